"""Archives of annotated boxes as a data source of its own: a ZIP a clip, in it one XML file of tracks and their boxes.

Reading: the driver lists names and sizes only; tasks open the archives and stream
the XML, so memory is bounded by one element. Writing: a task streams its clips'
archives under names of its own, the commit of the job gives them their names.
Any store that pyarrow knows by its URI will do.
"""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed names: of an archive before its clip, of the file in it.
PREFIX, INNER = "cvat_export__", "annotations.xml"
SCHEMA = "clip_id string, archive string, task_name string, task_size long, track_no long, label string, frame long, outside boolean"
#: Bytes of archives that a task reads: their texts are some twenty times as long.
TASK_BYTES = 4 << 20


def _store(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _xml(archive: zipfile.ZipFile, name: str):
    names = [n for n in archive.namelist() if n.lower().endswith(".xml")]
    if not names:
        raise ValueError(f"no XML file found in {name}")
    return archive.open(next((n for n in names if n.rsplit("/", 1)[-1].lower() == INNER), names[0]))


def task_of(xml) -> tuple[str, int]:
    """(name, size) of the task that meta tells; empty and 0 without one."""
    path, name, size = [], "", 0
    for event, e in ElementTree.iterparse(xml, ("start", "end")):
        if event == "start":
            path.append(e.tag)
            continue
        if path[1:] == ["meta", "task", "name"]:
            name = (e.text or "").strip()
        elif path[1:] == ["meta", "task", "size"]:
            size = int(e.text) if (e.text or "").strip().isdigit() else 0
        elif path[1:] == ["meta"]:
            break
        path.pop()
    return name, size


def boxes_of(xml) -> Iterator[tuple[int, str, int, bool]]:
    """(number of the track in the file, label, frame, outside) of each box of each track; boxes without a frame are left out."""
    no, label, depth, root = -1, "", 0, None
    for event, e in ElementTree.iterparse(xml, ("start", "end")):
        if event == "start":
            depth += 1
            root = e if root is None else root
            if depth == 2 and e.tag == "track":
                no, label = no + 1, e.get("label", "")
            continue
        depth -= 1
        if depth == 2 and e.tag == "box" and e.get("frame") is not None and no >= 0:
            yield no, label, int(e.get("frame")), e.get("outside", "0") in ("1", "true", "True")
        if depth == 2:
            e.clear()
        elif depth == 1:
            root.clear()


@dataclass
class Archives(InputPartition):
    paths: list[str]


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = sorted((f.path, f.size) for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and f.base_name.startswith(PREFIX) and f.base_name.endswith(".zip"))
        parts: list[Archives] = []
        held = TASK_BYTES
        for path, size in found:
            if held + size > TASK_BYTES:
                parts.append(Archives([]))
                held = 0
            parts[-1].paths.append(path)
            held += size
        return parts or [Archives([])]

    def read(self, partition: Archives) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            name = path.rsplit("/", 1)[-1]
            with store.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                with _xml(archive, name) as xml:
                    task = task_of(xml)
                with _xml(archive, name) as xml:
                    for box in boxes_of(xml):
                        yield (name[len(PREFIX) : -4], name, *task, *box)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    """A row is a track with its boxes (frames, outside) in order; rows must come by clip and track."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        out, files, clip = None, [], None

        def end() -> None:
            out[2].write(b"</annotations>\n")
            for x in reversed(out):
                x.close()

        for r in rows:
            r = r.asDict()
            if not out or r["clip_id"] != clip:
                if out:
                    end()
                clip = r["clip_id"]
                own = f"{root}/.{uuid.uuid4().hex}"
                files.append((own, f"{root}/{PREFIX}{clip}.zip"))
                file = store.open_output_stream(own)
                archive = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
                out = (file, archive, archive.open(INNER, "w"))
                text = io.StringIO()
                text.write(f'<?xml version="1.0" encoding="utf-8"?>\n<annotations><meta><task><name>{_text(r.get("task_name"))}</name><size>{r.get("task_size") or 0}</size></task></meta>\n')
                out[2].write(text.getvalue().encode())
            boxes = "".join(f'<box frame="{f}" outside="{int(bool(o))}"/>\n' for f, o in zip(r["frames"], r["outside"], strict=True))
            out[2].write(f'<track id="{r["track_no"]}" label={quoteattr(r["label"] or "")}>\n{boxes}</track>\n'.encode())
        if out:
            end()
        return Written(files)

    def commit(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for own, name in m.files if m else ():
                store.move(own, name)

    def abort(self, messages) -> None:
        store, _ = _store(self.path)
        for m in messages:
            for own, _name in m.files if m else ():
                store.delete_file(own)


def _text(s: str | None) -> str:
    return (s or "").replace("&", "&amp;").replace("<", "&lt;")


class AnnotationArchives(DataSource):
    """Format "annotations": option path, a folder of archives."""

    @classmethod
    def name(cls) -> str:
        return "annotations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"])


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Every box of the folder's archives (SCHEMA); no folder or no archive: no rows. An archive without an XML file is an error that names it."""
    spark.dataSource.register(AnnotationArchives)
    return spark.read.format("annotations").load(path)


def write_annotations(boxes: DataFrame, path: str) -> None:
    """boxes (clip_id, track_no, label, frame, outside; task_name and task_size if they are known) as one archive a clip; one that is there is replaced."""
    boxes.sparkSession.dataSource.register(AnnotationArchives)
    told = [F.min_by(c, F.coalesce("frame", F.lit(0))).alias(c) for c in ("label", "task_name", "task_size") if c in boxes.columns]
    tracks = boxes.groupBy("clip_id", "track_no").agg(*told, F.array_sort(F.collect_list(F.struct("frame", "outside"))).alias("b"))
    tracks = tracks.withColumns({"frames": F.col("b.frame"), "outside": F.col("b.outside")}).drop("b")
    tracks.repartition("clip_id").sortWithinPartitions("clip_id", "track_no").write.format("annotations").mode("append").save(path)
