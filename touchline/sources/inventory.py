"""Inventories of files, and the small text formats beside the tables: manifests, id lists, box labels."""

from __future__ import annotations

import itertools
import json
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints
from .archives import _store
from .files import read_csv

#: Fixed kinds of files by extension.
KINDS = {
    "is_video": (".mp4", ".mkv", ".avi", ".mov"),
    "is_annotation": (".json", ".csv", ".txt"),
    "is_tracking_like": (".csv", ".json", ".parquet", ".pkl", ".npy", ".npz"),
    "is_metadata": (".md", ".yaml", ".yml", ".txt", ".json"),
}
MANIFEST = "clip_id string, split string, competition string, source string, game_id string, half long, video_path string, enabled string, notes string"
#: Fixed texts that count as yes.
YES = ("1", "true", "yes", "y")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    """What lies before the last slash; . without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(name: Column) -> Column:
    """The last dot of a name and what follows, in lower case; empty if nothing stands before or after the dot."""
    return F.lower(F.regexp_extract(name, r"[^.]\.*(\.[^.]+)$", 1))


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file under root but hidden ones (names that begin with a dot or an underscore): path, relative_path, filename, extension, parent_relative_dir, size, time, and which kinds its extension makes it. Contents aren't read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("file_size_bytes"), F.col("modificationTime").alias("modified_at"))
    plain = lambda c: F.regexp_replace(c, "^([a-z][a-z0-9+.-]*):/+", "$1:/")
    relative = F.substr(plain(F.col("path")), F.length(plain(F.lit(base))) + 2)
    df = df.withColumn("relative_path", relative).withColumn("filename", basename(F.col("relative_path")))
    df = df.withColumns({"extension": extension(F.col("filename")), "parent_relative_dir": parent(F.col("relative_path"))})
    return df.withColumns({k: F.col("extension").isin(*v).cast("int") for k, v in KINDS.items()})


def inventory_clip_id(path: Column) -> Column:
    """A relative path without its extension, runs of other characters than letters and digits as one underscore."""
    stem = F.regexp_replace(path, r"(?<=[^/.])\.[^./]+$", "")
    name = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(name != "", name).otherwise("clip")


def period_token(path: Column) -> Column:
    """The last token of a path that names a half; else what the file's name begins with; else unknown_period."""
    halves = F.regexp_extract_all(F.lower(F.translate(path, "\\", "/")), F.lit("(?<![a-z0-9])(h[12]|half[_ -]?[12]|[12](?:st|nd)?[_ -]?half)(?![a-z0-9])"), F.lit(1))
    name = F.lower(basename(path))
    first = lambda n: name.startswith(f"{n}_") | name.isin(*(f"{n}{e}" for e in (".mp4", ".mkv", ".avi", ".mov")))
    return F.coalesce(F.translate(F.try_element_at(halves, F.lit(-1)), " -", "__"), F.when(first(1), "h1").when(first(2), "h2").otherwise("unknown_period"))


def clips_of(files: DataFrame) -> DataFrame:
    """Each video of an inventory with the annotation, tracking and metadata files of its folder, sorted and joined by semicolons."""
    beside = files.groupBy("parent_relative_dir").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(F.col(k) == 1, F.col("relative_path")))), ";").alias(name) for k, name in (("is_annotation", "annotation_paths"), ("is_tracking_like", "tracking_paths"), ("is_metadata", "metadata_paths"))))
    v = files.where("is_video = 1").join(beside, "parent_relative_dir")
    return v.select(inventory_clip_id(F.col("relative_path")).alias("inventory_clip_id"), F.col("relative_path").alias("relative_video_path"), "filename", "extension", "parent_relative_dir", "annotation_paths", "tracking_paths", "metadata_paths", period_token(F.col("relative_path")).alias("period_token"))


def clips_with(files: DataFrame, *needed: str) -> DataFrame:
    """(clip_id) of the folders right under the root that hold all the files named (paths in the folder)."""
    at = F.col("relative_path")
    f = files.select(F.substring_index(at, "/", 1).alias("clip_id"), F.regexp_replace(at, "^[^/]*/", "").alias("file")).where(F.col("file").isin(*needed) & (F.instr(at, "/") > 0))
    return f.groupBy("clip_id").agg(F.countDistinct("file").alias("n")).where(F.col("n") == len(set(needed))).select("clip_id")


def _sniffed(root: str):
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv
        import io

        store, base = _store(root)

        def one(path: str, ext: str) -> tuple[str, str, str]:
            try:
                with store.open_input_stream(f"{base}/{path}") as raw:
                    text = io.TextIOWrapper(raw, encoding="utf-8-sig" if ext == ".csv" else "utf-8", errors="strict" if ext == ".csv" else "replace", newline="")
                    if ext == ".csv":
                        return "csv_header", ",".join(next(csv.reader(text), [])), ""
                    if ext == ".txt":
                        lines = [line.strip() for _, line in zip(range(5), text, strict=False)]
                        return "txt_preview", " | ".join(x for x in lines if x), ""
                    if ext == ".json":
                        x = json.loads(text.read())
                        if isinstance(x, dict):
                            return "json_object_keys", ",".join(sorted(map(str, x))[:50]), ""
                        return ("json_list", f"items={len(x)}", "") if isinstance(x, list) else ("json_scalar", type(x).__name__, "")
            except Exception as e:  # what a file holds is data: the error is its row
                return ext.lstrip(".") or "unknown", "", str(e)
            return ext.lstrip(".") or "unknown", "", ""

        for pdf in frames:
            found = [one(p, e) for p, e in zip(pdf["relative_path"], pdf["extension"], strict=True)]
            yield pd.DataFrame({"relative_path": pdf["relative_path"], "extension": pdf["extension"], **{k: [x[i] for x in found] for i, k in enumerate(("schema_kind", "schema_summary", "error_message"))}})

    return f


def sniffed(files: DataFrame, root: str) -> DataFrame:
    """Of each annotation file: a CSV's header, a JSON object's keys or a list's length, a text's first five lines; error_message if it can't be read."""
    f = files.where("is_annotation = 1").select("relative_path", "extension")
    return f.mapInPandas(_sniffed(root), "relative_path string, extension string, schema_kind string, schema_summary string, error_message string")


def read_manifest(spark: SparkSession, path: str, enabled_only: bool = False) -> DataFrame:
    """A manifest's rows with an id, typed: half is 0 if it is missing, enabled is what the text says (yes if it is missing). A missing column is an error."""
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    df = read_csv(spark, path, MANIFEST, names).where("clip_id is not null")
    df = df.withColumns({"half": F.coalesce("half", F.lit(0)), "enabled": F.lower(F.trim(F.coalesce("enabled", F.lit("true")))).isin(*YES), "source": F.coalesce("source", F.lit(""))})
    return df.where("enabled") if enabled_only else df


def manifest_row(manifest: DataFrame, clip_id: str) -> DataFrame:
    """The clip's one row; an error if there is none or more than one."""
    return constraints.lookup(manifest, "clip_id", clip_id)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(clip_id) of a text's lines, trimmed, each once; empty lines and those that begin with # are left out."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(line.alias("clip_id")).where((F.col("clip_id") != "") & ~F.col("clip_id").startswith("#")).distinct()


def _members(root: str):
    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root)
        for pdf in frames:
            for name in pdf["name"]:
                with store.open_input_file(f"{base}/{name}") as raw, zipfile.ZipFile(raw) as z:
                    for part in itertools.batched((m for m in z.namelist() if m.endswith(".txt")), 1024):
                        yield pd.DataFrame({"file": part, "value": [z.read(m).decode() for m in part]})

    return f


def read_box_labels(spark: SparkSession, path: str, width: int, height: int, classes: dict[int, str], bundled: bool = False) -> DataFrame:
    """(file, frame, class_name, box_id, x1, y1, x2, y2) of label texts: a line a box, class and middle and size as shares of the picture; the frame is the second part of the file's name between underscores, up to its first dot. Boxes are numbered by line. Lines of other classes are left out. bundled: the texts are members of the folder's ZIP files; of single texts the driver lists every one, so many belong in bundles."""
    name = F.col("_metadata.file_name")
    if bundled:
        texts = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select(name.alias("name")).mapInPandas(_members(path), "file string, value string")
    else:
        texts = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True).select(name.alias("file"), "value")
    raw = texts.select("file", F.posexplode(F.split("value", "\n")).alias("box_id", "line"))
    part = F.split(F.trim("line"), r"\s+")
    n = lambda i: F.get(part, F.lit(i)).try_cast("double")
    kind = F.create_map(*(x for k, v in classes.items() for x in (F.lit(k), F.lit(v))))
    frame = F.substring_index(F.get(F.split("file", "_"), F.lit(1)), ".", 1).try_cast("long")
    df = raw.where(F.trim("line") != "").select("file", frame.alias("frame"), F.try_element_at(kind, n(0).cast("int")).alias("class_name"), F.col("box_id").cast("long").alias("box_id"), *(n(i).alias(c) for i, c in ((1, "cx"), (2, "cy"), (3, "w"), (4, "h"))))
    mid_x, mid_y, half_w, half_h = F.col("cx") * width, F.col("cy") * height, F.col("w") * width / 2, F.col("h") * height / 2
    return df.where("class_name is not null").select("file", "frame", "class_name", "box_id", (mid_x - half_w).alias("x1"), (mid_y - half_h).alias("y1"), (mid_x + half_w).alias("x2"), (mid_y + half_h).alias("y2"))


def write_box_labels(boxes: DataFrame, path: str, width: int, height: int, classes: dict[int, str], bundle: int | None = None) -> int:
    """boxes (clip_id, frame, class_name, box_id, x1, y1, x2, y2) as label texts clip<clip_id>_<frame>.txt, in order of box_id; returns how many. A task writes its frames' files; a repeated task writes the same. bundle: the texts of so many successive frames of a clip are members of one ZIP file."""
    number = F.create_map(*(x for k, v in classes.items() for x in (F.lit(v), F.lit(k))))
    line = F.format_string("%d %.9f %.9f %.9f %.9f", number[F.col("class_name")], (F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height)
    texts = boxes.withColumn("line", line).groupBy("clip_id", "frame").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("box_id", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        for pdf in frames:
            for clip, frame, text in zip(pdf["clip_id"], pdf["frame"], pdf["text"], strict=True):
                with store.open_output_stream(f"{base}/clip{clip}_{frame}.txt") as out:
                    out.write((text + "\n").encode())
            yield pd.DataFrame({"n": [len(pdf)]})

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        store, base = _store(path)
        store.create_dir(base, recursive=True)
        clip, first = pdf["clip_id"].iloc[0], pdf["frame"].min() // bundle
        with store.open_output_stream(f"{base}/clip{clip}_{first}.zip") as out, zipfile.ZipFile(out, "w") as z:
            for frame, text in sorted(zip(pdf["frame"], pdf["text"], strict=True)):
                z.writestr(zipfile.ZipInfo(f"clip{clip}_{frame}.txt"), text + "\n")  # with a fixed date: a repeated task writes the same
        return pd.DataFrame({"n": [len(pdf)]})

    if bundle:
        return texts.groupBy("clip_id", F.floor(F.col("frame") / bundle)).applyInPandas(pack, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return texts.mapInPandas(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
