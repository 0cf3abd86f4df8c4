"""Tables by clip, inventories, manifests and archives on small cases."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.operators import labels
from touchline.sources import archives, files, inventory, sinks

ROWS = "clip_id string, frame long, x double"


def test_a_second_run_rewrites_nothing(spark, tmp_path):
    path, rows = str(tmp_path / "derived" / "t"), spark.createDataFrame([("a", 0, 1.0), ("a", 1, 2.0), ("b", 0, 3.0), ("c", 0, -1.0)], ROWS)
    rules = {"negative": F.col("x") < 0}
    status = lambda df: {r.clip_id: (r.status, r.rows, r.message) for r in df.collect()}
    assert status(sinks.build_clips(rows, path, rules)) == {"a": ("built", 2, None), "b": ("built", 1, None), "c": ("failed", 1, "negative (1 rows)")}
    times = {f: os.path.getmtime(f"{path}/clip_id={c}/{f}") for c in "ab" for f in os.listdir(f"{path}/clip_id={c}")}
    mended = rows.withColumn("x", F.abs("x"))
    assert status(sinks.build_clips(mended, path, rules)) == {"a": ("skipped", 2, None), "b": ("skipped", 1, None), "c": ("built", 1, None)}
    assert times == {f: os.path.getmtime(f"{path}/clip_id={c}/{f}") for c in "ab" for f in os.listdir(f"{path}/clip_id={c}")}
    assert sorted(map(tuple, sinks.read_clips(spark, path).select("clip_id", "frame", "x").collect())) == sorted(map(tuple, mended.collect()))
    assert {s for s, _, _ in status(sinks.build_clips(mended, path, rules, {"window": 5})).values()} == {"built"}  # other settings: built anew
    assert sinks.read_schema(spark, path) == {"columns": [{"name": "clip_id", "type": "string"}, {"name": "frame", "type": "bigint"}, {"name": "x", "type": "double"}], "settings": {"window": 5}}
    assert sinks.read_clips(spark, path).count() == 4


def test_a_stopped_run_is_repeated(spark, tmp_path):
    """A clip whose rows are there, but which wasn't recorded as done, is written anew and not doubled."""
    path, rows = str(tmp_path / "t"), spark.createDataFrame([("a", 0, 1.0), ("b", 0, 3.0)], ROWS)
    rows.where("clip_id = 'a'").withColumn("x", F.lit(99.0)).write.partitionBy("clip_id").parquet(path)
    assert {r.status for r in sinks.build_clips(rows, path).collect()} == {"built"}
    assert sorted(map(tuple, sinks.read_clips(spark, path).select("clip_id", "frame", "x").collect())) == [("a", 0, 1.0), ("b", 0, 3.0)]


def test_guards(spark, tmp_path):
    with pytest.raises(ValueError, match="Refusing"):
        sinks.guarded("/data/outputs/clip/x.csv")
    with pytest.raises(ValueError, match="derived"):
        sinks.guarded("/data/x.csv", required="derived")
    assert sinks.guarded("/data/derived/x", required="derived") == "/data/derived/x"
    assert sinks.read_optional(spark, str(tmp_path / "none"), ROWS).columns == ["clip_id", "frame", "x"]


def test_inventory(spark, tmp_path):
    for name, text in {"a/1_720p.mkv": "v", "a/labels.json": '{"b": 1, "a": 2}', "a/table.CSV": "x,y\n1,2\n", "a/sub dir/half-2.mp4": "v", "top.txt": "one\n\n two \n3\n4\n5\n6\n", "a/bad.json": "{", "a/list.json": "[1, 2]", "a/.hidden.csv": "x", "noext": "z", "b/x.parquet": "p"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    inv = inventory.inventory(spark, str(tmp_path))
    got = {r.relative_path: r for r in inv.collect()}
    assert sorted(got) == ["a/1_720p.mkv", "a/bad.json", "a/labels.json", "a/list.json", "a/sub dir/half-2.mp4", "a/table.CSV", "b/x.parquet", "noext", "top.txt"]
    t = got["a/table.CSV"]
    assert (t.filename, t.extension, t.parent_relative_dir, t.is_annotation, t.is_tracking_like, t.is_video, t.file_size_bytes) == ("table.CSV", ".csv", "a", 1, 1, 0, 8)
    assert (got["top.txt"].parent_relative_dir, got["noext"].extension, got["top.txt"].is_metadata) == (".", "", 1)
    clips = {r.relative_video_path: r for r in inventory.clips_of(inv).collect()}
    assert clips["a/1_720p.mkv"].annotation_paths == "a/bad.json;a/labels.json;a/list.json;a/table.CSV" and clips["a/sub dir/half-2.mp4"].annotation_paths == ""
    assert (clips["a/1_720p.mkv"].inventory_clip_id, clips["a/sub dir/half-2.mp4"].inventory_clip_id) == ("a_1_720p", "a_sub_dir_half_2")
    assert (clips["a/1_720p.mkv"].period_token, clips["a/sub dir/half-2.mp4"].period_token) == ("h1", "half_2")
    kinds = {r.relative_path: (r.schema_kind, r.schema_summary, r.error_message == "") for r in inventory.sniffed(inv, str(tmp_path)).collect()}
    assert kinds == {"a/labels.json": ("json_object_keys", "a,b", True), "a/table.CSV": ("csv_header", "x,y", True), "top.txt": ("txt_preview", "one | two | 3 | 4", True), "a/bad.json": ("json", "", False), "a/list.json": ("json_list", "items=2", True)}
    assert {r.clip_id for r in inventory.clips_with(inv, "labels.json", "sub dir/half-2.mp4").collect()} == {"a"}
    assert inventory.clips_with(inv, "labels.json", "none").count() == 0


def test_periods(spark):
    rows = spark.createDataFrame([("x/1st half/2_a.mp4",), ("x/h1/y_H2.mkv",), ("x/2_720p.mkv",), ("x/1.mp4",), ("x/oh1.mp4",), ("a\\half 2\\z.mp4",)], "p string")
    assert [r[0] for r in rows.select(inventory.period_token(F.col("p"))).collect()] == ["1st_half", "h2", "h2", "h1", "unknown_period", "half_2"]


def test_manifest_and_lists(spark, tmp_path):
    head = "clip_id,split,competition,source,game_id,half,video_path,enabled,notes"
    (tmp_path / "m.csv").write_text(head + "\na,v,c,s,g,1,p,TRUE,\nb,v,c,s,g,,p,no,n\n,v,c,s,g,1,p,1,\nb,v,c,s,g,2,p,,\n")
    m = inventory.read_manifest(spark, str(tmp_path / "m.csv"))
    assert sorted((r.clip_id, r.half, r.enabled) for r in m.collect()) == [("a", 1, True), ("b", 0, False), ("b", 2, True)]
    assert inventory.manifest_row(m, "a").first().half == 1
    for clip, says in (("b", "Duplicate"), ("z", "not found")):
        with pytest.raises(PySparkException, match=says):
            inventory.manifest_row(m, clip).collect()
    (tmp_path / "bad.csv").write_text("clip_id,split\na,v\n")
    with pytest.raises(ValueError, match="game_id"):
        inventory.read_manifest(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "ids.txt").write_text("# head\n a \n\nb\nb\n  #c\n")
    assert sorted(r.clip_id for r in inventory.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]


def test_json_of_every_shape(spark, tmp_path):
    for i, text in enumerate(['[{"a": 1}, {"a": 2, "b": "x"}]', '{\n "a": 5,\n "b": "y"\n}', "[\n {\"a\": 6}\n]\n", "nonsense"]):
        (tmp_path / f"{i}.json").write_text(text)
    got = sorted((r.a or 0, r.b) for r in files.read_json(spark, str(tmp_path), "a long, b string", whole=True).collect())
    assert got == [(0, None), (1, None), (2, "x"), (5, "y"), (6, None)]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "l.json").write_text('{"a": 3}\n{"a": 4, "b": "z"}\nnonsense\n')
    got = sorted((r.a or 0, r.b) for r in files.read_json(spark, str(tmp_path / "lines"), "a long, b string").collect())
    assert got == [(0, None), (3, None), (4, "z")]


def test_archives(spark, tmp_path):
    xml = '<annotations><meta><task><name> t </name><size>9</size></task></meta><track id="0" label="pass"><box frame="1" outside="0"><attribute name="n">1</attribute></box><box frame="2" outside="1"/><box outside="0"/></track><image/><track id="7" label="shot"><box frame="2"/></track></annotations>'
    with zipfile.ZipFile(tmp_path / "cvat_export__c1.zip", "w") as z:
        z.writestr("other.xml", "<annotations/>")
        z.writestr("in/Annotations.XML", xml)
    (tmp_path / "note.txt").write_text("x")
    got = sorted(tuple(r) for r in archives.read_annotations(spark, str(tmp_path)).collect())
    assert got == [("c1", "cvat_export__c1.zip", "t", 9, 0, "pass", 1, False), ("c1", "cvat_export__c1.zip", "t", 9, 0, "pass", 2, True), ("c1", "cvat_export__c1.zip", "t", 9, 1, "shot", 2, False)]
    assert archives.read_annotations(spark, str(tmp_path / "none")).count() == 0
    e = labels.annotated_intervals(archives.read_annotations(spark, str(tmp_path))).orderBy("event_id").collect()
    assert [(r.event_id, r.event_type, r.start_frame, r.end_frame) for r in e] == [("c1__event_0001", "pass", 1, 1), ("c1__event_0002", "shot", 2, 2)]
    again = str(tmp_path / "again")
    archives.write_annotations(archives.read_annotations(spark, str(tmp_path)), again)
    assert sorted(tuple(r) for r in archives.read_annotations(spark, again).collect()) == got and os.listdir(again) == ["cvat_export__c1.zip"]
    with zipfile.ZipFile(tmp_path / "cvat_export__empty.zip", "w") as z:
        z.writestr("a.txt", "x")
    with pytest.raises(PySparkException, match="no XML file found in cvat_export__empty.zip"):
        archives.read_annotations(spark, str(tmp_path)).collect()


def test_headers_and_keys(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Frame, x ,name\n1,0.5,a\n2,,b\nz,1.5,c\n,2.5,d\n")
    df, header = files.read_csv_with_header(spark, str(tmp_path / "t.csv"))
    assert header == ["Frame", " x ", "name"] and df.count() == 4
    got = files.read_csv(spark, str(tmp_path / "t.csv"), "frame long, name string", keys=["frame"])
    assert sorted((r.frame, r.name) for r in got.collect()) == [(1, "a"), (2, "b")]
