"""What must not grow faster than the input, on small cases."""

import os
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from touchline.operators import candidates, frame_table, labels, motion, segments, tables, tracking
from touchline.plans import catalog
from touchline.sources import archives, inventory


def plan_of(df):
    return df._jdf.queryExecution().toString().lower()


def test_nearest_row_builds_no_frame_to_the_end(spark):
    """A frame that ends with the clip is built again for each row: n^2 steps a clip."""
    left = spark.createDataFrame([(1, f) for f in (0, 4, 5, 6, 11)] + [(2, 1)], "clip_id long, frame long")
    right = spark.createDataFrame([(1, 4, "a"), (1, 8, "b")], "clip_id long, frame long, v string")
    df = tables.nearest_row(left, right, "v")
    assert "unboundedfollowing" not in plan_of(df)
    assert {(r.clip_id, r.frame): r.nearest_v for r in df.collect()} == {(1, 0): "a", (1, 4): "a", (1, 5): "a", (1, 6): "a", (1, 11): "b", (2, 1): None}


def test_times_build_no_frame_to_the_end(spark):
    events = spark.createDataFrame([(1, 0), (1, 6), (1, 7), (1, 20)], "clip_id long, at long")
    frames = spark.createDataFrame([(1, 4, 0.4), (1, 8, 0.8)], "clip_id long, frame long, timestamp double")
    df = candidates.with_time(events, frames, "at", "time")
    assert "unboundedfollowing" not in plan_of(df)
    assert {r["at"]: r.time for r in df.collect()} == {0: 0.4, 6: 0.4, 7: 0.8, 20: 0.8}


def test_quantiles_are_those_of_sql(spark):
    """Large groups by way of the bracket, small ones whole, with ties, nulls and an empty group; values as DuckDB's to the last bit."""
    n = 30_000
    df = spark.range(n).selectExpr("id % 3 as k", "case when id % 11 <> 0 then sqrt(id * 7919 % 10007 / 25.0) end as x", "double(id % 3) as same")
    df = df.unionByName(spark.createDataFrame([(9, None, 1.0), (10, 4.0, 1.0), (11, 1.0, 2.0), (11, 2.0, 4.0)], "k long, x double, same double"))
    got = {}
    for accuracy in (100, 10_000):  # groups of a thousand values are large with the first
        q = tables.quantiles(df, ["k"], {"a": (F.col("x"), 0.95), "b": (F.col("x"), 0.5), "c": (F.col("same"), 0.9), "d": (F.col("x"), 1.0), "e": (F.col("x"), 0.0)}, accuracy)
        got[accuracy] = sorted(tuple(r) for r in q.collect())
    con = duckdb.connect()
    pdf = df.toPandas()  # noqa: F841
    want = con.execute("SELECT k, quantile_cont(x, 0.95::DOUBLE), quantile_cont(x, 0.5::DOUBLE), quantile_cont(same, 0.9::DOUBLE), quantile_cont(x, 1::DOUBLE), quantile_cont(x, 0::DOUBLE) FROM pdf GROUP BY 1 ORDER BY 1").fetchall()
    want = [tuple(None if x != x else x for x in r) for r in want]
    assert got[100] == got[10_000] == want


def test_peaks_are_those_above_the_quantile_of_sql(spark):
    """The quantile of these two speeds is one bit higher if it is a mixture of both: a speed of just that value would be lost."""
    low, high, part = 12139.218467441306, 12139.939250262278, 0.2999999999956344
    assert low + (high - low) * part < (1 - part) * low + part * high
    q = 0.95
    n = 68515
    below = int((n - 1) * q)
    df = spark.range(n).selectExpr("1L as clip_id", f"case when id < {below} then 1.0D when id = {below} then {low!r}D when id = {below + 1} then {high!r}D else 20000.0D end as ball_speed", "cast(null as double) as ball_acceleration")
    assert candidates.thresholds(df, q).first().speed_limit == low + (high - low) * part


def test_shares_are_written_from_their_exact_value(spark):
    """23 of 80 frames are 0.2875 in short, but a little less in truth: 0.287."""
    p = spark.range(80).selectExpr("1L as clip_id", "id as frame", "id / 25D as timestamp", "'Team A' as team", "1L as player_id", "600D as ball_x", "100D as ball_y", "false as is_interpolated", "10D as distance_to_ball")
    m = spark.range(80).selectExpr("1L as clip_id", "id as frame", "case when id in (12, 24, 36, 48, 60, 67) then 90D else 1D end as ball_speed", "cast(null as double) as ball_acceleration", "1 as velocity_valid", "0 as acceleration_valid")
    carries = spark.createDataFrame([(1, 0, 22, "ok")], "clip_id long, start_frame long, end_frame long, carry_quality_flag string")
    [r] = candidates.shot_candidates(p, m, carries).collect()
    assert (r.start_frame, r.end_frame, r.carry_overlap) == (0, 79, 0.2875)
    assert r.rule_reasons.endswith("carry_overlap_fraction=0.287")


def test_medians_move_no_rows(spark):
    """Rows stay where they are: only counts of values near the median are shuffled, and nothing is collected by group."""
    df = spark.range(1000).selectExpr("id % 2 as k", "double(id) as x")
    for got in (tables.inliers(df, ["k"], "x", 1.0, 1.5), tables.robust_scaled(df, ["k"], ["x"])):
        plan = plan_of(got)
        assert "sortmergejoin" not in plan and " percentile(" not in plan


def test_box_labels_are_bundled(spark, tmp_path):
    """A file for many frames, so that the driver lists few; the same rows as from single texts."""
    rows = [(c, f, "Ball" if b == 2 else "Player", b, 10.0 * b, 5.0, 10.0 * b + 8, 25.0) for c in (1, 2) for f in range(50) for b in range(3)]
    boxes = spark.createDataFrame(rows, "clip_id long, frame long, class_name string, box_id long, x1 double, y1 double, x2 double, y2 double")
    classes, one, many = {0: "Player", 2: "Ball"}, str(tmp_path / "one"), str(tmp_path / "many")
    assert inventory.write_box_labels(boxes, one, 1280, 720, classes) == inventory.write_box_labels(boxes, many, 1280, 720, classes, bundle=20) == 100
    assert sorted(f.name for f in (tmp_path / "many").iterdir() if f.suffix == ".zip") == [f"clip{c}_{i}.zip" for c in (1, 2) for i in range(3)]
    read = lambda path, **k: sorted(map(tuple, inventory.read_box_labels(spark, path, 1280, 720, classes, **k).collect()))
    assert read(many, bundled=True) == read(one) and len(read(one)) == 300


def test_windows_keep_clips_spread(spark):
    """The clip's first time comes by a broadcast, not by a window that holds the clip; a row without a clip keeps its windows."""
    t = spark.createDataFrame([(1, 0.0, 1.0, 2.0), (1, 5.5, 3.0, 4.0), (None, 9.0, 1.0, 2.0)], "clip_id long, timestamp double, center_x double, center_y double")
    df = motion.tumbling_means(t)
    assert "window [" not in plan_of(df) and "windowspecdefinition" not in plan_of(df)
    assert sorted((str(r.clip_id), r.window, r.rows) for r in df.collect()) == [("1", 0, 1), ("1", 1, 1), ("None", 0, 1)]


def test_trackers_hold_no_clip(spark):
    """A clip streams through its task: rows leave before the last ones are read, frames and clips may be cut by a batch, ids are exact."""
    big = 2**53 + 1
    rows = [(c, f, k, f / 25, 10.0 * f + 300 * k, 0.0, 0.5) for c in (1, big) for f in range(400) for k in (0, 1)]
    names = ["clip_id", "frame", "det_id", "timestamp", "center_x", "center_y", "confidence"]
    read = []

    def batches():
        for i in range(0, len(rows), 7):
            read.append(i)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 7]])

    out = tracking.worked_off(batches(), tracking.LinkMachine(90.0, 8, 2), 50)
    got = next(out).to_pylist()
    assert len(read) < 20
    got += [r for b in out for r in b.to_pylist()]
    assert sorted((r["clip_id"], r["frame"], r["track_id"]) for r in got) == [(c, f, k + 1) for c in (1, big) for f in range(400) for k in (0, 1)]
    df = tracking.link_ball_tracks(spark.createDataFrame([*rows, (None, 0, 0, 0.0, 0.0, 0.0, 0.5), (None, 1, 0, 0.1, 1.0, 0.0, None), (1, None, 0, 0.0, 0.0, 0.0, 0.5)], ", ".join(f"{n} {k}" for n, k in zip(names, ["long"] * 3 + ["double"] * 4, strict=True))))
    assert "flatmapgroups" not in plan_of(df)
    assert sorted((r.clip_id or 0, r.frame) for r in df.collect()) == sorted([(0, 0), (0, 1), *((r[0], r[1]) for r in rows)])


def test_archives_are_written_by_tracks(tmp_path):
    """A task that writes a clip sorts its tracks, a row each, not its boxes; long archives are read by a task each."""
    root = str(tmp_path)
    writer = archives.ArchiveWriter(root)
    rows = [Row(clip_id=c, track_no=t, label="pass", frames=[1, 2], outside=[False, None], task_name="t", task_size=9) for c in ("a", "b") for t in (0, 4)]
    writer.commit([writer.write(iter(rows))])
    got = [r for p in archives.ArchiveReader(root).partitions() for r in archives.ArchiveReader(root).read(p)]
    assert got == [(c, f"cvat_export__{c}.zip", "t", 9, n, "pass", f, False) for c in ("a", "b") for n in (0, 1) for f in (1, 2)]
    for k in range(3):
        with open(tmp_path / f"cvat_export__{k}.zip", "wb") as f:
            f.truncate(8 << 20)
    assert sorted(len(p.paths) for p in archives.ArchiveReader(root).partitions()) == [1, 1, 1, 2]


@pytest.mark.parametrize("name", ["annotation_archives", "annotation_events", "annotation_issues"])
def test_archives_are_parsed_once(spark, name):
    """Archives are parsed and intervals numbered before the query's last plan, which reads saved tables."""
    df = catalog.QUERIES[name](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" in plan and "annotations" not in plan and "Window" not in plan


def test_intervals_shuffle_boxes_once(spark):
    """A frame that comes twice breaks no run and needs no shuffle of its own; issues are those of the intervals given."""
    rows = [("a", t, "pass", f, False, "cvat_export__a.zip", "x", 9) for t in (0, 1) for f in (3, 1, 2, 2, 5)] + [("b", 0, "shot", f, o, "cvat_export__b.zip", "", 0) for f, o in ((1, True), (2, False), (None, False), (-1, False))]
    boxes = spark.createDataFrame(rows, "clip_id string, track_no long, label string, frame long, outside boolean, archive string, task_name string, task_size long")
    numbered = labels.numbered_intervals(boxes)
    assert "distinct" not in plan_of(numbered)
    assert sorted((r.clip_id, r.n, r.start_frame, r.end_frame, r.track_no, r.duplicates) for r in numbered.collect()) == [("a", 1, 1, 3, 0, 1), ("a", 2, 5, 5, 0, 1), ("b", 1, 2, 2, 0, 0)]
    manifest = spark.createDataFrame([("a", 25.0, 0.0, "x")], "clip_id string, fps double, duration_seconds double, cvat_task_name string")
    want = [("a", "error", "duplicate event: pass 1-3"), ("a", "error", "duplicate event: pass 5-5"), ("b", "error", "unknown clip export: cvat_export__b.zip")]
    given = spark.createDataFrame(numbered.collect(), numbered.schema)
    for df in (labels.annotation_issues(boxes, manifest), labels.annotation_issues(boxes, manifest, given)):
        assert sorted(map(tuple, df.collect())) == want
    assert "windowspecdefinition" not in plan_of(labels.annotation_issues(boxes, manifest, given))


def test_windows_of_the_frame_table_are_narrow(spark):
    """No window sorts the players of its frames, no aggregate is shuffled half done; rows without a frame keep their players."""
    t = spark.createDataFrame([(1, f, f / 25, k, 10.0 * k + f, 5.0, 40.0, 0.9) for f in (0, 1, 2) for k in (0, 5)] + [(1, None, 0.5, 0, 1.0, 1.0, 40.0, 0.9), (None, 3, 0.5, 0, 1.0, 1.0, 40.0, 0.9)], "clip_id long, frame long, timestamp double, track_id long, center_x double, center_y double, height double, confidence double")
    teams = spark.createDataFrame([(1, 0, "Team A"), (1, 5, "Team B")], "clip_id long, track_id long, team string")
    ball = spark.createDataFrame([(1, f, f / 25, 3.0 * f, 4.0, 0.9, False) for f in (1, 2, 4)], "clip_id long, frame long, timestamp double, center_x double, center_y double, confidence double, is_interpolated boolean")
    owner = spark.createDataFrame([(1, f, f / 25, "Team A", 0, 1.0, "ok") for f in (2, 4)], "clip_id long, frame long, timestamp double, team string, player_id long, distance_to_ball double, possession_reason string")
    df = frame_table.temporal_frames(t, teams, ball, owner)

    def nodes(p):
        yield p
        for i in range(p.children().size()):
            yield from nodes(p.children().apply(i))

    windows = [n.output().mkString(",") for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Window"]
    assert windows and not [w for w in windows if "players#" in w]
    got = {(r.clip_id, r.frame): r for r in df.collect()}
    assert {k: r.player_count for k, r in got.items()} == {(1, 0): 2, (1, 1): 2, (1, 2): 2, (1, 4): 0, (1, None): 1, (None, 3): 1}
    assert (got[1, 2].ball_vx, got[1, 4].frames_since_possession_change, got[1, None].timestamp, got[None, 3].possession_changed, got[1, 2].p1_track_id) == (3.0 / (2 / 25 - 1 / 25), 2, 0.5, 0, 0)


def test_carries_sort_no_players(spark):
    """The owners of frames are hashed, the players stream past them; both sides are shuffled, neither is broadcast."""
    p = spark.range(8).selectExpr("1L as clip_id", "id as frame", "id / 25D as timestamp", "'Team A' as team", "2L as player_id", "10D * id as ball_x", "0D as ball_y", "false as is_interpolated", "5D as distance_to_ball")
    players = spark.range(80).selectExpr("1L as clip_id", "id div 10 as frame", "id % 10 as track_id", "10D * (id div 10) as center_x", "double(id % 10) as center_y", "40D as height")
    df = segments.estimate_carries(p, players)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "LeftOuter, BuildLeft" in plan
    [r] = df.collect()
    assert (r.player_id, r.start_frame, r.end_frame, r.player_distance_px, r.mean_player_box_height) == (2, 0, 7, 70.0, 40.0)


def test_listed_frames_stay_off_the_driver(spark, tmp_path):
    """Spark takes listed frames to be as few as their events, and a saved table to be as small as its file: it would broadcast them, however many they are."""
    s = "clip_id long, shot_id long, image_width long, center_frame long, start_frame long, end_frame long, interpolated_share double, carry_overlap double, motion_frames long, tier string"
    spark.createDataFrame([(1, 1, 1000, 6, 4, 8, 0.0, 0.0, 3, "low"), (1, 2, 1000, 40, 30, 50, 0.0, 0.0, 3, "low")], s).write.parquet(str(tmp_path / "shots"))
    spark.range(60).selectExpr("1L as clip_id", "id as frame", "case when id < 20 then 10D else 500D end as ball_x").write.parquet(str(tmp_path / "frames"))
    shots, frames = (spark.read.parquet(str(tmp_path / name)) for name in ("shots", "frames"))
    df = candidates.refine_shots(shots, frames)
    near = candidates.around(shots.select("clip_id", "start_frame", "end_frame"), F.col("start_frame"), F.col("end_frame"), frames, n=F.count("*"))
    met = motion.nearest_within(shots.select("clip_id", F.col("shot_id").alias("id"), F.col("center_frame").alias("frame")), shots.select("clip_id", F.col("shot_id").alias("id"), F.col("start_frame").alias("frame")), 2)
    for got, key in ((df, "frame"), (near, "frame"), (met, "_b")):
        assert re.search(rf"SortMergeJoin \[clip_id#\w+, {key}#", got._jdf.queryExecution().executedPlan().toString())
    assert {(r.shot_id, r.review) for r in df.collect()} == {(1, 1), (2, 0)}
    assert {(r.start_frame, r.n) for r in near.collect()} == {(4, 5), (30, 21)}
    assert {(r.left_id, r.right_id, r.delta) for r in met.collect()} == {(1, 1, 2), (2, None, None)}


def test_weak_passes_meet_by_frames(spark):
    """A pass meets the weak passes near it, not all of its two players in the clip: pairs don't grow with the square of a clip."""
    rows = [(1, 100 * i + f, (100 * i + f) / 25, "Team A", p) for i in range(40) for p, at in ((1, range(0, 5)), (2, range(7, 12))) for f in at]
    p = spark.createDataFrame(rows, "clip_id long, frame long, timestamp double, team string, player_id long").selectExpr("*", "600D as ball_x", "100D as ball_y", "false as is_interpolated", "10D as distance_to_ball")
    m = spark.range(4000).selectExpr("1L as clip_id", "id as frame", "1D as ball_speed", "cast(null as double) as ball_acceleration", "1 as velocity_valid", "0 as acceleration_valid")
    weak = spark.createDataFrame([(1, i, 100 * i + 4, 100 * i + 7, 1, 2, "Team A") for i in range(40)] + [(1, 90, 6, 5, 1, 2, "Team A"), (1, 91, 104, 107, 2, 1, "Team A"), (1, 92, 204, 207, 1, 2, "Team B")], "clip_id long, pass_id long, start_frame long, end_frame long, from_player long, to_player long, team string")
    df = candidates.pass_candidates(p, m, weak)
    assert "_bucket" in plan_of(df)
    assert sorted((r.start_frame, r.weak_pass_id) for r in df.collect()) == [(100 * i + 4, i) for i in range(40)]
    alone = candidates.pass_candidates(p, m, weak.where("pass_id = 90")).where("weak_pass_id is not null").collect()
    assert [(r.start_frame, r.weak_pass_id) for r in alone] == [(4, 90)]
