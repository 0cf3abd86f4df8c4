"""Operators that SQL can't express, files and streams, on small cases."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from touchline.operators import candidates, motion, shape, tables, teams, tracking, windows
from touchline.sources import files
from touchline.streaming import windows as streams

PASS = "clip_id long, team string, pass_id long, start_frame long, end_frame long, center_frame long, from_player long, to_player long, duration double, max_speed double, max_acceleration double, ball_distance double, confidence double, tier string, consistent int, frame_gaps long, rule_reasons string"


def one_pass(start, end, a, b, duration=0.4, speed=100.0, acceleration=None, confidence=0.85, tier="high", consistent=1, gaps=0):
    return (start, end, (start + end) // 2, a, b, duration, speed, acceleration, 1.0, confidence, tier, consistent, gaps, "why")


def refined(spark, rows):
    df = spark.createDataFrame([(1, "Team A", i, *r) for i, r in enumerate(rows, 1)], PASS)
    return [(r.start_frame, r.end_frame, r.members, r.merge_blocked, r.status, r.weak_eligible) for r in candidates.refine_passes(df).orderBy("start_frame").collect()]


def test_passes_merge_up_to_24_frames(spark):
    """The inclusive span decides; a blocked merge doesn't bar a sound pass from training, but leaves an unsound one for review."""
    a, b = one_pass(0, 10, 1, 2), one_pass(12, 23, 2, 1, speed=50.0, confidence=0.65, tier="medium")
    assert refined(spark, [a, b]) == [(0, 23, 2, False, "merged", 1)]
    b = one_pass(12, 24, 2, 1, speed=50.0, confidence=0.65, tier="medium")
    assert refined(spark, [a, b]) == [(0, 10, 1, True, "kept", 1), (12, 24, 1, True, "review_only", 0)]


def test_passes_far_apart_or_unlike_stay(spark):
    a, unlike, far = one_pass(0, 4, 1, 2), one_pass(8, 12, 3, 4, speed=10.0, acceleration=5.0, confidence=0.35, tier="low"), one_pass(30, 34, 2, 1, duration=0.04)
    assert refined(spark, [a, unlike, far]) == [(0, 4, 1, False, "kept", 1), (8, 12, 1, False, "kept", 0), (30, 34, 1, False, "suppressed", 0)]
    assert refined(spark, []) == []


def test_like_passes(spark):
    """Equal accelerations are alike, and two unknown ones; an unknown speed is not like a slow one. The span is the last frame less the first."""
    a = one_pass(0, 4, 1, 2, speed=100.0, acceleration=50.0)
    assert refined(spark, [a, one_pass(8, 12, 3, 4, speed=5.0, acceleration=51.0)])[0][2] == 2
    assert refined(spark, [one_pass(0, 4, 1, 2, speed=None, acceleration=50.0), one_pass(8, 12, 3, 4, speed=0.0, acceleration=5.0)])[0][2] == 1
    assert refined(spark, [one_pass(0, 4, 1, 2, speed=None, acceleration=50.0), one_pass(8, 12, 3, 4, speed=None, acceleration=5.0)])[0][2] == 2
    assert [r[4] for r in refined(spark, [one_pass(0, 1, 1, 2), one_pass(40, 42, 1, 2)])] == ["suppressed", "kept"]


POSSESSION = "clip_id long, frame long, timestamp double, team string, player_id long, ball_x double, ball_y double, is_interpolated boolean, distance_to_ball double"
MOTION = "clip_id long, frame long, ball_speed double, ball_acceleration double, velocity_valid int, acceleration_valid int"


def possession(spark, owners, skip=(), seconds=0.04, xs=None):
    """Frames from 0 on with owners like 'A1' or '-'."""
    rows = [(1, f, f * seconds, {"A": "Team A", "B": "Team B", "-": "None"}[o[0]], int(o[1:]) if o != "-" else None, (xs or {}).get(f, 600.0), 100.0, False, 10.0) for f, o in enumerate(owners) if f not in skip]
    return spark.createDataFrame(rows, POSSESSION)


def motion_of(spark, n, fast=(), still=False):
    return spark.createDataFrame([(1, f, 90.0 if f in fast else 1.0 + f / 1000, None, int(not still), 0) for f in range(n)], MOTION)


def test_tiers_of_passes(spark):
    """high needs stable owners, no gap, motion and speed; a weak pass makes up for motion, not for a gap or short owners."""
    weak = "clip_id long, pass_id long, start_frame long, end_frame long, from_player long, to_player long, team string"
    none, some = spark.createDataFrame([], weak), spark.createDataFrame([(1, 9, 2, 4, 1, 2, "Team A")], weak)
    owners = ["A1"] * 4 + ["A2"] * 30
    tier = lambda own, moves, w=none, **k: [(r.tier, r.confidence) for r in candidates.pass_candidates(possession(spark, own, **k), moves, w).collect()]
    fast, slow = motion_of(spark, 34, fast=(3, 4, 5)), motion_of(spark, 34, fast=range(20, 34))
    assert tier(owners, fast) == [("high", 0.85)]
    assert tier(owners, slow) == [("medium", 0.65)]
    assert tier(["A1"] * 2 + ["A2"] * 32, fast) == [("low", 0.35)]
    assert tier(["A1"] * 4 + ["-", "-"] + ["A2"] * 28, fast, skip=(4,)) == [("low", 0.35)]
    still = motion_of(spark, 34, still=True)
    assert tier(owners, still) == [("low", 0.35)] and tier(owners, still, some) == [("medium", 0.65)]


def test_turnovers_have_no_limit_of_time_and_medium_ones_are_not_trained_on(spark):
    owners = ["A1"] * 3 + ["-"] * 80 + ["B2"] * 4
    found = candidates.turnover_candidates(possession(spark, owners), motion_of(spark, 87), spark.createDataFrame([], "clip_id long, interception_id long, frame long"))
    r = found.collect()[0]
    assert (r.start_frame, r.end_frame, r.subtype, r.tier) == (2, 83, "possession_turnover", "medium")
    bounds = spark.createDataFrame([(1, 0, 86)], "clip_id long, min_frame long, max_frame long")
    r = candidates.refine_turnovers(found, bounds).collect()[0]
    assert (r.start_frame, r.end_frame, r.status, r.review, r.weak_eligible) == (75, 86, "review_only", 1, 0)
    met = candidates.turnover_candidates(possession(spark, owners), motion_of(spark, 87), spark.createDataFrame([(1, 5, 85), (1, 4, 81)], "clip_id long, interception_id long, frame long"))
    r = candidates.refine_turnovers(met, bounds).collect()[0]
    assert (r.interception_id, r.frame_delta, r.tier, r.status, r.weak_eligible) == (4, -2, "high", "kept", 1)


def test_shots(spark):
    """Near an end anywhere in the span counts for the candidate, but only within six frames of the peak for the review."""
    owners, peak = ["A1"] * 60, motion_of(spark, 60, fast=(30,))
    carries = spark.createDataFrame([], "clip_id long, start_frame long, end_frame long, carry_quality_flag string")

    def one(xs):
        p = possession(spark, owners, xs={0: 999.0} | xs)
        s = candidates.shot_candidates(p, peak, carries)
        return [(r.start_frame, r.end_frame, r.image_width, r.tier, r.status, r.review) for r in candidates.refine_shots(s, p).collect() if r.center_frame == 30]

    assert one({20: 5.0}) == [(18, 42, 1000, "medium", "suppressed", 0)]
    assert one({33: 5.0}) == [(18, 42, 1000, "medium", "review_only", 1)]
    assert one({}) == [(18, 42, 1000, "low", "suppressed", 0)]
    carries = spark.createDataFrame([(1, 18, 25, "ok"), (1, 30, 40, "contains_interpolation")], "clip_id long, start_frame long, end_frame long, carry_quality_flag string")
    assert one({33: 5.0}) == [(18, 42, 1000, "low", "suppressed", 0)]


def test_windows_are_labelled_by_their_middle(spark):
    """Of frames 0 to 63 the middle is 23 to 38."""
    frames = spark.createDataFrame([(1, f) for f in range(64)], "clip_id long, frame long")
    label = lambda *e: [(r.target_class, r.event_id, r.event_overlap_frames) for r in motion.hopping_windows(frames, spark.createDataFrame([(1, *x) for x in e], "clip_id long, event_id long, label string, start_frame long, end_frame long")).collect()]
    assert label((7, "pass", 0, 23)) == [("pass", 7, 1)]
    assert label((7, "pass", 39, 60), (8, "shot", 0, 22)) == [("background", None, 0)]
    assert label((7, "pass", 23, 25), (9, "shot", 36, 38), (8, "shot", 30, 32)) == [("shot", 8, 3)]


def test_ball_gates(spark):
    box = "clip_id long, frame long, det_id long, width long, height long, center_y double, confidence double"
    rows = [(2, 5, 5, 400.0, 0.5), (3, 31, 10, 400.0, 0.5), (4, 3, 10, 400.0, 0.5), (5, 10, 31, 400.0, 0.5), (6, 10, 3, 400.0, 0.5), (7, 10, 10, 57.0, 0.9), (8, 10, 10, 400.0, 0.4), (9, 10, 10, 400.0, 0.6), (10, 3, 3, 1.0, 0.1), (11, 30, 30, 1.0, 0.1)]
    df = spark.createDataFrame([(1, 0, *r) for r in rows], box)
    got = {r.det_id: r.reason for r in motion.filter_ball_detections(df, 720).collect()}
    assert got == {2: "per_frame_confidence_cap", 3: "width_above_max", 4: "width_below_min", 5: "height_above_max", 6: "height_below_min", 7: "excluded_top_region", 8: "per_frame_confidence_cap", 9: None, 10: "area_below_min", 11: "area_above_max"}
    assert {r.det_id for r in motion.filter_ball_detections(df, 720, cap=0).where("kept").collect()} == {2, 8, 9}
    assert {r.reason for r in motion.filter_ball_detections(df, 720, cap=0, bottom=0.5).where("det_id = 9").collect()} == {"excluded_bottom_region"}


def test_interpolation_stays_in_a_track(spark):
    rows = [(1, 1, f, f / 25, 0.0, 0.0, c) for f, c in ((1, 0.9), (4, 0.3))] + [(1, 2, 2, 0.08, 500.0, 0.0, 0.9)]
    got = motion.interpolate(spark.createDataFrame(rows, "clip_id long, track_id long, frame long, timestamp double, center_x double, center_y double, confidence double")).where("is_interpolated = 1").orderBy("frame").collect()
    assert [(r.track_id, r.frame, r.center_x, r.confidence) for r in got] == [(1, 2, 0.0, 0.3), (1, 3, 0.0, 0.3)]


def test_shapes_keep_invalid_rows(spark):
    rows = [(1, f, f / 25, "Team A", 3, 10.0 * f, 0.0, float(w), 5.0, 2.0, f != 2) for f, w in enumerate((10, 12, 99, 14, 17))]
    got = shape.shape_temporal_features(spark.createDataFrame(rows, "clip_id long, frame long, timestamp double, team string, players long, centroid_x double, centroid_y double, width double, depth double, spread double, valid boolean"), 2)
    assert [(r.frame, r.valid_mask, r.width_delta, r.sequence_id, r.rolling_width_mean) for r in got.orderBy("frame").collect()] == [(0, 1, None, 1, 10.0), (1, 1, 2.0, 1, 11.0), (2, 0, None, 2, None), (3, 1, None, 3, 14.0), (4, 1, 3.0, 3, 15.5)]
    assert [r.shape_change for r in got.orderBy("frame").collect()] == [0, 0, 0, 0, 1]
    five = shape.shape_5s_summary(got.withColumn("valid_mask", (F.col("frame") == 1).cast("int"))).collect()[0]
    assert (five.rows, five.valid_rows, five.quality) == (5, 1, "low_coverage")
    assert shape.shape_5s_summary(got.withColumn("valid_mask", F.lit(0))).count() == 0


def test_teams_by_colour(spark):
    """Two colours are parted whatever the order; a referee far from both, a track of few samples and one without any stay apart."""
    names = [*teams.MEDIANS, "green_fraction"]
    base = dict.fromkeys(names, 1.0) | {"valid_fraction": 0.5, "green_fraction": 0.1}
    kinds = {0: (180.0, 160.0, 120.0), 1: (130.0, 70.0, 90.0), 2: (400.0, 400.0, 10.0)}
    rows = []
    for t, k in enumerate([0, 1, 0, 1, 0, 1, 2, 0]):
        for i in range(2 if t == 7 else 10):
            a, b, light = (x + (i * 7 + t * 3) % 5 for x in kinds[k])
            values = base | {"lab_a": a, "lab_b": b, "lab_l": light, "crop_area": 5000.0 if t == 6 else 900.0 + t}
            rows.append((1, t, *(values[n] for n in names)))
    samples = spark.createDataFrame(rows, "clip_id long, track_id long, " + ", ".join(f"{n} double" for n in names))
    tracks = spark.createDataFrame([(1, t) for t in range(9)], "clip_id long, track_id long")
    got = {r.track_id: (r.team, r.assignment_reason) for r in teams.classify_teams(samples, tracks).collect()}
    assert [got[t][0] for t in (0, 2, 4)] == ["Team A"] * 3 and [got[t][0] for t in (1, 3, 5)] == ["Team B"] * 3
    assert got[6] == ("Unknown", "far_from_team_centroid") and got[7] == ("Team A", "weak_track_near_centroid") and got[8] == ("Unknown", "no_valid_torso_samples")
    few = teams.classify_teams(samples.where("track_id = 0"), tracks.where("track_id = 0")).collect()[0]
    assert (few.team, few.assignment_reason, few.role) == ("Team A", "fallback_single_cluster", "team_a_player")


def test_clips_are_split_once_and_rare_classes_first(spark):
    rows = [(c, k) for c in range(20) for k in (["background"] + (["shot"] if c in (3, 8, 15) else []) + (["pass"] if c % 2 else []))]
    w = spark.createDataFrame(rows, "clip_id long, target_class string")
    got = {r.clip_id: r.split for r in windows.clip_disjoint_split(w).collect()}
    assert len(got) == 20 and {got[c] for c in (3, 8, 15)} == {"train", "val", "test"}
    assert sum(s == "test" for s in got.values()) == 4 and sum(s == "val" for s in got.values()) == 4
    assert windows.in_two_splits(windows.clip_disjoint_split(w)).count() == 0
    assert windows.clip_disjoint_split(w.limit(0)).count() == 0


def test_names_of_columns(spark):
    df = spark.createDataFrame([(1, 0.5, 7)], "Frame_ID long, TIME double, id long")
    assert tables.resolved(df, ["frame", "timestamp", "track_id"], ["confidence"]).collect()[0].asDict() == {"frame": 1, "timestamp": 0.5, "track_id": 7, "confidence": None}
    with pytest.raises(ValueError, match="team"):
        tables.resolved(df, ["team"])
    assert tables.declared(df, {"clip_id": "long", "time": "string"}).columns == ["clip_id", "time", "Frame_ID", "id"]
    text = spark.createDataFrame([("1", "x"), ("y", "z")], "a string, b string")
    assert tables.convert_if_any(text, ["a", "b"]).orderBy("b").collect() == [(1.0, "x"), (None, "z")]
    assert tables.with_height(spark.createDataFrame([(1.0, 5.0)], "y1 double, y2 double")).first().height == 4.0


DET = "clip_id long, frame long, det_id long, timestamp double, center_x double, center_y double, confidence double"


def test_ball_tracks(spark):
    rows = [(1, f, 0, f / 25, 10.0 * f, 0.0, 0.5) for f in (0, 1, 2, 5)] + [(1, 1, 1, 0.04, 900.0, 0.0, 0.9), (1, 30, 0, 1.2, 50.0, 0.0, 0.5), (1, 31, 0, 1.24, 55.0, 0.0, 0.5)]
    got = {(r.frame, r.track_id) for r in tracking.link_ball_tracks(spark.createDataFrame(rows, DET)).collect()}
    assert got == {(0, 1), (1, 1), (2, 1), (5, 1), (30, 3), (31, 3)}
    assert tracking.link_ball_tracks(spark.createDataFrame([], DET)).count() == 0


def test_players_keep_their_track(spark):
    """The smoothed box has whole corners (0.7 * 20 + 0.3 * 25 = 21.5, to even 22); a ball, and a box that is too small, have no track."""
    box = "clip_id long, frame long, det_id long, class_name string, x1 double, y1 double, x2 double, y2 double"
    rows = [(1, f, p, "person", 300.0 * p + 5 * f, 0.0, 300.0 * p + 5 * f + 20, 40.0) for f in range(5) for p in (0, 1)] + [(1, 2, 5, "ball", 0.0, 0.0, 50.0, 50.0), (1, 2, 6, "person", 0.0, 0.0, 9.0, 11.0)]
    got = tracking.centroid_track(spark.createDataFrame(rows, box)).collect()
    assert {(r.det_id, r.track_id) for r in got} == {(0, 1), (1, 2)}
    second = next(r for r in got if r.frame == 1 and r.det_id == 0)
    assert (second.x1, second.x2, second.center_x) == (2.0, 22.0, 12.0)


def test_gaps_of_a_ball_track(spark):
    """Gaps of 2 and of 8 missing frames are filled, one of 9 isn't."""
    rows = [(1, 1, f, f / 10, float(f), 2.0 * f, c) for f, c in ((0, 0.5), (3, 0.4), (12, 0.9), (22, 0.9))] + [(1, 2, 5, 0.5, 0.0, 0.0, 1.0)]
    got = tracking.with_gaps_filled(spark.createDataFrame(rows, tracking.LINKED.replace("track_id long, frame long", "track_id long, frame long")))
    filled = {r.frame: r for r in got.where("is_interpolated").collect()}
    assert sorted(filled) == [1, 2, *range(4, 12)]
    assert (filled[2].timestamp, filled[2].center_x, filled[2].center_y, filled[2].confidence) == pytest.approx((0.2, 2.0, 4.0, 0.4))
    assert tuple(tracking.ball_tracking_summary(got).first()) == (1, 2, 14, 7.5, 10, 2)


def test_times_of_absent_frames(spark):
    rows = [(1, f, 0, t) for f, t in ((2, 0.5), (4, 0.7), (5, 0.8), (9, 1.6))] + [(2, 3, 0, 9.0)]
    got = {(r.clip_id, r.frame): (r.timestamp, r.is_extrapolated) for r in tracking.frame_times(spark.createDataFrame(rows, "clip_id long, frame long, det_id long, timestamp double")).collect()}
    assert sorted(f for c, f in got if c == 1) == list(range(2, 10)) and got[1, 2] == (0.5, False) and got[2, 3] == (9.0, False)
    assert got[1, 3] == (pytest.approx(0.3), True) and got[1, 8] == (pytest.approx(0.8), True)


def test_boxes(spark):
    """Predictions in order take the best free box: the first takes the nearest, though the second would fit it better."""
    box = "clip_id long, frame long, class_name string, box_id long, x1 double, y1 double, x2 double, y2 double"
    one = lambda frame, c, i, x: (1, frame, c, i, x, 0.0, x + 10, 10.0)
    truth = spark.createDataFrame([one(0, "p", 0, 0.0), one(0, "p", 1, 4.0), one(1, "q", 0, 0.0)], box)
    found = spark.createDataFrame([one(0, "p", 0, 1.0), one(0, "p", 1, 0.0), one(9, "p", 0, 0.0)], box)
    got = {r.class_name: (r.tp, r.fp, r.fn) for r in tracking.detection_metrics(truth, found).collect()}
    assert got == {"p": (1, 1, 1), "q": (0, 0, 1)}
    tracks = spark.createDataFrame([(1, 0, 5, "Referee", 0.0, 0.0, 1.0, 1.0), (1, 0, 6, None, 0.0, 0.0, 1.0, 1.0)], "clip_id long, frame long, track_id long, class_name string, x1 double, y1 double, x2 double, y2 double")
    ball = spark.createDataFrame([(1, 0, 20.0, 30.0)], "clip_id long, frame long, center_x double, center_y double")
    assert {(r.class_name, r.box_id, r.x1, r.y2) for r in tracking.evaluated_boxes(tracks, ball).collect()} == {("Player", 6, 0.0, 1.0), ("Ball", 0, 12.5, 37.5)}


def test_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_csv(spark.createDataFrame([(1, 2, "x", 0.5), (1, None, None, None)], "clip_id long, frame long, confidence string, center_x double"), path)
    rows = [tuple(r) for r in files.read_csv(spark, path, files.SCHEMAS["ball"], ["frame"]).select("clip_id", "frame", "confidence", "center_x", "center_y").orderBy(F.col("frame").asc_nulls_last()).collect()]
    assert rows == [(1, 2, None, 0.5, None), (1, None, None, None, None)]
    with pytest.raises(ValueError, match="team"):
        files.read_csv(spark, path, files.SCHEMAS["player_teams"], ["team"])


def test_stream(spark, tmp_path):
    t = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    rows = [(1, 7, t(s), float(s), 0.0) for s in (0, 1, 4, 6, 60)]
    spark.createDataFrame(rows, "clip_id long, player_id long, ts timestamp, center_x double, center_y double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("clip_id long, player_id long, ts timestamp, center_x double, center_y double").parquet(str(tmp_path / "in"))
    for name, df in (("tumbling", streams.tumbling_summary(stream)), ("sessions", streams.owner_sessions(stream))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(90)
    assert sorted((r.rows, r.mean_x) for r in spark.table("tumbling").collect()) == [(1, 6.0), (3, 5 / 3)]
    assert sorted(r.rows for r in spark.table("sessions").collect()) == [2, 2]
