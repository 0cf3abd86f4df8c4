"""The table of frames and the labels on small cases: absent rows, nulls, empty tables."""

from touchline.operators import frame_table, labels

TRACKS = "clip_id long, frame long, timestamp double, track_id long, center_x double, center_y double, height double, confidence double"
TEAMS = "clip_id long, track_id long, team string, role string"
BALL = "clip_id long, frame long, timestamp double, center_x double, center_y double, confidence double, is_interpolated boolean"
POSSESSION = "clip_id long, frame long, timestamp double, team string, player_id long, distance_to_ball double, possession_reason string"


def test_frames(spark):
    tracks = [(1, 0, 0.0, 1, 0.0, 0.0, 40.0, 1.0), (1, 0, 0.0, 2, 30.0, 40.0, 40.0, 1.0), (1, 0, 0.0, 3, None, None, 40.0, 1.0), (1, 1, 0.04, 1, 2.0, 0.0, 40.0, 1.0)]
    teams = [(1, 1, "Team A", "x"), (1, 2, "Team B", "x")]
    ball = [(1, 0, 0.0, 0.0, 10.0, 0.5, False), (1, 5, 0.2, 1.0, 1.0, 0.5, True)]
    possession = [(1, 0, 0.0, "Team A", 1, 10.0, "r"), (1, 7, None, "Team B", 2, 1.0, "r")]
    df = frame_table.temporal_frames(spark.createDataFrame(tracks, TRACKS), spark.createDataFrame(teams, TEAMS), spark.createDataFrame(ball, BALL), spark.createDataFrame(possession, POSSESSION))
    a, b, c, d = df.orderBy("frame").collect()
    assert [r.frame for r in (a, b, c, d)] == [0, 1, 5, 7]
    assert (a.p1_track_id, a.p1_distance_to_ball, a.p2_track_id, a.p3_track_id, a.p3_missing) == (1, 10.0, 2, -1, 1)
    assert (a.player_count, a.team_a_player_count, a.unknown_team_player_count) == (3, 1, 1)
    assert (a.nearest_opponent_distance, a.nearest_teammate_distance, a.defenders_near_ball, a.team_b_spread) == (50.0, None, 1, 0.0)
    assert (b.ball_missing, b.possession_team, b.possessor_track_id, b.frames_since_possession_change, b.p1_missing) == (1, "Unknown", -1, 1, 1)
    assert (c.ball_is_interpolated, c.ball_velocity_valid, c.player_count, c.team_a_shape_valid) == (1, 0, 0, 0)
    assert (d.timestamp, d.possession_changed, d.frames_since_possession_change, d.nearest_opponent_distance) == (7.0, 1, 0, None)
    empty = [spark.createDataFrame([], s) for s in (TRACKS, TEAMS, BALL, POSSESSION)]
    assert frame_table.temporal_frames(*empty).count() == 0


def test_labels(spark):
    frames = spark.createDataFrame([(1, f, f / 25) for f in range(6)] + [(1, None, 0.0)], "clip_id long, frame long, timestamp double")
    schema = "clip_id long, carry_id long, start_frame long, end_frame long, carry_quality_flag string"
    carries = spark.createDataFrame([(1, 2, 1, 3, "ok"), (1, 1, 3, 4, "ok"), (1, 3, 0, 1, "short"), (1, 4, 9, 12, "ok"), (1, 5, 0, 1, None)], schema)
    out = labels.carry_labels(frames, carries)
    assert [(r.frame, r.event_id, r.covering) for r in out.orderBy("frame").collect()] == [(0, None, 0), (1, 2, 1), (2, 2, 1), (3, 1, 2), (4, 1, 1), (5, None, 0)]
    assert [tuple(r) for r in labels.carry_label_summary(out, carries).collect()] == [(1, 6, 4, 1, 3, 2, 1)]
    assert labels.carry_labels(frames.limit(0), carries.limit(0)).count() == 0


def test_annotations(spark):
    box = "clip_id long, track_no long, label string, frame long, outside boolean"
    rows = [(1, 0, "pass", f, False) for f in (0, 1, 2, 5, 6)] + [(1, 0, "pass", 3, True), (1, 1, "pass", 5, None), (1, 1, "pass", 6, False), (1, 2, "shot", 2, False), (1, 3, "other", 0, False), (1, 4, None, None, None), (1, 5, "carry", -1, False)]
    got = labels.annotated_intervals(spark.createDataFrame(rows, box)).orderBy("event_id").collect()
    assert [(r.event_id, r.event_type, r.start_frame, r.end_frame, r.duplicates, r.overlaps) for r in got] == [("1__event_0001", "pass", 0, 2, 0, 0), ("1__event_0002", "pass", 5, 6, 1, 0), ("1__event_0003", "shot", 2, 2, 0, 1)]
    assert labels.annotated_intervals(spark.createDataFrame([], box)).count() == 0
