"""Rules by hand: strangers between interceptions, shapes from the frame table, movement of a frame, times of events, pictures' tables."""

import pytest
from pyspark.sql import functions as F

from touchline.operators import candidates, frame_table, pictures, segments, shape

OWNERS = "clip_id long, frame long, timestamp double, team string, player_id long, ball_x double, ball_y double, distance_to_ball double"


def owners(spark, runs):
    """runs: (team, player, frames)."""
    rows, f = [], 0
    for team, player, n in runs:
        for _ in range(n):
            rows.append((1, f, f / 25, team, player, 1.0 * f, 0.0, 5.0))
            f += 1
    return spark.createDataFrame(rows, OWNERS)


def test_a_stranger_between_two_teams(spark):
    found = lambda *runs: [(r.frame, r.winner_player_id, r.previous_player_id) for r in segments.detect_interceptions(owners(spark, runs)).orderBy("frame").collect()]
    assert found(("Team A", 1, 6), ("Unknown", 9, 4), ("Team B", 6, 6)) == []
    assert found(("Team A", 1, 6), ("None", None, 4), ("Team B", 6, 6)) == [(10, 6, 1)]
    assert found(("Team A", 1, 6), ("Team B", 6, 6), ("Unknown", 9, 2), ("Team A", 1, 6)) == [(6, 6, 1)]
    assert found(("Team A", 1, 2), ("Team B", 6, 6)) == []


def frames_of(spark, players):
    """players: (frame, track, team, x, y)."""
    tracks = spark.createDataFrame([(1, f, f / 25, t, x, y, 40.0, 1.0) for f, t, _, x, y in players], "clip_id long, frame long, timestamp double, track_id long, center_x double, center_y double, height double, confidence double")
    teams = spark.createDataFrame(sorted({(1, t, k, "x") for _, t, k, _, _ in players}), "clip_id long, track_id long, team string, role string")
    ball = spark.createDataFrame([], "clip_id long, frame long, timestamp double, center_x double, center_y double, confidence double, is_interpolated boolean")
    poss = spark.createDataFrame([], "clip_id long, frame long, timestamp double, team string, player_id long, distance_to_ball double, possession_reason string")
    return tracks, teams, frame_table.temporal_frames(tracks, teams, ball, poss)


def test_shapes_of_one_and_of_two_players(spark):
    _, _, frames = frames_of(spark, [(0, 1, "Team A", 0.0, 0.0), (0, 2, "Team A", 6.0, 8.0), (0, 3, "Team B", 1.0, 1.0), (0, 4, "Unknown", 9.0, 9.0)])
    got = {r.team: r for r in shape.team_shape(frames).collect()}
    a, b = got["Team A"], got["Team B"]
    assert (a.players, a.centroid_x, a.centroid_y, a.width, a.depth, a.spread, a.valid) == (2, 3.0, 4.0, 6.0, 8.0, 5.0, True)
    assert (b.players, b.width, b.spread, b.valid) == (1, 0.0, 0.0, True)
    _, _, frames = frames_of(spark, [(0, 1, "Team A", 0.0, 0.0)])
    b = next(r for r in shape.team_shape(frames).collect() if r.team == "Team B")
    assert (b.players, b.centroid_x, b.valid) == (0, None, False)


def test_movement_of_a_frame(spark):
    """Track 1 moves 1 and then 3 pixels a frame, track 2 stands, track 3 comes back after a gap."""
    players = [(0, 1, "Team A", 0.0, 0.0), (1, 1, "Team A", 1.0, 0.0), (2, 1, "Team A", 4.0, 0.0), (0, 2, "Team B", 5.0, 5.0), (1, 2, "Team B", 5.0, 5.0), (2, 2, "Team B", 5.0, 5.0), (0, 3, "Unknown", 0.0, 0.0), (2, 3, "Unknown", 9.0, 9.0)]
    tracks, teams, _ = frames_of(spark, players)
    frames = spark.createDataFrame([(1, f, f / 25) for f in range(4)], "clip_id long, frame long, timestamp double")
    got = {r.frame: r for r in shape.movement_temporal_features(tracks, teams, frames).collect()}
    two = got[2]
    assert (two.valid_players, two.mean_speed, two.max_speed, two.fast_players, two.players_after_gap, two.movement_valid) == (2, pytest.approx(37.5), pytest.approx(75.0), 1, 1, 1)
    assert (two.team_a_mean_speed, two.team_a_valid_players, two.team_b_mean_speed, two.team_b_valid_players) == (pytest.approx(75.0), 1, 0.0, 1)
    assert two.max_acceleration == pytest.approx(50 * 25) and two.mean_acceleration == pytest.approx(25 * 25)
    assert (got[0].valid_players, got[0].mean_speed, got[0].movement_valid) == (0, None, 0) and got[3].players_after_gap == 0


def test_times_of_the_nearest_frame(spark):
    frames = spark.createDataFrame([(1, 0, 0.0), (1, 4, 0.4), (1, 6, None), (2, 5, 9.0)], "clip_id long, frame long, timestamp double")
    events = spark.createDataFrame([(1, 2, "tie"), (1, 3, "later"), (1, 99, "end"), (1, None, "none"), (3, 1, "no clip")], "clip_id long, at long, name string")
    got = {r["name"]: r.time for r in candidates.with_time(events, frames, "at", "time").collect()}
    assert got == {"tie": 0.0, "later": 0.4, "end": None, "none": None, "no clip": None}


def test_points_and_counted_passes(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (1, 1.5, 0.4), (1, 2.4, 0.0), (1, -0.6, 0.0), (1, 9.5, 0.0), (1, None, 0.0)], "clip_id long, center_x double, center_y double")
    assert {(r.px, r.py): r.points for r in pictures.density(points, 10, 5).collect()} == {(0, 0): 1, (2, 0): 2}
    # the ball goes from 1 to 2 (same team), is lost to 6, then to 9 (unknown), then to 6
    who = [1, 2, None, 6, 9, 6]
    ball = spark.createDataFrame([(1, f, 100.0 * (p or 50), 0.0) for f, p in enumerate(who)] + [(2, 0, 0.0, 0.0)], "clip_id long, frame long, center_x double, center_y double")
    players = spark.createDataFrame([(1, f, p, 100.0 * p, 10.0, None) for f in range(6) for p in (1, 2, 6, 9)], "clip_id long, frame long, track_id long, center_x double, center_y double, height double")
    teams = spark.createDataFrame([(1, 1, "Team A"), (1, 2, "Team A"), (1, 6, "Team B"), (1, 9, "Unknown")], "clip_id long, track_id long, team string")
    assert {tuple(r) for r in pictures.counted_passes(ball, players, teams).collect()} == {(1, 1, 1), (2, 0, 0)}


def test_summary_of_events(spark):
    e = spark.createDataFrame([(1, 5, 7, "Team A"), (1, 1, 8, "Team A"), (1, 9, 9, "Team B")], "clip_id long, frame long, player_id long, team string")
    got = {(r.section, r.metric): r.value for r in pictures.event_summary(e, "total", "frame", 2, metrics={"last": ("metrics", F.max("frame"))}).collect()}
    assert got == {("counts", "total"): 3.0, ("metrics", "last"): 9.0, ("teams", "Team A"): 2.0, ("teams", "Team B"): 1.0, ("players", "8"): 1.0, ("players", "7"): 1.0}
