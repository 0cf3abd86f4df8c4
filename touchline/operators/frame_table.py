"""The wide table of one row a frame: ball, possession, nearest players, team shape, the possessor's neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import track
from .motion import with_ball_motion
from .possession import with_possession_changes

TEAMS = {"team_a": "Team A", "team_b": "Team B"}


def _apart(p: Column, x: Column, y: Column) -> Column:
    return F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))


def player_motion(players: DataFrame) -> DataFrame:
    """Adds vx and vy since the track's row before; frames stand in where time doesn't advance."""
    dt = F.col("timestamp") - F.lag("timestamp").over(track())
    step = F.col("frame") - F.lag("frame").over(track())
    per = lambda c: F.try_divide(F.col(c) - F.lag(c).over(track()), F.when(F.col("_dt") > 0, F.col("_dt")))
    return players.withColumn("_dt", F.when(dt > 0, dt).otherwise(step)).withColumns({"vx": per("center_x"), "vy": per("center_y")}).drop("_dt")


def players_of(tracks: DataFrame, teams: DataFrame) -> DataFrame:
    """One row a frame: its players as an array by track_id, their counts and the shape of each team."""
    team = F.when(F.col("_team").isin(*TEAMS.values()), F.col("_team")).otherwise("Unknown")
    t = player_motion(tracks).join(teams.select("clip_id", "track_id", F.col("team").alias("_team")), ["clip_id", "track_id"], "left").withColumn("team", team)
    t = t.select("clip_id", "frame", "timestamp", "track_id", "center_x", "center_y", "team", "vx", "vy").repartition("clip_id", "frame")  # rows are narrower than the aggregates' buffers
    player = F.struct("track_id", F.col("center_x").alias("x"), F.col("center_y").alias("y"), "team", "vx", "vy")
    aggs = [F.min("timestamp").alias("track_time"), F.array_sort(F.collect_list(player)).alias("players"), F.count("*").alias("player_count")]
    for k, name in TEAMS.items():
        there = F.when((F.col("team") == name) & F.col("center_x").isNotNull() & F.col("center_y").isNotNull(), F.struct("center_x", "center_y"))
        x, y = there["center_x"], there["center_y"]
        aggs += [F.count_if(F.col("team") == name).alias(f"{k}_player_count"), F.avg(x).alias(f"{k}_centroid_x"), F.avg(y).alias(f"{k}_centroid_y"), (F.max(x) - F.min(x)).alias(f"{k}_width"), (F.max(y) - F.min(y)).alias(f"{k}_depth")]
    return t.groupBy("clip_id", "frame").agg(*aggs, F.count_if(F.col("team") == "Unknown").alias("unknown_team_player_count"))


def temporal_frames(tracks: DataFrame, teams: DataFrame, ball: DataFrame, possession: DataFrame, k: int = 4, radius: float = 100.0) -> DataFrame:
    """Every frame that has a player, a ball or a possession row.

    The three inputs meet on (clip_id, frame), the players first by their times
    alone: windows over the clip's frames sort narrow rows. Then come the players,
    as an array of their frame; all else is expressions over that row. Absent: id -1, team 'Unknown', flag *_missing 1, measures null.
    """
    b = ball.select("clip_id", "frame", F.col("timestamp").alias("ball_time"), "center_x", "center_y", F.col("confidence").alias("ball_confidence"), F.col("is_interpolated").cast("int").alias("ball_is_interpolated"))
    p = possession.select("clip_id", "frame", F.col("timestamp").alias("possession_time"), "team", "player_id", "distance_to_ball", "possession_reason")
    there = tracks.where("clip_id is not null and frame is not null").groupBy("clip_id", "frame").agg(F.min("timestamp").alias("track_time"))
    df = b.join(p, ["clip_id", "frame"], "full").join(there, ["clip_id", "frame"], "full")
    seen = F.col("center_x").isNotNull() & F.col("center_y").isNotNull()
    time = ("possession_time", "ball_time", "track_time")
    df = df.withColumns({"timestamp": F.coalesce(*time, F.col("frame").cast("double")), "center_x": F.when(seen, F.col("center_x")), "center_y": F.when(seen, F.col("center_y"))}).drop(*time)
    moved = with_possession_changes(with_ball_motion(df))
    df = moved.join(players_of(tracks, teams), ["clip_id", "frame"], "full")
    df = df.withColumns({
        "timestamp": F.coalesce("timestamp", "track_time", F.col("frame").cast("double")),
        "players": F.coalesce("players", F.array().cast(df.schema["players"].dataType)),
        **{c: F.coalesce(c, F.lit(0)) for c in ("possession_changed", "frames_since_possession_change")},
    })
    players, ball_x, ball_y = F.col("players"), F.col("center_x"), F.col("center_y")
    placed = lambda q: q["x"].isNotNull() & q["y"].isNotNull()
    near = F.slice(F.array_sort(F.transform(F.filter(players, lambda q: placed(q) & ball_x.isNotNull()), lambda q: F.struct(_apart(q, ball_x, ball_y).alias("d"), q["track_id"].alias("track_id"), q.alias("player")))), 1, k)
    owner = F.try_element_at(F.filter(players, lambda q: q["track_id"] == F.col("player_id")), F.lit(1))
    has_owner = F.col("team").isin(*TEAMS.values()) & F.col("owner").isNotNull()
    df = df.withColumns({"near": near, "owner": owner})
    least = lambda mine: F.when(has_owner, F.array_min(F.transform(F.filter(players, lambda q: placed(q) & (q["track_id"] != F.col("player_id")) & mine(q)), lambda q: _apart(q, F.col("owner.x"), F.col("owner.y")))))
    other = lambda q: q["team"].isin(*TEAMS.values()) & (q["team"] != F.col("team"))
    mean = lambda name, k: F.aggregate(F.transform(F.filter(players, lambda q: placed(q) & (q["team"] == name)), lambda q: _apart(q, F.col(f"{k}_centroid_x"), F.col(f"{k}_centroid_y"))), F.lit(0.0), lambda a, d: a + d)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    cols = [
        "clip_id", "frame", "timestamp", ball_x.alias("ball_x"), ball_y.alias("ball_y"), "ball_confidence", zero("ball_is_interpolated"), ball_x.isNull().cast("int").alias("ball_missing"),
        F.col("vx").alias("ball_vx"), F.col("vy").alias("ball_vy"), F.hypot("vx", "vy").alias("ball_speed"), F.col("ax").alias("ball_ax"), F.col("ay").alias("ball_ay"), F.hypot("ax", "ay").alias("ball_acceleration"),
        (F.col("vx").isNotNull() & F.col("vy").isNotNull()).cast("int").alias("ball_velocity_valid"), (F.col("ax").isNotNull() & F.col("ay").isNotNull()).cast("int").alias("ball_acceleration_valid"),
        F.coalesce("player_id", F.lit(-1)).cast("long").alias("possessor_track_id"), F.coalesce("team", F.lit("Unknown")).alias("possession_team"), "distance_to_ball", F.coalesce("possession_reason", F.lit("Unknown")).alias("possession_reason"),
        F.coalesce(~F.col("team").isin(*TEAMS.values()), F.lit(True)).cast("int").alias("possession_missing"), "possession_changed", "frames_since_possession_change",
        *map(zero, ("player_count", "team_a_player_count", "team_b_player_count", "unknown_team_player_count")),
    ]
    for i in range(1, k + 1):
        n = F.try_element_at("near", F.lit(i))
        q = n["player"]
        moves = q["vx"].isNotNull() & q["vy"].isNotNull()
        cols += [F.coalesce(n["track_id"], F.lit(-1)).cast("long").alias(f"p{i}_track_id"), q["x"].alias(f"p{i}_x"), q["y"].alias(f"p{i}_y"), F.coalesce(q["team"], F.lit("Unknown")).alias(f"p{i}_team"), n["d"].alias(f"p{i}_distance_to_ball"), n.isNull().cast("int").alias(f"p{i}_missing"), q["vx"].alias(f"p{i}_vx"), q["vy"].alias(f"p{i}_vy"), F.hypot(q["vx"], q["vy"]).alias(f"p{i}_speed"), moves.cast("int").alias(f"p{i}_velocity_valid")]
    cols += [least(lambda q: q["team"] == F.col("team")).alias("nearest_teammate_distance"), least(other).alias("nearest_opponent_distance")]
    cols.append(F.when(has_owner & ball_x.isNotNull(), F.size(F.filter(players, lambda q: other(q) & (_apart(q, ball_x, ball_y) <= radius)))).alias("defenders_near_ball"))
    for k_, name in TEAMS.items():
        there = F.size(F.filter(players, lambda q: placed(q) & (q["team"] == name)))
        cols += [f"{k_}_centroid_x", f"{k_}_centroid_y", f"{k_}_width", f"{k_}_depth", F.when(there > 0, mean(name, k_) / there).alias(f"{k_}_spread"), (there > 0).cast("int").alias(f"{k_}_shape_valid")]
    return df.select(*cols)


def missing_values(df: DataFrame) -> DataFrame:
    """(column, missing): nulls of each column."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns))).alias("x")).select("x.*")
