"""Runs of frames, and what follows from neighbouring runs. All operators deal by clip."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, distance, reasons, share

TEAMS = ("Team A", "Team B")


def islands(df: DataFrame, owner: list[str], max_gap: int | None = 1) -> DataFrame:
    """Adds seg: rows of the same owner form a run until the owner changes or, with max_gap, frames lie further apart."""
    w = clip().orderBy("frame")
    new = F.lit(False)
    for c in owner:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    if max_gap is not None:
        new = new | F.coalesce(F.col("frame") - F.lag("frame").over(w) > max_gap, F.lit(False))
    return df.withColumn("_new", (new | (F.row_number().over(w) == 1)).cast("int")).withColumn("seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def owned(possession: DataFrame) -> DataFrame:
    return possession.where(F.col("team").isin(*TEAMS) & F.col("player_id").isNotNull())


def runs(possession: DataFrame, max_gap: int | None, unknown: bool = False) -> DataFrame:
    """One row per run of an owner (team, player): bounds, frames, position of the ball at its first row. unknown: runs of a player of no known team are runs too."""
    df = islands(possession, ["team", "player_id"], max_gap)
    held = df.where(F.col("player_id").isNotNull() & F.col("team").isNotNull() & (F.col("team") != "None")) if unknown else owned(df)
    return held.groupBy("clip_id", "seg").agg(
        F.first("team").alias("team"), F.first("player_id").alias("player_id"),
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"),
        F.count("*").alias("frames"),
        F.min_by(F.struct("ball_x", "ball_y", "distance_to_ball"), "frame").alias("at"),
    )


def detect_interceptions(possession: DataFrame, min_previous: int = 3, min_new: int = 2) -> DataFrame:
    """The ball changes teams between neighbouring runs that are long enough. A run of a player of no known team stands between its neighbours: they don't follow each other."""
    w = clip().orderBy("start_frame")
    df = runs(possession, 1, unknown=True)
    for c in ("team", "player_id", "frames"):
        df = df.withColumn(f"previous_{c}", F.lag(c).over(w))
    df = df.where(F.col("team").isin(*TEAMS) & F.col("previous_team").isin(*TEAMS) & (F.col("previous_team") != F.col("team")) & (F.col("previous_frames") >= min_previous) & (F.col("frames") >= min_new))
    return df.select(
        "clip_id", F.row_number().over(w).cast("long").alias("interception_id"), F.col("start_frame").alias("frame"), F.col("start_time").alias("timestamp"),
        F.col("player_id").alias("winner_player_id"), F.col("team").alias("winner_team"), "previous_player_id", "previous_team",
        "at.ball_x", "at.ball_y", "at.distance_to_ball",
        reasons((F.col("previous_frames") < 5, "short_previous_segment"), (F.col("frames") < 3, "short_new_segment")).alias("quality_flag"),
    )


def interception_player_summary(interceptions: DataFrame) -> DataFrame:
    return interceptions.groupBy(F.col("winner_player_id").alias("player_id"), F.col("winner_team").alias("team")).agg(F.count("*").alias("interceptions"), F.avg("ball_x").alias("mean_ball_x"), F.avg("ball_y").alias("mean_ball_y"))


def estimate_carries(possession: DataFrame, players: DataFrame, min_frames: int = 5, min_duration: float = 0.20, min_ball: float = 20, min_player: float = 10, multiplier: float = 0.8, max_interpolated: float = 0.5, max_gap: int = 1) -> DataFrame:
    """Runs in which ball and player both move while they stay close. players: frame, track_id, center_x, center_y, height."""
    p = players.select("clip_id", "frame", F.col("track_id").alias("player_id"), F.col("center_x").alias("player_x"), F.col("center_y").alias("player_y"), "height")
    held = owned(islands(possession, ["team", "player_id"], max_gap)).hint("shuffle_hash")  # a row a frame: the players, many more, need no sort
    df = held.join(p, ["clip_id", "frame", "player_id"], "left")
    ball = F.when(F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull(), F.struct("ball_x", "ball_y"))
    player = F.when(F.col("player_x").isNotNull() & F.col("player_y").isNotNull(), F.struct("player_x", "player_y"))
    g = df.withColumn("b", ball).withColumn("p", player).groupBy("clip_id", "seg").agg(
        F.first("team").alias("team"), F.first("player_id").alias("player_id"),
        F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), (F.max("timestamp") - F.min("timestamp")).alias("duration_seconds"), F.count("*").alias("frames"),
        F.min_by("b", F.when(F.col("b").isNotNull(), F.col("frame"))).alias("b0"), F.max_by("b", F.when(F.col("b").isNotNull(), F.col("frame"))).alias("b1"),
        F.min_by("p", F.when(F.col("p").isNotNull(), F.col("frame"))).alias("p0"), F.max_by("p", F.when(F.col("p").isNotNull(), F.col("frame"))).alias("p1"),
        F.avg("distance_to_ball").alias("mean_distance_to_ball"), F.max("distance_to_ball").alias("max_distance_to_ball"),
        F.coalesce(F.avg("height"), F.lit(0.0)).alias("mean_player_box_height"), F.avg(F.col("is_interpolated").cast("double")).alias("interpolated_share"),
    )
    g = g.withColumn("ball_distance_px", F.coalesce(distance("b0.ball_x", "b0.ball_y", "b1.ball_x", "b1.ball_y"), F.lit(0.0))).withColumn("player_distance_px", F.coalesce(distance("p0.player_x", "p0.player_y", "p1.player_x", "p1.player_y"), F.lit(0.0)))
    g = g.withColumn("carry_distance_threshold", F.col("mean_player_box_height") * multiplier)
    ok = g.where((F.col("frames") >= min_frames) & (F.col("duration_seconds") >= min_duration - 1e-9) & (F.col("ball_distance_px") >= min_ball) & (F.col("player_distance_px") >= min_player) & (F.col("carry_distance_threshold") > 0) & (F.coalesce("mean_distance_to_ball", F.lit(0.0)) <= F.col("carry_distance_threshold")) & (F.col("interpolated_share") <= max_interpolated))
    return ok.select("clip_id", F.row_number().over(clip().orderBy("start_frame")).cast("long").alias("carry_id"), "player_id", "team", "start_frame", "end_frame", F.col("b0.ball_x").alias("start_ball_x"), F.col("b0.ball_y").alias("start_ball_y"), F.col("b1.ball_x").alias("end_ball_x"), F.col("b1.ball_y").alias("end_ball_y"), "frames", "duration_seconds", "ball_distance_px", "player_distance_px", "mean_distance_to_ball", "max_distance_to_ball", "mean_player_box_height", "carry_distance_threshold", "interpolated_share", reasons((F.col("interpolated_share") > 0, "contains_interpolation")).alias("carry_quality_flag"))


def carry_player_summary(carries: DataFrame) -> DataFrame:
    return carries.groupBy("player_id", "team").agg(F.count("*").alias("carries"), F.sum("duration_seconds").alias("total_duration"), F.avg("ball_distance_px").alias("mean_ball_distance"), F.max("ball_distance_px").alias("max_ball_distance"))


def frame_possession(possession: DataFrame) -> DataFrame:
    """One row a frame: of its rows with a team and a player the one nearest to the ball (unknown distances last, then the earliest time); without any, team None at its earliest time."""
    active = F.col("team").isin(*TEAMS) & F.col("player_id").isNotNull()
    first = F.struct((~active).cast("int").alias("none"), F.when(active, F.col("distance_to_ball").isNull().cast("int")).alias("unknown"), F.when(active, F.col("distance_to_ball")).alias("distance"), "timestamp", F.when(active, F.col("team")).otherwise("None").alias("team"), F.when(active, F.col("player_id")).alias("player_id"))
    return possession.groupBy("clip_id", "frame").agg(F.min(first).alias("x")).select("clip_id", "frame", "x.timestamp", "x.team", "x.player_id")


def stable_segments(possession: DataFrame, min_frames: int = 6, min_duration: float = 0.20) -> DataFrame:
    """Runs that frame gaps don't end, of a least length and duration."""
    return runs(possession, None).where((F.col("frames") >= min_frames) & (F.col("end_time") - F.col("start_time") >= min_duration - 1e-9)).drop("at")


def transitions(segments: DataFrame, max_gap_seconds: float | None = 2.0) -> DataFrame:
    """Neighbouring runs of different players that follow within max_gap_seconds; None: all neighbouring runs."""
    w = clip().orderBy("start_frame")
    df = segments
    for c in ("team", "player_id", "frames", "end_frame", "end_time"):
        df = df.withColumn(f"from_{c}", F.lag(c).over(w))
    gap = F.col("start_time") - F.col("from_end_time")
    near = F.col("from_player_id").isNotNull() if max_gap_seconds is None else (F.col("from_player_id") != F.col("player_id")) & (gap <= max_gap_seconds + 1e-9)
    return df.where(near).withColumn("gap_seconds", gap)


def passing_summary(segments: DataFrame) -> DataFrame:
    """Attempts, successes (same team) and accuracy by the passer's team."""
    ok = F.col("from_team") == F.col("team")
    return transitions(segments).groupBy(F.col("from_team").alias("team")).agg(F.count("*").alias("attempts"), F.count_if(ok).alias("successes")).withColumn("accuracy", 100 * share(F.col("successes"), F.col("attempts")))


def weak_passes(segments: DataFrame) -> DataFrame:
    df = transitions(segments).where(F.col("from_team") == F.col("team"))
    return df.select("clip_id", F.row_number().over(clip().orderBy("start_frame")).cast("long").alias("pass_id"), F.col("from_end_frame").alias("start_frame"), F.col("start_frame").alias("end_frame"), F.col("from_player_id").alias("from_player"), F.col("player_id").alias("to_player"), "team", F.lit(0.5).alias("confidence"))


def passing_network(passes: DataFrame) -> DataFrame:
    return passes.groupBy("team", "from_player", "to_player").agg(F.count("*").alias("passes"))


def overlap_groups(events: DataFrame) -> DataFrame:
    """Numbers the groups of events that overlap, directly or through others; an event alone has none. Running maxima, no join."""
    w = clip().orderBy("start_frame", "end_frame", "event_id")
    before = F.max("end_frame").over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = events.withColumn("_isle", F.sum(F.when(F.col("start_frame") <= before, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_many", (F.count("*").over(Window.partitionBy("clip_id", "_isle")) > 1).cast("int"))
    rank = F.sum(F.when(F.col("_first") & (F.col("_many") == 1), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_first", F.row_number().over(Window.partitionBy("clip_id", "_isle").orderBy("start_frame", "end_frame", "event_id")) == 1)
    return df.withColumn("overlap_group", F.when(F.col("_many") == 1, F.concat(F.lit("overlap_"), rank.cast("string")))).drop("_isle", "_many", "_first")


def merge_peaks(frames: DataFrame, gap: int = 12) -> DataFrame:
    """Intervals of frames that lie at most gap apart."""
    w = clip().orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) > gap).cast("int"), F.lit(1))
    return frames.select("clip_id", "frame").distinct().withColumn("seg", new).withColumn("seg", F.sum("seg").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("clip_id", "seg").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("peaks")).drop("seg")
