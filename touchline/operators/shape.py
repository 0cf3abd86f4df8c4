"""Team shape and movement, by frame, by five seconds and as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, flag
from .frame_table import TEAMS
from .motion import trajectories

def team_shape(frames: DataFrame) -> DataFrame:
    """One row per frame and team from the frame table (temporal_frames): players, centroid, width, depth, spread (mean distance from the centroid), and whether there is a shape (one player is enough). Rows without frame or time are left out."""
    names = ("player_count", "centroid_x", "centroid_y", "width", "depth", "spread", "shape_valid")
    each = F.explode(F.array(*(F.struct(F.lit(team).alias("team"), *(F.col(f"{k}_{c}").alias(c) for c in names)) for k, team in TEAMS.items())))
    df = frames.where("frame is not null and timestamp is not null").select("clip_id", "frame", "timestamp", each.alias("x"))
    return df.select("clip_id", "frame", "timestamp", "x.team", F.col("x.player_count").alias("players"), *(f"x.{c}" for c in names[1:-1]), (F.coalesce("x.shape_valid", F.lit(0)) == 1).alias("valid"))


def shape_temporal_features(shape: DataFrame, rolling: int = 25) -> DataFrame:
    """Every shape with compactness, changes since the frame before, rolling means and deviations, and whether width, depth or spread change more than in nine of ten frames of the team.

    A change needs two valid shapes in neighbouring frames; what isn't one begins a
    new sequence, and no rolling measure reaches beyond it. Invalid shapes keep
    their row, their measures are null.
    """
    team = Window.partitionBy("clip_id", "team").orderBy("frame")
    valid = F.col("valid") & F.col("centroid_x").isNotNull() & F.col("centroid_y").isNotNull() & F.col("width").isNotNull() & F.col("depth").isNotNull() & F.col("spread").isNotNull()
    df = shape.withColumn("valid_mask", flag(valid)).withColumn("frame_gap_from_previous", F.col("frame") - F.lag("frame").over(team)).withColumn("_dt", F.col("timestamp") - F.lag("timestamp").over(team))
    df = df.withColumn("_ok", flag(F.col("valid_mask") & F.lag("valid_mask").over(team) & (F.col("frame_gap_from_previous") == 1) & (F.col("_dt") > 0)))
    step = lambda c: F.when(F.col("_ok"), F.round(F.col(c) - F.lag(c).over(team), 9))
    df = df.withColumns({"centroid_dx": step("centroid_x"), "centroid_dy": step("centroid_y"), "width_delta": step("width"), "depth_delta": step("depth"), "spread_delta": step("spread"), "sequence_id": F.sum((~F.col("_ok")).cast("long")).over(team.rowsBetween(Window.unboundedPreceding, 0))})
    df = df.withColumn("centroid_speed", F.sqrt(F.col("centroid_dx") * F.col("centroid_dx") + F.col("centroid_dy") * F.col("centroid_dy")) / F.col("_dt"))
    seq = Window.partitionBy("clip_id", "team", "sequence_id").orderBy("frame").rowsBetween(1 - rolling, 0)
    mine = lambda c: F.when(F.col("valid_mask"), F.col(c))
    df = df.withColumn("rolling_centroid_speed_mean", F.when(F.col("_ok"), F.avg("centroid_speed").over(seq)))
    df = df.withColumns({f"rolling_{c}_{k}": F.when(F.col("valid_mask"), f(mine(c)).over(seq)) for c in ("width", "depth", "spread") for k, f in (("mean", F.avg), ("std", F.stddev_pop))})
    df = df.withColumn("compactness", F.when(F.col("valid_mask") & (F.col("spread") > 1e-6), 1 / F.col("spread")))
    changes = ("width_delta", "depth_delta", "spread_delta")
    limit = df.groupBy("clip_id", "team").agg(*(F.round(F.percentile(F.abs(c), 0.9), 9).alias(f"_{c}") for c in changes))
    over = flag(F.abs(changes[0]) > F.col(f"_{changes[0]}"))
    for c in changes[1:]:
        over = over | flag(F.abs(c) > F.col(f"_{c}"))
    return df.join(limit, ["clip_id", "team"]).withColumn("shape_change", (F.col("valid_mask") & over).cast("int")).withColumn("valid_mask", F.col("valid_mask").cast("int")).drop("_dt", "_ok", "valid", *(f"_{c}" for c in changes))


def _shape_means(*, medians: bool) -> list:
    v = lambda c: F.when(F.col("valid_mask") == 1, F.col(c))
    out = [F.count("*").alias("rows"), F.sum("valid_mask").alias("valid_rows"), *(F.avg(v(c)).alias(f"mean_{c}") for c in ("centroid_x", "centroid_y", "width", "depth", "spread", "compactness", "centroid_speed"))]
    out += [F.stddev_pop(v(c)).alias(f"std_{c}") for c in ("width", "depth", "spread")]
    if medians:
        out += [F.percentile(v(c), 0.5).alias(f"median_{c}") for c in ("width", "depth", "spread")]
    return [*out, F.sum("shape_change").alias("shape_changes")]


def _quality(df: DataFrame) -> DataFrame:
    df = df.withColumn("valid_share", F.col("valid_rows") / F.col("rows"))
    return df.withColumn("quality", F.when(F.col("valid_share") >= 0.70, "ok").when(F.col("valid_share") >= 0.40, "partial").otherwise("low_coverage"))


def shape_5s_summary(features: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Means of the valid shapes (of shape_temporal_features) of each five seconds from the clip's first time on; windows without one are left out. ok from 70 % valid frames on, partial from 40 %."""
    k = F.floor((F.col("timestamp") - F.min("timestamp").over(clip())) / seconds).cast("long")
    span = [F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp")]
    return _quality(features.withColumn("window", k).groupBy("clip_id", "team", "window").agg(*span, *_shape_means(medians=False)).where("valid_rows > 0"))


def team_shape_summary(features: DataFrame) -> DataFrame:
    """The same over a whole clip, with medians."""
    return _quality(features.groupBy("clip_id", "team").agg(*_shape_means(medians=True)))


def movement_summary(tracks: DataFrame, teams: DataFrame, low: float = 0.30) -> DataFrame:
    """Each track's extent, motion and confidence, how fragmented it is, and whether it can be relied on. low: below this a detection counts as of low confidence."""
    t = tracks.join(trajectories(tracks).withColumnRenamed("gap", "_gap"), ["clip_id", "track_id", "frame"])
    span = lambda c: [F.avg(c).alias(f"mean_{c}"), F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    g = t.groupBy("clip_id", "track_id").agg(
        F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
        F.count("*").alias("points"), (F.max("timestamp") - F.min("timestamp")).alias("seconds"), F.count("speed").alias("pairs"), F.count_if(F.col("_gap") > 1).alias("gap_breaks"), F.coalesce(F.max("_gap"), F.lit(0)).cast("long").alias("max_frame_gap"), F.max("segment_id").alias("segments"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("distance"), F.avg("speed").alias("mean_speed"), F.percentile("speed", 0.5).alias("median_speed"), F.max("speed").alias("max_speed"), F.avg(F.abs("acceleration")).alias("mean_acceleration"), F.max(F.abs("acceleration")).alias("max_acceleration"),
        *span("center_x"), *span("center_y"), F.avg("confidence").alias("mean_confidence"), (F.count_if(F.col("confidence") < low) / F.count("*")).alias("low_confidence_share"),
    )
    g = g.withColumn("risk", F.when((F.col("max_frame_gap") > 10) | (F.col("segments") >= 4), "high").when((F.col("max_frame_gap") > 3) | (F.col("segments") >= 2), "medium").otherwise("low"))
    named = g.join(teams.select("clip_id", "track_id", "team", "role"), ["clip_id", "track_id"], "left").withColumns({"team": F.coalesce("team", F.lit("Unknown")), "role": F.coalesce("role", F.lit("unknown"))})
    return named.withColumn("quality", F.when((F.col("pairs") >= 2) & (F.col("risk") != "high"), "ok").otherwise("sparse_track"))


def movement_temporal_features(tracks: DataFrame, teams: DataFrame, frames: DataFrame) -> DataFrame:
    """One row per frame of frames (clip_id, frame, timestamp): how many players move validly (a step from the frame before), their mean and largest speed and acceleration (without sign), how many are as fast as the fastest tenth of the clip's steps, both teams' players and mean speeds, and how many tracks come back after a gap. Frames without such players: measures null, counts 0."""
    t = trajectories(tracks).join(teams.select("clip_id", "track_id", "team"), ["clip_id", "track_id"], "left").where("frame is not null")
    moves = t.where("speed is not null")
    limit = moves.groupBy("clip_id").agg(F.percentile("speed", 0.9).alias("_limit"))
    of = lambda team: F.when(F.col("team") == team, F.col("speed"))
    a = F.abs("acceleration")
    g = moves.join(limit, "clip_id").groupBy("clip_id", "frame").agg(
        F.count("*").alias("valid_players"), F.avg("speed").alias("mean_speed"), F.max("speed").alias("max_speed"), F.avg(a).alias("mean_acceleration"), F.max(a).alias("max_acceleration"), F.count_if(F.col("speed") >= F.col("_limit")).alias("fast_players"),
        *(x for k, team in TEAMS.items() for x in (F.avg(of(team)).alias(f"{k}_mean_speed"), F.count(of(team)).alias(f"{k}_valid_players"))),
    )
    gaps = t.where("gap > 1").groupBy("clip_id", "frame").agg(F.count("*").alias("players_after_gap"))
    df = frames.where("frame is not null").select("clip_id", "frame", "timestamp").join(g, ["clip_id", "frame"], "left").join(gaps, ["clip_id", "frame"], "left")
    df = df.na.fill(0, ["valid_players", "fast_players", "players_after_gap", *(f"{k}_valid_players" for k in TEAMS)])
    return df.withColumn("movement_valid", (F.col("valid_players") > 0).cast("int"))
