"""Features of passes from the frames around them, and whether a turnover went before. All joins are on equal keys: a pass lists its frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag
from .motion import nearest_within

KEY = ["clip_id", "pass_id"]
FEATURES = ["same_team", "sender_stable", "receiver_stable", "free_ball", "duration", "ball_distance", "speed_peak", "above_baseline", "missing", "interpolated", "flicker", "carry_overlap", "turnover_overlap"]


def _listed(df: DataFrame, before: int = 0, after: int = 0) -> DataFrame:
    return df.withColumn("frame", F.explode(F.sequence(F.col("start_frame") - before, F.col("end_frame") + after)))


def _steady(rows: str) -> Column:
    """How many rows from the first on have its owner; 0 if it has none."""
    owner = F.get(F.col(rows), 0)["owner"]
    other = F.array_position(F.transform(rows, lambda x: ~x["owner"].eqNullSafe(owner)), True)
    return F.when(owner.isNull(), 0).when(other > 0, other - 1).otherwise(F.size(rows)).cast("long")


def overlap_share(passes: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """(clip_id, pass_id, name): the share of a pass's frames in the one event that covers most of it; passes that none covers have no row."""
    spans = events.select("clip_id", "start_frame", "end_frame").distinct()
    held = _listed(spans).select("clip_id", "frame", F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"))
    n = _listed(passes.select(*KEY, "start_frame", "end_frame")).join(held, ["clip_id", "frame"]).groupBy(*KEY, "start_frame", "end_frame", "_s", "_e").agg(F.count("*").alias("n"))
    return n.groupBy(*KEY, "start_frame", "end_frame").agg(F.max("n").alias("n")).select(*KEY, (F.col("n") / F.greatest(F.lit(1), F.col("end_frame") - F.col("start_frame") + 1)).alias(name))


def pass_features(passes: DataFrame, states: DataFrame, carries: DataFrame, turnovers: DataFrame, reach: int = 10, free_distance: float = 35.0) -> DataFrame:
    """The passes with FEATURES and completeness, the share of features that are known.

    states has a row a frame: team, player_id, distance_to_ball, ball_x, ball_y,
    ball_speed, is_interpolated, possession_changed. The sender is the owner of the
    last frame before the pass (at most reach frames back), the receiver that of
    the first one after it.
    """
    owner = F.when(F.col("s.team").isin("Team A", "Team B") & (F.col("s.player_id") >= 0), F.struct(F.col("s.team").alias("team"), F.col("s.player_id").alias("player_id")))
    spans = _listed(passes.select(*KEY, "start_frame", "end_frame"), reach, reach)
    x = spans.alias("p").join(states.alias("s"), ["clip_id", "frame"]).select(*KEY, "frame", "start_frame", "end_frame", owner.alias("owner"), "distance_to_ball", "ball_x", "ball_y", "ball_speed", "is_interpolated", "possession_changed")
    before, after = F.col("frame") < F.col("start_frame"), F.col("frame") > F.col("end_frame")
    within = ~before & ~after
    seen = within & F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()
    at = lambda f: f(F.when(seen, F.struct("frame", "ball_x", "ball_y")))
    g = x.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(before, F.struct((-F.col("frame")).alias("k"), "owner")))).alias("_back"),
        F.array_sort(F.collect_list(F.when(after, F.struct(F.col("frame").alias("k"), "owner")))).alias("_ahead"),
        F.count_if(within).alias("_n"),
        F.count_if(within & (F.col("distance_to_ball") > free_distance)).alias("free_ball"),
        F.max(F.when(within, F.col("ball_speed"))).alias("speed_peak"),
        F.percentile(F.when(before, F.col("ball_speed")), 0.5).alias("_base"),
        F.count_if(within & F.col("ball_x").isNull()).alias("_missing"),
        F.count_if(within & F.col("is_interpolated")).alias("_made"),
        F.count_if(within & (F.col("possession_changed") == 1)).alias("_changes"),
        at(F.min).alias("_from"),
        at(F.max).alias("_to"),
    )
    team = lambda rows: F.get(F.col(rows), 0)["owner"]["team"]
    moved = F.hypot(F.col("_to.ball_x") - F.col("_from.ball_x"), F.col("_to.ball_y") - F.col("_from.ball_y"))
    g = g.select(
        *KEY,
        (team("_back") == team("_ahead")).cast("int").alias("same_team"),
        _steady("_back").alias("sender_stable"),
        _steady("_ahead").alias("receiver_stable"),
        "free_ball",
        F.when(F.col("_to.frame") > F.col("_from.frame"), moved).alias("ball_distance"),
        "speed_peak",
        (F.col("speed_peak") > F.col("_base")).cast("int").alias("above_baseline"),
        F.try_divide("_missing", "_n").alias("missing"),
        F.try_divide("_made", "_n").alias("interpolated"),
        (F.col("_changes") > 1).cast("int").alias("flicker"),
    )
    df = passes.drop("duration").withColumn("duration", F.col("end_frame") - F.col("start_frame") + 1).join(g, KEY, "left")
    for events, name in ((carries, "carry_overlap"), (turnovers, "turnover_overlap")):
        df = df.join(overlap_share(passes, events, name), KEY, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("sender_stable", "receiver_stable", "free_ball", "flicker")} | {c: F.coalesce(c, F.lit(0.0)) for c in ("carry_overlap", "turnover_overlap")}
    df = df.withColumns(zero)
    known = sum((F.col(c).isNotNull().cast("int") for c in FEATURES), F.lit(0))
    return df.withColumn("completeness", known / len(FEATURES))


def pass_context(features: DataFrame, turnovers: DataFrame, near: int = 5, tolerance: int = 3, stable: int = 4) -> DataFrame:
    """Adds post_turnover and recovery (0 or 1), turnover_distance (of the nearest turnover's end from the pass's start, null beyond near frames) and recovery_frames (from the last turnover's end, tolerance frames before the pass at the earliest, to the pass's end).

    turnovers: clip_id, turnover_id, end_frame, team.
    """
    t = turnovers.select("clip_id", "turnover_id", F.col("end_frame").alias("frame"), F.col("team").alias("_winner"))
    hit = nearest_within(features.select("clip_id", F.col("pass_id").alias("id"), F.col("start_frame").alias("frame")), t.select("clip_id", F.col("turnover_id").alias("id"), "frame"), near)
    hit = hit.select("clip_id", F.col("left_id").alias("pass_id"), F.col("delta").alias("turnover_distance"))
    last = _listed(features.select(*KEY, "start_frame", "end_frame"), tolerance).join(t, ["clip_id", "frame"]).groupBy(*KEY).agg(F.max(F.struct("frame", -F.col("turnover_id"), "_winner")).alias("_t"))
    df = features.join(hit, KEY, "left").join(last, KEY, "left").withColumn("recovery_frames", F.col("end_frame") - F.col("_t.frame"))
    good = (F.col("same_team") == 1) & (F.col("sender_stable") >= stable) & (F.col("carry_overlap") <= 0.20) & (F.col("missing") <= 0.25) & (F.col("interpolated") <= 0.25)
    post = good & F.col("turnover_distance").isNotNull() & (F.col("receiver_stable") >= stable)
    recovery = good & (F.col("recovery_frames") >= 2) & (F.col("_t._winner") == F.col("team")) & (F.col("receiver_stable") >= 2) & (F.col("free_ball") >= 2)
    return df.withColumn("post_turnover", flag(post).cast("int")).withColumn("recovery", flag(recovery).cast("int")).drop("_t")
