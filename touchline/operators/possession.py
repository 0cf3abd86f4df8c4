"""Who has the ball: the nearest eligible player, smoothed over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip

#: Fixed reason texts.
SKIPPED, UNSURE, NOBODY, FAR, NEAR = "interpolated_ball_skipped", "ball_confidence_below_threshold", "no_eligible_player_in_frame", "nearest_player_too_far", "nearest_eligible_player_within_threshold"


def eligible(tracks: DataFrame, teams: DataFrame, min_confidence: float = 0.10) -> DataFrame:
    """Players of a team: confident enough, no referee."""
    return tracks.join(teams, ["clip_id", "track_id"]).where((F.col("confidence") >= min_confidence) & F.col("role").isin("team_a_player", "team_b_player"))


def nearest_player(ball: DataFrame, players: DataFrame) -> DataFrame:
    """Each ball row with the nearest player of its frame, the lower track_id at equal distance; null without players. A frame's players are gathered before the join, so it is a join of frames and not of players."""
    p = players.groupBy("clip_id", "frame").agg(F.collect_list(F.struct("center_x", "center_y", "track_id", "team", "height")).alias("_players"))
    b = ball.select("clip_id", "frame", "timestamp", F.col("center_x").alias("ball_x"), F.col("center_y").alias("ball_y"), F.col("confidence").alias("ball_confidence"), "is_interpolated")
    dx, dy = (lambda q: q["center_x"] - F.col("ball_x")), (lambda q: q["center_y"] - F.col("ball_y"))
    each = F.transform("_players", lambda q: F.struct(F.sqrt(dx(q) * dx(q) + dy(q) * dy(q)).alias("d"), q["track_id"].alias("track_id"), q["team"].alias("team"), q["height"].alias("height")))
    return b.join(p, ["clip_id", "frame"], "left").withColumn("near", F.array_min(F.filter(each, lambda x: x["d"].isNotNull()))).drop("_players")


def candidates(near: DataFrame, multiplier: float = 1.5, min_ball_confidence: float = 0.25, assign_interpolated: bool = False) -> DataFrame:
    """The gates in order: interpolated, unsure, nobody, too far; else the player's team."""
    reason = F.when(F.col("is_interpolated") & F.lit(not assign_interpolated), SKIPPED).when(F.col("ball_confidence") < min_ball_confidence, UNSURE).when(F.col("near").isNull(), NOBODY).when(F.col("near.d") > F.col("near.height") * multiplier, FAR).otherwise(NEAR)
    return near.withColumn("reason", reason).withColumn("candidate_team", F.when(F.col("reason") == NEAR, F.col("near.team")).otherwise("None"))


def smoothed(df: DataFrame, frames: int = 3) -> DataFrame:
    """Adds team: a switch needs `frames` equal candidates in a row; None takes effect at once.

    Closed form: the last None or the last candidate whose run has reached `frames`,
    whichever is later. All windows have one order, so the rows are sorted once.
    """
    w = clip().orderBy("frame")
    all_ = w.rowsBetween(Window.unboundedPreceding, 0)
    none = F.col("candidate_team") == "None"
    new = ~F.col("candidate_team").eqNullSafe(F.lag("candidate_team").over(w))
    df = df.withColumns({"_new": new, "_row": F.row_number().over(w)})
    df = df.withColumn("_n", F.col("_row") - F.last(F.when(F.col("_new"), F.col("_row")), ignorenulls=True).over(all_) + 1)
    told = F.when(none, "None").when(F.col("_n") >= frames, F.col("candidate_team"))
    df = df.withColumn("team", F.coalesce(F.last(told, ignorenulls=True).over(all_), F.lit("None")))
    before = F.coalesce(F.lag("team").over(w), F.lit("None"))
    df = df.withColumn("_before", before)
    suffix = F.when(none, "").when((F.col("_n") == frames) & (F.col("_before") != F.col("candidate_team")), "; smoothed_switch_confirmed").when(F.col("candidate_team") != F.col("team"), F.concat(F.lit("; smoothed_pending_switch_to_"), "candidate_team")).otherwise("")
    return df.withColumn("possession_reason", F.concat("reason", suffix)).drop("_new", "_row", "_n", "_before", "reason")


def estimate_possession(ball: DataFrame, tracks: DataFrame, teams: DataFrame, frames: int = 3, **gates) -> DataFrame:
    df = smoothed(candidates(nearest_player(ball, eligible(tracks, teams)), **gates), frames)
    mine = F.col("team") != "None"
    return df.select("clip_id", "frame", "timestamp", "team", "candidate_team", F.when(mine, F.col("near.track_id")).alias("player_id"), F.when(mine, F.col("near.d")).alias("distance_to_ball"), "ball_x", "ball_y", "is_interpolated", "possession_reason")


def possession_summary(possession: DataFrame) -> DataFrame:
    """Frames and share by team."""
    return possession.groupBy("team").agg(F.count("*").alias("frames"), F.avg("distance_to_ball").alias("mean_distance")).withColumn("percent", 100.0 * F.col("frames") / F.sum("frames").over(Window.partitionBy()))


def reason_counts(possession: DataFrame) -> DataFrame:
    return possession.groupBy(F.substring_index("possession_reason", ";", 1).alias("reason")).agg(F.count("*").alias("frames"))


def with_possession_changes(possession: DataFrame) -> DataFrame:
    """Adds possession_changed: the owner (team and player) differs from the last one there was; frames_since_possession_change: since then or since the first owner, 0 before any."""
    w = clip().orderBy("frame")
    owner = F.when(F.col("player_id").isNotNull() & F.col("team").isin("Team A", "Team B"), F.struct("team", "player_id"))
    df = possession.withColumn("_owner", owner).withColumn("_last", F.last("_owner", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    owned = F.col("_owner").isNotNull()
    changed = owned & F.col("_last").isNotNull() & ~F.col("_owner").eqNullSafe(F.col("_last"))
    start = changed | (owned & F.col("_last").isNull())
    at = F.last(F.when(start, F.col("frame")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"possession_changed": changed.cast("int"), "frames_since_possession_change": F.coalesce(F.col("frame") - at, F.lit(0)).cast("long")}).drop("_owner", "_last")


def possession_changes(possession: DataFrame) -> DataFrame:
    return with_possession_changes(possession).select("clip_id", "frame", "possession_changed", "frames_since_possession_change")


def possession_report(possession: DataFrame) -> DataFrame:
    """(clip_id, section, metric, value) of estimate_possession's rows: frames and percent of each team, Unknown and None (0 where there are none), interpolated rows and rows of low confidence, mean and largest distance of assigned frames (0 without any), rows by reason."""
    team, reason = F.col("team"), F.substring_index("possession_reason", ";", 1)
    of = lambda name: F.count_if(team == name)
    assigned = F.when(team != "None", F.col("distance_to_ball"))
    names = {"team_a": "Team A", "team_b": "Team B", "unknown": "Unknown"}
    one = {"total_ball_frames": F.count("*"), **{f"{k}_frames": of(v) for k, v in names.items()}, "frames_with_no_possession": of("None"), "interpolated_ball_rows": F.count_if("is_interpolated"), "low_ball_confidence_rows": F.count_if(reason == UNSURE)}
    distances = {"assigned_distance_avg": F.coalesce(F.avg(assigned), F.lit(0.0)), "assigned_distance_max": F.coalesce(F.max(assigned), F.lit(0.0))}
    shares = {f"{k}_possession_percent": 100.0 * of(v) / F.count("*") for k, v in (names | {"no": "None"}).items()}
    g = possession.groupBy("clip_id").agg(*(v.cast("double").alias(k) for k, v in (one | distances | shares).items()))
    sections = dict.fromkeys(one, "counts") | dict.fromkeys(distances, "distances") | dict.fromkeys(shares, "percentages")
    rows = g.select("clip_id", F.explode(F.array(*(F.struct(F.lit(x).alias("section"), F.lit(k).alias("metric"), F.col(k).alias("value")) for k, x in sections.items()))).alias("x")).select("clip_id", "x.*")
    return rows.union(possession.groupBy("clip_id", reason.alias("metric")).agg(F.count("*").cast("double").alias("value")).select("clip_id", F.lit("reasons"), "metric", "value"))
