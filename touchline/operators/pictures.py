"""Tables that pictures and reports are drawn from: points, edges, densities, readable statistics, top players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, distance
from .segments import TEAMS

#: Height of a player whose box isn't known.
HEIGHT = 60.0


def in_frame(points: DataFrame, width: int, height: int) -> DataFrame:
    """Points with px and py, their whole pixels (halves to even); those outside the picture or without a place are left out."""
    df = points.withColumns({"px": F.bround("center_x").cast("long"), "py": F.bround("center_y").cast("long")})
    return df.where(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1))


def frame_size(points: DataFrame) -> DataFrame:
    """(clip_id, width, height) as the clip's points tell them: the next whole number above the largest place, and one, but 1 at least; 0 and 0 if no point has both places. Boxes' far corners (x2, y2) count where there are some."""
    x, y = ("x2", "y2") if {"x2", "y2"} <= set(points.columns) else ("center_x", "center_y")
    there = F.col("center_x").isNotNull() & F.col("center_y").isNotNull()
    size = lambda c: F.coalesce(F.greatest(F.ceil(F.max(F.when(there, F.col(c)))).cast("long") + 1, F.lit(1)), F.lit(0))
    g = points.groupBy("clip_id").agg(F.count_if(there).alias("_n"), size(x).alias("width"), size(y).alias("height"))
    return g.select("clip_id", F.when(F.col("_n") > 0, F.col("width")).otherwise(0).alias("width"), F.when(F.col("_n") > 0, F.col("height")).otherwise(0).alias("height"))


def density(points: DataFrame, width: int, height: int, *by: str) -> DataFrame:
    """How many points each pixel holds, by the columns `by`; pixels without one have no row."""
    return in_frame(points, width, height).groupBy(*by, "px", "py").agg(F.count("*").alias("points"))


def team_points(tracks: DataFrame, teams: DataFrame, goalkeepers: bool = False) -> DataFrame:
    """The points of both teams' outfield players, with team; of their goalkeepers too if asked."""
    kinds = ("player", "goalkeeper") if goalkeepers else ("player",)
    team = F.when(F.col("role").isin(*(f"team_a_{k}" for k in kinds)), TEAMS[0]).when(F.col("role").isin(*(f"team_b_{k}" for k in kinds)), TEAMS[1])
    named = teams.select("clip_id", "track_id", team.alias("team")).where("team is not null")
    return tracks.join(named, ["clip_id", "track_id"])


def carry_lines(carries: DataFrame, least: float = 0.0) -> DataFrame:
    """Carries of a team over `least` pixels or more, as lines of the ball."""
    return carries.where(F.col("team").isin(*TEAMS) & (F.col("ball_distance_px") >= least)).select("clip_id", "carry_id", "team", "player_id", "start_ball_x", "start_ball_y", "end_ball_x", "end_ball_y", "ball_distance_px", "duration_seconds")


def interception_points(interceptions: DataFrame) -> DataFrame:
    """Interceptions of a team whose place is known."""
    return interceptions.where(F.col("winner_team").isin(*TEAMS) & F.col("ball_x").isNotNull() & F.col("ball_y").isNotNull()).select("clip_id", "interception_id", F.col("winner_team").alias("team"), F.col("winner_player_id").alias("player_id"), "ball_x", "ball_y")


def pass_lines(passes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Passes (of weak_passes) as lines from the passer at the last frame of their run to the receiver at the first of theirs; without either place, none."""
    at = lambda k, frame: tracks.where("center_x is not null and center_y is not null").select("clip_id", F.col("track_id").alias(f"{k}_player"), F.col("frame").alias(frame), F.col("center_x").alias(f"{k}_x"), F.col("center_y").alias(f"{k}_y"))
    df = passes.select("clip_id", "pass_id", "team", "from_player", "to_player", "start_frame", "end_frame")
    return df.join(at("from", "start_frame"), ["clip_id", "from_player", "start_frame"]).join(at("to", "end_frame"), ["clip_id", "to_player", "end_frame"]).select("clip_id", "pass_id", "team", "from_player", "to_player", "from_x", "from_y", "to_x", "to_y")


def pass_edges(lines: DataFrame) -> DataFrame:
    """Of each pair of players: passes, and the mean ends of their lines."""
    return lines.groupBy("clip_id", "team", "from_player", "to_player").agg(F.count("*").alias("passes"), *(F.avg(c).alias(f"mean_{c}") for c in ("from_x", "from_y", "to_x", "to_y")))


def event_summary(events: DataFrame, total: str, at: str, top: int = 20, player: str = "player_id", team: str = "team", metrics: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """(clip_id, section, metric, value): a clip's events, those of each team and of its `top` players, and further metrics (name: section and aggregate). Of players with as many events, the one whose first event (by `at`) comes first."""
    out = events.groupBy("clip_id").agg(F.count("*").cast("double").alias(total), *(f.cast("double").alias(k) for k, (_, f) in (metrics or {}).items()))
    names = {total: "counts"} | {k: section for k, (section, _) in (metrics or {}).items()}
    rows = out.select("clip_id", F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.lit(k).alias("metric"), F.col(k).alias("value")) for k, s in names.items()))).alias("x")).select("clip_id", "x.*")
    count = lambda c, section: events.groupBy("clip_id", F.col(c).cast("string").alias("metric")).agg(F.count("*").alias("n"), F.min(at).alias("first")).withColumn("section", F.lit(section))
    rank = F.row_number().over(clip().orderBy(F.desc("n"), "first", "metric"))
    best = count(player, "players").withColumn("_rank", rank).where(F.col("_rank") <= top)
    told = lambda df: df.select("clip_id", "section", "metric", F.col("n").cast("double").alias("value"))
    return rows.union(told(count(team, "teams"))).union(told(best))


def readable_player_stats(stats: DataFrame) -> DataFrame:
    """player_stats with rounded numbers under readable names, in order: by clip, most frames first, then the longest way, then the id."""
    r = lambda c, n: F.round(c, n)
    ordered = stats.orderBy("clip_id", F.desc("frames_seen"), F.desc("path_length"), "track_id")
    return ordered.select("clip_id", F.col("track_id").alias("Player ID"), F.col("frames_seen").alias("Frames Seen"), r("mean_confidence", 3).alias("Average Confidence"), r("path_length", 2).alias("Total Distance (pixels)"), r("mean_speed", 2).alias("Average Speed (pixels/sec)"), r("time_visible", 2).alias("Time Visible (sec)"))


def counted_passes(ball: DataFrame, players: DataFrame, teams: DataFrame, factor: float = 1.5) -> DataFrame:
    """Per clip, passes that reached the same team and passes that reached the other, by the nearest player alone.

    A frame that both tables have gives the ball to its nearest player (the lower id
    of two as near) if that one is nearer than factor times their height (60 if it
    isn't known). Who had it last keeps it through frames that give it to nobody. A
    change of player counts if both players' teams are known.
    """
    d = ball.select("clip_id", "frame", F.col("center_x").alias("_bx"), F.col("center_y").alias("_by")).dropDuplicates(["clip_id", "frame"]).join(players.select("clip_id", "frame", "track_id", "center_x", "center_y", F.coalesce("height", F.lit(HEIGHT)).alias("height")), ["clip_id", "frame"]).withColumn("d", distance("center_x", "center_y", "_bx", "_by"))
    near = d.groupBy("clip_id", "frame").agg(F.min(F.struct("d", "track_id", "height")).alias("x")).select("clip_id", "frame", "x.*").where(F.col("d") < F.col("height") * factor)
    team = F.when(F.col("team").isin(*TEAMS), F.col("team")).otherwise("Unknown")
    held = near.join(teams.select("clip_id", "track_id", team.alias("team")), ["clip_id", "track_id"], "left").withColumn("team", F.coalesce("team", F.lit("Unknown")))
    w = Window.partitionBy("clip_id").orderBy("frame")
    moved = held.withColumns({"_who": F.lag("track_id").over(w), "_team": F.lag("team").over(w)})
    change = F.coalesce(F.col("_who") != F.col("track_id"), F.lit(False))
    known = (F.col("team") != "Unknown") & (F.col("_team") != "Unknown")
    got = moved.groupBy("clip_id").agg(F.count_if(change & (F.col("team") == F.col("_team")) & (F.col("team") != "Unknown")).alias("successful"), F.count_if(change & (F.col("team") != F.col("_team")) & known).alias("failed"))
    return ball.select("clip_id").distinct().join(got, "clip_id", "left").na.fill(0)
