"""Roles of tracks: outfield players, goalkeepers, referees.

A clip's tracks are parted into a few colours; what is neither team's usual colour
is an odd one. Odd tracks near a goal become goalkeepers, those in the middle that
lie far from both teams' colours referees. All choices are windows over a clip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kmeans import groups_of_clips
from .motion import steps
from .teams import SAMPLES, WEIGHTS, classify_teams

#: Groups of colours, frames of a goalkeeper, distance of a referee's colour, share of the width before a goal, the middle's bounds.
COLOURS, KEEPER_FRAMES, REFEREE_DISTANCE, GOAL_AREA, MIDDLE = 5, 60, 2.1, 0.18, (0.25, 0.75)
#: Least rows and share of a team's largest group for another of its usual colours; share of the width that parts the teams' halves; least score of a goalkeeper; most referees.
USUAL, USUAL_SHARE, APART, LEAST_SCORE, REFEREES = 4, 0.40, 0.15, 0.45, 4


def track_positions(tracks: DataFrame) -> DataFrame:
    """Each track's frames, extremes, medians, spans, way and the medians of its boxes. tracks: clip_id, track_id, frame, center_x, center_y; x1 to y2 for the boxes, nulls without them."""
    box = lambda a, b: F.percentile(F.col(b) - F.col(a), 0.5) if {a, b} <= set(tracks.columns) else F.lit(None).cast("double")
    g = steps(tracks).groupBy("clip_id", "track_id").agg(
        F.count("frame").alias("track_frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        *(f(f"center_{c}").alias(f"{k}_{c}") for c in "xy" for k, f in (("median", lambda c: F.percentile(c, 0.5)), ("min", F.min), ("max", F.max))),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("movement_distance"), box("x1", "x2").alias("median_box_width"), box("y1", "y2").alias("median_box_height"),
    )
    return g.withColumns({"span_x": F.col("max_x") - F.col("min_x"), "span_y": F.col("max_y") - F.col("min_y")})


def colour_clusters(classified: DataFrame, k: int = COLOURS) -> DataFrame:
    """classified with color_cluster: the group of each track's colour among its clip's tracks; -1 without a colour."""
    return groups_of_clips(classified.drop("color_cluster"), "track_id", ["lab_a", "lab_b", "lab_l"], max(2, k), "color_cluster", WEIGHTS)


def colour_cluster_summary(df: DataFrame) -> DataFrame:
    """Each group of colours (of colour_clusters with track_positions): tracks, how many of each team, medians."""
    team = lambda t: F.count_if(F.col("team") == t)
    return df.where("color_cluster >= 0").groupBy("clip_id", "color_cluster").agg(
        F.count("*").alias("tracks"), F.count_if(F.col("frames_used") >= SAMPLES).alias("reliable_tracks"), team("Team A").alias("team_a_tracks"), team("Team B").alias("team_b_tracks"), team("Unknown").alias("unknown_tracks"),
        *(F.percentile(c, 0.5).alias(f"median_{c}") for c in ("r", "g", "b", "lab_l", "lab_a", "lab_b")), F.percentile("median_x", 0.5).alias("median_x"), F.percentile("median_y", 0.5).alias("median_y"), F.percentile("movement_distance", 0.5).alias("median_movement"),
    )


def usual_colours(df: DataFrame) -> DataFrame:
    """(clip_id, color_cluster) of the groups that hold many of a team's reliable tracks: 4 at least, and 40 % of the team's largest group."""
    n = df.where(F.col("team").isin("Team A", "Team B") & (F.col("frames_used") >= SAMPLES) & (F.col("color_cluster") >= 0)).groupBy("clip_id", "team", "color_cluster").agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy("clip_id", "team"))
    return n.withColumn("least", F.greatest(F.lit(USUAL), F.ceil(most * USUAL_SHARE))).where("n >= least").select("clip_id", "color_cluster").distinct()


def _within(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def assign_roles(clustered: DataFrame, frame_width: float, keeper_frames: int = KEEPER_FRAMES, referee_distance: float = REFEREE_DISTANCE) -> DataFrame:
    """clustered (of colour_clusters, with track_positions) with role, role_confidence, role_reason and role_color_outlier; team changes with the role.

    Goalkeepers: the best odd track before each goal, by length and little movement;
    they join the team whose players' middle lies on that side, or none if the
    halves can't be told. Referees: the best four odd tracks in the middle whose
    colour lies far from both teams', by that distance and by movement; they join no
    team. Ties go by more frames, then by team and track_id. Whoever joins no team
    and has neither role is unknown.
    """
    w, of_clip = frame_width, Window.partitionBy("clip_id")
    players, x = F.col("team").isin("Team A", "Team B"), F.col("median_x")
    df = clustered.join(usual_colours(clustered).withColumn("_usual", F.lit(True)), ["clip_id", "color_cluster"], "left")
    df = df.withColumns({
        "role": F.when(F.col("team") == "Team A", "team_a_player").when(F.col("team") == "Team B", "team_b_player").otherwise("unknown"),
        "role_color_outlier": F.col("_usual").isNull(), "role_confidence": F.col("assignment_confidence"),
        "role_reason": F.when(players, "outfield_color_cluster").otherwise(F.col("assignment_reason")),
    })
    way = lambda q: F.percentile(F.when(players, F.col("movement_distance")), q).over(of_clip)
    middle = lambda t: F.percentile(F.when(F.col("team") == t, x), 0.5).over(of_clip)
    df = df.withColumns({"_cut": way(0.60), "_a": middle("Team A"), "_b": middle("Team B")})

    side = F.when(x <= w * GOAL_AREA, "left").when(x >= w * (1.0 - GOAL_AREA), "right")
    reliable = F.col("role_color_outlier") & (F.col("frames_used") >= SAMPLES)
    still = F.when(F.col("_cut").isNull(), 1.0).otherwise(1.0 - _within(F.coalesce("movement_distance", "_cut") / F.greatest(F.col("_cut"), F.lit(1.0))))
    score = 0.45 * _within(F.col("track_frames") / max(keeper_frames, 1)) + 0.35 * still + 0.20
    df = df.withColumn("_side", F.when(reliable & (F.col("track_frames") >= keeper_frames), side)).withColumn("_score", score)
    best = F.row_number().over(Window.partitionBy("clip_id", "_side").orderBy(F.desc("_score"), F.desc("track_frames"), "team", "track_id"))
    df = df.withColumn("_keeper", F.col("_side").isNotNull() & (best == 1) & (F.col("_score") >= LEAST_SCORE))
    apart, a_left = F.abs(F.col("_a") - F.col("_b")) >= w * APART, F.col("_a") < F.col("_b")
    owner = F.when(apart, F.when(a_left == (F.col("_side") == "left"), "Team A").otherwise("Team B"))
    df = df.withColumn("_owner", owner).withColumns({
        "team": F.when(F.col("_keeper"), F.coalesce("_owner", F.lit("Unknown"))).otherwise(F.col("team")),
        "role": F.when(~F.col("_keeper"), F.col("role")).when(F.col("_owner") == "Team A", "team_a_goalkeeper").when(F.col("_owner") == "Team B", "team_b_goalkeeper").otherwise(F.concat(F.lit("goalkeeper_"), "_side")),
        "role_confidence": F.when(F.col("_keeper"), F.greatest("role_confidence", "_score")).otherwise(F.col("role_confidence")),
        "role_reason": F.when(F.col("_keeper"), F.format_string("color_outlier_near_%s_goal", "_side")).otherwise(F.col("role_reason")),
    })

    d = F.col("cluster_distance")
    df = df.withColumn("_way", F.coalesce(F.percentile(F.when(F.col("team").isin("Team A", "Team B"), F.col("movement_distance")), 0.5).over(of_clip), F.lit(1.0)))
    central = x.between(w * MIDDLE[0], w * MIDDLE[1]) & (F.col("color_cluster") >= 0) & (F.col("track_frames") >= max(20, 2 * SAMPLES)) & (d.isNull() | (d >= referee_distance))
    score = 0.55 * _within(F.coalesce(d, F.lit(0.0)) / max(referee_distance, 1.0)) + 0.45 * _within(F.coalesce("movement_distance", F.lit(0.0)) / F.greatest(F.col("_way"), F.lit(1.0)))
    df = df.withColumn("_official", F.coalesce(reliable & central, F.lit(False))).withColumn("_score", score)
    rank = F.row_number().over(Window.partitionBy("clip_id", "_official").orderBy(F.desc("_score"), F.desc("track_frames"), "team", "track_id"))
    df = df.withColumn("_official", F.col("_official") & (rank <= REFEREES) & ~F.col("_keeper"))
    chosen = lambda new, old: F.when(F.col("_official"), new).otherwise(F.col(old))
    df = df.withColumns({"team": chosen(F.lit("Unknown"), "team"), "role": chosen(F.lit("referee"), "role"), "role_confidence": chosen(F.greatest("role_confidence", "_score"), "role_confidence"), "role_reason": chosen(F.lit("color_outlier_central_official_candidate"), "role_reason")})
    none = (F.col("team") == "Unknown") & ~F.col("role").isin("referee", "goalkeeper_left", "goalkeeper_right")
    return df.withColumn("role", F.when(none, "unknown").otherwise(F.col("role"))).drop("_usual", "_cut", "_a", "_b", "_side", "_score", "_keeper", "_owner", "_way", "_official")


def player_roles(classified: DataFrame, tracks: DataFrame, frame_width: float, colours: int = COLOURS) -> DataFrame:
    """Teams and roles of all tracks: classified (of classify_teams) with the clip's groups of colours, positions and roles."""
    placed = classified.drop("role", "role_confidence", "role_reason").join(track_positions(tracks), ["clip_id", "track_id"], "left")
    return assign_roles(colour_clusters(placed, colours), frame_width)


def team_sheet(samples: DataFrame, tracks: DataFrame, frame_width: float, clusters: int = 2, colours: int = COLOURS) -> DataFrame:
    """From colour samples and tracks to teams and roles: median colours, two teams, tracks without samples, positions, roles. Two is the only number of teams."""
    if clusters != 2:
        raise ValueError(f"Team classification needs exactly 2 clusters, not {clusters}")
    return player_roles(classify_teams(samples, tracks), tracks, frame_width, colours)
