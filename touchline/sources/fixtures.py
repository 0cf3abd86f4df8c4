"""Domain tables derived from the events table, with integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    e = e.withColumn("clip_id", F.col("event_id") % 8).withColumn("frame", ((F.col("event_id") - F.col("event_id") % 8) / 8).cast("long"))
    e = e.withColumn("blk", ((F.col("frame") - F.col("frame") % 9) / 9).cast("long"))
    w = Window.partitionBy("clip_id", "blk").orderBy("frame")
    return e.withColumn("ot", F.first("event_type").over(w)).withColumn("ou", F.first("user_id").over(w)).where("event_id % 97 <> 0").withColumn("timestamp", F.col("frame") / 25.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("ot").isin("click", "view"), F.col("ot").isin("purchase", "signup")
    return base(spark, sf_dir).select("event_id", "clip_id", "frame", "timestamp", "blk", F.when(a, "Team A").when(b, "Team B").otherwise("None").alias("team"), F.when(a, F.col("ou") % 5).when(b, 5 + F.col("ou") % 5).otherwise(-1).alias("pid"))


def _x(p):
    return F.abs((F.col("frame") * (3 + p) + 131 * p + 53 * F.col("clip_id")) % 2560 - 1280).cast("double")


def _y(p):
    return F.abs((F.col("frame") * (2 + p) + 71 * p) % 1440 - 720).cast("double")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("track_id")
    t = frames(spark, sf_dir).withColumn("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))).where("(frame + 7 * track_id) % 23 <> 0")
    return t.select("clip_id", "frame", "timestamp", "track_id", _x(p).alias("center_x"), _y(p).alias("center_y"), (40 + (7 * p) % 30).cast("double").alias("height"), (((F.col("frame") + 3 * p) % 20) / 20.0).alias("confidence"))


def teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = frames(spark, sf_dir).select("clip_id").distinct().withColumn("track_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    referee, a = F.col("track_id").isin(4, 9), F.col("track_id") < 5
    return t.select("clip_id", "track_id", F.when(referee, "Unknown").when(a, "Team A").otherwise("Team B").alias("team"), F.when(referee, "referee").when(a, "team_a_player").otherwise("team_b_player").alias("role"))


def ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).where("event_id % 13 <> 0")
    none, p = F.col("team") == "None", F.col("pid")
    x = F.when(none, F.abs((11 * F.col("frame")) % 2560 - 1280).cast("double")).otherwise(_x(p) + F.col("event_id") % 30)
    y = F.when(none, F.abs((7 * F.col("frame")) % 1440 - 720).cast("double")).otherwise(_y(p) + F.col("event_id") % 20)
    return f.select("clip_id", "frame", "timestamp", x.alias("center_x"), y.alias("center_y"), (0.05 + (37 * F.col("event_id") % 95) / 100.0).alias("confidence"), (F.col("event_id") % 11 == 0).alias("is_interpolated"))


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames as a possession table, the ball at the owner."""
    f = frames(spark, sf_dir)
    own = F.col("team") != "None"
    b = ball(spark, sf_dir).select("clip_id", "frame", F.col("center_x").alias("ball_x"), F.col("center_y").alias("ball_y"), "is_interpolated").hint("merge")  # nearly a row a frame, of which the compressed file tells little: no broadcast
    return f.join(b, ["clip_id", "frame"], "left").select("clip_id", "frame", "timestamp", "team", F.when(own, F.col("pid")).alias("player_id"), "ball_x", "ball_y", F.coalesce("is_interpolated", F.lit(False)).alias("is_interpolated"), F.when(own, (F.col("event_id") % 30).cast("double")).alias("distance_to_ball"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled events: the blocks of frames, lengthened by up to 13 frames so that some overlap."""
    g = frames(spark, sf_dir).groupBy("clip_id", "blk").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    label = F.element_at(F.array(*map(F.lit, ("carry", "pass", "turnover", "shot", "uncertain"))), (F.col("blk") % 5 + 1).cast("int"))
    return g.select("clip_id", F.col("blk").alias("event_id"), "start_frame", (F.col("end_frame") + (F.col("blk") * 7) % 14).alias("end_frame"), label.alias("label"))


def pass_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature row for each labelled event, as if it were a pass."""
    i = intervals(spark, sf_dir).withColumn("h", F.col("event_id") * 37 + F.col("clip_id") * 11)
    return i.selectExpr(
        "clip_id", "event_id AS pass_id", "start_frame", "end_frame", "start_frame + 3 AS center_frame", "CASE WHEN h % 7 = 0 THEN NULL WHEN h % 5 = 0 THEN 0 ELSE 1 END AS same_team", "h % 9 AS sender_stable", "h * 3 % 8 AS receiver_stable",
        "h % 3 AS free_ball", "end_frame - start_frame + 1 + h % 9 AS duration", "CASE WHEN h % 11 <> 0 THEN double(h % 50) END AS ball_distance", "CASE WHEN h % 13 <> 0 THEN int(h % 4 > 0) END AS above_baseline", "CASE WHEN h % 19 <> 0 THEN double(h % 100) END AS speed_peak",
        "CASE WHEN h % 17 <> 0 THEN double(h % 40) / 100 END AS missing", "double(h * 7 % 33) / 100 AS interpolated", "int(h % 6 = 0) AS flicker", "double(h % 10) / 30 AS carry_overlap", "double(h * 3 % 11) / 30 AS turnover_overlap",
        "CASE WHEN h % 23 <> 0 THEN double(h % 10 + 3) / 10 END AS completeness", "int(h % 4 <> 1) AS refined_eligible", "int(h % 5 = 1) AS post_turnover", "int(h % 8 = 2) AS recovery",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_type").alias("actual"), F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")).alias("predicted")).where("predicted is not null")


#: The same tables in SQL.
SQL = """
base AS (SELECT * FROM (SELECT *, first_value(event_type) OVER w AS ot, first_value(user_id) OVER w AS ou, frame / 25.0::DOUBLE AS "timestamp" FROM (SELECT *, CAST((frame - frame % 9) / 9 AS BIGINT) AS blk FROM (SELECT event_id, user_id, event_type, event_id % 8 AS clip_id, CAST((event_id - event_id % 8) / 8 AS BIGINT) AS frame FROM events)) WINDOW w AS (PARTITION BY clip_id, blk ORDER BY frame)) WHERE event_id % 97 <> 0),
frames AS (SELECT event_id, clip_id, frame, "timestamp", blk, CASE WHEN ot IN ('click','view') THEN 'Team A' WHEN ot IN ('purchase','signup') THEN 'Team B' ELSE 'None' END AS team, CASE WHEN ot IN ('click','view') THEN ou % 5 WHEN ot IN ('purchase','signup') THEN 5 + ou % 5 ELSE -1 END AS pid FROM base),
tracks AS (SELECT clip_id, frame, "timestamp", p AS track_id, abs((frame * (3 + p) + 131 * p + 53 * clip_id) % 2560 - 1280)::DOUBLE AS center_x, abs((frame * (2 + p) + 71 * p) % 1440 - 720)::DOUBLE AS center_y, (40 + (7 * p) % 30)::DOUBLE AS height, ((frame + 3 * p) % 20) / 20.0::DOUBLE AS confidence FROM frames, (SELECT unnest(range(10)) AS p) WHERE (frame + 7 * p) % 23 <> 0),
ball AS (SELECT clip_id, frame, "timestamp", CASE WHEN team = 'None' THEN abs((11 * frame) % 2560 - 1280)::DOUBLE ELSE abs((frame * (3 + pid) + 131 * pid + 53 * clip_id) % 2560 - 1280)::DOUBLE + event_id % 30 END AS center_x, CASE WHEN team = 'None' THEN abs((7 * frame) % 1440 - 720)::DOUBLE ELSE abs((frame * (2 + pid) + 71 * pid) % 1440 - 720)::DOUBLE + event_id % 20 END AS center_y, 0.05::DOUBLE + (37 * event_id % 95) / 100.0::DOUBLE AS confidence, event_id % 11 = 0 AS is_interpolated FROM frames WHERE event_id % 13 <> 0),
owners AS (SELECT f.clip_id, f.frame, f."timestamp", team, CASE WHEN team <> 'None' THEN pid END AS player_id, center_x AS ball_x, center_y AS ball_y, coalesce(is_interpolated, false) AS is_interpolated, CASE WHEN team <> 'None' THEN (event_id % 30)::DOUBLE END AS distance_to_ball FROM frames f LEFT JOIN ball b ON f.clip_id = b.clip_id AND f.frame = b.frame),
intervals AS (SELECT clip_id, blk AS event_id, min(frame) AS start_frame, max(frame) + (blk * 7) % 14 AS end_frame, ['carry','pass','turnover','shot','uncertain'][blk % 5 + 1] AS label FROM frames GROUP BY clip_id, blk),
pass_features AS (SELECT clip_id, event_id AS pass_id, start_frame, end_frame, start_frame + 3 AS center_frame, CASE WHEN h % 7 = 0 THEN NULL WHEN h % 5 = 0 THEN 0 ELSE 1 END AS same_team, h % 9 AS sender_stable, h * 3 % 8 AS receiver_stable, h % 3 AS free_ball, end_frame - start_frame + 1 + h % 9 AS duration, CASE WHEN h % 11 <> 0 THEN (h % 50)::DOUBLE END AS ball_distance, CASE WHEN h % 13 <> 0 THEN (h % 4 > 0)::INT END AS above_baseline, CASE WHEN h % 19 <> 0 THEN (h % 100)::DOUBLE END AS speed_peak, CASE WHEN h % 17 <> 0 THEN (h % 40)::DOUBLE / 100 END AS missing, (h * 7 % 33)::DOUBLE / 100 AS interpolated, (h % 6 = 0)::INT AS flicker, (h % 10)::DOUBLE / 30 AS carry_overlap, (h * 3 % 11)::DOUBLE / 30 AS turnover_overlap, CASE WHEN h % 23 <> 0 THEN (h % 10 + 3)::DOUBLE / 10 END AS completeness, (h % 4 <> 1)::INT AS refined_eligible, (h % 5 = 1)::INT AS post_turnover, (h % 8 = 2)::INT AS recovery FROM (SELECT *, event_id * 37 + clip_id * 11 AS h FROM intervals)),
predictions AS (SELECT * FROM (SELECT event_type AS actual, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS predicted FROM events) WHERE predicted IS NOT NULL)
"""
