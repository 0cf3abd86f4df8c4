"""Queries of splits, constraints and moments over windows, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import constraints, reports, splits
from ..sources import fixtures as fx
from .catalog import _HOP, _windows, query, rounded

CLASSES = ["carry", "pass", "shot", "turnover"]
#: Labelled events by clip, of which each class is known in some clips only, so that not every split will do.
_SOME = """, sm AS (SELECT clip_id, label AS target_class, start_frame FROM intervals WHERE (CASE label WHEN 'carry' THEN clip_id % 2 = 0 WHEN 'pass' THEN clip_id % 3 <> 1 WHEN 'shot' THEN clip_id > 2 WHEN 'turnover' THEN clip_id % 4 = 1 END))"""


def _some(s, d):
    n, c = F.col("clip_id"), F.col("label")
    keep = F.when(c == "carry", n % 2 == 0).when(c == "pass", n % 3 != 1).when(c == "shot", n > 2).when(c == "turnover", n % 4 == 1)
    return fx.intervals(s, d).where(keep).withColumnRenamed("label", "target_class")


_BEST = _SOME + """, cl AS (SELECT f.clip_id, coalesce(m, 0) AS m, row_number() OVER (ORDER BY f.clip_id) - 1 AS i, row_number() OVER (ORDER BY (f.clip_id * 40503 + 42) % 97, f.clip_id) - 1 AS p FROM (SELECT DISTINCT clip_id FROM frames) f LEFT JOIN (SELECT clip_id, bit_or(1 << (list_position(['carry', 'pass', 'shot', 'turnover'], target_class)::INT - 1)) AS m FROM sm GROUP BY 1) m ON m.clip_id = f.clip_id),
sets AS (SELECT id, bit_count(id) AS k, sum(p) AS sum_, list(p ORDER BY i) AS ps, bit_or(m) AS m FROM (SELECT unnest(range(256)) AS id) CROSS JOIN cl WHERE (id >> i) & 1 = 1 GROUP BY 1, 2),
best AS (SELECT t.id AS t, v.id AS v FROM sets t JOIN sets v ON t.id & v.id = 0 JOIN sets e ON e.id = 255 - t.id - v.id WHERE t.k = 5 AND v.k = 1 AND e.k = 2 AND t.m = 15 ORDER BY bit_count(t.m) DESC, bit_count(v.m) DESC, bit_count(e.m) DESC, t.sum_, v.sum_, t.ps, v.ps LIMIT 1),
parted AS (SELECT clip_id, CASE WHEN (t >> i) & 1 = 1 THEN 'train' WHEN (v >> i) & 1 = 1 THEN 'val' ELSE 'test' END AS split FROM cl CROSS JOIN best)
"""


def _best(s, d):
    classes = _some(s, d).groupBy("clip_id").agg(F.collect_set("target_class").alias("classes"))
    clips = fx.frames(s, d).select("clip_id").distinct().join(classes, "clip_id", "left").withColumns({"classes": F.coalesce("classes", F.array().cast("array<string>")), "order": (F.col("clip_id") * 40503 + 42) % 97})
    return splits.exhaustive_split(clips, CLASSES, 5, 1, 2)


@query("exhaustive_split", _BEST + "SELECT * FROM parted")
def _(s, d):
    return _best(s, d)


@query("split_missing_classes", _BEST + """SELECT split, string_agg(label, ', ' ORDER BY label) AS missing FROM (SELECT unnest(['val', 'test']) AS split) s CROSS JOIN (SELECT unnest(['carry', 'pass', 'shot', 'turnover']) AS label) c WHERE NOT EXISTS (SELECT 1 FROM sm JOIN parted USING (clip_id) WHERE parted.split = s.split AND target_class = c.label) GROUP BY split""")
def _(s, d):
    return splits.missing_classes(_some(s, d), _best(s, d), CLASSES)


_FIXED = _HOP + """, wl AS (SELECT clip_id, start_frame, (target_class = 'carry')::INT AS label_id, CASE WHEN clip_id < 4 THEN 'train' WHEN clip_id = 4 THEN 'validation' WHEN clip_id < 7 THEN 'test' ELSE 'held back' END AS split FROM win)"""


def _fixed(s, d):
    n = F.col("clip_id")
    table = fx.frames(s, d).select("clip_id").distinct().withColumn("split", F.when(n < 4, "train").when(n == 4, "validation").when(n < 7, "test").otherwise("held back"))
    w = _windows(s, d).select("clip_id", "start_frame", (F.col("target_class") == "carry").cast("int").alias("label_id"))
    return splits.fixed_split(w, table)


@query("fixed_split", _FIXED + " SELECT * FROM wl")
def _(s, d):
    return _fixed(s, d)


@query("fixed_split_summary", _FIXED + " SELECT s.split, count(DISTINCT clip_id) AS clips, count(clip_id) AS total_windows, count(*) FILTER (label_id = 1) AS carry_windows, count(*) FILTER (label_id = 0) AS background_windows FROM (SELECT unnest(['train', 'validation', 'test', 'excluded']) AS split) s LEFT JOIN wl ON wl.split = s.split GROUP BY 1")
def _(s, d):
    return splits.split_summary(_fixed(s, d))


@query("manifest_lookup", """, cm AS (SELECT clip_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS frames FROM frames GROUP BY 1) SELECT * FROM cm WHERE clip_id = 3""")
def _(s, d):
    """The one row of a clip in a table of clips; the table has each clip once."""
    clips = fx.frames(s, d).groupBy("clip_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("frames"))
    return constraints.lookup(constraints.unique(clips, "clip_id", says="Duplicate clip ID in manifest"), "clip_id", 3)


_MOMENTS = _HOP + """, fr AS (SELECT clip_id, frame, center_x AS ball_x, CASE WHEN frame % 3 > 0 THEN confidence END AS sure, 5.0::DOUBLE AS flat FROM ball),
tw AS (SELECT * FROM win WHERE clip_id < 6), pcs AS (SELECT f.* FROM tw JOIN fr f ON f.clip_id = tw.clip_id AND f.frame BETWEEN tw.start_frame AND tw.end_frame),
mo AS (SELECT 'ball_x' AS feature, count(ball_x) AS n, avg(ball_x) AS mean, coalesce(nullif(stddev_samp(ball_x), 0), 1) AS std FROM pcs UNION ALL SELECT 'sure', count(sure), avg(sure), coalesce(nullif(stddev_samp(sure), 0), 1) FROM pcs UNION ALL SELECT 'flat', count(flat), avg(flat), 1 FROM pcs)
"""


def _features(s, d):
    return fx.ball(s, d).select("clip_id", "frame", F.col("center_x").alias("ball_x"), F.when(F.col("frame") % 3 > 0, F.col("confidence")).alias("sure"), F.lit(5.0).alias("flat"))


@query("window_cover", _HOP + "SELECT b.clip_id, b.frame, count(w.clip_id) AS cover FROM ball b LEFT JOIN win w ON w.clip_id = b.clip_id AND b.frame BETWEEN w.start_frame AND w.end_frame GROUP BY 1, 2")
def _(s, d):
    return reports.window_cover(fx.ball(s, d).select("clip_id", "frame"), _windows(s, d))


@query("window_moments", _MOMENTS + "SELECT feature, n::BIGINT AS n, round(mean, 6) AS mean, round(std, 6) AS std FROM mo")
def _(s, d):
    return rounded(reports.window_moments(_features(s, d), _windows(s, d).where("clip_id < 6"), ["ball_x", "sure", "flat"]))


@query("normalised_frames", _MOMENTS + "SELECT clip_id, frame, " + ", ".join(f"round(coalesce(({c} - (SELECT mean FROM mo WHERE feature = '{c}')) / (SELECT std FROM mo WHERE feature = '{c}'), 0), 5) AS {c}" for c in ("ball_x", "sure", "flat")) + " FROM fr")
def _(s, d):
    w = _windows(s, d).withColumn("split", F.when(F.col("clip_id") < 6, "train").otherwise("test"))
    return rounded(reports.normalised_frames(_features(s, d), w, ["ball_x", "sure", "flat"]), 5)
