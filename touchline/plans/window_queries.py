"""Queries of windows, splits, dedupes, nearest rows and teams, and the same in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels, motion, segments, tables, windows
from ..sources import fixtures as fx
from .catalog import _HOP, _windows, query, rounded
from .event_queries import _carries
from .frame_queries import _LABELS

_W = """, cw0 AS (SELECT clip_id, frame AS start_frame, lead(frame, 63) OVER w AS end_frame, lead(frame, 32) OVER w AS center_frame, lead(label, 32) OVER w AS label, lead(label_id, 32) OVER w AS label_id, row_number() OVER w - 1 AS r FROM labels WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
cw AS (SELECT * EXCLUDE (r), 64 AS window_length, (end_frame - start_frame <> 63)::INT AS contains_frame_gap FROM cw0 WHERE end_frame IS NOT NULL AND r % 16 = 0)
"""


def _carry_windows(s, d):
    return windows.carry_windows(labels.carry_labels(fx.frames(s, d), _carries(s, d)))


@query("carry_windows", _LABELS + _W + "SELECT * FROM cw")
def _(s, d):
    return _carry_windows(s, d)


@query("carry_window_summary", _LABELS + _W + "SELECT clip_id, count(*) FILTER (contains_frame_gap = 0) AS windows, count(*) FILTER (contains_frame_gap = 1) AS rejected_gap_windows, count(*) FILTER (contains_frame_gap = 0 AND label = 'carry') AS carry_windows FROM cw GROUP BY 1")
def _(s, d):
    whole = F.col("contains_frame_gap") == 0
    return _carry_windows(s, d).groupBy("clip_id").agg(F.count_if(whole).alias("windows"), F.count_if(~whole).alias("rejected_gap_windows"), F.count_if(whole & (F.col("label") == "carry")).alias("carry_windows"))


@query("window_features", _HOP + """, fr AS (SELECT f.clip_id, f.frame, b.center_x, b.confidence FROM frames f LEFT JOIN ball b ON f.clip_id = b.clip_id AND f.frame = b.frame), dn AS (SELECT w.clip_id, w.start_frame, w.start_frame + k AS frame, k AS position FROM win w, (SELECT unnest(range(64)) AS k)), dx AS (SELECT d.*, center_x, confidence FROM dn d LEFT JOIN fr f ON f.clip_id = d.clip_id AND f.frame = d.frame)
SELECT clip_id, start_frame, position, frame, """ + ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY clip_id, start_frame ORDER BY frame ROWS UNBOUNDED PRECEDING), first_value({c} IGNORE NULLS) OVER (PARTITION BY clip_id, start_frame ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS {c}" for c in ("center_x", "confidence")) + " FROM dx")
def _(s, d):
    rows = fx.frames(s, d).select("clip_id", "frame").join(fx.ball(s, d).select("clip_id", "frame", "center_x", "confidence"), ["clip_id", "frame"], "left")
    return motion.window_features(_windows(s, d), rows, ["center_x", "confidence"])


@query("missing_masks", """SELECT f.clip_id, f.frame, "timestamp", coalesce(center_x, 0) AS center_x, (center_x IS NULL)::INT::DOUBLE AS center_x_missing_mask FROM frames f LEFT JOIN (SELECT clip_id, frame, center_x FROM ball) b ON f.clip_id = b.clip_id AND f.frame = b.frame""")
def _(s, d):
    rows = fx.frames(s, d).select("clip_id", "frame", "timestamp").join(fx.ball(s, d).select("clip_id", "frame", "center_x"), ["clip_id", "frame"], "left")
    return windows.missing_masks(rows, ["center_x", "timestamp"])


_WEAK_WINDOWS = """, edge AS (SELECT clip_id, min(frame) AS min_frame, max(frame) AS max_frame FROM frames GROUP BY clip_id),
ev AS (SELECT clip_id, event_id::VARCHAR AS candidate_id, label AS target_class, start_frame AS es, end_frame AS ee, round_even((start_frame + end_frame) / 20, 0)::BIGINT * 10 AS center_frame, 'made_up' AS source_event_type, (event_id % 2)::INT AS is_eligible_for_weak_label, list_position(['background','carry','pass','turnover','shot'], label) AS pr FROM intervals WHERE label <> 'uncertain' AND event_id % 8 < 3 AND event_id % 7 <> 0),
e1 AS (SELECT e.*, min_frame, max_frame, center_frame - 32 AS start_frame, center_frame + 31 AS end_frame, center_frame - 8 AS label_start_frame, center_frame + 7 AS label_end_frame FROM (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY clip_id, center_frame ORDER BY pr DESC, candidate_id) = 1) e JOIN edge b ON e.clip_id = b.clip_id),
e2 AS (SELECT *, greatest(start_frame, min_frame) AS valid_start_frame, least(end_frame, max_frame) AS valid_end_frame, greatest(min_frame - start_frame, 0) AS padding_before_frames, greatest(end_frame - max_frame, 0) AS padding_after_frames, greatest(valid_end_frame - valid_start_frame + 1, 0) AS observed_frames, padding_before_frames + padding_after_frames AS padding_frames FROM e1),
e3 AS (SELECT *, EXISTS (SELECT 1 FROM ev o WHERE o.clip_id = e2.clip_id AND o.candidate_id <> e2.candidate_id AND o.es <= e2.end_frame AND o.ee >= e2.start_frame)::INT AS context_contains_other_event FROM e2),
bg0 AS (SELECT clip_id, unnest(range(min_frame, max_frame - 62, 16)) AS start_frame FROM edge WHERE max_frame - min_frame + 1 >= 64),
bg1 AS (SELECT b.clip_id, b.start_frame, b.start_frame + 63 AS end_frame, b.start_frame + 24 AS label_start_frame, b.start_frame + 39 AS label_end_frame, coalesce(string_agg(candidate_id, ';' ORDER BY center_frame, -pr, candidate_id) FILTER (es <= b.start_frame + 39 AND ee >= b.start_frame + 24), '') AS central, coalesce(string_agg(candidate_id, ';' ORDER BY center_frame, -pr, candidate_id) FILTER (es <= b.start_frame + 43 AND ee >= b.start_frame + 20), '') AS near_, coalesce(string_agg(candidate_id, ';' ORDER BY center_frame, -pr, candidate_id) FILTER (es <= b.start_frame + 63 AND ee >= b.start_frame), '') AS context FROM bg0 b LEFT JOIN ev e ON e.clip_id = b.clip_id AND es <= b.start_frame + 63 AND ee >= b.start_frame GROUP BY 1, 2),
ww AS (SELECT clip_id, start_frame, end_frame, valid_start_frame, valid_end_frame, center_frame, label_start_frame, label_end_frame, observed_frames, padding_frames, padding_before_frames, padding_after_frames, context_contains_other_event, target_class, 'weak_unified_event_candidates' AS label_source, candidate_id, source_event_type, is_eligible_for_weak_label FROM e3 WHERE observed_frames + padding_frames = 64
 UNION ALL SELECT clip_id, start_frame, end_frame, start_frame, end_frame, start_frame + 32, label_start_frame, label_end_frame, 64, 0, 0, 0, (context <> '')::INT, 'background', 'weak_background_center_label_region', '', '', 1 FROM bg1 WHERE near_ = ''),
rj AS (SELECT clip_id, 'event' AS window_kind, valid_start_frame AS candidate_start_frame, valid_end_frame AS candidate_end_frame, 'insufficient_frames' AS reason, 'event window has ' || observed_frames || ' observed frames and ' || padding_frames || ' padding frames; requires 64' AS detail FROM e3 WHERE observed_frames + padding_frames <> 64
 UNION ALL SELECT clip_id, 'background', NULL, NULL, 'insufficient_frames', 'clip has ' || (max_frame - min_frame + 1) || ' frames; requires 64' FROM edge WHERE max_frame - min_frame + 1 < 64
 UNION ALL SELECT clip_id, 'background', label_start_frame, label_end_frame, CASE WHEN central <> '' THEN 'center_label_region_overlaps_event' ELSE 'center_label_region_too_close_to_event' END, CASE WHEN central <> '' THEN central ELSE near_ END FROM bg1 WHERE near_ <> ''
 UNION ALL SELECT clip_id, 'background', start_frame, end_frame, 'accepted_with_noncentral_context_event', context FROM bg1 WHERE near_ = '' AND context <> ''
 UNION ALL SELECT clip_id, 'background', NULL, NULL, 'no_valid_background_window', 'all stride-aligned background starts were rejected or unavailable' FROM edge e WHERE max_frame - min_frame + 1 >= 64 AND NOT EXISTS (SELECT 1 FROM bg1 b WHERE b.clip_id = e.clip_id AND near_ = ''))
"""


def _weak(s, d, stride=16):
    """Some of the labelled events as unified ones (every seventh a duplicate), their middles at round frames, so that some meet."""
    i = fx.intervals(s, d).where("event_id % 8 < 3")
    center = F.bround((F.col("start_frame") + F.col("end_frame")) / 20).cast("long") * 10
    events = i.select("clip_id", "event_id", F.col("label").alias("event_type"), F.when(F.col("event_id") % 7 == 0, 1).alias("duplicate_of"), "start_frame", "end_frame", center.alias("center_frame"), F.lit("made_up").alias("source_type"), (F.col("event_id") % 2).cast("int").alias("weak_eligible"))
    return windows.weak_event_windows(fx.frames(s, d), windows.weak_events(events), window=64, region=16, stride=stride, margin=4)


@query("weak_event_windows", _WEAK_WINDOWS + "SELECT *, round(100.0::DOUBLE * padding_frames / 64, 6) AS padding_percent FROM ww")
def _(s, d):
    return _weak(s, d)[0]


@query("weak_window_rejections", _WEAK_WINDOWS + "SELECT * FROM rj")
def _(s, d):
    return _weak(s, d)[1]


@query("gold_frame_windows", """, cl AS (SELECT clip_id, max(frame) + 1 AS frame_count FROM frames GROUP BY 1), fw AS (SELECT clip_id, unnest(range(0, frame_count - 63, 16)) AS start_frame FROM cl WHERE frame_count >= 64),
fl AS (SELECT w.clip_id, w.start_frame, label, event_id, CASE WHEN e.clip_id IS NOT NULL THEN least(e.end_frame, w.start_frame + 38) - greatest(e.start_frame, w.start_frame + 23) + 1 END AS o, list_position(['background','carry','pass','turnover','shot'], label) AS r FROM fw w LEFT JOIN intervals e ON w.clip_id = e.clip_id AND e.label <> 'uncertain' AND e.start_frame <= w.start_frame + 38 AND e.end_frame >= w.start_frame + 23)
SELECT clip_id, start_frame, start_frame + 63 AS end_frame, start_frame + 23 AS label_start_frame, start_frame + 38 AS label_end_frame, coalesce(label, 'background') AS target_class, event_id, coalesce(o, 0) AS event_overlap_frames, list_aggregate([round_even(start_frame + i * (63.0::DOUBLE / 15), 0)::BIGINT::VARCHAR FOR i IN range(16)], 'string_agg', ',') AS sample_frames FROM fl QUALIFY row_number() OVER (PARTITION BY clip_id, start_frame ORDER BY o DESC, r DESC, event_id) = 1""")
def _(s, d):
    clips = fx.frames(s, d).groupBy("clip_id").agg((F.max("frame") + 1).alias("frame_count"))
    return windows.frame_windows(clips, fx.intervals(s, d).where("label <> 'uncertain'"))


@query("clip_disjoint_split", None)
def _(s, d):
    return windows.clip_disjoint_split(_windows(s, d))


@query("split_overlaps", ", sp AS (SELECT clip_id, CASE WHEN clip_id % 3 = 0 THEN 'train' ELSE 'val' END AS split FROM frames UNION SELECT clip_id, 'test' FROM frames WHERE clip_id IN (0, 5)) SELECT clip_id, string_agg(split, ',' ORDER BY split) AS splits FROM sp GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    f = fx.frames(s, d).select("clip_id")
    sp = f.withColumn("split", F.when(F.col("clip_id") % 3 == 0, "train").otherwise("val")).union(f.where("clip_id in (0, 5)").withColumn("split", F.lit("test")))
    return windows.in_two_splits(sp)


@query("approved_events", """SELECT * EXCLUDE (s, e), least(s, e) AS start_frame, greatest(s, e) AS end_frame FROM (SELECT clip_id, event_id, label, CASE WHEN event_id % 2 = 0 THEN start_frame ELSE end_frame END AS s, CASE WHEN event_id % 2 = 0 THEN end_frame ELSE start_frame END AS e, ['Yes', ' true ', '1', 'no', ''][event_id % 5 + 1] AS approved FROM intervals) WHERE event_id % 5 < 3""")
def _(s, d):
    even = F.col("event_id") % 2 == 0
    i = fx.intervals(s, d).withColumns({"start_frame": F.when(even, F.col("start_frame")).otherwise(F.col("end_frame")), "end_frame": F.when(even, F.col("end_frame")).otherwise(F.col("start_frame")), "approved": F.element_at(F.array(*map(F.lit, ("Yes", " true ", "1", "no", ""))), (F.col("event_id") % 5 + 1).cast("int"))})
    return windows.approved(i)


@query("keep_best", "SELECT clip_id, frame, track_id, confidence FROM tracks QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY confidence DESC, track_id) = 1")
def _(s, d):
    return tables.keep_first(fx.tracks(s, d).select("clip_id", "frame", "track_id", "confidence"), ["clip_id", "frame"], F.desc("confidence"), "track_id")


@query("keep_first_and_last", "SELECT a.clip_id, a.track_id, a.frame AS first_frame, a.center_x AS first_x, b.frame AS last_frame, b.center_x AS last_x FROM (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) = 1) a JOIN (SELECT * FROM tracks QUALIFY row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame DESC) = 1) b ON a.clip_id = b.clip_id AND a.track_id = b.track_id")
def _(s, d):
    t, key = fx.tracks(s, d), ["clip_id", "track_id"]
    one = lambda k, *order: tables.keep_first(t, key, *order).select(*key, F.col("frame").alias(f"{k}_frame"), F.col("center_x").alias(f"{k}_x"))
    return one("first", "frame").join(one("last", F.desc("frame")), key)


@query("keep_by_precedence", "SELECT clip_id, end_frame, event_id, label FROM intervals QUALIFY row_number() OVER (PARTITION BY clip_id, end_frame ORDER BY coalesce(nullif(list_position(['shot','turnover','pass','carry'], label), 0), 5), event_id) = 1")
def _(s, d):
    return tables.keep_by_precedence(fx.intervals(s, d).select("clip_id", "end_frame", "event_id", "label"), ["clip_id", "end_frame"], "label", ["shot", "turnover", "pass", "carry"], "event_id")


@query("nearest_ball", """SELECT e.clip_id, e.event_id, e.end_frame AS frame, b.frame AS nearest_frame, b.center_x AS nearest_center_x FROM intervals e JOIN ball b ON e.clip_id = b.clip_id QUALIFY row_number() OVER (PARTITION BY e.clip_id, e.event_id ORDER BY abs(b.frame - e.end_frame), b.frame) = 1""")
def _(s, d):
    return tables.nearest_row(fx.intervals(s, d).select("clip_id", "event_id", F.col("end_frame").alias("frame")), fx.ball(s, d), "center_x")


@query("boxes", "SELECT clip_id, frame, track_id, center_x - 20 AS x1, center_y - height / 2 AS y1, center_x + 20 AS x2, center_y + height / 2 AS y2, center_x, center_y, 40::DOUBLE AS width, height, 40 * height AS area FROM tracks")
def _(s, d):
    t = fx.tracks(s, d).select("clip_id", "frame", "track_id", (F.col("center_x") - 20).alias("x1"), (F.col("center_y") - F.col("height") / 2).alias("y1"), (F.col("center_x") + 20).alias("x2"), (F.col("center_y") + F.col("height") / 2).alias("y2"))
    return tables.with_box(t)


@query("distribution", " UNION ALL ".join(f"SELECT clip_id, '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, " + ", ".join(f"round(quantile_cont({c}, {q}::DOUBLE), 6) AS {k}" for k, q in (("min", 0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("max", 1))) + " FROM tracks GROUP BY 1" for c in ("center_x", "confidence")))
def _(s, d):
    return rounded(tables.distribution(fx.tracks(s, d), ["clip_id"], ["center_x", "confidence"]))


_MAD = """, mid AS (SELECT clip_id, median(center_x) AS m, stddev_pop(center_x) AS sd FROM tracks GROUP BY 1), mad AS (SELECT t.clip_id, any_value(m) AS m, any_value(sd) AS sd, median(abs(center_x - m)) AS d FROM tracks t JOIN mid ON t.clip_id = mid.clip_id GROUP BY 1)
"""


@query("robust_scaled", _MAD + "SELECT t.clip_id, frame, track_id, round((center_x - m) / CASE WHEN 1.4826::DOUBLE * d >= 1e-6 THEN 1.4826::DOUBLE * d WHEN sd >= 1e-6 THEN sd ELSE 1 END, 6) AS center_x FROM tracks t JOIN mad ON t.clip_id = mad.clip_id")
def _(s, d):
    return rounded(tables.robust_scaled(fx.tracks(s, d).select("clip_id", "frame", "track_id", "center_x"), ["clip_id"], ["center_x"]))


@query("inliers", _MAD + "SELECT t.clip_id, frame, track_id, center_x, center_x <= m + greatest(1.15::DOUBLE, 1.5::DOUBLE * d) AS inlier FROM tracks t JOIN mad ON t.clip_id = mad.clip_id")
def _(s, d):
    return tables.inliers(fx.tracks(s, d).select("clip_id", "frame", "track_id", "center_x"), ["clip_id"], "center_x", 1.15, 1.5)


@query("renumbered_tracks", "SELECT t.clip_id, t.track_id, frame, label FROM tracks t JOIN (SELECT clip_id, track_id, row_number() OVER (PARTITION BY clip_id ORDER BY min(frame), track_id) AS label FROM tracks GROUP BY 1, 2) n ON t.clip_id = n.clip_id AND t.track_id = n.track_id")
def _(s, d):
    return tables.renumbered(fx.tracks(s, d).select("clip_id", "track_id", "frame"))


_FLP = """, many AS (SELECT clip_id, frame, "timestamp", team, player_id, distance_to_ball FROM owners UNION ALL SELECT clip_id, frame, "timestamp" + 0.01::DOUBLE, 'Team B', 7, (frame % 40)::DOUBLE FROM frames WHERE frame % 3 = 0 UNION ALL SELECT clip_id, frame, "timestamp" + 0.02::DOUBLE, 'Team A', 2, NULL FROM frames WHERE frame % 5 = 0)
"""


@query("frame_level_possession", _FLP + """SELECT clip_id, frame, round("timestamp", 6) AS "timestamp", CASE WHEN active THEN team ELSE 'None' END AS team, CASE WHEN active THEN player_id END AS player_id FROM (SELECT *, team IN ('Team A', 'Team B') AND player_id IS NOT NULL AS active FROM many) QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY active DESC, CASE WHEN active THEN distance_to_ball END NULLS LAST, "timestamp", team, player_id) = 1""")
def _(s, d):
    o, f = fx.owners(s, d).select("clip_id", "frame", "timestamp", "team", "player_id", "distance_to_ball"), fx.frames(s, d)
    more = lambda n, dt, team, p, x: f.where(F.col("frame") % n == 0).select("clip_id", "frame", (F.col("timestamp") + dt).alias("timestamp"), F.lit(team).alias("team"), F.lit(p).cast("long").alias("player_id"), x.cast("double").alias("distance_to_ball"))
    return rounded(segments.frame_possession(o.unionByName(more(3, 0.01, "Team B", 7, F.col("frame") % 40)).unionByName(more(5, 0.02, "Team A", 2, F.lit(None)))))


@query("duration_buckets", "SELECT clip_id, CASE WHEN x < 300 THEN 'short' WHEN x < 1800 THEN 'medium' WHEN x IS NOT NULL THEN 'long' ELSE 'unknown_duration' END AS bucket, count(*) AS n FROM (SELECT clip_id, CASE WHEN event_id % 7 > 0 THEN (event_id * 97 % 4000)::DOUBLE END AS x FROM intervals) GROUP BY 1, 2")
def _(s, d):
    x = F.when(F.col("event_id") % 7 > 0, (F.col("event_id") * 97 % 4000).cast("double"))
    return fx.intervals(s, d).groupBy("clip_id", tables.duration_bucket(x).alias("bucket")).agg(F.count("*").alias("n"))
