"""Queries about data sets, readiness, runs and predictions, and the same in SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import datasets, frame_table, pictures, possession
from ..sources import fixtures as fx
from .catalog import _HOP, _NEAR, _possession, _windows, query, rounded
from .window_queries import _WEAK_WINDOWS, _weak

_LIST = "['background', 'carry', 'pass', 'turnover', 'shot']"
_SEL = _HOP + """, sw AS (SELECT win.*, CASE WHEN clip_id < 5 THEN 'train' WHEN clip_id = 5 THEN 'val' ELSE 'test' END AS split, ((start_frame / 8 + clip_id) % 3 <> 0 AND clip_id <> 2)::INT AS selected_after_balancing FROM win)"""


def _selected(s, d):
    n = F.col("clip_id")
    return _windows(s, d).withColumns({"split": F.when(n < 5, "train").when(n == 5, "val").otherwise("test"), "selected_after_balancing": (((F.col("start_frame") / 8 + n) % 3 != 0) & (n != 2)).cast("int")})


@query("dataset_class_counts", _SEL + f""", ph AS (SELECT 'before_balancing' AS phase, * FROM sw UNION ALL SELECT 'after_balancing', * FROM sw WHERE selected_after_balancing = 1)
SELECT p.phase, s.split, c.target_class, (SELECT count(*) FROM ph WHERE ph.phase = p.phase AND ph.target_class = c.target_class AND (s.split = 'all' OR ph.split = s.split)) AS window_count FROM (SELECT unnest(['before_balancing', 'after_balancing']) AS phase) p, (SELECT unnest(['all', 'train', 'val', 'test']) AS split) s, (SELECT unnest({_LIST}) AS target_class) c""")
def _(s, d):
    return datasets.class_counts(_selected(s, d))


_EACH = ", ".join(f"count(*) FILTER (target_class = '{c}' AND keep) AS {c}_windows" for c in datasets.CLASSES)


@query("dataset_clip_classes", _SEL + f""", ph AS (SELECT 'before_balancing' AS phase, true AS keep, * FROM sw UNION ALL SELECT 'after_balancing', selected_after_balancing = 1, * FROM sw)
SELECT clip_id, phase, {_EACH}, count(*) FILTER (keep) AS total_windows, coalesce(list_aggregate(list_filter({_LIST}, lambda c: list_contains(list(target_class) FILTER (keep), c)), 'string_agg', ','), '') AS classes_present FROM ph GROUP BY 1, 2""")
def _(s, d):
    return datasets.clip_class_counts(_selected(s, d))


@query("clip_frame_summary", """, fc AS (SELECT clip_id, max(frame) - min(frame) + 1 AS frame_count, max("timestamp") - min("timestamp") AS seconds FROM frames GROUP BY 1) SELECT 'frame_count' AS "column", round(min(frame_count), 6)::DOUBLE AS min, round(median(frame_count), 6) AS median, round(max(frame_count), 6)::DOUBLE AS max FROM fc UNION ALL SELECT 'seconds', round(min(seconds), 6), round(median(seconds), 6), round(max(seconds), 6) FROM fc""")
def _(s, d):
    g = fx.frames(s, d).groupBy("clip_id").agg((F.max("frame") - F.min("frame") + 1).alias("frame_count"), (F.max("timestamp") - F.min("timestamp")).alias("seconds"))
    return datasets.numeric_summary(g, "frame_count", "seconds")


@query("feature_columns", """SELECT unnest(['clip_id', 'frame', 'timestamp', 'owner_id', 'event_type', 'ball_x', 'distance_to_ball', 'never', 'team', 'is_interpolated', 'text_number', 'quality_flag']) AS "column", unnest([false, false, false, false, false, true, true, false, false, true, true, false]) AS is_feature, unnest(['identifier', 'identifier', 'identifier', 'identifier', 'leakage', 'numeric', 'numeric', 'no numeric value', 'no numeric value', 'numeric', 'numeric', 'leakage']) AS reason FROM (SELECT count(*) AS n FROM owners) WHERE n > 0""")
def _(s, d):
    o = fx.owners(s, d).select("clip_id", "frame", "timestamp", F.col("player_id").alias("owner_id"), F.lit("x").alias("event_type"), "ball_x", "distance_to_ball", F.lit(None).cast("double").alias("never"), "team", "is_interpolated", F.when(F.col("frame") % 5 == 0, F.col("frame").cast("string")).otherwise("none").alias("text_number"), F.lit(1).alias("quality_flag"))
    return datasets.feature_columns(o)


_KIND = "CASE track_id % 4 WHEN 0 THEN ' Person' WHEN 1 THEN 'player' WHEN 2 THEN 'ball' END"


def _classed(s, d):
    n = F.col("track_id") % 4
    return fx.tracks(s, d).withColumn("class_name", F.when(n == 0, " Person").when(n == 1, "player").when(n == 2, "ball"))


@query("people_only", f"SELECT clip_id, frame, track_id, {_KIND} AS class_name FROM tracks WHERE track_id % 4 < 2")
def _(s, d):
    return datasets.of_class(_classed(s, d)).select("clip_id", "frame", "track_id", "class_name")


@query("classes_found", f"SELECT trim({_KIND}) AS class_name, count(*) AS \"rows\", lower(trim({_KIND})) IN ('person', 'player') AS included FROM tracks WHERE track_id % 4 < 3 GROUP BY 1, 3")
def _(s, d):
    return datasets.classes_found(_classed(s, d))


_NEEDED = ("clip", "tracks", "teams")


@query("annotation_readiness", """, cl AS (SELECT DISTINCT clip_id FROM frames), b0 AS (SELECT clip_id, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM frames WHERE clip_id NOT IN (3, 5) GROUP BY 1),
st AS (SELECT cl.clip_id, f0, f1, n, CASE cl.clip_id WHEN 0 THEN 'source_manifest_validation' WHEN 1 THEN 'source_video' WHEN 2 THEN 'teams' END AS lack, CASE cl.clip_id WHEN 0 THEN 'duplicate clip_id' WHEN 1 THEN 'source video missing' END AS error, CASE WHEN cl.clip_id <> 4 THEN 25.0::DOUBLE ELSE 0 END AS fps, CASE WHEN cl.clip_id = 6 THEN n + 100 ELSE coalesce(n, 0) END AS vn FROM cl LEFT JOIN b0 ON b0.clip_id = cl.clip_id),
s1 AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'blocked' WHEN lack IS NOT NULL THEN 'needs_original_pipeline' WHEN n IS NULL THEN 'needs_temporal_sweep' ELSE 'ready_for_cvat' END AS status, f0 NOT IN (0, 1) AS late, vn > 0 AND n > 0 AND abs(vn - n) > greatest(2, fps) AS apart, fps <= 0 AS slow, clip_id = 7 AS long_ FROM st),
s2 AS (SELECT *, CASE WHEN clip_id = 1 THEN 'blocked' WHEN n IS NULL THEN 'missing_temporal_frames' WHEN late OR apart THEN 'frame_count_mismatch' WHEN slow THEN 'fps_mismatch' WHEN long_ THEN 'duration_mismatch' ELSE 'aligned' END AS alignment_status, CASE WHEN clip_id = 1 THEN 'missing clip' WHEN n IS NULL THEN 'missing temporal_frames.csv' ELSE concat_ws('; ', CASE WHEN long_ THEN 'expected about 30.000s' END, CASE WHEN slow THEN 'fps unavailable' END, CASE WHEN late THEN 'temporal frames do not start at 0 or 1' END, CASE WHEN apart THEN 'temporal frame count differs from video frame count' END) END AS notes FROM s1),
s3 AS (SELECT *, CASE WHEN status = 'ready_for_cvat' AND alignment_status = 'aligned' THEN 'ready_for_cvat' WHEN status IN ('needs_original_pipeline', 'needs_temporal_sweep') THEN 'planned' ELSE 'blocked' END AS annotation_status FROM s2)
SELECT clip_id, status, concat_ws(';', CASE WHEN clip_id = 1 THEN 'clip' END, lack, CASE WHEN n IS NULL THEN 'temporal_frames' END) AS missing_artifacts, error, f0 AS temporal_first_frame, f1 AS temporal_last_frame, n AS temporal_frame_count, alignment_status, notes AS alignment_notes, annotation_status, CASE WHEN annotation_status <> 'ready_for_cvat' THEN coalesce(error, lack, nullif(notes, ''), status) END AS blocked_reason FROM s3""")
def _(s, d):
    """Clip 0 stands twice in its manifest, 1 has no video, 2 no teams, 3 and 5 no frame table, 4 no rate, 6 too many frames, 7 the wrong length."""
    n = F.col("clip_id")
    f = fx.frames(s, d)
    clips = f.select("clip_id").distinct().withColumns({"source_exists": n != 1, "source_error": F.when(n == 0, "duplicate clip_id")})
    have = clips.select("clip_id", F.explode(F.array(*map(F.lit, _NEEDED))).alias("artefact")).where("not (clip_id = 1 and artefact = 'clip') and not (clip_id = 2 and artefact = 'teams')")
    frames = f.where("clip_id not in (3, 5)")
    count = frames.groupBy("clip_id").agg(F.count("*").alias("frame_count"))
    videos = clips.where("clip_id <> 1").select("clip_id").join(count, "clip_id", "left").select("clip_id", F.when(n == 7, 20.0).otherwise(30.5).alias("duration"), F.when(n != 4, 25.0).otherwise(0.0).alias("fps"), F.when(n == 6, F.col("frame_count") + 100).otherwise(F.coalesce("frame_count", F.lit(0))).alias("frame_count"), F.lit(None).cast("string").alias("video_error"))
    return datasets.annotation_readiness(clips, have, videos, frames, _NEEDED)


@query("upload_inventory", """, up AS (SELECT clip_id, CASE WHEN clip_id IN (2, 3) THEN 'same.mp4' ELSE clip_id || '.mp4' END AS video_filename, 'clips/' || clip_id AS source_clip_path, clip_id <> 4 AS source_exists, clip_id IN (6, 7) AS upload_copy_exists, CASE WHEN clip_id = 0 THEN 'not_ready_for_cvat' WHEN clip_id IN (2, 3) THEN 'duplicate_destination' WHEN clip_id = 4 THEN 'missing_source_clip' WHEN clip_id IN (6, 7) THEN 'already_exists' ELSE 'ready' END AS status FROM (SELECT DISTINCT clip_id FROM frames))
SELECT *, CASE status WHEN 'duplicate_destination' THEN 'duplicate video_filename in manifest' WHEN 'missing_source_clip' THEN 'source_clip_path does not exist' ELSE '' END AS error FROM up""")
def _(s, d):
    n = F.col("clip_id")
    text = n.cast("string")
    clips = fx.frames(s, d).select("clip_id").distinct()
    rows = clips.select("clip_id", F.when(n.isin(2, 3), "same.mp4").otherwise(F.concat(text, F.lit(".mp4"))).alias("video_filename"), F.concat(F.lit("clips/"), text).alias("source_clip_path"), F.when(n == 0, "planned").otherwise("ready_for_cvat").alias("annotation_status"))
    files = rows.where("clip_id <> 4").select(F.col("source_clip_path").alias("path")).union(rows.where("clip_id in (6, 7)").select("video_filename"))
    return datasets.upload_inventory(rows, files)


_SUMMARIES = """, sa AS (SELECT 'counts' AS section, unnest(['frames', 'raw_detections', 'filtered_detections']) AS metric, unnest([count(DISTINCT (clip_id, frame)), count(*), count(*) FILTER (confidence >= 0.5)]) AS v FROM tracks),
sb AS (SELECT 'counts' AS section, unnest(['frames', 'raw_detections', 'players']) AS metric, unnest([count(DISTINCT (clip_id, frame)), count(*) FILTER (track_id < 7), count(DISTINCT track_id)]) AS v FROM tracks)
"""


def _summaries(s, d):
    t = fx.tracks(s, d).withColumn("at", F.struct("clip_id", "frame"))
    one = lambda **m: t.agg(*(c.alias(k) for k, c in m.items())).select(F.lit("counts").alias("section"), F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("string").alias("value")) for k in m))).alias("x")).select("section", "x.*")
    first = one(frames=F.countDistinct("at"), raw_detections=F.count("*"), filtered_detections=F.count_if(F.col("confidence") >= 0.5))
    return first, one(frames=F.countDistinct("at"), raw_detections=F.count_if(F.col("track_id") < 7), players=F.countDistinct("track_id"))


@query("model_comparison", _SUMMARIES + """SELECT coalesce(sa.section, sb.section) AS section, coalesce(sa.metric, sb.metric) AS metric, sa.v::VARCHAR AS "first", sb.v::VARCHAR AS "second", (sb.v - sa.v)::DOUBLE AS difference FROM sa FULL JOIN sb ON sa.metric = sb.metric""")
def _(s, d):
    return datasets.compared(*_summaries(s, d))


@query("detection_rates", _SUMMARIES + """SELECT f::DOUBLE AS frames, r::DOUBLE AS raw, q::DOUBLE AS filtered, round(r / f, 6) AS raw_per_frame, round(q / f, 6) AS filtered_per_frame FROM (SELECT max(v) FILTER (metric = 'frames') AS f, max(v) FILTER (metric = 'raw_detections') AS r, max(v) FILTER (metric = 'filtered_detections') AS q FROM sa)""")
def _(s, d):
    return rounded(datasets.detection_rates(_summaries(s, d)[0]))


_HISTORY = _SEL + """, hi AS (SELECT 'run' || clip_id AS run, event_id + 1 AS epoch, (event_id * 37 % 50) / 100.0::DOUBLE AS accuracy, (event_id * 53 % 20) / 40.0::DOUBLE AS macro_f1 FROM intervals), pc AS (SELECT 'run' || clip_id AS run, CASE WHEN clip_id % 2 = 0 THEN 'test' ELSE 'val' END AS split, label AS target_class, max((event_id * 7 % 30) / 30.0::DOUBLE) AS f1 FROM intervals GROUP BY 1, 2, 3),
be AS (SELECT run, count(*) AS epochs_run, arg_max({'e': epoch, 'a': accuracy, 'm': macro_f1}, macro_f1 * 1000000 - epoch) AS b, arg_max({'a': accuracy, 'm': macro_f1}, epoch) AS l FROM hi GROUP BY 1)
"""


def _history(s, d):
    n, c = F.col("event_id"), F.concat(F.lit("run"), F.col("clip_id").cast("string"))
    i = fx.intervals(s, d)
    history = i.select(c.alias("run"), (n + 1).alias("epoch"), (n * 37 % 50 / 100.0).alias("accuracy"), (n * 53 % 20 / 40.0).alias("macro_f1"))
    return history, i.groupBy(c.alias("run"), F.when(F.col("clip_id") % 2 == 0, "test").otherwise("val").alias("split"), F.col("label").alias("target_class")).agg(F.max(n * 7 % 30 / 30.0).alias("f1"))


@query("model_run_summary", _HISTORY + "SELECT be.run, epochs_run, b.e AS best_epoch, round(b.a, 6) AS best_accuracy, round(b.m, 6) AS best_macro_f1, round(l.a, 6) AS final_accuracy, round(l.m, 6) AS final_macro_f1, " + ", ".join(f"round(coalesce((SELECT f1 FROM pc WHERE pc.run = be.run AND split = 'test' AND target_class = '{c}'), 0), 6) AS {c}_f1" for c in datasets.CLASSES) + ", (SELECT count(*) FROM sw WHERE selected_after_balancing = 1) AS total_windows, " + ", ".join(f"(SELECT count(*) FROM sw WHERE selected_after_balancing = 1 AND split = '{s}') AS {s}_windows" for s in ("train", "val", "test")) + " FROM be")
def _(s, d):
    return rounded(datasets.run_summary(*_history(s, d), _selected(s, d)))


@query("prediction_rows", _SEL + f""", pr AS (SELECT *, [((start_frame * 7 + clip_id * k) % 11) / 11.0::DOUBLE FOR k IN [1, 2, 3, 4, 5]] AS p FROM sw WHERE selected_after_balancing = 1) SELECT clip_id, start_frame, end_frame, target_class, {_LIST}[list_position(p, list_max(p))] AS predicted_class, round(list_max(p), 6) AS predicted_probability FROM pr""")
def _(s, d):
    p = F.array(*(((F.col("start_frame") * 7 + F.col("clip_id") * k) % 11) / 11.0 for k in (1, 2, 3, 4, 5)))
    return datasets.predictions(datasets.selected(_selected(s, d)).select("clip_id", "start_frame", "end_frame", "target_class", p.alias("probabilities")))


@query("fetch_plan", """, ft AS (SELECT event_id * 10 + clip_id AS id, CASE event_id % 6 WHEN 0 THEN '/abs/x.mkv' WHEN 1 THEN 'a/../x.mkv' WHEN 2 THEN 'alone.mkv' WHEN 3 THEN 'valid/2020/g' || clip_id || '/2_224p.mkv' WHEN 4 THEN 'lg\\2021\\g' || clip_id || '\\1_720p.mkv' END AS relative_video_path, CASE WHEN event_id % 4 = 0 THEN ' test ' ELSE '' END AS split FROM intervals)
SELECT id, relative_video_path, split, CASE id // 10 % 6 WHEN 3 THEN 'valid/2020/g' || id % 10 WHEN 4 THEN 'lg/2021/g' || id % 10 END AS game_id, CASE id // 10 % 6 WHEN 3 THEN '2_720p.mkv' WHEN 4 THEN '1_720p.mkv' END AS filename, CASE WHEN split <> '' THEN 'test' WHEN id // 10 % 6 = 3 THEN 'valid' ELSE '' END AS tracking_split, CASE WHEN id // 10 % 6 < 2 THEN 'relative_video_path must be a safe relative path: ' || relative_video_path WHEN id // 10 % 6 = 2 THEN 'relative_video_path must include game folders and filename: alone.mkv' WHEN relative_video_path IS NULL THEN 'relative_video_path must include game folders and filename: ' ELSE '' END AS error, CASE id // 10 % 6 WHEN 3 THEN '2020' WHEN 4 THEN '2021' ELSE '' END AS season FROM ft""")
def _(s, d):
    n, c = F.col("event_id"), F.col("clip_id").cast("string")
    k = n % 6
    path = F.when(k == 0, "/abs/x.mkv").when(k == 1, "a/../x.mkv").when(k == 2, "alone.mkv").when(k == 3, F.concat(F.lit("valid/2020/g"), c, F.lit("/2_224p.mkv"))).when(k == 4, F.concat(F.lit("lg\\2021\\g"), c, F.lit("\\1_720p.mkv")))
    rows = fx.intervals(s, d).select((n * 10 + F.col("clip_id")).alias("id"), path.alias("relative_video_path"), F.when(n % 4 == 0, " test ").otherwise("").alias("split"))
    return datasets.fetch_plan(rows).withColumn("season", F.coalesce(datasets.season(F.col("game_id")), F.lit("")))


_SLOTS = _NEAR + """, st AS (SELECT *, "timestamp" - lag("timestamp") OVER w AS dt, frame - lag(frame) OVER w AS df, center_x - lag(center_x) OVER w AS dx, center_y - lag(center_y) OVER w AS dy FROM tracks WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
sp AS (SELECT *, sqrt((dx / CASE WHEN dt > 0 THEN dt ELSE df END) ^ 2 + (dy / CASE WHEN dt > 0 THEN dt ELSE df END) ^ 2) AS speed, CASE WHEN track_id IN (4, 9) THEN 'Unknown' WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team FROM st),
rk AS (SELECT sp.*, sqrt((sp.center_x - b.center_x) ^ 2 + (sp.center_y - b.center_y) ^ 2) AS d, row_number() OVER (PARTITION BY sp.clip_id, sp.frame ORDER BY sqrt((sp.center_x - b.center_x) ^ 2 + (sp.center_y - b.center_y) ^ 2), track_id) AS r FROM sp JOIN ball b ON b.clip_id = sp.clip_id AND b.frame = sp.frame)
SELECT p.clip_id, p.frame, p.player_id, (SELECT count(*) FROM rk WHERE rk.clip_id = p.clip_id AND rk.frame = p.frame AND rk.team <> 'Unknown' AND rk.team <> p.team AND d <= 100) AS defenders_near_ball, round(rk.speed, 6) AS player_speed FROM poss p LEFT JOIN rk ON rk.clip_id = p.clip_id AND rk.frame = p.frame AND rk.track_id = p.player_id AND r <= 4 WHERE p.player_id IS NOT NULL"""


@query("slot_speed", _SLOTS)
def _(s, d):
    """The possessor's speed by the slots of the frame table."""
    frames = frame_table.temporal_frames(fx.tracks(s, d), fx.teams(s, d), fx.ball(s, d), _possession(s, d))
    asked = frames.where("possessor_track_id >= 0").select("clip_id", "frame", F.col("possessor_track_id").alias("player_id"))
    return rounded(datasets.slot_speed(asked, frames))


_SOURCES = """, sm AS (SELECT CASE WHEN clip_id = 1 THEN 0 ELSE clip_id END AS clip_id, CASE clip_id WHEN 2 THEN 3 ELSE 1 + clip_id % 2 END AS half, CASE clip_id WHEN 3 THEN 'lg/g3/x.mkv' WHEN 4 THEN 'lg/g4/2_720p.mkv' WHEN 5 THEN 'lg/other/2_720p.mkv' ELSE 'lg/g' || clip_id || '/' || 1 + clip_id % 2 || '_720p.mkv' END AS video_path, 'lg/g' || clip_id AS game_id, clip_id AS c FROM (SELECT DISTINCT clip_id FROM frames))
SELECT clip_id, CASE clip_id WHEN 0 THEN 'duplicate clip_id' WHEN 2 THEN 'half is not 1 or 2; half does not match source filename' WHEN 3 THEN 'source is not 1_720p.mkv or 2_720p.mkv' WHEN 4 THEN 'half does not match source filename' WHEN 5 THEN 'video_path does not contain game_id' WHEN 6 THEN 'source video missing' END AS source_error FROM sm WHERE clip_id < 7 GROUP BY 1"""


@query("source_errors", _SOURCES)
def _(s, d):
    n, c = F.col("c"), F.col("c").cast("string")
    m = fx.frames(s, d).select(F.col("clip_id").alias("c")).distinct()
    path = F.when(n == 3, "lg/g3/x.mkv").when(n == 4, "lg/g4/2_720p.mkv").when(n == 5, "lg/other/2_720p.mkv").otherwise(F.concat(F.lit("lg/g"), c, F.lit("/"), (1 + n % 2).cast("string"), F.lit("_720p.mkv")))
    m = m.select("c", F.when(n == 1, 0).otherwise(n).alias("clip_id"), F.when(n == 2, 3).otherwise(1 + n % 2).alias("half"), path.alias("video_path"), F.concat(F.lit("lg/g"), c).alias("game_id"))
    return datasets.source_errors(m.drop("c"), m.where("c <> 6").select(F.col("video_path").alias("path")))


@query("stage_counts", """, sg AS (SELECT clip_id, unnest(['tracks', 'ball']) AS stage, unnest([CASE WHEN clip_id % 3 = 0 THEN 'failed' ELSE 'ok' END, 'ok']) AS status FROM (SELECT DISTINCT clip_id FROM frames)) SELECT stage, status, count(*) AS clips FROM sg GROUP BY 1, 2""")
def _(s, d):
    clips = fx.frames(s, d).select("clip_id").distinct()
    return datasets.stage_counts(clips.select("clip_id", F.lit("tracks").alias("stage"), F.when(F.col("clip_id") % 3 == 0, "failed").otherwise("ok").alias("status")).union(clips.select("clip_id", F.lit("ball"), F.lit("ok"))))


@query("split_manifest", _SEL + " SELECT clip_id, split, count(*) AS windows, " + ", ".join(f"count(*) FILTER (target_class = '{c}') AS {c}_windows" for c in datasets.CLASSES) + " FROM sw GROUP BY 1, 2")
def _(s, d):
    return datasets.split_manifest(_selected(s, d))


def _stride_sql(n: int) -> str:
    """The windows and rejections of one stride, under names of their own."""
    sql, names = _WEAK_WINDOWS.replace("max_frame - 62, 16)", f"max_frame - 62, {n})"), ("edge", "ev", "e1", "e2", "e3", "bg0", "bg1", "ww", "rj")
    for k in names:
        sql = re.sub(rf"\b{k}\b(?!\.)", f"{k}_{n}", sql)
    return re.sub(r"\be2\.", f"e2_{n}.", sql)


_STRIDES = _stride_sql(8) + _stride_sql(24) + " SELECT stride, windows, " + ", ".join(f"{c}_windows" for c in datasets.CLASSES) + ", clips_with_background, rejected_overlap, rejected_margin, accepted_with_context FROM (" + " UNION ALL ".join(f"SELECT {n} AS stride, count(*) AS windows, " + ", ".join(f"count(*) FILTER (target_class = '{c}') AS {c}_windows" for c in datasets.CLASSES) + f", count(DISTINCT clip_id) FILTER (target_class = 'background') AS clips_with_background, (SELECT count(*) FROM rj_{n} WHERE window_kind = 'background' AND reason = 'center_label_region_overlaps_event') AS rejected_overlap, (SELECT count(*) FROM rj_{n} WHERE window_kind = 'background' AND reason = 'center_label_region_too_close_to_event') AS rejected_margin, (SELECT count(*) FROM rj_{n} WHERE window_kind = 'background' AND reason = 'accepted_with_noncentral_context_event') AS accepted_with_context FROM ww_{n}" for n in (8, 24)) + ")"


@query("stride_statistics", _STRIDES)
def _(s, d):
    return datasets.stride_statistics(lambda n: _weak(s, d, n), [8, 24])


_REASON = "split_part(possession_reason, ';', 1)"
_REPORT = _NEAR + """, pg AS (SELECT clip_id, count(*)::DOUBLE AS n, count(*) FILTER (team = 'Team A') AS a, count(*) FILTER (team = 'Team B') AS b, count(*) FILTER (team = 'Unknown') AS u, count(*) FILTER (team = 'None') AS o, count(*) FILTER (is_interpolated) AS i, count(*) FILTER (possession_reason LIKE 'ball_confidence_below_threshold%') AS l, coalesce(avg(distance_to_ball) FILTER (team <> 'None'), 0) AS m, coalesce(max(distance_to_ball) FILTER (team <> 'None'), 0) AS x FROM poss GROUP BY 1)
SELECT clip_id, unnest(['counts', 'counts', 'counts', 'counts', 'counts', 'counts', 'counts', 'distances', 'distances', 'percentages', 'percentages', 'percentages', 'percentages']) AS section, unnest(['total_ball_frames', 'team_a_frames', 'team_b_frames', 'unknown_frames', 'frames_with_no_possession', 'interpolated_ball_rows', 'low_ball_confidence_rows', 'assigned_distance_avg', 'assigned_distance_max', 'team_a_possession_percent', 'team_b_possession_percent', 'unknown_possession_percent', 'no_possession_percent']) AS metric, round(unnest([n, a, b, u, o, i, l, m, x, 100 * a / n, 100 * b / n, 100 * u / n, 100 * o / n]), 6) AS "value" FROM pg
UNION ALL SELECT clip_id, 'reasons', """ + _REASON + ", count(*) FROM poss GROUP BY 1, 3"


@query("possession_report", _REPORT)
def _(s, d):
    return rounded(possession.possession_report(_possession(s, d)))


@query("frame_size", """SELECT clip_id, greatest(ceil(max(center_x))::BIGINT + 1, 1) AS width, greatest(ceil(max(center_y))::BIGINT + 1, 1) AS height FROM tracks GROUP BY 1""")
def _(s, d):
    return pictures.frame_size(fx.tracks(s, d))
