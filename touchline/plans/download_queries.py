"""Queries of download plans and samples, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import downloads
from ..sources import fixtures as fx
from .catalog import query

TARGET = 40


def _inventory(s, d):
    """Labelled events as if they were files: some are there already under a clip's name, some nothing identifies."""
    n, c = F.col("event_id"), F.col("clip_id")
    named = n % 9 != 4
    path = F.when(n % 7 == 3, F.format_string('"Clips\\\\//Clip%d/"', c)).otherwise(F.format_string("Games/%d/part%d/H%d_%d.mkv", n % 5, c, n % 2 + 1, n))
    return fx.intervals(s, d).select(
        (n * 10 + c).alias("row"), F.when(named & (n % 4 != 1), path).alias("video_path"), F.when(named & (n % 4 == 1), F.format_string("x/clip%d", n % 20)).alias("filename"), F.when(n % 3 == 0, "readable").otherwise("missing").alias("readable_status"),
        F.when(n % 5 == 0, "ready_for_video_pilot").alias("pilot_status"), F.when(n % 2 == 0, "nearby: a.json").alias("annotation_paths"), F.when(n % 11 == 0, "t.pkl").otherwise("").alias("tracking_files"),
        F.when(n % 6 == 1, "unknown").when(n % 6 > 1, (n * 97 % 4000).cast("string")).alias("duration_seconds"),
    )


def _local(s, d):
    return fx.frames(s, d).select(F.concat(F.lit("clip"), F.col("clip_id").cast("string")).alias("clip_id")).distinct().where("clip_id <> 'clip5'")


_PLAN = r""", iv AS (SELECT event_id * 10 + clip_id AS row, CASE WHEN event_id % 9 <> 4 AND event_id % 4 <> 1 THEN CASE WHEN event_id % 7 = 3 THEN '"Clips\//Clip' || clip_id || '/"' ELSE 'Games/' || event_id % 5 || '/part' || clip_id || '/H' || event_id % 2 + 1 || '_' || event_id || '.mkv' END END AS video_path, CASE WHEN event_id % 9 <> 4 AND event_id % 4 = 1 THEN 'x/clip' || event_id % 20 END AS filename,
 event_id % 7 = 3 AS other, event_id, clip_id, CASE WHEN event_id % 3 = 0 THEN 'readable' ELSE 'missing' END AS readable_status, CASE WHEN event_id % 5 = 0 THEN 'ready_for_video_pilot' END AS pilot_status, CASE WHEN event_id % 2 = 0 THEN 'nearby: a.json' END AS annotation_paths, CASE WHEN event_id % 11 = 0 THEN 't.pkl' ELSE '' END AS tracking_files, CASE WHEN event_id % 6 = 1 THEN 'unknown' WHEN event_id % 6 > 1 THEN (event_id * 97 % 4000)::VARCHAR END AS duration_seconds FROM intervals),
norm AS (SELECT *, CASE WHEN video_path IS NULL THEN NULL WHEN other THEN 'clips/clip' || clip_id ELSE lower(video_path) END AS nv, filename AS nf FROM iv),
loc AS (SELECT DISTINCT 'clip' || clip_id AS id FROM frames WHERE clip_id <> 5),
dup AS (SELECT norm.*, coalesce((SELECT id FROM loc WHERE id = split_part(nv, '/', -1)), (SELECT id FROM loc WHERE id = split_part(nf, '/', -1))) AS matching FROM norm),
des AS (SELECT *, CASE WHEN nv IS NOT NULL THEN regexp_replace(nv, '/[^/]*$', '') WHEN annotation_paths IS NOT NULL THEN 'nearby: a.json' WHEN nf IS NOT NULL THEN 'x' WHEN tracking_files <> '' THEN 't.pkl' ELSE 'unknown_parent' END AS grp0,
 CASE WHEN duration_seconds IS NULL THEN 'unknown_duration' WHEN duration_seconds = 'unknown' THEN 'unknown' WHEN duration_seconds::DOUBLE < 300 THEN 'short' WHEN duration_seconds::DOUBLE < 1800 THEN 'medium' ELSE 'long' END AS bucket,
 CASE WHEN nv IS NOT NULL AND contains(nv, 'h1') THEN 'h1' WHEN nv IS NOT NULL AND contains(nv, 'h2') THEN 'h2' ELSE 'unknown_half' END AS half,
 CASE WHEN readable_status = 'readable' THEN 100 ELSE 0 END + CASE WHEN pilot_status IS NOT NULL OR readable_status = 'readable' THEN 50 ELSE 0 END + CASE WHEN annotation_paths IS NOT NULL THEN 20 ELSE 0 END + CASE WHEN tracking_files <> '' THEN 10 ELSE 0 END AS score,
 concat_ws(';', CASE WHEN readable_status = 'readable' THEN 'readable_video' END, CASE WHEN pilot_status IS NOT NULL OR readable_status = 'readable' THEN 'ready_for_video_pilot' END, CASE WHEN annotation_paths IS NOT NULL THEN 'nearby_annotation_files' END, CASE WHEN tracking_files <> '' THEN 'tracking_files_available' END) AS why0,
 CASE WHEN matching IS NOT NULL THEN 'exclude_exact_duplicate' WHEN nv IS NOT NULL OR nf IS NOT NULL OR annotation_paths IS NOT NULL OR tracking_files <> '' THEN 'candidate_for_new_download' ELSE 'manual_review_required' END AS rec FROM dup),
tn AS (SELECT *, row_number() OVER (PARTITION BY grp0 || '|' || bucket || '|' || half ORDER BY score DESC, coalesce(nv, nf, annotation_paths, tracking_files), row) AS turn FROM des WHERE rec = 'candidate_for_new_download'),
sel AS (SELECT row, row_number() OVER (ORDER BY turn, grp0 || '|' || bucket || '|' || half) AS rank FROM tn QUALIFY rank <= 40),
plan AS (SELECT des.*, sel.rank FROM des LEFT JOIN sel ON sel.row = des.row)
"""


def _plan(s, d):
    return downloads.download_plan(_inventory(s, d), _local(s, d), "row", TARGET)


@query("download_plan", _PLAN + "SELECT row, grp0 AS parent_group, bucket AS duration_bucket, half, score::INT AS priority_score, (matching IS NOT NULL)::INT AS is_exact_local_duplicate, matching AS matching_local_clip_id, rec AS download_recommendation, rank AS selection_rank, CASE WHEN rank IS NOT NULL THEN concat_ws(';', nullif(why0, ''), 'parent_group=' || grp0, 'duration_bucket=' || bucket, 'half=' || half) END AS selection_reason FROM plan")
def _(s, d):
    return _plan(s, d).select("row", "parent_group", "duration_bucket", "half", "priority_score", "is_exact_local_duplicate", "matching_local_clip_id", "download_recommendation", "selection_rank", "selection_reason")


@query("download_plan_summary", _PLAN + "SELECT count(*) AS candidates_considered, count(*) FILTER (rec = 'exclude_exact_duplicate') AS exact_duplicates_excluded, count(*) FILTER (rec = 'manual_review_required') AS manual_review_candidates, count(rank) AS new_download_candidates_selected, 40 AS requested_target FROM plan")
def _(s, d):
    return downloads.plan_summary(_plan(s, d), TARGET)


@query("manifest_of_sample", """SELECT 'league__2020_2021__game_' || event_id || '__h' || clip_id % 2 + 1 || '_720p' AS clip_id, 'valid' AS split, 'league' AS competition, 'league/2020-2021/game ' || event_id AS game_id, (clip_id % 2 + 1)::INT AS half, 'v/' || event_id || '/' || clip_id AS video_path, true AS enabled, 'local_manifest' AS notes FROM intervals WHERE label <> 'shot' AND clip_id < 2 ORDER BY (event_id * 40503 + clip_id * 7 + 42) % 10007, 1 LIMIT 15""")
def _(s, d):
    """Fifteen halves of the games of one league."""
    n, c = F.col("event_id"), F.col("clip_id")
    v = fx.intervals(s, d).where("clip_id < 2").select(F.concat(F.when(F.col("label") == "shot", "cup").otherwise("league"), F.lit("/2020-2021/game "), n.cast("string")).alias("game_id"), (c % 2 + 1).cast("int").alias("half"), F.concat_ws("/", F.lit("v"), n.cast("string"), c.cast("string")).alias("video_path"), ((n * 40503 + c * 7 + 42) % 10007).alias("key"))
    return downloads.manifest_of(v, 15, "720p", "league/", order=F.col("key"))
