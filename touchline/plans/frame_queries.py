"""Queries of the frame table and of labels, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frame_table, labels
from ..sources import archives
from ..sources import fixtures as fx
from ..sources.files import saved, saved_path
from .catalog import _CARRY, _CHANGES, _NEAR, _possession, query, rounded
from .event_queries import _carries

_D = "sqrt(({a}.center_x - {b}.{x}) * ({a}.center_x - {b}.{x}) + ({a}.center_y - {b}.{y}) * ({a}.center_y - {b}.{y}))"


def _slot(i: int) -> str:
    return f""", coalesce(n{i}.track_id, -1) AS p{i}_track_id, round(n{i}.center_x, 6) AS p{i}_x, round(n{i}.center_y, 6) AS p{i}_y, coalesce(n{i}.team, 'Unknown') AS p{i}_team, round(n{i}.d, 6) AS p{i}_distance_to_ball, CASE WHEN n{i}.d IS NULL THEN 1 ELSE 0 END AS p{i}_missing, round(n{i}.vx, 6) AS p{i}_vx, round(n{i}.vy, 6) AS p{i}_vy, round(sqrt(n{i}.vx * n{i}.vx + n{i}.vy * n{i}.vy), 6) AS p{i}_speed, CASE WHEN n{i}.vx IS NOT NULL THEN 1 ELSE 0 END AS p{i}_velocity_valid"""


def _team(k: str) -> str:
    return f""", round({k}.cx, 6) AS team_{k}_centroid_x, round({k}.cy, 6) AS team_{k}_centroid_y, round({k}.width, 6) AS team_{k}_width, round({k}.depth, 6) AS team_{k}_depth, round({k}.spread, 6) AS team_{k}_spread, CASE WHEN {k}.n > 0 THEN 1 ELSE 0 END AS team_{k}_shape_valid"""


_TABLE = _NEAR + f""", pl AS (SELECT *, CASE WHEN track_id IN (4, 9) THEN 'Unknown' WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team, (center_x - lag(center_x) OVER w) / ("timestamp" - lag("timestamp") OVER w) AS vx, (center_y - lag(center_y) OVER w) / ("timestamp" - lag("timestamp") OVER w) AS vy FROM tracks WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
spine AS (SELECT clip_id, frame FROM tracks UNION SELECT clip_id, frame FROM ball UNION SELECT clip_id, frame FROM poss),
cen AS (SELECT clip_id, frame, team, count(*) AS n, avg(center_x) AS cx, avg(center_y) AS cy, max(center_x) - min(center_x) AS width, max(center_y) - min(center_y) AS depth, min("timestamp") AS t FROM pl GROUP BY clip_id, frame, team),
form AS (SELECT c.*, s.spread FROM cen c JOIN (SELECT p.clip_id, p.frame, p.team, avg({_D.format(a="p", b="c", x="cx", y="cy")}) AS spread FROM pl p JOIN cen c ON p.clip_id = c.clip_id AND p.frame = c.frame AND p.team = c.team GROUP BY 1, 2, 3) s ON c.clip_id = s.clip_id AND c.frame = s.frame AND c.team = s.team),
wide0 AS (SELECT s.clip_id, s.frame, coalesce(o."timestamp", b."timestamp", tt.t) AS "timestamp", b.center_x AS bx, b.center_y AS byy, b.confidence AS ball_confidence, b.is_interpolated::INT AS inter, o.team, o.player_id, o.distance_to_ball, o.possession_reason FROM spine s LEFT JOIN ball b ON s.clip_id = b.clip_id AND s.frame = b.frame LEFT JOIN poss o ON s.clip_id = o.clip_id AND s.frame = o.frame LEFT JOIN (SELECT clip_id, frame, min(t) AS t FROM cen GROUP BY 1, 2) tt ON s.clip_id = tt.clip_id AND s.frame = tt.frame),
wide1 AS (SELECT *, "timestamp" - lag("timestamp") OVER w AS dt, bx - lag(bx) OVER w AS dx, byy - lag(byy) OVER w AS dy FROM wide0 WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
wide2 AS (SELECT *, dx / dt AS vx, dy / dt AS vy FROM wide1),
wide AS (SELECT *, (vx - lag(vx) OVER w) / dt AS ax, (vy - lag(vy) OVER w) / dt AS ay FROM wide2 WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
nn AS (SELECT *, row_number() OVER (PARTITION BY clip_id, frame ORDER BY d, track_id) AS k FROM (SELECT p.*, {_D.format(a="p", b="b", x="center_x", y="center_y")} AS d FROM pl p JOIN ball b ON p.clip_id = b.clip_id AND p.frame = b.frame)),
ctx AS (SELECT w.clip_id, w.frame, min({_D.format(a="q", b="m", x="center_x", y="center_y")}) FILTER (q.track_id <> m.track_id AND q.team = w.team) AS mate, min({_D.format(a="q", b="m", x="center_x", y="center_y")}) FILTER (q.track_id <> m.track_id AND q.team <> w.team AND q.team <> 'Unknown') AS foe, count(*) FILTER (q.team <> w.team AND q.team <> 'Unknown' AND {_D.format(a="q", b="w", x="bx", y="byy")} <= 100) AS near_ball, any_value(w.bx) AS seen FROM wide w JOIN pl m ON w.clip_id = m.clip_id AND w.frame = m.frame AND w.player_id = m.track_id JOIN pl q ON w.clip_id = q.clip_id AND w.frame = q.frame WHERE w.team <> 'None' GROUP BY 1, 2)
""" + _CHANGES.format(table="wide") + """SELECT w.clip_id, w.frame, round(w."timestamp", 6) AS "timestamp", round(bx, 6) AS ball_x, round(byy, 6) AS ball_y, round(ball_confidence, 6) AS ball_confidence, coalesce(inter, 0) AS ball_is_interpolated, CASE WHEN bx IS NULL THEN 1 ELSE 0 END AS ball_missing,
round(w.vx, 6) AS ball_vx, round(w.vy, 6) AS ball_vy, round(sqrt(w.vx * w.vx + w.vy * w.vy), 6) AS ball_speed, round(ax, 6) AS ball_ax, round(ay, 6) AS ball_ay, round(sqrt(ax * ax + ay * ay), 6) AS ball_acceleration, CASE WHEN w.vx IS NOT NULL THEN 1 ELSE 0 END AS ball_velocity_valid, CASE WHEN ax IS NOT NULL THEN 1 ELSE 0 END AS ball_acceleration_valid,
coalesce(w.player_id, -1) AS possessor_track_id, coalesce(w.team, 'Unknown') AS possession_team, round(w.distance_to_ball, 6) AS distance_to_ball, coalesce(possession_reason, 'Unknown') AS possession_reason, CASE WHEN w.team IN ('Team A', 'Team B') THEN 0 ELSE 1 END AS possession_missing, possession_changed, frames_since_possession_change,
coalesce(a.n, 0) + coalesce(b.n, 0) + coalesce(u.n, 0) AS player_count, coalesce(a.n, 0) AS team_a_player_count, coalesce(b.n, 0) AS team_b_player_count, coalesce(u.n, 0) AS unknown_team_player_count, round(mate, 6) AS nearest_teammate_distance, round(foe, 6) AS nearest_opponent_distance, CASE WHEN seen IS NOT NULL THEN near_ball::INT END AS defenders_near_ball""" + "".join(map(_slot, (1, 2, 3, 4))) + _team("a") + _team("b") + """
FROM wide w JOIN changes ch ON w.clip_id = ch.clip_id AND w.frame = ch.frame LEFT JOIN ctx ON w.clip_id = ctx.clip_id AND w.frame = ctx.frame""" + "".join(f" LEFT JOIN nn n{i} ON w.clip_id = n{i}.clip_id AND w.frame = n{i}.frame AND n{i}.k = {i}" for i in (1, 2, 3, 4)) + "".join(f" LEFT JOIN form {k} ON w.clip_id = {k}.clip_id AND w.frame = {k}.frame AND {k}.team = '{t}'" for k, t in (("a", "Team A"), ("b", "Team B"), ("u", "Unknown")))


def _frames(s, d):
    return frame_table.temporal_frames(fx.tracks(s, d), fx.teams(s, d), fx.ball(s, d), _possession(s, d))


@query("temporal_frames", _TABLE)
def _(s, d):
    return rounded(_frames(s, d))


@query("missing_values", """SELECT unnest(['center_x', 'confidence', 'distance_to_ball']) AS "column", unnest([count(*) - count(b.center_x), count(*) - count(b.confidence), count(*) - count(distance_to_ball)]) AS missing FROM owners o LEFT JOIN ball b ON o.clip_id = b.clip_id AND o.frame = b.frame""")
def _(s, d):
    both = fx.owners(s, d).join(fx.ball(s, d).select("clip_id", "frame", "center_x", "confidence"), ["clip_id", "frame"], "left")
    return frame_table.missing_values(both.select("center_x", "confidence", "distance_to_ball"))


_LABELS = _CARRY + """, held AS (SELECT c.clip_id, c.carry_id, f.frame FROM carry c JOIN frames f ON c.clip_id = f.clip_id AND f.frame BETWEEN start_frame AND end_frame WHERE carry_quality_flag = 'ok'),
labels AS (SELECT f.clip_id, f.frame, "timestamp", CASE WHEN h.event_id IS NULL THEN 'background' ELSE 'carry' END AS label, (h.event_id IS NOT NULL)::INT AS label_id, CASE WHEN h.event_id IS NULL THEN 'default_background' ELSE 'carry_csv_ok' END AS label_source, 1.0::DOUBLE AS label_confidence, h.event_id, coalesce(covering, 0) AS covering FROM frames f LEFT JOIN (SELECT clip_id, frame, min(carry_id) AS event_id, count(*) AS covering FROM held GROUP BY 1, 2) h ON f.clip_id = h.clip_id AND f.frame = h.frame)
"""


@query("carry_labels", _LABELS + 'SELECT * REPLACE (round("timestamp", 6) AS "timestamp") FROM labels')
def _(s, d):
    return rounded(labels.carry_labels(fx.frames(s, d), _carries(s, d)))


@query("carry_label_summary", _LABELS + """SELECT f.*, coalesce(accepted, 0) AS accepted, coalesce(ignored, 0) AS ignored_low_quality, coalesce(zero_overlap, 0) AS zero_overlap FROM (SELECT clip_id, count(*) AS frames, sum(label_id)::BIGINT AS carry_frames, sum(greatest(covering - 1, 0))::BIGINT AS duplicate_label_frames FROM labels GROUP BY 1) f
LEFT JOIN (SELECT clip_id, count(*) FILTER (carry_quality_flag = 'ok') AS accepted, count(*) FILTER (carry_quality_flag <> 'ok') AS ignored, count(*) FILTER (carry_quality_flag = 'ok' AND NOT EXISTS (SELECT 1 FROM held h WHERE h.clip_id = c.clip_id AND h.carry_id = c.carry_id)) AS zero_overlap FROM carry c GROUP BY 1) c ON f.clip_id = c.clip_id""")
def _(s, d):
    carries = _carries(s, d)
    return labels.carry_label_summary(labels.carry_labels(fx.frames(s, d), carries), carries)


def _boxes(s, d):
    """Each labelled event as an annotated track, outside in each 17th frame; every fifth one twice, and one label that isn't known."""
    i = fx.intervals(s, d).withColumn("label", F.when(F.col("event_id") % 11 == 0, "noise").otherwise(F.col("label")))
    return i.select("clip_id", F.explode(F.expr("CASE WHEN event_id % 5 = 0 THEN array(event_id, event_id + 1000000) ELSE array(event_id) END")).alias("track_no"), "label", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).withColumn("outside", F.col("frame") % 17 == 0)


_EVENTS = """, boxes AS (SELECT clip_id, unnest(CASE WHEN event_id % 5 = 0 THEN [event_id, event_id + 1000000] ELSE [event_id] END) AS track_no, label, s AS frame FROM (SELECT *, unnest(range(start_frame, end_frame + 1)) AS s FROM intervals WHERE event_id % 11 <> 0) WHERE s % 17 <> 0),
once AS (SELECT clip_id, label, start_frame, end_frame, min(track_no) AS track_no, count(*) - 1 AS duplicates FROM (SELECT clip_id, track_no, label, min(frame) AS start_frame, max(frame) AS end_frame FROM (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, track_no, label ORDER BY frame) AS run FROM boxes) GROUP BY clip_id, track_no, label, run) GROUP BY 1, 2, 3, 4),
e AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY track_no, start_frame, label) AS n FROM once)"""
_INTERVALS = _EVENTS + """
SELECT clip_id, printf('%d__event_%04d', clip_id, n) AS event_id, label AS event_type, start_frame, end_frame, round(start_frame / 25.0::DOUBLE, 6) AS start_seconds, round(end_frame / 25.0::DOUBLE, 6) AS end_seconds, label = 'uncertain' AS uncertain, duplicates, (SELECT count(*) FROM e b WHERE b.clip_id = a.clip_id AND b.n < a.n AND b.start_frame <= a.end_frame AND b.end_frame >= a.start_frame) AS overlaps FROM e a"""


@query("annotated_intervals", _INTERVALS)
def _(s, d):
    return rounded(labels.interval_events(saved(labels.numbered_intervals(_boxes(s, d)))))


def _archived(s, d):
    """The boxes of _boxes as they come back from archives. Each reading parses the archives anew: a query that reads the boxes twice saves them."""
    n = F.col("clip_id")
    task = F.when(n == 2, "another task").when(n == 3, "gold_v1__3.mp4").otherwise(F.concat(F.lit("task "), n.cast("string")))
    path = f"{saved_path(s)}/archives"
    archives.write_annotations(_boxes(s, d).withColumns({"clip_id": n.cast("string"), "task_name": task, "task_size": n * 100}), path)
    return archives.read_annotations(s, path)


@query("annotation_archives", _INTERVALS)
def _(s, d):
    """Annotated events by way of archives: written, read back, joined to events."""
    archived = _archived(s, d).withColumn("clip_id", F.col("clip_id").cast("long"))
    return rounded(labels.interval_events(saved(labels.numbered_intervals(archived))))


_MANIFEST = _EVENTS + """, task AS (SELECT DISTINCT clip_id, CASE clip_id WHEN 2 THEN 'another task' WHEN 3 THEN 'gold_v1__3.mp4' ELSE 'task ' || clip_id END AS task_name, clip_id * 100 AS size FROM frames),
mf AS (SELECT *, 'task ' || clip_id AS want, CASE WHEN clip_id % 3 = 0 THEN 24 + clip_id END::DOUBLE AS told, CASE WHEN clip_id % 3 = 1 THEN 5 + clip_id END::DOUBLE AS secs FROM task WHERE clip_id <> 6),
rate AS (SELECT *, CASE WHEN told > 0 THEN told WHEN secs > 0 AND size > 0 THEN size / secs ELSE 25 END AS fps FROM mf), ev AS (SELECT e.*, r.fps, r.want FROM e JOIN rate r ON r.clip_id = e.clip_id)
"""


def _manifest(s, d):
    n = F.col("clip_id")
    m = fx.frames(s, d).select("clip_id").distinct().where("clip_id <> 6")
    return m.select(n.cast("string").alias("clip_id"), F.concat(F.lit("task "), n.cast("string")).alias("cvat_task_name"), F.when(n % 3 == 0, (24 + n).cast("double")).alias("fps"), F.when(n % 3 == 1, (5 + n).cast("double")).alias("duration_seconds"))


@query("annotation_events", _MANIFEST + """SELECT clip_id::VARCHAR AS clip_id, printf('%d__event_%04d', clip_id, n) AS event_id, label AS event_type, start_frame, end_frame, round(start_frame / fps, 6) AS start_seconds, round(end_frame / fps, 6) AS end_seconds, want AS cvat_task_name, label = 'uncertain' AS uncertain, duplicates, (SELECT count(*) FROM e b WHERE b.clip_id = a.clip_id AND b.n < a.n AND b.start_frame <= a.end_frame AND b.end_frame >= a.start_frame) AS overlaps FROM ev a""")
def _(s, d):
    archived = saved(_archived(s, d))
    return rounded(labels.annotation_events(archived, _manifest(s, d), saved(labels.numbered_intervals(archived))))


@query("annotation_issues", _MANIFEST + """SELECT '6' AS clip_id, 'error' AS severity, 'unknown clip export: cvat_export__6.zip' AS message
UNION ALL SELECT '2', 'warning', 'task name mismatch: export=another task, manifest=task 2'
UNION ALL SELECT clip_id::VARCHAR, 'warning', CASE WHEN secs > 0 AND size > 0 THEN printf('manifest fps missing; derived fps=%.6f from CVAT task size %d and duration %.3fs', fps, size, secs) ELSE 'manifest fps missing; using fallback fps=25.0' END FROM rate WHERE told IS NULL
UNION ALL SELECT clip_id::VARCHAR, 'error', printf('duplicate event: %s %d-%d', label, start_frame, end_frame) FROM ev WHERE duplicates > 0
UNION ALL SELECT a.clip_id::VARCHAR, 'warning', printf('overlap: %s %d-%d with %s %d-%d', a.label, a.start_frame, a.end_frame, b.label, b.start_frame, b.end_frame) FROM ev a JOIN ev b ON b.clip_id = a.clip_id AND b.n < a.n AND b.start_frame <= a.end_frame AND b.end_frame >= a.start_frame""")
def _(s, d):
    archived = saved(_archived(s, d))
    return labels.annotation_issues(archived, _manifest(s, d), saved(labels.numbered_intervals(archived)))
