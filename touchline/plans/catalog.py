"""Every query of the engine on the derived domain tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, motion, possession, segments
from ..sources import fixtures as fx

CLASSES = ["click", "error", "purchase", "signup", "view"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    """Registers a query; sql follows the domain tables' WITH list (a leading comma continues it); None: SQL can't express it."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {fx.SQL.strip()} {sql}"
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema))


_NEAR = """, player AS (SELECT * FROM tracks WHERE confidence >= 0.10 AND track_id NOT IN (4, 9)),
near AS (SELECT *, CASE WHEN is_interpolated THEN 'interpolated_ball_skipped' WHEN ball_confidence < 0.25 THEN 'ball_confidence_below_threshold' WHEN d IS NULL THEN 'no_eligible_player_in_frame' WHEN d > height * 1.5 THEN 'nearest_player_too_far' ELSE 'nearest_eligible_player_within_threshold' END AS reason FROM (
 SELECT b.clip_id, b.frame, b."timestamp", b.center_x AS ball_x, b.center_y AS ball_y, b.confidence AS ball_confidence, is_interpolated, track_id, height, sqrt((b.center_x - p.center_x) * (b.center_x - p.center_x) + (b.center_y - p.center_y) * (b.center_y - p.center_y)) AS d, row_number() OVER (PARTITION BY b.clip_id, b.frame ORDER BY sqrt((b.center_x - p.center_x) * (b.center_x - p.center_x) + (b.center_y - p.center_y) * (b.center_y - p.center_y)), track_id) AS rn FROM ball b LEFT JOIN player p ON b.clip_id = p.clip_id AND b.frame = p.frame) WHERE rn = 1),
cand AS (SELECT *, CASE WHEN reason <> 'nearest_eligible_player_within_threshold' THEN 'None' WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS candidate_team FROM near),
runs0 AS (SELECT *, sum(CASE WHEN candidate_team = 'None' THEN 1 ELSE 0 END) OVER w AS block, CASE WHEN candidate_team IS DISTINCT FROM lag(candidate_team) OVER w THEN 1 ELSE 0 END AS fresh FROM cand WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
runs1 AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM runs0),
runs2 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, run ORDER BY frame) AS n FROM runs1),
team0 AS (SELECT *, CASE WHEN candidate_team = 'None' THEN 'None' ELSE coalesce(last_value(CASE WHEN candidate_team <> 'None' AND n >= 3 THEN candidate_team END IGNORE NULLS) OVER (PARTITION BY clip_id, block ORDER BY frame ROWS UNBOUNDED PRECEDING), 'None') END AS team FROM runs2),
poss AS (SELECT clip_id, frame, "timestamp", team, candidate_team, CASE WHEN team <> 'None' THEN track_id END AS player_id, CASE WHEN team <> 'None' THEN d END AS distance_to_ball, ball_x, ball_y, is_interpolated, reason || CASE WHEN candidate_team = 'None' THEN '' WHEN n = 3 AND coalesce(lag(team) OVER (PARTITION BY clip_id ORDER BY frame), 'None') <> candidate_team THEN '; smoothed_switch_confirmed' WHEN candidate_team <> team THEN '; smoothed_pending_switch_to_' || candidate_team ELSE '' END AS possession_reason FROM team0)
"""
_RUNS = """, isle AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY frame) AS seg FROM (SELECT *, CASE WHEN row_number() OVER w = 1 OR team IS DISTINCT FROM lag(team) OVER w OR player_id IS DISTINCT FROM lag(player_id) OVER w {gap} THEN 1 ELSE 0 END AS fresh FROM owners WINDOW w AS (PARTITION BY clip_id ORDER BY frame))),
runs AS (SELECT clip_id, seg, any_value(team) AS team, any_value(player_id) AS player_id, min(frame) AS start_frame, max(frame) AS end_frame, min("timestamp") AS start_time, max("timestamp") AS end_time, count(*) AS frames FROM isle WHERE team <> 'None' GROUP BY clip_id, seg)
"""
_STRICT = _RUNS.format(gap="OR frame - lag(frame) OVER w > 1")
_LOOSE = _RUNS.format(gap="")
_STABLE = _LOOSE + """, stable AS (SELECT * FROM runs WHERE frames >= 6 AND end_time - start_time >= 0.2 - 1e-9),
moves AS (SELECT * FROM (SELECT *, lag(team) OVER w AS from_team, lag(player_id) OVER w AS from_player, lag(end_frame) OVER w AS from_frame, start_time - lag(end_time) OVER w AS gap FROM stable WINDOW w AS (PARTITION BY clip_id ORDER BY start_frame)) WHERE from_player <> player_id AND gap <= 2.0 + 1e-9)
"""
_INTER = _STRICT + """, inter AS (SELECT r.clip_id, row_number() OVER (PARTITION BY r.clip_id ORDER BY start_frame) AS interception_id, start_frame AS frame, start_time AS "timestamp", r.player_id AS winner_player_id, r.team AS winner_team, previous_player_id, previous_team, o.ball_x, o.ball_y, o.distance_to_ball, CASE WHEN concat_ws('; ', CASE WHEN pf < 5 THEN 'short_previous_segment' END, CASE WHEN frames < 3 THEN 'short_new_segment' END) = '' THEN 'ok' ELSE concat_ws('; ', CASE WHEN pf < 5 THEN 'short_previous_segment' END, CASE WHEN frames < 3 THEN 'short_new_segment' END) END AS quality_flag FROM (SELECT *, lag(team) OVER w AS previous_team, lag(player_id) OVER w AS previous_player_id, lag(frames) OVER w AS pf FROM runs WINDOW w AS (PARTITION BY clip_id ORDER BY start_frame)) r JOIN owners o ON r.clip_id = o.clip_id AND r.start_frame = o.frame WHERE previous_team <> r.team AND pf >= 3 AND frames >= 2)
"""
_STEPS = """, steps AS (SELECT *, sqrt((center_x - lag(center_x) OVER w) * (center_x - lag(center_x) OVER w) + (center_y - lag(center_y) OVER w) * (center_y - lag(center_y) OVER w)) AS step, frame - lag(frame) OVER w AS gap, "timestamp" - lag("timestamp") OVER w AS dt FROM tracks WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame))
"""
_CONF = """, names AS (SELECT unnest(['click','error','purchase','signup','view']) AS c), matrix AS (SELECT a.c AS actual, b.c AS predicted, count(p.actual) AS "count" FROM names a CROSS JOIN names b LEFT JOIN predictions p ON p.actual = a.c AND p.predicted = b.c GROUP BY a.c, b.c),
report AS (SELECT label, support, coalesce(tp / nullif(found, 0), 0) AS "precision", coalesce(tp / nullif(support, 0), 0) AS recall FROM (SELECT actual AS label, sum("count") AS support, sum(CASE WHEN actual = predicted THEN "count" ELSE 0 END) AS tp FROM matrix GROUP BY actual) JOIN (SELECT predicted AS label, sum("count") AS found FROM matrix GROUP BY predicted) USING (label)),
f AS (SELECT label, support::BIGINT AS support, "precision", recall, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM report)
"""


def _possession(s, d):
    return possession.estimate_possession(fx.ball(s, d), fx.tracks(s, d), fx.teams(s, d))


@query("estimate_possession", _NEAR + 'SELECT clip_id, frame, round("timestamp", 6) AS "timestamp", team, candidate_team, player_id, round(distance_to_ball, 6) AS distance_to_ball, round(ball_x, 6) AS ball_x, round(ball_y, 6) AS ball_y, is_interpolated, possession_reason FROM poss')
def _(s, d):
    return rounded(_possession(s, d))


@query("possession_summary", _NEAR + "SELECT team, count(*) AS frames, round(avg(distance_to_ball), 6) AS mean_distance, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM poss GROUP BY team")
def _(s, d):
    return rounded(possession.possession_summary(_possession(s, d)))


@query("possession_reasons", _NEAR + "SELECT split_part(possession_reason, ';', 1) AS reason, count(*) AS frames FROM poss GROUP BY 1")
def _(s, d):
    return possession.reason_counts(_possession(s, d))


_CHANGES = """, l AS (SELECT *, CASE WHEN team <> 'None' AND player_id IS NOT NULL THEN team || player_id END AS owner FROM {table}),
l1 AS (SELECT *, last_value(owner IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
changes AS (SELECT clip_id, frame, CASE WHEN owner <> before THEN 1 ELSE 0 END AS possession_changed, coalesce(frame - last_value(CASE WHEN owner <> before OR (before IS NULL AND owner IS NOT NULL) THEN frame END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) AS frames_since_possession_change FROM l1)
"""


@query("possession_changes", _CHANGES.format(table="owners") + "SELECT * FROM changes")
def _(s, d):
    return possession.possession_changes(fx.owners(s, d))


@query("detect_interceptions", _INTER + 'SELECT * REPLACE (round("timestamp", 6) AS "timestamp") FROM inter')
def _(s, d):
    return rounded(segments.detect_interceptions(fx.owners(s, d)))


@query("interception_player_summary", _INTER + "SELECT winner_player_id AS player_id, winner_team AS team, count(*) AS interceptions, round(avg(ball_x), 6) AS mean_ball_x, round(avg(ball_y), 6) AS mean_ball_y FROM inter GROUP BY 1, 2")
def _(s, d):
    return rounded(segments.interception_player_summary(segments.detect_interceptions(fx.owners(s, d))))


_CARRY = _STRICT + """, pts AS (SELECT i.*, center_x AS px, center_y AS py, height FROM isle i LEFT JOIN tracks t ON i.clip_id = t.clip_id AND i.frame = t.frame AND i.player_id = t.track_id WHERE team <> 'None'),
cg AS (SELECT clip_id, seg, any_value(team) AS team, any_value(player_id) AS player_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames, max("timestamp") - min("timestamp") AS duration_seconds, avg(distance_to_ball) AS mean_distance_to_ball, max(distance_to_ball) AS max_distance_to_ball, coalesce(avg(height), 0) AS mean_player_box_height, avg(CASE WHEN is_interpolated THEN 1.0::DOUBLE ELSE 0 END) AS interpolated_share,
 arg_min(ball_x, frame) FILTER (ball_x IS NOT NULL) AS bx0, arg_min(ball_y, frame) FILTER (ball_x IS NOT NULL) AS by0, arg_max(ball_x, frame) FILTER (ball_x IS NOT NULL) AS bx1, arg_max(ball_y, frame) FILTER (ball_x IS NOT NULL) AS by1, arg_min(px, frame) FILTER (px IS NOT NULL) AS px0, arg_min(py, frame) FILTER (px IS NOT NULL) AS py0, arg_max(px, frame) FILTER (px IS NOT NULL) AS px1, arg_max(py, frame) FILTER (px IS NOT NULL) AS py1 FROM pts GROUP BY clip_id, seg),
cd AS (SELECT *, coalesce(sqrt((bx0 - bx1) * (bx0 - bx1) + (by0 - by1) * (by0 - by1)), 0) AS ball_distance_px, coalesce(sqrt((px0 - px1) * (px0 - px1) + (py0 - py1) * (py0 - py1)), 0) AS player_distance_px, mean_player_box_height * 0.8::DOUBLE AS carry_distance_threshold FROM cg),
carry AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_frame) AS carry_id, player_id, team, start_frame, end_frame, bx0 AS start_ball_x, by0 AS start_ball_y, bx1 AS end_ball_x, by1 AS end_ball_y, frames, duration_seconds, ball_distance_px, player_distance_px, mean_distance_to_ball, max_distance_to_ball, mean_player_box_height, carry_distance_threshold, interpolated_share, CASE WHEN interpolated_share > 0 THEN 'contains_interpolation' ELSE 'ok' END AS carry_quality_flag FROM cd WHERE frames >= 5 AND duration_seconds >= 0.2 - 1e-9 AND ball_distance_px >= 20 AND player_distance_px >= 10 AND carry_distance_threshold > 0 AND coalesce(mean_distance_to_ball, 0) <= carry_distance_threshold AND interpolated_share <= 0.5)
"""


@query("estimate_carries", _CARRY + "SELECT * REPLACE (round(duration_seconds, 6) AS duration_seconds, round(ball_distance_px, 6) AS ball_distance_px, round(player_distance_px, 6) AS player_distance_px, round(mean_distance_to_ball, 6) AS mean_distance_to_ball, round(mean_player_box_height, 6) AS mean_player_box_height, round(carry_distance_threshold, 6) AS carry_distance_threshold, round(interpolated_share, 6) AS interpolated_share) FROM carry")
def _(s, d):
    return rounded(segments.estimate_carries(fx.owners(s, d), fx.tracks(s, d)))


@query("carry_player_summary", _CARRY + "SELECT player_id, team, count(*) AS carries, round(sum(duration_seconds), 6) AS total_duration, round(avg(ball_distance_px), 6) AS mean_ball_distance, round(max(ball_distance_px), 6) AS max_ball_distance FROM carry GROUP BY 1, 2")
def _(s, d):
    return rounded(segments.carry_player_summary(segments.estimate_carries(fx.owners(s, d), fx.tracks(s, d))))


def _stable(s, d):
    return segments.stable_segments(fx.owners(s, d))


@query("stable_possession_segments", _STABLE + "SELECT * REPLACE (seg::BIGINT AS seg, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time) FROM stable")
def _(s, d):
    return rounded(_stable(s, d))


@query("passing_summary", _STABLE + "SELECT from_team AS team, count(*) AS attempts, count(*) FILTER (from_team = team) AS successes, round(100.0::DOUBLE * (count(*) FILTER (from_team = team)) / count(*), 6) AS accuracy FROM moves GROUP BY from_team")
def _(s, d):
    return rounded(segments.passing_summary(_stable(s, d)))


_PASS = _STABLE + ", pass AS (SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY start_frame) AS pass_id, from_frame AS start_frame, start_frame AS end_frame, from_player, player_id AS to_player, team, 0.5::DOUBLE AS confidence FROM moves WHERE from_team = team) "


@query("export_weak_passes", _PASS + "SELECT * FROM pass")
def _(s, d):
    return segments.weak_passes(_stable(s, d))


@query("passing_network", _PASS + "SELECT team, from_player, to_player, count(*) AS passes FROM pass GROUP BY 1, 2, 3")
def _(s, d):
    return segments.passing_network(segments.weak_passes(_stable(s, d)))


@query("player_stats", _STEPS + """SELECT clip_id, track_id, frames_seen, round(mean_confidence, 6) AS mean_confidence, round(path_length, 6) AS path_length, round(time_visible, 6) AS time_visible, round(CASE WHEN time_visible > 0 THEN path_length / time_visible ELSE 0 END, 6) AS mean_speed FROM (SELECT clip_id, track_id, count(center_x) AS frames_seen, avg(confidence) AS mean_confidence, coalesce(sum(step), 0) AS path_length, max("timestamp") - min("timestamp") AS time_visible FROM steps GROUP BY clip_id, track_id)""")
def _(s, d):
    return rounded(motion.player_stats(fx.tracks(s, d)))


@query("top_tracks", ", c AS (SELECT clip_id, track_id, row_number() OVER (PARTITION BY clip_id ORDER BY count(*) DESC, track_id) AS r FROM tracks GROUP BY clip_id, track_id) SELECT t.* FROM tracks t JOIN c USING (clip_id, track_id) WHERE r <= 5")
def _(s, d):
    return motion.top_tracks(fx.tracks(s, d))


@query("track_position_stats", _STEPS + "SELECT clip_id, track_id, count(*) AS frames, min(frame) AS first_frame, max(frame) AS last_frame, median(center_x) AS median_x, median(center_y) AS median_y, max(center_x) - min(center_x) AS span_x, max(center_y) - min(center_y) AS span_y, round(coalesce(sum(step), 0), 6) AS movement FROM steps GROUP BY 1, 2")
def _(s, d):
    return rounded(motion.position_stats(fx.tracks(s, d)))


@query("heatmap_grid", """, c AS (SELECT clip_id, track_id, least(greatest(floor(center_x / 1280 * 12), 0), 11)::BIGINT AS col, least(greatest(floor(center_y / 720 * 8), 0), 7)::BIGINT AS "row", count(*) AS points FROM tracks GROUP BY 1, 2, 3, 4) SELECT *, round(points / sum(points) OVER (PARTITION BY clip_id, track_id), 6) AS fraction FROM c""")
def _(s, d):
    return rounded(motion.heatmap_grid(fx.tracks(s, d), 1280, 720))


@query("trajectory_points", _STEPS + ", a AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, track_id ORDER BY frame)::BIGINT AS segment_id, CASE WHEN gap = 1 AND dt > 0 THEN step / dt END AS speed FROM steps) SELECT clip_id, track_id, frame, segment_id, round(CASE WHEN gap = 1 THEN step END, 6) AS step, round(speed, 4) AS speed, round(CASE WHEN segment_id = lag(segment_id) OVER w AND dt > 0 THEN (speed - lag(speed) OVER w) / dt END, 2) AS acceleration FROM a WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)")
def _(s, d):
    t = motion.trajectories(fx.tracks(s, d)).drop("gap")
    return t.withColumns({"step": F.round("step", 6), "speed": F.round("speed", 4), "acceleration": F.round("acceleration", 2)})


@query("nearest_players", """, r AS (SELECT b.clip_id, b.frame, t.track_id, sqrt((b.center_x - t.center_x) * (b.center_x - t.center_x) + (b.center_y - t.center_y) * (b.center_y - t.center_y)) AS d, row_number() OVER (PARTITION BY b.clip_id, b.frame ORDER BY sqrt((b.center_x - t.center_x) * (b.center_x - t.center_x) + (b.center_y - t.center_y) * (b.center_y - t.center_y)), t.track_id) AS k FROM ball b LEFT JOIN tracks t ON b.clip_id = t.clip_id AND b.frame = t.frame)
SELECT clip_id, frame, """ + ", ".join(f"coalesce(max(track_id) FILTER (k = {i}), -1)::BIGINT AS p{i}_id, round(max(d) FILTER (k = {i}), 6) AS p{i}_distance, CASE WHEN max(d) FILTER (k = {i}) IS NULL THEN 1 ELSE 0 END AS p{i}_missing" for i in (1, 2, 3, 4)) + " FROM r GROUP BY clip_id, frame")
def _(s, d):
    return rounded(motion.nearest_players(fx.ball(s, d), fx.tracks(s, d)))


@query("ball_motion", """, v AS (SELECT *, (center_x - lag(center_x) OVER w) / dt AS vx, (center_y - lag(center_y) OVER w) / dt AS vy FROM (SELECT *, "timestamp" - lag("timestamp") OVER w AS dt FROM ball WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
a AS (SELECT *, (vx - lag(vx) OVER w) / dt AS ax, (vy - lag(vy) OVER w) / dt AS ay FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY frame))
SELECT clip_id, frame, round(vx, 4) AS vx, round(vy, 4) AS vy, round(sqrt(vx * vx + vy * vy), 4) AS ball_speed, round(sqrt(ax * ax + ay * ay), 2) AS ball_acceleration, CASE WHEN vx IS NULL THEN 0 ELSE 1 END AS velocity_valid, CASE WHEN ax IS NULL THEN 0 ELSE 1 END AS acceleration_valid FROM a""")
def _(s, d):
    b = motion.ball_motion(fx.ball(s, d))
    return b.withColumns({c: F.round(c, 4) for c in ("vx", "vy", "ball_speed")} | {"ball_acceleration": F.round("ball_acceleration", 2)})


@query("interpolate_ball_tracks", """, n AS (SELECT *, lead(frame) OVER w AS f2, lead("timestamp") OVER w AS t2, lead(center_x) OVER w AS x2, lead(center_y) OVER w AS y2, lead(confidence) OVER w AS c2 FROM ball WINDOW w AS (PARTITION BY clip_id ORDER BY frame)), u AS (SELECT *, unnest(range(1, f2 - frame)) AS k FROM n WHERE f2 - frame > 1 AND f2 - frame - 1 <= 8)
SELECT clip_id, frame, round("timestamp", 6) AS "timestamp", round(center_x, 6) AS center_x, round(center_y, 6) AS center_y, round(confidence, 6) AS confidence, 0 AS is_interpolated FROM ball UNION ALL SELECT clip_id, frame + k, round("timestamp" + k / (f2 - frame) * (t2 - "timestamp"), 6), round(center_x + k / (f2 - frame) * (x2 - center_x), 6), round(center_y + k / (f2 - frame) * (y2 - center_y), 6), round(least(confidence, c2), 6), 1 FROM u""")
def _(s, d):
    return rounded(motion.interpolate(fx.ball(s, d)))


@query("frame_rate", """SELECT clip_id, round(CASE WHEN count(*) >= 3 AND median(dt) FILTER (dt > 0) > 0 THEN 1 / (median(dt) FILTER (dt > 0)) ELSE 25 END, 6) AS fps FROM (SELECT clip_id, "timestamp" - lag("timestamp") OVER (PARTITION BY clip_id ORDER BY frame) AS dt FROM frames) GROUP BY clip_id""")
def _(s, d):
    return rounded(motion.frame_rate(fx.frames(s, d)))


@query("clip_bounds", 'SELECT clip_id, min(frame) AS min_frame, max(frame) AS max_frame, count(*) AS "rows" FROM frames GROUP BY clip_id')
def _(s, d):
    return motion.bounds(fx.frames(s, d))


_DET = """, det AS (SELECT clip_id, frame, p AS det_id, 3 + (frame * 3 + 5 * p) % 29 AS width, 3 + (frame + 7 * p) % 29 AS height, ((frame * 5 + 90 * p) % 720)::DOUBLE AS center_y, ((frame * 7 + 13 * p) % 100) / 100.0::DOUBLE AS confidence FROM frames, (SELECT unnest(range(4)) AS p)),
r AS (SELECT *, CASE WHEN width * height < 20 THEN 'area_below_min' WHEN width * height > 500 THEN 'area_above_max' WHEN width < 4 THEN 'width_below_min' WHEN width > 30 THEN 'width_above_max' WHEN height < 4 THEN 'height_below_min' WHEN height > 30 THEN 'height_above_max' WHEN center_y < 720 * 0.08::DOUBLE THEN 'excluded_top_region' END AS gate FROM det),
kept AS (SELECT * EXCLUDE (gate), CASE WHEN gate IS NULL AND row_number() OVER (PARTITION BY clip_id, frame, gate IS NULL ORDER BY confidence DESC, det_id) > 1 THEN 'per_frame_confidence_cap' ELSE gate END AS reason, reason IS NULL AS kept FROM r)
"""


def _detected(s, d):
    p, f = F.col("det_id"), F.col("frame")
    det = fx.frames(s, d).select("clip_id", "frame", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("det_id"))
    return motion.filter_ball_detections(det.withColumns({"width": 3 + (f * 3 + 5 * p) % 29, "height": 3 + (f + 7 * p) % 29, "center_y": ((f * 5 + 90 * p) % 720).cast("double"), "confidence": ((f * 7 + 13 * p) % 100) / 100.0}), 720)


@query("filter_ball_detections", _DET + "SELECT * FROM kept")
def _(s, d):
    return _detected(s, d)


_MARKS = "['min', 'p25', 'median', 'p75', 'max']"


def _spread(table: str, where: str) -> str:
    parts = " UNION ALL ".join(f"SELECT clip_id, unnest([x || '_{c}_' FOR x IN ['']]) AS c, quantile_cont({v}::DOUBLE, [0, 0.25, 0.5, 0.75, 1]) AS q FROM kept {where} GROUP BY clip_id" for c, v in (("confidence", "confidence"), ("width", "width"), ("height", "height"), ("area", "(width * height)")))
    return f"SELECT clip_id, '{table}_distribution' AS section, trim(c, '_') || '_' || unnest({_MARKS}) AS metric, unnest(q) AS \"value\" FROM ({parts})"


_COUNTS = ["frames", *(f"{c}_{k}" for c in ("raw", "filtered") for k in ("detections", "frames_zero", "frames_one", "frames_multiple"))]


@query("ball_detection_diagnostics", _DET + f""", per AS (SELECT f.clip_id, f.frame, count(k.frame) AS raw, count(*) FILTER (k.kept) AS filtered FROM frames f LEFT JOIN kept k ON f.clip_id = k.clip_id AND f.frame = k.frame GROUP BY 1, 2),
tot AS (SELECT clip_id, [count(*), sum(raw), count(*) FILTER (raw = 0), count(*) FILTER (raw = 1), count(*) FILTER (raw > 1), sum(filtered), count(*) FILTER (filtered = 0), count(*) FILTER (filtered = 1), count(*) FILTER (filtered > 1)] AS n FROM per GROUP BY 1),
rep AS (SELECT clip_id, 'counts' AS section, unnest({_COUNTS}) AS metric, unnest(n)::DOUBLE AS "value" FROM tot UNION ALL SELECT clip_id, 'removal_reasons', reason, count(*)::DOUBLE FROM kept WHERE reason IS NOT NULL GROUP BY 1, 3 UNION ALL {_spread("raw", "")} UNION ALL {_spread("filtered", "WHERE kept")} UNION ALL SELECT clip_id, 'raw_frame_counts', frame::VARCHAR, raw::DOUBLE FROM per UNION ALL SELECT clip_id, 'filtered_frame_counts', frame::VARCHAR, filtered::DOUBLE FROM per)
SELECT clip_id, section, metric, round("value", 6) AS "value" FROM rep""")
def _(s, d):
    return rounded(motion.ball_detection_diagnostics(fx.frames(s, d), _detected(s, d)))


@query("tumbling_5s", """SELECT clip_id, "window", count(*) AS "rows", round(avg(center_x), 6) AS mean_x, round(stddev_pop(center_x), 6) AS std_x, median(center_y) AS median_y FROM (SELECT *, floor(("timestamp" - min("timestamp") OVER (PARTITION BY clip_id)) / 5.0::DOUBLE + 1e-9)::BIGINT AS "window" FROM tracks) GROUP BY 1, 2""")
def _(s, d):
    return rounded(motion.tumbling_means(fx.tracks(s, d)))


_HOP = """, bw AS (SELECT clip_id, unnest(range(min(frame), max(frame) - 62, 8)) AS start_frame FROM frames GROUP BY clip_id HAVING max(frame) - min(frame) + 1 >= 64),
hop AS (SELECT w.clip_id, w.start_frame, label, event_id, CASE WHEN e.clip_id IS NOT NULL THEN least(e.end_frame, w.start_frame + 38) - greatest(e.start_frame, w.start_frame + 23) + 1 END AS o, list_position(['background','carry','pass','turnover','shot'], label) AS r FROM bw w LEFT JOIN intervals e ON w.clip_id = e.clip_id AND e.label <> 'uncertain' AND e.start_frame <= w.start_frame + 38 AND e.end_frame >= w.start_frame + 23),
win AS (SELECT clip_id, start_frame, start_frame + 63 AS end_frame, start_frame + 23 AS label_start_frame, start_frame + 38 AS label_end_frame, coalesce(label, 'background') AS target_class, event_id, coalesce(o, 0) AS event_overlap_frames FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, start_frame ORDER BY o DESC, r DESC, event_id) AS k FROM hop) WHERE k = 1)
"""


def _windows(s, d):
    return motion.hopping_windows(fx.frames(s, d), fx.intervals(s, d).where("label <> 'uncertain'"))


@query("gold_event_windows", _HOP + "SELECT * FROM win")
def _(s, d):
    return _windows(s, d)


@query("window_split_counts", _HOP + ", sp AS (SELECT clip_id, CASE WHEN row_number() OVER (ORDER BY clip_id) <= 6 THEN 'train' WHEN row_number() OVER (ORDER BY clip_id) <= 7 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT clip_id FROM win)) SELECT split, target_class AS label, count(*) AS windows FROM win JOIN sp USING (clip_id) GROUP BY 1, 2")
def _(s, d):
    w = _windows(s, d)
    return metrics.split_counts(w, metrics.clip_split(w), "target_class")


@query("class_weights", _HOP + ", c AS (SELECT target_class AS label, count(*) AS n FROM win GROUP BY 1), x AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) AS w FROM c) SELECT label, n, round(w / avg(w) OVER (), 6) AS weight FROM x")
def _(s, d):
    return rounded(metrics.class_weights(_windows(s, d), "target_class"))


@query("overlap_groups", """, o AS (SELECT *, max(end_frame) OVER (PARTITION BY clip_id ORDER BY start_frame, end_frame, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM intervals), i AS (SELECT *, sum(CASE WHEN start_frame <= m THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY start_frame, end_frame, event_id) AS isle FROM o), g AS (SELECT clip_id, isle, row_number() OVER (PARTITION BY clip_id ORDER BY isle) AS k FROM i GROUP BY clip_id, isle HAVING count(*) > 1)
SELECT i.clip_id, event_id, start_frame, end_frame, label, 'overlap_' || k AS overlap_group FROM i LEFT JOIN g ON i.clip_id = g.clip_id AND i.isle = g.isle""")
def _(s, d):
    return segments.overlap_groups(fx.intervals(s, d))


@query("turnover_interception_match", _INTER + ", e AS (SELECT clip_id, event_id AS id, start_frame AS frame FROM intervals) SELECT clip_id, id AS left_id, rid AS right_id, delta FROM (SELECT e.clip_id, e.id, i.interception_id AS rid, abs(e.frame - i.frame) AS delta, row_number() OVER (PARTITION BY e.clip_id, e.id ORDER BY abs(e.frame - i.frame), i.interception_id) AS k FROM e LEFT JOIN inter i ON e.clip_id = i.clip_id AND abs(e.frame - i.frame) <= 2) WHERE k = 1")
def _(s, d):
    i = segments.detect_interceptions(fx.owners(s, d)).select("clip_id", F.col("interception_id").alias("id"), "frame")
    return motion.nearest_within(fx.intervals(s, d).select("clip_id", F.col("event_id").alias("id"), F.col("start_frame").alias("frame")), i, 2).drop("right_frame")


@query("confusion_matrix", _CONF + "SELECT * FROM matrix")
def _(s, d):
    return metrics.confusion_matrix(fx.predictions(s, d), CLASSES)


@query("classification_report", _CONF + 'SELECT label, support, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f')
def _(s, d):
    return rounded(metrics.classification_report(metrics.confusion_matrix(fx.predictions(s, d), CLASSES)))


@query("accuracy_macro_f1", _CONF + 'SELECT round((SELECT sum("count") FILTER (actual = predicted) / sum("count") FROM matrix), 6) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f')
def _(s, d):
    return rounded(metrics.accuracy_macro_f1(metrics.confusion_matrix(fx.predictions(s, d), CLASSES)))


@query("tracking_summary", """SELECT 'ball' AS section, unnest(['rows', 'interpolated', 'mean_confidence']) AS metric, round(unnest([count(*)::DOUBLE, count(*) FILTER (is_interpolated)::DOUBLE, avg(confidence)]), 6) AS "value" FROM ball""")
def _(s, d):
    return rounded(metrics.long_summary(fx.ball(s, d), "ball", {"rows": F.count("*"), "interpolated": F.count_if("is_interpolated"), "mean_confidence": F.avg("confidence")}))
