"""Queries of candidates, shape, movement, tracking and reports, and the same in SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, frame_table, metrics, motion, reports, segments, shape, tracking
from ..sources import fixtures as fx
from ..sources.files import saved
from .catalog import _CARRY, _HOP, _INTER, _PASS, _STEPS, _STRICT, _windows, query, rounded

_MOTION = """, v AS (SELECT *, (center_x - lag(center_x) OVER w) / dt AS vx, (center_y - lag(center_y) OVER w) / dt AS vy FROM (SELECT *, "timestamp" - lag("timestamp") OVER w AS dt FROM ball WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
a AS (SELECT *, (vx - lag(vx) OVER w) / dt AS ax, (vy - lag(vy) OVER w) / dt AS ay FROM v WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
motion AS (SELECT clip_id, frame, center_x, sqrt(vx * vx + vy * vy) AS speed, sqrt(ax * ax + ay * ay) AS acc, vx IS NOT NULL OR ax IS NOT NULL AS moves FROM a),
thr AS (SELECT clip_id, quantile_cont(speed, 0.75::DOUBLE) AS s75, quantile_cont(acc, 0.75::DOUBLE) AS a75, quantile_cont(speed, 0.95::DOUBLE) AS s95, quantile_cont(acc, 0.95::DOUBLE) AS a95 FROM motion GROUP BY clip_id),
edge AS (SELECT clip_id, min(frame) AS min_frame, max(frame) AS max_frame FROM frames GROUP BY clip_id),
ef AS (SELECT o.clip_id, o.frame, o."timestamp", o.ball_x, o.distance_to_ball, o.ball_x IS NULL AS missing, o.is_interpolated AS interpolated, speed, acc, coalesce(moves, false) AS valid, coalesce(o.frame - lag(o.frame) OVER (PARTITION BY o.clip_id ORDER BY o.frame) <> 1, false) AS gap FROM owners o LEFT JOIN motion m ON o.clip_id = m.clip_id AND o.frame = m.frame),
seg AS (SELECT *, lag(team) OVER w AS from_team, lag(player_id) OVER w AS from_player, lag(frames) OVER w AS from_frames, lag(end_frame) OVER w AS from_frame, lag(end_time) OVER w AS from_time, start_time - lag(end_time) OVER w AS gap FROM runs WINDOW w AS (PARTITION BY clip_id ORDER BY start_frame))
"""
_WEAK = _PASS.replace("isle", "loose").replace("runs", "lruns").replace("pass AS (", "weak AS (").rstrip()
_ALL = _CARRY + _INTER[len(_STRICT):] + _WEAK + _MOTION + """, pass0 AS (SELECT s.clip_id, s.from_frame AS start_frame, s.start_frame AS end_frame, s.from_time AS start_timestamp, s.start_time AS end_timestamp, s.team, s.from_player, s.player_id AS to_player, greatest(s.gap, 0) AS duration, s.from_frames AS previous_frames, s.frames AS new_frames, max(speed) AS max_speed, max(acc) AS max_acceleration, count(*) FILTER (f.valid) AS motion_frames, avg(CASE WHEN missing OR interpolated THEN 1.0::DOUBLE ELSE 0 END) FILTER (f.frame BETWEEN s.from_frame AND s.start_frame) AS lost_share, count(*) FILTER (f.gap AND f.frame > s.from_frame AND f.frame <= s.start_frame) AS frame_gaps, min(f.distance_to_ball) FILTER (f.frame BETWEEN s.from_frame AND s.start_frame) AS ball_distance FROM seg s LEFT JOIN ef f ON f.clip_id = s.clip_id AND f.frame BETWEEN s.from_frame - 12 AND s.start_frame + 12 WHERE s.from_team = s.team AND s.from_player <> s.player_id AND s.gap <= 2.0::DOUBLE + 1e-9 GROUP BY ALL),
pass1 AS (SELECT p.*, (SELECT min(w.pass_id) FROM weak w WHERE w.clip_id = p.clip_id AND w.team = p.team AND w.from_player = p.from_player AND w.to_player = p.to_player AND w.start_frame <= p.end_frame AND w.end_frame >= p.start_frame) AS weak_pass_id, coalesce(max_speed >= s75, false) OR coalesce(max_acceleration >= a75, false) AS fast, previous_frames >= 3 AND new_frames >= 2 AND frame_gaps = 0 AS sure FROM pass0 p LEFT JOIN thr t ON p.clip_id = t.clip_id),
pass2 AS (SELECT * EXCLUDE (fast, sure), sure::INT AS consistent, row_number() OVER (PARTITION BY clip_id ORDER BY start_frame, end_frame) AS pass_id, round_even((start_frame + end_frame) / 2, 0)::BIGINT AS center_frame, CASE WHEN sure AND motion_frames > 0 AND fast THEN 'high' WHEN sure AND (motion_frames > 0 OR weak_pass_id IS NOT NULL) THEN 'medium' ELSE 'low' END AS tier, CASE tier WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.65 ELSE 0.35 END AS confidence, 'same_team_player_change;previous_stable=' || previous_frames || ';new_stable=' || new_frames || ';valid_ball_motion_frames=' || motion_frames || CASE WHEN weak_pass_id IS NOT NULL THEN ';matched_weak_pass' ELSE '' END AS rule_reasons FROM pass1),
turn0 AS (SELECT s.clip_id, s.from_frame AS start_frame, s.start_frame AS end_frame, s.from_time AS start_timestamp, s.start_time AS end_timestamp, s.from_team, s.team, s.from_player, s.player_id AS to_player, o.distance_to_ball AS winner_distance, s.from_frames AS previous_frames, s.frames AS winner_frames FROM seg s JOIN owners o ON o.clip_id = s.clip_id AND o.frame = s.start_frame WHERE s.from_team <> s.team),
turn1 AS (SELECT t.*, max(speed) AS max_speed, max(acc) AS max_acceleration, min(f.distance_to_ball) AS ball_distance, (sum(gap::INT) - arg_min(gap::INT, f.frame))::BIGINT AS frame_gaps FROM turn0 t LEFT JOIN ef f ON f.clip_id = t.clip_id AND f.frame BETWEEN t.end_frame - 12 AND t.end_frame + 12 GROUP BY ALL),
turn3 AS (SELECT t.*, i.interception_id, i.frame - t.end_frame AS frame_delta FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY start_frame, end_frame) AS turnover_id FROM turn1) t LEFT JOIN inter i ON i.clip_id = t.clip_id AND abs(i.frame - t.end_frame) <= 2 QUALIFY row_number() OVER (PARTITION BY t.clip_id, turnover_id ORDER BY abs(i.frame - t.end_frame), i.interception_id) = 1),
turn AS (SELECT *, (interception_id IS NOT NULL)::INT AS matched, coalesce(winner_distance <= 100, false) AS near_, CASE WHEN matched = 1 AND previous_frames >= 3 AND winner_frames >= 2 AND near_ THEN 'high' WHEN previous_frames >= 3 AND winner_frames >= 2 AND near_ THEN 'medium' ELSE 'low' END AS tier, CASE WHEN matched = 1 THEN 'interception' ELSE 'possession_turnover' END AS subtype, CASE tier WHEN 'high' THEN 0.85::DOUBLE WHEN 'medium' THEN 0.60 ELSE 0.35 END AS confidence, 'team_switch;previous_stable=' || previous_frames || ';winner_stable=' || winner_frames || ';plausible_distance=' || near_::INT || CASE WHEN matched = 1 THEN ';matched_existing_interception' ELSE '' END AS rule_reasons FROM turn3),
turn2 AS (SELECT t.* EXCLUDE (start_frame, end_frame, near_), start_frame AS raw_start_frame, end_frame AS raw_end_frame, end_frame AS center_frame, greatest(t.end_frame - 8, min_frame) AS start_frame, least(t.end_frame + 8, max_frame) AS end_frame, previous_frames >= 3 AS p_, winner_frames >= 2 AS w_, CASE WHEN p_ AND w_ THEN CASE WHEN tier = 'high' THEN 'kept' ELSE 'review_only' END WHEN tier = 'low' THEN 'suppressed' ELSE 'review_only' END AS status, concat_ws(';', 'local_window_around_switch_frame', CASE WHEN matched = 1 THEN 'matched_interception_anchor' END, CASE WHEN NOT p_ THEN 'previous_owner_not_stable' END, CASE WHEN NOT w_ THEN 'winner_not_stable;team_switch_not_sustained' END) AS refinement_reasons, (tier <> 'low')::INT AS review, (p_ AND w_ AND tier = 'high' AND matched = 1)::INT AS weak_eligible FROM turn t JOIN edge e ON t.clip_id = e.clip_id),
lim AS (SELECT t.*, image_width FROM thr t JOIN (SELECT clip_id, ceil(max(ball_x))::BIGINT + 1 AS image_width FROM ef GROUP BY 1) i ON t.clip_id = i.clip_id),
pk AS (SELECT f.clip_id, f.frame FROM ef f JOIN lim l ON f.clip_id = l.clip_id WHERE valid AND (speed >= s95 OR acc >= a95)),
pk1 AS (SELECT *, sum(fresh) OVER (PARTITION BY clip_id ORDER BY frame) AS g FROM (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) <= 12 THEN 0 ELSE 1 END AS fresh FROM pk)),
shot0 AS (SELECT clip_id, min(frame) AS ps, max(frame) AS pe, count(*) AS peaks FROM pk1 GROUP BY clip_id, g),
cf AS (SELECT DISTINCT clip_id, unnest(range(start_frame, end_frame + 1)) AS frame FROM carry WHERE carry_quality_flag = 'ok'),
ef2 AS (SELECT f.*, c.frame IS NOT NULL AS carried, CASE WHEN ball_x <= 0.2::DOUBLE * image_width THEN 'left_image_end' WHEN ball_x >= 0.8::DOUBLE * image_width THEN 'right_image_end' END AS side FROM ef f JOIN lim l ON f.clip_id = l.clip_id LEFT JOIN cf c ON c.clip_id = f.clip_id AND c.frame = f.frame),
shot1 AS (SELECT s.clip_id, peaks, image_width, s95, round_even((ps + pe) / 2, 0)::BIGINT AS center_frame, ps, pe, min(f.frame) AS start_frame, max(f.frame) AS end_frame, arg_min("timestamp", f.frame) AS start_timestamp, arg_max("timestamp", f.frame) AS end_timestamp, max(speed) AS max_speed, max(acc) AS max_acceleration, min(distance_to_ball) AS ball_distance, count(*) FILTER (valid) AS motion_frames, avg(interpolated::INT::DOUBLE) AS interpolated_share, avg(carried::INT::DOUBLE) AS carry_overlap, arg_min(side, f.frame) FILTER (side IS NOT NULL) AS goal_side, bool_or(NOT missing AND NOT interpolated AND valid) AS evidence, (sum(gap::INT) - arg_min(gap::INT, f.frame))::BIGINT AS frame_gaps FROM shot0 s JOIN lim l ON s.clip_id = l.clip_id JOIN ef2 f ON f.clip_id = s.clip_id AND f.frame BETWEEN ps - 12 AND pe + 12 GROUP BY ALL),
shot AS (SELECT * EXCLUDE (s95, ps, pe, evidence), (goal_side IS NOT NULL)::INT AS near_end, row_number() OVER (PARTITION BY clip_id ORDER BY center_frame, start_frame) AS shot_id, coalesce(max_speed >= s95, false) AND evidence AND goal_side IS NOT NULL AND carry_overlap < 0.25 AS good_, CASE WHEN good_ THEN 'medium' ELSE 'low' END AS tier, CASE WHEN good_ THEN 0.55::DOUBLE WHEN carry_overlap < 0.25 THEN 0.35 ELSE 0.25 END AS confidence, 'ball_motion_spike;near_goal_region=' || near_end || ';non_interpolated_evidence=' || evidence::INT || ';carry_overlap_fraction=' || format('{:.3f}', carry_overlap) AS rule_reasons FROM shot1),
shot2 AS (SELECT s.* EXCLUDE (good_), local_, local_ AND interpolated_share <= 0.25 AND carry_overlap <= 0.2::DOUBLE AND motion_frames > 0 AS review_, CASE WHEN review_ THEN 'review_only' ELSE 'suppressed' END AS status, concat_ws(';', 'annotation_review_candidate_only', CASE WHEN local_ THEN 'local_near_goal_region' ELSE 'local_near_goal_region_absent' END, CASE WHEN interpolated_share > 0.25 THEN 'interpolation_fraction_too_high' END, CASE WHEN carry_overlap > 0.2::DOUBLE THEN 'carry_overlap_too_high' END, CASE WHEN motion_frames = 0 THEN 'valid_ball_motion_absent' END, CASE WHEN end_frame - start_frame > 36 AND NOT local_ THEN 'long_candidate_span_without_local_peak_support' END) AS refinement_reasons FROM shot s JOIN (SELECT s.clip_id, shot_id, coalesce(bool_or(ball_x <= 0.2::DOUBLE * image_width OR ball_x >= 0.8::DOUBLE * image_width), false) AS local_ FROM shot s LEFT JOIN owners o ON o.clip_id = s.clip_id AND o.frame BETWEEN center_frame - 6 AND center_frame + 6 GROUP BY 1, 2) n ON n.clip_id = s.clip_id AND n.shot_id = s.shot_id),
rp0 AS (SELECT *, row_number() OVER (PARTITION BY clip_id, team ORDER BY start_frame, end_frame, pass_id) AS n FROM pass2),
rp AS (SELECT clip_id, team, n, 1 AS grp, start_frame AS gs, end_frame AS ge, end_frame AS re, from_player AS rf, to_player AS rt, max_speed AS rs, max_acceleration AS ra, confidence AS rc, false AS blocked FROM rp0 WHERE n = 1
 UNION ALL SELECT clip_id, team, n, CASE WHEN m THEN grp ELSE grp + 1 END, CASE WHEN m THEN least(gs, s) ELSE s END, CASE WHEN m THEN greatest(ge, e) ELSE e END, CASE WHEN b THEN e ELSE re END, CASE WHEN b THEN f ELSE rf END, CASE WHEN b THEN t ELSE rt END, CASE WHEN b THEN sp ELSE rs END, CASE WHEN b THEN ac ELSE ra END, CASE WHEN b THEN co ELSE rc END, like_ AND NOT m FROM (
  SELECT *, like_ AND greatest(ge, re, e) - least(gs, s) + 1 <= 24 AS m, NOT m OR co > rc OR (co = rc AND coalesce(sp, 0) > coalesce(rs, 0)) AS b FROM (
   SELECT r.* EXCLUDE (n), p.n, p.start_frame AS s, p.end_frame AS e, p.from_player AS f, p.to_player AS t, p.max_speed AS sp, p.max_acceleration AS ac, p.confidence AS co, p.start_frame - re <= 12 AND (p.start_frame <= re OR (rf = p.to_player AND rt = p.from_player) OR CASE WHEN rs IS NULL OR p.max_speed IS NULL THEN rs IS NULL AND p.max_speed IS NULL ELSE abs(rs - p.max_speed) <= 0.05::DOUBLE * greatest(abs(rs), abs(p.max_speed), 1) END OR CASE WHEN ra IS NULL OR p.max_acceleration IS NULL THEN ra IS NULL AND p.max_acceleration IS NULL ELSE abs(ra - p.max_acceleration) <= 0.05::DOUBLE * greatest(abs(ra), abs(p.max_acceleration), 1) END) AS like_ FROM rp r JOIN rp0 p ON p.clip_id = r.clip_id AND p.team = r.team AND p.n = r.n + 1))),
rp1 AS (SELECT p.*, grp, blocked, row_number() OVER (PARTITION BY p.clip_id, p.team, grp ORDER BY confidence DESC, coalesce(max_speed, 0) DESC, p.n) AS best FROM rp0 p JOIN rp r ON p.clip_id = r.clip_id AND p.team = r.team AND p.n = r.n),
rp2 AS (SELECT clip_id, team, grp, min(start_frame) AS start_frame, max(end_frame) AS end_frame, arg_min(pass_id, n) AS raw_pass_id, count(*) AS members, string_agg(pass_id::VARCHAR, ';' ORDER BY n) AS ids, bool_or(blocked) AS blocked FROM rp1 GROUP BY 1, 2, 3),
pass3 AS (SELECT g.clip_id, g.team, b.pass_id, g.start_frame, g.end_frame, b.center_frame, b.from_player, b.to_player, b.duration, b.max_speed, b.max_acceleration, b.ball_distance, b.confidence, b.tier, b.consistent, b.frame_gaps, b.rule_reasons, raw_pass_id, CASE WHEN members > 1 THEN ids ELSE '' END AS merged_pass_ids, members, g.blocked OR coalesce(lead(g.blocked) OVER (PARTITION BY g.clip_id, g.team ORDER BY g.grp), false) AS merge_blocked, row_number() OVER (PARTITION BY g.clip_id ORDER BY g.team, g.grp) AS refined_id, b.duration < 0.08::DOUBLE AS h_, g.end_frame - g.start_frame < 2 AS n_, (NOT h_ AND NOT n_ AND b.tier = 'high' AND b.consistent = 1 AND b.frame_gaps = 0)::INT AS weak_eligible, CASE WHEN h_ OR n_ THEN 'suppressed' WHEN members > 1 THEN 'merged' WHEN merge_blocked AND weak_eligible = 0 THEN 'review_only' ELSE 'kept' END AS status, coalesce(nullif(concat_ws(';', CASE WHEN members > 1 THEN 'merged_nearby_same_team_candidates' END, CASE WHEN h_ THEN 'duration_below_0.080s' END, CASE WHEN n_ THEN 'frame_span_below_2' END, CASE WHEN merge_blocked THEN 'merge_blocked_span_too_long' END), ''), 'passes_refinement_checks') AS refinement_reasons, (NOT h_ AND NOT n_)::INT AS review FROM rp2 g JOIN rp1 b ON g.clip_id = b.clip_id AND g.team = b.team AND g.grp = b.grp AND b.best = 1)
"""


def _owners(s, d):
    """Saved, as the candidates' queries read it several times."""
    return saved(fx.owners(s, d))


def _move(s, d):
    return saved(motion.ball_motion(fx.ball(s, d)))


def _carries(s, d, o=None):
    return saved(segments.estimate_carries(o or _owners(s, d), fx.tracks(s, d)))


def _weak(s, d, o=None):
    return segments.weak_passes(segments.stable_segments(o or _owners(s, d)))


def _passes(s, d):
    o = _owners(s, d)
    return saved(candidates.pass_candidates(o, _move(s, d), _weak(s, d, o)))


def _turnovers(s, d):
    o = _owners(s, d)
    return saved(candidates.turnover_candidates(o, _move(s, d), segments.detect_interceptions(o)))


def _shots(s, d):
    o = _owners(s, d)
    return saved(candidates.shot_candidates(o, _move(s, d), _carries(s, d, o)))


def _select(table: str, drop: str, *numbers: str) -> str:
    """The table with its doubles rounded as `rounded` does."""
    return f"SELECT * EXCLUDE ({drop}) REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in numbers)}) FROM {table}" if drop else f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in numbers)}) FROM {table}"


_TIMES, _PEAKS = ("start_timestamp", "end_timestamp"), ("max_speed", "max_acceleration", "ball_distance")


@query("pass_candidates", _ALL + _select("pass2", "", *_TIMES, *_PEAKS, "duration", "lost_share"))
def _(s, d):
    return rounded(_passes(s, d))


@query("turnover_candidates", _ALL + _select("turn", "near_", *_TIMES, *_PEAKS, "winner_distance"))
def _(s, d):
    return rounded(_turnovers(s, d))


@query("shot_candidates", _ALL + _select("shot", "good_", *_TIMES, *_PEAKS, "interpolated_share", "carry_overlap"))
def _(s, d):
    return rounded(_shots(s, d))


@query("merge_peaks", _ALL + "SELECT clip_id, ps AS start_frame, pe AS end_frame, peaks FROM shot0")
def _(s, d):
    limits = candidates.thresholds(_move(s, d), 0.95)
    fast = candidates.event_frames(_owners(s, d), _move(s, d)).join(limits, "clip_id").where("valid and (ball_speed >= speed_limit or ball_acceleration >= acceleration_limit)")
    return segments.merge_peaks(fast)


@query("refine_turnovers", _ALL + _select("turn2", "p_, w_", *_TIMES, *_PEAKS, "winner_distance"))
def _(s, d):
    return rounded(candidates.refine_turnovers(_turnovers(s, d), motion.bounds(fx.frames(s, d))))


@query("refine_shots", _ALL + _select("shot2", "local_, review_", *_TIMES, *_PEAKS, "interpolated_share", "carry_overlap").replace("SELECT *", "SELECT review_::INT AS review, 0 AS weak_eligible, *", 1))
def _(s, d):
    return rounded(candidates.refine_shots(_shots(s, d), _owners(s, d)))


@query("refine_passes", _ALL + _select("pass3", "h_, n_", *_PEAKS, "duration"))
def _(s, d):
    return rounded(candidates.refine_passes(_passes(s, d)))


_NONE = "NULL::VARCHAR"
_UNIFIED = _ALL + f""", u0 AS (SELECT clip_id, 0 AS rank_, 'carry' AS event_type, 'possession_event' AS event_family, 'carry_source' AS source_type, 'existing_carry_detector' AS label_source, carry_id AS source_id, start_frame, end_frame, round_even((start_frame + end_frame) / 2, 0)::BIGINT AS center_frame, CASE WHEN carry_quality_flag = 'ok' THEN 0.8::DOUBLE ELSE 0.4 END AS confidence, 60 AS priority, 1 AS review, (carry_quality_flag = 'ok')::INT AS weak_eligible, team, player_id, NULL::BIGINT AS secondary_player_id, CASE WHEN carry_quality_flag = 'ok' THEN 'high' ELSE 'low' END AS tier, carry_quality_flag AS quality_flag, 'existing_carry_source' AS rule_reasons, {_NONE} AS status, {_NONE} AS refinement_reasons, NULL::DOUBLE AS max_speed, NULL::DOUBLE AS max_acceleration, ball_distance_px AS ball_distance, {_NONE} AS possession_before, {_NONE} AS possession_after, {_NONE} AS subtype FROM carry
UNION ALL SELECT clip_id, 1, 'pass', 'possession_event', 'passes_weak', 'passes_weak_baseline', pass_id, start_frame, end_frame, round_even((start_frame + end_frame) / 2, 0)::BIGINT, confidence, 70, 1, 0, team, from_player, to_player, 'low', {_NONE}, 'passes_weak_source', {_NONE}, {_NONE}, NULL, NULL, NULL, {_NONE}, {_NONE}, {_NONE} FROM weak
UNION ALL SELECT clip_id, 2, 'turnover', 'possession_change', 'interception_source', 'existing_interception_detector', interception_id, frame - 8, frame + 8, frame, 0.85::DOUBLE, 80, 1, 1, winner_team, winner_player_id, previous_player_id, 'high', quality_flag, 'existing_interception_source', {_NONE}, {_NONE}, NULL, NULL, distance_to_ball, previous_team || ':' || previous_player_id, winner_team || ':' || winner_player_id, {_NONE} FROM inter
UNION ALL SELECT clip_id, 3, 'pass', 'possession_event', 'pass_candidate_refined', 'possession_transition_with_ball_motion_heuristic', raw_pass_id, start_frame, end_frame, center_frame, confidence, 70, review, weak_eligible, team, from_player, to_player, tier, 'weak_candidate_not_ground_truth', rule_reasons, status, refinement_reasons, max_speed, max_acceleration, ball_distance, team || ':' || from_player, team || ':' || to_player, {_NONE} FROM pass3
UNION ALL SELECT clip_id, 4, 'turnover', 'possession_change', 'turnover_candidate_refined', 'possession_team_switch_with_interception_anchor', turnover_id, start_frame, end_frame, center_frame, confidence, 80, review, weak_eligible, team, to_player, from_player, tier, 'weak_candidate_not_ground_truth', rule_reasons, status, refinement_reasons, max_speed, max_acceleration, ball_distance, from_team || ':' || from_player, team || ':' || to_player, subtype FROM turn2
UNION ALL SELECT clip_id, 5, 'shot', 'attacking_event', 'shot_candidate_refined', 'heuristic_ball_motion_candidate', shot_id, start_frame, end_frame, center_frame, confidence, 90, review_::INT, 0, {_NONE}, NULL, NULL, tier, 'weak_candidate_not_confirmed_shot', rule_reasons, status, refinement_reasons, max_speed, max_acceleration, ball_distance, {_NONE}, {_NONE}, {_NONE} FROM shot2),
u1 AS (SELECT u.* REPLACE (least(greatest(start_frame, min_frame), max_frame) AS start_frame, least(greatest(end_frame, min_frame), max_frame) AS end_frame, least(greatest(center_frame, min_frame), max_frame) AS center_frame) FROM u0 u JOIN edge e ON u.clip_id = e.clip_id),
u2 AS (SELECT * EXCLUDE (rank_), row_number() OVER (PARTITION BY clip_id ORDER BY start_frame, end_frame, priority DESC, rank_, source_id) AS event_id FROM u1),
u5 AS (SELECT u.*, r.event_id AS duplicate_of FROM u2 u LEFT JOIN u2 r ON u.source_type = 'interception_source' AND r.source_type = 'turnover_candidate_refined' AND r.subtype = 'interception' AND r.clip_id = u.clip_id AND abs(r.center_frame - u.center_frame) <= 2 QUALIFY row_number() OVER (PARTITION BY u.clip_id, u.event_id ORDER BY abs(r.center_frame - u.center_frame), r.event_id) = 1),
u3 AS (SELECT *, sum(CASE WHEN start_frame <= m THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id ORDER BY event_id) AS island FROM (SELECT *, max(end_frame) OVER (PARTITION BY clip_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u5)),
u4 AS (SELECT clip_id, island, row_number() OVER (PARTITION BY clip_id ORDER BY island) AS k FROM u3 GROUP BY clip_id, island HAVING count(*) > 1),
unified AS (SELECT u.* EXCLUDE (m, island, subtype) REPLACE (CASE WHEN duplicate_of IS NULL THEN review ELSE 0 END AS review, CASE WHEN duplicate_of IS NULL THEN weak_eligible ELSE 0 END AS weak_eligible, CASE WHEN duplicate_of IS NULL THEN rule_reasons ELSE rule_reasons || ';duplicate_of_refined_interception_turnover' END AS rule_reasons), 0 AS is_gold_label, CASE WHEN duplicate_of IS NULL THEN '' ELSE 'duplicate_source_available_for_traceability' END AS notes, coalesce(duplicate_of, event_id) AS canonical_event_id, (SELECT arg_min(f."timestamp", abs(f.frame - u.start_frame) * 2 + (f.frame > u.start_frame)::INT) FROM frames f WHERE f.clip_id = u.clip_id) AS start_timestamp, (SELECT arg_min(f."timestamp", abs(f.frame - u.end_frame) * 2 + (f.frame > u.end_frame)::INT) FROM frames f WHERE f.clip_id = u.clip_id) AS end_timestamp, (SELECT arg_min(f."timestamp", abs(f.frame - u.center_frame) * 2 + (f.frame > u.center_frame)::INT) FROM frames f WHERE f.clip_id = u.clip_id) AS center_timestamp, source_type || '.csv' AS source_file, 'mark_only_no_label_resolution' AS overlap_policy, 'overlap_' || k AS overlap_group, (k IS NOT NULL)::INT AS overlap_warning FROM u3 u LEFT JOIN u4 g ON u.clip_id = g.clip_id AND u.island = g.island)
"""


def _unified(s, d):
    o, m, b = _owners(s, d), _move(s, d), motion.bounds(fx.frames(s, d))
    c, weak, met, f = _carries(s, d, o), saved(_weak(s, d, o)), saved(segments.detect_interceptions(o)), saved(candidates.event_frames(o, m))
    passes = saved(candidates.refine_passes(saved(candidates.pass_candidates(o, m, weak, frames=f))))
    turnovers = saved(candidates.refine_turnovers(saved(candidates.turnover_candidates(o, m, met, frames=f)), b))
    shots = saved(candidates.refine_shots(saved(candidates.shot_candidates(o, m, c, frames=f)), o))
    return candidates.unify_events(c, weak, met, passes, turnovers, shots, b, fx.frames(s, d), keep=saved)


@query("unify_events", _UNIFIED + _select("unified", "", *_PEAKS, "start_timestamp", "end_timestamp", "center_timestamp"))
def _(s, d):
    return rounded(_unified(s, d))


_SHAPE = """, who AS (SELECT *, CASE WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team FROM tracks WHERE track_id NOT IN (4, 9)), mid AS (SELECT *, avg(center_x) OVER w AS mx, avg(center_y) OVER w AS my FROM who WINDOW w AS (PARTITION BY clip_id, frame, team)),
per AS (SELECT clip_id, frame, team, count(*) AS players, any_value(mx) AS centroid_x, any_value(my) AS centroid_y, max(center_x) - min(center_x) AS width, max(center_y) - min(center_y) AS depth, avg(sqrt((center_x - mx) * (center_x - mx) + (center_y - my) * (center_y - my))) AS spread FROM mid GROUP BY 1, 2, 3),
shape AS (SELECT f.clip_id, f.frame, f."timestamp", t.team, coalesce(players, 0) AS players, centroid_x, centroid_y, width, depth, spread, players IS NOT NULL AS valid FROM frames f CROSS JOIN (SELECT unnest(['Team A', 'Team B']) AS team) t LEFT JOIN per p ON p.clip_id = f.clip_id AND p.frame = f.frame AND p.team = t.team)
"""


def _shape(s, d):
    return shape.team_shape(frame_table.temporal_frames(fx.tracks(s, d), fx.teams(s, d), fx.ball(s, d), fx.owners(s, d).withColumn("possession_reason", F.lit(""))))


_ROLLED = [f"rolling_{c}_{k}" for c in ("width", "depth", "spread") for k in ("mean", "std")]
_SHAPES = _SHAPE + """, sg AS (SELECT *, frame - lag(frame) OVER w AS gap, "timestamp" - lag("timestamp") OVER w AS dt, coalesce(valid AND lag(valid) OVER w AND frame - lag(frame) OVER w = 1 AND "timestamp" - lag("timestamp") OVER w > 0, false) AS ok FROM shape WINDOW w AS (PARTITION BY clip_id, team ORDER BY frame)),
s0 AS (SELECT *, sum((NOT ok)::INT) OVER w::BIGINT AS sequence_id, """ + ", ".join(f"CASE WHEN ok THEN round({c} - lag({c}) OVER w, 9) END AS {n}" for c, n in (("centroid_x", "centroid_dx"), ("centroid_y", "centroid_dy"), ("width", "width_delta"), ("depth", "depth_delta"), ("spread", "spread_delta"))) + """ FROM sg WINDOW w AS (PARTITION BY clip_id, team ORDER BY frame)),
s1 AS (SELECT *, sqrt(centroid_dx * centroid_dx + centroid_dy * centroid_dy) / dt AS centroid_speed, CASE WHEN valid AND spread > 1e-6 THEN 1 / spread END AS compactness FROM s0),
s2 AS (SELECT clip_id, team, round(quantile_cont(abs(width_delta), 0.9::DOUBLE), 9) AS lw, round(quantile_cont(abs(depth_delta), 0.9::DOUBLE), 9) AS ld, round(quantile_cont(abs(spread_delta), 0.9::DOUBLE), 9) AS ls FROM s1 GROUP BY 1, 2),
feat AS (SELECT s.* EXCLUDE (valid, dt, ok, gap), gap AS frame_gap_from_previous, valid::INT AS valid_mask, (valid AND (coalesce(abs(width_delta) > lw, false) OR coalesce(abs(depth_delta) > ld, false) OR coalesce(abs(spread_delta) > ls, false)))::INT AS shape_change, CASE WHEN ok THEN avg(centroid_speed) OVER r END AS rolling_centroid_speed_mean, """ + ", ".join(f"CASE WHEN valid THEN {f}({c}) FILTER (valid) OVER r END AS rolling_{c}_{k}" for c in ("width", "depth", "spread") for k, f in (("mean", "avg"), ("std", "stddev_pop"))) + """ FROM s1 s JOIN s2 ON s.clip_id = s2.clip_id AND s.team = s2.team WINDOW r AS (PARTITION BY s.clip_id, s.team, sequence_id ORDER BY frame ROWS 24 PRECEDING))
"""
_MEANS = ["mean_centroid_x", "mean_centroid_y", "mean_width", "mean_depth", "mean_spread", "mean_compactness", "mean_centroid_speed", "std_width", "std_depth", "std_spread"]
_SHAPE_SUMS = """count(*) AS "rows", sum(valid_mask)::BIGINT AS valid_rows, """ + ", ".join(f"avg({c}) FILTER (valid_mask = 1) AS mean_{c}" for c in ("centroid_x", "centroid_y", "width", "depth", "spread", "compactness", "centroid_speed")) + ", " + ", ".join(f"stddev_pop({c}) FILTER (valid_mask = 1) AS std_{c}" for c in ("width", "depth", "spread"))
_QUALITY = """valid_rows / "rows" AS valid_share, CASE WHEN valid_rows / "rows" >= 0.7::DOUBLE THEN 'ok' WHEN valid_rows / "rows" >= 0.4::DOUBLE THEN 'partial' ELSE 'low_coverage' END AS quality"""


def _features(s, d):
    """The shapes are saved, as both the limits and the features read them."""
    return shape.shape_temporal_features(saved(_shape(s, d)))


@query("shape_temporal_features", _SHAPES + _select("feat", "", '"timestamp"', "centroid_x", "centroid_y", "width", "depth", "spread", "compactness", "centroid_dx", "centroid_dy", "width_delta", "depth_delta", "spread_delta", "centroid_speed", "rolling_centroid_speed_mean", *_ROLLED))
def _(s, d):
    return rounded(_features(s, d))


@query("shape_5s_summary", _SHAPES + f""", k AS (SELECT *, floor(("timestamp" - min("timestamp") OVER (PARTITION BY clip_id)) / 5.0::DOUBLE)::BIGINT AS "window" FROM feat),
five AS (SELECT clip_id, team, "window", min(frame) AS start_frame, max(frame) AS end_frame, min("timestamp") AS start_timestamp, max("timestamp") AS end_timestamp, {_SHAPE_SUMS}, sum(shape_change)::BIGINT AS shape_changes FROM k GROUP BY 1, 2, 3 HAVING sum(valid_mask) > 0), five1 AS (SELECT *, {_QUALITY} FROM five)
""" + _select("five1", "", *_TIMES, *_MEANS, "valid_share"))
def _(s, d):
    return rounded(shape.shape_5s_summary(_features(s, d)))


@query("team_shape_summary", _SHAPES + f""", whole AS (SELECT clip_id, team, {_SHAPE_SUMS}, """ + ", ".join(f"quantile_cont({c}, 0.5::DOUBLE) FILTER (valid_mask = 1) AS median_{c}" for c in ("width", "depth", "spread")) + f""", sum(shape_change)::BIGINT AS shape_changes FROM feat GROUP BY 1, 2), whole1 AS (SELECT *, {_QUALITY} FROM whole)
""" + _select("whole1", "", *_MEANS, "valid_share", "median_width", "median_depth", "median_spread"))
def _(s, d):
    return rounded(shape.team_shape_summary(_features(s, d)))


_TRAJ = _STEPS + """, t0 AS (SELECT *, sum(CASE WHEN gap = 1 AND dt > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY clip_id, track_id ORDER BY frame)::BIGINT AS segment_id, CASE WHEN gap = 1 AND dt > 0 THEN step / dt END AS speed FROM steps),
traj AS (SELECT clip_id, track_id, frame, gap, segment_id, "timestamp", center_x, center_y, confidence, CASE WHEN gap = 1 AND dt > 0 THEN step END AS step, speed, CASE WHEN gap = 1 AND dt > 0 THEN (speed - lag(speed) OVER w) / dt END AS acceleration FROM t0 WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
sums AS (SELECT clip_id, track_id, min(frame) AS first_frame, max(frame) AS last_frame, min("timestamp") AS first_timestamp, max("timestamp") AS last_timestamp, count(*) AS points, max("timestamp") - min("timestamp") AS seconds, count(speed) AS pairs, count(*) FILTER (gap > 1) AS gap_breaks, coalesce(max(gap), 0) AS max_frame_gap, max(segment_id) AS segments, coalesce(sum(step), 0) AS distance, avg(speed) AS mean_speed, quantile_cont(speed, 0.5::DOUBLE) AS median_speed, max(speed) AS max_speed, avg(abs(acceleration)) AS mean_acceleration, max(abs(acceleration)) AS max_acceleration,
 avg(center_x) AS mean_center_x, min(center_x) AS min_center_x, max(center_x) AS max_center_x, avg(center_y) AS mean_center_y, min(center_y) AS min_center_y, max(center_y) AS max_center_y, avg(confidence) AS mean_confidence, (count(*) FILTER (confidence < 0.3::DOUBLE)) / count(*) AS low_confidence_share FROM traj GROUP BY 1, 2),
mv AS (SELECT *, CASE WHEN track_id IN (4, 9) THEN 'Unknown' WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team, CASE WHEN track_id IN (4, 9) THEN 'referee' WHEN track_id < 5 THEN 'team_a_player' ELSE 'team_b_player' END AS role, CASE WHEN max_frame_gap > 10 OR segments >= 4 THEN 'high' WHEN max_frame_gap > 3 OR segments >= 2 THEN 'medium' ELSE 'low' END AS risk, CASE WHEN pairs >= 2 AND risk <> 'high' THEN 'ok' ELSE 'sparse_track' END AS quality FROM sums)
"""


@query("movement_summary", _TRAJ + _select("mv", "", "first_timestamp", "last_timestamp", "seconds", "distance", "mean_speed", "median_speed", "max_speed", "mean_acceleration", "max_acceleration", "mean_center_x", "mean_center_y", "mean_confidence", "low_confidence_share"))
def _(s, d):
    return rounded(shape.movement_summary(fx.tracks(s, d), fx.teams(s, d)))


@query("movement_temporal_features", _TRAJ + """, lim AS (SELECT clip_id, quantile_cont(speed, 0.9::DOUBLE) AS most FROM traj GROUP BY 1), tt AS (SELECT traj.*, CASE WHEN track_id IN (4, 9) THEN 'Unknown' WHEN track_id < 5 THEN 'Team A' ELSE 'Team B' END AS team FROM traj),
vm AS (SELECT t.clip_id, frame, count(*) AS valid_players, avg(speed) AS mean_speed, max(speed) AS max_speed, avg(abs(acceleration)) AS mean_acceleration, max(abs(acceleration)) AS max_acceleration, count(*) FILTER (speed >= most) AS fast_players, avg(speed) FILTER (team = 'Team A') AS team_a_mean_speed, count(*) FILTER (team = 'Team A') AS team_a_valid_players, avg(speed) FILTER (team = 'Team B') AS team_b_mean_speed, count(*) FILTER (team = 'Team B') AS team_b_valid_players FROM tt t JOIN lim l ON l.clip_id = t.clip_id WHERE speed IS NOT NULL GROUP BY 1, 2),
ga AS (SELECT clip_id, frame, count(*) AS n FROM traj WHERE gap > 1 GROUP BY 1, 2),
mt AS (SELECT f.clip_id, f.frame, f."timestamp", coalesce(valid_players, 0) AS valid_players, mean_speed, max_speed, mean_acceleration, max_acceleration, coalesce(fast_players, 0) AS fast_players, team_a_mean_speed, coalesce(team_a_valid_players, 0) AS team_a_valid_players, team_b_mean_speed, coalesce(team_b_valid_players, 0) AS team_b_valid_players, coalesce(n, 0) AS players_after_gap, (valid_players IS NOT NULL)::INT AS movement_valid FROM frames f LEFT JOIN vm ON vm.clip_id = f.clip_id AND vm.frame = f.frame LEFT JOIN ga ON ga.clip_id = f.clip_id AND ga.frame = f.frame)
""" + _select("mt", "", '"timestamp"', "mean_speed", "max_speed", "mean_acceleration", "max_acceleration", "team_a_mean_speed", "team_b_mean_speed"))
def _(s, d):
    return rounded(shape.movement_temporal_features(fx.tracks(s, d), fx.teams(s, d), fx.frames(s, d)))


_STRANGERS = ", strangers AS (SELECT * REPLACE (CASE WHEN player_id IN (4, 9) THEN 'Unknown' ELSE team END AS team) FROM owners)"


@query("interceptions_among_strangers", _STRANGERS + _INTER.replace("FROM owners", "FROM strangers").replace("JOIN owners", "JOIN strangers").replace("WHERE previous_team <> r.team", "WHERE r.team <> 'Unknown' AND previous_team <> 'Unknown' AND previous_team <> r.team") + 'SELECT * REPLACE (round("timestamp", 6) AS "timestamp") FROM inter')
def _(s, d):
    """Two players whose team isn't known: their runs part the others'."""
    o = fx.owners(s, d)
    return rounded(segments.detect_interceptions(o.withColumn("team", F.when(F.col("player_id").isin(4, 9), "Unknown").otherwise(F.col("team")))))


def _detections(s, d):
    p, f = F.col("det_id"), F.col("frame")
    det = fx.frames(s, d).select("clip_id", "frame", "timestamp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("det_id"))
    return det.where("(frame + 5 * det_id) % 7 <> 0").withColumns({"center_x": ((f * 9 + 400 * p) % 1280).cast("double"), "center_y": ((f * 4 + 150 * p) % 720).cast("double"), "confidence": ((f * 7 + 13 * p) % 100) / 100.0})


@query("link_ball_tracks", None)
def _(s, d):
    return tracking.link_ball_tracks(_detections(s, d))


_FILLED = """, gp AS (SELECT *, lead(frame) OVER w - frame - 1 AS gap, lead(frame) OVER w AS nf, lead("timestamp") OVER w AS nt, lead(center_x) OVER w AS nx, lead(center_y) OVER w AS ny, lead(confidence) OVER w AS nc FROM tracks WHERE frame % 17 < 9 OR track_id % 3 = 0 WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame)),
filled AS (SELECT clip_id, track_id, frame + k AS frame, CASE WHEN k > 0 THEN "timestamp" + k / (gap + 1) * (nt - "timestamp") ELSE "timestamp" END AS "timestamp", CASE WHEN k > 0 THEN center_x + k / (gap + 1) * (nx - center_x) ELSE center_x END AS center_x, CASE WHEN k > 0 THEN center_y + k / (gap + 1) * (ny - center_y) ELSE center_y END AS center_y, CASE WHEN k > 0 THEN least(confidence, nc) ELSE confidence END AS confidence, k > 0 AS is_interpolated FROM (SELECT *, unnest(CASE WHEN gap BETWEEN 1 AND 8 THEN range(gap + 1) ELSE [0] END) AS k FROM gp))
"""


def _filled(s, d):
    """Tracks with gaps, as if they were the ball's."""
    return tracking.with_gaps_filled(fx.tracks(s, d).where("frame % 17 < 9 or track_id % 3 = 0").drop("height"))


@query("ball_gaps_filled", _FILLED + _select("filled", "", "timestamp", "center_x", "center_y", "confidence"))
def _(s, d):
    return rounded(_filled(s, d))


@query("ball_tracking_summary", _FILLED + """, fr AS (SELECT *, is_interpolated AND NOT lag(is_interpolated) OVER (PARTITION BY clip_id, track_id ORDER BY frame) AS first_ FROM filled), pt AS (SELECT clip_id, track_id, count(*) AS n, count(*) FILTER (is_interpolated) AS points, count(*) FILTER (first_) AS gaps FROM fr GROUP BY 1, 2)
SELECT clip_id, count(*) AS tracks, max(n) AS longest, round(avg(n), 6) AS mean_length, sum(points)::BIGINT AS interpolated_points, sum(gaps)::BIGINT AS gaps_filled FROM pt GROUP BY 1""")
def _(s, d):
    return rounded(tracking.ball_tracking_summary(_filled(s, d)))


@query("frame_times", """, det AS (SELECT clip_id, frame, "timestamp" + frame % 3 * 0.001::DOUBLE AS t FROM frames WHERE frame % 7 <> 2 AND frame > 3), du AS (SELECT clip_id, median(d) FILTER (d > 0) AS d, min(frame) AS a, max(frame) AS b FROM (SELECT *, (t - lag(t) OVER w) / (frame - lag(frame) OVER w) AS d FROM det WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) GROUP BY 1)
SELECT s.clip_id, s.frame, round(coalesce(t, s.frame * d), 6) AS "timestamp", t IS NULL AS is_extrapolated FROM (SELECT clip_id, d, unnest(range(a, b + 1)) AS frame FROM du) s LEFT JOIN det ON det.clip_id = s.clip_id AND det.frame = s.frame""")
def _(s, d):
    f = fx.frames(s, d).where("frame % 7 <> 2 and frame > 3").withColumns({"timestamp": F.col("timestamp") + F.col("frame") % 3 * 0.001, "det_id": F.lit(0)})
    return rounded(tracking.frame_times(f))


@query("centroid_track", None)
def _(s, d):
    half = lambda c, k: F.col(c) + F.lit(k)
    boxes = _detections(s, d).withColumns({"class_name": F.when(F.col("frame") % 10 == 9, "ball").otherwise("person"), "x1": half("center_x", -10), "x2": half("center_x", 10), "y1": half("center_y", -20), "y2": half("center_y", 20)})
    return rounded(tracking.centroid_track(boxes))


_BOXES = """, tb AS (SELECT clip_id, frame, track_id AS box_id, center_x AS x1, center_y AS y1, center_x + 40 AS x2, center_y + 80 AS y2, row_number() OVER (PARTITION BY clip_id, frame ORDER BY track_id) - 1 AS i FROM tracks),
fb AS (SELECT * EXCLUDE (i) REPLACE (x1 + frame % 5 * 4 AS x1, x2 + frame % 5 * 4 AS x2), row_number() OVER (PARTITION BY clip_id, frame ORDER BY box_id) AS k FROM tb WHERE (frame + box_id) % 11 <> 0),
ov AS (SELECT p.clip_id, p.frame, k, i, greatest(least(p.x2, q.x2) - greatest(p.x1, q.x1), 0) * greatest(least(p.y2, q.y2) - greatest(p.y1, q.y1), 0) AS both_ FROM fb p JOIN tb q ON p.clip_id = q.clip_id AND p.frame = q.frame),
pr AS (SELECT f.clip_id, f.frame, f.k, coalesce(list({'iou': both_ / (6400 - both_), 'i': o.i} ORDER BY both_ / (6400 - both_) DESC, o.i) FILTER (both_ > 0), []) AS best FROM fb f LEFT JOIN ov o ON o.clip_id = f.clip_id AND o.frame = f.frame AND o.k = f.k GROUP BY 1, 2, 3),
mt AS (SELECT DISTINCT clip_id, frame, 0::BIGINT AS k, []::BIGINT[] AS taken FROM tb UNION ALL SELECT clip_id, frame, k, CASE WHEN one.iou >= 0.5::DOUBLE THEN list_append(taken, one.i) ELSE taken END FROM (SELECT p.clip_id, p.frame, p.k, taken, list_filter(best, lambda x: NOT list_contains(taken, x.i))[1] AS one FROM mt m JOIN pr p ON p.clip_id = m.clip_id AND p.frame = m.frame AND p.k = m.k + 1)),
sums AS (SELECT sum(m) AS tp, sum(nb) - sum(m) AS fp, sum(na) - sum(m) AS fn FROM (SELECT max(len(taken)) AS m, (SELECT count(*) FROM fb WHERE fb.clip_id = t.clip_id AND fb.frame = t.frame) AS nb, (SELECT count(*) FROM tb WHERE tb.clip_id = t.clip_id AND tb.frame = t.frame) AS na FROM mt t GROUP BY t.clip_id, t.frame))
SELECT 'player' AS class_name, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM sums"""


@query("detection_metrics", _BOXES)
def _(s, d):
    t = fx.tracks(s, d).select("clip_id", "frame", F.lit("player").alias("class_name"), F.col("track_id").alias("box_id"), F.col("center_x").alias("x1"), F.col("center_y").alias("y1"), (F.col("center_x") + 40).alias("x2"), (F.col("center_y") + 80).alias("y2"))
    shift = F.col("frame") % 5 * 4
    found = t.where("(frame + box_id) % 11 <> 0").withColumns({"x1": F.col("x1") + shift, "x2": F.col("x2") + shift})
    return rounded(tracking.detection_metrics(t, found))


_SPLIT = _HOP + ", sp AS (SELECT clip_id, CASE WHEN row_number() OVER (ORDER BY clip_id) <= 6 THEN 'train' WHEN row_number() OVER (ORDER BY clip_id) <= 7 THEN 'val' ELSE 'test' END AS split FROM (SELECT DISTINCT clip_id FROM win)), sw AS (SELECT win.*, split FROM win JOIN sp ON win.clip_id = sp.clip_id)"


def _split(s, d):
    w = _windows(s, d)
    return w.join(metrics.clip_split(w), "clip_id")


@query("balance_windows", _SPLIT + ", c AS (SELECT split, min(n) AS cap FROM (SELECT split, target_class, count(*) AS n FROM sw GROUP BY 1, 2) GROUP BY 1) SELECT * EXCLUDE (r, cap) FROM (SELECT sw.*, cap, row_number() OVER (PARTITION BY sw.split, target_class ORDER BY (start_frame * 2654435761 + clip_id * 40503 + 42) % 1000003, clip_id, start_frame) AS r FROM sw JOIN c ON sw.split = c.split) WHERE r <= cap")
def _(s, d):
    return reports.balance_windows(_split(s, d), "target_class")


@query("normalise_windows", _SPLIT + ", st AS (SELECT avg(event_overlap_frames) AS m, stddev_pop(event_overlap_frames) AS sd FROM sw WHERE split = 'train') SELECT clip_id, start_frame, split, round((event_overlap_frames - m) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS event_overlap_frames FROM sw CROSS JOIN st")
def _(s, d):
    return rounded(reports.normalise(_split(s, d).select("clip_id", "start_frame", "split", F.col("event_overlap_frames").cast("double").alias("event_overlap_frames")), ["event_overlap_frames"]))


@query("readiness", """, f0 AS (SELECT clip_id, max(frame) - min(frame) + 1 AS frame_count, count(ball_x) > 0 OR count(distance_to_ball) > 0 AS usable FROM owners WHERE clip_id <> 7 GROUP BY 1),
e0 AS (SELECT clip_id, count(*) AS event_rows, count(*) FILTER (regexp_matches(label, '^(pass|turnover|interception|shot|carry)')) AS events_ok FROM intervals WHERE clip_id NOT IN (2, 5) GROUP BY 1),
c0 AS (SELECT DISTINCT clip_id FROM frames), n0 AS (SELECT c0.clip_id, coalesce(frame_count, 0) AS frame_count, coalesce(usable, false) AS usable, coalesce(event_rows, 0) AS event_rows, coalesce(events_ok, 0) AS events_ok, (coalesce(frame_count, 0) >= 64)::INT AS background_possible, c0.clip_id = 3 AS no_tracks FROM c0 LEFT JOIN f0 ON c0.clip_id = f0.clip_id LEFT JOIN e0 ON c0.clip_id = e0.clip_id),
n1 AS (SELECT *, concat_ws(';', CASE WHEN frame_count = 0 THEN 'missing temporal_frames' END, CASE WHEN event_rows = 0 THEN 'missing unified_candidates' END, CASE WHEN no_tracks THEN 'missing tracks' END, CASE WHEN frame_count > 0 AND NOT usable THEN 'no usable numeric temporal features found' END, CASE WHEN event_rows > 0 AND events_ok = 0 AND background_possible = 0 THEN 'no valid candidate events and not enough frames for background' END) AS reasons, CASE WHEN event_rows > 0 AND events_ok = 0 AND background_possible = 1 THEN 'no valid candidate events; background only' ELSE '' END AS warnings FROM n0)
SELECT clip_id, frame_count, event_rows, events_ok, background_possible, reasons, warnings, CASE WHEN reasons <> '' THEN 'NOT_READY' WHEN warnings <> '' THEN 'READY_WITH_WARNINGS' ELSE 'READY' END AS status FROM n1""")
def _(s, d):
    """Clip 7 lacks its frames, 2 and 5 their candidates, 3 its tracks."""
    o = _owners(s, d)
    clips = fx.frames(s, d).select("clip_id").distinct()
    others = {"tracks": fx.tracks(s, d).where("clip_id <> 3"), "ball_tracks": fx.ball(s, d), "team_assignments": fx.teams(s, d), "possession": o}
    return reports.readiness(clips, o.where("clip_id <> 7"), ["ball_x", "distance_to_ball"], fx.intervals(s, d).withColumnRenamed("label", "event_type").where("clip_id not in (2, 5)"), others)
