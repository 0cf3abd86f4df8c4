"""Queries of the scoring of passes, the marking of interceptions and the status tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import candidates, motion, pass_features, possession, reports, scoring, segments
from ..sources import fixtures as fx
from .catalog import _INTER, query, rounded
from .event_queries import _ALL, _carries, _move, _passes, _turnovers

_STRICT = """, k0 AS (SELECT *, missing <= 0.25::DOUBLE AND interpolated <= 0.25::DOUBLE AS seen,
 CASE WHEN same_team = 1 THEN 0.2::DOUBLE WHEN same_team = 0 THEN -0.25 ELSE 0 END + CASE WHEN sender_stable >= 4 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN receiver_stable >= 4 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN free_ball > 0 THEN 0.1::DOUBLE ELSE 0 END
 + CASE WHEN duration BETWEEN 2 AND 24 THEN 0.1::DOUBLE WHEN duration > 24 THEN -0.1 ELSE 0 END + CASE WHEN ball_distance > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN above_baseline = 1 THEN 0.1::DOUBLE ELSE 0 END
 + CASE WHEN missing <= 0.25::DOUBLE THEN 0.05::DOUBLE WHEN missing > 0.25::DOUBLE THEN -0.1 ELSE 0 END + CASE WHEN interpolated <= 0.25::DOUBLE THEN 0.05::DOUBLE WHEN interpolated > 0.25::DOUBLE THEN -0.1 ELSE 0 END
 + CASE WHEN flicker = 1 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN carry_overlap > 0.2::DOUBLE THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN turnover_overlap > 0.2::DOUBLE THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN coalesce(completeness, 0) < 0.6::DOUBLE THEN -0.1::DOUBLE ELSE 0 END AS total,
 concat_ws(';', CASE same_team WHEN 1 THEN 'same_team_sender_receiver_confirmed' WHEN 0 THEN 'same_team_sender_receiver_false' END, CASE WHEN sender_stable >= 4 THEN 'sender_stable_before_release' END, CASE WHEN receiver_stable >= 4 THEN 'receiver_stable_after_receipt' END, CASE WHEN free_ball > 0 THEN 'free_ball_phase_detected' END, CASE WHEN duration BETWEEN 2 AND 24 THEN 'duration_plausible' WHEN duration > 24 THEN 'duration_too_long' END, CASE WHEN ball_distance > 0 THEN 'ball_distance_plausible' END, CASE WHEN above_baseline = 1 THEN 'ball_motion_confirmed' WHEN above_baseline IS NULL THEN 'ball_speed_baseline_unavailable' WHEN speed_peak IS NOT NULL THEN 'ball_speed_not_above_baseline' END, CASE WHEN missing <= 0.25::DOUBLE THEN 'ball_missing_fraction_ok' WHEN missing > 0.25::DOUBLE THEN 'high_ball_missing' END, CASE WHEN interpolated <= 0.25::DOUBLE THEN 'ball_interpolation_fraction_ok' WHEN interpolated > 0.25::DOUBLE THEN 'high_ball_interpolation' END, CASE WHEN flicker = 1 THEN 'possession_flicker_penalty' END, CASE WHEN carry_overlap > 0.2::DOUBLE THEN 'carry_overlap_penalty' END, CASE WHEN turnover_overlap > 0.2::DOUBLE THEN 'turnover_overlap_penalty' END, CASE WHEN coalesce(completeness, 0) < 0.6::DOUBLE THEN 'insufficient_feature_coverage' END) AS reasons
 FROM pass_features),
k1 AS (SELECT *, greatest(0, least(1, total)) AS score FROM k0),
k2 AS (SELECT *, CASE WHEN score >= 0.7::DOUBLE THEN 'high' WHEN score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS tier, (score >= 0.7::DOUBLE AND refined_eligible = 1 AND same_team = 1 AND flicker = 0 AND seen) IS TRUE AS weak FROM k1),
strict AS (SELECT * EXCLUDE (total, weak), CASE WHEN weak THEN 'weak_label_candidate' WHEN score >= 0.45::DOUBLE THEN 'accepted_for_review' ELSE 'rejected_or_insufficient_evidence' END AS status, weak::INT AS weak_label FROM k2)
"""
_CALIBRATED = _STRICT + """, c0 AS (SELECT *, recovery = 1 AS r, recovery = 0 AND post_turnover = 1 AS p, recovery = 1 OR post_turnover = 1 AS ok, turnover_overlap > 0.2::DOUBLE AS turned FROM strict),
c1 AS (SELECT *, greatest(0, least(1, score + CASE WHEN ok AND turned THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN r AND flicker = 1 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN ok THEN 0.05::DOUBLE ELSE 0 END)) AS calibrated_score, CASE WHEN r THEN 2 ELSE 4 END AS needed_receiver_frames FROM c0),
c2 AS (SELECT *, CASE WHEN calibrated_score >= 0.7::DOUBLE THEN 'high' WHEN calibrated_score >= 0.45::DOUBLE THEN 'medium' ELSE 'low' END AS calibrated_tier, sender_stable >= 4 AND receiver_stable >= needed_receiver_frames AS firm FROM c1),
c3 AS (SELECT *, (calibrated_score >= 0.7::DOUBLE AND same_team = 1 AND firm AND seen AND carry_overlap <= 0.2::DOUBLE AND (flicker = 0 OR r)) IS TRUE AS weak FROM c2),
c4 AS (SELECT *, string_split(reasons, ';') AS was, [CASE WHEN r THEN 'recovery_to_pass_context_confirmed' END, CASE WHEN r THEN 'recovery_turnover_overlap_penalty_suppressed' END, CASE WHEN r THEN 'recovery_possession_flicker_penalty_suppressed' END, CASE WHEN p THEN 'post_turnover_pass_context_confirmed' END, CASE WHEN p AND turned THEN 'turnover_overlap_penalty_suppressed' END, 'calibrated_' || calibrated_tier || '_score', CASE WHEN same_team = 1 THEN 'same_team_sender_receiver_confirmed' END, CASE WHEN r THEN 'recovery_receiver_stability_threshold_applied' END, CASE WHEN firm THEN 'stable_sender_receiver_confirmed' END, CASE WHEN interpolated > 0.25::DOUBLE THEN 'high_ball_interpolation' END, CASE WHEN carry_overlap > 0.2::DOUBLE THEN 'carry_overlap_penalty' END, CASE WHEN flicker = 1 AND NOT r THEN 'possession_flicker_penalty' END, CASE WHEN coalesce(completeness, 0) < 0.6::DOUBLE THEN 'insufficient_feature_coverage' END, CASE WHEN weak THEN 'calibrated_weak_label_eligible' END] AS more FROM c3),
c5 AS (SELECT *, list_concat([CASE WHEN (ok AND turned AND x = 'turnover_overlap_penalty') OR (r AND flicker = 1 AND x = 'possession_flicker_penalty') THEN NULL ELSE x END FOR x IN was], more) AS said FROM c4),
c6 AS (SELECT clip_id, pass_id, u.x, min(u.i) AS i FROM (SELECT clip_id, pass_id, unnest(said) AS x, unnest(range(len(said))) AS i FROM c5) u WHERE x IS NOT NULL GROUP BY 1, 2, 3),
c7 AS (SELECT clip_id, pass_id, string_agg(x, ';' ORDER BY i) AS calibrated_reasons FROM c6 GROUP BY 1, 2)
SELECT c.clip_id, c.pass_id, round(calibrated_score, 6) AS calibrated_score, calibrated_tier, CASE WHEN weak THEN 'weak_label_candidate_calibrated' WHEN calibrated_score >= 0.45::DOUBLE THEN 'accepted_for_review_calibrated' ELSE 'rejected_or_insufficient_evidence_calibrated' END AS calibrated_status, weak::INT AS calibrated_weak_label, needed_receiver_frames, calibrated_reasons FROM c5 c JOIN c7 ON c.clip_id = c7.clip_id AND c.pass_id = c7.pass_id"""


def _scored(s, d):
    return scoring.score_passes_strict(fx.pass_features(s, d))


@query("score_passes_strict", _STRICT + "SELECT clip_id, pass_id, round(score, 6) AS score, tier, status, reasons, weak_label FROM strict")
def _(s, d):
    return rounded(_scored(s, d).select("clip_id", "pass_id", "score", "tier", "status", "reasons", "weak_label"))


@query("score_passes_calibrated", _CALIBRATED)
def _(s, d):
    df = scoring.score_passes_calibrated(_scored(s, d))
    return rounded(df.select("clip_id", "pass_id", "calibrated_score", "calibrated_tier", "calibrated_status", "calibrated_weak_label", "needed_receiver_frames", "calibrated_reasons"))


@query("review_manifest", _STRICT + "SELECT clip_id, pass_id, round(score, 6) AS score, tier, weak_label, greatest(0, start_frame - 20) AS context_start_frame, greatest(0, end_frame + 20) AS context_end_frame, CASE WHEN weak_label = 1 OR tier = 'high' THEN 'high_priority' WHEN tier = 'medium' THEN 'medium_priority' ELSE 'low_priority' END AS review_priority, '' AS manual_label FROM strict")
def _(s, d):
    return rounded(scoring.review_manifest(_scored(s, d)).select("clip_id", "pass_id", "score", "tier", "weak_label", "context_start_frame", "context_end_frame", "review_priority", "manual_label"))


@query("mark_interceptions", _INTER + """, ev AS (SELECT clip_id, event_id, 'turnover_candidate_refined' AS source_type, CASE event_id % 3 WHEN 0 THEN 'interception' WHEN 1 THEN '' END AS subtype, start_frame AS center_frame, 'seen' AS notes FROM intervals UNION ALL SELECT clip_id, 1000000 + interception_id, 'interception_source', '', frame, '' FROM inter),
hit AS (SELECT a.clip_id, a.event_id, b.event_id AS other, row_number() OVER (PARTITION BY a.clip_id, a.event_id ORDER BY abs(a.center_frame - b.center_frame), b.event_id) AS k FROM ev a JOIN ev b ON a.clip_id = b.clip_id AND a.source_type = 'interception_source' AND b.source_type <> 'interception_source' AND abs(a.center_frame - b.center_frame) <= 2)
SELECT e.clip_id, e.event_id, source_type, subtype, center_frame, CASE WHEN other IS NULL THEN 1 ELSE 0 END AS weak_eligible, CASE WHEN other IS NULL THEN 1 ELSE 0 END AS review, CASE WHEN other IS NULL THEN notes ELSE 'duplicate_source_available_for_traceability' END AS notes, CASE WHEN other IS NULL THEN 'rule' ELSE 'rule;duplicate_of_refined_interception_turnover' END AS rule_reasons, coalesce(other, e.event_id) AS canonical_event_id, other AS duplicate_of FROM ev e LEFT JOIN hit h ON e.clip_id = h.clip_id AND e.event_id = h.event_id AND k = 1""")
def _(s, d):
    turnovers = fx.intervals(s, d).selectExpr("clip_id", "event_id", "'turnover_candidate_refined' AS source_type", "CASE event_id % 3 WHEN 0 THEN 'interception' WHEN 1 THEN '' END AS subtype", "start_frame AS center_frame", "'seen' AS notes")
    sources = segments.detect_interceptions(fx.owners(s, d)).selectExpr("clip_id", "1000000 + interception_id AS event_id", "'interception_source' AS source_type", "'' AS subtype", "frame AS center_frame", "'' AS notes")
    return candidates.mark_interceptions(turnovers.unionByName(sources).selectExpr("*", "1 AS weak_eligible", "1 AS review", "'rule' AS rule_reasons"))


_STAGES = ["possession", "passes", "turnovers", "shots"]


@query("stage_status", """, st AS (SELECT clip_id, ['possession','passes','turnovers','shots'][event_id % 4 + 1] AS stage, CASE WHEN (clip_id * 3 + event_id) % 5 = 0 THEN 'failed' ELSE 'ok' END AS status FROM intervals),
g AS (SELECT clip_id, coalesce(max(status) FILTER (stage = 'possession'), 'missing') AS possession, coalesce(max(status) FILTER (stage = 'passes'), 'missing') AS passes, coalesce(max(status) FILTER (stage = 'turnovers'), 'missing') AS turnovers, coalesce(max(status) FILTER (stage = 'shots'), 'missing') AS shots FROM st GROUP BY 1)
SELECT *, CASE WHEN possession = 'ok' AND passes = 'ok' AND turnovers = 'ok' AND shots = 'ok' THEN 'ok' ELSE 'failed' END AS final_status FROM g""")
def _(s, d):
    stage = F.element_at(F.array(*map(F.lit, _STAGES)), (F.col("event_id") % 4 + 1).cast("int"))
    st = fx.intervals(s, d).select("clip_id", stage.alias("stage"), F.expr("CASE WHEN (clip_id * 3 + event_id) % 5 = 0 THEN 'failed' ELSE 'ok' END").alias("status"))
    return reports.stage_status(st, _STAGES)


@query("download_order", 'SELECT clip_id, event_id, label, end_frame - start_frame AS score, row_number() OVER (PARTITION BY label ORDER BY end_frame - start_frame DESC, clip_id * 1000000 + event_id) AS turn FROM intervals')
def _(s, d):
    items = fx.intervals(s, d).selectExpr("clip_id", "event_id", "label", "end_frame - start_frame AS score", "clip_id * 1000000 + event_id AS k")
    return reports.download_order(items, "label", "score", "k").drop("k")


_FEATURES = _ALL + """, own0 AS (SELECT *, CASE WHEN team <> 'None' AND player_id >= 0 THEN team || '/' || player_id END AS own FROM owners),
own1 AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM own0),
st AS (SELECT o.clip_id, o.frame, own, own <> was AS changed, 2 * distance_to_ball AS dist, ball_x, ball_y, is_interpolated, speed FROM own1 o LEFT JOIN motion m ON o.clip_id = m.clip_id AND o.frame = m.frame),
x AS (SELECT p.clip_id, p.pass_id, p.start_frame, p.end_frame, st.* EXCLUDE (clip_id) FROM pass2 p JOIN st ON p.clip_id = st.clip_id AND st.frame BETWEEN p.start_frame - 10 AND p.end_frame + 10),
back AS (SELECT clip_id, pass_id, any_value(o) AS o, CASE WHEN any_value(o) IS NULL THEN 0 ELSE coalesce(min(k) FILTER (own IS DISTINCT FROM o) - 1, count(*)) END AS n FROM (SELECT *, row_number() OVER w AS k, first_value(own) OVER w AS o FROM x WHERE frame < start_frame WINDOW w AS (PARTITION BY clip_id, pass_id ORDER BY frame DESC)) GROUP BY 1, 2),
ahead AS (SELECT clip_id, pass_id, any_value(o) AS o, CASE WHEN any_value(o) IS NULL THEN 0 ELSE coalesce(min(k) FILTER (own IS DISTINCT FROM o) - 1, count(*)) END AS n FROM (SELECT *, row_number() OVER w AS k, first_value(own) OVER w AS o FROM x WHERE frame > end_frame WINDOW w AS (PARTITION BY clip_id, pass_id ORDER BY frame)) GROUP BY 1, 2),
span AS (SELECT clip_id, pass_id, count(*) FILTER (dist > 35) AS free_ball, max(speed) AS speed_peak, count(*) FILTER (ball_x IS NULL) / count(*) AS missing, count(*) FILTER (is_interpolated) / count(*) AS interpolated, (count(*) FILTER (changed) > 1)::INT AS flicker, CASE WHEN count(ball_x) > 1 THEN sqrt((arg_max(ball_x, frame) - arg_min(ball_x, frame)) ^ 2 + (arg_max(ball_y, frame) - arg_min(ball_y, frame)) ^ 2) END AS ball_distance FROM x WHERE frame BETWEEN start_frame AND end_frame GROUP BY 1, 2),
calm AS (SELECT clip_id, pass_id, median(speed) AS base FROM x WHERE frame < start_frame GROUP BY 1, 2),
co AS (SELECT p.clip_id, p.pass_id, max(least(p.end_frame, e.end_frame) - greatest(p.start_frame, e.start_frame) + 1) AS n FROM pass2 p JOIN carry e ON p.clip_id = e.clip_id AND e.start_frame <= p.end_frame AND e.end_frame >= p.start_frame GROUP BY 1, 2),
ov AS (SELECT p.clip_id, p.pass_id, max(least(p.end_frame, e.end_frame) - greatest(p.start_frame, e.start_frame) + 1) AS n FROM pass2 p JOIN turn2 e ON p.clip_id = e.clip_id AND e.start_frame <= p.end_frame AND e.end_frame >= p.start_frame GROUP BY 1, 2),
ft AS (SELECT p.clip_id, p.pass_id, p.start_frame, p.end_frame, p.team, p.end_frame - p.start_frame + 1 AS duration, (split_part(b.o, '/', 1) = split_part(a.o, '/', 1))::INT AS same_team, coalesce(b.n, 0) AS sender_stable, coalesce(a.n, 0) AS receiver_stable, coalesce(free_ball, 0) AS free_ball, span.ball_distance, speed_peak, (speed_peak > base)::INT AS above_baseline, missing, interpolated, coalesce(flicker, 0) AS flicker, coalesce(co.n, 0) / (p.end_frame - p.start_frame + 1) AS carry_overlap, coalesce(ov.n, 0) / (p.end_frame - p.start_frame + 1) AS turnover_overlap
 FROM pass2 p LEFT JOIN back b ON p.clip_id = b.clip_id AND p.pass_id = b.pass_id LEFT JOIN ahead a ON p.clip_id = a.clip_id AND p.pass_id = a.pass_id LEFT JOIN span ON p.clip_id = span.clip_id AND p.pass_id = span.pass_id LEFT JOIN calm c ON p.clip_id = c.clip_id AND p.pass_id = c.pass_id LEFT JOIN co ON p.clip_id = co.clip_id AND p.pass_id = co.pass_id LEFT JOIN ov ON p.clip_id = ov.clip_id AND p.pass_id = ov.pass_id),
near0 AS (SELECT ft.clip_id, pass_id, min(abs(t.end_frame - ft.start_frame)) AS turnover_distance FROM ft JOIN turn2 t ON t.clip_id = ft.clip_id AND abs(t.end_frame - ft.start_frame) <= 5 GROUP BY 1, 2),
last0 AS (SELECT ft.clip_id, pass_id, t.end_frame AS at, t.team AS winner, row_number() OVER (PARTITION BY ft.clip_id, pass_id ORDER BY t.end_frame DESC, t.turnover_id) AS k FROM ft JOIN turn2 t ON t.clip_id = ft.clip_id AND t.end_frame BETWEEN ft.start_frame - 3 AND ft.end_frame)
"""


def _featured(s, d):
    owners = fx.owners(s, d).withColumn("distance_to_ball", 2 * F.col("distance_to_ball"))
    states = owners.join(_move(s, d).select("clip_id", "frame", "ball_speed"), ["clip_id", "frame"], "left").join(possession.possession_changes(owners).select("clip_id", "frame", "possession_changed"), ["clip_id", "frame"])
    turnovers = candidates.refine_turnovers(_turnovers(s, d), motion.bounds(fx.frames(s, d)))
    passes = _passes(s, d).select("clip_id", "pass_id", "start_frame", "end_frame", "team")
    return pass_features.pass_features(passes, states, _carries(s, d), turnovers), turnovers


_ROUNDED = "* REPLACE (round(ball_distance, 6) AS ball_distance, round(speed_peak, 6) AS speed_peak, round(missing, 6) AS missing, round(interpolated, 6) AS interpolated, round(carry_overlap, 6) AS carry_overlap, round(turnover_overlap, 6) AS turnover_overlap)"


@query("pass_features", _FEATURES + f"SELECT {_ROUNDED} FROM ft")
def _(s, d):
    return rounded(_featured(s, d)[0].drop("completeness"))


@query("pass_context", _FEATURES + """, good AS (SELECT ft.*, turnover_distance, ft.end_frame - l.at AS recovery_frames, winner, (same_team = 1 AND sender_stable >= 4 AND carry_overlap <= 0.2::DOUBLE AND missing <= 0.25::DOUBLE AND interpolated <= 0.25::DOUBLE) IS TRUE AS fit FROM ft LEFT JOIN near0 n ON n.clip_id = ft.clip_id AND n.pass_id = ft.pass_id LEFT JOIN last0 l ON l.clip_id = ft.clip_id AND l.pass_id = ft.pass_id AND k = 1)
SELECT clip_id, pass_id, turnover_distance, recovery_frames, (fit AND turnover_distance IS NOT NULL AND receiver_stable >= 4)::INT AS post_turnover, (fit AND recovery_frames >= 2 AND winner = team AND receiver_stable >= 2 AND free_ball >= 2) IS TRUE AS recovered FROM good""")
def _(s, d):
    df, turnovers = _featured(s, d)
    return pass_features.pass_context(df, turnovers).select("clip_id", "pass_id", "turnover_distance", "recovery_frames", "post_turnover", (F.col("recovery") == 1).alias("recovered"))
