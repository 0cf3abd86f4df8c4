"""Plausibility of passes from their features, and the list of passes to review. All expressions of one row; only the list's order shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import flag

#: What a feature adds to the score and the reason it gives, in the order in which reasons are listed.
RULES = [
    ("same_team = 1", 0.20, "same_team_sender_receiver_confirmed"),
    ("same_team = 0", -0.25, "same_team_sender_receiver_false"),
    ("sender_stable >= {stable}", 0.15, "sender_stable_before_release"),
    ("receiver_stable >= {stable}", 0.15, "receiver_stable_after_receipt"),
    ("free_ball > 0", 0.10, "free_ball_phase_detected"),
    ("duration BETWEEN 2 AND {longest}", 0.10, "duration_plausible"),
    ("duration > {longest}", -0.10, "duration_too_long"),
    ("ball_distance > 0", 0.10, "ball_distance_plausible"),
    ("above_baseline = 1", 0.10, "ball_motion_confirmed"),
    ("above_baseline IS NULL", 0.0, "ball_speed_baseline_unavailable"),
    ("above_baseline = 0 AND speed_peak IS NOT NULL", 0.0, "ball_speed_not_above_baseline"),
    ("missing <= {missing}", 0.05, "ball_missing_fraction_ok"),
    ("missing > {missing}", -0.10, "high_ball_missing"),
    ("interpolated <= {interpolated}", 0.05, "ball_interpolation_fraction_ok"),
    ("interpolated > {interpolated}", -0.10, "high_ball_interpolation"),
    ("flicker = 1", -0.20, "possession_flicker_penalty"),
    ("carry_overlap > 0.20D", -0.15, "carry_overlap_penalty"),
    ("turnover_overlap > 0.20D", -0.15, "turnover_overlap_penalty"),
    ("coalesce(completeness, 0) < 0.60D", -0.10, "insufficient_feature_coverage"),
]
LIMITS = {"stable": 4, "longest": 24, "missing": "0.25D", "interpolated": "0.25D"}
#: The columns that a reviewer fills in.
MANUAL = ("manual_label", "manual_confidence", "manual_release_frame", "manual_receiver_control_frame", "manual_reviewer", "manual_review_notes", "manual_reviewed_at", "manual_override_weak_label")


def _clamped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _tier(c: str) -> Column:
    return F.when(F.col(c) >= 0.70, "high").when(F.col(c) >= 0.45, "medium").otherwise("low")


def _listed(*pairs: tuple[Column, str]) -> Column:
    """The reasons that hold, as a list."""
    return F.filter(F.array(*(F.when(flag(c), F.lit(r)) for c, r in pairs)), lambda x: x.isNotNull())


def _covered(missing: str = "missing", interpolated: str = "interpolated") -> Column:
    return F.expr(f"{missing} <= {LIMITS['missing']} AND {interpolated} <= {LIMITS['interpolated']}")


def score_passes_strict(features: DataFrame) -> DataFrame:
    """Adds score (0 to 1), tier, status, reasons and weak_label (1: may be trained on). A missing feature adds nothing, missing completeness counts as 0."""
    rules = [(F.expr(c.format(**LIMITS)), w, r) for c, w, r in RULES]
    total = F.lit(0.0)
    for c, w, _ in rules:
        total = total + F.when(flag(c), F.lit(w)).otherwise(0.0)
    df = features.withColumn("score", _clamped(total)).withColumn("tier", _tier("score"))
    weak = flag((F.col("score") >= 0.70) & F.expr("refined_eligible = 1 AND same_team = 1 AND coalesce(flicker, 0) = 0") & _covered())
    status = F.when(weak, "weak_label_candidate").when(F.col("score") >= 0.45, "accepted_for_review").otherwise("rejected_or_insufficient_evidence")
    return df.withColumns({"status": status, "reasons": F.array_join(_listed(*((c, r) for c, _, r in rules)), ";"), "weak_label": weak.cast("int")})


def score_passes_calibrated(scored: DataFrame) -> DataFrame:
    """Adds calibrated_score, _tier, _status, _reasons and _weak_label to strictly scored passes: a pass soon after a turnover isn't punished for it.

    Expects post_turnover and recovery (1: the pass follows a turnover closely, or
    the recovery of the ball by the same team). Recovery goes first; it forgives
    flicker too, and a receiver's two stable frames then do.
    """
    recovery = flag(F.col("recovery") == 1)
    post = ~recovery & flag(F.col("post_turnover") == 1)
    turned, flicker = flag(F.col("turnover_overlap") > 0.20), flag(F.col("flicker") == 1)
    carried, same = flag(F.col("carry_overlap") > 0.20), flag(F.col("same_team") == 1)
    forgiven, add = recovery | post, lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    df = scored.withColumn("calibrated_score", _clamped(F.col("score") + add(forgiven & turned, 0.15) + add(recovery & flicker, 0.20) + add(forgiven, 0.05))).withColumn("calibrated_tier", _tier("calibrated_score"))
    needed = F.when(recovery, 2).otherwise(LIMITS["stable"])
    stable = flag((F.col("sender_stable") >= LIMITS["stable"]) & (F.col("receiver_stable") >= needed))
    weak = flag((F.col("calibrated_score") >= 0.70) & same & stable & _covered() & (F.col("carry_overlap") <= 0.20) & (~flicker | recovery))
    before = F.filter(F.split("reasons", ";"), lambda x: (x != "") & ~(forgiven & turned & (x == "turnover_overlap_penalty")) & ~(recovery & flicker & (x == "possession_flicker_penalty")))
    after = _listed(
        (recovery, "recovery_to_pass_context_confirmed"),
        (recovery, "recovery_turnover_overlap_penalty_suppressed"),
        (recovery, "recovery_possession_flicker_penalty_suppressed"),
        (post, "post_turnover_pass_context_confirmed"),
        (post & turned, "turnover_overlap_penalty_suppressed"),
        (F.col("calibrated_tier") == "high", "calibrated_high_score"),
        (F.col("calibrated_tier") == "medium", "calibrated_medium_score"),
        (F.col("calibrated_tier") == "low", "calibrated_low_score"),
        (same, "same_team_sender_receiver_confirmed"),
        (recovery, "recovery_receiver_stability_threshold_applied"),
        (stable, "stable_sender_receiver_confirmed"),
        (F.expr(f"interpolated > {LIMITS['interpolated']}"), "high_ball_interpolation"),
        (carried, "carry_overlap_penalty"),
        (flicker & ~recovery, "possession_flicker_penalty"),
        (F.coalesce("completeness", F.lit(0.0)) < 0.60, "insufficient_feature_coverage"),
        (weak, "calibrated_weak_label_eligible"),
    )
    status = F.when(weak, "weak_label_candidate_calibrated").when(F.col("calibrated_score") >= 0.45, "accepted_for_review_calibrated").otherwise("rejected_or_insufficient_evidence_calibrated")
    return df.withColumns({"calibrated_status": status, "calibrated_weak_label": weak.cast("int"), "needed_receiver_frames": needed, "calibrated_reasons": F.array_join(F.array_distinct(F.concat(before, after)), ";")})


def review_manifest(scored: DataFrame, before: int = 20, after: int = 20) -> DataFrame:
    """The scored passes with the frames to look at, a priority and empty columns for the reviewer: those to be trained on first, then by falling score, clip and centre."""
    priority = F.when(flag((F.col("weak_label") == 1) | (F.col("tier") == "high")), "high_priority").when(F.col("tier") == "medium", "medium_priority").otherwise("low_priority")
    df = scored.withColumns({"context_start_frame": F.greatest(F.lit(0), F.col("start_frame") - before), "context_end_frame": F.greatest(F.lit(0), F.col("end_frame") + after), "review_priority": priority} | {c: F.lit("") for c in MANUAL})
    return df.orderBy(F.coalesce("weak_label", F.lit(0)).desc(), F.coalesce("score", F.lit(-1.0)).desc(), "clip_id", F.asc_nulls_last("center_frame"))
