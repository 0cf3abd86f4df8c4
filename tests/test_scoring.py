"""Scoring, features and marking of passes on small cases: missing values, empty tables, ties."""

from pyspark.sql import functions as F

from touchline.operators import candidates, pass_features, scoring

COLUMNS = "clip_id long, pass_id long, start_frame long, end_frame long, center_frame long, same_team int, sender_stable long, receiver_stable long, free_ball long, duration long, ball_distance double, above_baseline int, speed_peak double, missing double, interpolated double, flicker int, carry_overlap double, turnover_overlap double, completeness double, refined_eligible int, post_turnover int, recovery int"
BEST = (1, 1, 10, 20, 15, 1, 6, 6, 2, 11, 50.0, 1, 90.0, 0.0, 0.0, 0, 0.0, 0.0, 1.0, 1, 0, 0)


def test_best_and_unknown_pass(spark):
    rows = [BEST, (1, 2, 0, 5, None) + (None,) * 17]
    got = {r.pass_id: r for r in scoring.score_passes_calibrated(scoring.score_passes_strict(spark.createDataFrame(rows, COLUMNS))).collect()}
    assert round(got[1].score, 6) == 1.0 and (got[1].status, got[1].weak_label, got[1].calibrated_weak_label) == ("weak_label_candidate", 1, 1)
    assert (got[2].score, got[2].tier, got[2].weak_label, got[2].calibrated_weak_label) == (0.0, "low", 0, 0)
    assert got[2].reasons == "ball_speed_baseline_unavailable;insufficient_feature_coverage"


def test_recovery_forgives_turnover_and_flicker(spark):
    at = dict(zip([c.split()[0] for c in COLUMNS.split(", ")], BEST)) | {"flicker": 1, "turnover_overlap": 0.5, "receiver_stable": 2, "recovery": 1}
    r = scoring.score_passes_calibrated(scoring.score_passes_strict(spark.createDataFrame([tuple(at.values())], COLUMNS))).first()
    assert (round(r.score, 6), r.weak_label) == (0.5, 0)
    assert (round(r.calibrated_score, 6), r.needed_receiver_frames, r.calibrated_weak_label) == (0.9, 2, 1)
    assert "turnover_overlap_penalty" not in r.calibrated_reasons.split(";") and "possession_flicker_penalty" not in r.calibrated_reasons.split(";")


def test_manifest_order_and_context(spark):
    rows = [BEST, (2, *BEST[1:]), (1, 3, 0, 5, None) + (None,) * 17]
    got = [(r.clip_id, r.pass_id, r.context_start_frame, r.context_end_frame, r.review_priority) for r in scoring.review_manifest(scoring.score_passes_strict(spark.createDataFrame(rows, COLUMNS))).collect()]
    assert got == [(1, 1, 0, 40, "high_priority"), (2, 1, 0, 40, "high_priority"), (1, 3, 0, 25, "low_priority")]


def test_marked_interceptions(spark):
    kind = "clip_id long, event_id long, source_type string, subtype string, center_frame long, weak_eligible int, review int, notes string, rule_reasons string"
    turn, source = "turnover_candidate_refined", "interception_source"
    rows = [(1, 1, turn, "interception", 98, 1, 1, None, "a"), (1, 2, turn, None, 102, 1, 1, None, "a"), (1, 3, turn, "loose", 100, 1, 1, None, "a"), (1, 4, source, "", 100, 1, 1, None, "b"), (2, 5, source, "", 100, 1, 1, "", "b"), (1, 6, source, "", None, 1, 1, "", "b")]
    got = {r.event_id: (r.weak_eligible, r.canonical_event_id, r.duplicate_of, r.notes) for r in candidates.mark_interceptions(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (1, 1, None, None), 2: (1, 2, None, None), 3: (1, 3, None, None), 4: (0, 1, 1, "duplicate_source_available_for_traceability"), 5: (1, 5, None, ""), 6: (1, 6, None, "")}
    assert candidates.mark_interceptions(spark.createDataFrame([], kind)).count() == 0


def test_features_of_a_pass(spark):
    state = "clip_id long, frame long, team string, player_id long, distance_to_ball double, ball_x double, ball_y double, ball_speed double, is_interpolated boolean, possession_changed int"
    owner = lambda f: ("Team A", 1) if f < 10 else ("None", None) if f <= 12 else ("Team A", 2) if f < 16 else ("Team B", 7)
    states = spark.createDataFrame([(1, f, *owner(f), 40.0 if 10 <= f <= 12 else 5.0, 3.0 * f, 4.0 * f, 9.0 if f == 11 else 1.0, f == 10, 0) for f in range(4, 20)], state)
    passes = spark.createDataFrame([(1, 1, 10, 12, "Team A"), (9, 1, 10, 12, "Team A")], "clip_id long, pass_id long, start_frame long, end_frame long, team string")
    spans = spark.createDataFrame([(1, 7, 12, 30, "Team A"), (1, 8, 12, 30, "Team A")], "clip_id long, turnover_id long, start_frame long, end_frame long, team string")
    f = pass_features.pass_features(passes, states, spans, spans.where("false"))
    r, alone = f.orderBy("clip_id").collect()
    assert (r.same_team, r.sender_stable, r.receiver_stable, r.free_ball, r.duration, r.ball_distance, r.above_baseline, r.flicker, r.turnover_overlap) == (1, 6, 3, 3, 3, 10.0, 1, 0, 0.0)
    assert round(r.carry_overlap, 6) == round(r.interpolated, 6) == 0.333333 and r.completeness == 1.0
    assert (alone.same_team, alone.sender_stable, alone.missing, alone.carry_overlap) == (None, 0, None, 0.0)
    ends = spans.withColumn("end_frame", F.lit(10).cast("long"))
    c = pass_features.pass_context(f.withColumn("carry_overlap", F.lit(0.0)).withColumn("interpolated", F.lit(0.0)), ends).orderBy("clip_id").collect()
    assert [(x.turnover_distance, x.recovery_frames, x.post_turnover, x.recovery) for x in c] == [(0, 2, 0, 1), (None, None, 0, 0)]
