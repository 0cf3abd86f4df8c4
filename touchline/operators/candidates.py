"""Event candidates from runs of possession and the ball's motion, their refinement and their union. All operators deal by clip."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, flag, half_even, tokens
from .motion import nearest_within, overlapping
from .segments import overlap_groups, runs, transitions
from .tables import quantiles

#: Priority of the kinds of events, confidence of carries (of quality ok, others) and interceptions.
PRIORITY = {"shot": 90, "turnover": 80, "pass": 70, "carry": 60}
CARRY_CONFIDENCE, INTERCEPTION_CONFIDENCE = (0.80, 0.40), 0.85


def event_frames(possession: DataFrame, motion: DataFrame) -> DataFrame:
    """One row a frame of possession, with the ball's motion; valid: it has a speed or an acceleration; gap: the frame before is missing."""
    m = motion.select("clip_id", "frame", "ball_speed", "ball_acceleration", ((F.col("velocity_valid") == 1) | (F.col("acceleration_valid") == 1)).alias("valid"))
    df = possession.select("clip_id", "frame", "timestamp", "ball_x", "distance_to_ball", F.col("ball_x").isNull().alias("missing"), flag(F.col("is_interpolated")).alias("interpolated")).join(m, ["clip_id", "frame"], "left")
    return df.withColumn("valid", flag(F.col("valid"))).withColumn("gap", flag(F.col("frame") - F.lag("frame").over(clip().orderBy("frame")) != 1))


def listed(events: DataFrame, columns: list[str], low: Column, high: Column) -> DataFrame:
    """columns of events with a row for each frame from low to high. Spark takes these rows to be as few as events has, so joins are told to sort them: a broadcast would bring them all to the driver."""
    return events.select(*columns, F.explode(F.sequence(low, high)).alias("frame")).hint("merge")


def around(events: DataFrame, low: Column, high: Column, frames: DataFrame, **aggregates: Column) -> DataFrame:
    """events with aggregates of the frames from low to high, bounds included: the frames are listed, so the join is on equal keys. `start_frame` and `end_frame` stand for the event's own span."""
    key = ["clip_id", "start_frame", "end_frame"]
    near = listed(events, key, low, high).join(frames, ["clip_id", "frame"]).groupBy(*key).agg(*(c.alias(k) for k, c in aggregates.items()))
    return events.join(near, key, "left")


def thresholds(motion: DataFrame, q: float) -> DataFrame:
    """Each clip's quantiles of speed and acceleration."""
    return quantiles(motion, ["clip_id"], {"speed_limit": (F.col("ball_speed"), q), "acceleration_limit": (F.col("ball_acceleration"), q)})


def _gaps() -> Column:
    """Gaps between a span's own frames: one before its first frame doesn't count."""
    return F.sum(F.col("gap").cast("long")) - F.min_by(F.col("gap").cast("long"), "frame")


def _numbered(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(clip().orderBy("start_frame", "end_frame")).cast("long"))


def _owner(team: str, player: str) -> Column:
    return F.concat_ws(":", F.col(team), F.col(player).cast("string"))


def pass_candidates(possession: DataFrame, motion: DataFrame, weak: DataFrame, pad: int = 12, frames: DataFrame | None = None) -> DataFrame:
    """The ball goes from a player to one of the same team within two seconds.

    high: stable owners, no missing frame between them, the ball moves and is fast
    nearby (the clip's upper quarter); medium: stable, no gap, and the ball moves or a
    weak pass (clip_id, pass_id, start_frame, end_frame, from_player, to_player, team)
    of the same players covers the change; else low. frames: event_frames of both, if
    they are at hand.
    """
    df = transitions(runs(possession, 1)).where(F.col("from_team") == F.col("team"))
    df = df.select("clip_id", F.col("from_end_frame").alias("start_frame"), F.col("start_frame").alias("end_frame"), F.col("from_end_time").alias("start_timestamp"), F.col("start_time").alias("end_timestamp"), "team", F.col("from_player_id").alias("from_player"), F.col("player_id").alias("to_player"), F.greatest("gap_seconds", F.lit(0.0)).alias("duration"), F.col("from_frames").alias("previous_frames"), F.col("frames").alias("new_frames"))
    who = ("team", "from_player", "to_player")
    w = weak.select("clip_id", *(F.col(c).alias(f"_{c}") for c in who), F.col("start_frame").alias("_s"), F.col("end_frame").alias("_e"), F.col("pass_id").alias("_weak"), F.least("start_frame", "end_frame").alias("b_start"), F.greatest("start_frame", "end_frame").alias("b_end"))
    met = overlapping(df.select("clip_id", *who, "start_frame", "end_frame", F.least("start_frame", "end_frame").alias("a_start"), F.greatest("start_frame", "end_frame").alias("a_end")), w.hint("merge"))
    hit = met.where(" and ".join(f"{c} = _{c}" for c in who) + " and _s <= end_frame and _e >= start_frame").groupBy("clip_id", "start_frame", "end_frame").agg(F.min("_weak").alias("weak_pass_id"))
    inside = F.col("frame").between(F.col("start_frame"), F.col("end_frame"))
    df = around(
        df, F.col("start_frame") - pad, F.col("end_frame") + pad, frames or event_frames(possession, motion),
        max_speed=F.max("ball_speed"), max_acceleration=F.max("ball_acceleration"), motion_frames=F.count_if("valid"),
        lost_share=F.avg(F.when(inside, (F.col("missing") | F.col("interpolated")).cast("double"))),
        frame_gaps=F.count_if(inside & F.col("gap") & (F.col("frame") > F.col("start_frame"))), ball_distance=F.min(F.when(inside, F.col("distance_to_ball"))),
    )
    df = df.join(hit, ["clip_id", "start_frame", "end_frame"], "left").join(thresholds(motion, 0.75), "clip_id", "left")
    stable = (F.col("previous_frames") >= 3) & (F.col("new_frames") >= 2)
    fast = flag(F.col("max_speed") >= F.col("speed_limit")) | flag(F.col("max_acceleration") >= F.col("acceleration_limit"))
    df = df.withColumns({"motion_frames": F.coalesce("motion_frames", F.lit(0).cast("long")), "frame_gaps": F.coalesce("frame_gaps", F.lit(0).cast("long"))})
    sure, moves = stable & (F.col("frame_gaps") == 0), F.col("motion_frames") > 0
    tier = F.when(sure & moves & fast, "high").when(sure & (moves | F.col("weak_pass_id").isNotNull()), "medium").otherwise("low")
    df = _numbered(df, "pass_id").withColumn("tier", tier).withColumn("consistent", sure.cast("int")).drop("speed_limit", "acceleration_limit")
    why = tokens((F.lit(True), "same_team_player_change"), (F.lit(True), F.concat(F.lit("previous_stable="), "previous_frames")), (F.lit(True), F.concat(F.lit("new_stable="), "new_frames")), (F.lit(True), F.concat(F.lit("valid_ball_motion_frames="), "motion_frames")), (F.col("weak_pass_id").isNotNull(), "matched_weak_pass"))
    middle = half_even((F.col("start_frame") + F.col("end_frame")) / 2)
    return df.withColumn("confidence", F.when(F.col("tier") == "high", 0.85).when(F.col("tier") == "medium", 0.65).otherwise(0.35)).withColumns({"center_frame": middle, "rule_reasons": why})


def turnover_candidates(possession: DataFrame, motion: DataFrame, interceptions: DataFrame, most_distance: float = 100, pad: int = 12, frames: DataFrame | None = None) -> DataFrame:
    """The ball goes to the other team, however long that takes; matched if an interception lies within two frames of the switch (the nearest, the lower id at equal distance). frames: event_frames of both, if they are at hand."""
    df = transitions(runs(possession, 1), None).where(F.col("from_team") != F.col("team"))
    df = df.select("clip_id", F.col("from_end_frame").alias("start_frame"), F.col("start_frame").alias("end_frame"), F.col("from_end_time").alias("start_timestamp"), F.col("start_time").alias("end_timestamp"), "from_team", "team", F.col("from_player_id").alias("from_player"), F.col("player_id").alias("to_player"), F.col("at.distance_to_ball").alias("winner_distance"), F.col("from_frames").alias("previous_frames"), F.col("frames").alias("winner_frames"))
    df = _numbered(df, "turnover_id")
    hit = nearest_within(df.select("clip_id", F.col("turnover_id").alias("id"), F.col("end_frame").alias("frame")), interceptions.select("clip_id", F.col("interception_id").alias("id"), "frame"), 2)
    df = around(df, F.col("end_frame") - pad, F.col("end_frame") + pad, frames or event_frames(possession, motion), max_speed=F.max("ball_speed"), max_acceleration=F.max("ball_acceleration"), ball_distance=F.min("distance_to_ball"), frame_gaps=_gaps())
    df = df.join(hit.select("clip_id", F.col("left_id").alias("turnover_id"), F.col("right_id").alias("interception_id"), "right_frame"), ["clip_id", "turnover_id"])
    matched, near = F.col("interception_id").isNotNull(), flag(F.col("winner_distance") <= most_distance)
    stable = (F.col("previous_frames") >= 3) & (F.col("winner_frames") >= 2)
    tier = F.when(matched & stable & near, "high").when(stable & near, "medium").otherwise("low")
    why = tokens((F.lit(True), "team_switch"), (F.lit(True), F.concat(F.lit("previous_stable="), "previous_frames")), (F.lit(True), F.concat(F.lit("winner_stable="), "winner_frames")), (F.lit(True), F.concat(F.lit("plausible_distance="), near.cast("int"))), (matched, "matched_existing_interception"))
    df = df.withColumns({"matched": matched.cast("int"), "frame_delta": F.col("right_frame") - F.col("end_frame"), "tier": tier, "subtype": F.when(matched, "interception").otherwise("possession_turnover"), "rule_reasons": why}).drop("right_frame")
    return df.withColumn("confidence", F.when(F.col("tier") == "high", 0.85).when(F.col("tier") == "medium", 0.60).otherwise(0.35))


def _side(width: Column, part: float) -> Column:
    return F.when(F.col("ball_x") <= part * width, "left_image_end").when(F.col("ball_x") >= (1 - part) * width, "right_image_end")


def shot_candidates(possession: DataFrame, motion: DataFrame, carries: DataFrame, gap: int = 12, pad: int = 12, side: float = 0.20, frames: DataFrame | None = None) -> DataFrame:
    """Peaks of the ball's speed or acceleration (the clip's 95th percentile), merged where they lie at most `gap` frames apart.

    medium: within `pad` frames the speed reaches the percentile, the ball is seen
    near an end of the image, it moves in a frame that isn't interpolated, and less
    than a quarter of the frames belong to carries of quality ok; else low. The image
    is as wide as the ball's places in the clip tell. Bounds are those of the frames there are.
    frames: event_frames of both, if they are at hand.
    """
    frames = frames or event_frames(possession, motion)
    limits = thresholds(motion, 0.95).join(frames.groupBy("clip_id").agg((F.ceil(F.max("ball_x")).cast("long") + 1).alias("image_width")), "clip_id")
    peak = frames.join(limits, "clip_id").where(F.col("valid") & ((F.col("ball_speed") >= F.col("speed_limit")) | (F.col("ball_acceleration") >= F.col("acceleration_limit")))).select("clip_id", "frame")
    w = clip().orderBy("frame")
    new = F.coalesce((F.col("frame") - F.lag("frame").over(w) > gap).cast("int"), F.lit(1))
    g = peak.withColumn("_new", new).withColumn("_seg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = g.groupBy("clip_id", "_seg").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("peaks")).drop("_seg").join(limits, "clip_id")
    carried = listed(carries.where("carry_quality_flag = 'ok'"), ["clip_id"], F.col("start_frame"), F.col("end_frame")).distinct().withColumn("carried", F.lit(1))
    rows = frames.join(carried, ["clip_id", "frame"], "left").join(limits.select("clip_id", "image_width"), "clip_id").withColumn("side", _side(F.col("image_width"), side)).drop("image_width")
    evidence = ~F.col("missing") & ~F.col("interpolated") & F.col("valid")
    df = around(
        g, F.col("start_frame") - pad, F.col("end_frame") + pad, rows,
        first=F.min("frame"), last=F.max("frame"), start_timestamp=F.min_by("timestamp", "frame"), end_timestamp=F.max_by("timestamp", "frame"), max_speed=F.max("ball_speed"), max_acceleration=F.max("ball_acceleration"), ball_distance=F.min("distance_to_ball"), motion_frames=F.count_if("valid"),
        interpolated_share=F.avg(F.col("interpolated").cast("double")), carry_overlap=F.avg(F.coalesce("carried", F.lit(0)).cast("double")), goal_side=F.min_by("side", F.when(F.col("side").isNotNull(), F.col("frame"))), evidence=F.bool_or(evidence), frame_gaps=_gaps(),
    )
    df = df.withColumn("center_frame", half_even((F.col("start_frame") + F.col("end_frame")) / 2)).withColumns({"start_frame": F.col("first"), "end_frame": F.col("last"), "near_end": F.col("goal_side").isNotNull().cast("int")}).drop("first", "last")
    free = F.col("carry_overlap") < 0.25
    good = flag(F.col("max_speed") >= F.col("speed_limit")) & F.col("evidence") & (F.col("near_end") == 1) & free
    df = df.withColumn("shot_id", F.row_number().over(clip().orderBy("center_frame", "start_frame")).cast("long")).withColumn("tier", F.when(good, "medium").otherwise("low"))
    why = tokens((F.lit(True), "ball_motion_spike"), (F.lit(True), F.concat(F.lit("near_goal_region="), "near_end")), (F.lit(True), F.concat(F.lit("non_interpolated_evidence="), F.col("evidence").cast("int"))), (F.lit(True), F.concat(F.lit("carry_overlap_fraction="), F.format_number("carry_overlap", 3))))
    return df.withColumn("confidence", F.when(good, 0.55).when(free, 0.35).otherwise(0.25)).withColumn("rule_reasons", why).drop("speed_limit", "acceleration_limit", "evidence")


MERGED = "clip_id long, team string, k long, pass_id long, start_frame long, end_frame long, center_frame long, from_player long, to_player long, duration double, max_speed double, max_acceleration double, ball_distance double, confidence double, tier string, consistent int, frame_gaps long, rule_reasons string, raw_pass_id long, merged_pass_ids string, members long, merge_blocked boolean"


def _alike(a: float, b: float) -> bool:
    """Equal within a twentieth, or both unknown."""
    if pd.isna(a) or pd.isna(b):
        return bool(pd.isna(a) and pd.isna(b))
    return abs(a - b) <= 0.05 * max(abs(a), abs(b), 1.0)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Folds a team's candidates of a clip in order of their frames."""
    out: list[dict] = []
    group: list[dict] = []
    best: dict = {}
    stop = False
    strength = lambda r: (0.0 if pd.isna(r["confidence"]) else r["confidence"], 0.0 if pd.isna(r["max_speed"]) else r["max_speed"])

    def close():
        if group:
            ids = [r["pass_id"] for r in group]
            lo, hi = min(r["start_frame"] for r in group), max(r["end_frame"] for r in group)
            out.append(best | {"k": len(out), "start_frame": lo, "end_frame": hi, "raw_pass_id": ids[0], "merged_pass_ids": ";".join(map(str, ids)) if len(ids) > 1 else "", "members": len(ids), "merge_blocked": stop})

    for r in pdf.sort_values(["start_frame", "end_frame", "pass_id"]).to_dict("records"):
        near = bool(group) and r["start_frame"] - best["end_frame"] <= 12
        like = near and (r["start_frame"] <= best["end_frame"] or (r["from_player"], r["to_player"]) == (best["to_player"], best["from_player"]) or _alike(r["max_speed"], best["max_speed"]) or _alike(r["max_acceleration"], best["max_acceleration"]))
        long = like and max(r["end_frame"], *(x["end_frame"] for x in group)) - min(r["start_frame"], *(x["start_frame"] for x in group)) + 1 > 24
        if like and not long:
            group.append(r)
            if strength(r) > strength(best):
                best = r
            continue
        stop = stop or bool(long)
        close()
        group, best, stop = [r], r, bool(long)
    close()
    return pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])


def refine_passes(candidates: DataFrame, least_seconds: float = 0.08, least_span: int = 2) -> DataFrame:
    """Candidates of a team that follow closely are one pass, the strongest stands for them; its end decides what is near. A merge over 24 frames is blocked and both sides say so.

    Short ones are suppressed; a blocked one that may not be trained on is for review
    only. The representative changes as rows come, so this is a fold of each clip's
    and team's rows and no window function.
    """
    names = [c.split() for c in MERGED.split(", ") if c.split()[0] not in ("k", "raw_pass_id", "merged_pass_ids", "members", "merge_blocked")]
    df = candidates.select(*(F.col(c).cast(t).alias(c) for c, t in names))
    m = df.groupBy("clip_id", "team").applyInPandas(_merge, MERGED)
    m = m.withColumn("refined_id", F.row_number().over(clip().orderBy("team", "k")).cast("long")).drop("k")
    hasty, narrow, blocked = flag(F.col("duration") < least_seconds), F.col("end_frame") - F.col("start_frame") < least_span, F.col("merge_blocked")
    weak = ~hasty & ~narrow & flag(F.col("tier") == "high") & flag(F.col("consistent") == 1) & flag(F.col("frame_gaps") == 0)
    status = F.when(hasty | narrow, "suppressed").when(F.col("members") > 1, "merged").when(blocked & ~weak, "review_only").otherwise("kept")
    why = tokens((F.col("members") > 1, "merged_nearby_same_team_candidates"), (hasty, f"duration_below_{least_seconds:.3f}s"), (narrow, f"frame_span_below_{least_span}"), (blocked, "merge_blocked_span_too_long"))
    return m.withColumn("status", status).withColumns({"refinement_reasons": F.when(why == "", "passes_refinement_checks").otherwise(why), "review": (F.col("status") != "suppressed").cast("int"), "weak_eligible": weak.cast("int")})


def refine_turnovers(candidates: DataFrame, bounds: DataFrame, pad: int = 8) -> DataFrame:
    """Windows around the switch, within the clip, and what becomes of each candidate: only stable and matched ones of the high tier are trained on."""
    previous, winner, tier, matched = F.col("previous_frames") >= 3, F.col("winner_frames") >= 2, F.col("tier"), F.col("matched") == 1
    stable = previous & winner
    sure = stable & (tier == "high") & matched
    status = F.when(sure, "kept").when(stable, F.when(tier == "high", "kept").otherwise("review_only")).otherwise(F.when(tier == "low", "suppressed").otherwise("review_only"))
    why = tokens((F.lit(True), "local_window_around_switch_frame"), (matched, "matched_interception_anchor"), (~previous, "previous_owner_not_stable"), (~winner, "winner_not_stable"), (~winner, "team_switch_not_sustained"))
    df = candidates.join(bounds.select("clip_id", "min_frame", "max_frame"), "clip_id")
    return df.withColumns({"raw_start_frame": F.col("start_frame"), "raw_end_frame": F.col("end_frame"), "center_frame": F.col("end_frame")}).withColumns({"start_frame": F.greatest(F.col("center_frame") - pad, "min_frame"), "end_frame": F.least(F.col("center_frame") + pad, "max_frame"), "status": status, "refinement_reasons": why, "review": (tier != "low").cast("int"), "weak_eligible": sure.cast("int")}).drop("min_frame", "max_frame")


def refine_shots(shots: DataFrame, possession: DataFrame, local: int = 6, side: float = 0.20, most_interpolated: float = 0.25, most_overlap: float = 0.20) -> DataFrame:
    """Shots are kept for review if the ball is near an end of the image within `local` frames of the peak, moves, is seldom interpolated and seldom carried; none is trained on."""
    at = listed(shots, ["clip_id", "shot_id", "image_width"], F.col("center_frame") - local, F.col("center_frame") + local)
    near = at.join(possession.select("clip_id", "frame", "ball_x"), ["clip_id", "frame"]).groupBy("clip_id", "shot_id").agg(F.bool_or(_side(F.col("image_width"), side).isNotNull()).alias("local_near"))
    df = shots.join(near, ["clip_id", "shot_id"], "left").withColumn("local_near", flag(F.col("local_near")))
    made, carried = F.col("interpolated_share") > most_interpolated, F.col("carry_overlap") > most_overlap
    still, close = F.col("motion_frames") == 0, F.col("local_near")
    review = close & ~made & ~carried & ~still
    why = tokens((F.lit(True), "annotation_review_candidate_only"), (close, "local_near_goal_region"), (~close, "local_near_goal_region_absent"), (made, "interpolation_fraction_too_high"), (carried, "carry_overlap_too_high"), (still, "valid_ball_motion_absent"), ((F.col("end_frame") - F.col("start_frame") > 6 * local) & ~close, "long_candidate_span_without_local_peak_support"))
    return df.withColumns({"status": F.when(review, "review_only").otherwise("suppressed"), "refinement_reasons": why, "review": review.cast("int"), "weak_eligible": F.lit(0)}).drop("local_near")


#: The columns of a unified event that its source gives; absent ones are null.
GIVEN = {"team": "string", "player_id": "long", "secondary_player_id": "long", "tier": "string", "quality_flag": "string", "rule_reasons": "string", "status": "string", "refinement_reasons": "string", "max_speed": "double", "max_acceleration": "double", "ball_distance": "double", "possession_before": "string", "possession_after": "string", "subtype": "string"}


#: Fixed text: what is done about events that overlap.
OVERLAP_POLICY = "mark_only_no_label_resolution"


def unify_events(carries: DataFrame, weak: DataFrame, interceptions: DataFrame, passes: DataFrame, turnovers: DataFrame, shots: DataFrame, bounds: DataFrame, frames: DataFrame, pad: int = 8, files: dict[str, str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All six sources in one table, inside their clip, in order of start, end and falling priority, with the groups of those that overlap and interceptions marked that a refined turnover stands for.

    frames (clip_id, frame, timestamp) tells the times of start, end and middle: that
    of the nearest frame, the earlier of two. files: the file of each source by its
    type; its type and .csv if it isn't given. keep: what is done with a table that is
    read several times, say to save it.
    """

    def part(rank: int, df: DataFrame, kind: str, family: str, source: str, label: str, key: str, center: Column, confidence: Column, review: Column, weak_eligible: Column, **given: Column) -> DataFrame:
        more = [given.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in GIVEN.items()]
        return df.select("clip_id", F.lit(rank).alias("_rank"), F.lit(kind).alias("event_type"), F.lit(family).alias("event_family"), F.lit(source).alias("source_type"), F.lit(label).alias("label_source"), F.col(key).cast("long").alias("source_id"), "start_frame", "end_frame", center.alias("center_frame"), confidence.alias("confidence"), F.lit(PRIORITY[kind]).alias("priority"), review.cast("int").alias("review"), weak_eligible.cast("int").alias("weak_eligible"), *more)

    one, zero, conf = F.lit(1), F.lit(0), F.col("confidence")
    middle = half_even((F.col("start_frame") + F.col("end_frame")) / 2)
    ok = flag(F.col("carry_quality_flag") == "ok")
    met = interceptions.withColumns({"start_frame": F.col("frame") - pad, "end_frame": F.col("frame") + pad})
    df = part(0, carries, "carry", "possession_event", "carry_source", "existing_carry_detector", "carry_id", middle, F.when(ok, CARRY_CONFIDENCE[0]).otherwise(CARRY_CONFIDENCE[1]), one, ok, tier=F.when(ok, "high").otherwise("low"), quality_flag=F.col("carry_quality_flag"), rule_reasons=F.lit("existing_carry_source"), ball_distance=F.col("ball_distance_px"))
    df = df.unionByName(part(1, weak, "pass", "possession_event", "passes_weak", "passes_weak_baseline", "pass_id", middle, conf, one, zero, player_id=F.col("from_player"), secondary_player_id=F.col("to_player"), tier=F.lit("low"), rule_reasons=F.lit("passes_weak_source")))
    df = df.unionByName(part(2, met, "turnover", "possession_change", "interception_source", "existing_interception_detector", "interception_id", F.col("frame"), F.lit(INTERCEPTION_CONFIDENCE), one, one, team=F.col("winner_team"), player_id=F.col("winner_player_id"), secondary_player_id=F.col("previous_player_id"), tier=F.lit("high"), rule_reasons=F.lit("existing_interception_source"), ball_distance=F.col("distance_to_ball"), possession_before=_owner("previous_team", "previous_player_id"), possession_after=_owner("winner_team", "winner_player_id")))
    df = df.unionByName(part(3, passes, "pass", "possession_event", "pass_candidate_refined", "possession_transition_with_ball_motion_heuristic", "raw_pass_id", F.col("center_frame"), conf, F.col("review"), F.col("weak_eligible"), player_id=F.col("from_player"), secondary_player_id=F.col("to_player"), quality_flag=F.lit("weak_candidate_not_ground_truth"), possession_before=_owner("team", "from_player"), possession_after=_owner("team", "to_player")))
    df = df.unionByName(part(4, turnovers, "turnover", "possession_change", "turnover_candidate_refined", "possession_team_switch_with_interception_anchor", "turnover_id", F.col("center_frame"), conf, F.col("review"), F.col("weak_eligible"), player_id=F.col("to_player"), secondary_player_id=F.col("from_player"), quality_flag=F.lit("weak_candidate_not_ground_truth"), possession_before=_owner("from_team", "from_player"), possession_after=_owner("team", "to_player")))
    df = df.unionByName(part(5, shots, "shot", "attacking_event", "shot_candidate_refined", "heuristic_ball_motion_candidate", "shot_id", F.col("center_frame"), conf, F.col("review"), zero, quality_flag=F.lit("weak_candidate_not_confirmed_shot")))
    inside = lambda c: F.least(F.greatest(c, F.col("min_frame")), F.col("max_frame"))
    df = df.join(bounds.select("clip_id", "min_frame", "max_frame"), "clip_id").withColumns({c: inside(F.col(c)) for c in ("start_frame", "end_frame", "center_frame")}).drop("min_frame", "max_frame")
    order = clip().orderBy("start_frame", "end_frame", F.desc("priority"), "_rank", "source_id")
    df = df.withColumns({"event_id": F.row_number().over(order).cast("long"), "confidence": F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)), "is_gold_label": F.lit(0), "notes": F.lit("")}).drop("_rank")
    df = keep(overlap_groups(mark_interceptions(keep(df))))
    df = with_times(df, frames, {f"{at}_frame": f"{at}_timestamp" for at in ("start", "end", "center")})
    file = F.concat("source_type", F.lit(".csv"))
    for kind, name in (files or {}).items():
        file = F.when(F.col("source_type") == kind, F.lit(name)).otherwise(file)
    return df.withColumns({"overlap_warning": F.col("overlap_group").isNotNull().cast("int"), "overlap_policy": F.lit(OVERLAP_POLICY), "source_file": file}).drop("subtype")


def with_time(events: DataFrame, frames: DataFrame, at: str, name: str) -> DataFrame:
    """events with the column `name`: the timestamp of the clip's frame nearest to the column `at`, the earlier frame if two are as near; null without frames."""
    return with_times(events, frames, {at: name})


def with_times(events: DataFrame, frames: DataFrame, names: dict[str, str]) -> DataFrame:
    """with_time for several columns and the names of their times. One pass each way over the clip's frames and all wanted frames in order, no pairs."""
    known = frames.where("frame is not null").groupBy("clip_id", "frame").agg(F.min("timestamp").alias("timestamp")).select("clip_id", "frame", F.struct("frame", "timestamp").alias("_f"))
    wanted = events.select("clip_id", F.explode(F.array(*names)).alias("frame")).where("frame is not null").distinct().withColumn("_want", F.lit(True)).hint("merge")
    nearest = lambda by: F.last("_f", ignorenulls=True).over(clip().orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    both = known.join(wanted, ["clip_id", "frame"], "full").withColumn("_a", nearest(F.asc("frame"))).withColumn("_b", nearest(F.desc("frame")))
    later = F.col("_a").isNull() | (F.col("_b.frame") - F.col("frame") < F.col("frame") - F.col("_a.frame"))
    times = both.where("_want").select("clip_id", "frame", F.when(F.coalesce(later, F.lit(False)), F.col("_b.timestamp")).otherwise(F.col("_a.timestamp")).alias("_time"))
    for at, name in names.items():
        events = events.join(times.select("clip_id", F.col("frame").alias(at), F.col("_time").alias(name)), ["clip_id", at], "left").select(*events.columns, name)
    return events


def mark_interceptions(events: DataFrame, tolerance: int = 2) -> DataFrame:
    """Marks each interception that a refined turnover within tolerance frames already stands for: it keeps its row, but is neither trained on nor reviewed.

    events has clip_id, event_id, source_type, subtype, center_frame, weak_eligible,
    review, notes and rule_reasons. Adds canonical_event_id (its own id if nothing
    stands for it) and duplicate_of.
    """
    at = lambda df: df.select("clip_id", F.col("event_id").alias("id"), F.col("center_frame").alias("frame"))
    sources = events.where("source_type = 'interception_source' and center_frame is not null")
    refined = events.where("source_type = 'turnover_candidate_refined' and coalesce(subtype, '') in ('', 'interception')")
    hit = nearest_within(at(sources), at(refined), tolerance).select("clip_id", F.col("left_id").alias("event_id"), F.col("right_id").alias("duplicate_of"))
    df, twice = events.join(hit, ["clip_id", "event_id"], "left"), F.col("duplicate_of").isNotNull()
    more = lambda c, token: F.when(twice, F.array_join(F.array_union(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: x != ""), F.array(F.lit(token))), ";")).otherwise(F.col(c))
    return df.withColumns(
        {
            "weak_eligible": F.when(twice, 0).otherwise(F.col("weak_eligible")),
            "review": F.when(twice, 0).otherwise(F.col("review")),
            "canonical_event_id": F.coalesce("duplicate_of", "event_id"),
            "notes": more("notes", "duplicate_source_available_for_traceability"),
            "rule_reasons": more("rule_reasons", "duplicate_of_refined_interception_turnover"),
        }
    )
