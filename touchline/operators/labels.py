"""Labels of frames and windows from events and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from .motion import overlapping

#: Fixed labels of annotations.
LABELS = ("carry", "pass", "turnover", "shot", "uncertain")


def carry_labels(frames: DataFrame, carries: DataFrame) -> DataFrame:
    """Every frame as background, or as the carry of quality ok that holds it, the lower carry_id where several do; covering: how many do."""
    held = carries.where("carry_quality_flag = 'ok' and start_frame <= end_frame").select("clip_id", "carry_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame"))
    g = held.groupBy("clip_id", "frame").agg(F.min("carry_id").alias("event_id"), F.count("*").alias("covering"))
    is_carry = F.col("event_id").isNotNull()
    out = frames.where("frame is not null").select("clip_id", "frame", "timestamp").join(g, ["clip_id", "frame"], "left")
    return out.select("clip_id", "frame", "timestamp", F.when(is_carry, "carry").otherwise("background").alias("label"), is_carry.cast("int").alias("label_id"), F.when(is_carry, "carry_csv_ok").otherwise("default_background").alias("label_source"), F.lit(1.0).alias("label_confidence"), "event_id", F.coalesce("covering", F.lit(0)).alias("covering"))


def carry_label_summary(labels: DataFrame, carries: DataFrame) -> DataFrame:
    """By clip: frames, those of carries, extra covers, carries taken and passed over, and carries without a frame."""
    f = labels.groupBy("clip_id").agg(F.count("*").alias("frames"), F.sum("label_id").alias("carry_frames"), F.sum(F.greatest(F.col("covering") - 1, F.lit(0))).alias("duplicate_label_frames"))
    ok = F.col("carry_quality_flag") == "ok"
    held = carries.where(ok & (F.col("start_frame") <= F.col("end_frame"))).select("clip_id", "carry_id", F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).join(labels.select("clip_id", "frame"), ["clip_id", "frame"], "left_semi").select("clip_id", "carry_id").distinct()
    c = carries.join(held.withColumn("held", F.lit(True)), ["clip_id", "carry_id"], "left").groupBy("clip_id").agg(F.count_if(ok).alias("accepted"), F.count_if(~flag(ok)).alias("ignored_low_quality"), F.count_if(ok & F.col("held").isNull()).alias("zero_overlap"))
    return f.join(c, "clip_id", "left").na.fill(0, ["accepted", "ignored_low_quality", "zero_overlap"])


def numbered_intervals(boxes: DataFrame) -> DataFrame:
    """(clip_id, n, label, start_frame, end_frame, track_no, duplicates) of boxes (clip_id, track_no, label, frame, outside) of annotations.

    A track's unbroken frames that are not outside make an interval; of equal ones
    (label and bounds) the first in track order stays. n numbers a clip's intervals
    in that order. Boxes are shuffled once: a frame that comes twice has one rank.
    """
    active = boxes.where(F.col("label").isin(*LABELS) & ~flag(F.col("outside")) & (F.col("frame") >= 0)).select("clip_id", "track_no", "label", "frame")
    w = Window.partitionBy("clip_id", "track_no", "label").orderBy("frame")
    runs = active.withColumn("run", F.col("frame") - F.dense_rank().over(w)).groupBy("clip_id", "track_no", "label", "run").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"))
    once = runs.groupBy("clip_id", "label", "start_frame", "end_frame").agg(F.min("track_no").alias("track_no"), (F.count("*") - 1).alias("duplicates"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("clip_id").orderBy("track_no", "start_frame", "label")))


def interval_events(numbered: DataFrame, fps: float = 25.0) -> DataFrame:
    """numbered_intervals, which are read three times, as events. overlaps: earlier events of the clip that share a frame."""
    a, b = (numbered.select("clip_id", F.col("n").alias(f"{k}n"), F.col("start_frame").alias(f"{k}_start"), F.col("end_frame").alias(f"{k}_end")) for k in "ab")
    hit = overlapping(a, b).where("bn < an").groupBy("clip_id", F.col("an").alias("n")).agg(F.count("*").alias("overlaps"))
    out = numbered.join(hit, ["clip_id", "n"], "left")
    return out.select("clip_id", F.format_string("%s__event_%04d", F.col("clip_id").cast("string"), "n").alias("event_id"), F.col("label").alias("event_type"), "start_frame", "end_frame", (F.col("start_frame") / fps).alias("start_seconds"), (F.col("end_frame") / fps).alias("end_seconds"), (F.col("label") == "uncertain").alias("uncertain"), "duplicates", F.coalesce("overlaps", F.lit(0)).alias("overlaps"))


def annotated_intervals(boxes: DataFrame, fps: float = 25.0) -> DataFrame:
    """Boxes of annotations as events: interval_events of their numbered_intervals."""
    return interval_events(numbered_intervals(boxes), fps)


#: Fixed frame rate where nothing tells one.
RATE = 25.0


def annotation_rates(archived: DataFrame, manifest: DataFrame) -> DataFrame:
    """(clip_id, task_name, expected_task, fps, warning) of each archived clip that the manifest (clip_id, fps, duration_seconds, cvat_task_name) has: its rate, or the task's frames by the duration, or 25."""
    a = archived.groupBy("clip_id").agg(F.max("task_name").alias("task_name"), F.max("task_size").alias("task_size"))
    df = a.join(manifest.select("clip_id", F.coalesce("fps", F.lit(0.0)).alias("_fps"), F.coalesce("duration_seconds", F.lit(0.0)).alias("_d"), F.coalesce("cvat_task_name", F.lit("")).alias("expected_task")), "clip_id")
    told, derived = F.col("_fps") > 0, (F.col("_d") > 0) & (F.col("task_size") > 0)
    rate = F.col("task_size") / F.col("_d")
    words = F.format_string("manifest fps missing; derived fps=%.6f from CVAT task size %d and duration %.3fs", rate, "task_size", "_d")
    return df.select("clip_id", "task_name", "expected_task", F.when(told, F.col("_fps")).when(derived, rate).otherwise(RATE).alias("fps"), F.when(told, None).when(derived, words).otherwise("manifest fps missing; using fallback fps=25.0").alias("warning"))


def annotation_events(archived: DataFrame, manifest: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """The events of archived boxes (of sources.archives) by annotated_intervals, with times by each clip's own rate; clips that the manifest lacks are left out. numbered: the boxes' numbered_intervals, if they are there already."""
    rates = annotation_rates(archived, manifest).select("clip_id", "expected_task", "fps")
    e = interval_events(numbered_intervals(archived) if numbered is None else numbered, 1.0).drop("start_seconds", "end_seconds").join(rates, "clip_id")
    return e.withColumns({"start_seconds": F.col("start_frame") / F.col("fps"), "end_seconds": F.col("end_frame") / F.col("fps")}).drop("fps").withColumnRenamed("expected_task", "cvat_task_name")


def annotation_issues(archived: DataFrame, manifest: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """(clip_id, severity, message): clips that the manifest lacks, tasks of other names, missing rates, repeated events, and events that share frames. numbered: the boxes' numbered_intervals, if they are there already."""
    row = lambda df, severity, message: df.select("clip_id", F.lit(severity).alias("severity"), message.alias("message"))
    unknown = archived.select("clip_id", "archive").distinct().join(manifest.select("clip_id"), "clip_id", "left_anti")
    rates = annotation_rates(archived, manifest)
    name, want = F.col("task_name"), F.col("expected_task")
    allowed = (name == "") | (want == "") | (name == want) | (name == "gold_v1__{{file_name}}") | (name == F.concat("clip_id", F.lit(".mp4"))) | (name == F.concat(F.lit("gold_v1__"), "clip_id", F.lit(".mp4")))
    e = numbered_intervals(archived) if numbered is None else numbered
    own = e.join(manifest.select("clip_id"), "clip_id", "left_semi").select("clip_id", "n", F.col("label").alias("event_type"), "start_frame", "end_frame", "duplicates")
    a, b = (own.select("clip_id", *(F.col(c).alias(f"{k}_{c}") for c in ("n", "event_type")), F.col("start_frame").alias(f"{k}_start"), F.col("end_frame").alias(f"{k}_end")) for k in "ab")
    both = overlapping(a, b).where("b_n < a_n")
    return (
        row(unknown, "error", F.concat(F.lit("unknown clip export: "), "archive"))
        .union(row(rates.where(~allowed), "warning", F.format_string("task name mismatch: export=%s, manifest=%s", name, want)))
        .union(row(rates.where("warning is not null"), "warning", F.col("warning")))
        .union(row(own.withColumn("_", F.explode(F.when(F.col("duplicates") > 0, F.sequence(F.lit(1).cast("long"), "duplicates")).otherwise(F.array().cast("array<bigint>")))), "error", F.format_string("duplicate event: %s %d-%d", "event_type", "start_frame", "end_frame")))
        .union(row(both, "warning", F.format_string("overlap: %s %d-%d with %s %d-%d", "a_event_type", "a_start", "a_end", "b_event_type", "b_start", "b_end")))
    )
