"""Tables about data sets: which columns are features, how classes are spread, what is ready to annotate, how models compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import share

#: Fixed names that are no features, and tokens of names that would tell a model its label.
IDS = ("clip_id", "frame", "timestamp", "possessor_track_id")
LEAKS = ("event", "label", "candidate", "confidence_tier", "quality", "review", "gold", "manual", "score", "source", "priority", "overlap", "refinement")
CLASSES = ("background", "carry", "pass", "turnover", "shot")
PEOPLE = ("person", "player")
SPLITS = ("train", "valid", "test", "challenge")


def of_class(df: DataFrame, names: tuple[str, ...] = PEOPLE, column: str = "class_name") -> DataFrame:
    """Rows whose class, trimmed and in lower case, is one of the names."""
    return df.where(F.lower(F.trim(F.col(column).cast("string"))).isin(*names))


def classes_found(df: DataFrame, names: tuple[str, ...] = PEOPLE, column: str = "class_name") -> DataFrame:
    """(class_name, included, rows): the classes as they are written, and whether of_class takes them."""
    c = F.trim(F.col(column).cast("string"))
    return df.where(F.col(column).isNotNull()).groupBy(c.alias("class_name")).agg(F.count("*").alias("rows")).withColumn("included", F.lower("class_name").isin(*names))


def feature_columns(frames: DataFrame, ids: tuple[str, ...] = IDS, leaks: tuple[str, ...] = LEAKS) -> DataFrame:
    """(column, is_feature, reason): which columns of a frame table a model may see. Not: ids, names that tell the label, and columns in which no value is a number. One aggregate over all columns."""
    kinds = {}
    for f in frames.schema:
        low = f.name.lower()
        if f.name in ids or low.endswith("_id"):
            kinds[f.name] = "identifier"
        elif any(t in low for t in leaks):
            kinds[f.name] = "leakage"
    rest = [f for f in frames.schema if f.name not in kinds]
    number = lambda f: F.col(f.name).cast("double") if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else F.col(f.name).cast("string").try_cast("double")
    counts = frames.agg(*(F.count(number(f)).alias(f.name) for f in rest))
    told = [F.struct(F.lit(f.name).alias("column"), (F.col(f.name) > 0).alias("is_feature"), F.when(F.col(f.name) > 0, "numeric").otherwise("no numeric value").alias("reason")) for f in rest]
    told += [F.struct(F.lit(c).alias("column"), F.lit(False).alias("is_feature"), F.lit(why).alias("reason")) for c, why in kinds.items()]
    return counts.select(F.explode(F.array(*told)).alias("x")).select("x.*")


def selected(windows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """Windows that balancing selected, of known classes."""
    return windows.where((F.coalesce(F.col("selected_after_balancing").cast("int"), F.lit(0)) == 1) & F.col("target_class").isin(*classes))


def _phases(windows: DataFrame) -> DataFrame:
    phase = F.array(F.lit("before_balancing"), F.when(F.col("selected_after_balancing") == 1, "after_balancing"))
    return windows.withColumn("phase", F.explode(F.filter(phase, lambda p: p.isNotNull())))


def class_counts(windows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """(phase, split, target_class, window_count) before and after balancing, of each split and of all, zeros too. A cube over what is there, filled up from the grid."""
    g = _phases(windows).cube("phase", "split", "target_class").agg(F.count("*").alias("n"), F.grouping_id("phase", "split", "target_class").alias("_g"))
    there = g.where("_g in (0, 2)").select("phase", F.when(F.col("_g") == 2, "all").otherwise(F.col("split")).alias("split"), "target_class", "n")
    spark = windows.sparkSession
    grid = spark.createDataFrame([(p, s, c) for p in ("before_balancing", "after_balancing") for s in ("all", "train", "val", "test") for c in classes], "phase string, split string, target_class string")
    return grid.join(there, ["phase", "split", "target_class"], "left").select("phase", "split", "target_class", F.coalesce("n", F.lit(0)).alias("window_count"))


def clip_class_counts(windows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row a clip and phase: windows, those of each class, and the classes that it has, in the order of `classes`. A clip that balancing left nothing of keeps its row."""
    after = lambda c: (F.col("target_class") == c) & (F.col("selected_after_balancing") == 1)
    before = lambda c: F.col("target_class") == c
    g = windows.groupBy("clip_id").agg(*(F.count_if(f(c)).alias(f"{k}_{c}") for k, f in (("b", before), ("a", after)) for c in classes))
    row = lambda phase, k: F.struct(F.lit(phase).alias("phase"), *(F.col(f"{k}_{c}").alias(f"{c}_windows") for c in classes))
    df = g.select("clip_id", F.explode(F.array(row("before_balancing", "b"), row("after_balancing", "a"))).alias("x")).select("clip_id", "x.*")
    has = F.array_join(F.filter(F.array(*(F.when(F.col(f"{c}_windows") > 0, c) for c in classes)), lambda c: c.isNotNull()), ",")
    total = F.col(f"{classes[0]}_windows")
    for c in classes[1:]:
        total = total + F.col(f"{c}_windows")
    return df.withColumns({"total_windows": total, "classes_present": has})


def split_manifest(windows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row a clip: its split, its windows and those of each class; a clip in several splits has a row in each."""
    return windows.groupBy("clip_id", "split").agg(F.count("*").alias("windows"), *(F.count_if(F.col("target_class") == c).alias(f"{c}_windows") for c in classes))


def stride_statistics(build, strides: list[int], classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """One row a stride: windows, those of each class, clips with background, and background windows rejected for an event in their middle, for one too near, and accepted with one elsewhere. build(stride) gives (windows, rejections), as weak_event_windows does."""
    both = [build(n) for n in strides]
    every = lambda i: _stacked([x[i].withColumn("stride", F.lit(n)) for x, n in zip(both, strides, strict=True)])
    background = F.col("target_class") == "background"
    w = every(0).groupBy("stride").agg(F.count("*").alias("windows"), *(F.count_if(F.col("target_class") == c).alias(f"{c}_windows") for c in classes), F.countDistinct(F.when(background, F.col("clip_id"))).alias("clips_with_background"))
    why = lambda name: F.count_if((F.col("window_kind") == "background") & (F.col("reason") == name))
    r = every(1).groupBy("stride").agg(why("center_label_region_overlaps_event").alias("rejected_overlap"), why("center_label_region_too_close_to_event").alias("rejected_margin"), why("accepted_with_noncentral_context_event").alias("accepted_with_context"))
    names = both[0][0].sparkSession.createDataFrame([(n,) for n in strides], "stride int")
    return names.join(w, "stride", "left").join(r, "stride", "left").na.fill(0)


def _stacked(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def numeric_summary(df: DataFrame, *columns: str) -> DataFrame:
    """(column, min, median, max), rounded to 6 digits; nulls without a value."""
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("median", lambda x: F.percentile(x, 0.5)), ("max", F.max))))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), *(F.round(F.col(f"{k}_{c}"), 6).alias(k) for k in ("min", "median", "max"))) for c in columns))).alias("x")).select("x.*")


def annotation_readiness(clips: DataFrame, artefacts: DataFrame, videos: DataFrame, frames: DataFrame, needed: tuple[str, ...], seconds: float = 30.0) -> DataFrame:
    """What each clip lacks before it can be annotated, and whether its video and its frame table fit.

    clips: clip_id, source_exists, source_error (what its manifest row does wrong);
    artefacts: (clip_id, artefact) of what is there; videos: clip_id, duration, fps,
    frame_count, video_error; frames: the frame tables. status: blocked,
    needs_original_pipeline, needs_temporal_sweep or ready_for_cvat; alignment_status
    the last of duration_mismatch, fps_mismatch, frame_count_mismatch that holds, or
    aligned, or what is missing; annotation_status: ready_for_cvat, planned, blocked.
    """
    have = artefacts.where(F.col("artefact").isin(*needed)).groupBy("clip_id").agg(F.collect_set("artefact").alias("_have"))
    bounds = frames.where("frame is not null").groupBy("clip_id").agg(F.min("frame").alias("temporal_first_frame"), F.max("frame").alias("temporal_last_frame"), F.count("*").alias("temporal_frame_count"))
    df = clips.join(have, "clip_id", "left").join(bounds, "clip_id", "left").join(videos, "clip_id", "left")
    has = F.coalesce("_have", F.array().cast("array<string>"))
    wrong, source = F.col("source_error").isNotNull(), F.coalesce("source_exists", F.lit(False))
    lacks = [F.when(~F.array_contains(has, a), a) for a in needed] + [F.when(~source, "source_video"), F.when(wrong, "source_manifest_validation")]
    missing = F.filter(F.array(*lacks), lambda x: x.isNotNull())
    table = F.col("temporal_frame_count").isNotNull()
    df = df.withColumns({"_missing": missing, "_table": table})
    blocked = wrong | ~source
    status = F.when(blocked, "blocked").when(F.size("_missing") > 0, "needs_original_pipeline").when(~table, "needs_temporal_sweep").otherwise("ready_for_cvat")
    error = F.when(blocked, F.coalesce("source_error", F.lit("source video missing")))
    fps, n = F.coalesce("fps", F.lit(0.0)), F.coalesce("frame_count", F.lit(0))
    long_, slow, late = F.abs(F.coalesce("duration", F.lit(0.0)) - seconds) > 1.0, fps <= 0, ~F.col("temporal_first_frame").isin(0, 1)
    apart = (n > 0) & (F.col("temporal_frame_count") > 0) & (F.abs(n - F.col("temporal_frame_count")) > F.greatest(F.lit(2), F.when(fps > 0, F.bround(fps).cast("int")).otherwise(2)))
    no_video = F.col("video_error").isNotNull() | F.col("duration").isNull()
    aligned = F.when(no_video, "blocked").when(~table, "missing_temporal_frames").when(late | apart, "frame_count_mismatch").when(slow, "fps_mismatch").when(long_, "duration_mismatch").otherwise("aligned")
    notes = F.array_join(F.filter(F.array(F.when(long_, f"expected about {seconds:.3f}s"), F.when(slow, "fps unavailable"), F.when(late, "temporal frames do not start at 0 or 1"), F.when(apart, "temporal frame count differs from video frame count")), lambda x: x.isNotNull()), "; ")
    df = df.withColumns({"status": status, "error": error, "alignment_status": aligned, "alignment_notes": F.when(no_video, F.coalesce("video_error", F.lit("missing clip"))).when(~table, "missing temporal_frames.csv").otherwise(notes)})
    ready = (F.col("status") == "ready_for_cvat") & (F.col("alignment_status") == "aligned")
    df = df.withColumn("annotation_status", F.when(ready, "ready_for_cvat").when(F.col("status").isin("needs_original_pipeline", "needs_temporal_sweep"), "planned").otherwise("blocked"))
    reason = F.when(~ready, F.coalesce("error", F.nullif(F.array_join("_missing", "; "), F.lit("")), F.nullif("alignment_notes", F.lit("")), "status"))
    all_missing = F.array_join(F.when(table, F.col("_missing")).otherwise(F.concat("_missing", F.array(F.lit("temporal_frames")))), ";")
    return df.select("clip_id", "status", all_missing.alias("missing_artifacts"), "error", "temporal_first_frame", "temporal_last_frame", "temporal_frame_count", "alignment_status", "alignment_notes", "annotation_status", reason.alias("blocked_reason"))


def source_errors(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(clip_id, source_error) of the manifest rows (clip_id, half, video_path, game_id) that can't be a source: repeated ids, halves, names and games that don't fit, files (path) that aren't there. Of a repeated id, the messages of its last row by video_path."""
    path = F.translate(F.coalesce("video_path", F.lit("")), "\\", "/")
    name, game = F.substring_index(path, "/", -1), F.translate(F.coalesce("game_id", F.lit("")), "\\", "/")
    there = files.select(F.col("path").alias("video_path"), F.lit(True).alias("_there")).distinct()
    df = manifest.withColumn("_n", F.count("*").over(Window.partitionBy("clip_id"))).join(there, "video_path", "left")
    known = name.isin("1_720p.mkv", "2_720p.mkv")
    half = F.coalesce(F.col("half").cast("string"), F.lit(""))
    said = F.array_join(F.filter(F.array(
        F.when(F.col("_n") > 1, "duplicate clip_id"), F.when(~half.isin("1", "2"), "half is not 1 or 2"),
        F.when(~known, "source is not 1_720p.mkv or 2_720p.mkv").when(F.substring(name, 1, 1) != half, "half does not match source filename"),
        F.when(F.col("_there").isNull(), "source video missing"), F.when((game != "") & ~F.contains(path, game), "video_path does not contain game_id"),
    ), lambda x: x.isNotNull()), "; ")
    return df.withColumn("_said", said).where("_said <> ''").groupBy("clip_id").agg(F.max_by("_said", F.coalesce("video_path", F.lit(""))).alias("source_error"))


def stage_counts(stages: DataFrame) -> DataFrame:
    """(stage, status, clips) of stages (clip_id, stage, status)."""
    return stages.groupBy("stage", "status").agg(F.countDistinct("clip_id").alias("clips"))


def upload_inventory(rows: DataFrame, files: DataFrame, overwrite: bool = False) -> DataFrame:
    """What an upload of each clip would meet: rows (clip_id, video_filename, source_clip_path, annotation_status), files (path) of the sources, and (path) of uploads named by their file name. Status: not_ready_for_cvat, duplicate_destination, missing_source_clip, already_exists or ready. Nothing is copied."""
    there = files.select("path").distinct()
    df = rows.withColumn("_n", F.count("*").over(Window.partitionBy("video_filename")))
    df = df.join(there.select(F.col("path").alias("source_clip_path"), F.lit(True).alias("_source")), "source_clip_path", "left").join(there.select(F.col("path").alias("video_filename"), F.lit(True).alias("_copy")), "video_filename", "left")
    source, copy = F.coalesce("_source", F.lit(False)), F.coalesce("_copy", F.lit(False))
    status = F.when(~F.coalesce(F.col("annotation_status") == "ready_for_cvat", F.lit(False)), "not_ready_for_cvat").when(F.col("_n") > 1, "duplicate_destination").when(~source, "missing_source_clip").when(copy & F.lit(not overwrite), "already_exists").otherwise("ready")
    error = F.when(status == "duplicate_destination", "duplicate video_filename in manifest").when(status == "missing_source_clip", "source_clip_path does not exist").otherwise("")
    return df.select("clip_id", "video_filename", "source_clip_path", source.alias("source_exists"), copy.alias("upload_copy_exists"), status.alias("status"), error.alias("error"))


def compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two summaries (section, metric, value) side by side, with the difference of numbers; what only one has is null in the other."""
    a, b = (df.where("section is not null and metric is not null").select("section", "metric", F.col("value").cast("string").alias(k)) for df, k in ((first, "first"), (second, "second")))
    n = lambda c: F.col(c).try_cast("double")
    return a.join(b, ["section", "metric"], "full").withColumn("difference", n("second") - n("first"))


def detection_rates(summary: DataFrame) -> DataFrame:
    """One row of a ball detector's summary: raw and filtered detections and those a frame, 0 without frames."""
    of = lambda m: F.coalesce(F.max(F.when((F.col("section") == "counts") & (F.col("metric") == m), F.col("value").cast("string").try_cast("double"))), F.lit(0.0))
    g = summary.agg(of("frames").alias("frames"), of("raw_detections").alias("raw"), of("filtered_detections").alias("filtered"))
    return g.withColumns({"raw_per_frame": share(F.col("raw"), F.col("frames")), "filtered_per_frame": share(F.col("filtered"), F.col("frames"))})


def best_epochs(history: DataFrame) -> DataFrame:
    """Of each run of history (run, epoch, accuracy, macro_f1): the first epoch of the highest macro F1 with its figures, the last one's figures, and how many epochs there are."""
    row = F.struct("epoch", "accuracy", "macro_f1")
    best = F.max_by(row, F.struct(F.coalesce("macro_f1", F.lit(-1.0)), -F.col("epoch")))
    g = history.groupBy("run").agg(best.alias("b"), F.max_by(row, "epoch").alias("l"), F.count("*").alias("epochs_run"))
    return g.select("run", "epochs_run", F.col("b.epoch").alias("best_epoch"), F.col("b.accuracy").alias("best_accuracy"), F.col("b.macro_f1").alias("best_macro_f1"), F.col("l.accuracy").alias("final_accuracy"), F.col("l.macro_f1").alias("final_macro_f1"))


def run_summary(history: DataFrame, per_class: DataFrame, windows: DataFrame, classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """best_epochs with each class's F1 on the test split (per_class: run, split, target_class, f1; 0 if it is missing) and the selected windows of each split."""
    f1 = per_class.where("split = 'test'").groupBy("run").agg(*(F.max(F.when(F.col("target_class") == c, F.col("f1"))).alias(f"{c}_f1") for c in classes))
    n = selected(windows).agg(F.count("*").alias("total_windows"), *(F.count_if(F.col("split") == s).alias(f"{s}_windows") for s in ("train", "val", "test")))
    df = best_epochs(history).join(f1, "run", "left").join(F.broadcast(n))  # one row
    return df.na.fill(0.0, [f"{c}_f1" for c in classes])


def predictions(scored: DataFrame, column: str = "probabilities", classes: tuple[str, ...] = CLASSES) -> DataFrame:
    """scored with predicted_class and predicted_probability (6 digits): the first class of the highest probability; null without any."""
    p, names = F.col(column), F.array(*map(F.lit, classes))
    at = F.array_position(p, F.array_max(p))
    return scored.withColumns({"predicted_class": F.try_element_at(names, at.cast("int")), "predicted_probability": F.round(F.array_max(p), 6)}).drop(column)


def slot_speed(asked: DataFrame, frames: DataFrame, slots: int = 4) -> DataFrame:
    """asked (clip_id, frame, player_id, ...) with the player's speed in that frame, if they are one of its nearest players, and the defenders near the ball. frames: the frame table."""
    each = F.array(*(F.struct(F.col(f"p{i}_track_id").alias("id"), F.col(f"p{i}_speed").alias("speed")) for i in range(1, slots + 1)))
    f = frames.select("clip_id", "frame", each.alias("_slots"), "defenders_near_ball")
    df = asked.join(f, ["clip_id", "frame"], "left")
    mine = F.filter("_slots", lambda x: x["id"] == F.col("player_id"))
    return df.withColumn("player_speed", F.try_element_at(mine, F.lit(1))["speed"]).drop("_slots")


def season(game_id: Column) -> Column:
    """The second part of a game's id; empty without one."""
    return F.coalesce(F.get(F.split(F.translate(game_id, "\\", "/"), "/"), F.lit(1)), F.lit(""))


def half_of(path: Column) -> Column:
    """2 if the file's name begins with 2 or holds h2, else 1."""
    name = F.lower(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""))
    return F.when(name.startswith("2") | F.contains(name, F.lit("h2")), 2).otherwise(1)


def video_filename(half: Column, resolution: str) -> Column:
    return F.concat(half.cast("string"), F.lit(f"_{resolution}.mkv"))


def fetch_plan(rows: DataFrame, resolution: str = "720p") -> DataFrame:
    """rows (relative_video_path; split columns if there are any) with game_id, filename, tracking_split and error.

    A path must be relative and stay inside its root. The file name is the path's own
    if it tells the resolution, else it is made from the half. The split is the first
    of tracking_split, split, dataset_split that isn't empty, else the path's first
    folder if that is a split's name.
    """
    path = F.translate(F.coalesce("relative_video_path", F.lit("")), "\\", "/")
    safe = ~(path.startswith("/") | F.array_contains(F.split(path, "/"), ".."))
    folders = F.instr(path, "/") > 0
    name = F.substring_index(path, "/", -1)
    file = F.when(F.contains(name, F.lit(resolution)), name).otherwise(video_filename(half_of(path), resolution))
    error = F.when(~safe, F.concat(F.lit("relative_video_path must be a safe relative path: "), F.coalesce("relative_video_path", F.lit("")))).when(~folders, F.concat(F.lit("relative_video_path must include game folders and filename: "), path)).otherwise("")
    fine = safe & folders
    first = F.when(safe, F.substring_index(path, "/", 1))
    splits = [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("tracking_split", "split", "dataset_split") if c in rows.columns]
    told = F.coalesce(*splits, F.when(first.isin(*SPLITS), first), F.lit(""))
    return rows.withColumns({"game_id": F.when(fine, F.regexp_replace(path, "/[^/]*$", "")), "filename": F.when(fine, file), "tracking_split": told, "error": error})


def inventory_summary(files: DataFrame, clips: DataFrame) -> DataFrame:
    """(metric, value) of an inventory: files, bytes, files of each kind, clips, clips with annotations and with tracking beside them."""
    kinds = ("is_video", "is_annotation", "is_tracking_like", "is_metadata")
    f = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"), *(F.count_if(F.col(k) == 1).alias(k[3:] + "_files") for k in kinds))
    c = clips.agg(F.count("*").alias("clips"), F.count_if(F.col("annotation_paths") != "").alias("clips_with_annotations"), F.count_if(F.col("tracking_paths") != "").alias("clips_with_tracking"))
    one = f.join(c)  # one row each
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).cast("long").alias("value")) for k in one.columns))).alias("x")).select("x.*")
