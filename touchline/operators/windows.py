"""Windows of frames for training: by rows, around events, of background, of whole clips; and their split by clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, flag
from .motion import bounds, labelled, overlapping
from .reports import event_kind
from .tables import ranked

#: Classes in order; of events at the same frame the later class stays.
CLASSES = ("background", "carry", "pass", "turnover", "shot")


def missing_masks(table: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles, nulls as 0, and a 0/1 mask `<feature>_missing_mask` of each that has nulls (one aggregate of the whole table tells which)."""
    null = lambda c: F.col(c).try_cast("double").isNull()
    some = table.agg(*(F.coalesce(F.bool_or(null(c)), F.lit(False)).alias(c) for c in features)).first()
    masks = {f"{c}_missing_mask": null(c).cast("double") for c in features if some[c]}
    return table.select(*(c for c in table.columns if c not in features), *(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).alias(c) for c in features), *(v.alias(k) for k, v in masks.items()))


def carry_windows(labels: DataFrame, length: int = 64, stride: int = 16) -> DataFrame:
    """Windows of `length` rows each `stride` rows of a clip, labelled by their middle row. contains_frame_gap: frames are missing inside; such a window isn't one to train on."""
    w = clip().orderBy("frame")
    ahead = lambda c, n: F.lead(c, n).over(w)
    df = labels.select("clip_id", F.col("frame").alias("start_frame"), ahead("frame", length - 1).alias("end_frame"), ahead("frame", length // 2).alias("center_frame"), ahead("label", length // 2).alias("label"), ahead("label_id", length // 2).alias("label_id"), (F.row_number().over(w) - 1).alias("_row"))
    df = df.where(F.col("end_frame").isNotNull() & (F.col("_row") % stride == 0)).drop("_row")
    return df.withColumns({"window_length": F.lit(length), "contains_frame_gap": (F.col("end_frame") - F.col("start_frame") != length - 1).cast("int")})


def weak_events(unified: DataFrame) -> DataFrame:
    """Unified events as candidates of windows: known kinds, no duplicates, bounds in order."""
    kind = event_kind("event_type")
    df = unified.where(kind.isNotNull() & F.col("duplicate_of").isNull())
    return df.select("clip_id", F.col("event_id").cast("string").alias("candidate_id"), kind.alias("target_class"), F.least("start_frame", "end_frame").alias("event_start"), F.greatest("start_frame", "end_frame").alias("event_end"), "center_frame", F.col("source_type").alias("source_event_type"), F.col("weak_eligible").alias("is_eligible_for_weak_label"))


def _precedence() -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), F.col("target_class"))


def _ids(hit: Column | None = None) -> Column:
    """Ids of the events that a window meets, in order of place, falling precedence and id."""
    one = F.struct("center_frame", (-_precedence()).alias("p"), "candidate_id")
    return F.array_join(F.transform(F.array_sort(F.collect_list(one if hit is None else F.when(hit, one))), lambda x: x["candidate_id"]), ";")


def weak_event_windows(frames: DataFrame, events: DataFrame, window: int = 200, region: int = 25, stride: int = 50, margin: int = 25) -> tuple[DataFrame, DataFrame]:
    """(windows, rejections) of clips: one window around each event (weak_events), padded beyond the clip's ends, and background windows each `stride` frames whose middle keeps `margin` frames from every event.

    Of events at the same frame the one of the highest class stays, then the least
    id. context_contains_other_event: another event lies in the window.
    """
    b = bounds(frames)
    of = Window.partitionBy("clip_id", "center_frame").orderBy(F.desc(_precedence()), "candidate_id")
    once = events.withColumn("_r", F.row_number().over(of)).where("_r = 1").drop("_r").join(b.select("clip_id", "min_frame", "max_frame"), "clip_id")
    start, first = F.col("center_frame") - window // 2, F.col("center_frame") - region // 2
    w = once.withColumns({"start_frame": start, "end_frame": start + window - 1, "label_start_frame": first, "label_end_frame": first + region - 1})
    w = w.withColumns({"valid_start_frame": F.greatest("start_frame", "min_frame"), "valid_end_frame": F.least("end_frame", "max_frame"), "padding_before_frames": F.greatest(F.col("min_frame") - F.col("start_frame"), F.lit(0)), "padding_after_frames": F.greatest(F.col("end_frame") - F.col("max_frame"), F.lit(0))})
    w = w.withColumns({"observed_frames": F.greatest(F.col("valid_end_frame") - F.col("valid_start_frame") + 1, F.lit(0)), "padding_frames": F.col("padding_before_frames") + F.col("padding_after_frames")})
    whole = F.col("observed_frames") + F.col("padding_frames") == window
    e = events.select("clip_id", F.col("event_start").alias("b_start"), F.col("event_end").alias("b_end"), "center_frame", "candidate_id", "target_class")
    key = w.where(whole).select("clip_id", F.col("candidate_id").alias("own"), F.col("start_frame").alias("a_start"), F.col("end_frame").alias("a_end"))
    other = overlapping(key, e, max(16, window)).where("own <> candidate_id").groupBy("clip_id", F.col("own").alias("candidate_id")).agg(F.lit(1).alias("_other"))
    common = ["clip_id", "start_frame", "end_frame", "valid_start_frame", "valid_end_frame", "center_frame", "label_start_frame", "label_end_frame", "observed_frames", "padding_frames", "padding_before_frames", "padding_after_frames", "context_contains_other_event", "target_class", "label_source", "candidate_id", "source_event_type", "is_eligible_for_weak_label"]
    event_windows = w.where(whole).join(other, ["clip_id", "candidate_id"], "left").withColumns({"context_contains_other_event": F.coalesce("_other", F.lit(0)), "label_source": F.lit("weak_unified_event_candidates")}).select(*common)

    room = F.col("max_frame") - F.col("min_frame") + 1 >= window
    bg = b.where(room).select("clip_id", F.explode(F.sequence(F.col("min_frame"), F.col("max_frame") - window + 1, F.lit(max(1, stride)).cast("long"))).alias("start_frame"))
    first = F.col("start_frame") + window // 2 - region // 2
    bg = bg.withColumns({"end_frame": F.col("start_frame") + window - 1, "label_start_frame": first, "label_end_frame": first + region - 1})
    inside = (F.col("b_start") <= F.col("label_end_frame")) & (F.col("b_end") >= F.col("label_start_frame"))
    met = overlapping(bg.select("clip_id", "start_frame", "label_start_frame", "label_end_frame", (F.col("label_start_frame") - margin).alias("a_start"), (F.col("label_end_frame") + margin).alias("a_end")), e, max(16, window))
    met = met.groupBy("clip_id", "start_frame").agg(_ids(inside).alias("central"), _ids().alias("near"))
    seen = overlapping(bg.select("clip_id", "start_frame", F.col("start_frame").alias("a_start"), F.col("end_frame").alias("a_end")), e, max(16, window)).groupBy("clip_id", "start_frame").agg(_ids().alias("context"))
    bg = bg.join(met, ["clip_id", "start_frame"], "left").join(seen, ["clip_id", "start_frame"], "left").na.fill("", ["central", "near", "context"])
    free = bg.where("near = ''")
    frames_, zero = F.lit(window).cast("long"), F.lit(0).cast("long")
    background = free.withColumns({"valid_start_frame": F.col("start_frame"), "valid_end_frame": F.col("end_frame"), "center_frame": F.col("start_frame") + window // 2, "observed_frames": frames_, "padding_frames": zero, "padding_before_frames": zero, "padding_after_frames": zero, "context_contains_other_event": (F.col("context") != "").cast("int"), "target_class": F.lit("background"), "label_source": F.lit("weak_background_center_label_region"), "candidate_id": F.lit(""), "source_event_type": F.lit(""), "is_eligible_for_weak_label": F.lit(1)}).select(*common)
    windows = event_windows.unionByName(background).withColumn("padding_percent", F.round(100 * F.col("padding_frames") / window, 6))

    def rejected(df: DataFrame, kind: str, low, high, reason, detail) -> DataFrame:
        return df.select("clip_id", F.lit(kind).alias("window_kind"), low.cast("long").alias("candidate_start_frame"), high.cast("long").alias("candidate_end_frame"), reason.alias("reason"), detail.alias("detail"))

    none, label = F.lit(None), (F.col("label_start_frame"), F.col("label_end_frame"))
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    out = rejected(w.where(~whole), "event", F.col("valid_start_frame"), F.col("valid_end_frame"), F.lit("insufficient_frames"), text("event window has ", F.col("observed_frames").cast("string"), " observed frames and ", F.col("padding_frames").cast("string"), f" padding frames; requires {window}"))
    out = out.unionByName(rejected(b.where(~room), "background", none, none, F.lit("insufficient_frames"), text("clip has ", (F.col("max_frame") - F.col("min_frame") + 1).cast("string"), f" frames; requires {window}")))
    hit = F.col("central") != ""
    out = out.unionByName(rejected(bg.where("near <> ''"), "background", *label, F.when(hit, "center_label_region_overlaps_event").otherwise("center_label_region_too_close_to_event"), F.when(hit, F.col("central")).otherwise(F.col("near"))))
    out = out.unionByName(rejected(free.where("context <> ''"), "background", F.col("start_frame"), F.col("end_frame"), F.lit("accepted_with_noncentral_context_event"), F.col("context")))
    out = out.unionByName(rejected(b.where(room).join(free.select("clip_id").distinct(), "clip_id", "left_anti"), "background", none, none, F.lit("no_valid_background_window"), F.lit("all stride-aligned background starts were rejected or unavailable")))
    return windows, out


def frame_windows(clips: DataFrame, labels: DataFrame, size: int = 64, stride: int = 16, region: int = 16, samples: int = 16) -> DataFrame:
    """Windows of videos (clip_id, frame_count), labelled by their middle, with the frames to be sampled: evenly from the first to the last."""
    w = clips.where(F.col("frame_count") >= size).select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frame_count") - size, F.lit(max(1, stride)).cast("long"))).alias("start_frame")).withColumn("end_frame", F.col("start_frame") + size - 1)
    at = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.bround(F.col("start_frame") + i * (F.lit(float(size - 1)) / (samples - 1))).cast("long")) if samples > 1 else F.array(F.floor((F.col("start_frame") + F.col("end_frame")) / 2))
    return labelled(w, labels, region, CLASSES).withColumn("sample_frames", F.array_join(at.cast("array<string>"), ","))


def clip_disjoint_split(windows: DataFrame, label: str = "target_class", val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """(clip_id, split): no clip in two splits, and the rarest classes first get a clip in train, then test, then val, as far as they have clips.

    Clips come in a seeded order of their hash. What the classes' turns can use are
    the first few clips of each class, which are all that the driver sees; the other
    clips fill test, then val, then train.
    """
    order = F.xxhash64(F.col("clip_id").cast("string"), F.lit(seed))
    held = windows.groupBy("clip_id").agg(F.array_sort(F.collect_set(label)).alias("classes")).withColumn("_order", order)
    counts = {r["c"]: r["n"] for r in held.select(F.explode("classes").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    most = 3 * len(counts) + 3
    rank = F.row_number().over(Window.partitionBy("c").orderBy("_order", "clip_id"))
    first = held.withColumn("c", F.explode("classes")).withColumn("_r", rank).where(F.col("_r") <= most).orderBy("c", "_r").collect()
    of: dict = {}
    sets = {r["clip_id"]: set(r["classes"]) for r in first}

    def turn(mine: list, split: str, c: str, blocked: set) -> None:
        if any(s == split and c in sets[k] for k, s in of.items()):
            return
        clip_id = next((k for k in mine if k not in of), None)
        clip_id = next((k for k in mine if of.get(k) not in blocked), None) if clip_id is None else clip_id
        if clip_id is not None:
            of[clip_id] = split

    for c in sorted(counts, key=lambda c: (counts[c], c)):
        mine = [r["clip_id"] for r in first if r["c"] == c]
        turn(mine, "train", c, {"test", "val"})
        if counts[c] >= 2:
            turn(mine, "test", c, {"train", "val"})
        if counts[c] >= 3:
            turn(mine, "val", c, {"train", "test"})
    n = held.count()
    need = {s: max(0, max(1, round(n * share)) - sum(x == s for x in of.values())) for s, share in (("test", test), ("val", val))}
    kind = held.schema["clip_id"].dataType.simpleString()
    fixed = windows.sparkSession.createDataFrame(list(of.items()), f"clip_id {kind}, fixed string")
    k = F.col("_rank")
    rest = ranked(held.join(fixed, "clip_id", "left_anti"), [], F.shiftright("_order", 54), ["_order", "clip_id"]).withColumn("split", F.when(k <= need["test"], "test").when(k <= need["test"] + need["val"], "val").otherwise("train"))
    return rest.select("clip_id", "split").union(fixed)


def in_two_splits(df: DataFrame, key: str = "clip_id") -> DataFrame:
    """Keys that more than one split holds; none if the split is clean."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1).withColumn("splits", F.array_join("splits", ","))


def approved(events: DataFrame, column: str = "approved") -> DataFrame:
    """Events that a reviewer approved, with bounds in order and without those that lack one."""
    yes = flag(F.lower(F.trim(F.col(column).cast("string"))).isin("1", "true", "yes"))
    df = events.where(yes & F.col("start_frame").isNotNull() & F.col("end_frame").isNotNull())
    return df.withColumns({"start_frame": F.least("start_frame", "end_frame"), "end_frame": F.greatest("start_frame", "end_frame")})
