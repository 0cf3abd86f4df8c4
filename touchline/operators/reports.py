"""Balance and normalisation of data sets, readiness of clips, order of downloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import tokens
from .tables import ranked


def balance_windows(windows: DataFrame, label: str, seed: int = 42) -> DataFrame:
    """As many windows of each class as the rarest has, by split: those with the least of a seeded key of clip and frame."""
    key = (F.col("start_frame") * 2654435761 + F.col("clip_id") * 40503 + seed) % 1000003
    counts = windows.groupBy("split", label).agg(F.count("*").alias("n")).groupBy("split").agg(F.min("n").alias("_cap"))
    return ranked(windows.withColumn("_key", key), ["split", label], F.floor(F.col("_key") / 1024), ["_key", "clip_id", "start_frame"]).drop("_key").join(counts, "split").where(F.col("_rank") <= F.col("_cap")).drop("_rank", "_cap")


def normalise(df: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """z-scores by the training rows' mean and deviation (1 where that is 0); a missing value becomes 0."""
    stats = df.where(F.col(split) == "train").agg(*(f(c).alias(f"_{k}_{c}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop))))
    out = df.join(F.broadcast(stats))  # one row
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_mean_{c}")) / F.when(F.col(f"_std_{c}") > 1e-12, F.col(f"_std_{c}")).otherwise(1.0), F.lit(0.0))
    return out.withColumns({c: z(c) for c in columns}).select(*df.columns)


def window_cover(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """frames with cover, the number of windows (clip_id, start_frame, end_frame) that hold each frame: a window adds one at its start and takes it off behind its end, and a running sum over the clip tells how many are open. No frame is repeated."""
    names = [c for c in frames.columns if c != "cover"]
    edge = lambda frame, n: windows.where("start_frame <= end_frame").select("clip_id", frame.cast("long").alias("frame"), F.lit(n).cast("long").alias("_n"))
    edges = edge(F.col("start_frame"), 1).union(edge(F.col("end_frame") + 1, -1)).groupBy("clip_id", "frame").agg(F.sum("_n").alias("_n"))
    rows = frames.select(*names).withColumn("_row", F.lit(True)).unionByName(edges, allowMissingColumns=True)
    open_ = F.sum(F.coalesce("_n", F.lit(0))).over(Window.partitionBy("clip_id").orderBy("frame").rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("cover", open_).where("_row").select(*names, "cover")


def window_moments(frames: DataFrame, windows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: mean and deviation (of a sample) over the frames of all windows, a frame counting once for each window that holds it, nulls not at all. Mean 0 if nothing counts, deviation 1 if it is 0 or one value is all there is."""
    value = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns)))
    df = window_cover(frames, windows).where("cover > 0").select("cover", value.alias("v")).select("cover", "v.*").where("x is not null")
    means = df.groupBy("feature").agg(F.sum("cover").alias("n"), (F.sum(F.col("x") * F.col("cover")) / F.sum("cover")).alias("mean"))
    off = F.col("x") - F.col("mean")
    spread = df.join(F.broadcast(means), "feature").groupBy("feature").agg(F.sum(off * off * F.col("cover")).alias("_off"))
    names = frames.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    deviation = F.sqrt(F.col("_off") / F.nullif(F.col("n") - 1, F.lit(0)))
    return names.join(means, "feature", "left").join(spread, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0)).alias("std"))


def normalised_frames(frames: DataFrame, windows: DataFrame, columns: list[str], split: str = "split") -> DataFrame:
    """frames with `columns` as z-scores by the moments of the training windows; a missing value becomes 0. A window's features are the rows of its frames."""
    m = window_moments(frames, windows.where(F.col(split) == "train"), columns)
    one = m.agg(*(F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"_{k}_{c}") for c in columns for k in ("mean", "std")))
    z = lambda c: F.coalesce((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}"), F.lit(0.0))
    return frames.join(F.broadcast(one)).withColumns({c: z(c) for c in columns}).select(*frames.columns)  # one row


def event_kind(c: str) -> Column:
    """carry, pass, turnover or shot by how the name of an event's type begins; null: none of them."""
    text = F.lower(F.trim(F.col(c).cast("string")))
    return F.coalesce(*(F.when(text.startswith(p), k) for p, k in (("pass", "pass"), ("turnover", "turnover"), ("interception", "turnover"), ("shot", "shot"), ("carry", "carry"))))


def readiness(clips: DataFrame, frames: DataFrame, features: list[str], candidates: DataFrame, others: dict[str, DataFrame], least: int = 64) -> DataFrame:
    """What each clip lacks for a data set: NOT_READY with reasons, READY_WITH_WARNINGS if it can only give background, else READY.

    frames: the frame table, `features` its measures; candidates: unified events;
    others: further tables by name of which a clip needs a row. A table is missing for
    a clip if it has no row of it.
    """
    usable = F.lit(False)
    for c in features:
        usable = usable | F.col(c).isNotNull()
    f = frames.where("frame is not null").groupBy("clip_id").agg((F.max("frame") - F.min("frame") + 1).alias("frame_count"), F.bool_or(usable).alias("_usable"))
    e = candidates.groupBy("clip_id").agg(F.count("*").alias("event_rows"), F.count(event_kind("event_type")).alias("events_ok"))
    df = clips.select("clip_id").join(f, "clip_id", "left").join(e, "clip_id", "left")
    for name, t in others.items():
        df = df.join(t.groupBy("clip_id").agg(F.lit(True).alias(f"_{name}")), "clip_id", "left")
    df = df.na.fill(0, ["frame_count", "event_rows", "events_ok"]).withColumn("background_possible", (F.col("frame_count") >= least).cast("int"))
    none = (F.col("event_rows") > 0) & (F.col("events_ok") == 0)
    lacks = [(F.col("frame_count") == 0, "missing temporal_frames"), (F.col("event_rows") == 0, "missing unified_candidates"), *((F.col(f"_{n}").isNull(), f"missing {n}") for n in others)]
    lacks += [((F.col("frame_count") > 0) & ~F.coalesce("_usable", F.lit(False)), "no usable numeric temporal features found"), (none & (F.col("background_possible") == 0), "no valid candidate events and not enough frames for background")]
    df = df.withColumns({"reasons": tokens(*lacks), "warnings": tokens((none & (F.col("background_possible") == 1), "no valid candidate events; background only"))})
    status = F.when(F.col("reasons") != "", "NOT_READY").when(F.col("warnings") != "", "READY_WITH_WARNINGS").otherwise("READY")
    return df.withColumn("status", status).drop("_usable", *(f"_{n}" for n in others))


def stage_status(stages: DataFrame, names: list[str]) -> DataFrame:
    """(clip_id, stage, status) as one row a clip; ok if every stage is."""
    one = lambda s: F.coalesce(F.max(F.when(F.col("stage") == s, F.col("status"))), F.lit("missing")).alias(s)
    g = stages.groupBy("clip_id").agg(*map(one, names))
    return g.withColumn("final_status", F.when(F.forall(F.array(*names), lambda x: x == "ok"), "ok").otherwise("failed"))


def download_order(items: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """Round-robin over groups: the best of each, then the second best, and so on."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))
    return items.withColumn("turn", turn.cast("long"))
