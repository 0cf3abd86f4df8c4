"""Tracks: statistics, motion, grids, nearest players, interpolation, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import clip, distance, flag, track


def steps(tracks: DataFrame) -> DataFrame:
    """Distance to the track's row before; null at its first."""
    df = tracks.withColumn("_x", F.lag("center_x").over(track())).withColumn("_y", F.lag("center_y").over(track()))
    return df.withColumn("step", distance("center_x", "center_y", "_x", "_y")).drop("_x", "_y")


def player_stats(tracks: DataFrame) -> DataFrame:
    g = steps(tracks).groupBy("clip_id", "track_id").agg(F.count("center_x").alias("frames_seen"), F.avg("confidence").alias("mean_confidence"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path_length"), (F.max("timestamp") - F.min("timestamp")).alias("time_visible"))
    return g.withColumn("mean_speed", F.when(F.col("time_visible") > 0, F.col("path_length") / F.col("time_visible")).otherwise(0.0))


def top_tracks(tracks: DataFrame, n: int = 5) -> DataFrame:
    """All rows of the n most frequent tracks of each clip, the lower id first at equal counts."""
    count = tracks.groupBy("clip_id", "track_id").agg(F.count("*").alias("n"))
    top = count.withColumn("r", F.row_number().over(clip().orderBy(F.desc("n"), "track_id"))).where(F.col("r") <= n)
    return tracks.join(top.select("clip_id", "track_id"), ["clip_id", "track_id"], "left_semi")


def position_stats(tracks: DataFrame) -> DataFrame:
    g = steps(tracks).groupBy("clip_id", "track_id").agg(F.count("*").alias("frames"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.percentile("center_x", 0.5).alias("median_x"), F.percentile("center_y", 0.5).alias("median_y"), (F.max("center_x") - F.min("center_x")).alias("span_x"), (F.max("center_y") - F.min("center_y")).alias("span_y"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("movement"))
    return g


def heatmap_grid(tracks: DataFrame, width: int, height: int, cols: int = 12, rows: int = 8) -> DataFrame:
    """Points in each cell of a grid and their share of the track."""
    cell = lambda c, size, n: F.least(F.greatest(F.floor(F.col(c) / size * n), F.lit(0)), F.lit(n - 1)).cast("long")
    g = tracks.groupBy("clip_id", "track_id", cell("center_x", width, cols).alias("col"), cell("center_y", height, rows).alias("row")).agg(F.count("*").alias("points"))
    return g.withColumn("fraction", F.col("points") / F.sum("points").over(Window.partitionBy("clip_id", "track_id")))


def trajectories(tracks: DataFrame) -> DataFrame:
    """Gap-aware motion: a missing frame or a time that doesn't advance begins a new segment; speed needs a step within it, acceleration two. gap: frames since the track's row before."""
    df = steps(tracks).withColumn("_gap", F.col("frame") - F.lag("frame").over(track())).withColumn("_dt", F.col("timestamp") - F.lag("timestamp").over(track()))
    df = df.withColumn("_ok", flag((F.col("_gap") == 1) & (F.col("_dt") > 0)))
    df = df.withColumn("segment_id", F.sum(F.when(F.col("_ok"), 0).otherwise(1)).over(track().rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    df = df.withColumn("speed", F.when(F.col("_ok"), F.col("step") / F.col("_dt")))
    return df.withColumn("acceleration", F.when(F.col("_ok"), (F.col("speed") - F.lag("speed").over(track())) / F.col("_dt"))).select("clip_id", "track_id", "frame", F.col("_gap").alias("gap"), "segment_id", F.when(F.col("_ok"), F.col("step")).alias("step"), "speed", "acceleration")


def nearest_players(ball: DataFrame, players: DataFrame, k: int = 4) -> DataFrame:
    """One wide row a frame: the k nearest players' ids and distances; id -1 and missing 1 where there are fewer."""
    b = ball.select("clip_id", "frame", F.col("center_x").alias("ball_x"), F.col("center_y").alias("ball_y"))
    d = b.join(players.select("clip_id", "frame", "track_id", "center_x", "center_y"), ["clip_id", "frame"], "left").withColumn("d", distance("ball_x", "ball_y", "center_x", "center_y"))
    near = d.groupBy("clip_id", "frame").agg(F.slice(F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "track_id")))), 1, k).alias("n"))
    slot = lambda i: F.try_element_at("n", F.lit(i))
    cols = [c for i in range(1, k + 1) for c in (F.coalesce(slot(i)["track_id"], F.lit(-1)).cast("long").alias(f"p{i}_id"), slot(i)["d"].alias(f"p{i}_distance"), slot(i).isNull().cast("int").alias(f"p{i}_missing"))]
    return near.select("clip_id", "frame", *cols)


def with_ball_motion(ball: DataFrame) -> DataFrame:
    """Adds row-to-row velocity and acceleration (vx, vy, ax, ay); frames stand in where time doesn't advance."""
    w = clip().orderBy("frame")
    dt = F.col("timestamp") - F.lag("timestamp").over(w)
    df = ball.withColumn("_dt", F.when(dt > 0, dt).otherwise(F.col("frame") - F.lag("frame").over(w)))
    df = df.withColumn("vx", (F.col("center_x") - F.lag("center_x").over(w)) / F.col("_dt")).withColumn("vy", (F.col("center_y") - F.lag("center_y").over(w)) / F.col("_dt"))
    return df.withColumn("ax", (F.col("vx") - F.lag("vx").over(w)) / F.col("_dt")).withColumn("ay", (F.col("vy") - F.lag("vy").over(w)) / F.col("_dt")).drop("_dt")


def ball_motion(ball: DataFrame) -> DataFrame:
    df = with_ball_motion(ball)
    return df.select("clip_id", "frame", "vx", "vy", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")).alias("ball_speed"), F.sqrt(F.col("ax") * F.col("ax") + F.col("ay") * F.col("ay")).alias("ball_acceleration"), F.col("vx").isNotNull().cast("int").alias("velocity_valid"), F.col("ax").isNotNull().cast("int").alias("acceleration_valid"))


def interpolate(ball: DataFrame, max_gap: int = 8) -> DataFrame:
    """Rows and, between neighbours of a track that 1 to max_gap frames are missing between, linear ones of the lower confidence. Without a column track_id a clip is one track."""
    key = ["clip_id", "track_id"] if "track_id" in ball.columns else ["clip_id"]
    w = Window.partitionBy(*key).orderBy("frame")
    df = ball
    for c in ("frame", "timestamp", "center_x", "center_y", "confidence"):
        df = df.withColumn(f"_{c}", F.lead(c).over(w))
    gap = F.col("_frame") - F.col("frame")
    miss = F.when((gap > 1) & (gap - 1 <= max_gap), F.sequence(F.lit(1).cast("long"), gap - 1)).otherwise(F.array().cast("array<long>"))
    between = df.withColumn("_k", F.explode(miss)).withColumn("_r", F.col("_k") / gap)
    mixed = lambda c: (F.col(c) + F.col("_r") * (F.col(f"_{c}") - F.col(c))).alias(c)
    new = between.select(*key, (F.col("frame") + F.col("_k")).alias("frame"), mixed("timestamp"), mixed("center_x"), mixed("center_y"), F.least("confidence", "_confidence").alias("confidence"), F.lit(1).alias("is_interpolated"))
    return ball.select(*key, "frame", "timestamp", "center_x", "center_y", "confidence", F.lit(0).alias("is_interpolated")).unionByName(new)


def frame_rate(frames: DataFrame, default: float = 25.0) -> DataFrame:
    """1 / median of the positive time steps; the default with fewer than three stamps."""
    w = clip().orderBy("frame")
    g = frames.withColumn("dt", F.col("timestamp") - F.lag("timestamp").over(w)).groupBy("clip_id").agg(F.count("*").alias("n"), F.percentile(F.when(F.col("dt") > 0, F.col("dt")), 0.5).alias("m"))
    return g.select("clip_id", F.when((F.col("n") >= 3) & (F.col("m") > 0), 1 / F.col("m")).otherwise(default).alias("fps"))


def bounds(frames: DataFrame) -> DataFrame:
    return frames.groupBy("clip_id").agg(F.min("frame").alias("min_frame"), F.max("frame").alias("max_frame"), F.count("*").alias("rows"))


def filter_ball_detections(df: DataFrame, frame_height: float, cap: int = 1, area: tuple = (20, 500), width: tuple = (4, 30), height: tuple = (4, 30), top: float = 0.08, bottom: float = 0.0) -> DataFrame:
    """Boxes (clip_id, frame, det_id, width, height, center_y, confidence) with the first gate that they fail; those beyond the `cap` surest of a frame fail `per_frame_confidence_cap`; cap 0: no cap. kept: no gate."""
    size = F.col("width") * F.col("height")
    gates = [(size < area[0], "area_below_min"), (size > area[1], "area_above_max")]
    for c, (low, high) in (("width", width), ("height", height)):
        gates += [(F.col(c) < low, f"{c}_below_min"), (F.col(c) > high, f"{c}_above_max")]
    gates.append((F.col("center_y") < frame_height * top, "excluded_top_region"))
    if bottom > 0:
        gates.append((F.col("center_y") > frame_height * (1 - bottom), "excluded_bottom_region"))
    df = df.withColumn("reason", F.coalesce(*(F.when(c, r) for c, r in gates)))
    if cap > 0:
        w = Window.partitionBy("clip_id", "frame", F.col("reason").isNull()).orderBy(F.desc("confidence"), "det_id")
        df = df.withColumn("_rank", F.row_number().over(w)).withColumn("reason", F.when(F.col("reason").isNull() & (F.col("_rank") > cap), "per_frame_confidence_cap").otherwise(F.col("reason"))).drop("_rank")
    return df.withColumn("kept", F.col("reason").isNull())


def ball_detection_diagnostics(frames: DataFrame, filtered: DataFrame) -> DataFrame:
    """(clip_id, section, metric, value) rows of what filter_ball_detections left: counts of boxes and of frames with none, one or more of them, removals by gate, quartiles of confidence and size, and each frame's counts."""
    per = frames.select("clip_id", "frame").join(filtered.groupBy("clip_id", "frame").agg(F.count("*").alias("raw"), F.count_if("kept").alias("filtered")), ["clip_id", "frame"], "left").na.fill(0, ["raw", "filtered"])
    sums = [F.count("*").alias("frames")]
    for c in ("raw", "filtered"):
        sums += [F.sum(c).alias(f"{c}_detections"), F.count_if(F.col(c) == 0).alias(f"{c}_frames_zero"), F.count_if(F.col(c) == 1).alias(f"{c}_frames_one"), F.count_if(F.col(c) > 1).alias(f"{c}_frames_multiple")]
    counts = _long(per.groupBy("clip_id").agg(*sums), "counts")
    reasons = filtered.where("reason is not null").groupBy("clip_id", F.col("reason").alias("metric")).agg(F.count("*").cast("double").alias("value")).select("clip_id", F.lit("removal_reasons").alias("section"), "metric", "value")
    marks = ("min", "p25", "median", "p75", "max")
    boxes = filtered.withColumn("area", F.col("width") * F.col("height"))
    spread = None
    for name, rows in (("raw", boxes), ("filtered", boxes.where("kept"))):
        g = rows.groupBy("clip_id").agg(*(F.percentile(c, [0.0, 0.25, 0.5, 0.75, 1.0]).alias(c) for c in ("confidence", "width", "height", "area")))
        one = _long(g.select("clip_id", *(F.col(c)[i].alias(f"{c}_{m}") for c in ("confidence", "width", "height", "area") for i, m in enumerate(marks))), f"{name}_distribution")
        spread = one if spread is None else spread.unionByName(one)
    each = per.select("clip_id", F.explode(F.array(*(F.struct(F.lit(f"{c}_frame_counts").alias("section"), F.col("frame").cast("string").alias("metric"), F.col(c).cast("double").alias("value")) for c in ("raw", "filtered")))).alias("x")).select("clip_id", "x.*")
    return counts.unionByName(reasons).unionByName(spread).unionByName(each)


def _long(wide: DataFrame, section: str) -> DataFrame:
    """Columns of a clip's row as rows (section, metric, value)."""
    names = [c for c in wide.columns if c != "clip_id"]
    return wide.select("clip_id", F.lit(section).alias("section"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))).alias("x")).select("clip_id", "section", "x.metric", "x.value")


def with_first_time(df: DataFrame) -> DataFrame:
    """df with _first, the clip's first time stamp: a broadcast, since a window would bring a whole clip into one task."""
    first = df.groupBy(F.col("clip_id").alias("_clip")).agg(F.min("timestamp").alias("_first"))
    return df.join(F.broadcast(first), F.col("clip_id").eqNullSafe(F.col("_clip"))).drop("_clip")


def tumbling_means(tracks: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Windows from the clip's first time stamp on."""
    k = F.floor((F.col("timestamp") - F.col("_first")) / seconds + 1e-9).cast("long")
    return with_first_time(tracks).withColumn("window", k).groupBy("clip_id", "window").agg(F.count("*").alias("rows"), F.avg("center_x").alias("mean_x"), F.stddev_pop("center_x").alias("std_x"), F.percentile("center_y", 0.5).alias("median_y"))


def overlapping(a: DataFrame, b: DataFrame, width: int = 64) -> DataFrame:
    """Pairs of intervals (clip_id, a_start, a_end, ...) and (clip_id, b_start, b_end, ...) that share a frame. Both are dealt to buckets of `width` frames, and a pair belongs to the first that both touch: the join is on equal keys."""

    def dealt(df: DataFrame, k: str) -> DataFrame:
        first = F.floor(F.col(f"{k}_start") / width)
        return df.withColumn(f"_{k}", first).withColumn("_bucket", F.explode(F.sequence(first, F.floor(F.col(f"{k}_end") / width))))

    return dealt(a.where("a_start <= a_end"), "a").join(dealt(b.where("b_start <= b_end"), "b"), ["clip_id", "_bucket"]).where((F.col("_bucket") == F.greatest("_a", "_b")) & (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))).drop("_a", "_b", "_bucket")


def centred(start, end, region: int):
    """First and last frame of the region in the middle of a window."""
    first = F.floor((start + end) / 2) - max(1, region) // 2
    return F.greatest(start, first), F.least(end, first + max(1, region) - 1)


def labelled(windows: DataFrame, labels: DataFrame, region: int, priority) -> DataFrame:
    """windows (clip_id, start_frame, end_frame) with the class of the event that overlaps most with the middle region; the later class wins ties, then the lower event_id; none: the first class."""
    first, last = centred(F.col("start_frame"), F.col("end_frame"), region)
    w = windows.withColumns({"a_start": first, "a_end": last})
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("label"))
    e = labels.select("clip_id", "event_id", "label", F.col("start_frame").alias("b_start"), F.col("end_frame").alias("b_end"))
    over = F.least("a_end", "b_end") - F.greatest("a_start", "b_start") + 1
    best = overlapping(w, e).groupBy("clip_id", "start_frame").agg(F.max(F.struct(over.alias("overlap"), rank.alias("rank"), (-F.col("event_id")).alias("id"))).alias("x"))
    df = w.join(best, ["clip_id", "start_frame"], "left")
    kind = F.when(F.col("x").isNotNull(), F.try_element_at(F.array(*map(F.lit, priority)), F.col("x.rank").cast("int")))
    return df.select(*windows.columns, F.col("a_start").alias("label_start_frame"), F.col("a_end").alias("label_end_frame"), F.coalesce(kind, F.lit(priority[0])).alias("target_class"), (-F.col("x.id")).alias("event_id"), F.coalesce("x.overlap", F.lit(0)).cast("long").alias("event_overlap_frames"))


def hopping_windows(frames: DataFrame, labels: DataFrame, size: int = 64, stride: int = 8, region: int = 16, priority=("background", "carry", "pass", "turnover", "shot")) -> DataFrame:
    """Windows of size frames each stride, from a clip's first frame to its last, labelled by their middle."""
    b = bounds(frames).where(F.col("max_frame") - F.col("min_frame") + 1 >= size)
    w = b.select("clip_id", F.explode(F.sequence(F.col("min_frame"), F.col("max_frame") - size + 1, F.lit(stride).cast("long"))).alias("start_frame"))
    return labelled(w.withColumn("end_frame", F.col("start_frame") + size - 1), labels, region, priority)


def window_features(windows: DataFrame, frames: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each frame from a window's start to its end, whether the table has it or not: an absent value is that of the window's last frame before that has one, else of the next, else 0."""
    key = ["clip_id", "start_frame"]
    dense = windows.select(*key, F.explode(F.sequence("start_frame", "end_frame")).alias("frame")).join(frames.select("clip_id", "frame", *columns), ["clip_id", "frame"], "left")
    w = Window.partitionBy(*key).orderBy("frame")
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    filled = [F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after), F.lit(0.0)).alias(c) for c in columns]
    return dense.select(*key, (F.col("frame") - F.col("start_frame")).alias("position"), "frame", *filled)


def nearest_within(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """For each row of left (id, frame) the row of right within tolerance frames that is nearest, the lower id at equal distance. Frames are bucketed, so the join is on equal keys; it is never a broadcast, as Spark doesn't know that left has three rows each here."""
    a = left.select("clip_id", F.col("id").alias("left_id"), F.col("frame").alias("left_frame")).withColumn("_b", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda i: F.floor(F.col("left_frame") / (tolerance + 1)) + i)))
    b = right.select("clip_id", F.col("id").alias("right_id"), F.col("frame").alias("right_frame")).withColumn("_b", F.floor(F.col("right_frame") / (tolerance + 1)))
    hit = a.hint("merge").join(b, ["clip_id", "_b"]).withColumn("delta", F.abs(F.col("left_frame") - F.col("right_frame"))).where(F.col("delta") <= tolerance)
    best = hit.groupBy("clip_id", "left_id").agg(F.min(F.struct("delta", "right_id", "right_frame")).alias("m"))
    return left.select("clip_id", F.col("id").alias("left_id")).join(best, ["clip_id", "left_id"], "left").select("clip_id", "left_id", "m.right_id", "m.delta", "m.right_frame")
