"""Greedy linking of detections over frames, and greedy matching of boxes.

What a frame's detections link to depends on the frame before, so a clip's rows
are folded in order; clips spread over the cluster and bound a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import share

LINKED = "clip_id long, track_id long, frame long, timestamp double, center_x double, center_y double, confidence double"
FOLLOWED = "clip_id long, frame long, det_id long, track_id long, x1 double, y1 double, x2 double, y2 double, center_x double, center_y double"


def _greedy(pairs: list[tuple]) -> dict[int, int]:
    """Detection -> track, from pairs (..., track, detection) taken in order while both are free."""
    of, taken = {}, set()
    for *_, t, k in sorted(pairs):
        if k not in of and t not in taken:
            of[k] = t
            taken.add(t)
    return of


class LinkMachine:
    """Links a clip's ball detections, frame by frame. State: the next track's number, and of each open track its last frame and place, and the points that wait until it has `least` of them (null after that)."""

    out = LINKED

    def __init__(self, reach: float, max_gap: int, least: int):
        self.reach, self.max_gap, self.least = reach, max_gap, least

    def begin(self) -> dict:
        return {"next": 1, "open": []}

    def idle(self, state: dict) -> dict:
        return {**state, "open": []}

    def step(self, state: dict, frame: int, dets: list[dict]) -> tuple[dict, list[dict]]:
        """(the next state, points of tracks that have `least` points) of a frame's detections in order of det_id."""
        open_ = {t: (f, x, y, held) for t, f, x, y, held in state["open"] if frame - f - 1 <= self.max_gap}
        pairs = []
        for t, (f, x, y, _) in open_.items():
            for k, d in enumerate(dets):
                dist = math.hypot(d["center_x"] - x, d["center_y"] - y)
                if dist <= self.reach * (frame - f):
                    pairs.append((dist - 25 * d["confidence"], dist, t, k))
        of, new, out = _greedy(pairs), state["next"], []
        for k, d in enumerate(dets):
            if k not in of:
                of[k], new = new, new + 1
            point = {**d, "track_id": of[k], "frame": frame}
            held = open_[of[k]][3] if of[k] in open_ else []
            if held is not None:
                held = [*held, point]
                if len(held) >= self.least:
                    out, held = out + held, None
            else:
                out.append(point)
            open_[of[k]] = (frame, d["center_x"], d["center_y"], held)
        return {"next": new, "open": [[t, *x] for t, x in open_.items()]}, out


class CentroidMachine:
    """Follows a clip's players by their boxes, frame by frame. State: the next track's number, and of each open track its last frame and smoothed box."""

    out = FOLLOWED

    def __init__(self, reach: float, max_missing: int, smooth: float):
        self.reach, self.max_missing, self.smooth = reach, max_missing, min(1.0, max(0.0, smooth))

    def begin(self) -> dict:
        return {"next": 1, "open": []}

    def idle(self, state: dict) -> dict:
        return {**state, "open": []}

    def step(self, state: dict, frame: int, dets: list[dict]) -> tuple[dict, list[dict]]:
        middle = lambda b: ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2)
        open_ = {t: (f, box) for t, f, box in state["open"] if frame - f - 1 <= self.max_missing}
        boxes = [[d[c] for c in ("x1", "y1", "x2", "y2")] for d in dets]
        pairs = [(d, t, k) for t, (_, old) in open_.items() for k, box in enumerate(boxes) if (d := math.dist(middle(old), middle(box))) <= self.reach]
        of, new, out = _greedy(pairs), state["next"], []
        for k, d in enumerate(dets):
            if k in of:
                boxes[k] = [float(round(self.smooth * a + (1 - self.smooth) * b)) for a, b in zip(open_[of[k]][1], boxes[k], strict=True)]
            else:
                of[k], new = new, new + 1
            open_[of[k]] = (frame, boxes[k])
            x, y = middle(boxes[k])
            out.append({**d, "frame": frame, "track_id": of[k], **dict(zip(("x1", "y1", "x2", "y2"), boxes[k], strict=True)), "center_x": x, "center_y": y})
        return {"next": new, "open": [[t, *x] for t, x in open_.items()]}, out


def worked_off(batches: Iterator[pa.RecordBatch], machine, least_rows: int = 8192) -> Iterator[pa.RecordBatch]:
    """The rows that a machine gives for rows in order of clip, frame and detection, as they come: held are a frame, the machine's state and the rows of one batch to come."""
    schema = pa.schema([(n, pa.int64() if k == "long" else pa.float64()) for n, k in (c.split() for c in machine.out.split(", "))])
    at, dets, state, out = None, [], machine.begin(), []

    def packed() -> pa.RecordBatch:  # a measure that isn't known is null
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type, from_pandas=True) for f in schema], schema=schema)

    for batch in batches:
        names, nan = batch.schema.names, pa.scalar(float("nan"))
        columns = [(c.fill_null(nan) if pa.types.is_floating(c.type) else c) for c in batch.columns]
        for values in zip(*(c.to_numpy(zero_copy_only=False).tolist() if not c.null_count else c.to_pylist() for c in columns), strict=True):
            row = dict(zip(names, values, strict=True))
            key = (row["clip_id"], row["frame"])
            if key != at:
                if dets:
                    state, rows = machine.step(state, at[1], dets)
                    out += rows
                    if len(out) >= least_rows:
                        yield packed()
                        out = []
                if at is None or key[0] != at[0]:
                    state = machine.begin()
                at, dets = key, []
            dets.append(row)
    if dets:
        out += machine.step(state, at[1], dets)[1]
    if out:
        yield packed()


def _folded(df: DataFrame, machine) -> DataFrame:
    """The rows that a machine gives for each clip's frames in order; a clip streams through its task."""
    rows = df.where("frame is not null").repartition("clip_id").sortWithinPartitions("clip_id", "frame", F.col("det_id").asc_nulls_last())
    return rows.mapInArrow(lambda batches: worked_off(batches, machine), machine.out)


def link_ball_tracks(detections: DataFrame, reach: float = 90.0, max_gap: int = 8, least: int = 2) -> DataFrame:
    """Ball detections (clip_id, frame, det_id, timestamp, center_x, center_y, confidence) joined to tracks.

    A detection may follow a track within `reach` pixels a frame; the pairs are
    taken in order of distance less 25 times the confidence. A track ends when
    more than `max_gap` frames are missing; tracks of fewer than `least` points go.
    """
    df = detections.select(*(F.col(c).cast(k) for c, k in (("clip_id", "long"), ("frame", "long"), ("det_id", "long"), ("timestamp", "double"), ("center_x", "double"), ("center_y", "double"), ("confidence", "double"))))
    return _folded(df, LinkMachine(reach, max_gap, least))


def with_gaps_filled(linked: DataFrame, max_gap: int = 8) -> DataFrame:
    """linked with is_interpolated, and points on the line between neighbouring points of a track where 1 to `max_gap` frames are missing; their confidence is the lower of the two."""
    w = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    names = ("frame", "timestamp", "center_x", "center_y", "confidence")
    df = linked.withColumn("_next", F.lead(F.struct(*names)).over(w))
    gap = F.col("_next.frame") - F.col("frame") - 1
    steps = F.when(gap.between(1, max_gap), F.sequence(F.lit(0).cast("long"), gap)).otherwise(F.array(F.lit(0).cast("long")))
    df = df.withColumn("_gap", gap).withColumn("_step", F.explode(steps))
    on = F.col("_step") / (F.col("_gap") + 1)
    between = {c: F.when(F.col("_step") > 0, F.col(c) + on * (F.col(f"_next.{c}") - F.col(c))).otherwise(F.col(c)) for c in ("timestamp", "center_x", "center_y")}
    sure = F.when(F.col("_step") > 0, F.least("confidence", "_next.confidence")).otherwise(F.col("confidence"))
    return df.select("clip_id", "track_id", (F.col("frame") + F.col("_step")).alias("frame"), *(v.alias(c) for c, v in between.items()), sure.alias("confidence"), (F.col("_step") > 0).alias("is_interpolated"))


def ball_tracking_summary(filled: DataFrame) -> DataFrame:
    """Per clip (of with_gaps_filled): tracks, the longest, the mean length, interpolated points and filled gaps."""
    w = Window.partitionBy("clip_id", "track_id").orderBy("frame")
    first = F.col("is_interpolated") & ~F.lag("is_interpolated").over(w)
    g = filled.withColumn("_first", first).groupBy("clip_id", "track_id").agg(F.count("*").alias("n"), F.count_if("is_interpolated").alias("points"), F.count_if("_first").alias("gaps"))
    return g.groupBy("clip_id").agg(F.count("*").alias("tracks"), F.max("n").alias("longest"), F.avg("n").alias("mean_length"), F.sum("points").alias("interpolated_points"), F.sum("gaps").alias("gaps_filled"))


def frame_times(detections: DataFrame) -> DataFrame:
    """Every frame of a clip from its first to its last detection, with a time: that of its detections (the last by det_id), or frame times the clip's median frame duration (1/30 s if no two frames tell it)."""
    f = detections.groupBy("clip_id", "frame").agg(F.max_by("timestamp", "det_id").alias("timestamp"))
    w = Window.partitionBy("clip_id").orderBy("frame")
    each = (F.col("timestamp") - F.lag("timestamp").over(w)) / (F.col("frame") - F.lag("frame").over(w))
    clips = f.withColumn("_d", each).groupBy("clip_id").agg(F.min("frame").alias("a"), F.max("frame").alias("b"), F.coalesce(F.percentile(F.when(F.col("_d") > 0, F.col("_d")), 0.5), F.lit(1 / 30)).alias("duration"))
    spine = clips.select("clip_id", "duration", F.explode(F.sequence("a", "b")).alias("frame"))
    return spine.join(f, ["clip_id", "frame"], "left").select("clip_id", "frame", F.coalesce("timestamp", F.col("frame") * F.col("duration")).alias("timestamp"), F.col("timestamp").isNull().alias("is_extrapolated"))


def centroid_track(detections: DataFrame, reach: float = 120.0, max_missing: int = 30, smooth: float = 0.7, least_area: float = 100.0) -> DataFrame:
    """People (clip_id, frame, det_id, class_name, x1, y1, x2, y2) followed by the nearest smoothed box: the old box counts `smooth`, corners are whole pixels. Other classes and boxes of less than `least_area` are left out. A track ends after more than `max_missing` frames without a match."""
    return _folded(people(detections, least_area), CentroidMachine(reach, max_missing, smooth))


def people(detections: DataFrame, least_area: float = 100.0) -> DataFrame:
    """The detections that centroid_track follows."""
    area = F.greatest(F.lit(0), F.col("x2") - F.col("x1")) * F.greatest(F.lit(0), F.col("y2") - F.col("y1"))
    df = detections.where((F.col("class_name") == "person") & (area >= least_area))
    kept = [c for c in ("ts",) if c in df.columns]
    return df.select(*(F.col(c).cast("long") for c in ("clip_id", "frame", "det_id")), *(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")), *kept)


#: Side of the square that stands for a ball in box matching.
BALL_SIDE = 15.0


def evaluated_boxes(tracks: DataFrame, ball: DataFrame) -> DataFrame:
    """Predictions for detection_metrics: boxes of all tracks but referees as Player, a square around each ball as Ball."""
    half = BALL_SIDE / 2
    players = tracks.where(~F.lower(F.col("class_name")).eqNullSafe("referee")).select("clip_id", "frame", F.lit("Player").alias("class_name"), F.col("track_id").alias("box_id"), "x1", "y1", "x2", "y2")
    return players.unionByName(ball.select("clip_id", "frame", F.lit("Ball").alias("class_name"), F.lit(0).cast("long").alias("box_id"), (F.col("center_x") - half).alias("x1"), (F.col("center_y") - half).alias("y1"), (F.col("center_x") + half).alias("x2"), (F.col("center_y") + half).alias("y2")))


def _iou(p, q):
    w, h = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"]), F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    area = lambda b: (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])
    return F.coalesce(F.try_divide(both, area(p) + area(q) - both), F.lit(0.0))


def detection_metrics(truth: DataFrame, found: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes (clip_id, frame, class_name, box_id, x1, y1, x2, y2) of both sides: counts, precision, recall and F1 by class, over the frames that truth has.

    Predictions come in order of box_id; each takes the free true box of the
    largest overlap (the first at equal overlap) if that is `least` or more. A fold
    over a frame's arrays in column expressions.
    """
    key, box = ["clip_id", "frame", "class_name"], ["x1", "y1", "x2", "y2"]
    side = lambda df, c: df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("box_id", *(F.col(x).cast("double").alias(x) for x in box)))).alias(c))
    judged = side(found, "b").join(truth.select("clip_id", "frame").distinct(), ["clip_id", "frame"], "left_semi")
    m = side(truth, "a").join(judged, key, "full")
    m = m.withColumns({c: F.coalesce(c, F.array().cast(m.schema[c].dataType)) for c in ("a", "b")})

    def take(taken, p):
        each = F.transform(F.col("a"), lambda q, i: F.struct(_iou(p, q).alias("iou"), (-i).alias("i")))
        best = F.array_max(F.filter(each, lambda x: (x["iou"] > 0) & ~F.array_contains(taken, -x["i"])))
        # an array of one, so that the best is looked for once and not for each of its fields
        return F.get(F.transform(F.array(best), lambda x: F.when(x["iou"] >= least, F.concat(taken, F.array(-x["i"]))).otherwise(taken)), 0)

    m = m.select("class_name", F.size(F.aggregate("b", F.array().cast("array<int>"), take)).alias("m"), F.size("a").alias("na"), F.size("b").alias("nb"))
    g = m.groupBy("class_name").agg(F.sum("m").alias("tp"), (F.sum("nb") - F.sum("m")).alias("fp"), (F.sum("na") - F.sum("m")).alias("fn"))
    tp = F.col("tp")
    return g.withColumn("precision", share(tp, tp + F.col("fp"))).withColumn("recall", share(tp, tp + F.col("fn"))).withColumn("f1", share(2 * tp, 2 * tp + F.col("fp") + F.col("fn")))
