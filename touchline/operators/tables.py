"""Reading tables of changing form: names of columns, missing measures, repeated rows, nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The names that a column may have, in order of preference.
ALIASES = {
    "frame": ("frame", "frame_id", "frame_number"),
    "timestamp": ("timestamp", "time", "time_sec"),
    "track_id": ("track_id", "player_id", "ball_track_id", "id"),
    "center_x": ("center_x", "cx", "player_center_x", "ball_center_x", "x"),
    "center_y": ("center_y", "cy", "player_center_y", "ball_center_y", "y"),
    "team": ("team", "nearest_player_team", "possession_team"),
    "player_id": ("nearest_player_id", "possessor_track_id", "player_id"),
    "confidence": ("confidence", "ball_confidence"),
    "is_interpolated": ("is_interpolated", "interpolated"),
    "distance_to_ball": ("distance_to_ball", "nearest_distance"),
}


def resolved(df: DataFrame, required: list[str], optional: list[str] = ()) -> DataFrame:
    """The columns of a table by their own names, found by the first alias that the header has in any case; an optional one that isn't there is null. A required one that isn't there: ValueError with the header."""
    header = {c.lower(): c for c in df.columns}
    out = []
    for c in (*required, *optional):
        name = next((header[a] for a in ALIASES[c] if a in header), None)
        if name is None and c in required:
            raise ValueError(f"Could not locate required {c} column. Header: {df.columns}")
        out.append(F.lit(None).alias(c) if name is None else F.col(f"`{name}`").alias(c))
    return df.select(*out)


def with_box(df: DataFrame) -> DataFrame:
    """Adds centre, width, height and area of the boxes x1, y1, x2, y2."""
    df = df.withColumns({"center_x": (F.col("x1") + F.col("x2")) / 2, "center_y": (F.col("y1") + F.col("y2")) / 2, "width": F.col("x2") - F.col("x1"), "height": F.col("y2") - F.col("y1")})
    return df.withColumn("area", F.col("width") * F.col("height"))


def with_height(df: DataFrame) -> DataFrame:
    """The column height; without one, that of the box."""
    return df if "height" in df.columns else df.withColumn("height", F.col("y2") - F.col("y1"))


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Of the rows of equal keys the first by order: the best, if the order says so, or the earliest. A window, so a key's rows meet in a task."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def keep_by_precedence(df: DataFrame, keys: list[str], column: str, precedence: list[str], *order: Column | str) -> DataFrame:
    """Of the rows of equal keys the one whose value comes first in precedence (others last), then the first by order."""
    place = F.array_position(F.array(*map(F.lit, precedence)), F.col(column))
    return keep_first(df, keys, F.when(place > 0, place).otherwise(len(precedence) + 1), *order)


def declared(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The declared columns (name: type) in their order, absent ones null, then all others in theirs."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*(F.col(f"`{have[c.lower()]}`").cast(t).alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()), *(F.col(f"`{v}`") for k, v in have.items() if k not in {c.lower() for c in columns}))


def convert_if_any(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles if any of their values is a number; others stay as they are. One aggregate tells which."""
    number = lambda c: F.col(c).try_cast("double")
    some = df.agg(*(F.count(number(c)).alias(c) for c in columns)).first()
    return df.withColumns({c: number(c) for c in columns if some[c]})


def nearest_row(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
    """left (clip_id, frame) with columns of the row of right whose frame is nearest, however far; the earlier at equal distance. Both in one order by frame, so it is a window and no join; what follows is found by the opposite order, since a frame that ends with the clip is built again for each row. Frames of right are unique in a clip."""
    side = F.struct("frame", *columns)
    a = left.select("*", F.lit(None).cast(right.select(side.alias("x")).schema["x"].dataType).alias("_row"), F.lit(1).alias("_mine"))
    b = right.select("clip_id", "frame", side.alias("_row"), F.lit(0).alias("_mine"))
    upward, downward = (Window.partitionBy("clip_id").orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (("frame", "_mine"), (F.desc("frame"), F.desc("_mine"))))
    df = a.unionByName(b, allowMissingColumns=True)
    df = df.withColumn("_before", F.last("_row", True).over(upward)).withColumn("_after", F.last("_row", True).over(downward)).where("_mine = 1")
    early = F.col("_after").isNull() | (F.col("frame") - F.col("_before.frame") <= F.col("_after.frame") - F.col("frame"))
    near = F.when(F.col("_before").isNotNull() & early, F.col("_before")).otherwise(F.col("_after"))
    return df.withColumn("_near", near).select(*left.columns, F.col("_near.frame").alias("nearest_frame"), *(F.col(f"_near.{c}").alias(f"nearest_{c}") for c in columns))


def distribution(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Count, distinct values, mean, deviation and quartiles of each column by keys, a row a column."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.count_distinct(c).alias("distinct"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), *(F.percentile(c, q).alias(k) for k, q in (("min", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("max", 1.0))))
    return df.groupBy(*keys).agg(*(one(c).alias(f"_{c}") for c in columns)).select(*keys, F.explode(F.array(*(F.col(f"_{c}") for c in columns))).alias("x")).select(*keys, "x.*")


def quantiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[Column, float]], accuracy: int = 10_000) -> DataFrame:
    """(keys, names of wanted) exact quantiles of each (column, share) by keys, linear between neighbours as SQL's quantile_cont: low + (high - low) * part. Null without values.

    A sketch tells two values of the group that the quantile lies between; only the
    values between them, a few in ten thousand, are counted each and ordered, those
    below are one count. So no task holds a group. Groups of less than 10 * accuracy
    values are ordered whole. Groups are broadcast; keys must not be null. df is read twice.
    """
    margin, names = 3 / accuracy, list(wanted)
    v = [c.cast("double") for c, _ in wanted.values()]
    near = lambda i, q: F.percentile_approx(v[i], [max(0.0, q - margin), min(1.0, q + margin)], accuracy)
    sketch = df.groupBy(*keys).agg(*(F.count(c).alias(f"_n{i}") for i, c in enumerate(v)), *(near(i, q).alias(f"_b{i}") for i, (_, q) in enumerate(wanted.values())))
    one = lambda i, q: F.struct(F.lit(i).alias("i"), F.col(f"_n{i}").alias("n"), F.lit(q).alias("q"), F.when(F.col(f"_n{i}") >= 10 * accuracy, F.col(f"_b{i}")).alias("b"))
    each = sketch.select(*keys, F.array(*(one(i, q) for i, (_, q) in enumerate(wanted.values()))).alias("_g"))
    low, high = F.col("_x.g.b")[0], F.col("_x.g.b")[1]
    rows = df.select(*keys, F.array(*v).alias("_v")).join(F.broadcast(each), keys).select(*keys, F.explode(F.arrays_zip(F.col("_v").alias("v"), F.col("_g").alias("g"))).alias("_x"))
    rows = rows.where(F.col("_x.v").isNotNull() & (high.isNull() | (F.col("_x.v") <= high)))
    counts = rows.groupBy(*keys, F.col("_x.g.i").alias("i"), F.when(low.isNull() | (F.col("_x.v") >= low), F.col("_x.v")).alias("w")).agg(F.count("*").alias("m"))
    counts = counts.join(F.broadcast(each.select(*keys, F.explode("_g").alias("_g")).select(*keys, "_g.i", "_g.n", "_g.q")), [*keys, "i"])
    at = (F.col("n") - 1) * F.col("q")
    upto = F.sum("m").over(Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("w")).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"_upto": upto, "_at": at, "_k": F.floor(at)})
    first = lambda k: F.min(F.when(F.col("_upto") > k, F.struct(F.col("w").isNotNull().alias("known"), "w")))
    found = counts.groupBy(*keys, "i").agg(first(F.col("_k")).alias("_low"), first(F.least(F.col("_k") + 1, F.col("n") - 1)).alias("_high"), F.max(F.col("_at") - F.col("_k")).alias("_part"))
    inside = F.col("_low.known") & F.col("_high").isNotNull()
    value = F.when(~F.coalesce(inside, F.lit(False)), F.raise_error(F.lit("the sketch missed a quantile")).cast("double")).otherwise(F.col("_low.w") + F.when(F.col("_part") > 0, (F.col("_high.w") - F.col("_low.w")) * F.col("_part")).otherwise(0.0))
    wide = found.select(*keys, "i", value.alias("_q")).groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)))
    return sketch.select(*keys).join(F.broadcast(wide), keys, "left")


def robust_scaled(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns less their median, divided by 1.4826 times the median absolute deviation of their group; where that is 0 by the deviation, where that is 0 by 1."""
    mid = quantiles(df, keys, {f"_m_{c}": (F.col(c), 0.5) for c in columns}).join(F.broadcast(df.groupBy(*keys).agg(*(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))), keys)
    df = df.join(F.broadcast(mid), keys)
    mad = F.broadcast(quantiles(df, keys, {f"_d_{c}": (F.abs(F.col(c) - F.col(f"_m_{c}")), 0.5) for c in columns}))
    scale = lambda c: F.when(1.4826 * F.col(f"_d_{c}") >= 1e-6, 1.4826 * F.col(f"_d_{c}")).when(F.col(f"_s_{c}") >= 1e-6, F.col(f"_s_{c}")).otherwise(1.0)
    return df.join(mad, keys).withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / scale(c) for c in columns}).drop(*(f"_{k}_{c}" for k in "msd" for c in columns))


def inliers(df: DataFrame, keys: list[str], column: str, least: float, times: float, few: int = 4) -> DataFrame:
    """Adds inlier: the value lies within the group's median and the larger of `least` and `times` median absolute deviations above it; all of a group of fewer than `few`."""
    mid = quantiles(df, keys, {"_m": (F.col(column), 0.5)}).join(F.broadcast(df.groupBy(*keys).agg(F.count(column).alias("_n"))), keys)
    df = df.join(F.broadcast(mid), keys)
    mad = F.broadcast(quantiles(df, keys, {"_d": (F.abs(F.col(column) - F.col("_m")), 0.5)}))
    return df.join(mad, keys).withColumn("inlier", (F.col("_n") < few) | (F.col(column) <= F.col("_m") + F.greatest(F.lit(least), times * F.col("_d")))).drop("_m", "_n", "_d")


def renumbered(df: DataFrame, key: str = "track_id") -> DataFrame:
    """Adds label: the clip's keys numbered from 1 in order of their first frame, then by key."""
    first = df.groupBy("clip_id", key).agg(F.min("frame").alias("_f"))
    return df.join(first.withColumn("label", F.row_number().over(Window.partitionBy("clip_id").orderBy("_f", key)).cast("long")).drop("_f"), ["clip_id", key])


def duration_bucket(seconds: Column) -> Column:
    """short below five minutes, medium below thirty, else long; unknown_duration without a number."""
    return F.when(seconds < 300, "short").when(seconds < 1800, "medium").when(seconds.isNotNull(), "long").otherwise("unknown_duration")


def ranked(df: DataFrame, by: list[str], bucket: Column, order: list, name: str = "_rank") -> DataFrame:
    """df with each row's place (from 1) among the rows of equal `by`, in the order of `bucket` and then of `order`; bucket must not fall as order rises.

    Only a bucket's rows are sorted together; its places begin behind the counts of
    the buckets before it, of which there are few (some thousands at most). So no
    group of rows is ever in one task. The columns `by` must not be null.
    """
    b = df.withColumn("_bucket", bucket)
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = b.groupBy(*by, "_bucket").agg(F.count("*").alias("_n")).select(*by, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return b.withColumn("_inside", inside).join(sizes, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")
