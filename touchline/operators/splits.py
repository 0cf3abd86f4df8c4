"""Splits of clips: the best of all, and a fixed one with its checks."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import constraints

#: Most clips of an exhaustive split: subsets are numbered by the bits of a number.
MOST = 30


def split_sizes(n: int, share: float = 0.2) -> tuple[int, int, int]:
    """Clips of (train, val, test): val and test have round(share * n), one at least; halves round to even."""
    k = max(1, round(share * n))
    return n - 2 * k, k, k


def exhaustive_split(clips: DataFrame, required: list[str], train: int, val: int, test: int, order: str = "order") -> DataFrame:
    """(clip_id, split): of all ways to part the clips, the one with the most classes in train (all that are required), then in val, then in test, then with the least sums of the clips' places in `order`.

    clips: clip_id, classes (an array), and the column `order`, a seeded key; places
    are its ranks. Ties of sums go by the places of train's clips, then of val's, in
    order of clip_id. train + val + test must be the number of clips, MOST at most.
    An error if no way gives train all required classes.

    Every train set is a number of spark.range whose bits are the clips; what is
    left is parted by a table of all choices of `val` places among the rest. Class
    sets are bit masks, and the best way is the least struct of one aggregate.
    """
    spark = clips.sparkSession
    n = clips.count()
    if n != train + val + test or n > MOST:
        raise ValueError(f"Need {train} + {val} + {test} clips, {MOST} at most; found {n}.")
    names = F.array(*map(F.lit, sorted(required)))
    bits = F.aggregate(F.transform(F.filter(F.array_distinct("classes"), lambda c: F.array_contains(names, c)), lambda c: F.call_function("shiftleft", F.lit(1), F.array_position(names, c).cast("int") - 1)), F.lit(0), lambda a, b: a.bitwiseOR(b))
    # one row: the clips in order of their ids, each with its classes and its place in the seeded order
    ids = F.array_sort(F.collect_list(F.struct("clip_id", bits.alias("classes"), F.col(order).alias("key"))))
    one = clips.agg(ids.alias("clips"))
    keys = F.array_sort(F.transform("clips", lambda c: F.struct(c["key"], c["clip_id"])))
    one = one.select("clips", F.transform("clips", lambda c: c["classes"]).alias("classes"), F.transform("clips", lambda c: (F.array_position(keys, F.struct(c["key"], c["clip_id"])) - 1).cast("int")).alias("places"))

    full = (1 << len(required)) - 1
    has = lambda mask, i: F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1)) == 1
    either = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a.bitwiseOR(b))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, b: a + b)
    mine = lambda c, at: F.transform(at, lambda i: F.get(c, i))
    places = F.array(*(F.lit(i) for i in range(n)))
    sets = spark.range(1 << n).where(F.bit_count("id") == train)
    df = sets.join(F.broadcast(one)).withColumns({"train": F.filter(places, lambda i: has(F.col("id"), i)), "rest": F.filter(places, lambda i: ~has(F.col("id"), i))})
    df = df.withColumn("have", either(mine("classes", "train"))).where(F.col("have") == full)
    df = df.select("have", "train", F.transform("rest", lambda i: F.struct(i.alias("i"), F.get("classes", i).alias("c"), F.get("places", i).alias("p"))).alias("rest"), total(mine("places", "train")).alias("sum"), mine("places", "train").alias("train_places"))
    ways = spark.createDataFrame([(sum(1 << i for i in c),) for c in itertools.combinations(range(val + test), val)], "way long").coalesce(1)  # as many as val of val + test
    df = df.join(F.broadcast(ways))
    # unrolled over the few places that are left, so that it stays in generated code
    at = [F.get("rest", F.lit(i)) for i in range(val + test)]
    inside = [F.shiftright("way", i).bitwiseAND(F.lit(1)).cast("int") for i in range(val + test)]
    of_val, of_test, sum_val = F.lit(0), F.lit(0), F.lit(0)
    for x, y in zip(at, inside, strict=True):
        of_val, of_test, sum_val = of_val.bitwiseOR(x["c"] * y), of_test.bitwiseOR(x["c"] * (1 - y)), sum_val + x["p"] * y
    score = F.struct((-F.bit_count("have")).alias("a"), (-F.bit_count(of_val)).alias("b"), (-F.bit_count(of_test)).alias("c"), F.col("sum").alias("d"), sum_val.alias("e"))
    inner = F.filter("rest", lambda x, i: has(F.col("way"), i))
    best = df.withColumn("score", score).groupBy().agg(F.min(F.struct("score", "train_places", F.transform(inner, lambda x: x["p"]).alias("val_places"), "train", F.transform(inner, lambda x: x["i"]).alias("val"))).alias("best"))
    found = best.where(F.when(F.col("best").isNotNull(), True).otherwise(F.raise_error(F.lit("No valid split can provide all required training classes.")).cast("boolean")))
    split = lambda i: F.when(F.array_contains("best.train", i), "train").when(F.array_contains("best.val", i), "val").otherwise("test")
    parted = F.transform("clips", lambda c, i: F.struct(c["clip_id"].alias("clip_id"), split(i).alias("split")))
    return found.join(one).select(F.inline(parted))


def missing_classes(windows: DataFrame, split: DataFrame, required: list[str], label: str = "target_class") -> DataFrame:
    """(split, missing): the required classes that val or test have no window of; train lacking one is an error that names it."""
    have = windows.join(split, "clip_id").groupBy("split", F.col(label).alias("label")).agg(F.count("*").alias("n"))
    grid = windows.sparkSession.createDataFrame([(s, c) for s in ("train", "val", "test") for c in required], "split string, label string")
    lacks = grid.join(have, ["split", "label"], "left_anti")
    rows = lacks.where("split <> 'train'").groupBy("split").agg(F.array_join(F.array_sort(F.collect_list("label")), ", ").alias("missing"))
    return constraints.required(rows, lacks.where("split = 'train'"), "label", "Required class(es) absent from train split")


def fixed_split(rows: DataFrame, assignment: DataFrame) -> DataFrame:
    """rows with the split of their clip by assignment (clip_id, split). Errors name clips that are in more than one split, and clips of rows that no split has."""
    mapping = constraints.required(assignment, constraints.duplicates(assignment, "clip_id"), "name", "Clip appears in more than one split")
    return constraints.covered(rows, assignment, "clip_id", "Clip(s) in window index are not assigned to any split").join(mapping, "clip_id")


def split_summary(rows: DataFrame, splits: tuple[str, ...] = ("train", "validation", "test", "excluded"), label_id: str = "label_id") -> DataFrame:
    """Of each split, those without rows too: clips, windows, those of carries and of background."""
    g = rows.groupBy("split").agg(F.countDistinct("clip_id").alias("clips"), F.count("*").alias("total_windows"), F.count_if(F.col(label_id) == 1).alias("carry_windows"), F.count_if(F.col(label_id) == 0).alias("background_windows"))
    names = rows.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return names.join(g, "split", "left").na.fill(0)


def ways(n: int, train: int, val: int) -> int:
    """How many ways exhaustive_split looks at."""
    return math.comb(n, train) * math.comb(n - train, val)
