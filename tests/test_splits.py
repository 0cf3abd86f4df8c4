"""Splits, constraints and sums over windows on small cases."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.operators import constraints, reports, splits


def best(clips, required, train, val):
    place = {c: i for i, c in enumerate(sorted(clips, key=lambda c: (clips[c][1], c)))}
    ids = sorted(clips)
    found = []
    of = lambda cs: set().union(*(clips[c][0] & required for c in cs))
    for t in itertools.combinations(ids, train):
        if of(t) >= required:
            rest = [c for c in ids if c not in t]
            for v in itertools.combinations(rest, val):
                e = [c for c in rest if c not in v]
                score = (-len(of(t)), -len(of(v)), -len(of(e)), sum(place[c] for c in t), sum(place[c] for c in v), [place[c] for c in t], [place[c] for c in v])
                found.append((score, {**dict.fromkeys(t, "train"), **dict.fromkeys(v, "val"), **dict.fromkeys(e, "test")}))
    return min(found, key=lambda x: x[0])[1]


@pytest.mark.parametrize("n,train,val", [(5, 3, 1), (9, 5, 2), (12, 7, 2)])
def test_the_best_split(spark, n, train, val):
    dice = random.Random(n)
    required = {"a", "b", "c"}
    clips = {f"clip{i:02d}": ({c for c in "abcx" if dice.random() < 0.4} | ({"a", "b", "c"} if i == 1 else set()), dice.randint(0, 5)) for i in range(n)}
    df = spark.createDataFrame([(c, sorted(k), o) for c, (k, o) in clips.items()], "clip_id string, classes array<string>, order int")
    got = {r.clip_id: r.split for r in splits.exhaustive_split(df, sorted(required), train, val, n - train - val).collect()}
    assert got == best(clips, required, train, val)


def test_no_split_will_do(spark):
    df = spark.createDataFrame([(i, ["a"], i) for i in range(4)], "clip_id long, classes array<string>, order int")
    with pytest.raises(PySparkException, match="No valid split"):
        splits.exhaustive_split(df, ["a", "b"], 2, 1, 1).collect()
    with pytest.raises(ValueError, match="found 4"):
        splits.exhaustive_split(df, ["a"], 5, 1, 1)
    assert [splits.split_sizes(n) for n in (3, 5, 8, 25)] == [(1, 1, 1), (3, 1, 1), (4, 2, 2), (15, 5, 5)]


def test_constraints_name_what_breaks_them(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4), ("c", 5)], "clip_id string, x int")
    with pytest.raises(PySparkException, match="Duplicate clip: b, c"):
        constraints.unique(rows, "clip_id", says="Duplicate clip").agg(F.count("*")).collect()  # survives pruning
    assert constraints.unique(rows.where("x in (1, 2)"), "clip_id").count() == 2
    many = spark.range(60).select(F.explode(F.array(F.col("id"), F.col("id"))).alias("id"))
    with pytest.raises(PySparkException, match="and 40 more"):
        constraints.unique(many, "id").collect()
    with pytest.raises(PySparkException, match="not found: z"):
        constraints.lookup(rows, "clip_id", "z").collect()
    with pytest.raises(PySparkException, match="Duplicate Clip ID: b"):
        constraints.lookup(rows, "clip_id", "b").collect()
    assert constraints.lookup(rows, "clip_id", "a").collect() == [("a", 1)]


def test_fixed_split_checks_its_table(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "clip_id string, label_id int")
    table = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "test")], "clip_id string, split string")
    assert {tuple(r) for r in splits.split_summary(splits.fixed_split(rows, table)).collect()} == {("train", 1, 1, 1, 0), ("test", 2, 2, 0, 2), ("validation", 0, 0, 0, 0), ("excluded", 0, 0, 0, 0)}
    with pytest.raises(PySparkException, match="not assigned to any split: b, c"):
        splits.fixed_split(rows, table.where("clip_id = 'a'")).collect()
    with pytest.raises(PySparkException, match="more than one split: a"):
        splits.fixed_split(rows, table.union(table.limit(1))).collect()
    windows = spark.createDataFrame([("a", "pass"), ("b", "shot")], "clip_id string, target_class string")
    assert {tuple(r) for r in splits.missing_classes(windows, table, ["pass"]).collect()} == {("val", "pass"), ("test", "pass")}
    with pytest.raises(PySparkException, match="train split: goal, shot"):
        splits.missing_classes(windows, table, ["pass", "shot", "goal"]).collect()


def test_moments_over_windows(spark):
    frames = spark.createDataFrame([(1, f, float(f) if f != 3 else None, None) for f in range(6)] + [(2, 0, 9.0, None)], "clip_id long, frame long, x double, y double")
    windows = spark.createDataFrame([(1, 0, 3), (1, 2, 4), (1, 4, 4), (1, 5, 2), (3, 0, 9)], "clip_id long, start_frame long, end_frame long")
    assert {r.frame: r.cover for r in reports.window_cover(frames, windows).where("clip_id = 1").collect()} == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2, 5: 0}
    got = {r.feature: r for r in reports.window_moments(frames, windows, ["x", "y"]).collect()}
    values = [0, 1, 2, 2, 4, 4]
    mean = sum(values) / 6
    assert got["x"].n == 6 and got["x"].mean == pytest.approx(mean) and got["x"].std == pytest.approx((sum((v - mean) ** 2 for v in values) / 5) ** 0.5)
    assert tuple(got["y"]) == ("y", 0, 0.0, 1.0)
