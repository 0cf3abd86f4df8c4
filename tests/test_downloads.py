"""Download plans and seeded samples on small cases."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from touchline.operators import downloads


def test_values_as_paths(spark):
    rows = spark.createDataFrame([(' "A\\\\B//c/" ',), ("'x'",), (None,), ("/",), ("\t//Q\n",)], "v string")
    assert [r[0] for r in rows.select(downloads.normalised("v")).collect()] == ["a/b/c", "x", "", "", "q"]


def test_duplicates_by_any_key(spark):
    rows = [(1, "d/Clip_A.mp4", None), (2, None, "other/clip_b"), (3, "clip_c/", "clip_b"), (4, "n/m", ""), (5, None, None)]
    inv = spark.createDataFrame(rows, "row long, video_path string, slug string")
    local = spark.createDataFrame([("clip_a.MP4",), ("clip_b",), ("CLIP_C",), ("clip_c",)], "clip_id string")
    assert {r.row: r.matching_local_clip_id for r in downloads.local_duplicates(inv, local, "row").collect()} == {1: "clip_a.MP4", 2: "clip_b", 3: "clip_c"}


def test_plan(spark):
    """Two of group x/h1 and one of y/h2: by turns, the better score first inside a group."""
    rows = [(1, "x/h1_a.mkv", "no"), (2, "x/h1_b.mkv", "readable"), (3, "y/h2_c.mkv", "no"), (4, "have.mkv", "readable"), (5, None, "readable")]
    inv = spark.createDataFrame(rows, "row long, video_path string, readable string")
    local = spark.createDataFrame([("have.mkv",)], "clip_id string")
    got = {r.row: r for r in downloads.download_plan(inv, local, "row", 2).collect()}
    assert [got[i].download_recommendation for i in (1, 4, 5)] == ["candidate_for_new_download", "exclude_exact_duplicate", "manual_review_required"]
    assert {i: got[i].selection_rank for i in got} == {1: None, 2: 1, 3: 2, 4: None, 5: None}
    assert got[2].selection_reason == "readable_video;parent_group=x;duration_bucket=unknown_duration;half=h1"
    assert tuple(downloads.plan_summary(downloads.download_plan(inv, local, "row", 2), 2).first()) == (5, 1, 1, 2, 2)


def test_a_sample_is_the_same_in_every_partitioning_and_no_global_sort(spark):
    df = spark.range(1000)
    a = {r.id for r in downloads.seeded_sample(df.repartition(7), 50, "id").collect()}
    assert a == {r.id for r in downloads.seeded_sample(df.coalesce(1), 50, "id").collect()} and len(a) == 50
    assert a != {r.id for r in downloads.seeded_sample(df, 50, "id", seed=1).collect()}
    plan = downloads.seeded_sample(df, 50, "id")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_slugs_and_manifests(spark):
    v = spark.createDataFrame([("lg/2020-2021/a - b", 1, "p"), ("cup/x", 2, "q")], "game_id string, half int, video_path string")
    got = downloads.manifest_of(v, 1, "720p", "lg/").collect()
    assert [(r.clip_id, r.competition) for r in got] == [("lg__2020_2021__a___b__h1_720p", "lg")]
    with pytest.raises(PySparkException, match="found 1 local"):
        downloads.manifest_of(v, 2, "720p", "lg/").collect()
    assert v.select(downloads.clip_slug(F.col("game_id"), F.col("half"), "224p")).collect()[1][0] == "cup__x__h2_224p"
