"""State machines over streams: files in shuffled batches, a restart in the middle, the same rows as the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import possession, tracking
from touchline.plans import event_queries
from touchline.sources import fixtures as fx
from touchline.streaming import state

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def timed(df):
    return df.withColumn("ts", F.timestamp_micros((F.col("frame") * 40_000 + 1_700_000_000_000_000).cast("long")))


def streamed(spark, tmp, df, start):
    """df in four files by time, rows of neighbouring files mixed and one file twice, read in two runs; then rows of another clip much later, so that the watermark passes all."""
    dice = random.Random(1)
    last = df.agg(F.max("frame")).first()[0]
    rows = [r for r in df.collect()]
    dice.shuffle(rows)
    files = [[] for _ in range(4)]
    for r in rows:
        k = r.frame * 4 // (last + 1)
        files[min(3, k + (dice.random() < 0.3 and k < 3))].append(r)
    def put(name, some):
        spark.createDataFrame(some, df.schema).coalesce(1).write.parquet(f"{tmp}/in/{name}")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).option("recursiveFileLookup", True).parquet(f"{tmp}/in")
        q = start(stream).writeStream.format("parquet").option("path", f"{tmp}/out").option("checkpointLocation", f"{tmp}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)

    put("a", files[0])
    put("b", files[1])
    put("c", files[1][: len(files[1]) // 2])
    run()
    put("d", files[2])
    put("e", files[3])
    for k, name in enumerate("fgh"):
        end = rows[0].asDict() | {"clip_id": -1, "frame": last + 100_000 * (k + 1), "ts": timed(spark.createDataFrame([(last + 100_000 * (k + 1),)], "frame long")).first().ts}
        put(name, [tuple(end[c] for c in df.columns)])
    run()
    return spark.read.parquet(f"{tmp}/out").where("clip_id >= 0")


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda rows: sorted((tuple((x is None, x if x is not None else 0) for x in (r[c] for c in columns)) for r in rows), key=str)
    got, want = key(got.collect()), key(want.collect())
    assert got == want and want


def test_possession(spark, tmp_path):
    ball, tracks, teams = (f(spark, SF) for f in (fx.ball, fx.tracks, fx.teams))
    near = possession.candidates(possession.nearest_player(ball, possession.eligible(tracks, teams)))
    c = timed(near.select("clip_id", "frame", "timestamp", "candidate_team", "reason", "near.track_id", "near.d", "ball_x", "ball_y", "is_interpolated"))
    same(streamed(spark, tmp_path, c, lambda s: state.possession_stream(s, late="3 seconds")), possession.estimate_possession(ball, tracks, teams))


def test_ball_links(spark, tmp_path):
    det = event_queries._detections(spark, SF)
    same(streamed(spark, tmp_path, timed(det), lambda s: state.link_stream(s, late="3 seconds", idle_ms=1000)), tracking.link_ball_tracks(det))


def test_centroids(spark, tmp_path):
    box = {"class_name": F.lit("person"), "x1": F.col("center_x") - 10, "x2": F.col("center_x") + 10, "y1": F.col("center_y") - 20, "y2": F.col("center_y") + 20}
    det = event_queries._detections(spark, SF).where("frame % 20 < 15").withColumns(box)
    same(streamed(spark, tmp_path, timed(det), lambda s: state.centroid_stream(s, late="3 seconds", idle_ms=2000)), tracking.centroid_track(det))


def test_possession_machine_against_a_plain_loop():
    dice = random.Random(3)
    for _ in range(200):
        need, teams = dice.randint(1, 4), [dice.choice(["None", "A", "A", "A", "B", "B"]) for _ in range(40)]
        machine, s, got = state.PossessionMachine(need), None, []
        s = machine.begin()
        for f, t in enumerate(teams):
            s, out = machine.step(s, f, [{"candidate_team": t, "reason": "r", "track_id": 1, "d": 0.0}])
            got.append(out[0]["team"])
        want, now = [], "None"
        for f, t in enumerate(teams):
            if t == "None":
                now = "None"
            elif f + 1 >= need and teams[f + 1 - need : f + 1] == [t] * need:
                now = t
            want.append(now)
        assert got == want
