"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = re.compile(r"[^ \t-\r]+")
#: Words that a task remembers the hash of before it starts afresh.
REMEMBERED = 150_000


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


class WordHash(dict):
    """Word -> 64-bit hash that is the same on every machine; forgets all when too many are held."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        self[word] = h
        return h


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads nearby values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hashes(ws: list[str], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in order (repeats kept)."""
    if len(h) < n:
        return h[:0]
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the cluster's spark.checkpoint.dir; on a local master one of our own if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and lost executors cost nothing."""
    return written_at(df, fresh_dir(df.sparkSession, what))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def same_names(docs: DataFrame, **columns: Column | str) -> DataFrame:
    """docs' rows as a struct `_row` beside the columns that are named here: whatever names docs has, none clashes. `_row.*` gives docs back."""
    return docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), *((F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()))


def quoted(name: str) -> str:
    """A column's name as one word of a path, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, n: int):
    """crc32 of the id written as text, modulo n; of null: as of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def pieces(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours whose lengths sum to `most` or that are single."""
    at = total = 0
    for i, n in enumerate(lengths):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(lengths):
        yield at, len(lengths)


#: Shares that a node's edges are dealt into, so that a star's centre meets its edges in as many tasks; edges in a file.
SHARES, ROWS = 64, 250_000


def _least(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b): for each a and share of its edges the least b of all its edges. A node's edges never meet in one task, only one row for each share does."""
    part = pairs.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(SHARES)).alias("share")).agg(F.min("b").alias("m"))
    return part.select("a", "share").join(part.groupBy("a").agg(F.min("m").alias("m")), "a")


def _to_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (a, b) with m, the least of a."""
    return pairs.withColumn("share", F.pmod(F.xxhash64("b"), F.lit(SHARES))).join(least, ["a", "share"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): (node, root), root the least node.

    Alternates large-star and small-star rounds, each an aggregate and a join on
    keys that are dealt in shares; the edges shrink to a star per component in about
    log^2 rounds, whatever the graph. A round is written to the shared folder, and
    the one before deleted. Empty edges: empty result. Null ends and loops: left out.
    """
    spark, kind = edges.sparkSession, edges.schema["a"].dataType

    def saved(x: DataFrame, most: int) -> tuple[DataFrame, str]:
        """In as few files as `most` rows need; rounds only lose edges."""
        path = fresh_dir(spark, "edges")
        return written_at(x.coalesce(max(1, -(-most // ROWS))), path), path

    def shape(x: DataFrame) -> tuple:
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    ordered = lambda x: x.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, path = saved(ordered(edges.where("a is not null and b is not null and a <> b")), edges.count())
    last, now = None, shape(e)
    while now[0] and now != last:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_least(both, _least(both)).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()
        small = _to_least(large, _least(large)).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b")
        old = path
        e, path = saved(ordered(small), now[0])
        last, now = now, shape(e)
        delete(spark, old)
    stars = e.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").union(stars.select(F.col("root").cast(kind).alias("node"), "root").distinct())
