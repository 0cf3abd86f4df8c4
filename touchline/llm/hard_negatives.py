"""Hard negatives by ball trees: the most similar rows of other labels whose score lies in a window below a positive's.

Rows are dealt into shards of a few thousand and anchors into blocks; a task takes
one shard and one block. It builds the shard's ball tree and sends the whole block
through it. A ball (centre c, radius r) bounds the inner product with a query q
from both sides, q.c - |q| r and q.c + |q| r: a node goes if it lies above every
window, or strictly beneath the window's bottom or the k-th best of the shard so
far. Bounds only skip work: the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import written

#: Rows of a shard, anchors of a block, rows of a leaf, anchors that meet a leaf at once.
SHARD, BLOCK, LEAF, AT_ONCE = 2048, 16_384, 64, 2048
INT = np.iinfo(np.int32)


class BallTree:
    """Nodes in breadth-first order; a node's rows are neighbours in `order`, halved along the widest of its axes."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.first, self.last, self.left = [0], [len(x)], []
        centres, radii = [], []
        at = 0
        while at < len(self.first):
            a, b = self.first[at], self.last[at]
            rows = x[self.order[a:b]]
            centre = rows.mean(0) if b > a else np.zeros(x.shape[1])
            centres.append(centre)
            radii.append(np.sqrt(((rows - centre) ** 2).sum(1).max()) if b > a else 0.0)
            if b - a > LEAF and radii[-1] > 0:
                axis = rows.var(0).argmax()
                half = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, axis], half)]
                self.left.append(len(self.first))
                self.first += [a, a + half]
                self.last += [a + half, b]
            else:
                self.left.append(-1)
            at += 1
        self.centres, self.radii = np.array(centres), np.array(radii)


class Best:
    """The k best (score, id) of each query in each of its windows: higher scores first, ties by smaller id."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((*low.shape, k), -np.inf)
        self.id = np.full((*low.shape, k), np.iinfo(np.int64).max)

    def floor(self, q: np.ndarray) -> np.ndarray:
        """Least score that still counts, by window."""
        return np.maximum(self.low[q], self.score[q, :, -1])

    def offer(self, q: np.ndarray, scores: np.ndarray, ids: np.ndarray, fits: np.ndarray) -> None:
        """scores and fits: queries q by rows of ids."""
        floor = self.floor(q)
        for w in range(self.low.shape[1]):
            i, j = np.nonzero(fits & (scores >= floor[:, w, None]) & (scores <= self.high[q, w, None]))
            if not len(i):
                continue
            met = np.unique(i)
            held = np.repeat(met, self.k)
            who = np.concatenate([held, i])
            score = np.concatenate([self.score[q[met], w].ravel(), scores[i, j]])
            name = np.concatenate([self.id[q[met], w].ravel(), ids[j]])
            by = np.lexsort((name, -score, who))
            who, score, name = who[by], score[by], name[by]
            top = np.searchsorted(who, met)[:, None] + np.arange(self.k)
            self.score[q[met], w], self.id[q[met], w] = score[top], name[top]


def search(x: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, queries: np.ndarray, own: np.ndarray, own_label: np.ndarray, best: Best, same: bool) -> None:
    """Offers best the rows x that it may need. same: only other rows of a query's label; else only rows of other labels. own and rows name the rows themselves, so that a query doesn't meet itself."""
    if not len(x) or not len(queries):
        return
    tree, norm = BallTree(x), np.sqrt((queries**2).sum(1))

    def leaf(node: int, q: np.ndarray) -> None:
        at = tree.order[tree.first[node] : tree.last[node]]
        for c in range(0, len(q), AT_ONCE):
            p = q[c : c + AT_ONCE]
            alike = own_label[p][:, None] == labels[at]
            fits = alike & (own[p][:, None] != rows[at]) if same else ~alike
            best.offer(p, queries[p] @ x[at].T, ids[at], fits)

    # first every query goes down to the leaf that its inner product prefers, so that k-th scores are good before anything is pruned
    node, seen = np.zeros(len(queries), np.int64), np.empty(len(queries), np.int64)
    left = np.array(tree.left)
    while (inner := left[node] >= 0).any():
        q = np.flatnonzero(inner)
        a = left[node[q]]
        prefers = (queries[q] * (tree.centres[a] - tree.centres[a + 1])).sum(1) >= 0
        node[q] = np.where(prefers, a, a + 1)
    seen[:] = node
    for n in np.unique(seen):
        leaf(n, np.flatnonzero(seen == n))

    todo = [(0, np.arange(len(queries)))]
    while todo:
        n, q = todo.pop()
        middle, reach = queries[q] @ tree.centres[n], norm[q] * tree.radii[n]
        slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
        most, least = middle + reach + slack, middle - reach - slack
        q = q[((most[:, None] >= best.floor(q)) & (least[:, None] <= best.high[q])).any(1)]
        if not len(q):
            continue
        if tree.left[n] >= 0:
            todo += [(tree.left[n] + 1, q), (tree.left[n], q)]
        else:
            leaf(n, q[seen[q] != n])


def _rows(scale: float):
    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for i, label, v, anchor in zip(pdf["id"], pdf["label"], pdf["vector"], pdf["anchor"], strict=True):
                x = np.asarray(v, float)
                if np.isfinite(x).all():
                    out.append((i, label, bool(anchor), np.clip(np.floor(scale * x), INT.min, INT.max).astype("<i4").tobytes()))
            yield pd.DataFrame(out, columns=["id", "label", "anchor", "vector"])

    return clean


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v.ljust(4 * width, b"\0") for v in vectors), "<i4").reshape(len(vectors), width).astype(float)


def _met(width: int, k: int, same: bool):
    def f(anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if anchors.empty or rows.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("row", "w", "score", "id")})
        if same:
            low = np.full((len(anchors), 1), -np.inf)
            best = Best(low, -low, k)
        else:
            most = max(map(len, anchors["low"]), default=0)
            fill = lambda c, empty: np.array([[*v, *[empty] * (most - len(v))] for v in anchors[c]], float).reshape(len(anchors), most)
            best = Best(fill("low", np.inf), fill("high", -np.inf), k)
        search(_matrix(rows["a_vector"], width), *(rows[c].to_numpy(np.int64) for c in ("a_id", "a_row", "a_label")), _matrix(anchors["vector"], width), anchors["row"].to_numpy(np.int64), anchors["label"].to_numpy(np.int64), best, same)
        a, w, at = np.nonzero(best.score > -np.inf)
        limit = float(2**63 - 1024)
        return pd.DataFrame({"row": anchors["row"].to_numpy(np.int64)[a], "w": w, "score": np.clip(best.score[a, w, at], -limit, limit).astype(np.int64), "id": best.id[a, w, at]})

    return f


def hard_negatives(vectors: DataFrame, anchor: Column | str, id: Column | str = "vec_id", label: Column | str = "label", vector: Column | str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """For each row where `anchor` holds and each of its `positives` best other rows of its label: the `negatives` best rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score,
    negative_score. A score is the inner product of components floor(scale * x);
    higher ones come first, ties by smaller id. Rows with a null id, label or
    vector, or with a null or non-finite component, take no part; a null anchor
    flag counts as false. Components beyond 32 bits count as the nearest number of
    32 bits, scores beyond 2^53 are rounded. Of vectors of several lengths, the
    shorter count as filled up with zeros. Repeated rows each stand for themselves:
    an equal row is an anchor's positive, a repeated anchor gives its rows again.
    A pair without such negatives, and no rows: nothing.

    Every anchor meets every row of the labels in question, by blocks: the time
    grows with anchors x rows, less what the trees prune. A shard is copied once
    for each block of 16,384 anchors, an anchor once for each shard of its label.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    raw = vectors.select(col(id).cast("long").alias("id"), col(label).cast("long").alias("label"), F.coalesce(col(anchor), F.lit(False)).alias("anchor"), col(vector).cast("array<double>").alias("vector")).where("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)")
    rows = written(raw.mapInPandas(_rows(scale), "id long, label long, anchor boolean, vector binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, anchors, width = rows.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.octet_length("vector")) / 4, F.lit(0)).cast("int")).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-anchors // BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda df, k: F.pmod(F.xxhash64(df["row"]), F.lit(k)).cast("int")
    found = "row long, w int, score long, id long"

    mine = rows.where("anchor")
    asks = mine.select("row", "label", "vector", dealt(mine, blocks).alias("block"), every(shards).alias("shard"))
    # names of their own: both sides come from one table
    answers = rows.select(F.col("row").alias("a_row"), F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("vector").alias("a_vector"), dealt(rows, shards).alias("a_shard"), every(blocks).alias("a_block"))
    near = asks.groupBy("label", "shard", "block").cogroup(answers.groupBy("a_label", "a_shard", "a_block")).applyInPandas(_met(width, positives, True), found)
    order = [F.desc("score"), "id"]
    top = near.withColumn("w", F.row_number().over(Window.partitionBy("row").orderBy(*order))).where(F.col("w") <= positives)
    pairs = written(top.select("row", (F.col("w") - 1).alias("w"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")

    # low * p <= 100 * n <= high * p for whole n: from the ceiling of low * p / 100 to the floor of high * p / 100
    p = F.col("positive_score").cast("decimal(38,0)")
    windows = pairs.withColumns({"low": F.ceil(p * low / 100).cast("double"), "high": F.floor(p * high / 100).cast("double")}).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("w", "low", "high"))).alias("x"))
    asks = mine.join(windows, "row").select("row", "label", "vector", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    asks = asks.select("*", dealt(asks, blocks).alias("block"), every(shards).alias("shard"))
    far = asks.groupBy("shard", "block").cogroup(answers.groupBy("a_shard", "a_block")).applyInPandas(_met(width, negatives, False), found)
    top = far.withColumn("rank", F.row_number().over(Window.partitionBy("row", "w").orderBy(*order))).where(F.col("rank") <= negatives)
    return top.join(pairs, ["row", "w"]).join(mine.select("row", F.col("id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
