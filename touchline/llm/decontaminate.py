"""Benchmark decontamination.

The test items are the documents of a BM25 inverted index, every passage of every
text is a query. Impacts are divided by the item's score for its own words, so
one threshold holds for items of any length. Items lie in small blocks of likely
neighbours; the block maxima rule out nearly all blocks of a passage, the
others are searched by WAND. What is found counts if both the question and the
answer overlap with the passage.

The index is cut into shards of bounded size, by the items' length and a hash.
Tasks build them and write them to the shared folder; a task that searches texts
holds a few shards at a time and reads the others again for each batch of texts.
The corpus is read once, however many items there are, and no index passes the
driver.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from bisect import bisect_left
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fresh_dir, pieces, same_names, written
from .token_files import read_all, write_file

TERM = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.?!])\s+|\n+")
K1, B = 1.2, 0.75
#: Items in a block, and in a shard at most (but for chance: they are dealt by a hash); shards that a worker holds; least half of a passage, in words.
BLOCK, SHARD, HELD, HALF = 4, 1024, 4, 64
#: Least share of an item's own score; least share of a part's words in shared runs of RUN words.
SCORE, OVERLAP, RUN = 0.6, 0.6, 3


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer of an item: its last sentence is the answer; of a single sentence, the second half."""
    s = [x for x in map(terms, SENTENCE.split(text)) if x]
    if len(s) > 1:
        return [w for x in s[:-1] for w in x], s[-1]
    w = s[0] if s else []
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def overlap(part: list[str], runs: dict[int, set]) -> float:
    """Share of the part's words inside runs of RUN words (all of a shorter part) that the passage has. Nothing: 1."""
    n = min(RUN, len(part))
    if not n:
        return 1.0
    hit = np.zeros(len(part), bool)
    for i in range(len(part) - n + 1):
        if tuple(part[i : i + n]) in runs[n]:
            hit[i : i + n] = True
    return float(hit.mean())


class Shard:
    """Postings of some items (id, words, question, answer) of `half` words at most, with the weights of all items' words."""

    def __init__(self, items: list[tuple], weight: dict[str, float], mean: float, half: int):
        common = lambda x: tuple(sorted(set(x), key=lambda w: (weight[w], w))[:6])
        items = sorted(items, key=lambda x: (common(x[1]), len(x[1])))
        self.half = half
        self.ids = [x[0] for x in items]
        self.parts = [x[2:] for x in items]
        self.term = {w: i for i, w in enumerate(sorted({w for x in items for w in x[1]}))}
        self.best = np.zeros((len(self.term), -(-len(items) // BLOCK)), np.float32)
        self.postings: list[dict[int, list[tuple[int, float]]]] = [{} for _ in self.term]
        for k, (_, ws, *_) in enumerate(items):
            own = {w: weight[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(ws) / mean)) for w, n in Counter(ws).items()}
            total = sum(own.values())
            for w, v in own.items():
                t = self.term[w]
                self.postings[t].setdefault(k // BLOCK, []).append((k, v / total))
                self.best[t, k // BLOCK] = max(self.best[t, k // BLOCK], v / total)

    def wand(self, ts: list[int], block: int) -> list[tuple[int, float]]:
        """Items of a block that score SCORE or more for the terms: cursors move to the first item whose terms' maxima could reach it."""
        lists = [p for t in ts if (p := self.postings[t].get(block))]
        cursors = [[p[0][0], float(max(v for _, v in p)), p, 0] for p in lists]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[1]
                if bound >= SCORE - 1e-6:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(c[2][c[3]][1] for c in cursors if c[0] == pivot)
                if score >= SCORE - 1e-6:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                if c[0] < target:
                    c[3] = bisect_left(c[2], (target,), c[3])
                    c[0] = c[2][c[3]][0] if c[3] < len(c[2]) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def search(self, texts: list[list[str]]) -> list[list[tuple]]:
        """For each text's terms: (item's id, score, question's and answer's overlap) of every item found, the best passage of each."""
        half, found = self.half, [{} for _ in texts]
        n = np.array([len(t) for t in texts])
        get = self.term.get
        t = np.array([get(w, -1) for ws in texts for w in ws], np.int64)
        doc = np.repeat(np.arange(len(texts)), n)
        start = np.concatenate([[0], np.cumsum(n)])
        place = np.arange(len(t)) - start[doc]
        at = np.flatnonzero(t >= 0)
        t, doc, place = t[at], doc[at], place[at]
        if not len(t):
            return [[] for _ in texts]
        order = np.lexsort((place, t, doc))
        before = np.full(len(t), -1)
        same = (t[order][1:] == t[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        before[order[1:][same]] = place[order[:-1][same]]
        # A passage is two halves; a term counts once in each passage.
        k = place // half
        first = np.concatenate([[0], np.cumsum(-(-n // half))])
        a, b = before < k * half, (k > 0) & (before < (k - 1) * half)
        window = np.concatenate([(first[doc] + k)[a], (first[doc] + k - 1)[b]])
        term = np.concatenate([t[a], t[b]])
        order = np.argsort(window, kind="stable")
        window, term = window[order], term[order]
        edges = np.flatnonzero(np.diff(window, prepend=-1))
        bound = np.add.reduceat(self.best[term], edges)
        ends = np.append(edges[1:], len(term))
        runs_of: dict[int, dict] = {}
        for w, block in zip(*np.nonzero(bound >= SCORE - 1e-4), strict=True):
            ts = term[edges[w] : ends[w]].tolist()
            for item, score in self.wand(ts, int(block)):
                g = int(window[edges[w]])
                d = int(np.searchsorted(first, g, side="right")) - 1
                if g not in runs_of:
                    s = (g - int(first[d])) * half
                    ws = texts[d][s : s + 2 * half]
                    runs_of[g] = {r: set(zip(*(ws[i:] for i in range(r)))) for r in range(1, RUN + 1)}
                question, answer = (overlap(p, runs_of[g]) for p in self.parts[item])
                if question >= OVERLAP and answer >= OVERLAP and (item not in found[d] or found[d][item][0] < score):
                    found[d][item] = (float(score), question, answer)
        return [[(self.ids[i], *v) for i, v in sorted(x.items())] for x in found]


def _split(frames):
    for pdf in frames:
        rows = [(i, *parts(t or "")) for i, t in zip(pdf["item_id"], pdf["text"], strict=True)]
        yield pd.DataFrame([r for r in rows if r[1] or r[2]], columns=["item_id", "question", "answer"])


def index(items: DataFrame) -> list[str]:
    """Builds the shards of items (item_id, text) and returns their files. Items without words are left out; null or repeated ids are kept. No items: no files.

    Items of a length class (64 words, 128, and so on) share passages of twice
    that length, so that one long item doesn't lengthen all others' passages.
    """
    spark = items.sparkSession
    cut = written(items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInPandas(_split, "item_id string, question array<string>, answer array<string>").withColumn("row", F.monotonically_increasing_id()), "items")
    own = cut.withColumn("w", F.concat("question", "answer")).withColumn("tier", F.ceil(F.log2(F.greatest(F.size("w"), F.lit(HALF)) / HALF)).cast("int"))
    tiers = own.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.size("w")).alias("words")).collect()  # a row for each doubling of the length
    if not tiers:
        return []
    n = sum(r["n"] for r in tiers)
    mean = sum(r["words"] for r in tiers) / n
    each = own.select("row", F.explode(F.array_distinct("w")).alias("t"))
    weight = F.log1p((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = each.join(each.groupBy("t").agg(F.count("*").alias("df")), "t").groupBy("row").agg(F.collect_list("t").alias("t"), F.collect_list(weight).alias("weight"))
    of = F.element_at(F.create_map(*(F.lit(x) for r in tiers for x in (r["tier"], 1 if r["n"] <= SHARD else -(-2 * r["n"] // SHARD)))), F.col("tier"))
    dealt = own.join(weights, "row").withColumn("shard", F.pmod(F.xxhash64("row"), of))
    out = fresh_dir(spark, "index")

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        known = {t: v for ts, vs in zip(pdf["t"], pdf["weight"], strict=True) for t, v in zip(ts, vs, strict=True)}
        rows = [(i, list(w), list(q), list(a)) for i, w, q, a in zip(pdf["item_id"], pdf["w"], pdf["question"], pdf["answer"], strict=True)]
        file = f"{out}/shard-{uuid.uuid4().hex}"
        write_file(file, pickle.dumps(Shard(rows, known, mean, HALF << int(key[0]))))
        return pd.DataFrame({"file": [file]})

    manifest = written(dealt.groupBy("tier", "shard").applyInPandas(build, "file string"), "index-manifest")
    return sorted(r["file"] for r in manifest.collect())


_SHARDS: OrderedDict[str, Shard] = OrderedDict()


def shard(file: str) -> Shard:
    """A shard, one of the last HELD that the worker used or read again."""
    if file not in _SHARDS:
        while len(_SHARDS) >= HELD:
            _SHARDS.popitem(last=False)
        _SHARDS[file] = pickle.loads(read_all(file))
    _SHARDS.move_to_end(file)
    return _SHARDS[file]


FOUND = "array<struct<item_id:string, score:double, question_overlap:double, answer_overlap:double>>"


def searched(text: Column, files: list[str]) -> Column:
    """What the index has of each text, as FOUND; null or empty text: nothing."""
    names = ["item_id", "score", "question_overlap", "answer_overlap"]

    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = [terms(t) for t in batch]
            out: list = [[] for _ in texts]
            for file in files:
                s = shard(file)
                for a, b in pieces([len(t) for t in texts], 60_000):
                    for k, found in enumerate(s.search(texts[a:b]), a):
                        out[k] += [dict(zip(names, x, strict=True)) for x in found]
            yield pd.Series(out, dtype=object)

    return search.asNondeterministic()(text.cast("string"))


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text) and item whose question and answer one of its passages holds: doc_id, item_id, score, question_overlap, answer_overlap.

    Null or empty text, and items without words: no rows. Repeated rows repeat. No items: no rows.
    """
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), searched(F.col("text"), index(items)).alias("x")).select("doc_id", F.explode("x").alias("x"))
    return found.select("doc_id", F.col("x.item_id").cast(items.schema["item_id"].dataType).alias("item_id"), "x.score", "x.question_overlap", "x.answer_overlap")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, whatever their names, that hold no item. Null or empty text holds none; repeated rows repeat; no items: all rows."""
    return same_names(docs, leaks=searched(F.col("text"), index(items))).where(F.size("leaks") == 0).select("_row.*")
