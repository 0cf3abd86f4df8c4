"""Document quality by a linear-chain conditional random field over lines.

Each line is good or bad, judged by its own and its neighbours' features; the
marginals of the forward-backward recursion, weighted by the lines' lengths,
make the document's score. A labelled document labels its lines.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Measures of a line; with the two neighbours' and a constant they make its features.
MEASURES = 12
FEATURES = 3 * MEASURES + 1
SYMBOLS = "#*$%&|<>"


def _kinds() -> np.ndarray:
    """Bits by code point below 0x3000: 1 letter, 2 upper case, 4 digit, 8 symbol, 16 other mark, 32 white space, 64 vowel, 128 '!'."""
    out = np.zeros(0x3000, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        out[i] = c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() + 8 * (c in SYMBOLS) + 16 * (not c.isalnum() and not c.isspace() and c not in SYMBOLS) + 32 * c.isspace() + 128 * (c == "!")
    return out


KINDS = _kinds()


def lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Measures (lines x MEASURES) and lengths (code points, and one for the end) of all lines."""
    text = text or ""
    parts = text.split("\n")
    size = np.array([len(p) + 1 for p in parts], np.float64)
    code = np.frombuffer((text + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    kind = KINDS[np.minimum(code, 0x2FFF)]
    at = np.concatenate([[0], np.cumsum(size[:-1]).astype(np.int64)])
    share = [np.add.reduceat((kind & b) > 0, at, dtype=np.float64) / size for b in (1, 2, 4, 8, 16, 128)]
    seen: dict[str, int] = {}
    rows = []
    for p in parts:
        ws = p.split()
        n = len(ws)
        seen[p] = seen.get(p, 0) + 1
        rows.append((n, sum(map(str.__eq__, ws, ws[1:])) / n if n else 0.0, len(set(ws)) / n if n else 1.0, float(seen[p] > 1), float(p.rstrip().endswith((".", "!", "?", "…")))))
    r = np.array(rows, np.float64)
    return np.column_stack([*share, np.log1p(r[:, 0]) / 5, r[:, 1], r[:, 2], r[:, 3], r[:, 4], np.minimum(size / (r[:, 0] + 1), 40) / 10]), size


def features(m: np.ndarray) -> np.ndarray:
    """A line's measures, those of the line before and after (zeros beyond the ends), and a constant."""
    before, after = np.zeros_like(m), np.zeros_like(m)
    before[1:], after[:-1] = m[:-1], m[1:]
    return np.column_stack([m, before, after, np.ones(len(m))])


class CRF:
    """emit: weight of each feature for a good line; move: weights of neighbouring labels (bad 0, good 1)."""

    def __init__(self):
        self.emit, self.move = np.zeros(FEATURES), np.zeros((2, 2))

    def marginals(self, x: np.ndarray, starts: np.ndarray):
        """P(good) of each line of documents that lie one after the other in x, and the pairs' expected counts. starts: where each begins, and the end."""
        lengths = np.diff(starts)
        order = np.argsort(-lengths, kind="stable")
        lengths, first = lengths[order], starts[:-1][order]
        steps = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")
        z = np.clip(x @ self.emit, -30, 30)
        e = np.column_stack([np.exp(-z / 2), np.exp(z / 2)])
        w = np.exp(self.move)
        alpha = np.empty_like(e)
        for t in range(steps):
            i = first[: active[t]] + t
            a = e[i] if t == 0 else (alpha[i - 1] @ w) * e[i]
            alpha[i] = a / a.sum(1)[:, None]
        good, pairs = np.empty(len(e)), np.zeros((2, 2))
        beta = np.ones((len(lengths), 2))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            i = first[:n] + t
            g = alpha[i] * beta[:n]
            good[i] = g[:, 1] / g.sum(1)
            if t:
                v = e[i] * beta[:n]
                p = alpha[i - 1][:, :, None] * w * v[:, None, :]
                pairs += (p / p.sum((1, 2))[:, None, None]).sum(0)
                v = v @ w.T
                beta[:n] = v / v.sum(1)[:, None]
        return good, pairs

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-4) -> CRF:
        """Gradient ascent (Adam) on the likelihood of each line's label y."""
        pairs = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[starts[:-1]] = False
        at = np.flatnonzero(inner)
        np.add.at(pairs, (y[at - 1].astype(int), y[at].astype(int)), 1)
        m, v = np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)
        for k in range(1, rounds + 1):
            good, own = self.marginals(x, starts)
            g = np.concatenate([x.T @ (weight * (y - good)) / weight.sum(), (pairs - own).ravel() / len(y)]) - ridge * np.concatenate([self.emit, self.move.ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.emit += step[:FEATURES]
            self.move += step[FEATURES:].reshape(2, 2)
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The share of each text, by length, that lies in good lines."""
        got = [lines(t) for t in texts]
        starts = np.cumsum([0, *(len(s) for _, s in got)])
        if not len(got):
            return np.zeros(0)
        good, _ = self.marginals(np.concatenate([features(m) for m, _ in got]), starts)
        size = np.concatenate([s for _, s in got])
        return np.add.reduceat(good * size, starts[:-1]) / np.add.reduceat(size, starts[:-1])


def _sampled(frames):
    for pdf in frames:
        yield pd.DataFrame([(y, m.ravel().tolist(), s.tolist()) for t, y in zip(pdf["text"], pdf["quality"], strict=True) for m, s in [lines(t)]], columns=["quality", "m", "size"])


def fitted(docs: DataFrame, labels: DataFrame, held_out: Column, most: int = 4000) -> CRF:
    """A model of `most` labelled documents outside the held-out part at most: those with the least hashes of doc_id, so a fixed sample of any corpus. Each label weighs half."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = lab.where(~held_out).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("text", "quality").mapInPandas(_sampled, "quality int, m array<double>, size array<double>").toPandas()
    model = CRF()
    if not len(rows) or rows["quality"].nunique() < 2:
        share = float(rows["quality"].mean()) if len(rows) else 0.5
        model.emit[-1] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    x = np.concatenate([features(np.array(m).reshape(-1, MEASURES)) for m in rows["m"]])
    n = [len(s) for s in rows["size"]]
    y = np.repeat(rows["quality"].to_numpy(np.float64), n)
    size = np.concatenate([np.array(s) / sum(s) for s in rows["size"]])
    return model.fit(x, np.cumsum([0, *n]), y, size * len(y) / len(rows))


def quality(docs: DataFrame, labels: DataFrame, held_out: Column, cut: float = 0.3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted.

    Null or empty text: one empty line. Repeated or null doc_id: each row stands for
    itself. No labels, or labels of one kind: every line has the labels' share.
    """
    model = fitted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, held_out)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(frames):
        for pdf in frames:
            out = np.concatenate([shared.value.scores(list(pdf["text"].iloc[k : k + 2000])) for k in range(0, len(pdf), 2000)] or [np.zeros(0)])
            yield pdf.drop(columns="text").assign(score=np.clip(out, 0, 1))

    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out)
    return df.mapInPandas(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= cut).cast("int"))
