"""A hidden Markov language model.

Words are counted over the training documents in a distributed table. The most
frequent words (a fixed number) have symbols of their own; every other word has
the symbol of its class, told by its last bytes, and a share of the class by its
count, so that seen and unseen words have exact probabilities. The frequent
words reach the tasks as a broadcast of fixed size; the others are looked up by
a join on the word, which no frequent word takes part in. Baum-Welch counts are
summed over partitions; the scaled forward recursion gives the likelihood.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import pieces, written

#: Defaults of the words broadcast with their counts and of those with a symbol of their own; classes of the other words; states.
FREQUENT, OWN, CLASSES, STATES = 200_000, 8192, 512, 8
#: Tokens of a stretch: the stretches of a long sequence are worked on side by side, joined by exact messages. Tokens in memory at once.
STRETCH, BATCH = 512, 1_000_000
ALPHA = 0.1


def tokens(text: str | None) -> list[bytes]:
    """Words, A-Z in lower case: exactly the ASCII white space parts them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


def _counts(frames):
    c: Counter = Counter()

    def rows():
        out = pd.DataFrame({"word": list(c), "n": list(c.values()), "class": [word_class(w) for w in c]})
        c.clear()
        return out

    for pdf in frames:
        for t in pdf["text"]:
            c.update(tokens(t))
            if len(c) > 300_000:
                yield rows()
    if c:
        yield rows()


class Vocabulary:
    """What the tasks know of the counts: of the frequent words, the first `most` of which have symbols of their own, and of the classes of all others."""

    def __init__(self, frequent: pd.DataFrame, classes: pd.DataFrame, total: int, distinct: int, ends: int, most: int = OWN):
        self.own = most
        self.rank = {bytes(w): i for i, w in enumerate(frequent["word"])}
        self.total, self.ends = total + ends, ends
        self.log_base = math.log10(self.total + ALPHA * (distinct + (ends > 0) + 1))
        n = frequent["n"].to_numpy(np.float64)
        own = min(most, len(n))
        size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        if len(classes):
            size[classes["class"]], kinds[classes["class"]] = classes["total"], classes["kinds"]
        g = frequent["class"].to_numpy(np.int64)
        np.subtract.at(size, g[:own], n[:own])
        np.subtract.at(kinds, g[:own], 1)
        self.log_class = np.log10(size + ALPHA * (kinds + 1))
        self.symbol = np.where(np.arange(len(n)) < most, np.arange(len(n)), most + g).astype(np.uint16)
        self.log_count = np.log10(n + ALPHA)
        self.log_within = np.where(np.arange(len(n)) < most, 0.0, self.log_count - self.log_class[g])
        #: Share of each symbol, the start of all states.
        self.share = np.zeros(most + CLASSES + 1)
        self.share[:own] = n[:own]
        self.share[most:-1] = size
        self.share[-1] = ends
        self.share = (self.share + ALPHA) / (self.share + ALPHA).sum()

    def encoder(self):
        def encode(frames):
            rank = self.rank
            for pdf in frames:
                rows = []
                for text in pdf["text"]:
                    ws = tokens(text)
                    r = np.array([rank.get(w, -1) for w in ws], np.int64)
                    seen = r >= 0
                    tail = Counter(w for w, s in zip(ws, seen.tolist(), strict=True) if not s)
                    sym = np.empty(len(ws) + 1, np.uint16)
                    sym[-1] = self.own + CLASSES
                    sym[:-1][seen] = self.symbol[r[seen]]
                    sym[:-1][~seen] = [self.own + word_class(w) for w, s in zip(ws, seen.tolist(), strict=True) if not s]
                    within = float(self.log_within[r[seen]].sum()) - sum(n * self.log_class[word_class(w)] for w, n in tail.items())
                    base = float(self.log_count[r[seen]].sum()) + math.log10(self.ends + ALPHA) - (len(ws) + 1) * self.log_base
                    rows.append((len(ws) + 1, int(seen.sum()) + (self.ends > 0), base, within, sym.tobytes(), [{"word": w, "n": n} for w, n in tail.items()]))
                out = pd.DataFrame(rows, columns=["n_tokens", "known", "base", "within", "symbols", "tail"])
                yield pd.concat([pdf[["doc_id", "held_out"]].reset_index(drop=True), out], axis=1)

        return encode


def _by_step(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, as the first tokens of all, then the second ones, and so on; where each step begins; how many sequences it has."""
    lengths = np.array([len(s) for s in seqs])
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    offset = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(offset[-1], np.uint16)
    for i, s in enumerate(seqs):
        flat[offset[: len(s)] + i] = s
    return flat, offset, active


class HMM:
    """start (K), move (K, K), emit (symbols, K)."""

    def __init__(self, share: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        self.start = np.full(STATES, 1 / STATES)
        self.move = np.full((STATES, STATES), 0.1 / (STATES - 1)) + np.eye(STATES) * (0.9 - 0.1 / (STATES - 1))
        self.emit = share[:, None] * r.uniform(0.3, 1.7, (len(share), STATES))
        self.emit /= self.emit.sum(0)

    def forward(self, seqs: list[np.ndarray], first: np.ndarray | None = None, keep: bool = False):
        """Log10 likelihoods of sequences, longest first, that begin with the states' chances `first` (a row each; `start` if none are given); with keep also what the backward pass needs. Step t handles the sequences that are longer than t."""
        flat, offset, active = _by_step(seqs)
        log = np.zeros(len(seqs))
        alphas, scales = [], []
        a = None
        for t, n in enumerate(active):
            p = (np.broadcast_to(self.start, (n, STATES)) if first is None else first) if t == 0 else a[:n] @ self.move
            a = p * self.emit[flat[offset[t] : offset[t + 1]]]
            c = a.sum(1)
            a /= c[:, None]
            log[:n] += np.log10(c)
            if keep:
                alphas.append(a.astype(np.float32))
                scales.append(c)
        return (log, flat, offset, active, alphas, scales) if keep else log

    def transfers(self, seqs: list[np.ndarray]) -> np.ndarray:
        """For each stretch, longest first, the matrix that leads from the states at its first token to those after its last, up to a factor."""
        flat, offset, active = _by_step(seqs)
        out = np.broadcast_to(np.eye(STATES), (len(seqs), STATES, STATES)).copy()
        for t, n in enumerate(active):
            x = ((out[:n] * self.emit[flat[offset[t] : offset[t + 1]]][:, None, :]).reshape(-1, STATES) @ self.move).reshape(-1, STATES, STATES)
            out[:n] = x / x.sum((1, 2))[:, None, None] if t % 8 == 7 else x
        return out / out.sum((1, 2))[:, None, None]

    def messages(self, seqs: list[np.ndarray]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
        """The stretches of sequences, in order, as (place in the sequence, tokens); for each the chances of the states at its first token given all before it, and the likelihood (up to a factor) of all after it by the state at the next one's first token; ones after the last."""
        parts = [(k, s[k : k + STRETCH]) for s in seqs for k in range(0, len(s), STRETCH)]
        before, after = np.tile(self.start, (len(parts), 1)), np.ones((len(parts), STATES))
        inner = np.array([k > 0 for k, _ in parts] + [False])
        long = np.flatnonzero(inner[:-1] | inner[1:])
        order = sorted(long.tolist(), key=lambda i: -len(parts[i][1]))
        step = {}
        for k in range(0, len(order), max(1, BATCH // STRETCH)):
            some = order[k : k + max(1, BATCH // STRETCH)]
            step.update(zip(some, self.transfers([parts[i][1] for i in some]), strict=True))
        for i in long.tolist():
            if inner[i]:
                p = before[i - 1] @ step[i - 1]
                before[i] = p / p.sum()
        for i in long[::-1].tolist():
            if inner[i + 1]:
                v = step[i + 1] @ after[i + 1]
                after[i] = v / v.sum()
        return parts, before, after

    def expected(self, seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Adds the expected counts of whole sequences and returns their log10 likelihood. BATCH tokens, or one stretch, are held at once."""
        parts, before, after = self.messages(seqs)
        order = sorted(range(len(parts)), key=lambda i: -len(parts[i][1]))
        total = 0.0
        for a, b in pieces([len(parts[i][1]) for i in order], BATCH):
            total += self._stretches([parts[i] for i in order[a:b]], before[order[a:b]], after[order[a:b]], np.array([i + 1 < len(parts) and parts[i + 1][0] > 0 for i in order[a:b]]), start, move, emit)
        return total

    def _stretches(self, parts: list[tuple[int, np.ndarray]], before: np.ndarray, after: np.ndarray, followed: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> float:
        """Forward and backward over stretches, longest first; followed: the sequence goes on after the stretch."""
        log, flat, offset, active, alphas, scales = self.forward([s for _, s in parts], before, True)
        gamma = np.empty((len(flat), STATES), np.float32)
        last = np.array([len(s) - 1 for _, s in parts])
        ends = np.empty((len(parts), STATES))
        for t in np.unique(last).tolist():
            i = np.flatnonzero(last == t)
            ends[i] = alphas[t][i]
        if followed.any():
            x = ends[followed][:, :, None] * self.move * after[followed][:, None, :]
            move += (x / x.sum((1, 2))[:, None, None]).sum(0)
        tails = np.where(followed[:, None], after @ self.move.T, 1.0)
        tails /= (ends * tails).sum(1)[:, None]
        beta = np.ones((0, STATES))
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            if len(beta) < n:
                beta = np.concatenate([beta, tails[len(beta) : n]])
            g = alphas[t] * beta
            gamma[offset[t] : offset[t + 1]] = g / g.sum(1)[:, None]
            if t:
                w = self.emit[flat[offset[t] : offset[t + 1]]] * beta / scales[t][:, None]
                move += self.move * (alphas[t - 1][:n].T @ w)
                beta = w @ self.move.T
            alphas[t] = None
        start += gamma[: len(parts)][np.array([k == 0 for k, _ in parts])].sum(0)
        for k in range(STATES):
            emit[:, k] += np.bincount(flat, weights=gamma[:, k], minlength=len(emit))
        return float(log.sum())

    def counter(self):
        """A task's expected counts as rows (kind, i, K values), every symbol once at most."""

        def count(frames):
            start, move, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros_like(self.emit)
            waiting, size, log = [], 0, 0.0
            for pdf in frames:
                for raw in pdf["symbols"]:
                    waiting.append(np.frombuffer(raw, np.uint16))
                    size += len(waiting[-1])
                    if size >= BATCH:
                        log += self.expected(waiting, start, move, emit)
                        waiting, size = [], 0
            log += self.expected(waiting, start, move, emit)
            used = np.flatnonzero(emit.sum(1))
            rows = [("start", 0, start.tolist()), ("log", 0, [log] + [0.0] * (STATES - 1))] + [("move", k, move[k].tolist()) for k in range(STATES)]
            yield pd.DataFrame(rows + [("emit", int(i), emit[i].tolist()) for i in used], columns=["kind", "i", "v"])

        return count

    def scorer(self):
        def score(frames):
            for pdf in frames:
                seqs = [np.frombuffer(x, np.uint16) for x in pdf["symbols"]]
                order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
                out = np.empty(len(seqs))
                at = 0
                while at < len(order):
                    end, total = at, 0
                    while end < len(order) and (end == at or total < 4 * BATCH):
                        total += len(seqs[order[end]])
                        end += 1
                    out[order[at:end]] = self.forward([seqs[i] for i in order[at:end]])
                    at = end
                yield pdf.drop(columns="symbols").assign(log=out)

        return score


def most_frequent(counts: DataFrame, most: int = FREQUENT) -> pd.DataFrame:
    """The words above a count that `most` words at most reach: the count is found from a histogram of fixed size, so no task sends more than its share."""
    step = F.floor(F.log2("n") * 16).cast("int")
    hist = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).toPandas().sort_values("step", ascending=False)
    fit = hist.loc[hist["words"].cumsum() <= most, "step"]
    least = int(fit.min()) if len(fit) else 1 << 30
    return counts.where(step >= least).toPandas().sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


def trained(encoded: DataFrame, share: np.ndarray, iterations: int) -> HMM:
    """Baum-Welch over all rows of encoded (symbols)."""
    model = HMM(share)
    for _ in range(iterations):
        sums = encoded.select("symbols").mapInPandas(model.counter(), "kind string, i int, v array<double>").groupBy("kind", "i").agg(*(F.sum(F.element_at("v", k + 1)).alias(f"v{k}") for k in range(STATES))).toPandas()
        if not len(sums):
            break
        v = sums[[f"v{k}" for k in range(STATES)]].to_numpy()
        emit = np.zeros_like(model.emit)
        e = (sums["kind"] == "emit").to_numpy()
        emit[sums["i"].to_numpy()[e]] = v[e]
        emit += share[:, None] * 0.5 + 1e-9
        move = np.zeros((STATES, STATES))
        m = (sums["kind"] == "move").to_numpy()
        move[sums["i"].to_numpy()[m]] = v[m]
        start = v[(sums["kind"] == "start").to_numpy()].sum(0)
        model.emit, model.move, model.start = emit / emit.sum(0), (move + 0.01) / (move + 0.01).sum(1)[:, None], (start + 0.01) / (start + 0.01).sum()
    return model


def score(docs: DataFrame, held_out: Column, iterations: int = 3, own: int = OWN, frequent: int = FREQUENT) -> DataFrame:
    """One row per row of docs (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score.

    own: words that have emissions of their own (65,000 at most); all others, seen
    or not, share those of their class, each by its count. frequent: words whose
    counts are broadcast; the others' are joined, with the same result.

    Learns from the rows where held_out is false. Null or empty text: the end
    alone. No training rows: every word is unseen, all states are alike. Repeated
    or null doc_id: each row stands for itself.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    train = df.where(~F.col("held_out"))
    counts = written(train.select("text").mapInPandas(_counts, "word binary, n long, class int").groupBy("word").agg(F.sum("n").alias("n"), F.first("class").alias("class")), "counts")
    ends = train.count()
    classes = counts.groupBy("class").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).toPandas()
    vocabulary = Vocabulary(most_frequent(counts, frequent), classes, int(classes["total"].sum()), int(classes["kinds"].sum()), ends, own)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, within double, symbols binary, tail array<struct<word:binary, n:long>>"
    encoded = written(df.mapInPandas(lambda frames: shared.value.encoder()(frames), schema).withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = docs.sparkSession.sparkContext.broadcast(trained(encoded.where(~F.col("held_out")), vocabulary.share, iterations))
    scored = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "within", "symbols").mapInPandas(lambda frames: model.value.scorer()(frames), "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, within double, log double")
    rare = encoded.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times")).join(counts.select("word", "n"), "word", "left")
    tail = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("tail_log"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"))
    log, more = F.coalesce("tail_log", F.lit(0.0)), F.coalesce("tail_known", F.lit(0).cast("long"))
    return scored.join(tail, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + more).alias("n_known"), F.lit(vocabulary.total).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("log") + F.col("within") + log).alias("score"))
