"""Quality rules whose cutoffs are certified on labelled documents.

All rules' cutoffs are tightened together, level by level from "reject only what
scores 1" to a floor a rule. In each stratum the levels are tried in that order (a
fixed sequence, so trying many costs nothing), each by an exact binomial test that
the share of good documents that any rule rejects is above the allowed risk. The
last level that passes is taken. The error of the tests is divided over the strata
(Bonferroni), and nothing is lost to the number of rules.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import same_names, words, written

SYMBOL = re.compile(r"[#*$%&|<>]")
MARK = re.compile(r"[^\w\s]")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
#: Scores from 0 to 1 of which a high value speaks against a document.
RULES = ("symbols", "upper", "marks", "neighbours", "repeats")
#: The tightest cutoff of each rule, and how many levels lead there: at level k of LEVELS the cutoff is floor ** (k / LEVELS).
FLOORS = {"symbols": 0.05, "upper": 0.15, "marks": 0.15, "neighbours": 0.15, "repeats": 0.4}
LEVELS = 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(ws: list[str], n: int = 3) -> int:
    """Words inside runs of n words that occur twice or more."""
    if len(ws) <= n:
        return 0
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in ws), np.int64, len(ws))
    code = a[: len(a) - n + 1].copy()
    for i in range(1, n):
        code = np.unique(code * len(ids) + a[i : len(a) - n + 1 + i], return_inverse=True)[1]
    hot = np.bincount(code)[code] > 1
    edge = np.zeros(len(a) + 1, np.int64)
    at = np.flatnonzero(hot)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str | None) -> tuple:
    text = text or ""
    ws = words(text)
    n, chars = len(ws), sum(map(len, ws))
    lines = Counter(x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r"))
    symbols, repeats = len(SYMBOL.findall(text)), covered(ws)
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    same = sum(map(str.__eq__, ws, ws[1:]))
    return (n, chars, symbols, sum(c - 1 for c in lines.values()), repeats, share(symbols, chars), share(len(UPPER.findall(text)), chars), share(len(MARK.findall(text)), chars), share(same, n), share(repeats, n))


def measured(df: DataFrame) -> DataFrame:
    """df (own names only) with the counts and scores of its text in its place."""

    @F.pandas_udf(", ".join([f"{c} long" for c in COUNTS] + [f"{c} double" for c in RULES]))
    def measure(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measures(x) for x in texts], columns=[*COUNTS, *RULES])

    # Else a filter on what it returns would be moved below and measure every text twice.
    once = measure.asNondeterministic()
    keep = [c for c in df.columns if c != "text"]
    return df.select(*keep, once("text").alias("_m")).select(*keep, "_m.*")


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial(n, p), exactly: from k downwards until the terms no longer count."""
    if k >= n:
        return 1.0
    log = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total = math.exp(log)
    while k > 0 and (k > n * p or log > math.log(max(total, 1e-300)) - 45):
        j = np.arange(k, max(k - 4096, 0), -1)
        logs = log + np.cumsum(np.log(j) - np.log(n - j + 1) + math.log1p(-p) - math.log(p))
        total += float(np.exp(logs).sum())
        k, log = k - len(j), float(logs[-1])
    return min(1.0, total)


def certified(hist: np.ndarray, risk: float, error: float) -> int | None:
    """hist: good documents by step, the higher the sooner they are rejected. The lowest step g such that rejecting steps >= g is certified; None: none is."""
    n, best, rejected = int(hist.sum()), None, 0
    for g in range(len(hist) - 1, 0, -1):
        rejected += int(hist[g])
        if not n or tail(rejected, n, risk) > error:
            break
        best = g
    return best


def step() -> Column:
    """How soon the rules reject a document as they are tightened: LEVELS if the first level does, 1 if only the last one does, 0 if none does."""
    out = []
    for r in RULES:
        level = F.ceil(LEVELS * F.log(F.col(r)) / math.log(FLOORS[r]))
        out.append(F.when(F.col(r) > 0, F.greatest(F.lit(0), LEVELS + 1 - F.greatest(F.lit(1), level))).otherwise(0))
    return F.greatest(*out).cast("int")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def cutoffs(scored: DataFrame, stratum: str = "stratum", good: str = "good", risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """(stratum, step, one cutoff a rule): certified, null where no level is.

    scored has the stratum (null: its own stratum), the counts, the scores and
    whether the document is good (null: left out). risk: the share of a stratum's
    good documents, of those that don't fail the base, that the rules together may
    reject; error: the chance that any stratum's share is above it. A stratum needs
    about log(error / strata) / log(1 - risk) good labels, 437 with four strata, for
    the first level. No labelled rows: no strata, so no rejection.
    """
    rows = scored.where(F.col(good) & ~base_failed()).select(F.coalesce(F.col(stratum), F.lit("")).alias("stratum"), step().alias("step"))
    hist = written(rows.groupBy("stratum", "step").agg(F.count("*").alias("n")).coalesce(1), "holdout")  # LEVELS rows a stratum
    strata = max(1, hist.select("stratum").distinct().count())

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        g = certified(np.bincount(pdf["step"], weights=pdf["n"], minlength=LEVELS + 1).astype("int64"), risk, error / strata)
        out = {"stratum": pdf["stratum"].iloc[0], "cut_step": LEVELS + 1 if g is None else g}
        return pd.DataFrame([out | {f"cut_{r}": np.nan if g is None else FLOORS[r] ** ((LEVELS + 1 - g) / LEVELS) for r in RULES}])

    return written(hist.groupBy("stratum").applyInPandas(choose, "stratum string, cut_step int" + "".join(f", cut_{r} double" for r in RULES)).coalesce(1), "cutoffs")  # a row a stratum


def judged(scored: DataFrame, cuts: DataFrame) -> DataFrame:
    """scored (with its stratum) with base_failed and kept."""
    out = scored.withColumn("stratum", F.coalesce("stratum", F.lit(""))).join(cuts, "stratum", "left")
    over = F.coalesce(step() >= F.col("cut_step"), F.lit(False))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~over)


def fitted(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """Cutoffs of the labelled documents, strata by lang. A document with several labels is good only if all say so."""
    lab = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    some = docs.select("doc_id", "text", F.col("lang").cast("string").alias("stratum")).join(lab, "doc_id").repartition("doc_id")
    return cutoffs(measured(some.select("text", "stratum", "good")), risk=risk, error=error)


def quality_rules(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """One row per row of docs: doc_id, the counts, base_failed, kept.

    Null or empty text: no words, so base_failed. Null lang: its own stratum.
    Repeated or null doc_id: each row stands for itself. A stratum without enough
    labels has no cutoffs and rejects only what base_failed does.
    """
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("stratum"))
    return judged(measured(df), fitted(docs, labels, risk, error)).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> DataFrame:
    """The rows of docs, with its columns, whatever their names, that quality_rules keeps: none of a null or empty text; repeated rows alike."""
    df = same_names(docs, text=F.col("text").cast("string"), stratum=F.col("lang").cast("string"))
    return judged(measured(df), fitted(docs, labels, risk, error)).where("kept").select("_row.*")
