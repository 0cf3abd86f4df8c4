"""URL filters: rules on hosts and paths, and for all other URLs the ratio of two character language models.

The URLs that a rule accepts and those that one rejects train a smoothed
variable-order Markov model each; a URL that no rule decides is judged by the
difference of the two log-likelihoods a character, against a cutoff that held-out
URLs of the rules calibrate.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import delete, fresh_dir, written_at

#: Symbols of a URL: its UTF-8 bytes, one for its start (context only) and one for its end.
START, END, SYMBOLS = chr(256), chr(257), 257
#: Grams that a task counts before it hands them on; memory of the scores of grams.
HELD, REMEMBERED = 300_000, 300_000
#: Scores are counted by 1/1024 bit, and lie between -16 and 16.
STEP, MOST = 1024, 16
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Both empty if url is null or has no ://."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    part = lambda k: F.regexp_extract(text, r"\A(?s:.*?)://([^/?#]*)([^?#]*)", k)
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, of equally long ones that of the longer host, then the first by its text; nulls if none does. rules: host with a path from its first / on, and "allow" or "block". One fits its host and all subdomains, if the path starts with its own."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r), r.find("/") if "/" in r else len(r), [-ord(c) for c in r])):  # the last of them is asked first
        h, _, p = r.partition("/")
        p = r[len(h) :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(r)).otherwise(name), F.when(fits, F.lit(rules[r])).otherwise(verdict)
    return name, verdict


def symbols(url: str | None) -> str:
    """The URL after its scheme, its host lower-cased, as one character a byte, between a start and an end."""
    url = url or ""
    _, found, rest = url.partition("://")
    rest = rest if found else url
    at = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    rest = rest[:at].translate(LOWER) + rest[at:]
    return START + rest.encode("utf-8", "surrogatepass").decode("latin-1") + END


def _count(order: int):
    """(label, gram, n): how often each run of up to order symbols is followed by its last one; gram: context and symbol."""

    def f(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bool, Counter] = {True: Counter(), False: Counter()}
        out = lambda: pd.DataFrame([(k, g, n) for k, c in held.items() for g, n in c.items()], columns=["accepted", "gram", "n"])
        for pdf in frames:
            for url, accepted in zip(pdf["url"], pdf["accepted"], strict=True):
                s, c = symbols(url), held[bool(accepted)]
                c.update(s[1:])  # the start is no symbol that anything predicts
                for n in range(2, order + 2):
                    c.update(s[i : i + n] for i in range(len(s) - n + 1))
                if sum(map(len, held.values())) > HELD:
                    yield out()
                    held[True].clear()
                    held[False].clear()
        yield out()

    return f


class Model:
    """Interpolated Witten-Bell estimates over the contexts that were kept; a context that wasn't gives way to the next shorter one."""

    def __init__(self, order: int):
        self.order = order
        self.next: dict[str, dict[str, int]] = {}
        self.total: dict[str, int] = {}

    def add(self, gram: str, n: int) -> None:
        context = gram[:-1]
        self.next.setdefault(context, {})[gram[-1]] = n
        self.total[context] = self.total.get(context, 0) + n

    def p(self, context: str, symbol: str) -> float:
        at, p = len(context), 1 / SYMBOLS
        for n in range(at + 1):
            c = context[at - n :]
            follow = self.next.get(c)
            if follow is None:
                break
            kinds = len(follow)
            p = (follow.get(symbol, 0) + kinds * p) / (self.total[c] + kinds)
        return p


class Ratio(dict):
    """Gram -> log2 of the accepting model's probability over the rejecting one's; forgets all when too many are held."""

    def __init__(self, accepting: Model, rejecting: Model):
        self.accepting, self.rejecting = accepting, rejecting

    def __missing__(self, gram: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        r = math.log2(self.accepting.p(gram[:-1], gram[-1]) / self.rejecting.p(gram[:-1], gram[-1]))
        self[gram] = r
        return r

    def score(self, url: str | None) -> float:
        """Bits a symbol, the end counted."""
        s, k = symbols(url), self.accepting.order
        return math.fsum(self[s[max(0, i - k) : i + 1]] for i in range(1, len(s))) / (len(s) - 1)


def trained(urls: DataFrame, order: int, share: float) -> Ratio | None:
    """The models of urls (url, accepted). None if either kind has no URL.

    A context is kept if its occurrences are at least `share` of all symbols of its
    kind, so that at most 1/share contexts of a length are, each with at most 257
    following symbols: what the driver holds is bounded whatever the input. Every
    count is over all URLs.
    """
    grams = urls.mapInPandas(_count(order), "accepted boolean, gram string, n long").groupBy("accepted", "gram").agg(F.sum("n").alias("n"))
    path = fresh_dir(urls.sparkSession, "grams")
    grams = written_at(grams.withColumn("context", F.expr("substr(gram, 1, length(gram) - 1)")), path)
    contexts = grams.groupBy("accepted", "context").agg(F.sum("n").alias("of"))
    total = grams.where("context = ''").groupBy("accepted").agg(F.sum("n").alias("total"))
    kept = contexts.join(F.broadcast(total), "accepted").where(F.col("of") >= F.col("total") * share).select("accepted", "context")
    ratio = Ratio(Model(order), Model(order))
    for r in grams.join(kept, ["accepted", "context"]).select("accepted", "gram", "n").toLocalIterator():
        (ratio.accepting if r.accepted else ratio.rejecting).add(r.gram, r.n)
    delete(urls.sparkSession, path)
    return ratio if ratio.accepting.next and ratio.rejecting.next else None


def _score(ratio) -> Callable[[Column | str], Column]:
    @F.pandas_udf("double")
    def score(url: pd.Series) -> pd.Series:
        return pd.Series([ratio.value.score(u) for u in url], dtype=float)

    return score


def cutoff(scores: DataFrame, wrong: float) -> float:
    """Of held-out scores (score, accepted): the largest multiple of 1/1024 bit with at most the share `wrong` of the accepted ones below it. 0 if none is accepted. Exact to that step: the counts of at most 2^15 values are looked at."""
    at = F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("score"))) * STEP).cast("int")
    counts = sorted(tuple(r) for r in scores.where("accepted").groupBy(at.alias("at")).count().collect())
    most, below = wrong * sum(n for _, n in counts), 0
    for step, n in counts:
        below += n
        if below > most:
            return step / STEP
    return 0.0


def judged(pages: DataFrame, rules: dict[str, str], id: Column | str = "page_id", url: Column | str = "url", order: int = 5, share: float = 1 / 5000, wrong: float = 0.05, held_out: int = 5) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict (allow or block), score (bits a symbol, positive: likelier accepted), cutoff.

    A rule that fits decides; else a URL is blocked if its score is below the
    cutoff. Of the URLs that rules decide, those whose crc32 mod `held_out` is not 0
    train the models, the others calibrate the cutoff: at most the share `wrong` of
    the held-out accepted ones score below it. Repeated URLs count each time. Null
    url: as the empty one; it has no rule. A URL of any length is read whole. If no
    rule accepts, or none rejects, a URL of the rest is allowed, its score and the
    cutoff null. No rows: no rows. Other columns of pages are not looked at.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    df = pages.select(col(id).alias("page_id"), col(url).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    df = df.withColumns({"host": host, "path": path})
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": name, "by_rule": verdict})
    ruled = df.where("by_rule is not null").select("url", (F.col("by_rule") == "allow").alias("accepted"), (F.crc32(F.col("url").cast("binary")) % held_out == 0).alias("held"))
    ratio = trained(ruled.where("not held").select("url", "accepted"), order, share)
    if ratio is None:
        none = F.lit(None).cast("double")
        return df.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit("allow")).alias("verdict"), none.alias("score"), none.alias("cutoff"))
    told = pages.sparkSession.sparkContext.broadcast(ratio)
    score = _score(told)
    at = cutoff(ruled.where("held").select("accepted", score("url").alias("score")), wrong)
    return df.withColumn("score", score("url")).select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") < at, "block").otherwise("allow")).alias("verdict"), "score", F.lit(at).alias("cutoff"))
