"""Secret scans by corpus-wide ownership frequency.

Every text is searched for candidates; the hash of each candidate's value is
counted over distinct repositories and owners of the whole corpus. A value that
many owners hold is a copied example; one that fewer hold, in however many
repositories, and that looks random is a live-looking credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import written

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Further candidates: long words of mixed case with digits.
MIXED = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])(?=[A-Z0-9_-]*[a-z])(?=[a-z0-9_-]*[A-Z])[A-Za-z0-9_-]{20,}")
KINDS = ("assign", "access", "hex", "mixed")


def entropy(value: str) -> float:
    """Bits a character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def found(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind's rank, end, value) of every candidate, in order; offsets in code points, end exclusive."""
    text = text or ""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), k, m.end(), m[0]) for k, p in ((1, ACCESS), (2, HEX)) for m in p.finditer(text)]
    base = sorted(out)
    out += [x for m in MIXED.finditer(text) if not any(a < m.end() and m.start() < b for a, _, b, _ in base) for x in [(m.start(), 3, m.end(), m[0])]]
    return sorted(out)


def _scan(frames):
    for pdf in frames:
        rows = []
        for doc, text, repo, owner in zip(pdf["doc_id"], pdf["text"], pdf["repo"], pdf["owner"], strict=True):
            c = found(text)
            base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in c if k < 3)
            n = Counter(k for _, k, _, _ in c)
            rows.append((doc, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), repo, owner, [{"start": a, "rank": k, "end": b, "hash": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= 3.0} for a, k, b, v in c]))
        out = pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "repo", "owner", "candidates"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, repo string, owner string, candidates array<struct<start:long, rank:int, end:long, hash:string, random:boolean>>"


def secrets(docs: DataFrame, repo: Column | str = "source", owner: Column | str = "source", copied_owners: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and digest of the base spans, all spans, the repositories that hold their values, and how many candidates are live-looking or copied.

    n_copied counts candidates whose value `copied_owners` owners or more hold;
    n_live those that fewer hold and that look random; what is in neither doesn't
    look random. spans holds the base spans and those of live mixed words; repos,
    in the same order, the number of distinct repositories (owner and name). Null or empty text: no spans. Null repository or owner:
    counts as the empty name. Repeated or null doc_id: each row stands for itself.
    """
    as_col = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), as_col(repo).alias("repo"), as_col(owner).alias("owner"))
    scanned = written(df.mapInPandas(_scan, SCANNED).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = scanned.select("row", "repo", "owner", F.explode("candidates").alias("c")).select("row", "repo", "owner", "c.*")
    held = each.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("repos"))
    judged = each.join(held, "hash").select("row", "start", "rank", "end", "repos", (F.col("owners") >= copied_owners).alias("copied"), (F.col("random") & (F.col("owners") < copied_owners)).alias("live"))
    by_row = judged.groupBy("row").agg(
        F.count_if("live").alias("n_live"),
        F.count_if("copied").alias("n_copied"),
        F.array_sort(F.collect_list(F.when((F.col("rank") < 3) | F.col("live"), F.struct("start", "rank", "end", "repos")))).alias("s"),
    )
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("s", lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    repos = F.array_join(F.transform("s", lambda x: x["repos"].cast("string")), ",")
    zero = F.lit(0).cast("long")
    return scanned.select("row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256").join(by_row, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"), F.coalesce(repos, F.lit("")).alias("repos"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))
