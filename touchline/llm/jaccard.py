"""Join of texts whose sets of five-word runs are similar (Jaccard 0.8 or more).

Texts with the same set are one node. A forest of prefix tries holds each node's
min-hashes: a tree's paths lie sorted, so what a path shares with its neighbours
is the longest prefix that it shares with any. Nodes under an equal prefix are
candidates. All begin at the deepest prefix; as long as the recall that the
similarities met so far allow to estimate lies below the target, the prefixes
are shortened by one and only what meets anew is looked at. Candidates whose
signatures agree enough are joined into rough groups; within them every pair is
verified exactly, in blocks, so that a task holds two blocks at a time. No pairs
leave a task, only each node's number of links and a forest of the verified links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import WordHash, components, ngram_hashes, same_names, word_hashes, words, written

WORDS, TREES, DEEPEST = 5, 16, 5
#: Least estimated share of the similar pairs that meet under some prefix.
TARGET = 0.9999
#: Signatures that agree in a smaller share than this are no candidates: over four standard deviations below 0.8.
ROUGH = 0.6
#: Nodes in a block.
BLOCK = 256
_R = np.random.default_rng(11)
_A = _R.integers(1, 1 << 63, TREES * DEEPEST, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 1 << 63, TREES * DEEPEST, dtype=np.uint64)


def met(similarity, depth: int):
    """The chance that two sets of a similarity share a prefix of this depth in a tree at least."""
    return 1 - (1 - np.asarray(similarity, float) ** depth) ** TREES


def recall(found: np.ndarray, similarity: float, depth: int) -> float:
    """Estimated share of the similar pairs that prefixes of this depth find. found: pairs that they found, by how many min-hashes agree. Each stands for as many as its chance to be found says; one pair more of the least similarity is supposed, so that nothing found proves nothing."""
    agree = np.arange(len(found)) / (len(found) - 1)
    near = (agree >= similarity) & (found > 0)
    return float((found[near].sum() + met(similarity, depth)) / ((found[near] / met(agree[near], depth)).sum() + 1))


def shingles(text: str | None, known: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the five-word runs; of a shorter text, of all its words together; of none, nothing."""
    h = word_hashes(words(text), known)
    return np.unique(ngram_hashes(h, min(WORDS, len(h)))) if len(h) else h


def signature(s: np.ndarray) -> np.ndarray:
    out = np.empty(len(_A), np.uint64)
    for k in range(0, len(_A), 16):
        out[k : k + 16] = ((s[None, :] * _A[k : k + 16, None] + _B[k : k + 16, None]) >> np.uint64(16)).min(1)
    return out


def node(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _described(frames):
    known = WordHash()
    for pdf in frames:
        nodes, sigs, paths = [], [], []
        for t in pdf["text"]:
            s = shingles(t, known)
            nodes.append(node(s))
            if not len(s):
                sigs.append(None)
                paths.append(None)
                continue
            g = signature(s)
            sigs.append((g & np.uint64(255)).astype(np.uint8).tobytes())
            p = g.astype(">u4").tobytes()
            paths.append([p[k : k + 4 * DEEPEST] for k in range(0, len(p), 4 * DEEPEST)])
        yield pd.DataFrame({"did": pdf["did"], "hash": pdf["hash"], "node": nodes, "sig": sigs, "paths": paths})


def _climbed(frames):
    """Sorted paths that share a prefix with the one before or after them, and the length of the longer such prefix; the first and last of a partition count as sharing all."""
    last = None  # tree, path, node and the prefix shared with the path before

    def shared(t0, p0, t1, p1):
        return np.where(t0 == t1, np.logical_and.accumulate(p0 == p1, axis=-1).sum(-1), 0)

    def rows(t, p, n, common):
        some = common > 0
        return pd.DataFrame({"tree": t[some], "path": [x.astype(">u4").tobytes() for x in p[some]], "node": n[some], "common": common[some]})

    for pdf in frames:
        if not len(pdf):
            continue
        t, n = pdf["tree"].to_numpy(), pdf["node"].to_numpy()
        p = np.frombuffer(b"".join(pdf["path"]), ">u4").reshape(len(t), DEEPEST).astype(np.uint32)
        before = np.full(len(t), DEEPEST)
        before[1:] = shared(t[:-1], p[:-1], t[1:], p[1:])
        if last is not None:
            before[0] = shared(last[0][0], last[1][0], t[0], p[0])
            yield rows(*last[:3], np.maximum(last[3], before[:1]))
        yield rows(t[:-1], p[:-1], n[:-1], np.maximum(before[:-1], before[1:]))
        last = t[-1:], p[-1:], n[-1:], before[-1:]
    if last is not None:
        yield rows(*last[:3], np.full(1, DEEPEST))


def runs(frames, keys: list[str]) -> Iterator[tuple[tuple, dict[str, np.ndarray]]]:
    """Groups of a partition that is sorted by keys: (key, columns)."""
    rest = None
    for pdf in frames:
        if rest is not None:
            pdf = pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = [pdf[c].to_numpy() for c in keys]
        new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        for a, b in zip([0, *new[:-1].tolist()], new.tolist()):
            yield tuple(x[a] for x in k), {c: v[a:b] for c, v in cols.items()}
        rest = pdf.iloc[int(new[-1]) if len(new) else 0 :]
    if rest is not None and len(rest):
        yield tuple(rest[c].iloc[0] for c in keys), {c: rest[c].to_numpy() for c in rest.columns}


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """Links of a symmetric matrix that join what it joins, without rounds: breadth first."""
    n, out = len(pairs), []
    new = np.ones(n, bool)
    for s in range(n):
        if not new[s]:
            continue
        new[s], front = False, [s]
        while front:
            u = front.pop()
            for v in np.flatnonzero(pairs[u] & new).tolist():
                new[v] = False
                out.append((u, v))
                front.append(v)
    return out


def joining(close: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what a symmetric matrix over two blocks joins, if others join what it joins within a block: a link for each two such parts that have to meet, and not for each node, as every block meets every other. Over one block, its forest."""
    if (own == own[0]).all():
        return forest(close)
    inside = own[:, None] == own[None, :]
    part = np.arange(len(close))
    for u, v in forest(close & inside):
        part[v] = part[u]
    u, v = np.nonzero(close & ~inside)
    met = np.zeros(close.shape, bool)
    met[part[u], part[v]] = True
    return forest(met)


def _blocks(df: DataFrame, size: str) -> DataFrame:
    """A row for each pair of blocks (i <= j) of the group that the row's block takes part in."""
    count = F.ceil(F.col(size) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.ceil(F.col(size) / BLOCK)).cast("int")
    return df.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("i", F.least("own", "with")).withColumn("j", F.greatest("own", "with")).drop("with")


def _allowed(own: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs that a pair of blocks answers for: within the block, or across both."""
    pairs = np.ones((len(own), len(own)), bool) if i == j else own[:, None] != own[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


def _rough(depth: int, similarity: float):
    """Of nodes under an equal prefix of this depth: links (a, b) that join those whose signatures agree enough; rows (agree, n), how many similar pairs that meet under no longer prefix agree in so many min-hashes."""

    def rough(frames):
        rows, found = [], np.zeros(TREES * DEEPEST + 1)
        for (_, _, i, j), g in runs(frames, ["tree", "prefix", "i", "j"]):
            if len(g["node"]) < 2:
                continue
            order = np.argsort(g["node"])  # so that groups of the same nodes in several trees give the same links
            g = {c: x[order] for c, x in g.items()}
            s, n = np.array([np.frombuffer(x, np.uint8) for x in g["sig"]]), g["node"]
            pairs = np.triu(_allowed(g["own"], i, j))
            if depth < DEEPEST:  # these met one step deeper
                pairs &= g["rest"][:, None] != g["rest"][None, :]
            close = np.zeros((len(n), len(n)), bool)
            if i != j:  # what is joined within a block, here or one step deeper
                u, v = np.nonzero(np.triu(g["own"][:, None] == g["own"][None, :], 1))
                ok = (s[u] == s[v]).sum(1) >= ROUGH * s.shape[1]
                close[u[ok], v[ok]] = close[v[ok], u[ok]] = True
            u, v = np.nonzero(pairs)
            same = s[u] == s[v]
            agree = same.sum(1)
            ok = agree >= ROUGH * s.shape[1]
            u, v, agree = u[ok], v[ok], agree[ok]
            lead = np.logical_and.accumulate(same[ok].reshape(-1, TREES, DEEPEST), axis=2).sum(2)
            new = ~(lead > depth).any(1)
            found += np.bincount(agree[new], weights=1 / np.maximum(1, (lead[new] >= depth).sum(1)), minlength=len(found))
            close[u, v] = close[v, u] = True
            rows += [(int(n[x]), int(n[y])) for x, y in joining(close, g["own"])]
            if len(rows) > 50_000:
                yield table(rows, [])
                rows = []
        yield table(rows, [(k, x) for k, x in enumerate(found.tolist()) if x])

    def table(links, counts):
        return pd.DataFrame({"a": pd.array([x[0] for x in links] + [None] * len(counts), "Int64"), "b": pd.array([x[1] for x in links] + [None] * len(counts), "Int64"), "agree": pd.array([None] * len(links) + [x[0] for x in counts], "Int32"), "n": [0.0] * len(links) + [x[1] for x in counts]})

    return rough


def candidates(nodes: DataFrame, similarity: float, target: float = TARGET) -> DataFrame:
    """Links (a, b) that join the nodes (node, sig, paths) which may be similar: prefixes are shortened until the estimated recall is at the target."""
    paths = nodes.select("node", F.posexplode("paths").alias("tree", "path")).repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    tries = written(paths.mapInPandas(_climbed, "tree int, path binary, node long, common int"), "tries")
    out, found = None, np.zeros(TREES * DEEPEST + 1)
    for depth in range(DEEPEST, 0, -1):
        at = tries.where(F.col("common") >= depth).select("node", "tree", F.substring("path", 1, 4 * depth).alias("prefix"), F.substring("path", 4 * depth + 1, 4).alias("rest"))
        shared = at.groupBy("tree", "prefix").agg(F.count("*").alias("members")).where("members > 1")
        under = at.join(shared, ["tree", "prefix"]).join(nodes.select("node", "sig"), "node")
        dealt = _blocks(under, "members").repartition("tree", "prefix", "i", "j").sortWithinPartitions("tree", "prefix", "i", "j").select("tree", "prefix", "i", "j", "node", "own", "rest", "sig")
        round_ = written(dealt.mapInPandas(_rough(depth, similarity), "a long, b long, agree int, n double"), "rough")
        links = round_.where("b is not null").select("a", "b")
        out = links if out is None else out.union(links)
        for r in round_.where("b is null").groupBy("agree").agg(F.sum("n").alias("n")).collect():
            found[r["agree"]] += r["n"]
        if recall(found, similarity, depth) >= target:
            break
    return out


def links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of sets have the similarity, by exact counts of common members."""
    n = np.array([len(s) for s in sets], np.int64)
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    many = np.bincount(at, minlength=len(values)) > 1
    rank = np.cumsum(many) - 1
    keep = many[at]
    at, owner = rank[at[keep]], owner[keep]
    common = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    for a in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        lo, hi = np.searchsorted(at, [a, a + 4096])
        x = np.zeros((len(sets), 4096), np.float32)
        x[owner[lo:hi], at[lo:hi] - a] = 1
        common += x @ x.T
    return common + 1e-9 >= similarity * (n[:, None] + n[None, :] - common)


def _verified(similarity: float):
    def verify(frames):
        rows = []
        for (_, i, j), g in runs(frames, ["root", "i", "j"]):
            if len(g["node"]) < 2:
                continue
            alike = links([np.frombuffer(x, np.uint64) for x in g["set"]], similarity)
            pairs = _allowed(g["own"], i, j) & alike
            n, total = g["node"], pairs @ g["copies"].astype(np.int64)
            rows += [(int(x), None, int(t)) for x, t in zip(n, total, strict=True) if t]
            np.fill_diagonal(alike, False)
            rows += [(int(n[u]), int(n[v]), 0) for u, v in joining(alike, g["own"])]
            if len(rows) > 50_000:
                yield _table(rows)
                rows = []
        yield _table(rows)

    def _table(rows):
        return pd.DataFrame({"a": pd.array([r[0] for r in rows], "Int64"), "b": pd.array([r[1] for r in rows], "Int64"), "n": pd.array([r[2] for r in rows], "Int64")})

    return verify


def _set(frames):
    known = WordHash()
    for pdf in frames:
        yield pdf.drop(columns="text").assign(set=[shingles(t, known).tobytes() for t in pdf["text"]])


LAST = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "hash": F.xxhash64(text)})


def with_rows(docs: DataFrame) -> DataFrame:
    """docs' rows as the struct _row, with their did and hash."""
    return _keyed(same_names(docs, doc_id="doc_id", text="text")).select("_row", "did", "hash")


def classes(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(rows: did, hash, node of each row of docs; nodes: node, copies, links, did and hash of the class's first row)."""
    df = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("did", "hash", "text")
    described = written(df.mapInPandas(_described, "did long, hash long, node long, sig binary, paths array<binary>"), "signatures")
    rows = described.select("did", "hash", "node")
    nodes = written(described.groupBy("node").agg(F.count("*").alias("copies"), F.min(F.struct("did", "hash")).alias("at"), F.first("sig").alias("sig"), F.first("paths").alias("paths")), "nodes")
    rough = components(candidates(nodes.select("node", "sig", "paths"), similarity))
    sized = written(rough.join(rough.groupBy("root").agg(F.count("*").alias("members")), "root").join(nodes.select("node", "copies", "at"), "node").select("node", "root", "members", "copies", F.col("at.did").alias("did"), F.col("at.hash").alias("hash")), "rough")
    sets = df.join(sized.hint("merge"), ["did", "hash"]).mapInPandas(_set, "did long, hash long, node long, root long, members long, copies long, set binary").dropDuplicates(["node"])
    exact = written(_blocks(sets, "members").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").select("root", "i", "j", "node", "own", "copies", "set").mapInPandas(_verified(similarity), "a long, b long, n long"), "links")
    linked = exact.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    joined = components(exact.where("b is not null").select("a", "b"))
    whole = nodes.select("node", "copies", "at").join(joined, "node", "left").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = whole.groupBy("root").agg(F.min("at").alias("first"))
    return rows, written(whole.join(first, "root").select("node", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.col("first.did").alias("did"), F.col("first.hash").alias("hash")), "classes")


def jaccard_join(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, class_id (the least doc_id of the class; null if it has none), n_links (other rows that are similar), n_copies (rows with the same set).

    Null and empty texts are copies of each other, as are texts of fewer than five
    words that are equal word by word. Repeated rows are copies. Null doc_id: a row like others.
    """
    rows, nodes = classes(docs, similarity)
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return rows.select(real("did").alias("doc_id"), "node").join(nodes.select("node", real("did").alias("class_id"), F.col("links").alias("n_links"), F.col("copies").alias("n_copies")), "node").drop("node")


def first_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs with its columns, whatever their names: of each class the row with the least doc_id (null ids last; of rows of equal id and text, one). Null and empty texts are one class. No rows: none."""
    _, nodes = classes(docs, similarity)
    return with_rows(docs).join(nodes.select("did", "hash").distinct(), ["did", "hash"]).dropDuplicates(["did", "hash"]).select("_row.*")
