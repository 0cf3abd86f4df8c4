"""Merkle manifest of a dataset: a tree of 8 a node for each group of rows, and one over the groups' roots.

A fragment is a sparse forest: the digests of nodes whose siblings are not all
there yet, keyed by tree, level and index. Merging two is union, after which every
complete run of siblings (how many it has is known, as the number of leaves is)
gives way to its parent; this is associative, and neighbouring leaves leave a
fragment of at most 14 nodes a level. Chunks of rows become fragments in their
tasks, treeReduce merges these to the root, and exclusive scans from both sides
give each chunk the nodes beside its paths: all that its rows' proofs need.
"""

from __future__ import annotations

import hashlib
import pickle

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import quoted, written

ARITY = 8
#: The tree over the groups' roots.
TOP = -1
#: Rows of a chunk; fragments that a task of a scan merges.
CHUNK, FAN = 2048, 256

Key = tuple[int, int, int]


def joined(*digests: bytes) -> bytes:
    """H of digests as hex text."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    for _ in range(level):
        leaves = -(-leaves // ARITY)
    return leaves


class Forest:
    """nodes: (tree, level, index) -> (digest, leaves of the tree). groups: leaves of the tree over the groups' roots."""

    def __init__(self, groups: int, nodes: dict[Key, tuple[bytes, int]] | None = None):
        self.groups, self.nodes = groups, nodes or {}

    def settled(self) -> Forest:
        """Complete runs give way to their parents, a group's root becomes a leaf of the top tree."""
        nodes = self.nodes
        todo = list(nodes)
        while todo:
            tree, level, i = todo.pop()
            if (tree, level, i) not in nodes:
                continue
            leaves = nodes[tree, level, i][1]
            n = width(leaves, level)
            if n == 1:
                if tree == TOP:
                    continue
                digest, _ = nodes.pop((tree, level, i))
                up = (TOP, 0, tree)
                nodes[up] = (digest, self.groups)
            else:
                a = i - i % ARITY
                run = [(tree, level, j) for j in range(a, min(a + ARITY, n))]
                if not all(k in nodes for k in run):
                    continue
                up = (tree, level + 1, a // ARITY)
                nodes[up] = (joined(*(nodes.pop(k)[0] for k in run)), leaves)
            todo.append(up)
        return self

    def __add__(self, other: Forest) -> Forest:
        return Forest(self.groups, self.nodes | other.nodes).settled()

    def root(self) -> str | None:
        """The digest, if nothing else is left."""
        return next(iter(self.nodes.values()))[0].hex() if len(self.nodes) == 1 else None


class Paths:
    """The nodes above a chunk's leaves and their siblings, out of the leaves and of the nodes beside the paths."""

    def __init__(self, groups: int, leaves: dict[tuple[int, int], tuple[bytes, int]], beside: dict[Key, tuple[bytes, int]]):
        self.groups = groups
        self.size = {t: n for (t, _), (_, n) in leaves.items()} | {TOP: groups}
        self.digest = {k: d for k, (d, _) in beside.items()} | {(t, 0, i): d for (t, i), (d, _) in leaves.items()}
        self.above: dict[Key, bytes] = {}
        for tree in sorted(self.size, reverse=True):  # the top tree last, when the groups' roots are there
            level, at = 0, sorted({i for t, i in leaves if t == tree}) if tree != TOP else sorted({t for t, _ in leaves})
            n = self.size[tree]
            while n > 1:
                at = sorted({i // ARITY for i in at})
                for i in at:
                    self.digest[tree, level + 1, i] = joined(*(self.digest[tree, level, j] for j in range(i * ARITY, min((i + 1) * ARITY, n))))
                level, n = level + 1, -(-n // ARITY)
            if tree != TOP:
                self.digest[TOP, 0, tree] = self.digest[tree, level, 0]

    def siblings(self, tree: int, level: int, i: int) -> tuple[list[bytes], list[bytes]]:
        a, n = i - i % ARITY, width(self.size[tree], level)
        return [self.digest[tree, level, j] for j in range(a, i)], [self.digest[tree, level, j] for j in range(i + 1, min(a + ARITY, n))]

    def up(self, tree: int, level: int, i: int) -> Key | None:
        if width(self.size[tree], level) > 1:
            return tree, level + 1, i // ARITY
        return None if tree == TOP else (TOP, 0, tree)

    def suffix(self, key: Key) -> bytes:
        """Hex text of the siblings of key and of all that lie above it, in order; remembered above the leaves."""
        if key in self.above:
            return self.above[key]
        before, after = self.siblings(*key)
        up = self.up(*key)
        out = "".join(d.hex() for d in before + after).encode() + (self.suffix(up) if up else b"")
        if key[1] or key[0] == TOP:
            self.above[key] = out
        return out

    def fold(self, tree: int, i: int, digest: bytes) -> bytes:
        """The root that a leaf and the siblings beside its path give."""
        key: Key | None = (tree, 0, i)
        while True:
            if width(self.size[key[0]], key[1]) > 1:
                before, after = self.siblings(*key)
                digest = joined(*before, digest, *after)
            key = self.up(*key)
            if key is None:
                return digest

    def subroot(self, tree: int) -> bytes:
        return self.digest[TOP, 0, tree]


def leaf(*columns: Column) -> Column:
    """Digest (binary) of a row: sha256 of each value's UTF-8 byte count, a colon and the value; - for null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*(one(c.cast("string")) for c in columns)).cast("binary"), 256))


def _fragment(groups: int):
    def f(rows: pd.DataFrame) -> pd.DataFrame:
        nodes = {(int(t), 0, int(i)): (d, int(n)) for t, i, n, d in zip(rows["tree"], rows["i"], rows["n"], rows["leaf"], strict=True)}
        return pd.DataFrame({"k": [rows["chunk"].iloc[0]], "nodes": [pickle.dumps(Forest(groups, nodes).settled().nodes)]})

    return f


def _sum(groups: int, nodes) -> Forest:
    """Of neighbouring fragments, in order."""
    out = Forest(groups)
    for x in nodes:
        out = out + Forest(groups, pickle.loads(x))
    return out


def _beside(groups: int):
    """For each of some neighbouring fragments: what lies before and after it, given what lies before and after all of them."""

    def f(rows: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        each = [pickle.loads(x) for x in rows["nodes"]]
        before, after = (Forest(groups, pickle.loads(outer[c].iloc[0]) if len(outer) else {}) for c in ("before", "after"))
        left, right = [], []
        for x in each:
            left.append(before)
            before = before + Forest(groups, dict(x))
        for x in reversed(each):
            right.append(after)
            after = after + Forest(groups, dict(x))
        return pd.DataFrame({"k": rows["k"], "before": [pickle.dumps(x.nodes) for x in left], "after": [pickle.dumps(x.nodes) for x in reversed(right)]})

    return f


def scan(fragments: DataFrame, groups: int, n: int) -> DataFrame:
    """(k, before, after) of fragments (k, nodes), k from 0 to n - 1: the merged fragments below and above k. FAN neighbours at a time are merged, and the merged ones scanned likewise, so that no task sees more than FAN."""
    kind, shape = "k long, nodes binary", "k long, before binary, after binary"
    part = F.floor(F.col("k") / FAN).alias("part")
    if n > FAN:
        whole = fragments.groupBy(part).applyInPandas(lambda x: pd.DataFrame({"k": [x["k"].iloc[0] // FAN], "nodes": [pickle.dumps(_sum(groups, x.sort_values("k")["nodes"]).nodes)]}), kind)
        outer = scan(written(whole, "fragments"), groups, -(-n // FAN))
    else:
        outer = fragments.sparkSession.createDataFrame([], shape)
    return fragments.groupBy(part).cogroup(outer.groupBy(F.col("k"))).applyInPandas(_beside(groups), shape)


def _proofs(groups: int, root: str):
    def f(rows: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        leaves = {(int(t), int(i)): (d, int(n)) for t, i, n, d in zip(rows["tree"], rows["i"], rows["n"], rows["leaf"], strict=True)}
        paths = Paths(groups, leaves, pickle.loads(around["before"].iloc[0]) | pickle.loads(around["after"].iloc[0]))
        out = []
        for row, tree, i, d, other in zip(rows["row"], rows["tree"], rows["i"], rows["leaf"], rows["altered"], strict=True):
            folded = paths.fold(tree, i, d if other is None else other).hex()
            out.append((row, d.hex(), paths.subroot(tree).hex(), root, hashlib.sha256(paths.suffix((tree, 0, i))).hexdigest(), folded, folded == root))
        return pd.DataFrame(out, columns=["row", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return f


def indexed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """(rows, groups, number of rows) of written leaves (row, group, key, leaf, altered, salt): with tree (the group's rank), i (the row's place in its group by key, then leaf), n (the group's rows) and chunk (CHUNK rows that follow each other).

    One range sort; the driver sees some numbers a partition.
    """
    order = [F.col("group").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf"), F.xxhash64("salt"), F.col("salt")]
    at = F.col("at")
    dealt = leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(dealt.withColumns({"part": F.shiftright(at, 33), "at": at.bitwiseAND(F.lit((1 << 33) - 1))}).drop("salt", "key"), "leaves")

    # a group's rows in a part of the sort: at most parts + groups rows; a group begins in the first of its parts
    runs = written(placed.groupBy("part", "group").agg(F.count("*").alias("size"), F.min("at").alias("first")), "runs")
    begins = runs.groupBy("group").agg(F.min("part").alias("part"), F.sum("size").alias("n"), F.min_by("first", "part").alias("first"))
    begun = {r["part"]: r["groups"] for r in begins.groupBy("part").agg(F.count("*").alias("groups")).collect()}
    sums, total, groups = [], 0, 0
    for part, size in sorted(tuple(r) for r in runs.groupBy("part").agg(F.sum("size")).collect()):
        sums.append((part, total, groups))
        total, groups = total + size, groups + begun.get(part, 0)
    parts = leaves.sparkSession.createDataFrame(sums, "part long, rows_before long, groups_before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first"))
    trees = begins.join(parts, "part").select(F.col("group").alias("g"), (F.col("rows_before") + F.col("first")).alias("start"), "n", (F.col("groups_before") + rank - 1).alias("tree"))
    known = runs.join(parts, "part").join(trees, F.col("group").eqNullSafe(F.col("g"))).select(F.col("part").alias("p"), "g", "rows_before", "start", "n", "tree")
    place = F.col("rows_before") + at
    rows = placed.join(known, (F.col("part") == F.col("p")) & F.col("group").eqNullSafe(F.col("g")))
    return rows.select("row", "leaf", "altered", "tree", (place - F.col("start")).alias("i"), "n", F.floor(place / CHUNK).alias("chunk")), groups, total


def proofs(rows: DataFrame, digest: Column, altered: Column, group: str = "lang", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row: the columns `keep`, then leaf, subroot, root, proof_sha256, folded_root and verified.

    Rows are the leaves of their group's tree in the order of key, nulls first; ties
    by digest, equal rows in any order, as they make the same tree. Groups follow
    each other bytewise, null first; a group may hold any share of the rows, and
    there may be any number of groups. digest: a leaf; altered: another digest that
    the row's siblings are to be folded with, null: its own. Nulls are allowed in
    every column; texts of any length are hashed in the JVM and not shuffled. No
    rows: no rows. `keep` must not name one of the new columns.
    """
    spark = rows.sparkSession
    base = rows.select(F.struct(*(F.col(quoted(c)) for c in keep)).alias("row"), F.col(quoted(group)).cast("string").alias("group"), F.col(quoted(key)).cast("long").alias("key"), digest.alias("leaf"), altered.alias("altered"))
    leaves = written(base.withColumn("salt", F.monotonically_increasing_id()), "digests")
    tree, groups, total = indexed(leaves)
    columns = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not total:
        return leaves.select("row.*", *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in columns.split(", ")))
    fragments = written(tree.groupBy("chunk").applyInPandas(_fragment(groups), "k long, nodes binary"), "fragments")
    root = fragments.rdd.map(lambda r: Forest(groups, pickle.loads(r["nodes"]))).treeReduce(lambda a, b: a + b, depth=3).root()
    around = scan(fragments, groups, -(-total // CHUNK))
    out = tree.groupBy("chunk").cogroup(around.groupBy("k")).applyInPandas(_proofs(groups, root), f"row {leaves.schema['row'].dataType.simpleString()}, {columns}")
    return out.select("row.*", *(c.split()[0] for c in columns.split(", ")))
