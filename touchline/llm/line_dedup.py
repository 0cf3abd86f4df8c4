"""Duplicate and nearly equal lines: repeats by a count, near ones by a segment-partition edit join.

Equal lines are found by their 128-bit hash (node and twin), whatever their length. For the join, a line of length n is cut into MOST + 1 segments; a line within MOST edits of it
holds one of them unchanged, near its place. Each line is indexed by its own
segments and probes the segments of all lengths from n - MOST to n, at the few
places where a match can be part of an alignment. What meets is verified by a
banded bit-parallel edit distance. Lines that few others meet are verified as
pairs; a segment that many lines share is handled in pairs of blocks. No links
leave a task, only the lines that have a verified neighbour of an earlier place.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jaccard import LAST, _allowed, _blocks, _keyed, runs, with_rows
from .text import WORD, pieces, written

#: Most edits between nearly equal lines; least code points of a line that is compared at all, and of one that can be nearly equal to another (2 edits make a short line a different one).
MOST, LEAST, NEAR = 2, 1, 32
#: A segment that index and probes meet in more pairs than this goes by blocks.
FEW = 64
#: Rows of one segment that a task holds before it sends them on to the blocks; lines that a task remembers to have seen.
HELD, SEEN = 4096, 200_000
LINE = ["node", "twin"]


def segment(length: Column, i: int) -> tuple[Column, Column]:
    """Start (from 1) and size of the i-th of MOST + 1 even segments; the last ones are longer."""
    k = MOST + 1
    base, more = F.floor(length / k), length % k
    long = F.greatest(F.lit(0), i - (k - more))
    return (i * base + long + 1).cast("int"), (base + F.when(F.lit(i) >= k - more, 1).otherwise(0)).cast("int")


def keys(line: Column, length: Column) -> tuple[Column, list[bool]]:
    """The keys of a line's segments and probes, and which of them are its own segments."""
    out, own = [], []
    for less in range(MOST + 1):
        for i in range(MOST + 1):
            start, size = segment(length - less, i)
            low, high = max(-i, less - (MOST - i)), min(i, less + MOST - i)
            for off in range(low, high + 1):
                out.append(F.xxhash64(F.lit(i), (length - less).cast("int"), F.substring(line, start + off, size)))
                own.append(less == 0 and off == 0)
    return F.array(*out), own


#: Code points of the pairs of lines whose distances a task works out at once.
AT_ONCE = 1_000_000


def edits(pairs: list[tuple[str, str]], most: int = MOST) -> np.ndarray:
    """Edit distances, most + 1 for any above most: bit vectors of the band around the diagonal, many pairs at once."""
    return np.concatenate([_edits(pairs[a:b], most) for a, b in pieces([len(x) + len(y) for x, y in pairs], AT_ONCE)] or [np.zeros(0, np.int64)])


def _edits(pairs: list[tuple[str, str]], most: int) -> np.ndarray:
    out = np.zeros(len(pairs), np.int64)
    rest = []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most:
            out[k] = most + 1
            continue
        x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        n = min(len(x), len(y))
        d = np.flatnonzero(x[:n] != y[:n])
        p = int(d[0]) if len(d) else n
        d = np.flatnonzero(x[len(x) - n + p :][::-1] != y[len(y) - n + p :][::-1]) if n > p else []
        q = int(d[0]) if len(d) else n - p
        x, y = x[p : len(x) - q], y[p : len(y) - q]
        if min(len(x), len(y)) <= most:
            out[k] = min(most + 1, _small(x.tolist(), y.tolist()))
        else:
            rest.append((k, x.copy(), y.copy()))
    rest.sort(key=lambda r: len(r[1]))
    for a, b in pieces([len(r[1]) + 64 for r in rest], AT_ONCE):
        some = rest[a:b]
        out[[r[0] for r in some]] = _banded([r[1] for r in some], [r[2] for r in some], most)
    return out


def _small(x: list[int], y: list[int]) -> int:
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _banded(xs: list[np.ndarray], ys: list[np.ndarray], most: int) -> np.ndarray:
    """Bit 63 - most + d of a step's vectors is the cell d off the diagonal."""
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    a = np.full((int(n.max()) + 2 * most + 1 + int(max(0, (m - n).max())), len(xs)), 0xFFFFFFFF, np.uint32)
    b = np.full((int(m.max()), len(xs)), 0xFFFFFFFE, np.uint32)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        a[most : most + len(x), k] = x
        b[: len(y), k] = y
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    up = np.full(len(xs), (0xFFFFFFFFFFFFFFFF << (63 - most)) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    down = np.zeros(len(xs), np.uint64)
    dist = np.full(len(xs), most, np.int64)
    across = np.full(len(xs), 1 << 62, np.uint64)
    for i in range(len(b)):
        match = np.zeros(len(xs), np.uint64)
        for d in range(2 * most + 1):
            if i + d < len(a):
                match |= (a[i + d] == b[i]).astype(np.uint64) << np.uint64(63 - 2 * most + d)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (~(diagonal | up) & full), diagonal & up
        live, steep = i < m, i < n - most
        dist += np.where(live & steep, (diagonal >> np.uint64(63)) == 0, 0)
        flat = live & ~steep
        dist += np.where(flat, ((right & across) != 0).astype(np.int64) - ((left & across) != 0), 0)
        across = np.where(flat, across >> one, across)
        up, down = left | (~((diagonal >> one) | right) & full), (diagonal >> one) & right
    return np.minimum(dist, most + 1)


def lines_of(docs: DataFrame) -> DataFrame:
    """did, hash, pos, node and twin (the line's hashes), length, line of the lines that are compared: those with a word, and blank ones of NEAR code points or more."""
    df = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("did", "hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return df.select("did", "hash", "pos", F.xxhash64("line").alias("node"), F.xxhash64(F.lit(1), "line").alias("twin"), F.char_length("line").alias("length"), "line").where((F.col("length") >= NEAR) | (F.col("length") >= LEAST) & F.col("line").rlike(WORD.pattern))


def _spread(own: list[bool]):
    """Each line's keys as rows, a line once a task (as far as SEEN are remembered)."""
    flags = np.array(own)

    def spread(frames):
        seen: set[bytes] = set()
        for pdf in frames:
            raw = pdf[LINE].to_numpy().tobytes()
            new = []
            for k in range(0, len(raw), 16):
                x = raw[k : k + 16]
                if x not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(x)
                    new.append(k // 16)
            if new:
                some = pdf.iloc[new]
                yield pd.DataFrame({"key": np.concatenate(some["keys"].to_numpy()), **{c: np.repeat(some[c].to_numpy(), len(flags)) for c in LINE}, "own": np.tile(flags, len(some))})

    return spread


MET = "key long, a long, a2 long, b long, b2 long"


def _pairs(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: pd.array([r[i] for r in rows], "Int64") for i, c in enumerate(MET.split(", "))})


def _met(frames):
    """Rows (key, a, b) of two lines that meet; b is null: a line under a key of many. A key's rows are held as far as HELD, what is more goes on at once."""
    held: list[list[np.ndarray]] = []
    key, size, flooded = None, 0, False

    def many():
        return _pairs([(int(k), int(n), int(t), None, None) for part in held for k, n, t in zip(*part[:3])])

    def whole():
        return _meetings(*map(np.concatenate, zip(*held)))

    for pdf in frames:
        cols = [pdf[c].to_numpy() for c in ("key", *LINE, "own")]
        if not len(pdf):
            continue
        cut = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        at = 0
        if key is not None and key == cols[0][0]:
            at = int(cut[0]) if len(cut) else len(pdf)
            held.append([c[:at] for c in cols])
            size += at
            flooded = flooded or size > HELD
            if flooded:
                yield many()
                held = []
        if at < len(pdf):
            if held:
                yield whole()
            last = int(cut[-1]) if len(cut) else 0
            yield _meetings(*(c[at:last] for c in cols))
            held, key, size, flooded = [[c[last:] for c in cols]], cols[0][-1], len(pdf) - last, False
    if held:
        yield whole()


def _meetings(k: np.ndarray, n: np.ndarray, t: np.ndarray, o: np.ndarray) -> pd.DataFrame:
    rows: list[tuple] = []
    if len(k):
        edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        size = np.diff(np.append(edge, len(k)))
        for a, s in zip(edge[size > 1].tolist(), size[size > 1].tolist()):
            each = list(zip(n[a : a + s].tolist(), t[a : a + s].tolist()))
            all_ = set(each)
            if len(all_) < 2:
                continue
            own = {x for x, mine in zip(each, o[a : a + s].tolist()) if mine}
            if not own:
                continue
            if len(own) * len(all_) <= FEW:
                rows += {(int(k[a]), *min(x, y), *max(x, y)) for x in own for y in all_ if x != y}
            else:
                rows += [(int(k[a]), *x, None, None) for x in all_]
    return _pairs(rows)


def _close(frames):
    """The later line of each pair within MOST edits."""
    for pdf in frames:
        ok = edits(list(zip(pdf["x"], pdf["y"], strict=True))) <= MOST if len(pdf) else np.zeros(0, bool)
        yield pdf.loc[ok, LINE].drop_duplicates()


def _block(frames):
    """The lines of each pair of blocks that have an earlier line within MOST edits. Lines whose counts of letters differ too much need no distance; a line is done at its first neighbour."""
    for (_, i, j), g in runs(frames, ["key", "i", "j"]):
        if len(g["node"]) < 2:
            continue
        order = np.lexsort((g["pos"], g["hash"], g["did"]))
        text, n, twin, own = g["line"][order], g["node"][order], g["twin"][order], g["own"][order]
        length = np.array([len(t) for t in text])
        pairs = np.tril(_allowed(own, i, j)) & (np.abs(length[:, None] - length[None, :]) <= MOST)
        counts = np.zeros((len(n), 64), np.int32)
        for r, t in enumerate(text):
            counts[r] = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) % 64, minlength=64)
        later = np.zeros(len(n), bool)
        for r in range(len(n)):
            c = np.flatnonzero(pairs[r])
            c = c[np.abs(counts[c] - counts[r]).sum(1) <= 2 * MOST]
            for a, b in ((0, 4), (4, 32), (32, len(c))):
                if len(c[a:b]) and (edits([(text[r], text[x]) for x in c[a:b]]) <= MOST).any():
                    later[r] = True
                    break
        yield pd.DataFrame({"node": n[later], "twin": twin[later]})


def later(lines: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, twin): the lines that have another line within MOST edits of them whose first place (in seen) is earlier than theirs."""
    k, own = keys(F.col("line"), F.col("length"))
    spread = lines.select(*LINE, k.alias("keys")).mapInPandas(_spread(own), "key long, node long, twin long, own boolean")
    met = written(spread.repartition("key").sortWithinPartitions("key").mapInPandas(_met, MET), "met")
    pairs, many = met.where("b is not null").drop("key").distinct(), met.where("b is null").select("key", F.col("a").alias("node"), F.col("a2").alias("twin")).distinct()
    nodes = pairs.select(F.col("a").alias("node"), F.col("a2").alias("twin")).union(pairs.select("b", "b2")).union(many.select(*LINE)).distinct()
    place = ["did", "hash", "pos"]
    text = written(lines.select(*LINE, "line", *place).join(seen.join(nodes, LINE).select(*LINE, *place), [*LINE, *place]).dropDuplicates(LINE).select(*LINE, "line", *place), "lines")
    left, right = (text.select(F.col("node").alias(c), F.col("twin").alias(f"{c}2"), F.col("line").alias(t), F.struct(*place).alias(f"{c}_at")) for c, t in (("a", "x"), ("b", "y")))
    met_at = pairs.join(left, ["a", "a2"]).join(right, ["b", "b2"])
    second = F.col("a_at") < F.col("b_at")
    close = met_at.select(*(F.when(second, F.col(b)).otherwise(F.col(a)).alias(c) for c, a, b in (("node", "a", "b"), ("twin", "a2", "b2"))), "x", "y").mapInPandas(_close, "node long, twin long")
    sized = many.join(many.groupBy("key").agg(F.count("*").alias("members")), "key")
    dealt = _blocks(sized, "members").join(text, LINE).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", *LINE, "own", "line", *place)
    return close.union(dealt.mapInPandas(_block, "node long, twin long")).distinct()


def firsts(lines: DataFrame) -> DataFrame:
    """The first occurrence of each line: least doc_id, then least position."""
    return lines.groupBy(*LINE).agg(F.count("*").alias("n"), F.min(F.struct("did", "hash", "pos")).alias("at")).select(*LINE, "n", "at.did", "at.hash", "at.pos")


def removed(docs: DataFrame) -> DataFrame:
    """(did, hash, removed): the positions of each document's lines that a line of an earlier place equals or nearly equals.

    The earlier line is itself within MOST edits, whether it is removed or not;
    links are not followed further.
    """
    lines = lines_of(docs)
    seen = written(firsts(lines), "seen")
    near = later(lines.where(F.col("length") >= NEAR), seen).withColumn("near", F.lit(True))
    of = seen.join(near, LINE, "left").withColumn("near", F.coalesce("near", F.lit(False))).where("near or n > 1")
    doubled = written(of.select(*LINE, "near", F.struct("did", "hash", "pos").alias("first")), "doubled")
    return lines.select(*LINE, "did", "hash", "pos").join(doubled, LINE).where(F.col("near") | (F.struct("did", "hash", "pos") != F.col("first"))).groupBy("did", "hash").agg(F.array_sort(F.collect_set("pos")).alias("removed"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_lines, n_removed, removed (their positions from 0, joined by commas).

    Lines without a word are left alone if they have fewer than NEAR code points;
    of other lines below NEAR only exact repeats are removed. Null or empty text: one
    empty line. Rows of equal id and text have the same lines and so the same
    result; null ids come last. No rows: none.
    """
    rows = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("did", "hash", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    out = rows.join(removed(docs), ["did", "hash"], "left")
    return out.select(F.when(F.col("did") != LAST, F.col("did")).alias("doc_id"), "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with its columns, whatever their names, each text without its removed lines; n_chars, where there is one, follows. A text may become empty; null stays null. No rows: none."""
    out = with_rows(docs).join(removed(docs), ["did", "hash"], "left")
    row, whole = F.col("_row"), F.col("removed").isNull()
    text = F.when(whole, row["text"]).otherwise(F.array_join(F.filter(F.split(row["text"].cast("string"), "\n", -1), lambda x, i: ~F.array_contains("removed", i)), "\n"))
    new = row.withField("text", text.cast(docs.schema["text"].dataType))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(whole, row["n_chars"]).otherwise(F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(new.alias("_row")).select("_row.*")
