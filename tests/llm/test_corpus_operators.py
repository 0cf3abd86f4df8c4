"""Operators over whole corpora against plain brute force on small fixtures."""

import math
import random
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers

from touchline.llm import bpe, crf, decontaminate, hmm, jaccard, line_dedup, quality_rules, secret_scan, sharding
from touchline.llm.text import components, crc_mod

R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgh") for _ in range(R.randrange(2, 8))) for _ in range(900)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, did string, root long, key int"


def prose(n):
    return [R.choice(VOCAB) for _ in range(n)]


def frame(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), "x", "y", 1, 2) for i, t in pairs], SCHEMA)


def edited(ws, n):
    ws = list(ws)
    for _ in range(n):
        ws[R.randrange(len(ws))] = R.choice(VOCAB)
    return ws


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies of several degrees, shared lines, short, empty and null texts, a long text."""
    texts = [None, "", "", "one two", "one two", "one three", " \n "]
    for size in (60, 120, 300):
        base = prose(size)
        texts += [" ".join(edited(base, k)) for k in (0, 0, 1, 2, 4, 8, 15)]
    hot = " ".join(prose(80))
    texts += [hot + "\n" + " ".join(prose(90)) for _ in range(12)]
    texts += [" ".join(prose(20)) + "\n" + hot + "x" * k for k in range(4)]
    texts += [" ".join(prose(6000)), hot, "é" * 40 + "\nab", "é" * 41 + "\nab"]
    rows = list(enumerate(texts)) + [(None, hot), (9, texts[9])]
    return frame(spark, rows)


def find_classes(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if linked(a, b):
                ra, rb = root[a], root[b]
                root = [min(ra, rb) if r in (ra, rb) else r for r in root]
    return root


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 6000 + i) for i in range(200)] + [(7, 7), (None, 3)]
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        ra, rb = root.setdefault(a, a), root.setdefault(b, b)
        root = {k: min(ra, rb) if v in (ra, rb) else v for k, v in root.items()}
    assert got == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(corpus):
    rows = corpus.select("doc_id", "text").collect()

    def runs(t):
        w = (t or "").split()
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = [runs(r.text) for r in rows]
    linked = lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    root = find_classes(len(rows), linked)
    least = {}
    for r, k in zip(rows, root, strict=True):
        if r.doc_id is not None:
            least[k] = min(least.get(k, 1 << 60), r.doc_id)
    want = sorted((-1 if r.doc_id is None else r.doc_id, least.get(k, -1), sum(linked(i, j) for j in range(len(rows)) if j != i)) for i, (r, k) in enumerate(zip(rows, root, strict=True)))
    got = sorted((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in jaccard.jaccard_join(corpus).collect())
    assert got == want
    kept = jaccard.first_of_each(corpus)
    assert kept.columns == corpus.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_jaccard_large_group_goes_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = prose(200)
    docs = frame(spark, [(i, " ".join(edited(base, i % 4))) for i in range(60)])
    got = {r.doc_id: r for r in jaccard.jaccard_join(docs).collect()}
    sets = {r.doc_id: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for r in docs.collect() for w in [r.text.split()]}
    for i in sets:
        assert got[i].n_links == sum(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in sets if j != i)
    assert jaccard.jaccard_join(docs.limit(0)).count() == 0


def test_recall_is_estimated_from_what_was_found():
    none = np.zeros(81)
    for d in range(1, 6):
        assert jaccard.recall(none, 0.8, d) == pytest.approx(1 - (1 - 0.8**d) ** jaccard.TREES)
    copies, edge = none.copy(), none.copy()
    copies[80], edge[64] = 1e6, 1e6
    assert jaccard.recall(copies, 0.8, 5) >= jaccard.TARGET > jaccard.recall(edge, 0.8, 5)
    assert jaccard.recall(edge, 0.8, 5) == pytest.approx(1 - (1 - 0.8**5) ** jaccard.TREES, abs=1e-5)


def test_paths_climb_to_the_prefix_they_share():
    import pandas as pd

    r = np.random.default_rng(4)
    rows = sorted((int(r.integers(3)), tuple(r.integers(0, 3, jaccard.DEEPEST).tolist()), i) for i in range(300))
    pdf = pd.DataFrame({"tree": [x[0] for x in rows], "path": [np.array(x[1], ">u4").tobytes() for x in rows], "node": [x[2] for x in rows]})
    got = {x.node: x.common for k in (1, 7, 300) for f in [jaccard._climbed([pdf.iloc[i : i + k] for i in range(0, 300, k)])] for x in pd.concat(list(f)).itertuples()}
    for i, (t, path, n) in enumerate(rows):
        near = [next((k for k in range(jaccard.DEEPEST) if rows[j][1][k] != path[k]), jaccard.DEEPEST) if rows[j][0] == t else 0 for j in (i - 1, i + 1) if 0 <= j < 300]
        assert got.get(n, 0) == (jaccard.DEEPEST if i in (0, 299) else max(near))


@pytest.mark.parametrize("target", [0.9999, 0.0])
def test_prefixes_are_shortened_until_the_target(spark, target, monkeypatch):
    """With a low target the deepest prefix is enough; else the walk goes on, and nearly all pairs meet."""
    import pandas as pd

    depths = []
    monkeypatch.setattr(jaccard, "_rough", lambda d, s, f=jaccard._rough: depths.append(d) or f(d, s))
    r = np.random.default_rng(9)
    sets = {}
    for k in range(60):
        base = r.integers(0, 1 << 62, 200).astype(np.uint64)
        for j in range(2):  # 178 / 222 = 0.802
            sets[2 * k + j] = np.unique(np.concatenate([base[:178], r.integers(0, 1 << 62, 22).astype(np.uint64)]))
    g = {n: jaccard.signature(s) for n, s in sets.items()}
    rows = [(n, (x & np.uint64(255)).astype(np.uint8).tobytes(), [x.astype(">u4").tobytes()[k : k + 20] for k in range(0, 320, 20)]) for n, x in g.items()]
    nodes = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "sig", "paths"]), "node long, sig binary, paths array<binary>")
    met = {(min(x.a, x.b), max(x.a, x.b)) for x in jaccard.candidates(nodes, 0.8, target).collect()}
    assert depths == ([5] if not target else [5, 4])
    assert met <= {(2 * k, 2 * k + 1) for k in range(60)} and len(met) >= (45 if not target else 58)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_bit_parallel_distance():
    r = random.Random(1)
    pairs = []
    for _ in range(600):
        a = "".join(r.choice("abcé") for _ in range(r.randrange(80)))
        b = list(a)
        for _ in range(r.randrange(5)):
            i = r.randrange(len(b) + 1)
            b[i : i + r.randrange(2)] = r.choice(["", "a", "b"])
        pairs.append((a, "".join(b)))
    for most in (1, 2, 3):
        assert line_dedup.edits(pairs, most).tolist() == [min(most + 1, distance(a, b)) for a, b in pairs]


def brute_lines(rows):
    """Positions of removed lines by (doc_id, text)."""
    at = sorted({(1 << 63 if i is None else i, t or "", p, x) for i, t in rows for p, x in enumerate((t or "").split("\n")) if len(x) >= line_dedup.LEAST}, key=lambda x: (x[0], x[2]))
    lines = sorted({x[3] for x in at})
    root = find_classes(len(lines), lambda a, b: abs(len(lines[a]) - len(lines[b])) <= 2 and distance(lines[a], lines[b]) <= 2 if len(lines[a]) < 2000 else False)
    of, seen, gone = dict(zip(lines, root, strict=True)), set(), {}
    for i, t, p, x in at:
        if of[x] in seen:
            gone.setdefault((i, t), []).append(p)
        seen.add(of[x])
    return gone


@pytest.mark.parametrize("few", [64, 0])
def test_line_dedup(spark, monkeypatch, few):
    """few = 0: every meeting goes by blocks."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    r = random.Random(8)
    base = ["".join(r.choice("abcdef ") for _ in range(r.randrange(33, 60))) for _ in range(8)]

    def line():
        x = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 3, 6])):
            k = r.randrange(len(x))
            x[k : k + r.randrange(2)] = r.choice(["", "q", "z"])
        return "".join(x)

    rows = [(i, "\n".join([line() for _ in range(r.randrange(1, 5))] + (["short"] if i % 2 else []))) for i in range(40)] + [(None, base[0]), (90, None), (91, ""), (92, base[1] + "\n" + base[1])]
    rows.append(rows[3])
    docs = frame(spark, rows)
    gone = brute_lines(rows)
    want = sorted((1 << 63 if i is None else i, len((t or "").split("\n")), ",".join(map(str, gone.get((1 << 63 if i is None else i, t or ""), [])))) for i, t in rows)
    got = sorted((1 << 63 if x.doc_id is None else x.doc_id, x.n_lines, x.removed) for x in line_dedup.line_dedup(docs).collect())
    assert got == want
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts = {x.doc_id: x for x in out.collect()}
    assert texts[90].text is None and texts[92].n_chars == len(texts[92].text)


def test_short_lines_that_repeat_are_removed(spark):
    """Within and across documents, down to one code point; blank lines and nearly equal short ones stay."""
    rows = [(1, "Released under the MIT License.\n}\n\n \n}"), (2, "a\nReleased under the MIT License.\n\n \nReleased under the MIT Licence."), (3, "}\nb\na")]
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: "4", 2: "1", 3: "0,2"}
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(frame(spark, rows)).collect()}[3] == "b"


@pytest.mark.parametrize("few", [64, 0])
def test_a_line_goes_only_for_an_earlier_line_near_it(spark, monkeypatch, few):
    """b lies between a and c, but comes after both: c has no earlier line near it. d follows b and is near it only."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(jaccard, "BLOCK", 2)
    a, tail = "the quick brown fox jumps over the lazy dog 0000", "abcdefgh"
    b, c, d = a[:-2] + "11", "XX" + a[2:-2] + "11", a[:4] + "YY" + a[6:-2] + "11"
    rows = [(1, a), (2, c), (3, b), (4, d), (5, tail * 5), (6, "zz" + tail * 5)]
    got = {r.doc_id: r.removed for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got == {1: "", 2: "", 3: "0", 4: "0", 5: "", 6: "0"}


def test_line_dedup_empty(spark):
    docs = frame(spark, [])
    assert line_dedup.line_dedup(docs).count() == 0 and line_dedup.without_repeats(docs).count() == 0


def test_decontamination(spark):
    items = [(i, " ".join(prose(25)) + ". " + " ".join(prose(8)) + ".") for i in range(30)] + [(None, "What is it now. " + " ".join(prose(12))), (77, None), (78, ""), (79, "...")]
    clean = [(100 + i, " ".join(prose(400))) for i in range(30)]
    held = [(i, " ".join(prose(R.randrange(200))) + " " + items[i][1].upper() + " " + " ".join(prose(150))) for i in range(30)]
    half = [(200 + i, items[i][1].split(".")[0] + " " + " ".join(prose(60))) for i in range(10)]
    docs = frame(spark, clean + held + half + [(300, None), (301, ""), (None, items[30][1]), held[0]])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, bench)
    found = Counter((r.doc_id, r.item_id) for r in got.collect())
    assert found == Counter([(i, i) for i in range(30)] + [(None, None), (0, 0)])
    assert {r.doc_id for r in decontaminate.without_leaks(docs, bench).collect()} == {100 + i for i in range(30)} | {200 + i for i in range(10)} | {300, 301}
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_wand_is_exact(spark, monkeypatch):
    """Every passage and item at or above the threshold, and no other, with items in several shards."""
    monkeypatch.setattr(decontaminate, "SHARD", 16)
    items = [" ".join(prose(20)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    shards = [decontaminate.shard(f) for f in decontaminate.index(bench)]
    assert len(shards) > 1 and sorted(int(i) for s in shards for i in s.ids) == list(range(40))
    df = Counter(w for t in items for w in set(t.split()))
    mean = sum(len(t.split()) for t in items) / 40

    def impact(t):
        c = Counter(t.split())
        own = {w: math.log1p((40 - df[w] + 0.5) / (df[w] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(t.split()) / mean)) for w, n in c.items()}
        return {w: v / sum(own.values()) for w, v in own.items()}

    for i in range(40):
        ws = set(R.sample(items[i].split(), R.randrange(6, 20)) + prose(40))
        want = {k for k, t in enumerate(items) if sum(v for w, v in impact(t).items() if w in ws) >= decontaminate.SCORE}
        got = {int(s.ids[k]) for s in shards for b in range(s.best.shape[1]) for k, _ in s.wand([s.term[w] for w in ws if w in s.term], b)}
        assert got == want


def test_long_texts_and_items(spark):
    """A long item has passages of its own length; a text of very many words is searched whole."""
    long, short = " ".join(prose(300)) + ". " + " ".join(prose(40)) + ".", " ".join(prose(25)) + ". " + " ".join(prose(8)) + "."
    bench = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    assert sorted(decontaminate.shard(f).half for f in decontaminate.index(bench)) == [64, 512]
    filler = " ".join(prose(60_000))
    docs = frame(spark, [(1, filler + " " + long), (2, short + " " + filler), (3, filler), (4, " ".join(prose(70)) + " " + short)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {(1, 1), (2, 2), (4, 2)}


def test_names_that_clash(spark):
    """Columns of any name stay as they are, in operators that give the documents back."""
    names = ["n_words", "symbols", "kept", "_leaks", "leaks", "_r", "a.b", "_row", "_m", "stratum", "cut_upper", "removed", "hash", "did", "node", "share", "c`d"]
    item = " ".join(prose(20)) + ". " + " ".join(prose(9)) + "."
    rows = [(i, " ".join(prose(80)), "en", None, *([i] * len(names))) for i in range(6)] + [(7, " ".join(prose(70)) + " " + item, None, None, *([7] * len(names))), (8, None, None, None, *([None] * len(names)))]
    schema = ", ".join(["doc_id long", "text string", "lang string", "n_chars long"] + ["`" + n.replace("`", "``") + "` int" for n in names])
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out, ids in (
        (quality_rules.keep_good(docs, labels), {0, 1, 2, 3, 4, 5, 7}),
        (line_dedup.without_repeats(docs), {0, 1, 2, 3, 4, 5, 7, 8}),
        (jaccard.first_of_each(docs), {0, 1, 2, 3, 4, 5, 7, 8}),
        (decontaminate.without_leaks(docs, bench), {0, 1, 2, 3, 4, 5, 8}),
        (bpe.with_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")), {0, 1, 2, 3, 4, 5, 7, 8}),
    ):
        assert out.columns[: len(docs.columns)] == docs.columns
        got = out.collect()
        assert {r.doc_id for r in got} == ids and all(r["a.b"] == r["c`d"] == (None if r.doc_id == 8 else r.doc_id) for r in got)


def test_no_documents(spark):
    docs, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public_tokenizers.path("byte_bpe_50k.json")
    bench = spark.createDataFrame([(1, "what is it. this and that")], "item_id long, text string")
    for out in (decontaminate.leaks(docs, bench), decontaminate.without_leaks(docs, bench), quality_rules.quality_rules(docs, labels), quality_rules.keep_good(docs, labels), crf.quality(docs, labels, crc_mod("doc_id", 5) == 0), hmm.score(docs, crc_mod("doc_id", 10) == 0), bpe.bpe_digest(docs, path), bpe.with_tokens(docs, path), secret_scan.secrets(docs)):
        assert out.count() == 0


def test_vacuum_spares_what_is_being_written(spark, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"))
    t.append(frame(spark, [(1, "a")]))
    run = t._run(frame(spark, [(2, "b")]))  # written, not yet committed
    t.vacuum()
    t._commit(t.manifest(), lambda m: {"schema": m["schema"], "runs": [*m["runs"], run]})
    t._settled(run)
    assert {r.doc_id for r in t.read().collect()} == {1, 2}
    lost = t._run(frame(spark, [(3, "c")]))
    t.vacuum(abandoned_after=-60)
    assert lost["name"] not in dict(t._list(f"{t.path}/data")) and t.read().count() == 2


def test_other_columns_are_refused(spark, tmp_path):
    t = sharding.ShardedTable(spark, str(tmp_path / "t"))
    t.append(frame(spark, [(1, "a")]))
    with pytest.raises(ValueError):
        t.append(frame(spark, [(1, "a")]).withColumn("more", F.lit(1)))
    with pytest.raises(ValueError):
        t.append(frame(spark, [(1, "a")]).withColumn("doc_id", F.col("doc_id").cast("int")))
    assert t.read().count() == 1


def test_commits_are_exclusive(spark, tmp_path):
    """8 writers at once on each of 10 tables: every commit is there, every version can be read."""
    tables = [str(tmp_path / f"t{i}") for i in range(10)]

    def write(job):
        path, who = job
        t = sharding.ShardedTable(spark, path)
        for k in range(3):
            t._commit(t.manifest(), lambda m, k=k: {"schema": m["schema"], "runs": [*m["runs"], {"name": f"{who}-{k}"}]})

    with ThreadPoolExecutor(80) as pool:
        list(pool.map(write, [(path, who) for path in tables for who in range(8)]))
    for path in tables:
        t = sharding.ShardedTable(spark, path)
        assert t.version() == 24 and sorted(r["name"] for r in t.manifest()["runs"]) == sorted(f"{who}-{k}" for who in range(8) for k in range(3))
        assert [len(t.manifest(v)["runs"]) for v in range(1, 25)] == list(range(1, 25))
        assert not [n for n, _ in t._list(f"{path}/manifest") if n.startswith("_")]


def test_appends_at_once(spark, tmp_path):
    def write(i):
        sharding.ShardedTable(spark, str(tmp_path / "t")).append(spark.range(i * 10, i * 10 + 10))

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    assert sorted(r.id for r in sharding.ShardedTable(spark, str(tmp_path / "t")).read().collect()) == list(range(60))


def test_a_store_without_exclusive_names_is_refused(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "EXCLUSIVE", ("hdfs",))
    with pytest.raises(ValueError, match="exclusive"):
        sharding.ShardedTable(spark, str(tmp_path / "t"))


def test_sharding(spark, tmp_path):
    docs = frame(spark, [(i, f"t{i}") for i in range(500)] + [(None, None), (3, "t3")])
    t = sharding.ShardedTable(spark, str(tmp_path / "t"), target_bytes=20_000, fan=3)
    for a in sharding.arrivals(docs, 7):
        t.append(a)
        t.compact()
    m = t.manifest()
    assert Counter(map(tuple, t.read().collect())) == Counter(map(tuple, docs.collect()))
    assert all(sum(t.tier(r) == k for r in m["runs"]) < 3 for k in range(3))
    old = t.version()
    stale = t.manifest()
    assert t.append(docs.limit(2)) == old + 1
    assert t.read(old).count() == docs.count()
    assert t._commit(stale, lambda x: {"schema": x["schema"], "runs": x["runs"]}) == old + 2  # another writer was first
    assert t.read().count() == docs.count() + 2
    t.vacuum()
    assert t.read().count() == docs.count() + 2
    with pytest.raises(ValueError):
        sharding.ShardedTable(spark, str(tmp_path / "none")).read()
    assert sharding.sharded(docs.limit(0)).read().count() == 0


def test_hmm(spark):
    texts = [(i, " ".join(prose(R.randrange(1, 60)))) for i in range(120)] + [(500, None), (501, ""), (None, "A b\x0bc"), (502, "ÀÉ zzz zzz " * 300)]
    docs = frame(spark, texts)
    rows = {r.doc_id: r for r in hmm.score(docs, crc_mod("doc_id", 10) == 0).collect()}
    assert len(rows) == len(texts)
    import zlib

    def toks(t):
        return [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] + [None]

    train = Counter(w for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 10 for w in toks(t))
    n, v = sum(train.values()), len(train)
    for i, t in texts:
        ws, r = toks(t), rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score < 0


def test_forward_equals_enumeration_and_training_helps():
    r = np.random.default_rng(3)
    share = r.dirichlet(np.ones(6))
    m = hmm.HMM(share)
    seqs = [r.integers(0, 6, n).astype(np.uint16) for n in (5, 3, 3, 1)]
    for s, got in zip(seqs, m.forward(seqs), strict=True):
        p = m.start * m.emit[s[0]]
        for x in s[1:]:
            p = (p @ m.move) * m.emit[x]
        assert got == pytest.approx(math.log10(p.sum()))
    start, move, emit = np.zeros(hmm.STATES), np.zeros((hmm.STATES, hmm.STATES)), np.zeros_like(m.emit)
    before = m.expected(seqs, start, move, emit)
    assert start.sum() == pytest.approx(4) and move.sum() == pytest.approx(8) and emit.sum() == pytest.approx(12, rel=1e-5)
    m.start, m.move, m.emit = start / start.sum(), (move + 1e-12) / (move + 1e-12).sum(1)[:, None], (emit + 1e-12) / (emit + 1e-12).sum(0)
    assert m.forward(seqs).sum() >= before


def test_stretches_give_the_counts_of_whole_sequences(monkeypatch):
    """Against the plain recursion over every sequence, one after the other, whatever the length of the stretches."""
    r = np.random.default_rng(8)
    k = hmm.STATES
    m = hmm.HMM(r.dirichlet(np.ones(20)))
    m.move, m.start = r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(k))
    seqs = [r.integers(0, 20, n).astype(np.uint16) for n in (1, 2, 7, 8, 9, 40, 3, 65)]
    start, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit), 0.0
    for s in seqs:
        a = [m.start * m.emit[s[0]]]
        for x in s[1:]:
            a.append((a[-1] @ m.move) * m.emit[x])
        b = [np.ones(k)]
        for x in s[:0:-1]:
            b.insert(0, m.move @ (m.emit[x] * b[0]))
        p = a[-1].sum()
        log += math.log10(p)
        start += a[0] * b[0] / p
        for t, x in enumerate(s):
            emit[x] += a[t] * b[t] / p
            if t:
                move += a[t - 1][:, None] * m.move * (m.emit[x] * b[t])[None, :] / p
    for stretch, batch in ((512, 1_000_000), (8, 1_000_000), (8, 16), (1, 5), (3, 10)):
        monkeypatch.setattr(hmm, "STRETCH", stretch)
        monkeypatch.setattr(hmm, "BATCH", batch)
        got = np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
        assert m.expected(seqs, *got) == pytest.approx(log)
        for x, y in zip(got, (start, move, emit), strict=True):
            assert np.abs(x - y).max() < 1e-4


def test_hmm_scores_by_the_plain_recursion(spark, monkeypatch):
    """The query's score: for every text the forward recursion over its words, each word's chance worked out from the counts."""
    import zlib

    most, models = 40, []
    monkeypatch.setattr(hmm, "trained", lambda *a, f=hmm.trained: models.append(f(*a)) or models[-1])
    texts = [(i, " ".join(VOCAB[int(R.expovariate(0.01)) % 300] for _ in range(R.randrange(1, 50)))) for i in range(80)] + [(500, None), (501, "unseen Words here and here"), (None, "A b")]
    got = {r.doc_id: r.score for r in hmm.score(frame(spark, texts), crc_mod("doc_id", 10) == 0, own=most, frequent=90).collect()}
    toks = lambda t: [w.lower().encode() for w in (t or "").split()]
    train = [toks(t) for i, t in texts if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    count = Counter(w for ws in train for w in ws)
    ranked = sorted(count, key=lambda w: (-count[w], w))
    assert len(ranked) > 100
    own = {w: i for i, w in enumerate(ranked[:most])}
    size, kinds = Counter(), Counter()
    for w in ranked[most:]:
        size[hmm.word_class(w)] += count[w]
        kinds[hmm.word_class(w)] += 1
    m = models[0]
    for i, t in texts:
        p, log = m.start, 0.0
        for w in [*toks(t), None]:
            if w is None:
                e = m.emit[most + hmm.CLASSES]
            elif w in own:
                e = m.emit[own[w]]
            else:
                c = hmm.word_class(w)
                e = m.emit[most + c] * (count[w] + hmm.ALPHA) / (size[c] + hmm.ALPHA * (kinds[c] + 1))
            p = p * e
            log += math.log10(p.sum())
            p = p / p.sum() @ m.move
        assert got[i] == pytest.approx(log), i


def test_frequent_words_and_classes_make_a_distribution():
    import pandas as pd

    words = [f"w{i}".encode() for i in range(50)]
    f = pd.DataFrame({"word": words, "n": np.arange(50, 0, -1), "class": [hmm.word_class(w) for w in words]})
    c = f.groupby("class").agg(total=("n", "sum"), kinds=("n", "size")).reset_index()
    v = hmm.Vocabulary(f, c, int(f["n"].sum()), 50, 4)
    assert v.total == f["n"].sum() + 4 and v.share.sum() == pytest.approx(1)
    assert (v.log_within == 0).all()


def test_crf_marginals_and_quality(spark):
    m = crf.CRF()
    m.emit[:3], m.move[:] = (1.0, -2.0, 0.5), [[0.5, -0.3], [-0.2, 0.7]]
    r = np.random.default_rng(1)
    x, starts = r.normal(size=(7, crf.FEATURES)), np.array([0, 4, 5, 7])
    got, pairs = m.marginals(x, starts)
    z = x @ m.emit
    for a, b in zip(starts, starts[1:]):
        total, good = 0.0, np.zeros(b - a)
        for y in np.ndindex(*[2] * (b - a)):
            w = math.exp(sum(z[a + k] * (v - 0.5) for k, v in enumerate(y)) + sum(m.move[u, v] for u, v in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        assert got[a:b] == pytest.approx(good / total)
    assert pairs.sum() == pytest.approx(4)
    rows = [(i, "\n".join(" ".join(prose(12)) + "." for _ in range(4)) if i % 2 else "\n".join("## $$ " * 9 for _ in range(4))) for i in range(300)] + [(900, None), (901, ""), (None, "x")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(300)] + [(None, 1, 0), (901, None, 0)], "doc_id long, quality int, toxic int")
    got = crf.quality(docs, labels, crc_mod("doc_id", 5) == 0).collect()
    assert len(got) == len(rows) and all(0 <= g.score <= 1 for g in got)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 300]
    assert held and all(g.predicted == g.doc_id % 2 for g in held)
    model = crf.fitted(docs, labels, crc_mod("doc_id", 5) == 0)
    texts = dict(rows)
    for g in got:
        x, size = crf.lines(texts[g.doc_id])
        x = crf.features(x)
        z, total, good = x @ model.emit, 0.0, np.zeros(len(x))
        for y in np.ndindex(*[2] * len(x)):
            w = math.exp(sum(z[k] * (v - 0.5) for k, v in enumerate(y)) + sum(model.move[u, v] for u, v in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        assert g.score == pytest.approx(float((good / total * size).sum() / size.sum()), abs=1e-6)
    alone = crf.quality(docs, labels.limit(0), crc_mod("doc_id", 5) == 0).collect()
    assert {g.predicted for g in alone} == {1}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    path = str(tmp_path)
    good = [(i, " ".join(prose(90))) for i in range(20)]
    shared = " ".join(prose(40))
    item = " ".join(prose(20)) + ". " + " ".join(prose(9)) + "."
    rows = good + [(30, good[0][1]), (31, "tiny"), (32, None), (33, " ".join(prose(70)) + "\n" + shared), (34, " ".join(prose(70)) + "\n" + shared), (35, " ".join(prose(60)) + " " + item)]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    # 30 loses its only line and stays alone among the empty ones; 35 holds the item.
    assert set(out) == set(range(20)) | {30, 33, 34}
    assert out[33].text.endswith(shared) and shared not in out[34].text and out[30].text == ""
    assert out[0].n_tokens > 0
