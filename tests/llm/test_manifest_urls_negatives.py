"""URL filters, hard negatives and the Merkle manifest against plain brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import hard_negatives, merkle, queries, url_filter

RULES = queries.RULES


# --- Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def row_leaf(r, text):
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*map(one, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def parent(nodes):
    return [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]


def path(nodes, i):
    """(siblings before, siblings after) of each level, and the root."""
    steps = []
    while len(nodes) > 1:
        a = i - i % 8
        steps.append((nodes[a:i], nodes[i + 1 : a + 8]))
        nodes, i = parent(nodes), i // 8
    return steps, nodes[0]


def brute_manifest(rows):
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    by_lang = {}
    for r in rows:
        by_lang.setdefault((r.lang is not None, (r.lang or "").encode()), []).append(r)
    langs = sorted(by_lang)
    trees, subroots = {}, []
    for k in langs:
        rs = sorted(by_lang[k], key=lambda r: (r.doc_id is not None, r.doc_id or 0, row_leaf(r, r.text)))
        trees[k] = (rs, [row_leaf(r, r.text) for r in rs])
        subroots.append(path(trees[k][1], 0)[1])
    out = []
    for t, k in enumerate(langs):
        rs, leaves = trees[k]
        top, root = path(subroots, t)
        for i, r in enumerate(rs):
            steps = path(leaves, i)[0] + top
            tampered = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 0
            d = row_leaf(r, lower(r.text) if tampered else r.text)
            for a, b in steps:
                d = sha(*a, d, *b)
            out.append((str(r.doc_id), leaves[i], subroots[t], root, sha(*(x for a, b in steps for x in a + b)), d, d == root))
    return sorted(out)


def manifest(docs, tmp, spark):
    docs.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    got = queries.op13_merkle(spark, str(tmp))
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got.collect())


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, row string, leaf string"


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 700])
def test_manifest(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(merkle, "CHUNK", 10)
    monkeypatch.setattr(merkle, "FAN", 4)
    dice = random.Random(n)
    rows = [(i * 7 % (n + 3), dice.choice(["Ab", "ab", "", None, "É x" * 50]), dice.choice(["de", "en", "en", "en", "é", None, ""]), None if i % 5 else "S", i, "clash", "clash") for i in range(n)]
    docs = spark.createDataFrame(rows + rows[: n // 3], SHAPE).repartition(3)
    assert manifest(docs, tmp_path, spark) == brute_manifest(docs.collect())


def test_manifest_of_many_groups_null_ids_long_texts_and_no_rows(spark, tmp_path):
    rows = [(None if i % 9 == 0 else i, "X" * (200_000 if i == 5 else 1), f"g{i % 70}", None, None, None, None) for i in range(150)]
    docs = spark.createDataFrame(rows, SHAPE)
    assert manifest(docs, tmp_path, spark) == brute_manifest(docs.collect())
    assert manifest(docs.limit(0), tmp_path, spark) == []
    same = spark.createDataFrame([rows[1]] * 100, SHAPE)
    assert manifest(same, tmp_path, spark) == brute_manifest(same.collect())


def test_merging_forests_is_associative():
    leaves = [(hashlib.sha256(str(i).encode()).digest(), 100) for i in range(100)]
    cuts = [0, 3, 17, 18, 50, 77, 100]
    parts = [merkle.Forest(1, {(0, 0, i): leaves[i] for i in range(a, b)}).settled() for a, b in zip(cuts, cuts[1:], strict=False)]
    want = path([d.hex() for d, _ in leaves], 0)[1]
    left, right = parts[0], parts[-1]
    for p in parts[1:]:
        left = left + p
    for p in reversed(parts[:-1]):
        right = p + right
    assert left.root() == right.root() == want
    assert all(len([k for k in p.nodes if k[1] == level]) <= 14 for p in parts for level in range(3))


# --- hard negatives

def brute_negatives(rows, anchor=50):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for n, (a, v, label) in enumerate(kept):
        if a % anchor:
            continue
        same = sorted((-dot(v, w), i) for m, (i, w, k) in enumerate(kept) if k == label and m != n)[:5]
        other = sorted((-dot(v, w), i) for i, w, k in kept if k != label)
        for s, p in same:
            fit = [(t, i) for t, i in other if 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, row string, vector string, id string"


def negatives(spark, tmp, rows):
    spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], VECTORS).write.mode("overwrite").parquet(f"{tmp}/embeddings.parquet")
    got = queries.op12_hard_negatives(spark, str(tmp))
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("clustered", [False, True])
def test_hard_negatives(spark, tmp_path, monkeypatch, clustered):
    monkeypatch.setattr(hard_negatives, "SHARD", 150)
    monkeypatch.setattr(hard_negatives, "BLOCK", 5)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    dice = np.random.default_rng(3)
    middle = dice.normal(size=(6, 5)) * 3
    rows = [(int(i), [float(x) for x in (middle[i % 6] * clustered + dice.normal(size=5) * (0.2 if clustered else 1))], int(dice.integers(10))) for i in range(600)]
    rows[150] = (150, rows[0][1], rows[0][2])  # ties
    assert negatives(spark, tmp_path, rows) == brute_negatives(rows) != []


def test_hard_negatives_of_odd_rows(spark, tmp_path):
    one = [0.5, 0.25, -0.125]
    rows = [(50 * i, one, 1) for i in range(40)] + [(3 + 50 * i, [0.4, 0.2, 0.1], 2) for i in range(30)]  # one vector many times
    rows += [(None, one, 1), (1, None, 1), (2, [1.0, None, 1.0], 1), (4, [float("nan"), 1.0, 1.0], 2), (6, [float("inf"), 0.0, 0.0], 2), (8, [], 1), (9, [0.5], 2), (50, one, 1), (11, one, None)]
    assert negatives(spark, tmp_path, rows) == brute_negatives(rows) != []
    assert negatives(spark, tmp_path, rows[:1]) == [] == negatives(spark, tmp_path, [])
    negatives(spark, tmp_path, [(50, [3e38, 1.0], 1), (100, [3e38, 1.0], 1), (3, [2e38, 1.0], 2)])  # beyond what is exact: no crash


def test_the_trees_bounds_hold():
    dice = np.random.default_rng(1)
    x, q = dice.normal(size=(500, 8)), dice.normal(size=8)
    tree = hard_negatives.BallTree(x)
    assert sorted(tree.order) == list(range(500))
    for n, (a, b) in enumerate(zip(tree.first, tree.last, strict=True)):
        s, reach = x[tree.order[a:b]] @ q, np.linalg.norm(q) * tree.radii[n]
        assert (s <= tree.centres[n] @ q + reach + 1e-9).all() and (s >= tree.centres[n] @ q - reach - 1e-9).all()


# --- URL filters

URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.Net/x?y", "http://xnet/", "https://www.example.net/en/1", "https://example.net/en", "https://badexample.net/en/1",
    "http://example.com/de/1", "http://m.example.com/de/", "http://example.com/fr/1", "http://a.org/fr/2#x", "http://org/fr/", "a://b://net/", "http://net#/", "http://net?/", "HTTP://É.NET/\n", "http://x.example.org/en/" + "y" * 20000,
]


def plain(url):
    m = re.match(r"(?s)(.*?)://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", "", None
    host, p = re.sub("[A-Z]", lambda x: x[0].lower(), m[2]), m[3]
    fit = [r for r in RULES if ("." + host).endswith("." + r[: r.index("/")]) and p.startswith(r[r.index("/") :])]
    return host, p, max(fit, key=len, default=None)


def pages(spark, urls):
    return spark.createDataFrame([(None if i == 3 else i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, score string, host string")


def test_hosts_paths_and_rules(spark):
    got = {r.page_id: r for r in url_filter.judged(pages(spark, URLS), RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        r = got[None if i == 3 else i]
        host, p, name = plain(u)
        assert (r.host, r.path, r.rule) == (host, p, name), u
        assert r.verdict in ("allow", "block") and (name is None or r.verdict == RULES[name])


def brute_scores(urls, order, share, wrong, held_out=5):
    """The models by their definition: every count by a loop, contexts of share or more kept if all their suffixes are."""
    models, held = {}, []
    for accepted in (True, False):
        of = [u for u in urls if plain(u)[2] and (RULES[plain(u)[2]] == "allow") == accepted]
        held += [(u, accepted) for u in of if zlib.crc32(u.encode()) % held_out == 0]
        grams, symbols = Counter(), 0
        for s in (url_filter.symbols(u) for u in of if zlib.crc32(u.encode()) % held_out):
            for i in range(1, len(s)):
                symbols += 1
                for k in range(min(i, order) + 1):
                    grams[s[i - k : i], s[i]] += 1
        contexts = Counter()
        for (c, _), n in grams.items():
            contexts[c] += n
        models[accepted] = (grams, contexts, share * symbols)

    def p(model, context, x):
        grams, contexts, least = model
        out = 1 / 257
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            if not contexts[c] or contexts[c] < least:
                return out
            kinds = len({b for a, b in grams if a == c})
            out = (grams[c, x] + kinds * out) / (contexts[c] + kinds)
        return out

    def score(u):
        s = url_filter.symbols(u)
        return sum(math.log2(p(models[True], s[max(0, i - order) : i], s[i]) / p(models[False], s[max(0, i - order) : i], s[i])) for i in range(1, len(s))) / (len(s) - 1)

    good = sorted(math.floor(score(u) * 1024) for u, a in held if a)
    at = next((g / 1024 for g in good if sum(x <= g for x in good) > wrong * len(good)), 0.0)
    return {u: score(u) for u in urls}, at


def test_scores_and_cutoff(spark):
    dice = random.Random(5)
    word = lambda: "".join(dice.choice("abe") for _ in range(dice.randint(1, 4)))
    urls = [f"http://{word()}.{d}/{dice.choice(['en', 'fr', 'de'])}/{word()}" for d in ("example.net", "example.com", "a.org", "b.net") for _ in range(25)]
    want, at = brute_scores(urls, 3, 1 / 100, 0.1)
    got = url_filter.judged(pages(spark, urls), RULES, order=3, share=1 / 100, wrong=0.1).collect()
    verdicts = set()
    for r, u in ((r, urls[r.page_id if r.page_id is not None else 3]) for r in got):
        assert r.score == pytest.approx(want[u]) and r.cutoff == at
        if r.rule is None:
            assert r.verdict == ("block" if want[u] < at else "allow")
            verdicts.add(r.verdict)
    assert verdicts == {"allow", "block"}


def test_a_model_is_a_distribution():
    m = url_filter.Model(2)
    for g, n in (("a", 3), ("b", 1), ("aa", 2), ("ab", 1), (url_filter.END, 1)):
        m.add(g, n)
    for context in ("", "a", "ba", "zz"):
        assert sum(m.p(context, chr(i)) for i in range(256)) + m.p(context, url_filter.END) == pytest.approx(1)


def test_no_urls_and_no_rule(spark):
    assert url_filter.judged(pages(spark, URLS).limit(0), RULES).collect() == []
    got = url_filter.judged(pages(spark, ["http://a.com/", "http://a.net/"]), RULES).orderBy("page_id").collect()
    assert [(r.verdict, r.score) for r in got] == [("allow", None), ("block", None)]
    assert dict(url_filter.judged(pages(spark, ["http://a.b/c/d"]), {"b/c": "block", "a.b/": "allow"}).select("page_id", "rule").collect()) == {0: "a.b/"}


def test_ties_of_rules(spark):
    got = url_filter.judged(pages(spark, ["http://x.b/aaa"]), {"b/aaa": "block", "x.b/a": "allow"}).first()
    assert (got.rule, got.verdict) == ("x.b/a", "allow")


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_merkle"])
def test_the_sql_says_the_same(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.execute(queries.oracle_sql()[name])
    at = [c[0] for c in rel.description]
    assert sorted(at) == sorted(df.columns)
    want = sorted(rel.fetchall())
    assert sorted(tuple(r[c] for c in at) for r in df.collect()) == want and want
