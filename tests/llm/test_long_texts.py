"""One very long text beside ordinary ones: it is read whole, and nothing crashes."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from touchline.llm import bpe, crf, hmm, merkle, quality_rules, secret_scan
from touchline.llm.text import crc_mod

R = random.Random(8)
PATH = public_tokenizers.path("byte_bpe_50k.json")
LONG = "\n".join(" ".join(f"w{R.randrange(3000)}é" for _ in range(40)) for _ in range(2000)) + " password=abcdefghijklmnop\n" + "x" * 300_000
TEXTS = [LONG, "short text", None, "", "password=abcdefghijklmnop", " ".join(f"v{i}" for i in range(80))] + [f"some plain words number {i} and then a few more of them" for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(0, LONG, None, None, 1)], "doc_id long, text string, lang string, source string, n_chars long")


def test_secrets_of_a_long_text(docs):
    got = [r for r in secret_scan.secrets(docs).collect() if r.doc_id == 0]
    at = LONG.index("password=")
    assert len(got) == 2 and {(r.n_assign, r.base_sha256) for r in got} == {(1, hashlib.sha256(f"assign:{at}:{at + 25}".encode()).hexdigest())}


def test_rules_of_a_long_text(spark, docs):
    got = next(r for r in quality_rules.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() if r.doc_id == 0)
    ws = re.findall(r"[^ \t-\r]+", LONG)
    runs = Counter(zip(ws, ws[1:], ws[2:], strict=False))
    hit = {i + k for i in range(len(ws) - 2) for k in range(3) if runs[tuple(ws[i : i + 3])] > 1}
    assert (got.n_words, got.word_chars, got.n_repeat_words, got.base_failed, got.kept) == (len(ws), sum(map(len, ws)), len(hit), False, True)


def test_ids_of_a_long_text(docs):
    got = [r for r in bpe.bpe_digest(docs, PATH).collect() if r.doc_id == 0]
    ids = Tokenizer.from_file(PATH).encode(LONG, add_special_tokens=False).ids
    assert len(got) == 2 and {(r.n_tokens, r.ids_sha256) for r in got} == {(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())}
    assert {r.decoded_sha256 for r in got} == {hashlib.sha256(LONG.encode()).hexdigest()}


def test_scores_of_a_long_text(docs):
    rows = hmm.score(docs, crc_mod("doc_id", 10) == 0, iterations=1).collect()
    long = [r for r in rows if r.doc_id == 0]
    assert len(rows) == len(TEXTS) + 1 and {r.n_tokens for r in long} == {len(re.findall(r"[^ \t-\r]+", LONG)) + 1}
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows) and len({round(r.score, 6) for r in long}) == 1


def test_quality_of_a_long_text(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    rows = crf.quality(docs, labels, crc_mod("doc_id", 5) == 0).collect()
    assert len(rows) == len(TEXTS) + 1 and all(0 <= r.score <= 1 for r in rows)


def test_leaf_of_a_long_text(docs):
    got = {r.d for r in docs.where("doc_id = 0").select(merkle.leaf(docs["text"]).alias("d")).collect()}
    assert got == {hashlib.sha256(f"{len(LONG.encode())}:{LONG}".encode()).digest()}
