"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, crf, decontaminate, hard_negatives, hmm, jaccard, line_dedup, merkle, quality_rules, secret_scan, sharding, token_files, url_filter
from .text import crc_mod, table

VOCABULARY = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from the last version of their sharded table."""
    return sharding.sharded(table(spark, sf_dir, "documents")).read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.secrets(docs, repo=F.concat_ws("/", "source", "lang"), owner="source")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op9_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) == 0)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


#: Fixed rules of the query.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"), RULES)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of rows whose id is divisible by 7 move on by one, as noise."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document (by crc32 of its id) is folded with its text lower-cased."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(crc_mod("doc_id", 3) == 0, merkle.leaf(*rest, lower))
    return merkle.proofs(table(spark, sf_dir, "documents"), merkle.leaf(*rest, F.col("text")), altered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_NEGATIVES = """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""


def _leaf(text: str) -> str:
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"
    return "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: crc32 by its table; nodes level by level; for each document and level the siblings on both sides; then a fold up the levels.
_MANIFEST = f"""WITH RECURSIVE tab0(i, k, c) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM tab0 WHERE k < 8), tab AS (SELECT list(c ORDER BY i) AS t8 FROM tab0 WHERE k = 8),
d0 AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t, {_leaf("text")} AS leaf, {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t8[(xor(c, b) & 255) + 1])), 4294967295) % 3 = 0 AS tampered FROM documents, tab),
d AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d0),
nodes(t, level, i, h, n) AS (SELECT t, 0, i, leaf, n FROM d UNION ALL SELECT t, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM nodes WHERE n > 1 GROUP BY t, level, i // 8),
sub AS (SELECT t, h, level AS height FROM nodes WHERE n = 1),
tops(level, i, h, n) AS (SELECT 0, t, h, count(*) OVER () FROM sub UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 7) // 8) FROM tops WHERE n > 1 GROUP BY level, i // 8),
steps AS (SELECT d.id, level AS k, string_agg(nodes.h, '' ORDER BY nodes.i) FILTER (nodes.i < d.i // (8 ** level)::BIGINT) AS l, string_agg(nodes.h, '' ORDER BY nodes.i) FILTER (nodes.i > d.i // (8 ** level)::BIGINT) AS r FROM d JOIN nodes ON nodes.t = d.t AND nodes.n > 1 AND nodes.i // 8 = d.i // (8 ** (level + 1))::BIGINT GROUP BY d.id, level
UNION ALL SELECT d.id, height + tops.level, string_agg(tops.h, '' ORDER BY tops.i) FILTER (tops.i < d.t // (8 ** tops.level)::BIGINT), string_agg(tops.h, '' ORDER BY tops.i) FILTER (tops.i > d.t // (8 ** tops.level)::BIGINT) FROM d JOIN sub ON sub.t = d.t JOIN tops ON tops.n > 1 AND tops.i // 8 = d.t // (8 ** (tops.level + 1))::BIGINT GROUP BY d.id, height, tops.level),
fold(id, k, h) AS (SELECT id, 0, CASE WHEN tampered THEN low ELSE leaf END FROM d UNION ALL SELECT f.id, f.k + 1, sha256(coalesce(l, '') || h || coalesce(r, '')) FROM fold f JOIN steps s ON s.id = f.id AND s.k = f.k),
proof AS (SELECT id, string_agg(coalesce(l, '') || coalesce(r, ''), '' ORDER BY k) AS p FROM steps GROUP BY id), last AS (SELECT id, arg_max(h, k) AS folded FROM fold GROUP BY id), root AS (SELECT h AS root FROM tops WHERE n = 1)
SELECT doc_id, leaf, sub.h AS subroot, root, sha256(coalesce(p, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM d JOIN sub ON sub.t = d.t JOIN last ON last.id = d.id LEFT JOIN proof ON proof.id = d.id, root"""


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents", "op12_hard_negatives": _NEGATIVES, "op13_merkle": _MANIFEST}
