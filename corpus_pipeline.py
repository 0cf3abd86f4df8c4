"""A cleaning pipeline over the documents table: each stage applies one operator of touchline.llm.

A stage takes the documents that its predecessor kept and returns documents; each
is written to the shared folder and read again by the next. The last adds the
token counts and digests.

In every stage each row stands for itself, whatever its id: repeated rows and null
ids, languages and sources are allowed, other columns are kept whatever their
names, and texts of any length are read whole. No documents: no documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from touchline.llm import bpe, decontaminate, jaccard, line_dedup, quality_rules
from touchline.llm.queries import VOCABULARY
from touchline.llm.text import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject: null, empty and short texts among them; of repeated rows all or none. A language without enough labels rejects by the base alone."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its text without lines that stand in an earlier place; equal documents keep their lines in the first. A text whose lines all go is empty, a null text stays null."""
    return line_dedup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones; of equal rows one, of all texts of less than five words that are equal one."""
    return jaccard.first_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item; null and empty texts hold none, and without items all stay."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with n_tokens, ids_sha256 and decoded_sha256; null as the empty text."""
    return bpe.with_tokens(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]
#: The rules' exact bounds, edit distances, min-hashes and merges have no SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
