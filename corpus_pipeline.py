"""The document pipeline: each stage calls one operator of attestor.llm on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestor.llm import decontaminate, mixing, quality, simhash, simple8b
from attestor.llm.common import bounded_batches, materialised, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It is fitted on the labels of the documents at hand."""
    bounded_batches(spark)
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id."""
    bounded_batches(spark)
    return simhash.keep_one(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a full 13-word window of the benchmark go, and those of whose words one in twenty is a benchmark's."""
    bounded_batches(spark)
    own = docs.select(*COLUMNS)
    return decontaminate.without_overlap(own, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them: 0 to 3 times."""
    return mixing.mixed_rows(docs.select(*COLUMNS))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row in the written shards."""
    import public_tokenizers

    bounded_batches(spark)
    return simple8b.token_table(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("tokens", tokenised),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's result written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return docs
