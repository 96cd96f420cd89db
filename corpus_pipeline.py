"""A training corpus from the documents: known language, no exact copies, no near copies, no benchmark, encoded.

Each stage takes (session, documents, data folder) and works on all rows that the stage before kept; all but the last return the
columns of documents. Every document that stays keeps all its columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseloom.llm import bpe, decontamination, exact_dedup, language_id, queries, setsketch
from caseloom.llm.common import cut_lineage, read_table

#: Per cent of shingles that near copies have in common, and share of a benchmark item's shingles that makes a leak.
NEAR_PERCENT, LEAK_SHARE = 80, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.in_known_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return setsketch.without_near_copies(docs, NEAR_PERCENT)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"), LEAK_SHARE)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    return bpe.encoded(docs, queries.tokenizer_path())


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_leaks), ("bpe_encoding", encode)]

#: Language identification is not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents. A checkpoint after each keeps later stages from repeating earlier ones."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
