"""Exact deduplication by skew-safe combining.

Equal texts are merged three times, and each time the whole text is part of the key, so that equal digests never stand for
equal texts: inside a task (partial aggregation), per (digest, salt), and over the salts of a digest. The salt comes from the
partition a row was read in, so the merge of one digest gets at most one row from each salt, however large its group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import SPACE

#: Salts per digest: the most rows that the last merge gets for one text.
SALTS = 16


def normalised(text: Column) -> Column:
    """Runs of white space become one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per different text: ``digest``, ``body`` (normalised), ``keep_id`` (smallest id), ``group_size``."""
    rows = docs.select(F.col(id_column).alias("_id"), normalised(F.col(text_column)).alias("body"))
    salted = rows.select("_id", "body", F.sha2("body", 256).alias("digest"), (F.spark_partition_id() % salts).alias("salt"))
    winners = salted.groupBy("digest", "salt", "body").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    return winners.groupBy("digest", "body").agg(F.min("_id").alias("keep_id"), F.sum("_n").alias("group_size"))


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Only groups of two rows or more are joined back, by digest and a second fingerprint of the text; a group's share of the
    rows may be large, which the adaptive skew join splits.

    Null text is empty text. A null id never wins against another; in a group of null ids alone ``keep_id`` is null and all
    say kept. Rows repeated with the same id and text are one document: all say kept when that id is the smallest. Other
    columns are not read. An empty table gives an empty result.
    """
    groups = text_groups(docs, id_column, text_column, salts).filter("group_size > 1").select(
        F.col("digest").alias("_digest"), F.xxhash64("body").alias("_print"), "keep_id", "group_size")
    rows = docs.select(F.col(id_column).alias("doc_id"), normalised(F.col(text_column)).alias("body")).select(
        "doc_id", F.sha2("body", 256).alias("text_sha256"), F.xxhash64("body").alias("_own"))
    joined = rows.join(groups, (F.col("text_sha256") == F.col("_digest")) & (F.col("_own") == F.col("_print")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                         F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def without_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows whose text no row with a smaller id has, with all their columns.

    Rows repeated with the same id and text stay together. Dropped rows are found by (id, text digest).
    """
    found = exact_duplicates(docs.select(id_column, text_column), id_column, text_column)
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs[id_column].eqNullSafe(dropped["_id"]) & (F.sha2(normalised(docs[text_column]), 256) == dropped["_sha"])
    return docs.join(dropped, same, "left_anti")


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""
