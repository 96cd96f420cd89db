"""Aggregates the analyst views share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.core import text


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency of the values of a column, most frequent first."""
    return (
        df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "value")
    )


def _with_peer(rows: DataFrame, unknown: str) -> DataFrame:
    return rows.withColumn("peer", F.coalesce(F.nullif(F.col("remote_address"), F.lit("")), F.lit(unknown)))


def peer_ledger(rows: DataFrame, keys: list[str], unknown: str = "(no address)") -> DataFrame:
    """Attempts, outcomes, number of accounts and first/last time per remote address.

    The first level groups by account too, so the account count is exact without a distinct pass.
    """
    per_account = _with_peer(rows, unknown).groupBy(*keys, "peer", "account").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("result") == "failure").alias("bad"),
        F.count_if(F.col("result") == "success").alias("good"),
        F.min("timestamp").alias("lo"),
        F.max("timestamp").alias("hi"),
    )
    return per_account.groupBy(*keys, "peer").agg(
        F.sum("n").alias("attempts"),
        F.sum("bad").alias("fail"),
        F.sum("good").alias("success"),
        F.count_if(text("account") != "").alias("accounts"),
        F.min("lo").alias("first_time"),
        F.max("hi").alias("last_time"),
    )


def peer_accounts(rows: DataFrame, keys: list[str], unknown: str = "(no address)") -> DataFrame:
    """The accounts of each peer as rows with the place they were first seen; a sprayed peer may have millions."""
    named = _with_peer(rows, unknown).filter(text("account") != "")
    return named.groupBy(*keys, "peer", "account").agg(F.min(F.struct("_source_file", "_rowid")).alias("first_seen"))


def session_rollup(rows: DataFrame, keys: list[str], order_key: Column) -> DataFrame:
    """One row per session: bounds, outcome counts, the first non-empty address and account, number of events."""
    first = lambda c: F.min_by(c, F.when(text(c) != "", order_key))
    return rows.groupBy(*keys, "session_start").agg(
        F.min_by("direction", order_key).alias("direction"),
        first("remote_address").alias("remote_address"),
        first("account").alias("account"),
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("result") == "success").alias("success"),
        F.count_if(F.col("result") == "failure").alias("fail"),
    )
