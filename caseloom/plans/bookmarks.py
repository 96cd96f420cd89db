"""Analyst bookmarks resolved to their rows, and the sequence they tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.core import blank_to_null, first_present, text
from caseloom.plans.common import HOST, union_all


def bookmark_source(df: DataFrame, table: str, fields: list[str], time_field: str = "timestamp", keys: list[str] = HOST) -> DataFrame:
    """A table as bookmark targets: only the fields a bookmark may name, as a map."""
    names = list(dict.fromkeys([*fields, time_field]))
    optional = {c: (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in ("remote_address", "direction")}
    return df.select(
        *keys, F.lit(table).alias("tableName"), F.col("_rowid").alias("rowid"), F.lit(time_field).alias("time_field"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("string") for n in names])).alias("cells"),
        *optional.values(),
    )


def resolved(bookmarks: DataFrame, sources: list[DataFrame], keys: list[str] = HOST) -> DataFrame:
    """Bookmarks with their event time: the named field, else the table's timeline field, else its timestamp.

    A bookmark whose row is gone stays without a time. Bookmarks are an analyst's shortlist, so the optimizer may send
    them to the sources instead of moving the sources.
    """
    rows = union_all(sources)
    joined = bookmarks.join(rows, [*keys, "tableName", "rowid"], "left")
    cell = lambda name: F.try_element_at("cells", name)
    default = first_present(cell(F.col("time_field")), cell(F.lit("timestamp")))
    at = F.when(text("field") != "", blank_to_null(cell(F.col("field")))).otherwise(default)
    return joined.select(*bookmarks.columns, at.alias("event_time"), "remote_address", "direction")


def bookmark_order(descending: bool = False) -> list[Column]:
    """By event time; bookmarks without one sink and go by the time they were made."""
    at = F.col("event_time")
    return [F.asc(at.isNull()), at.desc() if descending else at.asc(), F.asc("taggedAt")]


def sequence(entries: DataFrame, addresses: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Entries with their peer: a known host's lifeline or the bare address."""
    peer = blank_to_null(F.trim(text("remote_address")))
    return entries.withColumn("peer", peer).join(addresses.withColumnRenamed("ip", "peer"), "peer", "left")


def participants(steps: DataFrame, max_peers: int | None = None) -> DataFrame:
    """Lifelines: every host (own or peer) in first-appearance order, then unknown peers (the first ``max_peers``, if given)."""
    order = F.struct(F.col("event_time").isNull().alias("late"), text("event_time").alias("at"), F.col("taggedAt").alias("tag"))
    hosts = steps.select(F.col("host_id").alias("name"), order.alias("o")).unionByName(
        steps.filter(F.col("peer_host").isNotNull()).select(F.col("peer_host").alias("name"), order.alias("o"))
    ).groupBy("name").agg(F.min("o").alias("first")).withColumn("kind", F.lit("host"))
    unknown = steps.filter(F.col("peer").isNotNull() & F.col("peer_host").isNull())
    peers = unknown.groupBy(F.col("peer").alias("name")).agg(F.min(order).alias("first"))
    if max_peers is not None:
        peers = peers.orderBy("first", "name").limit(max_peers)
    return hosts.unionByName(peers.withColumn("kind", F.lit("peer")))
