"""The raw zone laid out for the scans that analysts make: events by log and day, registry rows by hive.

Filters on these columns are settled on folder names, before a file is opened; other filters reach the files' statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.core import blank_to_null
from caseloom.functions.times import in_range, widen_bound

#: Partition columns by table.
LAYOUT = {"events": ("log", "day"), "registry": ("hive",)}


def day_of(ts: str = "timestamp") -> Column:
    """Evidence times are text of one clock, so the day is their beginning. Rows without a time have no day."""
    return F.substring(blank_to_null(ts), 1, 10)


def zone_schema(schema: T.StructType, table: str) -> T.StructType:
    """Files hold the other columns; partition columns are text and come last."""
    keys = LAYOUT[table]
    return T.StructType([f for f in schema.fields if f.name not in keys] + [T.StructField(k, T.StringType()) for k in keys])


def write_zone(rows: DataFrame, path: str, table: str) -> None:
    """Write one table by its layout. Dealt by ranges, so a large log is written by many tasks and a small one by one."""
    laid = rows.withColumn("day", day_of()) if "day" in LAYOUT[table] else rows
    keys = LAYOUT[table]
    # An empty name and none are one folder.
    laid = laid.withColumns({k: blank_to_null(k) for k in keys})
    laid.repartitionByRange(*keys, "_source_file", "_rowid").sortWithinPartitions(*keys, "_source_file", "_rowid").write.partitionBy(*keys).parquet(path)


def read_zone(spark: SparkSession, path: str, schema: T.StructType, table: str) -> DataFrame:
    """``schema`` is that of the rows as they were written; it is not looked up in the files."""
    return spark.read.schema(zone_schema(schema, table)).parquet(path)


def between(events: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Events in an inclusive range: the days by folder, the times inside them by statistics. Untimed rows fall out with a bound."""
    low, high = widen_bound(start, "start"), widen_bound(end, "end")
    kept = events.filter(in_range("timestamp", start, end))
    if low:
        kept = kept.filter(F.col("day") >= low[:10])
    if high:
        kept = kept.filter(F.col("day") <= high[:10])
    return kept


def of_logs(events: DataFrame, requested: DataFrame) -> DataFrame:
    """Events of the logs in a table; its names, known only at run time, choose the folders."""
    return events.join(requested.select("log").distinct(), "log", "left_semi")
