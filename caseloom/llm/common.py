"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.session import cut_lineage as _stored
from caseloom.session import ensure_checkpoint_dir

__all__ = ["SPACE", "cut_lineage", "ensure_checkpoint_dir", "in_order", "lower_ascii", "once", "read_table", "slices", "small_batches", "words"]

#: The six white-space characters that separate words.
SPACE = r"[\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut_lineage(df: DataFrame) -> DataFrame:
    """A stored copy of ``df``. Shuffle files of earlier steps go when the driver collects the plans that made them, which it
    may put off until they fill the executors' disks; so it collects here, where a step has ended."""
    done = _stored(df)
    df.sparkSession._jvm.System.gc()
    return done


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of one Arrow batch, so that a batch of long texts fits in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(batches: Iterator[pa.RecordBatch], column: str | int = "text", size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text (a longer text is a slice of its own), which are not copied.

    Bounds what a task takes for a batch, where it needs many times the bytes of the text.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(lengths) - lengths) // size
        starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else []
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(at, end - at)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a value that is computed once per row; a plain projection would be copied into every later use of it."""
    held = df.withColumn("_held", value)
    return held.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array("_held")).alias(name))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def in_order(rows: DataFrame, name: str, *order: Column) -> tuple[DataFrame, int]:
    """Number all rows from 0 in the given order, and count them. ``rows`` must be stored (read from files or a checkpoint).

    A range sort deals any number of equal keys over the tasks (each row has a number of its own as last key), and only the
    row counts of its partitions pass through the driver.
    """
    spark = rows.sparkSession
    columns = [F.col(f"`{c}`") for c in rows.columns]
    keyed = rows.select(*columns, F.monotonically_increasing_id().alias("_row"))
    ordered = cut_lineage(keyed.repartitionByRange(*order, F.col("_row")).sortWithinPartitions(*order, F.col("_row")).drop("_row"))
    # The number holds the partition in its upper bits and the row inside it in the lower 33.
    counted = ordered.select(*columns, F.monotonically_increasing_id().alias("_at")).withColumn("_part", F.shiftright("_at", 33))
    sizes = sorted((r["_part"], r["n"]) for r in counted.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_part bigint, _before bigint")
    placed = counted.join(F.broadcast(starts), "_part")
    return placed.select(*columns, (F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name)), total
