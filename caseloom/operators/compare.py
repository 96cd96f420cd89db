"""Comparing two versions of a result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a key's hash that name its range, from coarse to fine.
COARSE, FINE = 12, 24


def rows_digest(columns: list[str]) -> Column:
    """Aggregate that is equal for equal rows in any order: sums of two row hashes.

    Hash functions skip NULLs, so each column comes with a mark; else a value could change its column unnoticed.
    """
    marked = [x for c in sorted(columns) for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    total = lambda *salt: F.sum(F.xxhash64(*salt, *marked).cast("decimal(38,0)")).cast("string")
    return F.concat_ws(":", total(), total(F.lit("second")))


def _range_of(keys: list[str], bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*[x for k in keys for x in (F.col(f"`{k}`"), F.col(f"`{k}`").isNull())]), 64 - bits)


def _differing_ranges(left: DataFrame, right: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Ranges of keys whose rows differ between the versions; both sides are summed up before they meet."""
    def summed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(_range_of(keys, bits).alias("_range")).agg(F.struct(F.count(F.lit(1)), rows_digest(left.columns)).alias(name))

    both = summed(left, "_l").join(summed(right, "_r"), "_range", "full_outer")
    return both.filter(~F.col("_l").eqNullSafe(F.col("_r"))).select("_range")


def differing_part(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions in key ranges that differ: all rows that are not in both, and few others.

    A digest tree of two levels: the versions are summed up in 4,096 ranges, those that differ in ranges 4,096 times as fine, and
    only rows of fine ranges that differ come out. What is shuffled are digests and these rows. Both versions are scanned three
    times, which pays where they are stored tables. Columns must be hashable (no maps).
    """
    right = right.select(*left.columns)
    # At most 4,096 rows, whatever the data.
    coarse = F.broadcast(_differing_ranges(left, right, keys, COARSE))
    narrowed = [df.join(coarse, _range_of(keys, COARSE) == coarse["_range"], "left_semi") for df in (left, right)]
    fine = _differing_ranges(*narrowed, keys, FINE)
    a, b = (df.withColumn("_range", _range_of(keys, FINE)).join(fine, "_range", "left_semi").drop("_range") for df in narrowed)
    return a, b


def stored_row_differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``row_differences`` of two large stored versions that are mostly equal."""
    return row_differences(*differing_part(left, right, keys))


def stored_column_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``column_mismatches`` of two large stored versions that are mostly equal."""
    return column_mismatches(*differing_part(left, right, keys), keys)


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one version has, with multiplicity. Columns are matched by name."""
    right = right.select(*left.columns)
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    only_right = right.exceptAll(left).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)


def column_mismatches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per column: rows of the same key whose values differ. Missing rows count under ``(missing)``."""
    columns = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*columns).alias("_l"))
    b = right.select(*keys, F.struct(*columns).alias("_r"))
    both = a.join(b, keys, "full_outer")
    present = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    counts = both.agg(
        *[F.count_if(present & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))).alias(c) for c in columns],
        F.count_if(~present).alias("(missing)"),
    )
    return counts.unpivot([], [F.col(f"`{c}`") for c in counts.columns], "column_name", "mismatches")
