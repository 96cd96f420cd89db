"""Small helpers shared by all function modules. Empty text and NULL mean the same thing: absent."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(col(value), F.lit(""))


def text(value: Column | str) -> Column:
    """NULL-free text, for comparisons that treat absent and empty alike."""
    return F.coalesce(col(value), F.lit(""))


def first_present(*values: Column | str) -> Column:
    return F.coalesce(*[blank_to_null(v) for v in values])


def int_div(left: Column, right: int) -> Column:
    """Integer quotient; FILETIME values lose digits as doubles."""
    return F.call_function("div", left, F.lit(right).cast("bigint"))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add an expensive value that is computed once per row.

    A plain projection would be folded into every later filter and expression that mentions it, so a parsed payload
    would be parsed again for each. The one-element generator on top of the projection keeps it from moving; the
    projection itself is still compiled, which a generator over a lambda expression would not be.
    """
    return df.withColumn("_value", value).select(*df.columns, F.explode(F.array("_value")).alias(name))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.element_at(literal_map(pairs), key)


def inline_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as a local relation in the plan."""
    return spark.createDataFrame(pa.table({c: [row[i] for row in rows] for i, c in enumerate(columns)}))
