"""Shared shape of the overview tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.schemas import overview_columns

HOST = ["host_id"]


def overview_row(df: DataFrame, table: str, keep: list[str], **values: Column | str) -> DataFrame:
    """One branch of an overview table: named values, everything else NULL, all text."""
    columns = []
    for name in overview_columns(table):
        value = values.get(name)
        if isinstance(value, str):
            value = F.lit(value)
        columns.append((F.lit(None) if value is None else value).cast("string").alias(name))
    return df.select(*keep, *columns)


def union_all(branches: list[DataFrame]) -> DataFrame:
    """Branches in a fixed order, blanks filled."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
