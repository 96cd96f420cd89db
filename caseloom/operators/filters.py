"""Predicate builders shared by the analyst queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.core import all_of, any_of, col, text
from caseloom.functions.text import contains_folded
from caseloom.functions.times import in_range


def column_filter(column: str, value: str, mode: str = "contains") -> Column:
    """Case-insensitive contains, exclude or exact; an empty value filters nothing."""
    if not value:
        return F.lit(True)
    if mode == "exclude":
        return ~contains_folded(column, value)
    if mode == "exact":
        return F.lower(text(column)) == value.lower()
    return contains_folded(column, value)


def any_column_contains(columns: list[str], needle: str) -> Column:
    if not needle.strip():
        return F.lit(True)
    return any_of([contains_folded(F.col(f"`{c}`").cast("string"), needle) for c in columns])


def untimed_or_in_range(ts: Column | str, start: str | None, end: str | None) -> Column:
    """Configuration without a time cannot be excluded by an incident window."""
    value = col(ts)
    return value.isNull() | (value == "") | in_range(ts, start, end)


@dataclass(frozen=True)
class ActivityFilter:
    """Filter of the browser activity views; unset parts do not filter."""

    account: str | None = None
    kinds: tuple[str, ...] = ()
    day: str | None = None
    search: str | None = None
    start: str | None = None
    end: str | None = None

    # Fixed value: the selector entry that stands for every account.
    ALL_ACCOUNTS = "(전체)"

    def condition(self) -> Column:
        parts: list[Column] = []
        if self.account and self.account != self.ALL_ACCOUNTS:
            parts.append(F.col("account") == self.account)
        if self.kinds:
            parts.append(F.col("kind").isin(*self.kinds))
        if self.day:
            parts.append(F.substring("timestamp", 1, 10) == self.day)
        if self.start:
            parts.append(F.col("timestamp") >= self.start)
        if self.end:
            parts.append(F.col("timestamp") <= self.end)
        if self.search and self.search.strip():
            # Wildcards of the analyst's pattern keep their meaning here, unlike in the case-wide search.
            pattern = F.lit("%" + self.search.strip().lower().replace("\\", "\\\\") + "%")
            parts.append(any_of([F.like(F.lower(text(c)), pattern) for c in ("url", "title", "url_raw")]))
        return all_of(parts)


@dataclass(frozen=True)
class Page:
    offset: int = 0
    limit: int = 200
    max_limit: int = 200

    def apply(self, df: DataFrame, order_by: list[Column]) -> DataFrame:
        """One page by order. Deep pages should filter with ``beyond`` instead of a large offset."""
        start = max(self.offset, 0)
        size = min(max(self.limit, 1), self.max_limit)
        return df.orderBy(*order_by).offset(start).limit(size)


def beyond(keys: dict[str, bool], last: dict[str, object]) -> Column:
    """Rows that come after the last row of a page: a filter in place of a large offset.

    ``keys`` are the columns of the order, True where it descends; ``last`` has their values in that row. NULLs come first in
    ascending and last in descending order, as in Spark. The keys together should tell rows apart.
    """
    after, same = F.lit(False), F.lit(True)
    for name, descending in keys.items():
        value, given = F.col(name), last[name]
        if given is None:
            later = F.lit(False) if descending else value.isNotNull()
        else:
            later = (value < F.lit(given)) | value.isNull() if descending else value > F.lit(given)
        after = after | (same & F.coalesce(later, F.lit(False)))
        same = same & value.eqNullSafe(F.lit(given))
    return after


def total_rows(df: DataFrame, name: str = "row_count") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))
