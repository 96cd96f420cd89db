"""Search over every table of a case, linked rows, value lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import contains_folded
from caseloom.operators import ordered
from caseloom.operators.filters import any_column_contains
from caseloom.operators.postings import PostedTables
from caseloom.plans.common import HOST, union_all

# Fixed value: shortest query.
MIN_QUERY = 2
#: Joined rows of one link value that one task makes.
PAIRS_PER_PART = 20_000_000
#: Columns of hits, for a case without any file to search.
HITS = "host_id string, table_name string, _rowid bigint, match_column string, row string"


def table_hits(df: DataFrame, table: str, query: str, keys: list[str] = HOST, per_table: int | None = None) -> DataFrame:
    """Rows with the text in any column, the first such column, and the row as JSON.

    All of them, or the first ``per_table`` per host; that rank is pruned inside each input partition, and rows are only
    turned into JSON once they passed it.
    """
    columns = [c for c in df.columns if c not in (*keys, "_rowid")]
    found = df.filter(any_column_contains(columns, query))
    if per_table is not None:
        found = ordered.top_per_key(found, keys, [F.col("_rowid")], per_table)
    match = F.coalesce(*[F.when(contains_folded(F.col(f"`{c}`").cast("string"), query), F.lit(c)) for c in columns])
    return found.select(*keys, F.lit(table).alias("table_name"), "_rowid", match.alias("match_column"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("row"))


def case_search(tables: dict[str, DataFrame], query: str, keys: list[str] = HOST, per_table: int | None = None, total: int | None = None) -> DataFrame | None:
    """Hits over all tables and hosts, the first ``total`` of them if that is given; nothing for a query under two characters.

    ``hit_groups`` of the hits without limits says how many there are.
    """
    needle = query.strip()
    if len(needle) < MIN_QUERY:
        return None
    hits = union_all([table_hits(df, name, needle, keys, per_table) for name, df in sorted(tables.items())])
    return hits.orderBy(*keys, "table_name", "_rowid").limit(total) if total is not None else hits


def indexed_search(index: PostedTables, query: str, keys: list[str] = HOST) -> DataFrame | None:
    """The hits of ``case_search`` over stored tables; files that cannot hold the text are not opened."""
    needle = query.strip()
    if len(needle) < MIN_QUERY:
        return None
    tables, _, _ = index.narrowed(needle)
    hits = [table_hits(df, name, needle, keys) for name, df in tables]
    return union_all(hits) if hits else index.spark.createDataFrame([], HITS)


def hit_groups(hits: DataFrame, current_host: str | None = None, keys: list[str] = HOST) -> DataFrame:
    """Hits per host and table, the current host first."""
    own = F.col("host_id") == F.lit(current_host)
    return hits.groupBy(*keys, "table_name").agg(F.count(F.lit(1)).alias("hits")).withColumn("is_current", F.coalesce(own, F.lit(False)))


def linked_rows(df: DataFrame, column: str, value: Column | str, search: str = "") -> DataFrame:
    """Rows linked by a column value, with an optional text filter on the loaded file or the linking column."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    looked_at = "loaded_filename" if "loaded_filename" in df.columns else column
    rows = df.filter(F.col(column) == value)
    return rows.filter(contains_folded(looked_at, search.strip())) if search.strip() else rows


def link(left: DataFrame, left_column: str, right: DataFrame, right_column: str, keys: list[str] = HOST, how: str = "inner") -> DataFrame:
    """Follow a link between two evidence tables, within a host. ``how``: inner or left.

    Every pair is a row, so a few values shared by many rows are most of the work. Both sides are dealt by link, and a value
    with more than ``PAIRS_PER_PART`` pairs in parts: its rows on one side are split, those on the other meet each part.
    """
    target = right.select(*keys, F.col(right_column).alias(left_column), *[F.col(c).alias(f"linked_{c}") for c in right.columns if c not in (*keys, right_column)])
    on = [*keys, left_column]
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_left")).join(target.groupBy(*on).agg(F.count(F.lit(1)).alias("_right")), on)
    # a row of a left join without a partner in its part would count as one without any
    split_left = F.col("_left") > F.col("_right") if how == "inner" else F.lit(True)
    many = sizes.withColumn("_parts", F.ceil(F.col("_left") * F.col("_right") / F.lit(PAIRS_PER_PART)).cast("int")).filter("_parts > 1")
    many = many.select(*on, "_parts", split_left.alias("_split_left"))
    # a given number, as few bytes may make many pairs
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, split: Column) -> DataFrame:
        # by the row's values, so that a task that runs again deals alike
        values = [c for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
        own = F.array(F.pmod(F.xxhash64(*values), F.col("_parts")).cast("int"))
        part = F.when(F.col("_parts").isNull(), F.array(F.lit(0))).when(split, own).otherwise(F.sequence(F.lit(0), F.col("_parts") - 1))
        placed = rows.join(many, on, "left").withColumn("_part", F.explode(part)).drop("_parts", "_split_left")
        return placed.repartition(tasks, *on, "_part")

    joined = dealt(left, F.col("_split_left")).join(dealt(target, ~F.col("_split_left")), [*on, "_part"], how)
    return joined.drop("_part")


def raw_event_of(overview: DataFrame, events: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Overview rows with their raw event; only keys of the form ``<log>.evtx::<number>`` lead to one."""
    gate = F.when(F.col("record_key").rlike(r"(?i)\.evtx::\d+$"), F.col("record_key"))
    raw = events.select(
        *keys, F.col("_record_key").alias("_raw_key"), F.col("Provider").alias("raw_provider"), F.col("EventID").alias("raw_event_id"),
        F.col("timestamp").alias("raw_timestamp"), F.col("_rowid").alias("raw_rowid"),
    )
    # only events that a row links to are grouped
    wanted = overview.select(*keys, gate.alias("_raw_key")).filter(F.col("_raw_key").isNotNull()).distinct()
    raw = raw.join(wanted, [*keys, "_raw_key"], "left_semi")
    raw = raw.groupBy(*keys, "_raw_key").agg(F.min_by(F.struct("raw_provider", "raw_event_id", "raw_timestamp", "raw_rowid"), "raw_rowid").alias("r"))
    return overview.withColumn("_raw_key", gate).join(raw, [*keys, "_raw_key"], "left").select(*overview.columns, "r.*")
