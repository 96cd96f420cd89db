"""Ordered scans that never put one host into one task.

A plain window over ``partitionBy(host)`` would sort a whole host in one task. Here every scan works in two levels. The rows
are dealt by ranges of (key, time, ties) whose bounds Spark samples from the data, and are stored with the number of their
range: a cell is what one key has in one range. Rows are windowed inside cells, each cell leaves one summary row, a window
over the summaries carries state from range to range, and the carried state is joined back. A burst inside one instant, or any
number of rows without a time, is split by its ties like everything else, and a quiet year is one cell. A key has at most as
many summaries as there are ranges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import cut_lineage

SPAN = "_span"


@dataclass(frozen=True)
class ScanOrder:
    """Keys that isolate a scan, its time column, and the tie-break columns of the scan order. Rows without a time come first."""

    keys: tuple[str, ...]
    time: str
    ties: tuple[str, ...]

    def key(self) -> Column:
        return F.struct(F.col(self.time), *[F.col(c) for c in self.ties])

    def cells(self, df: DataFrame) -> DataFrame:
        """The rows with the number of their range, stored once.

        Both the rows and their summaries are made from the stored table: bounds that were sampled twice could deal a row to two
        ranges, and the input would be computed again for each use.
        """
        ranged = df.repartitionByRange(*[F.col(c) for c in (*self.keys, self.time, *self.ties)])
        return cut_lineage(ranged.withColumn(SPAN, F.spark_partition_id()))

    def window(self):
        return Window.partitionBy(*self.keys, SPAN).orderBy(self.time, *self.ties)

    def over_spans(self):
        return Window.partitionBy(*self.keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)

    def attach(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """Join the state of each cell back; the rows are already partitioned by exactly these columns."""
        return rows.join(summary, [*self.keys, SPAN], "left")


def carry_last(df: DataFrame, order: ScanOrder, value: Column, name: str, include_current: bool = False) -> DataFrame:
    """Latest non-NULL ``value`` before each row (or up to it), over the whole scan of each key."""
    rows = order.cells(df.withColumn("_v", value))
    upto = order.window().rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    local = rows.withColumn("_local", F.last("_v", ignorenulls=True).over(upto))
    summary = (
        rows.groupBy(*order.keys, SPAN)
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), order.key())).alias("_tail"))
        .withColumn("_carried", F.last("_tail", ignorenulls=True).over(order.over_spans()))
        .drop("_tail")
    )
    joined = order.attach(local, summary)
    return joined.withColumn(name, F.coalesce("_local", "_carried")).drop("_v", "_local", "_carried", SPAN)


def state_changes(df: DataFrame, order: ScanOrder, state: str) -> DataFrame:
    """Rows whose boolean state differs from the row before; the first row stays only when its state is off."""
    previous = carry_last(df, order, F.struct(F.col(state).alias("s")), "_previous")
    changed = F.coalesce(F.col("_previous.s") != F.col(state), ~F.col(state))
    return previous.filter(changed).drop("_previous")


def carry_within(
    df: DataFrame, keys: tuple[str, ...], time: str, ties: tuple[str, ...], value: str, tolerance_ms: int, name: str
) -> DataFrame:
    """Fill ``name`` with the latest earlier original ``value`` when it is at most ``tolerance_ms`` old.

    Rows without a time keep their own value and are nobody's source.
    """
    source = F.when(F.col(value).isNotNull() & F.col(time).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    carried = carry_last(df, ScanOrder(keys, time, ties), source, "_src")
    near = F.col(time) - F.col("_src.t") <= F.lit(tolerance_ms)
    return carried.withColumn(name, F.coalesce(F.col(value), F.when(near, F.col("_src.v")))).drop("_src")


def cluster_sessions(
    df: DataFrame, order: ScanOrder, gap_ms: int, direction: str | None = None, address: str | None = None, measured: str | None = None
) -> DataFrame:
    """Add ``session_start`` (struct of time and tie-breaks) to every row.

    A session ends when the direction changes, when the gap to the previous row exceeds ``gap_ms``, or when a row
    carries an address other than the address the session already has. A gap of exactly ``gap_ms`` stays inside.
    ``measured`` names the time that gaps are measured by, where it is not the time of the order; a gap next to a row
    without it ends nothing.
    """
    clock = F.col(measured or order.time)
    d = F.col(direction) if direction else F.lit("")
    a = F.nullif(F.col(address), F.lit("")) if address else F.lit(None).cast("string")
    w = order.window()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    # Inside a cell: breaks that need no knowledge of earlier cells.
    rows = (
        order.cells(df)
        .withColumn("_key", order.key()).withColumn("_d", d).withColumn("_a", a)
        .withColumn("_prev", F.lag(F.struct(clock.alias("t"), F.col("_d").alias("d"))).over(w))
        .withColumn(
            "_break",
            F.col("_prev").isNotNull()
            & (~F.col("_prev.d").eqNullSafe(F.col("_d")) | F.coalesce(clock - F.col("_prev.t") > F.lit(gap_ms), F.lit(False))),
        )
        .withColumn("_state", F.when(F.col("_break") | F.col("_a").isNotNull(), F.struct(F.col("_a").alias("a"))))
        .withColumn("_known", F.last("_state", ignorenulls=True).over(before))
        .withColumn("_leading", ~F.max("_break").over(upto))
        .withColumn("_conflict", ~F.col("_break") & F.coalesce(F.col("_a") != F.col("_known.a"), F.lit(False)))
        .withColumn("_local_start", F.col("_break") | F.col("_conflict"))
        .withColumn("_first_address", F.col("_leading") & F.col("_a").isNotNull() & F.col("_known").isNull())
    )

    # Across cells: one row per cell decides how its first rows relate to what came before.
    cells = rows.groupBy(*order.keys, SPAN).agg(
        F.min_by(F.struct(clock.alias("t"), F.col("_d").alias("d")), "_key").alias("_first"),
        F.max_by(F.struct(clock.alias("t"), F.col("_d").alias("d")), "_key").alias("_last"),
        F.min("_key").alias("_first_key"),
        F.max(F.when(F.col("_first_address"), F.struct(F.col("_key").alias("k"), F.col("_a").alias("a")))).alias("_lead"),
        F.max("_break").alias("_broken"),
        F.max_by("_state", F.when(F.col("_state").isNotNull(), F.col("_key"))).alias("_tail"),
        F.max(F.when(F.col("_local_start"), F.col("_key"))).alias("_last_start"),
    )
    spans = Window.partitionBy(*order.keys).orderBy(SPAN)
    cells = (
        cells.withColumn("_before", F.lag("_last").over(spans))
        .withColumn(
            "_lead_break",
            F.col("_before").isNull()
            | ~F.col("_before.d").eqNullSafe(F.col("_first.d"))
            | F.coalesce(F.col("_first.t") - F.col("_before.t") > F.lit(gap_ms), F.lit(False)),
        )
        .withColumn(
            "_out",
            F.when(F.col("_lead_break") | F.col("_broken"), F.struct(F.col("_tail.a").alias("a"))).otherwise(F.col("_tail")),
        )
        .withColumn("_in", F.last("_out", ignorenulls=True).over(order.over_spans()))
        .withColumn("_lead_conflict", ~F.col("_lead_break") & F.coalesce(F.col("_lead.a") != F.col("_in.a"), F.lit(False)))
        .withColumn(
            "_span_start",
            F.greatest(
                F.col("_last_start"),
                F.when(F.col("_lead_conflict"), F.col("_lead.k")),
                F.when(F.col("_lead_break"), F.col("_first_key")),
            ),
        )
        .withColumn("_start_in", F.last("_span_start", ignorenulls=True).over(order.over_spans()))
        .select(
            *order.keys, SPAN, "_start_in",
            F.when(F.col("_lead_break"), F.col("_first_key")).alias("_fix_first"),
            F.when(F.col("_lead_conflict"), F.col("_lead.k")).alias("_fix_address"),
        )
    )
    starts = (
        F.col("_local_start")
        | F.coalesce(F.col("_key") == F.col("_fix_first"), F.lit(False))
        | F.coalesce(F.col("_key") == F.col("_fix_address"), F.lit(False))
    )
    helper = [c for c in rows.columns if c.startswith("_") and c not in df.columns and c not in (SPAN, "_key", "_local_start")]
    joined = order.attach(rows.drop(*helper), cells).withColumn("_start", F.when(starts, F.col("_key")))
    return joined.withColumn(
        "session_start", F.coalesce(F.last("_start", ignorenulls=True).over(upto), F.col("_start_in"))
    ).drop(SPAN, "_key", "_local_start", "_start", "_start_in", "_fix_first", "_fix_address")


def fill_from_key(df: DataFrame, keys: list[str], optional: str, order_key: Column, columns: list[str]) -> DataFrame:
    """Fill empty columns with the last non-empty value of the same key over the whole scan.

    Rows whose ``optional`` key part is NULL belong to no key and stay as they are. The lookup side is aggregated to
    one row per key; a hot key on the row side is split by the adaptive skew join, and keyless rows are spread by hash
    instead of meeting in one task.
    """
    latest = df.filter(F.col(optional).isNotNull()).groupBy(*keys, F.col(optional).alias("_k")).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), order_key)).alias(f"_last_{c}") for c in columns]
    )
    keyless = F.concat(F.lit("\u0000"), F.xxhash64(order_key).cast("string"))
    joined = df.withColumn("_k", F.coalesce(F.col(optional), keyless)).join(latest, [*keys, "_k"], "left")
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(c, f"_last_{c}"))
    return joined.select(*df.columns)


def first_per_key(df: DataFrame, keys: list[str], order_key: Column, last: bool = False) -> DataFrame:
    """One whole row per key by scan order, as an aggregate: partial results meet before the shuffle."""
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)]).agg(pick(row, order_key).alias("_row")).select("_row.*")


def top_per_key(df: DataFrame, keys: list[str], order_by: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows per key; the rank filter is pruned inside each input partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).drop("_rank")
