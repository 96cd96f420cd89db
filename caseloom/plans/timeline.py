"""One timeline over all evidence with a defensible time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import lookups, tags, times
from caseloom.functions import text as tx
from caseloom.functions.core import blank_to_null, text, with_computed
from caseloom.plans.common import HOST, union_all
from caseloom.plans.execution import source_group

LOGON_EVENTS = ["4624", "4625", "4648"]
COLUMNS = ["timestamp", "category", "table_name", "facet", "title", "subtitle", "tags", "_source_file", "_rowid"]


def _entries(df: DataFrame, keys: list[str], category: str, table: Column | str, facet: Column | None, title: Column,
             subtitle: Column, found: Column, ts: str = "timestamp") -> DataFrame:
    """One source as timeline entries; untimed rows have no place on a timeline."""
    return df.filter(F.trim(text(ts)) != "").select(
        *keys, F.trim(ts).alias("timestamp"), F.lit(category).alias("category"),
        (F.lit(table) if isinstance(table, str) else table).alias("table_name"),
        (F.lit(None).cast("string") if facet is None else facet).alias("facet"),
        title.alias("title"), subtitle.alias("subtitle"), found.alias("tags"), "_source_file", "_rowid",
    )


def execution_entries(history: DataFrame, keys: list[str] = HOST) -> DataFrame:
    path = F.col("program_path")
    amcache = source_group() == "amcache"
    label = F.when(amcache, "Amcache").otherwise(F.coalesce(blank_to_null("source_artifact"), F.lit("ExecutionHistory")))
    found = F.when(amcache, F.concat(tags.path_tags(path), tags.missing_publisher_tags("publisher"))).otherwise(tags.path_tags(path))
    title = F.coalesce(blank_to_null("program_name"), blank_to_null(tx.last_segment(path)), F.lit("(no name)"))
    return _entries(history, keys, "_OVERVIEW", "ExecutionHistory", source_group(), title, F.concat_ws(" · ", label, blank_to_null(path)), found)


def task_entries(tasks: DataFrame, keys: list[str] = HOST) -> DataFrame:
    title = F.coalesce(blank_to_null("task_name"), F.lit("(no name)"))
    return _entries(tasks, keys, "_OVERVIEW", "ScheduledTasks", None, title, text("timestamp"), tags.path_tags("actions"))


def browser_entries(activity: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Visits and downloads; a cached response is not a browsing event."""
    kind = F.col("kind")
    rows = activity.filter(kind.isin("visit", "download"))
    found = F.concat(tags.danger_type_tags("danger"), F.when(kind == "download", tags.path_tags("detail")).otherwise(tags.no_tags()))
    title = F.coalesce(blank_to_null("url"), blank_to_null("url_raw"), blank_to_null("title"), F.lit("(no address)"))
    return _entries(rows, keys, "_OVERVIEW", "BrowserActivity", kind, title, F.initcap(kind), found)


def event_title() -> Column:
    base = F.concat(F.lit("Event "), text("EventID"), F.coalesce(F.concat(F.lit(" · "), F.col("event_label")), F.lit("")))
    logon = blank_to_null("_d.LogonType")
    name = F.when(F.lit(False), F.lit(""))
    for code, word in ed.LOGON_TYPES.items():
        name = name.when(logon == code, word)
    kind = F.coalesce(F.concat(name, F.lit(" (type "), logon, F.lit(")")), F.concat(F.lit("type "), logon))
    return F.when(F.col("EventID").isin(*LOGON_EVENTS) & logon.isNotNull(), F.concat(base, F.lit(" · "), kind)).otherwise(base)


def event_entries(events: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Event number 0 is a provider's own heartbeat and stays off the timeline."""
    rows = with_computed(lookups.with_catalog(events.filter(F.trim(text("EventID")) != "0")), "_d", tags.tag_payload("EventData"))
    found = F.concat(tags.level_tags("LevelName"), tags.security_tags("Provider", "EventID", F.col("_d")))
    return _entries(rows, keys, "EVENTLOG", F.col("log"), None, event_title(), F.concat_ws(" · ", blank_to_null("Provider"), blank_to_null("Channel")), found)


def link_entries(links: DataFrame, keys: list[str] = HOST) -> DataFrame:
    target = F.col("target_path")
    title = F.coalesce(blank_to_null(tx.last_segment(target)), blank_to_null(target), blank_to_null("app_id"), F.lit("JumpList entry"))
    return _entries(links, keys, "JUMPLIST", "JumpList_Entries", None, title, text(target), tags.path_tags(target))


def master_timeline(*, execution: DataFrame | None = None, tasks: DataFrame | None = None, activity: DataFrame | None = None,
                    events: DataFrame | None = None, links: DataFrame | None = None, keys: list[str] = HOST,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Union of the given sources. A range is applied inside each branch, so it reaches every scan."""
    def ranged(df: DataFrame) -> DataFrame:
        return df.filter(times.in_range("timestamp", start, end))

    branches = [
        build(ranged(df), keys)
        for build, df in (
            (execution_entries, execution), (task_entries, tasks), (browser_entries, activity), (event_entries, events), (link_entries, links),
        )
        if df is not None
    ]
    return union_all(branches)


def filter_timeline(timeline: DataFrame, hidden_tables: tuple[str, ...] = (), hidden_sources: tuple[str, ...] = (),
                    hidden_kinds: tuple[str, ...] = (), only_tagged: bool = False,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    rows = timeline.filter(times.in_range("timestamp", start, end))
    facet = text("facet")
    if hidden_tables:
        rows = rows.filter(~F.col("table_name").isin(*hidden_tables))
    if hidden_sources:
        rows = rows.filter(~((F.col("table_name") == "ExecutionHistory") & facet.isin(*hidden_sources)))
    if hidden_kinds:
        rows = rows.filter(~((F.col("table_name") == "BrowserActivity") & facet.isin(*hidden_kinds)))
    return rows.filter(F.size("tags") > 0) if only_tagged else rows


def timeline_order(descending: bool = False) -> list[Column]:
    ts = F.col("timestamp")
    return [ts.desc_nulls_last() if descending else ts.asc_nulls_last(), F.col("table_name"), F.col("_source_file"), F.col("_rowid")]


def facet_counts(timeline: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Rows per table and, where a table has one, per facet."""
    return timeline.groupBy(*keys, "category", "table_name", "facet").agg(F.count(F.lit(1)).alias("rows"))


def time_points(rows: DataFrame, keys: list[str], points: dict[str, str]) -> DataFrame:
    """Labelled times of a record as rows in order with their place in the record's span; one time alone is no line."""
    entries = F.filter(
        F.array(*[F.struct(times.epoch_millis(column).alias("ms"), F.lit(label).alias("label"), F.col(column).alias("value")) for column, label in points.items()]),
        lambda p: p["ms"].isNotNull(),
    )
    ordered = rows.select(*keys, F.array_sort(entries).alias("_p")).filter(F.size("_p") >= 2)
    low, high = F.get("_p", F.lit(0))["ms"], F.element_at("_p", -1)["ms"]
    span = F.greatest(high - low, F.lit(1))
    return ordered.select(*keys, low.alias("_low"), span.alias("_span_ms"), F.posexplode("_p").alias("position", "p")).select(
        *keys, "position", F.col("p.label").alias("label"), F.col("p.value").alias("value"),
        F.round((F.col("p.ms") - F.col("_low")) * 100.0 / F.col("_span_ms"), 3).alias("percent"),
    )
