"""Scheduled-task and error-report review, bitmap fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import tags, times
from caseloom.functions import text as tx
from caseloom.functions.core import any_of, blank_to_null, text, with_computed
from caseloom.schemas import overview_columns


def task_overview(tasks: DataFrame, keys: list[str]) -> DataFrame:
    """Task columns with the publisher flag: system folder or an author that names the vendor."""
    vendor = F.lower(text("uri")).startswith("\\microsoft\\") | F.lower(text("author")).contains("microsoft")
    rows = tasks.withColumn("is_microsoft", F.when(vendor, "1"))
    present = [c for c in overview_columns("ScheduledTasks") if c in rows.columns]
    return rows.select(*keys, *present, *[c for c in ("_rowid",) if c in rows.columns])


def task_review(overview: DataFrame) -> DataFrame:
    found = tags.path_tags("actions")
    hidden = F.coalesce(tx.truth_value("hidden"), F.lit(False))
    return overview.select(
        "*", F.coalesce(blank_to_null("task_name"), F.lit("(no name)")).alias("shown_name"), (text("is_microsoft") == "1").alias("vendor"),
        tx.truth_value("enabled").alias("is_enabled"), hidden.alias("is_hidden"), found.alias("tags"),
        (hidden | (F.size(found) > 0)).alias("review"),
    )


def task_filter(reviewed: DataFrame, kind: str = "all", search: str = "", start: str | None = None, end: str | None = None) -> DataFrame:
    rows = reviewed.filter(times.in_range("timestamp", start, end))
    chosen = {"user": ~F.col("vendor"), "review": F.col("review"), "hidden": F.col("is_hidden")}.get(kind)
    if chosen is not None:
        rows = rows.filter(chosen)
    if search.strip():
        rows = rows.filter(any_of([tx.contains_folded(c, search.strip()) for c in ("shown_name", "actions", "run_as", "trigger_types", "author")]))
    return rows


def task_order() -> list[Column]:
    return [F.desc("review"), F.asc("vendor"), F.asc("shown_name")]


def task_counts(reviewed: DataFrame, keys: list[str]) -> DataFrame:
    return reviewed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("vendor")).alias("user_tasks"),
        F.count_if("review").alias("review_tasks"), F.count_if("is_hidden").alias("hidden_tasks"),
    )


def report_review(reports: DataFrame) -> DataFrame:
    """Name, path, type and severity class, from the promoted columns or else from the report itself."""
    d = ed.payload("report", ["AppName", "AppPath", "EventType", "FriendlyEventName", "ReportIdentifier"])
    rows = with_computed(reports, "_d", d)
    inner = lambda c: blank_to_null(F.col(f"_d.{c}"))
    path = F.coalesce(blank_to_null("AppPath"), inner("AppPath"))
    name = F.coalesce(blank_to_null("AppName"), inner("AppName"), blank_to_null(tx.trimmed_basename(path)))
    kind = F.coalesce(blank_to_null("EventType"), inner("EventType"))
    return rows.select(
        *[c for c in reports.columns], name.alias("app_name"), path.alias("app_path"), kind.alias("event_type"),
        inner("FriendlyEventName").alias("friendly"), inner("ReportIdentifier").alias("report_id"), tags.report_tone(kind).alias("tone"),
    )


def report_filter(reviewed: DataFrame, event_type: str | None = None, search: str = "") -> DataFrame:
    rows = reviewed.filter(F.col("event_type") == event_type) if event_type else reviewed
    if search.strip():
        rows = rows.filter(any_of([tx.contains_folded(c, search.strip()) for c in ("app_name", "app_path", "event_type", "friendly", "report_id")]))
    return rows


def bitmap_fragments(cache: DataFrame) -> DataFrame:
    return cache.filter(F.col("kind") == "fragment")
