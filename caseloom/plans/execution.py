"""Program execution history and its review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import hexbin, tags, times
from caseloom.functions import text as tx
from caseloom.functions.core import any_of, blank_to_null, text, with_computed
from caseloom.operators import ordered
from caseloom.plans.common import HOST, overview_row, union_all
from caseloom.sources.raw import SCAN_TIES, hive, record_key, scan_seq, source_stem, user_hives

# Session markers of the usage counter, executable endings.
USAGE_MARKERS = ["UEME_CTLSESSION", "UEME_CTLCUACount:ctor"]
EXECUTABLE = r"(?i)\.(exe|dll|sys|scr|com|bat|cmd|ps1|vbs|js|jse|wsf|hta|msi)$"


def usage_counters(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """UserAssist values: rotated names, counters at fixed offsets when the record is long enough."""
    rows = user_hives(registry).filter(
        F.contains("key_path", F.lit("UserAssist")) & F.col("key_path").endswith("\\Count") & ~text("value_name").isin("", "(default)")
    )
    rows = rows.withColumn("_path", tx.rot13("value_name")).filter(~F.col("_path").isin(*USAGE_MARKERS))
    h = F.col("_hex")
    full = F.length(h) >= 2 * 68
    rows = with_computed(with_computed(rows, "_hex", hexbin.clean_hex("value_data")), "_ts", F.when(full, hexbin.filetime_at(h, 60)))
    number = lambda at: F.when(full, hexbin.le_uint(h, at, 4))
    user = F.regexp_replace("hive", r"(?i)_NTUSER\.DAT$", "")
    return overview_row(
        rows, "ExecutionHistory", [*keys, *SCAN_TIES], timestamp=F.col("_ts"),
        program_name=tx.last_segment("_path"), program_path=F.col("_path"), run_count=number(4), focus_count=number(8),
        focus_time_ms=number(12), user=user, source_artifact="UserAssist", record_key=record_key("Registry", F.col("hive")),
    )


def activity_moderator(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """BAM values: the executable is the value name, the time sits at offset 0, the account is in the key."""
    low = F.lower(text("key_path"))
    rows = hive(registry, "SYSTEM").filter(
        low.contains("\\services\\bam") & low.contains("\\usersettings\\") & F.lower(text("value_name")).endswith(".exe")
    )
    h = F.col("_hex")
    rows = with_computed(rows, "_hex", hexbin.clean_hex("value_data"))
    rows = with_computed(rows, "_ts", F.when(F.length(h) >= 16, hexbin.filetime_at(h, 0)))
    sid = F.substring_index(F.regexp_extract("key_path", r"^(?:[\s\S]*UserSettings\\)?([\s\S]*)$", 1), "\\", 1)
    return overview_row(
        rows, "ExecutionHistory", [*keys, *SCAN_TIES], timestamp=F.col("_ts"),
        program_name=tx.last_segment("value_name"), program_path=F.col("value_name"), user=blank_to_null(sid),
        source_artifact="BAM", record_key=record_key("Registry", F.col("hive")),
    )


def first_sightings(usage: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Earliest sighting of each (app, user). A row without a time never wins over a timed one; ties keep the first seen."""
    table = "SRUM_ApplicationResourceUsage"
    rows = usage.filter((text("app") != "") & ~F.lower("app").startswith("svc."))
    rows = rows.withColumn("_key", record_key(table, source_stem())).withColumn("_user", text("user"))
    rank = F.struct(F.coalesce(blank_to_null("timestamp"), F.lit("~")).alias("t"), scan_seq().alias("s"))
    first = rows.groupBy(*keys, "app", "_user").agg(F.min_by(F.struct("timestamp", "_key", *SCAN_TIES), rank).alias("r"))
    return overview_row(
        first.select("*", *[F.col(f"r.{c}").alias(c) for c in SCAN_TIES]), "ExecutionHistory", [*keys, *SCAN_TIES],
        timestamp=blank_to_null("r.timestamp"), program_name=F.coalesce(blank_to_null(tx.last_segment("app")), F.col("app")),
        program_path=F.col("app"), user=blank_to_null("_user"), source_artifact="SRUM", record_key=F.col("r._key"),
    )


def inventory(programs: DataFrame, files: DataFrame, keys: list[str] = HOST) -> DataFrame:
    extra = [*keys, *SCAN_TIES]
    return union_all([
        overview_row(
            programs, "ExecutionHistory", extra, timestamp=F.col("timestamp"), program_name=blank_to_null("Name"),
            program_path=blank_to_null("RootDirPath"), publisher=blank_to_null("Publisher"), source_artifact="Amcache_Programs",
            record_key=record_key("Amcache_Programs", source_stem()),
        ),
        overview_row(
            files, "ExecutionHistory", extra, timestamp=F.col("timestamp"), program_name=blank_to_null("name"),
            program_path=blank_to_null("lower_case_long_path"), publisher=blank_to_null("publisher"), sha1=blank_to_null("SHA1"),
            source_artifact="Amcache_Files", record_key=record_key("Amcache_Files", source_stem()),
        ),
    ])


def prefetch(runs: DataFrame, keys: list[str] = HOST) -> DataFrame:
    same = ["prefetch_hash", *[f"run_time_{i}" for i in range(2, 9)], "volume_device_path", "volume_serial_number", "volume_creation_time", "run_count"]
    return overview_row(
        runs, "ExecutionHistory", [*keys, *SCAN_TIES], timestamp=blank_to_null("last_run_time"),
        program_name=blank_to_null("executable_filename"), source_artifact="Prefetch", source_file=F.col("_source_file"),
        record_key=record_key("Prefetch_Execution", F.lit("Prefetch_Execution")), **{c: blank_to_null(c) for c in same},
    )


def execution_history(programs: DataFrame, files: DataFrame, registry: DataFrame, usage: DataFrame, runs: DataFrame, keys: list[str] = HOST) -> DataFrame:
    return union_all([
        inventory(programs, files, keys), usage_counters(registry, keys), first_sightings(usage, keys),
        activity_moderator(registry, keys), prefetch(runs, keys),
    ])


def source_group() -> Column:
    """Evidence family of an execution row."""
    raw = F.lower(F.trim(text("source_artifact")))
    return F.when(raw.startswith("amcache"), "amcache").when(raw.isin("userassist", "prefetch", "srum", "bam"), raw).otherwise("other")


def review(history: DataFrame) -> DataFrame:
    """Review columns: shown name, missing publisher, tags, risk, system path."""
    path = text("program_path")
    name = F.coalesce(blank_to_null("program_name"), blank_to_null(tx.trimmed_basename(path)), F.lit("(no name)"))
    publisher = F.trim(text("publisher"))
    source = F.when(text("source_artifact").startswith("Amcache"), "Amcache").otherwise(text("source_artifact"))
    executable = name.rlike(EXECUTABLE) | path.rlike(EXECUTABLE)
    unsigned = (source == "Amcache") & executable & (publisher == "")
    return history.select(
        "*", name.alias("shown_name"), source.alias("source"), unsigned.alias("unsigned"), tags.path_tags(path).alias("tags"),
        tags.is_windows_path(path).alias("system_path"),
    ).withColumn("risk", tags.risk_of(F.col("tags"), F.col("unsigned")))


def review_filter(
    reviewed: DataFrame, hidden_sources: tuple[str, ...] = (), exclude_system: bool = False, only_risk: bool = False,
    only_unsigned: bool = False, search: str = "", start: str | None = None, end: str | None = None,
) -> DataFrame:
    rows = reviewed.filter(times.in_range("timestamp", start, end))
    if hidden_sources:
        rows = rows.filter(~F.col("source").isin(*hidden_sources))
    if exclude_system:
        rows = rows.filter(~F.col("system_path"))
    if only_risk:
        rows = rows.filter(F.col("risk") > 0)
    if only_unsigned:
        rows = rows.filter("unsigned")
    if search.strip():
        fields = ["shown_name", "program_path", "publisher", "user", "source"]
        rows = rows.filter(any_of([tx.contains_folded(c, search.strip()) for c in fields]))
    return rows


def review_order(sort: str = "oldest") -> list[Column]:
    """``risk`` puts the risky first and then the newest; ``recent`` and ``oldest`` go by time."""
    ts = text("timestamp")
    if sort == "risk":
        return [F.desc("risk"), ts.desc(), F.col("record_key")]
    return [ts.desc() if sort == "recent" else ts.asc(), F.col("record_key")]


def source_counts(reviewed: DataFrame, keys: list[str] = HOST) -> DataFrame:
    return reviewed.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("rows"))
