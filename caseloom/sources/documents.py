"""Text and XML evidence: console history, error reports, scheduled-task files. One input file is one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import times
from caseloom.functions.core import blank_to_null, col, with_computed
from caseloom.functions.text import last_segment

# Folders that are not an account name.
SKIPPED_FOLDERS = ["psreadline", "powershell", "windows", "microsoft", "roaming", "appdata", "local"]
REPORT_KEY = r"^[A-Za-z0-9_.\[\]]+$"
REPORT_INDEX = r"^([A-Za-z0-9_.]+)\[([0-9]+)\](?:\.([A-Za-z0-9_.]+))?$"


def history_user(path: Column | str) -> Column:
    """First folder above the file that is not part of the standard layout."""
    parts = F.reverse(F.split(col(path), r"[\\/]"))
    named = F.filter(parts, lambda f, i: (i > 0) & (f != "") & ~F.lower(f).isin(*SKIPPED_FOLDERS))
    return F.get(named, F.lit(0))


def console_history(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """One row per non-empty line; blank lines still count in the numbering. An unreadable file leaves a status row."""
    keys = [c for c in files.columns if c not in (path, content)]
    lines = files.select(
        *keys, F.col(path).alias("_source_file"), history_user(path).alias("user"),
        F.col(content).isNull().alias("_unreadable"),
        F.posexplode_outer(F.split(F.col(content), r"\r\n|\r|\n")).alias("_at", "command"),
    )
    return lines.filter(F.col("_unreadable") | (F.col("command") != "")).select(
        *keys, (F.col("_at") + 1).alias("line_number"), "command", "user", "_source_file",
        F.when(F.col("_unreadable"), "unreadable_file").alias("_status"),
    )


def _quoted(value: Column) -> Column:
    """A JSON string literal; only text that needs escaping goes through the JSON writer."""
    encoded = F.to_json(F.struct(value.alias("v")))
    escaped = F.substr(encoded, F.lit(6), F.length(encoded) - 6)
    return F.when(value.rlike('[\\x00-\\x1f"\\\\]'), escaped).otherwise(F.concat(F.lit('"'), value, F.lit('"')))


def _last_by_key(pairs: Column) -> Column:
    """(k, v) pairs with keys in first-seen order and the last value of each key."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.transform(
        keys, lambda k: F.struct(k.alias("k"), F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"].alias("v"))
    )


def _json_object(pairs: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(p["k"]), F.lit(": "), p["v"])), ", "), F.lit("}"))


def report_lines(text: Column) -> Column:
    """Valid ``key=value`` lines as (key, value, family, index, member)."""
    lines = F.filter(F.split(F.regexp_replace(text, "^﻿+", ""), r"\r?\n"), lambda x: x.contains("="))
    parsed = F.transform(
        lines,
        lambda x: F.struct(
            F.trim(F.substring_index(x, "=", 1)).alias("key"),
            F.trim(F.substr(x, F.locate("=", x) + 1)).alias("value"),
        ),
    )
    indexed = lambda p: p["key"].contains("[") & p["key"].rlike(REPORT_INDEX)
    valid = F.filter(parsed, lambda p: p["key"].rlike(REPORT_KEY))
    return F.transform(
        valid,
        lambda p: F.struct(
            p["key"].alias("key"), p["value"].alias("value"),
            F.when(indexed(p), F.substring_index(p["key"], "[", 1)).alias("family"),
            F.when(indexed(p), F.substring_index(F.substring_index(p["key"], "]", 1), "[", -1).try_cast("bigint")).alias("index"),
            F.when(indexed(p) & p["key"].contains("]."), F.substring_index(p["key"], "].", -1)).alias("member"),
        ),
    )


def _family_array(own: Column) -> Column:
    """JSON array of the lines of one family by index. A plain value replaces what came before; members build an object."""
    indexes = F.array_sort(F.array_distinct(F.transform(own, lambda p: p["index"])))
    empty = F.struct(
        F.lit(None).cast("string").alias("plain"),
        F.array().cast("array<struct<k:string,v:string>>").alias("members"),
    )

    def fold(acc: Column, p: Column) -> Column:
        member = F.struct(p["member"].alias("k"), _quoted(p["value"]).alias("v"))
        with_member = F.struct(F.lit(None).cast("string").alias("plain"), F.concat(acc["members"], F.array(member)).alias("members"))
        plain = F.struct(p["value"].alias("plain"), F.array().cast("array<struct<k:string,v:string>>").alias("members"))
        return F.when(p["member"].isNull(), plain).otherwise(with_member)

    def slot(index: Column) -> Column:
        return F.aggregate(
            F.filter(own, lambda p: p["index"] == index), empty, fold,
            lambda acc: F.when(acc["plain"].isNotNull(), _quoted(acc["plain"])).otherwise(_json_object(_last_by_key(acc["members"]))),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(indexes, slot), ", "), F.lit("]"))


def error_reports(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """One row per report: promoted columns plus the whole report as JSON (scalars, then families as arrays).

    A report stays one row from start to end, so nothing is shuffled.
    """
    keys = [c for c in files.columns if c not in (path, content)]
    named = files.select(*keys, F.col(path).alias("_source_file"), F.col(content).alias("_text"))
    lines = with_computed(named, "_lines", report_lines(F.col("_text"))).withColumn("_bad", F.col("_text").isNull()).drop("_text")
    scalars = F.transform(
        F.filter("_lines", lambda p: p["family"].isNull()), lambda p: F.struct(p["key"].alias("k"), p["value"].alias("v"))
    )
    # every list is made once, as what stands inside a lambda is computed for each element
    single = with_computed(lines, "_pairs", scalars)
    rows = with_computed(single, "_scalars", _last_by_key(F.col("_pairs")))
    rows = with_computed(rows, "_indexed", F.filter("_lines", lambda p: p["family"].isNotNull()))
    family = F.array_distinct(F.transform("_indexed", lambda p: p["family"]))
    rows = with_computed(rows, "_families", F.transform(
        family, lambda f: F.struct(f.alias("k"), F.filter("_indexed", lambda p: p["family"] == f).alias("own"))))
    pick = lambda name: blank_to_null(F.get(F.filter("_scalars", lambda p: p["k"] == name), F.lit(0))["v"])
    scalar_json = F.transform("_scalars", lambda p: F.struct(p["k"].alias("k"), _quoted(p["v"]).alias("v")))
    family_json = F.transform("_families", lambda f: F.struct(f["k"].alias("k"), _family_array(f["own"]).alias("v")))
    return rows.select(
        *keys,
        times.filetime(pick("EventTime").try_cast("bigint")).alias("timestamp"),
        *[pick(c).alias(c) for c in ("EventType", "AppName", "AppPath", "TargetAppId", "ReportIdentifier")],
        F.when(~F.col("_bad"), _json_object(F.concat(scalar_json, family_json))).alias("report"),
        "_source_file",
        F.when(F.col("_bad"), "unreadable_file").alias("_status"),
    )


TASK_SCHEMA = (
    "RegistrationInfo struct<URI:string,Date:string,Author:string,Description:string>, "
    "Settings struct<Enabled:string,Hidden:string>, "
    "Principals struct<Principal:array<struct<UserId:string,GroupId:string,RunLevel:string,LogonType:string>>>, "
    "_corrupt string"
)


def _body(xml: Column, element: str) -> Column:
    return F.regexp_extract(xml, rf"(?s)<(?:\w+:)?{element}\b[^>]*>(.*?)</(?:\w+:)?{element}>", 1)


def _unescape(value: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return value


def _child(item: Column, element: str) -> Column:
    return F.trim(_unescape(F.regexp_extract(item, rf"(?s)<(?:\w+:)?{element}\b[^>]*>(.*?)</", 1)))


def _children(body: Column) -> Column:
    """Direct child elements in document order, as XML text."""
    return F.regexp_extract_all(body, F.lit(r"(?s)<((?:\w+:)?\w+)\b[^>]*?(?:/>|>.*?</\1>)"), F.lit(0))


def _local_name(item: Column) -> Column:
    return F.regexp_extract(item, r"^<(?:\w+:)?(\w+)", 1)


def scheduled_tasks(files: DataFrame, path: str = "path", content: str = "text") -> DataFrame:
    """One row per task file. A broken file becomes a row with a status instead of failing the job."""
    keys = [c for c in files.columns if c not in (path, content)]
    xml = F.trim(F.regexp_replace(F.regexp_replace(F.col(content), "^﻿", ""), r"(?s)^<\?xml.*?\?>", ""))
    parsed = F.from_xml("_xml", TASK_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "rowTag": "Task"})
    rows = with_computed(files.select(*keys, F.col(path).alias("_source_file"), xml.alias("_xml")), "_t", parsed)
    info, settings = F.col("_t.RegistrationInfo"), F.col("_t.Settings")
    principal = F.get(F.col("_t.Principals.Principal"), F.lit(0))

    def action(item: Column) -> Column:
        name = _local_name(item)
        command = F.trim(F.concat(_child(item, "Command"), F.lit(" "), _child(item, "Arguments")))
        return F.when(name == "Exec", command).when(name == "ComHandler", F.concat(F.lit("COM:"), _child(item, "ClassId"))).otherwise(name)

    actions = F.filter(F.transform(_children(_body(F.col("_xml"), "Actions")), action), lambda a: a != "")
    triggers = _children(_body(F.col("_xml"), "Triggers"))
    starts = F.filter(F.transform(triggers, lambda t: _child(t, "StartBoundary")), lambda s: s != "")
    leaf = last_segment(F.regexp_replace(F.trim(info["URI"]), r"\\+$", ""))
    trimmed = lambda c: blank_to_null(F.trim(c))
    bad = F.col("_t").isNull() | F.col("_t._corrupt").isNotNull()
    return rows.select(
        *keys,
        times.zoned_or_local_time(info["Date"]).alias("timestamp"),
        F.coalesce(blank_to_null(leaf), last_segment("_source_file")).alias("task_name"),
        trimmed(settings["Enabled"]).alias("enabled"),
        trimmed(settings["Hidden"]).alias("hidden"),
        F.coalesce(trimmed(principal["UserId"]), trimmed(principal["GroupId"])).alias("run_as"),
        trimmed(principal["RunLevel"]).alias("run_level"),
        blank_to_null(F.array_join(actions, " | ")).alias("actions"),
        blank_to_null(F.array_join(F.transform(triggers, _local_name), ", ")).alias("trigger_types"),
        times.zoned_or_local_time(F.get(starts, F.lit(0))).alias("trigger_start"),
        trimmed(info["Author"]).alias("author"),
        trimmed(info["Description"]).alias("description"),
        trimmed(principal["LogonType"]).alias("logon_type"),
        trimmed(info["URI"]).alias("uri"),
        "_source_file",
        F.when(bad, "corrupted").otherwise("ok").alias("_status"),
    )
