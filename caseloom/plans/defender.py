"""Antivirus history: threats, tampering, scans, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import tags, times
from caseloom.functions.core import any_of, blank_to_null, text, with_computed
from caseloom.operators import ordered
from caseloom.plans.common import HOST, overview_row, union_all
from caseloom.sources.raw import SCAN_TIES, logs_named, scan_seq

# Event numbers, configuration keys, texts that mean "nothing".
DETECTIONS = ["1116", "1006", "1015"]
ACTIONS = ["1117", "1007"]
SETTING_KEYS = [
    "disableantispyware", "disableantivirus", "disablerealtimemonitoring", "disablebehaviormonitoring",
    "disableioavprotection", "disableonaccessprotection", "disablescanonrealtimeenable", "tamperprotection", "exclusions",
    "disableblockatfirstseen", "puaprotection", "disablescriptscanning",
]
NO_ACTION = "해당 없음"
NO_FURTHER_ACTIONS = "No additional actions required"
FIELDS = [
    "Detection ID", "Threat Name", "Severity Name", "Category Name", "Process Name", "Detection User", "Source Name",
    "Origin Name", "Path", "Action Name", "Remediation User", "Additional Actions String", "Domain", "User",
    "Scan Parameters", "Scan Type", "Current security intelligence Version", "New Value", "Old Value",
]
RELEVANT = [*DETECTIONS, *ACTIONS, "5000", "5001", "5004", "5007", "5010", "5012", "1119", "1013", "1001", "2000"]


def defender_events(events: DataFrame) -> DataFrame:
    """Relevant antivirus events with their payload parsed once."""
    rows = logs_named(events, "defender").filter(F.col("EventID").isin(*RELEVANT))
    return with_computed(rows, "_d", ed.payload("EventData", FIELDS))


def _f(name: str) -> Column:
    return blank_to_null(F.col(f"_d.`{name}`"))


def _user() -> Column:
    return blank_to_null(F.regexp_replace(F.concat(text(_f("Domain")), F.lit("\\"), text(_f("User"))), r"^\\+|\\+$", ""))


def threats(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per detection: per field the last non-empty value, the earliest detection, the last action.

    Everything is an aggregate with a partial step, so a detection repeated millions of times stays cheap.
    """
    seq = scan_seq()
    hits = rows.filter(F.col("EventID").isin(*DETECTIONS, *ACTIONS)).withColumn(
        "_id", F.coalesce(_f("Detection ID"), F.concat(text("timestamp"), F.lit("|"), text(_f("Threat Name"))))
    )
    found, acted = F.col("EventID").isin(*DETECTIONS), F.col("EventID").isin(*ACTIONS)
    last = lambda value, when=F.lit(True): F.max_by(value, F.when(value.isNotNull() & when, seq))
    action = F.when(_f("Action Name") != NO_ACTION, _f("Action Name"))
    further = F.when(_f("Additional Actions String") != NO_FURTHER_ACTIONS, _f("Additional Actions String"))
    timed = F.col("timestamp").isNotNull()
    merged = hits.groupBy(*keys, "_id").agg(
        F.min_by("EventID", seq).alias("event_id"),
        last(_f("Threat Name")).alias("title"), last(_f("Severity Name")).alias("severity"),
        last(_f("Category Name")).alias("category"), last(_f("Process Name")).alias("process"),
        last(_f("Detection User")).alias("user"), last(_f("Source Name")).alias("source"), last(_f("Origin Name")).alias("origin"),
        last(F.coalesce(_f("Path"), _f("Process Name"))).alias("detail"),
        F.max_by("timestamp", F.when(acted, seq)).alias("action_time"),
        last(action, acted).alias("action"), last(_f("Remediation User"), acted).alias("remediation"),
        last(further, acted).alias("additional_actions"),
        # Candidates for the threat time: every detection, and the first timed event even when that one is an action.
        F.min(F.when(timed, F.struct(seq.alias("seq"), found.alias("found"), F.col("timestamp").alias("ts")))).alias("_first"),
        F.min(F.when(found & timed, F.struct(F.col("timestamp").alias("ts"), seq.alias("seq"), F.col("_record_key").alias("rk")))).alias("_found"),
        F.min(F.when(acted & F.col("_record_key").isNotNull(), F.struct(seq.alias("seq"), F.col("_record_key").alias("rk")))).alias("_acted"),
    )
    by_detection = F.col("_first.found") | F.coalesce(F.col("_found.ts") < F.col("_first.ts"), F.lit(False))
    ready = merged.withColumn("_ts", F.when(by_detection, F.col("_found.ts")).otherwise(F.col("_first.ts"))).withColumn(
        "_rk", F.when(by_detection, F.col("_found.rk")).otherwise(F.col("_acted.rk"))
    )
    return overview_row(
        ready, "Defender", keys, section="threat", timestamp=F.col("_ts"), event_id=F.col("event_id"),
        title=F.col("title"), detail=F.col("detail"), severity=F.col("severity"), category=F.col("category"),
        action=F.coalesce("action", F.lit("detected only")), action_time=F.col("action_time"), process=F.col("process"),
        user=F.col("user"), detection_user=F.col("user"), source=F.col("source"), origin=F.col("origin"),
        remediation=F.col("remediation"), additional_actions=F.col("additional_actions"),
        record_key=F.col("_rk"),
    )


def protection_changes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Realtime protection reduced to state changes."""
    states = (
        rows.filter(F.col("EventID").isin("5000", "5001"))
        .withColumn("is_on", F.col("EventID") == "5000").withColumn("_t", F.coalesce(times.epoch_millis("timestamp"), F.lit(-1)))
        .withColumn("_k", text("_record_key"))
    )
    order = ordered.ScanOrder(tuple(keys), "_t", ("is_on", "_k", "_rowid"))
    return ordered.state_changes(states, order, "is_on")


def tampering(rows: DataFrame, keys: list[str]) -> DataFrame:
    e = F.col("EventID")
    blob = F.lower(F.concat(text(_f("New Value")), text(_f("Old Value"))))
    setting = any_of([blob.contains(k) for k in SETTING_KEYS])
    direct = rows.filter(e.isin("5004", "5010", "5012", "1119") | ((e == "5007") & setting))
    title = (
        F.when(e == "5004", "realtime protection configuration changed").when(e == "5010", "malware scanning disabled")
        .when(e == "5012", "spyware scanning disabled").when(e == "1119", "threat removal failed")
        .otherwise("protection configuration changed")
    )
    detail = (
        F.when(e == "5004", "realtime protection settings changed")
        .when(e == "1119", F.concat(text(_f("Threat Name")), F.lit(" removal failed")))
        .when(e == "5007", F.concat(text(_f("Old Value")), F.lit(" → "), text(_f("New Value"))))
    )
    branch = lambda df, **v: overview_row(df, "Defender", keys, section="tampering", timestamp=F.col("timestamp"), record_key=F.col("_record_key"), **v)
    changes = protection_changes(rows, keys)
    on = F.col("is_on")
    cleared = rows.filter(e == "1013").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(text("timestamp").alias("ts"), text(_user()).alias("user"), text("_record_key").alias("rk"))).alias("latest"),
    )
    return union_all([
        overview_row(
            cleared, "Defender", keys, section="tampering", timestamp=blank_to_null(F.col("latest.ts")), event_id="1013",
            title="scan and threat history cleared",
            detail=F.concat(F.lit("history cleared "), F.col("n").cast("string"), F.lit(" times, latest shown")),
            user=blank_to_null(F.col("latest.user")), record_key=blank_to_null(F.col("latest.rk")),
        ),
        branch(direct, event_id=e, title=title, detail=detail),
        branch(
            changes, event_id=F.when(on, "5000").otherwise("5001"),
            title=F.when(on, "realtime protection restored").otherwise("realtime protection off"),
            detail=F.when(on, "realtime protection was turned back on").otherwise("realtime protection was turned off"),
        ),
    ])


def scans(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Latest scan per scan kind; of equal times the first seen wins."""
    kind = F.coalesce(_f("Scan Parameters"), _f("Scan Type"), F.lit("scan"))
    done = rows.filter(F.col("EventID") == "1001").withColumn("_kind", kind).withColumn("_user", _user()).withColumn("_type", _f("Scan Type"))
    latest = _latest(done, [*keys, "_kind"])
    return overview_row(
        latest, "Defender", keys, section="scan", timestamp=F.col("timestamp"), event_id="1001", title=F.col("_kind"),
        detail=F.col("_type"), user=F.col("_user"), record_key=F.col("_record_key"),
    )


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row with the greatest time, the first in scan order among equals."""
    first = ordered.first_per_key(rows.withColumn("_at", text("timestamp")), [*keys, "_at"], scan_seq())
    return ordered.first_per_key(first, keys, F.col("_at"), last=True).drop("_at")


def signatures(rows: DataFrame, keys: list[str]) -> DataFrame:
    updates = rows.filter(F.col("EventID") == "2000").withColumn("_version", _f("Current security intelligence Version"))
    return overview_row(
        _latest(updates, keys), "Defender", keys, section="signature", timestamp=F.col("timestamp"), event_id="2000",
        title="security intelligence version", detail=F.col("_version"), record_key=F.col("_record_key"),
    )


def defender_history(events: DataFrame, keys: list[str] = HOST) -> DataFrame:
    rows = defender_events(events)
    return union_all([threats(rows, keys), tampering(rows, keys), scans(rows, keys), signatures(rows, keys)])


def protection_summary(history: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Per host: unhandled threats, current protection state, last scan, whether history was cleared."""
    section, title = F.col("section"), text("title")
    realtime = (section == "tampering") & title.contains("realtime protection")
    at = text("timestamp")
    return history.groupBy(*keys).agg(
        F.count_if(section == "threat").alias("threats"),
        F.count_if((section == "threat") & ~tags.is_neutralised("action")).alias("unhandled"),
        F.max_by(title == "realtime protection restored", F.when(realtime, at)).alias("protection_on"),
        F.max(F.when(realtime, at)).alias("protection_since"),
        F.max(F.when(section == "scan", at)).alias("last_scan"),
        F.max(F.when(section == "signature", F.col("detail"))).alias("signature_version"),
        F.coalesce(F.bool_or((section == "tampering") & (F.col("event_id") == "1013")), F.lit(False)).alias("history_cleared"),
    )


def threat_order() -> list[Column]:
    """Threats that slipped through first, then newest first."""
    return [tags.is_neutralised("action").asc(), F.desc(text("timestamp"))]
