"""Remote desktop and file-share histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import lookups as lk
from caseloom.functions import times
from caseloom.functions.core import blank_to_null, inline_rows, with_computed
from caseloom.functions.text import bare_account
from caseloom.operators import ordered
from caseloom.plans.common import HOST, union_all
from caseloom.sources.raw import SCAN_TIES, scan_seq

# Provider, event, direction, result, description, address field, account field, needs logon type 10.
REMOTE_DESKTOP_RULES = [
    (lk.SECURITY, "4624", "inbound", "success", "remote desktop logon succeeded", "IpAddress", "TargetUserName", True),
    (lk.SECURITY, "4625", "inbound", "failure", "remote desktop logon failed", "IpAddress", "TargetUserName", True),
    (lk.RDP_CONNECTION, "1149", "inbound", "success", "network authentication succeeded", "Param3", "Param1", False),
    (lk.RDP_SESSION, "21", "inbound", "success", "session logon", "Address", "User", False),
    (lk.RDP_SESSION, "25", "inbound", "success", "session reconnected", "Address", "User", False),
    (lk.RDP_SESSION, "22", "inbound", "info", "shell started", "Address", "User", False),
    (lk.RDP_SESSION, "23", "inbound", "info", "session logoff", "Address", "User", False),
    (lk.RDP_SESSION, "24", "inbound", "info", "session disconnected", "Address", "User", False),
    (lk.RDP_SESSION, "39", "inbound", "info", "session disconnected by another session", "Address", "User", False),
    (lk.RDP_SESSION, "40", "inbound", "info", "session disconnected with reason", "Address", "User", False),
    (lk.RDP_CLIENT, "1024", "outbound", "info", "outbound connection attempt", "Value", "", False),
    (lk.RDP_CLIENT, "1102", "outbound", "info", "outbound server address", "Value", "", False),
    (lk.RDP_CLIENT, "1025", "outbound", "success", "outbound connection established", "", "", False),
    (lk.RDP_CLIENT, "1026", "outbound", "info", "outbound connection closed", "", "", False),
]
RULE_COLUMNS = ["Provider", "EventID", "direction", "result", "description", "address_field", "account_field", "remote_only"]
CARRY_MS = 300_000

OUTPUT = [
    "timestamp", "direction", "remote_address", "account", "description", "result", "event_id", "provider", "record_key",
    *SCAN_TIES,
]


def remote_desktop_events(events: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Matched events with their own address and account, before any filling.

    The event filter is a plain predicate, so it reaches the scan; the rule table is fixed and tiny.
    """
    providers = sorted({r[0] for r in REMOTE_DESKTOP_RULES})
    numbers = sorted({r[1] for r in REMOTE_DESKTOP_RULES})
    rules = inline_rows(events.sparkSession, RULE_COLUMNS, REMOTE_DESKTOP_RULES)
    relevant = events.filter(F.col("Provider").isin(*providers) & F.col("EventID").isin(*numbers))
    fields = ["IpAddress", "Param1", "Param3", "Address", "Value", "TargetUserName", "User"]
    sessions = ["SessionID", "Session", "TargetSession"]
    parsed = ed.payload("EventData", [*fields, *sessions, "LogonType"], {"EventXML": [*fields, *sessions]})
    data = with_computed(relevant.join(F.broadcast(rules), ["Provider", "EventID"]), "_d", parsed)
    data = data.filter(~F.col("remote_only") | (F.col("_d.LogonType") == "10"))

    def by_rule(column: str, names: list[str]):
        value = F.when(F.lit(False), F.lit(""))
        for name in names:
            value = value.when(F.col(column) == name, ed.field(F.col("_d"), name, under="EventXML"))
        return value

    session_key = F.coalesce(*[ed.nested_first(F.col("_d"), "EventXML", s) for s in sessions])
    return data.select(
        *keys, "timestamp", "direction",
        by_rule("address_field", ["IpAddress", "Param3", "Address", "Value"]).alias("remote_address"),
        bare_account(by_rule("account_field", ["TargetUserName", "Param1", "User"])).alias("account"),
        "description", "result", F.col("EventID").alias("event_id"), F.col("Provider").alias("provider"),
        F.col("_record_key").alias("record_key"), *SCAN_TIES,
        F.when(F.col("Provider") == lk.RDP_SESSION, session_key).alias("session_key"),
    )


def backfill_sessions(rows: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Rows of a session take the last address and account seen for it anywhere in the scan."""
    return ordered.fill_from_key(rows, keys, "session_key", scan_seq(), ["remote_address", "account"])


def carry_outbound(rows: DataFrame, keys: list[str] = HOST, tolerance_ms: int = CARRY_MS) -> DataFrame:
    """Outbound rows without an address take the latest earlier outbound address of at most five minutes ago.

    Inbound rows pass through the same cells without giving or taking, so the input is read once.
    """
    outbound = F.col("direction") == "outbound"
    timed = rows.withColumn("_t", times.epoch_millis("timestamp")).withColumn("_address", F.when(outbound, F.col("remote_address")))
    carried = ordered.carry_within(timed, (*keys, "direction"), "_t", SCAN_TIES, "_address", tolerance_ms, "_address")
    return carried.withColumn("remote_address", F.when(outbound, F.col("_address")).otherwise(F.col("remote_address"))).select(*rows.columns)


def remote_desktop_history(events: DataFrame, keys: list[str] = HOST, tolerance_ms: int = CARRY_MS) -> DataFrame:
    matched = backfill_sessions(remote_desktop_events(events, keys), keys)
    return carry_outbound(matched, keys, tolerance_ms).select(*keys, *OUTPUT)


def file_share_history(events: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Network logons (type 3) and file-server authentication failures; rows without an address are dropped."""
    logons = events.filter((F.col("Provider") == lk.SECURITY) & F.col("EventID").isin("4624", "4625"))
    names = ["LogonType", "IpAddress", "SourceNetworkAddress", "TargetUserName"]
    d = F.col("_d")
    logons = with_computed(logons, "_d", ed.payload("EventData", names, {"EventXML": names})).filter(
        ed.field(d, "LogonType", under="EventXML") == "3"
    )
    ok = F.col("EventID") == "4624"
    logons = logons.select(
        *keys, "timestamp", F.lit("inbound").alias("direction"),
        ed.field(d, "IpAddress", "SourceNetworkAddress", under="EventXML").alias("remote_address"),
        bare_account(ed.field(d, "TargetUserName", under="EventXML")).alias("account"),
        F.when(ok, "network logon succeeded").otherwise("network logon failed").alias("description"),
        F.when(ok, "success").otherwise("failure").alias("result"),
        F.col("EventID").alias("event_id"), F.col("Provider").alias("provider"), F.col("_record_key").alias("record_key"), *SCAN_TIES,
    )
    server = events.filter((F.col("Provider") == lk.SMB_SERVER) & F.col("EventID").isin("551", "1009"))
    inner = ["ClientName", "UserName"]
    server = with_computed(server, "_d", ed.payload("EventData", inner, {"EventData": inner})).select(
        *keys, "timestamp", F.lit("inbound").alias("direction"),
        blank_to_null(F.trim(F.regexp_replace(ed.nested_first(d, "EventData", "ClientName"), r"^\\+", ""))).alias("remote_address"),
        bare_account(ed.nested_first(d, "EventData", "UserName")).alias("account"),
        F.when(F.col("EventID") == "551", "file share authentication failed").otherwise("file share session authentication failed").alias("description"),
        F.lit("failure").alias("result"),
        F.col("EventID").alias("event_id"), F.col("Provider").alias("provider"), F.col("_record_key").alias("record_key"), *SCAN_TIES,
    )
    return union_all([logons, server]).filter(F.col("remote_address").isNotNull() & (F.col("remote_address") != "-"))
