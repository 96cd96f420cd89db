"""Checked queries over the event family: scans, histories, sessions, peers, accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import lookups, tags, times
from caseloom.functions import text as tx
from caseloom.functions.core import text, with_computed
from caseloom.harness.registry import check
from caseloom.harness.shapes import shape
from caseloom.operators import compare, ordered, payloads, rollups
from caseloom.operators.filters import Page, any_column_contains, column_filter, total_rows
from caseloom.plans import accounts, defender, powershell, remote_access, search, sessions, timeline
from caseloom.plans import registry_facts as rf
from caseloom.session import scratch_folder
from caseloom.sources import raw

EV = lambda spark, sf: shape(spark, sf, "ev")
SEC = "'Microsoft-Windows-Security-Auditing'"
LSM = "'Microsoft-Windows-TerminalServices-LocalSessionManager'"
AX = "'Microsoft-Windows-TerminalServices-ClientActiveXCore'"
DEF = "'Microsoft-Windows-Windows Defender'"


def jx(path: str, column: str = "EventData") -> str:
    """Payload field in the oracle, NULL when absent, empty or not JSON."""
    return f"nullif(json_extract_string(CASE WHEN json_valid({column}) THEN {column} END, '$.{path}'), '')"


def bare(expr: str) -> str:
    return f"nullif(trim(split_part(split_part(replace({expr}, '/', chr(92)), chr(92), -1), chr(64), 1)), '')"


# Scans -------------------------------------------------------------------------------------------------------------

@check("s1_text_scan", "ev", "SELECT host_id, log, CAST(_rowid AS BIGINT) AS _rowid, EventData FROM ev")
def _(spark, sf):
    return raw.text_columns(EV(spark, sf)).select("host_id", "log", "_rowid", "EventData")


@check("s4_category_scan", "ev", "SELECT _source_file, count(*) AS rows, min(_rowid) AS first_row, max(_rowid) AS last_row FROM ev GROUP BY 1")
def _(spark, sf):
    return EV(spark, sf).groupBy("_source_file").agg(F.count(F.lit(1)).alias("rows"), F.min("_rowid").alias("first_row"), F.max("_rowid").alias("last_row"))


@check("s5_log_scan", "ev", "SELECT log, EventID, count(*) AS rows FROM ev WHERE contains(lower(log), 'terminalservices') GROUP BY 1, 2")
def _(spark, sf):
    return raw.logs_named(EV(spark, sf), "TerminalServices").groupBy("log", "EventID").agg(F.count(F.lit(1)).alias("rows"))


@check("s26_ordered_columns", "ev", "SELECT log, EventID, host_id, _rowid FROM ev WHERE EventID IS NOT NULL")
def _(spark, sf):
    df = EV(spark, sf).filter("EventID is not null")
    keep = raw.ordered_columns(["log", "missing", "EventID"], ["EventID", "_rowid", "host_id", "log"])
    return df.select(*keep)


@check("s28_rows_by_source", "ev tasks", """
SELECT 'EventLog' AS artifact, _source_file, count(*) AS rows FROM ev GROUP BY 2
UNION ALL SELECT 'ScheduledTasks', _source_file, count(*) FROM tasks GROUP BY 2""".strip())
def _(spark, sf):
    return raw.rows_by_source({"EventLog": EV(spark, sf), "ScheduledTasks": shape(spark, sf, "tasks")})


@check("s29_status_rows", "ev", "SELECT host_id, _status AS status, count(*) AS rows FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return raw.status_counts(EV(spark, sf), ["host_id"])


@check("s32_log_allowlist", "ev", "SELECT log, count(*) AS rows FROM ev WHERE log <> 'Damaged' GROUP BY 1")
def _(spark, sf):
    files = EV(spark, sf).withColumn("name", tx.last_segment("_source_file"))
    return raw.allowed_logs(files, "name").groupBy("log").agg(F.count(F.lit(1)).alias("rows"))


@check("p7_column_filter", "ev", """
SELECT _rowid, CAST(contains(lower(coalesce(Provider, '')), 'defender') AS INT) AS has, CAST(NOT contains(lower(coalesce(Provider, '')), 'defender') AS INT) AS lacks,
  CAST(lower(coalesce(LevelName, '')) = 'error' AS INT) AS same FROM ev""")
def _(spark, sf):
    as_int = lambda c: c.cast("int")
    return EV(spark, sf).select(
        "_rowid", as_int(column_filter("Provider", "DEFENDER")).alias("has"), as_int(column_filter("Provider", "defender", "exclude")).alias("lacks"),
        as_int(column_filter("LevelName", "ERROR", "exact")).alias("same"))


@check("p8_any_column_search", "ev", """
SELECT _rowid FROM ev WHERE contains(lower(coalesce(Provider, '')), 'user17') OR contains(lower(coalesce(EventData, '')), 'user17')
  OR contains(lower(coalesce(UserID, '')), 'user17') OR contains(lower(coalesce(_record_key, '')), 'user17')""")
def _(spark, sf):
    return EV(spark, sf).filter(any_column_contains(["Provider", "EventData", "UserID", "_record_key"], "USER17")).select("_rowid")


@check("a4_value_frequency", "ev", "SELECT coalesce(Provider, '') AS value, count(*) AS count FROM ev GROUP BY 1")
def _(spark, sf):
    return rollups.value_counts(EV(spark, sf), "Provider")


# Scalar families over events ------------------------------------------------------------------------------------------

@check("f22_payload_fields", "ev", f"""
SELECT _rowid, {jx('LogonType')} AS logon_type, coalesce({jx('EventXML.SessionID')}, {jx('SessionID')}) AS session_id, {jx('"Detection ID"')} AS detection FROM ev""")
def _(spark, sf):
    d = F.col("d")
    df = EV(spark, sf).withColumn("d", ed.payload("EventData", ["LogonType", "SessionID", "Detection ID"], {"EventXML": ["SessionID"]}))
    return df.select("_rowid", ed.field(d, "LogonType").alias("logon_type"), ed.field(d, "SessionID", under="EventXML").alias("session_id"), ed.field(d, "Detection ID").alias("detection"))


EVENT_LABELS = f"""({SEC}, '4624', 'logon', 'logon succeeded'), ({SEC}, '4625', 'logon', 'logon failed'), ({LSM}, '21', 'remote desktop', 'session logon'),
  ({LSM}, '23', 'remote desktop', 'session logoff'), ({LSM}, '24', 'remote desktop', 'session disconnected'), ({LSM}, '25', 'remote desktop', 'session reconnected'),
  ({DEF}, '1116', 'detection', 'malware detected'), ({DEF}, '1117', 'detection', 'malware action completed'), ({DEF}, '5001', 'detection', 'realtime protection off'),
  ({DEF}, '5007', 'detection', 'configuration changed')"""


@check("f26_event_catalog", "ev", f"""
SELECT host_id, EventID, event_category, event_label, count(*) AS rows FROM ev JOIN (VALUES {EVENT_LABELS}) AS c(p, e, event_category, event_label) ON Provider = p AND EventID = e GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    known = lookups.with_catalog(EV(spark, sf)).filter(F.col("event_label").isNotNull())
    return known.groupBy("host_id", "EventID", "event_category", "event_label").agg(F.count(F.lit(1)).alias("rows"))


@check("q1_event_titles", "ev", f"""
SELECT _rowid, 'Event ' || coalesce(EventID, '') || coalesce(' · ' || event_label, '') || CASE WHEN EventID IN ('4624', '4625', '4648') AND lt IS NOT NULL
    THEN ' · ' || CASE lt WHEN '2' THEN 'interactive (type 2)' WHEN '3' THEN 'network (type 3)' WHEN '10' THEN 'remote desktop (type 10)' ELSE 'type ' || lt END ELSE '' END AS title
FROM (SELECT *, {jx('LogonType')} AS lt FROM ev) LEFT JOIN (VALUES {EVENT_LABELS}) AS c(p, e, event_category, event_label) ON Provider = p AND EventID = e
WHERE trim(coalesce(EventID, '')) <> '0' AND trim(coalesce(timestamp, '')) <> ''""")
def _(spark, sf):
    return timeline.event_entries(EV(spark, sf)).select("_rowid", "title")


@check("f25_quick_fields", "ev", f"""
SELECT _rowid, CASE {jx('LogonType')} WHEN '2' THEN 'interactive' WHEN '3' THEN 'network' WHEN '10' THEN 'remote desktop' END AS "ed_LogonType",
  {jx('TargetUserName')} AS "ed_TargetUserName", {jx('IpAddress')} AS "ed_IpAddress" FROM ev""")
def _(spark, sf):
    return EV(spark, sf).select("_rowid", *ed.quick_fields("EventData")).select("_rowid", "ed_LogonType", "ed_TargetUserName", "ed_IpAddress")


@check("f24_level_name", "ev", "SELECT Level, CASE Level WHEN '1' THEN 'Critical' WHEN '2' THEN 'Error' WHEN '3' THEN 'Warning' WHEN '5' THEN 'Verbose' ELSE 'Information' END AS level_name, count(*) AS rows FROM ev GROUP BY 1, 2")
def _(spark, sf):
    return EV(spark, sf).groupBy("Level", ed.level_name("Level").alias("level_name")).agg(F.count(F.lit(1)).alias("rows"))


@check("f32_event_tags", "ev", f"""
SELECT _rowid, concat_ws(',', CASE LevelName WHEN 'Critical' THEN 'critical_event' WHEN 'Error' THEN 'error_event' END,
  CASE WHEN EventID = '4625' THEN 'logon_failure' END, CASE WHEN EventID = '4624' AND {jx('LogonType')} = '10' THEN 'remote_desktop_logon' END,
  CASE WHEN EventID = '4624' AND {jx('LogonType')} = '3' THEN 'network_logon' END, CASE WHEN EventID = '1116' THEN 'malware_detected' END,
  CASE WHEN EventID = '1102' THEN 'audit_log_cleared' END, CASE WHEN EventID = '5001' THEN 'realtime_protection_off' END) AS tags FROM ev""")
def _(spark, sf):
    found = F.concat(tags.level_tags("LevelName"), tags.security_tags("Provider", "EventID", F.col("_d")))
    return with_computed(EV(spark, sf), "_d", tags.tag_payload("EventData")).select("_rowid", tags.tag_codes(found).alias("tags"))


@check("f23_flattened_payload", "ev", f"""
SELECT _rowid, 'EventData.ClientName' AS path, 'ClientName' AS field, json_extract_string(EventData, '$.EventData.ClientName') AS value FROM ev WHERE Provider = 'Microsoft-Windows-SMBServer'
UNION ALL SELECT _rowid, 'EventData.UserName', 'UserName', json_extract_string(EventData, '$.EventData.UserName') FROM ev WHERE Provider = 'Microsoft-Windows-SMBServer'""".replace("SELECT _rowid, 'EventData.C", "SELECT _rowid, 'EventData.C", 1).strip())
def _(spark, sf):
    smb = EV(spark, sf).filter(F.col("Provider") == lookups.SMB_SERVER)
    return payloads.leaf_rows(smb, "EventData", ["_rowid"])


DEEP_SQL = """
parts AS (SELECT *, repeat('N.', CAST(_rowid % 200 AS INT)) AS below, nullif(regexp_extract(EventData, '"TargetUserSid":"([^"]*)"', 1), '') AS sid,
  'CORP' || chr(92) || regexp_extract(EventData, '(user[0-9]+)"', 1) AS name FROM deep)"""


@check("f23_deep_payload", "deep", DEEP_SQL + """
SELECT _rowid, below || 'TargetUserSid' AS path, 'TargetUserSid' AS field, sid AS value FROM parts WHERE sid IS NOT NULL
UNION ALL SELECT _rowid, below || 'TargetUserName', 'TargetUserName', name FROM parts UNION ALL SELECT _rowid, below || 'Note', 'Note', '}, ' || @n(_rowid) || ', a{' FROM parts""")
def _(spark, sf):
    return payloads.leaf_rows(shape(spark, sf, "deep"), "EventData", ["_rowid"])


# Remote desktop -------------------------------------------------------------------------------------------------------

RDP_ROWS = f"""
rdp0 AS (SELECT host_id, timestamp, CASE WHEN Provider = {AX} THEN 'outbound' ELSE 'inbound' END AS direction,
    CASE WHEN Provider = {SEC} THEN coalesce({jx('EventXML.IpAddress')}, {jx('IpAddress')}) WHEN Provider = {LSM} THEN coalesce({jx('EventXML.Address')}, {jx('Address')})
      WHEN EventID IN ('1024', '1102') THEN coalesce({jx('EventXML.Value')}, {jx('Value')}) END AS remote_address,
    CASE WHEN Provider = {SEC} THEN {bare(jx('TargetUserName'))} WHEN Provider = {LSM} THEN coalesce({bare(jx('EventXML.User'))}, {bare(jx('User'))}) END AS account,
    CASE WHEN EventID IN ('4624', '21', '25', '1025') THEN 'success' WHEN EventID = '4625' THEN 'failure' ELSE 'info' END AS result,
    EventID AS event_id, _record_key AS record_key, _source_file, _rowid,
    CASE WHEN Provider = {LSM} THEN coalesce({jx('EventXML.SessionID')}, {jx('SessionID')}) END AS session_key
  FROM ev WHERE (Provider = {SEC} AND {jx('LogonType')} = '10') OR Provider IN ({LSM}, {AX})),
rdp1 AS (SELECT r.* REPLACE (coalesce(r.remote_address, k.a) AS remote_address, coalesce(r.account, k.c) AS account) FROM rdp0 r LEFT JOIN
  (SELECT host_id, session_key, arg_max(remote_address, (_source_file, _rowid)) FILTER (remote_address IS NOT NULL) AS a,
    arg_max(account, (_source_file, _rowid)) FILTER (account IS NOT NULL) AS c FROM rdp0 WHERE session_key IS NOT NULL GROUP BY 1, 2) k USING (host_id, session_key)),
rdp2 AS (SELECT *, epoch_ms(CAST(timestamp AS TIMESTAMP)) AS t, last_value(CASE WHEN direction = 'outbound' AND remote_address IS NOT NULL THEN {{'t': epoch_ms(CAST(timestamp AS TIMESTAMP)), 'a': remote_address}} END IGNORE NULLS)
    OVER (PARTITION BY host_id, direction ORDER BY timestamp, _source_file, _rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM rdp1),
rdp AS (SELECT host_id, timestamp, direction, coalesce(remote_address, CASE WHEN direction = 'outbound' AND t - prior.t <= @tolerance THEN prior.a END) AS remote_address,
    account, result, event_id, record_key, _source_file, _rowid, t FROM rdp2)"""
MINUTE = 60_000
TOLERANCE = 300 * MINUTE


def rdp_sql(tail: str, tolerance: int = TOLERANCE) -> str:
    return RDP_ROWS.replace("@tolerance", str(tolerance)) + tail


def rdp(spark, sf):
    return remote_access.remote_desktop_history(EV(spark, sf), tolerance_ms=TOLERANCE)


RDP_COLUMNS = ["host_id", "timestamp", "direction", "remote_address", "account", "result", "event_id", "record_key"]


@check("j4_session_backfill", "ev", rdp_sql(" SELECT record_key, remote_address, account FROM rdp1 WHERE session_key IS NOT NULL"))
def _(spark, sf):
    rows = remote_access.backfill_sessions(remote_access.remote_desktop_events(EV(spark, sf)))
    return rows.filter("session_key is not null").select("record_key", "remote_address", "account")


@check("j5_carry_forward", "ev", rdp_sql(" SELECT record_key, timestamp, remote_address FROM rdp WHERE direction = 'outbound'"))
def _(spark, sf):
    return rdp(spark, sf).filter("direction = 'outbound'").select("record_key", "timestamp", "remote_address")


@check("c2_remote_desktop_history", "ev", rdp_sql(" SELECT " + ", ".join(RDP_COLUMNS) + " FROM rdp", 300_000))
def c2(spark, sf):
    return remote_access.remote_desktop_history(EV(spark, sf)).select(*RDP_COLUMNS)


SESSION_MS = 120 * MINUTE
SESSION_SQL = """,
b1 AS (SELECT *, CASE WHEN lag(t) OVER w IS NULL OR lag(direction) OVER w <> direction OR t - lag(t) OVER w > @gap THEN 1 ELSE 0 END AS brk FROM rdp WINDOW w AS (PARTITION BY host_id ORDER BY timestamp, _source_file, _rowid)),
b2 AS (SELECT *, sum(brk) OVER (PARTITION BY host_id ORDER BY timestamp, _source_file, _rowid) AS seg FROM b1),
b3 AS (SELECT *, last_value(remote_address IGNORE NULLS) OVER (PARTITION BY host_id, seg ORDER BY timestamp, _source_file, _rowid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM b2),
b4 AS (SELECT *, sum(CASE WHEN brk = 1 OR (remote_address IS NOT NULL AND known IS NOT NULL AND remote_address <> known) THEN 1 ELSE 0 END) OVER (PARTITION BY host_id ORDER BY timestamp, _source_file, _rowid) AS sess FROM b3),
se AS (SELECT host_id, sess, min(_rowid) FILTER (rn = 1) AS start_row, arg_min(direction, (timestamp, _source_file, _rowid)) AS direction,
    arg_min(remote_address, (timestamp, _source_file, _rowid)) FILTER (remote_address IS NOT NULL) AS remote_address, arg_min(account, (timestamp, _source_file, _rowid)) FILTER (account IS NOT NULL) AS account,
    min(timestamp) AS start, max(timestamp) AS "end", count(*) AS events, count(*) FILTER (result = 'success') AS success, count(*) FILTER (result = 'failure') AS fail
  FROM (SELECT *, row_number() OVER (PARTITION BY host_id, sess ORDER BY timestamp, _source_file, _rowid) AS rn FROM b4) GROUP BY 1, 2)""".replace("@gap", str(SESSION_MS))


@check("w2_session_cluster", "ev", rdp_sql(SESSION_SQL + """ SELECT b4.record_key, se.start_row AS session_row FROM b4 JOIN se USING (host_id, sess)"""))
def _(spark, sf):
    found = sessions.remote_sessions(rdp(spark, sf), gap_ms=SESSION_MS)
    return found.select("record_key", F.col("session_start._rowid").alias("session_row"))


SESSION_COLUMNS = ["host_id", "start_row", "direction", "remote_address", "account", "start", '"end"', "events", "success", "fail"]


def session_rows(spark, sf):
    table = sessions.session_table(sessions.remote_sessions(rdp(spark, sf), gap_ms=SESSION_MS))
    return table.withColumn("start_row", F.col("session_start._rowid"))


@check("w4_gap_boundary", "", """
c AS (SELECT c_custkey AS k FROM customer)
SELECT k, CASE WHEN k % 3 = 1 AND EXISTS (SELECT 1 FROM c d WHERE d.k = c.k - 1) THEN k - 1 ELSE k END AS first_row FROM c""".strip())
def _(spark, sf):
    """Three events each: the second comes exactly one gap after the first and stays, the third a millisecond later than that."""
    k = F.col("c_custkey").cast("bigint")
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(
        k.alias("k"), F.floor(k / 3).alias("host_id"), (k % 3 * sessions.SESSION_GAP_MS + (k % 3 == 2).cast("int")).alias("t"))
    found = ordered.cluster_sessions(rows, ordered.ScanOrder(("host_id",), "t", ("k",)), sessions.SESSION_GAP_MS)
    return found.select("k", F.col("session_start.k").alias("first_row"))


@check("a9_session_rollup", "ev", rdp_sql(SESSION_SQL + " SELECT " + ", ".join(SESSION_COLUMNS) + " FROM se"))
def q4(spark, sf):
    return session_rows(spark, sf).select(*[c.strip('"') for c in SESSION_COLUMNS])


@check("p17_session_filter", "ev", rdp_sql(SESSION_SQL + " SELECT host_id, start_row, remote_address FROM se WHERE direction = 'inbound' AND success > 0 AND (contains(lower(coalesce(remote_address, '')), '16') OR contains(lower(coalesce(account, '')), '16'))"))
def _(spark, sf):
    kept = sessions.filter_sessions(session_rows(spark, sf), direction="inbound", outcome="success", search="16")
    return kept.select("host_id", "start_row", "remote_address")


@check("q4_remote_sessions", "ev facts", rdp_sql(SESSION_SQL + """,
addr AS (SELECT ip, min(host_id) AS peer_host FROM (SELECT DISTINCT host_id, '10.0.0.' || @n(_rowid @div 20 % 250) AS ip FROM facts WHERE value_name = 'IPAddress') GROUP BY 1)
SELECT se.host_id, start_row, remote_address, peer_host, events FROM se LEFT JOIN addr ON remote_address = ip WHERE success > 0"""))
def _(spark, sf):
    faces = shape(spark, sf, "facts").filter("value_name = 'IPAddress'")
    known = faces.groupBy(F.concat(F.lit("10.0.0."), F.expr("_rowid div 20 % 250").cast("string")).alias("ip")).agg(F.min("host_id").alias("peer_host"))
    return sessions.filter_sessions(session_rows(spark, sf), addresses=known, outcome="success").select("host_id", "start_row", "remote_address", "peer_host", "events")


# File share -----------------------------------------------------------------------------------------------------------

SMB_SQL = f"""
smb AS (SELECT host_id, timestamp, remote_address, account, result, event_id, record_key, _source_file, _rowid FROM (
  SELECT host_id, timestamp, {jx('IpAddress')} AS remote_address, {bare(jx('TargetUserName'))} AS account, CASE EventID WHEN '4624' THEN 'success' ELSE 'failure' END AS result, EventID AS event_id,
    _record_key AS record_key, _source_file, _rowid FROM ev WHERE Provider = {SEC} AND {jx('LogonType')} = '3'
  UNION ALL SELECT host_id, timestamp, nullif(trim(ltrim({jx('EventData.ClientName')}, chr(92))), ''), {bare(jx('EventData.UserName'))}, 'failure', EventID, _record_key, _source_file, _rowid FROM ev WHERE Provider = 'Microsoft-Windows-SMBServer')
  WHERE remote_address IS NOT NULL AND remote_address <> '-')"""


@check("c3_file_share_history", "ev", SMB_SQL + " SELECT host_id, timestamp, remote_address, account, result, event_id, record_key FROM smb")
def _(spark, sf):
    return remote_access.file_share_history(EV(spark, sf)).select("host_id", "timestamp", "remote_address", "account", "result", "event_id", "record_key")


PEER_SQL = SMB_SQL + """, peers AS (SELECT host_id, remote_address AS peer, count(*) AS attempts, count(*) FILTER (result = 'failure') AS fail, count(*) FILTER (result = 'success') AS success,
  count(DISTINCT account) AS accounts, min(timestamp) AS first_time, max(timestamp) AS last_time FROM smb GROUP BY 1, 2)"""
PEER_COLUMNS = ["host_id", "peer", "attempts", "fail", "success", "accounts", "first_time", "last_time"]


@check("a8_peer_ledger", "ev", PEER_SQL + " SELECT " + ", ".join(PEER_COLUMNS) + " FROM peers")
def _(spark, sf):
    return sessions.peers(remote_access.file_share_history(EV(spark, sf))).orderBy(*sessions.peer_order()).select(*PEER_COLUMNS)


@check("a8_peer_accounts", "ev", SMB_SQL + " SELECT host_id, remote_address AS peer, account, arg_min(_rowid, (_source_file, _rowid)) AS first_row FROM smb WHERE account IS NOT NULL GROUP BY 1, 2, 3")
def _(spark, sf):
    found = rollups.peer_accounts(remote_access.file_share_history(EV(spark, sf)), ["host_id"])
    return found.select("host_id", "peer", "account", F.col("first_seen._rowid").alias("first_row"))


@check("p20_peer_filter", "ev", PEER_SQL + " SELECT host_id, peer, attempts FROM peers p WHERE fail > 0 AND (contains(peer, '0.1.') OR EXISTS (SELECT 1 FROM smb s WHERE s.host_id = p.host_id AND s.remote_address = p.peer AND contains(lower(s.account), 'user1')))")
def _(spark, sf):
    return sessions.filter_peers(remote_access.file_share_history(EV(spark, sf)), outcome="fail", search="0.1.").select("host_id", "peer", "attempts").unionByName(
        sessions.filter_peers(remote_access.file_share_history(EV(spark, sf)), outcome="fail", search="user1").select("host_id", "peer", "attempts")).distinct()


@check("q6_peer_totals", "ev", PEER_SQL + " SELECT host_id, count(*) AS peers, CAST(sum(attempts) AS BIGINT) AS events FROM peers WHERE success > 0 GROUP BY 1")
def _(spark, sf):
    shown = sessions.filter_peers(remote_access.file_share_history(EV(spark, sf)), outcome="success")
    return shown.groupBy("host_id").agg(F.count(F.lit(1)).alias("peers"), F.sum("attempts").alias("events"))


@check("p4_time_range", "ev", "SELECT record_key, timestamp FROM (SELECT _record_key AS record_key, timestamp FROM ev) WHERE timestamp >= '2024-01-05 00:00:00.000' AND timestamp <= '2024-01-09 12:30:59.999'")
def _(spark, sf):
    return EV(spark, sf).filter(times.in_range("timestamp", "2024-01-05", "2024-01-09 12:30")).select(F.col("_record_key").alias("record_key"), "timestamp")


@check("j9_raw_event_gate", "ev", SMB_SQL + f" SELECT s.record_key, e.EventID AS raw_event_id, e.Provider AS raw_provider, e._rowid AS raw_rowid FROM smb s LEFT JOIN ev e ON e.host_id = s.host_id AND e._record_key = s.record_key AND regexp_matches(s.record_key, '(?i)\\.evtx::\\d+$')")
def _(spark, sf):
    joined = search.raw_event_of(remote_access.file_share_history(EV(spark, sf)), EV(spark, sf))
    return joined.select("record_key", "raw_event_id", "raw_provider", "raw_rowid")


# Antivirus ------------------------------------------------------------------------------------------------------------

def dj(name: str) -> str:
    return jx(f'"{name}"')


STATE_SQL = f"""
rt AS (SELECT host_id, timestamp, EventID = '5000' AS is_on, _record_key AS record_key, lag(EventID) OVER (PARTITION BY host_id ORDER BY timestamp, EventID = '5000', _record_key, _rowid) AS before, EventID FROM ev WHERE Provider = {DEF} AND EventID IN ('5000', '5001')),
changes AS (SELECT host_id, timestamp, record_key, is_on FROM rt WHERE (before IS NULL AND NOT is_on) OR before <> EventID)"""


@check("w1_state_changes", "ev", STATE_SQL + " SELECT host_id, timestamp, record_key, is_on FROM changes")
def _(spark, sf):
    rows = defender.protection_changes(defender.defender_events(EV(spark, sf)), ["host_id"])
    return rows.select("host_id", "timestamp", F.col("_record_key").alias("record_key"), "is_on")


LAST = lambda f, extra="": f"arg_max({f}, (_source_file, _rowid)) FILTER ({f} IS NOT NULL{extra})"
THREAT_SQL = f"""
th AS (SELECT host_id, {dj('Detection ID')} AS id, arg_min(EventID, (_source_file, _rowid)) AS event_id, {LAST(dj('Threat Name'))} AS title, {LAST(dj('Severity Name'))} AS severity, {LAST(dj('Path'))} AS detail,
  coalesce({LAST(dj('Action Name'), " AND EventID = '1117'")}, 'detected only') AS action, {LAST('timestamp', " AND EventID = '1117'")} AS action_time,
  arg_min(EventID, (_source_file, _rowid)) = '1116' AS opened_by_detection, min(timestamp) FILTER (EventID = '1116') AS found, arg_min(timestamp, (_source_file, _rowid)) AS opened
  FROM ev WHERE Provider = {DEF} AND EventID IN ('1116', '1117') GROUP BY 1, 2),
threats AS (SELECT host_id, event_id, title, severity, detail, action, action_time, CASE WHEN opened_by_detection OR found < opened THEN found ELSE opened END AS timestamp FROM th)"""


@check("a2_threat_merge", "ev", THREAT_SQL + " SELECT * FROM threats")
def _(spark, sf):
    rows = defender.threats(defender.defender_events(EV(spark, sf)), ["host_id"])
    return rows.select("host_id", "event_id", "title", "severity", "detail", "action", "action_time", "timestamp")


@check("a3_latest_scans", "ev", f"""
SELECT host_id, {dj('Scan Type')} AS title, '1001' AS event_id, max(timestamp) AS timestamp FROM ev WHERE Provider = {DEF} AND EventID = '1001' GROUP BY 1, 2
UNION ALL SELECT host_id, 'security intelligence version', '2000', max(timestamp) FROM ev WHERE Provider = {DEF} AND EventID = '2000' GROUP BY 1
UNION ALL SELECT host_id, 'history cleared ' || count(*) || ' times, latest shown', '1013', max(timestamp) FROM ev WHERE Provider = {DEF} AND EventID = '1013' GROUP BY 1""".strip())
def _(spark, sf):
    rows = defender.defender_events(EV(spark, sf))
    keys = ["host_id"]
    cleared = defender.tampering(rows, keys).filter("event_id = '1013'").withColumn("title", F.col("detail"))
    found = defender.scans(rows, keys).unionByName(defender.signatures(rows, keys)).unionByName(cleared)
    return found.select("host_id", "title", "event_id", "timestamp")


DEFENDER_SQL = THREAT_SQL + "," + STATE_SQL + f""",
dh AS (SELECT host_id, 'threat' AS section, timestamp, event_id, title, detail, action FROM threats
  UNION ALL SELECT host_id, 'tampering', timestamp, CASE WHEN is_on THEN '5000' ELSE '5001' END, CASE WHEN is_on THEN 'realtime protection restored' ELSE 'realtime protection off' END,
    CASE WHEN is_on THEN 'realtime protection was turned back on' ELSE 'realtime protection was turned off' END, NULL FROM changes
  UNION ALL SELECT host_id, 'tampering', timestamp, '5007', 'protection configuration changed', {dj('Old Value')} || ' → ' || {dj('New Value')}, NULL FROM ev WHERE Provider = {DEF} AND EventID = '5007' AND contains(lower({dj('New Value')}), 'disablerealtimemonitoring')
  UNION ALL SELECT host_id, 'tampering', max(timestamp), '1013', 'scan and threat history cleared', 'history cleared ' || count(*) || ' times, latest shown', NULL FROM ev WHERE Provider = {DEF} AND EventID = '1013' GROUP BY 1
  UNION ALL SELECT host_id, 'scan', max(timestamp), '1001', {dj('Scan Type')}, {dj('Scan Type')}, NULL FROM ev WHERE Provider = {DEF} AND EventID = '1001' GROUP BY 1, 5, 6
  UNION ALL SELECT host_id, 'signature', max(timestamp), '2000', 'security intelligence version', arg_max({dj('Current security intelligence Version')}, timestamp), NULL FROM ev WHERE Provider = {DEF} AND EventID = '2000' GROUP BY 1)"""


@check("c1_defender_history", "ev", DEFENDER_SQL + " SELECT * FROM dh")
def c1(spark, sf):
    return defender.defender_history(EV(spark, sf)).select("host_id", "section", "timestamp", "event_id", "title", "detail", "action")


@check("a12_protection_summary", "ev", DEFENDER_SQL + """
SELECT host_id, count(*) FILTER (section = 'threat') AS threats, count(*) FILTER (section = 'threat' AND NOT contains(lower(action), 'quarantine')) AS unhandled,
  arg_max(event_id = '5000', timestamp) FILTER (event_id IN ('5000', '5001')) AS protection_on, max(timestamp) FILTER (section = 'scan') AS last_scan, bool_or(event_id = '1013') AS history_cleared FROM dh GROUP BY 1""")
def _(spark, sf):
    rows = defender.protection_summary(defender.defender_history(EV(spark, sf)))
    return rows.select("host_id", "threats", "unhandled", "protection_on", "last_scan", "history_cleared")


@check("f45_threat_classes", "ev", THREAT_SQL + """
SELECT host_id, CASE WHEN contains(lower(coalesce(severity, '')), 'high') THEN 'danger' ELSE 'neutral' END AS severity_class, contains(lower(action), 'quarantine') AS neutralised, count(*) AS rows FROM threats GROUP BY 1, 2, 3""")
def _(spark, sf):
    rows = defender.threats(defender.defender_events(EV(spark, sf)), ["host_id"])
    return rows.groupBy("host_id", tags.severity_class("severity").alias("severity_class"), tags.is_neutralised("action").alias("neutralised")).agg(F.count(F.lit(1)).alias("rows"))


# PowerShell -----------------------------------------------------------------------------------------------------------

USERS_SQL = """
users AS (SELECT host_id, sid, arg_max(nullif(split_part(value_data, chr(92), -1), ''), _rowid) FILTER (nullif(split_part(value_data, chr(92), -1), '') IS NOT NULL) AS user_name FROM (
  SELECT *, split_part(key_path, chr(92), -1) AS sid FROM acct WHERE value_name = 'ProfileImagePath') GROUP BY 1, 2)"""


@check("j1_user_names", "acct sb", USERS_SQL + " SELECT s._rowid, coalesce(u.user_name, nullif(s.UserID, '')) AS account FROM sb s LEFT JOIN users u ON u.host_id = s.host_id AND u.sid = s.UserID WHERE s.UserID <> ''")
def _(spark, sf):
    named = powershell.with_account(shape(spark, sf, "sb").filter("UserID <> ''"), powershell.user_names(shape(spark, sf, "acct")), ["host_id"])
    return named.select("_rowid", F.col("_account").alias("account"))


BLOCK_SQL = USERS_SQL + f""",
parts AS (SELECT *, {jx('ScriptBlockId')} AS id, CAST({jx('MessageNumber')} AS BIGINT) AS num, CAST({jx('MessageTotal')} AS BIGINT) AS total, json_extract_string(EventData, '$.ScriptBlockText') AS body, {jx('Path')} AS path FROM sb WHERE EventID = '4104'),
blocks AS (SELECT host_id, id, string_agg(body, '' ORDER BY num) AS script_block, min(timestamp) AS timestamp, arg_min(UserID, _rowid) AS sid, arg_min(ProcessID, _rowid) AS process_id, arg_min(path, _rowid) AS script_path, arg_min(_record_key, timestamp) AS record_key FROM parts WHERE total > 1 GROUP BY 1, 2)"""
PS_SQL = BLOCK_SQL + f""",
ctx AS (SELECT *, regexp_extract({jx('ContextInfo')}, 'Host Application = ([^\\n]*)', 1) AS host, nullif(regexp_extract({jx('ContextInfo')}, '\\n *User = ([^\\n]*)', 1), '') AS usr,
    regexp_extract({jx('ContextInfo')}, 'Command Name = ([^\\n]*)', 1) AS cmd, {jx('Payload')} AS pay FROM sb WHERE EventID = '4103'),
old AS (SELECT *, json_extract_string(EventData, '$.Data[1]') AS blob FROM sb WHERE EventID = '800'),
ps AS (SELECT b.host_id, b.timestamp, coalesce(u.user_name, b.sid) AS account, 'powershell.exe' AS process, process_id, NULL AS command, script_block, NULL AS host_application, 'script block' AS kind, script_path, record_key FROM blocks b LEFT JOIN users u ON u.host_id = b.host_id AND u.sid = b.sid
  UNION ALL SELECT p.host_id, timestamp, coalesce(u.user_name, UserID), 'powershell.exe', ProcessID, NULL, nullif(body, ''), NULL, 'script block', path, _record_key FROM parts p LEFT JOIN users u ON u.host_id = p.host_id AND u.sid = p.UserID WHERE total <= 1
  UNION ALL SELECT c.host_id, timestamp, coalesce(usr, u.user_name, UserID), split_part(regexp_extract(host, '^"([^"]*)', 1), chr(92), -1), ProcessID, coalesce(split_part(pay, chr(10), 1), cmd), NULL, host, 'pipeline', NULL, _record_key FROM ctx c LEFT JOIN users u ON u.host_id = c.host_id AND u.sid = c.UserID
  UNION ALL SELECT host_id, timestamp, regexp_extract(blob, 'UserId=([^\\r\\n]*)', 1), 'powershell.exe', '', nullif(regexp_extract(blob, 'CommandLine=([^\\r\\n]*)', 1), ''), NULL, regexp_extract(blob, 'HostApplication=([^\\r\\n]*)', 1), 'command', NULL, _record_key FROM old)"""
PS_COLUMNS = ["host_id", "timestamp", "account", "process", "process_id", "command", "script_block", "host_application", "kind", "script_path", "record_key"]


def ps(spark, sf):
    return powershell.powershell_history(shape(spark, sf, "sb"), shape(spark, sf, "acct"))


@check("c4_script_blocks", "sb acct", BLOCK_SQL + " SELECT host_id, script_block, timestamp, process_id, script_path, record_key FROM blocks")
def _(spark, sf):
    parts = shape(spark, sf, "sb").filter("EventID = '4104'").withColumn("_d", ed.payload("EventData", ["ScriptBlockText", "Path", "ScriptBlockId", "MessageTotal", "MessageNumber"]))
    parts = parts.withColumn("_id", F.col("_d.ScriptBlockId")).withColumn("_number", F.col("_d.MessageNumber").cast("bigint")).filter("cast(_d.MessageTotal as bigint) > 1")
    return powershell.join_blocks(parts, ["host_id"]).select("host_id", "script_block", "timestamp", F.col("ProcessID").alias("process_id"), F.col("path").alias("script_path"), F.col("_record_key").alias("record_key"))


@check("c4_powershell_history", "sb acct", PS_SQL + " SELECT " + ", ".join(PS_COLUMNS) + " FROM ps")
def _(spark, sf):
    return ps(spark, sf).select(*PS_COLUMNS)


PS_GAP = 240 * MINUTE


@check("w3_identity_sessions", "sb acct", PS_SQL + f""",
g0 AS (SELECT *, account || '||' || coalesce(nullif(process_id, ''), process) AS identity, epoch_ms(CAST(timestamp AS TIMESTAMP)) AS t FROM ps),
g1 AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY host_id, identity ORDER BY timestamp, record_key) <= {PS_GAP} THEN 0 ELSE 1 END AS brk FROM g0),
g2 AS (SELECT *, sum(brk) OVER (PARTITION BY host_id, identity ORDER BY timestamp, record_key) AS sess FROM g1)
SELECT host_id, identity, min(timestamp) AS start, max(timestamp) AS "end", count(*) AS events FROM g2 GROUP BY host_id, identity, sess""")
def _(spark, sf):
    table = powershell.script_session_table(powershell.script_sessions(ps(spark, sf), gap_ms=PS_GAP))
    return table.select("host_id", "identity", "start", "end", "events")


@check("q5_script_evidence", "sb acct", PS_SQL + """
SELECT record_key, line AS evidence FROM (
  SELECT record_key, coalesce(list_filter(list_transform(string_split_regex(script_block, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '')[1], command, host_application) AS line FROM ps)""")
def _(spark, sf):
    return ps(spark, sf).select("record_key", powershell.evidence_text().alias("evidence"))


# Accounts -------------------------------------------------------------------------------------------------------------

MATCH_SQL = f"""
ent AS (SELECT host_id, _rowid, timestamp, log, 'event principal' AS role, true AS is_sid, 'UserID' AS path, UserID AS value FROM ev WHERE UserID <> ''
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'target', true, 'TargetUserSid', {jx('TargetUserSid')} FROM ev WHERE {jx('TargetUserSid')} IS NOT NULL
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'target', false, 'TargetUserName', {jx('TargetUserName')} FROM ev WHERE {jx('TargetUserName')} IS NOT NULL
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'account', false, 'EventData.UserName', {jx('EventData.UserName')} FROM ev WHERE {jx('EventData.UserName')} IS NOT NULL
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'session user', false, 'User', {jx('User')} FROM ev WHERE Provider = {LSM} AND {jx('User')} IS NOT NULL
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'session user', false, 'EventXML.User', {jx('EventXML.User')} FROM ev WHERE Provider = {LSM} AND {jx('EventXML.User')} IS NOT NULL
  UNION ALL SELECT host_id, _rowid, timestamp, log, 'account', false, 'EventXML.User', NULL FROM ev WHERE false),
usable AS (SELECT *, CASE WHEN is_sid THEN '[sid] ' ELSE '[name] ' END || role || ' · ' || path || ' = ' || value AS mark,
    CASE WHEN is_sid THEN lower(value) ELSE lower({bare('value')}) END AS k
  FROM (SELECT *, bool_or(is_sid) OVER (PARTITION BY _rowid, role) AS has_sid FROM ent) WHERE is_sid OR NOT has_sid),
people AS (SELECT c_custkey AS account_id, 's-1-5-21-1-2-3-' || @n(1000 + c_custkey % 200) AS sid, 'user' || @n(c_custkey % 200) AS name FROM customer),
wanted AS (SELECT account_id, true AS is_sid, sid AS k FROM people UNION ALL SELECT account_id, false, name FROM people),
hits AS (SELECT account_id, host_id, _rowid, string_agg(DISTINCT mark, ' | ' ORDER BY mark) AS evidence FROM usable JOIN wanted USING (is_sid, k) GROUP BY 1, 2, 3)"""


@check("j6_account_matches", "ev", MATCH_SQL + " SELECT account_id, host_id, _rowid, evidence FROM hits")
def _(spark, sf):
    return accounts.account_matches(EV(spark, sf), _people(spark, sf)).select("account_id", "host_id", "_rowid", "evidence")


def _people(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select(
        F.col("c_custkey").alias("account_id"), F.concat(F.lit("S-1-5-21-1-2-3-"), (1000 + F.col("c_custkey") % 200).cast("string")).alias("sid"),
        F.concat(F.lit("CORP\\user"), (F.col("c_custkey") % 200).cast("string")).alias("username"))


DEEP_MATCH_SQL = DEEP_SQL + """,
marked AS (SELECT host_id, _rowid, timestamp, sid IS NOT NULL AS is_sid, lower(coalesce(sid, regexp_extract(name, 'user[0-9]+'))) AS k,
  CASE WHEN sid IS NULL THEN '[name] target · ' || below || 'TargetUserName = ' || name ELSE '[sid] target · ' || below || 'TargetUserSid = ' || sid END AS evidence FROM parts)"""


@check("j6_deep_account_matches", "deep", DEEP_MATCH_SQL + """
SELECT c_custkey AS account_id, host_id, _rowid, evidence FROM marked JOIN customer
  ON k = CASE WHEN is_sid THEN 's-1-5-21-1-2-3-' || @n(1000 + c_custkey % 200) ELSE 'user' || @n(c_custkey % 200) END""")
def _(spark, sf):
    return accounts.account_matches(shape(spark, sf, "deep"), _people(spark, sf)).select("account_id", "host_id", "_rowid", "evidence")


@check("q7_deep_account_activity", "deep", DEEP_MATCH_SQL + " SELECT host_id, _rowid, timestamp, evidence FROM marked WHERE k IN ('s-1-5-21-1-2-3-1017', 'user17')")
def _(spark, sf):
    found = accounts.account_events(shape(spark, sf, "deep"), "S-1-5-21-1-2-3-1017", "CORP\\user17")
    return found.select("host_id", "_rowid", "timestamp", "evidence")


Q7_SQL = MATCH_SQL.replace("SELECT c_custkey AS account_id, 's-1-5-21-1-2-3-' || @n(1000 + c_custkey % 200) AS sid, 'user' || @n(c_custkey % 200) AS name FROM customer", "SELECT 17 AS account_id, 's-1-5-21-1-2-3-1017' AS sid, 'user17' AS name") + """,
acts AS (SELECT h.host_id, h._rowid, e.timestamp, e._source_file, h.evidence FROM hits h JOIN ev e ON e._rowid = h._rowid WHERE e.timestamp >= '2024-01-03' AND (contains(lower(e.log), 'security') OR contains(lower(evidence), 'security') OR contains(lower(e.EventData), 'security') OR contains(lower(e.Provider), 'security') OR contains(lower(e._source_file), 'security')))"""


def q7(spark, sf):
    return accounts.account_events(EV(spark, sf), "S-1-5-21-1-2-3-1017", "CORP\\user17", search="Security", start="2024-01-03")


@check("q7_account_activity", "ev", Q7_SQL + " SELECT host_id, _rowid, timestamp, evidence FROM acts")
def _(spark, sf):
    return q7(spark, sf).select("host_id", "_rowid", "timestamp", "evidence")


@check("o3_account_event_page", "ev", Q7_SQL + " SELECT _rowid, timestamp FROM acts ORDER BY (timestamp = ''), timestamp, _source_file, _rowid LIMIT 10 OFFSET 10")
def _(spark, sf):
    return Page(10, 10, 100).apply(q7(spark, sf), accounts.account_event_order()).select("_rowid", "timestamp")


@check("q7_account_total", "ev", Q7_SQL + " SELECT count(*) AS row_count FROM acts")
def _(spark, sf):
    return total_rows(q7(spark, sf))


@check("q7_source_failures", "ev", """
SELECT log, reason FROM (SELECT DISTINCT log || CASE WHEN log = 'Security' THEN '' WHEN log = 'Damaged' THEN '2' ELSE '' END AS log, CASE WHEN log = 'Damaged' THEN 'table not found' WHEN contains(log, 'SMB') THEN 'no time column for the range' END AS reason FROM ev) WHERE reason IS NOT NULL""")
def _(spark, sf):
    logs = EV(spark, sf).select("log").distinct()
    requested = logs.select(F.when(F.col("log") == "Damaged", "Damaged2").otherwise(F.col("log")).alias("log"))
    return accounts.source_failures(requested, logs.withColumn("has_time", ~F.col("log").contains("SMB")), True)


# Validation -----------------------------------------------------------------------------------------------------------

@check("u2_row_differences", "ev", SMB_SQL + """,
a AS (SELECT record_key, account, result FROM smb), b AS (SELECT record_key, CASE WHEN _rowid % 50 = 0 THEN 'changed' ELSE account END AS account, result FROM smb WHERE _rowid % 90 <> 0)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, sf):
    a, b = _versions(spark, sf)
    return compare.row_differences(a, b)


def _versions(spark, sf):
    rows = remote_access.file_share_history(EV(spark, sf))
    a = rows.select("record_key", "account", "result")
    b = rows.filter("_rowid % 90 <> 0").select("record_key", F.when(F.col("_rowid") % 50 == 0, "changed").otherwise(F.col("account")).alias("account"), "result")
    return a, b


@check("u2_column_mismatches", "ev", SMB_SQL + """
SELECT 'account' AS column_name, count(*) FILTER (_rowid % 90 <> 0 AND _rowid % 50 = 0) AS mismatches FROM smb UNION ALL SELECT 'result', 0 UNION ALL SELECT '(missing)', count(*) FILTER (_rowid % 90 = 0) FROM smb""")
def _(spark, sf):
    a, b = _versions(spark, sf)
    return compare.column_mismatches(a, b, ["record_key"])


@check("u2_stored_differences", "ev", SMB_SQL + """,
a AS (SELECT record_key, account, result FROM smb), b AS (SELECT record_key, CASE WHEN _rowid % 50 = 0 THEN 'changed' ELSE account END AS account, result FROM smb WHERE _rowid % 90 <> 0)
SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, sf):
    """Two stored versions, narrowed down by digests of their key ranges before rows are compared."""
    return compare.stored_row_differences(*_stored_versions(spark, sf), ["record_key"])


@check("u2_stored_mismatches", "ev", SMB_SQL + """
SELECT 'account' AS column_name, count(*) FILTER (_rowid % 90 <> 0 AND _rowid % 50 = 0) AS mismatches FROM smb UNION ALL SELECT 'result', 0 UNION ALL SELECT '(missing)', count(*) FILTER (_rowid % 90 = 0) FROM smb""")
def _(spark, sf):
    return compare.stored_column_mismatches(*_stored_versions(spark, sf), ["record_key"])


def _stored_versions(spark, sf):
    stored = []
    for df in _versions(spark, sf):
        folder = scratch_folder(spark, "version")
        df.write.parquet(folder)
        stored.append(spark.read.parquet(folder))
    return stored
