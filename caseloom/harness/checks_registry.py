"""Checked queries over registry, account and execution evidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from caseloom.functions import lookups, tags
from caseloom.functions import text as tx
from caseloom.functions.core import text
from caseloom.harness.registry import check
from caseloom.harness.shapes import filetime, kst, le, shape
from caseloom.operators import ordered
from caseloom.operators.filters import untimed_or_in_range
from caseloom.plans import execution as ex
from caseloom.plans import registry_facts as rf
from caseloom.plans import search, sessions
from caseloom.sources import raw, records

KEYS = ["host_id"]
LIVE = "(_recovery IS NULL OR _recovery = 'live')"
PATH_TAGS = """concat_ws(',', CASE WHEN regexp_matches({p}, '(?i)\\\\(appdata\\\\local\\\\)?temp\\\\') THEN 'temp_folder' END, CASE WHEN contains(lower({p}), '\\downloads\\') THEN 'downloads_folder' END,
  CASE WHEN contains(lower({p}), '\\users\\public\\') THEN 'public_folder' END, CASE WHEN contains(replace(lower({p}), '\\programdata\\microsoft\\', ''), '\\programdata\\') THEN 'programdata' END,
  CASE WHEN regexp_matches({p}, '(?i)\\\\(powershell|wscript|cscript|mshta|regsvr32|rundll32|certutil)\\.exe') THEN 'lolbin' END)"""


def path_tags(p: str) -> str:
    return PATH_TAGS.replace("{p}", f"coalesce({p}, '')")


# Registry scans -------------------------------------------------------------------------------------------------------

@check("s6_hive_scans", "reg", f"""
SELECT 'SYSTEM' AS scan, _source_file, _rowid, key_path FROM reg WHERE upper(hive) = 'SYSTEM' AND {LIVE} UNION ALL SELECT 'users', _source_file, _rowid, key_path FROM reg WHERE upper(hive) LIKE '%NTUSER.DAT' AND {LIVE}
UNION ALL SELECT 'all', _source_file, _rowid, key_path FROM reg WHERE {LIVE}""".strip())
def _(spark, sf):
    reg = shape(spark, sf, "reg")
    found = lambda df, name: df.select(F.lit(name).alias("scan"), "_source_file", "_rowid", "key_path")
    return found(raw.hive(reg, "system"), "SYSTEM").unionByName(found(raw.user_hives(reg), "users")).unionByName(found(raw.live_hives(reg), "all"))


@check("s7_live_rows", "reg", f"SELECT _rowid, {LIVE} AS live FROM reg")
def _(spark, sf):
    return shape(spark, sf, "reg").select("_rowid", raw.is_live().alias("live"))


@check("w6_first_per_key", "reg", f"SELECT value_name, arg_min(value_data, (_source_file, _rowid)) AS value_data, min((_source_file, _rowid))[2] AS _rowid FROM (SELECT * FROM reg WHERE {LIVE}) GROUP BY 1")
def _(spark, sf):
    rows = raw.live_hives(shape(spark, sf, "reg"))
    return ordered.first_per_key(rows, ["value_name"], raw.scan_seq()).select("value_name", "value_data", "_rowid")


@check("f31_path_tags", "reg", f"SELECT _rowid, {path_tags('value_data')} AS tags FROM reg")
def _(spark, sf):
    return shape(spark, sf, "reg").select("_rowid", tags.tag_codes(tags.path_tags("value_data")).alias("tags"))


USER = "CASE WHEN hive = 'SOFTWARE' THEN '(system)' ELSE regexp_replace(hive, '_NTUSER\\.DAT$', '') END"
FIND_SQL = f"""
live AS (SELECT *, lower(key_path) AS low FROM reg WHERE {LIVE} AND value_name <> '' AND value_name <> '(default)'),
autorun AS (SELECT host_id, 'autorun' AS category, value_name AS name, value_data AS value, 'info' AS status, CASE WHEN low LIKE '%runonce' THEN 'RunOnce' WHEN contains(low, 'policies') THEN 'Policy Run' ELSE 'Run' END AS detail,
    value_data AS command, {USER} AS user, CAST(NULL AS STRING) AS subtype, last_write AS timestamp FROM live WHERE low LIKE '%\\currentversion\\run' OR low LIKE '%\\currentversion\\runonce' OR low LIKE '%\\policies\\explorer\\run'),
trace AS (SELECT host_id, 'other' AS category, CASE WHEN low LIKE '%runmru' THEN 'RunMRU' ELSE 'TypedPath' END AS name, CASE WHEN low LIKE '%runmru' THEN regexp_replace(value_data, '\\\\1$', '') ELSE value_data END AS value, 'info' AS status, CAST(NULL AS STRING) AS detail,
    CASE WHEN low LIKE '%runmru' THEN regexp_replace(value_data, '\\\\1$', '') END AS command, {USER} AS user, CASE WHEN low LIKE '%runmru' THEN 'RunMRU' ELSE 'TypedPaths' END AS subtype, last_write AS timestamp
    FROM live WHERE value_name NOT IN ('MRUList', 'MRUListEx') AND (low LIKE '%\\explorer\\runmru' OR low LIKE '%\\explorer\\typedpaths'))"""
FIND_COLUMNS = ["host_id", "category", "name", "value", "status", "detail", "command", "user", "subtype", "timestamp"]


@check("c18_autoruns", "reg", FIND_SQL + " SELECT * FROM autorun")
def _(spark, sf):
    return rf.autoruns(raw.live_hives(shape(spark, sf, "reg")), KEYS).select(*FIND_COLUMNS)


@check("c19_execution_traces", "reg", FIND_SQL + " SELECT * FROM trace")
def _(spark, sf):
    return rf.execution_traces(raw.live_hives(shape(spark, sf, "reg")), KEYS).select(*FIND_COLUMNS)


# Facts ----------------------------------------------------------------------------------------------------------------

def pick(suffix: str, name: str) -> str:
    where = f"lower(key_path) LIKE '%{suffix}' AND value_name = '{name}' AND value_data <> ''"
    return f"arg_min(value_data, (NOT contains(lower(key_path), 'controlset001'), _source_file, _rowid)) FILTER ({where})"


PICK_SQL = f"""
picks AS (SELECT host_id, {pick('securityproviders' + chr(92) + 'wdigest', 'UseLogonCredential')} AS wdigest, {pick('control' + chr(92) + 'lsa', 'RunAsPPL')} AS ppl, {pick('services' + chr(92) + 'lanmanserver', 'Start')} AS server_start,
  {pick('lanmanserver' + chr(92) + 'parameters', 'AutoShareServer')} AS auto_server, {pick('lanmanserver' + chr(92) + 'parameters', 'AutoShareWks')} AS auto_workstation,
  {pick('computername' + chr(92) + 'computername', 'ComputerName')} AS computer_name, {pick('control' + chr(92) + 'timezoneinformation', 'TimeZoneKeyName')} AS time_zone,
  {pick('control' + chr(92) + 'windows', 'ShutdownTime')} AS shutdown FROM facts WHERE hive = 'SYSTEM' GROUP BY 1)"""


@check("c21_registry_picks", "facts", PICK_SQL + " SELECT * FROM picks")
def _(spark, sf):
    return rf.registry_picks(raw.hive(shape(spark, sf, "facts"), "SYSTEM"), rf.SYSTEM_PICKS)


@check("c15_credential_protection", "facts", PICK_SQL + """
SELECT host_id, 'WDigest UseLogonCredential' AS name, CASE wdigest WHEN '1' THEN '1 (on)' WHEN '0' THEN '0 (off)' ELSE 'not set (default)' END AS value, CASE wdigest WHEN '1' THEN 'suspicious' WHEN '0' THEN 'normal' ELSE 'info' END AS status FROM picks
UNION ALL SELECT host_id, 'LSASS protection (RunAsPPL)', CASE WHEN ppl IN ('1', '2') THEN ppl || ' (on)' ELSE 'not set' END, CASE WHEN ppl IN ('1', '2') THEN 'normal' ELSE 'caution' END FROM picks""")
def _(spark, sf):
    picks = rf.registry_picks(raw.hive(shape(spark, sf, "facts"), "SYSTEM"), rf.SYSTEM_PICKS)
    return rf.credential_protection(picks, KEYS).select("host_id", "name", "value", "status")


SHARE_SQL = PICK_SQL + """,
shares AS (SELECT host_id, 'file server service' AS name, CASE server_start WHEN '2' THEN 'automatic' WHEN '3' THEN 'manual' WHEN '4' THEN 'disabled' END AS value, CASE WHEN server_start IN ('2', '3') THEN 'info' ELSE 'normal' END AS status FROM picks
  UNION ALL SELECT host_id, 'administrative shares (AutoShareServer)', '0 (off)', 'info' FROM picks WHERE auto_server = '0'
  UNION ALL SELECT host_id, 'administrative shares (AutoShareWks)', '0 (off)', 'info' FROM picks WHERE auto_workstation = '0'
  UNION ALL SELECT host_id, value_name, CASE WHEN data LIKE '[%' THEN json_extract_string(data, '$[1]')[6:] ELSE data END, 'caution' FROM (SELECT host_id, value_name, arg_min(value_data, (_source_file, _rowid)) AS data FROM facts WHERE key_path LIKE '%LanmanServer\\Shares' AND value_name <> '(default)' GROUP BY 1, 2))"""


@check("c16_shares", "facts", SHARE_SQL + " SELECT * FROM shares")
def _(spark, sf):
    system = raw.hive(shape(spark, sf, "facts"), "SYSTEM")
    return rf.shares(system, rf.registry_picks(system, rf.SYSTEM_PICKS), KEYS).select("host_id", "name", "value", "status")


SQLAUTH = """
sqlauth AS (SELECT host_id, 'LoginMode — ' || split_part(inst, '.', 2) || coalesce(' · SQL Server ' || y, '') AS name,
  CASE value_data WHEN '1' THEN 'Windows authentication only' WHEN '2' THEN 'mixed mode' ELSE 'unknown(' || value_data || ')' END AS value, CASE value_data WHEN '2' THEN 'caution' WHEN '1' THEN 'normal' ELSE 'info' END AS status FROM
  (SELECT *, split_part(key_path, chr(92), 5) AS inst FROM facts WHERE value_name = 'LoginMode') LEFT JOIN (VALUES ('10', '2008'), ('11', '2012'), ('12', '2014'), ('13', '2016'), ('14', '2017'), ('15', '2019'), ('16', '2022'), ('17', '2025')) v(n, y) ON n = replace(split_part(inst, '.', 1), 'MSSQL', ''))"""


@check("c17_sql_authentication", "facts", SQLAUTH + " SELECT * FROM sqlauth")
def _(spark, sf):
    return rf.sql_authentication(raw.hive(shape(spark, sf, "facts"), "SOFTWARE"), KEYS).select("host_id", "name", "value", "status")


TICKS = le("shutdown", 0, 8)
FACT_SQL = PICK_SQL + f""",
sysfacts AS (SELECT host_id, value_name AS name, CASE WHEN value_name = 'InstallDate' THEN {kst('CAST(data AS BIGINT) * 1000000')} ELSE data END AS value FROM (SELECT host_id, value_name, arg_min(value_data, (_source_file, _rowid)) AS data FROM facts
    WHERE hive = 'SOFTWARE' AND key_path LIKE '%Windows NT\\CurrentVersion' AND NOT (value_name = 'InstallDate' AND value_data = '0') GROUP BY 1, 2)
  UNION ALL SELECT host_id, 'ComputerName', computer_name FROM picks UNION ALL SELECT host_id, 'TimeZone', time_zone FROM picks UNION ALL SELECT host_id, 'LastShutdownTime', {filetime(TICKS)} FROM picks)"""


@check("c11_system_facts", "facts", FACT_SQL + " SELECT * FROM sysfacts")
def _(spark, sf):
    return rf.system_facts(shape(spark, sf, "facts")).select("host_id", "name", "value")


def last(value_name: str) -> str:
    return f"arg_max(value_data, _rowid) FILTER (value_name = '{value_name}')"


NET_SQL = f"""
prof AS (SELECT host_id, key_path, {last('ProfileName')} AS n, {last('DateLastConnected')} AS d FROM facts WHERE contains(key_path, 'NetworkList') GROUP BY 1, 2),
nets AS (SELECT host_id, n AS value, printf('%04d-%02d-%02d %02d:%02d:%02d', {le('d', 0, 2)}, {le('d', 2, 2)}, {le('d', 6, 2)}, {le('d', 8, 2)}, {le('d', 10, 2)}, {le('d', 12, 2)}) AS timestamp FROM prof WHERE n <> ''),
ifc AS (SELECT host_id, split_part(key_path, chr(92), 7) AS name, {last('IPAddress')} AS a, {last('DhcpIPAddress')} AS b, {last('EnableDHCP')} AS e, {last('LeaseObtainedTime')} AS l, {last('DhcpSubnetMask')} AS m FROM facts WHERE contains(key_path, 'Tcpip') GROUP BY 1, 2),
faces AS (SELECT host_id, name, coalesce(nullif(nullif(json_extract_string(nullif(a, ''), '$[0]'), '0.0.0.0'), ''), nullif(b, '')) AS value, CASE e WHEN '1' THEN 'yes' WHEN '0' THEN 'no' END AS dhcp_enabled, m AS subnet_mask, {kst('CAST(l AS BIGINT) * 1000000')} AS lease_obtained FROM ifc),
faces1 AS (SELECT * FROM faces WHERE value IS NOT NULL AND value <> '0.0.0.0')"""


@check("a16_networks", "facts", NET_SQL + " SELECT * FROM nets")
def _(spark, sf):
    return rf.networks(shape(spark, sf, "facts")).select("host_id", "value", "timestamp")


@check("a16_interfaces", "facts", NET_SQL + " SELECT * FROM faces1")
def _(spark, sf):
    return rf.network_interfaces(shape(spark, sf, "facts")).select("host_id", "name", "value", "dhcp_enabled", "subnet_mask", "lease_obtained")


def shown_facts(spark, sf):
    """Facts as an overview holds them: empty values come first, each row is repeated at the end, and later ones differ."""
    facts = shape(spark, sf, "facts")
    columns = ["host_id", "category", "name", "value", "timestamp", "subnet_mask"]
    pick = lambda df, place, **new: df.withColumns({c: F.lit(None).cast("string") for c in columns if c not in df.columns}).withColumns(new).select(*columns, F.lit(place).alias("place"))
    system, faces = rf.system_facts(facts), rf.network_interfaces(facts)
    later = F.concat("value", F.lit(" later"))
    parts = [pick(system, 9, value=later), pick(system, 2), pick(system, 1, value=F.lit("")), pick(system, 9), pick(rf.networks(facts), 1), pick(rf.networks(facts), 5),
             pick(faces, 7, subnet_mask=F.lit("later")), pick(faces, 3), pick(faces, 8)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rf.deduplicated_facts(rows.withColumn("log", F.lit("overview")), ["log", "place"])


SHOWN_SQL = FACT_SQL + "," + NET_SQL.strip()


@check("a13_deduplicated_facts", "facts", NET_SQL + " SELECT host_id, value AS name, max(timestamp) AS timestamp FROM nets GROUP BY 1, 2")
def _(spark, sf):
    return shown_facts(spark, sf)["networks"]


@check("a13_first_system_values", "facts", SHOWN_SQL + " SELECT host_id, name, nullif(value, '') AS value FROM sysfacts")
def _(spark, sf):
    return shown_facts(spark, sf)["system"]


@check("a13_first_interfaces", "facts", SHOWN_SQL + " SELECT host_id, name, value, subnet_mask, 3 AS place FROM faces1")
def _(spark, sf):
    return shown_facts(spark, sf)["interfaces"].select("host_id", "name", "value", "subnet_mask", "place")


@check("a13_distinct_rows", "facts", SHOWN_SQL + """
SELECT DISTINCT host_id, name, value, timestamp, place FROM (SELECT host_id, 'connected network' AS name, value, timestamp, 1 AS place FROM nets UNION ALL SELECT host_id, name, value, NULL, 3 FROM faces1)""")
def _(spark, sf):
    return shown_facts(spark, sf)["rows"].filter("category in ('Network', 'NetworkInterface')").select("host_id", "name", "value", "timestamp", "place")


@check("j10_host_addresses", "facts", NET_SQL + " SELECT value AS ip, min(host_id) AS peer_host FROM faces1 GROUP BY 1")
def _(spark, sf):
    return rf.host_addresses(rf.network_interfaces(shape(spark, sf, "facts")))


@check("c8_registry_findings", "facts reg", FIND_SQL + "," + SHARE_SQL + "," + SQLAUTH + """,
hosts AS (SELECT DISTINCT host_id FROM facts UNION SELECT DISTINCT host_id FROM reg), p2 AS (SELECT * FROM hosts LEFT JOIN picks USING (host_id))
SELECT host_id, category, status, count(*) AS rows FROM (SELECT host_id, category, status FROM autorun UNION ALL SELECT host_id, category, status FROM trace UNION ALL SELECT host_id, 'shares', status FROM shares UNION ALL SELECT host_id, 'SQL authentication', status FROM sqlauth
  UNION ALL SELECT host_id, 'credential protection', CASE wdigest WHEN '1' THEN 'suspicious' WHEN '0' THEN 'normal' ELSE 'info' END FROM p2 UNION ALL SELECT host_id, 'credential protection', CASE WHEN ppl IN ('1', '2') THEN 'normal' ELSE 'caution' END FROM p2) GROUP BY 1, 2, 3""")
def _(spark, sf):
    return findings(spark, sf).groupBy("host_id", "category", "status").agg(F.count(F.lit(1)).alias("rows"))


def findings(spark, sf):
    columns = ["host_id", "hive", "key_path", "value_name", "value_data", "last_write", "_recovery", "_source_file", "_rowid"]
    both = shape(spark, sf, "facts").select(*columns).unionByName(shape(spark, sf, "reg").select(*columns))
    return rf.registry_findings(both)


@check("q19_finding_display", "reg", FIND_SQL + f" SELECT host_id, name, value, CASE WHEN category = 'autorun' AND {path_tags('coalesce(command, value)')} <> '' THEN 'suspicious' ELSE status END AS status FROM (SELECT * FROM autorun UNION ALL SELECT * FROM trace)")
def _(spark, sf):
    rows = raw.live_hives(shape(spark, sf, "reg"))
    return rf.finding_display(rf.autoruns(rows, KEYS).unionByName(rf.execution_traces(rows, KEYS))).select("host_id", "name", "value", "status")


@check("a14_finding_groups", "reg", FIND_SQL + " SELECT host_id, CAST(CASE category WHEN 'autorun' THEN 4 ELSE 5 END AS BIGINT) AS position, category, CASE category WHEN 'autorun' THEN user ELSE subtype END AS tab, count(*) AS rows FROM (SELECT * FROM autorun UNION ALL SELECT * FROM trace) GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    rows = raw.live_hives(shape(spark, sf, "reg"))
    return rf.finding_groups(rf.autoruns(rows, KEYS).unionByName(rf.execution_traces(rows, KEYS)))


@check("p5_untimed_survive", "reg", "SELECT _rowid FROM (SELECT *, CASE WHEN _rowid % 4 = 0 THEN NULL ELSE last_write END AS t FROM reg) WHERE t IS NULL OR (t >= '2024-01-01 10:00:00.000' AND t <= '2024-01-01 20:59:59.999')")
def _(spark, sf):
    rows = shape(spark, sf, "reg").withColumn("t", F.when(F.col("_rowid") % 4 != 0, F.col("last_write")))
    return rows.filter(untimed_or_in_range("t", "2024-01-01 10:00", "2024-01-01 20:59")).select("_rowid")


# Accounts -------------------------------------------------------------------------------------------------------------

F_ = "f"
ACCT_SQL = f"""
pr AS (SELECT host_id, split_part(key_path, chr(92), -1) AS sid, arg_max(value_data, _rowid) AS path, min(_rowid) AS seen FROM acct WHERE value_name = 'ProfileImagePath' GROUP BY 1, 2),
px AS (SELECT host_id, regexp_replace(arg_min(sid, seen), '-[^-]*$', '') AS prefix FROM pr WHERE sid LIKE 'S-1-5-21-%' GROUP BY 1),
us AS (SELECT host_id, CAST('0x' || right(key_path, 8) AS BIGINT) AS rid, max(value_data) FILTER (value_name = 'F') AS f, max(value_data) FILTER (value_name = 'V') AS v FROM acct WHERE hive = 'SAM' AND NOT contains(key_path, 'Names') GROUP BY 1, 2),
nm AS (SELECT host_id, lower(split_part(key_path, chr(92), -1)) AS name, max(last_write) AS created FROM acct WHERE contains(key_path, 'Users\\Names\\') GROUP BY 1, 2),
hd AS (SELECT host_id, lower(value_name) AS name, max(trim(value_data)) AS special FROM acct WHERE key_path LIKE '%UserList' GROUP BY 1, 2),
ac AS (SELECT u.host_id, prefix || '-' || rid AS sid, 'Customer#' || lpad(@n(rid - 1000), 9, '0') AS username, 'Fullname#' || lpad(@n(rid - 1000), 9, '0') AS full_name, @n(rid) AS rid,
    @n({le('f', 0x30, 4)}) AS rid_sam, {filetime(le('f', 8, 8))} AS last_login, {filetime(le('f', 0x18, 8))} AS password_last_set, {filetime(le('f', 0x28, 8))} AS last_failed_login,
    @n({le('f', 0x42, 2)}) AS login_count, @n({le('f', 0x40, 2)}) AS failed_login_count, CASE WHEN {le('f', 0x38, 2)} % 2 = 1 THEN 'yes' ELSE 'no' END AS disabled FROM us u LEFT JOIN px USING (host_id)),
acc AS (SELECT ac.*, nullif(pr.path, '') AS path, nm.created, CASE WHEN special IN ('0', '0x0') THEN 'yes (hidden from the logon screen)' WHEN special IS NOT NULL THEN 'list value ' || special END AS special_account
  FROM ac LEFT JOIN pr USING (host_id, sid) LEFT JOIN nm ON nm.host_id = ac.host_id AND nm.name = lower(username) LEFT JOIN hd ON hd.host_id = ac.host_id AND hd.name = lower(username))"""
ACCT_COLUMNS = ["host_id", "sid", "username", "full_name", "rid", "rid_sam", "path", "created", "last_login", "password_last_set", "last_failed_login", "login_count", "failed_login_count", "disabled", "special_account"]


def accounts(spark, sf):
    return rf.accounts(shape(spark, sf, "acct")).withColumnRenamed("name", "sid").withColumnRenamed("value", "path")


@check("j2_account_assembly", "acct", ACCT_SQL + " SELECT " + ", ".join(ACCT_COLUMNS) + " FROM acc")
def _(spark, sf):
    return accounts(spark, sf).filter("source_artifact = 'SAM'").select(*ACCT_COLUMNS)


ORPHAN_SQL = ACCT_SQL + """, orph AS (SELECT host_id, sid, path, CASE WHEN sid = 'S-1-5-18' THEN 'LocalSystem' ELSE coalesce(nullif(split_part(rtrim(path, chr(92)), chr(92), -1), ''), sid) END AS username FROM pr WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.host_id = pr.host_id AND acc.sid = pr.sid))"""


@check("j3_profiles_without_account", "acct", ORPHAN_SQL + " SELECT * FROM orph")
def _(spark, sf):
    return accounts(spark, sf).filter("source_artifact = 'ProfileList'").select("host_id", "sid", "path", "username")


@check("c6_target_info", "acct facts", ORPHAN_SQL + "," + FACT_SQL + "," + NET_SQL + """
SELECT host_id, category, source_artifact, count(*) AS rows, count(value) AS with_value FROM (SELECT host_id, 'Account' AS category, 'SAM' AS source_artifact, path AS value FROM acc UNION ALL SELECT host_id, 'Account', 'ProfileList', nullif(path, '') FROM orph
  UNION ALL SELECT host_id, 'SystemInfo', CASE WHEN name IN ('ComputerName', 'TimeZone', 'LastShutdownTime') THEN 'SYSTEM' ELSE 'SOFTWARE' END, value FROM sysfacts UNION ALL SELECT host_id, 'Network', 'NetworkList', value FROM nets UNION ALL SELECT host_id, 'NetworkInterface', 'Tcpip', value FROM faces1) GROUP BY 1, 2, 3""")
def _(spark, sf):
    info = rf.target_info(shape(spark, sf, "facts").unionByName(shape(spark, sf, "acct")))
    return info.groupBy("host_id", "category", "source_artifact").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("with_value"))


@check("q22_rid_mismatch", "acct", ACCT_SQL + " SELECT host_id, rid, rid_sam FROM acc WHERE rid <> rid_sam")
def _(spark, sf):
    return rf.rid_mismatches(rf.accounts(shape(spark, sf, "acct"))).select("host_id", "rid", "rid_sam")


@check("p16_interactive_users", "acct", ORPHAN_SQL + """
SELECT sid, coalesce(sid LIKE 'S-1-5-21-%' AND (CAST(split_part(sid, '-', -1) AS BIGINT) = 500 OR CAST(split_part(sid, '-', -1) AS BIGINT) >= 1000), false) AS is_user, count(*) AS rows FROM (SELECT sid FROM acc UNION ALL SELECT sid FROM orph) GROUP BY 1, 2""")
def _(spark, sf):
    return accounts(spark, sf).groupBy("sid", tags.is_interactive_user("sid").alias("is_user")).agg(F.count(F.lit(1)).alias("rows"))


@check("f27_sid_labels", "acct", "SELECT sid, CASE WHEN sid = 'S-1-5-18' THEN sid || ' (LocalSystem)' WHEN sid LIKE 'S-1-5-21-%-500' THEN sid || ' (Administrator)' ELSE sid END AS label FROM (SELECT DISTINCT split_part(key_path, chr(92), -1) AS sid FROM acct WHERE value_name = 'ProfileImagePath')")
def _(spark, sf):
    rows = shape(spark, sf, "acct").filter("value_name = 'ProfileImagePath'").select(tx.last_segment("key_path").alias("sid")).distinct()
    return rows.select("sid", lookups.sid_label("sid").alias("label"))


# Execution ------------------------------------------------------------------------------------------------------------

UA_SQL = f"""
ua AS (SELECT *, @rot[value_name] AS path FROM hexs WHERE contains(key_path, 'UserAssist')),
userassist AS (SELECT host_id, path AS program_path, split_part(path, chr(92), -1) AS program_name, CASE WHEN full_ THEN @n({le('value_data', 4, 4)}) END AS run_count, CASE WHEN full_ THEN @n({le('value_data', 8, 4)}) END AS focus_count,
  CASE WHEN full_ THEN @n({le('value_data', 12, 4)}) END AS focus_time_ms, CASE WHEN full_ THEN {filetime(le('value_data', 60, 8))} END AS timestamp, replace(hive, '_NTUSER.DAT', '') AS user, hive || '::Registry::' || @n(_rowid) AS record_key
  FROM (SELECT *, length(value_data) >= 136 AND length(value_data) % 2 = 0 AS full_ FROM ua WHERE path <> 'UEME_CTLSESSION')),
bam AS (SELECT host_id, value_name AS program_path, split_part(value_name, chr(92), -1) AS program_name, split_part(key_path, chr(92), -1) AS user, CASE WHEN length(value_data) >= 16 THEN {filetime(le('value_data', 0, 8))} END AS timestamp,
  'SYSTEM::Registry::' || @n(_rowid) AS record_key FROM hexs WHERE contains(key_path, 'bam') AND lower(value_name) LIKE '%.exe')"""


@check("c20_compatibility_cache", "shim", f"""
e AS (SELECT host_id, 'C:\\a\\' || lpad(@n(_rowid), 9, '0') || '.exe' AS value, 133000000000000000 + _rowid * 864000000005 AS t, _rowid, 0 AS i FROM shim UNION ALL SELECT host_id, 'D:\\b\\' || lpad(@n(_rowid @div 10), 9, '0') || '.dll', 132000000000000000 + _rowid * 10, _rowid, 1 FROM shim),
f AS (SELECT host_id, value, arg_min(t, (_rowid, i)) AS t FROM e GROUP BY 1, 2) SELECT host_id, value, {filetime('t')} AS timestamp FROM f""")
def _(spark, sf):
    return rf.compatibility_cache(shape(spark, sf, "shim"), KEYS).select("host_id", "value", "timestamp")


@check("c12_usage_counters", "hexs", UA_SQL + " SELECT * FROM userassist")
def _(spark, sf):
    return ex.usage_counters(shape(spark, sf, "hexs")).select("host_id", "program_path", "program_name", "run_count", "focus_count", "focus_time_ms", "timestamp", "user", "record_key")


@check("c13_activity_moderator", "hexs", UA_SQL + " SELECT * FROM bam")
def _(spark, sf):
    return ex.activity_moderator(shape(spark, sf, "hexs")).select("host_id", "program_path", "program_name", "user", "timestamp", "record_key")


SRUM_SQL = """
sight AS (SELECT host_id, app AS program_path, user, nullif(arg_min(timestamp, (coalesce(nullif(timestamp, ''), '~'), _source_file, _rowid)), '') AS timestamp, arg_min(_rowid, (coalesce(nullif(timestamp, ''), '~'), _source_file, _rowid)) AS r FROM usage WHERE lower(app) NOT LIKE 'svc.%' GROUP BY 1, 2, 3)"""


@check("a1_first_sightings", "usage", SRUM_SQL + " SELECT host_id, program_path, split_part(program_path, chr(92), -1) AS program_name, user, timestamp, 'SRUDB::SRUM_ApplicationResourceUsage::' || @n(r) AS record_key FROM sight")
def _(spark, sf):
    return ex.first_sightings(shape(spark, sf, "usage")).select("host_id", "program_path", "program_name", "user", "timestamp", "record_key")


EXEC_SQL = UA_SQL + "," + SRUM_SQL + """,
exec AS (SELECT host_id, timestamp, Name AS program_name, RootDirPath AS program_path, nullif(Publisher, '') AS publisher, CAST(NULL AS STRING) AS user, CAST(NULL AS STRING) AS run_count, 'Amcache_Programs' AS source_artifact, 'Amcache::Amcache_Programs::' || @n(_rowid) AS record_key FROM amp
  UNION ALL SELECT host_id, timestamp, name, lower_case_long_path, nullif(publisher, ''), NULL, NULL, 'Amcache_Files', 'Amcache::Amcache_Files::' || @n(_rowid) FROM amf
  UNION ALL SELECT host_id, timestamp, program_name, program_path, NULL, user, run_count, 'UserAssist', record_key FROM userassist
  UNION ALL SELECT host_id, timestamp, split_part(program_path, chr(92), -1), program_path, NULL, user, NULL, 'SRUM', 'SRUDB::SRUM_ApplicationResourceUsage::' || @n(r) FROM sight
  UNION ALL SELECT host_id, timestamp, program_name, program_path, NULL, user, NULL, 'BAM', record_key FROM bam
  UNION ALL SELECT host_id, nullif(last_run_time, ''), executable_filename, NULL, NULL, NULL, run_count, 'Prefetch', 'Prefetch_Execution::Prefetch_Execution::' || @n(_rowid) FROM runs)"""
EXEC_SHAPES = "amp amf hexs usage runs"
EXEC_COLUMNS = ["host_id", "timestamp", "program_name", "program_path", "publisher", "user", "run_count", "source_artifact", "record_key"]


def history(spark, sf):
    s = lambda name: shape(spark, sf, name)
    return ex.execution_history(s("amp"), s("amf"), s("hexs"), s("usage"), s("runs"))


@check("c7_execution_history", EXEC_SHAPES, EXEC_SQL + " SELECT * FROM exec")
def _(spark, sf):
    return history(spark, sf).select(*EXEC_COLUMNS)


EXE = "(?i)\\.(exe|dll|sys|scr|com|bat|cmd|ps1|vbs|js|jse|wsf|hta|msi)$"
REVIEW_SQL = EXEC_SQL + f""",
rv0 AS (SELECT *, coalesce(program_name, '(no name)') AS shown_name, CASE WHEN source_artifact LIKE 'Amcache%' THEN 'Amcache' ELSE source_artifact END AS source, {path_tags('program_path')} AS tags,
  source_artifact LIKE 'Amcache%' AND trim(coalesce(publisher, '')) = '' AND (regexp_matches(coalesce(program_name, ''), '{EXE}') OR regexp_matches(coalesce(program_path, ''), '{EXE}')) AS unsigned,
  regexp_matches(lower(coalesce(program_path, '')), '^[a-z]:\\\\windows(\\\\|$)') OR regexp_matches(lower(coalesce(program_path, '')), '\\\\device\\\\harddiskvolume\\d+\\\\windows\\\\') AS system_path FROM exec),
rv AS (SELECT *, CASE WHEN contains(tags, 'lolbin') THEN 2 WHEN tags <> '' OR unsigned THEN 1 ELSE 0 END AS risk FROM rv0)"""


@check("q17_execution_review", EXEC_SHAPES, REVIEW_SQL + " SELECT record_key, shown_name, source, tags, unsigned, system_path, risk FROM rv")
def _(spark, sf):
    rows = ex.review(history(spark, sf))
    return rows.select("record_key", "shown_name", "source", tags.tag_codes(F.col("tags")).alias("tags"), "unsigned", "system_path", "risk")


@check("p14_execution_filter", EXEC_SHAPES, REVIEW_SQL + " SELECT record_key, risk FROM rv WHERE source <> 'BAM' AND NOT system_path AND risk > 0 AND (contains(lower(shown_name), 'ring') OR contains(lower(coalesce(program_path, '')), 'ring') OR contains(lower(coalesce(publisher, '')), 'ring') OR contains(lower(coalesce(user, '')), 'ring') OR contains(lower(source), 'ring'))")
def _(spark, sf):
    return ex.review_filter(ex.review(history(spark, sf)), ("BAM",), exclude_system=True, only_risk=True, search=" Ring ").select("record_key", "risk")


@check("p15_system_paths", EXEC_SHAPES, REVIEW_SQL + " SELECT record_key, program_path, system_path FROM rv")
def _(spark, sf):
    return ex.review(history(spark, sf)).select("record_key", "program_path", "system_path")


@check("o5_risk_order", EXEC_SHAPES, REVIEW_SQL + " SELECT record_key, risk, timestamp FROM rv ORDER BY risk DESC, coalesce(timestamp, '') DESC, record_key LIMIT 40")
def _(spark, sf):
    return ex.review(history(spark, sf)).orderBy(*ex.review_order("risk")).limit(40).select("record_key", "risk", "timestamp")


@check("a11_execution_sources", EXEC_SHAPES, REVIEW_SQL + " SELECT host_id, source, count(*) AS rows FROM rv GROUP BY 1, 2")
def _(spark, sf):
    return ex.source_counts(ex.review(history(spark, sf)))


@check("u1_branch_union", EXEC_SHAPES, EXEC_SQL + " SELECT source_artifact, count(*) AS rows, count(user) AS with_user, count(publisher) AS with_publisher FROM exec GROUP BY 1")
def _(spark, sf):
    return history(spark, sf).groupBy("source_artifact").agg(F.count(F.lit(1)).alias("rows"), F.count("user").alias("with_user"), F.count("publisher").alias("with_publisher"))


@check("s14_usage_ids", "srum idmap", f"""
names AS (SELECT IdIndex, CASE WHEN IdType = 3 THEN 'S-1-5-21-1-2-3-' || @n(1000 + IdIndex - 1000000) ELSE 'App' || @n(IdIndex) END AS t FROM idmap)
SELECT l_orderkey, l_linenumber, a.t AS app, u.t AS user, {kst('CAST(round(TimeStamp * 86400000000.0) AS BIGINT) - 2209161600000000')} AS timestamp FROM srum LEFT JOIN names a ON a.IdIndex = AppId LEFT JOIN names u ON u.IdIndex = UserId""")
def _(spark, sf):
    resolved = records.resolve_usage(shape(spark, sf, "srum"), records.id_names(shape(spark, sf, "idmap")), [])
    return resolved.select("l_orderkey", "l_linenumber", "app", "user", records.usage_time(F.col("TimeStamp")).alias("timestamp"))


INV_SQL = """
w AS (SELECT host_id, key_path, max(last_write) AS timestamp, max(value_data) FILTER (value_name = 'Name') AS name, nullif(max(value_data) FILTER (value_name = 'Publisher'), '') AS publisher, max(value_data) FILTER (value_name = 'LowerCaseLongPath') AS lower_case_long_path,
  @n(CAST(max(value_data) FILTER (value_name = 'Size') AS BIGINT)) AS size, max(value_data) FILTER (value_name = 'FileId') AS fid, substr(max(value_data) FILTER (value_name = 'ProgramId'), 5) AS program_id, max(value_data) FILTER (value_name = 'OriginalFileName') AS original_file_name FROM inv GROUP BY 1, 2),
invf AS (SELECT host_id, key_path, timestamp, name, publisher, lower_case_long_path, size, CASE WHEN fid = '0' THEN NULL ELSE substr(fid, 5) END AS "SHA1", CASE WHEN fid = '0' THEN fid ELSE substr(fid, 5) END AS file_id, program_id, original_file_name FROM w)"""
INV_COLUMNS = ["host_id", "key_path", "timestamp", "name", "publisher", "lower_case_long_path", "size", "SHA1", "file_id", "program_id", "original_file_name"]


@check("s16_inventory_records", "inv", INV_SQL + " SELECT * FROM invf")
def _(spark, sf):
    return records.inventory_records(shape(spark, sf, "inv"), KEYS)[1].select(*INV_COLUMNS)


@check("f33_name_mismatch", "amf", """
SELECT _rowid, coalesce(original_file_name, '') <> '' AND lower(trim(name)) <> lower(trim(original_file_name)) AND regexp_replace(lower(trim(name)), '\\.[a-z0-9]+$', '') <> regexp_replace(lower(trim(original_file_name)), '\\.[a-z0-9]+$', '') AS mismatch FROM amf""")
def _(spark, sf):
    return shape(spark, sf, "amf").select("_rowid", (F.size(tags.name_mismatch_tags("name", "original_file_name")) > 0).alias("mismatch"))


@check("f34_value_tags", "amf amp", """
SELECT 'publisher' AS rule, _rowid FROM amf WHERE trim(publisher) = '' UNION ALL SELECT 'hidden', _rowid FROM amp WHERE HiddenArp = '1'""".strip())
def _(spark, sf):
    amf = shape(spark, sf, "amf").filter(F.size(tags.missing_publisher_tags("publisher")) > 0).select(F.lit("publisher").alias("rule"), "_rowid")
    amp = shape(spark, sf, "amp").filter(F.size(tags.boolean_tags("HiddenArp", "hidden_program", "danger")) > 0).select(F.lit("hidden").alias("rule"), "_rowid")
    return amf.unionByName(amp)


@check("j8_program_files", "amp amf", "SELECT p.Name AS program, f.name AS file, p._rowid AS program_row, f._rowid AS file_row FROM amp p JOIN amf f ON p.host_id = f.host_id AND p.ProgramId = f.program_id")
def _(spark, sf):
    joined = search.link(shape(spark, sf, "amp"), "ProgramId", shape(spark, sf, "amf"), "program_id")
    return joined.select(F.col("Name").alias("program"), F.col("linked_name").alias("file"), F.col("_rowid").alias("program_row"), F.col("linked__rowid").alias("file_row"))


@check("j8_loaded_files", "runs loaded", """
SELECT 'by_hash' AS link, r._rowid AS run, l._rowid AS loaded FROM runs r JOIN loaded l ON r.host_id = l.host_id AND r.prefetch_hash = l.prefetch_hash
UNION ALL SELECT 'by_name', r._rowid, l._rowid FROM loaded l JOIN runs r ON r.host_id = l.host_id AND r.executable_filename = l.executable_filename""".strip())
def _(spark, sf):
    runs, loaded = shape(spark, sf, "runs"), shape(spark, sf, "loaded")
    by_hash = search.link(runs, "prefetch_hash", loaded, "prefetch_hash").select(F.lit("by_hash").alias("link"), F.col("_rowid").alias("run"), F.col("linked__rowid").alias("loaded"))
    by_name = search.link(loaded, "executable_filename", runs, "executable_filename").select(F.lit("by_name").alias("link"), F.col("linked__rowid").alias("run"), F.col("_rowid").alias("loaded"))
    return by_hash.unionByName(by_name)


@check("j14_linked_rows", "loaded", "SELECT _rowid, loaded_filename FROM loaded WHERE prefetch_hash = 'H7' AND contains(lower(loaded_filename), 'mach')")
def _(spark, sf):
    return search.linked_rows(shape(spark, sf, "loaded"), "prefetch_hash", "H7", " MACH ").select("_rowid", "loaded_filename")
