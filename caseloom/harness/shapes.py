"""Evidence-shaped views over the given tables.

Each shape is one projection written once, with a few marks for the places where the two SQL dialects differ:
``@t(x)`` table, ``@'..'`` literal with backslashes, ``@fmt[..]`` timestamp text, ``@at[..]`` seconds after 2024-01-01 as
text, ``@b64[..]`` base64 of text, ``@wide[..]`` hex of text as UTF-16LE, ``@json[..]`` JSON-escaped text,
``@le4[..]`` (2, 4, 8) little-endian hex of a number, ``@rot[..]`` rotated letters, ``@n(..)`` number as text, ``@div``
integer quotient.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.core import with_computed

HOST = "'host' || @n({0} % 4) AS host_id"
PREFIX_V = "00" * 12 + "00000000" + "24000000" + "00000000" + "24000000" + "24000000" + "00000000" + "00" * (204 - 36)

SHAPES: dict[str, str] = {}

# One branch per log, so a filter on provider or log folds away the other branches as partition pruning would.
_SHARED = """
SELECT 'host' || @n(user_id % 4) AS host_id, @fmt[ts] AS timestamp, {provider} AS Provider, {event} AS EventID,
  'Operational' AS Channel, @n(event_id % 6) AS Level,
  CASE event_id % 6 WHEN 1 THEN 'Critical' WHEN 2 THEN 'Error' WHEN 3 THEN 'Warning' WHEN 5 THEN 'Verbose' ELSE 'Information' END AS LevelName,
  'PC' || @n(user_id % 4) AS Computer, @n(event_id) AS EventRecordID, @n(event_id % 50) AS ProcessID, '1' AS ThreadID,
  CASE WHEN event_id % 3 = 0 THEN 'S-1-5-21-1-2-3-' || @n(1000 + user_id % 200) ELSE '' END AS UserID,
  {data} AS EventData, '{log}' AS log, '{status}' AS _status, event_id AS _rowid, '/EVENTLOG/{log}.evtx' AS _source_file, '{log}.evtx::' || @n(event_id) AS _record_key
FROM @t(events) WHERE {where}
"""
_SECURITY_DATA = """'{"LogonType":"' || CASE event_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE '10' END
  || '","IpAddress":"' || CASE WHEN event_id % 11 = 0 THEN '-' ELSE '10.0.0.' || @n(user_id % 250) END
  || @'","TargetUserName":"CORP\\\\user' || @n(user_id % 200)
  || CASE WHEN event_id % 4 = 0 THEN '","TargetUserSid":"S-1-5-21-1-2-3-' || @n(1000 + user_id % 200) ELSE '' END || '"}'"""
_SESSION_DATA = """CASE WHEN event_id % 7 = 0 THEN '{"EventXML":' ELSE '' END
  || '{"SessionID":' || @n(user_id % 5) || CASE WHEN event_id % 3 = 0 THEN ',"Address":"172.16.0.' || @n(user_id % 9) || '"' ELSE '' END
  || CASE WHEN event_id % 5 = 0 THEN @',"User":"CORP\\\\user' || @n(user_id % 200) || '"' ELSE '' END || '}'
  || CASE WHEN event_id % 7 = 0 THEN '}' ELSE '' END"""
_DEFENDER_DATA = """'{"Detection ID":"' || @n(user_id % 300) || '","Threat Name":"T' || @n(user_id % 7) || '","Severity Name":"'
  || CASE event_id % 3 WHEN 0 THEN 'High' ELSE '' END || @'","Path":"C:\\\\Temp\\\\f' || @n(event_id % 100) || '.exe","Action Name":"'
  || CASE event_id % 4 WHEN 3 THEN 'Quarantine' ELSE '' END || '","Scan Type":"' || CASE event_id % 12 WHEN 4 THEN 'Quick' ELSE 'Full' END
  || '","Current security intelligence Version":"1.' || @n(event_id) || '","New Value":"' || CASE event_id % 16 WHEN 6 THEN 'DisableRealtimeMonitoring = 1' ELSE 'Other' END
  || '","Old Value":"0","Domain":"CORP","User":"user' || @n(user_id % 200) || '"}'"""
_SMB_DATA = """@'{"EventData":{"ClientName":"\\\\\\\\10.0.1.' || @n(user_id % 250) || '","UserName":"CORP/user' || @n(user_id % 200) || '@corp.local"}}'"""
_CLIENT_DATA = """CASE WHEN event_id % 4 IN (0, 3) THEN '{"Value":"192.168.0.' || @n(user_id % 7) || '"}' ELSE '{}' END"""
_GOOD = "event_id % 500 <> 499 AND "
_BRANCHES = [
    dict(provider="'Microsoft-Windows-SMBServer'", event="CASE WHEN event_id % 20 = 0 THEN '551' ELSE '1009' END", data=_SMB_DATA, log="Microsoft-Windows-SMBServer%4Security",
         where=_GOOD + "event_type = 'signup' AND event_id % 10 = 0"),
    dict(provider="'Microsoft-Windows-Security-Auditing'", event="'4624'", data=_SECURITY_DATA, log="Security", where=_GOOD + "event_type = 'signup' AND event_id % 10 <> 0"),
    dict(provider="'Microsoft-Windows-Security-Auditing'", event="'4625'", data=_SECURITY_DATA, log="Security", where=_GOOD + "event_type = 'error'"),
    dict(provider="'Microsoft-Windows-TerminalServices-LocalSessionManager'", event="CASE event_id % 4 WHEN 0 THEN '21' WHEN 1 THEN '23' WHEN 2 THEN '24' ELSE '25' END",
         data=_SESSION_DATA, log="Microsoft-Windows-TerminalServices-LocalSessionManager%4Operational", where=_GOOD + "event_type = 'click'"),
    dict(provider="'Microsoft-Windows-TerminalServices-ClientActiveXCore'", event="CASE event_id % 4 WHEN 0 THEN '1024' WHEN 1 THEN '1025' WHEN 2 THEN '1026' ELSE '1102' END",
         data=_CLIENT_DATA, log="Microsoft-Windows-TerminalServices-RDPClient%4Operational", where=_GOOD + "event_type = 'view'"),
    dict(provider="'Microsoft-Windows-Windows Defender'", data=_DEFENDER_DATA, log="Microsoft-Windows-Windows Defender%4Operational", where=_GOOD + "event_type = 'purchase'",
         event="CASE event_id % 8 WHEN 0 THEN '5000' WHEN 1 THEN '5001' WHEN 2 THEN '1116' WHEN 3 THEN '1117' WHEN 4 THEN '1001' WHEN 5 THEN '2000' WHEN 6 THEN '5007' ELSE '1013' END"),
    dict(provider="CAST(NULL AS STRING)", event="CAST(NULL AS STRING)", data="'not json'", log="Damaged", status="corrupted", where="event_id % 500 = 499"),
]


def _branch(parts: dict[str, str]) -> str:
    text = _SHARED
    for name, value in {"status": "ok", **parts}.items():
        text = text.replace("{" + name + "}", value)
    return text


SHAPES["ev"] = "UNION ALL".join(_branch(b) for b in _BRANCHES)

# Payloads whose objects are nested up to 200 deep, with braces inside texts.
SHAPES["deep"] = """
SELECT 'host' || @n(user_id % 4) AS host_id, @fmt[ts] AS timestamp, 'Vendor-Audit' AS Provider, '7' AS EventID, '' AS UserID,
  repeat('{"N":', CAST(event_id % 200 AS INT)) || CASE WHEN event_id % 4 = 0 THEN '{"TargetUserSid":"S-1-5-21-1-2-3-' || @n(1000 + user_id % 200) || '",' ELSE '{' END
    || @'"TargetUserName":"CORP\\\\user' || @n(user_id % 200) || '","Note":["}",' || @n(event_id) || ',null,"a{"]}' || repeat('}', CAST(event_id % 200 AS INT)) AS EventData,
  'Vendor' AS log, '/EVENTLOG/Vendor.evtx' AS _source_file, 'Vendor.evtx::' || @n(event_id) AS _record_key, event_id AS _rowid
FROM @t(events) WHERE event_type = 'error'
"""

SHAPES["sb"] = """
SELECT 'host' || @n(conv_id % 4) AS host_id, @at[conv_id * 3600 + turn * 60] AS timestamp, 'Microsoft-Windows-PowerShell' AS Provider,
  '4104' AS EventID, @n(100 + conv_id % 9) AS ProcessID, 'S-1-5-21-1-2-3-' || @n(1000 + conv_id % 50) AS UserID,
  '{"ScriptBlockId":"b' || @n(conv_id) || '","MessageNumber":' || @n(turn + 1) || ',"MessageTotal":' || @n(parts) || ',"Path":"' || role || '.ps1","ScriptBlockText":"' || @json[text] || '"}' AS EventData,
  'PowerShell' AS log, '/EVENTLOG/PowerShell.evtx' AS _source_file, 'PowerShell.evtx::' || @n(conv_id * 10000 + turn) AS _record_key, conv_id * 10000 + turn AS _rowid
FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS parts FROM @t(conversations))
UNION ALL
SELECT 'host' || @n(conv_id % 4), @at[conv_id * 3600 + turn * 60 + 30], 'Microsoft-Windows-PowerShell', '4103', @n(100 + conv_id % 9), 'S-1-5-21-1-2-3-' || @n(1000 + conv_id % 50),
  @'{"ContextInfo":"        Severity = Informational\\n        Host Application = \\"C:\\\\Windows\\\\posh' || @n(conv_id % 3) || @'.exe\\" -nop\\n        Command Name = Get-Item' || @n(conv_id)
    || CASE WHEN conv_id % 2 = 0 THEN @'\\n        User = CORP\\\\user' || @n(conv_id) ELSE '' END || '","Payload":"' || CASE WHEN conv_id % 3 = 0 THEN 'run ' || @n(conv_id) || @'\\nnext' ELSE '' END || '"}',
  'PowerShell', '/EVENTLOG/PowerShell.evtx', 'PowerShell.evtx::' || @n(conv_id * 10000 + 1000 + turn), conv_id * 10000 + 1000 + turn
FROM @t(conversations)
UNION ALL
SELECT 'host' || @n(conv_id % 4), @at[conv_id * 3600 + turn * 60 + 40], 'PowerShell', '800', '', '',
  @'{"Data":["Details","HostApplication=powershell.exe -File x' || @n(conv_id) || @'.ps1\\r\\nUserId=CORP\\\\user' || @n(conv_id % 5) || CASE WHEN conv_id % 2 = 0 THEN @'\\nCommandLine=Get-Date ' || @n(conv_id) ELSE '' END || '"]}',
  'Windows PowerShell', '/EVENTLOG/Windows PowerShell.evtx', 'Windows PowerShell.evtx::' || @n(conv_id * 10000 + 2000 + turn), conv_id * 10000 + 2000 + turn
FROM @t(conversations)
"""

SHAPES["reg"] = """
SELECT 'host' || @n(p_partkey % 4) AS host_id, @at[p_partkey * 60] AS last_write,
  CASE p_partkey % 5 WHEN 0 THEN @'\\Software\\Microsoft\\Windows\\CurrentVersion\\Run' WHEN 1 THEN @'\\Software\\Microsoft\\Windows\\CurrentVersion\\RunOnce'
    WHEN 2 THEN @'\\Software\\Microsoft\\Windows\\CurrentVersion\\Policies\\Explorer\\Run' WHEN 3 THEN @'\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\RunMRU'
    ELSE @'\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\TypedPaths' END AS key_path,
  CASE WHEN p_partkey % 17 = 0 THEN '(default)' WHEN p_partkey % 19 = 0 THEN 'MRUList' ELSE p_name END AS value_name,
  CASE p_partkey % 6 WHEN 0 THEN @'C:\\Users\\a\\AppData\\Local\\Temp\\' WHEN 1 THEN @'C:\\Users\\a\\Downloads\\' WHEN 2 THEN @'C:\\Users\\Public\\'
    WHEN 3 THEN @'C:\\ProgramData\\' WHEN 4 THEN @'C:\\Windows\\System32\\powershell.exe -enc ' ELSE @'C:\\Program Files\\' END || @n(p_partkey) || '.exe'
    || CASE WHEN p_partkey % 2 = 1 THEN @'\\1' ELSE '' END AS value_data,
  CASE p_partkey % 3 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'SOFTWARE' ELSE 'user' || @n(p_partkey % 6) || '_NTUSER.DAT' END AS hive,
  CASE p_partkey % 11 WHEN 1 THEN 'deleted' WHEN 2 THEN '' WHEN 3 THEN 'live' WHEN 4 THEN 'live' ELSE NULL END AS _recovery, p_partkey AS _rowid
FROM @t(part)
"""
SHAPES["reg"] = "SELECT *, '/REGISTRY/' || hive AS _source_file FROM (" + SHAPES["reg"] + ")"

_FACT = "SELECT 'host' || @n(k % 4) AS host_id, {hive} AS hive, {key} AS key_path, {name} AS value_name, {data} AS value_data, k * 20 + {slot} AS _rowid FROM c"
_CS = "@'\\\\ControlSet00' || CASE WHEN k % 2 = 0 THEN '2' ELSE '1' END || "
_FACTS = [
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\Tcpip\\\\Parameters\\\\Interfaces\\\\{' || @n(k) || '}'", "'IPAddress'", "CASE k % 5 WHEN 0 THEN '[\"0.0.0.0\"]' WHEN 1 THEN '' ELSE '[\"10.1.' || @n(k % 200) || '.' || @n(k % 250) || '\", \"0.0.0.0\"]' END"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\Tcpip\\\\Parameters\\\\Interfaces\\\\{' || @n(k) || '}'", "'DhcpIPAddress'", "CASE k % 3 WHEN 0 THEN '0.0.0.0' WHEN 1 THEN '' ELSE '10.2.' || @n(k % 200) || '.' || @n(k % 250) END"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\Tcpip\\\\Parameters\\\\Interfaces\\\\{' || @n(k) || '}'", "'EnableDHCP'", "@n(k % 3)"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\Tcpip\\\\Parameters\\\\Interfaces\\\\{' || @n(k) || '}'", "'LeaseObtainedTime'", "@n(1700000000 + k)"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\Tcpip\\\\Parameters\\\\Interfaces\\\\{' || @n(k) || '}'", "'DhcpSubnetMask'", "'255.255.255.0'"),
    ("'SOFTWARE'", "@'\\\\Microsoft\\\\Windows NT\\\\CurrentVersion\\\\NetworkList\\\\Profiles\\\\{' || @n(k) || '}'", "'ProfileName'", "CASE WHEN k % 9 = 0 THEN '' ELSE 'net' || @n(k % 100) END"),
    ("'SOFTWARE'", "@'\\\\Microsoft\\\\Windows NT\\\\CurrentVersion\\\\NetworkList\\\\Profiles\\\\{' || @n(k) || '}'", "'DateLastConnected'", "@le2[2000 + k % 25] || @le2[1 + k % 12] || '0000' || @le2[1 + k % 28] || @le2[k % 24] || @le2[k % 60] || @le2[k % 60] || '0000'"),
    ("'SOFTWARE'", "@'\\\\Microsoft\\\\Windows NT\\\\CurrentVersion'", "CASE k % 6 WHEN 0 THEN 'ProductName' WHEN 1 THEN 'EditionID' WHEN 2 THEN 'DisplayVersion' WHEN 3 THEN 'CurrentBuild' WHEN 4 THEN 'RegisteredOwner' ELSE 'InstallDate' END", "CASE WHEN k % 6 = 5 THEN @n(CASE WHEN k < 50 THEN 0 ELSE 1600000000 + k END) ELSE 'os' || @n(k) END"),
    ("'SYSTEM'", _CS + "@'\\\\Control\\\\SecurityProviders\\\\WDigest'", "'UseLogonCredential'", "@n(k % 3)"),
    ("'SYSTEM'", _CS + "@'\\\\Control\\\\Lsa'", "'RunAsPPL'", "CASE WHEN k % 4 = 1 THEN '' ELSE @n(k % 4) END"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\LanmanServer'", "'Start'", "@n(2 + k % 3)"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\LanmanServer\\\\Parameters'", "CASE WHEN k % 2 = 0 THEN 'AutoShareServer' ELSE 'AutoShareWks' END", "@n(k % 2)"),
    ("'SYSTEM'", _CS + "@'\\\\Services\\\\LanmanServer\\\\Shares'", "CASE WHEN k % 31 = 0 THEN '(default)' ELSE 'share' || @n(k % 300) END", "CASE WHEN k % 4 = 0 THEN 'plain text' ELSE @'[\"CSCFlags=0\",\"Path=C:\\\\\\\\share' || @n(k) || '\",\"Type=0\"]' END"),
    ("'SOFTWARE'", "@'\\\\Software\\\\Microsoft\\\\Microsoft SQL Server\\\\MSSQL' || @n(9 + k % 10) || '.INST' || @n(k) || @'\\\\MSSQLServer'", "'LoginMode'", "@n(k % 4)"),
    ("'SYSTEM'", _CS + "@'\\\\Control\\\\ComputerName\\\\ComputerName'", "'ComputerName'", "'PC' || @n(k)"),
    ("'SYSTEM'", _CS + "@'\\\\Control\\\\TimeZoneInformation'", "'TimeZoneKeyName'", "'Zone ' || @n(k)"),
    ("'SYSTEM'", _CS + "@'\\\\Control\\\\Windows'", "'ShutdownTime'", "@le8[133000000000000000 + k * 864000000005]"),
]
SHAPES["facts"] = "\nUNION ALL\n".join(
    _FACT.format(hive=h, key=k.replace("\\\\", "\\"), name=n, data=d.replace("\\\\\\\\", "\\\\"), slot=i) for i, (h, k, n, d) in enumerate(_FACTS)
)
SHAPES["facts"] = (
    "SELECT *, CAST(NULL AS STRING) AS _recovery, @at[_rowid] AS last_write, '/REGISTRY/' || hive AS _source_file FROM ("
    + SHAPES["facts"].replace(" FROM c", " FROM (SELECT c_custkey AS k FROM @t(customer))") + ")"
)

_F_BLOB = ("'" + "00" * 8 + "' || @le8[133000000000000000 + k * 36000000000] || '" + "00" * 8 + "' || @le8[132000000000000000 + k * 7] || '"
           + "00" * 8 + "' || @le8[CASE WHEN k % 3 = 0 THEN 0 ELSE 133100000000000000 + k END] || @le4[1000 + k + CASE WHEN k % 37 = 0 THEN 1 ELSE 0 END] || '"
           + "00" * 4 + "' || @le2[k % 2048] || '" + "00" * 6 + "' || @le2[k % 5] || @le2[k % 300]")
SHAPES["acct"] = f"""
SELECT 'host' || @n(k % 4) AS host_id, 'SAM' AS hive, @'\\SAM\\Domains\\Account\\Users\\' || lpad(hex(1000 + k), 8, '0') AS key_path, 'F' AS value_name,
  {_F_BLOB} AS value_data, k * 10 AS _rowid FROM (SELECT c_custkey AS k FROM @t(customer))
UNION ALL SELECT 'host' || @n(k % 4), 'SAM', @'\\SAM\\Domains\\Account\\Users\\' || lpad(hex(1000 + k), 8, '0'), 'V', '{PREFIX_V}' || @wide[c_name] || @wide['Fullname#' || lpad(@n(k), 9, '0')], k * 10 + 1
  FROM (SELECT c_custkey AS k, c_name FROM @t(customer))
UNION ALL SELECT 'host' || @n(k % 4), 'SAM', @'\\SAM\\Domains\\Account\\Users\\Names\\' || c_name, '(default)', '', k * 10 + 2 FROM (SELECT c_custkey AS k, c_name FROM @t(customer))
UNION ALL SELECT 'host' || @n(k % 4), 'SOFTWARE', @'\\Microsoft\\Windows NT\\CurrentVersion\\ProfileList\\' || CASE WHEN k % 43 = 0 THEN 'S-1-5-21-9-9-9-' || @n(k) WHEN k % 47 = 1 THEN 'S-1-5-18' ELSE 'S-1-5-21-1-2-3-' || @n(1000 + k) END, 'ProfileImagePath', @'C:\\Users\\' || c_name || CASE WHEN k % 5 = 0 THEN @'\\' ELSE '' END, k * 10 + 3
  FROM (SELECT c_custkey AS k, c_name FROM @t(customer) WHERE c_custkey % 3 <> 1 OR c_custkey < 10)
UNION ALL SELECT 'host' || @n(k % 4), 'SOFTWARE', @'\\Microsoft\\Windows NT\\CurrentVersion\\Winlogon\\SpecialAccounts\\UserList', c_name, CASE WHEN k % 2 = 0 THEN '0' ELSE '1 ' END, k * 10 + 4
  FROM (SELECT c_custkey AS k, c_name FROM @t(customer) WHERE c_custkey % 41 = 0)
"""
SHAPES["acct"] = "SELECT *, CAST(NULL AS STRING) AS _recovery, @at[_rowid] AS last_write, '/REGISTRY/' || hive AS _source_file FROM (" + SHAPES["acct"] + ")"

SHAPES["hexs"] = """
SELECT 'host' || @n(k % 4) AS host_id, 'user' || @n(k % 6) || '_NTUSER.DAT' AS hive, @'\\Software\\Microsoft\\Windows\\CurrentVersion\\Explorer\\UserAssist\\{A}\\Count' AS key_path,
  CASE WHEN k % 29 = 0 THEN @rot['UEME_CTLSESSION'] ELSE @rot[@'C:\\Tools\\App' || @n(k) || '.exe'] END AS value_name,
  CASE WHEN k % 13 = 0 THEN '0011' WHEN k % 31 = 0 THEN '001' ELSE '00000000' || @le4[k % 50] || @le4[k % 20] || @le4[k * 1000] || '""" + "00" * 44 + """' || @le8[133000000000000000 + k * 864000000005] || '00000000' END AS value_data,
  k * 2 AS _rowid FROM (SELECT c_custkey AS k FROM @t(customer))
UNION ALL
SELECT 'host' || @n(k % 4), 'SYSTEM', @'\\ControlSet001\\Services\\bam\\State\\UserSettings\\S-1-5-21-1-2-3-' || @n(1000 + k % 40), CASE WHEN k % 7 = 0 THEN 'Version' ELSE @'\\Device\\HarddiskVolume3\\Windows\\App' || @n(k) || '.EXE' END,
  CASE WHEN k % 11 = 0 THEN '00' ELSE @le8[133000000000000000 + k * 10000] || '00000000' END, k * 2 + 1 FROM (SELECT c_custkey AS k FROM @t(customer))
"""
SHAPES["hexs"] = "SELECT *, CAST(NULL AS STRING) AS _recovery, @at[_rowid] AS last_write, '/REGISTRY/' || hive AS _source_file FROM (" + SHAPES["hexs"] + ")"

SHAPES["amf"] = """
SELECT 'host' || @n(p_partkey % 4) AS host_id, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE @at[p_partkey * 3600] END AS timestamp, p_name || '.exe' AS name,
  CASE p_partkey % 6 WHEN 0 THEN @'c:\\users\\a\\appdata\\local\\temp\\' WHEN 1 THEN @'c:\\users\\a\\downloads\\' WHEN 2 THEN @'c:\\windows\\system32\\'
    WHEN 3 THEN @'c:\\programdata\\microsoft\\' WHEN 4 THEN @'c:\\programdata\\x\\' ELSE @'c:\\windows\\system32\\rundll32.exe\\' END || p_name || '.exe' AS lower_case_long_path,
  CASE WHEN p_size % 5 = 0 THEN ' ' WHEN p_size % 5 = 1 THEN '' ELSE p_brand END AS publisher, md5(p_name) AS SHA1,
  CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '.DLL' WHEN 1 THEN p_type ELSE '' END AS original_file_name, 'prog' || @n(p_partkey % 25) AS program_id,
  '/AMCACHE/Amcache.hve' AS _source_file, p_partkey AS _rowid
FROM @t(part)
"""
SHAPES["amp"] = """
SELECT 'host' || @n(s_suppkey % 4) AS host_id, @at[s_suppkey * 600] AS timestamp, s_name AS Name, @'C:\\Program Files\\' || s_name AS RootDirPath,
  CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Vendor' || @n(s_suppkey % 9) END AS Publisher, 'prog' || @n(s_suppkey % 25) AS ProgramId,
  CASE WHEN s_suppkey % 10 = 0 THEN '1' ELSE '0' END AS HiddenArp, '/AMCACHE/Amcache.hve' AS _source_file, s_suppkey AS _rowid
FROM @t(supplier)
"""
SHAPES["inv"] = """
SELECT 'host' || @n(k % 4) AS host_id, @'\\{H}\\Root\\InventoryApplicationFile\\f' || @n(k) AS key_path, value_name, value_data, @at[k] AS last_write, CAST(NULL AS STRING) AS _recovery, k * 10 + slot AS _rowid FROM (
  SELECT p_partkey AS k, 0 AS slot, 'Name' AS value_name, p_name AS value_data FROM @t(part)
  UNION ALL SELECT p_partkey, 1, 'Publisher', CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END FROM @t(part)
  UNION ALL SELECT p_partkey, 2, 'LowerCaseLongPath', @'c:\\x\\' || p_name FROM @t(part)
  UNION ALL SELECT p_partkey, 3, 'Size', '0x' || lower(hex(p_partkey * 1000)) FROM @t(part)
  UNION ALL SELECT p_partkey, 4, 'FileId', CASE WHEN p_partkey % 9 = 0 THEN '0' ELSE '0000' || md5(p_name) END FROM @t(part)
  UNION ALL SELECT p_partkey, 5, 'ProgramId', '0006prog' || @n(p_partkey % 25) FROM @t(part)
  UNION ALL SELECT p_partkey, 6, 'OriginalFileName', upper(p_name) FROM @t(part))
"""
SHAPES["usage"] = """
SELECT 'host' || @n(l.l_suppkey % 4) AS host_id, CASE WHEN l.l_orderkey % 29 = 0 THEN '' ELSE @fmt[l.l_shipdate] END AS timestamp,
  CASE WHEN p.p_size = 7 THEN 'svc.' || p.p_brand ELSE @'C:\\Program Files\\' || p.p_brand || @'\\' || p.p_type || '.exe' END AS app, s.s_name AS user,
  '/SRUM/SRUDB.dat' AS _source_file, l.l_orderkey * 10 + l.l_linenumber AS _rowid
FROM @t(lineitem) l JOIN @t(part) p ON l.l_partkey = p.p_partkey JOIN @t(supplier) s ON l.l_suppkey = s.s_suppkey
"""
SHAPES["runs"] = """
SELECT 'host' || @n(s_suppkey % 4) AS host_id, CASE WHEN s_suppkey % 8 = 0 THEN '' ELSE @at[s_suppkey * 777] END AS last_run_time, upper(s_name) || '.EXE' AS executable_filename,
  'H' || @n(s_suppkey % 60) AS prefetch_hash, @n(s_suppkey % 40) AS run_count, @at[s_suppkey * 700] AS run_time_2, '' AS run_time_3, '' AS run_time_4, '' AS run_time_5,
  '' AS run_time_6, '' AS run_time_7, '' AS run_time_8, @'\\VOLUME{1}' AS volume_device_path, 'ABCD' AS volume_serial_number, @at[0] AS volume_creation_time,
  '/PREFETCH/' || s_name || '.pf' AS _source_file, s_suppkey AS _rowid
FROM @t(supplier)
"""
SHAPES["loaded"] = """
SELECT 'host' || @n(c_custkey % 4) AS host_id, 'H' || @n(c_custkey % 60) AS prefetch_hash, 'SUPPLIER#' || lpad(@n(c_custkey % 100), 9, '0') || '.EXE' AS executable_filename,
  @'\\VOLUME{1}\\WINDOWS\\' || c_mktsegment || '.DLL' AS loaded_filename, c_custkey AS _rowid FROM @t(customer)
"""

SHAPES["cache"] = """
SELECT 'host' || @n(page_id % 4) AS host_id, 'acct' || @n(page_id % 5) AS account, url, CASE WHEN page_id % 12 = 0 THEN '' ELSE @at[page_id * 60] END AS response_time,
  '' AS request_time, CASE WHEN page_id % 24 = 0 THEN '' ELSE @at[page_id * 60 + 1] END AS creation_time, '200 OK' AS status, 'text/html' AS content_type, CASE WHEN page_id % 2 = 0 THEN @n(length(html)) ELSE '' END AS content_length,
  @n(length(html) + 1) AS body_size, '1/0/' || url AS cache_key, CASE WHEN page_id % 9 = 0 THEN '' ELSE @b64[html] END AS body_b64,
  '/BROWSER/acct' || @n(page_id % 5) || '_Chrome_Cache' AS _source_file, page_id AS _rowid FROM @t(pages)
"""
SHAPES["hurls"] = """
SELECT 'host' || @n(page_id % 4) AS host_id, 'acct' || @n(page_id % 5) AS account, CASE WHEN page_id % 15 = 1 THEN 'https://User:pw' || chr(64) || upper(substr(url, locate_at, 400)) ELSE url || CASE WHEN page_id % 6 = 1 THEN '%20a+b%zz' ELSE '' END END AS url,
  'title ' || @n(page_id) AS title, @n(page_id % 9) AS visit_count, @n(page_id % 4) AS typed_count, @n(13348540800000000 + page_id * 60000000 + 7) AS last_visit_time,
  '/BROWSER/acct' || @n(page_id % 5) || '_Chrome_History' AS _source_file, page_id AS _rowid FROM (SELECT *, CASE WHEN url LIKE 'https%' THEN 9 ELSE 8 END AS locate_at FROM @t(pages))
"""
SHAPES["hdown"] = """
SELECT 'host' || @n(page_id % 4) AS host_id, 'acct' || @n(page_id % 5) AS account, CASE WHEN page_id % 4 = 0 THEN '' ELSE @'C:\\Users\\a\\Downloads\\f%20' || @n(page_id) || '.exe' END AS target_path,
  @'C:\\Temp\\cur' || @n(page_id) || '.tmp' AS current_path, CASE WHEN page_id % 5 = 0 THEN '' ELSE url END AS tab_url, 'https://ref.example.com/' AS referrer, '' AS site_url,
  @n(13348540800000000 + page_id * 60000000) AS start_time, CASE WHEN page_id % 7 = 0 THEN '' ELSE @n(length(html) * (1 + page_id)) END AS total_bytes, @n(length(html)) AS received_bytes,
  'application/octet-stream' AS mime_type, @n(page_id % 10) AS danger_type, '/BROWSER/acct' || @n(page_id % 5) || '_Chrome_History' AS _source_file, page_id AS _rowid FROM @t(pages)
"""

SHAPES["ai"] = """
SELECT 'host' || @n(conv_id % 4) AS host_id, 'acct' || @n(conv_id % 5) AS account,
  CASE conv_id % 4 WHEN 0 THEN 'https://chatgpt.com/backend-api/conversation/' || id || CASE WHEN turn = 1 THEN '/stream_status' ELSE '' END
    WHEN 1 THEN 'https://claude.ai/api/organizations/o/chat_conversations/' || id || '?tree=True'
    WHEN 2 THEN 'https://gemini.google.com/_/BardChatUi/data/BardFrontendService/GetConversation?id=' || id
    ELSE 'https://news.example.com/claude.ai/' || id END AS url,
  CASE WHEN turn % 5 = 4 THEN 'text/html' ELSE 'application/json; charset=utf-8' END AS content_type,
  CASE WHEN turn % 3 = 2 THEN '' ELSE @at[conv_id * 3600 + turn] END AS response_time, @at[conv_id * 3600 + turn + 5] AS request_time, '' AS creation_time,
  CASE WHEN turn % 7 = 6 THEN '' ELSE @b64[payload] END AS body_b64, '/BROWSER/acct' || @n(conv_id % 5) || '_Chrome_Cache' AS _source_file, conv_id * 1000 + turn AS _rowid
FROM (SELECT *, CASE conv_id % 4
    WHEN 0 THEN '{"title":"talk ' || id || '","create_time":' || @n(1704067200 + conv_id) || '.25,"mapping":{"n1":{"message":{"author":{"role":"' || role || '"},"content":{"parts":["' || esc || '","tail"]},"create_time":' || @n(1704067300 + turn) || '}},"n0":{"message":{"author":{"role":"system"},"content":{"parts":["start"]},"create_time":1704067200}},"root":{"message":null}}}'
    WHEN 1 THEN ')]}' || chr(39) || chr(10) || '{"name":"chat ' || id || '","created_at":"2024-01-02T03:04:05.678Z","updated_at":"2024-01-02T03:04:05+09:00","chat_messages":[{"sender":"' || role || '","text":"' || esc || '","created_at":"2024-01-02 03:04:05"},{"role":"assistant","content":[{"text":"a"},{"text":"b"}],"created_at":"bad"}]}'
    WHEN 2 THEN '{"messages":[{"author":{"role":"' || role || '"},"content":"' || esc || '"},{"content":{"parts":["x",{"text":"y"}]}},5],"update_time":"1704067200000"}'
    ELSE '{"mapping":{}}' END AS payload
  FROM (SELECT conv_id, turn, role, @n(conv_id) || '-' || @n(turn) AS id, @json[text] AS esc FROM @t(conversations)))
"""
SHAPES["ai"] = SHAPES["ai"].replace("')]}' || chr(39) || chr(10)", "')]' || chr(39) || chr(10)")

SHAPES["mfta"] = """
SELECT 'host0' AS host_id, entry, flags, attr_seq, kind, namespace, name, parent, size FROM (
  SELECT CAST(5 AS BIGINT) AS entry, CAST(3 AS BIGINT) AS flags, 0 AS attr_seq, 'name' AS kind, 'Win32AndDos' AS namespace, '.' AS name, CAST(5 AS BIGINT) AS parent, CAST(0 AS BIGINT) AS size FROM @t(region) WHERE r_regionkey = 0
  UNION ALL SELECT CAST(r_regionkey AS BIGINT) + 10, CAST(3 AS BIGINT), 0, 'name', 'Win32', r_name, CAST(5 AS BIGINT), CAST(0 AS BIGINT) FROM @t(region)
  UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, CAST(3 AS BIGINT), 0, 'name', 'POSIX', n_name, CAST(n_regionkey AS BIGINT) + 10, CAST(0 AS BIGINT) FROM @t(nation)
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 0, 'name', 'DOS', 'SHORT~' || @n(c_custkey), CAST(7 AS BIGINT), CAST(1 AS BIGINT) FROM @t(customer)
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 1, 'name', 'Win32', c_name || CASE c_custkey % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.tar.Gz' ELSE '' END,
    CASE WHEN c_custkey % 50 = 0 THEN 99999999999 WHEN c_custkey % 77 = 5 THEN c_custkey + 1000 ELSE CAST(c_nationkey AS BIGINT) + 100 END, c_custkey * 3 FROM @t(customer) WHERE c_custkey % 61 <> 7
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 2, 'name', 'Win32AndDos', 'second' || @n(c_custkey), CAST(8 AS BIGINT), CAST(1 AS BIGINT) FROM @t(customer) WHERE c_custkey % 5 = 0
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 3, 'data', '', '', CAST(0 AS BIGINT), c_custkey * 100 FROM @t(customer) WHERE c_custkey % 4 <> 0
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 4, 'data', '', 'Zone.Identifier', CAST(0 AS BIGINT), CAST(26 AS BIGINT) FROM @t(customer) WHERE c_custkey % 6 = 0
  UNION ALL SELECT c_custkey + 1000, c_custkey % 2, 5, 'info', '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM @t(customer))
"""
SHAPES["usn"] = """
SELECT 'host' || @n(o_orderkey % 4) AS host_id, @fmt[o_orderdate] AS timestamp, 'file' || @n(o_custkey) || '.dat' AS filename,
  (o_orderkey * 40503 % 16777216) + CASE WHEN o_orderkey % 7 = 0 THEN 2147483648 ELSE 0 END AS reason, o_orderkey % 32768 AS file_attributes,
  o_orderkey + 281474976710656 * (o_orderkey % 100) AS file_reference, o_custkey + 281474976710656 * 3 AS parent_file_reference, o_orderkey AS _rowid
FROM @t(orders)
"""
SHAPES["tasks"] = """
SELECT 'host' || @n(s_suppkey % 4) AS host_id, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE @at[s_suppkey * 1800] END AS timestamp, s_name AS task_name,
  CASE s_suppkey % 6 WHEN 0 THEN 'true' WHEN 1 THEN 'False' WHEN 2 THEN '1' WHEN 3 THEN 'disabled' WHEN 4 THEN '' ELSE 'maybe' END AS enabled,
  CASE s_suppkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'no' ELSE '' END AS hidden, 'S-1-5-18' AS run_as, 'HighestAvailable' AS run_level,
  CASE s_suppkey % 4 WHEN 0 THEN @'C:\\Windows\\Temp\\x.exe' WHEN 1 THEN @'C:\\Windows\\System32\\mshta.exe http://x' WHEN 2 THEN 'COM:{1}' ELSE @'C:\\ok\\a.exe' END AS actions,
  'TimeTrigger' AS trigger_types, CASE WHEN s_suppkey % 3 = 0 THEN 'Microsoft Corporation' ELSE '' END AS author, 'text' AS description,
  CASE WHEN s_suppkey % 7 = 0 THEN @'\\Microsoft\\Windows\\T' || @n(s_suppkey) ELSE @'\\T' || @n(s_suppkey) END AS uri, '/TASKS/' || s_name AS _source_file, s_suppkey AS _rowid
FROM @t(supplier)
"""
SHAPES["xml"] = """
SELECT 'host' || @n(s_suppkey % 4) AS host_id, '/TASKS/' || s_name AS path,
  CASE WHEN s_suppkey % 33 = 5 THEN '<Task><broken' ELSE '<?xml version="1.0" encoding="UTF-16"?><Task version="1.2" xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Date>2024-0' || @n(1 + s_suppkey % 9)
    || '-01T10:00:00' || CASE s_suppkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+01:00' ELSE '' END || '</Date><Author>A &amp; B</Author>' || CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE @'<URI>\\Dir\\Job' || @n(s_suppkey) || '</URI>' END
    || '</RegistrationInfo><Principals><Principal id="P">' || CASE WHEN s_suppkey % 2 = 0 THEN '<UserId>S-1-5-18</UserId>' ELSE '<GroupId>G1</GroupId>' END || '<RunLevel>HighestAvailable</RunLevel></Principal></Principals><Settings><Enabled>true</Enabled><Hidden>false</Hidden></Settings><Triggers><TimeTrigger><StartBoundary>2024-01-01T00:00:0'
    || @n(s_suppkey % 10) || '</StartBoundary></TimeTrigger><LogonTrigger></LogonTrigger></Triggers><Actions Context="P"><Exec><Command>cmd' || @n(s_suppkey) || '.exe</Command><Arguments>/c a &lt; b</Arguments></Exec><ComHandler><ClassId>{C' || @n(s_suppkey) || '}</ClassId></ComHandler></Actions></Task>' END AS text, s_suppkey AS k
FROM @t(supplier)
"""
SHAPES["wer"] = """
SELECT 'host' || @n(o_orderkey % 4) AS host_id, '/WER/' || @n(o_orderkey) || '.wer' AS path, o_orderkey AS k,
  'Version=1' || chr(10) || 'EventType=' || CASE o_orderkey % 4 WHEN 0 THEN 'APPCRASH' WHEN 1 THEN 'AppHangB1' WHEN 2 THEN 'BEX64' ELSE 'RADAR' END || chr(13) || chr(10)
  || 'EventTime=' || @n(133000000000000000 + o_orderkey * 600000000) || chr(10) || 'Sig[1].Name=b' || chr(10) || 'Sig[1].Value=2' || chr(10) || 'Sig[0].Name=a"q' || chr(10) || 'bad key=x' || chr(10) || 'Sig[0].Value=' || o_orderstatus || chr(10)
  || CASE WHEN o_orderkey % 3 = 0 THEN @'AppPath=C:\\Apps\\App' || @n(o_custkey) || '.exe' ELSE 'AppName=App' || @n(o_custkey) END || chr(10) || 'LoadedModule[0]=ntdll.dll' || chr(10) || 'LoadedModule[1]=k=v.dll' || chr(10) || 'Version=2' AS text
FROM @t(orders)
"""
SHAPES["files"] = """
SELECT '/case/' || source || '/' || lang || '/' || CASE WHEN doc_id % 40 = 0 THEN 'REGBACK/' ELSE '' END || CASE doc_id % 10 WHEN 0 THEN 'SYSTEM' WHEN 1 THEN 'NTUSER.DAT' WHEN 2 THEN 'a' || @n(doc_id) || '.WER' ELSE 'f' || @n(doc_id) || '.txt' END AS path, text, doc_id
FROM @t(documents)
"""
SHAPES["console"] = """
SELECT 'host' || @n(doc_id % 4) AS host_id, '/C/Users/user' || @n(doc_id % 20) || '/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/ConsoleHost_history' || @n(doc_id) || '.txt' AS path, text FROM @t(documents)
"""
SHAPES["tiles"] = """
SELECT 'host' || @n(label % 4) AS host_id, 'Cache' || @n(label) || '_' || @n(vec_id @div 256) || '.bin' AS source_file, vec_id AS tile, 64 AS w, 64 AS h,
  CASE WHEN a = 0 THEN NULL ELSE @n(a) END AS left_edge, CASE WHEN b = 0 THEN NULL ELSE @n(b) END AS right_edge, CASE WHEN c = 0 THEN NULL ELSE @n(c) END AS top_edge, CASE WHEN d = 0 THEN NULL ELSE @n(d) END AS bottom_edge,
  @n(a) || ':' || @n(b) AS rgb
FROM (SELECT vec_id, label, CAST(floor(CAST(@el[embedding|0] AS DOUBLE) * 100) AS BIGINT) AS a, CAST(floor(CAST(@el[embedding|1] AS DOUBLE) * 100) AS BIGINT) AS b,
  CAST(floor(CAST(@el[embedding|2] AS DOUBLE) * 100) AS BIGINT) AS c, CAST(floor(CAST(@el[embedding|3] AS DOUBLE) * 100) AS BIGINT) AS d FROM @t(embeddings))
"""
SHAPES["links"] = """
SELECT 'host0' AS host_id, @at[c_custkey * 50] AS timestamp, @at[c_custkey * 40] AS created_time, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE @at[c_custkey * 45] END AS modified_time,
  'C:' || CASE WHEN c_custkey % 3 = 0 THEN '/' ELSE @'\\' END || upper(r_name) || @'\\' || n_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE @'\\' || c_name || CASE c_custkey % 3 WHEN 0 THEN '.TXT' WHEN 1 THEN '.tar.Gz' ELSE '' END END AS target_path,
  'app' || @n(c_custkey % 8) AS app_id, 'automatic' AS jumplist_type, '' AS arguments, '' AS working_directory, '' AS machine_id,
  '/case/' || CASE WHEN c_custkey % 6 = 0 THEN 'JumpList' ELSE 'LNK' END || '/acct' || @n(c_custkey % 7) || '/Recent/' || @n(c_custkey) || '.lnk' AS _source_file, c_custkey AS _rowid
FROM @t(customer) JOIN @t(nation) ON c_nationkey = n_nationkey JOIN @t(region) ON n_regionkey = r_regionkey
"""
SHAPES["marks"] = """
SELECT @n(o_orderkey) AS id, 'host' || @n(o_orderkey % 4) AS host_id, CASE o_orderkey % 3 WHEN 0 THEN 'Events' WHEN 1 THEN 'Tasks' ELSE 'Gone' END AS tableName,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderkey ELSE o_orderkey % 100 END AS rowid, CASE WHEN o_orderkey % 5 = 0 THEN 'timestamp' ELSE '' END AS field, @fmt[o_orderdate] AS taggedAt FROM @t(orders)
"""
SHAPES["shim"] = """
SELECT 'host' || @n(k % 4) AS host_id, 'SYSTEM' AS hive, @'\\ControlSet001\\Control\\Session Manager\\AppCompatCache' AS key_path, 'AppCompatCache' AS value_name,
  '00000000' || '3130747300000000' || @le4[46] || @le2[36] || @wide[@'C:\\a\\' || lpad(@n(k), 9, '0') || '.exe'] || @le8[133000000000000000 + k * 864000000005]
    || '3130747300000000' || @le4[46] || @le2[36] || @wide[@'D:\\b\\' || lpad(@n(k @div 10), 9, '0') || '.dll'] || @le8[132000000000000000 + k * 10] AS value_data,
  '/REGISTRY/SYSTEM' AS _source_file, k AS _rowid FROM (SELECT c_custkey AS k FROM @t(customer))
"""
_ITEM = "'000031" + "00" * 11 + "0000" + "0900" + "0400efbe" + "01" * 38 + "' || @wide[{0}] || '0000'"
SHAPES["bags"] = """
SELECT 'host0' AS host_id, 'acct1_UsrClass.dat' AS hive, @'\\S\\Shell\\BagMRU' AS key_path, @n(r_regionkey) AS value_name, '00002f433a5c0000' AS value_data, CAST(r_regionkey AS BIGINT) AS _rowid FROM @t(region)
UNION ALL SELECT 'host0', 'acct1_UsrClass.dat', @'\\S\\Shell\\BagMRU\\' || @n(n_regionkey), @n(n_nationkey), """ + _ITEM.format("n_name") + """, CAST(n_nationkey AS BIGINT) + 100 FROM @t(nation)
UNION ALL SELECT 'host0', 'acct1_UsrClass.dat', @'\\S\\Shell\\BagMRU\\' || @n(n_regionkey) || @'\\' || @n(n_nationkey), @n(c_custkey), """ + _ITEM.format("c_name") + """, c_custkey + 1000 FROM @t(customer) JOIN @t(nation) ON c_nationkey = n_nationkey
UNION ALL SELECT 'host0', 'acct1_UsrClass.dat', @'\\S\\Shell\\BagMRU', 'MRUListEx', '0000', CAST(r_regionkey AS BIGINT) + 50 FROM @t(region)
"""
SHAPES["idmap"] = """
SELECT 1 AS IdType, p_partkey AS IdIndex, @wide['App' || @n(p_partkey)] || '0000' AS IdBlob, p_partkey AS _rowid FROM @t(part)
UNION ALL SELECT 3, 1000000 + s_suppkey, '0105000000000005' || @le4[21] || @le4[1] || @le4[2] || @le4[3] || @le4[1000 + s_suppkey], 1000000 + s_suppkey FROM @t(supplier)
"""
SHAPES["srum"] = """
SELECT l_orderkey, l_linenumber, l_partkey AS AppId, 1000000 + l_suppkey AS UserId, CAST(45000 + l_orderkey % 300 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS TimeStamp FROM @t(lineitem)
"""


def _little_endian(expr: str, width: int) -> str:
    h = f"lpad(lower(hex({expr})), {2 * width}, '0')"
    return "(" + " || ".join(f"substr({h}, {2 * i + 1}, 2)" for i in reversed(range(width))) + ")"


def _bracketed(text: str, mark: str, build) -> str:
    """Replace ``mark[..]`` with balanced brackets."""
    while (at := text.find(mark + "[")) >= 0:
        depth, end = 0, at + len(mark)
        while True:
            depth += {"[": 1, "]": -1}.get(text[end], 0)
            if depth == 0:
                break
            end += 1
        text = text[:at] + build(text[at + len(mark) + 1:end]) + text[end + 1:]
    return text


def _parenthesised(text: str, mark: str, build) -> str:
    while (at := text.find(mark + "(")) >= 0:
        depth, end = 0, at + len(mark)
        while True:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            if depth == 0:
                break
            end += 1
        text = text[:at] + build(text[at + len(mark) + 1:end]) + text[end + 1:]
    return text


def render(sql: str, sf_dir: str | None) -> str:
    """The shape in Spark SQL for a folder, or in the oracle's dialect without one."""
    spark = sf_dir is not None
    sql = _parenthesised(sql, "@shape", lambda name: SHAPES[name])
    table = (lambda t: view_name(sf_dir, t)) if spark else (lambda t: t)
    sql = _parenthesised(sql, "@t", table)
    sql = _bracketed(sql, "@rot", lambda e: f"translate({e}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm')")
    for width in (2, 4, 8):
        sql = _bracketed(sql, f"@le{width}", lambda e, w=width: _little_endian(e, w))
    sql = _bracketed(sql, "@json", lambda e: f"replace(replace(replace(replace(replace({e}, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't')")
    if spark:
        sql = _bracketed(sql, "@fmt", lambda e: f"date_format({e}, 'yyyy-MM-dd HH:mm:ss.SSS')")
        sql = _bracketed(sql, "@at", lambda e: f"date_format(timestampadd(SECOND, CAST({e} AS BIGINT), timestamp_ntz'2024-01-01 00:00:00'), 'yyyy-MM-dd HH:mm:ss.SSS')")
        sql = _bracketed(sql, "@b64", lambda e: f"regexp_replace(base64(encode({e}, 'UTF-8')), '[^A-Za-z0-9+/=]', '')")
        sql = _bracketed(sql, "@wide", lambda e: f"lower(regexp_replace(hex({e}), '(..)', '$100'))")
        sql = _bracketed(sql, "@el", lambda e: "{0}[{1}]".format(*e.split("|")))
    else:
        sql = _bracketed(sql, "@fmt", lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S.%g')")
        sql = _bracketed(sql, "@at", lambda e: f"strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds({e}), '%Y-%m-%d %H:%M:%S.%g')")
        sql = _bracketed(sql, "@b64", lambda e: f"to_base64(encode({e}))")
        sql = _bracketed(sql, "@wide", lambda e: f"lower(regexp_replace(hex({e}), '(..)', '\\100', 'g'))")
        sql = _bracketed(sql, "@el", lambda e: "{0}[{1}]".format(e.split("|")[0], int(e.split("|")[1]) + 1))
    sql = _parenthesised(sql, "@n", lambda e: f"CAST({e} AS STRING)")
    sql = sql.replace("@div", "div" if spark else "//")
    return re.sub(r"@'", "r'" if spark else "'", sql)


#: Shapes whose rows cost much more than reading them, by the column that does.
HEAVY_ROWS = {"deep": "EventData", "wer": "text"}
#: Given rows that make one task of such a shape.
ROWS_PER_TASK = 100_000


def view_name(sf_dir: str, name: str) -> str:
    return f"given_{re.sub('[^A-Za-z0-9]', '_', sf_dir)}_{name}"


def register_tables(spark: SparkSession, sf_dir: str, names: set[str]) -> None:
    """Views over the given tables, so that a plan with many branches reads each schema once."""
    for name in names:
        view = view_name(sf_dir, name)
        if not spark.catalog.tableExists(view):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(view)


def shape(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = set(re.findall(r"@t\((\w+)\)", SHAPES[name]))
    register_tables(spark, sf_dir, tables)
    sql = render(SHAPES[name], sf_dir)
    if name not in HEAVY_ROWS:
        return spark.sql(sql)
    for table in tables:
        given = view_name(sf_dir, table)
        if not spark.catalog.tableExists(f"{given}_spread"):
            spread(spark.table(given)).createOrReplaceTempView(f"{given}_spread")
        sql = re.sub(rf"\b{given}\b", f"{given}_spread", sql)
    rows, heavy = spark.sql(sql), HEAVY_ROWS[name]
    # computed once, after the rows were spread: a filter on it does not move below
    return with_computed(rows.withColumnRenamed(heavy, "_heavy"), heavy, F.col("_heavy")).select(*rows.columns)


def spread(df: DataFrame) -> DataFrame:
    """The rows of an input, dealt to at least as many tasks as there are cores, of bounded size."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


# Macros of the oracle side -------------------------------------------------------------------------------------------

def kst(micros: str) -> str:
    """Epoch microseconds as evidence text on the display clock."""
    return f"strftime(make_timestamp(CAST({micros} AS BIGINT) + 32400000000), '%Y-%m-%d %H:%M:%S.%g')"


def filetime(ticks: str) -> str:
    half_even = f"({ticks}) // 10 + CASE WHEN ({ticks}) % 10 > 5 OR (({ticks}) % 10 = 5 AND (({ticks}) // 10) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"CASE WHEN ({ticks}) > 0 THEN {kst(f'({half_even}) - 11644473600000000')} END"


def le(hex_expr: str, offset: int, width: int) -> str:
    """Little-endian number of a hex text."""
    pairs = " || ".join(f"substr({hex_expr}, {2 * (offset + i) + 1}, 2)" for i in reversed(range(width)))
    return f"CAST('0x' || {pairs} AS BIGINT)"


def oracle(shapes: list[str], body: str) -> str:
    """One statement: the shapes as common tables, then the operator."""
    body = render(body.strip(), None)
    common = [f"{name} AS ({render(SHAPES[name], None)})" for name in shapes]
    if body.upper().startswith("SELECT"):
        return ("WITH " + ",\n".join(common) + "\n" if common else "") + body
    return "WITH RECURSIVE " + ",\n".join([*common, body])
