"""Fixed lookup tables of the evidence domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.core import inline_rows, text

SECURITY = "Microsoft-Windows-Security-Auditing"
RDP_CONNECTION = "Microsoft-Windows-TerminalServices-RemoteConnectionManager"
RDP_SESSION = "Microsoft-Windows-TerminalServices-LocalSessionManager"
RDP_CLIENT = "Microsoft-Windows-TerminalServices-ClientActiveXCore"
SMB_SERVER = "Microsoft-Windows-SMBServer"
POWERSHELL = "Microsoft-Windows-PowerShell"
DEFENDER = "Microsoft-Windows-Windows Defender"
TASK_SCHEDULER = "Microsoft-Windows-TaskScheduler"
SERVICES = "Service Control Manager"
KERNEL_GENERAL = "Microsoft-Windows-Kernel-General"
KERNEL_POWER = "Microsoft-Windows-Kernel-Power"
WINLOGON = "Microsoft-Windows-Winlogon"
PROFILES = "Microsoft-Windows-User Profiles Service"
BITS = "Microsoft-Windows-Bits-Client"
WINRM = "Microsoft-Windows-WinRM"

# Event meaning by provider and number.
EVENT_CATALOG = [
    (SECURITY, "4624", "logon", "logon succeeded"), (SECURITY, "4625", "logon", "logon failed"),
    (SECURITY, "4634", "logon", "logoff"), (SECURITY, "4647", "logon", "user initiated logoff"),
    (SECURITY, "4648", "logon", "logon with explicit credentials"), (SECURITY, "4672", "privilege", "logon with administrator rights"),
    (SECURITY, "4720", "account", "account created"), (SECURITY, "4722", "account", "account enabled"),
    (SECURITY, "4724", "account", "password reset attempt"), (SECURITY, "4726", "account", "account deleted"),
    (SECURITY, "4740", "account", "account locked"), (SECURITY, "4728", "group", "member added to global group"),
    (SECURITY, "4732", "group", "member added to local group"), (SECURITY, "4756", "group", "member added to universal group"),
    (SECURITY, "4698", "persistence", "scheduled task created"), (SECURITY, "4697", "persistence", "service installed (security log)"),
    (SECURITY, "1102", "anti-forensics", "audit log cleared"), (SECURITY, "5140", "file share", "network share accessed"),
    (SECURITY, "5145", "file share", "shared file access checked"), (SECURITY, "5156", "network", "connection allowed"),
    (SECURITY, "5157", "network", "connection blocked"), (SECURITY, "4768", "kerberos", "ticket granting ticket requested"),
    (SECURITY, "4769", "kerberos", "service ticket requested"), (SECURITY, "4771", "kerberos", "pre-authentication failed"),
    (SECURITY, "4776", "authentication", "NTLM credentials checked"), (SERVICES, "7045", "persistence", "new service installed"),
    (RDP_CONNECTION, "1149", "remote desktop", "client authenticated"), (RDP_SESSION, "21", "remote desktop", "session logon"),
    (RDP_SESSION, "24", "remote desktop", "session disconnected"), (RDP_SESSION, "25", "remote desktop", "session reconnected"),
    (POWERSHELL, "4104", "PowerShell", "script block recorded"), (TASK_SCHEDULER, "106", "persistence", "scheduled task registered"),
    (TASK_SCHEDULER, "200", "execution", "scheduled task started"), ("Microsoft-Windows-WMI-Activity", "5861", "persistence", "permanent event subscription"),
    (DEFENDER, "1116", "detection", "malware detected"), (DEFENDER, "1117", "detection", "malware action completed"),
    (DEFENDER, "5001", "detection", "realtime protection off"), (DEFENDER, "1006", "detection", "malware detected by scan"),
    (DEFENDER, "1007", "detection", "malware action taken"), (DEFENDER, "1008", "detection", "malware action failed"),
    (DEFENDER, "1009", "detection", "quarantined item restored"), (DEFENDER, "1015", "detection", "suspicious behaviour detected"),
    (DEFENDER, "5007", "detection", "configuration changed"), (DEFENDER, "5010", "detection", "malware scanning disabled"),
    (DEFENDER, "5012", "detection", "file scanning disabled"), ("EventLog", "6005", "system", "event log service started"),
    ("EventLog", "6006", "system", "event log service stopped"), ("EventLog", "6008", "system", "unexpected shutdown"),
    ("EventLog", "6013", "system", "system uptime"), ("EventLog", "1100", "system", "event log service shut down"),
    ("USER32", "1074", "system", "shutdown or restart requested"), ("User32", "1074", "system", "shutdown or restart requested"),
    (KERNEL_GENERAL, "12", "system", "operating system started"), (KERNEL_GENERAL, "13", "system", "operating system stopped"),
    (KERNEL_POWER, "41", "system", "unclean reboot"), (KERNEL_POWER, "42", "system", "entering sleep"),
    ("Microsoft-Windows-Power-Troubleshooter", "1", "system", "resumed from sleep"), (WINLOGON, "7001", "logon", "interactive logon"),
    (WINLOGON, "7002", "logon", "interactive logoff"), (PROFILES, "1", "logon", "profile load started"),
    (PROFILES, "2", "logon", "profile load finished"), (SERVICES, "7000", "service", "service failed to start"),
    (SERVICES, "7009", "service", "service start timed out"), (SERVICES, "7034", "service", "service terminated unexpectedly"),
    (SERVICES, "7035", "service", "service control sent"), (SERVICES, "7036", "service", "service state changed"),
    (SERVICES, "7040", "service", "service start type changed"), (SECURITY, "4688", "execution", "process created"),
    (SECURITY, "4689", "execution", "process exited"), (SECURITY, "4657", "registry", "registry value modified"),
    (SECURITY, "4663", "object access", "object access attempted"), (SECURITY, "4670", "privilege", "object permissions changed"),
    (SECURITY, "4673", "privilege", "privileged service called"), (SECURITY, "4719", "anti-forensics", "audit policy changed"),
    (SECURITY, "4738", "account", "account changed"), (SECURITY, "4767", "account", "account unlocked"),
    (SECURITY, "4700", "persistence", "scheduled task enabled"), (SECURITY, "4701", "persistence", "scheduled task disabled"),
    (SECURITY, "4702", "persistence", "scheduled task updated"), (SECURITY, "4778", "remote desktop", "session reconnected"),
    (SECURITY, "4779", "remote desktop", "session disconnected"), (SECURITY, "4798", "account", "local group membership listed"),
    (SECURITY, "4799", "group", "security group members listed"), (SECURITY, "4964", "logon", "special group logon"),
    (SECURITY, "5379", "credentials", "credential manager read"), (TASK_SCHEDULER, "140", "persistence", "scheduled task updated"),
    (TASK_SCHEDULER, "141", "persistence", "scheduled task deleted"), (TASK_SCHEDULER, "129", "execution", "task process created"),
    (TASK_SCHEDULER, "201", "execution", "task action completed"), (POWERSHELL, "4103", "PowerShell", "module logging"),
    (POWERSHELL, "4100", "PowerShell", "execution error"), ("PowerShell", "400", "PowerShell", "engine started"),
    ("PowerShell", "600", "PowerShell", "provider started"), (WINRM, "91", "remote", "remote shell session created"),
    (WINRM, "168", "remote", "remote shell authentication"), (BITS, "3", "download", "transfer job created"),
    (BITS, "59", "download", "transfer started"), (BITS, "60", "download", "transfer completed"),
    (RDP_SESSION, "23", "remote desktop", "session logoff"), (RDP_SESSION, "39", "remote desktop", "session disconnected by another session"),
    (RDP_SESSION, "40", "remote desktop", "session disconnected with reason"), (RDP_CONNECTION, "1158", "remote desktop", "remote connection accepted"),
    ("Application Error", "1000", "error", "application crashed"), ("Application Hang", "1002", "error", "application stopped responding"),
    ("Windows Error Reporting", "1001", "error", "error report"),
]

# Logs that enter the event table.
LOG_ALLOWLIST = [
    "Security.evtx", "System.evtx", "Application.evtx",
    "Microsoft-Windows-PowerShell%4Operational.evtx", "Windows PowerShell.evtx",
    "Microsoft-Windows-TerminalServices-LocalSessionManager%4Operational.evtx",
    "Microsoft-Windows-TerminalServices-RemoteConnectionManager%4Operational.evtx",
    "Microsoft-Windows-TerminalServices-RDPClient%4Operational.evtx",
    "Microsoft-Windows-Windows Defender%4Operational.evtx",
    "Microsoft-Windows-TaskScheduler%4Operational.evtx",
    "Microsoft-Windows-SMBServer%4Security.evtx", "Microsoft-Windows-SMBServer%4Audit.evtx",
    "Microsoft-Windows-SmbClient%4Security.evtx", "Microsoft-Windows-Bits-Client%4Operational.evtx",
    "Microsoft-Windows-Windows Firewall With Advanced Security%4Firewall.evtx",
]

# Journal reason and file attribute bits.
JOURNAL_REASONS = [
    (0x1, "DATA_OVERWRITE"), (0x2, "DATA_EXTEND"), (0x4, "DATA_TRUNCATION"),
    (0x10, "NAMED_DATA_OVERWRITE"), (0x20, "NAMED_DATA_EXTEND"), (0x40, "NAMED_DATA_TRUNCATION"),
    (0x100, "FILE_CREATE"), (0x200, "FILE_DELETE"), (0x400, "EA_CHANGE"), (0x800, "SECURITY_CHANGE"),
    (0x1000, "RENAME_OLD_NAME"), (0x2000, "RENAME_NEW_NAME"), (0x4000, "INDEXABLE_CHANGE"),
    (0x8000, "BASIC_INFO_CHANGE"), (0x10000, "HARD_LINK_CHANGE"), (0x20000, "COMPRESSION_CHANGE"),
    (0x40000, "ENCRYPTION_CHANGE"), (0x80000, "OBJECT_ID_CHANGE"), (0x100000, "REPARSE_POINT_CHANGE"),
    (0x200000, "STREAM_CHANGE"), (0x400000, "TRANSACTED_CHANGE"), (0x800000, "INTEGRITY_CHANGE"),
    (0x80000000, "CLOSE"),
]
FILE_ATTRIBUTES = [
    (0x1, "READONLY"), (0x2, "HIDDEN"), (0x4, "SYSTEM"), (0x10, "DIRECTORY"), (0x20, "ARCHIVE"),
    (0x80, "NORMAL"), (0x100, "TEMPORARY"), (0x200, "SPARSE_FILE"), (0x400, "REPARSE_POINT"),
    (0x800, "COMPRESSED"), (0x1000, "OFFLINE"), (0x4000, "ENCRYPTED"),
]

# Well-known identifiers, server versions, privileges.
SERVICE_SIDS = {"S-1-5-18": "LocalSystem", "S-1-5-19": "LocalService", "S-1-5-20": "NetworkService"}
LABELLED_SIDS = {
    **SERVICE_SIDS, "S-1-1-0": "Everyone", "S-1-5-7": "Anonymous", "S-1-5-11": "Authenticated Users",
    "S-1-5-32-544": "Administrators", "S-1-5-32-545": "Users",
}
SQL_SERVER_YEARS = {
    "10": "2008", "11": "2012", "12": "2014", "13": "2016", "14": "2017", "15": "2019", "16": "2022", "17": "2025",
}
PRIVILEGES = {
    "SeTcbPrivilege": "act as part of the operating system", "SeCreateTokenPrivilege": "create a token object",
    "SeDebugPrivilege": "debug programs", "SeBackupPrivilege": "back up files and directories",
    "SeRestorePrivilege": "restore files and directories", "SeLoadDriverPrivilege": "load and unload device drivers",
    "SeTakeOwnershipPrivilege": "take ownership of objects", "SeImpersonatePrivilege": "impersonate a client",
    "SeAssignPrimaryTokenPrivilege": "assign a primary token", "SeSecurityPrivilege": "manage auditing and the security log",
    "SeSystemtimePrivilege": "change the system time", "SeAuditPrivilege": "generate security audits",
    "SeEnableDelegationPrivilege": "enable trusted delegation", "SeTrustedCredManAccessPrivilege": "access credential manager as a trusted caller",
    "SeRelabelPrivilege": "modify an object label", "SeSystemEnvironmentPrivilege": "modify firmware environment values",
    "SeDelegateSessionUserImpersonatePrivilege": "impersonate another session user", "SeChangeNotifyPrivilege": "bypass traverse checking",
    "SeShutdownPrivilege": "shut down the system", "SeRemoteShutdownPrivilege": "shut down from a remote system",
    "SeSystemProfilePrivilege": "profile system performance", "SeProfileSingleProcessPrivilege": "profile a single process",
    "SeIncreaseBasePriorityPrivilege": "increase scheduling priority", "SeCreatePagefilePrivilege": "create a page file",
    "SeCreatePermanentPrivilege": "create permanent shared objects", "SeIncreaseQuotaPrivilege": "adjust memory quotas",
    "SeIncreaseWorkingSetPrivilege": "increase a working set", "SeManageVolumePrivilege": "perform volume maintenance",
    "SeCreateGlobalPrivilege": "create global objects", "SeCreateSymbolicLinkPrivilege": "create symbolic links",
    "SeTimeZonePrivilege": "change the time zone", "SeUndockPrivilege": "undock the computer",
    "SeMachineAccountPrivilege": "add workstations to a domain", "SeLockMemoryPrivilege": "lock pages in memory",
}


def catalog_table(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["Provider", "EventID", "event_category", "event_label"], EVENT_CATALOG)


def with_catalog(events: DataFrame) -> DataFrame:
    """Category and label for known (provider, number) pairs; the catalog is a fixed table of about a hundred rows."""
    return events.join(F.broadcast(catalog_table(events.sparkSession)), ["Provider", "EventID"], "left")


def privileges_table(spark: SparkSession) -> DataFrame:
    return inline_rows(spark, ["privilege", "privilege_text"], list(PRIVILEGES.items()))


def privilege_names(raw: Column | str) -> Column:
    """Privilege tokens of a blank- or comma-separated list."""
    return F.filter(F.split(F.trim(text(raw)), r"[\s,]+"), lambda x: x.rlike("^Se[A-Za-z]+Privilege$"))


def service_name(sid: Column) -> Column:
    found = F.when(F.lit(False), F.lit(""))
    for known, name in SERVICE_SIDS.items():
        found = found.when(sid == known, name)
    return found


def sid_label(sid: Column | str) -> Column:
    value = text(sid)
    name = F.when(F.lit(False), F.lit(""))
    for known, label in LABELLED_SIDS.items():
        name = name.when(value == known, label)
    name = name.when(value.rlike("^S-1-5-21-.*-500$"), "Administrator")
    return F.when(name.isNotNull(), F.concat(value, F.lit(" ("), name, F.lit(")"))).otherwise(F.nullif(value, F.lit("")))
