"""Rule-based triage tags: ARRAY<STRUCT<code, severity>> per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.core import any_of, col, text
from caseloom.functions.eventdata import payload

# Path rules, browser verdict codes, script patterns.
PATH_RULES = [
    ("temp_folder", "warning", r"(?i)\\(?:appdata\\local\\)?temp\\"),
    ("downloads_folder", "warning", r"(?i)\\downloads\\"),
    ("public_folder", "warning", r"(?i)\\users\\public\\"),
    ("programdata", "warning", r"(?i)\\programdata\\(?!microsoft\\)"),
    ("lolbin", "danger", r"(?i)\\(powershell|wscript|cscript|mshta|regsvr32|rundll32|certutil)\.exe"),
]
DANGEROUS_DOWNLOADS = {
    "1": "dangerous_file", "2": "dangerous_url", "3": "dangerous_content",
    "4": "maybe_dangerous_content", "7": "dangerous_host", "8": "potentially_unwanted",
}
SUSPICIOUS_SCRIPT = (
    r"(?i)-enc\b|-e\s+[A-Za-z0-9+/=]{20}|invoke-expression|iex[\s(]|downloadstring|downloadfile"
    r"|frombase64string|-w(indowstyle)?\s+hidden|-nop\b|bypass"
)
SECURITY = "Microsoft-Windows-Security-Auditing"
DEFENDER = "Microsoft-Windows-Windows Defender"
TASKS = "Microsoft-Windows-TaskScheduler"


def _tag(code: Column | str, severity: Column | str) -> Column:
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return F.struct(as_col(code).alias("code"), as_col(severity).alias("severity"))


def _collect(rules: list[tuple[Column, Column]]) -> Column:
    candidates = F.array(*[F.when(condition, tag) for condition, tag in rules])
    return F.filter(candidates, lambda t: t.isNotNull())


def path_tags(path: Column | str) -> Column:
    value = text(path)
    return _collect([(value.rlike(pattern), _tag(code, severity)) for code, severity, pattern in PATH_RULES])


def level_tags(level: Column | str) -> Column:
    value = text(level)
    return _collect([
        (value == "Critical", _tag("critical_event", "danger")),
        (value == "Error", _tag("error_event", "danger")),
    ])


def tag_payload(event_data: Column | str) -> Column:
    """The payload fields the event rules look at."""
    return payload(event_data, ["LogonType", "TargetUserName", "ScriptBlockText"])


def security_tags(provider: Column | str, event_id: Column | str, data: Column) -> Column:
    """Event rules over a parsed ``tag_payload``."""
    p, e = text(provider), text(event_id)
    logon, group = text(data["LogonType"]), text(data["TargetUserName"])
    admin = group.rlike("(?i)admin|관리자")
    added = e.isin("4728", "4732", "4756")
    return _collect([
        (e == "1102", _tag("audit_log_cleared", "danger")),
        (e == "4625", _tag("logon_failure", "warning")),
        (e == "4648", _tag("explicit_credentials", "warning")),
        ((e == "4624") & (logon == "10"), _tag("remote_desktop_logon", "warning")),
        ((e == "4624") & (logon == "3"), _tag("network_logon", "warning")),
        (added, _tag(F.when(admin, "admin_group_member_added").otherwise("group_member_added"),
                     F.when(admin, "danger").otherwise("warning"))),
        ((e == "7045") | ((p == SECURITY) & (e == "4697")), _tag("service_installed", "warning")),
        ((e == "4698") | ((p == TASKS) & (e == "106")), _tag("task_created", "warning")),
        (e.isin("5140", "5145"), _tag("share_access", "warning")),
        (e == "5156", _tag("connection_allowed", "warning")),
        (e == "1149", _tag("remote_desktop_authenticated", "warning")),
        (e == "5861", _tag("wmi_subscription", "danger")),
        (e == "1116", _tag("malware_detected", "danger")),
        (e == "5001", _tag("realtime_protection_off", "danger")),
        (e == "4720", _tag("account_created", "warning")),
        ((e == "4104") & text(data["ScriptBlockText"]).rlike(SUSPICIOUS_SCRIPT), _tag("suspicious_script", "danger")),
        (e == "4719", _tag("audit_policy_changed", "danger")),
        ((p == DEFENDER) & e.isin("5010", "5012"), _tag("scanning_disabled", "danger")),
        ((p == DEFENDER) & e.isin("1006", "1015"), _tag("threat_detected", "danger")),
    ])


def name_mismatch_tags(actual: Column | str, original: Column | str) -> Column:
    """The name on disk differs from the internal name, ignoring case and extension."""
    a, o = F.lower(F.trim(text(actual))), F.lower(F.trim(text(original)))
    strip = lambda v: F.regexp_replace(v, r"\.[a-z0-9]+$", "")
    given = (text(actual) != "") & (text(original) != "")
    return _collect([(given & (a != o) & (strip(a) != strip(o)), _tag("name_mismatch", "danger"))])


def danger_type_tags(danger: Column | str) -> Column:
    value = text(danger)
    return _collect([(value == code, _tag(name, "danger")) for code, name in DANGEROUS_DOWNLOADS.items()])


def boolean_tags(value: Column | str, code: str, severity: str) -> Column:
    return _collect([(text(value).isin("True", "true", "1"), _tag(code, severity))])


def missing_publisher_tags(publisher: Column | str) -> Column:
    return _collect([(F.trim(text(publisher)) == "", _tag("publisher_missing", "warning"))])


def finding_tags(status: Column | str, detail: Column | str) -> Column:
    given = text(detail) != ""
    return _collect([
        (given & (text(status) == "suspicious"), _tag("suspicious", "danger")),
        (given & (text(status) == "caution"), _tag("caution", "warning")),
    ])


def no_tags() -> Column:
    return F.array().cast("array<struct<code:string,severity:string>>")


def tag_codes(tags: Column) -> Column:
    """Codes joined for display and comparison."""
    return F.array_join(F.transform(tags, lambda t: t["code"]), ",")


def risk_of(tags: Column, unsigned: Column) -> Column:
    """2 with a danger tag, 1 with any tag or without a publisher, else 0."""
    danger = F.exists(tags, lambda t: t["severity"] == "danger")
    return F.when(danger, 2).when((F.size(tags) > 0) | unsigned, 1).otherwise(0)


def severity_class(severity: Column | str) -> Column:
    value = text(severity)
    return F.when(value.rlike("(?i)심각|critical|높음|high"), "danger").when(
        value.rlike("(?i)보통|medium|경고|moderate"), "warning").otherwise("neutral")


def is_neutralised(action: Column | str) -> Column:
    return text(action).rlike("(?i)격리|제거|quarantine|remove|clean|차단|block")


def tamper_tone(title: Column | str, event_id: Column | str) -> Column:
    t, e = text(title), text(event_id)
    return F.when((t == "realtime protection restored") | (e == "5000"), "ok").when(
        (t == "realtime protection off") | e.isin("5001", "5010", "5012"), "danger").otherwise("warning")


def report_tone(event_type: Column | str) -> Column:
    value = text(event_type)
    return F.when(value.rlike("(?i)HANG"), "warning").when(value.rlike("(?i)CRASH|BEX|FATAL|Exception|CLR"), "danger").otherwise("neutral")


def is_windows_path(path: Column | str) -> Column:
    value = F.lower(text(path))
    return any_of([
        value.rlike(r"^[a-z]:\\windows(\\|$)"),
        value.startswith("\\windows\\"), value.startswith("%systemroot%"), value.startswith("\\systemroot\\"),
        value.rlike(r"\\device\\harddiskvolume\d+\\windows\\"),
        value.rlike(r"(^|\\)windows\\(system32|syswow64|winsxs)\\"),
    ])


def is_interactive_user(sid: Column | str) -> Column:
    """Machine or domain account with the built-in administrator number or a number from 1000 on."""
    value = text(sid)
    rid = F.regexp_extract(value, r"-(\d+)$", 1).try_cast("bigint")
    return value.rlike("^S-1-5-21-") & F.coalesce((rid == 500) | (rid >= 1000), F.lit(False))


def report_app_path(event_data: Column | str) -> Column:
    """Executable path among the payload values, ignoring the report folder."""
    values = F.map_values(F.from_json(col(event_data), "map<string,string>"))
    hit = F.filter(values, lambda v: v.rlike(r"(?i)^[a-z]:\\.+\.(exe|dll|sys)$") & ~v.rlike(r"(?i)\\WER\\"))
    return F.get(hit, F.lit(0))


def report_reason(event_data: Column | str) -> Column:
    d = payload(event_data, ["Response", "P3", "P4"])
    response = F.when(~text(d["Response"]).rlike(r"(?i)사용할 수 없|not ?available|^n/?a$"), d["Response"])
    parts = F.filter(F.array(response, d["P3"], d["P4"]), lambda x: x.isNotNull() & (x != ""))
    return F.nullif(F.array_join(parts, " · "), F.lit(""))
