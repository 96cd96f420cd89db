"""Script execution history and its sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import eventdata as ed
from caseloom.functions import lookups as lk
from caseloom.functions import text as tx
from caseloom.functions import times
from caseloom.functions.core import blank_to_null, text, with_computed
from caseloom.operators import ordered
from caseloom.plans.common import HOST, overview_row, union_all
from caseloom.sources.raw import SCAN_TIES, live_hives, scan_seq

# Labels of the context text, in both languages the logs use.
HOST_LABELS = ["Host Application", "호스트 응용"]
USER_LABELS = ["User", "사용자"]
COMMAND_LABELS = ["Command Name", "명령 이름"]
SESSION_GAP_MS = 30 * 60 * 1000


def user_names(registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    """Profile name per security identifier; the last profile in scan order wins."""
    profiles = live_hives(registry).filter(
        F.lower("key_path").contains("\\profilelist\\s-") & (F.col("value_name") == "ProfileImagePath")
    ).withColumn("sid", tx.last_segment("key_path")).withColumn("user_name", blank_to_null(tx.last_segment("value_data")))
    named = profiles.filter((F.col("sid") != "") & F.col("user_name").isNotNull())
    return named.groupBy(*keys, "sid").agg(F.max_by("user_name", scan_seq()).alias("user_name"))


def with_account(rows: DataFrame, names: DataFrame, keys: list[str], sid: str = "UserID") -> DataFrame:
    """Profile name of the row's identifier, else the identifier itself."""
    known = names.withColumnRenamed("sid", sid)
    return rows.join(known, [*keys, sid], "left").withColumn("_account", F.coalesce("user_name", F.col(sid))).drop("user_name")


def powershell_history(events: DataFrame, registry: DataFrame, keys: list[str] = HOST) -> DataFrame:
    names = user_names(registry, keys)
    d = F.col("_d")
    modern = (F.col("Provider") == lk.POWERSHELL) & F.col("EventID").isin("4103", "4104")
    classic = (F.col("Provider") == "PowerShell") & (F.col("EventID") == "800")
    rows = events.filter(modern | classic)

    # 4104: single blocks stay rows, multi-part blocks are put together.
    script = with_computed(
        rows.filter((F.col("Provider") == lk.POWERSHELL) & (F.col("EventID") == "4104")), "_d", ed.payload("EventData", ["ScriptBlockText", "Path", "ScriptBlockId", "MessageTotal", "MessageNumber"])
    )
    number = lambda name: F.coalesce(F.trim(d[name]).try_cast("bigint"), F.lit(1))
    script = script.withColumn("_id", blank_to_null(d["ScriptBlockId"])).withColumn("_total", number("MessageTotal")).withColumn("_number", number("MessageNumber"))
    is_part = F.col("_id").isNotNull() & (F.col("_total") > 1)
    single = with_account(script.filter(~is_part), names, keys)
    blocks = with_account(join_blocks(script.filter(is_part), keys), names, keys)

    pipeline = with_computed(
        rows.filter((F.col("Provider") == lk.POWERSHELL) & (F.col("EventID") == "4103")), "_d", ed.payload("EventData", ["ContextInfo", "Payload"])
    )
    pipeline = with_account(pipeline, names, keys)
    context = d["ContextInfo"]
    p_host = tx.labelled_value(context, HOST_LABELS)
    p_command = F.coalesce(blank_to_null(F.regexp_replace(d["Payload"], r"^\s+|\s+$", "")), tx.labelled_value(context, COMMAND_LABELS))

    old = with_account(with_computed(rows.filter(classic), "_blob", all_text("EventData")), names, keys)
    c_host, c_command = tx.after_token("_blob", "HostApplication="), tx.after_token("_blob", "CommandLine=")
    old = old.withColumn("_host", c_host).withColumn("_command", c_command).filter(
        F.col("_host").isNotNull() | F.col("_command").isNotNull()
    )

    extra = [*keys, *SCAN_TIES]
    process = lambda host: F.coalesce(tx.exe_from_host(host), F.lit("powershell.exe"))
    base = dict(timestamp=F.col("timestamp"), process_id=F.col("ProcessID"), event_id=F.col("EventID"),
                provider=F.col("Provider"), record_key=F.col("_record_key"))
    return union_all([
        overview_row(single, "PowerShellHistory", extra, **base, account=F.col("_account"), process="powershell.exe",
                     script_block=blank_to_null(d["ScriptBlockText"]), kind="script block", script_path=blank_to_null(d["Path"])),
        overview_row(pipeline, "PowerShellHistory", extra, **base, account=F.coalesce(tx.labelled_value(context, USER_LABELS), F.col("_account")),
                     process=process(p_host), command=tx.first_line(p_command), host_application=p_host, kind="pipeline"),
        overview_row(old, "PowerShellHistory", extra, **base, account=F.coalesce(tx.after_token("_blob", "UserId="), F.col("_account")),
                     process=process(F.col("_host")), command=tx.first_line("_command"), host_application=F.col("_host"), kind="command"),
        overview_row(blocks, "PowerShellHistory", extra, timestamp=F.col("timestamp"), process_id=F.col("ProcessID"),
                     event_id=F.lit("4104"), provider=F.lit(lk.POWERSHELL), record_key=F.col("_record_key"), account=F.col("_account"),
                     process="powershell.exe", script_block=F.col("script_block"), kind="script block", script_path=F.col("path")),
    ])


def join_blocks(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Multi-part script blocks: the last text per part number, parts by number, the earliest time, first-seen context.

    Repeated copies of a part are reduced before parts are listed, so a list is as long as the block has parts.
    """
    seq = scan_seq()
    timed = F.when(F.col("timestamp").isNotNull(), F.struct(F.col("timestamp").alias("ts"), seq.alias("seq"), F.col("_record_key").alias("rk")))
    first = F.struct(
        seq.alias("seq"), F.col("UserID").alias("sid"), F.col("ProcessID").alias("pid"),
        F.col("_d.Path").alias("path"), F.col("_record_key").alias("rk"), *SCAN_TIES,
    )
    per_part = parts.groupBy(*keys, "_id", "_number").agg(
        F.max_by(text("_d.ScriptBlockText"), seq).alias("part"), F.min(timed).alias("early"), F.min(first).alias("first")
    )
    whole = per_part.groupBy(*keys, "_id").agg(
        F.array_sort(F.collect_list(F.struct("_number", "part"))).alias("parts"), F.min("early").alias("early"), F.min("first").alias("first")
    )
    return whole.select(
        *keys,
        F.col("first.sid").alias("UserID"), F.col("first.pid").alias("ProcessID"), blank_to_null(F.col("first.path")).alias("path"),
        F.col("early.ts").alias("timestamp"), F.coalesce("early.rk", "first.rk").alias("_record_key"),
        blank_to_null(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("script_block"),
        *[F.col(f"first.{c}").alias(c) for c in SCAN_TIES],
    )


def all_text(raw: Column | str) -> Column:
    """All strings of a nested payload, one per line, in document order."""
    value = F.col(raw) if isinstance(raw, str) else raw
    literals = F.regexp_extract_all(value, F.lit(r'"((?:[^"\\]|\\.)*)"\s*(:?)'), F.lit(0))
    strings = F.filter(literals, lambda s: ~s.rlike(r":$"))
    decoded = F.transform(strings, lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0)))
    return F.when(F.try_parse_json(value).isNotNull(), F.array_join(decoded, "\n"))


def evidence_text() -> Column:
    """First line of the script, else of the command, else of the host application; a view cuts it to its width."""
    return F.coalesce(*[tx.first_line(F.col(c)) for c in ("script_block", "command", "host_application")], F.lit("(no text recorded)"))


def script_sessions(history: DataFrame, keys: list[str] = HOST, gap_ms: int = SESSION_GAP_MS,
                    start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows with their session: one identity (account, process id or name), gaps over half an hour split it."""
    rows = history.filter(F.col("timestamp").isNotNull() & times.in_range("timestamp", start, end)).withColumn(
        "identity", F.concat(text("account"), F.lit("||"), F.coalesce(blank_to_null("process_id"), text("process")))
    ).withColumn("_t", times.epoch_millis("timestamp"))
    order = ordered.ScanOrder((*keys, "identity"), "_t", SCAN_TIES)
    return ordered.cluster_sessions(rows, order, gap_ms)


def script_session_table(sessions: DataFrame, keys: list[str] = HOST) -> DataFrame:
    order = F.struct("timestamp", *SCAN_TIES)
    first = lambda c: F.min_by(c, F.when(text(c) != "", order))
    return sessions.groupBy(*keys, "identity", "session_start").agg(
        first("account").alias("account"), first("process").alias("process"), F.min_by("process_id", order).alias("process_id"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), F.count(F.lit(1)).alias("events"),
        F.min_by(evidence_text(), order).alias("first_evidence"),
    )
