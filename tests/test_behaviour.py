"""Behaviour an analyst relies on, on small hand-made evidence."""

import base64
import json

from pyspark.sql import functions as F

from caseloom.operators.filters import ActivityFilter, Page, beyond
from caseloom.plans import accounts, browser, conversations, defender, powershell, remote_access, search
from caseloom.schemas import raw_schema
from caseloom.sources import documents, inventory, raw, records

EVENT = "host_id string, timestamp string, Provider string, EventID string, EventData string, UserID string, ProcessID string, log string, _record_key string, _source_file string, _rowid long"
REGISTRY = "host_id string, hive string, key_path string, value_name string, value_data string, last_write string, _recovery string, _source_file string, _rowid long"


def events(spark, rows):
    full = []
    for i, r in enumerate(rows):
        r = {"timestamp": f"2024-01-01 00:00:{i:02d}.000", "UserID": "", "log": "Security", **r}
        full.append(("h", r["timestamp"], r["Provider"], r["EventID"], r["EventData"], r["UserID"], "1", r["log"], f"{r['log']}.evtx::{i}", f"/{r['log']}", i))
    return spark.createDataFrame(full, EVENT)


def test_classic_script_event_keeps_host_and_account(spark):
    data = json.dumps({"Data": "HostApplication=powershell.exe -nop\r\nUserId=CONTOSO\\analyst"})
    rows = powershell.powershell_history(events(spark, [{"Provider": "PowerShell", "EventID": "800", "EventData": data}]), spark.createDataFrame([], REGISTRY)).collect()
    assert [(r["host_application"], r["account"], r["command"]) for r in rows] == [("powershell.exe -nop", "CONTOSO\\analyst", None)]


def test_file_server_failure(spark):
    data = json.dumps({"EventData": {"ClientName": "\\\\192.0.2.15", "UserName": "CONTOSO\\analyst"}})
    rows = remote_access.file_share_history(events(spark, [{"Provider": "Microsoft-Windows-SMBServer", "EventID": "1009", "EventData": data}])).collect()
    assert [(r["remote_address"], r["account"], r["result"]) for r in rows] == [("192.0.2.15", "analyst", "failure")]


def test_logon_type_places(spark):
    """The share history also looks into the nested payload, the desktop history only at the top."""
    nested = json.dumps({"EventXML": {"LogonType": "3", "IpAddress": "1.1.1.1"}, "LogonType": "10", "IpAddress": "2.2.2.2"})
    ev = events(spark, [{"Provider": "Microsoft-Windows-Security-Auditing", "EventID": "4624", "EventData": nested}])
    assert [r["remote_address"] for r in remote_access.file_share_history(ev).collect()] == ["1.1.1.1"]
    assert [r["remote_address"] for r in remote_access.remote_desktop_history(ev).collect()] == ["1.1.1.1"]


def test_carry_forward_real_window(spark):
    ax = "Microsoft-Windows-TerminalServices-ClientActiveXCore"
    times = ["00:00:00.000", "00:05:00.000", "00:05:00.001", "00:04:00.000"]
    rows = [{"Provider": ax, "EventID": "1024" if i == 0 else "1025", "EventData": '{"Value":"9.9.9.9"}' if i == 0 else "{}", "timestamp": f"2024-01-01 {t}"} for i, t in enumerate(times)]
    got = {r["_rowid"]: r["remote_address"] for r in remote_access.remote_desktop_history(events(spark, rows)).collect()}
    assert got == {0: "9.9.9.9", 1: "9.9.9.9", 2: None, 3: "9.9.9.9"}


def threat(eid, ts, **fields):
    return {"Provider": "Microsoft-Windows-Windows Defender", "EventID": eid, "timestamp": ts, "log": "Microsoft-Windows-Windows Defender",
            "EventData": json.dumps({"Detection ID": "d1", **{k.replace("_", " "): v for k, v in fields.items()}})}


def test_threat_time_follows_the_first_event(spark):
    def merged(rows):
        return defender.threats(defender.defender_events(events(spark, rows)), ["host_id"]).collect()[0]

    late_detection = merged([threat("1117", "2024-01-02 00:00:00.000", Action_Name="Quarantine"), threat("1116", "2024-01-03 00:00:00.000", Threat_Name="T")])
    assert (late_detection["timestamp"], late_detection["record_key"][-1], late_detection["action"]) == ("2024-01-02 00:00:00.000", "0", "Quarantine")
    early_detection = merged([threat("1117", "2024-01-02 00:00:00.000"), threat("1116", "2024-01-01 00:00:00.000")])
    assert (early_detection["timestamp"], early_detection["record_key"][-1]) == ("2024-01-01 00:00:00.000", "1")
    ignored_later_action = merged([threat("1116", "2024-01-03 00:00:00.000"), threat("1117", "2024-01-01 00:00:00.000", Action_Name="해당 없음")])
    assert (ignored_later_action["timestamp"], ignored_later_action["action"]) == ("2024-01-03 00:00:00.000", "detected only")


def evidence(spark, data, sid, name, provider="p", event_id="1", user_id=""):
    ev = events(spark, [{"Provider": provider, "EventID": event_id, "EventData": data, "UserID": user_id}])
    return [r["evidence"] for r in accounts.one_account(ev, sid, name).collect()]


def test_account_evidence(spark):
    sid = "S-1-5-21-1-2-3-1001"
    assert evidence(spark, json.dumps({"TargetUserSid": sid}), sid.lower(), "") == [f"[sid] target · TargetUserSid = {sid}"]
    # An identifier inside free text is no identity.
    assert evidence(spark, json.dumps({"RuleId": f"x {sid}"}), sid, "kim") == []
    # A role with an identifier never falls back to its name.
    assert evidence(spark, json.dumps({"TargetUserSid": "S-1-9", "TargetUserName": "kim"}), sid, "kim") == []
    assert evidence(spark, json.dumps({"TargetUserName": "CORP\\Kim"}), sid, "kim") == ["[name] target · TargetUserName = CORP\\Kim"]
    assert evidence(spark, json.dumps({"UserData": {"EventXML": {"User": "CORP\\kim"}}}), "", "kim", "Microsoft-Windows-TerminalServices-LocalSessionManager", "21") == [
        "[name] session user · UserData.EventXML.User = CORP\\kim"]
    assert evidence(spark, json.dumps({"User": "kim"}), "", "kim") == []
    assert evidence(spark, '{"TargetUserName":"\\u006bim"}', "", "kim") == ["[name] target · TargetUserName = kim"]
    assert evidence(spark, "{}", sid, "", user_id=sid) == [f"[sid] event principal · UserID = {sid}"]


ACTIVITY = "host_id string, account string, kind string, timestamp string, title string, url string, url_raw string, visit_count string, _source_file string, _rowid long"


def activity(spark, rows):
    return spark.createDataFrame([("h", "a", k, f"2024-01-0{i % 9 + 1} 00:00:00.000", "t", u, u, c, "f", i) for i, (k, u, c) in enumerate(rows)], ACTIVITY)


def test_domain_normalisation(spark):
    rows = [("visit", "https://user:pw@Example.com:8443/a", "2"), ("visit", "http://EXAMPLE.com./b", "3"), ("visit", "https://example.com/a", None),
            ("visit", "https://other.test/", "4"), ("visit", "file:///C:/x", "9"), ("visit", "about:blank", "1"), ("download", "https://example.com/z", "5")]
    got = {r["domain"]: (r["visit_count"], r["url_count"]) for r in browser.visited_domains(activity(spark, rows)).collect()}
    assert got == {"example.com": (5, 3), "other.test": (4, 1)}


def test_insights_and_summary(spark):
    rows = [("visit", "https://a.test/x", "3"), ("visit", "https://a.test/x", "4"), ("visit", "file:///c", "2"), ("download", "https://d.test/f", None), ("cache", "https://a.test/y", None)]
    df = activity(spark, rows)
    cards = browser.insights(df)
    assert cards["visit_total"].collect()[0][0] == 7
    assert [(r["domain"], r["url_count"]) for r in cards["top_domains"].collect()] == [("a.test", 1)]
    assert cards["download_total"].collect()[0][0] == 1 and cards["downloads"].count() == 1
    parts = {(r["part"], r["value"]): r["count"] for r in browser.summary(df, ActivityFilter(account=ActivityFilter.ALL_ACCOUNTS)).collect()}
    assert parts[("total", None)] == 5 and parts[("account", "a")] == 5
    assert browser.summary(df, ActivityFilter(account="nobody")).collect()[0]["count"] == 0


def test_cache_body_flag(spark):
    base = dict(response_time="2024-01-01 00:00:00.000", url="https://a/b", account="a")
    rows = [tuple({**base, "body_b64": b}.get(f) for f in raw_schema("cache_entries").fieldNames()[:-1]) + (i,) for i, b in enumerate(["aGk=", ""])]
    cache = spark.createDataFrame(rows, raw_schema("cache_entries"))
    none = spark.createDataFrame([], "host_id string, account string, url string, title string, visit_count string, typed_count string, last_visit_time string, _source_file string, _rowid long")
    down = spark.createDataFrame([], raw_schema("history_downloads")).withColumn("account", F.lit("a"))
    got = {r["_rowid"]: r["cache_body_recovered"] for r in browser.browser_activity(cache, none, down).collect()}
    assert got == {0: "1", 1: None}


def test_conversation_endpoints(spark):
    def found(url, payload, kind="application/json", raw_body=None):
        body = base64.b64encode(raw_body if raw_body is not None else payload.encode()).decode()
        row = {"url": url, "content_type": kind, "body_b64": body, "response_time": "2024-01-01 00:00:00.000"}
        cache = spark.createDataFrame([tuple(row.get(f) for f in raw_schema("cache_entries").fieldNames()[:-1]) + (1,)], raw_schema("cache_entries"))
        return conversations.conversations(cache).collect()

    chat = "https://chatgpt.com/backend-api/conversation/abc"
    assert len(found(chat, '{"mapping":{}}')) == 1
    assert found(chat + "/stream_status", '{"mapping":{}}') == []
    assert found("https://chatgpt.com/backend-api/settings", '{"mapping":{}}') == []
    assert found(chat, '{"mapping":[]}') == []
    assert found(chat, "", raw_body=b"\xff\xfe{}") == []
    assert found(chat, '{"mapping":{}}', kind="text/html") == []
    row = found("https://claude.ai/api/chat_conversations/x?y", ')]}\'\n{"messages":[],"created_at":1704067200}'.replace("]}", "]"))[0]
    assert (row["provider"], row["created_at"]) == ("Claude", "1704067200")


def test_body_preview_needs_the_exact_key(spark):
    rows = [{"account": "a", "url": "u", "cache_key": "k1", "body_b64": "aGVsbG8="}, {"account": "a", "url": "u", "cache_key": "", "body_b64": "eA=="}]
    cache = spark.createDataFrame([tuple({"host_id": "h", **r}.get(f) for f in raw_schema("cache_entries").fieldNames()[:-1]) + (i,) for i, r in enumerate(rows)], raw_schema("cache_entries"))
    ask = cache.select("host_id", "account", "url", "cache_key")
    got = browser.body_preview(cache, ask).collect()
    assert [(r["cache_key"], r["decoded_size"], r["truncated"]) for r in got] == [("k1", 5, False)]


def test_search_needs_two_characters(spark):
    df = spark.createDataFrame([("h", 1, "A_b%"), ("h", 2, "axbz")], "host_id string, _rowid long, v string")
    assert search.case_search({"t": df}, " a ") is None
    assert [r["_rowid"] for r in search.case_search({"t": df}, "a_B").collect()] == [1]


def test_missing_table_is_empty(spark, tmp_path):
    df = raw.read_table(spark, str(tmp_path / "none"), "events")
    assert df.count() == 0 and "EventData" in df.columns


def test_sink_replaces_only_written_hosts(spark, tmp_path):
    path = str(tmp_path / "out")
    first = spark.createDataFrame([("c", "h1", "x", "1"), ("c", "h2", "y", "2")], "case_id string, host_id string, b string, a string")
    raw.write_table(first, path, ["b"])
    raw.write_table(first.filter("host_id = 'h1'").withColumn("a", F.lit("9")), path, ["b"])
    got = spark.read.parquet(path)
    assert got.columns == ["b", "a", "case_id", "host_id"]
    assert sorted((r["host_id"], str(r["a"])) for r in got.collect()) == [("h1", "9"), ("h2", "2")]


def test_inventory_reads_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "SYSTEM").write_bytes(b"same")
    (tmp_path / "a" / "copy").write_bytes(b"same")
    (tmp_path / "a" / "Task").write_bytes("xx<Task".encode("utf-16-le"))
    files = inventory.list_files(spark, str(tmp_path))
    assert files.filter(inventory.with_marker("<Task")).count() == 1
    assert files.filter(inventory.named(["system"])).count() == 1
    assert inventory.dedupe_by_content(files).count() == 2


def test_console_history_counts_blank_lines(spark):
    path = "/C/Users/kim/AppData/Roaming/Microsoft/Windows/PowerShell/PSReadLine/h.txt"
    files = spark.createDataFrame([(path, "one\r\n\rtwo\n"), ("/x/bad", None)], "path string, text string")
    got = documents.console_history(files).collect()
    assert sorted((r["user"], r["line_number"] or 0, r["command"], r["_status"]) for r in got) == [("kim", 1, "one", None), ("kim", 3, "two", None), ("x", 0, None, "unreadable_file")]


def test_report_members_and_plain_values(spark):
    text = "A=1\nF[1]=plain\nF[0].x=a\nF[0].x=b\nF[1].y=c\nF[2].z=1\nF[2]=last\nno key\n =x"
    row = documents.error_reports(spark.createDataFrame([("/r", text)], "path string, text string")).collect()[0]
    assert json.loads(row["report"]) == {"A": "1", "F": [{"x": "b"}, {"y": "c"}, "last"]}


def test_live_rows_and_hidden_mark(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "live"), (4, "deleted")], "i int, _recovery string")
    assert [r["i"] for r in df.filter(raw.is_live()).orderBy("i").collect()] == [1, 3]


def test_inventory_prefixes(spark):
    key = "\\{H}\\Root\\InventoryApplicationFile\\f1"
    rows = [("h", key, "FileId", "0000abcd", 1), ("h", key, "ProgramId", "0006prog", 2), ("h", key, "Size", "0x10", 3), ("h", "\\{H}\\Root\\Programs\\p", "0", "Old name", 4),
            ("h", "\\{H}\\Root\\Other\\p", "Name", "no", 5)]
    df = spark.createDataFrame([(*r, "2024", None) for r in rows], "host_id string, key_path string, value_name string, value_data string, _rowid long, last_write string, _recovery string")
    programs, files = records.inventory_records(df, ["host_id"])
    f = files.collect()[0]
    assert (f["file_id"], f["SHA1"], f["program_id"], f["size"]) == ("abcd", "abcd", "prog", "16")
    assert [p["fields"]["Name"] for p in programs.collect()] == ["Old name"]


def test_content_is_compared_and_searched_as_a_whole(spark):
    edge = b"e" * 65_536
    big = [edge + middle + edge for middle in (b"one" * 9000, b"two" * 9000)]
    late = b"x" * 70_001 + "<Task".encode("utf-16-le")
    rows = [("a", big[0]), ("b", big[1]), ("c", big[0]), ("d", late), ("e", b"\x3c\x54\x61\x73"), ("f", None)]
    files = spark.createDataFrame([(p, c, None if c is None else len(c)) for p, c in rows], "path string, content binary, length long")
    assert sorted(r["path"] for r in inventory.dedupe_by_content(files).collect()) == ["a", "b", "d", "e", "f"]
    assert [r["path"] for r in files.filter(inventory.with_marker("<Task")).collect()] == ["d"]


def test_identity_in_deep_payload(spark):
    sid = "S-1-5-21-1-2-3-1001"
    data = {"TargetUserSid": sid}
    for k in range(12):
        data = {f"level{k}": data}
    path = ".".join(f"level{k}" for k in reversed(range(12)))
    assert evidence(spark, json.dumps(data), sid, "") == [f"[sid] target · {path}.TargetUserSid = {sid}"]


def test_search_is_complete_by_default(spark):
    rows = spark.createDataFrame([("h", i, f"needle {i}") for i in range(800)], "host_id string, _rowid long, text string")
    hits = search.case_search({"t": rows}, "NEEDLE", ["host_id"])
    assert hits.count() == 800 and search.hit_groups(hits, "h", ["host_id"]).collect()[0]["hits"] == 800
    assert search.case_search({"t": rows}, "needle", ["host_id"], per_table=50).count() == 50


def test_pages_by_key_equal_pages_by_offset(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else i % 4) for i in range(60)], "id long, rank long")
    for descending in (False, True):
        order = [F.desc("rank") if descending else F.asc("rank"), F.asc("id")]
        last, seen = None, []
        while True:
            left = rows if last is None else rows.filter(beyond({"rank": descending, "id": False}, last))
            page = [r.asDict() for r in Page(0, 7).apply(left, order).collect()]
            if not page:
                break
            seen += [r["id"] for r in page]
            last = page[-1]
        assert seen == [r["id"] for r in rows.orderBy(*order).collect()]
