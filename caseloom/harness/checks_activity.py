"""Checked queries over browser activity, conversations, tasks, reports and the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import obfuscation, tags, times, urls
from caseloom.functions import lookups
from caseloom.functions import text as tx
from caseloom.functions.core import text
from caseloom.harness import checks_events as ce
from caseloom.harness import checks_registry as cr
from caseloom.harness.registry import check
from caseloom.harness.shapes import kst, shape
from caseloom.operators.filters import ActivityFilter, Page, total_rows
from caseloom.plans import bookmarks as bm
from caseloom.plans import browser, conversations, search, tasks_reports, timeline
from caseloom.sources import documents, raw

KEYS = ["host_id"]
BR_SHAPES = "cache hurls hdown"
DECODE = "url_decode(regexp_replace(replace({0}, '+', '%2B'), '%([^0-9A-Fa-f]|.[^0-9A-Fa-f])', '%25\\1', 'g'))"


def chrome(column: str) -> str:
    return kst(f"CAST({column} AS BIGINT) - 11644473600000000")


def human(expr: str) -> str:
    n = f"CAST({expr} AS BIGINT)"
    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f KB', {n} / 1024.0) WHEN {n} < 1073741824 THEN printf('%.1f MB', {n} / 1048576.0) ELSE printf('%.1f GB', {n} / 1073741824.0) END"


ACT_SQL = f"""
dl AS (SELECT *, coalesce(nullif(target_path, ''), current_path) AS tgt, coalesce(nullif(tab_url, ''), referrer) AS src, coalesce(nullif(total_bytes, ''), received_bytes) AS amount FROM hdown),
act AS (SELECT host_id, account, 'cache' AS kind, coalesce(nullif(response_time, ''), nullif(creation_time, '')) AS timestamp, coalesce(nullif(split_part(url, '/', -1), ''), url) AS title, url, CAST(NULL AS STRING) AS url_raw, CAST(NULL AS STRING) AS visit_count,
    CAST(NULL AS STRING) AS detail, coalesce(nullif(content_length, ''), body_size) AS size, CAST(NULL AS STRING) AS danger, cache_key, CASE WHEN body_b64 <> '' THEN '1' END AS cache_body_recovered, _source_file, _rowid FROM cache WHERE coalesce(nullif(response_time, ''), nullif(creation_time, '')) IS NOT NULL
  UNION ALL SELECT host_id, account, 'visit', {chrome('last_visit_time')}, title, CASE WHEN contains(url, '%') THEN {DECODE.format('url')} ELSE url END, url, nullif(visit_count, '0'), NULL, NULL, NULL, NULL, NULL, _source_file, _rowid FROM hurls
  UNION ALL SELECT host_id, account, 'download', {chrome('start_time')}, split_part({DECODE.format('tgt')}, chr(92), -1), src, src, NULL, {DECODE.format('tgt')}, {human('amount')}, danger_type, NULL, NULL, _source_file, _rowid FROM dl)"""
ACT_COLUMNS = ["host_id", "account", "kind", "timestamp", "title", "url", "url_raw", "visit_count", "detail", "size", "danger", "cache_key", "cache_body_recovered", "_source_file", "_rowid"]


def act(spark, sf):
    return browser.browser_activity(shape(spark, sf, "cache"), shape(spark, sf, "hurls"), shape(spark, sf, "hdown"))


@check("c5_browser_activity", BR_SHAPES, ACT_SQL + " SELECT * FROM act")
def _(spark, sf):
    return act(spark, sf).select(*ACT_COLUMNS)


@check("a5_activity_summary", BR_SHAPES, ACT_SQL + """
SELECT 'total' AS part, CAST(NULL AS STRING) AS value, count(*) AS count FROM act WHERE timestamp >= '2024-01-01 10:00:00.000' UNION ALL SELECT 'account', account, count(*) FROM act WHERE timestamp >= '2024-01-01 10:00:00.000' GROUP BY 2
UNION ALL SELECT 'day', left(timestamp, 10), count(*) FROM act WHERE timestamp >= '2024-01-01 10:00:00.000' GROUP BY 2""")
def _(spark, sf):
    return browser.summary(act(spark, sf), ActivityFilter(start="2024-01-01 10:00:00.000"))


DOMAIN_SQL = ACT_SQL + """,
per_url AS (SELECT url, min(_rowid) AS r, coalesce(sum(CAST(visit_count AS BIGINT)), 0) AS v FROM act WHERE kind = 'visit' GROUP BY 1),
dom AS (SELECT regexp_replace(regexp_replace(regexp_replace(lower(split_part(split_part(split_part(split_part(url, '/', 3), '?', 1), '#', 1), chr(92), 1)), '^.*[@]', ''), ':\\d*$', ''), '\\.+$', '') AS domain, min(r) AS row_id, CAST(sum(v) AS BIGINT) AS visit_count, count(*) AS url_count FROM per_url GROUP BY 1)"""


@check("a6_domain_stats", BR_SHAPES, DOMAIN_SQL + " SELECT * FROM dom")
def _(spark, sf):
    return browser.visited_domains(act(spark, sf))


@check("a7_activity_insights", BR_SHAPES, DOMAIN_SQL + """
SELECT 'visits' AS part, CAST(NULL AS STRING) AS name, CAST(coalesce(sum(visit_count), 0) AS BIGINT) AS value FROM dom UNION ALL SELECT 'domain', domain, visit_count FROM (SELECT * FROM dom ORDER BY visit_count DESC, domain LIMIT 8)
UNION ALL SELECT 'downloads', NULL, count(*) FROM act WHERE kind = 'download' UNION ALL SELECT 'download', timestamp, _rowid FROM (SELECT * FROM act WHERE kind = 'download' ORDER BY timestamp DESC, _rowid LIMIT 8)""")
def _(spark, sf):
    cards = browser.insights(act(spark, sf))
    part = lambda df, name, label, value: df.select(F.lit(name).alias("part"), label.cast("string").alias("name"), value.cast("bigint").alias("value"))
    return (
        part(cards["visit_total"], "visits", F.lit(None), F.col("visit_total"))
        .unionByName(part(cards["top_domains"], "domain", F.col("domain"), F.col("visit_count")))
        .unionByName(part(cards["download_total"], "downloads", F.lit(None), F.col("download_total")))
        .unionByName(part(cards["downloads"], "download", F.col("timestamp"), F.col("_rowid")))
    )


@check("p11_activity_filter", BR_SHAPES, ACT_SQL + " SELECT kind, _rowid FROM act WHERE account = 'acct2' AND kind IN ('visit', 'download') AND left(timestamp, 10) = '2024-01-01' AND (lower(coalesce(url, '')) LIKE '%example%org%' OR lower(coalesce(title, '')) LIKE '%example%org%' OR lower(coalesce(url_raw, '')) LIKE '%example%org%')")
def _(spark, sf):
    where = ActivityFilter(account="acct2", kinds=("visit", "download"), day="2024-01-01", search="example%ORG")
    return act(spark, sf).filter(where.condition()).select("kind", "_rowid")


@check("o2_activity_page", BR_SHAPES, ACT_SQL + " SELECT kind, _rowid, timestamp FROM act WHERE kind IN ('visit', 'cache') ORDER BY timestamp DESC, _source_file, _rowid LIMIT 25 OFFSET 30")
def _(spark, sf):
    page = browser.activity_page(act(spark, sf), ActivityFilter(kinds=("visit", "cache")), Page(30, 25), descending=True)
    return page.select("kind", "_rowid", "timestamp")


@check("o4_latest_rows", BR_SHAPES, ACT_SQL + " SELECT kind, _rowid, timestamp FROM act ORDER BY timestamp DESC, kind, _rowid LIMIT 15")
def _(spark, sf):
    return act(spark, sf).orderBy(F.desc("timestamp"), "kind", "_rowid").limit(15).select("kind", "_rowid", "timestamp")


def _with_total(page, total):
    """The one-row total next to every row of a page."""
    return page.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").drop("one")


@check("q8_domain_page", BR_SHAPES, DOMAIN_SQL + " SELECT domain, visit_count, (SELECT count(*) FROM dom) AS total FROM (SELECT * FROM dom ORDER BY visit_count DESC, domain LIMIT 10 OFFSET 5)")
def _(spark, sf):
    domains = browser.visited_domains(act(spark, sf))
    return _with_total(Page(5, 10, 100).apply(domains, browser.domain_order()).select("domain", "visit_count"), total_rows(domains, "total"))


@check("q9_assistant_referrals", BR_SHAPES, ACT_SQL.replace("FROM hurls\n", "FROM (SELECT * REPLACE (url || CASE WHEN _rowid % 10 < 3 THEN '?utm_source=' || CASE _rowid % 3 WHEN 0 THEN 'ChatGPT.com' WHEN 1 THEN 'gemini' ELSE 'other' END ELSE '' END AS url) FROM hurls)\n") + """
SELECT _rowid, url FROM act WHERE contains(lower(url), 'utm_source=chatgpt.com') OR contains(lower(url), 'utm_source=gemini') OR contains(lower(url), 'utm_source=claude')""")
def _(spark, sf):
    mark = F.when(F.col("_rowid") % 3 == 0, "ChatGPT.com").when(F.col("_rowid") % 3 == 1, "gemini").otherwise("other")
    visits = shape(spark, sf, "hurls").withColumn("url", F.concat("url", F.when(F.col("_rowid") % 10 < 3, F.concat(F.lit("?utm_source="), mark)).otherwise("")))
    rows = browser.browser_activity(shape(spark, sf, "cache"), visits, shape(spark, sf, "hdown"))
    return browser.assistant_referrals(rows).select("_rowid", "url")


@check("q12_cache_list", "cache", "SELECT account, url, response_time, body_size, cache_key FROM cache WHERE body_b64 <> ''")
def _(spark, sf):
    return browser.cache_list(shape(spark, sf, "cache")).select("account", "url", "response_time", "body_size", "cache_key")


@check("q13_body_preview", "cache", "SELECT host_id, account, url, cache_key, md5(left(body_b64, 786432)) AS body, (length(body_b64) // 4) * 3 - (length(body_b64) - length(rtrim(body_b64, '='))) AS decoded_size, length(body_b64) > 786432 AS truncated FROM cache WHERE body_b64 <> ''")
def _(spark, sf):
    cache = shape(spark, sf, "cache")
    asked = cache.select("host_id", "account", "url", "cache_key").unionByName(cache.select("host_id", "account", "url", F.lit(" ").alias("cache_key")))
    return browser.body_preview(cache, asked).withColumn("body", F.md5("body_b64")).drop("body_b64")


@check("f42_decoded_size", "cache", "SELECT _rowid, CASE WHEN body_b64 = '' THEN 0 ELSE octet_length(from_base64(body_b64)) END AS size FROM cache")
def _(spark, sf):
    body = F.col("body_b64")
    return shape(spark, sf, "cache").select("_rowid", urls.base64_decoded_size(F.length(body).cast("bigint"), F.right(body, F.lit(2))).cast("bigint").alias("size"))


@check("f8_url_decode", "hurls", f"SELECT _rowid, CASE WHEN contains(url, '%') THEN {DECODE.format('url')} ELSE url END AS decoded FROM hurls")
def _(spark, sf):
    return shape(spark, sf, "hurls").select("_rowid", urls.url_decode("url").alias("decoded"))


@check("f48_cache_keys", "cache", "SELECT _rowid, substr(cache_key, 5) AS url, CASE WHEN regexp_matches(lower(split_part(split_part(url, '?', 1), '#', 1)), '\\.html?$') THEN 'text/html' END AS guessed FROM cache")
def _(spark, sf):
    return shape(spark, sf, "cache").select("_rowid", urls.url_from_key("cache_key").alias("url"), urls.content_type_of(F.lit(""), F.col("url")).alias("guessed"))


@check("f47_response_headers", "cache", "SELECT _rowid, '200 OK' AS status, 'text/html' AS content_type, @n(length(url)) AS x_len FROM cache")
def _(spark, sf):
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: image/png\r\nX-Len: "), F.length("url").cast("string"), F.lit("\r\nno colon\r\nCONTENT-TYPE: text/html"))
    parsed = urls.response_headers(head)
    return shape(spark, sf, "cache").select(
        "_rowid", parsed["status"].alias("status"), parsed["headers"]["content-type"].alias("content_type"), parsed["headers"]["x-len"].alias("x_len"))


@check("s23_source_accounts", "links cache", """
SELECT 'link' AS source, _rowid, regexp_extract(_source_file, '/(?:LNK|JumpList)/([^/]*)', 1) AS account FROM links UNION ALL SELECT 'browser', _rowid, regexp_extract(_source_file, '/BROWSER/([^/]*)', 1) FROM cache
UNION ALL SELECT 'bitmap', _rowid, CASE WHEN _rowid % 2 = 0 THEN 'u' || _rowid ELSE 'v' || _rowid END FROM cache""".strip())
def _(spark, sf):
    links = shape(spark, sf, "links").select(F.lit("link").alias("source"), "_rowid", tx.link_account("_source_file").alias("account"))
    cache = shape(spark, sf, "cache")
    own = cache.select(F.lit("browser").alias("source"), "_rowid", tx.browser_account("_source_file").alias("account"))
    path = F.when(F.col("_rowid") % 2 == 0, F.concat(F.lit("/c/rdp_cache/u"), "_rowid", F.lit("/Cache/Cache0000.bin"))).otherwise(F.concat(F.lit("/x/v"), "_rowid", F.lit("/Cache/a.bin")))
    tile = cache.select(F.lit("bitmap").alias("source"), "_rowid", tx.bitmap_account(path).alias("account"))
    return links.unionByName(own).unionByName(tile)


@check("s24_file_name_accounts", "cache hurls", "SELECT _rowid, account FROM cache UNION ALL SELECT _rowid, account FROM hurls")
def _(spark, sf):
    cached = shape(spark, sf, "cache").select("_rowid", tx.account_from_stem(tx.last_segment("_source_file"), "_Chrome_Cache").alias("account"))
    visited = shape(spark, sf, "hurls").select("_rowid", tx.account_from_stem(tx.last_segment("_source_file"), "_Chrome_History").alias("account"))
    return cached.unionByName(visited)


@check("s25_foreign_tables", "hurls hdown", "SELECT 'urls' AS table_name, count(*) AS rows, count(nullif(_rowid, '')) AS present FROM (SELECT @n(_rowid) AS _rowid FROM hurls) UNION ALL SELECT 'downloads', count(*), count(total_bytes) FROM hdown")
def _(spark, sf):
    tables = raw.foreign_tables({"urls": shape(spark, sf, "hurls"), "downloads": shape(spark, sf, "hdown"), "sqlite_sequence": shape(spark, sf, "cache")})
    rows = lambda name, column: tables[name].agg(F.count(F.lit(1)).alias("rows"), F.count(column).alias("present")).select(F.lit(name).alias("table_name"), "rows", "present")
    return rows("urls", "_rowid").unionByName(rows("downloads", "total_bytes"))


# Conversations --------------------------------------------------------------------------------------------------------

AI_SQL = f"""
ai0 AS (SELECT *, regexp_replace(decode(from_base64(body_b64)), '^[)\\]''\\n\\r ]+', '') AS j, coalesce(nullif(response_time, ''), nullif(request_time, '')) AS date FROM ai WHERE body_b64 <> '' AND contains(content_type, 'json') AND NOT contains(url, 'news.example.com') AND NOT contains(url, '/stream_status')),
conv AS (SELECT host_id, account, url, date, _source_file, _rowid, CASE WHEN contains(url, 'chatgpt') THEN 'ChatGPT' WHEN contains(url, 'claude') THEN 'Claude' ELSE 'Gemini' END AS provider, coalesce(json_extract_string(j, '$.title'), json_extract_string(j, '$.name')) AS title,
  coalesce(json_extract_string(j, '$.create_time'), json_extract_string(j, '$.created_at')) AS created_at, coalesce(json_extract_string(j, '$.update_time'), json_extract_string(j, '$.updated_at')) AS updated_at, j FROM ai0)"""


def conv(spark, sf):
    return conversations.conversations(shape(spark, sf, "ai"))


@check("q10_conversations", "ai", AI_SQL + " SELECT host_id, _rowid, provider, account, title, date, created_at, updated_at, url FROM conv")
def _(spark, sf):
    return conv(spark, sf).select("host_id", "_rowid", "provider", "account", "title", "date", "created_at", "updated_at", "url")


@check("q11_conversation_messages", "ai", AI_SQL + f"""
SELECT _rowid, 0 AS position, 'system' AS role, 'start' AS text, '2024-01-01 09:00:00.000' AS time FROM conv WHERE provider = 'ChatGPT'
UNION ALL SELECT _rowid, 1, json_extract_string(j, '$.mapping.n1.message.author.role'), json_extract_string(j, '$.mapping.n1.message.content.parts[0]') || chr(10) || 'tail', {kst("CAST(json_extract_string(j, '$.mapping.n1.message.create_time') AS BIGINT) * 1000000")} FROM conv WHERE provider = 'ChatGPT'
UNION ALL SELECT _rowid, 0, json_extract_string(j, '$.chat_messages[0].sender'), json_extract_string(j, '$.chat_messages[0].text'), '2024-01-02 03:04:05.000' FROM conv WHERE provider = 'Claude'
UNION ALL SELECT _rowid, 1, 'assistant', 'a' || chr(10) || 'b', NULL FROM conv WHERE provider = 'Claude'
UNION ALL SELECT _rowid, 0, json_extract_string(j, '$.messages[0].author.role'), json_extract_string(j, '$.messages[0].content'), NULL FROM conv WHERE provider = 'Gemini'
UNION ALL SELECT _rowid, 1, '?', 'x' || chr(10) || 'y', NULL FROM conv WHERE provider = 'Gemini'""")
def _(spark, sf):
    return conversations.messages(conv(spark, sf), ["_rowid"])


@check("f43_payload_times", "ai", AI_SQL + f"""
SELECT _rowid, CASE provider WHEN 'ChatGPT' THEN {kst('CAST(CAST(created_at AS DOUBLE) * 1000 AS BIGINT) * 1000')} WHEN 'Claude' THEN '2024-01-02 12:04:05.678' END AS created,
  CASE provider WHEN 'Claude' THEN '2024-01-02 03:04:05.000' WHEN 'Gemini' THEN '2024-01-01 09:00:00.000' END AS updated FROM conv""")
def _(spark, sf):
    return conv(spark, sf).select("_rowid", times.payload_time("created_at").alias("created"), times.payload_time("updated_at").alias("updated"))


@check("f44_conversation_endpoints", "ai", "SELECT _rowid, CASE WHEN contains(url, 'https://chatgpt.com') THEN 'ChatGPT' WHEN contains(url, 'https://claude.ai') THEN 'Claude' WHEN contains(url, 'https://gemini') THEN 'Gemini' END AS provider FROM ai")
def _(spark, sf):
    return shape(spark, sf, "ai").select("_rowid", conversations.provider("url").alias("provider"))


@check("f38_decoded_scripts", "ai", """
SELECT _rowid, octet_length(b) AS bytes, CASE WHEN octet_length(b) % 2 = 0 THEN 'UTF-16LE' ELSE 'UTF-8' END AS encoding, CASE WHEN octet_length(b) % 2 = 1 THEN decode(b)
  ELSE array_to_string(list_transform(range(1, len(hex(b)), 4), lambda i: chr(('0x' || substr(hex(b), i::INT + 2, 2) || substr(hex(b), i::INT, 2))::INT)), '') END AS output
FROM (SELECT _rowid, from_base64(body_b64) AS b FROM ai WHERE body_b64 <> '')""")
def _(spark, sf):
    """Every pair of bytes of these bodies is some character, so an even number of bytes is a tie, which UTF-16LE wins."""
    rows = shape(spark, sf, "ai").filter("body_b64 <> ''").withColumn("d", obfuscation.decode_base64("body_b64"))
    return rows.select("_rowid", F.col("d.bytes").cast("bigint").alias("bytes"), "d.encoding", "d.output")


# Tasks and reports ----------------------------------------------------------------------------------------------------

TASK_SQL = f"""
tk AS (SELECT *, lower(uri) LIKE '\\microsoft\\%' OR contains(lower(author), 'microsoft') AS vendor, CASE WHEN lower(enabled) IN ('true', '1') THEN true WHEN lower(enabled) IN ('false', 'disabled') THEN false END AS is_enabled, lower(hidden) = 'true' AS is_hidden, {cr.path_tags('actions')} AS tags FROM tasks),
tr AS (SELECT *, is_hidden OR tags <> '' AS review FROM tk)"""


def reviewed_tasks(spark, sf):
    return tasks_reports.task_review(tasks_reports.task_overview(shape(spark, sf, "tasks"), KEYS))


@check("c9_scheduled_tasks", "tasks", TASK_SQL + " SELECT host_id, timestamp, task_name, CASE WHEN vendor THEN '1' END AS is_microsoft, actions, author, uri FROM tk")
def _(spark, sf):
    return tasks_reports.task_overview(shape(spark, sf, "tasks"), KEYS).select("host_id", "timestamp", "task_name", "is_microsoft", "actions", "author", "uri")


@check("p1_vendor_flag", "tasks", TASK_SQL + " SELECT task_name, uri, CASE WHEN vendor THEN '1' END AS is_microsoft FROM tk")
def _(spark, sf):
    return tasks_reports.task_overview(shape(spark, sf, "tasks"), KEYS).select("task_name", "uri", "is_microsoft")


@check("q18_task_review", "tasks", TASK_SQL + " SELECT task_name, vendor, is_enabled, is_hidden, tags, review FROM tr")
def _(spark, sf):
    return reviewed_tasks(spark, sf).select("task_name", "vendor", "is_enabled", "is_hidden", tags.tag_codes(F.col("tags")).alias("tags"), "review")


@check("p18_task_filter", "tasks", TASK_SQL + " SELECT task_name FROM tr WHERE review AND (contains(lower(task_name), 'x.exe') OR contains(lower(actions), 'x.exe')) AND timestamp >= '2024-01-01 10:00:00.000'")
def _(spark, sf):
    return tasks_reports.task_filter(reviewed_tasks(spark, sf), "review", "X.EXE", start="2024-01-01 10:00").select("task_name")


@check("o6_task_order", "tasks", TASK_SQL + " SELECT task_name FROM tr ORDER BY review DESC, vendor, task_name LIMIT 12")
def _(spark, sf):
    return reviewed_tasks(spark, sf).orderBy(*tasks_reports.task_order()).limit(12).select("task_name")


@check("a11_task_counts", "tasks", TASK_SQL + " SELECT host_id, count(*) AS total, count(*) FILTER (NOT vendor) AS user_tasks, count(*) FILTER (review) AS review_tasks, count(*) FILTER (is_hidden) AS hidden_tasks FROM tr GROUP BY 1")
def _(spark, sf):
    return tasks_reports.task_counts(reviewed_tasks(spark, sf), KEYS)


@check("p9_tab_and_tagged", "tasks", TASK_SQL + " SELECT task_name FROM tr WHERE coalesce(enabled, '') = 'true' AND tags <> ''")
def _(spark, sf):
    return reviewed_tasks(spark, sf).filter((text("enabled") == "true") & (F.size("tags") > 0)).select("task_name")


@check("s13_task_files", "xml", """
SELECT host_id, path AS _source_file, CASE WHEN bad THEN NULL ELSE CASE k % 3 WHEN 0 THEN '2024-0' || (1 + k % 9) || '-01 19:00:00.000' WHEN 1 THEN '2024-0' || (1 + k % 9) || '-01 18:00:00.000' ELSE '2024-0' || (1 + k % 9) || '-01 10:00:00.000' END END AS timestamp,
  CASE WHEN bad OR k % 4 = 0 THEN split_part(path, '/', -1) ELSE 'Job' || k END AS task_name, CASE WHEN NOT bad THEN CASE WHEN k % 2 = 0 THEN 'S-1-5-18' ELSE 'G1' END END AS run_as, CASE WHEN NOT bad THEN 'cmd' || k || '.exe /c a < b | COM:{C' || k || '}' END AS actions,
  CASE WHEN NOT bad THEN 'TimeTrigger, LogonTrigger' END AS trigger_types, CASE WHEN NOT bad THEN '2024-01-01 00:00:0' || (k % 10) || '.000' END AS trigger_start, CASE WHEN NOT bad THEN 'A & B' END AS author, CASE WHEN bad THEN 'corrupted' ELSE 'ok' END AS _status
FROM (SELECT *, k % 33 = 5 AS bad FROM xml)""")
def _(spark, sf):
    tasks = documents.scheduled_tasks(shape(spark, sf, "xml").drop("k"))
    return tasks.select("host_id", "_source_file", "timestamp", "task_name", "run_as", "actions", "trigger_types", "trigger_start", "author", "_status")


WER_SQL = f"""
w0 AS (SELECT *, CASE k % 4 WHEN 0 THEN 'APPCRASH' WHEN 1 THEN 'AppHangB1' WHEN 2 THEN 'BEX64' ELSE 'RADAR' END AS et, regexp_extract(text, 'Sig\\[0\\]\\.Value=([^\\n]*)', 1) AS st, nullif(regexp_extract(text, 'AppPath=([^\\n]*)', 1), '') AS ap, nullif(regexp_extract(text, 'AppName=([^\\n]*)', 1), '') AS an, {kst('13300000000000000 + k * 60000000 - 11644473600000000')} AS ts FROM wer),
rep AS (SELECT host_id, path AS _source_file, ts AS timestamp, et AS "EventType", an AS "AppName", ap AS "AppPath", '{{"Version": "2", "EventType": "' || et || '", "EventTime": "' || (133000000000000000 + k * 600000000) || '", ' || CASE WHEN ap IS NULL THEN '"AppName": "' || an ELSE '"AppPath": "' || replace(ap, chr(92), chr(92) || chr(92)) END
  || '", "Sig": [{{"Name": "a' || chr(92) || '"q", "Value": "' || st || '"}}, {{"Name": "b", "Value": "2"}}], "LoadedModule": ["ntdll.dll", "k=v.dll"]}}' AS report FROM w0)"""


@check("s12_error_reports", "wer", WER_SQL + """ SELECT * FROM rep""")
def _(spark, sf):
    reports = documents.error_reports(shape(spark, sf, "wer").drop("k"))
    return reports.select("host_id", "_source_file", "timestamp", "EventType", "AppName", "AppPath", "report")


@check("q20_report_review", "wer", WER_SQL + """ SELECT _source_file, coalesce("AppName", split_part("AppPath", chr(92), -1)) AS app_name, "AppPath" AS app_path, "EventType" AS event_type, CASE WHEN "EventType" = 'AppHangB1' THEN 'warning' WHEN "EventType" IN ('APPCRASH', 'BEX64') THEN 'danger' ELSE 'neutral' END AS tone FROM rep""")
def _(spark, sf):
    rows = tasks_reports.report_review(documents.error_reports(shape(spark, sf, "wer").drop("k")))
    return rows.select("_source_file", "app_name", "app_path", "event_type", "tone")


@check("p19_report_filter", "wer", WER_SQL + """ SELECT _source_file FROM rep WHERE "EventType" = 'BEX64' AND (contains(lower(coalesce("AppName", split_part("AppPath", chr(92), -1))), 'app12') OR contains(lower(coalesce("AppPath", '')), 'app12'))""")
def _(spark, sf):
    rows = tasks_reports.report_review(documents.error_reports(shape(spark, sf, "wer").drop("k")))
    return tasks_reports.report_filter(rows, "BEX64", "APP12").select("_source_file")


@check("f36_report_events", "wer", WER_SQL + """ SELECT _source_file, ap AS app_path, 'bad · ' || st AS reason FROM (SELECT path AS _source_file, ap, st FROM w0)""")
def _(spark, sf):
    rows = documents.error_reports(shape(spark, sf, "wer").drop("k"))
    state = F.get_json_object("report", "$.Sig[0].Value")
    payload = F.to_json(F.struct(F.lit("C:\\ProgramData\\WER\\x.exe").alias("P1"), F.col("AppPath").alias("P2"), F.lit("bad").alias("P3"), state.alias("P4"), F.lit("not available").alias("Response")))
    return rows.withColumn("e", payload).select("_source_file", tags.report_app_path("e").alias("app_path"), tags.report_reason("e").alias("reason"))


@check("s11_console_history", "console", """
SELECT path AS _source_file, 'user' || regexp_extract(path, 'user(\\d+)', 1) AS user, line_number, command FROM (SELECT path, unnest(lines) AS command, generate_subscripts(lines, 1) AS line_number FROM (SELECT path, string_split_regex(text, '\\r\\n|\\r|\\n') AS lines FROM console)) WHERE command <> ''""")
def _(spark, sf):
    return documents.console_history(shape(spark, sf, "console").drop("host_id")).select("_source_file", "user", "line_number", "command")


@check("f35_privileges", "ev", """
SELECT _rowid, p AS privilege, CASE p WHEN 'SeDebugPrivilege' THEN 'debug programs' ELSE 'back up files and directories' END AS privilege_text FROM (SELECT _rowid, unnest(['SeDebugPrivilege', 'SeBackupPrivilege'][1 : 1 + CAST(_rowid % 2 AS BIGINT)]) AS p FROM ev)""")
def _(spark, sf):
    rows = shape(spark, sf, "ev").select("_rowid", F.when(F.col("_rowid") % 2 == 0, "SeDebugPrivilege\n\t\tBadToken, Se1Privilege").otherwise("SeDebugPrivilege, SeBackupPrivilege").alias("raw"))
    each = rows.select("_rowid", F.explode(lookups.privilege_names("raw")).alias("privilege"))
    return each.join(F.broadcast(lookups.privileges_table(spark)), "privilege").select("_rowid", "privilege", "privilege_text")


# Timeline -------------------------------------------------------------------------------------------------------------

TL_SHAPES = "ev tasks links " + BR_SHAPES + " " + cr.EXEC_SHAPES
TL_SQL = cr.EXEC_SQL + "," + ACT_SQL + f""",
tl AS (SELECT host_id, timestamp, '_OVERVIEW' AS category, 'ExecutionHistory' AS table_name, CASE WHEN source_artifact LIKE 'Amcache%' THEN 'amcache' ELSE lower(source_artifact) END AS facet, program_name AS title,
    concat_ws(',', nullif({cr.path_tags('program_path')}, ''), CASE WHEN source_artifact LIKE 'Amcache%' AND trim(coalesce(publisher, '')) = '' THEN 'publisher_missing' END) AS tags FROM exec WHERE timestamp IS NOT NULL
  UNION ALL SELECT host_id, timestamp, '_OVERVIEW', 'ScheduledTasks', NULL, task_name, {cr.path_tags('actions')} FROM tasks WHERE timestamp IS NOT NULL
  UNION ALL SELECT host_id, timestamp, '_OVERVIEW', 'BrowserActivity', kind, url, concat_ws(',', CASE danger WHEN '1' THEN 'dangerous_file' WHEN '2' THEN 'dangerous_url' WHEN '3' THEN 'dangerous_content' WHEN '4' THEN 'maybe_dangerous_content' WHEN '7' THEN 'dangerous_host' WHEN '8' THEN 'potentially_unwanted' END,
    CASE WHEN kind = 'download' THEN nullif({cr.path_tags('detail')}, '') END) FROM act WHERE kind IN ('visit', 'download')
  UNION ALL SELECT host_id, timestamp, 'EVENTLOG', log, NULL, NULL, CASE LevelName WHEN 'Critical' THEN 'critical_event' WHEN 'Error' THEN 'error_event' ELSE '' END FROM ev
  UNION ALL SELECT host_id, timestamp, 'JUMPLIST', 'JumpList_Entries', NULL, regexp_extract(target_path, '[^\\\\/]*$'), {cr.path_tags('target_path')} FROM links)"""


def tl(spark, sf):
    return timeline.master_timeline(
        execution=cr.history(spark, sf), tasks=shape(spark, sf, "tasks"), activity=act(spark, sf), events=shape(spark, sf, "ev"), links=shape(spark, sf, "links"))


@check("q1_master_timeline", TL_SHAPES, TL_SQL + " SELECT host_id, timestamp, category, table_name, facet, title, CASE WHEN category <> 'EVENTLOG' THEN tags END AS tags FROM tl")
def _(spark, sf):
    own = F.col("category") != "EVENTLOG"
    return tl(spark, sf).select("host_id", "timestamp", "category", "table_name", "facet", F.when(own, F.col("title")).alias("title"), F.when(own, tags.tag_codes(F.col("tags"))).alias("tags"))


@check("o1_timeline_order", TL_SHAPES, TL_SQL + " SELECT timestamp FROM tl ORDER BY timestamp LIMIT 50")
def _(spark, sf):
    return tl(spark, sf).orderBy(*timeline.timeline_order()).limit(50).select("timestamp")


@check("q2_timeline_filter", TL_SHAPES, TL_SQL + " SELECT host_id, timestamp, table_name, title FROM tl WHERE category <> 'EVENTLOG' AND table_name <> 'ScheduledTasks' AND NOT (table_name = 'ExecutionHistory' AND facet = 'srum') AND NOT (table_name = 'BrowserActivity' AND facet = 'visit') AND tags <> '' AND timestamp >= '2024-01-01 00:00:00.000' AND timestamp <= '2024-03-31 23:59:59.999'")
def _(spark, sf):
    rows = timeline.filter_timeline(tl(spark, sf), ("ScheduledTasks",), ("srum",), ("visit",), True, "2024-01-01", "2024-03-31")
    return rows.filter("category <> 'EVENTLOG'").select("host_id", "timestamp", "table_name", "title")


@check("a10_timeline_facets", TL_SHAPES, TL_SQL + " SELECT host_id, category, table_name, facet, count(*) AS rows FROM tl GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return timeline.facet_counts(tl(spark, sf))


@check("p13_timeline_admission", "ev " + BR_SHAPES, ACT_SQL + " SELECT host_id, 'BrowserActivity' AS table_name, timestamp, coalesce(nullif(url, ''), nullif(url_raw, ''), nullif(title, ''), '(no address)') AS url FROM act WHERE kind IN ('visit', 'download') UNION ALL SELECT host_id, log, timestamp, NULL FROM ev WHERE _rowid % 9 <> 0")
def _(spark, sf):
    heartbeat = shape(spark, sf, "ev").withColumn("EventID", F.when(F.col("_rowid") % 9 == 0, " 0").otherwise(F.coalesce("EventID", F.lit(""))))
    shown = lambda df, url: df.select("host_id", "table_name", "timestamp", url.alias("url"))
    return shown(timeline.browser_entries(act(spark, sf)), F.col("title")).unionByName(shown(timeline.event_entries(heartbeat), F.lit(None).cast("string")))


@check("q23_time_points", "links", """
p AS (SELECT _rowid, unnest([{'label': 'access', 'v': timestamp}, {'label': 'created', 'v': created_time}, {'label': 'modified', 'v': nullif(modified_time, '')}], recursive := true) FROM links),
o AS (SELECT _rowid, label, v AS value, epoch_ms(CAST(v AS TIMESTAMP)) AS ms FROM p WHERE v IS NOT NULL)
SELECT _rowid, CAST(row_number() OVER (PARTITION BY _rowid ORDER BY ms, label) - 1 AS INT) AS position, label, value, round((ms - min(ms) OVER (PARTITION BY _rowid)) * 100.0 / greatest(max(ms) OVER (PARTITION BY _rowid) - min(ms) OVER (PARTITION BY _rowid), 1), 3) AS percent FROM o""")
def _(spark, sf):
    points = {"timestamp": "access", "created_time": "created", "modified_time": "modified"}
    return timeline.time_points(shape(spark, sf, "links"), ["_rowid"], points)


@check("a17_evidence_summary", "ev tasks", """
SELECT artifact, tables, rows, status FROM (SELECT 'EventLog' AS artifact, count(DISTINCT log) AS tables, count(*) AS rows FROM ev UNION ALL SELECT 'ScheduledTasks', 1, count(*) FROM tasks) JOIN (VALUES ('EventLog', 'ok'), ('ScheduledTasks', 'ok')) s(a, status) ON artifact = a UNION ALL SELECT 'SRUM', 0, 0, 'missing'""")
def _(spark, sf):
    ev = shape(spark, sf, "ev").groupBy(F.lit("EventLog").alias("artifact"), "log").agg(F.count(F.lit(1)).alias("n"))
    tasks = shape(spark, sf, "tasks").groupBy(F.lit("ScheduledTasks").alias("artifact"), F.lit("tasks").alias("log")).agg(F.count(F.lit(1)).alias("n"))
    counts = ev.unionByName(tasks).groupBy("artifact").agg(F.count(F.lit(1)).alias("tables"), F.sum("n").alias("rows"))
    saved = spark.sql("SELECT * FROM VALUES ('EventLog', 'ok'), ('ScheduledTasks', 'ok'), ('SRUM', 'missing') AS t(artifact, status)")
    joined = saved.join(counts, "artifact", "left")
    return joined.select("artifact", F.coalesce("tables", F.lit(0)).alias("tables"), F.coalesce("rows", F.lit(0)).alias("rows"), "status")


# Search and bookmarks -------------------------------------------------------------------------------------------------

SEARCH_SQL = """
h AS (SELECT 'events' AS table_name, CAST(event_id AS BIGINT) AS _rowid, 'event_type' AS match_column, row_number() OVER (ORDER BY event_id) AS rn FROM events WHERE contains(lower(event_type), 'urc')
  UNION ALL SELECT 'part', p_partkey, 'p_name', row_number() OVER (ORDER BY p_partkey) FROM part WHERE contains(lower(p_name), 'urc')
  UNION ALL SELECT 'documents', doc_id, CASE WHEN contains(lower(text), 'urc') THEN 'text' ELSE 'source' END, row_number() OVER (ORDER BY doc_id) FROM documents WHERE contains(lower(text), 'urc') OR contains(lower(source), 'urc'))"""


def search_tables(spark, sf):
    read = lambda name, key: spark.read.parquet(f"{sf}/{name}.parquet").withColumn("host_id", F.lit("host0")).withColumn("_rowid", F.col(key).cast("bigint"))
    docs = read("documents", "doc_id").select("host_id", "_rowid", "text", "source")
    return {"events": read("events", "event_id").select("host_id", "_rowid", "event_type", "props"), "part": read("part", "p_partkey").select("host_id", "_rowid", "p_name"), "documents": docs}


def search_hits(spark, sf):
    return search.case_search(search_tables(spark, sf), " URC ")


@check("q14_case_search", "", SEARCH_SQL.strip() + " SELECT table_name, _rowid, match_column FROM h")
def _(spark, sf):
    return search_hits(spark, sf).select("table_name", "_rowid", "match_column")


@check("a15_hit_groups", "", SEARCH_SQL.strip() + " SELECT 'host0' AS host_id, table_name, count(*) AS hits, true AS is_current FROM h GROUP BY 2")
def _(spark, sf):
    return search.hit_groups(search_hits(spark, sf), "host0")


@check("p12_literal_search", "xml", "SELECT k FROM xml WHERE contains(lower(text), '&lt; b</arguments>')")
def _(spark, sf):
    return shape(spark, sf, "xml").filter(tx.contains_folded("text", "&LT; b</Arguments>")).select("k")


MARK_SQL = """
src AS (SELECT host_id, 'Events' AS tableName, _rowid AS rowid, timestamp, CASE WHEN contains(EventData, 'IpAddress') THEN nullif(json_extract_string(EventData, '$.IpAddress'), '') END AS remote_address FROM ev UNION ALL SELECT host_id, 'Tasks', _rowid, timestamp, NULL FROM tasks),
mk AS (SELECT m.id, m.host_id, m.tableName, m.rowid, m.taggedAt, s.timestamp AS event_time, s.remote_address FROM marks m LEFT JOIN src s ON s.host_id = m.host_id AND s.tableName = m.tableName AND s.rowid = m.rowid)"""


def marks(spark, sf):
    ev = shape(spark, sf, "ev").withColumn("remote_address", F.nullif(F.get_json_object(F.when(F.col("EventData").contains("IpAddress"), F.col("EventData")), "$.IpAddress"), F.lit(""))).withColumn("direction", F.lit("inbound"))
    sources = [bm.bookmark_source(ev, "Events", ["timestamp"]), bm.bookmark_source(shape(spark, sf, "tasks"), "Tasks", ["timestamp"])]
    return bm.resolved(shape(spark, sf, "marks"), sources)


@check("j11_bookmarked_rows", "ev tasks marks", MARK_SQL + " SELECT id, tableName, rowid, event_time FROM mk")
def _(spark, sf):
    return marks(spark, sf).select("id", "tableName", "rowid", "event_time")


@check("q21_bookmark_sequence", "ev tasks marks facts", cr.NET_SQL + "," + MARK_SQL + """,
addr AS (SELECT replace(value, '10.1.', '10.0.') AS ip, min(host_id) AS peer_host FROM faces1 GROUP BY 1),
steps AS (SELECT mk.*, nullif(trim(remote_address), '') AS peer, peer_host FROM mk LEFT JOIN addr ON ip = trim(remote_address))
SELECT id, event_time, host_id, peer, peer_host FROM steps""")
def _(spark, sf):
    return steps(spark, sf).select("id", "event_time", "host_id", "peer", "peer_host")


def steps(spark, sf):
    from caseloom.plans import registry_facts as rf

    faces = rf.network_interfaces(shape(spark, sf, "facts")).withColumn("value", F.replace(F.col("value"), F.lit("10.1."), F.lit("10.0.")))
    return bm.sequence(marks(spark, sf), rf.host_addresses(faces))


@check("q21_participants", "ev tasks marks facts", cr.NET_SQL + "," + MARK_SQL + """,
addr AS (SELECT replace(value, '10.1.', '10.0.') AS ip, min(host_id) AS peer_host FROM faces1 GROUP BY 1),
steps AS (SELECT mk.*, nullif(trim(remote_address), '') AS peer, peer_host FROM mk LEFT JOIN addr ON ip = trim(remote_address)),
u AS (SELECT peer AS name, min((event_time IS NULL, coalesce(event_time, ''), taggedAt)) AS f FROM steps WHERE peer IS NOT NULL AND peer_host IS NULL GROUP BY 1)
SELECT 'host' AS kind, name FROM (SELECT host_id AS name FROM steps UNION SELECT peer_host FROM steps WHERE peer_host IS NOT NULL) UNION ALL SELECT 'peer', name FROM u""")
def _(spark, sf):
    return bm.participants(steps(spark, sf)).select("kind", "name")
