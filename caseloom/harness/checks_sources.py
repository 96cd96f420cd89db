"""Checked queries over sources and sinks that really read and write: exports, result tables, files.

What they read is first written by Spark from the given tables, into the shared folder that the cluster names.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.harness.checks_activity import SEARCH_SQL, search_tables
from caseloom.harness.checks_events import EV
from caseloom.harness.registry import check
from caseloom.harness.shapes import shape
from caseloom.operators.clustered import OrderedFiles
from caseloom.operators.postings import PostedTables
from caseloom.plans import search
from caseloom.session import scratch_folder
from caseloom.sources import inventory, raw, zone
from caseloom.sources.sink import ResultSink

EXPORTED = ["host_id", "timestamp", "Provider", "EventID", "EventData", "_source_file", "_rowid"]


@check("s29_corrupt_json_lines", "ev", """
SELECT _rowid, host_id, Provider, EventData, NULL AS status, NULL AS error FROM ev WHERE _rowid % 7 <> 1
UNION ALL SELECT NULL, NULL, NULL, NULL, 'corrupted', 'unreadable record: {"broken":' || @n(_rowid) FROM ev WHERE _rowid % 7 = 1""")
def _(spark, sf):
    """Events exported as JSON lines, every seventh cut off."""
    rows = EV(spark, sf).select(*EXPORTED)
    line = F.when(F.col("_rowid") % 7 == 1, F.concat(F.lit('{"broken":'), F.col("_rowid").cast("string"))).otherwise(F.to_json(F.struct(*EXPORTED)))
    folder = scratch_folder(spark, "export-json")
    rows.select(line.alias("value")).write.text(folder)
    read = raw.read_table(spark, folder, "events", "json")
    return read.select("_rowid", "host_id", "Provider", "EventData", F.col("_status").alias("status"), F.col("_error").alias("error"))


@check("s29_corrupt_csv_lines", "", """
SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 5 <> 2 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 5 = 2 THEN 'corrupted' END AS status,
  CASE WHEN c_custkey % 5 = 2 THEN 'unreadable record: ' || CAST(c_custkey AS VARCHAR) || ',' || c_name || ',n/a' END AS error FROM customer""")
def _(spark, sf):
    """Accounts exported as CSV, every fifth with text in a number; readable fields stay."""
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    balance = F.when(F.col("c_custkey") % 5 == 2, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    folder = scratch_folder(spark, "export-csv")
    rows.select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", balance).alias("value")).write.text(folder)
    schema = rows.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")).schema
    read = raw.read_export(spark, folder, schema, "csv", header="false")
    return read.select("k", "name", "balance", F.col("_status").alias("status"), F.col("_error").alias("error"))


@check("s26_replayable_sink", "ev", """
SELECT host_id, _rowid, log, 'first' AS run FROM ev WHERE host_id = 'host0'
UNION ALL SELECT host_id, _rowid, log, 'second' FROM ev WHERE host_id IN ('host1', 'host2') AND EventID IS NOT NULL""")
def _(spark, sf):
    """Overlapping host sets in turn: one run is cut off after staging and finished later, one before its manifest and dropped."""
    rows = EV(spark, sf).select("host_id", "_rowid", "log", "EventID")
    sink = ResultSink(spark, scratch_folder(spark, "sink"))
    result = lambda df, name: df.select("host_id", "_rowid", "log", F.lit(name).alias("run"))
    sink.stage(result(rows.filter("host_id <> 'host2'"), "first"), "run-1")
    sink.publish("run-1")
    # host3 was processed again and has no rows now.
    second = rows.filter("host_id in ('host1', 'host2') and EventID is not null")
    sink.stage(result(second, "second"), "run-2", hosts=rows.filter("host_id <> 'host0'"))
    result(rows, "third").write.partitionBy("host_id").parquet(f"{sink.path}/_runs/run-3/rows")
    sink.recover()
    sink.publish("run-2")
    return sink.read()


@check("s28_observed_rows", "ev tasks", """
SELECT 'EventLog' AS artifact, count(*) AS rows, count(*) FILTER (_status IS NULL) AS ok, count(*) FILTER (_status IS NOT NULL) AS failed FROM (SELECT nullif(_status, '') AS _status FROM ev)
UNION ALL SELECT 'ScheduledTasks', count(*), count(*), 0 FROM tasks""".strip())
def _(spark, sf):
    """Rows counted by the jobs that write the tables, with no scan of their own."""
    counted = []
    tables = {"EventLog": EV(spark, sf).withColumn("_status", F.nullif("_status", F.lit(""))), "ScheduledTasks": shape(spark, sf, "tasks")}
    for artifact, table in tables.items():
        df, seen = raw.observed(table, artifact)
        df.write.parquet(scratch_folder(spark, "observed"))
        counted.append((artifact, seen.get["rows"], seen.get["ok"], seen.get["failed"]))
    return spark.createDataFrame(counted, "artifact string, rows long, ok long, failed long")


def _written_files(spark, sf):
    """One file per customer segment and nation: the names in order, a line each, and a marker in some."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").withColumn("folder", F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("c_custkey") % 3))
    folder = scratch_folder(spark, "files")
    rows.select("folder", "c_custkey", "c_name").repartition("folder").sortWithinPartitions("folder", "c_custkey").select("folder", F.col("c_name").alias("value")).write.partitionBy("folder").text(folder)
    listed = inventory.listed_files(spark, folder).filter(F.col("path").endswith(".txt"))
    return listed.withColumn("folder", F.regexp_extract("path", "folder=([^/]+)/", 1))


FILES_SQL = """
f AS (SELECT c_nationkey || '-' || c_custkey % 3 AS folder, string_agg(c_name || chr(10), '' ORDER BY c_custkey) AS content FROM customer GROUP BY 1)"""


@check("s8_streamed_markers", "", FILES_SQL + " SELECT folder, strlen(content) AS length, sha256(content) AS digest, contains(content, '7' || chr(10) || 'Customer#0000000') AS found FROM f")
def _(spark, sf):
    """Files read in blocks of a few bytes, so that lines and the marker lie across their borders."""
    return inventory.digested(_written_files(spark, sf), {"found": "7\nCustomer#0000000"}, block_bytes=64).select("folder", "length", "digest", "found")


@check("s9_streamed_dedupe", "", FILES_SQL + " SELECT folder, strlen(content) AS length, sha256(content) AS digest FROM f")
def _(spark, sf):
    """All files twice, in two folders: the first path of each content stays."""
    both = inventory.digested(_written_files(spark, sf).unionByName(_written_files(spark, sf)))
    return inventory.same_content(both).select("folder", "length", "digest")


# Layout --------------------------------------------------------------------------------------------------------------

def _zone(spark, sf, name, table):
    rows = shape(spark, sf, name)
    folder = scratch_folder(spark, f"zone-{table}")
    zone.write_zone(rows, folder, table)
    return zone.read_zone(spark, folder, rows.schema, table)


@check("s5_log_partitions", "ev", "SELECT log, EventID, _rowid, EventData FROM ev WHERE contains(lower(log), 'terminalservices')")
def _(spark, sf):
    """Logs by a part of their name: folders of other logs are not opened."""
    return raw.logs_named(_zone(spark, sf, "ev", "events"), "TerminalServices").select("log", "EventID", "_rowid", "EventData")


@check("s5_requested_logs", "ev", "SELECT log, _rowid, Provider FROM ev WHERE log IN (SELECT DISTINCT log FROM ev WHERE EventID IN ('4624', '1116'))")
def _(spark, sf):
    """Logs from a table of requests."""
    requested = EV(spark, sf).filter("EventID in ('4624', '1116')")
    return zone.of_logs(_zone(spark, sf, "ev", "events"), requested).select("log", "_rowid", "Provider")


@check("s6_hive_partitions", "reg", """
SELECT 'SYSTEM' AS scan, _rowid, key_path, value_name, value_data FROM reg WHERE upper(hive) = 'SYSTEM' AND (_recovery IS NULL OR _recovery = 'live')
UNION ALL SELECT 'users', _rowid, key_path, value_name, value_data FROM reg WHERE upper(hive) LIKE '%NTUSER.DAT' AND (_recovery IS NULL OR _recovery = 'live')""".strip())
def _(spark, sf):
    rows = _zone(spark, sf, "reg", "registry")
    found = lambda name, df: df.select(F.lit(name).alias("scan"), "_rowid", "key_path", "value_name", "value_data")
    return found("SYSTEM", raw.hive(rows, "system")).unionByName(found("users", raw.user_hives(rows)))


@check("p4_day_partitions", "ev", "SELECT _record_key AS record_key, timestamp, log FROM ev WHERE timestamp >= '2024-01-05 00:00:00.000' AND timestamp <= '2024-01-09 12:30:59.999'")
def _(spark, sf):
    rows = zone.between(_zone(spark, sf, "ev", "events"), "2024-01-05", "2024-01-09 12:30")
    return rows.select(F.col("_record_key").alias("record_key"), "timestamp", "log")


@check("o2_deep_page", "ev", """
SELECT timestamp, _record_key AS record_key, host_id, true AS few_files FROM ev WHERE timestamp < '2024-01-05 00:00:00.000' ORDER BY timestamp DESC, _record_key DESC LIMIT 60""")
def _(spark, sf):
    """A page of the time-ordered event files, newest first, that begins days before the newest row."""
    rows = EV(spark, sf).select("timestamp", F.col("_record_key").alias("record_key"), "host_id")
    files = OrderedFiles(spark, scratch_folder(spark, "ordered"), ("timestamp", "record_key"), descending=True)
    files.write(rows, rows_per_file=40)
    page, opened = files.page(rows.schema, 60, {"timestamp": "2024-01-05 00:00:00.000", "record_key": ""})
    return page.withColumn("few_files", F.lit(0 < opened <= 2 + 60 // 20))


def _posted(spark, sf):
    """The searched tables in two runs, by halves of their ids."""
    index = PostedTables(spark, scratch_folder(spark, "posted"))
    for run, parity in (("even", 0), ("odd", 1)):
        index.add({name: df.filter(F.col("_rowid") % 2 == parity) for name, df in search_tables(spark, sf).items()}, run, rows_per_file=20_000)
    return index


@check("q14_indexed_search", "", SEARCH_SQL.strip() + " SELECT table_name, _rowid, match_column FROM h")
def _(spark, sf):
    return search.indexed_search(_posted(spark, sf), " URC ").select("table_name", "_rowid", "match_column")


@check("p8_short_indexed_search", "", """
SELECT 'part' AS table_name, CAST(p_partkey AS BIGINT) AS _rowid, 'p_name' AS match_column FROM part WHERE contains(lower(p_name), 'zu')
UNION ALL SELECT 'events', event_id, CASE WHEN contains(lower(event_type), 'zu') THEN 'event_type' ELSE 'props' END FROM events WHERE contains(lower(event_type), 'zu') OR contains(lower(CAST(props AS VARCHAR)), 'zu')
UNION ALL SELECT 'documents', doc_id, CASE WHEN contains(lower(text), 'zu') THEN 'text' ELSE 'source' END FROM documents WHERE contains(lower(text), 'zu') OR contains(lower(source), 'zu')""")
def _(spark, sf):
    """A needle shorter than a gram is looked up as the beginning of one."""
    return search.indexed_search(_posted(spark, sf), "ZU").select("table_name", "_rowid", "match_column")
