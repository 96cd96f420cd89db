"""Exports with broken lines, the replayable sink, observed counts and files read in blocks."""

import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators.clustered import OrderedFiles
from caseloom.sources import inventory, raw, zone
from caseloom.sources.sink import ResultSink, SinkError


# --- exports ---------------------------------------------------------------------------------------------------------

def test_json_lines_that_are_no_records(spark, tmp_path):
    good = '{"host_id":"h","EventID":"1","_rowid":7,"_status":"truncated","_error":"tail"}'
    lines = [good, '{"host_id":"h","EventID":', "not json", "", '{"host_id":"h","_rowid":"seven"}', '{"_rowid":9}', "[1]", '{"other":1}']
    (tmp_path / "a.json").write_text("\n".join(lines))
    rows = raw.read_table(spark, str(tmp_path), "events", "json").select("host_id", "_rowid", "_status", "_error").collect()
    failed = lambda line: (None, "corrupted", "unreadable record: " + line)
    want = [(7, "truncated", "tail"), failed(lines[1]), failed("not json"), failed(lines[4]), (9, None, None), failed("[1]"), (None, None, None)]
    assert sorted((tuple(r[1:]) for r in rows), key=str) == sorted(want, key=str)


def test_csv_lines_that_are_no_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2\n3,y,z\nn,w\n")
    rows = raw.read_export(spark, str(tmp_path), spark.createDataFrame([], "a int, b string").schema, "csv").collect()
    got = {(r["a"], r["b"], r["_status"], r["_error"]) for r in rows}
    assert got == {(1, "x", None, None), (2, None, "corrupted", "unreadable record: 2"), (3, "y", "corrupted", "unreadable record: 3,y,z"), (None, "w", "corrupted", "unreadable record: n,w")}


@pytest.mark.parametrize("fmt, text", [("csv", "a,b\n1,x\nn,w\n"), ("json", '{"a":1,"b":"x"}\n{"a":"n","b":"w"}\n')])
def test_status_does_not_depend_on_the_columns_read(spark, tmp_path, fmt, text):
    (tmp_path / "a").write_text(text)
    read = raw.read_export(spark, str(tmp_path), spark.createDataFrame([], "a int, b string").schema, fmt)
    assert read.select("_status").filter("_status is not null").count() == 1
    assert sorted(map(tuple, read.select("b", "_status").collect()), key=str) == [("w", "corrupted"), ("x", None)]
    assert read.select("b").count() == 2 and read.filter("_error is not null").select("b").collect()[0]["b"] == "w"


@pytest.mark.parametrize("fmt", ["json", "csv"])
def test_missing_export(spark, tmp_path, fmt):
    df = raw.read_table(spark, str(tmp_path / "none"), "events", fmt)
    assert df.count() == 0 and {"_status", "_error", "EventData"} <= set(df.columns)


# --- sink ------------------------------------------------------------------------------------------------------------

def frame(spark, rows):
    return spark.createDataFrame(rows, "host_id string, v string, n long")


def content(sink):
    return sorted((str(r["host_id"]), r["v"], r["n"]) for r in sink.read().collect())


def test_runs_replace_their_hosts(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path / "out"))
    assert sink.runs() == [] and sink.recover() == [] and sink.read().count() == 0
    assert sink.stage(frame(spark, [("a", "x", 1), ("b", "x", 2), ("007", "x", 3)]), "1") == {"rows": 3, "ok": 3, "failed": 0}
    # staged only: readers see nothing yet
    assert content(sink) == []
    sink.publish("1")
    sink.stage(frame(spark, [("b", "y", 5), ("b", "y", 5), ("c", "y", 6)]), "2")
    sink.publish("2")
    want = [("007", "x", 3), ("a", "x", 1), ("b", "y", 5), ("b", "y", 5), ("c", "y", 6)]
    assert content(sink) == want
    for run in ("2", "2"):
        sink.publish(run)
        assert content(sink) == want
    assert sink.recover() == []


def test_cut_off_while_publishing(spark, tmp_path, monkeypatch):
    sink = ResultSink(spark, str(tmp_path / "out"))
    sink.stage(frame(spark, [("a", "x", 1), ("b", "x", 2)]), "1")
    sink.publish("1")
    sink.stage(frame(spark, [("b", "y", 3)]), "2")
    with monkeypatch.context() as m:
        m.setattr(ResultSink, "verify", lambda self, run: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            sink.publish("2")
    sink.stage(frame(spark, [("a", "z", 4)]), "3")
    assert sink.recover() == ["2", "3"]
    assert content(sink) == [("a", "z", 4), ("b", "y", 3)]


def test_cut_off_while_staging(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path / "out"))
    frame(spark, [("a", "half", 1)]).write.partitionBy("host_id").parquet(f"{sink.path}/_runs/1/rows")
    assert sink.recover() == [] and content(sink) == []
    sink.stage(frame(spark, [("b", "whole", 2)]), "1")
    sink.publish("1")
    assert content(sink) == [("b", "whole", 2)]


def test_hosts_without_rows(spark, tmp_path):
    """A processed host without rows is emptied; odd, empty and NULL names are hosts like others."""
    sink = ResultSink(spark, str(tmp_path / "out"))
    sink.stage(frame(spark, [("a/b=c", "x", 1), (None, "x", 2), ("", "x", 3), ("d", "x", 4)]), "1")
    sink.publish("1")
    assert content(sink) == [("None", "x", 2), ("None", "x", 3), ("a/b=c", "x", 1), ("d", "x", 4)]
    sink.stage(frame(spark, [("d", "y", 5)]), "2", hosts=frame(spark, [("a/b=c", "", 0), (None, "", 0), ("d", "", 0), ("new", "", 0)]))
    sink.publish("2")
    assert content(sink) == [("d", "y", 5)]
    sink.stage(frame(spark, []), "3", hosts=frame(spark, [("d", "", 0)]))
    sink.publish("3")
    assert content(sink) == []
    sink.stage(frame(spark, []), "4")
    sink.publish("4")
    assert content(sink) == []


def test_changed_files_are_found(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path / "out"))
    sink.stage(frame(spark, [("a", "x", 1), ("a", "x", 2)]), "1")
    sink.publish("1")
    frame(spark, [("a", "x", 1), ("a", "x", 3)]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("host_id").parquet(sink.path)
    with pytest.raises(SinkError):
        sink.verify("1")


def test_columns_in_order(spark, tmp_path):
    sink = ResultSink(spark, str(tmp_path / "out"))
    sink.stage(frame(spark, [("a", "x", 1)]), "1", preferred=["n", "missing"])
    sink.publish("1")
    assert sink.read().columns == ["n", "v", "host_id"]


# --- observed counts -------------------------------------------------------------------------------------------------

def test_observed_rows_need_no_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "corrupted"), (3, None)], "i int, _status string")
    counted, seen = raw.observed(df, "t")
    counted.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 3, "ok": 2, "failed": 1}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "CollectMetrics" in plan and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


# --- files in blocks -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_markers_over_block_borders(size):
    r = random.Random(size)
    for _ in range(60):
        data = bytes(r.choice(b"abc") for _ in range(r.randint(0, 80)))
        markers = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 1, 2, 5)]
        digest, found, total = inventory.read_blocks(io.BytesIO(data), size, markers)
        assert (digest, found, total) == (hashlib.sha256(data).hexdigest(), [m in data for m in markers], len(data))


def test_files_are_read_in_blocks(spark, tmp_path):
    big = bytes(random.Random(1).randrange(256) for _ in range(50_000)) + "<Task".encode("utf-16-le") + b"x" * 9000
    odd = "name with %20 and ü"
    for name, data in {"a": big, odd: b"..<Task..", "copy": big, "plain": b"Task", "empty": b""}.items():
        (tmp_path / name).write_bytes(data)
    listed = inventory.listed_files(spark, str(tmp_path))
    assert "content" not in listed.columns
    gone = listed.limit(1).select(F.lit(f"file:{tmp_path}/gone").alias("path"), F.lit(1).cast("long").alias("length"))
    rows = inventory.digested(listed.unionByName(gone), {"task": "<Task", "none": "<None"}, block_bytes=4096)
    got = {r["path"].rsplit("/", 1)[-1]: r for r in rows.collect()}
    assert got["a"]["digest"] == got["copy"]["digest"] == hashlib.sha256(big).hexdigest()
    assert [got[n]["task"] for n in ("a", odd, "copy", "plain", "gone")] == [True, True, True, False, None] and not got["a"]["none"]
    assert got["gone"]["digest"] is None and got["gone"]["_error"] and got["a"]["_error"] is None
    kept = sorted(r["path"].rsplit("/", 1)[-1] for r in inventory.same_content(rows).collect())
    assert kept == sorted(["a", odd, "plain", "gone"])


def test_no_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    assert inventory.digested(inventory.listed_files(spark, str(tmp_path)).limit(0), {"m": "x"}).count() == 0


# --- layout ----------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    logs = ["Security", "System", "", "Odd/Name=1", None]
    rows = [(logs[i % 5], f"2024-01-{1 + i % 9:02d} 10:00:00.000" if i % 11 else (None if i % 2 else ""), f"p{i % 3}", "f", i) for i in range(400)]
    df = spark.createDataFrame(rows, "log string, timestamp string, Provider string, _source_file string, _rowid long")
    path = str(tmp_path_factory.mktemp("zone") / "events")
    zone.write_zone(df, path, "events")
    return df, zone.read_zone(spark, path, df.schema, "events")


def scan_line(df, part):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next(line for line in plan.split(part)[1].splitlines() if line is not None)


def opened(df):
    return len({r[0] for r in df.select("_metadata.file_path").distinct().collect()})


def test_zone_keeps_all_rows(events):
    before, after = events
    key = lambda df: sorted(map(str, df.selectExpr("nullif(log, \'\')", "timestamp", "Provider", "_source_file", "_rowid").collect()))
    assert key(before) == key(after)


def test_log_filter_reaches_the_folders(events):
    found = raw.logs_named(events[1], "sec")
    assert "lower(log" in scan_line(found, "PartitionFilters: ") and {r["log"] for r in found.collect()} == {"Security"}
    assert 0 < opened(found) <= 10 < opened(events[1])


def test_range_reaches_folders_and_statistics(events):
    before, after = events
    found = zone.between(after, "2024-01-03", "2024-01-04 23:00")
    assert "day" in scan_line(found, "PartitionFilters: ") and "GreaterThanOrEqual(timestamp" in scan_line(found, "PushedFilters: ")
    want = {r["_rowid"] for r in before.collect() if r["timestamp"] and "2024-01-03" <= r["timestamp"] < "2024-01-05"}
    assert {r["_rowid"] for r in found.collect()} == want and zone.between(after).count() == 400


def test_requested_logs_choose_folders_at_run_time(spark, events, tmp_path):
    spark.createDataFrame([("System", 1), ("Odd/Name=1", 2), ("none", 1)], "log string, k int").write.parquet(str(tmp_path / "r"))
    found = zone.of_logs(events[1], spark.read.parquet(str(tmp_path / "r")).filter("k = 1"))
    assert "dynamicpruning" in scan_line(found, "PartitionFilters: ")
    assert {r["log"] for r in found.collect()} == {"System"}


def test_hive_filter_reaches_the_folders(spark, tmp_path):
    rows = spark.createDataFrame([(h, m, "f", i) for i, (h, m) in enumerate([("SYSTEM", None), ("system", "live"), ("SYSTEM", ""), ("SAM", None), ("a_NTUSER.DAT", None)])],
                                 "hive string, _recovery string, _source_file string, _rowid long")
    zone.write_zone(rows, str(tmp_path / "z"), "registry")
    read = zone.read_zone(spark, str(tmp_path / "z"), rows.schema, "registry")
    found = raw.hive(read, "System")
    assert sorted(r["_rowid"] for r in found.collect()) == [0, 1] and "upper(hive" in scan_line(found, "PartitionFilters: ")
    assert "_recovery" in scan_line(found, "PushedFilters: ")
    assert [r["_rowid"] for r in raw.user_hives(read).collect()] == [4]


@pytest.mark.parametrize("descending", [False, True])
def test_pages_read_few_files(spark, tmp_path, descending):
    r = random.Random(8)
    rows = [(None if i % 97 == 0 else f"t{r.randrange(300):03d}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "t string, i long").repartition(5)
    files = OrderedFiles(spark, str(tmp_path / "o"), ("t", "i"), descending)
    files.write(df, rows_per_file=100)
    want = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]), reverse=descending)
    total = files.index().count()
    assert total >= 30 and files.index().selectExpr("sum(rows)").first()[0] == 3000
    for place in (0, 1, 99, 100, 1500, 2950, 2999, 3000):
        after = dict(zip(("t", "i"), want[place - 1])) if place else None
        page, count = files.page(df.schema, 150, after)
        assert list(map(tuple, page.collect())) == want[place:place + 150] and count <= 8
    page, count = files.page(df.schema, 10, {"t": "" if descending else "u", "i": 0})
    assert all(x["t"] is None for x in page.collect()) and count <= 8


def test_pages_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "t string, i long")
    files = OrderedFiles(spark, str(tmp_path / "o"), ("t", "i"))
    files.write(df)
    assert files.page(df.schema, 10)[0].count() == 0


def test_short_stretches_share_files(spark, tmp_path):
    """An index row for every 10 rows, but no file for them alone."""
    files = OrderedFiles(spark, str(tmp_path / "o"), ("i",))
    files.write(spark.range(2000).selectExpr("id AS i"), rows_per_file=10)
    index = files.index().collect()
    assert len(index) >= 200 and max(r["rows"] for r in index) <= 10 and len({r["file"] for r in index}) <= 8
    page, opened = files.page(spark.range(0).selectExpr("id AS i").schema, 25, {"i": 994})
    assert [r["i"] for r in page.collect()] == list(range(995, 1020)) and opened <= 2
