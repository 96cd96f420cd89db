"""Two-level scans against sequential models on random data, and their boundaries."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators import ordered
from caseloom.plans import powershell, remote_access, sessions

SCHEMA = "host_id string, timestamp string, direction string, remote_address string, account string, result string, _source_file string, _rowid long"


def stamp(ms):
    s, ms = divmod(ms, 1000)
    m, s = divmod(s, 60)
    h, m = divmod(m, 60)
    d, h = divmod(h, 24)
    return f"2024-01-{d + 1:02d} {h:02d}:{m:02d}:{s:02d}.{ms:03d}"


def random_rows(seed, n, step):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice([0, 1, step // 4, step // 2, step, step + 1, step * 3])
        host = "hot" if rng.random() < 0.7 else f"h{rng.randrange(3)}"
        rows.append((host, stamp(t), rng.choice(["inbound", "inbound", "outbound"]), rng.choice([None, None, "a", "b", "c"]), None, "info", "f", i))
    rng.shuffle(rows)
    return rows


def sequential_sessions(rows, gap):
    found = {}
    for host in {r[0] for r in rows}:
        current, last = None, None
        for r in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1], r[7])):
            ms = to_ms(r[1])
            new = current is None or current["d"] != r[2] or ms - last > gap or (r[3] and current["a"] and r[3] != current["a"])
            if new:
                current = {"d": r[2], "a": r[3], "start": r[7]}
            if not current["a"] and r[3]:
                current["a"] = r[3]
            found[r[7]] = current["start"]
            last = ms
    return found


def to_ms(ts):
    d, h, m, s = int(ts[8:10]) - 1, int(ts[11:13]), int(ts[14:16]), float(ts[17:])
    return round((((d * 24 + h) * 60 + m) * 60 + s) * 1000)


@pytest.mark.parametrize("seed,step", [(1, 60_000), (2, 300_000), (3, 5_000)])
def test_sessions_equal_sequential_scan(spark, seed, step):
    rows = random_rows(seed, 1500, step)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r["_rowid"]: r["start"] for r in sessions.remote_sessions(df, gap_ms=step).select("_rowid", F.col("session_start._rowid").alias("start")).collect()}
    assert got == sequential_sessions(rows, step)


def test_session_gap_boundary(spark):
    gap = sessions.SESSION_GAP_MS
    rows = [("h", stamp(0), "inbound", "a", "CORP\\u", "success", "f", 0), ("h", stamp(gap), "inbound", None, "u2", "failure", "f", 1),
            ("h", stamp(2 * gap + 1), "inbound", "a", None, "success", "f", 2)]
    table = sessions.session_table(sessions.remote_sessions(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((r["start"], r["events"], r["success"], r["fail"], r["account"]) for r in table.collect())
    assert got == [(stamp(0), 2, 1, 1, "u"), (stamp(2 * gap + 1), 1, 1, 0, None)]


def test_sessions_keep_unreadable_times(spark):
    """Such rows follow their host's others by text, in the last session as far as direction and address allow."""
    rows = [("h", stamp(0), "inbound", "a", None, "info", "f", 0), ("h", stamp(10 ** 7), "inbound", "a", None, "info", "f", 1),
            ("h", "yesterday", "inbound", None, None, "info", "f", 2), ("h", "later", "inbound", "a", None, "info", "f", 3), ("h", "zz", "outbound", None, None, "info", "f", 4),
            ("g", "bad", "inbound", "b", None, "info", "f", 5), ("g", None, "inbound", "b", None, "info", "f", 6)]
    found = sessions.remote_sessions(spark.createDataFrame(rows, SCHEMA)).select("_rowid", F.col("session_start._rowid").alias("start"))
    assert {r["_rowid"]: r["start"] for r in found.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("seed,step", [(4, 100_000), (5, 300_000)])
def test_carry_forward_equals_sequential_scan(spark, seed, step):
    rows = random_rows(seed, 1200, step)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("x", F.lit(1)).repartition(5)
    got = {r["_rowid"]: r["remote_address"] for r in remote_access.carry_outbound(df).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        last = None
        for r in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1], r[7])):
            value = r[3]
            if r[2] == "outbound":
                t = to_ms(r[1])
                if value:
                    last = (t, value)
                elif last and 0 <= t - last[0] <= 300_000:
                    value = last[1]
            want[r[7]] = value
    assert got == want


def test_carry_last_over_many_spans(spark):
    rng = random.Random(9)
    rows = [("h" if i % 3 else "g", rng.randrange(10**9), i, rng.choice([None, None, None, f"v{i}"])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string")
    order = ordered.ScanOrder(("k",), "t", ("i",))
    got = {r["i"]: (r["before"], r["upto"]) for r in ordered.carry_last(ordered.carry_last(df, order, F.col("v"), "before"), order, F.col("v"), "upto", True).collect()}
    want = {}
    for k in "hg":
        last = None
        for _, t, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            want[i] = (last, v or last)
            last = v or last
    assert got == want


def test_script_session_boundary(spark):
    gap = powershell.SESSION_GAP_MS
    rows = [("h", stamp(t), "u", "p.exe", "7", f"c{i}", None, None, "f", i) for i, t in enumerate([0, gap, 2 * gap + 1])]
    schema = "host_id string, timestamp string, account string, process string, process_id string, command string, script_block string, host_application string, _source_file string, _rowid long"
    table = powershell.script_session_table(powershell.script_sessions(spark.createDataFrame(rows, schema)))
    assert sorted((r["events"], r["first_evidence"]) for r in table.collect()) == [(1, "c2"), (2, "c0")]


def test_state_changes_keep_first_only_when_off(spark):
    rows = [("h", 1, 0, True), ("h", 2, 1, True), ("h", 3, 2, False), ("h", 10**9, 3, False), ("h", 2 * 10**9, 4, True), ("g", 5, 5, False)]
    df = spark.createDataFrame(rows, "k string, t long, i long, s boolean")
    got = ordered.state_changes(df, ordered.ScanOrder(("k",), "t", ("i",)), "s")
    assert sorted(r["i"] for r in got.collect()) == [2, 4, 5]


def test_fill_from_key_takes_the_last_value(spark):
    df = spark.createDataFrame([("h", "s", 1, "a"), ("h", "s", 2, None), ("h", "s", 3, "b"), ("h", None, 4, None)], "h string, s string, i long, v string")
    got = ordered.fill_from_key(df, ["h"], "s", F.struct("i"), ["v"])
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(1, "a"), (2, "b"), (3, "b"), (4, None)]


def test_untimed_rows_keep_their_own_value(spark):
    rows = [("h", None, 0, "a"), ("h", None, 1, None), ("h", 10, 2, None), ("h", 20, 3, "b"), ("h", 30, 4, None), ("h", 31, 5, None)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string")
    got = ordered.carry_within(df, ("k",), "t", ("i",), "v", 10, "v")
    assert sorted((r["i"], r["v"]) for r in got.collect()) == [(0, "a"), (1, None), (2, None), (3, "b"), (4, "b"), (5, None)]


@pytest.fixture
def many_ranges(spark):
    """Ranges as they are on large input: small ones are not put together."""
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield 16
    for k, v in before.items():
        spark.conf.set(k, v)


def burst_rows(n):
    """A third in one minute of one host, a third of another host without a readable time, the rest quiet."""
    rng = random.Random(6)
    rows = []
    for i in range(n):
        kind = i % 3
        host, when = ("burst", stamp(rng.randrange(60_000))) if kind == 0 else ("untimed", f"t{rng.randrange(50):02d}") if kind == 1 else (f"h{rng.randrange(4)}", stamp(rng.randrange(10 ** 9)))
        rows.append((host, when, rng.choice(["inbound", "inbound", "inbound", "outbound"]), rng.choice([None, None, None, "a", "b"]), None, "info", "f", i))
    return rows


def test_bursts_and_untimed_rows_spread(spark, many_ranges):
    rows = burst_rows(6000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("t", F.col("_rowid") * 0)
    sizes = [r["count"] for r in ordered.ScanOrder(("host_id",), "t", ("timestamp", "_source_file", "_rowid")).cells(df).groupBy("host_id", ordered.SPAN).count().collect()]
    per_host = {r["host_id"]: r["n"] for r in ordered.ScanOrder(("host_id",), "t", ("timestamp", "_source_file", "_rowid")).cells(df).groupBy("host_id").agg(F.countDistinct(ordered.SPAN).alias("n")).collect()}
    assert sum(sizes) == 6000 and max(sizes) < 3 * 6000 / many_ranges
    assert per_host["burst"] >= 4 and per_host["untimed"] >= 4


def test_sessions_over_bursts_equal_sequential_scan(spark, many_ranges):
    """The same rows in many ranges; untimed rows follow their host's others by text and measure no gap."""
    rows = burst_rows(3000)
    got = {r["_rowid"]: r["start"] for r in sessions.remote_sessions(spark.createDataFrame(rows, SCHEMA).repartition(5), gap_ms=1000).select("_rowid", F.col("session_start._rowid").alias("start")).collect()}
    want = {}
    for host in {r[0] for r in rows}:
        current, last = None, None
        for r in sorted((r for r in rows if r[0] == host), key=lambda r: (r[1].startswith("t"), r[1], r[7])):
            ms = None if r[1].startswith("t") else to_ms(r[1])
            apart = current is not None and ms is not None and last is not None and ms - last > 1000
            if current is None or current["d"] != r[2] or apart or (r[3] and current["a"] and r[3] != current["a"]):
                current = {"d": r[2], "a": r[3], "start": r[7]}
            current["a"] = current["a"] or r[3]
            want[r[7]], last = current["start"], ms
    assert got == want


@pytest.mark.parametrize("seed", [7, 8])
def test_scans_over_many_ranges(spark, many_ranges, seed):
    """Carried values and state changes do not depend on where the ranges lie."""
    rng = random.Random(seed)
    rows = [("h" if rng.random() < 0.8 else f"g{rng.randrange(40)}", rng.randrange(50), i, rng.choice([None, None, f"v{i}"]), rng.random() < 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string, s boolean").repartition(6)
    order = ordered.ScanOrder(("k",), "t", ("i",))
    carried = {r["i"]: r["c"] for r in ordered.carry_last(df, order, F.col("v"), "c").collect()}
    changes = {r["i"] for r in ordered.state_changes(df, order, "s").collect()}
    want, switched = {}, set()
    for k in {r[0] for r in rows}:
        last = state = None
        for _, t, i, v, s in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3]):
            want[i], last = last, v or last
            if (state is None and not s) or (state is not None and state != s):
                switched.add(i)
            state = s
    assert carried == want and changes == switched
