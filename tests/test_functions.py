"""Scalar functions on hand-made values."""

import struct

from pyspark.sql import functions as F

from caseloom.functions import eventdata, hexbin, lookups, obfuscation, tags, times, urls
from caseloom.functions import text as tx
from caseloom.operators import payloads
from caseloom.plans import registry_facts as rf
from caseloom.sources.records import usage_table_name


def values(spark, column, data, schema="v string"):
    df = spark.createDataFrame([(i, *(d if isinstance(d, tuple) else (d,))) for i, d in enumerate(data)], "i int, " + schema)
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_filetime_rounds_half_even_and_floors_to_millis(spark):
    base = 133_000_000_000_000_000
    ticks = [base + 9_999_994, base + 9_999_995, base + 9_985, base + 9_995, 0, -5]
    got = values(spark, times.filetime(F.col("v")), ticks, "v long")
    assert [g and g[-6:] for g in got] == ["40.999", "41.000", "40.000", "40.001", None, None]
    assert got[0].startswith("2022-06-")


def test_filetime_nanoseconds(spark):
    got = values(spark, times.filetime_ns(F.col("v")), [1_500, 2_500, 999_500, -1], "v long")
    assert got == ["1970-01-01 09:00:00.000", "1970-01-01 09:00:00.000", "1970-01-01 09:00:00.001", "1970-01-01 09:00:00.000"]


def test_task_time(spark):
    got = values(spark, times.zoned_or_local_time("v"), ["2024-03-01T00:00:00Z", "2024-03-01T10:00:00.1234567+01:00", "2024-03-01T10:00:00", "soon", ""])
    assert got == ["2024-03-01 09:00:00.000", "2024-03-01 18:00:00.123", "2024-03-01 10:00:00.000", "soon", None]


def test_payload_time(spark):
    got = values(spark, times.payload_time("v"), ["2024-02-30 00:00:00", "2024-01-02 03:04:05.6", "1704067200", "1704067200123", "12", "2024-01-01T00:00:00Z", "x"])
    assert got == [None, "2024-01-02 03:04:05.600", "2024-01-01 09:00:00.000", "2024-01-01 09:00:00.123", None, "2024-01-01 09:00:00.000", None]


def test_times_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert values(spark, times.filetime(F.col("v")), [133_000_000_000_000_000], "v long") == ["2022-06-18 13:26:40.000"]
        assert values(spark, times.epoch_millis("v"), ["2024-03-10 02:30:00.000"])[0] == 1710037800000
        assert values(spark, times.zoned_or_local_time("v"), ["2024-03-10T02:30:00Z"]) == ["2024-03-10 11:30:00.000"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_ole_and_unix_times(spark):
    assert values(spark, times.ole_days("v"), ["45000.5", "0", "NaN", "x"]) == ["2023-03-15 21:00:00.000", None, None, None]
    assert values(spark, times.unix_seconds("v"), ["1704067200", "0", "-4", "a"]) == ["2024-01-01 09:00:00.000", None, None, None]


def test_range_bounds():
    assert times.widen_bound("2024-01-02", "start") == "2024-01-02 00:00:00.000"
    assert times.widen_bound("2024-01-02", "end") == "2024-01-02 23:59:59.999"
    assert times.widen_bound("2024-01-02T03:04", "end") == "2024-01-02 03:04:59.999"
    assert times.widen_bound("2024-1-2", "end") is None
    assert times.time_column_for(["a", "b"], None, {"b": "2024-01-01 00:00:00.000"}) == "b"
    assert times.time_column_for(["a", "timestamp"], "a", None) == "a"
    assert times.time_column_for(["a"], None, {"a": "x"}) is None


def test_names_and_paths(spark):
    assert values(spark, tx.bare_account("v"), ["CORP/kim@x", "a\\b\\ lee ", "", "park"]) == ["kim", "lee", None, "park"]
    assert values(spark, tx.exe_from_host("v"), ['"C:\\a b\\p.exe" -x', "C:\\q.exe -y", " "]) == ["p.exe", "q.exe", None]
    assert values(spark, tx.volume_relative("v"), ["C:\\Win", "c:", "d:x", "\\\\srv\\s", "E:/a/B"]) == ["\\win", "\\", "\\x", "\\\\srv\\s", "\\a\\b"]
    assert values(spark, tx.snake_case("v"), ["LowerCaseLongPath", "SHA1Hash", "BinFileVersion", "A-B"]) == ["lower_case_long_path", "sha1_hash", "bin_file_version", "a_b"]
    assert values(spark, tx.human_bytes("v"), ["0", "1023", "1024", "2304", "-1", "x", "1099511627776"]) == ["0 B", "1023 B", "1.0 KB", "2.2 KB", None, None, "1.0 TB"]
    assert values(spark, tx.address_list("v"), ['["0.0.0.0","10.1.1.1",""]', "0.0.0.0", "1.2.3.4", "[bad"]) == ["10.1.1.1", None, "1.2.3.4", "[bad"]
    assert values(spark, tx.truth_value("v"), [" YES ", "예", "아니오", "perhaps", ""]) == [True, True, False, None, None]
    assert values(spark, tx.bitmap_account("v"), ["/x/RDP_CACHE/kim/Cache/a.bin", "/x/RDP_CACHE/Cache/a", "/u/lee/cache/b", "/a/b"]) == ["kim", "RDP_CACHE", "lee", "unknown"]


def test_url_functions(spark):
    data = ["https://user:pw@Example.COM:443/a", "http://example.com./x", "file:///C:/a", "not a url", "https://b.org?q=@x"]
    assert values(spark, urls.url_domain("v"), data) == ["example.com", "example.com", None, None, "b.org"]
    assert values(spark, urls.url_decode("v"), ["a%20b+c", "%zz%41", "%EA%B0%80", "x%ff"]) == ["a b+c", "%zzA", "가", "x�"]
    assert values(spark, urls.url_from_key("v"), ["1/0/_dk_http://a http://b/c", "plain"]) == ["http://b/c", "plain"]


def test_hex_reads(spark):
    assert values(spark, hexbin.clean_hex("v"), ["0A0b", "abc", "zz", None]) == ["0a0b", "", "", ""]
    assert values(spark, hexbin.le_uint(F.col("v"), 1, 4), ["00010000ff", "0001"]) == [0xFF000001, 0]
    assert values(spark, hexbin.filetime_hex("v"), ["00" * 8, "ff" * 8, "00"]) == [None, None, None]
    text = "A가\U0001F600".encode("utf-16-le").hex()
    assert values(spark, hexbin.utf16_text(F.col("v")), [text, "3dd8", "00d84100", "41"]) == ["A가\U0001F600", "�", "�A", ""]
    sid = "010500000000000515000000010000000200000003000000f4010000"
    assert values(spark, hexbin.sid_text("v"), [sid, "0102"]) == ["S-1-5-21-1-2-3-500", "0102"]


def test_compatibility_entries():
    def record(path, ticks):
        raw = path.encode("utf-16-le")
        body = struct.pack("<H", len(raw)) + raw + struct.pack("<Q", ticks)
        return b"10ts" + b"\0" * 4 + struct.pack("<I", len(body)) + body

    head = struct.pack("<I", 52).ljust(52, b"\0")
    blob = head + record("C:\\a.exe", 7) + record("noslash", 8) + record("C:\\b.exe", 9)
    assert list(payloads.cache_entries(blob)) == [("C:\\a.exe", 7), ("C:\\b.exe", 9)]
    assert list(payloads.cache_entries(b"xx" + record("D:\\c", 1))) == [("D:\\c", 1)]
    assert list(payloads.cache_entries(b"")) == []


def test_compatibility_cache(spark):
    raw = "C:\\a.exe".encode("utf-16-le")
    body = struct.pack("<H", len(raw)) + raw + struct.pack("<Q", 133_000_000_000_000_000)
    blob = (b"10ts" + b"\0" * 4 + struct.pack("<I", len(body)) + body).hex()
    df = spark.createDataFrame([("h", "AppCompatCache", blob, "f", 1), ("h", "AppCompatCache", blob, "f", 2), ("h", "AppCompatCache", "zz", "f", 3)],
                               "host_id string, value_name string, value_data string, _source_file string, _rowid long")
    got = rf.compatibility_cache(df, ["host_id"]).collect()
    assert [(r["value"], r["timestamp"]) for r in got] == [("C:\\a.exe", "2022-06-18 13:26:40.000")]


def test_variable_names():
    code, legend = obfuscation.rename_variables("$Foo = ${b r} + $foo + $env:X + $_; $BAR")
    assert code == "$Value_1 = $Value_2 + $Value_1 + $env:X + $_; $Value_3"
    assert [x["original"] for x in legend] == ["$Foo", "$b r", "$BAR"]


def test_decoders(spark):
    wide = __import__("base64").b64encode("Get-Date".encode("utf-16-le")).decode()
    narrow = __import__("base64").b64encode("héllo wörld".encode()).decode()
    out = values(spark, obfuscation.decode_base64("v"), [wide, "'" + narrow + "'"])
    assert (out[0]["encoding"], out[0]["output"]) == ("UTF-16LE", "Get-Date")
    numbers = values(spark, obfuscation.decode_numbers("v"), ["(72,105,300)", "200, 65"])
    assert [(n["encoding"], n["output"]) for n in numbers] == [("UTF-8", "Hi"), ("Latin1", "ÈA")]
    assert values(spark, obfuscation.decode_url_text("v"), [" a+b%21 "]) == ["a b!"]


def test_tags(spark):
    paths = ["C:\\Users\\Public\\x.exe", "C:\\ProgramData\\Microsoft\\a", "C:\\ProgramData\\a\\temp\\b", "C:\\w\\RUNDLL32.EXE", None]
    assert values(spark, tags.tag_codes(tags.path_tags("v")), paths) == ["public_folder", "", "temp_folder,programdata", "lolbin", ""]
    script = '{"ScriptBlockText":"IEX (New-Object Net.WebClient).DownloadString(1)"}'
    rows = [("p", "4104", script), (tags.DEFENDER, "5010", None), ("x", "4732", '{"TargetUserName":"Administrators"}'), ("x", "4732", '{"TargetUserName":"Users"}')]
    got = values(spark, tags.tag_codes(tags.security_tags("p", "e", tags.tag_payload("d"))), rows, "p string, e string, d string")
    assert got == ["suspicious_script", "scanning_disabled", "admin_group_member_added", "group_member_added"]


def test_flattened_payload(spark):
    raw = '{"a":{"b":{"c":"x","n":5},"l":[1,"y",null]},"z":null,"t":true}'
    got = values(spark, eventdata.flattened("v"), [raw, "bad"])
    assert sorted((e["path"], e["field"], e["value"]) for e in got[0]) == [("a.b.c", "c", "x"), ("a.b.n", "n", "5"), ("a.l", "l", "1, y"), ("t", "t", "true")]


def test_usage_table_names():
    assert usage_table_name("{A-B}", ["BytesSent"]) == "SRUM_NetworkDataUsage"
    assert usage_table_name("{A-B}", ["DurationMS", "EndTime"]) == "SRUM_ApplicationTimeline"
    assert usage_table_name("{A-B}", ["x"]) == "SRUM_AB"


def test_sql_instance_and_hive_user(spark):
    assert values(spark, rf.sql_instance("v"), ["\\M\\MSSQL15.SQLX\\S", "\\M\\MSSQL99.A\\S", "\\M"]) == ["SQLX · SQL Server 2019", "A", None]
    assert values(spark, rf.hive_user("v"), ["SOFTWARE", "DEFAULT", "kim_NTUSER.DAT", "NTUSER.DAT"]) == ["(system)", ".DEFAULT", "kim", "NTUSER.DAT"]
    assert values(spark, lookups.sid_label("v"), ["S-1-1-0", "S-1-5-21-1-2-3-500", "S-1-9"]) == ["S-1-1-0 (Everyone)", "S-1-5-21-1-2-3-500 (Administrator)", "S-1-9"]
