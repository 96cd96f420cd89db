"""Search through postings: the same hits as a search of everything, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from caseloom.operators.postings import GRAM, PROBED, PostedTables, grams, probe
from caseloom.plans import search

NEEDLES = ["needle", "Needle In", "zz", "é ñ", "\U0001F600!", "a\nb", "%_", "absent text", "10", "ab", "x" * 40, "ΟΔΟΣ"]


def notes(spark, n=4000, host="h1"):
    r = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    special = {17: "a NEEDLE in hay", 40: "É Ñ", 41: "ok \U0001F600!", 42: "a\nb", 43: "100%_", 44: "ends with zz", 45: "x" * 5000, 46: "", 47: None, 48: "ab", 49: "ΟΔΟΣ", 3990: "needle in"}
    rows = [(host, i, special.get(i, " ".join(r.choice(words) for _ in range(6))), i * 10, "extra") for i in range(n)]
    return spark.createDataFrame(rows, "host_id string, _rowid bigint, note string, amount int, `odd.name` string")


def names(spark):
    return spark.createDataFrame([("h1", 1, "needle"), ("h2", 2, None)], "host_id string, _rowid bigint, name string")


def found(hits):
    return sorted((r.host_id, r.table_name, r._rowid, r.match_column, r.row) for r in hits.collect())


@pytest.fixture(scope="module")
def posted(spark, tmp_path_factory):
    index = PostedTables(spark, str(tmp_path_factory.mktemp("posted") / "case"))
    plain = {"notes": notes(spark).drop("odd.name"), "names": names(spark)}
    index.add(plain, "run-1", rows_per_file=100)
    return index, plain


@pytest.mark.parametrize("needle", NEEDLES)
def test_hits_are_those_of_a_full_search(posted, needle):
    index, plain = posted
    assert found(search.indexed_search(index, needle)) == found(search.case_search(plain, needle))


def test_files_are_skipped(posted):
    index, _ = posted
    _, read, files = index.narrowed("needle")
    assert files > 30 and read == 3
    assert index.narrowed("absent text")[1] == 0
    assert index.narrowed("alpha")[1] >= 0.9 * (files - 1)
    assert search.indexed_search(index, " x ") is None


def test_probe_reaches_the_file_statistics(posted):
    plan = posted[0].candidates("needle")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    assert "StringStartsWith(gram" in posted[0].candidates("zz")._jdf.queryExecution().toString()


def test_grams():
    assert probe("ab") == ["ab"] and probe("ABCA") == ["abc", "bca"] and len(probe("abcdefghijklmnopqrstuvwxyz")) == PROBED
    assert all(len(g) == GRAM for g in probe("x" * 40))


def test_grams_of_values(spark):
    rows = spark.createDataFrame([("aBc",), ("",), ("é\n\U0001F600",)], "v string").select(grams(F.col("v")).alias("g")).collect()
    assert sorted(rows[0].g) == ["abc", "bc\0", "c\0\0"] and rows[1].g == []
    assert {"é\n\U0001F600", "\n\U0001F600\0", "\U0001F600\0\0"} <= set(rows[2].g)


def test_runs_without_postings_and_replayed_runs(spark, tmp_path):
    """A run that was cut off before its postings is searched in full; adding it again leaves each row once."""
    index = PostedTables(spark, str(tmp_path / "case"))
    assert search.indexed_search(index, "needle").count() == 0
    index.add({"notes": notes(spark, 300).drop("odd.name")}, "run-1", rows_per_file=50)
    second = notes(spark, 60, "h2")
    cut = PostedTables(spark, str(tmp_path / "cut"))
    cut.add({"notes": second}, "run-2")
    # what a run leaves behind that stops after its rows
    for name in ("rows/notes", "tables"):
        source = spark.read.parquet(f"{cut.path}/{name}/run-2")
        source.write.parquet(f"{index.path}/{name}/run-2")
    expected = [("h1", 17), ("h2", 17)]
    hits = lambda: sorted((r.host_id, r._rowid) for r in search.indexed_search(index, "a needle").collect())
    assert hits() == expected
    for _ in range(2):
        index.add({"notes": second}, "run-2")
        assert hits() == expected
    assert index.narrowed("a needle")[1] == 2
    assert sorted((r.host_id, r.match_column) for r in search.indexed_search(index, "extra").select("host_id", "match_column").distinct().collect()) == [("h2", "odd.name")]


def test_empty_tables_and_names(spark, tmp_path):
    index = PostedTables(spark, str(tmp_path / "case"))
    index.add({"notes": notes(spark, 10).limit(0), "names": names(spark)}, "run-1")
    assert [r.table_name for r in search.indexed_search(index, "needle").collect()] == ["names"]
    with pytest.raises(ValueError):
        index.add({"a/b": names(spark)}, "run-1")
