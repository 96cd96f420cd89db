"""Versions of a result, compared whole and by digests of key ranges."""

import random

import pytest

from caseloom.operators import compare

SCHEMA = "k string, i long, a string, b string"


def version(seed, n):
    r = random.Random(seed)
    return [(r.choice(["x", "y", None]), i, r.choice(["p", "q", None]), r.choice(["p", "q", None])) for i in range(n)]


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("changes", [0, 1, 5, 400])
def test_same_differences_from_less(spark, changes):
    r = random.Random(changes)
    before = version(1, 2000)
    after = list(before)
    for _ in range(changes):
        at = r.randrange(len(after))
        k, i, a, b = after[at]
        # changed, moved to another column, dropped, added, repeated
        after[at:at + 1] = r.choice([[(k, i, "new", b)], [(k, i, b, a)], [], [(k, i, a, b), ("z", 10_000 + at, a, b)], [(k, i, a, b)] * 2])
    r.shuffle(after)
    left, right = spark.createDataFrame(before, SCHEMA), spark.createDataFrame(after, SCHEMA).select("b", "a", "i", "k")
    assert rows(compare.stored_row_differences(left, right, ["k", "i"])) == rows(compare.row_differences(left, right))
    parts = compare.differing_part(left, right, ["k", "i"])
    different = {x[:2] for x in set(before) ^ set(after)} | {x[:2] for x in after if after.count(x) > 1} if changes else set()
    assert all(part.count() <= 2 * len(different) + 2 for part in parts)


def test_same_mismatches(spark):
    before = version(2, 500)
    after = [(k, i, "new" if i % 40 == 0 else a, b) for k, i, a, b in before if i % 90]
    left, right = (spark.createDataFrame([(f"{k}", *x) for k, *x in v], SCHEMA) for v in (before, after))
    got = {x["column_name"]: x["mismatches"] for x in compare.stored_column_mismatches(left, right, ["k", "i"]).collect()}
    assert got == {x["column_name"]: x["mismatches"] for x in compare.column_mismatches(left, right, ["k", "i"]).collect()}


def test_value_in_another_column_is_a_difference(spark):
    left, right = spark.createDataFrame([("x", 1, "v", None)], SCHEMA), spark.createDataFrame([("x", 1, None, "v")], SCHEMA)
    assert compare.stored_row_differences(left, right, ["k", "i"]).count() == 2
    digest = lambda df: df.agg(compare.rows_digest(df.columns).alias("d")).first()["d"]
    assert digest(left) != digest(right) and digest(left.union(right)) == digest(right.union(left))


def test_empty_versions(spark):
    none, one = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("x", 1, None, None)], SCHEMA)
    assert compare.stored_row_differences(none, none, ["k", "i"]).count() == 0
    assert [r["side"] for r in compare.stored_row_differences(one, none, ["k", "i"]).collect()] == ["left"]
    assert [r["side"] for r in compare.stored_row_differences(none, one, ["k", "i"]).collect()] == ["right"]


def test_equal_rows_are_not_shuffled(spark, tmp_path):
    """Rows reach the comparison through semi joins with the differing ranges only."""
    spark.createDataFrame(version(3, 300), SCHEMA).write.parquet(str(tmp_path / "v"))
    df = spark.read.parquet(str(tmp_path / "v"))
    plan = compare.stored_row_differences(df, df, ["k", "i"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 4 and "Join FullOuter" in plan
