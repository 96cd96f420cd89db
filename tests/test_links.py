"""Links between tables when a few values have most of the rows."""

from collections import Counter

import pytest

from caseloom.plans import search


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("sides", [(300, 20), (20, 300)])
def test_values_with_many_rows_are_dealt_in_parts(spark, monkeypatch, how, sides):
    monkeypatch.setattr(search, "PAIRS_PER_PART", 500)
    n, m = sides
    left = [("h", "hot", i) for i in range(n)] + [("h", "one", 900), ("g", "hot", 901), ("h", None, 902), ("h", "hot", 0)]
    right = [("h", "hot", i) for i in range(m)] + [("h", "one", 900), ("h", None, 903), ("h", "hot", 0)]
    rows = search.link(spark.createDataFrame(left, "host_id string, a string, i long"), "a", spark.createDataFrame(right, "host_id string, b string, j long"), "b", how=how)
    assert rows.columns == ["host_id", "a", "i", "linked_j"]
    want = Counter((h, a, i, j) for h, a, i in left for g, b, j in right if (h, a) == (g, b) and a is not None)
    if how == "left":
        want += Counter((h, a, i, None) for h, a, i in left if a is None or h == "g")
    assert Counter(map(tuple, rows.collect())) == want
    assert "_part" in rows._jdf.queryExecution().optimizedPlan().toString()
