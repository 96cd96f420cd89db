"""How the evidence-shaped inputs are dealt."""

from caseloom.harness import shapes


def test_heavy_rows_are_dealt_by_their_number(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 8)
    monkeypatch.setattr(shapes, "ROWS_PER_TASK", 100)
    assert shapes.spread(df).rdd.getNumPartitions() == 50 and shapes.spread(df).count() == 5000
    monkeypatch.setattr(shapes, "ROWS_PER_TASK", 10_000)
    assert shapes.spread(df).rdd.getNumPartitions() == 8


def test_filters_on_heavy_values_stay_above_the_deal(spark):
    """A payload is read after its rows were spread, not in the few tasks that read the table."""
    rows = shapes.shape(spark, "/root/testdata/sf0.001", "deep").filter("EventData LIKE '%user1%'")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "user1" in plan.split("Repartition")[0] and "user1" not in plan.split("Repartition")[1]
