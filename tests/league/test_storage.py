"""Working tables in buckets, and their end."""

from ringlore import storage


def test_tables_in_buckets_are_dropped(spark, monkeypatch):
    monkeypatch.setattr(storage, "_paths", {})
    t = storage.written_by(spark.range(100).selectExpr("id % 7 AS k", "id"), "made-up", "k")
    assert t.count() == 100 and "Exchange" not in t.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    storage.written(spark.range(3), "plain")
    mine = lambda: [x.name for x in spark.catalog.listTables() if x.name.startswith("ringlore_made_up")]
    assert len(mine()) == 1 and storage.release(spark) == 2 and not mine()
