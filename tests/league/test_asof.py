"""The as-of join against a loop, one key with half of all rows, over few and many ranges."""

import random

import pytest

from ringlore.functions import shuffles
from ringlore.functions.shuffles import as_of
from ringlore.operators import joins, views
from ringlore.plans.league import League, league


def brute(left, right, strict):
    out = []
    for k, t, n in left:
        held = [(u, v, x) for j, u, v, x in right if None not in (j, u, k, t) and j == k and (u < t if strict else u <= t)]
        out.append((k, t, n, *(max(held, key=lambda h: (h[0], h[1]))[1:] if held else (None, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("parts", ["1", "4", "60"])
def test_as_of(spark, strict, parts):
    r = random.Random(7)
    key = lambda: 5 if r.random() < 0.5 else r.choice([None, 1, 2, 3, 9])
    left = [(key(), r.choice([None, *range(40)]), i) for i in range(300)]
    right = [(key(), r.choice([None, *range(40)]), i, None if i % 7 == 0 else f"v{i}") for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        a, b = spark.createDataFrame(left, "who long, day int, n int"), spark.createDataFrame(right, "who long, day int, v int, text string")
        got = as_of(a.repartition(3), b.repartition(3), "who", "day", ["v", "text"], strict, ties=["v"])
        assert got.columns == ["who", "day", "n", "v", "text"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, strict)
        assert {r.v for r in as_of(a, b.limit(0), "who", "day", ["v"]).collect()} == {None} and as_of(a.limit(0), b, "who", "day", ["v"]).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_as_of_shuffles_once_and_writes_the_left_rows_alone(spark, monkeypatch):
    """What is looked up is shuffled by one range shuffle and not written; a table holds the rows that look, and a row for each range."""
    tables, real = [], shuffles.written
    monkeypatch.setattr(shuffles, "written", lambda df, label: tables.append((df, real(df, label))) or tables[-1][1])
    a, b = spark.range(0, 7).selectExpr("id AS who", "50 AS day"), spark.range(0, 4000).selectExpr("id % 10 AS who", "int(id % 97) AS day", "id AS v")
    assert as_of(a, b, "who", "day", ["v"]).count() == 7
    (df, table), = tables
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert table.where("own IS NOT NULL").count() == 7 and table.count() <= 7 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_ratings_around_a_day_are_one_aggregate(spark):
    w = league(spark, "/root/testdata/sf0.001")
    plan = views.rank_before_and_after(w)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    day = w.counted.groupBy("date").count().orderBy("count").tail(1)[0].date
    got = {r.boxer_id: (r.before, r.after) for r in joins.ratings_around(w, day).collect()}
    rows = sorted((r.date, r.bout_id, r.boxer_id, r.post) for r in w.counted.select("date", "bout_id", "boxer_id", "post").collect())
    last = lambda k, upto: ([1500.0] + [p for d, _, b, p in rows if b == k and upto(d)])[-1]
    assert got == {k: (last(k, lambda d: d < day), last(k, lambda d: d <= day)) for k in got} and any(x != y for x, y in got.values())


def test_fighters_of_no_bout_need_no_ratings(spark):
    def none(w):
        raise AssertionError("ratings were asked for")

    w = League(spark, "/root/testdata/sf0.001", ratings=none)
    got = joins.without_bout(w)
    before_the_shuffle = got._jdf.queryExecution().optimizedPlan().toString()
    assert before_the_shuffle.count("Aggregate") == 2 and got.count() > 0
