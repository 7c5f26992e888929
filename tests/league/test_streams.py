"""Streams against their batch forms or plain loops: copied posts, fixed windows, proposals, the gate of a stored table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ringlore.operators import documents
from ringlore.streaming import gate, jobs

T0 = dt.datetime(2024, 1, 1)


def posts(spark, n=300):
    r = random.Random(4)
    # half of all posts are one text, in order of time as far as the files go
    rows = sorted(((T0 + dt.timedelta(minutes=r.randrange(6 * 1440)), i, r.randrange(5), "spam" if r.random() < 0.5 else f"t{r.randrange(60)}") for i in range(n)))
    return spark.createDataFrame([(i, u, f, t) for t, i, u, f in rows], "post_id long, user_id long, fp string, ts timestamp")


def test_copied_posts(spark, tmp_path):
    df = posts(spark)
    rows = [tuple(r) for r in df.collect()]
    want = {b[0] for b in rows if any(a[2] == b[2] and a[1] != b[1] and dt.timedelta(0) <= b[3] - a[3] <= dt.timedelta(hours=24) for a in rows)}
    assert 50 < len(want) < len(rows)
    assert sorted(r.post_id for r in documents.copied_posts(df).collect()) == sorted(want)
    assert documents.copied_posts(df.limit(0)).count() == 0
    for k, part in enumerate(df.orderBy("ts").randomSplit([1.0, 1.0], 1)):
        part.coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*"))
    q = jobs.copied_posts(stream, lateness="30 days").writeStream.format("memory").queryName("copied").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.post_id for r in spark.table("copied").collect()) == sorted(want)


def test_fixed_windows(spark):
    r = random.Random(6)
    rows = [(0 if i % 2 else r.randrange(1, 9), i, T0 + dt.timedelta(seconds=r.randrange(20 * 86400) if i % 7 else 86400 * (i % 20))) for i in range(600)] + [(None, 1000, T0), (3, 1001, None)]
    want = {}
    for u, _, t in sorted((x for x in rows if None not in x), key=lambda x: x[2]):
        own = want.setdefault(u, [])
        if not own or t >= own[-1][0] + dt.timedelta(days=1):
            own.append([t, 0])
        own[-1][1] += 1
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").repartition(3)
    got = {(x.user_id, x.start, x.n, x.refused) for x in documents.fixed_windows(df, 86400, 2).collect()}
    assert got == {(u, t, n, max(0, n - 2)) for u, own in want.items() for t, n in own}
    assert documents.fixed_windows(df.limit(0)).count() == 0


def merge(held, batch):
    return held.join(batch, "k", "left_anti").unionByName(batch)


def test_gate(spark, tmp_path):
    path, fields = str(tmp_path / "t"), "k long, v string, method string, round long"
    rows = [(i, f"v{i}", None if i % 2 else "KO", i % 12) for i in range(500)]
    gate.create(spark.createDataFrame(rows, fields), path, "k", 8)
    small = spark.createDataFrame([(3, "new", "UD", 12), (900, "more", None, None)], fields)
    assert gate.apply(small, path, 1, merge, ["method", "round"])
    # a result is one change; a new row changes nothing; only touched buckets are written
    found = gate.changes(gate.read(spark, path, 0), small, "k", ["method", "round"]).collect()
    assert sorted((r.k, r.field, r.kind) for r in found) == [(3, "result", "replace"), (3, "v", "replace")]
    now = {r.k: tuple(r) for r in gate.read(spark, path).collect()}
    assert now == {r[0]: r for r in rows} | {3: (3, "new", "UD", 12), 900: (900, "more", None, None)}
    assert {r.version for r in spark.read.parquet(f"{path}/manifest/v=1").collect()} == {0, 1}
    # again: the same
    assert gate.apply(small, path, 1, merge, ["method", "round"]) and {r.k: tuple(r) for r in gate.read(spark, path).collect()} == now
    flood = spark.createDataFrame([(i, "flood", "KO", 1) for i in range(200)], fields)
    assert not gate.apply(flood, path, 2, merge, ["method", "round"])
    assert {r.k: tuple(r) for r in gate.read(spark, path).collect()} == now and gate.held_versions(spark, path, range(4)) == [2]
    assert gate.apply(spark.createDataFrame([(4, "x", "KO", 4)], fields), path, 3, merge, ["method", "round"])
    assert gate.accept(spark, path, 2, merge, ["method", "round"]) == 4 and gate.held_versions(spark, path, range(4)) == []
    got = gate.read(spark, path)
    assert got.where("v = 'flood'").count() == 200 and got.count() == 501 and gate.read(spark, path, 1).where("v = 'flood'").count() == 0


def test_gated_stream(spark, tmp_path):
    path = str(tmp_path / "t")
    gate.create(spark.range(300).select(F.col("id").alias("k"), F.lit("old").alias("v")), path, "k", 4)
    for name, low, high in (("a", 0, 20), ("b", 20, 170), ("c", 160, 180)):
        spark.range(low, high).select(F.col("id").alias("k"), F.lit(name).alias("v")).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    gate.guarded_merge(stream, path, merge, [], str(tmp_path / "c"), 0).awaitTermination()
    assert gate.latest(spark, path) == 3
    assert {(r.v, r["count"]) for r in gate.read(spark, path).groupBy("v").count().collect()} == {("old", 260), ("a", 20), ("c", 20)}
    held = gate.held_versions(spark, path, range(5))
    assert len(held) == 1 and gate.accept(spark, path, held[0], merge, []) == 4
    assert gate.read(spark, path).where("v = 'b'").count() == 150


def test_proposals(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    day = lambda n: T0 + dt.timedelta(days=n)
    batches = [
        [("x", 1, "f1", None, day(0)), ("y", 2, "g1", None, day(0)), ("x", 3, "f1", None, day(1)), ("x", 4, "f2", None, day(2)), ("z", 5, None, None, day(2))],
        [("x", 6, None, "rejected", day(3)), ("x", 7, "f2", None, day(4)), ("x", 8, "f3", None, day(5)), ("y", 9, None, None, day(5)), ("y", 10, "g1", None, day(6))],
        [("w", 11, "h", None, day(50))],
        [("x", 12, None, "approved", day(51)), ("x", 13, "f2", None, day(52)), ("y", 14, None, "rejected", day(53))],
    ]
    schema = "target string, seq long, fingerprint string, decision string, ts timestamp"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    try:
        for k in range(len(batches)):
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / f"b[0-{k}]"))
            jobs.proposals(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        got = {r.seq: r.outcome for r in spark.read.parquet(out).collect()}
        left = spark.read.format("statestore").option("stateVarName", "rejected").load(check).count()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == {
        1: "added", 2: "added", 3: "unchanged", 4: "updated", 5: "nothing to supersede", 6: "decided", 7: "remembered", 8: "added", 9: "superseded", 10: "added", 11: "added", 12: "decided", 13: "added", 14: "decided",
    }
    assert left == 1  # the rejection of the first days is forgotten, the last one is not
