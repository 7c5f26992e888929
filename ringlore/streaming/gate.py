"""STR02, STR03: a stored table that batches are merged into unless they change too much of it; refused batches are held until they are accepted.

The table lies in hash buckets of its key.  Version ``v`` is a manifest, a row for each bucket that says in which version's folder its rows are, so a
batch writes only the buckets it touches, and the manifest, written last, makes it count.  A batch that is run again starts from the version
before it and writes the same again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..storage import remove

# A batch is refused over this share of the rows it touches, from so many changed rows on, and over so many changes in any case.
MOST_SHARE, FROM_ROWS, MOST_CHANGES = 0.3, 100, 2000
BUCKETS = 64

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(rows: DataFrame, path: str, version: int) -> DataFrame:
    """Writes bucketed rows as this version's files; the buckets that have any."""
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={version}")
    return rows.select("bucket").distinct().select("bucket", F.lit(version).cast("long").alias("version"))


def create(table: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    """A new stored table, version 0. Keys are not null and don't repeat."""
    spark = table.sparkSession
    table.limit(0).write.parquet(f"{path}/shape")
    spark.createDataFrame([(key, buckets)], "key string, buckets int").write.parquet(f"{path}/about")
    _write(_bucketed(table, key, buckets), path, 0).coalesce(1).write.parquet(f"{path}/manifest/v=0")


def about(spark: SparkSession, path: str) -> tuple[str, int]:
    row = spark.read.parquet(f"{path}/about").first()
    return row["key"], row["buckets"]


def latest(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/manifest").agg(F.max("v")).first()[0]


def _manifest(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("bucket int, version long").parquet(f"{path}/manifest/v={version}")


def _rows(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    # a manifest has a row a bucket at most
    files = [f"{path}/data/v={r['version']}/bucket={r['bucket']}" for r in manifest.collect()]
    shape = spark.read.parquet(f"{path}/shape")
    return spark.read.schema(shape.schema).parquet(*files) if files else shape


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table, as it is or as of a version."""
    return _rows(spark, path, _manifest(spark, path, latest(spark, path) if version is None else version))


def changes(held: DataFrame, batch: DataFrame, key: str, results: list[str]) -> DataFrame:
    """STR02: what a batch changes of rows that are held: ``key``, ``field``, ``old``, ``new`` (texts), ``kind`` (fill, clear, replace).

    The fields of a result are one change.  Rows that are new change nothing.
    """
    fields = [c for c in batch.columns if c in held.columns and c != key and c not in results]
    text = lambda side, c: F.col(f"{side}.{c}").cast("string")
    both = lambda side: F.when(F.coalesce(*[text(side, c) for c in results]).isNotNull(), F.to_json(F.struct(*[text(side, c).alias(c) for c in results]), {"ignoreNullFields": "false"}))
    each = [F.struct(F.lit(c).alias("field"), text("h", c).alias("old"), text("b", c).alias("new")) for c in fields]
    each += [F.struct(F.lit("result").alias("field"), both("h").alias("old"), both("b").alias("new"))] if results else []
    x = held.alias("h").join(batch.alias("b"), F.col(f"h.{key}") == F.col(f"b.{key}")).select(F.col(f"h.{key}").alias(key), F.explode(F.array(*each)).alias("c")).select(key, "c.*")
    kind = F.when(F.col("old").isNull(), "fill").when(F.col("new").isNull(), "clear").otherwise("replace")
    return x.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("kind", kind)


def is_flood(changed: DataFrame, key: str, touched: int) -> bool:
    """STR03: whether so much changes that somebody should look at it first."""
    n = changed.agg(F.countDistinct(key).alias("rows"), F.count("*").alias("all")).first()
    return n["all"] > MOST_CHANGES or n["rows"] >= FROM_ROWS and n["rows"] > MOST_SHARE * touched


def apply(batch: DataFrame, path: str, version: int, merge: Merge, results: list[str], unless_flood: bool = True) -> bool:
    """Makes ``version`` of the version before it and a batch; False if the batch is held instead (the table then stays as it was)."""
    spark = batch.sparkSession
    key, buckets = about(spark, path)
    before = _manifest(spark, path, version - 1)
    new = _bucketed(batch, key, buckets)
    touched = new.select("bucket").distinct()
    held = _rows(spark, path, before.join(touched, "bucket"))
    refused = unless_flood and is_flood(changes(held, batch, key, results), key, batch.join(held, key, "left_semi").count())
    if refused:
        batch.write.mode("overwrite").parquet(f"{path}/held/v={version}")
        after = before
    else:
        written = _write(_bucketed(merge(held, batch), key, buckets), path, version)
        after = before.join(touched, "bucket", "left_anti").unionByName(written)
    after.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={version}")
    return not refused


def held_versions(spark: SparkSession, path: str, versions: range) -> list[int]:
    """Which of these versions' batches are held."""
    jvm = spark.sparkContext._jvm
    at = lambda v: jvm.org.apache.hadoop.fs.Path(f"{path}/held/v={v}/_SUCCESS")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return [v for v in versions if at(v).getFileSystem(conf).exists(at(v))]


def accept(spark: SparkSession, path: str, version: int, merge: Merge, results: list[str]) -> int:
    """Merges a held batch after all; the version that has it."""
    batch = spark.read.parquet(f"{path}/held/v={version}")
    now = latest(spark, path) + 1
    apply(batch, path, now, merge, results, unless_flood=False)
    remove(spark, f"{path}/held/v={version}")
    return now


def guarded_merge(stream: DataFrame, path: str, merge: Merge, results: list[str], checkpoint: str, start: int) -> StreamingQuery:
    """Every batch of a stream as a version after ``start``, the table's version when the stream's checkpoint was new."""
    into = lambda batch, number: apply(batch, path, start + number + 1, merge, results)
    return stream.writeStream.foreachBatch(into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
