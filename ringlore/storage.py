"""Tables that are written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a local session may name none (tests, a laptop): then a folder of this machine is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ringlore-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_paths: dict[str, list[str]] = {}
#: those of the paths that are tables of the session's catalog
_tables: set[str] = set()


def new_path(spark: SparkSession, label: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_folder(spark)}/ringlore-{label}-{uuid.uuid4().hex}"
    _paths.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Deletes this application's working tables; to be called once the results that read them are saved. How many there were."""
    paths = _paths.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_table(path)}")
            _tables.discard(path)
        remove(spark, path)
    return len(paths)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: its work is done once and its lineage is cut."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table(path: str) -> str:
    return path.rsplit("/", 1)[-1].replace("-", "_")


def written_by(df: DataFrame, label: str, key: str) -> DataFrame:
    """:func:`written` as a table in buckets by ``key``, as many as shuffles have partitions: joins and groups by the key alone leave its rows where they lie.

    ``df`` should come out of a shuffle by the key, so that a bucket is one task's file.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    _tables.add(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "lz4").option("path", path).bucketBy(buckets, key).saveAsTable(_table(path))
    return spark.table(_table(path))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a working table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
