"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written


#: keys (or rows of two short columns) up to which they are sent to all tasks, and about how many of them travel as one row
MOST_SENT, TOGETHER = 8_000_000, 32
#: rows that a task sorts without spilling, if they are narrow
TASK_ROWS = 500_000


def dealt(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """``rows`` dealt by ``key`` into as many tasks as sort them in memory, not fewer than the session's shuffles have; ``n``: how many they are, else they are counted first."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, (rows.count() if n is None else n) // TASK_ROWS + 1), key)


class Keys:
    """A set of keys that rows are held against where they lie: sent to all tasks in lists by hash, or, beyond ``MOST_SENT``, by a shuffle."""

    def __init__(self, keys: DataFrame, label: str) -> None:
        """``keys``: one column; nulls are no keys."""
        keys = keys.toDF("key").where("key IS NOT NULL").distinct()
        self.rows = written(keys, label)
        self.n = self.rows.count()
        self.sent = self.n <= MOST_SENT
        self.chunks = self.n // TOGETHER + 1
        if self.n and self.sent:
            self.lists = written(self.rows.groupBy(self._chunk(F.col("key")).alias("_chunk")).agg(F.collect_list("key").alias("_keys")), label)

    def _chunk(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.chunks).cast("long"))

    def told(self, rows: DataFrame, key: Column, flag: str) -> DataFrame:
        """``rows`` with ``flag``: whether ``key`` is one of the keys; a null isn't."""
        own = [c for c in rows.columns if c != flag]
        if not self.n:
            return rows.select(*own, F.lit(False).alias(flag))
        if self.sent:
            x = rows.withColumn("_chunk", self._chunk(key)).withColumn("_key", key).join(F.broadcast(self.lists), "_chunk", "left")
            return x.select(*own, F.coalesce(F.array_contains("_keys", F.col("_key")), F.lit(False)).alias(flag))
        x = rows.withColumn("_key", key).join(self.rows.select(F.col("key").alias("_key"), F.lit(True).alias("_found")), "_key", "left")
        return x.select(*own, F.coalesce("_found", F.lit(False)).alias(flag))


#: bits of a sieve, as a power of two (32 MB), and of one of its rows
SIEVE_BITS, SIEVE_ROW_BITS = 28, 12


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` (a long, a hash) is not among ``keys``, before they meet by a shuffle; none whose key is among them is lost.

    Keys set a bit each in a table of a fixed size, which is sent to all tasks, whatever their number.
    """
    place = F.col(key).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    bits = keys.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, CAST({key} & 63 AS INT))").alias("b")).where("w IS NOT NULL").groupBy("w").agg(F.bit_or("b").alias("b"))
    all_ = keys.sparkSession.range(1 << SIEVE_BITS - 6).withColumnRenamed("id", "w").join(bits.hint("merge"), "w", "left").select("w", F.coalesce("b", F.lit(0).cast("long")).alias("b"))
    table = all_.groupBy(F.shiftright("w", SIEVE_ROW_BITS - 6).alias("_row")).agg(F.array_sort(F.collect_list(F.struct("w", "b")))["b"].alias("_bits"))
    table = written(table, "sieve")
    x = rows.withColumn("_place", place).join(F.broadcast(table), F.shiftright("_place", SIEVE_ROW_BITS) == F.col("_row"))
    word = F.get("_bits", F.shiftright("_place", 6).bitwiseAND(F.lit((1 << SIEVE_ROW_BITS - 6) - 1)).cast("int"))
    return x.withColumn("_word", word).where("shiftright(_word, CAST(_place & 63 AS INT)) & 1 = 1").select(*rows.columns)


def hinted(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, ``n`` of them, to be broadcast if they are few."""
    return F.broadcast(rows) if n <= MOST_SENT // 8 else rows


def _of_several(rows: DataFrame, key: Column) -> Keys:
    """Hashes of keys that several rows have."""
    x = rows.select(F.xxhash64(key).alias("h")).where(key.isNotNull()).repartition("h").groupBy("h").agg(F.count("*").alias("n"))
    return Keys(x.where("n > 1").select("h"), "hashes-of-several")


def all_but_first(rows: DataFrame, key: Column, order: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether they are not the first, in order of ``order``, of their key; null keys are alone.  Of rows that are alike one is the first.

    As :func:`repeats`, but rows may be alike in all columns; they are gone through twice.
    """
    often = _of_several(rows, key)
    x = often.told(rows, F.when(key.isNotNull(), F.xxhash64(key)), "_often")
    alone = x.where("NOT _often").drop("_often").withColumn(flag, F.lit(False))
    if not often.n:
        return alone
    n = F.row_number().over(Window.partitionBy("_own").orderBy(*order))
    return alone.unionByName(x.where("_often").withColumn("_own", key).withColumn(flag, n > 1).drop("_often", "_own"))


def repeats(rows: DataFrame, key: Column, order: list[str], flag: str) -> DataFrame:
    """``rows`` with ``flag``: whether a row before it, in order of ``order``, has the same key; null keys repeat nothing.

    Hashes of keys are shuffled, not rows: only rows of a hash that two have are sorted.  Rows that are alike in key and ``order`` are one, so ``order`` should tell rows apart.
    """
    often = _of_several(rows, key)
    mark = F.struct(key.alias("key"), *order)
    some = often.told(rows, F.xxhash64(key), "_often").where("_often").where(key.isNotNull()).select(mark.alias("key"), key.alias("own"), *order)
    n = F.row_number().over(Window.partitionBy("own").orderBy(*order))
    later = some.withColumn("n", n).where("n > 1").select("key") if often.n else some.select("key").limit(0)
    return Keys(later, "later-rows").told(rows, mark, flag)


def join_per_key(rows: DataFrame, table: DataFrame, key: str | list[str], total: int, most_heavy: int = 1000) -> DataFrame:
    """``rows`` inner-joined with ``table``, which has one row per key and, in ``n``, how many rows have that key.

    ``total``: the number of rows, or more.  Keys of more than ``total / most_heavy`` rows (and of more than 64), fewer
    than ``most_heavy`` by arithmetic, are broadcast and their rows dealt evenly; the others meet by a shuffle.
    Keys are one or several columns, the first of them a long or a string.
    """
    keys = [key] if isinstance(key, str) else key
    limit = max(64, total // most_heavy)
    own = [c for c in table.columns if c not in keys]
    heavy = table.where(F.col("n") > limit).select(*keys, F.struct(*own).alias("_heavy"))
    rest = table.where(F.col("n") <= limit).select(F.col(keys[0]).alias("_key"), *keys[1:], F.struct(*own).alias("_rest"))
    x = rows.join(F.broadcast(heavy), keys, "left")
    # a heavy key's rows are sent anywhere; what they might meet there is not looked at
    anywhere = F.xxhash64(*rows.columns).cast(rows.schema[keys[0]].dataType)
    x = x.withColumn("_key", F.when(F.col("_heavy").isNotNull(), anywhere).otherwise(F.col(keys[0])))
    x = x.join(rest, ["_key", *keys[1:]], "left").withColumn("_found", F.coalesce("_heavy", "_rest")).where("_found IS NOT NULL")
    return x.select(*rows.columns, "_found.*")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], strict: bool = False, ties: list[str] | None = None) -> DataFrame:
    """JOIN11, JOIN12: each row of ``left`` with ``values`` of the last row of ``right`` of its key at or before (``strict``: before) its own ``at``.

    Of right rows of one key and time the last in order of ``ties`` counts (none given: of their values).  Rows of ``left`` without a match, or
    with a null key or time, have nulls.  Both sides are dealt by ranges of (key, time), so a key of any size falls into several
    tasks, by one shuffle.  A task goes through its range in order and leaves the rows of ``left`` alone, with what it found, and the last value of
    the range, a row, which is carried into the next ones of its key.
    """
    ties = ties or values
    own, theirs = F.struct(*left.columns), F.struct(*values)
    known = right.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    shape = [F.col(key).alias("key"), F.col(at).alias("at")]
    # at the same time, what is looked up stands before who looks, or behind
    a = left.select(*shape, F.lit(0 if strict else 1).alias("side"), F.lit(None).cast(known.select(F.struct(*ties)).schema[0].dataType).alias("tie"), own.alias("own"), F.lit(None).cast(known.select(theirs).schema[0].dataType).alias("value"))
    b = known.select(*shape, F.lit(1 if strict else 0).alias("side"), F.struct(*ties).alias("tie"), F.lit(None).cast(left.select(own).schema[0].dataType).alias("own"), theirs.alias("value"))
    order = ["key", "at", "side", "tie"]
    rows = a.unionByName(b).repartitionByRange(*order, F.xxhash64("own")).sortWithinPartitions(*order).select("key", "own", "value")
    name = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    done = written(rows.mapInArrow(_last_values, f"range int, key {name['key']}, own {name['own']}, found {name['value']}"), "as-of-found")
    # the last value of each range, none if it has no value, and the last one before a range; a row for each range
    ends = done.where("own IS NULL").select("range", F.when(F.col("found").isNotNull(), F.struct(F.col("key"), F.col("found").alias("value"))).alias("end"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("range", F.last("end", ignorenulls=True).over(before).alias("end"))
    out = done.where("own IS NOT NULL").join(F.broadcast(carried), "range")
    found = F.coalesce("found", F.when(F.col("end.key") == F.col("key"), F.col("end.value")))
    found = F.when(F.col("own").getField(key).isNotNull() & F.col("own").getField(at).isNotNull(), found)
    return out.select("own.*", *[found.getField(v).alias(v) for v in values])


def _last_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that have ``own``, each with the last ``value`` of its key so far; at the end a row without ``own`` that has the last value of all and its key, or nulls."""
    number, last = TaskContext.get().partitionId(), None

    def made(rows: pa.Table, found: pa.Array) -> list[pa.RecordBatch]:
        t = pa.table({"range": pa.repeat(pa.scalar(number, pa.int32()), rows.num_rows), "key": rows["key"], "own": rows["own"], "found": found})
        return t.combine_chunks().to_batches()

    for batch in batches:
        x = pa.Table.from_batches([batch])
        # the value carried from the batch before stands in front
        x = pa.concat_tables([last, x]) if last is not None else x
        x = x.combine_chunks()
        place = np.where(x["value"].is_valid().to_numpy(), np.arange(x.num_rows), -1)
        place = np.maximum.accumulate(place)
        asks = np.nonzero(x["own"].is_valid().to_numpy())[0]
        at = place[asks]
        same = pc.fill_null(pc.equal(x["key"].take(asks), x["key"].take(np.maximum(at, 0))), False).to_numpy() & (at >= 0)
        yield from made(x.take(asks), x["value"].take(pa.array(at, mask=~same)))
        if len(place):
            # a null row while there is no value
            last = x.slice(place[-1], 1) if place[-1] >= 0 else x.take(pa.array([None], pa.int64()))
    if last is not None:
        yield from made(last, last["value"])
