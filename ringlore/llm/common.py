"""What the operators share: written tables, names, running totals, row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shuffles import join_per_key
from ..storage import new_path, remove, written

__all__ = ["join_per_key", "keep_marked", "new_path", "numbered", "remove", "running_total", "text_of", "unused", "written"]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def text_of(name: str = "text") -> Column:
    """The text column with null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def keep_marked(docs: DataFrame, key: dict[str, Column], marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is marked to stay, with their own columns; of rows of one key only one.

    ``key``: how each key column of ``marks`` is told from a row.  ``marks``: the key columns and ``stays``, a row for
    each document.  Only what doesn't simply stay is joined with the documents, so their texts are not shuffled as
    long as that is few rows, and are shuffled once otherwise.
    """
    each = marks.groupBy(*key).agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    special = written(each.where("NOT stays OR n > 1").drop("n"), "special-rows")
    names = {k: unused(docs, f"_key_{i}") for i, k in enumerate(key)}
    rows = docs.withColumns({names[k]: c for k, c in key.items()})
    own = special.select(*[F.col(k).alias(f"_own_{names[k]}") for k in key], F.col("stays").alias("_own_stays"))
    same = [rows[n].eqNullSafe(own[f"_own_{n}"]) for n in names.values()]
    out = rows.join(own, same, "left_anti")
    repeated = own.where("_own_stays")
    if not repeated.isEmpty():
        out = out.unionByName(rows.join(repeated, same, "left_semi").dropDuplicates(list(names.values())))
    return out.select(*docs.columns)


def _in_ranges(df: DataFrame, order: list[Column | str], label: str) -> tuple[DataFrame, Column]:
    """``df`` written in ranges of ``order``, sorted, with ``_at`` ascending; and the number of a row's range.

    All of ``order`` decides the bounds, so no group of equal leading columns has to fit in one task.
    """
    at = F.monotonically_increasing_id()
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at), label), F.shiftright("_at", 33)


def running_total(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before this one in ``order``.

    Each range of rows is summed on its own, and the ranges' totals, one row each, are broadcast.
    """
    placed, part = _in_ranges(df, order, "ranges")
    totals = placed.groupBy(part.alias("_range")).agg(F.sum(value).alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_range", part).withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return placed.join(F.broadcast(totals), "_range").withColumn(out, (F.col("_base") + F.col("_run")).cast("long")).drop("_range", "_at", "_base", "_run")


def numbered(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds ``out``: each row's place, from 0, in ``order`` over all rows.

    The ranges' row counts, one row for each, are broadcast.  Equal rows get places in either order.
    """
    placed, part = _in_ranges(df, order, "numbered")
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    placed = placed.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return placed.withColumn(out, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_base", "_at")
