"""DQ13: connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected components in MapReduce and beyond".  Each step is a minimum per node and a
join; nothing is collected, each round is a table in the shared folder, and hubs' minima are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shuffles import join_per_key
from ..storage import written


def _with_least(rows: DataFrame, total: int) -> DataFrame:
    """Adds ``m``, the least ``v`` of each ``u``; a hub's rows are not brought together."""
    least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return join_per_key(rows, least, "u", total).drop("n")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * total).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return _with_least(down, total).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) of each node that has an edge.

    ``edges``: columns ``u`` and ``v``, any direction, repeats and loops allowed.  Nulls take no part; of no edges
    there are no nodes.
    """
    edges = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    total, state = edges.count(), None
    while True:
        wide = _large_star(edges, total).where("u != v").distinct()
        edges = written(_small_star(wide, 2 * total).where("u != v").distinct(), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state, total = now, now[0]
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
