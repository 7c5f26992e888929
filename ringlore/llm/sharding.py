"""Shards by a k-d tree over document metadata.

A node of ``n`` shards is split, along the metadata dimension in which it is widest, where the bytes to the
left are to all its bytes as ``n // 2`` to ``n``; leaves are shards of near equal bytes.  The weighted medians
of all nodes of a level are found together: a histogram of bytes over each node's range, and again
over the bin where the median lies, until that bin holds next to nothing.  The driver sees histograms of
``BINS`` numbers a node; no row leaves the executors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, text_of, unused, written

BINS, TOLERANCE, TIE_BITS, COORD_BITS = 512, 0.002, 28, 24


class Node(NamedTuple):
    first: int
    shards: int


class Range(NamedTuple):
    """Where a node's median is known to lie, the bytes left of it, and the bytes that are wanted left of it."""

    low: int
    high: int
    before: int
    wanted: float


def coordinates(docs: DataFrame, names: list[str]) -> dict[str, Column]:
    """A number in [0, 1) for each dimension: size on a log scale, others by a hash of their value; null is 0."""
    size = F.log2(F.col("size").cast("double")) / 64
    hashed = {n: F.pmod(F.xxhash64(F.col(n).cast("string")), F.lit(1 << 20)) / float(1 << 20) for n in names if n in docs.columns}
    return {"size": size} | {n: F.coalesce(c, F.lit(0.0)) for n, c in hashed.items()}


def _lookup(values: dict[int, int | float | str], default: int | float | str | None = None) -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    found = F.element_at(F.create_map(*pairs), F.col("node")) if pairs else F.lit(None)
    return found if default is None else F.coalesce(found, F.lit(default))


def _medians(rows: DataFrame, wanted: dict[int, Range], smallest: float) -> dict[int, int]:
    """For each node the greatest key that goes left."""
    cut: dict[int, int] = {}
    while wanted:
        width = {k: max(1, -(-(r.high - r.low + 1) // BINS)) for k, r in wanted.items()}
        low, high = _lookup({k: r.low for k, r in wanted.items()}), _lookup({k: r.high for k, r in wanted.items()})
        inside = rows.where(F.col("node").isin(list(wanted)) & (F.col("key") >= low) & (F.col("key") <= high))
        place = F.floor((F.col("key") - low) / _lookup(width)).cast("long")
        bins: dict[int, list[tuple[int, int]]] = {k: [] for k in wanted}
        for r in inside.groupBy("node", place.alias("bin")).agg(F.sum("size").alias("size")).collect():  # BINS rows a node at most
            bins[r["node"]].append((r["bin"], r["size"]))
        narrower: dict[int, Range] = {}
        for k, r in wanted.items():
            done = r.before
            cut[k] = r.low - 1
            for b, size in sorted(bins[k]):
                start = r.low + b * width[k]
                if done + size >= r.wanted:
                    if size > smallest and width[k] > 1:
                        narrower[k] = Range(start, min(r.high, start + width[k] - 1), done, r.wanted)
                    else:
                        cut[k] = start + width[k] - 1 if done + size - r.wanted < r.wanted - done else start - 1
                    break
                done += size
                cut[k] = start + width[k] - 1
        wanted = narrower
    return cut


def metadata_rows(docs: DataFrame, dims: tuple[str, ...], id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, a whole number for each dimension (``c0``, ``c1``...) and a ``tie`` by hash of every document."""
    text = text_of(text_col)
    sized = docs.withColumn("size", (F.octet_length(text) + 16).cast("long")).withColumn("_crc", F.crc32(text)).withColumn("_row", F.monotonically_increasing_id())
    axes = coordinates(docs, list(dims))
    as_int = [F.floor(F.least(F.lit(1.0), c) * ((1 << COORD_BITS) - 1)).cast("long").alias(f"c{i}") for i, c in enumerate(axes.values())]
    tie = F.pmod(F.xxhash64(F.col(id_col), F.col("_row")), F.lit(1 << TIE_BITS)).alias("tie")
    return sized.select(F.col(id_col).alias("doc_id"), "size", F.col("_crc").alias("text_crc32"), *as_int, tie)


def shard_documents(
    docs: DataFrame, shards: int = 40, dims: tuple[str, ...] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every document.

    ``size``: UTF-8 bytes of the text (null: none) and 16.  Ties along a dimension are split by a hash of id and
    row, so equal metadata, one source with a third of all rows, or repeated rows do not make a shard larger.
    Columns of ``dims`` that are absent are left out; a null in one counts as 0.  Null ids are placed like others; of no
    documents there are no rows.  ``slot`` is the place in the shard, in order of ids.
    """
    rows = written(metadata_rows(docs, dims, id_col, text_col).withColumn("node", F.lit(0)), "kd-rows")
    n_axes = sum(c[0] == "c" and c[1:].isdigit() for c in rows.columns)
    total = rows.agg(F.sum("size")).first()[0] or 0
    smallest, nodes = TOLERANCE * total / shards, {0: Node(0, shards)}
    while any(n.shards > 1 for n in nodes.values()) and total:
        ends = [f(F.col(f"c{i}")).alias(f"{w}{i}") for i in range(n_axes) for w, f in (("low", F.min), ("high", F.max))]
        seen = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}  # a row a node
        split = {k: n for k, n in nodes.items() if n.shards > 1 and k in seen}
        if not split:
            break
        axis = {k: max(range(n_axes), key=lambda i, r=seen[k]: r[f"high{i}"] - r[f"low{i}"]) for k in split}
        chosen = F.element_at(F.array(*[F.col(f"c{i}") for i in range(n_axes)]), (_lookup(axis, 0) + 1).cast("int"))
        keyed = written(rows.withColumn("key", F.shiftleft(chosen, TIE_BITS).bitwiseOR(F.col("tie"))), "kd-keys")
        span = {k: (seen[k][f"low{a}"] << TIE_BITS, (seen[k][f"high{a}"] + 1 << TIE_BITS) - 1) for k, a in axis.items()}
        cut = _medians(keyed, {k: Range(*span[k], 0, seen[k]["bytes"] * (n.shards // 2) / n.shards) for k, n in split.items()}, smallest)
        kept, after = {k: n for k, n in nodes.items() if k not in split}, {}
        for k, n in split.items():
            after[2 * k + 1], after[2 * k + 2] = Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2)
        went = F.when(F.col("node").isin(list(split)), F.col("node") * 2 + F.when(F.col("key") <= _lookup(cut, 0), 1).otherwise(2)).otherwise(F.col("node"))
        rows = keyed.withColumn("node", went.cast("int")).drop("key")
        nodes = kept | after
    shard = _lookup({k: n.first for k, n in nodes.items()}, 0).cast("int")
    placed = numbered(rows.select("doc_id", "size", "text_crc32", shard.alias("shard")), ["shard", "doc_id"], "place")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row a shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the documents to ``path``, a folder ``shard=N`` for each shard; ids must be unique, a null id may stand once. A column of that name gets the folders an underscore."""
    key, shard = unused(docs, "_id"), unused(docs, "shard")
    own = placed.select(F.col("doc_id").alias(key), F.col("shard").alias(shard))
    docs.join(own, docs[id_col].eqNullSafe(own[key])).drop(key).write.partitionBy(shard).parquet(path)
