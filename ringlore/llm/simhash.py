"""Near duplicates by SimHash, with pivot distance tables.

Fingerprints: a bit is set where over half of the text's shingle hashes have it.  Linking is exact for
every pair of at most three differing bits.  For each distinct fingerprint a table row holds its Hamming
distances to ``PIVOTS`` reference fingerprints (pivots).  By the triangle inequality the distances of a
linked pair differ by three at most, so pairs with a larger coordinate difference are discarded, and
the survivors' bits are compared.

Distances in Hamming space concentrate, so a pivot table alone discards but does not index: pairs are
brought together by keys.  With the bits cut into five blocks, a linked pair agrees on two whole blocks
at least, so it meets under one of ten keys.  Under a key that more than ``HOT`` fingerprints share, the table
brings pairs together: its first ``BANDED`` distances, in bands of ``BAND``, are a row's cell, and a row near
it has a cell beside it.  What stands in a cell that is hot still (clusters of texts that are all near each other)
goes on to keys of 13 of 16 blocks, under which no more than 4,096 distinct fingerprints exist; so no group is
unbounded and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import join_per_key, text_of, written
from .textcodes import slices

SEED, BITS, MOST_BITS, PIVOTS = 42, 64, 3, 32
#: blocks of the first and the last keys; fingerprints from which a key or cell counts as hot; pivots and width of cells
COARSE, FINE, HOT, BANDED, BAND = 5, 16, 500, 6, 8


def shingle_hashes(text: str, words: int) -> list[int]:
    """XXH64 of each shingle of ``words`` words, repeats included; fewer words are one shingle."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know ASCII letters and white space only, as is asked for
    parts = text.encode().lower().split()
    if len(parts) <= words:
        return [xxh64_intdigest(b" ".join(parts), SEED)] if parts else []
    return list(map(xxh64_intdigest, map(b" ".join, zip(*(parts[i:] for i in range(words)))), repeat(SEED)))


def majority_bits(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint (uint64) of each run of hashes; an empty run gives zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    n = sizes[full]
    starts = np.cumsum(n) - n
    # up to 255 rows of 64 one-byte counters are added as 8 words without a carry
    per = -(-n // 255)
    block = np.repeat(starts, per) + 255 * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    counts = np.empty((len(block), 8), np.uint64)
    step = 256
    for a in range(0, len(block), step):
        lo, hi = block[a], block[a + step] if a + step < len(block) else len(hashes)
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts[a : a + step] = np.add.reduceat(bits.view(np.uint64), block[a : a + step] - lo, axis=0)
    ones = np.add.reduceat(counts.view(np.uint8).reshape(-1, BITS), np.cumsum(per) - per, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def prints_of(texts: list[str], words: int = 3) -> np.ndarray:
    """The fingerprint (uint64) of each text."""
    each = [np.array(shingle_hashes(t, words), np.uint64) for t in texts]
    return majority_bits(np.concatenate(each), np.array([len(h) for h in each], np.int64))


def _fingerprint_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints = prints_of(batch.column("text").to_pylist(), words)
            yield pa.record_batch([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp`` (64 bits as a signed long) of every document; null and empty texts have 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_fingerprint_task(words), T.StructType([rows.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pivot_rows() -> Column:
    """Distances to the pivots, eight in a long, a byte each.  A pivot is the hash of its number."""
    each = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64(F.lit(i)))).cast("long"), 8 * (i % 8)) for i in range(PIVOTS)]
    return F.struct(*[reduce(lambda a, b: a.bitwiseOR(b), each[i : i + 8]).alias(f"d{i // 8}") for i in range(0, PIVOTS, 8)])


def distance_to_pivot(pivots: Column, i: int) -> Column:
    return F.shiftrightunsigned(pivots[f"d{i // 8}"], 8 * (i % 8)).bitwiseAND(F.lit(255))


def near_by_pivots(a: Column, b: Column) -> Column:
    """Whether no coordinate of the two table rows differs by more than ``MOST_BITS``."""
    return reduce(lambda x, y: x & y, [F.abs(distance_to_pivot(a, i) - distance_to_pivot(b, i)) <= MOST_BITS for i in range(PIVOTS)])


def _times(cells: Column, bands: Column) -> Column:
    return F.flatten(F.transform(cells, lambda c: F.transform(bands, lambda b: c * 16 + b)))


def _cells(pivots: Column, neighbours: bool) -> Column:
    """The cell of a table row: its bands of the first ``BANDED`` pivots; or all cells that a row near it may have."""
    cells = F.array(F.lit(0).cast("long"))
    for i in range(BANDED):
        d = distance_to_pivot(pivots, i)
        reach = [F.greatest(d - MOST_BITS, F.lit(0)), d + MOST_BITS] if neighbours else [d]
        bands = F.array_distinct(F.array(*[F.floor(x / BAND).cast("long") for x in reach]))
        cells = _times(cells, bands)
    return cells


def _masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [_signed(sum(block[i] for i in keep)) for keep in combinations(range(blocks), blocks - MOST_BITS)]


def _keyed(nodes: DataFrame, blocks: int) -> DataFrame:
    """Each node under its bits of each choice of whole blocks; the choice and the bits are one key."""
    keys = F.array(*[F.xxhash64(F.lit(m), F.col("fp").bitwiseAND(F.lit(m))) for m in _masks(blocks)])
    return nodes.select("fp", "pivots", F.explode(keys).alias("key"))


def _survivors(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that meet under a key and that the pivot table doesn't discard."""
    a, b = a.alias("a"), b.alias("b")
    meets = reduce(lambda x, y: x & y, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in on]) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, meets & near_by_pivots(F.col("a.pivots"), F.col("b.pivots"))).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def _shared(keyed: DataFrame, on: list[str], label: str) -> DataFrame:
    return written(keyed.groupBy(*on).agg(F.count("*").alias("n")).where("n > 1"), label)


def linked_pairs(prints: DataFrame) -> DataFrame:
    """All pairs ``u < v`` of distinct fingerprints (column ``fp``, no repeats) with at most three differing bits."""
    nodes = written(prints.select("fp", _pivot_rows().alias("pivots")), "pivot-table")
    keyed = _keyed(nodes, COARSE)
    shared = _shared(keyed, ["key"], "shared-keys")
    members = written(keyed.join(shared.where(F.col("n") <= HOT).select("key"), "key"), "candidates")
    found = [_survivors(members, members, ["key"])]
    hot = shared.where(F.col("n") > HOT)
    if not hot.isEmpty():
        # cells of the pivot table within each hot key: one row stands in its own cell, the other in all that may hold a near one
        rows = written(keyed.join(hot.select("key"), "key"), "hot-members")
        own = rows.withColumn("cell", F.explode(_cells(F.col("pivots"), False)))
        near = rows.withColumn("cell", F.explode(_cells(F.col("pivots"), True)))
        cells = written(own.groupBy("key", "cell").agg(F.count("*").alias("n")), "cells")
        few = cells.where(F.col("n") <= HOT).select("key", "cell")
        found.append(_survivors(own.join(few, ["key", "cell"]), near.join(few, ["key", "cell"]), ["key", "cell"]))
        full = cells.where(F.col("n") > HOT).select("key", "cell")
        if not full.isEmpty():
            nodes = written(near.join(full, ["key", "cell"]).select("fp", "pivots").distinct(), "hot-fingerprints")
            keyed = _keyed(nodes, FINE)
            members = written(keyed.join(_shared(keyed, ["key"], "shared-keys").select("key"), "key"), "candidates")
            found.append(_survivors(members, members, ["key"]))
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST_BITS
    return reduce(DataFrame.unionByName, found).where(close).distinct()


def linked_groups(nodes: DataFrame) -> DataFrame:
    """Adds to ``nodes`` (with their fingerprint ``fp``) ``group``, a long that fingerprints linked by at most three differing bits share; equal ones are linked."""
    prints = written(nodes.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    roots = connected_components(linked_pairs(prints.select("fp")))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("group"), "n")
    return join_per_key(nodes, written(placed, "linked-prints"), "fp", nodes.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` (smallest id reachable through links) of every document.

    Texts without words have fingerprint 0 and are linked like others.  Equal fingerprints are linked, so
    copies and repeated rows are one node.  Null ids are never a component's id unless it has no other.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = connected_components(linked_pairs(nodes.select("fp")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.col("n").alias("copies"), F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    ids = join_per_key(placed, groups, "root", placed.count()).select("fp", "component_id", F.col("copies").alias("n"))
    return join_per_key(prints, written(ids, "components"), "fp", prints.count()).select("doc_id", "fp", "component_id")
