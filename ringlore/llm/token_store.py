"""Content-addressed store of token ids, in tables of the shared folder.

``write_store`` encodes the documents and cuts each id stream where a rolling hash over ``WINDOW`` ids asks
for it, so that equal stretches give equal chunks wherever they stand.  The store has three tables:

* ``chunks``: ``digest`` (SHA-256 of the ids as little-endian unsigned 32-bit integers), ``payload`` (the ids
  in as few bytes as the vocabulary needs, by zstandard), each digest once;
* ``recipes``: one row per document in ascending id order: ``start`` (ids of all documents before it),
  ``n_tokens``, the digests of its chunks in order, and ``root``, their Merkle root;
* ``manifest``: a Merkle tree over the recipes, level by level; the highest level is the store's root.

``read_store`` holds the recipes against the manifest, rebuilds every document from its recipe and the chunks, and
verifies every digest and root.  A chunk that very many documents share is one key of that join: adaptive execution
splits its documents among tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, remove, running_total, text_of, written
from .textcodes import as_binary, library_coder, slices

WINDOW, LEAST, MEAN_BITS, MOST = 32, 128, 10, 8192
#: digests that a task remembers in order not to send a chunk twice
REMEMBERED = 200_000


def rolling_hash(ids: np.ndarray) -> np.ndarray:
    """At each place the gear hash of the last ``WINDOW`` ids: the sum of each one's hash, shifted by its age."""
    h = ids.astype(np.uint32) * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(13)
    age = 1
    while age < WINDOW:
        h[age:] += h[:-age].copy() << np.uint32(age)
        age *= 2
    return h


def cut_points(ids: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """For each document ``ids[at[i]:at[i + 1]]``, the ends of its chunks.

    A chunk has ``LEAST`` ids at least (or is a document's last), so a window never reaches beyond its document.
    """
    asked = np.flatnonzero(rolling_hash(ids) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    first, last = np.searchsorted(asked, at[:-1], "right"), np.searchsorted(asked, at[1:], "left")
    out = []
    for a, b, i, j in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), last.tolist()):
        ends = []
        for cut in [*asked[i:j].tolist(), b]:
            while cut - a > MOST:
                a += MOST
                ends.append(a)
            if cut - a >= LEAST or cut == b and cut > a:
                ends.append(cut)
                a = cut
        out.append(ends)
    return out


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over the leaves; an odd node moves up as it is; of none, the hash of nothing."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        up = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = up + level[len(up) * 2 :]
    return level[0]


CHUNKS, RECIPES = "digest binary, n long, payload binary", "doc_id long, start long, n_tokens long, digests array<binary>, root binary"
MANIFEST = "level int, at long, documents long, tokens long, hash binary"
STAGED = "row long, doc_id long, n_tokens long, digests array<binary>, root binary, digest binary, n long, payload binary"


def _stage_task(tokenizer: str, end_id: int, width: int):
    names = [c.split()[0] for c in STAGED.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(tokenizer, True)
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress
        row, sent = TaskContext.get().partitionId() << 40, set()
        for batch in slices(batches, "text", 1 << 20):
            flat, at = coder.encode(batch.column("text"))
            ids = np.insert(flat, at[1:], np.uint32(end_id)).astype("<u4")
            at = at + np.arange(len(at))
            narrow = ids.astype(f"<u{width}")
            docs, chunks = [], []
            for doc, start, ends in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), cut_points(ids, at)):
                digests, a = [], start
                for b in ends:
                    digests.append(d := hashlib.sha256(ids[a:b].data).digest())
                    if d not in sent:
                        sent.add(d)
                        chunks.append((d, b - a, squeeze(narrow[a:b].data)))
                    a = b
                docs.append((row, doc, a - start, digests, merkle_root(digests)))
                row += 1
            if len(sent) > REMEMBERED:
                sent.clear()
            gap = [None] * len(chunks)
            some = [[*x, *gap] for x in zip(*docs)] + [[None] * len(docs) + list(x) for x in zip(*chunks)]
            if not chunks:
                some += [[None] * len(docs)] * 3
            yield pa.record_batch([pa.array(x, k) for x, k in zip(some, kinds)], names=names)

    return run


def _vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def write_store(
    docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, width: int = 2, fan: int = 4096
) -> None:
    """Writes the store of all documents to the folder ``path``.

    A document is the ids of its text and then ``end_id``; null and empty texts are that id alone.  Documents
    of null id come first; repeated rows are documents of their own.  ``width``: bytes that hold an id (2 or 4).
    """
    spark = docs.sparkSession
    if max(end_id, _vocabulary(tokenizer) - 1) >= 1 << 8 * width:
        raise ValueError(f"{width} bytes are too few for the tokenizer's ids")
    staged = new_path(spark, "token-staging")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows.mapInArrow(_stage_task(tokenizer, end_id, width), STAGED).write.option("compression", "lz4").parquet(staged)
    both = spark.read.schema(STAGED).parquet(staged)
    # equal digests are equal chunks, so any of them will do; each task sends a digest once
    chunks = both.where("digest IS NOT NULL").select("digest", "n", "payload").groupBy("digest").agg(F.first("n").alias("n"), F.first("payload").alias("payload"))
    chunks.write.option("compression", "none").parquet(f"{path}/chunks")
    recipes = running_total(both.where("row IS NOT NULL").select("row", "doc_id", "n_tokens", "digests", "root"), ["doc_id", "row"], "n_tokens", "start")
    # files in ascending order
    recipes.repartitionByRange("start").sortWithinPartitions("start").select("doc_id", "start", "n_tokens", "digests", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")
    remove(spark, staged)
    merkle_tree(_recipes(spark, path), fan).write.parquet(f"{path}/manifest")


def _folded(nodes: DataFrame, by: Column) -> DataFrame:
    """A node over each group of nodes: the hash of their hashes in order."""
    below = F.array_sort(F.collect_list(F.struct("at", "hash")))["hash"]
    sums = [F.sum(c).alias(c) for c in ("documents", "tokens")]
    above = nodes.groupBy(by.alias("node")).agg(*sums, F.concat_ws("", F.transform(below, F.hex)).alias("hashes"))
    return above.select(F.col("node").alias("at"), "documents", "tokens", F.unhex(F.sha2("hashes", 256)).alias("hash"))


def merkle_tree(recipes: DataFrame, fan: int = 4096) -> DataFrame:
    """``level``, ``at``, ``documents``, ``tokens``, ``hash``: the tree over all recipes but for its leaves.

    A leaf is the hash of a recipe's id, place, length and root.  A node has the leaves whose ``start`` lies in a
    stretch of ``fan`` mean documents (level 0), or ``fan`` nodes below it; the highest level is one node, the store's root.
    """
    total = recipes.agg(F.count("*"), F.sum("n_tokens")).first()
    stretch = max(1, fan * (total[1] or 1) // max(1, total[0]))
    leaf = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.hex("root")), 256)
    leaves = recipes.select(F.col("start").alias("at"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), F.unhex(leaf).alias("hash"))
    nodes = written(_folded(leaves, F.expr(f"at div {stretch}L")), "merkle-level")
    levels = [nodes.select(F.lit(0).alias("level"), "*")]
    while nodes.count() > 1:
        nodes = written(_folded(nodes, F.expr(f"at div {fan}L")), "merkle-level")
        levels.append(nodes.select(F.lit(len(levels)).alias("level"), "*"))
    return reduce(DataFrame.unionByName, levels)


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def verify_manifest(spark: SparkSession, path: str, fan: int = 4096) -> bool:
    """Whether the recipes are those that the manifest was made of: none changed, lost, added or moved."""
    found, held = merkle_tree(_recipes(spark, path), fan), spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return found.exceptAll(held).isEmpty() and held.exceptAll(found).isEmpty()


def _rebuild_task(width: int, most: int = 1 << 18):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for some in slices(batches, "n_tokens", most):
            streams = []
            for parts, root, n in zip(some.column("parts").to_pylist(), some.column("root").to_pylist(), some.column("n_tokens").to_pylist()):
                parts.sort(key=itemgetter("place"))
                ids = [np.frombuffer(expand(p["payload"]), f"<u{width}").astype("<u4") if p["payload"] else np.empty(0, "<u4") for p in parts]
                if any(hashlib.sha256(x.data).digest() != p["digest"] for x, p in zip(ids, parts)) or merkle_root([p["digest"] for p in parts]) != root or sum(map(len, ids)) != n:
                    raise ValueError("the store is damaged: a chunk is lost, or a chunk or a recipe does not match its hash")
                streams.append(np.concatenate(ids))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in streams])])
            yield pa.record_batch([some.column("doc_id"), some.column("start"), some.column("n_tokens"), as_binary(np.concatenate(streams), ends)], names=["doc_id", "start", "n_tokens", "ids"])

    return run


def read_store(spark: SparkSession, path: str, width: int = 2, fan: int = 4096) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of every document.

    The recipes are first held against the manifest, then every chunk and document against its hash; a store that
    does not match raises ``ValueError`` (here, or in the task that rebuilds the document).
    """
    if not verify_manifest(spark, path, fan):
        raise ValueError("the store is damaged: the recipes are not those of the manifest")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("digest", "payload")
    places = _recipes(spark, path).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("place", "digest"))
    parts = places.join(chunks, "digest", "left").groupBy("start", "doc_id", "n_tokens", "root")
    parts = parts.agg(F.collect_list(F.struct("place", "digest", "payload")).alias("parts"))
    return parts.mapInArrow(_rebuild_task(width), "doc_id long, start long, n_tokens long, ids binary")
