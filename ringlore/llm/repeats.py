"""Substring dedup: every window of ``WINDOW`` words that stands earlier in the corpus, found with an FM-index per shard.

A window is routed by its *anchor*: the leftmost run of ``GRAM`` words with the least hash in it.  Equal windows have equal anchors, so all
that can be equal meets in one shard.  Neighbouring windows with one anchor are a *piece* (up to ``WINDOW - GRAM + 1`` windows), and only anchors that
occur twice or more can hold a repeat, so most text never leaves its document.  (Within a piece no two windows are equal: the anchor
would stand at another distance.)

Of pieces with the same words the first in order of (id, place) stands for all, and in the others every window is a repeat.  First pieces
whose anchor has other pieces too go to shards of some ``SHARD_WORDS`` words.  Each shard is indexed (:mod:`.fm_index`), and its pieces stream through
the index: matching statistics by backward search give the windows that stand elsewhere, and the first of each stays.  An
anchor with more than ``MOST_PIECES`` different pieces would not fit a shard; its windows are settled one by one, by digest.

Hashes only route and group: an anchor's pieces count as the same when 64 bits of their words and of the anchor agree; everything else is compared by its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shuffles import join_per_key
from .common import text_of, written
from .fm_index import repeated_windows
from .textcodes import slices

WINDOW, GRAM, SHARD_WORDS, MOST_PIECES = 20, 5, 250_000, 4096
#: share of documents that tell which anchors are hot; rows among them from which one is; tasks that share a hot anchor's rows
HOT_SAMPLE, HOT_SHARE, SALTS = 64, 2e-4, 64
#: a piece's place is its first word's number times this, plus its number of windows
PLACE = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE)
    down = np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of each word, number of words before each text).  Words are runs of anything but ASCII white space; no nulls."""
    from xxhash import xxh64_intdigest

    texts = texts.cast(pa.string())
    at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at -= at[0]
    space = _SPACE[data]
    start = ~space
    begins = np.zeros(len(data) + 1, bool)
    begins[at] = True
    start[1:] &= space[:-1] | begins[1:-1]
    start = np.flatnonzero(start)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(at), np.int64)
    solid = np.flatnonzero(~space)
    ends = np.append(np.searchsorted(solid, start), len(solid)).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data[solid])]).dictionary_encode()
    each = np.fromiter(map(xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return each[words.indices.to_numpy(zero_copy_only=False)], np.searchsorted(start, at)


def pieces_of(words: np.ndarray, begins: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor's hash, piece's hash, first word within the text, number of windows) of each piece of the texts."""
    none = np.empty(0, np.int64)
    sizes = np.diff(begins)
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = np.flatnonzero(text[: len(words) - window + 1] == text[window - 1 :]) if len(words) >= window else none
    if not len(whole):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for i in range(gram):
        grams = grams * BASE + words[i : len(words) - gram + 1 + i]
    grams = _mixed(grams)
    # leftmost least of each run of grams: runs of 1, 2, 4, ... and at last two runs that overlap
    wide, at = window - gram + 1, np.arange(len(grams))
    size = 1
    while size < wide:
        step = min(size, wide - size)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        size += step
    at = at[whole]
    cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])
    first, n = whole[cut], np.diff(np.r_[cut, len(whole)])
    up, down = _powers(1 << int(len(words)).bit_length())
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    inside = (before[first + n + window - 1] - before[first]) * down[first]
    return text[first], grams[at[cut]], _mixed(inside + n.astype(np.uint64)), first - begins[text[first]], n


def _pieces_task(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            text, anchor, piece, first, n = pieces_of(*word_hashes(batch.column("text")), window, gram)
            own = batch.select(["doc_id", "tie"]).take(pa.array(text))
            longs = [pa.array(x) for x in (anchor.view(np.int64), piece.view(np.int64), first * PLACE + n)]
            yield pa.record_batch([*own.columns, *longs], names=["doc_id", "tie", "anchor", "piece", "at"])

    return run


def _asked_task(window: int, fields: list[str]):
    """The words of the asked pieces; of pieces of hot anchors each window on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        for batch in slices(batches, "text", 1 << 20):
            rows, anchors, places, words, digests = [], [], [], [], []
            for row, (text, asked) in enumerate(zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist())):
                parts = text.encode().split()
                for x in asked:
                    first, n = divmod(x["at"], PLACE)
                    if x["shard"] is not None:
                        each = [(x["shard"], x["at"], b" ".join(parts[first : first + n + window - 1]), None)]
                    else:
                        each = [(None, i * PLACE + 1, None, sha256(b" ".join(parts[i : i + window])).digest()) for i in range(first, first + n)]
                    for shard, at, piece, digest in each:
                        rows.append(row)
                        anchors.append(shard)
                        places.append(at)
                        words.append(piece)
                        digests.append(digest)
            own = batch.select(["doc_id", "tie"]).take(pa.array(rows, pa.int64()))
            yield pa.record_batch([*own.columns, pa.array(anchors, pa.int64()), pa.array(places, pa.int64()), pa.array(words, pa.binary()), pa.array(digests, pa.binary())], names=fields)

    return run


def _search_task(window: int):
    """Rows of one shard after the other, in order of position: those with repeated windows, a bit for each."""

    def found(rows: list[tuple]) -> Iterator[tuple]:
        for row, again in zip(rows, repeated_windows([r[3].split() for r in rows], window)):
            if again.any():
                yield *row[:3], sum(1 << i for i in np.flatnonzero(again).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard, schema = [], None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found(rows))) or [()] * 4
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, schema)], names=["doc_id", "tie", "at", "mask"])

        for batch in batches:
            schema = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.int64()]
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "tie", "at", "words"))):
                if s != shard and held:
                    yield out(held)
                    held = []
                shard = s
                held.append(row)
        if held:
            yield out(held)

    return run


def _kept_task(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            totals, gone, kept = [], [], []
            for text, again, copy in zip(*(batch.column(c).to_pylist() for c in ("text", "again", "copy"))):
                parts = text.encode().split()
                n = len(parts)
                if copy and n >= window:
                    covered, parts = n, []
                elif again:
                    edge = np.zeros(n + 1, np.int64)
                    place = np.array([x["at"] for x in again], np.int64) // PLACE
                    mask = np.array([x["mask"] for x in again], np.int64)
                    for i in range(PLACE):
                        hit = place[(mask >> i) & 1 == 1] + i
                        if len(hit):
                            np.add.at(edge, hit, 1)
                            np.add.at(edge, hit + window, -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    covered = n - int(stays.sum())
                    parts = [parts[i] for i in np.flatnonzero(stays).tolist()]
                else:
                    covered = 0
                totals.append(n)
                gone.append(covered)
                kept.append(b" ".join(parts))
            yield pa.record_batch([batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return run


def _position() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "at")


def _repeats(rows: DataFrame, window: int, gram: int, most_pieces: int, shard_words: int) -> DataFrame:
    """``doc_id``, ``tie``, ``at`` and ``mask`` (a bit a window) of pieces with repeated windows.  ``rows``: one for each (``doc_id``, ``tie``)."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    task = _pieces_task(window, gram)
    schema = f"doc_id {kind}, tie long, anchor long, piece long, at long"
    # anchors that many documents share are dealt over several tasks; which ones they are is no part of the result
    some = rows.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(HOT_SAMPLE)) == 0).mapInArrow(task, schema).groupBy("anchor").agg(F.count("*").alias("n"))
    some = written(some.where("n > 1"), "sampled-anchors")
    sampled = some.agg(F.sum("n")).first()[0] or 0
    hot = some.where(F.col("n") > max(32.0, HOT_SHARE * sampled)).select("anchor", F.lit(True).alias("hot"))
    each = rows.mapInArrow(task, schema).join(F.broadcast(hot), "anchor", "left")
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id", "tie", "at"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    counted = each.withColumn("n", F.count("*").over(W.partitionBy("anchor", salt)))
    met = written(counted.where("n > 1 OR hot").select("doc_id", "tie", "anchor", "piece", "at"), "met-pieces")
    # the first of the pieces with the same words, and how many there are under each anchor
    firsts = written(met.groupBy("anchor", "piece").agg(F.min(_position()).alias("first"), F.count("*").alias("n")), "first-pieces")
    others = join_per_key(met, firsts.where("n > 1"), ["anchor", "piece"], met.count()).where(_position() != F.col("first"))
    found = [others.select("doc_id", "tie", "at", (F.expr(f"shiftleft(1L, cast(at % {PLACE} AS int))") - 1).alias("mask"))]
    anchors = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    asked = join_per_key(firsts.select("anchor", "first"), anchors, "anchor", firsts.count())
    asked = written(asked.select("anchor", "n", "first.*"), "asked-pieces")
    words = asked.where(F.col("n") <= most_pieces).agg(F.sum(F.col("at") % PLACE + window - 1)).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    shard = F.when(F.col("n") <= most_pieces, F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    by_doc = asked.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("at", shard.alias("shard"))).alias("asked"))
    by_doc = by_doc.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "asked")
    texts = rows.join(by_doc, rows["doc_id"].eqNullSafe(by_doc["_id"]) & (rows["tie"] == by_doc["_tie"])).select("doc_id", "tie", "text", "asked")
    fields = ["doc_id", "tie", "shard", "at", "words", "digest"]
    pieces = written(texts.mapInArrow(_asked_task(window, fields), f"doc_id {kind}, tie long, shard long, at long, words binary, digest binary"), "piece-words")
    sharded = pieces.where("shard IS NOT NULL").select("shard", F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie", "at", "words")
    sharded = sharded.repartition(max(1, min(shards, 20_000)), "shard").sortWithinPartitions("shard", "no_id", "doc_id", "tie", "at")
    found.append(sharded.mapInArrow(_search_task(window), f"doc_id {kind}, tie long, at long, mask long"))
    single = pieces.where("digest IS NOT NULL").select("doc_id", "tie", "at", F.hex("digest").alias("digest"))
    heads = single.groupBy("digest").agg(F.min(_position()).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = join_per_key(single, heads, "digest", max(1, firsts.count() * PLACE)).where(_position() != F.col("first"))
    found.append(again.select("doc_id", "tie", "at", F.lit(1).cast("long").alias("mask")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, most_pieces: int = MOST_PIECES, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Each document without the words that a repeated window covers: id, ``n_words``, ``n_removed``, ``kept`` (words joined by one space).

    A window is ``window`` words in a row, of which ``gram`` route it; it is repeated if the same words also start earlier: in a document of a smaller
    id or further left in the same.  Windows are judged on the texts as given.  Texts of fewer words stay whole; a null text has no words.  A null id comes after all
    others; documents of one id are ordered by the hash of their text; of repeated rows (same id and text) one is first.  Other
    columns are not read.  No documents give no rows.
    """
    if not 1 <= window - gram + 1 < PLACE:
        raise ValueError(f"window - gram must be from 0 to {PLACE - 2}")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.isEmpty():
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
        firsts, every = rows, rows.withColumn("copy", F.lit(False))
    else:
        rows = written(rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()), "tied-documents")
        first = rows.groupBy("doc_id", "tie").agg(F.min("row").alias("row"), F.count("*").alias("n")).where("n > 1")
        first = first.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), F.col("row").alias("_row"))
        every = rows.join(first, rows["doc_id"].eqNullSafe(first["_id"]) & (rows["tie"] == first["_tie"]), "left")
        every = written(every.select("doc_id", "text", "tie", F.coalesce(F.col("row") != F.col("_row"), F.lit(False)).alias("copy")), "marked-copies")
        firsts = every.where("NOT copy").drop("copy")
    marks = _repeats(firsts, window, gram, most_pieces, shard_words).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("at", "mask")).alias("again"))
    marks = marks.select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "again")
    marked = every.join(marks, every["doc_id"].eqNullSafe(marks["_id"]) & (every["tie"] == marks["_tie"]), "left").select("doc_id", "text", "again", "copy")
    names = [id_col, "n_words", "n_removed", "kept"]
    return marked.mapInArrow(_kept_task(window, names), f"`{id_col}` {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept string")
