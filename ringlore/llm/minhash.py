"""Near duplicates by the share of word shingles: candidates by SimHash, then by MinHash bands, every link checked exactly.

Two documents are linked where the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Pairs meet under a band of four equal minima; of 16 bands a pair of similarity 0.8 shares one with
probability 0.9998, and a more similar pair with more.  Equal sets are one node.

Before the bands, texts whose SimHash fingerprints are linked (``simhash.py``: at most three differing bits, by pivot distance tables) are one
group like that of a band.  Fingerprints bring copies together; of pairs of similarity 0.8 they miss most, which the bands then find.

Pairs of a group are not all compared.  First over the linked fingerprints, then over the first ``FIRST`` bands and then over the others, each member is held against
one hub of its group, unless all of the group stand under one root already; what links puts under one root needs no further
comparison.  Members under different roots are then compared if their sizes and their distances to a hub allow it (1 less the similarity is a
metric), once a pair, and only where they share one of their rarest shingles, which every similar enough pair does; shingles that no other
member has count against a pair beforehand, and so do the bits in which parities of the sets, ``PARITY`` bits each, differ: no more than the shingles that
one of the two lacks.

What a comparison needs travels as a document's compressed text, a third of the size of its set of hashes, and the sets are made where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import connected_components
from .common import join_per_key, keep_marked, text_of, written
from .simhash import SEED, linked_groups, prints_of, shingle_hashes
from .textcodes import slices

WORDS, TENTHS = 5, 8
BANDS, ROWS, STEP, FIRST = 16, 4, 512, 4
#: pairs that one copy of a text serves
PAIRS_PER_TEXT = 4096
#: bits of a set's parity
PARITY = 1024


def _factors() -> tuple[np.ndarray, np.ndarray]:
    flips, odd = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64, endpoint=False)
    return flips, odd | np.uint64(1)


def band_keys(shingles: np.ndarray, flips: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """A key (uint64) for each band of a set of shingle hashes that is not empty."""
    least = reduce(np.minimum, [((shingles[a : a + STEP] ^ flips) * odd).min(axis=1) for a in range(0, len(shingles), STEP)])
    return (least * odd[::-1, 0]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, words), np.uint64))


def _node(shingles: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(shingles.astype("<u8").tobytes(), SEED)


def _longs(runs: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(runs).astype(np.uint64).view(np.int64)))


def _nodes(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([_node(s) for s in sets], np.uint64).view(np.int64))


def _keys_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips, odd = _factors()
        for batch in slices(batches, "text", 1 << 20):
            texts = batch.column("text").to_pylist()
            sets = [_shingle_set(t, words) for t in texts]
            keys = [band_keys(s, flips, odd) if len(s) else s for s in sets]
            sizes = pa.array([len(s) for s in sets], pa.int64())
            prints = pa.array(prints_of(texts).view(np.int64))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), _nodes(sets), sizes, prints, _longs(keys)], names=["doc_id", "text_hash", "node", "size", "fp", "keys"])

    return run


def _compressed_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zstandard import ZstdCompressor

    compress = ZstdCompressor(level=3).compress
    for batch in slices(batches, "text", 1 << 20):
        packed = [compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(packed, pa.binary())], names=["doc_id", "text_hash", "packed"])


def _unpacked(packed: bytes, words: int) -> np.ndarray:
    from zstandard import ZstdDecompressor

    return _shingle_set(ZstdDecompressor().decompress(packed).decode(), words)


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of ``PARITY`` remainders whether an odd number of shingles has it, 64 in a word (uint64)."""
    counts = np.bincount((shingles % np.uint64(PARITY)).astype(np.int64), minlength=PARITY)
    return np.packbits(counts & 1 == 1, bitorder="little").view("<u8")


def _sets_task(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "packed", 1 << 19):
            sets = [_unpacked(p, words) for p in batch.column("packed").to_pylist()]
            yield pa.record_batch([batch.column("node"), _longs(sets), _longs([parity(s) for s in sets])], names=["node", "shingles", "parity"])

    return run


def _counts_task(words: int):
    """Sizes and what is shared of each pair; rows of one ``v`` come one after the other, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, theirs = None, np.empty(0, np.uint64)
        for batch in slices(batches, "a", 1 << 19):
            sizes, shared = [], []
            for v, a, b in zip(*(batch.column(c).to_pylist() for c in ("v", "a", "b"))):
                if v != last:
                    last, theirs = v, _unpacked(b, words)
                own = _unpacked(a, words)
                sizes.append(len(own) + len(theirs))
                shared.append(len(np.intersect1d(own, theirs, assume_unique=True)))
            yield pa.record_batch([batch.column("u"), batch.column("v"), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64())], names=["u", "v", "sizes", "shared"])

    return run


def _with_text(rows: DataFrame, pairs: DataFrame, texts: DataFrame, side: str, name: str) -> DataFrame:
    """Adds the text of the node in ``side`` to ``rows``, which are ``pairs`` with or without more columns.

    A node of many pairs is dealt over several tasks, with a copy of its text for each.
    """
    uses = pairs.groupBy(side).agg(F.count("*").alias("n"))
    tasks = F.ceil(F.col("n") / PAIRS_PER_TEXT).cast("long")
    dealt = join_per_key(rows, uses, side, pairs.count()).withColumn("_salt", F.pmod(F.xxhash64("u", "v"), tasks)).drop("n")
    copies = texts.select(F.col("node").alias(side), F.col("packed").alias(name)).join(uses, side)
    return dealt.join(copies.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("n"), [side, "_salt"]).drop("_salt")


def _texts(rows: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """``node`` and ``packed``, the text of one document of each asked node."""
    ids = nodes.join(asked, "node", "left_semi").select("node", F.col("least.doc_id").alias("_least"), F.col("least.text_hash").alias("_hash"))
    packed = rows.mapInArrow(_compressed_task, T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], T.StructField("packed", T.BinaryType())]))
    met = packed.join(ids, packed["doc_id"].eqNullSafe(ids["_least"]) & (packed["text_hash"] == ids["_hash"])).select("node", "packed")
    return written(met.dropDuplicates(["node"]), "candidate-texts")


def _counted(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The written ``pairs`` (``u``, ``v``) with ``shared`` and ``sizes``, counted on the whole sets."""
    both = _with_text(_with_text(pairs, pairs, texts, "u", "a"), pairs, texts, "v", "b")
    schema = T.StructType([both.schema["u"], both.schema["v"], T.StructField("sizes", T.LongType()), T.StructField("shared", T.LongType())])
    return both.select("u", "v", "a", "b").mapInArrow(_counts_task(words), schema)


def _similar(tenths: int) -> Column:
    return 10 * F.col("shared") >= tenths * (F.col("sizes") - F.col("shared"))


def _rarest(members: DataFrame, texts: DataFrame, words: int, tenths: int) -> DataFrame:
    """Members (column ``node`` and struct ``x``) under each of their rarest shingles that others have too, and how many of theirs others have.

    Two sets of the asked similarity share one of the rarest ``size - similarity * size + 1`` shingles of each, in any
    order of rarity that is the same for both, so no such pair is lost; and what many texts quote is not rare.
    """
    sets = texts.join(members.select("node"), "node", "left_semi").mapInArrow(_sets_task(words), "node long, shingles array<long>, parity array<long>")
    sets = written(sets, "shingle-sets")
    tokens = sets.select("node", F.size("shingles").alias("of"), F.explode("shingles").alias("shingle"))
    known = join_per_key(tokens, tokens.groupBy("shingle").agg(F.count("*").alias("n")), "shingle", tokens.count())
    own = Window.partitionBy("node")  # a part of one document's shingles
    known = known.withColumn("place", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("rest", F.count_if(F.col("n") > 1).over(own))
    few = known.where(F.col("place") <= F.col("of") - F.ceil(F.col("of") * tenths / 10) + 1).where("n > 1")
    bits = F.struct(*[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY // 64)])
    own = members.join(sets.select("node", bits.alias("bits")), "node").withColumn("x", F.col("x").withField("bits", F.col("bits")))
    return few.join(own.select("node", "x"), "node").select("shingle", F.col("x").withField("rest", F.col("rest")).alias("x"))


def _met(rows: DataFrame, tenths: int) -> DataFrame:
    """Pairs of members (structs ``x``) that meet under one of their rare shingles, once for each, and that nothing known of them discards.

    Discarded are pairs under one root, sizes that are too far apart,
    distances to the same hub that are (1 less the similarity is a metric), and pairs that would be too far apart if they had all in common that
    each has in common with anybody, or all that their parities leave open.
    """
    a, b = rows.alias("a"), rows.alias("b")
    f = lambda side, c: F.col(f"{side}.x.{c}")
    fits = 10 * F.least(f("a", "size"), f("b", "size")) >= tenths * F.greatest(f("a", "size"), f("b", "size"))
    near = (f("a", "hub") != f("b", "hub")) | (F.abs(f("a", "away") - f("b", "away")) <= 1 - tenths / 10 + 1e-9)
    both = f("a", "size") + f("b", "size")
    apart = reduce(lambda x, y: x + y, [F.bit_count(f("a", f"bits.p{i}").bitwiseXOR(f("b", f"bits.p{i}"))) for i in range(PARITY // 64)])
    enough = reduce(lambda x, y: x & y, [10 * most >= tenths * (both - most) for most in (F.least(f("a", "rest"), f("b", "rest")), F.shiftright(both - apart, 1))])
    meets = (F.col("a.shingle") == F.col("b.shingle")) & (f("a", "node") < f("b", "node")) & (f("a", "root") != f("b", "root")) & fits & near & enough
    return a.join(b, meets).select(f("a", "node").alias("u"), f("b", "node").alias("v"))


def _keyed(nodes: DataFrame, roots: DataFrame | None, bands: range) -> DataFrame:
    """``node``, ``size``, ``root`` and ``key`` for each of the bands; without a link so far a node is its own root."""
    placed = nodes.withColumn("root", F.col("node")) if roots is None else nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # the bands' factors differ, so a key belongs to one band
    return placed.select("node", "size", "root", F.explode(F.slice("keys", bands.start + 1, len(bands))).alias("key"))


def _print_keyed(nodes: DataFrame) -> DataFrame:
    """``node``, ``size``, ``root`` (itself) and ``key``, which nodes with linked fingerprints share."""
    return linked_groups(nodes.select("node", "size", "fp")).select("node", "size", F.col("node").alias("root"), F.col("group").alias("key"))


def _mixed(keyed: DataFrame, label: str) -> DataFrame:
    """The members of groups that hold more than one root, with the group's size ``n``."""
    groups = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 1 AND low != high")
    # a group's row meets its members as they stream by; a large group's are split by Spark's handling of skew
    return written(keyed.join(groups.select("key", "n"), "key"), label)


def linked_roots(rows: DataFrame, nodes: DataFrame, words: int = WORDS, tenths: int = TENTHS) -> DataFrame | None:
    """``node`` and ``root`` of each node that has a link; None if no two nodes are linked."""
    roots, links, texts, counted = None, None, None, None
    for bands in (None, range(FIRST), range(FIRST, BANDS)):
        keyed = _print_keyed(nodes) if bands is None else _keyed(nodes, roots, bands)
        members = _mixed(keyed, "band-members")
        count = members.count()
        if not count:
            continue
        asked = members.select("node").distinct()
        asked = asked if texts is None else asked.join(texts, "node", "left_anti")
        more = _texts(rows, nodes, asked)
        texts = more if texts is None else texts.unionByName(more)
        # every member against the one of its group that meets most others: of the copies of a text, most likely the text itself
        met = members.groupBy("node").agg(F.sum("n").alias("met"))
        hub = members.join(met, "node").groupBy("key").agg(F.max_by(F.struct("node", "root"), F.struct("met", "node")).alias("hub"), F.count("*").alias("n"))
        with_hub = join_per_key(members.drop("n"), hub, "key", count).where(F.col("root") != F.col("hub.root"))
        pairs = written(with_hub.select(F.col("node").alias("u"), F.col("hub.node").alias("v")).distinct(), "hub-pairs")
        found = written(_counted(pairs, texts, words), "hub-counts")
        counted = found if counted is None else counted.unionByName(found)
        near = found.where(_similar(tenths)).select("u", "v")
        links = near if links is None else links.unionByName(near)
        roots = written(connected_components(links), "roots")
    if counted is None:
        return None
    # groups that hold several roots still; of the hubs that a node was held against, the nearest tells what it may be near to
    open_ = _mixed(_keyed(nodes, roots, range(BANDS)), "open-groups")
    away = (1 - F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("away")
    nearest = counted.select(F.col("u").alias("node"), F.col("v").alias("hub"), away).groupBy("node").agg(F.min_by("hub", "away").alias("hub"), F.min("away").alias("away"))
    open_ = open_.join(nearest, "node", "left").withColumn("hub", F.coalesce("hub", "node")).fillna(0.0, ["away"])
    members = written(open_.select("node", F.struct("node", "size", "root", "hub", "away").alias("x")).dropDuplicates(["node"]), "open-members")
    more = _met(_rarest(members, texts, words, tenths), tenths)
    known = counted.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    more = written(more.distinct().join(known, ["u", "v"], "left_anti"), "candidates")
    if more.isEmpty():
        return roots
    found = written(_counted(more, texts, words).where(_similar(tenths)).select("u", "v"), "links")
    return roots if found.isEmpty() else connected_components(links.unionByName(found))


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, tenths: int) -> DataFrame:
    """``doc_id``, ``text_hash`` and ``stays`` (id and text hash of the component's first document) of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    fields = [T.StructField(n, t) for n, t in (("text_hash", T.LongType()), ("node", T.LongType()), ("size", T.LongType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType())))]
    keys = written(rows.mapInArrow(_keys_task(words), T.StructType([rows.schema["doc_id"], *fields])), "band-keys")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    nodes = keys.groupBy("node").agg(first.alias("least"), F.count("*").alias("copies"), F.first("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    roots = linked_roots(rows, nodes, words, tenths)
    placed = nodes.select("node", "least", "copies")
    placed = placed.withColumn("root", F.col("node")) if roots is None else placed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = written(placed, "placed")
    groups = placed.groupBy("root").agg(F.min("least").alias("stays"), F.count("*").alias("n"))
    ids = join_per_key(placed, groups, "root", placed.count()).select("node", "stays", F.col("copies").alias("n"))
    return join_per_key(keys.select("doc_id", "text_hash", "node"), written(ids, "components"), "node", keys.count()).select("doc_id", "text_hash", "stays")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tenths: int = TENTHS) -> DataFrame:
    """``doc_id`` and ``component_id`` (smallest id reachable through links of similarity ``tenths`` / 10) of every document.

    Fewer words than ``words`` are one shingle; null, empty and blank texts are linked with each other.  Null ids are
    never a component's id unless it has no other.  Other columns are not read; no documents give no rows.
    """
    return _components(docs, id_col, text_col, words, tenths).select("doc_id", F.col("stays.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tenths: int = TENTHS) -> DataFrame:
    """One document of each component, with its own columns: that with the smallest id (see :func:`near_duplicates`).

    A null id loses to every other id; of documents of one id the smaller text hash stays, of repeated rows any one.
    """
    found = _components(docs, id_col, text_col, words, tenths)
    stays = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_hash") == F.col("stays.text_hash"))
    return keep_marked(docs, {id_col: F.col(id_col), "text_hash": F.xxhash64(text_of(text_col))}, found.select(F.col("doc_id").alias(id_col), "text_hash", stays.alias("stays")))
