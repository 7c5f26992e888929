"""Prefix trie of conversations by vertical bitmaps.

Each conversation is a row: its turns' digests one after the other, and their numbers of words.  Rows are dealt by ranges of (turns, id), so that a node
of the trie, the conversations with the same first turns, stands in neighbouring ranges, and a group of copies of any size
falls into several.  Within a range, runs of at most ``SHARD_ROWS`` rows or ``SHARD_TURNS`` turns are shards.

A shard indexes its conversations vertically: for each (position, turn) a bitset of the conversations that have that turn there.
Depth first, a node's bitset is intersected with the postings of the next position: each child's bitset gives its members
(popcount), its smallest member (bits are in order of id) and, with the bitset of conversations of that length, those that end there.

Only nodes that hold a shard's first or last conversation can go on in the next shard: they are *open*.  All others are complete and leave with their
totals.  Open nodes, two paths a shard, are merged in order of shards by a stack, ``FAN_IN`` shards at a time and in rounds, until one is left.
Ends of open nodes are lists of one shard each, in ascending order, and are hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_per_key, numbered, written

SHARD_ROWS, SHARD_TURNS, FAN_IN = 4096, 1 << 16, 64
#: bytes of a turn's digest
WIDTH = 16
SPACES = r"[\x20\x09-\x0D]+"

NODE = "kind int, shard long, place long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends binary"
FIELDS = [f.split()[0] for f in NODE.split(", ")]
#: what a row of a shard or a merge is: a complete node, an open node, a part of an open node's ends
COMPLETE, OPEN, ENDS = range(3)


def words_in(text: Column) -> Column:
    """Number of words of a text: runs of anything but ASCII white space."""
    return F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))


def conversation_rows(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (digests, hex) and ``words`` (arrays in order of turn) of each conversation.

    Turns of a null ``conv_id`` belong to none and are left out.  A null turn comes first, equal turns are ordered by role and
    digest of the text, a null role or text is empty.  A conversation is one row of some 20 bytes a turn, whatever its texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps (role, text) apart from another split of the same characters
    digest = F.left(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * WIDTH))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), "turn", role.alias("role"), F.sha2(text, 256).alias("text"), digest.alias("digest"), words_in(text).alias("words")).alias("turn"),
    )
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("t")).select("conv_id", F.col("t.digest").alias("turns"), F.col("t.words").alias("words"))


def rebuilt(rows: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation with its first turns taken from the one whose id is the multiple of ``every`` at or below its own.

    How many, h, is the checksum of its id modulo ``most``; its own turns after its first h follow.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    base = rows.where(F.col("conv_id") % every == 0)
    base = base.select(F.col("conv_id").alias("base_id"), F.slice("turns", 1, most - 1).alias("base_turns"), F.slice("words", 1, most - 1).alias("base_words"))
    both = rows.withColumn("h", h).withColumn("base_id", F.col("conv_id") - F.col("conv_id") % every).join(base, "base_id", "left")

    def joined(own: str, first: str, kind: str) -> Column:
        from_base = F.coalesce(F.slice(first, F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(from_base, F.slice(own, F.col("h") + 1, F.size(own)))

    return both.select("conv_id", joined("turns", "base_turns", "array<string>").alias("turns"), joined("words", "base_words", "array<int>").alias("words"))


def _bits(bitset: int) -> np.ndarray:
    """Positions of the set bits, ascending."""
    raw = np.frombuffer(bitset.to_bytes((bitset.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def _ids(ids: np.ndarray, bitset: int) -> bytes:
    return ",".join(map(str, ids[_bits(bitset)].tolist())).encode() if bitset else b""


def shard_nodes(shard: int, conv_ids: list[int], paths: list[bytes], words: list[list[int]]) -> Iterator[tuple]:
    """The trie of a shard's conversations, which are in order of their turns: rows of ``NODE``."""
    by_id = np.argsort(np.array(conv_ids, np.int64), kind="stable")
    ids = np.array(conv_ids, np.int64)[by_id]
    postings: list[dict[bytes, int]] = []
    ends: dict[int, int] = {}
    for bit, row in enumerate(by_id.tolist()):
        path, mark = paths[row], 1 << bit
        n = len(path) // WIDTH
        ends[n] = ends.get(n, 0) | mark
        while len(postings) < n:
            postings.append({})
        for d in range(n):
            turn = path[WIDTH * d : WIDTH * d + WIDTH]
            postings[d][turn] = postings[d].get(turn, 0) | mark
    place = np.empty(len(ids), np.int64)
    place[by_id] = np.arange(len(ids))
    first, last = 1 << int(place[0]), 1 << int(place[-1])
    # nodes in depth-first order: parent's number, depth, members, words of the last turn
    parent, depth, members, tokens = [-1], [0], [(1 << len(ids)) - 1], [0]
    stack = [0]
    while stack:
        node = stack.pop()
        d = depth[node]
        rest = members[node] & ~ends.get(d, 0)
        while rest:
            low = (rest & -rest).bit_length() - 1
            row = int(by_id[low])
            child = rest & postings[d][paths[row][WIDTH * d : WIDTH * d + WIDTH]]
            rest &= ~child
            stack.append(len(parent))
            parent.append(node)
            depth.append(d + 1)
            members.append(child)
            tokens.append(words[row][d])
    n = len(parent)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    is_open = [bool(m & first or m & last) for m in members]
    least = [int(ids[(m & -m).bit_length() - 1]) for m in members]
    for x in range(n - 1, -1, -1):  # children have larger numbers than their parents
        if not is_open[x]:
            leaves[x] += not children[x]
            saved[x] += (members[x].bit_count() - 1) * tokens[x]
            leaves[parent[x]] += leaves[x]
            saved[parent[x]] += saved[x]
            children[parent[x]] += 1
    keys: dict[int, bytes] = {}
    opened = sorted((not members[x] & first, depth[x], x) for x in range(n) if is_open[x])
    for at, (_, d, x) in enumerate(opened):
        keys[x] = hashlib.sha256(paths[int(by_id[(members[x] & -members[x]).bit_length() - 1])][: WIDTH * d]).digest()
        up = keys[parent[x]] if x else None
        yield OPEN, shard, at, keys[x], up, d, least[x], None, members[x].bit_count(), children[x], leaves[x], saved[x], tokens[x], None
        here = members[x] & ends.get(d, 0)
        if here:
            yield ENDS, shard, None, keys[x], None, d, None, None, None, None, None, None, None, _ids(ids, here)
    for x in range(n):
        if not is_open[x]:
            p = parent[x]
            here = hashlib.sha256(_ids(ids, members[x] & ends.get(depth[x], 0))).hexdigest().encode()
            up = (keys[p], None) if is_open[p] else (None, least[p])
            yield COMPLETE, shard, None, None, up[0], depth[x], least[x], up[1], members[x].bit_count(), children[x], leaves[x], saved[x], tokens[x], here


def _batches(rows: Iterator[tuple], size: int = 4096) -> Iterator[pa.RecordBatch]:
    from itertools import islice

    types = {"kind": pa.int32(), "key": pa.binary(), "parent_key": pa.binary(), "ends": pa.binary()}
    while got := list(islice(rows, size)):
        yield pa.record_batch([pa.array(c, types.get(f, pa.int64())) for f, c in zip(FIELDS, zip(*got))], names=FIELDS)


def _shards_task(shard_rows: int, shard_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, held, turns = TaskContext.get().partitionId() << 32, ([], [], []), 0

        def nodes() -> Iterator[tuple]:
            nonlocal shard, held, turns
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words"))):
                    more = len(row[2])
                    if held[0] and (len(held[0]) >= shard_rows or turns + more > shard_turns):
                        yield from shard_nodes(shard, *held)
                        shard, held, turns = shard + 1, ([], [], []), 0
                    for part, value in zip(held, row):
                        part.append(value)
                    turns += more
            if held[0]:
                yield from shard_nodes(shard, *held)

        yield from _batches(nodes())

    return run


def merged(rows: Iterator[dict], group: int, last: bool) -> Iterator[tuple]:
    """Open nodes of neighbouring shards, in order of (shard, place), as those of one: its complete nodes, then its open ones.

    Nodes of the first shard's first conversation may go on before it, and what is on the stack in the end after it, unless these
    are all shards (``last``).  No more than a path is in memory.
    """
    stack: list[dict] = []
    early: list[dict] = []
    start = None

    def close() -> Iterator[tuple]:
        node = stack.pop()
        if node["early"]:
            early.append(node)
            return
        saved = node["saved_tokens"] + (node["n_convs"] - 1) * node["words"]
        leaves = node["n_leaves"] + (not node["n_children"])
        if stack:
            up = stack[-1]
            up["n_children"] += 1
            up["n_leaves"] += leaves
            up["saved_tokens"] += saved
        yield COMPLETE, None, None, node["key"], node["parent_key"], node["depth"], node["conv_id"], None, node["n_convs"], node["n_children"], leaves, saved, node["words"], None

    for row in rows:
        start = row["shard"] if start is None else start
        d = row["depth"]
        if d < len(stack) and stack[d]["key"] == row["key"]:
            node = stack[d]
            node["conv_id"] = min(node["conv_id"], row["conv_id"])
            for f in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[f] += row[f]
            continue
        while len(stack) > d:
            yield from close()
        # the first path of the first shard: each node right below the one before it
        stack.append(row | {"early": not last and row["shard"] == start and row["place"] == d})
    while last and stack:
        yield from close()
    late = stack[:]
    left = [n for n in late if n["early"]] + sorted(early, key=lambda n: n["depth"]) + [n for n in late if not n["early"]]
    for at, n in enumerate(left):
        yield OPEN, group, at, n["key"], n["parent_key"], n["depth"], n["conv_id"], None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved_tokens"], n["words"], None


def _merge_task(last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (row for batch in batches for row in batch.to_pylist())
        yield from _batches(x for group, own in groupby(rows, key=lambda r: r["group"]) for x in merged(own, group, last))

    return run


def _hash_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each run of equal keys, whose parts stream by in order."""
    key, digest = None, None
    for batch in batches:
        done = []
        for k, part in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if k != key:
                if digest:
                    done.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(part)
            else:
                digest.update(b"," + part)
        yield pa.record_batch([pa.array([k for k, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())], names=["key", "ends_sha256"])
    if digest:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_nodes(rows: DataFrame, shard_rows: int = SHARD_ROWS, shard_turns: int = SHARD_TURNS, fan_in: int = FAN_IN) -> DataFrame:
    """A row for each node of the trie of ``rows`` (``conv_id``, ``turns``, ``words``; no repeated ``conv_id``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    Conversations without turns are members of the root; of no conversations there is no node.
    """
    path = F.unhex(F.concat_ws("", "turns"))
    placed = written(rows.select("conv_id", path.alias("path"), F.coalesce("words", F.array().cast("array<int>")).alias("words")), "conversations")
    placed = placed.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(placed.mapInArrow(_shards_task(shard_rows, shard_turns), NODE), "trie-shards")
    done = found.where(F.col("kind") == COMPLETE)
    open_, last = found.where(F.col("kind") == OPEN), False
    while not last:
        shards = numbered(open_.select("shard").distinct(), ["shard"], "nth").withColumn("group", F.floor(F.col("nth") / fan_in).cast("long"))
        shards = written(shards, "shard-groups")
        last = (shards.agg(F.max("group")).first()[0] or 0) == 0
        dealt = open_.join(shards.select("shard", "group"), "shard").repartition("group").sortWithinPartitions("group", "shard", "place")
        rounds = written(dealt.mapInArrow(_merge_task(last), NODE), "trie-merged")
        done = done.unionByName(rounds.where(F.col("kind") == COMPLETE))
        open_ = rounds.where(F.col("kind") == OPEN)
    parts = found.where(F.col("kind") == ENDS).select("key", "shard", "ends")
    hashed = parts.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(_hash_task, "key binary, ends_sha256 string")
    done = done.join(hashed, "key", "left").withColumn("ends_sha256", F.coalesce(F.col("ends").cast("string"), "ends_sha256", F.sha2(F.lit(""), 256)))
    # a child of a merged node names its parent by key; the root has children of every shard
    done = written(done.withColumn("up", F.hex("parent_key")), "trie-nodes")
    parents = done.where("key IS NOT NULL AND n_children > 0").select(F.hex("key").alias("up"), F.col("conv_id").alias("parent"), F.col("n_children").alias("n"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    named = join_per_key(done.where("up IS NOT NULL"), parents, "up", done.count()).withColumn("parent_conv_id", F.col("parent"))
    return done.where("up IS NULL").select(*out).unionByName(named.select(*out))
