"""Byte-level BPE by rank, on padded numpy matrices.

Distinct pre-tokens, bucketed by length, are the rows of a matrix of token ids.  Each round every row merges
its leftmost pair of least rank; rows without a pair leave the matrix (compaction).  Ranks of pairs come
from a hash table in two arrays; after a merge only the two pairs beside it are looked up again.
Pre-tokens of more than ``LONGEST`` bytes, for which rows of a matrix would take quadratic time, are merged
by a heap, which gives the same ids.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .textcodes import TextCoder, slices

#: white space before a space or at the end
_SPACED = re.compile(r"\s(?: |\Z)")
NONE = np.int32(np.iinfo(np.int32).max)
WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 192, 256)
LONGEST, ROWS = WIDTHS[-1], 8192


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Rank of the token that two tokens make, by open addressing with linear probing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, values = np.array(pairs, np.int64).reshape(-1, 2).T
        self.bits = max(4, int(len(keys) * 6).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            take = left[free]
            self.keys[slot[take]] = keys[take]  # of those that want one slot, the last gets it
            got = self.keys[slot[left]] == keys[left]
            self.values[slot[left[got]]] = values[left[got]]
            left = left[~got]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) ^ (keys.astype(np.uint64) >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where there is none or either is padding (negative)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left_over = np.flatnonzero((found != keys) & (found != -1) & (keys >= 0))
        while len(left_over):
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.values[slot[left_over[hit]]]
            left_over = left_over[~hit & (found != -1)]
        return out


class RankBpe:
    """Ids of pre-tokens by the ranks of a vocabulary, and their bytes again."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.pairs, self.split = ranks, PairTable(ranks), regex.compile(pattern).findall
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def _merge_rows(self, ids: np.ndarray) -> np.ndarray:
        """Merges all rows of a matrix padded with -1 at the right; the rows' ids, padded likewise."""
        out = np.full_like(ids, -1)
        rows = np.arange(len(ids))
        rank = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        columns = np.arange(ids.shape[1])
        while len(rows):
            at = rank.argmin(1)
            each = np.arange(len(rows))
            best = rank[each, at]
            go = best < NONE
            if not go.all():
                out[rows[~go], : ids.shape[1]] = ids[~go]
                rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                if not len(rows):
                    break
                each = each[: len(rows)]
            # drop what stands right of the pair's left token, then put the merged token there
            ids = np.where(columns[: ids.shape[1] - 1] <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[each, at] = best
            if ids.shape[1] == 1:
                out[rows, :1] = ids
                break
            rank = np.where(columns[: rank.shape[1] - 1] < at[:, None], rank[:, :-1], rank[:, 1:])
            last = ids.shape[1] - 1
            right = np.flatnonzero(at < last)
            rank[right, at[right]] = self.pairs.ranks(ids[right, at[right]], ids[right, at[right] + 1])
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.pairs.ranks(ids[left, at[left] - 1], ids[left, at[left]])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        """One long pre-token by a heap of pairs over a linked list."""
        part, after, before = [piece[i : i + 1] for i in range(len(piece))], list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = [(r, i, 2) for i in range(len(piece) - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j >= len(part) or len(part[i]) + len(part[j]) != size:
                continue
            part[i], part[j], after[i] = part[i] + part[j], b"", after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(part) and (r := self.ranks.get(both := part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(both)))
        return [self.ranks[p] for p in part if p]

    def words(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each) of pre-tokens."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes)
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        width = np.append(WIDTHS, LONGEST + 1)[np.searchsorted(WIDTHS, sizes)]
        for w in np.unique(width):
            which = np.flatnonzero(width == w)
            for a in range(0, len(which), ROWS):
                some = which[a : a + ROWS]
                if w > LONGEST:
                    long = [self._merge_long(raw[i]) for i in some]
                    got.append((some, np.array([x for ids in long for x in ids], np.int32), np.array([len(ids) for ids in long])))
                    continue
                cell = np.arange(w)
                inside = cell < sizes[some, None]
                ids = np.where(inside, self.of_byte[data[np.where(inside, (ends - sizes)[some, None] + cell, 0)]], np.int32(-1))
                ids = self._merge_rows(ids)
                got.append((some, ids[ids >= 0], (ids >= 0).sum(1)))
        n = np.zeros(len(raw), np.int64)
        for some, _, k in got:
            n[some] = k
        start, flat = np.cumsum(n) - n, np.empty(int(n.sum()), np.uint32)
        for some, ids, k in got:
            flat[np.repeat(start[some] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return flat, n

    def pieces(self, pieces: list[str], per_call: int = 32768) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of ``TextCoder``: split by the pattern, then each distinct pre-token once."""
        done = [self._encode_some(pieces[i : i + per_call]) for i in range(0, len(pieces), per_call)]
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])

    def _encode_some(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(pieces)
        if _SPACED.search(text) or any(p[:1] != " " for p in pieces):
            split = [self.split(p) for p in pieces]
            tokens, per = [t for s in split for t in s], np.array([len(s) for s in split], np.int64)
        else:
            tokens = self.split(text)
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
            per = np.diff(np.searchsorted(ends, np.cumsum([len(p) for p in pieces]), "right"), prepend=0)
        coded = pa.array(tokens, pa.string()).dictionary_encode()
        which = coded.indices.to_numpy()
        flat, n = self.words([t.encode() for t in coded.dictionary.to_pylist()])
        size = n[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        where = np.repeat((np.cumsum(n) - n)[which] - ends[:-1], size) + np.arange(int(ends[-1]))
        token_ends = np.concatenate([[0], np.cumsum(per)])
        return flat[where], np.diff(ends[token_ends])


@cache
def rank_coder(path: str, pattern: str) -> TextCoder:
    """The coder of a rank file; a Python worker keeps it, and its memo, from task to task."""
    return TextCoder(RankBpe(read_ranks(path), pattern), drop_space=False)


class Decoder:
    """Bytes of ids, by gathers from the bytes of all tokens."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        tokens = sorted(ranks.items(), key=lambda x: x[1])
        self.size = np.zeros(tokens[-1][1] + 1, np.int64)
        self.size[[r for _, r in tokens]] = [len(t) for t, _ in tokens]
        self.data, self.start = np.frombuffer(b"".join(t for t, _ in tokens), np.uint8), np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """A binary cell for each run of ids."""
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(self.start[ids] - ends[:-1], n)
        where += np.arange(len(where))
        return pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends[at].astype(np.int32)), pa.py_buffer(self.data[where])])


@cache
def decoder(path: str) -> Decoder:
    return Decoder(read_ranks(path))


def _encode_task(path: str, pattern: str, and_decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = rank_coder(path, pattern)
        for batch in slices(batches, "text", 4 << 20):
            ids, at = coder.encode(batch.column("text"))
            cells = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.view(np.int32)))
            out = {"doc_id": batch.column("doc_id"), "ids": cells}
            yield pa.record_batch(out | {"decoded": decoder(path).decode(ids, at)} if and_decode else out)

    return run


def _decode_task(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                at = some.column("ids").offsets.to_numpy().astype(np.int64)
                cells = decoder(path).decode(some.column("ids").values.to_numpy()[at[0] : at[-1]], at - at[0])
                yield pa.record_batch({"doc_id": some.column("doc_id"), "ids": some.column("ids"), "decoded": cells})

    return run


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every document, without special tokens.

    Null and empty texts have no ids.  Repeated rows are each encoded; other columns are not read.
    ``and_decode`` adds ``decoded`` as :func:`decode_documents` does, in the same Python worker.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    fields = [rows.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * and_decode
    return rows.mapInArrow(_encode_task(ranks_path, pattern, and_decode), T.StructType(fields))


def decode_documents(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes that the ids stand for."""
    schema = T.StructType([encoded.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return encoded.select("doc_id", "ids").mapInArrow(_decode_task(ranks_path), schema)
