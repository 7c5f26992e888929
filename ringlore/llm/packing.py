"""Sum-of-squares packing of token streams into windows of a fixed size.

Each task packs its own documents online.  ``open[h]`` counts the windows filled up to level ``h``;
a piece of ``s`` tokens goes to the level that makes the sum of the squared counts smallest
(Csirik et al., "On the sum-of-squares algorithm for bin packing").  Documents longer than a window
first give whole windows; what is left of them is placed like any other document.  Windows still
open at the end of a task, or beyond ``most_open``, are filled up by cutting the pieces of others, so
that a task leaves one partly filled window at most.  State is the level array and the open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .textcodes import as_binary, library_coder, slices

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

#: (document id, first token within the document, ids, tokens of the document)
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Packs pieces into windows of ``size``; closed windows are handed to ``emit``."""

    def __init__(self, size: int, emit, most_open: int = 2048) -> None:
        self.size, self.emit, self.most_open = size, emit, most_open
        # with a half at either end, count[h + s] - count[h] is the change of the sum of squares, halved and less 1
        self.count = np.zeros(size + 1)
        self.count[0], self.count[size] = 0.5, -0.5
        self.usable = np.full(size + 1, np.inf)
        self.usable[0] = 0
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.n_open = 0

    def level_for(self, s: int) -> int:
        """The level at which a piece of ``s`` tokens is placed; the fullest of equally good ones."""
        change = self.count[s:] - self.count[: self.size + 1 - s] + self.usable[: self.size + 1 - s]
        return self.size - s - int(np.argmin(change[::-1]))

    def _add(self, level: int, by: int) -> None:
        if 0 < level < self.size:
            self.count[level] += by
            self.usable[level] = 0 if self.count[level] > 0 else np.inf
            self.n_open += by

    def place(self, piece: Piece) -> None:
        s = len(piece[2])
        level = self.level_for(s)
        window = self.windows[level].pop() if level else []
        window.append(piece)
        self._add(level, -1)
        if level + s == self.size:
            self.emit(window)
        else:
            self.windows[level + s].append(window)
            self._add(level + s, 1)
            if self.n_open > self.most_open:
                self.close()

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % self.size
        for a in range(0, whole, self.size):
            self.emit([(doc, a, ids[a : a + self.size], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))

    def close(self) -> None:
        """Fills the fullest windows with what the emptiest hold, cutting pieces; one may stay partly filled."""
        left = [w for level in reversed(self.windows) for w in level]
        self.windows = [[] for _ in range(self.size)]
        self.count[1 : self.size] = 0
        self.usable[1:] = np.inf
        self.n_open = 0
        last = len(left) - 1
        for i, window in enumerate(left):
            if i > last:
                break
            room = self.size - sum(len(p[2]) for p in window)
            while room and last > i:
                doc, start, ids, total = left[last].pop()
                if len(ids) > room:
                    left[last].append((doc, start, ids[:-room], total))
                    doc, start, ids = doc, start + len(ids) - room, ids[-room:]
                window.append((doc, start, ids, total))
                room -= len(ids)
                last -= not left[last]
            self.emit(window)


def _pack_task(tokenizer: str, end_id: int, size: int, most_open: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_coder(tokenizer, False)
        base = TaskContext.get().partitionId() << 32
        done: list[list[Piece]] = []
        packer = SumOfSquares(size, done.append, most_open)
        n_windows = 0

        def flush() -> pa.RecordBatch:
            nonlocal n_windows
            pieces = [p for w in done for p in w]
            sizes = np.array([len(p[2]) for p in pieces], np.int64)
            per = np.array([len(w) for w in done], np.int64)
            ends = np.cumsum(sizes)
            first = np.repeat(np.cumsum(per) - per, per)
            offset = (ends - sizes) - (ends - sizes)[first]
            window = base + n_windows + np.repeat(np.arange(len(done)), per)
            n_windows += len(done)
            done.clear()
            return pa.record_batch(
                [
                    pa.array([p[0] for p in pieces], pa.int64()),
                    pa.array([p[1] for p in pieces], pa.int64()),
                    pa.array(sizes),
                    pa.array([p[3] for p in pieces], pa.int64()),
                    pa.array(window, pa.int64()),
                    pa.array(offset, pa.int64()),
                    as_binary(np.concatenate([p[2] for p in pieces]).astype("<u4"), np.concatenate([[0], ends])),
                ],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in slices(batches, "text"):
            ids, at = coder.encode(batch.column("text"))
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                packer.add(doc, np.append(ids[a:b], np.uint32(end_id)))
            if done:
                yield flush()
        packer.close()
        if done:
            yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, most_open: int = 2048
) -> DataFrame:
    """Packs all documents into sequences of at most ``size`` tokens: one row per piece, with its ids.

    A document is its ids and then ``end_id``; null and empty texts are that id alone.  Each id lies in
    exactly one piece.  Repeated rows and null ids are packed like others; other columns are not read.
    ``sequence_id`` is unique, not gapless; ``ids`` are little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_pack_task(tokenizer, end_id, size, most_open), SCHEMA)
