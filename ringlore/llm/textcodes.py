"""Texts to token ids, column-wise: each distinct word of a batch is encoded once.

A *word* is what a tokenizer's own split makes of a text (after its lower-casing, where it does that), so the ids of
a text are the ids of its words, one after the other.  Texts of ASCII and the letters of Latin-1 are split by
numpy over their bytes, and their words are numbered by Arrow.  Other texts are cut into longer *pieces*, stretches
whose ids do not depend on what stands around them, and those go through the tokenizer's own split.  Encoding is done
by whatever encoder is given (a tokenizer library, or the numpy merge loop of ``bpe.py``), joining by numpy
gathers.  The only state is a bounded memo of words and pieces.
"""

from __future__ import annotations

import codecs
import ctypes
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, repeat
from operator import attrgetter
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space right before a space: then the space is not the start of a piece.
_WIDE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_PIECE = re.compile(r".+?(?:(?<=\w)(?= )|\Z)", re.S)

Ids = tuple[np.ndarray, np.ndarray]


class Encoder(Protocol):
    """(all ids, number of ids of each): of words as bytes, and of pieces as strings."""

    def words(self, words: list[bytes]) -> Ids: ...

    def pieces(self, pieces: list[str]) -> Ids: ...


#: Kinds of bytes. Of two-byte letters only those that begin with 0xC3 are plain.
OTHER, LETTER, DIGIT, MARK, SPACE = range(5)


def _kinds() -> np.ndarray:
    kind = np.full(256, OTHER, np.uint8)
    kind[33:127] = MARK
    kind[ord("0") : ord("9") + 1] = DIGIT
    for first in "aA":
        kind[ord(first) : ord(first) + 26] = LETTER
    kind[0x80:0xC0] = kind[0xC3] = LETTER
    kind[9:14] = kind[32] = SPACE
    return kind


_KIND = _kinds()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def byte_kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; ``OTHER`` stands for characters that are not plain."""
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        # the signs of multiplication and division are no letters
        kind[lead[data[lead + 1] | 0x20 == 0xB7]] = OTHER
    return kind


def lowered(data: np.ndarray) -> np.ndarray:
    """Plain bytes in lower case."""
    out = _LOWER[data]
    second = np.flatnonzero(data == 0xC3) + 1
    if len(second):
        out[second] += np.where(out[second] < 0x9F, np.uint8(0x20), np.uint8(0))
    return out


def word_starts(data: np.ndarray, kind: np.ndarray, at: np.ndarray, drop_space: bool) -> np.ndarray:
    """Where words begin in plain texts ``data[at[i]:at[i + 1]]``.

    Words are runs of letters, of digits (one digit with ``drop_space``), of other marks, of white space, and English
    endings after an apostrophe.  Without ``drop_space`` a space is the start of the word behind it, and white space
    before a word gives up its last character to a word of its own.
    """
    first, start = np.zeros(len(data) + 1, bool), np.ones(len(data), bool)
    first[at] = True
    start[1:] = kind[1:] != kind[:-1]
    start |= first[:-1]
    if drop_space:
        start |= kind == DIGIT
    else:
        behind = np.flatnonzero(start & (kind != SPACE) & ~first[:-1])
        behind = behind[kind[behind - 1] == SPACE]
        start[behind - 1] = True
        start[behind[data[behind - 1] == 32]] = False
    mark = np.flatnonzero((data == 39) & start)
    mark = mark[mark + 1 < len(data)]
    mark = mark[(kind[mark + 1] == LETTER) & ~first[mark + 1]]
    if len(mark):
        c = data[mark + 1]
        d = np.where(first[mark + 2], 0, data[np.minimum(mark + 2, len(data) - 1)])
        two = ((c == ord("r")) | (c == ord("v"))) & (d == ord("e")) | (c == ord("l")) & (d == ord("l"))
        size = np.where(np.isin(c, list(b"stmd")), 2, np.where(two, 3, 0))
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        ends = mark + size
        start[ends[ends < len(data)]] = True
    return np.flatnonzero(start)


def _cuts(whole: bytes | str, ends: list[int]) -> Iterator:
    return map(whole.__getitem__, map(slice, ends, ends[1:]))


def _bytes_of(cells: pa.BinaryArray) -> list[bytes]:
    """The cells of a whole array without nulls."""
    ends = np.frombuffer(cells.buffers()[1], np.int32, len(cells) + 1).tolist() if len(cells) else [0]
    return list(_cuts((cells.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), ends))


class _Store:
    """Growing flat arrays: the ids of piece ``c`` are ``flat[start[c] : start[c] + size[c]]``."""

    def __init__(self) -> None:
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.size, self.n = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        first, n, m = self.n, self.n + len(sizes), self.used + len(ids)
        if m > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(m, np.uint32)])
        if n > len(self.start):
            pad = np.empty(n, np.int64)
            self.start = np.concatenate([self.start[: self.n], pad])
            self.size = np.concatenate([self.size[: self.n], pad])
        self.flat[self.used : m] = ids
        self.size[self.n : n] = sizes
        self.start[self.n : n] = self.used + np.cumsum(sizes) - sizes
        self.n, self.used = n, m
        return first

    def gather(self, codes: np.ndarray) -> Ids:
        """(ids of the pieces one after the other, sizes)."""
        size = self.size[codes]
        where = np.repeat(self.start[codes] - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        return self.flat[where], size


class TextCoder:
    """Encodes string arrays.

    ``drop_space``: white space separates words and has no ids, and words are in lower case; otherwise a space
    belongs to the word behind it (byte-level tokenizers).
    ``limit``: pieces that either half of the memo may hold.  New and used pieces go to the young half; when it
    is full it becomes the old half, and what the old one held and nothing used is forgotten.
    """

    def __init__(self, encoder: Encoder, drop_space: bool, limit: int = 120_000) -> None:
        self.encoder, self.drop_space, self.limit = encoder, drop_space, limit
        self.seen: dict[bytes | str, int] = {}
        self.store = _Store()
        self.old, self.old_store = self.seen, self.store

    def _add(self, pieces: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        first = self.store.add(ids, sizes)
        self.seen.update(zip(pieces, range(first, first + len(pieces))))

    def _codes(self, pieces: list, encode) -> np.ndarray:
        got = np.fromiter(map(self.seen.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(got < 0)
        if not len(missing):
            return got
        asked = [pieces[i] for i in missing.tolist()]
        new = list(dict.fromkeys(asked))
        held = np.fromiter(map(self.old.get, new, repeat(-1)), np.int64, len(new))
        if (held >= 0).any():
            self._add([new[i] for i in np.flatnonzero(held >= 0).tolist()], *self.old_store.gather(held[held >= 0]))
            new = [new[i] for i in np.flatnonzero(held < 0).tolist()]
        if new:
            self._add(new, *encode(new))
        got[missing] = np.fromiter(map(self.seen.__getitem__, asked), np.int64, len(asked))
        return got

    def _numbered(self, values: pa.Array, encode, prefix: str = "") -> np.ndarray:
        coded = values.dictionary_encode()
        words = _bytes_of(coded.dictionary) if pa.types.is_binary(values.type) else coded.dictionary.to_pylist()
        table = self._codes([prefix + w for w in words] if prefix else words, encode)
        return table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.empty(0, np.int64)

    def _pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all texts' pieces and where each text's begin."""
        encode = self.encoder.pieces
        if self.drop_space:
            lists = pc.ascii_split_whitespace(texts)
            return self._numbered(lists.flatten(), encode), lists.offsets.to_numpy().astype(np.int64)
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        at -= at[0]
        flat = lists.flatten()
        codes = self._numbered(flat, encode, " ")
        head = at[:-1]
        codes[head] = self._codes(flat.take(pa.array(head)).to_pylist(), encode)
        odd = np.flatnonzero(pc.match_substring_regex(texts, _WIDE).to_numpy(zero_copy_only=False))
        if not len(odd):
            return codes, at
        runs = np.split(codes, at[1:-1])
        for i in odd:
            runs[i] = self._codes(_PIECE.findall(texts[int(i)].as_py()), encode)
        return np.concatenate(runs), np.concatenate([[0], np.cumsum([len(r) for r in runs])])

    def _words(self, data: np.ndarray, kind: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of plain texts and where each text's begin."""
        if not len(data):
            return np.empty(0, np.int64), np.zeros(len(at), np.int64)
        if self.drop_space:
            data = lowered(data)
        start = word_starts(data, kind, at, self.drop_space)
        ends = pa.py_buffer(np.append(start, len(data)).astype(np.int32))
        words = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(data)])
        return self._numbered(words, self.encoder.words), np.searchsorted(start, at)

    def _ids(self, texts: pa.Array) -> Ids:
        """(ids of all texts, number of words' ids up to each text's begin)."""
        at = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at -= at[0]
        kind = byte_kinds(data)
        other = np.flatnonzero(kind == OTHER)
        if not len(other):
            codes, begins = self._words(data, kind, at)
        else:
            odd = np.zeros(len(texts), bool)
            odd[np.searchsorted(at, other, "right") - 1] = True
            if not odd.all():
                # by turns: plain texts and others, each as an array of their own, then in the texts' order
                parts = [self._ids(texts.filter(pa.array(m))) for m in (odd, ~odd)]
                ids, size, order = np.concatenate([p[0] for p in parts]), np.concatenate([np.diff(p[1]) for p in parts]), np.argsort(np.argsort(~odd, kind="stable"), kind="stable")
                begin = (np.cumsum(size) - size)[order]
                size = size[order]
                ends = np.concatenate([[0], np.cumsum(size)])
                return ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends
            codes, begins = self._pieces(texts)
        ids, size = self.store.gather(codes)
        return ids, np.concatenate([[0], np.cumsum(size)])[begins]

    def encode(self, texts: pa.Array) -> Ids:
        """(ids of all texts as uint32, offsets: one more than texts). Null counts as empty."""
        if self.store.n > self.limit:
            self.old, self.old_store, self.seen, self.store = self.seen, self.store, {}, _Store()
        if pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.string())
        texts = pc.fill_null(texts, "")
        if not len(texts):
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        return self._ids(texts)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of the texts in ``column``, or sum of its numbers (or one row).

    At the end of a task what is free goes back to the machine, as Python workers stay for later stages.
    """
    for batch in batches:
        cells = batch.column(column)
        sizes = pc.fill_null(cells if pa.types.is_integer(cells.type) else pc.binary_length(cells), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def as_binary(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """One little-endian binary cell for each run of ids."""
    width = ids.dtype.itemsize
    if len(ids) * width > np.iinfo(np.int32).max:
        raise ValueError("more than 2 GB of ids in one batch")
    at = pa.py_buffer((offsets * width).astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, at, pa.py_buffer(np.ascontiguousarray(ids))])


#: Fixed values of byte-level BPE: the bytes that stand for themselves.
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))


def byte_alphabet() -> str:
    """The character that stands for each byte: itself, or else the next one from 256 on."""
    rest = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(PLAIN_BYTES)))}
    return "".join(rest.get(b, chr(b)) for b in range(256))


class LibraryEncoder:
    """Words and pieces by a byte-level BPE file of the ``tokenizers`` library.

    Most of the library's time goes to what it keeps of a text's every character.  So plain words go straight to
    the library's model; pieces go through its whole ``encode``.  ``special_as_text``: strings such as
    ``<|endoftext|>`` in a document are ordinary text, as the files' README has it, and no control ids.
    """

    def __init__(self, path: str, special_as_text: bool = True) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = special_as_text
        self.letters, self.tokenize = byte_alphabet(), self.tok.model.tokenize
        #: word tokenizers mark the end of a word and have no ids for white space
        self.words_only = bool(self.tok.model.end_of_word_suffix)

    def words(self, words: list[bytes]) -> Ids:
        text = codecs.charmap_decode(b"".join(words), "strict", self.letters)[0]
        ends = list(accumulate(map(len, words), initial=0))
        strings = _cuts(text, ends)
        if self.words_only:
            tokens = [[] if w.isspace() else self.tokenize(s) for w, s in zip(words, strings)]
        else:
            tokens = list(map(self.tokenize, strings))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter(map(attrgetter("id"), chain.from_iterable(tokens)), np.uint32, int(sizes.sum())), sizes

    def pieces(self, pieces: list[str], per_call: int = 4096) -> Ids:
        ids, sizes = [], []
        for i in range(0, len(pieces), per_call):
            out = [e.ids for e in self.tok.encode_batch_fast(pieces[i : i + per_call], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, out), np.int64, len(out)))
            ids.append(np.fromiter(chain.from_iterable(out), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(ids), np.concatenate(sizes)


@cache
def library_coder(path: str, drop_space: bool, special_as_text: bool = True) -> TextCoder:
    """The coder of a tokenizer file; a Python worker keeps it, and its memo, from task to task."""
    return TextCoder(LibraryEncoder(path, special_as_text), drop_space)
