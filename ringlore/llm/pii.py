"""Personal data in texts: patterns propose, validators confirm, context words adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are reported whenever pattern and validator agree.
Further kinds need a score of ``THRESHOLD``: a pattern gives a start, a checksum (mod 97) or words
nearby raise it.  Further spans never replace or overlap base ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of
from .textcodes import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "short_card", "local_phone")
THRESHOLD, NEAR = 0.7, 48

SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# runs of digits are taken whole: a shorter match inside one can't succeed where the whole run fails
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])")
_DIGIT = re.compile(r"[0-9]")

CONTEXT = {
    "email": ("mail", "contact", "e-mail", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "short_card": ("card", "visa", "credit", "amex", "karte", "carte", "tarjeta"),
    "local_phone": ("phone", "call us", "tel", "mobile", "telefon"),
}
#: a context word counts as a whole word, not within another one
_NEAR_WORDS = {kind: re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, words))})s?(?!\w)") for kind, words in CONTEXT.items()}
#: score of a confirmed match before its context
START = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "short_card": 0.5, "local_phone": 0.5}


_CUT_LEFT, _CUT_RIGHT = re.compile(r"^\w+"), re.compile(r"\w+$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the decimal digits pass the Luhn check."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(d - 9 if (d := 2 * int(c)) > 9 else d for c in even)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether letters and digits pass the ISO 13616 check."""
    moved = iban[4:] + iban[:4]
    return len(iban) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with its run to the left, in linear time; the same as searching the pattern from the left."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LEFT:
            start -= 1
        if start < at and (m := _LOCAL.match(text, start)):
            found.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def _ip_ok(s: str) -> bool:
    parts = [p.lstrip("0") for p in s.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed base spans by kind as listed, then start; leftmost, not overlapping within a kind."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    found += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def further_spans(text: str) -> list[tuple[str, int, int]]:
    """Candidates of the further kinds that their validator confirms, before scoring."""
    if not _DIGIT.search(text):
        return []
    found = [("iban", *m.span()) for m in _IBAN.finditer(text) if mod97(m[0].replace(" ", ""))]
    found += [("short_card", *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 15 and luhn(d)]
    return found + [("local_phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's start, raised where a word of its context stands within ``NEAR`` characters."""
    # words that the window cuts are none
    left = text[max(0, start - NEAR - 1) : start]
    left = left if start <= NEAR else _CUT_LEFT.sub("", left)
    right = text[end : end + NEAR // 2 + 1]
    right = right if end + NEAR // 2 >= len(text) else _CUT_RIGHT.sub("", right)
    near = f"{left} \n {right}"
    return min(1.0, START[kind] + 0.2 * bool(_NEAR_WORDS[kind].search(near.lower())))


def find(text: str) -> list[Span]:
    """All spans of a text, in code points, end exclusive, by kind as in ``KINDS``, then start."""
    base = base_spans(text)
    found = [Span(k, a, b, score(text, k, a, b)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    for k, a, b in further_spans(text):
        if (s := score(text, k, a, b)) >= THRESHOLD and not any(a < y and x < b for x, y in taken):
            found.append(Span(k, a, b, s))
            taken.append((a, b))
    return found


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones as one, replaced by the name of its kind."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done : s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


def _find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        spans = [[s._asdict() for s in find(t)] for t in batch.column("text").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), pa.array(spans, _ARROW_SPANS)], names=["doc_id", "spans"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (array of kind, start, end, score) of every document.

    Null and empty texts have no spans.  Repeated rows are each reported.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(_find_batches, T.StructType([rows.schema["doc_id"], T.StructField("spans", SPANS)]))


def redact_pii(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with personal data replaced by the name of its kind; texts without any stay as they are.

    Null stays null.  ``chars_col``, where there is one, becomes the characters of the new text.
    """

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [None if t is None else redact(t, s) if (s := find(t)) else t for t in batch.column(text_col).to_pylist()]
            new = {text_col: pa.array(texts, batch.column(text_col).type)}
            if chars_col in names:
                new[chars_col] = pa.array([None if t is None else len(t) for t in texts], batch.column(chars_col).type)
            yield pa.record_batch([new.get(n, c) for n, c in zip(names, batch.columns)], names=names)

    return docs.mapInArrow(run, docs.schema)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
