"""Tables of wikitext pages, laid out as grids: title reigns (SRC10) and professional records (SRC13).

A page is cut into marks (brackets, bars, tags, line ends) and runs of text.  A stack of what is open tells which bars and line ends belong to the
page's own tables and which to a template, link or reference.  A table's cells are placed on a grid, where a cell that spans rows or columns stands in each
of its places; columns are then found by their headers, whichever row those stand in.
"""

from __future__ import annotations

import calendar
import dataclasses
import datetime as dt
import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MARKS = re.compile(r"(<!--.*?-->|<[^<>]*>|\{\{|\}\}|\[\[|\]\]|\n|\||!)", re.S)
_CLOSES = {"}}": "{{", "]]": "[["}
#: a line whose only marks are bars, exclamation marks and whole templates and links with none inside; one of these, or the border of two cells
_PLAIN = re.compile(r"(?:[^\[\]{}<>]|\{\{[^\[\]{}<>]*\}\}|\[\[[^\[\]{}<>]*\]\])*")
_WHOLE = re.compile(r"(\{\{[^{}]*\}\}|\[\[[^\[\]]*\]\]|\|\|)")
#: cells and days that a worker remembers
REMEMBERED = 1 << 15

# Templates that show their first unnamed value; words by which a header names its column; words for what goes on.
SHOWN_TEMPLATES = {"small", "big", "center", "nowrap", "nobr", "yes", "no", "draw", "yes2", "no2", "draw2", "nc2", "maybe2", "partial2"}
REIGN_COLUMNS = {"number": ["no", "#", "number"], "name": ["name", "champion", "boxer"], "dates": ["date", "dates", "held"], "reign": ["reign"], "defences": ["defences", "defenses", "def"]}
RECORD_COLUMNS = {"result": ["result", "res"], "opponent": ["opponent"], "type": ["type", "method"], "round": ["round", "rounds", "rd"], "date": ["date"]}
ONGOING = {"present", "incumbent", "current", "now"}
RESULTS = {"win": "win", "won": "win", "loss": "loss", "lost": "loss", "draw": "draw", "nc": "nc", "no contest": "nc"}
RECORD_METHODS = {"KO", "TKO", "UD", "MD", "SD", "DQ", "RTD", "TD"}


@dataclasses.dataclass
class Cell:
    """What a cell shows, a string a line, and its links as (article, words)."""

    lines: list[str]
    links: list[tuple[str, str]]
    header: bool = False
    rows: int = 1
    columns: int = 1

    @property
    def text(self) -> str:
        return " ".join(x for x in self.lines if x)


def marks(page: str, open_: list[str] | None = None) -> Iterator[tuple[str, bool]]:
    """The page's marks and runs of text, each with whether it stands outside templates, links and references; ``open_``: what is open before, and after."""
    open_ = [] if open_ is None else open_
    for mark in _MARKS.split(page):
        low = mark[:5].lower()
        if not mark or mark.startswith("<!--"):
            continue
        inside = bool(open_)
        if mark in ("{{", "[["):
            open_.append(mark)
        elif mark in _CLOSES and _CLOSES[mark] in open_:
            while open_.pop() != _CLOSES[mark]:
                pass
        elif low.startswith("<ref") and not mark.endswith("/>"):
            open_.append("<ref")
        elif low == "</ref" and "<ref" in open_:
            while open_.pop() != "<ref":
                pass
        yield mark, not inside and not open_


def _value(parts: list[str]) -> str:
    """What a template shows of its values."""
    name, *values = [p.strip() for p in parts]
    plain = [v for v in values if "=" not in v]
    return plain[0] if name.lower() in SHOWN_TEMPLATES and plain else ""


def shown(run: list[str]) -> Cell:
    """The words that marks and text show."""
    links: list[tuple[str, str]] = []
    frames: list[tuple[str, list[str]]] = [("", [""])]

    def put(text: str) -> None:
        frames[-1][1][-1] += text

    def close() -> None:
        kind, parts = frames.pop()
        if kind == "[[":
            if not re.match(r"(?i)(file|image|category):", parts[0]):
                links.append((parts[0].strip(), parts[-1].strip()))
                put(parts[-1])
        elif kind == "{{":
            put(_value(parts))

    for mark in run:
        low = mark.lower()
        if mark in ("{{", "[["):
            frames.append((mark, [""]))
        elif low.startswith("<ref") and not low.endswith("/>"):
            frames.append(("<ref", [""]))
        elif mark in _CLOSES or low.startswith("</ref"):
            kind = _CLOSES.get(mark, "<ref")
            if any(k == kind for k, _ in frames):
                while frames[-1][0] != kind:
                    close()
                close()
        elif mark == "|" and frames[-1][0]:
            frames[-1][1].append("")
        elif re.match(r"<br\b", low):
            put("\n")
        elif not mark.startswith("<"):
            put(" " if mark == "\n" and len(frames) > 1 else mark)
    while len(frames) > 1:
        close()
    text = html.unescape(re.sub("'{2,}", "", frames[0][1][0])).replace("\xa0", " ")
    return Cell([" ".join(line.split()) for line in text.split("\n")], [(a, " ".join(t.split())) for a, t in links])


def _cell(run: list[tuple[str, bool]], header: bool) -> Cell:
    """A cell of its marks: what stands before a bar of its own are attributes."""
    bar = next((i for i, (m, own) in enumerate(run) if own and m == "|"), None)
    attributes = "".join(m for m, _ in run[:bar]) if bar is not None else ""
    cell = shown([m for m, _ in (run if bar is None else run[bar + 1 :])])
    spans = {k.lower(): int(n) for k, n in re.findall(r"(?i)\b(rowspan|colspan)\s*=\s*[\"']?\s*(\d{1,3})", attributes)}
    return dataclasses.replace(cell, header=header, rows=max(1, spans.get("rowspan", 1)), columns=max(1, spans.get("colspan", 1)))


def _cells(line: list[tuple[str, bool]]) -> list[Cell]:
    """The cells of a line that begins with a bar or an exclamation mark."""
    sign, runs, at = line[0][0], [[]], 1
    while at < len(line):
        pair = {line[at][0], line[at + 1][0]} if at + 1 < len(line) and line[at][1] and line[at + 1][1] else set()
        if pair == {"|"} or pair == {"!"} and sign == "!":
            runs.append([])
            at += 2
        else:
            runs[-1].append(line[at])
            at += 1
    return [_cell(r, sign == "!") for r in runs]


@lru_cache(REMEMBERED)
def _plain_cell(text: str) -> Cell:
    return _cell(list(marks(text)), False)


def _plain_cells(line: str) -> list[Cell]:
    """The cells of a plain line that begins with a bar; what it shows of equal cells is worked out once."""
    cells = [""]
    for piece in _WHOLE.split(line[1:]):
        if piece == "||":
            cells.append("")
        else:
            cells[-1] += piece
    return [_plain_cell(c) for c in cells]


def _lines(page: str) -> Iterator[str | list[tuple[str, bool]]]:
    """The page's lines, each as it is if it is plain, and otherwise as marks; a line ends where nothing is open."""
    # a comment or a tag may run over several lines: then nothing is told by a line alone
    if "<!--" in page or re.search(r"<[^<>]*\n", page):
        line: list[tuple[str, bool]] = []
        for mark, own in marks(page):
            if mark == "\n" and own:
                yield line
                line = []
            else:
                line.append((mark, own))
        yield line
        return
    open_: list[str] = []
    line = []
    for text in page.split("\n"):
        if not open_ and _PLAIN.fullmatch(text):
            yield text
            continue
        line.extend(marks(text, open_))
        if open_:
            line.append(("\n", False))
        else:
            yield line
            line = []
    if open_:
        yield line[:-1]


def tables(page: str) -> Iterator[tuple[list[str], list[list[Cell]]]]:
    """(headings above it, rows of cells) of each table of a page that is not inside another."""
    heads, rows, open_ = ["", ""], [], 0
    cell: str | list[tuple[str, bool]] = ""

    def finish() -> None:
        nonlocal cell
        if cell and rows:
            rows[-1].extend(_plain_cells(cell) if isinstance(cell, str) and cell[0] == "|" else _cells(as_marks(cell)))
        cell = ""

    def as_marks(line: str | list[tuple[str, bool]]) -> list[tuple[str, bool]]:
        return list(marks(line)) if isinstance(line, str) else line

    for line in _lines(page):
        text = line if isinstance(line, str) else "".join(m for m, _ in line)
        begins = text.lstrip()
        if begins.startswith("{|"):
            open_ += 1
            if open_ == 1:
                rows = [[]]
        elif open_ > 1:
            open_ -= begins.startswith("|}")
        elif open_ == 1 and begins.startswith("|}"):
            finish()
            open_ = 0
            yield list(heads), [r for r in rows if r]
        elif open_ == 1 and begins.startswith(("|-", "|+")):
            finish()
            rows.append([])
        elif open_ == 1 and line and (line[0] if isinstance(line, str) else line[0][0]) in ("|", "!"):
            finish()
            cell = line
        elif open_ == 1 and cell:
            cell = [*as_marks(cell), ("\n", False), *as_marks(line)]
        elif not open_ and (h := re.fullmatch(r"\s*(==+)(.*?)(==+)\s*", text)):
            level = min(len(h[1]), len(h[3]), 3)
            heads = [shown(_MARKS.split(h[2])).text, ""] if level == 2 else [heads[0], shown(_MARKS.split(h[2])).text]
    if open_ == 1:
        finish()
        yield list(heads), [r for r in rows if r]


def grid(rows: list[list[Cell]]) -> list[list[Cell | None]]:
    """Rows of equal length, every cell in all of its places."""
    placed: dict[tuple[int, int], Cell] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in placed:
                c += 1
            for i in range(r, min(len(rows), r + cell.rows)):
                for j in range(c, c + cell.columns):
                    placed.setdefault((i, j), cell)
            c += cell.columns
    width = max((c for _, c in placed), default=-1) + 1
    return [[placed.get((r, c)) for c in range(width)] for r in range(len(rows))]


def columns_of(rows: list[list[Cell | None]], names: dict[str, list[str]]) -> tuple[int, dict[str, int]]:
    """(row of the header, column by kind) where a row of headers names most of the kinds."""
    best: tuple[int, dict[str, int]] = (-1, {})
    for r, row in enumerate(rows):
        found: dict[str, int] = {}
        for c, cell in enumerate(row):
            if not (cell and cell.header):
                continue
            words = re.findall(r"[a-z#]+", cell.text.lower())
            kind = next((k for k, first in names.items() if words and words[0] in first), None)
            if kind:
                found.setdefault(kind, c)
        if len(found) > len(best[1]):
            best = r, found
    return best


_MONTH = {name.lower(): i for names in (calendar.month_name, calendar.month_abbr) for i, name in enumerate(names) if i} | {"sept": 9}


@lru_cache(REMEMBERED)
def moment(text: str) -> tuple[int | None, int | None, int | None] | None:
    """(year, month, day) as far as a text gives them, in any order; None if it holds anything else or no part of a date."""
    year = month = day = None
    iso = re.fullmatch(r"\s*(\d{4})-(\d\d)-(\d\d)\s*", text)
    if iso:
        return int(iso[1]), int(iso[2]), int(iso[3])
    for word in re.findall(r"\w+", text.lower()):
        number = re.fullmatch(r"(\d+)(st|nd|rd|th)?", word)
        if number and len(number[1]) == 4 and year is None:
            year = int(number[1])
        elif number and len(number[1]) <= 2 and day is None:
            day = int(number[1])
        elif word in _MONTH and month is None:
            month = _MONTH[word]
        else:
            return None
    return None if (year, month, day) == (None, None, None) else (year, month, day)


def day_text(year: int | None, month: int | None, day: int | None) -> str | None:
    """A day, month or year as text; None if there is no such one."""
    try:
        dt.date(year or 0, month or 1, day or 1)
    except ValueError:
        return None
    if day and not month:
        return None
    return "-".join([f"{year:04}"] + [f"{x:02}" for x in (month, day) if x])


def period(text: str) -> tuple[str, str | None] | None:
    """(start, end; None while it goes on) of a stretch of time, each as precise as it is told. What the start leaves out it shares with the end."""
    iso = re.fullmatch(r"\s*(\d{4}-\d\d-\d\d)\s*[-–—]\s*(\S+)\s*", text)
    ends = [iso[1], iso[2]] if iso else [x.strip() for x in re.split(r"\s+-\s+|[–—]", text)]
    if len(ends) != 2:
        return None
    going_on = ends[1].lower() in ONGOING
    first, last = moment(ends[0]), None if going_on else moment(ends[1])
    if first is None or not going_on and last is None:
        return None
    year, month, day = first
    if last:
        if month is None and day is not None:
            month = last[1]
        year = last[0] if year is None else year
        last = (year if last[0] is None else last[0], *last[1:])
    start, end = day_text(year, month, day), day_text(*last) if last else None
    if year is None or start is None or last and end is None:
        return None
    return None if end and end < start[: len(end)] else (start, end)


def _integer(text: str) -> int | None:
    found = re.match(r"\s*(\d+)", text)
    return int(found[1]) if found else None


def reigns(page: str) -> list[dict]:
    """SRC10: the rows of a page's reign tables below weight classes: what the page says, and what it doesn't as null.

    ``number``, ``name``, ``article`` (of the name's link), ``opponent`` and ``note`` (what stands in brackets below the name), ``start``, ``end``, ``current``,
    ``end_note`` (below the dates), ``defences``, ``place`` in its table from 1.  Rows without a name or with dates that can't be read are left out.
    """
    out = []
    for (division, category), cells in tables(page):
        rows = grid(cells)
        top, at = columns_of(rows, REIGN_COLUMNS)
        # a column called reign holds dates where no other does, and numbers otherwise
        if "reign" in at:
            at.setdefault("number" if "dates" in at else "dates", at["reign"])
        if not division.lower().endswith("weight") or "name" not in at or "dates" not in at:
            continue
        place = 0
        for row in rows[top + 1 :]:
            get = lambda kind: row[at[kind]] if kind in at and at[kind] < len(row) and row[at[kind]] else Cell([""], [])  # noqa: B023, E731
            name, when = get("name"), get("dates")
            dates = period(when.lines[0])
            title = re.sub(r"\s*\(\d+\)$", "", name.lines[0])
            if name is when or not title or dates is None:
                continue
            place += 1
            article = next((a for a, t in name.links if t and t in name.lines[0]), None)
            below = " ".join(name.lines[1:]).strip(" ()")
            beaten = re.match(r"(?i)def(?:\.|eated)?\s+(.+)", below)
            out.append({
                "division": division, "category": category, "place": place, "number": _integer(get("number").text), "name": title, "article": article, "opponent": beaten[1] if beaten else None, "note": below if below and not beaten else None,
                "start": dates[0], "end": dates[1], "current": dates[1] is None, "end_note": " ".join(when.lines[1:]).strip(" ()") or None, "defences": _integer(get("defences").text),
            })
    return out


def record(page: str) -> list[dict]:
    """SRC13: the bouts of a page's professional record; a draw or no contest is its own method. Rows that can't be read are left out."""
    out = []
    for (head, _), cells in tables(page):
        rows = grid(cells)
        top, at = columns_of(rows, RECORD_COLUMNS)
        if not re.search(r"(?i)\bprofessional\b.*\brecord\b", head) or len(at) < len(RECORD_COLUMNS):
            continue
        for row in rows[top + 1 :]:
            text = {k: row[c].text if c < len(row) and row[c] else "" for k, c in at.items()}
            result = RESULTS.get(text["result"].lower())
            kind = re.sub(r"\W.*", "", text["type"].upper())
            method = {"draw": "DRAW", "nc": "NC"}.get(result or "", kind if kind in RECORD_METHODS else None)
            told = moment(text["date"])
            date = day_text(*told) if told and None not in told else None
            if not (result and method and date and text["opponent"]):
                continue
            link = next(iter(row[at["opponent"]].links), None)
            over = _integer(text["round"])
            of = re.search(r"\((\d+)\)", text["round"])
            out.append({"result": result, "opponent": text["opponent"], "article": link[0] if link else None, "method": method, "round": over, "scheduled": int(of[1]) if of else over, "date": date})
    return out


REIGN = "division string, category string, place int, number int, name string, article string, opponent string, note string, start string, end string, current boolean, end_note string, defences int"
RECORD = "result string, opponent string, article string, method string, round int, scheduled int, date string"


def parsed(pages: DataFrame, key: str, text: str, parse: Callable[[str], list[dict]], schema: str) -> DataFrame:
    """Rows of each page by ``parse`` (:func:`reigns` or :func:`record`), with the page's key. Null and unreadable pages have none."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = pages.select(F.col(key).alias("page"), F.col(text).cast("string").alias("text"))
    fields = T.StructType.fromDDL(schema).fields
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(k, r) for k, t in zip(b.column("page").to_pylist(), b.column("text").to_pylist()) for r in parse(t or "")]
            columns = [pa.array([r[n] for _, r in got], kinds[f.dataType.simpleString()]) for n, f in zip(names, fields)]
            yield pa.record_batch([pa.array([k for k, _ in got], b.schema.field("page").type), *columns], names=["page", *names])

    return rows.mapInArrow(run, T.StructType([rows.schema["page"], *fields]))
