"""Wikitext tables on pages of our own: spans, nesting, headers in any order, dates at three precisions."""

import pytest

from ringlore.plans.league import League
from ringlore.sources import star
from ringlore.sources import wikitables as wt

CLASS = """Intro with a {{template|a
| b}} and a <!-- {| hidden
|} --> comment.
==Strawweight==
Some words.
===Full champion===
{| class="wikitable" style="text-align:center"
|+ Holders
! scope="col" | Defenses !! Champion<ref>{{cite|url=a
|b}}</ref>
! Held
! No.
|-
| 2 || '''[[Una First (athlete)|Una First]]'''<br />{{small|(def. [[Otto Other]])}} || 3 May 1990 – 4 June 1991<br>(stripped) || rowspan="3" | 1
|-
| 0 || Dos&nbsp;Second (2)<br>(awarded) || June 1991 &ndash; 1992
|-
| &mdash; || [[Tres]] || 5 – 9 July 1993
|-
| colspan=4 | Vacant
|-
| 4 || Cuatro || Smarch 1994 – 1995 || 2
|-
| 1 (3) || Cinco {{sup|note|[[x|y]]}} || 2001-02-03 – present || 3
|}
===Interim===
{|
! # !! Name !! Reign !! Defences
|-
! 1
| Inter || 31 April 1999 – 1 May 2000 || 1
|-
! 2
|
Below
|| 1 May 2000 - 30 April 2000 || 1
|-
! 3 || Good || 30 Apr – 1 May 2000 || none
|}
==Rules==
{|
! No !! Name !! Dates
|-
| 1 || X || 1990 – 1991
|}
"""


def test_reigns():
    got = [(r["category"], r["place"], r["number"], r["name"], r["article"], r["opponent"], r["note"], r["start"], r["end"], r["current"], r["end_note"], r["defences"]) for r in wt.reigns(CLASS)]
    assert {r["division"] for r in wt.reigns(CLASS)} == {"Strawweight"}
    assert got == [
        ("Full champion", 1, 1, "Una First", "Una First (athlete)", "Otto Other", None, "1990-05-03", "1991-06-04", False, "stripped", 2),
        ("Full champion", 2, 1, "Dos Second", None, None, "awarded", "1991-06", "1992", False, None, 0),
        ("Full champion", 3, 1, "Tres", "Tres", None, None, "1993-07-05", "1993-07-09", False, None, None),
        ("Full champion", 4, 3, "Cinco", None, None, None, "2001-02-03", None, True, None, 1),
        ("Interim", 1, 3, "Good", None, None, None, "2000-04-30", "2000-05-01", False, None, None),
    ]


def test_record():
    page = """== Professional boxing record ==
{| class="wikitable"
! rowspan="2" | No. !! rowspan="2" | Date !! colspan="2" | Outcome !! rowspan="2" | Opponent !! rowspan="2" | Round, time
|-
! Result !! Type
|-
| 6 || 2 Jan 1990 || {{yes2|Win}} || TKO || [[Al (x)|Al]] || 3 (10), 1:02
|-
| 5 || March 3, 1989 || rowspan=2 {{x}} | Loss || UD || Bo || 8
|-
| 4 || 1988-04-05 || {{small|SD}} || Cy || 6 (6)
|-
| 3 || Feb 30, 1988 || Win || KO || Di || 1
|-
| 2 || May 1988 || Win || KO || Di || 1
|-
| 1 || 1 June 1987 || No contest || TKO || Ed || 2 (4)
|-
| 0 || 1 June 1986 || Draw || PTS || Flo || 4
|}
"""
    assert [tuple(r.values()) for r in wt.record(page)] == [
        ("win", "Al", "Al (x)", "TKO", 3, 10, "1990-01-02"), ("loss", "Bo", None, "UD", 8, 8, "1989-03-03"), ("loss", "Cy", None, "SD", 6, 6, "1988-04-05"), ("nc", "Ed", None, "NC", 2, 4, "1987-06-01"), ("draw", "Flo", None, "DRAW", 4, 4, "1986-06-01"),
    ]
    assert wt.record(page.replace("Professional boxing", "Amateur")) == [] and wt.record("") == [] and wt.reigns("{| x\n! unfinished") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1 Jan 2000 – 2 Feb 2001", ("2000-01-01", "2001-02-02")), ("Feb 26 – 1 Mar 1933", ("1933-02-26", "1933-03-01")), ("September 4, 1980 — now", ("1980-09-04", None)), ("1980 – 1981", ("1980", "1981")), ("2001-02-03-2001-03-04", ("2001-02-03", "2001-03-04")),
        ("10 No 1972 – 11 Apr 1974", None), ("24 Ma 1980 – 6 Feb 1982", None), ("22 Jun 2002", None), ("3 May 2001 – 1 May 2001", None), ("29 Feb 2001 – 2002", None), ("present – 2001", None), ("2001 – 2002 – 2003", None), ("", None), ("5 – present", None),
    ],
)
def test_period(text, want):
    assert wt.period(text) == want


def test_grid():
    rows = wt.grid([[wt.Cell(["a"], [], rows=2), wt.Cell(["b"], [], columns=2)], [wt.Cell(["c"], [], rows=9), wt.Cell(["d"], [])], [wt.Cell(["e"], [])]])
    assert [[c and c.text for c in r] for r in rows] == [["a", "b", "b"], ["a", "c", "d"], ["e", "c", None]]


def test_parsed(spark):
    pages = spark.createDataFrame([(1, CLASS), (2, None), (3, "no tables")], "id long, text string")
    rows = wt.parsed(pages, "id", "text", wt.reigns, wt.REIGN).collect()
    assert [r.page for r in rows] == [1] * 5 and rows[0].article == "Una First (athlete)" and rows[3].current
    assert wt.parsed(pages.limit(0), "id", "text", wt.record, wt.RECORD).count() == 0


def test_plain_lines_read_as_by_marks():
    page = "{|\n| a || {{yes2|Win}} || x=1 | [[A|B]] c || d ||| e\n! f !! g || h\n| i\ncontinued || j\n| {{small|k\n|l}} || m <br> n\n|}\n"
    (_, rows), commented = next(wt.tables(page)), list(wt.tables(page + "<!-- -->"))
    assert commented == [(["", ""], rows)]
    assert [[c.lines for c in r] for r in rows] == [[["a"], ["Win"], ["B c"], ["d"], ["e"], ["f"], ["g"], ["h"], ["i", "continued"], ["j"], ["k"], ["m", "n"]]]
    assert [c.text for c in wt._plain_cells("| a || {{yes2|Win}} || x=1 | [[A|B]] c")] == ["a", "Win", "B c"]


def test_record_pages_need_no_ratings(spark):
    def none(w):
        raise AssertionError("ratings were asked for")

    w = League(spark, "/root/testdata/sf0.001", ratings=none)
    got = wt.parsed(star.record_pages(w), "page", "text", wt.record, wt.RECORD)
    assert got.count() == 2 * w.bouts.where("method IS NOT NULL").count() > 0
