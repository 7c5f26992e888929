"""Names in one spelling: marks dropped, variants of letters and suffixes as one, in every script."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that don't count (Latin, Arabic vowels, tatweel), letters that don't come apart by marks, suffixes as written and as typed.
MARKS = "[̀-ًͯ-ٰٟـ]"
ARABIC_LETTERS = {"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه"}
LATIN_LETTERS = {"ł": "l", "đ": "d", "ð": "d", "ø": "o", "ı": "i", "æ": "ae", "œ": "oe", "ß": "ss", "þ": "th"}
SUFFIXES = {"junior": "jr", "senior": "sr", "2nd": "ii", "3rd": "iii", "4th": "iv"}


@cache
def composed_letters() -> tuple[str, str]:
    """Every letter that is a plain letter with marks that don't count, and its plain letter; by canonical decomposition."""
    found = []
    for c in map(chr, [*range(0x80, 0xAC00), *range(0xF900, 0x10000)]):
        plain, *marks = unicodedata.normalize("NFD", c)
        if plain != c and re.fullmatch(f"{MARKS}*", "".join(marks)):
            found.append((c, plain))
    return "".join(c for c, _ in found), "".join(p for _, p in found)


def _one_for_one(text: Column, letters: dict[str, str]) -> Column:
    return F.translate(text, "".join(letters), "".join(letters.values()))


def folded(text: Column) -> Column:
    """FN01: a text as spellings meet: no marks, one form of Arabic letters, lower case, plain Latin letters, short suffixes, single spaces."""
    x = F.regexp_replace(F.translate(text, *composed_letters()), MARKS, "")
    x = F.lower(_one_for_one(x, ARABIC_LETTERS))
    x = _one_for_one(x, {a: b for a, b in LATIN_LETTERS.items() if len(b) == 1})
    for letter, letters in LATIN_LETTERS.items():
        if len(letters) > 1:
            x = F.replace(x, F.lit(letter), F.lit(letters))
    for written, typed in SUFFIXES.items():
        x = F.regexp_replace(x, rf"(?U)\b{written}\b", typed)
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def name_key(name: Column) -> Column:
    """The letters and digits of a folded name, its words joined by one space; null where there are none, so that it never joins."""
    key = F.trim(F.regexp_replace(folded(name), r"[^\p{L}\p{M}\p{N}]+", " "))
    return F.when(key != "", key)


def folded_word(text: str) -> str:
    """:func:`folded` of what is typed."""
    table = str.maketrans(dict(zip(*composed_letters())))
    text = re.sub(MARKS, "", text.translate(table)).translate(str.maketrans(ARABIC_LETTERS)).lower().translate(str.maketrans(LATIN_LETTERS))
    for written, typed in SUFFIXES.items():
        text = re.sub(rf"\b{written}\b", typed, text)
    return " ".join(text.split())
