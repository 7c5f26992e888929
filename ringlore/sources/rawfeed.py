"""SRC11: raw nested JSON as the columns of a feed, by a specification that is data: where a value stands, and what kind it is.

The JSON is parsed once into a VARIANT; values come out by path.  What stands there but can't be read as its kind is null and a row
of problems.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.canon import country_of, division_of

# What a length may be, in centimetres.
LEAST_CM, MOST_CM = 100, 250


@dataclasses.dataclass(frozen=True)
class Field:
    """A column ``name`` of a ``kind``; the first of ``paths`` that holds anything counts. Without a ``needed`` one a row is left out."""

    name: str
    kind: str
    paths: tuple[str, ...]
    needed: bool = False


def length_cm(text: Column) -> Column:
    """A length in whole centimetres: of centimetres, metres, inches, or feet and inches (``180``, ``1.8 m``, ``71 in``, ``5' 11"``, ``5 ft 11``)."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[’′]|feet|foot", "ft"), "[”″\"]|''|inches|inch", "in")
    x = F.regexp_replace(F.regexp_replace(x, "'", "ft"), "½", ".5")
    number = lambda pattern, group: F.nullif(F.regexp_extract(x, pattern, group), F.lit("")).cast("double")
    feet = r"^(\d)\s*ft\.?\s*(?:(\d{1,2}(?:\.\d+)?)\s*(?:in)?\.?)?$"
    inches = F.coalesce(number(feet, 1) * 12 + F.coalesce(number(feet, 2), F.lit(0.0)), number(r"^(\d{2,3}(?:\.\d+)?)\s*in\.?$", 1))
    cm = F.coalesce(inches * 2.54, number(r"^(\d{2,3}(?:\.\d+)?)\s*(?:cm)?$", 1), number(r"^(\d(?:\.\d+)?)\s*m$", 1) * 100)
    whole = F.floor(cm + 0.5).cast("int")
    return F.when(whole.between(LEAST_CM, MOST_CM), whole)


def _plain(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


#: How a value's text is read.
KINDS: dict[str, Callable[[Column], Column]] = {
    "text": _plain,
    "whole": lambda t: F.when(t.rlike(r"^\s*-?\d{1,9}(\.0+)?\s*$"), t.cast("double").cast("int")),
    "day": lambda t: F.when(t.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd")),
    "length": length_cm,
    "country": country_of,
    "division": division_of,
    "stance": lambda t: F.when(F.lower(F.trim(t)).isin("orthodox", "southpaw", "switch"), F.initcap(F.trim(t))),
    "flag": lambda t: F.when(F.lower(t).isin("true", "yes", "1"), True).when(F.lower(t).isin("false", "no", "0"), False),
}

FIGHTER = [
    Field("external_id", "text", ("$.id",), needed=True),
    Field("name", "text", ("$.name", "$.names.full"), needed=True),
    Field("country", "country", ("$.nationality", "$.country.name")),
    Field("division", "division", ("$.division.name", "$.division")),
    Field("stance", "stance", ("$.physical.stance",)),
    Field("height_cm", "length", ("$.physical.height",)),
    Field("reach_cm", "length", ("$.physical.reach",)),
    Field("wins", "whole", ("$.stats.wins",)),
    Field("born", "day", ("$.birth.date",)),
    Field("active", "flag", ("$.active",)),
]


def mapped(raw: DataFrame, key: str, text: str, spec: list[Field]) -> tuple[DataFrame, DataFrame]:
    """(rows: ``key`` and the fields; problems: ``key``, ``field``, ``problem``, ``told``) of JSON texts.

    Problems: ``not_json`` (nothing else is told of such a row), ``missing`` (of a needed field), ``unreadable``.  Rows without a needed field are
    left out.  Null texts are not JSON.
    """
    told = raw.select(key, F.try_parse_json(text).alias("_v"))
    value = lambda f: F.coalesce(*[_plain(F.try_variant_get("_v", p, "string")) for p in f.paths])
    # an object where a value is expected is that object's text; what is inside it stands in another path
    told = told.select(key, F.col("_v").isNull().alias("_broken"), *[F.when(~value(f).startswith("{"), value(f)).alias(f.name) for f in spec])
    read = {f.name: KINDS[f.kind](F.col(f.name)) for f in spec}
    problem = {f.name: F.when(F.col(f.name).isNull(), F.lit("missing") if f.needed else F.lit(None)).when(read[f.name].isNull(), "unreadable") for f in spec}
    each = [F.struct(F.lit(f.name).alias("field"), problem[f.name].alias("problem"), F.col(f.name).alias("told")) for f in spec]
    found = F.when(F.col("_broken"), F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit("not_json").alias("problem"), F.lit(None).cast("string").alias("told")))).otherwise(F.array(*each))
    problems = told.select(key, F.explode(found).alias("p")).select(key, "p.*").where("problem IS NOT NULL")
    rows = told.where("NOT _broken").select(key, *[c.alias(n) for n, c in read.items()]).dropna(subset=[f.name for f in spec if f.needed])
    return rows, problems
