"""Column expressions whose semantics differ from Spark's own functions."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

# Result methods by family.
STOPPAGES = ("KO", "TKO", "RTD")
REFEREE_STOPPAGES = ("KO", "TKO")
DECISIONS = ("UD", "MD", "SD", "TD")
DRAWS = ("DRAW", "TDRAW")
METHODS = ("KO", "TKO", "RTD", "DQ", "UD", "MD", "SD", "TD", "DRAW", "TDRAW", "NC")

#: A month of the league is 30.4 days, not a calendar month.
MONTH_DAYS = 30.4


def half_up(c: Column) -> Column:
    """Rounds .5 towards positive infinity, to a long."""
    return F.floor(c + 0.5).cast("long")


def counts(method: Column) -> Column:
    """Whether a result counts in a record: known and not a no contest."""
    return method.isNotNull() & (method != "NC")


def is_stoppage(method: Column) -> Column:
    return F.coalesce(method.isin(*STOPPAGES), F.lit(False))


def is_decision(method: Column) -> Column:
    return F.coalesce(method.isin(*DECISIONS), F.lit(False))


def months_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a) / F.lit(MONTH_DAYS)


def months_before(day: dt.date, months: float) -> dt.date:
    """The day ``months`` league months before ``day``."""
    return day - dt.timedelta(days=months * MONTH_DAYS)


def share(part: Column, whole: Column) -> Column:
    """part / whole, and 0 for nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def expected(a: Column, b: Column) -> Column:
    """Elo expectation of rating ``a`` against ``b``."""
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def weighted_parts(parts: list[tuple[float, Column]]) -> tuple[Column, Column]:
    """(weighted sum of the known parts, weight of the known parts)."""
    known = [(F.when(c.isNotNull(), F.lit(w)).otherwise(0.0), F.coalesce(c, F.lit(0.0)) * w) for w, c in parts]
    return reduce(lambda a, b: a + b, [v for _, v in known]), reduce(lambda a, b: a + b, [w for w, _ in known])


def seconds_in(end_round: Column, clock: Column) -> Column:
    """Seconds from the first bell: rounds of three minutes and the clock ``m:ss`` of the last one."""
    m, s = F.regexp_extract(clock, r"^(\d+):(\d{2})$", 1), F.regexp_extract(clock, r"^(\d+):(\d{2})$", 2)
    known = F.coalesce(clock.rlike(r"^\d+:\d{2}$"), F.lit(False))
    return (end_round - 1) * 180 + F.when(known, m.cast("int") * 60 + s.cast("int")).otherwise(0)


def islands(key: list[str], order: list[str], breaks: Column) -> Column:
    """Number of the run that a row belongs to; a row where ``breaks`` holds starts a new one."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(breaks, 1).otherwise(0)).over(w)
