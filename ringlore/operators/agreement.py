"""MDL32: facts that several sources state, and whether they agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shuffles import dealt

# How far apart two sources may be, as a share of the larger value; whose word alone doesn't confirm another's.
TOLERANCES = {"weigh_in": 0.005}
TOLERANCE = 0.05
WIKIS = r"(^|\.)(wikipedia|wikidata)\.org$"


def _reach(tolerance: float) -> float:
    # |a - b| <= t max(a, b) is |ln a - ln b| <= -ln(1 - t)
    return -math.log1p(-tolerance) + 1e-12


def judged_facts(claims: DataFrame) -> DataFrame:
    """Each claim's field as ``verified``, ``single_source`` or ``conflict``.

    ``claims``: ``claim_id``, ``kind``, ``subject``, ``field``, ``host``, ``value``, ``official``.  Of each host the claim of the smallest id speaks for it.
    The largest set of hosts that lie within the tolerance of one of them (of equals the smallest value's) is decisive if it has two hosts, not
    all wikis: claims in it are verified, others are in conflict.  Without one, an only official record is verified and the others are in
    conflict.  A lone host is a single source, or verified if official.  Null and negative values take no part.

    Counting who is near is a window over sorted logarithms, not a join of pairs.  All rows of a fact meet by one shuffle, into tasks that sort in memory.
    """
    fact = ["kind", "subject", "field"]
    stated = claims.where("value >= 0").withColumn("official", F.coalesce("official", F.lit(False)))
    own = Window.partitionBy(*fact, "host").orderBy(F.asc_nulls_last("claim_id"))  # a host's claims about one fact
    # by the subject alone: a kind or field that is the same in all rows would keep the windows from standing on this shuffle
    x = dealt(stated, "subject").withColumn("log", F.when(F.col("value") > 0, F.ln("value")).otherwise(-1e6))
    x = x.withColumns({"rep": F.row_number().over(own) == 1, "host_log": F.first("log").over(own), "host_official": F.first("official").over(own)})
    # ranges of doubles are for SQL alone
    over = lambda value, t: F.expr(f"{value} OVER (PARTITION BY kind, subject, field ORDER BY log RANGE BETWEEN {_reach(t)!r}D PRECEDING AND {_reach(t)!r}D FOLLOWING)")
    near, firm = (lambda t: over("count(CASE WHEN rep THEN 1 END)", t)), (lambda t: over("max(CASE WHEN rep THEN sure END)", t))

    def by_kind(make) -> Column:  # noqa: ANN001
        out = F.when(F.lit(False), make(TOLERANCE))
        for kind, t in TOLERANCES.items():
            out = out.when(F.col("kind") == kind, make(t))
        return out.otherwise(make(TOLERANCE))

    x = x.withColumn("sure", (~F.col("host").rlike(WIKIS)).cast("int")).withColumn("near", by_kind(near)).withColumn("firm", by_kind(firm))
    all_ = Window.partitionBy(*fact)
    largest = F.max_by(F.struct("log", "near", "firm"), F.when(F.col("rep"), F.struct("near", F.negative("log"))))
    x = x.withColumns({"c": largest.over(all_), "hosts": F.sum(F.col("rep").cast("long")).over(all_), "officials": F.sum((F.col("rep") & F.col("host_official")).cast("long")).over(all_)})
    within = lambda log: F.abs(F.col(log) - F.col("c.log")) <= by_kind(lambda t: F.lit(_reach(t)))
    decided = (F.col("c.near") >= 2) & (F.col("c.firm") == 1)
    verified = F.when(F.col("hosts") == 1, F.col("host_official")).when(decided, within("host_log") & within("log")).otherwise((F.col("officials") == 1) & F.col("host_official"))
    return x.select("claim_id", *fact, "host", "value", F.when(verified, "verified").when(F.col("hosts") == 1, "single_source").otherwise("conflict").alias("status"))


def judged_claims(claims: DataFrame) -> DataFrame:
    """Each claim: in conflict if a field is, verified if all fields are, else a single source's."""
    x = judged_facts(claims).groupBy("claim_id").agg(F.max(F.col("status") == "conflict").alias("conflict"), F.min(F.col("status") == "verified").alias("verified"))
    return x.select("claim_id", F.when(F.col("conflict"), "conflict").when(F.col("verified"), "verified").otherwise("single_source").alias("status"))
