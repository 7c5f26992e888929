"""Snapshots merged, compared and validated."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..plans.league import League
from ..sources import star
from ..storage import written
from .graph import connected_components
from .validation import validated

FIELDS = ["method", "winner_id", "end_round", "round_time"]


def snapshots(w: League) -> tuple[DataFrame, DataFrame]:
    """Two versions of the bouts: what is held (six of seven bouts, some results missing) and what is delivered (eight of nine, some results withdrawn)."""
    b = w.bouts.select("bout_id", "cancelled", *FIELDS)
    held = b.where("bout_id % 7 <> 0").withColumn("method", F.when(F.col("bout_id") % 5 != 0, F.col("method"))).withColumn("end_round", F.when(F.col("bout_id") % 4 != 0, F.col("end_round")))
    given = b.where("bout_id % 9 <> 0").withColumn("method", F.when(F.col("bout_id") % 11 != 0, F.col("method"))).withColumn("round_time", F.when(F.col("bout_id") % 3 != 0, F.col("round_time")))
    return held, given


def upsert(w: League) -> DataFrame:
    """SNK01, SNK02: delivered rows over held ones by id.

    ``winner_id`` is overwritten, ``end_round`` and ``round_time`` keep what is held where nothing is delivered, and a
    delivered null result does not erase a held one unless the bout is cancelled.
    """
    held, given = snapshots(w)
    h, g = held.alias("h"), given.alias("g")
    keep = lambda f: F.coalesce(F.col(f"g.{f}"), F.col(f"h.{f}")).alias(f)
    new = F.col("g.bout_id").isNotNull()
    method = F.when(~new, F.col("h.method")).when(F.col("g.method").isNull() & ~F.col("g.cancelled"), F.col("h.method")).otherwise(F.col("g.method"))
    x = h.join(g, F.col("h.bout_id") == F.col("g.bout_id"), "full")
    return x.select(F.coalesce("g.bout_id", "h.bout_id").alias("bout_id"), method.alias("method"), F.when(new, F.col("g.winner_id")).otherwise(F.col("h.winner_id")).alias("winner_id"), keep("end_round"), keep("round_time"))


def replace_per_source(w: League) -> DataFrame:
    """SNK03, SNK04: purses held, with those of every source and bout that is delivered anew replaced."""
    held = w.purses.where("bout_id % 2 = 0")
    new = w.purses.where("bout_id % 3 = 0").withColumn("usd", F.col("usd") * 2)
    kept = held.join(new.select("bout_id", "source").distinct(), ["bout_id", "source"], "left_anti")
    return kept.unionByName(new).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("usd"), 2).alias("usd"))


def ledger(w: League) -> DataFrame:
    """SNK06, STR07: rows for (bout, day) that the ledger does not have yet."""
    days = w.bouts.where("upcoming").select("bout_id", F.explode(F.array(*[F.date_sub(F.lit(w.as_of), i) for i in range(3)])).alias("locked_on"))
    have = days.where("bout_id % 2 = 0 AND locked_on < DATE '2000-06-30'")
    return days.join(have, ["bout_id", "locked_on"], "left_anti")


def changes(w: League) -> DataFrame:
    """STR02, SET03: differences of the two snapshots by field: fill, clear or replace."""
    held, given = snapshots(w)
    h, g = held.alias("h"), given.alias("g")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"h.{f}").cast("string").alias("old"), F.col(f"g.{f}").cast("string").alias("new")) for f in FIELDS])
    x = h.join(g, F.col("h.bout_id") == F.col("g.bout_id")).select(F.col("h.bout_id").alias("bout_id"), F.explode(each).alias("c")).select("bout_id", "c.*")
    kind = F.when(F.col("old").isNull(), "fill").when(F.col("new").isNull(), "clear").otherwise("replace")
    return x.where(~F.col("old").eqNullSafe(F.col("new"))).withColumn("kind", kind)


def change_flood(w: League, most_share: float = 0.3, most_rows: int = 100) -> DataFrame:
    """STR03: fields of which too many rows change at once."""
    of = snapshots(w)[0].count()
    x = changes(w).groupBy("field").agg(F.count("*").alias("n"), count_if(F.col("kind") == "clear").alias("cleared"))
    return x.withColumn("refused", (F.col("n") >= most_rows) & (F.col("n") / max(1, of) > most_share))


def list_diff(w: League) -> DataFrame:
    """STR17: rows added, changed and removed between the snapshots."""
    held, given = snapshots(w)
    h, g = held.withColumn("sig", F.xxhash64(*FIELDS)).alias("h"), given.withColumn("sig", F.xxhash64(*FIELDS)).alias("g")
    x = h.join(g, F.col("h.bout_id") == F.col("g.bout_id"), "full")
    what = F.when(F.col("h.bout_id").isNull(), "added").when(F.col("g.bout_id").isNull(), "removed").when(F.col("h.sig") != F.col("g.sig"), "changed").otherwise("same")
    return x.groupBy(what.alias("what")).agg(F.count("*").alias("n"))


def issues(w: League) -> DataFrame:
    """DQ01 of the league as a supplier might deliver it."""
    return validated(star.feed(w), w.as_of.isoformat())[0]


def _smallest_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of each group a task has, with the two smallest ids."""
    group = ["severity", "code", "entity"]
    n: dict[tuple[str, str, str], int] = {}
    ids: dict[tuple[str, str, str], list[str]] = {}
    for batch in batches:
        key = pc.binary_join_element_wise(*[batch.column(c) for c in group], "\x1f").dictionary_encode()
        for i, name in enumerate(key.dictionary.to_pylist()):
            own, told = batch.column("id").filter(pc.equal(key.indices, i)), tuple(name.split("\x1f"))
            n[told] = n.get(told, 0) + len(own)
            known = own.drop_null()
            ids[told] = sorted([*ids.get(told, []), *known.take(pc.bottom_k_unstable(known, min(2, len(known)))).to_pylist()])[:2]
    columns = [pa.array([k[i] for k in n], pa.string()) for i in range(3)]
    yield pa.record_batch([*columns, pa.array(n.values(), pa.int64()), pa.array(ids.values(), pa.list_(pa.string()))], names=[*group, "n", "ids"])


def issue_groups(w: League) -> DataFrame:
    """DQ03: issues by code with the two smallest ids.  Issues are neither written nor sorted: a task gives a row for each group."""
    parts = issues(w).select("severity", "code", "entity", "id").mapInArrow(_smallest_two, "severity string, code string, entity string, n long, ids array<string>")
    smallest = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, 2)
    return parts.groupBy("severity", "code", "entity").agg(F.sum("n").alias("n"), F.array_join(smallest, ",").alias("examples")).select("code", "entity", "severity", "n", "examples")


def double_bookings(w: League) -> DataFrame:
    """DQ04: fighters of more than one live bout on a day."""
    return w.long.where("NOT cancelled").groupBy("boxer_id", "date").agg(F.count("*").alias("bouts")).where("bouts > 1")


def overlapping_stints(w: League) -> DataFrame:
    """DQ05: stints that begin before the one before has ended, once every fifth end is moved by a year."""
    s = w.stints.withColumn("end", F.when(F.col("boxer_id") % 5 == 0, F.date_add("end", 365)).otherwise(F.col("end")))
    after = F.lead("start").over(Window.partitionBy("boxer_id").orderBy("start", "person_id"))
    return s.withColumn("next", after).where(F.col("next") < F.coalesce("end", F.lit("9999-12-31").cast("date"))).select("boxer_id", "person_id", "start", "next")


def card_conflicts(w: League) -> DataFrame:
    """DQ06: decisions whose cards do not give the result: three for the winner, two and one even, or two to one."""
    v = F.when(F.col("winner_id").isNull(), 0).when((F.col("red") > F.col("blue")) == (F.col("winner_id") == F.col("red_id")), 1).otherwise(-1)
    x = w.scorecards.withColumn("v", F.when(F.col("red") == F.col("blue"), 0).otherwise(v)).groupBy("bout_id", "method")
    c = x.agg(count_if(F.col("v") == 1).alias("with_winner"), count_if(F.col("v") == 0).alias("even"), count_if(F.col("v") == -1).alias("against"))
    ok = F.when(F.col("method") == "UD", F.col("with_winner") == 3).when(F.col("method") == "MD", (F.col("with_winner") == 2) & (F.col("even") == 1))
    return c.where(~ok.when(F.col("method") == "SD", (F.col("with_winner") == 2) & (F.col("against") == 1)).when(F.col("method") == "TD", F.col("with_winner") >= 2).otherwise(True))


def supplier_totals(w: League) -> DataFrame:
    """A supplier's record of each fighter: as held, but for men of two classes, of whom some are short and some have more or other results."""
    k, touched = F.col("boxer_id"), (F.col("sex") == "male") & F.col("division").isin("BUILDING", "MACHINERY")
    off = lambda c: F.when(touched, c).otherwise(0)
    return w.careers.select(
        "boxer_id", (F.col("wins") + off(F.when(k % 41 == 0, -1).when(k % 5 == 0, k % 3).otherwise(0))).alias("sup_wins"), (F.col("losses") + off(F.when(k % 82 == 0, 1).otherwise(0))).alias("sup_losses"),
        (F.col("draws") - off(F.when(k % 123 == 0, 1).otherwise(0))).alias("sup_draws"),
    )


def record_verdict(own: list[Column], told: list[Column]) -> Column:
    """Whether wins, losses and draws held are all those told (complete), no more of any (partial), or more of one (conflict)."""
    more = reduce(lambda a, b: a | b, [a > b for a, b in zip(own, told)])
    same = reduce(lambda a, b: a & b, [a == b for a, b in zip(own, told)])
    return F.when(more, "conflict").when(same, "complete").otherwise("partial")


def reconciliation(w: League, totals: DataFrame | None = None) -> DataFrame:
    """DQ08: what is held of a fighter's record against a supplier's totals: complete, partial, conflict."""
    names = ("wins", "losses", "draws")
    x = w.careers.select("boxer_id", *names).join(supplier_totals(w) if totals is None else totals, "boxer_id")
    return x.withColumn("verdict", record_verdict([F.col(n) for n in names], [F.col(f"sup_{n}") for n in names]))


def coherent_core(w: League) -> DataFrame:
    """DQ09: the largest set of complete fighters all of whose opponents are in the set.

    Rounds of anti-joins until nothing leaves; each round's set is a written table.
    """
    met = written(w.counted.select("boxer_id", "opp_id").distinct(), "opponents")
    core = written(reconciliation(w).where("verdict = 'complete'").select("boxer_id"), "core")
    n = core.count()
    while True:
        out = met.join(core.select(F.col("boxer_id").alias("opp_id")), "opp_id", "left_anti").select("boxer_id").distinct()
        core = written(core.join(out, "boxer_id", "left_anti"), "core")
        if (now := core.count()) == n:
            return core
        n = now


def components(w: League) -> DataFrame:
    """DQ13: fighters by the smallest id that bouts link them to."""
    found = connected_components(w.counted.select(F.col("boxer_id").alias("u"), F.col("opp_id").alias("v")))
    return found.select(F.col("node").alias("boxer_id"), F.col("root").alias("label"))


def stratified_sample(w: League, n: int = 10, seed: int = 7) -> DataFrame:
    """DQ16: ``n`` fighters of each division and sex, drawn by a hash."""
    own = Window.partitionBy("division", "sex").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("boxer_id").cast("string"))), "boxer_id")
    return w.fighters.withColumn("n", F.row_number().over(own)).where(F.col("n") <= n).select("division", "sex", "boxer_id")


def settlement(w: League) -> DataFrame:
    """DQ19: raw results by the first reason not to trust them."""
    b = w.bouts
    decided = F.col("method").isin("KO", "TKO", "RTD", "UD", "MD", "SD", "TD", "DQ")
    why: Column = F.when(F.col("cancelled"), "cancelled").when(F.col("method").isNull() & (F.col("date") > F.lit(w.as_of)), "not yet").when(F.col("method").isNull(), "no method")
    why = why.when(decided & F.col("winner_id").isNull(), "decision without winner").when(F.col("end_round") > F.col("rounds"), "rounds raised").when(F.col("end_round").isNull(), "end unknown")
    return b.groupBy(why.otherwise("settled").alias("reason")).agg(F.count("*").alias("n"))


def repeat_fights(w: League) -> DataFrame:
    """WIN20, LNK02: meetings of one pair within a day of each other as one cluster, and whether results agree."""
    a, b = F.least("red_id", "blue_id").alias("a_id"), F.greatest("red_id", "blue_id").alias("b_id")
    own = Window.partitionBy("a_id", "b_id").orderBy("date", "bout_id")
    x = w.decided.select("bout_id", "date", a, b, "winner_id").withColumn("apart", F.datediff("date", F.lag("date").over(own)) > 1)
    x = x.withColumn("cluster", F.sum(F.when(F.col("apart"), 1).otherwise(0)).over(own))
    won = F.coalesce("winner_id", F.lit(-1))
    y = x.groupBy("a_id", "b_id", "cluster").agg(F.count("*").alias("n"), F.min("bout_id").alias("first_id"), (F.min(won) < F.max(won)).alias("disagree"))
    return y.where("n > 1").drop("cluster")
