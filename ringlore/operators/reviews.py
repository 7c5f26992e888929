"""Reviews of what a supplier delivers: conflicts explained, draws capped, proposals and contributions kept, venues decided."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..plans.league import League
from .canon import slug_of
from .graph import connected_components
from .merging import reconciliation, record_verdict

EDIT_SOURCE = "Community edit"


def explained_conflicts(w: League, recent_days: int = 14, short_rounds: int = 3, repeat_days: int = 30) -> DataFrame:
    """DQ10: why fighters have more held than their supplier counts: causes, and what opponents say about one reversed winner.

    ``draw``: more draws than counted; ``repeat``: one opponent twice within ``repeat_days``; ``same-day``: two fights on a day;
    ``recent``, ``short``: no conflict without the last days' or the short fights; ``wins``, ``losses``: more of them, where
    nothing but draws explains it; ``flipped``: no conflict if one fight had gone the other way.  ``flip`` is what the best
    of those fights would do to the opponent: ``mutual`` (clears a conflict), ``open``, ``contradicted`` (breaks a record).
    """
    r = reconciliation(w)
    sup = [F.col(f"sup_{c}") for c in ("wins", "losses", "draws")]
    x = w.counted.join(r.where("verdict = 'conflict'").select("boxer_id", *[F.col(f"sup_{c}") for c in ("wins", "losses", "draws")]), "boxer_id")
    x = x.withColumn("since", F.datediff("date", F.lag("date").over(Window.partitionBy("boxer_id", "opp_id").orderBy("date", "bout_id"))))
    x = x.withColumn("that_day", F.count("*").over(Window.partitionBy("boxer_id", "date")))
    total = lambda result, keep: count_if((F.col("result") == result) & keep)
    sets = {"all": F.lit(True), "old": F.datediff(F.lit(w.as_of), "date") > recent_days, "long": F.col("rounds") > short_rounds}
    sums = [total(result, keep).alias(f"{name}_{result}") for name, keep in sets.items() for result in "WLD"]
    g = x.groupBy("boxer_id", *[f"sup_{c}" for c in ("wins", "losses", "draws")]).agg(*sums, F.max(F.coalesce(F.col("since") <= repeat_days, F.lit(False))).alias("repeat"), (F.max("that_day") > 1).alias("same_day"))
    clear = lambda *own: record_verdict(list(own), sup) != "conflict"
    of = lambda name: [F.col(f"{name}_{result}") for result in "WLD"]
    wins, losses, draws = of("all")
    g = g.withColumns({"recent": clear(*of("old")), "short": clear(*of("long")), "flip_w": (wins > 0) & clear(wins - 1, losses + 1, draws), "flip_l": (losses > 0) & clear(wins + 1, losses - 1, draws)})
    told = F.col("repeat") | F.col("same_day") | F.col("recent") | F.col("short")
    tests = [("draw", draws > sup[2]), ("repeat", F.col("repeat")), ("same-day", F.col("same_day")), ("recent", F.col("recent")), ("short", F.col("short")), ("wins", ~told & (wins > sup[0])), ("losses", ~told & (losses > sup[1])), ("flipped", F.col("flip_w") | F.col("flip_l"))]
    causes = F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))
    out = g.select("boxer_id", F.when(F.size(causes) > 0, F.array_join(causes, ",")).otherwise("unexplained").alias("causes"), "flip_w", "flip_l")
    # the fights that could have gone the other way, with the opponent's record now and then
    o = r.select(F.col("boxer_id").alias("opp_id"), F.col("verdict").alias("was"), *[F.col(c).alias(f"o_{c}") for c in ("wins", "losses", "draws", "sup_wins", "sup_losses", "sup_draws")])
    f = w.counted.join(out.where("flip_w OR flip_l"), "boxer_id").where("(result = 'W' AND flip_w) OR (result = 'L' AND flip_l)").join(o, "opp_id")
    gain = F.when(F.col("result") == "W", 1).otherwise(-1)
    then = record_verdict([F.col("o_wins") + gain, F.col("o_losses") - gain, F.col("o_draws")], [F.col(f"o_sup_{c}") for c in ("wins", "losses", "draws")])
    kind = F.when((F.col("was") == "conflict") & (then != "conflict"), 2).when((F.col("was") == "complete") | (F.col("was") == "partial") & (then == "conflict"), 0).otherwise(1)
    best = f.groupBy("boxer_id").agg(F.max(kind).alias("k")).select("boxer_id", F.element_at(F.array(F.lit("contradicted"), F.lit("open"), F.lit("mutual")), F.col("k") + 1).alias("flip"))
    return out.select("boxer_id", "causes").join(best, "boxer_id", "left")


def capped_draws(bouts: DataFrame, totals: DataFrame) -> DataFrame:
    """LNK03: the drawn bouts (``bout_id``, ``red_id``, ``blue_id``) for which either fighter's supplier has no draw left.

    In order of ``bout_id`` a draw is kept where both fighters' counts (``boxer_id``, ``draws``) have room; fighters without a
    count always have.  Draws depend on each other only through shared fighters, so they are dealt by connected
    component and stream through their task in order.
    """
    links = connected_components(bouts.select(F.col("red_id").alias("u"), F.col("blue_id").alias("v")))
    room = lambda side: totals.select(F.col("boxer_id").alias(f"{side}_id"), F.col("draws").alias(f"{side}_most"))
    x = bouts.join(room("red"), "red_id", "left").join(room("blue"), "blue_id", "left").join(links.select(F.col("node").alias("red_id"), F.col("root").alias("component")), "red_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: dict[int, int] = {}
        component = None
        for batch in batches:
            d, out = batch.to_pydict(), []
            for bout, c, r, b, most_r, most_b in zip(d["bout_id"], d["component"], d["red_id"], d["blue_id"], d["red_most"], d["blue_most"]):
                if c != component:
                    component = c
                    used.clear()
                if all(most is None or used.get(i, 0) < most for i, most in ((r, most_r), (b, most_b))):
                    used[r], used[b] = used.get(r, 0) + 1, used.get(b, 0) + 1
                else:
                    out.append(bout)
            yield pa.record_batch([pa.array(out, pa.int64())], names=["bout_id"])

    dealt = x.select("bout_id", "red_id", "blue_id", "red_most", "blue_most", "component").repartition("component").sortWithinPartitions("component", "bout_id")
    return dealt.mapInArrow(run, "bout_id long")


def reconciled_proposals(changes: DataFrame, proposals: DataFrame, now: Column, scope: Column, memory_days: int = 30) -> DataFrame:
    """STR05: what a run's ``changes`` (``target``, ``kind``, ``new``, ``place``) make of the proposals (``target``, ``fingerprint``, ``status``, ``decided_on``).

    Of several changes of one target the first by ``place`` counts.  A pending proposal is ``unchanged`` or ``updated``; what was
    rejected in the same words less than ``memory_days`` ago is ``remembered``; others are ``added``.  A pending proposal in
    ``scope`` that the run doesn't find is ``superseded``.
    """
    fingerprint = F.substring(F.sha2(F.to_json(F.struct("kind", "new")), 256), 1, 32)
    first = Window.partitionBy("target").orderBy("place")
    c = changes.withColumn("n", F.row_number().over(first)).where("n = 1").select("target", fingerprint.alias("found"))
    pending = proposals.where("status = 'pending'").select("target", F.col("fingerprint").alias("held"))
    recent = proposals.where((F.col("status") == "rejected") & (F.datediff(now, "decided_on") < memory_days)).select("target", F.col("fingerprint").alias("found"), F.lit(True).alias("refused")).distinct()
    x = c.join(pending, "target", "full").join(recent, ["target", "found"], "left")
    outcome = F.when(F.col("found").isNull(), F.when(scope, "superseded")).when(F.col("held") == F.col("found"), "unchanged").when(F.col("held").isNotNull(), "updated").when(F.col("refused"), "remembered").otherwise("added")
    return x.select("target", outcome.alias("outcome")).where("outcome IS NOT NULL")


def replayed_contributions(stints: DataFrame, contributions: DataFrame, people: DataFrame, fighters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """DQ18: (stints with the approved edits in place of all former ones, approved edits of unknown fighters).

    ``stints``: ``boxer_id``, ``person``, ``start``, ``source``; ``contributions``: ``edit_id``, ``boxer_id``, ``name``, ``start``, ``status``; ``people``:
    ``person``, ``name``.  A person is the first of that name, whatever its case, or a new one named by the slug.
    """
    approved = contributions.where("status = 'approved'")
    skipped = approved.join(fighters, "boxer_id", "left_anti")
    known = people.groupBy(F.lower("name").alias("key")).agg(F.min("person").alias("known"))
    placed = approved.join(fighters, "boxer_id", "left_semi").withColumn("key", F.lower("name")).join(known, "key", "left")
    new = F.concat(F.lit("community:"), F.coalesce(F.nullif(slug_of(F.col("name")), F.lit("")), F.lit("person")))
    edits = placed.select("boxer_id", F.coalesce("known", new).alias("person"), "start", F.lit(EDIT_SOURCE).alias("source"))
    return stints.where(F.col("source") != EDIT_SOURCE).unionByName(edits), skipped


def decided_venues(venues: DataFrame, candidates: DataFrame) -> DataFrame:
    """LNK07: venues (``venue_id``, ``name``, ``city``, ``country``) matched with candidates (``qid``, ``label``, ``names``, ``places``, ``countries``, ``caps``), or why not.

    A candidate must go by the venue's name and lie in its city, or, if none does, in its country.  Of several, one
    that is labelled so is taken; else none.  The capacity is the middle one told.
    """
    v, c = venues.alias("v"), candidates.select("*", F.explode("names").alias("called")).alias("c")
    x = v.join(c, F.col("v.name") == F.col("c.called")).select("venue_id", "qid", "caps", F.array_contains("places", F.col("city")).alias("here"), F.array_contains("countries", F.col("country")).alias("near"), (F.col("label") == F.col("v.name")).alias("labelled"))
    one = lambda test: F.struct(count_if(test).alias("n"), count_if(test & F.col("labelled")).alias("labels"), F.min(F.when(test, F.struct("qid", "caps"))).alias("only"), F.min(F.when(test & F.col("labelled"), F.struct("qid", "caps"))).alias("label"))
    g = x.groupBy("venue_id").agg(one(F.col("here")).alias("city"), one(F.col("near")).alias("land"))
    g = venues.select("venue_id").join(g, "venue_id", "left").withColumn("pool", F.when(F.col("city.n") > 0, F.col("city")).otherwise(F.col("land")))
    taken = F.when(F.col("pool.n") == 1, F.col("pool.only")).when(F.col("pool.labels") == 1, F.col("pool.label"))
    status = F.when(F.col("pool").isNull(), "no such name").when(F.col("pool.n") == 0, "elsewhere").when(taken.isNull(), "ambiguous").otherwise("matched")
    caps = F.array_sort(taken["caps"])
    half = F.floor(F.size(caps) / 2).cast("int")
    middle = F.when(F.size(caps) % 2 == 1, F.get(caps, half)).otherwise((F.get(caps, half - 1) + F.get(caps, half)) / 2)
    basis = F.when(taken.isNotNull(), F.when(F.col("city.n") > 0, "city").otherwise("country"))
    return g.select("venue_id", status.alias("status"), taken["qid"].alias("qid"), basis.alias("basis"), F.when(F.size(caps) > 0, middle).cast("double").alias("capacity"))
