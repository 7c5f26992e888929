"""What trainers add (MDL17), and what a change of trainer does (MDL18)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.league import League
from ..storage import written
from .joins import rating_at
from .models import sigmoid

# Steps and penalties of the fit, bounds of evidence and verdicts, bouts on either side of a move.
PASSES, STEP, FIGHTER_PENALTY, TRAINER_PENALTY = 70, 0.8, 0.05, 8.0
STRONG, SOME = 40, 8
CLEAR, LEANING = 1.96, 1.28
AFTER, LEAST_AFTER, LEAST_BEFORE, LEAST_STUDIED = 6, 3, 2, 10
#: change in a parameter (a sixtieth of a rating point) below which the fit has settled; numbers of fighters and trainers whose values travel
#: together, as bits; fighters and trainers up to which their values are broadcast (64 MB)
SETTLED, CHUNK_BITS, MOST_BROADCAST = 1e-4, 12, 8_000_000
ELO = 400 / math.log(10)


def _numbered(ids: DataFrame, label: str) -> DataFrame:
    """``id`` and a number ``at`` that follows the order of ids; numbers of one task follow each other, so a chunk of them has few gaps."""
    ids = written(ids.toDF("id").repartitionByRange("id").sortWithinPartitions("id"), label)
    return written(ids.withColumn("at", F.monotonically_increasing_id()), label)


def _observations(w: League, fighters: DataFrame, trainers: DataFrame) -> DataFrame:
    """Counted bouts of which one corner's trainer is known at least, equal ones counted once, a row for each corner (``own``) and sorted into tasks by it.

    Fighters are numbers from 0 up, trainers from -1 down.  A fighter's stints travel as one row, so the trainer of a bout (that of JOIN09) needs no join of its own.
    """
    t = w.stints.where("start IS NOT NULL OR end IS NOT NULL").join(trainers.select(F.col("id").alias("person_id"), "at"), "person_id")
    t = t.groupBy("boxer_id").agg(F.collect_list(F.struct("start", "person_id", "end", "at")).alias("stints"))
    t = fighters.select(F.col("id").alias("boxer_id"), "at").join(t, "boxer_id", "left")
    won = F.when(F.col("result") == "W", 1.0).when(F.col("result") == "D", 0.5).otherwise(0.0)
    inside = lambda s: F.coalesce(F.col("date") >= s["start"], F.lit(True)) & F.coalesce(F.col("date") < s["end"], F.lit(True))
    x = w.corners.where("counted").select("bout_id", "boxer_id", "side", "date", "result").join(t, "boxer_id")
    x = x.select("bout_id", (F.col("side") == "red").alias("red"), "at", F.array_min(F.filter("stints", inside))["at"].alias("t"), won.alias("won"))
    of = lambda red, c, n: F.max(F.when(F.col("red") == red, F.col(c))).alias(n)
    x = x.groupBy("bout_id").agg(of(True, "at", "a"), of(False, "at", "b"), of(True, "t", "a_t"), of(False, "t", "b_t"), of(True, "won", "won"))
    x = x.where("a_t IS NOT NULL OR b_t IS NOT NULL").groupBy("a", "b", "a_t", "b_t").agg(F.count("*").alias("n"), F.sum("won").alias("won"))
    corner = lambda a, b, won: F.struct(F.col(a).alias("own"), F.col(b).alias("opp"), F.col(f"{a}_t").alias("own_t"), F.col(f"{b}_t").alias("opp_t"), "n", won.alias("won"))
    both = F.array(corner("a", "b", F.col("won")), corner("b", "a", F.col("n") - F.col("won")))
    return written(x.select(F.explode(both).alias("c")).select("c.*").repartitionByRange("own", "opp"), "impact-observations")


def _valued(rows: DataFrame, now: DataFrame | None, few: bool, keys: list[str]) -> DataFrame:
    """Adds ``v_`` and the key for each of the keys, its current value; 0 before the first pass and for nobody."""
    for key in keys:
        if now is None:
            rows = rows.withColumn(f"v_{key}", F.lit(0.0))
            continue
        chunks = now.select(F.col("chunk").alias("_chunk"), F.col("values").alias("_values"))
        rows = rows.join(F.broadcast(chunks) if few else chunks, F.shiftright(key, CHUNK_BITS) == F.col("_chunk"), "left")
        place = F.col(key).bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int")
        rows = rows.withColumn(f"v_{key}", F.coalesce(F.get("_values", place), F.lit(0.0))).drop("_chunk", "_values")
    return rows


def _chances(obs: DataFrame, now: DataFrame | None, few: bool) -> DataFrame:
    """Adds ``p``, the chance of ``own`` at the current values, and the observation's curvature ``h``."""
    x = _valued(obs, now, few, ["own", "own_t", "opp", "opp_t"])
    x = x.withColumn("p", sigmoid(F.col("v_own") + F.col("v_own_t") - F.col("v_opp") - F.col("v_opp_t")))
    return x.withColumn("h", F.col("n") * F.col("p") * (1 - F.col("p")))


def _chunks(values: DataFrame) -> DataFrame:
    """``key``, ``v`` and ``moved`` as a row for each chunk of numbers: the values in their places, 0 where there is none, and the largest move."""
    place = F.col("key").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int")
    x = values.groupBy(F.shiftright("key", CHUNK_BITS).alias("chunk")).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "v"))).alias("entries"), F.max("moved").alias("moved"))
    gap = lambda e, i: e["place"] - F.when(i == 0, 0).otherwise(F.get("entries", i - 1)["place"] + 1)
    filled = F.flatten(F.transform("entries", lambda e, i: F.concat(F.array_repeat(F.lit(0.0), gap(e, i)), F.array(e["v"]))))
    return x.select("chunk", filled.alias("values"), "moved")


def trainer_impact(w: League, passes: int = PASSES) -> DataFrame:
    """MDL17: trainers' effects in rating points beside fighters' levels: one fit over all bouts with a known trainer on either side.

    Damped Newton steps for all parameters at once.  The current values are chunks of ``1 << CHUNK_BITS`` doubles, up to ``MOST_BROADCAST`` of them broadcast; so a pass reads the
    observations where they lie and shuffles but partial sums of gradient and curvature, about one for each parameter, since the rows of a fighter lie together.
    The error of an effect rests on bouts of fighters who also worked with someone else (only they tell a trainer from their fighters), ``informative`` of them;
    with few the verdict is unclear.
    """
    fighters = _numbered(w.fighters.select("boxer_id"), "impact-fighters")
    trainers = _numbered(w.stints.select("person_id").where("person_id IS NOT NULL").distinct(), "impact-trainers").withColumn("at", -1 - F.col("at"))
    obs = _observations(w, fighters, trainers)
    few = fighters.count() + trainers.count() <= MOST_BROADCAST
    now, penalty = None, F.when(F.col("key") >= 0, FIGHTER_PENALTY).otherwise(TRAINER_PENALTY)
    for number in range(passes):
        x = _chances(obs, now, few).withColumn("g", F.col("won") - F.col("n") * F.col("p"))
        each = F.array(*[F.struct(F.col(c).alias("key"), "g", "h") for c in ("own", "own_t")])
        sums = x.select(F.explode(each).alias("e")).select("e.*").where("key IS NOT NULL").groupBy("key").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        step = STEP * (F.col("g") - penalty * F.col("v_key")) / (F.col("h") + penalty)
        now = written(_chunks(_valued(sums, now, few, ["key"]).select("key", (F.col("v_key") + step).alias("v"), F.abs(step).alias("moved"))), "impact-values")
        # the values have settled once none moves any more
        if number % 5 == 4 and (now.agg(F.max("moved")).first()[0] or 0.0) < SETTLED:
            break
    worked = _chances(obs, now, few).where("own_t IS NOT NULL").groupBy("own", "own_t").agg(F.sum("n").alias("n"), F.sum("h").alias("h"))
    info = F.when(F.count("*").over(Window.partitionBy("own")) > 1, F.col("h")).otherwise(0.0)  # a fighter's trainers
    per = worked.select("own_t", "n", info.alias("info")).groupBy("own_t").agg(F.sum("info").alias("info"), F.sum("n").alias("fights"), F.count("*").alias("fighters"))
    out = _valued(per, now, few, ["own_t"]).join(trainers.select(F.col("id").alias("trainer_id"), F.col("at").alias("own_t")), "own_t").withColumn("points", F.col("v_own_t") * ELO)
    error, informative = ELO / F.sqrt(F.col("info") + TRAINER_PENALTY), F.floor(F.col("info") * 4 + 0.5)
    evidence = F.when(informative >= STRONG, "strong").when(informative >= SOME, "some").otherwise("thin")
    sure = lambda z: F.when(F.col("points") - z * error > 0, "above").when(F.col("points") + z * error < 0, "below")
    verdict = F.when(evidence == "thin", "unclear").otherwise(F.coalesce(sure(CLEAR), F.concat(F.lit("leaning "), sure(LEANING)), F.lit("unclear")))
    return out.select("trainer_id", "points", error.alias("error"), evidence.alias("evidence"), verdict.alias("verdict"), "fights", informative.cast("long").alias("informative"), "fighters")


def _summary(name: str) -> list[Column]:
    return [F.count("change").alias(name), F.avg("change").alias(f"{name}_mean"), F.coalesce(F.stddev_samp("change"), F.lit(0.0)).alias(f"{name}_sd")]


def switch_study(w: League) -> DataFrame:
    """MDL18: the change of rating over up to six bouts after a change of trainer, against the same over six bouts from the middle of a stint.

    A move counts with two bouts under the one before and three under the new one; a stint of eight bouts or more is one of the control group, from
    its middle bout.  ``difference`` of the means and its ``error``; one row, or none if either group has under ten.
    """
    own = Window.partitionBy("boxer_id").orderBy("start", "person_id")
    stints = w.stints.where("start IS NOT NULL").select("boxer_id", "person_id", "start", "end", F.lag("person_id").over(own).alias("prev"), F.lag("start").over(own).alias("prev_start"))
    stints = written(stints.withColumn("stint", F.monotonically_increasing_id()), "stints")
    # a rating on a day is the one after that day's last bout
    day = Window.partitionBy("boxer_id", "date").orderBy("bout_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bouts = w.counted.select("boxer_id", "bout_id", "date", F.last("post").over(day).alias("rating"))
    inside = (F.col("date") >= F.col("start")) & F.coalesce(F.col("date") < F.col("end"), F.lit(True))
    x = bouts.join(stints, "boxer_id")
    under = x.where(inside).withColumn("place", F.row_number().over(Window.partitionBy("stint").orderBy("date", "bout_id")) - 1)
    under = under.withColumn("held", F.count("*").over(Window.partitionBy("stint")))
    later = under.where(F.col("place") < AFTER).groupBy("stint").agg(F.count("*").alias("later"), F.max_by("rating", "place").alias("after"))
    before = x.where((F.col("date") < F.col("start")) & (F.col("date") >= F.col("prev_start"))).groupBy("stint").agg(F.count("*").alias("before"))
    moved = stints.where(F.col("prev") != F.col("person_id")).join(later.where(F.col("later") >= LEAST_AFTER), "stint").join(before.where(F.col("before") >= LEAST_BEFORE), "stint")
    moved = rating_at(w, moved.select("boxer_id", F.col("start").alias("date"), "after")).select((F.col("after") - F.col("rating")).alias("change"))
    pivot = F.least(F.col("held") - AFTER - 1, F.greatest(F.lit(LEAST_BEFORE - 1), F.floor(F.col("held") / 2)))
    stayed = under.where(F.col("held") >= LEAST_BEFORE + AFTER).groupBy("stint")
    stayed = stayed.agg((F.max(F.when(F.col("place") == pivot + AFTER, F.col("rating"))) - F.max(F.when(F.col("place") == pivot, F.col("rating")))).alias("change"))
    both = moved.agg(*_summary("switched")).crossJoin(stayed.agg(*_summary("stayed")))  # a row each
    both = both.where((F.col("switched") >= LEAST_STUDIED) & (F.col("stayed") >= LEAST_STUDIED))
    error = F.sqrt(F.pow("switched_sd", F.lit(2)) / F.col("switched") + F.pow("stayed_sd", F.lit(2)) / F.col("stayed"))
    return both.select("*", (F.col("switched_mean") - F.col("stayed_mean")).alias("difference"), error.alias("error"))
