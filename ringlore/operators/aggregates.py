"""League-wide aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import METHODS, count_if, counts, half_up, is_stoppage, share
from ..plans.league import League

#: Provenance from best to worst.
BASES = ("disclosed", "reported", "estimated")


def zero_filled(w: League, values: tuple, name: str, counted: DataFrame) -> DataFrame:
    """A row for each of ``values``, with zeros where ``counted`` has none."""
    dim = w.spark.createDataFrame([(v,) for v in values], f"{name} {'string' if isinstance(values[0], str) else 'int'}")
    return dim.join(counted, name, "left").fillna(0)


def overview(w: League) -> DataFrame:
    """AGG02."""
    b = w.decided.agg(F.count("*").alias("bouts"), share(count_if(is_stoppage(F.col("method"))), F.count("*")).alias("finish_rate"))
    f = w.careers.where("bouts > 0").agg(F.count("*").alias("fighters"), F.countDistinct("country").alias("countries"))
    e = w.events.where(~F.col("cancelled") & (F.col("date") <= F.lit(w.as_of))).agg(F.count("*").alias("past_events"))
    return f.crossJoin(b).crossJoin(e)  # three rows of one each


def by_division(w: League) -> DataFrame:
    """AGG03."""
    return w.decided.groupBy("division").agg(F.count("*").alias("bouts"), share(count_if(is_stoppage(F.col("method"))), F.count("*")).alias("ko_rate"))


def method_split(w: League) -> DataFrame:
    """AGG04: every method, also those without a bout."""
    return zero_filled(w, METHODS, "method", w.bouts.where("method IS NOT NULL").groupBy("method").agg(F.count("*").alias("bouts")))


def by_year(w: League) -> DataFrame:
    """AGG05."""
    return w.decided.groupBy(F.year("date").alias("year")).agg(F.count("*").alias("total"), count_if(is_stoppage(F.col("method"))).alias("kos"))


def finish_round_histogram(w: League) -> DataFrame:
    """AGG06: twelve bins, later rounds in the last."""
    x = w.decided.where(is_stoppage(F.col("method")) & F.col("end_round").isNotNull())
    return zero_filled(w, tuple(range(1, 13)), "round", x.groupBy(F.least("end_round", F.lit(12)).alias("round")).agg(F.count("*").alias("finishes")))


def finish_heatmap(w: League) -> DataFrame:
    """AGG07: share of a division's finishes that falls in each round."""
    x = w.decided.where(is_stoppage(F.col("method")) & F.col("end_round").isNotNull())
    per = x.groupBy("division", "end_round").agg(F.count("*").alias("finishes"))
    total = F.sum("finishes").over(Window.partitionBy("division"))
    return per.select("division", "end_round", "finishes", (F.col("finishes") / total).alias("share"))


def country_leaders(w: League) -> DataFrame:
    """AGG08."""
    c = w.careers.where("bouts > 0").groupBy("country")
    c = c.agg(F.count("*").alias("fighters"), F.sum("wins").cast("long").alias("wins"), F.sum("bouts").cast("long").alias("bouts"))
    return c.withColumn("win_rate", share(F.col("wins"), F.col("bouts")))


def stance_edge(w: League) -> DataFrame:
    """AGG09: share of decisive bouts between the two stances that southpaws won, and how many bouts tell."""
    s = w.fighters.select("boxer_id", "stance")
    x = w.decided.join(s.withColumnsRenamed({"boxer_id": "red_id", "stance": "rs"}), "red_id").join(s.withColumnsRenamed({"boxer_id": "blue_id", "stance": "bs"}), "blue_id")
    mixed = F.coalesce((F.col("rs") != F.col("bs")), F.lit(False)) & F.col("winner_id").isNotNull()
    south = F.when(F.col("winner_id") == F.col("red_id"), F.col("rs")).otherwise(F.col("bs")) == "Southpaw"
    known = count_if(F.col("rs").isNotNull() & F.col("bs").isNotNull())
    return x.agg(count_if(mixed).alias("bouts"), share(count_if(mixed & south), count_if(mixed)).alias("southpaw_share"), known.alias("known"), F.count("*").alias("all_bouts"))


def reach_edge(w: League, least: int = 5) -> DataFrame:
    """AGG10: decisive bouts in which the reaches differ by ``least`` cm or more, and the share that the longer won."""
    r = w.fighters.select("boxer_id", "reach_cm")
    x = w.decided.where("winner_id IS NOT NULL").join(r.withColumnsRenamed({"boxer_id": "red_id", "reach_cm": "rr"}), "red_id")
    x = x.join(r.withColumnsRenamed({"boxer_id": "blue_id", "reach_cm": "br"}), "blue_id").where(F.abs(F.col("rr") - F.col("br")) >= least)
    longer = F.when(F.col("rr") > F.col("br"), F.col("red_id")).otherwise(F.col("blue_id"))
    return x.agg(F.count("*").alias("bouts"), share(count_if(F.col("winner_id") == longer), F.count("*")).alias("longer_won"))


def landed_in(facts: Column) -> tuple[Column, Column]:
    """Of a fighter's list of one bout the punches landed, by the whole-fight line where there is one, else the sum of the rounds, and the number of rounds."""
    total = lambda keep: F.aggregate(facts, F.lit(0).cast("long"), lambda s, x: s + F.when(keep(x["round"]), x["landed"]).otherwise(0))
    landed = F.when(F.exists(facts, lambda x: x["round"] == 0), total(lambda r: r == 0)).otherwise(total(lambda r: r > 0))
    return landed, F.size(F.filter(facts, lambda x: x["round"] > 0)).cast("long")


def punch_totals(w: League) -> DataFrame:
    """AGG11: the whole-fight line where there is one, else the sum of the rounds.  A fighter's lines of a bout lie in one row, so nothing is shuffled."""
    landed, rounds = landed_in(F.col("facts"))
    return w.punch_lists.select("bout_id", "boxer_id", landed.alias("landed"), rounds.alias("rounds"))


def weigh_in_stats(w: League) -> DataFrame:
    """AGG12: by division; weight under the limit of those who made it, and weight gained by fight night."""
    under = F.when(F.col("made"), F.col("limit_lb") - F.col("official_lb"))
    return w.weigh_ins.groupBy("division").agg(
        F.count("*").alias("n"), share(count_if(F.col("made") == F.lit(False)), count_if(F.col("made").isNotNull())).alias("miss_rate"),
        F.avg(under).alias("avg_under"), F.avg(F.col("night_lb") - F.col("official_lb")).alias("avg_gain"), F.avg("night_lb").alias("avg_night"),
    )


def night_edge(w: League) -> DataFrame:
    """AGG13: win rate by how much heavier than the opponent on the night: 8, 4, 1.5 lb, either way."""
    x = w.weigh_ins.where("night_lb IS NOT NULL AND result IN ('W', 'L')").select("bout_id", "boxer_id", "opp_id", "night_lb", "result")
    o = x.select("bout_id", F.col("boxer_id").alias("opp_id"), F.col("night_lb").alias("opp_lb"))
    d = F.col("night_lb") - F.col("opp_lb")
    size = F.when(F.abs(d) >= 8, 3).when(F.abs(d) >= 4, 2).when(F.abs(d) >= 1.5, 1).otherwise(0)
    y = x.join(o, ["bout_id", "opp_id"]).withColumn("bucket", F.when(d < 0, -size).otherwise(size))
    return y.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(F.when(F.col("result") == "W", 1.0).otherwise(0.0)).alias("win_rate"))


def missed_weights(w: League, n: int = 25) -> DataFrame:
    """AGG14: the latest fighters over the limit, with the total and their win rate in decided bouts."""
    x = w.weigh_ins.where("made = false")
    total = x.agg(F.count("*").alias("total"), share(count_if(F.col("result") == "W"), count_if(F.col("result").isin("W", "L"))).alias("win_rate"))
    latest = x.select("bout_id", "boxer_id", "date", (F.col("official_lb") - F.col("limit_lb")).alias("over_lb")).orderBy(F.desc("date"), F.desc("bout_id"), "boxer_id").limit(n)
    return latest.crossJoin(F.broadcast(total))  # one row


def rehydration(w: League) -> DataFrame:
    """AGG15."""
    return w.weigh_ins.groupBy("boxer_id").agg(F.avg(F.col("night_lb") - F.col("official_lb")).alias("avg_gain"), count_if(F.col("made") == F.lit(False)).alias("misses"))


def judge_stats(w: League) -> DataFrame:
    """AGG16: how often each judge agrees with the majority of the cards, and mean margin."""
    side = F.signum(F.col("red") - F.col("blue")).cast("int")
    c = w.scorecards.withColumn("vote", side)
    per = c.groupBy("bout_id").agg(F.count("*").alias("cards"), *[count_if(F.col("vote") == v).alias(f"v{v + 1}") for v in (-1, 0, 1)])
    per = per.where("cards >= 3").withColumn("majority", F.when(F.col("v0") >= 2, -1).when(F.col("v1") >= 2, 0).when(F.col("v2") >= 2, 1))
    x = c.join(per.select("bout_id", "majority"), "bout_id")
    told = F.col("majority").isNotNull()
    return x.groupBy("judge_id").agg(
        F.count("*").alias("cards"), share(count_if(told & (F.col("vote") == F.col("majority"))), count_if(told)).alias("agreement"),
        count_if(told & (F.col("vote") != F.col("majority"))).alias("dissents"), F.avg(F.abs(F.col("red") - F.col("blue"))).alias("avg_margin"),
    )


def scoring_disputes(w: League, n: int = 20) -> DataFrame:
    """AGG18: bouts in which judges saw different winners, widest first."""
    d = (F.col("red") - F.col("blue")).cast("long")
    x = w.scorecards.groupBy("bout_id").agg(F.max(d).alias("high"), F.min(d).alias("low")).where("high > 0 AND low < 0")
    return x.select("bout_id", (F.col("high") - F.col("low")).alias("spread")).orderBy(F.desc("spread"), "bout_id").limit(n)


def best_purses(w: League) -> DataFrame:
    """AGG24: one amount per fighter and bout: the best basis, then the latest source; rows without an amount do not count."""
    rank = F.create_map(*[F.lit(x) for i, b in enumerate(BASES) for x in (b, -i)])
    known = F.filter("facts", lambda x: x["usd"].isNotNull())
    best = F.array_max(F.transform(known, lambda x: F.struct(F.element_at(rank, x["basis"]).alias("rank"), x["source"].alias("source"), x["usd"].alias("usd"), x["basis"].alias("basis")))).alias("best")
    # the sources of one purse lie in one row
    return w.purse_lists.select("bout_id", "boxer_id", "date", best).select("bout_id", "boxer_id", "date", "best.usd", "best.basis")


def career_money(w: League) -> DataFrame:
    """AGG26: total, biggest purse and the share of it that is disclosed."""
    x = best_purses(w).where("usd IS NOT NULL")
    return x.groupBy("boxer_id").agg(
        F.round(F.sum("usd"), 2).alias("total"), F.max("usd").alias("biggest"), F.round(share(F.sum(F.when(F.col("basis") == "disclosed", F.col("usd")).otherwise(0.0)), F.sum("usd")), 6).alias("disclosed_share")
    )


def top_purses(w: League, n: int = 20) -> DataFrame:
    """AGG27."""
    return best_purses(w).where("usd > 0").select("bout_id", "boxer_id", "usd").orderBy(F.desc("usd"), "bout_id", "boxer_id").limit(n)


def revenue_by_year(w: League) -> DataFrame:
    """AGG29."""
    return best_purses(w).groupBy(F.year("date").alias("year")).agg(F.round(F.sum("usd"), 2).alias("usd"), F.count("usd").alias("with_purse"), F.count("*").alias("of"))


def country_rollup(w: League) -> DataFrame:
    """AGG30: by country, and by region as a second level through duplicated rows."""
    n, r = w.raw("nation"), w.raw("region")
    parent = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    x = w.fighters.join(F.broadcast(parent), "country").select("active", F.explode(F.array("country", "region")).alias("place"))
    return x.groupBy("place").agg(F.count("*").alias("fighters"), count_if(F.col("active")).alias("active"))


def venue_rows(w: League) -> DataFrame:
    """AGG31."""
    coming = ~F.col("cancelled") & (F.col("date") > F.lit(w.as_of))
    return w.events.groupBy("venue", "country").agg(F.count("*").alias("events"), count_if(coming).alias("upcoming"), F.max("date").alias("last_date"))


def coverage(w: League) -> DataFrame:
    """AGG32: how many fighters and bouts have each fact, in one pass over each."""
    f = w.fighters.agg(*[F.count(c).alias(c) for c in ("birth_year", "height_cm", "reach_cm", "stance")], F.count("*").alias("of"))
    b = w.bouts.where("method IS NOT NULL").agg(*[F.count(c).alias(c) for c in ("end_round", "round_time", "winner_id")], F.count("*").alias("of"))
    rows = [(d, c) for d, cols in ((f, ("birth_year", "height_cm", "reach_cm", "stance")), (b, ("end_round", "round_time", "winner_id"))) for c in cols]
    out = [d.select(F.lit(c).alias("field"), F.col(c).alias("have"), "of") for d, c in rows]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def reach_index(w: League, least: int = 10) -> DataFrame:
    """AGG39: reach against the mean of the division, 100 being the mean; divisions with ``least`` known reaches."""
    pool = Window.partitionBy("division", "sex")
    x = w.fighters.where("reach_cm IS NOT NULL").select("boxer_id", "reach_cm", F.avg("reach_cm").over(pool).alias("mean"), F.count("*").over(pool).alias("peers"))
    return x.where(F.col("peers") >= least).select("boxer_id", half_up(100 * F.col("reach_cm") / F.col("mean")).alias("reach_index"))


def red_share_by_year(w: League) -> DataFrame:
    """AGG42: the red corner's share of decisive bouts by year; outside 40 to 75 % is suspicious."""
    x = w.decided.where("winner_id IS NOT NULL").groupBy(F.year("date").alias("year")).agg(F.count("*").alias("bouts"), F.avg(F.when(F.col("winner_id") == F.col("red_id"), 1.0).otherwise(0.0)).alias("red_share"))
    return x.withColumn("outlier", ~F.col("red_share").between(0.40, 0.75))


def small_groups(w: League, below: int = 30) -> DataFrame:
    """AGG43: countries and divisions with fewer fighters than ``below``."""
    return w.fighters.groupBy("country", "division").agg(F.count("*").alias("n")).where(F.col("n") < below)


def change_groups(w: League) -> DataFrame:
    """AGG44: median and greatest weight gain by division and result, with up to ten samples."""
    gain = F.col("night_lb") - F.col("official_lb")
    x = w.weigh_ins.where("night_lb IS NOT NULL").groupBy("division", "result")
    return x.agg(F.count("*").alias("n"), F.expr("percentile(night_lb - official_lb, 0.5)").alias("median_gain"), F.max(gain).alias("max_gain"))


def mean_stint_result(w: League) -> DataFrame:
    """AGG19, AGG20: record and rating change of a trainer's fighters inside each stint."""
    from .joins import bouts_in_stints

    x = bouts_in_stints(w)
    per = x.groupBy("person_id", "boxer_id", "start").agg(
        count_if(F.col("result") == "W").alias("wins"), count_if(F.col("result") == "L").alias("losses"), count_if(F.col("result") == "D").alias("draws"),
        F.max_by("post", F.struct("date", "bout_id")).alias("last"), F.min_by("pre", F.struct("date", "bout_id")).alias("first"),
    )
    return per.groupBy("person_id").agg(
        F.count("*").alias("tenures"), F.countDistinct("boxer_id").alias("fighters"), F.sum("wins").cast("long").alias("wins"), F.sum("losses").cast("long").alias("losses"),
        F.sum("draws").cast("long").alias("draws"), F.avg(F.col("last") - F.col("first")).alias("mean_change"),
    )


def host_record(w: League) -> DataFrame:
    """JOIN18: every customer with the number of cards held, zero included, and how many were cancelled."""
    held = w.events.groupBy("host_id").agg(F.count("*").alias("cards"), count_if(F.col("cancelled")).alias("cancelled"))
    return w.fighters.select("boxer_id").join(held, F.col("boxer_id") == F.col("host_id"), "left").select("boxer_id", F.coalesce("cards", F.lit(0)).alias("cards"), F.coalesce("cancelled", F.lit(0)).alias("cancelled"))


def career_strip(w: League) -> DataFrame:
    """AGG40: bouts of each year between a fighter's first and last, and whether a result's end is missing in it."""
    x = w.counted.groupBy("boxer_id", F.year("date").alias("year")).agg(F.count("*").alias("bouts"), (count_if(F.col("end_round").isNull()) > 0).alias("missing"))
    years = x.groupBy("boxer_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.join(x, ["boxer_id", "year"], "left").select("boxer_id", "year", F.coalesce("bouts", F.lit(0)).alias("bouts"), F.coalesce("missing", F.lit(False)).alias("missing"))


def opponents_last_five(w: League) -> DataFrame:
    """AGG38: combined record, going in, of a fighter's last five opponents."""
    from .careers import running_record

    back = Window.partitionBy("boxer_id").orderBy(F.desc("date"), F.desc("bout_id"))
    last = w.counted.select("bout_id", "boxer_id", "opp_id", "date").withColumn("n", F.row_number().over(back)).where("n <= 5")
    rec = running_record(w).select("bout_id", F.col("boxer_id").alias("opp_id"), "wins_before", "losses_before")
    return last.join(rec, ["bout_id", "opp_id"]).groupBy("boxer_id").agg(F.sum("wins_before").cast("long").alias("opp_wins"), F.sum("losses_before").cast("long").alias("opp_losses"), F.count("*").alias("opponents"))


def method_counts(w: League) -> DataFrame:
    """Counted results by method family."""
    return w.bouts.where(counts(F.col("method"))).groupBy("method").agg(F.count("*").alias("n"))
