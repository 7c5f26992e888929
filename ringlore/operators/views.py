"""Page-level views, orders and sets over the league, and the rest of its aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, counts, expected, half_up, share
from ..functions.shuffles import as_of
from ..plans.league import League
from ..storage import written
from .careers import ORDER, running_record
from .joins import bouts_in_stints, head_trainer, ratings_around
from .models import predictions
from .rankings import division_ranking, eligible


def with_names(w: League) -> DataFrame:
    """PRJ01, JOIN01: every bout that is not cancelled with the card's country, both names and both countries."""
    f = w.fighters.select("boxer_id", "name", "country")
    side = lambda s: f.select(F.col("boxer_id").alias(f"{s}_id"), F.col("name").alias(f"{s}_name"), F.col("country").alias(f"{s}_country"))
    b = w.bouts.where("NOT cancelled").select("bout_id", "country", "red_id", "blue_id")
    return b.join(side("red"), "red_id").join(side("blue"), "blue_id").select("bout_id", "country", "red_name", "blue_name", "red_country", "blue_country")


def enriched_events(w: League) -> DataFrame:
    """JOIN02: cards with their region where it is known: only regions 0 to 2 are."""
    n, r = w.raw("nation"), w.raw("region").where("r_regionkey <= 2")
    known = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return w.events.join(F.broadcast(known), "country", "left").groupBy("region").agg(F.count("*").alias("events"), count_if(F.col("cancelled")).alias("cancelled"))


def referee_stats(w: League) -> DataFrame:
    """AGG17: bouts, stoppages with a known round, their share, mean round and share by round three, by referee."""
    x = w.decided.withColumn("referee_id", (F.col("part") + F.col("supp")) % 17)
    stop = F.col("method").isin("KO", "TKO") & F.col("end_round").isNotNull()
    return x.groupBy("referee_id").agg(
        F.count("*").alias("bouts"), count_if(stop).alias("stoppages"), share(count_if(stop), F.count("*")).alias("rate"),
        F.avg(F.when(stop, F.col("end_round"))).alias("avg_round"), share(count_if(stop & (F.col("end_round") <= 3)), count_if(stop)).alias("early"),
    )


def stint_records(w: League) -> DataFrame:
    """AGG19: record and rating change within each stint."""
    return bouts_in_stints(w).groupBy("boxer_id", "person_id", "start").agg(
        count_if(F.col("result") == "W").alias("wins"), count_if(F.col("result") == "L").alias("losses"), count_if(F.col("result") == "D").alias("draws"),
        (F.max_by("post", F.struct(*ORDER)) - F.min_by("pre", F.struct(*ORDER))).alias("change"),
    )


def gyms(w: League) -> DataFrame:
    """AGG21, AGG22: gyms (the trainer's nation) by fighters whose stint is open."""
    s = w.raw("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_nationkey").cast("long").alias("gym_id"))
    x = w.stints.join(s, "person_id")
    return x.groupBy("gym_id").agg(F.countDistinct("boxer_id").alias("fighters"), F.countDistinct(F.when(F.col("end").isNull(), F.col("boxer_id"))).alias("current"))


def trainer_leaderboard(w: League, n: int = 20) -> DataFrame:
    """AGG23: trainers with four bouts or more by the mean change of their stints."""
    x = bouts_in_stints(w)
    bouts = x.groupBy("person_id").agg(F.count("*").alias("bouts")).where("bouts >= 4")
    mean = stint_records(w).groupBy("person_id").agg(F.round(F.avg("change"), 9).alias("mean_change"))
    return bouts.join(mean, "person_id").orderBy(F.desc("mean_change"), "person_id").limit(n)


def card_money(w: League, n: int = 20) -> DataFrame:
    """AGG25, AGG27: gross of past cards: gate, pay per view buys at a price, site fee; unknown parts count as nothing."""
    b = w.bouts.where("NOT cancelled AND date <= DATE '2000-06-30'").groupBy("event_id").agg(F.sum("l_extendedprice").alias("gate"), F.max("part").alias("buys"), F.min("supp").alias("fee"))
    ppv = F.when(F.col("event_id") % 3 == 0, F.floor(F.col("buys") * 59.99 + 0.5))
    gross = F.round(F.col("gate") + F.coalesce(ppv, F.lit(0)) + F.when(F.col("event_id") % 2 == 0, F.col("fee") * 1000).otherwise(0), 2)
    return b.select("event_id", gross.alias("gross")).where("gross > 0").orderBy(F.desc("gross"), "event_id").limit(n)


def broadcasters(w: League) -> DataFrame:
    """AGG28: by broadcaster (the promoter's class), cards, mean and peak of viewers; a card counts once."""
    x = w.bouts.where("NOT cancelled").groupBy("promoter", "event_id").agg(F.max("part").alias("viewers"))
    return x.groupBy("promoter").agg(F.count("*").alias("events"), half_up(F.avg("viewers")).alias("mean_viewers"), F.max("viewers").alias("peak"))


def features(w: League) -> DataFrame:
    """WIN05, MDL05: state of both fighters going into each decisive bout; months idle 12 if unknown, 36 at most."""
    r = running_record(w)
    idle = F.least(F.coalesce(F.col("days_idle") / 30.4, F.lit(12.0)), F.lit(36.0)).alias("idle")
    ko = F.when(F.col("wins_before") > 0, F.col("kos_before") / F.col("wins_before")).otherwise(0.0).alias("ko_rate")
    return r.select("bout_id", "boxer_id", "pre", idle, ko, F.when(F.col("bouts_before") > 0, F.col("ko_losses_before") / F.col("bouts_before")).otherwise(0.0).alias("ko_loss_rate"))


def action_percentile(w: League) -> DataFrame:
    """WIN15: share of fights with strictly fewer punches, by counting each number once; a bout's punches lie in its row."""
    from .aggregates import landed_in

    total = F.aggregate(w.punches_of_bout(), F.lit(0).cast("long"), lambda s, x: s + landed_in(x["facts"])[0])
    x = written(w.decided.select("bout_id", total.alias("landed")), "landed")
    v = x.groupBy("landed").count()
    below = F.coalesce(F.sum("count").over(Window.orderBy("landed").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.select("landed", below.alias("below"), F.sum("count").over(Window.partitionBy()).alias("all"))
    return x.join(F.broadcast(v), "landed").select("bout_id", (F.col("below") / F.col("all")).alias("percentile"))  # a histogram


def leaderboard(w: League, least: int = 10) -> DataFrame:
    """MDL30, MDL31, WIN18: users' picks of past bouts graded; 1 + (1 - p) points for a right one; shared places.

    A pick is an event row that is no view: the card of its number, round the number of cards, and there the headline of
    the decided bouts; the corner by the event's parity.
    """
    cards = w.events.count()
    ev = w.raw("events").where("event_type <> 'view'").select("event_id", "user_id", F.pmod("event_id", F.lit(cards)).alias("card"))
    b = w.decided.where("winner_id IS NOT NULL").groupBy(F.col("event_id").alias("card")).agg(F.max_by(F.struct("bout_id", "red_id", "winner_id"), F.struct("position", "bout_id")).alias("b")).select("card", "b.*")
    p = w.counted.where("side = 'red'").select("bout_id", expected(F.col("pre"), F.col("opp_pre")).alias("p_red"))
    x = ev.join(b, "card").join(p, "bout_id")
    red = F.col("event_id") % 2 == 0
    right = red == (F.col("winner_id") == F.col("red_id"))
    chance = F.when(red, F.col("p_red")).otherwise(1 - F.col("p_red"))
    t = x.groupBy("user_id").agg(F.count("*").alias("graded"), count_if(right).alias("right"), F.round(F.sum(F.when(right, 2 - chance).otherwise(0.0)), 9).alias("points")).where(F.col("graded") >= least)
    t = t.withColumn("accuracy", F.round(F.col("right") / F.col("graded"), 9))
    top = t.orderBy(F.desc("points"), F.desc("accuracy"), "user_id").limit(50)
    return top.withColumn("place", F.rank().over(Window.orderBy(F.desc("points"), F.desc("accuracy"))))  # of 50 rows


def rank_before_and_after(w: League, day: dt.date = dt.date(2000, 3, 1)) -> DataFrame:
    """WIN22: today's eligible pool by the ratings before a day and after it."""
    x = eligible(w).select("boxer_id", "division", "sex").join(ratings_around(w, day), "boxer_id")
    own = Window.partitionBy("division", "sex")
    return x.select("boxer_id", F.row_number().over(own.orderBy(F.desc("before"), "boxer_id")).alias("rank_before"), F.row_number().over(own.orderBy(F.desc("after"), "boxer_id")).alias("rank_after"))


def by_ko_rate(w: League, n: int = 50) -> DataFrame:
    """ORD02: KO rate where it can be compared (five wins), others last; ties by rating and id."""
    rate = F.when(F.col("wins") >= 5, F.round("ko_rate", 9))
    return w.careers.select("boxer_id", rate.alias("rate"), "rating").orderBy(F.col("rate").desc_nulls_last(), F.desc("rating"), "boxer_id").limit(n)


def newest_bouts(w: League, n: int = 30) -> DataFrame:
    """ORD07: the newest counted bouts."""
    return w.decided.select("bout_id", "date").orderBy(F.desc("date"), F.desc("bout_id")).limit(n)


def all_spellings(w: League) -> DataFrame:
    """SET01: country names of fighters, cards and nations, one below the other, counted."""
    x = w.fighters.select("country").unionAll(w.events.select("country")).unionAll(w.raw("nation").select("n_name"))
    return x.groupBy("country").agg(F.count("*").alias("n"))


def needs_review(w: League) -> DataFrame:
    """SET02: documents that are short or hold a link, once each."""
    d = w.raw("documents")
    return d.where(F.length("text") < 200).select("doc_id").union(d.where(F.col("text").rlike("https?://")).select("doc_id")).distinct()


def shared_countries(w: League) -> DataFrame:
    """SET04, SET05: countries of southpaw champions that also have orthodox ones."""
    c = w.reigns.select(F.col("champion_id").alias("boxer_id")).distinct().join(w.fighters, "boxer_id")
    return c.where("stance = 'Southpaw'").select("country").intersect(c.where("stance = 'Orthodox'").select("country"))


def next_cards(w: League, n: int = 10) -> DataFrame:
    """VW04, VW10, VW11: next cards with the number of bouts and the headline, the last position."""
    x = w.bouts.where("upcoming").groupBy("event_id", "date").agg(F.count("*").alias("bouts"), F.max_by("bout_id", F.struct("position", "bout_id")).alias("headline_id"))
    return x.orderBy("date", "event_id").limit(n)


def highlights(w: League) -> DataFrame:
    """VW07: best win and greatest upset of 24 points or more of each fighter."""
    x = w.counted.where("result = 'W'")
    best = x.groupBy("boxer_id").agg(F.max_by("bout_id", F.struct("opp_pre", F.negative("bout_id"))).alias("best_win"), F.max("opp_pre").alias("best_rating"))
    gap = x.withColumn("gap", F.col("opp_pre") - F.col("pre")).where("gap >= 24").groupBy("boxer_id").agg(F.max("gap").alias("upset"))
    return best.join(gap, "boxer_id", "left")


def ranking_depth(w: League) -> DataFrame:
    """VW14: ranked fighters of each pool and the share of them with fewer bouts than 60."""
    x = division_ranking(w).join(w.careers.select("boxer_id", "bouts"), "boxer_id")
    return x.groupBy("division", "sex").agg(F.count("*").alias("ranked"), F.avg(F.when(F.col("bouts") < 60, 1.0).otherwise(0.0)).alias("partial_share"))


def year_end_ranks(w: League) -> DataFrame:
    """MDL10: calls by year: how many and how often right."""
    from .models import calls

    return calls(w).groupBy(F.year("date").alias("year")).agg(F.count("*").alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg("surprise").alias("surprise"))


def endings(w: League) -> DataFrame:
    """MDL28: chances of each upcoming bout split into stoppage and points for either corner."""
    p = predictions(w)
    return p.select("bout_id", *[(F.col(f"p_{s}") * e).alias(f"{s}_{n}") for s in ("red", "blue") for n, e in (("stop", F.col("p_stop")), ("points", 1 - F.col("p_stop")))])


def trainer_ids(w: League) -> DataFrame:
    """JOIN10: bouts by head trainer, stints with a known start only, counted by trainer."""
    return head_trainer(w, start_required=True).groupBy("trainer_id").agg(F.count("*").alias("bouts"))


def ledger_grades(w: League) -> DataFrame:
    """MDL29, JOIN12: of the daily snapshots of each past bout the last one strictly before its day, graded; draws are void."""
    b = w.bouts.where("method IS NOT NULL").select("bout_id", "date", "method", "winner_id", "red_id")
    snap = b.select("bout_id", "date", F.explode(F.array(*[F.date_sub("date", d) for d in (0, 1, 3)])).alias("locked_on")).withColumn("red_pick", (F.col("bout_id") + F.datediff("date", "locked_on")) % 2 == 0)
    last = as_of(b, snap.select("bout_id", F.col("locked_on").alias("date"), "red_pick"), "bout_id", "date", ["red_pick"], strict=True).where("red_pick IS NOT NULL")
    state = F.when(F.col("winner_id").isNull() | ~counts(F.col("method")), "void").when(F.col("red_pick") == (F.col("winner_id") == F.col("red_id")), "right").otherwise("wrong")
    return last.groupBy(state.alias("state")).agg(F.count("*").alias("n"))
