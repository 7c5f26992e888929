"""What a fight, a night or a pairing amounts to: recaps, previews, official lists, matchmaking, scouting lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, count_if, half_up, is_stoppage, seconds_in
from ..plans.league import League
from .careers import ORDER
from .models import calls, confidence, corners, decisive_chance, predictions, rated_calls, upcoming_pairs, win_terms, winner_chance
from .rankings import division_ranking
from .titles import BELT, belts

# How well two styles go together (names in order of the alphabet), and weights of a pairing's parts.
CLASHES = {
    ("Iron-Chin Brawler", "Knockout Artist"): 1.0, ("Knockout Artist", "Knockout Artist"): 0.9, ("Iron-Chin Brawler", "Iron-Chin Brawler"): 0.85, ("Counter-Puncher", "Knockout Artist"): 0.85,
    ("Counter-Puncher", "Volume Boxer"): 0.78, ("Counter-Puncher", "Iron-Chin Brawler"): 0.8, ("Technician", "Volume Boxer"): 0.7, ("Counter-Puncher", "Technician"): 0.55, ("Technician", "Technician"): 0.45,
    ("Volume Boxer", "Volume Boxer"): 0.6, ("Knockout Artist", "Technician"): 0.75, ("Knockout Artist", "Volume Boxer"): 0.8, ("Iron-Chin Brawler", "Technician"): 0.7, ("Iron-Chin Brawler", "Volume Boxer"): 0.75,
}
PAIRING_WEIGHTS = {"competitive": 0.28, "relevance": 0.18, "style": 0.14, "availability": 0.14, "novelty": 0.12, "stakes": 0.14}
#: The bodies whose lists are shown, in order.
BODIES = ("WBA", "WBC", "IBF", "WBO")


def surprise_tier(chance: Column) -> Column:
    """PRJ04: a word for a winner's chance going in."""
    return F.when(chance < 0.25, "major-upset").when(chance < 0.4, "upset").when(chance >= 0.75, "heavy-favourite").when(chance >= 0.6, "expected").otherwise("close")


def title_changes(w: League) -> DataFrame:
    """Of each decisive title bout whether it crowned or was a defence, and how many defences the reign then had."""
    own = Window.partitionBy(*BELT).orderBy(*ORDER)
    x = w.bouts.where("title IS NOT NULL AND winner_id IS NOT NULL").select("bout_id", "date", *BELT, "title_vacant", "winner_id")
    x = x.withColumn("before", F.lag("winner_id").over(own))
    crowned = F.col("before").isNull() | F.col("title_vacant") | (F.col("winner_id") != F.col("before"))
    x = x.withColumn("crowned", crowned).withColumn("reign", F.sum(F.when(crowned, 1).otherwise(0)).over(own))
    place = F.row_number().over(Window.partitionBy(*BELT, "reign").orderBy(*ORDER)) - 1
    return x.select("bout_id", F.when(F.col("crowned"), "crowned").otherwise("defended").alias("title_change"), place.alias("defence"))


def recaps(w: League) -> DataFrame:
    """VW02: one row per decided bout with a winner: how surprising, ratings, records, runs, and what ended for the loser."""
    upto = Window.partitionBy("boxer_id").orderBy(*ORDER)
    here, before = upto.rowsBetween(Window.unboundedPreceding, 0), upto.rowsBetween(Window.unboundedPreceding, -1)
    won, lost = F.col("result") == "W", F.col("result") == "L"
    total = lambda test, over: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(over), F.lit(0))
    # a winner's run ends at anything but a win, a loser's at anything but a loss
    x = w.counted.select("bout_id", *ORDER[:1], "boxer_id", "result", "method", "pre", "post", "opp_pre", total(won, here).alias("wins"), total(lost, here).alias("losses"), total(F.col("result") == "D", here).alias("draws"),
                         total(~won, here).alias("no_wins"), total(~lost, here).alias("no_losses"), total(F.lit(True), before).alias("fights_before"), total(lost, before).alias("losses_before"),
                         total(lost & is_stoppage(F.col("method")), before).alias("stopped_before"))
    run = F.row_number().over(Window.partitionBy("boxer_id", F.col("result"), F.when(won, F.col("no_wins")).otherwise(F.col("no_losses"))).orderBy(*ORDER))
    x = x.withColumn("run", run)
    record = F.concat_ws("-", "wins", "losses", "draws")
    a = x.where(won).select("bout_id", "date", F.col("boxer_id").alias("winner_id"), F.col("pre").alias("winner_before"), F.col("post").alias("winner_after"), record.alias("winner_record"), F.col("run").alias("win_run"))
    unbeaten = F.when((F.col("fights_before") >= 5) & (F.col("losses_before") == 0), F.col("fights_before"))
    first_stop = F.when(is_stoppage(F.col("method")) & (F.col("stopped_before") == 0) & (F.col("fights_before") >= 3) & unbeaten.isNull(), F.col("fights_before"))
    b = x.where(lost).select("bout_id", F.col("boxer_id").alias("loser_id"), F.col("pre").alias("loser_before"), F.col("post").alias("loser_after"), record.alias("loser_record"), F.col("run").alias("loss_run"), unbeaten.alias("unbeaten_ended"), first_stop.alias("first_stoppage"))
    known = rated_calls(w).select("bout_id", winner_chance().alias("chance"))
    out = a.join(b, "bout_id").join(known, "bout_id", "left").join(title_changes(w), "bout_id", "left")
    return out.withColumn("surprise", F.when(F.col("chance").isNotNull(), surprise_tier(F.col("chance"))))


def nights(w: League) -> DataFrame:
    """VW03: one row per past card with a decided winner: early ends, belts, calls, the biggest upset, the fastest finish, the longest run."""
    b = w.bouts.where("NOT cancelled").select("bout_id", "event_id", "method", "end_round", seconds_in(F.col("end_round"), F.col("round_time")).alias("seconds"))
    right = calls(w).select("bout_id", "right")
    x = recaps(w).join(b, "bout_id").join(right, "bout_id", "left")
    stop = is_stoppage(F.col("method"))
    upset = F.when(F.col("chance") < 0.4, F.struct(F.col("chance"), "bout_id"))
    fastest = F.when(stop & F.col("end_round").isNotNull(), F.struct("seconds", "bout_id"))
    run = F.when(F.col("win_run") >= 3, F.struct((-F.col("win_run")).alias("order"), "bout_id", "winner_id", "win_run"))
    out = x.groupBy("event_id").agg(
        F.count("*").alias("decided"), count_if(stop).alias("early"), count_if(F.col("title_change") == "crowned").alias("crowned"), count_if(F.col("title_change") == "defended").alias("defended"),
        F.count("right").alias("called"), count_if(F.coalesce("right", F.lit(False))).alias("called_right"), F.min(upset).alias("u"), F.min(fastest).alias("f"), F.min(run).alias("r"), F.count("unbeaten_ended").alias("unbeaten_ended"),
    )
    return out.select("event_id", "decided", "early", "crowned", "defended", "called", "called_right", F.col("u.bout_id").alias("upset_id"), F.col("f.bout_id").alias("fastest_id"), F.col("r.winner_id").alias("run_id"), F.col("r.win_run").alias("run"), "unbeaten_ended")


def replace_snapshot(held: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """SNK05: rows held, with all of each delivered ``key`` replaced by what is delivered for it."""
    return held.join(delivered.select(key).distinct(), key, "left_anti").unionByName(delivered)


def official_rows(w: League, shift: int, bodies: tuple[str, ...]) -> DataFrame:
    """A snapshot of bodies' lists: champions of each class from the belts, then contenders from the ranking, each body's a few places on."""
    b = belts(w).where("title = 'World Title'").select("division", "sex", F.col("holder_id").alias("boxer_id"), F.element_at(F.array(*[F.lit(x) for x in BODIES]), F.col("title_org").cast("int") + 1).alias("body"))
    champions = b.select("body", "division", "sex", F.lit("champion").alias("kind"), F.lit(None).cast("int").alias("rank"), "boxer_id")
    number = F.posexplode(F.array(*[F.lit(x) for x in BODIES])).alias("n", "body")
    r = division_ranking(w).select("division", "sex", "boxer_id", F.col("rank").alias("place"), number)
    contenders = r.withColumn("rank", F.col("place") - F.col("n") - shift).where("rank BETWEEN 1 AND 15").select("body", "division", "sex", F.lit("contender").alias("kind"), "rank", "boxer_id")
    return champions.unionByName(contenders).where(F.col("body").isin(*bodies))


def official(w: League) -> DataFrame:
    """SNK05: last month's lists of all bodies, with those of two bodies replaced by this month's."""
    return replace_snapshot(official_rows(w, 1, BODIES), official_rows(w, 0, BODIES[1:3]), "body")


def _body_order(c: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in BODIES]), c)


def official_by_division(rows: DataFrame) -> DataFrame:
    """VW13: each class's lists in the bodies' order, champions apart from contenders in order of rank; unknown bodies are left out."""
    x = rows.where(F.col("body").isin(*BODIES)).groupBy("division", "sex", "body").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "champion", F.col("boxer_id")))), lambda c: c.cast("string")), ",").alias("champions"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "champion", F.struct("rank", "boxer_id")))), lambda c: c["boxer_id"].cast("string")), ",").alias("contenders"),
    )
    return x.withColumn("place", _body_order(F.col("body")))


def official_by_fighter(rows: DataFrame) -> DataFrame:
    """VW13: a fighter's places: by body, a belt before a rank."""
    said = F.concat_ws(" ", "body", "sex", "division", F.when(F.col("kind") == "champion", "champion").otherwise(F.col("rank").cast("string")))
    order = F.struct(_body_order(F.col("body")).alias("b"), F.coalesce("rank", F.lit(0)).alias("r"), said.alias("said"))
    x = rows.where(F.col("body").isin(*BODIES) & F.col("boxer_id").isNotNull()).groupBy("boxer_id").agg(F.array_sort(F.collect_list(order)).alias("p"))
    return x.select("boxer_id", F.array_join(F.transform("p", lambda p: p["said"]), "; ").alias("places"))


def style_sample(w: League, per_style: int = 400) -> DataFrame:
    """WIN17: of fighters with eight bouts or more the highest rated of each style."""
    own = Window.partitionBy("archetype").orderBy(F.desc("rating"), "boxer_id")
    return w.careers.where("bouts >= 8").select("archetype", "boxer_id", "rating", F.row_number().over(own).alias("n")).where(F.col("n") <= per_style).drop("n")


def pairings(w: League, top: int = 8, n: int = 40) -> DataFrame:
    """MDL24, MDL25: fights to make: pairs among the first ``top`` of each pool by six weighted parts; a pool brings ``top`` rows, so 28 pairs at most."""
    idle = F.datediff(F.lit(w.as_of), "last_fight") / 30.4
    fresh = F.when(idle < 1.5, 0.15).when(idle < 2, 0.45).when(idle <= 9, 1.0).when(idle <= 18, 0.7).when(idle <= 30, 0.4).otherwise(0.15)
    fresh = F.when(~F.col("active"), 0.0).when(F.col("last_fight").isNull(), 0.5).otherwise(fresh)
    loss_rate = F.when(F.col("bouts") > 0, F.col("ko_losses") / F.col("bouts")).otherwise(0.0)
    c = w.careers.select("boxer_id", F.col("reach_cm").cast("double").alias("reach"), F.col("age").cast("double").alias("age"), F.coalesce(idle, F.lit(24.0)).alias("idle"), "ko_rate", loss_rate.alias("ko_loss_rate"), "archetype", fresh.alias("fresh"))
    r = division_ranking(w).where(F.col("rank") <= top).join(c, "boxer_id")
    side = lambda s: r.select("division", "sex", F.col("boxer_id").alias(f"{s}_id"), *[F.col(x).alias(f"{s}_{x}") for x in r.columns if x not in ("division", "sex", "boxer_id")])
    x = side("red").join(side("blue"), ["division", "sex"]).where("red_rank < blue_rank")
    met = w.decided.groupBy(F.least("red_id", "blue_id").alias("lo"), F.greatest("red_id", "blue_id").alias("hi")).agg(F.count("*").alias("met"), F.min_by("method", F.struct(*ORDER)).alias("first_method"))
    x = x.withColumn("lo", F.least("red_id", "blue_id")).withColumn("hi", F.greatest("red_id", "blue_id")).join(met, ["lo", "hi"], "left")
    live = belts(w).where("NOT dormant").groupBy(F.col("holder_id").alias("id")).agg(F.collect_set(F.struct("division", "title", "title_org")).alias("belts"))
    for s in ("red", "blue"):
        x = x.join(live.select(F.col("id").alias(f"{s}_id"), F.col("belts").alias(f"{s}_belts")), f"{s}_id", "left")
    p = decisive_chance(sum(win_terms(*corners()).values(), F.lit(0.0)))
    mean = (F.col("red_rating") + F.col("blue_rating")) / 2
    pair = F.concat_ws("|", F.least("red_archetype", "blue_archetype"), F.greatest("red_archetype", "blue_archetype"))
    known = F.element_at(F.create_map(*[F.lit(v) for (a, b), value in CLASHES.items() for v in (f"{a}|{b}", value)]), pair)
    clash = F.coalesce(known, F.when(pair.contains("Journeyman"), 0.2).when(pair.contains("Prospect"), 0.35).otherwise(0.5))
    close_first = F.col("first_method").isin("SD", "MD", "DRAW", "TD", "TDRAW")
    unify = F.exists("red_belts", lambda a: F.exists("blue_belts", lambda b: (a["division"] == b["division"]) & (a["title"] == b["title"]) & (a["title_org"] != b["title_org"])))
    challenger = F.when(F.col("red_belts").isNotNull(), F.col("blue_rank")).otherwise(F.col("red_rank"))
    held = F.col("red_belts").isNotNull() | F.col("blue_belts").isNotNull()
    parts = {
        "competitive": clamp(1 - F.abs(2 * p - 1) * 0.97),
        "relevance": clamp(1 - F.abs(F.col("red_rating") - F.col("blue_rating")) / 320 + F.when((F.col("red_rank") <= 10) & (F.col("blue_rank") <= 10), 0.2).otherwise(0.0)),
        "style": clamp(0.4 * clash + 0.35 * (F.col("red_ko_rate") + F.col("blue_ko_rate")) / 2 + 0.25 * clamp((mean - 1450) / 300)),
        "availability": F.least("red_fresh", "blue_fresh"),
        "novelty": F.when(F.col("met").isNull(), 1.0).when(F.col("met") > 1, 0.15).when(close_first, 0.7).otherwise(0.35),
        "stakes": F.when(F.coalesce(unify, F.lit(False)), 1.0).when(held & (challenger <= 5), 0.75).when(held, 0.3).otherwise(0.0),
    }
    total = reduce(lambda a, b: a + b, [PAIRING_WEIGHTS[k] * v for k, v in parts.items()])
    return x.select(F.col("red_id").alias("a_id"), F.col("blue_id").alias("b_id"), half_up(F.round(100 * total, 9)).alias("score")).orderBy(F.desc("score"), "a_id", "b_id").limit(n)


def previews(w: League) -> DataFrame:
    """VW06: upcoming bouts with who has the edge in each line of the tape, both corners' form, and where the belt stands."""
    edge = lambda a, b, more=True: F.when(a.isNull() | b.isNull() | (a == b), None).when((a > b) == F.lit(more), "red").otherwise("blue")
    c = w.careers.select("boxer_id", "win_rate", "ko_rate", "rating", "age", "height_cm", "reach_cm", "streak_type", "streak")
    r = division_ranking(w).select("boxer_id", "rank")
    own = c.join(r, "boxer_id", "left")
    side = lambda s: own.select(*[F.col(n).alias(f"{s}_{n}" if n != "boxer_id" else f"{s}_id") for n in own.columns])
    x = w.bouts.where("upcoming").select("bout_id", "red_id", "blue_id", *BELT, "title_vacant").join(side("red"), "red_id").join(side("blue"), "blue_id")
    line = lambda n, more=True: edge(F.col(f"red_{n}"), F.col(f"blue_{n}"), more).alias(n)
    form = lambda s: F.when((F.col(f"{s}_streak") >= 2) & F.col(f"{s}_streak_type").isin("W", "L"), F.concat(f"{s}_streak_type", F.col(f"{s}_streak").cast("string"))).alias(f"{s}_form")
    now = belts(w).select(*BELT, "holder_id")
    x = x.join(now, BELT, "left")
    stake = F.when(F.col("title").isNull(), None).when(F.col("title_vacant") | F.col("holder_id").isNull(), "vacant").when((F.col("holder_id") == F.col("red_id")) | (F.col("holder_id") == F.col("blue_id")), "defence").otherwise("on the line")
    return x.select("bout_id", line("win_rate"), line("ko_rate"), line("rating"), line("rank", False), line("age", False), line("height_cm"), line("reach_cm"), form("red"), form("blue"), stake.alias("belt"))


def matchup_lines(w: League) -> DataFrame:
    """VW12: one line on each upcoming bout: how sure, who, and how it should end."""
    z = sum(win_terms(*corners()).values(), F.lit(0.0))
    gap = F.abs(2 * decisive_chance(z) - 1) * 0.97
    names = w.fighters.select(F.col("boxer_id").alias("pick_id"), "name")
    sure = upcoming_pairs(w).select("bout_id", confidence(gap).alias("confidence"))
    x = predictions(w).join(sure, "bout_id").withColumn("pick_id", F.when(F.col("p_red") >= F.col("p_blue"), F.col("red_id")).otherwise(F.col("blue_id"))).join(names, "pick_id")
    ending = F.when(F.col("p_stop") > 0.5, "Expect a stoppage.").otherwise("Likely goes the distance.")
    percent = half_up(F.round(100 * F.greatest("p_red", "p_blue"), 9)).cast("string")
    return x.select("bout_id", F.concat(F.col("confidence"), F.lit(": "), F.col("name"), F.lit(" "), percent, F.lit("%. "), ending).alias("line"))


def scouting_lines(w: League) -> DataFrame:
    """VW12: who a fighter is, in one sentence; what the data does not have is left out."""
    rank = F.count("*").over(Window.partitionBy("division", "sex").orderBy(F.desc("rating")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tied = F.count("*").over(Window.partitionBy("division", "sex", "rating"))
    ranked = w.careers.where("active").select("boxer_id", (rank - tied + 1).alias("rank"))
    x = w.careers.where("active").join(ranked, "boxer_id")
    who = F.concat_ws(" ", F.when(F.col("age").isNotNull(), F.concat(F.col("age").cast("string"), F.lit("-year-old"))), F.lower("stance"), F.lower("division"))
    share = half_up(F.round(100 * F.col("ko_rate"), 9)).cast("string")
    text = F.concat(F.col("name"), F.lit(" is a "), who, F.lit(" from "), F.col("country"), F.lit(", "), F.col("record"), F.lit(" with "), F.col("kos").cast("string"), F.lit(" knockouts ("), share, F.lit("% of wins). Rated "),
                    half_up(F.col("rating")).cast("string"), F.lit(", #"), F.col("rank").cast("string"), F.lit(" of the class."))
    return x.select("boxer_id", text.alias("line"))


def day_index(w: League) -> DataFrame:
    """VW05: of every day of the year with a decided bout how many there are, over how many years, and the next such day."""
    x = w.bouts.where(F.col("method").isNotNull() & ~F.col("cancelled") & (F.col("date") <= F.lit(w.as_of))).groupBy(F.date_format("date", "MM-dd").alias("day")).agg(F.count("*").alias("fights"), F.countDistinct(F.year("date")).alias("years"))
    first = x.agg(F.min("day").alias("first"))
    following = F.lead("day").over(Window.orderBy("day"))  # 366 rows at most
    return x.withColumn("next_day", following).crossJoin(first).select("day", "fights", "years", F.coalesce("next_day", "first").alias("next_day"))
