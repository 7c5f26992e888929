"""Rankings, top lists and record lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, half_up, is_stoppage, months_before, seconds_in
from ..plans.league import League
from .careers import ORDER
from .joins import rating_on
from .titles import BELT


def eligible(w: League, bouts: int = 5, months: float = 24) -> DataFrame:
    """FLT21: active, enough bouts, at least half of them won, and a fight since ``months`` ago."""
    c = w.careers
    return c.where(F.col("active") & (F.col("bouts") >= bouts) & (F.col("win_rate") >= 0.5) & (F.col("last_fight") >= F.lit(months_before(w.as_of, months))))


def division_ranking(w: League) -> DataFrame:
    """WIN01: by division and sex; rank by rating, then id."""
    own = Window.partitionBy("division", "sex").orderBy(F.desc("rating"), "boxer_id")
    return eligible(w).select("division", "sex", "boxer_id", "rating", F.row_number().over(own).alias("rank"))


def rank_movement(w: League, months: float = 3) -> DataFrame:
    """WIN02: places gained within today's pool since ``months`` ago, by the ratings of then."""
    then = rating_on(w, months_before(w.as_of, months)).withColumnRenamed("rating", "old")
    x = division_ranking(w).join(then, "boxer_id")
    old_rank = F.row_number().over(Window.partitionBy("division", "sex").orderBy(F.desc("old"), "boxer_id"))
    return x.select("division", "sex", "boxer_id", "rank", (old_rank - F.col("rank")).alias("moved"), (F.col("rating") - F.col("old")).alias("rating_change"))


def pound_for_pound(w: League, n: int = 20) -> DataFrame:
    """WIN03."""
    return eligible(w, bouts=8).select("boxer_id", "sex", "division", "rating").orderBy(F.desc("rating"), "boxer_id").limit(n)


def accumulators(w: League, quality: float = 1540) -> DataFrame:
    """WIN09: peak rating and its first date, wins over strong opponents, title wins, defences, reign days, divisions held."""
    own = Window.partitionBy("boxer_id").orderBy(*ORDER)
    before, upto = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    beaten, won = F.coalesce(F.col("winner_id") == F.col("opp_id"), F.lit(False)), F.col("result") == "W"
    x = w.turns(F.col("title").isNotNull().alias("titled"), beaten.alias("beaten")).where("result IS NOT NULL")
    peak = F.col("post") > F.coalesce(F.max("post").over(before), F.lit(float("-inf")))
    x = x.select("boxer_id", "opp_id", *ORDER, "result", "titled", "beaten", "pre", "post", peak.alias("peaks"), F.sum(won.cast("int")).over(upto).alias("won"))
    # wins since the last loss; a draw leaves the run as it is
    lost_at = F.coalesce(F.max(F.when(F.col("result") == "L", F.col("won"))).over(upto), F.lit(0))
    facts = F.struct(F.col("boxer_id"), F.col("post"), F.when(F.col("peaks"), F.col("date")).alias("peak_on"), (won & F.col("titled")).cast("int").alias("title_win"), F.when(won, F.col("won") - F.col("run_from")).alias("run"), F.lit(0).alias("strong"))
    # who lost tells the opponent how strong they were, so that no bout has to bring both together
    told = F.struct(F.col("opp_id").alias("boxer_id"), F.lit(None).cast("double").alias("post"), F.lit(None).cast("date").alias("peak_on"), F.lit(0).alias("title_win"), F.lit(None).cast("bigint").alias("run"), F.lit(1).alias("strong"))
    x = x.withColumn("run_from", lost_at)
    x = x.select(F.explode(F.when(F.col("beaten") & (F.col("pre") >= quality), F.array(facts, told)).otherwise(F.array(facts))).alias("f")).select("f.*")
    x = x.groupBy("boxer_id").agg(
        F.max("post").alias("peak"), F.max("peak_on").alias("peak_date"), F.sum("strong").cast("long").alias("quality_wins"), F.sum("title_win").cast("long").alias("title_wins"),
        F.coalesce(F.max("run"), F.lit(0)).cast("long").alias("win_streak"),
    )
    r = w.reigns.groupBy(F.col("champion_id").alias("boxer_id")).agg(F.sum("defences").cast("long").alias("defences"), F.sum("counted_days").cast("long").alias("reign_days"), F.countDistinct("division").alias("divisions"))
    out = x.join(r, "boxer_id", "left").fillna(0, ["defences", "reign_days", "divisions"])
    return out.select("boxer_id", "peak", "peak_date", "quality_wins", "title_wins", "defences", "reign_days", "divisions", "win_streak")


def top(df: DataFrame, n: int, value: str, *ties) -> DataFrame:  # noqa: ANN002
    """ORD04: the first ``n`` rows by value, ties in order, with their rank."""
    rows = df.orderBy(F.desc(value), *ties).limit(n)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(value), *ties)))  # of n rows


def record_list(w: League, which: str, n: int = 25, sex: str | None = None, division: str | None = None) -> DataFrame:
    """REC01 to REC12: a ranked list of fighters or reigns, within a sex or division if named."""
    scope = lambda df: df.where((F.lit(sex is None) | (F.col("sex") == (sex or ""))) & (F.lit(division is None) | (F.col("division") == (division or ""))))
    c = scope(w.careers).select("boxer_id", "name", "wins", "kos", "bouts", "rating")
    if which in ("longest-reign", "reign-defences"):
        value = "days" if which == "longest-reign" else "defences"
        r = scope(w.reigns.withColumnRenamed("champion_id", "boxer_id").withColumn("days", F.col("counted_days"))).join(w.fighters.select("boxer_id", "name"), "boxer_id")
        return top(r.where(F.col(value) > 0).select("boxer_id", "name", *BELT, "reign_no", F.col(value).alias("value"), "days"), n, "value", F.desc("days"), "name", "title_org", "title", "division", "sex", "reign_no").drop("days")
    if which in ("wins", "kos"):
        return top(c.where(F.col(which) > 0).select("boxer_id", "name", F.col(which).alias("value")), n, "value", "name")
    if which == "ko-rate":
        return top(c.where("wins >= 15").select("boxer_id", "name", (F.col("kos") / F.col("wins")).alias("value"), "wins"), n, "value", F.desc("wins"), "name").drop("wins")
    a = c.join(accumulators(w), "boxer_id")
    if which == "greatest":
        # Weights of a career's parts.
        parts = [(0.30, clamp((F.col("peak") - 1500) / 300)), (0.25, clamp(F.col("quality_wins") / 8)), (0.15, clamp(F.col("reign_days") / (365 * 8))), (0.10, clamp(F.col("defences") / 15)), (0.10, clamp(F.col("win_streak") / 30))]
        total = sum(p * v for p, v in parts) / sum(p for p, _ in parts)
        return top(a.where("bouts >= 10").select("boxer_id", "name", "rating", half_up(F.round(100 * total, 9)).alias("value")), n, "value", F.desc("rating"), "name").drop("rating")
    column = {"peak": "peak", "win-streak": "win_streak", "quality-wins": "quality_wins", "title-wins": "title_wins", "defences": "defences", "divisions": "divisions"}[which]
    least = {"divisions": 1, "peak": -1}.get(which, 0)
    return top(a.where(F.col(column) > least).select("boxer_id", "name", half_up(F.col(column)).alias("value")), n, "value", "name")


FIGHTER_LISTS = ("greatest", "peak", "wins", "kos", "ko-rate", "win-streak", "quality-wins", "title-wins", "defences", "divisions", "longest-reign", "reign-defences")


def records_of(w: League, n: int = 10) -> DataFrame:
    """REC17: the places of fighters in the lists of fighters and reigns, the first ``n`` of each; a fighter's best place in a list."""
    lists = [record_list(w, which, n).select("boxer_id", F.lit(which).alias("list"), "rank") for which in FIGHTER_LISTS]
    return reduce(DataFrame.unionByName, lists).groupBy("boxer_id", "list").agg(F.min("rank").alias("rank"))


def fastest_finishes(w: League, n: int = 25) -> DataFrame:
    """REC15: stoppages whose clock is known, shortest first, then earliest."""
    x = w.bouts.where(is_stoppage(F.col("method")) & F.col("round_time").rlike(r"^\d+:\d{2}$") & F.col("end_round").isNotNull())
    x = x.select("bout_id", "date", seconds_in(F.col("end_round"), F.col("round_time")).cast("long").alias("seconds"))
    return x.orderBy("seconds", "date", "bout_id").limit(n)


def most_knockdowns(w: League, n: int = 25) -> DataFrame:
    """REC16."""
    x = w.bouts.where("method IS NOT NULL").select("bout_id", "date", (F.col("kd_red") + F.col("kd_blue")).cast("long").alias("knockdowns")).where("knockdowns >= 2")
    return x.orderBy(F.desc("knockdowns"), F.desc("date"), "bout_id").limit(n)


def biggest_upsets(w: League, n: int = 200) -> DataFrame:
    """VW08, REC14: wins over the higher rated, widest gap first; neither at the starting rating."""
    x = w.counted.where("result = 'W' AND pre <> 1500 AND opp_pre <> 1500 AND opp_pre > pre")
    return x.select("bout_id", "boxer_id", "opp_id", (F.col("opp_pre") - F.col("pre")).alias("gap")).orderBy(F.desc("gap"), "bout_id").limit(n)


def on_this_day(w: League, month: int = 6, day: int = 30, n: int = 20, per_year: int = 3) -> DataFrame:
    """WIN16: bouts of a day of the year, three a year first and the rest after them; titles, then later rounds."""
    x = w.decided.where((F.month("date") == month) & (F.dayofmonth("date") == day))
    score = F.when(F.col("title").isNotNull(), 100).otherwise(0) + F.col("rounds")
    x = x.select("bout_id", F.year("date").alias("year"), score.cast("long").alias("importance"))
    x = x.withColumn("n", F.row_number().over(Window.partitionBy("year").orderBy(F.desc("importance"), "bout_id")))
    return x.select("bout_id", "year", "importance", (F.col("n") > per_year).alias("over_cap")).orderBy("over_cap", F.desc("importance"), "bout_id").limit(n)


def split_by_time(w: League, share_: float = 0.75) -> DataFrame:
    """WIN21: by year and half, from counts: the first three quarters of each division's bouts by position are for training."""
    own = Window.partitionBy("division", "sex")
    x = w.decided.select("bout_id", "division", "sex", "date").withColumn("n", F.row_number().over(own.orderBy(*ORDER))).withColumn("of", F.count("*").over(own))
    return x.groupBy("division", "sex").agg(F.sum(F.when(F.col("n") <= F.floor(F.col("of") * share_), 1).otherwise(0)).cast("long").alias("train"), F.count("*").alias("total"))
