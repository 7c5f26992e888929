"""Career totals, streaks and what is derived from a fighter's own bouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, half_up, is_stoppage, islands, share
from ..plans.league import League

ORDER = ["date", "bout_id"]


def career_stats(w: League) -> DataFrame:
    """AGG01: totals of each fighter's counted bouts; fighters without one have zeros and no last fight.

    One shuffle brings a fighter's bouts together in order; the trailing run of equal results is told as they pass by.
    """
    own = Window.partitionBy("boxer_id").orderBy(*ORDER)
    x = w.turns(F.coalesce("end_round", "rounds").alias("ended")).where("result IS NOT NULL")
    x = x.select("boxer_id", *ORDER, "result", "ended", "post", is_stoppage(F.col("method")).alias("stop"), F.row_number().over(own).alias("n"), F.lag("result").over(own).alias("one_before"), F.lead("bout_id").over(own).isNull().alias("newest"))
    x = x.withColumn("since", F.max(F.when(F.coalesce(F.col("result") != F.col("one_before"), F.lit(True)), F.col("n"))).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    newest = lambda c: F.max(F.when(F.col("newest"), c))
    sums = x.groupBy("boxer_id").agg(
        count_if(F.col("result") == "W").alias("wins"), count_if(F.col("result") == "L").alias("losses"), count_if(F.col("result") == "D").alias("draws"),
        count_if((F.col("result") == "W") & F.col("stop")).alias("kos"), count_if((F.col("result") == "L") & F.col("stop")).alias("ko_losses"), F.count("*").alias("bouts"),
        F.avg("ended").alias("avg_rounds"), F.max("date").alias("last_fight"), newest(F.col("post")).alias("rating"), F.min("date").alias("debut"),
        newest(F.col("result")).alias("streak_type"), newest((F.col("n") - F.col("since") + 1).cast("long")).alias("streak"),
    )
    out = w.fighters.join(sums, "boxer_id", "left")
    zero = {c: 0 for c in ("wins", "losses", "draws", "kos", "ko_losses", "bouts", "streak")} | {"avg_rounds": 0.0, "rating": 1500.0}
    out = out.fillna(zero)
    out = out.withColumn("ko_rate", share(F.col("kos"), F.col("wins"))).withColumn("win_rate", share(F.col("wins"), F.col("bouts")))
    out = out.withColumn("age", F.lit(w.as_of.year) - F.col("birth_year"))
    return out.withColumn("archetype", archetype()).withColumn("record", F.concat_ws("-", "wins", "losses", "draws"))


def archetype() -> Column:
    """PRJ03: the first rule that holds."""
    b, win, ko = F.col("bouts"), F.col("win_rate"), F.col("ko_rate")
    stopped = share(F.col("ko_losses"), F.col("losses"))
    # The rules' bounds and names, in order.
    rules = [
        (b < 8, "Prospect"), (win < 0.4, "Journeyman"), (ko >= 0.55, "Knockout Artist"), ((ko >= 0.4) & (stopped <= 0.35), "Iron-Chin Brawler"),
        ((ko <= 0.3) & (win >= 0.6), "Technician"), ((F.col("avg_rounds") >= 7) & (ko < 0.4), "Volume Boxer"),
    ]
    out = F.when(*[F.lit(x) if isinstance(x, str) else x for x in rules[0]])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("Counter-Puncher")


def current_streak(w: League) -> DataFrame:
    """The trailing run of equal results: ``streak_type`` W, L or D and its length."""
    back = Window.partitionBy("boxer_id").orderBy(*[F.desc(c) for c in ORDER])
    x = w.counted.select("boxer_id", *ORDER, "result").withColumn("newest", F.first("result").over(back))
    broken = F.max(F.when(F.col("result") != F.col("newest"), 1).otherwise(0)).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("broken", broken).where("broken = 0").groupBy("boxer_id").agg(F.first("newest").alias("streak_type"), F.count("*").alias("streak"))


def longest_run(w: League, of: str = "W", draws_break: bool = True) -> DataFrame:
    """WIN06: longest run of a result.  With ``draws_break`` off, a draw leaves the run as it is."""
    x = w.counted.select("boxer_id", *ORDER, "result")
    x = x if draws_break else x.where((F.col("result") == of) | (F.col("result") != "D"))
    x = x.withColumn("run", islands(["boxer_id"], ORDER, F.col("result") != of)).where(F.col("result") == of)
    return x.groupBy("boxer_id", "run").count().groupBy("boxer_id").agg(F.max("count").alias("longest"))


def running_record(w: League) -> DataFrame:
    """WIN04, WIN05: record, days since the last fight and finishes of a fighter before each counted bout."""
    before = Window.partitionBy("boxer_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    stop = is_stoppage(F.col("method"))
    upto = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(before), F.lit(0)).cast("long")
    return w.counted.select(
        "bout_id", "boxer_id", "date", "opp_id", "pre", "opp_pre", "result", "method", "division", "sex",
        upto(F.col("result") == "W").alias("wins_before"), upto(F.col("result") == "L").alias("losses_before"), upto(F.lit(True)).alias("bouts_before"),
        upto((F.col("result") == "W") & stop).alias("kos_before"), upto((F.col("result") == "L") & stop).alias("ko_losses_before"),
        F.datediff("date", F.lag("date").over(Window.partitionBy("boxer_id").orderBy(*ORDER))).alias("days_idle"),
    )


def form(w: League, last: int = 5) -> DataFrame:
    """WIN12: letters of the last results, newest first."""
    back = Window.partitionBy("boxer_id").orderBy(*[F.desc(c) for c in ORDER])
    x = w.counted.select("boxer_id", *ORDER, "result").withColumn("n", F.row_number().over(back)).where(F.col("n") <= last)
    listed = F.array_sort(F.collect_list(F.struct("n", "result")))
    return x.groupBy("boxer_id").agg(F.concat_ws("", F.transform(listed, lambda s: s["result"])).alias("form"))


def unbeaten_in_last(w: League, n: int) -> DataFrame:
    """FLT07: fighters with at least ``n`` counted bouts who lost none of the last ``n``."""
    back = Window.partitionBy("boxer_id").orderBy(*[F.desc(c) for c in ORDER])
    x = w.counted.select("boxer_id", *ORDER, "result").withColumn("n", F.row_number().over(back)).where(F.col("n") <= n)
    return x.groupBy("boxer_id").agg(F.count("*").alias("held"), count_if(F.col("result") == "L").alias("lost")).where((F.col("held") == n) & (F.col("lost") == 0)).select("boxer_id")


def longest_gap(w: League) -> DataFrame:
    """WIN14: most days between two counted bouts."""
    before = Window.partitionBy("boxer_id").orderBy(*ORDER)
    x = w.counted.select("boxer_id", F.datediff("date", F.lag("date").over(before)).alias("days"))
    return x.groupBy("boxer_id").agg(F.max("days").alias("longest_gap")).where("longest_gap IS NOT NULL")


def by_the_numbers(w: League) -> DataFrame:
    """AGG33: rounds boxed (unknown if any end is), distance, quick finishes, countries, layoff of 180 days or more."""
    gaps = longest_gap(w).where("longest_gap >= 180")
    unknown = count_if(F.col("end_round").isNull())
    x = w.counted.groupBy("boxer_id").agg(
        F.when(unknown == 0, F.sum("end_round")).cast("long").alias("rounds_boxed"), count_if((F.col("end_round") == F.col("rounds")) & ~is_stoppage(F.col("method"))).alias("distance"),
        count_if((F.col("result") == "W") & is_stoppage(F.col("method")) & (F.col("end_round") <= 3)).alias("quick_finishes"), F.countDistinct("country").alias("countries"),
    )
    return x.join(gaps, "boxer_id", "left")


def outcomes_by_year(w: League) -> DataFrame:
    """AGG34: outcomes of each year from a fighter's first to last, years without a bout included."""
    x = w.counted.withColumn("year", F.year("date"))
    stop, dec = is_stoppage(F.col("method")), F.col("method").isin("UD", "MD", "SD", "TD")
    won = F.col("result") == "W"
    per = x.groupBy("boxer_id", "year").agg(
        count_if(won & stop).alias("ko"), count_if(won & dec).alias("decision"), count_if(won & ~stop & ~dec).alias("other_win"),
        count_if(F.col("result") == "D").alias("draw"), count_if(F.col("result") == "L").alias("loss"), F.count("*").alias("total"),
    )
    years = x.groupBy("boxer_id").agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return years.join(per, ["boxer_id", "year"], "left").fillna(0)


def finish_rounds(w: League) -> DataFrame:
    """AGG35: of fighters with three or more known finishes: mean round to one decimal, most frequent round (the earliest of equals)."""
    x = w.counted.where((F.col("result") == "W") & is_stoppage(F.col("method")) & F.col("end_round").isNotNull())
    per = x.groupBy("boxer_id", "end_round").count()
    mode = per.groupBy("boxer_id").agg(F.max_by("end_round", F.struct("count", -F.col("end_round"))).alias("mode_round"))
    mean = x.groupBy("boxer_id").agg((half_up(F.avg("end_round") * 10) / 10).alias("mean_round"), F.count("*").alias("finishes")).where("finishes >= 3")
    return mean.join(mode, "boxer_id")


def opposition(w: League) -> DataFrame:
    """AGG37: mean and best opponent's rating going in, of fighters with five bouts or more."""
    x = w.counted.groupBy("boxer_id").agg(F.avg("opp_pre").alias("mean_opponent"), F.max("opp_pre").alias("best_opponent"), F.count("*").alias("bouts"))
    return x.where("bouts >= 5")


def late_rounds(w: League) -> DataFrame:
    """AGG36: record in fights that reached round eight, of fighters with three of them."""
    x = w.counted.where("end_round >= 8").groupBy("boxer_id")
    return x.agg(F.count("*").alias("late_bouts"), count_if(F.col("result") == "W").alias("late_wins")).where("late_bouts >= 3")
