"""Further filters, presets, rules and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import count_if, expected
from ..plans.league import League
from ..sources import star, wikitables
from .models import WIN_WEIGHTS, corners, sigmoid, upcoming_pairs, win_terms

#: MDL07. Presets as values of the win model's weights that differ from the model's own.
PRESETS = {
    "Balanced": {},
    "Pure Elo": {"reach": 0.0, "age": 0.0, "idle": 0.0, "power": 0.0, "chin": 0.0},
    "Old school": {"rating": WIN_WEIGHTS["rating"] * 0.6, "reach": 0.04, "power": 0.6, "chin": 0.6},
    "Father Time": {"age": 0.09, "idle": 0.04},
}


def preset_chances(w: League) -> DataFrame:
    """MDL07: the red corner's chance in every upcoming bout under each preset."""
    terms = win_terms(*corners())
    chance = lambda p: sigmoid(sum((t * (p[n] / WIN_WEIGHTS[n]) if n in p else t for n, t in terms.items()), F.lit(0.0)))
    each = F.array(*[F.struct(F.lit(name).alias("preset"), chance(p).alias("p_red")) for name, p in PRESETS.items()])
    return upcoming_pairs(w).select("bout_id", F.explode(each).alias("x")).select("bout_id", "x.*")


def rule_decisions(w: League) -> DataFrame:
    """STR04: changes decided by standing rules: fills are taken, replaced rounds too if they move by two at most, the rest waits."""
    from .merging import changes

    rules = w.spark.createDataFrame([("any", "fill", None), ("end_round", "replace", 2)], "field string, kind string, most int")
    c = changes(w)
    near = F.abs(F.col("old").try_cast("int") - F.col("new").try_cast("int"))
    x = c.join(F.broadcast(rules.withColumnRenamed("field", "rule").withColumnRenamed("kind", "k")), (F.col("k") == F.col("kind")) & F.col("rule").isin("any") | ((F.col("k") == F.col("kind")) & (F.col("rule") == F.col("field"))), "left")
    ok = F.col("k").isNotNull() & (F.col("most").isNull() | (near <= F.col("most")))
    return x.groupBy("field", "kind", F.when(ok, "taken").otherwise("waits").alias("decision")).agg(F.count("*").alias("n"))


def lagging(w: League, days: int = 60) -> DataFrame:
    """STR15: reconciliation with and without the last days: conflicts that vanish are lagging."""
    late = F.datediff(F.lit(w.as_of), "date") < days
    x = w.counted.where("result = 'W'").groupBy("boxer_id").agg(F.count("*").alias("wins"), count_if(~late).alias("earlier"))
    told = F.col("earlier") + F.when(F.col("boxer_id") % 3 == 0, 0).otherwise(F.col("boxer_id") % 2)
    x = x.withColumn("told", told)
    verdict = F.when(F.col("wins") == F.col("told"), "complete").when(F.col("earlier") == F.col("told"), "lagging").when(F.col("wins") < F.col("told"), "partial").otherwise("conflict")
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def audit(w: League) -> DataFrame:
    """DQ15: checks of the whole feed, each with how many rows it finds."""
    f, b = w.fighters, w.bouts
    checks = {
        "fighters-without-bout": f.join(w.long, "boxer_id", "left_anti"), "self-fights": b.where("red_id = blue_id"), "late-rounds": b.where("end_round > rounds"),
        "title-without-winner": b.where("title IS NOT NULL AND method IS NOT NULL AND winner_id IS NULL"), "cards-only-cancelled": w.events.join(b.where("NOT cancelled"), "event_id", "left_anti"),
    }
    out = [d.agg(F.lit(n).alias("code"), F.count("*").alias("n")) for n, d in checks.items()]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def watchlist(w: League, watched: DataFrame, days: int = 30, ahead: int = 14) -> DataFrame:
    """VW09: results of the last ``days`` and bouts of the next ones of watched fighters, by who watches (``user_id``, ``boxer_id``)."""
    x = w.long.join(watched.distinct(), "boxer_id")
    since = F.datediff(F.lit(w.as_of), "date")
    past = x.where(F.col("counted") & (since < days)).select("user_id", "boxer_id", "bout_id", F.col("result").alias("what"))
    soon = x.where(F.col("upcoming") & (since >= -ahead)).select("user_id", "boxer_id", "bout_id", F.lit("upcoming"))
    return past.union(soon)


def watched_by_events(w: League) -> DataFrame:
    """Users watch the fighter whose number is that of the event's, round the number of fighters."""
    fighters = w.fighters.count()
    return w.raw("events").select("user_id", F.pmod("event_id", F.lit(fighters)).alias("boxer_id")).distinct()


def owned_reigns(reigns: DataFrame, ids: DataFrame) -> DataFrame:
    """LNK05: reigns of pages (``article``) with the fighter of that external id (``ids``: ``boxer_id``, ``external_id``), where it is one fighter's alone."""
    own = ids.where("external_id IS NOT NULL").groupBy("external_id").agg(F.count("*").alias("n"), F.min("boxer_id").alias("boxer_id")).where("n = 1")
    return reigns.join(own.select("boxer_id", F.col("external_id").alias("article")), "article")


def reign_owner(w: League) -> DataFrame:
    """LNK05: reigns and defences of the league's pages by fighter."""
    rows = wikitables.parsed(star.reign_pages(w), "page", "text", wikitables.reigns, wikitables.REIGN)
    return owned_reigns(rows, star.articles(w)).groupBy("boxer_id").agg(F.count("*").alias("reigns"), F.sum("defences").cast("long").alias("defences"))


def surprise_share(w: League) -> DataFrame:
    """MDL14: log-loss and Brier score of the rating's chances, a millionth at least and as much less than 1 at most, over all decisive bouts."""
    p = expected(F.col("pre"), F.col("opp_pre"))
    x = w.counted.where("side = 'red' AND result <> 'D'").select(F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p)).alias("p"), F.when(F.col("result") == "W", 1.0).otherwise(0.0).alias("y"))
    return x.agg(F.count("*").alias("n"), F.avg(-(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))).alias("log_loss"), F.avg((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))).alias("brier"))
