"""Title lineages by windows: in every decisive title bout the champion afterwards is the winner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.league import League

#: 18 league months without a title bout
DORMANT_DAYS = 18 * 30.4
BELT = ["title_org", "title", "division", "sex"]


def lineage(w: League) -> DataFrame:
    """WIN08: one row per reign, with how it began and ended, defences and days to its end or the league's day."""
    own = Window.partitionBy(*BELT).orderBy("date", "bout_id")
    x = w.bouts.where("title IS NOT NULL AND winner_id IS NOT NULL")
    x = x.withColumn("loser_id", F.when(F.col("winner_id") == F.col("red_id"), F.col("blue_id")).otherwise(F.col("red_id")))
    x = x.withColumn("prev", F.lag("winner_id").over(own))
    x = x.withColumn("starts", F.col("prev").isNull() | F.col("title_vacant") | (F.col("winner_id") != F.col("prev")))
    how = F.when(F.col("prev").isNull(), F.when(F.col("title_vacant"), "vacant").otherwise("first")).when(F.col("title_vacant"), "vacant")
    x = x.withColumn("how", how.when(F.col("loser_id") == F.col("prev"), "won").otherwise("inherited"))
    x = x.withColumn("reign_no", F.sum(F.col("starts").cast("long")).over(own))
    r = x.groupBy(*BELT, "reign_no").agg(
        F.min_by("winner_id", F.struct("date", "bout_id")).alias("champion_id"), F.min("date").alias("start"), F.min_by("how", F.struct("date", "bout_id")).alias("how"),
        (F.count("*") - 1).alias("defences"), F.max("date").alias("last_date"), F.min_by("loser_id", F.struct("date", "bout_id")).alias("from_id"),
    )
    after = Window.partitionBy(*BELT).orderBy("reign_no")
    r = r.withColumn("end", F.lead("start").over(after)).withColumn("next_how", F.lead("how").over(after))
    r = r.withColumn("ended_by", F.when(F.col("next_how") == "vacant", "vacated").when(F.col("next_how") == "won", "lost").when(F.col("next_how") == "inherited", "passed"))
    r = r.withColumn("from_id", F.when(F.col("how") != "inherited", F.col("from_id")))
    r = r.withColumn("days", F.greatest(F.lit(0), F.datediff(F.coalesce("end", F.lit(w.as_of)), "start")).cast("long")).drop("next_how")
    # a reign that still runs on a dormant belt lasts, for records, to the belt's last title bout
    resting = w.fighters.where("NOT active").select(F.col("boxer_id").alias("champion_id"), F.lit(True).alias("resting"))
    r = r.join(resting, "champion_id", "left")
    dormant = F.col("end").isNull() & (F.coalesce("resting", F.lit(False)) | (F.datediff(F.lit(w.as_of), "last_date") > DORMANT_DAYS))
    return r.withColumn("counted_days", F.when(dormant, F.greatest(F.lit(0), F.datediff("last_date", "start"))).otherwise(F.col("days")).cast("long")).drop("resting")


def belts(w: League) -> DataFrame:
    """VW01, AGG41: one row per belt: holder, champions, longest reign, most defences, and whether it is dormant.

    Dormant: the holder is not active, or the last title bout is more than 18 league months ago.
    """
    last = F.struct("reign_no")
    b = w.reigns.groupBy(*BELT).agg(
        F.max_by("champion_id", last).alias("holder_id"), F.max("last_date").alias("last_date"), F.countDistinct("champion_id").alias("champions"),
        F.max("days").alias("longest_days"), F.max("defences").alias("most_defences"), F.sum("defences").alias("defences"), F.count("*").alias("reigns"),
    )
    b = b.join(w.fighters.select(F.col("boxer_id").alias("holder_id"), F.col("active").alias("holder_active")), "holder_id")
    old = F.datediff(F.lit(w.as_of), "last_date") > DORMANT_DAYS
    return b.withColumn("dormant", ~F.col("holder_active") | old).drop("holder_active")
