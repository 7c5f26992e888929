"""Text and event operators over the other given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.shuffles import as_of
from ..plans.league import League
from ..storage import written


def slug(c: Column, most: int = 100) -> Column:
    """FN02: lower case, runs of other characters as one hyphen, cut at a hyphen."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.regexp_replace(F.substring(s, 1, most), "-[^-]*$", ""))


def name_key(c: Column) -> Column:
    """FN03, FN04: words in order, without suffixes."""
    words = F.filter(F.split(F.lower(c), r"[\s\-.,']+"), lambda x: (x != "") & ~x.isin("jr", "sr", "ii", "iii"))
    return F.array_join(F.array_sort(words), " ")


def html_text(c: Column) -> Column:
    """SRC09: text of a page: scripts and styles dropped, tags as spaces, five entities, runs of space as one."""
    x = F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def slugs(w: League) -> DataFrame:
    return w.raw("part").select("p_partkey", slug(F.col("p_name")).alias("slug"), name_key(F.col("p_name")).alias("key"))


def pages_text(w: League) -> DataFrame:
    """SRC09 over the pages: characters and digest of each one's text."""
    x = w.raw("pages").select("page_id", html_text(F.col("html")).alias("text"))
    return x.select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def text_checks(w: League) -> DataFrame:
    """FN19: links, long numbers and repeated characters in each document."""
    t = F.col("text")
    return w.raw("documents").select("doc_id", t.rlike(r"https?://|www\.").alias("has_link"), t.rlike("[0-9]{9,}").alias("long_number"), t.rlike("(!!!|\\?\\?\\?|\\.\\.\\.\\.)").alias("repeats"), F.length("text").alias("chars"))


def letters_fingerprint(c: Column) -> Column:
    """FN14: digest of the letters alone, in lower case."""
    return F.substring(F.sha1(F.regexp_replace(F.lower(c), "[^a-z]", "")), 1, 16)


def copy_waves(w: League) -> DataFrame:
    """STR10: letters fingerprints that two or more sources share."""
    x = w.raw("documents").select("source", letters_fingerprint(F.col("text")).alias("fp")).groupBy("fp").agg(F.countDistinct("source").alias("sources"), F.count("*").alias("documents"))
    return x.where("sources > 1")


def posts(w: League) -> DataFrame:
    """Events as posts of documents' texts: ``post_id``, ``user_id``, ``fp`` (fingerprint of the letters), ``ts``."""
    n = w.raw("documents").count()
    texts = w.raw("documents").select(F.col("doc_id").alias("of"), letters_fingerprint(F.col("text")).alias("fp"))
    x = w.raw("events").select(F.col("event_id").alias("post_id"), "user_id", F.col("ts").cast("timestamp").alias("ts"), F.pmod(F.floor(F.col("event_id") / 3), F.lit(n)).alias("of"))
    return x.join(texts, "of").drop("of")


def copied_posts(posts: DataFrame, hours: int = 24) -> DataFrame:
    """STR10: posts of which another user posted the same letters within the ``hours`` before.

    Rows of a fingerprint are dealt by stretches of that length, each with the stretch before it, so a text that is always posted is no
    single task's; within them a window over the hours before has another user if its least or greatest one is another.
    """
    length = hours * 3_600_000_000
    stretch = F.floor(F.unix_micros("ts") / length)
    near = posts.withColumn("at", F.unix_micros("ts")).withColumn("own", stretch).withColumn("stretch", F.explode(F.array(stretch, stretch + 1)))
    before = Window.partitionBy("fp", "stretch").orderBy("at").rangeBetween(-length, 0)
    x = near.withColumn("low", F.min("user_id").over(before)).withColumn("high", F.max("user_id").over(before))
    return x.where("stretch = own AND (low <> user_id OR high <> user_id)").select("post_id", "user_id")


def fixed_windows(events: DataFrame, seconds: int = 86400, most: int = 2) -> DataFrame:
    """STR08: windows that begin at a user's first event after the last one ended: ``user_id``, ``start``, ``n`` and how many were ``refused``.

    The first event a window's length after each is found by an as-of join in reversed time.  Which events begin windows is found by
    doubling: from those known, the ones 1, 2, 4, ... windows on, in as many rounds as the logarithm of a user's windows.
    """
    hits = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("user_id IS NOT NULL AND at IS NOT NULL")
    firsts = written(hits.groupBy("user_id", "at").agg(F.count("*").alias("n")), "hits")  # hits at one instant are one
    later = firsts.select("user_id", (-F.col("at")).alias("back"), F.col("at").alias("next"))
    jump = as_of(firsts.select("user_id", "at", (-F.col("at") - seconds * 1_000_000).alias("back")), later, "user_id", "back", ["next"])
    jump = written(jump.where("next IS NOT NULL").select("user_id", "at", "next"), "jumps")
    starts = written(firsts.groupBy("user_id").agg(F.min("at").alias("at")), "window-starts")
    while not jump.isEmpty():
        more = starts.join(jump, ["user_id", "at"]).select("user_id", F.col("next").alias("at"))
        starts = written(starts.unionByName(more).distinct(), "window-starts")
        twice = jump.select("user_id", F.col("at").alias("from"), F.col("next").alias("at")).join(jump, ["user_id", "at"])
        jump = written(twice.select("user_id", F.col("from").alias("at"), "next"), "jumps")
    placed = as_of(firsts, starts.withColumn("start", F.col("at")), "user_id", "at", ["start"])
    x = placed.groupBy("user_id", "start").agg(F.sum("n").alias("n"))
    return x.select("user_id", F.timestamp_micros("start").alias("start"), "n", F.greatest(F.lit(0), F.col("n") - most).alias("refused"))


def duplicate_groups(w: League) -> DataFrame:
    """LNK09: texts that are equal once case and white space are folded."""
    folded = F.trim(F.regexp_replace(F.lower("text"), r"[ \t\n\r]+", " "))
    x = w.raw("documents").groupBy(F.md5(folded).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return x.where("n > 1")


def props(w: League) -> DataFrame:
    """FN15: the number inside each event's JSON, by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return w.raw("events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.countDistinct(k).alias("distinct_k"))


def windows(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """STR08: count and mean value in tumbling, or with ``slide`` sliding, windows of event time."""
    own = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(own, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """STR13: a user's events with less than ``gap`` between them as one session."""
    return events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def dedupe_daily(events: DataFrame) -> DataFrame:
    """STR07, WIN19: the first event of a user, type and day."""
    own = Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id")
    return events.withColumn("n", F.row_number().over(own)).where("n = 1").select("event_id", "user_id", "event_type")


def limited(events: DataFrame, most: int = 2, seconds: int = 86400) -> DataFrame:
    """STR09, STR11: events at which a user has more than ``most`` in the trailing seconds."""
    trailing = Window.partitionBy("user_id").orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(-seconds, 0)
    return events.withColumn("n", F.count("*").over(trailing)).where(F.col("n") > most).select("event_id", "user_id", "n")


def late(events: DataFrame, days: int = 14) -> DataFrame:
    """STR01: events that arrive (in order of a hash of the id) more than ``days`` after a later one of their user."""
    before = Window.partitionBy("user_id").orderBy(F.md5(F.col("event_id").cast("string")), "event_id").rowsBetween(Window.unboundedPreceding, -1)
    x = events.select("event_id", "user_id", "ts", F.max("ts").over(before).alias("seen"))
    return x.where(F.col("ts") < F.col("seen") - F.expr(f"INTERVAL {days} DAYS")).select("event_id", "user_id")
