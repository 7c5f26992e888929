"""Records that mean the same thing, found and joined; values made canonical."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if
from ..functions.names import folded, name_key
from ..plans.league import League
from ..sources import star
from ..storage import written
from .canon import fnv1a
from .documents import name_key as sorted_words_key
from .validation import validated_money

def day_functions(w: League) -> DataFrame:
    """FN12: day of the year as text, the day a week on, months since, and whether a text is a real day."""
    day = F.concat(F.year("date").cast("string"), F.lit("-02-"), F.lpad((28 + F.col("event_id") % 3).cast("string"), 2, "0"))
    return w.events.select("event_id", F.date_format("date", "MM-dd").alias("md"), F.date_add("date", 7).alias("next_week"), (F.datediff(F.lit(w.as_of), "date") / 30.4).alias("months"), F.try_to_date(day, "yyyy-MM-dd").isNotNull().alias("real_day"))


def hashes(w: League) -> DataFrame:
    """FN14: digests of names as fingerprints, and their FNV-1a."""
    return w.fighters.select("boxer_id", fnv1a(F.col("name")).alias("fnv"), F.substring(F.sha1("name"), 1, 12).alias("sha1"), F.substring(F.sha2("name", 256), 1, 16).alias("sha256"), F.md5("name").alias("md5"))


def money_text(c: Column) -> Column:
    """FN16: dollars in millions or thousands to one decimal, or whole below that."""
    part = lambda unit: F.floor(c / unit * 10 + 0.5) / 10
    text = lambda v, s: F.concat(F.lit("$"), F.format_string("%.1f", v), F.lit(s))
    return F.when(c >= 1e6, text(part(1e6), "M")).when(c >= 1e3, text(part(1e3), "k")).otherwise(F.concat(F.lit("$"), F.floor(c + 0.5).cast("string")))


def order_prices(w: League) -> DataFrame:
    return w.raw("orders").select("o_orderkey", money_text(F.col("o_totalprice")).alias("price"))


def array_functions(w: League) -> DataFrame:
    """FN20, FN05: words of part types: sorted, distinct, the first two, and whether all have four letters or more."""
    words = F.filter(F.split("p_type", r"[\s\-]+"), lambda x: x != "")
    return w.raw("part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(words)), "|").alias("sorted"), F.array_join(F.slice(words, 1, 2), "|").alias("first_two"), F.forall(words, lambda x: F.length(x) >= 4).alias("all_long"))


def folded_texts(w: League) -> DataFrame:
    """FN01: documents as spellings meet."""
    return w.raw("documents").select("doc_id", F.md5(folded(F.col("text"))).alias("folded"))


def duplicate_profiles(profiles: DataFrame, least: int = 3) -> DataFrame:
    """LNK01: one person under several profiles: the same folded name, birth year and career total of ``least`` bouts or more.

    ``profiles``: ``boxer_id``, ``name``, ``birth_year``, ``wins``, ``losses``, ``draws`` (the total as the supplier counts it) and ``bouts``
    (how many are held).  The busiest profile is kept, of equals the one of smaller id.  A name without letters, an unknown year or an
    unknown total meets nobody.  Returns ``key``, ``birth_year``, ``n``, ``keep_id`` and ``ids`` (all of the group, ascending).
    """
    total = ["wins", "losses", "draws"]
    known = profiles.dropna(subset=["birth_year", *total]).where(F.col("wins") + F.col("losses") + F.col("draws") >= least)
    x = known.withColumn("key", name_key(F.col("name"))).where("key IS NOT NULL").groupBy("key", "birth_year", *total)
    x = x.agg(F.count("*").alias("n"), F.max_by("boxer_id", F.struct("bouts", F.negative("boxer_id"))).alias("keep_id"), F.array_sort(F.collect_list("boxer_id")).alias("ids"))
    return x.where("n > 1").select("key", "birth_year", "n", "keep_id", "ids")


def merged_profiles(profiles: DataFrame, bouts: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """LNK01: profiles without those that are another's copy, and bouts (``red_id``, ``blue_id``, ``winner_id``) that name the kept ones."""
    groups = duplicate_profiles(profiles, least).select("keep_id", F.explode("ids").alias("gone"))
    into = written(groups.where("gone <> keep_id"), "merged-profiles")
    for c in ("red_id", "blue_id", "winner_id"):
        to = into.select(F.col("gone").alias(c), F.col("keep_id").alias("_keep"))
        bouts = bouts.join(to, c, "left").withColumn(c, F.coalesce("_keep", c)).select(*bouts.columns)
    return profiles.join(into.select(F.col("gone").alias("boxer_id")), "boxer_id", "left_anti").select(*profiles.columns), bouts


# Nations that count as one with the United Kingdom.
HOME_NATIONS = ("england", "scotland", "wales", "northern ireland", "great britain")


def nation_key(nation: Column) -> Column:
    key = name_key(nation.cast("string"))
    return F.when(key.isin(*HOME_NATIONS), "united kingdom").otherwise(key)


def career_fits(born: Column, died: Column, first: Column, last: Column) -> Column:
    """Whether a life fits a career, as far as its years are known: no bout before 14, none over 50 years after birth, none after death."""
    parts = [first < born + 14, last > born + 50, last > died]
    return ~reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts])


def three_pass_linkage(ours: DataFrame, staged: DataFrame) -> DataFrame:
    """LNK04: ``ours`` linked to ``staged`` people (both: ``id``, ``external_id``, ``name``, ``year``, ``nation``).

    ``ours`` also have ``first_year`` and ``last_year`` of their bouts, ``staged`` a ``death_year``.  By external id; then by folded name and
    year, unique on both sides; then by folded name, unique on both sides, where the nation agrees (home nations are one), the years
    don't differ by over one, and the life fits the career.  What a pass has claimed on either side is out of the next; an external id whose years
    differ by over one claims both sides and links nothing.  Names without letters never link.  Returns ``l``, ``r``, ``pass``.
    """
    own = ["first_year", "last_year"]
    rows = {
        "l": ours.select(F.col("id").alias("l"), "external_id", name_key(F.col("name")).alias("name"), "year", nation_key(F.col("nation")).alias("nation"), *own),
        "r": staged.select(F.col("id").alias("r"), "external_id", name_key(F.col("name")).alias("name"), "year", nation_key(F.col("nation")).alias("nation"), "death_year"),
    }
    apart = F.coalesce(F.abs(F.col("year_l") - F.col("year_r")) > 1, F.lit(False))
    fits = career_fits(F.col("year_r"), F.col("death_year_r"), F.col("first_year_l"), F.col("last_year_l"))
    claimed = None
    for number, keys, linked in ((1, ["external_id"], ~apart), (2, ["name", "year"], F.lit(True)), (3, ["name"], (F.col("nation_l") == F.col("nation_r")) & ~apart & fits)):
        unique = []
        for s, df in rows.items():
            open_ = df if claimed is None else df.join(claimed, s, "left_anti")
            others = [c for c in df.columns if c != s]
            kept = open_.dropna(subset=keys).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("n"), F.min(s).alias(s), *[F.min(c).alias(f"{c}_{s}") for c in others])
            unique.append(kept.where("n = 1").drop("n"))
        hits = unique[0].join(unique[1], [f"_{k}" for k in keys])
        hits = hits.withColumn("linked", linked)
        hits = written((hits if number == 1 else hits.where("linked")).select("l", "r", F.lit(number).alias("pass"), "linked"), "linkage")
        claimed = hits if claimed is None else claimed.unionByName(hits)
    return claimed.where("linked").drop("linked")


#: share of a hall's real cities from which one of them is its city
SURE_CITY = 0.6


def unified_venues(cards: DataFrame) -> DataFrame:
    """LNK06: cards (``event_id``, ``venue``, ``city``, ``country``) with one spelling for each hall of a city, and with a hall's real city where its own name stood for it.

    Of spellings that fold to the same the most frequent (with its spelling of the city) is kept, then one with letters beyond ASCII, then the longest, then the first.
    Where the city folds to the hall's name, the most frequent real city of that hall in that country replaces it if it has ``SURE_CITY`` of
    them.  Names without letters and nulls are left alone.
    """
    hall, place = name_key(F.col("venue")), name_key(F.col("city"))
    keyed = cards.withColumn("_hall", hall).withColumn("_place", place)
    spelled = keyed.dropna(subset=["_hall", "_place"]).groupBy("_hall", "_place", "venue", "city").agg(F.count("*").alias("n"))
    order = Window.partitionBy("_hall", "_place").orderBy(F.desc("n"), F.desc(F.col("venue").rlike(r"[^\x00-\x7f]")), F.desc(F.length("venue")), "venue")  # spellings of a hall
    best = spelled.withColumn("r", F.row_number().over(order)).where("r = 1").select("_hall", "_place", F.col("venue").alias("_best"))
    x = keyed.join(best, ["_hall", "_place"], "left").withColumn("venue", F.coalesce("_best", "venue")).withColumn("_land", F.coalesce(name_key(F.col("country")), F.lit("")))
    real = x.where("_place <> _hall").groupBy("_hall", "_land", "city").agg(F.count("*").alias("n"))
    cities = real.groupBy("_hall", "_land").agg(F.max(F.struct("n")).alias("top"), F.sum("n").alias("all"), F.min_by("city", F.struct(F.negative("n"), "city")).alias("_city"))
    cities = cities.where(F.col("top.n") >= SURE_CITY * F.col("all")).select("_hall", "_land", "_city")
    x = x.join(cities, ["_hall", "_land"], "left").withColumn("city", F.when(F.col("_place") == F.col("_hall"), F.coalesce("_city", "city")).otherwise(F.col("city")))
    return x.select(*cards.columns)


def checked_claims(claims: DataFrame, bouts: DataFrame) -> DataFrame:
    """JOIN13, LNK10: claims (``claim_id``, ``day``, ``name``, ``claimed``, ``distance``) held against bouts (``bout_id``, ``date``, ``name``, ``method``, ``rounds``).

    A claim meets bouts of the same name within a day of its own; only a single hit counts, and for decisions the
    scheduled distance must agree.  Claims without a hit are open.
    """
    days = claims.withColumn("date", F.explode(F.array(F.date_sub("day", 1), F.col("day"), F.date_add("day", 1))))
    hits = days.join(bouts, ["date", "name"]).groupBy("claim_id").agg(F.count("*").alias("hits"), F.min("bout_id").alias("bout_id"), F.min("method").alias("method"), F.min("rounds").alias("rounds"))
    x = claims.join(hits, "claim_id", "left")
    apart = F.col("claimed").isin("UD", "MD", "SD") & (F.col("rounds") != F.col("distance"))
    verdict = F.when(F.col("hits").isNull(), "no bout").when(F.col("hits") > 1, "ambiguous").when(apart, "other distance")
    verdict = verdict.when(F.col("method").isNull(), "only source").when(F.col("claimed") == F.col("method"), "agrees").otherwise("conflict")
    return x.select("claim_id", F.when(F.col("hits") == 1, F.col("bout_id")).alias("bout_id"), verdict.alias("verdict"))


def money_issues(w: League) -> DataFrame:
    """DQ02 of money as suppliers might deliver it."""
    return validated_money(*star.money(w), w.as_of.isoformat())[0]


def emptied_cards(w: League) -> DataFrame:
    """DQ07: cards with bouts of which none is left once bouts without a method and of odd ids are dropped."""
    left = w.bouts.where("method IS NOT NULL AND bout_id % 2 = 0")
    return w.events.where("NOT cancelled").join(w.bouts, "event_id", "left_semi").join(left, "event_id", "left_anti").select("event_id")


def restricted(w: League) -> DataFrame:
    """DQ11, DQ12: bouts of which both fighters reconcile, and their share of all."""
    from .merging import reconciliation

    ok = reconciliation(w).where("verdict = 'complete'").select("boxer_id")
    both = w.bouts.join(ok.select(F.col("boxer_id").alias("red_id")), "red_id", "left_semi").join(ok.select(F.col("boxer_id").alias("blue_id")), "blue_id", "left_semi")
    return both.agg(F.count("*").alias("bouts")).crossJoin(w.bouts.agg(F.count("*").alias("of")))  # a row each


def surprises(w: League) -> DataFrame:
    """DQ14: heuristics over careers, each with the number of fighters it finds."""
    c = w.careers
    tests = {"many-draws": F.col("draws") > 6, "no-losses": (F.col("losses") == 0) & (F.col("bouts") > 10), "very-young": F.year("debut") - F.col("birth_year") < 15, "all-kos": (F.col("kos") == F.col("wins")) & (F.col("wins") >= 5), "inactive-recent": ~F.col("active") & (F.col("last_fight") > "2000-06-01")}
    counted = c.agg(*[count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items()])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("code"), F.col(f"`{n}`").alias("n")) for n in tests])).alias("x")).select("x.*")


def corrected(w: League) -> DataFrame:
    """STR06: bouts of which an override is held, and whether the delivered value has moved since."""
    b = w.bouts.where("method IS NOT NULL")
    o = b.where("bout_id % 97 = 0").select("bout_id", F.lit("NC").alias("new"), F.when(F.col("bout_id") % 2 == 0, F.col("method")).otherwise("UD").alias("seen"))
    x = b.join(o, "bout_id")
    return x.select("bout_id", "new", (F.col("method") != F.col("seen")).alias("moved"))


def picks_in_time(w: League) -> DataFrame:
    """STR16: events by whether they come before the day of the card that they name."""
    e = w.raw("events").select("event_id", "ts", (F.col("event_id") * 4).alias("card"))
    c = w.events.select(F.col("event_id").alias("card"), "date")
    return e.join(c, "card").groupBy((F.to_date("ts") < F.col("date")).alias("in_time")).agg(F.count("*").alias("n"))


def post_limits(posts: DataFrame, who: str, most: int, window: str) -> DataFrame:
    """STR11: more than ``most`` posts of one user or address in a window of time (batch: aligned windows)."""
    x = posts.groupBy(who, F.window("ts", window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > most)
    return x.select(F.col(who).cast("string").alias("who"), F.col("w.start").alias("start"), "n")


def post_limits_of(w: League) -> DataFrame:
    """STR11: all three limits: a user's ten minutes, an address's ten minutes, a new account's (its first day) posts of a day."""
    e = w.raw("events").select("event_id", "user_id", "ts", F.pmod("event_id", F.lit(7)).alias("address"))
    first = e.groupBy("user_id").agg(F.min("ts").alias("since"))
    new = e.join(first, "user_id").where(F.col("ts") < F.col("since") + F.expr("INTERVAL 1 DAY"))
    limits = [("user", post_limits(e, "user_id", 1, "10 minutes")), ("address", post_limits(e, "address", 3, "10 minutes")), ("new account", post_limits(new, "user_id", 2, "1 day"))]
    return reduce(DataFrame.unionByName, [x.select(F.lit(kind).alias("limit"), "who", "start", "n") for kind, x in limits])


def reporters(reports: DataFrame, least: int = 6, days: int = 7, posts: int = 3) -> DataFrame:
    """STR12: subjects that ``least`` different people report whose first post is ``days`` old and who have ``posts`` or more by then.

    ``reports``: ``subject``, ``user_id``, ``ts``; a report is a post of its author too.
    """
    own = Window.partitionBy("user_id").orderBy("ts")
    x = reports.withColumn("since", F.first("ts").over(own)).withColumn("before", F.row_number().over(own) - 1)
    old = (F.col("ts") >= F.col("since") + F.expr(f"INTERVAL {days} DAYS")) & (F.col("before") >= posts)
    return x.where(old).groupBy("subject").agg(F.countDistinct("user_id").alias("users")).where(F.col("users") >= least)


def part_keys(w: League) -> DataFrame:
    """FN03: part brands and types by their sorted words."""
    return w.raw("part").groupBy(sorted_words_key(F.col("p_type")).alias("key")).agg(F.count("*").alias("n"))
