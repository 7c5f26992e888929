"""Values in one spelling: results, weight classes, countries, broadcasters; small functions on text and numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import folded

# Spellings of results, in lower case and without separators; and words that tell what kind of decision it was.
RESULT_SPELLINGS = {
    "KO": ["ko", "knockout", "knock out", "k.o."],
    "TKO": ["tko", "t.k.o.", "technical knockout", "technical knock out", "referee stoppage", "stoppage", "stopped", "rsc"],
    "RTD": ["rtd", "retired", "retirement", "corner retirement", "corner stoppage", "corner"],
    "DQ": ["dq", "disqualification", "disqualified"],
    "UD": ["ud", "unanimous", "unanimous decision", "decision unanimous", "unanimous points", "points", "pts", "decision"],
    "MD": ["md", "majority", "majority decision", "decision majority"],
    "SD": ["sd", "split", "split decision", "decision split"],
    "TD": ["td", "technical decision", "tech decision", "technical points"],
    "TDRAW": ["tdraw", "technical draw", "td draw"],
    "DRAW": ["draw", "drawn", "d", "majority draw", "split draw", "unanimous draw"],
    "NC": ["nc", "n c", "no contest", "no decision", "nd", "n d"],
}
DECISION_WORDS = {"techn": "TD", "unanim": "UD", "major": "MD", "split": "SD"}

# Weight classes, lightest first, with the limit in pounds and the words of their names ("weight" left out).
DIVISIONS = {
    "Minimumweight": (105, ["minimum", "straw", "mini fly", "atom"]),
    "Light Flyweight": (108, ["light fly", "junior fly", "super fly 108"]),
    "Flyweight": (112, ["fly"]),
    "Super Flyweight": (115, ["super fly", "junior bantam"]),
    "Bantamweight": (118, ["bantam"]),
    "Super Bantamweight": (122, ["super bantam", "junior feather"]),
    "Featherweight": (126, ["feather"]),
    "Super Featherweight": (130, ["super feather", "junior light"]),
    "Lightweight": (135, ["light"]),
    "Super Lightweight": (140, ["super light", "junior welter", "light welter"]),
    "Welterweight": (147, ["welter"]),
    "Super Welterweight": (154, ["super welter", "junior middle", "light middle"]),
    "Middleweight": (160, ["middle"]),
    "Super Middleweight": (168, ["super middle"]),
    "Light Heavyweight": (175, ["light heavy", "lhw"]),
    "Cruiserweight": (200, ["cruiser", "junior heavy"]),
    "Heavyweight": (None, ["heavy", "hw"]),
}
SAME_WORDS = {"jr": "junior", "lb": "pounds", "lbs": "pounds", "pound": "pounds", "above": "over"}
SILENT_WORDS = ("", "women", "womens", "female", "ladies", "men", "mens", "male", "s", "weight")

# How channels' names begin, and words that name nobody.
CHANNELS = {
    "dazn": "DAZN", "espn": "ESPN", "espn +": "ESPN+", "showtime": "Showtime", "show time": "Showtime", "youtube": "YouTube", "fite": "FITE", "fox": "FOX", "sky sports": "Sky Sports", "sky sport": "Sky Sports",
    "skysports": "Sky Sports", "sky box office": "Sky Sports", "bt sport": "TNT Sports", "btsport": "TNT Sports", "tnt sports": "TNT Sports", "tnt sport": "TNT Sports", "trillertv": "TrillerTV", "triller tv": "TrillerTV", "hbo": "HBO",
    "amazon": "Amazon Prime Video", "itv": "ITV", "nbc": "NBC", "cbs": "CBS", "facebook": "Facebook", "probox tv": "ProBox TV", "proboxtv": "ProBox TV", "peacock": "Peacock", "fubo": "Fubo", "fubotv": "Fubo", "paramount": "Paramount+",
}
NOBODY = ("n/a", "na", "string", "pay per view", "ppv", "internet ppv", "internet stream", "internet", "tbd", "tba", "unknown", "none")

# Other names of countries.
COUNTRIES = {
    "usa": "United States", "us": "United States", "u s": "United States", "united states of america": "United States", "uk": "United Kingdom", "great britain": "United Kingdom", "britain": "United Kingdom",
    "republic of ireland": "Ireland", "russian federation": "Russia", "turkiye": "Turkey", "czech republic": "Czechia", "ivory coast": "Côte d’Ivoire", "cape verde": "Cabo Verde", "swaziland": "Eswatini",
    "macedonia": "North Macedonia", "burma": "Myanmar", "bosnia": "Bosnia & Herzegovina", "bosnia herzegovina": "Bosnia & Herzegovina", "holland": "Netherlands", "uae": "United Arab Emirates", "korea": "South Korea",
    "viet nam": "Vietnam", "east timor": "Timor-Leste", "drc": "Congo - Kinshasa", "dr congo": "Congo - Kinshasa", "democratic republic of congo": "Congo - Kinshasa", "congo": "Congo - Brazzaville",
    "republic of congo": "Congo - Brazzaville", "western australia": "Australia", "new south wales": "Australia", "queensland": "Australia", "tasmania": "Australia", "south australia": "Australia",
}
UK_NATIONS = ["England", "Scotland", "Wales", "Northern Ireland"]

ACCENTED, PLAIN = "áàâäãåāéèêëēíìîïīóòôöõōúùûüūçñýÿ", "aaaaaaaeeeeeiiiiioooooouuuuucnyy"


def looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def spaced(text: Column, separators: str) -> Column:
    """Lower case, each run of separators and white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), separators, " "), r"\s+", " "))


def method_of(text: Column) -> Column:
    """FN09: the result that a spelling stands for; null for none."""
    flat = spaced(text, r"[-_/–—:()]+")
    named = looked_up(flat, {s: m for m, spellings in RESULT_SPELLINGS.items() for s in spellings})
    kind = F.when(F.lit(False), F.lit(""))
    for word, method in DECISION_WORDS.items():
        kind = kind.when(flat.contains(word), method)
    return F.coalesce(named, F.when(flat.rlike(r"^disqualif\w*$"), "DQ"), F.when(flat.contains("decision") | flat.contains("points"), kind))


def words_of(text: Column, letters: str = "[a-z]+|[0-9]+") -> Column:
    """The words and numbers of a folded text."""
    return F.regexp_extract_all(folded(text), F.lit(f"({letters})"))


def division_of(text: Column) -> Column:
    """FN08: the weight class that a spelling stands for; null for none.

    Its words, without what is silent and without "weight", are looked up with their numbers, then without; then "over" 200 counts as the
    heaviest class, and a limit in pounds as its class.
    """
    named = {words: name for name, (_, spellings) in DIVISIONS.items() for words in spellings}
    limits = {str(pounds): name for name, (pounds, _) in DIVISIONS.items() if pounds}
    short = F.transform(words_of(text), lambda w: F.regexp_replace(w, "weight$", ""))
    short = F.transform(short, lambda w: F.coalesce(looked_up(w, SAME_WORDS), w))
    words = F.filter(short, lambda w: ~w.isin(*SILENT_WORDS))
    number = lambda w: w.rlike("^[0-9]+$")
    unit = lambda w: w.isin("pounds", "over")
    numbers = F.filter(words, number)
    by_both = looked_up(F.array_join(F.filter(words, lambda w: ~unit(w)), " "), named)
    by_name = looked_up(F.array_join(F.filter(words, lambda w: ~number(w) & ~unit(w)), " "), named)
    over = F.when(F.array_contains(numbers, "200") & (F.array_contains(words, "over") | text.contains("+")), "Heavyweight")
    only = F.forall(words, lambda w: number(w) | unit(w)) & F.array_contains(words, "pounds")
    return F.coalesce(by_both, by_name, over, F.when(only, looked_up(F.get(numbers, F.lit(0)), limits)))


def country_of(text: Column) -> Column:
    """FN10: a country's one name; what is not known by another name stays as it is."""
    key = F.translate(spaced(F.regexp_replace(F.lower(text), "&", "and"), r"\bthe\b"), ACCENTED + "’'.", PLAIN)
    return F.coalesce(looked_up(F.trim(key), COUNTRIES), F.trim(text))


def in_country(country: Column, wanted: str) -> Column:
    """FN10: whether a place is ``wanted`` or a nation within it."""
    return country.isin([wanted, *UK_NATIONS] if wanted == "United Kingdom" else [wanted])


def broadcaster_of(text: Column) -> Column:
    """FN11: the one name of a channel, by the first words of a spelling, the longest known first; null for nobody; others as they are."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    words = words_of(plain, r"[a-z0-9]+|\+")
    known = [looked_up(F.array_join(F.slice(words, 1, n), " "), CHANNELS) for n in (3, 2, 1)]
    return F.when((plain != "") & ~F.lower(plain).isin(*NOBODY), F.coalesce(*known, plain))


def slug_of(text: Column, plus: str = "-plus") -> Column:
    """A name as an address: ASCII letters and digits in lower case, joined by hyphens."""
    return F.trim(F.regexp_replace(F.translate(F.regexp_replace(F.lower(text), r"\+", plus), ACCENTED, PLAIN), "[^a-z0-9]+", "-"), F.lit("-"))


def fnv1a(text: Column) -> Column:
    """FN14: FNV-1a of 32 bits over the characters' codes."""
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)


def upper_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """FN13: each key's median, of an even number of values the larger of the middle two; from counts of equal values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(key)
    upto = F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    middle = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(own)).where(F.col("upto") > F.floor(F.col("all") / 2))
    return middle.groupBy(key).agg(F.min(value).alias("median"), F.max("all").alias("n"))


def natural_earth(lat: Column, lon: Column, width: float = 1000.0) -> tuple[Column, Column]:
    """FN17: latitude and longitude on a map of that width in the Natural Earth projection (Šavrič, Jenny and Patterson 2011), to a tenth."""
    across = lambda p: 0.8707 - 0.131979 * p**2 - 0.013791 * p**4 + 0.003971 * p**10 - 0.001529 * p**12
    down = lambda p: p * (1.007226 + 0.015085 * p**2 - 0.044475 * p**6 + 0.028874 * p**8 - 0.005916 * p**10)
    scale = width / (2 * math.pi * across(0.0))
    height = round(2 * down(math.pi / 2) * scale)
    p, q = (F.radians(F.least(F.greatest(c.cast("double"), F.lit(-m)), F.lit(m))) for c, m in ((lat, 90.0), (lon, 180.0)))
    tenth = lambda c: F.floor(F.round(c * 10, 6) + 0.5) / 10
    return tenth(q * across(p) * scale + width / 2), tenth(height / 2 - down(p) * scale)


def read_as(df: DataFrame, spelled: Column, read: Column) -> DataFrame:
    """How often each spelling occurs and what it is read as."""
    return df.groupBy(spelled.alias("spelled")).agg(F.count("*").alias("n")).select("spelled", read.alias("read"), "n")


def broadcaster_links(cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """LNK08: (organisations: ``external_id``, ``name``; cards: ``event_id``, ``external_id``) of cards with free-text ``broadcaster``."""
    named = cards.select("event_id", broadcaster_of(F.col("broadcaster")).alias("name")).where("name IS NOT NULL")
    links = named.select("event_id", "name", F.concat(F.lit("broadcaster:broadcaster-"), slug_of(F.col("name"))).alias("external_id"))
    return links.select("external_id", "name").distinct(), links.select("event_id", "external_id")
