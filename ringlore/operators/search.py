"""Fighter filters, sorts, paging and text search."""

from __future__ import annotations

import dataclasses
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import folded, folded_word
from ..plans.league import League
from .canon import in_country


@dataclasses.dataclass(frozen=True)
class Filters:
    """FLT01: a conjunction of optional tests; an unknown value passes none of them."""

    division: str | None = None
    sex: str | None = None
    stance: str | None = None
    country: str | None = None
    active: bool | None = None
    undefeated: bool = False
    archetype: str | None = None
    text: str | None = None
    win_streak: int | None = None
    least: dict[str, float] = dataclasses.field(default_factory=dict)
    most: dict[str, float] = dataclasses.field(default_factory=dict)
    fought_since: str | None = None
    fought_until: str | None = None
    missed_weight: bool = False
    champion: str | None = None
    trainer_id: int | None = None
    trainer_name: str | None = None
    team_now: bool = False
    gym_nation: str | None = None
    new_trainer_since: str | None = None
    record: str | None = None

    def columns(self) -> list[Column]:
        out = [F.col(n) == v for n in ("division", "sex", "stance", "active", "archetype") if (v := getattr(self, n)) is not None]
        out += [in_country(F.col("country"), self.country)] if self.country else []
        out += [{"winning": F.col("wins") > F.col("losses"), "losing": F.col("wins") < F.col("losses")}[self.record]] if self.record else []
        out += [(F.col("losses") == 0) & (F.col("bouts") > 0)] * self.undefeated
        out += [folded(F.col("name")).contains(folded_word(self.text))] if self.text else []
        out += [(F.col("streak_type") == "W") & (F.col("streak") >= self.win_streak)] if self.win_streak else []
        # a rating is compared as it is shown, rounded
        shown = {"rating": F.floor(F.col("rating") + 0.5), "debut_year": F.year("debut")}
        out += [shown.get(n, F.col(n)) >= v for n, v in self.least.items()] + [shown.get(n, F.col(n)) <= v for n, v in self.most.items()]
        out += [F.col("last_fight") >= F.lit(self.fought_since).cast("date")] if self.fought_since else []
        return out + ([F.col("last_fight") <= F.lit(self.fought_until).cast("date")] if self.fought_until else [])


def search(w: League, f: Filters) -> DataFrame:
    """Fighters that pass every test: column tests first, then semi-joins."""
    x = reduce(DataFrame.where, f.columns(), w.careers)
    if f.missed_weight:
        x = x.join(w.weigh_ins.where("made = false"), "boxer_id", "left_semi")
    if f.champion:
        x = x.join(champions(w, f.champion), "boxer_id", "left_semi")
    team = w.stints.where("end IS NULL") if f.team_now else w.stints
    if f.trainer_id is not None:
        x = x.join(team.where(F.col("person_id") == f.trainer_id), "boxer_id", "left_semi")
    if f.trainer_name:
        named = w.raw("supplier").where(F.lower("s_name").contains(f.trainer_name.lower())).select(F.col("s_suppkey").alias("person_id"))
        x = x.join(team.join(named, "person_id", "left_semi"), "boxer_id", "left_semi")
    if f.gym_nation:
        n = w.raw("nation").where(F.lower("n_name").contains(f.gym_nation.lower()))
        gym = w.raw("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("person_id"))
        x = x.join(team.join(gym, "person_id", "left_semi"), "boxer_id", "left_semi")
    if f.new_trainer_since:
        own = Window.partitionBy("boxer_id").orderBy("start")
        moved = w.stints.withColumn("before", F.lag("person_id").over(own)).where(F.col("before") != F.col("person_id"))
        recent = (F.col("start") >= F.lit(f.new_trainer_since).cast("date")) & (F.col("start") <= F.lit(w.as_of))
        x = x.join(moved.where(recent), "boxer_id", "left_semi")
    return x


def champions(w: League, which: str) -> DataFrame:
    """FLT15, SET03: ``current`` holders, all who ``ever`` held a belt, or ``former`` ones, who hold none now."""
    ever = w.reigns.select(F.col("champion_id").alias("boxer_id"))
    current = w.reigns.where("end IS NULL").select(F.col("champion_id").alias("boxer_id"))
    return {"ever": ever.distinct(), "current": current.distinct(), "former": ever.distinct().exceptAll(current.distinct())}[which]


def sort_unknown_last(df: DataFrame, by: str, descending: bool, *ties: str) -> DataFrame:
    """ORD01, ORD03: unknown values last in either direction; texts in order of their folded spelling."""
    value = folded(F.col(by)) if isinstance(df.schema[by].dataType, T.StringType) else F.col(by)
    return df.orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), *ties)


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """ORD06: rows of page ``number`` (from 1, beyond the last the last) and the total."""
    total = df.count()
    number = max(1, min(number, -(-total // size)))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).withColumn("total", F.lit(total))


def type_ahead(w: League, text: str, limit: int = 10, table: str = "part", column: str = "p_name", key: str = "p_partkey") -> DataFrame:
    """SRCH01, ORD08: names that hold every word; those that begin with the text first, then at a word, then anywhere."""
    whole = folded_word(text)
    words = whole.split()
    name = folded(F.col(column))
    x = reduce(DataFrame.where, [name.contains(t) for t in words], w.raw(table))
    rank = F.when(name.startswith(whole), 0).when(F.concat(F.lit(" "), name).contains(f" {whole}"), 1).otherwise(2)
    return x.select(F.col(key).alias("id"), F.col(column).alias("name"), rank.alias("rank")).orderBy("rank", "name", "id").limit(limit)


def global_search(w: League, text: str, cap: int = 5) -> DataFrame:
    """SRCH04: fighters, countries, suppliers, parts and events that hold the text, a few of each kind."""
    t = text.lower()
    kinds = [
        w.fighters.select(F.lit("fighter").alias("kind"), F.col("boxer_id").alias("id"), "name"), w.raw("nation").select(F.lit("country"), F.col("n_nationkey").cast("long"), "n_name"),
        w.raw("supplier").select(F.lit("trainer"), "s_suppkey", "s_name"), w.raw("part").select(F.lit("part"), "p_partkey", "p_name"), w.events.select(F.lit("event"), "event_id", "event_name"),
    ]
    x = reduce(DataFrame.union, [k.where(F.lower(F.col(k.columns[2])).contains(t)) for k in kinds])
    return x.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("name", "id"))).where(F.col("n") <= cap).drop("n")


def word_index(w: League) -> DataFrame:
    """SRCH03: words and pairs of words of part names with the number of names that hold them."""
    words = F.filter(F.split(F.lower("p_name"), r"[\s\-.,']+"), lambda x: x != "")
    x = w.raw("part").select("p_partkey", words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    return x.select("p_partkey", F.explode(F.array_distinct(F.concat("w", pairs))).alias("word")).groupBy("word").agg(F.countDistinct("p_partkey").alias("names"))


def unique_names(names: DataFrame) -> DataFrame:
    """SRCH05: words of names (``name``) that belong to one name alone."""
    words = F.filter(F.split(F.lower("name"), r"[\s#\-.,']+"), lambda x: x != "")
    x = names.select("name", F.explode(words).alias("word")).distinct()
    return x.groupBy("word").agg(F.count("*").alias("owners"), F.min("name").alias("name")).where("owners = 1").select("word", "name")


def osa_distance(a: str, b: str, most: int = 2) -> int:
    """FN06: edits (with swaps of neighbours, no letter edited twice) between two words; ``most + 1`` if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
        older, old = old, row
    return min(old[-1], most + 1)


def allowed_slips(word: str | int) -> int:
    """FN07: no slip in up to three letters, one in up to six, two in more."""
    n = word if isinstance(word, int) else len(word)
    return 0 if n <= 3 else 1 if n <= 6 else 2


def near_words(words: DataFrame, asked: list[str]) -> DataFrame:
    """SRCH02, JOIN17: ``words`` (column ``word``) within the allowed slips of the asked ones; a filter by length and by plain distance stays in the JVM."""

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([osa_distance(x, y) for x, y in zip(a, b)], dtype="int32")

    ask = F.broadcast(words.sparkSession.createDataFrame([(a, allowed_slips(a)) for a in asked], "asked string, slips int"))  # as many rows as are asked
    near = words.join(ask, (F.abs(F.length("word") - F.length("asked")) <= F.col("slips")) & (F.levenshtein("word", "asked") <= 2 * F.col("slips")))
    return near.withColumn("distance", distance("word", "asked")).where(F.col("distance") <= F.col("slips")).drop("slips")


def fuzzy_words(w: League, asked: list[str]) -> DataFrame:
    """JOIN17: words of part names near the asked ones."""
    words = w.raw("part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    return near_words(words, asked).select("asked", "word", "distance", "n")


def by_name(rows: DataFrame, typed: str) -> DataFrame:
    """SRCH08, SRCH02: rows (``id``, ``name``, ``rank``) that hold every word typed; if none does, those with a word near each, fewest slips first.

    ``slips`` is 0 for the former.  Nothing typed is every row.
    """
    asked = list(dict.fromkeys(folded_word(typed).split()))
    exact = reduce(DataFrame.where, [folded(F.col("name")).contains(a) for a in asked], rows)
    if not asked or not exact.isEmpty():
        return exact.select("id", "name", "rank", F.lit(0).alias("slips"))
    each = rows.select("id", "name", "rank", F.explode(F.array_distinct(F.split(folded(F.col("name")), r"[\s\-]+"))).alias("word"))
    near = near_words(each.select("word").distinct(), asked)
    best = each.join(near, "word").groupBy("id", "name", "rank", "asked").agg(F.min("distance").alias("slips"))
    return best.groupBy("id", "name", "rank").agg(F.count("*").alias("n"), F.sum("slips").cast("long").alias("slips")).where(F.col("n") == len(asked)).drop("n")


def _grams(text: str, n: int) -> Column:
    """All runs of ``n`` words of a text."""
    # bound to a variable, or else the split would be done again for every place
    of = lambda words: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", F.slice(words, i + 1, n))))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    return F.coalesce(F.transform(F.array(words), of)[0], F.array().cast("array<string>"))


def names_in_text(names: DataFrame, texts: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """SRCH07: texts (``doc_id``, ``text``) that hold names (``name_id``, ``name``) of ``least`` words or more, by equal runs of words.

    A name of up to ``most`` words is one run; of a longer one every run of ``most`` words counts.  A run that several
    names share counts for each.  Both sides are shuffled by run; neither is broadcast.
    """
    words = F.filter(F.split(F.lower("name"), r"\s+"), lambda x: x != "")
    n = F.least(F.size(words), F.lit(most)).alias("n")
    rows = names.select("name_id", "name", n).where(F.col("n") >= least)
    lengths = [r["n"] for r in rows.select("n").distinct().collect()]  # at most `most` numbers
    runs = [(rows.where(F.col("n") == k).select("name_id", F.explode(_grams("name", k)).alias("gram")), texts.select("doc_id", F.explode(_grams("text", k)).alias("gram"))) for k in lengths]
    hits = [a.distinct().join(b, "gram") for a, b in runs]
    if not hits:
        hits = [rows.select("name_id", F.lit(None).cast("long").alias("doc_id"), "name").limit(0).select(F.col("name").alias("gram"), "name_id", "doc_id")]
    return reduce(DataFrame.unionByName, hits).groupBy("name_id").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("times"))
