"""SRCH06: people named in running text, in full or with a slip or two.

Words of names are found by a neighbourhood of deletions: two words within k slips agree once at most k letters are taken out of each, so both
sides are joined by their shortened forms and then compared.  A name is looked for at its anchor, the word that fewest names have, and its
other words are compared with those beside it.  What a text holds is settled per text: full names claim their words first, the longest before
others; in the words left, near names with the fewest slips; where two people fit a stretch equally well, neither is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import folded
from ..functions.shuffles import Keys, join_per_key, sifted
from ..storage import written
from .search import allowed_slips, osa_distance

# What parts words; slips forgiven in a whole name.
BREAKS = r"[\s\-.,;:!?؟،()\"“”'’]+"
MOST_SLIPS = 2


def words_of(text: Column) -> Column:
    return F.filter(F.split(folded(text), BREAKS), lambda w: w != "")


def slips_between(typed: str, word: str) -> int | None:
    """Slips that make ``word`` of what was typed, if no more than its length allows; short words have to be the same."""
    if typed == word:
        return 0
    if min(len(typed), len(word)) <= 3:
        return None
    most = allowed_slips(max(len(typed), len(word)))
    found = osa_distance(typed, word, most)
    return found if found <= most else None


def shortened(word: Column) -> Column:
    """The word, without any letter and, if it is long, without any two."""
    n = F.length(word)
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    once = without(word)
    own = F.array(word)
    return F.array_distinct(F.when(n <= 3, own).when(n <= 6, F.concat(own, once)).otherwise(F.concat(own, once, F.flatten(F.transform(once, without)))))


def near_pairs(typed: DataFrame, known: DataFrame) -> DataFrame:
    """``typed``, ``word`` and ``slips`` of words (column ``word`` of either side, no repeats) that are the same or near.

    A long word has over two hundred forms.  Most of those of known words that no typed word has are dropped before the shuffle.
    """

    @F.pandas_udf("int")
    def slips(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slips_between(x, y) for x, y in zip(a, b)], dtype="Int32")

    # forms and words travel as hashes: who meets by chance is discarded with those who are not near
    forms = lambda df, name: df.select(F.explode(F.transform(shortened(F.col("word")), lambda f: F.xxhash64(f))).alias("form"), F.xxhash64("word").alias(name))
    a, b = forms(typed, "t"), forms(known, "k")
    b = written(sifted(b, a, "form"), "forms-asked-for")
    # sizes are estimated from names and texts, of which a form is a small part; without the hint these sides may be taken for small and broadcast
    met = a.join(b.hint("merge"), "form").select("t", "k").distinct()
    for df, name, key in ((typed, "typed", "t"), (known, "word", "k")):
        met = met.join(df.select(F.col("word").alias(name), F.xxhash64("word").alias(key)).hint("merge"), key)
    return met.select("typed", "word").withColumn("slips", slips("typed", "word")).where("slips IS NOT NULL")


def settled(hits: list[dict]) -> list[dict]:
    """The hits (``owner``, ``first``, ``count``, ``slips``, ``letters``) of a text that name somebody, in its order, each owner once."""
    taken: set[int] = set()
    out: list[dict] = []
    span = lambda h: range(h["first"], h["first"] + h["count"])
    for h in sorted((h for h in hits if not h["slips"]), key=lambda h: (-h["letters"], h["first"], h["owner"])):
        if taken.isdisjoint(span(h)):
            taken.update(span(h))
            out.append(h)
    near = sorted((h for h in hits if h["slips"] and taken.isdisjoint(span(h))), key=lambda h: (h["slips"], -h["count"], h["first"], h["owner"]))
    for h in near:
        if taken.isdisjoint(span(h)):
            taken.update(span(h))
            if not any(x["owner"] != h["owner"] and (x["slips"], x["count"]) == (h["slips"], h["count"]) and abs(x["first"] - h["first"]) < h["count"] for x in near):
                out.append(h)
    named: dict = {}
    for h in sorted(out, key=lambda h: (h["slips"] > 0, h["first"])):
        named.setdefault(h["owner"], h)
    return sorted(named.values(), key=lambda h: h["first"])


def _settled_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(k, h) for k, hits in enumerate(batch.column("hits").to_pylist()) for h in settled(hits)]
        own = batch.column("doc_id").take(pa.array([k for k, _ in found], pa.int64()))
        owner = pa.array([h["owner"] for _, h in found], batch.schema.field("hits").type.value_type.field("owner").type)
        yield pa.record_batch([own, owner, *[pa.array([h[c] for _, h in found], pa.int32()) for c in ("first", "count", "slips")]], names=["doc_id", "owner", "first", "count", "slips"])


def people_in_texts(names: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc_id``, ``owner``, ``first`` (number of the name's first word in the text, from 0), ``count`` (its words) and ``slips``.

    ``names``: ``owner``, ``name``, several for one owner if they have several; names of one word name nobody.  ``texts``: ``doc_id``, ``text``.
    Null texts hold nothing.  Neither names nor texts are broadcast, but a table of bits of a fixed size, and the typed words that are near a name's, if they are few.
    """
    n = names.select("owner", words_of(F.col("name")).alias("name")).where(F.size("name") >= 2).distinct()
    n = written(n.withColumn("name_id", F.monotonically_increasing_id()), "names")
    by_word = n.select("name_id", "owner", "name", F.posexplode("name").alias("at", "word"))
    frequency = by_word.groupBy("word").agg(F.countDistinct("name_id").alias("held"))
    rarest = Window.partitionBy("name_id").orderBy("held", "at")  # a name's words
    anchors = by_word.join(frequency.hint("merge"), "word").withColumn("r", F.row_number().over(rarest)).where("r = 1").select("word", "owner", "name", "at")
    tokens = written(texts.select("doc_id", words_of(F.col("text")).alias("words")), "words-of-texts")
    each = tokens.select("doc_id", F.posexplode("words").alias("i", "typed"))
    pairs = written(near_pairs(each.select(F.col("typed").alias("word")).distinct(), anchors.select("word").distinct()), "near-words")
    # the rows of a word that is near an anchor, with the words around it: as many as the longest name has
    width = n.agg(F.coalesce(F.max(F.size("name")), F.lit(0))).first()[0]
    around = F.slice("words", F.greatest(F.col("i") - width, F.lit(0)) + 1, 2 * width + 1)
    placed = tokens.select("doc_id", "words", F.posexplode("words").alias("i", "typed")).select("doc_id", "typed", "i", around.alias("around"), F.least("i", F.lit(width)).alias("before"))
    placed = Keys(pairs.select("typed"), "words-near-anchors").told(placed, F.col("typed"), "_near").where("_near").drop("_near")
    uses = each.groupBy("typed").agg(F.count("*").alias("n")).join(pairs.select("typed").distinct().hint("merge"), "typed")
    near = join_per_key(placed, uses, "typed", max(1, each.count())).drop("n").join(pairs.select("typed", "word").hint("merge"), "typed").join(anchors.hint("merge"), "word")
    start = F.col("before") - F.col("at")
    near = near.where((start >= 0) & (start + F.size("name") <= F.size("around")))

    @F.pandas_udf("int")
    def total(stretch: pd.Series, name: pd.Series) -> pd.Series:
        def one(a: list[str], b: list[str]) -> int | None:
            slips = 0
            for x, y in zip(a, b):
                s = slips_between(x, y)
                if s is None or (slips := slips + s) > MOST_SLIPS:
                    return None
            return slips

        return pd.Series([one(a, b) for a, b in zip(stretch, name)], dtype="Int32")

    hits = near.select("doc_id", "owner", (F.col("i") - F.col("at")).alias("first"), F.size("name").alias("count"), F.length(F.array_join("name", " ")).alias("letters"), total(F.slice("around", start + 1, F.size("name")), "name").alias("slips"))
    hits = hits.where("slips IS NOT NULL").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("owner", "first", "count", "slips", "letters")).alias("hits"))
    fields = [tokens.schema["doc_id"], T.StructField("owner", names.schema["owner"].dataType), *[T.StructField(c, T.IntegerType()) for c in ("first", "count", "slips")]]
    return hits.mapInArrow(_settled_task, T.StructType(fields))
