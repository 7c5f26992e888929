"""Exact duplicates by heavy-hitter split; DataFrame functions only.

Texts are equal when their SHA-256 after white space normalisation is equal.  A Misra-Gries pass
(Spark's ``freqItems``: at most ``1 / support`` counters, no frequent digest missed) proposes the
frequent digests; their exact counts are then taken, and the winners, at most ``1 / support`` rows by
arithmetic, are broadcast: their copies are settled on the map side and never shuffled.  All other
digests are counted with partial sums before a shuffle, and rows of digests that occur more than once meet
their count in a join, so no group of equal rows is gathered anywhere, however many rows there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_marked, text_of, written

SPACES = r"[\x20\x09-\x0D]+"


def digest_of(text_col: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text with each run of ASCII white space as one space."""
    return F.sha2(F.regexp_replace(text_of(text_col), SPACES, " "), 256)


def support_for(rows: int) -> float:
    """The share of rows from which a digest counts as frequent; ``freqItems`` takes no smaller one than 1e-4."""
    return min(5e-4, max(1e-4, 1e6 / max(1, rows)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the smallest id stays.  Null text counts as empty, so null and empty
    texts form one group.  A null id loses to every other id.  Of repeated rows (same id and text)
    exactly one is kept.  Other columns, whatever their names, are not read.  No rows give no rows.
    """
    rows = written(
        docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest_of(text_col).alias("digest")),
        "digests",
    )
    total = rows.count()
    support = support_for(total) if support is None else support
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    frequent = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    winners = (
        rows.join(F.broadcast(frequent.distinct()), "digest")
        .groupBy("digest")
        .agg(F.count("*").alias("size"), F.min(order).alias("first"))
        .where(F.col("size") >= F.lit(max(2.0, support * total)))
    )
    winners = written(winners, "heavy-digests")
    heavy = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    several = rest.groupBy("digest").agg(F.count("*").alias("size"), F.min(order).alias("first")).where("size > 1")
    rest = rest.join(several, "digest", "left").withColumn("size", F.coalesce("size", F.lit(1))).withColumn("first", F.coalesce("first", order))
    return heavy.unionByName(rest).select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float | None = None) -> DataFrame:
    """The documents that stay, with their own columns (see :func:`exact_groups`)."""
    groups = exact_groups(docs, id_col, text_col, support).select(id_col, "text_sha256", F.col("kept").alias("stays"))
    return keep_marked(docs, {id_col: F.col(id_col), "text_sha256": digest_of(text_col)}, groups)
