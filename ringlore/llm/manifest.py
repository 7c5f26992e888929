"""Merkle manifest of a dataset as a content-addressed graph, and proofs by descending it.

A leaf is the digest of a row's fields.  Within each group (``lang``) leaves stand in ascending order of id, and every eight
consecutive nodes become one, level by level, until one is left, the group's subroot; subroots, ordered by group, become
one root in the same way.  The store has a record for each node above the leaves: its digest and its children's digests, as often as
they occur but once a digest, since equal digests have equal children.

A proof is found from the root: a request's rank, read as base-8 digits, says which child to follow at each record, and the children
that are not followed are the path's segment.  Requests that share the leading digits share the rows that descend, so a level has as many rows as it
has wanted nodes, and the records of a level are looked up by digest.  Reversed, the segments lead from leaf to root.

Rows of equal id in a group are ordered by digest; repeated rows are leaves of their own with the same digest (and, but for their places, no way
to tell them apart).  Null ids come first, null groups are a group of their own and come first.  Of no rows there is no root and no proof.
Only the named columns are read.  Nothing is collected but heights and counts; a group may hold all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_per_key, numbered, written

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: heights of the tree over the groups' subroots begin here
TRUNK = 1000


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields, each ``-`` if null and otherwise its number of bytes, a colon and its value."""

    def cell(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(cell, fields)), 256)


def height_of(n: Column) -> Column:
    """Levels above ``n`` leaves, exactly: the digits in base 8 of the last leaf's rank (none for a lone leaf)."""
    bits = F.length(F.bin(n - 1))
    return F.when(n <= 1, 0).otherwise(F.ceil(bits / 3)).cast("int")


def _raised(nodes: DataFrame, base: int, levels: int, path: str) -> DataFrame:
    """Writes the records above ``nodes`` (``branch``, ``at``, ``left`` nodes in the branch, ``digest``); the last node of each branch."""
    tops = []
    for height in range(base + 1, base + levels + 1):
        tops.append(nodes.where("left = 1"))
        runs = nodes.where("left > 1").groupBy("branch", F.shiftright("at", 3).alias("at"))
        runs = runs.agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("i"), "digest")))["digest"].alias("children"), F.first("left").alias("left"))
        runs = runs.select("branch", "at", F.ceil(F.col("left") / FANOUT).cast("long").alias("left"), F.sha2(F.concat_ws("", "children"), 256).alias("digest"), "children")
        runs = written(runs, "merkle-level")
        records = runs.groupBy("digest").agg(F.first("children").alias("children"), F.count("*").alias("n"))
        records.write.parquet(f"{path}/records/height={height}")
        nodes = runs.drop("children")
    out = nodes.where("left = 1")
    for top in tops:
        out = out.unionByName(top)
    return out.select("branch", "digest")


def write_manifest(docs: DataFrame, path: str, group_col: str = "lang", id_col: str = "doc_id", fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = ()) -> None:
    """Writes the store to ``path``: ``leaves`` (with the columns ``carry`` of the rows), ``branches`` (a row a group) and ``records``."""
    own = [F.col(c).alias(f"carry_{c}") for c in carry]
    rows = docs.select(F.col(group_col).alias("branch_key"), F.col(id_col).alias("id"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), *own)
    placed = numbered(written(rows, "leaf-digests"), ["branch_key", "id", "leaf"], "at")
    placed = written(placed.withColumn("name", F.coalesce(F.concat(F.lit("="), F.col("branch_key").cast("string")), F.lit("-"))), "placed-leaves")
    groups = placed.groupBy("branch_key", "name").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    groups = written(numbered(written(groups, "groups"), ["branch_key"], "branch"), "numbered-groups")
    size = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("groups"))
    size = size.select("rows", "groups", height_of(F.col("most")).alias("height"), height_of(F.col("groups")).alias("trunk")).first()
    known = join_per_key(placed, groups.select("name", "branch", "first", "n"), "name", size["rows"])
    known.select("branch_key", "id", "leaf", *[f"carry_{c}" for c in carry], "branch", (F.col("at") - F.col("first")).alias("rank"), F.col("n").alias("left")).write.parquet(f"{path}/leaves")
    leaves = docs.sparkSession.read.parquet(f"{path}/leaves")
    subroots = _raised(leaves.select("branch", F.col("rank").alias("at"), "left", F.col("leaf").alias("digest")), 0, size["height"], path)
    branches = groups.select("branch", "branch_key", height_of(F.col("n")).alias("height")).join(subroots.withColumnRenamed("digest", "subroot"), "branch")
    branches.write.parquet(f"{path}/branches")
    trunk = docs.sparkSession.read.parquet(f"{path}/branches").select(F.lit(0).cast("long").alias("branch"), F.col("branch").alias("at"), F.lit(size["groups"]).alias("left"), F.col("subroot").alias("digest"))
    _raised(trunk, TRUNK, size["trunk"], path).select("digest").write.parquet(f"{path}/root")


def _segment(children: Column, i: Column) -> Column:
    """The children before and after the followed one, each as one string."""
    before = F.concat_ws("", F.slice(children, 1, i))
    return F.struct(before.alias("before"), F.concat_ws("", F.slice(children, i + 2, F.lit(FANOUT))).alias("after"))


def _descended(nodes: DataFrame, records: DataFrame, total: int) -> DataFrame:
    """Each node's children in its place, with one more segment on the way there.  ``nodes``: ``at``, ``digest``, ``way`` and others."""
    found = join_per_key(nodes, records, "digest", total).drop("n")
    others = [c for c in nodes.columns if c not in ("at", "digest", "way")]
    each = found.select(*others, "at", "way", "children", F.posexplode("children").alias("i", "digest"))
    return each.select(*others, (F.col("at") * FANOUT + F.col("i")).alias("at"), "digest", F.concat("way", F.array(_segment(F.col("children"), F.col("i")))).alias("way"))


def prove(spark: SparkSession, path: str, requests: DataFrame | None = None) -> DataFrame:
    """A row for each wanted leaf: group, id, ``leaf``, ``subroot``, ``root``, carried columns and ``path``, the segments from leaf to root.

    ``requests``: ``branch`` and ``rank`` of the wanted leaves (repeats allowed, each proved once); None: all leaves.
    """
    leaves = spark.read.parquet(f"{path}/leaves")
    wanted = leaves if requests is None else leaves.join(requests.select("branch", "rank").distinct(), ["branch", "rank"], "left_semi")
    branches = spark.read.parquet(f"{path}/branches")
    total = leaves.count()
    heights = branches.agg(F.coalesce(F.max("height"), F.lit(0)), height_of(F.count("*"))).first()
    records = lambda height: spark.read.parquet(f"{path}/records/height={height}")
    asked = lambda nodes, keys: nodes if requests is None else nodes.join(keys, keys.columns, "left_semi")
    segment = "array<struct<before:string,after:string>>"
    down = spark.read.parquet(f"{path}/root").select(F.col("digest").alias("root"), F.lit(0).cast("long").alias("at"), "digest", F.array().cast(segment).alias("way"))
    for height in range(heights[1], 0, -1):
        down = asked(_descended(down, records(TRUNK + height), total), wanted.select(F.shiftright("branch", 3 * (height - 1)).alias("at")).distinct())
    # at the bottom of the trunk a place is a branch and its digest is a subroot
    entry = down.select("root", F.col("at").alias("branch"), F.col("digest").alias("subroot"), "digest", F.lit(0).cast("long").alias("at"), "way").join(branches.select("branch", "height"), "branch")
    entry = written(entry, "merkle-branches")
    inside = None
    for height in range(heights[0], 0, -1):
        here = entry.where(F.col("height") == height).drop("height")
        inside = here if inside is None else inside.unionByName(here)
        if height > 1:
            keys = wanted.select("branch", F.shiftright("rank", 3 * (height - 1)).alias("at")).distinct()
            inside = written(asked(_descended(inside, records(height), total), keys), "merkle-way")
    lone = wanted.where("left = 1").join(entry.where("height = 0").select("branch", "root", "subroot", "way"), "branch")
    if inside is not None:
        # eight leaves share the way to their parent, so the ways are dealt by parents
        parents = join_per_key(inside, records(1), "digest", total).select("root", "branch", "subroot", F.col("at").alias("parent"), "way", "children")
        last = wanted.withColumn("parent", F.shiftright("rank", 3)).join(parents, ["branch", "parent"])
        i = F.col("rank").bitwiseAND(FANOUT - 1).cast("int")
        lone = lone.unionByName(last.withColumn("way", F.concat("way", F.array(_segment(F.col("children"), i)))).select(*lone.columns))
    return lone.withColumn("path", F.reverse("way")).drop("way", "left")


def proof_digest(path: Column) -> Column:
    """SHA-256 of a path's siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf has under a path."""
    return F.aggregate(path, leaf, lambda digest, s: F.sha2(F.concat(s["before"], digest, s["after"]), 256))
