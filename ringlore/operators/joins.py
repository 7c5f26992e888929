"""Joins by interval, by date, by pair, and by neighbourhood."""

from __future__ import annotations

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import months_before
from ..functions.shuffles import as_of
from ..plans.league import League


def bouts_in_stints(w: League) -> DataFrame:
    """JOIN08: counted bouts within [start, end) of a fighter's stints; open bounds are unbounded."""
    b = w.counted.select("boxer_id", "bout_id", "date", "result", "pre", "post")
    s = w.stints
    inside = (F.coalesce(F.col("date") >= F.col("start"), F.lit(True))) & (F.coalesce(F.col("date") < F.col("end"), F.lit(True)))
    return b.join(s, "boxer_id").where(inside & (F.col("start").isNotNull() | F.col("end").isNotNull()))


def head_trainer(w: League, start_required: bool = False) -> DataFrame:
    """JOIN09, JOIN10: each counted bout's first stint, by start and person, that covers its date."""
    x = bouts_in_stints(w)
    x = x.where("start IS NOT NULL") if start_required else x
    return x.groupBy("bout_id", "boxer_id").agg(F.min_by("person_id", F.struct("start", "person_id")).alias("trainer_id"))


def rating_on(w: League, day: dt.date) -> DataFrame:
    """The rating of every fighter at the end of one day, 1500 before any bout: one aggregate, since the day is the same for all."""
    return ratings_around(w, day).select("boxer_id", F.col("after").alias("rating"))


def ratings_around(w: League, day: dt.date) -> DataFrame:
    """The ratings of every fighter ``before`` one day and ``after`` it, 1500 before any bout: one aggregate."""
    x = w.counted.where(F.col("date") <= F.lit(day))
    earlier, order = F.when(F.col("date") < F.lit(day), F.struct("date", "bout_id")), F.struct("date", "bout_id")
    got = x.groupBy("boxer_id").agg(F.max_by("post", earlier).alias("before"), F.max_by("post", order).alias("after"))
    start = lambda c: F.coalesce(c, F.lit(1500.0)).alias(c)
    return w.fighters.select("boxer_id").join(got, "boxer_id", "left").select("boxer_id", start("before"), start("after"))


def rating_at(w: League, rows: DataFrame, strict: bool = False) -> DataFrame:
    """JOIN11, JOIN12: ``rows`` (``boxer_id``, ``date`` and others) with each one's ``rating`` on its own day, 1500 before any bout.

    A bout on that day counts unless ``strict``; of several on one day the last by id.
    """
    after = w.counted.select("boxer_id", "date", "bout_id", F.col("post").alias("rating"))
    return as_of(rows, after, "boxer_id", "date", ["rating"], strict, ties=["bout_id"]).withColumn("rating", F.coalesce("rating", F.lit(1500.0)))


def stint_start_ratings(w: League) -> DataFrame:
    """JOIN11: ratings at the start of stints."""
    starts = w.stints.where("start IS NOT NULL").select("boxer_id", "person_id", F.col("start").alias("date"))
    return rating_at(w, starts)


def ratings_going_in(w: League) -> DataFrame:
    """JOIN12: ratings before the day of each bout, of its red corner."""
    return rating_at(w, w.bouts.select("bout_id", F.col("red_id").alias("boxer_id"), "date"), strict=True).select("bout_id", "boxer_id", "rating")


def head_to_head(w: League) -> DataFrame:
    """JOIN06: pairs that met three times or more, with the record of the one of smaller id."""
    a, b = F.least("red_id", "blue_id").alias("a_id"), F.greatest("red_id", "blue_id").alias("b_id")
    x = w.decided.select(a, b, "winner_id").groupBy("a_id", "b_id")
    out = x.agg(F.count("*").alias("met"), F.sum(F.when(F.col("winner_id") == F.col("a_id"), 1).otherwise(0)).cast("long").alias("a_won"), F.sum(F.when(F.col("winner_id") == F.col("b_id"), 1).otherwise(0)).cast("long").alias("b_won"))
    return out.where("met >= 3")


def common_opponents(w: League, a: int, b: int) -> DataFrame:
    """JOIN07, SET04: opponents of both fighters, other than themselves, with each one's results against them."""
    of = lambda i, n: w.counted.where(F.col("boxer_id") == i).groupBy("opp_id").agg(F.count("*").alias(f"{n}_met"), F.sum(F.when(F.col("result") == "W", 1).otherwise(0)).cast("long").alias(f"{n}_won"))
    return of(a, "a").join(of(b, "b"), "opp_id").where(~F.col("opp_id").isin(a, b))


def top_pairs(w: League, division: str = "BUILDING", sex: str = "male", top: int = 8) -> DataFrame:
    """JOIN14: all pairs among the first ``top`` of a ranking: a self-join of ``top`` rows."""
    from .rankings import division_ranking

    r = division_ranking(w).where((F.col("division") == division) & (F.col("sex") == sex) & (F.col("rank") <= top)).select("boxer_id", "rank", "rating")
    a, b = r.alias("a"), r.alias("b")
    x = a.join(b, F.col("a.rank") < F.col("b.rank"))
    return x.select(F.col("a.boxer_id").alias("a_id"), F.col("b.boxer_id").alias("b_id"), F.abs(F.col("a.rating") - F.col("b.rating")).alias("gap"))


def candidates(w: League, boxer_id: int, gap: float = 100, free_days: int = 14) -> DataFrame:
    """JOIN15: possible opponents: same pool, near in rating, four bouts or more, not met or booked before, and free for ``free_days``."""
    c = w.careers.select("boxer_id", "division", "sex", "rating", "bouts", "active")
    me = F.broadcast(c.where(F.col("boxer_id") == boxer_id).select("division", "sex", F.col("rating").alias("own")))
    met = w.long.where(F.col("boxer_id") == boxer_id).select(F.col("opp_id").alias("boxer_id"))
    booked = w.long.where(F.col("upcoming") & (F.datediff("date", F.lit(w.as_of)) <= free_days)).select("boxer_id")
    x = c.where((F.col("boxer_id") != boxer_id) & (F.col("bouts") >= 4) & F.col("active")).join(me, ["division", "sex"])
    x = x.where(F.abs(F.col("rating") - F.col("own")) <= gap).join(met, "boxer_id", "left_anti").join(booked, "boxer_id", "left_anti")
    return x.select("boxer_id", F.abs(F.col("rating") - F.col("own")).alias("gap"))


def missed_and_won(w: League) -> DataFrame:
    """JOIN04, FLT16: fighters who were over the limit at least once."""
    return w.fighters.join(w.weigh_ins.where("made = false"), "boxer_id", "left_semi").select("boxer_id", "name")


def without_bout(w: League) -> DataFrame:
    """JOIN05: fighters of no bout, and cards without one."""
    # whoever fights is counted once before it is shuffled
    fought = w.bouts.select(F.explode(F.array("red_id", "blue_id")).alias("boxer_id")).distinct()
    f = w.fighters.join(fought, "boxer_id", "left_anti").select(F.lit("fighter").alias("kind"), F.col("boxer_id").alias("id"))
    e = w.events.join(w.bouts.select("event_id").distinct(), "event_id", "left_anti").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    return f.unionByName(e)


#: rows of either side that are held against each other at a time
CELL, ASKING_TILE, POOL_TILE = 20_000, 64, 256


def _tiles(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers in tiles of at most ``most``, split at the median of the widest dimension."""
    open_, out = [np.arange(len(x))], []
    while open_:
        rows = open_.pop()
        if len(rows) <= most:
            out += [rows] if len(rows) else []
            continue
        own = x[rows]
        by, half = int(np.argmax(own.max(0) - own.min(0))), len(rows) // 2
        order = np.argpartition(own[:, by], half)
        open_ += [rows[order[:half]], rows[order[half:]]]
    return out


def _nine_places(d: np.ndarray) -> np.ndarray:
    """Billionths, rounded as Spark rounds a double's decimal digits."""
    scaled = d * 1e9
    whole = np.floor(scaled)
    out, unsure = (whole + (scaled - whole >= 0.5)).astype(np.int64), np.abs(scaled - whole - 0.5) < 1e-4
    out[unsure] = [int(Decimal(repr(float(v))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP)) for v in d[unsure]]
    return out


def _vectors(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(f"v{i}").to_numpy() for i in range(6)], 1)


def _nearest(asking: pa.Table, pool: pa.Table, k: int) -> pa.Table:
    """Of each asking row the ``k`` nearest of the pool but itself, ties to smaller ids.  Tiles of the pool that are too far for a whole tile of those who ask are passed over."""
    ask, ask_ids, all_, ids = _vectors(asking), asking.column("of_id").to_numpy(), _vectors(pool), pool.column("boxer_id").to_numpy()
    tiles = _tiles(all_, POOL_TILE)
    low, high = (np.array([f(all_[t], axis=0) for t in tiles]).reshape(-1, 6) for f in (np.min, np.max))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for rows in _tiles(ask, ASKING_TILE) if tiles else []:
        u, own = ask[rows], ask_ids[rows]
        best, who = np.full((len(rows), k), np.iinfo(np.int64).max), np.full((len(rows), k), np.iinfo(np.int64).max)
        apart = np.sqrt((np.maximum(0.0, np.maximum(low - u.max(0), u.min(0) - high)) ** 2).sum(1))
        for t in np.argsort(apart):
            if apart[t] * 1e9 - 2 > best[:, -1].max():
                break
            v, d = all_[tiles[t]], np.zeros((len(rows), len(tiles[t])))
            for i in range(6):
                d += (v[None, :, i] - u[:, None, i]) ** 2
            d = np.sqrt(d)
            i, j = np.nonzero((d * 1e9 <= best[:, -1:] + 2.0) & (ids[tiles[t]][None, :] != own[:, None]))
            if not len(i):
                continue
            n = np.concatenate([i, np.repeat(np.arange(len(rows)), k)])
            far, name = np.concatenate([_nine_places(d[i, j]), best.ravel()]), np.concatenate([ids[tiles[t]][j], who.ravel()])
            order = np.lexsort((name, far, n))
            starts = np.searchsorted(n[order], np.arange(len(rows)))
            first = order[starts[:, None] + np.arange(k)]
            best, who = far[first], name[first]
        found = best < np.iinfo(np.int64).max
        out.append((np.repeat(own, k)[found.ravel()], who[found], best[found] / 1e9))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    return pa.table(dict(zip(("of_id", "boxer_id", "d"), columns)))


def similar_fighters(w: League, asking: Column, k: int = 5, cell: int = CELL) -> DataFrame:
    """JOIN16, MDL26: nearest styles of the ``asking`` fighters within their sex, by a six-number vector; match = max(0, round(100 - 38 d)).

    Everyone asked about is held against the whole pool, in cells: a block of the pool meets a block of those who ask (``cell`` rows of either, about), a
    cell leaves ``k`` nearest of each who asks, and only those are shuffled and ranked.
    """
    c = w.careers.where("bouts >= 5")
    dims = [F.col("ko_rate"), F.col("win_rate"), F.coalesce((F.col("age") - 30) / 8, F.lit(0.0)), F.col("avg_rounds") / 12, F.when(F.col("stance") == "Southpaw", 1.0).otherwise(0.0), (F.col("rating") - 1500) / 200]
    v = c.select("boxer_id", "sex", *[d.cast("double").alias(f"v{i}") for i, d in enumerate(dims)])
    blocks, askers = (max(1, -(-n // cell)) for n in (v.count(), v.where(asking).count()))
    dealt = lambda n: F.pmod(F.xxhash64("boxer_id"), F.lit(n)).cast("int")
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    values = [f"v{i}" for i in range(6)]
    pool = v.select("boxer_id", "sex", *values, dealt(blocks).alias("block"), across(askers).alias("asker"))
    ask = v.where(asking).select(F.col("boxer_id").alias("of_id"), "sex", *values, dealt(askers).alias("asker"), across(blocks).alias("block"))
    keys = ["sex", "block", "asker"]
    x = ask.groupBy(*keys).cogroup(pool.groupBy(*keys)).applyInArrow(lambda a, b: _nearest(a, b, k), "of_id long, boxer_id long, d double")
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("of_id").orderBy("d", "boxer_id"))).where(F.col("rank") <= k)
    return x.select("of_id", "rank", "boxer_id", F.greatest(F.lit(0), F.floor(100 - 38 * F.col("d") + 0.5)).cast("long").alias("match"))


def switched_trainers(w: League, months: float = 90) -> DataFrame:
    """WIN13: changes of trainer since ``months`` ago, with the one before."""
    own = Window.partitionBy("boxer_id").orderBy("start")
    x = w.stints.withColumn("before_id", F.lag("person_id").over(own)).where(F.col("before_id").isNotNull() & (F.col("before_id") != F.col("person_id")))
    return x.where((F.col("start") >= F.lit(months_before(w.as_of, months))) & (F.col("start") <= F.lit(w.as_of))).select("boxer_id", "start", "person_id", "before_id")
