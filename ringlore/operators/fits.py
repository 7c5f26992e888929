"""The win model and the finish estimate fitted to past bouts: data, regression, choice of terms, comparison."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, is_stoppage
from ..plans.league import League
from ..storage import written
from .careers import ORDER
from .models import sigmoid

TERMS = ["elo", "reach", "age", "idle", "ko", "chin", "exp", "rehyd", "weight_edge", "new_trainer", "trainer_wins"]
FINISH_TERMS = ["ko_sum", "chin_sum", "mismatch", "idle_sum"]
#: what a model must gain in held-out log-loss over a simpler one, and the least ``|weight / error|`` of a term that stays
MIN_GAIN, LEAST_Z, LEAST_ROWS = 0.002, 2.0, 400


def going_in(w: League, *more: Column) -> DataFrame:
    """MDL12: of each counted bout and fighter who has fought before, what their own bouts told before it, and what ``more`` of :meth:`League.turns` is; by fighter, in order."""
    own = Window.partitionBy("boxer_id").orderBy(*ORDER)
    x = w.turns(*more).where("result IS NOT NULL")
    stop = is_stoppage(F.col("method"))
    upto = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.select(
        *[c for c in x.columns if c not in ("method", "opp_id", "post")], stop.alias("stopped"), (F.row_number().over(own) - 1).alias("bouts_before"),
        upto(F.col("result") == "W").alias("wins_before"), upto((F.col("result") == "W") & stop).alias("kos_before"), upto((F.col("result") == "L") & stop).alias("ko_losses_before"),
        F.datediff("date", F.lag("date").over(own)).alias("days_idle"),
    )


def own_terms() -> dict[str, Column]:
    """The terms that :func:`going_in` tells."""
    rate = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return {
        "elo": F.col("pre") / 100, "idle": F.coalesce(F.least(F.lit(36.0), F.col("days_idle") / 30.4), F.lit(12.0)),
        "ko": rate("kos_before", "wins_before"), "chin": rate("ko_losses_before", "bouts_before"),
    }


def with_trainers(w: League, x: DataFrame) -> DataFrame:
    """Adds to rows by fighter ``head_start`` and ``head_id``, the first stint that covers the day, and ``trainer_wins``, the share won of the trainer's earlier bouts from eight on, else a half."""
    s = w.stints.where("start IS NOT NULL OR end IS NOT NULL").groupBy("boxer_id").agg(F.collect_list(F.struct("start", "person_id", "end")).alias("stints"))
    covers = lambda s: F.coalesce(F.col("date") >= s["start"], F.lit(True)) & F.coalesce(F.col("date") < s["end"], F.lit(True))
    head = F.array_min(F.transform(F.filter("stints", covers), lambda s: F.struct(s["start"].alias("start"), s["person_id"].alias("person_id"))))
    x = x.join(s, "boxer_id", "left").withColumn("head", head).drop("stints")
    # rows without a trainer are dealt by bout
    x = x.withColumns({"head_start": F.col("head.start"), "head_id": F.col("head.person_id")}).withColumn("alone", F.when(F.col("head_id").isNull(), F.col("bout_id"))).drop("head")
    own = Window.partitionBy("head_id", "alone").orderBy("date", "bout_id")
    led = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumns({"led": led(F.col("result") != "D"), "led_won": led(F.col("result") == "W"), "same": F.coalesce(F.lag("bout_id").over(own) == F.col("bout_id"), F.lit(False))})
    # both corners of one bout count after it
    x = x.withColumns({c: F.when(F.col("same"), F.lag(c).over(own)).otherwise(F.col(c)) for c in ("led", "led_won")})
    return x.withColumn("trainer_wins", F.when(F.col("head_id").isNotNull() & (F.col("led") >= 8), F.col("led_won") / F.col("led")).otherwise(0.5)).drop("alone", "led", "led_won", "same")


def corner_pairs(x: DataFrame, shared: list[str], terms: list[str]) -> DataFrame:
    """A row for each bout of which ``x`` has both corners: ``shared`` columns as the red corner has them and ``red_`` and ``blue_`` ``terms``; by one shuffle."""
    side = lambda red, c: F.max(F.when(F.col("red") == red, F.col(c)))
    each = [side(s == "red", c).alias(f"{s}_{c}") for s in ("red", "blue") for c in terms]
    g = x.select("bout_id", "red", *shared, *terms).repartition("bout_id").groupBy("bout_id").agg(F.count_if("red").alias("_red"), F.count_if(~F.col("red")).alias("_blue"), *[side(True, c).alias(c) for c in shared], *each)
    return g.where("_red > 0 AND _blue > 0").drop("_red", "_blue")


def win_rows(w: League) -> DataFrame:
    """MDL12: a row per decisive bout: red less blue in each of the eleven terms, unknown on either side 0, bouts of odd ids turned round."""
    _, official, night, _ = w.weights(F.col("red"))
    weighed = lambda c: F.when(~F.col("cancelled"), c)
    x = going_in(w, weighed(night).alias("weight_edge"), weighed(night - official).alias("gain"))
    before = Window.partitionBy("boxer_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("rehyd", F.coalesce(F.avg("gain").over(before), F.lit(0.0))).drop("gain")
    # a trainer's bouts are counted before any row is left out
    x = with_trainers(w, x.join(w.fighters.select("boxer_id", "reach_cm", "birth_year"), "boxer_id"))
    x = x.where("bouts_before >= 1").withColumns(own_terms()).withColumns(
        {
            "reach": F.col("reach_cm").cast("double"), "age": (F.year("date") - F.col("birth_year")).cast("double"), "exp": F.log1p("bouts_before"),
            "new_trainer": F.when(F.datediff("date", "head_start") / 30.4 < 6, 1.0).otherwise(0.0), "won": (F.col("result") == "W").cast("int"), "decisive": F.col("result") != "D",
        }
    )
    turned = F.col("bout_id") % 2 == 1
    apart = lambda c: F.coalesce(F.col(f"red_{c}") - F.col(f"blue_{c}"), F.lit(0.0))
    y = (F.col("won") == 1) != turned
    return corner_pairs(x.where("decisive"), ["date", "won"], TERMS).select("bout_id", "date", y.cast("int").alias("y"), *[(F.when(turned, -1.0).otherwise(1.0) * apart(c)).alias(c) for c in TERMS])


def finish_rows(w: League) -> DataFrame:
    """MDL16: a row per counted bout: both corners' finishing and being finished together, how far apart they are, how long both were idle; whether it ended early.

    Own bouts alone tell these terms; trainers and weights are not asked for.
    """
    both = lambda c: F.col(f"red_{c}") + F.col(f"blue_{c}")
    x = going_in(w).where("bouts_before >= 1").withColumns(own_terms()).withColumn("y", F.col("stopped").cast("int"))
    return corner_pairs(x, ["date", "y"], ["elo", "ko", "chin", "idle"]).select("bout_id", "date", "y", both("ko").alias("ko_sum"), both("chin").alias("chin_sum"), F.abs(F.col("red_elo") - F.col("blue_elo")).alias("mismatch"), both("idle").alias("idle_sum"))


class Fit(NamedTuple):
    """Weights in the terms' own units, their standard errors, and the intercept."""

    intercept: float
    weights: dict[str, float]
    errors: dict[str, float]

    def chance(self) -> Column:
        return sigmoid(sum((F.lit(v) * F.col(c) for c, v in self.weights.items()), F.lit(self.intercept)))

    def z(self, term: str) -> float:
        return self.weights[term] / (self.errors[term] or 1.0)


def logistic(rows: DataFrame, terms: list[str], penalty: float = 1.0, rounds: int = 30, tolerance: float = 1e-7) -> Fit:
    """MDL13: ridge logistic regression on terms standardised by mean and population deviation, by Newton steps; the intercept is free.

    Each step sums gradient and Hessian, a few dozen numbers, in one pass over the rows; the driver solves.
    """
    m = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(terms)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(terms)]).first()
    mean, sd = [m[f"m{i}"] or 0.0 for i in range(len(terms))], [m[f"s{i}"] or 1.0 for i in range(len(terms))]
    cols = [F.lit(1.0), *[(F.col(c) - F.lit(a)) / F.lit(s) for c, a, s in zip(terms, mean, sd)]]
    k, pairs = len(cols), [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    beta = np.zeros(k)
    for _ in range(rounds):
        p = sigmoid(clamp(sum((float(b) * c for b, c in zip(beta, cols)), F.lit(0.0)), -30.0, 30.0))
        x = rows.select("y", p.alias("p"), *[c.alias(f"c{i}") for i, c in enumerate(cols)])
        s = x.agg(*[F.sum((F.col("p") - F.col("y")) * F.col(f"c{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        g, h = np.array([s[f"g{i}"] or 0.0 for i in range(k)]), np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = s[f"h{i}_{j}"] or 0.0
        g[1:] += penalty * beta[1:]
        h[1:, 1:] += penalty * np.eye(k - 1)
        step = np.linalg.solve(h + 1e-12 * np.eye(k), g)
        beta = beta - step
        if np.linalg.norm(step) < tolerance:
            break
    error = np.sqrt(np.diag(np.linalg.inv(h + 1e-12 * np.eye(k))))
    weights = {c: float(b / s) for c, b, s in zip(terms, beta[1:], sd)}
    return Fit(float(beta[0] - sum(weights[c] * a for c, a in zip(terms, mean))), weights, {c: float(e / s) for c, e, s in zip(terms, error[1:], sd)})


def loss(rows: DataFrame, chances: dict[str, Column]) -> dict[str, tuple[float, float, float]]:
    """MDL14: log-loss, Brier score and accuracy of each named chance over the rows."""
    out = []
    for name, p in chances.items():
        q = clamp(p, 1e-6, 1 - 1e-6)
        y = F.col("y")
        out += [F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias(f"{name}_l"), F.avg((q - y) * (q - y)).alias(f"{name}_b"), F.avg(F.when((q >= 0.5).cast("int") == y, 1.0).otherwise(0.0)).alias(f"{name}_a")]
    r = rows.agg(*out).first()
    return {n: (r[f"{n}_l"], r[f"{n}_b"], r[f"{n}_a"]) for n in chances}


def halves(rows: DataFrame, share: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """The earlier and the later rows by date and id; the cut is found from counts by day, and only its day is ranked."""
    days = rows.groupBy("date").agg(F.count("*").alias("n"))
    cut = int(rows.count() * share)
    upto = days.withColumn("upto", F.sum("n").over(Window.orderBy("date")))  # a row for each day
    day = upto.where(F.col("upto") >= cut).orderBy("date").first()
    left = cut - (day["upto"] - day["n"])
    last = rows.where(F.col("date") == F.lit(day["date"])).orderBy("bout_id").limit(left).select("bout_id")
    early = rows.where(F.col("date") < F.lit(day["date"])).unionByName(rows.where(F.col("date") == F.lit(day["date"])).join(last, "bout_id", "left_semi").select(rows.columns))
    late = rows.where(F.col("date") > F.lit(day["date"])).unionByName(rows.where(F.col("date") == F.lit(day["date"])).join(last, "bout_id", "left_anti").select(rows.columns))
    return early, late


def simplest(losses: list[tuple[str, float]], least: float = MIN_GAIN) -> str:
    """MDL15: of models from the plainest on, the last that gains ``least`` over the one chosen before it."""
    name, best = losses[0]
    for other, value in losses[1:]:
        if value < best - least:
            name, best = other, value
    return name


def win_fit(w: League) -> DataFrame:
    """MDL12 to MDL15: each term's weight, error and whether it stays (rating always, others from ``LEAST_Z`` on), and the losses of four models on the later quarter."""
    rows = written(win_rows(w), "win-rows")
    if rows.count() < LEAST_ROWS:
        return w.spark.createDataFrame([], "model string, term string, weight double, error double, kept boolean")
    train, test = halves(rows)
    full, own = logistic(train, TERMS), logistic(train, TERMS[:1])
    kept = [t for t in TERMS if t == TERMS[0] or abs(full.z(t)) >= LEAST_Z]
    few = logistic(train, kept)
    got = loss(test, {"plain": sigmoid(F.col("elo") * float(np.log(10) / 4)), "rating": own.chance(), "selected": few.chance(), "all": full.chance()})
    best = simplest([(n, got[n][0]) for n in got])
    out = [("all", t, full.weights[t], full.errors[t], t in kept) for t in TERMS] + [("selected", t, few.weights[t], few.errors[t], True) for t in kept]
    out += [(n, "log-loss", v[0], None, n == best) for n, v in got.items()]
    return w.spark.createDataFrame(out, "model string, term string, weight double, error double, kept boolean")


def finish_fit(w: League) -> DataFrame:
    """MDL16: the chance of an early end, fitted and by the hand-set rule; the fit is taken where it gains ``MIN_GAIN`` on the later quarter."""
    rows = written(finish_rows(w), "finish-rows")
    if rows.count() < LEAST_ROWS:
        return w.spark.createDataFrame([], "model string, term string, weight double, error double, kept boolean")
    train, test = halves(rows)
    full = logistic(train, FINISH_TERMS)
    kept = [t for t in FINISH_TERMS if abs(full.z(t)) >= LEAST_Z]
    few = logistic(train, kept) if kept else Fit(float(np.log((b := train.agg(F.avg("y")).first()[0]) / (1 - b))), {}, {})
    rule = clamp(0.22 + 0.35 * F.col("ko_sum") + 0.2 * F.col("chin_sum"), 0.1, 0.85)
    got = loss(test, {"rule": rule, "fitted": clamp(few.chance(), 0.03, 0.95)})
    best = simplest([(n, got[n][0]) for n in got])
    out = [("all", t, full.weights[t], full.errors[t], t in kept) for t in FINISH_TERMS] + [(n, "log-loss", v[0], None, n == best) for n, v in got.items()]
    return w.spark.createDataFrame(out, "model string, term string, weight double, error double, kept boolean")
