"""What SQL can't say, against plain Python: replay, fixpoints, fits, projections, fuzzy words, capped draws."""

import datetime as dt
import math
import random
import re
from collections import Counter
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ringlore import oracle
from ringlore.functions import shuffles
from ringlore.operators import agreement, checks, fits, joins, linkage, mentions, merging, models, reviews, search, stories, trainers
from ringlore.operators.validation import Feed, validated, validated_money
from ringlore.plans.league import League, league
from ringlore.sources import star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return league(spark, SF)


BOUT = "bout_id long, date date, division string, sex string, red_id long, blue_id long, method string, winner_id long"


def small(spark, rows):
    bouts = spark.createDataFrame(rows, BOUT)
    return SimpleNamespace(spark=spark, bouts=bouts, decided=bouts.where("method IS NOT NULL AND method <> 'NC'"))


def replay(rows, k=24.0, bonus=1.15):
    rating, out = {}, {}
    for bout, _, _, _, red, blue, method, winner in sorted(rows, key=lambda r: (r[1], r[0])):
        p, q = rating.get(red, 1500.0), rating.get(blue, 1500.0)
        score = None if method in (None, "NC") else 0.5 if winner is None else float(winner == red)
        d = 0.0 if score is None else k * (bonus if method in ("KO", "TKO", "RTD") else 1) * (score - 1 / (1 + 10 ** ((q - p) / 400)))
        rating[red], rating[blue] = p + d, q - d
        out[bout] = (p, q, d)
    return out


def test_elo_goes_with_a_fighter_to_another_class(spark):
    r, rows = random.Random(4), []
    for i in range(400):
        a, b = r.sample(range(12), 2) if i % 3 else r.sample(range(20, 30), 2)
        method = r.choice(["KO", "UD", "DRAW", "NC", None])
        rows.append((i, dt.date(2000, 1, 1) + dt.timedelta(days=r.randrange(90)), "light" if i % 2 else "heavy", "male", a, b, method, None if method in ("DRAW", "NC", None) else r.choice([a, b])))
    w = small(spark, rows)
    got = {x.bout_id: (x.red_pre, x.blue_pre, x.red_change) for x in models.elo_ratings(w).collect()}
    want = replay(rows)
    assert got.keys() == want.keys() and all(np.allclose(got[i], want[i]) for i in want)
    # the first bout of a class is not from the start for those who come from the other one
    first = min((x for x in rows if x[2] == "light" and x[4] < 12), key=lambda x: (x[1], x[0]))
    assert any(got[x[0]][0] != 1500.0 for x in rows if x[2] == first[2])
    assert {x.bout_id for x in models.elo(w).collect()} == {x[0] for x in rows if x[6] not in ("NC", None)}
    assert models.elo_ratings(small(spark, [])).count() == 0


def test_league_with_its_own_ratings(spark):
    """By default the league is rated by replay, and careers, rankings and calls follow."""
    own = League(spark, SF)
    e = {(x.bout_id, x.red): x.pre for x in own.ratings.select("bout_id", F.lit(True).alias("red"), F.col("red_pre").alias("pre")).union(own.ratings.select("bout_id", F.lit(False), "blue_pre")).collect()}
    rows = own.long.select("bout_id", "side", "pre", "post", "result").collect()
    assert len(rows) == len(e) and all(x.pre == e[x.bout_id, x.side == "red"] for x in rows)
    assert all((x.post > x.pre) == (x.result == "W") for x in rows if x.result in ("W", "L"))
    best = own.careers.orderBy(F.desc("rating")).first()
    assert best.rating > 1500 and best.wins > best.losses


def test_components(w):
    pairs = [(x.boxer_id, x.opp_id) for x in w.counted.select("boxer_id", "opp_id").distinct().collect()]
    root = {i: i for p in pairs for i in p}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {x.boxer_id: x.label for x in merging.components(w).collect()} == {i: find(i) for i in root}


def test_core(w):
    met = {}
    for x in w.counted.select("boxer_id", "opp_id").distinct().collect():
        met.setdefault(x.boxer_id, set()).add(x.opp_id)
    core = {x.boxer_id for x in merging.reconciliation(w).where("verdict = 'complete'").collect()}
    while gone := {i for i in core if met.get(i, set()) - core}:
        core -= gone
    assert core and {x.boxer_id for x in merging.coherent_core(w).collect()} == core


def test_a_pass_of_trainer_impact_moves_no_observations(spark):
    """Values come by chunks, with gaps; nothing is shuffled to look them up, whatever Spark thinks of their size."""
    keys = [0, 3, 4095, 4096, (1 << 33) + 2, -1, -4097]
    values = spark.createDataFrame([(k, float(k % 97) / 9, 0.0) for k in keys], "key long, v double, moved double")
    rows = spark.createDataFrame([(a, b, t, u, 1, 1.0) for a in keys[:5] for b in keys[:5] for t, u in ((-1, None), (-4097, -1))], "own long, opp long, own_t long, opp_t long, n long, won double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        got = trainers._chances(rows, trainers._chunks(values), True)
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
        of = {k: float(k % 97) / 9 for k in keys} | {None: 0.0}
        got = got.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 50 and all(abs(x.p - 1 / (1 + math.exp(of[x.opp] + of[x.opp_t] - of[x.own] - of[x.own_t]))) < 1e-9 for x in got)


def test_trainer_impact(w):
    """A few passes over all bouts with a trainer on either side against the same steps in numpy, with errors, evidence and verdicts."""
    heads = {(x.bout_id, x.boxer_id): x.trainer_id for x in joins.head_trainer(w).collect()}
    rows = [(x, heads.get((x.bout_id, x.boxer_id)), heads.get((x.bout_id, x.opp_id))) for x in w.counted.where("side = 'red'").collect()]
    rows = [x for x in rows if x[1] is not None or x[2] is not None]
    assert any(None in x[1:] for x in rows)
    names = sorted({("f", x.boxer_id) for x, _, _ in rows} | {("f", x.opp_id) for x, _, _ in rows} | {("t", t) for _, a, b in rows for t in (a, b) if t is not None})
    at = {n: i for i, n in enumerate(names)} | {("t", None): len(names)}
    ends = np.array([[at["f", x.boxer_id], at["t", a], at["f", x.opp_id], at["t", b]] for x, a, b in rows])
    y = np.array([{"W": 1.0, "D": 0.5, "L": 0.0}[x.result] for x, _, _ in rows])
    penalty, v = np.array([0.05 if k == "f" else 8.0 for k, _ in names] + [1.0]), np.zeros(len(names) + 1)

    def chance():
        return 1 / (1 + np.exp(-(v[ends[:, 0]] + v[ends[:, 1]] - v[ends[:, 2]] - v[ends[:, 3]])))

    for _ in range(3):
        p = chance()
        g, h = np.zeros(len(v)), np.zeros(len(v))
        for j, sign in enumerate((1, 1, -1, -1)):
            np.add.at(g, ends[:, j], sign * (y - p))
            np.add.at(h, ends[:, j], p * (1 - p))
        v = v + 0.8 * (g - penalty * v) / (h + penalty)
        v[-1] = 0
    worked, info, bouts = {}, {}, {}
    for x, a, b in rows:
        for f, t in ((x.boxer_id, a), (x.opp_id, b)):
            if t is not None:
                worked.setdefault(f, set()).add(t)
    for (x, a, b), p in zip(rows, chance()):
        for f, t in ((x.boxer_id, a), (x.opp_id, b)):
            if t is not None:
                info[t] = info.get(t, 0.0) + p * (1 - p) * (len(worked[f]) > 1)
                bouts.setdefault(t, []).append(f)
    got = {x.trainer_id: x for x in trainers.trainer_impact(w, passes=3).collect()}
    assert got.keys() == info.keys()
    for t, x in got.items():
        points, error, n = v[at["t", t]] * 400 / np.log(10), 400 / np.log(10) / np.sqrt(info[t] + 8), int(np.floor(info[t] * 4 + 0.5))
        evidence = "strong" if n >= 40 else "some" if n >= 8 else "thin"
        side = "above" if points > 0 else "below"
        verdict = "unclear" if evidence == "thin" or abs(points) <= 1.28 * error else side if abs(points) > 1.96 * error else f"leaning {side}"
        assert abs(x.points - points) < 1e-6 and abs(x.error - error) < 1e-6
        assert (x.evidence, x.verdict, x.fights, x.informative, x.fighters) == (evidence, verdict, len(bouts[t]), n, len(set(bouts[t])))


def test_logistic(spark):
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (r.random(600) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.3, 0.0])))).astype(int)
    rows = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, a double, b double, c double")
    fit = fits.logistic(rows, ["a", "b", "c"])
    z = np.column_stack([np.ones(600), (x - x.mean(0)) / x.std(0)])
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-z @ beta))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([0, 1, 1, 1])
        beta -= np.linalg.solve(h, z.T @ (p - y) + [0, *beta[1:]])
    weights = beta[1:] / x.std(0)
    assert np.allclose([fit.weights[c] for c in "abc"], weights) and np.isclose(fit.intercept, beta[0] - weights @ x.mean(0))
    assert np.allclose([fit.errors[c] for c in "abc"], np.sqrt(np.diag(np.linalg.inv(h)))[1:] / x.std(0))
    assert abs(fit.z("a")) > 2 > abs(fit.z("c"))
    assert fits.simplest([("plain", 0.7), ("one", 0.699), ("two", 0.6), ("three", 0.599)]) == "two"


def test_halves(spark):
    rows = spark.createDataFrame([(i, dt.date(2000, 1, 1 + i // 7)) for i in range(40)], "bout_id long, date date")
    early, late = fits.halves(rows)
    assert [sorted(x.bout_id for x in part.collect()) for part in (early, late)] == [list(range(30)), list(range(30, 40))]


def test_fits_of_the_league(w):
    got = fits.win_fit(w).collect()
    assert [x.term for x in got if x.model == "all" and x.term != "log-loss"] == fits.TERMS and sum(x.kept for x in got if x.term == "log-loss") == 1
    assert all(0 < x.weight < 1 for x in got if x.term == "log-loss")
    assert {x.model for x in fits.finish_fit(w).collect() if x.term == "log-loss"} == {"rule", "fitted"}


def test_style_map(w):
    rows = {x.boxer_id: (x.x, x.y) for x in models.style_map(w).collect()}
    dims = ["ko_rate", "win_rate", "avg_rounds", "losses", "ko_losses", "bouts"]
    data = w.careers.where("bouts >= 5").select("boxer_id", *dims).toPandas().sort_values("boxer_id")
    x = data[dims].to_numpy(float)
    _, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    for i, axis in enumerate((axes[:, -1], axes[:, -2])):
        at = (x - x.mean(0)) @ axis
        at = (at - at.min()) / (at.max() - at.min())
        got = np.array([rows[b][i] for b in data.boxer_id])
        assert min(abs(got - at).max(), abs(got - (1 - at)).max()) < 1e-3


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_fuzzy_words(w):
    asked = ["smlal", "widgte", "anvli", "gizmoo", "gear", "rde", "blut"]
    words = {x for r in w.raw("part").select("p_name").collect() for x in r.p_name.lower().split(" ")}
    got = {(x.asked, x.word): x.distance for x in search.fuzzy_words(w, asked).collect()}
    want = {(a, b): osa(a, b) for a in asked for b in words if osa(a, b) <= search.allowed_slips(a)}
    assert got == want and want


def test_capped_draws(spark):
    r = random.Random(2)
    bouts = [(i, *r.sample(range(30), 2)) for i in range(200)]
    most = {i: r.randrange(4) for i in range(25)}
    used, want = {}, set()
    for i, a, b in bouts:
        if all(f not in most or used.get(f, 0) < most[f] for f in (a, b)):
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
        else:
            want.add(i)
    got = reviews.capped_draws(spark.createDataFrame(bouts, "bout_id long, red_id long, blue_id long"), spark.createDataFrame(list(most.items()), "boxer_id long, draws long"))
    assert {x.bout_id for x in got.collect()} == want and want


def far_apart(spark):
    """Bouts of fighters whose ratings lie far apart: each pair meets three times, an underdog wins the second and the third."""
    gaps = [0.0, 8.0, 2000.0, 6400.0, 6408.0, 300_000.0]
    rows = [(10 * g + n, dt.date(2000, 1, 1 + n), "BUILDING", "male", 2 * g, 2 * g + 1, "UD", 2 * g + (n > 0), 1500.0 + gap, 1500.0) for g, gap in enumerate(gaps) for n in range(3)]
    bouts = spark.createDataFrame(rows, BOUT + ", red_pre double, blue_pre double").withColumn("event_id", F.lit(1)).withColumn("cancelled", F.lit(False)).withColumn("end_round", F.lit(3)).withColumn("rounds", F.lit(3)).withColumn("round_time", F.lit("1:00"))
    bouts = bouts.withColumn("title", F.lit(None).cast("string")).withColumn("title_org", F.lit(0)).withColumn("title_vacant", F.lit(False))
    side = lambda a, b: bouts.withColumns({"boxer_id": F.col(f"{a}_id"), "opp_id": F.col(f"{b}_id"), "side": F.lit(a), "pre": F.col(f"{a}_pre"), "post": F.col(f"{a}_pre"), "opp_pre": F.col(f"{b}_pre"), "result": F.when(F.col("winner_id") == F.col(f"{a}_id"), "W").otherwise("L")})
    return SimpleNamespace(spark=spark, bouts=bouts, decided=bouts, counted=side("red", "blue").unionByName(side("blue", "red")))


def test_surprise_of_ratings_far_apart(spark):
    """MDL08, MDL10: the underdog's chance is not 1 less the favourite's, which is rounding or nothing; a surprise has a bound and is never null."""
    got = {x.bout_id: x.surprise for x in models.calls(far_apart(spark)).where("NOT right").collect()}
    assert all(got[b] == pytest.approx(-math.log2(max(1e-6, 1 / (1 + 10 ** (gap / 400))))) for b, gap in ((11, 8), (21, 2000), (31, 6400), (41, 6408)))
    assert got[51] == got[52] == pytest.approx(-math.log2(1e-6))


def test_log_loss_of_ratings_far_apart(spark):
    """MDL09: a winner's chance below rounding of 1 still counts as the chance it is."""
    w = far_apart(spark)
    low = {x.bout_id: x.low for x in models.rated_calls(w).collect()}
    assert low[31] == pytest.approx(1e-16, rel=1e-9) and low[41] < low[31] and low[51] == 0.0


def test_biggest_upset_of_ratings_far_apart(spark):
    """VW03: of upsets that rounding would make equal the one of the larger gap is the biggest."""
    w = far_apart(spark)
    w.bouts = w.bouts.where("bout_id < 50")
    w.decided, w.counted = w.bouts, w.counted.where("bout_id < 50")
    assert stories.nights(w).first().upset_id == 41


def test_mdl14_sql_says_the_same_bounds(spark):
    """MDL14: SQL bounds the chances as the query does, however far ratings lie apart."""
    w = far_apart(spark)
    got = checks.surprise_share(w).first()
    rows = ", ".join(f"('red', '{x.result}', {x.pre}::DOUBLE, {x.opp_pre}::DOUBLE)" for x in w.counted.where("side = 'red'").collect())
    n, loss, brier = duckdb.sql(oracle.ORACLE_SQL["mdl14"].replace(oracle.LEAGUE, f"WITH won AS (SELECT * FROM (VALUES {rows}) t(side, result, pre, opp_pre))")).fetchall()[0]
    assert got.n == n and (loss, brier) == pytest.approx((got.log_loss, got.brier), abs=1e-6)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nearest_is_exact_with_ties(spark):
    """JOIN16: the nearest of each who asks, as all pairs give them, with many equal vectors."""
    r, n = np.random.default_rng(1), 3000
    v = np.round(r.normal(size=(n, 6)), 1)
    v[:200] = v[0]
    ids = r.permutation(n).astype(np.int64)
    table = lambda rows, name: pa.table({name: ids[rows], **{f"v{i}": v[rows, i] for i in range(6)}})
    ask = np.arange(0, n, 37)
    got = joins._nearest(table(ask, "of_id"), table(np.arange(n), "boxer_id"), 5).to_pydict()
    want = []
    for a in ask:
        d = np.sqrt(sum((v[:, j] - v[a, j]) ** 2 for j in range(6)))
        want += [(int(ids[a]), x, k) for x, k in sorted((round(float(x), 9), int(k)) for x, k in zip(d, ids) if k != ids[a])[:5]]
    assert sorted(zip(got["of_id"], got["d"], got["boxer_id"])) == sorted(want)
    assert not joins._nearest(table(ask[:0], "of_id"), table(ask, "boxer_id"), 5).num_rows


def test_pairs_of_fighters_are_not_rows(w):
    """JOIN16: only the nearest of each cell are shuffled, and cells of any size agree."""
    rows = lambda cell: {tuple(x) for x in joins.similar_fighters(w, F.col("boxer_id") % 20 == 0, cell=cell).collect()}
    assert rows(5) == rows(1000)
    assert "FlatMapCoGroupsInArrow" in plan(joins.similar_fighters(w, F.col("boxer_id") % 20 == 0))


def test_facts_meet_by_one_shuffle(w):
    """MDL32: claims of a fact are moved once."""
    claims = star.fact_claims(w)
    assert plan(agreement.judged_facts(claims)).count("Exchange hashpartitioning") == 1


def test_what_needs_no_ratings_asks_for_none(spark):
    """MDL32, DQ01, DQ02, MDL17: corners, weights, claims, feeds and observations come from the bouts alone."""
    def none(w):  # noqa: ANN001, ANN202
        raise AssertionError("asked for ratings")

    own = League(spark, SF, ratings=none)
    assert own.corners.count() == 2 * own.bouts.count() and own.weigh_ins.count() and star.fact_claims(own).count() and star.money(own) and star.feed(own)
    assert trainers._observations(own, spark.range(200).selectExpr("id", "id AS at"), spark.range(50).selectExpr("id", "-1 - id AS at")).count()


def test_claims_are_dealt_into_tasks_that_sort_in_memory(spark, monkeypatch):
    """MDL32: a task gets no more rows than it sorts without spilling, whatever the session's number of partitions."""
    monkeypatch.setattr(shuffles, "TASK_ROWS", 10)
    assert shuffles.dealt(spark.range(200).withColumnRenamed("id", "subject"), "subject").rdd.getNumPartitions() == 21


def test_issues_of_money_are_told_in_one_pass(w):
    """DQ02: what is told of a row is written, so asking twice does no join and no window again."""
    assert "Window" not in plan(linkage.money_issues(w)) and "Join" not in plan(linkage.money_issues(w))


def test_rows_that_several_rules_read_are_checked_once(w):
    """DQ01, DQ03: the checks of bouts are not part of the plans of all that refer to them."""
    assert plan(merging.issues(w)).count("result_inconsistent") <= 1


def test_rows_in_bouts_are_checked_where_they_lie(w):
    """DQ01: nothing that comes in a bout is shuffled to it, to its fighters or to people; bouts are shuffled for who fights twice a day alone."""
    exchanges = [x for x in plan(merging.issues(w)).splitlines() if "Exchange hashpartitioning" in x]
    assert len(exchanges) <= 6 and not any("bout" in x or "judge" in x or "boxer_known" in x for x in exchanges)


@pytest.mark.parametrize("most", [8_000_000, 3])
def test_rows_in_bouts_and_apart_are_checked_alike(spark, w, monkeypatch, most):
    """DQ01: repeated ids, rows that name another bout than the one they come in, cards of other bouts; also with sets too large to be sent."""
    feed, n = star.feed(w), "row % 1000"
    other = feed.events.agg(F.max("id")).first()[0]
    odd = f"CASE WHEN {n} = 2 AND row % 7 = 0 THEN 'x' || (row - 1) WHEN {n} = 3 THEN 'x' || (row + 1) WHEN {n} = 4 THEN 'x' || (row - 1) ELSE id END"
    b = feed.bouts.withColumn("id", F.expr(odd)).withColumn("event", F.expr(f"CASE WHEN row % 11 = 3 THEN '{other}' ELSE event END"))
    inside = feed._replace(bouts=b)
    apart = Feed(*feed[:2], b.drop("packet", "card_id", "card_date", "held"), *feed[3:5], *[t.of(b.select("held")) for t in feed[5:]])
    monkeypatch.setattr(shuffles, "MOST_SENT", most)
    a, z = (Counter(map(tuple, validated(x, "2000-06-30")[0].collect())) for x in (inside, apart))
    assert a == z and a["error", "dup_id", "bout", "(blank)"] == 0 and sum(v for k, v in a.items() if k[1] == "dup_id" and k[2] == "bout") > 10


def test_kept_rows_of_a_feed(w):
    """DQ01: what is kept of a feed has the columns that were delivered, and no row in error."""
    feed = star.feed(w)
    found, kept = validated(feed, "2000-06-30")
    wrong = {x.entity: x.n for x in found.where("severity = 'error'").groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert kept.bouts.columns == feed.bouts.columns and kept.bouts.count() == feed.bouts.count() - wrong["bout"]
    assert kept.punches.columns == feed.punches.columns and kept.punches.count() == w.punches.count() - wrong["punch_stat"]


def test_groups_of_issues_sort_no_issues(w):
    """DQ03: the two smallest ids of a group come from each task, not from a sort of all issues."""
    assert "Window" not in plan(merging.issue_groups(w)).split("MapInArrow")[0]
    ids = ["b", "a", None, "a", "c"]
    batch = pa.record_batch([pa.array(["error"] * 5), pa.array(["x"] * 4 + ["y"]), pa.array(["bout"] * 5), pa.array(ids)], names=["severity", "code", "entity", "id"])
    got = [r for b in merging._smallest_two(iter([batch, batch.slice(0, 1)])) for r in b.to_pylist()]
    assert [(r["code"], r["n"], r["ids"]) for r in got] == [("x", 5, ["a", "a"]), ("y", 1, ["c"])]


def test_lines_of_punches_are_those_of_the_lists(w):
    lists = w.punch_lists.select("bout_id", "boxer_id", F.explode("facts").alias("f")).select("bout_id", "boxer_id", "f.*")
    assert lists.exceptAll(w.punches).isEmpty() and lists.count() == w.punches.count()


def test_card_of_a_repeated_bout_is_not_emptied(spark, w):
    """DQ01: a row that repeats an id doesn't make its card one that lost its bouts."""
    feed = star.feed(w)
    one = feed.bouts.where("id IS NOT NULL").orderBy("row").limit(1)
    again = one.withColumn("row", F.lit(10**12)).withColumn("event", F.lit("e-new"))
    more = feed.events.limit(1).select(F.lit(10**12).alias("row"), F.lit("e-new").alias("id"), F.lit("2000-01-01").alias("date"))
    found = merging.validated(feed._replace(bouts=feed.bouts.unionByName(again), events=feed.events.unionByName(more)), "2000-06-30")[0]
    assert not found.where("code = 'event_emptied' AND id = 'e-new'").count() and found.where("code = 'dup_id' AND entity = 'bout'").count()


def test_forms_of_words_are_not_broadcast(spark):
    """SRCH06: a few names have many forms; small as they seem, they stay off the driver."""
    words = spark.range(1000).select(F.concat(F.lit("fighter"), F.col("id").cast("string")).alias("word"))
    assert "Broadcast" not in plan(mentions.near_pairs(words, words))


@pytest.mark.parametrize("bits", [28, 13])
def test_forms_that_nobody_typed_are_not_shuffled(spark, monkeypatch, bits):
    """SRCH06: of many known words, few forms that no typed word has go on; pairs are the same with a sieve that is much too small."""
    made = {}
    keep = mentions.written
    monkeypatch.setattr(mentions, "written", lambda df, label: made.setdefault(label, keep(df, label)))
    monkeypatch.setattr(shuffles, "SIEVE_BITS", bits)
    known = spark.range(300).select(F.concat(F.lit("fighter"), star.spelled_number(F.col("id"))).alias("word"))
    typed = spark.createDataFrame([("fighterbalcer",), ("figterdim",), ("fihgtergurhav",), ("abc",)], "word string")
    got = {tuple(x) for x in mentions.near_pairs(typed, known).collect()}
    words = [x.word for x in known.collect()]
    assert got == {(t, k, s) for t in ("fighterbalcer", "figterdim", "fihgtergurhav", "abc") for k in words if (s := mentions.slips_between(t, k)) is not None} and len(got) >= 3
    assert made["forms-asked-for"].count() < 300 * (20 if bits == 28 else 60)


def test_money_in_bouts_moves_no_rows_and_is_told_as_apart(w):
    """DQ02: purses and weights find their bouts where they lie; of rows that are alike one is kept, as of others of one ref."""
    money, plain = star.money(w)
    whole = [t.of(plain.bouts.select("held")) for t in (money.purses, money.weights)]
    apart = money._replace(purses=whole[0], weights=whole[1])
    a, z = (Counter(map(tuple, validated_money(x, plain, "2000-06-30")[0].collect())) for x in (money, apart))
    assert a == z and a and any(k[1] == "dup_purse" for k in a)
    twice, kept = validated_money(apart._replace(purses=whole[0].union(whole[0])), plain, "2000-06-30")
    once = whole[0].where("basis <> 'guess'").select("ref").distinct().count()
    refs = kept.purses.groupBy("ref").count()
    assert refs.where("count > 1").isEmpty() and 0 < refs.count() <= once
    n = lambda t: sum(v for k, v in t.items() if k[1] == "dup_purse")
    assert n(Counter(map(tuple, twice.collect()))) == 2 * n(a) + refs.count()


def test_rows_of_one_ref_alone_are_sorted(spark):
    rows = spark.createDataFrame([(k, v) for k, v in [("a", 2), ("a", 1), ("b", 1), ("c", 5), ("c", 5), (None, 1), (None, 1)]], "k string, v long")
    got = sorted(((x.k or "", x.v, x.later) for x in shuffles.all_but_first(rows, F.col("k"), ["v"], "later").collect()))
    assert got == [("", 1, False), ("", 1, False), ("a", 1, False), ("a", 2, True), ("b", 1, False), ("c", 5, False), ("c", 5, True)]
    assert "Window" not in plan(shuffles.all_but_first(rows.where("v = 2"), F.col("k"), ["v"], "later"))


def test_pages_of_records_are_made_in_small_tasks(w, monkeypatch):
    """SRC13: a task sorts and holds no more rows than fit, whatever the session's number of partitions; no other shuffle follows."""
    monkeypatch.setattr(shuffles, "TASK_ROWS", 1000)
    shown = plan(star.record_pages(w))
    exchanges = re.findall(r"Exchange hashpartitioning\(boxer_id#\w+, (\d+)\)", shown)
    assert exchanges == [str(2 * w.bouts.count() // 1000 + 1)]
