"""Worked numbers, invariants of the whole league, and batch against stream."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from ringlore import queries
from ringlore.functions import columns as c
from ringlore.operators import aggregates, careers, documents, fits, merging, models, rankings, search, titles, views
from ringlore.plans.league import League, league
from ringlore.sources import files, star
from ringlore.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def w(spark):
    return league(spark, SF)


def test_wins_equal_losses_and_totals(w):
    r = w.careers.agg(*[F.sum(x).alias(x) for x in ("wins", "losses", "draws", "bouts")]).first()
    assert r.wins == r.losses and r.wins + r.losses + r.draws == r.bouts == 2 * w.decided.count()


def test_elo_invariants(w):
    e = models.elo(w)
    r = e.agg(F.count("*").alias("n"), F.max(F.abs(F.col("change"))).alias("most")).first()
    assert r.n == w.decided.count() and r.most <= 24 * 1.15
    # a rating before a bout is the one after the fighter's last bout
    long = e.select("bout_id", F.col("red_id").alias("b"), F.col("pre_red").alias("pre"), F.col("change").alias("d")).unionByName(e.select("bout_id", F.col("blue_id").alias("b"), F.col("pre_blue").alias("pre"), (-F.col("change")).alias("d")))
    x = long.join(w.bouts.select("bout_id", "date"), "bout_id").toPandas().sort_values(["b", "date", "bout_id"])
    after = (x.pre + x.d).groupby(x.b).shift(1).fillna(1500.0)
    assert abs(after - x.pre).max() < 1e-9


def test_reigns_end_where_the_next_begins(w):
    rows = w.reigns.orderBy(*titles.BELT, "reign_no").collect()
    for a, b in zip(rows, rows[1:]):
        same = all(a[k] == b[k] for k in titles.BELT)
        assert (a["end"] == b["start"]) if same else a["end"] is None
        assert same or b["how"] in ("first", "vacant")


def test_streaks_and_runs_of_one_fighter(w):
    rows = w.counted.where("boxer_id = 0").orderBy("date", "bout_id").select("result").collect()
    s = [r.result for r in rows]
    trailing = len(s) - max((i + 1 for i, x in enumerate(s) if x != s[-1]), default=0)
    got = careers.current_streak(w).where("boxer_id = 0").first()
    assert (got.streak_type, got.streak) == (s[-1], trailing)

    def longest(seq, of):
        best = run = 0
        for x in seq:
            run = run + 1 if x == of else 0
            best = max(best, run)
        return best

    assert careers.longest_run(w, "W", True).where("boxer_id = 0").first().longest == longest(s, "W")
    assert careers.longest_run(w, "W", False).where("boxer_id = 0").first().longest == longest([x for x in s if x != "D"], "W")


def test_rounding_and_months(spark):
    x = spark.createDataFrame([(-2.5,), (2.5,), (2.4,)], "x double").select(c.half_up(F.col("x")).alias("y")).collect()
    assert [r.y for r in x] == [-2, 3, 2]
    assert c.months_before(dt.date(2000, 6, 30), 3) == dt.date(2000, 3, 31)


@pytest.mark.parametrize(("a", "b", "most", "d"), [("ab", "ba", 2, 1), ("ca", "abc", 3, 3), ("kitten", "sitting", 3, 3), ("abc", "xyz", 1, 2), ("", "a", 2, 1)])
def test_osa_distance(a, b, most, d):
    assert search.osa_distance(a, b, most) == d


def test_unknown_values_pass_no_filter(w):
    tall = search.search(w, search.Filters(least={"height_cm": 0})).count()
    short = search.search(w, search.Filters(most={"height_cm": 999})).count()
    assert tall == short == w.fighters.where("height_cm IS NOT NULL").count() < w.fighters.count()


def test_empty_league(spark, tmp_path):
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(str(tmp_path / f"{t}.parquet"))
    from ringlore.queries import QUERIES

    e = League(spark, str(tmp_path))
    assert e.careers.count() == 0 and e.reigns.count() == 0 and rankings.division_ranking(e).count() == 0 and merging.changes(e).count() == 0
    for key in ("agg02", "agg04", "agg09", "win08", "rec01", "mdl22", "dq03"):
        QUERIES[key](spark, str(tmp_path)).collect()


def test_components_agree_with_pools(w):
    x = merging.components(w).join(w.fighters, "boxer_id").groupBy("label").agg(F.countDistinct("division", "sex").alias("pools"))
    assert x.where("pools > 1").count() == 0


def test_csv(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text('Birth Year,Full-Name,height_cm\n1990,"O""Hara, Al\nJr",180\n,,\nx,Bo,170.5\n1980,,160\n')
    rows, problems = files.typed(files.read_csv(spark, str(p)), {"fullname": "string", "birthyear": "int", "heightcm": "int", "reach": "int"}, required=("fullname",))
    assert {(r.fullname, r.birthyear, r.heightcm, r.reach) for r in rows.collect()} == {('O"Hara, Al\nJr', 1990, 180, None), ("Bo", None, None, None)}
    assert sorted(r.problem for r in problems.collect()) == ["birthyear: x", "fullname: missing", "heightcm: 170.5"]


def test_feeds_and_html(spark):
    xml = '<rss><item><title><![CDATA[A <b>bold</b> &amp; new]]></title><link>https://x.org/a?utm_source=q&amp;id=7#f</link><pubDate>d</pubDate></item><item><title>no link</title></item></rss>'
    atom = '<feed><entry><title>T</title><link href="javascript:x"/></entry><entry><title>U</title><link rel="self" href="http://y.org/b"/></entry></feed>'
    got = files.feed_items(spark.createDataFrame([(1, xml), (2, atom), (3, None)], "id long, x string"), "id", "x").collect()
    assert [(r.key, r.title, r.link) for r in got] == [(1, "A bold & new", "https://x.org/a?id=7"), (2, "U", "http://y.org/b")]
    page = spark.createDataFrame([("<p>a&nbsp;&amp;lt; <script>x</script>b<!-- c --></p>",)], "h string").select(documents.html_text(F.col("h")).alias("t")).first().t
    assert page == "a &lt; b"


def _run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("complete" if name != "allowed" and name != "first" else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "ev"))
    stream = jobs.event_stream(spark, str(tmp_path / "ev"), ev.schema)
    _run(jobs.tumbling(stream, lateness="3650 days"), "tumbling")
    got = {(r.window.start, r.event_type, r.n) for r in spark.table("tumbling").collect()}
    assert got == {(r.start, r.event_type, r.n) for r in documents.windows(ev, "1 hour").collect()}
    _run(jobs.sessions(jobs.event_stream(spark, str(tmp_path / "ev"), ev.schema), lateness="3650 days"), "sessions")
    assert {(r.user_id, r.session_window.start, r.n) for r in spark.table("sessions").collect()} == {(r.user_id, r.start, r.n) for r in documents.sessions(ev).collect()}
    keys = ["user_id", "event_type"]
    _run(jobs.first_only(jobs.event_stream(spark, str(tmp_path / "ev"), ev.schema), keys, "3650 days"), "first")
    assert spark.table("first").count() == ev.select(*keys).distinct().count()


def test_limiter_counts_only_allowed(spark, tmp_path):
    r = random.Random(4)
    rows = sorted((i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(4000))) for i in range(120))
    rows = [(i, u, t) for i, (u, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    q = jobs.limiter(jobs.event_stream(spark, str(tmp_path / "e"), df.schema), most=3, seconds=600).writeStream.format("memory").queryName("allowed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    held, expected = {}, {}
    for i, u, t in sorted(rows, key=lambda x: (x[2], x[0])):
        held[u] = [x for x in held.get(u, []) if x > t - dt.timedelta(seconds=600)]
        expected[i] = len(held[u]) < 3
        if expected[i]:
            held[u].append(t)
    assert {r.event_id: r.allowed for r in spark.table("allowed").collect()} == expected


def test_frames_shuffle_no_bout_twice_for_its_host_or_ratings(spark):
    """Cards hold their host's place, so bouts don't meet their hosts; given ratings come out of their shuffle into the join, not out of a table."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        w = League(spark, SF, ratings=star.running_score)
        assert "host_n" in w._cards.columns and "host_n" not in w.events.columns
        bouts = star.bouts(spark, SF, w.fighters, w._cards, w.as_of)
        assert bouts._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 3
        assert not [p for p in w.ratings.inputFiles() if "ringlore-ratings" in p]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bouts_find_their_corners_without_a_shuffle(spark):
    """Ids by place are broadcast in rows of a fixed length; the bouts are those of the shuffled look-up, and each is written once with both ratings."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        w = League(spark, SF, ratings=star.running_score)
        few = star.bouts(spark, SF, w.fighters, w._cards, w.as_of, few=True)
        assert few._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
        many = star.bouts(spark, SF, w.fighters, w._cards, w.as_of)
        assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty() and few.count() > 5000
        pool = spark.range(1000).selectExpr("'A' AS division", "'male' AS sex", "int(999 - id) AS pos", "id AS boxer_id")
        assert {r.chunk: r.ids for r in star.seats(pool).collect()} == {i: [999 - p for p in range(256 * i, min(1000, 256 * i + 256))] for i in range(4)}
        assert w.long.count() == 2 * w.rated.count() == 2 * w.bouts.count() and {p.rsplit("/", 1)[0].split("/")[-1][:21] for p in w.long.inputFiles()} == {"ringlore-rated-bouts-"}
        # bouts lie by card: neither their ratings nor a count by card move them
        by_card = w.bouts.groupBy("event_id").agg(F.max("part"))
        assert "Exchange" not in by_card._jdf.queryExecution().executedPlan().toString()
        assert w.rated.join(w.ratings, ["bout_id", "red_pre", "blue_pre", "red_change", "blue_change"]).count() == w.bouts.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_punches_cards_and_purses_of_a_bout_lie_in_its_row(spark, w):
    """Sums of a bout need no shuffle but that of a histogram or a list; lists and rows say the same, also of a fighter in both corners."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (aggregates.punch_totals(w), aggregates.best_purses(w), models.score_reasons(w)):
        assert "Exchange" not in plan(df)
    assert "SortMergeJoin" not in plan(views.action_percentile(w))
    got = w.punches.groupBy("bout_id", "boxer_id").agg(F.sum(F.expr("IF(round = 0, landed, NULL)")).alias("t"), F.sum(F.expr("IF(round > 0, landed, NULL)")).alias("r"), F.sum(F.expr("INT(round > 0)")).alias("n"))
    want = got.selectExpr("bout_id", "boxer_id", "coalesce(t, r) AS landed", "n AS rounds")
    assert want.exceptAll(aggregates.punch_totals(w)).isEmpty() and want.count() == 2 * w.decided.count()
    alone = w.decided.where("bout_id % 3 = 0").limit(5).withColumn("blue_id", F.col("red_id")).select("bout_id", "red_id", F.explode(w.punches_of_bout()).alias("c")).select("bout_id", "red_id", "c.*")
    rows = alone.collect()
    assert len(rows) == 5 and all(r.boxer_id == r.red_id and sum(f.round == 0 for f in r.facts) == 2 for r in rows)


def test_generated_code_of_bouts_is_compiled(spark):
    """The JVM interprets generated methods of over 8,000 bytes; all bouts pass through this one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        w = League(spark, SF, ratings=star.running_score)
        made = star.bouts(spark, SF, w.fighters, w._cards, w.as_of, few=True)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", made._jdf.queryExecution().explainString(mode))]
        assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_what_follows_by_fighter_is_one_shuffle_and_the_same(spark, w):
    """Careers, records and terms before bouts against their forms by several joins, for ratings by fighter and by replay."""
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert shuffles(w.turns()) == 1 and shuffles(fits.finish_rows(w)) == 2
    for league_ in (w, League(spark, SF)):
        same = ["bout_id", "boxer_id", "opp_id", "date", "result", "pre", "post"]
        a, b = league_.turns().select(same), league_.long.select(same)
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 2 * league_.bouts.count()
        streak, runs = careers.current_streak(league_), careers.longest_run(league_, "W", draws_break=False)
        assert streak.exceptAll(league_.careers.select("boxer_id", "streak_type", "streak")).isEmpty()
        acc = rankings.accumulators(league_)
        assert runs.exceptAll(acc.select("boxer_id", F.col("win_streak").alias("longest"))).isEmpty()
        strong = league_.counted.where("result = 'W' AND opp_pre >= 1540").groupBy("boxer_id").agg(F.count("*").alias("quality_wins"))
        assert strong.exceptAll(acc.select("boxer_id", "quality_wins")).isEmpty() and acc.agg(F.sum("quality_wins")).first()[0] == strong.agg(F.sum("quality_wins")).first()[0]
        r = careers.running_record(league_).where("bouts_before >= 1")
        both = r.groupBy("bout_id").count().where("count = 2")
        assert fits.finish_rows(league_).count() == both.count() > 1000
        got = fits.going_in(league_).where("bouts_before >= 1").select("bout_id", "boxer_id", "wins_before", "kos_before", "ko_losses_before", "days_idle")
        assert r.select(got.columns).exceptAll(got).isEmpty()


def test_changes_are_worked_out_once_for_proposals(w):
    """What is found and what was proposed before read one written table of changes, not the snapshots three times."""
    x = queries.proposals(w)
    assert len({p.rsplit("/", 1)[0] for p in x.inputFiles() if "ringlore-changes-" in p}) == 1
    assert x.where("outcome <> 'superseded'").count() == merging.changes(w).count() > 1000
