"""Registered queries: a key for each operator, applied to the league of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import aggregates as agg
from .operators import agreement, canon, careers, checks, documents, fits, joins, linkage, mentions, merging, models, rankings, reviews, search, stories, titles, trainers, views
from .functions.names import name_key
from .oracle import ORACLE_SQL  # noqa: F401
from .plans.league import League, league
from .sources import rawfeed, star, wikitables
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, counts as long: what two engines can agree on."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.DecimalType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def register(key: str, make: Callable[[League], DataFrame]) -> None:
    QUERIES[key] = lambda spark, sf_dir: plain(make(league(spark, sf_dir)))


CAREER = ["boxer_id", "wins", "losses", "draws", "kos", "ko_losses", "bouts", "ko_rate", "win_rate", "avg_rounds", "last_fight", "streak_type", "streak", "age"]

for _key, _make in {
    "src01": lambda w: w.bouts.select("bout_id", "event_id", "date", "red_id", "blue_id", "method", "winner_id", "rounds", "end_round", "round_time", "kd_red", "kd_blue", "title", "upcoming"),
    "join03": lambda w: w.long.select("bout_id", "boxer_id", "opp_id", "side", "result", "kd_for", "kd_against"),
    "win07": lambda w: w.counted.select("bout_id", "boxer_id", "pre", "post", "opp_pre"),
    "agg01": lambda w: w.careers.select(*CAREER),
    "prj03": lambda w: w.careers.select("boxer_id", "archetype", "record"),
    "agg02": agg.overview,
    "agg03": agg.by_division,
    "agg04": agg.method_split,
    "agg05": agg.by_year,
    "agg06": agg.finish_round_histogram,
    "agg07": agg.finish_heatmap,
    "agg08": agg.country_leaders,
    "agg09": agg.stance_edge,
    "agg10": agg.reach_edge,
    "agg11": agg.punch_totals,
    "agg12": agg.weigh_in_stats,
    "agg13": agg.night_edge,
    "agg14": agg.missed_weights,
    "agg15": agg.rehydration,
    "agg16": agg.judge_stats,
    "agg18": agg.scoring_disputes,
    "agg20": agg.mean_stint_result,
    "agg24": agg.best_purses,
    "agg26": agg.career_money,
    "agg27": agg.top_purses,
    "agg29": agg.revenue_by_year,
    "agg30": agg.country_rollup,
    "agg31": agg.venue_rows,
    "agg32": agg.coverage,
    "agg33": careers.by_the_numbers,
    "agg34": careers.outcomes_by_year,
    "agg35": careers.finish_rounds,
    "agg36": careers.late_rounds,
    "agg37": careers.opposition,
    "agg38": agg.opponents_last_five,
    "agg39": agg.reach_index,
    "agg40": agg.career_strip,
    "agg41": lambda w: titles.belts(w),
    "agg42": agg.red_share_by_year,
    "agg43": agg.small_groups,
    "agg44": agg.change_groups,
    "join04": joins.missed_and_won,
    "join05": joins.without_bout,
    "join06": joins.head_to_head,
    "join07": lambda w: joins.common_opponents(w, 4, 52),
    "join08": lambda w: joins.bouts_in_stints(w).select("bout_id", "boxer_id", "person_id", "start", "end"),
    "join09": joins.head_trainer,
    "join11": joins.stint_start_ratings,
    "join12": joins.ratings_going_in,
    "join14": joins.top_pairs,
    "join15": lambda w: joins.candidates(w, 6),
    "join16": lambda w: joins.similar_fighters(w, F.col("boxer_id") % 20 == 0),
    "join18": agg.host_record,
    "win01": rankings.division_ranking,
    "win02": rankings.rank_movement,
    "win03": rankings.pound_for_pound,
    "win04": lambda w: careers.running_record(w).select("bout_id", "boxer_id", "wins_before", "losses_before", "bouts_before", "kos_before", "ko_losses_before", "days_idle"),
    "win06_all_time": lambda w: careers.longest_run(w, "W", draws_break=False),
    "win06_analytics": lambda w: careers.longest_run(w, "W", draws_break=True),
    "win06_losses": lambda w: careers.longest_run(w, "L", draws_break=True),
    "win08": lambda w: w.reigns.select(*titles.BELT, "reign_no", "champion_id", "start", "end", "how", "ended_by", "from_id", "defences", "days"),
    "win09": rankings.accumulators,
    "win12": careers.form,
    "win13": joins.switched_trainers,
    "win14": careers.longest_gap,
    "win16": rankings.on_this_day,
    "win21": rankings.split_by_time,
    "flt07": lambda w: careers.unbeaten_in_last(w, 3),
    "flt21": lambda w: rankings.eligible(w).select("boxer_id", "rating"),
    "rec01": lambda w: rankings.record_list(w, "greatest"),
    "rec02": lambda w: rankings.record_list(w, "peak", sex="female"),
    "rec03": lambda w: rankings.record_list(w, "wins"),
    "rec04": lambda w: rankings.record_list(w, "kos", division="BUILDING"),
    "rec05": lambda w: rankings.record_list(w, "ko-rate"),
    "rec06": lambda w: rankings.record_list(w, "win-streak"),
    "rec07": lambda w: rankings.record_list(w, "quality-wins"),
    "rec08": lambda w: rankings.record_list(w, "title-wins"),
    "rec09": lambda w: rankings.record_list(w, "defences"),
    "rec10": lambda w: rankings.record_list(w, "divisions"),
    "rec11": lambda w: rankings.record_list(w, "longest-reign"),
    "rec12": lambda w: rankings.record_list(w, "reign-defences"),
    "rec15": rankings.fastest_finishes,
    "rec16": rankings.most_knockdowns,
    "vw08": rankings.biggest_upsets,
}.items():
    register(_key, _make)


def parts(w: League) -> DataFrame:
    """Part names as a list, ranked by size."""
    return w.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("rank"))


FIGHTER_SEARCH = search.Filters(sex="male", active=True, least={"wins": 20, "rating": 1500, "height_cm": 165}, most={"losses": 40}, fought_since="2000-01-01")
VIA_SEARCH = search.Filters(champion="former", missed_weight=True, stance="Southpaw")

for _key, _make in {
    "flt01": lambda w: search.search(w, FIGHTER_SEARCH).select("boxer_id", "wins", "losses", "rating", "height_cm"),
    "flt03": lambda w: search.search(w, search.Filters(undefeated=True)).select("boxer_id"),
    "flt06": lambda w: search.search(w, search.Filters(win_streak=3)).select("boxer_id", "streak"),
    "flt12": lambda w: search.search(w, search.Filters(archetype="Counter-Puncher")).select("boxer_id"),
    "flt13": lambda w: search.search(w, search.Filters(text="0012")).select("boxer_id", "name"),
    "flt14": lambda w: search.search(w, search.Filters(trainer_id=3)).select("boxer_id"),
    "flt15": lambda w: search.search(w, VIA_SEARCH).select("boxer_id"),
    "flt17": lambda w: w.bouts.where("year(date) = 1999 AND division = 'BUILDING' AND title IS NOT NULL AND rounds >= 8 AND method IN ('KO', 'TKO', 'RTD')").select("bout_id", "date", "method", "rounds"),
    "ord01": lambda w: search.sort_unknown_last(w.careers, "reach_cm", True, "boxer_id").select("boxer_id", "reach_cm"),
    "ord06": lambda w: search.page(w.careers.select("boxer_id", "rating"), [F.desc("rating"), "boxer_id"], 3, 25),
    "srch01": lambda w: search.type_ahead(w, "re"),
    "srch03": search.word_index,
    "srch04": lambda w: search.global_search(w, "12"),
    "srch05": lambda w: search.unique_names(w.raw("customer").select(F.col("c_name").alias("name"))),
    "srch07": lambda w: search.names_in_text(w.raw("benchmark").select(F.col("item_id").alias("name_id"), F.col("text").alias("name")), w.raw("documents")),
    "srch02": lambda w: search.by_name(parts(w), "smlal widgte"),
    "srch06": lambda w: mentions.people_in_texts(star.named_people(w), star.mention_texts(w)),
    "srch08": lambda w: search.by_name(parts(w), "RED widg"),
    "set03": lambda w: search.champions(w, "former"),
    "mdl01_elo": models.elo,
    "mdl02": models.predictions,
    "mdl08": models.calls,
    "mdl09": models.calls_summary,
    "mdl10_worst": models.worst_calls,
    "mdl11": models.calibration,
    "mdl11_verdict": lambda w: models.calibration_verdict(models.calibration(w)),
    "mdl12": fits.win_rows,
    "mdl13_irls": fits.win_fit,
    "mdl16_finish": fits.finish_fit,
    "mdl19": models.trainer_lift,
    "mdl20": models.upset_watch,
    "mdl21": models.tier_record,
    "mdl22": models.fight_scores,
    "mdl27_style_map": models.style_map,
    "win10": models.fights_of_the_year,
    "fn02": documents.slugs,
    "fn15": documents.props,
    "fn19": documents.text_checks,
    "src09": documents.pages_text,
    "str10": documents.copy_waves,
    "lnk09": documents.duplicate_groups,
    "str_tumbling": lambda w: documents.windows(w.raw("events"), "1 hour"),
    "str_sliding": lambda w: documents.windows(w.raw("events"), "1 hour", "15 minutes"),
    "str_session": lambda w: documents.sessions(w.raw("events")),
    "str_dedupe": lambda w: documents.dedupe_daily(w.raw("events")),
    "str_limiter": lambda w: documents.limited(w.raw("events")),
    "str08": lambda w: documents.fixed_windows(w.raw("events")),
    "str10_posts": lambda w: documents.copied_posts(documents.posts(w)),
    "str_late": lambda w: documents.late(w.raw("events")),
    "snk01": merging.upsert,
    "snk03": merging.replace_per_source,
    "snk06": merging.ledger,
    "str02": merging.changes,
    "str03": merging.change_flood,
    "str17": merging.list_diff,
    "dq01": merging.issues,
    "dq03": merging.issue_groups,
    "dq04": merging.double_bookings,
    "dq05": merging.overlapping_stints,
    "dq06": merging.card_conflicts,
    "dq08": merging.reconciliation,
    "dq09_core": merging.coherent_core,
    "dq13_components": merging.components,
    "dq16": merging.stratified_sample,
    "dq19": merging.settlement,
    "win20": merging.repeat_fights,
}.items():
    register(_key, _make)


def broadcaster_cards(w: League) -> DataFrame:
    """LNK08: cards of each broadcaster's organisation."""
    orgs, links = canon.broadcaster_links(w.events.select("event_id", star.spelled(F.col("event_id"), star.CHANNELS).alias("broadcaster")))
    return orgs.join(links.groupBy("external_id").agg(F.count("*").alias("cards")), "external_id")


def money_told(w: League) -> DataFrame:
    """DQ02 without what is told of a row that was kept among repeats of its ref, and without the counts of rows that have no URL."""
    x = linkage.money_issues(w).where("code <> 'no_source_url'")
    repeated = x.where("code LIKE 'dup%'").select("entity", "id").distinct()
    return x.where("severity = 'error'").unionByName(x.where("severity = 'warning'").join(repeated, ["entity", "id"], "left_anti").select(x.columns))


def keyed_changes(w: League) -> DataFrame:
    """Changes of the two snapshots, each with its target."""
    c = merging.changes(w)
    return c.select("bout_id", F.concat_ws(":", F.col("bout_id").cast("string"), "field").alias("target"), "kind", "new", F.lit(0).alias("place"))


def proposals(w: League) -> DataFrame:
    """STR05."""
    c = written(keyed_changes(w), "changes")  # read as changes and as what was proposed before
    return reviews.reconciled_proposals(c, star.proposals(w, c), F.lit(w.as_of), ~F.col("target").endswith("3003:ghost"))


def community_teams(w: League) -> DataFrame:
    """DQ18: stints by source and person once the edits are replayed; every seventh fighter's stints came from former edits."""
    source = F.when(F.col("boxer_id") % 7 == 0, reviews.EDIT_SOURCE).otherwise("feed")
    held = w.stints.select("boxer_id", F.concat(F.lit("p"), F.col("person_id").cast("string")).alias("person"), "start", source.alias("source"))
    people = w.raw("supplier").select(F.concat(F.lit("p"), F.col("s_suppkey").cast("string")).alias("person"), F.col("s_name").alias("name"))
    rows, skipped = reviews.replayed_contributions(held, star.contributions(w), people, w.fighters.select("boxer_id"))
    return rows.select("source", "person").unionByName(skipped.select(F.lit("skipped").alias("source"), F.lit("").alias("person"))).groupBy("source", "person").agg(F.count("*").alias("n"))


def capped_draws(w: League) -> DataFrame:
    """LNK03: some fighters' suppliers count a draw less than is held, or don't count."""
    k = F.col("boxer_id")
    totals = w.careers.where("boxer_id % 5 <> 0").select("boxer_id", F.greatest(F.lit(0), F.col("draws") - F.when(k % 3 == 0, 1).otherwise(0)).alias("draws"))
    return reviews.capped_draws(w.bouts.where("method = 'DRAW'").select("bout_id", "red_id", "blue_id"), totals)


for _key, _make in {
    "dq10": reviews.explained_conflicts,
    "dq18": community_teams,
    "str05": proposals,
    "lnk03_draws": capped_draws,
    "lnk07": lambda w: reviews.decided_venues(*star.venues(w)),
    "prj01": views.with_names,
    "prj02": lambda w: w.careers.select("boxer_id", "record", F.when(F.col("wins") > F.col("losses"), "winning").when(F.col("wins") < F.col("losses"), "losing").otherwise("even").alias("balance")),
    "join02": views.enriched_events,
    "join10": views.trainer_ids,
    "join13": lambda w: linkage.checked_claims(star.claims(w), w.named("red").where("NOT cancelled").select("bout_id", "date", F.col("red_name").alias("name"), "method", "rounds")),
    "join17_fuzzy": lambda w: search.fuzzy_words(w, ["smlal", "widgte", "anvli", "gizmoo", "gear"]),
    "agg17": views.referee_stats,
    "agg19": views.stint_records,
    "agg22": views.gyms,
    "agg23": views.trainer_leaderboard,
    "agg25": views.card_money,
    "agg28": views.broadcasters,
    "win05": views.features,
    "win15": views.action_percentile,
    "win18": lambda w: views.leaderboard(w, least=3),
    "win22": views.rank_before_and_after,
    "ord02": views.by_ko_rate,
    "ord07": views.newest_bouts,
    "set01": views.all_spellings,
    "set02": views.needs_review,
    "set04": views.shared_countries,
    "vw04": views.next_cards,
    "vw07": views.highlights,
    "vw14": views.ranking_depth,
    "mdl10": views.year_end_ranks,
    "mdl28": views.endings,
    "mdl25": stories.pairings,
    "vw02": stories.recaps,
    "vw03": stories.nights,
    "vw05": stories.day_index,
    "vw06": stories.previews,
    "vw12": stories.scouting_lines,
    "vw12_matchup": stories.matchup_lines,
    "vw13": lambda w: stories.official_by_division(stories.official(w)),
    "vw13_fighters": lambda w: stories.official_by_fighter(stories.official(w)),
    "snk05": stories.official,
    "win17": stories.style_sample,
    "mdl18": trainers.switch_study,
    "mdl29": views.ledger_grades,
    "rec17": rankings.records_of,
    "mdl32": lambda w: agreement.judged_facts(star.fact_claims(w)).select("claim_id", "kind", "host", "value", "status"),
    "mdl32_claims": lambda w: agreement.judged_claims(star.fact_claims(w)).groupBy("status").agg(F.count("*").alias("n")),
    "fn01": linkage.folded_texts,
    "fn01_names": lambda w: star.profiles(w).groupBy(name_key(F.col("name")).alias("key")).agg(F.countDistinct("name").alias("spellings")),
    "fn03": linkage.part_keys,
    "fn08": lambda w: canon.read_as(w.fighters, star.spelled(F.col("boxer_id"), star.CLASS_NAMES), canon.division_of(F.col("spelled"))),
    "fn09": lambda w: canon.read_as(w.bouts, star.spelled(F.col("bout_id"), star.RESULTS), canon.method_of(F.col("spelled"))),
    "fn10": lambda w: canon.read_as(w.events, star.spelled(F.col("event_id"), star.PLACES), canon.country_of(F.col("spelled"))),
    "fn11": lambda w: canon.read_as(w.events, star.spelled(F.col("event_id"), star.CHANNELS), canon.broadcaster_of(F.col("spelled"))),
    "fn13": lambda w: canon.upper_medians(w.decided, "division", "end_round"),
    "fn17": lambda w: w.events.select("event_id", *[c.alias(n) for c, n in zip(canon.natural_earth((F.col("event_id") * 37) % 181 - 90, (F.col("event_id") * 53) % 361 - 180), "xy")]),
    "lnk08": lambda w: broadcaster_cards(w),
    "fn12": linkage.day_functions,
    "fn14": linkage.hashes,
    "fn16": linkage.order_prices,
    "fn20": linkage.array_functions,
    "lnk01": lambda w: linkage.duplicate_profiles(star.profiles(w)).withColumn("ids", F.array_join("ids", ",")),
    "lnk01_bouts": lambda w: linkage.merged_profiles(star.profiles(w), w.bouts.select("bout_id", "red_id", "blue_id", "winner_id"))[1],
    "lnk04": lambda w: linkage.three_pass_linkage(star.people(w, "supplier", "s_suppkey", "s_nationkey", 53), star.people(w, "customer", "c_custkey", "c_nationkey", 37)),
    "lnk06": lambda w: linkage.unified_venues(star.halls(w)),
    "dq02": money_told,
    "dq07": linkage.emptied_cards,
    "dq11": linkage.restricted,
    "dq14": linkage.surprises,
    "str06": linkage.corrected,
    "str11": linkage.post_limits_of,
    "str12": lambda w: linkage.reporters(w.raw("events").select(F.col("event_type").alias("subject"), "user_id", "ts")),
    "str16": linkage.picks_in_time,
}.items():
    register(_key, _make)

FACTS = ["boxer_id", "wins", "losses", "bouts", "kos", "rating"]


def _found(**tests) -> Callable[[League], DataFrame]:  # noqa: ANN003
    return lambda w: search.search(w, search.Filters(**tests)).select(*FACTS)


for _key, _make in {
    "flt02": _found(division="FURNITURE", sex="female", stance="Southpaw", active=True),
    "flt04": _found(least={"wins": 25, "bouts": 60}, most={"losses": 35, "draws": 4}),
    "flt05": _found(least={"kos": 10, "ko_rate": 0.5}, most={"ko_losses": 15}),
    "flt08": _found(fought_since="2000-05-01", fought_until="2000-06-15"),
    "flt09": _found(record="losing", sex="female"),
    "flt10": _found(least={"reach_cm": 180, "age": 25, "debut_year": 1992}, most={"height_cm": 190, "age": 30, "debut_year": 1999}),
    "flt14_name": _found(trainer_name="0003", team_now=True),
    "flt14_gym": _found(gym_nation="nation_1", team_now=True, division="HOUSEHOLD"),
    "flt16_new": _found(new_trainer_since="1999-09-30", division="BUILDING"),
    "flt18": _found(country="NATION_4", stance="Orthodox", active=True),
    "prj04": models.score_tiers,
    "mdl06": models.prediction_factors,
    "mdl23": models.score_reasons,
    "flt11": _found(least={"rating": 1504}, most={"rating": 1548}),
    "flt16": _found(missed_weight=True, division="BUILDING"),
    "flt22": lambda w: w.decided.where("method <> 'DQ' AND rounds >= 6").groupBy("rounds").agg(F.count("*").alias("n")),
    "mdl07": checks.preset_chances,
    "mdl14": checks.surprise_share,
    "mdl17_impact": trainers.trainer_impact,
    "lnk05": checks.reign_owner,
    "src10": lambda w: wikitables.parsed(star.reign_pages(w), "page", "text", wikitables.reigns, wikitables.REIGN),
    "src11": lambda w: rawfeed.mapped(star.raw_fighters(w), "row", "json", rawfeed.FIGHTER)[0].drop("reach_cm"),
    "src11_problems": lambda w: rawfeed.mapped(star.raw_fighters(w), "row", "json", rawfeed.FIGHTER)[1],
    "src13": lambda w: wikitables.parsed(star.record_pages(w), "page", "text", wikitables.record, wikitables.RECORD),
    "str04": checks.rule_decisions,
    "str15": checks.lagging,
    "dq15": checks.audit,
    "vw09": lambda w: checks.watchlist(w, checks.watched_by_events(w)),
}.items():
    register(_key, _make)
