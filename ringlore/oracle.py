"""DuckDB SQL that says what the registered queries should return, written apart from them.

``LEAGUE`` derives the league from the given tables as common table expressions; each query is what follows.
Numbers are rounded and counted as ``queries.plain`` does.
"""

from __future__ import annotations

LEAGUE = """
WITH fighters0 AS (
    SELECT c_custkey AS boxer_id, c_name AS name, n_name AS country, c_mktsegment AS division, n_regionkey,
        CASE WHEN c_custkey % 4 = 0 THEN 'female' ELSE 'male' END AS sex, c_acctbal > 0 AS active,
        CASE WHEN c_custkey % 13 <> 0 THEN 1955 + c_custkey % 30 END AS birth_year,
        CASE WHEN c_custkey % 11 <> 0 THEN 160 + (c_custkey * 7) % 41 END AS height_cm,
        CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 17 <> 0 THEN 160 + (c_custkey * 7) % 41 + c_custkey % 19 - 6 END AS reach_cm,
        CASE WHEN c_custkey % 10 < 6 THEN 'Orthodox' WHEN c_custkey % 10 < 9 THEN 'Southpaw' END AS stance
    FROM customer JOIN nation ON c_nationkey = n_nationkey),
fighters AS (
    SELECT *, row_number() OVER (PARTITION BY division, sex ORDER BY boxer_id) - 1 AS pos, count(*) OVER (PARTITION BY division, sex) AS n FROM fighters0),
league_events AS (
    SELECT o_orderkey AS event_id, o_orderdate::DATE AS date, o_orderkey % 53 = 0 AS cancelled, country, 'Hall ' || (o_orderkey % 40) AS venue,
        o_orderpriority AS promoter, o_custkey AS host_id
    FROM orders JOIN fighters ON o_custkey = boxer_id),
bouts0 AS (
    SELECT l.*, e.*, f.division, f.sex, f.pos, f.n, l_quantity::BIGINT AS q, (l_partkey + l_suppkey) % 12 = 0 AS is_title,
        l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity,
            l_discount, l_tax, l_returnflag, l_linestatus) AS bout_id,
        (l_partkey * 31 + l_suppkey * 17 + l_quantity::BIGINT * 7 + l_linenumber) % 100 AS m
    FROM lineitem l JOIN league_events e ON l_orderkey = event_id JOIN fighters f ON host_id = f.boxer_id),
bouts1 AS (
    SELECT *, CASE WHEN is_title AND n >= 4 THEN l_partkey % 4 ELSE (pos + l_linenumber) % n END AS red_pos,
        CASE WHEN is_title AND n >= 4 THEN (l_partkey + 1 + l_orderkey % 3) % 4 ELSE (pos + l_linenumber + 1 + l_partkey % greatest(n - 1, 1)) % n END AS blue_pos,
        CASE WHEN NOT cancelled AND date <= DATE '2000-06-30' THEN
            CASE WHEN m < 14 THEN 'KO' WHEN m < 38 THEN 'TKO' WHEN m < 43 THEN 'RTD' WHEN m < 45 THEN 'DQ' WHEN m < 80 THEN 'UD' WHEN m < 85 THEN 'MD'
                WHEN m < 92 THEN 'SD' WHEN m < 94 THEN 'TD' WHEN m < 97 THEN 'DRAW' WHEN m < 98 THEN 'TDRAW' ELSE 'NC' END END AS method,
        4 + 2 * (l_linenumber % 5) AS rounds
    FROM bouts0),
bouts AS (
    SELECT b.bout_id, b.event_id, b.date, b.cancelled, b.country, b.venue, b.sex, r.boxer_id AS red_id, u.boxer_id AS blue_id, r.name AS red_name, method,
        CASE WHEN l_partkey % 7 <> 3 THEN b.division ELSE coalesce(map {'BUILDING': 'AUTOMOBILE', 'AUTOMOBILE': 'MACHINERY', 'MACHINERY': 'FURNITURE', 'FURNITURE': 'HOUSEHOLD'}[b.division], b.division) END AS division,
        CASE WHEN method IS NULL OR method IN ('DRAW', 'TDRAW', 'NC') THEN NULL WHEN r.boxer_id % 149 = 0 THEN r.boxer_id WHEN u.boxer_id % 149 = 0 THEN u.boxer_id WHEN q <= 28 THEN r.boxer_id ELSE u.boxer_id END AS winner_id, rounds,
        CASE WHEN method IS NULL THEN NULL WHEN method IN ('KO', 'TKO', 'RTD', 'DQ', 'TD', 'TDRAW') THEN CASE WHEN l_partkey % 29 <> 0 THEN 1 + l_suppkey % rounds END
            ELSE rounds END AS end_round,
        CASE WHEN l_partkey % 9 <> 0 THEN (l_suppkey % 3) || ':' || lpad((l_partkey % 60)::VARCHAR, 2, '0') END AS round_time,
        CASE WHEN q % 7 = 0 THEN 1 + q % 2 ELSE 0 END AS kd_red, CASE WHEN l_partkey % 8 = 0 THEN 1 ELSE 0 END AS kd_blue,
        CASE WHEN is_title THEN CASE WHEN l_partkey % 3 = 0 THEN 'Regional Title' ELSE 'World Title' END END AS title, l_suppkey % 3 AS title_org,
        is_title AND l_orderkey % 20 = 0 AS title_vacant, l_partkey AS part, l_suppkey AS supp, l_linenumber AS position, l_returnflag, l_extendedprice,
        NOT b.cancelled AND method IS NULL AS upcoming, method IS NOT NULL AND method <> 'NC' AS counted, coalesce(method IN ('KO', 'TKO', 'RTD'), false) AS stopped
    FROM bouts1 b JOIN fighters r ON r.division = b.division AND r.sex = b.sex AND r.pos = b.red_pos
    JOIN fighters u ON u.division = b.division AND u.sex = b.sex AND u.pos = b.blue_pos),
long0 AS (
    SELECT *, red_id AS boxer_id, blue_id AS opp_id, 'red' AS side, kd_red AS kd_against, kd_blue AS kd_for FROM bouts
    UNION ALL SELECT *, blue_id, red_id, 'blue', kd_blue, kd_red FROM bouts),
long1 AS (SELECT *, CASE WHEN counted THEN CASE WHEN winner_id IS NULL THEN 'D' WHEN winner_id = boxer_id THEN 'W' ELSE 'L' END END AS result FROM long0),
long2 AS (
    SELECT *, CASE result WHEN 'W' THEN 8 WHEN 'L' THEN -8 ELSE 0 END AS delta,
        1500.0::DOUBLE + coalesce(sum(CASE result WHEN 'W' THEN 8 WHEN 'L' THEN -8 ELSE 0 END) OVER
            (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS pre FROM long1),
lb AS (SELECT a.*, a.pre + a.delta AS post, b.pre AS opp_pre FROM long2 a JOIN long2 b ON a.bout_id = b.bout_id AND a.opp_id = b.boxer_id),
won AS (SELECT * FROM lb WHERE counted),
streaks AS (
    SELECT boxer_id, first_value(result) OVER w AS newest, result, row_number() OVER w AS n FROM won WINDOW w AS (PARTITION BY boxer_id ORDER BY date DESC, bout_id DESC)),
streak AS (
    SELECT boxer_id, newest AS streak_type, coalesce(min(n) FILTER (WHERE result <> newest) - 1, count(*)) AS streak FROM streaks GROUP BY ALL),
careers0 AS (
    SELECT f.*, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses, count(*) FILTER (result = 'D') AS draws,
        count(*) FILTER (result = 'W' AND stopped) AS kos, count(*) FILTER (result = 'L' AND stopped) AS ko_losses, count(bout_id) AS bouts,
        coalesce(avg(coalesce(end_round, rounds)), 0) AS avg_rounds, max(date) AS last_fight, coalesce(arg_max(post, (date, bout_id)), 1500) AS rating
    FROM fighters f LEFT JOIN won USING (boxer_id) GROUP BY ALL),
careers1 AS (SELECT c.*, s.streak_type, coalesce(s.streak, 0) AS streak, CASE WHEN wins > 0 THEN kos / wins ELSE 0 END AS ko_rate,
    CASE WHEN bouts > 0 THEN wins / bouts ELSE 0 END AS win_rate, 2000 - birth_year AS age FROM careers0 c LEFT JOIN streak s USING (boxer_id)),
careers AS (SELECT *, CASE WHEN bouts < 8 THEN 'Prospect' WHEN win_rate < 0.4 THEN 'Journeyman' WHEN ko_rate >= 0.55 THEN 'Knockout Artist'
    WHEN ko_rate >= 0.4 AND (losses = 0 OR ko_losses / losses <= 0.35) THEN 'Iron-Chin Brawler' WHEN ko_rate <= 0.3 AND win_rate >= 0.6 THEN 'Technician'
    WHEN avg_rounds >= 7 AND ko_rate < 0.4 THEN 'Volume Boxer' ELSE 'Counter-Puncher' END AS archetype FROM careers1),
titles0 AS (
    SELECT *, CASE WHEN winner_id = red_id THEN blue_id ELSE red_id END AS loser_id,
        lag(winner_id) OVER (PARTITION BY title_org, title, division, sex ORDER BY date, bout_id) AS prev FROM bouts WHERE title IS NOT NULL AND winner_id IS NOT NULL),
titles1 AS (
    SELECT *, CASE WHEN prev IS NULL THEN CASE WHEN title_vacant THEN 'vacant' ELSE 'first' END WHEN title_vacant THEN 'vacant' WHEN loser_id = prev THEN 'won' ELSE 'inherited' END AS how,
        sum(CASE WHEN prev IS NULL OR title_vacant OR winner_id <> prev THEN 1 ELSE 0 END) OVER (PARTITION BY title_org, title, division, sex ORDER BY date, bout_id) AS reign_no FROM titles0),
reigns0 AS (
    SELECT title_org, title, division, sex, reign_no, arg_min(winner_id, (date, bout_id)) AS champion_id, min(date) AS start, arg_min(how, (date, bout_id)) AS how,
        count(*) - 1 AS defences, max(date) AS last_date, arg_min(loser_id, (date, bout_id)) AS from0 FROM titles1 GROUP BY ALL),
reigns1 AS (
    SELECT *, CASE WHEN how <> 'inherited' THEN from0 END AS from_id, lead(start) OVER b AS "end",
        CASE lead(how) OVER b WHEN 'vacant' THEN 'vacated' WHEN 'won' THEN 'lost' WHEN 'inherited' THEN 'passed' END AS ended_by,
        greatest(0, datediff('day', start, coalesce(lead(start) OVER b, DATE '2000-06-30'))) AS days
    FROM reigns0 WINDOW b AS (PARTITION BY title_org, title, division, sex ORDER BY reign_no)),
reigns AS (
    SELECT r.*, CASE WHEN "end" IS NULL AND (NOT f.active OR datediff('day', last_date, DATE '2000-06-30') > 547) THEN datediff('day', start, last_date) ELSE days END AS counted_days
    FROM reigns1 r JOIN fighters f ON champion_id = boxer_id),
stints AS (
    SELECT boxer_id, (boxer_id + i * (1 + boxer_id % 3)) % (SELECT count(*) FROM supplier) AS person_id, make_date(1995 + 2 * i, 1 + boxer_id % 12, 1) AS start,
        CASE WHEN i < 3 THEN make_date(1997 + 2 * i, 1 + boxer_id % 12, 1) END AS "end" FROM fighters, (SELECT unnest([0, 1, 2, 3])::BIGINT AS i)),
instint AS (SELECT w.*, s.person_id, s.start, s."end" FROM won w JOIN stints s ON s.boxer_id = w.boxer_id AND w.date >= s.start AND (s."end" IS NULL OR w.date < s."end")),
cards0 AS (
    SELECT b.*, seat, 10 * rounds - 2 AS top, 1 + (bout_id + seat) % 5 AS gap,
        CASE WHEN winner_id IS NULL THEN (bout_id + seat) % 2 = 0 ELSE winner_id = red_id END AS r0, method IN ('MD', 'DRAW', 'TDRAW') AND seat = 3 AS even
    FROM bouts b, (SELECT unnest([1, 2, 3])::BIGINT AS seat) WHERE method IN ('UD', 'MD', 'SD', 'TD', 'DRAW', 'TDRAW')),
cards1 AS (SELECT *, CASE WHEN (method = 'SD' AND seat = 3) OR (bout_id % 101 = 0 AND seat = 2) THEN NOT r0 ELSE r0 END AS red_won FROM cards0),
cards AS (
    SELECT bout_id, date, method, seat, (supp + seat) % 23 AS judge_id, CASE WHEN even OR red_won THEN top ELSE top - gap END AS red,
        CASE WHEN even OR NOT red_won THEN top ELSE top - gap END AS blue, rounds, winner_id, red_id, blue_id FROM cards1),
weights0 AS (
    SELECT *, CASE division WHEN 'BUILDING' THEN 126.0 WHEN 'AUTOMOBILE' THEN 147.0 WHEN 'MACHINERY' THEN 160.0 WHEN 'FURNITURE' THEN 175.0 END::DOUBLE AS limit_lb,
        (part + CASE WHEN side = 'red' THEN 0 ELSE 1 END) % 37 = 0 AS missed FROM lb WHERE NOT cancelled),
weights1 AS (SELECT *, coalesce(limit_lb, 210.0) - (part % 20)::DOUBLE / 10.0::DOUBLE + CASE WHEN missed THEN 3.5 ELSE 0.0 END::DOUBLE AS official_lb FROM weights0),
weights AS (
    SELECT bout_id, boxer_id, opp_id, date, division, result, limit_lb, official_lb, CASE WHEN supp % 4 <> 0 THEN official_lb + 4 + (supp + boxer_id) % 12 END AS night_lb,
        CASE WHEN limit_lb IS NOT NULL THEN NOT missed END AS made FROM weights1),
punches AS (
    SELECT bout_id, boxer_id, round, CASE WHEN round = 0 THEN 4 ELSE 1 END * (5 + (part + boxer_id * 3 + round) % 25) AS landed
    FROM (SELECT bout_id, boxer_id, rounds, part, k * 7 AS round7, k, k * 7 AS round FROM won, (SELECT unnest([0, 1, 2, 3, 4])::BIGINT AS k) WHERE k <= least(rounds, 4) AND (k > 0 OR bout_id % 3 = 0))),
purses AS (
    SELECT bout_id, boxer_id, date, CASE WHEN i = 1 THEN 'estimated' WHEN l_returnflag = 'A' THEN 'disclosed' WHEN l_returnflag = 'N' THEN 'reported' ELSE 'estimated' END AS basis,
        'source ' || i AS source, CASE WHEN i = 0 AND bout_id % 8 = 0 THEN NULL ELSE round(l_extendedprice * (1 + i), 2) END AS usd
    FROM lb, (SELECT unnest([0, 1])::BIGINT AS i) WHERE NOT cancelled AND (i = 0 OR bout_id % 4 = 0)),
purse AS (
    SELECT bout_id, boxer_id, date, arg_max(usd, (r, source)) FILTER (usd IS NOT NULL) AS usd, arg_max(basis, (r, source)) FILTER (usd IS NOT NULL) AS basis
    FROM (SELECT *, CASE basis WHEN 'disclosed' THEN 0 WHEN 'reported' THEN -1 ELSE -2 END AS r FROM purses) GROUP BY ALL),
eligible AS (SELECT * FROM careers WHERE active AND bouts >= 5 AND win_rate >= 0.5 AND last_fight >= DATE '2000-06-30' - INTERVAL 729 DAY),
ranking AS (SELECT *, row_number() OVER (PARTITION BY division, sex ORDER BY rating DESC, boxer_id) AS rank FROM eligible),
runs AS (
    SELECT boxer_id, max(n) AS longest FROM (SELECT boxer_id, run, count(*) AS n FROM (SELECT boxer_id, result, count(*) FILTER (result = 'L') OVER (PARTITION BY boxer_id ORDER BY date, bout_id) AS run
        FROM won WHERE result <> 'D') WHERE result = 'W' GROUP BY ALL) GROUP BY ALL),
acc0 AS (
    SELECT boxer_id, max(post) AS peak, arg_max(date, (post, -epoch(date), -bout_id)) AS peak_date, count(*) FILTER (result = 'W' AND opp_pre >= 1540) AS quality_wins,
        count(*) FILTER (result = 'W' AND title IS NOT NULL) AS title_wins FROM won GROUP BY ALL),
held AS (SELECT champion_id AS boxer_id, sum(defences)::BIGINT AS defences, sum(counted_days)::BIGINT AS reign_days, count(DISTINCT division) AS divisions FROM reigns GROUP BY ALL),
acc AS (
    SELECT a.*, coalesce(defences, 0) AS defences, coalesce(reign_days, 0) AS reign_days, coalesce(divisions, 0) AS divisions, coalesce(longest, 0) AS win_streak
    FROM acc0 a LEFT JOIN held USING (boxer_id) LEFT JOIN runs USING (boxer_id))
"""

_RANKED = "SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({rows}) ORDER BY {order} LIMIT 25"


def _ranked(rows: str, order: str, columns: str = "boxer_id, name, value") -> str:
    return f"SELECT {columns}, rank FROM ({_RANKED.format(rows=rows, order=order)})"


_QUERIES = {
    "src01": "SELECT bout_id, event_id, date, red_id, blue_id, method, winner_id, rounds, end_round, round_time, kd_red, kd_blue, title, upcoming FROM bouts",
    "join03": "SELECT bout_id, boxer_id, opp_id, side, result, kd_for, kd_against FROM lb",
    "win07": "SELECT bout_id, boxer_id, pre, post, opp_pre FROM won",
    "agg01": "SELECT boxer_id, wins, losses, draws, kos, ko_losses, bouts, round(ko_rate, 6) AS ko_rate, round(win_rate, 6) AS win_rate, round(avg_rounds, 6) AS avg_rounds, last_fight, streak_type, streak, age FROM careers",
    "prj03": "SELECT boxer_id, archetype, wins || '-' || losses || '-' || draws AS record FROM careers",
    "agg02": """SELECT (SELECT count(*) FROM careers WHERE bouts > 0) AS fighters, (SELECT count(DISTINCT country) FROM careers WHERE bouts > 0) AS countries, count(*) AS bouts,
        round(count(*) FILTER (stopped) / count(*), 6) AS finish_rate, (SELECT count(*) FROM league_events WHERE NOT cancelled AND date <= DATE '2000-06-30') AS past_events FROM bouts WHERE counted""",
    "agg03": "SELECT division, count(*) AS bouts, round(count(*) FILTER (stopped) / count(*), 6) AS ko_rate FROM bouts WHERE counted GROUP BY ALL",
    "agg04": """SELECT v.method, count(b.bout_id) AS bouts FROM (SELECT unnest(['KO', 'TKO', 'RTD', 'DQ', 'UD', 'MD', 'SD', 'TD', 'DRAW', 'TDRAW', 'NC']) AS method) v LEFT JOIN bouts b USING (method) GROUP BY ALL""",
    "agg05": "SELECT year(date) AS year, count(*) AS total, count(*) FILTER (stopped) AS kos FROM bouts WHERE counted GROUP BY ALL",
    "agg06": """SELECT r AS round, count(bout_id) AS finishes FROM (SELECT unnest(range(1, 13)) AS r) LEFT JOIN (SELECT * FROM bouts WHERE stopped AND end_round IS NOT NULL) ON least(end_round, 12) = r GROUP BY ALL""",
    "agg07": """SELECT division, end_round, n AS finishes, round(n / sum(n) OVER (PARTITION BY division), 6) AS share FROM (SELECT division, end_round, count(*) AS n FROM bouts WHERE stopped AND end_round IS NOT NULL GROUP BY ALL)""",
    "agg08": "SELECT country, count(*) AS fighters, sum(wins)::BIGINT AS wins, sum(bouts)::BIGINT AS bouts, round(sum(wins) / sum(bouts), 6) AS win_rate FROM careers WHERE bouts > 0 GROUP BY ALL",
    "agg09": """SELECT count(*) FILTER (mixed) AS bouts, round(count(*) FILTER (mixed AND ws = 'Southpaw') / count(*) FILTER (mixed), 6) AS southpaw_share, count(*) FILTER (rs IS NOT NULL AND bs IS NOT NULL) AS known, count(*) AS all_bouts
        FROM (SELECT r.stance AS rs, u.stance AS bs, coalesce(r.stance <> u.stance, false) AND winner_id IS NOT NULL AS mixed, CASE WHEN winner_id = red_id THEN r.stance ELSE u.stance END AS ws
        FROM bouts JOIN fighters r ON red_id = r.boxer_id JOIN fighters u ON blue_id = u.boxer_id WHERE counted)""",
    "agg10": """SELECT count(*) AS bouts, round(count(*) FILTER ((winner_id = red_id) = (r.reach_cm > u.reach_cm)) / count(*), 6) AS longer_won
        FROM bouts JOIN fighters r ON red_id = r.boxer_id JOIN fighters u ON blue_id = u.boxer_id WHERE counted AND winner_id IS NOT NULL AND abs(r.reach_cm - u.reach_cm) >= 5""",
    "agg11": "SELECT bout_id, boxer_id, coalesce(sum(landed) FILTER (round = 0), sum(landed) FILTER (round > 0))::BIGINT AS landed, count(*) FILTER (round > 0) AS rounds FROM punches GROUP BY ALL",
    "agg12": """SELECT division, count(*) AS n, round(CASE WHEN count(made) > 0 THEN count(*) FILTER (NOT made) / count(made) ELSE 0 END, 6) AS miss_rate, round(avg(limit_lb - official_lb) FILTER (made), 6) AS avg_under,
        round(avg(night_lb - official_lb), 6) AS avg_gain, round(avg(night_lb), 6) AS avg_night FROM weights GROUP BY ALL""",
    "agg13": """SELECT CASE WHEN d < 0 THEN -s ELSE s END AS bucket, count(*) AS n, round(avg(CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END), 6) AS win_rate FROM (
        SELECT a.result, a.night_lb - b.night_lb AS d, CASE WHEN abs(a.night_lb - b.night_lb) >= 8 THEN 3 WHEN abs(a.night_lb - b.night_lb) >= 4 THEN 2 WHEN abs(a.night_lb - b.night_lb) >= 1.5 THEN 1 ELSE 0 END AS s
        FROM weights a JOIN weights b ON a.bout_id = b.bout_id AND a.opp_id = b.boxer_id WHERE a.night_lb IS NOT NULL AND b.night_lb IS NOT NULL AND a.result IN ('W', 'L')) GROUP BY ALL""",
    "agg14": """SELECT bout_id, boxer_id, date, round(official_lb - limit_lb, 6) AS over_lb, (SELECT count(*) FROM weights WHERE NOT made) AS total,
        (SELECT round(count(*) FILTER (result = 'W') / count(*) FILTER (result IN ('W', 'L')), 6) FROM weights WHERE NOT made) AS win_rate FROM weights WHERE NOT made ORDER BY date DESC, bout_id DESC, boxer_id LIMIT 25""",
    "agg15": "SELECT boxer_id, round(avg(night_lb - official_lb), 6) AS avg_gain, count(*) FILTER (NOT made) AS misses FROM weights GROUP BY ALL",
    "agg16": """SELECT judge_id, count(*) AS cards, round(CASE WHEN count(majority) > 0 THEN count(*) FILTER (vote = majority) / count(majority) ELSE 0 END, 6) AS agreement, count(*) FILTER (vote <> majority) AS dissents,
        round(avg(abs(red - blue)), 6) AS avg_margin FROM (SELECT *, sign(red - blue) AS vote, CASE WHEN count(*) FILTER (red < blue) OVER b >= 2 THEN -1 WHEN count(*) FILTER (red = blue) OVER b >= 2 THEN 0
        WHEN count(*) FILTER (red > blue) OVER b >= 2 THEN 1 END AS majority FROM cards WINDOW b AS (PARTITION BY bout_id)) GROUP BY ALL""",
    "agg18": "SELECT bout_id, max(red - blue) - min(red - blue) AS spread FROM cards GROUP BY ALL HAVING max(red - blue) > 0 AND min(red - blue) < 0 ORDER BY spread DESC, bout_id LIMIT 20",
    "agg20": """SELECT person_id, count(*) AS tenures, count(DISTINCT boxer_id) AS fighters, sum(w)::BIGINT AS wins, sum(l)::BIGINT AS losses, sum(d)::BIGINT AS draws, round(avg(b - a), 6) AS mean_change FROM (
        SELECT person_id, boxer_id, start, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'L') AS l, count(*) FILTER (result = 'D') AS d, arg_max(post, (date, bout_id)) AS b, arg_min(pre, (date, bout_id)) AS a
        FROM instint GROUP BY ALL) GROUP BY ALL""",
    "agg24": "SELECT bout_id, boxer_id, date, round(usd, 6) AS usd, basis FROM purse",
    "agg26": "SELECT boxer_id, round(sum(usd), 2) AS total, max(usd) AS biggest, round(sum(usd) FILTER (basis = 'disclosed') / sum(usd), 6) AS disclosed_share FROM purse WHERE usd IS NOT NULL GROUP BY ALL",
    "agg27": "SELECT bout_id, boxer_id, usd FROM purse WHERE usd > 0 ORDER BY usd DESC, bout_id, boxer_id LIMIT 20",
    "agg29": "SELECT year(date) AS year, round(sum(usd), 2) AS usd, count(usd) AS with_purse, count(*) AS of FROM purse GROUP BY ALL",
    "agg30": "SELECT place, count(*) AS fighters, count(*) FILTER (active) AS active FROM (SELECT active, unnest([country, r_name]) AS place FROM fighters JOIN region ON n_regionkey = r_regionkey) GROUP BY ALL",
    "agg31": "SELECT venue, country, count(*) AS events, count(*) FILTER (NOT cancelled AND date > DATE '2000-06-30') AS upcoming, max(date) AS last_date FROM league_events GROUP BY ALL",
    "agg32": " UNION ALL ".join(
        [f"SELECT '{c}' AS field, count({c}) AS have, count(*) AS of FROM fighters" for c in ("birth_year", "height_cm", "reach_cm", "stance")]
        + [f"SELECT '{c}', count({c}), count(*) FROM bouts WHERE method IS NOT NULL" for c in ("end_round", "round_time", "winner_id")]
    ),
    "agg33": """SELECT boxer_id, CASE WHEN count(end_round) = count(*) THEN sum(end_round) END::BIGINT AS rounds_boxed, count(*) FILTER (end_round = rounds AND NOT stopped) AS distance,
        count(*) FILTER (result = 'W' AND stopped AND end_round <= 3) AS quick_finishes, count(DISTINCT country) AS countries, CASE WHEN max(gap) >= 180 THEN max(gap) END AS longest_gap
        FROM (SELECT *, datediff('day', lag(date) OVER (PARTITION BY boxer_id ORDER BY date, bout_id), date) AS gap FROM won) GROUP BY ALL""",
    "agg34": """SELECT y.boxer_id, y.year, count(*) FILTER (result = 'W' AND stopped) AS ko, count(*) FILTER (result = 'W' AND method IN ('UD', 'MD', 'SD', 'TD')) AS decision, count(*) FILTER (result = 'W' AND method = 'DQ') AS other_win,
        count(*) FILTER (result = 'D') AS draw, count(*) FILTER (result = 'L') AS loss, count(bout_id) AS total
        FROM (SELECT boxer_id, unnest(range(min(year(date)), max(year(date)) + 1)) AS year FROM won GROUP BY boxer_id) y LEFT JOIN won w ON w.boxer_id = y.boxer_id AND year(w.date) = y.year GROUP BY ALL""",
    "agg35": """SELECT boxer_id, floor(avg(end_round) * 10 + 0.5) / 10 AS mean_round, count(*) AS finishes, min(m) AS mode_round FROM (SELECT *, first_value(end_round) OVER (PARTITION BY boxer_id ORDER BY n DESC, end_round) AS m FROM (
        SELECT boxer_id, end_round, count(*) OVER (PARTITION BY boxer_id, end_round) AS n FROM won WHERE result = 'W' AND stopped AND end_round IS NOT NULL)) GROUP BY boxer_id HAVING count(*) >= 3""",
    "agg36": "SELECT boxer_id, count(*) AS late_bouts, count(*) FILTER (result = 'W') AS late_wins FROM won WHERE end_round >= 8 GROUP BY ALL HAVING count(*) >= 3",
    "agg37": "SELECT boxer_id, round(avg(opp_pre), 6) AS mean_opponent, max(opp_pre) AS best_opponent, count(*) AS bouts FROM won GROUP BY ALL HAVING count(*) >= 5",
    "agg38": """SELECT a.boxer_id, sum(r.w)::BIGINT AS opp_wins, sum(r.l)::BIGINT AS opp_losses, count(*) AS opponents FROM (SELECT *, row_number() OVER (PARTITION BY boxer_id ORDER BY date DESC, bout_id DESC) AS n FROM won) a
        JOIN (SELECT bout_id, boxer_id, count(*) FILTER (result = 'W') OVER p AS w, count(*) FILTER (result = 'L') OVER p AS l FROM won WINDOW p AS (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) r
        ON r.bout_id = a.bout_id AND r.boxer_id = a.opp_id WHERE n <= 5 GROUP BY ALL""",
    "agg39": """SELECT boxer_id, floor(100 * reach_cm / avg(reach_cm) OVER p + 0.5)::BIGINT AS reach_index FROM fighters WHERE reach_cm IS NOT NULL WINDOW p AS (PARTITION BY division, sex) QUALIFY count(*) OVER p >= 10""",
    "agg40": """SELECT y.boxer_id, y.year, count(bout_id) AS bouts, count(bout_id) > count(end_round) AS missing
        FROM (SELECT boxer_id, unnest(range(min(year(date)), max(year(date)) + 1)) AS year FROM won GROUP BY boxer_id) y LEFT JOIN won w ON w.boxer_id = y.boxer_id AND year(w.date) = y.year GROUP BY ALL""",
    "agg41": """SELECT r.*, NOT f.active OR datediff('day', last_date, DATE '2000-06-30') > 547 AS dormant FROM (SELECT title_org, title, division, sex, arg_max(champion_id, reign_no) AS holder_id, max(last_date) AS last_date,
        count(DISTINCT champion_id) AS champions, max(days) AS longest_days, max(defences) AS most_defences, sum(defences)::BIGINT AS defences, count(*) AS reigns FROM reigns GROUP BY ALL) r JOIN fighters f ON holder_id = boxer_id""",
    "agg42": "SELECT *, NOT red_share BETWEEN 0.40 AND 0.75 AS outlier FROM (SELECT year(date) AS year, count(*) AS bouts, round(avg(CASE WHEN winner_id = red_id THEN 1.0 ELSE 0.0 END), 6) AS red_share FROM bouts WHERE winner_id IS NOT NULL GROUP BY ALL)",
    "agg43": "SELECT country, division, count(*) AS n FROM fighters GROUP BY ALL HAVING count(*) < 30",
    "agg44": "SELECT division, result, count(*) AS n, round(median(night_lb - official_lb), 6) AS median_gain, round(max(night_lb - official_lb), 6) AS max_gain FROM weights WHERE night_lb IS NOT NULL GROUP BY ALL",
    "join04": "SELECT boxer_id, name FROM fighters WHERE boxer_id IN (SELECT boxer_id FROM weights WHERE NOT made)",
    "join05": "SELECT 'fighter' AS kind, boxer_id AS id FROM fighters WHERE boxer_id NOT IN (SELECT boxer_id FROM lb) UNION ALL SELECT 'event', event_id FROM league_events WHERE event_id NOT IN (SELECT event_id FROM bouts)",
    "join06": """SELECT least(red_id, blue_id) AS a_id, greatest(red_id, blue_id) AS b_id, count(*) AS met, count(*) FILTER (winner_id = least(red_id, blue_id)) AS a_won, count(*) FILTER (winner_id = greatest(red_id, blue_id)) AS b_won
        FROM bouts WHERE counted GROUP BY 1, 2 HAVING count(*) >= 3""",
    "join07": """SELECT a.opp_id, a.met AS a_met, a.won AS a_won, b.met AS b_met, b.won AS b_won FROM (SELECT opp_id, count(*) AS met, count(*) FILTER (result = 'W') AS won FROM won WHERE boxer_id = 4 GROUP BY ALL) a
        JOIN (SELECT opp_id, count(*) AS met, count(*) FILTER (result = 'W') AS won FROM won WHERE boxer_id = 52 GROUP BY ALL) b USING (opp_id) WHERE opp_id NOT IN (4, 52)""",
    "join08": 'SELECT bout_id, boxer_id, person_id, start, "end" FROM instint',
    "join09": "SELECT bout_id, boxer_id, arg_min(person_id, (start, person_id)) AS trainer_id FROM instint GROUP BY ALL",
    "join14": "SELECT a.boxer_id AS a_id, b.boxer_id AS b_id, abs(a.rating - b.rating) AS gap FROM ranking a JOIN ranking b ON a.rank < b.rank AND b.rank <= 8 AND a.division = 'BUILDING' AND b.division = 'BUILDING' AND a.sex = 'male' AND b.sex = 'male'",
    "join15": """SELECT c.boxer_id, abs(c.rating - m.rating) AS gap FROM careers c JOIN careers m ON m.boxer_id = 6 AND c.division = m.division AND c.sex = m.sex WHERE c.boxer_id <> 6 AND c.bouts >= 4 AND c.active AND abs(c.rating - m.rating) <= 100
        AND c.boxer_id NOT IN (SELECT opp_id FROM lb WHERE boxer_id = 6) AND c.boxer_id NOT IN (SELECT boxer_id FROM lb WHERE upcoming AND date <= DATE '2000-07-14')""",
    "join16": """SELECT of_id, rank, boxer_id, greatest(0, floor(100 - 38 * d + 0.5))::BIGINT AS match FROM (SELECT *, row_number() OVER (PARTITION BY of_id ORDER BY d, boxer_id) AS rank FROM (
        SELECT a.boxer_id AS of_id, b.boxer_id, round(sqrt((a.ko_rate - b.ko_rate) ** 2 + (a.win_rate - b.win_rate) ** 2 + (coalesce((a.age - 30) / 8, 0) - coalesce((b.age - 30) / 8, 0)) ** 2 + (a.avg_rounds / 12 - b.avg_rounds / 12) ** 2
        + ((coalesce(a.stance, '') = 'Southpaw')::INT - (coalesce(b.stance, '') = 'Southpaw')::INT) ** 2 + ((a.rating - b.rating) / 200) ** 2), 9) AS d
        FROM careers a JOIN careers b ON a.sex = b.sex AND a.boxer_id <> b.boxer_id WHERE a.bouts >= 5 AND b.bouts >= 5 AND a.boxer_id % 20 = 0)) WHERE rank <= 5""",
    "join18": "SELECT boxer_id, count(event_id) AS cards, count(*) FILTER (cancelled) AS cancelled FROM fighters LEFT JOIN league_events ON boxer_id = host_id GROUP BY ALL",
    "win01": "SELECT division, sex, boxer_id, rating, rank FROM ranking",
    "win02": """SELECT division, sex, boxer_id, rank, row_number() OVER (PARTITION BY division, sex ORDER BY old DESC, boxer_id) - rank AS moved, rating - old AS rating_change FROM ranking
        JOIN (SELECT boxer_id, coalesce(arg_max(post, (date, bout_id)), 1500) AS old FROM fighters LEFT JOIN (SELECT * FROM won WHERE date <= DATE '2000-06-30' - INTERVAL 91 DAY) USING (boxer_id) GROUP BY ALL) USING (boxer_id)""",
    "win03": "SELECT boxer_id, sex, division, rating FROM eligible WHERE bouts >= 8 ORDER BY rating DESC, boxer_id LIMIT 20",
    "win04": """SELECT bout_id, boxer_id, count(*) FILTER (result = 'W') OVER p AS wins_before, count(*) FILTER (result = 'L') OVER p AS losses_before, count(*) OVER p AS bouts_before, count(*) FILTER (result = 'W' AND stopped) OVER p AS kos_before,
        count(*) FILTER (result = 'L' AND stopped) OVER p AS ko_losses_before, datediff('day', lag(date) OVER (PARTITION BY boxer_id ORDER BY date, bout_id), date) AS days_idle
        FROM won WINDOW p AS (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "win06_all_time": "SELECT * FROM runs",
    "win06_analytics": """SELECT boxer_id, max(n) AS longest FROM (SELECT boxer_id, run, count(*) AS n FROM (SELECT boxer_id, result, count(*) FILTER (result <> 'W') OVER (PARTITION BY boxer_id ORDER BY date, bout_id) AS run FROM won) WHERE result = 'W' GROUP BY ALL) GROUP BY ALL""",
    "win06_losses": """SELECT boxer_id, max(n) AS longest FROM (SELECT boxer_id, run, count(*) AS n FROM (SELECT boxer_id, result, count(*) FILTER (result <> 'L') OVER (PARTITION BY boxer_id ORDER BY date, bout_id) AS run FROM won) WHERE result = 'L' GROUP BY ALL) GROUP BY ALL""",
    "win08": 'SELECT title_org, title, division, sex, reign_no::BIGINT AS reign_no, champion_id, start, "end", how, ended_by, from_id, defences, days FROM reigns',
    "win09": "SELECT * FROM acc",
    "win12": "SELECT boxer_id, string_agg(result, '' ORDER BY n) AS form FROM (SELECT boxer_id, result, row_number() OVER (PARTITION BY boxer_id ORDER BY date DESC, bout_id DESC) AS n FROM won) WHERE n <= 5 GROUP BY ALL",
    "win13": """SELECT boxer_id, start, person_id, before_id FROM (SELECT *, lag(person_id) OVER (PARTITION BY boxer_id ORDER BY start) AS before_id FROM stints) WHERE before_id <> person_id AND start >= DATE '2000-06-30' - INTERVAL 2736 DAY AND start <= DATE '2000-06-30'""",
    "win14": "SELECT boxer_id, max(gap) AS longest_gap FROM (SELECT boxer_id, datediff('day', lag(date) OVER (PARTITION BY boxer_id ORDER BY date, bout_id), date) AS gap FROM won) GROUP BY ALL HAVING max(gap) IS NOT NULL",
    "win16": """SELECT bout_id, year, importance, n > 3 AS over_cap FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY importance DESC, bout_id) AS n FROM (SELECT bout_id, year(date) AS year,
        CASE WHEN title IS NOT NULL THEN 100 ELSE 0 END + rounds AS importance FROM bouts WHERE counted AND month(date) = 6 AND day(date) = 30)) ORDER BY n > 3, importance DESC, bout_id LIMIT 20""",
    "win21": """SELECT division, sex, count(*) FILTER (n <= floor(of * 0.75)) AS train, count(*) AS total FROM (SELECT division, sex, row_number() OVER (PARTITION BY division, sex ORDER BY date, bout_id) AS n, count(*) OVER (PARTITION BY division, sex) AS of FROM bouts WHERE counted) GROUP BY ALL""",
    "flt07": "SELECT boxer_id FROM (SELECT *, row_number() OVER (PARTITION BY boxer_id ORDER BY date DESC, bout_id DESC) AS n FROM won) WHERE n <= 3 GROUP BY ALL HAVING count(*) = 3 AND count(*) FILTER (result = 'L') = 0",
    "flt21": "SELECT boxer_id, rating FROM eligible",
    "rec01": _ranked("""SELECT boxer_id, name, rating, floor(round(100 * (0.30 * least(1, greatest(0, (peak - 1500) / 300)) + 0.25 * least(1, quality_wins / 8) + 0.15 * least(1, reign_days / 2920) + 0.10 * least(1, defences / 15)
        + 0.10 * least(1, win_streak / 30)) / 0.9, 9) + 0.5)::BIGINT AS value FROM careers JOIN acc USING (boxer_id) WHERE bouts >= 10""", "value DESC, rating DESC, name"),
    "rec02": _ranked("SELECT boxer_id, name, floor(peak + 0.5)::BIGINT AS value FROM careers JOIN acc USING (boxer_id) WHERE bouts > 0 AND sex = 'female'", "value DESC, name"),
    "rec03": _ranked("SELECT boxer_id, name, wins AS value FROM careers WHERE wins > 0", "value DESC, name"),
    "rec04": _ranked("SELECT boxer_id, name, kos AS value FROM careers WHERE kos > 0 AND division = 'BUILDING'", "value DESC, name"),
    "rec05": _ranked("SELECT boxer_id, name, kos / wins AS v, wins FROM careers WHERE wins >= 15", "v DESC, wins DESC, name", "boxer_id, name, round(v, 6) AS value"),
    "rec06": _ranked("SELECT boxer_id, name, win_streak AS value FROM careers JOIN acc USING (boxer_id) WHERE win_streak > 0", "value DESC, name"),
    "rec07": _ranked("SELECT boxer_id, name, quality_wins AS value FROM careers JOIN acc USING (boxer_id) WHERE quality_wins > 0", "value DESC, name"),
    "rec08": _ranked("SELECT boxer_id, name, title_wins AS value FROM careers JOIN acc USING (boxer_id) WHERE title_wins > 0", "value DESC, name"),
    "rec09": _ranked("SELECT boxer_id, name, defences AS value FROM careers JOIN acc USING (boxer_id) WHERE defences > 0", "value DESC, name"),
    "rec10": _ranked("SELECT boxer_id, name, divisions AS value FROM careers JOIN acc USING (boxer_id) WHERE divisions > 1", "value DESC, name"),
    "rec11": _ranked("SELECT r.* EXCLUDE (days), counted_days AS days, name, champion_id AS boxer_id, counted_days AS value FROM reigns r JOIN fighters f ON champion_id = f.boxer_id WHERE counted_days > 0", "value DESC, days DESC, name, title_org, title, division, sex, reign_no", "boxer_id, name, title_org, title, division, sex, reign_no::BIGINT AS reign_no, value"),
    "rec12": _ranked("SELECT r.* EXCLUDE (days), counted_days AS days, name, champion_id AS boxer_id, defences AS value FROM reigns r JOIN fighters f ON champion_id = f.boxer_id WHERE defences > 0", "value DESC, days DESC, name, title_org, title, division, sex, reign_no", "boxer_id, name, title_org, title, division, sex, reign_no::BIGINT AS reign_no, value"),
    "rec15": """SELECT bout_id, date, (end_round - 1) * 180 + split_part(round_time, ':', 1)::INT * 60 + split_part(round_time, ':', 2)::INT AS seconds FROM bouts WHERE stopped AND round_time IS NOT NULL AND end_round IS NOT NULL ORDER BY seconds, date, bout_id LIMIT 25""",
    "rec16": "SELECT bout_id, date, kd_red + kd_blue AS knockdowns FROM bouts WHERE method IS NOT NULL AND kd_red + kd_blue >= 2 ORDER BY knockdowns DESC, date DESC, bout_id LIMIT 25",
    "vw08": "SELECT bout_id, boxer_id, opp_id, opp_pre - pre AS gap FROM won WHERE result = 'W' AND pre <> 1500 AND opp_pre <> 1500 AND opp_pre > pre ORDER BY gap DESC, bout_id LIMIT 200",
}

_HELD = """(SELECT bout_id, cancelled, CASE WHEN bout_id % 5 <> 0 THEN method END AS method, winner_id, CASE WHEN bout_id % 4 <> 0 THEN end_round END AS end_round, round_time FROM bouts WHERE bout_id % 7 <> 0)"""
_GIVEN = """(SELECT bout_id, cancelled, CASE WHEN bout_id % 11 <> 0 THEN method END AS method, winner_id, end_round, CASE WHEN bout_id % 3 <> 0 THEN round_time END AS round_time FROM bouts WHERE bout_id % 9 <> 0)"""
_CHANGES = f"""SELECT bout_id, u.field, u.old, u.new, CASE WHEN u.old IS NULL THEN 'fill' WHEN u.new IS NULL THEN 'clear' ELSE 'replace' END AS kind FROM (
    SELECT h.bout_id, unnest([{{'field': 'method', 'old': h.method, 'new': g.method}}, {{'field': 'winner_id', 'old': h.winner_id::VARCHAR, 'new': g.winner_id::VARCHAR}},
    {{'field': 'end_round', 'old': h.end_round::VARCHAR, 'new': g.end_round::VARCHAR}}, {{'field': 'round_time', 'old': h.round_time, 'new': g.round_time}}]) AS u
    FROM {_HELD} h JOIN {_GIVEN} g USING (bout_id)) WHERE u.old IS DISTINCT FROM u.new"""
_FEED = """fb0 AS (SELECT boxer_id AS k, CASE WHEN boxer_id % 211 = 5 THEN NULL WHEN boxer_id % 97 = 1 THEN 'b' || (boxer_id - 1) ELSE 'b' || boxer_id END AS id, * FROM fighters),
fb1 AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS nth FROM fb0),
fb2 AS (SELECT *, CASE WHEN id IS NULL THEN 'missing_id' WHEN nth > 1 THEN 'dup_id' WHEN k % 61 = 2 THEN 'unknown_division' END AS err, CASE WHEN k % 43 = 3 THEN 300 ELSE height_cm END AS h, CASE WHEN k % 47 = 4 THEN 90 WHEN k % 53 = 6 THEN height_cm + 40 ELSE reach_cm END AS r FROM fb1),
fb AS (SELECT * FROM fb2 WHERE err IS NULL),
fe AS (SELECT 'e' || event_id AS id, date AS day FROM league_events WHERE event_id % 89 <> 1),
fx0 AS (SELECT bout_id AS k, CASE WHEN bout_id % 1009 = 1 THEN NULL ELSE 'x' || bout_id END AS id, CASE WHEN bout_id % 113 = 2 THEN 'e-1' ELSE 'e' || event_id END AS event, 'b' || red_id AS red, CASE WHEN bout_id % 127 = 3 THEN 'b' || red_id ELSE 'b' || blue_id END AS blue, cancelled,
    CASE WHEN bout_id % 131 = 4 THEN 'XX' WHEN upcoming AND bout_id % 13 = 1 THEN 'KO' WHEN cancelled AND bout_id % 3 = 0 THEN 'UD' ELSE method END AS method, CASE WHEN bout_id % 137 = 5 THEN 99 ELSE rounds END AS rounds, CASE WHEN bout_id % 139 = 6 THEN rounds + 1 ELSE end_round END AS end_round,
    CASE WHEN bout_id % 149 = 7 THEN NULL WHEN bout_id % 151 = 8 THEN 'b999999999' WHEN (upcoming AND bout_id % 13 = 1) OR (cancelled AND bout_id % 3 = 0) THEN 'b' || red_id ELSE 'b' || winner_id END AS winner, kd_red FROM bouts),
fx1 AS (SELECT x.*, e.day, CASE WHEN x.id IS NULL THEN 'missing_id' WHEN e.id IS NULL OR r.id IS NULL OR u.id IS NULL THEN 'bad_reference' WHEN red = blue THEN 'same_fighter' WHEN x.k % 107 = 4 THEN 'unknown_division' WHEN method = 'XX' THEN 'unknown_method' WHEN rounds = 99 OR end_round > rounds OR end_round < 1 THEN 'bad_round'
    WHEN (method IS NULL AND winner IS NOT NULL) OR (method IN ('DRAW', 'TDRAW', 'NC') AND winner IS NOT NULL) OR (method NOT IN ('DRAW', 'TDRAW', 'NC') AND winner IS NULL) THEN 'result_inconsistent' WHEN winner NOT IN (red, blue) THEN 'winner_not_in_bout' END AS err
    FROM fx0 x LEFT JOIN fe e ON e.id = event LEFT JOIN fb r ON r.id = red LEFT JOIN fb u ON u.id = blue),
fx AS (SELECT * FROM fx1 WHERE err IS NULL),
fs0 AS (SELECT boxer_id || '#' || year(start) AS ref, 'b' || boxer_id AS boxer, boxer_id AS k, person_id, strftime(start, '%Y-%m-%d') AS s0, strftime(CASE WHEN boxer_id % 17 = 5 THEN start - 9 WHEN boxer_id % 5 = 0 THEN "end" + 365 ELSE "end" END, '%Y-%m-%d') AS fin FROM stints),
fs1 AS (SELECT *, CASE WHEN k % 19 = 4 THEN '1999-13-01' ELSE s0 END AS since, CASE WHEN k % 31 = 2 THEN NULL WHEN k % 23 = 3 THEN 'p-1' ELSE 'p' || person_id END AS person FROM fs0),
fs2 AS (SELECT *, CASE WHEN boxer NOT IN (SELECT id FROM fb) THEN 'bad_reference' WHEN k % 29 <> 1 AND person IS NULL THEN 'stint_no_entity' WHEN k % 29 = 1 THEN 'unknown_role' WHEN person = 'p-1' THEN 'bad_reference' WHEN k % 19 = 4 THEN 'bad_date' WHEN fin < since THEN 'stint_bad_dates' END AS err FROM fs1),
fs AS (SELECT *, lag(fin) OVER o AS before, row_number() OVER o AS n FROM fs2 WHERE err IS NULL WINDOW o AS (PARTITION BY boxer ORDER BY since, ref)),
fw AS (SELECT 'x' || bout_id || '/b' || boxer_id AS ref, CASE WHEN bout_id % 173 = 1 THEN 'b6' ELSE 'b' || boxer_id END AS boxer, x.id AS bout, x.red, x.blue, CASE WHEN bout_id % 179 = 2 THEN 30.0 ELSE official_lb END AS o,
    CASE WHEN bout_id % 181 = 3 THEN official_lb - 10 WHEN bout_id % 191 = 4 THEN official_lb + 50 ELSE night_lb END AS night, CASE WHEN bout_id % 193 = 5 THEN limit_lb + 20 ELSE limit_lb END AS lim, limit_lb AS std, CASE WHEN bout_id % 197 = 6 THEN NOT made ELSE made END AS made
    FROM weights LEFT JOIN fx x ON x.id = 'x' || bout_id),
fw1 AS (SELECT *, CASE WHEN bout IS NULL OR boxer NOT IN (SELECT id FROM fb) THEN 'bad_reference' WHEN boxer NOT IN (red, blue) THEN 'not_in_bout' END AS err FROM fw),
fc AS (SELECT 'x' || c.bout_id || '#' || seat AS ref, x.id AS bout, x.method, x.winner, x.red AS rid, x.blue AS uid, CASE WHEN c.bout_id % 227 = 4 THEN 'p-1' ELSE 'p' || (judge_id % 10) END AS judge, CASE WHEN c.bout_id % 199 = 1 AND seat = 3 THEN 2 ELSE seat END AS seat,
    CASE WHEN c.bout_id % 241 = 2 AND seat = 1 THEN 200 ELSE c.red END AS r, c.blue AS u, CASE WHEN x.method IN ('TD', 'TDRAW') AND x.end_round IS NOT NULL THEN x.end_round ELSE x.rounds END AS scored FROM cards c LEFT JOIN fx x ON x.id = 'x' || c.bout_id WHERE NOT (c.bout_id % 223 = 3 AND seat = 3)),
fc1 AS (SELECT *, CASE WHEN bout IS NULL OR judge = 'p-1' OR judge NOT IN (SELECT 'p' || s_suppkey FROM supplier) THEN 'bad_reference' END AS err, CASE WHEN r > u THEN rid WHEN u > r THEN uid ELSE 'even' END AS side FROM fc),
fc2 AS (SELECT bout, method, winner, count(*) AS n, count(DISTINCT seat) AS seats, bool_or(greatest(r, u) > 10 * scored OR least(r, u) < 6 * scored) AS wide, count(*) FILTER (side = winner) AS won, count(*) FILTER (side = 'even') AS ev, count(*) FILTER (side = rid) AS rr, count(*) FILTER (side = uid) AS uu
    FROM fc1 WHERE err IS NULL GROUP BY ALL),
fp AS (SELECT 'x' || p.bout_id || '/b' || boxer_id || '/r' || round // 7 AS ref, CASE WHEN x.id IS NULL OR 'b' || boxer_id NOT IN (SELECT id FROM fb) THEN 'bad_reference' END AS err, p.bout_id % 229 = 1 AS odd FROM punches p LEFT JOIN fx x ON x.id = 'x' || p.bout_id),
fk AS (SELECT 'x' || bout_id || '/b' || boxer_id AS ref, CASE WHEN bout_id % 233 = 1 THEN 'b6' ELSE 'b' || boxer_id END AS boxer, CASE WHEN bout_id % 239 = 2 THEN 'p-1' ELSE 'p' || (boxer_id % 5) END AS person, x.id AS bout, x.red, x.blue FROM won LEFT JOIN fx x ON x.id = 'x' || bout_id),
fk1 AS (SELECT *, CASE WHEN bout IS NULL OR boxer NOT IN (SELECT id FROM fb) OR person = 'p-1' OR person NOT IN (SELECT 'p' || s_suppkey FROM supplier) THEN 'bad_reference' END AS err FROM fk),
issues AS (
    SELECT 'error' AS severity, err AS code, 'boxer' AS entity, coalesce(id, '(blank)') AS id FROM fb2 WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'implausible_height', 'boxer', id FROM fb WHERE h NOT BETWEEN 120 AND 230
    UNION ALL SELECT 'warning', 'implausible_reach', 'boxer', id FROM fb WHERE r NOT BETWEEN 120 AND 250
    UNION ALL SELECT 'warning', 'reach_height_mismatch', 'boxer', id FROM fb WHERE r BETWEEN 120 AND 250 AND r - h NOT BETWEEN -12 AND 25
    UNION ALL SELECT 'warning', 'debut_age', 'boxer', id FROM fb WHERE k % 37 = 0 AND birth_year IS NOT NULL
    UNION ALL SELECT 'warning', 'retired_before_debut', 'boxer', id FROM fb WHERE k % 59 = 7 AND birth_year IS NOT NULL
    UNION ALL SELECT 'warning', 'unknown_sex', 'boxer', id FROM fb WHERE k % 67 = 8
    UNION ALL SELECT 'warning', 'bad_birth_date', 'boxer', id FROM fb WHERE k % 71 = 9
    UNION ALL SELECT 'error', 'bad_date', 'event', 'e' || event_id FROM league_events WHERE event_id % 89 = 1
    UNION ALL SELECT 'error', err, 'bout', coalesce(id, '(blank)') FROM fx1 WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'result_in_future', 'bout', id FROM fx WHERE method IS NOT NULL AND day > DATE '2000-06-30' AND NOT cancelled
    UNION ALL SELECT 'warning', 'result_on_cancelled', 'bout', id FROM fx WHERE method IS NOT NULL AND cancelled
    UNION ALL SELECT 'warning', 'missing_end_round', 'bout', id FROM fx WHERE method IN ('KO', 'TKO', 'RTD', 'DQ', 'TD', 'TDRAW') AND end_round IS NULL
    UNION ALL SELECT 'warning', 'odds_invalid', 'bout', id FROM fx WHERE k % 157 = 9
    UNION ALL SELECT 'warning', 'kd_negative', 'bout', id FROM fx WHERE k % 163 = 10
    UNION ALL SELECT 'warning', 'fighter_double_booked', 'boxer', who FROM (SELECT unnest([red, blue]) AS who, day FROM fx WHERE NOT cancelled) GROUP BY who, day HAVING count(*) > 1
    UNION ALL SELECT 'error', err, 'stint', ref FROM fs2 WHERE err IS NOT NULL
    UNION ALL SELECT DISTINCT 'warning', 'head_trainer_overlap', 'boxer', boxer FROM fs WHERE n > 1 AND (before IS NULL OR since < before)
    UNION ALL SELECT 'error', err, 'weigh_in', ref FROM fw1 WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'weight_implausible', 'weigh_in', ref FROM fw1 WHERE err IS NULL AND o NOT BETWEEN 80 AND 400
    UNION ALL SELECT 'warning', 'fight_night_below_official', 'weigh_in', ref FROM fw1 WHERE err IS NULL AND night < o - 6
    UNION ALL SELECT 'warning', 'rehydration_implausible', 'weigh_in', ref FROM fw1 WHERE err IS NULL AND night > o + 40
    UNION ALL SELECT 'warning', 'limit_mismatch', 'weigh_in', ref FROM fw1 WHERE err IS NULL AND abs(lim - std) > 8
    UNION ALL SELECT 'warning', 'made_weight_inconsistent', 'weigh_in', ref FROM fw1 WHERE err IS NULL AND ((made AND o > lim + 0.05) OR (NOT made AND o <= lim))
    UNION ALL SELECT 'error', err, 'scorecard', ref FROM fc1 WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'scorecard_duplicate_seat', 'bout', bout FROM fc2 WHERE seats < n
    UNION ALL SELECT 'warning', 'scorecard_range', 'bout', bout FROM fc2 WHERE wide
    UNION ALL SELECT 'warning', 'scorecard_incomplete', 'bout', bout FROM fc2 WHERE method IN ('UD', 'MD', 'SD', 'TD', 'DRAW', 'TDRAW') AND n <> 3
    UNION ALL SELECT 'warning', 'scorecard_result_mismatch', 'bout', bout FROM fc2 WHERE n = 3 AND NOT CASE method WHEN 'UD' THEN won = 3 WHEN 'MD' THEN won = 2 AND ev = 1 WHEN 'SD' THEN won = 2 AND ev = 0 WHEN 'TD' THEN won >= 2 WHEN 'DRAW' THEN ev >= 2 OR (rr = 1 AND uu = 1) WHEN 'TDRAW' THEN ev >= 2 OR (rr = 1 AND uu = 1) ELSE true END
    UNION ALL SELECT 'error', err, 'punch_stat', ref FROM fp WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'punch_inconsistent', 'punch_stat', ref FROM fp WHERE err IS NULL AND odd
    UNION ALL SELECT 'error', err, 'corner', ref FROM fk1 WHERE err IS NOT NULL
    UNION ALL SELECT 'warning', 'corner_not_in_bout', 'corner', ref FROM fk1 WHERE err IS NULL AND boxer NOT IN (red, blue)
    UNION ALL SELECT 'warning', 'event_emptied', 'event', id FROM fe WHERE id IN (SELECT event FROM fx1 WHERE err IS DISTINCT FROM 'missing_id') AND id NOT IN (SELECT event FROM fx)
    UNION ALL SELECT 'info', 'orphan_people', 'person', n::VARCHAR FROM (SELECT count(*) AS n FROM supplier WHERE 'p' || s_suppkey NOT IN (SELECT person FROM fs UNION SELECT judge FROM fc1 WHERE err IS NULL UNION SELECT person FROM fk1 WHERE err IS NULL)) WHERE n > 0)"""
_CALLS = """calls0 AS (
    SELECT b.bout_id, b.date, b.division, r.pre AS ra, r.opp_pre AS rb, b.winner_id = b.red_id AS red_won, CASE WHEN r.pre = r.opp_pre THEN b.bout_id % 2 = 0 ELSE r.pre > r.opp_pre END AS red_fav
    FROM bouts b JOIN (SELECT *, row_number() OVER (PARTITION BY boxer_id ORDER BY date, bout_id) AS nth FROM won) r ON r.bout_id = b.bout_id AND r.boxer_id = b.red_id AND r.nth > 1
    JOIN (SELECT *, row_number() OVER (PARTITION BY boxer_id ORDER BY date, bout_id) AS nth FROM won) u ON u.bout_id = b.bout_id AND u.boxer_id = b.blue_id AND u.nth > 1
    WHERE b.winner_id IS NOT NULL),
calls AS (SELECT *, CASE WHEN "right" THEN chance ELSE 1 / (1 + pow(10, gap / 400)) END AS pw FROM (
    SELECT bout_id, date, division, gap, 1 / (1 + pow(10, -gap / 400)) AS chance, red_won = red_fav AS "right" FROM (SELECT *, abs(ra - rb) AS gap FROM calls0)))"""
_FEATURES = """feat AS (SELECT boxer_id, rating, reach_cm, age, ko_rate, CASE WHEN bouts > 0 THEN ko_losses / bouts ELSE 0 END AS chin, coalesce(datediff('day', last_fight, DATE '2000-06-30') / 30.4, 24) AS idle FROM careers),
chances0 AS (
    SELECT bout_id, red_id, blue_id, ln(10) / 400 * (a.rating - b.rating) AS t_rating, coalesce(0.016 * least(12, greatest(-12, a.reach_cm - b.reach_cm)), 0) * (a.reach_cm IS NOT NULL AND b.reach_cm IS NOT NULL)::INT
        + CASE WHEN a.age IS NOT NULL AND b.age IS NOT NULL THEN 0.03 * (greatest(0, b.age - 34) - greatest(0, a.age - 34)) ELSE 0 END + 0.01 * (greatest(0, b.idle - 12) - greatest(0, a.idle - 12))
        + 0.2 * (a.ko_rate - b.ko_rate) + 0.2 * (b.chin - a.chin) AS t_rest, least(0.85, greatest(0.1, 0.22 + 0.35 * (a.ko_rate + b.ko_rate) + 0.2 * (a.chin + b.chin))) AS p_stop
    FROM bouts JOIN feat a ON red_id = a.boxer_id JOIN feat b ON blue_id = b.boxer_id WHERE upcoming),
chances AS (SELECT *, 0.97 * least(0.96, greatest(0.04, 1 / (1 + exp(-(t_rating + t_rest))))) AS p_red FROM chances0)"""
_SCORES = """card AS (SELECT bout_id, avg(abs(red - blue)) AS margin, count(DISTINCT sign(red - blue)) > 1 AS split FROM cards GROUP BY ALL),
total AS (SELECT bout_id, boxer_id, coalesce(sum(landed) FILTER (round = 0), sum(landed) FILTER (round > 0)) AS landed, count(*) FILTER (round > 0) AS rounds FROM punches GROUP BY ALL),
rate AS (SELECT t.bout_id, round(sum(landed) / max(t.rounds), 6) AS per_round, sum(landed) FILTER (boxer_id = red_id) / sum(landed) AS red_share FROM total t JOIN bouts b USING (bout_id) GROUP BY ALL),
pct AS (SELECT *, (rank() OVER (ORDER BY per_round) - 1) / count(*) OVER () AS percentile FROM rate),
fact AS (
    SELECT b.*, w.pre AS ra, w.opp_pre AS rb, 1 / (1 + pow(10, (w.opp_pre - w.pre) / 400)) AS p, margin, split, percentile, red_share
    FROM bouts b JOIN won w ON w.bout_id = b.bout_id AND w.side = 'red' LEFT JOIN card c ON c.bout_id = b.bout_id LEFT JOIN pct ON pct.bout_id = b.bout_id WHERE b.counted AND b.method <> 'DQ' AND b.rounds >= 6),
part AS (
    SELECT bout_id, date, division, 0.7 * least(1, (kd_red + kd_blue) / 4) + CASE WHEN kd_red > 0 AND kd_blue > 0 THEN 0.3 ELSE 0 END AS k,
        CASE WHEN method IN ('DRAW', 'TDRAW') THEN 1 WHEN stopped THEN 0.25 + 0.75 * pow(coalesce(least(1, greatest(0, (end_round - 1) / (rounds - 1))), 0), 1.5)
            WHEN margin IS NOT NULL THEN CASE WHEN split THEN greatest(0.85, 1 - least(1, margin / (rounds * 0.4))) ELSE 1 - least(1, margin / (rounds * 0.4)) END END AS f,
        0.65 * percentile + 0.35 * (1 - abs(2 * red_share - 1)) AS a, 0.5 * (1 - abs(2 * p - 1)) + 0.5 * least(1, greatest(0, ((ra + rb) / 2 - 1500) / 250)) AS m,
        CASE WHEN winner_id IS NULL THEN 0 ELSE least(1, greatest(0, (0.5 - CASE WHEN winner_id = red_id THEN p ELSE 1 - p END) / 0.35)) END AS u,
        CASE WHEN title IS NULL THEN 0 ELSE least(1, 0.6 + CASE WHEN title LIKE 'World%' THEN 0.25 ELSE 0 END + CASE WHEN title_vacant THEN 0.15 ELSE 0 END) END AS s,
        CASE WHEN winner_id IS NULL THEN 0 ELSE least(1, CASE WHEN winner_id = red_id THEN kd_red ELSE kd_blue END / 2) END AS c FROM fact),
scores0 AS (
    SELECT *, 0.63 - 0.03 + 0 AS unused, 0.17 + CASE WHEN f IS NULL THEN 0 ELSE 0.20 END + CASE WHEN a IS NULL THEN 0 ELSE 0.20 END + 0.16 + 0.09 + 0.08 + 0.10 AS weight,
        0.17 * k + 0.20 * coalesce(f, 0) + 0.20 * coalesce(a, 0) + 0.16 * m + 0.09 * u + 0.08 * s + 0.10 * c AS total FROM part),
scores AS (SELECT bout_id, date, division, floor(round(100 * total / weight, 9) + 0.5)::BIGINT AS score, round(weight::DOUBLE, 6) AS coverage FROM scores0)"""

_MORE = {
    "flt01": "SELECT boxer_id, wins, losses, rating, height_cm FROM careers WHERE sex = 'male' AND active AND wins >= 20 AND floor(rating + 0.5) >= 1500 AND height_cm >= 165 AND losses <= 40 AND last_fight >= DATE '2000-01-01'",
    "flt03": "SELECT boxer_id FROM careers WHERE losses = 0 AND bouts > 0",
    "flt06": "SELECT boxer_id, streak FROM careers WHERE streak_type = 'W' AND streak >= 3",
    "flt12": "SELECT boxer_id FROM careers WHERE archetype = 'Counter-Puncher'",
    "flt13": "SELECT boxer_id, name FROM fighters WHERE name LIKE '%0012%'",
    "flt14": "SELECT DISTINCT boxer_id FROM stints WHERE person_id = 3",
    "flt15": """SELECT boxer_id FROM fighters WHERE stance = 'Southpaw' AND boxer_id IN (SELECT champion_id FROM reigns) AND boxer_id NOT IN (SELECT champion_id FROM reigns WHERE "end" IS NULL) AND boxer_id IN (SELECT boxer_id FROM weights WHERE NOT made)""",
    "flt17": "SELECT bout_id, date, method, rounds FROM bouts WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31' AND division = 'BUILDING' AND title IS NOT NULL AND rounds >= 8 AND stopped",
    "ord01": "SELECT boxer_id, reach_cm FROM fighters",
    "ord06": "SELECT boxer_id, rating, (SELECT count(*) FROM careers) AS total FROM careers ORDER BY rating DESC, boxer_id LIMIT 25 OFFSET 50",
    "srch01": "SELECT p_partkey AS id, p_name AS name, CASE WHEN starts_with(lower(p_name), 're') THEN 0 WHEN contains(' ' || lower(p_name), ' re') THEN 1 ELSE 2 END AS rank FROM part WHERE contains(lower(p_name), 're') ORDER BY rank, name, id LIMIT 10",
    "srch03": """SELECT word, count(DISTINCT p_partkey) AS names FROM (SELECT p_partkey, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1]))) AS word
        FROM (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[\\s\\-.,'']+'), lambda x: x <> '') AS w FROM part)) GROUP BY ALL""",
    "srch04": """SELECT kind, id, name FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY name, id) AS n FROM (SELECT 'fighter' AS kind, boxer_id AS id, name FROM fighters UNION ALL SELECT 'country', n_nationkey, n_name FROM nation
        UNION ALL SELECT 'trainer', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part UNION ALL SELECT 'event', event_id, 'Card ' || event_id FROM league_events) WHERE contains(lower(name), '12')) WHERE n <= 5""",
    "srch05": "SELECT word, min(c_name) AS name FROM (SELECT DISTINCT c_name, unnest(list_filter(regexp_split_to_array(lower(c_name), '[ #\\-.,'']+'), lambda x: x <> '')) AS word FROM customer) GROUP BY word HAVING count(*) = 1",
    "srch07": r"""SELECT name_id, count(DISTINCT doc_id) AS documents, count(*) AS times FROM (SELECT DISTINCT item_id AS name_id, unnest(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM (SELECT item_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM benchmark))
        JOIN (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 3)), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents)) USING (gram) GROUP BY name_id""",
    "set03": """SELECT DISTINCT champion_id AS boxer_id FROM reigns WHERE champion_id NOT IN (SELECT champion_id FROM reigns WHERE "end" IS NULL)""",
    "mdl02": f"@{_FEATURES} SELECT bout_id, red_id, blue_id, round(p_red, 6) AS p_red, round(0.97 - p_red, 6) AS p_blue, round(1 / (1 + exp(-(t_rating + t_rest))) - 1 / (1 + exp(-t_rest)), 6) AS rating_shift, round(p_stop, 6) AS p_stop FROM chances",
    "mdl20": f"@{_FEATURES} SELECT bout_id, CASE WHEN p_red < 0.97 - p_red THEN red_id ELSE blue_id END AS underdog_id, round(c, 6) AS chance, CASE WHEN c >= 0.4 THEN 'toss-up' WHEN c >= 0.28 THEN 'live' ELSE 'longshot' END AS tier FROM (SELECT *, round(least(p_red, 0.97 - p_red), 9) AS c FROM chances) ORDER BY c DESC, bout_id LIMIT 50",
    "mdl08": f'@{_CALLS} SELECT bout_id, date, division, round(chance, 6) AS chance, "right", round(-log2(greatest(pw, 1e-6)), 6) AS surprise FROM calls',
    "mdl09": f'@{_CALLS} SELECT division, count(*) AS n, round(avg("right"::INT), 6) AS accuracy, round(avg(-ln(greatest(pw, 1e-9))), 6) AS log_loss, round(avg(pow(1 - pw, 2)), 6) AS brier FROM calls GROUP BY division HAVING count(*) >= 30',
    "mdl11": f'@{_CALLS} SELECT least(floor(round(chance * 10, 9)), 9) / 10 AS bin, count(*) AS n, round(avg(chance), 6) AS expected, round(avg("right"::INT), 6) AS actual FROM calls GROUP BY 1',
    "mdl21": f"""@{_CALLS} SELECT CASE WHEN 1 - chance >= 0.4 THEN 'toss-up' WHEN 1 - chance >= 0.28 THEN 'live' ELSE 'longshot' END AS tier, count(*) AS n, count(*) FILTER (NOT "right") AS upsets, round(avg(1 - chance), 6) AS expected FROM calls GROUP BY 1""",
    "mdl19": """SELECT trainer_id, count(*) AS fights, round(sum(p), 6) AS expected, sum(CASE result WHEN 'W' THEN 1 WHEN 'D' THEN 0.5 ELSE 0 END)::DOUBLE AS actual FROM (SELECT *, 1 / (1 + pow(10, (opp_pre - pre) / 400)) AS p FROM won)
        JOIN (SELECT bout_id, boxer_id, arg_min(person_id, (start, person_id)) AS trainer_id FROM instint GROUP BY ALL) USING (bout_id, boxer_id) WHERE p < 0.4 GROUP BY ALL HAVING count(*) >= 12""",
    "mdl22": f"@{_SCORES} SELECT * FROM scores",
    "win10": f"@{_SCORES} SELECT year, rank, bout_id, score FROM (SELECT *, year(date) AS year, row_number() OVER (PARTITION BY year(date) ORDER BY score DESC, date, bout_id) AS rank FROM scores) WHERE rank <= 10",
    "fn02": """SELECT p_partkey, CASE WHEN length(s) <= 100 THEN s ELSE regexp_replace(s[1:100], '-[^-]*$', '') END AS slug, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_name), '[\\s\\-.,'']+'), lambda x: x <> '' AND x NOT IN ('jr', 'sr', 'ii', 'iii'))), ' ') AS key
        FROM (SELECT *, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part)""",
    "fn15": "SELECT event_type, count(*) AS n, sum(k)::BIGINT AS sum_k, count(DISTINCT k) AS distinct_k FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY ALL",
    "fn19": r"SELECT doc_id, regexp_matches(text, 'https?://|www\.') AS has_link, regexp_matches(text, '[0-9]{9,}') AS long_number, regexp_matches(text, '(!!!|\?\?\?|\.\.\.\.)') AS repeats, length(text) AS chars FROM documents",
    "src09": r"""SELECT page_id, length(t) AS chars, sha256(t) AS digest FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
        '<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) AS t FROM pages)""",
    "str10": "SELECT * FROM (SELECT sha1(regexp_replace(lower(text), '[^a-z]', '', 'g'))[1:16] AS fp, count(DISTINCT source) AS sources, count(*) AS documents FROM documents GROUP BY 1) WHERE sources > 1",
    "lnk09": r"SELECT md5(trim(regexp_replace(lower(text), '[ \t\n\r]+', ' ', 'g'))) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "str_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2",
    "str_sliding": "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY 1, 2",
    "str_session": """SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
        SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true) AS fresh FROM events)) GROUP BY user_id, s""",
    "str_dedupe": "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events) WHERE n = 1",
    "str_limiter": "SELECT * FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2",
    "str_late": "SELECT event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY md5(event_id::VARCHAR), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen - INTERVAL 14 DAY",
    "snk01": f"""SELECT coalesce(g.bout_id, h.bout_id) AS bout_id, CASE WHEN g.bout_id IS NULL OR (g.method IS NULL AND NOT g.cancelled) THEN h.method ELSE g.method END AS method,
        CASE WHEN g.bout_id IS NULL THEN h.winner_id ELSE g.winner_id END AS winner_id, coalesce(g.end_round, h.end_round) AS end_round, coalesce(g.round_time, h.round_time) AS round_time FROM {_HELD} h FULL JOIN {_GIVEN} g ON h.bout_id = g.bout_id""",
    "snk03": """SELECT source, count(*) AS n, round(sum(usd), 2) AS usd FROM (SELECT source, usd FROM purses p WHERE bout_id % 2 = 0 AND bout_id % 3 <> 0 UNION ALL SELECT source, usd * 2 FROM purses WHERE bout_id % 3 = 0) GROUP BY ALL""",
    "snk06": "SELECT bout_id, (DATE '2000-06-30' - i::INT)::DATE AS locked_on FROM bouts, (SELECT unnest([0, 1, 2]) AS i) WHERE upcoming AND NOT (bout_id % 2 = 0 AND i > 0)",
    "str02": _CHANGES,
    "str03": f"SELECT field, count(*) AS n, count(*) FILTER (kind = 'clear') AS cleared, count(*) >= 100 AND count(*) / (SELECT count(*) FROM {_HELD}) > 0.3 AS refused FROM ({_CHANGES}) GROUP BY field",
    "str17": f"""SELECT CASE WHEN h.bout_id IS NULL THEN 'added' WHEN g.bout_id IS NULL THEN 'removed' WHEN h.method IS DISTINCT FROM g.method OR h.winner_id IS DISTINCT FROM g.winner_id OR h.end_round IS DISTINCT FROM g.end_round
        OR h.round_time IS DISTINCT FROM g.round_time THEN 'changed' ELSE 'same' END AS what, count(*) AS n FROM {_HELD} h FULL JOIN {_GIVEN} g ON h.bout_id = g.bout_id GROUP BY 1""",
    "dq01": f"@{_FEED} SELECT * FROM issues",
    "dq03": f"@{_FEED} SELECT severity, code, entity, count(*) AS n, array_to_string(list_sort(list(id))[1:2], ',') AS examples FROM issues GROUP BY ALL",
    "dq04": "SELECT boxer_id, date, count(*) AS bouts FROM lb WHERE NOT cancelled GROUP BY ALL HAVING count(*) > 1",
    "dq05": """SELECT boxer_id, person_id, start, next FROM (SELECT boxer_id, person_id, start, CASE WHEN boxer_id % 5 = 0 THEN "end" + 365 ELSE "end" END AS fin, lead(start) OVER (PARTITION BY boxer_id ORDER BY start, person_id) AS next FROM stints) WHERE next < coalesce(fin, DATE '9999-12-31')""",
    "dq06": """SELECT * FROM (SELECT bout_id, method, count(*) FILTER (v = 1) AS with_winner, count(*) FILTER (v = 0) AS even, count(*) FILTER (v = -1) AS against FROM (SELECT *, CASE WHEN red = blue THEN 0 WHEN winner_id IS NULL THEN 0 WHEN (red > blue) = (winner_id = red_id) THEN 1 ELSE -1 END AS v FROM cards) GROUP BY ALL)
        WHERE NOT CASE method WHEN 'UD' THEN with_winner = 3 WHEN 'MD' THEN with_winner = 2 AND even = 1 WHEN 'SD' THEN with_winner = 2 AND against = 1 WHEN 'TD' THEN with_winner >= 2 ELSE true END""",
    "dq16": "SELECT division, sex, boxer_id FROM (SELECT *, row_number() OVER (PARTITION BY division, sex ORDER BY md5('7:' || boxer_id), boxer_id) AS k FROM fighters) WHERE k <= 10",
    "dq19": """SELECT CASE WHEN cancelled THEN 'cancelled' WHEN method IS NULL AND date > DATE '2000-06-30' THEN 'not yet' WHEN method IS NULL THEN 'no method' WHEN winner_id IS NULL AND method NOT IN ('DRAW', 'TDRAW', 'NC') THEN 'decision without winner'
        WHEN end_round > rounds THEN 'rounds raised' WHEN end_round IS NULL THEN 'end unknown' ELSE 'settled' END AS reason, count(*) AS n FROM bouts GROUP BY 1""",
    "win20": """SELECT a_id, b_id, count(*) AS n, min(bout_id) AS first_id, count(DISTINCT coalesce(winner_id, -1)) > 1 AS disagree FROM (SELECT *, count(*) FILTER (apart) OVER (PARTITION BY a_id, b_id ORDER BY date, bout_id) AS c FROM (
        SELECT bout_id, date, least(red_id, blue_id) AS a_id, greatest(red_id, blue_id) AS b_id, winner_id, coalesce(datediff('day', lag(date) OVER (PARTITION BY least(red_id, blue_id), greatest(red_id, blue_id) ORDER BY date, bout_id), date) > 1, false) AS apart
        FROM bouts WHERE counted)) GROUP BY a_id, b_id, c HAVING count(*) > 1""",
}

_LISTS = [
    ("greatest", """SELECT boxer_id, name, rating, floor(round(100 * (0.30 * least(1, greatest(0, (peak - 1500) / 300)) + 0.25 * least(1, quality_wins / 8) + 0.15 * least(1, reign_days / 2920) + 0.10 * least(1, defences / 15)
        + 0.10 * least(1, win_streak / 30)) / 0.9, 9) + 0.5)::BIGINT AS value FROM careers JOIN acc USING (boxer_id) WHERE bouts >= 10""", "value DESC, rating DESC, name"),
    ("peak", "SELECT boxer_id, name, floor(peak + 0.5)::BIGINT AS value FROM careers JOIN acc USING (boxer_id) WHERE bouts > 0", "value DESC, name"),
    ("wins", "SELECT boxer_id, name, wins AS value FROM careers WHERE wins > 0", "value DESC, name"),
    ("kos", "SELECT boxer_id, name, kos AS value FROM careers WHERE kos > 0", "value DESC, name"),
    ("ko-rate", "SELECT boxer_id, name, kos / wins AS value, wins FROM careers WHERE wins >= 15", "value DESC, wins DESC, name"),
    *[(n, f"SELECT boxer_id, name, {c} AS value FROM careers JOIN acc USING (boxer_id) WHERE {c} > {least}", "value DESC, name")
      for n, c, least in (("win-streak", "win_streak", 0), ("quality-wins", "quality_wins", 0), ("title-wins", "title_wins", 0), ("defences", "defences", 0), ("divisions", "divisions", 1))],
    *[(n, f"SELECT r.*, name, champion_id AS boxer_id, {c} AS value FROM reigns r JOIN fighters f ON champion_id = f.boxer_id WHERE {c} > 0", "value DESC, counted_days DESC, name, title_org, title, division, sex, reign_no")
      for n, c in (("longest-reign", "counted_days"), ("reign-defences", "defences"))],
]

_LAST = {
    "prj01": """SELECT bout_id, b.country, r.name AS red_name, u.name AS blue_name, r.country AS red_country, u.country AS blue_country FROM bouts b JOIN fighters r ON red_id = r.boxer_id JOIN fighters u ON blue_id = u.boxer_id WHERE NOT cancelled""",
    "prj02": "SELECT boxer_id, wins || '-' || losses || '-' || draws AS record, CASE WHEN wins > losses THEN 'winning' WHEN wins < losses THEN 'losing' ELSE 'even' END AS balance FROM careers",
    "join02": """SELECT region, count(*) AS events, count(*) FILTER (cancelled) AS cancelled FROM league_events LEFT JOIN (SELECT n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <= 2) USING (country) GROUP BY ALL""",
    "join10": "SELECT trainer_id, count(*) AS bouts FROM (SELECT bout_id, boxer_id, arg_min(person_id, (start, person_id)) AS trainer_id FROM instint GROUP BY ALL) GROUP BY ALL",
    "join13": """SELECT claim_id, CASE WHEN hits = 1 THEN bout_id END AS bout_id, CASE WHEN hits = 0 THEN 'no bout' WHEN hits > 1 THEN 'ambiguous' WHEN claimed IN ('UD', 'MD', 'SD') AND rounds <> distance THEN 'other distance' WHEN method IS NULL THEN 'only source' WHEN claimed = method THEN 'agrees' ELSE 'conflict' END AS verdict
        FROM (SELECT claim_id, claimed, distance, count(b.bout_id) AS hits, min(b.bout_id) AS bout_id, min(b.method) AS method, min(b.rounds) AS rounds FROM (SELECT bout_id AS claim_id, (date + (bout_id % 4 - 1)::INT)::DATE AS day, red_name AS name, CASE WHEN bout_id % 17 = 0 THEN 'KO' ELSE coalesce(method, 'UD') END AS claimed,
        rounds + CASE WHEN bout_id % 19 = 0 THEN 2 ELSE 0 END AS distance FROM bouts WHERE NOT cancelled) c LEFT JOIN (SELECT * FROM bouts WHERE NOT cancelled) b ON b.red_name = c.name AND b.date BETWEEN day - 1 AND day + 1 GROUP BY ALL)""",
    "agg17": """SELECT (part + supp) % 17 AS referee_id, count(*) AS bouts, count(*) FILTER (s) AS stoppages, round(count(*) FILTER (s) / count(*), 6) AS rate, round(avg(end_round) FILTER (s), 6) AS avg_round, round(count(*) FILTER (s AND end_round <= 3) / count(*) FILTER (s), 6) AS early
        FROM (SELECT *, method IN ('KO', 'TKO') AND end_round IS NOT NULL AS s FROM bouts WHERE counted) GROUP BY 1""",
    "agg19": """SELECT boxer_id, person_id, start, count(*) FILTER (result = 'W') AS wins, count(*) FILTER (result = 'L') AS losses, count(*) FILTER (result = 'D') AS draws, arg_max(post, (date, bout_id)) - arg_min(pre, (date, bout_id)) AS change FROM instint GROUP BY ALL""",
    "agg22": """SELECT s_nationkey AS gym_id, count(DISTINCT boxer_id) AS fighters, count(DISTINCT boxer_id) FILTER ("end" IS NULL) AS current FROM stints JOIN supplier ON person_id = s_suppkey GROUP BY ALL""",
    "agg23": """SELECT person_id, sum(n)::BIGINT AS bouts, round(round(avg(c), 9), 6) AS mean_change FROM (SELECT person_id, boxer_id, start, count(*) AS n, arg_max(post, (date, bout_id)) - arg_min(pre, (date, bout_id)) AS c FROM instint GROUP BY ALL) GROUP BY person_id HAVING sum(n) >= 4 ORDER BY round(avg(c), 9) DESC, person_id LIMIT 20""",
    "agg25": """SELECT event_id, gross FROM (SELECT event_id, round(sum(l_extendedprice) + CASE WHEN event_id % 3 = 0 THEN floor(max(part) * 59.99::DOUBLE + 0.5) ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN min(supp) * 1000 ELSE 0 END, 2) AS gross FROM bouts WHERE NOT cancelled AND date <= DATE '2000-06-30' GROUP BY event_id) WHERE gross > 0 ORDER BY gross DESC, event_id LIMIT 20""",
    "agg28": """SELECT promoter, count(*) AS events, floor(avg(viewers) + 0.5)::BIGINT AS mean_viewers, max(viewers) AS peak FROM (SELECT promoter, event_id, max(part) AS viewers FROM bouts JOIN (SELECT event_id, promoter FROM league_events) USING (event_id) WHERE NOT cancelled GROUP BY ALL) GROUP BY ALL""",
    "win05": """SELECT bout_id, boxer_id, pre, round(least(coalesce(datediff('day', lag(date) OVER o, date) / 30.4, 12), 36), 6) AS idle, round(CASE WHEN count(*) FILTER (result = 'W') OVER p > 0 THEN count(*) FILTER (result = 'W' AND stopped) OVER p / count(*) FILTER (result = 'W') OVER p ELSE 0 END, 6) AS ko_rate,
        round(CASE WHEN count(*) OVER p > 0 THEN count(*) FILTER (result = 'L' AND stopped) OVER p / count(*) OVER p ELSE 0 END, 6) AS ko_loss_rate FROM won WINDOW o AS (PARTITION BY boxer_id ORDER BY date, bout_id), p AS (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "win15": """SELECT bout_id, round((rank() OVER (ORDER BY landed) - 1) / count(*) OVER (), 6) AS percentile FROM (SELECT bout_id, sum(landed) AS landed FROM (SELECT bout_id, boxer_id, coalesce(sum(landed) FILTER (round = 0), sum(landed) FILTER (round > 0)) AS landed FROM punches GROUP BY ALL) GROUP BY ALL)""",
    "win18": """SELECT user_id, graded, "right", round(points, 6) AS points, round(accuracy, 6) AS accuracy, rank() OVER (ORDER BY points DESC, accuracy DESC) AS place FROM (SELECT user_id, count(*) AS graded, count(*) FILTER (ok) AS "right", round(sum(CASE WHEN ok THEN 2 - p ELSE 0 END), 9) AS points, round(count(*) FILTER (ok) / count(*), 9) AS accuracy FROM (
        SELECT user_id, (event_id % 2 = 0) = (winner_id = red_id) AS ok, CASE WHEN event_id % 2 = 0 THEN q ELSE 1 - q END AS p FROM (SELECT event_id, user_id, event_id % (SELECT count(*) FROM league_events) AS card FROM events WHERE event_type <> 'view') e
        JOIN (SELECT event_id AS card, arg_max(bout_id, (position, bout_id)) AS bout_id FROM bouts WHERE counted AND winner_id IS NOT NULL GROUP BY ALL) h USING (card) JOIN (SELECT bout_id, red_id, winner_id FROM bouts) b USING (bout_id)
        JOIN (SELECT bout_id, 1 / (1 + pow(10, (opp_pre - pre) / 400)) AS q FROM won WHERE side = 'red') USING (bout_id)) GROUP BY user_id HAVING count(*) >= 3 ORDER BY points DESC, accuracy DESC, user_id LIMIT 50)""",
    "win22": """SELECT boxer_id, row_number() OVER (PARTITION BY division, sex ORDER BY b DESC, boxer_id) AS rank_before, row_number() OVER (PARTITION BY division, sex ORDER BY a DESC, boxer_id) AS rank_after FROM eligible
        JOIN (SELECT boxer_id, coalesce(arg_max(post, (date, bout_id)) FILTER (date < DATE '2000-03-01'), 1500) AS b, coalesce(arg_max(post, (date, bout_id)) FILTER (date <= DATE '2000-03-01'), 1500) AS a FROM fighters LEFT JOIN won USING (boxer_id) GROUP BY ALL) USING (boxer_id)""",
    "ord02": "SELECT boxer_id, round(r, 6) AS rate, rating FROM (SELECT *, CASE WHEN wins >= 5 THEN round(ko_rate, 9) END AS r FROM careers) ORDER BY r DESC NULLS LAST, rating DESC, boxer_id LIMIT 50",
    "ord07": "SELECT bout_id, date FROM bouts WHERE counted ORDER BY date DESC, bout_id DESC LIMIT 30",
    "set01": "SELECT country, count(*) AS n FROM (SELECT country FROM fighters UNION ALL SELECT country FROM league_events UNION ALL SELECT n_name FROM nation) GROUP BY ALL",
    "set02": "SELECT doc_id FROM documents WHERE length(text) < 200 UNION SELECT doc_id FROM documents WHERE regexp_matches(text, 'https?://')",
    "set04": "SELECT country FROM fighters WHERE stance = 'Southpaw' AND boxer_id IN (SELECT champion_id FROM reigns) INTERSECT SELECT country FROM fighters WHERE stance = 'Orthodox' AND boxer_id IN (SELECT champion_id FROM reigns)",
    "vw04": "SELECT event_id, date, count(*) AS bouts, arg_max(bout_id, (position, bout_id)) AS headline_id FROM bouts WHERE upcoming GROUP BY ALL ORDER BY date, event_id LIMIT 10",
    "vw07": """SELECT boxer_id, arg_max(bout_id, (opp_pre, -bout_id)) AS best_win, max(opp_pre) AS best_rating, max(opp_pre - pre) FILTER (opp_pre - pre >= 24) AS upset FROM won WHERE result = 'W' GROUP BY ALL""",
    "vw14": "SELECT division, sex, count(*) AS ranked, round(avg(CASE WHEN bouts < 60 THEN 1.0 ELSE 0.0 END), 6) AS partial_share FROM ranking GROUP BY ALL",
    "mdl10": f'@{_CALLS} SELECT year(date) AS year, count(*) AS n, round(avg("right"::INT), 6) AS accuracy, round(avg(-log2(greatest(pw, 1e-6))), 6) AS surprise FROM calls GROUP BY 1',
    "mdl28": f"@{_FEATURES} SELECT bout_id, round(p_red * p_stop, 6) AS red_stop, round(p_red * (1 - p_stop), 6) AS red_points, round((0.97 - p_red) * p_stop, 6) AS blue_stop, round((0.97 - p_red) * (1 - p_stop), 6) AS blue_points FROM chances",
    "mdl29": """SELECT CASE WHEN winner_id IS NULL THEN 'void' WHEN ((bout_id + 1) % 2 = 0) = (winner_id = red_id) THEN 'right' ELSE 'wrong' END AS state, count(*) AS n FROM bouts WHERE method IS NOT NULL GROUP BY 1""",
    "rec17": " UNION ALL ".join(f"SELECT boxer_id, '{n}' AS list, min(rank) AS rank FROM (SELECT boxer_id, row_number() OVER (ORDER BY {o}) AS rank FROM ({r}))  WHERE rank <= 10 GROUP BY boxer_id" for n, r, o in _LISTS),
    "fn03": r"SELECT array_to_string(list_sort(list_filter(regexp_split_to_array(lower(p_type), '[\s\-.,'']+'), lambda x: x <> '')), ' ') AS key, count(*) AS n FROM part GROUP BY 1",
    "fn09": "SELECT s AS spelled, r AS read, count(*) AS n FROM bouts JOIN (VALUES (0, 'KO', 'KO'), (1, 'Knock-Out', 'KO'), (2, 'k.o.', 'KO'), (3, 'TKO', 'TKO'), (4, 'Technical Knockout', 'TKO'), (5, 'Referee Stoppage', 'TKO'), (6, 'stopped', 'TKO'), (7, 'RSC', 'TKO'), (8, 'Corner Retirement', 'RTD'), (9, 'corner stoppage', 'RTD'), (10, 'Disqualification', 'DQ'), (11, 'Decision - Unanimous', 'UD'), (12, 'Unanimous Decision (117-111)', 'UD'), (13, 'pts', 'UD'), (14, 'points', 'UD'), (15, 'Decision - Split', 'SD'), (16, 'Majority Decision', 'MD'), (17, 'Technical points', 'TD'), (18, 'Decision (technical)', 'TD'), (19, 'Tech decision', 'TD'), (20, 'Technical Draw', 'TDRAW'), (21, 'drawn', 'DRAW'), (22, 'Majority draw', 'DRAW'), (23, 'No Contest', 'NC'), (24, 'N/C', 'NC'), (25, 'no decision', 'NC'), (26, 'N/D', 'NC'), (27, 'walkover', NULL), (28, '', NULL)) v(i, s, r) ON bout_id % 29 = i GROUP BY ALL",
    "fn13": "SELECT division, min(end_round) AS median, max(of) AS n FROM (SELECT division, end_round, row_number() OVER (PARTITION BY division ORDER BY end_round) AS k, count(*) OVER (PARTITION BY division) AS of FROM bouts WHERE counted AND end_round IS NOT NULL) WHERE k > of // 2 GROUP BY division",
    "fn17": """SELECT event_id, floor(round((l * (0.8707 - 0.131979 * pow(p, 2) + pow(p, 4) * (-0.013791 + pow(p, 4) * (0.003971 * pow(p, 2) - 0.001529 * pow(p, 4)))) * s + 500) * 10, 6) + 0.5) / 10 AS x,
        floor(round((h / 2 - p * (1.007226 + pow(p, 2) * (0.015085 + pow(p, 4) * (-0.044475 + 0.028874 * pow(p, 2) - 0.005916 * pow(p, 4)))) * s) * 10, 6) + 0.5) / 10 AS y FROM (SELECT *, round(2 * (pi() / 2) * (1.007226 + pow(pi() / 2, 2) * (0.015085 + pow(pi() / 2, 4) * (-0.044475 + 0.028874 * pow(pi() / 2, 2) - 0.005916 * pow(pi() / 2, 4)))) * s) AS h
        FROM (SELECT event_id, radians((event_id * 37) % 181 - 90) AS p, radians((event_id * 53) % 361 - 180) AS l, 1000 / (2 * pi() * 0.8707) AS s FROM league_events))""",
    "fn10": "SELECT s AS spelled, r AS read, count(*) AS n FROM league_events JOIN (VALUES (0, 'USA', 'United States'), (1, 'U.S.', 'United States'), (2, 'United States of America', 'United States'), (3, 'The Netherlands', 'The Netherlands'), (4, 'Holland', 'Netherlands'), (5, 'Türkiye', 'Turkey'), (6, 'Great Britain', 'United Kingdom'), (7, 'England', 'England'), (8, 'Northern Ireland', 'Northern Ireland'), (9, 'New South Wales', 'Australia'), (10, 'DR Congo', 'Congo - Kinshasa'), (11, 'NATION_3', 'NATION_3'), (12, ' Ghana ', 'Ghana')) v(i, s, r) ON event_id % 13 = i GROUP BY ALL",
    "fn12": """SELECT event_id, strftime(date, '%m-%d') AS md, (date + 7)::DATE AS next_week, round(datediff('day', date, DATE '2000-06-30') / 30.4, 6) AS months, event_id % 3 = 0 OR (event_id % 3 = 1 AND year(date) % 4 = 0) AS real_day FROM league_events""",
    "fn14": "SELECT boxer_id, sha1(name)[1:12] AS sha1, sha256(name)[1:16] AS sha256, md5(name) AS md5, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::HUGEINT)), lambda h, c: xor(h, c) * 16777619 % 4294967296)::BIGINT AS fnv FROM fighters",
    "fn16": """SELECT o_orderkey, CASE WHEN o_totalprice >= 1e6 THEN format('${:.1f}M', floor(o_totalprice / 1e6 * 10 + 0.5) / 10) WHEN o_totalprice >= 1e3 THEN format('${:.1f}k', floor(o_totalprice / 1e3 * 10 + 0.5) / 10) ELSE '$' || floor(o_totalprice + 0.5)::BIGINT END AS price FROM orders""",
    "fn20": r"""SELECT p_partkey, array_to_string(list_sort(list_distinct(w)), '|') AS sorted, array_to_string(w[1:2], '|') AS first_two, len(list_filter(w, lambda x: length(x) < 4)) = 0 AS all_long FROM (SELECT p_partkey, list_filter(regexp_split_to_array(p_type, '[\s\-]+'), lambda x: x <> '') AS w FROM part)""",
    "dq07": "SELECT event_id FROM league_events WHERE NOT cancelled AND event_id IN (SELECT event_id FROM bouts) AND event_id NOT IN (SELECT event_id FROM bouts WHERE method IS NOT NULL AND bout_id % 2 = 0)",
    "dq11": """@ok AS (SELECT boxer_id FROM careers WHERE sex = 'female' OR division NOT IN ('BUILDING', 'MACHINERY') OR (NOT boxer_id % 41 = 0 AND (boxer_id % 5 <> 0 OR boxer_id % 3 = 0))) SELECT count(*) FILTER (red_id IN (SELECT boxer_id FROM ok) AND blue_id IN (SELECT boxer_id FROM ok)) AS bouts, count(*) AS of FROM bouts""",
    "dq14": """SELECT 'many-draws' AS code, count(*) FILTER (draws > 6) AS n FROM careers UNION ALL SELECT 'no-losses', count(*) FILTER (losses = 0 AND bouts > 10) FROM careers UNION ALL SELECT 'very-young', (SELECT count(*) FROM (SELECT boxer_id, min(date) AS debut FROM won GROUP BY ALL) JOIN fighters USING (boxer_id) WHERE year(debut) - birth_year < 15)
        UNION ALL SELECT 'all-kos', count(*) FILTER (kos = wins AND wins >= 5) FROM careers UNION ALL SELECT 'inactive-recent', count(*) FILTER (NOT active AND last_fight > DATE '2000-06-01') FROM careers""",
    "str06": "SELECT bout_id, 'NC' AS new, CASE WHEN bout_id % 2 = 0 THEN false ELSE method <> 'UD' END AS moved FROM bouts WHERE method IS NOT NULL AND bout_id % 97 = 0",
    "str11": """SELECT 'user' AS "limit", user_id::VARCHAR AS who, time_bucket(INTERVAL 10 MINUTE, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT 'address', (event_id % 7)::VARCHAR, time_bucket(INTERVAL 10 MINUTE, ts), count(*) FROM events GROUP BY ALL HAVING count(*) > 3
        UNION ALL SELECT 'new account', user_id::VARCHAR, date_trunc('day', ts)::TIMESTAMP, count(*) FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS since FROM events) WHERE ts < since + INTERVAL 1 DAY GROUP BY ALL HAVING count(*) > 2""",
    "str12": """SELECT event_type AS subject, count(DISTINCT user_id) AS users FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS since, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS before FROM events)
        WHERE ts >= since + INTERVAL 7 DAY AND before >= 3 GROUP BY ALL HAVING count(DISTINCT user_id) >= 6""",
    "str16": "SELECT ts::DATE < date AS in_time, count(*) AS n FROM events e JOIN league_events l ON l.event_id = e.event_id * 4 GROUP BY 1",
}

_FACTS = "SELECT boxer_id, wins, losses, bouts, kos, rating FROM careers WHERE "
_CHECKS = {
    "flt02": _FACTS + "division = 'FURNITURE' AND sex = 'female' AND stance = 'Southpaw' AND active",
    "flt04": _FACTS + "wins >= 25 AND bouts >= 60 AND losses <= 35 AND draws <= 4",
    "flt05": _FACTS + "kos >= 10 AND ko_rate >= 0.5 AND ko_losses <= 15",
    "flt08": _FACTS + "last_fight BETWEEN DATE '2000-05-01' AND DATE '2000-06-15'",
    "flt10": _FACTS + "reach_cm >= 180 AND age BETWEEN 25 AND 30 AND height_cm <= 190 AND boxer_id IN (SELECT boxer_id FROM won GROUP BY boxer_id HAVING year(min(date)) BETWEEN 1992 AND 1999)",
    "flt09": _FACTS + "wins < losses AND sex = 'female'",
    "flt14_name": _FACTS + """boxer_id IN (SELECT boxer_id FROM stints JOIN supplier ON person_id = s_suppkey WHERE "end" IS NULL AND contains(lower(s_name), '0003'))""",
    "flt14_gym": _FACTS + """division = 'HOUSEHOLD' AND boxer_id IN (SELECT boxer_id FROM stints JOIN supplier ON person_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE "end" IS NULL AND contains(lower(n_name), 'nation_1'))""",
    "flt16_new": _FACTS + "division = 'BUILDING' AND boxer_id IN (SELECT boxer_id FROM (SELECT *, lag(person_id) OVER (PARTITION BY boxer_id ORDER BY start) AS p FROM stints) WHERE p <> person_id AND start BETWEEN DATE '1999-09-30' AND DATE '2000-06-30')",
    "flt18": _FACTS + "country = 'NATION_4' AND stance = 'Orthodox' AND active",
    "prj04": f"@{_SCORES} SELECT year(date) AS year, CASE WHEN score >= 70 THEN 'classic' WHEN score >= 55 THEN 'great' WHEN score >= 40 THEN 'good' WHEN score >= 25 THEN 'solid' ELSE 'routine' END AS tier, count(*) AS n, round(avg(score), 6) AS mean_score FROM scores GROUP BY ALL",
    "mdl06": f"""@{_FEATURES}, terms AS (SELECT bout_id, unnest([{{'factor': 'rating', 't': ln(10) / 400 * (a.rating - b.rating)}}, {{'factor': 'reach', 't': CASE WHEN a.reach_cm IS NOT NULL AND b.reach_cm IS NOT NULL THEN 0.016 * least(12, greatest(-12, a.reach_cm - b.reach_cm)) ELSE 0 END}},
        {{'factor': 'age', 't': CASE WHEN a.age IS NOT NULL AND b.age IS NOT NULL THEN 0.03 * (greatest(0, b.age - 34) - greatest(0, a.age - 34)) ELSE 0 END}}, {{'factor': 'idle', 't': 0.01 * (greatest(0, b.idle - 12) - greatest(0, a.idle - 12))}},
        {{'factor': 'power', 't': 0.2 * (a.ko_rate - b.ko_rate)}}, {{'factor': 'chin', 't': 0.2 * (b.chin - a.chin)}}]) AS u FROM bouts JOIN feat a ON red_id = a.boxer_id JOIN feat b ON blue_id = b.boxer_id WHERE upcoming),
        s AS (SELECT bout_id, u.factor AS factor, u.t AS t, sum(u.t) OVER (PARTITION BY bout_id) AS z FROM terms),
        g AS (SELECT *, 1 / (1 + exp(-z)) - 1 / (1 + exp(-(z - t))) AS shift, abs(2 * least(0.96, greatest(0.04, 1 / (1 + exp(-z)))) - 1) * 0.97 AS gap FROM s)
        SELECT bout_id, CASE WHEN gap < 0.12 THEN 'Toss-up' WHEN gap < 0.3 THEN 'Lean' WHEN gap < 0.55 THEN 'Clear favourite' ELSE 'Heavy favourite' END AS confidence, factor, round(shift, 6) AS shift FROM g WHERE factor = 'rating' OR abs(shift) > 0.004""",
    "mdl23": f"""@{_SCORES}, each AS (SELECT bout_id, unnest([{{'n': 'knockdowns', 'w': 0.17, 'v': k}}, {{'n': 'finish', 'w': 0.20, 'v': f}}, {{'n': 'action', 'w': 0.20, 'v': a}}, {{'n': 'matchup', 'w': 0.16, 'v': m}}, {{'n': 'upset', 'w': 0.09, 'v': u}}, {{'n': 'stakes', 'w': 0.08, 'v': s}}, {{'n': 'comeback', 'w': 0.10, 'v': c}}]) AS p FROM part)
        SELECT bout_id, score, string_agg(n, ',' ORDER BY r) AS reasons FROM (SELECT bout_id, p.n AS n, row_number() OVER (PARTITION BY bout_id ORDER BY p.w::DOUBLE * p.v::DOUBLE DESC, p.n) AS r FROM each WHERE p.v >= 0.45) JOIN scores USING (bout_id) WHERE r <= 4 GROUP BY bout_id, score""",
    "flt11": _FACTS + "floor(rating + 0.5) BETWEEN 1504 AND 1548",
    "flt16": _FACTS + "division = 'BUILDING' AND boxer_id IN (SELECT boxer_id FROM weights WHERE NOT made)",
    "flt22": "SELECT rounds, count(*) AS n FROM bouts WHERE counted AND method <> 'DQ' AND rounds >= 6 GROUP BY ALL",
    "mdl07": f"""@{_FEATURES}, d AS (SELECT bout_id, a.rating - b.rating AS r, CASE WHEN a.reach_cm IS NOT NULL AND b.reach_cm IS NOT NULL THEN least(12, greatest(-12, a.reach_cm - b.reach_cm)) ELSE 0 END AS reach,
            CASE WHEN a.age IS NOT NULL AND b.age IS NOT NULL THEN greatest(0, b.age - 34) - greatest(0, a.age - 34) ELSE 0 END AS age, greatest(0, b.idle - 12) - greatest(0, a.idle - 12) AS idle, a.ko_rate - b.ko_rate AS ko, b.chin - a.chin AS chin
            FROM bouts JOIN feat a ON red_id = a.boxer_id JOIN feat b ON blue_id = b.boxer_id WHERE upcoming),
        p AS (SELECT 'Balanced' AS preset, 1.0::DOUBLE AS f, 0.016::DOUBLE AS wr, 0.03::DOUBLE AS wa, 0.01::DOUBLE AS wi, 0.2::DOUBLE AS wk, 0.2::DOUBLE AS wc UNION ALL SELECT 'Pure Elo', 1, 0, 0, 0, 0, 0 UNION ALL SELECT 'Old school', 0.6, 0.04, 0.03, 0.01, 0.6, 0.6 UNION ALL SELECT 'Father Time', 1, 0.016, 0.09, 0.04, 0.2, 0.2)
        SELECT bout_id, preset, round(1 / (1 + exp(-(ln(10) / 400 * f * r + wr * reach + wa * age + wi * idle + wk * ko + wc * chin))), 6) AS p_red FROM d, p""",
    "mdl14": """SELECT count(*) AS n, round(avg(-ln(CASE WHEN result = 'W' THEN p ELSE 1 - p END)), 6) AS log_loss, round(avg(pow(CASE WHEN result = 'W' THEN 1 - p ELSE p END, 2)), 6) AS brier FROM (SELECT result, greatest(1e-6, least(1 - 1e-6, 1 / (1 + pow(10, (opp_pre - pre) / 400)))) AS p FROM won WHERE side = 'red' AND result <> 'D')""",
    "str04": f"""SELECT field, kind, CASE WHEN kind = 'fill' OR (kind = 'replace' AND field = 'end_round' AND abs(try_cast(old AS INT) - try_cast("new" AS INT)) <= 2) THEN 'taken' ELSE 'waits' END AS decision, count(*) AS n FROM ({_CHANGES}) GROUP BY ALL""",
    "str15": """SELECT CASE WHEN wins = told THEN 'complete' WHEN earlier = told THEN 'lagging' WHEN wins < told THEN 'partial' ELSE 'conflict' END AS verdict, count(*) AS n FROM (SELECT *, earlier + CASE WHEN boxer_id % 3 = 0 THEN 0 ELSE boxer_id % 2 END AS told FROM (
        SELECT boxer_id, count(*) AS wins, count(*) FILTER (date <= DATE '2000-06-30' - 60) AS earlier FROM won WHERE result = 'W' GROUP BY ALL)) GROUP BY 1""",
    "dq15": """SELECT 'fighters-without-bout' AS code, count(*) AS n FROM fighters WHERE boxer_id NOT IN (SELECT boxer_id FROM lb) UNION ALL SELECT 'self-fights', count(*) FROM bouts WHERE red_id = blue_id UNION ALL SELECT 'late-rounds', count(*) FROM bouts WHERE end_round > rounds
        UNION ALL SELECT 'title-without-winner', count(*) FROM bouts WHERE title IS NOT NULL AND method IS NOT NULL AND winner_id IS NULL UNION ALL SELECT 'cards-only-cancelled', count(*) FROM league_events WHERE event_id NOT IN (SELECT event_id FROM bouts WHERE NOT cancelled)""",
    "vw09": """SELECT user_id, boxer_id, bout_id, CASE WHEN upcoming THEN 'upcoming' ELSE result END AS what FROM lb JOIN (SELECT DISTINCT user_id, event_id % (SELECT count(*) FROM fighters) AS boxer_id FROM events) USING (boxer_id) WHERE (counted AND date > DATE '2000-06-30' - 30) OR (upcoming AND date <= DATE '2000-07-14')""",
}

_RECAPS = f"""{_CALLS},
tc AS (SELECT bout_id, CASE WHEN k = 1 THEN 'crowned' ELSE 'defended' END AS title_change, k - 1 AS defence FROM (SELECT bout_id, row_number() OVER (PARTITION BY title_org, title, division, sex, reign_no ORDER BY date, bout_id) AS k FROM titles1)),
rec0 AS (
    SELECT bout_id, date, boxer_id, result, stopped, pre, post, count(*) FILTER (result = 'W') OVER h || '-' || count(*) FILTER (result = 'L') OVER h || '-' || count(*) FILTER (result = 'D') OVER h AS record,
        count(*) FILTER (result <> 'W') OVER h AS nw, count(*) FILTER (result <> 'L') OVER h AS nl, count(*) OVER b AS fb, count(*) FILTER (result = 'L') OVER b AS lb, count(*) FILTER (result = 'L' AND stopped) OVER b AS sb
    FROM won WINDOW h AS (PARTITION BY boxer_id ORDER BY date, bout_id), b AS (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rec1 AS (SELECT *, row_number() OVER (PARTITION BY boxer_id, result, CASE result WHEN 'W' THEN nw ELSE nl END ORDER BY date, bout_id) AS run FROM rec0),
recaps AS (
    SELECT a.bout_id, a.date, a.boxer_id AS winner_id, a.pre AS winner_before, a.post AS winner_after, a.record AS winner_record, a.run AS win_run, b.boxer_id AS loser_id, b.pre AS loser_before, b.post AS loser_after, b.record AS loser_record, b.run AS loss_run,
        CASE WHEN b.fb >= 5 AND b.lb = 0 THEN b.fb END AS unbeaten_ended, CASE WHEN b.stopped AND b.sb = 0 AND b.fb >= 3 AND NOT (b.fb >= 5 AND b.lb = 0) THEN b.fb END AS first_stoppage,
        c.pw AS p, c."right" AS ok, title_change, defence
    FROM rec1 a JOIN rec1 b ON a.bout_id = b.bout_id AND a.result = 'W' AND b.result = 'L' LEFT JOIN calls c ON c.bout_id = a.bout_id LEFT JOIN tc ON tc.bout_id = a.bout_id)"""
_BELTS = """belts AS (SELECT r.*, NOT f.active OR datediff('day', last_date, DATE '2000-06-30') > 547 AS dormant FROM (SELECT title_org, title, division, sex, arg_max(champion_id, reign_no) AS holder_id, max(last_date) AS last_date FROM reigns GROUP BY ALL) r JOIN fighters f ON holder_id = boxer_id)"""
_OFFICIAL = f"""{_BELTS}, bodies AS (SELECT unnest(['WBA', 'WBC', 'IBF', 'WBO']) AS body, unnest([0, 1, 2, 3]) AS n),
official AS (
    SELECT body, division, sex, 'champion' AS kind, NULL::BIGINT AS rank, holder_id AS boxer_id FROM belts JOIN bodies ON n = title_org WHERE title = 'World Title'
    UNION ALL SELECT body, division, sex, 'contender', k, boxer_id FROM (SELECT body, division, sex, boxer_id, rank - bodies.n - CASE WHEN body IN ('WBC', 'IBF') THEN 0 ELSE 1 END AS k FROM ranking, bodies) WHERE k BETWEEN 1 AND 15)"""
_SUP = """sup AS (SELECT boxer_id, wins, losses, draws, wins + CASE WHEN NOT t THEN 0 WHEN boxer_id % 41 = 0 THEN -1 WHEN boxer_id % 5 = 0 THEN boxer_id % 3 ELSE 0 END AS sup_wins, losses + CASE WHEN t AND boxer_id % 82 = 0 THEN 1 ELSE 0 END AS sup_losses,
    draws - CASE WHEN t AND boxer_id % 123 = 0 THEN 1 ELSE 0 END AS sup_draws FROM (SELECT *, sex = 'male' AND division IN ('BUILDING', 'MACHINERY') AS t FROM careers)),
rec AS (SELECT *, CASE WHEN wins > sup_wins OR losses > sup_losses OR draws > sup_draws THEN 'conflict' WHEN wins = sup_wins AND losses = sup_losses AND draws = sup_draws THEN 'complete' ELSE 'partial' END AS verdict FROM sup)"""
def _money_told(n: str) -> str:
    return f"CASE WHEN {n} % 43 = 6 THEN 'bad_basis' WHEN {n} % 47 = 7 THEN 'missing_source' END AS unnamed, {n} % 61 = 10 AS old, {n} % 53 = 8 AS bare, {n} % 53 <> 8 AND {n} % 59 = 9 AS ftp"


_MONEY_FRAMES = {
    "financials": f"""SELECT 'e' || event_id || '/desk' AS ref, 0 AS o, CASE WHEN event_id % 83 = 1 THEN 'bad_reference' WHEN event_id % 79 = 2 THEN 'negative_amount' END AS early, {_money_told('event_id')},
        [CASE WHEN gate > 2e9 THEN 'implausible_amount' END, CASE WHEN sold > capacity THEN 'tickets_over_capacity' END, CASE WHEN buys * price > 0 AND abs(revenue - buys * price) / (buys * price) > 0.2 THEN 'ppv_revenue_mismatch' END, CASE WHEN price > 150 THEN 'implausible_ppv_price' END,
        CASE WHEN gate / sold < 5 OR gate / sold > 20000 THEN 'implausible_ticket_price' END] AS w FROM (SELECT event_id, CASE WHEN event_id % 67 = 11 THEN 3e9 ELSE event_id % 1000 * 1000.0 END AS gate, event_id % 9000 + 100 AS sold, CASE WHEN event_id % 31 = 3 THEN 50 ELSE 20000 END AS capacity,
        CASE WHEN event_id % 3 = 0 THEN event_id * 10 END AS buys, CASE WHEN event_id % 37 = 4 THEN 500 ELSE 60 END AS price, CASE WHEN event_id % 3 = 0 THEN event_id * 600 * CASE WHEN event_id % 41 = 5 THEN 2 ELSE 1 END END AS revenue FROM league_events)""",
    "purse": f"""SELECT 'x' || bout_id || '/b' || who AS ref, CASE WHEN n % 89 = 2 THEN 'x-1' ELSE 'x' || bout_id END || '|' || bx AS o, CASE WHEN n % 89 = 2 THEN 'bad_reference' WHEN least(g, b, t) < 0 THEN 'negative_amount' WHEN coalesce(g, b, t) IS NULL THEN 'empty_purse' END AS early, {_money_told('n')},
        [CASE WHEN bx NOT IN (boxer_id, opp_id) THEN 'purse_not_in_bout' END, CASE WHEN t > 6e8 THEN 'implausible_purse' END, CASE WHEN t + 1 < g THEN 'purse_total_below_guarantee' END, CASE WHEN abs(g + b - t) > greatest(1000, t * 0.02) THEN 'purse_parts_mismatch' END] AS w, g, b, t, n
        FROM (SELECT *, CASE WHEN n % 97 = 3 THEN 6 ELSE who END AS bx, CASE WHEN n % 73 = 4 THEN -1 WHEN n % 71 = 5 THEN NULL WHEN n % 67 = 6 THEN u * 2 ELSE u * 0.75 END::DOUBLE AS g, CASE WHEN n % 71 = 5 THEN NULL WHEN n % 31 = 7 THEN u ELSE u * 0.25 END::DOUBLE AS b,
        CASE WHEN n % 71 = 5 THEN NULL WHEN n % 103 = 8 THEN 7e8 ELSE u END::DOUBLE AS t FROM (SELECT bout_id, boxer_id, opp_id, bout_id + boxer_id AS n, (bout_id % 900 + 100) * 1000.0::DOUBLE AS u, CASE WHEN (bout_id + boxer_id) % 101 = 1 THEN opp_id ELSE boxer_id END AS who FROM won))""",
    "broadcast": f"""SELECT 'e' || CASE WHEN event_id % 29 = 1 THEN event_id - 1 ELSE event_id END || '/one' AS ref, 'e' || event_id AS o, CASE WHEN event_id % 83 = 1 THEN 'bad_reference' WHEN event_id % 37 = 2 THEN 'missing_broadcaster' WHEN event_id % 31 = 3 THEN 'bad_platform' WHEN event_id % 41 = 4 THEN 'negative_amount' END AS early,
        {_money_told('event_id')}, [CASE WHEN peak < event_id * 10 THEN 'peak_below_average' END, CASE WHEN peak > 4e8 THEN 'implausible_audience' END] AS w FROM (SELECT *, CASE WHEN event_id % 19 = 5 THEN event_id WHEN event_id % 67 = 6 THEN 500000000 ELSE event_id * 20 END AS peak FROM league_events)""",
    "earning": f"""SELECT 'b' || CASE WHEN boxer_id % 29 = 1 THEN boxer_id - 1 ELSE boxer_id END || '/1999' AS ref, 'b' || boxer_id AS o, CASE WHEN boxer_id % 83 = 1 THEN 'bad_reference' WHEN boxer_id % 37 = 2 THEN 'bad_year' WHEN t IS NULL OR boxer_id % 41 = 5 THEN 'negative_amount' END AS early, {_money_told('boxer_id')},
        [CASE WHEN abs(r + boxer_id * 50000 - t) > greatest(1000, t * 0.02) THEN 'earning_parts_mismatch' END, CASE WHEN t > 1.2e9 THEN 'implausible_earning' END] AS w
        FROM (SELECT boxer_id, CASE WHEN boxer_id % 31 = 3 THEN NULL WHEN boxer_id % 23 = 4 THEN 1.3e9 ELSE boxer_id * 100000 END AS t, CASE WHEN boxer_id % 19 = 6 THEN boxer_id * 100000 ELSE boxer_id * 50000 END AS r FROM fighters)""",
    "weigh_in": f"""SELECT 'x' || bout_id || '/b' || who AS ref, CASE WHEN n % 89 = 2 THEN 'x-1' ELSE 'x' || bout_id END || '|' || bx AS o, CASE WHEN n % 89 = 2 THEN 'bad_reference' WHEN bx NOT IN (boxer_id, opp_id) THEN 'weigh_in_not_in_bout' WHEN coalesce(g, b) IS NULL OR least(g, b) < 0 THEN 'bad_weight' END AS early, {_money_told('n')},
        [CASE WHEN g NOT BETWEEN 85 AND 400 OR b NOT BETWEEN 85 AND 400 THEN 'implausible_weight' END, CASE WHEN b < g - 3 THEN 'fight_night_below_weigh_in' END] AS w, g, b, n
        FROM (SELECT *, CASE WHEN n % 97 = 3 THEN 6 ELSE who END AS bx, CASE WHEN n % 73 = 4 THEN -1 WHEN n % 71 = 5 THEN NULL WHEN n % 67 = 6 THEN 30 ELSE official_lb END AS g, CASE WHEN n % 71 = 5 THEN NULL WHEN n % 31 = 7 THEN official_lb - 5 ELSE night_lb END AS b
        FROM (SELECT *, bout_id + boxer_id AS n, CASE WHEN (bout_id + boxer_id) % 101 = 1 THEN opp_id ELSE boxer_id END AS who FROM weights))""",
}
_REPEATS = {"purse": "dup_purse", "broadcast": "dup_broadcast", "earning": "dup_earning", "weigh_in": "dup_weigh_in"}


def _money(entity: str, frame: str) -> str:
    """A repeat's warnings are those of whichever row is kept, so refs with a repeat are told by their number of rows alone."""
    again = f"CASE WHEN count(*) OVER (PARTITION BY ref) > 1 THEN true ELSE false END" if entity in _REPEATS else "false"
    return f"""SELECT 'error' AS severity, coalesce(early, unnamed) AS code, '{entity}' AS entity, ref AS id FROM ({frame}) WHERE coalesce(early, unnamed) IS NOT NULL
        UNION ALL SELECT u.s, u.c, '{entity}', ref FROM (SELECT ref, unnest(list_filter(list_concat([CASE WHEN old THEN {{'s': 'warning', 'c': 'bad_retrieved_at'}} END, CASE WHEN ftp THEN {{'s': 'warning', 'c': 'bad_source_url'}} END], list_transform(w, lambda c: CASE WHEN c IS NOT NULL THEN {{'s': 'warning', 'c': c}} END)), lambda x: x IS NOT NULL)) AS u
            FROM (SELECT *, {again} AS again FROM ({frame}) WHERE coalesce(early, unnamed) IS NULL) WHERE NOT again)
        {f"UNION ALL SELECT 'error', '{_REPEATS[entity]}', '{entity}', ref FROM (SELECT ref, unnest(range(count(*) - 1)) FROM ({frame}) WHERE coalesce(early, unnamed) IS NULL GROUP BY ref HAVING count(*) > 1)" if entity in _REPEATS else ''}"""


_STORIES = {
    "dq02": " UNION ALL ".join(_money(k, v) for k, v in _MONEY_FRAMES.items()),
    "srch08": "SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS rank, 0::BIGINT AS slips FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_name), 'widg')",
    "srch02": """SELECT id, name, rank, sum(d)::BIGINT AS slips FROM (SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS rank, asked, min(damerau_levenshtein(word, asked)) AS d FROM (SELECT *, unnest(string_split(lower(p_name), ' ')) AS word FROM part),
        (VALUES ('smlal', 1), ('widgte', 1)) v(asked, most) WHERE damerau_levenshtein(word, asked) <= most GROUP BY ALL) GROUP BY ALL HAVING count(*) = 2""",
    "join17_fuzzy": """SELECT asked, word, damerau_levenshtein(word, asked) AS distance, n FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) WHERE word <> '' GROUP BY ALL), (VALUES ('smlal'), ('widgte'), ('anvli'), ('gizmoo'), ('gear')) v(asked)
        WHERE damerau_levenshtein(word, asked) <= CASE WHEN length(asked) <= 3 THEN 0 WHEN length(asked) <= 6 THEN 1 ELSE 2 END""",
    "dq08": f"@{_SUP} SELECT * FROM rec",
    "dq10": f"""@{_SUP}, f AS (SELECT w.*, r.sup_wins, r.sup_losses, r.sup_draws, datediff('day', lag(date) OVER (PARTITION BY w.boxer_id, opp_id ORDER BY date, bout_id), date) <= 30 AS again, count(*) OVER (PARTITION BY w.boxer_id, date) > 1 AS twice, date < DATE '2000-06-16' AS old
            FROM won w JOIN (SELECT * FROM rec WHERE verdict = 'conflict') r USING (boxer_id)),
        g AS (SELECT boxer_id, sup_wins AS sw, sup_losses AS sl, sup_draws AS sd, count(*) FILTER (result = 'W') AS w, count(*) FILTER (result = 'L') AS l, count(*) FILTER (result = 'D') AS d, coalesce(bool_or(again), false) AS again, bool_or(twice) AS twice,
            count(*) FILTER (result = 'W' AND old) <= sup_wins AND count(*) FILTER (result = 'L' AND old) <= sup_losses AND count(*) FILTER (result = 'D' AND old) <= sup_draws AS recent,
            count(*) FILTER (result = 'W' AND rounds > 3) <= sup_wins AND count(*) FILTER (result = 'L' AND rounds > 3) <= sup_losses AND count(*) FILTER (result = 'D' AND rounds > 3) <= sup_draws AS short FROM f GROUP BY boxer_id, sup_wins, sup_losses, sup_draws),
        h AS (SELECT *, w > 0 AND w - 1 <= sw AND l + 1 <= sl AND d <= sd AS fw, l > 0 AND w + 1 <= sw AND l - 1 <= sl AND d <= sd AS fl FROM g),
        e AS (SELECT x.boxer_id, max(CASE WHEN o.verdict = 'conflict' AND o.wins + gain <= o.sup_wins AND o.losses - gain <= o.sup_losses AND o.draws <= o.sup_draws THEN 2
            WHEN o.verdict = 'complete' OR (o.verdict = 'partial' AND (o.wins + gain > o.sup_wins OR o.losses - gain > o.sup_losses OR o.draws > o.sup_draws)) THEN 0 ELSE 1 END) AS k
            FROM (SELECT w.boxer_id, opp_id, CASE result WHEN 'W' THEN 1 ELSE -1 END AS gain FROM won w JOIN h USING (boxer_id) WHERE (result = 'W' AND fw) OR (result = 'L' AND fl)) x JOIN rec o ON o.boxer_id = x.opp_id GROUP BY x.boxer_id)
        SELECT boxer_id, coalesce(nullif(concat_ws(',', CASE WHEN d > sd THEN 'draw' END, CASE WHEN again THEN 'repeat' END, CASE WHEN twice THEN 'same-day' END, CASE WHEN recent THEN 'recent' END, CASE WHEN short THEN 'short' END,
            CASE WHEN NOT (again OR twice OR recent OR short) AND w > sw THEN 'wins' END, CASE WHEN NOT (again OR twice OR recent OR short) AND l > sl THEN 'losses' END, CASE WHEN fw OR fl THEN 'flipped' END), ''), 'unexplained') AS causes,
            ['contradicted', 'open', 'mutual'][k + 1] AS flip FROM h LEFT JOIN e USING (boxer_id)""",
    "dq18": """@edits AS (SELECT event_id AS k, event_id % ((SELECT count(*) FROM fighters) + 50) AS boxer_id, CASE event_id % 3 WHEN 0 THEN upper(s_name) WHEN 1 THEN s_name ELSE 'New Coach ' || event_id % 17 END AS name FROM events JOIN supplier ON s_suppkey = event_id % (SELECT count(*) FROM supplier) WHERE event_id % 4 >= 2),
        placed AS (SELECT e.*, p.person FROM edits e LEFT JOIN (SELECT lower(s_name) AS key, min('p' || s_suppkey) AS person FROM supplier GROUP BY 1) p ON lower(name) = key)
        SELECT source, person, count(*) AS n FROM (SELECT 'feed' AS source, 'p' || person_id AS person FROM stints WHERE boxer_id % 7 <> 0
            UNION ALL SELECT 'Community edit', coalesce(person, 'community:' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-')) FROM placed WHERE boxer_id IN (SELECT boxer_id FROM fighters)
            UNION ALL SELECT 'skipped', '' FROM placed WHERE boxer_id NOT IN (SELECT boxer_id FROM fighters)) GROUP BY ALL""",
    "str05": f"""@c AS (SELECT bout_id, bout_id || ':' || field AS target, sha256('{{"kind":"' || kind || '"' || CASE WHEN "new" IS NULL THEN '' ELSE ',"new":"' || "new" || '"' END || '}}')[1:32] AS fp FROM ({_CHANGES}))
        SELECT target, CASE WHEN bout_id % 4 = 0 THEN CASE WHEN bout_id % 8 = 0 THEN 'unchanged' ELSE 'updated' END WHEN bout_id % 4 = 1 AND bout_id % 60 < 30 THEN 'remembered' ELSE 'added' END AS outcome FROM c
        UNION ALL SELECT bout_id || ':ghost', 'superseded' FROM bouts WHERE bout_id % 50 = 3 AND NOT ends_with(bout_id::VARCHAR, '3003')""",
    "lnk07": """@v AS (SELECT DISTINCT venue || '|' || country AS venue_id, venue AS name, 'City ' || split_part(venue, ' ', 2)::BIGINT % 7 || ' ' || country AS city, country FROM league_events),
        g AS (SELECT n_nationkey::BIGINT AS n, n_name, h, [1000 + h * 10, 1200, 900 + n_nationkey][1:n_nationkey % 4] AS caps FROM nation, (SELECT unnest(range(40)) AS h)),
        c AS (SELECT n * 1000 + h * 10 AS qid, 'Hall ' || h AS label, 'Hall ' || h AS name, 'City ' || h % 7 || ' ' || n_name AS place, n_name, caps FROM g WHERE (n + h) % 3 <> 0
            UNION ALL SELECT n * 1000 + h * 10 + 1, 'Old Hall', 'Hall ' || h, 'City 99', n_name, caps FROM g WHERE (n * h) % 4 = 1
            UNION ALL SELECT n * 1000 + h * 10 + 2, 'Hall ' || h, 'Hall ' || h, 'City ' || h % 7 || ' ' || n_name, n_name, caps FROM g WHERE (n + 2 * h) % 11 = 0),
        x AS (SELECT v.venue_id, count(c.qid) AS named, count(*) FILTER (place = city) AS nc, count(*) FILTER (n_name = country) AS nl, count(*) FILTER (place = city AND label = c.name) AS lc, count(*) FILTER (n_name = country AND label = c.name) AS ll,
            arg_min(c, qid) FILTER (place = city) AS oc, arg_min(c, qid) FILTER (n_name = country) AS ol, arg_min(c, qid) FILTER (place = city AND label = c.name) AS bc, arg_min(c, qid) FILTER (n_name = country AND label = c.name) AS bl FROM v LEFT JOIN c ON c.name = v.name GROUP BY ALL),
        y AS (SELECT *, CASE WHEN nc > 0 THEN CASE WHEN nc = 1 THEN oc WHEN lc = 1 THEN bc END WHEN nl = 1 THEN ol WHEN nl > 1 AND ll = 1 THEN bl END AS t FROM x)
        SELECT venue_id, CASE WHEN named = 0 THEN 'no such name' WHEN nc = 0 AND nl = 0 THEN 'elsewhere' WHEN t IS NULL THEN 'ambiguous' ELSE 'matched' END AS status, t.qid AS qid, CASE WHEN t IS NOT NULL THEN CASE WHEN nc > 0 THEN 'city' ELSE 'country' END END AS basis,
            list_median(t.caps)::DOUBLE AS capacity FROM y""",
    "mdl12": """@gain AS (SELECT bout_id, boxer_id, w.night_lb, coalesce(avg(w.night_lb - w.official_lb) OVER (PARTITION BY boxer_id ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rehyd FROM weights w WHERE bout_id IN (SELECT bout_id FROM bouts WHERE counted)),
        head AS (SELECT bout_id, boxer_id, date, max(result) AS result, min(start) AS since, arg_min(person_id, (start, person_id)) AS person FROM instint GROUP BY ALL),
        led AS (SELECT person, bout_id, sum(n) OVER p AS n, sum(won) OVER p AS won FROM (SELECT person, date, bout_id, count(*) FILTER (result <> 'D') AS n, count(*) FILTER (result = 'W') AS won FROM head GROUP BY ALL) WINDOW p AS (PARTITION BY person ORDER BY date, bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        run AS (SELECT w.bout_id, w.boxer_id, w.date, w.pre / 100 AS elo, f.reach_cm AS reach, year(w.date) - f.birth_year AS age, coalesce(least(36, datediff('day', lag(w.date) OVER o, w.date) / 30.4), 12) AS idle, count(*) OVER p AS before,
            CASE WHEN count(*) FILTER (result = 'W') OVER p > 0 THEN count(*) FILTER (result = 'W' AND stopped) OVER p / count(*) FILTER (result = 'W') OVER p ELSE 0 END AS ko, CASE WHEN count(*) OVER p > 0 THEN count(*) FILTER (result = 'L' AND stopped) OVER p / count(*) OVER p ELSE 0 END AS chin
            FROM won w JOIN fighters f ON f.boxer_id = w.boxer_id WINDOW o AS (PARTITION BY w.boxer_id ORDER BY w.date, w.bout_id), p AS (PARTITION BY w.boxer_id ORDER BY w.date, w.bout_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        s AS (SELECT r.*, ln(1 + before) AS exp, coalesce(g.rehyd, 0) AS rehyd, g.night_lb AS edge, CASE WHEN datediff('day', since, r.date) / 30.4 < 6 THEN 1 ELSE 0 END AS fresh, CASE WHEN led.n >= 8 THEN led.won / led.n ELSE 0.5 END AS tw
            FROM run r LEFT JOIN gain g ON g.bout_id = r.bout_id AND g.boxer_id = r.boxer_id LEFT JOIN head h ON h.bout_id = r.bout_id AND h.boxer_id = r.boxer_id LEFT JOIN led ON led.bout_id = r.bout_id AND led.person = h.person WHERE before >= 1)
        SELECT b.bout_id, b.date, ((winner_id = red_id) <> (b.bout_id % 2 = 1))::BIGINT AS y, """ + ", ".join(
        f"round(CASE WHEN b.bout_id % 2 = 1 THEN -1 ELSE 1 END * coalesce(r.{c} - u.{c}, 0)::DOUBLE, 6) AS {n}" for n, c in (("elo", "elo"), ("reach", "reach"), ("age", "age"), ("idle", "idle"), ("ko", "ko"), ("chin", "chin"), ("exp", "exp"), ("rehyd", "rehyd"), ("weight_edge", "edge"), ("new_trainer", "fresh"), ("trainer_wins", "tw"))
    ) + " FROM bouts b JOIN s r ON r.bout_id = b.bout_id AND r.boxer_id = red_id JOIN s u ON u.bout_id = b.bout_id AND u.boxer_id = blue_id WHERE winner_id IS NOT NULL",
    "vw02": f"""@{_RECAPS} SELECT bout_id, date, winner_id, winner_before, winner_after, winner_record, win_run, loser_id, loser_before, loser_after, loser_record, loss_run, unbeaten_ended, first_stoppage, round(p, 6) AS chance, title_change, defence,
        CASE WHEN p < 0.25 THEN 'major-upset' WHEN p < 0.4 THEN 'upset' WHEN p >= 0.75 THEN 'heavy-favourite' WHEN p >= 0.6 THEN 'expected' WHEN p IS NOT NULL THEN 'close' END AS surprise FROM recaps""",
    "vw03": f"""@{_RECAPS}, x AS (SELECT r.*, b.event_id, b.stopped, b.end_round, (b.end_round - 1) * 180 + coalesce(split_part(b.round_time, ':', 1)::INT * 60 + split_part(b.round_time, ':', 2)::INT, 0) AS seconds FROM recaps r JOIN bouts b USING (bout_id) WHERE NOT b.cancelled)
        SELECT event_id, count(*) AS decided, count(*) FILTER (stopped) AS early, count(*) FILTER (title_change = 'crowned') AS crowned, count(*) FILTER (title_change = 'defended') AS defended, count(ok) AS called, count(*) FILTER (ok) AS called_right,
        arg_min(bout_id, (p, bout_id)) FILTER (p < 0.4) AS upset_id, arg_min(bout_id, (seconds, bout_id)) FILTER (stopped AND end_round IS NOT NULL) AS fastest_id, arg_min(winner_id, (-win_run, bout_id)) FILTER (win_run >= 3) AS run_id,
        max(win_run) FILTER (win_run >= 3) AS run, count(unbeaten_ended) AS unbeaten_ended FROM x GROUP BY event_id""",
    "vw05": """@d AS (SELECT strftime(date, '%m-%d') AS day, count(*) AS fights, count(DISTINCT year(date)) AS years FROM bouts WHERE method IS NOT NULL AND NOT cancelled AND date <= DATE '2000-06-30' GROUP BY 1)
        SELECT *, coalesce(lead(day) OVER (ORDER BY day), (SELECT min(day) FROM d)) AS next_day FROM d""",
    "vw06": f"""@{_BELTS}, c AS (SELECT k.*, r.rank FROM careers k LEFT JOIN (SELECT boxer_id, rank FROM ranking) r USING (boxer_id)),
        x AS (SELECT bout_id, red_id, blue_id, b.title, title_vacant, holder_id, a AS r, o AS u FROM bouts b JOIN c a ON red_id = a.boxer_id JOIN c o ON blue_id = o.boxer_id LEFT JOIN belts t ON t.title_org = b.title_org AND t.title = b.title AND t.division = b.division AND t.sex = b.sex WHERE upcoming)
        SELECT bout_id, """ + ", ".join(f"CASE WHEN r.{c} {'>' if more else '<'} u.{c} THEN 'red' WHEN r.{c} <> u.{c} THEN 'blue' END AS {c}" for c, more in (("win_rate", 1), ("ko_rate", 1), ("rating", 1), ("rank", 0), ("age", 0), ("height_cm", 1), ("reach_cm", 1)))
        + """, CASE WHEN r.streak >= 2 AND r.streak_type <> 'D' THEN r.streak_type || r.streak END AS red_form, CASE WHEN u.streak >= 2 AND u.streak_type <> 'D' THEN u.streak_type || u.streak END AS blue_form,
        CASE WHEN title IS NULL THEN NULL WHEN title_vacant OR holder_id IS NULL THEN 'vacant' WHEN holder_id IN (red_id, blue_id) THEN 'defence' ELSE 'on the line' END AS belt FROM x""",
    "vw12": """SELECT boxer_id, name || ' is a ' || CASE WHEN age IS NOT NULL THEN age || '-year-old ' ELSE '' END || CASE WHEN stance IS NOT NULL THEN lower(stance) || ' ' ELSE '' END || lower(division) || ' from ' || country || ', ' || wins || '-' || losses || '-' || draws || ' with ' || kos || ' knockouts ('
        || floor(round(100 * ko_rate, 9) + 0.5)::BIGINT || '% of wins). Rated ' || floor(rating + 0.5)::BIGINT || ', #' || rank() OVER (PARTITION BY division, sex ORDER BY rating DESC) || ' of the class.' AS line FROM careers WHERE active""",
    "vw12_matchup": f"""@{_FEATURES}, g AS (SELECT *, abs(2 * p_red - 0.97) AS gap FROM chances) SELECT bout_id, CASE WHEN gap < 0.12 THEN 'Toss-up' WHEN gap < 0.3 THEN 'Lean' WHEN gap < 0.55 THEN 'Clear favourite' ELSE 'Heavy favourite' END || ': ' || name || ' '
        || floor(round(100 * greatest(p_red, 0.97 - p_red), 9) + 0.5)::BIGINT || '%. ' || CASE WHEN p_stop > 0.5 THEN 'Expect a stoppage.' ELSE 'Likely goes the distance.' END AS line FROM g JOIN fighters ON boxer_id = CASE WHEN p_red >= 0.97 - p_red THEN red_id ELSE blue_id END""",
    "vw13": f"""@{_OFFICIAL} SELECT division, sex, body, coalesce(string_agg(boxer_id::VARCHAR, ',' ORDER BY boxer_id) FILTER (kind = 'champion'), '') AS champions, coalesce(string_agg(boxer_id::VARCHAR, ',' ORDER BY rank, boxer_id) FILTER (kind = 'contender'), '') AS contenders,
        list_position(['WBA', 'WBC', 'IBF', 'WBO'], body) AS place FROM official GROUP BY ALL""",
    "vw13_fighters": f"""@{_OFFICIAL} SELECT boxer_id, string_agg(said, '; ' ORDER BY list_position(['WBA', 'WBC', 'IBF', 'WBO'], body), coalesce(rank, 0), said) AS places FROM (SELECT *, body || ' ' || sex || ' ' || division || ' ' || coalesce(rank::VARCHAR, 'champion') AS said FROM official) GROUP BY ALL""",
    "snk05": f"@{_OFFICIAL} SELECT * FROM official",
    "win17": "SELECT archetype, boxer_id, rating FROM careers WHERE bouts >= 8 QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY rating DESC, boxer_id) <= 400",
    "mdl25": f"""@{_BELTS}, c AS (SELECT k.*, rank, CASE WHEN bouts > 0 THEN ko_losses / bouts ELSE 0 END AS chin, coalesce(m, 24) AS idle, CASE WHEN NOT active THEN 0 WHEN m IS NULL THEN 0.5 WHEN m < 1.5 THEN 0.15 WHEN m < 2 THEN 0.45 WHEN m <= 9 THEN 1 WHEN m <= 18 THEN 0.7 WHEN m <= 30 THEN 0.4 ELSE 0.15 END AS fresh
            FROM (SELECT *, datediff('day', last_fight, DATE '2000-06-30') / 30.4 AS m FROM careers) k JOIN (SELECT boxer_id, rank FROM ranking WHERE rank <= 8) USING (boxer_id)),
        met AS (SELECT least(red_id, blue_id) AS lo, greatest(red_id, blue_id) AS hi, count(*) AS met, arg_min(method, (date, bout_id)) AS fm FROM bouts WHERE counted GROUP BY 1, 2),
        live AS (SELECT * FROM belts WHERE NOT dormant),
        x AS (SELECT a.boxer_id AS a_id, b.boxer_id AS b_id, a.rating AS ra, b.rating AS rb, a.rank AS ka, b.rank AS kb, a.fresh AS fa, b.fresh AS fb, a.ko_rate + b.ko_rate AS ko, met, fm, least(a.archetype, b.archetype) || '|' || greatest(a.archetype, b.archetype) AS pair,
            1 / (1 + exp(-(ln(10) / 400 * (a.rating - b.rating) + CASE WHEN a.reach_cm IS NOT NULL AND b.reach_cm IS NOT NULL THEN 0.016 * least(12, greatest(-12, a.reach_cm - b.reach_cm)) ELSE 0 END
            + CASE WHEN a.age IS NOT NULL AND b.age IS NOT NULL THEN 0.03 * (greatest(0, b.age - 34) - greatest(0, a.age - 34)) ELSE 0 END + 0.01 * (greatest(0, b.idle - 12) - greatest(0, a.idle - 12)) + 0.2 * (a.ko_rate - b.ko_rate) + 0.2 * (b.chin - a.chin)))) AS p0,
            EXISTS (SELECT 1 FROM live WHERE holder_id = a.boxer_id) AS ha, EXISTS (SELECT 1 FROM live WHERE holder_id = b.boxer_id) AS hb,
            EXISTS (SELECT 1 FROM live l JOIN live m ON l.division = m.division AND l.title = m.title AND l.title_org <> m.title_org AND l.sex = m.sex WHERE l.holder_id = a.boxer_id AND m.holder_id = b.boxer_id) AS unify
            FROM c a JOIN c b ON a.division = b.division AND a.sex = b.sex AND a.rank < b.rank LEFT JOIN met ON lo = least(a.boxer_id, b.boxer_id) AND hi = greatest(a.boxer_id, b.boxer_id)),
        y AS (SELECT *, 0.28 * least(1, greatest(0, 1 - abs(2 * least(0.96, greatest(0.04, p0)) - 1) * 0.97)) + 0.18 * least(1, greatest(0, 1 - abs(ra - rb) / 320 + CASE WHEN ka <= 10 AND kb <= 10 THEN 0.2 ELSE 0 END))
            + 0.14 * least(1, greatest(0, 0.4 * coalesce(map {{'Iron-Chin Brawler|Knockout Artist': 1.0, 'Knockout Artist|Knockout Artist': 0.9, 'Iron-Chin Brawler|Iron-Chin Brawler': 0.85, 'Counter-Puncher|Knockout Artist': 0.85, 'Counter-Puncher|Volume Boxer': 0.78, 'Counter-Puncher|Iron-Chin Brawler': 0.8, 'Technician|Volume Boxer': 0.7,
                'Counter-Puncher|Technician': 0.55, 'Technician|Technician': 0.45, 'Volume Boxer|Volume Boxer': 0.6, 'Knockout Artist|Technician': 0.75, 'Knockout Artist|Volume Boxer': 0.8, 'Iron-Chin Brawler|Technician': 0.7, 'Iron-Chin Brawler|Volume Boxer': 0.75}}[pair]::DOUBLE, CASE WHEN contains(pair, 'Journeyman') THEN 0.2 WHEN contains(pair, 'Prospect') THEN 0.35 ELSE 0.5 END)
                + 0.35 * ko / 2 + 0.25 * least(1, greatest(0, ((ra + rb) / 2 - 1450) / 300)))) + 0.14 * least(fa, fb) + 0.12 * CASE WHEN met IS NULL THEN 1 WHEN met > 1 THEN 0.15 WHEN fm IN ('SD', 'MD', 'DRAW', 'TD', 'TDRAW') THEN 0.7 ELSE 0.35 END
            + 0.14 * CASE WHEN unify THEN 1 WHEN (ha OR hb) AND CASE WHEN ha THEN kb ELSE ka END <= 5 THEN 0.75 WHEN ha OR hb THEN 0.3 ELSE 0 END AS total FROM x)
        SELECT a_id, b_id, floor(round(100 * total, 9) + 0.5)::BIGINT AS score FROM y ORDER BY score DESC, a_id, b_id LIMIT 40""",
}


def _folded(x: str) -> str:
    """A text as spellings meet, for the characters that the tables hold."""
    x = f"regexp_replace(strip_accents({x}), '[\u064b-\u065f\u0670\u0640]', '', 'g')"
    x = f"translate(lower(translate({x}, 'أإآٱىة', 'اااايه')), 'łđðøı', 'lddoi')"
    x = f"replace(replace(replace(replace({x}, 'æ', 'ae'), 'œ', 'oe'), 'ß', 'ss'), 'þ', 'th')"
    for long, short in (("junior", "jr"), ("senior", "sr"), ("2nd", "ii"), ("3rd", "iii"), ("4th", "iv")):
        x = rf"regexp_replace({x}, '\b{long}\b', '{short}', 'g')"
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _name_key(x: str) -> str:
    return rf"nullif(trim(regexp_replace({_folded(x)}, '[^\p{{L}}\p{{M}}\p{{N}}]+', ' ', 'g')), '')"


_PROFILES = f"""profiles AS (
    SELECT boxer_id, {_name_key("name")} AS key, CASE WHEN p % 13 <> 0 THEN 1955 + p % 30 END AS birth_year, p % 40 + CASE WHEN p % 7 = 0 THEN boxer_id % 2 ELSE 0 END AS wins,
        CASE WHEN p % 17 <> 0 THEN p % 9 END AS losses, p % 3 AS draws, bouts, name
    FROM (SELECT boxer_id, boxer_id // 2 AS p, bouts, CASE WHEN boxer_id % 2 = 0
        THEN ['José Peña', 'Łukasz Østby', 'Šimun Đurek', 'Иван Ёлкин', 'أحمد علي', 'Zoë Groß', 'Jörg Ælin Junior', 'O’Néa-Lee', 'محمد سعيد', 'Ivan Petrov'][p % 10 + 1]
        ELSE ['JOSE PENA', 'lukasz ostby', 'Simun Durek', 'ИВАН ЕЛКИН', 'احمد على', 'Zoe  Gross', 'Jorg Aelin Jr.', 'O Nea Lee', 'محمود سعيد', 'Иван Петров'][p % 10 + 1] END || ' ' || p % 211 AS name FROM careers)),
copies AS (
    SELECT key, birth_year, count(*) AS n, arg_max(boxer_id, (bouts, -boxer_id)) AS keep_id, list(boxer_id ORDER BY boxer_id) AS ids FROM profiles
    WHERE birth_year IS NOT NULL AND key IS NOT NULL AND wins + losses + draws >= 3 GROUP BY key, birth_year, wins, losses, draws HAVING count(*) > 1)"""

_REGISTERS = ", ".join(
    f"""{t} AS (SELECT {key} AS id, CASE WHEN {key} % 10 = 0 THEN {key} END AS ext, ({key} * {factor} + 7) % 5003 AS name, CASE WHEN {key} % 3 <> 0 THEN 1955 + {key} % 30 + {late} END AS year,
        CASE WHEN {nation} IN (3, 4) THEN -1 ELSE {nation} % 3 END AS nation, 1975 + {key} % 25 AS first, 1975 + {key} % 25 + {key} % 12 AS last, CASE WHEN {key} % 6 = 0 THEN 1985 + {key} % 20 END AS died FROM {table})"""
    for t, table, key, nation, factor, late in (("s", "supplier", "s_suppkey", "s_nationkey", 53, "0"), ("c", "customer", "c_custkey", "c_nationkey", 37, "CASE WHEN c_custkey % 20 = 0 THEN 5 ELSE 0 END"))
)

_READ_CLASSES = [
    ("WELTERWEIGHT", "Welterweight"), ("jr welter weight", "Super Lightweight"), ("Light Middleweight", "Super Welterweight"), ("154 lb", "Super Welterweight"), ("super_middle", "Super Middleweight"), ("Ladies Feather", "Featherweight"),
    ("Super Lightweight (140 lbs)", "Super Lightweight"), ("above 200", "Heavyweight"), ("200 + pounds", "Heavyweight"), ("Junior Light", "Super Featherweight"), ("Heavy", "Heavyweight"), ("cruiser weight 200lbs", "Cruiserweight"),
    ("160 Pound", "Middleweight"), ("atom", "Minimumweight"), ("Openweight", None), ("Super Fly", "Super Flyweight"), ("Super-Flyweight (108)", "Light Flyweight"), ("126", None), ("Male Hw", "Heavyweight"),
]
_READ_CHANNELS = [
    ("SHOWTIME Sports", "Showtime"), ("Show Time", "Showtime"), ("ESPN Deportes", "ESPN"), ("Espn+", "ESPN+"), ("espn  + UK", "ESPN+"), ("BTSport 2", "TNT Sports"), ("TNT Sport", "TNT Sports"), ("TrillerTV Live", "TrillerTV"),
    ("triller tv", "TrillerTV"), ("PPV", None), ("tba", None), ("Unknown", None), ("  Radio   Sud ", "Radio Sud"), ("dazn Italia", "DAZN"), ("FOX", "FOX"), ("Sky  Sports Arena", "Sky Sports"), ("FuboTV", "Fubo"), ("Foxes", "Foxes"),
    ("HBO Max", "HBO"), ("Amazon", "Amazon Prime Video"), (" ", None),
]


def _read(table: str, key: str, spellings: list[tuple[str, str | None]]) -> str:
    rows = ", ".join(f"({i}, '{s}', {repr(r) if r else 'NULL'})" for i, (s, r) in enumerate(spellings))
    return f"SELECT s AS spelled, r AS read, count(*) AS n FROM {table} JOIN (VALUES {rows}) v(i, s, r) ON {key} % {len(spellings)} = i GROUP BY ALL"


_REIGN_ROWS = """told AS (
    SELECT title_org || '|' || r.title || '|' || r.division || '|' || r.sex || '|' || (reign_no - 1) // 50 AS page, upper(r.division[1]) || lower(r.division[2:]) || 'weight' AS division, r.title AS category, (reign_no - 1) % 50 + 1 AS place,
        CASE WHEN reign_no % 4 = 2 AND (reign_no - 1) % 50 > 0 THEN reign_no - 1 WHEN reign_no % 4 <> 2 THEN reign_no END AS number, f.name, CASE WHEN champion_id % 7 <> 0 THEN 'Fighter ' || champion_id END AS article,
        g.name AS opponent, NULL::VARCHAR AS note, strftime(start, '%Y-%m-%d') AS start, strftime("end", '%Y-%m-%d') AS "end", "end" IS NULL AS current, ended_by AS end_note, defences, champion_id
    FROM reigns r JOIN fighters f ON champion_id = f.boxer_id LEFT JOIN fighters g ON from_id = g.boxer_id)"""

_FACTS_TOLD = """claims AS (
    SELECT bout_id * 1000000 + boxer_id * 10 + i AS claim_id, CASE WHEN bout_id % 5 = 0 THEN 'weigh_in' ELSE 'purse' END AS kind, bout_id || '/' || boxer_id AS subject,
        ['en.wikipedia.org', 'desk.example', 'court.example.gov', 'www.wikidata.org', 'wire.example'][CASE WHEN bout_id % 3 = 0 THEN i % 4 ELSE i END + 1] AS host,
        round(CASE WHEN bout_id % 41 = 0 THEN 0 WHEN bout_id % 5 = 0 THEN 140::DOUBLE * (1 + (f - 1) / 10) ELSE (bout_id % 900 + 100) * 1000::DOUBLE * f END, 2) AS value, i = 2 AND bout_id % 2 = 0 AS official
    FROM (SELECT *, [1, 1, 1.03, 1.049, 0.96, 1.2, 0.5][(bout_id + i * 3) % 7 + 1]::DOUBLE AS f FROM (SELECT bout_id, boxer_id, unnest(range((bout_id + boxer_id) % 5 + 1)) AS i FROM won))),
reps AS (SELECT *, CASE WHEN kind = 'weigh_in' THEN 0.005 ELSE 0.05 END::DOUBLE AS t FROM claims QUALIFY row_number() OVER (PARTITION BY subject, host ORDER BY claim_id) = 1),
near AS (SELECT a.subject, a.value, count(*) AS n, bool_or(b.host NOT LIKE '%wiki%') AS firm FROM reps a JOIN reps b ON a.subject = b.subject AND abs(a.value - b.value) <= a.t * greatest(a.value, b.value) GROUP BY a.subject, a.host, a.value),
centre AS (SELECT subject, arg_max(value, (n, -value)) AS c, max(n) AS n, arg_max(firm, (n, -value)) AS firm, count(*) AS hosts FROM near GROUP BY subject),
judged AS (
    SELECT c.claim_id, c.kind, c.host, c.value, CASE WHEN hosts = 1 THEN CASE WHEN r.official THEN 'verified' ELSE 'single_source' END
        WHEN n >= 2 AND firm THEN CASE WHEN abs(c.value - x.c) <= t * greatest(c.value, x.c) AND abs(r.value - x.c) <= t * greatest(r.value, x.c) THEN 'verified' ELSE 'conflict' END
        WHEN r.official AND (SELECT count(*) FROM reps o WHERE o.subject = c.subject AND o.official) = 1 THEN 'verified' ELSE 'conflict' END AS status
    FROM claims c JOIN reps r ON r.subject = c.subject AND r.host = c.host JOIN centre x ON x.subject = c.subject)"""

_PLACES_READ = ["United States", "United States", "United States", "The Netherlands", "Netherlands", "Turkey", "United Kingdom", "England", "Northern Ireland", "Australia", "Congo - Kinshasa", "NATION_3", "Ghana"]
_PLACES_TOLD = ["USA", "U.S.", "United States of America", "The Netherlands", "Holland", "Türkiye", "Great Britain", "England", "Northern Ireland", "New South Wales", "DR Congo", "NATION_3", "Ghana"]
_RAW = f"""raw AS (
    SELECT boxer_id AS row, CASE WHEN boxer_id % 23 <> 0 THEN boxer_id::VARCHAR END AS external_id, name, {_PLACES_READ}[boxer_id % 13 + 1] AS country, {[r for _, r in _READ_CLASSES]!r}[boxer_id % 19 + 1] AS division,
        nullif(trim({[c for c, _ in _READ_CLASSES]}[boxer_id % 19 + 1]), '') AS class_told, coalesce(stance, 'unknown') AS stance_told, stance, CASE boxer_id % 6 WHEN 0 THEN height_cm WHEN 1 THEN height_cm WHEN 2 THEN floor(inches * 2.54 + 0.5) WHEN 3 THEN floor(inches * 2.54 + 0.5) END::BIGINT AS height_cm,
        CASE WHEN height_cm IS NOT NULL OR boxer_id % 6 = 4 THEN boxer_id % 6 = 4 ELSE false END AS tall, CASE WHEN boxer_id % 9 <> 0 THEN boxer_id % 50 END AS wins, CASE WHEN boxer_id % 8 <> 0 THEN make_date(1960 + boxer_id % 40, 5, 17) END AS born, active, boxer_id % 37 = 5 AS broken
    FROM (SELECT *, floor(height_cm / 2.54 + 0.5)::BIGINT AS inches FROM fighters))""".replace("None", "NULL")

_PEOPLE = {
    "lnk06": f"""@halls0 AS (SELECT event_id, country, CASE WHEN event_id % 5 = 0 THEN 'HALL ' || event_id % 40 WHEN event_id % 5 < 3 THEN 'Háll ' || event_id % 40 ELSE 'Hall ' || event_id % 40 || CASE WHEN event_id % 7 = 0 THEN '.' ELSE '' END END AS venue,
            CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 6 = 0 THEN 'hall ' || event_id % 40 WHEN event_id % 40 < 20 THEN 'Port ' || event_id % 40 % 9 ELSE 'Port ' || event_id % 3 END AS city FROM league_events),
        halls1 AS (SELECT *, {_name_key("venue")} AS kv, {_name_key("city")} AS kc, coalesce({_name_key("country")}, '') AS kl FROM halls0),
        best AS (SELECT kv, kc, venue AS b FROM (SELECT kv, kc, venue, city, count(*) AS n FROM halls1 WHERE kc IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kv, kc ORDER BY n DESC, length(venue) <> strlen(venue) DESC, length(venue) DESC, venue) = 1),
        cities AS (SELECT kv, kl, city AS c FROM (SELECT kv, kl, city, count(*) AS n FROM halls1 WHERE kc <> kv GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY kv, kl ORDER BY n DESC, city) = 1 AND n >= 0.6 * sum(n) OVER (PARTITION BY kv, kl))
        SELECT event_id, coalesce(b, venue) AS venue, CASE WHEN h.kc = h.kv THEN coalesce(c, city) ELSE city END AS city, country FROM halls1 h LEFT JOIN best USING (kv, kc) LEFT JOIN cities USING (kv, kl)""",
    "mdl10_worst": f'@{_CALLS} SELECT bout_id, date, round(chance, 9) AS chance FROM calls WHERE NOT "right" ORDER BY round(chance, 9) DESC, date DESC, bout_id DESC LIMIT 10',
    "mdl11_verdict": f"""@{_CALLS}, bins AS (SELECT count(*) AS n, avg("right"::INT) - avg(chance) AS d FROM calls GROUP BY least(floor(round(chance * 10, 9)), 9) HAVING count(*) >= 20),
        g AS (SELECT coalesce(sum(d * n) / sum(n), 0) AS gap, coalesce(sum(n), 0)::BIGINT AS n FROM bins)
        SELECT CASE WHEN gap > 0.03 THEN 'under' WHEN gap < -0.03 THEN 'over' ELSE 'calibrated' END AS verdict, round(gap, 6) AS gap, n FROM g""",
    "src11": f"@{_RAW} SELECT row, external_id, name, country, division, stance, height_cm, wins, born, active FROM raw WHERE NOT broken AND external_id IS NOT NULL",
    "src11_problems": f"""@{_RAW} SELECT row, NULL::VARCHAR AS field, 'not_json' AS problem, NULL::VARCHAR AS told FROM raw WHERE broken
        UNION ALL SELECT row, 'external_id', 'missing', NULL FROM raw WHERE NOT broken AND external_id IS NULL
        UNION ALL SELECT row, 'division', 'unreadable', class_told FROM raw WHERE NOT broken AND division IS NULL
        UNION ALL SELECT row, 'stance', 'unreadable', 'unknown' FROM raw WHERE NOT broken AND stance IS NULL
        UNION ALL SELECT row, 'height_cm', 'unreadable', 'tall' FROM raw WHERE NOT broken AND tall
        UNION ALL SELECT row, 'wins', 'unreadable', 'many' FROM raw WHERE NOT broken AND wins IS NULL
        UNION ALL SELECT row, 'born', 'unreadable', '1980-02-30' FROM raw WHERE NOT broken AND born IS NULL""",
    "str08": """@RECURSIVE_starts AS (
            SELECT user_id, min(ts) AS start FROM events GROUP BY user_id
            UNION ALL SELECT s.user_id, min(e.ts) FROM RECURSIVE_starts s JOIN events e ON e.user_id = s.user_id AND e.ts >= s.start + INTERVAL 1 DAY GROUP BY s.user_id, s.start)
        SELECT e.user_id, s.start, count(*) AS n, greatest(0, count(*) - 2) AS refused FROM events e ASOF JOIN RECURSIVE_starts s ON e.user_id = s.user_id AND e.ts >= s.start GROUP BY ALL""",
    "str10_posts": """@posts AS (SELECT event_id AS post_id, user_id, ts, sha1(regexp_replace(lower(text), '[^a-z]', '', 'g'))[1:16] AS fp FROM events JOIN documents ON doc_id = event_id // 3 % (SELECT count(*) FROM documents))
        SELECT DISTINCT b.post_id, b.user_id FROM posts b JOIN posts a ON a.fp = b.fp AND a.user_id <> b.user_id AND a.ts BETWEEN b.ts - INTERVAL 24 HOURS AND b.ts""",
    "mdl18": """@st AS (SELECT *, row_number() OVER (ORDER BY boxer_id, start, person_id) AS stint, lag(person_id) OVER o AS prev, lag(start) OVER o AS prev_start FROM stints WHERE start IS NOT NULL WINDOW o AS (PARTITION BY boxer_id ORDER BY start, person_id)),
        days AS (SELECT boxer_id, date, arg_max(post, bout_id) AS rating FROM won GROUP BY ALL),
        und AS (SELECT s.*, d.rating, row_number() OVER (PARTITION BY stint ORDER BY w.date, bout_id) - 1 AS place, count(*) OVER (PARTITION BY stint) AS held FROM won w JOIN st s ON w.boxer_id = s.boxer_id AND w.date >= s.start AND (s."end" IS NULL OR w.date < s."end") JOIN days d ON d.boxer_id = w.boxer_id AND d.date = w.date),
        moves AS (SELECT stint, any_value(boxer_id) AS boxer_id, any_value(start) AS start, arg_max(rating, place) AS after FROM und u WHERE place < 6 AND prev <> person_id
            AND (SELECT count(*) FROM won w WHERE w.boxer_id = u.boxer_id AND w.date < u.start AND w.date >= u.prev_start) >= 2 GROUP BY stint HAVING count(*) >= 3),
        a AS (SELECT count(*) AS n, avg(c) AS m, coalesce(stddev_samp(c), 0) AS sd FROM (SELECT after - coalesce(d.rating, 1500) AS c FROM moves m ASOF LEFT JOIN days d ON d.boxer_id = m.boxer_id AND m.start >= d.date)),
        b AS (SELECT count(*) AS n, avg(c) AS m, coalesce(stddev_samp(c), 0) AS sd FROM (SELECT max(rating) FILTER (place = p + 6) - max(rating) FILTER (place = p) AS c FROM (SELECT *, least(held - 7, greatest(1, held // 2)) AS p FROM und WHERE held >= 8) GROUP BY stint))
        SELECT a.n AS switched, round(a.m, 6) AS switched_mean, round(a.sd, 6) AS switched_sd, b.n AS stayed, round(b.m, 6) AS stayed_mean, round(b.sd, 6) AS stayed_sd, round(a.m - b.m, 6) AS difference, round(sqrt(a.sd * a.sd / a.n + b.sd * b.sd / b.n), 6) AS error
        FROM a, b WHERE a.n >= 10 AND b.n >= 10""",
    "mdl32": f"@{_FACTS_TOLD} SELECT * FROM judged",
    "mdl32_claims": f"@{_FACTS_TOLD} SELECT status, count(*) AS n FROM judged GROUP BY status",
    "src10": f"@{_REIGN_ROWS} SELECT * EXCLUDE champion_id FROM told",
    "src13": """SELECT boxer_id AS page, CASE result WHEN 'W' THEN 'win' WHEN 'L' THEN 'loss' WHEN 'D' THEN 'draw' ELSE 'nc' END AS result, f.name AS opponent, 'Fighter ' || opp_id AS article,
        CASE WHEN result = 'D' THEN 'DRAW' WHEN result IS NULL THEN 'NC' ELSE method END AS method, end_round AS round, rounds AS scheduled, strftime(date, '%Y-%m-%d') AS date
        FROM lb JOIN (SELECT boxer_id AS opp_id, name FROM fighters) f USING (opp_id) WHERE method IS NOT NULL""",
    "lnk05": f"""@{_REIGN_ROWS}, own AS (SELECT any_value(boxer_id) AS boxer_id, 'Fighter ' || (boxer_id - CASE WHEN boxer_id % 50 = 2 THEN 1 ELSE 0 END) AS article FROM fighters GROUP BY 2 HAVING count(*) = 1)
        SELECT boxer_id, count(*) AS reigns, sum(defences)::BIGINT AS defences FROM told JOIN own USING (article) GROUP BY boxer_id""",
    "lnk08": f"SELECT 'broadcaster:broadcaster-' || trim(regexp_replace(replace(lower(read), '+', '-plus'), '[^a-z0-9]+', '-', 'g'), '-') AS external_id, read AS name, sum(n)::BIGINT AS cards FROM ({_read('league_events', 'event_id', _READ_CHANNELS)}) WHERE read IS NOT NULL GROUP BY ALL",
    "fn08": _read("fighters", "boxer_id", _READ_CLASSES),
    "fn11": _read("league_events", "event_id", _READ_CHANNELS),
    "join11": """@after_bouts AS (SELECT boxer_id, date, arg_max(post, bout_id) AS post FROM won GROUP BY ALL)
        SELECT s.boxer_id, s.person_id, s.start AS date, coalesce(post, 1500) AS rating FROM stints s ASOF LEFT JOIN after_bouts a ON s.boxer_id = a.boxer_id AND s.start >= a.date WHERE s.start IS NOT NULL""",
    "join12": """@after_bouts AS (SELECT boxer_id, date, arg_max(post, bout_id) AS post FROM won GROUP BY ALL)
        SELECT b.bout_id, red_id AS boxer_id, coalesce(post, 1500) AS rating FROM bouts b ASOF LEFT JOIN after_bouts a ON b.red_id = a.boxer_id AND b.date > a.date""",
    "fn01": f"SELECT doc_id, md5({_folded('text')}) AS folded FROM documents",
    "fn01_names": f"@{_PROFILES} SELECT key, count(DISTINCT name) AS spellings FROM profiles GROUP BY key",
    "lnk01": f"@{_PROFILES} SELECT key, birth_year, n, keep_id, array_to_string(ids, ',') AS ids FROM copies",
    "lnk01_bouts": f"""@{_PROFILES}, into_ AS (SELECT keep_id, unnest(ids) AS gone FROM copies)
        SELECT bout_id, coalesce(r.keep_id, red_id) AS red_id, coalesce(b.keep_id, blue_id) AS blue_id, coalesce(w.keep_id, winner_id) AS winner_id
        FROM bouts LEFT JOIN into_ r ON r.gone = red_id LEFT JOIN into_ b ON b.gone = blue_id LEFT JOIN into_ w ON w.gone = winner_id""",
    "lnk04": f"""@{_REGISTERS},
        p1 AS (SELECT s.id AS l, c.id AS r, 1 AS pass, abs(s.year - c.year) > 1 IS NOT TRUE AS linked FROM s JOIN c USING (ext)),
        p2 AS (SELECT a.id AS l, b.id AS r, 2 AS pass, true AS linked FROM (SELECT name, year, min(id) AS id FROM s WHERE year IS NOT NULL AND id NOT IN (SELECT l FROM p1) GROUP BY ALL HAVING count(*) = 1) a
            JOIN (SELECT name, year, min(id) AS id FROM c WHERE year IS NOT NULL AND id NOT IN (SELECT r FROM p1) GROUP BY ALL HAVING count(*) = 1) b USING (name, year)),
        p12 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p2),
        p3 AS (SELECT a.id AS l, b.id AS r, 3 AS pass, true AS linked FROM (SELECT * FROM s WHERE id NOT IN (SELECT l FROM p12) QUALIFY count(*) OVER (PARTITION BY name) = 1) a
            JOIN (SELECT * FROM c WHERE id NOT IN (SELECT r FROM p12) QUALIFY count(*) OVER (PARTITION BY name) = 1) b USING (name)
            WHERE a.nation = b.nation AND abs(a.year - b.year) > 1 IS NOT TRUE AND (a.first < b.year + 14) IS NOT TRUE AND (a.last > b.year + 50) IS NOT TRUE AND (a.last > b.died) IS NOT TRUE)
        SELECT l, r, pass FROM p12 WHERE linked UNION ALL SELECT l, r, pass FROM p3""",
}


def _whole(query: str) -> str:
    """The league's expressions and the query; one that begins with @ brings expressions of its own."""
    whole = f"{LEAGUE}, {query[1:]}" if query.startswith("@") else f"{LEAGUE} {query}"
    return whole.replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_", "") if "RECURSIVE_" in query else whole


ORACLE_SQL = {k: _whole(q) for k, q in (_QUERIES | _MORE | _LAST | _CHECKS | _STORIES | _PEOPLE).items()}
