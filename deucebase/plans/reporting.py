"""Score scalars, strength, coverage and quality reports."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions import naming, score
from deucebase.operators import coverage, strength
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches, points


@query(f"SELECT {sql.SIDE} AS side, count(*) AS n, sum((svr = pt_winner)::INT)::BIGINT AS won FROM points GROUP BY 1")
def serve_side_counts(spark, d):
    return points(spark, d).groupBy(score.serve_side(F.col("pts")).alias("side")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("svr") == F.col("pt_winner")).cast("int")).alias("won"))


@query(f"""SELECT {sql.PRESSURE} AS pressure, CASE WHEN set1 > set2 THEN 'set_ahead' WHEN set1 < set2 THEN 'set_behind' WHEN gm1 - gm2 >= 2 THEN 'ahead' WHEN gm1 - gm2 <= -2 THEN 'behind' ELSE 'even' END AS lead,
 count(*) AS n, round(avg((svr = pt_winner)::INT), 6) AS server_win FROM points GROUP BY 1, 2""")
def pressure_and_lead(spark, d):
    p = points(spark, d)
    g = p.groupBy(score.pressure(F.col("pts"), F.col("gm1"), F.col("gm2")).alias("pressure"), score.lead(F.col("gm1"), F.col("gm2"), F.col("set1"), F.col("set2")).alias("lead"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("svr") == F.col("pt_winner")).cast("int")), 6).alias("server_win"))


@query(f"SELECT gender, round(avg((svr = pt_winner)::INT), 9) AS mu FROM points WHERE {sql.VALID} GROUP BY gender")
def league_mu(spark, d):
    return strength.league_mu(points(spark, d)).withColumn("mu", F.round("mu", 9))


@query(
    f""", mu AS (SELECT gender, avg((svr = pt_winner)::INT) AS mu FROM points WHERE {sql.VALID} GROUP BY gender)
 SELECT gender, player, round(coalesce(sum(won) FILTER (serving) / nullif(count(*) FILTER (serving), 0), any_value(mu)), 9) AS serve_rate,
 round(coalesce(sum(won) FILTER (NOT serving) / nullif(count(*) FILTER (NOT serving), 0), 1 - any_value(mu)), 9) AS return_rate FROM pv JOIN mu USING (gender) GROUP BY gender, player""",
    sql.PLAYERS,
)
def current_strength(spark, d):
    s = strength.current_strength(points(spark, d))
    return s.select("gender", "player", F.round("serve_rate", 9).alias("serve_rate"), F.round("return_rate", 9).alias("return_rate"))


_CHARTED = """, n AS (SELECT match_id, count(*) AS n FROM points GROUP BY match_id), s AS (
 SELECT match_id, gender, year, player1 AS player FROM matches UNION ALL SELECT match_id, gender, year, player2 FROM matches)
 SELECT {0}, count(*) AS n_matches, sum(n)::BIGINT AS n_points, min(year)::INT AS first_year, max(year)::INT AS last_year FROM s JOIN n USING (match_id) GROUP BY {0}"""


@query(_CHARTED.format("gender, player"))
def player_coverage(spark, d):
    return coverage.charted(matches(spark, d), points(spark, d))


@query(_CHARTED.format("gender, player, year").replace("year,", "year::INT AS year,", 1).replace("GROUP BY gender, player, year", "GROUP BY gender, player, s.year"))
def player_coverage_by_year(spark, d):
    return coverage.charted(matches(spark, d), points(spark, d), ("gender", "player", "year"))


@query(f"""SELECT count(*) AS n_matches, count(DISTINCT tournament) AS n_events, min(date) AS first_date, max(date) AS last_date, sum((gender = 'M')::INT)::BIGINT AS n_men,
 round_even(100 * avg(({sql.TIER} <> 'Other / Unknown')::INT), 1) AS pct_classified, (SELECT count(*) FROM (SELECT gender, player1 FROM matches UNION SELECT gender, player2 FROM matches)) AS n_players FROM matches""")
def coverage_summary(spark, d):
    return coverage.summary(matches(spark, d))


@query(f"""SELECT year::INT AS year, {sql.BASE} AS event, gender, count(DISTINCT match_id) AS charted, least(100.0, round_even(100.0 * count(DISTINCT match_id) / 127, 1)) AS pct
 FROM matches WHERE {sql.TIER} = 'Grand Slam' AND round IN ('R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F') GROUP BY 1, 2, 3""")
def slam_coverage(spark, d):
    return coverage.slam_coverage(matches(spark, d))


_SIZES = "(VALUES ('R128', 64), ('R64', 32), ('R32', 16), ('R16', 8), ('QF', 4), ('SF', 2), ('F', 1)) r(round, size)"


@query(f""", m AS (SELECT * FROM matches WHERE {sql.TIER} = 'Grand Slam' AND round IN ('R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F')),
 n AS (SELECT year, gender, round, count(DISTINCT match_id) AS n FROM m GROUP BY ALL)
 SELECT g.year::INT AS year, g.gender, r.round, r.size, coalesce(n.n, 0) AS charted, least(100.0, round_even(100.0 * coalesce(n.n, 0) / r.size, 1)) AS pct
 FROM (SELECT DISTINCT year, gender FROM m) g CROSS JOIN {_SIZES} LEFT JOIN n ON n.year = g.year AND n.gender = g.gender AND n.round = r.round""")
def slam_round_coverage(spark, d):
    return coverage.slam_round_coverage(matches(spark, d))


@query(f""", m AS (SELECT *, {sql.BASE} AS event FROM matches WHERE {sql.TIER} = 'Grand Slam' AND round IN ('R128', 'R64', 'R32', 'R16', 'QF', 'SF', 'F')),
 dr AS (SELECT gender, count(DISTINCT (year || '|' || event)) AS draws FROM m GROUP BY gender)
 SELECT m.gender, m.round, count(DISTINCT match_id) AS charted, any_value(draws) AS draws, round_even(100.0 * count(DISTINCT match_id) / (any_value(draws) * any_value(size)), 1) AS pct
 FROM m JOIN dr USING (gender) JOIN {_SIZES} ON r.round = m.round GROUP BY m.gender, m.round""")
def slam_round_completion(spark, d):
    return coverage.round_completion(matches(spark, d), "Grand Slam", coverage.SLAM_ROUNDS, naming.event_base(F.col("tournament")))


@query(f"""SELECT year::INT AS year, {sql.CANON} AS event, gender, count(DISTINCT match_id) AS charted, least(100.0, round_even(100.0 * count(DISTINCT match_id) / 15, 1)) AS pct
 FROM matches WHERE {sql.TIER} = 'Masters / WTA 1000' AND round IN ('R16', 'QF', 'SF', 'F') GROUP BY 1, 2, 3""")
def masters_coverage(spark, d):
    return coverage.masters_coverage(matches(spark, d))


@query(f""", m AS (SELECT *, {sql.CANON} AS event FROM matches WHERE {sql.TIER} = 'Masters / WTA 1000' AND round IN ('R16', 'QF', 'SF', 'F')),
 dr AS (SELECT gender, count(DISTINCT (year || '|' || event)) AS draws FROM m GROUP BY gender)
 SELECT m.gender, m.round, count(DISTINCT match_id) AS charted, any_value(draws) AS draws, round_even(100.0 * count(DISTINCT match_id) / (any_value(draws) * any_value(size)), 1) AS pct
 FROM m JOIN dr USING (gender) JOIN {_SIZES} ON r.round = m.round GROUP BY m.gender, m.round""")
def masters_round_completion(spark, d):
    return coverage.round_completion(matches(spark, d), "Masters / WTA 1000", coverage.LATE_ROUNDS, naming.canon_masters_event(F.col("tournament")))


@query(f"""SELECT {sql.TIER} AS tier, gender, count(*) AS n, count(*) FILTER (year >= 1997 AND round NOT LIKE 'Q_') AS main_since_1997 FROM matches GROUP BY 1, 2""")
def tier_counts(spark, d):
    m = matches(spark, d).withColumn("tier", naming.classify_tier(F.col("tournament"), F.col("gender")))
    late = (F.col("year") >= 1997) & ~F.col("round").like("Q_")
    return m.groupBy("tier", "gender").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("main_since_1997"))


@query(f"""SELECT CASE {sql.BASE} WHEN 'french open' THEN 'roland garros' WHEN 'montreal' THEN 'canada' WHEN 'toronto' THEN 'canada' ELSE {sql.BASE} END AS key, count(DISTINCT tournament) AS spellings, count(*) AS n FROM matches GROUP BY 1""")
def tournament_keys(spark, d):
    return matches(spark, d).groupBy(naming.tourn_key(F.col("tournament")).alias("key")).agg(F.countDistinct("tournament").alias("spellings"), F.count(F.lit(1)).alias("n"))


@query("""SELECT match_id, surface IN ('Hard', 'Clay', 'Grass', 'Carpet') AS surface_valid, CASE WHEN surface IN ('Hard', 'Clay', 'Grass', 'Carpet') THEN surface END AS surface_clean,
 round LIKE 'Q%' AND round <> 'QF' AS is_qualifying, date IS NOT NULL AS date_valid FROM matches""")
def match_flags(spark, d):
    from deucebase.operators.cleaning import flag_matches

    return flag_matches(matches(spark, d)).select("match_id", "surface_valid", "surface_clean", "is_qualifying", "date_valid")


@query("""SELECT 'surface' AS field, surface AS value, count(*) AS n FROM matches GROUP BY surface UNION ALL SELECT 'round', round, count(*) FROM matches GROUP BY round UNION ALL SELECT 'best_of', best_of::STRING, count(*) FROM matches GROUP BY best_of""")
def matches_report(spark, d):
    from deucebase.operators.cleaning import value_counts

    return value_counts(matches(spark, d), ["surface", "round", "best_of"])


@query("""SELECT count(*) AS n_points, count(DISTINCT match_id) AS n_matches, count(*) FILTER (svr NOT IN (1, 2)) AS bad_server, count(*) FILTER (coalesce(first_serve, '') = '') AS no_first_serve,
 count(*) FILTER (second_serve IS NOT NULL) AS second_serves, count(*) FILTER (pts = '') AS no_score FROM points""")
def points_report(spark, d):
    from deucebase.operators.cleaning import points_report as report

    return report(points(spark, d))


@query("""SELECT gender, player, CASE WHEN r >= l THEN 'R' ELSE 'L' END AS hand, (r + l)::BIGINT AS votes FROM (SELECT gender, player, sum((hand = 'R')::INT) AS r, sum((hand = 'L')::INT) AS l FROM
 (SELECT gender, player1 AS player, player1_hand AS hand FROM matches UNION ALL SELECT gender, player2, player2_hand FROM matches) WHERE hand IN ('R', 'L') GROUP BY 1, 2)""")
def modal_hand(spark, d):
    return coverage.modal_hand(matches(spark, d))


@query(
    """, parts AS (SELECT match_id, strftime(date, '%Y%m%d') || '-' || gender || '-' || replace(tournament, ' ', '_') || '-' || round || '-' || replace(player1, ' ', '_') || '-' || replace(player2, ' ', CASE WHEN match_id::BIGINT % 7 = 0 THEN '-' ELSE '_' END) AS id, * EXCLUDE (match_id) FROM matches)
 SELECT id, CASE WHEN match_id::BIGINT % 7 <> 0 THEN strftime(date, '%Y%m%d') END AS date, CASE WHEN match_id::BIGINT % 7 <> 0 THEN tournament END AS tournament, CASE WHEN match_id::BIGINT % 7 <> 0 THEN player2 END AS player2 FROM parts"""
)
def match_id_fields(spark, d):
    hyphen = F.when(F.col("match_id").cast("bigint") % 7 == 0, "-").otherwise("_")
    us = lambda c: F.replace(F.col(c), F.lit(" "), F.lit("_"))
    m = matches(spark, d).select(F.concat_ws("-", F.date_format("date", "yyyyMMdd"), "gender", us("tournament"), "round", us("player1"), F.replace(F.col("player2"), F.lit(" "), hyphen)).alias("id"))
    p = m.withColumn("p", naming.match_id_parts(F.col("id")))
    return p.select("id", "p.date", "p.tournament", "p.player2")


@query("""SELECT gender, year::INT AS year, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gender), 6) AS pct, rank() OVER (PARTITION BY gender ORDER BY count(*) DESC)::INT AS place FROM matches GROUP BY gender, year""")
def matches_by_year_ranked(spark, d):
    n = matches(spark, d).groupBy("gender", "year").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("gender")
    return n.select("gender", "year", "n", F.round(100.0 * F.col("n") / F.sum("n").over(w), 6).alias("pct"), F.rank().over(w.orderBy(F.desc("n"))).alias("place"))




@query(f""", m AS (SELECT * FROM matches WHERE {sql.TIER} = 'Masters / WTA 1000' AND round IN ('R16', 'QF', 'SF', 'F')), n AS (SELECT year, gender, round, count(DISTINCT match_id) AS n FROM m GROUP BY ALL)
 SELECT g.year::INT AS year, g.gender, r.round, r.size, coalesce(n.n, 0) AS charted, least(100.0, round_even(100.0 * coalesce(n.n, 0) / r.size, 1)) AS pct FROM (SELECT DISTINCT year, gender FROM m) g CROSS JOIN (VALUES ('R16', 8), ('QF', 4), ('SF', 2), ('F', 1)) r(round, size) LEFT JOIN n ON n.year = g.year AND n.gender = g.gender AND n.round = r.round""")
def masters_round_coverage(spark, d):
    return coverage.masters_round_coverage(matches(spark, d))
