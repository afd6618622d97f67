"""Join kinds, set operations, windows, pivots, sampling and tests as the reports use them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions import stats
from deucebase.operators import coverage, strength
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches, points

_SIDES = ", s AS (SELECT match_id, gender, year, tournament, surface, player1 AS player FROM matches UNION ALL SELECT match_id, gender, year, tournament, surface, player2 FROM matches)"


def _sides(spark, d):
    return coverage.sides(matches(spark, d), ("match_id", "gender", "year", "tournament", "surface"))


@query(_SIDES + " SELECT player, count(*) AS n, count(DISTINCT tournament) AS events FROM s GROUP BY player HAVING count(*) >= 5")
def player_unpivot(spark, d):
    return _sides(spark, d).groupBy("player").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tournament").alias("events")).where("n >= 5")


@query(_SIDES + ", a AS (SELECT player, count(*) AS hard FROM s WHERE surface = 'Hard' AND year < 1997 GROUP BY 1), b AS (SELECT player, count(*) AS clay FROM s WHERE surface = 'Clay' AND year > 1999 GROUP BY 1) SELECT coalesce(a.player, b.player) AS player, hard, clay FROM a FULL JOIN b ON a.player = b.player")
def full_outer(spark, d):
    s = _sides(spark, d)
    a = s.where("surface = 'Hard' AND year < 1997").groupBy("player").agg(F.count(F.lit(1)).alias("hard"))
    b = s.where("surface = 'Clay' AND year > 1999").groupBy("player").agg(F.count(F.lit(1)).alias("clay"))
    return a.join(b, "player", "full")


@query("SELECT match_id, tournament FROM matches m WHERE EXISTS (SELECT 1 FROM points p WHERE p.match_id = m.match_id AND p.pts = '6-6') AND match_id NOT IN (SELECT match_id FROM points WHERE second_serve IS NULL AND first_serve = '')")
def semi_and_anti(spark, d):
    p = points(spark, d).select("match_id", "pts", "first_serve", "second_serve")
    m = matches(spark, d).select("match_id", "tournament")
    return m.join(p.where("pts = '6-6'"), "match_id", "left_semi").join(p.where("second_serve IS NULL AND first_serve = ''"), "match_id", "left_anti")


@query(_SIDES + """, e AS (SELECT player, CASE WHEN min(year) + 2 < max(year) THEN min(year) + 2 ELSE max(year) END AS cut, min(year) AS y0, max(year) AS y1 FROM s GROUP BY player),
 er AS (SELECT player, 1 AS era, y0, cut AS y1 FROM e UNION ALL SELECT player, 2, cut + 1, y1 FROM e WHERE cut < y1) SELECT s.player, era, count(*) AS n FROM s JOIN er ON s.player = er.player AND s.year BETWEEN er.y0 AND er.y1 GROUP BY 1, 2""")
def era_range_join(spark, d):
    s = _sides(spark, d).select("player", "year")
    e = s.groupBy("player").agg(F.min("year").alias("y0"), F.max("year").alias("y1")).withColumn("cut", F.least(F.col("y0") + 2, F.col("y1")))
    eras = e.select(F.col("player").alias("who"), F.inline(F.array(F.struct(F.lit(1).alias("era"), F.col("y0").alias("a"), F.col("cut").alias("b")), F.struct(F.lit(2).alias("era"), (F.col("cut") + 1).alias("a"), F.col("y1").alias("b"))))).where("a <= b")
    return s.join(eras, (F.col("player") == F.col("who")) & F.col("year").between(F.col("a"), F.col("b"))).groupBy("player", "era").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.match_id AS first_id, b.match_id AS second_id, a.gender FROM matches a JOIN matches b ON a.gender = b.gender AND least(a.player1, a.player2) = least(b.player1, b.player2) AND greatest(a.player1, a.player2) = greatest(b.player1, b.player2) AND a.match_id::BIGINT < b.match_id::BIGINT AND a.surface = b.surface")
def same_pair_rematches(spark, d):
    """Join on the unordered pair of players."""
    m = matches(spark, d).select("match_id", "gender", "surface", F.array_sort(F.array("player1", "player2")).alias("pair"))
    a, b = m.withColumnRenamed("match_id", "first_id"), m.withColumnRenamed("match_id", "second_id")
    return a.join(b, ["gender", "surface", "pair"]).where(F.col("first_id").cast("bigint") < F.col("second_id").cast("bigint")).select("first_id", "second_id", "gender")


@query(", c AS (SELECT DISTINCT tournament FROM matches) SELECT c.tournament AS event, v.city FROM c JOIN (VALUES ('Rome'), ('Miami'), ('Open'), ('Paris')) v(city) ON contains(c.tournament, v.city)")
def containment_join(spark, d):
    cities = spark.createDataFrame([("Rome",), ("Miami",), ("Open",), ("Paris",)], "city string")
    events = matches(spark, d).select(F.col("tournament").alias("event")).distinct()
    return events.join(F.broadcast(cities), F.col("event").contains(F.col("city")))  # four cities


@query(_SIDES + " SELECT player FROM s WHERE surface = 'Grass' INTERSECT SELECT player FROM s WHERE surface = 'Carpet' EXCEPT SELECT player FROM s WHERE tournament = 'Basel' AND year = 1996")
def set_operations(spark, d):
    s = _sides(spark, d)
    p = lambda c: s.where(c).select("player")
    return p("surface = 'Grass'").intersect(p("surface = 'Carpet'")).exceptAll(p("tournament = 'Basel' AND year = 1996").distinct())


@query(_SIDES + ", t AS (SELECT gender, player, count(*) AS n FROM s GROUP BY 1, 2) SELECT gender, player, n, rank::INT AS rank, round(mean, 6) AS mean FROM (SELECT *, rank() OVER (PARTITION BY gender ORDER BY n DESC) AS rank, row_number() OVER (PARTITION BY gender ORDER BY n DESC, player) AS rn, avg(n) OVER (PARTITION BY gender) AS mean FROM t) WHERE rn <= 3")
def top_players(spark, d):
    t = _sides(spark, d).groupBy("gender", "player").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("gender")
    t = t.select("*", F.rank().over(w.orderBy(F.desc("n"))).alias("rank"), F.row_number().over(w.orderBy(F.desc("n"), "player")).alias("rn"), F.round(F.avg("n").over(w), 6).alias("mean"))
    return t.where("rn <= 3").drop("rn")


@query("SELECT gender, round(quantile_cont(r, 0.25), 6) AS q25, round(quantile_cont(r, 0.75), 6) AS q75, count(*) AS n FROM (SELECT gender, player, sum(won) / count(*) AS r FROM pv WHERE serving GROUP BY 1, 2) GROUP BY gender", sql.PLAYERS)
def rate_bands(spark, d):
    r = strength.player_view(points(spark, d)).where("serving").groupBy("gender", "player").agg((F.sum("won") / F.count(F.lit(1))).alias("r"))
    return r.groupBy("gender").agg(F.round(F.expr("percentile_cont(0.25) WITHIN GROUP (ORDER BY r)"), 6).alias("q25"), F.round(F.expr("percentile_cont(0.75) WITHIN GROUP (ORDER BY r)"), 6).alias("q75"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT {sql.SIDE} AS side, round(avg((svr = pt_winner)::INT) FILTER (gender = 'M'), 6) AS \"M\", round(avg((svr = pt_winner)::INT) FILTER (gender = 'W'), 6) AS \"W\" FROM points GROUP BY 1")
def side_pivot(spark, d):
    from deucebase.functions.score import serve_side

    p = points(spark, d).withColumn("side", serve_side(F.col("pts")))
    return p.groupBy("side").pivot("gender", ["M", "W"]).agg(F.round(F.avg((F.col("svr") == F.col("pt_winner")).cast("int")), 6))


@query(_SIDES + """, f AS (SELECT player, last(year ORDER BY year, match_id::BIGINT) AS last_year, last(surface ORDER BY year, match_id::BIGINT) AS last_surface, sum(year * 1.0) / count(*) AS mean_year FROM s GROUP BY player) SELECT player, last_year::INT AS last_year, last_surface, round(mean_year, 6) AS mean_year FROM f""")
def latest_per_player(spark, d):
    k = F.struct("year", F.col("match_id").cast("bigint"))
    return _sides(spark, d).groupBy("player").agg(F.max("year").alias("last_year"), F.max_by("surface", k).alias("last_surface"), F.round(F.avg("year"), 6).alias("mean_year"))


@query("SELECT match_id FROM matches ORDER BY md5(match_id || ':7'), match_id LIMIT 20")
def seeded_sample(spark, d):
    """A fixed number of matches by a seeded hash: the sample is the feature, taken before any filter."""
    return matches(spark, d).select("match_id").orderBy(F.md5(F.concat("match_id", F.lit(":7"))), "match_id").limit(20)


_PV = """, t AS (SELECT gender, player, surface, count(*) AS n, sum(won) AS w, (1.0 + (ascii(md5(player || surface)) * 7919) % 97) / 98.0 AS p FROM pv WHERE serving GROUP BY 1, 2, 3)"""


def _pvalues(spark, d):
    t = strength.player_view(points(spark, d)).where("serving").groupBy("gender", "player", "surface").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    return t.withColumn("p", (1.0 + (F.ascii(F.md5(F.concat("player", "surface"))) * 7919) % 97) / 98.0)


@query(_PV + """, r AS (SELECT *, row_number() OVER (PARTITION BY player ORDER BY p, surface) AS r, count(*) OVER (PARTITION BY player) AS m FROM t)
 SELECT player, surface, round(least(1.0, min(p * m / r) OVER (PARTITION BY player ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 6) AS bh, round(least(1.0, max((m - r + 1) * p) OVER (PARTITION BY player ORDER BY r ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM r""", sql.PLAYERS)
def multiple_testing(spark, d):
    t = stats.holm(stats.bh(_pvalues(spark, d), "p", ["player"], ["surface"], "bh"), "p", ["player"], ["surface"], "holm")
    return t.select("player", "surface", F.round("bh", 6).alias("bh"), F.round("holm", 6).alias("holm"))


_BS = f""", mu AS (SELECT gender, avg((svr = pt_winner)::INT) AS mu FROM points WHERE {sql.VALID} GROUP BY gender), bs AS (SELECT gender, player, count(*) AS n, sum(won) AS w, any_value(mu) AS mu FROM pv JOIN mu USING (gender) WHERE serving GROUP BY 1, 2), bp AS (SELECT *, {sql.binom_tail('w', 'n', 'mu')} AS p FROM bs)"""


@query(_BS + f" SELECT gender, player, n, w::BIGINT AS w, round(p, 6) AS p, round(q, 6) AS q FROM {sql.bh('bp', 'p', 'gender', 'player')}", sql.PLAYERS)
def binomial_screen(spark, d):
    """Players who win more serve points than the tour would: exact tail, adjusted within gender."""
    s = strength.player_view(points(spark, d)).where("serving").groupBy("gender", "player").agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("w"))
    j = s.join(F.broadcast(strength.league_mu(points(spark, d))), "gender").withColumn("p", stats.binom_tail("w", "n", "mu"))  # two rows
    return stats.bh(j, "p", ["gender"], ["player"]).select("gender", "player", "n", "w", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


_SD = f""", sd AS (SELECT gender, player, {', '.join(f"count(*) FILTER ({sql.SIDE} = '{side}' AND won = {w}) AS {c}" for c, side, w in (('a', 'deuce', 1), ('b', 'deuce', 0), ('c', 'ad', 1), ('d', 'ad', 0)))} FROM pv WHERE serving GROUP BY 1, 2),
 sp AS (SELECT *, {sql.fisher('a', 'b', 'c', 'd')} AS p FROM sd), sr AS (SELECT *, row_number() OVER (ORDER BY p, gender, player) AS r, count(*) OVER () AS m FROM sp)"""


@query(_SD + " SELECT gender, player, a, b, c, d, round(p, 6) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS q FROM sr", sql.PLAYERS)
def side_differences(spark, d):
    """Deuce against ad court per player by Fisher's exact test, Holm over all."""
    from deucebase.functions.score import serve_side

    v = strength.player_view(points(spark, d)).where("serving").withColumn("side", serve_side(F.col("pts")))
    n = lambda side, won: F.count_if((F.col("side") == side) & (F.col("won") == won))
    t = v.groupBy("gender", "player").agg(n("deuce", 1).alias("a"), n("deuce", 0).alias("b"), n("ad", 1).alias("c"), n("ad", 0).alias("d"))
    t = t.withColumn("p", stats.fisher_two_sided("a", "b", "c", "d")).withColumn("family", F.lit(1))  # one family: a row per player
    t = stats.holm(t, "p", ["family"], ["gender", "player"])
    return t.select("gender", "player", "a", "b", "c", "d", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))


@query(", t AS (SELECT match_id, charted_by, gender, count(*) AS n, count(*) FILTER (svr = pt_winner) AS w FROM points JOIN (SELECT match_id, charted_by FROM matches) USING (match_id) GROUP BY 1, 2, 3), c AS (SELECT charted_by, sum(n) AS n, sum(w) AS w FROM t GROUP BY 1) SELECT charted_by, n::BIGINT AS n, round(w / n - (sum(w) OVER () - w) / (sum(n) OVER () - n), 6) AS deviation FROM c")
def charter_effect(spark, d):
    """A charter's serve-win share less that of all others: sums over everything less the own ones."""
    p = points(spark, d).join(matches(spark, d).select("match_id", "charted_by"), "match_id")
    c = p.groupBy("charted_by").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("svr") == F.col("pt_winner")).alias("w"))
    tot = c.agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    return c.join(F.broadcast(tot)).select("charted_by", "n", F.round(F.col("w") / F.col("n") - (F.col("tw") - F.col("w")) / (F.col("tn") - F.col("n")), 6).alias("deviation"))  # one row


@query(", t AS (SELECT gender, player, count(*) AS n, sum(won) / count(*) AS r FROM pv WHERE serving GROUP BY 1, 2) SELECT gender, count(*) AS players, round(greatest(var_samp(r) - avg(r * (1 - r) / n), 0), 6) AS tau2, round(median(n), 6) AS median_n FROM t GROUP BY gender", sql.PLAYERS)
def variance_components(spark, d):
    """Variance between players beyond what sampling explains."""
    t = strength.player_view(points(spark, d)).where("serving").groupBy("gender", "player").agg(F.count(F.lit(1)).alias("n"), (F.sum("won") / F.count(F.lit(1))).alias("r"))
    tau2 = F.greatest(F.var_samp("r") - F.avg(F.col("r") * (1 - F.col("r")) / F.col("n")), F.lit(0.0))
    return t.groupBy("gender").agg(F.count(F.lit(1)).alias("players"), F.round(tau2, 6).alias("tau2"), F.round(F.median("n"), 6).alias("median_n"))


@query(f""", t AS (SELECT gender, player, {sql.PRESSURE} AS pr, count(*) AS n, sum(won) AS w FROM pv WHERE serving GROUP BY 1, 2, 3)
 SELECT b.gender, sum(b.n)::BIGINT AS n, round((sum(b.w) - sum(b.n * (m.w / m.n))) / sqrt(sum(b.n * (m.w / m.n) * (1 - m.w / m.n))), 6) AS z FROM t b JOIN t m ON b.gender = m.gender AND b.player = m.player AND m.pr = 'normal' WHERE b.pr = 'break_pt' GROUP BY b.gender""", sql.PLAYERS)
def break_point_leverage(spark, d):
    """Serve points won on break points against each player's own rate on normal points."""
    from deucebase.functions.score import pressure

    v = strength.player_view(points(spark, d)).where("serving").withColumn("pr", pressure(F.col("pts"), F.col("gm1"), F.col("gm2")))
    t = v.where("pr IN ('normal', 'break_pt')").groupBy("gender", "player").agg(*[F.sum(F.when(F.col("pr") == k, x)).alias(f"{c}_{k}") for k in ("normal", "break_pt") for c, x in (("n", F.lit(1)), ("w", F.col("won")))])
    r = F.col("w_normal") / F.col("n_normal")
    g = t.where("n_normal > 0 AND n_break_pt > 0").groupBy("gender")
    return g.agg(F.sum("n_break_pt").alias("n"), F.round((F.sum("w_break_pt") - F.sum(F.col("n_break_pt") * r)) / F.sqrt(F.sum(F.col("n_break_pt") * r * (1 - r))), 6).alias("z"))


@query("SELECT match_id, pt FROM (SELECT match_id, pt, svr FROM points ORDER BY md5(match_id || ':' || pt || ':1'), match_id, pt LIMIT 5000) WHERE svr = 1")
def sampled_points(spark, d):
    """A sample of a fixed size by a seeded hash, taken before the filter, as the corpus reads it."""
    from deucebase.sources.store import parsed_points

    return parsed_points(spark, d, "svr = 1", 5000).select("match_id", "pt")
