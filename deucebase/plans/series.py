"""Walk-forward and windowed series."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.operators import cleaning, strength
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import digit, points

_LOG = f"""{sql.PLAYERS}, dl AS (SELECT gender, player, date, sum(won) FILTER (serving) AS sw, count(*) FILTER (serving) AS sn, sum(won) FILTER (NOT serving) AS rw, count(*) FILTER (NOT serving) AS rn FROM pv GROUP BY 1, 2, 3),
 dz AS (SELECT gender, player, date, coalesce(sw, 0) AS sw, sn, coalesce(rw, 0) AS rw, rn FROM dl)"""


@query(
    """, lg AS (SELECT gender, date, coalesce(sum(w) OVER b / nullif(sum(n) OVER b, 0), 0.6) AS mu FROM (SELECT gender, date, sum(sw) AS w, sum(sn) AS n FROM dz GROUP BY 1, 2) WINDOW b AS (PARTITION BY gender ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)),
 p AS (SELECT gender, player, date, coalesce(sum(sw) OVER b, 0) AS a, coalesce(sum(sn) OVER b, 0) AS an, coalesce(sum(rw) OVER b, 0) AS r, coalesce(sum(rn) OVER b, 0) AS rn FROM dz WINDOW b AS (PARTITION BY gender, player ORDER BY date RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
 SELECT gender, player, date, an::BIGINT AS p_serve_n, p.rn::BIGINT AS p_return_n, round((a + 100 * mu) / (an + 100), 6) AS serve_rate, round((r + 100 * (1 - mu)) / (p.rn + 100), 6) AS return_rate FROM p JOIN lg USING (gender, date)""",
    _LOG,
)
def walk_forward(spark, d):
    w = strength.walk_forward(points(spark, d))
    return w.withColumn("serve_rate", F.round("serve_rate", 6)).withColumn("return_rate", F.round("return_rate", 6))


_MATCHLOG = """, ml AS (SELECT match_id, gender, player, date, (date - DATE '1970-01-01')::INT AS day, sum(won) / count(*) - 0.5 AS residual FROM pv GROUP BY 1, 2, 3, 4)"""


def _match_log(spark, d):
    g = strength.player_view(points(spark, d)).groupBy("match_id", "gender", "player", "date").agg((F.sum("won") / F.count(F.lit(1)) - 0.5).alias("residual"))
    return g.withColumn("day", F.unix_date("date"))


@query(
    _MATCHLOG
    + """, a AS (SELECT *, list({'day': day, 'match_id': match_id, 'residual': residual}) OVER (PARTITION BY gender, player ORDER BY day RANGE BETWEEN 540 PRECEDING AND 1 PRECEDING) AS got FROM ml),
 b AS (SELECT match_id, gender, player, list_slice(list_reverse_sort(coalesce(got, [])), 1, 10) AS r FROM a)
 SELECT match_id, gender, player, len(r)::INT AS n_recent, round(CASE WHEN len(r) > 0 THEN list_sum(list_transform(r, lambda x: x.residual)) / len(r) ELSE 0 END, 6) AS form FROM b""",
    sql.PLAYERS,
)
def trailing_form(spark, d):
    f = strength.trailing_form(_match_log(spark, d))
    return f.select("match_id", "gender", "player", "n_recent", F.round("form", 6).alias("form"))


@query(_MATCHLOG + """, g AS (SELECT gender, residual, lag(residual) OVER w AS prev, day - lag(day) OVER w AS gap FROM ml WINDOW w AS (PARTITION BY gender, player ORDER BY day, match_id))
 SELECT gender, count(*) AS pairs, round(corr(prev, residual), 6) AS ac1 FROM g WHERE gap BETWEEN 1 AND 45 GROUP BY gender""", sql.PLAYERS)
def streakiness(spark, d):
    w = Window.partitionBy("gender", "player").orderBy("day", "match_id")
    g = _match_log(spark, d).withColumn("prev", F.lag("residual").over(w)).withColumn("gap", F.col("day") - F.lag("day").over(w))
    return g.where("gap BETWEEN 1 AND 45").groupBy("gender").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.corr("prev", "residual"), 6).alias("ac1"))


_SERVES = f""", sv AS (SELECT match_id, gender, CASE WHEN svr = 1 THEN player1 ELSE player2 END AS player, date, count(*) AS n, sum((d = '4')::INT) AS wide FROM (SELECT *, regexp_extract(coalesce(first_serve, ''), '^[^frvoulhjbszpymiktq4560]*([4560])', 1) AS d FROM points) WHERE d IN ('4', '5', '6') GROUP BY ALL),
 ag AS (SELECT *, row_number() OVER (PARTITION BY gender, player ORDER BY date DESC, match_id DESC) - 1 AS age, sum(n) OVER (PARTITION BY gender, player) AS total, sum(n) OVER (PARTITION BY gender, player ORDER BY date, match_id) AS run FROM sv)"""


def _serves(spark, d):
    from deucebase.functions.notation import serve_dir

    p = points(spark, d).withColumn("d", serve_dir(F.col("first_serve"))).where(F.col("d").isin("4", "5", "6"))
    s = p.groupBy("match_id", "gender", F.when(F.col("svr") == 1, F.col("player1")).otherwise(F.col("player2")).alias("player"), "date").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("d") == "4").alias("wide"))
    w = Window.partitionBy("gender", "player")
    return s.withColumn("age", F.row_number().over(w.orderBy(F.desc("date"), F.desc("match_id"))) - 1).withColumn("total", F.sum("n").over(w)).withColumn("run", F.sum("n").over(w.orderBy("date", "match_id")))


@query(_SERVES + " SELECT gender, player, round(sum(pow(0.5, age / 10.0) * wide) / sum(pow(0.5, age / 10.0) * n), 6) AS recent_wide, round(pow(sum(pow(0.5, age / 10.0) * n), 2) / sum(pow(0.5, age / 10.0) * pow(0.5, age / 10.0) * n), 6) AS n_eff, sum(n)::BIGINT AS n FROM ag GROUP BY 1, 2")
def recent_placement(spark, d):
    """Wide share with weights that halve every 10 matches, and the effective number of serves."""
    w = F.pow(F.lit(0.5), F.col("age") / 10.0)
    return _serves(spark, d).groupBy("gender", "player").agg(F.round(F.sum(w * F.col("wide")) / F.sum(w * F.col("n")), 6).alias("recent_wide"), F.round(F.pow(F.sum(w * F.col("n")), F.lit(2.0)) / F.sum(w * w * F.col("n")), 6).alias("n_eff"), F.sum("n").alias("n"))


@query(_SERVES + " SELECT gender, player, round(sum(wide) FILTER (2 * run <= total) / nullif(sum(n) FILTER (2 * run <= total), 0), 6) AS early, round(sum(wide) FILTER (2 * run > total) / sum(n) FILTER (2 * run > total), 6) AS late FROM ag GROUP BY 1, 2")
def career_halves(spark, d):
    """Wide share before and after half of a player's serves."""
    early = F.col("run") * 2 <= F.col("total")
    share = lambda c: F.round(F.try_divide(F.sum(F.when(c, F.col("wide"))), F.sum(F.when(c, F.col("n")))), 6)
    return _serves(spark, d).groupBy("gender", "player").agg(share(early).alias("early"), share(~early).alias("late"))


@query(_SERVES + """, t AS (SELECT gender, player, match_id, n, wide, sum(n) OVER w AS pn, sum(wide) OVER w AS pw FROM ag WINDOW w AS (PARTITION BY gender, player ORDER BY date, match_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT gender, count(*) AS n_matches, round(sum(-(wide * ln((pw + 1) / (pn + 2)) + (n - wide) * ln(1 - (pw + 1) / (pn + 2)))) / sum(n), 6) AS log_loss FROM t WHERE pn IS NOT NULL GROUP BY gender""")
def window_prediction(spark, d):
    """Loss a serve of the wide share of the five matches before."""
    w = Window.partitionBy("gender", "player").orderBy("date", "match_id").rowsBetween(-5, -1)
    t = _serves(spark, d).withColumn("pn", F.sum("n").over(w)).withColumn("pw", F.sum("wide").over(w)).where("pn IS NOT NULL")
    p = (F.col("pw") + 1) / (F.col("pn") + 2)
    loss = -(F.col("wide") * F.log(p) + (F.col("n") - F.col("wide")) * F.log(1 - p))
    return t.groupBy("gender").agg(F.count(F.lit(1)).alias("n_matches"), F.round(F.sum(loss) / F.sum("n"), 6).alias("log_loss"))


_RAW = f"""SELECT CAST(l_orderkey AS STRING) AS match_id, CAST(l_linenumber AS INT) AS pt, l_partkey, row_number() OVER (ORDER BY l_orderkey, {digit("md5(CAST(l_partkey AS STRING))", 1)} % 2, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord FROM lineitem"""


@query(
    f"""WITH raw AS ({_RAW}), a AS (SELECT *, first(pt) OVER w AS f, lag(pt) OVER w AS lp FROM raw WINDOW w AS (PARTITION BY match_id ORDER BY ord)),
 b AS (SELECT *, sum((pt = f AND coalesce(lp, -1) <> pt)::INT) OVER (PARTITION BY match_id ORDER BY ord) AS blk FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY match_id, blk) AS sz FROM b),
 k AS (SELECT * FROM (SELECT *, max(sz) OVER (PARTITION BY match_id) AS msz FROM c) WHERE sz = msz), k2 AS (SELECT * FROM (SELECT *, min(blk) OVER (PARTITION BY match_id) AS mb FROM k) WHERE blk = mb),
 u AS (SELECT DISTINCT match_id, pt, l_partkey FROM k2), n AS (SELECT *, count(*) OVER (PARTITION BY match_id, pt) AS c FROM u)
 SELECT match_id, pt, l_partkey FROM (SELECT *, max(c) OVER (PARTITION BY match_id) AS mc FROM n) WHERE mc = 1""",
    "",
)
def dedupe_points(spark, d):
    spark.read.parquet(f"{d}/lineitem.parquet").createOrReplaceTempView("lineitem")
    # the order column stands for file order; here it follows from the unique key within a match
    key = _RAW.replace("OVER (ORDER BY l_orderkey,", "OVER (PARTITION BY l_orderkey ORDER BY")
    return cleaning.dedupe_points(spark.sql(key), "ord").drop("ord")
