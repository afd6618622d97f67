"""Win probability of points: backoff tables, values, win probability added, held-out losses; games in closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.functions import score
from deucebase.operators import screens, strength, winprob
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import points
from deucebase.sources.store import once, parsed

_POS = f"""{sql.SHOTS}, pos AS (
 SELECT match_id, pt, gender, player, idx, server_won::INT AS y, terminal, hitter = server AS by_server, idx = rally_len AS is_last, serve_in_play AS sip, least(idx, 12) AS ply, CASE WHEN 3 - hitter = server THEN 'S' ELSE 'R' END AS to_hit,
 CASE WHEN is_serve THEN 'SV' WHEN side = '' THEN 'XX' ELSE side END AS wing, {sql.KIND_OF.format(serve='is_serve')} AS kind, coalesce(direction, '?') AS direction,
 regexp_matches(tail, '[+\\-]')::INT AS approach, coalesce(depth, '-') AS depth FROM shots WHERE parse_ok)"""
_F = ", ".join(winprob.FEATURES)


def _value_ctes(rows: str = "pos") -> str:
    est, cols = "base", []
    for k in range(2, 9):
        p = ", ".join(winprob.FEATURES[:k])
        cols.append(f"sum(n) OVER (PARTITION BY {p}) AS n{k}, sum(w) OVER (PARTITION BY {p}) AS w{k}")
        est = f"((w{k} + 50.0 * {est}) / (n{k} + 50.0))"
    return f""", b AS (SELECT sip, (sum(y) + 50.0 * (SELECT sum(y) / count(*) FROM {rows} WHERE is_last)) / (count(*) + 50.0) AS base FROM {rows} WHERE is_last GROUP BY sip),
 st AS (SELECT {_F}, count(*) AS n, sum(y) AS w FROM {rows} WHERE NOT is_last GROUP BY ALL),
 val AS (SELECT {_F}, base, {est} AS value FROM (SELECT st.*, base, {', '.join(cols)} FROM st JOIN b USING (sip)))"""


_WPA = f"""{_POS}{_value_ctes()}, wp AS (
 SELECT *, v_after - coalesce(lag(v_after) OVER (PARTITION BY match_id, pt ORDER BY idx), base) AS delta FROM
 (SELECT pos.*, b.base, CASE WHEN is_last THEN y::DOUBLE ELSE value END AS v_after FROM pos JOIN b USING (sip) LEFT JOIN val USING ({_F}))),
 wpa AS (SELECT *, CASE WHEN by_server THEN delta ELSE -delta END AS wpa FROM wp)"""


def _pos(spark, d):
    """States of all strokes, kept once an application."""
    return once(spark, "positions", d, lambda: winprob.positions(parsed(spark, d)))


@query(f"SELECT level, count(*) AS states, sum(n)::BIGINT AS n, sum(w)::BIGINT AS w FROM (" + " UNION ALL ".join(f"SELECT {k} AS level, {', '.join(winprob.FEATURES[:k])}" + "".join(f", NULL AS {f}" for f in winprob.FEATURES[k:]) + f", count(*) AS n, sum(y) AS w FROM pos WHERE NOT is_last GROUP BY ALL" for k in range(2, 9)) + ") GROUP BY level", _POS)
def backoff_levels(spark, d):
    t = winprob.backoff_table(_pos(spark, d))
    return t.groupBy("level").agg(F.count(F.lit(1)).alias("states"), F.sum("n").alias("n"), F.sum("w").alias("w"))


@query(f"SELECT {_F.replace('ply', 'ply::INT AS ply')}, round(value, 6) AS value FROM val", _POS + _value_ctes())
def state_values(spark, d):
    return winprob.state_values(_pos(spark, d)).select(*winprob.FEATURES, F.round("value", 6).alias("value"))


@query("SELECT CASE WHEN wpa <= -0.25 THEN '??' WHEN wpa <= -0.12 THEN '?' WHEN wpa <= -0.06 THEN '?!' WHEN wpa >= 0.20 THEN '!' ELSE '' END AS mark, by_server, count(*) AS n, round(avg(wpa), 6) AS mean_wpa FROM wpa GROUP BY 1, 2", _WPA)
def wpa_marks(spark, d):
    w = winprob.shot_wpa(_pos(spark, d))
    return w.groupBy(winprob.annotate(F.col("wpa")).alias("mark"), "by_server").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("wpa"), 6).alias("mean_wpa"))


@query(
    """SELECT gender, player, count(*) AS n_shots, round(sum(greatest(wpa, 0.0)) / count(*), 6) AS gained, round(sum(greatest(-wpa, 0.0)) / count(*), 6) AS conceded, round(count(*) FILTER (terminal = '*') / count(*), 6) AS winner_rate,
 round(count(*) FILTER (terminal = '@') / count(*), 6) AS unforced_rate, round(100 * exp(-6 * sum(greatest(-wpa, 0.0)) / count(*)), 6) AS accuracy FROM wpa GROUP BY gender, player HAVING count(*) >= 200""",
    _WPA,
)
def player_quality(spark, d):
    q = winprob.player_quality(winprob.shot_wpa(_pos(spark, d)))
    return q.select("gender", "player", "n_shots", *[F.round(c, 6).alias(c) for c in ("gained", "conceded", "winner_rate", "unforced_rate", "accuracy")])


@query("SELECT match_id, pt, round(sum(delta) - any_value(y) + min(base), 6) + 0.0 AS gap FROM wpa GROUP BY match_id, pt HAVING abs(sum(delta) - any_value(y) + min(base)) > 1e-9", _WPA)
def wpa_telescopes(spark, d):
    """Points whose deltas do not add up to their result less the base: none."""
    w = winprob.shot_wpa(_pos(spark, d)).groupBy("match_id", "pt").agg((F.sum("server_delta") - F.first(F.col("server_won").cast("double")) + F.min("base")).alias("gap"))
    return w.where(F.abs("gap") > 1e-9).withColumn("gap", F.round("gap", 6) + 0.0)


@query(
    f"""SELECT {', '.join(winprob.FEATURES[:6]).replace('ply', 'ply::INT AS ply')}, next_wing, next_dir, count(*) AS n, round(avg(y), 6) AS server_win FROM
 (SELECT *, lead(wing) OVER w AS next_wing, lead(direction) OVER w AS next_dir FROM pos WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)) WHERE NOT is_last GROUP BY ALL""",
    _POS,
)
def next_strokes(spark, d):
    e = winprob.explore(_pos(spark, d))
    return e.withColumn("server_win", F.round("server_win", 6))


def _split_sql() -> str:
    est, join = "base", []
    for k in range(2, 9):
        f = winprob.FEATURES[:k]
        join.append(f"LEFT JOIN (SELECT {', '.join(f)}, count(*) AS n{k}, sum(y) AS w{k} FROM tr WHERE NOT is_last GROUP BY ALL) t{k} USING ({', '.join(f)})")
        est = f"(CASE WHEN n{k} IS NULL THEN {est} ELSE (w{k} + 50.0 * {est}) / (n{k} + 50.0) END)"
    test = f"({sql.crc32('match_id')}) % 1000 < 200"
    return f""", tr AS (SELECT * FROM pos WHERE NOT ({test})), b AS (SELECT sip, (sum(y) + 50.0 * (SELECT sum(y) / count(*) FROM tr WHERE is_last)) / (count(*) + 50.0) AS base FROM tr WHERE is_last GROUP BY sip),
 sc AS (SELECT te.*, {est} AS p FROM (SELECT * FROM pos WHERE NOT is_last AND {test}) te JOIN b USING (sip) {' '.join(join)})"""


def _scored(spark, d, features=winprob.FEATURES):  # position by position; losses alone come from the state table
    pos = _pos(spark, d).withColumn("test", screens.in_test(F.col("match_id")))
    return winprob.held_out_values(pos.where("NOT test"), pos.where("test"), features)


@query("SELECT gender, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM sc GROUP BY gender", _POS + _split_sql())
def held_out_losses(spark, d):
    s = winprob.losses(_scored(spark, d), "p", "server_won", ("gender",))
    return s.select("gender", "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))


@query("SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM sc GROUP BY 1", _POS + _split_sql())
def held_out_calibration(spark, d):
    c = winprob.calibration(_scored(spark, d), "p", "server_won")
    return c.select("bin", "n", F.round("mean_p", 6).alias("mean_p"), F.round("rate", 6).alias("rate"))


def _states(spark, d):
    """Counts of all states with the score's tags, by fold: kept once an application."""
    def build():
        pos = winprob.tagged(_pos(spark, d), points(spark, d))
        return winprob.state_table(pos, screens.in_test(F.col("match_id")), ["gender", *winprob.TAGS])

    return once(spark, "state_table", d, build)


VARIANTS = {
    "whole": winprob.FEATURES, "no depth": winprob.FEATURES[:-1], "no direction": [x for x in winprob.FEATURES if x != "direction"], "serve and ply": winprob.FEATURES[:2], "to kind": winprob.FEATURES[:5],
    "court coarse": winprob.coarse(["court"]), "court fine": winprob.fine(["court"]), "pressure coarse": winprob.coarse(["pressure"]), "pressure and court": winprob.coarse(["pressure", "court"]), "lead fine": winprob.fine(["lead"]),
}
_TAGGED = f"""{_POS}, tg AS (SELECT match_id, pt, {sql.SIDE} AS court, {sql.PRESSURE} AS pressure, CASE WHEN svr = 1 THEN gm1 ELSE gm2 END AS sg, CASE WHEN svr = 1 THEN gm2 ELSE gm1 END AS rg, CASE WHEN svr = 1 THEN set1 ELSE set2 END AS ss, CASE WHEN svr = 1 THEN set2 ELSE set1 END AS rs FROM points),
 pt2 AS (SELECT pos.*, court, pressure, CASE WHEN ss > rs THEN 'set_ahead' WHEN ss < rs THEN 'set_behind' WHEN sg - rg >= 2 THEN 'ahead' WHEN sg - rg <= -2 THEN 'behind' ELSE 'even' END AS lead FROM pos JOIN tg USING (match_id, pt)),
 hm AS (SELECT match_id, ({sql.crc32('match_id')}) % 1000 < 200 AS test FROM matches), pf AS (SELECT * FROM pt2 JOIN hm USING (match_id)), tr AS (SELECT * FROM pf WHERE NOT test), b AS (SELECT sip, (sum(y) + 50.0 * (SELECT sum(y) / count(*) FROM tr WHERE is_last)) / (count(*) + 50.0) AS base FROM tr WHERE is_last GROUP BY sip)"""


def _variant_sql(name: str, features: list[str]) -> str:
    est, join = "base", []
    for k in range(2, len(features) + 1):
        f = ", ".join(features[:k])
        join.append(f"LEFT JOIN (SELECT {f}, count(*) AS n{k}, sum(y) AS w{k} FROM tr WHERE NOT is_last GROUP BY ALL) t{k} USING ({f})")
        est = f"(CASE WHEN n{k} IS NULL THEN {est} ELSE (w{k} + 50.0 * {est}) / (n{k} + 50.0) END)"
    return f"SELECT '{name}' AS variant, count(*) AS n, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss, round(avg((p - y) * (p - y)), 6) AS brier FROM (SELECT te.y, {est} AS p FROM (SELECT * FROM pf WHERE NOT is_last AND test) te JOIN b USING (sip) {' '.join(join)})"


@query(" UNION ALL ".join(_variant_sql(k, f) for k, f in VARIANTS.items()), _TAGGED)
def feature_ablation(spark, d):
    """Held-out losses of models on ten feature lists, with and without the score: all from one table of states."""
    out = None
    for name, f in VARIANTS.items():
        one = winprob.state_losses(_states(spark, d), f).select(F.lit(name).alias("variant"), "n", F.round("log_loss", 6).alias("log_loss"), F.round("brier", 6).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT match_id, pt, count(*) AS strokes, round(min(wpa), 6) AS worst FROM wpa GROUP BY 1, 2 HAVING min(wpa) <= -0.25 ORDER BY count(*) DESC, min(wpa), match_id, pt LIMIT 5", _WPA)
def demo_points(spark, d):
    return winprob.demo_points(winprob.shot_wpa(_pos(spark, d))).withColumn("worst", F.round("worst", 6))


@query(
    """, mu AS (SELECT gender, avg((svr = pt_winner)::INT) AS mu FROM points GROUP BY gender), s AS (SELECT gender, player, sum(won) FILTER (serving) / count(*) FILTER (serving) AS g FROM pv GROUP BY gender, player)
 SELECT gender, player, round(pow(g, 4) * (1 + 4 * (1 - g) + 10 * (1 - g) * (1 - g)) + 20 * pow(g * (1 - g), 3) * g * g / (g * g + (1 - g) * (1 - g)), 6) AS hold FROM s""",
    sql.PLAYERS,
)
def hold_probability(spark, d):
    s = strength.current_strength(points(spark, d))
    return s.select("gender", "player", F.round(score.game_wp(F.col("serve_rate")), 6).alias("hold"))
