"""Serve tendencies: placement, cards, dispersion, drift, windows, leverage, sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.functions.notation import LETTERS
from deucebase.operators import coverage, tendencies
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.plans.sequences import _HANDS
from deucebase.sources.adapter import matches, points
from deucebase.sources.store import coded_points, once, parsed, stored_points


def _dir(c: str) -> str:
    return f"regexp_extract(coalesce({c}, ''), '^[^{LETTERS}4560]*([4560])', 1)"


_PRESS = sql.PRESSURE
_DEL = f"""{sql.CTES}, {_HANDS}, v0 AS (SELECT *, {sql.SIDE} AS side, {_PRESS} AS bucket, trim(coalesce(second_serve, '')) <> '' AS second, CASE WHEN svr = 1 THEN player1 ELSE player2 END AS player, CASE WHEN svr = 1 THEN player2 ELSE player1 END AS opponent, (svr = pt_winner)::INT AS won FROM points WHERE {sql.VALID}),
 dl AS (SELECT match_id, gender, player, opponent, date, year, side, bucket, won, 1 AS snum, {_dir('first_serve')} AS target, NOT second AS starts FROM v0 WHERE side <> 'na'
  UNION ALL SELECT match_id, gender, player, opponent, date, year, side, bucket, won, 2, {_dir('second_serve')}, true FROM v0 WHERE side <> 'na' AND second),
 pl AS (SELECT match_id, gender, player, opponent, date, year, side, snum, {', '.join(f"count(*) FILTER (target = '{t}') AS c{t}, count(*) FILTER (target = '{t}' AND starts) AS p{t}, coalesce(sum(won) FILTER (target = '{t}' AND starts), 0) AS w{t}" for t in '456')}, count(*) AS n FROM dl WHERE target IN ('4', '5', '6') GROUP BY 1, 2, 3, 4, 5, 6, 7, 8)"""


def _delivered(spark, d):
    return once(spark, "deliveries", d, lambda: tendencies.serves(stored_points(spark, d)))


def _placed(spark, d):
    return once(spark, "placement", d, lambda: tendencies.placement(tendencies.serves(coded_points(spark, d))))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query(f"SELECT gender, side, snum, {', '.join(f'sum({x}{t})::BIGINT AS {x}{t}' for x in 'cpw' for t in '456')}, count(*) AS rows FROM pl GROUP BY 1, 2, 3", _DEL)
def serve_placement(spark, d):
    return _placed(spark, d).groupBy("gender", "side", "snum").agg(*[F.sum(f"{x}{t}").alias(f"{x}{t}") for x in "cpw" for t in "456"], F.count(F.lit(1)).alias("rows"))


@query("SELECT charted_by, count(*) AS serves, count(*) FILTER (target IN ('4', '5', '6')) AS coded, count(*) FILTER (target = '0') AS unknown FROM dl JOIN (SELECT match_id, charted_by FROM matches) USING (match_id) WHERE snum = 1 GROUP BY 1", _DEL)
def chart_coverage(spark, d):
    return tendencies.chart_coverage(_delivered(spark, d).join(matches(spark, d).select("match_id", "charted_by"), "match_id"), ["charted_by"])


@query(
    """, c AS (SELECT gender, player, charted_by, sum(c4) AS c, sum(n) AS n FROM pl JOIN (SELECT match_id, charted_by FROM matches) USING (match_id) WHERE snum = 1 GROUP BY 1, 2, 3),
 r AS (SELECT *, sum(n) OVER w - n AS rn, sum(c) OVER w - c AS rc FROM c WINDOW w AS (PARTITION BY gender, player)), g AS (SELECT gender, charted_by, sum(n * (c / n - rc / rn)) / sum(n) AS dev FROM r WHERE n >= 5 AND rn >= 20 GROUP BY 1, 2 HAVING sum(n) >= 50)
 SELECT gender, count(*) AS charters, round(stddev_pop(dev), 6) AS sd, round(min(dev), 6) AS low, round(max(dev), 6) AS high FROM g GROUP BY 1""",
    _DEL,
)
def charter_fingerprints(spark, d):
    return _rounded(tendencies.charter_effect(_placed(spark, d), matches(spark, d).select("match_id", "charted_by"), "4", 5, 20, 50), "sd", "low", "high")


_S = {
    "wide": ("c4 + c5 + c6 >= {f}", "c4 / (c4 + c5 + c6)", None), "t": ("c4 + c5 + c6 >= {f}", "c6 / (c4 + c5 + c6)", None),
    "in_gap": ("least(c4, c6) >= {f}", "p6 / c6 - p4 / c4", "(p4 / c4) * (1 - p4 / c4) / c4 + (p6 / c6) * (1 - p6 / c6) / c6"),
    "pay_gap": ("least(p4, p6) >= {f}", "w6 / p6 - w4 / p4", "(w4 / p4) * (1 - w4 / p4) / p4 + (w6 / p6) * (1 - w6 / p6) / p6"),
}


def _card_rows(table: str, keys: str, floor: int) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{k}' AS stat, {v} AS v, {s or f'({v}) * (1 - {v}) / (c4 + c5 + c6)'} AS s, c4 + c5 + c6 AS n FROM {table} WHERE {w.format(f=floor)}" for k, (w, v, s) in _S.items())


_SUMS = ", ".join(f"sum({x}{t}) AS {x}{t}" for x in "cpw" for t in "456")


@query(
    f""", dx AS (SELECT pl.*, ({sql.crc32('match_id')}) & 1 AS half FROM pl WHERE side = 'deuce' AND snum = 1), fu AS (SELECT gender, player, {_SUMS} FROM dx GROUP BY 1, 2), ha AS (SELECT gender, player, half, {_SUMS} FROM dx GROUP BY 1, 2, 3),
 fr AS ({_card_rows('fu', 'gender, player', 30)}), hr AS ({_card_rows('ha', 'gender, player, half', 10)}),
 vc AS (SELECT gender, stat, count(*) AS players, avg(v) AS mean, greatest(var_samp(v) - avg(s), 0) AS tau2, avg(s * n) AS v1, median(n) AS median_n FROM fr GROUP BY 1, 2),
 pr AS (SELECT gender, player, stat, max(v) FILTER (half = 0) AS v0, max(v) FILTER (half = 1) AS v1, max(n) FILTER (half = 0) AS n0, max(n) FILTER (half = 1) AS n1 FROM hr GROUP BY 1, 2, 3 HAVING max(v) FILTER (half = 0) IS NOT NULL AND max(v) FILTER (half = 1) IS NOT NULL),
 rr AS (SELECT gender, stat, count(*) AS pairs, covar_pop(v0, v1) / nullif(stddev_pop(v0) * stddev_pop(v1), 0) AS r FROM pr GROUP BY 1, 2), nh AS (SELECT gender, stat, median(n) AS n_half FROM (SELECT gender, stat, unnest([n0, n1]) AS n FROM pr) GROUP BY 1, 2),
 j AS (SELECT *, CASE WHEN tau2 > 0 AND r > 0 AND n_half > 0 THEN greatest((tau2 / r - tau2) * n_half / v1, 1) END AS phi FROM vc JOIN rr USING (gender, stat) JOIN nh USING (gender, stat) WHERE players >= 3 AND pairs >= 3)
 SELECT gender, stat, players, pairs, round(mean, 6) AS mean, round(tau2, 6) AS tau2, round(v1, 6) AS v1, round(r, 6) AS r, round(CASE WHEN r > -1 THEN 2 * r / (1 + r) END, 6) AS reliability, round(phi, 6) AS phi, round(CASE WHEN tau2 > 0 THEN 0.8 * v1 / (0.2 * tau2) END, 3) AS n80_binomial FROM j""",
    _DEL,
)
def card_stats(spark, d):
    c = tendencies.card_stats(_placed(spark, d), "match_id", 30, 10)
    return _rounded(c, "mean", "tau2", "v1", "r", "reliability", "phi").withColumn("n80_binomial", F.round(F.col("n80_binomial"), 3) + 0.0).drop("median_n", "n_half", "n80")


def _chi(p: str) -> str:
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN pow(c4 - n * {p}, 2) / (n * {p} * (1 - {p})) ELSE 0 END"


@query(
    f""", e AS (SELECT pl.*, h.hand AS opp FROM pl LEFT JOIN hands h ON h.gender = pl.gender AND h.player = pl.opponent WHERE snum = 1), e2 AS (SELECT *, sum(n) OVER v AS hn, sum(c4) OVER v / sum(n) OVER v AS hr FROM e WINDOW v AS (PARTITION BY gender, player, side, opp)),
 e3 AS (SELECT *, max((opp = 'R' AND hn >= 5)::INT) OVER w + max((opp = 'L' AND hn >= 5)::INT) OVER w = 2 AS bth FROM e2 WINDOW w AS (PARTITION BY gender, player, side)),
 m AS (SELECT *, sum(c4) OVER w / sum(n) OVER w AS p, sum(c4) OVER y / sum(n) OVER y AS yr FROM e3 WHERE n >= 3 WINDOW w AS (PARTITION BY gender, player, side), y AS (PARTITION BY gender, player, side, year)),
 g AS (SELECT gender, player, side, count(*) AS matches, sum(n) AS n, any_value(p) AS p, sum({_chi('p')}) AS chi, count(*) FILTER (coalesce(bth AND opp IN ('R', 'L'), false)) AS hm, sum({_chi('hr')}) FILTER (coalesce(bth AND opp IN ('R', 'L'), false)) AS hchi, count(DISTINCT year) AS ys, sum({_chi('yr')}) AS ychi FROM m GROUP BY 1, 2, 3)
 SELECT gender, player, side, matches, n::BIGINT AS n, round(p, 6) AS p, round(chi / (matches - 1), 6) AS phi, round(CASE WHEN hm >= 4 THEN hchi / (hm - 2) END, 6) AS phi_hand, round(CASE WHEN ys > 1 AND ys < matches - 1 THEN ychi / (matches - ys) END, 6) AS phi_year FROM g WHERE matches >= 4 AND p > 0 AND p < 1""",
    _DEL,
)
def placement_dispersion(spark, d):
    t = tendencies.dispersion(_placed(spark, d), coverage.modal_hand(matches(spark, d)), "4", 3, 4, 5)
    return _rounded(t.drop("pval"), "p", "phi", "phi_hand", "phi_year")


@query()
def dispersion_rejections(spark, d):
    """How many of the dispersion tests survive the false-discovery cut, by gender; tests hold the tail and the cut."""
    return tendencies.bh_reject(tendencies.dispersion(_placed(spark, d), coverage.modal_hand(matches(spark, d)), "4", 3, 4, 5), "pval", ["gender"])


@query(
    """, s AS (SELECT gender, player, side, count(*) FILTER (bucket = 'break_pt') AS nb, count(*) FILTER (bucket = 'break_pt' AND target = '6') AS kb, count(*) FILTER (bucket = 'normal') AS nn, count(*) FILTER (bucket = 'normal' AND target = '6') AS kn FROM dl WHERE snum = 1 AND target IN ('4', '5', '6') GROUP BY 1, 2, 3),
 g AS (SELECT gender, player, sum(nb) AS n, sum(kb) AS o, sum(nb * (kn / nn)) AS e, sum(nb * (kn / nn) * (1 - kn / nn)) AS v FROM s WHERE nb > 0 AND nn >= 10 GROUP BY 1, 2)
 SELECT gender, player, n::BIGINT AS n, round(o / n, 6) AS observed, round(e / n, 6) AS expected, round((o - e) / sqrt(v), 6) AS z FROM g WHERE n >= 5 AND v > 0""",
    _DEL,
)
def placement_leverage(spark, d):
    return _rounded(tendencies.leverage(_delivered(spark, d), "break_pt", "6", 5, 10).drop("pval"), "observed", "expected", "z")


@query("SELECT gender, side, bucket, count(*) AS n, " + ", ".join(f"round(avg((target = '{t}')::INT), 6) AS share{t}" for t in "456") + " FROM dl WHERE snum = 1 AND target IN ('4', '5', '6') AND bucket IN ('normal', 'break_pt', 'game_pt', 'deuce', 'tiebreak') GROUP BY 1, 2, 3 HAVING count(*) >= 50", _DEL)
def tour_leverage(spark, d):
    return _rounded(tendencies.tour_leverage(_delivered(spark, d), 50), "share4", "share5", "share6")


_CELLS = [f"{s}{t}" for s in ("deuce", "ad") for t in "456"]
_CAR = f""", ca0 AS (SELECT gender, player, match_id, date, year, {', '.join(f"coalesce(sum(c{t}) FILTER (side = '{s}'), 0) AS {s}{t}" for s in ('deuce', 'ad') for t in '456')}, sum(n) AS n FROM pl WHERE snum = 1 GROUP BY 1, 2, 3, 4, 5),
 ca AS (SELECT *, row_number() OVER w - 1 AS age, coalesce(sum(n) OVER (PARTITION BY gender, player ORDER BY date DESC, year DESC, match_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM ca0 WINDOW w AS (PARTITION BY gender, player ORDER BY date DESC, year DESC, match_id DESC))"""


def _est(s: str, t: str) -> str:
    return f"(({s}{t} + 25.0 * t_{s}{t}) / ({s}4 + {s}5 + {s}6 + 25.0))"


def _tot(s: str) -> str:
    return f"(h_{s}4 + h_{s}5 + h_{s}6)"


_LOSS = " + ".join(f"h_{s}{t} * ln(greatest({_est(s, t)}, 1e-9))" for s in ("deuce", "ad") for t in "456")
_SQ = " + ".join(f"coalesce({_tot(s)} * pow({_est(s, '6')} - h_{s}6 / nullif({_tot(s)}, 0), 2), 0)" for s in ("deuce", "ad"))
_NOISE = " + ".join(f"CASE WHEN {_tot(s)} > 1 THEN {_tot(s)} * (h_{s}6 / {_tot(s)}) * (1 - h_{s}6 / {_tot(s)}) / ({_tot(s)} - 1) ELSE 0 END" for s in ("deuce", "ad"))
_NN = " + ".join(f"CASE WHEN {_tot(s)} > 1 THEN {_tot(s)} ELSE 0 END" for s in ("deuce", "ad"))


@query(
    _CAR
    + f""", tm AS (SELECT gender, {', '.join(f'sum({s}{t}) / sum({s}4 + {s}5 + {s}6) AS t_{s}{t}' for s in ('deuce', 'ad') for t in '456')} FROM ca GROUP BY 1),
 hx AS (SELECT *, later < 40 AS held, sum(n) FILTER (later >= 40) OVER w AS hist, sum(n) FILTER (later < 40) OVER w AS hn, count(*) FILTER (later < 40) OVER w AS hm FROM ca WINDOW w AS (PARTITION BY gender, player)), hy AS (SELECT * FROM hx WHERE hist >= 60 AND hn >= 40),
 h AS (SELECT gender, player, {', '.join(f'sum({c}) AS h_{c}' for c in _CELLS)}, sum(n) AS h_n FROM hy WHERE held GROUP BY 1, 2),
 ru AS (SELECT * FROM (VALUES ('window', 5), ('window', 20), ('window', NULL), ('decay', 10)) r(kind, param)), wx AS (SELECT hy.*, kind, param, CASE WHEN param IS NULL THEN 1.0 WHEN kind = 'window' THEN (age - hm < param)::INT ELSE pow(0.5, (age - hm) / param) END AS wt FROM hy, ru WHERE NOT held),
 p AS (SELECT gender, player, kind, param, {', '.join(f'sum(wt * {c}) AS {c}' for c in _CELLS)} FROM wx GROUP BY 1, 2, 3, 4),
 z AS (SELECT gender, kind, param, -({_LOSS}) / h_n AS loss, ({_SQ}) / h_n AS sq, coalesce(({_NOISE}) / nullif({_NN}, 0), 0) AS fl FROM p JOIN h USING (gender, player) JOIN tm USING (gender))
 SELECT gender, kind, param, count(*) AS players, round(avg(loss), 6) AS loss, round(sqrt(avg(sq)), 6) AS rmse, round(sqrt(greatest(avg(sq) - avg(fl), 0)), 6) AS est FROM z GROUP BY 1, 2, 3""",
    _DEL,
)
def window_scan(spark, d):
    return _rounded(tendencies.window_scan(_placed(spark, d), 40, 60, (5, 20, None), (10,)), "loss", "rmse", "est")


@query(
    _CAR
    + """, w AS (SELECT *, pow(0.5, age / 20.0) AS wt FROM ca), s AS (SELECT gender, player, 'deuce' AS side, wt, year, deuce4 AS c4, deuce5 AS c5, deuce6 AS c6 FROM w UNION ALL SELECT gender, player, 'ad', wt, year, ad4, ad5, ad6 FROM w)
 SELECT gender, player, side, """
    + ", ".join(f"round(sum(wt * c{t}) / nullif(sum(wt * (c4 + c5 + c6)), 0), 6) AS share{t}" for t in "456")
    + ", round(pow(sum(wt * (c4 + c5 + c6)), 2) / nullif(sum(wt * wt * (c4 + c5 + c6)), 0), 6) AS n_eff, count(*) FILTER (wt >= 0.1) AS matches, min(year) FILTER (wt >= 0.1)::INT AS y0, max(year) FILTER (wt >= 0.1)::INT AS y1 FROM s GROUP BY 1, 2, 3",
    _DEL,
)
def recent_profiles(spark, d):
    return _rounded(tendencies.recent_profile(_placed(spark, d)), "share4", "share5", "share6", "n_eff")


@query()
def placement_drift(spark, d):
    """Tests hold the gap against a plain version; the null is drawn."""
    return tendencies.drift(_placed(spark, d), 3, 100, 2)


_FS = f"regexp_extract(coalesce(first_serve, ''), '^[^{LETTERS}456]*([456])', 1)"
_SV = f"""{sql.SHOTS}, s3 AS (SELECT match_id, pt, any_value(side) FILTER (rn = 3) AS side3, max((rn = 3)::INT) AS third, any_value((coalesce(terminal, '') = '*')::INT) FILTER (rn = 3) AS w3, any_value((coalesce(terminal, '') = '@')::INT) FILTER (rn = 3) AS e3, any_value((coalesce(next_terminal, '') = '#')::INT) FILTER (rn = 3) AS f3
   FROM (SELECT *, row_number() OVER (PARTITION BY match_id, pt ORDER BY idx) AS rn FROM shots) GROUP BY 1, 2),
 v AS (SELECT gender, CASE WHEN svr = 1 THEN player1 ELSE player2 END AS player, {sql.SIDE} AS side, server_won::INT AS won, serve_in_play = 1 AS first, outcome, {_FS} AS tg, coalesce(third, 0) AS third, side3, coalesce(w3, 0) AS w3, coalesce(e3, 0) AS e3, coalesce(f3, 0) AS f3 FROM decoded LEFT JOIN s3 USING (match_id, pt) WHERE parse_ok AND {sql.VALID} AND {sql.SIDE} <> 'na')"""


@query(
    """ SELECT gender, coalesce(player, '_tour_') AS player, side, count(*) AS n, count(*) FILTER (first) AS s1_n, count(*) FILTER (NOT first) AS s2_n, round(count(*) FILTER (first) / count(*), 6) AS first_in, round(count(*) FILTER (outcome = 'ace') / count(*), 6) AS ace, round(count(*) FILTER (outcome = 'double_fault') / count(*), 6) AS df,
 round(avg(won) FILTER (first), 6) AS s1_won, round(avg(won) FILTER (NOT first), 6) AS s2_won, round(count(*) FILTER (tg = '4') / nullif(count(*) FILTER (tg <> ''), 0), 6) AS wide, round(count(*) FILTER (tg = '5') / nullif(count(*) FILTER (tg <> ''), 0), 6) AS body, round(count(*) FILTER (tg = '6') / nullif(count(*) FILTER (tg <> ''), 0), 6) AS t,
 sum(third)::BIGINT AS third, round(count(*) FILTER (third = 1 AND side3 = 'FH') / nullif(sum(third), 0), 6) AS third_fh, round(sum(third * (w3 + e3 + f3)) / nullif(sum(third), 0), 6) AS third_att, round(sum(third * (w3 + f3)) / nullif(sum(third * (w3 + e3 + f3)), 0), 6) AS third_conv
 FROM v GROUP BY GROUPING SETS ((gender, side), (gender, player, side))""",
    _SV,
)
def side_summary(spark, d):
    s = tendencies.side_summary(parsed(spark, d))
    return _rounded(s, "first_in", "ace", "df", "s1_won", "s2_won", "wide", "body", "t", "third_fh", "third_att", "third_conv")
