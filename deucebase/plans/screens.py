"""Screens of contexts, answers and third strokes, with gates loose enough for small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.functions import stats
from deucebase.operators import coded, coverage, screens
from deucebase.operators import sequences as seq
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.plans.sequences import _OBS, _TOK
from deucebase.sources.adapter import matches
from deucebase.sources.store import coded_points, once, parsed

_HALF = f"(({sql.crc32('match_id')}) & 1)::INT"
_SK = f"""{_TOK}, hv AS (SELECT match_id, {_HALF} AS half FROM matches),
 w0 AS (SELECT t.*, hand, row_number() OVER w - 1 AS i, {', '.join(f"lag({c}, {k}) OVER w AS {c[0]}{k}" for c in ('tok', 'mir') for k in (1, 2, 3, 4))} FROM tk t LEFT JOIN hands USING (gender, player) WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)),
 w1 AS (SELECT gender, player, match_id, i, {sql.SIDE} AS side, (coalesce(terminal, '') = '*')::INT AS w, (coalesce(terminal, '') = '@')::INT AS e, (coalesce(next_terminal, '') = '#')::INT AS f,
   {', '.join("concat_ws(' ', " + ', '.join(f"CASE WHEN hand = 'L' THEN m{j} ELSE t{j} END" for j in range(k, 0, -1)) + f") AS c{k}" for k in (2, 3, 4))} FROM w0),
 sk AS (SELECT gender, player, k, context, half, CASE WHEN i <= k + 3 AND side <> 'na' THEN side END AS opening, count(*) AS n, sum(w) AS w, sum(e) AS e, sum(f) AS f FROM
   ({' UNION ALL '.join(f'SELECT gender, player, match_id, i, side, w, e, f, {k} AS k, c{k} AS context FROM w1 WHERE i >= {k}' for k in (2, 3, 4))}) JOIN hv USING (match_id) GROUP BY ALL)"""


def _counts(spark, d):
    """Strike counts of depths 2 to 4, kept once an application: every screen below reads them."""
    return once(spark, "strike_counts", d, lambda: coded.strike_counts(coded_points(spark, d), (2, 3, 4)))


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("SELECT gender, player, k::INT AS k, half, sum(n)::BIGINT AS n, sum(w)::BIGINT AS w, sum(e)::BIGINT AS e, sum(f)::BIGINT AS f, count(DISTINCT context) AS contexts FROM sk GROUP BY 1, 2, 3, 4", _SK)
def fold_totals(spark, d):
    c = _counts(spark, d)
    return c.groupBy("gender", "player", "k", "half").agg(*[F.sum(x).alias(x) for x in ("n", "w", "e", "f")], F.countDistinct("context").alias("contexts"))


def _tag_sql(att: str, win: str, min_n: int, min_fold: int, lift: float, q: float) -> str:
    return f""", fo AS (SELECT gender, player, context, half, sum(n) AS n, sum({att}) AS att, sum({win}) AS win FROM sk WHERE k = 2 GROUP BY 1, 2, 3, 4),
 f1 AS (SELECT *, sum(att) OVER (PARTITION BY gender, player, half) / sum(n) OVER (PARTITION BY gender, player, half) AS base, sum(n) OVER c AS an, sum(att) OVER c AS aa, sum(win) OVER c AS aw,
   sum(att) OVER (PARTITION BY gender, player) / sum(n) OVER (PARTITION BY gender, player) AS ab FROM fo WINDOW c AS (PARTITION BY gender, player, context)),
 f2 AS (SELECT *, coalesce(att / n / nullif(base, 0), 0) AS lift FROM f1 WHERE an >= {min_n}),
 f3 AS (SELECT *, sum(win) FILTER (lift >= {lift} AND att >= {min_fold}) OVER h / nullif(sum(att) FILTER (lift >= {lift} AND att >= {min_fold}) OVER h, 0) AS mc FROM f2 WINDOW h AS (PARTITION BY gender, player, half)),
 fp AS (SELECT *, {sql.binom_tail('att', 'n', 'base')} AS p FROM f3 WHERE att >= {min_fold} AND base > 0),
 fd AS (SELECT gender, player, context, 1 - half AS half FROM {sql.bh('fp', 'p', 'gender, player, half', 'context')} WHERE q <= {q} AND lift >= {lift}),
 fv AS (SELECT *, win / att >= mc AS green FROM f3 JOIN fd USING (gender, player, context, half) WHERE att >= {min_fold} AND lift > 1 AND mc IS NOT NULL),
 fg AS (SELECT gender, player, context, count(*) AS folds, any_value(green) AS green, sum(mc * att) / sum(att) AS ref, any_value(n) AS n, any_value(att) AS att, any_value(win) AS win, any_value(lift) AS lift, any_value(an) AS an, any_value(aa) AS aa, any_value(aw) AS aw, any_value(ab) AS ab
   FROM fv GROUP BY 1, 2, 3 HAVING count(DISTINCT green) = 1),
 fh AS (SELECT gender, player, context, folds, green, ref, CASE WHEN folds = 2 THEN an ELSE n END AS on_, CASE WHEN folds = 2 THEN aa ELSE att END AS oa, CASE WHEN folds = 2 THEN aw ELSE win END AS ow, CASE WHEN folds = 2 THEN aa / an / ab ELSE lift END AS lift FROM fg)
 SELECT gender, player, context, folds, CASE WHEN green THEN 'green' ELSE 'trap' END AS tag, on_::BIGINT AS oos_n, oa::BIGINT AS oos_attempts, round(lift, 6) AS lift, round(oa / on_, 6) AS rate, round(ow / oa, 6) AS conv, round(ow / oa - ref, 6) AS conv_delta FROM fh"""


@query(_tag_sql("w + e + f", "w + f", 6, 1, 1.05, 0.95), _SK)
def tagged_contexts(spark, d):
    t = screens.tagged_contexts(_counts(spark, d).where("k = 2"), "aggressive", 6, 1, 1.05, 0.95)
    return _rounded(t, "lift", "rate", "conv", "conv_delta")


@query(_tag_sql("w + e", "w", 6, 1, 1.05, 0.95), _SK)
def tagged_contexts_finishing(spark, d):
    t = screens.tagged_contexts(_counts(spark, d).where("k = 2"), "finishing", 6, 1, 1.05, 0.95)
    return _rounded(t, "lift", "rate", "conv", "conv_delta")


@query(
    """, t AS (SELECT gender, player, context, sum(n) AS n, sum(w) AS w, sum(e) AS e, sum(w + e + f) AS a FROM sk WHERE k = 2 GROUP BY 1, 2, 3 HAVING sum(n) >= 4), u AS (SELECT *, sum(a) OVER p / sum(n) OVER p AS r FROM t WINDOW p AS (PARTITION BY gender, player))
 SELECT gender, player, count(*) AS contexts, round(covar_pop(w / n, e / n) / nullif(stddev_pop(w / n) * stddev_pop(e / n), 0), 6) AS we_corr, round(sqrt(greatest(sum(pow(a - n * r, 2) - n * r * (1 - r)) / nullif(sum(n * (n - 1)), 0), 0)), 6) AS sigma FROM u GROUP BY 1, 2 HAVING count(*) >= 5""",
    _SK,
)
def context_spread(spark, d):
    return _rounded(screens.context_spread(_counts(spark, d).where("k = 2"), 4, 5), "we_corr", "sigma")


@query(
    """, t AS (SELECT gender, player, context, half, sum(n) AS n, sum(w + e + f) AS a FROM sk WHERE k = 2 GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 2),
 u AS (SELECT gender, player, context, max(a / n) FILTER (half = 0) AS r0, max(a / n) FILTER (half = 1) AS r1 FROM t GROUP BY 1, 2, 3) SELECT gender, count(*) AS pairs, round(covar_pop(r0, r1) / nullif(stddev_pop(r0) * stddev_pop(r1), 0), 6) AS r FROM u WHERE r0 IS NOT NULL AND r1 IS NOT NULL GROUP BY gender""",
    _SK,
)
def split_half_rates(spark, d):
    s = screens.split_half(_counts(spark, d).where("k = 2"), 2)
    return s.groupBy("gender").agg(F.count(F.lit(1)).alias("pairs"), F.round(stats.corr(F.col("r0"), F.col("r1")), 6).alias("r"))


def _gold_sql(att: str, win: str, name: str) -> str:
    return f""", {name}t AS (SELECT gender, player, k, context, sum(n) AS n, sum({att}) AS att, sum({win}) AS win, coalesce(sum(n) FILTER (half = 0), 0) AS n0, coalesce(sum(n) FILTER (half = 1), 0) AS n1, coalesce(sum({att}) FILTER (half = 0), 0) AS a0, coalesce(sum({att}) FILTER (half = 1), 0) AS a1 FROM sk GROUP BY 1, 2, 3, 4),
 {name}j AS (SELECT c.*, p.context AS parent, p.att / p.n AS pr, p.win / p.att AS pc FROM {name}t c JOIN {name}t p ON p.gender = c.gender AND p.player = c.player AND p.k = c.k - 1 AND p.context = substr(c.context, instr(c.context, ' ') + 1) AND p.att > 0 WHERE c.k > 2 AND c.n >= 3 AND c.att >= 1),
 {name}p AS (SELECT *, {sql.binom_tail('att', 'n', 'pr')} AS p FROM {name}j),
 {name}g AS (SELECT *, CASE WHEN att / n < 1.3 * pr THEN 'lift' WHEN p >= 0.4 THEN 'binomial' WHEN NOT coalesce(n0 >= 1 AND a0 / nullif(n0, 0) > pr AND n1 >= 1 AND a1 / nullif(n1, 0) > pr, false) THEN 'replication' WHEN q > 0.99 THEN 'fdr' END AS gate,
   count(*) OVER (PARTITION BY gender, player) AS tested, CASE WHEN win / att >= pc THEN 'green' ELSE 'trap' END AS tag FROM {sql.bh(f'{name}p', 'p', 'gender, player', 'k, context')})"""


_GOLD = {"min_n": 3, "min_att": 1, "p_max": 0.4, "half_n": 1, "q": 0.99}
_WIDE, _NARROW = _gold_sql("w + e + f", "w + f", "wd"), _gold_sql("w + e", "w", "nr")


@query(_WIDE + " SELECT gender, player, k::INT AS k, context, parent, n::BIGINT AS n, att::BIGINT AS att, round(pr, 6) AS parent_rate, round(win / att, 6) AS conv, round(pc, 6) AS parent_conv, round(p, 6) AS p, round(q, 6) AS q, tested, gate, tag FROM wdg", _SK)
def gold_patterns(spark, d):
    g = screens.gold_patterns(_counts(spark, d), "aggressive", **_GOLD)
    return _rounded(g.drop("att_rate"), "parent_rate", "conv", "parent_conv", "p", "q")


@query(_WIDE + _NARROW + """ SELECT coalesce(a.g, 'absent') AS wide, coalesce(b.g, 'absent') AS narrow, count(*) AS n, count(*) FILTER (a.tag <> b.tag) AS flips FROM (SELECT *, coalesce(gate, 'gold') AS g FROM wdg) a
 FULL JOIN (SELECT *, coalesce(gate, 'gold') AS g FROM nrg) b ON a.gender = b.gender AND a.player = b.player AND a.k = b.k AND a.context = b.context WHERE a.g = 'gold' OR b.g = 'gold' GROUP BY 1, 2""", _SK)
def numerator_comparison(spark, d):
    c = _counts(spark, d)
    return screens.numerator_comparison(screens.gold_patterns(c, "aggressive", **_GOLD), screens.gold_patterns(c, "finishing", **_GOLD))


@query(_WIDE + f""", sd AS (SELECT gender, player, k, context, {', '.join(f"coalesce(sum({x}) FILTER (opening = '{s}'), 0)::BIGINT AS {c}_{s}" for c, x in (('n', 'n'), ('att', 'w + e + f'), ('win', 'w + f')) for s in ('deuce', 'ad'))} FROM sk WHERE opening IS NOT NULL GROUP BY 1, 2, 3, 4),
 te AS (SELECT gender, player, k, context, 'att' AS test, att_deuce AS a, n_deuce - att_deuce AS b, att_ad AS c, n_ad - att_ad AS d FROM wdg JOIN sd USING (gender, player, k, context) WHERE n_deuce >= 2 AND n_ad >= 2
   UNION ALL SELECT gender, player, k, context, 'conv', win_deuce, att_deuce - win_deuce, win_ad, att_ad - win_ad FROM wdg JOIN sd USING (gender, player, k, context) WHERE att_deuce >= 1 AND att_ad >= 1),
 pf AS (SELECT *, {sql.fisher('a', 'b', 'c', 'd')} AS p FROM te), pr AS (SELECT *, row_number() OVER (ORDER BY p, gender, player, k, context, test) AS r, count(*) OVER () AS m FROM pf)
 SELECT gender, player, k::INT AS k, context, test, a, b, c, d, round(p, 6) AS p, round(least(1.0, max((m - r + 1) * p) OVER (ORDER BY r)), 6) AS p_holm FROM pr""", _SK)
def side_heterogeneity(spark, d):
    c = _counts(spark, d)
    return _rounded(screens.side_heterogeneity(screens.gold_patterns(c, "aggressive", **_GOLD), c, 2, 1), "p", "p_holm")


_BO = """, bt AS (SELECT gender, player, k, context, half, sum(n) AS n, sum(w + e + f) AS a FROM sk GROUP BY 1, 2, 3, 4, 5), b0 AS (SELECT gender, player, sum(a) / sum(n) AS p FROM bt WHERE half = 0 AND k = 2 GROUP BY 1, 2)"""


def _bo(top: int) -> str:
    p, joins = "b0.p", []
    for k in range(2, top + 1):
        joins.append(f"LEFT JOIN bt x{k} ON x{k}.gender = t.gender AND x{k}.player = t.player AND x{k}.half = 0 AND x{k}.k = {k} AND x{k}.context = array_to_string(list_slice(string_split(t.context, ' '), -{k}, -1), ' ')")
        p = f"((coalesce(x{k}.a, 0) + 20.0 * {p}) / (coalesce(x{k}.n, 0) + 20.0))"
    p = f"least(greatest({p}, 1e-6), 1 - 1e-6)"
    return f"SELECT t.gender, {top} AS k, sum(t.n)::BIGINT AS n, round(sum(-(t.a * ln({p}) + (t.n - t.a) * ln(1 - {p}))) / sum(t.n), 6) AS log_loss FROM bt t JOIN b0 USING (gender, player) {' '.join(joins)} WHERE t.half = 1 AND t.k = {top} GROUP BY 1"


@query(_BO + " " + " UNION ALL ".join(_bo(k) for k in (2, 3, 4)), _SK)
def context_backoff(spark, d):
    return _rounded(screens.backoff_eval(_counts(spark, d)), "log_loss").select("gender", "k", "n", "log_loss")


# --- answers and third strokes

_CELLKEY = "family, kind, zone, state_depth"
_ERA = "CASE WHEN coalesce(year, 0) < 2000 THEN 'pre-2000' WHEN year < 2010 THEN '2000s' ELSE '2010+' END"
_OC = f"""{_OBS}, hv AS (SELECT match_id, {_HALF} AS half FROM matches), o4 AS (SELECT o3.*, half, {_ERA} AS era, {sql.SIDE} AS court FROM o3 JOIN hv USING (match_id)),
 oc AS (SELECT gender, player, family, kind, zone, state_depth, side AS wing, resp_kind, line, era, half, count(*) AS n, sum(won) AS won FROM (SELECT *, 'rally' AS family, '' AS state_depth FROM o4 UNION ALL SELECT *, 'ret', d_depth FROM o4 WHERE idx = 3 AND d_depth IS NOT NULL) GROUP BY ALL)"""


def _standing_sql(name: str, rows: str, state: str) -> str:
    r = "wing, resp_kind, line"
    return f"""{name}0 AS (SELECT gender, player, {state}, {r}, coalesce(sum(n) FILTER (half = 0), 0) AS n0, coalesce(sum(n) FILTER (half = 1), 0) AS n1, sum(n) AS c, sum(won) AS wins FROM {rows} GROUP BY ALL),
 {name} AS (SELECT *, sum(c) OVER ps AS n_state, sum(n0) OVER ps AS n0s, sum(n1) OVER ps AS n1s, sum(wins) OVER ps AS ws, sum(c) OVER fs - sum(c) OVER ps AS bn, sum(c) OVER fr - c AS bf, sum(wins) OVER fs - sum(wins) OVER ps AS bw, sum(wins) OVER fr - wins AS bfw
   FROM {name}0 WINDOW ps AS (PARTITION BY gender, player, {state}), fs AS (PARTITION BY gender, {state}), fr AS (PARTITION BY gender, {state}, {r}))"""


def _surface_sql(rows: str) -> str:
    return f"""SELECT *, (c + 30.0 * pf) / (n_state + 30.0) / pf AS lift, c * log2((c + 30.0 * pf) / (n_state + 30.0) / pf) AS evidence, (wins + 20.0 * fconv) / (c + 20.0) AS conv, (ws + 20.0 * bw / bn) / (n_state + 20.0) AS sconv
   FROM {rows} WHERE (c + 30.0 * pf) / (n_state + 30.0) / pf >= 1.02 AND least(n0, n1) >= 1 AND coalesce(least(n0 / nullif(n0s, 0) / pf, n1 / nullif(n1s, 0) / pf) >= 1.01, false)"""


_LOOSE = {"min_state": 10, "min_cell": 2, "min_field": 50, "min_bf": 2, "lift": 1.02, "half_lift": 1.01, "half_min": 1}


def _obs(spark, d):
    return coded.observations(coded_points(spark, d))


def _era_cells(spark, d):
    return once(spark, "era_cells", d, lambda: screens.era_cells(_obs(spark, d)))


@query(
    f""", {_standing_sql('st', 'oc', _CELLKEY)}, s1x AS (SELECT *, bf / bn AS pf0, bfw / nullif(bf, 0) AS fc0 FROM st WHERE n_state >= 10 AND bn >= 50 AND c >= 2 AND bf >= 2),
 me AS (SELECT gender, player, {_CELLKEY}, era, sum(n) AS ne FROM oc GROUP BY ALL), fe AS (SELECT gender, {_CELLKEY}, era, sum(n) AS fe FROM oc GROUP BY ALL), fr AS (SELECT gender, {_CELLKEY}, wing, resp_kind, line, era, sum(n) AS fr, sum(won) AS fw FROM oc GROUP BY ALL),
 ow AS (SELECT gender, player, {_CELLKEY}, wing, resp_kind, line, era, sum(n) AS ce, sum(won) AS we FROM oc GROUP BY ALL),
 ee AS (SELECT s.gender, s.player, {_CELLKEY}, wing, resp_kind, line, ne, fe, coalesce(fr, 0) - coalesce(ce, 0) AS b, coalesce(fw, 0) - coalesce(we, 0) AS bw2 FROM s1x s JOIN me USING (gender, player, {_CELLKEY}) JOIN fe USING (gender, {_CELLKEY}, era)
   LEFT JOIN fr USING (gender, {_CELLKEY}, wing, resp_kind, line, era) LEFT JOIN ow USING (gender, player, {_CELLKEY}, wing, resp_kind, line, era) WHERE fe - ne >= 20),
 eg AS (SELECT gender, player, {_CELLKEY}, wing, resp_kind, line, sum(ne * b / (fe - ne)) / sum(ne) AS es, sum(ne * bw2 / b) FILTER (b > 0) / nullif(sum(ne) FILTER (b > 0), 0) AS ec, sum(ne) AS cov FROM ee GROUP BY ALL),
 u AS (SELECT s.*, coalesce(es > 0 AND cov >= 0.6 * n_state, false) AS use, es, ec FROM s1x s LEFT JOIN eg USING (gender, player, {_CELLKEY}, wing, resp_kind, line)),
 v AS (SELECT *, CASE WHEN use THEN es ELSE pf0 END AS pf, CASE WHEN use THEN coalesce(ec, fc0) ELSE fc0 END AS fconv FROM u), z AS ({_surface_sql('v')}),
 r AS (SELECT *, row_number() OVER (PARTITION BY gender, player, family ORDER BY evidence DESC, lift DESC, {_CELLKEY}, wing, resp_kind, line) AS place FROM z)
 SELECT gender, player, {_CELLKEY}, wing, resp_kind, line, c::BIGINT AS n, n_state::BIGINT AS n_state, round(pf, 6) AS p_field, round(lift, 6) AS lift, round(conv, 6) AS conv, round(fconv, 6) AS fconv, round(sconv, 6) AS sconv FROM r WHERE place <= CASE WHEN family = 'rally' THEN 3 ELSE 2 END""",
    _OC,
)
def court_profiles(spark, d):
    p = screens.court_profile(_era_cells(spark, d), min_field_era=20, **_LOOSE)
    return _rounded(p.drop("evidence", "place"), "p_field", "lift", "conv", "fconv", "sconv")


@query(f", {_standing_sql('st', 'oc', _CELLKEY)}, x AS (SELECT gender, log2((n0 + 15.0 * bf / bn) / (n0s + 15.0) / (bf / bn)) AS a, log2((n1 + 15.0 * bf / bn) / (n1s + 15.0) / (bf / bn)) AS b FROM st WHERE least(n0s, n1s) >= 5 AND bn >= 50 AND c >= 2 AND bf >= 2) SELECT gender, count(*) AS cells, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) AS r FROM x GROUP BY gender", _OC)
def response_stability(spark, d):
    cells = screens.fold_cells(screens.with_family(_obs(spark, d)), screens.CELL)
    return _rounded(screens.cell_stability(cells, screens.STATE, screens.RESP, 5, 2, 50, 2), "r")


_PS = "court, serve_direction, kind, zone, depth"
_PC = f"""{_OC}, po AS (SELECT gender, player, court, sdir, kind, zone, d_depth AS depth, side AS wing, resp_kind, line, half, won FROM o4 WHERE idx = 3 AND d_depth IS NOT NULL AND court <> 'na'),
 pc AS (SELECT 'full' AS tier, gender, player, court, sdir AS serve_direction, kind, zone, depth, wing, resp_kind, line, half, count(*) AS n, sum(won) AS won FROM po WHERE sdir IN ('4', '5', '6') GROUP BY ALL
  UNION ALL SELECT 'side', gender, player, court, '', kind, zone, depth, wing, resp_kind, line, half, count(*), sum(won) FROM po GROUP BY ALL
  UNION ALL SELECT 'pooled', gender, player, '', '', kind, zone, depth, wing, resp_kind, line, half, count(*), sum(won) FROM po GROUP BY ALL),
 ti AS (SELECT gender, player, CASE coalesce(min(CASE tier WHEN 'full' THEN 1 WHEN 'side' THEN 2 ELSE 3 END) FILTER (states >= 4), 3) WHEN 1 THEN 'full' WHEN 2 THEN 'side' ELSE 'pooled' END AS tier FROM
   (SELECT gender, player, tier, count(*) FILTER (n >= 6) AS states FROM (SELECT gender, player, tier, {_PS}, sum(n) AS n FROM pc GROUP BY ALL) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


def _plus(spark, d):
    return once(spark, "plus_one_cells", d, lambda: screens.plus_one_cells(_obs(spark, d)))


@query("SELECT * FROM ti", _PC)
def plus_one_tiers(spark, d):
    return screens.assigned_tier(_plus(spark, d), 6, 4)


@query(
    f""", {_standing_sql('st', 'pc', 'tier, ' + _PS)}, a AS (SELECT st.*, bf / bn AS pf, bfw / nullif(bf, 0) AS fconv FROM st JOIN ti USING (gender, player, tier) WHERE n_state >= 6 AND bn >= 20 AND c >= 1 AND bf >= 1),
 p0 AS (SELECT *, {sql.binom_tail('c', 'n_state', 'pf')} AS p FROM a), b AS (SELECT * FROM {sql.bh('p0', 'p', 'gender, player', _PS + ', wing, resp_kind, line')}), z AS ({_surface_sql('b')}),
 r AS (SELECT *, row_number() OVER (PARTITION BY gender, player ORDER BY evidence DESC, lift DESC, {_PS}, wing, resp_kind, line) AS place FROM z WHERE q <= 0.99)
 SELECT gender, player, tier, {_PS}, wing, resp_kind, line, c::BIGINT AS n, n_state::BIGINT AS n_state, round(pf, 6) AS p_field, round(lift, 6) AS lift, round(conv, 6) AS conv, round(fconv, 6) AS fconv, round(sconv, 6) AS sconv, round(p, 6) AS p, round(q, 6) AS q FROM r WHERE place <= 2""",
    _PC,
)
def plus_one_profiles(spark, d):
    p = screens.plus_one_profile(_plus(spark, d), **(_LOOSE | {"min_state": 6, "min_field": 20, "min_cell": 1, "min_bf": 1}), q=0.99)
    return _rounded(p.drop("place"), "p_field", "lift", "conv", "fconv", "sconv", "p", "q")


@query(
    """, s AS (SELECT gender, player, kind, zone, depth, court, concat_ws(' ', wing, resp_kind, line) AS resp, sum(n) AS n FROM pc WHERE tier = 'side' GROUP BY ALL),
 m AS (SELECT gender, player, kind, zone, depth, court, sum(n) AS total, arg_max(resp, (n, resp)) AS best FROM s GROUP BY ALL HAVING sum(n) >= 3)
 SELECT a.gender, a.player, a.kind, a.zone, a.depth, a.best AS deuce, b.best AS ad, a.total::BIGINT AS n_deuce, b.total::BIGINT AS n_ad FROM m a JOIN m b ON a.gender = b.gender AND a.player = b.player AND a.kind = b.kind AND a.zone = b.zone AND a.depth = b.depth WHERE a.court = 'deuce' AND b.court = 'ad' AND a.best <> b.best""",
    _PC,
)
def plus_one_flips(spark, d):
    return screens.side_flips(_plus(spark, d), 3)


@query(
    f"""SELECT state, answer, incoming, outgoing, count(*) AS n FROM (SELECT
 concat_ws(' ', CASE d_depth WHEN '7' THEN 'short' WHEN '8' THEN 'mid-depth' WHEN '9' THEN 'deep' END, CASE kind WHEN 'net' THEN 'net ball' WHEN 'other' THEN 'drop/lob' ELSE kind END, CASE WHEN d_depth IS NOT NULL THEN 'return' END, 'into', CASE zone WHEN 'fh' THEN 'the FH corner' WHEN 'bh' THEN 'the BH corner' ELSE 'the middle' END) AS state,
 CASE WHEN line = 'mid' THEN ans || ' through the middle' WHEN zone IN ('fh', 'bh') AND zone <> lower(side) AND resp_kind IN ('drive', 'slice') THEN CASE WHEN line = 'cc' THEN 'inside-out ' ELSE 'inside-in ' END || ans WHEN line = 'cc' THEN 'crosscourt ' || ans ELSE ans || ' down the line' END AS answer,
 d_in AS incoming, CASE line WHEN 'cc' THEN ref WHEN 'dtl' THEN translate(ref, '13', '31') ELSE '2' END AS outgoing FROM (SELECT *, side || ' ' || CASE resp_kind WHEN 'net' THEN 'net shot' WHEN 'other' THEN 'drop/lob' ELSE resp_kind END AS ans FROM o3)) GROUP BY ALL""",
    _OBS,
)
def response_names(spark, d):
    o = _obs(spark, d).join(coverage.modal_hand(matches(spark, d)).select("gender", "player", "hand"), ["gender", "player"])
    c = F.col
    into, out = screens.physical_codes(c("zone"), c("wing"), c("line"), c("hand"))
    o = o.select(screens.state_name(c("kind"), c("zone"), c("depth")).alias("state"), screens.resp_name(c("zone"), c("wing"), c("resp_kind"), c("line")).alias("answer"), into.alias("incoming"), out.alias("outgoing"))
    return o.groupBy("state", "answer", "incoming", "outgoing").agg(F.count(F.lit(1)).alias("n"))
