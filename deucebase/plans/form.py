"""Walk-forward predictions of matches: strength, form, surface; streakiness; intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.operators import form, strength
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches, points
from deucebase.sources.store import once

_PREV = "RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
_LOG = f"""{sql.CTES}, mu AS (SELECT gender, avg((svr = pt_winner)::INT) AS mu FROM points WHERE {sql.VALID} GROUP BY gender),
 ml AS (SELECT m.match_id, m.gender, player1, player2, date, (date - DATE '1970-01-01')::INT AS day, surface, best_of, s1n, s1w, s2n, s2w, winner FROM matches m JOIN (SELECT match_id, count(*) FILTER (svr = 1) AS s1n, count(*) FILTER (svr = 1 AND pt_winner = 1) AS s1w, count(*) FILTER (svr = 2) AS s2n, count(*) FILTER (svr = 2 AND pt_winner = 2) AS s2w, arg_max(pt_winner, pt) AS winner FROM points WHERE {sql.VALID} GROUP BY 1) p ON p.match_id = m.match_id WHERE least(s1n, s2n) >= 20),
 sx AS (SELECT match_id, gender, player1 AS player, 1 AS slot, date, day, surface, s1n AS sn, s1w AS sw, s2n AS rn, s2n - s2w AS rw FROM ml UNION ALL SELECT match_id, gender, player2, 2, date, day, surface, s2n, s2w, s1n, s1n - s1w FROM ml),
 sc AS (SELECT *, {', '.join(f'coalesce(sum({c}) OVER w, 0) AS c{c}, coalesce(sum({c}) OVER f, 0) AS f{c}' for c in ('sn', 'sw', 'rn', 'rw'))}, count(*) OVER w AS played FROM sx WINDOW w AS (PARTITION BY gender, player ORDER BY date {_PREV}), f AS (PARTITION BY gender, player, surface ORDER BY date {_PREV})),
 rb AS (SELECT sc.*, mu, (csw + 100 * mu) / (csn + 100) AS s, (crw + 100 * (1 - mu)) / (crn + 100) AS r FROM sc JOIN mu USING (gender)), rc AS (SELECT *, (fsw + 400 * s) / (fsn + 400) AS so, (frw + 400 * r) / (frn + 400) AS ro FROM rb),
 ex AS (SELECT ml.*, greatest(.30, least(.92, a.s - b.r + 1 - a.mu)) AS p1, greatest(.30, least(.92, b.s - a.r + 1 - a.mu)) AS p2, greatest(.30, least(.92, a.so - b.ro + 1 - a.mu)) AS q1, greatest(.30, least(.92, b.so - a.ro + 1 - a.mu)) AS q2, least(a.played, b.played) AS prior, least(a.fsn, b.fsn) AS depth FROM ml JOIN rc a ON a.match_id = ml.match_id AND a.slot = 1 JOIN rc b ON b.match_id = ml.match_id AND b.slot = 2),
 ey AS (SELECT *, (s1w + s2n - s2w) / (s1n + s2n) - (p1 * s1n + (1 - p2) * s2n) / (s1n + s2n) AS residual FROM ex),
 rs AS (SELECT match_id, gender, day, player1 AS player, 1 AS slot, residual FROM ey UNION ALL SELECT match_id, gender, day, player2, 2, -residual FROM ey),
 fl AS (SELECT *, list_slice(list_reverse_sort(coalesce(list({{'day': day, 'match_id': match_id, 'residual': residual}}) OVER (PARTITION BY gender, player ORDER BY day RANGE BETWEEN 540 PRECEDING AND 1 PRECEDING), [])), 1, 10) AS l FROM rs),
 fm AS (SELECT match_id, slot, CASE WHEN len(l) > 0 THEN list_sum(list_transform(l, lambda x: x.residual)) / (len(l) + 5.0) ELSE 0 END AS form FROM fl)"""


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


def _log(spark, d):
    return once(spark, "match_log", d, lambda: form.match_log(points(spark, d), matches(spark, d)))


def _rated(spark, d):
    def build():
        log = _log(spark, d)
        return form.expected(log, form.rates_before(log, strength.league_mu(points(spark, d))))

    return once(spark, "rated_matches", d, build)


def _formed(spark, d):
    return once(spark, "formed_matches", d, lambda: form.with_form(_rated(spark, d)))


@query("SELECT match_id, gender, player1, player2, date, surface, best_of::INT AS best_of, s1n, s1w, s2n, s2w, winner::INT AS winner FROM ml", _LOG)
def match_log(spark, d):
    return _log(spark, d).drop("day")


@query("SELECT match_id, round(p1, 6) AS p1, round(p2, 6) AS p2, round(q1, 6) AS q1, round(q2, 6) AS q2, round(residual, 6) AS residual, prior, depth::BIGINT AS depth FROM ey", _LOG)
def rated_matches(spark, d):
    return _rounded(_rated(spark, d).select("match_id", "p1", "p2", "q1", "q2", "residual", "prior", "depth"), "p1", "p2", "q1", "q2", "residual")


@query("SELECT ey.match_id, round(a.form, 6) AS f1, round(b.form, 6) AS f2 FROM ey JOIN fm a ON a.match_id = ey.match_id AND a.slot = 1 JOIN fm b ON b.match_id = ey.match_id AND b.slot = 2", _LOG)
def match_form(spark, d):
    return _rounded(_formed(spark, d).select("match_id", "f1", "f2"), "f1", "f2")


@query("SELECT match_id, player, surface, played, fsn::BIGINT AS deep, round(s, 6) AS serve, round(r, 6) AS ret, round(so, 6) AS serve_on, round(ro, 6) AS ret_on FROM rc", _LOG)
def walk_forward_by_surface(spark, d):
    """Rates before each match, surface on top of career on top of the league."""
    b = form.rates_before(_log(spark, d), strength.league_mu(points(spark, d)))
    return _rounded(b.select("match_id", "player", "surface", "played", "deep", "serve", "ret", "serve_on", "ret_on"), "serve", "ret", "serve_on", "ret_on")


_GP = """, gp AS (SELECT *, lag(residual) OVER w AS x, day - lag(day) OVER w AS gap FROM rs WINDOW w AS (PARTITION BY gender, player ORDER BY day, match_id)), gq AS (SELECT gender, player, x, residual AS y FROM gp WHERE gap <= 45 AND day < 10000)"""


@query(_GP + " SELECT gender, player, count(*) AS n, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0), 6) AS r, round(covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) * count(*) / (count(*) + 30), 6) AS rho FROM gq GROUP BY 1, 2 HAVING count(*) >= 3 AND stddev_pop(x) * stddev_pop(y) <> 0", _LOG)
def streaky_players(spark, d):
    return _rounded(form.streakiness(form.gap_pairs(form.residuals(_rated(spark, d)), 10_000), 3), "r", "rho")


@query()
def streak_null(spark, d):
    """Autocorrelation of shuffles by player; tests hold it against the plain formula."""
    return form.perm_null(form.gap_pairs(form.residuals(_rated(spark, d)), 10_000), 3)


@query("SELECT gender, count(*) AS n, round(regr_slope(residual, a.form - b.form), 6) AS slope, round(regr_intercept(residual, a.form - b.form), 6) AS intercept, round(sqrt(greatest(regr_syy(residual, a.form - b.form) - regr_slope(residual, a.form - b.form) * regr_sxy(residual, a.form - b.form), 0) / (count(*) - 2) / regr_sxx(residual, a.form - b.form)), 6) AS se FROM ey JOIN fm a ON a.match_id = ey.match_id AND a.slot = 1 JOIN fm b ON b.match_id = ey.match_id AND b.slot = 2 GROUP BY gender", _LOG)
def form_slope(spark, d):
    return _rounded(form.slope(_formed(spark, d).withColumn("df", F.col("f1") - F.col("f2")), "residual", "df", ["gender"]), "slope", "intercept", "se")


@query(
    """, fd AS (SELECT a.form - b.form AS x, residual AS y FROM ey JOIN fm a ON a.match_id = ey.match_id AND a.slot = 1 JOIN fm b ON b.match_id = ey.match_id AND b.slot = 2), q AS (SELECT quantile_cont(x, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM fd),
 b AS (SELECT unnest(range(10)) AS bin, q FROM q) SELECT bin::INT AS bin, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM fd JOIN b ON x BETWEEN q[bin + 1] AND q[bin + 2] GROUP BY bin HAVING count(*) > 30""",
    _LOG,
)
def form_bins(spark, d):
    return _rounded(form.quantile_bins(_formed(spark, d).withColumn("df", F.col("f1") - F.col("f2")), "df", "residual"), "x", "y")


@query(
    """, t AS (SELECT gender, player, sum(sw) FILTER (surface = 'Hard') / sum(sn) FILTER (surface = 'Hard') AS h, sum(sw) FILTER (surface = 'Clay') / sum(sn) FILTER (surface = 'Clay') AS c FROM sx WHERE surface IN ('Hard', 'Clay') GROUP BY 1, 2 HAVING sum(sn) FILTER (surface = 'Hard') >= 60 AND sum(sn) FILTER (surface = 'Clay') >= 60),
 r AS (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY h - c, player) AS up, row_number() OVER (PARTITION BY gender ORDER BY h - c DESC, player DESC) AS dn FROM t) SELECT gender, player, round(h, 6) AS \"Hard_rate\", round(c, 6) AS \"Clay_rate\", round(h - c, 6) AS tilt FROM r WHERE up <= 3 OR dn <= 3""",
    _LOG,
)
def surface_tilt(spark, d):
    return _rounded(form.surface_tilt(_log(spark, d), 60), "Hard_rate", "Clay_rate", "tilt")


def _arms(spark, d):
    """Chances of every arm: career rates, form at a grid of weights, form by streakiness, surface rates."""

    def build():
        rho = form.streakiness(form.gap_pairs(form.residuals(_rated(spark, d)), 10_000), 3)
        f = form.streaky_form(_formed(spark, d), rho).where("prior >= 3")
        a = lambda w, x="f": (F.col("p1") + w * (F.col(f"{x}1") - F.col(f"{x}2")), F.col("p2") - w * (F.col(f"{x}1") - F.col(f"{x}2")))
        return form.chances(f, {"base": a(0.0), "form_25": a(0.25), "form_50": a(0.5), "form_100": a(1.0), "streaky": a(0.5, "g"), "on_surface": (F.col("q1"), F.col("q2"))})

    return once(spark, "match_arms", d, build)


ARMS = ["base", "form_25", "form_50", "form_100", "streaky", "on_surface"]


@query()
def arm_losses(spark, d):
    """Mean loss of every arm and the best, by era: the earlier half tunes, the later half tests. Loss of the tree's chances;
    tests hold the tree."""
    s = _arms(spark, d).withColumn("era", F.when(F.col("date") < "1996-01-01", "train").otherwise("test"))
    return form.best_of_grid(s, ARMS, ["era"])


@query()
def arm_intervals(spark, d):
    """Mean loss of the arms less that of the base, with 95 % intervals by resampling, by gender."""
    s = _arms(spark, d)
    y = F.col("y")
    one = F.array(*[F.struct(F.lit(a).alias("arm"), (form.log_loss(F.col(a), y) - form.log_loss(F.col("base"), y)).alias("delta")) for a in ARMS[1:]])
    return form.paired_bootstrap(s.select("gender", F.inline(one)), "delta", ["gender", "arm"], n=400)


@query()
def arm_strata(spark, d):
    """Gain of the surface arm over the base by surface and by how much history the surface has (strata overlap)."""
    s = _arms(spark, d)
    y = F.col("y")
    strata = F.filter(F.array(F.col("surface"), *[F.when(F.col("depth") >= n, F.lit(f"depth {n}+")) for n in (50, 150)]), lambda x: x.isNotNull())
    d = s.select("gender", (form.log_loss(F.col("on_surface"), y) - form.log_loss(F.col("base"), y)).alias("delta"), F.explode(strata).alias("stratum"))
    return form.paired_bootstrap(d, "delta", ["gender", "stratum"], n=200)
