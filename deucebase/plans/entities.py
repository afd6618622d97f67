"""Fingerprints, performances, eras, clusters and match win probability."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.operators import coded, eras, matchwp, strength, winprob
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.plans.value import _pos
from deucebase.sources.adapter import matches, points
from deucebase.sources.store import coded_points, once, parsed

_NETTY = "(letter IN ('v', 'z', 'o', 'p', 'u', 'y') OR contains(tail, '+') OR contains(tail, '-'))"
_GS = "letter IN ('f', 'b', 'r', 's')"


def _point_sums() -> str:
    """Counters of the point's grain for slot ``slot``, server ``server``; s1d and s2*: first stroke's direction, second stroke."""
    own, first = "slot = server", "slot = server AND serve_in_play = 1"
    live = "last_hitter = slot AND rally_len >= 3 AND outcome ="
    cond = {
        "points": "true", "serve_pts": own, "return_pts": "slot <> server", "first_in": first, "serve1": f"{first} AND rally_len > 0", "sv4": f"{first} AND s1d = '4'", "sv6": f"{first} AND s1d = '6'",
        "aces": f"{own} AND outcome = 'ace'", "dfs": f"{own} AND outcome = 'double_fault'", "unreturned": f"{own} AND (outcome = 'ace' OR (outcome <> 'double_fault' AND rally_len = 2 AND last_hitter <> server AND server_won))",
        **{f"{x}{d}": f"{first} AND has AND {sql.SIDE} = '{side}'" + (f" AND s1d = '{d}'" if d else "") for x, side in (("d", "deuce"), ("a", "ad")) for d in ("", "4", "6")},
        **{f"s2{d}": f"{own} AND serve_in_play = 2 AND has" + (f" AND s1d = '{d}'" if d else "") for d in ("", "4", "6")},
        "gs_winners": f"last_hitter = slot AND outcome = 'winner' AND NOT on_serve AND {_GS}", "unforced": "last_hitter = slot AND outcome = 'unforced_error'",
        "returns": "ret", "ret_slice": "ret AND r_letter IN ('r', 's')", "ret_fh": f"ret AND r_side = 'FH'", "ret_depth": "ret AND r_depth IS NOT NULL", "ret_deep": "ret AND r_depth = '9'", "ret_shallow": "ret AND r_depth = '7'",
        "ret_dir": "ret AND r_dir IS NOT NULL", "ret_d1": "ret AND r_dir = '1'", "ret_d3": "ret AND r_dir = '3'", "net_points": "coalesce(at_net, false)",
        "winners": f"{live} 'winner'", "l_unforced": f"{live} 'unforced_error'", "l_forced": f"{live} 'forced_error'",
    }
    stroke = ("rally", "slice", "net", "fh", "ground", "l_rally", "l_slice", "l_net", "l_fh", "l_ground", "l_dir", "l_d1", "l_d3")
    return ", ".join([f"(coalesce({c}, false))::INT AS {k}" for k, c in cond.items()] + [f"coalesce(o_{k}, 0) AS {k}" for k in stroke])


def _stroke_sums() -> str:
    late = "idx >= 3 AND "
    cond = {"rally": "true", "slice": "letter IN ('r', 's')", "net": _NETTY, "fh": f"{_GS} AND side = 'FH'", "ground": _GS, "dir": "direction IN ('1', '2', '3')", "d1": "direction = '1'", "d3": "direction = '3'"}
    cond = {k: c for k, c in cond.items() if k not in ("dir", "d1", "d3")} | {f"l_{k}": late + c for k, c in cond.items()}
    return ", ".join(f"count(*) FILTER ({c}) AS o_{k}" for k, c in cond.items())


_COUNTERS = f"""{sql.SHOTS}, sh1 AS (SELECT match_id, pt, any_value(direction) FILTER (rn = 1) AS s1d, any_value(letter) FILTER (rn = 2) AS r_letter, any_value(side) FILTER (rn = 2) AS r_side, any_value(depth) FILTER (rn = 2) AS r_depth, any_value(direction) FILTER (rn = 2) AS r_dir
   FROM (SELECT *, row_number() OVER (PARTITION BY match_id, pt ORDER BY idx) AS rn FROM shots WHERE parse_ok) GROUP BY 1, 2),
 own AS (SELECT match_id, pt, hitter AS slot, bool_or({_NETTY}) AS at_net, {_stroke_sums()} FROM shots WHERE parse_ok AND NOT is_serve GROUP BY 1, 2, 3),
 dp AS (SELECT d.*, unnest([1, 2]) AS slot FROM decoded d WHERE parse_ok AND {sql.VALID}),
 ct AS (SELECT dp.match_id, pt, gender, year, slot, CASE WHEN slot = 1 THEN player1 ELSE player2 END AS player, rally_len, {_point_sums()}
   FROM (SELECT dp.*, slot <> server AND rally_len >= 2 AS ret FROM dp) dp LEFT JOIN sh1 USING (match_id, pt) LEFT JOIN own USING (match_id, pt, slot))"""


def _rates(rates: dict[str, str]) -> str:
    return ", ".join(f"round(sum({r.split('/')[0]}) / greatest(sum({r.split('/')[1]}), 1), 6) AS {k}" for k, r in rates.items())


def _counts(spark, d):
    """Counters per point and player, kept once an application."""
    return once(spark, "point_counters", d, lambda: eras.counters(parsed(spark, d), ("match_id", "pt", "gender", "year")))


def _player_counts(spark, d):
    """The counters of styles summed by player and year, kept once an application."""
    return once(spark, "player_counters", d, lambda: coded.player_counters(coded_points(spark, d)))


def _rounded(df, cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query(f"SELECT gender, player, year::INT AS year, sum(points)::BIGINT AS n, {_rates(eras.YEAR_RATES)} FROM ct GROUP BY 1, 2, 3", _COUNTERS)
def year_fingerprints(spark, d):
    return _rounded(eras.year_fingerprints(_player_counts(spark, d)), eras.YEAR_RATES)


@query(f"SELECT gender, player, sum(points)::BIGINT AS n, {_rates(eras.STYLE_RATES)} FROM ct GROUP BY 1, 2 HAVING sum(points) >= 100", _COUNTERS)
def style_fingerprints(spark, d):
    return _rounded(eras.fingerprints(_player_counts(spark, d), min_points=100), eras.RATES)


@query(f"SELECT match_id, slot::INT AS slot, gender, player, sum(points)::BIGINT AS n_points, sum(serve_pts)::BIGINT AS n_serve_pts, sum(l_rally)::BIGINT AS n_rally_shots, {_rates(eras.PERFORMANCE_RATES)} FROM ct GROUP BY 1, 2, 3, 4 HAVING sum(serve_pts) >= 10 AND sum(returns) >= 5 AND sum(l_rally) >= 10", _COUNTERS)
def performances(spark, d):
    return _rounded(eras.performances(_counts(spark, d), 10, 5, 10), eras.PERFORMANCE_RATES)


_FP = f"{_COUNTERS}, fp AS (SELECT gender, player, sum(points) AS n, {', '.join(f'sum({a}) / greatest(sum({b}), 1) AS {k}' for k, (a, b) in ((k, r.split('/')) for k, r in eras.STYLE_RATES.items()))} FROM ct GROUP BY 1, 2 HAVING sum(points) >= 100)"
_Z = ", ".join(f"coalesce(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0) AS {c}" for c in eras.RATES)


@query("SELECT gender, player, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in eras.RATES) + f" FROM (SELECT gender, player, {_Z} FROM fp WINDOW w AS (PARTITION BY gender))", _FP)
def standardized_styles(spark, d):
    return _rounded(eras.standardized(eras.fingerprints(_player_counts(spark, d), min_points=100)).select("gender", "player", *eras.RATES), eras.RATES)


def _eras(spark, d):
    return eras.career_eras(eras.year_fingerprints(_player_counts(spark, d)), min_era=50, min_span=3, ratio=1.0, min_year_points=10)


@query()
def career_eras(spark, d):
    """Tests hold the cuts and the null against plain versions; the gates are loose here, as are the tables small."""
    return _eras(spark, d)


@query()
def era_fingerprints(spark, d):
    """Fingerprints of entities: players, or their eras where a career is split."""
    c = eras.with_entity(_player_counts(spark, d), _eras(spark, d))
    return _rounded(eras.fingerprints(c, ["gender", "entity"], 50), eras.RATES)


@query()
def collapsed_eras(spark, d):
    c = eras.with_entity(_player_counts(spark, d), _eras(spark, d))
    f = eras.fingerprints(c, ["gender", "player", "entity"], 1)
    last = c.groupBy("gender", "player", "entity").agg(F.max("year").alias("year_end"))
    return _rounded(eras.collapsed(f.join(last, ["gender", "player", "entity"]), ["serve_wide", "ace_rate"], ["fh_share", "avg_rally_len"]), ("serve_wide", "ace_rate", "fh_share", "avg_rally_len"))


@query()
def style_clusters(spark, d):
    return eras.style_clusters(eras.fingerprints(_player_counts(spark, d), min_points=100))


_DIST = " + ".join(f"pow(a.{c} - b.{c}, 2)" for c in eras.RATES)


@query(f", z AS (SELECT gender, player, {_Z} FROM fp WINDOW w AS (PARTITION BY gender)), p AS (SELECT a.gender, a.player, b.player AS nearest, sqrt({_DIST}) AS distance FROM z a JOIN z b ON a.gender = b.gender AND a.player <> b.player) SELECT gender, player, arg_min(nearest, (round(distance, 9), nearest)) AS nearest, round(min(distance), 6) AS distance FROM p GROUP BY 1, 2", _FP)
def nearest_styles(spark, d):
    return eras.nearest_styles(eras.fingerprints(_player_counts(spark, d), min_points=100)).withColumn("distance", F.round("distance", 6))


# --- the score of a match

_SC = f"""sc AS (SELECT *, string_split(pts, '-') AS tk, svr = 1 AS serves FROM points WHERE {sql.VALID}),
 sd AS (SELECT *, len(tk) = 2 AS two, list_position(['0', '15', '30', '40', 'AD'], tk[1]) - 1 AS x, list_position(['0', '15', '30', '40', 'AD'], tk[2]) - 1 AS y FROM sc),
 se AS (SELECT *, (x IS NULL OR y IS NULL OR (pts = '0-0' AND gm1 = 6 AND gm2 = 6)) AS tie FROM sd WHERE two),
 sf AS (SELECT *, CASE WHEN tie THEN try_cast(tk[1] AS INT) ELSE x END AS a0, CASE WHEN tie THEN try_cast(tk[2] AS INT) ELSE y END AS b0 FROM se)"""


@query("SELECT match_id, pt, set1 AS s1, set2 AS s2, gm1 AS g1, gm2 AS g2, (CASE WHEN serves THEN a0 ELSE b0 END)::INT AS a, (CASE WHEN serves THEN b0 ELSE a0 END)::INT AS b, serves, tie AS tiebreak FROM sf WHERE a0 IS NOT NULL AND b0 IS NOT NULL", f"{sql.CTES}, {_SC}")
def parsed_scores(spark, d):
    return _scores(strength.valid_points(points(spark, d))).select("match_id", "pt", "s1", "s2", "g1", "g2", "a", "b", "serves", "tiebreak")


def _scores(p):
    c = F.col
    return p.withColumn("sc", matchwp.parse_score(c("svr"), c("set1"), c("set2"), c("gm1"), c("gm2"), c("pts"))).where("sc IS NOT NULL").select("*", "sc.*").drop("sc")


@query("SELECT match_id, arg_max(pt_winner, pt)::INT AS winner FROM points WHERE pt_winner IN (1, 2) GROUP BY match_id")
def eventual_winners(spark, d):
    return matchwp.eventual_winners(points(spark, d))


_MU = f"""{sql.PLAYERS}, mu AS (SELECT gender, avg((svr = pt_winner)::INT) AS mu FROM points WHERE {sql.VALID} GROUP BY gender),
 sr AS (SELECT gender, player, coalesce(sum(won) FILTER (serving) / nullif(count(*) FILTER (serving), 0), any_value(mu)) AS s, coalesce(sum(won) FILTER (NOT serving) / nullif(count(*) FILTER (NOT serving), 0), 1 - any_value(mu)) AS r FROM pv JOIN mu USING (gender) GROUP BY 1, 2),
 mt AS (SELECT match_id, best_of, greatest(.30, least(.92, a.s - b.r + 1 - mu)) AS p1, greatest(.30, least(.92, b.s - a.r + 1 - mu)) AS p2 FROM matches m JOIN mu USING (gender) JOIN sr a ON a.gender = m.gender AND a.player = m.player1 JOIN sr b ON b.gender = m.gender AND b.player = m.player2)"""


def _matchups(spark, d):
    """Point rates of both players of every match: serve against the other's return, kept once an application."""
    return once(spark, "matchups", d, lambda: _matchup_rows(spark, d))


def _matchup_rows(spark, d):
    p = points(spark, d)
    m = matches(spark, d).select("match_id", "gender", "player1", "player2", "best_of").join(strength.league_mu(p), "gender")
    s = once(spark, "strength", d, lambda: strength.current_strength(p))
    for k in (1, 2):
        m = m.join(s.select("gender", F.col("player").alias(f"player{k}"), F.col("serve_rate").alias(f"s{k}"), F.col("return_rate").alias(f"r{k}")), ["gender", f"player{k}"])
    pair = lambda a, b: strength.matchup(F.col(f"s{a}"), F.col(f"r{b}"), F.col("mu"))
    return m.select("match_id", F.col("best_of").cast("int").alias("best_of"), pair(1, 2).alias("p1"), pair(2, 1).alias("p2"))


@query("SELECT match_id, best_of::INT AS best_of, round(p1, 6) AS p1, round(p2, 6) AS p2 FROM mt", _MU)
def matchups(spark, d):
    return _rounded(_matchups(spark, d), ("p1", "p2"))


@query()
def pre_match_chances(spark, d):
    """Player 1's chance before every match; tests hold the tree against a walk over all points."""
    return matchwp.pre_match(_matchups(spark, d))


def _live(spark, d):
    def build():
        s = _scores(strength.valid_points(points(spark, d))).join(_matchups(spark, d), "match_id")
        return matchwp.with_match_wp(s.select("match_id", "pt", "gender", *matchwp.SCORE))

    return once(spark, "match_wp", d, build)


@query()
def match_win_probability(spark, d):
    """Every well-formed score with player 1's chance and the point's leverage; a score beyond the match's end has none."""
    return _live(spark, d)


@query()
def match_curves(spark, d):
    """The curve of every match: order, chance, leverage, where a set begins."""
    return matchwp.curve(_live(spark, d)).select("match_id", "pt", "i", "wp", "leverage", "new_set")


@query()
def clutch_strokes(spark, d):
    """The eight strokes that cost most: the report's limit."""
    return matchwp.clutch(winprob.shot_wpa(_pos(spark, d)), _live(spark, d).where("leverage IS NOT NULL")).select("match_id", "pt", "idx", "stroke", "server_delta", "leverage", "match_wpa")


@query()
def match_calibration(spark, d):
    """Chance against outcome, by tenths of the chance, over points."""
    j = _live(spark, d).where("wp IS NOT NULL").join(matchwp.eventual_winners(points(spark, d)), "match_id").withColumn("y", (F.col("winner") == 1).cast("int"))
    return winprob.calibration(j, "wp", "y")
