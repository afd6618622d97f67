"""Serve tendencies: placement per match, what it earns, how stable it is, how much history tells the next match."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from deucebase.functions.notation import first_serve_dir, serve_dir
from deucebase.functions.score import pressure, serve_side
from deucebase.functions.stats import corr, norm_sf
from deucebase.operators.screens import half

WHO = ["gender", "player"]
TARGETS = ("4", "5", "6")  # wide, body, T
BUCKETS = ("normal", "break_pt", "game_pt", "deuce", "tiebreak")


def serves(points: DataFrame) -> DataFrame:
    """One row per charted delivery of a valid point with a known side: who, serve number, target ("" or "0" if none),
    pressure, whether it started the point, and the server's win."""
    c = F.col
    p = points.where("svr IN (1, 2) AND pt_winner IN (1, 2)").withColumn("side", serve_side(c("pts"))).where("side <> 'na'")
    second = F.trim(F.coalesce("second_serve", F.lit(""))) != ""
    won = (c("svr") == c("pt_winner")).cast("int")
    one = F.struct(F.lit(1).alias("snum"), serve_dir(c("first_serve")).alias("target"), (~second).alias("starts"))
    two = F.struct(F.lit(2).alias("snum"), serve_dir(c("second_serve")).alias("target"), F.lit(True).alias("starts"))
    names = F.when(c("svr") == 1, c("player1")).otherwise(c("player2")), F.when(c("svr") == 1, c("player2")).otherwise(c("player1"))
    return p.select("match_id", "gender", names[0].alias("player"), names[1].alias("opponent"), "date", "year", "side", pressure(c("pts"), c("gm1"), c("gm2")).alias("bucket"), won.alias("won"), F.inline(F.when(second, F.array(one, two)).otherwise(F.array(one))))


def placement(delivered: DataFrame) -> DataFrame:
    """Per match, player, side and serve number: counts by target (c), those that started the point (p), won (w)."""
    at = lambda t, cond, v: F.sum(F.when((F.col("target") == t) & cond, v).otherwise(0))
    sums = [at(t, cond, v).alias(f"{n}{t}") for n, cond, v in (("c", F.lit(True), F.lit(1)), ("p", F.col("starts"), F.lit(1)), ("w", F.col("starts"), F.col("won"))) for t in TARGETS]
    g = delivered.where(F.col("target").isin(*TARGETS)).groupBy("match_id", *WHO, "opponent", "date", "year", "side", "snum")
    return g.agg(*sums).withColumn("n", F.col("c4") + F.col("c5") + F.col("c6"))


def chart_coverage(delivered: DataFrame, by: list[str]) -> DataFrame:
    """First serves, those with a target, and those charted as unknown, per group."""
    return delivered.where("snum = 1").groupBy(*by).agg(F.count(F.lit(1)).alias("serves"), F.count_if(F.col("target").isin(*TARGETS)).alias("coded"), F.count_if(F.col("target") == "0").alias("unknown"))


def charter_effect(placed: DataFrame, charters: DataFrame, target: str = "4", min_cell: int = 150, min_rest: int = 300, min_charter: int = 2000) -> DataFrame:
    """By gender: how far charters shift a target's share of the same players against all other charts of them."""
    c = placed.where("snum = 1").join(charters, "match_id").groupBy(*WHO, "charted_by").agg(F.sum(f"c{target}").alias("c"), F.sum("n").alias("n"))
    w = Window.partitionBy(*WHO)
    c = c.withColumn("rest", F.sum("n").over(w) - F.col("n")).withColumn("rest_c", F.sum("c").over(w) - F.col("c")).where((F.col("n") >= min_cell) & (F.col("rest") >= min_rest))
    d = c.groupBy("gender", "charted_by").agg((F.sum(F.col("n") * (F.col("c") / F.col("n") - F.col("rest_c") / F.col("rest"))) / F.sum("n")).alias("dev"), F.sum("n").alias("n")).where(F.col("n") >= min_charter)
    return d.groupBy("gender").agg(F.count(F.lit(1)).alias("charters"), F.stddev_pop("dev").alias("sd"), F.min("dev").alias("low"), F.max("dev").alias("high"))


def n_for_reliability(tau2: Column, v1: Column, r: float, inflate: Column | float = 1.0) -> Column:
    """Serves needed for a statistic to be ``r`` signal; null where players don't differ."""
    return F.when(tau2 > 0, r * (F.lit(inflate) if isinstance(inflate, float) else inflate) * v1 / ((1 - r) * tau2))


def spearman_brown(r: Column, k: float = 2.0) -> Column:
    return F.when(r > -1, F.try_divide(k * r, 1 + (k - 1) * r))


def implied_inflation(tau2: Column, v1: Column, r: Column, n: Column) -> Column:
    """How much noisier than one coin a player is, given the correlation of halves; at least 1."""
    return F.when((tau2 > 0) & (r > 0) & (n > 0), F.greatest(F.try_divide((tau2 / r - tau2) * n, v1), F.lit(1.0)))


def _card(name: str, floor: int) -> Column:
    """Struct value, variance, n of a statistic over sums c, p, w; null below the floor."""
    c = F.col
    n = c("c4") + c("c5") + c("c6")
    if name in ("wide", "t"):
        x = c("c4" if name == "wide" else "c6") / n
        return F.when(n >= floor, F.struct(x.alias("v"), (x * (1 - x) / n).alias("s"), n.alias("n")))
    top, low = ("p", "c") if name == "in_gap" else ("w", "p")
    a, b = F.try_divide(c(f"{top}4"), c(f"{low}4")), F.try_divide(c(f"{top}6"), c(f"{low}6"))
    return F.when(F.least(f"{low}4", f"{low}6") >= floor, F.struct((b - a).alias("v"), (a * (1 - a) / c(f"{low}4") + b * (1 - b) / c(f"{low}6")).alias("s"), n.alias("n")))


CARDS = ("wide", "t", "in_gap", "pay_gap")
_SUMS = [f"{x}{t}" for x in "cpw" for t in TARGETS]


def card_stats(placed: DataFrame, key: str = "match_id", min_full: int = 150, min_half: int = 50) -> DataFrame:
    """By gender and statistic, deuce court first serves: variance between players beyond sampling, the correlation of two
    halves by a hash of ``key`` (the match, or its charter), and the serves needed for four fifths signal."""
    d = placed.where("side = 'deuce' AND snum = 1")
    sums = [F.sum(s).alias(s) for s in _SUMS]
    full = d.groupBy(*WHO).agg(*sums).select("gender", F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), _card(k, min_full).alias("x")) for k in CARDS]))).where("x IS NOT NULL")
    vc = full.groupBy("gender", "stat").agg(F.count(F.lit(1)).alias("players"), F.avg("x.v").alias("mean"), F.greatest(F.var_samp("x.v") - F.avg("x.s"), F.lit(0.0)).alias("tau2"), F.avg(F.col("x.s") * F.col("x.n")).alias("v1"), F.median("x.n").alias("median_n"))
    halves = d.groupBy(*WHO, half(F.col(key)).alias("half")).agg(*sums).select(*WHO, "half", F.inline(F.array(*[F.struct(F.lit(k).alias("stat"), _card(k, min_half).alias("x")) for k in CARDS]))).where("x IS NOT NULL")
    side = lambda h, f: F.max(F.when(F.col("half") == h, F.col(f"x.{f}")))
    pair = halves.groupBy(*WHO, "stat").agg(*[side(h, f).alias(f"{f}{h}") for h in (0, 1) for f in ("v", "n")]).where("v0 IS NOT NULL AND v1 IS NOT NULL")
    r = _halves(pair)
    j = vc.join(r, ["gender", "stat"]).where("players >= 3 AND pairs >= 3")
    phi = implied_inflation(F.col("tau2"), F.col("v1"), F.col("r"), F.col("n_half"))
    j = j.withColumn("reliability", spearman_brown(F.col("r"))).withColumn("phi", phi)
    return j.withColumn("n80", n_for_reliability(F.col("tau2"), F.col("v1"), 0.8, F.col("phi"))).withColumn("n80_binomial", n_for_reliability(F.col("tau2"), F.col("v1"), 0.8))


def _halves(pair: DataFrame) -> DataFrame:
    r = pair.groupBy("gender", "stat").agg(F.count(F.lit(1)).alias("pairs"), corr(F.col("v0"), F.col("v1")).alias("r"))
    n = pair.select("gender", "stat", F.explode(F.array("n0", "n1")).alias("n")).groupBy("gender", "stat").agg(F.median("n").alias("n_half"))
    return r.join(n, ["gender", "stat"])


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail by the cube-root approximation; good to a thousandth from five degrees of freedom on."""

    def one(v, k):
        if v is None or k is None or not v > 0 or not k > 0:
            return 1.0
        z = ((v / k) ** (1 / 3) - 1 + 2 / (9 * k)) / math.sqrt(2 / (9 * k))
        return 0.5 * math.erfc(z / math.sqrt(2))

    return pd.Series([one(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


def dispersion(placed: DataFrame, hands: DataFrame, target: str = "4", min_serves: int = 12, min_matches: int = 15, min_hand: int = 40) -> DataFrame:
    """Per player and side: does a target's share move more between matches than one coin would (phi, chi-square over its
    degrees), and how much of that do the opponent's hand and the year explain?"""
    k, n = F.col(f"c{target}"), F.col("n")
    by = [*WHO, "side"]
    every = placed.where("snum = 1").join(hands.select("gender", F.col("player").alias("opponent"), F.col("hand").alias("opp")), ["gender", "opponent"], "left")
    whole = Window.partitionBy(*by)
    vs = Window.partitionBy(*by, "opp")
    every = every.withColumn("hand_n", F.sum("n").over(vs)).withColumn("hand_rate", F.sum(k).over(vs) / F.sum("n").over(vs))
    usable = lambda h: F.max(F.when((F.col("opp") == h) & (F.col("hand_n") >= min_hand), 1).otherwise(0)).over(whole)
    every = every.withColumn("both", (usable("R") + usable("L")) == 2)
    m = every.where(n >= min_serves).withColumn("p", F.sum(k).over(whole) / F.sum("n").over(whole)).withColumn("y_rate", F.sum(k).over(Window.partitionBy(*by, "year")) / F.sum("n").over(Window.partitionBy(*by, "year")))
    chi = lambda p: F.when((p > 0) & (p < 1), F.pow(k - n * p, F.lit(2)) / (n * p * (1 - p))).otherwise(0.0)
    hand = F.coalesce(F.col("both") & F.col("opp").isin("R", "L"), F.lit(False))
    g = m.groupBy(*by).agg(F.count(F.lit(1)).alias("matches"), F.sum("n").alias("n"), F.first("p").alias("p"), F.sum(chi(F.col("p"))).alias("chi"), F.count_if(hand).alias("hm"), F.sum(F.when(hand, chi(F.col("hand_rate")))).alias("hchi"), (F.countDistinct("year") + F.max(F.when(F.col("year").isNull(), 1).otherwise(0))).alias("years"), F.sum(chi(F.col("y_rate"))).alias("ychi"))
    g = g.where((F.col("matches") >= min_matches) & (F.col("p") > 0) & (F.col("p") < 1))
    phi_hand = F.when(F.col("hm") >= min_matches, F.col("hchi") / (F.col("hm") - 2))
    phi_year = F.when((F.col("years") > 1) & (F.col("years") < F.col("matches") - 1), F.col("ychi") / (F.col("matches") - F.col("years")))
    return g.select(*by, "matches", "n", "p", (F.col("chi") / (F.col("matches") - 1)).alias("phi"), phi_hand.alias("phi_hand"), phi_year.alias("phi_year"), chi2_sf("chi", F.col("matches") - 1).alias("pval"))


def bh_reject(df: DataFrame, p: str, by: list[str], q: float = 0.10) -> DataFrame:
    """How many hypotheses of a group survive Benjamini-Hochberg at level ``q``."""
    w = Window.partitionBy(*by)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(p))).withColumn("_m", F.count(F.lit(1)).over(w))
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("tests"), F.coalesce(F.max(F.when(F.col(p) <= q * F.col("_r") / F.col("_m"), F.col("_r"))), F.lit(0)).alias("rejected"))


def leverage(delivered: DataFrame, bucket: str = "break_pt", target: str = "6", min_n: int = 80, min_normal: int = 100) -> DataFrame:
    """Per player: a target's share on big points against the own normal-point rate, side by side of the court."""
    d = delivered.where(F.col("snum") == 1).where(F.col("target").isin(*TARGETS))
    n = lambda b, t: F.count_if((F.col("bucket") == b) & (F.col("target") == t if t else F.lit(True)))
    s = d.groupBy(*WHO, "side").agg(n(bucket, "").alias("nb"), n(bucket, target).alias("kb"), n("normal", "").alias("nn"), n("normal", target).alias("kn")).where((F.col("nb") > 0) & (F.col("nn") >= min_normal))
    p = F.col("kn") / F.col("nn")
    g = s.groupBy(*WHO).agg(F.sum("nb").alias("n"), F.sum("kb").alias("obs"), F.sum(F.col("nb") * p).alias("exp"), F.sum(F.col("nb") * p * (1 - p)).alias("var")).where((F.col("n") >= min_n) & (F.col("var") > 0))
    z = (F.col("obs") - F.col("exp")) / F.sqrt("var")
    return g.select(*WHO, "n", (F.col("obs") / F.col("n")).alias("observed"), (F.col("exp") / F.col("n")).alias("expected"), z.alias("z"), (2 * norm_sf(F.abs(z))).alias("pval"))


def tour_leverage(delivered: DataFrame, least: int = 500) -> DataFrame:
    """Shares of the targets by gender, side and pressure."""
    d = delivered.where(F.col("snum") == 1).where(F.col("target").isin(*TARGETS) & F.col("bucket").isin(*BUCKETS))
    g = d.groupBy("gender", "side", "bucket").agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("target") == t).cast("int")).alias(f"share{t}") for t in TARGETS])
    return g.where(F.col("n") >= least)


def careers(placed: DataFrame) -> DataFrame:
    """First serves of a player per match with ``age`` (0: the newest) and a total order by date, year, id."""
    side = lambda s, t: F.coalesce(F.sum(F.when(F.col("side") == s, F.col(f"c{t}"))), F.lit(0)).alias(f"{s}{t}")
    m = placed.where("snum = 1").groupBy(*WHO, "match_id", "date", "year").agg(*[side(s, t) for s in ("deuce", "ad") for t in TARGETS], F.sum("n").alias("n"))
    w = Window.partitionBy(*WHO).orderBy(F.coalesce(F.unix_date("date"), F.lit(0)).desc(), F.coalesce("year", F.lit(0)).desc(), F.desc("match_id"))
    return m.withColumn("age", F.row_number().over(w) - 1).withColumn("later", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _weight(rule: Column, age: Column) -> Column:
    """Weight of a match by a rule: {kind, param}; null param: the whole career."""
    return F.when(rule["param"].isNull(), 1.0).when(rule["kind"] == "window", (age < rule["param"]).cast("double")).otherwise(F.pow(F.lit(0.5), age / rule["param"]))


def _rules(windows: tuple, halflives: tuple) -> Column:
    one = lambda kind, p: F.struct(F.lit(kind).alias("kind"), F.lit(p).cast("int").alias("param"))
    return F.array(*[one("window", w) for w in windows], *[one("decay", h) for h in halflives])


def window_scan(placed: DataFrame, holdout: int = 200, history: int = 600, windows: tuple = (5, 10, 20, 40, 80, None), halflives: tuple = (10, 20, 40, 80), smooth: float = 25.0) -> DataFrame:
    """Which stretch of history best predicts a player's newest ``holdout`` serves? By gender and rule: mean log-loss a
    serve, rms error of the T share, and that without the held-out serves' own noise."""
    c = careers(placed)
    cells = [f"{s}{t}" for s in ("deuce", "ad") for t in TARGETS]
    tour = c.groupBy("gender").agg(*[F.sum(x).alias(f"t_{x}") for x in cells])
    tour = tour.select("gender", *[(F.col(f"t_{s}{t}") / sum(F.col(f"t_{s}{u}") for u in TARGETS)).alias(f"t_{s}{t}") for s in ("deuce", "ad") for t in TARGETS])
    held = F.col("later") < holdout
    who = Window.partitionBy(*WHO)
    c = c.withColumn("held", held).withColumn("hist_n", F.sum(F.when(~held, F.col("n"))).over(who)).withColumn("held_n", F.sum(F.when(held, F.col("n"))).over(who)).withColumn("held_m", F.count_if(held).over(who))
    c = c.where((F.col("hist_n") >= history) & (F.col("held_n") >= holdout))
    h = c.where("held").groupBy(*WHO).agg(*[F.sum(x).alias(f"h_{x}") for x in cells], F.sum("n").alias("h_n"))
    x = c.where("NOT held").withColumn("rule", F.explode(_rules(windows, halflives))).withColumn("wt", _weight(F.col("rule"), F.col("age") - F.col("held_m")))
    p = x.groupBy(*WHO, "rule").agg(*[F.sum(F.col("wt") * F.col(k)).alias(k) for k in cells]).join(h, WHO).join(tour, "gender")
    total = lambda s, pre="": sum(F.col(f"{pre}{s}{t}") for t in TARGETS)
    est = lambda s, t: (F.col(f"{s}{t}") + smooth * F.col(f"t_{s}{t}")) / (total(s) + smooth)
    loss = -sum(F.col(f"h_{s}{t}") * F.log(F.greatest(est(s, t), F.lit(1e-9))) for s in ("deuce", "ad") for t in TARGETS) / F.col("h_n")
    share = lambda s: F.try_divide(F.col(f"h_{s}6"), total(s, "h_"))
    sq = sum(F.coalesce(total(s, "h_") * F.pow(est(s, "6") - share(s), F.lit(2)), F.lit(0.0)) for s in ("deuce", "ad")) / F.col("h_n")
    many = lambda s: total(s, "h_") > 1
    noise = sum(F.when(many(s), total(s, "h_") * share(s) * (1 - share(s)) / F.greatest(total(s, "h_") - 1, F.lit(1))).otherwise(0.0) for s in ("deuce", "ad"))
    floor = F.coalesce(F.try_divide(noise, sum(F.when(many(s), total(s, "h_")).otherwise(0) for s in ("deuce", "ad"))), F.lit(0.0))
    g = p.select("gender", "rule", loss.alias("loss"), sq.alias("sq"), floor.alias("floor")).groupBy("gender", "rule").agg(F.count(F.lit(1)).alias("players"), F.avg("loss").alias("loss"), F.avg("sq").alias("sq"), F.avg("floor").alias("floor"))
    return g.select("gender", "rule.kind", "rule.param", "players", "loss", F.sqrt("sq").alias("rmse"), F.sqrt(F.greatest(F.col("sq") - F.col("floor"), F.lit(0.0))).alias("est"))


def recent_profile(placed: DataFrame, kind: str = "decay", param: int = 20) -> DataFrame:
    """Per player and side: shares of the targets under a rule, the effective number of serves, and the span of matches
    that still carry a tenth of the newest one's weight."""
    c = careers(placed).withColumn("wt", _weight(F.struct(F.lit(kind).alias("kind"), F.lit(param).alias("param")), F.col("age")))
    side = lambda s: F.struct(F.lit(s).alias("side"), *[F.col(f"{s}{t}").alias(f"c{t}") for t in TARGETS])
    c = c.select(*WHO, "wt", "year", F.inline(F.array(side("deuce"), side("ad")))).withColumn("n", F.col("c4") + F.col("c5") + F.col("c6"))
    live = F.col("wt") >= 0.1
    g = c.groupBy(*WHO, "side").agg(*[F.try_divide(F.sum(F.col("wt") * F.col(f"c{t}")), F.sum(F.col("wt") * F.col("n"))).alias(f"share{t}") for t in TARGETS], F.try_divide(F.pow(F.sum(F.col("wt") * F.col("n")), F.lit(2)), F.sum(F.col("wt") * F.col("wt") * F.col("n"))).alias("n_eff"), F.count_if(live).alias("matches"), F.min(F.when(live, F.col("year"))).alias("y0"), F.max(F.when(live, F.col("year"))).alias("y1"))
    return g


def tvd(a: np.ndarray, b: np.ndarray, least: int = 40) -> float:
    """Distance of two profiles (sides by targets): total variation a side, weighted by the thinner one."""
    na, nb = a.sum(1), b.sum(1)
    ok = (na >= least) & (nb >= least)
    if not ok.any():
        return math.nan
    d = np.abs(a[ok] / na[ok, None] - b[ok] / nb[ok, None]).sum(1) / 2
    w = np.minimum(na, nb)[ok]
    return float((w * d).sum() / w.sum())


def biggest_move(a: np.ndarray, b: np.ndarray, least: int = 40) -> str:
    na, nb = a.sum(1), b.sum(1)
    moves = [(abs(b[s, t] / nb[s] - a[s, t] / na[s]), s, t) for s in range(2) if na[s] >= least and nb[s] >= least for t in range(3)]
    if not moves or max(moves)[0] <= 0:
        return ""
    _, s, t = max(moves, key=lambda m: (m[0], -m[1], -m[2]))
    return f"{('deuce', 'ad')[s]} {('wide', 'body', 'T')[t]} {a[s, t] / na[s]:.0%}→{b[s, t] / nb[s]:.0%}"


def drift(placed: DataFrame, min_serves: int = 12, career: int = 800, years: int = 8, shuffles: int = 50) -> DataFrame:
    """Per player: gap between the early and the late half of a career's serves against the median gap of shuffled match
    orders. One player's matches are a bounded group; the shuffles are seeded by the name."""
    cells = [f"{s}{t}" for s in ("deuce", "ad") for t in TARGETS]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        columns = ["gender", "player", "n", "matches", "y0", "y1", "chrono", "null_gap", "ratio", "moved"]
        g = g[g["n"] >= min_serves].sort_values("match_id")
        y = g["year"].dropna()
        if g["n"].sum() < career or not len(y) or y.max() - y.min() < years:
            return pd.DataFrame([], columns=columns)
        x, n = g[cells].to_numpy(float).reshape(-1, 2, 3), g["n"].to_numpy(float)

        def cut(order):
            k = int(np.searchsorted(np.cumsum(n[order]), n.sum() / 2)) + 1
            return x[order[:k]].sum(0), x[order[k:]].sum(0)

        early, late = cut(np.lexsort((g["match_id"].astype(str).to_numpy(), g["year"].fillna(0).to_numpy())))
        gap = tvd(early, late)
        name = str(g["player"].iloc[0])
        rng = np.random.default_rng(zlib.crc32(name.encode()))
        null = [d for d in (tvd(*cut(rng.permutation(len(n)))) for _ in range(shuffles)) if not math.isnan(d)]
        if math.isnan(gap) or not null:
            return pd.DataFrame([], columns=columns)
        m = float(np.median(null))
        return pd.DataFrame([(g["gender"].iloc[0], name, int(n.sum()), len(n), int(y.min()), int(y.max()), gap, m, gap / m if m else None, biggest_move(early, late))], columns=columns)

    return careers(placed).groupBy(*WHO).applyInPandas(one, "gender string, player string, n bigint, matches int, y0 int, y1 int, chrono double, null_gap double, ratio double, moved string")


def side_summary(parsed: DataFrame) -> DataFrame:
    """Serving by side, for the tour and per player (GROUPING SETS): placement, first serves in, aces, points won, and the
    server's second stroke: forehands, attempts, those that paid."""
    c = F.col
    p = parsed.where("svr IN (1, 2) AND pt_winner IN (1, 2) AND parse_ok AND server_won IS NOT NULL").withColumn("side", serve_side(c("pts"))).where("side <> 'na'")
    s, nxt = F.get("shots", F.lit(2)), F.get("shots", F.lit(3))
    flag = lambda b: F.coalesce(b, F.lit(False)).cast("int")
    won, first, third = flag(c("server_won")), c("serve_in_play") == 1, F.size("shots") >= 3
    target = first_serve_dir(c("first_serve"))
    w, e, f = flag(s["terminal"] == "*"), flag(s["terminal"] == "@"), flag(nxt["terminal"] == "#")
    v = {
        "n": F.lit(1), "s1_n": flag(first), "s1_w": won * flag(first), "s2_n": flag(~first), "s2_w": won * flag(~first), "aces": flag(c("outcome") == "ace"), "dfs": flag(c("outcome") == "double_fault"),
        **{f"d{t}": flag(target == t) for t in TARGETS}, "third": flag(third), "third_fh": flag(third & (s["side"] == "FH")), "third_att": flag(third) * (w + e + f), "third_won": flag(third) * (w + f),
    }
    rows = p.select("gender", F.when(c("svr") == 1, c("player1")).otherwise(c("player2")).alias("player"), "side", *[x.alias(k) for k, x in v.items()])
    rows = rows.groupBy("gender", "player", "side").agg(*[F.sum(k).alias(k) for k in v])
    g = rows.groupingSets([[c("gender"), c("side")], [c("gender"), c("player"), c("side")]], c("gender"), c("player"), c("side")).agg(*[F.sum(k).alias(k) for k in v])
    known = c("d4") + c("d5") + c("d6")
    ratio = lambda a, b: F.try_divide(a, b)
    return g.select(
        "gender", F.coalesce("player", F.lit("_tour_")).alias("player"), "side", "n", "s1_n", "s2_n", ratio(c("s1_n"), c("n")).alias("first_in"), ratio(c("aces"), c("n")).alias("ace"), ratio(c("dfs"), c("n")).alias("df"), ratio(c("s1_w"), c("s1_n")).alias("s1_won"), ratio(c("s2_w"), c("s2_n")).alias("s2_won"),
        ratio(c("d4"), known).alias("wide"), ratio(c("d5"), known).alias("body"), ratio(c("d6"), known).alias("t"), "third", ratio(c("third_fh"), c("third")).alias("third_fh"), ratio(c("third_att"), c("third")).alias("third_att"), ratio(c("third_won"), c("third_att")).alias("third_conv"),
    )

