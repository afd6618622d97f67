"""Serve and return strength, current and walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions.score import shrink

VALID = "svr IN (1, 2) AND pt_winner IN (1, 2)"


def valid_points(points: DataFrame) -> DataFrame:
    return points.where(VALID)


def league_mu(points: DataFrame) -> DataFrame:
    """Mean share of points that the server wins, by gender."""
    return valid_points(points).groupBy("gender").agg(F.avg((F.col("svr") == F.col("pt_winner")).cast("int")).alias("mu"))


def player_view(points: DataFrame) -> DataFrame:
    """Two rows a point, one per player: who, serving or not, won or not. One scan, no self-join."""
    sides = F.array(*[F.struct(F.col(f"player{k}").alias("player"), F.lit(k).alias("slot")) for k in (1, 2)])
    p = valid_points(points).withColumn("side", F.explode(sides))
    return p.withColumn("player", F.col("side.player")).withColumn("slot", F.col("side.slot")).withColumn("serving", F.col("svr") == F.col("slot")).withColumn("won", (F.col("pt_winner") == F.col("slot")).cast("int")).drop("side")


def _sums(g):
    s = lambda c, name: F.sum(F.when(c, F.col("won")).otherwise(0)).alias(f"{name}_won")
    n = lambda c, name: F.sum(c.cast("int")).alias(f"{name}_n")
    serving = F.col("serving")
    return g.agg(s(serving, "serve"), n(serving, "serve"), s(~serving, "return"), n(~serving, "return"))


def current_strength(points: DataFrame) -> DataFrame:
    """Career serve and return rates per (gender, player); the league's rate where a player has no such point."""
    sums = _sums(player_view(points).groupBy("gender", "player"))
    mu = league_mu(points)
    j = sums.join(mu, "gender")
    serve = F.coalesce(F.try_divide("serve_won", "serve_n"), "mu")
    ret = F.coalesce(F.try_divide("return_won", "return_n"), 1 - F.col("mu"))
    return j.select("gender", "player", serve.alias("serve_rate"), ret.alias("return_rate"))


def day_log(points: DataFrame, by: tuple[str, ...] = ("gender", "player")) -> DataFrame:
    """Sums per player and day."""
    return _sums(player_view(points).groupBy(*by, "date"))


def walk_forward(points: DataFrame, k: float = 100.0, by: tuple[str, ...] = ("gender", "player")) -> DataFrame:
    """Rates before each day a player played: matches of that day do not see each other. Shrunk by ``k`` points to the
    league's rate so far. A range frame over day numbers ends the day before; nothing is iterated."""
    log = day_log(points, by).withColumn("day", F.unix_date("date"))
    before = Window.partitionBy(*by).orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    # the league's sums are one row per gender and day, a fixed number of days at most
    daily = log.groupBy("gender", "day").agg(F.sum("serve_won").alias("w"), F.sum("serve_n").alias("n"))
    lw = Window.partitionBy("gender").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    league = daily.select("gender", "day", F.coalesce(F.try_divide(F.sum("w").over(lw), F.sum("n").over(lw)), F.lit(0.6)).alias("mu"))
    for c in ("serve_won", "serve_n", "return_won", "return_n"):
        log = log.withColumn(f"p_{c}", F.coalesce(F.sum(c).over(before), F.lit(0)))
    j = log.join(league, ["gender", "day"])
    return j.select(*by, "date", "p_serve_n", "p_return_n", shrink(F.col("p_serve_won"), F.col("p_serve_n"), F.col("mu"), k).alias("serve_rate"), shrink(F.col("p_return_won"), F.col("p_return_n"), 1 - F.col("mu"), k).alias("return_rate"))


def matchup(serve_a, return_b, mu):
    """Point rate of A's serve against B's return, kept between .30 and .92."""
    return F.least(F.greatest(serve_a - return_b + 1 - mu, F.lit(0.30)), F.lit(0.92))


def trailing_form(log: DataFrame, n: int = 10, days: int = 540, by: tuple[str, ...] = ("gender", "player"), value: str = "residual") -> DataFrame:
    """Mean of the last ``n`` earlier values that are at most ``days`` old; 0 if there are none.

    The window holds a player's matches of ``days`` days, which is bounded by the calendar."""
    w = Window.partitionBy(*by).orderBy("day").rangeBetween(-days, -1)
    got = F.sort_array(F.collect_list(F.struct("day", "match_id", value)).over(w), asc=False)
    recent = F.slice(got, 1, n)
    total = F.aggregate(recent, F.lit(0.0), lambda acc, x: acc + x[value])
    return log.withColumn("n_recent", F.size(recent)).withColumn("form", F.coalesce(F.try_divide(total, F.size(recent)), F.lit(0.0)))
