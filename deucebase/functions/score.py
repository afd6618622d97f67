"""Score scalars: serve side, pressure, lead, win probability of a game."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points done for a game token.
TOKENS = {"0": 0, "15": 1, "30": 2, "40": 3, "AD": 4}
BREAK_POINTS = ("0-40", "15-40", "30-40", "40-AD")
GAME_POINTS = ("40-0", "40-15", "40-30", "AD-40")


def _done(token: Column) -> Column:
    c = F.lit(None).cast("int")
    for k, v in TOKENS.items():
        c = F.when(token == k, v).otherwise(c)
    return c


def serve_side(pts: Column) -> Column:
    """deuce or ad by the parity of points done; na if the score is not two tokens."""
    t = F.split(F.coalesce(pts, F.lit("")), "-")
    a, b = F.get(t, F.lit(0)), F.get(t, F.lit(1))
    game = _done(a) + _done(b)
    digits = a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$")
    done = F.coalesce(game, F.when(digits, a.try_cast("int") + b.try_cast("int")))
    return F.when((F.size(t) != 2) | done.isNull(), "na").when(done % 2 == 0, "deuce").otherwise("ad")


def pressure(pts: Column, g1: Column, g2: Column) -> Column:
    known = F.forall(F.split(pts, "-"), lambda x: x.isin(*TOKENS))
    tie = ~known | F.coalesce((g1 >= 6) & (g2 >= 6), F.lit(False))
    return F.when(F.coalesce(~pts.contains("-"), F.lit(True)), "na").when(tie, "tiebreak").when(pts.isin(*BREAK_POINTS), "break_pt").when(pts.isin(*GAME_POINTS), "game_pt").when(pts == "40-40", "deuce").otherwise("normal")


def lead(sg: Column, rg: Column, ss: Column, rs: Column) -> Column:
    gap = sg - rg
    none = sg.isNull() | rg.isNull() | ss.isNull() | rs.isNull()
    return F.when(none, "na").when(ss > rs, "set_ahead").when(ss < rs, "set_behind").when(gap >= 2, "ahead").when(gap <= -2, "behind").otherwise("even")


def game_wp(g: Column) -> Column:
    """Chance to hold from 0-0 at point rate ``g``: win to 0, 15, 30, or reach deuce and win from there."""
    q = 1 - g
    return F.pow(g, F.lit(4)) * (1 + 4 * q + 10 * q * q) + 20 * F.pow(g * q, F.lit(3)) * g * g / (g * g + q * q)


def shrink(w: Column, n: Column, prior: Column, k: float) -> Column:
    """Rate with ``k`` pseudo-observations at ``prior``."""
    return (w + k * prior) / (n + k)
