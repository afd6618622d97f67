"""Sums over strokes from their codes: what the array operators count a stroke at a time, in expressions that are compiled.

All take points as :func:`deucebase.sources.store.coded_points` has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deucebase.functions.notation import BACKHAND, CODE, FOREHAND, KINDS, code_at, spelled, stroke_kind, wing
from deucebase.operators.sequences import END, START

WHO = ["gender", "player"]
_I = F.col("i")


def _of(name: str, i: Column) -> Column:
    """``name`` of who hits stroke ``i``: the server hits the even ones."""
    return F.when(i % 2 == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1"))


def _strokes(coded: DataFrame, start: int, *columns) -> DataFrame:
    """One row per stroke from ``start`` on, numbered ``i``."""
    return coded.where(F.col("rally_len") > start).select(*columns, F.explode(F.sequence(F.lit(start), F.col("rally_len") - 1)).alias("i"))


def gram_counts(coded: DataFrame) -> DataFrame:
    """n of every (gender, player, a, b, t): two words, the next one, and whose it is (null: the point's end)."""
    pad = lambda k: F.concat(F.lit("<<<<"), F.col(f"words{k}"), F.lit(">>")).alias(f"words{k}")
    p = coded.where("parse_ok").select("gender", "by0", "by1", "rally_len", pad(0), pad(1))
    s = p.select("*", F.explode(F.sequence(F.lit(0), F.col("rally_len"))).alias("i"))
    word = lambda j: F.substring(_of("words", _I + j), 2 * (_I + j) + 5, F.lit(2))
    who = F.when(_I < F.col("rally_len"), _of("by", _I))
    g = s.groupBy("gender", who.alias("player"), word(-2).alias("a"), word(-1).alias("b"), word(0).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    plain = lambda c: F.when(F.col(c) == "<<", START).when(F.col(c) == ">>", END).otherwise(spelled(F.col(c))).alias(c)
    return g.select(*WHO, plain("a"), plain("b"), plain("t"), "n")


def strike_counts(coded: DataFrame, depths: tuple[int, ...] = (2,)) -> DataFrame:
    """As :func:`deucebase.operators.screens.strike_counts`."""
    s = _strokes(coded.where("parse_ok"), min(depths), "gender", "by0", "by1", "words0", "words1", "code", "side", "half")
    end, after = code_at(_I, 3), code_at(_I + 1, 3)
    s = s.select("gender", _of("by", _I).alias("player"), _of("words", _I).alias("words"), "side", "half", "i", *[(a == b).cast("int").alias(c) for a, b, c in ((end, "*", "w"), (end, "@", "e"), (after, "#", "f"))])
    k = F.col("k")
    s = s.withColumn("k", F.explode(F.array(*[F.lit(x) for x in depths]))).where("i >= k")
    context, opening = F.substring(F.col("words"), 2 * (_I - k) + 1, 2 * k), F.when((_I <= k + 3) & (F.col("side") != "na"), F.col("side"))
    g = s.groupBy(*WHO, "k", context.alias("context"), "half", opening.alias("opening")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("w", "e", "f")])
    words = F.concat_ws(" ", *[F.when(k > j, spelled(F.substring("context", 2 * j + 1, 2))) for j in range(max(depths))])
    return g.withColumn("context", words)


def observations(coded: DataFrame) -> DataFrame:
    """As :func:`deucebase.operators.sequences.observations`, without ``pt``."""
    s = _strokes(coded.where("parse_ok AND server_won IS NOT NULL"), 2, "match_id", "gender", "year", "pts", "code", "server_won", "by0", "by1", "hand0", "hand1")
    at = {"in_letter": (-1, 0), "d_in": (-1, 1), "depth": (-1, 2), "letter": (0, 0), "d_out": (0, 1)}
    o = s.select("match_id", "gender", "year", "pts", F.substring("code", 2, 1).alias("serve_direction"), _of("by", _I).alias("player"), _of("hand", _I).alias("hand"), (_I + 1).alias("idx"), ((_I % 2 == 0) == F.col("server_won")).cast("int").alias("won"), *[code_at(_I + j, place).alias(n) for n, (j, place) in at.items()])
    c = F.col
    o = o.where(c("letter").isin(*FOREHAND, *BACKHAND) & c("d_in").isin("1", "2", "3") & c("d_out").isin("1", "2", "3") & c("hand").isNotNull()).withColumn("wing", wing(c("letter")))
    fh, bh = F.when(c("hand") == "R", "1").otherwise("3"), F.when(c("hand") == "R", "3").otherwise("1")
    o = o.withColumn("ref", F.when(c("d_in") != "2", c("d_in")).when(c("wing") == "FH", fh).otherwise(bh))
    line = F.when(c("d_out") == c("ref"), "cc").when(c("d_out") == F.translate("ref", "13", "31"), "dtl").otherwise("mid")
    zone = F.when(c("d_in") == "2", "mid").when(c("d_in") == fh, "fh").otherwise("bh")
    kind = lambda n: stroke_kind(c(n), F.lit(False))
    return o.select("match_id", "gender", "year", "pts", "serve_direction", "player", "idx", F.nullif("depth", F.lit(".")).alias("depth"), "wing", "won", zone.alias("zone"), line.alias("line"), kind("in_letter").alias("kind"), kind("letter").alias("resp_kind"))


def player_counters(coded: DataFrame, keep: tuple[str, ...] = ("year",)) -> DataFrame:
    """Sums by player and ``keep`` of the counters of :func:`deucebase.operators.eras.counters` that styles and years take."""
    c = F.col
    p = coded.where("parse_ok AND svr IN (1, 2) AND pt_winner IN (1, 2) AND server_won IS NOT NULL")
    by = ["gender", *keep]
    flag = lambda b: b.cast("int")
    q = p.select(*by, "by0", "by1", "rally_len", "outcome", "serve_in_play", F.substring("code", 2, 1).alias("aim"), F.substring("code", CODE + 1, 1).alias("r"), F.substring("code", CODE + 3, 1).alias("deep"), F.substring("code", -CODE, 1).alias("last"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    serving, ending, n = _I == 0, (c("rally_len") + _I) % 2 == 1, c("rally_len")
    first, ret = serving & (c("serve_in_play") == 1), ~serving & (n >= 2)
    values = {
        "points": F.lit(1), "rally_len": n, "serve_pts": flag(serving), "serve1": flag(first), "sv4": flag(first & (c("aim") == "4")), "sv6": flag(first & (c("aim") == "6")), "aces": flag(serving & (c("outcome") == "ace")), "dfs": flag(serving & (c("outcome") == "double_fault")),
        "gs_winners": flag(ending & (c("outcome") == "winner") & c("last").isin(*KINDS["drive"], *KINDS["slice"])), "unforced": flag(ending & (c("outcome") == "unforced_error")),
        "returns": flag(ret), "ret_slice": flag(ret & c("r").isin(*KINDS["slice"])), "ret_depth": flag(ret & (c("deep") != ".")), "ret_deep": flag(ret & (c("deep") == "9")),
    }
    total = lambda df, v: df.groupBy(*by, _of("by", _I).alias("player")).agg(*[F.sum(x).alias(k) for k, x in v.items()])
    s = _strokes(p, 1, *by, "by0", "by1", "code")
    s = s.select(*by, "by0", "by1", "i", code_at(_I, 0).alias("x"), (code_at(_I, 4) != ".").alias("up"))
    ground = c("x").isin(*KINDS["drive"], *KINDS["slice"])
    strokes = {"rally": F.lit(1), "slice": flag(c("x").isin(*KINDS["slice"])), "net": flag(c("x").isin(*KINDS["net"]) | c("up")), "fh": flag(ground & c("x").isin(*FOREHAND)), "ground": flag(ground), "l_rally": flag(_I >= 2)}
    both = total(q, values).unionByName(total(s, strokes), allowMissingColumns=True)
    return both.groupBy(*by, "player").agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in (values | strokes)])
