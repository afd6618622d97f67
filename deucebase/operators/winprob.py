"""Point-level win probability: backoff tables by ROLLUP, values by a fold, win probability added per stroke."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions.notation import decoded, other_player, stroke_kind
from deucebase.functions.score import lead, pressure, serve_side

FEATURES = ["sip", "ply", "to_hit", "wing", "kind", "direction", "approach", "depth"]
K = 50.0


def positions(points: DataFrame, cap: int = 12, keep: tuple[str, ...] = ("match_id", "pt", "gender", "player1", "player2")) -> DataFrame:
    """One row per stroke of a readable point, with the state after it (general to specific) and whether it was the last."""
    d = decoded(points).where("parse_ok AND server_won IS NOT NULL AND rally_len > 0")
    d = d.select(*keep, "server", "server_won", "serve_in_play", "rally_len", F.explode("shots").alias("s"))
    s = F.col("s")
    return d.select(
        *keep, "server_won", s["idx"].alias("idx"), s["hitter"].alias("hitter"), s["stroke"].alias("stroke"), s["side"].alias("side"), s["terminal"].alias("terminal"), (s["hitter"] == F.col("server")).alias("by_server"),
        (s["idx"] == F.col("rally_len")).alias("is_last"), F.col("serve_in_play").alias("sip"), F.least(s["idx"], F.lit(cap)).alias("ply"), F.when(other_player(s["hitter"]) == F.col("server"), "S").otherwise("R").alias("to_hit"),
        F.when(s["is_serve"], "SV").when(s["side"] == "", "XX").otherwise(s["side"]).alias("wing"), stroke_kind(s["letter"], s["is_serve"]).alias("kind"), F.coalesce(s["direction"], F.lit("?")).alias("direction"),
        s["modifiers"].rlike(r"[+\-]").cast("int").alias("approach"), F.coalesce(s["depth"], F.lit("-")).alias("depth"),
    )


TAGS = ["pressure", "court", "lead"]


def tagged(pos: DataFrame, points: DataFrame) -> DataFrame:
    """``pos`` with the score's tags of its point, from the server's side."""
    c = F.col
    first = c("svr") == 1
    own = lambda a, b: F.when(first, c(a)).otherwise(c(b))
    p = points.select("match_id", "pt", pressure(c("pts"), c("gm1"), c("gm2")).alias("pressure"), serve_side(c("pts")).alias("court"), lead(own("gm1", "gm2"), own("gm2", "gm1"), own("set1", "set2"), own("set2", "set1")).alias("lead"))
    return pos.join(p, ["match_id", "pt"])


def state_table(pos: DataFrame, test: Column, extra: list[str] | None = None) -> DataFrame:
    """n and w per full state, tags included, of the training and the test matches; ``is_last`` rows count points. All
    levels, ablations and losses are sums of this one small table."""
    return pos.groupBy(test.alias("test"), "is_last", *FEATURES, *(extra or [])).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("server_won").cast("int")).alias("w"))


def state_losses(states: DataFrame, features: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Held-out log-loss and Brier score of a model on ``features`` (sip first), from :func:`state_table`."""
    train = states.where("NOT test")
    b = train.where("is_last").groupBy("sip").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    whole = Window.partitionBy()  # two rows
    b = b.select("sip", ((F.col("w") + K * F.sum("w").over(whole) / F.sum("n").over(whole)) / (F.col("n") + K)).alias("p"))
    t = train.where("NOT is_last").groupBy(*features).agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    out = states.where("test AND NOT is_last").groupBy(*dict.fromkeys([*features, *by])).agg(F.sum("n").alias("n_t"), F.sum("w").alias("w_t")).join(F.broadcast(b), "sip")
    for k in range(2, len(features) + 1):
        level = t.groupBy(*features[:k]).agg(F.sum("n").alias("ln"), F.sum("w").alias("lw"))
        out = out.join(level, features[:k], "left").withColumn("p", F.when(F.col("ln").isNull(), F.col("p")).otherwise((F.col("lw") + K * F.col("p")) / (F.col("ln") + K))).drop("ln", "lw")
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    n, w = F.col("n_t"), F.col("w_t")
    return out.groupBy(*by).agg(F.sum(n).alias("n"), (F.sum(-(w * F.log(q) + (n - w) * F.log(1 - q))) / F.sum(n)).alias("log_loss"), (F.sum(w * (q - 1) * (q - 1) + (n - w) * q * q) / F.sum(n)).alias("brier"))


def coarse(tags: list[str]) -> list[str]:
    """Tags as a conditioner of all that follows the first three features."""
    return [*FEATURES[:3], *tags, *FEATURES[3:]]


def fine(tags: list[str]) -> list[str]:
    """Tags that only refine the full state."""
    return [*FEATURES, *tags]


def demo_points(wpa: DataFrame, worst: float = -0.25, top: int = 5) -> DataFrame:
    """The longest rallies that hold a stroke as bad as ``worst``: the report's limit."""
    g = wpa.groupBy("match_id", "pt").agg(F.count(F.lit(1)).alias("strokes"), F.min("wpa").alias("worst"))
    return g.where(F.col("worst") <= worst).orderBy(F.desc("strokes"), "worst", "match_id", "pt").limit(top)


def state_counts(pos: DataFrame, features: list[str]) -> DataFrame:
    """n and server wins per full state, non-terminal positions only: what all levels are summed from."""
    return pos.where("NOT is_last").groupBy(*features).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("server_won").cast("int")).alias("w"))


def backoff_table(pos: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Counts of every prefix of the features, two at least. ROLLUP expands the states, not the positions."""
    g = F.grouping_id(*features)
    level = sum((g.bitwiseAND(F.lit(1 << (len(features) - 1 - i))) == 0).cast("int") for i in range(len(features)))
    t = state_counts(pos, features).rollup(*features).agg(F.sum("n").alias("n"), F.sum("w").alias("w"), level.alias("level"))
    return t.where("level >= 2")


def bases(pos: DataFrame) -> DataFrame:
    """Value before the serve per serve in play, shrunk to the whole; counts points, not positions."""
    p = pos.where("is_last").groupBy("sip").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("server_won").cast("int")).alias("w"))
    all_ = Window.partitionBy()
    g = F.sum("w").over(all_) / F.sum("n").over(all_)  # two rows
    return p.select("sip", ((F.col("w") + K * g) / (F.col("n") + K)).alias("base"))


def state_values(pos: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Value of every seen state: est_k = (w_k + K est_(k-1)) / (n_k + K) from the base down the prefixes.

    Sums per prefix are windows over the table of states, whose size is bounded by the features' values."""
    t = state_counts(pos, features).join(F.broadcast(bases(pos)), "sip")
    est: Column = F.col("base")
    for k in range(2, len(features) + 1):
        w = Window.partitionBy(*features[:k])
        t = t.withColumns({f"n{k}": F.sum("n").over(w), f"w{k}": F.sum("w").over(w)})
        est = (F.col(f"w{k}") + K * est) / (F.col(f"n{k}") + K)
    return t.select(*features, "base", est.alias("value"))


def shot_wpa(pos: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Per stroke: value before and after, server_delta and wpa (from the hitter's side). Deltas of a point add up to
    its result less the base."""
    v = state_values(pos, features).drop("base")
    j = pos.join(v, features, "left").join(F.broadcast(bases(pos)), "sip")
    after = F.when(F.col("is_last"), F.col("server_won").cast("double")).otherwise(F.col("value"))
    w = Window.partitionBy("match_id", "pt").orderBy("idx")
    j = j.withColumn("v_after", after).withColumn("v_before", F.coalesce(F.lag("v_after").over(w), F.col("base")))
    j = j.withColumn("server_delta", F.col("v_after") - F.col("v_before"))
    return j.withColumn("wpa", F.when(F.col("by_server"), F.col("server_delta")).otherwise(-F.col("server_delta")))


def annotate(wpa: Column) -> Column:
    return F.when(wpa <= -0.25, "??").when(wpa <= -0.12, "?").when(wpa <= -0.06, "?!").when(wpa >= 0.20, "!").otherwise("")


def player_quality(wpa: DataFrame, min_shots: int = 200) -> DataFrame:
    """Per player: value gained and conceded per stroke, winners, unforced errors, accuracy."""
    p = wpa.withColumn("player", F.when(F.col("hitter") == 1, F.col("player1")).otherwise(F.col("player2")))
    n = F.count(F.lit(1))
    g = p.groupBy("gender", "player").agg(
        n.alias("n_shots"), (F.sum(F.greatest("wpa", F.lit(0.0))) / n).alias("gained"), (F.sum(F.greatest(-F.col("wpa"), F.lit(0.0))) / n).alias("conceded"),
        (F.count_if(F.col("terminal") == "*") / n).alias("winner_rate"), (F.count_if(F.col("terminal") == "@") / n).alias("unforced_rate"),
    )
    return g.where(F.col("n_shots") >= min_shots).withColumn("accuracy", 100 * F.exp(-6 * F.col("conceded")))


def explore(pos: DataFrame, features: list[str] = FEATURES, level: int = 6) -> DataFrame:
    """For each state prefix: the strokes that follow, how often, and how often the server won."""
    w = Window.partitionBy("match_id", "pt").orderBy("idx")
    p = pos.withColumn("next_wing", F.lead("wing").over(w)).withColumn("next_dir", F.lead("direction").over(w)).where("NOT is_last")
    return p.groupBy(*features[:level], "next_wing", "next_dir").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("server_won").cast("double")).alias("server_win"))


def calibration(scored: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate"))


def losses(scored: DataFrame, p: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Log-loss and Brier score; predictions are kept 1e-6 from 0 and 1."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    t = F.col(y).cast("double")
    return scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(-(t * F.log(q) + (1 - t) * F.log(1 - q))).alias("log_loss"), F.avg((q - t) * (q - t)).alias("brier"))


def held_out_values(train: DataFrame, test: DataFrame, features: list[str] = FEATURES) -> DataFrame:
    """Test positions with the value that the training positions give their state, backing off to the longest seen prefix."""
    t = state_counts(train, features)
    est: Column = F.col("base")
    out = test.where("NOT is_last").join(F.broadcast(bases(train)), "sip")
    for k in range(2, len(features) + 1):
        level = t.groupBy(*features[:k]).agg(F.sum("n").alias(f"n{k}"), F.sum("w").alias(f"w{k}"))
        out = out.join(level, features[:k], "left")
        est = F.when(F.col(f"n{k}").isNull(), est).otherwise((F.col(f"w{k}") + K * est) / (F.col(f"n{k}") + K))
        out = out.withColumn(f"e{k}", est)
        est = F.col(f"e{k}")
    return out.withColumn("p", est)
