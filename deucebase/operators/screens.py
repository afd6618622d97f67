"""Screens of contexts and responses: what raises a player's attempts, tested in folds, families and against the field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions import stats
from deucebase.functions.score import serve_side
from deucebase.operators.sequences import CELL

#: What counts as an attempt and what as one that paid, over sums w (winner), e (own error), f (error forced).
NUMERATORS = {"aggressive": ("w + e + f", "w + f"), "finishing": ("w + e", "w")}
WHO = ["gender", "player"]


def half(match_id: Column) -> Column:
    """Fold of a match: the low bit of its id's CRC-32."""
    return F.crc32(match_id.cast("binary")).bitwiseAND(F.lit(1)).cast("int")


def in_test(match_id: Column, per_mille: int = 200) -> Column:
    return F.crc32(match_id.cast("binary")) % 1000 < per_mille


def candidates(points: DataFrame, least: int = 10_000) -> DataFrame:
    """Players with enough valid points to be searched."""
    who = F.explode(F.array("player1", "player2")).alias("player")
    return points.where("svr IN (1, 2) AND pt_winner IN (1, 2)").select("gender", who).groupBy(*WHO).agg(F.count(F.lit(1)).alias("points")).where(F.col("points") >= least)


def strike_counts(toks: DataFrame, hands: DataFrame, depths: tuple[int, ...] = (2,)) -> DataFrame:
    """n, w, e, f per player, depth, context (a text of words in the striker's frame), fold, and whether the strokes
    before it touch the opening, by serve side. Every stroke of depth k counts once for every k; one pass."""
    least = min(depths)

    def one(i: Column) -> Column:
        s, nxt = F.get("shots", i), F.get("shots", i + 1)
        t = F.coalesce(s["terminal"], F.lit(""))
        return F.struct(
            F.when(s["hitter"] == 1, F.col("player1")).otherwise(F.col("player2")).alias("player"), i.alias("i"),
            (t == "*").cast("int").alias("w"), (t == "@").cast("int").alias("e"), F.coalesce(nxt["terminal"] == "#", F.lit(False)).cast("int").alias("f"),
        )

    s = toks.where(F.size("shots") > least).select("match_id", "gender", "pts", "toks", "mirrored", F.inline(F.transform(F.sequence(F.lit(least), F.size("shots") - 1), one)))
    s = s.join(hands.select(*WHO, "hand"), WHO, "left")
    own = F.when(F.coalesce(F.col("hand") == "L", F.lit(False)), F.col("mirrored")).otherwise(F.col("toks"))
    s = s.withColumn("seen", own).withColumn("k", F.explode(F.array(*[F.lit(k) for k in depths]))).where("i >= k")
    context = F.array_join(F.slice("seen", F.col("i") - F.col("k") + 1, F.col("k")), " ")
    side = serve_side(F.col("pts"))
    opening = F.when((F.col("i") <= F.col("k") + 3) & (side != "na"), side)
    return s.groupBy(*WHO, "k", context.alias("context"), half(F.col("match_id")).alias("half"), opening.alias("opening")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("w", "e", "f")])


def _pooled(counts: DataFrame, *by: str) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "w", "e", "f")])


def tagged_contexts(counts: DataFrame, numerator: str = "aggressive", min_n: int = 60, min_fold: int = 6, lift: float = 1.5, q: float = 0.10) -> DataFrame:
    """Contexts (of one depth) that raise a player's attempts in one half of the matches and again in the other, tagged
    green or trap by how they convert there.

    Each half discovers in turn: attempts over the player's own rate at least ``lift`` times, exact upper tail, adjusted
    over all contexts of the player that the half can test. The other half confirms: a lift above 1, enough attempts, and
    the tag from its conversion against its own mean over contexts of a lift. Halves that disagree drop out. The figures
    are those of the confirming half; of both together where both confirm."""
    att, win = (F.expr(x) for x in NUMERATORS[numerator])
    f = _pooled(counts, *WHO, "context", "half").select(*WHO, "context", "half", "n", att.alias("att"), win.alias("win"))
    own = Window.partitionBy(*WHO, "half")
    f = f.withColumn("base", F.sum("att").over(own) / F.sum("n").over(own))
    every = Window.partitionBy(*WHO, "context")
    f = f.withColumn("all_n", F.sum("n").over(every)).withColumn("all_att", F.sum("att").over(every)).withColumn("all_win", F.sum("win").over(every))
    all_base = F.sum("att").over(Window.partitionBy(*WHO)) / F.sum("n").over(Window.partitionBy(*WHO))
    f = f.withColumn("all_base", all_base).where(F.col("all_n") >= min_n)
    f = f.withColumn("rate", F.col("att") / F.col("n")).withColumn("lift", F.coalesce(F.try_divide("rate", "base"), F.lit(0.0)))
    mean = lambda c: F.sum(F.when((F.col("lift") >= lift) & (F.col("att") >= min_fold), F.col(c))).over(own)
    f = f.withColumn("mean_conv", F.try_divide(mean("win"), mean("att")))
    disc = stats.bh(f.where((F.col("att") >= min_fold) & (F.col("base") > 0)).withColumn("p", stats.binom_tail("att", "n", "base")), "p", [*WHO, "half"], ["context"])
    disc = disc.where((F.col("q") <= q) & (F.col("lift") >= lift)).select(*WHO, "context", (1 - F.col("half")).alias("half"))
    v = f.where((F.col("att") >= min_fold) & (F.col("lift") > 1) & F.col("mean_conv").isNotNull()).join(disc, [*WHO, "context", "half"])
    v = v.withColumn("green", F.col("win") / F.col("att") >= F.col("mean_conv"))
    g = v.groupBy(*WHO, "context").agg(
        F.count(F.lit(1)).alias("folds"), F.countDistinct("green").alias("kinds"), F.first("green").alias("green"), (F.sum(F.col("mean_conv") * F.col("att")) / F.sum("att")).alias("reference"),
        *[F.first(c).alias(c) for c in ("n", "att", "win", "lift", "all_n", "all_att", "all_win", "all_base")],
    ).where("kinds = 1")
    both = F.col("folds") == 2
    pick = lambda a, b: F.when(both, F.col(a)).otherwise(F.col(b))
    g = g.select(*WHO, "context", "folds", F.when(F.col("green"), "green").otherwise("trap").alias("tag"), "reference", pick("all_n", "n").alias("oos_n"), pick("all_att", "att").alias("oos_attempts"), pick("all_win", "win").alias("oos_won"), F.when(both, F.col("all_att") / F.col("all_n") / F.col("all_base")).otherwise(F.col("lift")).alias("lift"))
    return g.withColumn("rate", F.col("oos_attempts") / F.col("oos_n")).withColumn("conv", F.col("oos_won") / F.col("oos_attempts")).withColumn("conv_delta", F.col("conv") - F.col("reference")).drop("oos_won", "reference")


def context_spread(counts: DataFrame, min_n: int = 60, min_contexts: int = 20) -> DataFrame:
    """Per player: correlation of winner and error rates over contexts, and the sd of attempts between contexts beyond
    binomial noise (moments of a beta-binomial)."""
    t = _pooled(counts, *WHO, "context").where(F.col("n") >= min_n).withColumn("att", F.expr(NUMERATORS["aggressive"][0]))
    t = t.withColumn("p", F.sum("att").over(Window.partitionBy(*WHO)) / F.sum("n").over(Window.partitionBy(*WHO)))
    excess = F.sum(F.pow(F.col("att") - F.col("n") * F.col("p"), F.lit(2)) - F.col("n") * F.col("p") * (1 - F.col("p")))
    g = t.groupBy(*WHO).agg(F.count(F.lit(1)).alias("contexts"), stats.corr(F.col("w") / F.col("n"), F.col("e") / F.col("n")).alias("we_corr"), F.sqrt(F.greatest(F.try_divide(excess, F.sum(F.col("n") * (F.col("n") - 1))), F.lit(0.0))).alias("sigma"))
    return g.where(F.col("contexts") >= min_contexts)


def split_half(counts: DataFrame, min_half: int = 25) -> DataFrame:
    """(player, context, rate of attempts in either half) where both halves hold enough."""
    t = _pooled(counts, *WHO, "context", "half").withColumn("r", F.expr(NUMERATORS["aggressive"][0]) / F.col("n")).where(F.col("n") >= min_half)
    side = lambda h: F.max(F.when(F.col("half") == h, F.col("r")))
    return t.groupBy(*WHO, "context").agg(side(0).alias("r0"), side(1).alias("r1")).where("r0 IS NOT NULL AND r1 IS NOT NULL")


def gold_patterns(counts: DataFrame, numerator: str = "aggressive", min_n: int = 60, min_att: int = 12, lift: float = 1.3, p_max: float = 0.005, half_n: int = 15, q: float = 0.10) -> DataFrame:
    """Every tested (player, depth, context) of depth 3 on with the gate it failed, ``gate`` null for gold.

    A context is held against its own tail (one stroke shorter): support, a parent with attempts, the lift, the exact
    tail, each half above the parent's rate, and last the adjusted tail over all of the player's tested contexts."""
    att, win = (F.expr(x) for x in NUMERATORS[numerator])
    h = lambda c, k: F.coalesce(F.sum(F.when(F.col("half") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    t = counts.withColumn("att", att).withColumn("win", win).groupBy(*WHO, "k", "context").agg(F.sum("n").alias("n"), F.sum("att").alias("att"), F.sum("win").alias("win"), *[h(c, k) for c in ("n", "att") for k in (0, 1)])
    child = t.where((F.col("k") > 2) & (F.col("n") >= min_n) & (F.col("att") >= min_att)).withColumn("parent", F.regexp_replace("context", r"^\S+ ", "")).withColumn("up", F.col("k") - 1)
    parent = t.select(*WHO, F.col("k").alias("up"), F.col("context").alias("parent"), (F.col("att") / F.col("n")).alias("parent_rate"), F.try_divide("win", "att").alias("parent_conv")).where("parent_rate > 0")
    j = child.join(parent, [*WHO, "up", "parent"]).withColumn("p", stats.binom_tail("att", "n", "parent_rate"))
    j = stats.bh(j, "p", WHO, ["k", "context"]).withColumn("tested", F.count(F.lit(1)).over(Window.partitionBy(*WHO)))
    above = lambda k: (F.col(f"n{k}") >= half_n) & (F.try_divide(F.col(f"att{k}"), F.col(f"n{k}")) > F.col("parent_rate"))
    gate = F.when(F.col("att") / F.col("n") < lift * F.col("parent_rate"), "lift").when(F.col("p") >= p_max, "binomial").when(~F.coalesce(above(0) & above(1), F.lit(False)), "replication").when(F.col("q") > q, "fdr")
    conv = F.col("win") / F.col("att")
    return j.select(*WHO, "k", "context", "parent", "n", "att", (F.col("att") / F.col("n")).alias("att_rate"), "parent_rate", conv.alias("conv"), "parent_conv", "p", "q", "tested", gate.alias("gate"), F.when(conv >= F.col("parent_conv"), "green").otherwise("trap").alias("tag"))


def numerator_comparison(wide: DataFrame, narrow: DataFrame) -> DataFrame:
    """How the gold of two numerators overlaps: both, or which gate the other one failed (absent: not tested there)."""
    key = [*WHO, "k", "context"]
    a = wide.select(*key, F.coalesce("gate", F.lit("gold")).alias("wide"), F.col("tag").alias("wide_tag"))
    b = narrow.select(*key, F.coalesce("gate", F.lit("gold")).alias("narrow"), F.col("tag").alias("narrow_tag"))
    j = a.join(b, key, "full").withColumn("wide", F.coalesce("wide", F.lit("absent"))).withColumn("narrow", F.coalesce("narrow", F.lit("absent")))
    j = j.where("wide = 'gold' OR narrow = 'gold'")
    return j.groupBy("wide", "narrow").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wide_tag") != F.col("narrow_tag")).alias("flips"))


def side_heterogeneity(rows: DataFrame, counts: DataFrame, least: int = 15, least_att: int = 6) -> DataFrame:
    """Attempts and conversion of patterns by serve side where they touch the opening: Fisher's exact test each, Holm over
    all tests together."""
    t = counts.where("opening IS NOT NULL").withColumn("att", F.expr(NUMERATORS["aggressive"][0])).withColumn("win", F.expr(NUMERATORS["aggressive"][1]))
    s = lambda c, side: F.coalesce(F.sum(F.when(F.col("opening") == side, F.col(c))), F.lit(0)).alias(f"{c}_{side}")
    t = t.groupBy(*WHO, "k", "context").agg(*[s(c, side) for c in ("n", "att", "win") for side in ("deuce", "ad")])
    j = rows.select(*WHO, "k", "context").join(t, [*WHO, "k", "context"])
    table = lambda name, whole, part, low: F.when((F.col(f"{low}_deuce") >= (least if low == "n" else least_att)) & (F.col(f"{low}_ad") >= (least if low == "n" else least_att)), F.struct(F.lit(name).alias("test"), F.col(f"{part}_deuce").alias("a"), (F.col(f"{whole}_deuce") - F.col(f"{part}_deuce")).alias("b"), F.col(f"{part}_ad").alias("c"), (F.col(f"{whole}_ad") - F.col(f"{part}_ad")).alias("d")))
    tests = j.select(*WHO, "k", "context", F.inline(F.filter(F.array(table("att", "n", "att", "n"), table("conv", "att", "win", "att")), lambda x: x.isNotNull())))
    tests = tests.withColumn("p", stats.fisher_two_sided("a", "b", "c", "d")).withColumn("all", F.lit(1))
    return stats.holm(tests, "p", ["all"], [*WHO, "k", "context", "test"], "p_holm").drop("all")


def fold_cells(obs: DataFrame, by: list[str]) -> DataFrame:
    """Responses per player, fold and columns ``by``: n and won."""
    return obs.groupBy(*WHO, *by, half(F.col("match_id")).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))


def _standing(cells: DataFrame, state: list[str], resp: list[str]) -> DataFrame:
    """Cells (two halves wide) with the player's and the field's totals in the state; the field leaves the player out."""
    h = lambda c, k: F.coalesce(F.sum(F.when(F.col("half") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    t = cells.groupBy(*WHO, *state, *resp).agg(h("n", 0), h("n", 1), F.sum("n").alias("c"), F.sum("won").alias("wins"))
    w = lambda c, *by: F.sum(c).over(Window.partitionBy("gender", *by))
    t = t.withColumns({"n_state": w("c", "player", *state), "n0_state": w("n0", "player", *state), "n1_state": w("n1", "player", *state), "won_state": w("wins", "player", *state)})
    return t.withColumns({"bn": w("c", *state) - F.col("n_state"), "bf": w("c", *state, *resp) - F.col("c"), "b_won": w("wins", *state) - F.col("won_state"), "bf_won": w("wins", *state, *resp) - F.col("wins")})


def _surfaced(t: DataFrame, k: float, lift: float, half_lift: float, half_min: int, k_conv: float) -> DataFrame:
    """Shrunk lift over ``p_field``, the halves' own lifts, evidence, conversion against the field and against the player."""
    l = lambda h: F.try_divide(F.col(f"n{h}"), F.col(f"n{h}_state")) / F.col("p_field")  # noqa: E731, E741
    t = t.withColumn("lift", (F.col("c") + k * F.col("p_field")) / (F.col("n_state") + k) / F.col("p_field"))
    good = (F.col("lift") >= lift) & (F.least("n0", "n1") >= half_min) & F.coalesce(F.least(l(0), l(1)) >= half_lift, F.lit(False))
    p_state = F.col("b_won") / F.col("bn")
    return t.withColumns({"surfaces": good, "evidence": F.col("c") * F.log2("lift"), "conv": (F.col("wins") + k_conv * F.col("fconv")) / (F.col("c") + k_conv), "sconv": (F.col("won_state") + k_conv * p_state) / (F.col("n_state") + k_conv)})


STATE, RESP = CELL[:4], CELL[4:]


def era(year: Column) -> Column:
    """Decade bucket; an unknown year counts as the first."""
    y = F.coalesce(year, F.lit(0))
    return F.when(y < 2000, "pre-2000").when(y < 2010, "2000s").otherwise("2010+")


def with_family(obs: DataFrame) -> DataFrame:
    """Observations in their families: every one is a rally answer; a server's third stroke with a known return depth is
    an answer to the return too."""
    rally, ret = F.struct(F.lit("rally").alias("family"), F.lit("").alias("state_depth")), F.struct(F.lit("ret").alias("family"), F.col("depth").alias("state_depth"))
    return obs.select("*", F.inline(F.when((F.col("idx") == 3) & F.col("depth").isNotNull(), F.array(rally, ret)).otherwise(F.array(rally))))


def era_cells(obs: DataFrame) -> DataFrame:
    """Responses of both families per player, era and fold: n and won."""
    o = with_family(obs).withColumn("era", era(F.col("year")))
    return o.groupBy(*WHO, *CELL, "era", half(F.col("match_id")).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))


def court_profile(cells: DataFrame, min_state: int = 80, min_cell: int = 10, min_field: int = 500, min_field_era: int = 200, cover: float = 0.6, min_bf: int = 20, lift: float = 1.4, half_lift: float = 1.15, half_min: int = 4, k: float = 30.0, k_conv: float = 20.0, rally: int = 3, ret: int = 2) -> DataFrame:
    """A player's unusual answers, best evidence first: ``rally`` of the rally family and ``ret`` of the return family.
    ``cells``: rows of :func:`era_cells`, read several times.

    The field's share of a response leaves the player out and is weighted by the player's own eras where eras that hold
    enough cover ``cover`` of the player's balls; else it is the pooled share."""
    t = _standing(cells, STATE, RESP).withColumn("p_field", F.col("bf") / F.col("bn")).withColumn("fconv", F.try_divide("bf_won", "bf"))
    t = t.where((F.col("n_state") >= min_state) & (F.col("bn") >= min_field) & (F.col("c") >= min_cell) & (F.col("bf") >= min_bf))
    # By era: what the field answers, for every (player, state, era) and every response of the player in any era.
    mine = cells.groupBy(*WHO, *STATE, "era").agg(F.sum("n").alias("n_e"))
    field = cells.groupBy("gender", *STATE, "era").agg(F.sum("n").alias("f_e"))
    answers = cells.groupBy("gender", *CELL, "era").agg(F.sum("n").alias("fr_e"), F.sum("won").alias("fw_e"))
    own = cells.groupBy(*WHO, *CELL, "era").agg(F.sum("n").alias("c_e"), F.sum("won").alias("w_e"))
    e = t.select(*WHO, *CELL).join(mine, [*WHO, *STATE]).join(field, ["gender", *STATE, "era"]).where(F.col("f_e") - F.col("n_e") >= min_field_era)
    e = e.join(answers, ["gender", *CELL, "era"], "left").join(own, [*WHO, *CELL, "era"], "left")
    bf = F.coalesce("fr_e", F.lit(0)) - F.coalesce("c_e", F.lit(0))
    bw = F.coalesce("fw_e", F.lit(0)) - F.coalesce("w_e", F.lit(0))
    n = F.col("n_e")
    e = e.groupBy(*WHO, *CELL).agg((F.sum(n * bf / (F.col("f_e") - n)) / F.sum(n)).alias("e_share"), F.try_divide(F.sum(F.when(bf > 0, n * bw / bf)), F.sum(F.when(bf > 0, n))).alias("e_conv"), F.sum(n).alias("covered"))
    t = t.join(e, [*WHO, *CELL], "left")
    use = F.coalesce((F.col("e_share") > 0) & (F.col("covered") >= cover * F.col("n_state")), F.lit(False))
    t = t.withColumn("fconv", F.when(use, F.coalesce("e_conv", "fconv")).otherwise(F.col("fconv"))).withColumn("p_field", F.when(use, F.col("e_share")).otherwise(F.col("p_field")))
    t = _surfaced(t, k, lift, half_lift, half_min, k_conv).where("surfaces")
    w = Window.partitionBy(*WHO, "family").orderBy(F.desc("evidence"), F.desc("lift"), *CELL)
    t = t.withColumn("place", F.row_number().over(w)).where(F.when(F.col("family") == "rally", F.col("place") <= rally).otherwise(F.col("place") <= ret))
    return t.select(*WHO, *CELL, F.col("c").alias("n"), "n_state", "p_field", "lift", "evidence", "conv", "fconv", "sconv", "place")


PLUS_STATE = ["court", "serve_direction", "kind", "zone", "depth"]
PLUS_RESP = ["wing", "resp_kind", "line"]
TIERS = ("full", "side", "pooled")


def plus_one_cells(obs: DataFrame) -> DataFrame:
    """The server's third stroke per fold at three resolutions (GROUPING SETS over pre-summed rows)."""
    o = obs.where((F.col("idx") == 3) & F.col("depth").isNotNull()).withColumn("court", serve_side(F.col("pts"))).where("court <> 'na'")
    s = fold_cells(o, [*PLUS_STATE, *PLUS_RESP])
    keys = [*WHO, "half", *PLUS_STATE[2:], *PLUS_RESP]
    sets = [[F.col(c) for c in (*keys, *own)] for own in (PLUS_STATE[:2], PLUS_STATE[:1], [])]
    tier = F.when(F.grouping("serve_direction") == 0, "full").when(F.grouping("court") == 0, "side").otherwise("pooled")
    t = s.groupingSets(sets, *[F.col(c) for c in (*keys, *PLUS_STATE[:2])]).agg(tier.alias("tier"), F.sum("n").alias("n"), F.sum("won").alias("won"))
    return t.where("tier <> 'full' OR serve_direction IN ('4', '5', '6')").fillna("", PLUS_STATE[:2])


def assigned_tier(cells: DataFrame, min_state: int = 80, min_states: int = 4) -> DataFrame:
    """The finest resolution in which a player has met enough situations often enough, whatever they answered."""
    s = cells.groupBy(*WHO, "tier", *PLUS_STATE).agg(F.sum("n").alias("n")).groupBy(*WHO, "tier").agg(F.count_if(F.col("n") >= min_state).alias("states"))
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))
    best = F.min(F.when(F.col("states") >= min_states, rank))
    return s.groupBy(*WHO).agg(F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.coalesce(best, F.lit(len(TIERS))).cast("int")).alias("tier"))


def plus_one_profile(cells: DataFrame, min_state: int = 80, min_states: int = 4, min_cell: int = 10, min_field: int = 500, min_bf: int = 20, lift: float = 1.4, half_lift: float = 1.15, half_min: int = 4, k: float = 30.0, k_conv: float = 20.0, q: float = 0.10, top: int = 2) -> DataFrame:
    """The ``top`` unusual third strokes of each player at the assigned tier; exact tail against the field, adjusted over
    all cells of the player that have a field."""
    t = cells.join(assigned_tier(cells, min_state, min_states), [*WHO, "tier"])
    # the field is everyone at that tier, whoever is assigned to it
    s = _standing(cells, ["tier", *PLUS_STATE], PLUS_RESP).join(t.select(*WHO, "tier").distinct(), [*WHO, "tier"])
    s = s.where((F.col("n_state") >= min_state) & (F.col("bn") >= min_field) & (F.col("c") >= min_cell) & (F.col("bf") >= min_bf))
    s = s.withColumn("p_field", F.col("bf") / F.col("bn")).withColumn("fconv", F.try_divide("bf_won", "bf"))
    s = stats.bh(s.withColumn("p", stats.binom_tail("c", "n_state", "p_field")), "p", WHO, [*PLUS_STATE, *PLUS_RESP])
    s = _surfaced(s, k, lift, half_lift, half_min, k_conv).where(F.col("surfaces") & (F.col("q") <= q))
    w = Window.partitionBy(*WHO).orderBy(F.desc("evidence"), F.desc("lift"), *PLUS_STATE, *PLUS_RESP)
    return s.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select(*WHO, "tier", *PLUS_STATE, *PLUS_RESP, F.col("c").alias("n"), "n_state", "p_field", "lift", "conv", "fconv", "sconv", "p", "q", "place")


def side_flips(cells: DataFrame, min_state: int = 80) -> DataFrame:
    """Situations in which a player's first choice differs between the deuce and the ad court."""
    s = cells.where("tier = 'side'").groupBy(*WHO, *PLUS_STATE[2:], "court", *PLUS_RESP).agg(F.sum("n").alias("n"))
    resp = F.concat_ws(" ", *PLUS_RESP)
    m = s.groupBy(*WHO, *PLUS_STATE[2:], "court").agg(F.sum("n").alias("total"), F.max(F.struct(F.col("n"), resp.alias("resp"))).alias("m")).where(F.col("total") >= min_state)
    side = lambda c, name: F.max(F.when(F.col("court") == c, F.col(name)))
    g = m.groupBy(*WHO, *PLUS_STATE[2:]).agg(side("deuce", "m.resp").alias("deuce"), side("ad", "m.resp").alias("ad"), side("deuce", "total").alias("n_deuce"), side("ad", "total").alias("n_ad"))
    return g.where("deuce <> ad")


def cell_stability(cells: DataFrame, state: list[str], resp: list[str], min_half: int = 40, min_total: int = 10, min_field: int = 500, min_bf: int = 20, k: float = 15.0) -> DataFrame:
    """By gender: correlation between the halves' shrunk log-lifts over all well-filled cells."""
    t = _standing(cells, state, resp).where((F.least("n0_state", "n1_state") >= min_half) & (F.col("bn") >= min_field) & (F.col("c") >= min_total) & (F.col("bf") >= min_bf))
    p = F.col("bf") / F.col("bn")
    side = lambda h: F.log2((F.col(f"n{h}") + k * p) / (F.col(f"n{h}_state") + k) / p)
    return t.withColumn("x", side(0)).withColumn("y", side(1)).groupBy("gender").agg(F.count(F.lit(1)).alias("cells"), stats.corr(F.col("x"), F.col("y")).alias("r"))


# Words for codes.
_BALL = {"drive": "drive", "slice": "slice", "net": "net ball", "other": "drop/lob"}
_ANSWER = {"drive": "drive", "slice": "slice", "net": "net shot", "other": "drop/lob"}
_ZONE = {"fh": "the FH corner", "mid": "the middle", "bh": "the BH corner"}
_DEPTH = {"7": "short", "8": "mid-depth", "9": "deep"}
_COURT = {"deuce": "deuce court", "ad": "ad court"}
_SERVE = {"4": "wide serve", "5": "body serve", "6": "T serve"}


def _word(c: Column, words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in words.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def state_name(kind: Column, zone: Column, depth: Column, court: Column | None = None, direction: Column | None = None) -> Column:
    """A situation in words: the ball, where it goes, and what of depth, court and serve is known."""
    ball = F.concat_ws(" ", _word(depth, _DEPTH), _word(kind, _BALL), F.when(_word(depth, _DEPTH).isNotNull(), "return"), F.lit("into"), _word(zone, _ZONE))
    if court is None:
        return ball
    where = F.concat_ws(", ", _word(court, _COURT), _word(direction, _SERVE))
    return F.when(where == "", ball).otherwise(F.concat(where, F.lit(" · "), ball))


def resp_name(zone: Column, wing: Column, kind: Column, line: Column) -> Column:
    stroke = F.concat_ws(" ", wing, _word(kind, _ANSWER))
    around = zone.isin("fh", "bh") & (zone != F.lower(wing)) & kind.isin("drive", "slice")
    return (
        F.when(line == "mid", F.concat(stroke, F.lit(" through the middle"))).when(around, F.concat(F.when(line == "cc", "inside-out ").otherwise("inside-in "), stroke))
        .when(line == "cc", F.concat(F.lit("crosscourt "), stroke)).otherwise(F.concat(stroke, F.lit(" down the line")))
    )


def physical_codes(zone: Column, wing: Column, line: Column, hand: Column) -> tuple[Column, Column]:
    """Thirds of the court, by a right-hander's naming, of the ball that came and of the answer."""
    right = hand == "R"
    incoming = F.when(zone == "mid", "2").when((zone == "fh") == right, "1").otherwise("3")
    lane = F.when((wing == "FH") == right, "1").otherwise("3")
    ref = F.when(incoming != "2", incoming).otherwise(lane)
    return incoming, F.when(line == "cc", ref).when(line == "dtl", F.translate(ref, "13", "31")).otherwise("2")


def backoff_eval(counts: DataFrame, kappa: float = 20.0) -> DataFrame:
    """Per longest context: loss a stroke of attempts in half 1, predicted from half 0 by rates of ever longer contexts,
    each shrunk by ``kappa`` strokes to the one before. ``counts``: one row per player, depth k, context and half, in which
    a stroke counts at every depth it has."""
    t = _pooled(counts, *WHO, "k", "context", "half").withColumn("att", F.expr(NUMERATORS["aggressive"][0]))
    depths = sorted(r[0] for r in t.select("k").distinct().collect())  # a handful of lengths
    train = t.where("half = 0")
    base = train.where(F.col("k") == depths[0]).groupBy(*WHO).agg((F.sum("att") / F.sum("n")).alias("p0"))
    out = None
    for top in depths:
        cur = t.where((F.col("half") == 1) & (F.col("k") == top)).join(base, WHO).withColumn("p", F.col("p0"))
        for k in [d for d in depths if d <= top]:
            level = train.where(F.col("k") == k).select(*WHO, F.col("context").alias("c"), F.col("n").alias("tn"), F.col("att").alias("ta"))
            cur = cur.withColumn("c", F.array_join(F.slice(F.split("context", " "), -k, k), " ")).join(level, [*WHO, "c"], "left")
            cur = cur.withColumn("p", (F.coalesce("ta", F.lit(0)) + kappa * F.col("p")) / (F.coalesce("tn", F.lit(0)) + kappa)).drop("c", "tn", "ta")
        q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
        one = cur.groupBy("gender").agg(F.sum("n").alias("n"), (F.sum(-(F.col("att") * F.log(q) + (F.col("n") - F.col("att")) * F.log(1 - q))) / F.sum("n")).alias("log_loss")).withColumn("k", F.lit(top))
        out = one if out is None else out.unionByName(one)
    return out
