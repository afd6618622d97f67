"""Tables that a site reads: facts, summaries, years, triggers, patterns, serves, identities; reports in Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions.naming import classify_tier, normalize_name, tourn_key
from deucebase.functions.notation import aggressive, pretty_context
from deucebase.functions.score import serve_side
from deucebase.operators import coverage

WHO = ["gender", "player"]
ANCHORS = {1: "return", 2: "serve+1", 3: "return+1"}


def player_facts(matches: DataFrame, counts: DataFrame, least: int = 200) -> DataFrame:
    """Modal hand and ace rate per player; either may be missing."""
    aces = counts.groupBy(*WHO).agg(F.sum("aces").alias("a"), F.sum("serve_pts").alias("n")).where(F.col("n") >= least).select(*WHO, (F.col("a") / F.col("n")).alias("ace_rate"))
    return coverage.modal_hand(matches).select(*WHO, "hand").join(aces, WHO, "full")


def charted_matches(matches: DataFrame, since: int) -> DataFrame:
    """Identities of the main draws of the upper two levels, with names as keys."""
    tier = classify_tier(F.col("tournament"), F.col("gender"))
    q = F.coalesce(F.col("round").startswith("Q") & (F.col("round") != "QF"), F.lit(False))
    m = matches.where((F.col("year") >= since) & ~q & tier.isin("Grand Slam", "Masters / WTA 1000"))
    return m.select("gender", "year", tourn_key(F.col("tournament"), normalize_name("tournament")).alias("tourn_key"), normalize_name("player1").alias("p1_norm"), normalize_name("player2").alias("p2_norm"), "match_id", "charted_by")


def archetype(z) -> Column:
    """A neutral name for a cluster from its centre's z-scores, by ordered rules. ``z``: feature name to Column."""
    return (
        F.when((z("net_pct") > 1) & (z("slice_pct") > 1.5), "Slice & net specialist").when(z("net_pct") > 1, "Net-rusher / serve-volleyer")
        .when((z("slice_pct") > 1) | (z("return_slice") > 1), "Slice & variety").when((z("avg_rally_len") > 0.4) & (z("ace_rate") < 0), "Baseline grinder / counterpuncher")
        .when((z("gs_winner_rate") > 0.4) & (z("avg_rally_len") < 0), "Big serve / first-strike").when((z("ace_rate") > 0.2) | (z("serve_t") > 0.3), "Big-serving baseliner").otherwise("Baseline all-rounder")
    )


def named_clusters(standardized: DataFrame, clusters: DataFrame, features: list[str]) -> DataFrame:
    """Players with their cluster's name."""
    j = standardized.join(clusters.select(*WHO, "cluster"), WHO)
    centre = j.groupBy("gender", "cluster").agg(*[F.avg(f).alias(f) for f in features]).select("gender", "cluster", archetype(F.col).alias("archetype"))
    return clusters.join(centre, ["gender", "cluster"])


def top_per_player(rows: DataFrame, order: list[Column], top: int = 3) -> DataFrame:
    w = Window.partitionBy(*WHO).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top).drop("_rn")


def triggers(tagged: DataFrame, deep: DataFrame, top: int = 3) -> DataFrame:
    """Each player's strongest green lights, worst traps and deep patterns as one table."""
    cols = [*WHO, "tag", "context", F.col("rate").alias("att_rate"), F.col("lift").alias("att_lift"), F.col("conv").alias("conversion"), "conv_delta", F.col("oos_n").alias("n"), F.col("oos_attempts").alias("attempts")]
    green = top_per_player(tagged.where("tag = 'green'"), [F.desc("lift"), F.asc("context")], top)
    trap = top_per_player(tagged.where("tag = 'trap'"), [F.asc("conv_delta"), F.asc("context")], top)
    t = green.unionByName(trap).select(*cols).withColumn("depth", F.lit(2))
    g = deep.where("gate IS NULL").withColumn("att_lift", F.col("att_rate") / F.col("parent_rate"))
    g = top_per_player(g, [F.desc("att_lift"), F.asc("context")], top).select(*WHO, "tag", "context", "att_rate", "att_lift", F.col("conv").alias("conversion"), (F.col("conv") - F.col("parent_conv")).alias("conv_delta"), "n", F.col("att").alias("attempts"), F.col("k").cast("int").alias("depth"))
    return t.unionByName(g).withColumn("context", pretty_context(F.col("context")))


def patterns(court: DataFrame, plus: DataFrame | None) -> DataFrame:
    """Rally answers from the court profile, answers to the return from the third strokes; from the court profile too where
    those are not there. Missing codes are empty."""
    rally = court.where("family = 'rally'")
    if plus is None:
        ret = court.where("family = 'ret'").withColumns({"tier": F.lit("pooled"), "serve_side": F.lit(""), "serve_dir": F.lit("")})
    else:
        ret = plus.withColumn("family", F.lit("ret")).withColumnsRenamed({"court": "serve_side", "serve_direction": "serve_dir", "depth": "state_depth"})
    out = rally.unionByName(ret, allowMissingColumns=True)
    return out.select(*WHO, "family", "kind", "zone", F.coalesce("state_depth", F.lit("")).alias("state_depth"), "wing", "resp_kind", "line", "n", "n_state", "p_field", "lift", "conv", "sconv", *[F.coalesce(c, F.lit("")).alias(c) for c in ("tier", "serve_side", "serve_dir")])


def opening_counts(parsed: DataFrame, hands: DataFrame) -> DataFrame:
    """n, w, e, f of the return and the two strokes after it, per player, side, anchor and the strokes before (two at most),
    in the striker's frame."""
    from deucebase.operators.sequences import tokens

    t = tokens(parsed, ("match_id", "pt", "gender", "player1", "player2", "pts")).withColumn("side", serve_side(F.col("pts"))).where("side <> 'na' AND size(shots) > 1")

    def one(i: Column) -> Column:
        s, nxt = F.get("shots", i), F.get("shots", i + 1)
        e = F.coalesce(s["terminal"], F.lit(""))
        start = F.greatest(i - 1, F.lit(1))
        return F.struct(F.when(s["hitter"] == 1, F.col("player1")).otherwise(F.col("player2")).alias("player"), i.alias("i"), F.slice("toks", start, i - start + 1).alias("plain"), F.slice("mirrored", start, i - start + 1).alias("mirror"), (e == "*").cast("int").alias("w"), (e == "@").cast("int").alias("e"), F.coalesce(nxt["terminal"] == "#", F.lit(False)).cast("int").alias("f"))

    s = t.select("gender", "side", F.inline(F.transform(F.sequence(F.lit(1), F.least(F.size("shots") - 1, F.lit(3))), one))).join(hands.select(*WHO, "hand"), WHO, "left")
    context = F.array_join(F.when(F.coalesce(F.col("hand") == "L", F.lit(False)), F.col("mirror")).otherwise(F.col("plain")), " ")
    anchor = F.element_at(F.create_map(*[F.lit(x) for kv in ANCHORS.items() for x in kv]), F.col("i"))
    return s.groupBy(*WHO, "side", anchor.alias("anchor"), context.alias("context")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("w", "e", "f")])


def opening_rows(counts: DataFrame, min_base: int = 200, min_n: int = 60, min_att: int = 12, lift: float = 1.5) -> DataFrame:
    """Openings that raise attempts over the player's own norm for the same stroke and side, and whether they pay."""
    w = Window.partitionBy(*WHO, "side", "anchor")
    att = F.col("w") + F.col("e") + F.col("f")
    t = counts.withColumn("att", att).withColumn("win", F.col("w") + F.col("f")).withColumns({"bn": F.sum("n").over(w), "ba": F.sum(att).over(w), "bw": F.sum(F.col("w") + F.col("f")).over(w)})
    t = t.where((F.col("bn") >= min_base) & (F.col("ba") > 0) & (F.col("n") >= min_n) & (F.col("att") >= min_att))
    t = t.withColumns({"att_rate": F.col("att") / F.col("n"), "base_att": F.col("ba") / F.col("bn"), "conversion": F.col("win") / F.col("att"), "base_conv": F.col("bw") / F.col("ba")})
    t = t.withColumn("att_lift", F.col("att_rate") / F.col("base_att")).where(F.col("att_lift") >= lift).withColumn("conv_delta", F.col("conversion") - F.col("base_conv"))
    return t.select(*WHO, "side", "anchor", "context", "n", F.col("att").alias("attempts"), "att_rate", "att_lift", "conversion", "conv_delta", F.when(F.col("conv_delta") >= 0, "green").otherwise("trap").alias("tag"))


def contrasts(shots: DataFrame) -> DataFrame:
    """Attempts and what became of them by kind and wing of a stroke, for server and returner."""
    a = aggressive(shots)
    n = lambda c: F.sum(F.col(c).cast("int"))
    return a.groupBy("letter", (F.col("hitter") == F.col("server")).alias("by_server")).agg(F.count(F.lit(1)).alias("n"), n("is_winner").alias("w"), n("own_unforced").alias("e"), n("induced_forced").alias("f"))


def depth_tier(a: Column, b: Column) -> Column:
    """How well a pairing is charted, by the less charted player."""
    least = F.least(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0)))
    return F.when(least >= 30, "deep").when(least >= 8, "fair").when(least >= 1, "thin").otherwise("none")


def current_round(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The first round of a draw with a match to play; none where all are played."""
    return matches.groupBy(*keys).agg(F.min(F.when(F.col("state") != "post", F.col("rank"))).alias("current"))


def sharing(rows: DataFrame, by: list[str], pattern: list[str]) -> DataFrame:
    """Which share of a group has the same headline pattern: the most common one's."""
    g = rows.groupBy(*by, *pattern).agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*by).agg(F.sum("n").alias("players"), (F.max("n") / F.sum("n")).alias("share"))


def trigger_stability(counts: DataFrame, min_half: int = 25, top: int = 5) -> DataFrame:
    """Per player: correlation of a context's rates of attempts between halves, and overlap of the ``top`` contexts."""
    from deucebase.functions.stats import corr

    t = counts.groupBy(*WHO, "context", "half").agg(F.sum("n").alias("n"), F.sum(F.col("w") + F.col("e") + F.col("f")).alias("a")).where(F.col("n") >= min_half).withColumn("r", F.col("a") / F.col("n"))
    w = Window.partitionBy(*WHO, "half").orderBy(F.desc("r"), "context")
    t = t.withColumn("rn", F.row_number().over(w))
    side = lambda h, c: F.max(F.when(F.col("half") == h, F.col(c)))
    both = t.groupBy(*WHO, "context").agg(side(0, "r").alias("r0"), side(1, "r").alias("r1"))
    c = both.where("r0 IS NOT NULL AND r1 IS NOT NULL").groupBy(*WHO).agg(F.count(F.lit(1)).alias("contexts"), corr(F.col("r0"), F.col("r1")).alias("r"))
    names = lambda h: F.collect_set(F.when((F.col("half") == h) & (F.col("rn") <= top), F.col("context")))
    j = t.groupBy(*WHO).agg(names(0).alias("x"), names(1).alias("y"))
    j = j.select(*WHO, F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))).alias("jaccard"))
    return c.join(j, WHO)


def top_changed(years: DataFrame, features: list[str], cut: int, top: int = 3) -> DataFrame:
    """The features that moved most between a player's years before and from ``cut`` on, weighted by points."""
    late = F.col("year") >= cut
    mean = lambda f, c: F.try_divide(F.sum(F.when(c, F.col(f) * F.col("n"))), F.sum(F.when(c, F.col("n"))))
    g = years.groupBy(*WHO).agg(*[(mean(f, late) - mean(f, ~late)).alias(f) for f in features])
    moves = F.array(*[F.struct((-F.abs(f)).alias("k"), F.lit(f).alias("feature"), F.col(f).alias("change")) for f in features])
    return g.where(F.col(features[0]).isNotNull()).select(*WHO, F.posexplode(F.slice(F.array_sort(moves), 1, top)).alias("place", "m")).select(*WHO, (F.col("place") + 1).alias("place"), "m.feature", "m.change")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A report table as text; a report has at most ``most`` rows, which is checked."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"markdown: more than {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
