"""Stroke words: n-gram language model, context windows, response cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions.notation import decoded, shot_token, stroke_kind

START, END = "<s>", "<end>"


def tokens(points: DataFrame, keep: tuple[str, ...] = ("match_id", "pt", "gender", "player1", "player2")) -> DataFrame:
    """Per readable point its strokes as words, unmirrored and mirrored (``toks``, ``mirrored``), and what they led to."""
    d = decoded(points).where("parse_ok").select(*keep, "server", "server_won", "shots")
    return d.select(*keep, "server", "server_won", "shots", F.transform("shots", lambda s: shot_token(s, F.lit(False))).alias("toks"), F.transform("shots", lambda s: shot_token(s, F.lit(True))).alias("mirrored"))


def spoken(toks: DataFrame, hands: DataFrame) -> DataFrame:
    """``toks`` with each stroke named by its own hitter's hand: what a left-hander hits is turned. Unknown hands are right."""
    for k in (1, 2):
        toks = toks.join(hands.select("gender", F.col("player").alias(f"player{k}"), F.coalesce(F.col("hand") == "L", F.lit(False)).alias(f"_left{k}")), ["gender", f"player{k}"], "left")
    left = lambda s: F.coalesce(F.when(s["hitter"] == 1, F.col("_left1")).otherwise(F.col("_left2")), F.lit(False))
    return toks.withColumn("toks", F.zip_with("shots", F.arrays_zip("toks", "mirrored"), lambda s, w: F.when(left(s), w["mirrored"]).otherwise(w["toks"]))).drop("_left1", "_left2")


def strikes(toks: DataFrame, k: int, keep: tuple[str, ...] = ("match_id", "pt", "gender")) -> DataFrame:
    """One row per stroke that ``k`` others lead up to: the striker, both contexts (plain and mirrored), and whether it
    won, was an own unforced error, or induced a forced error."""

    def one(i: Column) -> Column:
        s, nxt = F.get("shots", i), F.get("shots", i + 1)
        t = F.coalesce(s["terminal"], F.lit(""))
        return F.struct(
            F.when(s["hitter"] == 1, F.col("player1")).otherwise(F.col("player2")).alias("player"), s["idx"].alias("idx"), F.slice("toks", i - k + 1, k).alias("plain"), F.slice("mirrored", i - k + 1, k).alias("mirror"),
            (t == "*").cast("int").alias("w"), (t == "@").cast("int").alias("e"), F.coalesce(nxt["terminal"] == "#", F.lit(False)).cast("int").alias("f"), (t == "#").cast("int").alias("own_forced"),
        )

    long = toks.where(F.size("shots") > k)
    return long.select(*keep, F.inline(F.transform(F.sequence(F.lit(k), F.size("shots") - 1), one)))


def contexts(struck: DataFrame, hands: DataFrame) -> DataFrame:
    """Seen with a right-hander's wings: a left-handed striker's context is the mirrored one. Unknown hands are right."""
    j = struck.join(hands.select("gender", "player", "hand"), ["gender", "player"], "left")
    return j.withColumn("context", F.array_join(F.when(F.coalesce(F.col("hand") == "L", F.lit(False)), F.col("mirror")).otherwise(F.col("plain")), " ")).drop("plain", "mirror", "hand")


def context_table(ctx: DataFrame, min_n: int = 20) -> DataFrame:
    """Per player and context: attempts (winner, unforced or induced error), lift over the player's own rate, conversion."""
    sums = lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("e").alias("e"), F.sum("f").alias("f"))
    t = sums(ctx.groupBy("gender", "player", "context"))
    base = t.groupBy("gender", "player").agg(F.sum("n").alias("bn"), F.sum(F.col("w") + F.col("e") + F.col("f")).alias("ba"))
    j = t.where(F.col("n") >= min_n).join(base, ["gender", "player"])
    att = F.col("w") + F.col("e") + F.col("f")
    return j.select("gender", "player", "context", "n", att.alias("attempts"), (att / F.col("n")).alias("att_rate"), F.coalesce(F.try_divide(att / F.col("n"), F.col("ba") / F.col("bn")), F.lit(0.0)).alias("att_lift"), F.try_divide(F.col("w") + F.col("f"), att).alias("conv"))


def ngrams(toks: DataFrame) -> DataFrame:
    """(a, b, t) of every point, two starts before and an end after its words."""
    seq = F.concat(F.array(F.lit(START), F.lit(START)), "toks", F.array(F.lit(END)))
    d = toks.withColumn("seq", seq)
    steps = F.transform(F.sequence(F.lit(2), F.size("seq") - 1), lambda i: F.struct(i.alias("i"), F.get("seq", i - 2).alias("a"), F.get("seq", i - 1).alias("b"), F.get("seq", i).alias("t")))
    return d.select("match_id", "pt", "gender", "player1", "player2", "server", F.inline(steps))


def _times(grams: DataFrame) -> Column:
    return F.sum("n") if "n" in grams.columns else F.count(F.lit(1))


def ngram_model(grams: DataFrame, l3: float = 0.7, l2: float = 0.2, l1: float = 0.1) -> DataFrame:
    """p and surprise (bits) of every seen (gender, a, b, t): interpolated tri-, bi- and add-one unigram shares.

    Lower orders are window sums over the trigram counts, so the grams are grouped once. Grams with ``n`` are counts."""
    g = grams.groupBy("gender", "a", "b", "t").agg(_times(grams).alias("n"))
    s = lambda *by: F.sum("n").over(Window.partitionBy("gender", *by))
    vocab = g.groupBy("gender").agg(F.countDistinct("t").alias("vocab"), F.sum("n").alias("total"))
    g = g.select("*", s("a", "b").alias("nab"), s("b", "t").alias("nbt"), s("b").alias("nb"), s("t").alias("nt")).join(vocab, "gender")
    p = l3 * F.col("n") / F.col("nab") + l2 * F.col("nbt") / F.col("nb") + l1 * (F.col("nt") + 1) / (F.col("total") + F.col("vocab"))
    return g.select("gender", "a", "b", "t", "n", p.alias("p"), (-F.log2(p)).alias("bits"))


def hitter(grams: DataFrame) -> DataFrame:
    """Rows of :func:`ngrams` with the player whose stroke ``t`` is; none for the end of a point."""
    who = F.when(F.col("i") % 2 == 0, F.col("server")).otherwise(3 - F.col("server"))
    return grams.where(F.col("t") != END).withColumn("player", F.when(who == 1, F.col("player1")).otherwise(F.col("player2")))


def player_surprise(grams: DataFrame, model: DataFrame, min_n: int = 500) -> DataFrame:
    """Per player: strokes, mean surprise in bits and perplexity of the own strokes under the tour's model."""
    own = grams.where("player IS NOT NULL") if "player" in grams.columns else hitter(grams)
    g = own.groupBy("gender", "player", "a", "b", "t").agg(_times(grams).alias("k")).join(model.select("gender", "a", "b", "t", "bits"), ["gender", "a", "b", "t"])
    s = g.groupBy("gender", "player").agg(F.sum("k").alias("n"), (F.sum(F.col("k") * F.col("bits")) / F.sum("k")).alias("bits")).where(F.col("n") >= min_n)
    return s.withColumn("perplexity", F.pow(F.lit(2.0), F.col("bits")))


def surprise_wpa(grams: DataFrame, model: DataFrame, wpa: DataFrame, width: float = 1.0, least: int = 500) -> DataFrame:
    """Mean win probability added by how surprising a stroke was, in bins of ``width`` bits."""
    g = grams.where(F.col("t") != END).join(model.select("gender", "a", "b", "t", "bits"), ["gender", "a", "b", "t"]).select("match_id", "pt", (F.col("i") - 1).cast("int").alias("idx"), "gender", "bits")
    j = g.join(wpa.select("match_id", "pt", "idx", "wpa"), ["match_id", "pt", "idx"])
    return j.groupBy("gender", F.floor(F.col("bits") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("bits").alias("bits"), F.avg("wpa").alias("wpa")).where(F.col("n") >= least)


def signatures(grams: DataFrame, min_n: int = 10) -> DataFrame:
    """Share of a word after another for a player, over the share in the field."""
    t = hitter(grams).groupBy("gender", "player", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    s = lambda *by: F.sum("n").over(Window.partitionBy("gender", *by))
    lift = (F.col("n") / s("player", "b")) / (s("b", "t") / s("b"))
    return t.withColumn("lift", lift).where(F.col("n") >= min_n)


def observations(points: DataFrame, hands: DataFrame, keep: tuple[str, ...] = ("match_id", "pt", "gender", "player1", "player2", "pts")) -> DataFrame:
    """Pairs of consecutive rally strokes as (incoming state, response), in the responder's frame; unknown hands drop out.

    Columns: player, idx, kind, zone, depth (of the incoming ball), wing, resp_kind, line, won, serve_direction."""
    d = decoded(points).where("parse_ok AND server_won IS NOT NULL").select(*keep, "server", "server_won", "shots")

    def one(i: Column) -> Column:
        p, c = F.get("shots", i - 1), F.get("shots", i)
        won = ((c["hitter"] == F.col("server")) == F.col("server_won")).cast("int")
        return F.struct(F.when(c["hitter"] == 1, F.col("player1")).otherwise(F.col("player2")).alias("player"), c["idx"].alias("idx"), p["letter"].alias("in_letter"), p["direction"].alias("d_in"), p["depth"].alias("depth"), c["side"].alias("wing"), c["letter"].alias("letter"), c["direction"].alias("d_out"), won.alias("won"))

    d = d.where(F.size("shots") > 2).withColumn("serve_direction", F.get("shots", F.lit(0))["direction"])
    o = d.select(*keep, "serve_direction", F.inline(F.transform(F.sequence(F.lit(2), F.size("shots") - 1), one)))
    o = o.where(F.col("wing").isin("FH", "BH") & F.col("d_in").isin("1", "2", "3") & F.col("d_out").isin("1", "2", "3"))
    o = o.join(hands.select("gender", "player", "hand"), ["gender", "player"])
    fh, bh = F.when(F.col("hand") == "R", "1").otherwise("3"), F.when(F.col("hand") == "R", "3").otherwise("1")
    ref = F.when(F.col("d_in") != "2", F.col("d_in")).when(F.col("wing") == "FH", fh).otherwise(bh)
    line = F.when(F.col("d_out") == ref, "cc").when(F.col("d_out") == F.translate(ref, "13", "31"), "dtl").otherwise("mid")
    zone = F.when(F.col("d_in") == "2", "mid").when(F.col("d_in") == fh, "fh").otherwise("bh")
    kinds = stroke_kind(F.col("in_letter"), F.lit(False)).alias("kind"), stroke_kind(F.col("letter"), F.lit(False)).alias("resp_kind")
    return o.select(*keep, "serve_direction", "player", "idx", "depth", "wing", "won", zone.alias("zone"), line.alias("line"), *kinds)


CELL = ["family", "kind", "zone", "state_depth", "wing", "resp_kind", "line"]


def response_cells(obs: DataFrame) -> DataFrame:
    """Counts per player and cell; a server's third stroke is in the family ``ret`` too where the return's depth is known."""
    fam = F.when((F.col("idx") == 3) & F.col("depth").isNotNull(), F.array(F.struct(F.lit("rally").alias("family"), F.lit("").alias("state_depth")), F.struct(F.lit("ret").alias("family"), F.col("depth").alias("state_depth")))).otherwise(F.array(F.struct(F.lit("rally").alias("family"), F.lit("").alias("state_depth"))))
    return obs.select("*", F.inline(fam)).groupBy("gender", "player", *CELL).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))


def response_lifts(cells: DataFrame, k: float = 30.0, min_state: int = 20) -> DataFrame:
    """Share of a response in a state over the others' share (the player's own strokes taken out), shrunk by ``k``."""
    state = CELL[:4]
    w = lambda *by: F.sum("n").over(Window.partitionBy("gender", *by))
    c = cells.select("*", w("player", *state).alias("n_state"), w(*state).alias("f_state"), w(*CELL).alias("f_cell"))
    share = F.try_divide(F.col("f_cell") - F.col("n"), F.col("f_state") - F.col("n_state"))
    lift = F.try_divide((F.col("n") + k * share) / (F.col("n_state") + k), share)
    return c.where(F.col("n_state") >= min_state).select("gender", "player", *CELL, "n", "n_state", share.alias("field_share"), lift.alias("lift"), (F.col("n") * F.log2(lift)).alias("evidence"))


def serve_plus_one(obs: DataFrame, side: Column) -> DataFrame:
    """The server's third stroke, counted at three resolutions by GROUPING SETS over pre-summed rows."""
    o = obs.where((F.col("idx") == 3) & F.col("depth").isNotNull()).withColumn("court", side).where("court <> 'na'")
    fine = ["court", "serve_direction", "kind", "zone", "depth", "wing", "resp_kind", "line"]
    s = o.groupBy("gender", "player", *fine).agg(F.count(F.lit(1)).alias("n"), F.sum("won").alias("won"))
    state = fine[2:]
    sets = [[F.col(x) for x in ("gender", "player", *own, *state)] for own in (fine[:2], fine[:1], [])]
    tier = F.when(F.grouping("serve_direction") == 0, "full").when(F.grouping("court") == 0, "side").otherwise("pooled")
    t = s.groupingSets(sets, *[F.col(x) for x in ("gender", "player", *fine)]).agg(tier.alias("tier"), F.sum("n").alias("n"), F.sum("won").alias("won"))
    return t.where("tier <> 'full' OR serve_direction IN ('4', '5', '6')")
