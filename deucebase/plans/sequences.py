"""Stroke-word queries: language model, trigger contexts, response cells, serve plus one."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions import notation, score
from deucebase.operators import coded, coverage, screens
from deucebase.operators import sequences as seq
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches
from deucebase.sources.store import coded_points, once, parsed

_HANDS = """hands AS (SELECT gender, player, CASE WHEN sum((hand = 'R')::INT) >= sum((hand = 'L')::INT) THEN 'R' ELSE 'L' END AS hand FROM
 (SELECT gender, player1 AS player, player1_hand AS hand FROM matches UNION ALL SELECT gender, player2, player2_hand FROM matches) WHERE hand IN ('R', 'L') GROUP BY 1, 2)"""
_KW = "CASE WHEN letter IN ('f', 'b') THEN 'd' WHEN letter IN ('r', 's') THEN 's' WHEN letter IN ('v', 'z', 'o', 'p', 'u', 'y') THEN 'v' ELSE 'o' END"
_WORD = f"CASE side WHEN 'FH' THEN 'F' WHEN 'BH' THEN 'B' ELSE '?' END || {_KW} || "
_SERVED = "'sv' || CASE direction WHEN '4' THEN 'W' WHEN '5' THEN 'B' WHEN '6' THEN 'T' ELSE '?' END"
_TOK = f"""{sql.SHOTS}, {_HANDS}, tk AS (SELECT *, CASE WHEN is_serve THEN {_SERVED} ELSE {_WORD} coalesce(direction, '·') END AS tok,
 CASE WHEN is_serve THEN {_SERVED} ELSE {_WORD} translate(coalesce(direction, '·'), '13', '31') END AS mir FROM shots WHERE parse_ok)"""
_CTX = """, cx AS (SELECT t.*, hand, CASE WHEN coalesce(hand, 'R') = 'L' THEN lag(mir, {0}) OVER w{1} ELSE lag(tok, {0}) OVER w{2} END AS context, lag(tok, {0}) OVER w AS deep,
 (coalesce(terminal, '') = '*')::INT AS w, (coalesce(terminal, '') = '@')::INT AS e, (coalesce(next_terminal, '') = '#')::INT AS f FROM tk t LEFT JOIN hands USING (gender, player) WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx))"""
_CTX2 = _CTX.format(2, " || ' ' || lag(mir, 1) OVER w", " || ' ' || lag(tok, 1) OVER w")


def _tokens(spark, d):
    return seq.tokens(parsed(spark, d))


def _contexts(spark, d, k=2):
    return seq.contexts(seq.strikes(_tokens(spark, d), k), coverage.modal_hand(matches(spark, d)))


@query(
    """SELECT gender, player, context, count(*) AS n, sum(w + e + f)::BIGINT AS attempts, round(sum(w + e + f) / count(*), 6) AS att_rate,
 round(coalesce((sum(w + e + f) / count(*)) / nullif(any_value(ba) / any_value(bn), 0), 0), 6) AS att_lift, round(sum(w + f) / nullif(sum(w + e + f), 0), 6) AS conv
 FROM cx JOIN (SELECT gender, player, count(*) AS bn, sum(w + e + f) AS ba FROM cx WHERE deep IS NOT NULL GROUP BY 1, 2) USING (gender, player) WHERE deep IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 5""",
    _TOK + _CTX2,
)
def trigger_contexts(spark, d):
    t = seq.context_table(_contexts(spark, d), 5)
    return t.select("gender", "player", "context", "n", "attempts", *[F.round(c, 6).alias(c) for c in ("att_rate", "att_lift", "conv")])


_HALF = f"(({sql.crc32('match_id')}) & 1)::INT"


@query(f"SELECT gender, player, {_HALF} AS half, count(*) AS n, sum(w)::BIGINT AS w, sum(e)::BIGINT AS e, sum(f)::BIGINT AS f FROM cx WHERE deep IS NOT NULL GROUP BY 1, 2, 3", _TOK + _CTX2)
def context_halves(spark, d):
    half = screens.half(F.col("match_id"))
    c = seq.strikes(_tokens(spark, d), 2)
    return c.groupBy("gender", "player", half.alias("half")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum("e").alias("e"), F.sum("f").alias("f"))


@query(
    """, p2 AS (SELECT gender, lag(tok, 2) OVER w || ' ' || lag(tok, 1) OVER w AS context, (coalesce(terminal, '') = '*')::INT AS win, (coalesce(terminal, '') = '@')::INT AS unf, (coalesce(terminal, '') = '#')::INT AS forced FROM tk WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)),
 t AS (SELECT gender, context, count(*) AS n, sum(win) AS winners, sum(unf) AS unforced, sum(forced) AS forced FROM p2 WHERE context IS NOT NULL GROUP BY 1, 2)
 SELECT gender, context, n, winners::BIGINT AS winners, unforced::BIGINT AS unforced, forced::BIGINT AS forced FROM (SELECT *, row_number() OVER (PARTITION BY gender ORDER BY winners / n DESC, n DESC, context) AS rn FROM t WHERE n >= 10) WHERE rn <= 10""",
    _TOK,
)
def shot_patterns(spark, d):
    s = seq.strikes(_tokens(spark, d), 2).withColumn("context", F.array_join("plain", " "))
    t = s.groupBy("gender", "context").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("winners"), F.sum("e").alias("unforced"), F.sum("own_forced").alias("forced")).where("n >= 10")
    w = Window.partitionBy("gender").orderBy(F.desc(F.col("winners") / F.col("n")), F.desc("n"), "context")
    return t.withColumn("rn", F.row_number().over(w)).where("rn <= 10").drop("rn")


@query(
    """, deep AS (SELECT gender, lag(tok, 3) OVER w || ' ' || lag(tok, 2) OVER w || ' ' || lag(tok, 1) OVER w AS c3, lag(tok, 2) OVER w || ' ' || lag(tok, 1) OVER w AS c2, (coalesce(terminal, '') = '*')::INT AS win FROM tk WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)),
 a AS (SELECT gender, c3, substr(c3, instr(c3, ' ') + 1) AS parent, count(*) AS n, sum(win) AS w FROM deep WHERE c3 IS NOT NULL GROUP BY 1, 2), b AS (SELECT gender, c2, count(*) AS n, sum(win) AS w FROM deep WHERE c2 IS NOT NULL GROUP BY 1, 2)
 SELECT a.gender, c3 AS context, parent, a.n, round(a.w / a.n, 6) AS rate, round(b.w / b.n, 6) AS parent_rate FROM a JOIN b ON a.gender = b.gender AND a.parent = b.c2 WHERE a.n >= 5""",
    _TOK,
)
def deep_patterns(spark, d):
    def table(k):
        s = seq.strikes(_tokens(spark, d), k)
        return s.groupBy("gender", F.col("plain").alias("ctx")).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))

    a, b = table(3).withColumn("parent", F.slice("ctx", 2, 2)), table(2).select("gender", F.col("ctx").alias("parent"), F.col("n").alias("pn"), F.col("w").alias("pw"))
    j = a.where("n >= 5").join(b, ["gender", "parent"])
    return j.select("gender", F.array_join("ctx", " ").alias("context"), F.array_join("parent", " ").alias("parent"), "n", F.round(F.col("w") / F.col("n"), 6).alias("rate"), F.round(F.col("pw") / F.col("pn"), 6).alias("parent_rate"))


_NG = f"""{_TOK}, sq AS (SELECT gender, match_id, pt, idx AS i, CASE WHEN hand = 'L' THEN mir ELSE tok END AS t, player FROM tk LEFT JOIN hands USING (gender, player) UNION ALL SELECT gender, match_id, pt, max(idx) + 1, '<end>', NULL FROM tk GROUP BY 1, 2, 3),
 ng AS (SELECT gender, match_id, pt, player, coalesce(lag(t, 2) OVER w, '<s>') AS a, coalesce(lag(t, 1) OVER w, '<s>') AS b, t FROM sq WINDOW w AS (PARTITION BY gender, match_id, pt ORDER BY i)),
 ct AS (SELECT gender, a, b, t, count(*) AS n FROM ng GROUP BY ALL),
 lm AS (SELECT gender, a, b, t, n, 0.7 * n / sum(n) OVER (PARTITION BY gender, a, b) + 0.2 * sum(n) OVER (PARTITION BY gender, b, t) / sum(n) OVER (PARTITION BY gender, b) + 0.1 * (sum(n) OVER (PARTITION BY gender, t) + 1) / (total + vocab) AS p
        FROM ct JOIN (SELECT gender, count(DISTINCT t) AS vocab, sum(n) AS total FROM ct GROUP BY gender) USING (gender))"""


def _grams(spark, d):
    """Words of all points in their hitters' own hands, as trigrams; kept once an application."""
    return once(spark, "stroke_grams", d, lambda: seq.ngrams(seq.spoken(_tokens(spark, d), coverage.modal_hand(matches(spark, d)))))


def _gram_counts(spark, d):
    """Trigrams counted by whose word the last is, kept once an application."""
    return once(spark, "gram_counts", d, lambda: coded.gram_counts(coded_points(spark, d)))


@query("SELECT gender, a, b, t, n, round(p, 6) AS p, round(-log2(p), 6) AS bits FROM lm", _NG)
def ngram_model(spark, d):
    m = seq.ngram_model(_gram_counts(spark, d))
    return m.select("gender", "a", "b", "t", "n", F.round("p", 6).alias("p"), F.round("bits", 6).alias("bits"))


@query("SELECT gender, sum(n)::BIGINT AS n, round(pow(2, sum(n * -log2(p)) / sum(n)), 6) AS perplexity FROM lm GROUP BY gender", _NG)
def perplexity(spark, d):
    m = seq.ngram_model(_gram_counts(spark, d))
    return m.groupBy("gender").agg(F.sum("n").alias("n"), F.round(F.pow(F.lit(2.0), F.sum(F.col("n") * F.col("bits")) / F.sum("n")), 6).alias("perplexity"))


@query("SELECT gender, player, b, t, n, round(lift, 6) AS lift FROM (SELECT *, (n / sum(n) OVER (PARTITION BY gender, player, b)) / (sum(n) OVER (PARTITION BY gender, b, t) / sum(n) OVER (PARTITION BY gender, b)) AS lift FROM (SELECT gender, player, b, t, count(*) AS n FROM ng WHERE t <> '<end>' GROUP BY ALL)) WHERE n >= 10", _NG)
def word_signatures(spark, d):
    return seq.signatures(_grams(spark, d)).withColumn("lift", F.round("lift", 6))


@query("SELECT gender, floor(-log2(p))::INT AS bits, count(*) AS n FROM ng JOIN lm USING (gender, a, b, t) GROUP BY 1, 2", _NG)
def surprise_bins(spark, d):
    g = _grams(spark, d)
    j = g.join(seq.ngram_model(g).drop("n"), ["gender", "a", "b", "t"])
    return j.groupBy("gender", F.floor("bits").cast("int").alias("bits")).agg(F.count(F.lit(1)).alias("n"))


_OBS = f"""{_TOK}, lg AS (SELECT t.*, lag(letter) OVER w AS in_letter, lag(direction) OVER w AS d_in, lag(depth) OVER w AS d_depth, lag(idx) OVER w AS pi, first(direction) OVER w AS sdir FROM tk t WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)),
 n3 AS (SELECT *, row_number() OVER (PARTITION BY match_id, pt ORDER BY idx) AS pos FROM lg),
 ob AS (SELECT n3.*, hand, CASE WHEN hand = 'R' THEN '1' ELSE '3' END AS fh, CASE WHEN hand = 'R' THEN '3' ELSE '1' END AS bh, ((hitter = server) = server_won)::INT AS won FROM n3 JOIN hands USING (gender, player) WHERE pos >= 3 AND side IN ('FH', 'BH') AND d_in IN ('1', '2', '3') AND direction IN ('1', '2', '3')),
 o2 AS (SELECT *, CASE WHEN d_in <> '2' THEN d_in WHEN side = 'FH' THEN fh ELSE bh END AS ref, CASE WHEN d_in = '2' THEN 'mid' WHEN d_in = fh THEN 'fh' ELSE 'bh' END AS zone,
   {sql.KIND_OF.format(serve='false').replace('letter', 'in_letter')} AS kind, {sql.KIND_OF.format(serve='false')} AS resp_kind FROM ob),
 o3 AS (SELECT *, CASE WHEN direction = ref THEN 'cc' WHEN direction = translate(ref, '13', '31') THEN 'dtl' ELSE 'mid' END AS line FROM o2),
 cells AS (SELECT gender, player, family, kind, zone, state_depth, side AS wing, resp_kind, line, count(*) AS n, sum(won) AS won FROM (SELECT *, 'rally' AS family, '' AS state_depth FROM o3 UNION ALL SELECT *, 'ret', d_depth FROM o3 WHERE idx = 3 AND d_depth IS NOT NULL) GROUP BY ALL)"""


def _obs(spark, d):
    return seq.observations(parsed(spark, d), coverage.modal_hand(matches(spark, d)))


@query("SELECT gender, player, family, kind, zone, state_depth, wing, resp_kind, line, n, won::BIGINT AS won FROM cells", _OBS)
def response_cells(spark, d):
    return seq.response_cells(_obs(spark, d))


@query(
    """, s AS (SELECT *, sum(n) OVER (PARTITION BY gender, player, family, kind, zone, state_depth) AS n_state, sum(n) OVER (PARTITION BY gender, family, kind, zone, state_depth) AS f_state, sum(n) OVER (PARTITION BY gender, family, kind, zone, state_depth, wing, resp_kind, line) AS f_cell FROM cells),
 q AS (SELECT *, (f_cell - n) / nullif(f_state - n_state, 0) AS sh FROM s WHERE n_state >= 20)
 SELECT gender, player, family, kind, zone, state_depth, wing, resp_kind, line, n, n_state::BIGINT AS n_state, round(sh, 6) AS field_share, round(((n + 30.0 * sh) / (n_state + 30.0)) / nullif(sh, 0), 6) AS lift FROM q""",
    _OBS,
)
def response_lifts(spark, d):
    r = seq.response_lifts(seq.response_cells(_obs(spark, d)))
    return r.drop("evidence").withColumn("field_share", F.round("field_share", 6)).withColumn("lift", F.round("lift", 6))


@query(
    f""", s1p AS (SELECT *, {sql.SIDE} AS court FROM o3 WHERE idx = 3 AND d_depth IS NOT NULL AND {sql.SIDE} <> 'na')
 SELECT 'full' AS tier, gender, player, court, sdir AS serve_direction, kind, zone, d_depth AS depth, side AS wing, resp_kind, line, count(*) AS n, sum(won)::BIGINT AS won FROM s1p WHERE sdir IN ('4', '5', '6') GROUP BY ALL
 UNION ALL SELECT 'side', gender, player, court, NULL, kind, zone, d_depth, side, resp_kind, line, count(*), sum(won)::BIGINT FROM s1p GROUP BY ALL
 UNION ALL SELECT 'pooled', gender, player, NULL, NULL, kind, zone, d_depth, side, resp_kind, line, count(*), sum(won)::BIGINT FROM s1p GROUP BY ALL""",
    _OBS,
)
def serve_plus_one(spark, d):
    return seq.serve_plus_one(_obs(spark, d), score.serve_side(F.col("pts")))


@query("SELECT gender, player, count(*) AS n, round(avg(-log2(p)), 6) AS bits, round(pow(2, avg(-log2(p))), 6) AS perplexity FROM ng JOIN lm USING (gender, a, b, t) WHERE t <> '<end>' GROUP BY 1, 2 HAVING count(*) >= 500", _NG)
def player_surprise(spark, d):
    g = _gram_counts(spark, d)
    s = seq.player_surprise(g, seq.ngram_model(g))
    return s.select("gender", "player", "n", F.round("bits", 6).alias("bits"), F.round("perplexity", 6).alias("perplexity"))


@query("SELECT t AS token, CASE WHEN starts_with(t, 'sv') THEN CASE substr(t, 3) WHEN 'W' THEN 'serve wide' WHEN 'B' THEN 'serve body' WHEN 'T' THEN 'serve T' ELSE 'serve ?' END WHEN t = '<end>' THEN t ELSE CASE substr(t, 1, 1) WHEN 'F' THEN 'FH' WHEN 'B' THEN 'BH' ELSE '?' END || ' ' || CASE substr(t, 2, 1) WHEN 'd' THEN 'drive' WHEN 's' THEN 'slice' WHEN 'v' THEN 'net' ELSE 'shot' END || '→' || substr(t, 3) END AS words, count(*) AS n FROM ng GROUP BY 1, 2", _NG)
def pretty_tokens(spark, d):
    return _grams(spark, d).groupBy(F.col("t").alias("token")).agg(F.count(F.lit(1)).alias("n")).select("token", notation.pretty(F.col("token")).alias("words"), "n")
