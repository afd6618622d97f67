"""The decoded points and the stroke table."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.functions import notation
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import points
from deucebase.sources.store import parsed


@query(
    f"""SELECT match_id, pt, server, serve_in_play, rally_len::INT AS rally_len, last_hitter::INT AS last_hitter, outcome, winner_by_notation::INT AS winner_by_notation, server_won, parse_ok,
 CASE WHEN rally_len = 0 OR on_serve THEN '' ELSE {sql.SIDE_OF} END AS ending_side, CASE WHEN rally_len = 0 THEN '' WHEN on_serve THEN 'serve' ELSE {sql.NAME_OF} END AS ending_stroke,
 CASE WHEN rally_len = 0 THEN '' ELSE {sql.KIND_OF.format(serve='on_serve')} END AS ending_kind FROM decoded""",
    sql.DECODED,
)
def points_parsed(spark, d):
    return notation.point_features(parsed(spark, d))


@query("SELECT outcome, serve_in_play, count(*) AS n, round(avg(rally_len), 6) AS mean_rally, round(avg(server_won::INT), 6) AS server_win FROM decoded GROUP BY 1, 2", sql.DECODED)
def outcomes(spark, d):
    p = notation.point_features(parsed(spark, d))
    return p.groupBy("outcome", "serve_in_play").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("rally_len"), 6).alias("mean_rally"), F.round(F.avg(F.col("server_won").cast("int")), 6).alias("server_win"))


@query(
    f"""SELECT match_id, pt, idx::INT AS idx, hitter::INT AS hitter, is_serve, letter, side, CASE WHEN is_serve THEN 'serve' ELSE {sql.NAME_OF} END AS stroke, direction, depth,
 regexp_replace(tail, '[^+=^\\-]', '', 'g') AS modifiers, error_loc, terminal FROM shots""",
    sql.SHOTS,
)
def stroke_table(spark, d):
    return notation.shot_table(parsed(spark, d)).select("match_id", "pt", "idx", "hitter", "is_serve", "letter", "side", "stroke", "direction", "depth", "modifiers", "error_loc", "terminal")


@query(
    f"""SELECT {sql.KIND_OF.format(serve='is_serve')} AS kind, side, count(*) AS n, sum((coalesce(terminal, '') = '*')::INT)::BIGINT AS winners, sum((coalesce(terminal, '') = '@')::INT)::BIGINT AS own_unforced,
 sum((coalesce(next_terminal, '') = '#')::INT)::BIGINT AS induced_forced FROM shots WHERE parse_ok GROUP BY 1, 2""",
    sql.SHOTS,
)
def aggressive_strokes(spark, d):
    s = notation.aggressive(notation.shot_table(parsed(spark, d)).where("parse_ok"))
    n = lambda c, name: F.sum(F.col(c).cast("int")).alias(name)
    return s.groupBy(notation.stroke_kind(F.col("letter"), F.col("is_serve")).alias("kind"), "side").agg(F.count(F.lit(1)).alias("n"), n("is_winner", "winners"), n("own_unforced", "own_unforced"), n("induced_forced", "induced_forced"))


@query(f"""SELECT regexp_extract(coalesce(first_serve, ''), '^[^{notation.LETTERS}4560]*([4560])', 1) AS serve, CASE WHEN regexp_extract(coalesce(first_serve, ''), '^[^{notation.LETTERS}456]*([456])', 1) = '' THEN '?' ELSE regexp_extract(first_serve, '^[^{notation.LETTERS}456]*([456])', 1) END AS known, gender, count(*) AS n FROM points GROUP BY 1, 2, 3""")
def serve_directions(spark, d):
    p = points(spark, d)
    return p.groupBy(notation.serve_dir(F.col("first_serve")).alias("serve"), notation.first_serve_dir(F.col("first_serve")).alias("known"), "gender").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT rally_len >= 5 AS long, exists_net, count(*) AS n, round(avg(server_won::INT), 6) AS server_win FROM
 (SELECT match_id, pt, any_value(rally_len) AS rally_len, any_value(server_won) AS server_won, bool_or(letter IN ('v', 'z', 'o', 'p', 'u', 'y')) AS exists_net FROM shots WHERE parse_ok GROUP BY match_id, pt) GROUP BY 1, 2""",
    sql.SHOTS,
)
def rally_contrasts(spark, d):
    p = notation.decoded(parsed(spark, d)).where("parse_ok")
    net = F.exists("shots", lambda s: s["letter"].isin(*"vzopuy"))
    return p.groupBy((F.col("rally_len") >= 5).alias("long"), net.alias("exists_net")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("server_won").cast("int")), 6).alias("server_win"))


@query(
    """SELECT count(*) AS n, sum((outcome = 'ace')::INT)::BIGINT AS aces, sum((outcome = 'double_fault')::INT)::BIGINT AS double_faults, gender,
 sum((winner_by_notation IS NOT NULL AND winner_by_notation <> pt_winner)::INT)::BIGINT AS mismatches FROM decoded GROUP BY gender""",
    sql.DECODED,
)
def notation_checks(spark, d):
    p = notation.point_features(parsed(spark, d), ("gender", "pt_winner"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return p.groupBy("gender").agg(F.count(F.lit(1)).alias("n"), n(F.col("outcome") == "ace").alias("aces"), n(F.col("outcome") == "double_fault").alias("double_faults"), n(F.col("winner_by_notation") != F.col("pt_winner")).alias("mismatches"))
