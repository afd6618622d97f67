"""Matches and points projected from the star-schema tables.

The projection is one SQL text that Spark and DuckDB read alike, so that every operator can be run on both. A match is
a block of 16 orders, from a key divisible by 16 on, and dated by its first order; its points are the block's line items. What the star
schema lacks (players, notation, score) comes from digits of an md5 of the row's unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEX = "0123456789abcdef"


def digit(h: str, i: int) -> str:
    """The i-th hex digit of md5 text ``h``, as a number."""
    return f"(instr('{HEX}', substr({h}, {i}, 1)) - 1)"


def pick(values: list[str], index: str) -> str:
    """CASE that picks a string by number, modulo the list."""
    arms = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE {index} % {len(values)} {arms} END"


TOURNAMENTS = ["Wimbledon", "US Open", "Roland Garros", "Australian Open", "Indian Wells Masters", "Miami Masters", "Montreal", "Toronto", "Rome Masters", "Davis Cup WG", "Tour Finals", "Basel", "Dubai", "French Open", "Charleston", "Monte Carlo"]
ROUNDS = ["F", "SF", "QF", "R16", "R32", "R64", "R128", "Q1"]
SURFACES = ["Hard", "Clay", "Grass", "Hard", "Clay", "Carpet", "Eva A.", ""]
SCORES = ["0-0", "15-0", "0-15", "15-15", "30-0", "0-30", "30-15", "15-30", "30-30", "40-0", "0-40", "40-15", "15-40", "40-30", "30-40", "40-40", "AD-40", "40-AD", "3-2", "6-6", "40", ""]
LETTERS = "fbrsfbvzopfbylmhijkt"
PLAYERS = 40

_P1 = f"(({digit('h', 1)} * 16 + {digit('h', 2)}) % {PLAYERS})"
_P2 = f"(({_P1} + 1 + ({digit('h', 3)} * 16 + {digit('h', 4)}) % {PLAYERS - 1}) % {PLAYERS})"

MATCHES = f"""
SELECT CAST(k AS STRING) AS match_id, CASE WHEN gd = 0 THEN 'M' ELSE 'W' END AS gender,
       CONCAT(CASE WHEN gd = 0 THEN 'M' ELSE 'W' END, ' Player ', CAST(a AS STRING)) AS player1,
       CONCAT(CASE WHEN gd = 0 THEN 'M' ELSE 'W' END, ' Player ', CAST(b AS STRING)) AS player2,
       CASE WHEN a % 5 = 0 AND {digit("h", 6)} <> 7 OR a % 5 <> 0 AND {digit("h", 6)} = 7 THEN 'L' WHEN {digit("h", 6)} = 9 THEN 'U' ELSE 'R' END AS player1_hand,
       CASE WHEN b % 5 = 0 AND {digit("h", 7)} <> 7 OR b % 5 <> 0 AND {digit("h", 7)} = 7 THEN 'L' WHEN {digit("h", 7)} = 9 THEN 'U' ELSE 'R' END AS player2_hand,
       CAST(o_orderdate AS DATE) AS date, year(CAST(o_orderdate AS DATE)) AS year,
       {pick(TOURNAMENTS, digit("h", 8))} AS tournament, {pick(ROUNDS, digit("h", 9))} AS round,
       {pick(SURFACES, digit("h", 10))} AS surface, CASE WHEN {digit("h", 11)} < 4 AND gd = 0 THEN 5 ELSE 3 END AS best_of,
       CONCAT('charter', CAST({digit("h", 12)} AS STRING)) AS charted_by
FROM (SELECT o_orderkey AS k, o_orderdate, h, {digit("h", 5)} % 2 AS gd, {_P1} AS a, {_P2} AS b
      FROM (SELECT o_orderkey - o_orderkey % 16 AS o_orderkey, md5(CAST(o_orderkey - o_orderkey % 16 AS STRING)) AS h, coalesce(min(CASE WHEN o_orderkey % 16 = 0 THEN o_orderdate END), min(o_orderdate)) AS o_orderdate FROM orders GROUP BY o_orderkey - o_orderkey % 16) x0) x1
"""

_STROKES = " ".join(
    f"""|| CASE WHEN {digit("h", 8)} > {2 * i} THEN substr('{LETTERS}', CAST({digit("h", 9 + 2 * i)} + 1 + {i % 5} AS INT), 1) || substr('123', CAST({digit("h", 10 + 2 * i)} % 3 + 1 AS INT), 1) ELSE '' END"""
    + (f""" || CASE WHEN {digit("h", 8)} > 0 THEN substr('789', CAST({digit("h", 31)} % 3 + 1 AS INT), 1) ELSE '' END""" if i == 0 else "")
    for i in range(7)
)
_SERVE = f"substr('4564560', CAST({digit('h', 24)} % 7 + 1 AS INT), 1)"
_END = f"CASE WHEN {digit('h', 25)} < 6 THEN '*' ELSE substr('ndwx', CAST({digit('h', 26)} % 4 + 1 AS INT), 1) || CASE WHEN {digit('h', 27)} < 5 THEN '#' ELSE '@' END END"
_RALLY = f"({_SERVE} {_STROKES} || {_END})"
_FAULT = f"({_SERVE} || substr('ndwx', CAST({digit('h', 26)} % 4 + 1 AS INT), 1))"

POINTS = f"""
SELECT match_id, CAST(row_number() OVER (PARTITION BY match_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS pt,
       CAST({digit("h", 1)} % 2 + 1 AS INT) AS svr, CAST(CASE WHEN {digit("h", 2)} < 10 THEN {digit("h", 1)} % 2 + 1 ELSE 2 - {digit("h", 1)} % 2 END AS INT) AS pt_winner,
       CAST({digit("h", 3)} % 3 AS INT) AS set1, CAST({digit("h", 4)} % 3 AS INT) AS set2, CAST({digit("h", 5)} % 7 AS INT) AS gm1, CAST({digit("h", 6)} % 7 AS INT) AS gm2,
       {pick(SCORES, f"({digit('h', 7)} * 16 + {digit('h', 30)})")} AS pts,
       CASE WHEN {digit("h", 28)} < 10 THEN {_RALLY} WHEN {digit("h", 28)} = 10 THEN 'c' || {_RALLY} WHEN {digit("h", 28)} = 15 AND {digit("h", 29)} < 3 THEN '' ELSE {_FAULT} END AS first_serve,
       CASE WHEN {digit("h", 28)} < 11 OR {digit("h", 28)} = 15 THEN NULL WHEN {digit("h", 29)} < 4 THEN {_FAULT} ELSE {_RALLY} END AS second_serve
FROM (SELECT CAST(l_orderkey - l_orderkey % 16 AS STRING) AS match_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
             md5(CONCAT(CAST(l_orderkey AS STRING), '|', CAST(l_linenumber AS STRING), '|', CAST(l_partkey AS STRING), '|', CAST(l_suppkey AS STRING), '|', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))) AS h
      FROM lineitem) y
"""

#: For DuckDB: the same two tables as common table expressions. ``points`` has every match's gender and players.
CTES = f"matches AS ({MATCHES}), points AS (SELECT p.*, m.gender, m.player1, m.player2, m.date, m.year, m.surface FROM ({POINTS}) p JOIN matches m ON p.match_id = m.match_id)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per match; every order is read, a sixteenth as many rows come out."""
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(MATCHES)


def raw_points(spark: SparkSession, sf_dir: str, spread_out: bool = False) -> DataFrame:
    """Points without their match's columns; ``spread_out``: over all cores by match, however few splits the file has."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    if spread_out:
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartition(parts, rows["l_orderkey"] - rows["l_orderkey"] % 16)
    rows.createOrReplaceTempView("lineitem")
    return spark.sql(POINTS)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with what is needed of their match. Spark picks the join; AQE broadcasts matches where they are small."""
    m = matches(spark, sf_dir).select("match_id", "gender", "player1", "player2", "date", "year", "surface")
    return raw_points(spark, sf_dir).join(m, "match_id")
