"""Raw files to tables and back: what is written comes back as it was."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.plans.registry import query
from deucebase.sources import ingest, store
from deucebase.sources.adapter import matches, points

_RAW_MATCH = {v: k for k, v in ingest.MATCH_COLUMNS.items()}
_RAW_POINT = {v: k for k, v in ingest.POINT_COLUMNS.items()}


def _match_files(spark, d):
    """Matches as the files have them: one CSV a tour, dates as digits, players' own headers."""
    path = store.scratch(spark, "raw-matches")
    m = matches(spark, d).withColumn("date", F.date_format("date", "yyyyMMdd")).drop("year")
    raw = m.toDF(*[_RAW_MATCH.get(c, c.title() if c != "match_id" else c) for c in m.columns])
    for g, short in ingest.GENDERS.items():
        store.write_csv(raw.where(F.col("Gender") == g).drop("Gender"), f"{path}/charting-{short}-matches.csv")
    return path


@query("SELECT match_id, gender, player1, player2, player1_hand, player2_hand, date, year::INT AS year, tournament, round, CASE WHEN surface IN ('Hard', 'Clay', 'Grass', 'Carpet') THEN surface END AS surface, CASE WHEN surface IN ('Hard', 'Clay', 'Grass', 'Carpet', '') THEN best_of::INT END AS best_of, CASE WHEN surface IN ('Hard', 'Clay', 'Grass', 'Carpet', '') THEN charted_by END AS charted_by FROM matches")
def ingested_matches(spark, d):
    """Written as raw files, found by the catalogue (missing ones skipped), scanned as text, repaired and cast."""
    path = _match_files(spark, d)
    there = ingest.present(spark, path, ingest.all_sources("matches") + ingest.all_sources("stats"))
    frames = [ingest.clean_matches(ingest.scan_csv(spark, f"{path}/{s.name}"), s.gender) for s in there]
    return ingest.union_all(frames).select("match_id", "gender", "player1", "player2", "player1_hand", "player2_hand", "date", "year", "tournament", "round", "surface", "best_of", "charted_by")


@query("SELECT match_id, pt::INT AS pt, svr, pt_winner, set1, set2, gm1, gm2, nullif(pts, '') AS pts, nullif(first_serve, '') AS first_serve, second_serve FROM points")
def ingested_points(spark, d):
    """Points as raw files in which every third match is charted again from its start, half way: the whole chart stays."""
    p = points(spark, d).select("match_id", "pt", "svr", "pt_winner", "set1", "set2", "gm1", "gm2", "pts", "first_serve", "second_serve")
    again = p.where("match_id % 3 = 0 AND pt <= 4").withColumn("ord", F.col("pt") + 1_000_000)
    raw = p.withColumn("ord", F.col("pt")).unionByName(again).withColumn("ord", F.col("match_id").cast("bigint") * 10_000_000 + F.col("ord"))
    path = store.scratch(spark, "raw-points")
    store.write_csv(raw.toDF(*[_RAW_POINT.get(c, c) for c in raw.columns]), path)
    scanned = ingest.scan_csv(spark, path, [_RAW_POINT.get(c, c) for c in raw.columns]).withColumn("ord", F.col("ord").cast("bigint"))
    return ingest.clean_points(scanned, "ord").drop("ord")


@query("SELECT 'matches' AS \"table\", count(*) AS rows, TIMESTAMP '2024-05-02 00:00:00' AS at FROM matches UNION ALL SELECT 'points', count(*), TIMESTAMP '2024-05-01 00:00:00' FROM points")
def ingestion_log(spark, d):
    """Runs appended to a JSON-lines log; the latest of each table, newest first."""
    path = store.scratch(spark, "log")
    m, p = matches(spark, d), points(spark, d)
    for run, at, tables in (("a", "2024-05-01 00:00:00", {"matches": m.limit(3), "points": p}), ("b", "2024-05-02 00:00:00", {"matches": m})):
        store.append_jsonl(ingest.run_record(spark, run, at, tables), path)
    return ingest.freshness(spark.read.schema("run_id string, at timestamp, `table` string, rows bigint").json(path))


@query("SELECT 'stored_matches' AS name, count(*) AS rows, 13::INT AS columns FROM matches UNION ALL SELECT 'stored_players', count(DISTINCT player), 1 FROM (SELECT player1 AS player FROM matches UNION ALL SELECT player2 FROM matches)")
def catalog_listing(spark, d):
    """CREATE OR REPLACE TABLE AS for two tables, then what the catalog holds."""
    m = matches(spark, d)
    store.create_table(m.limit(1), "stored_matches")
    store.create_table(m, "stored_matches")
    store.create_table(m.select(F.explode(F.array("player1", "player2")).alias("player")).distinct(), "stored_players")
    return store.catalog_info(spark, ["stored_matches", "stored_players"])


@query("SELECT match_id, player1, player2 FROM matches WHERE gender = 'M' AND year >= 1995 AND tournament = 'Wimbledon'")
def bound_query(spark, d):
    """A prepared text with bound values."""
    matches(spark, d).createOrReplaceTempView("all_matches")
    return spark.sql("SELECT match_id, player1, player2 FROM all_matches WHERE gender = :g AND year >= :y AND tournament = :t", args={"g": "M", "y": 1995, "t": "Wimbledon"})


@query("SELECT match_id, gender, player1, tournament FROM matches")
def partitioned_table(spark, d):
    """Parquet by gender, overwritten in place, read back."""
    path = store.scratch(spark, "by-gender")
    m = matches(spark, d).select("match_id", "gender", "player1", "tournament")
    store.write_parquet(m.limit(1), path, ("gender",))
    store.write_parquet(m, path, ("gender",))
    return spark.read.schema(m.schema).parquet(path).select(*m.columns)
