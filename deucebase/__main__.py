"""Jobs: python -m deucebase JOB SOURCE TARGET. Each reads whole tables and writes whole tables."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deucebase.functions.notation import decoded
from deucebase.operators import cleaning, coverage, eras, gold
from deucebase.sources import ingest, store


def run_ingest(spark: SparkSession, source: str, target: str) -> None:
    """CSV files of ``source`` to clean Parquet tables, and a line in the log."""
    there = ingest.present(spark, source, ingest.all_sources())
    tables = {}
    for kind in ("matches", "points"):
        frames = []
        for s in (x for x in there if x.kind == kind):
            raw = ingest.scan_csv(spark, f"{source}/{s.name}")
            if kind == "points":
                raw = raw.withColumn("_order", F.monotonically_increasing_id())  # file order within a file
            frames.append(ingest.clean_matches(raw, s.gender) if kind == "matches" else ingest.clean_points(raw, "_order").drop("_order"))
        if frames:
            store.write_parquet(ingest.union_all(frames), f"{target}/{kind}")
            tables[kind] = spark.read.parquet(f"{target}/{kind}")
    if tables:
        now = spark.sql("SELECT cast(current_timestamp() AS string)").first()[0]
        store.append_jsonl(ingest.run_record(spark, spark.sparkContext.applicationId, now, tables), f"{target}/log")


def run_shots(spark: SparkSession, source: str, target: str) -> None:
    """Points with all that the decoder tells of them."""
    store.write_parquet(decoded(store.spread(spark.read.parquet(f"{source}/points"))), f"{target}/points_parsed")


def run_eras(spark: SparkSession, source: str, target: str) -> None:
    """The eras of every player of enough points."""
    m = spark.read.parquet(f"{source}/matches").select("match_id", "gender", "player1", "player2", "year")
    p = spark.read.parquet(f"{source}/points_parsed").drop("gender", "player1", "player2", "year").join(m, "match_id")
    store.write_parquet(eras.career_eras(eras.year_fingerprints(eras.counters(p, ("match_id", "pt", "gender", "year")))), f"{target}/player_eras")


def run_report(spark: SparkSession, source: str, target: str) -> None:
    """Quality and coverage reports in Markdown."""
    m, p = spark.read.parquet(f"{source}/matches"), spark.read.parquet(f"{source}/points")
    text = gold.markdown(cleaning.points_report(p), "Points") + "\n" + gold.markdown(coverage.summary(m), "Coverage") + "\n" + gold.markdown(coverage.slam_coverage(m).orderBy("year", "event", "gender"), "Grand Slams")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{target}/report")


JOBS = {"ingest": run_ingest, "shots": run_shots, "eras": run_eras, "report": run_report}


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__)
    a.add_argument("job", choices=JOBS)
    a.add_argument("source")
    a.add_argument("target")
    o = a.parse_args()
    JOBS[o.job](SparkSession.builder.appName(f"deucebase-{o.job}").getOrCreate(), o.source, o.target)


if __name__ == "__main__":
    main()
