"""Live feeds: scoreboard JSON, draw scaffolds, history of states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOREBOARD = """events array<struct<id: string, name: string, major: boolean, date: string, endDate: string, venue: struct<displayName: string>,
 groupings: array<struct<grouping: struct<slug: string>, competitions: array<struct<id: string, date: string, round: struct<displayName: string>, status: struct<type: struct<state: string, shortDetail: string>>,
 competitors: array<struct<athlete: struct<displayName: string>, flag: struct<alt: string>, winner: boolean, linescores: array<struct<value: double>>>>>>>>>>"""


def read_scoreboards(spark: SparkSession, path: str) -> DataFrame:
    """Scoreboard documents of a landing folder; malformed ones give null."""
    return spark.read.schema(SCOREBOARD).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def singles_matches(boards: DataFrame) -> DataFrame:
    """One row per singles match of the main draw: tournament, gender, round, names, winner, sets as (a, b) pairs."""
    e = boards.select(F.explode("events").alias("e"))
    g = e.select("e", F.explode("e.groupings").alias("g")).where(F.col("g.grouping.slug").isin("mens-singles", "womens-singles"))
    c = g.select("e", "g", F.explode("g.competitions").alias("c")).where(F.size("c.competitors") == 2).where(~F.coalesce(F.col("c.round.displayName"), F.lit("")).contains("Qualifying"))
    a, b = F.col("c.competitors")[0], F.col("c.competitors")[1]
    sets = F.zip_with(F.coalesce(a["linescores"], F.array()), F.coalesce(b["linescores"], F.array()), lambda x, y: F.struct(x["value"].cast("int").alias("a"), y["value"].cast("int").alias("b")))
    return c.select(
        F.col("c.id").alias("id"), F.trim(F.element_at(F.split(F.col("e.id"), "-"), 1)).alias("tournament_id"), F.col("e.name").alias("tournament"), F.when(F.col("g.grouping.slug") == "mens-singles", "M").otherwise("W").alias("gender"),
        F.col("c.round.displayName").alias("round"), F.col("c.status.type.state").alias("state"), a["athlete"]["displayName"].alias("player_a"), b["athlete"]["displayName"].alias("player_b"),
        F.when(a["winner"], 1).when(b["winner"], 2).alias("winner"), sets.alias("sets"), F.trim(F.get(F.split(F.col("e.venue.displayName"), ","), F.lit(0))).alias("city"),
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_state(df: DataFrame, keys: list[str], stamp: str, state: list[str]) -> DataFrame:
    """The latest state of every key: one aggregate with partial results, no sort of a key's history."""
    got = F.max(F.struct(stamp, *state)).alias("s")
    return df.groupBy(*keys).agg(got).select(*keys, f"s.{stamp}", *[f"s.{c}" for c in state])


def archive(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Freeze once: rows of ``fresh`` come in only where ``store`` has no such key."""
    return store.unionByName(fresh.join(store.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def prune(store: DataFrame, group: list[str], stamp: str, keep: int, tie: str) -> DataFrame:
    """The ``keep`` latest of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc(stamp), F.desc(tie))
    return store.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def slots(first_round: DataFrame, keys: list[str], size: str, slot: str = "slot") -> DataFrame:
    """Scaffold of a draw: every later round's slots, and the two that feed each. Slots are numbered from 1, so that slot
    s of a round goes on to slot (s + 1) / 2 of the next."""
    rounds = F.sequence(F.lit(1), F.log2(F.col(size)).cast("int"))
    d = first_round.select(*keys, size).distinct().select(*keys, size, F.explode(rounds).alias("round"))
    n = F.floor(F.col(size) / F.pow(F.lit(2.0), F.col("round")))
    d = d.withColumn("slot", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    return d.withColumn("feeds", F.floor((F.col("slot") + 1) / 2))
