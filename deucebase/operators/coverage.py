"""Coverage reports: what is charted, by player, year, event and round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deucebase.functions.naming import canon_masters_event, classify_tier, event_base

# Matches per round of a slam's main draw, and of a 1000's late rounds.
SLAM_ROUNDS = {"R128": 64, "R64": 32, "R32": 16, "R16": 8, "QF": 4, "SF": 2, "F": 1}
LATE_ROUNDS = {"R16": 8, "QF": 4, "SF": 2, "F": 1}


def sides(df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Each match once per player."""
    return df.select(*keep, F.explode(F.array("player1", "player2")).alias("player"))


def charted(matches: DataFrame, points: DataFrame, by: tuple[str, ...] = ("gender", "player")) -> DataFrame:
    """Matches, points and first and last year per group; points are counted per match before the join."""
    n = points.where("svr IN (1, 2) AND pt_winner IN (1, 2)").groupBy("match_id").agg(F.count(F.lit(1)).alias("n"))
    m = sides(matches.join(n, "match_id"), ("match_id", "gender", "year", "n"))
    m = m.where("year IS NOT NULL") if "year" in by else m
    return m.groupBy(*by).agg(F.count(F.lit(1)).alias("n_matches"), F.sum("n").alias("n_points"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def summary(matches: DataFrame) -> DataFrame:
    m = matches.withColumn("tier", classify_tier(F.col("tournament"), F.col("gender")))
    players = sides(matches, ("gender",)).agg(F.countDistinct("gender", "player").alias("n_players"))
    one = m.agg(
        F.count(F.lit(1)).alias("n_matches"), F.countDistinct("tournament").alias("n_events"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.sum((F.col("gender") == "M").cast("int")).alias("n_men"), F.bround(100 * F.avg((F.col("tier") != "Other / Unknown").cast("int")), 1).alias("pct_classified"),
    )
    return one.join(F.broadcast(players))  # one row on either side


def slam_coverage(matches: DataFrame, since: int = 1990, full: int = 127) -> DataFrame:
    m = matches.where(F.col("year") >= since).where(classify_tier(F.col("tournament"), F.col("gender")) == "Grand Slam").where(F.col("round").isin(*SLAM_ROUNDS))
    n = m.groupBy("year", event_base(F.col("tournament")).alias("event"), "gender").agg(F.countDistinct("match_id").alias("charted"))
    return n.withColumn("pct", F.least(F.lit(100.0), F.bround(100.0 * F.col("charted") / full, 1)))


def _sizes(spark: SparkSession, rounds: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(r, n, i) for i, (r, n) in enumerate(rounds.items())], "round string, size int, ord int")


def round_grid(charted: DataFrame, rounds: dict[str, int], keys: tuple[str, ...]) -> DataFrame:
    """Every draw in every round, with 0 where nothing is charted. The rounds are a fixed handful."""
    draws = charted.select(*keys).distinct()
    grid = draws.crossJoin(F.broadcast(_sizes(charted.sparkSession, rounds)))
    n = charted.groupBy(*keys, "round").agg(F.countDistinct("match_id").alias("n"))
    return grid.join(n, [*keys, "round"], "left").withColumn("charted", F.coalesce("n", F.lit(0))).withColumn("pct", F.least(F.lit(100.0), F.bround(100.0 * F.col("charted") / F.col("size"), 1))).drop("n", "ord")


def slam_round_coverage(matches: DataFrame) -> DataFrame:
    m = matches.where(classify_tier(F.col("tournament"), F.col("gender")) == "Grand Slam").where(F.col("round").isin(*SLAM_ROUNDS))
    return round_grid(m, SLAM_ROUNDS, ("year", "gender"))


def round_completion(matches: DataFrame, tier: str, rounds: dict[str, int], event) -> DataFrame:
    """Charted matches of a round over what all draws with any charted match hold."""
    m = matches.where(classify_tier(F.col("tournament"), F.col("gender")) == tier).where(F.col("round").isin(*rounds)).withColumn("event", event)
    draws = m.groupBy("gender").agg(F.countDistinct("year", "event").alias("draws"))
    n = m.groupBy("gender", "round").agg(F.countDistinct("match_id").alias("charted"))
    j = n.join(draws, "gender").join(F.broadcast(_sizes(matches.sparkSession, rounds)), "round")
    return j.select("gender", "round", "charted", "draws", F.bround(100.0 * F.col("charted") / (F.col("draws") * F.col("size")), 1).alias("pct"))


def masters_coverage(matches: DataFrame, full: int = 15) -> DataFrame:
    m = matches.where(classify_tier(F.col("tournament"), F.col("gender")) == "Masters / WTA 1000").where(F.col("round").isin(*LATE_ROUNDS))
    n = m.groupBy("year", canon_masters_event(F.col("tournament")).alias("event"), "gender").agg(F.countDistinct("match_id").alias("charted"))
    return n.withColumn("pct", F.least(F.lit(100.0), F.bround(100.0 * F.col("charted") / full, 1)))


def modal_hand(matches: DataFrame, by: tuple[str, ...] = ("gender", "player")) -> DataFrame:
    """A player's most frequent hand, R before L on a tie; unknown hands have no vote."""
    votes = F.array(*[F.struct(F.col(f"player{k}").alias("player"), F.upper(F.trim(F.col(f"player{k}_hand"))).alias("hand")) for k in (1, 2)])
    v = matches.select("gender", F.inline(votes)).where(F.col("hand").isin("R", "L")).groupBy(*by).agg(F.sum((F.col("hand") == "R").cast("int")).alias("r"), F.sum((F.col("hand") == "L").cast("int")).alias("l"))
    return v.select(*by, F.when(F.col("r") >= F.col("l"), "R").otherwise("L").alias("hand"), (F.col("r") + F.col("l")).alias("votes"))


def masters_round_coverage(matches: DataFrame) -> DataFrame:
    """The upper level's late rounds by year and tour, with 0 where nothing is charted."""
    m = matches.where(classify_tier(F.col("tournament"), F.col("gender")) == "Masters / WTA 1000").where(F.col("round").isin(*LATE_ROUNDS))
    return round_grid(m, LATE_ROUNDS, ("year", "gender"))
