"""Repairs, flags, duplicates and quality reports of the raw tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions.naming import match_id_parts

# Fixed values.
SURFACES = ("Hard", "Clay", "Grass", "Carpet")
HANDS = ("R", "L", "U")
COLUMNS = ("match_id", "player1", "player2", "player1_hand", "player2_hand", "date", "tournament", "round", "time", "court", "surface", "umpire", "best_of", "final_tb", "charted_by")


def flag_matches(matches: DataFrame) -> DataFrame:
    valid = F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False))
    qualifying = F.coalesce(F.col("round").startswith("Q") & (F.col("round") != "QF"), F.lit(False))
    return matches.withColumn("surface_valid", valid).withColumn("surface_clean", F.when(valid, F.col("surface"))).withColumn("is_qualifying", qualifying).withColumn("date_valid", F.col("date").isNotNull())


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(field, value, n) of several columns in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def points_report(points: DataFrame) -> DataFrame:
    n = lambda c, name: F.count_if(c).alias(name)
    return points.agg(
        F.count(F.lit(1)).alias("n_points"), F.countDistinct("match_id").alias("n_matches"), n(~F.col("svr").isin(1, 2), "bad_server"),
        n(F.coalesce("first_serve", F.lit("")) == "", "no_first_serve"), n(F.col("second_serve").isNotNull(), "second_serves"), n(F.col("pts") == "", "no_score"),
    )


def repair_matches(raw: DataFrame) -> DataFrame:
    """Rows that lost their player columns, and rows with a foreign value for a surface.

    A hand code in ``player1`` gives a shifted row away. If its match_id is also there intact the row goes; else it is
    rebuilt from its match_id, with hands from where the players should be and all from ``time`` on nulled; if the id
    is ambiguous it goes. A surface that is none nulls all from ``surface`` on.
    """
    shifted = F.coalesce(F.upper(F.trim("player1")).isin(*HANDS), F.lit(False))
    d = raw.withColumn("_shifted", shifted)
    intact = d.where("NOT _shifted").select(F.col("match_id").alias("_id")).distinct().withColumn("_intact", F.lit(True))
    d = d.join(intact, d["match_id"].eqNullSafe(F.col("_id")), "left").drop("_id").withColumn("_p", match_id_parts(F.col("match_id")))
    d = d.where("NOT _shifted OR (_intact IS NULL AND _p IS NOT NULL)")
    hand = lambda c: F.when(F.upper(F.trim(c)).isin(*HANDS), F.upper(F.trim(c)))
    new = {c: F.col(f"_p.{c}") for c in ("player1", "player2", "date", "tournament", "round")} | {"player1_hand": hand("player1"), "player2_hand": hand("player2")}
    tail = [c for c in COLUMNS[COLUMNS.index("time") :] if c in raw.columns]
    d = d.withColumns({c: F.when(F.col("_shifted"), v).otherwise(F.col(c)) for c, v in new.items() if c in raw.columns})
    d = d.withColumns({c: F.when(~F.col("_shifted"), F.col(c)) for c in tail})
    s = F.trim(F.coalesce("surface", F.lit("")))
    d = d.withColumn("_foreign", (s != "") & ~s.isin(*SURFACES))
    return d.withColumns({c: F.when(~F.col("_foreign"), F.col(c)) for c in COLUMNS[COLUMNS.index("surface") :] if c in raw.columns}).select(*raw.columns)


def dedupe_points(points: DataFrame, order: str) -> DataFrame:
    """One chart per match. ``order`` is the column of file order.

    A chart starts again where a match's first point number comes back after another number. The largest block stays,
    the first on a tie; rows equal in all but ``order`` go down to one; a match that still repeats a number goes.
    """
    m = Window.partitionBy("match_id")
    w = m.orderBy(order)
    d = points.withColumn("_first", F.first("pt").over(w)).withColumn("_start", ((F.col("pt") == F.col("_first")) & (F.coalesce(F.lag("pt").over(w), F.lit(-1)) != F.col("pt"))).cast("int"))
    d = d.withColumn("_block", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.count(F.lit(1)).over(Window.partitionBy("match_id", "_block"))
    d = d.withColumn("_size", size).withColumn("_best", F.max(F.struct("_size", -F.col("_block"))).over(m))
    d = d.where(F.col("_block") == -F.col("_best.col2")).select(*points.columns)
    d = d.dropDuplicates([c for c in points.columns if c != order])
    d = d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("match_id", "pt"))).withColumn("_bad", F.max("_n").over(m))
    return d.where("_bad = 1").select(*points.columns)
