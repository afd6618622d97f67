"""Raw files to clean tables: catalogue, CSV scans, header names, tolerant casts, ingestion log."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from deucebase.operators.cleaning import dedupe_points, repair_matches

# What stands for a missing value in the files, and the files of the corpus.
NULLS = ("", "NA", "N/A", "nan", "NaN", "null", "NULL", "None", "n/a", "<NA>", "#N/A")
GENDERS = {"M": "m", "W": "w"}
DECADES = ("to-2009", "2010s", "2020s")
MATCH_COLUMNS = {"Player 1": "player1", "Player 2": "player2", "Pl 1 hand": "player1_hand", "Pl 2 hand": "player2_hand", "Best of": "best_of", "Final TB?": "final_tb", "Charted by": "charted_by"}
POINT_COLUMNS = {"Pt": "pt", "Set1": "set1", "Set2": "set2", "Gm1": "gm1", "Gm2": "gm2", "Pts": "pts", "Svr": "svr", "1st": "first_serve", "2nd": "second_serve", "PtWinner": "pt_winner", "TbSet": "tb_set"}


@dataclass(frozen=True)
class Source:
    """A file of the corpus: what it holds, whose, and its name."""

    kind: str
    gender: str
    name: str


def all_sources(what: str = "all") -> list[Source]:
    """Two tours, each with a file of matches and one of points a decade."""
    found = []
    for g, short in GENDERS.items():
        found.append(Source("matches", g, f"charting-{short}-matches.csv"))
        found += [Source("points", g, f"charting-{short}-points-{d}.csv") for d in DECADES]
        found.append(Source("stats", g, f"charting-{short}-stats-Overview.csv"))
    return [s for s in found if what in ("all", s.kind)]


def present(spark: SparkSession, folder: str, sources: list[Source]) -> list[Source]:
    """Those whose file is there; the others are skipped. Any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = lambda s: jvm.org.apache.hadoop.fs.Path(f"{folder}/{s.name}")
    return [s for s in sources if (p := path(s)).getFileSystem(conf).exists(p)]


def scan_csv(spark: SparkSession, path: str | list[str], columns: list[str] | None = None) -> DataFrame:
    """All columns as text: "6" stays "6". Short rows are padded with nulls; NULLS are null. With ``columns`` the schema is
    pinned and no file is read ahead."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"')
    if columns:
        r = r.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = r.csv(path)
    return df.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NULLS), F.col(f"`{c}`")).alias(c) for c in df.columns])


def slug(name: str) -> str:
    """A header as an identifier: lower case, anything else than letters and digits an underscore."""
    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def rename(df: DataFrame, known: dict[str, str]) -> DataFrame:
    """Known headers by the map, all others by :func:`slug`."""
    return df.toDF(*[known.get(c.strip(), slug(c)) for c in df.columns])


def to_int(c: Column) -> Column:
    """Whole numbers of any notation; anything else is null."""
    v = F.trim(c).try_cast("double")
    return F.when(v == F.floor(v), v).try_cast("int")


def to_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "t", "yes", "1"), True).when(t.isin("false", "f", "no", "0"), False)


def to_date(c: Column) -> Column:
    """yyyymmdd or ISO; a wrong date is null."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{8}$"), F.try_to_date(t, "yyyyMMdd")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))


def clean_matches(raw: DataFrame, gender: str) -> DataFrame:
    """Repair, casts and the derived year of a scan of matches."""
    d = repair_matches(rename(raw, MATCH_COLUMNS))
    d = d.withColumn("date", to_date(F.col("date")))
    casts = {"best_of": to_int(F.col("best_of"))} if "best_of" in d.columns else {}
    return d.withColumns({**casts, "gender": F.lit(gender), "year": F.year("date")})


def clean_points(raw: DataFrame, order: str) -> DataFrame:
    """Casts and one chart a match. ``order``: the column of file order."""
    d = rename(raw, POINT_COLUMNS | {order: order})
    whole = [c for c in ("pt", "set1", "set2", "gm1", "gm2", "svr", "pt_winner") if c in d.columns]
    return dedupe_points(d.withColumns({c: to_int(F.col(c)) for c in whole}).where("match_id IS NOT NULL AND pt IS NOT NULL"), order)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Frames of differing columns; what one lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def run_record(spark: SparkSession, run_id: str, at: str, tables: dict[str, DataFrame]) -> DataFrame:
    """A row of the ingestion log for each table: what was read, when, how much."""
    return union_all([t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(run_id).alias("run_id"), F.lit(at).cast("timestamp").alias("at"), F.lit(n).alias("table"), "rows") for n, t in tables.items()])


def freshness(log: DataFrame) -> DataFrame:
    """The latest record of every table, newest first, tables never read last."""
    last = log.groupBy("table").agg(F.max(F.struct("at", "rows")).alias("m"))
    return last.select("table", F.col("m.at").alias("at"), F.col("m.rows").alias("rows")).orderBy(F.desc_nulls_last("at"), "table")
