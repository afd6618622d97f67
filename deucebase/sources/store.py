"""Where tables are kept: the shared folder, a read-through store of what is built once, and the sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deucebase.functions.notation import coded, decoded
from deucebase.functions.score import serve_side
from deucebase.operators import coverage
from deucebase.sources.adapter import matches, points, raw_points

_BUILT: dict[tuple[str, str, str], str] = {}


def home(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only where the driver is the only machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return f"{base.rstrip('/')}/deucebase"
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: stored tables need a folder that all executors share")
    own = spark.conf.get("deucebase.store.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="deucebase-store-")
        spark.conf.set("deucebase.store.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below :func:`home`."""
    return f"{home(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Where a stage's method would be over 8,000 bytes, which the JVM leaves interpreted, operators get methods of their own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def once(spark: SparkSession, name: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read-through: the table ``name`` of input ``key``, built and written as Parquet the first time in an application,
    and again if its files are gone."""
    at = (spark.sparkContext.applicationId, name, key)
    if at in _BUILT:
        try:
            return spark.read.parquet(_BUILT[at])
        except AnalysisException:
            del _BUILT[at]
    path = scratch(spark, name)
    with compiled(spark):
        build().write.parquet(path)
    _BUILT[at] = path
    return spark.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores: a small file has few splits, and decoding is work for a core, not for the disk."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with what the decoder tells of them, strokes included: decoded once an application and then read."""
    return once(spark, "points_parsed", sf_dir, lambda: decoded(spread(points(spark, sf_dir))))


def stored_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points as :func:`points` has them, read from the stored table instead of made from line items again."""
    return parsed(spark, sf_dir).select(*points(spark, sf_dir).columns)


def stored_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, "matches", sf_dir, lambda: matches(spark, sf_dir))


def coded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points with their strokes' code, who serves and returns (``by0``, ``by1``), their hands, and the strokes' words as
    either sees them (``words0``, ``words1``); without ``pt``, which takes a sort of all line items."""
    return once(spark, "points_coded", sf_dir, lambda: _coded_rows(spark, sf_dir))


def _coded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    m = stored_matches(spark, sf_dir)
    p = raw_points(spark, sf_dir, spread_out=True).drop("pt").join(m.select("match_id", "gender", "player1", "player2", "date", "year"), "match_id")
    p = coded(p.drop("set1", "set2"))
    for k in (0, 1):
        p = p.withColumn(f"by{k}", F.when(c("server") == k + 1, c("player1")).otherwise(c("player2")))
    hands = coverage.modal_hand(m)
    for k in (0, 1):
        p = p.join(hands.select("gender", c("player").alias(f"by{k}"), c("hand").alias(f"hand{k}")), ["gender", f"by{k}"], "left")
        p = p.withColumn(f"words{k}", F.when(c(f"hand{k}") == "L", F.translate("words", "13", "31")).otherwise(c("words")))
    return p.withColumn("side", serve_side(c("pts"))).withColumn("half", F.crc32(c("match_id").cast("binary")).bitwiseAND(F.lit(1)).cast("int")).drop("words")


def parsed_points(spark: SparkSession, sf_dir: str, where: str | None = None, sample: int | None = None, seed: int = 1) -> DataFrame:
    """Decoded points, of a seeded sample of a fixed size where one is asked for; the filter comes after the sample."""
    p = parsed(spark, sf_dir)
    if sample:
        p = p.orderBy(F.md5(F.concat_ws(":", "match_id", "pt", F.lit(seed))), "match_id", "pt").limit(sample)
    return p.where(where) if where else p


def write_parquet(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; nulls are empty. ``one_file`` is for reports of a bounded size."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("emptyValue", '""').csv(path)


def create_table(df: DataFrame, name: str) -> None:
    """CREATE OR REPLACE as a view over written files: the catalog entry is swapped, readers of the old one go on."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    df.sparkSession.read.parquet(path).createOrReplaceTempView(name)


def catalog_info(spark: SparkSession, names: list[str]) -> DataFrame:
    """(name, rows, columns) of views, one count each in one union."""
    out = None
    for n in sorted(names):
        t = spark.table(n)
        one = t.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(len(t.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out
