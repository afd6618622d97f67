"""Replay of a landing folder: the last state of every key, kept by a streaming query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_states(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """A stream of the Parquet files that land in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(states: DataFrame, stamp: str, key: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """States per key and window; rows later than ``late`` behind the watermark are dropped, which bounds the state."""
    return states.withWatermark(stamp, late).groupBy(F.window(stamp, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", key, "n")


def first_states(states: DataFrame, keys: list[str], stamp: str, late: str = "7 days") -> DataFrame:
    """Freeze once: the first state of each key that comes in; keys older than ``late`` behind the watermark are forgotten,
    which bounds the state."""
    return states.withWatermark(stamp, late).dropDuplicatesWithinWatermark(keys)


def _versions(table: str, spark: SparkSession):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.listStatus(path) if fs.exists(path) else []
    return fs, {int(x.getPath().getName()[2:]): x.getPath() for x in found if x.getPath().getName().startswith("v=")}


def keep_last(states: DataFrame, keys: list[str], stamp: str, cols: list[str], table: str, checkpoint: str, versions: int = 3):
    """Start a query that keeps the last state of each key in the Parquet folder ``table``, batch after batch.

    Each batch writes a new version folder from the newest one before it; the newest is complete, so a batch that is run
    again does no harm. Versions beyond the last ``versions`` are removed. A batch rewrites the keys' table, which holds one
    row a key."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.max(F.struct(stamp, *cols)).alias("s"))
        fs, have = _versions(table, spark)
        before = [v for v in have if v < epoch]
        if before:
            new = new.unionByName(spark.read.parquet(f"{table}/v={max(before)}"))
        new.groupBy(*keys).agg(F.max("s").alias("s")).write.mode("overwrite").parquet(f"{table}/v={epoch}")
        for v in sorted(before)[: -(versions - 1) or None]:
            fs.delete(have[v], True)

    return states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def adopt_once(sheets: DataFrame, keys: list[str], table: str, checkpoint: str):
    """Start a query that appends rows of keys that the Parquet folder ``table`` does not have yet; a batch that is run
    again finds its own keys there and adds nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(table)
        new = batch.dropDuplicates(keys)
        if path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            new = new.join(spark.read.parquet(table).select(*keys).distinct(), keys, "left_anti")
        new.write.mode("append").parquet(table)

    return sheets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
