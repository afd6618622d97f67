"""Helpers the training-data operators share: written tables, batch bounds, dense ranks, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches of documents are kept short, so that a batch of long texts stays small.
DOC_BATCH = 128


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). A folder of our own is made only where that is unset and
    the driver is the only machine (a local master); elsewhere a missing setting is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        base = spark.conf.get("deucebase.work.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="deucebase-")
            spark.conf.set("deucebase.work.dir", base)
    return f"{base.rstrip('/')}/deucebase"


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def remove(*tables: DataFrame) -> None:
    """Delete tables of :func:`save` that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._saved_at)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def short_batches(spark: SparkSession, rows: int = DOC_BATCH) -> None:
    """Arrow batches of at most ``rows`` rows in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Called by a worker that has ended a task: memory that is free goes back to the system, as workers are used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def released(run):
    """``run`` over the batches of a task, then :func:`give_back`."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes the files of shuffles that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a dense 0-based bigint rank by ``order``, written and read back.

    The sort is by range over many partitions; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    t = save(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    sizes = sorted((r[0], r[1]) for r in t.groupBy(part.alias("p")).count().collect())
    rows, at = [], 0
    for p, n in sizes:
        rows.append((p, at))
        at += n
    offsets = spark.createDataFrame(rows, "_p bigint, _o bigint")
    low = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return t.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(name, F.col("_o") + low).drop("_p", "_o", "_mid")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a bigint, b bigint)``: rows (id, component), component the smallest id.

    Alternating star contraction: each round joins every node's neighbours to its smallest one, so the number of
    rounds grows with the logarithm of a component's diameter. All links stay in Spark tables; only one count a
    round reaches the driver. Rounds that do not end raise rather than return half-joined components.
    """
    e = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: neighbours above a node go to the smallest of the node and its neighbours
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = save(small)
        # ended when no node has two parents and no parent is itself a child
        busy = new.groupBy("a").count().where("count > 1").select("a").limit(1)
        chain = new.select(F.col("b").alias("a")).join(new.select("a"), "a", "left_semi").limit(1)
        e = new
        if busy.unionByName(chain).isEmpty():
            roots = e.select(F.col("b").alias("id")).distinct()
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
