"""Exact duplicates by deterministic block naming, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.llm.common import save


def _with_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    """doc_id, sha, row key and the text's UTF-8 bytes in blocks of ``block_bytes`` (an empty text: one empty block)."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("bin"))
    sha = F.sha2("bin", 256)
    last = F.greatest(F.ceil(F.octet_length("bin") / block_bytes), F.lit(1)) - 1
    blocks = F.transform(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")), lambda i: F.substring(F.col("bin"), i.cast("int") * block_bytes + 1, F.lit(block_bytes)))
    return d.select("doc_id", sha.alias("sha"), blocks.alias("blocks")).withColumn("row_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "sha"))


def _names(values: DataFrame, cols: list[str]) -> DataFrame:
    """Each distinct row of ``cols`` gets one integer, by its place in the order of fingerprint, then value; written, so that a lost task cannot rename."""
    d = values.select(*cols).distinct().withColumn("fp", F.xxhash64(*cols))
    # Ranges are cut on the fingerprint alone: what the driver samples for them stays small, and they come out even.
    return save(d.repartitionByRange("fp").sortWithinPartitions("fp", *cols).select(*cols, F.monotonically_increasing_id().alias("name")))


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 1024) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are cut into blocks of ``block_bytes`` bytes. Sorting the distinct blocks gives each an integer name;
    then adjacent pairs of names are named in the same way, level by level, until one name stands for the whole
    text. Two texts of a level have the same name if and only if they are equal: no name rests on a hash.

    A block whose 64-bit fingerprint occurs once in the corpus cannot equal another, so a document that holds
    one is its own group and its text is not sorted. Fingerprints only save work; they never make two texts equal.

    Defined cases: a null text counts as empty, and empty texts equal each other. Of equal texts the row with the
    largest doc_id stays (null ids come last; if all are null, keep_id is null). Of rows that repeat both id and
    text, one is kept. Rows that share an id but not the text are separate. Other columns of ``docs`` are not read.
    """
    base = _with_blocks(docs, id_col, text_col, block_bytes)
    meta = save(base.select("doc_id", "sha", "row_key", F.transform("blocks", lambda x: F.xxhash64(x)).alias("fps")))
    repeated = meta.select(F.explode("fps").alias("fp")).groupBy("fp").count().where("count > 1").select("fp", F.lit(1).alias("again"))
    fps = meta.select("row_key", F.explode("fps").alias("fp"))
    cand = save(fps.join(repeated, "fp", "left").groupBy("row_key").agg(F.min(F.coalesce("again", F.lit(0))).alias("all_again")).where("all_again = 1").select("row_key"))
    blocks = save(base.select("row_key", "blocks").join(cand, "row_key", "left_semi").select("row_key", F.posexplode("blocks").alias("pos", "block")))

    def gathered(rows: DataFrame, by: list[str]) -> DataFrame:
        named = rows.join(_names(rows, by), by).select("row_key", "pos", "name")
        got = named.groupBy("row_key").agg(F.sort_array(F.collect_set(F.struct("pos", "name"))).alias("got"))
        return save(got.select("row_key", F.col("got.name").alias("names")))

    rows, level, done = gathered(blocks, ["block"]), 0, []
    while True:
        done.append(rows.where("size(names) = 1").select("row_key", F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        active = rows.where("size(names) > 1")
        if active.isEmpty():
            break
        steps = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        pairs = F.transform(steps, lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")))
        flat = active.select("row_key", F.posexplode(pairs).alias("pos", "pair")).select("row_key", "pos", "pair.a", "pair.b")
        rows, level = gathered(flat, ["a", "b"]), level + 1
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    # Rows are counted here, not row keys: a row that is repeated counts each time.
    members = save(meta.select("doc_id", "row_key").join(named, "row_key"))
    groups = members.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    found = members.select("row_key", "level", "name").distinct().join(groups, ["level", "name"]).select("row_key", "keep_id", "group_size", F.lit(True).alias("named"))
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(0)))
    out = meta.select("doc_id", "sha", "row_key").join(found, "row_key", "left")
    out = out.withColumn("keep_id", F.when(F.col("named"), F.col("keep_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = out.withColumn("kept", kept & (nth == 1))
    return out.select("doc_id", "keep_id", F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies that :func:`name_documents` drops; same columns, rows that repeat id and text once."""
    kept = name_documents(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    d = docs.withColumn("_id", F.col(id_col)).withColumn("_sha", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))
    return d.join(kept, d["_id"].eqNullSafe(kept["_id"]) & (d["_sha"] == kept["_sha"]), "left_semi").dropDuplicates(["_id", "_sha"]).drop("_id", "_sha")
