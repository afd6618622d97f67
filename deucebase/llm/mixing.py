"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.llm.common import ranked, save

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9
_OUT = "unit bigint, src bigint, size bigint, base bigint, p double, doc_id bigint"


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, source_col: str = "source") -> DataFrame:
    """One row per source: source, src (rank by code point, null last), source_size, n_docs, target.

    The sources share ``share`` times all sizes by weight; a target stops at ``most`` times its source's size and
    the excess is shared again by weight until none is above. Each round is one aggregate over the sources.
    """
    totals = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    t = save(ranked(totals, [F.col("source").asc_nulls_last()], "src").withColumn("weight", w))
    cap = F.col("source_size") * most
    whole = t.agg(F.sum("source_size")).first()[0] or 0
    rate, before = 0.0, -1
    while True:  # ends: a source that is capped stays capped, as the rate only rises
        full = F.col("weight") * rate >= cap
        r = t.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.sum(full.cast("int"))).first()
        if r[1] is None or r[2] == before:
            break
        rate, before = (share * whole - (r[0] or 0.0)) / r[1], r[2]
    return t.select("source", "src", "source_size", "n_docs", F.least(F.col("weight") * rate, cap).alias("target"))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase of the cube method, balanced on the count and the size.

    Three open units span a null space of the two constraints; the walk goes along it, either way with the
    probability that keeps each unit's expectation, until a unit reaches 0 or 1. Two units at most stay open.
    """
    p = p.astype(float).copy()
    draws = rng.random(len(p) + 1)
    open_, n = [], 0
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(open_, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, p[k] / -v), min(down, (1 - p[k]) / -v)
        step = up if draws[n] * (up + down) < down else -down
        n += 1
        for k, v in zip(open_, u, strict=True):
            p[k] += step * v
        still = [k for k in open_ if _EPS < p[k] < 1 - _EPS]
        for k in open_:
            if k not in still:
                p[k] = round(p[k])
        open_ = still
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of all ways to take the open units (14 at most), the one whose size and then count come nearest to their expectation."""
    p = p.copy()
    left = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(left):
        ways = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        miss = np.abs(ways @ size[left] - p[left] @ size[left])
        off = np.abs(ways.sum(1) - p[left].sum())
        p[left] = ways[np.lexsort((off, miss))[0]]
    return np.round(p)


def walk(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, last: bool, tail: int = 12) -> np.ndarray:
    """One block, largest sizes first. The last block of a source keeps ``tail`` units, spread evenly over the smaller half
    of its sizes, for the landing: their sums are dense around any miss that the two open units leave. Other blocks hand
    four such units up, so that the last one has enough of them."""
    held = np.unique(np.linspace(len(p) // 2, len(p) - 1, tail if last else 4).astype(int)) if len(p) else np.zeros(0, int)
    rest = np.setdiff1d(np.arange(len(p)), held)
    p = p.astype(float)
    p[rest] = flight(p[rest], size[rest], rng)
    return landing(p, size) if last else p


def _walk(seed: int, last: bool):
    def run(key, g):  # no hints: Spark reads them as another kind of function
        g = g.select(["unit", "src", "size", "base", "p", "doc_id"]).sort_by([("size", "descending"), ("unit", "ascending"), ("doc_id", "ascending")])
        rng = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
        return g.set_column(4, "p", pa.array(walk(g["p"].to_numpy(), g["size"].to_numpy(), rng, last)))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken, copies.

    A source at target t takes each of its documents t / size times on average: the whole part always, the rest
    by balanced sampling with equal probabilities. The flight phase runs in blocks of about ``block`` documents
    of one source; the at most six documents that each leaves open meet in blocks of the next level, until one
    block a source is left. A dozen of its units and the two that stay open are the landing problem, solved by trying
    every way, so a source's total misses its target by a part of a small document.

    Blocks follow a hash of doc_id, size and text (``unit``) and every block has its own seeded generator, so reruns agree on any
    cluster. A source with a third of all rows is just more blocks. Null or empty text: size 0, taken 0. A null
    source is a source, last in order. Rows that repeat an id are units of their own. No rows in: no rows out.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    sized = save(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), _unit(seed, id_col, text_col).alias("unit")))
    targets = save(source_targets(sized, weights, share, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    small = targets.select("source", "src", "n_docs", rate.alias("rate"))
    units = sized.join(small, sized["source"].eqNullSafe(small["source"])).select(
        "unit", "src", "size", F.floor("rate").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), "doc_id", "n_docs"
    )
    units = units.withColumn("block", F.pmod("unit", F.ceil(F.col("n_docs") / block)))
    blocks = targets.agg(F.max(F.ceil(F.col("n_docs") / block))).first()[0] or 1
    done = []
    while True:
        last = blocks <= 1
        out = units.groupBy("src", "block").applyInArrow(_walk(seed, last), _OUT)
        out = save(out.withColumn("is_open", (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)))
        done.append(out.where("NOT is_open"))
        if last:
            break
        blocks = -(-blocks // (block // 6))
        units = out.where("is_open").drop("is_open").withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.lit(blocks)))
    rows = done[0]
    for d in done[1:]:
        rows = rows.unionByName(d)
    back = targets.select("src", "source_size", "target")
    copies = (F.col("base") + F.round("p")).cast("bigint")
    return rows.join(back, "src").select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("src").alias("source_rank"), "unit")


def _unit(seed: int, id_col: str, text_col: str) -> Column:
    """Name of a row for the draw: rows that share or lack an id are told apart by their text."""
    return F.xxhash64(F.lit(seed), F.col(id_col).cast("bigint"), F.col(text_col))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 11, **how) -> DataFrame:
    """``docs`` as the mix takes them: a document that it takes twice is there twice, one that it doesn't take is not.

    Null and empty texts have size 0 and are drawn at their source's rate like any other. Rows equal in id and text share
    their counts out among themselves. An empty table gives an empty one; all columns stay.
    """
    taken = mix(docs, seed=seed, id_col=id_col, text_col=text_col, **how).groupBy("unit").agg(F.sort_array(F.collect_list("copies")).alias("_c"))
    both = docs.withColumn("_unit", _unit(seed, id_col, text_col)).join(taken.withColumnRenamed("unit", "_mixed"), F.col("_unit") == F.col("_mixed"))
    nth = F.row_number().over(Window.partitionBy("_unit").orderBy(F.lit(0)))
    both = both.withColumn("_n", F.element_at("_c", nth)).where("_n > 0")
    return both.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(*docs.columns)
