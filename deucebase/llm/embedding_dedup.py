"""Embedding near-duplicates by PCA-ordered tiled comparison."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deucebase.llm.common import components, ranked, save

_SLACK = 1e-9
_BLOCK = 1024


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision. Scaled by the largest component first, so that nothing overflows."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.stack([r.values.to_numpy(zero_copy_only=False) for r in column]) if len(column) else np.zeros((0, dim))


def principal_axes(vectors: DataFrame, dim: int) -> np.ndarray:
    """Axes (columns) by falling variance, of the second moments of all unit vectors; dim * dim sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            if b.num_rows:
                u = unit(_matrix(b.column(0), dim))
                total += u.T @ u
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([np.arange(dim * dim, dtype=np.int64), flat], names=["k", "s"])

    parts = vectors.select("v").mapInArrow(run, "k bigint, s double").groupBy("k").agg(F.sum("s").alias("s"))
    flat = np.zeros(dim * dim)
    for k, s in parts.collect():
        flat[k] = s
    m = flat.reshape(dim, dim)
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def _leading(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = unit(_matrix(b.column(0), len(axes))) @ axes[:, 0] if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), z], names=["v", "least", "copies", "lead"])

    return run


def similar_pairs(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray, least: float, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= ``least``. ``x``, ``y``: along the axes; ``ux``, ``uy``: the unit vectors themselves.

    The products over the leading axes come first; what the others can still add is at most the product of the
    suffix norms. A pair goes on only while that bound reaches ``least``; who is left is checked on the unit vectors.
    """
    k = steps[0]

    def tail(z, at):
        return np.sqrt((z[:, at:] ** 2).sum(1))

    bound = np.column_stack([x[:, :k], tail(x, k)]) @ np.column_stack([y[:, :k], tail(y, k)]).T
    i, j = np.nonzero(bound >= least - _SLACK)
    for at in steps[1:]:
        if not len(i):
            break
        keep = np.concatenate([np.einsum("ij,ij->i", x[p, :at], y[q, :at]) + tail(x, at)[p] * tail(y, at)[q] >= least - _SLACK for p, q in _chunks(i, j)])
        i, j = i[keep], j[keep]
    if len(i):
        keep = np.concatenate([np.einsum("ij,ij->i", ux[p], uy[q]) >= least for p, q in _chunks(i, j)])
        i, j = i[keep], j[keep]
    return i, j


def _chunks(i: np.ndarray, j: np.ndarray, rows: int = 65_536):
    for k in range(0, len(i), rows):
        yield i[k : k + rows], j[k : k + rows]


def _hook(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``a`` and ``b`` in ``parent``, whose entries all stay roots of their nodes."""
    while True:
        p, q = parent[a], parent[b]
        if (p == q).all():
            return
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))
        while (parent != (up := parent[parent])).any():
            parent[:] = up


def _tiles(axes: np.ndarray, least: float):
    dim = len(axes)
    steps = tuple(sorted({max(1, dim // 4), max(1, dim // 2), dim}))

    def run(key, g):  # no hints: Spark reads them as another kind of function
        side = g["side"].to_numpy()
        raw = _matrix(g["v"].combine_chunks(), dim)
        rep, copies = g["rep"].to_numpy(), g["copies"].to_numpy()
        order = np.lexsort((rep, side))
        raw, rep, copies, side = raw[order], rep[order], copies[order], side[order]
        u = unit(raw)
        z = u @ axes
        own = not side.any()
        n = len(rep)
        cut = 0 if own else int((side == 0).sum())
        links, parent = np.zeros(n, np.int64), np.arange(n)
        for a in range(0, n if own else cut, _BLOCK):
            for b in range(a if own else cut, n, _BLOCK):
                x, y = slice(a, min(a + _BLOCK, n if own else cut)), slice(b, min(b + _BLOCK, n))
                i, j = similar_pairs(z[x], z[y], u[x], u[y], least, steps)
                i, j = i + a, j + b
                if own and a == b:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    _hook(parent, i, j)
        hit = np.flatnonzero(links)
        return pa.table({"rep": rep[hit], "links": links[hit], "root": rep[parent[hit]]})

    return run


def near_duplicates(embeddings: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tile: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Equal vectors are one class, named by its place along the first principal axis, not by an id, as rows may share
    those. The classes in that order are cut into tiles; a tile meets itself and those later ones whose first
    coordinates come within sqrt(2 - 2 * least) of its own, since no pair farther apart can reach the cosine. Every
    meeting is a task of bounded size that gives link counts and a spanning forest, never its pairs. The driver holds
    two numbers a tile, one tile for every ``tile`` vectors. All pairs that can link are compared; the result is exact.

    A vector that is null, empty, zero or holds a null or non-finite component links with nothing: n_links 0, its own
    component. So does a null id, whose row is kept. Vectors of different length never link. Repeated rows are vectors
    of their own, and rows that share an id are told apart by their vectors.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = "vec_id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)"
    rows = rows.withColumn("fine", F.coalesce(F.expr(fine), F.lit(False)))
    classes = save(rows.where("fine").groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found, named, base = None, None, 0
    for dim, n in sorted((r[0], r[1]) for r in classes.groupBy(F.size("v")).count().collect()):
        one = classes.where(F.size("v") == dim)
        axes = principal_axes(one, dim)
        led = one.select("v", "least", "copies").mapInArrow(_leading(axes), "v array<double>, least bigint, copies bigint, lead double")
        placed = save(ranked(led, [F.col("lead"), F.col("least")], "place").withColumn("tile", F.floor(F.col("place") / tile).cast("int")).withColumn("rep", F.col("place") + base))
        base += n
        ends = sorted((r[0], r[1], r[2]) for r in placed.groupBy("tile").agg(F.min("lead"), F.max("lead")).collect())
        gap = np.sqrt(2 - 2 * least) + 1e-6
        low, high = np.array([e[1] for e in ends]), np.array([e[2] for e in ends])
        reach = np.searchsorted(low, high + gap, side="right") - 1  # the last tile that tile i meets
        first = np.searchsorted(reach, np.arange(len(ends)), side="left")  # the first tile that meets tile i; reach rises
        bounds = spark.createDataFrame([(i, int(first[i]), int(reach[i])) for i in range(len(ends))], "tile int, first int, reach int")
        met = placed.join(bounds, "tile").withColumn("other", F.explode(F.sequence("first", "reach")))
        met = met.select(F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), (F.col("tile") > F.col("other")).cast("int").alias("side"), "v", "rep", "copies")
        part = met.groupBy("i", "j").applyInArrow(_tiles(axes, least), "rep bigint, links bigint, root bigint")
        found = part if found is None else found.unionByName(part)
        own = placed.select("v", "least", "copies", "rep")
        named = own if named is None else named.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = save(found)
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "rep")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    smallest = named.join(comp, "rep").groupBy("component").agg(F.min("least").alias("component_id"))
    whole = named.join(links, "rep", "left").join(comp.join(smallest, "component").select("rep", "component_id"), "rep", "left")
    whole = whole.select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    good = rows.where("fine").join(whole, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT fine").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
