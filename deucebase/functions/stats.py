"""Multiple-testing windows as Columns; exact tails as Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bh(df: DataFrame, p: str, family: list[str], tie: list[str], name: str = "q") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within each family."""
    w = Window.partitionBy(*family)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(p, *tie))).withColumn("_m", F.count(F.lit(1)).over(w))
    back = w.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(back))).drop("_r", "_m")


def holm(df: DataFrame, p: str, family: list[str], tie: list[str], name: str = "q") -> DataFrame:
    w = Window.partitionBy(*family)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(p, *tie))).withColumn("_m", F.count(F.lit(1)).over(w))
    on = w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(name, F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col(p)).over(on))).drop("_r", "_m")


def upper_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial: terms by their ratio, from the largest one out."""
    if k <= 0:
        return 1.0
    if k > n or p <= 0:
        return 0.0
    if p >= 1:
        return 1.0
    top = max(k, min(n, int((n + 1) * p)))
    term = math.exp(math.lgamma(n + 1) - math.lgamma(top + 1) - math.lgamma(n - top + 1) + top * math.log(p) + (n - top) * math.log1p(-p))
    total, t, i = term, term, top
    while i < n and t > total * 1e-17:
        t *= (n - i) / (i + 1) * p / (1 - p)
        i += 1
        total += t
    t, i = term, top
    while i > k and t > total * 1e-17:
        t *= i / (n - i + 1) * (1 - p) / p
        i -= 1
        total += t
    return min(1.0, total)


@F.pandas_udf(DoubleType())
def binom_tail(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([upper_tail(int(a), int(b), float(c)) for a, b, c in zip(k, n, p, strict=True)])


def two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of one table: all tables with its margins that are as unlikely, or more.

    Weights of the tables follow from each other by ratios, in logs from the given one out. Where a weight is about that
    of the given table, whole numbers decide, so that ties count."""
    r, s, t = a + b, c + d, a + c
    low, high = max(0, t - s), min(r, t)
    x = np.arange(low, high, dtype=np.float64)
    up = np.log((r - x) * (t - x)) - np.log((x + 1) * (s - t + x + 1))  # log of the weight of x + 1 over that of x
    logs = np.concatenate([-np.cumsum(up[: a - low][::-1])[::-1], [0.0], np.cumsum(up[a - low :])])

    def as_unlikely(k: int) -> bool:
        steps = range(min(a, k), max(a, k))
        rise, fall = math.prod((r - i) * (t - i) for i in steps), math.prod((i + 1) * (s - t + i + 1) for i in steps)
        return rise <= fall if k > a else fall <= rise

    tail = logs < 0
    for i in np.flatnonzero(np.abs(logs) < 1e-7):
        tail[i] = as_unlikely(low + int(i))
    w = np.exp(logs - logs.max())
    return float(min(1.0, w[tail].sum() / w.sum()))


@F.pandas_udf(DoubleType())
def fisher_two_sided(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([two_sided(*map(int, x)) for x in zip(a, b, c, d, strict=True)])


@F.pandas_udf(DoubleType())
def norm_sf(z: pd.Series) -> pd.Series:
    return z.map(lambda x: 0.5 * math.erfc(x / math.sqrt(2)))
