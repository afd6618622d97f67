"""Telling players by their performances, and the style benchmark of shot quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.operators import eras, form, reid, winprob
from deucebase.plans.entities import _counts
from deucebase.plans.registry import query
from deucebase.plans.value import _pos
from deucebase.sources.adapter import matches
from deucebase.sources.store import once


def _performances(spark, d):
    p = eras.performances(_counts(spark, d), 10, 5, 10)
    m = matches(spark, d)
    side = lambda k, o: F.struct(F.lit(k).alias("slot"), F.col(f"player{o}").alias("opponent"), F.when(F.upper(F.trim(f"player{k}_hand")).isin("R", "L"), F.upper(F.trim(f"player{k}_hand"))).otherwise("?").alias("hand"))
    meta = m.select("match_id", "charted_by", F.when(F.col("surface") == "", "?").otherwise(F.coalesce("surface", F.lit("?"))).alias("surface"), "year", F.inline(F.array(side(1, 2), side(2, 1))))
    return p.join(meta, ["match_id", "slot"])


def _embedded(spark, d, block="all"):
    rates = {"serve": eras.SERVE_RATES, "return": eras.RETURN_RATES, "rally": eras.RALLY_RATES, "response": eras.RETURN_RATES | eras.RALLY_RATES, "all": eras.PERFORMANCE_RATES}[block]
    keep = ["match_id", "slot", "gender", "player", "opponent", "hand", "charted_by", "surface", "year", "n_points"]
    return once(spark, f"embedded_{block}", d, lambda: reid.embedded(reid.capped(_performances(spark, d)).select(*keep, *rates), list(rates)))


def _hist(spark, d, label="player"):
    return once(spark, f"pairs_{label}", d, lambda: reid.pair_histogram(_embedded(spark, d), label))


@query()
def identity_blocks(spark, d):
    """Area and rank-1 share of every block of rates, and the area with shuffled names, which is a half; tests hold metric,
    area and ranks against plain versions."""
    out = None
    for block in ("serve", "return", "rally", "response", "all"):
        e = _embedded(spark, d, block)
        a = reid.auc(reid.pair_histogram(e), ["gender"])
        other = F.col("player").alias("_other")
        shuffled = e.withColumn("_k", F.row_number().over(reid.Window.partitionBy("gender").orderBy(F.xxhash64(F.lit(3), "match_id", "slot")))).select("gender", "_k", other)
        null = e.withColumn("_k", F.row_number().over(reid.Window.partitionBy("gender").orderBy(F.xxhash64(F.lit(4), "match_id", "slot")))).join(shuffled, ["gender", "_k"])
        n = reid.auc(reid.pair_histogram(null, "_other"), ["gender"]).select("gender", F.col("auc").alias("auc_null"))
        one = a.join(n, "gender").join(reid.rank1(reid.nearest(e), ["gender"]), "gender").withColumn("block", F.lit(block))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def identity_controls(spark, d):
    """The area under each control's filter."""
    return reid.control_auc(_hist(spark, d))


@query()
def identity_drift(spark, d):
    return reid.drift_auc(_hist(spark, d), 1)


@query()
def charter_probe(spark, d):
    """Does the metric tell charters apart, where it should tell players?"""
    return reid.auc(_hist(spark, d, "charted_by"), ["gender"])


@query()
def identity_by_size(spark, d):
    """Rank-1 share by how much of the match was seen."""
    near = reid.nearest(_embedded(spark, d, "response")).join(_embedded(spark, d, "response").select("match_id", "slot", "n_points"), ["match_id", "slot"])
    return reid.rank1(form.quartile_of(near, "n_points"), ["gender", "part"])


def _dist(spark, d):
    return once(spark, "player_distances", d, lambda: reid.player_distances(_embedded(spark, d, "response"), 2))


@query()
def self_and_others(spark, d):
    return reid.self_vs_other(_dist(spark, d), 1)


@query()
def confusable_players(spark, d):
    """The twelve closest crossings a gender: the report's limit."""
    return reid.confusable(_dist(spark, d))


@query()
def style_benchmark(spark, d):
    """Shot quality against what a player's style lets expect."""
    prints = eras.fingerprints(_counts(spark, d), min_points=100)
    clusters = eras.style_clusters(prints).select("gender", "player", "cluster")
    q = winprob.player_quality(winprob.shot_wpa(_pos(spark, d))).select("gender", "player", (F.col("gained") - F.col("conceded")).alias("quality"))
    rows = prints.join(clusters, ["gender", "player"]).join(q, ["gender", "player"])
    return reid.ridge_benchmark(rows, eras.RATES, "quality", "cluster")
