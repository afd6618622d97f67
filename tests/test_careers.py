"""Careers: cuts, eras, clusters, drift, against plain versions."""

import math

import numpy as np
import pytest

from deucebase.operators import eras, tendencies


def test_contiguous_cuts():
    r = np.random.default_rng(2)
    for _ in range(200):
        n, k = r.integers(1, 60, int(r.integers(1, 12))).astype(float), int(r.integers(1, 5))
        want, cur, acc, cut = [], [], 0.0, n.sum() / k
        for i, x in enumerate(n):
            cur.append(i)
            acc += x
            if acc >= cut - 1e-9 and len(want) < k - 1:
                want.append(cur)
                cur, cut = [], cut + n.sum() / k
        want = [c for c in [*want, cur] if c]
        got = [list(range(s.start, s.stop)) for s in eras.contiguous(n, k)]
        assert [i for c in got for i in c] == list(range(len(n)))
        if all(len(c) for c in want) and n.max() <= n.sum() / k:  # a year heavier than an era shifts the plain version's cuts
            assert got == want


def test_a_changed_career_splits_and_a_steady_one_does_not(spark):
    r = np.random.default_rng(4)
    rows = []
    for name, jump in [("Changer", 0.3), *((f"Steady {i}", 0.0) for i in range(6))]:
        for y in range(2000, 2012):
            base = [0.4 + (jump if y > 2005 else 0) + 0.02 * r.standard_normal()] * len(eras.YEAR_RATES)
            rows.append(("M", name, y, 500, *[float(b) + 0.01 * r.standard_normal() for b in base]))
    schema = "gender string, player string, year int, n bigint, " + ", ".join(f"{k} double" for k in eras.YEAR_RATES)
    got = eras.career_eras(spark.createDataFrame(rows, schema), ratio=2.5).toPandas()
    split = got[got["n_eras"] > 1]
    assert set(split["player"]) == {"Changer"} and list(split.sort_values("era")[["year_start", "year_end"]].itertuples(index=False, name=None)) == [(2000, 2005), (2006, 2011)]
    names = spark.createDataFrame([(e,) for e in got["entity"]], "e string").select(eras.base_name(eras.F.col("e"))).collect()
    assert {x[0] for x in names} == set(got["player"])
    points = spark.createDataFrame([("M", "Changer", 2001), ("M", "Changer", 2010), ("M", "Changer", None), ("M", "Steady 1", 2001)], "gender string, player string, year int")
    assert [x["entity"] for x in eras.with_entity(points, spark.createDataFrame(got)).orderBy("player", "year").collect()] == ["Changer", "Changer (2000–2005)", "Changer (2006–2011)", "Steady 1"]  # noqa: RUF001


def test_collapse_keeps_the_last_known_value(spark):
    df = spark.createDataFrame([("M", "a", 2001, 10, 1.0, 5.0), ("M", "a", 2005, 30, None, 1.0), ("M", "b", 2000, 5, None, None)], "gender string, player string, year_end int, n bigint, x double, y double")
    got = {r["player"]: (r["x"], r["y"], r["n"]) for r in eras.collapsed(df, ["x"], ["y"]).collect()}
    assert got == {"a": (1.0, 2.0, 40), "b": (None, None, 5)}


def test_clusters_find_planted_groups(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((3, len(eras.RATES))) * 4
    rows = [("W", f"p{i:02d}", 100, *(centres[i % 3] + 0.2 * r.standard_normal(len(eras.RATES))).tolist()) for i in range(45)]
    schema = "gender string, player string, n bigint, " + ", ".join(f"{k} double" for k in eras.RATES)
    got = eras.style_clusters(spark.createDataFrame(rows, schema), k=3).toPandas().sort_values("player")
    assert len({(i % 3, c) for i, c in enumerate(got["cluster"])}) == 3
    assert got["silhouette"].min() > 0.5


def test_silhouettes_against_the_definition():
    r = np.random.default_rng(3)
    z, label = r.standard_normal((20, 3)), r.integers(0, 3, 20)
    got = eras.silhouettes(z, label)
    for i in range(20):
        d = [math.dist(z[i], z[j]) for j in range(20)]
        own = [d[j] for j in range(20) if label[j] == label[i] and j != i]
        if own:
            a = sum(own) / len(own)
            b = min(np.mean([d[j] for j in range(20) if label[j] == k]) for k in set(label.tolist()) - {label[i]})
            assert got[i] == pytest.approx((b - a) / max(a, b))


def test_profile_distance():
    a, b = np.array([[50.0, 30, 20], [10, 10, 10]]), np.array([[20.0, 30, 50], [40, 40, 40]])
    assert tendencies.tvd(a, b) == pytest.approx(0.3) and math.isnan(tendencies.tvd(a[1:], b[1:]))
    assert tendencies.biggest_move(a, b) == "deuce wide 50%→20%"


def test_drift_tells_order_from_chance(spark):
    r = np.random.default_rng(7)
    rows = []
    for name, move in (("mover", 0.5), ("stayer", 0.0)):
        for m in range(60):
            wide = 0.2 + (move if m >= 30 else 0)
            for side in ("deuce", "ad"):
                c4 = int(r.binomial(20, wide))
                rows.append((f"{name}{m:03d}", "M", name, None, 1990 + m // 5, side, 1, c4, (20 - c4) // 2, 20 - c4 - (20 - c4) // 2, 20))
    df = spark.createDataFrame(rows, "match_id string, gender string, player string, date date, year int, side string, snum int, c4 bigint, c5 bigint, c6 bigint, n bigint")
    got = {r["player"]: r for r in tendencies.drift(df).collect()}
    assert got["mover"]["ratio"] > 3 and got["mover"]["moved"] and got["stayer"]["ratio"] < 2
