"""Score, name, test and tree functions against literals and properties."""

import random

import pytest
from pyspark.sql import functions as F

from deucebase.functions import naming, score, stats
from deucebase.operators import cleaning, matchwp


def test_serve_side(spark):
    """Every pair of game tokens, tiebreak numbers, and pairs with something else in them."""
    done = dict(zip(score.TOKENS, range(5), strict=True))
    games = [(f"{a}-{b}", "deuce" if (done[a] + done[b]) % 2 == 0 else "ad") for a in done for b in done]
    r = random.Random(3)
    breaks = [(f"{a}-{b}", "deuce" if (a + b) % 2 == 0 else "ad") for a, b in ((r.randrange(1, 13), r.randrange(1, 13)) for _ in range(30))]
    odd = [(f"{a}{sep}{b}", "na") for a in ("15", "Z", "") for b in ("q", "") for sep in ("-", " ", "")] + [("0-0-0", "na"), (None, "na")]
    df = spark.createDataFrame(games + breaks + odd, "pts string, want string")
    for x in df.select("pts", "want", score.serve_side(F.col("pts")).alias("got")).collect():
        assert x["got"] == x["want"], x


def test_tiers_and_keys(spark):
    rows = [("Wimbledon ", "M", "Grand Slam", "wimbledon"), ("Rome Masters", "M", "Masters / WTA 1000", "rome"), ("Dubai", "W", "Masters / WTA 1000", "dubai"), ("Dubai", "M", "Tour (250/500)", "dubai"), ("Davis Cup WG", "M", "Team / Other Event", "davis cup wg"), (None, "M", "Other / Unknown", ""), ("French Open", "W", "Grand Slam", "roland garros"), ("Montreal", "M", "Tour (250/500)", "canada")]
    df = spark.createDataFrame(rows, "t string, g string, tier string, key string")
    for r in df.select("*", naming.classify_tier(F.col("t"), F.col("g")).alias("a"), naming.tourn_key(F.col("t")).alias("b"), naming.normalize_name("t").alias("c")).collect():
        assert (r["a"], r["b"]) == (r["tier"], r["key"])
    assert spark.createDataFrame([("Gaël  Mon-fils Jr.",)], "n string").select(naming.normalize_name("n")).first()[0] == "gael mon fils jr"


def test_repair(spark):
    cols = "match_id string, player1 string, player2 string, player1_hand string, player2_hand string, date string, tournament string, round string, time string, surface string, umpire string, best_of string"
    rows = [
        ("20200101-M-Rome-F-A_B-C_D", "A B", "C D", "R", "L", "20200101", "Rome", "F", "10", "Clay", "U", "3"),
        ("20200101-M-Rome-F-A_B-C_D", "R", "L", "20200101", "Rome", "F", "10", "Clay", "U", "3", None, None),
        ("20200102-W-Rome-SF-E_F-G_H", "R", "L", "20200102", "Rome", "SF", "10", "Clay", "U", "3", None, None),
        ("20200103-W-Rome-SF-E-F-G_H", "L", "R", "x", "y", "z", "10", "Clay", "U", "3", None, None),
        ("20200104-W-Rome-QF-I_J-K_L", "I J", "K L", "R", "R", "20200104", "Rome", "QF", "10", "Eva A", "3", "1"),
    ]
    got = {r["match_id"]: r for r in cleaning.repair_matches(spark.createDataFrame(rows, cols)).collect()}
    assert set(got) == {rows[0][0], rows[2][0], rows[4][0]}
    r = got[rows[2][0]]
    assert (r["player1"], r["player2"], r["player1_hand"], r["player2_hand"], r["round"], r["time"], r["surface"]) == ("E F", "G H", "R", "L", "SF", None, None)
    assert got[rows[4][0]]["surface"] is None and got[rows[4][0]]["best_of"] is None and got[rows[4][0]]["player1"] == "I J"


def test_dedupe(spark):
    rows = [("a", p, x, i) for i, (p, x) in enumerate([(1, "p"), (2, "q"), (3, "r"), (1, "p"), (2, "q"), (2, "q")])] + [("b", 1, "x", 10), ("b", 2, "y", 11), ("b", 2, "z", 12)]
    got = cleaning.dedupe_points(spark.createDataFrame(rows, "match_id string, pt int, v string, ord int"), "ord").collect()
    assert sorted((r["match_id"], r["pt"]) for r in got) == [("a", 1), ("a", 2), ("a", 3)]


def _after(t, state, won):
    """The score after a point, by the rules alone; 1 or 0 at the end of the match."""
    s1, s2, g1, g2, a, b, serves, tie, first = state
    a, b = (a + 1, b) if won else (a, b + 1)
    final = s1 == s2 == t["need"] - 1
    target = (t["target"] if final else 7) if tie else 4
    if max(a, b) < target or abs(a - b) < 2:
        if tie and (a + b) % 2 == 1:
            serves = not serves
        return (s1, s2, g1, g2, a, b, serves, tie, first)
    if not tie:
        g1, g2 = (g1 + 1, g2) if a > b else (g1, g2 + 1)
    over = tie or max(g1, g2) >= 6 and abs(g1 - g2) >= 2
    if over:
        s1, s2 = (s1 + 1, s2) if (a > b) else (s1, s2 + 1)
        return float(s1 > s2) if max(s1, s2) == t["need"] else (s1, s2, 0, 0, 0, 0, not first, False, not first)
    starts = (not first) if (g1 + g2) % 2 else first
    return (s1, s2, g1, g2, 0, 0, starts, g1 == g2 == (t["games"] if final else 6), first)


@pytest.mark.parametrize(("p1", "p2", "best_of", "games", "target"), [(0.61, 0.66, 3, 6, 7), (0.7, 0.58, 5, 12, 7), (0.55, 0.57, 3, 6, 10)])
def test_match_tree_along_walks(p1, p2, best_of, games, target):
    """Along random matches: the chance is the mean of the chances after the point, leverage their difference."""
    tree = matchwp.tree(p1, p2, best_of, games, target)
    rules = {"need": best_of // 2 + 1, "games": games, "target": target}
    value = lambda s: s if isinstance(s, float) else tree.live(*s[:8])[0]
    r = random.Random(best_of)
    for _ in range(25):
        first = r.random() < 0.5
        state = (0, 0, 0, 0, 0, 0, first, False, first)
        while not isinstance(state, float):
            w = p1 if state[6] else 1 - p2
            up, down = value(_after(rules, state, True)), value(_after(rules, state, False))
            now, leverage = tree.live(*state[:8])
            assert now == pytest.approx(w * up + (1 - w) * down, abs=1e-9) and leverage == pytest.approx(up - down, abs=1e-9)
            state = _after(rules, state, r.random() < w)


def test_equal_players_are_even():
    for best_of in (3, 5):
        assert matchwp.tree(0.64, 0.64, best_of).before() == pytest.approx(0.5)
    assert matchwp.tree(0.66, 0.6, 5).before() > matchwp.tree(0.66, 0.6, 3).before() > 0.6


def test_closed_game_equals_the_table(spark):
    for r in spark.range(1, 20).select((F.col("id") / 20).alias("g")).select("g", score.game_wp(F.col("g")).alias("w")).collect():
        assert r["w"] == pytest.approx(matchwp.game_table(r["g"])[0, 0], abs=1e-12)


def test_parse_score(spark):
    rows = [(1, 0, 1, 3, 2, "40-15"), (2, 0, 1, 3, 2, "40-15"), (1, 0, 0, 6, 6, "0-0"), (2, 0, 0, 6, 6, "5-9"), (1, 0, 0, 5, 6, "0-0"), (1, 0, 0, 6, 6, "15-0"), (1, 0, None, 0, 0, "0-0"), (1, 0, 0, 0, 0, "40"), (1, 0, 0, 0, 0, "x-1"), (None, 0, 0, 0, 0, "0-0"), (1, 0, 0, 0, 0, None)]
    df = spark.createDataFrame(rows, "svr int, set1 int, set2 int, gm1 int, gm2 int, pts string")
    c = F.col
    got = [r[0] for r in df.select(matchwp.parse_score(*map(c, ("svr", "set1", "set2", "gm1", "gm2", "pts")))).collect()]
    assert [tuple(g)[4:] if g else None for g in got] == [(3, 1, True, False), (1, 3, False, False), (0, 0, True, True), (9, 5, False, True), (0, 0, True, False), (1, 0, True, False), None, None, None, None, None]


def test_binomial_tail():
    import math

    for n, k, p in [(10, 3, 0.2), (50, 40, 0.6), (300, 170, 0.5), (5, 0, 0.1), (5, 6, 0.1)]:
        assert stats.upper_tail(k, n, p) == pytest.approx(sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)), rel=1e-9)


def test_fisher_against_whole_numbers():
    import math

    import pandas as pd

    r = random.Random(4)
    rows = [tuple(r.randrange(m + 1) for _ in range(4)) for m in (0, 1, 4, 30, 100) for _ in range(60)]
    rows += [(a, b, b, a) for a, b, _, _ in rows] + [(a, b, a, d) for a, b, _, d in rows]  # ties of tables
    got = stats.fisher_two_sided.func(*(pd.Series(x) for x in zip(*rows, strict=True)))
    for (a, b, c, d), p in zip(rows, got, strict=True):
        w = {x: math.comb(a + b, x) * math.comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)}
        assert p == pytest.approx(sum(q for q in w.values() if q <= w[a]) / sum(w.values()), rel=1e-9)


def test_fisher_of_a_large_table_is_quick():
    """As many serve points as a player has at six times sf0.1; whole numbers for every table took minutes."""
    import time

    import pandas as pd

    at = time.process_time()
    p = stats.fisher_two_sided.func(*(pd.Series([x]) for x in (15000, 7000, 14800, 7300)))[0]
    assert p == pytest.approx(0.006603863218669955, rel=1e-9)
    assert time.process_time() - at < 5


def test_adjusted_p_values(spark):
    r = random.Random(2)
    p = [round(r.random() ** 2, 2) for _ in range(40)]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "fam string, i int, p double")
    order = sorted(range(40), key=lambda i: (p[i], i))
    bh, holm, low, high = {}, {}, 1.0, 0.0
    for rank in range(40, 0, -1):
        low = min(low, p[order[rank - 1]] * 40 / rank)
        bh[order[rank - 1]] = low
    for rank in range(1, 41):
        high = max(high, (40 - rank + 1) * p[order[rank - 1]])
        holm[order[rank - 1]] = min(1.0, high)
    for x in stats.holm(stats.bh(df, "p", ["fam"], ["i"], "b"), "p", ["fam"], ["i"], "h").collect():
        assert x["b"] == pytest.approx(bh[x["i"]]) and x["h"] == pytest.approx(holm[x["i"]])


def test_tails_of_the_normal_and_chi_square(spark):
    from deucebase.operators.tendencies import bh_reject, chi2_sf

    df = spark.createDataFrame([(0.0, 10), (10.0, 10), (18.307, 10), (23.209, 10), (-1.0, 10), (3.0, 0)], "x double, k int")
    got = [r[0] for r in df.select(chi2_sf("x", "k")).collect()]
    assert got[0] == got[4] == got[5] == 1.0 and got[1] == pytest.approx(0.4405, abs=2e-3) and got[2] == pytest.approx(0.05, abs=1e-3) and got[3] == pytest.approx(0.01, abs=1e-3)
    z = spark.createDataFrame([(0.0,), (1.6448536,), (-1.6448536,)], "z double").select(stats.norm_sf("z")).collect()
    assert [r[0] for r in z] == pytest.approx([0.5, 0.05, 0.95], abs=1e-6)
    p = spark.createDataFrame([("a", x) for x in (0.001, 0.03, 0.035, 0.9)] + [("b", 0.5)], "g string, p double")
    assert {r["g"]: (r["tests"], r["rejected"]) for r in bh_reject(p, "p", ["g"]).collect()} == {"a": (4, 3), "b": (1, 0)}


def test_folds_are_crc(spark):
    import zlib

    from deucebase.operators.screens import half, in_test

    ids = [str(i * 16) for i in range(200)]
    for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", half(F.col("i")).alias("h"), in_test(F.col("i")).alias("t")).collect():
        assert (r["h"], r["t"]) == (zlib.crc32(r["i"].encode()) & 1, zlib.crc32(r["i"].encode()) % 1000 < 200)
