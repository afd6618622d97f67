"""The decoder against points built from the grammar, whose meaning is known as they are built."""

import random

import pytest

from deucebase.functions import notation

ENDS = {"*": "winner", "#": "forced_error", "@": "unforced_error"}
SCHEMA = "id int, first_serve string, second_serve string, svr int, pt_winner int"


def build(r: random.Random):
    """A rally string and what it says: (text, strokes as (letter, direction, depth, modifiers), end, error place)."""
    serve = r.choice("456")
    strokes = [("", serve, None, "")]
    text = r.choice(["", "c", "cc"]) + serve
    for _ in range(r.choice([0, 1, 2, 3, 8])):
        letter, direction, depth = r.choice(notation.LETTERS), r.choice(["", "1", "2", "3"]), r.choice(["", "", "7", "8", "9"])
        mods = r.choice(["", "", "+", "-", "=", "^"])
        text += letter + mods + direction + depth
        strokes.append((letter, direction or None, depth or None, mods))
    end = r.choice("*#@")
    where = "" if end == "*" else r.choice("ndwx")
    return text + where + end, strokes, end, where


@pytest.fixture(scope="module")
def rallies():
    r = random.Random(11)
    out = []
    for i in range(300):
        text, strokes, end, where = build(r)
        server = r.choice([1, 2])
        second = r.random() < 0.3
        out.append((i, r.choice("456") + r.choice("ndwx") if second else text, text if second else r.choice([None, "", "  "]), server, strokes, end, where, 2 if second else 1))
    return out


def test_rallies(spark, rallies):
    rows = []
    for i, first, second, server, strokes, end, *_ in rallies:
        hitter = server if len(strokes) % 2 else 3 - server
        rows.append((i, first, second, server, hitter if end == "*" else 3 - hitter))
    got = {x["id"]: x for x in notation.decoded(spark.createDataFrame(rows, SCHEMA)).collect()}
    for (i, _, _, server, strokes, end, where, sip), row in zip(rallies, rows, strict=True):
        g = got[i]
        n = len(strokes)
        assert (g["serve_in_play"], g["rally_len"], g["parse_ok"]) == (sip, n, True)
        assert g["outcome"] == ("ace" if n == 1 and end == "*" else ENDS[end])
        assert [(s["letter"], s["direction"], s["depth"], s["modifiers"]) for s in g["shots"]] == strokes
        assert [s["hitter"] for s in g["shots"]] == [server if k % 2 == 0 else 3 - server for k in range(n)]
        assert g["server_won"] == (row[4] == server) and g["winner_by_notation"] == row[4]
        assert (g["shots"][-1]["terminal"], g["shots"][-1]["error_loc"] or "") == (end, where)
        letter = strokes[-1][0]
        assert g["ending_side"] == ("FH" if letter in notation.FOREHAND else "BH" if letter in notation.BACKHAND else "")
        assert "winner_mismatch" not in g["flags"] and "no_terminal" not in g["flags"]


def test_faults_and_odd_strings(spark):
    rows = [
        (0, "6w", "5x", 2, 1), (1, "6w", None, 2, None), (2, "", None, 1, 2), (3, "  ", " ", 1, None), (4, "qs3h2", None, 2, 1), (5, "05b1", None, 1, 1), (6, "9z2*", None, 1, 2),
        (7, "4h1*", None, 1, 1), (8, None, None, None, None), (9, "5y2!?*", None, 2, 1),
    ]
    got = {x["id"]: x for x in notation.decoded(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[0]["outcome"], got[0]["winner_by_notation"], got[0]["server_won"]) == ("double_fault", 1, False)
    assert (got[1]["outcome"], got[1]["parse_ok"], got[1]["flags"]) == ("fault_unfinished", True, ["first_fault_no_second"])
    for i in (2, 3, 8):
        assert (got[i]["outcome"], got[i]["rally_len"], got[i]["flags"], got[i]["parse_ok"]) == ("unknown", 0, ["empty"], False)
    # letters before the first digit are skipped; a 3 is no serve direction, what follows is the returner's
    assert got[4]["flags"][:3] == ["lead:q", "lead:s", "no_serve_dir"] and "stray:3" in got[4]["flags"] and [s["hitter"] for s in got[4]["shots"]] == [1]
    assert not got[4]["parse_ok"]
    assert (got[5]["rally_len"], got[5]["shots"][0]["direction"]) == (2, "0") and "unk:5" in got[5]["flags"] and "no_terminal" in got[5]["flags"]
    assert not got[6]["parse_ok"] and got[6]["flags"] == ["no_serve_dir", "stray:9"] and got[6]["shots"][0]["hitter"] == 2
    assert "winner_mismatch" in got[7]["flags"] and got[7]["server_won"]  # the returner hit the winner, the chart says the server won
    assert got[9]["flags"] == ["unk:!", "unk:?"] and got[9]["outcome"] == "winner"


def test_later_descriptors_win(spark):
    g = notation.decoded(spark.createDataFrame([(0, "42b1378n@", None, 1, 1)], SCHEMA)).first()
    assert [s["direction"] for s in g["shots"]] == ["2", "3"] and g["shots"][1]["depth"] == "8"


def test_decoded_points_are_left_alone(spark):
    d = notation.decoded(spark.createDataFrame([(0, "4b1*", None, 1, 2)], SCHEMA))
    assert notation.decoded(d) is d


def test_aggressive_strokes(spark, rallies):
    """A forced error counts for the stroke before it, and for nobody if there is none."""
    rows = [(str(i), f or s, None, v, 1) for i, f, s, v, *_ in rallies if not (s or "").strip()]
    df = spark.createDataFrame(rows, "match_id string, first_serve string, second_serve string, svr int, pt_winner int")
    seen: dict = {}
    for x in notation.aggressive(notation.shot_table(df, ("match_id",))).collect():
        seen.setdefault(x["match_id"], {})[x["idx"]] = (x["is_winner"], x["own_unforced"], x["induced_forced"])
    for i, _, s, _, strokes, end, *_ in rallies:
        if (s or "").strip():
            continue
        n = len(strokes)
        want = {k: (end == "*" and k == n, end == "@" and k == n, end == "#" and k == n - 1) for k in range(1, n + 1)}
        assert seen[str(i)] == want


def test_coded_strokes(spark):
    """The code of a whole batch says what the decoder says of every stroke: strays, repeats, lines' ends and other scripts too."""
    import random

    from pyspark.sql import functions as F

    from deucebase.functions.notation import coded, decoded

    rng, rows = random.Random(3), []
    for i in range(1500):
        serve = lambda: rng.choice(["", "c", "  ", "S", "é"]) + rng.choice("4560123 f") + "".join(rng.choice("frvoqtbs123789ndwx*#@+-=^cS .;\n\r\u0085  é") for _ in range(rng.randint(0, 9)))
        rows.append((i, rng.choice([None, "", serve(), serve()]), rng.choice([None, None, serve()]), rng.choice([1, 2, None]), rng.choice([1, 2, 0, None])))
    p = spark.createDataFrame(rows, "id int, first_serve string, second_serve string, svr int, pt_winner int")
    known = lambda s, c: F.coalesce(s[c], F.lit("."))
    one = lambda s: F.concat(F.when(s["is_serve"], "S").otherwise(s["letter"]), known(s, "direction"), known(s, "depth"), known(s, "terminal"), F.when(s["modifiers"].rlike("[+-]"), "+").otherwise("."), known(s, "error_loc"))
    d = decoded(p).withColumn("code", F.when(F.get("shots", F.lit(0))["is_serve"], F.array_join(F.transform("shots", one), "")))
    cols = ["id", "serve_in_play", "server", "code", "parse_ok"]
    full = [*cols, "rally_len", "outcome", "server_won"]
    for names, where in ((cols, "true"), (full, "code IS NOT NULL")):
        a, b = ({tuple(r) for r in x.where(where).select(*names).collect()} for x in (d, coded(p)))
        assert a == b and len(a) > 200
