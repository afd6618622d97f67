"""Wiki markup, brackets, calendars, archives."""

import datetime as dt
import json

from pyspark.sql import functions as F

from deucebase.functions import wikitext
from deucebase.operators import brackets

PAGE = """
Lead {{infobox|a=[[x|y]]}}
==Seeds==
# [[Nobody]]
==Draw==
{{16TeamBracket-Compact
| RD1-seed01=1 | RD1-team01='''{{flagicon|AUT}} [[Uma Oberholzer (tennis)|U Oberholzer]]''' | RD1-score01=6
| RD1-seed02=<small>3/WC</small> | RD1-team02={{flagicon|PER}} [[Inés Quispe|I Quispe]]
| RD1-team03=Bare Name<!-- note --> | RD1-seed03=Alt/LL
| RD1-team04=[[Vera Lindqvist]] | RD1-seed04=
| RD2-seed03=2 | RD2-team03=[[Odd Numbered]]
| RD1-team07=[[Half Known]]
}}
==Qualifying==
{{16TeamBracket|RD1-team01=[[Never]]|RD1-team02=[[Ever]]}}
"""


def test_draws():
    got = wikitext.parse_draw(PAGE)
    assert got[0] == (1, "Uma Oberholzer", "Inés Quispe", "1", "3", False, False)
    assert got[1] == (2, "Bare Name", "Vera Lindqvist", "LL", None, False, False)
    assert got[2] == (3, "Odd Numbered", None, "2", None, True, False)
    assert got[3] == (4, "Half Known", None, None, None, False, True) and [g[0] for g in got] == list(range(1, 9)) and all(g[6] for g in got[4:])
    assert wikitext.parse_draw(None) == wikitext.parse_draw("") == wikitext.parse_draw("no brackets {{ at all") == []


def test_templates_nest():
    t = wikitext.templates("a {{x|1={{y|p|[[q|r]]}}|[[s|t]]|u}} {{open|v")
    assert [(x.name, x.fields) for x in t] == [("x", ["1={{y|p|[[q|r]]}}", "[[s|t]]", "u"]), ("y", ["p", "[[q|r]]"])]


def test_calendar():
    page = """
===May===
| [[2031 Tiber Cup|Tiber Cup]]<br />[[Rome]], Italy<br />ATP 1000<br />Clay – $9 – 96S/48Q<br />[[2031 Tiber Cup – Men's singles|Singles]] – [[2031 Tiber Cup – Men's doubles|Doubles]] || other
|-
| ATP 500 (legend)
===June===
| [[Ring Open]]<br>Basel, Switzerland<br>WTA 250<br>Hard (i) – 32S
| [[2031 Lawn Major|Lawn Major]]<br />[[London]]<br />Grand Slam<br />Grass – 128S
"""
    assert wikitext.parse_calendar(page) == [
        ("Tiber Cup", "Rome", "ATP 1000", "Clay", False, 5, 96, ["2031 Tiber Cup – Men's singles"]),
        ("Ring Open", "Basel", "WTA 250", "Hard", True, 6, 32, []),
        ("Lawn Major", "London", "Grand Slam", "Grass", False, 6, 128, []),
    ]
    assert wikitext.parse_calendar(None) == []


MATCH = "tournament_id string, gender string, id string, position long, rank int, label string, a string, b string, state string, date string, winner int"


def feed(spark):
    """Eight players, seven matches; the final is undecided on one side."""
    rows = [("t", "W", f"q{k}", k, 51, "Quarterfinals", f"P {chr(65 + 2 * k)}", f"P {chr(66 + 2 * k)}", "post", "2030-01-01", 1) for k in range(4)]
    rows += [("t", "W", "s1", 5, 52, "Semifinals", "P E", "P G", "post", "2030-01-02", 1), ("t", "W", "s0", 6, 52, "Semifinals", "P A", "P C", "pre", "2030-01-02", None)]
    rows += [("t", "W", "f", 7, 53, "Final", "P E", "TBD", "pre", "2030-01-03", None)]
    return spark.createDataFrame(rows, MATCH)


def test_links_and_order(spark):
    linked = brackets.link_rounds(feed(spark))
    got = {r["id"]: r["feeds"] for r in linked.collect()}
    assert got == {"q0": "s0", "q1": "s0", "q2": "s1", "q3": "s1", "s1": "f", "s0": None, "f": None}
    place = {r["id"]: r["place"] for r in brackets.order_rounds(linked).collect()}
    assert (place["f"], place["s1"], place["s0"]) == (1, 1, 2) and sorted(("q2", "q3", "q0", "q1"), key=place.get) == ["q2", "q3", "q0", "q1"]
    twice = feed(spark).unionByName(spark.createDataFrame([("t", "W", "s2", 8, 52, "Semifinals", "P A", "P H", "pre", None, None)], MATCH))
    assert {r["id"]: r["feeds"] for r in brackets.link_rounds(twice).collect()}["q0"] is None  # P A stands in two semifinals
    events = spark.createDataFrame([("t", "W", "Cup")], "tournament_id string, gender string, name string")
    doc = json.loads(brackets.payload(events, brackets.order_rounds(linked)).first()["json"])
    assert doc["name"] == "Cup" and [m["id"] for m in doc["rounds"][1]["matches"]] == ["s1", "s0"]


def sheet(spark):
    rows = [("t", "W", k + 1, f"P {chr(65 + 2 * k)}", f"P {chr(66 + 2 * k)}", str(k + 1), None, False, False) for k in range(4)]
    return spark.createDataFrame(rows, "tournament_id string, gender string, slot int, a string, b string, seed_a string, seed_b string, bye boolean, partial boolean")


def test_slots(spark):
    s, m = sheet(spark), feed(spark)
    assert brackets.feed_agreement(s, m).first()["agreement"] == 1.0 and brackets.adopted(s, m).count() == 4
    got = {(r["round"], r["slot"]): r for r in brackets.slot_rounds(s, m.where("id <> 's0'")).collect()}
    assert len(got) == 7 and got[2, 2]["id"] == "s1" and got[2, 1]["id"] == "slot-2-1" and got[2, 1]["placeholder"] and got[2, 1]["date"] == "2030-01-02"
    assert got[3, 1]["id"] == "f" and got[2, 2]["feeds"] == "f" and got[1, 1]["feeds"] == "slot-2-1" and got[3, 1]["feeds"] is None
    assert (got[1, 3]["seed_a"], got[2, 2]["seed_a"], got[1, 3]["seed_b"]) == ("3", "3", None)
    # a feed with a round less, or two matches in one slot: nothing
    assert brackets.slot_rounds(s, m.where("rank > 51")).count() == 0
    clash = m.unionByName(spark.createDataFrame([("t", "W", "x", 9, 52, "Semifinals", "P B", "TBD", "pre", "", None)], MATCH))
    assert brackets.slot_rounds(s, clash).count() == 0
    bye = s.withColumn("b", F.when(F.col("slot") != 4, F.col("b"))).withColumn("bye", F.col("slot") == 4)
    four = {(r["round"], r["slot"]): r for r in brackets.slot_rounds(bye, m.where("id NOT IN ('q3', 's1')")).collect()}
    assert (four[1, 4]["a"], four[1, 4]["b"], four[1, 4]["bye"], four[1, 4]["date"]) == ("P G", "Bye", True, "")
    assert not brackets.is_usable(s.where("slot < 4")).first()["usable"] and brackets.is_usable(s).first()["usable"]


def test_fuzzy_names(spark):
    left = spark.createDataFrame([("W", n) for n in ("Anaïs Dupont-Lefèvre", "Anais Dupont Lefevr", "Karolina Muchowa", "Zed", "TBD")], "gender string, who string")
    right = spark.createDataFrame([("W", "Anais Dupont Lefevre"), ("W", "Karolina Muchova"), ("M", "Zed")], "gender string, player string")
    got = {r["who"]: r["matched"] for r in brackets.fuzzy_join(left, right, ["gender"], "who", "player").collect()}
    assert got == {"Anaïs Dupont-Lefèvre": "Anais Dupont Lefevre", "Anais Dupont Lefevr": "Anais Dupont Lefevre", "Karolina Muchowa": "Karolina Muchova", "Zed": None, "TBD": None}


def test_calendar_lookup(spark):
    cal = spark.createDataFrame([("M", "Rome Masters", "Rome", "ATP 1000", "Clay", 5), ("M", "Rome II", "Rome", "ATP 125", "Clay", 7), ("M", "Washington Open", "Washington, D.C.", "ATP 500", "Hard", None)], "gender string, event string, city string, tier string, surface string, month int")
    ev = spark.createDataFrame([("a", "M", "Tiber Cup", "Rome", 5), ("b", "M", "Tiber Cup", "Rome", 6), ("c", "M", "Sponsor DC Open", "Washington", 8), ("d", "W", "Tiber Cup", "Rome", 5), ("e", "M", "Tiber Cup", "Rome", 9)], "tournament_id string, gender string, name string, city string, month int")
    assert {r["tournament_id"]: r["cal_tier"] for r in brackets.calendar_lookup(ev, cal).collect()} == {"a": "ATP 1000", "b": None, "c": "ATP 500", "d": None, "e": None}


def test_annotation(spark):
    charted = spark.createDataFrame([("W", 2030, "cup", "P A", "P B", "m1")], "gender string, year int, tourn_key string, player1 string, player2 string, match_id string")
    universe = spark.createDataFrame([("W", "P A"), ("W", "P B")], "gender string, player string")
    for done, want in ((True, {"q0": True, "q1": False}), (False, {"q0": None, "q1": None})):
        events = spark.createDataFrame([("t", "W", "Cup", "", 2030, done)], "tournament_id string, gender string, name string, city string, year int, completed boolean")
        got = {r["id"]: r for r in brackets.annotate(feed(spark), universe, charted, events).collect()}
        assert {k: got[k]["charted"] for k in want} == want and got["q0"]["matched_a"] == "P A"


def test_archive_rules(spark):
    assert [r["tournament_id"] for r in brackets.completed(feed(spark).withColumn("winner", F.lit(1)).withColumn("state", F.lit("post"))).collect()] == ["t"] and brackets.completed(feed(spark)).count() == 0
    at = lambda d: dt.datetime(2030, 1, d)
    rows = [("s1", "M", "Grand Slam", 2028, at(1)), ("s0", "M", "Grand Slam", 2027, at(1)), ("a", "M", "500", 2029, at(2)), ("a", "W", "500", 2029, at(2)), ("b", "M", "500", 2030, at(3)), ("c", "M", "500", 2030, at(4)), ("d", "M", "250", 2020, at(1))]
    got = brackets.prune(spark.createDataFrame(rows, "tournament_id string, gender string, tier string, year int, archived_at timestamp"), 2030).collect()
    assert sorted(r["tournament_id"] for r in got) == ["b", "c", "d", "s1"]
    f = spark.createDataFrame([("t", "M", "1", 1, "pre"), ("t", "M", "1", 3, "post"), ("t", "M", "2", 2, "in")], "tournament_id string, gender string, id string, day int, state string")
    assert {r["id"]: r["state"] for r in brackets.harvest(f).collect()} == {"1": "post", "2": "in"}


def test_dates(spark):
    rows = [("2030-05-01T11:00Z", "2030-05-01T12:00:00Z"), ("x", None)]
    d = spark.createDataFrame(rows, "a string, b string")
    got = d.select(brackets.iso(F.col("a")).alias("a"), brackets.venue_day(brackets.iso(F.col("b"))).alias("day"), brackets.stale(brackets.iso(F.col("a")), F.lit("2030-05-02 10:00:00").cast("timestamp"), F.lit(2030), F.lit(2030)).alias("old"), brackets.playing(brackets.iso(F.col("a")), brackets.iso(F.col("b")), F.lit("2030-05-04").cast("timestamp")).alias("on")).collect()
    assert got[0]["a"] == dt.datetime(2030, 5, 1, 11) and got[0]["day"] == dt.date(2030, 5, 2) and not got[0]["old"] and not got[0]["on"]
    assert got[1]["a"] is None and got[1]["old"] and got[1]["on"]
    ranks = spark.createDataFrame([("Round 2",), ("Quarterfinal",), ("Qualifying 1st Round",), (None,), ("Playoff",)], "l string").select(brackets.round_rank(F.col("l"))).collect()
    assert [r[0] for r in ranks] == [2, 51, None, None, 50]
