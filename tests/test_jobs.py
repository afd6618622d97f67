"""Files to tables by the jobs, odd cells and all."""

from deucebase import __main__ as jobs
from deucebase.operators import gold
from deucebase.sources import ingest, store

MATCHES = """match_id,Player 1,Player 2,Pl 1 hand,Pl 2 hand,Date,Tournament,Round,Time,Court,Surface,Umpire,Best of,Final TB?,Charted by
20310501-W-Rome-F-Uma_O-Ines_Q,Uma O,Ines Q,R,L,20310501,Rome,F,12,1,Clay,Z,3,1,me
20310502-W-Rome-SF-Uma_O-Vera_L,Uma O,Vera L,R,NA,20310599,Rome,SF,,,Hard,nan,3.0,,you
"""
POINTS = """match_id,Pt,Set1,Set2,Gm1,Gm2,Pts,Svr,1st,2nd,PtWinner
20310501-W-Rome-F-Uma_O-Ines_Q,1,0,0,0,0,0-0,1,4f29b1*,,2
20310501-W-Rome-F-Uma_O-Ines_Q,2,0,0,0,0,15-0,1,6*,,1
20310501-W-Rome-F-Uma_O-Ines_Q,3.0,0,0,0,0,30-0,1,5n,4d,2
20310501-W-Rome-F-Uma_O-Ines_Q,1,0,0,0,0,0-0,1,4f29b1*,,2
20310501-W-Rome-F-Uma_O-Ines_Q,x,0,0,0,0
"""


def test_jobs(spark, tmp_path):
    raw, out = tmp_path / "raw", str(tmp_path / "out")
    raw.mkdir()
    (raw / "charting-w-matches.csv").write_text(MATCHES)
    (raw / "charting-w-points-2020s.csv").write_text(POINTS)
    jobs.run_ingest(spark, f"file://{raw}", out)
    m = {r["match_id"]: r for r in spark.read.parquet(f"{out}/matches").collect()}
    f, s = (m[k] for k in sorted(m))
    assert (f["player1"], f["year"], f["best_of"], f["surface"], f["gender"], f["charted_by"]) == ("Uma O", 2031, 3, "Clay", "W", "me")
    assert (s["date"], s["year"], s["player2_hand"], s["umpire"], s["best_of"], s["time"]) == (None, None, None, None, 3, None)
    assert sorted(r["pt"] for r in spark.read.parquet(f"{out}/points").collect()) == [1, 2, 3]
    assert {r["table"]: r["rows"] for r in ingest.freshness(spark.read.schema("run_id string, at timestamp, `table` string, rows bigint").json(f"{out}/log")).collect()} == {"matches": 2, "points": 3}
    jobs.run_shots(spark, out, out)
    assert {r["pt"]: r["outcome"] for r in spark.read.parquet(f"{out}/points_parsed").collect()} == {1: "winner", 2: "ace", 3: "double_fault"}
    jobs.run_report(spark, out, out)
    text = "\n".join(r[0] for r in spark.read.text(f"{out}/report").collect())
    assert "## Points" in text and "| n_points |" in text


def test_headers_and_casts(spark):
    assert ingest.slug(" Pl 1 (hand)? ") == "pl_1_hand"
    df = spark.createDataFrame([("6", "Yes", "2030-02-30"), ("6.0", "0", "20300228"), ("6.5", "", "x"), (None, None, None)], "a string, b string, c string")
    c = ingest.F.col
    got = df.select(ingest.to_int(c("a")), ingest.to_bool(c("b")), ingest.to_date(c("c"))).collect()
    assert [tuple(map(str, r)) for r in got] == [("6", "True", "None"), ("6", "False", "2030-02-28"), ("None", "None", "None"), ("None", "None", "None")]


def test_read_through(spark, tmp_path):
    import shutil

    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = str(tmp_path)
    assert store.once(spark, "t", key, build).count() == 3 and store.once(spark, "t", key, build).count() == 3 and len(built) == 1
    at = next(p for (a, n, k), p in store._BUILT.items() if k == key)
    shutil.rmtree(at.removeprefix("file://"))
    assert store.once(spark, "t", key, build).count() == 3 and len(built) == 2


def test_archetypes(spark):
    cols = ("net_pct", "slice_pct", "return_slice", "avg_rally_len", "ace_rate", "gs_winner_rate", "serve_t")
    rows = [(2.0, 2.0, 0, 0, 0, 0, 0), (2.0, 0, 0, 0, 0, 0, 0), (0, 0, 1.5, 0, 0, 0, 0), (0, 0, 0, 1.0, -1.0, 0, 0), (0, 0, 0, -1.0, 0, 1.0, 0), (0, 0, 0, 0, 0, 0, 1.0), (0, 0, 0, 0, 0, 0, 0)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in cols))
    assert [r[0] for r in df.select(gold.archetype(ingest.F.col)).collect()] == ["Slice & net specialist", "Net-rusher / serve-volleyer", "Slice & variety", "Baseline grinder / counterpuncher", "Big serve / first-strike", "Big-serving baseliner", "Baseline all-rounder"]


def test_site_tables_read_stored_points(spark):
    """No table of the site is made from line items a second time; the stored points are the same rows."""
    from deucebase.plans import gold as plan
    from deucebase.sources import store
    from deucebase.sources.adapter import points

    d = "/root/testdata/sf0.001"
    for name, t in plan.gold_tables(spark, d).items():
        assert not any("lineitem" in f for f in t.inputFiles()), name
    a, b = points(spark, d), store.stored_points(spark, d)
    assert a.schema.names == b.schema.names and a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_sums_from_codes(spark):
    """Every sum that the site takes from codes is the one of the operators that count a stroke of an array at a time, and
    no stored table of the site holds decoded arrays."""
    from pyspark.sql import functions as F

    from deucebase.operators import coded, coverage, eras, screens
    from deucebase.operators import sequences as seq
    from deucebase.plans import gold as plan
    from deucebase.sources import store
    from deucebase.sources.adapter import matches

    d = "/root/testdata/sf0.001"
    p, c, hands = store.parsed(spark, d), store.coded_points(spark, d), coverage.modal_hand(matches(spark, d))
    g = seq.hitter(seq.ngrams(seq.spoken(seq.tokens(p), hands))).groupBy("gender", "player", "a", "b", "t").agg(F.count(F.lit(1)).alias("n"))
    keep = ("match_id", "pt", "gender", "player1", "player2", "pts", "year")
    cells = lambda o: screens.era_cells(o).unionByName(screens.plus_one_cells(o), allowMissingColumns=True)
    sums = coded.player_counters(c)
    by = ["gender", "player", "year"]
    counters = eras.counters(p, ("gender", "year")).groupBy(*by).agg(*[F.sum(x).alias(x) for x in sums.columns if x not in by])
    pairs = [
        (coded.gram_counts(c).where("player IS NOT NULL"), g),
        (coded.strike_counts(c, (2, 3, 4)), screens.strike_counts(seq.tokens(p, keep), hands, (2, 3, 4))),
        (cells(coded.observations(c)), cells(seq.observations(p, hands, keep))),
        (sums, counters),
    ]
    for a, b in pairs:
        a, b = ({tuple(r) for r in x.select(*sorted(x.columns)).collect()} for x in (a, b))
        assert a == b and a
    for name, t in plan.gold_tables(spark, d).items():
        assert not any("points_parsed" in f or "lineitem" in f for f in t.inputFiles()), name
