"""Scoreboard JSON, draw scaffolds and the streaming replay."""

import json

from pyspark.sql import functions as F

from deucebase.operators import live
from deucebase.streaming import replay


def test_scoreboard(spark, tmp_path):
    """Two tours in one event; doubles, qualifying and a match of one side stay out; a broken document is skipped."""

    def player(name, won=None, *games):
        return {"athlete": {"displayName": name}, "winner": won, "linescores": [{"value": float(g)} for g in games]}

    def game(ident, label, state, *players):
        return {"id": ident, "round": {"displayName": label}, "status": {"type": {"state": state}}, "competitors": list(players)}

    men = [game("9", "Round 1", "in", player("Ole", None, 4), player("Pio", None, 5)), game("8", "Quarterfinal", "pre", player("Rui"))]
    women = [game("7", "Semifinal", "post", player("Una", False, 6, 2, 3), player("Vea", True, 4, 6, 6)), game("6", "Qualifying Final", "post", player("A", True), player("B", False))]
    groups = [{"grouping": {"slug": s}, "competitions": c} for s, c in (("mens-singles", men), ("womens-singles", women), ("mixed-doubles", women))]
    (tmp_path / "day.json").write_text(json.dumps({"events": [{"id": "310-2031", "name": "Fjord Open", "venue": {"displayName": "Bergen , Norway"}, "groupings": groups}]}))
    (tmp_path / "bad.json").write_text('{"events": [')
    got = {r["id"]: r for r in live.singles_matches(live.read_scoreboards(spark, str(tmp_path))).collect()}
    assert set(got) == {"9", "7"}
    assert (got["7"]["gender"], got["7"]["winner"], got["7"]["state"], [tuple(x) for x in got["7"]["sets"]]) == ("W", 2, "post", [(6, 4), (2, 6), (3, 6)])
    assert (got["9"]["gender"], got["9"]["winner"], got["9"]["tournament_id"], got["9"]["city"], got["9"]["round"]) == ("M", None, "310", "Bergen", "Round 1")


def test_scaffold(spark):
    rows = live.slots(spark.createDataFrame([("x", 8)], "draw string, size int"), ["draw"], "size").collect()
    assert sorted((r["round"], r["slot"], r["feeds"]) for r in rows) == [(1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 1, 1), (2, 2, 1), (3, 1, 1)]


def test_replay_equals_batch(spark, tmp_path):
    df = spark.range(300).select((F.col("id") % 17).alias("k"), (F.col("id") * 7919 % 301).alias("at"), F.col("id").cast("string").alias("v"))
    df.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = replay.read_states(spark, str(tmp_path / "in"), df.schema, files=2)
    q = replay.keep_last(stream, ["k"], "at", ["v"], str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = max(int(p.name[2:]) for p in (tmp_path / "out").iterdir())
    got = {r["k"]: (r["s"]["at"], r["s"]["v"]) for r in spark.read.parquet(str(tmp_path / "out" / f"v={last}")).collect()}
    assert len(list((tmp_path / "out").glob("v=*"))) <= 3
    assert last == 2 and got == {r["k"]: (r["at"], r["v"]) for r in live.last_state(df, ["k"], "at", ["v"]).collect()}


def test_streams_of_windows_and_sheets(spark, tmp_path):
    df = spark.range(200).select((F.col("id") % 9).alias("k"), F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.col("id").alias("v"))
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = replay.read_states(spark, str(tmp_path / "in"), df.schema, files=1)
    q = replay.windowed_counts(stream, "at", "k", late="400 days").writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("counts").groupBy("start", "k").agg(F.max("n").alias("n")).agg(F.sum("n")).first()[0]
    assert got == 200
    q = replay.adopt_once(replay.read_states(spark, str(tmp_path / "in"), df.schema, files=2), ["k"], str(tmp_path / "sheets"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "sheets")).collect()) == list(range(9))
    q = replay.first_states(replay.read_states(spark, str(tmp_path / "in"), df.schema, files=2), ["k"], "at", "400 days").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["k"] for r in spark.table("firsts").collect()) == list(range(9))
