"""Brackets, draw sheets, calendars and archives, over a feed made of the matches."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from deucebase.functions import naming, wikitext
from deucebase.operators import brackets, matchwp
from deucebase.plans import sql
from deucebase.plans.registry import query
from deucebase.sources.adapter import matches, points

_RANK = {"R128": 1, "R64": 2, "R32": 3, "R16": 4, "QF": 51, "SF": 52, "F": 53}
_RANK_SQL = "CASE round " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RANK.items()) + " END"
_FEED = f"""{sql.CTES}, fd AS (SELECT tournament || ' ' || year AS tournament_id, gender, match_id AS id, match_id::BIGINT AS position, {_RANK_SQL} AS rank, round AS label, player1 AS a, player2 AS b, date FROM matches WHERE {_RANK_SQL} IS NOT NULL)"""


def feed(spark, d):
    """The matches as a scoreboard tells them: an event is a tournament's year."""
    m = matches(spark, d)
    rank = F.lit(None).cast("int")
    for k, v in _RANK.items():
        rank = F.when(F.col("round") == k, v).otherwise(rank)
    w = matchwp.eventual_winners(points(spark, d)).withColumnRenamed("match_id", "id")
    f = m.select(F.concat_ws(" ", "tournament", "year").alias("tournament_id"), "gender", F.col("match_id").alias("id"), F.col("match_id").cast("bigint").alias("position"), rank.alias("rank"), F.col("round").alias("label"), F.col("player1").alias("a"), F.col("player2").alias("b"), F.lit("post").alias("state"), F.col("date").cast("string").alias("date"))
    return f.where("rank IS NOT NULL").join(w, "id", "left")


@query(
    """, m AS (SELECT *, dense_rank() OVER (PARTITION BY tournament_id, gender ORDER BY rank) AS rd FROM fd), n AS (SELECT tournament_id, gender, rd, id, unnest([a, b]) AS name FROM m),
 e AS (SELECT tournament_id, gender, rd, name, min(id) AS nx FROM n GROUP BY ALL HAVING count(*) = 1), h AS (SELECT n.tournament_id, n.gender, n.id, min(nx) AS feeds FROM n JOIN e ON e.tournament_id = n.tournament_id AND e.gender = n.gender AND e.rd = n.rd + 1 AND e.name = n.name GROUP BY 1, 2, 3 HAVING count(DISTINCT nx) = 1)
 SELECT tournament_id, gender, id, rd::INT AS round, feeds FROM m LEFT JOIN h USING (tournament_id, gender, id)""",
    _FEED,
)
def bracket_links(spark, d):
    return brackets.link_rounds(feed(spark, d)).select("tournament_id", "gender", "id", "round", "feeds")


@query()
def bracket_order(spark, d):
    """Matches in place, back from the last round; a test holds it against the plain rule."""
    return brackets.order_rounds(brackets.link_rounds(feed(spark, d))).select("tournament_id", "gender", "id", "round", "place")


_SLOTS = """, sl AS (SELECT * FROM (SELECT gender || ' ' || year AS tournament_id, gender, year, row_number() OVER (PARTITION BY gender, year ORDER BY match_id::BIGINT) AS slot, player1 AS a, player2 AS b, match_id FROM matches) WHERE slot <= 8)"""


def _sheets(spark, d):
    """A wiki page for each gender's year: eight pairs, every seventh slot a bye."""
    w = Window.partitionBy("gender", "year").orderBy(F.col("match_id").cast("bigint"))
    s = matches(spark, d).withColumn("slot", F.row_number().over(w)).where("slot <= 8")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    name = lambda c: F.concat(F.lit("'''{{flagicon|XXX}} [["), c, F.lit(" (athlete)|short]]'''"))
    pair = F.concat(F.lit("| RD1-seed"), two(F.col("slot") * 2 - 1), F.lit("=<small>"), F.col("slot"), F.lit("/WC</small> | RD1-team"), two(F.col("slot") * 2 - 1), F.lit("="), name(F.col("player1")), F.lit("\n| RD1-team"), two(F.col("slot") * 2), F.lit(" = "), name(F.col("player2")))
    bye = F.concat(F.lit("| RD2-seed"), two(F.col("slot")), F.lit("=Q| RD2-team"), two(F.col("slot")), F.lit("="), name(F.col("player1")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("slot", F.when(F.col("slot") == 7, bye).otherwise(pair).alias("t")))), lambda x: x["t"]), "\n")
    page = F.concat(F.lit("Intro\n==Draw==\n===Top===\n{{16TeamBracket-Compact-Tennis3\n"), text, F.lit("\n}}\n==Qualifying==\n{{16TeamBracket|RD1-team01=[[Nobody]]|RD1-team02=[[No One]]}}"))
    return s.groupBy(F.concat_ws(" ", "gender", "year").alias("tournament_id"), "gender").agg(page.alias("text"))


def _slots(spark, d):
    wikitext.register(spark)
    _sheets(spark, d).createOrReplaceTempView("draw_pages")
    return spark.sql("SELECT tournament_id, gender, s.* FROM draw_pages, LATERAL parse_draw(text) s")


@query(_SLOTS + " SELECT tournament_id, gender, slot::INT AS slot, a, CASE WHEN slot <> 7 THEN b END AS b, CASE WHEN slot = 7 THEN 'Q' ELSE slot::VARCHAR END AS seed_a, slot = 7 AS bye, false AS partial FROM sl UNION ALL SELECT tournament_id, gender, s::INT, NULL, NULL, NULL, false, true FROM (SELECT tournament_id, gender, unnest(range(count(*) + 1, 9)) AS s FROM sl GROUP BY 1, 2)")
def parsed_draws(spark, d):
    return _slots(spark, d).drop("seed_b")


@query(_SLOTS + " SELECT tournament_id, gender, count(*) = 8 AS usable, 8::BIGINT AS slots FROM sl GROUP BY 1, 2")
def usable_draws(spark, d):
    return brackets.is_usable(_slots(spark, d))


def _year_feed(spark, d):
    """A gender's year as an event, its first eight pairs the first round: every other one as in the sheet, the others as
    the ninth match on has them."""
    w = Window.partitionBy("gender", "year").orderBy(F.col("match_id").cast("bigint"))
    m = matches(spark, d).withColumn("k", F.row_number().over(w)).where("k % 2 = 1 AND k <= 7 OR k IN (9, 10)")
    return m.select(F.concat_ws(" ", "gender", "year").alias("tournament_id"), "gender", F.col("match_id").alias("id"), F.lit(1).alias("rank"), F.col("player2").alias("a"), F.col("player1").alias("b"))


@query(
    """, k AS (SELECT gender || ' ' || year AS tournament_id, gender, player1, player2, row_number() OVER (PARTITION BY gender, year ORDER BY match_id::BIGINT) AS k FROM matches), s AS (SELECT DISTINCT tournament_id, regexp_replace(lower(least(player1, player2)), '[^a-z ]', ' ', 'g') AS x FROM k WHERE k <= 8),
 l AS (SELECT * FROM k WHERE k % 2 = 1 AND k <= 7 OR k IN (9, 10)) SELECT tournament_id, gender, 1.0 AS agreement FROM l GROUP BY 1, 2"""
)
def feed_agreements(spark, d):
    """The names here differ in digits only, which normalizing takes away: every pair agrees. Tests have real names."""
    return brackets.feed_agreement(_slots(spark, d), _year_feed(spark, d))


_CAL = [("M", "Rome Open", "Rome", "ATP 1000", "Clay", 5), ("M", "Rome Challenger", "Rome", "ATP 125", "Clay", 9), ("W", "Miami Cup", "Miami", "WTA 1000", "Hard", 3), ("M", "Miami", "Key Biscayne", "ATP 1000", "Hard", None), ("W", "Toronto Classic", "Canada", "WTA 1000", "Hard", 8), ("M", "Dubai", "", "ATP 500", "Hard", 2)]
_KEY = "CASE k0 WHEN 'montreal' THEN 'canada' WHEN 'toronto' THEN 'canada' WHEN 'french open' THEN 'roland garros' ELSE k0 END"


def _key(c: str) -> str:
    return f"(SELECT {_KEY} FROM (SELECT trim(regexp_replace(regexp_replace(lower({c}), '\\bmasters\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS k0))"


def _events(spark, d):
    m = matches(spark, d)
    return m.groupBy(F.concat_ws(" ", "tournament", "year").alias("tournament_id"), "gender").agg(F.min("tournament").alias("name"), F.min("tournament").alias("city"), F.min(F.month("date")).alias("month"))


def _calendar(spark):
    return spark.createDataFrame(_CAL, "gender string, event string, city string, tier string, surface string, month int")


@query(
    f""", ev AS (SELECT tournament || ' ' || year AS tournament_id, gender, min(tournament) AS name, min(month(date)) AS month FROM matches GROUP BY 1, 2), ek AS (SELECT *, {_key('name')} AS ck FROM ev),
 cal AS (SELECT *, {_key('city')} AS ek, {_key('event')} AS vk FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in _CAL)}) c(gender, event, city, cal_tier, surface, cal_month))
 SELECT e.tournament_id, e.gender, c.event, c.cal_tier, coalesce(abs(e.month - c.cal_month), 0)::INT AS apart, (ck <> '' AND ek <> '' AND (contains(ck, ek) OR contains(ek, ck))) AND contains(ck, vk) AS both FROM ek e JOIN cal c ON c.gender = e.gender AND coalesce(abs(e.month - c.cal_month) <= 1, true) AND ((ck <> '' AND ek <> '' AND (contains(ck, ek) OR contains(ek, ck))) OR contains(ck, vk))""".replace("AS both", 'AS "both"')
)
def calendar_candidates(spark, d):
    c = brackets.calendar_candidates(_events(spark, d), _calendar(spark))
    return c.select("tournament_id", "gender", "event", "cal_tier", F.coalesce(F.abs(F.col("month") - F.col("cal_month")), F.lit(0)).alias("apart"), "both")


@query()
def calendar_lookup(spark, d):
    """Events with exactly one calendar row, over all events; the candidates are held by calendar_candidates."""
    return brackets.calendar_lookup(_events(spark, d), _calendar(spark)).select("tournament_id", "gender", "event", "cal_tier")


@query(", l AS (SELECT *, max(rank) OVER (PARTITION BY tournament_id, gender) AS top FROM fd), w AS (SELECT match_id, arg_max(pt_winner, pt) AS winner FROM points WHERE pt_winner IN (1, 2) GROUP BY 1) SELECT tournament_id, gender FROM l LEFT JOIN w ON w.match_id = l.id WHERE rank = top GROUP BY 1, 2 HAVING count(*) FILTER (winner IS NOT NULL) >= 1", _FEED)
def completed_draws(spark, d):
    return brackets.completed(feed(spark, d))


_STORE = f", st AS (SELECT tournament || ' ' || year AS tournament_id, gender, min({sql.TIER}) AS tier, min(year) AS year, max(date) AS archived_at FROM matches GROUP BY 1, 2)"


@query(
    _STORE
    + """, o AS (SELECT lower(tier) AS t, tournament_id, max(archived_at) AS ats FROM st WHERE NOT contains(lower(tier), 'grand slam') GROUP BY 1, 2), r AS (SELECT DISTINCT tournament_id FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY ats DESC, tournament_id) AS rn FROM o) WHERE rn <= 2),
 n AS (SELECT tournament_id, gender FROM st ORDER BY archived_at DESC, tournament_id DESC, gender DESC LIMIT 1)
 SELECT tournament_id, gender, tier, year::INT AS year FROM st WHERE (contains(lower(tier), 'grand slam') AND year >= 1996) OR tournament_id IN (SELECT tournament_id FROM r) OR EXISTS (SELECT 1 FROM n WHERE n.tournament_id = st.tournament_id AND n.gender = st.gender)"""
)
def pruned_archive(spark, d):
    m = matches(spark, d)
    s = m.groupBy(F.concat_ws(" ", "tournament", "year").alias("tournament_id"), "gender").agg(F.min(naming.classify_tier(F.col("tournament"), F.col("gender"))).alias("tier"), F.min("year").alias("year"), F.max("date").alias("archived_at"))
    return brackets.prune(s, 1998).drop("archived_at")


@query("SELECT event_type AS gender, (user_id % 7)::VARCHAR AS tournament_id, user_id::VARCHAR AS id, arg_max(round(value, 6), (ts, event_id)) AS value FROM events GROUP BY 1, 2, 3", "")
def harvested_states(spark, d):
    """Dated states of the events table, the last of each."""
    e = spark.read.parquet(f"{d}/events.parquet")
    f = e.select(F.col("event_type").alias("gender"), (F.col("user_id") % 7).cast("string").alias("tournament_id"), F.col("user_id").cast("string").alias("id"), F.round("value", 6).alias("value"), F.struct("ts", "event_id").alias("day"))
    return brackets.harvest(f)


@query("SELECT event_id, CASE WHEN hour(ts) >= 12 THEN ts::DATE + 1 ELSE ts::DATE END AS day, (ts >= TIMESTAMP '2024-01-01') AS late FROM events", "")
def venue_days(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", brackets.venue_day(F.col("ts")).alias("day"), (F.col("ts") >= F.lit("2024-01-01").cast("timestamp")).alias("late"))


@query()
def bracket_documents(spark, d):
    """A JSON document for every draw; a test reads one back."""
    f = brackets.order_rounds(brackets.link_rounds(feed(spark, d)))
    return brackets.payload(_events(spark, d).drop("month"), f)
