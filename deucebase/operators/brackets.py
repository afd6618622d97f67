"""Brackets from a feed: linking rounds by names, slots by a draw sheet, calendar lookups, annotation, the archive."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from deucebase.functions.naming import normalize_name, tourn_key

EVENT = ["tournament_id", "gender"]
OPEN = ("TBD", "")
# Rounds by name, the first rounds are numbered.
ROUNDS = {"quarterfinal": 51, "quarterfinals": 51, "semifinal": 52, "semifinals": 52, "final": 53}


def named(c: Column) -> Column:
    return F.coalesce(~c.isin(*OPEN), F.lit(False))


def round_rank(label: Column) -> Column:
    """Order of a round by its label: numbered rounds by number, late ones after them; null for qualifying."""
    lab = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    c = F.when(lab.contains("qualif") | (lab == ""), F.lit(None).cast("int"))
    for k, v in ROUNDS.items():
        c = c.when(lab == k, v)
    return c.otherwise(F.coalesce(F.regexp_extract(lab, r"^round (\d+)", 1).try_cast("int"), F.lit(50)))


@F.pandas_udf(StringType())
def closest(name: pd.Series, choices: pd.Series, cutoff: pd.Series) -> pd.Series:
    """The choice most like the name by the ratio of matching blocks; none below the cutoff. Choices are a bounded list."""
    return pd.Series([(difflib.get_close_matches(n, list(c), n=1, cutoff=k) or [None])[0] if n and c is not None else None for n, c, k in zip(name, choices, cutoff, strict=True)])


def fuzzy_join(left: DataFrame, right: DataFrame, keys: list[str], name: str, target: str, cutoff: float = 0.88, most: int = 50_000) -> DataFrame:
    """``left`` with ``matched``: the ``target`` of ``right`` with the same normalized name, else of the closest one.

    Exact names meet by an equi-join. Only distinct names that miss are compared with the names of their key that begin
    with one of three neighbouring lengths of the same letters' count; a key holds at most ``most`` names, checked."""
    names = left.select(*keys, name).distinct().withColumn("_n", normalize_name(name))
    table = right.withColumn("_n", normalize_name(target)).groupBy(*keys, "_n").agg(F.min(target).alias("_t"))
    hit = names.join(table, [*keys, "_n"], "left")
    lists = table.groupBy(*keys).agg(F.collect_list("_n").alias("_all"), F.count(F.lit(1)).alias("_size"))
    lists = lists.withColumn("_all", F.when(F.col("_size") <= most, F.col("_all")).otherwise(F.raise_error(F.lit(f"fuzzy_join: over {most} names in one key")))).drop("_size")
    miss = hit.where("_t IS NULL AND _n <> ''").drop("_t").join(lists, keys)
    # a ratio of at least c needs lengths within a factor: 2 * min / (a + b) >= c
    reach = F.filter("_all", lambda x: 2 * F.least(F.length(x), F.length("_n")) >= cutoff * (F.length(x) + F.length("_n")))
    found = miss.select(*keys, name, "_n", closest("_n", reach, F.lit(cutoff)).alias("_c")).where("_c IS NOT NULL")
    found = found.join(table.withColumnRenamed("_n", "_c"), [*keys, "_c"]).select(*keys, name, F.col("_t").alias("matched"))
    exact = hit.where("_t IS NOT NULL").select(*keys, name, F.col("_t").alias("matched"))
    return left.join(exact.unionByName(found), [*keys, name], "left")


def link_rounds(matches: DataFrame) -> DataFrame:
    """``feeds``: the next round's match in which one of a match's names stands. A name that stands twice there, or names
    that point to two matches, claim nothing."""
    m = matches.withColumn("round", F.dense_rank().over(Window.partitionBy(*EVENT).orderBy("rank")))
    names = m.select(*EVENT, "round", "id", F.explode(F.array_distinct(F.array("a", "b"))).alias("name")).where(named(F.col("name")))
    entrant = m.select(*EVENT, "round", "id", F.explode(F.array("a", "b")).alias("name")).where(named(F.col("name"))).groupBy(*EVENT, "round", "name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("to")).where("n = 1")
    hits = names.join(entrant.select(*EVENT, (F.col("round") - 1).alias("round"), "name", "to"), [*EVENT, "round", "name"])
    one = hits.groupBy(*EVENT, "id").agg(F.countDistinct("to").alias("n"), F.min("to").alias("feeds")).where("n = 1").drop("n")
    return m.join(one, [*EVENT, "id"], "left")


def order_rounds(linked: DataFrame, position: str = "position") -> DataFrame:
    """``place`` within each round: near the match that is fed, back from the last round; the feed's order on ties and for
    matches that feed nothing, which come last. One draw's matches are a bounded group."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        place, parts = {}, []
        for _, r in sorted(g.groupby("round"), key=lambda x: -x[0]):
            r = r.assign(_p=[place.get(f, len(place) + 1) for f in r["feeds"]]).sort_values(["_p", position], kind="stable")
            r = r.drop(columns="_p").assign(place=range(1, len(r) + 1))
            place = dict(zip(r["id"], r["place"], strict=True))
            parts.append(r)
        return pd.concat(parts)

    return linked.groupBy(*EVENT).applyInPandas(one, ", ".join(f"`{n}` {t}" for n, t in linked.dtypes) + ", place int")


def is_usable(slots: DataFrame) -> DataFrame:
    """By draw: a power of two of slots, two at least, none of them half known."""
    n = F.count(F.lit(1))
    return slots.groupBy(*EVENT).agg(((n >= 2) & (F.bit_count(n) == 1) & (F.count_if("partial") == 0)).alias("usable"), n.alias("slots"))


def _pair(a: str, b: str) -> Column:
    return F.array_sort(F.array(F.col(a), F.col(b)))


def feed_agreement(slots: DataFrame, matches: DataFrame) -> DataFrame:
    """By draw: share of the feed's first-round pairings that stand in the sheet."""
    sheet = slots.where("a IS NOT NULL AND b IS NOT NULL").withColumns({"x": normalize_name("a"), "y": normalize_name("b")}).select(*EVENT, _pair("x", "y").alias("pair")).distinct().withColumn("hit", F.lit(1))
    first = matches.withColumn("least", F.min("rank").over(Window.partitionBy(*EVENT))).where("rank = least").where(named(F.col("a")) & named(F.col("b")))
    live = first.withColumns({"x": normalize_name("a"), "y": normalize_name("b")}).select(*EVENT, _pair("x", "y").alias("pair"))
    return live.join(sheet, [*EVENT, "pair"], "left").groupBy(*EVENT).agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.count(F.lit(1))).alias("agreement"))


def adopted(slots: DataFrame, matches: DataFrame, floor: float = 0.9) -> DataFrame:
    """Slots of the sheets that are whole and agree with the feed."""
    good = is_usable(slots).where("usable").join(feed_agreement(slots, matches).where(F.col("agreement") >= floor), EVENT).select(*EVENT)
    return slots.join(good, EVENT, "left_semi")


def slot_rounds(slots: DataFrame, matches: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """Every slot of every round of the draws in ``slots``: match, names, seeds, what it feeds, placeholder or bye, day.

    A match stands where its names' first-round slots lead; names that lead to two slots place nothing. A round's only
    match without a place takes its only empty slot. A draw whose feed has another number of rounds, or two matches in
    one slot, is left out whole."""
    size = slots.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n")).where("n >= 2 AND bit_count(n) = 1").withColumn("rounds", (F.log2("n") + 1.5).cast("int"))
    m = matches.withColumn("round", F.dense_rank().over(Window.partitionBy(*EVENT).orderBy("rank")))
    size = size.join(m.groupBy(*EVENT).agg(F.max("round").alias("rounds")), [*EVENT, "rounds"])
    sides = [F.struct(F.col("slot"), F.col(s).alias("name"), F.col(f"seed_{s}").alias("seed")) for s in "ab"]
    sheet = slots.select(*EVENT, F.inline(F.array(*sides))).where("name IS NOT NULL").withColumn("name", F.col("name"))
    people = m.join(size.select(*EVENT), EVENT, "left_semi").select(*EVENT, "round", "id", F.explode(F.array_distinct(F.array("a", "b"))).alias("who")).where(named(F.col("who")))
    known = fuzzy_join(people, sheet.select(*EVENT, "name"), EVENT, "who", "name", cutoff).where("matched IS NOT NULL")
    known = known.join(sheet.select(*EVENT, F.col("name").alias("matched"), F.col("slot").alias("r1"), "seed"), [*EVENT, "matched"])
    to = (F.floor((F.col("r1") - 1) / F.pow(F.lit(2.0), F.col("round") - 1)) + 1).cast("int")
    votes = known.groupBy(*EVENT, "round", "id").agg(F.countDistinct(to).alias("v"), F.min(to).alias("slot")).where("v = 1").drop("v")
    clash = votes.groupBy(*EVENT, "round", "slot").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(*EVENT).distinct()
    size = size.join(clash, EVENT, "left_anti")
    grid = size.select(*EVENT, "n", "rounds", F.explode(F.sequence(F.lit(1), "rounds")).alias("round"))
    grid = grid.withColumn("slot", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / F.pow(F.lit(2.0), F.col("round") - 1)).cast("int"))))
    placed = grid.join(votes, [*EVENT, "round", "slot"], "left")
    left = m.join(size.select(*EVENT), EVENT, "left_semi").join(votes.select(*EVENT, "id"), [*EVENT, "id"], "left_anti").groupBy(*EVENT, "round").agg(F.count(F.lit(1)).alias("loose"), F.min("id").alias("spare")).where("loose = 1")
    empty = F.count_if(F.col("id").isNull()).over(Window.partitionBy(*EVENT, "round"))
    placed = placed.withColumn("empty", empty).join(left, [*EVENT, "round"], "left")
    placed = placed.withColumn("id", F.when(F.col("id").isNull() & (F.col("empty") == 1) & F.col("spare").isNotNull(), F.col("spare")).otherwise(F.col("id"))).drop("empty", "loose", "spare")
    # facts of the rounds and of the slots
    labels = m.groupBy(*EVENT, "round").agg(F.min("rank").alias("rank"), F.min("label").alias("label"))
    day = m.where("date IS NOT NULL AND date <> ''").groupBy(*EVENT, "round", "date").agg(F.count(F.lit(1)).alias("c"), F.min("position").alias("p"))
    day = day.groupBy(*EVENT, "round").agg(F.max_by("date", F.struct("c", -F.col("p"))).alias("day"))
    byes = slots.where("(a IS NULL) <> (b IS NULL)").select(*EVENT, F.lit(1).alias("round"), "slot", F.coalesce("a", "b").alias("through"))
    seeds = known.groupBy(*EVENT, F.col("who")).agg(F.max("seed").alias("seed"))
    out = placed.join(m.select(*EVENT, "id", "a", "b", "state", "date"), [*EVENT, "id"], "left").join(labels, [*EVENT, "round"]).join(day, [*EVENT, "round"], "left").join(byes, [*EVENT, "round", "slot"], "left")
    own, bye = F.col("id").isNull(), F.col("id").isNull() & F.col("through").isNotNull()
    out = out.withColumns({"placeholder": own, "bye": bye, "a": F.when(own, F.coalesce("through", F.lit("TBD"))).otherwise(F.col("a")), "b": F.when(bye, "Bye").when(own, "TBD").otherwise(F.col("b")), "date": F.when(bye, "").when(own, F.coalesce("day", F.lit(""))).otherwise(F.col("date"))})
    out = out.withColumn("id", F.coalesce("id", F.concat_ws("-", F.lit("slot"), "round", "slot"))).drop("day", "through", "n")
    for s in "ab":
        own_seed = sheet.select(*EVENT, F.col("name").alias(s), F.col("seed").alias("_s"))
        out = out.join(seeds.withColumnsRenamed({"who": s, "seed": "_k"}), [*EVENT, s], "left").join(own_seed, [*EVENT, s], "left").withColumn(f"seed_{s}", F.coalesce("_k", "_s")).drop("_k", "_s")
    nxt = out.select(*EVENT, (F.col("round") - 1).alias("round"), F.col("slot").alias("to"), F.col("id").alias("feeds"))
    return out.withColumn("to", F.floor((F.col("slot") + 1) / 2).cast("int")).join(nxt, [*EVENT, "round", "to"], "left").drop("to", "rounds")


def calendar_candidates(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Calendar rows that may be a live event's: same tour, a month apart at most where both have one, the city inside the
    other's or the event's name inside the feed's. ``both`` marks those with city and name.

    A season's calendar has a few hundred rows; the tour is the equi key."""
    e = events.withColumns({"ck": tourn_key(F.col("city"), normalize_name("city")), "nk": tourn_key(F.col("name"), normalize_name("name"))})
    c = calendar.select("gender", F.col("event"), F.col("city").alias("cal_city"), F.col("tier").alias("cal_tier"), F.col("surface"), F.col("month").alias("cal_month"), tourn_key(F.col("city"), normalize_name("city")).alias("ek"), tourn_key(F.col("event"), normalize_name("event")).alias("vk"))
    city = (F.col("ck") != "") & (F.col("ek") != "") & (F.col("ck").contains(F.col("ek")) | F.col("ek").contains(F.col("ck")))
    name = (F.col("nk") != "") & (F.col("event") != "") & F.col("nk").contains(F.col("vk"))
    near = F.coalesce(F.abs(F.col("month") - F.col("cal_month")) <= 1, F.lit(True))
    j = e.join(c, "gender").where(near & (city | name))
    return j.withColumn("both", city & name).drop("ck", "nk", "ek", "vk")


def calendar_lookup(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """The calendar row of every event that has exactly one candidate; others keep nulls."""
    c = calendar_candidates(events, calendar)
    w = Window.partitionBy(*EVENT)
    one = c.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").select(*EVENT, "event", "cal_city", "cal_tier", "surface")
    return events.join(one, EVENT, "left")


def annotate(matches: DataFrame, universe: DataFrame, charted: DataFrame, events: DataFrame) -> DataFrame:
    """Names matched to charted players, and of finished events the charted match: by tour, year, either key of the event
    and the unordered pair of names. An event without any charted match keeps nulls, not false."""
    out = matches
    for s in "ab":
        m = fuzzy_join(out.select("gender", F.col(s).alias("_who")).where(named(F.col("_who")) & (F.col("_who") != "Bye")).distinct(), universe, ["gender"], "_who", "player")
        out = out.join(m.withColumnsRenamed({"_who": s, "matched": f"matched_{s}"}), ["gender", s], "left")
    keys = events.withColumn("key", F.explode(F.array_distinct(F.array(tourn_key(F.col("city"), normalize_name("city")), tourn_key(F.col("name"), normalize_name("name")))))).where("key <> '' AND completed").select(*EVENT, "year", "key")
    pairs = out.where(named(F.col("a")) & named(F.col("b"))).withColumns({"x": normalize_name("a"), "y": normalize_name("b")}).select(*EVENT, "id", _pair("x", "y").alias("pair")).join(keys, EVENT)
    c = charted.withColumns({"x": normalize_name("player1"), "y": normalize_name("player2")}).select("gender", "year", F.col("tourn_key").alias("key"), _pair("x", "y").alias("pair"), "match_id")
    ids = pairs.join(c, ["gender", "year", "key", "pair"]).groupBy(*EVENT, "id").agg(F.min("match_id").alias("chart_id"))
    out = out.join(ids, [*EVENT, "id"], "left")
    any_ = F.count("chart_id").over(Window.partitionBy(*EVENT)) > 0
    real = ~F.coalesce(F.col("placeholder"), F.lit(False)) if "placeholder" in matches.columns else F.lit(True)
    return out.withColumn("charted", F.when(any_ & real, F.col("chart_id").isNotNull()))


def completed(matches: DataFrame) -> DataFrame:
    """Draws whose last round is one match, played, with a winner."""
    last = matches.withColumn("_top", F.max("rank").over(Window.partitionBy(*EVENT))).where("rank = _top")
    g = last.groupBy(*EVENT).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("state") == "post") & F.col("winner").isNotNull()).alias("done"))
    return g.where("n >= 1 AND done >= 1").select(*EVENT)


def prune(store: DataFrame, year: int, keep: int = 2, slam_years: int = 2) -> DataFrame:
    """Slams of the last years, of every other tier the ``keep`` newest events (all their draws), and the newest of all."""
    slam = F.lower(F.coalesce("tier", F.lit(""))).contains("grand slam")
    tier = F.lower(F.coalesce("tier", F.lit("")))
    other = store.where(~slam).groupBy(tier.alias("t"), "tournament_id").agg(F.max("archived_at").alias("at"))
    recent = other.withColumn("rn", F.row_number().over(Window.partitionBy("t").orderBy(F.desc("at"), "tournament_id"))).where(F.col("rn") <= keep).select("tournament_id").distinct().withColumn("recent", F.lit(True))
    newest = store.agg(F.max(F.struct("archived_at", *EVENT)).alias("m")).select("m.tournament_id", "m.gender").withColumn("newest", F.lit(True))
    j = store.join(recent, "tournament_id", "left").join(newest, EVENT, "left")
    return j.where((slam & (F.col("year") >= year - slam_years)) | F.col("recent") | F.col("newest")).drop("recent", "newest")


def harvest(feeds: DataFrame, day: str = "day") -> DataFrame:
    """Dated feeds of an event as one: the state of each match on the last day it is in."""
    rest = [c for c in feeds.columns if c not in (*EVENT, "id", day)]
    return feeds.groupBy(*EVENT, "id").agg(F.max_by(F.struct(*rest), day).alias("s")).select(*EVENT, "id", "s.*")


def stale(fetched: Column, now: Column, season: Column, year: Column, hours: int = 24) -> Column:
    """A calendar that is missing, undated, of another season or a day old."""
    return F.coalesce((season != year) | (F.unix_timestamp(now) - F.unix_timestamp(fetched) >= hours * 3600), F.lit(True))


def playing(start: Column, end: Column, now: Column, grace_days: int = 1) -> Column:
    """Whether an event is on, a day's grace either side; what is not known counts as on."""
    g = F.make_dt_interval(F.lit(grace_days))
    return F.coalesce((start - g <= now) & (now <= end + g), F.lit(True))


def iso(value: Column) -> Column:
    """A timestamp of ISO text, UTC where it names no zone; null if it is none."""
    return F.regexp_replace(F.regexp_replace(value, "Z$", "+00:00"), r"([T ]\d\d:\d\d)(?=$|[+-])", "$1:00").try_cast("timestamp")


def venue_day(stamp: Column) -> Column:
    """The calendar day of a match at its venue: from noon UTC on, the next day's."""
    return F.when(F.hour(stamp) >= 12, F.date_add(F.to_date(stamp), 1)).otherwise(F.to_date(stamp))


def payload(events: DataFrame, matches: DataFrame) -> DataFrame:
    """One JSON document per draw: its fields and the rounds with their matches in place."""
    side = lambda s: F.struct(F.col(s).alias("name"), F.col(f"seed_{s}").alias("seed")).alias(s)
    have = [c for c in ("state", "feeds", "placeholder", "bye", "date") if c in matches.columns]
    m = matches.withColumns({f"seed_{s}": F.lit(None).cast("string") for s in "ab" if f"seed_{s}" not in matches.columns})
    r = m.groupBy(*EVENT, "rank").agg(F.min("label").alias("label"), F.sort_array(F.collect_list(F.struct("place", "id", *have, side("a"), side("b")))).alias("matches"))
    r = r.groupBy(*EVENT).agg(F.sort_array(F.collect_list(F.struct("rank", "label", "matches"))).alias("rounds"))
    e = events.join(r, EVENT)
    return e.select(*EVENT, F.to_json(F.struct(*[c for c in e.columns])).alias("json"))
