"""The site's tables and what goes into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from deucebase.functions import naming
from deucebase.operators import brackets, coverage, eras, gold, screens, strength, tendencies, winprob
from deucebase.operators import sequences as seq
from deucebase.plans import entities, sequences, sql, value
from deucebase.plans import screens as screened
from deucebase.plans import tendencies as placed
from deucebase.plans.registry import query
from deucebase.plans.value import _pos
from deucebase.sources import store
from deucebase.sources.adapter import matches, points
from deucebase.sources.store import once, parsed


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in cols})


@query(f", ac AS (SELECT gender, player, sum(aces) / sum(serve_pts) AS ace_rate FROM ct GROUP BY 1, 2 HAVING sum(serve_pts) >= 200), {sequences._HANDS} SELECT coalesce(h.gender, a.gender) AS gender, coalesce(h.player, a.player) AS player, hand, round(ace_rate, 6) AS ace_rate FROM hands h FULL JOIN ac a ON a.gender = h.gender AND a.player = h.player", entities._COUNTERS)
def player_facts(spark, d):
    return _rounded(gold.player_facts(matches(spark, d), entities._player_counts(spark, d)), "ace_rate")


_FOLD = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TKEY = f"(SELECT CASE k WHEN 'french open' THEN 'roland garros' WHEN 'montreal' THEN 'canada' WHEN 'toronto' THEN 'canada' ELSE k END FROM (SELECT trim(regexp_replace(regexp_replace({_FOLD.format('tournament')}, '\\bmasters\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS k))"


@query(f"SELECT gender, year::INT AS year, {_TKEY} AS tourn_key, {_FOLD.format('player1')} AS p1_norm, {_FOLD.format('player2')} AS p2_norm, match_id, charted_by FROM matches WHERE year >= 1995 AND NOT (starts_with(round, 'Q') AND round <> 'QF') AND {sql.TIER} IN ('Grand Slam', 'Masters / WTA 1000')")
def charted_matches(spark, d):
    return gold.charted_matches(matches(spark, d), 1995)


_OPEN = f"""{sequences._TOK}, op0 AS (SELECT t.*, hand, {sql.SIDE} AS sd, row_number() OVER w - 1 AS i, lag(tok, 1) OVER w AS t1, lag(tok, 2) OVER w AS t2, lag(mir, 1) OVER w AS m1, lag(mir, 2) OVER w AS m2 FROM tk t LEFT JOIN hands USING (gender, player) WINDOW w AS (PARTITION BY match_id, pt ORDER BY idx)),
 oc AS (SELECT gender, player, sd AS side, CASE i WHEN 1 THEN 'return' WHEN 2 THEN 'serve+1' ELSE 'return+1' END AS anchor, CASE WHEN hand = 'L' THEN concat_ws(' ', CASE WHEN i >= 2 THEN m2 END, m1) ELSE concat_ws(' ', CASE WHEN i >= 2 THEN t2 END, t1) END AS context,
   count(*) AS n, sum((coalesce(terminal, '') = '*')::INT) AS w, sum((coalesce(terminal, '') = '@')::INT) AS e, sum((coalesce(next_terminal, '') = '#')::INT) AS f FROM op0 WHERE i BETWEEN 1 AND 3 AND sd <> 'na' GROUP BY ALL)"""


def _openings(spark, d):
    return once(spark, "opening_counts", d, lambda: gold.opening_counts(parsed(spark, d), coverage.modal_hand(matches(spark, d))))


@query(", b AS (SELECT *, w + e + f AS att, w + f AS win, sum(n) OVER p AS bn, sum(w + e + f) OVER p AS ba, sum(w + f) OVER p AS bw FROM oc WINDOW p AS (PARTITION BY gender, player, side, anchor)) SELECT gender, player, side, anchor, context, n, att::BIGINT AS attempts, round(att / n, 6) AS att_rate, round((att / n) / (ba / bn), 6) AS att_lift, round(win / att, 6) AS conversion, round(win / att - bw / ba, 6) AS conv_delta, CASE WHEN win / att - bw / ba >= 0 THEN 'green' ELSE 'trap' END AS tag FROM b WHERE bn >= 20 AND ba > 0 AND n >= 4 AND att >= 1 AND (att / n) / (ba / bn) >= 1.5", _OPEN)
def opening_rows(spark, d):
    return _rounded(gold.opening_rows(_openings(spark, d), 20, 4, 1, 1.5), "att_rate", "att_lift", "conversion", "conv_delta")


@query(f"SELECT letter, hitter = server AS by_server, count(*) AS n, sum((coalesce(terminal, '') = '*')::INT)::BIGINT AS w, sum((coalesce(terminal, '') = '@')::INT)::BIGINT AS e, sum((coalesce(next_terminal, '') = '#')::INT)::BIGINT AS f FROM shots GROUP BY 1, 2", sql.SHOTS)
def letter_contrasts(spark, d):
    from deucebase.functions.notation import shot_table

    return gold.contrasts(shot_table(parsed(spark, d), ("match_id", "pt", "server")))


@query(
    """, t AS (SELECT gender, player, context, half, sum(n) AS n, sum(w + e + f) / sum(n) AS r FROM sk WHERE k = 2 GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 2), u AS (SELECT *, row_number() OVER (PARTITION BY gender, player, half ORDER BY r DESC, context) AS rn FROM t),
 b AS (SELECT gender, player, context, max(r) FILTER (half = 0) AS r0, max(r) FILTER (half = 1) AS r1 FROM u GROUP BY 1, 2, 3), c AS (SELECT gender, player, count(*) AS contexts, covar_pop(r0, r1) / nullif(stddev_pop(r0) * stddev_pop(r1), 0) AS r FROM b WHERE r0 IS NOT NULL AND r1 IS NOT NULL GROUP BY 1, 2),
 j AS (SELECT gender, player, list(context) FILTER (half = 0 AND rn <= 5) AS x, list(context) FILTER (half = 1 AND rn <= 5) AS y FROM u GROUP BY 1, 2)
 SELECT gender, player, contexts, round(r, 6) AS r, round(len(list_intersect(coalesce(x, []), coalesce(y, []))) / nullif(len(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), 0), 6) AS jaccard FROM c JOIN j USING (gender, player)""",
    screened._SK,
)
def trigger_stability(spark, d):
    return _rounded(gold.trigger_stability(screened._counts(spark, d).where("k = 2"), 2), "r", "jaccard")


_EARLY = ", ".join(f"sum({f} * n) FILTER (year >= 1996) / nullif(sum(n) FILTER (year >= 1996), 0) - sum({f} * n) FILTER (year < 1996) / nullif(sum(n) FILTER (year < 1996), 0) AS {f}" for f in eras.YEAR_RATES)
_YF = f"{entities._COUNTERS}, yf AS (SELECT gender, player, year, sum(points) AS n, {', '.join(f'sum({a}) / greatest(sum({b}), 1) AS {k}' for k, (a, b) in ((k, r.split('/')) for k, r in eras.YEAR_RATES.items()))} FROM ct GROUP BY 1, 2, 3)"


@query(f", g AS (SELECT gender, player, {_EARLY} FROM yf GROUP BY 1, 2), u AS (UNPIVOT g ON {', '.join(eras.YEAR_RATES)} INTO NAME feature VALUE change), r AS (SELECT *, row_number() OVER (PARTITION BY gender, player ORDER BY -abs(change), feature) AS place FROM u) SELECT gender, player, place::INT AS place, feature, round(change, 6) AS change FROM r WHERE place <= 3", _YF)
def top_changed(spark, d):
    return _rounded(gold.top_changed(eras.year_fingerprints(entities._player_counts(spark, d)), list(eras.YEAR_RATES), 1996), "change")


_SW = f"""{sequences._NG}, {value._WPA.split(sql.SHOTS + ", ", 1)[1]}, ngi AS (SELECT gender, match_id, pt, i, coalesce(lag(t, 2) OVER w, '<s>') AS a, coalesce(lag(t, 1) OVER w, '<s>') AS b, t FROM sq WINDOW w AS (PARTITION BY gender, match_id, pt ORDER BY i))"""


@query("SELECT g.gender, floor(-log2(p))::INT AS bin, count(*) AS n, round(avg(-log2(p)), 6) AS bits, round(avg(w.wpa), 6) AS wpa FROM ngi g JOIN lm ON lm.gender = g.gender AND lm.a = g.a AND lm.b = g.b AND lm.t = g.t JOIN wpa w ON w.match_id = g.match_id AND w.pt = g.pt AND w.idx = g.i WHERE g.t <> '<end>' GROUP BY 1, 2 HAVING count(*) >= 500", _SW)
def surprise_wpa(spark, d):
    g = sequences._grams(spark, d)
    s = seq.surprise_wpa(g, seq.ngram_model(g), winprob.shot_wpa(_pos(spark, d)))
    return _rounded(s, "bits", "wpa")


@query("SELECT match_id, CASE WHEN least(a.n, b.n) >= 30 THEN 'deep' WHEN least(a.n, b.n) >= 8 THEN 'fair' WHEN least(a.n, b.n) >= 1 THEN 'thin' ELSE 'none' END AS tier FROM matches m JOIN pn a ON a.gender = m.gender AND a.player = m.player1 JOIN pn b ON b.gender = m.gender AND b.player = m.player2", f"{sql.CTES}, pn AS (SELECT gender, player, count(*) AS n FROM (SELECT gender, player1 AS player FROM matches UNION ALL SELECT gender, player2 FROM matches) GROUP BY 1, 2)")
def pairing_depth(spark, d):
    m = matches(spark, d).select("match_id", "gender", "player1", "player2")
    n = coverage.sides(m, ("gender",)).groupBy("gender", "player").agg(F.count(F.lit(1)).alias("n"))
    for k in (1, 2):
        m = m.join(n.withColumnsRenamed({"player": f"player{k}", "n": f"n{k}"}), ["gender", f"player{k}"], "left")
    return m.select("match_id", gold.depth_tier(F.col("n1"), F.col("n2")).alias("tier"))


@query(", c AS (SELECT gender, player, family, kind, zone, wing, resp_kind, line, sum(n) AS n FROM cells GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY gender, player ORDER BY n DESC, family, kind, zone, wing, resp_kind, line) AS rn FROM c), g AS (SELECT gender, family, kind, zone, wing, resp_kind, line, count(*) AS k FROM h WHERE rn = 1 GROUP BY ALL) SELECT gender, sum(k)::BIGINT AS players, round(max(k) / sum(k), 6) AS share FROM g GROUP BY 1", sequences._OBS)
def headline_sharing(spark, d):
    """How many players share the most common headline answer."""
    key = ["family", "kind", "zone", "wing", "resp_kind", "line"]
    c = seq.response_cells(screened._obs(spark, d)).groupBy("gender", "player", *key).agg(F.sum("n").alias("n"))
    head = gold.top_per_player(c, [F.desc("n"), *[F.asc(k) for k in key]], 1)
    return _rounded(gold.sharing(head, ["gender"], key), "share")


@query("SELECT gender, player FROM (SELECT gender, player1 AS player FROM points WHERE svr IN (1, 2) AND pt_winner IN (1, 2) UNION ALL SELECT gender, player2 FROM points WHERE svr IN (1, 2) AND pt_winner IN (1, 2)) GROUP BY 1, 2 HAVING count(*) >= 1500")
def search_pool(spark, d):
    return screens.candidates(points(spark, d), 1500).select("gender", "player")


@query(f"SELECT {sql.SIDE} AS side, " + ", ".join(f"round(avg((svr = pt_winner)::INT) FILTER ({sql.PRESSURE} = '{b}'), 6) AS {b}" for b in tendencies.BUCKETS) + f" FROM points WHERE {sql.VALID} AND {sql.SIDE} <> 'na' GROUP BY 1")
def pressure_pivot(spark, d):
    from deucebase.functions.score import pressure, serve_side

    p = strength.valid_points(points(spark, d)).withColumn("side", serve_side(F.col("pts"))).where("side <> 'na'").withColumn("bucket", pressure(F.col("pts"), F.col("gm1"), F.col("gm2")))
    g = p.groupBy("side").pivot("bucket", list(tendencies.BUCKETS)).agg(F.avg((F.col("svr") == F.col("pt_winner")).cast("int")))
    return _rounded(g, *tendencies.BUCKETS)


@query(", c AS (SELECT gender, player, year, count(*) AS n FROM (SELECT gender, player1 AS player, year FROM matches UNION ALL SELECT gender, player2, year FROM matches) GROUP BY ALL) SELECT gender, player, year::INT AS year, n, sum(n) OVER (PARTITION BY gender, player)::BIGINT AS ord FROM c")
def coverage_grid(spark, d):
    """Rows by year with the window sum that orders the rows."""
    from pyspark.sql.window import Window

    c = coverage.sides(matches(spark, d), ("gender", "year")).groupBy("gender", "player", "year").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("ord", F.sum("n").over(Window.partitionBy("gender", "player")))


@query(", f AS (SELECT gender, player, CASE WHEN date >= DATE '1996-01-01' THEN 'recent' ELSE 'all' END AS w, regexp_extract(coalesce(first_serve, ''), '^[^frvoulhjbszpymiktq4560]*([4560])', 1) AS t FROM (SELECT *, CASE WHEN svr = 1 THEN player1 ELSE player2 END AS player FROM points WHERE svr IN (1, 2) AND pt_winner IN (1, 2))), m AS (SELECT count(*) FILTER (t IN ('4', '5', '6')) AS coded, count(*) AS serves, count(DISTINCT gender || player) AS players FROM f) SELECT key, value::DOUBLE AS value FROM (UNPIVOT m ON coded, serves, players INTO NAME key VALUE value)")
def serve_meta(spark, d):
    """Meta facts of the placement table as key and value rows."""
    from deucebase.functions.notation import serve_dir

    p = strength.valid_points(points(spark, d)).withColumn("player", F.when(F.col("svr") == 1, F.col("player1")).otherwise(F.col("player2")))
    one = p.agg(F.count_if(serve_dir(F.col("first_serve")).isin("4", "5", "6")).alias("coded"), F.count(F.lit(1)).alias("serves"), F.countDistinct("gender", "player").alias("players"))
    return one.unpivot([], ["coded", "serves", "players"], "key", "value").select("key", F.col("value").cast("double").alias("value"))


@query()
def named_styles(spark, d):
    """Clusters with the names that their centres give them; a test holds the rules."""
    f = eras.fingerprints(entities._player_counts(spark, d), min_points=100)
    return gold.named_clusters(eras.standardized(f), eras.style_clusters(f), eras.RATES)


def _summary(spark, d):
    p, m, counts = store.coded_points(spark, d), store.stored_matches(spark, d), entities._player_counts(spark, d)
    summary = strength.current_strength(p).withColumns({c: F.bround(c, 4) for c in ("serve_rate", "return_rate")}).join(coverage.charted(m, p), ["gender", "player"], "left").join(gold.player_facts(m, counts), ["gender", "player"], "left")
    f = eras.fingerprints(counts, min_points=100)
    summary = summary.join(gold.named_clusters(eras.standardized(f), eras.style_clusters(f), eras.RATES).select("gender", "player", "archetype", "silhouette"), ["gender", "player"], "left").join(f.select("gender", "player", "avg_rally_len"), ["gender", "player"], "left")
    g = sequences._gram_counts(spark, d)
    return summary.join(seq.player_surprise(g, seq.ngram_model(g)).select("gender", "player", "bits"), ["gender", "player"], "left")


def gold_tables(spark, d):
    """The seven tables by name; the summary is kept once an application, as the years are those of its players."""
    p, m = store.coded_points(spark, d), store.stored_matches(spark, d)
    summary = once(spark, "player_summary", d, lambda: _summary(spark, d))
    c = screened._counts(spark, d)
    tagged = screens.tagged_contexts(c.where("k = 2"), "aggressive", 6, 1, 1.05, 0.95)
    return {
        "player_summary": summary,
        "player_years": coverage.charted(m, p, ("gender", "player", "year")).where("year IS NOT NULL").join(summary.select("gender", "player"), ["gender", "player"], "left_semi"),
        "player_triggers": gold.triggers(tagged, screens.gold_patterns(c, "aggressive", **screened._GOLD)),
        "player_patterns": gold.patterns(screens.court_profile(screened._era_cells(spark, d), min_field_era=20, **screened._LOOSE), screens.plus_one_profile(screened._plus(spark, d), **(screened._LOOSE | {"min_state": 6, "min_field": 20, "min_cell": 1, "min_bf": 1}), q=0.99)),
        "player_serve": tendencies.recent_profile(placed._placed(spark, d)),
        "charted_matches": gold.charted_matches(m, 1995),
        "meta": strength.league_mu(p).select(F.concat(F.lit("mu_"), "gender").alias("key"), F.bround("mu", 5).alias("value")),
    }


@query()
def gold_build(spark, d):
    """The site's seven tables, written and read back: name, rows, columns."""
    home = store.scratch(spark, "gold")
    for name, t in gold_tables(spark, d).items():
        with store.compiled(spark):
            store.write_parquet(t, f"{home}/{name}")
        spark.read.parquet(f"{home}/{name}").createOrReplaceTempView(f"gold_{name}")
    return store.catalog_info(spark, [f"gold_{n}" for n in ("player_summary", "player_years", "player_triggers", "player_patterns", "player_serve", "charted_matches", "meta")])


@query()
def annotated_brackets(spark, d):
    """A finished feed with its players and charted matches marked."""
    from deucebase.plans.feeds import feed

    m = matches(spark, d)
    events = m.groupBy(F.concat_ws(" ", "tournament", "year").alias("tournament_id"), "gender").agg(F.min("tournament").alias("name"), F.min("tournament").alias("city"), F.min("year").alias("year"), F.lit(True).alias("completed"))
    universe = coverage.sides(m, ("gender",)).distinct()
    charted = m.withColumn("tourn_key", naming.tourn_key(F.col("tournament"), naming.normalize_name("tournament")))
    a = brackets.annotate(feed(spark, d).drop("winner", "position"), universe, charted, events)
    return a.select("tournament_id", "gender", "id", "matched_a", "matched_b", "chart_id", "charted")



@query(screened._WIDE + " SELECT gender, gate, count(*) AS patterns, count(DISTINCT player) AS players, count(DISTINCT context) AS contexts FROM (SELECT *, coalesce(gate, 'gold') AS g FROM wdg) GROUP BY gender, gate", screened._SK)
def survivor_rollup(spark, d):
    """How many patterns, players and contexts each gate leaves or stops."""
    g = screens.gold_patterns(screened._counts(spark, d), "aggressive", **screened._GOLD)
    return g.groupBy("gender", "gate").agg(F.count(F.lit(1)).alias("patterns"), F.countDistinct("player").alias("players"), F.countDistinct("context").alias("contexts"))


@query()
def placement_cards(spark, d):
    """Recent shares with whether they rest on enough serves to be four fifths signal, and what the tests of dispersion and
    drift say of the player."""
    p = placed._placed(spark, d)
    need = tendencies.card_stats(p, "match_id", 30, 10).where("stat = 'wide'").select("gender", "n80")
    hands = coverage.modal_hand(matches(spark, d))
    r = tendencies.recent_profile(p).join(need, "gender", "left").withColumn("reliable", F.coalesce(F.col("n_eff") >= F.col("n80"), F.lit(False)))
    r = r.join(tendencies.dispersion(p, hands, "4", 3, 4, 5).select("gender", "player", "side", "phi", "pval"), ["gender", "player", "side"], "left")
    return r.join(tendencies.drift(p, 3, 100, 2).select("gender", "player", "ratio", "moved"), ["gender", "player"], "left")


@query()
def sampled_fit(spark, d):
    """State values fitted on a seeded sample of points: the sample is the feature."""
    from deucebase.sources.store import parsed_points

    return winprob.state_values(winprob.positions(parsed_points(spark, d, None, 20_000)))


@query("SELECT gender, min(date) AS oldest, max(date) AS newest, count(*) AS n FROM matches GROUP BY gender")
def feed_ages(spark, d):
    return matches(spark, d).groupBy("gender").agg(F.min("date").alias("oldest"), F.max("date").alias("newest"), F.count(F.lit(1)).alias("n"))


@query("SELECT round, ord::INT AS ord, count(*) AS n FROM matches JOIN (VALUES ('R128', 0), ('R64', 1), ('R32', 2), ('R16', 3), ('QF', 4), ('SF', 5), ('F', 6)) r(round, ord) USING (round) GROUP BY 1, 2 ORDER BY ord")
def rounds_in_order(spark, d):
    """Sorted by a round's place in the draw, not by its name."""
    sizes = coverage._sizes(spark, coverage.SLAM_ROUNDS).select("round", "ord")
    return matches(spark, d).join(sizes, "round").groupBy("round", "ord").agg(F.count(F.lit(1)).alias("n")).orderBy("ord")


def player_universe(m):
    """(gender, key, player): every player by the normalized name; the last spelling in order stands for a key."""
    p = coverage.sides(m, ("gender",)).where("player IS NOT NULL").distinct()
    return p.groupBy("gender", naming.normalize_name("player").alias("key")).agg(F.max("player").alias("player"))


@query("SELECT gender, trim(regexp_replace(regexp_replace(lower(player), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g')) AS key, max(player) AS player FROM (SELECT gender, player1 AS player FROM matches UNION SELECT gender, player2 FROM matches) GROUP BY 1, 2")
def universe(spark, d):
    return player_universe(matches(spark, d))
