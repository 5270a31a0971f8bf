"""Registered queries: ties of running events and the application of reviews (see ``joins`` for what the tables stand for)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.operators import identity, repair, views
from rallyspark.plans.common import Registry, read
from rallyspark.plans.texts import _pick, _sql

registry = Registry()
add = registry.add

SCORES = ["3-1", None, "0-3", "late"]


@add(f"""
    WITH t AS (SELECT o_orderkey AS k, o_custkey AS c, {_sql(SCORES, 'o_orderkey')} AS score, o_orderkey % 2 = 0 AND o_orderkey % 5 > 0 AS drawn FROM orders WHERE o_orderkey % 13 > 0),
    s AS (SELECT *, coalesce(CASE WHEN k % 3 <> 1 THEN 'T' || c % 40 END, CASE WHEN drawn THEN 'A' || c END, 'TBD') AS a,
      CASE WHEN k % 11 > 0 THEN coalesce(CASE WHEN k % 3 <> 2 THEN 'T' || c % 41 END, CASE WHEN drawn AND k % 6 > 0 THEN 'B' || c END, 'TBD') ELSE '' END AS b FROM t),
    r AS (SELECT l_orderkey AS k, string_agg(l_linenumber || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS rubbers FROM lineitem GROUP BY 1)
    SELECT k AS tie_id, a AS a_code, CASE WHEN k % 4 > 0 THEN 'Team 1' ELSE a END AS a_name, b AS b_code, CASE WHEN k % 11 = 0 THEN '' WHEN k % 4 > 0 THEN 'Team 2' ELSE b END AS b_name,
      CASE score WHEN '3-1' THEN 3 ELSE 0 END::INTEGER AS score_a, CASE score WHEN '3-1' THEN 1 WHEN '0-3' THEN 3 ELSE 0 END::INTEGER AS score_b, rubbers FROM s LEFT JOIN r USING (k)""")
def running_ties(spark, sf_dir):
    """Ties of running events: teams that are not known yet come from the bracket, else they are to be decided."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf_dir, "orders")
    unit = [(c % 50).alias("event_id"), F.when(k % 2 == 0, "MT").otherwise("WT").alias("sub_event_type_code")]
    code = F.concat(F.lit("U"), k.cast("string"))
    ties = o.select(k.alias("tie_id"), *unit, F.when(k % 5 > 0, code).alias("external_match_code"), _pick(SCORES, k).alias("match_score"))
    side = F.explode(F.when(k % 11 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))).alias("side_no")
    sides = o.where(k % 13 > 0).select(k.alias("tie_id"), "o_custkey", side)
    n = F.col("side_no")
    team = F.concat(F.lit("T"), F.pmod(c, n + 39).cast("string"))
    sides = sides.select("tie_id", "side_no", F.when(F.col("tie_id") % 3 != n, team).alias("team_code"), F.when(F.col("tie_id") % 4 > 0, F.concat(F.lit("Team "), n.cast("string"))).alias("team_name"))
    seat = lambda letter: F.concat(F.lit(letter), c.cast("string"))
    brackets = o.where(k % 2 == 0).select(*unit, code.alias("external_unit_code"), seat("A").alias("side_a_team_code"), F.when(k % 6 > 0, seat("B")).alias("side_b_team_code"))
    rubbers = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tie_id"), F.col("l_linenumber").alias("match_id"), "l_returnflag")
    shown = views.live_tie_view(ties, sides, brackets, rubbers)
    listed = F.array_join(F.transform("rubbers", lambda x: F.concat(x["match_id"].cast("string"), x["l_returnflag"])), ",")
    return shown.select("tie_id", F.col("team_a.code").alias("a_code"), F.col("team_a.name").alias("a_name"), F.col("team_b.code").alias("b_code"), F.col("team_b.name").alias("b_name"), F.col("score_a").cast("int").alias("score_a"), F.col("score_b").cast("int").alias("score_b"), listed.alias("rubbers"))


def _review(spark, sf_dir):
    """Customers as rows of ranking lists, and every tenth of them as an item of a review that names some of its fields."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.concat(F.lit("Cd P"), (k % 60).cast("string"))).otherwise(F.concat(F.lit("P"), (k % 60).cast("string"), F.lit(" CD")))
    country = F.concat(F.lit("c"), F.col("c_nationkey").cast("string"))
    rows = read(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("category"), k.alias("seq"), (k % 100).alias("rank"), name.alias("name"), country.alias("country_code"), (k % 7).alias("points"),
        F.when(k % 3 == 0, k.cast("string")).alias("player_id"), F.when(k % 4 == 0, "/old").alias("profile_url"), F.lit("open").alias("id_resolution_status"),
    )
    s = F.col("seq")
    items = rows.where(s % 10 == 0).select(
        "category", s.alias("item"), F.when(s % 20 == 0, F.col("rank")).alias("rank"), F.when(s % 30 > 0, F.col("name")).alias("name"), F.when(s % 40 == 0, F.col("country_code")).alias("country_code"),
        F.when(s % 50 == 0, F.col("points")).alias("points"), F.when(s % 60 > 0, F.concat(F.lit(" R"), s.cast("string"))).otherwise(" ").alias("resolved_id"), F.when(s % 70 > 0, F.concat(F.lit("/p/"), s.cast("string"))).alias("resolved_url"),
    )
    return rows, items


_REVIEW = """
    w AS (SELECT c_mktsegment AS category, c_custkey AS seq, c_custkey % 100 AS rank, CASE WHEN c_custkey % 2 = 0 THEN 'Cd P' || c_custkey % 60 ELSE 'P' || c_custkey % 60 || ' CD' END AS name, 'c' || c_nationkey AS cc, c_custkey % 7 AS points FROM customer),
    i AS (SELECT category, seq AS item, CASE WHEN seq % 20 = 0 THEN rank END AS rank, CASE WHEN seq % 30 > 0 THEN name END AS name, CASE WHEN seq % 40 = 0 THEN cc END AS cc, CASE WHEN seq % 50 = 0 THEN points END AS points,
      'R' || seq AS id, CASE WHEN seq % 70 > 0 THEN '/p/' || seq END AS url FROM w WHERE seq % 10 = 0 AND seq % 60 > 0)"""


@add(f"""
    WITH {_REVIEW},
    h AS (SELECT i.item, i.id, i.url, min(w.seq) AS seq FROM i JOIN w ON w.category = i.category AND (i.rank IS NULL OR (w.rank <> 0 AND w.rank = i.rank)) AND (i.name IS NULL OR w.name = i.name)
        AND (i.cc IS NULL OR w.cc = i.cc) AND (i.points IS NULL OR (w.points <> 0 AND w.points = i.points)) GROUP BY ALL),
    l AS (SELECT seq, max_by(id, item) AS id, max_by(url, item) FILTER (url IS NOT NULL) AS url FROM h GROUP BY 1)
    SELECT seq, coalesce(id, CASE WHEN seq % 3 = 0 THEN seq::VARCHAR END) AS player_id, coalesce(url, CASE WHEN seq % 4 = 0 THEN '/old' END) AS profile_url, CASE WHEN id IS NOT NULL THEN 'manual' ELSE 'open' END AS id_resolution_status
    FROM w LEFT JOIN l USING (seq)""")
def reviewed_rankings(spark, sf_dir):
    """Ranking lists with the ids of a review: each item fills the first row that has all the values it names."""
    return identity.apply_review(*_review(spark, sf_dir)).select("seq", "player_id", "profile_url", "id_resolution_status")


@add(f"""
    WITH {_REVIEW}, g AS (SELECT seq, name, upper(cc) AS country, seq % 60 AS x FROM w),
    a AS (SELECT DISTINCT item % 60 AS x, upper(cc) AS country FROM i WHERE name IS NOT NULL AND cc IS NOT NULL)
    SELECT seq AS player_id, name, country FROM g WHERE seq % 25 = 0
    UNION SELECT seq, name, country FROM g SEMI JOIN a USING (x, country) WHERE (x, country) IN (SELECT (x, country) FROM g GROUP BY ALL HAVING count(*) > 1)""")
def reviewed_names(spark, sf_dir):
    """Entries of same names after a review: all bearers of a resolved item's name in its country."""
    rows, items = _review(spark, sf_dir)
    players = rows.drop("player_id").withColumnRenamed("seq", "player_id")
    entries = players.where("player_id % 25 = 0").select("player_id", "name", F.upper("country_code").alias("country"))
    return identity.reviewed_same_names(entries, items, players)


ROUNDS, RESULTS = ["QF", "", "main draw", "R16"], ["3-1", "0-3", "2-2", None]


@add("""
    WITH e AS (SELECT event_id AS k, 'Ann ' || user_id % 30 AS a, 'Bo ' || user_id % 31 AS b, event_id // 4 % 4 AS i, CASE WHEN event_id % 2 = 1 THEN 'WS' END AS old FROM events),
    r AS (SELECT k, a || ' (CHN)' || CASE WHEN k % 4 = 0 THEN '&Cy 1 (CHN)' ELSE '' END AS side_a, b || ' (JPN)' AS side_b, CASE WHEN k % 3 > 0 THEN 'MS' ELSE old END AS sub_event,
      CASE k % 4 WHEN 0 THEN 'QF' WHEN 3 THEN 'R16' ELSE 'Group B' END AS round, CASE k % 3 WHEN 0 THEN 'side_a' WHEN 1 THEN 'side_b' ELSE 'unknown' END AS perspective,
      CASE WHEN k % 3 = 2 OR i = 3 THEN 'unknown' WHEN k % 3 = i THEN 'win' ELSE 'loss' END AS result_for_player,
      CASE WHEN k % 5 = 0 THEN a WHEN i = 0 AND k % 4 = 0 THEN a || ' / Cy 1' WHEN i = 0 THEN a WHEN i = 1 THEN b ELSE '' END AS winner FROM e)
    SELECT k AS event_id, * EXCLUDE (k), concat_ws(',', 'all_players_in_row', CASE WHEN k % 4 = 0 THEN 'side_a' END, 'side_b', CASE WHEN k % 3 > 0 THEN 'sub_event' END, CASE WHEN k % 4 > 0 THEN 'round' END,
      CASE WHEN k % 3 > 0 THEN 'perspective' END, CASE WHEN result_for_player <> 'win' THEN 'result_for_player' END, CASE WHEN winner <> '' THEN 'winner' END) AS changes FROM r""")
def repaired_match_rows(spark, sf_dir):
    """Matches repaired from their raw rows, with the columns that have changed."""
    k, u = F.col("event_id"), F.col("user_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    a, b = text("Ann ", u % 30), text("Bo ", u % 31)
    raw = F.concat_ws(
        " | ", (k % 9 + 2010).cast("string"), F.lit("Open Group B"), text(a, " (CHN)"), F.when(k % 4 == 0, "Cy 1 (CHN)").otherwise(""), text(b, " (JPN)"), F.lit(""),
        F.when(k % 3 > 0, "MS").otherwise(""), F.lit("Main Draw"), _pick(ROUNDS, k), F.lit("x"), F.lit(""), F.when(k % 5 == 0, a).otherwise(""),
    )
    owner = F.when(k % 3 == 0, text(u % 30, " ann")).when(k % 3 == 1, F.lower(b)).otherwise("zed")
    rows = read(spark, sf_dir, "events").select(
        k, owner.alias("player_name"), raw.alias("raw_row_text"), _pick(RESULTS, F.floor(k / 4)).alias("match_score"), F.lit(None).cast("array<string>").alias("all_players_in_row"),
        F.array(text(a, " (CHN)")).alias("side_a"), F.lit(None).cast("array<string>").alias("side_b"), F.when(k % 2 == 1, "WS").alias("sub_event"), F.lit("QF").alias("round"),
        F.lit("side_a").alias("perspective"), F.lit("win").alias("result_for_player"), F.lit("").alias("winner"),
    )
    out = repair.repaired_matches(rows)
    listed = [F.array_join(c, "&").alias(c) for c in ("side_a", "side_b")]
    return out.select("event_id", *listed, "sub_event", "round", "perspective", "result_for_player", "winner", F.array_join("changes", ",").alias("changes"))
