"""Registered queries: messages folded into last states, ties found or made for results, countries (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.rounds import discipline, is_team_discipline
from rallyspark.operators import identity, replay, views
from rallyspark.plans.common import Registry, read
from rallyspark.plans.texts import _pick, _sql

registry = Registry()
add = registry.add

STATUS = {"view": "scheduled", "purchase": "completed"}
PAGES = ["Men's Teams", "Women's Singles", "Mixed Teams", "Exhibition", "Women's Teams | Final"]
WINNERS = ["3-1", "1-3", "2-2", None, "late"]
SETS = ["11-5, 7-11", "x,11-0,", "", None]

#: Messages in SQL, each with whether an official final result stood before it, so that the state machine is followed step by step.
_MESSAGES = """
    m AS (SELECT user_id || '-' || event_id % 7 AS tie_code, event_id AS seq, CASE event_type WHEN 'view' THEN 'scheduled' WHEN 'purchase' THEN 'completed' ELSE 'live' END AS status,
      CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN ' Official' ELSE 'Live' END AS source_status, event_id % 4 || '-' || event_id % 3 AS score,
      CASE WHEN event_id % 3 = 1 THEN 'Match ' || event_id % 50 END AS session_label, CASE WHEN event_id % 5 = 0 THEN 'S' || event_id % 11 END AS stage_code, 'T' || event_id % 9 AS table_no FROM events)"""


def _messages(spark, sf_dir):
    """Events as messages of live and official feeds about ties."""
    e = F.col("event_id")
    text = lambda head, n: F.concat(F.lit(head), (e % n).cast("string"))
    source = F.when(F.col("event_type") == "error", None).when((F.col("event_type") == "purchase") & (e % 3 == 0), " Official").otherwise("Live")
    return read(spark, sf_dir, "events").select(
        F.concat(F.col("user_id").cast("string"), text("-", 7)).alias("tie_code"), e.alias("seq"), F.when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "purchase", "completed").otherwise("live").alias("status"),
        source.alias("source_status"), F.concat((e % 4).cast("string"), F.lit("-"), (e % 3).cast("string")).alias("score"),
        F.when(e % 3 == 1, text("Match ", 50)).alias("session_label"), F.when(e % 5 == 0, text("S", 11)).alias("stage_code"), text("T", 9).alias("table_no"),
    )


def _tie_states(messages):
    return replay.replay(messages, "tie_code", "seq", ["status", "score"], ["source_status", "session_label"], ["stage_code"], ["table_no"])


@add(f"""
    WITH {_MESSAGES}, f AS (SELECT *, status = 'completed' AND coalesce(source_status, '') = ' Official' AS fin FROM m),
    g AS (SELECT *, coalesce(bool_or(fin) OVER (PARTITION BY tie_code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stood FROM f), a AS (SELECT * FROM g WHERE fin OR NOT stood)
    SELECT tie_code, max_by(status, seq) AS status, max_by(score, seq) AS score, max_by(source_status, seq) AS source_status, max_by(session_label, seq) AS session_label, min_by(stage_code, seq) AS stage_code,
      min_by(table_no, seq) AS table_no, max_by(fin, seq) AS final, max(seq) AS synced FROM a GROUP BY 1""")
def replayed_ties(spark, sf_dir):
    """Last state of every tie after all its messages."""
    return _tie_states(_messages(spark, sf_dir))


@add(f"""
    WITH {_MESSAGES}, f AS (SELECT *, status = 'completed' AND coalesce(source_status, '') = ' Official' AS fin FROM m),
    g AS (SELECT *, coalesce(bool_or(fin) OVER (PARTITION BY tie_code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stood FROM f),
    t AS (SELECT tie_code, max_by(status, seq) AS tie_status, max_by(source_status, seq) AS tie_source, max(seq) AS tie_synced FROM g WHERE fin OR NOT stood GROUP BY 1),
    r AS (SELECT f.*, n AS rubber_no, tie_code || '::R' || n AS rubber_code, (seq + n) % 4 || '-' || seq % 4 AS match_score, 'P' || (seq + n) % 30 AS player_a FROM f, range(1, 4) x(n) WHERE n <= seq % 4),
    h AS (SELECT *, coalesce(bool_or(fin) OVER (PARTITION BY rubber_code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stood FROM r),
    s AS (SELECT tie_code, rubber_code, max_by(status, seq) AS status, max_by(source_status, seq) AS source_status, max_by(match_score, seq) AS match_score, max_by(player_a, seq) AS player_a, max_by(fin, seq) AS final, max(seq) AS synced FROM h WHERE fin OR NOT stood GROUP BY 1, 2)
    SELECT tie_code, rubber_code, CASE WHEN NOT final AND tie_synced > synced THEN tie_status ELSE status END AS status, CASE WHEN NOT final AND tie_synced > synced THEN coalesce(tie_source, source_status) ELSE source_status END AS source_status,
      match_score, player_a, final, synced FROM s JOIN t USING (tie_code)""")
def replayed_rubbers(spark, sf_dir):
    """Last state of every rubber: its own messages, then what its tie's status hands down."""
    messages, e = _messages(spark, sf_dir), F.col("seq")
    rubber = lambda n: F.struct(F.concat(((e + n) % 4).cast("string"), F.lit("-"), (e % 4).cast("string")).alias("match_score"), F.concat(F.lit("P"), ((e + n) % 30).cast("string")).alias("player_a"))
    listed = F.transform(F.when(e % 4 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (e % 4).cast("int"))), rubber)
    rows = replay.rubber_messages(messages.withColumn("rubbers", listed), "tie_code", "rubbers")
    states = replay.replay(rows, ["tie_code", "rubber_code"], "seq", ["status", "match_score", "player_a"], ["source_status"])
    return replay.cascaded(_tie_states(messages), states, "tie_code")


_SETS_FLIPPED = ["5-11,11-7", "x,0-11", "", None]
_SETS_PLAIN = ["11-5,7-11", "x,11-0", "", None]


@add(f"""
    WITH g AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, l_orderkey % 2 = 0 AS a, {_sql(WINNERS, 'l_suppkey')} AS raw, CASE WHEN l_suppkey % 7 = 0 THEN 'INJ' END AS marker FROM lineitem),
    p AS (SELECT *, CASE WHEN raw LIKE '%-%' THEN split_part(raw, '-', 1)::INTEGER END AS x, CASE WHEN raw LIKE '%-%' THEN split_part(raw, '-', 2)::INTEGER END AS y FROM g),
    v AS (SELECT *, CASE WHEN a THEN x ELSE y END AS l, CASE WHEN a THEN y ELSE x END AS r FROM p)
    SELECT 'T' || k || '::R' || n AS rubber_code, CASE WHEN k % 3 = 0 THEN 'Match TBD' ELSE 'Match ' || k % 9 END || ' / Rubber ' || n AS session_label, CASE WHEN a THEN 'P' || s ELSE 'Q' || s END AS player_a, CASE WHEN a THEN 'Q' || s ELSE 'P' || s END AS player_b,
      CASE WHEN x IS NULL THEN raw ELSE l || '-' || r || coalesce(' ' || marker, '') END AS match_score, CASE WHEN l > r THEN 'A' WHEN r > l THEN 'B' END AS winner_side,
      coalesce(CASE WHEN a THEN {_sql(_SETS_PLAIN, 's')} ELSE {_sql(_SETS_FLIPPED, 's')} END, '') AS games, 'completed' AS status FROM v""")
def finished_rubbers(spark, sf_dir):
    """Finished rubbers in side A's view, with sets turned round where the first team is side B."""
    k, s = F.col("l_orderkey"), F.col("l_suppkey")
    games = read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("T"), k.cast("string")).alias("tie_code"), F.when(k % 3 == 0, " ").otherwise(F.concat(F.lit("Match "), (k % 9).cast("string"))).alias("tie_session"), F.col("l_linenumber").alias("game_order"),
        F.concat(F.lit(" P"), s.cast("string")).alias("player1"), F.concat(F.lit("Q"), s.cast("string"), F.lit(" ")).alias("player2"), _pick(WINNERS, s).alias("game_score"), F.when(s % 7 == 0, "INJ").alias("marker"),
        _pick(SETS, s).alias("set_scores"), (k % 2 == 0).alias("team1_is_side_a"),
    )
    return replay.completed_rubbers(games).withColumn("games", F.array_join("games", ","))


_TIES_SQL = """
    o AS (SELECT o_orderkey AS k, o_custkey AS event_id, CASE WHEN o_orderkey % 2 = 0 THEN 'MT' ELSE 'WT' END AS sub, 'T' || o_orderkey % 3 AS t1, 'T' || (o_orderkey % 3 + 1) AS t2, CASE WHEN o_orderkey % 5 = 0 THEN 'G1' END AS grp,
      CASE WHEN o_orderkey % 5 > 1 THEN 'KO' END AS stage, CASE WHEN o_orderkey % 5 > 1 THEN 'R' || o_orderkey % 2 END AS rnd, CASE WHEN o_orderkey % 4 > 0 THEN 'D' || o_orderkey % 6 END AS day, (o_orderkey % 8)::INTEGER AS no, 'T0' || o_orderkey % 4 AS tbl, o_orderpriority < '3' AS tie FROM orders),
    t AS (SELECT *, 'C' || k AS code FROM o WHERE tie), w AS (SELECT * REPLACE (t2 AS t1, t1 AS t2), CASE WHEN k % 9 = 0 THEN 'C' || (k + 1) END AS code FROM o WHERE NOT tie),
    n AS (SELECT w.k AS wid, t.k AS tid, count(*) OVER (PARTITION BY w.k, s, a, m, b) AS same, rank() OVER (PARTITION BY w.k ORDER BY s DESC, a DESC, m DESC, b DESC) AS place FROM w JOIN t ON w.event_id = t.event_id AND w.sub = t.sub AND ((w.t1 = t.t1 AND w.t2 = t.t2) OR (w.t1 = t.t2 AND w.t2 = t.t1)) AND (w.grp IS NULL OR coalesce(w.grp = t.grp, false)),
      LATERAL (SELECT w.grp IS NULL AND coalesce(w.stage = t.stage AND w.rnd = t.rnd, false) AS s, coalesce(w.day = t.day, false) AS a, w.no = t.no AS m, w.tbl = t.tbl AS b)),
    f AS (SELECT w.*, coalesce(c.k, n.tid) AS tid FROM w LEFT JOIN t c ON c.event_id = w.event_id AND c.code = w.code LEFT JOIN n ON n.wid = w.k AND n.place = 1 AND n.same = 1)"""


def _wanted(spark, sf_dir):
    """Orders of high priority as ties that are there, all others as finished results in search of one."""
    k = F.col("o_orderkey")
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    one, two = text("T", k % 3), text("T", k % 3 + 1)
    tie = F.col("o_orderpriority") < "3"
    rows = read(spark, sf_dir, "orders").select(
        k, F.col("o_custkey").alias("event_id"), F.when(k % 2 == 0, "MT").otherwise("WT").alias("sub_event_type_code"), F.when(tie, one).otherwise(two).alias("team1"), F.when(tie, two).otherwise(one).alias("team2"),
        F.when(k % 5 == 0, "G1").alias("group_code"), F.when(k % 5 > 1, "KO").alias("stage_code"), F.when(k % 5 > 1, text("R", k % 2)).alias("round_code"), F.when(k % 4 > 0, text("D", k % 6)).alias("scheduled_local_at"),
        (k % 8).cast("int").alias("match_no"), text("T0", k % 4).alias("table_no"), tie.alias("tie"),
    )
    ties = rows.where("tie").withColumn("external_match_code", text("C", k)).withColumnRenamed("o_orderkey", "tie_id").drop("tie")
    wanted = rows.where("not tie").withColumn("external_match_code", F.when(k % 9 == 0, text("C", k + 1))).withColumnRenamed("o_orderkey", "wanted_id").drop("tie")
    return wanted, ties


@add(f"WITH {_TIES_SQL} SELECT k AS wanted_id, tid AS tie_id FROM f")
def ties_of_results(spark, sf_dir):
    """The tie that each finished result means."""
    return replay.found_ties(*_wanted(spark, sf_dir)).select("wanted_id", "tie_id")


@add(f"""
    WITH {_TIES_SQL}, p AS (SELECT tid, min_by(stage, k) AS pstage, min_by(rnd, k) AS prnd, min_by(grp, k) AS pgrp, min_by(day, k) AS pday FROM f WHERE tid IS NOT NULL GROUP BY 1),
    c AS (SELECT *, coalesce(code, 'COMP::' || sub || '::' || coalesce(grp, rnd, 'UNK') || '::' || no || '::' || t1 || '-' || t2) AS named FROM f WHERE tid IS NULL)
    SELECT t.k AS tie_id, event_id, sub AS sub_event_type_code, code AS external_match_code, coalesce(stage, pstage) AS stage_code, coalesce(rnd, prnd) AS round_code, coalesce(grp, pgrp) AS group_code, coalesce(day, pday) AS scheduled_local_at, t1 AS team1, t2 AS team2, tbl AS table_no
    FROM t LEFT JOIN p ON tid = t.k UNION ALL
    SELECT NULL, event_id, sub, named, stage, rnd, grp, day, t1, t2, tbl FROM c QUALIFY row_number() OVER (PARTITION BY event_id, named ORDER BY k) = 1""")
def ties_ensured(spark, sf_dir):
    """Known ties with filled fields, and ties made for results that have none."""
    return replay.ensured_ties(*_wanted(spark, sf_dir)).drop("match_no")


@add(f"""
    WITH e AS (SELECT event_id AS seq, user_id || '-' || event_id % 9 AS code, {_sql(PAGES, 'event_id')} AS page, {_sql(["scheduled", "live", "completed", "cancelled", "walkover", "odd"], 'event_id // 5')} AS status,
      CASE WHEN event_id % 4 = 0 THEN 'T' || event_id % 8 END AS table_no, CASE WHEN event_id % 6 > 3 THEN 'Round ' || event_id % 5 END AS round_label, CASE WHEN event_id % 3 > 0 THEN event_type END AS side FROM events),
    d AS (SELECT *, CASE WHEN page LIKE '%Teams%' THEN 'team_tie' ELSE 'match' END AS kind, CASE page WHEN 'Men''s Teams' THEN 'MT' WHEN 'Women''s Singles' THEN 'WS' WHEN 'Mixed Teams' THEN 'XT' WHEN 'Women''s Teams | Final' THEN 'WT' END AS sub FROM e WHERE page <> 'Exhibition')
    SELECT kind, code, max_by(status, (CASE status WHEN 'completed' THEN 40 WHEN 'walkover' THEN 40 WHEN 'live' THEN 30 WHEN 'scheduled' THEN 20 WHEN 'cancelled' THEN 10 ELSE 0 END, seq)) AS status, max_by(sub, seq) AS sub_event_type_code, max_by(table_no, seq) AS table_no, max_by(round_label, seq) AS round_label, arg_max_null(side, seq) AS side FROM d GROUP BY 1, 2""")
def schedule_states(spark, sf_dir):
    """Ties and matches after all schedule messages; unknown disciplines are left out."""
    e = F.col("event_id")
    units = read(spark, sf_dir, "events").select(
        e.alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), (e % 9).cast("string")).alias("code"), _pick(PAGES, e).alias("page"), _pick(["scheduled", "live", "completed", "cancelled", "walkover", "odd"], F.floor(e / 5)).alias("status"),
        F.when(e % 4 == 0, F.concat(F.lit("T"), (e % 8).cast("string"))).alias("table_no"), F.when(e % 6 > 3, F.concat(F.lit("Round "), (e % 5).cast("string"))).alias("round_label"), F.when(e % 3 > 0, F.col("event_type")).alias("side"),
    )
    unit = discipline(F.lit(None).cast("string"), F.col("page"))
    return replay.scheduled_units(units, unit, is_team_discipline(F.col("sub_event_type_code")), "code", "seq", ["sub_event_type_code", "table_no", "round_label"], ["side"])


@add("""
    WITH n AS (SELECT 'N' || chr(65 + n_nationkey // 5) || chr(65 + n_nationkey % 5) AS code, n_name AS name FROM nation),
    c AS (SELECT c_custkey AS k, 'N' || chr(65 + c_nationkey // 5) || chr(65 + c_nationkey % 5) AS own FROM customer),
    p AS (SELECT k, CASE WHEN k % 3 = 0 THEN own WHEN k % 3 = 1 THEN 'ZZZ' END AS code, own, CASE k % 4 WHEN 0 THEN own WHEN 1 THEN 'LAND ' || k % 10 WHEN 2 THEN '' END AS country, CASE k % 5 WHEN 0 THEN own WHEN 1 THEN 'EN ' || k % 10 END AS en FROM c),
    q AS (SELECT *, CASE WHEN code IS NULL AND k % 4 = 0 THEN own ELSE code END AS full_code, CASE WHEN k % 4 = 1 THEN country WHEN k % 5 = 1 THEN en END AS given FROM p)
    SELECT k, full_code AS country_code, coalesce(given, n.name, CASE k % 4 WHEN 0 THEN ' ' || lower(own) || ' ' WHEN 2 THEN ' ' END) AS country, coalesce(given, n.name, CASE k % 5 WHEN 0 THEN own END) AS country_en FROM q LEFT JOIN n ON n.code = full_code""")
def country_names(spark, sf_dir):
    """Country codes and names of profiles by their own texts, else by a table of codes."""
    letters = lambda n: F.concat(F.lit("N"), F.char(F.floor(n / 5) + 65), F.char(n % 5 + 65))
    names = read(spark, sf_dir, "nation").select(letters(F.col("n_nationkey")).alias("code"), F.col("n_name").alias("name"))
    k, own = F.col("c_custkey"), letters(F.col("c_nationkey"))
    land = F.concat(F.lit("Land   "), (k % 10).cast("string"))
    profiles = read(spark, sf_dir, "customer").select(
        k.alias("k"), F.when(k % 3 == 0, F.concat(F.lit(" "), F.lower(own))).when(k % 3 == 1, "z zz").alias("country_code"),
        F.when(k % 4 == 0, F.concat(F.lit(" "), F.lower(own), F.lit(" "))).when(k % 4 == 1, land).when(k % 4 == 2, " ").alias("country"), F.when(k % 5 == 0, own).when(k % 5 == 1, F.concat(F.lit("en "), (k % 10).cast("string"))).alias("country_en"),
    )
    return identity.with_countries(profiles, names)


@add("""
    WITH p AS (SELECT l_orderkey AS k, l_suppkey % 2 + 1 AS side, 'P' || l_partkey % 6 || '|N' || l_suppkey % 2 AS who, min((l_linenumber, l_suppkey, l_partkey)) AS first, max_by(l_partkey, (l_linenumber, l_suppkey, l_partkey)) AS id FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT k, coalesce(string_agg(who || '|' || id, ',' ORDER BY first) FILTER (side = 1), '') AS a, coalesce(string_agg(who || '|' || id, ',' ORDER BY first) FILTER (side = 2), '') AS b FROM p GROUP BY 1)
    SELECT o_orderkey AS tie_id, o_orderkey % 4 || '-' || o_orderkey % 3 AS match_score, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'A' WHEN o_orderkey % 3 = 2 THEN 'B' END AS winner_side, 'R' || o_orderkey % 6 AS round_code,
      coalesce(a, '') AS players_a, coalesce(b, '') AS players_b FROM orders LEFT JOIN s ON k = o_orderkey""")
def tie_details(spark, sf_dir):
    """Details of ties from their rubbers' players."""
    k = F.col("o_orderkey")
    team = lambda head: F.concat(F.lit(head), (F.col("o_custkey") % 9).cast("string"))
    ties = read(spark, sf_dir, "orders").select(
        k.alias("tie_id"), team("A").alias("team_a"), team("B").alias("team_b"), F.when(k % 5 == 0, None).when(k % 3 == 1, team("A")).when(k % 3 == 2, team("B")).otherwise("odd").alias("winner_code"),
        (k % 4).alias("score_a"), (k % 3).alias("score_b"), F.concat(F.when(k % 2 == 0, "KO:MT:").otherwise(""), F.lit("R"), (k % 6).cast("string")).alias("round"),
    )
    players = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tie_id"), F.col("l_linenumber").alias("match_id"), (F.col("l_suppkey") % 2 + 1).alias("side_no"), F.col("l_suppkey").alias("player_no"), F.col("l_partkey").alias("player_id"),
        F.concat(F.lit("P"), (F.col("l_partkey") % 6).cast("string")).alias("name"), F.concat(F.lit("N"), (F.col("l_suppkey") % 2).cast("string")).alias("country_code"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("|", x["name"], x["country_code"], x["player_id"].cast("string"))), ",")
    shown = views.tie_detail(ties, players)
    return shown.select("tie_id", "match_score", "winner_side", "round_code", text("players_a").alias("players_a"), text("players_b").alias("players_b"))
