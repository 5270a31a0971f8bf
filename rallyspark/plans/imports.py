"""Registered queries: official single matches, rounds and rosters of ties, cleanups and inferred winners (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.scores import winner_side
from rallyspark.operators import bracket, identity, merge, replay, schedule, views
from rallyspark.operators import relational as R
from rallyspark.plans.common import Registry, read
from rallyspark.plans.reads import _pick, _sql, _text

registry = Registry()
add = registry.add

_MESSAGES = """
    m AS (SELECT event_id AS seq, user_id AS event_id, 'M' || event_id % 11 AS code, CASE event_type WHEN 'view' THEN 'scheduled' WHEN 'purchase' THEN 'completed' ELSE 'live' END AS status, CASE WHEN event_id % 3 = 0 THEN 'Official' WHEN event_id % 7 > 0 THEN 'Live' END AS source,
      event_id % 4 || '-' || event_id % 3 AS score, CASE WHEN event_id % 4 > event_id % 3 THEN 'A' WHEN event_id % 4 < event_id % 3 THEN 'B' END AS won, (event_id % 3)::INTEGER AS n FROM events),
    f AS (SELECT *, status = 'completed' AND coalesce(source, '') = 'Official' AS fin FROM m), g AS (SELECT *, coalesce(bool_or(fin) OVER (PARTITION BY event_id, code ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stood FROM f),
    last AS (SELECT event_id, code, max_by(seq, seq) AS seq FROM g WHERE fin OR NOT stood GROUP BY 1, 2), z AS (SELECT g.* FROM g JOIN last USING (event_id, code, seq))"""


def _official(spark, sf_dir):
    e = F.col("event_id")
    player = lambda side, no: F.struct((e * 10 + side * 2 + no).alias("player_id"), F.concat(F.lit("P"), (e % 50 + no).cast("string")).alias("name"), _text("N", e % 4).alias("country"))
    side = lambda n: F.struct(F.lit(n).alias("side_no"), _text("T", e % 5 + n).alias("team_code"), F.array(player(n, 1), player(n, 2)).alias("players"))
    rows = read(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("user_id"), _text("M", e % 11).alias("external_match_code"), F.when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "purchase", "completed").otherwise("live").alias("status"),
        F.when(e % 3 == 0, "Official").when(e % 7 > 0, "Live").alias("source_status"), F.concat((e % 4).cast("string"), F.lit("-"), (e % 3).cast("string")).alias("match_score"), F.when(e % 4 > e % 3, "A").when(e % 4 < e % 3, "B").alias("winner_side"),
        F.lit(None).cast("string").alias("session_label"), F.lit(None).cast("string").alias("table_no"), F.lit(None).cast("string").alias("stage_code"), F.lit(None).cast("string").alias("round_code"), F.slice(F.array(side(1), side(2)), 1, (e % 3).cast("int")).alias("sides"),
    )
    return rows.withColumnRenamed("user_id", "event_id")


@add(f"""
    WITH {_MESSAGES} SELECT event_id, code AS external_match_code, status, score AS match_score, won AS winner_side, fin AS final, seq AS synced, n::BIGINT AS sides FROM z""")
def official_singles(spark, sf_dir):
    """Single matches after all results, with the number of sides that the last one left."""
    states, sides, _ = replay.official_matches(_official(spark, sf_dir))
    count = sides.groupBy("event_id", "external_match_code").agg(F.count(F.lit(1)).alias("sides"))
    out = states.join(count, ["event_id", "external_match_code"], "left").fillna(0, subset=["sides"])
    return out.select("event_id", "external_match_code", "status", "match_score", "winner_side", "final", "synced", "sides")


@add(f"""
    WITH {_MESSAGES} SELECT event_id, code AS external_match_code, s::INTEGER AS side_no, 'T' || (seq % 5 + s) AS team_code, coalesce((won = 'A') = (s = 1), false) AS is_winner, p::INTEGER AS player_order, seq * 10 + s * 2 + p AS player_id, 'P' || (seq % 50 + p) AS name
    FROM z, range(1, 3) x(s), range(1, 3) y(p) WHERE s <= n""")
def official_players(spark, sf_dir):
    """Players of the sides of single matches: those of the last accepted result only."""
    _, sides, players = replay.official_matches(_official(spark, sf_dir))
    keys = ["event_id", "external_match_code", "side_no"]
    return players.join(sides, keys).select(*keys, "team_code", "is_winner", "player_order", "player_id", "name")


STAGES = ["MAIN", "Main Draw", "Main Draw - Division 2", "main draw - Plate", "Position matches 5-8 - Division 3", "Position matches", "Groups", " Position matches 9-12 "]
STAGES_ZH = [None, "正赛 - 甲组", "主赛", ""]
ROUNDS = ["F", "SFNL", "16", "Final", "odd", "", "8FNL", "R64"]
ROUNDS_ZH = [None, "决", "8", "sf"]


@add(f"""
    WITH o AS (SELECT o_orderkey AS id, {_sql(STAGES, 'o_orderkey')} AS stage, {_sql(STAGES_ZH, 'o_orderkey // 8')} AS zh, {_sql(ROUNDS, 'o_custkey')} AS round, {_sql(ROUNDS_ZH, 'o_custkey // 8')} AS round_zh FROM orders),
    v AS (SELECT l_orderkey AS id, ['R32', 'R16', 'QuarterFinal', 'Final'][l_partkey % 4 + 1] AS r, [30, 40, 50, 80][l_partkey % 4 + 1] AS ord, count(*) AS n FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL), modal AS (SELECT id, max_by({{'r': r, 'ord': ord}}, (n, ord)) AS v FROM v GROUP BY 1),
    a AS (SELECT *, trim(stage) AS s, CASE round WHEN 'F' THEN 'Final' WHEN 'SFNL' THEN 'SemiFinal' WHEN '16' THEN 'R16' WHEN '8FNL' THEN 'R16' ELSE round END AS name FROM o),
    b AS (SELECT *, CASE name WHEN 'Final' THEN 80 WHEN 'SemiFinal' THEN 60 WHEN 'R16' THEN 40 WHEN 'R64' THEN 20 ELSE 0 END AS ord, CASE WHEN trim(coalesce(round_zh, '')) IN ('', '8', 'sf') THEN CASE name WHEN 'Final' THEN '决赛' WHEN 'SemiFinal' THEN '半决赛' WHEN 'R16' THEN '16 强' WHEN 'R64' THEN '64 强' END ELSE round_zh END AS own_label,
      nullif(regexp_extract(s, '(?i)^Main Draw\\s*-\\s*(.+)$', 1), '') AS part, CASE WHEN regexp_matches(zh, '^(主赛|正赛)\\s*-\\s*') THEN regexp_replace(zh, '^(主赛|正赛)\\s*-\\s*', '') END AS zh_part,
      trim(regexp_replace(s, '(?i)^Position matches', '')) AS rest FROM a),
    c AS (SELECT *, coalesce(zh_part, part, '') AS said, CASE WHEN regexp_matches(rest, 'Division \\d+$') THEN trim(regexp_extract(rest, '^(.*?)\\s*-\\s*Division', 1)) ELSE rest END AS span, regexp_extract(rest, 'Division (\\d+)$', 1) AS division FROM b),
    d AS (SELECT *, CASE WHEN s = 'MAIN' THEN 'main' WHEN regexp_matches(s, '(?i)^main draw') THEN CASE WHEN said = '' THEN 'main' ELSE 'main-' || trim(regexp_replace(lower(coalesce(part, said)), '[^a-z0-9]+', '-', 'g'), '-') END
        WHEN s LIKE 'Position matches%' THEN concat_ws('-', 'position', nullif(span, ''), CASE WHEN division <> '' THEN 'division-' || division END) END AS code,
      CASE WHEN s = 'MAIN' THEN '' WHEN regexp_matches(s, '(?i)^main draw') THEN CASE WHEN regexp_matches(said, '^Division \\d+$') THEN '第' || regexp_extract(said, '(\\d+)', 1) || '级别' ELSE said END WHEN s LIKE 'Position matches%' THEN concat_ws(' ', '排位赛', nullif(span, ''), CASE WHEN division <> '' THEN '第' || division || '级别' END) END AS label FROM c)
    SELECT d.id AS tie_id, CASE WHEN v IS NOT NULL THEN v.r WHEN d.code IS NOT NULL AND ord > 0 THEN d.code || ':' || name END AS code,
      CASE WHEN v IS NOT NULL THEN CASE v.r WHEN 'R32' THEN '32 强' WHEN 'R16' THEN '16 强' WHEN 'QuarterFinal' THEN '四分之一决赛' ELSE '决赛' END WHEN d.code IS NOT NULL AND ord > 0 THEN concat_ws(' ', nullif(d.label, ''), own_label) END AS label,
      (CASE WHEN v IS NOT NULL THEN v.ord WHEN d.code IS NOT NULL AND ord > 0 THEN ord - CASE WHEN s LIKE 'Position%' THEN 1000 ELSE 0 END END)::INTEGER AS round_order FROM d LEFT JOIN modal USING (id)""")
def tie_rounds(spark, sf_dir):
    """Rounds of team ties: of most rubbers, else of the tie in its stage; position matches before all others."""
    k, c, part = F.col("o_orderkey"), F.col("o_custkey"), F.col("l_partkey")
    ties = read(spark, sf_dir, "orders").select(k.alias("tie_id"), _pick(STAGES, k).alias("stage"), _pick(STAGES_ZH, F.floor(k / 8)).alias("stage_zh"), _pick(ROUNDS, c).alias("round"), _pick(ROUNDS_ZH, F.floor(c / 8)).alias("round_zh"))
    rubbers = read(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("tie_id"), _pick(["R32", "R16", "QuarterFinal", "Final"], part).alias("draw_round"), _pick([30, 40, 50, 80], part).alias("round_order"))
    return bracket.resolved_rounds(ties, rubbers).select("tie_id", "code", "label", "round_order")


@add("""
    WITH r AS (SELECT 1 AS layer, o_custkey % 90 AS e, 'T' || o_orderkey % 7 AS team, 'P' || o_orderkey % 50 AS name FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT 2, o_custkey % 90, 'T' || o_orderkey % 7, 'Q' || o_orderkey % 50 FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 UNION ALL SELECT 3, o_custkey % 90, 'T' || o_orderkey % 7, 'R' || o_orderkey % 50 FROM orders)
    SELECT e AS event_id, team AS team_code, layer, count(DISTINCT name) AS players, min(name) AS first_ FROM r JOIN (SELECT e, team, min(layer) AS layer FROM r GROUP BY ALL) USING (e, team, layer) GROUP BY ALL""")
def team_rosters(spark, sf_dir):
    """Rosters of teams from running ties, else from group tables, else from past matches: all of the first source that has any."""
    k, o = F.col("o_orderkey"), read(spark, sf_dir, "orders")
    layer = lambda df, head: df.select((F.col("o_custkey") % 90).alias("event_id"), _text("T", k % 7).alias("team_code"), _text(head, k % 50).alias("name"))
    rows = R.first_layer(["event_id", "team_code"], layer(o.where("o_orderstatus = 'P'"), "P"), layer(o.where((F.col("o_orderpriority") == "1-URGENT") & (k % 4 == 0)), "Q"), layer(o, "R"))
    return rows.groupBy("event_id", "team_code", "layer").agg(F.count_distinct("name").alias("players"), F.min("name").alias("first_"))


WINNERS = ["Kim wins", "LEE", "kim and lee", "", None, "nobody"]
RESULTS = ["win", "L", " W ", "odd", None]
SIDES = ["side_a", "SIDE_B", None]


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, {_sql(WINNERS, 'o_orderkey')} AS w, {_sql(RESULTS, 'o_orderkey // 6')} AS res, {_sql(SIDES, 'o_custkey')} AS me, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 5 || '-' || o_custkey % 3 END AS score, CASE WHEN o_orderkey % 9 = 0 THEN ' b' END AS given FROM orders),
    t AS (SELECT *, coalesce(lower(w) LIKE '%kim%', false) AS a, coalesce(lower(w) LIKE '%lee%', false) AS b, lower(trim(coalesce(res, ''))) AS r, lower(coalesce(me, '')) AS m FROM o)
    SELECT k AS o_orderkey, CASE WHEN a AND NOT b THEN 'A' WHEN b AND NOT a THEN 'B' WHEN m <> '' AND r IN ('win', 'l', 'w') THEN CASE WHEN (m = 'side_a') = (r IN ('win', 'w')) THEN 'A' ELSE 'B' END WHEN split_part(score, '-', 1)::INTEGER > split_part(score, '-', 2)::INTEGER THEN 'A' WHEN split_part(score, '-', 1)::INTEGER < split_part(score, '-', 2)::INTEGER THEN 'B' END AS inferred,
      CASE WHEN given IS NOT NULL THEN 'B' WHEN a AND NOT b THEN 'A' WHEN b AND NOT a THEN 'B' END AS by_name FROM t""")
def inferred_winners(spark, sf_dir):
    """Winners by name, the owner's result and the score; and those of team files, by the given side or name alone."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    winner, a, b = _pick(WINNERS, k), F.array(F.lit("Kim"), F.lit("")), F.array(F.lit("Lee"))
    score = F.when(k % 4 > 0, F.concat((k % 5).cast("string"), F.lit("-"), (c % 3).cast("string")))
    inferred = identity.inferred_winner(winner, _pick(SIDES, c), _pick(RESULTS, F.floor(k / 6)), score, a, b)
    return read(spark, sf_dir, "orders").select(k, inferred.alias("inferred"), winner_side(F.when(k % 9 == 0, " b"), winner, a, b).alias("by_name"))


@add("""
    WITH n AS (SELECT name, max(zh) AS zh FROM (SELECT 'E' || p_partkey % 400 AS name, p_brand AS zh, p_partkey FROM part WHERE p_partkey % 5 > 0) GROUP BY 1), h AS (SELECT 'L' || p_partkey AS href, p_brand AS zh FROM part WHERE p_partkey % 3 = 0)
    SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN 'own' END, n.zh, h.zh) AS name_zh FROM orders LEFT JOIN n ON n.name = 'E' || o_custkey % 600 LEFT JOIN h ON h.href = 'L' || o_orderkey % 3000""")
def carried_translations(spark, sf_dir):
    """Translations of events: their own, else last year's by name, else by link."""
    p, k = F.col("p_partkey"), F.col("o_orderkey")
    previous = read(spark, sf_dir, "part").select(F.when(p % 5 > 0, _text("E", p % 400)).alias("name"), F.when(p % 3 == 0, _text("L", p)).alias("href"), F.col("p_brand").alias("name_zh"))
    incoming = read(spark, sf_dir, "orders").select(k, _text("E", F.col("o_custkey") % 600).alias("name"), _text("L", k % 3000).alias("href"), F.when(k % 6 == 0, "own").when(k % 6 == 1, "").alias("name_zh"))
    return views.carried_translations(incoming, previous, ["name_zh"]).select("o_orderkey", "name_zh")


@add("""
    WITH d AS (SELECT o_orderkey AS id, ['MT', 'WS', 'XT', 'WT', 'MD'][o_orderkey % 5 + 1] AS sub FROM orders) SELECT 'tie' AS kind, count(*) AS n FROM d WHERE sub IN ('MT', 'WT', 'XT') UNION ALL SELECT 'rubber', count(*) FROM lineitem JOIN d ON id = l_orderkey WHERE sub IN ('MT', 'WT', 'XT')
    UNION ALL SELECT 'side of ' || l_suppkey % 4, count(*) FROM lineitem JOIN d ON id = l_orderkey WHERE sub IN ('MT', 'WT', 'XT') AND l_linenumber % 2 = 0 GROUP BY 1""")
def team_cleanup(spark, sf_dir):
    """What is left of ties, rubbers and sides when ties of disciplines that no teams play are removed with all that hangs on them."""
    ties = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tie_id"), _pick(["MT", "WS", "XT", "WT", "MD"], F.col("o_orderkey")).alias("sub"))
    rubbers = read(spark, sf_dir, "lineitem")
    left = ties.where(F.col("sub").isin("MT", "WT", "XT"))
    kept, sides = merge.cascade(left, "tie_id", (rubbers, "l_orderkey"), (rubbers.where("l_linenumber % 2 = 0"), "l_orderkey"))
    count = lambda df, kind: df.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(left, F.lit("tie")).union(count(kept, F.lit("rubber"))).union(count(sides, _text("side of ", F.col("l_suppkey") % 4)))


@add("""
    WITH g AS (SELECT 'first' || c_custkey % 40 || ' last' || c_custkey % 25 AS k, 'N' || c_nationkey AS cc, list(c_custkey) AS ids FROM customer GROUP BY ALL HAVING count(*) > 1),
    s AS (SELECT 'first' || o_custkey % 40 || ' last' || o_custkey % 25 AS k, 'N' || o_custkey % 25 AS cc, min(year(o_orderdate)) AS y FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL),
    a AS (SELECT unnest(ids) AS player_id, y FROM g JOIN s USING (k, cc)) SELECT player_id, min(y)::INTEGER AS from_year, player_id % 3 > 0 AS needs_scrape FROM a GROUP BY 1""")
def same_name_plan(spark, sf_dir):
    """Players of same-name groups that occur in the events, from their first year, and whether their evidence is missing."""
    c, o = F.col("c_custkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("First"), (n % 40).cast("string"), F.lit(" LAST"), (n % 25).cast("string"))
    players = read(spark, sf_dir, "customer").select(c.alias("player_id"), name(c).alias("name"), _text("N", F.col("c_nationkey")).alias("country_code"))
    sides = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(name(o).alias("name"), _text("n", o % 25).alias("country"), F.year("o_orderdate").alias("year"))
    return identity.scrape_plan(sides, identity.same_name_groups(players), players.where("player_id % 3 = 0").select("player_id"))


@add("""
    WITH s AS (SELECT o_custkey AS e, o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 3 * 240 + o_orderkey % 60)::INTEGER) AS t, o_orderdate::DATE AS d FROM orders),
    day_ AS (SELECT e, d, list_sort(list(t)) AS ts FROM s GROUP BY ALL), x AS (SELECT *, ts[1] AS first_, coalesce(ts[2], ts[1]) AS second FROM day_),
    r AS (SELECT e, 'schedule' AS source, second + INTERVAL 420 MINUTE AS run_at FROM x UNION ALL SELECT e, 'standings', second + INTERVAL 300 MINUTE FROM x WHERE d < DATE '1998-06-01' UNION ALL SELECT e, 'backup', first_ FROM x UNION ALL SELECT e, 'promote', max_by(second, d) + INTERVAL 1440 MINUTE FROM x GROUP BY e)
    SELECT e AS event_id, source, run_at, 1::BIGINT AS labels FROM r GROUP BY ALL""")
def daily_jobs(spark, sf_dir):
    """Daily jobs of every event by its sessions, runs of one minute merged."""
    k = F.col("o_orderkey")
    at = F.timestamp_add("MINUTE", (k % 3 * 240 + k % 60).cast("int"), F.col("o_orderdate").cast("timestamp"))
    sessions = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.to_date("o_orderdate").alias("local_date"), F.lit("s").alias("label"), at.alias("start_at"), F.lit("1998-06-01").cast("date").alias("main_draw_start"))
    return schedule.merged_runs(schedule.daily_runs(sessions)).select("event_id", "source", F.col("run_at").cast("timestamp_ntz").alias("run_at"), F.size("labels").cast("long").alias("labels"))


@add("""
    WITH f AS (SELECT o_orderkey AS m, o_custkey AS e, ['MS', 'WS', 'XD'][o_orderkey % 3 + 1] AS sub FROM orders), last AS (SELECT e, sub, max(m) AS m FROM f GROUP BY ALL)
    SELECT e AS event_id, sub AS sub_event_type_code, m AS match_id, coalesce(string_agg('P' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS players FROM last LEFT JOIN lineitem ON l_orderkey = m AND l_suppkey % 10 > 0 GROUP BY ALL""")
def current_champions(spark, sf_dir):
    """The latest final of every event and discipline with all its players; players without an id do not count."""
    k = F.col("o_orderkey")
    finals = read(spark, sf_dir, "orders").select(k.alias("match_id"), F.col("o_custkey").alias("event_id"), _pick(["MS", "WS", "XD"], k).alias("sub_event_type_code"))
    last = R.top_row(finals, ["event_id", "sub_event_type_code"], F.col("match_id"))
    players = read(spark, sf_dir, "lineitem").where("l_suppkey % 10 > 0").select(F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("player_order"), F.col("l_partkey").alias("player"))
    listed = R.nested(players, ["match_id"], ["player_order", "player"], ["player_order", "player"], "players")
    return last.join(listed, "match_id", "left").select("event_id", "sub_event_type_code", "match_id", F.coalesce(F.array_join(F.transform("players", lambda p: F.concat(F.lit("P"), p["player"].cast("string"))), ","), F.lit("")).alias("players"))


@add("""
    WITH t AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'live' ELSE 'walkover' END AS s FROM orders), r AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey AS p, CASE WHEN l_returnflag = 'N' THEN 'live' ELSE 'completed' END AS s FROM lineitem)
    SELECT t.id AS tie_id, coalesce(string_agg(n || ':' || p, ',' ORDER BY n, p), '') AS rubbers FROM t LEFT JOIN r ON r.id = t.id AND (t.s = 'live' OR r.s IN ('completed', 'walkover')) GROUP BY 1""")
def shown_rubbers(spark, sf_dir):
    """Ties with their rubbers in order; a finished tie shows finished rubbers only."""
    ties = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tie_id"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "live").otherwise("walkover").alias("status"))
    rubbers = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tie_id"), F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p")).alias("rubber_order"), F.when(F.col("l_returnflag") == "N", "live").otherwise("completed").alias("status"))
    shown = F.transform("rubbers", lambda r: F.concat_ws(":", r["rubber_order"]["n"].cast("string"), r["rubber_order"]["p"].cast("string")))
    return views.tie_view(ties, R.dealt(rubbers, "tie_id")).select("tie_id", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("rubbers"))
