"""Registered queries: brackets, champions, identities and schedules over the driver's tables (see ``joins`` for what they stand for)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.text import dedup_key, side_key
from rallyspark.operators import bracket, champions, identity, schedule, stats
from rallyspark.plans.common import Registry, read
from rallyspark.sources.shared import stored

registry = Registry()
add = registry.add
ROUNDS = ("Round of 16", "QuarterFinal", "SemiFinal", "Final")
#: Customers of a block of ids and one segment are a ranking list, so lists grow in number with the table and not in size.
LIST_IDS = 5000
#: Order keys of a draw with four rounds of equal size, and of one whose rounds halve: 32, 16, 8, 4, 2 matches and one or two finals.
DRAW_IDS, KNOCKOUT_IDS = 512, 64
HALVING, STARTS = ("Round of 64", "Round of 32", "Round of 16", "QuarterFinal", "SemiFinal", "Final"), (0, 32, 48, 56, 60, 62)


def _matches(spark, sf_dir, ids=DRAW_IDS):
    """Orders as matches; a draw is a block of order keys, so draws grow in number with the table and not in size. Sides from small pools, status F won by side A, O by side B.

    Every third draw of halving rounds has a single final: it has no match of its last key.
    """
    key = lambda c: F.concat(F.lit("P"), c.cast("string"))
    k = F.col("o_orderkey")
    event, place = F.floor(k / ids), k % ids
    few = F.lit(ids != DRAW_IDS) & (place >= STARTS[4])  # few sides are left in the last two rounds, so losers of semifinals meet again
    equal = F.element_at(F.array(*map(F.lit, ROUNDS)), (F.pmod(F.floor(k / 3), F.lit(4)) + 1).cast("int"))
    halving = F.element_at(F.array(*map(F.lit, HALVING)), sum((F.when(place >= s, 1).otherwise(0) for s in STARTS), F.lit(0)))
    orders = read(spark, sf_dir, "orders")
    return (orders if ids == DRAW_IDS else orders.where((event % 3 > 0) | (place < KNOCKOUT_IDS - 1))).select(
        k.alias("match_id"), event.alias("event_id"), F.when(event % 2 == 0, "WTT_MAIN").otherwise("ITTF").alias("category_code"), F.lit("MS").alias("sub_event_type_code"),
        F.lit("Main Draw").alias("stage"), (equal if ids == DRAW_IDS else halving).alias("round"),
        key(F.when(few, k % 3).otherwise(k % 7)).alias("side_a_key"), key(F.when(few, F.col("o_custkey") % 4).otherwise(F.col("o_custkey") % 5)).alias("side_b_key"), F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").alias("winner_side"),
    )


def _draws(ids: int = DRAW_IDS) -> str:
    """The matches, draw rounds and their order in SQL."""
    halving = "CASE " + " ".join(f"WHEN o_orderkey % {ids} >= {s} THEN '{r}'" for s, r in reversed(list(zip(STARTS, ("R64", "R32", "R16", "QuarterFinal", "SemiFinal", "Final"), strict=True)))) + " END"
    equal = "['R16', 'QuarterFinal', 'SemiFinal', 'Final'][(o_orderkey // 3) % 4 + 1]"
    return f"""
    m AS (SELECT o_orderkey AS match_id, o_orderkey // {ids} AS event_id, o_orderkey // {ids} % 2 = 1 AS other, {equal if ids == DRAW_IDS else halving} AS r,
      'P' || (CASE WHEN {ids} <> {DRAW_IDS} AND o_orderkey % {ids} >= {STARTS[4]} THEN o_orderkey % 3 ELSE o_orderkey % 7 END) AS a, 'P' || (CASE WHEN {ids} <> {DRAW_IDS} AND o_orderkey % {ids} >= {STARTS[4]} THEN o_custkey % 4 ELSE o_custkey % 5 END) AS b,
      CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END AS w FROM orders WHERE {ids} = {DRAW_IDS} OR o_orderkey // {ids} % 3 > 0 OR o_orderkey % {ids} < {ids} - 1),
    los AS (SELECT DISTINCT event_id, CASE w WHEN 'A' THEN b ELSE a END AS k FROM m WHERE r = 'SemiFinal' AND w IS NOT NULL),
    duo AS (SELECT x.event_id, x.k AS lo, y.k AS hi FROM los x JOIN los y ON x.event_id = y.event_id AND x.k < y.k),
    fin AS (SELECT event_id, count(*) AS n FROM m WHERE r = 'Final' GROUP BY 1),
    d AS (SELECT m.*, CASE WHEN r = 'Final' AND other AND fin.n = 2 AND duo.lo IS NOT NULL THEN 'Bronze' ELSE r END AS draw_round
      FROM m LEFT JOIN fin ON fin.event_id = m.event_id LEFT JOIN duo ON duo.event_id = m.event_id AND lo = least(a, b) AND hi = greatest(a, b)),
    l AS (SELECT *, CASE draw_round WHEN 'R64' THEN 20 WHEN 'R32' THEN 30 WHEN 'R16' THEN 40 WHEN 'QuarterFinal' THEN 50 WHEN 'SemiFinal' THEN 60 WHEN 'Bronze' THEN 70 ELSE 80 END AS round_order FROM d)"""


_LINKS = """
    v AS (SELECT *, dense_rank() OVER (PARTITION BY event_id ORDER BY round_order) AS lv FROM l),
    asks AS (SELECT *, row_number() OVER (PARTITION BY event_id, lv, k ORDER BY match_id, n) AS i FROM (SELECT event_id, lv, match_id, 1 AS n, a AS k FROM v UNION ALL SELECT event_id, lv, match_id, 2, b FROM v)),
    wins AS (SELECT *, row_number() OVER (PARTITION BY event_id, lv, k ORDER BY match_id) AS i FROM (SELECT event_id, lv + 1 AS lv, match_id, CASE w WHEN 'A' THEN a ELSE b END AS k FROM v WHERE w IS NOT NULL)),
    f AS (SELECT asks.match_id, n, wins.match_id AS feeder FROM asks JOIN wins USING (event_id, lv, k, i))"""


def _places(levels: int = 5) -> str:
    """Places from the last round down: a level's matches by the place their feeder link gave them, those without behind."""
    out = ["t AS (SELECT v.*, max(lv) OVER (PARTITION BY event_id) - lv AS d, lv = 1 AS lowest FROM v)", "a0 AS (SELECT 0::BIGINT AS match_id, 0::BIGINT AS spot WHERE false)"]
    for d in range(levels):
        out.append(f"p{d} AS (SELECT t.*, spot, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(spot, 1000000000000), t.match_id) AS n FROM t LEFT JOIN a{d} USING (match_id) WHERE d = {d})")
        out.append(f"a{d + 1} AS (SELECT f.feeder AS match_id, (p{d}.n - 1) * 2 + f.n AS spot FROM f JOIN p{d} USING (match_id))")
    out.append("p AS (" + " UNION ALL ".join(f"SELECT event_id, match_id, draw_round, lowest, spot, n FROM p{d}" for d in range(levels)) + ")")
    return ", ".join(out)


@add(f"WITH {_draws(KNOCKOUT_IDS)} SELECT match_id, event_id, draw_round, round_order::INTEGER AS round_order, CASE WHEN draw_round = 'Bronze' THEN 'final_reclassified' END AS bronze_source FROM l")
def draw_rows(spark, sf_dir):
    """Draw rounds of matches with finals that are bronze matches in truth."""
    return bracket.draw_rows(_matches(spark, sf_dir, KNOCKOUT_IDS)).select("match_id", "event_id", "draw_round", "round_order", "bronze_source")


@add(f"""
    WITH {_draws(KNOCKOUT_IDS)}, {_LINKS}
    SELECT v.match_id, max(feeder) FILTER (n = 1) AS side_a_previous, max(feeder) FILTER (n = 2) AS side_b_previous FROM v LEFT JOIN f ON f.match_id = v.match_id GROUP BY 1""")
def bracket_links(spark, sf_dir):
    """The match of the round before that each side won."""
    return bracket.feeder_links(stored(bracket.draw_rows(_matches(spark, sf_dir, KNOCKOUT_IDS)), "draw")).select("match_id", "side_a_previous", "side_b_previous")


@add(f"""
    WITH {_draws()}, {_LINKS}, {_places()}, last AS (SELECT event_id, max(spot) AS top FROM p GROUP BY 1)
    SELECT match_id, event_id, draw_round, (CASE WHEN lowest THEN coalesce(spot, coalesce(top, 0) + n) ELSE n END)::INTEGER AS bracket_position FROM p JOIN last USING (event_id)""")
def bracket_positions(spark, sf_dir):
    """Places of matches in their brackets."""
    linked = stored(bracket.feeder_links(stored(bracket.draw_rows(_matches(spark, sf_dir)), "draw")), "linked")
    return bracket.bracket_positions(linked).select("match_id", "event_id", "draw_round", "bracket_position")


@add(f"""
    WITH {_draws(KNOCKOUT_IDS)}, x AS (SELECT event_id, min(match_id) AS match_id FROM l WHERE draw_round = 'Final' GROUP BY 1), n AS (SELECT event_id, count(*) AS n FROM l WHERE draw_round = 'Final' GROUP BY 1)
    SELECT event_id, CASE l.w WHEN 'A' THEN a WHEN 'B' THEN b END AS champion_name, CASE WHEN l.w IS NOT NULL THEN NULL ELSE 'unresolved_winner_side' END AS issue FROM x JOIN l USING (event_id, match_id) JOIN n USING (event_id) WHERE n.n = 1""")
def champions_single_final(spark, sf_dir):
    """Champions of draws with exactly one final."""
    rows = bracket.draw_rows(_matches(spark, sf_dir, KNOCKOUT_IDS))
    one = rows.where("draw_round = 'Final'").groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("event_id")
    return champions.champions(stored(_rosters(rows).join(one, "event_id", "left_semi"), "rosters")).select("event_id", "champion_name", "issue")


def _rosters(rows):
    roster = lambda c: F.array(F.struct(F.col(c).alias("name"), F.lit("N1").alias("country"), F.expr("bigint(null)").alias("player_id")))
    return rows.withColumns({"side_a": roster("side_a_key"), "side_b": roster("side_b_key"), "winner_name": F.lit(None).cast("string"), "match_score": F.lit(None).cast("string")})


@add(f"""
    WITH {_draws(KNOCKOUT_IDS)}, y AS (SELECT *, CASE w WHEN 'A' THEN a WHEN 'B' THEN b END AS k FROM l),
    q AS (SELECT event_id, list(DISTINCT k) FILTER (k IS NOT NULL) AS through FROM y WHERE draw_round = 'QuarterFinal' GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT k) >= 2),
    s AS (SELECT event_id, list_sort(list(DISTINCT k) FILTER (k IS NOT NULL AND list_contains(through, a) AND list_contains(through, b))) AS last_two FROM y JOIN q USING (event_id) WHERE draw_round = 'SemiFinal' GROUP BY 1 HAVING count(*) >= 2),
    fi AS (SELECT l.*, coalesce(len(last_two) = 2 AND list_sort([a, b]) = last_two, false) AS hit FROM l LEFT JOIN s USING (event_id) WHERE draw_round = 'Final'),
    pick AS (SELECT event_id, count(*) > 1 AND count(*) FILTER (hit) <> 1 AS fallback, CASE WHEN count(*) > 1 AND count(*) FILTER (hit) = 1 THEN min(match_id) FILTER (hit) ELSE min(match_id) END AS match_id FROM fi GROUP BY 1)
    SELECT event_id, 'MS' AS sub_event_type_code, CASE WHEN w IS NOT NULL THEN '' END AS champion_player_ids, CASE w WHEN 'A' THEN a WHEN 'B' THEN b END AS champion_name, CASE WHEN w IS NOT NULL THEN 'N1' END AS champion_country_code,
      fallback, CASE WHEN w IS NULL THEN 'unresolved_winner_side' END AS issue FROM fi JOIN pick USING (event_id, match_id)""")
def champions_all(spark, sf_dir):
    """Champions of all draws; of several finals the one between the semifinal winners."""
    return champions.champions(stored(_rosters(bracket.draw_rows(_matches(spark, sf_dir, KNOCKOUT_IDS))), "rosters"))


@add()
def team_champions(spark, sf_dir):
    """Team champions by rubbers of the final tie."""
    return champions.champions(stored(_rosters(bracket.draw_rows(_matches(spark, sf_dir).withColumn("sub_event_type_code", F.lit("MT")))), "rosters"))


@add("""
    WITH r AS (SELECT o_custkey AS player_id, o_orderkey % 7 AS event_id, o_orderkey AS seq, ['R32', 'R16', 'QuarterFinal', 'SemiFinal', 'Final'][o_orderkey % 5 + 1] AS round, (o_orderkey % 5 + 4)::INTEGER AS weight, o_orderkey % 11 = 0 AS title FROM orders),
    b AS (SELECT player_id, event_id, list_reduce(list({'weight': weight, 'title': title, 'round': round} ORDER BY seq), lambda h, x: CASE WHEN x.weight > h.weight OR (x.title AND NOT h.title) THEN x ELSE h END) AS best FROM r GROUP BY 1, 2)
    SELECT player_id, event_id, 'WS' AS sub_event_type_code, CASE WHEN best.title THEN '冠军' ELSE best.round END AS result, best.weight AS weight, best.title AS is_champion FROM b""")
def best_result_fold(spark, sf_dir):
    """Best result of each player, event and discipline in source order."""
    o = read(spark, sf_dir, "orders")
    rows = o.select(
        F.col("o_custkey").alias("player_id"), (F.col("o_orderkey") % 7).alias("event_id"), F.lit("WS").alias("sub_event_type_code"), F.col("o_orderkey").alias("seq"),
        F.element_at(F.array(*map(F.lit, ("R32", "R16", "QuarterFinal", "SemiFinal", "Final"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("round"), (F.col("o_orderkey") % 11 == 0).alias("is_champion"),
    )
    return stats.best_results(rows)


def _merge_sql(various: bool) -> str:
    """The greedy merge row by row; ``various``: names with years and more words, results without ids, named aliases."""
    years = "CASE WHEN seq % 9 = 0 THEN [n, n || ' (1999)'] ELSE [n] END" if various else "[n]"
    more, known = ("CASE WHEN seq % 6 = 0 THEN ' jun' ELSE '' END", "seq % 31 > 0") if various else ("''", "true")
    return f"""
    WITH RECURSIVE c AS (SELECT c_mktsegment || '/' || c_custkey // {LIST_IDS} AS category, c_custkey AS seq, 'player ' || c_custkey % 400 AS n, 'N' || c_custkey % 3 AS cc, c_custkey % 50 AS points FROM customer),
    weekly AS (SELECT category, seq, seq AS rank, cc, points, {years} AS names FROM c),
    res AS (SELECT category, seq, seq + seq % 5 AS rank, cc, points + (seq % 4 = 0)::INTEGER AS points, n || {more} AS n, CASE WHEN {known} THEN 'id' || seq END AS id FROM c),
    alias AS (SELECT DISTINCT 'player ' || c_custkey % 400 AS n, 'N' || c_custkey % 3 AS cc, CASE WHEN c_custkey % 2 = 0 THEN 'id' || (c_custkey + 15) END AS pid, 'player ' || (c_custkey + 3) % 400 AS other FROM customer WHERE {'c_custkey % 97 = 0' if various else 'false'}),
    words AS (SELECT category, seq, cc, unnest(names) AS n FROM weekly),
    w2 AS (SELECT category, seq, cc, list_distinct(list_concat(string_split(names[1], ' '), CASE WHEN len(names) > 1 THEN ['(1999)'] ELSE [] END)) AS ws FROM weekly),
    pairs AS (
      SELECT DISTINCT w.category, w.seq, 0 AS kind, r.seq AS result FROM words w JOIN res r ON r.category = w.category AND r.cc = w.cc AND r.n = w.n
      UNION SELECT w.category, w.seq, 1, r.seq FROM words w JOIN alias a ON a.cc = w.cc AND a.n = w.n JOIN res r ON r.category = w.category AND r.cc = w.cc AND CASE WHEN a.pid IS NOT NULL THEN coalesce(r.id = a.pid, false) ELSE r.n = a.other END
      UNION SELECT w.category, w.seq, 2, r.seq FROM w2 w JOIN res r ON r.category = w.category AND r.cc = w.cc AND (list_has_all(w.ws, string_split(r.n, ' ')) OR list_has_all(string_split(r.n, ' '), w.ws))),
    cand AS (SELECT p.category, p.seq, list({{'kind': kind, 'rank': r.rank, 'points': r.points, 'id': r.id}}) AS cs FROM pairs p JOIN res r ON r.category = p.category AND r.seq = p.result GROUP BY ALL),
    k AS (SELECT w.category, w.seq, w.rank, w.points, coalesce(cs, []) AS cs, row_number() OVER (PARTITION BY w.category ORDER BY w.seq) AS n FROM weekly w LEFT JOIN cand USING (category, seq)),
    s AS (
      SELECT category, 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::BIGINT AS seq, NULL::VARCHAR AS player_id, NULL::BIGINT AS results_rank, NULL::VARCHAR AS status FROM (SELECT DISTINCT category FROM k)
      UNION ALL
      SELECT category, n, CASE WHEN one.id IS NULL THEN used ELSE list_append(used, one.id) END, seq, one.id, one.rank,
        CASE WHEN len(found) = 0 THEN 'unmatched' WHEN tie THEN 'ambiguous' WHEN len(found) = 1 THEN label WHEN label LIKE 'manual%' THEN 'manual_alias_rank_fallback' ELSE 'rank_fallback' END
      FROM (SELECT *, CASE WHEN NOT tie THEN found[1] END AS one FROM (SELECT *, coalesce(len(found) > 1 AND found[1].far = found[2].far, false) AS tie
        FROM (SELECT *, list_sort(list_transform(chosen, lambda x: {{'far': abs(rank - x.rank), 'rank': x.rank, 'id': x.id}})) AS found
          FROM (SELECT *, CASE WHEN len(e) > 0 THEN e WHEN len(l) > 0 THEN l WHEN len(ap) > 0 THEN ap WHEN len(a) > 0 THEN a WHEN len(pp) > 0 THEN pp ELSE p END AS chosen,
              CASE WHEN len(l) > 0 THEN 'matched' WHEN len(ap) > 0 THEN 'manual_alias' WHEN len(a) > 0 THEN 'manual_alias_rank_fallback' ELSE 'partial_name' END AS label
            FROM (SELECT *, list_filter(l, lambda x: x.points = points) AS e, list_filter(a, lambda x: x.points = points) AS ap, list_filter(p, lambda x: x.points = points) AS pp
              FROM (SELECT *, list_filter(open_, lambda x: x.kind = 0) AS l, list_filter(open_, lambda x: x.kind = 1) AS a, list_filter(open_, lambda x: x.kind = 2) AS p
                FROM (SELECT k.*, s.used, list_filter(k.cs, lambda x: x.id IS NULL OR NOT list_contains(s.used, x.id)) AS open_ FROM s JOIN k ON k.category = s.category AND k.n = s.n + 1))))))))
    SELECT category, seq, player_id, results_rank, status FROM s WHERE n > 0"""


def _lists(spark, sf_dir):
    """Customers of a block of ids and one segment as a weekly list and its results list."""
    name = lambda c: F.concat_ws(" ", F.lit("Player"), (F.col(c) % 400).cast("string"))
    category = F.concat_ws("/", "c_mktsegment", F.floor(F.col("c_custkey") / LIST_IDS).cast("string"))
    weekly = read(spark, sf_dir, "customer").select(category.alias("category"), F.col("c_custkey").alias("seq"), F.col("c_custkey").alias("rank"), name("c_custkey").alias("name"), F.concat(F.lit("N"), (F.col("c_custkey") % 3).cast("string")).alias("country_code"), (F.col("c_custkey") % 50).alias("points"))
    results = weekly.select("category", "seq", (F.col("rank") + F.col("seq") % 5).alias("rank"), "name", "country_code", (F.col("points") + F.when(F.col("seq") % 4 == 0, 1).otherwise(0)).alias("points"), F.concat(F.lit("id"), F.col("seq").cast("string")).alias("player_id"))
    return weekly, results


@add(_merge_sql(False))
def ranking_id_merge(spark, sf_dir):
    """Ids of every ranking list from its results list, each id once in a list."""
    return identity.merge_ranking_ids(*_lists(spark, sf_dir)).select("category", "seq", "player_id", "results_rank", "status")


@add(_merge_sql(True))
def ranking_ids_by_alias(spark, sf_dir):
    """The same with names that differ: by a year, by more words, or by a named alias; some results have no id."""
    weekly, results = _lists(spark, sf_dir)
    number = F.col("c_custkey")
    named = lambda c: F.concat_ws(" ", F.lit("Player"), (c % 400).cast("string"))
    weekly = weekly.withColumn("name", F.when(F.col("seq") % 9 == 0, F.concat(F.lit(" "), F.upper("name"), F.lit("  (1999)"))).otherwise(F.col("name")))
    results = results.withColumns({"name": F.concat("name", F.when(F.col("seq") % 6 == 0, " Jun").otherwise("")), "player_id": F.when(F.col("seq") % 31 > 0, F.col("player_id"))})
    aliases = read(spark, sf_dir, "customer").where(number % 97 == 0).select(
        F.concat(F.lit("N"), (number % 3).cast("string")).alias("country_code"), named(number).alias("weekly_name"), named(number + 3).alias("results_name"), F.when(number % 2 == 0, F.concat(F.lit("id"), (number + 15).cast("string"))).alias("player_id"),
    )
    return identity.merge_ranking_ids(weekly, results, aliases).select("category", "seq", "player_id", "results_rank", "status")


@add("""
    WITH i AS (SELECT lower(p_name) AS k, p_brand AS c, min(p_partkey) AS lo, max(p_partkey) AS hi FROM part GROUP BY 1, 2)
    SELECT s_suppkey, CASE WHEN lo = hi THEN lo END AS player_id, CASE WHEN lo IS NULL THEN 'unmatched' WHEN lo = hi THEN 'matched' ELSE 'ambiguous' END AS status FROM (
      SELECT s_suppkey, p_name AS n, 'Brand#' || (s_suppkey % 26) AS c FROM supplier JOIN part ON p_partkey = s_suppkey) a LEFT JOIN i ON i.k = lower(a.n) AND upper(i.c) = upper(a.c)""")
def resolve_players(spark, sf_dir):
    """Ids by name and country: one candidate, several or none. Names here have their words in order, so one key decides."""
    part = read(spark, sf_dir, "part")
    ordered = part.withColumn("name", F.lower("p_name"))
    players = ordered.select(F.col("p_partkey").alias("player_id"), "name", F.col("p_brand").alias("country_code"))
    index = identity.player_index(players).where(F.col("key") == F.lower("key"))
    asks = read(spark, sf_dir, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select("s_suppkey", F.lower("p_name").alias("name"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 26).cast("string")).alias("country"))
    raw = index.join(players.select(F.col("name").alias("key")).distinct(), "key", "left_semi")
    return identity.resolve_players(asks, raw).select("s_suppkey", "player_id", "status")


@add("""
    WITH s AS (SELECT l_orderkey, array_to_string(list(lower('s' || l_suppkey) || '|' || lower(l_returnflag) ORDER BY lower('s' || l_suppkey) || '|' || lower(l_returnflag)), '||') AS k FROM lineitem GROUP BY 1)
    SELECT l_orderkey, k AS side, 'order|x|y|z|' || least(k, 'm') || '|' || greatest(k, 'm') AS dedup FROM s""")
def match_side_key(spark, sf_dir):
    """Keys of sides and matches that do not depend on the order of players or sides."""
    sides = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("name"), F.col("l_returnflag").alias("country"))).alias("p"))
    keyed = sides.select("l_orderkey", side_key(F.col("p")).alias("side"))
    return keyed.withColumn("dedup", dedup_key(F.lit(" Order, presented by nobody"), F.lit("x"), F.lit("y"), F.lit("z"), F.col("side"), F.lit("m")))


@add("""
    WITH s AS (SELECT o_custkey AS event_id, o_orderdate + to_hours((o_orderkey % 12)::INTEGER) AS t FROM orders WHERE o_orderpriority = '1-URGENT'),
    r AS (SELECT event_id, 'live' AS source, unnest(generate_series(t, t + INTERVAL 359 MINUTE, INTERVAL 10 MINUTE)) AS run_at FROM s
      UNION ALL SELECT event_id, 'official_reconcile', unnest(list_append(generate_series(t + INTERVAL 5 MINUTE, t + INTERVAL 359 MINUTE, INTERVAL 1 HOUR), t + INTERVAL 6 HOUR)) FROM s)
    SELECT event_id, source, run_at, count(*)::BIGINT AS n FROM r GROUP BY 1, 2, 3""")
def schedule_jobs(spark, sf_dir):
    """Refresh jobs of sessions: windows expanded to runs, counted by minute."""
    at = F.timestamp_add("HOUR", (F.col("o_orderkey") % 12).cast("int"), F.col("o_orderdate").cast("timestamp"))
    o = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    sessions = o.select(F.col("o_custkey").alias("event_id"), F.to_date("o_orderdate").alias("local_date"), F.lit("s").alias("label"), at.alias("start_at"), F.lit("2999-01-01").cast("date").alias("main_draw_start"))
    return schedule.session_runs(sessions).groupBy("event_id", "source", F.col("run_at").cast("timestamp_ntz").alias("run_at")).agg(F.count(F.lit(1)).alias("n"))


@add("""
    WITH t AS (SELECT min(o_orderkey) AS tie_id, count(*) AS n, o_custkey % 300 AS e, least(o_orderkey % 5, o_custkey % 7) AS lo, greatest(o_orderkey % 5, o_custkey % 7) AS hi FROM orders WHERE o_orderstatus = 'F' GROUP BY e, lo, hi)
    SELECT o_orderkey AS match_id, CASE WHEN n = 1 THEN tie_id END AS tie_id FROM orders LEFT JOIN t ON e = o_custkey % 300 AND lo = least(o_orderkey % 7, o_custkey % 5) AND hi = greatest(o_orderkey % 7, o_custkey % 5) WHERE o_orderstatus = 'O'""")
def link_rubbers(spark, sf_dir):
    """Rubbers linked to the only tie of their countries in either order."""
    o = read(spark, sf_dir, "orders").withColumns({"event_id": F.col("o_custkey") % 300, "sub_event_type_code": F.lit("MT"), "stage": F.lit("s"), "round": F.lit("r")})
    keys = ["event_id", "sub_event_type_code", "stage", "round"]
    ties = o.where("o_orderstatus = 'F'").select(*keys, F.col("o_orderkey").alias("tie_id"), (F.col("o_orderkey") % 5).alias("team_a"), (F.col("o_custkey") % 7).alias("team_b"))
    rubbers = o.where("o_orderstatus = 'O'").select(*keys, F.col("o_orderkey").alias("match_id"), (F.col("o_orderkey") % 7).alias("country_a"), (F.col("o_custkey") % 5).alias("country_b"))
    return schedule.link_rubbers(rubbers, ties).select("match_id", "tie_id")
