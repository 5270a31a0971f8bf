"""Registered queries: aggregates, rankings and windows over the driver's tables (see ``joins`` for what they stand for)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.functions.scores import guarded_ratio
from rallyspark.functions.text import slugify, stage_token
from rallyspark.operators import relational as R
from rallyspark.operators import stats
from rallyspark.plans.common import Registry, cents, read

registry = Registry()
add = registry.add


@add("""
    SELECT o_custkey, count(DISTINCT o_orderpriority || o_orderstatus)::BIGINT AS keys, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END)::BIGINT AS done,
      count(DISTINCT CASE WHEN o_totalprice > 200000 THEN year(o_orderdate) END)::BIGINT AS dear_years FROM orders GROUP BY 1""")
def distinct_conditional(spark, sf_dir):
    """Several conditional distinct counts of one key in one pass."""
    when = lambda c, v: F.count_distinct(F.when(c, v))
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count_distinct(F.concat("o_orderpriority", "o_orderstatus")).alias("keys"), when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("done"),
        when(F.col("o_totalprice") > 200000, F.year("o_orderdate")).alias("dear_years"),
    )


@add("""
    WITH rows AS (SELECT a.l_orderkey, a.l_suppkey, sa.s_nationkey AS own, sb.s_nationkey AS other, a.l_returnflag FROM lineitem a JOIN supplier sa ON sa.s_suppkey = a.l_suppkey
      LEFT JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber <> a.l_linenumber LEFT JOIN supplier sb ON sb.s_suppkey = b.l_suppkey),
    fold AS (SELECT l_orderkey, l_suppkey, min(own) AS own, min(l_returnflag) AS flag, list(DISTINCT other) FILTER (other IS NOT NULL) AS others FROM rows GROUP BY 1, 2)
    SELECT l_suppkey, count(*) FILTER (len(others) > 0 AND len(list_filter(others, lambda x: x <> own)) = 0)::BIGINT AS domestic,
      count(*) FILTER (len(list_filter(others, lambda x: x <> own)) > 0)::BIGINT AS foreign_matches, count(*) FILTER (len(list_filter(others, lambda x: x <> own)) > 0 AND flag = 'A')::BIGINT AS foreign_wins
    FROM fold GROUP BY 1""")
def two_level_fold(spark, sf_dir):
    """Fold to (match, player) with the set of opponents' countries, then domestic and foreign counts of each player."""
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("own"))
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag").join(home, "l_suppkey")
    other = lines.select(F.col("l_orderkey").alias("other_order"), F.col("l_linenumber").alias("other_line"), F.col("own").alias("other"))
    rows = lines.join(other, (F.col("l_orderkey") == F.col("other_order")) & (F.col("l_linenumber") != F.col("other_line")), "left")
    fold = rows.groupBy("l_orderkey", "l_suppkey").agg(F.min("own").alias("own"), F.min("l_returnflag").alias("flag"), F.collect_set("other").alias("others"))
    same = F.forall("others", lambda x: x == F.col("own"))
    return fold.groupBy("l_suppkey").agg(F.count_if((F.size("others") > 0) & same).alias("domestic"), F.count_if(~same).alias("foreign_matches"), F.count_if(~same & (F.col("flag") == "A")).alias("foreign_wins"))


@add("""
    WITH v AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)
    SELECT c_nationkey, c_mktsegment AS majority FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS r FROM v) WHERE r = 1""")
def majority_vote_lex(spark, sf_dir):
    """Most frequent segment of each nation, the least on a tie."""
    return R.majority(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


@add("""
    WITH v AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS seen FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_returnflag AS majority FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, l_returnflag) AS r FROM v) WHERE r = 1""")
def majority_first_seen(spark, sf_dir):
    """Most frequent flag of each order, the one seen first on a tie."""
    return R.majority(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", first_seen="l_linenumber")


@add("""
    WITH w AS (SELECT l_orderkey, l_suppkey, count(*) AS wins FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), m AS (SELECT *, max(wins) OVER (PARTITION BY l_orderkey) AS top FROM w)
    SELECT l_orderkey, CASE WHEN count(*) FILTER (wins = top) = 1 THEN max(l_suppkey) FILTER (wins = top) END AS winner FROM m GROUP BY 1""")
def unique_argmax(spark, sf_dir):
    """The supplier with most wins of each order, none where two share them."""
    wins = read(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("wins"))
    return R.unique_argmax(wins, "l_orderkey", "l_suppkey", "wins")


@add("""
    WITH s AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS v FROM lineitem)
    SELECT a.l_orderkey, a.v AS first, b.v AS second FROM s a JOIN s b ON a.l_orderkey = b.l_orderkey AND a.v < b.v""")
def set_pairs(spark, sf_dir):
    """Two-element combinations of each order's set."""
    return R.set_pairs(read(spark, sf_dir, "lineitem").withColumn("v", F.concat("l_returnflag", "l_linestatus")), "l_orderkey", "v")


@add("""
    WITH t AS (SELECT o_orderpriority AS group_code, 'T' || (o_custkey % 8) AS team_a, 'T' || ((o_custkey // 8) % 8) AS team_b, o_orderkey % 4 AS a, (o_orderkey // 4) % 4 AS b FROM orders),
    r AS (SELECT group_code, team_a AS team_code, a > b AS won, a AS plus, b AS minus FROM t WHERE a <> b UNION ALL SELECT group_code, team_b, b > a, b, a FROM t WHERE a <> b),
    g AS (SELECT group_code, team_code, count(*)::BIGINT AS played, count(*) FILTER (won)::BIGINT AS won, sum(plus)::BIGINT AS score_for, sum(minus)::BIGINT AS score_against FROM r GROUP BY 1, 2)
    SELECT group_code, team_code, played, won, won AS points, score_for, score_against, played - won AS lost, score_for - score_against AS difference,
      row_number() OVER (PARTITION BY group_code ORDER BY won DESC, score_for - score_against DESC, score_for DESC, team_code)::INTEGER AS rank FROM g""")
def standings_from_results(spark, sf_dir):
    """Group tables from ties: each order is a tie of two teams with a score."""
    code = lambda c: F.concat(F.lit("T"), c.cast("long").cast("string"))
    ties = read(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("group_code"), code(F.col("o_custkey") % 8).alias("team_a"), code(F.floor(F.col("o_custkey") / 8) % 8).alias("team_b"), F.lit(None).cast("string").alias("winner_side"),
        F.concat_ws("-", (F.col("o_orderkey") % 4).cast("string"), (F.floor(F.col("o_orderkey") / 4) % 4).cast("string")).alias("match_score"),
    )
    teams = ties.select("group_code", F.explode(F.array("team_a", "team_b")).alias("team_code"))
    return stats.standings(teams, ties)


@add("""
    SELECT n_nationkey, count(c_custkey)::BIGINT AS customers, count(c_custkey) FILTER (c_acctbal < 0)::BIGINT AS debtors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' GROUP BY 1""")
def zero_filled_groups(spark, sf_dir):
    """Every nation with its counts, zeros where there are none."""
    c = read(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'").withColumnRenamed("c_nationkey", "n_nationkey")
    return R.zero_filled(read(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", c, customers=F.count(F.lit(1)), debtors=F.count_if(F.col("c_acctbal") < 0))


@add("SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 20")
def top_n_frequency(spark, sf_dir):
    """The 20 most frequent names."""
    return R.top_n(read(spark, sf_dir, "part"), "p_name", 20)


@add("SELECT l_suppkey, l_returnflag, min(l_linenumber) AS first_line, max(l_partkey) AS last_part, count(*)::BIGINT AS appearances FROM lineitem GROUP BY 1, 2")
def min_max_roster(spark, sf_dir):
    """Roster by name and country: least order, largest id and appearances."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.min("l_linenumber").alias("first_line"), F.max("l_partkey").alias("last_part"), F.count(F.lit(1)).alias("appearances"))


@add("""
    SELECT o_custkey, o_orderkey, least(min(o_orderkey) OVER w, o_orderkey) AS best, min(o_orderkey) OVER w IS NULL OR o_orderkey < min(o_orderkey) OVER w AS is_best FROM orders
    WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def running_best(spark, sf_dir):
    """Least value so far of each customer and the rows that set it."""
    return R.running_best(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "best", "is_best")


@add("""
    SELECT o_custkey, min(o_orderkey % 500) AS best_rank, min_by(strftime(o_orderdate, '%Y-%m'), (o_orderkey % 500, o_orderdate, o_orderkey)) AS best_month FROM orders GROUP BY 1""")
def career_best(spark, sf_dir):
    """Best rank of each player and the month in which it was first reached."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 500).alias("rank"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return R.career_best(rows, "o_custkey", "rank", "at", F.col("month"))


@add("""
    WITH h AS (SELECT DISTINCT user_id, ts::DATE AS day, hour(ts)::BIGINT AS h FROM events), r AS (SELECT *, h - row_number() OVER (PARTITION BY user_id, day ORDER BY h) AS run FROM h)
    SELECT user_id, day, min(h) AS first, max(h) AS last, count(*)::BIGINT AS n FROM r GROUP BY user_id, day, run""")
def hourly_islands(spark, sf_dir):
    """Runs of consecutive hours with events of each user and day."""
    rows = read(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").cast("long").alias("h"))
    return R.islands(rows, ["user_id", "day"], "h")


@add("""
    SELECT event_id, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS segment FROM (
      SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)""")
def change_counter(spark, sf_dir):
    """Number of the run of equal event types of each user."""
    return R.change_counter(read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "segment")


@add("""
    SELECT o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), date_trunc('month', o_orderdate + to_days(o_orderkey::INTEGER % 100)), INTERVAL 1 MONTH))::DATE AS month
    FROM orders WHERE o_orderpriority = '1-URGENT'""")
def month_expansion(spark, sf_dir):
    """One row for each month that a span touches."""
    rows = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.to_date("o_orderdate").alias("s"))
    return R.months_covered(rows.withColumn("e", F.date_add("s", (F.col("o_orderkey") % 100).cast("int"))), "s", "e").select("o_orderkey", "month")


@add("""
    SELECT r_name, n_name, grouping(r_name)::INTEGER AS no_region, grouping(n_name)::INTEGER AS no_nation, count(*)::BIGINT AS n, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS cents
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY CUBE (r_name, n_name)""")
def rollup_cube(spark, sf_dir):
    """Sums by every subset of region and nation."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.cube("r_name", "n_name").agg(F.grouping("r_name").cast("int").alias("no_region"), F.grouping("n_name").cast("int").alias("no_nation"), F.count(F.lit(1)).alias("n"), F.sum(cents("c_acctbal")).alias("cents"))


@add("""
    SELECT o_custkey, o_orderkey, sum(round(o_totalprice * 100)::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three,
      ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)::INTEGER AS quarter, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INTEGER AS tier,
      lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_order FROM orders""")
def window_frames(spark, sf_dir):
    """Moving sums, quartiles, dense ranks and leads of each customer's orders."""
    by = W.partitionBy("o_custkey")
    time = by.orderBy("o_orderdate", "o_orderkey")
    return read(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.sum(cents("o_totalprice")).over(time.rowsBetween(-2, 0)).alias("last_three"), F.ntile(4).over(by.orderBy("o_totalprice", "o_orderkey")).alias("quarter"),
        F.dense_rank().over(by.orderBy("o_orderpriority")).alias("tier"), F.lead("o_orderkey").over(time).alias("next_order"),
    )


@add("SELECT l_suppkey, count(*)::BIGINT AS n, avg(l_linenumber) AS mean_line FROM lineitem GROUP BY 1 HAVING count(*) > 600")
def having_filter(spark, sf_dir):
    """Groups above a size."""
    return read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_linenumber").alias("mean_line")).where("n > 600")


@add()
def approx_distinct(spark, sf_dir):
    """Approximate distinct parts and median price of each flag."""
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median_price"))


@add("""
    SELECT o_orderkey, o_orderpriority, coalesce(nullif(list_position(['2-HIGH', '1-URGENT'], o_orderpriority), 0), 3)::INTEGER AS place FROM orders
    ORDER BY place, o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100""")
def preferred_order(spark, sf_dir):
    """Listed codes first in their order, others by code; the first 100."""
    wanted = ["2-HIGH", "1-URGENT"]
    at = F.array_position(F.array(*map(F.lit, wanted)), F.col("o_orderpriority"))
    rows = read(spark, sf_dir, "orders").withColumn("place", F.when(at > 0, at).otherwise(3).cast("int"))
    return rows.orderBy(*R.preferred_order(F.col("o_orderpriority"), wanted), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderpriority", "place").limit(100)


@add("""
    WITH k AS (SELECT *, o_orderstatus = 'F' AS keep, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey, o_orderpriority) AS any_kept FROM orders)
    SELECT o_orderkey, o_custkey FROM k WHERE keep OR NOT any_kept""")
def filter_unless_empty(spark, sf_dir):
    """Finished orders of each customer and priority; all of them where none is finished."""
    return R.filter_unless_empty(read(spark, sf_dir, "orders"), ["o_custkey", "o_orderpriority"], F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@add("""
    SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g') AS slug, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS token FROM part""")
def slugs(spark, sf_dir):
    """Slug of every name and token of every brand."""
    return read(spark, sf_dir, "part").select("p_partkey", slugify(F.col("p_name")).alias("slug"), stage_token(F.col("p_brand")).alias("token"))


@add("""
    WITH m AS (SELECT l_orderkey AS match_id, (l_linenumber - 1) % 2 + 1 AS side_no, l_suppkey AS player_id FROM lineitem),
    o AS (SELECT a.match_id, a.player_id, b.player_id AS opponent_id, a.side_no FROM m a JOIN m b ON a.match_id = b.match_id AND a.side_no <> b.side_no)
    SELECT player_id, opponent_id, s_name AS opponent_name, count(*)::BIGINT AS matches, count(*) FILTER ((o_orderstatus = 'F' AND side_no = 1) OR (o_orderstatus = 'O' AND side_no = 2))::BIGINT AS wins,
      max(o_orderdate) AS latest_date, count(*) FILTER ((o_orderstatus = 'F' AND side_no = 1) OR (o_orderstatus = 'O' AND side_no = 2))::DOUBLE / count(*)::DOUBLE * 100.0 AS win_rate
    FROM o JOIN orders ON o_orderkey = match_id JOIN supplier ON s_suppkey = opponent_id GROUP BY 1, 2, 3""")
def opponent_table(spark, sf_dir):
    """Opponents of each player with matches, wins, latest date and rate; status F is won by side A, O by side B."""
    sides = read(spark, sf_dir, "lineitem").select("l_orderkey", ((F.col("l_linenumber") - 1) % 2 + 1).alias("l_linenumber"), "l_suppkey")
    pairs = R.opponents(sides, "l_orderkey", "l_linenumber", "l_suppkey")
    winner = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B")
    matches = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), winner.alias("winner_side"), F.col("o_orderdate").alias("start_date"))
    names = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("opp_l_suppkey"), F.col("s_name").alias("opponent_name"))
    rows = pairs.join(matches, "l_orderkey").join(names, "opp_l_suppkey").select(F.col("l_suppkey").alias("player_id"), F.col("opp_l_suppkey").alias("opponent_id"), "opponent_name", "winner_side", F.col("l_linenumber").alias("side_no"), "start_date")
    return stats.opponent_table(rows)


def _stat_rows(spark, sf_dir):
    """Player rows of the driver's tables in the shape of ``stats.player_stats``."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match_id"), ((F.col("l_linenumber") - 1) % 2 + 1).alias("side_no"), F.col("l_suppkey").alias("player_id"))
    home = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("player_id"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("player_country"))
    sides = lines.join(home, "player_id")
    other = sides.select(F.col("match_id").alias("other_match"), F.col("side_no").alias("other_side"), F.col("player_country").alias("opponent_country"))
    rows = sides.join(other, (F.col("match_id") == F.col("other_match")) & (F.col("side_no") != F.col("other_side")), "left").drop("other_match", "other_side")
    code = F.when(F.col("o_orderkey") % 4 == 0, "WS").when(F.col("o_orderkey") % 4 == 1, "XD").when(F.col("o_orderkey") % 4 == 2, "MS").otherwise("WT")
    matches = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("match_id"), (F.col("o_custkey") % 50).alias("event_id"), F.lit("Main Draw").alias("stage"), F.when(F.col("o_orderkey") % 3 == 0, "Final").otherwise("R16").alias("round"),
        F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").alias("winner_side"), code.alias("sub_event_type_code"), (F.col("o_custkey") % 12 + 1).alias("sort_order"),
        F.when(F.col("o_orderpriority") == "5-LOW", "WTT_YOUTH").otherwise("WTT_MAIN").alias("category_id"), F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string")).alias("champion_country_code"), F.lit(None).cast("string").alias("champion_player_ids"),
    )
    return rows.join(matches, "match_id")


@add("""
    WITH s AS (SELECT l_orderkey AS m, (l_linenumber - 1) % 2 + 1 AS side, l_suppkey AS p, 'N' || s_nationkey AS c FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    g AS (SELECT s.m, s.p, min(s.side) AS side, min(s.c) AS c, list(DISTINCT t.c) FILTER (t.c IS NOT NULL) AS others FROM s LEFT JOIN s t ON s.m = t.m AND s.side <> t.side GROUP BY 1, 2),
    r AS (SELECT p, c, side, coalesce(others, []) AS others, o_custkey % 50 AS e, o_custkey % 12 + 1 AS sort, o_orderkey % 3 = 0 AS final, (o_orderstatus = 'F' AND side = 1) OR (o_orderstatus = 'O' AND side = 2) AS won,
      ['WS', 'XD', 'MS', 'WT'][o_orderkey % 4 + 1] AS code, 'N' || (o_custkey % 25) AS champ FROM g JOIN orders ON o_orderkey = m WHERE o_orderpriority <> '5-LOW'),
    f AS (SELECT *, e || ':' || code AS key, len(list_filter(others, lambda x: x <> c)) = 0 AS same, sort <= 9 AS seven, sort <= 5 AS three, CASE WHEN code = 'WT' THEN c = champ ELSE final AND won END AS title FROM r)
    SELECT p AS player_id, count(*) FILTER (len(others) > 0 AND NOT same)::BIGINT AS foreign_matches, count(*) FILTER (len(others) > 0 AND NOT same AND won)::BIGINT AS foreign_wins,
      count(*) FILTER (len(others) > 0 AND same)::BIGINT AS domestic_matches, count(*) FILTER (len(others) > 0 AND same AND won)::BIGINT AS domestic_wins, count(DISTINCT e)::BIGINT AS events_total,
      count(DISTINCT key) FILTER (seven)::BIGINT AS seven_events, count(DISTINCT key) FILTER (seven AND (final OR title))::BIGINT AS seven_finals, count(DISTINCT key) FILTER (seven AND title)::BIGINT AS all_seven_titles,
      count(DISTINCT key) FILTER (three AND title)::BIGINT AS all_three_titles, count(DISTINCT key) FILTER (seven AND title AND code IN ('WS', 'XD'))::BIGINT AS event_seven_titles,
      count(DISTINCT key) FILTER (three AND title AND code IN ('WS', 'XD'))::BIGINT AS event_three_titles, count(DISTINCT key) FILTER (seven AND title AND code = 'WS')::BIGINT AS single_seven_titles,
      count(DISTINCT key) FILTER (three AND title AND code = 'WS')::BIGINT AS single_three_titles FROM f GROUP BY 1""")
def player_aggregate_stats(spark, sf_dir):
    """Statistics of every player: domestic and foreign results, events, finals and titles by tier."""
    out = stats.player_stats(_stat_rows(spark, sf_dir))
    return out.drop("foreign_win_rate", "domestic_win_rate", "seven_titles", "three_titles")


@add("""
    WITH t AS (SELECT (o_custkey % 40)::BIGINT AS event_id, ['Final', 'SemiFinal', 'Bronze', 'R16'][o_orderkey % 4 + 1] AS r, 'T' || (o_orderkey % 30) AS a, 'T' || (o_custkey % 30) AS b,
      CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END AS w FROM orders),
    d AS (SELECT event_id, r, CASE w WHEN 'A' THEN a ELSE b END AS won, CASE w WHEN 'A' THEN b ELSE a END AS lost FROM t WHERE w IS NOT NULL),
    p AS (SELECT event_id, 1 AS place, won AS team_code FROM d WHERE r = 'Final' UNION ALL SELECT event_id, 2, lost FROM d WHERE r = 'Final'
      UNION ALL SELECT event_id, 3, won FROM d WHERE r = 'Bronze' UNION ALL SELECT event_id, 4, lost FROM d WHERE r = 'Bronze'
      UNION ALL SELECT event_id, 3, lost FROM d WHERE r = 'SemiFinal' AND event_id NOT IN (SELECT event_id FROM d WHERE r = 'Bronze')
        AND (event_id, lost) NOT IN (SELECT event_id, a FROM t WHERE r = 'Final' UNION ALL SELECT event_id, b FROM t WHERE r = 'Final'))
    SELECT event_id, team_code, min(place)::INTEGER AS place FROM p GROUP BY 1, 2""")
def podium_places(spark, sf_dir):
    """Podium of each event from its final, bronze tie and semifinals (the historical view)."""
    code = lambda c: F.concat(F.lit("T"), c.cast("string"))
    ties = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 40).alias("event_id"), F.element_at(F.array(*map(F.lit, ("Final", "SemiFinal", "Bronze", "R16"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("draw_round"),
        code(F.col("o_orderkey") % 30).alias("team_a"), code(F.col("o_custkey") % 30).alias("team_b"), F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").alias("winner_side"),
    )
    return stats.podium(ties, ["event_id"])


@add("SELECT count(*)::BIGINT AS total, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS wins, min(year(o_orderdate))::INTEGER AS first_year, max(year(o_orderdate))::INTEGER AS last_year, count(*) FILTER (o_orderstatus = 'F')::DOUBLE / count(*)::DOUBLE * 100.0 AS rate FROM orders")
def verification_counts(spark, sf_dir):
    """Totals, range of years and rate of a whole table in one row."""
    out = read(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"), F.min(F.year("o_orderdate")).alias("first_year"), F.max(F.year("o_orderdate")).alias("last_year"))
    return out.withColumn("rate", guarded_ratio(F.col("wins"), F.col("total")))
