"""Registered queries: lookups, joins, set operations and existence tests over the driver's tables.

The tables stand for sports tables: customer = player, orders = match, lineitem = side rows of a match, supplier = opponent,
nation and region = country and continent, part = tournament item, events = live feed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.scores import guarded_ratio
from rallyspark.functions.text import name_key, pair_key
from rallyspark.operators import relational as R
from rallyspark.plans.common import Registry, cents, read

registry = Registry()
add = registry.add


@add("""
    WITH last AS (SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1)
    SELECT last.o_custkey, c_name, last.o_orderkey, o_totalprice FROM last JOIN orders USING (o_orderkey)
    JOIN customer ON c_custkey = last.o_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def latest_snapshot_topk(spark, sf_dir):
    """Latest order of each customer, joined to the customer, the 50 dearest."""
    last = R.top_row(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_custkey", F.struct("o_orderdate", "o_orderkey"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return last.join(customers, "o_custkey").select("o_custkey", "c_name", "o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@add("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_row_per_key(spark, sf_dir):
    """Latest order of each customer by a limited window."""
    rows = R.first_rows(read(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey"))
    return rows.select("o_custkey", "o_orderkey", "o_orderstatus")


@add("""
    SELECT c_custkey, count(o_orderkey)::BIGINT AS total, count(o_orderkey) FILTER (o_orderstatus = 'F')::BIGINT AS wins,
      coalesce(count(o_orderkey) FILTER (o_orderstatus = 'F')::DOUBLE / nullif(count(o_orderkey)::DOUBLE, 0) * 100.0, 0.0) AS win_rate
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def guarded_win_rate(spark, sf_dir):
    """Wins, matches and rate of every customer; without matches the rate is 0."""
    stats = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("wins"))
    out = read(spark, sf_dir, "customer").select("c_custkey").join(stats, "c_custkey", "left").fillna(0)
    return out.withColumn("win_rate", guarded_ratio(F.col("wins"), F.col("total")))


@add("""
    SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') > 60 AS has_more
    FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def page_with_total(spark, sf_dir):
    """Third page of 20 finished orders with the total number and whether more follow."""
    rows = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return R.page(rows, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 40)


@add("""
    SELECT p_partkey, p_name, p_brand, CASE WHEN lower(p_type) = 'red' THEN 1 WHEN lower(p_name) = 'red' THEN 2 WHEN lower(p_brand) = 'red' THEN 3 WHEN starts_with(lower(p_type), 'red') THEN 4
      WHEN starts_with(lower(p_name), 'red') THEN 5 WHEN starts_with(lower(p_brand), 'red') THEN 6 WHEN p_size IS NOT NULL THEN 7 ELSE 8 END::INTEGER AS relevance
    FROM part WHERE contains(lower(p_name), 'red') ORDER BY relevance, coalesce(p_size, 999999), p_name, p_partkey LIMIT 20""")
def search_relevance(spark, sf_dir):
    """Best 20 hits of a search by tiers of relevance, then size and name."""
    hits = read(spark, sf_dir, "part").where(R.contains_any(["p_name"], ["red"]))
    ranked = hits.withColumn("relevance", R.search_rank("red", "p_name", "p_type", "p_brand", "p_size"))
    return ranked.orderBy("relevance", F.coalesce("p_size", F.lit(999999)), "p_name", "p_partkey").select("p_partkey", "p_name", "p_brand", "relevance").limit(R.clamp(None, 1, 20, 20))


@add("""
    SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') OR contains(lower(p_type), 'ring') OR contains(lower(p_type), 'gear'))
      AND NOT (contains(lower(p_type), 'economy') AND NOT contains(lower(p_type), 'brass'))""")
def keyword_expand_or(spark, sf_dir):
    """Parts that hold any of several terms in either column, without a negated compound."""
    economy, brass = R.contains_any(["p_type"], ["economy"]), R.contains_any(["p_type"], ["brass"])
    return read(spark, sf_dir, "part").where(R.contains_any(["p_name", "p_type"], ["Ring", "gear"]) & ~(economy & ~brass)).select("p_partkey", "p_name")


@add("""
    SELECT c_custkey, coalesce(nullif((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'), 0),
      nullif((SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O'), 0), c_nationkey, 0)::BIGINT AS total FROM customer""")
def list_first_nonzero_counts(spark, sf_dir):
    """The first child count that is not zero, else the stored number."""
    orders = read(spark, sf_dir, "orders")
    urgent, open_ = orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'"), orders.where("o_orderstatus = 'O'")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return R.first_nonzero(customers, "c_custkey", [(urgent, "o_custkey"), (open_, "o_custkey")], "c_nationkey").select("c_custkey", "total")


@add("""
    SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
      OR EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_acctbal < 0)""")
def exists_any_of(spark, sf_dir):
    """Customers with a row in any of several tables."""
    dear, debt = read(spark, sf_dir, "orders").where("o_totalprice > 450000"), read(spark, sf_dir, "supplier").where("s_acctbal < 0")
    return R.existing(read(spark, sf_dir, "customer"), "c_custkey", (dear, "o_custkey"), (debt, "s_suppkey")).select("c_custkey", "c_name")


@add("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')")
def anti_missing(spark, sf_dir):
    """Customers without an urgent finished order."""
    done = read(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select("o_custkey")
    return R.missing(read(spark, sf_dir, "customer"), done, {"c_custkey": "o_custkey"}).select("c_custkey", "c_nationkey")


@add("""
    SELECT a.l_suppkey AS supplier, b.l_suppkey AS opponent, count(*)::BIGINT AS meetings, count(*) FILTER (a.l_returnflag = 'A')::BIGINT AS wins, max(a.l_shipdate) AS latest
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber GROUP BY 1, 2""")
def opponent_pairs(spark, sf_dir):
    """Opponents of each supplier within orders: meetings, wins and latest date."""
    sides = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate")
    parts = R.parts_of(sides)
    pairs = R.opponents(sides.repartition(parts, "l_orderkey"), "l_orderkey", "l_linenumber", "l_suppkey")
    # pairs of suppliers grow with the lines, so they are dealt as the lines are, a few for each line
    return pairs.repartition(4 * parts, "l_suppkey", "opp_l_suppkey").groupBy(F.col("l_suppkey").alias("supplier"), F.col("opp_l_suppkey").alias("opponent")).agg(F.count(F.lit(1)).alias("meetings"), F.count_if(F.col("l_returnflag") == "A").alias("wins"), F.max("l_shipdate").alias("latest"))


@add("""
    SELECT a.l_orderkey, a.l_linenumber AS side_a, b.l_linenumber AS side_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber <> b.l_linenumber
    WHERE a.l_suppkey = 3 AND b.l_suppkey = 5""")
def head_to_head(spark, sf_dir):
    """Meetings of two suppliers; each one's rows are filtered before the join."""
    return R.head_to_head(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), "l_orderkey", "l_linenumber", "l_suppkey", 3, 5)


@add("""
    WITH pairs AS (SELECT DISTINCT least(a.l_suppkey, b.l_suppkey) AS lo, greatest(a.l_suppkey, b.l_suppkey) AS hi FROM lineitem a JOIN lineitem b
      ON a.l_orderkey = b.l_orderkey AND a.l_suppkey <> b.l_suppkey)
    SELECT c.c_custkey, n.n_nationkey AS other, count(*)::BIGINT AS n FROM customer c JOIN nation n ON c.c_nationkey <> n.n_nationkey
    JOIN pairs ON (lo = c.c_nationkey AND hi = n.n_nationkey) OR (lo = n.n_nationkey AND hi = c.c_nationkey) GROUP BY 1, 2""")
def symmetric_pair_join(spark, sf_dir):
    """Pairs matched in either order, by an equi-join on their least and greatest."""
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("other"))
    own = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("home"))
    homes = own.select("home").distinct().crossJoin(nations).where("home <> other")  # nations by nations
    # a supplier that is no home and no nation is in no pair that can match
    named = homes.select(F.explode(F.array("home", "other")).alias("l_suppkey")).distinct()
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    sides = lines.join(named, "l_suppkey", "left_semi").repartition(R.parts_of(lines), "l_orderkey").distinct()
    met = R.opponents(sides, "l_orderkey", "l_suppkey", "l_suppkey").select(F.least("l_suppkey", "opp_l_suppkey").alias("lo"), F.greatest("l_suppkey", "opp_l_suppkey").alias("hi")).distinct()
    matched = R.symmetric_join(homes, met, ("home", "other"), ("lo", "hi")).select("home", "other")
    # a customer gives a row for each nation at most, and is dealt so; the matched pairs are nations by nations and may be sent to all
    dealt = own.repartition(R.parts_of(own, nations.count()), "c_custkey")
    return dealt.join(F.broadcast(matched), "home").groupBy("c_custkey", F.col("other").cast("int").alias("other")).agg(F.count(F.lit(1)).alias("n"))


@add("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def concat_distinct(spark, sf_dir):
    """Distinct flags of each order, sorted and joined."""
    return R.joined_distinct(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "flags")


@add("""
    SELECT c_custkey, c_name, coalesce(s_suppkey, n_nationkey) AS resolved, CASE WHEN s_suppkey IS NOT NULL THEN 1 WHEN n_nationkey IS NOT NULL THEN 2 END::INTEGER AS resolved_step
    FROM customer LEFT JOIN (SELECT s_suppkey, s_suppkey AS k FROM supplier WHERE s_acctbal > 0) ON k = c_custkey
    LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS n_nationkey FROM supplier GROUP BY 1 HAVING min(s_suppkey) = max(s_suppkey)) ON s_nationkey = c_nationkey""")
def waterfall_resolve(spark, sf_dir):
    """Resolve by id, else by a nation that has exactly one supplier."""
    suppliers = read(spark, sf_dir, "supplier")
    steps = [(suppliers.where("s_acctbal > 0"), {"c_custkey": "s_suppkey"}, "s_suppkey"), (suppliers, {"c_nationkey": "s_nationkey"}, "s_suppkey")]
    return R.waterfall(read(spark, sf_dir, "customer"), steps).select("c_custkey", "c_name", "resolved", "resolved_step")


@add("""
    WITH keys AS (SELECT p_partkey, lower(p_name) || '|' || p_brand AS k FROM part UNION
      SELECT p_partkey, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') || '|' || p_brand FROM part)
    SELECT k, count(DISTINCT p_partkey)::BIGINT AS candidates, min(p_partkey) AS least FROM keys GROUP BY 1""")
def dual_key_index(spark, sf_dir):
    """Index by the raw name and by its sorted words, each with the brand: candidates of every key."""
    part = read(spark, sf_dir, "part")
    key = lambda c: F.concat(c, F.lit("|"), F.col("p_brand"))
    keys = part.select("p_partkey", F.explode(F.array_distinct(F.array(key(F.lower("p_name")), key(name_key(F.col("p_name")))))).alias("k"))
    return keys.groupBy("k").agg(F.count_distinct("p_partkey").alias("candidates"), F.min("p_partkey").alias("least"))


@add("SELECT p_brand, p_type, p_name, count(*)::BIGINT AS n, min(p_partkey) AS first_id FROM part GROUP BY ALL HAVING count(DISTINCT p_partkey) > 1")
def same_key_groups(spark, sf_dir):
    """Groups of one key with more than one id."""
    return read(spark, sf_dir, "part").groupBy("p_brand", "p_type", "p_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p_partkey").alias("ids"), F.min("p_partkey").alias("first_id")).where("ids > 1").drop("ids")


@add("""
    SELECT 'm:' || o_orderkey AS tag, o_orderkey AS id, o_totalprice AS amount, NULL::INTEGER AS line FROM orders
    UNION ALL SELECT 'r:' || l_orderkey, l_orderkey, l_extendedprice, l_linenumber FROM lineitem""")
def union_tagged_ids(spark, sf_dir):
    """Two sources under one tagged identity, missing columns as nulls."""
    orders = read(spark, sf_dir, "orders").select(R.tagged("m", F.col("o_orderkey")).alias("t"), F.col("o_totalprice").alias("amount"))
    lines = read(spark, sf_dir, "lineitem").select(R.tagged("r", F.col("l_orderkey")).alias("t"), F.col("l_extendedprice").alias("amount"), F.col("l_linenumber").alias("line"))
    return orders.unionByName(lines, allowMissingColumns=True).select(F.col("t.text").alias("tag"), F.col("t.id").alias("id"), "amount", "line")


@add("""
    WITH a AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE AS s, (o_orderdate + to_days(o_orderkey::INTEGER % 5))::DATE AS e FROM orders WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT o_orderkey AS other, o_custkey, o_orderdate::DATE AS s2, (o_orderdate + to_days(o_orderkey::INTEGER % 70))::DATE AS e2 FROM orders WHERE o_orderpriority = '5-LOW')
    SELECT o_custkey, o_orderkey, other FROM a JOIN b USING (o_custkey) WHERE s <= e2 AND e >= s2""")
def interval_overlap(spark, sf_dir):
    """Orders of one customer whose spans overlap, by buckets of 30 days."""
    orders = read(spark, sf_dir, "orders").withColumn("s", F.to_date("o_orderdate"))
    a = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", "s", F.date_add("s", (F.col("o_orderkey") % 5).cast("int")).alias("e"))
    b = orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("other"), "o_custkey", F.col("s").alias("s2"), F.date_add("s", (F.col("o_orderkey") % 70).cast("int")).alias("e2"))
    return R.overlapping(a, b, ("s", "e"), ("s2", "e2"), 30, ["o_custkey"]).select("o_custkey", "o_orderkey", "other")


@add("""
    SELECT p_partkey, p_size, coalesce(CASE WHEN NOT amb THEN CASE WHEN up IS NULL OR down <= up THEN bv ELSE av END END, NULL) AS nearest, least(down, up) AS distance, amb AS ambiguous FROM (
      SELECT *, coalesce(down = up AND bv <> av, false) AS amb FROM (
        SELECT p_partkey, p_size, p_retailprice - b.at AS down, a.at - p_retailprice AS up, b.v AS bv, a.v AS av FROM part
        ASOF LEFT JOIN (SELECT s_acctbal AS at, min(s_suppkey) AS v FROM supplier GROUP BY 1) b ON p_retailprice >= b.at
        ASOF LEFT JOIN (SELECT s_acctbal AS at, min(s_suppkey) AS v FROM supplier GROUP BY 1) a ON p_retailprice <= a.at))""")
def nearest_by_distance(spark, sf_dir):
    """The supplier whose balance is nearest to each part's price; one key for all, so ranges of the data deal the work out."""
    part = read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return R.nearest(part, read(spark, sf_dir, "supplier"), [], "p_retailprice", "s_acctbal", "s_suppkey").select("p_partkey", "p_size", "nearest", "distance", "ambiguous")


@add("""
    WITH marks AS (SELECT o_custkey AS user_id, o_orderdate AS at, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2)
    SELECT o.o_orderkey AS open_order, o.o_custkey, m.o_orderkey AS last_done FROM (SELECT * FROM orders WHERE o_orderstatus = 'O') o ASOF LEFT JOIN marks m ON o.o_custkey = m.user_id AND o.o_orderdate >= m.at""")
def as_of_join(spark, sf_dir):
    """For each open order the latest finished order of the customer at or before its date."""
    orders = read(spark, sf_dir, "orders")
    left = orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("open_order"), "o_custkey", "o_orderdate")
    right = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("last_done"))
    return R.as_of(left, right, ["o_custkey"], "o_orderdate", "at", ["last_done"]).select("open_order", "o_custkey", "last_done")


@add("""
    WITH c AS (SELECT c_nationkey AS k, count(*)::BIGINT AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*)::BIGINT AS suppliers FROM supplier GROUP BY 1)
    SELECT coalesce(c.k, s.k) AS nation, customers, suppliers FROM c FULL OUTER JOIN s ON c.k = s.k""")
def full_outer_join(spark, sf_dir):
    """Customers and suppliers by nation, nations of either side."""
    c = read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full")


@add("""
    SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000
    UNION (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def set_ops(spark, sf_dir):
    """Union, intersection and difference of key sets."""
    s, c = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_nationkey")
    return s.intersect(c).union(read(spark, sf_dir, "nation").select("n_nationkey").exceptAll(s.distinct())).distinct()


@add("""
    WITH t AS (SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n, array_to_string(list_sort(list(DISTINCT l_suppkey)), '/') AS who FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, array_to_string(list(l_linenumber || ':' || n || ':' || who ORDER BY l_linenumber), ';') AS sides FROM t GROUP BY 1""")
def nested_sides(spark, sf_dir):
    """Match, sides, players: two levels of nested lists, shown as text."""
    lines = read(spark, sf_dir, "lineitem")
    sides = lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("l_suppkey")).alias("players"))
    nested = R.nested(sides, ["l_orderkey"], ["l_linenumber"], ["l_linenumber", "n", "players"], "sides")
    show = F.transform("sides", lambda s: F.concat_ws(":", s["l_linenumber"].cast("string"), s["n"].cast("string"), F.array_join(F.transform(s["players"], lambda p: p.cast("string")), "/")))
    return nested.select("l_orderkey", F.array_join(show, ";").alias("sides"))


@add("""
    WITH names AS (SELECT DISTINCT p_name, array_to_string(list_sort(string_split(lower(p_name), ' ')), ' ') AS k FROM part)
    SELECT p_partkey, p.p_name, k, least(p_brand, p_type) || '|' || greatest(p_brand, p_type) AS pair FROM part p JOIN names ON names.p_name = p.p_name""")
def name_key_sorted(spark, sf_dir):
    """Word-order-free name key and pair key of every part."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_name", name_key(F.col("p_name")).alias("k"), pair_key(F.col("p_brand"), F.col("p_type")).alias("pair"))


@add("""
    SELECT r_name, n_name, count(DISTINCT c_custkey)::BIGINT AS customers, count(o_orderkey)::BIGINT AS matches, coalesce(sum(round(o_totalprice * 100)::BIGINT), 0)::BIGINT AS cents
    FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def left_join_chain(spark, sf_dir):
    """Continent, country, player and match through a chain of left joins; matches are summed by player first."""
    per = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("matches"), F.sum(cents("o_totalprice")).alias("cents"))
    players = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    by_nation = players.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.sum("matches").alias("matches"), F.sum("cents").alias("cents"))
    nations = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return nations.join(by_nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").fillna(0, ["customers", "matches", "cents"]).select("r_name", "n_name", "customers", "matches", "cents")
