"""Registered queries: import jobs, checks of feeds and matching rules over whole tables (see ``joins`` for what they stand for)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.operators import merge as M
from rallyspark.operators import quality as Q
from rallyspark.operators import relational as R
from rallyspark.operators import schedule, stats
from rallyspark.plans.common import Registry, read
from rallyspark.plans.texts import _pick, _sql

registry = Registry()
add = registry.add


def _halves(spark, sf_dir):
    """Orders as a present table (all keys but multiples of 5) and what comes in (multiples of 3), with a status and a source."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = lambda n: _pick(["completed", "live", "scheduled", "walkover", "cancelled"], n)
    old = o.where(k % 5 != 0).select(k.alias("k"), status(k).alias("status"), F.when(k % 2 == 0, "official").otherwise("live").alias("source"), F.col("o_custkey").alias("v"))
    new = o.where(k % 3 == 0).select(k.alias("k"), status(F.floor(k / 3)).alias("status"), F.when(k % 4 == 0, "official").otherwise("live").alias("source"), F.when(k % 9 > 0, F.col("o_custkey") + 1).alias("v"))
    return old, new


_STATES = ["completed", "live", "scheduled", "walkover", "cancelled"]
_HALVES = f"""
    o AS (SELECT o_orderkey AS k, {_sql(_STATES, 'o_orderkey')} AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'official' ELSE 'live' END AS source, o_custkey AS v FROM orders WHERE o_orderkey % 5 <> 0),
    n AS (SELECT o_orderkey AS k, {_sql(_STATES, 'o_orderkey // 3')} AS status, CASE WHEN o_orderkey % 4 = 0 THEN 'official' ELSE 'live' END AS source, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey + 1 END AS v FROM orders WHERE o_orderkey % 3 = 0)"""


@add(f"""
    WITH {_HALVES}, j AS (SELECT coalesce(o.k, n.k) AS k, o.k IS NOT NULL AS has_o, n.k IS NOT NULL AND (o.k IS NULL OR NOT (o.status IN ('completed', 'walkover') AND o.source = 'official') OR n.source = 'official') AS take,
      o.status AS os, n.status AS ns, o.source AS oc, n.source AS nc, o.v AS ov, n.v AS nv FROM o FULL JOIN n ON o.k = n.k)
    SELECT k, CASE WHEN has_o AND NOT take THEN os WHEN NOT has_o THEN ns
        WHEN map {{'completed': 40, 'walkover': 40, 'live': 30, 'scheduled': 20, 'cancelled': 10}}[ns] >= map {{'completed': 40, 'walkover': 40, 'live': 30, 'scheduled': 20, 'cancelled': 10}}[os] THEN ns ELSE os END AS status,
      CASE WHEN take THEN nc ELSE oc END AS source, CASE WHEN take THEN coalesce(nv, ov) ELSE ov END AS v FROM j""")
def guarded_upsert(spark, sf_dir):
    """Late data: finished official rows change by official rows only, a status never falls, empty values do not overwrite."""
    old, new = _halves(spark, sf_dir)
    return M.upsert(old, new, "k", rules=M.monotone_status() | {"v": F.coalesce("n.v", "o.v")}, when=M.not_final())


@add(f"""
    WITH {_HALVES}, c AS (SELECT o.k, o.status IS DISTINCT FROM n.status AS s, o.source IS DISTINCT FROM n.source AS c, o.v IS DISTINCT FROM n.v AS v FROM o JOIN n USING (k))
    SELECT count(*)::BIGINT AS checked, count(*) FILTER (s OR c OR v)::BIGINT AS changed, count(*) FILTER (s)::BIGINT AS status, count(*) FILTER (c)::BIGINT AS source, count(*) FILTER (v)::BIGINT AS v FROM c""")
def change_counts(spark, sf_dir):
    """How many rows of an import differ from the present ones, by column."""
    old, new = _halves(spark, sf_dir)
    return M.changes(old, new, "k", ["status", "source", "v"])


@add(f"WITH {_HALVES} SELECT n.k, n.status, n.source, n.v FROM o JOIN n USING (k) WHERE (o.status, o.source) <> (n.status, n.source)")
def changed_rows(spark, sf_dir):
    """The rows of an import that a detail job has to visit."""
    old, new = _halves(spark, sf_dir)
    return M.only_changed(old, new, "k", ["status", "source"])


@add("""
    SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey % 3 <> 0 UNION ALL
    SELECT l_orderkey, l_linenumber, l_suppkey + 1 FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber <= 3 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3)
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0 AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 3)""")
def replaced_scope(spark, sf_dir):
    """Orders of an import replace all lines that the present table has of them."""
    old = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    new = old.where("l_orderkey % 3 = 0 and l_linenumber <= 3").withColumn("l_suppkey", F.col("l_suppkey") + 1)
    return M.replace_scope(old, new, "l_orderkey")


@add("""
    WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')
    SELECT 'owned' AS kind, l_orderkey AS parent, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)
    UNION ALL SELECT 'free', CASE WHEN l_orderkey IN (SELECT o_orderkey FROM p) THEN l_orderkey END, l_linenumber FROM lineitem""")
def cascade_and_detach(spark, sf_dir):
    """Children of removed parents: one kind goes, the other stays without its key."""
    lines = R.dealt(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), "l_linenumber"), "parent")
    parents = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'")
    (kept,) = M.cascade(parents, "o_orderkey", (lines, "parent"))
    return kept.select(F.lit("owned").alias("kind"), "*").union(M.detach(lines, parents, "parent", "o_orderkey").select(F.lit("free").alias("kind"), "*"))


@add("""
    SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def newest_wrapper_rows(spark, sf_dir):
    """The row of each key from its newest wrapper, the later one at equal times."""
    return M.newest_wrapper(read(spark, sf_dir, "events"), ["user_id", "event_type"], F.date_trunc("day", "ts"), "event_id").select("user_id", "event_id", "value")


@add("""
    WITH a AS (SELECT p_partkey AS code, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, p_brand AS venue, 'a' AS source FROM part WHERE p_partkey % 4 > 0),
    b AS (SELECT p_partkey AS code, p_type AS name, 'hall' AS venue, 'b' AS source FROM part WHERE p_partkey % 2 = 0)
    SELECT code, coalesce(a.name, b.name) AS name, coalesce(a.venue, b.venue) AS venue, concat_ws(',', a.source, b.source) AS sources FROM a FULL JOIN b USING (code)""")
def two_feeds_filled(spark, sf_dir):
    """Match cards of two feeds by code: the first one's fields, empty ones from the second."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    a = p.where(k % 4 > 0).select(k.alias("code"), F.when(k % 3 > 0, F.col("p_name")).alias("name"), F.col("p_brand").alias("venue"), F.lit("a").alias("source"))
    b = p.where(k % 2 == 0).select(k.alias("code"), F.col("p_type").alias("name"), F.lit("hall").alias("venue"), F.lit("b").alias("source"))
    return M.fill_from(a, b, "code", ["name", "venue"]).withColumn("sources", F.array_join("sources", ","))


@add("""
    WITH r AS (SELECT o_orderkey AS id, o_orderkey % 3 > 0 AS is_real, o_custkey AS c, o_orderpriority AS p, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS s FROM orders),
    f AS (SELECT c, p, max(s) AS fs FROM r WHERE NOT is_real GROUP BY 1, 2)
    SELECT id, coalesce(s, fs) AS s FROM r LEFT JOIN f USING (c, p) WHERE is_real UNION ALL SELECT id, s FROM r WHERE NOT is_real AND (c, p) NOT IN (SELECT c, p FROM r WHERE is_real)""")
def provisional_rows(spark, sf_dir):
    """Provisional rows fill the gaps of the real row they belong to; those without one stay."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(k.alias("id"), (k % 3 > 0).alias("is_real"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.when(k % 2 == 0, F.col("o_orderstatus")).alias("s"))
    return M.reconcile_provisional(rows, "id", F.col("is_real"), ["c", "p"], ["s"]).select("id", "s")


@add("""
    WITH live AS (SELECT 7 AS event_id, 'M' || o_orderkey AS code, CASE o_orderkey % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'completed' WHEN 2 THEN 'walkover' ELSE 'live' END AS st, CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END AS w, o_orderkey AS k FROM orders),
    h AS (SELECT 7 AS event_id, 'M' || o_orderkey AS code, 'old' AS w FROM orders WHERE o_orderkey % 10 = 0)
    SELECT event_id, code AS external_code, w AS winner_side FROM h UNION ALL SELECT event_id, code, w FROM live WHERE st = 'completed' AND w IN ('A', 'B') AND k % 10 <> 0""")
def promoted_matches(spark, sf_dir):
    """Finished live matches of an event become historical rows; known codes are ignored, walkovers and open ones stay behind."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    code, side = F.concat(F.lit("M"), k.cast("string")), F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B")
    live = o.select(F.lit(7).alias("event_id"), code.alias("external_code"), _pick(["completed", "completed", "walkover", "live"], k).alias("status"), side.alias("winner_side"), F.lit("a").alias("side_a_key"), F.lit("b").alias("side_b_key"))
    history = o.where(k % 10 == 0).select(F.lit(7).alias("event_id"), code.alias("external_code"), F.lit("old").alias("winner_side"))
    return M.promote(history, live, 7)


@add("SELECT code, coalesce(name, code) AS name FROM (SELECT DISTINCT p_brand AS code FROM part) LEFT JOIN (SELECT 'Brand#' || n_nationkey AS code, n_name AS name FROM nation WHERE n_nationkey < 10) USING (code) UNION SELECT 'Brand#' || n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def registered_codes(spark, sf_dir):
    """Unknown codes join the dictionary under their own name."""
    dim = read(spark, sf_dir, "nation").where("n_nationkey < 10").select(F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"))
    return M.register_codes(dim, read(spark, sf_dir, "part").select(F.col("p_brand").alias("code")), "code", "name")


@add("""
    WITH b AS (SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'name' END, CASE WHEN p_partkey % 11 = 0 THEN 'brand' END], lambda x: x IS NOT NULL)) AS reason FROM part),
    r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY p_partkey) AS i FROM b)
    SELECT reason, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FILTER (i <= 20) AS examples FROM r GROUP BY 1""")
def required_fields(spark, sf_dir):
    """Rows without a required field, by reason, with the least twenty keys of each."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    rows = p.select(k, F.when(k % 7 > 0, F.col("p_name")).alias("name"), F.when(k % 11 == 0, F.lit("  ")).otherwise(F.col("p_brand")).alias("brand"))
    return Q.rejects(Q.required(rows, "name", "brand"), "p_partkey").withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@add("""
    WITH c AS (SELECT c_mktsegment || '/' || c_custkey // 1000 AS category, c_custkey AS seq, CASE WHEN c_custkey % 50 = 0 THEN 1 ELSE c_custkey END AS rank, c_custkey // (CASE WHEN c_custkey % 30 < 2 THEN 2 ELSE 1 END) AS player_id, c_custkey FROM customer),
    f AS (SELECT *, coalesce(rank >= lag(rank) OVER (PARTITION BY category ORDER BY seq), true) AS o, count(*) OVER (PARTITION BY category, player_id) = 1 AS u, strpos('/p/' || c_custkey, player_id::VARCHAR) > 0 AS l FROM c)
    SELECT category, seq, concat_ws(',', CASE WHEN NOT o THEN 'order' END, CASE WHEN NOT u THEN 'unique' END, CASE WHEN NOT l THEN 'url' END) AS reasons FROM f WHERE NOT (o AND u AND l)""")
def ranking_row_checks(spark, sf_dir):
    """Rows of ranking lists out of order, with an id twice or a link to another id."""
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(F.concat_ws("/", "c_mktsegment", F.floor(k / 1000).cast("string")).alias("category"), k.alias("seq"), F.when(k % 50 == 0, 1).otherwise(k).alias("rank"), F.floor(k / F.when(k % 30 < 2, 2).otherwise(1)).alias("player_id"), F.concat(F.lit("/p/"), k.cast("string")).alias("profile_url"))
    return Q.ranking_rows(rows).where(F.size("reasons") > 0).select("category", "seq", F.array_join("reasons", ",").alias("reasons"))


@add("""
    WITH e AS (SELECT event_type AS c, count(*) AS n FROM events GROUP BY 1), t AS (SELECT c, n::BIGINT AS rows, CASE c WHEN 'click' THEN n ELSE n + n // 40 + 6 END AS expected FROM e)
    SELECT t.c AS event_type, rows, expected::BIGINT AS expected, expected <= rows AS whole, expected - rows <= greatest(5.0, expected * 0.02) AS usable FROM t""")
def snapshot_complete(spark, sf_dir):
    """Whether each list has the total that its source names, or is usable within the tolerance."""
    e = read(spark, sf_dir, "events")
    n = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("expected", F.when(F.col("event_type") == "click", F.col("n")).otherwise(F.col("n") + F.floor(F.col("n") / 40) + 6))
    return Q.complete(e.join(n, "event_type"), "event_type", "expected")


@add("""
    WITH r AS (SELECT o_custkey AS c, o_orderkey // 50 AS page, o_orderkey AS rank FROM orders), p AS (SELECT page, count(*) AS n, min(rank) AS lo, max(rank) AS hi FROM r GROUP BY 1)
    SELECT p.page, page % 3 > 0 AND page % 5 > 0 AS proved, shared::BIGINT AS shared, agree::BIGINT AS agree FROM p
    JOIN (SELECT page, count(*) AS shared, count(*) FILTER (rank % 4 > 0) AS agree FROM r WHERE rank % 2 = 0 GROUP BY 1) o USING (page)""")
def page_checks(spark, sf_dir):
    """Pages against their checkpoints, and how far an overlapping fetch agrees with them."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), F.floor(k / 50).alias("page"), k.alias("rank"))
    marks = rows.groupBy("page").agg(F.count(F.lit(1)).alias("row_count"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))
    marks = marks.withColumns({"parsed_count": F.col("row_count") + F.when(F.col("page") % 3 == 0, 1).otherwise(0), "last_rank": F.col("last_rank") + F.when(F.col("page") % 5 == 0, 1).otherwise(0)})
    again = rows.where("rank % 2 = 0").withColumn("player_id", F.when(F.col("rank") % 4 > 0, F.col("player_id")).otherwise(-1))
    return Q.page_proof(rows, marks, ["page"]).join(Q.page_overlap(rows, again, ["page", "rank"]), "page")


@add("""
    SELECT o_custkey, min(o_orderkey % 40) = 0 AND max(o_orderkey % 40) + 1 = count(DISTINCT o_orderkey % 40) AS sound, sum(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END)::BIGINT AS first_rows FROM orders GROUP BY 1""")
def prefix_checks(spark, sf_dir):
    """Whether the ranks of each list are a gapless prefix."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 40 + 1).alias("rank"))
    return Q.prefix_sound(rows, "o_custkey").join(rows.groupBy("o_custkey").agg(F.count_if(F.col("rank") == 1).alias("first_rows")), "o_custkey")


@add("""
    SELECT event_type AS step, sum(event_id % 3)::BIGINT AS inserted, sum(CASE WHEN event_id % 1000 = 7 THEN 1 ELSE 0 END)::BIGINT AS skipped, 0::BIGINT AS errors, sum(CASE WHEN event_id % 1000 = 7 THEN 1 ELSE 0 END) > 0 AS manual_check FROM events GROUP BY 1""")
def run_totals(spark, sf_dir):
    """Totals of per-file summaries by step, and whether one needs a look."""
    k = F.col("event_id")
    return Q.run_summary(read(spark, sf_dir, "events").select(F.col("event_type").alias("step"), (k % 3).alias("inserted"), F.when(k % 1000 == 7, 1).otherwise(0).alias("skipped"), F.lit(0).alias("errors")))


@add("SELECT DISTINCT user_id, (event_id // 25 * 25)::BIGINT AS \"offset\" FROM events WHERE event_type = 'error'")
def pages_to_fetch(spark, sf_dir):
    """Offsets of the pages that hold rows to be fetched again."""
    return Q.missing_pages(read(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "event_id", 25)


@add("""
    WITH r AS (SELECT p_partkey, p_name AS event, 1990 + p_size AS year, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN upper(p_name) || ',' WHEN 2 THEN p_type ELSE p_name END AS raw_event, CASE WHEN p_partkey % 6 = 0 THEN NULL WHEN p_partkey % 10 = 3 THEN 1 ELSE 1990 + p_size END AS raw_year FROM part)
    SELECT p_partkey, raw_event FROM r WHERE raw_event IS NOT NULL AND (replace(lower(raw_event), ',', '') <> lower(event) OR coalesce(raw_year <> year, false)) AND raw_event <> 'ECONOMY'""")
def raw_identity_mismatches(spark, sf_dir):
    """Rows whose raw text names another event or year than their file, unless the pair is allowed."""
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    name = F.when(k % 4 == 0, "").when(k % 4 == 1, F.concat(F.upper("p_name"), F.lit(","))).when(k % 4 == 2, F.col("p_type")).otherwise(F.col("p_name"))
    year = F.when(k % 6 == 0, "-").when(k % 10 == 3, "1").otherwise((F.col("p_size") + 1990).cast("string"))
    rows = p.select(k, F.col("p_name").alias("event"), (F.col("p_size") + 1990).alias("year"), F.concat(year, F.lit(" | "), name, F.lit(" | x")).alias("raw"))
    allowed = p.select(F.col("p_name").alias("event"), F.lit("ECONOMY").alias("raw_event")).distinct()
    return Q.identity_mismatch(rows, "raw", "event", "year", allowed).select("p_partkey", "raw_event")


PLACES = ["Rome, Italy", "Arena of NEW YORK City", "Doha", "somewhere", "Rome and New-York", "Newyork", ""]
COUNTRIES = ["QA", "US", None, "XX", "IT"]


@add(f"""
    WITH c AS (SELECT c_custkey, {_sql(PLACES, 'c_custkey')} AS place, {_sql(COUNTRIES, 'c_custkey // 7')} AS cc FROM customer),
    t AS (SELECT * FROM (VALUES ('New York', 'America/New_York'), ('Rome', 'Europe/Rome'), ('York', 'Europe/London')) AS v(city, zone)),
    h AS (SELECT c_custkey, max_by(zone, length(city)) AS city_zone FROM c JOIN t ON contains(' ' || regexp_replace(lower(place), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || lower(city) || ' ') GROUP BY 1)
    SELECT c_custkey, coalesce(city_zone, CASE cc WHEN 'QA' THEN 'Asia/Qatar' END) AS time_zone, CASE WHEN city_zone IS NOT NULL THEN 'city' WHEN cc = 'QA' THEN 'country' WHEN cc = 'US' THEN 'multi-zone country' ELSE 'unknown place' END AS reason FROM c LEFT JOIN h USING (c_custkey)""")
def zones_of_places(spark, sf_dir):
    """Zones by the longest city named in a place, else by the country's only zone."""
    k = F.col("c_custkey")
    events = read(spark, sf_dir, "customer").select(k.alias("event_id"), _pick(PLACES, k).alias("location"), _pick(COUNTRIES, F.floor(k / 7)).alias("country_code"))
    cities = spark.createDataFrame([("New York", "America/New_York"), ("Rome", "Europe/Rome"), ("York", "Europe/London")], "city string, time_zone string")
    countries = spark.createDataFrame([("QA", "Asia/Qatar"), ("US", "America/New_York"), ("US", "America/Chicago")], "country_code string, time_zone string")
    return schedule.infer_zone(events, cities, countries).select(F.col("event_id").alias("c_custkey"), "time_zone", "reason")


@add("""
    WITH m AS (SELECT n_regionkey AS t, CASE WHEN n_nationkey % 3 > 0 THEN 'k' || n_nationkey % 2 END AS kd, n_name AS cat, n_nationkey % 4 AS pr, n_nationkey AS id FROM nation WHERE n_nationkey % 5 > 0),
    b AS (SELECT t, kd, min_by(cat, (-pr, id)) AS cat FROM m GROUP BY 1, 2)
    SELECT c_custkey, cat AS category_id FROM customer LEFT JOIN b ON t = c_custkey % 6 AND kd IS NOT DISTINCT FROM CASE WHEN c_custkey % 4 > 0 THEN 'k' || c_custkey % 2 END""")
def event_categories(spark, sf_dir):
    """Category of each event by type and kind: highest priority, then least id; kinds that are missing match each other."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    mapping = read(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("event_type"), F.when(n % 3 > 0, F.concat(F.lit("k"), (n % 2).cast("string"))).alias("event_kind"), F.col("n_name").alias("category_id"), (n % 4).alias("priority"), n.alias("id"), F.when(n % 5 > 0, 1).otherwise(0).alias("is_active"))
    events = read(spark, sf_dir, "customer").select(k, (k % 6).alias("event_type"), F.when(k % 4 > 0, F.concat(F.lit("k"), (k % 2).cast("string"))).alias("event_kind"))
    return schedule.category_of(events, mapping).select("c_custkey", "category_id")


@add("""
    WITH a AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS p, o_orderdate AS d FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_orderkey AS row_id, o_custkey AS c, o_orderpriority AS p, o_orderdate AS d FROM orders WHERE o_orderstatus = 'F'),
    h AS (SELECT k, 1 AS step, row_id FROM a JOIN r USING (c, p) UNION ALL SELECT k, 2, row_id FROM a JOIN r USING (c) UNION ALL SELECT k, 3, row_id FROM a JOIN r USING (d, p)), b AS (SELECT k, min((step, row_id)) AS hit FROM h GROUP BY 1)
    SELECT a.k, hit[2] AS row_id, hit[1]::INTEGER AS step FROM a LEFT JOIN b USING (k)""")
def three_pass_matches(spark, sf_dir):
    """Rows matched by the first of three keys that finds any."""
    o = read(spark, sf_dir, "orders")
    side = lambda status, name: o.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias(name), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_orderdate").alias("d"))
    return schedule.match_passes(side("O", "k"), side("F", "row_id"), [["c", "p"], ["c"], ["d", "p"]], "k", "row_id").select("k", "row_id", "step")


@add("""
    WITH g AS (SELECT 'G' || (s_suppkey % 10) AS g, s_suppkey AS t FROM supplier), a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey % 25 END AS x, o_orderkey % 25 AS y FROM orders)
    SELECT k, gx.g AS group_code, CASE WHEN x IS NULL THEN 'side without one country' WHEN gx.g IS NULL THEN 'no common group' END AS issue
    FROM a LEFT JOIN (SELECT p.t AS tx, q.t AS ty, p.g FROM g p JOIN g q ON p.g = q.g AND p.t <> q.t) gx ON tx = x AND ty = y""")
def groups_of_ties(spark, sf_dir):
    """Group of each tie by the table that holds both teams, else why there is none."""
    groups = read(spark, sf_dir, "supplier").select(F.lit("s").alias("stage"), F.concat(F.lit("G"), (F.col("s_suppkey") % 10).cast("string")).alias("group_code"), F.col("s_suppkey").alias("team_code"))
    k = F.col("o_orderkey")
    ties = read(spark, sf_dir, "orders").select(k.alias("k"), F.when(k % 9 > 0, F.col("o_custkey") % 25).alias("team_a"), (k % 25).alias("team_b"))
    return schedule.groups_by_pair(ties, groups).select("k", "group_code", "issue")


@add("""
    WITH e AS (SELECT event_id, ['Main Draw', ' Groups ', 'x', NULL][event_id % 4 + 1] AS s, ['F', ' SF', 'Group 1', NULL][event_id // 4 % 4 + 1] AS r FROM events),
    c AS (SELECT *, coalesce(map {'Main Draw': 'MAIN_DRAW', 'Groups': 'PRELIMINARY'}[trim(s)], 'UNKNOWN') AS stage_code FROM e)
    SELECT event_id, stage_code, CASE WHEN stage_code = 'PRELIMINARY' AND trim(r) = 'F' THEN 'R1' ELSE coalesce(map {'F': 'FINAL', 'SF': 'SEMI'}[trim(r)], 'UNKNOWN') END AS round_code FROM c""")
def stage_and_round_codes(spark, sf_dir):
    """Codes of stages and rounds by alias: a stage's own aliases before those of all."""
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(k, _pick(["Main Draw", " Groups ", "x", None], k).alias("stage"), _pick(["F", " SF", "Group 1", None], F.floor(k / 4)).alias("round"))
    table = lambda data, names: spark.createDataFrame(data, ", ".join(f"{n} string" for n in names.split()))
    out = schedule.stage_round_codes(rows, table([("Main Draw", "MAIN_DRAW"), ("Groups", "PRELIMINARY")], "alias code"), table([("F", "FINAL"), ("SF", "SEMI")], "alias code"), table([("PRELIMINARY", "F", "R1")], "stage_code alias code"))
    return out.select("event_id", "stage_code", "round_code")


@add("""
    WITH m AS (SELECT o_orderkey % 2 + 1 AS a, 2 - o_orderkey % 2 AS b, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS w FROM orders), s AS (SELECT count(*) AS t, count(*) FILTER (w = a) AS x, count(*) FILTER (w = b) AS y FROM m)
    SELECT t::BIGINT AS total, x::BIGINT AS wins_a, y::BIGINT AS wins_b, (t - x - y)::BIGINT AS undecided, x::DOUBLE / t::DOUBLE * 100.0 AS rate_a, y::DOUBLE / t::DOUBLE * 100.0 AS rate_b FROM s""")
def head_to_head_totals(spark, sf_dir):
    """Wins of both sides of all meetings, undecided ones and rates."""
    k = F.col("o_orderkey")
    meetings = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B").alias("winner_side"), (k % 2 + 1).alias("side_a"), (2 - k % 2).alias("side_b"))
    return stats.head_to_head_summary(meetings)
