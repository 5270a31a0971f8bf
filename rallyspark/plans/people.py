"""Registered queries: identities of players by names, countries, rosters, ranks and evidence (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.operators import identity
from rallyspark.plans.common import Registry, read

registry = Registry()
add = registry.add

_KEY = "array_to_string(list_sort(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> '')), ' ')"
#: Players, countries played for before, questions and evidence in SQL. Several players of a country bear one name.
_PEOPLE = f"""
    p AS (SELECT c_custkey AS player_id, 'First' || c_custkey % 40 || ' LAST' || c_custkey % 25 AS name, 'N' || c_nationkey AS cc FROM customer),
    h AS (SELECT name AS old_name, {_KEY.format('name')} AS k, cc, 'N' || (substr(cc, 2)::INTEGER + 1) % 25 AS old FROM p WHERE player_id % 11 = 0),
    own AS (SELECT player_id, cc, unnest(list_distinct([name, {_KEY.format('name')}])) AS key FROM p),
    idx AS (SELECT key, cc, player_id FROM own
      UNION SELECT unnest(list_distinct([old_name, h.k])), h.old, player_id FROM p JOIN h ON h.k = {_KEY.format('p.name')} AND h.cc = p.cc),
    a AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'LAST' || o_custkey % 25 || '  First' || o_custkey % 40 WHEN o_orderkey % 3 = 1 THEN ' First' || o_custkey % 40 || ' LAST' || o_custkey % 25 ELSE lower('First' || o_custkey % 40 || ' LAST' || o_custkey % 25) END AS name,
      'n' || (c_nationkey + (o_orderkey % 7 = 0)::INTEGER) % 25 AS country, 'c' || o_orderkey % 6 AS context FROM orders JOIN customer ON c_custkey = o_custkey),
    hits AS (SELECT id, min(player_id) AS lo, max(player_id) AS hi FROM (SELECT id, upper(country) AS cc, unnest(list_distinct([trim(name), {_KEY.format('name')}])) AS key FROM a) q JOIN idx USING (key, cc) GROUP BY 1)"""


def _players(spark, sf_dir):
    c = F.col("c_custkey")
    name = F.concat(F.lit("First"), (c % 40).cast("string"), F.lit(" LAST"), (c % 25).cast("string"))
    return read(spark, sf_dir, "customer").select(c.alias("player_id"), name.alias("name"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("country_code"))


def _history(players):
    """Every eleventh player played for the next country before."""
    old = F.concat(F.lit("N"), ((F.substring("country_code", 2, 9).cast("int") + 1) % 25).cast("string"))
    return players.where(F.col("player_id") % 11 == 0).select(F.col("name").alias("player_name"), F.col("country_code").alias("current_country"), old.alias("historical_country"))


def _asks(spark, sf_dir):
    """Names as feeds write them: words in the other order, more spaces, lower case; some with the country before."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    first, last = F.concat(F.lit("First"), (c % 40).cast("string")), F.concat(F.lit("LAST"), (c % 25).cast("string"))
    name = F.when(k % 3 == 0, F.concat(last, F.lit("  "), first)).when(k % 3 == 1, F.concat(F.lit(" "), first, F.lit(" "), last)).otherwise(F.lower(F.concat(first, F.lit(" "), last)))
    home = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = read(spark, sf_dir, "orders").join(home, "o_custkey")
    country = F.concat(F.lit("n"), ((F.col("c_nationkey") + (k % 7 == 0).cast("int")) % 25).cast("string"))
    return rows.select(k.alias("id"), name.alias("name"), country.alias("country"), F.concat(F.lit("c"), (k % 6).cast("string")).alias("context"))


@add(f"WITH {_PEOPLE} SELECT id, CASE WHEN lo = hi THEN lo END AS player_id, CASE WHEN lo IS NULL THEN 'unmatched' WHEN lo = hi THEN 'matched' ELSE 'ambiguous' END AS status FROM a LEFT JOIN hits USING (id)")
def resolve_variants(spark, sf_dir):
    """Ids by name in any spelling and by the country now or before: one candidate, several or none."""
    players = _players(spark, sf_dir)
    return identity.resolve_players(_asks(spark, sf_dir), identity.player_index(players, _history(players))).select("id", "player_id", "status")


@add(f"""
    WITH {_PEOPLE},
    g0 AS (SELECT {_KEY.format('name')} AS k, cc, list(DISTINCT player_id) AS ids FROM p GROUP BY ALL HAVING count(DISTINCT player_id) > 1),
    g AS (SELECT k, cc, list_distinct(flatten(list(ids))) AS ids FROM (SELECT * FROM g0 UNION ALL SELECT g0.k, h.old, ids FROM g0 JOIN (SELECT DISTINCT k, cc, old FROM h) h USING (k, cc)) GROUP BY ALL),
    proof AS (SELECT DISTINCT o_custkey AS player_id, 'c' || o_orderkey % 6 AS context FROM orders WHERE o_orderstatus = 'F'),
    told AS (SELECT id, min(player_id) AS own, count(*) AS n FROM (SELECT id, context, unnest(ids) AS player_id FROM a JOIN g ON g.k = {_KEY.format('a.name')} AND g.cc = upper(a.country)) x JOIN proof USING (player_id, context) GROUP BY 1),
    f AS (SELECT a.id, ids IS NOT NULL AS grouped, lo, hi, own, coalesce(n, 0) AS n FROM a LEFT JOIN hits USING (id) LEFT JOIN told USING (id) LEFT JOIN g ON g.k = {_KEY.format('a.name')} AND g.cc = upper(a.country))
    SELECT id, CASE WHEN grouped THEN CASE WHEN n = 1 THEN own END WHEN lo = hi THEN lo END AS player_id,
      CASE WHEN grouped THEN CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'same_name_ambiguous' ELSE 'same_name_unresolved' END WHEN lo IS NULL THEN 'unmatched' WHEN lo = hi THEN 'matched' ELSE 'ambiguous' END AS status FROM f""")
def resolve_by_evidence(spark, sf_dir):
    """Ids where several players bear a name: settled by the matches of one candidate only."""
    players = _players(spark, sf_dir)
    history = _history(players)
    proof = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("player_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 6).cast("string")).alias("context"))
    return identity.resolve_players(_asks(spark, sf_dir), identity.player_index(players, history), identity.same_name_groups(players, history), proof).select("id", "player_id", "status")


@add("""
    WITH p AS (SELECT c_custkey AS player_id, 'First' || c_custkey % 40 || ' LAST' || c_custkey % 25 AS name, 'N' || c_nationkey AS country FROM customer), one AS (SELECT name, country, min(player_id) AS p FROM p GROUP BY ALL HAVING count(DISTINCT player_id) = 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey ELSE p END AS player_id FROM (SELECT *, 'First' || (o_custkey + o_orderkey % 2) % 40 || ' LAST' || o_custkey % 25 AS name, 'N' || o_custkey % 25 AS country FROM orders) LEFT JOIN one USING (name, country)""")
def backfilled_ids(spark, sf_dir):
    """Missing ids by exact name and country where one player has them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = F.concat(F.lit("First"), ((c + k % 2) % 40).cast("string"), F.lit(" LAST"), (c % 25).cast("string"))
    asks = read(spark, sf_dir, "orders").select(k.alias("id"), name.alias("name"), F.concat(F.lit("N"), (c % 25).cast("string")).alias("country"), F.when(k % 4 == 0, c).alias("player_id"))
    return identity.backfill_exact(asks, _players(spark, sf_dir)).select("id", "player_id")


@add("""
    WITH r AS (SELECT l_suppkey AS event_id, 'T' || l_linenumber % 3 AS team, upper(trim(CASE WHEN l_partkey % 5 > 0 THEN ' name' || l_partkey % 30 || CASE WHEN l_partkey % 2 = 0 THEN ' ' ELSE '' END ELSE ' ' END)) AS n, l_partkey AS player_id, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS seq FROM lineitem),
    k AS (SELECT event_id, team, n, max_by(player_id, seq) AS p FROM r WHERE n <> '' GROUP BY ALL)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN -1 ELSE p END AS player_id FROM orders LEFT JOIN k ON event_id = o_custkey % 100 AND team = 'T' || o_orderkey % 3 AND n = 'NAME' || o_orderkey % 30""")
def roster_ids(spark, sf_dir):
    """Ids by event, team and name from the rosters of one event; the last row of a name counts."""
    part, k = F.col("l_partkey"), F.col("o_orderkey")
    name = F.when(part % 5 > 0, F.concat(F.lit(" name"), (part % 30).cast("string"), F.when(part % 2 == 0, " ").otherwise(""))).otherwise(" ")
    team = lambda c: F.concat(F.lit("T"), (c % 3).cast("string"))
    roster = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("event_id"), team(F.col("l_linenumber")).alias("team_code"), name.alias("name"), part.alias("player_id"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + part).alias("seq"))
    asks = read(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_custkey") % 100).alias("event_id"), team(k).alias("team_code"), F.concat(F.lit("Name"), (k % 30).cast("string")).alias("name"), F.when(k % 9 == 0, F.lit(-1).cast("long")).alias("player_id"))
    return identity.roster_lookup(asks, roster).select("id", "player_id")


@add("""
    WITH p AS (SELECT c_custkey AS player_id, 'N' || c_nationkey AS cc, c_custkey % 30 AS profile_rank, unnest(CASE WHEN c_custkey % 6 = 0 THEN ['first' || c_custkey % 40 || ' last', 'first' || c_custkey % 40 || ' last (1999)'] ELSE ['first' || c_custkey % 40 || ' last'] END) AS v FROM customer),
    a AS (SELECT o_orderkey AS id, 'N' || o_custkey % 25 AS cc, o_custkey % 30 AS rank, unnest(CASE WHEN o_orderkey % 5 = 0 THEN ['first' || o_custkey % 40 || ' last', 'first' || o_custkey % 40 || ' last (1999)'] ELSE ['first' || o_custkey % 40 || ' last'] END) AS v FROM orders),
    h AS (SELECT id, min(player_id) AS player_id FROM a JOIN p ON p.v = a.v AND p.cc = a.cc AND profile_rank = rank GROUP BY 1 HAVING count(DISTINCT player_id) = 1)
    SELECT o_orderkey AS id, player_id FROM orders LEFT JOIN h ON id = o_orderkey""")
def ranks_verified(spark, sf_dir):
    """Candidates by name variant and country that count only with the weekly rank in their profile, and alone."""
    c, k = F.col("c_custkey"), F.col("o_orderkey")
    named = lambda n, years: F.concat(F.lit("First"), (n % 40).cast("string"), F.lit(" LAST"), F.when(years, " (1999)").otherwise(""))
    code = lambda n: F.concat(F.lit("N"), n.cast("string"))
    profiles = read(spark, sf_dir, "customer").select(c.alias("player_id"), named(c, c % 6 == 0).alias("name"), code(F.col("c_nationkey")).alias("country_code"), (c % 30).alias("profile_rank"))
    asks = read(spark, sf_dir, "orders").select(k.alias("id"), named(F.col("o_custkey"), k % 5 == 0).alias("name"), F.lower(code(F.col("o_custkey") % 25)).alias("country_code"), (F.col("o_custkey") % 30).alias("rank"))
    return identity.verified_by_rank(asks, profiles).select("id", "player_id")
