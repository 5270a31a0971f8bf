"""Registered queries: ties split by a change of country, staged and knockout views, overrides and groups (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.operators import champions, schedule, views
from rallyspark.plans.common import Registry, read

registry = Registry()
add = registry.add


def _text(head: str, n):
    return F.concat(F.lit(head), n.cast("string"))


@add("""
    WITH h AS (SELECT 'pl' || n_nationkey % 7 AS name, 'T' || n_nationkey % 4 AS cc, max('T' || (n_nationkey + 1) % 4) AS old FROM nation WHERE n_nationkey % 3 = 1 GROUP BY ALL),
    o AS (SELECT o_orderkey AS id, 'S' || o_orderkey % 2 AS stage, 'R' || o_orderkey % 3 AS rnd, 'G' || o_custkey % 300 AS grp, o_orderkey % 4 || '-' || o_custkey % 4 AS score, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END END AS won,
      o_orderkey % 2 = 0 AS turned, 'T' || o_orderkey % 4 AS t, 'Pl' || o_orderkey % 7 AS pl, 'T' || (o_custkey % 3 + 4) AS u FROM orders),
    m AS (SELECT *, old IS NOT NULL AND old <> t AS changed, CASE WHEN old IS NOT NULL AND old <> t THEN old ELSE t END AS team FROM o LEFT JOIN h ON h.name = lower(pl) AND h.cc = t),
    s AS (SELECT id, stage, rnd, grp, score, won, changed, CASE WHEN turned THEN u ELSE team END AS a, CASE WHEN turned THEN team ELSE u END AS b, split_part(score, '-', 1)::INTEGER AS x, split_part(score, '-', 2)::INTEGER AS y FROM m),
    g AS (SELECT *, least(a, b) || greatest(a, b) AS pair, CASE WHEN a < b THEN x ELSE y END AS lo, CASE WHEN a < b THEN y ELSE x END AS hi FROM s),
    c AS (SELECT stage, rnd, grp, pair, count(*) AS n, bool_or(changed) AS any_, min_by({'id': id, 'a': a, 'b': b, 'score': score, 'won': won}, id) AS base, sum(lo)::INTEGER AS lo, sum(hi)::INTEGER AS hi FROM g GROUP BY ALL),
    j AS (SELECT *, CASE WHEN base.a < base.b THEN lo ELSE hi END AS p, CASE WHEN base.a < base.b THEN hi ELSE lo END AS q FROM c WHERE n > 1 AND any_)
    SELECT base.id AS tie_id, base.a AS team_a, base.b AS team_b, CASE WHEN p > 0 OR q > 0 THEN p || '-' || q ELSE base.score END AS match_score, CASE WHEN p > q THEN 'A' WHEN q > p THEN 'B' ELSE base.won END AS winner_side, n::BIGINT AS merged FROM j
    UNION ALL SELECT id, a, b, score, won, 1 FROM g JOIN c USING (stage, rnd, grp, pair) WHERE NOT (n > 1 AND any_)""")
def country_changes(spark, sf_dir):
    """Ties that a player's change of country has split, as one again: scores summed by team, the winner by the sums."""
    k, c, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n_nationkey")
    own, other = _text("T", k % 4), _text("T", c % 3 + 4)
    side = lambda no, team, name: F.struct(F.lit(no).alias("side_no"), team.alias("team_code"), F.array(F.struct(name.alias("name"), team.alias("country"))).alias("players"))
    pl, opponent = _text("Pl", k % 7), _text("Op", c % 5)
    sides = F.when(k % 2 == 0, F.array(side(1, other, opponent), side(2, own, pl))).otherwise(F.array(side(1, own, pl), side(2, other, opponent)))
    ties = read(spark, sf_dir, "orders").select(
        k.alias("tie_id"), F.lit("MT").alias("sub_event_type_code"), _text("S", k % 2).alias("stage_code"), _text("R", k % 3).alias("round_code"), _text("G", c % 300).alias("group_code"), F.lit(None).cast("string").alias("scheduled_local_at"),
        F.concat((k % 4).cast("string"), F.lit("-"), (c % 4).cast("string")).alias("match_score"), F.when(k % 5 > 0, F.when(k % 2 == 0, "A").otherwise("B")).alias("winner_side"), sides.alias("sides"),
    )
    history = read(spark, sf_dir, "nation").where(n % 3 == 1).select(_text("PL", n % 7).alias("player_name"), _text("T", n % 4).alias("current_country"), _text("T", (n + 1) % 4).alias("historical_country"))
    return champions.merge_country_changes(ties, history).select("tie_id", "team_a", "team_b", "match_score", "winner_side", F.col("merged").cast("long").alias("merged"))


def _ties(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, sf_dir, "orders").select(
        k.alias("tie_id"), (c % 25).alias("event_id"), _text("Stage ", k % 3).alias("stage"), _text("G", k % 4).alias("round"), _text("T", k % 5).alias("team_a"), _text("T", c % 6).alias("team_b"),
        F.concat((k % 4).cast("string"), F.lit("-2")).alias("match_score"), F.when(k % 7 > 0, F.when(k % 2 == 0, "A").otherwise("B")).alias("winner_side"),
    )


_TIES = """t AS (SELECT o_orderkey AS tie_id, o_custkey % 25 AS event_id, 'Stage ' || o_orderkey % 3 AS stage, 'G' || o_orderkey % 4 AS round, 'T' || o_orderkey % 5 AS team_a, 'T' || o_custkey % 6 AS team_b,
      o_orderkey % 4 || '-2' AS match_score, CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END END AS winner_side FROM orders)"""


@add(f"""
    WITH {_TIES}, s AS (SELECT n_nationkey AS event_id, p AS position, 'Stage ' || p AS stage, CASE WHEN p = 2 THEN 'knockout' ELSE 'groups' END AS format, CASE WHEN p < 2 THEN 'G' || g END AS group_code FROM nation, range(0, 4) x(p), range(0, 5) y(g) WHERE p < 2 OR g = 0)
    SELECT s.event_id, position::INTEGER AS position, s.stage, format, group_code, coalesce(string_agg(tie_id || ':' || team_a || ':' || team_b || ':' || match_score || ':' || coalesce(winner_side, ''), ',' ORDER BY tie_id), '') AS ties
    FROM s LEFT JOIN t ON t.event_id = s.event_id AND t.stage = s.stage AND (group_code IS NULL OR group_code = t.round) GROUP BY ALL""")
def staged_ties(spark, sf_dir):
    """Ties of every event by the stages and groups of its override, stages and groups without ties too."""
    nation, places = read(spark, sf_dir, "nation"), F.explode(F.sequence(F.lit(0), F.lit(3)))
    rows = nation.select(F.col("n_nationkey").alias("event_id"), places.alias("position")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("position < 2 or g = 0")
    stages = rows.select("event_id", "position", _text("Stage ", F.col("position")).alias("stage"), F.when(F.col("position") == 2, "knockout").otherwise("groups").alias("format"), F.when(F.col("position") < 2, _text("G", F.col("g"))).alias("group_code"), F.lit(None).cast("string").alias("group_name"))
    shown = F.array_join(F.transform("ties", lambda t: F.concat_ws(":", t["tie_id"].cast("string"), t["team_a"], t["team_b"], t["match_score"], F.coalesce(t["winner_side"], F.lit("")))), ",")
    return views.staged_view(_ties(spark, sf_dir), stages).select("event_id", "position", "stage", "format", "group_code", shown.alias("ties"))


@add(f"""
    WITH {_TIES}, o AS (SELECT o_custkey % 25 AS event_id, o_orderkey AS tie_id, CASE WHEN o_orderkey % 2 = 0 THEN 'F' END AS code, CASE WHEN o_orderkey % 4 = 0 THEN 'Final' END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 90 END AS ord FROM orders WHERE o_orderpriority = '1-URGENT'),
    r AS (SELECT t.event_id, t.tie_id, coalesce(o.code, t.round) AS code, coalesce(o.label, 'Round ' || t.round) AS label, coalesce(o.ord, (t.tie_id % 4 * 10))::INTEGER AS round_order FROM t LEFT JOIN o USING (event_id, tie_id))
    SELECT event_id, code, label, round_order, string_agg(tie_id::VARCHAR, ',' ORDER BY tie_id) AS ties FROM r GROUP BY ALL""")
def knockout_lists(spark, sf_dir):
    """Ties of every event by round; an override's code, label and order go before a tie's own, each where it is given."""
    k = F.col("o_orderkey")
    ties = _ties(spark, sf_dir).withColumns({"code": F.col("round"), "label": F.concat(F.lit("Round "), F.col("round")), "round_order": (F.col("tie_id") % 4 * 10).cast("int")})
    override = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 25).alias("event_id"), k.alias("tie_id"), F.when(k % 2 == 0, "F").alias("code"), F.when(k % 4 == 0, "Final").alias("label"), F.when(k % 2 == 0, 90).alias("round_order"))
    lists = views.knockout_rounds(ties, override)
    return lists.select("event_id", "code", "label", "round_order", F.array_join(F.transform("ties", lambda t: t["tie_id"].cast("string")), ",").alias("ties"))


@add(f"""
    WITH {_TIES}, w AS (SELECT n_nationkey AS event_id, 'role ' || r AS role, 'T' || r AS one, 'T' || (r + n_nationkey) % 9 AS two FROM nation, range(0, 5) x(r))
    SELECT w.event_id, role, min(tie_id) AS tie_id FROM w LEFT JOIN t ON t.event_id = w.event_id AND ((team_a = one AND team_b = two) OR (team_a = two AND team_b = one)) GROUP BY ALL""")
def override_pairs(spark, sf_dir):
    """The first tie between the two teams that an override names for each role, in either order."""
    n = F.col("n_nationkey")
    wanted = read(spark, sf_dir, "nation").select(n, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r")).select(n.alias("event_id"), _text("role ", F.col("r")).alias("role"), _text("T", F.col("r")).alias("first_code"), _text("T", (F.col("r") + n) % 9).alias("second_code"))
    return views.override_ties(_ties(spark, sf_dir), wanted)


@add(f"""
    WITH {_TIES}, g AS (SELECT 'Stage ' || n_nationkey % 2 AS stage, 'GP' || n_nationkey % 3 AS group_code, 'T' || n_nationkey % 8 AS team FROM nation WHERE n_nationkey < 8),
    u AS (SELECT tie_id, CASE WHEN tie_id % 13 > 0 THEN team_a END AS team_a, team_b FROM t)
    SELECT tie_id, x.stage, x.group_code, CASE WHEN team_a IS NULL THEN 'side without one country' WHEN x.group_code IS NULL THEN 'no common group' END AS issue
    FROM u LEFT JOIN (SELECT a.stage, a.group_code, a.team AS ta, b.team AS tb FROM g a JOIN g b ON a.stage = b.stage AND a.group_code = b.group_code AND a.team <> b.team) x ON ta = team_a AND tb = team_b""")
def tie_groups(spark, sf_dir):
    """Stage and group of ties by the groups that hold both teams."""
    n = F.col("n_nationkey")
    groups = read(spark, sf_dir, "nation").where(n < 8).select(_text("Stage ", n % 2).alias("stage"), _text("GP", n % 3).alias("group_code"), _text("T", n % 8).alias("team_code"))
    ties = _ties(spark, sf_dir).select("tie_id", F.when(F.col("tie_id") % 13 > 0, F.col("team_a")).alias("team_a"), "team_b")
    return schedule.groups_by_pair(ties, groups).select("tie_id", "stage", "group_code", "issue")
