"""Registered queries: order and byes of knockout rounds, groups of finals, date rollover and lanes (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.calendar import CALENDAR_RULES, classified
from rallyspark.operators import bracket, schedule
from rallyspark.plans.common import Registry, read

registry = Registry()
add = registry.add

#: Order keys of a knockout draw, and the first place of each of its rounds.
KNOCKOUT_IDS, STARTS = 64, (0, 32, 48, 56, 60, 62)


def _knockout(spark, sf_dir):
    """Orders as team ties: a draw is a block of 64 keys with six rounds of 32, 16, 8, 4, 2 and 2 ties."""
    k = F.col("o_orderkey")
    at = k % KNOCKOUT_IDS
    team = lambda c: F.concat(F.lit("T"), c.cast("string"))
    a, b = F.when(k % 17 == 0, None).otherwise(team(k % 9)), team(F.col("o_custkey") % 8)
    return read(spark, sf_dir, "orders").select(
        F.floor(k / KNOCKOUT_IDS).cast("string").alias("draw"), sum((F.when(at >= s, 1).otherwise(0) for s in STARTS), F.lit(0)).alias("level"), k.alias("seq"), F.concat(F.lit("tie"), k.cast("string")).alias("tie_id"),
        a.alias("team_a"), b.alias("team_b"), F.when(F.col("o_orderstatus") == "F", a).when(F.col("o_orderstatus") == "O", b).alias("winner"),
    )


def _order_sql(rounds: int = len(STARTS)) -> str:
    """Rounds from the last one down: a round's ties by the ask of the round behind that took them, then as they were."""
    level = " + ".join(f"(o_orderkey % {KNOCKOUT_IDS} >= {s})::INTEGER" for s in STARTS)
    out = [f"""o AS (SELECT (o_orderkey // {KNOCKOUT_IDS})::VARCHAR AS draw, {level} AS level, o_orderkey AS seq, CASE WHEN o_orderkey % 17 > 0 THEN 'T' || o_orderkey % 9 END AS a, 'T' || o_custkey % 8 AS b, o_orderstatus AS s FROM orders),
    r AS (SELECT *, CASE s WHEN 'F' THEN a WHEN 'O' THEN b END AS w, dense_rank() OVER (PARTITION BY draw ORDER BY level DESC) - 1 AS d FROM o),
    seen AS (SELECT draw, level, unnest([a, b]) AS team FROM r),
    t AS (SELECT r.*, (SELECT count(*) FROM seen WHERE seen.draw = r.draw AND seen.level < r.level AND seen.team = a) + (SELECT count(*) FROM seen WHERE seen.draw = r.draw AND seen.level < r.level AND seen.team = b) AS weight FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY draw, d, w ORDER BY weight DESC, seq) AS k FROM t), q0 AS (SELECT NULL::VARCHAR AS draw, NULL::VARCHAR AS team, NULL::BIGINT AS k, NULL::BIGINT AS ask WHERE false)"""]
    for d in range(rounds):
        out.append(f"o{d} AS (SELECT k.*, row_number() OVER (PARTITION BY k.draw ORDER BY ask NULLS LAST, seq) AS place FROM k LEFT JOIN q{d} q ON q.draw = k.draw AND q.team = k.w AND q.k = k.k WHERE d = {d})")
        out.append(f"q{d + 1} AS (SELECT draw, team, row_number() OVER (PARTITION BY draw, team ORDER BY ask) AS k, ask FROM (SELECT draw, a AS team, 2 * place AS ask FROM o{d} UNION ALL SELECT draw, b, 2 * place + 1 FROM o{d}) WHERE team IS NOT NULL)")
    return ", ".join(out) + " " + " UNION ALL ".join(f"SELECT draw, 'tie' || seq AS tie_id, place::INTEGER AS display_order FROM o{d}" for d in range(rounds))


@add(f"WITH {_order_sql()}")
def knockout_order(spark, sf_dir):
    """Every knockout round in the order of the ties that it feeds."""
    return bracket.display_order(_knockout(spark, sf_dir)).select("draw", "tie_id", "display_order")


#: A draw of byes: 14 ties of at most 16, 8 behind them, 2 behind those.
BYE_IDS, BYE_STARTS = 24, (0, 14, 22)


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, o_orderkey // {BYE_IDS} AS draw, o_orderkey % {BYE_IDS} AS pos, CASE WHEN o_orderkey % {BYE_IDS} >= 22 THEN 3 WHEN o_orderkey % {BYE_IDS} >= 14 THEN 2 ELSE 1 END AS level FROM orders WHERE o_orderkey % 7 > 0 OR o_orderkey // {BYE_IDS} % 2 = 0),
    s AS (SELECT k AS match_id, draw, level, side, 'U' || k AS unit, CASE WHEN draw % 3 = 0 AND k % 5 = 0 THEN 0 ELSE 1 END AS players,
      'U' || (draw * {BYE_IDS} + CASE level WHEN 2 THEN (pos - 14) * 2 + side - 1 WHEN 3 THEN 14 + (pos - 22) * 2 + side - 1 END) AS previous FROM o, range(1, 3) x(side)),
    n AS (SELECT draw, level, count(DISTINCT match_id) AS n FROM s GROUP BY ALL),
    f AS (SELECT s.*, n.n, EXISTS (SELECT 1 FROM s p WHERE p.draw = s.draw AND p.level = s.level - 1 AND p.unit = s.previous) AS fed, p.n AS before FROM s JOIN n USING (draw, level) JOIN n p ON p.draw = s.draw AND p.level = s.level - 1),
    g AS (SELECT *, count(*) FILTER (fed OR players > 0) OVER (PARTITION BY draw, level) = 2 * n AS full_ FROM f WHERE before < 2 * n)
    SELECT draw, (level - 1)::INTEGER AS level, -(match_id * 10 + side) AS match_id, 'virtual-bye:' || draw || ':' || (level - 1) || ':' || match_id || ':' || side AS unit_code, match_id AS next_match_id, side::INTEGER AS next_side_no FROM g WHERE full_ AND NOT fed""")
def virtual_byes(spark, sf_dir):
    """Byes for the sides of a round without a tie before them, where all slots of the round are then filled."""
    k = F.col("o_orderkey")
    at, draw = k % BYE_IDS, F.floor(k / BYE_IDS)
    level = sum((F.when(at >= s, 1).otherwise(0) for s in BYE_STARTS), F.lit(0))
    rows = read(spark, sf_dir, "orders").where((k % 7 > 0) | (draw % 2 == 0)).withColumn("side_no", F.explode(F.array(F.lit(1), F.lit(2))))
    feeder = F.when(level == 2, (at - 14) * 2 + F.col("side_no") - 1).when(level == 3, 14 + (at - 22) * 2 + F.col("side_no") - 1)
    unit = lambda n: F.concat(F.lit("U"), n.cast("string"))
    sides = rows.select(
        draw.alias("draw"), level.alias("level"), k.alias("match_id"), "side_no", unit(draw * BYE_IDS + feeder).alias("previous_unit"), unit(k).alias("unit_code"), F.when((draw % 3 == 0) & (k % 5 == 0), 0).otherwise(1).alias("n_players"),
    )
    return bracket.virtual_byes(sides, ["draw"])


@add("""
    WITH RECURSIVE f AS (SELECT o_orderkey // 100 AS event_id, o_orderkey AS match_id, ['C' || o_orderkey % 11, 'C' || o_custkey % 13] AS c, row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) AS n FROM orders),
    s AS (SELECT event_id, match_id, n, c AS seen, 0 AS tie_group FROM f WHERE n = 1
      UNION ALL SELECT f.event_id, f.match_id, f.n, CASE WHEN list_has_any(seen, c) THEN list_concat(seen, c) ELSE c END, tie_group + (NOT list_has_any(seen, c))::INTEGER FROM s JOIN f ON f.event_id = s.event_id AND f.n = s.n + 1)
    SELECT match_id, tie_group FROM s""")
def final_groups(spark, sf_dir):
    """Finals of a discipline in runs that share no country with the run before."""
    k = F.col("o_orderkey")
    code = lambda c: F.concat(F.lit("C"), c.cast("string"))
    finals = read(spark, sf_dir, "orders").select(F.floor(k / 100).alias("event_id"), F.lit("MT").alias("sub_event_type_code"), k.alias("match_id"), F.array(code(k % 11), code(F.col("o_custkey") % 13)).alias("countries"))
    return bracket.disjoint_runs(finals).select("match_id", "tie_group")


@add("""
    WITH RECURSIVE d AS (SELECT o_custkey AS k, o_orderkey AS seq, make_date(2023 + o_custkey % 2, month(o_orderdate), least(day(o_orderdate), 28)) AS here, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
    s AS (SELECT k, seq, n, here AS local_date FROM d WHERE n = 1
      UNION ALL SELECT d.k, d.seq, d.n, CASE WHEN d.here < s.local_date THEN (d.here + INTERVAL 1 YEAR)::DATE ELSE d.here END FROM s JOIN d ON d.k = s.k AND d.n = s.n + 1)
    SELECT k AS event_id, seq, local_date FROM s""")
def rolled_dates(spark, sf_dir):
    """Dates of sessions without a year: one that lies before the last goes into the next year."""
    o = read(spark, sf_dir, "orders")
    days = o.select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 2 + 2023).alias("year"), F.month("o_orderdate").alias("month"), F.least(F.dayofmonth("o_orderdate"), F.lit(28)).alias("day"))
    return bracket.rolled_dates(days, "event_id", "seq", "year").select("event_id", "seq", "local_date")


@add("""
    WITH RECURSIVE p AS (SELECT o_custkey AS k, o_orderdate::DATE AS s, (o_orderdate::DATE + (o_orderkey % 200)::INTEGER) AS e, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderdate::DATE + (o_orderkey % 200)::INTEGER) AS n FROM orders),
    w AS (SELECT k, s, e, n, [e] AS busy, 0 AS lane FROM p WHERE n = 1
      UNION ALL SELECT k, s, e, n, CASE WHEN lane < len(busy) THEN list_transform(busy, lambda u, i: CASE WHEN i = lane + 1 THEN e ELSE u END) ELSE list_append(busy, e) END, lane
      FROM (SELECT p.k, p.s, p.e, p.n, w.busy, coalesce(list_position(list_transform(w.busy, lambda u: u < p.s), true) - 1, len(w.busy))::INTEGER AS lane FROM w JOIN p ON p.k = w.k AND p.n = w.n + 1))
    SELECT k AS week, s, e, lane FROM w""")
def calendar_lanes(spark, sf_dir):
    """Spans of a calendar in the first lane that is free."""
    s = F.to_date("o_orderdate")
    spans = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("week"), s.alias("s"), F.date_add(s, (F.col("o_orderkey") % 200).cast("int")).alias("e"))
    return bracket.lanes(spans, "week", "s", "e")


PREFIXES = ["WTT", "ITTF-Africa", "ITTF-Americas", "ITTF-ATTU", "ITTF Oceania", "ETTU", "European", "World", "Olympic", "Asian", "Solidarity", "ITTF World Table Tennis", "Europe U13"]
REGIONS = ["", "North American", "South American", "Central", "Mixed", "Youth", "Para"]
AGES = ["", "Youth", "Star", "U21", "Hopes", "Masters", "Para", "Team"]
KINDS = ["Champions", "Contender", "Feeder", "Cup", "Championships", "Top 16", "Grand Smash", "Team Championships Finals", "Games", "Singles Qualification", "Team World Cup", "Elite", "Open", "Finals", "Olympic Games", "Special Event Qualifier"]


def _contains(phrase: str) -> str:
    text = phrase.replace("'", "''")
    return f"regexp_matches(name, '{text[1:]}')" if text.startswith("~") else f"contains(name, '{text}')"


def _classes(field: int) -> str:
    """The table of rules as one CASE."""
    rules = " ".join("WHEN " + " AND ".join("(" + " OR ".join(map(_contains, group)) + ")" for group in groups) + f" THEN '{(kind, sub)[field]}'" for groups, kind, sub in CALENDAR_RULES)
    return f"CASE WHEN coalesce(name, '') = '' THEN NULL {rules} ELSE '{('Continental', 'Senior Championships')[field]}' END"


def _of(forms: list[str], n: str) -> str:
    return "[" + ", ".join(f"'{f}'" for f in forms) + f"][({n}) % {len(forms)} + 1]"


@add(f"""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 50 > 0 THEN concat_ws(' ', {_of(PREFIXES, 'o_custkey')}, nullif({_of(REGIONS, 'o_orderkey')}, ''), nullif({_of(AGES, 'o_orderkey // 7')}, ''), {_of(KINDS, 'o_orderkey // 3')}, year(o_orderdate)::VARCHAR) END AS name FROM orders)
    SELECT o_orderkey, name, {_classes(0)} AS event_type, {_classes(1)} AS event_kind FROM o""")
def calendar_classes(spark, sf_dir):
    """Type and kind of calendar events whose names are put together from families, regions, ages and kinds."""
    k = F.col("o_orderkey")
    pick = lambda forms, n: F.get(F.array(*map(F.lit, forms)), (n % len(forms)).cast("int"))
    name = F.concat_ws(" ", pick(PREFIXES, F.col("o_custkey")), F.nullif(pick(REGIONS, k), F.lit("")), F.nullif(pick(AGES, F.floor(k / 7)), F.lit("")), pick(KINDS, F.floor(k / 3)), F.year("o_orderdate").cast("string"))
    named = read(spark, sf_dir, "orders").select(k, F.when(k % 50 > 0, name).alias("name"))
    return named.withColumn("c", classified(F.col("name"))).select("o_orderkey", "name", "c.event_type", "c.event_kind")


STAGE_NAMES = ["Main Draw - Division 2", "Position Draw 第二级别", "Qualification", "正赛", "Groups", "main draw 第10级别"]
ROUND_CODES = ["Final", "SF", "8", "R32", "odd", "QFNL", "Bronze", "R256"]


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS event_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m') END AS at_, {_of(STAGE_NAMES, 'o_orderkey')} AS st, {_of(ROUND_CODES, 'o_orderkey // 2')} AS rc,
      CASE WHEN o_orderkey % 4 > 0 THEN 'GP0' || o_orderkey % 2 END AS grp, CASE WHEN o_orderkey % 5 > 1 THEN 'T0' || o_orderkey % 2 END AS tbl, CASE WHEN o_orderkey % 2 = 0 THEN 'cm:' || o_orderkey ELSE o_orderkey::VARCHAR END AS id FROM orders),
    p AS (SELECT *, 100 * CASE WHEN lower(st) LIKE '%main draw%' OR st LIKE '%正赛%' THEN 0 WHEN lower(st) LIKE '%position%' THEN 1 WHEN st LIKE '%Qualification%' THEN 2 ELSE 3 END
        + CASE WHEN st LIKE '%Division 2%' OR st LIKE '%第二级别%' THEN 2 WHEN st LIKE '%第10级别%' THEN 10 ELSE 99 END AS stage,
      CASE rc WHEN 'Final' THEN 80 WHEN 'SF' THEN 60 WHEN '8' THEN 50 WHEN 'QFNL' THEN 50 WHEN 'R32' THEN 30 WHEN 'Bronze' THEN 70 ELSE 0 END AS ord FROM o),
    b AS (SELECT x.k, count(*) FILTER (y.k IS NOT NULL AND y.k <> x.k AND CASE
          WHEN coalesce(x.at_, '') = '' AND coalesce(y.at_, '') = '' AND y.stage <> x.stage THEN y.stage < x.stage WHEN coalesce(x.at_, '') = '' AND coalesce(y.at_, '') = '' AND y.ord <> x.ord THEN y.ord > x.ord
          WHEN coalesce(y.at_, '') <> coalesce(x.at_, '') THEN coalesce(y.at_, '') < coalesce(x.at_, '') WHEN y.stage <> x.stage THEN y.stage < x.stage WHEN y.ord <> x.ord THEN y.ord > x.ord
          WHEN coalesce(y.grp, '') <> coalesce(x.grp, '') THEN coalesce(y.grp, '') < coalesce(x.grp, '') WHEN coalesce(y.tbl, '') <> coalesce(x.tbl, '') THEN coalesce(y.tbl, '') < coalesce(x.tbl, '') ELSE y.k < x.k END) AS before FROM p x JOIN p y USING (event_id) GROUP BY 1)
    SELECT event_id, id, (before + 1)::INTEGER AS place FROM b JOIN p USING (k)""")
def schedule_order(spark, sf_dir):
    """Places in schedule lists that mix rows with and without a time; the SQL compares row by row, as the rule is given."""
    k = F.col("o_orderkey")
    pick = lambda forms, n: F.get(F.array(*map(F.lit, forms)), (n % len(forms)).cast("int"))
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    matches = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("event_id"), F.when(k % 2 == 0, text("cm:", k)).otherwise(k.cast("string")).alias("schedule_match_id"), F.when(k % 3 == 0, None).when(k % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("scheduled_local_at"),
        F.lit("").alias("stage_code"), pick(STAGE_NAMES, k).alias("stage_name"), pick(ROUND_CODES, F.floor(k / 2)).alias("round_code"), F.lit(None).cast("string").alias("round_name"),
        F.when(k % 4 > 0, text("GP0", k % 2)).alias("group_code"), F.when(k % 5 > 1, text("T0", k % 2)).alias("table_no"), F.lit(None).cast("string").alias("session_label"),
    )
    return schedule.listed(matches, ["event_id"]).select("event_id", F.col("schedule_match_id").alias("id"), "place")
