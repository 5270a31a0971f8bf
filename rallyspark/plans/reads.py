"""Registered queries: filters, lookups, orders and counts of the read side over whole tables (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.payload import placeholder
from rallyspark.functions.text import athlete_name, competitor_name, text_value
from rallyspark.operators import bracket, filters, identity, quality, schedule, stats, views
from rallyspark.operators import relational as R
from rallyspark.operators.merge import only_changed
from rallyspark.plans.common import Registry, read

registry = Registry()
add = registry.add


def _text(head: str, n):
    return F.concat(F.lit(head), n.cast("string"))


def _pick(forms: list, n):
    return F.get(F.array(*map(F.lit, forms)), F.pmod(n, F.lit(len(forms))).cast("int"))


def _sql(forms: list, n: str) -> str:
    return "[" + ", ".join("NULL" if f is None else "'" + f.replace("'", "''") + "'" for f in forms) + f"][({n}) % {len(forms)} + 1]"


SERIES = ["CONTINENTAL CUP", "Continental", "WTT SERIES", None, "YOUTH WTT", "Cadet Tour", "U JUNIOR"]
NAMES = ["Asian Cup", "Men Open", "Men and Women Open", "women open", "European Games", "Africa Cup", None, "MEN ONLY"]
CODES = ["MTEAM0000", "MTEAM0001", None, "X0000 ", "0000"]
GAMES = ["[]", "11-5", "", None, " "]


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, p_size AS sort_order, {_sql(SERIES, 'o_orderkey')} AS cat, {_sql(NAMES, 'o_custkey')} AS name, {_sql(CODES, 'o_orderkey // 3')} AS code, {_sql(GAMES, 'o_orderkey // 2')} AS score, {_sql(GAMES, 'o_custkey')} AS games,
      CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey % 2 END AS flag, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate::DATE END AS start_, CASE WHEN o_orderkey % 5 > 0 THEN ['GP01', 'gp2', 'R16', 'G', 'xGP1'][o_orderkey % 5 + 1] END AS rc FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 4000)
    SELECT k AS o_orderkey, year(day) >= 1997 AND year(day) <> 2000 AS in_years, sort_order IS NOT NULL AND sort_order >= 1 AND sort_order <= 14 AS is_senior, coalesce(flag, 0) = 0 AS unflagged, coalesce(cat IN ('WTT SERIES', 'YOUTH WTT'), false) AS listed,
      NOT (lower(coalesce(name, '')) LIKE '%men open%' AND lower(coalesce(name, '')) NOT LIKE '%women%') AS not_only, coalesce(name = 'Asian Cup', false) AS asked, coalesce(start_ <= DATE '1999-01-01', true) AS begun,
      cat IS NULL OR upper(cat) NOT LIKE 'CONTINENTAL%' OR coalesce(name LIKE '%Asian%' OR name LIKE '%European%' OR name LIKE '%Pan American%', false) AS shown, coalesce(code LIKE '%0000', false) AS whole_unit,
      k % 3 > 0 AND (coalesce(trim(score), '') IN ('', '[]') OR coalesce(trim(games), '') IN ('', '[]')) AS incomplete, cat IS NULL OR NOT regexp_matches(upper(cat), 'YOUTH|JUNIOR|CADET') AS adult, rc IS NULL OR NOT regexp_matches(rc, '^[Gg][Pp][0-9]+') AS knockout FROM o""")
def list_filters(spark, sf_dir):
    """Every predicate of the lists, for every row."""
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = read(spark, sf_dir, "orders").withColumn("_p", k % 4000).join(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("_p"), "p_size"), "_p", "left")
    category, name = _pick(SERIES, k), _pick(NAMES, F.col("o_custkey"))
    round_code = F.when(k % 5 > 0, _pick(["GP01", "gp2", "R16", "G", "xGP1"], k))
    return rows.select(
        k, ((F.year(day) >= 1997) & (F.year(day) != 2000)).alias("in_years"), filters.senior(F.col("p_size")).alias("is_senior"), filters.unflagged(F.when(k % 6 > 0, k % 2)).alias("unflagged"), F.coalesce(category.isin("WTT SERIES", "YOUTH WTT"), F.lit(False)).alias("listed"),
        filters.not_only(name, "men open", "women").alias("not_only"), (filters.optional(name, "Asian Cup") & filters.optional(name, "")).alias("asked"), filters.begun(F.when(k % 4 > 0, day), F.lit("1999-01-01").cast("date")).alias("begun"), filters.shown_series(category, name).alias("shown"),
        filters.whole_unit(_pick(CODES, F.floor(k / 3))).alias("whole_unit"), filters.incomplete(F.when(k % 3 > 0, "completed"), _pick(GAMES, F.floor(k / 2)), _pick(GAMES, F.col("o_custkey"))).alias("incomplete"), stats.adult(category).alias("adult"), filters.knockout(round_code).alias("knockout"),
    )


@add("""
    WITH r AS (SELECT o_custkey AS c, ['T1', 'T2', 'T3'][o_orderkey % 3 + 1] AS tier, ['WS', 'JGS'][o_orderkey % 2 + 1] AS d, o_orderkey % 7 = 0 AS champ, o_orderkey AS k FROM orders)
    SELECT c_custkey, coalesce(bool_or(tier = 'T2' AND d = 'WS' AND champ), false) AS all_three, coalesce(bool_or(d = 'JGS'), false) AS junior, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (champ), '') AS first_, coalesce(string_agg(k::VARCHAR, ',' ORDER BY k) FILTER (NOT champ), '') AS rest
    FROM customer LEFT JOIN r ON c = c_custkey GROUP BY 1""")
def record_filters(spark, sf_dir):
    """Conditions that one nested record must meet together, and a stable split of records into two lists."""
    k = F.col("o_orderkey")
    record = F.struct(k.alias("k"), _pick(["T1", "T2", "T3"], k).alias("tier"), _pick(["WS", "JGS"], k).alias("discipline"), (k % 7 == 0).alias("is_champion"))
    listed = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list(record)).alias("r"))
    rows = read(spark, sf_dir, "customer").select("c_custkey").join(listed, "c_custkey", "left").withColumn("r", F.coalesce("r", F.array().cast(dict(listed.dtypes)["r"])))
    split = lambda keep: F.array_join(F.transform(F.filter("r", lambda x: x["is_champion"] == keep), lambda x: x["k"].cast("string")), ",")
    return rows.select("c_custkey", filters.holds(F.col("r"), "T2", "WS", True).alias("all_three"), filters.holds(F.col("r"), discipline="JGS").alias("junior"), split(True).alias("first_"), split(False).alias("rest"))


@add("""
    WITH s AS (SELECT l_orderkey AS k, l_linenumber % 2 + 1 AS side, string_agg('P' || l_partkey, '/' ORDER BY l_suppkey, l_partkey) AS names FROM lineitem GROUP BY ALL), w AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS side FROM orders)
    SELECT o_orderkey, names AS winner_name FROM orders JOIN w ON w.k = o_orderkey LEFT JOIN s ON s.k = w.k AND s.side = w.side""")
def winner_names(spark, sf_dir):
    """Names of the winning side, joined by a key that is computed from the winner."""
    player = F.struct("l_suppkey", "l_partkey")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(player)), lambda p: F.concat(F.lit("P"), p["l_partkey"].cast("string"))), "/")
    sides = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("side_no")).agg(names.alias("winner_name"))
    won = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
    return read(spark, sf_dir, "orders").select("o_orderkey", won.alias("side_no")).join(sides, ["o_orderkey", "side_no"], "left").select("o_orderkey", "winner_name")


@add("""
    WITH d AS (SELECT s_suppkey AS id, 'Slug ' || s_suppkey AS slug, 'P' || s_suppkey % 60 AS name FROM supplier), n AS (SELECT name, max_by(slug, id) AS slug FROM d GROUP BY 1),
    a AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 150 END AS pid, 'P' || o_custkey % 90 AS name FROM orders)
    SELECT k AS o_orderkey, coalesce(d.slug, n.slug) AS slug FROM a LEFT JOIN d ON d.id = a.pid LEFT JOIN n ON n.name = a.name""")
def shown_players(spark, sf_dir):
    """Display columns by id, else by exact name."""
    k, c, s = F.col("o_orderkey"), F.col("o_custkey"), F.col("s_suppkey")
    table = read(spark, sf_dir, "supplier").select(s.alias("player_id"), _text("Slug ", s).alias("slug"), F.concat(F.lit(" P"), (s % 60).cast("string"), F.lit(" ")).alias("name"))
    rows = read(spark, sf_dir, "orders").select(k, F.when(k % 3 == 0, c % 150).alias("player_id"), F.concat(F.lit("P"), (c % 90).cast("string"), F.lit("  ")).alias("player_name"))
    return views.by_id_or_name(rows, table, ["slug"]).select("o_orderkey", "slug")


@add("""
    WITH i AS (SELECT o_orderkey AS k, pos, [o_custkey % 150, o_orderkey % 40, o_custkey % 7, o_custkey % 150][pos] AS id FROM orders, range(1, 5) x(pos))
    SELECT o_orderkey, coalesce(names, '') AS names FROM orders LEFT JOIN (SELECT k, string_agg(s_name, ',' ORDER BY pos) AS names FROM i JOIN supplier ON s_suppkey = id GROUP BY 1) ON k = o_orderkey""")
def names_in_order(spark, sf_dir):
    """Rows for a list of ids, in the list's order, unknown ids left out."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = read(spark, sf_dir, "orders").select(k, F.array(c % 150, k % 40, c % 7, c % 150).alias("ids"))
    found = views.by_position(rows, "ids", read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "found")
    return found.select("o_orderkey", F.coalesce(F.array_join(F.transform("found", lambda x: x["s_name"]), ","), F.lit("")).alias("names"))


@add("""
    WITH e AS (SELECT o_orderkey AS id, 1995 + o_orderkey % 4 AS y, 'open ' || o_custkey % 700 AS k FROM orders WHERE o_orderkey % 5 = 0),
    c AS (SELECT o_orderkey AS k, 1995 + o_orderkey % 5 AS y, 'open ' || o_custkey % 900 AS n, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 5 END AS href FROM orders WHERE o_orderkey % 5 > 0),
    a AS (SELECT k, y, min(id) AS id FROM e GROUP BY ALL HAVING count(DISTINCT id) = 1), b AS (SELECT k, min(id) AS id FROM e GROUP BY 1 HAVING count(DISTINCT id) = 1)
    SELECT c.k AS row_id, coalesce(a.id, b.id, e.id) AS event_id, CASE WHEN a.id IS NOT NULL THEN 1 WHEN b.id IS NOT NULL THEN 2 WHEN e.id IS NOT NULL THEN 3 END AS step FROM c LEFT JOIN a ON a.k = n AND a.y = c.y LEFT JOIN b ON b.k = n LEFT JOIN e ON e.id = href""")
def calendar_matches(spark, sf_dir):
    """Events of calendar rows by name and year, by a name that one event has, by the id in the link."""
    o, k, c = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    events = o.where(k % 5 == 0).select(k.alias("event_id"), (F.lit(1995) + k % 4).alias("year"), F.concat(F.lit("Open "), (c % 700).cast("string"), F.lit(" presented by X")).alias("name"))
    calendar = o.where(k % 5 > 0).select(k.alias("row_id"), (F.lit(1995) + k % 5).alias("year"), F.concat(F.lit(" OPEN,  "), (c % 900).cast("string")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("x?eventId="), (k + 5).cast("string"))).alias("href"))
    return views.calendar_rows(calendar, events).select("row_id", "event_id", F.col("event_id_step").alias("step"))


@add("""
    WITH t AS (SELECT o_custkey % 200 AS grp, 'T' || o_orderkey % 6 AS a, 'T' || (o_orderkey % 6 + 1 + o_custkey % 3) AS b, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 4 END AS x, o_orderkey // 3 % 4 AS y, CASE WHEN o_orderkey % 11 = 0 THEN 'B' END AS given FROM orders),
    d AS (SELECT *, coalesce(given, CASE WHEN x > y THEN 'A' WHEN y > x THEN 'B' END) AS w FROM t),
    r AS (SELECT grp, a AS team, w = 'A' AS won, coalesce(x, 0) AS plus, CASE WHEN x IS NULL THEN 0 ELSE y END AS minus FROM d WHERE w IS NOT NULL UNION ALL SELECT grp, b, w = 'B', CASE WHEN x IS NULL THEN 0 ELSE y END, coalesce(x, 0) FROM d WHERE w IS NOT NULL),
    g AS (SELECT grp, team, count(r.team) AS played, count(*) FILTER (won) AS won, coalesce(sum(plus), 0)::BIGINT AS score_for, coalesce(sum(minus), 0)::BIGINT AS score_against FROM (SELECT DISTINCT grp, unnest([a, b]) AS team FROM t) LEFT JOIN r USING (grp, team) GROUP BY ALL)
    SELECT grp AS group_code, team AS team_code, played, won, played - won AS lost, score_for, score_against, row_number() OVER (PARTITION BY grp ORDER BY won DESC, score_for - score_against DESC, score_for DESC, team)::INTEGER AS rank FROM g""")
def group_tables(spark, sf_dir):
    """Tables of groups from ties; teams without a decided tie stand with zeros."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    score = F.when(k % 5 > 0, F.concat((k % 4).cast("string"), F.lit(" - "), (F.floor(k / 3) % 4).cast("string")))
    ties = read(spark, sf_dir, "orders").select((c % 200).alias("group_code"), _text("T", k % 6).alias("team_a"), _text("T", k % 6 + 1 + c % 3).alias("team_b"), score.alias("match_score"), F.when(k % 11 == 0, "B").alias("winner_side"))
    teams = ties.select("group_code", F.explode(F.array("team_a", "team_b")).alias("team_code"))
    return stats.standings(teams, ties).select("group_code", "team_code", "played", "won", "lost", "score_for", "score_against", "rank")


@add("""
    WITH v AS (SELECT l_orderkey AS k, nullif('C' || l_suppkey % 4, 'C3') AS c, l_linenumber * 1000000 + l_partkey AS seq FROM lineitem), n AS (SELECT k, c, count(*) AS n, min(seq) AS seen FROM v WHERE c IS NOT NULL GROUP BY ALL),
    d AS (SELECT l_orderkey AS k, ['R32', 'R16', 'QuarterFinal', 'Final'][l_partkey % 4 + 1] AS r, [30, 40, 50, 80][l_partkey % 4 + 1] AS o, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT k AS l_orderkey, (SELECT min_by(c, (-n, c)) FROM n WHERE n.k = x.k) AS by_letter, (SELECT min_by(c, (-n, seen)) FROM n WHERE n.k = x.k) AS by_place, (SELECT max_by(r, (n, o)) FROM d WHERE d.k = x.k) AS draw_round FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) x""")
def votes(spark, sf_dir):
    """Majorities with ties by letter and by first place, and the draw round of most of a tie's rubbers."""
    lines, part = read(spark, sf_dir, "lineitem"), F.col("l_partkey")
    rows = lines.select("l_orderkey", F.nullif(_text("C", F.col("l_suppkey") % 4), F.lit("C3")).alias("c"), (F.col("l_linenumber") * 1_000_000 + part).alias("seq"))
    rounds = lines.select("l_orderkey", _pick(["R32", "R16", "QuarterFinal", "Final"], part).alias("draw_round"), _pick([30, 40, 50, 80], part).alias("round_order"))
    out = lines.select("l_orderkey").distinct().join(R.majority(rows, "l_orderkey", "c", "by_letter"), "l_orderkey", "left").join(R.majority(rows, "l_orderkey", "c", "by_place", "seq"), "l_orderkey", "left")
    return out.join(bracket.modal_round(rounds, ["l_orderkey"]), "l_orderkey", "left").select("l_orderkey", "by_letter", "by_place", "draw_round")


@add("""
    WITH m AS (SELECT o_custkey AS p, 'E' || o_orderkey % 9 AS e, o_orderstatus = 'F' AS won FROM orders)
    SELECT c_custkey AS player_id, count(DISTINCT e) AS events, count(e) AS matches, count(*) FILTER (won) AS wins FROM customer LEFT JOIN m ON p = c_custkey GROUP BY 1""")
def match_file_totals(spark, sf_dir):
    """Events, matches and wins of every ranked player's match files, zeros without one."""
    matches = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("player_id"), _text("E", F.col("o_orderkey") % 9).alias("event_name"), F.when(F.col("o_orderstatus") == "F", "W").otherwise("L").alias("result"))
    return stats.legacy_totals(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id")), matches)


_SIDES = """s AS (SELECT CASE WHEN l_partkey % 13 > 0 THEN 'P' || l_partkey % 300 || CASE WHEN l_suppkey % 2 = 0 THEN ' x' ELSE ' X' END ELSE ' ' END AS name, nullif('N' || l_suppkey % 3, 'N2') AS country, CASE WHEN l_linenumber % 3 = 0 THEN '名' || l_partkey % 2 WHEN l_linenumber % 3 = 1 THEN ' ' END AS zh FROM lineitem)"""


def _sides(spark, sf_dir):
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    name = F.when(part % 13 > 0, F.concat(F.lit("P"), (part % 300).cast("string"), F.when(supp % 2 == 0, " x").otherwise(" X"))).otherwise(" ")
    return read(spark, sf_dir, "lineitem").select(name.alias("name"), F.nullif(_text("N", supp % 3), F.lit("N2")).alias("country"), F.when(F.col("l_linenumber") % 3 == 0, _text("名", part % 2)).when(F.col("l_linenumber") % 3 == 1, " ").alias("name_zh"))


@add(f"WITH {_SIDES} SELECT name, country, count(*) AS occurrences, coalesce(array_to_string(list_sort(list(DISTINCT zh) FILTER (trim(zh) <> '')), ','), '') AS names_zh FROM s WHERE trim(name) <> '' GROUP BY 1, 2")
def harvested_players(spark, sf_dir):
    """Players of match files by name and country, with occurrences and spellings."""
    return identity.harvest(_sides(spark, sf_dir)).select("name", "country", "occurrences", F.array_join("names_zh", ",").alias("names_zh"))


@add(f"""
    WITH {_SIDES}, h AS (SELECT name, country, lower(name) AS k, count(*) AS n FROM s WHERE trim(name) <> '' GROUP BY 1, 2), z AS (SELECT lower(name) AS k, coalesce(array_to_string(list_sort(list(DISTINCT zh) FILTER (trim(zh) <> '')), ','), '') AS names_zh FROM s GROUP BY 1),
    m AS (SELECT k, max_by({{'name': name, 'country': country, 'n': n}}, (n, coalesce(country, '') <> '', coalesce(country, ''), name)) AS r FROM h WHERE k NOT IN (SELECT 'p' || p_partkey || ' x' FROM part WHERE p_partkey % 2 = 0) GROUP BY 1)
    SELECT k, r.n AS occurrences, r.country IS NOT NULL AS coded, names_zh FROM m JOIN z USING (k)""")
def players_to_add(spark, sf_dir):
    """Harvested names without a player: the most frequent spelling of each, then one with a country."""
    players = read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit(" P"), F.col("p_partkey").cast("string"), F.lit("  X")).alias("name"))
    out = identity.missing_players(identity.harvest(_sides(spark, sf_dir)), players)
    return out.select(F.lower("name").alias("k"), "occurrences", F.col("country").isNotNull().alias("coded"), F.array_join("names_zh", ",").alias("names_zh"))


@add("""
    WITH c AS (SELECT c_custkey AS k, ['GPB', 'GPA', 'R16', NULL, 'X'][c_custkey % 5 + 1] AS code, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 17 END AS rank, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 31 END AS pos, 'unit-' || c_custkey % 110 AS unit FROM customer)
    SELECT k AS c_custkey, row_number() OVER (ORDER BY CASE code WHEN 'GPA' THEN 1 WHEN 'GPB' THEN 2 WHEN 'R16' THEN 3 ELSE 4 END, code NULLS LAST, k) AS by_list, row_number() OVER (ORDER BY coalesce(rank, 9999), k) AS by_rank,
      row_number() OVER (ORDER BY coalesce(pos, k), k) AS by_bracket, row_number() OVER (ORDER BY split_part(unit, '-', 2)::INTEGER, k) AS by_number FROM c""")
def list_orders(spark, sf_dir):
    """Places in four orders: a list of codes, ranks with unknown ones last, bracket places else ids, numbers at the end of a text.

    Places are over all rows, by one global sort each; the lists themselves are pages of one event.
    """
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select(k, _pick(["GPB", "GPA", "R16", None, "X"], k).alias("code"), F.when(k % 3 > 0, k % 17).alias("rank"), F.when(k % 4 > 0, k % 31).alias("pos"), _text("unit-", k % 110).alias("unit"))
    number = F.regexp_extract("unit", r"(\d+)$", 1).cast("int")
    orders = {"by_list": R.preferred_order(F.col("code"), ["GPA", "GPB", "R16"]), "by_rank": [F.coalesce("rank", F.lit(9999))], "by_bracket": [F.coalesce("pos", k)], "by_number": [number]}
    out = rows.select(k)
    for name, order in orders.items():
        out = out.join(R.placed(rows, name, *order, k).select("c_custkey", name), "c_custkey")
    return out


@add("""
    WITH p AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS a, string_split(p_type || ' ' || lower(p_name) || ' ' || p_brand, ' ') AS b, ['x', p_brand] AS c FROM part)
    SELECT k AS p_partkey, list_has_any(a, b) AS shares, NOT list_has_any(b, c) AS disjoint_, (SELECT string_agg(w, ',' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(list_concat(a, b, c)) AS w, generate_subscripts(list_concat(a, b, c), 1) AS i) GROUP BY w)) AS words FROM p""")
def word_sets(spark, sf_dir):
    """Sets of words that meet or do not, and lists joined with the first of each word kept."""
    a, b, c = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_type", F.lower("p_name"), "p_brand"), " "), F.array(F.lit("x"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", F.arrays_overlap(a, b).alias("shares"), (~F.arrays_overlap(b, c)).alias("disjoint_"), F.array_join(F.array_distinct(F.concat(a, b, c)), ",").alias("words"))


RAW = ["8FNL", " 8fnl ", "QFNL", None, "R16"]


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, {_sql(RAW, 'o_orderkey')} AS raw, CASE WHEN o_orderkey % 7 > 0 THEN 'QF' ELSE 'R16' END AS code FROM orders)
    SELECT k AS match_id, raw, 'R16' AS round_code FROM o WHERE upper(trim(raw)) = '8FNL' AND code = 'QF'""")
def repaired_rounds(spark, sf_dir):
    """Rows that a repair of wrongly coded rounds changes, as they are afterwards; all others stay untouched."""
    k = F.col("o_orderkey")
    rows = read(spark, sf_dir, "orders").select(k.alias("match_id"), _pick(RAW, k).alias("raw"), F.when(k % 7 > 0, "QF").otherwise("R16").alias("round_code"))
    return only_changed(rows, rows.withColumn("round_code", schedule.repaired_round(F.col("raw"), F.col("round_code"))), "match_id", ["round_code"])


@add("""
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Team ' || c_custkey WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'FAM Giv' ELSE 'Giv' END WHEN c_custkey % 4 = 0 THEN 'C' || c_custkey WHEN c_custkey % 4 = 1 THEN 'ORG' ELSE 'TBD' END AS competitor,
      CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'FAM Giv' ELSE 'Giv' END WHEN c_custkey % 4 = 0 THEN 'C' || c_custkey ELSE 'Unknown' END AS athlete, c_custkey % 5 IN (0, 1) OR c_custkey % 6 = 0 AS is_placeholder,
      CASE WHEN c_custkey % 2 = 0 THEN 'english' WHEN c_custkey % 3 = 0 THEN NULL ELSE 'chinesisch' END AS item FROM customer""")
def shown_competitors(spark, sf_dir):
    """Names of competitors and athletes from what a feed gives, places not yet filled, and texts by language."""
    k = F.col("c_custkey")
    team, given, family = F.when(k % 3 == 0, _text(" Team ", k)).otherwise(" "), F.when(k % 3 == 1, "Giv "), F.when((k % 3 == 1) & (k % 2 == 0), " FAM")
    code, org = F.when(k % 4 == 0, _text("C", k)).otherwise(""), F.when(k % 4 == 1, "ORG").otherwise("")
    entry = lambda language, value: F.struct(F.lit(language).alias("Language"), value.alias("Value"))
    items = F.array(entry("CHI", F.when(k % 3 > 0, "chinesisch").otherwise("")), entry("ENG", F.when(k % 2 == 0, "english").otherwise("")))
    return read(spark, sf_dir, "customer").select(
        k, competitor_name(team, given, family, code, org).alias("competitor"), athlete_name(given, family, code).alias("athlete"), placeholder(_pick(["DEF", "tbd", "CHN", None, ""], k), F.when(k % 6 == 0, " Tbd ").otherwise("Name")).alias("is_placeholder"), text_value(items).alias("item"),
    )


@add("""
    SELECT o_orderpriority AS source, count(*) AS rows, count(*) FILTER (o_orderkey % 3 = 0) AS player_a, count(*) FILTER (o_custkey % 4 = 0) AS player_b FROM orders GROUP BY 1""")
def null_players(spark, sf_dir):
    """Rows and missing players of every source."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.when(F.col("o_orderkey") % 3 > 0, 1).alias("player_a"), F.when(F.col("o_custkey") % 4 > 0, 1).alias("player_b"))
    return quality.null_share(rows.groupBy("source"), "player_a", "player_b")


@add("""
    WITH f AS (SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), r AS (SELECT c_mktsegment AS label, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT id FROM f) GROUP BY 1)
    SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS unmatched FROM customer LEFT JOIN r ON label = c_mktsegment WHERE c_custkey IN (SELECT id FROM f)""")
def importable_rows(spark, sf_dir):
    """Rows that stand in the table and have a file, with the number of rows of their kind that have none."""
    customers, files = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey")
    left = R.missing(customers, files, {"c_custkey": "o_custkey"}).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("unmatched"))
    found = R.existing(customers, "c_custkey", (files, "o_custkey")).select("c_custkey", "c_mktsegment")
    return found.join(left, "c_mktsegment", "left").fillna(0, subset=["unmatched"])


@add("""
    WITH t AS (SELECT 'customer' AS source, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'blank', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) SELECT source, n FROM t""")
def verified_counts(spark, sf_dir):
    """Counts that are checked after an import, one row each."""
    orders = read(spark, sf_dir, "orders")
    count = lambda df, name: quality.report(df, n=F.count(F.lit(1))).select(F.lit(name).alias("source"), "n")
    return count(read(spark, sf_dir, "customer"), "customer").union(count(orders, "orders")).union(count(orders.where(~F.col("o_orderstatus").isin("F", "O")), "blank"))


@add("""
    WITH p AS (SELECT c_custkey AS id, c_name AS name, 'slug-' || c_custkey % 50 AS slug, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 200 END AS rank, CASE WHEN c_custkey % 4 = 0 THEN 'customer' WHEN c_custkey % 4 = 1 THEN 'x customer' END AS zh FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT id AS player_id, rank::BIGINT AS rank, (CASE WHEN lower(coalesce(zh, '')) = 'customer' THEN 1 WHEN lower(name) = 'customer' THEN 2 WHEN slug = 'customer' THEN 3 WHEN lower(coalesce(zh, '')) LIKE 'customer%' THEN 4 WHEN lower(name) LIKE 'customer%' THEN 5 WHEN slug LIKE 'customer%' THEN 6 WHEN rank IS NOT NULL THEN 7 ELSE 8 END)::INTEGER AS relevance
    FROM p ORDER BY relevance, coalesce(rank, 999999), name, id LIMIT 20""")
def search_hits(spark, sf_dir):
    """The twenty best hits of a search, which is what a search shows."""
    k = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(k.alias("player_id"), F.col("c_name").alias("name"), _text("slug-", k % 50).alias("slug"), F.when(k % 4 == 0, "Customer").when(k % 4 == 1, "x customer").alias("name_zh"), F.lit("X").alias("country_code"))
    entries = read(spark, sf_dir, "customer").where(k % 3 > 0).select(F.lit(2).alias("snapshot_id"), k.alias("player_id"), (k % 200).alias("rank"))
    snapshots = read(spark, sf_dir, "region").select(F.lit("women_singles").alias("category"), F.concat(F.lit("2025-0"), (F.col("r_regionkey") % 3 + 1).cast("string")).alias("ranking_date"), (F.col("r_regionkey") % 3).cast("int").alias("snapshot_id"))
    return views.search_players(people, entries, snapshots, " CUSTOMER", 50).select("player_id", "rank", "relevance")


@add("""
    WITH s AS (SELECT o_orderkey AS id, ['women_singles', 'men_singles'][o_orderkey % 2 + 1] AS cat, o_orderdate AS d FROM orders), last AS (SELECT max_by(id, (d, id)) AS id FROM s WHERE cat = 'women_singles'),
    e AS (SELECT c_custkey AS p, c_custkey AS rank, c_custkey % 9 AS ev, c_custkey % 40 AS m, c_custkey % 40 // 2 AS w, (SELECT id FROM last) AS snap FROM customer), r AS (SELECT p AS player_id, rank, coalesce(w::DOUBLE / nullif(m::DOUBLE, 0) * 100, 0.0) AS win_rate FROM e WHERE ev > 5)
    SELECT player_id, rank, win_rate, (SELECT count(*) FROM r) AS total, (SELECT count(*) FROM r) > 120 AS has_more FROM r ORDER BY win_rate DESC, rank, player_id LIMIT 100 OFFSET 20""")
def rate_page(spark, sf_dir):
    """One page of the latest ranking by win rate, a hundred rows at most: the page is what the list shows."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    snapshots = read(spark, sf_dir, "orders").select(k.alias("snapshot_id"), _pick(["women_singles", "men_singles"], k).alias("category"), F.col("o_orderdate").alias("ranking_date"))
    last = views.latest_snapshot(snapshots, "women_singles").select("snapshot_id")
    entries = read(spark, sf_dir, "customer").select(c.alias("player_id"), c.alias("rank"), (c % 9).alias("career_events"), (c % 40).alias("career_matches"), F.floor(c % 40 / 2).alias("career_wins")).crossJoin(F.broadcast(last))  # one row is broadcast
    people = read(spark, sf_dir, "customer").select(c.alias("player_id"))
    return views.rankings(snapshots, entries, people, "women_singles", R.clamp(500, 1, 100, 20), 20, by_rate=True).select("player_id", "rank", "win_rate", "total", "has_more")
