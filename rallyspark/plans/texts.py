"""Registered queries: the scalar rules of texts, dates, scores and rounds over whole tables (see ``joins`` for what they stand for).

Feeds of the platform's shapes are made from the driver's tables: a row's key picks a form from a list, its other columns fill it.
The SQL beside each query states the rule itself, with DuckDB's functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rallyspark.functions import dates as D
from rallyspark.functions import rounds as G
from rallyspark.functions import scores as S
from rallyspark.functions import text as T
from rallyspark.plans.common import Registry, read

registry = Registry()
add = registry.add


def _pick(forms: list[str | None], n: Column) -> Column:
    return F.get(F.array(*map(F.lit, forms)), F.pmod(n, F.lit(len(forms))).cast("int"))


def _sql(forms: list[str | None], n: str) -> str:
    """The same choice in SQL."""
    return "[" + ", ".join("NULL" if f is None else "'" + f.replace("'", "''") + "'" for f in forms) + f"][({n}) % {len(forms)} + 1]"


_RAW = """'  ' || upper(p_name) || ',  ' || p_brand || '. ' || CASE WHEN p_partkey % 3 = 0 THEN 'Presented   by ' || p_type ELSE p_type || ' (19' || (p_partkey % 90 + 10) || ')' END"""
ACCENTS = ["José Müller", "ÅSE ñandú", "Łukasz Žižka", "plain name", "Çelik Ö'Brien"]


@add(f"""
    WITH p AS (SELECT p_partkey, {_RAW} AS raw, p_name, p_brand, p_type, {_sql(ACCENTS, 'p_partkey')} AS marked FROM part)
    SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(raw)), '\\s+presented\\s+by\\s+.*$', ''), '[,.]', '', 'g'), '\\s+', ' ', 'g')) AS event_name,
      array_to_string(list_sort(list_filter(string_split_regex(lower(raw), '\\s+'), lambda w: w <> '')), ' ') AS name_key,
      trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')) AS squeezed,
      trim(regexp_replace(regexp_replace(lower(trim(raw)), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')) AS slug,
      trim(regexp_replace(replace(p_brand || ' ' || p_type || '--', ' ', ''), '-+$', '')) AS code, trim(regexp_replace(p_brand || ' x--', '-+$', '')) AS read_code,
      trim(regexp_replace(lower(trim(raw)), '[^a-z0-9]+', '-', 'g'), '-') AS token,
      least(p_name, p_type) || '|' || greatest(p_name, p_type) AS pair, strip_accents(marked) AS bare,
      trim(regexp_replace(lower(strip_accents(marked)), '[^a-z0-9]+', ' ', 'g')) AS lookup,
      strpos(' ' || lower(p_name) || ' ', ' ring ') > 0 AS has_ring,
      list_distinct([trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), trim(regexp_replace(trim(regexp_replace(lower(raw), '\\s+', ' ', 'g')), '\\s+\\((?:19|20)\\d{{2}}\\)$', ''))]).list_sort().array_to_string('#') AS variants
    FROM p""")
def text_keys(spark, sf_dir):
    """Keys of names, events, stages and match codes; names without marks, in phrases and in their variants."""
    p = read(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("Presented   by "), F.col("p_type"))).otherwise(F.concat(F.col("p_type"), F.lit(" (19"), (F.col("p_partkey") % 90 + 10).cast("string"), F.lit(")")))
    p = p.select("p_partkey", "p_name", "p_brand", "p_type", F.concat(F.lit("  "), F.upper("p_name"), F.lit(",  "), F.col("p_brand"), F.lit(". "), tail).alias("raw"), _pick(ACCENTS, F.col("p_partkey")).alias("marked"))
    raw, marked = F.col("raw"), F.col("marked")
    return p.select(
        "p_partkey", T.normalize_event_name(raw).alias("event_name"), T.name_key(raw).alias("name_key"), T.normalize_text(raw).alias("squeezed"), T.slugify(raw).alias("slug"),
        T.match_code(F.concat("p_brand", F.lit(" "), "p_type", F.lit("--"))).alias("code"), T.match_code(F.concat("p_brand", F.lit(" x--")), drop_spaces=False).alias("read_code"),
        T.stage_token(raw).alias("token"), T.pair_key(F.col("p_name"), F.col("p_type")).alias("pair"), T.fold_accents(marked).alias("bare"), T.lookup_text(marked).alias("lookup"),
        T.contains_phrase(F.lower("p_name"), F.lit("ring")).alias("has_ring"), F.array_join(F.array_sort(T.name_variants(raw)), "#").alias("variants"),
    )


@add("""
    WITH l AS (SELECT l_orderkey, list_sort(list_distinct(list('s' || l_suppkey || '|' || upper(l_returnflag)))) AS named,
        list_sort(list_distinct(list(CASE WHEN l_suppkey % 2 = 0 THEN 'id:' || l_suppkey ELSE 'name:s' || l_suppkey || '|' || upper(l_returnflag) END))) AS members, list_sort(list_distinct(list(upper(l_returnflag)))) AS flags FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN len(flags) = 1 THEN flags[1] END AS only_country, array_to_string(flags, ',') AS countries,
      CASE WHEN len(flags) = 1 THEN 'C:' || flags[1] ELSE 'R:' || array_to_string(named, '||') END AS team, 'R:' || array_to_string(members, '||') AS roster FROM l""")
def roster_keys(spark, sf_dir):
    """Countries, team keys and roster keys of the players of each order."""
    player = F.struct(F.concat(F.lit(" S"), F.col("l_suppkey").cast("string")).alias("name"), F.lower("l_returnflag").alias("country"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("player_id"))
    sides = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(player).alias("p"))
    p = F.col("p")
    return sides.select("l_orderkey", T.single_country(p).alias("only_country"), F.array_join(T.countries_of(p), ",").alias("countries"), T.team_key(p).alias("team"), T.roster_key(p).alias("roster"))


CELLS = ["{n} (CHN)", "{n}", "", " {n}  (JPN) ", "{n} GER)"]
TABLES = ["Table 1", "T 07", "table 12 hall", "court x", "", None]
NAMES = ["WTT Star Contender Doha 2024", "World Cup, 2019", "Open presented by A Bank 2021", "Grand Smash", "Cup 1850"]
LINKS = ["/x?eventId=12", "https://h/tournament/77/info", "/tournament/abc/", "eventId=5&tournament/9/"]


@add(f"""
    WITH e AS (SELECT event_id, event_type AS n, {_sql(CELLS, 'event_id')} AS c1, {_sql(CELLS, 'event_id // 5')} AS c2, {_sql(CELLS, 'event_id // 25')} AS c3, {_sql(TABLES, 'event_id')} AS tab,
        {_sql(NAMES, 'event_id')} AS name, {_sql(LINKS, 'event_id')} AS link, (event_id % 40) AS y FROM events),
    r AS (SELECT *, (1990 + y) || ' | ' || n || ' | ' || replace(c1, '{{n}}', n) || ' | ' || replace(c2, '{{n}}', n) || '|' || replace(c3, '{{n}}', n) AS raw FROM e),
    s AS (SELECT *, list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: regexp_matches(x, '^.+\\(\\w+\\)$')) AS hits, trim(replace(c1, '{{n}}', n)) AS tok,
      trim(regexp_replace(name, '(?i)\\s+presented\\s+by\\s+.*$', '')) AS bare FROM r)
    SELECT event_id, CASE WHEN regexp_matches(tok, '^(.+?)\\s*\\((\\w+)\\)$') THEN regexp_extract(tok, '^(.+?)\\s*\\((\\w+)\\)$', 1) ELSE tok END AS player, nullif(regexp_extract(tok, '^(.+?)\\s*\\((\\w+)\\)$', 2), '') AS country,
      len(hits)::INTEGER AS players, CASE WHEN len(hits) = 2 THEN hits[1] ELSE '' END AS side_a, CASE WHEN len(hits) = 2 THEN hits[2] ELSE '' END AS side_b,
      1990 + y::INTEGER AS raw_year, nullif(n, '') AS raw_event, nullif(trim(replace(c1, '{{n}}', n)), '') AS cell, array_to_string(list_filter(list_transform(string_split(replace(c1, '{{n}}', n) || ' / ' || n, '/'), lambda x: trim(x)), lambda x: x <> ''), '&') AS rubber,
      CASE WHEN regexp_extract(coalesce(tab, ''), '(?i)\\b(?:Table|T)\\s*0*(\\d+)\\b', 1) <> '' THEN 'T' || lpad(regexp_extract(tab, '(?i)\\b(?:Table|T)\\s*0*(\\d+)\\b', 1), 2, '0') ELSE upper(nullif(trim(tab), '')) END AS table_code,
      CASE WHEN regexp_matches(bare, '^(.*?)[\\s,]+((?:19|20)\\d{{2}})$') THEN regexp_extract(bare, '^(.*?)[\\s,]+((?:19|20)\\d{{2}})$', 1) ELSE bare END AS base_name, try_cast(nullif(regexp_extract(bare, '^(.*?)[\\s,]+((?:19|20)\\d{{2}})$', 2), '') AS INTEGER) AS name_year,
      coalesce(try_cast(nullif(regexp_extract(link, 'eventId=(\\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(link, '/tournament/(\\d+)/', 1), '') AS BIGINT)) AS calendar_id, 'Match ' || y || ' / Rubber 2' AS rubber_label, y::INTEGER AS match_no,
      array_to_string(list_filter(list_transform(string_split(y || ', x,' || event_id || ',', ','), lambda x: try_cast(trim(x) AS BIGINT)), lambda x: x IS NOT NULL), ',') AS ids
    FROM s""")
def raw_rows(spark, sf_dir):
    """Cells of raw rows: players, sides, year and event, tables, labels, ids in links and lists."""
    e, k, n = read(spark, sf_dir, "events"), F.col("event_id"), F.col("event_type")
    fill = lambda c: F.replace(c, F.lit("{n}"), n)
    cell = [fill(_pick(CELLS, F.floor(k / 5**i))) for i in range(3)]
    y = (k % 40).cast("string")
    raw = F.concat((k % 40 + 1990).cast("string"), F.lit(" | "), n, F.lit(" | "), cell[0], F.lit(" | "), cell[1], F.lit("|"), cell[2])
    token, sides, identity, name = T.player_token(cell[0]), T.row_sides(F.col("raw")), T.raw_identity(F.col("raw")), T.split_event_name(_pick(NAMES, k))
    pair = F.size(T.row_players(F.col("raw"))) == 2
    return e.withColumn("raw", raw).select(
        "event_id", token["name"].alias("player"), token["country"].alias("country"), F.size(T.row_players(F.col("raw"))).alias("players"),
        F.when(pair, F.array_join(sides["a"], "&")).otherwise("").alias("side_a"), F.when(pair, F.array_join(sides["b"], "&")).otherwise("").alias("side_b"), identity["year"].alias("raw_year"), identity["event"].alias("raw_event"),
        T.fixed_row(F.col("raw"), ["year", "event", "cell"])["cell"].alias("cell"), F.array_join(T.rubber_names(F.concat(cell[0], F.lit(" / "), n)), "&").alias("rubber"),
        T.table_label(_pick(TABLES, k)).alias("table_code"), name["base"].alias("base_name"), name["year"].alias("name_year"), T.event_id_from_href(_pick(LINKS, k)).alias("calendar_id"),
        T.rubber_label(F.concat(F.lit("Match "), y), F.lit(2)).alias("rubber_label"), T.match_number(F.concat(F.lit("x Match "), y, F.lit(" y"))).alias("match_no"),
        F.array_join(F.transform(T.id_list(F.concat(y, F.lit(", x,"), k.cast("string"), F.lit(","))), lambda x: x.cast("string")), ",").alias("ids"),
    )


TIES = ["{a}-{b}", "{a} - {b} ", "x {a}-{b} y", "", None, "{a}:{b}", "{a} - {b} (11-9, 8-11)", "abc"]
FORFEITS = ["{a}-{b}", "{a}-{b} WO", "{a} WO-{b}", "{a} - {b} RET", "{a} INJ - {b}", "w/o", "", None]
STATES = ["Official", "LIVE ", "scheduled", "Walkover", "canceled", "other", None]
ROUNDS = ["Final", "SemiFinal", "QuarterFinal", "R16", "R32", "R64", "R128", "Group 1", None]
GAMES = ["11-{a},{b}-11", "11:{a}, x, 0-0, -{b}-4", '["11-{a}","{b}:11","bad"]', '[{{"player":{a},"opponent":{b}}},{{"player":0,"opponent":0}}]', "", None]


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, (o_custkey % 5)::VARCHAR AS a, (o_orderkey // 7 % 5)::VARCHAR AS b, {_sql(TIES, 'o_orderkey')} AS f, {_sql(FORFEITS, 'o_orderkey')} AS g, {_sql(STATES, 'o_orderkey')} AS st, {_sql(ROUNDS, 'o_orderkey')} AS r,
        {_sql(["W", "w", "L", "", None], 'o_orderkey')} AS flag, o_orderkey % 2 = 0 AS first_a FROM orders),
    t AS (SELECT *, replace(replace(f, '{{a}}', a), '{{b}}', b) AS tie, trim(replace(replace(g, '{{a}}', a), '{{b}}', b)) AS fo FROM o),
    u AS (SELECT *, try_cast(nullif(regexp_extract(tie, '(\\d+)\\s*-\\s*(\\d+)', 1), '') AS INTEGER) AS ta, try_cast(nullif(regexp_extract(tie, '(\\d+)\\s*-\\s*(\\d+)', 2), '') AS INTEGER) AS tb,
        try_cast(nullif(regexp_extract(tie, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 1), '') AS INTEGER) AS ma, try_cast(nullif(regexp_extract(tie, '^\\s*(\\d+)\\s*-\\s*(\\d+)\\s*$', 2), '') AS INTEGER) AS mb,
        regexp_matches(replace(trim(split_part(coalesce(tie, ''), '(', 1)), ' ', ''), '^\\d+-\\d+$') AS br, replace(trim(split_part(coalesce(tie, ''), '(', 1)), ' ', '') AS bt,
        regexp_matches(fo, '^\\d+\\s*-\\s*\\d+(\\s+(WO|INJ|DNS|DSQ|RET))?$') AS back, regexp_matches(fo, '^\\d+\\s+(WO|INJ|DNS|DSQ|RET)\\s*-\\s*\\d+$') AS front FROM t),
    v AS (SELECT *, try_cast(CASE WHEN br THEN split_part(bt, '-', 1) END AS INTEGER) AS ba, try_cast(CASE WHEN br THEN split_part(bt, '-', 2) END AS INTEGER) AS bb,
        try_cast(nullif(regexp_extract(fo, '^(\\d+)', 1), '') AS INTEGER) AS f1, try_cast(nullif(regexp_extract(fo, '-\\s*(\\d+)', 1), '') AS INTEGER) AS f2, nullif(regexp_extract(fo, '(WO|INJ|DNS|DSQ|RET)', 1), '') AS mark FROM u),
    w AS (SELECT *, CASE WHEN first_a THEN f1 ELSE f2 END AS fa, CASE WHEN first_a THEN f2 ELSE f1 END AS fb, mark IS NOT NULL AND (front = first_a) AS on_a, mark IS NOT NULL AND (front <> first_a) AS on_b FROM v)
    SELECT k AS o_orderkey, ta AS tie_a, tb AS tie_b, ma AS match_a, mb AS match_b, ba AS bracket_a, bb AS bracket_b, CASE WHEN ta > tb THEN 'A' WHEN tb > ta THEN 'B' END AS tie_winner,
      CASE WHEN ta IS NOT NULL THEN tb || '-' || ta ELSE tie END AS flipped, CASE WHEN ta > tb THEN 'B' WHEN tb > ta THEN 'A' END AS flipped_winner,
      CASE WHEN coalesce(fo, '') = '' THEN NULL WHEN back OR front THEN CASE WHEN on_a THEN fa || ' ' || mark || '-' || fb ELSE fa || '-' || fb || coalesce(' ' || mark, '') END ELSE fo END AS forfeit_score,
      CASE WHEN back OR front THEN CASE WHEN mark = 'WO' AND on_a THEN 'B' WHEN mark = 'WO' AND on_b THEN 'A' WHEN fa > fb THEN 'A' WHEN fb > fa THEN 'B' WHEN on_a THEN 'B' WHEN on_b THEN 'A' END END AS forfeit_winner,
      CASE r WHEN 'Final' THEN 8 WHEN 'SemiFinal' THEN 7 WHEN 'QuarterFinal' THEN 6 WHEN 'R16' THEN 5 WHEN 'R32' THEN 4 WHEN 'R64' THEN 3 WHEN 'R128' THEN 2 ELSE 1 END AS weight,
      CASE lower(trim(st)) WHEN 'official' THEN 'completed' WHEN 'live' THEN 'live' WHEN 'scheduled' THEN 'scheduled' WHEN 'walkover' THEN 'walkover' WHEN 'canceled' THEN 'cancelled' ELSE 'scheduled' END AS status,
      CASE lower(trim(st)) WHEN 'official' THEN 40 WHEN 'live' THEN 30 WHEN 'walkover' THEN 40 WHEN 'canceled' THEN 10 ELSE 20 END AS import_priority,
      CASE WHEN lower(trim(st)) IN ('official', 'walkover') THEN CASE WHEN upper(flag) = 'W' THEN 'A' WHEN ta > tb THEN 'A' WHEN tb > ta THEN 'B' END END AS live_winner,
      CASE WHEN upper(coalesce(flag, '')) = 'W' THEN 'A' WHEN upper(coalesce(flag, '')) = 'L' THEN 'B' WHEN ba > bb THEN 'A' WHEN bb > ba THEN 'B' END AS bracket_winner,
      a <> '0' AND b <> '0' AND first_a AS turned, coalesce(coalesce(ta, 0)::DOUBLE / nullif(coalesce(ta + tb, 0), 0)::DOUBLE * 100.0, 0.0) AS share,
      (CASE WHEN tie <> '' THEN 100 ELSE 0 END + 5 * a::INTEGER + 3 * (b::INTEGER % 3) + CASE WHEN r <> '' THEN 2 ELSE 0 END + CASE WHEN st <> '' THEN 1 ELSE 0 END)::INTEGER AS filled
    FROM w""")
def score_rules(spark, sf_dir):
    """Tie, match and bracket scores, forfeits in side A's view, winners, statuses and weights."""
    o, k = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    a, b = (F.col("o_custkey") % 5).cast("string"), (F.floor(k / 7) % 5).cast("string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{a}"), F.col("a")), F.lit("{b}"), F.col("b"))
    rows = o.select(k, a.alias("a"), b.alias("b")).select("*", fill(_pick(TIES, k)).alias("tie"), fill(_pick(FORFEITS, k)).alias("fo"), _pick(STATES, k).alias("st"), _pick(ROUNDS, k).alias("r"), _pick(["W", "w", "L", "", None], k).alias("flag"), (k % 2 == 0).alias("first_a"))
    tie, match, bracket, forfeit, status = S.tie_score(F.col("tie")), S.match_score(F.col("tie")), S.bracket_score(F.col("tie")), S.forfeit(F.col("fo"), F.col("first_a")), S.status_of(F.col("st"))
    explicit = F.when(F.upper("flag") == "W", "A")
    return rows.select(
        "o_orderkey", tie["a"].alias("tie_a"), tie["b"].alias("tie_b"), match["a"].alias("match_a"), match["b"].alias("match_b"), bracket["a"].alias("bracket_a"), bracket["b"].alias("bracket_b"),
        S.winner_of(tie).alias("tie_winner"), S.flip_score(F.col("tie")).alias("flipped"), S.flip_winner(S.winner_of(tie)).alias("flipped_winner"), forfeit["score"].alias("forfeit_score"), forfeit["winner"].alias("forfeit_winner"),
        S.round_weight(F.col("r")).alias("weight"), status.alias("status"), S.status_priority(status).alias("import_priority"), S.live_winner(status, explicit, F.col("tie")).alias("live_winner"),
        S.bracket_winner(F.col("flag"), F.when(F.upper("flag") == "L", "W"), F.col("tie")).alias("bracket_winner"),
        S.flips_order(F.nullif("a", F.lit("0")), F.nullif("b", F.lit("0")), F.when(F.col("first_a"), F.nullif("b", F.lit("0"))), F.when(F.col("first_a"), F.nullif("a", F.lit("0")))).alias("turned"),
        S.guarded_ratio(F.coalesce(tie["a"], F.lit(0)), F.coalesce(tie["a"] + tie["b"], F.lit(0))).alias("share"),
        S.completeness(F.col("tie"), F.lit(0), F.col("a").cast("int"), F.col("b").cast("int") % 3, F.col("r"), F.col("st")).cast("int").alias("filled"),
    )


DATES = ["{d}-{e} TBD {x}", "{d} {x} – {e} {y}", "{m}-{d}至{n}-{e}", "{x}", "", "{d} {x} - {e}  {y}", "nonsense 1", " {d}{x}至{e} {y} "]
MONTH_NAMES = ["Jan", "february", "MAR", "Apr", "may", "June", "jul", "August", "Sept", "oct", "November", "dec", "x"]
SINCE = ["{x}-5", "soon", "", None, "{x}-17", "{y}"]
OFFSETS = ["+02:00", "-05:30", "Z", "+0845", "", " odd"]
PLACES = ["Doha Open", "LONDON Cup", "Own", "the Ontario, California event", "United States Smash", "Macao", "Singapore and Doha", "China Smash 2024", "Yokohama", "Paris", ""]
_MONTHS = "['january', 'february', 'march', 'april', 'may', 'june', 'july', 'august', 'september', 'october', 'november', 'december']"


def _month(c: str) -> str:
    """Number of an English month name, whole or its first three letters, in SQL."""
    return f"list_position(list_transform({_MONTHS}, lambda m: lower(trim({c})) IN (m, m[1:3])), true)"


def _filled(c: str) -> str:
    for mark, value in (("d", "k % 19 + 3"), ("e", "k % 8 + 20"), ("m", "k % 9 + 1"), ("n", "k // 3 % 12 + 1"), ("x", "x"), ("y", "y")):
        c = f"replace({c}, '{{{mark}}}', ({value})::VARCHAR)"
    return c


@add(f"""
    WITH o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS day, {_sql(MONTH_NAMES, 'o_orderkey // 8')} AS x, {_sql(MONTH_NAMES, 'o_orderkey // 9')} AS y FROM orders),
    f AS (SELECT *, regexp_replace(trim({_filled(_sql(DATES, 'k'))}), '[–—]', '-', 'g') AS t, strftime(day, '%Y-') || {_filled(_sql(SINCE, 'k'))} AS since, {_sql(OFFSETS, 'k')} AS off, lower({_sql(PLACES, 'k')}) AS place FROM o),
    g AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '^[A-Za-z]+$') THEN 0 WHEN regexp_matches(t, '(?i)(\\d+)-(\\d+)\\s*TBD\\s*([A-Za-z]+)') THEN 1 WHEN regexp_matches(t, '(\\d+)\\s*([A-Za-z]+)\\s*[-至]\\s*(\\d+)\\s*([A-Za-z]+)') THEN 2
        WHEN regexp_matches(t, '(\\d+)-(\\d+)\\s*至\\s*(\\d+)-(\\d+)') THEN 3 ELSE 0 END AS form, regexp_extract_all(t, '\\d+') AS ds, regexp_extract_all(replace(t, 'TBD', ''), '[A-Za-z]+') AS ns FROM f),
    r AS (SELECT *, CASE form WHEN 3 THEN ds[2]::INTEGER ELSE ds[1]::INTEGER END AS d1, CASE form WHEN 3 THEN ds[4]::INTEGER ELSE ds[2]::INTEGER END AS d2,
        CASE form WHEN 3 THEN ds[1]::INTEGER ELSE {_month('ns[1]')} END AS m1, CASE form WHEN 3 THEN ds[3]::INTEGER WHEN 1 THEN {_month('ns[1]')} ELSE {_month('ns[2]')} END AS m2, regexp_extract(off, '^([+-])(\\d\\d):?(\\d\\d)$', ['sign', 'h', 'mi']) AS z FROM g)
    SELECT k AS o_orderkey,
      CASE WHEN form > 0 AND m1 > 0 AND m2 > 0 THEN '2024-' || lpad(m1::VARCHAR, 2, '0') || '-' || lpad(d1::VARCHAR, 2, '0') END AS range_start,
      CASE WHEN form > 0 AND m1 > 0 AND m2 > 0 THEN (2024 + (m2 < m1 AND m1 >= 10)::INTEGER) || '-' || lpad(m2::VARCHAR, 2, '0') || '-' || lpad(d2::VARCHAR, 2, '0') END AS range_end,
      nullif({_month('x')}, 0)::INTEGER AS month_no,
      CASE WHEN regexp_matches(since, '^\\d{{4}}-\\w+-\\d{{1,2}}') THEN since[1:5] || lpad(coalesce(list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], regexp_extract(since, '-(\\w+)-', 1)), 1)::VARCHAR, 2, '0') || '-' || lpad(regexp_extract(since, '(\\d+)$', 1), 2, '0') ELSE nullif(since, '') END AS expires,
      CASE WHEN k % 2 = 0 THEN strftime(day, '%Y-%m') END AS ranking_month, strftime(day, '%Y-%m-%d') || 'T' || lpad((k % 24)::VARCHAR, 2, '0') || ':05:00' AS us_local,
      CASE WHEN k % 3 = 0 THEN month(day)::INTEGER END AS zh_month, CASE WHEN k % 3 = 0 THEN day(day)::INTEGER END AS zh_day,
      CASE WHEN k % 2 = 0 THEN year(day) || '-' || strftime(day, '%m-%d') || 'T' || lpad((k % 24)::VARCHAR, 2, '0') || ':30:00' END AS shown_at,
      CASE WHEN k % 5 = 0 THEN 'completed' WHEN DATE '1999-06-01' < day THEN 'upcoming' WHEN DATE '1999-06-01' > day + 30 THEN 'finished_pending_promotion' ELSE 'in_progress' END AS display,
      CASE WHEN day < DATE '1999-06-01' THEN 'completed' ELSE 'upcoming' END AS lifecycle, coalesce(CASE WHEN k % 3 > 0 THEN day < DATE '1999-06-01' END, false) AS past,
      CASE WHEN k % 2 = 0 THEN strftime(day, '%Y-%m-%d') ELSE 'TBD' END AS bucket,
      day::TIMESTAMP + to_minutes((k % 40)::INTEGER) BETWEEN day::TIMESTAMP + to_minutes(10) AND day::TIMESTAMP + to_minutes(25) AS soon, nullif(trim(' ' || {_sql(["x", "", None], 'k')}), '') AS window_end,
      CASE WHEN off = '' OR off = 'Z' OR z.h <> '' THEN strftime(day, '%Y-%m-%dT%H:%M:%S') || CASE WHEN off = 'Z' THEN '+00:00' ELSE off END END AS aware_local,
      CASE WHEN off = 'Z' THEN strftime(day, '%Y-%m-%dT%H:%M:%S') || '+00:00' WHEN z.h <> '' THEN strftime(day::TIMESTAMP - (z.sign || '1')::INTEGER * to_minutes(try_cast(z.h AS INTEGER) * 60 + try_cast(z.mi AS INTEGER)), '%Y-%m-%dT%H:%M:%S') || '+00:00' END AS aware_utc,
      CASE WHEN place LIKE '%own%' THEN 'Own/Zone' WHEN regexp_matches(place, 'united states smash|ontario california|ontario, california') THEN 'America/Los_Angeles' WHEN regexp_matches(place, 'london|united kingdom|england') THEN 'Europe/London' WHEN regexp_matches(place, 'doha|qatar') THEN 'Asia/Qatar'
        WHEN place LIKE '%singapore%' THEN 'Asia/Singapore' WHEN regexp_matches(place, 'macau|macao') THEN 'Asia/Macau' WHEN regexp_matches(place, 'china smash|beijing') THEN 'Asia/Shanghai' WHEN regexp_matches(place, 'yokohama|japan') THEN 'Asia/Tokyo' END AS zone
    FROM r""")
def date_rules(spark, sf_dir):
    """Date ranges of four grammars, months, expiry dates, display times, statuses of a day and zones by keyword."""
    o, k, day = read(spark, sf_dir, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    x, y = _pick(MONTH_NAMES, F.floor(k / 8)), _pick(MONTH_NAMES, F.floor(k / 9))
    values = {"{d}": k % 19 + 3, "{e}": k % 8 + 20, "{m}": k % 9 + 1, "{n}": F.floor(k / 3) % 12 + 1, "{x}": x, "{y}": y}

    def fill(c: Column) -> Column:
        for mark, value in values.items():
            c = F.replace(c, F.lit(mark), value.cast("string"))
        return c

    as_of, iso = F.lit("1999-06-01").cast("date"), F.date_format(day, "yyyy-MM-dd")
    hour = F.lpad((k % 24).cast("string"), 2, "0")
    span = D.date_range(fill(_pick(DATES, k)), F.lit(2024))
    expiry = F.concat(F.date_format(day, "yyyy-"), fill(_pick(SINCE, k)))
    chinese = D.chinese_day(F.when(k % 3 == 0, F.concat(F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))).otherwise(iso))
    shown = F.when(k % 2 == 0, F.concat(F.lit("Match 3 | "), F.date_format(day, "d MMM"), F.lit(", "), hour, F.lit(":30"))).otherwise("Match 3")
    minute = lambda n: F.timestamp_add("MINUTE", n, day.cast("timestamp_ntz"))
    aware = D.local_and_utc(F.concat(iso, F.lit("T00:00:00"), _pick(OFFSETS, k)), F.lit(None).cast("string"))
    place = _pick(PLACES, k)
    return o.select(
        "o_orderkey", span["start"].alias("range_start"), span["end"].alias("range_end"), D.month(x).alias("month_no"), D.expires_date(expiry).alias("expires"),
        D.ranking_month(F.when(k % 2 == 0, iso).otherwise("week 3")).alias("ranking_month"), D.us_time(F.concat(F.date_format(day, "MM/dd/yyyy"), F.lit(" "), hour, F.lit(":05"))).alias("us_local"),
        chinese["month"].alias("zh_month"), chinese["day"].alias("zh_day"), D.display_time(shown, F.year(day)).alias("shown_at"),
        D.display_status(F.when(k % 5 == 0, "completed").otherwise("upcoming"), day, F.date_add(day, 30), F.lit("UTC"), F.to_timestamp(F.lit("1999-06-01 12:00:00"))).alias("display"),
        D.imported_lifecycle(day, as_of).alias("lifecycle"), D.is_past(F.when(k % 3 > 0, day), as_of).alias("past"), D.day_bucket(F.when(k % 2 == 0, day.cast("timestamp")), F.lit(None).cast("timestamp_ntz"), F.lit("UTC"), "UTC").alias("bucket"),
        D.starts_within(minute((k % 40).cast("int")), minute(F.lit(10)), 15).alias("soon"), D.time_window(F.array(F.lit("a"), F.concat(F.lit(" "), _pick(["x", "", None], k))))["end"].alias("window_end"),
        aware["local"].alias("aware_local"), aware["utc"].alias("aware_utc"), D.zone_guess(F.when(place == "Own", "Own/Zone"), place).alias("zone"),
    )


CODES = ["R128", "R64-", "8FNL", "QFNL", "sfnl", "FNL-", "GP{g}", "RND{r}", "XYZ", "", None]
CATEGORIES = ["Men's Singles - Round of 32", "Mixed Doubles Quarterfinal", "Group {g} women", "Qualifying Round {r}", "Preliminary Round", "Semi-Final", "the FINAL", "warm up", None]
TEXTS = ["Women's Teams - Group {g}", "men's singles, Round of 16", "Round of 128", "Preliminary Round {r}", "Mixed Doubles Quarterfinal", "Semifinal", "final day", "finals", ""]
STAGES = ["Main Draw - Division {r}", "Position Draw 第二级别", "Qualification", "正赛", "other Groups", ""]
RAWS = ["x R{g} y", "a | SF | b", "Round of 8 x", "Rd 4", "Group B", "prelim", "nothing", "r{r} of", "Refinal", "quarterfinal Rd  7", "REPECHAGE"]
DOCUMENTS = ["TTEMTEAM-1", "TTEWTEAM-2", "TTEMSINGLES", None, "xTTEMTEAM", "TTEWTEAM", ""]
TEAM_CODES = ["MT", "U19WT", "MS", None, " xt ", "XTT", "U15mt", "XDT", "WTX"]
GAMES_NAMES = ["the Asian Games 2022", "Asian Para Games", "Asian Cup", "ASIAN GAMES and Asian Para Games", "asian games", "", None]


@add(f"""
    WITH e AS (SELECT event_id AS k, lpad((event_id % 20 + 1)::VARCHAR, 2, '0') AS g, (event_id % 4 + 1)::VARCHAR AS r, {_sql(CODES, 'event_id')} AS c, {_sql(CATEGORIES, 'event_id')} AS cat, {_sql(TEXTS, 'event_id // 3')} AS t, {_sql(STAGES, 'event_id')} AS s, concat_ws(' | ', {_sql(RAWS, 'event_id')}, {_sql(RAWS, 'event_id // 11')}) AS w FROM events),
    f AS (SELECT k, g, r, upper(trim(replace(replace(coalesce(c, ''), '{{g}}', g), '{{r}}', r))) AS c, lower(replace(replace(coalesce(cat, ''), '{{g}}', g), '{{r}}', r)) AS cat, replace(replace(t, '{{g}}', g), '{{r}}', r) AS t, replace(s, '{{r}}', r) AS s, replace(replace(w, '{{g}}', g), '{{r}}', r) AS w FROM e),
    h AS (SELECT *, try_cast(nullif(regexp_extract(c, '^GP(\\d{{2}})', 1), '') AS INTEGER) AS gp, nullif(regexp_extract(c, '^RND(\\d+)$', 1), '') AS rnd,
        map {{'R128': 'R128', 'R64-': 'R64', '8FNL': 'R16', 'QFNL': 'QF', 'SFNL': 'SF', 'FNL-': 'F'}}[c] AS direct, c || ' ' || t AS hay FROM f),
    i AS (SELECT *, CASE WHEN gp BETWEEN 1 AND 16 OR rnd IS NOT NULL THEN 'PRELIMINARY' WHEN direct IS NOT NULL THEN 'MAIN_DRAW' ELSE 'UNKNOWN' END AS st,
        CASE WHEN gp BETWEEN 1 AND 16 THEN 'G' || gp WHEN rnd IS NOT NULL THEN 'R' || rnd WHEN direct IS NOT NULL THEN direct ELSE 'UNKNOWN' END AS rc,
        nullif(regexp_extract(hay, '(?i)Round of\\s+(\\d+)', 1), '') AS ro, try_cast(nullif(regexp_extract(hay, '(?i)Group\\s+(\\d+)', 1), '') AS INTEGER) AS gr FROM h)
    SELECT k AS event_id, st AS schedule_stage, rc AS schedule_round, CASE WHEN gp BETWEEN 1 AND 16 THEN c[1:4] END AS schedule_group,
      CASE WHEN c IN ('FNL-', 'SFNL', 'QFNL', '8FNL', 'R64-') THEN 'MAIN_DRAW' WHEN c IN ('RND1', 'RND2', 'RND3') THEN 'PRELIMINARY' WHEN gp IS NOT NULL THEN 'MAIN_STAGE1' END AS bracket_stage,
      CASE c WHEN 'FNL-' THEN 'F' WHEN 'SFNL' THEN 'SF' WHEN 'QFNL' THEN 'QF' WHEN '8FNL' THEN 'R16' WHEN 'R64-' THEN 'R64' WHEN 'RND1' THEN 'R1' ELSE nullif(c, '') END AS bracket_round,
      (CASE c WHEN 'FNL-' THEN 80 WHEN 'SFNL' THEN 60 WHEN 'QFNL' THEN 50 WHEN '8FNL' THEN 40 WHEN 'R64-' THEN 20 WHEN 'RND1' THEN 10 WHEN 'RND2' THEN 20 WHEN 'RND3' THEN 30 ELSE gp + 100 END)::INTEGER AS bracket_order,
      CASE WHEN cat LIKE '%group %' OR regexp_matches(cat, 'qualifying round\\s+\\d+') OR cat LIKE '%preliminary round%' THEN 'PRELIMINARY' WHEN regexp_matches(cat, 'round of (256|128|64|32|16)|quarter-?final|semi-?final|final') THEN 'MAIN_DRAW' END AS category_stage,
      CASE WHEN cat LIKE '%group %' THEN 'G' || regexp_extract(cat, 'group\\s+(\\d+)', 1)::INTEGER WHEN regexp_matches(cat, 'qualifying round\\s+\\d+') THEN 'R' || regexp_extract(cat, 'qualifying round\\s+(\\d+)', 1)::INTEGER WHEN cat LIKE '%preliminary round%' THEN 'R1'
        WHEN regexp_matches(cat, 'round of (256|128|64|32|16)') THEN 'R' || regexp_extract(cat, 'round of (\\d+)', 1) WHEN regexp_matches(cat, 'quarter-?final') THEN 'QF' WHEN regexp_matches(cat, 'semi-?final') THEN 'SF' WHEN cat LIKE '%final%' THEN 'F' END AS category_round,
      CASE WHEN st <> 'UNKNOWN' THEN rc WHEN ro IS NOT NULL THEN 'R' || ro::INTEGER WHEN gr IS NOT NULL THEN 'G' || gr WHEN hay ILIKE '%preliminary round%' THEN 'R1' ELSE 'UNKNOWN' END AS live_round,
      CASE WHEN t ILIKE '%preliminary round%' THEN 'RND1' WHEN t ILIKE '%quarterfinal%' THEN 'QFNL' WHEN t ILIKE '%semifinal%' THEN 'SFNL' WHEN regexp_matches(t, '(?i)\\bfinal\\b') THEN 'FNL'
        WHEN regexp_matches(t, '(?i)round of\\s+(16|32|64|128)\\b') THEN map {{'16': '8FNL', '32': 'R32-', '64': 'R64-', '128': 'R128'}}[regexp_extract(t, '(?i)round of\\s+(\\d+)', 1)] WHEN regexp_matches(t, '(?i)group\\s+\\d+') THEN 'GP' || lpad(regexp_extract(t, '(?i)group\\s+(\\d+)', 1)::INTEGER::VARCHAR, 2, '0') END AS feed_code,
      CASE WHEN lower(t) LIKE 'women''s teams%' THEN 'WT' WHEN lower(t) LIKE 'men''s singles%' THEN 'MS' WHEN lower(t) LIKE 'mixed doubles%' THEN 'XD' END AS discipline,
      (CASE WHEN regexp_matches(lower(s), 'main draw|正赛') THEN 0 WHEN regexp_matches(lower(s), 'position|排位赛') THEN 1 WHEN lower(s) LIKE '%qualification%' THEN 2 ELSE 3 END * 100
        + coalesce(try_cast(nullif(regexp_extract(s, 'Division (\\d+)', 1), '') AS INTEGER), CASE WHEN s LIKE '%第二级别%' THEN 2 END, 99))::INTEGER AS stage_order,
      CASE WHEN lower(s) LIKE '%groups%' THEN 'Groups' ELSE trim(s) END AS stage_name,
      CASE WHEN regexp_matches(w, '(?i)\\bR\\d{{1,3}}\\b') THEN upper(regexp_extract(w, '(?i)\\b(R\\d{{1,3}})\\b', 1)) ELSE coalesce(nullif(regexp_extract(w, '(?i)\\b(QF|SF|F|QuarterFinal|SemiFinal|Final)\\b', 1), ''), nullif(regexp_extract(w, '(?i)\\bRound\\s+of\\s+\\d+\\b'), ''),
        nullif(regexp_extract(w, '(?i)\\bRd\\s+\\d+\\b'), ''), nullif(regexp_extract(w, '(?i)\\bGroup\\s+[A-Z]\\b'), ''), regexp_extract(w, '(?i)\\b(Preliminary|Prelim|Repechage)\\b', 1)) END AS raw_round,
      CASE WHEN c IN ('F', 'SF', 'QF') THEN NULL WHEN regexp_matches(c, '^(R|QR)\\d+$') THEN c ELSE t END AS history,
      CASE WHEN doc LIKE 'TTEMTEAM%' THEN 'MTEAM' WHEN doc LIKE 'TTEWTEAM%' THEN 'WTEAM' END AS team_class, coalesce(regexp_matches(upper(trim(code)), '^XT$|[MW]T$'), false) AS team_event,
      CASE WHEN lower(games) LIKE '%asian games%' AND lower(games) NOT LIKE '%asian para games%' THEN 'Continental Games' ELSE 'x' END AS kind
    FROM i, LATERAL (SELECT {_sql(DOCUMENTS, 'k')} AS doc, {_sql(TEAM_CODES, 'k')} AS code, {_sql(GAMES_NAMES, 'k')} AS games)""")
def round_rules(spark, sf_dir):
    """Round codes of schedules, brackets, categories, feeds and raw rows; disciplines, stage order and event kinds."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    fill = lambda c: F.replace(F.replace(c, F.lit("{g}"), F.lpad((k % 20 + 1).cast("string"), 2, "0")), F.lit("{r}"), (k % 4 + 1).cast("string"))
    rows = e.select(k, fill(_pick(CODES, k)).alias("c"), fill(_pick(CATEGORIES, k)).alias("cat"), fill(_pick(TEXTS, F.floor(k / 3))).alias("t"), fill(_pick(STAGES, k)).alias("s"), fill(F.concat_ws(" | ", _pick(RAWS, k), _pick(RAWS, F.floor(k / 11)))).alias("w"))
    c, t = F.col("c"), F.col("t")
    schedule, bracket, category = G.schedule_round(c), G.bracket_round(c), G.category_round(F.col("cat"))
    document, code = _pick(DOCUMENTS, k), _pick(TEAM_CODES, k)
    return rows.select(
        "event_id", schedule["stage_code"].alias("schedule_stage"), schedule["round_code"].alias("schedule_round"), schedule["group_code"].alias("schedule_group"),
        bracket["stage_code"].alias("bracket_stage"), bracket["round_code"].alias("bracket_round"), bracket["round_order"].alias("bracket_order"), category["stage_code"].alias("category_stage"), category["round_code"].alias("category_round"),
        G.live_round(c, t)["round_code"].alias("live_round"), G.described_round(t).alias("feed_code"), G.discipline(F.lit(None).cast("string"), t).alias("discipline"), G.stage_priority(F.lit(""), F.col("s")).alias("stage_order"),
        G.stage_label(F.col("s")).alias("stage_name"), G.raw_round(F.col("w")).alias("raw_round"), G.historical_label(c, t).alias("history"),
        G.team_class(document).alias("team_class"), F.coalesce(G.is_team_discipline(code), F.lit(False)).alias("team_event"), G.continental_override(_pick(GAMES_NAMES, k), F.lit("x")).alias("kind"),
    )
