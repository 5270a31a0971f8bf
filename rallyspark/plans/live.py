"""Registered queries: merges, live data, time zones and streams over the driver's tables (see ``joins`` for what they stand for)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.functions.dates import display_status
from rallyspark.functions.scores import completeness, status_priority, tie_score, winner_of
from rallyspark.functions.text import player_token
from rallyspark.operators import merge as M
from rallyspark.operators import quality as Q
from rallyspark.operators import relational as R
from rallyspark.plans.common import Registry, read
from rallyspark.streaming import live as S

registry = Registry()
add = registry.add


@add("""
    WITH official AS (SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1), live AS (SELECT user_id, max_by(event_id, ts) AS event_id FROM events WHERE event_type = 'error' GROUP BY 1)
    SELECT coalesce(o.user_id, l.user_id) AS user_id, coalesce(o.event_id, l.event_id) AS event_id, CASE WHEN o.user_id IS NULL THEN 'live' ELSE 'official' END AS source
    FROM official o FULL JOIN (SELECT * FROM live) l ON o.user_id = l.user_id""")
def official_overrides_live(spark, sf_dir):
    """Latest official row of each key, else the latest live one."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    of = lambda kind, name: events.where(F.col("event_type") == kind).withColumn("source", F.lit(name))
    return R.overlay("user_id", of("purchase", "official"), of("error", "live"), order="ts").select("user_id", "event_id", "source")


@add("""
    SELECT user_id, event_type, max_by(event_id, (date_trunc('day', ts), event_id)) AS event_id, max_by(value, (date_trunc('day', ts), event_id)) AS value FROM events GROUP BY 1, 2""")
def newest_wrapper_wins(spark, sf_dir):
    """Row of each key from the newest wrapper (a day), the later position at equal times."""
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", F.date_trunc("day", F.col("ts")).alias("day"))
    return M.newest_wrapper(rows, ["user_id", "event_type"], F.col("day"), "event_id").select("user_id", "event_type", "event_id", "value")


@add("""
    WITH o AS (SELECT o_custkey, max(o_orderkey) AS k, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1),
    n AS (SELECT o_custkey, max(o_orderkey) AS k, max_by(o_orderstatus, o_orderkey) AS status, max_by(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1)
    SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, CASE WHEN o.k IS NOT NULL AND (n.k IS NULL OR o.status = 'F') THEN o.k ELSE n.k END AS k,
      CASE WHEN o.k IS NOT NULL AND (n.k IS NULL OR o.status = 'F') THEN o.status ELSE n.status END AS status,
      CASE WHEN o.k IS NULL THEN n.price WHEN n.k IS NULL OR o.status = 'F' THEN o.price ELSE least(o.price, n.price) END AS price
    FROM o FULL JOIN n ON o.o_custkey = n.o_custkey""")
def upsert_merge(spark, sf_dir):
    """One half of the orders over the other: finished rows do not change, of prices the lesser stays."""
    last = lambda rest: M.latest_incoming(read(spark, sf_dir, "orders").where(f"o_orderkey % 2 = {rest}").select("o_custkey", F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")), "o_custkey", "k")
    return M.upsert(last(0), last(1), "o_custkey", {"price": F.least("o.price", "n.price")}, when=F.col("o.status") != "F")


@add("""
    WITH o AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), n AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1)
    SELECT * FROM o UNION ALL SELECT * FROM n WHERE o_custkey NOT IN (SELECT o_custkey FROM o)""")
def insert_or_ignore(spark, sf_dir):
    """Rows whose key is new are added, of several the first."""
    rows = read(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    return M.insert_or_ignore(R.top_row(rows.where("k % 3 = 0"), "o_custkey", F.struct("k"), largest=False), rows.where("k % 3 <> 0"), "o_custkey", "k")


@add("""
    WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name, ['scheduled', 'live', 'completed', 'cancelled'][c_custkey % 4 + 1] AS status FROM customer),
    n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, ['live', 'scheduled', 'walkover', 'live', 'cancelled'][s_suppkey % 5 + 1] AS status FROM supplier),
    p AS (SELECT o.k, o.name AS oname, n.name AS nname, o.status AS os, n.status AS ns, n.k IS NOT NULL AS hit FROM o LEFT JOIN n ON n.k = o.k)
    SELECT k, CASE WHEN hit THEN coalesce(nname, oname) ELSE oname END AS name, CASE WHEN hit AND
      (CASE ns WHEN 'completed' THEN 40 WHEN 'walkover' THEN 40 WHEN 'live' THEN 30 WHEN 'scheduled' THEN 20 ELSE 10 END) >= (CASE os WHEN 'completed' THEN 40 WHEN 'walkover' THEN 40 WHEN 'live' THEN 30 WHEN 'scheduled' THEN 20 ELSE 10 END)
      THEN ns ELSE os END AS status FROM p""")
def coalesce_patch(spark, sf_dir):
    """Null fields keep the old value, and a status never falls."""
    pick = lambda key, names: F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), pick("c_custkey", ["scheduled", "live", "completed", "cancelled"]).alias("status"))
    new = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), pick("s_suppkey", ["live", "scheduled", "walkover", "live", "cancelled"]).alias("status"))
    return M.upsert(old, new, "k", M.patch(["name"]) | M.monotone_status())


@add("""
    WITH r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 40 WHEN 'click' THEN 30 WHEN 'view' THEN 20 ELSE 0 END AS p, (CASE WHEN value > 50 THEN 100 ELSE 0 END) + (event_id % 3) * 5 AS c FROM events)
    SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p DESC, c DESC, ts DESC, event_id) AS n FROM r) WHERE n = 1""")
def best_record(spark, sf_dir):
    """One row for each code by priority, completeness, newest time and arrival."""
    kinds = {"purchase": "completed", "click": "live", "view": "scheduled", "error": "other", "signup": "other"}
    rows = read(spark, sf_dir, "events").withColumn("status", F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")))
    full = completeness(F.when(F.col("value") > 50, "3-0"), F.lit(0), F.col("event_id") % 3, F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string"))
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return M.best_record(rows.withColumn("code", F.col("user_id").cast("string")), "code", status_priority(F.col("status")), full, stamp, "event_id").select("user_id", "event_id")


@add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_field_extract(spark, sf_dir):
    """Fields of a JSON text by schema; what is not there is null."""
    p = F.from_json("props", "struct<k:bigint,missing:string>")
    return read(spark, sf_dir, "events").select("event_id", p["k"].alias("k"), p["missing"].alias("missing"))


@add("""
    WITH t AS (SELECT p_partkey, (p_size % 5) || ' - ' || (p_partkey % 4) || CASE WHEN p_partkey % 7 = 0 THEN ' (11-9)' ELSE '' END AS raw FROM part)
    SELECT p_partkey, raw, regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 1)::INTEGER AS a, regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 2)::INTEGER AS b,
      CASE WHEN regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 1)::INTEGER > regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 2)::INTEGER THEN 'A' WHEN regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 1)::INTEGER < regexp_extract(raw, '(\\d+)\\s*-\\s*(\\d+)', 2)::INTEGER THEN 'B' END AS winner FROM t""")
def score_regex_parse(spark, sf_dir):
    """Scores and winners from texts."""
    raw = F.concat(F.concat_ws(" - ", (F.col("p_size") % 5).cast("string"), (F.col("p_partkey") % 4).cast("string")), F.when(F.col("p_partkey") % 7 == 0, " (11-9)").otherwise(""))
    rows = read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("s", tie_score(F.col("raw")))
    return rows.select("p_partkey", "raw", F.col("s.a").alias("a"), F.col("s.b").alias("b"), winner_of(F.col("s")).alias("winner"))


@add("""
    SELECT c_custkey, regexp_extract(c_name || ' (N' || c_nationkey || ')', '^(.+?)\\s*\\((\\w+)\\)$', 1) AS name, regexp_extract(c_name || ' (N' || c_nationkey || ')', '^(.+?)\\s*\\((\\w+)\\)$', 2) AS country FROM customer""")
def player_tokens(spark, sf_dir):
    """Name and country of texts like NAME (CC)."""
    t = player_token(F.concat(F.col("c_name"), F.lit(" (N"), F.col("c_nationkey").cast("string"), F.lit(")")))
    return read(spark, sf_dir, "customer").select("c_custkey", t["name"].alias("name"), t["country"].alias("country"))


@add("""
    SELECT strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def tz_rebucket(spark, sf_dir):
    """Events by day of a reference zone."""
    day = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Shanghai"), F.col("ts")), "yyyy-MM-dd")
    return read(spark, sf_dir, "events").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@add("""
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN DATE '1998-06-01' < o_orderdate::DATE THEN 'upcoming' WHEN DATE '1998-06-01' > (o_orderdate + INTERVAL 90 DAY)::DATE THEN 'finished_pending_promotion' ELSE 'in_progress' END AS status FROM orders""")
def event_display_status(spark, sf_dir):
    """Display status of spans on a fixed day of the event's zone."""
    start = F.to_date("o_orderdate")
    lifecycle = F.when(F.col("o_orderstatus") == "F", "completed").otherwise("upcoming")
    status = display_status(lifecycle, start, F.date_add(start, 90), F.lit("UTC"), F.lit("1998-06-01 12:00:00").cast("timestamp"))
    return read(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"))


@add("""
    WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'balance' END AS r FROM customer UNION ALL SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'segment' END FROM customer)
    SELECT r AS reason, count(*)::BIGINT AS n, array_to_string(list_slice(list(c_custkey ORDER BY c_custkey), 1, 20), ',') AS examples FROM b WHERE r IS NOT NULL GROUP BY 1""")
def rejects_with_examples(spark, sf_dir):
    """Rows that break rules: counts by rule and the first 20 keys."""
    rows = Q.with_reasons(read(spark, sf_dir, "customer"), balance=F.col("c_acctbal") >= 0, segment=F.col("c_mktsegment") != "MACHINERY")
    out = Q.rejects(rows, "c_custkey", 20)
    return out.select("reason", "n", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


def _stream(spark, sf_dir):
    return S.files(spark, f"{sf_dir}/event[s].parquet", read(spark, sf_dir, "events").schema, time="ts")


@add("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY 1, 2""")
def tumbling_window(spark, sf_dir):
    """Events of six-hour windows by type."""
    out = S.tumbling(read(spark, sf_dir, "events"), "ts", "6 hours", ["event_type"], n=F.count(F.lit(1)), users=F.count_distinct("user_id"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("""
    SELECT (time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h::INTEGER))::TIMESTAMP AS window_start, count(*)::BIGINT AS n FROM events, range(0, 3) t(h) GROUP BY 1""")
def sliding_window(spark, sf_dir):
    """Events of three-hour windows that open every hour."""
    return S.tumbling(read(spark, sf_dir, "events"), "ts", "3 hours", [], slide="1 hour", n=F.count(F.lit(1))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("""
    WITH g AS (SELECT *, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*)::BIGINT AS n FROM r GROUP BY user_id, k""")
def session_window(spark, sf_dir):
    """Sessions of each user with pauses of less than half an hour."""
    out = S.sessions(read(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@add("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    """Daily counts by a stream over the event files."""
    out = S.run(S.tumbling(_stream(spark, sf_dir), "ts", "1 day", ["event_type"], n=F.count(F.lit(1))), mode="complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@add("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, sf_dir):
    """First row of each user and type, kept by a stream within a watermark of a year."""
    return S.run(S.once(_stream(spark, sf_dir), "ts", ["user_id", "event_type"], "365 days"), S.append, "append").select("user_id", "event_type")


@add("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def stream_live_upsert(spark, sf_dir):
    """Newest row of each key, merged batch by batch."""
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "ts")
    out = S.run(rows, S.latest_by(["user_id"], ["ts", "event_id"], F.col("n.ts") >= F.col("o.ts")), "append")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@add("""
    WITH RECURSIVE t AS (SELECT DISTINCT user_id, epoch_ms(ts) AS ms FROM events), n AS MATERIALIZED (SELECT t.user_id, t.ms, x.ms AS later FROM t ASOF LEFT JOIN t x ON x.user_id = t.user_id AND x.ms >= t.ms + 3600000),
    w AS (SELECT user_id, min(ms) AS opens FROM t GROUP BY 1 UNION ALL SELECT w.user_id, later FROM w JOIN n ON n.user_id = w.user_id AND n.ms = w.opens WHERE later IS NOT NULL),
    c AS (SELECT e.user_id, w.opens, count(*) AS n FROM events e ASOF JOIN w ON w.user_id = e.user_id AND w.opens <= epoch_ms(e.ts) GROUP BY 1, 2)
    SELECT user_id, sum(n)::BIGINT AS requests, sum(least(n, 3))::BIGINT AS allowed FROM c GROUP BY 1""")
def stream_rate_limit(spark, sf_dir):
    """Requests of each user that pass a limit of three in an hour that opens with the first request; a watermark of ten years drops none."""
    with S.timed_state(spark):
        out = S.run(S.limiter(_stream(spark, sf_dir), "user_id", "ts", 3_600_000, 3, "3650 days"), S.append, "update")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("requests"), F.count_if("allowed").alias("allowed"))
