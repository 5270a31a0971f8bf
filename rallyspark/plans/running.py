"""Registered queries: running ties found without their code and merged where they stand twice (see ``joins`` for the tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyspark.operators import running
from rallyspark.plans.common import Registry, read
from rallyspark.sources.shared import stored

registry = Registry()
add = registry.add

#: One message after the other over a list of open ties: the recursion goes through the messages of every event and discipline in step.
_STEPS = """
    m AS (
      SELECT event_id AS seq, user_id AS event_id, CASE WHEN event_id % 2 = 0 THEN 'MT' ELSE 'WT' END AS sub,
        CASE WHEN event_id % 4 = 1 THEN 'C' || event_id // 8 % 6 WHEN event_id % 11 = 0 THEN ' ' END AS given,
        CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'T' || (event_id // 5 % 3 + 1) ELSE 'T' || event_id // 5 % 3 END AS t1,
        CASE WHEN event_id % 3 = 0 THEN 'T' || event_id // 5 % 3 ELSE 'T' || (event_id // 5 % 3 + 1) END AS t2,
        CASE WHEN event_id // 3 % 2 = 0 THEN 'KO' ELSE 'UNKNOWN' END AS stage, CASE WHEN event_id // 3 % 2 = 0 THEN 'R' || event_id // 9 % 2 ELSE 'UNKNOWN' END AS rnd,
        CASE WHEN event_id % 5 > 1 THEN 'T0' || event_id // 7 % 3 END AS tbl, CASE WHEN event_id % 7 > 2 THEN 'Match ' || event_id // 11 % 4 WHEN event_id % 7 = 1 THEN 'Evening' END AS sess,
        CASE event_type WHEN 'view' THEN 'scheduled' WHEN 'purchase' THEN 'completed' ELSE 'live' END AS status,
        CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'Official' ELSE 'Live' END AS source, event_id % 4 || '-' || event_id % 3 AS score FROM events),
    k AS (
      SELECT *, row_number() OVER (PARTITION BY event_id, sub ORDER BY seq) AS n, nullif(trim(given), '') IS NOT NULL AS own, status = 'completed' AND coalesce(source, '') = 'Official' AS fin,
        CASE WHEN sess LIKE 'Match %' THEN substr(sess, 7)::INTEGER END AS no,
        coalesce(nullif(trim(given), ''), 'LIVE::' || sub || '::' || rnd || '::' || coalesce(replace(sess, ' ', ''), 'UNKNOWN') || '::' || concat_ws('-', t1, t2)) AS code FROM m),
    s AS (
      SELECT event_id, sub, 0::BIGINT AS n, []::STRUCT(id BIGINT, code VARCHAR, t1 VARCHAR, t2 VARCHAR, stage VARCHAR, rnd VARCHAR, tbl VARCHAR, sess VARCHAR, no INTEGER, status VARCHAR, fin BOOLEAN)[] AS ties,
        NULL::BIGINT AS seq, NULL::BIGINT AS tie, NULL::BIGINT AS gone FROM (SELECT DISTINCT event_id, sub FROM k)
      UNION ALL
      SELECT event_id, sub, n, CASE WHEN cur IS NULL THEN list_append(ties, {'id': seq, 'code': code, 't1': t1, 't2': t2, 'stage': stage, 'rnd': rnd, 'tbl': tbl, 'sess': sess, 'no': no, 'status': status, 'fin': fin})
          WHEN kept THEN ties ELSE list_transform(list_filter(ties, lambda t: gone IS NULL OR t.id <> gone), lambda t: CASE WHEN t.id <> cur THEN t ELSE
            {'id': t.id, 'code': t.code, 't1': coalesce(t1, t.t1), 't2': coalesce(t2, t.t2), 'stage': coalesce(t.stage, stage), 'rnd': coalesce(t.rnd, rnd), 'tbl': coalesce(tbl, t.tbl), 'sess': coalesce(sess, t.sess),
             'no': CASE WHEN sess IS NULL THEN t.no ELSE no END, 'status': status, 'fin': fin} END) END AS ties, seq, coalesce(cur, seq) AS tie, gone
      FROM (SELECT *, CASE WHEN cur IS NOT NULL AND NOT kept AND NOT own AND t1 IS NOT NULL THEN nullif(list_filter(ties, lambda t: t.status = 'live' AND t.code LIKE 'LIVE::%' AND t.rnd = 'UNKNOWN'
              AND coalesce(t.tbl, '') = coalesce(tbl, '') AND coalesce(t.t1, '') = t1 AND t.t2 = t2)[1].id, cur) END AS gone
        FROM (SELECT *, cur IS NOT NULL AND NOT fin AND list_filter(ties, lambda t: t.id = cur)[1].fin AS kept
          FROM (SELECT *, coalesce(coded, CASE WHEN NOT own AND t1 IS NOT NULL THEN list_filter(ties, lambda t: ((coalesce(t.t1, '') = t1 AND t.t2 = t2) OR (coalesce(t.t1, '') = t2 AND t.t2 = t1)) AND t.stage = stage AND t.rnd = rnd
                  AND (coalesce(t.tbl = tbl, false) OR coalesce(t.no = no, false) OR coalesce(t.sess = sess, false)))[1].id END) AS cur
            FROM (SELECT k.*, s.ties, list_filter(s.ties, lambda t: t.code = k.code)[1].id AS coded FROM s JOIN k ON s.event_id = k.event_id AND s.sub = k.sub AND k.n = s.n + 1))))),
    links AS (SELECT s.seq, s.tie, s.gone, k.* EXCLUDE (seq) FROM s JOIN k ON s.seq = k.seq)"""


def _messages(spark, sf_dir):
    """Events as messages of a live feed: some with a code, some with teams in the other order, some without a team, table or session."""
    e = F.col("event_id")
    div = lambda n: F.floor(e / n)
    text = lambda head, n: F.concat(F.lit(head), n.cast("string"))
    team = lambda more: text("T", div(5) % 3 + more)
    unknown = div(3) % 2 != 0
    return read(spark, sf_dir, "events").select(
        e.alias("seq"), F.col("user_id").alias("event_id"), F.when(e % 2 == 0, "MT").otherwise("WT").alias("sub_event_type_code"),
        F.when(e % 4 == 1, text("C", div(8) % 6)).when(e % 11 == 0, " ").alias("external_match_code"),
        F.when(e % 13 == 0, None).when(e % 3 == 0, team(1)).otherwise(team(0)).alias("team1"), F.when(e % 3 == 0, team(0)).otherwise(team(1)).alias("team2"),
        F.when(unknown, "UNKNOWN").otherwise("KO").alias("stage_code"), F.when(unknown, "UNKNOWN").otherwise(text("R", div(9) % 2)).alias("round_code"),
        F.when(e % 5 > 1, text("T0", div(7) % 3)).alias("table_no"), F.when(e % 7 > 2, text("Match ", div(11) % 4)).when(e % 7 == 1, "Evening").alias("session_label"),
        F.when(F.col("event_type") == "view", "scheduled").when(F.col("event_type") == "purchase", "completed").otherwise("live").alias("status"),
        F.when(F.col("event_type") == "error", None).when((F.col("event_type") == "purchase") & (e % 3 == 0), "Official").otherwise("Live").alias("source_status"),
        F.concat((e % 4).cast("string"), F.lit("-"), (e % 3).cast("string")).alias("score"),
    )


@add(f"WITH RECURSIVE {_STEPS} SELECT seq, code, tie, gone AS removes FROM links")
def linked_messages(spark, sf_dir):
    """The running tie of every live message, and the tie that it finds to stand twice."""
    return running.linked(_messages(spark, sf_dir)).select("seq", "code", "tie", "removes")


@add(f"""
    WITH RECURSIVE {_STEPS}, left_ AS (SELECT * FROM links WHERE tie NOT IN (SELECT gone FROM links WHERE gone IS NOT NULL)),
    f AS (SELECT *, coalesce(bool_or(fin) OVER (PARTITION BY tie ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stood FROM left_), a AS (SELECT * FROM f WHERE fin OR NOT stood)
    SELECT event_id, sub AS sub_event_type_code, tie, max_by(status, seq) AS status, max_by(score, seq) AS score, max_by(source, seq) AS source_status, max_by(sess, seq) AS session_label, max_by(tbl, seq) AS table_no,
      max_by(t1, seq) AS team1, max_by(t2, seq) AS team2, min_by(stage, seq) AS stage_code, min_by(rnd, seq) AS round_code, min_by(code, seq) AS code, max_by(fin, seq) AS final, max(seq) AS synced FROM a GROUP BY 1, 2, 3""")
def linked_ties(spark, sf_dir):
    """Ties after all live messages, with or without codes; those that stood twice are gone."""
    return running.running_ties(stored(running.linked(_messages(spark, sf_dir)), "links"))
