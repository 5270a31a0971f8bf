"""Preference formatting: the common turns of two conversations once as prompt, the rest as two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED = "assistant"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def _trained(turns: Column) -> Column:
    """start:end of the trained role's texts within the rendered completion (code points, end exclusive), comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.char_length(_head(t))
        end = begin + F.char_length(t["text"])
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: F.array_join(acc["spans"], ","))


def pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k and 2k+1 as pair k; the one with more characters in trained turns is chosen, the smaller id on a tie.

    Rows with a null conv_id belong to no conversation. A null turn number sorts first, null roles and texts are empty, and of rows
    with one conversation and turn number the least (role, text) counts. A conversation without its partner gives no pair. Group
    and array are one conversation pair, the size of the row that is returned.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.pmod("conv_id", F.lit(2)).cast("int").alias("side"),
        F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    once = clean.groupBy("pair_id", "side", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    listed = once.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "side", F.col("said.role").alias("role"), F.col("said.text").alias("text")))).alias("turns"))
    side = lambda i: F.transform(F.filter("turns", lambda t: t["side"] == i), lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text")))
    both = listed.select("pair_id", side(0).alias("even"), side(1).alias("odd")).where((F.size("even") > 0) & (F.size("odd") > 0))
    weight = lambda c: F.aggregate(c, F.lit(0), lambda s, t: s + F.when(t["role"] == TRAINED, F.char_length(t["text"])).otherwise(0))
    first = weight("even") >= weight("odd")
    return both.select(
        "pair_id", (F.col("pair_id") * 2 + F.when(first, 0).otherwise(1)).alias("chosen_id"), (F.col("pair_id") * 2 + F.when(first, 1).otherwise(0)).alias("rejected_id"),
        F.when(first, F.col("even")).otherwise(F.col("odd")).alias("chosen_turns"), F.when(first, F.col("odd")).otherwise(F.col("even")).alias("rejected_turns"),
    )


def format_pairs(paired: DataFrame) -> DataFrame:
    """One row for each pair: prompt of the longest common turn prefix, both completions and the spans that are trained."""
    shorter = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    same = lambda i: F.get("chosen_turns", i) == F.get("rejected_turns", i)
    common = F.aggregate(F.sequence(F.lit(0), shorter - 1), F.lit(0), lambda n, i: F.when((n == i) & same(i), n + 1).otherwise(n))
    out = paired.withColumn("prompt_turns", common)
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.size(c))
    return out.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), _render(F.slice("chosen_turns", 1, F.col("prompt_turns"))).alias("prompt"),
        _render(rest("chosen_turns")).alias("chosen"), _trained(rest("chosen_turns")).alias("chosen_trained"),
        _render(rest("rejected_turns")).alias("rejected"), _trained(rest("rejected_turns")).alias("rejected_trained"),
    )


ORACLE = """
WITH once AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, min({'role': coalesce(role, ''), 'text': coalesce(text, '')}) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
turns AS (SELECT conv_id // 2 AS pair_id, conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, turn, said.role AS role, said.text AS text,
  '<|' || said.role || '|>' || chr(10) AS head FROM once),
weights AS (SELECT pair_id, conv_id, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS w, count(*) AS n FROM turns GROUP BY 1, 2),
picked AS (
  SELECT a.pair_id, CASE WHEN a.w >= b.w THEN a.conv_id ELSE b.conv_id END AS chosen_id, CASE WHEN a.w >= b.w THEN b.conv_id ELSE a.conv_id END AS rejected_id
  FROM weights a JOIN weights b ON a.pair_id = b.pair_id AND a.conv_id % 2 = 0 AND b.conv_id % 2 = 1),
split AS (
  SELECT p.*, least(coalesce((SELECT min(t.pos) FROM turns t JOIN turns u ON u.pos = t.pos AND u.conv_id = p.rejected_id
      WHERE t.conv_id = p.chosen_id AND (t.turn, t.role, t.text) <> (u.turn, u.role, u.text)), 1 << 30),
    1 + least((SELECT n FROM weights w WHERE w.conv_id = p.chosen_id), (SELECT n FROM weights w WHERE w.conv_id = p.rejected_id))) - 1 AS prompt_turns
  FROM picked p),
parts AS (
  SELECT s.pair_id, CASE WHEN t.pos <= s.prompt_turns THEN 'p' WHEN t.conv_id = s.chosen_id THEN 'c' ELSE 'r' END AS part, t.*  EXCLUDE (pair_id)
  FROM split s JOIN turns t ON t.conv_id = s.chosen_id OR (t.conv_id = s.rejected_id AND t.pos > s.prompt_turns)),
placed AS (
  SELECT *, head || text || chr(10) AS line,
    coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY pair_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at FROM parts),
joined AS (
  SELECT pair_id, part, string_agg(line, '' ORDER BY pos) AS body,
    coalesce(string_agg(begin_at::BIGINT || ':' || (begin_at + length(text))::BIGINT, ',' ORDER BY pos) FILTER (role = 'assistant'), '') AS trained FROM placed GROUP BY 1, 2)
SELECT s.pair_id, s.chosen_id, s.rejected_id, s.prompt_turns::BIGINT AS prompt_turns, coalesce(p.body, '') AS prompt,
  coalesce(c.body, '') AS chosen, coalesce(c.trained, '') AS chosen_trained, coalesce(r.body, '') AS rejected, coalesce(r.trained, '') AS rejected_trained
FROM split s LEFT JOIN joined p ON p.pair_id = s.pair_id AND p.part = 'p' LEFT JOIN joined c ON c.pair_id = s.pair_id AND c.part = 'c'
LEFT JOIN joined r ON r.pair_id = s.pair_id AND r.part = 'r'
"""
