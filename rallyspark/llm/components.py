"""Connected components by alternating large and small stars, every step a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyspark.llm.common import discard, store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node joins its larger neighbours to the least node it sees."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select("v", "u"))
    least = store(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
    out = store(both.where("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct(), "stars")
    discard(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins itself and its smaller neighbours to the least of them."""
    least = store(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
    out = store(moved.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct(), "stars")
    discard(least)
    return out


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of ``edges`` (a, b); labels themselves are left out.

    Ends when a round changes nothing; then all edges are stars around the labels. Joins are between stored tables, so a node with
    very many neighbours is split by the skew join.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        wide = _large_star(now)
        after = _small_star(wide)
        discard(wide, now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label"))
