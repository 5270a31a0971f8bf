"""Shards by a hierarchical weighted hash tree.

A key descends region, rack and shard levels, at each to the child with the least draw. A shard draws ``-ln(u) / weight`` with ``u`` a
hash of the key and the shard's place; a rack or region draws the least of what it holds, which is distributed as one weighted draw with
the sum of its weights. So a child gets rows in proportion to its weight, a weight that changes moves rows only into or out of the
subtrees that hold it, and a shard that is added anywhere takes rows only into itself. There is one tree for each number of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.llm.common import store

Tree = list[list[list[float]]]

#: Slots are numbered in parts of each shard, so that no shard's numbering meets in one task: at least so many, and of about so many rows.
PARTS, PART_ROWS = 64, 250_000


def balanced_tree(shards: int, per_rack: int = 5, racks: int = 4) -> Tree:
    """Regions of racks of shard weights: racks and regions are filled in order, all weights are 1."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    tree: Tree = []
    for s in range(shards):
        if s % (per_rack * racks) == 0:
            tree.append([])
        if s % per_rack == 0:
            tree[-1].append([])
        tree[-1][-1].append(1.0)
    return tree


def _least(draws: list[Column]) -> Column:
    return draws[0] if len(draws) == 1 else F.least(*draws)


def _leaf(key: Column, region: int, rack: int, at: int, shard: int, weight: float) -> Column:
    """A shard's draw for a key, with its place in the tree."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(region), F.lit(rack), F.lit(at)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.struct((-F.ln(u) / F.lit(weight)).alias("draw"), F.lit(region).alias("region"), F.lit(rack).alias("rack"), F.lit(shard).alias("shard"))


def place(df: DataFrame, key: str, tree: Tree, prefix: str = "") -> DataFrame:
    """Add ``{prefix}region``, ``{prefix}rack`` (within the region) and ``{prefix}shard`` (over the whole tree).

    A null key is a key like any other; equal keys share a shard. The tree is a parameter of a few hundred weights; a weight of 0 takes
    no rows.
    """
    regions, n = [], 0
    for r, racks in enumerate(tree):
        rack_draws = []
        for k, weights in enumerate(racks):
            leaves = [_leaf(F.col(key), r, k, i, n + i, w) for i, w in enumerate(weights) if w > 0]
            n += len(weights)
            if leaves:
                rack_draws.append(_least(leaves))
        if rack_draws:
            regions.append(_least(rack_draws))
    at = f"{prefix}at"
    return df.withColumn(at, _least(regions)).withColumns({f"{prefix}{c}": F.col(f"{at}.{c}") for c in ("region", "rack", "shard")}).drop(at)


def slots(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``slot``, gapless from 0 in each group, by counting parts first; ``df`` must be stored (it is read twice).

    Rows are dealt to parts by a hash of their whole content and their place in the stored table, so copies spread too.
    """
    parts = df.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # one row for each part of each group, a 250 000th of the input at most: the planner broadcasts them where they are small
    offsets = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(W.partitionBy(group, "part").orderBy(*order))
    return df.withColumn("rank", rank).join(offsets, [group, "part"]).withColumn("slot", (F.col("before") + F.col("rank") - 1).cast("long")).drop("rank", "before", "part")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Size, checksum, place now and place with one more shard, and a gapless slot, for every row.

    Null text: size 16, checksum 0. Rows with one doc_id (or a null one) share a shard; repeated rows get a slot each.
    ``grown_shard`` is the shard that ``shards + 1`` shards give: rows move into the added one only. Empty table: no rows. Only doc_id and text are read; text never leaves its task.
    """
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    rows = place(place(rows, "doc_id", balanced_tree(shards)), "doc_id", balanced_tree(shards + 1), "grown_")
    placed = store(rows.withColumn("h", F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id())), "shards")
    parts = max(PARTS, -(-placed.count() // (shards * PART_ROWS)))
    return slots(placed.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).drop("h"), "shard", "doc_id", "text_crc32", "size")
