"""Prefix scans over keys of any size: a key that holds very many rows is cut into ranges of its order, so that no key sorts in one task.

Only keys above a share of the rows are cut, at places taken from the data; for all others there is one range and no further step. A
scan is then a window within each range, one summary row for each range, a window over those, and what it carries joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.sources.shared import stored

#: Rows that a key may hold in one task at least; ranges of a key that holds more are a square of this many.
LEAST, SIDE = 10_000, 16


class Ranged:
    """Rows with ``_r``, the number of their range within the key; ``keys`` are those to partition by, without it."""

    def __init__(self, rows: DataFrame, keys: list[str], split: bool):
        self.rows, self.keys, self.split = rows, keys, split

    def window(self, *order):
        return W.partitionBy(*self.keys, "_r").orderBy(*order)

    def _summed(self, rows: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        out = rows.groupBy(*self.keys, "_r").agg(*[c.alias(n) for n, c in summary.items()])
        for name, c in carry.items():
            out = out.withColumn(name, c)
        return out

    def carried(self, rows: DataFrame, summary: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
        """``rows`` with what earlier or later ranges of their key carry into their own: ``carry`` is over the summaries of a key's ranges.

        Without a key that is cut the carried columns are null.
        """
        if not self.split:
            kinds = dict(self._summed(rows.limit(0), summary, carry).dtypes)
            return rows.withColumns({n: F.lit(None).cast(kinds[n]) for n in carry})
        each = self._summed(rows.where("_cut"), summary, carry)
        right = each.select(*[F.col(k).alias(f"_{i}k") for i, k in enumerate(self.keys)], F.col("_r").alias("_rr"), *carry)
        same = [F.col(k).eqNullSafe(F.col(f"_{i}k")) for i, k in enumerate(self.keys)]
        return rows.join(right, [F.col("_r") == F.col("_rr"), *same], "left").drop("_rr", *[f"_{i}k" for i in range(len(self.keys))])

    def before(self):
        """Window over the ranges of a key up to the one before."""
        return W.partitionBy(*self.keys).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)

    def behind(self):
        return W.partitionBy(*self.keys).orderBy("_r").rowsBetween(1, W.unboundedFollowing)


def ranged(df: DataFrame, keys: list[str], at: str) -> Ranged:
    """Cut the keys that hold more than LEAST rows and more than half a partition's share, by quantiles of ``at``.

    ``at`` is a number, date or timestamp; rows with one value of it stay in one range, nulls come first. Null keys are keys like others.
    Counts and quantiles are taken before the shuffle; the cuts are one row for each such key, of which there are at most twice as many
    as partitions.
    """
    keys = list(keys) or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, top = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(LEAST, (total or 0) // (2 * parts))
    if top is None or top <= limit:
        return Ranged(df.withColumns({"_r": F.lit(0), "_cut": F.lit(False)}), keys, False)
    named = [F.col(k).alias(f"_{i}k") for i, k in enumerate(keys)]
    same = [F.col(k).eqNullSafe(F.col(f"_{i}k")) for i, k in enumerate(keys)]
    hot = counts.where(F.col("_n") > limit).select(*named)
    quantiles = F.percentile_approx(at, [i / SIDE**2 for i in range(1, SIDE**2)], 10_000)
    held = df.select(*keys, at).join(F.broadcast(hot), same, "left_semi").groupBy(*keys).agg(quantiles.alias("q"))
    # two levels of cuts, so that a row is compared with twice a side of them
    coarse = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda i: F.get(F.col("q"), i * SIDE - 1))
    fine = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.slice(F.col("q"), i * SIDE + 1, SIDE - 1))
    cuts = stored(held.select(*named, coarse.alias("_coarse"), fine.alias("_fine")), "cuts")
    passed = lambda cs: F.size(F.filter(cs, lambda c: F.col(at) >= c))
    j = passed(F.col("_coarse"))
    number = F.when(F.col("_coarse").isNull(), 0).otherwise(j * SIDE + passed(F.get(F.col("_fine"), j)))
    out = df.join(F.broadcast(cuts), same, "left").withColumns({"_r": number, "_cut": F.col("_coarse").isNotNull()})
    return Ranged(out.drop("_coarse", "_fine", *[f"_{i}k" for i in range(len(keys))]), keys, True)
