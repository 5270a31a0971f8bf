"""Reusable relational builders. All are lazy plans: nothing is collected and no side is broadcast by force.

Where a rule picks one row, aggregates with a map-side part (``max_by``, ``min_by``) are preferred to windows, so that a key with very
many rows is reduced before it is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.operators.scan import ranged
from rallyspark.sources.shared import stored


def _cols(names: str | list[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


#: Rows that one task sorts or groups where a whole table goes through a shuffle.
DEALT_ROWS = 2_000_000


def parts_of(df: DataFrame, each: int = 1) -> int:
    """Partitions of a shuffle, in number with the rows, or with ``each`` rows for one. Counting those of a plain Parquet table reads its footers only."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() * each // DEALT_ROWS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in hash partitions of ``keys``, so that a task's memory does not grow with the table; joins and groupings on the keys use them."""
    return df.repartition(parts_of(df), *keys)


def top_row(df: DataFrame, keys: str | list[str], order: Column, largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or least) ``order``, a struct that should be unique within a key."""
    keys = _cols(keys)
    pick = F.max_by if largest else F.min_by
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def first_rows(df: DataFrame, keys: str | list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key; Spark limits each group before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*_cols(keys)).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows of one page with ``total`` (of all rows) and ``has_more``; sort and limit become one top-k."""
    limit, offset = max(1, min(limit, 100)), max(0, offset)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)  # one row is broadcast


def clamp(value: int | None, low: int, high: int, default: int) -> int:
    return default if value is None else max(low, min(high, value))


def existing(df: DataFrame, key: str, *sources: tuple[DataFrame, str]) -> DataFrame:
    """Rows whose key is in any of the sources: their distinct keys are joined once, instead of one probe for each source."""
    keys = reduce(DataFrame.union, [s.select(F.col(c).alias(key)) for s, c in sources])
    return df.join(keys.where(F.col(key).isNotNull()).distinct(), key, "left_semi")


def missing(df: DataFrame, other: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows without a partner, keys compared null-safely."""
    pairs = [df[a].eqNullSafe(other[b]) for a, b in on.items()]
    return df.join(other, reduce(Column.__and__, pairs), "left_anti")


def first_nonzero(df: DataFrame, key: str, sources: list[tuple[DataFrame, str]], stored: str | None = None, name: str = "total") -> DataFrame:
    """Add the first count that is not zero over several child tables, else the stored total, else 0."""
    counts = []
    for i, (child, column) in enumerate(sources):
        n = child.groupBy(F.col(column).alias(key)).agg(F.count(F.lit(1)).alias(f"_n{i}"))
        df = df.join(n, key, "left")
        counts.append(F.nullif(F.col(f"_n{i}"), F.lit(0)))
    last = [F.col(stored)] if stored else []
    return df.withColumn(name, F.coalesce(*counts, *last, F.lit(0)).cast("long")).drop(*[f"_n{i}" for i in range(len(sources))])


def symmetric_join(a: DataFrame, b: DataFrame, a_pair: tuple[str, str], b_pair: tuple[str, str], how: str = "inner") -> DataFrame:
    """Join on two columns in either order, as an equi-join on (least, greatest)."""
    left = a.withColumns({"_lo": F.least(*a_pair), "_hi": F.greatest(*a_pair)})
    right = b.withColumns({"_lo": F.least(*b_pair), "_hi": F.greatest(*b_pair)})
    return left.join(right, ["_lo", "_hi"], how).drop("_lo", "_hi")


def opponents(sides: DataFrame, match: str, side: str, player: str, prefix: str = "opp_") -> DataFrame:
    """Every side row with every row of the other sides of its match; those columns get the prefix."""
    other = sides.select(F.col(match), *[F.col(c).alias(prefix + c) for c in sides.columns if c != match])
    return sides.join(other, match).where(F.col(side) != F.col(prefix + side))


def head_to_head(sides: DataFrame, match: str, side: str, player: str, a: int, b: int) -> DataFrame:
    """Meetings of two players: each player's rows are filtered before the join; one row for each pair of sides that met."""
    left = sides.where(F.col(player) == a).select(match, F.col(side).alias("side_a"))
    right = sides.where(F.col(player) == b).select(match, F.col(side).alias("side_b"))
    return left.join(right, match).where(F.col("side_a") != F.col("side_b"))


def joined_distinct(df: DataFrame, keys: str | list[str], value: str, name: str, sep: str = ",") -> DataFrame:
    """Distinct values of each key, sorted and joined; duplicates go before the list is built."""
    return df.groupBy(*_cols(keys)).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(name))


def majority(df: DataFrame, keys: str | list[str], value: str, name: str = "majority", first_seen: str | None = None) -> DataFrame:
    """Most frequent value of each key; a tie goes to the least value, or to the one seen first by the column ``first_seen``.

    Null and blank values have no vote. Votes are counted before they are compared, so a hot key costs a row for each value.
    """
    keys = _cols(keys)
    seen = F.min(first_seen) if first_seen else F.lit(0)
    votes = df.where(F.trim(F.col(value).cast("string")) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_votes"), seen.alias("_seen"))
    order = F.struct(-F.col("_votes"), "_seen", value)
    return votes.groupBy(*keys).agg(F.min_by(value, order).alias(name))


def unique_argmax(df: DataFrame, keys: str | list[str], value: str, score: str, name: str = "winner") -> DataFrame:
    """The value with the largest score of each key, null where two values share it."""
    best = df.groupBy(*_cols(keys)).agg(F.max(F.struct(score, value)).alias("_m"), F.max(score).alias("_top"), F.collect_set(F.struct(score, value)).alias("_all"))
    ties = F.size(F.filter("_all", lambda x: x[score] == F.col("_top")))
    return best.select(*_cols(keys), F.when(ties == 1, F.col(f"_m.{value}")).alias(name))


def set_pairs(df: DataFrame, keys: str | list[str], value: str) -> DataFrame:
    """All two-element combinations of each key's distinct values, first below second. For sets bounded by their meaning."""
    keys = _cols(keys)
    once = df.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    return once.select(*keys, F.col(value).alias("first")).join(once.select(*keys, F.col(value).alias("second")), keys).where(F.col("first") < F.col("second"))


def zero_filled(dim: DataFrame, keys: str | list[str], facts: DataFrame, **measures: Column) -> DataFrame:
    """Every key of ``dim`` with aggregates of ``facts``; keys without facts get zeros."""
    keys = _cols(keys)
    agg = facts.groupBy(*keys).agg(*[m.alias(n) for n, m in measures.items()])
    return dim.join(agg, keys, "left").fillna(0, subset=list(measures))


def overlay(keys: str | list[str], *layers: DataFrame, order: str | None = None) -> DataFrame:
    """One row for each key: from the first layer that has it; within a layer the row with the largest ``order``."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [x.withColumn("_layer", F.lit(-i)) for i, x in enumerate(layers)])
    rank = F.struct("_layer", *([order] if order else []))
    return top_row(rows, keys, rank).drop("_layer")


def first_layer(keys: str | list[str], *layers: DataFrame) -> DataFrame:
    """All rows of the first layer that has any for a key, with ``layer`` from 1; layers have the same columns. Null keys are keys like others."""
    keys = _cols(keys)
    rows = reduce(DataFrame.unionByName, [x.withColumn("layer", F.lit(i)) for i, x in enumerate(layers, 1)])
    best = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min("layer").alias("_layer"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(best, [F.col("layer") == F.col("_layer"), *same], "left_semi")


def filter_unless_empty(df: DataFrame, keys: str | list[str], keep: Column) -> DataFrame:
    """Rows that meet ``keep``; all rows of a key of which none does."""
    keys = _cols(keys)
    marked = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    some = marked.groupBy(*keys).agg(F.bool_or("_keep").alias("_some"))
    return marked.join(some, keys).where(F.col("_keep") | ~F.col("_some")).drop("_keep", "_some")


def waterfall(df: DataFrame, steps: list[tuple[DataFrame, dict[str, str], str]], name: str = "resolved") -> DataFrame:
    """Add the value of the first step that has exactly one candidate, and ``{name}_step`` (from 1; null where none has).

    A step is (table, {own column: table's column}, value column). A key with several distinct values gives none.
    """
    found, at = [], []
    for i, (table, on, value) in enumerate(steps):
        own = list(on)
        keyed = table.select(*[F.col(b).alias(a) for a, b in on.items()], F.col(value).alias("_v")).where(reduce(Column.__and__, [F.col(a).isNotNull() for a in own]))
        single = keyed.groupBy(*own).agg(F.min("_v").alias(f"_v{i}"), F.max("_v").alias("_hi")).where(F.col(f"_v{i}") == F.col("_hi")).drop("_hi")
        df = df.join(single, own, "left")
        found.append(F.col(f"_v{i}"))
        at.append(F.when(F.col(f"_v{i}").isNotNull(), i + 1))
    return df.withColumns({name: F.coalesce(*found), f"{name}_step": F.coalesce(*at)}).drop(*[f"_v{i}" for i in range(len(steps))])


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], days: int = 30, keys: list[str] | None = None) -> DataFrame:
    """Pairs of date spans that overlap (both ends included), by an equi-join on buckets of ``days``.

    A pair is emitted only in the first bucket that both share, so none is lost or repeated.
    """
    bucket = lambda c: F.floor(F.unix_date(F.to_date(c)) / days)
    left = a.withColumn("_b", F.explode(F.sequence(bucket(a_span[0]), bucket(a_span[1]))))
    right = b.withColumn("_b", F.explode(F.sequence(bucket(b_span[0]), bucket(b_span[1]))))
    joined = left.join(right, [*(keys or []), "_b"])
    meets = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(a_span[1]) >= F.col(b_span[0]))
    return joined.where(meets & (F.col("_b") == F.greatest(bucket(a_span[0]), bucket(b_span[0])))).drop("_b")


def months_covered(df: DataFrame, start: str, end: str, name: str = "month", year: str | None = None) -> DataFrame:
    """One row for each month that a span touches; with ``year`` (a column) only months of that year."""
    first, last = F.trunc(start, "month"), F.trunc(end, "month")
    if year:
        low, high = F.make_date(F.col(year), F.lit(1), F.lit(1)), F.make_date(F.col(year), F.lit(12), F.lit(1))
        first, last = F.greatest(first, low), F.least(last, high)
    return df.where(first <= last).withColumn(name, F.explode(F.sequence(first, last, F.expr("interval 1 month"))))


def islands(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers of each key: ``first``, ``last`` and their count."""
    part = ranged(df.select(*keys, number).distinct(), keys, number)
    rows = part.rows.withColumn("_place", F.row_number().over(part.window(number)))
    rows = part.carried(rows, {"_rows": F.count(F.lit(1))}, {"_before": F.sum("_rows").over(part.before())})
    run = F.col(number) - F.col("_place") - F.coalesce("_before", F.lit(0))
    return rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def change_counter(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "segment") -> DataFrame:
    """Add a number from 1 that grows whenever ``value`` differs from the row before it. Orders should be unique within a key."""
    part = ranged(df, keys, order[0])
    w = part.window(*order)
    change = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    rows = part.rows.withColumn("_c", change).withColumn("_s", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    at, over = F.struct(*order), W.partitionBy(*part.keys).orderBy("_r")
    ends = {"_own": F.sum("_c"), "_first": F.min_by(F.struct(value), at), "_last": F.max_by(F.struct(value), at)}
    # a range whose first value goes on from the range before opens one segment less
    goes_on = F.coalesce(F.lag("_last").over(over).eqNullSafe(F.col("_first")) & (F.row_number().over(over) > 1), F.lit(False)).cast("int")
    rows = part.carried(rows, ends, {"_on": goes_on, "_before": F.coalesce(F.sum(F.col("_own") - F.col("_on")).over(part.before()), F.lit(0)) - F.col("_on")})
    return rows.withColumn(name, F.col("_s") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)


def running_best(df: DataFrame, keys: list[str], order: list[str], value: str, name: str = "best") -> DataFrame:
    """Add the least value so far and whether the row set it."""
    part = ranged(df, keys, order[0])
    near = F.min(value).over(part.window(*order).rowsBetween(W.unboundedPreceding, -1))
    rows = part.carried(part.rows.withColumn("_near", near), {"_least": F.min(value)}, {"_far": F.min("_least").over(part.before())})
    before = F.least("_near", "_far")
    return rows.withColumn("_before", before).withColumns({name: F.least("_before", value), f"is_{name}": F.col(value).isNotNull() & (F.col("_before").isNull() | (F.col(value) < F.col("_before")))}).select(*df.columns, name, f"is_{name}")


def career_best(entries: DataFrame, player: str, rank: str, date: str, month: Column) -> DataFrame:
    """Best rank of each player and the month in which it was first reached."""
    rows = entries.where(F.col(rank).isNotNull())
    return rows.groupBy(player).agg(F.min(rank).alias("best_rank"), F.min_by(month, F.struct(rank, date)).alias("best_month"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, value: str) -> DataFrame:
    """Add the value of the nearest row on the right by distance, ``distance`` and ``ambiguous``.

    Both sides are sorted together once; candidates are the last at or before and the first at or after. Equal distances of different
    values on the two sides are ambiguous and give null. Of right rows at one place the least value counts. Without keys, or where one
    holds very many rows, the sort goes by ranges of the data, and each range gets the last place before it and the first behind it.
    """
    places = right.where(F.col(right_at).isNotNull()).groupBy(*keys, F.col(right_at).cast("double").alias("_at")).agg(F.min(value).alias("_v"))
    rows = left.withColumns({"_at": F.col(at).cast("double"), "_kind": F.lit(1), "_mark": F.lit(None).cast(f"struct<at:double,v:{dict(right.dtypes)[value]}>")})
    marks = places.withColumn("_mark", F.struct(F.col("_at").alias("at"), F.col("_v").alias("v"))).withColumn("_kind", F.lit(0)).drop("_v")
    part = ranged(rows.unionByName(marks, allowMissingColumns=True), keys, "_at")
    w = part.window("_at", "_kind")
    back = F.last("_mark", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first("_mark", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    there = F.when(F.col("_kind") == 0, F.col("_at"))
    over = {"_low": F.last("_hi", ignorenulls=True).over(part.before()), "_high": F.first("_lo", ignorenulls=True).over(part.behind())}
    both = part.carried(part.rows.withColumns({"_b": back, "_a": ahead}), {"_hi": F.max_by("_mark", there), "_lo": F.min_by("_mark", there)}, over)
    out = both.where("_kind = 1").withColumns({"_back": F.coalesce("_b", "_low"), "_ahead": F.coalesce("_a", "_high")})
    down, up = F.col("_at") - F.col("_back.at"), F.col("_ahead.at") - F.col("_at")
    tie = F.coalesce((down == up) & ~F.col("_back.v").eqNullSafe(F.col("_ahead.v")), F.lit(False))
    pick = F.when(tie, None).when(up.isNull() | (down <= up), F.col("_back.v")).otherwise(F.col("_ahead.v"))
    return out.withColumns({"nearest": pick, "distance": F.least(down, up), "ambiguous": tie}).select(*left.columns, "nearest", "distance", "ambiguous")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_at: str, values: list[str]) -> DataFrame:
    """Add the values of the latest right row at or before each left row's time, by one sort of both sides together.

    Of right rows at one time the largest values count. A key that holds very many rows is sorted by ranges of its times.
    """
    marks = right.groupBy(*keys, F.col(right_at).alias("_at")).agg(F.max(F.struct(*values)).alias("_row")).withColumn("_kind", F.lit(0))
    both = left.withColumns({"_at": F.col(at), "_kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    part = ranged(both, keys, "_at")
    near = F.last("_row", ignorenulls=True).over(part.window("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    rows = part.rows.withColumn("_near", near)
    rows = part.carried(rows, {"_latest": F.max_by("_row", F.when(F.col("_kind") == 0, F.col("_at")))}, {"_far": F.last("_latest", ignorenulls=True).over(part.before())})
    out = rows.where("_kind = 1").withColumn("_row", F.coalesce("_near", "_far"))
    return out.select(*left.columns, *[F.col(f"_row.{v}").alias(v) for v in values])


def nested(df: DataFrame, keys: list[str], order: list[str], fields: list[str], name: str) -> DataFrame:
    """Rows of each key as a sorted array of structs. For children bounded by their parent (sides of a match, players of a side)."""
    rest = [c for c in fields if c not in order]
    listed = F.array_sort(F.collect_list(F.struct(*order, *rest)))
    return df.groupBy(*keys).agg(F.transform(listed, lambda x: F.struct(*[x[c].alias(c) for c in fields])).alias(name))


def top_n(df: DataFrame, value: str, n: int = 20) -> DataFrame:
    """The n most frequent values with their counts, ties by value."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(n)


def contains_any(columns: list[str], terms: list[str]) -> Column:
    """Whether any column holds any term, case apart; no term: nothing does."""
    tests = [F.contains(F.lower(F.col(c)), F.lit(t.lower())) for c in columns for t in terms]
    return F.coalesce(reduce(Column.__or__, tests), F.lit(False)) if tests else F.lit(False)


def search_rank(query: str, name: str, alias: str, slug: str, rank: str) -> Column:
    """Relevance of a search hit: exact alias, name, slug; their prefixes; ranked rows; the rest."""
    q, low = query.lower(), lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    out = F.when(low(alias) == q, 1).when(low(name) == q, 2).when(low(slug) == q, 3)
    out = out.when(F.startswith(low(alias), F.lit(q)), 4).when(F.startswith(low(name), F.lit(q)), 5).when(F.startswith(low(slug), F.lit(q)), 6)
    return out.when(F.col(rank).isNotNull(), 7).otherwise(8)


def preferred_order(code: Column, wanted: list[str]) -> list[Column]:
    """Sort keys: place in the list, unlisted codes last, then the code."""
    at = F.array_position(F.array(*map(F.lit, wanted)), code)
    return [F.when(at > 0, at).otherwise(F.lit(len(wanted) + 1)).asc(), code.asc_nulls_last()]


def placed(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add ``name``, the place from 1 of every row of a whole table in ``order``, which must tell all rows apart.

    Rows are dealt to ranges of the order; the ranges' sizes, one number each, say where each begins, so no task sees the whole table.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_part", F.spark_partition_id())
    held = stored(dealt, "placed")
    starts, before = [], 0
    for part, n in sorted(tuple(r) for r in held.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    begins = spark.createDataFrame(starts, "_part int, _before long")
    rank = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return held.join(F.broadcast(begins), "_part").withColumn(name, rank + F.col("_before")).select(*df.columns, name)


def tagged(kind: str, number: Column) -> Column:
    """Identity over sources of several kinds: struct<kind, id, text>."""
    return F.struct(F.lit(kind).alias("kind"), number.cast("long").alias("id"), F.concat_ws(":", F.lit(kind), number.cast("string")).alias("text"))
