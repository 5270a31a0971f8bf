"""Changes of tables as whole-table plans: upserts, patches, guards, replacement of a scope, promotion.

Every function takes the present table and what comes in, and returns the next table; ``write_partitions`` commits one scope at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyspark.functions.scores import IMPORT_STATUS, status_priority
from rallyspark.functions.text import nz
from rallyspark.operators.relational import _cols, top_row


def latest_incoming(rows: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """Of rows with one key the last one."""
    return top_row(rows, keys, F.struct(*order))


def upsert(old: DataFrame, new: DataFrame, keys: str | list[str], rules: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Rows of ``new`` (one for each key) over rows of ``old``.

    In ``rules`` and ``when`` the columns are ``o.x`` and ``n.x``: a rule gives a column's value where both have the row, ``when`` says
    whether an old row may change at all. Keys are compared null-safely.
    """
    keys = _cols(keys)
    cols = [c for c in old.columns if c not in keys]
    same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys])
    o, n = old.withColumn("_o", F.lit(True)).alias("o"), new.withColumn("_n", F.lit(True)).alias("n")
    joined = o.join(n, same, "full")
    has_o, has_n = F.col("o._o").isNotNull(), F.col("n._n").isNotNull()
    change = has_n if when is None else has_n & (~has_o | F.coalesce(when, F.lit(False)))
    value = lambda c: (rules or {}).get(c, F.col(f"n.{c}") if c in new.columns else F.col(f"o.{c}"))
    fresh = lambda c: F.col(f"n.{c}") if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c])
    picked = [F.when(has_o & change, value(c)).when(has_o, F.col(f"o.{c}")).otherwise(fresh(c)).alias(c) for c in cols]
    key = [F.when(has_o, F.col(f"o.{k}")).otherwise(F.col(f"n.{k}")).alias(k) for k in keys]
    return joined.select(*key, *picked).select(*old.columns)


def patch(columns: list[str]) -> dict[str, Column]:
    """Rules that keep the old value where the new one is null."""
    return {c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) for c in columns}


def monotone_status(column: str = "status", scale: dict[str, int] = IMPORT_STATUS) -> dict[str, Column]:
    """Rule that never lowers a status; the incoming one wins on equality."""
    return {column: F.when(status_priority(F.col(f"n.{column}"), scale) >= status_priority(F.col(f"o.{column}"), scale), F.col(f"n.{column}")).otherwise(F.col(f"o.{column}"))}


def completed_only_forward(column: str = "lifecycle_status") -> dict[str, Column]:
    """Rule for lifecycles: only upcoming becomes completed."""
    return {column: F.when((F.col(f"o.{column}") == "upcoming") & (F.col(f"n.{column}") == "completed"), F.lit("completed")).otherwise(F.col(f"o.{column}"))}


def not_final(status: str = "status", source: str = "source") -> Column:
    """Guard against late data: a completed official row is changed by official rows only."""
    final = F.col(f"o.{status}").isin("completed", "walkover") & (F.col(f"o.{source}") == "official")
    return F.coalesce(~final, F.lit(True)) | F.coalesce(F.col(f"n.{source}") == "official", F.lit(False))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: str | list[str], *order: str) -> DataFrame:
    """Rows of ``new`` whose key is not there yet are added; of several the first by ``order``."""
    keys = _cols(keys)
    once = top_row(new, keys, F.struct(*order), largest=False) if order else new.dropDuplicates(keys)
    same = reduce(Column.__and__, [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys])
    return old.unionByName(once.alias("n").join(old.select(*keys).distinct().alias("o"), same, "left_anti"), allowMissingColumns=True)


def replace_scope(old: DataFrame, new: DataFrame, scope: str | list[str]) -> DataFrame:
    """All old rows of the scopes that ``new`` has are replaced."""
    scope = _cols(scope)
    same = reduce(Column.__and__, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in scope])
    return old.alias("o").join(new.select(*scope).distinct().alias("n"), same, "left_anti").unionByName(new)


def cascade(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """Children whose parent is still there."""
    left = parents.select(F.col(key).alias("_k")).distinct()
    return [c.join(left, c[k] == F.col("_k"), "left_semi") for c, k in children]


def detach(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children stay without their parent: the key is null where the parent is gone."""
    left = parents.select(F.col(parent_key).alias(child_key), F.lit(True).alias("_there")).distinct()
    return children.join(left, child_key, "left").withColumn(child_key, F.when(F.col("_there"), F.col(child_key))).select(*children.columns)


def best_record(rows: DataFrame, key: str, priority: Column, completeness: Column, updated: Column, arrival: str) -> DataFrame:
    """One row for each code: highest priority, then fullest, then newest, then first to arrive. Rows without a code all stay."""
    coded = rows.where(nz(F.col(key)) != "")
    order = F.struct(priority, completeness, nz(updated), -F.col(arrival))
    return top_row(coded, key, order).unionByName(rows.where(nz(F.col(key)) == ""))


def newest_wrapper(rows: DataFrame, keys: str | list[str], stamp: Column, position: str) -> DataFrame:
    """The row of each key from its newest wrapper, the later one at equal times."""
    return top_row(rows, keys, F.struct(stamp, position))


def fill_from(first: DataFrame, second: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two feeds by code: the first one's fields, empty ones from the second, and the sources that had the code."""
    rows = first.withColumn("_s", F.lit(0)).unionByName(second.withColumn("_s", F.lit(1)))
    filled = [F.min_by(F.col(c), F.when(nz(F.col(c).cast("string")) != "", F.col("_s"))).alias(c) for c in fields]
    return rows.groupBy(key).agg(*filled, F.array_sort(F.collect_set("source")).alias("sources"))


def reconcile_provisional(rows: DataFrame, key: str, real: Column, match_on: list[str], fields: list[str]) -> DataFrame:
    """Provisional rows (``real`` false) are folded into the real row with the same ``match_on``; only its empty fields are filled.

    Provisional rows without a real partner stay.
    """
    marked = rows.withColumn("_real", F.coalesce(real, F.lit(False)))
    own, other = marked.where("_real"), marked.where("not _real")
    fill = other.groupBy(*match_on).agg(*[F.max(c).alias(f"_{c}") for c in fields])
    merged = own.join(fill, match_on, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in fields}).select(*rows.columns)
    return merged.unionByName(other.join(own.select(*match_on).distinct(), match_on, "left_anti").select(*rows.columns))


def promote(history: DataFrame, live: DataFrame, event_id: int, replace: bool = False) -> DataFrame:
    """Finished live matches of one event become historical rows.

    Walkovers and matches without both sides or a winner stay behind. Again promoting changes nothing: known codes are ignored, or with
    ``replace`` the event's promoted rows are purged first.
    """
    done = live.where((F.col("event_id") == event_id) & (F.col("status") == "completed") & F.col("winner_side").isin("A", "B") & (nz(F.col("side_a_key")) != "") & (nz(F.col("side_b_key")) != ""))
    base = history.where(~((F.col("event_id") == event_id) & F.col("external_code").isNotNull())) if replace else history
    return insert_or_ignore(base, done.select(*[c for c in history.columns if c in done.columns]), ["event_id", "external_code"], "external_code")


def promotion_check(live: DataFrame, event_id: int) -> DataFrame:
    """Counts that must hold before an event is promoted."""
    own = live.where(F.col("event_id") == event_id)
    return own.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("status").isin("completed", "walkover", "cancelled")).alias("unfinished"), F.count_if((F.col("status") == "completed") & F.col("winner_side").isNull()).alias("without_winner"))


def register_codes(dim: DataFrame, rows: DataFrame, code: str, name: str) -> DataFrame:
    """Unknown codes join the dictionary under their own name; blank codes do not."""
    new = rows.where(F.trim(nz(F.col(code))) != "").select(F.col(code), F.col(code).alias(name)).distinct()
    return insert_or_ignore(dim, new, code, name)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per column the number of rows that differ, with ``checked`` and ``changed`` rows."""
    j = old.alias("o").join(new.alias("n"), key)
    flag = lambda c: ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    return j.agg(F.count(F.lit(1)).alias("checked"), F.count_if(reduce(Column.__or__, [flag(c) for c in columns])).alias("changed"), *[F.count_if(flag(c)).alias(c) for c in columns])


def only_changed(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old``."""
    return new.alias("n").join(old.alias("o"), key).where(reduce(Column.__or__, [~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])).select(key, *[F.col(f"n.{c}") for c in new.columns if c != key])


def write_partitions(df: DataFrame, path: str, partition: str | list[str]) -> None:
    """Commit the scopes of ``df`` at once: only their partitions are replaced, all or none becomes visible."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_cols(partition)).parquet(path)
