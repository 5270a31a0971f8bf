"""Checks of tables: each returns rows or one row of figures; nothing is raised and nothing asks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallyspark.functions.text import normalize_event_name, nz, raw_identity


def with_reasons(df: DataFrame, **rules: Column) -> DataFrame:
    """Add ``reasons``: names of the rules that a row breaks (a rule is true where the row is sound)."""
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()])))


def required(df: DataFrame, *columns: str) -> DataFrame:
    return with_reasons(df, **{c: F.trim(nz(F.col(c).cast("string"))) != "" for c in columns})


def all_or_nothing(df: DataFrame) -> DataFrame:
    """All rows if none has reasons, else none."""
    bad = df.where(F.size("reasons") > 0).limit(1).agg(F.count(F.lit(1)).alias("_bad"))
    return df.crossJoin(F.broadcast(bad)).where("_bad = 0").drop("_bad", "reasons")  # one row is broadcast


def rejects(df: DataFrame, key: str, examples: int = 20) -> DataFrame:
    """Rejected rows by reason: how many, and the least keys as examples."""
    bad = df.where(F.size("reasons") > 0).select(key, F.explode("reasons").alias("reason"))
    first = bad.withColumn("_n", F.row_number().over(W.partitionBy("reason").orderBy(key))).where(F.col("_n") <= examples)
    shown = first.groupBy("reason").agg(F.array_sort(F.collect_list(key)).alias("examples"))
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).join(shown, "reason")


def identity_mismatch(df: DataFrame, raw: str, event: str, year: str, allowed: DataFrame | None = None) -> DataFrame:
    """Rows whose raw text names another event or year than their file, unless the pair is allowed (event, raw_event)."""
    rows = df.withColumn("_r", raw_identity(F.col(raw)))
    other = (normalize_event_name(F.col("_r.event")) != normalize_event_name(F.col(event))) | (F.col("_r.year").isNotNull() & (F.col("_r.year") != F.col(year)))
    bad = rows.where(F.col("_r.event").isNotNull() & F.coalesce(other, F.lit(False))).withColumn("raw_event", F.col("_r.event")).drop("_r")
    return bad if allowed is None else bad.join(allowed.select(event, "raw_event"), [event, "raw_event"], "left_anti")


def ranking_rows(df: DataFrame, rank: str = "rank", player: str = "player_id", url: str = "profile_url") -> DataFrame:
    """Add reasons to ranking rows of a category: ranks in order, ids once, the url names the id."""
    w = W.partitionBy("category").orderBy("seq")
    ordered = F.coalesce(F.col(rank) >= F.lag(rank).over(w), F.col(rank).isNotNull())
    once = F.count(F.lit(1)).over(W.partitionBy("category", player)) == 1
    return with_reasons(df.withColumns({"_o": ordered, "_u": once}), order=F.col("_o"), unique=F.col("_u"), url=F.contains(nz(F.col(url)), F.col(player).cast("string"))).drop("_o", "_u")


def complete(df: DataFrame, category: str, expected: str, tolerance: float = 0.02, least: int = 5) -> DataFrame:
    """Per category the rows, the expected total, whether it is whole, and usable within max(least, tolerance)."""
    out = df.groupBy(category).agg(F.count(F.lit(1)).alias("rows"), F.max(expected).alias("expected"))
    short = F.col("expected") - F.col("rows")
    return out.withColumns({"whole": short <= 0, "usable": short <= F.greatest(F.lit(float(least)), F.col("expected") * tolerance)})


def missing_pages(df: DataFrame, category: str, index: str, page: int) -> DataFrame:
    """Distinct offsets of the pages that hold the rows."""
    return df.select(category, (F.floor(F.col(index) / page) * page).cast("long").alias("offset")).distinct()


def page_proof(pages: DataFrame, expected: DataFrame, key: list[str]) -> DataFrame:
    """Pages whose counts and first and last rank are those of their checkpoint."""
    seen = pages.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    sound = (F.col("rows") == F.col("row_count")) & (F.col("rows") == F.col("parsed_count")) & (F.col("first") == F.col("first_rank")) & (F.col("last") == F.col("last_rank"))
    return expected.join(seen, key, "left").select(*key, F.coalesce(sound, F.lit(False)).alias("proved"))


def page_overlap(pages: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Shared rows of neighbouring pages and how many agree in id."""
    j = pages.alias("a").join(other.alias("b"), key)
    return j.groupBy(*[k for k in key if k != "rank"]).agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("a.player_id").eqNullSafe(F.col("b.player_id"))).alias("agree"))


def prefix_sound(df: DataFrame, category: str) -> DataFrame:
    """Whether the rows of a category are a gapless prefix from rank 1."""
    out = df.groupBy(category).agg(F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_distinct("rank").alias("n"))
    return out.select(category, ((F.col("low") == 1) & (F.col("high") == F.col("n"))).alias("sound"))


def null_share(df: DataFrame | GroupedData, *columns: str) -> DataFrame:
    """Rows, and those that lack each column, of a table or of each group."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def run_summary(steps: DataFrame) -> DataFrame:
    """Totals of per-file summaries by step, and whether one needs a look (step, inserted, skipped, errors)."""
    out = steps.groupBy("step").agg(*[F.sum(c).alias(c) for c in ("inserted", "skipped", "errors")])
    return out.withColumn("manual_check", (F.col("errors") > 0) | (F.col("skipped") > 0))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys with several rows. Reported only: repeated meetings are real."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def report(df: DataFrame, **measures: Column) -> DataFrame:
    return df.agg(*[m.alias(n) for n, m in measures.items()])
