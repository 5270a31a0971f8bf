"""Helpers of the tests: one value of an expression, rows as plain values."""

from __future__ import annotations

from pyspark.sql import Row


def plain(x):
    if isinstance(x, Row):
        return tuple(plain(v) for v in x)
    return [plain(v) for v in x] if isinstance(x, list) else x


def values(spark, schema: str, rows: list, *exprs) -> list:
    """Values of expressions over rows, in the order of the rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"_i long, {schema}").coalesce(1)
    got = sorted(df.select("_i", *[e.alias(f"e{i}") for i, e in enumerate(exprs)]).collect())
    return [plain(r[1]) if len(exprs) == 1 else tuple(plain(v) for v in r[1:]) for r in got]


def _fixed(x):
    return tuple(map(_fixed, x)) if isinstance(x, list | tuple) else x


def rows(df, *columns) -> set:
    """Rows as a set of tuples; arrays become tuples."""
    return {tuple(_fixed(plain(v)) for v in r) for r in (df.select(*columns) if columns else df).collect()}
