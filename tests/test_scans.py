"""Scans over keys that are cut into ranges: a key with a third of all rows, no key at all, nulls, ties, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from rallyspark.operators import relational, scan
from tests.helpers import rows


@pytest.fixture
def cut(monkeypatch):
    monkeypatch.setattr(scan, "LEAST", 50)


def table(spark, n=3000, seed=3):
    """(k, at, id, v): one key holds a third of the rows, some keys are null, times repeat."""
    rng = random.Random(seed)
    data = [(None if i % 97 == 0 else "hot" if i % 3 == 0 else f"k{rng.randrange(200)}", rng.randrange(900), i, rng.choice(["a", "b", None, "b"])) for i in range(n)]
    return data, spark.createDataFrame(data, "k string, at long, id long, v string").repartition(4)


def by_key(data):
    out = {}
    for k, at, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        out.setdefault(k, []).append((at, i, v))
    return out


def test_ranges_are_even(spark, cut):
    data, df = table(spark)
    part = scan.ranged(df, ["k"], "at")
    sizes = [r["count"] for r in part.rows.groupBy("k", "_r").count().where("k = 'hot'").collect()]
    assert part.split and len(sizes) > 100 and max(sizes) < 30 and sum(sizes) == sum(k == "hot" for k, *_ in data)
    assert part.rows.where("not _cut and _r > 0").count() == 0
    order = part.rows.where("_cut").groupBy("k", "_r").agg(F.min("at").alias("lo"), F.max("at").alias("hi")).orderBy("k", "_r").collect()
    assert all(a.k != b.k or a.hi < b.lo for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("least", [50, 10_000])
def test_scans_equal_a_loop(spark, monkeypatch, least):
    monkeypatch.setattr(scan, "LEAST", least)
    data, df = table(spark)
    want_s, want_b = {}, {}
    for own in by_key(data).values():
        n, last, best = 0, object(), None
        for at, i, v in own:
            n, last = n + (v != last), v
            want_s[i] = n
            value = (at * 7 + i * 13) % 1000
            want_b[i] = (value if best is None else min(best, value), best is None or value < best)
            best = want_b[i][0]
    got = relational.change_counter(df, ["k"], ["at", "id"], "v")
    assert {r.id: r.segment for r in got.collect()} == want_s and got.columns == [*df.columns, "segment"]
    valued = df.withColumn("x", (F.col("at") * 7 + F.col("id") * 13) % 1000)
    assert {r.id: (r.best, r.is_best) for r in relational.running_best(valued, ["k"], ["at", "id"], "x").collect()} == want_b


@pytest.mark.parametrize("least", [50, 10_000])
def test_as_of_and_nearest_equal_a_loop(spark, monkeypatch, least):
    monkeypatch.setattr(scan, "LEAST", least)
    data, df = table(spark)
    right_data, right = table(spark, 700, 9)
    marks = {}
    for k, at, i, _ in right_data:
        marks.setdefault(k, {}).setdefault(at, []).append(i)
    got = relational.as_of(df, right.select("k", F.col("at").alias("t"), F.col("id").alias("other")), ["k"], "at", "t", ["other"])
    latest = lambda k, at: max((t for t in marks.get(k, {}) if t <= at), default=None)
    # a null key has no partner as in any join of keys
    want = {i: (max(marks[k][t]) if (t := latest(k, at)) is not None else None) for k, at, i, _ in data}
    assert {r.id: r.other for r in got.collect()} == want
    for keys in (["k"], []):
        near = relational.nearest(df, right.select("k", F.col("at").alias("t"), F.col("id").alias("other")), keys, "at", "t", "other")
        places = {}
        for k, at, i, _ in right_data:
            own = places.setdefault(k if keys else 0, {})
            own[at] = min(own.get(at, i), i)
        for r in near.collect():
            own = places.get(r.k if keys else 0, {})
            down, up = max((t for t in own if t <= r["at"]), default=None), min((t for t in own if t >= r["at"]), default=None)
            gaps = [abs(r["at"] - t) for t in (down, up) if t is not None]
            assert r.distance == (min(gaps) if gaps else None)
            tied = len(gaps) == 2 and gaps[0] == gaps[1] and own[down] != own[up]
            assert r.ambiguous == tied and (r.nearest is None if tied or not gaps else r.nearest == own[down if len(gaps) == 1 and down is not None or len(gaps) == 2 and gaps[0] <= gaps[1] else up])


def test_islands_and_empty_tables(spark, cut):
    numbers = [("hot", n) for n in range(1000) if n % 10 != 7] + [("b", 1), ("b", 2), ("b", 2), (None, 5)]
    df = spark.createDataFrame(numbers, "k string, n long")
    want = {("hot", lo, hi, hi - lo + 1) for lo, hi in [(0, 6), *((x + 8, min(x + 16, 999)) for x in range(0, 991, 10))]} | {("b", 1, 2, 2), (None, 5, 5, 1)}
    assert rows(relational.islands(df, ["k"], "n"), "k", "first", "last", "n") == want
    none = df.where("false")
    assert relational.islands(none, ["k"], "n").count() == 0 and relational.running_best(none, ["k"], ["n"], "n").count() == 0
    assert relational.nearest(none, none.select("k", F.col("n").alias("t"), F.col("n").alias("o")), [], "n", "t", "o").count() == 0
