import math

import numpy as np

from rallyspark.llm import topk


def brute(rows, every, k):
    ok = [(i, r[0], [math.floor(1024 * float(x)) for x in r[1]]) for i, r in enumerate(rows) if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for i, key, v in ok:
        if key % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), other) for j, other, w in ok if j != i)[:k]
            out += [(key, n, other, -s) for n, (s, other) in enumerate(scored, 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(1500)]
    rows += [(5000 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(100, rows[7][1]), (100, rows[7][1]), (None, [1.0] * 8), (200, None), (300, [None] * 8), (400, [float("nan")] * 8), (500, [float("inf")] * 8), (600, []), (700, [-0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, "vec_id", "embedding").select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 100, 10)


def test_small_tables_and_large_values(spark):
    schema = "vec_id long, embedding array<double>, row string, key string, v string"
    assert topk.top_k(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    one = spark.createDataFrame([(0, [1.0], "a", "b", "c")], schema)
    assert topk.top_k(one, "vec_id", "embedding").count() == 0
    rows = [(0, [1e5, -2e5], "", "", ""), (1, [3e5, 4e5], "", "", ""), (2, [-1.5, 0.25], "", "", "")]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, schema), "vec_id", "embedding").collect())
    assert got == brute([r[:2] for r in rows], 100, 10)
