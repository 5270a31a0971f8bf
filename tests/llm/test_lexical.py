import math
import re
from collections import Counter

import numpy as np
import pytest

from rallyspark.llm import lexical

QUERIES = [(1, "the QUICK brown fox the"), (1, "token lorem"), (2, None), (3, ""), (None, "Straße 日本語"), (4, "nowhere tobefound"), (5, "row row same id twice"), (6, "one")]


def plain(docs, queries, k=10):
    """item, rank, doc_id, score by full scores of every pair; texts of one query are taken apart by their place."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: Counter(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(upper)))
    own = [(d, c) for d, c in ((d, terms(t)) for d, t in docs) if c]
    n, length, df = len(own), sum(c.total() for _, c in own), Counter(t for _, c in own for t in c)
    out = Counter()
    for item, text in queries:
        scored = []
        for d, c in own:
            m = 25 + 75 * c.total() * n // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms(text).items() if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1):
            out[(item, rank, d, -s)] += 1
    return out


@pytest.mark.parametrize("group_terms", [1 << 18, 3])
def test_awkward_rows(spark, docs, wide, group_terms):
    queries = spark.createDataFrame(QUERIES, "item_id long, text string")
    got = lexical.search(wide.repartition(3), queries, group_terms=group_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, got.collect())) == plain([(r.doc_id, r.text) for r in docs.collect()], QUERIES)


def test_empty_tables(spark, docs, empty):
    none, some = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(QUERIES, "item_id long, text string")
    assert lexical.search(docs, none).count() == 0 and lexical.search(empty, some).count() == 0


def test_bounds_skip_blocks_and_lose_nothing(spark, monkeypatch):
    """Documents of one topic stand together, so most blocks are never scored; ties and copies are among the best."""
    rows = [(i, f"topic{i // 500} " * (1 + i % 7) + "common words of all documents " * (1 + i % 5)) for i in range(4000)]
    queries = [(q, f"topic{q} common") for q in range(8)]
    docs, asked = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame(queries, "item_id long, text string")
    assert Counter(map(tuple, lexical.search(docs, asked).collect())) == plain(rows, queries)
    vocabulary = {t.encode(): i for i, t in enumerate(sorted({w for _, q in queries for w in q.split()}))}
    index = lexical.forward_index(docs, vocabulary).toArrow().to_pylist()
    search = lexical._Search({0: ([vocabulary[b"topic0"]], np.array([1000]))}, len(vocabulary), 10, (4000, 4000 * 15), {})
    assert search.visit(index, False) <= 5 < len(index)


def test_whole_tables(spark, sf_dir):
    docs, queries = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, asked = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in queries.collect()]
    assert Counter(map(tuple, lexical.search(docs.repartition(4), queries).collect())) == plain(rows, asked)
