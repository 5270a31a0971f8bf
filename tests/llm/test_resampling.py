import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from rallyspark.llm import resampling, words

TARGET = [(1, "the quick brown fox"), (2, None), (3, "Straße straße 42 far away"), (3, "")]


def plain(docs, target, percent=25, seed=7, least=20):
    """doc_id, n_features, weight, score, rank of every row, by counters."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(upper))

    def buckets(t):
        w = found(t)
        return len(w), Counter(zlib.crc32(f.encode()) % 10000 for f in [*w, *map(" ".join, zip(w, w[1:]))])

    own = [(d, *buckets(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in own:
        s.update(c)
    for _, text in target:
        t.update(buckets(text)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    rows = []
    for d, n, c in own:
        weight = sum(gain(b) * k for b, k in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    drawn = able[: len(able) * percent // 100]
    ranks = Counter((*r[:1], *r[2:]) for r in rows), [((r[0], *r[2:]), i) for i, r in enumerate(drawn, 1)]
    out = Counter({(*k, None): n for k, n in ranks[0].items()})
    for k, i in ranks[1]:
        out[(*k, None)] -= 1
        out[(*k, i)] += 1
    return +out


@pytest.mark.parametrize("percent", [25, 100])
def test_awkward_rows(spark, docs, wide, percent):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = resampling.resample(wide.repartition(3), target, percent, min_words=3)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == plain(rows, TARGET, percent, least=3)


def test_blocks_and_slices_change_nothing(spark, sf_dir, monkeypatch):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, resampling.resample(docs, target).collect())) == plain(rows, [tuple(r) for r in target.collect()])
    text = ("Ünï words, and more words 12 " * 60).encode()
    whole = resampling.bucket_counts(text)
    monkeypatch.setattr(resampling, "parts_of_words", lambda t: words.parts_of_words(t, 37))
    cut = resampling.bucket_counts(text)
    assert whole[0] == cut[0] and (whole[1] == cut[1]).all() and (whole[2] == cut[2]).all()


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, none).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(map(tuple, resampling.resample(docs, none, min_words=1).collect())) == plain(rows, [], least=1)


def test_a_frequent_bucket_and_many_copies(spark):
    rows = [(i, "same words again and again here" if i % 3 else f"one{i} two{i} same words") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(0, "same words two7")], "item_id long, text string")
    assert Counter(map(tuple, resampling.resample(docs, target, min_words=4).collect())) == plain(rows, [(0, "same words two7")], least=4)
