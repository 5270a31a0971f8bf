import re
from collections import Counter, defaultdict

import numpy as np

from rallyspark.llm import neardup
from rallyspark.llm.components import components

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sets_of(rows, words):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        out.setdefault(doc_id, []).append(frozenset([tuple(w[i : i + words]) for i in range(len(w) - words + 1)] or ([tuple(w)] if w else [])))
    return out


def brute(rows, words, percent):
    """Component of each doc_id by counting all shared shingles."""
    sets = [(d, s) for d, ss in sets_of(rows, words).items() for s in ss if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)
    for i, (d, s) in enumerate(sets):
        shared = Counter(j for x in s for j in where[x] if j > i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(d), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for words in (2, 5):
        want = brute(rows, words, 80)
        got = {r.doc_id: r for r in neardup.groups(docs, words, 80).collect()}
        assert {d: r.component_id for d, r in got.items()} == want
        assert {d: r.n_shingles for d, r in got.items()} == {d: len(s[0]) for d, s in sets_of(rows, words).items()}
        assert all(r.kept == (d == r.component_id) for d, r in got.items())


def test_chains_and_large_groups(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i // 3 :] + [f"x{j}" for j in range(i // 3)])) for i in range(40)]
    rows += [(100 + i, " ".join(words[:50] + [f"y{i}"])) for i in range(60)] + [(1000 + i, "same text for all of these rows here") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.groups(docs, 2, 80).collect()} == brute(rows, 2, 80)


def test_awkward_rows(spark, docs, wide, empty):
    got = neardup.groups(wide, 2, 80)
    assert sorted(got.columns) == ["component_id", "doc_id", "kept", "n_shingles"]
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()]
    assert len(rows) == docs.count()
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[2][2:] == (1, False) and by[1][2:] == (1, True) and by[3][1:] == (0, 3, True) and by[4][1:] == (0, 4, True) and by[5][1:] == (0, 5, True)
    assert [r[2:] for r in rows if r[0] is None] == [(None, True)] * 2
    assert by[9007199254740993][1:3] == (1, 9007199254740993)
    kept = neardup.kept_documents(wide, 2, 80)
    assert kept.columns == wide.columns and kept.count() == docs.count() - 1
    assert neardup.groups(empty).count() == 0 and neardup.kept_documents(empty).columns == empty.columns


def test_sketches_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.int64).astype(np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    r = neardup.sketches([a, b, np.union1d(a, b)])
    assert (np.maximum(r[0], r[1]) == r[2]).all()  # registers of a union are maxima
    assert abs((r[0] == r[1]).mean() - 0.6) < 0.15
    assert neardup.sketches([np.empty(0, np.uint64)]).max() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (10, 11), (11, 12), (12, 10), (3, 20)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {2: 1, 3: 1, 20: 1, 5: 4, 11: 10, 12: 10}


def test_parity_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(8)
    for n in (1, 5, 40, 600, 5000):
        pool = rng.integers(0, 1 << 63, 3 * n + 10, dtype=np.int64).astype(np.uint64)
        for _ in range(40):
            a = np.unique(rng.choice(pool, n, replace=False))
            swap = int(rng.integers(0, max(1, n // 4) + 1))
            b = np.unique(np.concatenate([a[swap:], pool[rng.choice(len(pool), int(rng.integers(0, swap + 1)), replace=False)]]))
            if not len(b):
                continue
            both = len(np.intersect1d(a, b))
            linked = 100 * both >= 80 * (len(a) + len(b) - both)
            ok = neardup.near_enough([neardup.parity(a)], [neardup.parity(b)], np.array([len(a)]), np.array([len(b)]), 80)[0]
            assert ok or not linked
            if n >= 600 and 100 * both < 70 * (len(a) + len(b) - both):
                assert not ok


def test_second_round_meets_only_rows_with_a_likely_pair(spark, monkeypatch):
    """A band of 300 unlike sets and two alike pairs: the forest meets all rows, the round after it those four as askers and as members."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(300)]
    for a, b in ((7, 200), (150, 250)):
        sets[b] = np.unique(np.concatenate([sets[a][:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
    rows = [(i, len(s), bytearray(r.tobytes()), bytearray(neardup.parity(s))) for i, (s, r) in enumerate(zip(sets, neardup.sketches(sets), strict=True))]
    reps = spark.createDataFrame(rows, "id long, n long, registers binary, parity binary")
    members, labels = reps.selectExpr("5L AS band", "id", "0L AS hub"), spark.createDataFrame([], "node long, label long")
    made, cells = [], neardup._cells
    monkeypatch.setattr(neardup, "_cells", lambda sized: made.append(cells(sized).count()) or cells(sized))
    pairs, seen = neardup._remaining(members, labels, reps, 80, None)
    assert {tuple(r) for r in pairs.collect()} == {(200, 7), (250, 150)}
    again, _ = neardup._remaining(members, labels, reps, 80, seen)
    assert {tuple(r) for r in again.collect()} == {(200, 7), (250, 150)} and made == [598, 8]
    joined = spark.createDataFrame([(7, 7), (200, 7)], "node long, label long")
    assert [tuple(r) for r in neardup._remaining(members, joined, reps, 80, seen)[0].collect()] == [(250, 150)]


def _alike(rng, pairs, n=160):
    sets = [np.unique(rng.integers(0, 1 << 63, 60).astype(np.uint64)) for _ in range(n)]
    for a, b in pairs:
        sets[b] = np.unique(np.concatenate([sets[a][:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)]))
    return [(i, len(s), bytearray(r.tobytes()), bytearray(neardup.parity(s))) for i, (s, r) in enumerate(zip(sets, neardup.sketches(sets), strict=True))]


def test_rows_meet_once_for_a_hub_and_crowded_hubs_ask_for_two_bands(spark, monkeypatch):
    """A row stands once for all bands of a hub; rows with one band of a crowded hub meet only where they share a second crowded hub."""
    pairs = [(7, 90), (20, 110), (30, 130), (40, 150)]
    reps = spark.createDataFrame(_alike(np.random.default_rng(5), pairs), "id long, n long, registers binary, parity binary")
    labels = spark.createDataFrame([], "node long, label long")
    made, cells = [], neardup._cells
    monkeypatch.setattr(neardup, "_cells", lambda sized: made.append(cells(sized).count()) or cells(sized))
    meet = lambda members, seen=None: neardup._remaining(spark.createDataFrame(members, "band long, id long, hub long"), labels, reps, 80, seen)
    found = lambda out: {tuple(r) for r in out.collect()}
    every = [(band, i, 0) for band in range(40) for i in range(160)]
    assert found(meet(every)[0]) == {(b, a) for a, b in pairs} and made == [318]

    made.clear()
    monkeypatch.setattr(neardup, "SIDE", 50)
    # band 1 of hub 0 holds all; 7 and 90 share a second band of it, 20 and 110 a band that is not crowded, 30 and 130 one of a crowded hub
    more = [(2, i, 0) for i in (0, 7, 90)] + [(3, i, 2) for i in (2, 20, 110)] + [(4, i, 3) for i in [3, 30, *range(100, 160)] if i != 150]
    out, seen = meet([(1, i, 0) for i in range(160)] + more)
    assert {(90, 7), (110, 20), (130, 30)} == found(out)
    assert sum(made) < 300  # by blocks of all pairs of bands: 2 * 159 * 4 and 2 * 60 * 2
    made.clear()
    assert found(meet([(1, i, 0) for i in range(160)] + more, seen)[0]) == {(90, 7), (110, 20), (130, 30)} and sum(made) <= 12
