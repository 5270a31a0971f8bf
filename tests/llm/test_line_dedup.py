from collections import Counter

import pytest

from rallyspark.llm import linededup


def plain(docs, least=10):
    """doc_id, text, n_lines, n_dropped of every row; rows of one doc_id are one document, those without an id the last one."""
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(upper)
    order = lambda d: (d is None, d or 0)
    owner = {}
    for d, text in docs:
        for k in map(key, (text or "").split("\n")):
            if len(k) >= least:
                owner[k] = min(owner.get(k, order(d)), order(d))
    out = Counter()
    for d, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if owner.get(key(x), order(d)) == order(d)]
        out[(d, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    return out


AWKWARD = [
    (5, "A shared line of text\nshort\nA SHARED LINE OF TEXT \nown line number five"), (3, "\ta shared line of text\r\n\nshort\n"), (3, "another row of document three\nown line number five"),
    (9, "Été à la plage ici\nSTRASSE UND ẞ und KK"), (8, "été à la plage ici\nÉTÉ à la plage ici\nstrasse und ẞ und kK\nstrasse und ẞ und kk"), (None, "own line number five\nonly without an id here"),
    (None, "only without an id here\nÉté À la plage ici"), (12, "ten chars!\nnine char"), (11, "Ten Chars!\nnine char"), (12, "ten chars!\nnine char"), (1, None), (2, ""), (4, "\n\n"), (-7, "own line number five"),
]


@pytest.mark.parametrize("batches", [1, 2, 6, 20])
def test_awkward_rows(spark, docs, batches):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + AWKWARD
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), batches=batches)
    assert Counter(map(tuple, got.collect())) == plain(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_clashing_names_and_empty_tables(spark, docs, wide, empty):
    assert Counter(map(tuple, linededup.deduplicated(wide, batches=2).collect())) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert linededup.deduplicated(empty).count() == 0


def test_one_line_in_a_third_of_all_documents(spark):
    rows = [(i, f"the licence line that many share\nown line of {i}" if i % 3 == 1 else f"own line of document {i // 2}\nx") for i in range(2000)]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_a_text_of_very_many_dropped_lines(spark):
    many = "\n".join(f"line number {i % 5000} of many" for i in range(40_000))
    rows = [(1, many), (2, many + "\nlast line of all"), (3, "line number 7 of many")]
    got = linededup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_levels_are_compacted(spark):
    runs = linededup.Runs(spark, fan=2)
    for i in range(5):
        keys = spark.range(i, i + 3).selectExpr("cast(cast(id as string) as binary) h", "named_struct('late', false, 'doc_id', id) owner")
        runs.add(runs.unknown(keys))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(bytes(r.h) for r in runs.owners().collect()) == sorted(str(i).encode() for i in range(7))
    runs.drop()
