import random
import string
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rallyspark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs.where(~langid.held_out()))
    found = docs.select("doc_id", "lang", langid.held_out().alias("out"), langid.predicted(net)(F.col("text")).alias("p")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    tested = [r for r in found if r.out]
    assert len(tested) > 150 and np.mean([r.p.lang_pred == r.lang for r in tested]) >= 0.97
    assert all(0 <= r.p.score <= 1 for r in found)
    kept = langid.accepted(docs, net)
    assert kept.columns == docs.columns and kept.count() == docs.count()  # short texts are kept
    # planted texts in no learnt language go, at any length from two dozen letters on; short clean ones stay
    rng = random.Random(1)
    junk = ["".join(rng.choices(string.ascii_letters + string.digits + "  ", k=k)) for k in (60, 90, 100, 120, 300, 2000)]
    junk += ["このテキストの言語は学習されていません。" * k for k in (2, 3, 20)] + ["Привет как дела сегодня хорошая погода " * k for k in (4, 8, 20)]
    clean = ["un", "der", *[" ".join(r.split()[:3]) for r in [x.text for x in docs.where("lang = 'en'").limit(20).collect()]]]
    planted = spark.createDataFrame([(i, t) for i, t in enumerate(junk + clean)], "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.accepted(planted, net).collect()) == list(range(len(junk), len(junk + clean)))


def test_awkward_rows(spark, docs, wide, empty):
    net = langid.fit(docs)
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(wide, net).collect()}
    assert (3, "und") in got and (4, "und") in got and (5, "und") in got
    assert {x for _, x in got} <= {"und", "en", "de", "fr", "xx"}
    kept = langid.accepted(wide, net)
    assert kept.columns == wide.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert langid.fit(empty) is None
    assert langid.accepted(docs, None).count() == docs.count()
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(empty, net).count() == 0


def test_windows_cover_the_text():
    rows, sizes = langid.windows(b"x" * 600)
    assert rows.shape == (3, langid.WINDOW + 3) and sizes.tolist() == [256, 256, 88] and (rows[0] == ord("x")).all() and (rows[2][88:] == 0).all()


def test_network_against_plain_loops():
    rng = np.random.default_rng(4)
    rows = np.stack([langid.windows(t.encode())[0][0] for t in ("a short text", "ein längerer Text über etwas", "x" * 256)])
    net = langid.train(rows, np.array([0, 1, 0]), ["a", "b"], epochs=2)
    want = []
    for row in rows:
        pooled = []
        for f in range(net.filters.shape[1]):
            width = langid.WIDTHS[f // langid.FILTERS]
            answers = [sum(net.embed[row[i + j]][e] * net.filters[j * langid.EMBED + e, f] for j in range(width) for e in range(langid.EMBED)) for i in range(langid.WINDOW)]
            pooled.append(max(0.0, max(answers) + net.bias[f]))
        z = [sum(p * net.dense[f, c] for f, p in enumerate(pooled)) + net.dense_bias[c] for c in range(2)]
        want.append([x - np.log(sum(np.exp(z))) for x in z])
    assert np.allclose(net.log_probabilities(rows), want, atol=1e-4)
    made = langid.noise(rows)
    assert made.shape == rows.shape and sorted(made[0]) == sorted(rows[0]) and not (rng.permutation(made[1]) == rows[1]).all()


def test_every_language_is_learnt_from_a_bounded_sample(spark, monkeypatch):
    rows = [(i, f"w{i % 70} text of language number {i % 70}", f"l{i % 70:02d}") for i in range(700)]
    rows += [(None, "one text that is repeated", "same")] * 400 + [(1, "another one that is repeated", "same")] * 400
    seen = []
    monkeypatch.setattr(langid, "ROWS", 140)
    monkeypatch.setattr(langid, "train", lambda x, y, classes, **k: seen.append((len(x), classes)))
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    n, classes = seen[0]
    assert classes == [*[f"l{i:02d}" for i in range(70)], "same", langid.NOISE] and n <= 140 + 140 // 8 + 1


def test_letters():
    assert langid.has_letter("1 é") and not any(langid.has_letter(t) for t in ("²½①Ⅷ", "12 .,", "_", ""))
    got = langid.predict(pd.Series(["²½①Ⅷ", "word"]), langid.train(np.zeros((1, langid.WINDOW + 3), np.uint8), np.array([0]), ["en"], epochs=1))
    assert got["lang_pred"].tolist() == ["und", "en"] and got["score"][0] == 0
