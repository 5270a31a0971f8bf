import numpy as np

from rallyspark.llm import quality


def test_labelled_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(docs, labels).join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = [r.kept for r in got if r.quality == 1], [r.kept for r in got if r.quality == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.1
    kept = quality.kept_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == quality.classify(docs, labels).where("kept").count()


def test_sparse_sites_shrink_to_their_prior(spark):
    rows = [(f"h{i % 10}", "p", 3.0 if (i % 10) % 2 else -3.0) for i in range(4000)] + [("rare", "q", -3.0), ("few", "q", -3.0), ("few", "q", -3.0)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, evidence double")
    sites, by = quality.site_sums(scored)
    got = {(r.host, r.path): r for r in quality.combined(scored, sites, by).collect()}
    assert abs(by.rate - 0.5) < 0.02
    assert got["h1", "p"].path_rate > 0.9 and got["h0", "p"].path_rate < 0.1
    assert abs(got["rare", "q"].path_rate - by.rate) < 1e-9  # a site's only document says nothing about its site
    assert 0.1 < got["few", "q"].path_rate < 0.5  # one other document moves it part of the way


def test_awkward_rows(spark, docs, wide, labels, empty):
    got = quality.classify(wide, labels, "source", "lang").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(not r.kept and r.score == 0 and r.evidence is None for r in got if r.doc_id in (3, 4))
    kept = quality.kept_documents(wide, labels)
    assert kept.columns == wide.columns
    no_labels = labels.where("false")
    assert quality.classify(docs, no_labels).where("kept").count() == docs.where("text <> ''").count()
    assert quality.classify(empty, labels).count() == 0 and quality.kept_documents(empty, no_labels).count() == 0
    one_kind = labels.where("quality = 1")
    assert quality.classify(docs, one_kind).where("kept").count() == docs.where("text <> ''").count()


def test_posteriors_by_hand(spark, docs, wide, labels):
    """Every step after the evidence, in plain Python over all rows."""
    rows = quality.classify(wide, labels).collect() + quality.classify(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")).collect()
    cut = docs.count()

    def strength(groups):
        some = [(p, good / n, n) for p, good, n in groups if n > 1]
        chance, over = sum(p * (1 - p) for p, _, _ in some), sum(p * (1 - p) * (n - 1) for p, _, n in some)
        if not over:
            return 100.0
        between = max(1e-6, (sum(n * (m - p) ** 2 for p, m, n in some) - chance) / over)
        return min(1000.0, max(1.0, 1 / min(between, 0.999) - 1))

    good_of = lambda r: 1 / (1 + np.exp(-r.evidence))
    for part in (rows[:cut], rows[cut:]):
        paths, hosts = {}, {}
        for r in part:
            if r.evidence is not None:
                for table, k in ((paths, (r.host, r.path)), (hosts, r.host)):
                    n, g = table.get(k, (0, 0.0))
                    table[k] = n + 1, g + good_of(r)
        total = sum(n for n, _ in hosts.values())
        rate = min(0.999, max(0.001, sum(g for _, g in hosts.values()) / total))
        kh = strength([(rate, g, n) for n, g in hosts.values()])
        kp = strength([((hosts[h][1] + kh * rate) / (hosts[h][0] + kh), g, n) for (h, _), (n, g) in paths.items()])
        for r in part:
            if r.evidence is None:
                assert (r.score, r.kept) == (0, False)
                continue
            (n, g), (hn, hg) = paths[r.host, r.path], hosts[r.host]
            h = (hg - good_of(r) + kh * rate) / (hn - 1 + kh)
            q = (g - good_of(r) + kp * h) / (n - 1 + kp)
            score = 1 / (1 + np.exp(-(r.evidence + np.log(q / (1 - q)) - np.log(rate / (1 - rate)))))
            assert abs(r.host_rate - h) < 1e-9 and abs(r.path_rate - q) < 1e-9 and abs(r.score - score) < 1e-9 and r.kept == (r.score >= quality.KEEP)
