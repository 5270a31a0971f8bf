import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from rallyspark.llm import neardup  # noqa: E402
from rallyspark.llm.common import store  # noqa: E402
from tests.llm.test_near_dedup import brute  # noqa: E402
from tests.llm.test_packing import PATH, held  # noqa: E402
from tests.llm.test_secrets import base  # noqa: E402


def test_stages_on_whole_tables(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, seen = {"documents": {r.doc_id: r.text for r in docs.collect()}}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = store(stage(spark, seen, sf_dir), name)
        assert seen.columns == docs.columns
        kept[name] = {r.doc_id: r.text for r in seen.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert all(labels.get(d) != 1 for d in set(kept["documents"]) - set(kept["quality"]))
    assert set(kept["language"]) == {d for d, t in kept["quality"].items() if any(c.isalpha() for c in t)}
    groups = brute(list(kept["language"].items()), 5, 80)
    assert set(kept["near_dedup"]) == {d for d, c in groups.items() if d == c}
    assert set(kept["secrets"]) == set(kept["near_dedup"])
    for d, text in kept["near_dedup"].items():
        assert (kept["secrets"][d] == text) or base(text)
        assert not base(kept["secrets"][d])
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, sf_dir).collect()
    held(rows, kept["secrets"], Tokenizer.from_file(PATH))


def test_awkward_documents(spark, wide, empty, sf_dir):
    for source in (wide, empty):
        docs = source
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = store(stage(spark, docs, sf_dir), "stage")
            assert docs.columns == source.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 0


def test_kept_documents_by_words(spark):
    rows = [(1, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (2, "a b c d e f g h i j k l m n o p q r s t u v w x y z"), (3, "something else entirely")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.kept_documents(docs, 5, 80).collect()) == [1, 3]
