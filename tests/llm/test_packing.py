import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rallyspark.llm import packing, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def held(rows, texts, tokenizer, most=4096):
    """Check the pieces of documents with unique ids; returns sequence sizes."""
    ids = {d: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for d, t in texts.items()}
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        docs[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans, whole in [(docs[d], len(ids[d])) for d in ids] + [(s, None) for s in sequences.values()]:
        at = 0
        for a, n in sorted(spans):
            assert a == at
            at += n
        assert at == whole if whole else at <= most
    return [sum(n for _, n in s) for s in sequences.values()]


def test_packs_all_tokens(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    sizes = held(rows, {r.doc_id: r.text for r in docs.collect()}, tokenizer)
    assert all(n & (n - 1) == 0 for n in sizes)
    loads = defaultdict(int)
    for r in rows:
        loads[r.step_group] += r.length
    assert len({r.tier for r in rows}) >= 3 and max(loads.values()) <= 2 * packing.STEP


def test_awkward_rows(spark, docs, wide, empty, tokenizer):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = packing.pack(wide.where("doc_id is not null").dropDuplicates(["doc_id"]), PATH).collect()
    held(rows, {r.doc_id: r.text for r in one.collect()}, tokenizer)
    assert {r.doc_id: r.doc_tokens for r in rows}[3] == 1
    every = packing.pack(wide, PATH).collect()
    assert sum(r.length for r in every if r.doc_id == 7) == 2 * next(r.doc_tokens for r in every if r.doc_id == 7)
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, tiers=(512, 3000))


def test_ids_of_odd_texts(tokenizer):
    texts = ["", "İstanbul ΣΑΣ", "a<|endoftext|>b", "<|startoftext|> x", "don't  stop\t\nnow", "ÀÉ ßﬁ", "日本語のテキスト", "x" * 300, "a b c", "é ́", "1234 5,6.7!!", "'s 's'S", "🙂🙂 ok"]
    for text, ids in zip(texts, tokens.WordIds(PATH).ids(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text
