import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rallyspark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
SIGNS = list("abcdeeeiiinnstthrlo") + [" ", "  ", "   ", "\n", "\t", ".", ",", "1", "22", "é", "ñ", "日", "本", "😀", "▁", "the", " the", "ing", "tion", "<s>", "</s>", "<0x41>", "‍", "́", "ﬁ", "Ω"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts(library):
    rng = random.Random(3)
    texts = ["", " ", "  a", "a  ", "\n", "▁", "▁a", "aaaaaaaaaaaaaaaa", "abababababab"] + ["".join(rng.choices(SIGNS, k=rng.randint(1, 60))) for _ in range(3000)]
    model = pieces.piece_model(PATH)
    for text, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert model.decode(ids).decode() == library.decode(want), text


def test_digests(spark, library, docs, wide, empty):
    got = pieces.digests(wide, PATH).collect()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda t: tuple(map(str, t))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=key) == sorted(want, key=key)
    assert pieces.digests(empty, PATH).count() == 0
    whole = {r.doc_id: r for r in pieces.encode_decode(docs, PATH).collect()}
    assert whole[1].decoded == docs.where("doc_id = 1").first().text and whole[3].n_tokens == 2
