import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm import bpe
from quillspan.llm.queries import vocab_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocab_path())


ODD = "aaab  \n\t\r\x1c\x1d\x85\xa0'sStre vémlld12٣½_-.,<|endoftext|>日本😀​ 　İß"


def test_same_ids_as_the_library(library):
    rng = random.Random(5)
    texts = ["", "<|endoftext|>", "a" * 999, " " * 50 + "x", "\0special<|endoftext|>"] + ["".join(rng.choice(ODD) for _ in range(rng.randrange(80))) for _ in range(500)]
    voc = bpe.vocabulary(vocab_path())
    for text, ids in zip(texts, bpe.encode_block(voc, texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert bpe.decode_ids(voc, ids) == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_round_trip(text):
    voc = bpe.vocabulary(vocab_path())
    assert bpe.decode_ids(voc, next(iter(bpe.encode_block(voc, [text])))) == text


def test_operators(edges, docs_of, library):
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(edges, vocab_path()).collect()}
    assert digests[1]["n_tokens"] == 0 and digests[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert digests[6]["decoded_sha256"] == hashlib.sha256("naïve 日本語 text 😀 with marks".encode()).hexdigest()
    whole = bpe.decode(bpe.encode(edges, vocab_path()), vocab_path())
    assert whole.columns == [*edges.columns, "token_ids", "decoded"]
    for r in whole.collect():
        assert r["decoded"] == (r["text"] or "") and r["token_ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    again = bpe.encode(edges, vocab_path(), decoded_col="text")
    assert sorted(r["text"] for r in again.collect()) == sorted(r["decoded"] for r in whole.collect())
    assert bpe.encode(docs_of([]), vocab_path()).count() == 0
