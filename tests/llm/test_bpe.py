import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(texts):
    return [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in bpe.encoder(PATH).encode(texts)]


def test_every_whole_token_is_one_token_of_the_library(library):
    whole = bpe.load(PATH).whole()
    assert len(whole) > 50_000
    for b, i in random.Random(1).sample(sorted(whole.items()), 300):
        letters = "".join(bpe.byte_letters()[x] for x in b)
        assert [t.id for t in library.model.tokenize(letters)] == [i]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab the's 12\n\t .,é漢😀\u0558"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text_encodes_and_counts_as_in_the_library(library, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert ids_of([text]) == [want]
    assert bpe.count_text(PATH, text) == len(want)
    assert bpe.encoder(PATH).decode(next(bpe.encoder(PATH).encode([text]))) == library.decode(want, skip_special_tokens=False)


def test_texts_of_the_corpus(library, texts):
    some = [t for _, t in texts][:120] + ["a" * 3000, "ab" * 700 + "c", " " * 500, "<|endoftext|>", "x<|endoftext|><|endoftext|> y"]
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    assert ids_of(some) == want
    assert [bpe.count_text(PATH, t) for t in some] == [len(w) for w in want]


def test_odd_rows(odd_docs, odd_rows, no_docs, library):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in bpe.count_tokens(odd_docs, PATH, limit=100).collect())
    want = [len(library.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows]
    assert got == sorted((str(r[0]), len((r[1] or "").encode()), n, n > 100) for r, n in zip(odd_rows, want, strict=True))
    out = bpe.encode_decode(odd_docs, PATH, carry=("doc_id", "n_tokens", "bytes"), keep=("decoded",))
    assert out.columns == ["doc_id", "bytes", "n_tokens", "ids_sha256", "decoded_sha256", "decoded"]
    rows = out.collect()
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(r[0]), r[1] or "") for r in odd_rows)
    assert all(r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest() for r in rows)
    assert bpe.count_tokens(no_docs, PATH).count() == bpe.encode_decode(no_docs, PATH).count() == 0
