import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from demandlens.llm.bpe import TreeBpe, encode, encode_digests, encoder, load_ranks, text_encoder

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(PATH), special_tokens={})


def ids(text, spaced):
    return np.frombuffer(text_encoder(PATH, PATTERN, spaced)(text), "<u4").tolist()


@pytest.mark.parametrize("spaced", [False, True])
@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab éñ中\n\t\r\x1c\x85  '!1stre")) | st.text())
def test_texts_encode_as_the_library_does(spaced, text):
    text = text.encode("utf-8", "ignore").decode()
    got = ids(text, spaced)
    assert got == REFERENCE.encode_ordinary(text)
    assert encoder(PATH).decode(np.array(got, "<u4")) == text.encode()


def test_long_pieces():
    rng = random.Random(4)
    for text in ("a" * 3000, "ab" * 999, "".join(rng.choice("abcdeé") for _ in range(20_000)), "=" * 5001, " " * 700 + "x"):
        assert ids(text, True) == REFERENCE.encode_ordinary(text)


def test_joining_is_associative_and_equals_merging():
    bpe, rng = TreeBpe(load_ranks(PATH)), random.Random(6)
    for _ in range(300):
        parts = [bytes(rng.choice(b"thea nding\xc3\xa9") for _ in range(rng.randint(0, 40))) for _ in range(3)]
        a, b, c = map(bpe.merge, parts)
        whole = bpe.merge(b"".join(parts))
        assert bpe.join(bpe.join(a, b), c) == bpe.join(a, bpe.join(b, c)) == whole == bpe._merge_long(b"".join(parts))


def test_odd_documents(odd_docs, no_docs):
    want, want_ids = [], []
    for r in odd_docs.collect():
        found = np.array(REFERENCE.encode_ordinary(r.text or ""), "<u4").tobytes()
        data = (r.text or "").encode()
        want.append((r.doc_id, len(found) // 4, hashlib.sha256(found).hexdigest(), hashlib.sha256(data).hexdigest()))
        want_ids.append((r.doc_id, found, len(found) // 4, data))
    for spaced in (False, True):
        assert sorted(map(tuple, encode_digests(odd_docs, PATH, PATTERN, spaced).collect()), key=repr) == sorted(want, key=repr)
    got = [(i, bytes(a), n, bytes(d)) for i, a, n, d in encode(odd_docs, PATH, PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want_ids, key=repr)
    assert encode(no_docs, PATH, PATTERN).count() == 0
