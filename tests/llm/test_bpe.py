import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from factloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, public_tokenizers.PATTERN)


def test_random_texts(codec, reference):
    random.seed(1)
    alphabet = "abcdefghij ETAOIN  \n\t.,'s0123456789éüñß你好🙂"
    for _ in range(400):
        text = "".join(random.choice(alphabet) for _ in range(random.randint(0, 200)))
        ids = codec.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_long_pieces(codec, reference):
    for text in ("x" * 3000, "ab" * 2000, " " * 500, "9" * 999, "".join(random.choice("abcdef") for _ in range(4000))):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_append_and_edit(codec, reference):
    word = "internationalisationally"
    t = bpe.PrefixTable(codec.v)
    for i, c in enumerate(word):
        t.append(c.encode())
        assert t.tokens() == reference.encode_ordinary(word[: i + 1])
    t.replace(5, 9, b"xyz")
    assert t.tokens() == reference.encode_ordinary(word[:5] + "xyz" + word[9:])


def test_documents(documents, reference):
    texts = {r.doc_id: r.text or "" for r in documents.collect()}
    rows = bpe.encode_digests(documents, PATH, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert (r.ids, r.n_tokens, r.round_trip) == (ids, len(ids), True)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(odd, nothing):
    rows = bpe.encode_documents(odd, PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == 10
    assert [r.ids for r in rows if r.doc_id in (2, 3)] == [[], []]
    assert bpe.encode_digests(nothing, PATH, public_tokenizers.PATTERN).count() == 0
