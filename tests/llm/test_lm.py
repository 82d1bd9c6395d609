import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import lm


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def brute(rows, k):
    """The automaton walked token by token."""
    learns = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 != 0
    c, cc = Counter(), Counter()
    for i, t in rows:
        if learns(i):
            w = tokens(t)
            c.update(w)
            cc.update(zip(["<s>", *w[:-1]], w, strict=True))
    n, v = sum(c.values()), len(c)
    p = lambda w: (c[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for i, t in rows:
        base = score = 0.0
        state = "<s>"
        for w in tokens(t):
            u = c["</s>"] if state == "<s>" else c[state]
            base += math.log10(p(w))
            if cc[state, w]:
                score += math.log10((cc[state, w] + k * p(w)) / (u + k))
            else:
                score += math.log10(k / (u + k)) + math.log10(p(w))  # the failure arc
            state = w
        out.append((i, not learns(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, base, score))
    return out


@pytest.mark.parametrize("block", [lm.BLOCK, 40_000, 2_000])
def test_documents(documents, block):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: tuple(r) for r in lm.score_documents(documents, block=block).collect()}
    for want in brute(rows, lm.K):
        assert got[want[0]][:5] == want[:5]
        assert got[want[0]][5:] == pytest.approx(want[5:], rel=1e-9)


def test_context_helps_held_out_texts(spark):
    rows = [r for r in lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_packing():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        assert (lm._unpack_sorted(lm._pack_sorted(x)) == x).all()


def test_odd_rows(odd, nothing):
    rows = lm.score_documents(odd).collect()
    want = brute([(r.doc_id, r.text) for r in odd.collect()], lm.K)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.score, 6)) for r in rows) == sorted((repr(w[0]), w[2], w[3], round(w[6], 6)) for w in want)
    assert lm.score_documents(nothing).count() == 0


def test_only_buckets_that_occur_are_asked():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    for buckets in (1, 7, 100_000):
        b = lm._bucket(h, buckets)
        held = lm._held(b)
        assert [i for i, _, _ in held] == sorted(set(b.tolist()))
        assert np.concatenate([h[x:y] for _, x, y in held]).tolist() == h.tolist()
        assert all((b[x:y] == i).all() for i, x, y in held)
    assert lm._held(lm._bucket(np.zeros(0, np.uint64), 3)) == []
