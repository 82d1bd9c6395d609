import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from factloom.llm import packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cut_up(docs, library, capacity=2048):
    """{(doc_id, piece, start, length, crc): rows} by definition."""
    out = []
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        starts = [0] if len(ids) <= capacity else [0, *range(first, len(ids), capacity)]
        for k, at in enumerate(starts):
            part = ids[at : starts[k + 1] if k + 1 < len(starts) else len(ids)]
            out.append((doc_id, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return out


def plain_best_fit(lengths, capacity):
    bins = []
    for s in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(bins) if r >= s]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return bins


def check(rows, wanted, capacity=2048):
    assert sorted(map(repr, (r[:5] for r in rows))) == sorted(map(repr, wanted))
    held = defaultdict(list)
    for r in rows:
        held[r[5]].append((r[6], r[3]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(n for _, n in p) for p in held.values()) == sorted(plain_best_fit([w[3] for w in wanted], capacity))


def rows_of(df):
    return [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in df.collect()]


def test_query_is_best_fit_decreasing(spark, sf_dir, documents, library):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    check(rows_of(queries.op12_best_fit_packing(spark, sf_dir)), cut_up(docs, library))


def test_runs_are_best_fit_one_by_one():
    rng = random.Random(5)
    for trial in range(300):
        capacity = rng.choice([1, 7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        counts = {s: lengths.count(s) for s in lengths}
        runs, bins = packing.best_fit(counts, capacity)
        used = defaultdict(list)
        for rank, s in enumerate(sorted(lengths)):
            first, first_bin, q, offset, length = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1]
            assert length == s
            used[first_bin + (rank - first) // q].append((offset + (rank - first) % q * s, s))
        assert len(used) == bins
        assert sorted(capacity - sum(s for _, s in x) for x in used.values()) == sorted(plain_best_fit(lengths, capacity))
        for x in used.values():
            assert all(a + s == b for (a, s), (b, _) in zip(sorted(x), sorted(x)[1:])) and min(x)[0] == 0


def test_runs_are_few_whatever_the_pieces():
    rng = random.Random(6)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    runs, bins = packing.best_fit(counts)
    assert len(runs) < 20_000 and bins >= sum(s * n for s, n in counts.items()) // 2048


def test_ids_are_those_of_the_library(library):
    encoder = packing.Encoder(PATH)
    rng = random.Random(7)
    signs = [chr(c) for c in [*range(1, 0x2FF), *range(0x600, 0x620), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, *range(0x4E00, 0x4E20), 0xFEFF, 0x1F642]]
    texts = ["".join(rng.choice(signs) for _ in range(200)) for _ in range(200)] + ["a<|endoftext|>b", "x" * 5000, " \n" * 4000, "don't we'll 'S 'LL  \t a", "", "1" * 3000, "中" * 3000]
    for t in texts:
        assert encoder.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_odd_rows(spark, odd, nothing, library):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check(rows_of(packing.pack(odd, PATH)), cut_up(rows, library))
    check(rows_of(packing.pack(odd, PATH, capacity=16)), cut_up(rows, library, 16), 16)
    assert packing.pack(nothing, PATH).collect() == []
    same = spark.createDataFrame([(None, None)] * 5000, "doc_id long, text string")
    check(rows_of(packing.pack(same, PATH)), [(None, 0, 0, 1, zlib.crc32(bytes(4)))] * 5000)


def test_sequences_hold_the_ids(spark, odd, library):
    packed = packing.pack(odd, PATH, capacity=64, with_ids=True)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())


def test_every_sign_is_encoded_as_by_the_library(library):
    encoder = packing.Encoder(PATH)
    signs = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c} {c}{c}1" for c in signs[i : i + 60]) for i in range(0, len(signs), 60)]
    for i in range(0, len(texts), 2000):
        for text, wanted in zip(texts[i : i + 2000], library.encode_batch(texts[i : i + 2000], add_special_tokens=False)):
            assert encoder.ids(text).tolist() == wanted.ids
