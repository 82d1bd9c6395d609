import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from factloom.llm import queries, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(small)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, items):
    """[(doc_id, n_features, weight, score, rank)] by definition."""
    source, target = Counter(), Counter()
    for _, text in docs:
        source.update(features(text)[1])
    for text in items:
        target.update(features(text)[1])
    s_all, t_all = sum(source.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    out = [(r[0], r[2], r[3], r[4], k + 1) for k, r in enumerate(drawn)]
    left = Counter(rows) - Counter(drawn)
    return sorted(out + [(r[0], r[2], r[3], r[4], None) for r in left.elements()], key=repr)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect()), key=repr)


def test_query_is_the_definition(spark, sf_dir, documents):
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got(queries.op11_importance_resampling(spark, sf_dir)) == plain(docs, items)


def test_shift_is_appending_zero_bytes():
    rng = random.Random(1)
    for n in [0, 1, 2, 63, 64, 65, 127, 128, 1000, 4097, 1 << 20]:
        a, b = rng.randbytes(9), rng.randbytes(n)
        shifted = resample.shift(np.array([zlib.crc32(a)], dtype=np.uint32), np.array([n]))[0]
        assert zlib.crc32(a + b) == shifted ^ zlib.crc32(b)


@pytest.mark.parametrize("size", [1, 16, 1 << 20])
def test_slices_change_nothing(monkeypatch, size):
    monkeypatch.setattr(resample, "SLICE", size)
    texts = ["One two, three: four-five SIX", "", None, "a", "ÄÖ äö ſharp 你好 x", "w" * 300 + " é " + "v" * 100, "9 8 7 7 7"]
    n_words, found = Counter(), []
    for text, words, pairs in resample._features([None if t is None else t.encode() for t in texts], 10000, 3):
        for t, w in zip(text.tolist(), words.tolist()):
            n_words[t] += w
        found += list(zip(*pairs.tolist()))
    for k, t in enumerate(texts):
        n, wanted = features(t)
        assert n_words[k] == n and sorted(b for x, b in found if x == k) == sorted(wanted)


def test_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = spark.createDataFrame([("alpha beta gamma",), (None,)], "text string")
    more = odd.unionByName(odd.where("doc_id = 4").withColumn("doc_id", odd.doc_id * 0 + 4))
    docs = rows + [r for r in rows if r[0] == 4]
    assert got(resample.resample(more, target)) == plain(docs, ["alpha beta gamma", None])
    assert got(resample.resample(nothing, target)) == []
    assert got(resample.resample(odd, target.limit(0))) == plain(rows, [])


def test_repeated_rows_are_drawn_each_and_kept_columns_stay(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(7, text, "x", 5)] * 40 + [(None, text, "y", 6)] * 20, "doc_id long, text string, rank string, weight int")
    out = resample.resample(docs, docs, keep=("text", "rank", "weight"))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "n_features", "weight", "score", "rank"]
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3] and len(rows) == 60
    assert {r.text for r in rows} == {text}
