from bisect import bisect_right
from math import exp, isclose

import numpy as np

from factloom.llm import quality, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op7_quality_gam(spark, sf).collect()]
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 50
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def one_score(model, text):
    """The score of one text, table entry by table entry."""
    x = quality.features(text)
    raw = model.base + sum(t[bisect_right(list(e), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    for (i, j), t in zip(model.pairs, model.pair_tables, strict=True):
        raw += t[bisect_right(list(model.pair_edges[i]), x[i])][bisect_right(list(model.pair_edges[j]), x[j])]
    return 1 / (1 + exp(-raw))


def test_scores_are_sums_of_table_entries(spark, documents, sf_dir):
    model = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = quality.with_scores(documents, model).collect()
    assert rows and all(isclose(r.quality_score, one_score(model, r.text), rel_tol=1e-9) for r in rows)


def test_the_fit_sees_just_the_training_rows(spark, documents, sf_dir):
    """The same tables as a fit on rows chosen in plain Python; repeated rows change nothing."""
    from zlib import crc32

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    rows = sorted((quality.features(texts[r.doc_id]), r.quality) for r in labels.collect() if r.doc_id in texts and crc32(str(r.doc_id).encode()) % 3 != 1)
    want = quality.Gam().fit(np.array([x for x, _ in rows]), np.array([y for _, y in rows], dtype=float))
    for docs in (documents, documents.unionAll(documents)):
        got = quality.train(docs, labels)
        assert got.pairs == want.pairs
        assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got.tables, want.tables, strict=True))


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.Gam().fit(x[:2000], y[:2000])
    assert model.pairs[0] == (0, 1)
    assert np.mean((model.score(x[2000:]) >= 0.5) == y[2000:]) > 0.85


def test_one_label_or_none():
    empty = quality.Gam().fit(np.zeros((0, 3)), np.zeros(0))
    assert empty.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    ones = quality.Gam().fit(np.zeros((9, 3)), np.ones(9))
    assert ones.score(np.zeros((1, 3)))[0] > 0.5


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    out = quality.with_scores(odd, model)
    assert out.count() == 10
    assert sorted(out.columns) == sorted(odd.columns)
    assert quality.with_scores(nothing, model).count() == 0
    assert quality.train(nothing, labels.limit(0)).tables == []
