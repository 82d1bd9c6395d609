"""The stages one by one and together, against brute force on a small table."""

import hashlib

import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import bpe, decontam
from test_quality import one_score


def test_stages(spark, sf_dir, documents):
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:4]:
        new = stage(spark, docs, sf_dir).cache()
        assert new.schema.names == documents.schema.names
        assert new.count() > 0.5 * docs.count(), name
        docs = new
    ids = {r.doc_id for r in docs.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [decontam.normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert not any(i in decontam.normal(t) for t in texts.values() for i in items)
    rows = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(rows) == ids
    codec = bpe.codec(public_tokenizers.path(corpus_pipeline.VOCABULARY), public_tokenizers.PATTERN)
    for i, t in texts.items():
        assert rows[i].ids == codec.encode(t)
        assert rows[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_copies_go_but_one(spark, sf_dir):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(5, text, "en", "s", 1), (2, text, "en", "s", 1), (7, "quite another text of some seven words", "en", "s", 1), (None, text, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r.doc_id) for r in corpus_pipeline.one_of_each_group(spark, docs, sf_dir).collect()) == ["2", "7", "None"]


def test_a_text_of_its_own_stays_beside_a_copy(spark, sf_dir):
    a, c = "one two three four five six seven eight nine ten", "some quite other words stand in this text here and now"
    rows = [(3, a), (5, a), (5, c), (5, c), (6, c + " too"), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' AS text_hash")
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect() if r.text) == [(3, a), (5, c), (5, c)]
    assert kept.count() == 5


def test_near_duplicates_stage_against_brute_force(spark, sf_dir, documents):
    import test_neardup

    want = test_neardup.brute([(r.doc_id, r.text) for r in documents.collect()], 5, 80)
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, documents, sf_dir).collect()}
    assert kept == {i for i, (_, low) in want.items() if i == low}


def test_quality_stage_against_the_scores(spark, sf_dir, documents):
    """The stage keeps just the documents that the model, fitted and applied apart from Spark's tasks, gives an even chance."""
    from factloom.llm import quality

    model = quality.train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = documents.collect()
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, documents, sf_dir).collect()}
    want = {r.doc_id for r in rows if one_score(model, r.text) >= 0.5}
    assert kept == want


def test_redaction_updates_the_length(spark, sf_dir):
    docs = spark.createDataFrame([(1, "write a@b.org", "en", "s", 13), (2, None, "en", "s", None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs, sf_dir).collect()}
    assert (rows[1].text, rows[1].n_chars, rows[2].text) == ("write <email>", 13, None)


def test_odd_rows_pass_through(spark, sf_dir, odd, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf_dir).count() == 0
    small = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, small, sf_dir).count() >= 5


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
def test_registered(n):
    assert sum(q.startswith(f"op{n}_") for q in entry.queries()) == 1
