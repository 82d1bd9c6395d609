"""From raw documents to token ids: reject, deduplicate, decontaminate, redact, encode.

``STAGES`` lists the stages in order. Each takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a
DataFrame; all but the last return the columns of documents. ``run`` applies them, each stage's rows written as Parquet in
the cluster's shared folder and read again. SQL can't express the stages, so there is no ``ORACLE_SQL``: the tests hold them
against brute force.

In every stage an empty table stays empty, repeated rows are treated each by itself (but as copies of each other by the
near-duplicate stage), and further columns, of whatever names, come out as they went in (the last stage doesn't read them).
Null and empty texts are scored like any other, are linked with nothing, hold no benchmark item and no personal data, and have no tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontam, neardup, pii, quality
from factloom.llm.common import free_name, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model gives at least an even chance of the good label; texts alone decide."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_scores(docs, model).where(F.col("quality_score") >= 0.5).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate texts, five-word shingles at a similarity of 0.8, the rows of the smallest id. A row goes only for its own text: of an id with several texts those without a copy stay. Rows without id stay."""
    of_text = free_name(docs, "of_text")
    lost = neardup.near_duplicates(docs, size=5, share=80).where("NOT text_kept").select("doc_id", F.col("text_hash").alias(of_text)).distinct()
    return docs.withColumn(of_text, F.xxhash64("text")).join(lost.hint("shuffle_hash"), ["doc_id", of_text], "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontam.without_passages(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    before, now = free_name(docs, "before"), F.length("text")
    clean = pii.redact(docs.withColumn(before, F.length("text")))
    return clean.withColumn("n_chars", F.when(now != F.col(before), now.cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of the ids and of the bytes they decode to."""
    return bpe.encode_digests(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("tokens", token_ids),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else stored(docs), sf_dir)
    return docs
