"""The thin queries over whole tables: each applies its operator with production parameters and derives the columns to compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import annsearch, bpe, decontam, fixity, htmlmain, lm, neardup, packing, pii, quality, resample, sharding, spelling
from factloom.llm.common import id_crc, stored, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACKED = "byte_bpe_50k.json"


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op2_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica in which every 500th is altered, every 700th is lost and every 900th has a strange one beside it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    replica = pages.where("page_id % 700 != 5 OR page_id IS NULL").withColumn("html", F.when(F.col("page_id") % 500 == 3, F.concat("html", F.lit("!"))).otherwise(F.col("html")))
    strange = pages.where("page_id % 900 = 7").withColumn("page_id", -1 - F.col("page_id"))
    archive = stored(fixity.records(pages))
    found = fixity.byte_ranges(fixity.audit(archive, fixity.records(replica.unionAll(strange))), archive)
    return found.select(fixity.key_of(F.col("file"), F.col("offset")).alias("page_id"), "status", "left_digest", "right_digest", "byte_offset", "n_bytes")


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.select("doc_id", "pii", F.filter("pii", lambda x: x["kind"].isin(*pii.BASE)).alias("base"))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return base.select("doc_id", *counts, F.sha2(F.encode(pii.joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.with_scores(documents, quality.train(documents, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op4_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return annsearch.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op5_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op8_edit_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_texts(table(spark, sf_dir, "pages"))


def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=3, share=85).select("doc_id", "n_shingles", "component_id", "kept")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKED))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_hilbert_sharding, op2_merkle_fixity, op3_pii_spans, op4_kmeans_tree, op5_backoff_lm, op6_byte_bpe, op7_quality_gam, op8_edit_decontamination, op9_minhash_neardup, op10_template_text, op11_importance_resampling, op12_best_fit_packing, op13_spelling_variants)
}
ORACLE_SQL: dict[str, str] = {
    "op2_merkle_fixity": """WITH n AS (SELECT page_id, url, html, strlen(url) + strlen(html) + length(CAST(strlen(html) AS VARCHAR)) + length('WARC/1.0..WARC-Type: response..WARC-Target-URI: ..Content-Length: ........') AS n_bytes FROM pages),
 a AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY page_id // 4096 ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS byte_offset FROM n)
 SELECT page_id, CASE WHEN page_id % 700 = 5 THEN 'missing' ELSE 'changed' END AS status, sha256(url || chr(10) || html) AS left_digest, CASE WHEN page_id % 700 = 5 THEN NULL ELSE sha256(url || chr(10) || html || '!') END AS right_digest,
  CAST(byte_offset AS BIGINT) AS byte_offset, CAST(n_bytes AS BIGINT) AS n_bytes FROM a WHERE page_id % 500 = 3 OR page_id % 700 = 5
 UNION ALL SELECT -1 - page_id, 'extra', NULL, sha256(url || chr(10) || html), NULL, NULL FROM pages WHERE page_id % 900 = 7""",
}
