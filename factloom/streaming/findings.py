"""A cache of findings that follows changes: what a change can reach over reversed dependencies is evaluated again, and only the buckets that hold such modules are written.

Under one folder, in folders by bucket (a hash of the path): ``findings`` and ``modules`` (path, content_hash). Findings are written first and
hashes last, so that a run that broke off is made up by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.checkpoints import cut, remove, stored
from factloom.operators.components import reached
from factloom.operators.sets import hash_diff

BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the cache; missing: empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _replace(rows: DataFrame, path: str, touched: list[int], buckets: int) -> None:
    """The touched buckets' folders hold just ``rows`` afterwards; the others aren't written."""
    spark = rows.sparkSession
    held = stored(rows.withColumn("bucket", _bucket(buckets)))  # the folder that is written may be read by the rows
    left = {r.bucket for r in held.select("bucket").distinct().collect()}  # at most one number a bucket
    held.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - left:
        remove(spark, f"{path}/bucket={b}")


def affected(changed: DataFrame, edges: DataFrame) -> DataFrame:
    """(path): the changed paths and all that depend on them, by whatever number of steps; edges are (from_path, to_path)."""
    back = edges.where("to_path IS NOT NULL").select(F.col("to_path").alias("src"), F.col("from_path").alias("dst"))
    return reached(back, changed.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))


def update(modules: DataFrame, edges: DataFrame, evaluate: Callable[[DataFrame], DataFrame], path: str, schema: str, buckets: int = BUCKETS) -> dict[str, int]:
    """Brings the cache under ``path`` to the state of ``modules`` (path, content_hash) with its ``edges``; how many modules there are, changed, were evaluated, and how many buckets were written.

    ``evaluate`` gives the findings (of ``schema``, which has a column path) of the modules it is given, and may look at all that these depend on. A module whose edges
    changed has changed itself, so that the edges of now are enough; a removed one is reached over the edges that still name it.
    """
    spark = modules.sparkSession
    now = cut(modules.select("path", "content_hash"))
    before = _read(spark, f"{path}/modules", "path string, content_hash string, bucket int").select("path", "content_hash")
    changes = cut(hash_diff(before, now))
    if changes.isEmpty():
        return {"modules": now.count(), "changed": 0, "evaluated": 0, "buckets": 0}
    again = cut(affected(changes, edges).distinct())
    todo = cut(now.join(again, "path", "left_semi").select("path"))
    touched = [r.bucket for r in again.union(changes.select("path")).select(_bucket(buckets).alias("bucket")).distinct().collect()]  # at most one number a bucket
    inside = _bucket(buckets).isin(touched)
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    kept = _read(spark, f"{path}/findings", f"{schema}, bucket int").where(F.col("bucket").isin(touched)).join(again, "path", "left_anti").select(*names)
    _replace(kept.unionByName(evaluate(todo).select(*names)), f"{path}/findings", touched, buckets)
    _replace(now.where(inside), f"{path}/modules", touched, buckets)
    return {"modules": now.count(), "changed": changes.count(), "evaluated": todo.count(), "buckets": len(touched)}


def findings(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All findings of the cache."""
    return _read(spark, f"{path}/findings", f"{schema}, bucket int").drop("bucket")
