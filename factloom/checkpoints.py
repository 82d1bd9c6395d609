"""Where iterative plans cut their lineage: the folder that the cluster names in spark.checkpoint.dir, on one machine one of our own where it is unset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, in folders by ``parts``, read again: columns and folders that a reader doesn't ask for are not read."""
    path = f"{shared_folder(df.sparkSession)}/facts-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Turns:
    """A state that is written anew each turn, as Parquet in the shared folder; the turn before is removed then, so that disk holds two at most.

    Read as a table it carries nothing of the plan that made it: what the optimizer derives about columns of a checkpoint (its constraints) would grow with each turn.
    Only the last DataFrame given out can be read.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        before, self.path = self.path, f"{shared_folder(self.spark)}/turn-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        if before is not None:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(self.path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the cluster's file system."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
