"""What every operator of this subpackage shares: table access and cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder and read back, so that a lost executor costs no recomputation.

    ``spark.checkpoint.dir`` is read from the session; a folder of our own is set only where it is unset, as in tests.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; on one machine, where it is unset, a folder of our own; on a cluster without it this raises, as no other executor would see a local folder."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    return named or context.getCheckpointDir()


_written: list[str] = []


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: for wide rows, which a checkpoint would keep as they lie in memory. ``remove_stored`` takes it back."""
    path = f"{shared_folder(df.sparkSession)}/factloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.parquet(path)


def remove_stored(spark: SparkSession) -> int:
    """Deletes all that ``stored`` wrote from this driver, once no result that reads it is needed any more; how many folders these were."""
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def id_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many signs more as no column of ``df`` has it, in small letters or large."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
