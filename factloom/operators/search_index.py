"""A search index beside the texts: which texts hold a run of three signs, so that a search reads those that can match.

Two tables under one folder, each in folders by bucket (a hash of the path): ``texts`` (id, path, content_hash, text), ids distinct in
a bucket, and ``postings`` (gram, start, n, gaps), the ids of the texts that hold a gram, in order, each less the one before. Lists are made of a block of texts at
a time, where the texts lie: ``start`` is the block's first id, and a gram has a row for each block that holds it, so that lists have a bounded length whatever
the number of texts, and only texts are exchanged. A search asks for its grams only (files are sorted by gram), meets the lists of the rarest, and reads the
buckets that remain. Refreshing compares hashes and rewrites the buckets in which a file was added, changed or removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.checkpoints import remove, shared_folder
from factloom.operators.ranking import line_hits

SIGNS = 3
RAREST = 3  # lists that a search meets
BUCKETS = 64  # so many that a bucket holds some thousands of texts


PARTS = 2  # tasks for each shuffle partition of the session
BLOCK = 2_000_000  # pairs of gram and text in a task's memory
_BITS = 21  # of a code point


def grams(low: str) -> list[str]:
    """The distinct runs of three code points of a text in small letters."""
    return list(dict.fromkeys(low[i : i + SIGNS] for i in range(len(low) - SIGNS + 1)))


def _codes(low: str) -> np.ndarray:
    """``grams`` as numbers, in order."""
    c = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.int64)
    found = np.sort(c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])
    return found[np.diff(found, prepend=-1) != 0]


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")


def _write(files: DataFrame, path: str, buckets: int) -> None:
    """Both tables' folders of the files' buckets. Texts come last: hashes are compared with theirs, so that a run that broke off before is made up by the next."""
    parts = PARTS * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = -(-parts // buckets)  # of a bucket, so that every task has texts
    share = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(shares)).cast("int")
    held = files.where("path IS NOT NULL AND text IS NOT NULL").select(_bucket(buckets).alias("bucket"), share.alias("share"), "path", "text").repartition(parts, "bucket", "share")
    in_share = Window.partitionBy("bucket", "share").orderBy("path")
    texts = held.withColumn("id", (F.row_number().over(in_share) - 1) * shares + F.col("share"))
    lists = texts.select("bucket", "share", "id", F.lower("text").alias("low")).mapInArrow(_lists, _LISTS)
    texts = texts.select("bucket", "path", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), "text", "id")
    for name, df, order in (("postings", lists, ("gram", "start")), ("texts", texts, ("id",))):
        df.sortWithinPartitions("bucket", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")


_LISTS = "gram string, start int, n int, gaps array<int>, bucket int"


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lists of a task's texts (bucket, share, id, low), which come in order, a block of one share at a time."""
    block: list[tuple[int, np.ndarray]] = []
    held, place = 0, None
    for b in batches:
        for bucket, share, number, low in zip(*(b.column(c).to_pylist() for c in ("bucket", "share", "id", "low")), strict=True):
            if block and (held >= BLOCK or place != (bucket, share)):
                yield _lists_of(block, place[0])
                block, held = [], 0
            place = bucket, share
            block.append((number, _codes(low)))
            held += len(block[-1][1])
    if block:
        yield _lists_of(block, place[0])


def _lists_of(block: list[tuple[int, np.ndarray]], bucket: int) -> pa.RecordBatch:
    codes = np.concatenate([c for _, c in block])
    ids = np.repeat(np.array([i for i, _ in block], np.int32), [len(c) for _, c in block])
    order = np.argsort(codes, kind="stable")
    codes, ids = codes[order], ids[order]
    at = np.flatnonzero(np.diff(codes, prepend=-1))
    gaps = np.diff(ids, prepend=np.int32(0))
    gaps[at] = ids[at]
    signs = [codes[at] >> 2 * _BITS, codes[at] >> _BITS & (1 << _BITS) - 1, codes[at] & (1 << _BITS) - 1]
    names = ["".join(map(chr, x)) for x in zip(*(c.tolist() for c in signs), strict=True)]
    ends = np.append(at, len(codes)).astype(np.int32)
    same = lambda x: np.full(len(at), x, np.int32)
    columns = [pa.array(names, pa.string()), pa.array(same(block[0][0])), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(gaps.astype(np.int32))), pa.array(same(bucket))]
    return pa.RecordBatch.from_arrays(columns, ["gram", "start", "n", "gaps", "bucket"])


def build(files: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index of files (path, text), paths distinct. Null paths and texts are left out."""
    _write(files, path, buckets)


def refresh(files: DataFrame, path: str, buckets: int = BUCKETS) -> list[int]:
    """Brings the index to the state of ``files``; the buckets that were rewritten."""
    spark = files.sparkSession
    old = _table(spark, path, "texts").select("path", F.col("content_hash").alias("before"))
    new = files.where("path IS NOT NULL AND text IS NOT NULL").select("path", F.sha2(F.encode("text", "UTF-8"), 256).alias("after"))
    changed = old.join(new, "path", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select(_bucket(buckets).alias("bucket")).distinct()
    todo = sorted(r.bucket for r in changed.collect())  # at most one number a bucket
    if todo:
        mine = files.where(_bucket(buckets).isin(todo))
        left = {r.bucket for r in mine.where("text IS NOT NULL").select(_bucket(buckets).alias("bucket")).distinct().collect()}
        _write(mine, path, buckets)
        for b in set(todo) - left:  # nothing is written for a bucket without files
            remove(spark, f"{path}/postings/bucket={b}")
            remove(spark, f"{path}/texts/bucket={b}")
    return todo


_SCHEMAS = {"texts": "path string, content_hash string, text string, id int, bucket int", "postings": _LISTS}


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{path}/{name}")


def _rarest(spark: SparkSession, path: str, needle: str) -> list[tuple[str, int]] | None:
    """The needle's rarest grams with the number of texts that hold them; none if it is too short to have one."""
    asked = grams(spark.range(1).select(F.lower(F.lit(needle)).alias("low")).first().low)  # as the texts' small letters are made
    if not asked:
        return None
    n = {r.gram: r.n for r in _table(spark, path, "postings").where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    return sorted(((g, n.get(g, 0)) for g in asked), key=lambda x: (x[1], x[0]))[:RAREST]


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(bucket, id) of the texts that hold the query's rarest grams, all of them; None where the query, without spaces around it, has less than three signs."""
    rarest = _rarest(spark, path, query.strip().lower())
    if rarest is None:
        return None
    lists = _table(spark, path, "postings").where(F.col("gram").isin([g for g, _ in rarest])).select("bucket", "gram", "start", F.posexplode("gaps").alias("at", "gap"))
    ids = lists.select("bucket", F.sum("gap").over(Window.partitionBy("bucket", "gram", "start").orderBy("at")).cast("int").alias("id"))
    return ids.groupBy("bucket", "id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("bucket", "id")


def texts_for(spark: SparkSession, path: str, query: str) -> DataFrame:
    """(path, text) that can hold the query, from the buckets that have any; all texts for a query too short to have a gram."""
    texts, found = _table(spark, path, "texts"), candidates(spark, path, query)
    if found is None:
        return texts.select("path", "text")
    shared_folder(spark)
    found = found.checkpoint()
    buckets = [r.bucket for r in found.select("bucket").distinct().collect()]  # at most one number a bucket
    return texts.where(F.col("bucket").isin(buckets)).join(found, ["bucket", "id"], "left_semi").select("path", "text")


def indexed_lines(spark: SparkSession, path: str, query: str, per_module: int = 3) -> DataFrame:
    """What an exact search over all texts gives, from those that can match; paths are distinct, so that no line is exchanged."""
    return line_hits(texts_for(spark, path, query), [query], fuzzy=False, per_module=per_module).select("path", "line", "score", "column", "snippet")
