"""Merkle fixity audit of record archives: records and ordered ranges of offsets are hashed into a tree for each file;
replicas' roots are compared, and only mismatching branches are descended, down to the records that differ.

A node covers a fixed range of offsets, so that a record that is altered in place changes its own branch alone. Only digests
are shuffled, never records. The records' digests are written once to the shared folder, and each level is built from the
written one below it, so an archive is read once; a node has 2 ** ``BITS`` children at most, and records that share one offset
count as a set of digests.

Records come from WARC files, where an offset is a place in bytes (``read_warc``), or from a table whose key is a record's
number, ``SPAN`` to a file (``records``); ``byte_ranges`` says where such a record lies in its WARC file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut, stored

BITS, LEVELS = 4, 3  # a node's children, as a power of two; levels above the records
PIECE = 65_536  # compressed bytes that are read at a time
SPAN = 1 << BITS * LEVELS  # records in a file
WARC_BITS = 8  # for offsets in bytes
NOWHERE = -(1 << 63)  # the file of records without a key
HEAD = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {}\r\nContent-Length: {}\r\n\r\n"


def record_digest(url: Column, payload: Column) -> Column:
    """SHA-256 of a record: its address, a line end, its payload; nulls count as empty."""
    return F.sha2(F.encode(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(payload, F.lit(""))), "UTF-8"), 256)


def record_bytes(url: Column, payload: Column) -> Column:
    """The length of the WARC record, head and closing line ends included."""
    long = F.octet_length(F.coalesce(payload, F.lit("")))
    return (F.octet_length(F.coalesce(url, F.lit(""))) + long + F.length(long.cast("string")) + len(HEAD.format("", "")) + 4).cast("bigint")


def records(archive: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(file, offset, digest, n_bytes) of each record. The key orders the records; one without a key lies in the file ``NOWHERE`` at an offset of its digest's own. Equal records at one offset are one, with their number in the digest."""
    rows = archive.select(F.col(key).cast("bigint").alias("k"), record_digest(F.col(url), F.col(payload)).alias("d"), record_bytes(F.col(url), F.col(payload)).alias("b"))
    file, offset = F.coalesce(F.shiftright("k", BITS * LEVELS), F.lit(NOWHERE)), F.coalesce(F.col("k").bitwiseAND(F.lit(SPAN - 1)), F.xxhash64("d"))
    counted = rows.select(file.cast("bigint").alias("file"), offset.cast("bigint").alias("offset"), "d", "b").groupBy("file", "offset", "d").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    one = F.concat_ws("*", "d", F.when(F.col("n") > 1, F.col("n").cast("string")))
    return counted.groupBy("file", "offset").agg(F.array_join(F.array_sort(F.collect_set(one)), ",").alias("digest"), F.sum("b").alias("n_bytes"))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, digest, n_bytes, uri) of each record of the WARC files at ``path``: place and length in bytes, SHA-256 of the record as it lies there.

    Files whose records are single gzip members are read too, places and lengths then being those of the members. What follows
    the last whole record of a file counts as one record without address. A file is held by one task; Spark's reader ends at 2 GB.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("file"), b.column("content"), strict=True):
                rows = [(name.as_py(), at, hashlib.sha256(data).hexdigest(), len(data), uri) for at, data, uri in _cut(memoryview(content.as_buffer()))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], ["file", "offset", "digest", "n_bytes", "uri"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, "file string, offset bigint, digest string, n_bytes bigint, uri string")


def _cut(data: memoryview) -> Iterator[tuple[int, memoryview, str | None]]:
    """(place, bytes, address) of each record."""
    at = 0
    while at < len(data):
        if bytes(data[at : at + 2]) == b"\x1f\x8b":
            n, head = _member(data[at:])
            yield at, data[at : at + n], _uri(head[: head.find(b"\r\n\r\n") + 1])
        else:
            head = bytes(data[at : at + 65536])
            end = head.find(b"\r\n\r\n")
            size = next((x.split(b":", 1)[1].strip() for x in head[: max(end, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
            whole = head.startswith(b"WARC/") and size.isdigit() and at + end + 8 + int(size) <= len(data)
            n = end + 8 + int(size) if whole else len(data) - at
            yield at, data[at : at + n], _uri(head[:end]) if whole else None
        at += n


def _member(data: memoryview) -> tuple[int, bytes]:
    """How many bytes the gzip member at the beginning has (one that is damaged or cut off: all), and its first plain bytes up to the end of the header. It is
    read a piece at a time, so that a file of many members is walked once."""
    member, n, head = zlib.decompressobj(31), 0, b""
    while not member.eof and n < len(data):
        part = data[n : n + PIECE]
        try:
            plain = member.decompress(part)
        except zlib.error:
            return len(data), b""
        if b"\r\n\r\n" not in head:
            head += plain
        n += len(part) - len(member.unused_data)
    return n, head


def _uri(head: bytes) -> str | None:
    return next((x.split(b":", 1)[1].strip().decode("utf-8", "replace") for x in head.split(b"\r\n") if x.lower().startswith(b"warc-target-uri:")), None)


def level_up(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """The nodes above: each hashes its children's places and digests in order."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", F.lpad(F.col("offset").bitwiseAND(F.lit((1 << bits) - 1)).cast("string"), 6, "0"), "digest")))
    return nodes.groupBy("file", F.shiftright("offset", bits).alias("offset")).agg(F.sha2(F.array_join(parts, "|"), 256).alias("digest"))


def tree(leaves: DataFrame, bits: int = BITS) -> list[DataFrame]:
    """Levels from the records to the roots, each written before the next is built."""
    out = [stored(leaves)]
    for _ in range(LEVELS):
        out.append(cut(level_up(out[-1], bits)))
    return out


def audit(left: DataFrame, right: DataFrame, bits: int = BITS) -> DataFrame:
    """(file, offset, status, left_digest, right_digest, n_bytes) of the records (file, offset, digest, n_bytes) in which two replicas differ: changed, missing (on the right) or extra; n_bytes is the left one's. Empty replicas are trees without nodes; equal ones give no rows."""
    a, b = tree(left, bits), tree(right, bits)
    below: DataFrame | None = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        x, y = x.withColumnRenamed("digest", "left_digest"), y.select("file", "offset", F.col("digest").alias("right_digest"))
        if below is not None:  # only children of nodes that differ
            held = lambda df, at=below: df.withColumn("up", F.shiftright("offset", bits)).join(at, ["file", "up"], "left_semi").drop("up")
            x, y = held(x), held(y)
        differ = cut(x.join(y, ["file", "offset"], "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest"))))
        below = differ.select("file", F.col("offset").alias("up"))
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return differ.select("file", "offset", status.alias("status"), "left_digest", "right_digest", "n_bytes")


def byte_ranges(found: DataFrame, left: DataFrame) -> DataFrame:
    """The rows of ``audit`` over ``records`` with byte_offset: where the left replica's record begins in its WARC file, null where there is none or it has no key. Only files that hold a difference are laid out; a file has ``SPAN`` offsets at most."""
    touched = left.where(F.col("file") != NOWHERE).join(found.select("file").distinct(), "file", "left_semi")
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    places = touched.select("file", "offset", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("byte_offset"))
    return found.join(places, ["file", "offset"], "left")


def key_of(file: Column, offset: Column) -> Column:
    """The key of a record of ``records``; null in the file of those without."""
    return F.when(file != NOWHERE, F.shiftleft(file, BITS * LEVELS) + offset)
