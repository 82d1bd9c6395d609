"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel-top-k draw.

A text is lower-cased (A-Z) and its words joined by single spaces. One scan stores the running CRC-32 at each word's end. The
CRC of any run of words follows from two of these prefixes: with ``|`` for concatenation and ``shift(c, n)`` for what n zero
bytes make of the register c, a linear map over GF(2),

    crc(a | b) = shift(crc(a), len(b)) xor crc(b)    so    crc(b) = crc(a | b) xor shift(crc(a), len(b))

so that no n-gram is ever built. Two passes over the texts: the first counts features by bucket, summed in each task before
the exchange; the second adds the buckets' gains. What goes through the driver and to all tasks is one vector of
``BUCKETS`` numbers. The draw ranks narrow rows by range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import stored
from factloom.llm.sharding import cut_runs

BUCKETS = 10_000
N = 3  # longest run of words
LEAST_WORDS = 20
SHARE = 5  # of a hundred documents with words enough
SEED = 42
SLICE = 1 << 20  # bytes that are scanned at a time, about; bounds memory, not results

#: Separators become spaces and A-Z small letters; 0-9, a-z and all bytes of other signs stay.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_STEP = _byte_table()


def _apply(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The linear map of four byte tables on each register."""
    return op[0][c & 255] ^ op[1][(c >> 8) & 255] ^ op[2][(c >> 16) & 255] ^ op[3][c >> 24]


def _maps() -> tuple[np.ndarray, list[np.ndarray]]:
    """Shifts by 0 to 63 bytes, and by 64, 128, 256 ... bytes."""
    each = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    small = [each]
    for _ in range(64):
        c = small[-1]
        small.append(_STEP[c & 255] ^ (c >> 8))
    doubled = [small.pop()]
    for _ in range(32):
        doubled.append(_apply(doubled[-1], doubled[-1]))
    return np.stack(small), doubled


_SMALL, _DOUBLED = _maps()


def shift(c: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What ``n`` zero bytes make of each register ``c`` (uint32)."""
    low = n & 63
    out = _SMALL[low, 0, c & 255] ^ _SMALL[low, 1, (c >> 8) & 255] ^ _SMALL[low, 2, (c >> 16) & 255] ^ _SMALL[low, 3, c >> 24]
    far = np.flatnonzero(n >> 6)
    high, k = n[far] >> 6, 0
    while high.any():
        odd = (high & 1).astype(bool)
        out[far[odd]] = _apply(_DOUBLED[k], out[far[odd]])
        high, k = high >> 1, k + 1
    return out


def _slices(data: bytes) -> Iterator[list[bytes]]:
    """The text's words, in lists of bounded bytes (but for a single longer word)."""
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else next((i for i in range(at + SLICE, len(data)) if _PLAIN[data[i]] == 32), len(data))
        yield data[at:end].translate(_PLAIN).split()
        at = end


def _features(texts: Iterable[bytes | None], buckets: int, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: the numbers of the texts in them, words of each, and (text, bucket) of every feature as two rows.

    Short texts share a slice; the running CRC goes on from text to text, as only differences of it count. Of a text longer than a slice the last
    ``n`` - 1 words are read again with the next slice, and runs that lie in them alone are not counted twice.
    """
    pieces: list[bytes] = []
    owner: list[tuple[int, int, int]] = []  # text, words in the slice, how many of them were read before
    size = 0

    def scan() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, words, again = (np.array(x, dtype=np.int64) for x in zip(*owner))
        spaced = [b" " + w for w in pieces]
        end_crc = np.fromiter(accumulate(spaced, lambda c, w: crc32(w, c), initial=0), dtype=np.uint32, count=len(spaced) + 1)
        ends = np.cumsum(np.fromiter(map(len, spaced), dtype=np.int64, count=len(spaced)))
        before = ~end_crc[:-1]  # a CRC's register is its complement
        start_crc = ~(_STEP[(before ^ np.uint32(32)) & 255] ^ (before >> 8))
        starts = np.concatenate(([0], ends[:-1])) + 1
        of = np.repeat(np.arange(len(text)), words)
        place = np.arange(len(pieces)) - np.repeat(np.cumsum(words) - words, words)
        old = np.repeat(again, words)
        found_text, found_bucket = [], []
        for k in range(1, n + 1):
            if len(pieces) < k:
                break
            last = slice(k - 1, None)
            first = slice(None, len(pieces) - k + 1)
            ok = (of[first] == of[last]) & (place[last] >= old[last])
            i = np.flatnonzero(ok)
            j = i + k - 1
            crc = end_crc[1:][j] ^ shift(start_crc[i], ends[j] - starts[i])
            found_text.append(text[of[i]])
            found_bucket.append((crc % np.uint32(buckets)).astype(np.int64))
        empty = np.zeros(0, dtype=np.int64)
        return text, words - again, np.stack([np.concatenate([*found_text, empty]), np.concatenate([*found_bucket, empty])])

    for number, data in enumerate(texts):
        tail: list[bytes] = []
        for words in _slices(data or b""):
            pieces += tail + words
            owner.append((number, len(tail) + len(words), len(tail)))
            size += sum(map(len, words))
            tail = (tail + words)[-(n - 1) :] if n > 1 else []
            if size >= SLICE:
                yield scan()
                pieces, owner, size = [], [], 0
    if owner:
        yield scan()


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS, n: int = N) -> np.ndarray:
    """How many features of all texts fall into each bucket: a vector of ``buckets`` long numbers. Null texts have none; an empty table gives zeros."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in _features(batch.column(0).cast(pa.large_binary()).to_pylist(), buckets, n):
                total += np.bincount(found[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    parts = df.select(F.col(text).cast("string").alias("text")).mapInArrow(each, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln ((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets, in doubles."""
    b, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of the digest of ``seed:doc_id``; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(documents: DataFrame, gain: np.ndarray, keep: tuple[str, ...] = (), n: int = N, seed: int = SEED) -> DataFrame:
    """doc_id, kept (a struct of the columns ``keep``), n_words, n_features, weight and score of every row; a null text has no words, and so the weight 0."""
    buckets = len(gain)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for text, words, found in _features(batch.column(1).cast(pa.large_binary()).to_pylist(), buckets, n):
                np.add.at(n_words, text, words)
                n_features += np.bincount(found[0], minlength=batch.num_rows)
                weight += np.rint(np.bincount(found[0], weights=gain[found[1]], minlength=batch.num_rows)).astype(np.int64)
            luck = np.fromiter((gumbel(x, seed) for x in batch.column(0).to_pylist()), dtype=np.int64, count=batch.num_rows)
            own = [pa.array(x) for x in (n_words, n_features, weight, weight + luck)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *own], ["doc_id", "kept", "n_words", "n_features", "weight", "score"])

    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(0)
    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), kept.alias("kept"))
    schema = T.StructType([read.schema["doc_id"], read.schema["kept"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight", "score"))])
    return read.mapInArrow(each, schema)


def resample(documents: DataFrame, target: DataFrame, keep: tuple[str, ...] = (), share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS, n: int = N) -> DataFrame:
    """Every document with its rank in a draw of ``share`` in a hundred of those with at least ``least`` words; undrawn: null.

    Documents are (doc_id, text), the target is (text). Returns doc_id, ``keep`` (columns of documents to carry along, such as
    text), n_features, weight, score and rank; a kept column of one of these names is replaced, others are not read. Ties of
    the score go to the smaller id, null ids last; equal rows are drawn each by itself. Null and empty texts have no features, the weight 0 and are never
    drawn. An empty table gives no rows; an empty target counts as zeros in every bucket.
    """
    gain = gains(bucket_counts(documents, buckets=buckets, n=n), bucket_counts(target, buckets=buckets, n=n))
    kept = [c for c in dict.fromkeys(keep) if c not in ("doc_id", "n_features", "weight", "score", "rank")]
    # written once: the range exchange reads it twice; the row's number splits equal rows
    scored = stored(weighted(documents, gain, tuple(kept), n, seed).withColumns({"first": -F.col("score"), "nameless": F.col("doc_id").isNull(), "tie": F.monotonically_increasing_id()}))
    able = F.col("n_words") >= least
    drawn = scored.where(able).count() * share // 100
    ranked = cut_runs(scored.where(able), ["first", "nameless", "doc_id", "tie"], 1).withColumn("rank", F.when(F.col("slot") < drawn, F.col("slot") + 1))
    both = ranked.unionByName(scored.where(~able).withColumns({"shard": F.lit(0), "slot": F.lit(None).cast("long"), "rank": F.lit(None).cast("long")}))
    return both.select("doc_id", *[F.col("kept").getField(c).alias(c) for c in kept], "n_features", "weight", "score", "rank")
