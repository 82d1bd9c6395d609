"""Best-fit decreasing packing of token sequences, over all documents at once.

Documents become token ids in one pass; longer ones are cut. Where a piece goes depends on its length and its rank among all
pieces in order of length, so the whole table meets only as counts of at most ``CAPACITY`` lengths. On these counts the packing
is exact best-fit decreasing: a segment tree over remaining capacities finds the tightest open bin that still holds the length,
in logarithmic time; equal pieces that go to equal bins are placed as one run. The plan is a bounded list of runs, however
many documents there are, and a piece finds its run by bisection on its rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import stored
from factloom.llm.sharding import cut_runs

CAPACITY = 2048
LONG_PIECE = 1000  # signs without a boundary, from which the merge of lowest rank is sought in a heap
END_ID = 0


class Tightest:
    """A segment tree over remaining capacities 0 to ``capacity``: how many open bins have each, and the smallest one from a bound on."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.n = [0] * (2 * self.width)

    def add(self, remaining: int, bins: int) -> None:
        at = self.width + remaining
        while at:
            self.n[at] += bins
            at >>= 1

    def find(self, least: int) -> int | None:
        """The smallest remaining capacity of an open bin that is at least ``least``."""
        at = self.width + least
        if self.n[at]:
            return least
        while at > 1:  # up to the first right-hand neighbour with bins, then down on its left
            if not at & 1 and self.n[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.n[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit decreasing over ``counts`` pieces of each length: runs (first rank, first bin, pieces a bin, offset in the bin, length) sorted by rank, and the number of bins.

    Ranks count all pieces in ascending order of length. Piece j of a run lies in bin first + j // q at offset + (j mod q) x length.
    Equal pieces fill the tightest bin until it holds no more of them, as its remainder stays the tightest; runs split a range of bins
    once a length at most, so that there are few ranges: their number depends on the lengths, not on the pieces.
    """
    tree = Tightest(capacity)
    ranges: dict[int, list[tuple[int, int]]] = {}  # remaining capacity -> ranges (first bin, bins)
    rank = dict(zip(sorted(counts), np.concatenate(([0], np.cumsum([counts[s] for s in sorted(counts)])))[:-1].tolist()))
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(remaining: int, first: int, n: int) -> None:
        if n:
            ranges.setdefault(remaining, []).append((first, n))
            tree.add(remaining, n)

    for s in sorted(counts, reverse=True):
        at, left = rank[s], counts[s]
        while left:
            r = tree.find(s)
            if r is None:  # as many new bins as the rest needs
                r, q = capacity, capacity // s
                n = -(-left // q)
                first, bins = bins, bins + n
            else:
                first, n = ranges[r].pop()
                tree.add(r, -n)
                q = r // s
            full, over = min(n, left // q), 0
            placed = full * q
            if full < n and placed < left:  # the last bin takes the few that are left
                over = left - placed
            used = full + (over > 0)
            runs.append((at, first, q, capacity - r, s))
            put(r - q * s, first, full)
            put(r - over * s, first + full, over > 0)
            put(r, first + used, n - used)
            at, left = at + placed + over, left - placed - over
    return np.array(sorted(runs), dtype=np.int64).reshape(-1, 5), bins


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level BPE file, by a faster library where both agree.

    The vocabulary's ids are its merge order, so the same merges can be run from ranks. Texts that hold a special token's string, or a run so long
    that merging it piecewise would take quadratic time, are encoded by the tokenizers library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        import tokenizers

        self.plain = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in signs} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in signs)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        import public_tokenizers

        self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        words = text.split()
        long_run = len(text) > LONG_PIECE and (max(map(len, words), default=0) > LONG_PIECE or len(text) - sum(map(len, words)) - len(words) > LONG_PIECE)
        if long_run or any(x in text for x in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self.fast.encode_ordinary(text), dtype="<u4")


def pieces(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces of at most ``capacity`` ids: its tokens, then id 0. The first piece takes the odd rest. A null text counts as empty."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.ids(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, at in enumerate([0, *range(first, len(ids), capacity)]):
                    part = ids[at : first if k == 0 else at + capacity]
                    rows.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                held += len(ids)
                if held > 4_000_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def pack(documents: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All documents' pieces with sequence_id and offset, as best-fit decreasing places them: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    ``path`` is the byte-level BPE file. Null and empty texts are one piece, id 0 alone; repeated rows and null ids are pieces of their own; very long texts are cut, never
    shortened; an empty table gives no rows; columns beyond doc_id and text are not read.
    """
    # written once, with a number that splits equal rows: the range exchange reads it twice
    cut_up = stored(pieces(documents, path, capacity, with_ids).withColumn("tie", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most one row for each length up to the capacity
    runs, _ = best_fit(counts, capacity)
    ranked = cut_runs(cut_up, ["length", "doc_id", "piece", "tie"], 1).drop("shard", "tie")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("slot").to_numpy(zero_copy_only=False).astype(np.int64)
            first, first_bin, a_bin, offset, length = runs[np.searchsorted(runs[:, 0], rank, side="right") - 1].T if len(rank) else np.zeros((5, 0), dtype=np.int64)
            j = rank - first
            placed = [batch.column(c) for c in names] + [pa.array(first_bin + j // np.maximum(a_bin, 1)), pa.array(offset + j % np.maximum(a_bin, 1) * length)]
            yield pa.RecordBatch.from_arrays(placed, [*names, "sequence_id", "offset"])

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return ranked.mapInArrow(each, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, its pieces in order: ``packed`` is what ``pack`` gives with ids. A sequence holds at most the capacity, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
