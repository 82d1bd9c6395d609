"""Language-model scores by a weighted backoff automaton.

A state is a context: the token just read, or none. Smoothed bigrams are a state's arcs; a token without an arc takes the
failure arc, with its weight, to the state of no context, whose arcs are the smoothed single tokens. One traversal from left
to right carries the state and sums the arcs' log10 weights:

    arc u -> w      (c(uw) + K p(w)) / (c(u) + K)         where c(uw) > 0
    failure of u    K / (c(u) + K)
    arc of no context    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1))

The model grows with the corpus and is never gathered in one place. Documents are dealt into blocks of bounded bytes; each
block asks for the counts of just the n-grams that it holds, bucketed by hash; a bucket sums what all blocks counted and
answers each; a block then walks its part of the automaton over its own texts. A bucket that a block holds nothing of is not
asked, so there are never more messages than n-grams in the blocks, however many blocks meet however many buckets. The corpus'
own two numbers, its tokens and its distinct tokens, are summed over the buckets apart. Tokens and bigrams are known by 64-bit
hashes (two different ones of 100 million share one with a probability of about 3 in 10,000).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import id_crc

BLOCK = 8_000_000  # bytes of text in a block, about
K = 8.0  # weight of the single-token estimate in a context
ADD = 0.1
END, START = xxhash.xxh3_64_intdigest(b" end"), xxhash.xxh3_64_intdigest(b" start")  # no token holds a space
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M1) ^ (b * _M2 + (b >> np.uint64(29)))
    h = (h ^ (h >> np.uint64(30))) * _M3
    return h ^ (h >> np.uint64(31))


class Block:
    """The texts of a block as token hashes: each text's tokens and one end, and the distinct tokens and bigrams in order of hash."""

    def __init__(self, texts: list[str | None]):
        hashes, lengths = [], []
        for t in texts:
            words = (t or "").encode("utf-8", "surrogatepass").lower().split()
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
            hashes += [h, np.array([END], np.uint64)]
            lengths.append(len(words) + 1)
        token = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        del hashes
        self.lengths = np.array(lengths, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if lengths else np.zeros(0, np.int64)
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[self.first] = START
        self.tokens, self.at = np.unique(token, return_inverse=True)
        self.bigrams, self.pair_at = np.unique(_pairs(before, token), return_inverse=True)
        # the context's own count is that of the token before; a start is as frequent as an end
        self.context = np.empty_like(self.at)
        self.context[1:] = self.at[:-1]
        if len(token):
            self.context[self.first] = np.searchsorted(self.tokens, np.uint64(END))

    def counts(self, learns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each distinct token and bigram occurs in the texts that the model learns from."""
        weight = np.repeat(learns.astype(np.float64), self.lengths)
        return tuple(np.bincount(i, weight, len(x)).astype(np.int64) for i, x in ((self.at, self.tokens), (self.pair_at, self.bigrams)))

    def walk(self, c: np.ndarray, cc: np.ndarray, n: int, v: int, k: float) -> dict[str, np.ndarray]:
        """The traversal over all texts at once: the state after a token is that token, so that each step's arc is known by its bigram."""
        p = (c + ADD) / (n + ADD * (v + 1))
        single = p[self.at]
        seen, context = cc[self.pair_at].astype(np.float64), c[self.context].astype(np.float64)
        arc = np.log10((seen + k * single) / (context + k))
        back = np.log10(k / (context + k)) + np.log10(single)
        step = np.where(seen > 0, arc, back)
        total = lambda x: np.add.reduceat(x, self.first) if len(self.first) else np.zeros(0)
        return {"n_tokens": self.lengths, "n_known": total((c[self.at] > 0).astype(np.int64)), "base_score": total(np.log10(single)), "score": total(step)}


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of hash, so that a sorted array falls into contiguous slices."""
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def _held(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """The buckets that occur in an ascending array, with their slices."""
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))) if len(bucket) else np.zeros(0, np.int64)
    return list(zip(bucket[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=False))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpack(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Ascending numbers as their first, the width of the differences and these, no byte wider than the widest needs."""
    if not len(x):
        return b""
    steps = np.diff(x)
    width = max((int(steps.max()).bit_length() + 7) // 8, 1) if len(steps) else 1
    return x[:1].tobytes() + bytes([width]) + np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width = b[8]
    steps = np.frombuffer(b, np.uint8, offset=9).reshape(-1, width)
    out = np.zeros((len(steps) + 1, 8), np.uint8)
    out[1:, :width] = steps
    out = out.reshape(-1).view(np.uint64)
    out[0] = np.frombuffer(b, np.uint64, 1)[0]
    return np.cumsum(out, dtype=np.uint64)


def _ask(buckets: int):
    """Of one block: for each bucket the block's hashes in it and their counts."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = Block(table.column("text").to_pylist())
        counts = block.counts(table.column("learns").to_numpy(zero_copy_only=False))
        parts = [{i: (_pack_sorted(h[a:b]), _pack(c[a:b])) for i, a, b in _held(_bucket(h, buckets))} for h, c in zip((block.tokens, block.bigrams), counts, strict=True)]
        nothing = (b"", _pack(np.zeros(0, np.int64)))
        rows = [(i, *parts[0].get(i, nothing), *parts[1].get(i, nothing)) for i in sorted(parts[0].keys() | parts[1].keys())]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], ["block", "bucket", "tokens", "token_counts", "bigrams", "bigram_counts"])

    return run


def _sums(table: pa.Table, name: str, counted: str) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Of one bucket's messages: each distinct hash's sum, the place of every asked hash among these, and where each message's hashes end."""
    h = [_unpack_sorted(x) for x in table.column(name).to_pylist()]
    c = np.concatenate([_unpack(x, np.int64) for x in table.column(counted).to_pylist()])
    keys, at = np.unique(np.concatenate(h), return_inverse=True)
    return np.bincount(at, c, len(keys)).astype(np.int64), at, np.cumsum([len(x) for x in h]).tolist()


def _answer(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Of one bucket: to each block that asked the whole corpus' counts of what it asked for."""
    out = []
    for name, counted in (("tokens", "token_counts"), ("bigrams", "bigram_counts")):
        total, at, ends = _sums(table, name, counted)
        out.append([_pack(x) for x in np.split(total[at], ends[:-1])])
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    columns = [table.column("block").to_pylist(), [key[0].as_py()] * table.num_rows, *out]
    return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["block", "bucket", "c", "cc"])


def _facts(table: pa.Table) -> pa.Table:
    """Of one bucket: how many tokens it has, distinct and all."""
    total = _sums(table, "tokens", "token_counts")[0]
    return pa.table([pa.array([int((total > 0).sum())], pa.int64()), pa.array([int(total.sum())], pa.int64())], ["v", "n"])


def score_documents(documents: DataFrame, held_out: int = 10, k: float = K, block: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; the model learns from rows whose crc32(doc_id as text) mod ``held_out`` is not 0.

    Null and empty texts are one end token; a null id counts as the empty text in the remainder; repeated rows count and are
    scored each; an empty table gives no rows; without training rows every token has probability 1. Extra columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    size = documents.agg(F.sum(F.octet_length("text").cast("bigint") + 16)).first()[0] or 0
    block = block or int(BLOCK * min(max((size / 4e9) ** 0.5, 1), 2))  # fewer and larger messages for large inputs, as far as memory allows
    blocks = -(-size // block) or 1
    buckets = -(-blocks // 2)
    rest = id_crc(F.col("doc_id")) % held_out
    dealt = documents.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text", (rest != 0).alias("learns"))
    asked = dealt.groupBy("block").applyInArrow(_ask(buckets), "block int, bucket int, tokens binary, token_counts binary, bigrams binary, bigram_counts binary")
    # the texts are dealt once: both the asking and the walking read the same exchange
    answers = asked.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, c binary, cc binary")
    # two numbers over the same exchange, for every answer
    facts = asked.groupBy("bucket").applyInArrow(_facts, "v bigint, n bigint").agg(F.struct(F.coalesce(F.sum("v"), F.lit(0)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).scalar()
    answers = answers.withColumn("_f", facts).select("block", "bucket", "c", "cc", "_f.v", "_f.n")

    def walk(texts: pa.Table, given: pa.Table) -> pa.Table:
        given = given.sort_by("bucket")
        counts = [np.concatenate([np.zeros(0, np.int64), *(_unpack(x, np.int64) for x in given.column(name).to_pylist())]) for name in ("c", "cc")]
        v, n = (given.column(x)[0].as_py() for x in ("v", "n"))
        found = Block(texts.column("text").to_pylist()).walk(*counts, n, v, k)
        held = pa.array(~texts.column("learns").to_numpy(zero_copy_only=False))
        columns = [texts.column("doc_id"), held, *(pa.array(found[x], pa.int64()) for x in ("n_tokens", "n_known")), pa.array(np.full(len(held), n), pa.int64()), *(pa.array(found[x], pa.float64()) for x in ("base_score", "score"))]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, schema)
