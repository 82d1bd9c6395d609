"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding. Storing that token for every prefix makes
an encoding a walk backwards, an append a few more entries, and an edit a recomputation from the edit on.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries after which a worker's table of pieces or pairs starts anew; bounds memory, not results.
KEPT = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Vocabulary:
    """The ranks, and which tokens may stand side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.token[rank] = token
        self.lengths = sorted({len(t) for t in ranks})
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """By definition: the adjacent pair of lowest rank is joined, the first of equals, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def reachable(self, t: int) -> bool:
        if (known := self.whole.get(t)) is None:
            known = self.whole[t] = self.merge(self.token[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens' bytes, side by side, encode as just these two."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.token[a] + self.token[b]) == [a, b]
        return known


class PrefixTable:
    """One piece's bytes, and for each of its prefixes the last token of that prefix's encoding."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        v, ranks, last = self.v, self.v.ranks, self.last
        data = self.data = self.data + more
        for end in range(len(last) + 1, len(data) + 1):
            for n in v.lengths:
                if n > end:
                    raise ValueError("a byte is not in the vocabulary")
                if (t := ranks.get(data[end - n : end])) is not None and (v.fits(last[end - n - 1], t) if n < end else v.reachable(t)):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is not in the vocabulary")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Bytes start to end become ``new``; the table is kept up to start and computed from there."""
        tail = self.data[end:]
        del self.last[start:]
        self.data = self.data[:start]
        self.append(new + tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.data)
        while at:
            out.append(t := self.last[at - 1])
            at -= len(self.v.token[t])
        return out[::-1]


class Pieces(dict):
    """A piece's tokens, computed when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        data = piece.encode("utf-8", "surrogatepass")
        out = [t] if (t := self.v.ranks.get(data)) is not None else PrefixTable(self.v, data).tokens()
        if len(piece) <= 64:  # long ones rarely come again
            if len(self) >= KEPT:
                self.clear()
            self[piece] = out
        return out


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.v, self.find = Vocabulary(ranks), regex.compile(pattern).findall
        self.pieces = Pieces(self.v)

    def encode(self, text: str) -> list[int]:
        pieces, out = self.pieces, []
        for p in self.find(text):
            out += pieces[p]
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.token.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, file and pattern."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; null counts as empty, and an empty text has no ids.

    ``path`` is a file of ranks that every executor has. Rows keep their number: equal rows give equal rows, an empty table
    none. Columns beyond doc_id and text are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = pa.array([c.encode(t or "") for t in part.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def encode_digests(documents: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, round_trip: the ids' and the decoded bytes' digests; the ids themselves leave the worker only ``with_ids``. The rules are those of ``encode_documents``."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        digits = list(map(str, range(len(c.v.token))))
        for b in (big.slice(at, 1024) for big in batches for at in range(0, big.num_rows, 1024)):
            out: list[list] = [[], [], [], [], []]
            for t in b.column("text").to_pylist():
                ids = c.encode(t or "")
                decoded = c.decode(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                out[2].append(hashlib.sha256(decoded).hexdigest())
                out[3].append(decoded == (t or "").encode("utf-8", "surrogatepass"))
                if with_ids:
                    out[4].append(pa.array(ids, pa.int32()))
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.bool_())]
            if with_ids:
                columns.append(pa.array(out[4], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names)

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids
    return documents.select("doc_id", "text").mapInArrow(run, schema)
