"""Benchmark passages in documents by pigeonhole edit matching.

An item with an error budget of k is split into k + 1 pieces: of any occurrence within the budget at least one piece is
exact. Pieces are found by one automaton over each whole text; a hit climbs a tree of ever longer runs of pieces, each
verified by Myers' bit-parallel distance within its own budget, so that chance hits end at the first, shortest run.
Items are read in blocks of bounded size, each held against all documents; of several blocks one is sent at a time, and what
it found is written before the next one is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import free_name, stored

PER_ERROR = 12  # one error in the budget for so many signs of an item
BLOCK = 2_000_000  # signs of items that are sent to the executors at a time


def normal(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends; null counts as empty."""
    return " ".join((text or "").lower().split())


class Run:
    """Pieces ``first`` to ``last`` of an item as one pattern with an error for each piece but one."""

    __slots__ = ("above", "at", "budget", "masks", "text", "top")

    def __init__(self, text: str, at: int, budget: int, above: Run | None):
        self.text, self.at, self.budget, self.above = text, at, budget, above
        self.top, self.masks = 1 << max(len(text) - 1, 0), {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def nearest(self, window: str) -> tuple[int, int]:
        """Least distance of the pattern to any part of the window, and where the first such part ends."""
        full = (self.top << 1) - 1
        up, down, score, top, get = full, 0, len(self.text), self.top, self.masks.get
        best, end = score, 0
        for i, c in enumerate(window):
            eq = get(c, 0)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            rise, fall = down | ~(h | up) & full, up & h
            if rise & top:
                score += 1
            elif fall & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            rise, fall = rise << 1 & full, fall << 1 & full
            up, down = fall | ~(v | rise) & full, rise & v
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[int, str]], per_error: int):
        self.items = {}
        self.pieces = ahocorasick.Automaton()
        hits: dict[str, list[tuple[int, int, Run]]] = {}
        for key, (item, text) in enumerate(items):
            if text:
                k = len(text) // per_error
                cuts = [round(i * len(text) / (k + 1)) for i in range(k + 2)]
                root = Run(text, 0, k, None)
                self.items[key] = (item, text, k, Run(text[::-1], 0, k, None))
                self._split(text, cuts, 0, k + 1, root, key, hits)
        for piece, found in hits.items():
            self.pieces.add_word(piece, (len(piece), found))
        if hits:
            self.pieces.make_automaton()

    def _split(self, text: str, cuts: list[int], a: int, b: int, run: Run, key: int, hits: dict) -> None:
        if b - a == 1:
            hits.setdefault(run.text, []).append((key, run.at, run))
            return
        mid = (a + b) // 2
        for x, y in ((a, mid), (mid, b)):
            self._split(text, cuts, x, y, Run(text[cuts[x] : cuts[y]], cuts[x], y - x - 1, run), key, hits)

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item, distance, budget, start, end) of each item that occurs within its budget: its nearest occurrence, the first of equals; places in the normal text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not self.items:
            return []
        for last, (n, found) in self.pieces.iter(text):
            for key, at, leaf in found:
                start = last + 1 - n - at  # where the item would begin
                _, whole, _, back = self.items[key]
                if key in best and best[key][0] == 0:
                    continue
                if text.startswith(whole, max(start, 0)) and start >= 0:
                    best[key] = (0, start, start + len(whole))
                    continue
                run, d, end, low = leaf, 0, 0, 0
                while run.above is not None and d <= run.budget:
                    run = run.above
                    low = max(start + run.at - run.budget, 0)
                    d, end = run.nearest(text[low : max(start + run.at + len(run.text) + run.budget, 0)])
                if d <= run.budget and run.above is None:
                    end += low
                    begin = end - back.nearest(text[max(end - len(whole) - d, 0) : end][::-1])[1]
                    if key not in best or (d, begin) < best[key][:2]:
                        best[key] = (d, begin, end)
        return [(self.items[k][0], d, self.items[k][2], s, e) for k, (d, s, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    held, n, some = [], 0, False
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r.item_id, normal(r.text)))
        n += len(held[-1][1])
        if n >= block:
            yield held
            held, n, some = [], 0, True
    if held or not some:
        yield held


_built: dict[str, Matcher] = {}  # in a worker: the matcher of the block at hand


def _matcher(name: str, sent: Broadcast, per_error: int) -> Matcher:
    """The block's automaton, built once in a worker; the block before is let go."""
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(sent.value, per_error)
    return _built[name]


def _by_blocks(documents: DataFrame, benchmark: DataFrame, block: int, against: Callable[[Broadcast, str], DataFrame]) -> Iterator[DataFrame]:
    """What each block of items finds, lazily for a single block; of several each is written, and its items are taken back, before the next is sent. A block has at most ``block`` signs and one item."""
    send = lambda items: (documents.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex)
    blocks = _blocks(benchmark, block)
    first, second = next(blocks), next(blocks, None)
    if second is None:
        yield against(*send(first))
        return
    for items in chain((first, second), blocks):
        sent, name = send(items)
        yield stored(against(sent, name))
        sent.destroy()


def find_passages(documents: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block: int = BLOCK) -> DataFrame:
    """One row for each document row and item that occurs in its whole text: doc_id, item_id, distance, budget, start, end.

    Texts and items are compared in lower case with single spaces; start and end (exclusive) count code points of that form.
    Null and empty texts hold nothing and null or empty items occur nowhere; an item shorter than ``per_error`` must occur
    exactly; repeated rows and items each give their rows; empty tables give none. Extra columns are not read.
    """
    kinds = [documents.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()]
    names = ["doc_id", "item_id", "distance", "budget", "start", "end"]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int, budget int, start int, end int"

    schema_item = to_arrow_type(benchmark.schema["item_id"].dataType)

    def against(sent: Broadcast, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent, per_error)
            for b in batches:
                rows, found = [], []
                for i, t in enumerate(b.column("text").to_pylist()):
                    for x in matcher.find(normal(t)):
                        rows.append(i)
                        found.append(x)
                columns = list(zip(*found, strict=True)) or [()] * 5
                types = [schema_item, pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), *map(pa.array, columns, types)], names)

        return documents.select("doc_id", "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionAll, _by_blocks(documents, benchmark, block, against))


def without_passages(documents: DataFrame, benchmark: DataFrame, per_error: int = PER_ERROR, block: int = BLOCK) -> DataFrame:
    """The documents, all columns, in whose whole text no item occurs within its budget; the rules are those of ``find_passages``.

    One block of items filters in one pass without a shuffle; of several blocks each tells the digests of the texts that it hit,
    and the documents of these texts go. Columns of whatever names come out as they went in.
    """
    items = list(_first_blocks(benchmark, block))
    if len(items) == 1:
        sent, name = documents.sparkSession.sparkContext.broadcast(items[0]), uuid.uuid4().hex

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent, per_error)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normal(t)) for t in b.column("text").to_pylist()], pa.bool_()))

        return documents.mapInArrow(clean, documents.schema)

    def against(sent: Broadcast, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(name, sent, per_error)
            for b in batches:
                yield b.select(["_text"]).filter(pa.array([bool(matcher.find(normal(t))) for t in b.column("text").to_pylist()], pa.bool_()))

        return documents.select(F.md5(F.encode("text", "UTF-8")).alias("_text"), "text").mapInArrow(run, "_text string")

    hit = reduce(DataFrame.unionAll, _by_blocks(documents, benchmark, block, against)).distinct()
    of_text = free_name(documents, "of_text")
    return documents.withColumn(of_text, F.md5(F.encode("text", "UTF-8"))).join(hit.withColumnRenamed("_text", of_text), of_text, "left_anti").select(*documents.columns)


def _first_blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """The first block and, if there is more, an empty one: enough to see whether one is all."""
    blocks = _blocks(benchmark, block)
    yield next(blocks)
    if next(blocks, None) is not None:
        yield []
