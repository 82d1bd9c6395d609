"""Spelling variants: pairs of vocabulary words at one edit, by composing acceptors with a one-edit transducer.

The vocabulary is dealt by initial states: words that agree up to a place, or from a place on, start (or end) in the same state
of the whole vocabulary's acceptor. Let a pair's edit be at the length of the words' common prefix, and l the shorter word's length. If
that is at least h = l div 2, both words begin with the same h signs; otherwise both end with the same l - h. So a pair is
found in just one partition, keyed by (l, window of the edit, what lies before the window, what lies after it). A partition with more than ``GROUP`` words has its window
halved, which turns part of what may vary into key; at a window of one sign a partition holds at most the alphabet, squared.

In a partition, what is left of the words inside the window becomes a minimal acyclic acceptor A (equal right languages share a state). A is composed
with the transducer that changes or inserts one sign, and with A again: states (q, q) before the edit, then all arcs out of q, in
pairs for a change or alone for an insertion, then pairs of different states, whose common right language is computed once each.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import cut, stored

LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10  # how many times as frequent a form must be
DROPPED = 31  # of the occurrences' checksums, one in so many loses a sign
GROUP = 10_000  # words of a partition; above the 90 x 90 + 90 that a window of one sign can hold
HELD = 500_000  # distinct words that a task counts before it hands them on; bounds memory, not results

_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters in small letters (A-Z only), of which checksums divisible by 31 lose a sign, of so many signs and occurrences at least.

    Counted in each task before the exchange, and there text by text: an occurrence's checksum is that of the text's id and the run.
    """

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")
        held: Counter[str] = Counter()
        full = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                before = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(run.findall(text.as_py().translate(_SMALL))).items():
                    h = zlib.crc32(word.encode(), before)
                    if h % DROPPED == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield full()
                    held.clear()
        yield full()

    read = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return read.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


class Acceptor:
    """A minimal acyclic acceptor of sorted distinct strings: ``arcs[q]`` has q's next states by sign, ``final`` the accepting states, 0 begins."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final: set[int] = set()
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []  # the last word's arcs that aren't minimised yet

        def settle(depth: int) -> None:
            while len(path) > depth:
                q, sign, to = path.pop()
                same = known.setdefault((to in self.final, *self.arcs[to].items()), to)
                self.arcs[q][sign] = same

        last = ""
        for word in words:
            depth = next((i for i, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
            settle(depth)
            q = path[-1][2] if path else 0
            for sign in word[depth:]:
                self.arcs.append({})
                self.arcs[q][sign] = len(self.arcs) - 1
                path.append((q, sign, len(self.arcs) - 1))
                q = len(self.arcs) - 1
            self.final.add(q)
            last = word
        settle(0)


def _common(a: Acceptor, p: int, q: int, known: dict[tuple[int, int], list[str]]) -> list[str]:
    """The strings accepted from both states; each pair of states once, the deepest pairs first."""
    todo = [(p, q)]
    while todo:
        pair = todo[-1]
        if pair in known:
            todo.pop()
            continue
        x, y = a.arcs[pair[0]], a.arcs[pair[1]]
        small, other = (x, y) if len(x) <= len(y) else (y, x)
        both = [s for s in small if s in other]
        lacking = [k for s in both if (k := (x[s], y[s])) not in known]
        if lacking:
            todo += lacking
            continue
        known[pair] = [""] * (pair[0] in a.final and pair[1] in a.final) + [s + rest for s in both for rest in known[x[s], y[s]]]
        todo.pop()
    return known[p, q]


def one_edit(words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of distinct strings one changed or inserted sign apart, each once; of an insertion the shorter comes first.

    The edit is at the end of the common prefix, so that an insertion into a run of equal signs has one path: what follows it must not begin with the inserted sign.
    """
    a = Acceptor(sorted(words))
    known: dict[tuple[int, int], list[str]] = {}
    stack = [(0, "")]
    while stack:
        q, before = stack.pop()
        arcs = a.arcs[q]
        for (s, p), (t, r) in combinations(arcs.items(), 2):
            for rest in _common(a, p, r, known):
                yield before + s + rest, before + t + rest
        for s, p in arcs.items():
            for rest in _common(a, q, p, known):
                if not rest.startswith(s):
                    yield before + rest, before + s + rest
            stack.append((p, before + s))


def _members(words: DataFrame, least_length: int) -> DataFrame:
    """Each word under its keys: l is its length or, as the longer word of an insertion, one less; the edit is in the second half or in the first."""
    length = F.length("word")
    bases = F.filter(F.array(length, length - 1), lambda x: x >= least_length)
    whole = words.select("word", "n", F.explode(bases).alias("l"))
    half = F.col("l").cast("int").bitwiseAND(F.lit(-2)) / 2
    windows = F.array(F.struct(half.cast("int").alias("i"), (F.col("l") + 1).alias("j")), F.struct(F.lit(0).alias("i"), half.cast("int").alias("j")))
    return _keyed(whole.select("word", "n", "l", F.explode(windows).alias("w")).select("word", "n", "l", "w.i", "w.j"))


def _keyed(m: DataFrame) -> DataFrame:
    """Adds the key of the window [i, j): what lies before it and, counted from the end, after it."""
    after = F.greatest(F.col("l") - F.col("j"), F.lit(0))
    text = F.concat_ws("\x00", F.substr("word", F.lit(1), F.col("i")), F.substr("word", F.length("word") - after + 1, after))
    return m.withColumn("key", F.xxhash64(text, "l", "i", "j"))


def _bounded(members: DataFrame, group: int) -> DataFrame:
    """The members with every partition's words at most ``group``: the windows of larger ones are halved, until all fit or windows are of one sign."""
    done = None
    while True:
        large = cut(members.where("j - i > 1").groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group).select("key"))
        if large.isEmpty():
            return members if done is None else done.unionByName(members)
        rest = members.join(large, "key", "left_anti")
        done = rest if done is None else done.unionByName(rest)
        middle = F.expr("(i + j) div 2").cast("int")
        halves = F.explode(F.array(F.struct(F.col("i"), middle.alias("j")), F.struct(middle.alias("i"), F.col("j"))))
        members = cut(_keyed(members.join(large, "key", "left_semi").select("word", "n", "l", halves.alias("w")).select("word", "n", "l", "w.i", "w.j")))


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, group: int = GROUP) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words exactly one inserted, deleted or replaced sign apart, each once. ``words`` is (word, n), words distinct."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("key", "l", "i", "j", "word", "n"))))
        out: list[tuple[str, int, str, int]] = []
        made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64()))], ["a", "n_a", "b", "n_b"])
        for (_, l, i, j), same in groupby(rows, key=lambda r: r[:4]):
            held = [(r[4], r[5]) for r in same]
            if len(held) == 1:
                continue
            after = max(l - j, 0)
            parts: dict[tuple[str, str], dict[str, tuple[str, int]]] = {}
            for word, n in held:  # keys are hashes: partitions are told apart by the signs themselves
                end = len(word) - after
                parts.setdefault((word[:i], word[end:]), {})[word[i:end]] = (word, n)
            for inside in parts.values():
                if len(inside) == 1:
                    continue
                for x, y in one_edit(list(inside)):
                    if len(inside[x][0]) != l:  # both of the longer length: they meet under their own
                        continue
                    # an edit at the window's end lies in the next window, which what both begin with decides
                    if len(y) > len(x) and y.startswith(x) and j <= l:
                        continue
                    out.append((*inside[x], *inside[y]))
                    if len(out) >= 50_000:
                        yield made()
                        out.clear()
        yield made()

    dealt = _bounded(_members(words, least_length), group).repartition("key").sortWithinPartitions("key", "l", "i", "j")
    return dealt.select("key", "l", "i", "j", "word", "n").mapInArrow(each, "a string, n_a long, b string, n_b long")


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents' vocabulary.

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that is at least ``ratio`` times the word's; its root is the end of the chain of forms.
    Null texts have no words; a null id counts as the empty text in checksums; repeated rows count each; an empty table gives no rows; columns beyond doc_id and text are not read.
    """
    words = stored(vocabulary(documents, least_length, least_count))
    pairs = near_pairs(words, least_length, group)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))))
    best = pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("form"))).alias("best"))
    fits = -F.col("best.m") >= F.col("n") * ratio
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    found = stored(found)
    return found.join(_roots(found), "word", "left").select("word", "form", F.coalesce("root", F.col("word")).alias("root"), "n", "n_near", "form_n")


def _roots(found: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form. A form is ``ratio`` times as frequent, so chains are as long as counts have digits; each turn doubles what is followed."""
    ends = cut(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = cut(ends.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if stepped.where("moved").isEmpty():
            return stepped.select("word", "root")
        ends = stepped.select("word", "root")
