"""MinHash near-duplicates by a signature-coordinate inverted join.

Each distinct token sequence is one class. A class posts itself under its signature's (coordinate, value) pairs, but only
under the rarest so many that two classes agreeing on enough coordinates (``agreement``) must meet in one list (prefix filter over one
global order, rarest first). In a list nobody is paired with everybody: each member is paired with the list's hub, the
class whose values are the most common. Only lists whose members are then still in different components stay open. Members
of a short open list meet each other; of a long one, the members outside the hub's component are dealt into blocks of bounded
size, and each of these meets every block of the list, compared at once on full sets; members that the hub has joined don't meet
each other, and only links that join components come out. All pairs are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from factloom.llm.common import cut

COORDINATES = 32
MISS = 1e-4  # share of pairs just at the wanted similarity that may agree on too few coordinates
SHORT = 64  # members of a list that are paired one by one
LOAD = 300_000  # shingles in a block of a long list's members
_M1, _M2, _M3, _M4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> np.ndarray:
    """The sorted set of hashes (64 bits) of runs of ``size`` words; of fewer words the whole sequence is one; none of no words."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * _M3 + h[i : len(h) - k + 1 + i] * _M4)
    return np.unique(out)


_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    if len(s) < 4096:
        low = (s[None, :] * _A[:, None] + _B[:, None]).min(axis=1)
    else:
        low = np.array([(s * a + b).min() for a, b in zip(_A, _B, strict=True)], np.uint64)
    return (low >> np.uint64(32)).astype(np.uint32).view(np.int32)


def agreement(share: int) -> int:
    """On how many coordinates a pair must agree: as many as all but ``MISS`` of the pairs of ``share`` hundredths do."""
    tail, t, p = 0.0, 0, share / 100
    while (tail := tail + comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)) <= MISS:
        t += 1
    return t


def _signed(documents: DataFrame, size: int) -> DataFrame:
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, n, sig = [], [], []
            for t in b.column("text").to_pylist():
                words = tokens(t)
                s = shingles(words, size)
                digest.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                n.append(len(s))
                sig.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "h", "digest", "n", "sig"])

    return documents.select("doc_id", "h", "text").mapInArrow(run, f"doc_id {kind}, h bigint, digest binary, n bigint, sig array<int>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                s = pa.array([shingles(tokens(t), size).view(np.int64) for t in part.column("text").to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("rep"), s], ["rep", "s"])

    return texts.select("rep", "text").mapInArrow(run, "rep bigint, s array<bigint>")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): each node of an edge with the smallest node it can reach. Neighbours' minima, then a jump to the minimum's own, until nothing moves; each turn is written to the checkpoint folder."""
    ends = F.explode(F.array(F.struct(F.col(a).alias("a"), F.col(b).alias("b")), F.struct(F.col(b).alias("a"), F.col(a).alias("b")))).alias("e")  # both directions of edges that are computed once
    both = cut(edges.where(F.col(a) != F.col(b)).select(ends).select("e.a", "e.b").distinct())
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("comp")))
    while True:
        low = both.join(label.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        near = label.join(low, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("mid"))
        jump = label.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        moved = Observation()  # counted as the turn is written
        new = near.join(jump, "mid", "left").select("node", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp"))
        label = cut(new.observe(moved, F.count(F.when(F.col("comp") != F.col("was"), 1)).alias("n"))).select("node", "comp")
        if not moved.get["n"]:
            return label


def _agreeing(pairs: DataFrame, classes: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) with the number of coordinates they agree on, where that is enough and their sizes allow the similarity."""
    of = lambda x: classes.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("n").alias(f"n_{x}"))
    met = pairs.join(of("a"), "a").join(of("b"), "b")
    met = met.where((F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * share))
    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x))
    return met.withColumn("agree", agree).where(F.col("agree") >= agreement(share))


def _confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough. A hub's many pairs are split by the skew join."""
    of = lambda x: sets.select(F.col("rep").alias(x), F.col("s").alias(f"s_{x}"))
    both = F.size(F.array_intersect("s_a", "s_b"))
    return pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").where(both * 100 >= (F.size("s_a") + F.size("s_b") - both) * share).select("a", "b")


def _joins(share: int):
    """Of two blocks of one hub (or one twice): a link for each pair of components that they join, one of the similar pairs."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lo, hi = key[1].as_py(), key[2].as_py()
        block, reps, comps = (table.column(c).to_numpy() for c in ("block", "rep", "comp"))
        rows = table.column("s").combine_chunks()
        ends, values = rows.offsets.to_numpy(), rows.values.to_numpy()
        sizes = np.diff(ends)
        a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        out: list[tuple[int, int]] = []
        if len(a) and len(b):
            _, token, df = np.unique(values[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
            owner = np.repeat(np.arange(len(reps)), sizes)
            shared = df[token] > 1
            token, owner = token[shared], owner[shared]
            order = np.argsort(token, kind="stable")
            token, owner = np.unique(token[order], return_inverse=True)[1], owner[order]
            both = np.zeros((len(a), len(b)), np.float32)
            at_a, at_b = np.full(len(reps), -1), np.full(len(reps), -1)
            at_a[a], at_b[b] = np.arange(len(a)), np.arange(len(b))
            for first in range(0, int(token[-1]) + 1 if len(token) else 0, 2048):
                x, y = np.searchsorted(token, (first, first + 2048))
                one, two = np.zeros((len(a), 2048), np.float32), np.zeros((len(b), 2048), np.float32)
                t, o = token[x:y] - first, owner[x:y]
                one[at_a[o[at_a[o] >= 0]], t[at_a[o] >= 0]] = 1
                two[at_b[o[at_b[o] >= 0]], t[at_b[o] >= 0]] = 1
                both += one @ two.T  # counts below 2^24 are exact
            both = both.astype(np.int64)
            near = both * 100 >= (sizes[a][:, None] + sizes[b][None, :] - both) * share
            near &= comps[a][:, None] != comps[b][None, :]
            i, j = np.nonzero(near)
            _, pick = np.unique(np.stack([np.minimum(comps[a[i]], comps[b[j]]), np.maximum(comps[a[i]], comps[b[j]])]), axis=1, return_index=True)
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for p in pick:
                x, y = find(int(comps[a[i[p]]])), find(int(comps[b[j[p]]]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(reps[a[i[p]]]), int(reps[b[j[p]]])))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return run


def _long_lists(members: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Links (a, b) that join components among members (hub, rep, comp, n) of one hub. Those of the hub's own component (comp = hub_comp) are dealt into
    even blocks of ``LOAD`` shingles, the others into odd ones; each pair of blocks is compared once, two even ones never."""
    out = (F.col("comp") != F.col("hub_comp")).cast("int")
    sided = members.withColumn("side", out)
    loads = sided.groupBy("hub").agg(*[F.ceil(F.coalesce(F.sum(F.when(F.col("side") == x, F.col("n"))), F.lit(0)) / LOAD).cast("int").alias(f"blocks{x}") for x in (0, 1)])
    blocks = F.when(F.col("side") == 0, F.col("blocks0")).otherwise(F.col("blocks1"))
    dealt = sided.join(loads, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int") * 2 + F.col("side")).join(sets, "rep")
    odd = F.transform(F.sequence(F.lit(0), F.col("blocks1") - 1), lambda x: x * 2 + 1)  # a list with another component has an odd block
    even = F.when(F.col("blocks0") > 0, F.transform(F.sequence(F.lit(0), F.greatest("blocks0", F.lit(1)) - 1), lambda x: x * 2)).otherwise(F.array().cast("array<int>"))
    other = F.explode(F.when(F.col("side") == 0, odd).otherwise(F.concat(even, odd)))
    pairs = dealt.select("hub", "rep", "comp", "block", "s", other.alias("other"))
    pairs = pairs.select("hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "comp", "s")
    return pairs.groupBy("hub", "lo", "hi").applyInArrow(_joins(share), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, size: int = 5, share: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text), text_kept for every row: documents are linked where 100 * intersection >= ``share`` * union of their sets of ``size``-word shingles.

    component_id is the smallest doc_id reachable; kept says that it is the row's own. Null and empty texts have no shingles
    and no links and are kept; rows of a null doc_id take no part: component_id null, kept false. Repeated rows of one
    doc_id each stay; if their texts differ they are one document that has the links of each of its texts. text_kept looks at the row's own
    text instead: no smaller id has this text or one that links reach from it; it is true for rows without shingles or id. An empty table gives no rows. Columns beyond doc_id and text are not read.
    """
    kind = documents.schema["doc_id"].dataType
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("h"), "text")  # h tells the texts of one id apart
    signed = cut(_signed(docs, size))
    real = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = real.groupBy("digest").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("rep"), "digest", "at.doc_id", "at.h", "n", "sig"))
    several = real.groupBy("doc_id").agg((F.min(F.xxhash64("digest")) != F.max(F.xxhash64("digest"))).alias("differ")).where("differ").select("doc_id")
    texts_of_one = cut(real.select("doc_id", "digest").join(several, "doc_id", "left_semi").distinct().join(classes.select("digest", "rep"), "digest").select("doc_id", "rep"))
    same = texts_of_one.join(texts_of_one.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b")).where("a != b")

    posts = classes.select("rep", F.posexplode("sig").alias("i", "v"))
    lengths = posts.groupBy("i", "v").agg(F.count("*").alias("c")).where("c > 1")
    listed = posts.join(lengths, ["i", "v"]).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("c", "i", "v"))).alias("at"))
    listed = listed.where(F.size("at") >= agreement(share))
    prefix = F.slice("at", 1, F.size("at") - agreement(share) + 1)
    weight = F.aggregate("at", F.lit(0).cast("bigint"), lambda acc, x: acc + x["c"])
    lists = cut(listed.select("rep", weight.alias("w"), F.explode(prefix).alias("p")).select("rep", "w", "p.i", "p.v"))

    hubs = lists.groupBy("i", "v").agg(F.min(F.struct(-F.col("w"), "rep")).alias("hub"), F.count("*").alias("c")).where("c > 1").select("i", "v", F.col("hub.rep").alias("b"))
    stars = lists.join(hubs, ["i", "v"]).select(F.col("rep").alias("a"), "b").where("a != b").distinct()
    # a member of several lists is first held against the hub that agrees with it most
    best = _agreeing(stars, classes, share).groupBy("a").agg(F.max(F.struct("agree", F.col("b"))).alias("x")).select("a", F.col("x.b").alias("b"))
    eligible = lists.select("rep").distinct().join(classes.select("rep", "doc_id", "h"), "rep")
    texts = docs.join(eligible.hint("shuffle_hash"), ["doc_id", "h"]).groupBy("doc_id", "h", "rep").agg(F.max("text").alias("text"))
    sets = cut(_sets(texts, size))
    first = cut(_confirmed(best, sets, share))
    comp = components(first)

    member = lists.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("i", "v", "rep", F.coalesce("comp", "rep").alias("comp"))
    split = member.groupBy("i", "v").agg((F.min("comp") != F.max("comp")).alias("split"), F.count("*").alias("c")).where("split")
    open_ = cut(member.join(split.select("i", "v", "c"), ["i", "v"]))
    short = open_.where(F.col("c") <= SHORT).select("i", "v", "rep", "comp")
    other = short.select("i", "v", F.col("rep").alias("b"), F.col("comp").alias("comp_b"))
    rest = short.withColumnRenamed("rep", "a").join(other, ["i", "v"]).where("comp < comp_b").select("a", "b").distinct()
    more = _confirmed(_agreeing(rest, classes, share), sets, share)
    long = open_.where(F.col("c") > SHORT).join(hubs.withColumnRenamed("b", "hub"), ["i", "v"]).select("hub", "rep", "comp").distinct()
    hub_comp = long.where("rep = hub").select("hub", F.col("comp").alias("hub_comp"))
    joined = _long_lists(long.join(hub_comp, "hub").join(classes.select("rep", "n"), "rep"), sets, share)
    texts_linked = components(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(more).unionAll(joined))

    def lowest(linked: DataFrame, name: str) -> DataFrame:
        held = linked.withColumnRenamed("node", "rep").join(classes.select("rep", "doc_id"), "rep")
        return held.join(held.groupBy("comp").agg(F.min("doc_id").alias(name)), "comp").select("rep", name)

    by_class = classes.join(lowest(texts_linked, "text_low"), "rep", "left")
    if same.isEmpty():
        by_class = by_class.withColumn("low", F.col("text_low"))
    else:
        final = components(texts_linked.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionAll(same))
        by_class = by_class.join(lowest(final, "low"), "rep", "left")
    by_class = by_class.select("digest", F.coalesce("low", "doc_id").alias("component_id"), F.coalesce("text_low", "doc_id").alias("text_low"))
    out = signed.select("doc_id", F.col("h").alias("text_hash"), "digest", F.col("n").alias("n_shingles")).join(by_class, "digest", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_shingles", own.cast(kind).alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(False)).alias("kept"), "text_hash", F.coalesce(F.col("text_low") == F.col("doc_id"), F.lit(True)).alias("text_kept"))
