"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first traversal.

The tree is fitted on a bounded sample (``sample_size``: it grows with the root of the table, so that leaves and what a query
visits grow alike) and sent to every executor; every row is indexed into a leaf. A query walks the tree through a priority queue of branches, nearest first. How many leaves it visits is
calibrated: a bounded set of queries is held against all rows exactly, and the visits are widened until the wanted share
of their true neighbours lies in visited leaves. Only distinct vectors are compared; of equal vectors the smallest ids
suffice, as ties go to them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import cut

SAMPLE, SAMPLE_MOST = 8192, 65536  # vectors that the tree is fitted on, at least and at most
FAN, LEAF = 8, 48  # children of a node; vectors of the sample in a leaf, about
CALIBRATION = 256  # queries held against all rows to calibrate the visits
RECALL = 0.93  # share of their neighbours that visited leaves must hold; 256 queries estimate it within some 0.02, so that 0.9 is reached
ROWS = 4096  # vectors of a leaf that are compared at a time


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        owner = np.argmax(x @ centres.T, axis=1)
        new = np.zeros_like(centres)
        np.add.at(new, owner, x)
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(norm > 0, new / np.where(norm > 0, norm, 1), centres)
        if np.allclose(new, centres):
            break
        centres = new
    return centres


class Tree:
    """Nodes of unit centres. ``children[n]`` is a list of (node, is_leaf); leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, fan: int = FAN, leaf: int = LEAF, seed: int = 7):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # a leaf l stands as ~l
        self.leaves = 0
        self.root = self._grow(x, fan, leaf, np.random.default_rng(seed))

    def _grow(self, x: np.ndarray, fan: int, leaf: int, rng: np.random.Generator) -> int:
        if len(x) <= leaf or len(distinct := np.unique(x, axis=0)) <= fan:
            self.leaves += 1
            return ~(self.leaves - 1)
        centres = _kmeans(distinct, min(fan, len(distinct)), rng)
        owner = np.argmax(x @ centres.T, axis=1)
        used = np.unique(owner)
        if len(used) < 2:
            self.leaves += 1
            return ~(self.leaves - 1)
        node = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[node] = [self._grow(x[owner == u], fan, leaf, rng) for u in used]
        return node

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf each row goes down to."""
        out = np.zeros(len(x), np.int32)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = ~node
            elif len(rows):
                owner = np.argmax(x[rows] @ self.centres[node].T, axis=1)
                todo += [(c, rows[owner == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray, most: int | None = None, held: np.ndarray | None = None, least: int = 0) -> list[int]:
        """Leaves in best-bin-first order: the branch whose centre is nearest to the query comes next. With the number of ids that each leaf holds, on past ``most`` leaves until they have ``least``."""
        out: list[int] = []
        queue = [(-1.0, 0, self.root)]
        n = seen = 0
        while queue and (most is None or len(out) < most or held is not None and seen < least):
            _, _, node = heapq.heappop(queue)
            while node >= 0:
                near = self.centres[node] @ q
                order = np.argsort(-near, kind="stable")
                for i in order[1:]:
                    n += 1
                    heapq.heappush(queue, (-float(near[i]), n, self.children[node][i]))
                node = self.children[node][order[0]]
            out.append(~node)
            seen += 0 if held is None else int(held[~node])
        return out


def sample_size(rows: int) -> int:
    return min(SAMPLE_MOST, max(SAMPLE, int(36 * rows**0.5)))


def _stack(column: pa.Array) -> np.ndarray:
    """Vectors of one length without nulls as a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id bigint, v array<double>) of the rows that take part: id and vector there, components finite, not all zero, and of the commonest length."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fine = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda c: c != 0))
    size = fine.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return fine.where(F.size("v") == (size["d"] if size else 0))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)


def _top(q: np.ndarray, ids: np.ndarray, x: np.ndarray, entries: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, vec_id, cosine) of the k nearest of the rows x to each q, ties to smaller ids; each row stands for its entries (ids of equal vectors); a query's own id is left out."""
    score = q @ x.T / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])
    keep = min(k + 1, len(x))
    out: list[tuple[int, int, float]] = []
    for i in range(len(q)):
        low = np.partition(score[i], len(x) - keep)[len(x) - keep]
        near = [(-score[i, j], int(e), i) for j in np.flatnonzero(score[i] >= low - 1e-12) for e in entries[j] if e != ids[i]]
        out += [(i, e, -s) for s, e, _ in sorted(near)[:k]]
    a = np.array(out, dtype=object).reshape(len(out), 3)
    return a[:, 0].astype(np.int64), a[:, 1].astype(np.int64), a[:, 2].astype(np.float64)


def nearest(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: of each row that ``is_query`` holds for, the k nearest other rows found, by cosine.

    Rows whose id or vector is null, zero or holds a null or non-finite component take no part, nor do those of another
    length than most. Repeated rows of one id count once; equal vectors tie to the smaller id. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    # of equal vectors the k + 1 smallest ids: no other can be among the k nearest of any query; a partial limit runs before the exchange
    first = whole.withColumn("h", F.xxhash64("v")).withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    rows = cut(first.groupBy("h", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("v", "ids"))
    queries = cut(whole.where(is_query).select(F.col("vec_id").alias("query_id"), "v"))
    schema = "query_id bigint, vec_id bigint, score double"

    sample = rows.orderBy(F.xxhash64("v")).limit(sample_size(rows.count())).select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    tree = Tree(_unit(np.array(sample.tolist(), dtype=np.float64)))
    sent = spark.sparkContext.broadcast(tree)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaf", pa.array(sent.value.assign(_unit(_stack(b.column("v")))), pa.int32()))

    indexed = cut(rows.mapInArrow(index, "v array<double>, ids array<bigint>, leaf int"))
    visits = _calibrated(indexed, queries, tree, k)
    held = np.zeros(tree.leaves, np.int64)  # k + 1 ids besides or with a query's own are k neighbours
    for r in indexed.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).collect():
        held[r.leaf] = r.n

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.append_column("leaves", pa.array([sent.value.visits(q, visits, held, k + 1) for q in _unit(_stack(b.column("v")))], pa.list_(pa.int32())))

    # a leaf of many rows is split into parts of bounded size; the counts are as few as the tree's leaves
    parts = indexed.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.ceil(F.col("n") / ROWS).cast("int").alias("parts"))
    leaf_rows = indexed.join(F.broadcast(parts), "leaf").select("leaf", F.pmod(F.xxhash64("v"), "parts").cast("int").alias("part"), "v", "ids")
    asked = queries.mapInArrow(walk, "query_id bigint, v array<double>, leaves array<int>").select("query_id", "v", F.explode("leaves").alias("leaf"))
    asked = asked.join(F.broadcast(parts), "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "query_id", "v")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(left) or not len(right):
            return empty
        x, entries, found = np.stack(right["v"].to_numpy()), right["ids"].tolist(), [empty]
        for at in range(0, len(left), 512):
            ids, q = left["query_id"].to_numpy()[at : at + 512], np.stack(left["v"].to_numpy()[at : at + 512])
            i, e, s = _top(q, ids, x, entries, k)
            found.append(pd.DataFrame({"query_id": ids[i], "vec_id": e, "score": s}))
        return pd.concat(found[1:])

    pairs = asked.groupBy("leaf", "part").cogroup(leaf_rows.groupBy("leaf", "part")).applyInPandas(compare, schema)
    return _best(pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _calibrated(indexed: DataFrame, queries: DataFrame, tree: Tree, k: int) -> int:
    """Visits after which ``RECALL`` of the true neighbours of ``CALIBRATION`` queries, held against every row, are in visited leaves."""
    some = queries.orderBy(F.xxhash64("query_id")).limit(CALIBRATION).collect()
    if not some:
        return 1
    q, ids = np.array([r.v for r in some], dtype=np.float64), np.array([r.query_id for r in some])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                entries, leaf = b.column("ids").to_pylist(), b.column("leaf").to_numpy()
                i, e, s = _top(q, ids, _stack(b.column("v")), entries, k)
                own = {x: int(n) for xs, n in zip(entries, leaf, strict=True) for x in xs}
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(e), pa.array(s), pa.array([own[int(x)] for x in e], pa.int32())], ["query_id", "vec_id", "score", "leaf"])

    # CALIBRATION * k rows reach the driver
    found = _best(indexed.mapInArrow(exact, "query_id bigint, vec_id bigint, score double, leaf int"), k).select("query_id", "leaf").collect()
    place = {int(i): {leaf: n for n, leaf in enumerate(tree.visits(u))} for i, u in zip(ids, _unit(q), strict=True)}
    needed = sorted(place[r.query_id][r.leaf] + 1 for r in found)
    return needed[min(int(np.ceil(RECALL * len(needed))), len(needed)) - 1] if needed else 1
