"""Text quality: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turns over the features and then over the strongest pairs, add up to one lookup table for each
feature and each pair; a text's score is a sum of table entries. The fit sees a bounded sample of labelled rows
(``SAMPLE``), the score sees every row's whole text. Nothing but the text enters a score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import id_crc

SAMPLE = 8000  # labelled rows that the fit reads at most, the first by a hash of the id
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 60, 0.15, 12

FEATURES = (
    "log_bytes", "log_words", "word_length", "longest_word", "upper_words", "upper_letters", "non_ascii", "digits", "blanks", "exclaims", "bars", "marks", "odd_signs",
    "brackets", "bare_words", "short_words", "distinct_words", "top_word", "repeats", "lines", "line_length", "distinct_lines", "closed_lines",
)
_CLASSES = {k: np.frombuffer(v, np.uint8) for k, v in {"upper_letters": bytes(range(65, 91)), "digits": b"0123456789", "blanks": b" \t\n\r\x0b\x0c", "exclaims": b"!", "bars": b"|", "marks": b".,;:?'\"-", "odd_signs": b"#$%&*@^~_=+\\/`", "brackets": b"<>{}[]()"}.items()}


def features(text: str | None) -> list[float]:
    """The values of ``FEATURES`` for one text; null counts as empty, for which every share is 0."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n, w, rows = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    share = {k: float(counts[v].sum()) / n for k, v in _CLASSES.items()}
    tally, lengths = Counter(words), list(map(len, words))
    values = share | {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)), "word_length": sum(lengths) / w, "longest_word": np.log1p(max(lengths, default=0)),
        "upper_words": sum(x.isupper() for x in (text or "").split()) / w, "non_ascii": float(counts[128:].sum()) / n,
        "bare_words": sum(not any(c > 127 or 65 <= c <= 90 or 97 <= c <= 122 for c in x[:8]) for x in tally) / max(len(tally), 1),
        "short_words": sum(k <= 3 for k in lengths) / w, "distinct_words": len(tally) / w ** 0.85, "top_word": max(tally.values(), default=0) / w,
        "repeats": sum(map(bytes.__eq__, words, words[1:])) / w, "lines": np.log1p(len(lines)), "line_length": np.log1p(len(data) / rows),
        "distinct_lines": len(set(lines)) / rows, "closed_lines": sum(x.rstrip().endswith((b".", b"!", b"?", b":", b'"')) for x in lines) / rows,
    }
    return [float(values[k]) for k in FEATURES]


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _shrunk(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    return grad / (hess + 1.0)


def _tree(grad: np.ndarray, hess: np.ndarray, count: np.ndarray, splits: int = 2) -> np.ndarray:
    """A tree of at most ``splits`` + 1 leaves over ordered bins: each bin's step."""
    cuts = [0, len(grad)]
    gain = lambda a, b: grad[a:b].sum() ** 2 / (hess[a:b].sum() + 1.0)
    for _ in range(splits):
        best, at = 1e-9, None
        for a, b in zip(cuts, cuts[1:], strict=False):
            g, h, c = np.cumsum(grad[a:b])[:-1], np.cumsum(hess[a:b])[:-1], np.cumsum(count[a:b])[:-1]
            if not len(g):
                continue
            more = g**2 / (h + 1) + (grad[a:b].sum() - g) ** 2 / (hess[a:b].sum() - h + 1) - gain(a, b)
            more[(c < LEAST) | (count[a:b].sum() - c < LEAST)] = -1
            if more.max() > best:
                best, at = more.max(), a + 1 + int(more.argmax())
        if at is None:
            break
        cuts = sorted({*cuts, at})
    out = np.zeros(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = _shrunk(grad[a:b].sum(), hess[a:b].sum())
    return out


class Gam:
    """The tables. ``fit`` takes an array of feature rows and labels of 0 and 1; without both labels the score is their share."""

    def __init__(self) -> None:
        self.base, self.edges, self.tables = 0.0, [], []
        self.pairs: list[tuple[int, int]] = []
        self.pair_edges: list[np.ndarray] = []
        self.pair_tables: list[np.ndarray] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Gam:
        share = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        n = x.shape[1]
        self.edges = [_edges(x[:, f], BINS) for f in range(n)]
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, self.tables, strict=True)]
        raw = np.full(len(y), self.base)
        for _ in range(ROUNDS):
            for b, t, c in zip(bins, self.tables, counts, strict=True):
                p = 1 / (1 + np.exp(-raw))
                step = RATE * _tree(np.bincount(b, y - p, len(t)), np.bincount(b, p * (1 - p), len(t)), c)
                t += step
                raw += step[b]
        self._fit_pairs(x, y, raw)
        return self

    def _fit_pairs(self, x: np.ndarray, y: np.ndarray, raw: np.ndarray) -> None:
        """The pairs whose grids take most of what the single features leave, then their tables in turns: each step a tree over one side within halves of the other."""
        self.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
        bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        p = 1 / (1 + np.exp(-raw))
        sums = lambda i, j, v: np.bincount(bins[i] * PAIR_BINS + bins[j], v, PAIR_BINS**2)
        gain = {(i, j): float((sums(i, j, y - p) ** 2 / (sums(i, j, p * (1 - p)) + 1)).sum()) for i, j in combinations(range(x.shape[1]), 2)}
        self.pairs = sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]
        self.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in self.pairs]
        for turn in range(PAIR_ROUNDS):
            for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
                p = 1 / (1 + np.exp(-raw))
                g, h, c = (sums(i, j, v).reshape(PAIR_BINS, PAIR_BINS) for v in (y - p, p * (1 - p), np.ones(len(y))))
                cut = 1 + turn % (PAIR_BINS - 1)
                step = np.zeros_like(t)
                for part in (slice(0, cut), slice(cut, None)):
                    step[part] = RATE * _tree(g[part].sum(0), h[part].sum(0), c[part].sum(0), 1)
                t += step
                raw += step[bins[i], bins[j]]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            raw += t[np.searchsorted(e, x[:, f], side="right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            raw += t[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-raw))


def _with_features(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pa.array([features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("quality"), x], ["quality", "x"])

    return df.select("quality", "text").mapInArrow(run, "quality int, x array<double>")


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """Fits on labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most ``sample`` of them. Null ids and labels other
    than 0 and 1 are left out; of an id with both labels the lower counts; of an id with several texts the least is read, however many rows it has."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % 3 != 1))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most ``sample`` rows of two numbers, so they go to every executor
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = _with_features(texts).orderBy(F.xxhash64("x", "quality"), "quality").limit(sample).collect()
    x = np.array([r.x for r in rows], dtype=float).reshape(len(rows), len(FEATURES))
    return Gam().fit(x, np.array([r.quality for r in rows], dtype=float))


def with_scores(documents: DataFrame, model: Gam) -> DataFrame:
    """Every row and column, with quality_score (double, 0 to 1). Null and empty texts are scored like any; columns of that name are replaced; an empty table stays empty."""
    documents = documents.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column("text").to_pylist()], dtype=float).reshape(b.num_rows, len(FEATURES))
            yield b.append_column("quality_score", pa.array(model.score(x), pa.float64()))

    return documents.mapInArrow(run, documents.withColumn("quality_score", F.lit(0.0)).schema)
