"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are cut into bins. Shallow trees on one feature at a time, boosted in turn with a small step, add up to
one lookup table per feature; then trees on the most useful feature pairs add up to tables of two bins. A score is the
sum of the tables' entries through the logistic function: a few vectorised additions per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import documents

#: Labelled rows that the model is fitted on at most: those with the smallest hash of their id.
MOST_LABELLED = 20_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, STEP, LEAST_LEAF = 200, 60, 0.1, 15
SMOOTH = 1.0

FEATURES = (
    "log_words", "word_length", "symbols", "bars", "exclamations", "capitals", "digits", "commas_stops", "other_signs", "non_ascii", "line_words",
    "distinct_words", "repeated_lines", "short_words", "bare_signs",
)


def _classes() -> np.ndarray:
    """The class of each byte, as a bit: several features count bytes of one class."""
    of = np.zeros(256, dtype=np.uint16)
    for bit, members in enumerate((b"#*$%&<>@^~", b"|", b"!", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?", b"\"'()[]{}-_=+/\\`", bytes(range(128, 192)), b"\n", b" \t\n\x0b\x0c\r")):
        of[list(members)] |= 1 << bit
    return of


CLASSES = _classes()


def features(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each whole text; a null text is an empty one, whose shares are all 0."""
    raw = [(t or "").encode() for t in texts.to_pylist()]
    out = np.zeros((len(raw), len(FEATURES)))
    for row, data in zip(out, raw, strict=True):
        counts = np.bincount(CLASSES[np.frombuffer(data, dtype=np.uint8)], minlength=1024)
        by_bit = counts @ BITS
        words = data.split()
        n, chars = len(words), len(data) - by_bit[9]
        if not n:
            continue
        lines = [x for x in data.split(b"\n") if x.strip()]
        row[0] = np.log1p(n)
        row[1] = chars / n
        row[2:10] = by_bit[:8] / chars
        row[10] = n / len(lines)
        row[11] = len(set(words)) / n
        row[12] = 1 - len(set(lines)) / len(lines)
        row[13] = sum(len(w) <= 3 for w in words) / n
        row[14] = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    return out


BITS = np.array([[(k >> b) & 1 for b in range(10)] for k in range(1024)])


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    coarse: list[np.ndarray]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.edges)
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[bins[:, j]]
        for a, b, table in self.pairs:
            total += table[self.coarse[a][bins[:, a]], self.coarse[b][bins[:, b]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def _best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """(gain, k): bins below k go left. Gain 0 where no split leaves enough rows on both sides."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = gl**2 / (hl + SMOOTH) + gr**2 / (hr + SMOOTH) - g.sum() ** 2 / (h.sum() + SMOOTH)
    gain[(nl < LEAST_LEAF) | (nr < LEAST_LEAF)] = 0
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """A shallow tree's value for every bin of one feature, from its bins' gradients, weights and rows."""
    gain, k = _best_split(g, h, n) if depth else (0.0, 0)
    if gain <= 0:
        return np.full(len(g), g.sum() / (h.sum() + SMOOTH))
    return np.concatenate([tree(g[:k], h[:k], n[:k], depth - 1), tree(g[k:], h[k:], n[k:], depth - 1)])


def pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values) of the better tree on two features: a cut of one, then a cut of the other on either side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + SMOOTH)))
    for axis in (0, 1):
        a, b, c = (x if axis == 0 else x.T for x in (g, h, n))
        for k in range(1, len(a)):
            gain, values = 0.0, np.empty(a.shape)
            for part in (slice(None, k), slice(k, None)):
                sg, sh, sn = a[part].sum(0), b[part].sum(0), c[part].sum(0)
                gain += sg.sum() ** 2 / (sh.sum() + SMOOTH) + _best_split(sg, sh, sn)[0]
                values[part] = tree(sg, sh, sn, 1)
            gain -= a.sum() ** 2 / (b.sum() + SMOOTH)
            if gain > best[0]:
                best = gain, values if axis == 0 else values.T
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosts the tables on rows ``x`` (features) and ``y`` (0 or 1). One label only, or no row, gives a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    p = x.shape[1]
    quantiles = np.arange(1, BINS) / BINS
    edges = [np.unique(np.quantile(x[:, j], quantiles)) if len(x) else np.array([]) for j in range(p)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    coarse = [np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1) for e in edges]
    model = Model(edges, tables, [], coarse, bias)
    if len(y) == 0 or y.min() == y.max():
        return model
    bins, total = binned(x, edges), np.full(len(y), bias)
    rows = [np.bincount(bins[:, j], minlength=len(tables[j])) for j in range(p)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(ROUNDS):
        for j in range(p):
            g, h = slopes()
            size = len(tables[j])
            step = STEP * tree(np.bincount(bins[:, j], g, size), np.bincount(bins[:, j], h, size), rows[j])
            tables[j] += step
            total += step[bins[:, j]]
    rough = np.stack([coarse[j][bins[:, j]] for j in range(p)], axis=1)

    def grid(a: int, b: int, w: np.ndarray | None) -> np.ndarray:
        return np.bincount(rough[:, a] * PAIR_BINS + rough[:, b], w, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    gains = sorted(((pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))[0], a, b) for a, b in combinations(range(p), 2)), reverse=True)
    model.pairs = [(a, b, np.zeros((PAIR_BINS, PAIR_BINS))) for gain, a, b in gains[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            g, h = slopes()
            step = STEP * pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))[1]
            table += step
            total += step[rough[:, a], rough[:, b]]
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the fold of an id, crc32 of its digits modulo ``FOLDS``, is the held-out one; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = features(batch.column(1))
        values = pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(FEATURES), dtype=np.int32), found.ravel())
        yield pa.RecordBatch.from_arrays([batch.column(0), values], names=["doc_id", "x"])


def trained(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """The model from ``labels`` (doc_id, quality) outside the held-out fold, over at most ``most`` labelled rows.

    Disagreeing labels of an id count by their mean; of rows that share an id the one with the smallest features counts.
    """
    marked = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    own = docs.select("doc_id", "text").join(F.broadcast(marked.select("doc_id")), "doc_id")  # at most ``most`` ids
    rows = own.mapInArrow(_featurise, "doc_id long, x array<double>").groupBy("doc_id").agg(F.min("x").alias("x")).join(marked, "doc_id").collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return fit(np.array([r["x"] for r in rows]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], dtype=float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row; null and empty texts get the score of an empty text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of at most BINS entries per feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(features(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return scored(docs, trained(docs, labels))
