"""Whitening of embeddings along their leading principal components, by Chebyshev-filtered subspace iteration.

Vectors become whole numbers; the distinct ones make the fit list, whose sums are exact. A small block of directions Q is
improved in rounds: each applies a polynomial of the covariance V to it, one pass over the fit list for each degree
(every task adds up its rows' share of XᵀXQ, centred first; the sums have as many rows as a vector has entries). The
polynomial is a Chebyshev one scaled to the unwanted part of the spectrum, which it damps, while it blows up what lies
above. QR and a Rayleigh-Ritz step on the small block then give values and directions. Rounds end once the residuals of
the wanted ones are down at rounding errors and nothing larger can have been missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import written

COMPONENTS = 4
SCALE = 256
#: Directions beyond the wanted ones; the damped part of the spectrum begins at the last.
GUARD = 16
DEGREE = 8
#: Residuals, as a share of the largest eigenvalue, at which a direction counts as found.
TOLERANCE = 2.0**-47
#: Rounds after which the block is doubled; a block of all directions is exact.
PATIENCE = 12
BLOCK_BYTES = 4 << 20
SAFE = 1 << 62

OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"


def whole_numbers(rows: DataFrame, vector: str, x: str) -> DataFrame:
    """Rows whose vector has finite entries only, with ``x``: floor(256 c) of each entry c, as long."""
    value = F.col(vector)
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.filter(value.isNotNull() & ~bad).withColumn(x, F.transform(value, lambda c: F.floor(c.cast("double") * SCALE)))


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    """A list column as a matrix; shorter vectors have zeros behind."""
    values, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == d).all():
        return values.reshape(-1, d)
    out = np.zeros((len(sizes), d), np.int64)
    out[np.arange(d) < sizes[:, None]] = values
    return out


def _times(a: np.ndarray, n: int, s: list[int]) -> np.ndarray:
    """``n a - s``, exactly: in 64 bits where they hold it, else in Python's numbers."""
    most = max((abs(int(a.max(initial=0))), abs(int(a.min(initial=0))), 0))
    if most * n + max(map(abs, s), default=0) < SAFE:
        return a * n - np.array(s, np.int64)
    return a.astype(object) * n - np.array(s, object)


class Fit:
    """The fit list, written in blocks of vectors, with its count, exact sums and passes over it."""

    def __init__(self, distinct: DataFrame, d: int):
        """``distinct`` has one column of whole-number vectors, each once."""
        self.d = d
        per_block = max(1, BLOCK_BYTES // (8 * d))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                all_ = _vectors(batch.column(0), d)
                parts = [all_[k : k + per_block] for k in range(0, len(all_), per_block)]
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], ["block"])

        self.blocks = written(distinct.mapInArrow(blocks, "block binary"), "fit-list")

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, [0] * d
            for a in _matrices(batches, d):
                exact = a if int(np.abs(a).max(initial=0)) * len(a) < SAFE else a.astype(object)
                n, total = n + len(a), [t + int(v) for t, v in zip(total, exact.sum(axis=0), strict=True)]
            if n:
                yield pa.RecordBatch.from_pydict({"dim": pa.array(range(d), pa.int32()), "n": pa.array([n] * d, pa.int64()), "s": pa.array(list(map(str, total)))})

        each = self.blocks.mapInArrow(sums, "dim int, n long, s string")
        got = each.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
        self.n = got[0].n if got else 0
        self.s = [int(r.s) for r in sorted(got, key=lambda r: r.dim)]
        self.trace = 0.0

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, for a matrix of few columns; also sets the trace of V."""
        d, n, s, k = self.d, self.n, self.s, q.shape[1]
        names = ["t", *(f"y{j}" for j in range(k))]

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            y = None
            for a in _matrices(batches, d):
                c = _times(a, n, s).astype(np.float64) / n
                own = np.column_stack([np.einsum("ij,ij->j", c, c), c.T @ (c @ q)])
                y = own if y is None else y + own
            if y is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(np.ascontiguousarray(v)) for v in y.T)], ["dim", *names])

        each = self.blocks.mapInArrow(partial, "dim int, " + ", ".join(f"{x} double" for x in names))
        rows = sorted(each.groupBy("dim").agg(*(F.sum(x).alias(x) for x in names)).collect(), key=lambda r: r.dim)
        got = np.array([r[1:] for r in rows], np.float64) / n
        self.trace = float(got[:, 0].sum())
        return got[:, 1:]


def _matrices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for block in batch.column(0):
            yield np.frombuffer(block.as_py(), np.int64).reshape(-1, d)


def filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, upto: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """A Chebyshev polynomial of V times ``q``: small for eigenvalues in [0, upto], near 1 at ``top``; ``vq`` is V q."""
    half = upto / 2
    sigma = first = half / (top - half)
    before, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * after / half) - before * (sigma * after)
        sigma = after
    return now


def leading(times: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, trace: Callable[[], float], guard: int = GUARD, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of V, falling, and their unit vectors as columns.

    A direction is found when its residual is down at rounding errors. Whether a larger eigenvalue is missing is settled
    by the trace where what the block leaves of it is less than the last wanted value; else by one more round in which
    fresh random directions replace the guard and no wanted value moves. Should rounds not get there the block grows, up
    to all directions, where the Rayleigh-Ritz step is the whole eigenproblem.
    """
    rng = np.random.default_rng(seed)
    wanted, k = min(wanted, d), min(d, wanted + guard)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    rounds, probed, best = 0, False, np.inf
    while True:
        vq = times(q)
        h = q.T @ vq
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        top = values[0]
        if top <= 0 or k == d:
            return values[:wanted], q[:, :wanted]
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / top
        done = residual <= TOLERANCE or residual <= 16 * TOLERANCE and residual > best / 2
        best = min(best, residual)
        if done and (probed or trace() - values.sum() < values[wanted - 1]):
            return values[:wanted], q[:, :wanted]
        rounds += 1
        if rounds % PATIENCE == 0:
            k, best = min(d, 2 * k), np.inf
            q = np.linalg.qr(np.column_stack([q, rng.standard_normal((d, k - q.shape[1]))]))[0]
            probed = False
            continue
        if done:
            probed = True
            q = np.linalg.qr(np.column_stack([q[:, :wanted], rng.standard_normal((d, k - wanted))]))[0]
            vq = times(q)
        q = np.linalg.qr(filtered(times, q, vq, max(values[-1], top * 1e-6), top))[0]


def whitened(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per row with a finite vector and component: ``ident`` and the columns of ``OUT``.

    Rows whose vector is null or has a null or non-finite entry are left out, shorter vectors have zeros behind, repeated
    rows and null ids stay rows of their own, other columns are ignored, an empty table gives no rows. There are at most
    as many components as entries. Where the fit list doesn't vary along a component ``whitened`` is null, and
    ``explained`` too if it doesn't vary at all. Entries over 64 bits become the nearest long. ``deviation`` is null
    where 64 bits don't hold it; ``deviation_exact`` has it up to 38 digits.
    """
    spark = rows.sparkSession
    kind = rows.schema[ident].dataType.simpleString()
    numbers = whole_numbers(rows.select(F.col(ident).alias("ident"), F.col(vector).alias("v")), "v", "x").select("ident", "x")
    schema = f"`{ident}` {kind}, {OUT}"
    d = numbers.agg(F.max(F.size("x"))).first()[0]
    if not d:
        return spark.createDataFrame([], schema)
    padded = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("x")))
    fit = Fit(numbers.select(padded.alias("x")).distinct(), d)
    values, vectors = leading(fit.times, d, components, lambda: fit.trace)
    varies = values > max(values[0], 0) * d * 2.0**-50
    scaled = np.where(varies, vectors / np.sqrt(np.where(varies, values, 1)), 0)
    error = float(np.abs(scaled[:, varies].T @ fit.times(scaled[:, varies]) - np.eye(int(varies.sum()))).max()) if varies.any() else None
    n, s, trace, c = fit.n, fit.s, fit.trace, len(values)
    explained = [float(e) / trace if trace > 0 else None for e in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1), d)
            far = _times(x, n, s)
            if far.dtype == object or float(np.abs(far).max()) ** 2 * d >= SAFE:
                exact = [int(v) for v in (far.astype(object) ** 2).sum(axis=1)]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
                whole = pa.array([v if v < 10**38 else None for v in exact], pa.decimal128(38, 0)) if max(exact) >= 1 << 63 else deviation.cast(pa.decimal128(38, 0))
            else:
                deviation = pa.array((far**2).sum(axis=1))
                whole = deviation.cast(pa.decimal128(38, 0))
            centred = far.astype(np.float64) / n if far.dtype != object else np.array([[float(Fraction(v, n)) for v in row] for row in far])
            w = centred @ scaled
            m = batch.num_rows
            at = pa.array(np.repeat(np.arange(m), c))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * c, n, np.int64)),
                    deviation.take(at),
                    pa.array(w.ravel(), mask=~np.tile(varies, m)),
                    pa.array(explained * m, pa.float64()),
                    pa.array([error] * (m * c), pa.float64()),
                    whole.take(at),
                ],
                [ident, *(f.split()[0] for f in OUT.replace("(38,0)", "").split(", "))],
            )

    return numbers.mapInArrow(project, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
