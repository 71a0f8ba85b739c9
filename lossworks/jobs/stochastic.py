"""Over-dispersed Poisson fit and bootstrap of a triangle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.draws import text_key, uniform_array
from lossworks.functions.order import percentiles
from lossworks.functions.tables import written
from lossworks.jobs.variance import estimators
from lossworks.operators.triangles import ROW, latest

SEG = ["segment", "kind"]
ZERO = 1e-10
#: A cell that the fit meets up to this share of its cumulative amount has no residual: what is left is rounding.
ROUNDING = 1e-12
LEAST_POOL, LEAST_SIMS, BLOCK = 10, 100, 500
PERCENTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.995)


def odp_cells(cells: DataFrame) -> DataFrame:
    """Observed cells with ``incremental, fitted, residual``: fitted ones by dividing back from the latest diagonal."""
    row = Window.partitionBy(*ROW).orderBy("age_idx")
    back = Window.partitionBy(*ROW).orderBy(F.desc("age_idx")).rowsBetween(Window.unboundedPreceding, 0)
    f = estimators(cells).select(*SEG, "age_idx", "f")
    big = cells.groupBy(*SEG).agg(F.countDistinct("origin_idx").alias("_i"), F.countDistinct("age_idx").alias("_k")).filter("_i >= 3 and _k >= 3").select(*SEG)
    rows = cells.join(big, SEG).join(latest(cells).select(*ROW, "latest_idx", "latest"), list(ROW)).filter("age_idx <= latest_idx").join(f, [*SEG, "age_idx"], "left")
    step = F.when(F.col("age_idx") < F.col("latest_idx"), F.col("f")).otherwise(1.0)
    rows = rows.withColumn("_cum", F.col("latest") / F.product(step).over(back))
    rows = rows.withColumns({
        "incremental": F.when(F.col("age_idx") == 0, F.col("value")).otherwise(F.col("value") - F.lag("value").over(row)),
        "fitted": F.col("_cum") - F.coalesce(F.lag("_cum").over(row), F.lit(0.0)),
    })
    gap = F.col("incremental") - F.col("fitted")
    r = F.when(F.col("fitted") > 0, gap / F.sqrt("fitted"))
    # the rounding of a corner's residual grows with the amounts, beyond any fixed bound
    zero = (F.abs(r) <= ZERO) | (r.isNotNull() & (F.abs(gap) <= ROUNDING * F.greatest(F.abs("value"), F.abs("_cum"))))
    return rows.select(*SEG, "origin", "origin_idx", "age", "age_idx", "latest_idx", "incremental", "fitted", F.when(zero, 0.0).otherwise(r).alias("residual"))


def odp_fit(cells: DataFrame) -> DataFrame:
    """Per segment ``n, p, phi, pool``: usable residuals, parameters, dispersion, residuals that are not zero.

    Segments without degrees of freedom have no rows.
    """
    rows = odp_cells(cells)
    out = rows.groupBy(*SEG).agg(F.count("residual").alias("n"), (2 * F.countDistinct("origin_idx") - 1).alias("p"), F.sum(F.col("residual") * F.col("residual")).alias("_ss"), F.count_if(F.abs("residual") > ZERO).alias("pool"))
    return out.filter("n > p").withColumn("phi", F.col("_ss") / (F.col("n") - F.col("p"))).drop("_ss")


def bootstrap(cells: DataFrame, n_sims: int = 1000, seed: int = 1, bias_adjust: bool = True, process_variance: bool = True, counted: bool = False) -> DataFrame:
    """``segment, kind, origin, sim, unpaid``: simulated reserves per origin.

    A segment is one row of small arrays; blocks of simulations are dealt to tasks and drawn by a generator of their own
    (seed, segment, block), so results don't depend on the partitioning. Residuals are resampled, the triangle refitted
    and projected; each future cell then varies as a gamma with the fit's dispersion. A resample that can't be refitted
    keeps the original factors; non-positive future means are added as they are. ``counted`` picks residuals by a counter
    hash of seed, segment, origin, age and simulation that any engine can compute; it has no process variance.
    """
    if counted and process_variance:
        raise ValueError("BAD_OPTION: counted draws have no process variance")
    if n_sims < LEAST_SIMS:
        raise ValueError(f"TOO_FEW_SIMS: at least {LEAST_SIMS}")
    fit = odp_fit(cells).filter(F.col("pool") >= LEAST_POOL)
    one = F.sort_array(F.collect_list(F.struct("origin_idx", "age_idx", "fitted", "residual", "origin", "latest_idx")))
    segments = odp_cells(cells).groupBy(*SEG).agg(one.alias("cells")).join(fit, SEG)
    factors = estimators(cells).groupBy(*SEG).agg(F.transform(F.sort_array(F.collect_list(F.struct("age_idx", "f"))), lambda x: x["f"]).alias("f"))
    blocks = -(-n_sims // BLOCK)
    dealt = segments.join(factors, SEG).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", text_key(F.col("segment")) if counted else F.xxhash64("segment", "kind"))
    dealt = dealt.repartition("segment", "kind", "block")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                sims = min(BLOCK, n_sims - r.block * BLOCK)
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, r.salt & 0xFFFFFFFFFFFFFFFF, r.block])))

                def picks(pool: int, size: int, k: int, sims=sims, rng=rng, r=r) -> np.ndarray:
                    if not counted:
                        return rng.integers(0, pool, (size, k, sims))
                    origins = np.array(sorted({c["origin_idx"] for c in r.cells}))
                    return (uniform_array(seed, r.salt, origins[:, None, None], np.arange(k)[None, :, None], np.arange(sims) + r.block * BLOCK) * pool).astype(int)

                names, unpaid = simulate(r.cells, np.asarray(r.f), r.phi, r.n, r.p, sims, rng, bias_adjust, process_variance, picks)
                yield pd.DataFrame({
                    "segment": r.segment, "kind": r.kind, "origin": np.repeat(names, sims), "sim": np.tile(np.arange(sims) + r.block * BLOCK, len(names)), "unpaid": unpaid.ravel(),
                })

    return dealt.select("segment", "kind", "cells", "f", "phi", "n", "p", "block", "salt").mapInPandas(run, "segment string, kind string, origin string, sim long, unpaid double")


def simulate(cells, f, phi, n, p, sims, rng, bias_adjust, process_variance, picks) -> tuple[list[str], np.ndarray]:
    """(origins, unpaid by origin and simulation) of one block, vectorised over its simulations.

    ``picks`` gives, for each origin, age and simulation, the place of a residual in the pool, which is in order of cells.
    """
    origins = sorted({c["origin_idx"] for c in cells})
    size, k = len(origins), len(f) + 1
    place = {o: i for i, o in enumerate(origins)}
    mean, names, last = np.full((size, k), np.nan), [""] * size, np.full(size, -1)
    for c in cells:
        i = place[c["origin_idx"]]
        mean[i, c["age_idx"]], names[i], last[i] = c["fitted"], c["origin"], c["latest_idx"]
    pool = np.array([c["residual"] for c in cells if c["residual"] is not None and abs(c["residual"]) > ZERO]) * (np.sqrt(n / (n - p)) if bias_adjust else 1)
    seen = ~np.isnan(mean)
    good = seen & (np.nan_to_num(mean) > 0)
    cells_ = np.where(seen, np.nan_to_num(mean), 0.0)[:, :, None] + np.where(good, np.sqrt(np.where(good, mean, 0)), 0)[:, :, None] * pool[picks(len(pool), size, k)]
    cum = np.cumsum(np.where(seen[:, :, None], cells_, 0), axis=1)
    factors = np.empty((k - 1, sims))
    for j in range(k - 1):
        use = (seen[:, j] & seen[:, j + 1])[:, None] & (cum[:, j] > 0)
        num, den = np.where(use, cum[:, j + 1], 0).sum(0), np.where(use, cum[:, j], 0).sum(0)
        factors[j] = np.where(den > 0, num / np.where(den > 0, den, 1), np.nan)
    factors = np.where(np.isnan(factors).any(0), f[:, None], factors)
    unpaid = np.zeros((size, sims))
    for i in range(size):
        at = cum[i, last[i]].copy()
        for j in range(last[i] + 1, k):
            after = at * factors[j - 1]
            m = after - at
            if process_variance:
                m = np.where(m > 0, rng.gamma(np.maximum(m, 1e-300) / phi) * phi, m)
            unpaid[i] += m
            at = after
    return names, unpaid


def summary(samples: DataFrame) -> DataFrame:
    """Per origin, and with a null origin per segment, ``n, mean, sd, cv`` and interpolated percentiles of simulated amounts.

    Percentiles come from running counts over range buckets, so that a segment of very many simulations is no task of its own.
    """
    total = samples.groupBy(*SEG, "sim").agg(F.sum("unpaid").alias("unpaid")).withColumn("origin", F.lit(None).cast("string"))
    rows = written(samples.select(*SEG, "origin", "sim", "unpaid").unionByName(total), "simulated")
    own = [*SEG, "origin"]
    out = rows.groupBy(*own).agg(F.count("*").alias("n"), F.avg("unpaid").alias("mean"), F.stddev_samp("unpaid").alias("sd")).filter("n >= 2")
    found = percentiles(rows, own, "unpaid", {f"p{k}": p for k, p in enumerate(PERCENTILES)})
    found = found.select(*(F.col(c).alias(f"_{c}") for c in own), F.array(*(f"p{k}" for k in range(len(PERCENTILES)))).alias("percentiles"))
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = out.join(found, same).select(*own, "n", "mean", "sd", "percentiles")
    return out.withColumn("cv", F.when(F.col("mean") != 0, F.col("sd") / F.abs("mean")))
