"""Claim-size distributions: expectations under limits, increased-limit tables, and censored fits."""

from __future__ import annotations

from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lossworks.functions.numbers import finite
from lossworks.functions.tables import written
from lossworks.jobs.large_losses import survival_quantiles

# The rational approximation 7.1.26 of the error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# The rational approximation of the normal quantile by P. J. Acklam (relative error below 1.15e-9), highest
# powers first, and the probability below which it uses the tail's form.
CENTRE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
CENTRE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL = 0.02425
# The sizes and shares that make a fit thin or unusable.
LEAST, THIN, LEAST_EXACT, MOST_CENSORED = 10, 30, 5, 0.8
#: Probabilities at which a fit is held against the observed sizes.
PROBES = (0.5, 0.75, 0.9, 0.95, 0.99)


def normal_cdf(z: Column) -> Column:
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + ERF_P * x)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-x * x)
    return F.when(z >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def polynomial(powers: tuple[float, ...], x: Column) -> Column:
    """By its coefficients, the highest power's first."""
    out = F.lit(powers[0])
    for a in powers[1:]:
        out = out * x + a
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal's value with probability ``p`` below it; null unless 0 < p < 1."""
    q = p - 0.5
    centre = polynomial(CENTRE_TOP, q * q) * q / polynomial(CENTRE_BOTTOM, q * q)
    far = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))  # the same on either side, with the other sign
    tail = polynomial(TAIL_TOP, far) / polynomial(TAIL_BOTTOM, far)
    inside = F.when(p < TAIL, tail).when(p > 1 - TAIL, -tail).otherwise(centre)
    return F.when((p > 0) & (p < 1), inside)


def severity_quantile(kind: Column, p1: Column, p2: Column, p: Column) -> Column:
    """The size of a lognormal (mu, sigma) or a Pareto (theta, alpha) with probability ``p`` below it; null unless 0 < p < 1."""
    pareto = F.when((p > 0) & (p < 1), p1 * (F.pow(1 - p, -1 / p2) - 1))
    return F.when(kind == "lognormal", F.exp(p1 + p2 * normal_quantile(p))).otherwise(pareto)


def quantile_check(observations: DataFrame, fits: DataFrame, probes: tuple[float, ...] = PROBES) -> DataFrame:
    """``segment, kind, p, empirical, fitted``: quantiles of each fit (segment, kind, p1, p2) beside the observed ones.

    The observed ones allow for open claims by the product-limit estimate, which runs over range buckets; they are null
    where open claims leave nothing to see. A fit without parameters has null quantiles.
    """
    seen = survival_quantiles(observations, probes).select(F.col("segment").alias("_segment"), F.col("p").alias("_p"), "quantile")
    each = fits.select("segment", "kind", "p1", "p2", F.explode(F.array(*map(F.lit, probes))).alias("p"))
    both = each.join(seen, F.col("segment").eqNullSafe(F.col("_segment")) & (F.col("p") == F.col("_p")), "left")
    return both.select("segment", "kind", "p", F.col("quantile").alias("empirical"), severity_quantile(F.col("kind"), F.col("p1"), F.col("p2"), F.col("p")).alias("fitted"))


def closed_form_fits(observations: DataFrame) -> DataFrame:
    """``segment, kind, p1, p2`` from averages of the positive sizes, as if all claims were closed: one combining aggregate.

    A lognormal by its likelihood (mean and deviation of the logarithms), a Pareto by its first two moments: null where
    these are those of a thinner tail. Starting points and a check for the censored fits; no substitute for them.
    """
    value = F.when(finite("value") > 0, finite("value"))
    mean, square = F.avg(value), F.avg(value * value)
    sums = observations.groupBy("segment").agg(F.avg(F.ln(value)).alias("mu"), F.stddev_pop(F.ln(value)).alias("sigma"), mean.alias("m"), (square - mean * mean).alias("v"))
    alpha = F.when(F.col("v") > F.col("m") * F.col("m"), 2 * F.col("v") / (F.col("v") - F.col("m") * F.col("m")))
    fits = F.array(F.struct(F.lit("lognormal").alias("kind"), F.col("mu").alias("p1"), F.col("sigma").alias("p2")), F.struct(F.lit("pareto").alias("kind"), (F.col("m") * (alpha - 1)).alias("p1"), alpha.alias("p2")))
    return sums.select("segment", F.explode(fits).alias("f")).select("segment", "f.*")


def severity_mean(kind: Column, p1: Column, p2: Column) -> Column:
    """Of a lognormal (mu, sigma) or a Pareto (theta, alpha); null where it is infinite."""
    return F.when(kind == "lognormal", F.exp(p1 + p2 * p2 / 2)).when(p2 > 1, p1 / (p2 - 1))


def limited_expected_value(kind: Column, p1: Column, p2: Column, limit: Column) -> Column:
    """E[min(X, limit)]; null unless the limit is positive."""
    log = F.ln(limit)
    lognormal = F.exp(p1 + p2 * p2 / 2) * normal_cdf((log - p1 - p2 * p2) / p2) + limit * (1 - normal_cdf((log - p1) / p2))
    pareto = F.when(F.abs(p2 - 1) < 1e-9, p1 * F.ln((limit + p1) / p1)).otherwise(p1 / (p2 - 1) * (1 - F.pow(p1 / (limit + p1), p2 - 1)))
    return F.when(limit > 0, F.when(kind == "lognormal", lognormal).otherwise(pareto))


def uncap_factor(kind: Column, p1: Column, p2: Column, cap: Column, target: Column | None = None) -> Column:
    """From losses capped at ``cap`` to losses limited at ``target`` (none: unlimited); null where it is undefined."""
    below = limited_expected_value(kind, p1, p2, cap)
    above = severity_mean(kind, p1, p2) if target is None else F.when(target >= cap, limited_expected_value(kind, p1, p2, target))
    return F.when(below > 0, above / below)


def interpolated_ilf(table: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` (segment, limit) with ``factor``, log-log between the rows of ``table`` (segment, limit, factor).

    Null outside the table, and for a table with repeated or falling rows, amounts that aren't positive, or one row only.
    """
    own = Window.partitionBy("segment").orderBy("limit")
    rows = table.select("segment", finite("limit").alias("lo"), finite("factor").alias("f0"), F.lead(finite("limit")).over(own).alias("hi"), F.lead(finite("factor")).over(own).alias("f1"))
    bad = F.max((~F.coalesce((F.col("lo") > 0) & (F.col("f0") > 0), F.lit(False)) | F.coalesce((F.col("hi") == F.col("lo")) | (F.col("f1") < F.col("f0")), F.lit(False))).cast("int"))
    good = rows.groupBy("segment").agg(bad.alias("bad"), F.count("*").alias("n"), F.max("lo").alias("top")).filter("bad = 0 and n > 1").select("segment", "top")
    rows = rows.filter("hi is not null").join(good, "segment")
    x = limits.withColumnRenamed("limit", "_limit").withColumnRenamed("segment", "_segment")
    inside = (F.col("_limit") >= F.col("lo")) & ((F.col("_limit") < F.col("hi")) | ((F.col("hi") == F.col("top")) & (F.col("_limit") == F.col("hi"))))
    t = (F.ln("_limit") - F.ln("lo")) / (F.ln("hi") - F.ln("lo"))
    out = x.join(rows, (F.col("_segment") == F.col("segment")) & inside, "left")
    return out.select(F.col("_segment").alias("segment"), F.col("_limit").alias("limit"), F.exp(F.ln("f0") + t * (F.ln("f1") - F.ln("f0"))).alias("factor"))


def descent(start: np.ndarray, rounds: int = 200, least_gain: float = 0.0) -> Generator[list[np.ndarray], list[float], np.ndarray]:
    """A minimum of a smooth function of two numbers, by damped Newton steps on central differences.

    Yields lists of points and is sent the function's values there, so that many functions can be asked at once. A step
    that promises less than ``least_gain`` of the value is the last and isn't tried: sums in changing order can't tell it.
    """

    def around(x: np.ndarray) -> list[np.ndarray]:
        e = np.diag(1e-4 * np.maximum(1, np.abs(x)))
        return [x, *(x + s for s in e), *(x - s for s in e), x + e[0] + e[1], x + e[0] - e[1], x - e[0] + e[1], x - e[0] - e[1]]

    x, damp = np.asarray(start, dtype=float), 1e-3
    values = yield around(x)
    for _ in range(rounds):
        value, up, down, (pp, pm, mp, mm) = values[0], values[1:3], values[3:5], values[5:]
        h = 1e-4 * np.maximum(1, np.abs(x))
        g = np.array([(u - d) / (2 * k) for u, d, k in zip(up, down, h, strict=True)])
        cross = (pp - pm - mp + mm) / (4 * h[0] * h[1])
        hess = np.array([[(up[0] - 2 * value + down[0]) / h[0] ** 2, cross], [cross, (up[1] - 2 * value + down[1]) / h[1] ** 2]])
        while damp < 1e12:
            w, v = np.linalg.eigh(hess)
            step = -v @ ((v.T @ g) / (np.maximum(np.abs(w), 1e-9) + damp * np.abs(w).max()))
            if -(g @ step) < 2 * least_gain * max(1, abs(value)):
                return x + step
            values = yield around(x + step)
            if values[0] <= value:
                break
            damp *= 4
        else:
            return x
        moved, x, damp = np.abs(step).max(), x + step, max(damp / 8, 1e-12)
        if moved < 1e-9 or value - values[0] < 1e-12 * max(1, abs(value)):
            return x
    return x


def minimised(f, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The minimum that ``descent`` finds of ``f``."""
    steps = descent(start, rounds)
    points = next(steps)
    while True:
        try:
            points = steps.send([f(p) for p in points])
        except StopIteration as found:
            return found.value


def _summed(rows: DataFrame, asked: dict) -> dict:
    """What ``asked`` ((kind, segment): points) needs of ``rows``, by (kind, segment, place, of open claims).

    One aggregate for all kinds and segments. Of a lognormal (mu, ln sigma) the log-likelihood terms of the open claims at
    each point: its closed ones need no more than their two sums. Of a Pareto (ln theta, ln alpha) the sums of
    ln(1 + value / theta), open and closed claims apart: alpha is only a factor of them, so points of one theta ask once.
    """
    lognormal = [("lognormal", s, k, p[0], np.exp(-p[1])) for (kind, s), ps in asked.items() if kind == "lognormal" for k, p in enumerate(ps)]
    pareto = [("pareto", s, k, np.exp(a), 0.0) for (kind, s), ps in asked.items() if kind == "pareto" for k, a in enumerate(_firsts(ps))]
    kinds, segments, places, first, second = zip(*lognormal, *pareto, strict=True)
    columns = [pa.array(kinds), pa.array(segments, to_arrow_type(rows.schema["segment"].dataType)), pa.array(places, pa.int32()), np.array(first), np.array(second)]
    at = F.broadcast(rows.sparkSession.createDataFrame(pa.table(columns, names=["kind", "_segment", "k", "a", "b"])))
    tail = F.ln(F.greatest(1 - normal_cdf((F.ln("value") - F.col("a")) * F.col("b")), F.lit(1e-300)))
    # ln(value + theta) less ln(theta): exact for a large theta too
    term = F.when(F.col("kind") == "lognormal", tail).otherwise(F.log1p(F.col("value") / F.col("a")))
    met = rows.join(at, F.col("segment").eqNullSafe(F.col("_segment")) & ((F.col("kind") == "pareto") | F.col("censored")))
    out = met.groupBy("kind", "_segment", "k", "censored").agg(F.sum(F.col("w") * term).alias("v")).collect()
    return {(r["kind"], r["_segment"], r["k"], r["censored"]): r["v"] for r in out}


def _firsts(points: list[np.ndarray]) -> list[float]:
    return sorted({float(p[0]) for p in points})


def fit_severity(observations: DataFrame, kind: str) -> DataFrame:
    """``fit_severities`` of one kind."""
    return fit_severities(observations, (kind,))


def fit_severities(observations: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """``segment, kind, p1, p2, log_likelihood, n_exact, n_censored, n_excluded, valid, message`` by censored likelihood.

    Observations are read once, whatever the kinds: counted per distinct value and written; they stay partitioned, whatever
    a segment's size. Each step of the optimisers is one aggregate for all kinds and segments, of which the driver holds two
    parameters and a few sums each. Too few observations, too few closed ones, too many open ones, and implausible
    parameters make a fit invalid.
    """
    spark = observations.sparkSession
    value = F.when(finite("value") > 0, finite("value"))
    counts = written(observations.groupBy("segment", "censored", value.alias("value")).agg(F.count("*").cast("double").alias("w")), "severities")
    excluded = counts.groupBy("segment").agg(F.sum(F.when(F.col("value").isNull(), F.col("w")).otherwise(0.0)).cast("long").alias("n_excluded"))
    rows = counts.filter("value is not null")
    schema = f"segment {rows.schema['segment'].dataType.simpleString()}"
    exact = F.when(~F.col("censored"), F.col("w")).otherwise(0.0)
    log = F.ln("value")
    sums = rows.groupBy("segment").agg(F.sum("w").alias("n"), F.sum(exact).alias("ne"), F.sum(exact * F.col("value")).alias("s0"), F.sum(exact * log).alias("s1"), F.sum(exact * log * log).alias("s2")).collect()
    sums = {r["segment"]: r for r in sums}

    def likelihood(kind: str, s, k: int, p: np.ndarray, places: dict, found: dict) -> float:
        r = sums[s]
        if kind == "lognormal":
            closed = -r["s1"] - r["ne"] * (p[1] + 0.5 * np.log(2 * np.pi)) - (r["s2"] - 2 * p[0] * r["s1"] + r["ne"] * p[0] ** 2) / (2 * np.exp(p[1]) ** 2)
            return closed + found.get((kind, s, k, True), 0.0)
        closed, open_ = (found.get((kind, s, places[float(p[0])], c), 0.0) for c in (False, True))
        return r["ne"] * (p[1] - p[0]) - (np.exp(p[1]) + 1) * closed - np.exp(p[1]) * open_

    def losses(asked: dict) -> dict:
        found = _summed(rows, asked)
        out = {}
        for (kind, s), ps in asked.items():
            places = {a: k for k, a in enumerate(_firsts(ps))}
            out[kind, s] = [-likelihood(kind, s, k, p, places, found) for k, p in enumerate(ps)]
        return out

    running, asked, best = {}, {}, {}
    for s, r in sums.items():
        n, ne = r["n"], r["ne"]
        if n < LEAST or ne < LEAST_EXACT or (n - ne) / n > MOST_CENSORED:
            continue
        mean = r["s1"] / ne
        for kind in kinds:
            start = np.array([mean, 0.5 * np.log(max(1e-6, r["s2"] / ne - mean**2))]) if kind == "lognormal" else np.log([r["s0"] / ne, 2.0])
            running[kind, s] = descent(start, least_gain=1e-12)
            asked[kind, s] = next(running[kind, s])
    while asked:
        values, left = losses(asked), {}
        for key in asked:
            try:
                left[key] = running[key].send(values[key])
            except StopIteration as found:
                best[key] = found.value
        asked = left
    loss = losses({key: [p] for key, p in best.items()}) if best else {}
    fits = []
    for s, r in sums.items():
        n, ne = int(r["n"]), int(r["ne"])
        for kind in kinds:
            if (kind, s) not in best:
                fits.append((s, kind, None, None, None, ne, n - ne, False, "too few observations, or too few of them closed"))
                continue
            p, likely = best[kind, s], -loss[kind, s][0]
            p1, p2 = (p[0], np.exp(p[1])) if kind == "lognormal" else np.exp(p)
            fine = bool((1e-6 <= p2 <= 3.5 if kind == "lognormal" else p2 > 1) and np.isfinite(likely))
            said = None if fine else "the fitted tail is not usable"
            fits.append((s, kind, float(p1), float(p2), float(likely), ne, n - ne, fine, said or ("few observations" if n < THIN else None)))
    fits = spark.createDataFrame(fits, f"{schema}, _kind string, p1 double, p2 double, log_likelihood double, n_exact long, n_censored long, valid boolean, message string")
    fits = fits.withColumnRenamed("segment", "_segment")
    each = excluded.withColumn("kind", F.explode(F.array(*map(F.lit, kinds))))
    out = each.join(fits, F.col("segment").eqNullSafe(F.col("_segment")) & (F.col("kind") == F.col("_kind")), "left").select(
        "segment", "n_excluded", "kind", "p1", "p2", "log_likelihood", "n_exact", "n_censored", F.coalesce("valid", F.lit(False)).alias("valid"), "message"
    )
    return out.withColumn("message", F.when(F.col("n_exact").isNull(), F.lit("no usable observation")).otherwise(F.col("message")))


def log_likelihood(kind: Column, p1: Column, p2: Column, value: Column, censored: Column) -> Column:
    """One observation's term: the density of a closed claim, the probability of more than an open one's size."""
    z = (F.ln(value) - p1) / p2
    lognormal = F.when(censored, F.ln(F.greatest(1 - normal_cdf(z), F.lit(1e-300)))).otherwise(-F.ln(value) - F.ln(p2) - F.lit(0.5 * np.log(2 * np.pi)) - z * z / 2)
    log = F.log1p(value / p1)
    pareto = F.when(censored, -p2 * log).otherwise(F.ln(p2) - F.ln(p1) - (p2 + 1) * log)
    return F.when(kind == "lognormal", lognormal).otherwise(pareto)


def around_optimum(observations: DataFrame, fits: DataFrame, step: float = 0.01) -> DataFrame:
    """``segment, kind, n_exact, n_censored, log_likelihood, best_neighbour``: what the data say at a fit and beside it.

    Each parameter is moved up and down by ``step`` of itself, also both at once; all nine sums come from one combining
    aggregate over the observations. A fit is an optimum if its own is the largest.
    """
    own = fits.filter("p1 is not null").select(F.col("segment").alias("_segment"), "kind", "p1", "p2")
    rows = observations.filter(finite("value") > 0).withColumn("value", finite("value")).join(own, F.col("segment").eqNullSafe(F.col("_segment")))
    moves = [(a, b) for a in (0, step, -step) for b in (0, step, -step)]
    sums = [F.sum(log_likelihood(F.col("kind"), F.col("p1") * (1 + a), F.col("p2") * (1 + b), F.col("value"), F.col("censored"))).alias(f"l{k}") for k, (a, b) in enumerate(moves)]
    out = rows.groupBy("segment", "kind").agg(F.count_if(~F.col("censored")).alias("n_exact"), F.count_if("censored").alias("n_censored"), *sums)
    return out.select("segment", "kind", "n_exact", "n_censored", F.col("l0").alias("log_likelihood"), F.greatest(*(f"l{k}" for k in range(1, len(moves)))).alias("best_neighbour"))
