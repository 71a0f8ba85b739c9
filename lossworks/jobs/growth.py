"""Growth-curve reserves: one curve per segment fitted to yearly increments, with or without premium."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.severity import minimised

CURVES = {
    "loglogistic": lambda x, omega, theta: np.where(x > 0, 1 / (1 + (theta / np.where(x > 0, x, 1)) ** omega), 0.0),
    "weibull": lambda x, omega, theta: np.where(x > 0, 1 - np.exp(-((np.where(x > 0, x, 0) / theta) ** omega)), 0.0),
}
RESULT = (
    "segment string, origin string, method string, curve string, omega double, theta double, elr double, sigma2 double, latest double, growth double, reserve double, "
    "process_sd double, parameter_sd double, total_sd double, valid boolean, message string"
)


def growth_share(curve: str, x: Column, omega: Column, theta: Column) -> Column:
    """The share of losses that has emerged at average age ``x``, as a column; 0 at 0 and before."""
    if curve not in CURVES:
        raise ValueError(f"BAD_CURVE: one of {', '.join(CURVES)}")
    share = 1 / (1 + F.pow(theta / x, omega)) if curve == "loglogistic" else 1 - F.exp(-F.pow(x / theta, omega))
    return F.when(x > 0, share).when(x.isNotNull(), 0.0)


def average_age_of(months: Column) -> Column:
    """``average_age`` as a column."""
    return F.when(months > 0, F.greatest(months - 6.0, months / 2.0)).when(months.isNotNull(), 0.0)


def first_order(cells: DataFrame, fits: DataFrame, step: float = 1e-5) -> DataFrame:
    """``segment, curve, n, slope_omega, slope_theta``: how far fits with a level per origin are from a stationary point.

    ``fits`` are ``growth_curve``'s rows. A slope is the derivative of the likelihood in the logarithm of a parameter, levels
    held (they maximise it), over the sum of its terms' sizes: 0 at an optimum. It is worked out from the cells by
    columns and one combining aggregate, apart from the optimiser.
    """
    good = fits.filter("valid and method = 'ldf_curve' and origin is not null").select("segment", "origin", "curve", "omega", "theta", (F.col("latest") / F.col("growth")).alias("_level"))
    by_age = Window.partitionBy("segment", "origin").orderBy("age")
    rows = cells.select("segment", "origin", "age", finite("value").alias("value")).filter("value is not null")
    rows = rows.withColumns({"c": F.col("value") - F.coalesce(F.lag("value").over(by_age), F.lit(0.0)), "_to": average_age_of(F.col("age")), "_since": average_age_of(F.coalesce(F.lag("age").over(by_age), F.lit(0)))})
    rows = rows.join(good, ["segment", "origin"])

    def mean(a: float, b: float) -> Column:
        out = F.lit(None).cast("double")
        for curve in CURVES:
            omega, theta = F.col("omega") * (1 + a), F.col("theta") * (1 + b)
            out = F.when(F.col("curve") == curve, F.col("_level") * (growth_share(curve, F.col("_to"), omega, theta) - growth_share(curve, F.col("_since"), omega, theta))).otherwise(out)
        return out

    weight = F.col("c") / mean(0, 0) - 1
    terms = {"omega": weight * (mean(step, 0) - mean(-step, 0)) / (2 * step), "theta": weight * (mean(0, step) - mean(0, -step)) / (2 * step)}
    slopes = [(F.sum(t) / F.sum(F.abs(t))).alias(f"slope_{k}") for k, t in terms.items()]
    return rows.groupBy("segment", "curve").agg(F.count("*").alias("n"), *slopes)


def average_age(t: np.ndarray) -> np.ndarray:
    """Months from the average accident date: t - 6, and t / 2 within the first year."""
    return np.where(t > 0, np.maximum(t - 6.0, t / 2.0), 0.0)


def second_derivatives(f, at: np.ndarray, step: float = 1e-3) -> np.ndarray:
    """The Hessian of f at 1, ..., 1 in units of ``at``: central differences of a relative step."""
    n, eye = len(at), np.eye(len(at)) * step
    g = lambda u: f(at * (1 + u))
    mid, out = g(np.zeros(n)), np.empty((n, n))
    for i in range(n):
        out[i, i] = (g(eye[i]) - 2 * mid + g(-eye[i])) / step**2
        for j in range(i):
            out[i, j] = out[j, i] = (g(eye[i] + eye[j]) - g(eye[i] - eye[j]) - g(eye[j] - eye[i]) + g(-eye[i] - eye[j])) / (4 * step**2)
    return out


def fitted(frame: pd.DataFrame, curve: str, truncation: float | None, cape_cod: bool) -> pd.DataFrame:
    """One segment's rows and, with a null origin, its totals; an unusable segment gives one row that says why."""
    method, segment = "cape_cod_curve" if cape_cod else "ldf_curve", frame["segment"].iloc[0]
    base = dict.fromkeys((c.split()[0] for c in RESULT.split(", ")), None) | {"segment": segment, "method": method, "curve": curve}

    def refused(why: str) -> pd.DataFrame:
        return pd.DataFrame([base | {"valid": False, "message": why}])

    frame = frame.sort_values(["origin_idx", "age"])
    if (frame["age"] % 12 != 0).any():
        return refused("ages are not whole years")
    seen = frame[frame["value"].notna()]
    if seen.empty or (seen.groupby("origin_idx").size() != seen.groupby("origin_idx")["age"].max() / (frame["age"].min() if len(frame) else 12)).any():
        return refused("no observed cells, or a gap between them")
    if truncation is not None and truncation < seen["age"].max():
        return refused("the truncation age is below an observed age")
    origins, row = np.unique(seen["origin_idx"], return_inverse=True)
    age, cum = seen["age"].to_numpy(float), seen["value"].to_numpy(float)
    first = np.concatenate(([True], row[1:] != row[:-1]))
    c = np.where(first, cum, cum - np.concatenate(([0.0], cum[:-1])))
    to = average_age(age)
    since = np.where(first, 0.0, np.concatenate(([0.0], to[:-1])))
    last = np.concatenate((~(row[1:] == row[:-1]), [True]))
    latest, x, names = cum[last], to[last], seen["origin"].to_numpy()[last]
    premium = seen["premium"].to_numpy(float)[last]
    if cape_cod and not (premium > 0).all():
        return refused("an origin has no premium")
    growth, n = CURVES[curve], len(c)
    end = None if truncation is None else float(average_age(np.array(truncation)))
    top = lambda p: 1.0 if end is None else float(growth(np.array(end), *p))

    def scale(p):
        """The levels that maximise the likelihood for a curve: an ultimate per origin, or one loss ratio."""
        if cape_cod:
            return np.array([c.sum() / (premium * growth(x, *p)).sum()])
        return latest / growth(x, *p)

    def means(q):
        p = q[-2:]
        level = q[0] * premium if cape_cod else q[:-2]
        return level[row] * (growth(to, *p) - growth(since, *p))

    def likelihood(q):
        m = means(q)
        return float((c * np.log(m) - m).sum()) if (m > 0).all() else -1e300

    def loss(z):
        p = np.exp(np.clip(z, -20, 20))
        with np.errstate(all="ignore"):
            value = likelihood(np.concatenate((scale(p), p)))
        return -value if np.isfinite(value) else 1e300

    unit = max(abs(loss(np.log([1.5, max(x.max() / 2, 1)]))), 1.0)
    best = np.exp(minimised(lambda z: loss(z) / unit * 1e3, np.log([1.5, max(x.max() / 2, 1.0)])))
    q = np.concatenate((scale(best), best))
    free = n - len(q)
    if free <= 0 or likelihood(q) <= -1e299:
        return refused("too few cells, or no finite likelihood")
    m = means(q)
    sigma2 = ((c - m) ** 2 / m).sum() / free

    def reserves(q):
        level = q[0] * premium if cape_cod else q[:-2]
        return level * (top(q[-2:]) - growth(x, *q[-2:]))

    reserve = reserves(q)
    cov = -sigma2 * np.linalg.inv(second_derivatives(likelihood, q))
    slope = np.stack([(reserves(q * (1 + e)) - reserves(q * (1 - e))) / 2e-5 for e in np.eye(len(q)) * 1e-5], axis=1)
    parameter = np.sqrt(np.maximum(0, np.einsum("ij,jk,ik->i", slope, cov, slope)))
    total = slope.sum(0)
    rows = [(*r,) for r in zip(names, latest, growth(x, *best), reserve, parameter, strict=True)]
    rows.append((None, latest.sum(), None, reserve.sum(), np.sqrt(max(0.0, total @ cov @ total))))
    fit = base | {"omega": best[0], "theta": best[1], "elr": q[0] if cape_cod else None, "sigma2": sigma2, "valid": True}
    out = []
    for name, paid, g, r, sd in rows:
        process = np.sqrt(sigma2 * max(0.0, r))
        out.append(fit | {"origin": name, "latest": paid, "growth": g, "reserve": r, "process_sd": process, "parameter_sd": sd, "total_sd": np.hypot(process, sd)})
    return pd.DataFrame(out)


def growth_curve(cells: DataFrame, curve: str = "loglogistic", truncation: float | None = None, exposures: DataFrame | None = None) -> DataFrame:
    """Reserves per origin and, with a null origin, per segment, with process, parameter and total standard deviations.

    Without ``exposures`` each origin has a level of its own, with them (segment, origin, earned_premium) one loss ratio
    holds for all. ``truncation`` is the age in months up to which losses develop. A segment is a few thousand cells at
    most, so each is fitted in one task; segments run in parallel.
    """
    if curve not in CURVES:
        raise ValueError(f"BAD_CURVE: one of {', '.join(CURVES)}")
    if truncation is not None and not truncation > 0:
        raise ValueError("BAD_TAIL: the truncation age must be positive")
    rows = cells.select("segment", "origin", "origin_idx", "age", finite("value").alias("value"))
    premium = F.lit(None).cast("double")
    if exposures is not None:
        rows = rows.join(exposures.select("segment", "origin", finite("earned_premium").alias("premium")), ["segment", "origin"], "left")
        premium = F.col("premium")
    rows = rows.select("segment", "origin", "origin_idx", "age", "value", premium.alias("premium"))
    with_premium = exposures is not None
    return rows.groupBy("segment").applyInPandas(lambda f: fitted(f, curve, truncation, with_premium), RESULT)
