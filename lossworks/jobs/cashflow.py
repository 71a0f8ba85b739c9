"""Payout patterns, discounting, unallocated expenses, and the roll-forward of actual against expected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.chainladder import cdfs

TAIL_SHARE = 1e-9


def payout_pattern(cl: DataFrame, cells: DataFrame, selections: DataFrame, tail: float = 1.0) -> DataFrame:
    """``segment, origin, from_months, to_months, amount``: each origin's unpaid amount by future interval.

    Months count from the origin's latest age. What the last age leaves open is paid in one more interval as wide as the
    last step (12 months where there is none), when it is more than ``TAIL_SHARE`` of the ultimate.
    """
    own = Window.partitionBy("segment", "kind").orderBy("age_idx")
    factors = cdfs(cells, selections, tail).withColumn("pct", 1 / F.col("cdf"))
    steps = factors.withColumns({"_to": F.lead("age").over(own), "_next": F.lead("pct").over(own), "_step": F.col("age") - F.lag("age").over(own)})
    rows = cl.select("segment", "kind", "origin", "latest_age", "ultimate")
    joined = rows.join(steps, ["segment", "kind"]).filter(F.col("age") >= F.col("latest_age"))
    inside = joined.filter("_to is not null").select(
        "segment", "origin", (F.col("age") - F.col("latest_age")).alias("from_months"), (F.col("_to") - F.col("latest_age")).alias("to_months"), (F.col("ultimate") * (F.col("_next") - F.col("pct"))).alias("amount")
    )
    left = F.col("ultimate") * (1 - F.col("pct"))
    at = F.col("age") - F.col("latest_age")
    after = joined.filter("_to is null").filter(F.abs(left) > TAIL_SHARE * F.abs("ultimate")).select("segment", "origin", at.alias("from_months"), (at + F.coalesce("_step", F.lit(12))).alias("to_months"), left.alias("amount"))
    return inside.unionByName(after)


def discount(flows: DataFrame, rates: DataFrame | float, convention: str = "mid", provenance: str = "") -> DataFrame:
    """``segment, origin, nominal, discounted`` (and a null origin: the segment) from flows in months.

    ``rates`` is a flat rate or a spot curve ``year, rate`` whose entry for the year that holds the payment counts, the
    last one beyond. ``provenance``, where the rates come from, must be given and is returned.
    """
    if not provenance.strip():
        raise ValueError("NO_PROVENANCE: say where the rates come from")
    if convention not in ("mid", "end"):
        raise ValueError("BAD_CONVENTION: mid or end")
    t = (F.col("from_months") + F.col("to_months")) / 24.0 if convention == "mid" else F.col("to_months") / 12.0
    rows = flows.withColumn("t", t)
    if isinstance(rates, DataFrame):
        curve = rates.groupBy().agg(F.max("year").alias("_last"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("year", finite("rate").alias("rate"))))).alias("_curve"))
        rows = rows.join(F.broadcast(curve))  # one row: the curve
        rate = F.col("_curve")[F.least(F.greatest(F.ceil("t").cast("int"), F.lit(1)), F.col("_last").cast("int"))]
    else:
        rate = F.lit(float(rates))
    rows = rows.withColumn("pv", F.col("amount") / F.pow(1 + rate, F.col("t")))
    out = rows.rollup("segment", "origin").agg(F.sum("amount").alias("nominal"), F.sum("pv").alias("discounted")).filter("segment is not null")
    return out.withColumn("provenance", F.lit(provenance))


def ulae_ratios(periods: DataFrame, weights: tuple[float, float, float], basis: str = "weighted") -> DataFrame:
    """Per period (null: all) ``basis`` and ``ratio`` of expense paid to it; null where the basis isn't positive.

    ``periods``: segment, period, ulae_paid, reported_ultimate, paid, closed_ultimate. The weights of opening, maintaining
    and closing lie in [0, 1] and add up to 1. A segment with an amount below 0 has no rows (``errors.ulae_errors``).
    """
    if any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("BAD_WEIGHTS: weights lie in [0, 1] and add up to 1")
    u1, u2, u3 = weights
    own = F.col("paid") if basis == "paid" else u1 * F.col("reported_ultimate") + u2 * F.col("paid") + u3 * F.col("closed_ultimate")
    bad = ~F.coalesce(F.least(*(F.when(finite(c) >= 0, 1).otherwise(0) for c in ("ulae_paid", "paid", "reported_ultimate", "closed_ultimate"))) == 1, F.lit(False))
    whole = periods.withColumn("_bad", F.max(bad.cast("int")).over(Window.partitionBy("segment"))).filter("_bad = 0").drop("_bad")
    out = whole.withColumn("basis", own).rollup("segment", "period").agg(F.sum("ulae_paid").alias("ulae_paid"), F.sum("basis").alias("basis")).filter("segment is not null")
    return out.withColumn("ratio", F.when(F.col("basis") > 0, F.col("ulae_paid") / F.col("basis")))


def ulae_reserve(segments: DataFrame, weights: tuple[float, float, float], form: str) -> DataFrame:
    """``segments`` (selected_w, ultimate_losses, ulae_paid, reported_ultimate, paid, closed_ultimate) with ``reserve``.

    ``expected``: W L - M; ``bf``: W (u1 (L - R) + u2 (L - P) + u3 (L - C)); ``development``: M (L / B - 1).
    """
    u1, u2, u3 = weights
    big_l, m, w = F.col("ultimate_losses"), F.col("ulae_paid"), F.col("selected_w")
    basis = u1 * F.col("reported_ultimate") + u2 * F.col("paid") + u3 * F.col("closed_ultimate")
    out = {"expected": w * big_l - m, "bf": w * (big_l - basis), "development": F.when(basis > 0, m * (big_l / basis - 1))}[form]
    return segments.withColumn("reserve", out)


def actual_expected(rows: DataFrame) -> DataFrame:
    """Per origin (null: the segment) ``expected, actual, difference, ratio`` since the prior valuation.

    ``rows``: segment, origin, prior_ultimate, prior_latest, current_latest, pct_prior, pct_current.
    """
    each = rows.select(
        "segment", "origin", (F.col("prior_ultimate") * (F.col("pct_current") - F.col("pct_prior"))).alias("expected"), (F.col("current_latest") - F.col("prior_latest")).alias("actual")
    )
    out = each.rollup("segment", "origin").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual")).filter("segment is not null")
    return out.withColumns({"difference": F.col("actual") - F.col("expected"), "ratio": F.when(F.col("expected") != 0, F.col("actual") / F.col("expected"))})


def actual_expected_warnings(rows: DataFrame) -> DataFrame:
    odd = F.when(F.col("pct_current") < F.col("pct_prior"), "BACKWARDS").when(~F.col("pct_prior").between(0, 1.05) | ~F.col("pct_current").between(0, 1.05), "PERCENT_RANGE")
    return rows.withColumn("code", odd).filter("code is not null").select("segment", F.lit("actual_expected").alias("method"), "code", F.col("origin").alias("message"))


def percent_developed(factors: DataFrame) -> DataFrame:
    """``pct`` = 1 / cdf; null for a factor that isn't positive and finite."""
    return factors.withColumn("pct", F.when(finite("cdf") > 0, 1 / finite("cdf")))
