"""Why a segment has no result: one row ``segment, method, code, message`` for each segment that a method leaves out.

The methods skip segments that they can't take, so that one never fails the others; these frames say which and why.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.stochastic import LEAST_POOL, odp_fit
from lossworks.operators.factors import link_ratios
from lossworks.operators.triangles import paired


def _errors(rows: DataFrame, method: str, reason: Column) -> DataFrame:
    """``reason`` is a struct of code and message, or null where there is nothing to report."""
    return rows.withColumn("_e", reason).filter("_e is not null").select("segment", F.lit(method).alias("method"), "_e.code", "_e.message")


def _because(code: str, message: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _columns(cells: DataFrame) -> DataFrame:
    """Per segment its numbers of origins and ages, and its first column of ages without any ratio."""
    size = cells.groupBy("segment").agg(F.countDistinct("origin_idx").alias("origins"), F.countDistinct("age_idx").alias("ages"))
    ratios = link_ratios(cells).groupBy("segment", "from_age", "to_age").agg(F.count("ldf").alias("n"))
    empty = ratios.filter("n = 0").groupBy("segment").agg(F.min(F.struct("from_age", "to_age")).alias("_bare"))
    return size.join(empty, "segment", "left")


def _no_factor() -> Column:
    return _because("NO_FACTOR", F.concat(F.lit("no usable factor for ages "), F.col("_bare.from_age").cast("string"), F.lit("-"), F.col("_bare.to_age").cast("string")))


def mack_errors(cells: DataFrame) -> DataFrame:
    """Of ``mack`` and ``mack_residuals``: fewer than two ages, or a column of ages without any ratio."""
    reason = F.when(F.col("ages") < 2, _because("TOO_SMALL", "fewer than two ages")).when(F.col("_bare").isNotNull(), _no_factor())
    return _errors(_columns(cells), "mack", reason)


def merz_wuthrich_errors(cells: DataFrame) -> DataFrame:
    """Of ``merz_wuthrich``: triangles that aren't square, have a hole or a cell that isn't positive, or go beyond the diagonal."""
    n = F.max("origin_idx").over(Window.partitionBy("segment"))
    inside = F.col("origin_idx") + F.col("age_idx") <= F.col("_n")
    out = cells.withColumn("_n", n).groupBy("segment").agg(
        (F.max("origin_idx") + 1).alias("origins"), (F.max("age_idx") + 1).alias("ages"),
        F.max((inside & ~(F.coalesce(finite("value"), F.lit(0.0)) > 0)).cast("int")).alias("_hole"), F.max((~inside & F.col("value").isNotNull()).cast("int")).alias("_beyond"),
    )
    reason = (
        F.when(F.col("origins") != F.col("ages"), _because("SHAPE", "not as many origins as ages")).when(F.col("origins") < 2, _because("TOO_SMALL", "fewer than two ages"))
        .when(F.col("_hole") == 1, _because("SHAPE", "a cell up to the latest diagonal is missing or not positive")).when(F.col("_beyond") == 1, _because("SHAPE", "a cell beyond the latest diagonal is observed"))
    )
    return _errors(out, "merz_wuthrich", reason)


def odp_errors(cells: DataFrame, method: str = "odp_fit") -> DataFrame:
    """Of ``odp_fit`` and, with ``method`` ``bootstrap``, of the bootstrap, which needs some residuals that aren't zero."""
    fits = odp_fit(cells).select("segment", "pool")
    reason = (
        F.when((F.col("origins") < 3) | (F.col("ages") < 3), _because("TOO_SMALL", "fewer than three origins or ages")).when(F.col("_bare").isNotNull(), _no_factor())
        .when(F.col("pool").isNull(), _because("TOO_SMALL", "no degrees of freedom are left"))
    )
    if method == "bootstrap":
        reason = reason.when(F.col("pool") < LEAST_POOL, _because("TOO_SMALL", "too few usable residuals"))
    return _errors(_columns(cells).join(fits, "segment", "left"), method, reason)


def munich_errors(paid: DataFrame, incurred: DataFrame) -> DataFrame:
    """Of ``munich_chain_ladder``: other shapes of the two, fewer than two ages, a column without any ratio."""
    shape = paired(paid, incurred)[1].select("segment", F.lit(True).alias("_odd"))
    sides = _columns(paid).unionByName(_columns(incurred)).groupBy("segment").agg(F.min("ages").alias("ages"), F.min("_bare").alias("_bare"))
    reason = (
        F.when(F.col("_odd"), _because("SHAPE", "the triangles' origins or ages differ")).when(F.col("ages") < 2, _because("TOO_SMALL", "fewer than two ages")).when(F.col("_bare").isNotNull(), _no_factor())
    )
    return _errors(sides.join(shape, "segment", "left"), "munich_chain_ladder", reason)


def pair_errors(a: DataFrame, b: DataFrame, method: str) -> DataFrame:
    """Of ``add``, ``subtract`` and ``severity``: triangles of other origins or ages."""
    return paired(a, b)[1].withColumn("method", F.lit(method))


def cape_cod_errors(rows: DataFrame) -> DataFrame:
    """Of ``cape_cod``: losses below 0, premiums, factors or adjustments that aren't positive."""
    bad = lambda c: ~F.coalesce(finite(c) > 0, F.lit(False))
    adjusted = lambda c: F.col(c).isNotNull() & bad(c)
    each = (
        F.when(bad("cdf"), _because("BAD_CDF", F.concat(F.lit("no positive factor in "), "origin"))).when(bad("premium"), _because("BAD_PREMIUM", F.concat(F.lit("no positive premium in "), "origin")))
        .when(~F.coalesce(finite("reported") >= 0, F.lit(False)), _because("BAD_LOSSES", F.concat(F.lit("losses below 0 in "), "origin"))).when(adjusted("loss_adj") | adjusted("premium_adj"), _because("BAD_ADJ", F.concat(F.lit("no positive adjustment in "), "origin")))
    )
    return _errors(rows.withColumn("_r", each).groupBy("segment").agg(F.min("_r").alias("_r")), "cape_cod", F.col("_r"))


def ulae_errors(periods: DataFrame) -> DataFrame:
    """Of ``ulae_ratios``: a segment with an amount that is missing, no number or below 0."""
    amounts = ("ulae_paid", "paid", "reported_ultimate", "closed_ultimate")
    bad = F.coalesce(*(F.when(~F.coalesce(finite(c) >= 0, F.lit(False)), F.lit(c)) for c in amounts))
    each = F.when(bad.isNotNull(), _because("BAD_LOSSES", F.concat(bad, F.lit(" is below 0 or missing in "), "period")))
    return _errors(periods.withColumn("_r", each).groupBy("segment").agg(F.min("_r").alias("_r")), "ulae_ratios", F.col("_r"))
