"""Standard errors of the chain ladder: Mack, its residuals, and the one-year view of Merz and Wuthrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.operators.factors import link_ratios
from lossworks.operators.triangles import COLUMN, latest

SEG = ["segment", "kind"]


def estimators(cells: DataFrame) -> DataFrame:
    """Per column: the weighted factor ``f``, its volume ``den``, ``n`` and the data's ``sigma2`` (null below two ratios).

    A segment with a column without any ratio has no rows: it can't be projected.
    """
    use = F.col("ldf").isNotNull()
    ratios = link_ratios(cells)
    own = Window.partitionBy(*COLUMN)
    f = F.sum(F.when(use, F.col("c1"))).over(own) / F.sum(F.when(use, F.col("c0"))).over(own)
    out = ratios.withColumn("f", f).groupBy(*COLUMN, "from_age", "to_age", "f").agg(
        F.sum(F.when(use, F.col("c0"))).alias("den"), F.count("ldf").alias("n"), F.sum(F.when(use, F.col("c0") * F.pow(F.col("ldf") - F.col("f"), 2))).alias("_ss")
    )
    out = out.withColumn("sigma2", F.when(F.col("n") > 1, F.col("_ss") / (F.col("n") - 1))).drop("_ss")
    return out.withColumn("_whole", F.min(F.col("n")).over(Window.partitionBy(*SEG)) > 0).filter("_whole").drop("_whole")


def completed(columns: DataFrame) -> DataFrame:
    """``columns`` with missing ``sigma2`` filled from left to right: min(b^2/a, a, b) of the two columns before."""
    ordered = F.sort_array(F.collect_list(F.struct("age_idx", "sigma2")))

    def step(done, x):
        n = F.size(done)
        b = F.when(n > 0, F.get(done, n - 1))
        a = F.when(n > 1, F.get(done, n - 2))
        filled = F.when(a > 0, F.least(b * b / a, a, b)).when(b.isNotNull(), b).otherwise(0.0)
        return F.concat(done, F.array(F.coalesce(x["sigma2"], filled)))

    filled = F.aggregate("o", F.array().cast("array<double>"), step)
    # places are age indexes: columns are numbered from 0 without a gap
    per = columns.groupBy(*SEG).agg(ordered.alias("o")).select(*SEG, F.posexplode(filled).alias("age_idx", "sigma2"))
    return columns.drop("sigma2").join(per, list(COLUMN))


def _columns(cells: DataFrame, selections: DataFrame | None) -> DataFrame:
    """Estimators with filled ``sigma2`` and the projection factor ``g``: the selection (1 where unusable) or ``f``."""
    out = completed(estimators(cells))
    if selections is None:
        return out.withColumn("g", F.col("f"))
    own = selections.select(*COLUMN, finite("ldf").alias("_s"))
    return out.join(own, list(COLUMN), "left").withColumn("g", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)).drop("_s")


def mack(cells: DataFrame, selections: DataFrame | None = None, tail: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): per origin and per segment ``latest, ultimate, reserve, standard_error, cv``.

    Each pair of origins shares the estimation error of the columns that both have still to pass, so its part starts at
    the more mature one's age. A tail other than 1 counts as one more column, its variance extrapolated once more.
    """
    if not tail > 0:
        raise ValueError("BAD_TAIL: the tail factor must be positive")
    columns = _columns(cells, selections)
    by_age = Window.partitionBy(*SEG).orderBy("age_idx")
    columns = columns.withColumns({
        "_a": F.lag("sigma2").over(by_age), "_lastc": F.lead("age_idx").over(by_age).isNull(), "unit": F.col("sigma2") / F.pow("g", F.lit(2)),
    })
    shape = columns.filter("_lastc").select(
        *SEG, F.col("age_idx").alias("_k"), F.col("den").alias("_dt"),
        (F.lit(float(tail != 1)) * F.when(F.col("_a") > 0, F.least(F.col("sigma2") * F.col("sigma2") / F.col("_a"), "_a", "sigma2")).otherwise(F.col("sigma2")) / tail**2).alias("_ut"),
    )
    rows = latest(cells).filter("latest is not null").join(shape, SEG)
    ahead = rows.join(columns.select(*SEG, "age_idx", "g", "unit", "den"), SEG).filter(F.col("age_idx") >= F.col("latest_idx"))
    so_far = Window.partitionBy(*SEG, "origin_idx").orderBy("age_idx").rowsBetween(Window.unboundedPreceding, -1)
    ahead = ahead.withColumn("c", F.col("latest") * F.coalesce(F.product("g").over(so_far), F.lit(1.0)))
    sums = ahead.groupBy(*SEG, "origin_idx").agg(
        F.product("g").alias("_growth"), F.sum(F.when(F.col("c") > 0, F.col("unit") * (1 / F.col("c") + 1 / F.col("den")))).alias("_terms"), F.sum(F.when(F.col("c") > 0, 0).otherwise(1)).alias("dropped_columns")
    )
    end = F.col("latest") * F.coalesce("_growth", F.lit(1.0))
    rows = rows.join(sums, [*SEG, "origin_idx"], "left").withColumn("_end", end).withColumn("ultimate", F.col("_end") * tail)
    rows = rows.withColumn("mse", (F.coalesce("_terms", F.lit(0.0)) + F.when(F.col("_end") > 0, F.col("_ut") * (1 / F.col("_end") + 1 / F.col("_dt"))).otherwise(0.0)) * F.pow("ultimate", F.lit(2)))
    onward = Window.partitionBy(*SEG).orderBy("age_idx").rowsBetween(0, Window.unboundedFollowing)
    shared = columns.select(*SEG, F.col("age_idx").alias("_floor"), F.sum(2 * F.col("unit") / F.col("den")).over(onward).alias("_g"))
    x = rows.filter("ultimate > 0").select(*SEG, F.col("origin_idx").alias("_i"), F.col("ultimate").alias("_u"), F.col("latest_idx").alias("_m"), "_ut", "_dt")
    y = rows.filter("ultimate > 0").select(*SEG, F.col("origin_idx").alias("_j"), F.col("ultimate").alias("_v"), F.col("latest_idx").alias("_l"))
    pairs = x.join(y, SEG).filter("_i < _j").withColumn("_floor", F.greatest("_m", "_l")).join(shared, [*SEG, "_floor"], "left")
    pairs = pairs.groupBy(*SEG).agg(F.sum(F.col("_u") * F.col("_v") * (F.coalesce("_g", F.lit(0.0)) + 2 * F.col("_ut") / F.col("_dt"))).alias("_pairs"))
    reserve = F.col("ultimate") - F.col("latest")
    error = F.sqrt("mse")
    per_origin = rows.select(
        *SEG, "origin", "origin_idx", "latest", "ultimate", reserve.alias("reserve"), error.alias("standard_error"), F.when(reserve != 0, error / reserve).alias("cv"),
        F.coalesce("dropped_columns", F.lit(0)).alias("dropped_columns"),
    )
    per_segment = rows.groupBy(*SEG).agg(F.sum("latest").alias("latest"), F.sum("ultimate").alias("ultimate"), F.sum("mse").alias("_m")).join(pairs, SEG, "left")
    total = F.sqrt(F.col("_m") + F.coalesce("_pairs", F.lit(0.0)))
    per_segment = per_segment.select(*SEG, "latest", "ultimate", reserve.alias("reserve"), total.alias("standard_error"), F.when(reserve != 0, total / reserve).alias("cv"))
    return per_origin, per_segment


def mack_residuals(cells: DataFrame) -> DataFrame:
    """``origin, from_age, to_age, calendar, factor, residual``: (F - f) sqrt(C) / sigma; null where sigma is unknown or 0."""
    own = estimators(cells).select(*COLUMN, "f", "sigma2")
    rows = link_ratios(cells).filter("ldf is not null").join(own, list(COLUMN))
    residual = F.when(F.col("sigma2") > 0, (F.col("ldf") - F.col("f")) * F.sqrt("c0") / F.sqrt("sigma2"))
    return rows.select(*SEG, "origin", "from_age", "to_age", (F.col("origin_idx") + F.col("age_idx") + 1).alias("calendar"), F.col("ldf").alias("factor"), residual.alias("residual"))


def merz_wuthrich(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, totals): the one-year claims-development error beside Mack's, for square regular triangles.

    Other segments (not square, with holes, or with a cell that isn't positive) have no rows.
    """
    size = F.max("origin_idx") + 1
    odd = F.max(F.when(F.col("origin_idx") + F.col("age_idx") < F.col("_n"), F.when(F.coalesce(finite("value"), F.lit(0.0)) > 0, 0).otherwise(1)).otherwise(F.when(F.col("value").isNull(), 0).otherwise(1)))
    sized = cells.withColumn("_n", F.max("origin_idx").over(Window.partitionBy(*SEG)) + 1)
    fit = sized.groupBy(*SEG, "_n").agg((F.max("age_idx") + 1).alias("_k"), odd.alias("_odd"), size.alias("_s")).filter("_n = _k and _odd = 0 and _n > 1").select(*SEG, "_n")
    good = cells.join(fit, SEG)
    diagonal = good.filter(F.col("origin_idx") + F.col("age_idx") == F.col("_n") - 1).select(*SEG, "_n", "origin", "origin_idx", "age_idx", F.col("value").alias("latest"))
    columns = completed(estimators(good.drop("_n"))).select(*SEG, "age_idx", "f", "den", (F.col("sigma2") / F.pow("f", F.lit(2))).alias("sjr"))
    at = diagonal.join(columns, [*SEG, "age_idx"], "left")
    piece = F.col("latest") / (F.col("den") + F.col("latest")) * F.col("sjr") / F.col("den")
    later = Window.partitionBy(*SEG).orderBy("age_idx").rowsBetween(1, Window.unboundedFollowing)
    onward = Window.partitionBy(*SEG).orderBy("age_idx").rowsBetween(0, Window.unboundedFollowing)
    at = at.withColumns({
        "_est": F.col("sjr") / F.col("den") + F.coalesce(F.sum(piece).over(later), F.lit(0.0)),
        "ultimate": F.col("latest") * F.product(F.coalesce("f", F.lit(1.0))).over(onward),
    })
    at = at.withColumn("msep", F.when(F.col("origin_idx") > 0, F.pow("ultimate", F.lit(2)) * (F.col("sjr") / F.col("latest") + F.col("_est"))).otherwise(0.0))
    younger = Window.partitionBy(*SEG).orderBy("origin_idx").rowsBetween(1, Window.unboundedFollowing)
    at = at.withColumn("_cross", F.when(F.col("origin_idx") > 0, 2 * F.col("ultimate") * F.coalesce(F.sum("ultimate").over(younger), F.lit(0.0)) * F.col("_est")).otherwise(0.0))
    per_origin, per_segment = mack(good.drop("_n"))
    ratio = F.when(F.col("mack_root") > 0, F.col("cdr_root") / F.col("mack_root")).alias("one_year_ratio")
    rows = at.select(*SEG, "origin", "origin_idx", (F.col("ultimate") - F.col("latest")).alias("reserve"), F.sqrt("msep").alias("cdr_root"))
    rows = rows.join(per_origin.select(*SEG, "origin", F.col("standard_error").alias("mack_root")), [*SEG, "origin"]).select("*", ratio)
    sums = at.groupBy(*SEG).agg(F.sum(F.col("ultimate") - F.col("latest")).alias("reserve"), F.sqrt(F.sum(F.col("msep") + F.col("_cross"))).alias("cdr_root"))
    sums = sums.join(per_segment.select(*SEG, F.col("standard_error").alias("mack_root")), SEG).select("*", ratio)
    return rows, sums
