"""Tests of a triangle: calendar-year effect, correlation of subsequent factors, exhibits of ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.operators.factors import link_ratios
from lossworks.operators.triangles import COLUMN

SEG = ["segment", "kind"]


def calendar_diagonals(cells: DataFrame) -> DataFrame:
    """Per diagonal the ratios above (``large``) and below (``small``) their column's median, z, its mean and variance.

    Columns with fewer than two ratios don't count; segments with fewer than three origins have no rows.
    """
    enough = cells.groupBy(*SEG).agg(F.countDistinct("origin_idx").alias("_o")).filter("_o >= 3").drop("_o")
    ratios = link_ratios(cells).filter("ldf is not null").join(enough, SEG)
    own = Window.partitionBy(*COLUMN)
    marked = ratios.withColumns({"_mid": F.percentile("ldf", F.lit(0.5)).over(own), "_n": F.count("*").over(own)}).filter("_n >= 2 and ldf <> _mid")
    diagonal = (F.col("origin_idx") + F.col("age_idx") + 1).alias("diagonal")
    out = marked.groupBy(*SEG, diagonal).agg(F.count_if(F.col("ldf") > F.col("_mid")).alias("large"), F.count_if(F.col("ldf") < F.col("_mid")).alias("small"))
    n = (F.col("large") + F.col("small")).cast("double")
    m = F.floor((n - 1) / 2)
    binomial = F.when(m > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(m, F.lit(1)).cast("long")), F.lit(1.0), lambda acc, x: acc * (n - x) / x)).otherwise(1.0)
    c = binomial * n / F.pow(F.lit(2.0), n)
    expected = n / 2 - c
    out = out.withColumn("z", F.least("large", "small")).withColumn("expected_z", expected)
    return out.withColumn("variance_z", n * (n - 1) / 4 - c * (n - 1) + F.col("expected_z") - F.pow("expected_z", F.lit(2)))


def calendar_year_test(cells: DataFrame) -> DataFrame:
    """Per segment total z, its mean and variance, the 95 % interval and whether z lies outside."""
    sums = calendar_diagonals(cells).groupBy(*SEG).agg(F.sum("z").alias("z"), F.sum("expected_z").alias("expected_z"), F.sum("variance_z").alias("variance_z"))
    half = 1.96 * F.sqrt(F.greatest("variance_z", F.lit(0.0)))
    out = sums.withColumns({"low": F.col("expected_z") - half, "high": F.col("expected_z") + half})
    return out.withColumn("significant", (F.col("z") < F.col("low")) | (F.col("z") > F.col("high")))


def _average_rank(value: str, *keys: str):
    """Rank with ties averaged."""
    own = Window.partitionBy(*keys)
    return F.rank().over(own.orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def factor_correlation(cells: DataFrame) -> DataFrame:
    """Per segment the weighted Spearman statistic of subsequent ratios, its variance, the 50 % bound, and the verdict."""
    row = Window.partitionBy(*SEG, "origin_idx").orderBy("age_idx")
    origins = cells.groupBy(*SEG).agg(F.countDistinct("origin_idx").alias("_o"))
    pairs = link_ratios(cells).withColumn("pre", F.lag("ldf").over(row)).filter("ldf is not null and pre is not null")
    pairs = pairs.join(origins, SEG).filter(F.col("age_idx") + 1 <= F.col("_o") - 2)
    ranked = pairs.withColumns({"_r": _average_rank("ldf", *COLUMN), "_s": _average_rank("pre", *COLUMN)})
    columns = ranked.groupBy(*COLUMN).agg(F.count("*").alias("m"), F.sum(F.pow(F.col("_r") - F.col("_s"), 2)).alias("d2")).filter("m > 1")
    columns = columns.withColumn("t", 1 - 6 * F.col("d2") / (F.col("m") * (F.col("m") * F.col("m") - 1)))
    out = columns.groupBy(*SEG).agg((F.sum((F.col("m") - 1) * F.col("t")) / F.sum(F.col("m") - 1)).alias("statistic"), (1.0 / F.sum(F.col("m") - 1)).alias("variance"))
    out = out.withColumn("bound50", 0.67 * F.sqrt("variance"))
    return out.withColumn("correlated", F.abs("statistic") > F.col("bound50"))


def _median_trend(grid: DataFrame, value: str) -> DataFrame:
    """Per segment the median over columns of the growth per origin that a log-linear fit (three points) gives."""
    y = F.when(F.col(value) > 0, F.ln(value))
    columns = grid.withColumn("_y", y).groupBy("segment", "age_idx").agg(F.count("_y").alias("n"), F.regr_slope("_y", "origin_idx").alias("b")).filter("n >= 3 and b is not null")
    return columns.groupBy("segment").agg(F.percentile(F.exp("b") - 1, F.lit(0.5)).alias(f"{value}_trend"))


def _recent_shift(grid: DataFrame, value: str, recent: int = 3, mature: float = 0.95) -> DataFrame:
    """Per segment the median over immature columns of the last values' mean over the earlier ones', less 1."""
    column = Window.partitionBy("segment", "age_idx")
    rows = grid.filter(F.col(value).isNotNull()).withColumns({
        "_back": F.row_number().over(column.orderBy(F.desc("origin_idx"))), "_up": F.row_number().over(column.orderBy(value)), "_n": F.count("*").over(column),
    })
    sums = rows.groupBy("segment", "age_idx", "_n").agg(
        F.max(F.when(F.col("_up") == F.floor(F.col("_n") / 2) + 1, F.col(value))).alias("mid"), F.avg(F.when(F.col("_back") <= recent, F.col(value))).alias("new"), F.avg(F.when(F.col("_back") > recent, F.col(value))).alias("old")
    )
    sums = sums.filter((F.col("_n") >= recent + 2) & (F.col("mid") < mature) & (F.col("old") != 0))
    return sums.groupBy("segment").agg(F.percentile(F.col("new") / F.col("old") - 1, F.lit(0.5)).alias(f"{value}_shift"))


def run_diagnostics(triangles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(measures, findings) per segment: closure shift, case and paid-to-incurred trends, calendar-year effect."""
    from lossworks.operators.triangles import measure, ratio_grids

    grid = ratio_grids(triangles)
    out = triangles.select("segment").distinct()
    for part in (_recent_shift(grid, "closed_to_reported"), _median_trend(grid, "average_open_case"), _median_trend(grid, "paid_to_incurred")):
        out = out.join(part, "segment", "left")
    out = out.join(calendar_year_test(measure(triangles, "paid")).select("segment", "significant"), "segment", "left")
    tests = (
        ("SETTLEMENT_RATE_SHIFT", F.abs("closed_to_reported_shift") > 0.05), ("CASE_ADEQUACY_SHIFT", F.abs("average_open_case_trend") > 0.08),
        ("PAID_TO_INCURRED_SHIFT", F.abs("paid_to_incurred_trend") > 0.03), ("CALENDAR_YEAR_EFFECT", F.col("significant")),
    )
    found = F.array_compact(F.array(*(F.when(test, F.lit(code)) for code, test in tests)))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NO_MATERIAL_DISTORTIONS")))
    return out, out.select("segment", F.explode(found).alias("code"))
