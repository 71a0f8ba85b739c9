"""Layers above a cap: factors from a table of increased limits, and from illustrative curves where there is neither a table
nor a credible fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.functions.tables import broadcast_if_small, written
from lossworks.jobs.severity import uncap_factor

# Curves for illustration, of plausible shapes; no bureau's factors.
ILLUSTRATIVE = (
    ("casualty-lognormal-moderate", "lognormal", 9.2, 1.4),
    ("casualty-lognormal-heavy", "lognormal", 9.0, 1.8),
    ("liability-pareto", "pareto", 40000.0, 1.8),
)


def illustrative_curves(spark: SparkSession) -> DataFrame:
    """``curve, kind, p1, p2``."""
    return spark.createDataFrame(ILLUSTRATIVE, "curve string, kind string, p1 double, p2 double")


def checked_tables(table: DataFrame) -> DataFrame:
    """One row per segment of ``table`` (segment, limit, factor): ``segment, knots, message``.

    ``knots`` are its rows by limit. ``message`` says what is wrong with a table: fewer than two rows, a limit or factor
    that isn't positive, a repeated limit, factors that fall.
    """
    knot = F.struct(finite("limit").alias("limit"), finite("factor").alias("factor"))
    rows = table.groupBy("segment").agg(F.sort_array(F.collect_list(knot)).alias("knots"))
    pairs = F.arrays_zip(F.slice("knots", F.lit(1), F.size("knots") - 1).alias("lo"), F.slice("knots", F.lit(2), F.size("knots") - 1).alias("hi"))
    message = (
        F.when(F.size("knots") < 2, "a table needs at least two rows")
        .when(F.exists("knots", lambda k: ~F.coalesce((k.limit > 0) & (k.factor > 0), F.lit(False))), "limits and factors must be positive")
        .when(F.exists(pairs, lambda x: x.lo.limit == x.hi.limit), "a limit is repeated")
        .when(F.exists(pairs, lambda x: x.lo.factor > x.hi.factor), "factors must not fall as limits grow")
    )
    return rows.select("segment", "knots", message.alias("message"))


def interpolated(knots: Column, limit: Column) -> Column:
    """The factor at a limit, log-log between two knots and exact at one; null outside the table."""
    below = F.size(F.filter(knots, lambda k: k.limit <= limit))
    lo, hi = F.get(knots, below - 1), F.get(knots, below)
    share = (F.ln(limit) - F.ln(lo.limit)) / (F.ln(hi.limit) - F.ln(lo.limit))
    return F.when(limit == lo.limit, lo.factor).when(limit > lo.limit, F.exp(F.ln(lo.factor) + share * (F.ln(hi.factor) - F.ln(lo.factor))))


def table_factors(table: DataFrame, layers: DataFrame) -> DataFrame:
    """``layers`` (segment, cap, target and more) with ``factor`` from losses capped at ``cap`` to those limited at ``target``.

    Where there is none ``code`` and ``message`` say why: a target below the cap or amounts that are no numbers (BAD_LIMIT), no table
    or a bad one (BAD_TABLE), a limit outside it (TABLE_RANGE; nothing is extrapolated). A bad layer or table fails alone.
    Both limits are placed by one join: a segment's table, a few dozen published rows, travels to its layers as one
    array (broadcast where measured small), so a segment with very many layers is dealt like any other.
    """
    tables = written(checked_tables(table), "limit-tables").select(F.col("segment").alias("_segment"), F.col("knots").alias("_knots"), F.col("message").alias("_message"))
    rows = layers.join(broadcast_if_small(tables), F.col("segment").eqNullSafe(F.col("_segment")), "left")
    cap, target = finite("cap"), finite("target")
    rows = rows.withColumn("_cap", interpolated(F.col("_knots"), cap)).withColumn("_target", interpolated(F.col("_knots"), target))
    problem = (
        F.when(cap.isNull() | target.isNull(), _problem("BAD_LIMIT", "cap and target must be numbers"))
        .when(target < cap, _problem("BAD_LIMIT", "the target must be at or above the cap"))
        .when(F.col("_knots").isNull(), _problem("BAD_TABLE", "the segment has no table"))
        .when(F.col("_message").isNotNull(), _problem("BAD_TABLE", F.col("_message")))
        .when(F.col("_cap").isNull() | F.col("_target").isNull(), _problem("TABLE_RANGE", "a limit is outside the table"))
    )
    rows = rows.withColumn("_problem", problem)
    factor = F.when(F.col("_problem").isNull(), F.col("_target") / F.col("_cap"))
    return rows.select(*layers.columns, factor.alias("factor"), "_problem.code", "_problem.message")


def _problem(code: str, message: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def curve_factors(layers: DataFrame, curves: DataFrame | None = None) -> DataFrame:
    """``layers`` by each curve (``curve, kind, p1, p2``; none: the illustrative ones) with ``curve, factor, code``.

    A null target is none: losses without a limit, for which a Pareto of infinite mean has no factor (INFINITE_MEAN).
    """
    curves = illustrative_curves(layers.sparkSession) if curves is None else curves
    menu = curves.agg(F.sort_array(F.collect_list(F.struct("curve", "kind", "p1", "p2"))).alias("_curves")).first()["_curves"]
    each = F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in c.asDict().items())) for c in menu)))
    rows = layers.withColumn("_c", each)
    kind, p1, p2, cap, target = F.col("_c.kind"), F.col("_c.p1"), F.col("_c.p2"), finite("cap"), finite("target")
    endless = F.col("target").isNull()
    code = F.when(~F.coalesce(cap > 0, F.lit(False)) | (~endless & ~F.coalesce(target >= cap, F.lit(False))), "BAD_LIMIT").when(endless & (kind == "pareto") & (p2 <= 1), "INFINITE_MEAN")
    factor = F.when(endless, uncap_factor(kind, p1, p2, cap)).otherwise(uncap_factor(kind, p1, p2, cap, target))
    return rows.select(*layers.columns, F.col("_c.curve").alias("curve"), F.when(code.isNull(), factor).alias("factor"), code.alias("code"))
