"""Trends, rate levels and tail curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite

HORIZON, LARGEST_TAIL, CONVERGED, LEAST_POINTS = 200, 5.0, 1e-7, 3


def trend_value(value: Column, rate: Column, from_year: Column, to_year: Column) -> Column:
    """value x (1 + rate)^(to - from); null unless the rate is above -1."""
    return F.when(rate > -1, value * F.pow(1 + rate, to_year - from_year))


def analyze_trend(points: DataFrame, per_year: int = 1) -> DataFrame:
    """``segment, fit, annual_rate, r_squared, n_points, excluded`` from ``segment, year, value``.

    Exponential fits over all usable points, the last five and three years, and all but the highest and lowest value
    (five points at least); a fit has a rate from three points on.
    """
    per_year = max(1, round(per_year))
    good = (finite("value") > 0) & F.col("year").isNotNull()
    own = Window.partitionBy("segment")
    excluded = points.groupBy("segment").agg(F.count_if(~F.coalesce(good, F.lit(False))).alias("excluded"))
    rows = points.filter(good).withColumns({
        "_back": F.row_number().over(own.orderBy(F.desc("year"))), "_hi": F.row_number().over(own.orderBy(F.desc("value"), F.desc("year"))), "_lo": F.row_number().over(own.orderBy("value", "year")), "_n": F.count("*").over(own),
    })
    windows = {"all": F.lit(True), "last5": F.col("_back") <= 5 * per_year, "last3": F.col("_back") <= 3 * per_year, "exhilo": (F.col("_n") >= 5) & (F.col("_hi") > 1) & (F.col("_lo") > 1)}
    each = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in windows.items()))))
    y = F.ln("value")
    fits = rows.select("segment", "year", y.alias("y"), each.alias("fit")).groupBy("segment", "fit").agg(F.count("*").alias("n_points"), F.regr_slope("y", "year").alias("_b"), F.regr_r2("y", "year").alias("_r"), F.regr_syy("y", "year").alias("_s"))
    enough = F.col("n_points") >= LEAST_POINTS
    menu = excluded.select("segment", "excluded", F.explode(F.array(*map(F.lit, windows))).alias("fit"))
    return menu.join(fits, ["segment", "fit"], "left").select(
        "segment", "fit", F.when(enough, F.exp("_b") - 1).alias("annual_rate"), F.when(enough, F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_r"))).alias("r_squared"), F.coalesce("n_points", F.lit(0)).alias("n_points"), "excluded",
    )


def year_fraction(date: Column) -> Column:
    return F.year(date) + (F.dayofyear(date) - 1) / F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))


def _area(w: Column, p0: Column, p1: Column) -> Column:
    """Earnings up to policy date w of policies of one year that are in force within [p0, p1]."""
    r2 = lambda x: F.pow(F.greatest(x, F.lit(0.0)), F.lit(2))
    return (r2(w - p0 + 1) - r2(w - p1 + 1) - r2(w - p0) + r2(w - p1)) / 2


def on_level(origins: DataFrame, changes: DataFrame) -> DataFrame:
    """``segment, origin, average_level, current_level, on_level_factor`` by the parallelogram.

    ``origins``: segment, origin, p0, p1 (the period in years); ``changes``: segment, effective_date, change. Annual
    policies written evenly: the share of a period that an era earns has a closed form.
    """
    good = changes.filter(finite("change") > -1).select("segment", year_fraction(F.col("effective_date")).alias("at"), (1 + F.col("change")).alias("step"))
    own = Window.partitionBy("segment").orderBy("at")
    eras = good.select("segment", "at", F.product("step").over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("level"), F.lead("at").over(own).alias("to"))
    first = origins.select("segment").distinct().join(good.groupBy("segment").agg(F.min("at").alias("to")), "segment", "left").select("segment", F.lit(float("-inf")).alias("at"), F.lit(1.0).alias("level"), "to")
    last = good.groupBy("segment").agg(F.product("step").alias("current_level"))
    rows = origins.join(eras.unionByName(first), "segment").join(last, "segment", "left")
    p0, p1 = F.col("p0").cast("double"), F.col("p1").cast("double")
    clamp = lambda x: F.least(F.greatest(x, p0 - 1), p1)
    share = (_area(clamp(F.coalesce("to", F.lit(float("inf")))), p0, p1) - _area(clamp(F.col("at")), p0, p1)) / (p1 - p0)
    out = rows.groupBy("segment", "origin").agg(F.sum(share * F.col("level")).alias("average_level"), F.first(F.coalesce("current_level", F.lit(1.0))).alias("current_level"))
    return out.withColumn("on_level_factor", F.col("current_level") / F.col("average_level"))


def fit_tail(selections: DataFrame, method: str = "exponential", horizon: int = HORIZON) -> DataFrame:
    """``segment, kind, n_points, slope, intercept, r_squared, tail_factor, valid, converged`` from selected factors.

    A line through ln(f - 1) on the column's number (``exponential``) or its logarithm (``inverse_power``), of factors
    above 1; extrapolated from the last selected column until a factor is 1 for all purposes, or the horizon. Fewer than
    three points, a slope that isn't negative, or a product above the limit make the fit invalid, with tail 1.
    """
    x = F.col("j").cast("double") if method == "exponential" else F.ln("j")
    base = selections.select("segment", "kind", (F.col("age_idx") + 1).alias("j"), finite("ldf").alias("f"))
    used = F.when(F.col("f") > 1, F.ln(F.col("f") - 1))
    fits = base.withColumns({"x": x, "y": used}).groupBy("segment", "kind").agg(
        F.count("y").alias("n_points"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("_r"), F.regr_syy("y", "x").alias("_s"),
        F.max(F.when(F.col("f").isNotNull(), F.col("j"))).alias("last"),
    )
    fits = fits.withColumn("r_squared", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_r"))).withColumn("_ok", (F.col("n_points") >= LEAST_POINTS) & (F.col("slope") < 0))
    steps = fits.filter("_ok").select("segment", "kind", "slope", "intercept", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    idx = (F.col("last") + F.col("step")).cast("double")
    steps = steps.withColumn("f", 1 + F.exp(F.col("intercept") + F.col("slope") * (idx if method == "exponential" else F.ln(idx))))
    order = Window.partitionBy("segment", "kind").orderBy("step")
    steps = steps.withColumn("_done", F.coalesce(F.max((F.col("f") - 1 < CONVERGED).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_done = 0")
    tails = steps.groupBy("segment", "kind").agg(F.product("f").alias("_tail"), F.max((F.col("f") - 1 < CONVERGED).cast("int")).alias("_c"))
    valid = F.col("_ok") & (F.col("_tail") <= LARGEST_TAIL)
    return fits.join(tails, ["segment", "kind"], "left").withColumn("valid", F.coalesce(valid, F.lit(False))).select(
        "segment", "kind", "n_points", "slope", "intercept", "r_squared", F.when(F.col("valid"), F.col("_tail")).otherwise(1.0).alias("tail_factor"), "valid", (F.coalesce("_c", F.lit(0)) == 1).alias("converged")
    )
