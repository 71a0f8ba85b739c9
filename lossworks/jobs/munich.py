"""Munich chain ladder: paid and incurred amounts projected together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.variance import completed, estimators
from lossworks.operators.factors import link_ratios
from lossworks.operators.triangles import latest, paired

SEG = ["segment"]
COL = ["segment", "age_idx"]


def _one(cells: DataFrame, kind: str) -> DataFrame:
    """One kind's cells under a common name, so that both sides join by segment."""
    return cells.select("segment", F.lit(kind).alias("kind"), "origin", "origin_idx", "age", "age_idx", finite("value").alias("value"))


def ratio_parameters(paid: DataFrame, incurred: DataFrame) -> DataFrame:
    """Per age the pooled paid-to-incurred ratio ``q`` and the deviations ``rho_p``, ``rho_i`` around it (null below two)."""
    both = paired(paid, incurred)[0].filter("a > 0 and b > 0")
    q = both.groupBy(*COL).agg((F.sum("a") / F.sum("b")).alias("q"), F.count("*").alias("n"))
    dev = both.join(q, COL).groupBy(*COL, "q", "n").agg(
        F.sum(F.col("a") * F.pow(F.col("b") / F.col("a") - 1 / F.col("q"), 2)).alias("dp"), F.sum(F.col("b") * F.pow(F.col("a") / F.col("b") - F.col("q"), 2)).alias("di")
    )
    enough = F.col("n") > 1
    return dev.select(*COL, "q", F.when(enough, F.sqrt(F.col("dp") / (F.col("n") - 1))).alias("rho_p"), F.when(enough, F.sqrt(F.col("di") / (F.col("n") - 1))).alias("rho_i"))


def _factor_residuals(cells: DataFrame, name: str) -> DataFrame:
    own = estimators(cells).select(*COL, "f", "sigma2").filter("sigma2 > 0")
    rows = link_ratios(cells).filter("ldf is not null").join(own, COL)
    return rows.select(*COL, "origin_idx", ((F.col("ldf") - F.col("f")) / F.sqrt("sigma2") * F.sqrt("c0")).alias(name))


def correlations(paid: DataFrame, incurred: DataFrame) -> DataFrame:
    """``segment, lambda_p, lambda_i``: slopes through the origin of factor residuals on ratio residuals; 0 without any."""
    ages = ratio_parameters(paid, incurred).filter("rho_p > 0 and rho_i > 0")
    cells = paired(paid, incurred)[0].filter("a > 0 and b > 0").join(ages, COL)
    ratio = cells.select(
        *COL, "origin_idx", ((F.col("b") / F.col("a") - 1 / F.col("q")) / F.col("rho_p") * F.sqrt("a")).alias("rp"), ((F.col("a") / F.col("b") - F.col("q")) / F.col("rho_i") * F.sqrt("b")).alias("ri")
    )
    at = [*COL, "origin_idx"]
    rows = ratio.join(_factor_residuals(paid, "fp"), at, "left").join(_factor_residuals(incurred, "fi"), at, "left")
    slope = lambda r, f: F.coalesce(F.try_divide(F.sum(F.col(r) * F.col(f)), F.sum(F.when(F.col(f).isNotNull(), F.col(r) * F.col(r)))), F.lit(0.0))
    return rows.groupBy(*SEG).agg(slope("rp", "fp").alias("lambda_p"), slope("ri", "fi").alias("lambda_i"))


def munich_chain_ladder(paid: DataFrame, incurred: DataFrame, last_sigma: tuple[float, float] | None = None) -> DataFrame:
    """A row per origin: ``paid_ultimate, incurred_ultimate`` and the separate chain ladders' ``scl_paid, scl_incurred``.

    Each step adds to the chain-ladder step the part of the gap between paid and incurred that the correlation explains.
    A final column whose sigma the data can't give takes ``last_sigma`` (paid, incurred) or the usual extrapolation.
    The coupled walk of an origin runs over its own few columns as an array fold.
    """
    paid, incurred = _one(paid, "paid"), _one(incurred, "incurred")

    def columns(cells: DataFrame, k: int, tag: str) -> DataFrame:
        own = estimators(cells)
        if last_sigma is not None:
            top = own.groupBy("segment").agg(F.max("age_idx").alias("_last"))
            own = own.join(top, "segment").withColumn("sigma2", F.when((F.col("age_idx") == F.col("_last")) & F.col("sigma2").isNull(), float(last_sigma[k]) ** 2).otherwise(F.col("sigma2"))).drop("_last")
        return completed(own).select(*COL, F.col("f").alias(f"f_{tag}"), F.sqrt("sigma2").alias(f"s_{tag}"))

    step = columns(paid, 0, "p").join(columns(incurred, 1, "i"), COL).join(ratio_parameters(paid, incurred), COL, "left").join(correlations(paid, incurred), SEG, "left")
    usable = (F.col("q") > 0) & (F.col("rho_p") > 0) & (F.col("rho_i") > 0)
    step = step.select(
        *COL, "f_p", "f_i", F.coalesce("q", F.lit(1.0)).alias("q"),
        F.coalesce(F.when(usable, F.col("lambda_p") * F.col("s_p") / F.col("rho_p")), F.lit(0.0)).alias("k_p"), F.coalesce(F.when(usable, F.col("lambda_i") * F.col("s_i") / F.col("rho_i")), F.lit(0.0)).alias("k_i"),
    )
    both = paired(paid, incurred)[0]
    ends = latest(paid).filter("latest is not null").select("segment", "origin", "origin_idx", F.col("latest_idx").alias("lp"), F.col("latest").alias("paid_latest")).join(
        latest(incurred).filter("latest is not null").select("segment", "origin_idx", F.col("latest_idx").alias("li"), F.col("latest").alias("incurred_latest")), ["segment", "origin_idx"]
    ).withColumn("start", F.least("lp", "li"))
    at = both.select("segment", "origin_idx", F.col("age_idx").alias("start"), F.col("a").alias("p0"), F.col("b").alias("i0"))
    seen = both.select("segment", "origin_idx", (F.col("age_idx") - 1).alias("age_idx"), F.col("a").alias("next_p"), F.col("b").alias("next_i"))
    steps = ends.select("segment", "origin_idx", "start").join(step, "segment").filter("age_idx >= start").join(seen, ["segment", "origin_idx", "age_idx"], "left")
    walk = steps.groupBy("segment", "origin_idx").agg(F.sort_array(F.collect_list(F.struct("age_idx", "f_p", "f_i", "q", "k_p", "k_i", "next_p", "next_i"))).alias("steps"))
    rows = ends.join(at, ["segment", "origin_idx", "start"]).join(walk, ["segment", "origin_idx"], "left")

    def moved(s, x):
        p = s["p"] * x["f_p"] + x["k_p"] * (s["i"] - s["p"] / x["q"])
        i = s["i"] * x["f_i"] + x["k_i"] * (s["p"] - s["i"] * x["q"])
        return F.struct(F.coalesce(x["next_p"], p).alias("p"), F.coalesce(x["next_i"], i).alias("i"))

    first = F.struct(F.col("p0").alias("p"), F.col("i0").alias("i"))
    end = F.when(F.col("steps").isNull(), first).otherwise(F.aggregate("steps", first, moved))
    alone = lambda last, f: F.aggregate(F.filter(F.coalesce("steps", F.array().cast(dict(rows.dtypes)["steps"])), lambda x: x["age_idx"] >= F.col(last)), F.lit(1.0), lambda acc, x: acc * x[f])
    out = rows.withColumn("_end", end).withColumns({"_gp": alone("lp", "f_p"), "_gi": alone("li", "f_i")})
    return out.select(
        "segment", "origin", "origin_idx", "paid_latest", "incurred_latest", F.col("_end.p").alias("paid_ultimate"), F.col("_end.i").alias("incurred_ultimate"),
        (F.col("paid_latest") * F.col("_gp")).alias("scl_paid"), (F.col("incurred_latest") * F.col("_gi")).alias("scl_incurred"),
    )
