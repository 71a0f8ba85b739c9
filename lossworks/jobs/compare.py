"""Comparison of result sets, and of assumption ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.functions.order import in_buckets

CENTRAL, ERRORS = 1e-6, 0.005


def _deviation(x, y):
    top = F.greatest(F.abs(x), F.abs(y))
    return F.when(top > 0, F.abs(x - y) / top).otherwise(0.0)


def crosscheck(a: DataFrame, b: DataFrame, central: float = CENTRAL, errors: float = ERRORS, atol: float = 0.0) -> DataFrame:
    """A verdict per segment on two result tables ``segment, origin, ultimate, unpaid, standard_error``.

    ``not-comparable`` without a common origin, or where one side alone gives standard errors; ``disagree`` where origins
    differ or a deviation exceeds its tolerance; else ``agree``. One join on segment and origin.
    """
    names = ("ultimate", "unpaid", "standard_error")
    x = a.select("segment", "origin", *(finite(c).alias(f"a_{c}") for c in names), F.lit(1).alias("_a"))
    y = b.select("segment", "origin", *(finite(c).alias(f"b_{c}") for c in names), F.lit(1).alias("_b"))
    both = x.join(y, ["segment", "origin"], "full_outer")
    aggs = [F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b")]
    for c, tolerance in zip(names, (central, central, errors), strict=True):
        p, q = F.col(f"a_{c}"), F.col(f"b_{c}")
        over = F.abs(p - q) > atol + tolerance * F.greatest(F.abs(p), F.abs(q))
        aggs += [F.max(_deviation(p, q)).alias(f"max_{c}"), F.count_if(over).alias(f"breach_{c}")]
    one = F.col("a_standard_error").isNull() != F.col("b_standard_error").isNull()
    out = both.groupBy("segment").agg(*aggs, F.count_if(one & F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("uncovered"))
    verdict = (
        F.when(F.col("common") == 0, "not-comparable")
        .when((F.col("only_a") + F.col("only_b") > 0) | (F.col("breach_ultimate") + F.col("breach_unpaid") + F.col("breach_standard_error") > 0), "disagree")
        .when(F.col("uncovered") > 0, "not-comparable").otherwise("agree")
    )
    return out.withColumn("verdict", verdict)


def crosscheck_stochastic(a: DataFrame, b: DataFrame, sigmas: float = 4.0, exact: float = 1e-9) -> DataFrame:
    """Per origin whether two simulated summaries ``segment, origin, mean, sd, n_sims, seed`` agree within sampling error.

    The bound of the means is sigmas x sqrt(2) x CV / sqrt(n), of the deviations sigmas x sqrt(2) / sqrt(2 n), with the
    smaller n and the larger CV; equal seeds and sizes must agree exactly.
    """
    x = a.select("segment", "origin", *(F.col(c).alias(f"a_{c}") for c in ("mean", "sd", "n_sims", "seed")))
    y = b.select("segment", "origin", *(F.col(c).alias(f"b_{c}") for c in ("mean", "sd", "n_sims", "seed")))
    both = x.join(y, ["segment", "origin"], "full_outer")
    cv = F.greatest(*(F.when(F.col(f"{k}_mean") != 0, F.col(f"{k}_sd") / F.abs(f"{k}_mean")).otherwise(0.0) for k in "ab"))
    n = F.least("a_n_sims", "b_n_sims")
    same = F.coalesce((F.col("a_seed") == F.col("b_seed")) & (F.col("a_n_sims") == F.col("b_n_sims")), F.lit(False))
    out = both.withColumns({
        "mean_deviation": _deviation(F.col("a_mean"), F.col("b_mean")), "sd_deviation": _deviation(F.col("a_sd"), F.col("b_sd")),
        "mean_bound": F.when(same, exact).otherwise(sigmas * F.sqrt(F.lit(2.0)) * cv / F.sqrt(n)), "sd_bound": F.when(same, exact).otherwise(sigmas * F.sqrt(F.lit(2.0)) / F.sqrt(2 * n)),
    })
    ok = (F.col("mean_deviation") <= F.col("mean_bound")) & (F.col("sd_deviation") <= F.col("sd_bound"))
    return out.withColumn("verdict", F.when(F.col("a_mean").isNull() | F.col("b_mean").isNull(), "not-comparable").when(ok, "agree").otherwise("disagree"))


def latest_entries(ledger: DataFrame) -> DataFrame:
    """The last entry of each field of an analysis."""
    last = F.max_by(F.struct("value", "actor", "rationale"), "seq")
    return ledger.groupBy("analysis_id", "field").agg(last.alias("e")).select("analysis_id", "field", "e.*")


def changed_assumptions(prior: DataFrame, current: DataFrame) -> DataFrame:
    """``analysis_id, field, change, prior_value, current_value``: fields added, removed or changed (values are JSON)."""
    x = latest_entries(prior).select("analysis_id", "field", F.col("value").alias("prior_value"), F.lit(True).alias("_p"))
    y = latest_entries(current).select("analysis_id", "field", F.col("value").alias("current_value"), F.lit(True).alias("_c"))
    change = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "removed").when(~F.col("prior_value").eqNullSafe(F.col("current_value")), "changed")
    return x.join(y, ["analysis_id", "field"], "full_outer").withColumn("change", change).filter("change is not null").select("analysis_id", "field", "change", "prior_value", "current_value")


def judgments(ledger: DataFrame) -> DataFrame:
    """Entries that someone made: the actor is not ``default``."""
    return ledger.filter(F.col("actor") != "default")


def ledger_errors(ledger: DataFrame) -> DataFrame:
    """Judgments without a rationale, and numbers that don't run 1, 2, 3, ... within an analysis."""
    own = Window.partitionBy("analysis_id").orderBy("seq")
    code = F.when((F.col("actor") != "default") & (F.trim(F.coalesce("rationale", F.lit(""))) == ""), "NO_RATIONALE").when(F.col("seq") != F.col("_n"), "BAD_SEQUENCE")
    return ledger.withColumn("_n", F.row_number().over(own)).withColumn("code", code).filter("code is not null").select("analysis_id", "seq", "field", "code")


def appended(ledger: DataFrame | None, entries: DataFrame, order: str = "recorded_at") -> tuple[DataFrame, DataFrame]:
    """(``entries`` with ``seq``, errors): ``seq`` continues each analysis' numbers without a gap.

    Entries have ``analysis_id, field, actor, rationale``, ``order`` and more. One that someone made without saying why is
    refused (``analysis_id, field, code``), and the others go on.

    Within an analysis entries are numbered by ``order``, ties by field and then by the whole entry. Entries that the ledger has
    already, all columns alike, are left out, so that a batch sent twice, whole or in part, is appended once; of entries
    alike within a batch one is. Numbers run over range buckets: an analysis may have any number of entries.
    """
    names = [c for c in entries.columns if c != "seq"]
    silent = (F.coalesce("actor", F.lit("")) != "default") & (F.trim(F.coalesce("rationale", F.lit(""))) == "")
    errors = entries.filter(silent).select("analysis_id", "field", F.lit("MISSING_RATIONALE").alias("code"))
    new = entries.filter(~silent).select(*names).distinct()
    if ledger is not None:
        same = F.lit(True)
        for c in names:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        new = new.join(ledger.select(*(F.col(c).alias(f"_{c}") for c in names)), same, "left_anti")
    by = [order, "field", *(c for c in names if c not in (order, "field", "analysis_id"))]
    dealt = in_buckets(new, ["analysis_id"], by)
    counts = dealt.groupBy("analysis_id", "bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("analysis_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("analysis_id").alias("_analysis"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("analysis_id", "bucket").orderBy(*by)
    out = dealt.withColumn("_place", F.row_number().over(own)).join(starts, F.col("analysis_id").eqNullSafe(F.col("_analysis")) & (F.col("bucket") == F.col("_bucket")))
    if ledger is None:
        out = out.withColumn("_last", F.lit(0).cast("long"))
    else:
        last = ledger.groupBy(F.col("analysis_id").alias("_of")).agg(F.max("seq").cast("long").alias("_last"))
        out = out.join(last, F.col("analysis_id").eqNullSafe(F.col("_of")), "left")
    return out.select(*names, (F.coalesce("_last", F.lit(0)) + F.col("_before") + F.col("_place")).alias("seq")), errors


def result_table(results: dict[str, DataFrame]) -> DataFrame:
    """``method, segment, origin, ultimate, unpaid, standard_error`` of several methods' rows; what one lacks is null."""
    out = None
    for method, rows in results.items():
        names = [c for c in ("segment", "origin", "ultimate", "unpaid", "standard_error") if c in rows.columns]
        part = rows.select(F.lit(method).alias("method"), *names)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
