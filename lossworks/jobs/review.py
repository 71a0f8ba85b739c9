"""Data-quality review of claim snapshots and of triangle pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.operators.triangles import ROW, paired

#: Checks in their fixed order, with the status that findings give.
CLAIM_CHECKS = (
    ("non-finite-value", "fail"),
    ("negative-paid", "fail"),
    ("negative-case", "warning"),
    ("paid-decreasing", "fail"),
    ("date-order", "fail"),
    ("duplicate-snapshot", "fail"),
    ("future-dated", "fail"),
    ("closed-with-case", "warning"),
)
TRIANGLE_CHECKS = (
    ("non-finite-value", "fail"),
    ("shape-mismatch", "fail"),
    ("paid-exceeds-incurred", "fail"),
    ("negative-incremental-paid", "warning"),
    ("negative-incremental-incurred", "warning"),
    ("interior-missing", "warning"),
)
SHOWN = 20


def claim_findings(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """``segment, check_id, claim_id, evaluation_date, seq, detail``: a row per finding, from one shuffle by claim."""
    by_date = Window.partitionBy("segment", "claim_id").orderBy("evaluation_date", "seq")
    same = Window.partitionBy("segment", "claim_id", "evaluation_date").orderBy("seq")
    rows = snapshots.withColumns({
        "_paid": F.lag("paid_to_date").over(by_date), "_date": F.lag("evaluation_date").over(by_date), "_nth": F.row_number().over(same),
        "_p": finite("paid_to_date"), "_c": finite("case_reserve"),
    })
    late = F.lit(as_of).cast("date")
    tests: list[tuple[str, Column, str]] = [
        ("non-finite-value", F.col("_p").isNull(), "paid_to_date is not a finite number"),
        ("non-finite-value", F.col("_c").isNull(), "case_reserve is not a finite number"),
        ("negative-paid", F.col("_p") < 0, "paid_to_date is negative"),
        ("negative-case", F.col("_c") < 0, "case_reserve is negative"),
        ("paid-decreasing", (F.col("_date") != F.col("evaluation_date")) & (F.col("_p") < finite("_paid")), "paid_to_date fell since the last evaluation"),
        ("date-order", F.col("report_date") < F.col("accident_date"), "report_date precedes accident_date"),
        ("date-order", F.col("evaluation_date") < F.col("report_date"), "evaluation_date precedes report_date"),
        ("duplicate-snapshot", F.col("_nth") > 1, "another snapshot of this date"),
        ("closed-with-case", (F.col("status") == "closed") & (F.col("_c") > 0), "case_reserve on a closed claim"),
    ]
    if as_of is not None:
        tests += [("future-dated", F.col(c) > late, f"{c} exceeds the as-of date") for c in ("accident_date", "report_date", "evaluation_date")]
    found = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(check).alias("check_id"), F.lit(said).alias("detail"))) for check, test, said in tests)))
    return rows.select("segment", "claim_id", "evaluation_date", "seq", F.explode(found).alias("f")).select("segment", "f.check_id", "claim_id", "evaluation_date", "seq", "f.detail")


def _summary(segments: DataFrame, findings: DataFrame, checks, not_evaluated: Column) -> DataFrame:
    """Every check of every segment with its status and count, clean ones too."""
    menu = F.explode(F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("check_id"), F.lit(s).alias("bad")) for k, (c, s) in enumerate(checks))))
    counts = findings.groupBy("segment", "check_id").agg(F.count("*").alias("n"))
    out = segments.select("segment", menu.alias("m")).select("segment", "m.*").join(counts, ["segment", "check_id"], "left")
    status = F.when(not_evaluated, "not-evaluated").when(F.col("n") > 0, F.col("bad")).otherwise("pass")
    return out.select("segment", "place", "check_id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n_findings"))


def review_claims(snapshots: DataFrame, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(checks, findings). Without an as-of date ``future-dated`` is not evaluated."""
    findings = claim_findings(snapshots, as_of)
    return _summary(snapshots.select("segment").distinct(), findings, CLAIM_CHECKS, (F.col("check_id") == "future-dated") & F.lit(as_of is None)), findings


def shown(findings: DataFrame, most: int = SHOWN) -> DataFrame:
    """The first findings of each check, in order of claim, date and input, with how many more there are."""
    counts = findings.groupBy("segment", "check_id").agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    order = Window.partitionBy("segment", "check_id").orderBy("claim_id", "evaluation_date", "seq", "detail")
    # ranked before the shuffle as well: a task holds the first few of each other task, not a check's whole list
    first = findings.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)
    return first.join(counts, ["segment", "check_id"])


def triangle_findings(paid: DataFrame, incurred: DataFrame) -> DataFrame:
    """``segment, check_id, origin, age, detail``; a segment whose shapes differ has no cell findings but non-finite ones."""
    both, errors = paired(paid, incurred)
    odd = lambda cells, kind: cells.filter(F.col("value").isNotNull() & finite("value").isNull()).select("segment", F.lit("non-finite-value").alias("check_id"), "origin", "age", F.lit(kind).alias("detail"))
    shape = errors.select("segment", F.lit("shape-mismatch").alias("check_id"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("age"), F.col("message").alias("detail"))
    slack = 1e-9 * F.greatest(F.lit(1.0), F.abs("a"), F.abs("b"))
    over = both.filter(F.col("a") - F.col("b") > slack).select("segment", F.lit("paid-exceeds-incurred").alias("check_id"), "origin", "age", F.lit("paid exceeds incurred").alias("detail"))
    same = both.select("segment").distinct()
    row = Window.partitionBy(*ROW).orderBy("age_idx")
    whole = Window.partitionBy(*ROW)

    def within(cells: DataFrame, kind: str) -> DataFrame:
        seen = cells.join(same, "segment", "left_semi").withColumns({
            "_before": F.last("value", ignorenulls=True).over(row.rowsBetween(Window.unboundedPreceding, -1)),
            "_first": F.min(F.when(F.col("value").isNotNull(), F.col("age_idx"))).over(whole), "_last": F.max(F.when(F.col("value").isNotNull(), F.col("age_idx"))).over(whole),
        })
        fell = seen.filter(F.col("value") < F.col("_before")).select("segment", F.lit(f"negative-incremental-{kind}").alias("check_id"), "origin", "age", F.lit("lower than before").alias("detail"))
        gap = seen.filter(F.col("value").isNull() & F.col("age_idx").between(F.col("_first"), F.col("_last"))).select("segment", F.lit("interior-missing").alias("check_id"), "origin", "age", F.lit(kind).alias("detail"))
        return fell.unionByName(gap)

    out = odd(paid, "paid").unionByName(odd(incurred, "incurred")).unionByName(shape).unionByName(over)
    return out.unionByName(within(paid, "paid")).unionByName(within(incurred, "incurred"))


def review_triangles(paid: DataFrame, incurred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(checks, findings) of a triangle pair per segment."""
    findings = triangle_findings(paid, incurred)
    bad = paired(paid, incurred)[1].select("segment", F.lit(True).alias("_bad")).distinct()
    segments = paid.select("segment").union(incurred.select("segment")).distinct()
    blocked = F.col("place") > 1
    checks = _summary(segments, findings, TRIANGLE_CHECKS, F.lit(False)).join(bad, "segment", "left")
    return checks.withColumn("status", F.when(F.coalesce("_bad", F.lit(False)) & blocked, "not-evaluated").otherwise(F.col("status"))).drop("_bad"), findings
