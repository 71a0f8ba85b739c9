"""A bad segment among good ones: it has no result, an error says why, and the others' results stay as they are."""

import pytest
from pyspark.sql import functions as F

from lossworks.jobs import apriori, cashflow, errors, stochastic, variance
from lossworks.operators import triangles
from tests.published import RAA, TAYLOR_ASHE, cells


def spoilt(spark):
    """s0 is whole; in the others an age without values, one age, a negative cell, a cell beyond the diagonal, no square."""
    base = cells(spark, RAA)
    value = F.col("value")
    copies = [
        base, base.withColumn("value", F.when(F.col("age_idx") != 4, value)), base.filter("age_idx = 0"), base.withColumn("value", F.when((F.col("origin_idx") == 1) & (F.col("age_idx") == 1), -value).otherwise(value)),
        base.withColumn("value", F.when((F.col("origin_idx") == 9) & (F.col("age_idx") == 9), 1.0).otherwise(value)), base.filter("origin_idx < 7"), base.filter("origin_idx < 2 and age_idx < 2").withColumn("value", F.when(F.col("origin_idx") + F.col("age_idx") < 2, value)),
    ]
    out = None
    for k, part in enumerate(copies):
        part = part.withColumns({"segment": F.lit(f"s{k}"), "value": F.col("value").cast("double")})
        out = part if out is None else out.unionByName(part)
    return out


def codes(df):
    return {r["segment"]: r["code"] for r in df.collect()}


def test_variance_methods(spark):
    tri = spoilt(spark)
    assert codes(errors.mack_errors(tri)) == {"s1": "NO_FACTOR", "s2": "TOO_SMALL"}
    rows, totals = variance.mack(tri)
    assert {r["segment"] for r in totals.collect()} == {"s0", "s3", "s4", "s5", "s6"}
    assert totals.filter("segment = 's0'").first()["standard_error"] == pytest.approx(26909.011, rel=1e-5)
    assert codes(errors.merz_wuthrich_errors(tri)) == {"s1": "SHAPE", "s2": "SHAPE", "s3": "SHAPE", "s4": "SHAPE", "s5": "SHAPE"}
    assert {r["segment"] for r in variance.merz_wuthrich(tri)[1].collect()} == {"s0", "s6"}


def test_odp_methods(spark):
    tri = spoilt(spark)
    assert codes(errors.odp_errors(tri)) == {"s1": "NO_FACTOR", "s2": "TOO_SMALL", "s6": "TOO_SMALL"}
    assert {r["segment"] for r in stochastic.odp_fit(tri).collect()} == {"s0", "s3", "s4", "s5"}
    small = cells(spark, [r[: 3 - i] for i, r in enumerate(TAYLOR_ASHE[:3])])
    assert codes(errors.odp_errors(small, "bootstrap")) == {"s0": "TOO_SMALL"}


def test_pairs(spark):
    whole = cells(spark, RAA, TAYLOR_ASHE)
    other = whole.filter("segment = 's0' or origin_idx > 0")
    assert codes(errors.munich_errors(whole, other)) == {"s1": "SHAPE"} == codes(errors.pair_errors(whole, other, "add"))
    assert {r["segment"] for r in triangles.add(whole, other).select("segment").distinct().collect()} == {"s0"}
    assert errors.pair_errors(whole, other, "add").first()["method"] == "add"


def test_amounts(spark):
    rows = spark.createDataFrame(
        [("a", "2001", 0, 5.0, 1.1, 10.0, None, 1.0), ("b", "2001", 0, 5.0, 0.0, 10.0, 1.0, 1.0), ("c", "2001", 0, 5.0, 1.1, None, 1.0, 1.0), ("d", "2001", 0, -5.0, 1.1, 10.0, 1.0, 1.0), ("e", "2001", 0, 5.0, 1.1, 10.0, -1.0, 1.0)],
        "segment string, origin string, origin_idx int, reported double, cdf double, premium double, loss_adj double, premium_adj double",
    )
    assert codes(errors.cape_cod_errors(rows)) == {"b": "BAD_CDF", "c": "BAD_PREMIUM", "d": "BAD_LOSSES", "e": "BAD_ADJ"}
    assert apriori.cape_cod(rows.filter("segment = 'a'")).first()["pooled_elr"] == pytest.approx(0.55)
    periods = spark.createDataFrame([("a", "1", 1.0, 2.0, 3.0, 4.0), ("b", "1", 1.0, 2.0, 3.0, 4.0), ("b", "2", 1.0, -2.0, 3.0, 4.0), ("c", "1", None, 2.0, 3.0, 4.0)], "segment string, period string, ulae_paid double, paid double, reported_ultimate double, closed_ultimate double")
    assert codes(errors.ulae_errors(periods)) == {"b": "BAD_LOSSES", "c": "BAD_LOSSES"}
    assert {r["segment"] for r in cashflow.ulae_ratios(periods, (0.3, 0.3, 0.4)).collect()} == {"a"}
