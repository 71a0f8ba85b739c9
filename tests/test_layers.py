"""Quantiles of fitted sizes, and layers by tables and curves."""

import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from lossworks.jobs import layers, severity

# By hand: a table of three limits.
TABLE = [("s", 100_000.0, 1.0), ("s", 250_000.0, 1.35), ("s", 1_000_000.0, 1.9)]
LAYER = "segment string, cap double, target double"


def test_normal_quantiles(spark):
    ps = [1e-300, 1e-12, 0.001, 0.02424, 0.02425, 0.02426, 0.3, 0.5, 0.7, 0.97574, 0.97576, 0.999, 1 - 1e-12]
    rows = spark.createDataFrame([(p,) for p in (*ps, 0.0, 1.0, -1.0, None)], "p double").select("p", severity.normal_quantile(F.col("p")).alias("z")).collect()
    for r in rows:
        if r["p"] is None or not 0 < r["p"] < 1:
            assert r["z"] is None
        else:
            assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=2e-9, abs=2e-9)


def test_quantiles_of_both_kinds(spark):
    rows = spark.createDataFrame([("lognormal", 9.2, 1.4, 0.9), ("pareto", 40_000.0, 1.8, 0.9), ("pareto", 40_000.0, 1.8, 0.0), ("lognormal", None, 1.4, 0.5)], "kind string, p1 double, p2 double, p double")
    got = [r["q"] for r in rows.select(severity.severity_quantile(F.col("kind"), F.col("p1"), F.col("p2"), F.col("p")).alias("q")).collect()]
    assert got[0] == pytest.approx(math.exp(9.2 + 1.4 * NormalDist().inv_cdf(0.9)), rel=1e-8)
    assert got[1] == pytest.approx(40_000 * (0.1 ** (-1 / 1.8) - 1), rel=1e-12) and got[2] is None and got[3] is None
    assert 1 - (40_000 / (40_000 + got[1])) ** 1.8 == pytest.approx(0.9)


def test_fits_beside_observed_quantiles(spark):
    """Exact quantiles of a lognormal as claims, a fifth of them open: the fit returns them, and what is observed is near."""
    n = 500
    sizes = [(("s", math.exp(8 + 1.5 * NormalDist().inv_cdf((k + 0.5) / n)), k % 5 == 0)) for k in range(n)] + [("t", 5.0, True), ("t", -1.0, False), ("t", None, False)]
    seen = spark.createDataFrame(sizes, "segment string, value double, censored boolean")
    fits = severity.closed_form_fits(seen)
    got = {(r["segment"], r["kind"]): r for r in fits.collect()}
    assert got["s", "lognormal"]["p1"] == pytest.approx(8, abs=1e-9) and got["s", "lognormal"]["p2"] == pytest.approx(1.5, rel=0.01) and got["s", "pareto"]["p2"] > 2
    assert got["t", "pareto"]["p1"] is None
    check = {(r["segment"], r["kind"], r["p"]): r for r in severity.quantile_check(seen, fits).collect()}
    assert len(check) == 4 * len(severity.PROBES)
    for p in severity.PROBES:
        r = check["s", "lognormal", p]
        assert r["fitted"] == pytest.approx(math.exp(8 + got["s", "lognormal"]["p2"] * NormalDist().inv_cdf(p)), rel=1e-8) and r["empirical"] > 0
        assert check["t", "pareto", p]["fitted"] is None


def test_layers_by_a_table(spark):
    asked = [("s", 250_000.0, 1_000_000.0), ("s", 100_000.0, 100_000.0), ("s", 150_000.0, 500_000.0), ("s", 250_000.0, 100_000.0), ("s", 50_000.0, 250_000.0), ("s", 250_000.0, 2_000_000.0), ("s", None, 1.0), ("none", 1.0, 2.0), ("falls", 1.0, 2.0), ("twice", 1.0, 2.0), ("one", 1.0, 1.0), ("zero", 1.0, 2.0), (None, 1.0, 2.0)]
    tables = [*TABLE, ("falls", 1.0, 1.2), ("falls", 2.0, 1.0), ("twice", 1.0, 1.0), ("twice", 1.0, 1.0), ("one", 1.0, 1.0), ("zero", 0.0, 1.0), ("zero", 2.0, 1.0), (None, 1.0, 1.0), (None, 2.0, 1.5)]
    got = layers.table_factors(spark.createDataFrame(tables, "segment string, limit double, factor double"), spark.createDataFrame(asked, LAYER)).collect()
    found = {(r["segment"], r["cap"], r["target"]): r for r in got}
    assert len(found) == len(asked)
    assert found["s", 250_000.0, 1_000_000.0]["factor"] == pytest.approx(1.9 / 1.35, abs=1e-12) and found["s", 100_000.0, 100_000.0]["factor"] == 1.0
    at = lambda x, a, b, f, g: math.exp(math.log(f) + math.log(x / a) / math.log(b / a) * math.log(g / f))
    assert found["s", 150_000.0, 500_000.0]["factor"] == pytest.approx(at(5e5, 2.5e5, 1e6, 1.35, 1.9) / at(1.5e5, 1e5, 2.5e5, 1.0, 1.35), abs=1e-12)
    assert found[None, 1.0, 2.0]["factor"] == 1.5
    codes = {k: r["code"] for k, r in found.items() if r["code"]}
    assert codes == {
        ("s", 250_000.0, 100_000.0): "BAD_LIMIT", ("s", None, 1.0): "BAD_LIMIT", ("s", 50_000.0, 250_000.0): "TABLE_RANGE", ("s", 250_000.0, 2_000_000.0): "TABLE_RANGE",
        ("none", 1.0, 2.0): "BAD_TABLE", ("falls", 1.0, 2.0): "BAD_TABLE", ("twice", 1.0, 2.0): "BAD_TABLE", ("one", 1.0, 1.0): "BAD_TABLE", ("zero", 1.0, 2.0): "BAD_TABLE",
    }
    assert found["falls", 1.0, 2.0]["message"] == "factors must not fall as limits grow" and all(r["factor"] is None for r in found.values() if r["code"])


def test_layers_by_curves(spark):
    asked = spark.createDataFrame([("s", 250_000.0, None), ("s", 250_000.0, 1_000_000.0), ("s", 250_000.0, 100_000.0), ("s", 0.0, 1.0)], LAYER)
    got = {(r["cap"], r["target"], r["curve"]): r for r in layers.curve_factors(asked).collect()}
    assert len(got) == 12
    for curve, *_ in layers.ILLUSTRATIVE:
        assert got[250_000.0, None, curve]["factor"] > got[250_000.0, 1_000_000.0, curve]["factor"] > 1
        assert got[250_000.0, 100_000.0, curve]["code"] == "BAD_LIMIT" and got[0.0, 1.0, curve]["code"] == "BAD_LIMIT"
    own = spark.createDataFrame([("endless", "pareto", 10_000.0, 0.9)], "curve string, kind string, p1 double, p2 double")
    found = {r["target"]: r for r in layers.curve_factors(asked.filter("cap > 0"), own).collect()}
    assert found[None]["code"] == "INFINITE_MEAN" and found[None]["factor"] is None and found[1_000_000.0]["factor"] > 1
