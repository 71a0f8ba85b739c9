import numpy as np
import pytest
from pyspark.sql import functions as F

from lossworks.jobs import adjust, growth, munich, severity, variance
from tests.published import cells

# A published pair of triangles.
PAID = [[576, 1804, 1970, 2024, 2074, 2102, 2131], [866, 1948, 2162, 2232, 2284, 2348], [1412, 3758, 4252, 4416, 4494], [2286, 5292, 5724, 5850], [1868, 3778, 4648], [1442, 4010], [2044]]
INCURRED = [[978, 2104, 2134, 2144, 2174, 2182, 2174], [1844, 2552, 2466, 2480, 2508, 2454], [2904, 4354, 4698, 4600, 4644], [3502, 5958, 6070, 6142], [2812, 4882, 4852], [2642, 4406], [5022]]


def test_munich_published(spark):
    paid, incurred = cells(spark, PAID), cells(spark, INCURRED, kind="incurred")
    c = munich.correlations(munich._one(paid, "paid"), munich._one(incurred, "incurred")).first()
    assert (c["lambda_p"], c["lambda_i"]) == (pytest.approx(0.64, abs=0.005), pytest.approx(0.44, abs=0.005))
    rows = munich.munich_chain_ladder(paid, incurred, (0.1, 0.1)).orderBy("origin_idx").collect()
    assert len(rows) == 7 and rows[0]["paid_ultimate"] == 2131 and rows[0]["incurred_ultimate"] == 2174
    gap = [abs(r["paid_ultimate"] / r["incurred_ultimate"] - 1) for r in rows]
    apart = [abs(r["scl_paid"] / r["scl_incurred"] - 1) for r in rows]
    assert sum(gap[1:]) < sum(apart[1:]) / 3
    assert rows[6]["scl_paid"] == pytest.approx(variance.mack(paid)[0].filter("origin_idx = 6").first()["ultimate"])


def test_fisher_lange_hand_computed(spark):
    closed = cells(spark, [[50, 80, 100], [50, 80, None], [50, None, None]], kind="closed")
    paid = closed.withColumn("value", F.col("value") * 10).withColumn("kind", F.lit("paid"))
    ultimate = closed.select("segment", "origin", F.lit(100.0).alias("ultimate_counts")).distinct()
    out = {r["origin_idx"]: r["unpaid"] for r in adjust.fisher_lange(paid, closed, ultimate, 0.0).collect()}
    assert out == {0: pytest.approx(0), 1: pytest.approx(200), 2: pytest.approx(500)}


def test_case_adequacy_hand_computed(spark):
    rows = [("s", "2020", 0, 12, 0, 50.0, 100.0, 5.0), ("s", "2020", 0, 24, 1, 80.0, 120.0, 2.0), ("s", "2021", 1, 12, 0, 60.0, 130.0, 7.0), ("s", "2021", 1, 24, 1, None, None, None)]
    tri = spark.createDataFrame(rows, "segment string, origin string, origin_idx int, age int, age_idx int, paid double, incurred double, open_count double")
    out = {(r["origin_idx"], r["age_idx"]): r["value"] for r in adjust.case_adequacy(tri, 0.1)[0].collect()}
    assert out == {(0, 0): pytest.approx(50 + 10 / 1.1 * 5), (0, 1): pytest.approx(120), (1, 0): pytest.approx(130), (1, 1): None}


def test_severity_fit_recovers_the_parameters(spark):
    rng = np.random.default_rng(4)
    logn, par = np.exp(rng.normal(9, 1.2, 4000)), 20000 * (rng.random(4000) ** (-1 / 2.5) - 1)
    limit = rng.exponential(60000, 4000)
    rows = [("l", float(min(v, m)), bool(v > m)) for v, m in zip(logn, limit, strict=True)] + [("p", float(min(v, m)), bool(v > m)) for v, m in zip(par, limit, strict=True)] + [("few", 1.0, False), ("l", -1.0, False), ("none", 0.0, True)]
    df = spark.createDataFrame(rows, "segment string, value double, censored boolean")
    fit = {r["segment"]: r for r in severity.fit_severity(df, "lognormal").collect()}
    assert (fit["l"]["p1"], fit["l"]["p2"]) == (pytest.approx(9, abs=0.1), pytest.approx(1.2, abs=0.1)) and fit["l"]["valid"] and fit["l"]["n_excluded"] == 1
    assert not fit["few"]["valid"] and not fit["none"]["valid"]
    fit = {r["segment"]: r for r in severity.fit_severity(df, "pareto").collect()}
    assert (fit["p"]["p1"], fit["p"]["p2"]) == (pytest.approx(20000, rel=0.25), pytest.approx(2.5, rel=0.2))


def test_severity_fits_of_both_kinds_read_the_claims_once(spark):
    rows = [(s, float(np.exp(8 + 1.1 * (((k * 37) % 101) / 50.5 - 1)) * (1 + k / 300) ** 2) if k else -1.0, k % 6 == 0) for s in "ab" for k in range(300)]
    df = spark.createDataFrame(rows, "segment string, value double, censored boolean")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    key = lambda r: (r["segment"], r["kind"])
    both = {key(r): r for r in severity.fit_severities(df.mapInArrow(seen, df.schema), ("lognormal", "pareto")).collect()}
    assert read.value == len(rows) and len(both) == 4
    for kind in ("lognormal", "pareto"):
        for r in severity.fit_severity(df, kind).collect():
            assert both[key(r)]["log_likelihood"] == pytest.approx(r["log_likelihood"], rel=1e-9) and both[key(r)]["n_excluded"] == 1
            assert (both[key(r)]["n_exact"], both[key(r)]["n_censored"], r["valid"]) == (250, 49, True)


def test_severity_fit_has_no_most_values(spark):
    """Over two million distinct values in a segment, spread over the quantiles of each distribution."""
    n = 2_100_000
    u = (F.col("id") + 0.5) / n
    df = spark.range(n).select(F.lit("s").alias("segment"), (20000 * (F.pow(1 - u, F.lit(-1 / 2.5)) - 1)).alias("value"), F.lit(False).alias("censored"))
    [fit] = severity.fit_severity(df, "pareto").collect()
    assert fit["valid"] and fit["n_exact"] == n and (fit["p1"], fit["p2"]) == (pytest.approx(20000, rel=0.01), pytest.approx(2.5, rel=0.01))
    [fit] = severity.fit_severity(df, "lognormal").collect()
    assert fit["valid"] and fit["n_exact"] == n


def test_limited_expected_values(spark):
    rng = np.random.default_rng(5)
    draws = {"lognormal": np.exp(rng.normal(8, 1, 400_000)), "pareto": 5000 * (rng.random(400_000) ** (-1 / 3) - 1)}
    df = spark.createDataFrame([("lognormal", 8.0, 1.0), ("pareto", 5000.0, 3.0)], "kind string, p1 double, p2 double")
    lev = severity.limited_expected_value(F.col("kind"), F.col("p1"), F.col("p2"), F.lit(4000.0))
    for r in df.select("kind", lev.alias("v"), severity.severity_mean(F.col("kind"), F.col("p1"), F.col("p2")).alias("m")).collect():
        assert r["v"] == pytest.approx(np.minimum(draws[r["kind"]], 4000).mean(), rel=0.01)
        assert r["m"] == pytest.approx(draws[r["kind"]].mean(), rel=0.02)


def test_increased_limits(spark):
    table = spark.createDataFrame([("s", 100.0, 1.0), ("s", 400.0, 2.0), ("s", 1000.0, 2.5), ("bad", 1.0, 2.0), ("bad", 2.0, 1.0)], "segment string, limit double, factor double")
    asked = spark.createDataFrame([("s", 200.0), ("s", 400.0), ("s", 1000.0), ("s", 1001.0), ("bad", 1.5)], "segment string, limit double")
    out = {(r["segment"], r["limit"]): r["factor"] for r in severity.interpolated_ilf(table, asked).collect()}
    assert out[("s", 200.0)] == pytest.approx(2**0.5) and out[("s", 400.0)] == pytest.approx(2) and out[("s", 1000.0)] == pytest.approx(2.5)
    assert out[("s", 1001.0)] is None and out[("bad", 1.5)] is None


def test_growth_curves_published(spark):
    from lossworks.jobs.growth import growth_curve
    from tests.published import TAYLOR_ASHE

    tri = [list(r) for r in TAYLOR_ASHE]
    tri[0][3] = 2182708
    both = cells(spark, tri, [[1, 2], [3, None]], first=-9).withColumn("origin", (F.col("origin_idx") + 1991).cast("string"))
    out = growth_curve(both).collect()
    total = next(r for r in out if r["segment"] == "s0" and r["origin"] is None)
    assert total["omega"] == pytest.approx(1.434294, abs=2e-4) and total["theta"] == pytest.approx(48.6249, abs=0.01)
    assert total["sigma2"] == pytest.approx(65029, rel=1e-3) and total["reserve"] == pytest.approx(35_640_618, rel=1e-3)
    assert [r["valid"] for r in out if r["segment"] == "s1"] == [False]
    cut = next(r for r in growth_curve(both, truncation=240).collect() if r["segment"] == "s0" and r["origin"] is None)
    assert cut["reserve"] == pytest.approx(28_987_633, rel=1e-3) and cut["total_sd"] == pytest.approx(4_885_707, rel=5e-3)
    weibull = next(r for r in growth_curve(both, "weibull").collect() if r["segment"] == "s0" and r["origin"] is None)
    assert (weibull["omega"], weibull["theta"], weibull["reserve"]) == (pytest.approx(1.296906, abs=1e-3), pytest.approx(48.88453, abs=0.02), pytest.approx(21_214_761, rel=1e-3))
    premium = both.select("segment", "origin", (10_000_000.0 + 400_000.0 * F.col("origin_idx")).alias("earned_premium")).distinct()
    cc = next(r for r in growth_curve(both, truncation=240, exposures=premium).collect() if r["segment"] == "s0" and r["origin"] is None)
    assert (cc["omega"], cc["theta"]) == (pytest.approx(1.447634, abs=1e-3), pytest.approx(48.0205, abs=0.02))
    assert cc["elr"] == pytest.approx(0.5978, abs=1e-4) and cc["reserve"] == pytest.approx(29_707_484, rel=1e-3)


def test_settlement_branches(spark):
    closed = cells(spark, [[50, 80, 100], [40, 90, None], [60, None, None]], kind="closed")
    paid = cells(spark, [[500, 900, 1200], [300, 1000, None], [700, None, None]])
    ultimate = closed.select("segment", "origin", F.lit(100.0).alias("ultimate_counts")).distinct()
    out = {(r["origin_idx"], r["age_idx"]): r["value"] for r in adjust.settlement(paid, closed, ultimate, exponential=False).collect()}
    assert out[(0, 0)] == pytest.approx(500 + 400 * 10 / 30) and out[(0, 1)] == pytest.approx(900 + 300 * 10 / 20) and out[(0, 2)] == 1200
    assert out[(1, 0)] == pytest.approx(300 + 700 * 20 / 50) and out[(1, 1)] == 1000 and out[(1, 2)] is None
    curve = {(r["origin_idx"], r["age_idx"]): r["value"] for r in adjust.settlement(paid, closed, ultimate).collect()}
    assert curve[(0, 0)] == pytest.approx(500 * (900 / 500) ** (10 / 30))


def test_growth_curves_as_columns(spark):
    rows = [(float(x), 1.4, 30.0) for x in (-3, 0, 0.5, 6, 18, 240)] + [(None, 1.4, 30.0)]
    df = spark.createDataFrame(rows, "x double, omega double, theta double")
    for curve, f in growth.CURVES.items():
        got = [r["g"] for r in df.select(growth.growth_share(curve, F.col("x"), F.col("omega"), F.col("theta")).alias("g")).collect()]
        assert got[:-1] == pytest.approx([float(f(np.array(x), 1.4, 30.0)) for x, *_ in rows[:-1]], abs=1e-14) and got[-1] is None
    ages = [r["a"] for r in df.select(growth.average_age_of(F.col("x")).alias("a")).collect()]
    assert ages[:-1] == [float(growth.average_age(np.array(x))) for x, *_ in rows[:-1]]
    with pytest.raises(ValueError, match="BAD_CURVE"):
        growth.growth_share("straight", F.col("x"), F.col("omega"), F.col("theta"))


def test_fits_are_stationary(spark):
    """Cells of a curve with some noise: at the fit the likelihood has no slope, elsewhere it has."""
    cells = []
    for o in range(6):
        for k in range(6 - o):
            t = 12 * (k + 1)
            share = 1 / (1 + (25 / growth.average_age(t)) ** 1.6)
            cells.append(("s", f"20{10 + o}", o, t, 1000.0 * (1 + 0.1 * o) * float(share) * (1 + 0.02 * ((o * 7 + k * 3) % 5 - 2))))
    df = spark.createDataFrame(cells, "segment string, origin string, origin_idx int, age int, value double")
    fits = growth.growth_curve(df).cache()
    r = growth.first_order(df, fits).first()
    assert r["n"] == 21 and abs(r["slope_omega"]) < 1e-3 and abs(r["slope_theta"]) < 1e-3
    moved = fits.withColumn("theta", F.col("theta") * 1.2)
    assert abs(growth.first_order(df, moved).first()["slope_theta"]) > 0.01


def test_neighbours_of_a_fit_are_less_likely(spark):
    import math

    rows = [("s", math.exp(8 + 1.1 * (((k * 37) % 101) / 50.5 - 1)), k % 6 == 0) for k in range(300)]
    seen = spark.createDataFrame(rows, "segment string, value double, censored boolean")
    for kind in ("lognormal", "pareto"):
        fits = severity.fit_severity(seen, kind).cache()
        r = severity.around_optimum(seen, fits).first()
        assert (r["n_exact"], r["n_censored"]) == (250, 50) and r["log_likelihood"] == pytest.approx(fits.first()["log_likelihood"], rel=1e-9)
        if fits.first()["p1"] < 1e8:  # a Pareto of ever thinner tail has its optimum at infinity
            assert r["log_likelihood"] > r["best_neighbour"]
        moved = severity.around_optimum(seen, fits.withColumn("p1", F.col("p1") * 1.05)).first()
        assert moved["log_likelihood"] < moved["best_neighbour"]
