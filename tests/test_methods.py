import math

import pytest
from pyspark.sql import functions as F

from lossworks.jobs import adjust, apriori, cashflow, chainladder, compare, diagnostics, large_losses, levels, stochastic, variance
from lossworks.operators import factors, triangles
from tests.published import RAA, TAYLOR_ASHE, cells


def test_chain_ladder_published(spark):
    both = cells(spark, TAYLOR_ASHE, RAA)
    rows = chainladder.chain_ladder(both, chainladder.selected(both))
    total = {r["segment"]: r for r in chainladder.totals(rows, "ultimate", "unpaid").filter("origin is null").collect()}
    assert total["s0"]["ultimate"] == pytest.approx(53038945.611924306, rel=1e-9)
    assert total["s0"]["unpaid"] == pytest.approx(18680855.611924313, rel=1e-9)
    assert total["s1"]["ultimate"] == pytest.approx(213122.228, rel=1e-7)
    assert total["s1"]["unpaid"] == pytest.approx(52135.228, rel=1e-7)


def test_mack_published_and_row_order(spark):
    both = cells(spark, TAYLOR_ASHE, RAA)
    total = {r["segment"]: r["standard_error"] for r in variance.mack(both)[1].collect()}
    assert total["s0"] == pytest.approx(2447094.8608346656, rel=1e-6)
    assert total["s1"] == pytest.approx(26909.011, rel=1e-5)
    turned = both.withColumn("origin_idx", 9 - F.col("origin_idx"))
    again = {r["segment"]: r["standard_error"] for r in variance.mack(turned)[1].collect()}
    assert again["s0"] == pytest.approx(total["s0"], rel=1e-9)


def test_residuals_weigh_out(spark):
    tri = cells(spark, TAYLOR_ASHE)
    ratios = factors.link_ratios(tri).select("origin", "from_age", "c0")
    sums = variance.mack_residuals(tri).join(ratios, ["origin", "from_age"]).groupBy("from_age").agg(F.sum(F.col("residual") * F.sqrt("c0")).alias("s")).collect()
    assert all(abs(r["s"] or 0) < 1e-4 for r in sums)


def test_raa_diagnostics(spark):
    tri = cells(spark, RAA)
    c = diagnostics.factor_correlation(tri).first()
    assert c["statistic"] == pytest.approx(0.07, abs=0.005)
    assert c["bound50"] == pytest.approx(0.67 / math.sqrt(28), rel=1e-9)
    z = diagnostics.calendar_year_test(tri).first()
    assert z["z"] == 14
    assert z["expected_z"] == pytest.approx(12.875, abs=1e-9)
    assert z["variance_z"] == pytest.approx(3.9785, abs=1e-3)
    assert not z["significant"]


def test_bornhuetter_ferguson_hand_computed(spark):
    tri = cells(spark, [[100, 150], [120, None]], first=22)
    cl = chainladder.chain_ladder(tri, chainladder.selected(tri))
    premium = spark.createDataFrame([("s0", "2022", 200.0), ("s0", "2023", 200.0)], "segment string, origin string, earned_premium double")
    bf = {r["origin"]: r for r in apriori.bornhuetter_ferguson(cl, premium).collect()}
    assert bf["2022"]["apriori"] == pytest.approx(0.75)
    assert (bf["2022"]["ultimate"], bf["2023"]["ultimate"]) == (pytest.approx(150), pytest.approx(170))
    gb = {r["origin"]: r for r in apriori.benktander(apriori.bornhuetter_ferguson(cl, premium), cl).collect()}
    assert gb["2023"]["ultimate"] == pytest.approx(120 + (1 - 1 / 1.5) * 170)


def test_cape_cod_hand_computed(spark):
    rows = spark.createDataFrame(
        [("s", "2022", 0, 800.0, 1.05, 1500.0, None, None), ("s", "2023", 1, 600.0, 1.25, 1600.0, None, None), ("s", "2024", 2, 300.0, 2.0, 1700.0, None, None)],
        "segment string, origin string, origin_idx int, reported double, cdf double, premium double, loss_adj double, premium_adj double",
    )
    elr = 1700 / (1500 / 1.05 + 1600 / 1.25 + 850)
    assert apriori.cape_cod(rows).first()["elr"] == pytest.approx(elr)
    own = {r["origin"]: r["ultimate"] for r in apriori.cape_cod(rows, decay=0.0).collect()}
    assert own["2024"] == pytest.approx(600)
    with pytest.raises(ValueError, match="BAD_ADJ"):
        apriori.cape_cod(rows, decay=1.5)
    assert apriori.expected_claims(rows, 0.5).first()["ultimate"] == 750


def test_case_outstanding_hand_computed(spark):
    case = cells(spark, [[300, 200, 100, 40], [320, 220, 110, None], [350, 240, None, None], [380, None, None, None]], kind="case", first=22)
    paid = case.withColumn("value", F.when(F.col("value").isNotNull(), 100.0 * (F.col("age_idx") + 1))).withColumn("kind", F.lit("paid"))
    picked = spark.createDataFrame([("s0", 0, 0.7, 0.5), ("s0", 1, 0.5, 0.45), ("s0", 2, 0.4, 0.6)], "segment string, age_idx int, case_ratio double, paid_on_case double")
    out = {r["origin"]: r for r in adjust.case_outstanding(paid, case, picked).collect()}
    assert out["2025"]["future_paid"] == pytest.approx([190, 119.7, 79.8, 53.2])
    assert out["2025"]["unpaid"] == pytest.approx(442.7)


def test_averages_window_ends_at_last_ratio(spark):
    tri = cells(spark, [[100, 200], [100, 150], [100, None], [100, 120], [100, None]])
    found = {r["avg_key"]: r["value"] for r in factors.averages(factors.link_ratios(tri)).collect()}
    assert found["all-str"] == pytest.approx((2 + 1.5 + 1.2) / 3)
    assert found["3-str"] == pytest.approx((1.5 + 1.2) / 2)
    assert found["med-5x1"] == pytest.approx(1.5)
    assert found["geo-all"] == pytest.approx((2 * 1.5 * 1.2) ** (1 / 3))


def test_increments_and_back(spark):
    tri = cells(spark, [[1, None, 5, 7], [2, 4, None, None]])
    back = [r["value"] for r in triangles.incremental(tri).orderBy("origin_idx", "age_idx").collect()]
    assert back == [1, None, None, 2, 2, 2, None, None]
    again = [r["value"] for r in triangles.cumulative(triangles.incremental(tri)).orderBy("origin_idx", "age_idx").collect()]
    assert again == [1, None, None, None, 2, 4, None, None]


def test_shapes_must_match(spark):
    a, b = cells(spark, [[1, 2], [3, None]], [[1, 2]]), cells(spark, [[1, 2], [3, None]], [[1, 2, 3]])
    both, errors = triangles.paired(a, b)
    assert [r["segment"] for r in errors.collect()] == ["s1"]
    assert {r["segment"] for r in both.collect()} == {"s0"}


def test_long_format(spark):
    rows = spark.createDataFrame([("a", "2021", 12, 110.0), ("a", "2020", 24, 180.0), ("a", "2020", 12, 100.0), ("b", "2020", 12, None), ("b", "2020", 12, None)], "segment string, origin string, age int, value double")
    out, errors = triangles.from_long(rows, "paid")
    assert [(r["origin"], r["age"], r["value"]) for r in out.orderBy("origin", "age").collect()] == [("2020", 12, 100.0), ("2020", 24, 180.0), ("2021", 12, 110.0), ("2021", 24, None)]
    assert [(r["segment"], r["code"]) for r in errors.collect()] == [("b", "SHAPE")]


def test_trend_exact(spark):
    points = spark.createDataFrame([("s", y, 1000 * 1.07 ** (y - 2020)) for y in range(2018, 2026)] + [("s", 2017, None)], "segment string, year int, value double")
    out = {r["fit"]: r for r in levels.analyze_trend(points).collect()}
    assert all(out[k]["annual_rate"] == pytest.approx(0.07) and out[k]["r_squared"] == pytest.approx(1) for k in ("all", "last5", "last3", "exhilo"))
    assert out["all"]["excluded"] == 1


def test_on_level_parallelogram(spark):
    origins = spark.createDataFrame([("s", "2024", 2024.0, 2025.0), ("s", "2025", 2025.0, 2026.0)], "segment string, origin string, p0 double, p1 double")
    change = spark.createDataFrame([("s", "2024-07-01", 0.1)], "segment string, d string, change double").select("segment", F.to_date("d").alias("effective_date"), "change")
    x = 182 / 366
    out = {r["origin"]: r["average_level"] for r in levels.on_level(origins, change).collect()}
    assert out["2024"] == pytest.approx(1 + 0.1 * (1 - x) ** 2 / 2)
    assert out["2025"] == pytest.approx(1 + 0.1 * (1 - x**2 / 2))


def test_caps(spark):
    rows = spark.createDataFrame(
        [("s", "A", "2025-01-01", 100e3, 300e3, "open"), ("s", "B", "2025-01-01", 300e3, 0.0, "closed"), ("s", "C", "2025-01-01", 50e3, 100e3, "open")],
        "segment string, claim_id string, accident_date string, paid_to_date double, case_reserve double, status string",
    ).withColumn("accident_date", F.to_date("accident_date"))
    out = {r["claim_id"]: (r["paid_to_date"], r["case_reserve"]) for r in large_losses.cap_claims(rows, 250e3).collect()}
    assert out == {"A": (100e3, 150e3), "B": (250e3, 0.0), "C": (50e3, 100e3)}
    with pytest.raises(ValueError, match="BAD_CAP"):
        large_losses.cap_claims(rows, 0)


def test_survival_ties(spark):
    seen = spark.createDataFrame([("s", v, c) for v, c in ((1.0, False), (2.0, False), (2.0, True), (3.0, False))], "segment string, value double, censored boolean")
    curve = {r["value"]: r["survival"] for r in large_losses.survival(seen).collect()}
    assert curve == {1.0: pytest.approx(0.75), 2.0: pytest.approx(0.5), 3.0: pytest.approx(0.0)}
    q = {r["p"]: r["quantile"] for r in large_losses.survival_quantiles(seen, (0.25, 0.5)).collect()}
    assert q == {0.25: 1.0, 0.5: 2.0}


def test_bootstrap_bands_and_partitioning(spark):
    tri = cells(spark, TAYLOR_ASHE, RAA)
    fit = {r["segment"]: r for r in stochastic.odp_fit(tri).collect()}
    assert fit["s0"]["n"] == 55 and fit["s0"]["p"] == 19
    samples = stochastic.bootstrap(tri.filter("segment = 's0'"), 1000, 12345)
    total = stochastic.summary(samples).filter("origin is null").first()
    assert total["mean"] == pytest.approx(18_688_000, rel=0.12)
    assert total["sd"] == pytest.approx(2_956_000, rel=0.2)
    other = stochastic.summary(stochastic.bootstrap(tri.repartition(7), 1000, 12345)).filter("origin is null and segment = 's0'").first()
    assert other["mean"] == pytest.approx(total["mean"], rel=1e-9)


def test_rounding_of_large_amounts_is_no_residual(spark):
    """The two corners are met by the fit; with large amounts their rounding passes any fixed bound."""
    large = [[[round(v * 1e6 * (1 + s / 7), 2) for v in row] for row in TAYLOR_ASHE] for s in range(8)]
    fit = stochastic.odp_fit(cells(spark, *large)).collect()
    assert [(r["n"], r["pool"]) for r in fit] == [(55, 53)] * 8


def test_counted_draws_scale_with_the_amounts(spark):
    tris = [[[round(v * (1 + s / 7), 2) for v in row] for row in TAYLOR_ASHE] for s in range(8)]

    def means(factor: float) -> dict:
        rows = cells(spark, *([[v * factor for v in row] for row in tri] for tri in tris))
        drawn = stochastic.bootstrap(rows, 100, 7, process_variance=False, counted=True)
        return {(r["segment"], r["origin"]): r["m"] / factor for r in drawn.groupBy("segment", "origin").agg(F.avg("unpaid").alias("m")).collect()}

    assert means(1e6) == pytest.approx(means(1.0), rel=1e-9)


def test_cash_flows_add_up(spark):
    tri = cells(spark, [[100, 160, 200], [120, 192, None], [150, None, None]], first=23)
    picked = chainladder.selected(tri)
    flows = cashflow.payout_pattern(chainladder.chain_ladder(tri, picked), tri, picked)
    by = {}
    for r in flows.orderBy("from_months").collect():
        by.setdefault(r["origin"], []).append(round(r["amount"], 6))
    assert {k: v for k, v in by.items() if any(v)} == {"2024": [48.0], "2025": [90.0, 60.0]}
    out = cashflow.discount(flows, 0.0, "end", "test").filter("origin is null").first()
    assert out["nominal"] == pytest.approx(out["discounted"])
    with pytest.raises(ValueError, match="NO_PROVENANCE"):
        cashflow.discount(flows, 0.0)


def test_actual_expected(spark):
    rows = spark.createDataFrame([("s", "2024", 1000.0, 480.0, 700.0, 0.5, 0.7)], "segment string, origin string, prior_ultimate double, prior_latest double, current_latest double, pct_prior double, pct_current double")
    out = cashflow.actual_expected(rows).filter("origin = '2024'").first()
    assert (out["expected"], out["actual"], out["ratio"]) == (pytest.approx(200), pytest.approx(220), pytest.approx(1.1))


def test_changed_assumptions(spark):
    schema = "analysis_id string, seq int, actor string, field string, value string, rationale string"
    a = spark.createDataFrame([("x", 1, "default", "tail", "1", None), ("x", 2, "actuary", "tail", "1.05", "r"), ("x", 3, "default", "old", "1", None)], schema)
    b = spark.createDataFrame([("x", 1, "agent", "tail", "1.1", " "), ("x", 3, "default", "new", "2", None)], schema)
    assert {(r["field"], r["change"]) for r in compare.changed_assumptions(a, b).collect()} == {("tail", "changed"), ("old", "removed"), ("new", "added")}
    assert {(r["seq"], r["code"]) for r in compare.ledger_errors(b).collect()} == {(1, "NO_RATIONALE"), (3, "BAD_SEQUENCE")}


def test_crosscheck_verdicts(spark):
    schema = "segment string, origin string, ultimate double, unpaid double, standard_error double"
    a = spark.createDataFrame([("ok", "1", 100.0, 10.0, 5.0), ("off", "1", 100.0, 10.0, 5.0), ("se", "1", 100.0, 10.0, 5.0), ("gone", "1", 1.0, 1.0, 1.0)], schema)
    b = spark.createDataFrame([("ok", "1", 100.00001, 10.0, 5.01), ("off", "1", 101.0, 10.0, 5.0), ("se", "1", 100.0, 10.0, None), ("gone", "2", 1.0, 1.0, 1.0)], schema)
    out = {r["segment"]: r["verdict"] for r in compare.crosscheck(a, b).collect()}
    assert out == {"ok": "agree", "off": "disagree", "se": "not-comparable", "gone": "not-comparable"}
