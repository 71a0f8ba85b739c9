"""Running totals and ranks over range buckets against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lossworks.functions.order import at_ranks, in_buckets, running
from lossworks.jobs import large_losses


@pytest.fixture(autouse=True)
def many_buckets(spark):
    """Small tables would be put into one bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_over_a_hot_group(spark):
    rng = random.Random(5)
    rows = [(g, v, rng.randint(1, 9)) for g, n in (("hot", 3000), ("b", 7), (None, 3)) for v in rng.sample(range(10_000), n)]
    table = spark.createDataFrame(rows, "g string, v int, n long")
    spread = in_buckets(table.repartition(9), ["g"], ["v"])
    assert spread.filter("g = 'hot'").select("bucket").distinct().count() > 1
    found = {(r["g"], r["v"]): (r["s"], r["p"]) for r in running(spread, ["g"], ["v"], {"s": "n"}, {"p": 1 + F.col("n") / 1e5}).collect()}
    assert len(found) == len(rows)
    for group in ("hot", "b", None):
        s, p = 0, 1.0
        for _, v, n in sorted((r for r in rows if r[0] == group), key=lambda r: r[1]):
            s, p = s + n, p * (1 + n / 1e5)
            assert found[group, v] == (s, pytest.approx(p))


def test_ranks_with_ties_nulls_and_no_rows(spark):
    rng = random.Random(6)
    rows = [("a", float(rng.randint(0, 40))) for _ in range(501)] + [("b", 2.5), ("c", None)] + [(None, x) for x in (3.0, 1.0)]
    table = spark.createDataFrame(rows, "g string, x double")
    shares = {"p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = {r["g"]: tuple(r[k] for k in shares) for r in at_ranks(table, ["g"], "x", shares).collect()}
    values = {g: sorted(x for h, x in rows if h == g and x is not None) for g in ("a", "b", None)}
    assert found == {g: tuple(v[math.ceil(p * len(v)) - 1] for p in shares.values()) for g, v in values.items()}
    assert at_ranks(table.limit(0), ["g"], "x", shares).count() == 0


def test_survival_of_many_values(spark):
    rng = random.Random(7)
    rows = [("s", float(rng.randint(1, 900)), rng.random() < 0.3) for _ in range(4000)]
    found = {r["value"]: (r["at_risk"], r["survival"]) for r in large_losses.survival(spark.createDataFrame(rows, "segment string, value double, censored boolean")).collect()}
    left, expected = 1.0, {}
    for v in sorted({v for _, v, c in rows if not c}):
        risk = sum(w >= v for _, w, _ in rows)
        left *= 1 - sum(w == v and not c for _, w, c in rows) / risk
        expected[v] = (risk, pytest.approx(left, abs=1e-12))
    assert found == expected
