"""Result documents, sample tables, percentiles at scale, appended ledgers."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lossworks.functions.draws import uniform
from lossworks.functions.order import percentiles
from lossworks.jobs import compare, documents, stochastic
from lossworks.sources import samples

RESULT = "segment string, method string, basis string, origin string, origin_idx int, ultimate double, unpaid double, standard_error double"


def triangle(segment, measure="paid"):
    return (segment, json.dumps({"kind": "triangle", "triangle": {"measure": measure, "cumulative": True, "origins": [], "agesMonths": [], "values": [], "segment": segment}}))


def results(spark, rows):
    return spark.createDataFrame(rows, RESULT)


GOOD = [("s", "mack", "paid", "2020", 0, 10.0, 1.0, None), ("s", "mack", "paid", "2021", 1, 20.0, 5.0, 2.5), ("s", "chain_ladder", "paid", "2021", 1, 21.0, 6.0, None), ("s", "chain_ladder", "paid", "2020", 0, 11.0, 0.5, None)]
TOTALS = "segment string, method string, ultimate double, unpaid double, standard_error double"


def test_documents_there_and_back(spark):
    totals = spark.createDataFrame([("s", "mack", 30.0, 6.0, 3.0), ("s", "chain_ladder", 32.0, 6.5, None)], TOTALS)
    warnings = spark.createDataFrame([("s", "mack", "thin column")], "segment string, method string, message string")
    triangles = spark.createDataFrame([triangle("s")], "segment string, document string")
    made, errors = documents.result_documents(results(spark, GOOD), triangles, totals, warnings=warnings)
    assert errors.count() == 0
    found = {r["method"]: json.loads(r["document"]) for r in made.collect()}
    mack = found["mack"]["result"]
    assert found["mack"]["kind"] == "method-result" and mack["method"] == "mack" and mack["measure"] == "paid" and mack["warnings"] == ["thin column"]
    assert [r["origin"] for r in mack["rows"]] == ["2020", "2021"]
    assert "standardError" not in mack["rows"][0] and mack["rows"][1]["standardError"] == 2.5 and mack["totals"] == {"ultimate": 30.0, "unpaid": 6.0, "standardError": 3.0}
    ladder = found["chain_ladder"]["result"]
    assert ladder["method"] == "chainLadder" and "warnings" not in ladder and "standardError" not in ladder["totals"] and len(ladder["appliesTo"]["triangle"]) == 64 and "selection" not in ladder["appliesTo"]
    rows, sums, errors = documents.results_from_documents(made)
    assert errors.count() == 0
    assert sorted(tuple(r) for r in rows.select("segment", "method", "origin", "ultimate", "unpaid", F.coalesce("standard_error", F.lit(-1.0))).collect()) == sorted((s, m, o, u, v, -1.0 if e is None else e) for s, m, _, o, _, u, v, e in GOOD)
    assert sorted(tuple(r) for r in sums.select("method", "ultimate", "unpaid", F.coalesce("standard_error", F.lit(-1.0))).collect()) == [("chain_ladder", 32.0, 6.5, -1.0), ("mack", 30.0, 6.0, 3.0)]


def test_totals_are_summed_without_an_error(spark):
    made, _ = documents.result_documents(results(spark, GOOD), spark.createDataFrame([triangle("s")], "segment string, document string"))
    sums = {r["method"]: r for r in documents.results_from_documents(made)[1].collect()}
    assert sums["mack"]["ultimate"] == 30.0 and sums["mack"]["unpaid"] == 6.0 and sums["mack"]["standard_error"] is None


def test_bad_results_fail_alone(spark):
    rows = [*GOOD]
    for k, (method, basis, origin, ultimate, error) in enumerate([("merz_wuthrich", "paid", "2020", 1.0, None), ("mack", "incurred", "2020", 1.0, None), ("mack", "paid", None, 1.0, None), ("mack", "paid", "2020", math.nan, None), ("mack", "paid", "2020", 1.0, math.inf)]):
        rows.append((f"b{k}", method, basis, origin, 0, ultimate, 0.0, error))
    rows += [("b5", "mack", "paid", "2020", 0, 1.0, 0.0, None), ("b6", "mack", "paid", "2020", 0, 1.0, 0.0, None), ("b6", "mack", "paid", "2020", 1, 1.0, 0.0, None), ("b7", "benktander", "paid", "2020", 0, 1.0, 0.0, None)]
    triangles = spark.createDataFrame([triangle(s) for s in ("s", "b0", "b1", "b2", "b3", "b4", "b6", "b7")], "segment string, document string")
    other = json.dumps({"kind": "selection", "selection": {"segment": "b7", "measure": "incurred", "development": []}})
    made, errors = documents.result_documents(results(spark, rows), triangles, selections=spark.createDataFrame([("b7", other)], "segment string, document string"))
    assert {r["segment"] for r in made.collect()} == {"s"}
    said = {r["segment"]: (r["code"], r["message"]) for r in errors.collect()}
    assert {k: v[1] for k, v in said.items()} == {
        "b0": "no document for method merz_wuthrich", "b1": "the basis isn't the triangle's measure", "b2": "an origin is missing or stands twice", "b3": "an amount is no number", "b4": "an amount is no number",
        "b5": "no triangle document", "b6": "an origin is missing or stands twice", "b7": "the selection is of another triangle",
    }
    assert {v[0] for v in said.values()} == {"BAD_INTERCHANGE"}


def test_bad_documents_fail_alone(spark):
    body = {"segment": "s", "measure": "paid", "method": "mack", "rows": [{"origin": "2020", "ultimate": 1.0, "unpaid": 0.5}], "totals": {"ultimate": 1.0, "unpaid": 0.5}}
    spoilt = [body | {"method": "guess"}, body | {"measure": "rainfall"}, {k: v for k, v in body.items() if k != "totals"}, body | {"rows": [*body["rows"], *body["rows"]]}, body | {"rows": [{"origin": "2020", "ultimate": 1.0}]}, body | {"totals": {"ultimate": 1.0}}]
    texts = [json.dumps({"kind": "method-result", "result": b}) for b in (body, *spoilt)] + ["{", None, json.dumps({"kind": "triangle"})]
    rows, totals, errors = documents.results_from_documents(spark.createDataFrame([(t,) for t in texts], "document string"))
    assert rows.count() == totals.count() == 1 and errors.count() == len(texts) - 1


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def drawn(spark, segments, seed, sims=50):
    rows = spark.range(len(segments) * 3 * sims).select(F.element_at(F.array(*map(F.lit, segments)), (F.col("id") % len(segments) + 1).cast("int")).alias("segment"), F.floor(F.col("id") / len(segments)).alias("k"))
    return rows.select("segment", F.lit("paid").alias("kind"), F.concat(F.lit("20"), F.lpad((F.col("k") % 3).cast("string"), 2, "0")).alias("origin"), F.floor(F.col("k") / 3).alias("sim"), (uniform(F.lit(seed), F.col("k")) * 100).alias("unpaid"))


def test_one_segment_is_written_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(samples, "SIMS_PER_FILE", 20)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = str(tmp_path / "sink")
    samples.write_samples(drawn(spark, ["a", "b", "2024", None], 1), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    before = files(path)
    assert len([f for f in before if "segment=a/" in f and "/samples/" in f]) >= 2  # a segment's simulations are several files
    total = {r["segment"]: r["total"] for r in samples.read_manifest(spark, path).collect()}
    samples.write_samples(drawn(spark, ["b"], 2), path)
    after = files(path)
    assert {f: t for f, t in after.items() if "segment=b/" not in f} == {f: t for f, t in before.items() if "segment=b/" not in f}
    assert not {f for f in after if "segment=b/" in f} & set(before)
    again = {r["segment"]: r for r in samples.read_manifest(spark, path).collect()}
    assert set(again) == {"a", "b", "2024", None} and all((r["n"], r["n_sims"], r["n_origins"]) == (150, 50, 3) for r in again.values())
    assert again["b"]["total"] != total["b"] and all(again[s]["total"] == total[s] for s in ("a", "2024", None))
    samples.write_samples(drawn(spark, ["b"], 2), path)  # a rerun changes no number
    assert {r["segment"]: r["total"] for r in samples.read_manifest(spark, path).collect()} == {s: r["total"] for s, r in again.items()}
    assert samples.wrong(spark, path).count() == 0


def test_only_asked_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "sink")
    samples.write_samples(drawn(spark, ["a", "b", "c"], 1), path)
    some = samples.read_samples(spark, path, ["b"], ["paid"])
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan and "segment#" in plan.split("PartitionFilters")[1]
    assert some.count() == 150 and all("segment=b" in r["f"] for r in some.select(F.input_file_name().alias("f")).distinct().collect())


def test_a_manifest_that_is_wrong_is_found(spark, tmp_path):
    path = str(tmp_path / "sink")
    samples.write_samples(drawn(spark, ["a", "b"], 1), path)
    victim = next(f for f in files(path) if "segment=a/" in f and "/samples/" in f)
    os.remove(victim)
    assert [r["segment"] for r in samples.wrong(spark, path).collect()] == ["a"]


def test_percentiles_of_a_very_large_group(spark):
    """Ten million values in one group, some in another, and one alone: between two ranks as numpy has it."""
    rows = spark.range(10_000_000).select(F.lit("hot").alias("g"), ((F.col("id") * 7919) % 9_999_991).cast("double").alias("v"))
    some = [("s", float(v)) for v in (3, 1, 4, 1, 5, 9, 2, 6)] + [("one", 7.0), ("none", None), (None, 2.0), (None, 4.0)]
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r["g"]: r for r in percentiles(rows.unionByName(spark.createDataFrame(some, "g string, v double")), ["g"], "v", shares).collect()}
    hot = (np.arange(10_000_000) * 7919 % 9_999_991).astype(float)
    for g, values in (("hot", hot), ("s", [3, 1, 4, 1, 5, 9, 2, 6]), ("one", [7.0]), (None, [2.0, 4.0])):
        assert [got[g][k] for k in shares] == pytest.approx(np.quantile(values, list(shares.values())).tolist(), rel=1e-12)
    assert "none" not in got


def test_summary_of_samples(spark):
    rows = drawn(spark, ["a", "b"], 3, 40)
    table = rows.toPandas()
    got = {(r["segment"], r["origin"]): r for r in stochastic.summary(rows).collect()}
    assert len(got) == 8
    for (segment, origin), r in got.items():
        own = table[table.segment == segment]
        values = own.groupby("sim").unpaid.sum() if origin is None else own[own.origin == origin].unpaid
        assert r["n"] == 40 and r["mean"] == pytest.approx(values.mean()) and r["sd"] == pytest.approx(values.std()) and r["cv"] == pytest.approx(values.std() / values.mean())
        assert r["percentiles"] == pytest.approx(np.quantile(values, stochastic.PERCENTILES).tolist())


LEDGER = "analysis_id string, field string, value double, actor string, rationale string, recorded_at long"


def test_numbers_go_on_where_they_ended(spark):
    first = [("x", f"f{i}", float(i), "default", None, i % 4) for i in range(30)] + [("y", "f", 1.0, "someone", "seen", 0), ("y", "g", 1.0, "someone", " ", 0), (None, "f", 1.0, "default", None, 5)]
    ledger, errors = compare.appended(None, spark.createDataFrame(first, LEDGER))
    ledger = ledger.cache()
    assert [tuple(r) for r in errors.collect()] == [("y", "g", "MISSING_RATIONALE")]
    second = [*first[10:], ("x", "late", 2.0, "default", None, 0), ("x", "late", 2.0, "default", None, 0), ("z", "f", 1.0, "default", None, 0), ("y", "f", 2.0, "someone", "changed", 9)]
    more, _ = compare.appended(ledger, spark.createDataFrame(second, LEDGER))
    every = ledger.unionByName(more)
    numbers = {}
    for r in every.collect():
        numbers.setdefault(r["analysis_id"], []).append((r["seq"], r["recorded_at"], r["field"]))
    assert {k: sorted(x[0] for x in v) for k, v in numbers.items()} == {"x": [*range(1, 32)], "y": [1, 2], "z": [1], None: [1]}
    assert [x[1:] for x in sorted(numbers["x"])][:30] == sorted((i % 4, f"f{i}") for i in range(30)) and sorted(numbers["x"])[30][2] == "late"
    assert compare.appended(every, spark.createDataFrame(second, LEDGER))[0].count() == 0  # sent again, nothing is new
    assert compare.ledger_errors(every.filter("analysis_id is not null")).count() == 0
