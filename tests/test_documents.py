"""Triangle and selection documents, and the coherence of stated factors."""

import json

import pytest
from pyspark.sql import functions as F

from lossworks.jobs import documents, levels
from lossworks.operators import factors, triangles
from tests.published import RAA, TAYLOR_ASHE, cells


def named(spark, *grids):
    """Published triangles with years as origins."""
    return cells(spark, *grids).withColumns({"origin": (F.col("origin_idx") + 2001).cast("string"), "kind": F.lit("paid")})


def frame(spark, *docs):
    return spark.createDataFrame([(d if isinstance(d, str) or d is None else json.dumps(d),) for d in docs], "document string")


def triangle(**changes):
    body = {"measure": "paid", "cumulative": True, "originLengthMonths": 12, "origins": [{"label": "2001", "start": "2001-01-01"}, {"label": "2002", "start": "2002-01-01"}], "agesMonths": [12, 24], "values": [[1.5, 2.5], [3, None]], "valuationDate": "2002-12-31", "segment": "a"}
    return {"kind": "triangle", "triangle": body | changes}


def test_triangles_go_there_and_back(spark):
    both = named(spark, TAYLOR_ASHE, RAA)
    made, errors = documents.triangle_documents(both, "2010-12-31")
    one = json.loads(made.filter("segment = 's0'").first()["document"])
    body = one["triangle"]
    assert one["kind"] == "triangle" and body["originLengthMonths"] == 12 and body["agesMonths"][:2] == [12, 24] and body["origins"][3] == {"label": "2004", "start": "2004-01-01"}
    assert body["values"][9] == [344014.0] + [None] * 9 and body["cumulative"] is True
    again, bad, warned = documents.cells_from_documents(made)
    key = ["segment", "kind", "origin", "origin_idx", "age", "age_idx", "value"]
    assert sorted(map(repr, again.select(*key).collect())) == sorted(map(repr, both.select(*key[:-1], F.col("value").cast("double").alias("value")).collect()))
    assert errors.count() == bad.count() == warned.count() == 0


def test_increments_are_summed_with_a_warning(spark):
    made, _ = documents.triangle_documents(triangles.incremental(named(spark, TAYLOR_ASHE)), "2010-12-31", is_cumulative=False)
    got, _, warned = documents.cells_from_documents(made)
    want = {(r["origin_idx"], r["age_idx"]): r["value"] for r in named(spark, TAYLOR_ASHE).collect()}
    assert {(r["origin_idx"], r["age_idx"]): r["value"] for r in got.collect()} == {k: v if v is None else pytest.approx(v) for k, v in want.items()}
    assert [r["code"] for r in warned.collect()] == ["INCREMENTAL"]


def test_a_bad_document_fails_alone(spark):
    bad = [
        None, "", "no json", {"kind": "selection"}, triangle(measure="earnedPremium"), triangle(measure="custom:x"), triangle(values=None), triangle(values=[[1, 2]]), triangle(values=[[1, 2], [3]]), triangle(agesMonths=[24, 12]),
    ]
    got, errors, warned = documents.cells_from_documents(frame(spark, triangle(), triangle(segment="b", originLengthMonths=6), *bad))
    assert [(r["segment"], r["origin"], r["age"], r["value"]) for r in got.orderBy("segment", "origin_idx", "age_idx").collect()] == [(s, o, a, v) for s in "ab" for o, a, v in (("2001", 12, 1.5), ("2001", 24, 2.5), ("2002", 12, 3.0), ("2002", 24, None))]
    assert errors.count() == len(bad) and {r["code"] for r in errors.collect()} == {"BAD_INTERCHANGE"}
    assert [(r["segment"], r["code"]) for r in warned.collect()] == [("b", "ORIGIN_LENGTH")]
    odd = named(spark, TAYLOR_ASHE).withColumn("origin", F.when(F.col("origin_idx") == 2, "first").otherwise(F.col("origin")))
    mixed = named(spark, RAA).withColumn("segment", F.lit("s9")).withColumn("origin", F.when(F.col("origin_idx") == 2, "2003Q1").otherwise(F.col("origin")))
    good, errors = documents.triangle_documents(odd.unionByName(mixed), "2010-12-31")
    assert good.count() == 0 and {r["segment"]: "mix" in r["message"] for r in errors.collect()} == {"s0": False, "s9": True}


def test_origin_periods(spark):
    df = spark.createDataFrame([("2023",), ("2023Q3",), ("2023q1",), ("x",), ("202",), (None,)], "o string")
    got = [tuple(r["i"]) if r["i"] else None for r in df.select(documents.origin_interval(F.col("o")).alias("i")).collect()]
    assert got == [(2023.0, 2024.0), (2023.5, 2023.75), (2023.0, 2023.25), None, None, None]


def selection(*development, **more):
    return {"kind": "selection", "selection": {"segment": "s0", "measure": "paid", "originLengthMonths": 12, "development": list(development)} | more}


def entry(a, b, value, kind, **intent):
    return {"fromAgeMonths": a, "toAgeMonths": b, "value": value, "intent": {"kind": kind} | intent}


def test_all_averages_are_replayed(spark):
    tri = named(spark, TAYLOR_ASHE, RAA)
    menu = factors.averages(factors.link_ratios(tri)).filter("value is not null")
    for key in documents.INTENTS:
        stated = menu.filter(F.col("avg_key") == key).withColumn("value", F.when((F.col("age_idx") == 1) & (F.col("segment") == "s1"), F.col("value") * (1 + 5e-9)).otherwise(F.col("value")))
        entries, _, errors = documents.selections_from_documents(documents.selection_documents(stated))
        found, bad = documents.check_coherence(entries, tri)
        rows = found.collect()
        assert errors.count() == bad.count() == 0 and len(rows) == 18 and all(r["capability"] == "exact" and r["authoritative"] == "intent" for r in rows)
        assert [(r["segment"], r["from_age"]) for r in rows if not r["coherent"]] == [("s1", 24)], key


def test_what_is_not_replayed(spark):
    tri = named(spark, TAYLOR_ASHE)
    doc = selection(
        entry(12, 24, 3.5, "judgmental", rationale="new system"), entry(24, 36, 1.7, "regression"), entry(36, 48, 1.4, "volume-weighted", windowOriginPeriods=4), entry(48, 60, 1.1, "simple", exclusions=[{"origin": "2003"}]),
        entry(60, 72, 9.0, "volume-weighted"), entry(72, 84, 1.0, "medial", windowOriginPeriods=5, excludeHigh=2, excludeLow=1),
    )
    entries, _, errors = documents.selections_from_documents(frame(spark, doc))
    rows = {r["from_age"]: r for r in documents.check_coherence(entries, tri)[0].collect()}
    assert errors.count() == 0 and {k: (r["capability"], r["authoritative"], r["coherent"]) for k, r in rows.items()} == {
        12: ("value-only", "value", None), 24: ("value-only", "intent", None), 36: ("value-only", "intent", None), 48: ("value-only", "intent", None), 60: ("exact", "intent", False), 72: ("value-only", "intent", None),
    }


def test_bad_selections(spark):
    bad = [
        selection(entry(12, 24, 3.5, "judgmental")), selection(entry(12, 24, 3.5, "external", rationale=" ")), selection(entry(24, 12, 3.5, "simple")), selection(entry(12, 24, None, "simple")), selection(entry(12, 24, 1.5, "simple", excludeHigh=1)), {"kind": "triangle"}, "{",
        selection(entry(12, 24, 1.5, "simple"), tail={"value": 1.02, "intent": {"kind": "judgmental"}}),
    ]
    entries, tails, errors = documents.selections_from_documents(frame(spark, *bad))
    assert entries.count() == tails.count() == 0 and errors.count() == len(bad)
    tri = named(spark, TAYLOR_ASHE)
    for doc in (selection(entry(12, 36, 3.5, "simple")), selection(entry(12, 24, 3.5, "simple"), entry(12, 24, 3.4, "simple"))):
        entries, _, _ = documents.selections_from_documents(frame(spark, doc))
        found, errors = documents.check_coherence(entries, tri)
        assert found.count() == 0 and errors.count() == 1


def test_fitted_tails(spark):
    tri = named(spark, TAYLOR_ASHE, RAA)
    menu = factors.averages(factors.link_ratios(tri)).filter("avg_key = 'all-wtd' and value is not null")
    for family, method in documents.FAMILIES.items():
        fits = levels.fit_tail(menu.withColumn("ldf", F.col("value")), method).select("segment", "kind", F.when(F.col("segment") == "s0", F.col("tail_factor")).otherwise(F.col("tail_factor") * 1.001).alias("value"), F.lit(family).alias("family"))
        entries, tails, errors = documents.selections_from_documents(documents.selection_documents(menu, fits))
        found, _ = documents.check_coherence(entries, tri, tails)
        ends = {r["segment"]: r for r in found.filter("from_age is null").collect()}
        valid = {r["segment"]: r["valid"] for r in levels.fit_tail(menu.withColumn("ldf", F.col("value")), method).collect()}
        assert errors.count() == 0 and ends["s0"]["coherent"] is valid["s0"] and ends["s1"]["coherent"] is False and ends["s0"]["capability"] == "exact"
