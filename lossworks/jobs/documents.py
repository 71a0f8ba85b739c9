"""Triangles and factor selections as JSON documents, one per row, and the check that selections say what they mean.

A document is a string column; what it holds is read with one schema. Bad documents give a row in an errors frame and
never fail the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.levels import fit_tail
from lossworks.operators.factors import averages, link_ratios
from lossworks.operators.triangles import cumulative, from_grid_rows

TOLERANCE = 1e-9

# Names of the document format.
TRIANGLE_SCHEMA = "struct<kind:string,triangle:struct<measure:string,cumulative:boolean,originLengthMonths:int,origins:array<struct<label:string,start:string>>,agesMonths:array<int>,values:array<array<double>>,valuationDate:string,segment:string>>"
SELECTION_SCHEMA = (
    "struct<kind:string,selection:struct<segment:string,measure:string,originLengthMonths:int,development:array<struct<fromAgeMonths:int,toAgeMonths:int,value:double,"
    "intent:struct<kind:string,windowOriginPeriods:int,excludeHigh:int,excludeLow:int,exclusions:array<struct<origin:string,reason:string>>,rationale:string>>>,"
    "tail:struct<value:double,intent:struct<kind:string,family:string,fitFromAgeMonths:int,rationale:string>>>>"
)
# Measures that are triangles, stated judgments, and which average each intent asks for (kind, window, trims).
MEASURES = {
    "paid": "paid", "incurred": "incurred", "caseReserve": "case_reserve", "reportedCount": "reported_count", "openCount": "open_count", "closedCount": "closed_count", "closedWithPayCount": "closed_with_pay_count",
}
JUDGED = ("judgmental", "external")
INTENTS = {
    "all-wtd": ("volume-weighted", None, None), "all-str": ("simple", None, None), "5-wtd": ("volume-weighted", 5, None), "5-str": ("simple", 5, None),
    "3-wtd": ("volume-weighted", 3, None), "3-str": ("simple", 3, None), "med-5x1": ("medial", 5, 1), "geo-all": ("geometric", None, None),
}
RESULT_SCHEMA = (
    "struct<kind:string,result:struct<segment:string,measure:string,method:string,appliesTo:struct<triangle:string,selection:string>,rows:array<struct<origin:string,ultimate:double,unpaid:double,standardError:double>>,"
    "totals:struct<ultimate:double,unpaid:double,standardError:double>,warnings:array<string>>>"
)
# Methods whose results are documents, by their names there.
METHODS = {"chain_ladder": "chainLadder", "mack": "mack", "bornhuetter_ferguson": "bornhuetterFerguson", "benktander": "benktander"}
FAMILIES = {"exponential-decay": "exponential", "inverse-power": "inverse_power"}


def _error(rows: DataFrame, method: str) -> DataFrame:
    """Rows with a ``problem`` as errors."""
    return rows.filter("problem is not null").select("segment", F.lit(method).alias("method"), F.lit("BAD_INTERCHANGE").alias("code"), F.col("problem").alias("message"))


def origin_start(label: Column) -> Column:
    """The first day of an origin named like ``2023`` or ``2023Q3``; null for other names."""
    year = F.when(label.rlike(r"^\d{4}([Qq][1-4])?$"), F.substring(label, 1, 4))
    month = F.when(F.length(label) == 6, F.substring(label, 6, 1).cast("int") * 3 - 2).otherwise(1)
    return F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))


def origin_months(label: Column) -> Column:
    return F.when(label.rlike(r"^\d{4}$"), 12).when(label.rlike(r"^\d{4}[Qq][1-4]$"), 3)


def origin_interval(label: Column) -> Column:
    """An origin's period as numbers of years, (p0, p1); null for other names."""
    start = origin_start(label).cast("date")
    p0 = F.year(start) + (F.month(start) - 1) / 12
    return F.when(start.isNotNull(), F.struct(p0.cast("double").alias("p0"), (p0 + origin_months(label) / 12).cast("double").alias("p1")))


def triangle_documents(cells: DataFrame, valuation_date: str, is_cumulative: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``segment, measure, document``, errors) from cells, a document per segment and kind.

    Origins are named by year or quarter, all alike; other names fail their triangle. A triangle is one row: some
    thousands of cells.
    """
    names = F.create_map(*(F.lit(x) for pair in ((v, k) for k, v in MEASURES.items()) for x in pair))
    own = ["segment", "kind"]
    rows = cells.groupBy(*own, "origin_idx", "origin").agg(F.sort_array(F.collect_list(F.struct("age_idx", "age", finite("value").alias("value")))).alias("c"))
    whole = rows.groupBy(*own).agg(
        F.sort_array(F.collect_list(F.struct("origin_idx", "origin", "c"))).alias("r"),
        F.min(F.coalesce(origin_months(F.col("origin")), F.lit(0))).alias("least"), F.max(F.coalesce(origin_months(F.col("origin")), F.lit(0))).alias("most"),
    )
    problem = F.when(F.col("least") == 0, "an origin's name is no year and no quarter").when(F.col("least") != F.col("most"), "origins mix years and quarters")
    whole = whole.withColumn("problem", problem)
    body = F.struct(
        F.element_at(names, F.col("kind")).alias("measure"), F.lit(is_cumulative).alias("cumulative"), F.col("least").alias("originLengthMonths"),
        F.transform("r", lambda r: F.struct(r["origin"].alias("label"), origin_start(r["origin"]).alias("start"))).alias("origins"),
        F.col("r")[0]["c"]["age"].alias("agesMonths"), F.transform("r", lambda r: r["c"]["value"]).alias("values"), F.lit(valuation_date).alias("valuationDate"), "segment",
    )
    document = F.to_json(F.struct(F.lit("triangle").alias("kind"), body.alias("triangle")), {"ignoreNullFields": "false"})
    good = whole.filter("problem is null").select("segment", F.element_at(names, F.col("kind")).alias("measure"), document.alias("document"))
    return good, _error(whole, "triangle_documents")


def cells_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cumulative cells, errors, warnings) from ``document`` strings.

    Incremental values are cumulated, with a warning; so are origins of one and six months warned of. Unreadable
    documents, other measures, absent values and rows of other lengths than the ages fail their document.
    """
    d = documents.withColumn("d", F.from_json("document", TRIANGLE_SCHEMA)).select("d.kind", "d.triangle.*").withColumnRenamed("kind", "_doc")
    kinds = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    ages, n = F.col("agesMonths"), F.size("agesMonths")
    rising = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.get(ages, i) <= F.get(ages, i - 1))) == 0
    d = d.withColumn(
        "problem",
        F.when(F.col("_doc").isNull() | (F.col("_doc") != "triangle") | F.col("measure").isNull(), "no triangle document")
        .when(F.element_at(kinds, F.col("measure")).isNull(), F.concat(F.lit("no triangle of measure "), F.col("measure")))
        .when(F.col("values").isNull() | F.col("origins").isNull() | ages.isNull(), "values, origins or ages are absent")
        .when((F.size("origins") != F.size("values")) | F.exists("values", lambda r: F.coalesce(F.size(r) != n, F.lit(True))), "rows aren't as many as the origins and as long as the ages")
        .when(~rising, "ages don't rise"),
    )
    good = d.filter("problem is null")
    rows = good.select("segment", F.element_at(kinds, F.col("measure")).alias("kind"), F.coalesce("cumulative", F.lit(True)).alias("cumulative"), "agesMonths", "origins", F.posexplode("values").alias("origin_idx", "vals"))
    cells = from_grid_rows(rows.withColumn("origin", F.get(F.col("origins"), F.col("origin_idx"))["label"]).drop("origins"))
    straight = cells.filter("cumulative").drop("cumulative")
    summed = cumulative(cells.filter("not cumulative").drop("cumulative"))
    notes = F.array_compact(F.array(
        F.when(~F.coalesce("cumulative", F.lit(True)), F.lit("INCREMENTAL")), F.when(F.col("originLengthMonths").isin(1, 6), F.lit("ORIGIN_LENGTH")),
    ))
    warnings = good.select("segment", F.lit("cells_from_documents").alias("method"), F.explode(notes).alias("code"), F.col("measure").alias("message"))
    return straight.unionByName(summed), _error(d, "cells_from_documents"), warnings


def selection_documents(entries: DataFrame, tails: DataFrame | None = None, origin_months: int = 12) -> DataFrame:
    """``segment, document`` from ``segment, kind, from_age, to_age, value, avg_key`` and ``segment, kind, value, family``.

    ``avg_key`` names the average that a factor was taken from; without one the value is a judgment and ``rationale``
    (a column that may be absent) says why.
    """
    names = F.create_map(*(F.lit(x) for pair in ((v, k) for k, v in MEASURES.items()) for x in pair))

    def meant(part: int, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for key, intent in INTENTS.items():
            out = F.when(F.col("avg_key") == key, F.lit(intent[part]).cast(kind)).otherwise(out)
        return out

    rationale = F.col("rationale") if "rationale" in entries.columns else F.lit(None).cast("string")
    intent = F.struct(
        F.coalesce(meant(0, "string"), F.lit("judgmental")).alias("kind"), meant(1, "int").alias("windowOriginPeriods"), meant(2, "int").alias("excludeHigh"), meant(2, "int").alias("excludeLow"), rationale.alias("rationale"),
    )
    entry = F.struct(F.col("from_age").alias("fromAgeMonths"), F.col("to_age").alias("toAgeMonths"), "value", intent.alias("intent"))
    out = entries.groupBy("segment", "kind").agg(F.sort_array(F.collect_list(entry)).alias("development"))
    if tails is not None:
        tail = F.struct("value", F.struct(F.lit("fitted").alias("kind"), "family").alias("intent"))
        out = out.join(tails.select("segment", "kind", tail.alias("tail")), ["segment", "kind"], "left")
    body = F.struct("segment", F.element_at(names, F.col("kind")).alias("measure"), F.lit(origin_months).alias("originLengthMonths"), "development", *(["tail"] if tails is not None else []))
    return out.select("segment", F.to_json(F.struct(F.lit("selection").alias("kind"), body.alias("selection"))).alias("document"))


def selections_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, tails, errors) from ``document`` strings.

    Entries: ``segment, kind, months, from_age, to_age, value, intent, window, high, low, excluded``. A judgment without a
    rationale, an interval that doesn't rise, a value that is no number, and trims of another average than a medial one
    fail their document.
    """
    d = documents.withColumn("d", F.from_json("document", SELECTION_SCHEMA)).select(F.col("d.kind").alias("_doc"), "d.selection.*")
    kinds = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))

    def unsaid(intent: Column) -> Column:
        return intent["kind"].isin(*JUDGED) & (F.trim(F.coalesce(intent["rationale"], F.lit(""))) == "")

    def has(test) -> Column:
        return F.exists("development", lambda e: F.coalesce(test(e), F.lit(True)))

    trims = lambda e: (e["intent"]["kind"] != "medial") & (e["intent"]["excludeHigh"].isNotNull() | e["intent"]["excludeLow"].isNotNull())
    d = d.withColumn(
        "problem",
        F.when(F.col("_doc").isNull() | (F.col("_doc") != "selection") | F.col("development").isNull(), "no selection document")
        .when(F.element_at(kinds, F.col("measure")).isNull(), "no triangle of this measure")
        .when(has(lambda e: e["toAgeMonths"] <= e["fromAgeMonths"]), "an interval doesn't rise")
        .when(has(lambda e: finite(e["value"]).isNull()), "a value is no number")
        .when(has(lambda e: unsaid(e["intent"])) | F.coalesce(unsaid(F.col("tail.intent")), F.lit(False)), "a judgment has no rationale")
        .when(has(trims), "only a medial average has trims"),
    )
    good = d.filter("problem is null").withColumn("kind", F.element_at(kinds, F.col("measure")))
    entries = good.select("segment", "kind", F.col("originLengthMonths").alias("months"), F.explode("development").alias("e")).select(
        "segment", "kind", "months", F.col("e.fromAgeMonths").alias("from_age"), F.col("e.toAgeMonths").alias("to_age"), "e.value", F.col("e.intent.kind").alias("intent"),
        F.col("e.intent.windowOriginPeriods").alias("window"), F.col("e.intent.excludeHigh").alias("high"), F.col("e.intent.excludeLow").alias("low"), (F.coalesce(F.size("e.intent.exclusions"), F.lit(0)) > 0).alias("excluded"),
    )
    tails = good.filter("tail is not null").select("segment", "kind", "tail.value", F.col("tail.intent.kind").alias("intent"), F.col("tail.intent.family").alias("family"), F.col("tail.intent.fitFromAgeMonths").alias("fit_from"))
    return entries, tails, _error(d, "selections_from_documents")


def _amounts(x: Column) -> Column:
    """Ultimate, unpaid and, where there is one, standard error, in the document's names."""
    return F.struct(*(finite(x[c]).alias(n) for c, n in (("ultimate", "ultimate"), ("unpaid", "unpaid"), ("standard_error", "standardError"))))


def _unsound(x: Column) -> Column:
    """Whether an amount that must be there is no number, or a standard error is there and is none."""
    error = x["standard_error"]
    return finite(x["ultimate"]).isNull() | finite(x["unpaid"]).isNull() | (error.isNotNull() & finite(error).isNull())


def result_documents(rows: DataFrame, triangles: DataFrame, totals: DataFrame | None = None, selections: DataFrame | None = None, warnings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(``segment, method, document``, errors) from several methods' results, a document per segment and method.

    ``rows``: ``segment, method, basis, origin, ultimate, unpaid`` and, where a method has them, ``standard_error`` and
    ``origin_idx`` (the order of the rows; else by name). ``totals``: ``segment, method, ultimate, unpaid, standard_error``;
    without them amounts are summed, and there is no total error, which no sum gives. A standard error that is absent
    stays absent. ``triangles`` and ``selections`` (``segment, document``) are what the results rest on and are named by
    their SHA-256. Another method, another basis than the triangle's measure, a selection of another measure, no
    triangle, repeated origins, and amounts that are no numbers fail their result alone. ``warnings``: ``segment,
    method, message``; without any the document has no such field.
    """
    own = ["segment", "method"]
    for name, kind in (("standard_error", "double"), ("origin_idx", "int")):
        rows = rows if name in rows.columns else rows.withColumn(name, F.lit(None).cast(kind))
    each = F.struct("origin_idx", "origin", *(F.col(c).cast("double").alias(c) for c in ("ultimate", "unpaid", "standard_error")))
    whole = rows.groupBy(*own).agg(
        F.sort_array(F.collect_list(each)).alias("r"), F.min("basis").alias("basis"), F.max("basis").alias("_basis"),
        F.sum(finite("ultimate")).alias("_u"), F.sum(finite("unpaid")).alias("_v"), (F.count("*") - F.countDistinct("origin")).alias("_repeated"),
    )
    if totals is None:
        whole = whole.withColumn("t", F.struct(F.col("_u").alias("ultimate"), F.col("_v").alias("unpaid"), F.lit(None).cast("double").alias("standard_error")))
    else:
        given = totals.select(*own, F.struct(*(F.col(c).cast("double").alias(c) for c in ("ultimate", "unpaid", "standard_error"))).alias("t"))
        whole = whole.join(given, own, "left")
    parsed = triangles.select("segment", F.sha2("document", 256).alias("_triangle"), F.from_json("document", TRIANGLE_SCHEMA)["triangle"]["measure"].alias("_measure"))
    whole = whole.join(parsed, "segment", "left")
    if selections is None:
        whole = whole.withColumns({"_selection": F.lit(None).cast("string"), "_selected": F.lit(None).cast("string")})
    else:
        whole = whole.join(selections.select("segment", F.sha2("document", 256).alias("_selection"), F.from_json("document", SELECTION_SCHEMA)["selection"]["measure"].alias("_selected")), "segment", "left")
    if warnings is None:
        whole = whole.withColumn("_warnings", F.lit(None).cast("array<string>"))
    else:
        whole = whole.join(warnings.groupBy(*own).agg(F.sort_array(F.collect_list("message")).alias("_warnings")), own, "left")
    methods, measures = (F.create_map(*(F.lit(x) for pair in table for x in pair)) for table in (METHODS.items(), ((v, k) for k, v in MEASURES.items())))
    basis = F.element_at(measures, F.col("basis"))
    whole = whole.withColumn(
        "problem",
        F.when(F.element_at(methods, F.col("method")).isNull(), F.concat(F.lit("no document for method "), F.coalesce("method", F.lit("null"))))
        .when(F.col("_measure").isNull(), "no triangle document")
        .when(~F.col("basis").eqNullSafe(F.col("_basis")) | F.coalesce(basis != F.col("_measure"), F.col("basis").isNotNull()), "the basis isn't the triangle's measure")
        .when(F.col("_selection").isNotNull() & ~F.col("_selected").eqNullSafe(F.col("_measure")), "the selection is of another triangle")
        .when(F.col("_repeated") > 0, "an origin is missing or stands twice")
        .when(F.exists("r", _unsound), "an amount is no number").when(F.col("t").isNull() | _unsound(F.col("t")), "a total is no number"),
    )
    body = F.struct(
        "segment", F.col("_measure").alias("measure"), F.element_at(methods, F.col("method")).alias("method"), F.struct(F.col("_triangle").alias("triangle"), F.col("_selection").alias("selection")).alias("appliesTo"),
        F.transform("r", lambda x: F.struct(x["origin"].alias("origin"), *(_amounts(x)[n].alias(n) for n in ("ultimate", "unpaid", "standardError")))).alias("rows"), _amounts(F.col("t")).alias("totals"), F.col("_warnings").alias("warnings"),
    )
    good = whole.filter("problem is null").select(*own, F.to_json(F.struct(F.lit("method-result").alias("kind"), body.alias("result"))).alias("document"))
    return good, _error(whole, "result_documents")


def results_from_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, totals, errors) from ``document`` strings.

    Rows: ``segment, method, kind, origin, ultimate, unpaid, standard_error``, an absent error null; totals the same without
    an origin. Unreadable documents, other kinds and methods, absent rows or totals, repeated or unnamed origins and
    absent amounts fail their document.
    """
    d = documents.withColumn("d", F.from_json("document", RESULT_SCHEMA)).select(F.col("d.kind").alias("_doc"), "d.result.*").withColumnRenamed("rows", "r").withColumnRenamed("totals", "t")
    methods, kinds = (F.create_map(*(F.lit(x) for pair in table for x in pair)) for table in (((v, k) for k, v in METHODS.items()), MEASURES.items()))
    absent = lambda x: finite(x["ultimate"]).isNull() | finite(x["unpaid"]).isNull()
    names = F.transform("r", lambda x: x["origin"])
    d = d.withColumn(
        "problem",
        F.when(~F.col("_doc").eqNullSafe(F.lit("method-result")) | F.col("method").isNull(), "no result document")
        .when(F.element_at(methods, F.col("method")).isNull(), F.concat(F.lit("no result of method "), F.col("method")))
        .when(F.element_at(kinds, F.col("measure")).isNull(), "no triangle of this measure")
        .when(F.col("r").isNull() | F.col("t").isNull(), "rows or totals are absent")
        .when((F.size(F.array_distinct(names)) < F.size(names)) | F.exists(names, lambda n: n.isNull()), "an origin is missing or stands twice")
        .when(F.exists("r", absent), "an amount is no number").when(absent(F.col("t")), "a total is no number"),
    )
    good = d.filter("problem is null").select("segment", F.element_at(methods, F.col("method")).alias("method"), F.element_at(kinds, F.col("measure")).alias("kind"), "r", "t")
    amounts = lambda x: [F.col(f"{x}.ultimate"), F.col(f"{x}.unpaid"), F.col(f"{x}.standardError").alias("standard_error")]
    rows = good.select("segment", "method", "kind", F.explode("r").alias("x")).select("segment", "method", "kind", "x.origin", *amounts("x"))
    return rows, good.select("segment", "method", "kind", *amounts("t")), _error(d, "results_from_documents")


def selections_on_columns(entries: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries with ``age_idx``, errors): each interval must be one of the triangle's adjacent ages, and stand once.

    One bad interval fails the whole selection of its segment.
    """
    by_age = Window.partitionBy("segment", "kind").orderBy("age_idx")
    columns = cells.select("segment", "kind", "age", "age_idx").distinct().withColumn("to_age", F.lead("age").over(by_age)).filter("to_age is not null")
    columns = columns.select("segment", "kind", F.col("age").alias("from_age"), "to_age", "age_idx")
    met = entries.join(columns, ["segment", "kind", "from_age", "to_age"], "left")
    met = met.withColumn("_times", F.count("*").over(Window.partitionBy("segment", "kind", "from_age", "to_age")))
    span = F.concat(F.col("from_age").cast("string"), F.lit(" to "), F.col("to_age").cast("string"))
    met = met.withColumn("problem", F.when(F.col("age_idx").isNull(), F.concat(F.lit("no adjacent ages of the triangle: "), span)).when(F.col("_times") > 1, F.concat(F.lit("stands twice: "), span)))
    bad = met.filter("problem is not null").select("segment", "kind").distinct()
    return met.join(bad, ["segment", "kind"], "left_anti").drop("problem", "_times"), _error(met, "selections_on_columns").distinct()


def average_of_intent() -> Column:
    """The average that an entry's intent asks for; null where none replays it (windows and trims need annual origins)."""
    key = F.lit(None).cast("string")
    for name, (kind, window, trim) in INTENTS.items():
        test = (F.col("intent") == kind) & F.col("window").eqNullSafe(F.lit(window).cast("int"))
        if window is not None:
            test = test & (F.coalesce("months", F.lit(12)) == 12)
        if trim is not None:
            test = test & (F.col("high") == trim) & (F.col("low") == trim)
        key = F.when(test, F.lit(name)).otherwise(key)
    return F.when(~F.col("excluded"), key)


def _compared(rows: DataFrame) -> DataFrame:
    """``relative_deviation`` and ``coherent`` of ``value`` against ``expected``; null where nothing is recomputed."""
    scale = F.greatest(F.abs("value"), F.abs("expected"))
    deviation = F.when(scale == 0, 0.0).otherwise(F.abs(F.col("value") - F.col("expected")) / scale)
    exact = F.col("capability") == "exact"
    return rows.withColumn("relative_deviation", F.when(exact, deviation)).withColumn("coherent", F.when(exact, F.coalesce(F.col("relative_deviation") <= TOLERANCE, F.lit(False))))


def check_coherence(entries: DataFrame, cells: DataFrame, tails: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, errors): what each stated factor would be if it were recomputed as it says.

    Findings: ``segment, kind, from_age, to_age, capability, authoritative, expected, actual, relative_deviation, coherent``;
    a tail's ages are null. Judgments are their own authority and intents that no average replays are taken as they are
    (``value-only``); all others must be within ``TOLERANCE``. A fitted tail is fitted on the stated factors.
    """
    placed, errors = selections_on_columns(entries, cells)
    menu = averages(link_ratios(cells)).select("segment", "kind", "age_idx", "avg_key", F.col("value").alias("expected"))
    judged = F.col("intent").isin(*JUDGED)
    marked = placed.withColumn("avg_key", F.when(~judged, average_of_intent()))
    out = marked.join(menu, ["segment", "kind", "age_idx", "avg_key"], "left").withColumns({
        "capability": F.when(F.col("avg_key").isNotNull(), "exact").otherwise("value-only"), "authoritative": F.when(judged, "value").otherwise("intent"),
    })
    names = ["segment", "kind", "from_age", "to_age", "capability", "authoritative", "expected", F.col("value").alias("actual"), "relative_deviation", "coherent"]
    out = _compared(out).select(*names)
    if tails is None:
        return out, errors
    good = tails.join(placed.select("segment", "kind").distinct(), ["segment", "kind"], "left_semi").withColumns({
        "from_age": F.lit(None).cast("int"), "to_age": F.lit(None).cast("int"), "authoritative": F.when(F.col("intent").isin(*JUDGED), "value").otherwise("intent"),
    })
    fits = None
    for family, method in FAMILIES.items():
        own = placed.join(good.filter(F.col("family") == family).select("segment", "kind", "fit_from"), ["segment", "kind"])
        factors = own.select("segment", "kind", "age_idx", F.when(F.coalesce(F.col("from_age") >= F.col("fit_from"), F.lit(True)), F.col("value")).alias("ldf"))
        fit = fit_tail(factors, method).select("segment", "kind", F.lit(family).alias("family"), F.when(F.col("valid"), F.col("tail_factor")).alias("expected"))
        fits = fit if fits is None else fits.unionByName(fit)
    fitted = good.join(fits, ["segment", "kind", "family"], "left").withColumn("capability", F.when(F.col("authoritative") == "value", "value-only").otherwise("exact"))
    return out.unionByName(_compared(fitted).select(*names)), errors
