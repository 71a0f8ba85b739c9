"""Development triangles as long tables of cells, for any number of segments at once.

A triangle's cells: ``segment, kind, origin, origin_idx, age, age_idx, value``; a null value can't be observed yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import CADENCE_MONTHS, finite, last_complete_month, month_index, period_index, period_label, safe_ratio

KINDS = ("paid", "incurred", "case_reserve", "reported_count", "open_count", "closed_count", "closed_with_pay_count")
CELL = ("segment", "origin_idx", "age_idx")
ROW = ("segment", "kind", "origin_idx")
COLUMN = ("segment", "kind", "age_idx")


def build_triangles(snapshots: DataFrame, as_of: str, cadence: str = "annual") -> DataFrame:
    """All seven triangles side by side: ``segment, origin, origin_idx, age, age_idx`` and a column per kind.

    A claim's state changes only at its snapshots: each change is added to the first age whose month-end lies on or after
    both the evaluation and the report, and a running sum over ages gives every cell. One shuffle by claim; all else are
    cells. Of snapshots of one date the last in input order holds; origin and report date are those of the first.
    Segments without a snapshot up to the as-of date, or without a complete age, have no cells (see ``build_errors``).
    """
    months, last_month = CADENCE_MONTHS[cadence], last_complete_month(as_of)
    kept = snapshots.filter(F.col("evaluation_date") <= F.lit(as_of).cast("date"))
    by_date = Window.partitionBy("segment", "claim_id").orderBy("evaluation_date", "seq")
    by_input = Window.partitionBy("segment", "claim_id").orderBy("seq")
    closed = (F.col("status") == "closed").cast("long")
    paid = F.col("paid_to_date")
    state = {
        "paid": paid,
        "case_reserve": F.when(F.col("status") == "open", F.col("case_reserve")).otherwise(0.0),
        "closed_count": closed,
        "closed_with_pay_count": F.when(paid > 0, closed).otherwise(0),
    }
    own = period_index("accident_date", cadence)
    steps = (
        kept.withColumns({"_period": own, "_origin": F.first(own).over(by_input), "_report": F.first("report_date").over(by_input)})
        .withColumns({"_at": F.row_number().over(by_date), **{f"_{k}": v for k, v in state.items()}})
        .withColumns({k: F.col(f"_{k}") - F.coalesce(F.lag(f"_{k}").over(by_date), F.lit(0)) for k in state})
    )
    start = F.col("_origin") * months

    def landing(date: Column) -> Column:
        return F.greatest(F.ceil((month_index(date) - start + 1) / months) - 1, F.lit(0)).cast("int")

    moves = steps.select(
        "segment", "_period", "_origin",
        F.explode(F.array(
            F.struct(landing(F.greatest("evaluation_date", "_report")).alias("age_idx"), *(F.col(k).cast("double").alias(k) for k in state), F.lit(0.0).alias("reported_count")),
            F.when(F.col("_at") == 1, F.struct(landing(F.col("_report")).alias("age_idx"), *(F.lit(0.0).alias(k) for k in state), F.lit(1.0).alias("reported_count"))),
        )).alias("m"),
    ).filter("m is not null")
    sums = moves.groupBy("segment", F.col("_origin").alias("period"), "m.age_idx").agg(
        *(F.sum(f"m.{k}").alias(k) for k in (*state, "reported_count")), F.min("_period").alias("lo"), F.max("_period").alias("hi")
    )
    spans = sums.groupBy("segment").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n_ages = F.floor((last_month - F.col("lo") * months + 1) / months).cast("int")
    spine = (
        spans.withColumn("n", n_ages).filter("n >= 1")
        .select("segment", "lo", "n", F.explode(F.sequence("lo", "hi")).alias("period"))
        .select("segment", "lo", "period", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("age_idx"))
    )
    running = Window.partitionBy("segment", "period").orderBy("age_idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.col("period") * months + (F.col("age_idx") + 1) * months - 1 <= last_month
    total = {k: F.when(seen, F.sum(F.coalesce(k, F.lit(0.0))).over(running)) for k in (*state, "reported_count")}
    cells = spine.join(sums.drop("lo", "hi"), ["segment", "period", "age_idx"], "left").withColumns(total)
    return cells.select(
        "segment",
        period_label("period", cadence).alias("origin"),
        (F.col("period") - F.col("lo")).alias("origin_idx"),
        ((F.col("age_idx") + 1) * months).alias("age"),
        "age_idx",
        "paid",
        (F.col("paid") + F.col("case_reserve")).alias("incurred"),
        "case_reserve",
        "reported_count",
        (F.col("reported_count") - F.col("closed_count")).alias("open_count"),
        "closed_count",
        "closed_with_pay_count",
    )


def build_errors(snapshots: DataFrame, as_of: str, cadence: str = "annual") -> DataFrame:
    """``segment, method, code, message`` for the segments that ``build_triangles`` can't build."""
    months, date = CADENCE_MONTHS[cadence], F.lit(as_of).cast("date")
    kept = F.min(F.when(F.col("evaluation_date") <= date, period_index("accident_date", cadence)))
    found = snapshots.groupBy("segment").agg(kept.alias("lo"))
    code = F.when(F.col("lo").isNull(), "NO_CLAIMS").when(last_complete_month(as_of) - F.col("lo") * months + 1 < months, "NO_DEVELOPMENT")
    said = F.when(F.col("code") == "NO_CLAIMS", "no snapshot on or before the as-of date").otherwise("no complete development age")
    return found.withColumn("code", code).filter("code is not null").select("segment", F.lit("build_triangles").alias("method"), "code", said.alias("message"))


def measure(triangles: DataFrame, kind: str) -> DataFrame:
    """One kind's cells."""
    return triangles.select("segment", F.lit(kind).alias("kind"), "origin", "origin_idx", "age", "age_idx", F.col(kind).cast("double").alias("value"))


def long_cells(triangles: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Several kinds' cells, below each other."""
    return triangles.unpivot(["segment", "origin", "origin_idx", "age", "age_idx"], list(kinds), "kind", "value").select(
        "segment", "kind", "origin", "origin_idx", "age", "age_idx", "value"
    )


def from_long(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) from ``segment, origin, age, value``: absent pairs are null; a repeated pair fails its segment."""
    twice = rows.groupBy("segment", "origin", "age").agg(F.count("*").alias("n")).filter("n > 1").select("segment").distinct()
    errors = twice.select("segment", F.lit("from_long").alias("method"), F.lit("SHAPE").alias("code"), F.lit("an origin and age occur twice").alias("message"))
    good = rows.join(twice, "segment", "left_anti")
    origins = good.select("segment", "origin").distinct().withColumn("origin_idx", F.row_number().over(Window.partitionBy("segment").orderBy("origin")) - 1)
    ages = good.select("segment", "age").distinct().withColumn("age_idx", F.row_number().over(Window.partitionBy("segment").orderBy("age")) - 1)
    cells = origins.join(ages, "segment").join(good.select("segment", "origin", "age", "value"), ["segment", "origin", "age"], "left")
    return cells.select("segment", F.lit(kind).alias("kind"), "origin", "origin_idx", "age", "age_idx", "value"), errors


def from_grid(rows: DataFrame, kind: str, ages: list[int]) -> tuple[DataFrame, DataFrame]:
    """(cells, errors) from ``segment, origin, origin_idx, vals``: one array per origin, as long as ``ages``."""
    bad = rows.filter(F.size("vals") != len(ages)).select("segment").distinct()
    errors = bad.select("segment", F.lit("from_grid").alias("method"), F.lit("SHAPE").alias("code"), F.lit("a row is not as long as the ages").alias("message"))
    cells = rows.join(bad, "segment", "left_anti").select("segment", "origin", "origin_idx", F.posexplode("vals").alias("age_idx", "value"))
    age = F.array(*map(F.lit, ages))[F.col("age_idx")]
    return cells.select("segment", F.lit(kind).alias("kind"), "origin", "origin_idx", age.alias("age"), "age_idx", F.col("value").cast("double").alias("value")), errors


def from_grid_rows(rows: DataFrame) -> DataFrame:
    """Cells from a row per origin: ``agesMonths`` and ``vals`` side by side, as long as each other; other columns stay."""
    return rows.select("*", F.posexplode("vals").alias("age_idx", "value")).withColumn("age", F.get(F.col("agesMonths"), F.col("age_idx"))).drop("vals", "agesMonths")


def incremental(cells: DataFrame) -> DataFrame:
    """Cumulative to incremental: the first cell as it is; null where this or the cell before is null."""
    before = F.lag(finite("value")).over(Window.partitionBy(*ROW).orderBy("age_idx"))
    return cells.withColumn("value", F.when(F.col("age_idx") == 0, finite("value")).otherwise(finite("value") - before))


def cumulative(cells: DataFrame) -> DataFrame:
    """Incremental to cumulative; from the first null on all is null."""
    running = Window.partitionBy(*ROW).orderBy("age_idx").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.sum(finite("value").isNull().cast("int")).over(running) > 0
    return cells.withColumn("value", F.when(~gone, F.sum(finite("value")).over(running)))


def paired(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cells with ``a`` and ``b``, errors): segments whose origins or ages differ fail with ``SHAPE``."""
    left = a.select(*CELL, "kind", "origin", "age", finite("value").alias("a"))
    right = b.select(*CELL, F.col("origin").alias("_origin"), F.col("age").alias("_age"), finite("value").alias("b"))
    both = left.join(right, list(CELL), "full_outer")
    odd = F.max((F.col("origin").isNull() | F.col("_origin").isNull() | (F.col("origin") != F.col("_origin")) | (F.col("age") != F.col("_age"))).cast("int"))
    bad = both.groupBy("segment").agg(odd.alias("odd")).filter("odd = 1").select("segment")
    errors = bad.select("segment", F.lit("paired").alias("method"), F.lit("SHAPE").alias("code"), F.lit("the triangles' origins or ages differ").alias("message"))
    return both.join(bad, "segment", "left_anti").drop("_origin", "_age"), errors


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b)[0].withColumn("value", F.col("a") + F.col("b")).drop("a", "b")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return paired(a, b)[0].withColumn("value", F.col("a") - F.col("b")).drop("a", "b")


def severity(loss: DataFrame, count: DataFrame) -> DataFrame:
    """Loss per claim, cell by cell."""
    return paired(loss, count)[0].withColumn("value", safe_ratio("a", "b")).drop("a", "b")


def ratio_grids(triangles: DataFrame) -> DataFrame:
    """Paid to incurred, closed to reported, and the average open case, cell by cell."""
    return triangles.select(
        "segment", "origin", "origin_idx", "age", "age_idx",
        safe_ratio("paid", "incurred").alias("paid_to_incurred"),
        safe_ratio("closed_count", "reported_count").alias("closed_to_reported"),
        safe_ratio(F.col("incurred") - F.col("paid"), "open_count").alias("average_open_case"),
    )


def latest(cells: DataFrame) -> DataFrame:
    """``segment, kind, origin, origin_idx`` with the last observed cell, or nulls where none is."""
    seen = cells.withColumn("value", finite("value"))
    last = F.max(F.when(F.col("value").isNotNull(), F.struct("age_idx", "age", "value")))
    return seen.groupBy("segment", "kind", "origin", "origin_idx").agg(last.alias("l")).select(
        "segment", "kind", "origin", "origin_idx", F.col("l.age_idx").alias("latest_idx"), F.col("l.age").alias("latest_age"), F.col("l.value").alias("latest")
    )


TRIANGLES_SQL = """
claim AS (
  SELECT segment, claim_id, year(arg_min(accident_date, seq)) AS oy, arg_min(report_date, seq) AS report FROM snap GROUP BY 1, 2
), rng AS (
  SELECT segment, min(year(accident_date)) AS y0, max(year(accident_date)) AS y1 FROM snap GROUP BY 1
), spine AS (
  SELECT segment, y0, oy, unnest(range(0, 2002 - y0)) AS age_idx FROM (SELECT segment, y0, unnest(range(y0, y1 + 1)) AS oy FROM rng)
), st AS (
  SELECT c.segment, c.oy, p.age_idx, c.claim_id, coalesce(arg_max(s.paid_to_date, s.seq), 0) AS paid,
         coalesce(arg_max(CASE WHEN s.status = 'open' THEN s.case_reserve ELSE 0 END, s.seq), 0) AS case_reserve,
         coalesce(arg_max(CASE WHEN s.status = 'closed' THEN 1 ELSE 0 END, s.seq), 0) AS closed
  FROM claim c JOIN spine p ON c.segment = p.segment AND c.oy = p.oy AND c.oy + p.age_idx <= 2001 AND c.report <= make_date(c.oy + p.age_idx, 12, 31)
  LEFT JOIN snap s ON s.segment = c.segment AND s.claim_id = c.claim_id AND s.evaluation_date <= make_date(c.oy + p.age_idx, 12, 31)
  GROUP BY 1, 2, 3, 4
), agg AS (
  SELECT segment, oy, age_idx, sum(paid) AS paid, sum(case_reserve) AS case_reserve, count(*) AS reported, sum(closed) AS closed,
         sum(CASE WHEN closed = 1 AND paid > 0 THEN 1 ELSE 0 END) AS closed_pay
  FROM st GROUP BY 1, 2, 3
), tri AS (
  SELECT p.segment, CAST(p.oy AS VARCHAR) AS origin, CAST(p.oy - p.y0 AS INTEGER) AS origin_idx, CAST(12 * (p.age_idx + 1) AS INTEGER) AS age, CAST(p.age_idx AS INTEGER) AS age_idx,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(paid, 0)::DOUBLE END AS paid,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(paid + case_reserve, 0)::DOUBLE END AS incurred,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(case_reserve, 0)::DOUBLE END AS case_reserve,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(reported, 0)::DOUBLE END AS reported_count,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(reported - closed, 0)::DOUBLE END AS open_count,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(closed, 0)::DOUBLE END AS closed_count,
         CASE WHEN p.oy + p.age_idx <= 2001 THEN coalesce(closed_pay, 0)::DOUBLE END AS closed_with_pay_count
  FROM spine p LEFT JOIN agg a USING (segment, oy, age_idx)
)"""
