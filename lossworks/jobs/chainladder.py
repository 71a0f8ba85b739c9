"""Selections and the chain ladder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.operators.factors import averages, link_ratios
from lossworks.operators.triangles import latest


def selected(cells: DataFrame, avg_key: str = "all-wtd") -> DataFrame:
    """``segment, kind, age_idx, from_age, to_age, ldf``: one average of the menu as the selection."""
    return averages(link_ratios(cells)).filter(F.col("avg_key") == avg_key).select("segment", "kind", "age_idx", "from_age", "to_age", F.col("value").alias("ldf"))


def cdfs(cells: DataFrame, selections: DataFrame, tail: float | DataFrame = 1.0) -> DataFrame:
    """``segment, kind, age_idx, age, f, cdf``: factors to ultimate from each age; missing or non-positive ones are 1.

    ``tail`` is a number or a table ``segment, kind, tail_factor``. Segments without any selection have no rows.
    """
    if not isinstance(tail, DataFrame) and not tail > 0:
        raise ValueError("BAD_TAIL: the tail factor must be positive")
    ages = cells.select("segment", "kind", "age_idx", "age").distinct()
    out = ages.join(selections.select("segment", "kind", "age_idx", finite("ldf").alias("_ldf")), ["segment", "kind", "age_idx"], "left")
    own = Window.partitionBy("segment", "kind")
    out = out.withColumn("_any", (F.count("_ldf").over(own) > 0) | (F.max("age_idx").over(own) == 0)).filter("_any")
    if isinstance(tail, DataFrame):
        out = out.join(tail.select("segment", "kind", F.col("tail_factor").alias("_tail")), ["segment", "kind"], "left").withColumn("_tail", F.coalesce("_tail", F.lit(1.0)))
    else:
        out = out.withColumn("_tail", F.lit(float(tail)))
    onward = own.orderBy("age_idx").rowsBetween(0, Window.unboundedFollowing)
    f = F.when(F.col("_ldf") > 0, F.col("_ldf")).otherwise(1.0)
    return out.withColumn("f", f).select("segment", "kind", "age_idx", "age", "f", (F.product("f").over(onward) * F.col("_tail")).alias("cdf"))


def chain_ladder(cells: DataFrame, selections: DataFrame, tail: float | DataFrame = 1.0) -> DataFrame:
    """A row per origin: ``latest_age, latest, cdf, percent_developed, ultimate, unpaid``; empty origins have none."""
    found = latest(cells).filter("latest is not null")
    factors = cdfs(cells, selections, tail).select("segment", "kind", F.col("age_idx").alias("latest_idx"), "cdf")
    ultimate = F.col("latest") * F.col("cdf")
    return found.join(factors, ["segment", "kind", "latest_idx"]).select(
        "segment", "kind", "origin", "origin_idx", "latest_age", "latest", "cdf", (1 / F.col("cdf")).alias("percent_developed"),
        ultimate.alias("ultimate"), (ultimate - F.col("latest")).alias("unpaid"),
    )


def totals(rows: DataFrame, *amounts: str) -> DataFrame:
    """The rows' amounts per origin and, with a null origin, per segment."""
    return rows.rollup("segment", "origin").agg(*(F.sum(a).alias(a) for a in amounts)).filter("segment is not null")


def warnings(cells: DataFrame, selections: DataFrame) -> DataFrame:
    """``segment, method, code, message``: replaced selections, empty origins, and segments without any selection."""
    bad = F.when(finite("ldf").isNull(), "MISSING_SELECTION").when(F.col("ldf") <= 0, "BAD_SELECTION")
    spans = F.concat_ws("-", F.col("from_age").cast("string"), F.col("to_age").cast("string"))
    replaced = selections.withColumn("code", bad).filter("code is not null").select("segment", "code", F.concat(F.lit("factor treated as 1 for ages "), spans).alias("message"))
    empty = latest(cells).filter("latest is null").select("segment", F.lit("EMPTY_ORIGIN").alias("code"), F.concat(F.lit("no observed value in "), F.col("origin")).alias("message"))
    none = selections.groupBy("segment").agg(F.count(finite("ldf")).alias("n")).filter("n = 0").select("segment", F.lit("NO_SELECTIONS").alias("code"), F.lit("no factor is selected").alias("message"))
    out = replaced.unionByName(empty).unionByName(none)
    return out.select("segment", F.lit("chain_ladder").alias("method"), "code", "message")


#: Chain ladder on ``tri.{kind}`` with all-year weighted factors, for SQL twins; needs RATIOS_SQL before it.
CHAIN_LADDER_SQL = """
sel AS (
  SELECT segment, age_idx, sum(c1) FILTER (ldf IS NOT NULL) / sum(c0) FILTER (ldf IS NOT NULL) AS f FROM ldf GROUP BY 1, 2
), cdf AS (
  SELECT segment, age_idx, age, product(coalesce(f, 1)) OVER (PARTITION BY segment ORDER BY age_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS cdf
  FROM (SELECT DISTINCT segment, age_idx, age FROM tri) LEFT JOIN sel USING (segment, age_idx)
), lat AS (
  SELECT segment, origin, origin_idx, max(age_idx) AS latest_idx, max(age) AS latest_age, arg_max({kind}, age_idx) AS latest
  FROM tri WHERE {kind} IS NOT NULL GROUP BY 1, 2, 3
), cl AS (
  SELECT lat.segment, origin, origin_idx, latest_idx, latest_age, latest, cdf.cdf, latest * cdf.cdf AS ultimate, latest * cdf.cdf - latest AS unpaid
  FROM lat JOIN cdf ON lat.segment = cdf.segment AND lat.latest_idx = cdf.age_idx
)"""
