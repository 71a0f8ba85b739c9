"""Link ratios and their averages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite, safe_ratio
from lossworks.operators.triangles import COLUMN, ROW


@dataclass(frozen=True)
class Average:
    """An average of a column's link ratios; ``years`` counts origin periods up to the last one that has a ratio."""

    key: str
    kind: str  # weighted, straight, medial or geometric
    years: int | None = None


#: Fixed menu of averages.
DEFAULT_AVERAGES = (
    Average("all-wtd", "weighted"),
    Average("all-str", "straight"),
    Average("5-wtd", "weighted", 5),
    Average("5-str", "straight", 5),
    Average("3-wtd", "weighted", 3),
    Average("3-str", "straight", 3),
    Average("med-5x1", "medial", 5),
    Average("geo-all", "geometric"),
)


def link_ratios(cells: DataFrame) -> DataFrame:
    """``segment, kind, origin, origin_idx, age_idx, from_age, to_age, c0, c1, ldf`` for every column but the last."""
    row = Window.partitionBy(*ROW).orderBy("age_idx")
    out = cells.withColumn("value", finite("value")).withColumns({"c1": F.lead("value").over(row), "to_age": F.lead("age").over(row)})
    return out.filter("to_age is not null").select(
        "segment", "kind", "origin", "origin_idx", "age_idx", F.col("age").alias("from_age"), "to_age", F.col("value").alias("c0"), "c1",
        safe_ratio("c1", "value").alias("ldf"),
    )


def averages(ratios: DataFrame, menu: tuple[Average, ...] = DEFAULT_AVERAGES) -> DataFrame:
    """``segment, kind, age_idx, from_age, to_age, avg_key, value``: one aggregate for the whole menu."""
    column = Window.partitionBy(*COLUMN)
    last = F.max(F.when(F.col("ldf").isNotNull(), F.col("origin_idx"))).over(column)
    marked = ratios.withColumn("_last", last)
    windows = sorted({a.years for a in menu}, key=lambda y: (y is not None, y))
    name = lambda y, what: f"_{what}_{y or 'all'}"
    aggs = []
    for y in windows:
        use = F.col("ldf").isNotNull() if y is None else F.col("ldf").isNotNull() & (F.col("origin_idx") > F.col("_last") - y)
        f = F.when(use, F.col("ldf"))
        aggs += [
            F.count(f).alias(name(y, "n")), F.sum(f).alias(name(y, "s")), F.min(f).alias(name(y, "lo")), F.max(f).alias(name(y, "hi")),
            F.sum(F.when(use, F.col("c1"))).alias(name(y, "num")), F.sum(F.when(use, F.col("c0"))).alias(name(y, "den")),
            F.sum(F.when(use & (F.col("ldf") > 0), F.ln("ldf"))).alias(name(y, "ln")),
        ]
    sums = marked.groupBy(*COLUMN, "from_age", "to_age").agg(*aggs)

    def value(a: Average):
        n, s, lo, hi, num, den, ln = (F.col(name(a.years, w)) for w in ("n", "s", "lo", "hi", "num", "den", "ln"))
        return {
            "straight": F.when(n > 0, s / n),
            "weighted": F.when(den > 0, num / den),
            "medial": F.when(n > 2, (s - lo - hi) / (n - 2)).when(n > 0, s / n),
            "geometric": F.when((n > 0) & (lo > 0), F.exp(ln / n)),
        }[a.kind]

    each = F.explode(F.array(*(F.struct(F.lit(a.key).alias("avg_key"), value(a).alias("value")) for a in menu)))
    return sums.select(*COLUMN, "from_age", "to_age", each.alias("a")).select(*COLUMN, "from_age", "to_age", "a.avg_key", "a.value")


def volatility(ratios: DataFrame) -> DataFrame:
    """``segment, kind, age_idx, cv``: the ratios' sample deviation over their mean; null below two or at mean 0."""
    out = ratios.groupBy(*COLUMN).agg(F.count("ldf").alias("n"), F.stddev_samp("ldf").alias("sd"), F.avg("ldf").alias("mean"))
    return out.select(*COLUMN, F.when((F.col("n") > 1) & (F.col("mean") != 0), F.col("sd") / F.abs("mean")).alias("cv"))


RATIOS_SQL = """
ldf AS (
  SELECT segment, origin, origin_idx, age_idx, age AS from_age, lead(age) OVER w AS to_age, v AS c0, lead(v) OVER w AS c1,
         CASE WHEN v > 0 THEN lead(v) OVER w / v END AS ldf
  FROM (SELECT *, {kind} AS v FROM tri) WINDOW w AS (PARTITION BY segment, origin_idx ORDER BY age_idx)
  QUALIFY to_age IS NOT NULL
)"""
