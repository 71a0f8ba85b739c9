"""Running totals in an order, where one group may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.tables import written


def in_buckets(rows: DataFrame, groups: list[str], order: list[Column | str]) -> DataFrame:
    """``rows``, written with ``bucket``: dealt by ranges of (groups, order), so that a group's buckets follow its order.

    Rows of equal groups and order are in one bucket. The ranges only steer the load; totals don't depend on them.
    """
    return written(rows.repartitionByRange(*groups, *order).withColumn("bucket", F.spark_partition_id()), "buckets")


def running(rows: DataFrame, groups: list[str], order: list[Column | str], sums: dict[str, Column | str] | None = None, products: dict[str, Column | str] | None = None) -> DataFrame:
    """``rows`` of ``in_buckets`` with running sums and products of non-null values, up to and with the row.

    Each bucket gives one total, which run within a group (as many rows as buckets); a window within (group, bucket) does
    the rest, so no task holds more than a bucket. Within a group no two rows have equal orders. A null group is a group.
    """
    values = {k: (F.sum, v, F.lit(0)) for k, v in (sums or {}).items()} | {k: (F.product, v, F.lit(1.0)) for k, v in (products or {}).items()}
    keys = [*groups, "bucket"]
    before = Window.partitionBy(*groups).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys).agg(*(total(v).alias(f"_{name}") for name, (total, v, _) in values.items()))
    starts = totals.select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.coalesce(total(f"_{name}").over(before), none).alias(f"_{name}") for name, (total, _, none) in values.items()))
    out = rows.withColumns({name: total(v).over(own) for name, (total, v, _) in values.items()})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = out.join(starts, same).drop(*(f"_{k}" for k in keys))
    joined = {name: (F.col(f"_{name}") * F.col(name) if total is F.product else F.col(f"_{name}") + F.col(name)) for name, (total, _, _) in values.items()}
    return out.withColumns(joined).drop(*(f"_{name}" for name in values))


def _counted(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Per group and distinct value ``_upto``, the number of rows up to it, and ``_all``; nulls left out.

    Rows are counted per distinct value first, and these counts run over range buckets.
    """
    counts = in_buckets(rows.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_n")), groups, [value])
    upto = running(counts, groups, [value], sums={"_upto": "_n"})
    whole = counts.groupBy(*groups).agg(F.sum("_n").alias("_all")).select(*(F.col(g).alias(f"_{g}") for g in groups), "_all")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return upto.join(whole, same)


def at_ranks(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group: for each of ``shares`` the value of rank ceil(share x number of rows), nulls left out."""
    at = {name: F.min(F.when(F.col("_upto") >= F.ceil(F.lit(p) * F.col("_all")), F.col(value))) for name, p in shares.items()}
    return _counted(rows, groups, value).groupBy(*groups).agg(*(v.alias(name) for name, v in at.items()))


def percentiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group: for each of ``shares`` the value at place share x (rows - 1), between two ranks in proportion.

    The two ranks next to a place are looked up in running counts: no task holds a group's values, however many they are.
    """
    counted = _counted(rows, groups, value)
    place = {name: F.lit(float(p)) * (F.col("_all") - 1) for name, p in shares.items()}
    ranks = [F.min(F.when(F.col("_upto") > f(x), F.col(value))).alias(f"_{k}_{name}") for name, x in place.items() for k, f in (("lo", F.floor), ("hi", F.ceil))]
    found = counted.groupBy(*groups).agg(*ranks, F.first("_all").alias("_all"))
    between = [(F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (x - F.floor(x))).alias(name) for name, x in place.items()]
    return found.select(*groups, *between)
