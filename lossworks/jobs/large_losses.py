"""Large losses: latest snapshots, caps, size diagnostics, survival quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.functions.order import at_ranks, in_buckets, running
from lossworks.functions.tables import broadcast_if_small, written

PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
ANCHORS = (0.75, 0.9, 0.95, 0.99)


def latest_snapshots(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """One snapshot per claim: the latest up to the as-of date, of equal dates the first in input order.

    An aggregate that combines before the shuffle, not a window.
    """
    rows = snapshots if as_of is None else snapshots.filter(F.col("evaluation_date") <= F.lit(as_of).cast("date"))
    names = [c for c in snapshots.columns if c not in ("segment", "claim_id")]
    best = F.max_by(F.struct(*names), F.struct("evaluation_date", (-F.col("seq")).alias("first")))
    return rows.groupBy("segment", "claim_id").agg(best.alias("s")).select("segment", "claim_id", "s.*")


def latest_accident_year(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    rows = snapshots if as_of is None else snapshots.filter(F.col("evaluation_date") <= F.lit(as_of).cast("date"))
    return rows.groupBy("segment").agg(F.max(F.year("accident_date")).alias("base_year"))


def cap_claims(snapshots: DataFrame, cap: float, index_rate: float = 0.0, base_year: int | None = None) -> DataFrame:
    """Snapshots with paid and case amounts capped at cap x (1 + rate)^(accident year - base year).

    The base year is the segment's latest accident year where none is given. Dates and statuses stay.
    """
    if not cap > 0:
        raise ValueError("BAD_CAP: the cap must be positive")
    if not index_rate > -1:
        raise ValueError("BAD_INDEX: the index rate must be above -1")
    rows = snapshots
    if base_year is None:
        rows = rows.join(latest_accident_year(snapshots), "segment")
    else:
        rows = rows.withColumn("base_year", F.lit(base_year))
    limit = F.lit(float(cap)) * F.pow(F.lit(1.0 + index_rate), F.year("accident_date") - F.col("base_year"))
    paid, whole = F.least("paid_to_date", "_cap"), F.least(F.col("paid_to_date") + F.col("case_reserve"), "_cap")
    return rows.withColumn("_cap", limit).withColumns({"case_reserve": whole - paid, "paid_to_date": paid}).select(*snapshots.columns)


def size_by_year(snapshots: DataFrame, as_of: str | None = None) -> DataFrame:
    """``segment, year, claim_count, total_incurred, max_claim, nonzero_count`` and ceil-rank percentiles."""
    rows = latest_snapshots(snapshots, as_of).select("segment", F.year("accident_date").alias("year"), (F.col("paid_to_date") + F.col("case_reserve")).alias("incurred"))
    sizes = rows.groupBy("segment", "year").agg(
        F.count("*").alias("claim_count"), F.sum("incurred").alias("total_incurred"), F.max("incurred").alias("max_claim"), F.count_if(F.col("incurred") > 0).alias("nonzero_count")
    )
    ranks = at_ranks(rows, ["segment", "year"], "incurred", {f"p{round(p * 100)}": p for p in PERCENTILES}).withColumnsRenamed({"segment": "_segment", "year": "_year"})
    same = F.col("segment").eqNullSafe(F.col("_segment")) & F.col("year").eqNullSafe(F.col("_year"))
    return sizes.join(ranks, same, "left").drop("_segment", "_year")


def nice(value: Column) -> Column:
    """Rounded to 1, 2.5, 5 or 10 times a power of ten; fixed values: these steps and the bounds between them."""
    size = F.pow(F.lit(10.0), F.floor(F.log10(value)))
    scaled = value / size
    return F.when(value > 0, F.when(scaled < 1.5, 1.0).when(scaled < 3.5, 2.5).when(scaled < 7.5, 5.0).otherwise(10.0) * size).otherwise(0.0)


def candidate_caps(snapshots: DataFrame, as_of: str | None = None, index_rate: float = 0.0, extra: tuple[float, ...] = ()) -> DataFrame:
    """``segment, cap``: rounded upper percentiles of the positive sizes at base-year level, and the extra ones."""
    rows = latest_snapshots(snapshots, as_of).join(latest_accident_year(snapshots, as_of), "segment")
    level = F.pow(F.lit(1.0 + index_rate), F.year("accident_date") - F.col("base_year"))
    rows = rows.select("segment", ((F.col("paid_to_date") + F.col("case_reserve")) / level).alias("size")).filter("size > 0")
    found = at_ranks(rows, ["segment"], "size", {f"a{k}": p for k, p in enumerate(ANCHORS)})
    caps = found.select("segment", F.explode(F.array(*(nice(F.col(f"a{k}")) for k in range(len(ANCHORS))))).alias("cap"))
    if more := [float(x) for x in extra if x > 0]:
        caps = caps.union(found.select("segment", F.explode(F.array(*map(F.lit, more))).alias("cap")))
    return caps.filter("cap > 0").distinct()


def cap_candidates(snapshots: DataFrame, caps: DataFrame, as_of: str | None = None, index_rate: float = 0.0) -> DataFrame:
    """Per segment, cap and year (null: all): effective cap, claims above it, their share, and the excess share.

    The caps (a few per segment) travel to the claims as one array, and each year's sums are arrays with a place per cap:
    claims shuffle once, by year, after combining, and are never multiplied by caps.
    """
    menu = caps.groupBy("segment").agg(F.sort_array(F.collect_set("cap")).alias("caps")).join(latest_accident_year(snapshots, as_of), "segment")
    menu = written(menu, "caps")
    most = menu.agg(F.max(F.size("caps"))).first()[0] or 1  # the longest menu: a handful
    rows = latest_snapshots(snapshots, as_of).join(broadcast_if_small(menu), "segment")
    rows = rows.select("segment", "caps", F.year("accident_date").alias("year"), "base_year", (F.col("paid_to_date") + F.col("case_reserve")).alias("v"))
    level = F.pow(F.lit(1.0 + index_rate), F.col("year") - F.col("base_year"))
    limits = [F.get("caps", F.lit(k)) * level for k in range(most)]
    sums = [F.array(*(F.count_if(F.col("v") > x) for x in limits)).alias("pierced"), F.array(*(F.sum(F.when(F.col("v") > x, F.col("v") - x).otherwise(0.0)) for x in limits)).alias("excess")]
    years = rows.groupBy("segment", "year", "caps", "base_year").agg(F.count("*").alias("n"), F.sum("v").alias("incurred"), *sums)
    out = years.select("segment", "year", "base_year", "n", "incurred", "pierced", "excess", F.posexplode("caps").alias("k", "cap")).select(
        "segment", "cap", "year", (F.col("cap") * level).alias("effective_cap"), "n", F.get("pierced", F.col("k")).alias("pierce_count"), F.get("excess", F.col("k")).alias("excess"), "incurred"
    )
    whole = out.groupBy("segment", "cap").agg(*(F.sum(c).alias(c) for c in ("n", "pierce_count", "excess", "incurred"))).select("segment", "cap", F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("effective_cap"), "n", "pierce_count", "excess", "incurred")
    share = F.when(F.col("incurred") > 0, F.col("excess") / F.col("incurred")).otherwise(0.0)
    return out.unionByName(whole).select("segment", "cap", "year", "effective_cap", "pierce_count", (F.col("pierce_count") / F.col("n")).alias("pierce_share"), share.alias("excess_share"))


def severity_observations(snapshots: DataFrame, base_year: int, as_of: str | None = None, index_rate: float = 0.0) -> DataFrame:
    """``segment, value, censored``: latest sizes at base-year level; open claims are censored."""
    level = F.pow(F.lit(1.0 + index_rate), F.year("accident_date") - F.lit(base_year))
    return latest_snapshots(snapshots, as_of).select("segment", ((F.col("paid_to_date") + F.col("case_reserve")) / level).alias("value"), (F.col("status") == "open").alias("censored"))


def survival(observations: DataFrame) -> DataFrame:
    """``segment, value, events, at_risk, survival``: the product limit at each distinct closed value.

    Values are counted first, and the counts run over range buckets: no task holds a segment's values.
    """
    counts = observations.filter(finite("value").isNotNull()).groupBy("segment", "value").agg(F.count_if(~F.col("censored")).alias("events"), F.count("*").alias("n"))
    counts = running(in_buckets(counts, ["segment"], ["value"]), ["segment"], ["value"], sums={"upto": "n"})
    whole = counts.groupBy("segment").agg(F.sum("n").alias("whole")).withColumnRenamed("segment", "_segment")
    seen = counts.join(whole, F.col("segment").eqNullSafe(F.col("_segment"))).drop("_segment").withColumn("at_risk", F.col("whole") - F.col("upto") + F.col("n")).filter("events > 0")
    out = running(seen, ["segment"], ["value"], products={"survival": 1 - F.col("events") / F.col("at_risk")})
    return out.select("segment", "value", "events", "at_risk", "survival")


def survival_quantiles(observations: DataFrame, probes: tuple[float, ...]) -> DataFrame:
    """``segment, p, quantile``: the first value whose survival is at most 1 - p; null where none is."""
    curve = survival(observations)
    each = F.explode(F.array(*map(F.lit, probes))).alias("p")
    return curve.select("segment", "value", "survival", each).groupBy("segment", "p").agg(F.min(F.when(F.col("survival") <= 1 - F.col("p") + 1e-12, F.col("value"))).alias("quantile"))
