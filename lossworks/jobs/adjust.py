"""Case outstanding development, and reserves net of recoveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite, safe_ratio
from lossworks.operators.triangles import ROW, paired

SEG = ["segment", "kind"]


def case_ratios(paid: DataFrame, case: DataFrame) -> DataFrame:
    """``case_ratio`` (next case to case) and ``paid_on_case`` (paid in between to case) of every interval."""
    row = Window.partitionBy(*ROW).orderBy("age_idx")
    both = paired(paid, case)[0].withColumns({"_p": F.lead("a").over(row), "_c": F.lead("b").over(row), "to_age": F.lead("age").over(row)}).filter("to_age is not null")
    return both.select(*SEG, "origin", "origin_idx", "age_idx", F.col("age").alias("from_age"), "to_age", safe_ratio("_c", "b").alias("case_ratio"), safe_ratio(F.col("_p") - F.col("a"), F.col("b")).alias("paid_on_case"))


def case_outstanding(paid: DataFrame, case: DataFrame, selections: DataFrame, tail_paid_on_case: float = 1.0) -> DataFrame:
    """A row per origin: ``latest_age, paid_to_date, case_outstanding, future_paid, unpaid, ultimate``.

    From the last age that both triangles show, case runs off by the selected case ratios and each interval pays the
    selected part of the case before it; the tail pays the rest. ``selections``: segment, age_idx, case_ratio (missing: 1,
    negative: 0), paid_on_case (missing: 0).
    """
    both = paired(paid, case)[0]
    ages = both.groupBy(*SEG).agg(F.max("age_idx").alias("_end"))
    at = F.max(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct("age_idx", "age", "a", "b")))
    seed = both.groupBy(*SEG, "origin", "origin_idx").agg(at.alias("s")).filter("s is not null").select(*SEG, "origin", "origin_idx", F.col("s.age_idx").alias("_k"), F.col("s.age").alias("latest_age"), F.col("s.a").alias("paid_to_date"), F.col("s.b").alias("case_outstanding"))
    own = selections.select("segment", F.col("age_idx").alias("_j"), F.greatest(F.coalesce(finite("case_ratio"), F.lit(1.0)), F.lit(0.0)).alias("_cr"), F.coalesce(finite("paid_on_case"), F.lit(0.0)).alias("_pr"))
    steps = seed.join(ages, SEG).select("*", F.explode(F.sequence(F.col("_k"), F.col("_end"))).alias("_j")).join(own, ["segment", "_j"], "left")
    order = Window.partitionBy(*SEG, "origin_idx").orderBy("_j")
    last = F.col("_j") == F.col("_end")
    before = F.coalesce(F.product(F.coalesce("_cr", F.lit(1.0))).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    flow = F.col("case_outstanding") * before * F.when(last, F.lit(float(tail_paid_on_case))).otherwise(F.coalesce("_pr", F.lit(0.0)))
    out = steps.withColumn("_flow", flow).groupBy(*SEG, "origin", "origin_idx", "latest_age", "paid_to_date", "case_outstanding").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_j", "_flow"))), lambda x: x["_flow"]).alias("future_paid"), F.sum("_flow").alias("unpaid")
    )
    return out.withColumn("ultimate", F.col("paid_to_date") + F.col("unpaid"))


def net_of_recoveries(gross: DataFrame, recoveries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings): chain-ladder rows of gross less those of recoveries; origins on one side only are left out."""
    names = ("latest", "ultimate", "unpaid")
    a = gross.select("segment", "origin", *(F.col(c).alias(f"gross_{c}") for c in names))
    b = recoveries.select("segment", "origin", *(F.col(c).alias(f"recovered_{c}") for c in names))
    both = a.join(b, ["segment", "origin"], "full_outer")
    here = F.col("gross_latest").isNotNull() & F.col("recovered_latest").isNotNull()
    rows = both.filter(here).select("segment", "origin", *(F.col(f"gross_{c}") for c in names), *(F.col(f"recovered_{c}") for c in names), *((F.col(f"gross_{c}") - F.col(f"recovered_{c}")).alias(f"net_{c}") for c in names))
    side = F.when(F.col("gross_latest").isNull(), "no gross row").otherwise("no recovery row")
    return rows, both.filter(~here).select("segment", F.lit("net_of_recoveries").alias("method"), F.lit("UNALIGNED").alias("code"), F.concat(side, F.lit(" for "), "origin").alias("message"))


def fisher_lange(paid: DataFrame, closed: DataFrame, ultimate_counts: DataFrame, severity_trend: float) -> DataFrame:
    """A row per origin: ``latest_age, paid_to_date, ultimate_counts, unpaid, ultimate``.

    Future closures are the ultimate counts (segment, origin, ultimate_counts) times each age's latest disposal rate; each
    costs the age's severity, trended by calendar months from the observed ones. Ages must be equally spaced.
    """
    if not severity_trend > -1:
        raise ValueError("BAD_TREND: the severity trend must be above -1")
    growth = F.lit(1.0 + severity_trend)
    row = Window.partitionBy(*ROW).orderBy("age_idx")
    both = paired(paid, closed)[0]
    first = F.col("age_idx") == 0
    both = both.withColumns({
        "_p": F.when(first, F.col("a")).otherwise(F.col("a") - F.lag("a").over(row)), "_c": F.when(first, F.col("b")).otherwise(F.col("b") - F.lag("b").over(row)),
        "_step": F.col("age") - F.lag("age").over(row),
    })
    steps = both.groupBy(*SEG).agg(F.min("_step").alias("step"), F.max("_step").alias("_most")).filter("step = _most").drop("_most")
    both = both.join(steps, SEG).withColumn("cal", F.col("origin_idx") * F.col("step") + F.col("age"))
    both = both.join(ultimate_counts.select("segment", "origin", finite("ultimate_counts").alias("u")).filter("u >= 0"), ["segment", "origin"])
    both = both.withColumn("ref", F.max(F.when(F.col("_p").isNotNull() | F.col("_c").isNotNull(), F.col("cal"))).over(Window.partitionBy(*SEG)))
    good = F.col("_c") > 0
    rate = F.when(F.col("u") > 0, F.col("_c") / F.col("u"))
    ages = both.groupBy(*SEG, F.col("age_idx").alias("_j"), F.col("age").alias("_age")).agg(
        F.max_by(rate, F.when(rate.isNotNull(), F.col("origin_idx"))).alias("_d"),
        (F.sum(F.when(good, F.col("_p") * F.pow(growth, (F.col("ref") - F.col("cal")) / 12.0))) / F.sum(F.when(good & F.col("_p").isNotNull(), F.col("_c")))).alias("_s"),
    )
    at = F.max(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.struct("age_idx", "age", "a")))
    seed = both.groupBy(*SEG, "origin", "origin_idx", "step", "ref", "u").agg(at.alias("s")).filter("s is not null")
    rows = seed.join(ages, SEG, "left")
    ahead = F.col("_j") > F.col("s.age_idx")
    cost = F.col("u") * F.col("_d") * F.col("_s") * F.pow(growth, (F.col("origin_idx") * F.col("step") + F.col("_age") - F.col("ref")) / 12.0)
    out = rows.groupBy(*SEG, "origin", "origin_idx", F.col("s.age").alias("latest_age"), F.col("s.a").alias("paid_to_date"), F.col("u").alias("ultimate_counts")).agg(F.sum(F.when(ahead, F.coalesce(cost, F.lit(0.0))).otherwise(0.0)).alias("unpaid"))
    return out.withColumn("ultimate", F.col("paid_to_date") + F.col("unpaid"))


def case_adequacy(triangles: DataFrame, severity_trend: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(adjusted incurred cells, trends): average open cases restated to the latest diagonal's level.

    The trend is given, or the point-weighted mean of the columns' log-linear yearly trends (three points at least each,
    else 0). Each cell is paid plus open claims at the diagonal's average, deflated by the years between; without open
    claims it is paid, and without a diagonal average the incurred value stays.
    """
    cells = triangles.select("segment", "origin", "origin_idx", "age", "age_idx", *(finite(c).alias(c) for c in ("paid", "incurred", "open_count")))
    cells = cells.withColumns({"avg": safe_ratio(F.col("incurred") - F.col("paid"), F.col("open_count")), "_years": F.min("age").over(Window.partitionBy("segment")) / 12.0})
    y = F.when(F.col("avg") > 0, F.ln("avg"))
    columns = cells.withColumn("y", y).groupBy("segment", "age_idx", "_years").agg(F.count("y").alias("n"), F.regr_slope("y", "origin_idx").alias("b")).filter("n >= 3 and b is not null")
    fitted = columns.groupBy("segment").agg((F.sum((F.exp(F.col("b") / F.col("_years")) - 1) * F.col("n")) / F.sum("n")).alias("_fit"))
    trends = cells.select("segment").distinct().join(fitted, "segment", "left").select("segment", F.coalesce(F.lit(severity_trend).cast("double"), "_fit", F.lit(0.0)).alias("trend")).filter("trend > -1")
    column = Window.partitionBy("segment", "age_idx")
    has = F.when(F.col("open_count").isNotNull(), F.col("origin_idx"))
    rows = cells.join(trends, "segment").withColumns({"_row": F.max(has).over(column), "_diag": F.max_by("avg", has).over(column)})
    level = F.col("_diag") / F.pow(1 + F.col("trend"), (F.col("_row") - F.col("origin_idx")) * F.col("_years"))
    value = (
        F.when(F.col("paid").isNull() | F.col("open_count").isNull(), F.lit(None).cast("double")).when(F.col("open_count") == 0, F.col("paid"))
        .when(F.col("_diag").isNull(), F.col("incurred")).otherwise(F.col("paid") + level * F.col("open_count"))
    )
    return rows.select("segment", F.lit("incurred").alias("kind"), "origin", "origin_idx", "age", "age_idx", value.alias("value")), trends


def settlement(paid: DataFrame, closed: DataFrame, ultimate_counts: DataFrame, exponential: bool = True) -> DataFrame:
    """Paid cells restated to the latest diagonal's disposal rates.

    A cell's closed counts become its age's latest rate times the origin's ultimate counts; paid is read off the origin's
    own (closed, paid) points: a point hit exactly, between two, from the origin (0, 0) below the first, and along the last
    two beyond the end. Of points with equal counts the one with the larger paid amount counts. Cells without a target keep
    their value; none falls below 0. A triangle's row has few points, so each cell meets those of its own origin only.
    """
    both = paired(paid, closed)[0].join(ultimate_counts.select("segment", "origin", finite("ultimate_counts").alias("u")), ["segment", "origin"], "left")
    has = F.when(F.col("b").isNotNull(), F.col("origin_idx"))
    rate = F.when(F.col("u") > 0, F.col("b") / F.col("u"))
    both = both.withColumn("_rate", F.max_by(rate, has).over(Window.partitionBy("segment", "age_idx")))
    both = both.withColumn("_x", F.when(F.col("b").isNotNull() & (F.col("u") > 0), F.col("_rate") * F.col("u")))
    points = both.filter("a is not null and b is not null").groupBy("segment", "origin_idx", F.col("b").alias("_px")).agg(F.max("a").alias("_py"))
    points = points.withColumns({"_lx": F.lag("_px").over(Window.partitionBy("segment", "origin_idx").orderBy("_px")), "_ly": F.lag("_py").over(Window.partitionBy("segment", "origin_idx").orderBy("_px"))})
    met = both.join(points, ["segment", "origin_idx"], "left")
    gap, point = F.col("_px") - F.col("_x"), F.struct("_px", "_py", "_lx", "_ly")
    near = met.groupBy(*(c for c in both.columns)).agg(
        F.max(F.when(F.abs(gap) < 1e-9, F.col("_py"))).alias("_hit"), F.max_by(point, F.when(gap < 0, F.col("_px"))).alias("_low"), F.min_by(point, F.when(gap > 0, F.col("_px"))).alias("_high"),
        F.count_if(gap < 0).alias("_nl"), F.count_if(gap > 0).alias("_nh"),
    )
    zero = F.lit(0.0)
    x1 = F.when(F.col("_nl") == 0, zero).when(F.col("_nh") == 0, F.coalesce("_low._lx", zero)).otherwise(F.col("_low._px"))
    y1 = F.when(F.col("_nl") == 0, zero).when(F.col("_nh") == 0, F.coalesce("_low._ly", zero)).otherwise(F.col("_low._py"))
    x2 = F.when(F.col("_nh") == 0, F.col("_low._px")).otherwise(F.col("_high._px"))
    y2 = F.when(F.col("_nh") == 0, F.col("_low._py")).otherwise(F.col("_high._py"))
    out = near.withColumns({"_x1": x1, "_y1": y1, "_x2": x2, "_y2": y2})
    part = F.when(F.col("_x2") != F.col("_x1"), (F.col("_x") - F.col("_x1")) / (F.col("_x2") - F.col("_x1"))).otherwise(zero)
    line = F.col("_y1") + (F.col("_y2") - F.col("_y1")) * part
    curve = F.when((F.col("_y1") > 0) & (F.col("_y2") > 0) & F.lit(exponential), F.col("_y1") * F.pow(F.col("_y2") / F.col("_y1"), part)).otherwise(line)
    value = F.when(F.col("_x").isNull() | F.col("a").isNull(), F.col("a")).otherwise(F.greatest(F.coalesce("_hit", curve, F.col("a")), zero))
    return out.select(*SEG, "origin", "origin_idx", "age", "age_idx", value.alias("value"))
