"""Methods that lean on an expected loss: Bornhuetter-Ferguson, Benktander, Cape Cod, expected claims; frequency-severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.functions.numbers import finite
from lossworks.jobs.chainladder import chain_ladder
from lossworks.operators.triangles import latest, severity


def _sum_if(test: Column, amount: str) -> Column:
    return F.sum(F.when(test, F.col(amount)))


def derived_apriori(cl: DataFrame, exposures: DataFrame, maturity: float = 0.9) -> DataFrame:
    """``segment, apriori, all_periods``: the premium-weighted loss ratio of mature origins, or of all where none is."""
    rows = cl.join(exposures.select("segment", "origin", finite("earned_premium").alias("premium")), ["segment", "origin"]).filter("premium > 0")
    mature = F.col("percent_developed") >= maturity
    sums = rows.groupBy("segment").agg(
        _sum_if(mature, "ultimate").alias("u"), _sum_if(mature, "premium").alias("p"), F.sum("ultimate").alias("ua"), F.sum("premium").alias("pa")
    )
    return sums.select("segment", F.when(F.col("p") > 0, F.col("u") / F.col("p")).otherwise(F.col("ua") / F.col("pa")).alias("apriori"), (~(F.coalesce("p", F.lit(0.0)) > 0)).alias("all_periods"))


def bornhuetter_ferguson(
    cl: DataFrame, exposures: DataFrame, apriori: float | None = None, by_origin: DataFrame | None = None, maturity: float = 0.9
) -> DataFrame:
    """A row per origin with usable premium: latest + a-priori x premium x (1 - 1/cdf).

    The a-priori ratio is the origin's own (``by_origin``: segment, origin, apriori), else the one given, else derived.
    """
    rows = cl.join(exposures.select("segment", "origin", finite("earned_premium").alias("premium")), ["segment", "origin"]).filter("premium > 0")
    rows = rows.join(derived_apriori(cl, exposures, maturity).select("segment", F.col("apriori").alias("_derived")), "segment", "left")
    own = F.lit(None).cast("double")
    if by_origin is not None:
        rows = rows.join(by_origin.select("segment", "origin", finite("apriori").alias("_own")), ["segment", "origin"], "left")
        own = F.col("_own")
    rows = rows.withColumn("apriori", F.coalesce(own, F.lit(apriori).cast("double"), F.col("_derived"))).filter("apriori is not null")
    expected = F.col("apriori") * F.col("premium")
    unreported = expected * (1 - 1 / F.col("cdf"))
    return rows.select(
        "segment", "kind", "origin", "origin_idx", "latest", "cdf", "apriori", "premium", expected.alias("expected_ultimate"),
        unreported.alias("unpaid"), (F.col("latest") + unreported).alias("ultimate"),
    )


def bf_warnings(cl: DataFrame, exposures: DataFrame, maturity: float = 0.9) -> DataFrame:
    """Origins without usable premium, and segments whose a-priori comes from all periods."""
    rows = cl.join(exposures.select("segment", "origin", finite("earned_premium").alias("premium")), ["segment", "origin"], "left")
    out = rows.filter("not coalesce(premium > 0, false)").select("segment", F.lit("NO_PREMIUM").alias("code"), F.concat(F.lit("no usable premium in "), "origin").alias("message"))
    none = derived_apriori(cl, exposures, maturity).filter("all_periods").select("segment", F.lit("NOT_MATURE").alias("code"), F.lit("the a-priori comes from all periods").alias("message"))
    return out.unionByName(none).select("segment", F.lit("bornhuetter_ferguson").alias("method"), "code", "message")


def benktander(bf: DataFrame, cl: DataFrame) -> DataFrame:
    """A row per origin of ``bf``: latest + q x its ultimate, with q = 1 - 1/cdf; credibility 1 - q."""
    q = 1 - 1 / F.col("cdf")
    ultimate = F.col("latest") + q * F.col("bf_ultimate")
    rows = bf.select("segment", "kind", "origin", "origin_idx", "latest", "cdf", F.col("ultimate").alias("bf_ultimate"))
    rows = rows.join(cl.select("segment", "origin", F.col("ultimate").alias("cl_ultimate")), ["segment", "origin"])
    return rows.select("segment", "kind", "origin", "origin_idx", "latest", "cdf", (1 - q).alias("credibility"), "cl_ultimate", "bf_ultimate", ultimate.alias("ultimate"), (ultimate - F.col("latest")).alias("unpaid"))


def elr_rows(cl: DataFrame, exposures: DataFrame) -> DataFrame:
    """Input of the expected-loss methods from chain-ladder rows: ``reported, cdf, premium, loss_adj, premium_adj``."""
    rows = cl.join(exposures.select("segment", "origin", finite("earned_premium").alias("premium")), ["segment", "origin"]).filter("premium > 0")
    return rows.select("segment", "origin", "origin_idx", F.col("latest").alias("reported"), "cdf", "premium", F.lit(1.0).alias("loss_adj"), F.lit(1.0).alias("premium_adj"))


def cape_cod(rows: DataFrame, decay: float = 1.0) -> DataFrame:
    """A row per origin: the pooled ratio of adjusted losses to used-up premium, decayed by distance, and its ultimate.

    Segments whose used-up premium isn't positive have no rows.
    """
    if not 0 <= decay <= 1:
        raise ValueError("BAD_ADJ: the decay factor must be between 0 and 1")
    base = rows.withColumns({"loss_adj": F.coalesce("loss_adj", F.lit(1.0)), "premium_adj": F.coalesce("premium_adj", F.lit(1.0))})
    base = base.withColumns({"_loss": F.col("reported") * F.col("loss_adj"), "used_up": F.col("premium") * F.col("premium_adj") / F.col("cdf")})
    pooled = base.groupBy("segment").agg((F.sum("_loss") / F.nullif(F.sum("used_up"), F.lit(0.0))).alias("pooled_elr"), F.sum("used_up").alias("_all")).filter("_all > 0").drop("_all")
    if decay == 1:
        elr = base.join(pooled, "segment").withColumn("elr", F.col("pooled_elr"))
    else:
        other = base.select("segment", F.col("origin_idx").alias("_j"), F.col("_loss").alias("_l"), F.col("used_up").alias("_u"))
        weight = F.pow(F.lit(float(decay)), F.abs(F.col("origin_idx") - F.col("_j")))
        own = base.join(other, "segment").groupBy("segment", "origin_idx").agg(F.sum(weight * F.col("_l")).alias("_num"), F.sum(weight * F.col("_u")).alias("_den"))
        own = own.filter("_den > 0").select("segment", "origin_idx", (F.col("_num") / F.col("_den")).alias("elr"))
        elr = base.join(pooled, "segment").join(own, ["segment", "origin_idx"])
    at_level = F.col("elr") * F.col("premium_adj") / F.col("loss_adj")
    ultimate = F.col("reported") + at_level * F.col("premium") * (1 - 1 / F.col("cdf"))
    return elr.select(
        "segment", "origin", "origin_idx", "reported", "cdf", "premium", "used_up", "pooled_elr", "elr", at_level.alias("elr_at_origin_level"),
        (at_level * F.col("premium")).alias("expected_ultimate"), ultimate.alias("ultimate"), (ultimate - F.col("reported")).alias("unpaid"),
    )


def expected_claims(rows: DataFrame, elr: float) -> DataFrame:
    """A row per origin: the given ratio at the origin's level times premium."""
    if not elr > 0:
        raise ValueError("BAD_ELR: the expected loss ratio must be positive")
    own = F.lit(float(elr)) * F.coalesce("premium_adj", F.lit(1.0)) / F.coalesce("loss_adj", F.lit(1.0))
    return rows.select("segment", "origin", "origin_idx", "premium", own.alias("elr_at_origin_level"), (own * F.col("premium")).alias("ultimate"))


def frequency_severity(loss: DataFrame, count: DataFrame, count_selections: DataFrame, severity_selections: DataFrame) -> DataFrame:
    """A row per origin that has both: ultimate counts x ultimate severity."""
    counts = chain_ladder(count, count_selections).select("segment", "origin", F.col("ultimate").alias("ultimate_counts"))
    per_claim = chain_ladder(severity(loss, count), severity_selections).select("segment", "origin", F.col("ultimate").alias("ultimate_severity"))
    rows = latest(loss).join(counts, ["segment", "origin"]).join(per_claim, ["segment", "origin"])
    ultimate = F.col("ultimate_counts") * F.col("ultimate_severity")
    own = F.coalesce("latest", F.lit(0.0))
    return rows.select("segment", "kind", "origin", "origin_idx", own.alias("latest"), "ultimate_counts", "ultimate_severity", ultimate.alias("ultimate"), (ultimate - own).alias("unpaid"))
