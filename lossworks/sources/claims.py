"""Claim snapshots: the loss-run reader, and a deterministic claim view over the order tables for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossworks.functions.tables import written
from lossworks.sources import csv_ranges

AS_OF = "2001-12-31"
# The columns of a loss run.
LOSS_RUN = ("claim_id", "accident_date", "report_date", "evaluation_date", "paid_to_date", "case_reserve", "status")


def claims_view(spark: SparkSession, sf_dir: str, as_of: str | None = AS_OF, recoveries: bool = False) -> DataFrame:
    """``segment, claim_id, accident_date, report_date, evaluation_date, paid_to_date, case_reserve, status, seq``.

    An order is a claim, its line numbers are yearly evaluations, the market segment is the line of business. Amounts are
    whole cents until the end, so that sums don't depend on their order. ``recoveries``: returned lines only.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    cents = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.pow(F.lit(0.5), F.col("l_linenumber") - 1) * 100 + 0.5)
    rows = read("lineitem").filter("l_returnflag = 'R'") if recoveries else read("lineitem")
    # dealt by order once: the sums, the windows and the join all keep an order's lines where they are
    lines = rows.select("l_orderkey", "l_linenumber", cents.alias("cents")).repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.sum("cents").alias("cents"))
    claim = Window.partitionBy("l_orderkey")
    lines = lines.withColumns({
        "paid": F.sum("cents").over(claim.orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)),
        "total": F.sum("cents").over(claim),
        "last": F.max("l_linenumber").over(claim),
    })
    orders = read("orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("accident_date"))
    customers = read("customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    out = (
        lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "segment",
            F.col("o_orderkey").cast("string").alias("claim_id"),
            "accident_date",
            F.date_add("accident_date", (F.col("o_orderkey") % 45).cast("int")).alias("report_date"),
            F.last_day(F.add_months("accident_date", 12 * F.col("l_linenumber") - 3)).alias("evaluation_date"),
            (F.col("paid") / 100.0).alias("paid_to_date"),
            (F.floor((F.col("total") - F.col("paid")) * (F.col("o_orderkey") % 3 + 9) / 10.0 + 0.5) / 100.0).alias("case_reserve"),
            F.when(F.col("l_linenumber") == F.col("last"), "closed").otherwise("open").alias("status"),
            (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        )
    )
    return out.filter(F.col("evaluation_date") <= F.lit(as_of).cast("date")) if as_of else out


def exposures_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``segment, origin, earned_premium``: order totals per segment and order year, in whole cents until the end."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("segment", F.year("o_orderdate").cast("string").alias("origin"))
        .agg((F.sum(cents) / 100.0).alias("earned_premium"))
    )


CLAIMS_SQL = """
ln AS (
  SELECT l_orderkey, l_linenumber,
         CAST(sum(CAST(floor(l_extendedprice * (1 - l_discount) * pow(0.5, l_linenumber - 1) * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents
  FROM lineitem GROUP BY 1, 2
), lw AS (
  SELECT *, CAST(sum(cents) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS paid,
         CAST(sum(cents) OVER (PARTITION BY l_orderkey) AS BIGINT) AS total, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last
  FROM ln
), allsnap AS (
  SELECT c_mktsegment AS segment, CAST(o_orderkey AS VARCHAR) AS claim_id, CAST(o_orderdate AS DATE) AS accident_date,
         CAST(o_orderdate AS DATE) + CAST(o_orderkey % 45 AS INTEGER) AS report_date,
         last_day(CAST(o_orderdate AS DATE) + to_months(CAST(12 * l_linenumber - 3 AS INTEGER))) AS evaluation_date,
         paid / 100.0::DOUBLE AS paid_to_date, floor((total - paid) * (o_orderkey % 3 + 9) / 10.0::DOUBLE + 0.5) / 100.0::DOUBLE AS case_reserve,
         CASE WHEN l_linenumber = last THEN 'closed' ELSE 'open' END AS status, o_orderkey * 10 + l_linenumber AS seq
  FROM lw JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
), snap AS (
  SELECT * FROM allsnap WHERE evaluation_date <= DATE '2001-12-31'
), expo AS (
  SELECT c_mktsegment AS segment, CAST(year(o_orderdate) AS VARCHAR) AS origin,
         CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) / 100.0::DOUBLE AS earned_premium
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
)"""


def loss_run_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(claims, errors) from a loss-run CSV file or folder, read in byte ranges whatever the sizes of the files.

    Each file is read by its own header: in any case, blanks count as ``_``; of repeated ones the first counts, further
    columns are ignored. A file that lacks a column fails alone, by an error of code ``SHAPE``; so does a record whose
    quoted field isn't closed. All fields are read as text; a row with any error gives no claim but an error row per
    message, with the file, the record's first line and its fields.
    """
    rows, files = csv_ranges.table(spark, path, LOSS_RUN)
    rows = written(rows, "loss-run")
    claims, errors = parsed_loss_run(rows.filter("not broken"))
    nothing = F.struct(*(F.lit(None).cast("string").alias(c) for c in LOSS_RUN))
    open_ = rows.filter("broken").select("source_file", "line", nothing.alias("row"), F.lit("a quoted field is not closed").alias("message"))
    lacks = files.filter(F.size("missing") > 0).select("source_file", F.lit(1).cast("long").alias("line"), nothing.alias("row"), F.concat(F.lit("SHAPE: missing column "), F.array_join("missing", ", ")).alias("message"))
    return claims, errors.unionByName(open_).unionByName(lacks)


def parsed_loss_run(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims, errors) from loss-run rows whose columns are text; ``source_file``, ``line`` and ``seq`` may come with them."""
    text = {c: F.trim(F.coalesce(F.col(c), F.lit(""))) for c in LOSS_RUN}
    date = {c: F.when(text[c].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text[c], "yyyy-MM-dd")) for c in ("accident_date", "report_date", "evaluation_date")}
    amount = {c: F.when(text[c].rlike(r"^-?\d+(\.\d+)?$"), text[c].try_cast("double")) for c in ("paid_to_date", "case_reserve")}
    status = F.lower(text["status"])
    checks = [(text["claim_id"] == "", "claim_id is missing")]
    checks += [(d.isNull(), f"{c} is not a yyyy-mm-dd date") for c, d in date.items()]
    checks += [(a.isNull(), f"{c} is not a plain number") for c, a in amount.items()]
    checks += [
        (~status.isin("open", "closed"), "status is neither open nor closed"),
        (date["report_date"] < date["accident_date"], "report_date is before accident_date"),
        (date["evaluation_date"] < date["report_date"], "evaluation_date is before report_date"),
    ]
    found = F.array_compact(F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(said)) for test, said in checks)))
    marked = rows.withColumn("_errors", found).withColumn("_seq", F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id())
    claims = marked.filter(F.size("_errors") == 0).select(
        text["claim_id"].alias("claim_id"), *(date[c].alias(c) for c in date), *(amount[c].alias(c) for c in amount), status.alias("status"), F.col("_seq").alias("seq")
    )
    source = F.col("source_file") if "source_file" in rows.columns else F.lit(None).cast("string")
    line = F.col("line") if "line" in rows.columns else F.lit(None).cast("long")
    errors = marked.select(source.alias("source_file"), line.alias("line"), F.struct(*LOSS_RUN).alias("row"), F.explode("_errors").alias("message"))
    return claims, errors
