"""Simulated amounts as a partitioned table: a folder per segment and kind, rewritten alone, with a manifest beside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lossworks.functions.tables import written

OWN = ["segment", "kind"]
SCHEMA = "origin string, sim long, unpaid double, segment string, kind string"
MANIFEST = "n long, n_sims long, n_origins long, total decimal(38,4), segment string, kind string"
#: Simulations of a segment that go to one task and file.
SIMS_PER_FILE = 1_000_000


def _parts(path: str) -> tuple[str, str]:
    return f"{path}/samples", f"{path}/manifest"


def counted(samples: DataFrame) -> DataFrame:
    """``segment, kind`` with ``n`` rows, ``n_sims``, ``n_origins`` and ``total`` (in ten-thousandths, so that order doesn't matter).

    One combining aggregate per (segment, kind, origin) first: the distinct counts are of its rows.
    """
    each = samples.groupBy(*OWN, "origin").agg(F.count("*").alias("n"), F.max("sim").alias("top"), F.sum(F.col("unpaid").cast("decimal(28,4)")).alias("total"))
    return each.groupBy(*OWN).agg(F.sum("n").alias("n"), (F.max("top") + 1).alias("n_sims"), F.count("*").alias("n_origins"), F.sum("total").cast("decimal(38,4)").alias("total"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Writes ``segment, kind, origin, sim, unpaid`` below ``path``; simulations of a segment are numbered from 0.

    Only the folders of the segments and kinds in ``samples`` are replaced, each as a whole when the job ends, so that one
    segment can be simulated again and a rerun of the same draws changes nothing. Segments are dealt by blocks of
    simulations: a large one is many files from many tasks. The manifest is counted from what has been written; rows that
    ``wrong`` lists tell of a run that ended in between.
    """
    spark = samples.sparkSession
    data, manifest = _parts(path)
    rows = written(samples.select("origin", F.col("sim").cast("long").alias("sim"), F.col("unpaid").cast("double").alias("unpaid"), *OWN), "samples")  # drawn once
    dealt = rows.repartition(*OWN, F.floor(F.col("sim") / SIMS_PER_FILE)).sortWithinPartitions(*OWN, "origin", "sim")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*OWN).parquet(data)
    mine = rows.select(*OWN).distinct().select(*(F.col(c).alias(f"_{c}") for c in OWN))
    same = F.col("segment").eqNullSafe(F.col("_segment")) & F.col("kind").eqNullSafe(F.col("_kind"))
    found = counted(read_samples(spark, path)).join(mine, same, "left_semi")
    found.select("n", "n_sims", "n_origins", "total", *OWN).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*OWN).parquet(manifest)


def read_samples(spark: SparkSession, path: str, segments: list[str] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The samples; of some segments or kinds only their folders are read."""
    out = spark.read.schema(SCHEMA).parquet(_parts(path)[0])
    if segments is not None:
        out = out.filter(F.col("segment").isin(segments))
    return out if kinds is None else out.filter(F.col("kind").isin(kinds))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(_parts(path)[1])


def wrong(spark: SparkSession, path: str) -> DataFrame:
    """``segment, kind, written, listed``: segments whose rows aren't what the manifest says, as structs of its counts."""
    names = ["n", "n_sims", "n_origins", "total"]
    a = counted(read_samples(spark, path)).select(*OWN, F.struct(*names).alias("written"))
    b = read_manifest(spark, path).select(*(F.col(c).alias(f"_{c}") for c in OWN), F.struct(*names).alias("listed"))
    same = F.col("segment").eqNullSafe(F.col("_segment")) & F.col("kind").eqNullSafe(F.col("_kind"))
    both = a.join(b, same, "full_outer").filter(~F.col("written").eqNullSafe(F.col("listed")))
    return both.select(F.coalesce("segment", "_segment").alias("segment"), F.coalesce("kind", "_kind").alias("kind"), "written", "listed")
