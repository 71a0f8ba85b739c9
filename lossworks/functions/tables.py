"""Written intermediate tables: computed once, read by every later step, whichever executors are lost meanwhile."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Where that is unset a local master gets a temporary folder of its own; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, which cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most bytes that are broadcast, by a sum over the table itself.
MOST_BYTES = 16 << 20


def small_enough(df: DataFrame, most_bytes: int = MOST_BYTES) -> bool:
    """Whether the rows of ``df``, counted as JSON text, take at most so many bytes. ``df`` is written."""
    return (df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """A broadcast hint where the bytes of all rows prove the size; else the join shuffles."""
    return F.broadcast(df) if small_enough(df, most_bytes) else df
