"""Mixing sources to target weights.

Sizes are summed per source, a water level turns weights into targets that never exceed a multiple of the source's size,
and every document is emitted floor(rate) times plus one more time when a keyed hash falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.functions.order import in_buckets, running
from lossworks.llm.common import broadcast_if_small, documents, n_words, text_or_empty, unused, written

CAP = 3
SEED = "mix-1"


def cyclic_weight(order: Column, cycle: int = 3) -> Column:
    """Weights 1, 2, ..., cycle, repeating, by a source's 0-based place in the order."""
    return (order % cycle + 1).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """Per-source targets from ``source, source_size``, one row per source.

    All sizes are shared out by weight; a target stops at ``cap`` times its size and the excess goes to the others by
    weight, until none is above. With sources in order of cap/weight, the capped ones are a prefix: source i is capped
    when the level of the sources from i on, (total - caps before i) / (weights from i on), lifts it to its cap. All
    terms are whole numbers, so the comparison is exact and the level is a single division. Both orders run over range
    buckets, so no task holds all sources; the driver gets two totals and the level.
    """
    by_name = [F.col("source").isNull(), F.encode("source", "UTF-8")]
    by_ratio = [F.col("limit") / F.col("weight"), F.col("place")]
    placed = running(in_buckets(sizes.select("source", "source_size"), [], by_name), [], by_name, sums={"place": F.lit(1).cast("long")})
    weighed = (
        placed.drop("bucket").withColumn("place", F.col("place") - 1)
        .withColumn("weight", cyclic_weight(F.col("place")))
        .withColumn("limit", F.col("source_size") * cap)
    )
    weighed = in_buckets(weighed, [], by_ratio)
    total, weights = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (
        running(weighed, [], by_ratio, sums={"limits": "limit", "weights": "weight"})
        .withColumn("room", F.lit(total) - (F.col("limits") - F.col("limit")))
        .withColumn("heft", F.lit(weights) - (F.col("weights") - F.col("weight")))
        .withColumn("capped", _wide("room") * _wide("weight") >= _wide("limit") * _wide("heft"))
    )
    level = written(level.select("source", "source_size", "weight", "limit", "room", "heft", "capped"), "levels")
    left = level.agg(F.max(F.when(~F.col("capped"), F.struct("room", "heft"))).alias("left")).first()["left"]
    room, heft = left or (0, 1)  # with all of them capped no target asks for the level
    shared = (F.lit(room).cast("long") * F.col("weight")).cast("double") / F.lit(float(heft))
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("limit").cast("double")).otherwise(shared).alias("target"))


def _wide(name: str) -> Column:
    """A whole number whose products don't overflow."""
    return F.col(name).cast("decimal(19, 0)")


def coin(seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on the seed and ``doc_id`` only; on the text where there is no id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), text_or_empty())))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mix(docs: DataFrame, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``; any columns of those names are replaced.

    A null text has size 0, a null source is a source of its own, last in the order. Repeated rows with one ``doc_id``
    share one coin, and so do rows without an id that have one text. A source of size 0 has target 0 and its documents are kept once (they hold no words).
    Sums per source combine before the shuffle. The table of targets, a row per source, is written and measured: up to
    16 MB it is broadcast, so a source with a third of all rows is no hot key; beyond, the join shuffles.
    """
    sized = docs.withColumn("size", n_words(text_or_empty()))
    per_source = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap), "targets")
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    source, rate_ = unused(docs.columns, "_source", "_rate")
    wanted = per_source.select(F.col("source").alias(source), "source_size", "target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    whole = F.floor(rate_)
    return (
        sized.drop("source_size", "target", "copies", "taken")
        .join(broadcast_if_small(wanted), F.col("source").eqNullSafe(F.col(source)))
        .withColumn(rate_, rate)
        .withColumn("copies", (whole + (coin(seed) < F.col(rate_) - whole).cast("long")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*names, "size", "source_size", "target", "copies", "taken")
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as many times as ``copies`` says."""
    kept = [c for c in mixed.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    (copy,) = unused(mixed.columns, "_copy")
    return mixed.filter("copies > 0").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*kept)


def op3(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


OP3_SQL = """
WITH d AS (
  SELECT doc_id, text, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), p AS (
  SELECT *, row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1 AS place FROM s
), w AS (
  SELECT *, place % 3 + 1 AS weight, source_size * 3 AS lim FROM p
), c AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER b, 0) AS room,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heft
  FROM w WINDOW b AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), u AS (
  SELECT max(room) AS room, max(heft) AS heft FROM c WHERE room * weight < lim * heft
), t AS (
  SELECT c.source, c.source_size,
         CASE WHEN c.room * weight >= lim * c.heft THEN CAST(lim AS DOUBLE)
              ELSE CAST(u.room * weight AS DOUBLE) / CAST(u.heft AS DOUBLE) END AS target
  FROM c CROSS JOIN u
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0 END AS rate,
         CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), 'text:' || coalesce(d.text, ''))), 1, 8) AS BIGINT) / 4294967296.0 AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST((floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM r
"""
