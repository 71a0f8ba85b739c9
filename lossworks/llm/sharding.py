"""Sharding by a k-d tree over document metadata.

Copies of a text are one weighted point. The tree splits the points of a node at a weighted median along the node's widest
dimension (text size, source, language), level by level, until every leaf holds the target bytes: one shard.
Only DataFrame functions; the driver holds the tree, a few numbers per node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lossworks.llm.common import documents, text_or_empty, written

SHARDS = 24
#: A group of copies heavier than this part of a shard is dealt in parts of at most that weight.
HEAVY = 1 / 8
#: Bins of one histogram pass, and the error allowed in a split as a part of a shard's bytes.
BINS, SLACK = 512, 1 / 1000
#: Rows that one slot window sorts on average; the number of windows follows the table.
ROWS_PER_WINDOW = 200_000
DIMENSIONS = ("k_size", "k_source", "k_lang")
LOW = 1 << 32


@dataclass
class Node:
    first: int
    shards: int
    dim: str = ""
    low: int = 0
    high: int = 0
    want: float = 0.0
    cut: int | None = None


def _key(value: Column) -> Column:
    """A dimension's value (up to 20 bits) with the text's hash below it: ties split by text, equal texts never."""
    return (value.cast("long") * LOW + F.col("h")).cast("long")


def points(docs: DataFrame) -> DataFrame:
    """A row per document: ``doc_id, size, text_crc32`` and its point: ``h`` (32 bits of the text's hash) and keys.

    A group's source and language are its smallest document's, so that copies stay together whatever their metadata.
    """
    text = F.encode(text_or_empty(), "UTF-8")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text_or_empty()).alias("text_hash"),
        F.pmod(F.xxhash64(source), F.lit(1 << 20)).alias("source_code"),
        F.pmod(F.xxhash64(lang), F.lit(1 << 20)).alias("lang_code"),
    )


def _grouped(rows: DataFrame) -> DataFrame:
    own = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "source_code", "lang_code")
    return rows.groupBy("text_hash", "size").agg(F.count("*").alias("n"), F.min(own).alias("own")).select(
        "text_hash", "size", (F.col("n") * F.col("size")).alias("weight"),
        F.col("own.source_code").alias("source_code"), F.col("own.lang_code").alias("lang_code"),
    )


def _histogram(at: DataFrame, nodes: list[Node]) -> dict[int, list[tuple[int, int, int]]]:
    """Per node the bytes in each of ``BINS`` equal bins of its current range: (bin, bytes, points)."""
    spans = at.sparkSession.createDataFrame(
        [(n.first, n.dim, n.low, max(1, -(-(n.high - n.low + 1) // BINS))) for n in nodes], "node int, dim string, low long, step long"
    )
    key = F.coalesce(*(F.when(F.col("dim") == d, F.col(d)) for d in DIMENSIONS))
    found: dict[int, list] = {n.first: [] for n in nodes}
    counted = (
        at.join(F.broadcast(spans), "node")
        .withColumn("bin", F.floor((key - F.col("low")) / F.col("step")).cast("long"))
        .withColumn("bin", F.when(F.col("bin") < 0, -1).when(F.col("bin") >= BINS, BINS).otherwise(F.col("bin")))
        .groupBy("node", "bin")
        .agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    )
    for r in counted.collect():  # at most nodes x (BINS + 2) rows
        found[r["node"]].append((r["bin"], r["w"], r["n"]))
    return {k: sorted(v) for k, v in found.items()}


def _cuts(at: DataFrame, nodes: list[Node], slack: float) -> None:
    """Sets each node's cut: keys up to it go left, with the wanted bytes up to ``slack`` or to a single key."""
    busy = nodes
    while busy:
        found, still = _histogram(at, busy), []
        for n in busy:
            step, below, done = max(1, -(-(n.high - n.low + 1) // BINS)), 0, False
            n.cut = n.high
            for number, weight, _ in found[n.first]:
                if below + weight >= n.want:
                    left, top = n.low + number * step - 1, n.low + number * step + step - 1
                    if number < 0 or number >= BINS:
                        break
                    near = left if n.want - below <= below + weight - n.want else top
                    if step == 1 or min(n.want - below, below + weight - n.want) <= slack:
                        n.cut, done = near, True
                    else:
                        n.low, n.high, n.cut = left + 1, top, near
                        still.append(n)
                        done = True
                    break
                below += weight
            if not done:
                n.cut = n.high
        busy = still


def kd_tree(at: DataFrame, shards: int) -> DataFrame:
    """``at`` (keys, weight) with ``node``: the number of its leaf, from 0 to ``shards`` - 1."""
    total = at.agg(F.sum("weight")).first()[0] or 0
    at, nodes = at.withColumn("node", F.lit(0)), [Node(0, shards)]
    whole = None
    while nodes:
        ranges = at.groupBy("node").agg(F.sum("weight").alias("w"), *(f(d).alias(f"{k}_{d}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))))
        found = {r["node"]: r for r in ranges.collect()}  # a row per node
        if whole is None:
            whole = {d: (found[0][f"hi_{d}"] - found[0][f"lo_{d}"]) or 1 for d in DIMENSIONS} if found else {}
        alive = [n for n in nodes if n.first in found]
        for n in alive:
            r = found[n.first]
            n.dim = max(DIMENSIONS, key=lambda d: (r[f"hi_{d}"] - r[f"lo_{d}"]) / whole[d])
            n.low, n.high, n.want = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"], r["w"] * (n.shards // 2) / n.shards
        _cuts(at, alive, SLACK * total / shards)
        if alive:
            key = {d: F.col(d) for d in DIMENSIONS}
            right = F.lit(False)
            for n in alive:
                right = right | ((F.col("node") == n.first) & (key[n.dim] > n.cut))
            half = F.coalesce(*(F.when(F.col("node") == n.first, F.lit(n.first + n.shards // 2)) for n in alive), F.col("node"))
            at = at.withColumn("node", F.when(right, half).otherwise(F.col("node")))
        nodes = [Node(f, k) for n in alive for f, k in ((n.first, n.shards // 2), (n.first + n.shards // 2, n.shards - n.shards // 2)) if k > 1]
    return at


def kd_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shards hold near equal bytes (UTF-8 bytes of the text, plus 8 each). Copies of a text share a shard,
    but a group heavier than ``HEAVY`` of a shard is dealt by ``doc_id`` in parts of that weight (there are at most
    shards / HEAVY such groups, so their list is small). Null texts are empty texts; a null source or language is a value
    of its own; an empty table gives no rows; repeated rows get slots of their own. The rows' metadata is written once;
    each level of the tree reads the points a few times, and no row but histograms reaches the driver.
    """
    rows = written(points(docs), "shard-rows")
    groups = written(_grouped(rows), "shard-groups")
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum(F.col("weight") / F.col("size")), F.lit(0.0))).first()
    buckets = 1 + int(n_rows) // (shards * ROWS_PER_WINDOW)
    most = max(1, int(total / shards * HEAVY))
    heavy = groups.filter(F.col("weight") > most).select("text_hash", "size", F.ceil(F.col("weight") / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")

    def keyed(df: DataFrame) -> DataFrame:
        h = F.pmod(F.xxhash64("text_hash", "part"), F.lit(LOW))
        size = F.least(F.floor(F.log2(F.col("size").cast("double")) * 20000), F.lit((1 << 20) - 1))
        return df.withColumn("h", h).withColumns({"k_size": _key(size), "k_source": _key(F.col("source_code")), "k_lang": _key(F.col("lang_code"))})

    with_parts = groups.join(F.broadcast(heavy), ["text_hash", "size"], "left")
    light = with_parts.filter("parts is null").withColumn("part", F.lit(0)).drop("parts")
    of_heavy = rows.select("doc_id", "text_hash", "size").join(F.broadcast(heavy), ["text_hash", "size"]).withColumn("part", part)
    of_heavy = of_heavy.groupBy("text_hash", "size", "part").agg(F.sum("size").alias("weight"))
    meta = with_parts.filter("parts is not null").select("text_hash", "size", "source_code", "lang_code")
    of_heavy = of_heavy.join(F.broadcast(meta), ["text_hash", "size"])
    at = written(keyed(light.unionByName(of_heavy.select(*light.columns))).select("text_hash", "size", "part", "weight", *DIMENSIONS), "shard-points")
    leaves = kd_tree(at, shards).select("text_hash", "size", "part", F.col("node").cast("int").alias("shard"))
    placed = (
        rows.join(F.broadcast(heavy), ["text_hash", "size"], "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(part)).join(leaves, ["text_hash", "size", "part"])
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(buckets)).cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", "bucket")
    )
    placed = written(placed, "shard-placed")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("at", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "bucket"])  # a row for each window
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op7(spark, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir))
