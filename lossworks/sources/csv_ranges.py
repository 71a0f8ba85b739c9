"""CSV files read in byte ranges, with line breaks inside quoted fields, and each file's own header.

Spark's text source cuts files into ranges at line ends. Whether a range begins inside a quoted field follows from what
all ranges before it do to that state: each is a function of one bit, found from its lines with quotes alone, and these
functions are composed along a file (a row per range). Then each range is cut into records where its lines are read; only
records that cross a range's end meet their rest in a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lossworks.functions.tables import broadcast_if_small, small_enough, written

#: The most characters of a record within one range; a quoted field that stays open longer is an error.
MOST_RECORD = 16 << 20
WHOLE, HEAD, MIDDLE, TAIL = 0, 1, 2, 3
PIECES = "file long, start long, ord long, part int, text string"
RANGE = ["file", "start"]


def ends_open(line: str, open_: bool) -> bool:
    """Whether a quoted field is open behind a line; quotes count at a field's start and, doubled or not, within one."""
    at = 0
    while True:
        if open_:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            open_, at = False, line.find(",", at)
            if at < 0:
                return False
            at += 1
        if line[at : at + 1] == '"':
            open_, at = True, at + 1
            continue
        at = line.find(",", at)
        if at < 0:
            return False
        at += 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file`` (a hash of its path), ``start`` of the range and ``value``, the range's lines in order."""
    return spark.read.text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range with quotes: whether a field is open at its end if none, and if one, is open at its start."""
    key, ends, out = None, (False, True), []
    for batch in batches:
        for file, start, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if key != (file, start):
                out += [(*key, *ends)] if key else []
                key, ends = (file, start), (False, True)
            ends = tuple(ends_open(value, x) for x in ends)
    out += [(*key, *ends)] if key else []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["file", "start", "closed_to", "open_to"])


def open_ranges(rows: DataFrame) -> DataFrame:
    """``file, start`` of the ranges that begin inside a quoted field.

    A range forces the state, keeps or swaps it. So it is that of the last range before that forces it (a file's start
    does), swapped as often as ranges since then swap.
    """
    turns = rows.filter(F.contains("value", F.lit('"'))).mapInArrow(_turns, "file long, start long, closed_to boolean, open_to boolean")
    turns = written(turns.unionByName(rows.select(*RANGE, F.lit(None).cast("boolean").alias("closed_to"), F.lit(None).cast("boolean").alias("open_to")).distinct()).groupBy(*RANGE).agg(F.max("closed_to").alias("closed_to"), F.max("open_to").alias("open_to")), "csv-ranges")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = (F.col("closed_to") & ~F.col("open_to")).cast("int")
    forced = F.when(F.col("closed_to") == F.col("open_to"), F.col("closed_to").cast("int"))
    own = turns.withColumn("_swaps", F.sum(F.coalesce(swaps, F.lit(0))).over(Window.partitionBy("file").orderBy("start")))
    # a forced state, less the swaps up to it, plus those up to the range
    offset = F.when(forced.isNotNull(), forced - F.col("_swaps"))
    state = F.pmod(F.coalesce(F.last(offset, ignorenulls=True).over(before), F.lit(0)) + F.coalesce(F.max("_swaps").over(before), F.lit(0)), F.lit(2))
    return own.withColumn("_open", state).filter("_open = 1").select(*RANGE)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each range in order, as ``PIECES``; a text of null is too long."""
    key, open_, carried, pending, held, size, first, ord_ = None, False, False, False, [], 0, 0, 0
    out: list[tuple] = []

    def text() -> str | None:
        return "\n".join(held) if size <= MOST_RECORD else None

    def left() -> list[tuple]:
        if not pending:
            return []
        return [(*key, first, MIDDLE if carried else TAIL, text())]

    for batch in batches:
        for file, start, value, begins_open in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if key != (file, start):
                out += left()
                key, open_, carried, pending, held, size, ord_ = (file, start), bool(begins_open), bool(begins_open), False, [], 0, 0
            ord_ += 1
            if not open_ and '"' not in value:
                if value:
                    out.append((*key, ord_, WHOLE, value))
                continue
            if not pending:
                first, pending = ord_, True
            size += len(value) + 1
            if size <= MOST_RECORD:
                held.append(value)
            else:
                held.clear()
            open_ = ends_open(value, open_)
            if not open_:
                out.append((*key, first, HEAD if carried else WHOLE, text()))
                carried, pending, held, size = False, False, [], 0
        if out:
            yield _batch(out)
            out = []
    if out := out + left():
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])


def records(rows: DataFrame) -> DataFrame:
    """``file, start, ord, text`` of each record that isn't a blank line; ``ord`` is its first line's number within the range.

    ``text`` is null where a quoted field isn't closed at the file's end, and for records of over ``MOST_RECORD``
    characters: a stray quote fails one record and nothing else, and no task gathers the rest of a file.
    """
    begins = written(open_ranges(rows).withColumn("_begins_open", F.lit(True)), "csv-open")
    if small_enough(begins):  # such a join keeps the lines' order
        marked = rows.join(F.broadcast(begins), RANGE, "left")
    else:
        marked = rows.withColumn("_line", F.monotonically_increasing_id()).join(begins, RANGE, "left").repartition(*RANGE).sortWithinPartitions(*RANGE, "_line")
    pieces = written(marked.select(*RANGE, "value", "_begins_open").mapInArrow(_records, PIECES), "csv-pieces")
    cut = pieces.filter(F.col("part") != WHOLE)
    chain = F.sum((F.col("part") == TAIL).cast("int")).over(Window.partitionBy("file").orderBy("start", "part"))
    parts = F.sort_array(F.collect_list(F.struct("start", "part", "ord", "text")))
    cut = cut.withColumn("_chain", chain)
    size = F.sum(F.coalesce(F.length("text"), F.lit(MOST_RECORD)))
    short = cut.groupBy("file", "_chain").agg(size.alias("_size")).filter(F.col("_size") <= MOST_RECORD).select("file", "_chain", F.lit(True).alias("_short"))
    cut = cut.join(short, ["file", "_chain"], "left").withColumn("text", F.when(F.col("_short"), F.col("text")))
    joined = cut.groupBy("file", "_chain").agg(parts.alias("p"))
    closed = (F.size("p") > 1) & (F.element_at("p", -1)["part"] == HEAD) & F.forall("p", lambda x: x["text"].isNotNull())
    joined = joined.select("file", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["ord"].alias("ord"), F.when(closed, F.array_join("p.text", "\n")).alias("text"))
    return pieces.filter(F.col("part") == WHOLE).select("file", "start", "ord", "text").unionByName(joined)


def header_name(text: Column) -> Column:
    """A header in lower case, its blanks as ``_``."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, "﻿", ""))), r"\s+", "_")


def table(spark: SparkSession, path: str, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, files): the columns ``names`` of each file by its own header, all as text.

    Rows: ``source_file, line`` (the record's first line in its file, from 1), ``seq`` (rising along a file), ``broken``
    (a field isn't closed) and ``names``. Of repeated headers the first counts, further columns are ignored. Files:
    ``source_file, missing``, the names that a file lacks (it has no rows then).
    """
    source = lines(spark, path)
    counts = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("start")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("source_file", F.xxhash64("source_file").alias("file"), "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranges = written(ranges, "csv-line-numbers")
    files = ranges.select("file", "source_file").distinct().withColumn("rank", F.row_number().over(Window.orderBy("source_file")).cast("long"))  # a row per file
    all_ = written(records(source), "csv-records")
    place = F.struct("start", "ord")
    heads = all_.groupBy("file").agg(F.min_by(F.coalesce("text", F.lit("")), place).alias("header"), F.min(place).alias("first"))
    width = heads.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit(""))))).first()[0]
    schema = ", ".join(f"c{k} string" for k in range((width or 0) + 1))
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    cells = lambda text: F.array(*(F.from_csv(text, schema, options)[f"c{k}"] for k in range((width or 0) + 1)))
    heads = heads.withColumn("names", F.transform(cells(F.col("header")), lambda x: F.coalesce(header_name(x), F.lit(""))))
    missing = F.array_except(F.array(*map(F.lit, names)), F.col("names"))
    heads = written(files.join(heads, "file", "left").withColumn("missing", F.coalesce(missing, F.array(*map(F.lit, names)))), "csv-heads")
    good = heads.filter(F.size("missing") == 0).select("file", "source_file", "rank", "first", *(F.array_position("names", n).alias(f"_{n}") for n in names))
    body = all_.join(broadcast_if_small(good), "file").filter(place != F.col("first"))
    body = body.join(broadcast_if_small(ranges.select(*RANGE, "before")), RANGE).withColumn("_cells", F.from_csv("text", schema, options))
    row = F.array(*(F.col("_cells")[f"c{k}"] for k in range((width or 0) + 1)))
    body = body.withColumn("_row", row).select(
        "source_file", (F.col("before") + F.col("ord")).alias("line"), (F.shiftleft("rank", 40) + F.col("start") + F.col("ord")).alias("seq"), F.col("text").isNull().alias("broken"),
        *(F.try_element_at("_row", F.col(f"_{n}").cast("int")).alias(n) for n in names),
    )
    return body, heads.select("source_file", "missing")
