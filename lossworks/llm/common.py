"""Helpers that several corpus operators share: words, column names, written and broadcast tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lossworks.functions.tables import shared_dir, written

__all__ = ["broadcast_if_small", "documents", "let", "n_words", "shared_dir", "small_enough", "text_or_empty", "unused", "words_of", "written"]

#: A word is a maximal run of anything but blank and the five ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def unused(columns: list[str], *names: str) -> list[str]:
    """``names`` with as many underscores before each as it takes to clash with none of ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


#: The most bytes that are broadcast, by a sum over the table itself.
MOST_BYTES = 16 << 20


def small_enough(df: DataFrame, most_bytes: int) -> bool:
    """Whether the rows of ``df`` take at most so many bytes: lengths of strings and binaries, 16 for any other value."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    row = sum(((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if k in ("string", "binary") else F.lit(16)) for c, k in kinds.items()), F.lit(16))
    return (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most_bytes


def broadcast_if_small(df: DataFrame, most_bytes: int | None = None) -> DataFrame:
    """A broadcast hint where a sum over the rows proves the size; else the join shuffles. ``df`` is a written table."""
    return F.broadcast(df) if small_enough(df, MOST_BYTES if most_bytes is None else most_bytes) else df
