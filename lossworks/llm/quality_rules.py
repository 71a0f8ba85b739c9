"""Quality rules from cross-document line frequency, in DataFrame functions only.

Normalised lines are hashed; each hash's distinct documents are counted per host (the ``source`` column). Lines above the
host's limit are boilerplate and are removed; a document that loses too much of itself is rejected, as is one that fails
the base rules (too few words, too many words in repeated five-word windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import WORD, broadcast_if_small, documents, let, text_or_empty, unused, words_of, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # per cent of the words
#: A line is boilerplate in a host when more than this part of the host's documents, and more than MIN_DOCS, have it.
MOST_DOCS, MIN_DOCS = 0.02, 10
#: A document is rejected when more than this part of its words stood in boilerplate lines.
MOST_REMOVED = 0.5

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more among ``windows`` (in text order).

    Sorting (hash, position) puts equal windows side by side; their positions, in order again, each add the words that
    the one before did not cover.
    """

    def covered(ordered: Column) -> Column:
        n = F.size(ordered)
        pairs = F.zip_with(
            F.slice(ordered, F.lit(1), n - 1),
            F.slice(ordered, F.lit(2), n - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        state = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(F.array_distinct(F.flatten(pairs))),
            state,
            lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(numbered), covered))


def _windows(hashes: Column) -> Column:
    """The hash of each five-word window, in text order."""
    n = F.size(hashes)
    count = F.greatest(n - (WINDOW - 1), F.lit(0))
    shifted = [F.slice(hashes, F.lit(k + 1), count) for k in range(WINDOW)]
    # arrays_zip pairs the word hashes of a window; one pass hashes each
    zipped = F.arrays_zip(*(s.alias(f"w{k}") for k, s in enumerate(shifted)))
    return F.transform(zipped, lambda z: F.xxhash64(*(z[f"w{k}"] for k in range(WINDOW))))


def normalised(line: Column) -> Column:
    """Lower case, digits alike, single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    """64 bits of the normalised line's MD5, as hex digits: a hash that any SQL engine has."""
    return F.substring(F.md5(normalised(line).cast("binary")), 1, 16)


def measured(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, host, text_hash``, the base figures and ``lines`` (hash and words of each line with a word).

    A null text counts as an empty one: all figures 0, no lines.
    """
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line = F.transform(lines, lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("n")))
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    words = words_of(text)
    figures = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(_windows(h), _repeat_words)).cast("long").alias("n_repeat_words"),
        ),
    )
    return (
        docs.select(
            "doc_id",
            source.alias("host"),
            F.xxhash64(text).alias("text_hash"),
            figures.alias("f"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            line.alias("lines"),
        )
        .withColumns({"n_words": F.col("f.n_words"), "n_repeat_words": F.col("f.n_repeat_words")})
        .select("doc_id", "host", "text_hash", *BASE, "lines")
    )


def frequent_lines(rows: DataFrame) -> DataFrame:
    """``host, h`` of the lines above their host's limit.

    Documents are distinct texts, so that the exact copies of one don't make its own lines boilerplate. Both counts
    combine before they shuffle, and (host, line, text) spreads a line that every document has.
    """
    seen = rows.select("host", "text_hash", F.explode("lines.h").alias("h")).distinct()
    counts = seen.groupBy("host", "h").agg(F.count("*").alias("n"))
    hosts = rows.filter(F.size("lines") > 0).select("host", "text_hash").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    counts = counts.filter(F.col("n") > MIN_DOCS)
    hosts = hosts.withColumnRenamed("host", "_host")
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("n") > F.col("docs") * MOST_DOCS).select("host", "h")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def judged(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, host, text_hash``, the base figures, ``base_failed, n_removed_words, boilerplate, kept``.

    ``boilerplate`` lists the hashes of the lines to remove. A null text has no words and fails; a null source is a host
    of its own; repeated rows are judged alike; an empty table gives no rows. Texts are read once: the figures and line
    hashes are written, and the counts and verdicts come from that table. The boilerplate lines of a host are at most
    its lines / (MOST_DOCS x documents); they are broadcast when measured small, else the join shuffles.
    """
    rows = written(measured(docs).withColumn("row", F.monotonically_increasing_id()), "lines")
    frequent = written(frequent_lines(rows), "frequent").select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    each = rows.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.n")
    hit = (
        each.join(broadcast_if_small(frequent), (F.col("h") == F.col("_h")) & F.col("host").eqNullSafe(F.col("_host")))
        .groupBy("row").agg(F.sum("n").alias("n_removed_words"), F.collect_set("h").alias("boilerplate"))
    )
    return (
        rows.drop("lines").join(hit, "row", "left").drop("row")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= F.col("n_words") * MOST_REMOVED))
    )


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents and without boilerplate lines; its columns stay, ``n_chars`` follows.

    Verdicts meet the texts by id, source and text hash; equal rows have equal verdicts, so one of each is kept to join.
    Null and empty texts have no words and go; repeated rows stay repeated; an empty table gives no rows.
    """
    names = docs.columns
    id_, host, hash_, lines = unused(names, "_id", "_host", "_hash", "_lines")
    verdicts = (
        judged(docs).filter("kept")
        .select(F.col("doc_id").alias(id_), F.col("host").alias(host), F.col("text_hash").alias(hash_), F.col("boilerplate").alias(lines))
        .dropDuplicates([id_, host, hash_])
    )
    source = F.col("source") if "source" in names else F.lit(None).cast("string")
    same = (
        F.col("doc_id").eqNullSafe(F.col(id_)) & source.eqNullSafe(F.col(host)) & (F.xxhash64(text_or_empty()) == F.col(hash_))
    )
    left = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(lines, line_hash(x))))
    out = docs.join(verdicts, same).withColumn("text", F.when(F.col(lines).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*names)


def op2(spark, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).select("doc_id", *BASE, "base_failed", "kept", "n_removed_words")


OP2_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d
), win AS (
  SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
), rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest(range(i, i + 5)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM win) WHERE c > 1
  ) GROUP BY r
), li AS (
  SELECT r, source, line, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS norm,
         len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS n
  FROM (SELECT r, source, unnest(ls) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM li GROUP BY r
), h AS (
  SELECT r, source, substr(md5(norm), 1, 16) AS h, n FROM li
), docs AS (
  SELECT source, count(DISTINCT text) AS docs FROM d WHERE regexp_matches(text, '[^\\x20\\x09-\\x0D]') GROUP BY source
), freq AS (
  SELECT c.source, c.h FROM (SELECT h.source, h, count(DISTINCT d.text) AS n FROM h JOIN d USING (r) GROUP BY h.source, h) c
  JOIN docs ON c.source IS NOT DISTINCT FROM docs.source AND n > 10 AND n > docs.docs * 0.02
), gone AS (
  SELECT r, sum(n) AS n FROM h JOIN freq ON h.h = freq.h AND h.source IS NOT DISTINCT FROM freq.source GROUP BY r
), f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, (len(ws) < 10 OR coalesce(rep.n, 0) * 100 > len(ws) * 20) AS base_failed,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM w LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN gone USING (r)
)
SELECT *, NOT base_failed AND n_removed_words <= n_words * 0.5 AS kept FROM f
"""
