"""Small tables with every odd case: nulls, empty and long texts, repeated rows, ties, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in ("lo", "mi", "ra", "tu", "ven", "sor", "pel", "ga") for b in ("ba", "ne", "ri", "sto", "lum", "da", "ken", "fo", "wis")]


def prose(rng, n):
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + rng.choice(WORDS) * (rng.random() < 0.5))
        if k % 11 == 10:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


def documents(n=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append([i, prose(rng, rng.choice((12, 40, 120))), "en", f"src{i % 4}", 0])
    for i in range(n, n + 25):  # exact and near copies
        words = rows[i % 7][1].split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), "en", "src0", 0])
    passage = prose(rng, 30)
    for i in range(n + 25, n + 33):
        rows.append([i, prose(rng, 15) + "\n" + passage + "\n" + prose(rng, 10), "fr", "src1", 0])
    rows += [[900, None, None, None, None], [901, "", "en", "src0", 0], [902, " \n\t ", "en", "src1", 3], [903, "one two", "en", None, 7], [904, "One TWO", "en", None, 7], [None, prose(rng, 50), "en", "src2", 0], [None, None, None, None, None]]
    rows += [[905, prose(rng, 3000), "en", "src2", 0], [906, "x" * 5000, "en", "src3", 0], [907, "é中\U0001f600 \x00   á İx <|endoftext|> don't", "en", "src3", 0]]
    rows += [list(rows[3]), list(rows[3]), list(rows[70])]
    return [tuple(r) for r in rows]


def frame(spark, rows=None, clash=False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        for name in ("size", "n", "h", "row", "doc", "at", "kind", "value", "rate", "copies", "target", "node", "bucket", "score", "kept", "n_entities"):
            df = df.withColumn(name, F.lit("clash"))
    return df
