"""URL filters: explicit host/path rules, and association rules that FP-growth mines from labelled URLs.

A rule says "these URL tokens together mean block". They are mined from the pages that the
explicit rules decide and from those whose URL names a labelled document. Rules below the support or confidence limits go,
and so do rules that a shorter rule already covers. Rules are found by an inverted index: each is filed under its rarest need only.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lossworks.llm.common import broadcast_if_small, shared_dir, written

#: (host, path, verdict): fits the host and its subdomains when the URL's path starts with the rule's path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
MIN_SUPPORT = 0.001
MIN_COUNT = 5
MIN_CONFIDENCE = 0.8


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, path``; a null URL or one without ``://`` has empty ones."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return pages.select(
        "page_id",
        "url",
        _lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def with_rule(urls: DataFrame, rules=RULES) -> DataFrame:
    """``urls`` with the longest fitting rule's name (like ``net/fr/``) and verdict, or nulls."""
    found = F.lit(None).cast("struct<rule:string,own:string>")
    for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("own"))).otherwise(found)
    return urls.withColumn("_rule", found).select("*", "_rule.rule", "_rule.own").drop("_rule")


def tokens(urls: DataFrame) -> DataFrame:
    """``urls`` with the distinct tokens of each: the host's labels with their place from the right, path segments,
    runs of digits as ``#``, query keys, and whether there is a fragment."""
    labels = F.reverse(F.split("host", r"\."))
    steps = F.filter(F.split("path", "/"), lambda s: s != "")
    query = F.coalesce(F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.filter(F.transform(F.split(query, "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    made = F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
        F.transform(steps, lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, r"\d+", "#"))),
        F.transform(keys, lambda k: F.concat(F.lit("q:"), k)),
        F.when(F.instr(F.coalesce("url", F.lit("")), "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
        F.array(F.concat(F.lit("s:"), F.regexp_extract(F.coalesce("url", F.lit("")), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))),
    )
    return urls.withColumn("tokens", F.array_distinct(made))


def mined_rules(urls: DataFrame, labels: DataFrame) -> DataFrame:
    """``rule_id, needs, confidence, support`` from ``urls`` (page_id, tokens) and ``labels`` (page_id, bad).

    A rule says that pages with a token of each of its ``needs`` are bad; tokens that stand on exactly the same labelled
    pages are one need, so that a dozen keys that always come together don't make thousands of sets. Needs that are a rule
    alone go no further, nor do tokens that all pages have. FP-growth lists the frequent sets of the others on the bad
    pages; an inverted index counts them on all labelled ones. Rules of which another's needs are a part are left out. A
    page with several labels is bad when any is. No labels, or none bad, give no rules.
    """
    spark = urls.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    marked = labels.filter("page_id is not null").groupBy("page_id").agg(F.max(F.coalesce("bad", F.lit(0))).alias("bad"))
    pages = urls.select("page_id", "tokens").join(marked, "page_id").select("tokens", (F.col("bad") > 0).cast("long").alias("bad"), F.monotonically_increasing_id().alias("row"))
    pages = written(pages, "baskets")
    n, bad = pages.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0))).first()
    empty = "rule_id string, needs array<array<string>>, confidence double, support double"
    if not bad:
        return spark.createDataFrame([], empty)
    least = max(MIN_COUNT, math.ceil(MIN_SUPPORT * n))
    each = pages.select("row", "bad", F.explode("tokens").alias("token"))
    cover = [F.count("*").alias("n"), F.sum("bad").alias("bad"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64(F.lit("cover"), "row")).alias("y")]
    covers = each.groupBy("token").agg(*cover).filter(F.col("bad") >= least)
    classes = covers.groupBy("n", "bad", "x", "y").agg(F.sort_array(F.collect_list("token")).alias("members"))
    classes = written(classes.select(F.col("members")[0].alias("token"), "members", "n", "bad"), "token-classes")
    sure = F.col("bad") / F.col("n") >= MIN_CONFIDENCE
    rules = classes.filter(sure).select(F.array("token").alias("tokens"), (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support"))
    left = broadcast_if_small(written(classes.filter(~sure & (F.col("n") < n)).select("token"), "tokens-left"))
    baskets = written(each.join(left, "token").groupBy("row").agg(F.collect_list("token").alias("items"), F.max("bad").alias("bad")), "token-baskets")
    dark = baskets.filter("bad > 0").count()
    if dark >= least:
        found = FPGrowth(minSupport=(least - 0.5) / dark).fit(baskets.filter("bad > 0")).freqItemsets
        sets = written(found.filter(F.size("items") > 1).select(F.sort_array("items").alias("tokens"), F.col("freq").alias("bad")), "token-sets")
        index = broadcast_if_small(written(filed(sets), "token-set-index"))
        hits = baskets.select("items", F.explode("items").alias("token")).join(index.drop("bad"), "token")
        counts = hits.filter(F.size(F.array_except("tokens", "items")) == 0).groupBy("tokens").agg(F.count("*").alias("n"))
        sets = sets.join(counts, "tokens").filter(sure)
        rules = rules.unionByName(sets.select("tokens", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / n).alias("support")))
    kept = unneeded_gone(written(rules, "rules"))
    needs = kept.select("tokens", "confidence", "support", F.posexplode("tokens").alias("place", "token")).join(classes.select("token", "members"), "token")
    needs = needs.groupBy("tokens", "confidence", "support").agg(F.sort_array(F.collect_list(F.struct("place", "members"))).alias("m"))
    return needs.select(F.array_join("tokens", " ").alias("rule_id"), F.col("m.members").alias("needs"), "confidence", "support")


def unneeded_gone(rules: DataFrame) -> DataFrame:
    """Without the rules of which another rule's ``tokens`` are a proper part: that one fires whenever they would."""
    long = rules.select("tokens", F.explode("tokens").alias("token"))
    short = filed(rules).select(F.col("tokens").alias("short"), "token")
    covered = long.join(short, "token").filter((F.size("short") < F.size("tokens")) & (F.size(F.array_except("short", "tokens")) == 0))
    return rules.join(covered.select("tokens").distinct(), "tokens", "left_anti")


def filed(rules: DataFrame) -> DataFrame:
    """The inverted index: ``rules`` with ``token``, the one of their ``tokens`` that the fewest rules have."""
    each = rules.select("tokens", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("n"))
    key = each.join(often, "token").groupBy("tokens").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return rules.join(key, "tokens")


def evidence(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, bad`` of the pages that something is known of.

    Where an explicit rule decides, its verdict is the label. Other pages have the label of the document that their URL
    names: the number that is a path segment behind the first one, with or without an ending (``labels``: doc_id, toxic).
    """
    urls = with_rule(parts(pages), rules)
    decided = urls.filter("own is not null").select("page_id", (F.col("own") == "block").cast("int").alias("bad"))
    number = F.regexp_extract("path", r"^/[^/]+/(\d{1,18})(?:\.[a-z]+)?/?$", 1)
    toxic = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).cast("int").alias("bad"))
    named = urls.filter("own is null").select("page_id", F.when(number != "", number).cast("long").alias("doc_id"))
    return decided.unionByName(named.join(toxic, "doc_id").select("page_id", "bad"))


def verdicts(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, mined_rule``, from ``labels`` (page_id, bad).

    An explicit rule decides where one fits; else a page that has a token of each need of a mined rule is blocked
    (``mined_rule`` names the page's tokens of the most confident), and all others are allowed. Repeated pages are judged each by itself, a null id or URL is a
    page like others, extra columns are ignored, an empty table gives no rows. Pages meet their rules by row, so that a
    URL crawled very often is no hot key.
    """
    urls = written(tokens(with_rule(parts(pages))).drop("url").withColumn("row", F.monotonically_increasing_id()), "urls")
    rules = written(mined_rules(urls, labels).select(F.col("rule_id").alias("tokens"), "needs", "confidence"), "mined-rules")
    # filed under the tokens of their rarest need
    each = rules.select("tokens", F.explode("needs").alias("need"))
    often = each.groupBy("need").agg(F.count("*").alias("n"))
    key = each.join(often, "need").groupBy("tokens").agg(F.min(F.struct("n", "need"))["need"].alias("need"))
    index = rules.join(key, "tokens").select("needs", "confidence", F.explode("need").alias("token"))
    own = F.transform("needs", lambda need: F.array_max(F.array_intersect(need, F.col("tokens"))))
    fired = (
        urls.filter("own is null").select("row", "tokens", F.explode("tokens").alias("token"))
        .join(broadcast_if_small(written(index, "rule-index")), "token")
        .filter(F.forall("needs", lambda need: F.arrays_overlap(need, F.col("tokens"))))
        .groupBy("row").agg(F.max(F.struct("confidence", F.array_join(F.sort_array(own), " ").alias("rule_id")))["rule_id"].alias("mined_rule"))
    )
    return (
        urls.drop("tokens").join(fired, "row", "left")
        .select(
            "page_id", "host", "path", "rule",
            F.coalesce("own", F.when(F.col("mined_rule").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "mined_rule",
        )
    )


def op9(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return verdicts(pages, evidence(pages, spark.read.parquet(f"{sf_dir}/labels.parquet")))
