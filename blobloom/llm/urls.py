"""Verdicts on URLs: host and path rules, and gradient-boosted trees on lexical features where no rule fits."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import is_small, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "hyphens", "suffix_share", "suffix_log_count"]
# Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """Behind the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruling(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """STRUCT<rule, verdict> of the longest rule that fits, else null.

    rules: (verdict, host/path). A rule fits its host and all subdomains where the path starts with
    its path. Of rules of one length the last one listed wins.
    """
    result = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, _, path_start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + path_start)
        result = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(result)
    return result


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(text: Column) -> Column:
    """Bits per character."""

    def bits(s: Column) -> Column:
        letters = F.array_distinct(F.split(s, ""))
        share = F.transform(letters, lambda c: F.length(F.replace(s, c, F.lit(""))).cast("double"))
        n = F.length(s).cast("double")
        return F.aggregate(share, F.lit(0.0), lambda total, rest: total - (n - rest) / n * F.log2((n - rest) / n))

    return F.when(F.length(text) > 0, _bound(text, bits)).otherwise(0.0)


def lexical(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Feature columns of the columns url, host and path; suffixes: (suffix, blocked, n) of the labelled rows."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    n = F.length(url)
    rows = urls.select(
        "*",
        suffix_of(host).alias("suffix"),
        n.cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double").alias("depth"),
        F.when(n > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / n).otherwise(0.0).alias("digit_ratio"),
        entropy(url).alias("entropy"),
        F.when(F.instr(url, "?") > 0, F.size(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"))).otherwise(0).cast("double").alias("parameters"),
        (F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit("")))).cast("double").alias("hyphens"),
    )
    # Suffixes are few in most corpora; a long list is joined like any table, hot suffixes split by AQE.
    side = F.broadcast(suffixes) if is_small(suffixes) else suffixes
    rows = rows.join(side, "suffix", "left")
    blocked, count = F.coalesce("blocked", F.lit(0)), F.coalesce("n", F.lit(0))
    rows = rows.withColumn("suffix_share", (blocked + 1.0) / (count + 2.0)).withColumn("suffix_log_count", F.log1p(count))
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.drop("blocked", "n", "suffix"))


def fit(labelled: DataFrame, suffixes: DataFrame, sample: int = SAMPLE, trees: int = 8, depth: int = 4, seed: int = 7) -> Model | None:
    """Trees on at most `sample` rows (url, host, path, blocked 0/1), half of each label, chosen by hash of the URL.

    Without rows of both labels there is nothing to learn, and the result is None.
    """
    order = [F.xxhash64("url", F.lit(seed)), "url"]
    each = [labelled.where(F.col("blocked") == b).orderBy(*order).limit(sample // 2) for b in (0, 1)]
    rows = written(lexical(functools.reduce(DataFrame.unionByName, each).withColumnRenamed("blocked", "label"), suffixes).select("features", F.col("label").cast("double")), "url-sample")
    if rows.select("label").distinct().count() < 2:
        return None
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64, checkpointInterval=-1).fit(rows)


def judge(df: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(key, host, path, rule, verdict, score) of every URL.

    verdict: the rule's, else block where the trees find blocking likelier. They learn from the URLs
    that rules label; counts of suffixes cover all of those. If all of those have one label there is
    nothing to learn, and the rest is allowed. A null URL has an empty host and path, and is
    judged by its (empty) features. Repeated rows are judged each; an empty table gives none.
    """
    pages = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{url}`").cast("string").alias("url"))
    pages = pages.select("*", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    pages = pages.withColumn("ruling", ruling(rules, F.col("host"), F.col("path")))
    labelled = pages.where(F.col("ruling").isNotNull()).select("url", "host", "path", (F.col("ruling.verdict") == "block").cast("int").alias("blocked"))
    suffixes = written(labelled.groupBy(suffix_of(F.col("host")).alias("suffix")).agg(F.sum("blocked").alias("blocked"), F.count("*").alias("n")), "suffixes")
    model = fit(labelled, suffixes, sample)
    rows = lexical(pages, suffixes)
    score = F.lit(0.0)
    if model is not None:
        rows = model.transform(rows)
        score = vector_to_array("probability")[1]
    verdict = F.coalesce("ruling.verdict", F.when(score >= 0.5, "block").otherwise("allow"))
    return rows.select(key, "host", "path", F.col("ruling.rule").alias("rule"), verdict.alias("verdict"), score.alias("score"))
