"""URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

Features: lengths, depth, share of digits, entropy of the characters, number of parameters, and the statistics of the
host's suffix (its last two labels) among the labelled URLs. The trees are fitted on at most ``TRAINING_ROWS`` labelled
URLs, those with the smallest hash, so the model and the suffix table are bounded whatever the input.

Edge cases: a url that is null or has no ``://`` has empty host and path, fits no rule and is judged by its features
(all zero if null); without labels of both kinds the method gives every url the one kind there is, or allow; suffixes
not seen take the mean; repeated rows get equal results; an empty table gives an empty result. Rules are
configuration: some tens. Other columns are not read.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.llm.common import stage

ALLOW, BLOCK = "allow", "block"
TRAINING_ROWS = 20_000
SPLIT_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
FEATURES = [
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
    "query_length", "suffix_rate", "suffix_count",
]


def host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT_URL, 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT_URL, 2)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. A rule is a host and, from the first slash on, the
    start of a path."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def lexical(url: Column) -> dict[str, Column]:
    text = F.coalesce(url, F.lit(""))
    size = F.length(text)
    letters = F.array_distinct(F.split(text, ""))

    def surprise(c: Column) -> Column:
        share = (size - F.length(F.replace(text, c, F.lit("")))) / size
        return F.when(c == "", F.lit(0.0)).otherwise(-share * F.log2(share))

    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    name = host(url)
    return {
        "url_length": size,
        "host_length": F.length(name),
        "path_length": F.length(path(url)),
        "depth": F.length(path(url)) - F.length(F.replace(path(url), F.lit("/"), F.lit(""))),
        "labels": F.size(F.split(name, r"\.")),
        "digit_ratio": F.when(size > 0, F.regexp_count(text, F.lit("[0-9]")) / size).otherwise(0.0),
        "entropy": F.when(size > 0, F.aggregate(F.transform(letters, surprise), F.lit(0.0), lambda a, b: a + b)).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "suffix": F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0),
    }


class UrlModel:
    def __init__(self, trees, suffixes: DataFrame | None, rate: float):
        self.trees, self.suffixes, self.rate = trees, suffixes, rate


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = TRAINING_ROWS,
        trees: int = 20, depth: int = 4) -> UrlModel:
    """Learn from (url, label), label 1 meaning block."""
    sample = labelled.select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label"))
    sample = sample.filter("url IS NOT NULL AND label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    sample = stage(sample.withColumns(lexical(F.col("url"))), "labelled-urls")
    kinds = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    total = sum(kinds.values())
    rate = kinds.get(1.0, 0) / total if total else 0.0
    if len(kinds) < 2:
        return UrlModel(None, None, rate)
    # smoothed, so that a rare suffix says little
    suffix_rate = (F.sum("label") + 20 * rate) / (F.count("*") + 20)
    suffixes = stage(sample.groupBy("suffix").agg(suffix_rate.alias("suffix_rate"), F.log1p(F.count("*")).alias("suffix_count")), "url-suffixes")
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=17, featuresCol="features", labelCol="label")
    ready = vectors(sample, suffixes, rate).select("label", "features").repartition(2).cache()
    fitted = learner.fit(ready)
    ready.unpersist()
    return UrlModel(fitted, suffixes, rate)


def vectors(rows: DataFrame, suffixes: DataFrame, rate: float) -> DataFrame:
    # bounded by the training rows
    met = rows.join(F.broadcast(suffixes), "suffix", "left")
    met = met.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(rate)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})
    return met.withColumn("features", array_to_vector(F.array(*[F.col(f).cast("double") for f in FEATURES])))


def judge(pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule (null if none fits), verdict, block_score (the trees')."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumns({"host": host(url), "path": path(url)})
    rows = rows.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        scored = rows.withColumn("block_score", F.lit(float(model.rate)))
    else:
        judged = model.trees.transform(vectors(rows.withColumns(lexical(url)), model.suffixes, model.rate))
        scored = judged.withColumn("block_score", vector_to_array("probability")[1])
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("block_score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "block_score")
