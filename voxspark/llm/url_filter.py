"""URL filters: host and path rules, and gradient-boosted trees on lexical features.

A url's verdict is that of the longest rule that fits, else the trees'.  The features
are lengths, depth, digit ratio, entropy, parameter counts and suffix statistics; the
suffix statistics are counted over all labelled rows, the trees alone are fitted on a
bounded sample of them (`max_train_rows` urls a class, those with the smallest url
hashes), scoring is JVM-side.

Defined results: a null url, or one without "://", has an empty host and path, no rule
and the trees' verdict on all-zero features; without labelled rows of both classes
there are no trees and every url without a rule is allowed; extra columns are passed on.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Terms whose appearance in a host labels a url as unwanted (fixed values).
SEED_TERMS = ("spam", "pills", "casino", "porn", "viagra", "xxx", "warez", "lottery")
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-."
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_len", "host_len", "path_len", "labels", "depth", "digit_ratio", "hyphens", "params", "query_len", "entropy", "longest_label", "suffix_rate", "suffix_log_n")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (a key like "example.net/en/") that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):  # later branches are outer, so the longest is asked first
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def with_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """urls with the lexical columns of FEATURES but the suffix statistics, and suffix."""
    u, h, p = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    n = F.greatest(F.length(h), F.lit(1))
    entropy = sum((F.when(_count(h, c) > 0, -(_count(h, c) / n) * F.log2(_count(h, c) / n)).otherwise(0.0) for c in _ALPHABET), F.lit(0.0))
    return urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).withColumns({
        "url_len": F.length(u), "host_len": F.length(h), "path_len": F.length(p), "labels": F.when(h == "", 0).otherwise(1 + _count(h, ".")), "depth": _count(p, "/"),
        "digit_ratio": F.length(F.regexp_replace(u, "[^0-9]", "")) / F.greatest(F.length(u), F.lit(1)), "hyphens": _count(h, "-"), "params": _count(query, "="),
        "query_len": F.length(query), "entropy": entropy, "longest_label": F.coalesce(F.array_max(F.transform(F.split(h, r"\."), F.length)), F.lit(0)), "suffix": suffix_of(h)})


def seed_labels(urls: DataFrame, terms: tuple[str, ...] = SEED_TERMS, url: str = "url") -> DataFrame:
    """url and label: 1.0 where the host holds a seed term, else 0.0."""
    hit = F.lit(False)
    for t in terms:
        hit = hit | host_of(F.col(url)).contains(t)
    return urls.select(F.col(url).alias("url"), hit.cast("double").alias("label"))


class UrlModel:
    """Fitted trees with the suffix statistics (a row a suffix)."""

    def __init__(self, labelled: DataFrame, max_train_rows: int = 5000, max_iter: int = 10, max_depth: int = 3):
        by_hash = lambda k: labelled.where(F.col("label") == k).dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_train_rows)
        train = materialize(with_features(by_hash(1.0).unionAll(by_hash(0.0))), "url-train")
        self.suffixes = materialize(labelled.where("label in (0, 1)").select(suffix_of(host_of(F.col("url"))).alias("suffix"), "label").groupBy("suffix").agg(((F.sum("label") + 1.0) / (F.count("*") + 2.0)).alias("suffix_rate"), F.log(1.0 + F.count("*")).alias("suffix_log_n")), "url-suffixes")
        self.assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        self.trees = None
        if train.select("label").distinct().count() == 2:
            # one sorted partition of at most 2 * max_train_rows rows: sums in one order, so one model
            rows = self._vectors(train).select("features", "label", "url").repartition(1).sortWithinPartitions("url").select("features", "label")
            self.trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth, seed=7).fit(rows)

    def _vectors(self, rows: DataFrame) -> DataFrame:
        # no hint: there may be many suffixes; Spark broadcasts a small table, and splits large keys of a large one
        held = rows.join(self.suffixes, "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_log_n": 0.0})
        return self.assembler.transform(held)

    def predict(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """urls with host, path and unwanted (boolean)."""
        keep = [*(c for c in urls.columns if c not in ("host", "path")), "host", "path"]
        if self.trees is None:
            return urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url)), "unwanted": F.lit(False)}).select(*keep, "unwanted")
        scored = self.trees.transform(self._vectors(with_features(urls, url)))
        return scored.select(*keep, (F.col("prediction") == 1.0).alias("unwanted"))


def judge_urls(urls: DataFrame, rules: dict[str, str], model: UrlModel, url: str = "url") -> DataFrame:
    """urls with host, path, rule and verdict ("allow" or "block")."""
    scored = model.predict(urls, url).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("unwanted"), "block").otherwise("allow")
    for rule, says in rules.items():
        verdict = F.when(F.col("rule") == rule, F.lit(says)).otherwise(verdict)
    return scored.withColumn("verdict", verdict).drop("unwanted")
