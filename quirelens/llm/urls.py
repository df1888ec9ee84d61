"""URL filters: a rule list decides what it covers, gradient-boosted trees on lexical features decide the rest.

The trees learn from labelled URLs: those a rule of the list decides are the labels (their rule's verdict), and a
caller may pass a table of its own. Features are lexical only: length, depth, digit share, entropy, parameter
counts, and the smoothed share of blocked URLs per host suffix, in training from the other folds. Suffixes are
hashed into ``SUFFIX_BUCKETS`` buckets, so the table of suffix statistics has a fixed bound and may be broadcast.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage

#: The rule list of the registered query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Labelled rows that the trees see at most (by hash of the URL), and the size of the ensemble.
MAX_LABELLED = 20_000
TREES, DEPTH = 8, 3
#: Probability from which a URL that no rule decides is blocked: only where the trees are sure.
BLOCK_AT = 0.7
SUFFIX_BUCKETS, FOLDS = 2_048, 5
FEATURES = ("url_chars", "host_chars", "path_chars", "depth", "labels", "digit_share", "entropy", "n_params", "query_chars", "has_fragment", "has_extension", "is_https", "suffix_share")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path: from there up to ``? #``. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (as host and path in one string) that fits, or null."""
    rule = F.lit(None).cast("string")
    for _, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
    return rule


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host, path and the features that need no statistics. A null URL counts as empty."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_and_path(F.col(url))
    df = df.withColumns({"host": host, "path": path})
    n = F.greatest(F.length(u), F.lit(1))
    chars = F.split(u, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.length(u) - F.length(F.replace(u, c, F.lit(""))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda a, k: a - F.when(k > 0, k / n * F.log2(k / n)).otherwise(0.0))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_chars": F.length(u).cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
            "labels": F.size(F.split("host", r"\.")).cast("double"),
            "digit_share": F.length(F.regexp_replace(u, "[^0-9]", "")) / n,
            "entropy": F.when(F.length(u) > 0, entropy).otherwise(0.0),
            "n_params": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
            "query_chars": F.length(query).cast("double"),
            "has_fragment": F.contains(u, F.lit("#")).cast("double"),
            "has_extension": F.regexp_like(F.col("path"), F.lit(r"\.[A-Za-z0-9]{1,5}$")).cast("double"),
            "is_https": F.startswith(F.lower(u), F.lit("https:")).cast("double"),
            "suffix_bucket": F.pmod(F.xxhash64(F.substring_index("host", ".", -2)), F.lit(SUFFIX_BUCKETS)).cast("int"),
        }
    )


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS))


def suffix_counts(labelled: DataFrame, *more: Column) -> DataFrame:
    """(suffix_bucket, blocked, seen) and further keys: SUFFIX_BUCKETS rows at most, FOLDS times that by fold."""
    return labelled.groupBy("suffix_bucket", *more).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("seen"))


class UrlModel:
    """Fitted trees and the statistics they use. Without labels of both kinds every URL gets the commoner verdict."""

    def __init__(self, labelled: DataFrame) -> None:
        """``labelled``: url and label (1.0: block)."""
        rows = lexical(labelled.select("url", F.col("label").cast("double").alias("label")))
        counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # two rows
        total = sum(counts.values())
        self.default = 1.0 if counts.get(1.0, 0) > counts.get(0.0, 0) else 0.0
        self.counts = cut_lineage(suffix_counts(rows))
        self.own_fold = cut_lineage(suffix_counts(rows, fold(F.col("url")).alias("fold")))
        self.model = None
        if counts.get(0.0) and counts.get(1.0):
            share = min(1.0, MAX_LABELLED / total)
            some = rows.where(F.pmod(F.xxhash64("url", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
            train = self.featured(some, training=True).select("features", "label")
            train = cut_lineage(train)  # read once for every level of every tree
            self.model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=32, stepSize=0.4, seed=11).fit(train)

    def featured(self, df: DataFrame, training: bool = False) -> DataFrame:
        """Add the feature vector. A training row's suffix share comes from the other folds: all rows of one fold and
        suffix have one value, so it says nothing of the row's own label."""
        df = df.join(F.broadcast(self.counts), "suffix_bucket", "left")
        blocked, seen = F.coalesce("blocked", F.lit(0.0)), F.coalesce("seen", F.lit(0))
        if training:
            own = self.own_fold.withColumnsRenamed({"blocked": "own_blocked", "seen": "own_seen"})
            df = df.withColumn("fold", fold(F.col("url"))).join(F.broadcast(own), ["suffix_bucket", "fold"], "left")
            blocked, seen = blocked - F.coalesce("own_blocked", F.lit(0.0)), seen - F.coalesce("own_seen", F.lit(0))
        df = df.withColumn("suffix_share", (blocked + 1.0) / (seen + 2.0))
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    def block_probability(self, df: DataFrame) -> DataFrame:
        """Add ``p_block`` to a table made by :func:`lexical`."""
        if self.model is None:
            return df.withColumn("p_block", F.lit(self.default))
        scored = self.model.setProbabilityCol("gbt_probability").setRawPredictionCol("gbt_raw").setPredictionCol("gbt_class").transform(self.featured(df))
        return scored.withColumn("p_block", vector_to_array("gbt_probability")[1])


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, label): the URLs that a rule decides."""
    host, path = host_and_path(F.col("url"))
    verdicts = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, 1.0 if v == "block" else 0.0)))
    return pages.select("url", verdicts[matching_rule(host, path, rules)].alias("label")).where("label IS NOT NULL")


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block of every row; repeated rows stay, a null url has empty host and path."""
    model = UrlModel(labelled if labelled is not None else rule_labels(pages, rules))
    df = lexical(pages.select("page_id", "url"))
    df = model.block_probability(df.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)))
    by_rule = F.create_map(*(F.lit(x) for v, h, p in rules for x in (h + p, v)))
    by_model = F.when(F.col("p_block") >= BLOCK_AT, "block").otherwise("allow")
    return df.select("page_id", "host", "path", "rule", F.coalesce(by_rule[F.col("rule")], by_model).alias("verdict"), "p_block")
