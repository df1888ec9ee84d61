"""Vectors: vocabularies, normalised term frequencies, scaling statistics."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions import text as T
from quirelens.operators import knn
from quirelens.runtime import cut_lineage
from quirelens.sources import tables as files


def vocabulary(docs: DataFrame, text: str = "text", size: int = 100, min_df: float = 0.01, max_df: float = 0.5, clean=T.clean_text) -> DataFrame:
    """(term, tf, df): the most frequent terms of the cleaned field among those in a fitting share of the documents; ties by term."""
    n = docs.count()
    terms = docs.select("doc_id", F.explode(T.tokens(clean(F.col(text)))).alias("term"))
    # one row per document and term first, so that document counts need no distinct
    each = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k"))
    stats = each.groupBy("term").agg(F.sum("k").alias("tf"), F.count(F.lit(1)).alias("df"))
    return stats.where((F.col("df") >= min_df * n) & (F.col("df") <= max_df * n)).orderBy(F.desc("tf"), "term").limit(size)


def term_frequencies(docs: DataFrame, vocab: DataFrame, text: str = "text", clean=T.clean_text) -> DataFrame:
    """(doc_id, term, weight): counts of vocabulary terms in the cleaned field, scaled to length 1 per document. The vocabulary has at most its size in rows."""
    terms = docs.select("doc_id", F.explode(T.tokens(clean(F.col(text)))).alias("term")).join(F.broadcast(vocab.select("term")), "term")
    counts = terms.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k"))
    norms = counts.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("k") * F.col("k"))).alias("norm"))
    return counts.join(norms, "doc_id").select("doc_id", "term", (F.col("k") / F.col("norm")).alias("weight"))


def unpivot(df: DataFrame, features: list[str]) -> DataFrame:
    return df.unpivot([c for c in df.columns if c not in features], features, "feature", "value")


def statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, n, mean, min, max) with NaN and null taken as 0; one pass over the wide table."""
    value = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    wide = df.agg(F.count(F.lit(1)).alias("n"), *(f(value(c)).alias(f"{c}__{k}") for c in features for k, f in (("mean", F.avg), ("min", F.min), ("max", F.max))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col("n"), *(F.col(f"{c}__{k}").alias(k) for k in ("mean", "min", "max"))) for c in features)))
    return wide.select(rows.alias("s")).select("s.*")


def merge_statistics(*stats: DataFrame) -> DataFrame:
    """Statistics of the union from those of its parts; means are weighted by their rows and exact to about 12 digits."""
    both = stats[0]
    for s in stats[1:]:
        both = both.unionByName(s)
    return both.groupBy("feature").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.min("min").alias("min"), F.max("max").alias("max")).select("feature", "n", "mean", "min", "max")


def scaled(value: Column, least: Column, most: Column, mean: Column | None = None) -> Column:
    """(x - min) / (max - min), not clipped; as it is where the range is empty. NaN and null become 0, or the mean if given."""
    fill = F.lit(0.0) if mean is None else mean
    x = F.coalesce(F.nanvl(value.cast("double"), fill), fill)
    return F.when(most > least, (x - least) / (most - least)).otherwise(x)


def scale(df: DataFrame, stats: DataFrame, features: list[str], impute: str = "zero") -> DataFrame:
    """The table with its features scaled. The statistics are one row per feature."""
    named = stats.groupBy().pivot("feature", features).agg(F.first("min").alias("min"), F.first("max").alias("max"), F.first("mean").alias("mean"))
    wide = df.crossJoin(F.broadcast(named))  # one row
    out = {c: scaled(F.col(c), F.col(f"{c}_min"), F.col(f"{c}_max"), F.col(f"{c}_mean") if impute == "mean" else None) for c in features}
    return wide.withColumns(out).select(*df.columns)


def normalise(spark: SparkSession, df: DataFrame, features: list[str], path: str, train: bool) -> DataFrame:
    """Scale by stored statistics. Training merges the batch's statistics into the stored ones first; without any,
    prediction fails."""
    if train:
        new = statistics(df, features)
        try:
            new = cut_lineage(merge_statistics(files.read_statistics(spark, path, features), new))
        except AnalysisException:  # nothing stored yet
            pass
        files.write_statistics(new, path, features)
    return scale(df, files.read_statistics(spark, path, features), features)


def knn_vote(queries: DataFrame, train: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, p1): share of class 1 among the k nearest training rows, weighted by inverse distance; zero distances take all.

    queries, train: doc_id / vec_id, vector (array of doubles), train with label. Queries meet the training rows by the bucket
    index, in blocks (:mod:`knn`). A query without a vector gets no share.
    """
    near = knn.search(knn.build(train.withColumnRenamed("vec_id", "t")), queries.withColumnRenamed("doc_id", "q"), k)
    votes = knn.vote(near).select(F.col("q").alias("doc_id"), "p1")
    any_row = F.broadcast(train.limit(1).select(F.lit(1).alias("_one")))  # without training rows nobody is answered
    return queries.select("doc_id").distinct().crossJoin(any_row).drop("_one").join(votes, "doc_id", "left")
