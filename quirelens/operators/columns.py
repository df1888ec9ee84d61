"""Table tools: columns of feature files, page rows of documents, custom reports, batches in order, stored vocabularies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirelens.operators import curation


def subset(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns, in this order; a missing one is an error of the plan."""
    return df.select(*names)


def detach(features: DataFrame, feature: str) -> DataFrame:
    """One feature of a feature file with its class and name."""
    return features.select(feature, "class", "name")


def substitute(features: DataFrame, other: DataFrame, feature: str) -> DataFrame:
    """``feature`` as the other file has it; names that it lacks keep their own value. A name stands once in the other file."""
    new = other.select("name", F.col(feature).alias("_new"))
    return features.join(new, "name", "left").withColumn(feature, F.coalesce("_new", feature)).select(*features.columns)


def pages_of(index: DataFrame) -> DataFrame:
    """(doc_id, n_pages, first_image) from the page image index."""
    return index.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), F.min("image").alias("first_image"))


def page_rows(docs: DataFrame, index: DataFrame) -> DataFrame:
    """The index rows of the wanted documents, with their place in page order."""
    return docs.join(index, "doc_id").select("doc_id", "page_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no")).cast("long").alias("place"))


def split_pages(pages: DataFrame, split: DataFrame) -> DataFrame:
    """Pages with ``part`` of their document: no document lies on both sides. A page without a document's part is an error."""
    out = pages.join(split.select("doc_id", "part"), "doc_id", "left")
    return out.withColumn("part", F.when(F.col("part").isNull(), F.raise_error(F.lit("a page's document has no part"))).otherwise(F.col("part")))


def report_rows(results: DataFrame, counts: DataFrame, meta: DataFrame, order: str) -> DataFrame:
    """Results with page counts and metadata; of several results of a document the one with the greatest ``order``."""
    latest = results.groupBy("doc_id").agg(F.max_by(F.struct(*(c for c in results.columns if c not in ("doc_id", order))), order).alias("r")).select("doc_id", "r.*")
    return latest.join(counts, "doc_id").join(meta, "doc_id")


def concatenated(batches: list[DataFrame], key: str) -> DataFrame:
    """All batches with ``place``: first by batch, inside it by key."""
    each = [b.withColumn("_order", F.struct(F.lit(k).alias("b"), F.col(key).alias("k"))) for k, b in enumerate(batches)]
    return curation.ranked(reduce(DataFrame.unionByName, each), "_order").drop("_order")


def stored_vocabulary(rows: DataFrame, path: str, least: int, size: int = 100) -> DataFrame:
    """(term): the ``size`` most frequent terms of ``rows`` (terms: array), written to ``path``; a corpus of fewer than
    ``least`` documents takes what is stored there."""
    if rows.limit(least).count() >= least:
        terms = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("k"))
        terms.orderBy(F.desc("k"), "term").limit(size).select("term").write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)
