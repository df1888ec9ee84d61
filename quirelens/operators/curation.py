"""Ingest and curation: joins with defaults and checks, resuming, splits, samples, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage


def with_metadata(docs: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on doc_id; missing text is a blank, missing participants 0."""
    defaults = {"file_name": " ", "folder_name": " ", "course_name": " ", "number_participants": 0}
    return docs.join(metadata, "doc_id", "left").fillna({k: v for k, v in defaults.items() if k in metadata.columns})


def parse_inline(text: Column) -> Column:
    """Map of ``key=value,key=value``."""
    return F.str_to_map(text, F.lit(","), F.lit("="))


def unlabelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents without a label: must be empty before training."""
    return docs.join(labels, "doc_id", "left_anti")


def with_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    missing = unlabelled(docs, labels).limit(1).count()
    if missing:
        raise ValueError("some documents have no label")
    return docs.join(labels, "doc_id")


def still_to_do(batch: DataFrame, saved: DataFrame, required: list[str]) -> DataFrame:
    """Documents of the batch that have no complete saved row: unsaved ones, and those whose saved fields are missing."""
    complete = saved
    for c in required:
        complete = complete.where(F.col(c).isNotNull())
    return batch.join(complete, "doc_id", "left_anti")


def unseen_by_path(images: DataFrame, saved: DataFrame, key: str) -> DataFrame:
    """Images none of whose saved ids (``saved_id``, runs of digits) is part of their path.

    An id that a path holds is a part of one of its runs of digits, so all parts of these runs meet the ids by equality.
    """
    # only parts as long as some saved id; there are as many lengths as the longest id has digits
    lengths = saved.agg(F.collect_set(F.length("saved_id")).alias("lengths"))  # one row
    runs = F.regexp_extract_all("path", F.lit("([0-9]+)"), F.lit(1))
    fitting = lambda r: F.filter("lengths", lambda n: (n > 0) & (n <= F.length(r)))
    cuts = F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(fitting(r), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: r.substr(i, n))))))
    held = images.crossJoin(F.broadcast(lengths)).select(key, F.explode(F.array_distinct(cuts)).alias("saved_id")).join(saved.select("saved_id"), "saved_id").select(key).distinct()
    return images.join(held, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    return old.join(new, key, "left_anti").unionByName(new, allowMissingColumns=True)


def same_rows(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that only one of two feature tables has: must be empty before they are joined."""
    return left.select(key, F.lit(True).alias("l")).join(right.select(key, F.lit(True).alias("r")), key, "full").where("l IS NULL OR r IS NULL").select(key)


def order_key(seed: int, key: Column) -> Column:
    """Repeatable shuffling key that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def sample(df: DataFrame, n: int, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """n rows by hash order."""
    return df.withColumn("_k", order_key(seed, F.col(key))).orderBy("_k", key).limit(n).drop("_k")


def ranked(df: DataFrame, order: str, within: str | None = None) -> DataFrame:
    """Add ``place`` (from 1) by the column ``order``, overall or within a key, without bringing all rows to one task.

    Rows are dealt by ranges of (key, order); counts of the ranges (one row per range and key) give each its first place.
    """
    keys = [within] if within else []
    dealt = df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    sizes = dealt.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over((Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order))
    return dealt.withColumn("_inside", inside).join(starts, ["_part", *keys]).withColumn("place", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def split(df: DataFrame, share: float = 0.8, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Add ``part``: exactly floor(share * n) rows are train, the others test."""
    n = df.count()
    return ranked(df.withColumn("_k", order_key(seed, F.col(key))), "_k").withColumn("part", F.when(F.col("place") <= int(share * n), "train").otherwise("test")).drop("_k", "place")


def balanced(df: DataFrame, label: str, seed: int = 42, key: str = "doc_id", n: int | None = None) -> DataFrame:
    """As many rows of each class as the smallest has (or n), by hash order."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0] or 0
    least = min(least, n) if n is not None else least
    return ranked(df.withColumn("_k", order_key(seed, F.col(key))), "_k", label).where(F.col("place") <= least).drop("_k", "place")


def review(results: DataFrame, n: int = 100, by: str = "probability", seed: int = 42) -> DataFrame:
    """Up to n positives for a look by hand: probability above one half, or decision C."""
    return sample(results.where("probability > 0.5" if by == "probability" else "prediction = 'C'"), n, seed)


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight n / (k * n_c) of each class."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))  # one row
    return counts.crossJoin(F.broadcast(total)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))
