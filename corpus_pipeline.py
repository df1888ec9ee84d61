"""Corpus pipeline: five stages, each over all that the one before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; the driver (or :func:`run`) writes it as Parquet
and reads it again for the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import bpe, jaccard_join, mixing, pii, quality
from quirelens.llm.queries import tokenizer_path
from quirelens.runtime import shared_folder, small_batches, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; kept ones lose their failing lines.

    Null and empty texts have too few words and go; repeated rows are judged alike, null ids count as any other.
    """
    small_batches(spark)
    kept = quality.judge(docs.select(*COLUMNS)).where("kept")
    return _counted(kept.withColumn("text", F.col("clean_text")))


def _keyed(docs: DataFrame) -> DataFrame:
    """Columns of ``documents`` and the key of the distinct (doc_id, text): by id, rows without one last, then by the text's hashes."""
    hashes = {"k_text": F.xxhash64("text"), "k_more": F.xxhash64(F.lit("key"), "text")}
    return docs.select(*COLUMNS).withColumns({"k_none": F.col("doc_id").isNull(), "k_id": F.coalesce("doc_id", F.lit(0)).cast("long")} | hashes)


KEY = ("k_none", "k_id", "k_text", "k_more")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays: the one with the smallest id, with or without an id.

    A document is a distinct (doc_id, text). Those without an id come last, those of one id go by their texts' hashes;
    of rows that are one document the one with the smallest other columns stays.
    """
    small_batches(spark)
    own = _keyed(docs)
    linked = jaccard_join.join(own.select(F.struct(*KEY).alias("doc_id"), "text"))
    heads = linked.where("doc_id = component_id").select("doc_id.*").distinct()
    kept = own.join(heads, list(KEY), "left_semi").groupBy(*KEY).agg(F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row"))
    return kept.select("row.*").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found gives way to its kind in brackets.

    Null texts stay null; rows are neither dropped nor merged, whatever their ids.
    """
    small_batches(spark)
    return _counted(pii.redact(docs.select(*COLUMNS)))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it.

    Null and empty texts have no words and are not taken; a null source is a source of its own, last in order.
    """
    small_batches(spark)
    return mixing.mix(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (packed), decoded text of every row; null and empty texts have no token and decode to the empty text."""
    small_batches(spark)
    both = bpe.encode_and_decode(docs.select("doc_id", "source", "text"), tokenizer_path())
    return both.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal_data),
    ("mixing sources", mixed_sources),
    ("BPE encoding and decoding", tokens),
]

#: The later stages are no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
