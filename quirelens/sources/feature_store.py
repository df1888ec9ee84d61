"""Store of feature rows with their texts beside, saved in generations.

A save writes one generation, so that it costs what it brings and not what the store holds; of several rows of a document the latest
generation's counts. A generation that begins anew hides all earlier ones. A save that runs again under its number replaces
its own files. Texts lie apart: who needs numbers only does not read them. :func:`compact` brings a store down to one generation.

Rows without doc_id are not saved. Of repeated rows of one document in a save one is kept, the largest by its fields.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY, TEXT = "doc_id", "text"


def generations(spark: SparkSession, folder: str) -> list[tuple[int, bool]]:
    """(number, whether it begins anew) of the saves that are complete, in order. One small row each."""
    try:
        marks = spark.read.option("basePath", f"{folder}/saved").parquet(f"{folder}/saved")
    except AnalysisException:  # nothing saved yet
        return []
    return sorted((int(r["generation"]), r["anew"]) for r in marks.select("generation", "anew").collect())


def save(features: DataFrame, folder: str, anew: bool = False, generation: int | None = None) -> int:
    """Save ``features`` (doc_id, text, any fields) as the next generation, or under a number of its own; returns the number."""
    spark = features.sparkSession
    known = generations(spark, folder)
    number = generation if generation is not None else (known[-1][0] + 1 if known else 1)
    fields = [c for c in features.columns if c not in (KEY, TEXT)]
    single = features.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.max(F.struct(*fields, TEXT)).alias("row"))
    single.select(KEY, *(F.col(f"row.{c}").alias(c) for c in fields)).write.mode("overwrite").parquet(f"{folder}/rows/generation={number}")
    single.select(KEY, F.col(f"row.{TEXT}").alias(TEXT)).where(F.col(TEXT).isNotNull()).write.mode("overwrite").parquet(f"{folder}/texts/generation={number}")
    # the mark comes last: a save that breaks off is not seen
    spark.createDataFrame([(anew,)], "anew boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/saved/generation={number}")
    return number


def _visible(spark: SparkSession, folder: str) -> list[int]:
    numbers = []
    for number, anew in generations(spark, folder):
        numbers = [number] if anew else [*numbers, number]
    return numbers


def _part(spark: SparkSession, folder: str, part: str, numbers: list[int]) -> DataFrame:
    """One part of the visible generations; a field that only some have is null in the others."""
    paths = [f"{folder}/{part}/generation={n}" for n in numbers]
    return spark.read.option("basePath", f"{folder}/{part}").option("mergeSchema", "true").parquet(*paths)


def load(spark: SparkSession, folder: str, texts: bool = True) -> DataFrame:
    """The latest row of every saved document, with its text (null where none was saved) or without."""
    numbers = _visible(spark, folder)
    if not numbers:
        raise ValueError(f"nothing is saved in {folder}")
    rows = _part(spark, folder, "rows", numbers)
    fields = [c for c in rows.columns if c not in (KEY, "generation")]
    latest = rows.groupBy(KEY).agg(F.max_by(F.struct("generation", *fields), "generation").alias("row")).select(KEY, "row.*")
    if texts:
        latest = latest.join(_part(spark, folder, "texts", numbers), [KEY, "generation"], "left")
    return latest.drop("generation")


def load_or_repair(batch: DataFrame, folder: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete rows of the documents of ``batch``, documents of ``batch`` still to be extracted).

    A row is complete with all ``required`` fields and its text; a document with an incomplete row is extracted again.
    """
    spark = batch.sparkSession
    if not _visible(spark, folder):
        return batch.select(KEY).limit(0), batch
    saved = load(spark, folder)
    missing = [c for c in required if c not in saved.columns]
    complete = saved.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*required, TEXT])) if not missing else saved.limit(0)
    return complete.join(batch.select(KEY).distinct(), KEY, "left_semi"), batch.join(complete.select(KEY), KEY, "left_anti")


def compact(spark: SparkSession, folder: str) -> int:
    """Save the latest rows as a generation that begins anew; earlier ones stay on disk until they are deleted."""
    return save(load(spark, folder), folder, anew=True)
