"""Incremental scoring as a stream: batches of new files, results appended once, reports and statistics on top."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.operators import report, vectors
from quirelens.runtime import shared_folder


def score_new(source: DataFrame, score, results: str, checkpoint: str, key: str = "doc_id", done: DataFrame | None = None) -> None:
    """Score what the streaming ``source`` has not given yet and append it to ``results`` (Parquet); ends when all is done.

    The checkpoint resumes after a stop. A batch that runs again after a failure adds nothing twice, since it writes its
    own folder anew. Ids in ``done`` are processed already and not scored again.
    """

    def each(batch: DataFrame, number: int) -> None:
        # one folder per batch, overwritten when the batch is repeated
        fresh = batch if done is None else batch.join(done.select(key), key, "left_anti")
        score(fresh.dropDuplicates([key])).write.mode("overwrite").parquet(f"{results}/batch={number}")

    source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_results(spark: SparkSession, results: str, key: str = "doc_id") -> DataFrame:
    """All results, of several rows of one document the latest batch's."""
    rows = spark.read.option("basePath", results).parquet(results)
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (key, "batch"))), "batch").alias("r")).select(key, "r.*")


def running_report(stream: DataFrame) -> DataFrame:
    """The report's document, page and exposure counters as a streaming aggregate (complete mode)."""
    return stream.groupBy().agg(F.count(F.lit(1)).alias("n_docs"), *report.buckets(F.lit(1), "docs"), *report.buckets(F.col("pages"), "pages"), *report.buckets(F.col("pages") * F.col("participants"), "exposure"))


def merge_batch_statistics(spark: SparkSession, batch: DataFrame, features: list[str], folder: str, number: int) -> None:
    """Write the statistics of a batch under its number; :func:`current_statistics` merges what is there."""
    vectors.statistics(batch, features).write.mode("overwrite").parquet(f"{folder}/batch={number}")


def current_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.merge_statistics(spark.read.parquet(folder).drop("batch"))


def publish_report(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Run :func:`running_report` over what the stream has; each batch replaces the report of the one before under its own number."""

    def each(whole: DataFrame, number: int) -> None:
        whole.withColumn("batch", F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    running_report(stream).writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def published_report(spark: SparkSession, folder: str) -> DataFrame:
    """The latest report, and how many batches made one."""
    reports = spark.read.option("basePath", folder).parquet(folder)
    columns = [c for c in reports.columns if c != "batch"]
    return reports.agg(F.max_by(F.struct(*columns), "batch").alias("r"), F.count(F.lit(1)).alias("n_batches")).select("r.*", "n_batches")


def keep_statistics(stream: DataFrame, features: list[str], folder: str, checkpoint: str) -> None:
    """Statistics of every batch of the stream under its number; a batch that runs again replaces its own and is counted once."""

    def each(batch: DataFrame, number: int) -> None:
        merge_batch_statistics(batch.sparkSession, batch, features, folder, number)

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def arriving_events(spark: SparkSession, sf_dir: str, folder: str, files: int = 6) -> DataFrame:
    """The events as a stream of several files, two a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(files, "event_id").write.mode("overwrite").parquet(f"{folder}/arrived")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arrived")


def events_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents to score, by an available-now stream; one row per event type."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def score(batch: DataFrame) -> DataFrame:
        p = F.round(F.abs(F.col("value")) * 100).cast("bigint") % 1000 / 1000.0
        return batch.select("event_id", "event_type", p.alias("probability")).withColumn("prediction", report.decide(F.col("probability")))

    score_new(source, score, f"{folder}/results", f"{folder}/checkpoint", "event_id")
    return read_results(spark, f"{folder}/results", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("prediction") == "C").cast("int")).alias("n_positive"))
