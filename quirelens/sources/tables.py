"""Readers and writers with explicit schemas; every path goes to Spark untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "document_id STRING, file_name STRING, folder_name STRING, number_participants INT, course_name STRING"
LABELS = "label DOUBLE, doc_id STRING"
PUBLISHED = "document_id STRING, published STRING"
STATISTICS = "feature STRING, n BIGINT, mean DOUBLE, min DOUBLE, max DOUBLE"


def document_files(spark: SparkSession, paths: str | list[str], pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, path): files of folders or explicit paths; the id is the base name without extension. Contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(paths)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), "path")


def metadata(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """Metadata CSV with a header (the last two columns may be absent), for the given ids only."""
    head = spark.read.csv(path, header=True)
    have = set(head.columns)
    schema = ", ".join(c for c in METADATA.split(", ") if c.split(" ")[0] in have)
    rows = spark.read.csv(path, header=True, schema=schema).withColumnRenamed("document_id", "doc_id")
    return rows if ids is None else rows.join(ids.select("doc_id"), "doc_id", "left_semi")


def labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=LABELS)


def processed_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids from the one-row CSV form."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("doc_id")).select(F.trim("doc_id").alias("doc_id")).where("doc_id <> ''").distinct()


def classification(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and label from a semicolon CSV; rows whose flag is neither True nor False are dropped."""
    flag = F.when(F.col("published") == "False", 0.0).when(F.col("published") == "True", 1.0)
    return spark.read.csv(path, sep=";", header=True, schema=PUBLISHED).select(F.col("document_id").alias("doc_id"), flag.alias("label")).where("label IS NOT NULL")


def results(spark: SparkSession, glob: str) -> DataFrame:
    """All result rows of JSON files, those of samples and merged reports left out."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    own = spark.read.schema("doc_id STRING, probability DOUBLE, prediction STRING").json(glob)
    return own.where(~F.contains(name, F.lit("sample")) & ~F.contains(name, F.lit("merged")))


def write_results(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("errorifexists").format(kind).options(**({"header": "true"} if kind == "csv" else {})).save(path)


def read_statistics(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Scaling statistics, checked: one complete row for every feature and none for others."""
    stats = spark.read.schema(STATISTICS).parquet(path)
    names = [r[0] for r in stats.where("mean IS NOT NULL AND min IS NOT NULL AND max IS NOT NULL").select("feature").limit(len(features) + 1).collect()]
    if sorted(names) != sorted(features):
        raise ValueError("statistics do not fit the features")
    return stats


def write_statistics(stats: DataFrame, path: str, features: list[str]) -> None:
    """Scaling statistics, one row for every feature and none for others; checked by :func:`read_statistics`."""
    stats.where(F.col("feature").isin(features)).write.mode("overwrite").parquet(path)


def write_images(index: DataFrame, path: str, append: bool = True) -> None:
    """The page image index: doc_id, page_no, image and, where known, label."""
    index.write.mode("append" if append else "overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, ids: DataFrame, nets=("res", "xce", "inc")) -> DataFrame:
    """(doc_id, page_no, vector) of the chosen documents: the networks' vectors of a page behind each other."""
    rows = spark.read.parquet(path).join(ids.select("doc_id"), "doc_id", "left_semi")
    wide = rows.groupBy("doc_id", "page_no").agg(*(F.first(F.when(F.col("net") == n, F.col("vector")), ignorenulls=True).alias(n) for n in nets))
    return wide.where(" AND ".join(f"{n} IS NOT NULL" for n in nets)).select("doc_id", "page_no", F.concat(*nets).alias("vector"))


def append_vectors(df: DataFrame, path: str) -> None:
    """Page vectors, one folder per network."""
    df.write.partitionBy("net").mode("append").parquet(path)


def decoded(raw):
    """Text of bytes: UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))
