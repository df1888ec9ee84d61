"""Session helpers shared by every operator."""

from __future__ import annotations

import contextlib
import contextvars
import re
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Rows an Arrow batch holds at most; texts may be long, and workers hold a batch of input and one of output at a time.
BATCH_ROWS = "1000"
#: Bytes after which an Arrow batch ends; a longer text is a batch of its own.
BATCH_BYTES = str(4 << 20)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory follows single texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; the path goes to Spark's reader untouched (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may have none; it gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Paths that :func:`stored` wrote inside the open :func:`scratch`, if there is one.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and go on from there: encoded and compressed by columns, and readers take the columns they need.

    The shuffle files behind it go at once. Smaller on disk than :func:`cut_lineage`, which writes whole rows as they are in memory but knows
    how they are dealt. ``keep``: the files outlive the :func:`scratch` they are written in.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    if not keep and _written.get() is not None:
        _written.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """What :func:`stored` writes inside is deleted at the end, but what is kept; a step's result is to be stored with ``keep``."""
    paths: list[str] = []
    outer = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(outer)
        sc = spark.sparkContext
        for path in paths:
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that a partition of :func:`spread` should have.
SPREAD_ROWS = 60_000


def parts_for(df: DataFrame) -> int:
    """Partitions for work on all rows of ``df``: as many as a shuffle has, more where there are more rows, so that the memory of a task does not grow with them."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SPREAD_ROWS))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` into :func:`parts_for` partitions; windows and sums within the keys go on in them."""
    return df.repartition(parts_for(df), *keys)


#: Spark's own setting: the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The setting before each :func:`cleaned_up` that is open, of all threads.
_open: list[str] = []
_cleaning = threading.Lock()


@contextlib.contextmanager
def cleaned_up(spark: SparkSession):
    """Shuffle files of the executions inside are deleted when these end: jobs of many steps would pile them up."""
    with _cleaning:
        _open.append(spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning:
            before = _open[0]
            _open.pop()
            if not _open:  # the last one of several threads
                spark.conf.set(CLEANUP, before)


def side_by_side(spark: SparkSession, *steps: Callable[[], Any]) -> list:
    """What the steps return; their jobs run at the same time, so that small ones don't wait for each other."""
    with ThreadPoolExecutor(max(len(steps), 1)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def cut_and_clean(df: DataFrame) -> DataFrame:
    """:func:`cut_lineage`, and the shuffle files behind ``df`` are deleted at once; what was written stands without them."""
    with cleaned_up(df.sparkSession):
        return cut_lineage(df.select("*"))  # an execution of its own takes the setting as it is now
