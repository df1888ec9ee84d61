"""Properties of documents from captured ``Key: value`` text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules in the order in which they are tried on a lower-cased line (fixed values).
KEYS = ("creator", "producer", "file size", "page rot", "page size")


def parse(docs: DataFrame) -> DataFrame:
    """doc_id, txt -> file_size, page_rot, page_size_x, page_size_y, producer, creator.

    A line belongs to the first key it contains (a value that holds the word counts too); its value is the text between
    the first and the second colon; the last line of a key wins. What no line reports is -1 or "empty"; a document
    without any output (null or blank text) has NaN and "passwordprotected".
    """
    lines = docs.select("doc_id", F.posexplode_outer(F.split("txt", "\n")).alias("no", "line"))
    low = F.lower("line")
    key = F.lit(None).cast("string")
    for k in reversed(KEYS):
        key = F.when(F.contains(low, F.lit(k)), k).otherwise(key)
    value = F.trim(F.get(F.split("line", ":"), F.lit(1)))
    some = F.max(F.coalesce((F.trim("line") != "").cast("int"), F.lit(0))).alias("some")
    last = {k: F.max_by(F.when(key == k, value), F.when(key == k, F.col("no"))).alias(k.replace(" ", "_")) for k in KEYS}
    own = lines.groupBy("doc_id").agg(some, *last.values())
    number = lambda c: F.when(F.col("some") == 1, F.coalesce(c.try_cast("double"), F.lit(-1.0))).otherwise(F.lit(float("nan")))
    text = lambda c: F.when(F.col("some") == 1, F.coalesce(c, F.lit("empty"))).otherwise("passwordprotected")
    size = r"([0-9.]+)\s+x\s+([0-9.]+)"
    return own.select(
        "doc_id",
        number(F.regexp_extract("file_size", r"^(\S+)", 1)).alias("file_size"),
        number(F.regexp_extract("page_rot", r"^(\S+)", 1)).alias("page_rot"),
        number(F.regexp_extract("page_size", size, 1)).alias("page_size_x"),
        number(F.regexp_extract("page_size", size, 2)).alias("page_size_y"),
        text(F.col("producer")).alias("producer"),
        text(F.col("creator")).alias("creator"),
    )
