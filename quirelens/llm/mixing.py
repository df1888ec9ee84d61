"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target number of words, so each of its documents has the same rate: target / size of the source.
The whole part of the rate is taken as whole copies; the fractional part is a copy probability. Probabilities are
paired: mass moves between two documents, in words, at random in either direction with chances that leave every
expectation alone, until one of the two is integral. So the expected words of the source stay exact to the end.

The pairing runs as a reduction tree: documents of a source fall into buckets of about ``FAN_IN`` by hash, a fold over
each bucket leaves at most one fractional document, and these residuals form the buckets of the next level. Only
narrow rows (id, size) move, a bucket is bounded, and a source of any size spreads over its buckets. The last
residual of a source is rounded to the nearer side, so a source misses its target by at most one document's half.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage

#: Weights by the sources' code-point order, repeating; share of all words; most copies of a document.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
FAN_IN = 128
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``rank`` (from 0) by source, null last, without bringing all sources to one task."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = cut_lineage(parts)
    # one row per partition
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("inside", inside).join(before.select("part", "before"), "part").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("inside") - 1).drop("part", "inside", "before")


def targets(sources: DataFrame) -> DataFrame:
    """source, source_size -> the same with weight and target.

    Where weights ask for more than ``MOST`` times a source's size the target stops there, and the excess goes to
    the other sources by weight, again and again until none is above. Each round is one aggregate of two numbers.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    own = cut_lineage(ranked(sources).withColumn("weight", weight))
    cap = MOST * F.col("source_size")
    total = SHARE * (own.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # a source that is full at one level is full at every higher one, so the level only rises
        full = cap <= F.lit(level) * F.col("weight")
        taken, open_weight = own.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if open_weight == 0:
            break
        new = (total - taken) / open_weight
        if new <= level:
            break
        level = new
    return own.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def uniform(*keys: Column) -> Column:
    """Repeatable number in [0, 1) from the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 40)) / float(1 << 40)


#: Equal rows that a task deals out at a time.
CHUNK = 1_024
UNIT = "struct<size:bigint,key:bigint,doc_id:{id},p:double>"


def fold(units: Column, id_type: str, level: Column) -> Column:
    """Pivotal rounding of an array of units (size, key, doc_id, p), largest first: (done: units with p 0 or 1, open: unit or null)."""
    unit = UNIT.format(id=id_type)
    start = F.struct(F.array().cast(f"array<{unit}>").alias("done"), F.lit(None).cast(unit).alias("open"))

    def with_p(u: Column, p: Column) -> Column:
        return F.struct(u["size"].alias("size"), u["key"].alias("key"), u["doc_id"].alias("doc_id"), p.alias("p")).cast(unit)

    def pair(acc: Column, b: Column) -> Column:
        a = acc["open"]
        ratio = b["size"] / a["size"]
        # mass for a, in copies of a: up until a is whole or b empty, down until a is empty or b whole
        up = F.least(1.0 - a["p"], b["p"] * ratio)
        down = F.least(a["p"], (1.0 - b["p"]) * ratio)
        rises = uniform(a["key"], b["key"], level) * (up + down) < down
        a_ends = F.when(rises, 1.0 - a["p"] <= b["p"] * ratio).otherwise(a["p"] <= (1.0 - b["p"]) * ratio)
        ended = F.when(a_ends, with_p(a, F.when(rises, 1.0).otherwise(0.0))).otherwise(with_p(b, F.when(rises, 0.0).otherwise(1.0)))
        rest_b = F.when(rises, b["p"] - (1.0 - a["p"]) / ratio).otherwise(b["p"] + a["p"] / ratio)
        rest_a = F.when(rises, a["p"] + b["p"] * ratio).otherwise(a["p"] - (1.0 - b["p"]) * ratio)
        rest = F.when(a_ends, with_p(b, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest_b)))).otherwise(with_p(a, F.greatest(F.lit(0.0), F.least(F.lit(1.0), rest_a))))
        return F.struct(F.array_append(acc["done"], ended).alias("done"), rest.alias("open"))

    return F.aggregate(units, start, lambda acc, b: F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), b.alias("open"))).otherwise(pair(acc, b)))


def each_row(units: DataFrame) -> DataFrame:
    """Units of ``rows`` equal rows back to rows, with ``all`` copies dealt evenly among them; large units in chunks over the cluster."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))
    large = units.where(F.col("rows") > CHUNK).withColumn("chunk", F.explode(chunks)).repartition("chunk")
    parts = units.where(F.col("rows") <= CHUNK).withColumn("chunk", F.lit(0).cast("long")).unionByName(large)
    first = F.col("chunk") * CHUNK
    numbered = parts.withColumn("k", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("rows")) - 1)))
    share = F.floor(F.col("all") / F.col("rows")) + (F.col("k") < F.col("all") % F.col("rows")).cast("long")
    return numbered.select("doc_id", "size", "rank", share.alias("copies"))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row.

    Null texts have size 0 and no copies; a null source is a source of its own, last in order; rows equal in id, text
    and source are one unit with their number, whose copies are dealt evenly among them; an empty table stays empty.
    Reruns give the same copies.
    """
    id_type = f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},rows:bigint,sure:bigint>"
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("key"))
    # narrow: the texts are read once; equal rows become a number before the shuffle
    sized = cut_lineage(sized.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("rows")))
    goal = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = sized.join(goal, sized["source"].eqNullSafe(goal["source"])).select(
        sized["doc_id"], sized["size"], sized["key"], "rows", "rank", F.floor(rate).alias("whole"), (F.col("rows") * (rate - F.floor(rate))).alias("mass"), (F.floor(F.col("n") / FAN_IN) + 1).alias("buckets"), "n"
    )
    rows = rows.withColumns({"sure": F.floor("mass"), "p": F.col("mass") - F.floor("mass")})
    idle = rows.where("size = 0 OR p = 0").select("doc_id", "rows", "size", "rank", F.when(F.col("size") > 0, F.col("rows") * F.col("whole") + F.col("sure")).otherwise(0).alias("all"))
    unit = F.struct("size", "key", F.struct("doc_id", "rows", "sure").alias("doc_id"), "p")

    def rounded(units: DataFrame) -> DataFrame:
        u = F.col("u")
        return units.select("u.doc_id.doc_id", "u.doc_id.rows", "u.size", "rank", (u["doc_id"]["rows"] * F.col("whole") + u["doc_id"]["sure"] + F.round(u["p"])).cast("long").alias("all"))

    # about FAN_IN documents of each source wait for the last level: small ones among them take up what large ones leave
    waits = (F.col("n") > FAN_IN) & (F.pmod(F.xxhash64("key", F.lit("waits")), F.col("n")) < FAN_IN)
    units = rows.where("size > 0 AND p > 0").select("rank", "whole", "buckets", unit.alias("unit"), waits.alias("waits"))
    open_, waiting = units.where("NOT waits").drop("waits"), units.where("waits").drop("waits")
    found, level = [idle], 0
    most = goal.agg(F.max("n")).first()[0] or 0
    while True:
        last = most <= FAN_IN
        if last:
            open_ = open_.unionByName(waiting)
        bucket = F.lit(0) if last else F.pmod(F.xxhash64("unit.key", F.lit(level)), F.col("buckets"))
        groups = open_.groupBy("rank", "whole", "buckets", bucket.alias("bucket")).agg(F.sort_array(F.collect_list("unit"), asc=False).alias("units"))
        folded = cut_lineage(groups.select("rank", "whole", "buckets", fold(F.col("units"), id_type, F.lit(level)).alias("f")))
        found.append(rounded(folded.select("rank", "whole", F.explode("f.done").alias("u"))))
        open_ = folded.where("f.open IS NOT NULL").select("rank", "whole", F.greatest(F.lit(1), F.floor(F.col("buckets") / FAN_IN) + 1).alias("buckets"), F.col("f.open").alias("unit"))
        level += 1
        if last:
            break
        most = most // FAN_IN + 1
    found.append(rounded(open_.withColumnRenamed("unit", "u")))
    out = found[0].withColumn("all", F.col("all").cast("long"))
    for f in found[1:]:
        out = out.unionByName(f)
    return each_row(out).join(goal.select("rank", "source", "source_size", "target"), "rank").select("doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The mixed table: each row of ``docs`` as often as it is taken, with all its columns."""
    by = ["_id", "_source", "_size"]
    key = [F.col("doc_id").alias("_id"), F.col("source").alias("_source"), words(F.col("text")).alias("_size")]
    # narrow: how often each (id, source, size) is taken, and how many rows have it
    taken = copies(docs).groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows")).where("_copies > 0")
    rows = docs.select(*(F.col(c).alias(f"r_{k}") for k, c in enumerate(docs.columns)), *key)
    joined = rows.join(taken.select(*(F.col(c).alias(f"t{c}") for c in by), "_copies", "_rows"), (F.col("_id").eqNullSafe(F.col("t_id"))) & (F.col("_source").eqNullSafe(F.col("t_source"))) & (F.col("_size") == F.col("t_size")))
    # rows that agree in id, source and size share their copies evenly; what is left over goes to the first of them
    order = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*(c for c in rows.columns if c.startswith("r_")))))
    several = joined.where("_rows > 1").withColumn("_share", F.floor(F.col("_copies") / F.col("_rows")) + (order <= F.col("_copies") % F.col("_rows")).cast("long"))
    each = joined.where("_rows = 1").withColumn("_share", F.col("_copies")).unionByName(several).where("_share > 0")
    return each.withColumn("_k", F.explode(F.array_repeat(F.lit(1), F.col("_share").cast("int")))).select(*(F.col(f"r_{k}").alias(c) for k, c in enumerate(docs.columns)))


def digest(docs: DataFrame) -> DataFrame:
    """:func:`copies` with the words taken; one row per row, null ids and repeated rows included, a null text takes 0."""
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
