"""N-gram Jaccard join by a token-group matrix: linked documents, their classes and components, exactly.

Documents are sets of ``SHINGLE``-word shingles (64-bit hashes); equal sets are one class. Two classes link at
``PERCENT`` % similarity.

1. Classes that may link. A shingle that no other class holds is in no overlap, so a class with more than a fifth of such
   shingles has no links. A fixed share of the shingles, those with low hashes, tells this for most classes; a bounded
   list of very frequent shingles counts as shared and is not dealt out. Whole sets are made for the rest only.
2. Groups. Similar sets are put into groups by their least and their commonest shingles; each set asks one leader of a
   group, the one that shares most of its own set. Verified links merge components. Sets near one leader are a crowd; inside
   it they are known by their differences from the crowd's core, which tell overlaps exactly. Members near the core link
   with its centre, others are compared only where they share differences, so a crowd of near copies is not compared
   pair by pair.
3. Matrix. Each group's union of shingles is stored as rows (shingle, group): first for sets of about one size, where the
   overlap with the union shows which sets can link beyond their own group at all, then for the groups themselves.
   A query's overlap with the union bounds its overlap with any member, and only groups that reach the needed overlap
   are opened and compared member by member. In the common order of shingles, rarest first, linked sets share one among
   their first ``n - ceil(0.8 n) + 1``, so the second matrix holds first shingles only.

Every link found is verified on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm import bytescan as bs
from quirelens.runtime import cut_and_clean, cut_lineage

SHINGLE, PERCENT = 5, 80
#: Questions a class and round of leaders, similarity in percent at which a set counts to its leader's crowd, frequent
#: shingles left out of the exchange at most.
SIGNATURES, NEAR, MAX_FREQUENT = 4, 50, 100_000
#: Shingles with hashes below this (0.3 of all) tell which classes may link; above a fifth, or they tell nothing.
LOW = np.uint64(3 * (1 << 64) // 10)
#: Low hashes counted per flush for the frequent list, the count in a flush that makes a shingle a candidate, and in all.
FLUSH, FLUSH_COUNT, FREQUENT = 2_000_000, 4, 24
#: Rows with whole sets that a partition of a written table holds.
SETS = 2_000
#: Least and most bits of the filter that keeps needless sets from being written (a full filter only costs time).
FILTER_BITS = (1 << 16, 1 << 27)


def written(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """``df`` written and read again in as few partitions as its rows need, so that small tables don't make many small files."""
    out = cut_and_clean(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def row_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle hash), sorted, each once."""
    low = bs.lower_ascii(data)
    s, e, row = bs.word_bounds(low, offsets)
    words = bs.span_hash(bs.prefix_hash(low), s, e) if len(s) else np.zeros(0, np.uint64)
    return bs.distinct_in_row(*bs.shingles(words, row, len(offsets) - 1, SHINGLE))


def set_number(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, class number) per row; equal sets have equal numbers, empty sets 0."""
    size = np.bincount(rows, minlength=n)
    total = np.zeros(n, np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        heads = np.concatenate([[0], np.cumsum(size[some])[:-1]])
        total[some] = np.add.reduceat(bs.mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), heads)
        total[some] = bs.mix(total[some] + size[some].astype(np.uint64))
    return size.astype(np.int64), total.view(np.int64)


def needed(a: Column, b: Column) -> Column:
    """Least overlap of linked sets of sizes a and b: 100 * i >= PERCENT * (a + b - i)."""
    return F.ceil(PERCENT * (a + b) / (100 + PERCENT) - 1e-9)


def first_column(n: Column) -> Column:
    return n - F.ceil(PERCENT * n / 100 - 1e-9) + 1


def shared_at_least(a: Column, b: Column) -> Column:
    """Least number of first shingles that linked sets of sizes a and b share: of the set whose first shingles end
    earlier, all common ones up to there are among them, and only those behind may be common besides."""
    return F.least(needed(a, b) - a + first_column(a), needed(a, b) - b + first_column(b))


def close(a: Column, b: Column) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n, c (class number), frequent: candidates for the frequent list, on some rows."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, offsets in bs.text_steps(batch, "text"):
                rows, h = row_sets(data, offsets)
                n, c = set_number(rows, h, hi - lo)
                low = h[h < LOW]
                held.append(low)
                size += len(low)
                frequent = [None] * (hi - lo)
                if size > FLUSH:
                    u, k = np.unique(np.concatenate(held), return_counts=True)
                    frequent[0] = [{"h": int(x), "k": int(y)} for x, y in zip(u[k >= FLUSH_COUNT], k[k >= FLUSH_COUNT], strict=True)]
                    held, size = [], 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(c), pa.array(frequent, pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())])))], ["doc_id", "n", "c", "frequent"])
        if held:
            u, k = np.unique(np.concatenate(held), return_counts=True)
            last = [{"h": int(x), "k": int(y)} for x, y in zip(u[k >= FLUSH_COUNT], k[k >= FLUSH_COUNT], strict=True)]
            if last:  # a row of its own, without a document
                kind = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays([pa.array([None], kind), pa.array([-1], pa.int64()), pa.array([0], pa.int64()), pa.array([last], pa.list_(pa.struct([("h", pa.int64()), ("k", pa.int64())])))], ["doc_id", "n", "c", "frequent"])
        held.clear()
        bs.give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n bigint, c bigint, frequent array<struct<h: bigint, k: bigint>>")


def frequent_list(measured: DataFrame) -> np.ndarray:
    """The most frequent low shingles, MAX_FREQUENT at most, sorted."""
    each = measured.where("frequent IS NOT NULL").select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.k").alias("k")).where(F.col("k") > FREQUENT)
    top = each.orderBy(F.desc("k"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    return np.sort(top["h"].to_numpy().astype(np.int64).view(np.uint64))


def low_rows(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(k: low shingle, c, need) of each class, a class once per step; shingles of ``frequent`` are known to be shared and left out.

    ``need`` of the rows of a class must be shared with other classes, or more than a fifth of its set is its own and
    nothing can link with it. A class that needs none has a row with its own number as k besides.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # MAX_FREQUENT numbers at most

    def run(batches):
        last = shared.value
        for batch in batches:
            for lo, hi, data, offsets in bs.text_steps(batch, "text"):
                rows, h = row_sets(data, offsets)
                n, c = set_number(rows, h, hi - lo)
                _, once = np.unique(c, return_index=True)
                take = np.zeros(hi - lo, bool)
                take[once] = True
                take &= n > 0
                go = (h < LOW) & take[rows]
                if len(last) and len(h):
                    go &= last[np.minimum(np.searchsorted(last, h), len(last) - 1)] != h
                rows, h = rows[go], h[go]
                need = np.bincount(rows, minlength=hi - lo) - (n - -(-PERCENT * n // 100))
                auto = np.flatnonzero(take & (need <= 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([h.view(np.int64), c[auto]])), pa.array(np.concatenate([c[rows], c[auto]])), pa.array(np.concatenate([need[rows], need[auto]]))],
                    ["k", "c", "need"],
                )
        bs.give_back()

    return docs.select("text").mapInArrow(run, "k bigint, c bigint, need bigint")


def linkable(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """(c) of the classes that may link by what their low shingles show: at most a fifth of the set is known to be its own."""
    by = Window.partitionBy("k")  # shingles of many classes are in the frequent list and have no rows here
    met = low_rows(docs, frequent_list(measured)).withColumn("lo", F.min("c").over(by)).withColumn("hi", F.max("c").over(by))
    met = met.where("lo < hi OR need <= 0").select("k", "c", "need").distinct()
    return written(met.groupBy("c").agg(F.count(F.lit(1)).alias("f"), F.max("need").alias("need")).where("f >= need").select("c"))


def class_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, hs: whole set) of the classes in ``wanted`` (distinct c), read from the texts again."""
    bits = filter_bits(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(filter_of(wanted, bits))

    def run(batches):
        known = shared.value
        for batch in batches:
            for lo, hi, data, offsets in bs.text_steps(batch, "text"):
                rows, h = row_sets(data, offsets)
                n, c = set_number(rows, h, hi - lo)
                u = c.view(np.uint64)
                hit = n > 0
                for part in (u % np.uint64(bits), bs.mix(u) % np.uint64(bits)):
                    p = part.astype(np.int64)
                    hit &= (known[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) == 1
                _, once = np.unique(c, return_index=True)
                first = np.zeros(len(c), bool)
                first[once] = True
                chosen = hit & first
                mine = chosen[rows]
                ends = np.concatenate([[0], np.cumsum(n[chosen])])
                sets = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(h[mine].view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c[chosen]), sets], ["c", "hs"])
        bs.give_back()

    found = docs.select("text").mapInArrow(run, "c bigint, hs array<bigint>")
    return found.join(wanted, "c", "left_semi").groupBy("c").agg(F.first("hs").alias("hs"))


def filter_bits(numbers: DataFrame) -> int:
    """Size of the filter: about 16 bits a number, within FILTER_BITS."""
    least, most = FILTER_BITS
    return min(most, max(least, 1 << (16 * numbers.count()).bit_length()))


def filter_of(numbers: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``bits`` bits over the column c: partial filters are or-ed word by word in Spark."""

    def run(batches):
        out = np.zeros(bits // 32, np.uint32)
        for batch in batches:
            u = batch.column(0).to_numpy().view(np.uint64)
            for part in (u % np.uint64(bits), bs.mix(u) % np.uint64(bits)):
                p = part.astype(np.int64)
                np.bitwise_or.at(out, p >> 5, np.uint32(1) << (p & 31).astype(np.uint32))
        w = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array(out[w].astype(np.int64))], ["w", "m"])

    words = numbers.select("c").mapInArrow(run, "w bigint, m bigint").groupBy("w").agg(F.bit_or("m").alias("m")).toArrow()  # bits / 32 rows at most
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy()] = words["m"].to_numpy().astype(np.uint32)
    return out


def shared_parts(sets: DataFrame) -> DataFrame:
    """(c, n, toks: (df, h) of the shingles that other sets have too, rarest first) of the sets that keep enough of them.

    What is left out is in one set alone, so overlaps are those of the parts. In the common order such shingles come
    first, then the others by the number of sets that hold them.
    """
    each = sets.select("c", F.size("hs").cast("long").alias("n"), F.explode("hs").alias("h"))
    counts = written(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"))  # written, so that a hot shingle's side of the join can be split
    kept = each.join(counts, "h").select("c", "n", "h", "df").repartition("c")
    parts = kept.groupBy("c").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "h"))).alias("toks"))  # at most a set
    return parts.where(100 * F.size("toks") >= PERCENT * F.col("n"))


def compared(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sizes and overlap; b is the side that may be in many pairs."""
    own = parts.select("c", "n", F.transform("toks", lambda x: x["h"]).alias("hs"))
    both = pairs.join(own.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("hs").alias("ha")), "a").join(own.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("hs").alias("hb")), "b")
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).alias("common"))


def at_least(percent: int) -> Column:
    """Whether pairs of :func:`compared` reach this similarity."""
    return 100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))


def components(links: DataFrame) -> DataFrame:
    """(c, g) for every end of a link: g is the smallest node that links reach from c.

    Labels fall to the least neighbour's, twice in one job, then jump to that label's own label.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = edges.groupBy(F.col("a").alias("c")).agg(F.least(F.col("a"), F.min("b")).alias("g"))
    while True:
        for _ in range(2):
            near = edges.join(labels, F.col("b") == F.col("c")).groupBy("a").agg(F.min("g").alias("low"))
            labels = labels.join(near, F.col("c") == F.col("a")).select("c", F.least("g", "low").alias("g"), F.col("g").alias("old"))
        labels = written(labels)
        if labels.where("g <> old").isEmpty():
            return labels.select("c", "g")
        jump = labels.select(F.col("c").alias("via"), F.col("g").alias("far"))
        labels = labels.join(jump, F.col("g") == F.col("via"), "left").select("c", F.least("g", F.coalesce("far", "g")).alias("g"))


def merge_groups(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Groups (c, g) after further links: the components of the graph of groups."""
    if links.isEmpty():
        return groups
    ends = links.join(groups.select(F.col("c").alias("a"), F.col("g").alias("ga")), "a").join(groups.select(F.col("c").alias("b"), F.col("g").alias("gb")), "b")
    moved = components(ends.where("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct())
    return written(groups.join(moved.select(F.col("c").alias("g"), F.col("g").alias("to")), "g", "left").select("c", F.coalesce("to", "g").alias("g")))


def ask_leaders(live: DataFrame, marks: list[Column]) -> DataFrame:
    """(a: member, b: leader), one question a class and mark at most: sets of about one size with one mark ask the one among
    them that shares most of its own set."""
    band = lambda j: F.floor(F.log("n") / np.log(1.25) + j % 2 / 2)
    keys = [F.struct(F.xxhash64(mark, band(j), F.lit(j % 2)).alias("s")) for j, mark in enumerate(marks)]
    signed = live.select("c", "n", "g", (F.size("toks") / F.col("n")).alias("share"), F.explode(F.array(*keys)).alias("x")).select("c", "n", "g", "share", "x.s").where("s IS NOT NULL")
    leads = signed.groupBy("s").agg(F.max_by(F.struct("c", "n", "g"), F.struct("share", "c")).alias("lead"), (F.min("g") < F.max("g")).alias("open")).where("open").select("s", "lead")
    met = signed.join(written(leads), "s").where((F.col("g") != F.col("lead.g")) & close(F.col("n"), F.col("lead.n")))
    return met.select(F.col("c").alias("a"), F.col("lead.c").alias("b")).distinct()


def least_shingles() -> list[Column]:
    return [F.array_min(F.transform("toks", lambda x, j=j: F.xxhash64(x["h"], F.lit(j)))) for j in range(SIGNATURES)]


def commonest_shingles() -> list[Column]:
    return [F.get("toks", F.size("toks") - 1 - j)["h"] for j in range(SIGNATURES)]


def deviations(live: DataFrame) -> DataFrame:
    """(c, g, y, rest, x) of the crowds y that hold several components, seen from the crowd's core.

    The core is what most members hold. ``rest`` is where a set differs from it, apart from shingles that no other set
    has; ``x`` grows with the number of all differences, those included. Two sets differ in what only one of them has in
    its differences, so they link exactly if x + x' <= 2 * (100 + PERCENT) * (number of differences they share).
    """
    own = live.select("c", "n", "g", "y", F.transform("toks", lambda x: x["h"]).alias("hs"))
    crowds = written(own.groupBy("y").agg(F.count(F.lit(1)).alias("m"), (F.min("g") < F.max("g")).alias("open")).where("open").select("y", "m"))
    own = own.join(crowds, "y")
    held = own.select("y", "m", F.explode("hs").alias("h")).groupBy("y", "m", "h").agg(F.count(F.lit(1)).alias("k")).where("2 * k > m")
    core = written(held.groupBy("y").agg(F.collect_list("h").alias("core")))  # under twice the mean size of its sets
    seen = own.join(core, "y", "left").withColumn("core", F.coalesce("core", F.array().cast("array<bigint>")))
    rest = F.array_sort(F.concat(F.array_except("core", "hs"), F.array_except("hs", "core")))
    seen = seen.select("c", "g", "y", "n", (F.col("n") - F.size("hs")).alias("alone"), rest.alias("rest"))
    x = (100 + PERCENT) * (F.size("rest") + F.col("alone")) - (100 - PERCENT) * F.col("n")
    return written(seen.select("c", "g", "y", "rest", x.alias("x")), SETS)


def centres(seen: DataFrame) -> DataFrame:
    return written(seen.groupBy("y").agg(F.min_by(F.struct("c", "g", "x"), F.struct("x", "c")).alias("centre")))


def core_links(seen: DataFrame) -> DataFrame:
    """(a, b): members so near the core that they link with the nearest one, whatever differences they share."""
    return seen.join(centres(seen), "y").where((F.col("x") + F.col("centre.x") <= 0) & (F.col("c") != F.col("centre.c"))).select(F.col("c").alias("a"), F.col("centre.c").alias("b"))


def deviant_links(seen: DataFrame) -> DataFrame:
    """(a, b): the other links between components of a crowd. Such sets share differences, at least one among the first
    of each, so the index of differences finds them; a member of the centre's component is only asked, never asks."""
    placed = seen.join(centres(seen), "y").withColumn("inside", F.col("g") == F.col("centre.g"))
    outer = written(placed.where("NOT inside").groupBy("y").agg(F.min("x").alias("x_out")))
    placed = placed.join(outer, "y")
    need = F.greatest(F.lit(1), F.ceil((F.col("x") + F.when(F.col("inside"), F.col("x_out")).otherwise(F.least("centre.x", "x_out"))) / (2.0 * (100 + PERCENT)) - 1e-9))
    count = F.greatest(F.size("rest") - need + 1, F.lit(0)).cast("int")
    rows = written(placed.select("y", "c", "g", "inside", F.explode(F.slice("rest", F.lit(1), count)).alias("h")))
    asking = rows.where("NOT inside").select("y", "h", F.col("c").alias("a"), F.col("g").alias("ga"))
    told = rows.select("y", "h", F.col("c").alias("b"), F.col("g").alias("gb"), "inside")
    pairs = asking.join(told, ["y", "h"]).where((F.col("ga") != F.col("gb")) & (F.col("inside") | (F.col("a") < F.col("b")))).select("a", "b").distinct()
    side = lambda k: seen.select(F.col("c").alias(k), F.col("x").alias(f"x{k}"), F.col("rest").alias(f"rest_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(F.col("xa") + F.col("xb") <= 2 * (100 + PERCENT) * F.size(F.array_intersect("rest_a", "rest_b"))).select("a", "b")


def firsts(live: DataFrame) -> DataFrame:
    """(h, c, n, g): the shared ones among the first shingles of each set."""
    alone = F.col("n") - F.size("toks")
    count = F.greatest(first_column(F.col("n")) - alone, F.lit(0)).cast("int")
    return live.select("c", "n", "g", F.explode(F.slice("toks", F.lit(1), count)).alias("x")).select("x.h", "c", "n", "g")


def meeting(rows: DataFrame) -> DataFrame:
    """The rows of :func:`firsts` whose shingle is held by another group too, of sets that share enough of their first shingles."""
    spans = written(rows.groupBy("h").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("n").alias("n0"), F.max("n").alias("n1")).where("g0 < g1"))
    met = rows.join(spans, "h")
    low, high = F.greatest("n0", F.ceil(PERCENT * F.col("n") / 100 - 1e-9)), F.least("n1", F.floor(100 * F.col("n") / PERCENT + 1e-9))
    seen = met.groupBy("c", "n").agg(F.count(F.lit(1)).alias("shared"), F.min(low).alias("low"), F.max(high).alias("high"))
    # over partners' sizes the bound grows up to n and falls beyond (up to rounding, hence 2)
    bound = F.least(shared_at_least(F.col("n"), F.col("low")), shared_at_least(F.col("n"), F.col("high"))) - 2
    return met.join(seen.where((F.col("low") <= F.col("high")) & (F.col("shared") >= bound)).select("c"), "c", "left_semi").select("h", "c", "n", "g")


def qualifying(live: DataFrame) -> DataFrame:
    """The sets of ``live`` (c, n, toks, g) that overlap enough with the union of some group of sets of about their size.

    Token-group matrix: per shingle, the groups that hold it, here classes of sizes within 4 % (a few hundred at most), each
    with its smallest and largest size and component. A set's own component does not count.
    """
    each = live.select("c", "n", "g", F.explode("toks").alias("x")).select("x.h", "c", "n", "g")
    band = F.floor(F.log("n") / np.log(1.04))
    cells = each.groupBy("h", band.alias("band")).agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    matrix = written(cells.groupBy("h").agg(F.collect_list(F.struct("band", "g0", "g1", "n0", "n1")).alias("cells"), F.min("g0").alias("low"), F.max("g1").alias("high")).where("low < high").select("h", "cells"))
    open_ = lambda x: ((x["g0"] != F.col("g")) | (x["g1"] != F.col("g"))) & (100 * x["n1"] >= PERCENT * F.col("n")) & (PERCENT * x["n0"] <= 100 * F.col("n"))
    met = each.join(matrix, "h").select("c", "n", F.explode(F.filter("cells", open_)).alias("x")).select("c", "n", "x.band", "x.n0")
    told = met.groupBy("c", "n", "band").agg(F.count(F.lit(1)).alias("common"), F.min("n0").alias("n0"))
    least = F.greatest("n0", F.ceil(PERCENT * F.col("n") / 100 - 1e-9))
    return live.join(told.where(F.col("common") >= needed(F.col("n"), least)).select("c").distinct(), "c", "left_semi")


def opened_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of different groups to be verified: groups whose union shares enough first shingles with a set are opened for it."""
    spans = rows.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    union = rows.select("h", F.col("g").alias("other")).distinct()
    asks = rows.join(union, "h").where("g <> other").groupBy("c", "n", "other").agg(F.count(F.lit(1)).alias("shared")).join(spans.withColumnRenamed("g", "other"), "other")
    low, high = F.greatest("least", F.ceil(PERCENT * F.col("n") / 100 - 1e-9)), F.least("most", F.floor(100 * F.col("n") / PERCENT + 1e-9))
    bound = F.least(shared_at_least(F.col("n"), low), shared_at_least(F.col("n"), high)) - 2
    opened = written(asks.where((low <= high) & (F.col("shared") >= bound)).select("c", "other"))
    asking = rows.join(opened, "c").select("h", "c", "n", "other")
    inside = rows.select("h", F.col("c").alias("b"), F.col("n").alias("nb"), F.col("g").alias("other"))
    met = asking.join(inside, ["h", "other"]).where(close(F.col("n"), F.col("nb")) & (F.col("c") < F.col("b"))).groupBy(F.col("c").alias("a"), "b", "n", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return met.where(F.col("shared") >= shared_at_least(F.col("n"), F.col("nb"))).select("a", "b")


def groups_of(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """Component labels (c, g) of the classes that may link."""
    parts = written(shared_parts(written(class_sets(docs, linkable(docs, measured)), SETS)), SETS)
    live = parts.withColumn("g", F.col("c"))
    asked = written(compared(ask_leaders(live, least_shingles() + commonest_shingles()), live))
    groups = merge_groups(live.select("c", "g"), asked.where(at_least(PERCENT)).select("a", "b"))
    # a set belongs to the crowd of the leader that it is nearest to, linked or not
    nearest = asked.where(at_least(NEAR)).groupBy(F.col("a").alias("c")).agg(F.max_by("b", F.struct(F.col("common") / (F.col("na") + F.col("nb") - F.col("common")), "b")).alias("b"))
    crowd = nearest.join(groups.select(F.col("c").alias("b"), F.col("g").alias("y")), "b").select("c", "y")
    live = written(live.drop("g").join(groups, "c").join(crowd, "c", "left").withColumn("y", F.coalesce("y", "g")), SETS)
    live = written(qualifying(live.join(meeting(firsts(live)).select("c").distinct(), "c", "left_semi")), SETS)
    seen = deviations(live)
    groups = merge_groups(groups, core_links(seen))
    links = deviant_links(seen.drop("g").join(groups, "c"))
    # pairs of one crowd are done; what is left are sets of different crowds
    pairs = opened_pairs(written(meeting(firsts(live.withColumn("g", F.col("y"))))))
    return merge_groups(groups, written(links.unionByName(compared(pairs, live).where(at_least(PERCENT)).select("a", "b"))))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with the same set), component_id (smallest doc_id reachable by links).

    Null and empty texts have no shingles and are linked with nothing: their own id. Equal rows get equal results. A
    null doc_id keeps its row; as the smallest id of a component it gives way to the others. Further columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    measured = cut_lineage(measure(docs))
    rows = measured.where("n >= 0")
    groups = groups_of(docs, measured)
    classes = rows.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("class_id"))
    named = classes.join(groups, "c", "left").withColumn("g", F.coalesce("g", "c"))
    lowest = named.groupBy("g").agg(F.min("class_id").alias("component_id"))
    known = named.join(lowest, "g").select("c", "class_id", "component_id")
    out = rows.join(known, (rows["c"] == known["c"]) & (rows["n"] > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
