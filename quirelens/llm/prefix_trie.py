"""Prefix trie of conversations by the Euler-tour technique.

Every distinct sequence of first turns is a node. Each node has an enter and an exit arc; the arcs form one list, the tour.
The list is ranked over the cluster (:func:`list_rank`), and what holds for a subtree is a difference of two prefix sums
over the arcs in tour order.

Defined results: a null role or text is empty; a null turn comes first; rows of one conversation with equal turns are ordered
by a hash of role and text; rows without conv_id belong to no conversation. Repeated rows are turns of their own. An
empty table gives no rows. Other columns are ignored. No turn's text is shuffled: turns travel as hashes of 3 x 40 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage

#: Turns that conversations of one family may share at most: h is a remainder by this number (part of the contract).
SHARED = 9
FAMILY = 5
#: Hashes of a turn: three of 40 bits; their running sums (no overflow below 8 million turns) name a prefix.
HASH_BITS, N_HASHES = 40, 3
KEY = ["d", "k0", "k1", "k2"]
UP = ["pd", "q0", "q1", "q2"]
#: The list of arcs is contracted until this many are left; those are ranked in one task.
BASE_ARCS = 10_000
#: Arcs of one local bucket, about; arcs between two sums of the tour's prefix sums.
BUCKET_ARCS, SUM_ARCS = 50_000, 8_192
#: Conversation ids whose text is joined before hashing: those that share conv_id div this number.
ID_CHUNK = 4_096


def ranged(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``df`` written in range partitions by group and order, with its partition number ``pid``; a large group spans several."""
    return cut_lineage(df.repartitionByRange(*group, *order, F.monotonically_increasing_id()).withColumn("pid", F.spark_partition_id()))


def running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums (this row included) in each group by ``order``; a group may be larger than a task.

    Sums within (partition, group) are windows; what earlier partitions hold of the same group is one row per partition.
    """
    own = ranged(df, group, order)
    totals = own.groupBy("pid", *group).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    before = Window.partitionBy(*group).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pid", *group, *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums))
    here = Window.partitionBy("pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = own.select("*", *(F.sum(c).over(here).alias(n) for n, c in sums.items())).join(offsets, ["pid", *group])
    return rows.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def turn_rows(chats: DataFrame) -> DataFrame:
    """(conv, pos, h1, h2, size): the turns of each conversation in order, pos from 1; size is the text's UTF-8 bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = chats.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), F.xxhash64(role, F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text, F.lit(3), role).alias("h2"), F.octet_length(text).cast("long").alias("size")
    )
    return running(slim, ["conv"], [F.col("at").asc_nulls_first(), F.col("h1"), F.col("h2")], {"pos": F.lit(1)}).select("conv", "pos", "h1", "h2", "size")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv), (conv, d, h1, h2, size)): every conversation, and its turns behind the first turns of its family's first one."""
    convs = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = cut_lineage(convs.select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % FAMILY).alias("base")))
    bases = convs.select(F.col("conv").alias("base"), F.col("own").alias("base_turns"))
    plan = convs.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("m"))
    # at most SHARED - 1 turns of every fifth conversation go to the few conversations of their family
    head = turns.where((F.col("pos") < SHARED) & (F.col("conv") % FAMILY == 0)).withColumnRenamed("conv", "base")
    shared = plan.join(head, "base").where("pos <= m").select("conv", F.col("pos").alias("d"), "h1", "h2", "size")
    own = turns.join(plan, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("m")).alias("d"), "h1", "h2", "size")
    return plan.select("conv"), shared.unionByName(own)


def trie_nodes(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): nodes (KEY, UP, conv_id, n_convs, size, pid, nid) in range partitions by parent; ends (conv, KEY)."""
    cut = (1 << HASH_BITS) - 1
    parts = {f"g{k}": F.xxhash64(F.lit(k), "d", "h1", "h2").bitwiseAND(cut) for k in range(N_HASHES)}
    keyed = running(turns.select("conv", "d", "size", *(c.alias(n) for n, c in parts.items())), ["conv"], [F.col("d")], {f"k{k}": F.col(f"g{k}") for k in range(N_HASHES)})
    keyed = cut_lineage(keyed)
    up = [(F.col("d") - 1).alias("pd"), *((F.col(f"k{k}") - F.col(f"g{k}")).alias(f"q{k}") for k in range(N_HASHES))]
    inner = keyed.select("conv", "size", *KEY, *up).groupBy(*KEY).agg(*(F.min(c).alias(c) for c in UP), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("size").alias("size"))
    none = F.lit(None).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*(F.lit(0).cast("long").alias(c) for c in KEY), *(none.alias(c) for c in UP), "conv_id", "n_convs", F.lit(0).cast("long").alias("size"))
    nodes = inner.unionByName(root).withColumn("d", F.col("d").cast("long")).withColumn("pd", F.col("pd").cast("long"))
    placed = nodes.repartitionByRange(*UP, *KEY).withColumn("pid", F.spark_partition_id()).withColumn("nid", F.monotonically_increasing_id())
    last = keyed.groupBy("conv").agg(F.max(F.struct("d", "k0", "k1", "k2")).alias("e"))
    ends = convs.join(last, "conv", "left").select("conv", *(F.coalesce(F.col(f"e.{c}"), F.lit(0)).cast("long").alias(c) for c in KEY))
    return cut_lineage(placed), ends


def tour_arcs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, arcs): facts of each node (nid, conv_id, depth, parent_conv_id, n_children, ...) and arcs (arc, prev, next, w, bucket).

    Arc 2 * nid enters a node, 2 * nid + 1 leaves it; children follow in the order of nid. A parent with many children
    is met through (partition, parent), of which there is at most one row per partition: no group is larger than a partition.
    """
    spans = nodes.where("pd IS NOT NULL").groupBy("pid", *UP).agg(F.min("nid").alias("lo"), F.max("nid").alias("hi"), F.count(F.lit(1)).alias("n"))
    spans = cut_lineage(spans)
    families = spans.groupBy(*UP).agg(F.min("lo").alias("first_child"), F.max("hi").alias("last_child"), F.sum("n").alias("n_children"))
    as_parent = families.select(*(F.col(u).alias(k) for u, k in zip(UP, KEY, strict=True)), "first_child", "last_child", "n_children")
    full = cut_lineage(nodes.join(as_parent, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    by_pid = Window.partitionBy(*UP).orderBy("pid")
    parents = full.select(*(F.col(k).alias(u) for u, k in zip(UP, KEY, strict=True)), F.col("nid").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    spans = spans.select("pid", *UP, F.lag("hi").over(by_pid).alias("left_of"), F.lead("lo").over(by_pid).alias("right_of")).join(parents, UP)
    here = Window.partitionBy("pid", *UP).orderBy("nid")
    placed = full.withColumn("elder", F.lag("nid").over(here)).withColumn("younger", F.lead("nid").over(here)).join(spans, ["pid", *UP], "left")
    elder, younger = F.coalesce("elder", "left_of"), F.coalesce("younger", "right_of")
    nid = F.col("nid")
    enter, leave = nid * 2, nid * 2 + 1
    placed = placed.select("*", F.coalesce(elder * 2 + 1, F.col("parent") * 2).alias("enter_prev"), F.coalesce(F.col("first_child") * 2, leave).alias("enter_next"), F.coalesce(F.col("last_child") * 2 + 1, enter).alias("leave_prev"), F.coalesce(younger * 2, F.col("parent") * 2 + 1).alias("leave_next"))
    leaf = F.col("n_children") == 0
    saving = (F.col("n_convs") - 1) * F.col("size")
    facts = cut_lineage(placed.select("nid", *KEY, "conv_id", "n_convs", "n_children", "parent_conv_id", leaf.cast("long").alias("leaf"), saving.alias("saving"), "enter_prev", "enter_next", "leave_prev", "leave_next"))
    # the tour stays within a conversation's own nodes most of the time, so these share a bucket
    family = F.xxhash64(F.expr(f"conv_id div {FAMILY}"), F.expr(f"d div {BUCKET_ARCS}"))
    pair = F.array(F.struct(enter.alias("arc"), F.col("enter_prev").alias("prev"), F.col("enter_next").alias("next")), F.struct(leave.alias("arc"), F.col("leave_prev").alias("prev"), F.col("leave_next").alias("next")))
    return facts, facts.select(family.alias("bucket"), F.explode(pair).alias("a")).select("a.*", F.lit(1).cast("long").alias("w"), "bucket")


# ---------------------------------------------------------------- list ranking


def local_chains(frame: pd.DataFrame) -> pd.DataFrame:
    """Stretches of the list inside one bucket: (arc, prev, next, w) of the first arc, (arc, head, off) of the others."""
    frame = frame.sort_values("arc", ignore_index=True)
    arc = frame["arc"].to_numpy(np.int64)
    prev, nxt = frame["prev"].fillna(-1).to_numpy(np.int64), frame["next"].fillna(-1).to_numpy(np.int64)
    n = len(arc)
    at = np.clip(np.searchsorted(arc, prev), 0, n - 1)
    back = np.where(arc[at] == prev, at, np.arange(n))  # the arc before, or itself at the head of a stretch
    off = np.where(back == np.arange(n), 0, frame["w"].to_numpy(np.int64)[back])
    while True:
        far = back[back]
        if (far == back).all():
            break
        off, back = off + off[back], far
    is_head = back == np.arange(n)
    order = np.lexsort((off, back))
    tail = order[np.append(np.flatnonzero(np.diff(back[order])), n - 1)]  # the last arc of each stretch
    end, weight = np.full(n, -1), np.zeros(n, np.int64)
    end[back[tail]] = nxt[tail]
    weight[back[tail]] = off[tail] + frame["w"].to_numpy(np.int64)[tail]

    def nullable(values: np.ndarray, known: np.ndarray) -> pd.api.extensions.ExtensionArray:
        return pd.arrays.IntegerArray(values.astype(np.int64), ~known)

    return pd.DataFrame({"arc": arc, "prev": nullable(prev, is_head & (prev >= 0)), "next": nullable(end, is_head & (end >= 0)), "w": weight, "head": nullable(arc[back], ~is_head), "off": off})


CHAIN = "arc long, prev long, next long, w long, head long, off long"


def spliced(live: DataFrame, round_no: int) -> tuple[DataFrame, DataFrame]:
    """One round of contraction: (remaining, removed (arc, head, off)). An arc goes where its coin shows 1 and its predecessor's 0."""

    def coin(c: str) -> Column:
        return F.xxhash64(c, F.lit(round_no)).bitwiseAND(1)

    goes = F.col("prev").isNotNull() & (coin("arc") == 1) & (coin("prev") == 0)
    marked = live.withColumn("goes", goes)
    out = marked.where("goes")
    stay = marked.where("NOT goes").drop("goes")
    after = out.select(F.col("arc").alias("next"), F.col("next").alias("then"), F.col("w").alias("more"), F.lit(True).alias("hit"))
    stay = stay.join(after, "next", "left").select("arc", "prev", F.when(F.col("hit"), F.col("then")).otherwise(F.col("next")).alias("next"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"))
    before = out.select(F.col("arc").alias("prev"), F.col("prev").alias("earlier"))
    stay = stay.join(before, "prev", "left").select("arc", F.coalesce("earlier", "prev").alias("prev"), "next", "w")
    # a removed arc stands behind its predecessor's weight
    weights = live.select(F.col("arc").alias("prev"), F.col("w").alias("off"))
    return stay, out.join(weights, "prev").select("arc", F.col("prev").alias("head"), "off")


def list_rank(arcs: DataFrame) -> DataFrame:
    """(arc, pos): the place of each arc, from 0, in the list given by (arc, prev, next, w, bucket).

    First the stretches inside each bucket become one element each; then random independent sets are spliced out, round by
    round, until a bounded rest is ranked in one task. What was taken out gets its place back from its head, last round first.
    """
    buckets = max(1, -(-arcs.count() // BUCKET_ARCS))
    local = arcs.withColumn("bucket", F.pmod("bucket", F.lit(buckets))).groupBy("bucket").applyInPandas(lambda f: local_chains(f), CHAIN)
    local = cut_lineage(local)
    removed = [local.where("head IS NOT NULL").select("arc", "head", "off")]
    live = local.where("head IS NULL").select("arc", "prev", "next", "w")
    heads = removed[0].select(F.col("arc").alias("prev"), "head")
    live = cut_lineage(live.join(heads, "prev", "left").select("arc", F.coalesce("head", "prev").alias("prev"), "next", "w"))
    while live.count() > BASE_ARCS:
        stay, out = spliced(live, len(removed))
        removed.append(cut_lineage(out))
        live = cut_lineage(stay)
    rest = live.select("*", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda f: local_chains(f.drop(columns="one")), CHAIN)
    pos = cut_lineage(rest.select("arc", F.col("off").alias("pos")))
    for gone in reversed(removed):
        back = gone.join(pos.withColumnRenamed("arc", "head"), "head").select("arc", (F.col("pos") + F.col("off")).alias("pos"))
        pos = cut_lineage(pos.unionByName(back))
    return pos


def tour_sums(arcs: DataFrame, columns: list[str]) -> DataFrame:
    """Prefix sums of ``columns`` over the tour (pos from 0 without gaps): sums of blocks of SUM_ARCS places, then within each block."""
    blocked = arcs.withColumn("block", F.expr(f"pos div {SUM_ARCS}"))
    totals = blocked.groupBy("block").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per SUM_ARCS arcs
    offsets = totals.select("block", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    here = Window.partitionBy("block").orderBy("pos")
    return blocked.select("*", *(F.sum(c).over(here).alias(f"upto_{c}") for c in columns)).join(offsets, "block").select("arc", *columns, *((F.col(f"upto_{c}") + F.col(f"_{c}")).alias(f"upto_{c}") for c in columns))


def id_digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256): digest of the ascending ids of the conversations that end at a node, comma-joined.

    A digest needs its input in order. Ids are joined in chunks first (conv_id div ID_CHUNK: bounded groups), and the chunks
    of a node are streamed through the digest, a batch at a time.
    """
    chunks = ends.groupBy(*KEY, F.expr(f"conv div {ID_CHUNK}").alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*KEY, "ids"]), strict=True):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield rows(done)
        if now is not None:
            yield rows([(*now, digest.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in done], pa.string() if c == "ends_sha256" else pa.int64()) for k, c in enumerate([*KEY, "ends_sha256"])})

    return ordered.mapInArrow(stream, ", ".join([*(f"{c} long" for c in KEY), "ends_sha256 string"]))


def build(chats: DataFrame) -> DataFrame:
    """The trie of all conversations (conv_id, turn, role, text), one row per node:

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves (childless nodes of the
    subtree, itself included), saved_tokens (bytes that shared turns of the subtree save), ends_sha256.
    """
    turns = cut_lineage(turn_rows(chats))
    convs, turns = rebuilt(turns)
    nodes, ends = trie_nodes(convs, turns)
    facts, arcs = tour_arcs(nodes)
    pos = list_rank(arcs)
    # what a node adds to its subtree is counted where it is entered
    measures = facts.select(F.explode(F.array(F.struct((F.col("nid") * 2).alias("arc"), "leaf", "saving"), F.struct((F.col("nid") * 2 + 1).alias("arc"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saving")))).alias("m")).select("m.*")
    sums = tour_sums(measures.join(pos, "arc"), ["leaf", "saving"])
    enters = F.col("arc") % 2 == 0
    whole = sums.groupBy(F.expr("arc div 2").alias("nid")).agg(
        *(F.sum(F.when(enters, F.col(c) - F.col(f"upto_{c}")).otherwise(F.col(f"upto_{c}"))).alias(n) for c, n in (("leaf", "n_leaves"), ("saving", "saved_tokens")))
    )
    nothing = sha256(b"").hexdigest()
    named = facts.join(whole, "nid").join(id_digests(ends), KEY, "left")
    return named.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
