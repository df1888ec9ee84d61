import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quirelens.llm import prefix_trie
from quirelens.runtime import table

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Rows (conv_id, turn, role, text) with distinct turns per conversation -> the trie's rows."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), (role or "", text or "")))
    turns = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        new = turns.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(new) + 1):
            members[tuple(new[:d])].append(c)
        ends[tuple(new)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) if children[node] else 1
        saved[node] = own + sum(saved[x] for x in children[node])
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha(ends[n])) for n, m in members.items()
    )


def built(df):
    return sorted(map(tuple, prefix_trie.build(df).select(*COLUMNS).collect()))


@pytest.mark.parametrize("small", [False, True])
def test_whole_table(spark, sf_dir, small, monkeypatch):
    """Small limits: many buckets, rounds of contraction, blocks and id chunks."""
    if small:
        for name, value in {"BASE_ARCS": 200, "BUCKET_ARCS": 60, "SUM_ARCS": 50, "ID_CHUNK": 7}.items():
            monkeypatch.setattr(prefix_trie, name, value)
    chats = table(spark, sf_dir, "conversations")
    rows = [tuple(r) for r in chats.select("conv_id", "turn", "role", "text").collect()]
    assert built(chats) == brute(rows)


def test_edges(spark):
    long = [(40, k, "user", f"t{k % 3}") for k in range(300)]
    rows = [(1, 0, None, None), (1, None, "user", "é"), (7, 3, "user", "x" * 50_000), (None, 0, "user", "lost"), (12, 1, "user", "only"), *long]
    # copies: every conversation of 100..160 says the same, so the ends of one node are many
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(3)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, pid int")
    assert built(df) == brute(rows)
    assert prefix_trie.build(df.limit(0)).count() == 0
    only_null = prefix_trie.build(df.where("conv_id IS NULL"))
    assert only_null.count() == 0


def test_equal_turns_and_repeats(spark):
    """Equal turn numbers are ordered by a hash, the same in every run; a repeated row is a turn of its own."""
    rows = [(5, 1, "user", "a"), (5, 1, "user", "b"), (5, 1, "user", "a"), (10, 1, "user", "a"), (10, 1, "user", "b"), (10, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = built(df)
    assert got == built(df.orderBy(F.desc("text"))) and max(r[1] for r in got) == 3
    assert [r for r in got if r[1] == 3] == [(5, 3, 5, 2, 0, 1, 2 * 0 + 1, hashlib.sha256(b"5,10").hexdigest())]


def test_running_sums_across_partitions(spark):
    """One group larger than any partition, ties and repeated rows included."""
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("g"), (F.col("id") % 500).alias("o"), F.lit(2).alias("v"))
    out = prefix_trie.running(df, ["g"], [F.col("o")], {"n": F.lit(1), "s": F.col("v")})
    got = defaultdict(list)
    for r in out.collect():
        got[r.g].append((r.n, r.o, r.s))
    for rows in got.values():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(1, len(rows) + 1)) and [o for _, o, _ in rows] == sorted(o for _, o, _ in rows) and all(s == 2 * n for n, _, s in rows)
