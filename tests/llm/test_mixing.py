import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirelens.llm import mixing
from quirelens.runtime import table


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    left, open_, goal = mixing.SHARE * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * each > 2 * sizes[s]}
        if not full:
            return goal | {s: weight[s] * each for s in open_}
        for s in full:
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]
        open_ -= full
    return goal


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_targets_and_closeness(spark, sf):
    docs = table(spark, f"/root/testdata/{sf}", "documents").withColumn("source", F.when(F.col("source") != "src3", F.col("source")))
    if sf == "sf0.1":  # one hot source with most rows, over several levels of the tree
        docs = docs.withColumn("source", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0, F.lit("src16")).otherwise(F.col("source")))
    rows = mixing.digest(docs).collect()
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.size == len(re.findall(mixing.WORD, text[r.doc_id] or ""))
        assert r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    goal = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= largest[s] / 2 + 1
    assert Counter((r.doc_id, r.taken) for r in mixing.digest(docs.repartition(5)).collect()) == Counter((r.doc_id, r.taken) for r in rows)


def test_mix_and_edges(spark):
    rows = [(k, f"w {'x ' * (k % 7)}", "a" if k % 3 else "b", k) for k in range(300)] + [(7000, None, None, 0), (7001, "", "z", 0), (7002, "one two", None, 5), (7003, "w " * 100_000, "a", 1)] + [(8000, "same words", "c", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int").withColumn("taken", F.lit(1))
    got = mixing.digest(docs).collect()
    assert len(got) == len(rows) and {r.taken for r in got if r.doc_id in (7000, 7001)} == {0}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    have = Counter(r.doc_id for r in mixed.collect())
    want = Counter()
    for r in mixing.copies(docs).collect():
        want[r.doc_id] += r.copies
    assert +have == +want
    assert mixing.digest(docs.limit(0)).count() == 0


def test_expectation_is_kept(spark):
    """The share of runs in which a document is taken is near its rate."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "a") for k in range(60)] + [(1000 + k, "w " * 30, "b") for k in range(60)], "doc_id bigint, text string, source string")
    hits, rate = Counter(), {}
    for seed in range(8):
        moved = docs.withColumn("doc_id", F.col("doc_id") + 100_000 * seed)
        for r in mixing.digest(moved).collect():
            hits[r.source] += r.taken / r.size
            rate[r.source] = r.target / r.source_size
    for s, x in rate.items():
        assert hits[s] / 480 == pytest.approx(x, abs=0.12)


def test_many_equal_rows_are_one_unit(spark):
    """Equal rows share their copies evenly, none above twice, and the source meets its target."""
    rows = [(1, "four words are here", "a")] * 3001 + [(None, "no id at all", "a")] * 7 + [(k, "x " * (k % 9 + 1), "a") for k in range(2, 60)] + [(k, "y y", "b") for k in range(60, 400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.digest(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    mine = [r for r in got if r.doc_id == 1]
    assert max(r.copies for r in mine) - min(r.copies for r in mine) <= 1 and max(r.copies for r in got) <= 2
    for source in "ab":
        of = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 6
    assert Counter((r.doc_id, r.taken) for r in mixing.digest(docs.repartition(9)).collect()) == Counter((r.doc_id, r.taken) for r in got)
    mixed = Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert mixed[1] == sum(r.copies for r in mine)
