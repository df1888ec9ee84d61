import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quirelens.llm import jaccard_join as jj
from quirelens.runtime import table


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows.items()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    near = {p for ids in index.values() for p in itertools.combinations(sorted(ids), 2)}
    for a, b in near:
        i = len(sets[a] & sets[b])
        if 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in rows}


def compare(docs):
    want = brute({r.doc_id: r.text for r in docs.select("doc_id", "text").collect()})
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(docs).collect()}
    assert got.keys() == want.keys()
    assert [(i, got[i], want[i]) for i in want if got[i] != want[i]] == []


def test_given_data(spark):
    compare(table(spark, "/root/testdata/sf0.01", "documents").withColumn("n", F.lit("clash")))


@pytest.mark.parametrize("small", [24, 2])
def test_crowds(spark, small, monkeypatch):
    monkeypatch.setattr(jj, "FREQUENT", small)
    monkeypatch.setattr(jj, "FLUSH_COUNT", 2)
    rng = random.Random(small)
    line = [f"line{k}" for k in range(14)]
    rows, i = [], 0
    for crowd in range(3):
        base = [f"w{crowd}x{k}" for k in range(60)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(60)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join((line if rng.random() < 0.5 else []) + words)))
            i += 1
    for _ in range(60):  # the common line and little else
        rows.append((i, " ".join(line + [f"r{rng.randrange(10**6)}" for _ in range(rng.randint(0, 4))])))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, "A b"), (i + 3, "a B"), (i + 4, "z " * 30_000)]
    rng.shuffle(rows)
    compare(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5))


def test_edges(spark):
    docs = spark.createDataFrame([(None, "one two three four five six"), (4, "one two three four five six"), (4, "one two three four five six"), (None, None)], "doc_id bigint, text string")
    got = sorted((r.n_shingles, r.component_id) for r in jj.join(docs).collect() if r.n_shingles)
    assert got == [(2, 4)] * 3
    assert jj.join(docs.limit(0)).count() == 0
