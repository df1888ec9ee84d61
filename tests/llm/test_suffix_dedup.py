import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelens.llm import bytescan as bs
from quirelens.llm import suffix_dedup as sd
from quirelens.runtime import table

W = sd.WIDTH


def brute(rows):
    """rows: doc_id -> bytes."""
    seen, out = set(), {}
    for i in sorted(rows):
        text = rows[i]
        gone = bytearray(len(text))
        for s in range(len(text) - W + 1):
            w = text[s : s + W]
            if w in seen:
                gone[s : s + W] = b"\1" * W
            seen.add(w)
        kept = bytes(b for b, g in zip(text, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def compare(docs):
    rows = {r.doc_id: (r.text or "").encode() for r in docs.select("doc_id", "text").collect()}
    want = brute(rows)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.digest(docs).collect()}
    assert got.keys() == want.keys()
    assert [i for i in want if got[i] != want[i]] == []


def test_given_data(spark, sf_dir):
    compare(table(spark, sf_dir, "documents"))
    compare(table(spark, "/root/testdata/sf0.01", "documents").repartition(7))


@pytest.mark.parametrize("big", [2_000, 3])
def test_planted(spark, big, monkeypatch):
    monkeypatch.setattr(sd, "MAX_BUCKET", big)
    monkeypatch.setattr(sd, "STEP", 20_000)
    rng = random.Random(big)
    passage = "".join(rng.choice("abcdefgh é\n") for _ in range(400))
    rows = [(0, None), (1, ""), (2, "x" * 99), (3, "x" * 100), (4, "x" * 100), (5, "ab" * 300), (6, "z" * 5000)]
    for k in range(120):
        a, b = sorted(rng.sample(range(400), 2))
        noise = lambda: "".join(rng.choice("qrstuv") for _ in range(rng.randint(0, 90)))
        edit = passage[:a] + rng.choice("XYZ") + passage[a + 1 :] if k % 2 else passage[a:b]
        rows.append((10 + k, noise() + edit + noise() + passage[b : b + 120]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("d", F.lit("clash")).repartition(5)
    compare(docs)


def test_edges(spark):
    rows = [(None, "y" * 150), (3, "y" * 150), (3, "y" * 150), (4, "y" * 149 + "é")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in sd.digest(docs).collect())
    assert got == [(-1, 149), (3, 150), (3, 150), (4, 149)]
    assert sd.digest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("big", [2_000, 1])
def test_equal_rows_and_shared_ids(spark, big, monkeypatch):
    """Equal rows are one document; different texts of one id, or without an id, are several."""
    monkeypatch.setattr(sd, "MAX_BUCKET", big)
    monkeypatch.setattr(sd, "STEP", 20_000)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    a, b, c, d, e = (noise(300) for _ in range(5))
    passage = noise(400)
    parts = {20 + k: noise(30) + passage[rng.randint(0, 150) : rng.randint(260, 400)] + noise(30) for k in range(12)}
    rows = [(5, a), (None, b), (None, c), (-(1 << 63), b), (7, d), (7, e), (8, a + "!"), *parts.items()]
    docs = spark.createDataFrame(rows * 3, "doc_id bigint, text string")
    want = {i: brute({5: a.encode(), 8: (a + "!").encode(), **{k: t.encode() for k, t in parts.items()}})[i] for i in (5, 8, *parts)}
    alone = lambda t: (len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest())
    empty = hashlib.sha256(b"").hexdigest()
    expected = [(None, *alone(b)), (None, *alone(c)), (-(1 << 63), 300, 300, 1, empty), (7, *alone(d)), (7, *alone(e)), *((i, *w) for i, w in want.items())]
    for n in (1, 7):
        got = [tuple(r) for r in sd.digest(docs.repartition(n)).collect()]
        assert sorted(got, key=str) == sorted(expected * 3, key=str)


def test_refined_numbers():
    """Refined numbers and ranks are equal exactly where the windows are, periodic texts included."""
    rng = np.random.default_rng(3)
    word = rng.integers(97, 100, 130).astype(np.uint8)
    data = np.concatenate([word, rng.integers(97, 99, 40).astype(np.uint8), word[:110], np.full(260, 97, np.uint8), word[20:]])
    windows = [data[k : k + W].tobytes() for k in range(len(data) - W + 1)]
    first = [windows.index(w) for w in windows]
    prefix = bs.prefix_hash(data)
    sparse = sd.refined_at(prefix, np.arange(len(windows)))
    assert (sparse == sd.refined_all(data)).all()
    for numbers in (sparse, sd.refined_ranks(data)):
        kinds = {}
        assert [kinds.setdefault(int(x), k) for k, x in enumerate(numbers)] == first
    for short in (0, 1, 24, 25, 74, 99):
        assert len(sd.refined_all(data[:short])) == len(sd.refined_ranks(data[:short])) == 0
