import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from quirelens.llm import spotsigs
from quirelens.runtime import table

ANCHORS = set(spotsigs.ANCHORS)


def brute(text):
    words = re.findall(r"[^\W_]+", text.lower())
    chains = set()
    for k, w in enumerate(words):
        content = [x for x in words[k + 1 :] if x not in ANCHORS][: spotsigs.CHAIN]
        if w in ANCHORS and len(content) == spotsigs.CHAIN:
            chains.add(" ".join(content))
    return chains or set(words)


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("runs", [500, 7])
def test_against_brute_force(spark, sf_dir, runs, monkeypatch):
    monkeypatch.setattr(spotsigs, "RUN_ROWS", runs)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit("x").alias("sig"), F.lit(0).alias("run")).withColumn("doc_id", F.col("doc_id") * F.col("doc_id"))
    extra = spark.createDataFrame([(10**9, None, "", 1), (10**9 + 7, "", "", 1), (-5, "the a an", "", 2), (10**10, "the one two three " * 700, "", 3)], "doc_id bigint, text string, sig string, run int")
    docs = docs.unionByName(extra)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in spotsigs.digest(docs).collect()}
    assert got.keys() == texts.keys()
    for k, i in enumerate(ids):
        text, nxt = texts[i], texts[ids[(k + 1) % len(ids)]]
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert len(r.fingerprint) == 8 * len(brute(text))
        assert r.near_edited == pytest.approx(jaccard(brute(text), brute(edited))) and r.near_next == pytest.approx(jaccard(brute(text), brute(nxt)))
    assert spotsigs.digest(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "the x y z"), (3, "b"), (3, "b")], "doc_id bigint, text string")
    assert spotsigs.digest(odd).count() == 3


def test_near_pairs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = docs.where("doc_id < 20").select((F.col("doc_id") + 5000).alias("doc_id"), F.concat("text", F.lit(" the very last chain")).alias("text"))
    docs = docs.unionByName(near)
    members, pairs = spotsigs.near_pairs(docs)
    sets = {r.doc_id: brute(r.text) for r in docs.collect()}
    of = {r.doc_id: r["class"] for r in members.collect()}
    assert of.keys() == sets.keys()
    got = {(r.a, r.b) for r in pairs.collect()}
    for i, j in itertools.combinations(sorted(sets), 2):
        a, b = sorted((of[i], of[j]))
        assert (a == b) == (sets[i] == sets[j])
        if a != b:
            assert ((a, b) in got) == (jaccard(sets[i], sets[j]) >= 0.8), (i, j)
