"""Every stage against brute force on its own input, and the whole run."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from quirelens.llm import mixing, quality
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_pii import brute as base_spans


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, f) in enumerate(cp.STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_columns_and_names(stages):
    assert [s[0] for s in stages] == ["quality rules", "n-gram Jaccard join", "personal data", "mixing sources", "BPE encoding and decoding"]
    assert all(sorted(s[3]) == sorted(cp.COLUMNS) for s in stages[:-1])


def test_quality(stages, spark):
    _, before, after, _ = stages[0]
    kept = {r.doc_id: r.text for r in after}
    for r in before:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        if len(words) < quality.MIN_WORDS:
            assert r.doc_id not in kept
        elif r.doc_id in kept:
            assert set(kept[r.doc_id].split("\n")) <= set(r.text.split("\n"))
    assert 0 < len(after) < len(before)


def test_near_duplicates(stages):
    _, before, after, _ = stages[1]
    group = components({r.doc_id: r.text for r in before})
    assert {r.doc_id for r in after} == {g for _, g in group.values()} and len(after) == len({g for _, g in group.values()})
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_personal_data(stages):
    _, before, after, _ = stages[2]
    text = {r.doc_id: r.text for r in after}
    assert len(after) == len(before)
    for r in before:
        found = base_spans(r.text)
        assert (text[r.doc_id] == r.text) or "[" in text[r.doc_id]
        for _, a, b in found:
            assert r.text[a:b] not in text[r.doc_id]


def test_mixing(stages):
    _, before, after, _ = stages[3]
    have = Counter(r.doc_id for r in after)
    words = lambda t: len(re.findall(mixing.WORD, t or ""))
    assert max(have.values()) <= 2 and set(have) <= {r.doc_id for r in before}
    total = sum(words(r.text) for r in before)
    assert abs(sum(words(r.text) for r in after) - mixing.SHARE * total) <= 0.1 * total


def test_tokens(stages):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(cp.tokenizer_path())
    _, before, after, _ = stages[4]
    assert len(after) == len(before)
    ids = {r.doc_id: (r.ids, r.decoded, r.n_tokens) for r in after}
    for r in before[:60]:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        packed, decoded, n = ids[r.doc_id]
        assert [int.from_bytes(packed[k : k + 4], "little") for k in range(0, len(packed), 4)] == want and n == len(want)
        assert decoded == tok.decode(want, skip_special_tokens=False)


def test_run(stages, spark, sf_dir):
    assert cp.run(spark, sf_dir).count() == len(stages[-1][2])


def test_edges(spark, sf_dir):
    docs = spark.createDataFrame([(None, None, None, None, None), (None, "w " * 60, "en", None, 1), (5, "", "en", "a", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("extra", F.lit(1))
    out = [stage(spark, docs, sf_dir).collect() for _, stage in cp.STAGES]
    assert all(stage(spark, docs.limit(0), sf_dir).count() == 0 for _, stage in cp.STAGES)
    texts = sorted([None, "", "w " * 60], key=str)
    assert out[0] == []  # too few words, or one word all along
    assert sorted((r.text for r in out[1]), key=str) == sorted((r.text for r in out[2]), key=str) == texts
    assert {r.text for r in out[3]} == {"w " * 60} and len(out[3]) in (1, 2)  # 150 % of all words are 90
    assert sorted(r.n_tokens for r in out[4])[:2] == [0, 0] and len(out[4]) == 3


def test_shared_and_missing_ids(spark, sf_dir):
    say = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    a, b, c, d, e, f = map(say, range(6))
    # 1: one id, two texts; 2, 3: texts of one id, one a copy of id 2's; without an id: copies of each other, and of id 1's
    rows = [(1, a), (1, b), (2, c), (3, c + " end"), (3, d), (None, e), (None, e + " end"), (None, e), (None, a + " end"), (None, f), (4, d), (None, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)] * 2, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    want = {(1, a), (1, b), (2, c), (3, d), (None, f), (None, ""), (5, None)}
    for n in (1, 5):
        after = [(r.doc_id, r.text, r.source) for r in cp.near_duplicates(spark, docs.repartition(n), sf_dir).collect()]
        got = {(i, t) for i, t, _ in after}
        assert len(after) == len(got) == len(want) + 1
        assert want <= got and len(got & {(None, e), (None, e + " end")}) == 1
        assert {s for i, t, s in after if (i, t) == (1, a)} == {"s0"} and {s for _, t, s in after if t == e} <= {"s5"}
