import hashlib
import json
import random

import numpy as np
import pytest

from quirelens.llm import bpe
from quirelens.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def both():
    return bpe.model_of(tokenizer_path()), tokenizers.Tokenizer.from_file(tokenizer_path())


def check(both, texts):
    ours, theirs = both
    for text, packed in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, "<u4").tolist() == ids, text
        assert ours.decode(packed) == theirs.decode(ids, skip_special_tokens=False)


def test_random_texts(both):
    rng = random.Random(5)
    letters = [*"abcdefghijklmnopqrstuvwxyz'é ßİΣςσ0123# ́ 日本.,!?Aÿ×÷ªµ", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", " ", "'re", "\n"]
    check(both, ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(4000)])


def test_long_and_repetitive(both):
    check(both, ["", " ", "a" * 3000, "hahaha" * 500, "in" * 31 + "th" * 40, "x" * 60 + " " + "y" * 61, "don't we'll I'D", "😀" * 50])


def test_speculation_fails_and_is_repaired(both):
    model, _ = both
    words = [t[:-4].encode() + b"ings" for t in list(model.usable)[:4000] if t.endswith("</w>") and t[:-4].isascii() and t[:-4].isalpha()]
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    end = np.cumsum([len(w) for w in words])
    owner, ids, stuck = model.speculate(data, end - [len(w) for w in words], end)
    merged = model.merge_all(data, end - [len(w) for w in words], end)
    greedy = [ids[owner == k].tolist() for k in range(len(words))]
    ok = [all(model.compatible(np.array(g[:-1]), np.array(g[1:]))) if len(g) > 1 else True for g in greedy]
    assert any(ok) and not all(ok) and not len(stuck)
    for k in range(len(words)):
        assert (greedy[k] == merged[k].tolist()) == ok[k]
        assert model.merge(model.base(words[k])) == merged[k].tolist() == model.merge_long(model.base(words[k]))


@pytest.mark.parametrize("part", ["normalizer", "added_tokens"])
def test_a_file_that_reads_words_otherwise(tmp_path, part):
    """Plain words take the short way only where the file reads them so."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert bpe.model_of(tokenizer_path()).simple
    if part == "normalizer":
        spec[part] = None
    else:
        spec[part][0] |= {"content": "cafe", "id": spec["model"]["vocab"]["cafe"]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    model = bpe.BpeModel(str(path))
    assert not model.simple
    theirs = tokenizers.Tokenizer.from_file(str(path))
    for text in ("some cafe, decafe!", "plain words here."):
        assert np.frombuffer(model.encode([text.encode()])[0], "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_table(spark, both):
    rows = [(1, "The café, isn't it?", "x", 3), (1, "The café, isn't it?", "x", 3), (None, None, None, None), (4, "", "y", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string, decoded int")
    out = bpe.encode(df, tokenizer_path())
    assert out.columns == ["doc_id", "text", "decoded", "ids"] and out.count() == 4
    got = bpe.digest(df, tokenizer_path()).orderBy("doc_id").collect()
    ids = both[1].encode(rows[0][1], add_special_tokens=False).ids
    assert [r.n_tokens for r in got] == [0, len(ids), len(ids), 0]
    assert got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digest(df.limit(0), tokenizer_path()).count() == 0
