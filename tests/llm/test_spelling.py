import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirelens.llm import spelling
from quirelens.runtime import table


def brute(rows):
    """Near words by every single deletion, replacement found through all gaps and checked letter by letter."""
    counts = Counter()
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    gaps = defaultdict(set)
    for w in n:
        gaps[w].add(w)
        for k in range(len(w)):
            gaps[w[:k] + w[k + 1 :]].add(w)
    near = defaultdict(set)
    for group in gaps.values():
        for a in group:
            near[a] |= {b for b in group if a != b and edits(a, b) == 1}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def edits(a, b):
    """1 if exactly one code point is inserted, deleted or replaced, else 2."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True))
    a, b = sorted((a, b), key=len)
    return 1 if len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b))) else 2


def found(df):
    return sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("rare", [256, 4, 0])
def test_whole_table(spark, sf_dir, rare, monkeypatch):
    """Lists of any length give the same rows: most pairs through grams, few, none."""
    monkeypatch.setattr(spelling, "RARE", rare)
    docs = table(spark, sf_dir, "documents")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert any(r[1] for r in want) and found(docs) == want


def test_edges(spark):
    """Long words, repeated letters, Latin-1 letters, null texts and ids, repeated rows, clashing column names."""
    deep = "ab" * 2000
    words = ["aaaaaa", "aaaaa", "aaaab", "aaaba", "éclair", "eclair", "éclairs", deep, deep + "c", deep[:50] + "x" + deep[50:], "Straße", "strasse", "abcd", "xbcdefghijklm", "abcdefghijklm", "abcdefghijkl", "abcdefhgijklm"]
    rows = [(k, " ".join([w] * (3 + k))) for k, w in enumerate(words)] + [(None, None), (None, "eclair eclair"), (5, ""), (7, "x" * 10), (7, "x" * 10), (7, "x" * 10)]
    rows.append((99, "éclair, " * 40 + "y" * 5 + " yyyyy yyyyy yyyyyz yyyyyz yyyyyz " + "Ābcdef " * 3))
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, word string, n int")
    want = brute(rows)
    assert found(df) == want and len(want) > 10
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.where(F.col("text").isNull())).count() == 0


def test_share_of_words_with_bound(spark, sf_dir):
    """The grams carry the search where words are many: at the small scale, most words have a head and a tail side by side."""
    counted = spelling.word_counts(table(spark, sf_dir, "documents"))
    words = counted.select(F.monotonically_increasing_id().alias("wid"), "w", F.char_length("w").alias("len"), "n")
    shares = spelling.decomposed(words).agg(F.avg(F.col("head").isNotNull().cast("int")), F.avg((F.col("len") > 5).cast("int"))).first()
    assert shares[0] > 0.8 * shares[1]


def test_words_need_two_grams(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), min_length=3)
