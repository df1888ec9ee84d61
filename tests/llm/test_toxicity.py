import itertools

import numpy as np

from quirelens.llm import toxicity
from quirelens.runtime import table


def test_marginals_against_enumeration():
    rng = np.random.default_rng(1)
    emit, trans = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    mask = np.arange(5)[None, :] < np.array([5, 3, 1])[:, None]
    p, expected, logz = toxicity.marginals(emit, mask, trans)
    pairs = np.zeros((2, 2))
    for c, n in enumerate((5, 3, 1)):
        total, on = 0.0, np.zeros(n)
        here = np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(emit[c, t] * ys[t] for t in range(n)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            total += w
            on += w * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                here[a, b] += w
        pairs += here / total
        assert np.allclose(p[c, :n], on / total) and np.isclose(logz[c], np.log(total))
    assert np.allclose(expected, pairs)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = toxicity.digest(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted", "score").toPandas()
    hit = ((got.toxic == 1) & (got.predicted == 1)).sum()
    assert hit >= 0.9 * (got.toxic == 1).sum() and hit >= 0.9 * got.predicted.sum()


def test_edges(spark):
    rows = [(k, f"plain words number {k} here idiot." if k % 2 else f"plain words number {k} here kind.", k) for k in range(200)]
    docs = spark.createDataFrame([*rows, (900, None, 1), (901, "", 1), (902, "You IDIOT!", 1), (902, "You IDIOT!", 1), (None, "x " * 40_000, None)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([*((k, k % 2, None) for k in range(200)), (None, 1, "z"), (5000, None, "z")], "doc_id bigint, toxic int, text string")
    got = toxicity.digest(docs, labels).collect()
    assert len(got) == 205 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[900].predicted == by[901].predicted == by[None].predicted == 0
    model = toxicity.fit(docs, labels)
    spans = [r for r in toxicity.score(docs, model).where("doc_id = 902").collect()]
    assert "You IDIOT!"[spans[0].toxic_spans[0].start : spans[0].toxic_spans[0].end] == "IDIOT!"
    none = toxicity.digest(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and toxicity.digest(docs.limit(0), labels).count() == 0
