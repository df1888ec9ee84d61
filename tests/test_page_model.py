import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelens.operators import page_model as P


def pages(n=200, size=6, seed=3):
    rng = np.random.default_rng(seed)
    truth = rng.normal(size=size) * 2
    x = rng.normal(size=(n, size))
    return x, (x @ truth > 0).astype(float)


def steps(w, bias, batches, rate):
    """Plain gradient steps, written out for one unit."""
    for x, y in batches:
        error = np.array([1 / (1 + np.exp(-(sum(a * b for a, b in zip(row, w, strict=True)) + bias))) - t for row, t in zip(x, y, strict=True)])
        w, bias = w - rate * (x * error[:, None]).mean(axis=0), bias - rate * error.mean()
    return w, bias


def test_one_part_is_a_plain_sequence_of_steps(spark):
    x, y = pages(90)
    soft = np.linspace(0.1, 0.9, 30)
    rows = [(k, x[k].tolist(), float(y[k]) if k < 60 else float(soft[k - 60]), k < 60) for k in range(90)]
    df = spark.createDataFrame(rows, "page_id long, vector array<double>, target double, known boolean").repartition(5)
    stages = (P.Stage(0.3, 2), P.Stage(0.1, 2, mixed=True))
    unit = P.SigmoidUnit(6, drop=0.0).train(df, stages)
    w, bias = np.zeros(6), 0.0
    for number, stage in enumerate(stages):
        rng, per, batches, at = np.random.default_rng((7, number, 0)), 24 if stage.mixed else 4, [], 0
        for _ in range(stage.passes):
            order = rng.permutation(60)
            for first in range(0, 60, per):
                own = order[first : first + per]
                along = [60 + (at + j) % 30 for j in range(8)] if stage.mixed else []
                at += len(along)
                batches.append((np.concatenate([x[own], x[along]]) if along else x[own], np.concatenate([y[own], soft[[a - 60 for a in along]]]) if along else y[own]))
        w, bias = steps(w, bias, batches, stage.rate)
    assert unit.weights == pytest.approx([*w, bias])


def test_parts_are_averaged_by_their_pages(spark, monkeypatch):
    monkeypatch.setattr(P, "PART_PAGES", 64)
    x, y = pages(300)
    df = spark.createDataFrame([(k, x[k].tolist(), float(y[k]), True) for k in range(300)], "page_id long, vector array<double>, target double, known boolean")
    stage = P.Stage(0.3, 3)
    unit = P.SigmoidUnit(6).train(df, (stage,))
    part = {r.page_id: r.part for r in df.select("page_id", F.pmod(F.xxhash64("page_id"), F.lit(5)).alias("part")).collect()}
    want, none = np.zeros(7), np.zeros((0, 6))
    for p in range(5):
        own = [k for k in range(300) if part[k] == p]
        want += len(own) * P.walk(np.zeros(7), x[own], y[own], none, np.zeros(0), stage, 0.5, np.random.default_rng((7, 0, p)))
    assert unit.weights == pytest.approx(want / 300)


def test_learns_and_repeats(spark):
    x, y = pages(400)
    df = spark.createDataFrame([(k, x[k].tolist(), float(y[k])) for k in range(400)], "page_id long, vector array<double>, label double")
    run = lambda: P.pseudo_labelled(df.where("page_id < 100"), df.where("page_id >= 100"), 6, drop=0.1)  # six inputs bear little dropping
    unit = run()
    right = unit.score(df).join(df, "page_id").agg(F.avg(((F.col("score") >= 0.5).cast("double") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.9 and (run().weights == unit.weights).all()


def test_edges(spark):
    empty = spark.createDataFrame([], "page_id long, vector array<double>, label double")
    unit = P.pseudo_labelled(empty, empty, 3)
    pages_ = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1.0), (2, None, 1.0), (None, [0.0, 0.0, 0.0], None)], "page_id long, vector array<double>, label double")
    assert {r.page_id: r.score for r in unit.score(pages_).collect()} == {1: 0.5, None: 0.5}
    assert P.pseudo_labelled(pages_, pages_, 3).stages_done == 5
