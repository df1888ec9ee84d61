import pytest

from quirelens.sources import feature_store as store


def test_generations(spark, tmp_path):
    folder = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, "doc_id string, text string, x double")
    batch = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    complete, todo = store.load_or_repair(batch, folder, ["x"])
    assert complete.count() == 0 and todo.count() == 4
    with pytest.raises(ValueError):
        store.load(spark, folder)
    assert store.save(make([("a", "one", 1.0), ("b", "two", 2.0), (None, "lost", 3.0), ("a", "one", 1.0)]), folder) == 1
    assert store.save(make([("b", "new", 5.0), ("c", None, 3.0), ("d", "four", None)]), folder) == 2
    assert store.save(make([("b", "newer", 6.0), ("c", None, 3.0), ("d", "four", None)]), folder, generation=2) == 2  # the same save again
    complete, todo = store.load_or_repair(batch, folder, ["x"])
    assert sorted(map(tuple, complete.select("doc_id", "text", "x").collect())) == [("a", "one", 1.0), ("b", "newer", 6.0)]
    assert sorted(r.doc_id for r in todo.collect()) == ["c", "d"]
    assert store.load_or_repair(batch, folder, ["x", "never"])[1].count() == 4
    assert "text" not in store.load(spark, folder, texts=False).columns
    before = sorted(map(tuple, store.load(spark, folder).select("doc_id", "text", "x").collect()), key=str)
    assert store.compact(spark, folder) == 3
    assert sorted(map(tuple, store.load(spark, folder).select("doc_id", "text", "x").collect()), key=str) == before
    store.save(make([("z", "z", 0.0)]), folder, anew=True)
    assert [r.doc_id for r in store.load(spark, folder).collect()] == ["z"]


def test_a_save_that_broke_off_is_not_seen(spark, tmp_path):
    folder = str(tmp_path / "store")
    df = spark.createDataFrame([("a", "t", 1.0)], "doc_id string, text string, x double")
    store.save(df, folder)
    df.drop("text").write.parquet(f"{folder}/rows/generation=2")
    assert store.load(spark, folder).count() == 1 and store.generations(spark, folder) == [(1, False)]
    assert store.save(df.withColumn("y", df.x + 1), folder) == 2 and store.load(spark, folder).first().y == 2.0
