"""Hand cases: geometry, images, reports, properties, XML, layout, curation, statistics, models, streams."""

import math

import pytest
from pyspark.sql import functions as F

from quirelens.functions import geometry as G
from quirelens.functions import text as T
from quirelens.operators import curation, layout, models, pages, report, vectors
from quirelens.sources import page_xml, properties, tables
from quirelens.streaming import incremental


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize(("b", "want"), [((5, 5, 15, 15), 25), ((10, 0, 20, 10), 0), ((20, 20, 30, 30), None)])
def test_overlap(spark, b, want):
    names = ["aleft", "atop", "aright", "abot", "bleft", "btop", "bright", "bbot"]
    df = spark.createDataFrame([(0, 0, 10, 10, *b)], names)
    back = spark.createDataFrame([(*b, 0, 0, 10, 10)], names)
    assert one(df.select(G.overlap("a", "b")))[0] == one(back.select(G.overlap("a", "b")))[0] == want


def test_images_of_a_page(spark):
    given = [(0, 0, 10, 10), (5, 5, 10, 10), (0, 0, 10, 10), (190, 90, 20, 20), (50, 30, -10, 10), (70, 70, 1, 1)]
    df = spark.createDataFrame([("d", 1, k, *x) for k, x in enumerate(given)], "doc_id string, page_no int, seq int, t int, l int, w int, h int")
    box = G.clip(F.col("l"), F.col("t"), F.col("w"), F.col("h"), F.lit(100), F.lit(200))
    got = one(pages.image_space(df.select("doc_id", "page_no", "seq", *(v.alias(k) for k, v in box.items()))))
    assert (got.images, got.space) == (4, 375)


def test_tiny_images_stop_a_page(spark):
    rows = [("d", 1, k, "image", 5, 5) for k in range(60)] + [("d", 2, k, "image", 50, 50) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id string, page_no int, elem_seq int, kind string, width int, height int")
    assert {r.page_no: r["count"] for r in pages.stop_after_tiny_images(df).groupBy("page_no").count().collect()} == {1: 50, 2: 60}


def test_columns(spark):
    df = spark.createDataFrame([("d", 1, 0, 40), ("d", 1, 50, 90), ("d", 1, 10, 95)], "doc_id string, page_no int, left int, right int")
    assert one(pages.columns_mode(df)).modal_columns == 2


def test_report_and_decision(spark):
    df = spark.createDataFrame([(str(k), p, 1, 2, "c") for k, p in enumerate((0.1, 0.2, 0.3, 0.5, 0.7, 0.9))], "doc_id string, probability double, pages int, participants int, course string")
    got = one(report.report(df))
    assert [got[f"docs_over_{k}"] for k in (20, 40, 50, 60, 80)] == [4, 3, 2, 2, 1] and got.docs_under_20 == 2 and got.exposure_over_80 == 2
    assert one(df.where("probability = 0.5").select(report.decide(F.col("probability"))))[0] == "C"
    assert one(report.report(df.limit(0))).docs_over_20 == 0


def test_scalars(spark):
    df = spark.createDataFrame([("see DOI: 10.1/x", "Acrobat Distiller 9.0 (Windows)", "The_Lecture 01 pdf and notes")], "a string, b string, c string")
    got = one(df.select(T.copyright_evidence(F.col("a")), T.clean_property(F.col("b")), T.clean_property(F.lit(None).cast("string")), T.clean_metadata(F.col("c"), ("and",)), T.copyright_evidence(F.lit("doing isbnx")), T.copyright_evidence(F.lit("doi 10"))))
    assert tuple(got) == (1, "acrobatdistillerwindows", "None", "The_Lecture notes", 0, 0)


def test_properties(spark):
    df = spark.createDataFrame([("a", "Creator: one\nPage size:      595.32 x 841.92 pts (A4)\nCreator: two: three\nFile size: 12 bytes"), ("b", None), ("c", "Title: x")], "doc_id string, txt string")
    got = {r.doc_id: r for r in properties.parse(df).collect()}
    assert (got["a"].page_size_x, got["a"].page_size_y, got["a"].creator, got["a"].file_size, got["a"].producer) == (595.32, 841.92, "two", 12.0, "empty")
    assert math.isnan(got["b"].file_size) and got["b"].creator == "passwordprotected" and got["c"].page_rot == -1


def test_page_xml(spark):
    good = b'<pdf2xml><outline><item page="1">One</item></outline><page width="100" height="50"><fontspec id="0" size="9" family="T" color="#0"/><text top="1" left="2" width="3" height="4" font="0">a <b>bo ld</b> tail <i>it</i></text>\x01<image top="1" left="1" width="2" height="2" src="x.png"/></page><page width="1" height="1"/></pdf2xml>'
    broken = b"<pdf2xml>\n<page width='1' height='1'>\n<text top='1'>x</b></text>\n</page>\n</pdf2xml>"
    rows = [("a", good), ("b", None), ("c", b"Syntax Error: no"), ("d", b"not xml"), ("e", broken), ("f", "<pdf2xml><page width='1' height='1'><text top='1' left='1' width='1' height='1' font='0'>\xe9</text></page></pdf2xml>".encode("latin-1"))]
    got = page_xml.read(spark.createDataFrame(rows, "doc_id string, xml binary")).collect()
    by = {i: [r for r in got if r.doc_id == i] for i in "abcdef"}
    assert [r.kind for r in by["a"]] == ["outline", "item", "page", "fontspec", "text", "image", "page"]
    run = by["a"][4]
    assert (run.text, run.bold_text, run.fmt, run.n_bold_words) == ("a  bo ld it", "bo ld", page_xml.MIXED, 2)
    assert [by[i][0].error_code for i in "bcd"] == ["pw_protected", "Syntax Error: no", "xml_error"]
    assert [r.kind for r in by["e"]] == ["page"] and by["f"][1].text == "é"


def lay_out(spark, runs):
    rows = [("d", 1, k, "text", *r[:4], 0, "w", 0) for k, r in enumerate(runs)]
    return layout.boxes(spark.createDataFrame(rows, "doc_id string, page_no int, elem_seq int, kind string, top int, left int, width int, height int, font int, text string, fmt int")).collect()


def test_block(spark):
    got = lay_out(spark, [(t, 50, 200, 10) for t in (100, 112, 124, 136)])
    assert [(r.kind, r.left, r.top, r.right, r.bot, r.n_lines) for r in got] == [("block", 50, 100, 250, 146, 4)]


def test_no_gap_and_indent(spark):
    assert [(r.kind, r.n_lines) for r in lay_out(spark, [(100, 50, 200, 10)])] == [("text", 1)]
    got = lay_out(spark, [(88, 65, 185, 10)] + [(t, 50, 200, 10) for t in (100, 112, 124)] + [(136, 50, 90, 10)])
    assert [(r.kind, r.top, r.bot, r.n_lines) for r in got] == [("block", 88, 146, 5)]


def test_statistics(spark):
    a = spark.createDataFrame([("f", 2, 1.0, 0.0, 2.0)], tables.STATISTICS)
    b = spark.createDataFrame([("f", 6, 5.0, 3.0, 9.0)], tables.STATISTICS)
    assert tuple(one(vectors.merge_statistics(a, b)))[1:] == (8, 4.0, 0.0, 9.0)
    df = spark.createDataFrame([(5.0, 7.0), (None, float("nan"))], "x double, y double")
    stats = spark.createDataFrame([("x", 2, 1.0, 0.0, 20.0), ("y", 2, 7.0, 7.0, 7.0)], tables.STATISTICS)
    assert [tuple(r) for r in vectors.scale(df, stats, ["x", "y"]).collect()] == [(0.25, 7.0), (0.0, 0.0)]
    assert [tuple(r) for r in vectors.scale(df, stats, ["x", "y"], "mean").collect()] == [(0.25, 7.0), (0.05, 7.0)]


def test_knn_vote(spark):
    train = spark.createDataFrame([(k, [float(d)], y) for k, (d, y) in enumerate([(1, 1), (2, 1), (4, 1), (2, 0), (4, 0), (9, 0)])], "vec_id bigint, vector array<double>, label int")
    ask = spark.createDataFrame([(0, [0.0]), (1, [9.0])], "doc_id bigint, vector array<double>")
    got = {r.doc_id: r.p1 for r in vectors.knn_vote(ask, train).collect()}
    assert got[0] == pytest.approx(0.7) and got[1] == 0.0


def test_page_scores(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    scores = spark.createDataFrame([("d1", 0.2), ("d1", 0.4)], "doc_id string, score double")
    assert {r.doc_id: round(r.probability, 6) for r in models.document_scores(docs, scores).collect()} == {"d1": 0.3, "d2": 0.0}


def test_curation(spark):
    docs = spark.range(103).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    parts = {r.part: r["count"] for r in curation.split(docs).groupBy("part").count().collect()}
    assert parts == {"train": 82, "test": 21}
    assert {r.label: r["count"] for r in curation.balanced(docs, "label").groupBy("label").count().collect()} == {0: 11, 1: 11}
    assert curation.balanced(docs, "label", n=3).count() == 6
    with pytest.raises(ValueError, match="label"):
        curation.with_labels(docs.select("doc_id"), docs.limit(5))
    whole = {w.weight for w in curation.class_weights(docs).collect()}
    assert whole == {103 / (2 * 11), 103 / (2 * 92)}


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"x")
    assert [r.doc_id for r in tables.document_files(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "meta.csv").write_text("document_id,file_name,folder_name\na,f,g\nz,f,g\n")
    assert [tuple(r) for r in tables.metadata(spark, str(tmp_path / "meta.csv"), spark.createDataFrame([("a",)], "doc_id string")).collect()] == [("a", "f", "g")]
    (tmp_path / "labels.csv").write_text("1.0,a\n0.0,b\n")
    assert tables.labels(spark, str(tmp_path / "labels.csv")).count() == 2
    (tmp_path / "done.csv").write_text("a, b,,a\n")
    assert sorted(r.doc_id for r in tables.processed_ids(spark, str(tmp_path / "done.csv")).collect()) == ["a", "b"]
    (tmp_path / "pub.csv").write_text("document_id;published\na;True\nb;False\nc;maybe\n")
    assert sorted(tuple(r) for r in tables.classification(spark, str(tmp_path / "pub.csv")).collect()) == [("a", 1.0), ("b", 0.0)]
    raw = spark.createDataFrame([("é".encode(),), ("é".encode("latin-1"),)], "raw binary")
    assert {r[0] for r in raw.select(tables.decoded(F.col("raw"))).collect()} == {"é"}


def test_stream_resumes(spark, tmp_path):
    inbox, seen = tmp_path / "in", []
    schema = "doc_id bigint, probability double"

    def score(batch):
        seen.append(batch.count())
        return batch.withColumn("prediction", report.decide(F.col("probability")))

    def run():
        source = spark.readStream.schema(schema).parquet(str(inbox))
        incremental.score_new(source, score, str(tmp_path / "out"), str(tmp_path / "check"))

    spark.range(5).selectExpr("id AS doc_id", "double(0.6) AS probability").write.mode("append").parquet(str(inbox))
    run()
    spark.range(5, 8).selectExpr("id AS doc_id", "double(0.1) AS probability").write.mode("append").parquet(str(inbox))
    run()
    run()
    assert seen == [5, 3]
    got = {r.doc_id: r.prediction for r in incremental.read_results(spark, str(tmp_path / "out")).collect()}
    assert got == {k: "C" if k < 5 else "NC" for k in range(8)}
    for number in range(2):
        incremental.merge_batch_statistics(spark, spark.range(number * 4, number * 4 + 4).selectExpr("double(id) AS x"), ["x"], str(tmp_path / "stats"), number)
    assert tuple(one(incremental.current_statistics(spark, str(tmp_path / "stats")))) == ("x", 8, 3.5, 0.0, 7.0)


def test_stop_words_are_sparks(spark):
    assert list(T.ALL_STOP_WORDS) == T.spark_stop_words(spark)
    df = spark.createDataFrame([("because nous cats about", "because nous cats")], "a string, b string")
    assert tuple(one(df.select(T.clean_text(F.col("a")), T.clean_metadata(F.col("b"))))) == ("cats", "cats")


def test_fields_are_cleaned_before_tokens(spark):
    df = spark.createDataFrame([(1, "Acrobat Distiller 5.0", None, "my because_file pdf ab", "cats because dogs")], "doc_id int, producer string, creator string, file_name string, text string")
    row = one(models.with_tokens(df, ("producer", "creator", "file_name", "text")))
    assert (row.producer_tokens, row.creator_tokens, row.file_name_tokens, row.text_tokens) == (["acrobatdistiller"], ["none"], ["because_file"], ["cats", "dogs"])
    vocab = vectors.vocabulary(df, max_df=1.0)
    assert {r.term for r in vocab.collect()} == {"cats", "dogs"}
    producers = vectors.vocabulary(df, "producer", max_df=1.0, clean=T.clean_property)
    assert [(r.term, r.weight) for r in vectors.term_frequencies(df, producers, "producer", clean=T.clean_property).collect()] == [("acrobatdistiller", 1.0)]


def test_cut_and_clean_leaves_the_setting(spark):
    from quirelens import runtime

    df = runtime.cut_and_clean(spark.range(100).repartition(3).groupBy((F.col("id") % 7).alias("g")).count())
    assert df.count() == 7 and df.groupBy("count").count().count() == 2 and spark.conf.get(runtime.CLEANUP, "false") == "false"


def test_stop_words_are_a_hash_set(spark):
    """The whole list costs one look-up a word; words are compared as written, an empty list keeps all."""
    from quirelens.functions import text as T

    df = spark.createDataFrame([("the cat The über été and dog pdf x_1",), (None,)], "v string")
    out = df.select(T.clean_text(F.col("v")).alias("t"), T.clean_metadata(F.col("v")).alias("m"), T.clean_text(F.col("v"), ()).alias("all"))
    assert [tuple(r) for r in out.collect()] == [("cat The dog pdf x_1", "cat The dog x_1", "the cat The über été and dog pdf x_1"), ("", "", "")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" INSET ") >= 2 and "array_contains" not in plan
