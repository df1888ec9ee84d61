"""Registered queries of readers, writers and table tools: driver tables go out in the engine's file forms and come back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.operators import columns, curation, vectors
from quirelens.plans.catalog import NUMERIC, ORACLE_SQL, SCORED, query, scored
from quirelens.runtime import shared_folder, table
from quirelens.sources import tables as files
from quirelens.streaming import incremental


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def page_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, net, vector, label: three vectors a document, of every third document one net is missing."""
    e = table(spark, sf_dir, "embeddings")
    net = F.element_at(F.array(*map(F.lit, ("res", "xce", "inc"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(F.expr("vec_id div 12").alias("doc_id"), F.expr("vec_id div 3 % 4").alias("page_no"), net.alias("net"), F.col("embedding").cast("array<double>").alias("vector"), "label")


VECTORS = "(SELECT vec_id // 12 AS doc_id, vec_id // 3 % 4 AS page_no, ['res', 'xce', 'inc'][vec_id % 3 + 1] AS net, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings)"


@query("csv_metadata", "SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.source AS file_name, d.lang AS folder_name, CAST(d.n_chars AS INTEGER) AS number_participants FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0")
def csv_metadata(spark, sf_dir):
    """Metadata out as CSV with a header, and in again for the documents that are asked for."""
    path = place(spark, "metadata")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("file_name"), F.col("lang").alias("folder_name"), F.col("n_chars").alias("number_participants")).write.csv(path, header=True)
    ids = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").cast("string").alias("doc_id"))
    return files.metadata(spark, path, ids).select("doc_id", "file_name", "folder_name", "number_participants")


@query("csv_labels", "SELECT CAST(quality AS DOUBLE) AS label, CAST(doc_id AS VARCHAR) AS doc_id FROM labels")
def csv_labels(spark, sf_dir):
    path = place(spark, "labels")
    table(spark, sf_dir, "labels").select(F.col("quality").cast("double"), "doc_id").write.csv(path)
    return files.labels(spark, path)


@query("csv_classification", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN toxic = 1 THEN 0.0 ELSE 1.0 END AS label FROM labels WHERE quality = 1")
def csv_classification(spark, sf_dir):
    """Flags True and False become labels, rows with another flag go."""
    path = place(spark, "published")
    flag = F.when(F.col("quality") == 0, "unknown").when(F.col("toxic") == 1, "False").otherwise("True")
    table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), flag.alias("published")).write.csv(path, header=True, sep=";")
    return files.classification(spark, path)


@query("id_row", "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM labels WHERE toxic = 1")
def id_row(spark, sf_dir):
    """Processed ids in their form of one line with commas, a line for each language's documents."""
    path = place(spark, "ids")
    rows = table(spark, sf_dir, "labels").where("toxic = 1").groupBy((F.col("doc_id") % 64).alias("part")).agg(F.array_join(F.collect_list(F.col("doc_id").cast("string")), ", ").alias("value"))
    rows.select("value").write.text(path)
    return files.processed_ids(spark, path)


@query("json_results", f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, probability, CASE WHEN probability >= 0.5 THEN 'C' ELSE 'NC' END AS prediction FROM {SCORED}")
def json_results(spark, sf_dir):
    from quirelens.operators import report

    path = place(spark, "results")
    files.write_results(scored(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "probability", report.decide(F.col("probability")).alias("prediction")), path)
    return files.results(spark, path).select("doc_id", "probability", "prediction")


@query("statistics_file", ORACLE_SQL["feature_statistics"])
def statistics_file(spark, sf_dir):
    """Scaling statistics written, read and checked against the feature list."""
    path = place(spark, "statistics")
    files.write_statistics(vectors.statistics(table(spark, sf_dir, "lineitem"), NUMERIC), path, NUMERIC)
    return files.read_statistics(spark, path, NUMERIC).withColumn("mean", F.round("mean", 6))


@query("scale_by_file", ORACLE_SQL["scale_minmax"])
def scale_by_file(spark, sf_dir):
    """Training writes the statistics, prediction reads them; without them it stops."""
    path = place(spark, "statistics")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMERIC)
    vectors.normalise(spark, rows, NUMERIC, path, train=True)
    out = vectors.normalise(spark, rows, NUMERIC, path, train=False)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in NUMERIC))


@query("vector_store", f"""SELECT doc_id, page_no, round(list_sum(a.vector) + list_sum(b.vector) + list_sum(c.vector), 6) AS total, len(a.vector) + len(b.vector) + len(c.vector) AS size
  FROM {VECTORS} a JOIN {VECTORS} b USING (doc_id, page_no) JOIN {VECTORS} c USING (doc_id, page_no) WHERE a.net = 'res' AND b.net = 'xce' AND c.net = 'inc' AND doc_id % 3 = 1""")
def vector_store(spark, sf_dir):
    """Vectors appended by network, loaded for chosen documents, the networks of a page joined."""
    path = place(spark, "vectors")
    files.append_vectors(page_vectors(spark, sf_dir).drop("label"), path)
    ids = page_vectors(spark, sf_dir).where("doc_id % 3 = 1").select("doc_id").distinct()
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return files.load_vectors(spark, path, ids).select("doc_id", "page_no", F.round(total, 6).alias("total"), F.size("vector").cast("long").alias("size"))


IMAGES = f"(SELECT DISTINCT doc_id, page_no, doc_id || '_' || page_no || '.jpg' AS image FROM {VECTORS})"


@query("image_index", f"SELECT doc_id, count(*) AS n_pages, min(image) AS first_image FROM {IMAGES} GROUP BY doc_id")
def image_index(spark, sf_dir):
    """The page image index, appended in two parts and read; pages per document counted from it."""
    path = place(spark, "images")
    index = page_vectors(spark, sf_dir).select("doc_id", "page_no").distinct().withColumn("image", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("page_no").cast("string"), F.lit(".jpg")))
    files.write_images(index.where("doc_id % 2 = 0"), path, append=False)
    files.write_images(index.where("doc_id % 2 = 1"), path)
    return columns.pages_of(spark.read.parquet(path))


@query("pages_of_documents", f"SELECT l.doc_id, v.page_no, row_number() OVER (PARTITION BY l.doc_id ORDER BY v.page_no) AS place FROM labels l JOIN {IMAGES} v ON l.doc_id = v.doc_id")
def pages_of_documents(spark, sf_dir):
    """Page rows of the wanted documents, numbered in page order."""
    index = page_vectors(spark, sf_dir).select("doc_id", "page_no").distinct()
    return columns.page_rows(table(spark, sf_dir, "labels").select("doc_id"), index)


@query("split_pages", f"""SELECT v.doc_id, v.page_no, CASE WHEN r <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM {IMAGES} v
  JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM {IMAGES})) s ON s.doc_id = v.doc_id""")
def split_pages(spark, sf_dir):
    """Pages follow their document's side of the split."""
    index = page_vectors(spark, sf_dir).select("doc_id", "page_no").distinct()
    return columns.split_pages(index, curation.split(index.select("doc_id").distinct())).select("doc_id", "page_no", "part")


@query("column_subset", "SELECT doc_id, source AS file_name FROM documents")
def column_subset(spark, sf_dir):
    return columns.subset(table(spark, sf_dir, "documents").withColumnRenamed("source", "file_name"), ["doc_id", "file_name"])


@query("detach_feature", "SELECT n_chars, CAST(l.quality AS VARCHAR) AS class, d.doc_id AS name FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def detach_feature(spark, sf_dir):
    """One feature with class and name, from a feature file of several."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", F.length("source").alias("other"), F.col("quality").cast("string").alias("class"), F.col("doc_id").alias("name"))
    return columns.detach(rows, "n_chars")


@query("substitute_feature", "SELECT d.doc_id AS name, coalesce(l.quality, d.n_chars) AS n_chars, d.source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def substitute_feature(spark, sf_dir):
    """A column replaced by that of another file; rows that the other lacks keep theirs."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), "n_chars", "source")
    other = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"), F.col("quality").cast("long").alias("n_chars"))
    return columns.substitute(rows, other, "n_chars")


@query("custom_report", f"""SELECT r.doc_id, r.probability, r.pages, o.o_orderstatus AS folder_name FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY probability DESC) AS n
  FROM (SELECT doc_id, probability, pages FROM {SCORED} UNION ALL SELECT doc_id, probability / 2 AS probability, pages FROM {SCORED} WHERE doc_id % 2 = 0)) WHERE n = 1) r JOIN orders o ON o.o_orderkey = r.doc_id""")
def custom_report(spark, sf_dir):
    """Results of two files, page counts and metadata joined; of several results the newest file's counts."""
    docs = scored(spark, sf_dir)
    results = docs.select("doc_id", "probability", F.lit(2).alias("file")).unionByName(docs.where("doc_id % 2 = 0").select("doc_id", (F.col("probability") / 2).alias("probability"), F.lit(1).alias("file")))
    meta = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("folder_name"))
    return columns.report_rows(results, docs.select("doc_id", "pages"), meta, "file").select("doc_id", "probability", "pages", "folder_name")


@query("batch_concatenation", "SELECT doc_id, source, row_number() OVER (ORDER BY doc_id % 4, doc_id) AS place FROM documents")
def batch_concatenation(spark, sf_dir):
    """Four batches' outputs behind each other, in order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return columns.concatenated([docs.where(F.col("doc_id") % 4 == k) for k in range(4)], "doc_id").select("doc_id", "source", "place")


@query("small_corpus_fallback", """WITH t AS (SELECT * FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) WHERE term <> '')
  SELECT item_id AS doc_id, term, count(*) AS k FROM t WHERE term IN (SELECT term FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 100) GROUP BY item_id, term""")
def small_corpus_fallback(spark, sf_dir):
    """A batch too small to give a vocabulary takes the stored one."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "").alias("terms"))
    path = place(spark, "vocabulary")
    columns.stored_vocabulary(rows, path, least=1)
    none = columns.stored_vocabulary(rows.limit(0), path, least=1)
    return rows.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(none), "term").groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("k"))


@query("stream_skip_processed", """SELECT event_type, count(*) AS n_docs FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0) GROUP BY event_type""")
def stream_skip_processed(spark, sf_dir):
    """A resumed run: rows whose ids are processed already are not scored again."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    folder = place(spark, "resumed")
    done = table(spark, sf_dir, "events").where("event_id % 3 = 0").select("event_id")
    incremental.score_new(source, lambda b: b.select("event_id", "event_type"), f"{folder}/results", f"{folder}/checkpoint", "event_id", done)
    return incremental.read_results(spark, f"{folder}/results", "event_id").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_docs"))


@query("feature_store", """WITH f AS (SELECT doc_id, text, source, n_chars FROM documents),
  a AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN text END AS text, CASE WHEN doc_id % 11 <> 0 THEN source END AS source, n_chars, 2 AS g FROM f WHERE doc_id % 3 <> 0),
  b AS (SELECT doc_id, text, source, -n_chars AS n_chars, 3 AS g FROM f WHERE doc_id % 5 = 0),
  l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY g DESC) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
  SELECT f.doc_id, l.doc_id IS NOT NULL AS saved, l.source, l.n_chars, length(l.text) AS text_length FROM f LEFT JOIN l ON l.doc_id = f.doc_id AND r = 1 AND l.text IS NOT NULL AND l.source IS NOT NULL AND l.n_chars IS NOT NULL""")
def feature_store(spark, sf_dir):
    """Documents saved in generations: one that is hidden, one with gaps, one that updates; complete rows, and what is still to be extracted."""
    from quirelens.sources import feature_store as store

    folder = f"{shared_folder(spark)}/features-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    store.save(docs.withColumn("source", F.lit("old")), folder)
    gaps = docs.where("doc_id % 3 <> 0").withColumns({"text": F.expr("CASE WHEN doc_id % 7 <> 0 THEN text END"), "source": F.expr("CASE WHEN doc_id % 11 <> 0 THEN source END")})
    store.save(gaps, folder, anew=True)
    store.save(docs.where("doc_id % 5 = 0").withColumn("n_chars", -F.col("n_chars")), folder)
    complete, todo = store.load_or_repair(docs.select("doc_id"), folder, ["source", "n_chars"])
    kept = complete.select("doc_id", F.lit(True).alias("saved"), "source", "n_chars", F.char_length("text").alias("text_length"))
    return kept.unionByName(todo.select("doc_id", F.lit(False).alias("saved")), allowMissingColumns=True)
