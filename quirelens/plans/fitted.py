"""Registered queries of fitted models: nearest neighbours over whole tables, cross-fitting, stacks, page models."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.operators import knn, models
from quirelens.plans.catalog import query
from quirelens.runtime import table


def labelled_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 2).alias("label"))


@query("knn_index", """WITH t AS (SELECT vec_id, embedding::DOUBLE[] AS v, label % 2 AS label FROM embeddings),
  d AS (SELECT q.vec_id AS doc_id, t.vec_id AS t, t.label, list_distance(q.v, t.v) AS d FROM t q JOIN t ON q.vec_id <> t.vec_id),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, t) AS r FROM d) WHERE r <= 5)
  SELECT doc_id, round(sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w), 4) AS p1 FROM (SELECT *, CASE WHEN min(d) OVER (PARTITION BY doc_id) = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END AS w FROM n) GROUP BY 1""")
def knn_index(spark, sf_dir):
    """Every vector judged by its five nearest others, through the bucket index."""
    vec = labelled_vectors(spark, sf_dir)
    index = knn.build(vec.withColumnRenamed("vec_id", "t"))
    near = knn.search(index, vec.withColumnRenamed("vec_id", "q"), skip_self=True)
    return knn.vote(near).select(F.col("q").alias("doc_id"), F.round("p1", 4).alias("p1"))


@query("cross_fit_rates", """WITH r AS (SELECT d.doc_id, d.source, l.quality, CAST('0x' || substr(md5('42|' || d.doc_id), 1, 8) AS BIGINT) % 5 AS fold FROM documents d JOIN labels l USING (doc_id)),
  own AS (SELECT source, fold, count(*) AS n, sum(quality) AS s FROM r GROUP BY 1, 2), every AS (SELECT source, sum(n) AS n, sum(s) AS s FROM own GROUP BY 1),
  f AS (SELECT fold, count(*) AS n, sum(quality) AS s FROM r GROUP BY 1), total AS (SELECT count(*) AS n, sum(quality) AS s FROM r)
  SELECT r.doc_id, round(CASE WHEN every.n > own.n THEN (every.s - own.s) / (every.n - own.n) ELSE (total.s - f.s) / (total.n - f.n) END, 6) AS p
  FROM r JOIN own ON own.source IS NOT DISTINCT FROM r.source AND own.fold = r.fold JOIN every ON every.source IS NOT DISTINCT FROM r.source JOIN f ON f.fold = r.fold, total""")
def cross_fit_rates(spark, sf_dir):
    """Share of good documents by source, for each document from those of the other folds; unseen sources take the share of all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")

    def fit(rows):
        return rows.groupBy("source").agg(F.avg("quality").alias("own")), rows.agg(F.avg("quality").alias("of_all"))

    def score(fitted, rows):
        own, of_all = fitted
        known = own.withColumnRenamed("source", "known")
        joined = rows.join(known, rows["source"].eqNullSafe(known["known"]), "left").crossJoin(F.broadcast(of_all))  # one row
        return joined.select("doc_id", F.round(F.coalesce("own", "of_all"), 6).alias("p"))

    return models.cross_fitted(docs, fit, score, folds=5)


@query("page_model")
def page_model(spark, sf_dir):
    """Scores of all vectors by a unit that knows half of the labels and goes on with its own scores of the others."""
    from quirelens.operators import page_model as unit

    vec = labelled_vectors(spark, sf_dir).withColumnRenamed("vec_id", "page_id")
    trained = unit.pseudo_labelled(vec.where("page_id % 2 = 0"), vec.where("page_id % 2 = 1"), 64)
    return trained.score(vec).select("page_id", F.round("score", 6).alias("score"))
