"""All registered queries of the library's own operators, with the SQL that DuckDB gives the same rows for.

Driver tables stand for the engine's inputs: orders for scored documents, lineitem for page elements, documents and
labels for texts, pages for markup, part for properties, embeddings for page vectors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.functions import geometry as G
from quirelens.functions import text as T
from quirelens.operators import curation, pages, report, vectors
from quirelens.runtime import shared_folder, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- scored documents (orders)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, probability, pages, participants, course; pages = lines of the order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("pages"))
    o = table(spark, sf_dir, "orders")
    base = o.select(F.col("o_orderkey").alias("doc_id"), (F.round(F.col("o_totalprice") * 100).cast("bigint") % 1000 / 1000.0).alias("probability"), (F.col("o_custkey") % 50).alias("participants"), F.col("o_orderpriority").alias("course"))
    return base.join(lines, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.lit(1)).cast("long"))


SCORED = """(SELECT o_orderkey AS doc_id, CAST(round(o_totalprice * 100) AS BIGINT) % 1000 / 1000.0 AS probability, o_custkey % 50 AS participants,
  o_orderpriority AS course, coalesce(p.pages, 1) AS pages
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS pages FROM lineitem GROUP BY 1) p ON p.l_orderkey = o_orderkey)"""


def _buckets(weight: str, prefix: str) -> str:
    over = [f"CAST(coalesce(sum(CASE WHEN probability > {t} THEN {weight} END), 0) AS BIGINT) AS {prefix}_over_{int(t * 100)}" for t in report.OVER]
    return ", ".join([*over, f"CAST(coalesce(sum(CASE WHEN probability <= {report.UNDER} THEN {weight} END), 0) AS BIGINT) AS {prefix}_under_20"])


COUNTERS = f"count(*) AS n_docs, {_buckets('1', 'docs')}, {_buckets('pages', 'pages')}, {_buckets('pages * participants', 'exposure')}"


@query("report_exposure", f"SELECT {COUNTERS}, count(DISTINCT course) AS n_courses FROM {SCORED}")
def report_exposure(spark, sf_dir):
    return report.report(scored(spark, sf_dir))


@query("report_page_limit", f"SELECT {COUNTERS}, count(DISTINCT course) AS n_courses FROM {SCORED} WHERE pages <= 4")
def report_page_limit(spark, sf_dir):
    return report.report(scored(spark, sf_dir), page_limit=4)


@query("report_merge", f"SELECT {COUNTERS}, 4.5 AS seconds FROM {SCORED}")
def report_merge(spark, sf_dir):
    """Ten batch reports and their merge: the counters of the whole."""
    docs = scored(spark, sf_dir)
    own = [c for c in report.report(docs).columns if c != "n_courses"]
    batches = docs.groupBy((F.col("doc_id") % 10).alias("batch")).agg(F.count(F.lit(1)).alias("n_docs"), *report.buckets(F.lit(1), "docs"), *report.buckets(F.col("pages"), "pages"), *report.buckets(F.col("pages") * F.col("participants"), "exposure"))
    return report.merge(batches.withColumn("seconds", F.col("batch").cast("double")), timing="seconds").select(*own, "seconds")


@query("report_pairs", f"""SELECT metric, value FROM (UNPIVOT (SELECT CAST(docs_over_50 AS DOUBLE) AS docs_over_50, CAST(pages_over_50 AS DOUBLE) AS pages_over_50 FROM (SELECT {COUNTERS} FROM {SCORED})) ON docs_over_50, pages_over_50 INTO NAME metric VALUE value)""")
def report_pairs(spark, sf_dir):
    return report.as_pairs(report.report(scored(spark, sf_dir)).select("docs_over_50", "pages_over_50"))


@query("decision_threshold", f"SELECT doc_id, probability, CASE WHEN probability >= 0.5 THEN 'C' ELSE 'NC' END AS prediction, probability > 0.5 AS positive FROM {SCORED}")
def decision_threshold(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "probability", report.decide(F.col("probability")).alias("prediction"), (F.col("probability") > report.POSITIVE).alias("positive"))


@query("result_pairs", f"SELECT doc_id || '-x' AS doc_id, probability, CASE WHEN probability >= 0.5 THEN 'C' ELSE 'NC' END AS prediction FROM {SCORED}")
def result_pairs(spark, sf_dir):
    """Key-value export of results and back; ids hold dashes."""
    docs = scored(spark, sf_dir).select(F.concat(F.col("doc_id").cast("string"), F.lit("-x")).alias("doc_id"), "probability", report.decide(F.col("probability")).alias("prediction"))
    return report.read_pairs(report.result_pairs(docs))


# ---------------------------------------------------------------- curation (documents, labels)


@query("metadata_left_join", """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), ' ') AS folder_name, coalesce(l.toxic, 0) AS number_participants
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def metadata_left_join(spark, sf_dir):
    meta = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("folder_name"), F.col("toxic").alias("number_participants"))
    return curation.with_metadata(table(spark, sf_dir, "documents").select("doc_id"), meta)


@query("inline_metadata", "SELECT p_partkey AS doc_id, p_name AS file_name, p_brand AS folder_name FROM part")
def inline_metadata(spark, sf_dir):
    line = F.concat(F.lit("file_name="), F.col("p_name"), F.lit(",folder_name="), F.col("p_brand"))
    m = curation.parse_inline(line)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.element_at(m, "file_name").alias("file_name"), F.element_at(m, "folder_name").alias("folder_name"))


@query("resume_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic = 0)")
def resume_anti_join(spark, sf_dir):
    saved = table(spark, sf_dir, "labels").select("doc_id", "quality", F.when(F.col("toxic") == 0, F.lit("ok")).alias("text"))
    return curation.still_to_do(table(spark, sf_dir, "documents").select("doc_id"), saved, ["quality", "text"])


@query("label_completeness", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def label_completeness(spark, sf_dir):
    return curation.unlabelled(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


@query("labelled_rows", "SELECT l.doc_id, d.source, l.quality FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def labelled_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("doc_id", "source", "quality")


@query("unseen_by_path", """SELECT p.page_id, p.url AS path FROM pages p WHERE NOT EXISTS (
  SELECT 1 FROM labels l WHERE l.toxic = 1 AND contains(p.url, CAST(l.doc_id AS VARCHAR)))""")
def unseen_by_path(spark, sf_dir):
    images = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    saved = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("saved_id"))
    return curation.unseen_by_path(images, saved, "page_id").select("page_id", "path")


@query("processed_union", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0 UNION SELECT doc_id FROM documents WHERE lang = 'es'")
def processed_union(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.where("toxic = 1").select("doc_id").unionByName(labels.where("quality = 0").select("doc_id")).unionByName(table(spark, sf_dir, "documents").where("lang = 'es'").select("doc_id")).distinct()


@query("upsert_features", """SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' UNION ALL
  SELECT doc_id, upper(source) AS source, n_chars FROM documents WHERE lang <> 'en' OR lang IS NULL""")
def upsert_features(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    new = docs.where("lang <> 'en' OR lang IS NULL").withColumn("source", F.upper("source"))
    return curation.upsert(docs, new).select("doc_id", "source", "n_chars")


@query("feature_join_check", "SELECT d.doc_id FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def feature_join_check(spark, sf_dir):
    return curation.same_rows(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"))


MD5 = "md5('42|' || CAST(doc_id AS VARCHAR))"


@query("split_80_20", f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {MD5}) <= floor(0.8 * (SELECT count(*) FROM documents)) THEN 'train' ELSE 'test' END AS part FROM documents")
def split_80_20(spark, sf_dir):
    return curation.split(table(spark, sf_dir, "documents").select("doc_id"))


@query("balanced_subset", f"""SELECT doc_id, toxic FROM (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {MD5}) AS r FROM labels)
  WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def balanced_subset(spark, sf_dir):
    return curation.balanced(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic")


@query("sample_n", f"SELECT doc_id, source FROM documents ORDER BY {MD5}, doc_id LIMIT 100")
def sample_n(spark, sf_dir):
    return curation.sample(table(spark, sf_dir, "documents").select("doc_id", "source"), 100)


@query("review_sample", f"SELECT doc_id, probability FROM {SCORED} WHERE probability > 0.5 ORDER BY {MD5}, doc_id LIMIT 100")
def review_sample(spark, sf_dir):
    return curation.review(scored(spark, sf_dir).select("doc_id", "probability"))


@query("class_weights", "SELECT toxic AS label, n, total / (k * n) AS weight FROM (SELECT toxic, count(*) AS n FROM labels GROUP BY 1), (SELECT count(*) AS total, count(DISTINCT toxic) AS k FROM labels)")
def class_weights(spark, sf_dir):
    return curation.class_weights(table(spark, sf_dir, "labels").withColumnRenamed("toxic", "label"))


@query("accuracy", "SELECT avg(CASE WHEN (n_chars >= 1000) = (quality = 1) THEN 1.0 ELSE 0.0 END) AS accuracy FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def accuracy(spark, sf_dir):
    from quirelens.operators.models import accuracy as share

    both = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return share(both.select((F.col("n_chars") >= 1000).cast("int").alias("prediction"), F.col("quality").alias("label")))


# ---------------------------------------------------------------- texts

SQL_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


@query("word_line_stats", f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
  p AS (SELECT doc_id, CAST(floor(i / 40) AS INT) AS page_no, sum(CASE WHEN len({SQL_WORDS}) > 0 THEN 1 ELSE 0 END) AS lines, sum(len({SQL_WORDS})) AS words FROM l GROUP BY 1, 2)
  SELECT doc_id, count(*) AS count_pages, round(avg(words), 6) AS mean_words_pp, round(avg(lines), 6) AS mean_lines_pp, round(sum(words) / nullif(sum(lines), 0), 6) AS mean_words_per_line FROM p GROUP BY 1""")
def word_line_stats(spark, sf_dir):
    stats = pages.document_means(pages.page_text(table(spark, sf_dir, "documents")))
    return stats.select("doc_id", "count_pages", *(F.round(c, 6).alias(c) for c in ("mean_words_pp", "mean_lines_pp", "mean_words_per_line")))


@query("first_last_100_words", f"""SELECT doc_id, array_to_string(w[1:100], ' ') AS first_100_words, array_to_string(w[greatest(len(w) - 99, 1):], ' ') AS last_100_words FROM (SELECT doc_id, {SQL_WORDS} AS w FROM documents)""")
def first_last_100_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.first_words(F.col("text")).alias("first_100_words"), T.last_words(F.col("text")).alias("last_100_words"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


@query("text_clean", f"SELECT doc_id, array_to_string(list_filter({SQL_WORDS}, lambda w: NOT list_contains({STOP_SQL}, w)), ' ') AS clean FROM documents")
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text"), T.STOP_WORDS).alias("clean"))


@query("copyright_symbol", """SELECT page_id, CAST(regexp_matches(lower(t), '©|[^a-z]doi[^a-z]|[^a-z]isbn[^a-z]') AS INT) AS copyright_symbol
  FROM (SELECT page_id, regexp_replace(replace(html, '&copy;', '©'), '<[^>]*>', ' ', 'g') AS t FROM pages)
  UNION ALL SELECT -1 - doc_id, CAST(regexp_matches(lower(text), '©|[^a-z]doi[^a-z]|[^a-z]isbn[^a-z]') AS INT) FROM documents""")
def copyright_symbol(spark, sf_dir):
    stripped = F.regexp_replace(F.replace(F.col("html"), F.lit("&copy;"), F.lit("©")), "<[^>]*>", " ")
    web = table(spark, sf_dir, "pages").select("page_id", T.copyright_evidence(stripped).alias("copyright_symbol"))
    docs = table(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), T.copyright_evidence(F.col("text")).alias("copyright_symbol"))
    return web.unionByName(docs)


@query("property_clean", "SELECT p_partkey, coalesce(regexp_replace(lower(p_type), '[^a-z]', '', 'g'), 'None') AS creator, coalesce(regexp_replace(lower(p_brand), '[^a-z]', '', 'g'), 'None') AS producer FROM part")
def property_clean(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.clean_property(F.col("p_type")).alias("creator"), T.clean_property(F.col("p_brand")).alias("producer"))


@query("metadata_clean", f"""WITH s AS (SELECT page_id AS id, url AS v FROM pages UNION ALL SELECT -1 - p_partkey, p_name FROM part),
  w AS (SELECT id, list_filter(regexp_extract_all(coalesce(v, ''), '([\\p{{L}}\\p{{N}}_]{{3,}})', 1), lambda x: NOT list_contains({STOP_SQL}, x)) AS w FROM s)
  SELECT id, array_to_string(CASE WHEN list_position(w, 'pdf') > 0 THEN list_concat(w[:list_position(w, 'pdf') - 1], w[list_position(w, 'pdf') + 1:]) ELSE w END, ' ') AS clean FROM w""")
def metadata_clean(spark, sf_dir):
    values = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("v")).unionByName(table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("id"), F.col("p_name").alias("v")))
    return values.select("id", T.clean_metadata(F.col("v"), T.STOP_WORDS).alias("clean"))


@query("property_parse", "SELECT p_partkey AS doc_id, p_type AS creator, p_brand AS producer, CAST(p_size AS DOUBLE) AS page_size_x, p_size + 0.5 AS page_size_y, CAST(p_partkey * 10 AS DOUBLE) AS file_size, -1.0 AS page_rot FROM part")
def property_parse(spark, sf_dir):
    from quirelens.sources import properties

    text = F.concat(F.lit("Title: x\nCreator: "), F.col("p_type"), F.lit("\nProducer:   "), F.col("p_brand"), F.lit("\nPage size:  "), F.col("p_size").cast("string"), F.lit(" x "), (F.col("p_size") + 0.5).cast("string"), F.lit(" pts (A4)\nFile size: "), (F.col("p_partkey") * 10).cast("string"), F.lit(" bytes"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("txt"))
    return properties.parse(docs).select("doc_id", "creator", "producer", "page_size_x", "page_size_y", "file_size", "page_rot")


VOCAB = """(WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([\\p{L}\\p{N}_]{2,})', 1)) AS term FROM documents),
  e AS (SELECT doc_id, term, count(*) AS k FROM t GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents)
  SELECT term, CAST(sum(k) AS BIGINT) AS tf, count(*) AS df FROM e GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT n FROM n) AND count(*) <= 0.5 * (SELECT n FROM n) ORDER BY tf DESC, term LIMIT 100)"""


def as_is(column):
    """The SQL of the two queries below takes texts uncleaned."""
    return column


@query("vocabulary_top100", f"SELECT term, tf, df FROM {VOCAB}")
def vocabulary_top100(spark, sf_dir):
    return vectors.vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=as_is)


@query("tf_l2", f"""WITH v AS (SELECT term FROM {VOCAB}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1)) AS term FROM documents),
  c AS (SELECT doc_id, term, count(*) AS k FROM t WHERE term IN (SELECT term FROM v) GROUP BY 1, 2)
  SELECT doc_id, term, round(k / sqrt(sum(k * k) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""")
def tf_l2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return vectors.term_frequencies(docs, vectors.vocabulary(docs, clean=as_is), clean=as_is).withColumn("weight", F.round("weight", 6))


# ---------------------------------------------------------------- numeric features (lineitem)

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("feature_statistics", " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, round(avg({c}), 6) AS mean, min({c}) AS min, max({c}) AS max FROM lineitem" for c in NUMERIC))
def feature_statistics(spark, sf_dir):
    return vectors.statistics(table(spark, sf_dir, "lineitem"), NUMERIC).withColumn("mean", F.round("mean", 6))


# a mean of prices may be a tie at six digits, which the last bit of a sum decides; at nine digits none is
@query("stats_merge", ORACLE_SQL["feature_statistics"].replace(", 6)", ", 9)"))
def stats_merge(spark, sf_dir):
    """Statistics of two batches merged: those of all rows."""
    rows = table(spark, sf_dir, "lineitem")
    return vectors.merge_statistics(vectors.statistics(rows.where("l_orderkey % 2 = 0"), NUMERIC), vectors.statistics(rows.where("l_orderkey % 2 = 1"), NUMERIC)).withColumn("mean", F.round("mean", 9))


@query("scale_minmax", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - (SELECT min({c}) FROM lineitem)) / ((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)), 6) AS {c}" for c in NUMERIC) + " FROM lineitem")
def scale_minmax(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *NUMERIC)
    out = vectors.scale(rows, vectors.statistics(rows, NUMERIC), NUMERIC)
    return out.select("l_orderkey", "l_linenumber", *(F.round(c, 6).alias(c) for c in NUMERIC))


# ---------------------------------------------------------------- page elements (lineitem as rectangles and runs)


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id = order, one page each; rectangles clipped to a page of 600 x 600."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_no"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("seq"), (F.col("l_partkey") % 500).cast("int").alias("x"), (F.col("l_suppkey") * 37 % 500).cast("int").alias("y"), (F.col("l_quantity") * 4).cast("int").alias("w"), (F.col("l_linenumber") * 20).cast("int").alias("h"))
    box = G.clip(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(600), F.lit(600))
    return lines.select("doc_id", "page_no", "seq", *(v.alias(k) for k, v in box.items()))


RECTS = """(SELECT l_orderkey AS doc_id, 1 AS page_no, CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey AS seq, CAST(l_partkey % 500 AS INT) AS "left", CAST(l_suppkey * 37 % 500 AS INT) AS top,
  least(CAST(l_partkey % 500 + l_quantity * 4 AS INT), 600) AS "right", least(CAST(l_suppkey * 37 % 500 + l_linenumber * 20 AS INT), 600) AS bot FROM lineitem)"""
DISTINCT = f"""(SELECT doc_id, page_no, "left", top, "right", bot, min(seq) AS seq FROM {RECTS} WHERE ("right" - "left") * (bot - top) > 1 GROUP BY ALL)"""
OVERLAPS = f"""(SELECT a.doc_id, a.page_no, CAST(coalesce(sum(CASE WHEN dx >= 0 AND dy >= 0 THEN dx * dy END), 0) AS BIGINT) AS overlap FROM
  (SELECT a.doc_id, a.page_no, least(a."right", b."right") - greatest(a."left", b."left") AS dx, least(a.bot, b.bot) - greatest(a.top, b.top) AS dy
   FROM {DISTINCT} a JOIN {DISTINCT} b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.seq > b.seq) a GROUP BY 1, 2)"""


@query("rect_overlap", f"SELECT doc_id, page_no, overlap FROM {OVERLAPS}")
def rect_overlap(spark, sf_dir):
    return pages.earlier_overlaps(pages.distinct_rects(rects(spark, sf_dir)))


@query("image_space", f"""SELECT r.doc_id, r.page_no, r.images, CAST(r.area - coalesce(o.overlap, 0) AS BIGINT) AS space FROM
  (SELECT doc_id, page_no, count(*) AS images, sum(("right" - "left") * (bot - top)) AS area FROM {DISTINCT} GROUP BY 1, 2) r LEFT JOIN {OVERLAPS} o ON r.doc_id = o.doc_id AND r.page_no = o.page_no""")
def image_space(spark, sf_dir):
    return pages.image_space(rects(spark, sf_dir))


def _mode(value: str, out: str) -> str:
    return f"""(SELECT doc_id, arg_max({value}, (k, -first)) AS {out}, round(max(k) / sum(k), 6) AS share_{out} FROM (SELECT doc_id, {value}, count(*) AS k, min(seq) AS first FROM r GROUP BY ALL) GROUP BY 1)"""


@query("margin_modes", f"""WITH r AS (SELECT z.doc_id // 8 AS doc_id, z.seq + z.doc_id * 10000000000 AS seq, "left" // 50 AS lft, "right" // 50 AS rgt FROM {RECTS} z),
  e AS (SELECT doc_id, max(rgt) AS max_right, max(lft) AS max_left, min(lft) AS min_left FROM r GROUP BY 1)
  SELECT e.doc_id, modal_left, share_modal_left, modal_right, share_modal_right, max_right, max_left, min_left FROM e JOIN {_mode('lft', 'modal_left')} a ON a.doc_id = e.doc_id JOIN {_mode('rgt', 'modal_right')} b ON b.doc_id = e.doc_id""")
def margin_modes(spark, sf_dir):
    runs = rects(spark, sf_dir).select(F.expr("doc_id div 8").alias("doc_id"), (F.col("seq") + F.col("doc_id") * 10_000_000_000).alias("seq"), F.expr("left div 50").alias("left"), F.expr("right div 50").alias("right"))
    out = pages.margins(runs)
    return out.select("doc_id", "modal_left", F.round("share_modal_left", 6).alias("share_modal_left"), "modal_right", F.round("share_modal_right", 6).alias("share_modal_right"), "max_right", "max_left", "min_left")


@query("font_counts", "SELECT l_orderkey AS doc_id, count(*) AS count_fonts, count(DISTINCT l_returnflag) AS count_font_colors, count(DISTINCT l_linestatus) AS count_font_families, max(l_quantity - 2) AS max_font_size, min(CASE WHEN l_quantity - 2 > 0 THEN l_quantity - 2 END) AS min_font_size FROM lineitem GROUP BY 1")
def font_counts(spark, sf_dir):
    return pages.fonts(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_returnflag").alias("color"), F.col("l_linestatus").alias("family"), (F.col("l_quantity") - 2).alias("size")))


@query("font_main", """SELECT doc_id, arg_max(size, (w, -font)) AS main_font_size, round(max(w) / sum(w), 6) AS perc_main_font_word FROM
  (SELECT l_orderkey AS doc_id, l_suppkey % 3 AS font, sum(l_quantity) AS w, max(l_linenumber) AS size FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def font_main(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_suppkey") % 3).alias("font"), F.col("l_linenumber").alias("size"), F.col("l_quantity").alias("words"))
    return pages.main_font(runs).withColumn("perc_main_font_word", F.round("perc_main_font_word", 6))


RUNS = """(SELECT l_orderkey // 16 AS doc_id, 1 AS page_no, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey AS seq, CAST(l_suppkey % 20 * 30 AS INT) AS top, CAST(l_partkey % 500 AS INT) AS "left", CAST(l_partkey % 500 + l_quantity AS INT) AS "right", 10 + CAST(l_linenumber % 2 AS INT) AS height, CAST(l_linenumber % 2 AS INT) AS font, CAST(l_linenumber % 3 AS INT) AS fmt FROM lineitem)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 16 AS doc_id", "1 AS page_no", "(l_orderkey * 10 + l_linenumber) * 100000000L + l_partkey AS seq", "int(l_suppkey % 20 * 30) AS top", "int(l_partkey % 500) AS left", "int(l_partkey % 500 + l_quantity) AS right", "10 + int(l_linenumber % 2) AS height", "int(l_linenumber % 2) AS font", "int(l_linenumber % 3) AS fmt")


@query("run_gaps", f"""SELECT doc_id, seq, "left" - lag("right") OVER (PARTITION BY doc_id, page_no, top ORDER BY "left", seq, "right") AS gap FROM {RUNS}""")
def run_gaps(spark, sf_dir):
    return pages.run_gaps(runs(spark, sf_dir)).select("doc_id", "seq", "gap")


@query("merged_runs", f"""WITH m AS (SELECT *, "left" - lag("right") OVER w < 10 AND (count(*) OVER (PARTITION BY doc_id, page_no, "left") <= 2 OR fmt > 0 OR lag(fmt) OVER w > 0) AS j FROM {RUNS} WINDOW w AS (PARTITION BY doc_id, page_no, top ORDER BY "left", seq, "right")),
  n AS (SELECT *, CAST(sum(CASE WHEN j THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no, top ORDER BY "left", seq, "right" ROWS UNBOUNDED PRECEDING) AS INT) AS line FROM m)
  SELECT doc_id, page_no, top, line, min("left") AS "left", max("right") AS "right", count(*) AS runs FROM n GROUP BY 1, 2, 3, 4""")
def merged_runs(spark, sf_dir):
    return pages.merged_runs(runs(spark, sf_dir))


@query("line_gaps", f"""WITH h AS (SELECT doc_id, page_no, top, min(struct_pack(l := "left", s := seq, height := height, font := font)) AS h FROM {RUNS} GROUP BY 1, 2, 3),
  g AS (SELECT doc_id, page_no, top, top - lag(top + h.height) OVER w AS gap, h.font AS font, lag(h.font) OVER w AS above FROM h WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY top)),
  c AS (SELECT doc_id, page_no, gap, count(*) AS k, min(top) AS first FROM g WHERE gap > 0 AND font = above GROUP BY 1, 2, 3)
  SELECT doc_id, page_no, arg_max(gap, (k, -first)) AS norm_gap, round(max(k) / sum(k), 6) AS share_norm_gap FROM c GROUP BY 1, 2""")
def line_gaps(spark, sf_dir):
    return pages.line_gaps(runs(spark, sf_dir)).withColumn("share_norm_gap", F.round("share_norm_gap", 6))


@query("columns_mode", f"""WITH RECURSIVE b AS (SELECT DISTINCT ON (doc_id, page_no, "left") doc_id, page_no, "left" AS l, "right" AS r FROM (SELECT doc_id // 8 AS doc_id, doc_id % 8 AS page_no, "left", "right" FROM {RECTS}) ORDER BY doc_id, page_no, "left", "right"),
  s AS (SELECT doc_id, page_no, 0 AS n, -1000000000 AS at FROM b GROUP BY ALL
    UNION ALL SELECT s.doc_id, s.page_no, s.n + 1, (SELECT min(r) FROM b WHERE b.doc_id = s.doc_id AND b.page_no = s.page_no AND b.l >= s.at) FROM s WHERE EXISTS (SELECT 1 FROM b WHERE b.doc_id = s.doc_id AND b.page_no = s.page_no AND b.l >= s.at)),
  p AS (SELECT doc_id, page_no, greatest(max(n), 1) AS cols FROM s GROUP BY 1, 2), c AS (SELECT doc_id, cols, count(*) AS k FROM p GROUP BY 1, 2)
  SELECT doc_id, CAST(arg_max(cols, (k, -cols)) AS INT) AS modal_columns, round(max(k) / sum(k), 6) AS perc_modal_columns FROM c GROUP BY 1""")
def columns_mode(spark, sf_dir):
    boxes = rects(spark, sf_dir).select(F.expr("doc_id div 8").alias("doc_id"), (F.col("doc_id") % 8).alias("page_no"), "left", "right")
    return pages.columns_mode(boxes).withColumn("perc_modal_columns", F.round("perc_modal_columns", 6))


@query("first_pages", "SELECT l_orderkey AS doc_id, l_linenumber AS page_no FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem) WHERE r <= 3")
def first_pages(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"))


# ---------------------------------------------------------------- markup (pages)


def tags(html, name: str):
    return F.regexp_extract_all(html, F.lit(f"(?is)<{name}[ >]"), F.lit(0))


@query("markup_elements", """SELECT page_id, kind, CAST(len(regexp_extract_all(html, '(?is)<' || kind || '[ >]')) AS INT) AS n FROM pages, (VALUES ('b'), ('a'), ('li'), ('p'), ('h1')) k(kind)""")
def markup_elements(spark, sf_dir):
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.size(tags(F.col("html"), k)).alias("n")) for k in ("b", "a", "li", "p", "h1"))))
    return table(spark, sf_dir, "pages").select("page_id", kinds.alias("e")).select("page_id", "e.kind", "e.n")


@query("bold_words_pp", """SELECT page_id, CAST(list_sum(list_transform(regexp_extract_all(html, '(?is)<b>([^<]*)', 1), lambda t: len(list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')))) AS BIGINT) AS bold_words FROM pages""")
def bold_words_pp(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("(?is)<b>([^<]*)"), F.lit(1))
    total = F.when(F.size(found) > 0, F.aggregate(F.transform(found, T.word_count), F.lit(0).cast("bigint"), lambda a, n: a + n))
    return table(spark, sf_dir, "pages").select("page_id", total.alias("bold_words"))


@query("links_pp", """SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, round(avg(len(regexp_extract_all(html, '(?is)<a[ >]'))), 6) AS mean_annotations_pp, count(*) AS pages FROM pages GROUP BY 1""")
def links_pp(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.round(F.avg(F.size(tags(F.col("html"), "a"))), 6).alias("mean_annotations_pp"), F.count(F.lit(1)).alias("pages"))


@query("outline_items", """SELECT page_id, CAST(len(regexp_extract_all(html, '(?is)<ul[ >]')) + len(regexp_extract_all(html, '(?is)<li[ >]')) AS INT) AS count_outline_items FROM pages""")
def outline_items(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", (F.size(tags(F.col("html"), "ul")) + F.size(tags(F.col("html"), "li"))).alias("count_outline_items"))


# ---------------------------------------------------------------- page vectors (embeddings)


@query("knn_vote", """WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT vec_id, embedding, label % 2 AS label FROM embeddings WHERE vec_id % 50 <> 0),
  d AS (SELECT q.vec_id AS doc_id, t.label, list_distance(q.embedding::DOUBLE[], t.embedding::DOUBLE[]) AS d, t.vec_id AS t FROM q, t),
  n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d, t) AS r FROM d) WHERE r <= 5)
  SELECT doc_id, round(sum(CASE WHEN label = 1 THEN w ELSE 0 END) / sum(w), 4) AS p1 FROM (SELECT *, CASE WHEN min(d) OVER (PARTITION BY doc_id) = 0 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END AS w FROM n) GROUP BY 1""")
def knn_vote(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 2).alias("label"))
    ask = vec.where("vec_id % 50 = 0").select(F.col("vec_id").alias("doc_id"), "vector")
    return vectors.knn_vote(ask, vec.where("vec_id % 50 <> 0")).withColumn("p1", F.round("p1", 4))


@query("page_vectors_concat", """SELECT doc_id, len(v) AS dims, round(list_sum(v), 4) AS total, round(v[1], 6) AS first FROM (SELECT vec_id // 3 AS doc_id, flatten(list(embedding::DOUBLE[] ORDER BY vec_id)) AS v FROM embeddings GROUP BY 1 HAVING count(*) = 3)""")
def page_vectors_concat(spark, sf_dir):
    from quirelens.operators import models

    rows = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("doc_id"), F.lit(1).alias("page_no"), F.element_at(F.array(F.lit("res"), F.lit("xce"), F.lit("inc")), (F.col("vec_id") % 3 + 1).cast("int")).alias("net"), F.col("embedding").cast("array<double>").alias("vector"))
    v = F.col("vector")
    return models.joined_vectors(rows).select("doc_id", F.size(v).cast("long").alias("dims"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(v[0], 6).alias("first"))


@query("page_to_doc_mean", "SELECT d.doc_id, round(coalesce(avg(e.label / 10.0), 0), 6) AS probability FROM documents d LEFT JOIN embeddings e ON e.vec_id // 3 = d.doc_id GROUP BY 1")
def page_to_doc_mean(spark, sf_dir):
    from quirelens.operators import models

    scores = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 3").alias("doc_id"), (F.col("label") / 10).alias("score"))
    return models.document_scores(table(spark, sf_dir, "documents").select("doc_id"), scores).withColumn("probability", F.round("probability", 6))


# ---------------------------------------------------------------- layout, models, streams


def layout_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen orders as a document, lineitem rows as text runs on pages of 100 rows."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.selectExpr(
        "string(l_orderkey div 64) AS doc_id", "int(l_orderkey % 64 div 16) + 1 AS page_no", "int(l_orderkey % 16 * 10 + l_linenumber) AS elem_seq", "'text' AS kind",
        "int(l_orderkey % 16 * 40 + l_linenumber * 12) AS top", "int(50 + l_suppkey % 3 * 200) AS left", "int(100 + l_quantity) AS width", "10 AS height", "int(l_linenumber % 2) AS font",
        "concat('run ', l_linestatus) AS text", "0 AS fmt",
    )


@query("layout_boxes")
def layout_boxes(spark, sf_dir):
    from quirelens.operators import layout

    return layout.boxes(layout_elements(spark, sf_dir)).drop("text")


@query("layout_islands", """WITH r AS (SELECT l_orderkey, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS n FROM lineitem),
  i AS (SELECT *, n - row_number() OVER (PARTITION BY l_orderkey, f ORDER BY n) AS g FROM r)
  SELECT CAST(l_orderkey // 64 AS VARCHAR) AS doc_id, CAST(l_orderkey % 64 + 1 AS INTEGER) AS page_no, CASE WHEN count(*) > 2 THEN 'block' ELSE 'text' END AS kind,
  CAST(CASE f WHEN 'A' THEN 50 WHEN 'N' THEN 150 ELSE 250 END AS INTEGER) AS box_left, CAST(min(n) * 20 AS INTEGER) AS box_top, CAST(max(n) * 20 + 12 AS INTEGER) AS box_bot, CAST(count(*) AS INTEGER) AS n_lines
  FROM i GROUP BY l_orderkey, f, g""")
def layout_islands(spark, sf_dir):
    """An order as a page, its lines as evenly spaced text lines indented by their flag: each stretch of one flag is one box, a block from three lines on."""
    from quirelens.operators import layout

    rows = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").selectExpr("l_orderkey", "l_returnflag", "int(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS elem_seq")
    runs = rows.selectExpr(
        "string(l_orderkey div 64) AS doc_id", "int(l_orderkey % 64) + 1 AS page_no", "elem_seq", "'text' AS kind", "elem_seq * 20 AS top",
        "CASE l_returnflag WHEN 'A' THEN 50 WHEN 'N' THEN 150 ELSE 250 END AS left", "100 AS width", "12 AS height", "0 AS font", "'run' AS text", "0 AS fmt",
    )
    return layout.boxes(runs).selectExpr("doc_id", "page_no", "kind", "`left` AS box_left", "top AS box_top", "bot AS box_bot", "n_lines")


@query("page_xml_elements", """SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(n_links), 0) AS BIGINT) AS links FROM (
  SELECT 'page' AS kind, 0 AS n_links FROM part UNION ALL SELECT 'text', 1 FROM part UNION ALL SELECT 'fontspec', 0 FROM part) GROUP BY 1""")
def page_xml_elements(spark, sf_dir):
    from quirelens.sources import page_xml

    body = F.concat(F.lit('<pdf2xml><page width="100" height="200"><fontspec id="0" size="'), F.col("p_size").cast("string"), F.lit('" family="Times" color="#000"/><text top="1" left="2" width="3" height="4" font="0">x <a href="u">'), F.lit("link</a> tail</text></page></pdf2xml>"))
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), body.cast("binary").alias("xml"))
    return page_xml.read(docs).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("links"))


@query("train_stack")
def train_stack(spark, sf_dir):
    """A stack over documents and labels: text fields and numeric features against the quality label; scores of all documents."""
    from quirelens.operators import models

    docs = table(spark, sf_dir, "documents")

    def fields(rows, *more):
        split = rows.withColumns({"text": F.coalesce("text", F.lit("")), "words": T.words(F.col("text"))})  # once for what is made of words
        breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
        return split.select(
            "doc_id", "text", F.array_join(F.slice("words", 1, 100), " ").alias("first_100_words"), F.coalesce("source", F.lit("none")).alias("folder_name"),
            F.coalesce("n_chars", F.lit(0)).cast("double").alias("n_chars"), F.size("words").cast("double").alias("n_words"), (breaks + 1).cast("double").alias("n_lines"), *more,
        )

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    train = fields(docs.join(labels, "doc_id"), "label")  # words of the labelled alone
    stack = models.Stack(("text", "first_100_words", "folder_name"), ["n_chars", "n_words", "n_lines"], trees=20, folds=2).fit(train)
    return stack.score(fields(docs)).select("doc_id", "probability", report.decide(F.col("probability")).alias("prediction"))


@query("pseudo_label")
def pseudo_label(spark, sf_dir):
    """Page vectors with half of the labels hidden: probabilities of the model after one round of self-training."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from quirelens.operators import models

    vec = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), (F.col("label") % 2).alias("label"))
    _, model = models.pseudo_labelled(vec.where("vec_id % 2 = 0"), vec.where("vec_id % 2 = 1"))
    return model.transform(vec.withColumn("features", array_to_vector("vector"))).select("vec_id", vector_to_array("probability")[1].alias("score"))


@query("stream_incremental", """SELECT event_type, count(*) AS n_docs, CAST(sum(CASE WHEN CAST(round(abs(value) * 100) AS BIGINT) % 1000 / 1000.0 >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive FROM events GROUP BY 1""")
def stream_incremental(spark, sf_dir):
    from quirelens.streaming import incremental

    return incremental.events_report(spark, sf_dir)


STREAMED = "(SELECT CAST(round(abs(value) * 100) AS BIGINT) % 1000 / 1000.0 AS probability, user_id % 7 + 1 AS pages, length(event_type) AS participants FROM events)"


@query("stream_report", f"SELECT {COUNTERS}, 3 AS n_batches FROM {STREAMED}")
def stream_report(spark, sf_dir):
    """The exposure report kept as the state of a stream over events; the last batch's is that of all."""
    from quirelens.streaming import incremental

    folder = f"{shared_folder(spark)}/report-{uuid.uuid4().hex}"
    events = incremental.arriving_events(spark, sf_dir, folder)
    docs = events.select((F.round(F.abs(F.col("value")) * 100).cast("bigint") % 1000 / 1000.0).alias("probability"), (F.col("user_id") % 7 + 1).alias("pages"), F.length("event_type").alias("participants"))
    incremental.publish_report(docs, f"{folder}/reports", f"{folder}/state")
    return incremental.published_report(spark, f"{folder}/reports")


@query("stream_statistics", "SELECT feature, count(*) AS n, round(avg(x), 9) AS mean, min(x) AS min, max(x) AS max FROM (SELECT 'value' AS feature, value AS x FROM events UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE) FROM events) GROUP BY 1")
def stream_statistics(spark, sf_dir):
    """Scaling statistics that grow with a stream over events; all batches are delivered twice, and counted once."""
    from quirelens.streaming import incremental

    folder, features = f"{shared_folder(spark)}/statistics-{uuid.uuid4().hex}", ["value", "user_id"]
    events = incremental.arriving_events(spark, sf_dir, folder)
    incremental.keep_statistics(events, features, f"{folder}/batches", f"{folder}/state")
    incremental.keep_statistics(events, features, f"{folder}/batches", f"{folder}/state-lost")  # all batches again, under the same numbers
    return incremental.current_statistics(spark, f"{folder}/batches").withColumn("mean", F.round("mean", 9))


# ---------------------------------------------------------------- cleaning with the whole list of stop words

ALL_STOP_SQL = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in T.ALL_STOP_WORDS) + "]"


@query("text_clean_all", ORACLE_SQL["text_clean"].replace(STOP_SQL, ALL_STOP_SQL))
def text_clean_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("clean"))


@query("metadata_clean_all", ORACLE_SQL["metadata_clean"].replace(STOP_SQL, ALL_STOP_SQL))
def metadata_clean_all(spark, sf_dir):
    values = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("v")).unionByName(table(spark, sf_dir, "part").select((-1 - F.col("p_partkey")).alias("id"), F.col("p_name").alias("v")))
    return values.select("id", T.clean_metadata(F.col("v")).alias("clean"))
