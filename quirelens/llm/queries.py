"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import bpe, chat, html_extract, jaccard_join, mixing, pii, prefix_trie, quality, spelling, spotsigs, suffix_dedup, toxicity, urls
from quirelens import runtime

#: Where the vocabulary files of the public tokenizers lie (a parameter; they are not part of the repository).
TOKENIZER_FILE = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER_FILE) -> str:
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    runtime.small_batches(spark)
    return runtime.table(spark, sf_dir, name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold the template's own control strings."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chats(chats.unionByName(extra)))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents")).drop("class_id")


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.digest(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat": op2_chat,
    "op3_bpe": op3_bpe,
    "op4_toxicity": op4_toxicity,
    "op5_urls": op5_urls,
    "op6_suffixes": op6_suffixes,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_jaccard": op9_jaccard,
    "op10_spotsigs": op10_spotsigs,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_main_text": op12_main_text,
    "op13_spelling": op13_spelling,
}

#: Unsigned crc32 in DuckDB: the table of 256 steps (t), and the fold of a list of bytes over it.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i)))"


def crc_sql(octets: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def octets_sql(text: str) -> str:
    """UTF-8 bytes of a text of code points below 2048."""
    return f"flatten(list_transform(string_split({text}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + (unicode(x) & 63) AS BIGINT)] END))"


PREFIX_TRIE_SQL = f"""WITH {CRC_TABLE},
  turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT c, max(pos) AS m FROM turns GROUP BY 1),
  convs AS (SELECT c, c - c % 5 AS b, {crc_sql(octets_sql("CAST(c AS VARCHAR)"))} % {prefix_trie.SHARED} AS h FROM own, crc),
  rebuilt AS (SELECT v.c, t.pos AS d, role, text FROM convs v JOIN turns t ON t.c = v.b AND t.pos <= v.h
    UNION ALL SELECT v.c, t.pos - v.h + least(v.h, coalesce(o.m, 0)), role, text FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h LEFT JOIN own o ON o.c = v.b),
  p AS (SELECT c, d, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS k, strlen(text) AS size FROM rebuilt UNION ALL SELECT c, 0, 'root', 0 FROM convs),
  nodes AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saving FROM p GROUP BY 1, 2),
  up AS (SELECT n.d, n.k, q.d AS pd, q.k AS pk FROM nodes n JOIN p q ON q.c = n.conv_id AND q.d = n.d - 1),
  kids AS (SELECT pd AS d, pk AS k, count(*) AS n_children FROM up GROUP BY 1, 2),
  below AS (SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM p a JOIN p b ON a.c = b.c AND b.d >= a.d),
  sums AS (SELECT below.d, below.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum(n.saving) AS saved_tokens FROM below JOIN nodes n ON n.d = bd AND n.k = bk LEFT JOIN kids ON kids.d = bd AND kids.k = bk GROUP BY 1, 2),
  ends AS (SELECT d, k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends_sha256 FROM (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM p GROUP BY 1) GROUP BY 1, 2)
  SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
  FROM nodes n JOIN sums USING (d, k) LEFT JOIN kids USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN up USING (d, k) LEFT JOIN nodes m ON m.d = up.pd AND m.k = up.pk"""

SPELLING_SQL = f"""WITH RECURSIVE {CRC_TABLE},
  runs AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
  hashed AS (SELECT run, k, {crc_sql(octets_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run"))} AS h FROM runs, crc),
  said AS (SELECT CASE WHEN h % {spelling.PLANT} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w, k FROM hashed),
  words AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM said WHERE length(w) >= {spelling.MIN_LENGTH} GROUP BY 1 HAVING sum(k) >= {spelling.MIN_COUNT}),
  gaps AS (SELECT w, i, substr(w, 1, i - 1) || substr(w, i + 1) AS g FROM (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM words)),
  shorter AS (SELECT DISTINCT gaps.w AS a, words.w AS b FROM gaps JOIN words ON words.w = g),
  near AS (SELECT x.w AS a, y.w AS b FROM gaps x JOIN gaps y ON x.g = y.g AND x.i = y.i AND x.w <> y.w UNION ALL SELECT a, b FROM shorter UNION ALL SELECT b, a FROM shorter),
  best AS (SELECT a AS w, b AS form, n AS form_n, n_near FROM (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM near JOIN words ON words.w = b) WHERE r = 1),
  told AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (w)),
  walk AS (SELECT w, w AS at FROM told UNION ALL SELECT walk.w, told.form FROM walk JOIN told ON told.w = walk.at WHERE told.form IS NOT NULL)
  SELECT told.w AS word, told.form, walk.at AS root, told.n, told.n_near, told.form_n FROM told JOIN walk ON walk.w = told.w JOIN told last ON last.w = walk.at AND last.form IS NULL"""

ORACLE_SQL: dict[str, str] = {"op11_prefix_trie": PREFIX_TRIE_SQL, "op13_spelling": SPELLING_SQL}
