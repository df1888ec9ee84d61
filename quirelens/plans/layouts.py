"""Registered queries of page layout: lines, joins, successors, on pages made of order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelens.functions import text as T
from quirelens.operators import features, layout
from quirelens.plans.catalog import query
from quirelens.runtime import cut_lineage, parts_for, spread, table

ORDERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)"

#: An order as a page of one font: two runs a top, some close together, some of odd height, some formatted.
RUNS = f"""(SELECT l_orderkey AS o, n, (n // 2) * 20 AS top, 50 + n % 2 * 100 AS lft, 50 + n % 2 * 100 + 88 + q % 14 AS rgt, CASE WHEN flag = 'A' THEN 9 ELSE 12 END AS h, CASE WHEN q % 5 = 0 THEN n % 3 ELSE 0 END AS fmt, 'w' || n AS txt
  FROM (SELECT l_orderkey, {ORDERED} AS n, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS flag FROM lineitem))"""


def numbered(spark, sf_dir, name):
    """Order lines with doc_id and page_no (an order is a page), dealt by document, and their number in the order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity").selectExpr("*", "string(l_orderkey) AS doc_id", "1 AS page_no")
    return spread(rows, "doc_id").selectExpr("*", f"int({ORDERED.replace('l_orderkey', 'doc_id', 1)}) AS {name}")


def pages_of_orders(spark, sf_dir):
    rows = numbered(spark, sf_dir, "elem_seq").selectExpr("doc_id", "page_no", "elem_seq", "int(l_quantity) AS q", "l_returnflag")
    return rows.selectExpr(
        "doc_id", "page_no", "elem_seq", "'text' AS kind", "elem_seq div 2 * 20 AS top", "50 + elem_seq % 2 * 100 AS left", "88 + q % 14 AS width",
        "CASE WHEN l_returnflag = 'A' THEN 9 ELSE 12 END AS height", "0 AS font", "concat('w', elem_seq) AS text", "CASE WHEN q % 5 = 0 THEN elem_seq % 3 ELSE 0 END AS fmt",
    ).selectExpr("doc_id", "page_no", "elem_seq", "kind", "int(top) AS top", "left", "width", "height", "font", "text", "fmt")


#: The lines of those pages: odd heights by the recursion over runs, then lengthened lines, then joins; z has one row per line.
LINES = f"""WITH RECURSIVE r AS (SELECT * FROM {RUNS}),
  s AS (SELECT o, n, h AS best, h AS first, CAST(h = 12 AS INTEGER) AS c12, CAST(h = 9 AS INTEGER) AS c9, false AS odd FROM r WHERE n = 1
    UNION ALL SELECT o, n, b, first, CASE WHEN h = 12 AND h <> best AND NOT (h <> b) THEN 1 ELSE k12 END, CASE WHEN h = 9 AND h <> best AND NOT (h <> b) THEN 1 ELSE k9 END, h <> best AND h <> b
    FROM (SELECT *, CASE WHEN h = best THEN best WHEN k12 > k9 THEN 12 WHEN k9 > k12 THEN 9 ELSE first END AS b
      FROM (SELECT r.o, r.n, r.h, s.best, s.first, s.c12 + CAST(r.h = 12 AS INTEGER) AS k12, s.c9 + CAST(r.h = 9 AS INTEGER) AS k9 FROM s JOIN r ON r.o = s.o AND r.n = s.n + 1))),
  w AS (SELECT r.*, s.odd, lead(s.odd) OVER p AS nodd, lead(r.lft) OVER p AS nl, lead(r.rgt) OVER p AS nr, lead(r.fmt) OVER p AS nf, lead(r.txt) OVER p AS nt FROM r JOIN s USING (o, n) WINDOW p AS (PARTITION BY o ORDER BY n)),
  l AS (SELECT o, n, top, lft, CASE WHEN c THEN nr ELSE rgt END AS rgt, CASE WHEN c THEN 2 ELSE 1 END AS runs, CASE WHEN c THEN txt || ' ' || nt ELSE txt END AS txt, CASE WHEN NOT c OR nf = 0 OR fmt = nf THEN fmt WHEN fmt = 0 THEN nf ELSE 4 END AS fmt
    FROM (SELECT *, coalesce(nodd AND nl - rgt >= 0 AND nl - rgt < 10, false) AS c FROM w)),
  g AS (SELECT *, coalesce(lft - lag(rgt) OVER p < 10, false) AND top > min(top) OVER (PARTITION BY o) AS near, fmt > 0 OR coalesce(lag(fmt) OVER p, 0) > 0 AS styled, count(*) OVER (PARTITION BY o, lft) AS c FROM l WINDOW p AS (PARTITION BY o, top ORDER BY lft, n)),
  j AS (SELECT *, near AND (styled OR c - coalesce(sum(CAST(near AND styled AS INTEGER)) OVER (PARTITION BY o, lft ORDER BY top RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) <= 2) AS joins FROM g),
  z AS (SELECT o, top, island, min(lft) AS lft, arg_max(rgt, lft) AS rgt, arg_min(n, lft) AS head, sum(runs) AS runs, string_agg(txt, ' ' ORDER BY lft, n) AS txt,
    CASE WHEN count(DISTINCT nullif(fmt, 0)) = 0 THEN 0 WHEN count(DISTINCT nullif(fmt, 0)) = 1 THEN max(fmt) ELSE 4 END AS fmt
    FROM (SELECT *, sum(CAST(NOT joins AS INTEGER)) OVER (PARTITION BY o, top ORDER BY lft, n) AS island FROM j) GROUP BY o, top, island)"""


@query("layout_lines", f"""{LINES}
  SELECT CAST(o AS VARCHAR) AS doc_id, CAST(top AS INTEGER) AS line_top, CAST(lft AS INTEGER) AS line_left, CAST(rgt AS INTEGER) AS line_right, CAST(runs AS INTEGER) AS n_runs, CAST(fmt AS INTEGER) AS line_fmt FROM z""")
def layout_lines(spark, sf_dir):
    """Lines of every order's page: runs of odd height lengthen the line before, close neighbours of one top join."""
    parts = parts_for(table(spark, sf_dir, "lineitem"))
    joined = layout.joined_lines(layout.lines(pages_of_orders(spark, sf_dir), parts))
    return joined.select("doc_id", F.col("top").alias("line_top"), F.col("left").alias("line_left"), F.col("right").alias("line_right"), F.size(F.split("text", " ")).alias("n_runs"), F.col("fmt").alias("line_fmt"))


@query("doubled_text", f"""{LINES},
  t AS (SELECT o, string_agg(txt, ' ' ORDER BY n) AS txt FROM r GROUP BY 1), y AS (SELECT o, string_agg(txt, ' ' ORDER BY head) AS txt FROM z GROUP BY 1)
  SELECT CAST(o AS VARCHAR) AS doc_id, doubled, text, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words, array_to_string(list_slice(string_split(text, ' '), -5, -1), ' ') AS last_words
  FROM (SELECT o, false AS doubled, t.txt AS text FROM t UNION ALL SELECT o, true, t.txt || ' ' || y.txt FROM t JOIN y USING (o))""")
def doubled_text(spark, sf_dir):
    """The text of every order's page: its runs alone, and its runs with its merged lines behind them."""
    parts = parts_for(table(spark, sf_dir, "lineitem"))
    elements = cut_lineage(pages_of_orders(spark, sf_dir))
    lines = layout.joined_lines(layout.lines(elements, parts))
    both = [features.document_texts(elements, lines, doubled, parts).withColumn("doubled", F.lit(doubled)) for doubled in (False, True)]
    return both[0].unionByName(both[1]).select("doc_id", "doubled", "text", T.word_count(F.col("text")).alias("n_words"), T.last_words(F.col("text"), 5).alias("last_words"))


@query("line_successors", f"""WITH r AS (SELECT l_orderkey AS o, n * 10 + q % 8 AS top, 8 + l_suppkey % 25 AS h, 50 + l_partkey % 7 AS lft, 150 + q % 9 AS rgt, n % 2 AS font
    FROM (SELECT l_orderkey, l_suppkey, l_partkey, CAST(l_quantity AS INTEGER) AS q, {ORDERED} AS n FROM lineitem)),
  p AS (SELECT a.o, a.top, b.top - a.top - a.h AS gap, a.font = b.font AS same_font, row_number() OVER (PARTITION BY a.o, a.top ORDER BY b.top) AS k FROM r a JOIN r b ON a.o = b.o AND b.top > a.top
    AND (b.top - a.top - a.h > 0 OR (abs(b.top - a.top - a.h) * 100 < 15 * a.h AND (abs(a.lft - b.lft) <= 2 OR abs(a.rgt - b.rgt) <= 2 OR (a.lft <= b.lft AND b.rgt <= a.rgt) OR (b.lft <= a.lft AND a.rgt <= b.rgt)))))
  SELECT CAST(o AS VARCHAR) AS doc_id, CAST(top AS INTEGER) AS line_top, CAST(gap AS INTEGER) AS gap, same_font FROM p WHERE k = 1""")
def line_successors(spark, sf_dir):
    """Every order line as a line of text that may overlap the next ones: the first line below that may follow it."""
    rows = numbered(spark, sf_dir, "n").selectExpr("doc_id", "page_no", "n", "int(l_quantity) AS q", "int(l_suppkey) AS s", "int(l_partkey) AS p")
    lines = rows.selectExpr("doc_id", "page_no", "n AS seq", "n * 10 + q % 8 AS top", "50 + p % 7 AS left", "150 + q % 9 AS right", "8 + s % 25 AS height", "n % 2 AS font")
    return layout.successors(lines, lines).select("doc_id", F.col("top").alias("line_top"), "gap", "same_font")


#: An order as a page of 80 by 60: its lines are images, text boxes or blocks by their flag, some repeated, some beyond the page.
RECTS = f"""(SELECT l_orderkey AS o, n, flag, p % 90 - 8 AS l, s % 60 - 5 AS t, p % 90 - 8 + 4 + q % 30 AS r, s % 60 - 5 + 4 + q % 25 AS b
  FROM (SELECT l_orderkey, {ORDERED} AS n, l_returnflag AS flag, l_partkey % 7 * 9 AS p, l_suppkey % 5 * 7 AS s, CAST(l_quantity AS INTEGER) % 9 AS q FROM lineitem))"""


@query("page_space", f"""WITH x AS (SELECT * FROM {RECTS}),
  k AS (SELECT o, CASE flag WHEN 'A' THEN 'i' ELSE 'b' END AS kind, flag = 'R' AS block, n, greatest(0, least(l, 80)) AS l, greatest(0, least(t, 60)) AS t, CASE flag WHEN 'A' THEN greatest(0, least(r, 80)) ELSE least(r, 80) END AS r, CASE flag WHEN 'A' THEN greatest(0, least(b, 60)) ELSE least(b, 60) END AS b FROM x),
  d AS (SELECT o, kind, l, t, r, b, (r - l) * (b - t) AS size, min(CASE WHEN block THEN 1000 ELSE 0 END + n) AS seq FROM k WHERE (r - l) * (b - t) > CASE kind WHEN 'i' THEN 1 ELSE 0 END GROUP BY 1, 2, 3, 4, 5, 6),
  p AS (SELECT a.o, a.kind, a.seq, a.size, c.kind AS other, CASE WHEN least(a.r, c.r) >= greatest(a.l, c.l) AND least(a.b, c.b) >= greatest(a.t, c.t) THEN (least(a.r, c.r) - greatest(a.l, c.l)) * (least(a.b, c.b) - greatest(a.t, c.t)) ELSE 0 END AS ov
    FROM d a JOIN d c ON a.o = c.o AND ((a.kind = c.kind AND a.seq > c.seq) OR (a.kind = 'b' AND c.kind = 'i'))),
  m AS (SELECT d.o, d.kind, d.seq, d.size, coalesce(sum(CASE WHEN p.other = d.kind THEN ov END), 0) AS same, coalesce(sum(CASE WHEN p.other <> d.kind THEN ov END), 0) AS img FROM d LEFT JOIN p ON p.o = d.o AND p.kind = d.kind AND p.seq = d.seq GROUP BY 1, 2, 3, 4),
  g AS (SELECT o, count(*) FILTER (kind = 'i') AS images, coalesce(sum(greatest(size - same, 0)) FILTER (kind = 'i'), 0) AS image_space, coalesce(sum(same) FILTER (kind = 'i'), 0) AS image_image,
    coalesce(sum(size) FILTER (kind = 'b' AND seq < 1000), 0) AS textbox_space, coalesce(sum(size) FILTER (kind = 'b' AND seq >= 1000), 0) AS blockstyle_space, coalesce(sum(img) FILTER (kind = 'b'), 0) AS box_image, coalesce(sum(same) FILTER (kind = 'b'), 0) AS box_box FROM m GROUP BY 1)
  SELECT CAST(q.o AS VARCHAR) AS doc_id, CAST(coalesce(images, 0) AS BIGINT) AS images, CAST(coalesce(image_space, 0) AS BIGINT) AS image_space, CAST(coalesce(image_image, 0) AS BIGINT) AS image_image, CAST(coalesce(textbox_space, 0) AS BIGINT) AS textbox_space, CAST(coalesce(blockstyle_space, 0) AS BIGINT) AS blockstyle_space,
  CAST(coalesce(box_image, 0) AS BIGINT) AS box_image, CAST(coalesce(box_box, 0) AS BIGINT) AS box_box, CAST(4800 - coalesce(image_space + textbox_space + blockstyle_space - box_image - box_box, 0) AS BIGINT) AS free_space, round(coalesce(image_space, 0) / 4800.0, 6) AS image_ratio
  FROM (SELECT DISTINCT o FROM x) q LEFT JOIN g USING (o)""")
def page_space(spark, sf_dir):
    """Space of images, text boxes and blocks on every order's page, with the three kinds of overlap, free space and the share of images."""
    from quirelens.functions import geometry as G
    from quirelens.operators import pages

    rows = cut_lineage(numbered(spark, sf_dir, "seq").selectExpr("doc_id", "page_no", "seq", "l_returnflag AS flag", "int(l_partkey % 7 * 9) AS p", "int(l_suppkey % 5 * 7) AS s", "int(l_quantity) % 9 AS q"))
    rects = rows.selectExpr("doc_id", "page_no", "seq", "flag", "p % 90 - 8 AS left", "s % 60 - 5 AS top", "4 + q % 30 AS width", "4 + q % 25 AS height")
    sheets = rects.select("doc_id", "page_no").distinct().selectExpr("doc_id", "page_no", "80 AS page_width", "60 AS page_height")
    box = G.clip(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.lit(80), F.lit(60))
    images = rects.where("flag = 'A'").select("doc_id", "page_no", "seq", *(v.alias(k) for k, v in box.items()))
    boxes = rects.where("flag <> 'A'").selectExpr("doc_id", "page_no", "seq AS box_id", "CASE flag WHEN 'R' THEN 'block' ELSE 'text' END AS kind", "left", "top", "left + width AS right", "top + height AS bot")
    out = pages.page_space(sheets, images, boxes, parts_for(table(spark, sf_dir, "lineitem")))
    return out.select("doc_id", "images", "image_space", "image_image", "textbox_space", "blockstyle_space", "box_image", "box_box", "free_space", F.round(F.col("image_space") / F.col("space"), 6).alias("image_ratio"))


ORDER_LINES = f"(SELECT l_orderkey AS o, {ORDERED} AS n, l_returnflag AS flag, CAST(l_quantity AS INTEGER) AS q, l_partkey AS p, l_suppkey AS s FROM lineitem)"
ROUNDED = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0), 6) AS {c}" for c in features.NUMERIC_41)


#: Order lines of a slice of :func:`feature_table`.
SLICE_ROWS = 72_000_000


def feature_elements(lines):
    """Elements of documents of up to 64 orders: a page with evenly spaced lines, images and a font each; some pages have too many tiny images."""
    numbers = ORDERED.replace("BY l_orderkey", "BY doc, l_orderkey", 1)
    rows = spread(lines, "doc").selectExpr("doc", "l_orderkey AS o", f"int({numbers}) AS n", "min(l_orderkey) OVER (PARTITION BY doc) AS first", "l_returnflag AS flag", "int(l_quantity) AS q", "l_partkey AS p", "l_suppkey AS s")
    said = "concat('run', repeat(' w', q % 3), CASE WHEN p % 50 = 0 THEN ' ©' ELSE '' END)"
    # all elements of an order line from one row, so that lines are numbered once: k says which, from 7 on a tiny image
    each = rows.selectExpr("*", "explode(sequence(1, CASE WHEN n = 1 AND o % 97 = 0 THEN 66 WHEN n = 1 THEN 6 ELSE 2 END)) AS k").where("(k <> 2 OR q % 4 = 0) AND (k <> 5 OR o % 10 = 0) AND (k <> 6 OR o = first)")

    numbers = {"text": "k = 1", "image": "k = 2", "page": "k = 3", "font": "k = 4", "item": "k = 5", "outline": "k = 6", "tiny": "k > 6"}
    of = lambda kind, **told: f"CAST(CASE {' '.join(f'WHEN {numbers[x]} THEN {value}' for x, value in told.items())} END AS {kind})"

    values = {
        "page_no": "CASE WHEN k NOT IN (5, 6) THEN int(o % 64) + 1 END", "page_width": "400", "page_height": "2000",
        "elem_seq": of("int", text="100 + n", image="50 + n", page="0", font="1", item="1", outline="0", tiny="194 + k"),
        "kind": of("string", text="'text'", image="'image'", page="'page'", font="'fontspec'", item="'item'", outline="'outline'", tiny="'image'"),
        "top": of("int", text="n * 20", image="s % 150", tiny="5"), "left": of("int", text="CASE flag WHEN 'A' THEN 50 WHEN 'N' THEN 150 ELSE 250 END", image="p % 300", tiny="5"),
        "width": of("int", text="100", image="10 + q", tiny="5"), "height": of("int", text="12", image="10 + q % 20", tiny="5"), "font": of("int", text="o % 2", font="o % 2"),
        "size": of("int", font="9 + 3 * (o % 2)"), "family": of("string", font="concat('F', o % 3)"), "color": of("string", font="concat('c', o % 5)"),
        "text": of("string", text=said), "bold_text": of("string", text=f"CASE WHEN q % 5 = 0 THEN {said} ELSE '' END"), "fmt": of("int", text="0"),
        "n_bold_words": of("int", text="CASE WHEN q % 5 = 0 THEN 1 + q % 3 + int(p % 50 = 0) ELSE 0 END"), "n_links": of("int", text="int(q % 7 = 0)"), "error_code": "CAST(NULL AS string)",
    }
    return each.selectExpr("doc AS doc_id", *(f"{value} AS {c}" for c, value in values.items()))


@query("feature_table", f"""WITH r AS (SELECT *, o // 64 AS d, o % 64 + 1 AS page, CASE flag WHEN 'A' THEN 50 WHEN 'N' THEN 150 ELSE 250 END AS l, 1 + q % 3 + CAST(p % 50 = 0 AS INTEGER) AS words FROM {ORDER_LINES}),
  st AS (SELECT d, min(page) FILTER (o % 97 = 0) AS stop FROM r GROUP BY 1),
  k AS (SELECT r.*, stop IS NULL OR page < stop AS done FROM r JOIN st USING (d) WHERE stop IS NULL OR page <= stop),
  pg AS (SELECT DISTINCT d, page, o, done FROM k),
  cnt AS (SELECT d, count(*) AS count_pages, count(*) AS count_fonts, count(DISTINCT o % 5) AS count_font_colors, count(DISTINCT o % 3) AS count_font_families, max(9 + 3 * (o % 2)) AS max_font_size, min(9 + 3 * (o % 2)) AS min_font_size FROM pg GROUP BY 1),
  outl AS (SELECT d, CASE WHEN stop IS NULL THEN 1 + (SELECT count(DISTINCT o) FROM r WHERE r.d = st.d AND o % 10 = 0) ELSE 0 END AS count_outline_items, CAST(stop IS NOT NULL AS INTEGER) AS image_error FROM st),
  fw AS (SELECT d, o % 2 AS font, sum(words) AS w FROM k GROUP BY 1, 2),
  fm AS (SELECT d, arg_max(9 + 3 * font, w * 10 - font) AS main_font_size, max(w) / sum(w) AS perc_main_font_word FROM fw GROUP BY 1),
  said AS (SELECT d, max(CAST(p % 50 = 0 AS INTEGER)) AS copyright_symbol, sum(CASE WHEN q % 5 = 0 THEN words ELSE 0 END) AS bold, sum(CAST(q % 7 = 0 AS INTEGER)) AS links FROM k GROUP BY 1),
  ln AS (SELECT d, sum(words) AS words, count(*) AS lines, count(DISTINCT page) AS pages FROM k WHERE done GROUP BY 1),
  im AS (SELECT d, page, done, p % 300 AS a, s % 150 AS b, p % 300 + 10 + q AS c, s % 150 + 10 + q % 20 AS e, min(n) AS seq FROM k WHERE q % 4 = 0 GROUP BY 1, 2, 3, 4, 5, 6, 7),
  ic AS (SELECT d, count(im.d) + max(image_error) AS n_images FROM outl LEFT JOIN im USING (d) GROUP BY 1),
  io AS (SELECT x.d, x.page, x.seq, greatest(any_value((x.c - x.a) * (x.e - x.b)) - coalesce(sum(CASE WHEN y.d IS NULL THEN 0 ELSE greatest(least(x.c, y.c) - greatest(x.a, y.a), 0) * greatest(least(x.e, y.e) - greatest(x.b, y.b), 0) END), 0), 0) AS added FROM im x LEFT JOIN im y ON x.d = y.d AND x.page = y.page AND x.seq > y.seq WHERE x.done GROUP BY 1, 2, 3),
  ip AS (SELECT d, page, sum(added) AS image_space FROM io GROUP BY 1, 2),
  isl AS (SELECT *, n - row_number() OVER (PARTITION BY o, flag ORDER BY n) AS g FROM k WHERE done),
  bx AS (SELECT d, page, l, min(n) * 20 AS t, max(n) * 20 + 12 AS b, count(*) AS lines, count(*) > 2 AS block FROM isl GROUP BY d, page, o, flag, l, g),
  bi AS (SELECT bx.d, bx.page, sum(greatest(least(l + 100, im.c) - greatest(l, im.a), 0) * greatest(least(bx.b, im.e) - greatest(bx.t, im.b), 0)) AS box_image FROM bx JOIN im ON bx.d = im.d AND bx.page = im.page GROUP BY 1, 2),
  bp AS (SELECT d, page, count(*) FILTER (NOT block) AS tn, coalesce(sum(lines) FILTER (NOT block), 0) AS tl, coalesce(sum(100 * (b - t)) FILTER (NOT block), 0) AS ts, CASE WHEN count(*) FILTER (NOT block) = 0 THEN 0 ELSE greatest(1, count(DISTINCT l) FILTER (NOT block AND lines >= 2)) END AS tc,
    count(*) FILTER (block) AS bn, coalesce(sum(lines) FILTER (block), 0) AS bl, coalesce(sum(100 * (b - t)) FILTER (block), 0) AS bs, CASE WHEN count(*) FILTER (block) = 0 THEN 0 ELSE greatest(1, count(DISTINCT l) FILTER (block)) END AS bc FROM bx GROUP BY 1, 2),
  sp AS (SELECT d, sum(coalesce(image_space, 0)) / (count(*) * 800000) AS mean_image_space_pp, max(coalesce(image_space, 0) / 800000) AS max_image_page_ratio, sum(800000 - coalesce(image_space, 0) - ts - bs + coalesce(box_image, 0)) / (count(*) * 800000) AS mean_free_space_pp,
    sum(tn) AS tn, sum(tl) / nullif(sum(tn), 0) AS mean_lines_per_textbox, avg(ts) AS mean_textbox_space_pp, sum(bn) AS bn, sum(bl) / nullif(sum(bn), 0) AS mean_lines_per_blockstyle, avg(bs) AS mean_blockstyle_space_pp FROM bp LEFT JOIN ip USING (d, page) LEFT JOIN bi USING (d, page) GROUP BY 1),
  tm AS (SELECT d, arg_max(tc, c * 100 - tc) AS m, max(c) AS c FROM (SELECT d, tc, count(*) AS c FROM bp GROUP BY 1, 2) GROUP BY 1), bm AS (SELECT d, arg_max(bc, c * 100 - bc) AS m, max(c) AS c FROM (SELECT d, bc, count(*) AS c FROM bp GROUP BY 1, 2) GROUP BY 1),
  ed AS (SELECT d, arg_max(l, c * 100000 - f) AS modal_left, max(c) / sum(c) AS perc_modal_left, max(l) AS max_left, min(l) AS min_left FROM (SELECT d, l, count(*) AS c, min(page * 10 + n) AS f FROM k WHERE done GROUP BY 1, 2) GROUP BY 1),
  w AS (SELECT *, -1 AS file_size, -1 AS page_rot, -1 AS page_size_x, -1 AS page_size_y, ln.words / ln.pages AS mean_words_pp, ln.lines / ln.pages AS mean_lines_pp, ln.words / ln.lines AS mean_words_per_line, bold / count_pages AS mean_bold_words_pp, links / count_pages AS mean_annotations_pp,
    n_images / count_pages AS mean_images_pp, tn / count_pages AS mean_textboxes_pp, bn / count_pages AS mean_blockstyles_pp, CASE WHEN tn > 0 THEN tm.m END AS modal_textbox_columns_pp, CASE WHEN tn > 0 THEN tm.c / count_pages END AS perc_modal_textbox_columns_pp,
    CASE WHEN bn > 0 THEN bm.m END AS modal_blockstyle_columns_pp, CASE WHEN bn > 0 THEN bm.c / count_pages END AS perc_modal_blockstyle_columns_pp, modal_left + 100 AS modal_right, perc_modal_left AS perc_modal_right, max_left + 100 AS max_right
    FROM cnt JOIN outl USING (d) JOIN fm USING (d) JOIN said USING (d) JOIN ic USING (d) LEFT JOIN ln USING (d) LEFT JOIN sp USING (d) LEFT JOIN tm USING (d) LEFT JOIN bm USING (d) LEFT JOIN ed USING (d)),
  x AS (SELECT * REPLACE (CASE WHEN n_images > 0 THEN mean_image_space_pp END AS mean_image_space_pp, CASE WHEN n_images > 0 THEN max_image_page_ratio END AS max_image_page_ratio, CASE WHEN tn > 0 THEN mean_textbox_space_pp END AS mean_textbox_space_pp, CASE WHEN bn > 0 THEN mean_blockstyle_space_pp END AS mean_blockstyle_space_pp) FROM w)
  SELECT CAST(d AS VARCHAR) AS doc_id, {ROUNDED} FROM x""")
def feature_table(spark, sf_dir):
    """The 41 numeric features of documents made of orders; a document with too many tiny images on a page stops there."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("string(l_orderkey div 64) AS doc", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")

    def rounded(own):
        return features.assemble(feature_elements(own), mark_image_error=True).select("doc_id", *(F.round(c, 6).alias(c) for c in features.NUMERIC_41))

    return features.in_slices(lines, "doc", max(1, -(-lines.count() // SLICE_ROWS)), rounded)
