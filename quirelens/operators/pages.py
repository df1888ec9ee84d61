"""Page and document statistics over flat element tables (one row per run, rectangle, font or image)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.functions import geometry as G

RECT = ("left", "top", "right", "bot")


def distinct_rects(elements: DataFrame) -> DataFrame:
    """Rectangles of size above 1, each once per page, at its first place in element order."""
    kept = elements.where(G.area(*(F.col(c) for c in RECT)) > 1)
    return kept.groupBy("doc_id", "page_no", *RECT).agg(F.min("seq").alias("seq"))


def earlier_overlaps(rects: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, overlap): summed overlap of each rectangle with the earlier ones of its page (or with all of ``others``).

    The page is an equi key; only the order of the two is a residual condition. Pages are bounded by what fits on one.
    """
    key = ["doc_id", "page_no"]
    a = rects.select(*key, "seq", *(F.col(c).alias(f"a{c}") for c in RECT))
    b = (rects if others is None else others).select(*key, F.col("seq").alias("seq_b"), *(F.col(c).alias(f"b{c}") for c in RECT))
    pairs = a.join(b, key)
    if others is None:
        pairs = pairs.where("seq > seq_b")
    return pairs.groupBy(*key).agg(F.coalesce(F.sum(G.overlap("a", "b")), F.lit(0)).alias("overlap"))


def image_space(elements: DataFrame) -> DataFrame:
    """(doc_id, page_no, images, space): kept images of a page and the area they add, overlaps with earlier ones taken off."""
    rects = distinct_rects(elements)
    own = rects.groupBy("doc_id", "page_no").agg(F.count(F.lit(1)).alias("images"), F.sum(G.area(*(F.col(c) for c in RECT))).alias("area"))
    return own.join(earlier_overlaps(rects), ["doc_id", "page_no"], "left").select("doc_id", "page_no", "images", (F.col("area") - F.coalesce("overlap", F.lit(0))).alias("space"))


def stop_after_tiny_images(elements: DataFrame, most: int = 50, below: int = 50) -> DataFrame:
    """Elements of a page before the image that is the 51st of one identical size below 50 square pixels."""
    size = F.col("width") * F.col("height")
    tiny = (F.col("kind") == "image") & (size < below)
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no", "kind", size).orderBy("elem_seq"))
    marked = elements.withColumn("_stop", F.when(tiny & (nth > most), F.col("elem_seq")))
    first = F.min("_stop").over(Window.partitionBy("doc_id", "page_no"))
    return marked.withColumn("_first", first).where("_first IS NULL OR elem_seq < _first").drop("_stop", "_first")


def marked_tiny_images(elements: DataFrame, most: int = 50, below: int = 50) -> DataFrame:
    """All elements with ``kept`` (it stands before the image that is the 51st of one size below 50 on its page, clipped, in square pixels),
    ``page_done`` (false for all of the page on which a document stops) and ``stopped`` (its document stops somewhere).

    The page's own row stays; what comes after the stop, on all later pages too and in outlines, goes. Documents without such a page are whole.
    """
    box = G.clip(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height"))
    size = F.abs((box["right"] - box["left"]) * (box["bot"] - box["top"]))
    tiny = elements.where("kind = 'image'").select("doc_id", "page_no", "elem_seq", size.alias("size")).where(F.col("size") < below)
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_no", "size").orderBy("elem_seq"))
    stops = tiny.withColumn("nth", nth).where(F.col("nth") > most).groupBy("doc_id").agg(F.min(F.struct("page_no", "elem_seq")).alias("stop"))
    ahead = (F.col("page_no") < F.col("stop.page_no")) | ((F.col("page_no") == F.col("stop.page_no")) & ((F.col("elem_seq") < F.col("stop.elem_seq")) | (F.col("kind") == "page")))
    marks = {"kept": F.col("stop").isNull() | F.coalesce(ahead, F.lit(False)), "page_done": F.col("stop").isNull() | (F.col("page_no") < F.col("stop.page_no")), "stopped": F.col("stop").isNotNull()}
    return elements.join(stops.hint("shuffle_hash"), "doc_id", "left").withColumns(marks).drop("stop")  # one row per document at most, elements need no sort


def until_tiny_images(elements: DataFrame, most: int = 50, below: int = 50) -> DataFrame:
    """Elements of each document before it stops, see :func:`marked_tiny_images`."""
    return marked_tiny_images(elements, most, below).where("kept").drop("kept")


def covered_rects(rects: DataFrame) -> DataFrame:
    """``rects`` with ``overlap``: what earlier ones of the page cover of each. One join by the page, so that pages stay where they are."""
    key = ["doc_id", "page_no"]
    a = rects.select(*key, "seq", *(F.col(c).alias(f"a{c}") for c in RECT)).alias("a")
    b = rects.select(*(F.col(c).alias(f"b_{c}") for c in key), F.col("seq").alias("seq_b"), *(F.col(c).alias(f"b{c}") for c in RECT)).alias("b")
    pairs = a.join(b, (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page_no") == F.col("b_page_no")) & (F.col("seq") > F.col("seq_b")), "left")
    return pairs.groupBy(*key, "seq", *(F.col(f"a{c}").alias(c) for c in RECT)).agg(F.coalesce(F.sum(F.when(F.col("seq_b").isNotNull(), G.overlap("a", "b"))), F.lit(0)).alias("overlap"))


def page_space(sheets: DataFrame, images: DataFrame, boxes: DataFrame, parts: int | None = None) -> DataFrame:
    """What covers each page of ``sheets`` (doc_id, page_no, page_width, page_height), one row a page.

    images: rectangles (RECT, seq). boxes: left, top, right, bot, kind (text or block), box_id. Images are kept once each and add
    what earlier ones do not cover, at least nothing. Boxes are clipped to the page and kept once each, text boxes before blocks.
    Three sums of overlaps stay apart: images with earlier images, boxes with images, boxes with earlier boxes;
    free_space is the page without images and boxes, the overlaps of the latter two kinds given back.
    ``parts``: partitions that pages are dealt into once, all joins and sums go on in them; Spark's own number if not given.
    """
    key = ["doc_id", "page_no"]
    if parts is not None:
        sheets, images, boxes = (df.repartition(parts, *key) for df in (sheets, images, boxes))
    area = G.area(*(F.col(c) for c in RECT))
    kept = distinct_rects(images)
    covered = covered_rects(kept)
    by_image = covered.groupBy(*key).agg(F.count(F.lit(1)).alias("images"), F.sum(F.greatest(area - F.col("overlap"), F.lit(0))).alias("image_space"), F.sum("overlap").alias("image_image"))
    own = boxes.join(sheets.select(*key, "page_width", "page_height"), key)
    clipped = {"left": F.least(F.greatest("left", F.lit(0)), "page_width"), "top": F.least(F.greatest("top", F.lit(0)), "page_height"), "right": F.least("right", "page_width"), "bot": F.least("bot", "page_height")}
    own = own.select(*key, "kind", "box_id", *(v.alias(c) for c, v in clipped.items())).where("(right - left) * (bot - top) > 0")
    rects = own.groupBy(*key, *RECT).agg(F.min(F.struct((F.col("kind") == "block").alias("block"), "box_id")).alias("seq"))
    by_box = rects.groupBy(*key).agg(F.sum(F.when(~F.col("seq.block"), area).otherwise(0)).alias("textbox_space"), F.sum(F.when(F.col("seq.block"), area).otherwise(0)).alias("blockstyle_space"))
    for name, others in (("box_image", kept), ("box_box", None)):
        by_box = by_box.join(earlier_overlaps(rects, others).withColumnRenamed("overlap", name), key, "left")
    sums = ["images", "image_space", "image_image", "textbox_space", "blockstyle_space", "box_image", "box_box"]
    page = F.col("page_width").cast("long") * F.col("page_height")
    out = sheets.select(*key, page.alias("space")).join(by_image, key, "left").join(by_box, key, "left").select(*key, "space", *(F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in sums))
    return out.withColumn("free_space", F.expr("space - image_space - textbox_space - blockstyle_space + box_image + box_box"))


def modal(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Most frequent value per key (of equal counts the first seen) and its share of the rows."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("k"), F.min(order).alias("first"))
    best = F.max_by(value, F.struct(F.col("k"), -F.col("first")))
    return counts.groupBy(*keys).agg(best.alias(out), (F.max("k") / F.sum("k")).alias(f"share_{out}"))


def margins(runs: DataFrame) -> DataFrame:
    """Modal left and right edge per document with shares, and the extremes."""
    ends = runs.groupBy("doc_id").agg(F.max("right").alias("max_right"), F.max("left").alias("max_left"), F.min("left").alias("min_left"))
    return modal(runs, ["doc_id"], "left", "seq", "modal_left").join(modal(runs, ["doc_id"], "right", "seq", "modal_right"), "doc_id").join(ends, "doc_id")


def fonts(specs: DataFrame) -> DataFrame:
    """Per document: fonts, distinct colours and families, largest size, smallest positive size."""
    return specs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count_fonts"), F.countDistinct("color").alias("count_font_colors"), F.countDistinct("family").alias("count_font_families"), F.max("size").alias("max_font_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("min_font_size"))


def main_font(runs: DataFrame) -> DataFrame:
    """Size of the font with the most words (the first of equal ones) and its share of the words. runs: doc_id, font, size, words."""
    per = runs.groupBy("doc_id", "font").agg(F.sum("words").alias("w"), F.max("size").alias("size"))
    return per.groupBy("doc_id").agg(F.max_by("size", F.struct("w", -F.col("font"))).alias("main_font_size"), (F.max("w") / F.sum("w")).alias("perc_main_font_word"))


def run_gaps(runs: DataFrame) -> DataFrame:
    """Horizontal gap of each run to the one before on the same top."""
    w = Window.partitionBy("doc_id", "page_no", "top").orderBy("left", "seq", "right")
    return runs.withColumn("gap", F.col("left") - F.lag("right").over(w))


def merged_runs(runs: DataFrame, most: int = 10) -> DataFrame:
    """Runs of one top joined while the gap is below ``most`` and one side is formatted or the left edge is rare on the page (W03)."""
    w = Window.partitionBy("doc_id", "page_no", "top").orderBy("left", "seq", "right")
    rare = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page_no", "left")) <= 2
    gap = F.col("left") - F.lag("right").over(w)
    joins = (gap < most) & (rare | (F.col("fmt") > 0) | (F.lag("fmt").over(w) > 0))
    marked = runs.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "page_no", "top", F.col("_line").cast("int").alias("line")).agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count(F.lit(1)).alias("runs"))


def line_gaps(runs: DataFrame) -> DataFrame:
    """Most common vertical gap per page between consecutive tops, each by its first run, same font only (A20)."""
    heads = runs.groupBy("doc_id", "page_no", "top").agg(F.min(F.struct("left", "seq", "height", "font")).alias("h"))
    w = Window.partitionBy("doc_id", "page_no").orderBy("top")
    gaps = heads.select("doc_id", "page_no", "top", (F.col("top") - F.lag(F.col("top") + F.col("h.height")).over(w)).alias("gap"), F.lag("h.font").over(w).alias("above"), F.col("h.font").alias("font")).where("gap > 0 AND font = above")
    return modal(gaps, ["doc_id", "page_no"], "gap", "top", "norm_gap")


def columns_of(boxes: Column) -> Column:
    """Greedy number of columns from an array of (left, right): the smallest right edge per left edge, then a chain of boxes that start at or right of the current edge, the smallest right edge first. A page with a box has one at least."""
    least = F.map_from_entries(F.transform(F.array_distinct(F.transform(boxes, lambda b: b["left"])), lambda x: F.struct(x, F.array_min(F.transform(F.filter(boxes, lambda b: b["left"] == x), lambda b: b["right"])))))
    ends = F.array_sort(F.transform(F.map_entries(least), lambda e: F.struct(e["value"].alias("right"), e["key"].alias("left"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-(10**9)).cast("bigint").alias("at"))
    chained = F.aggregate(ends, start, lambda a, b: F.when(b["left"] >= a["at"], F.struct((a["n"] + 1).alias("n"), b["right"].cast("bigint").alias("at"))).otherwise(a))
    return F.greatest(chained["n"], F.lit(1)).cast("int")


def columns_mode(boxes: DataFrame) -> DataFrame:
    """Per document: the most frequent number of columns of its pages (the smallest of equal ones) and its share. boxes: doc_id, page_no, left, right."""
    pages = boxes.groupBy("doc_id", "page_no").agg(columns_of(F.collect_list(F.struct("left", "right"))).alias("cols"))
    counts = pages.groupBy("doc_id", "cols").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("doc_id").agg(F.max_by("cols", F.struct(F.col("k"), -F.col("cols"))).alias("modal_columns"), (F.max("k") / F.sum("k")).alias("perc_modal_columns"))


def page_text(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """(doc_id, page_no, lines, words): stretches of lines as pages, blank lines not counted as lines."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))
    n = F.size(F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return lines.select("doc_id", F.floor(F.col("i") / lines_per_page).cast("int").alias("page_no"), n.alias("n")).groupBy("doc_id", "page_no").agg(F.sum((F.col("n") > 0).cast("int")).alias("lines"), F.sum("n").alias("words"))


def document_means(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("count_pages"), F.avg("words").alias("mean_words_pp"), F.avg("lines").alias("mean_lines_pp"), (F.sum("words") / F.sum("lines")).alias("mean_words_per_line"))
