"""The feature table: one wide row per document from its elements, lines, boxes and properties.

Words, lines and margins are counted over the merged lines of pages. A feature whose guard fails (no fonts, no text, no image, no
box) is 0. Rows without doc_id make no document.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.functions import geometry as G
from quirelens.functions import text as T
from quirelens.operators import layout, pages
from quirelens.runtime import parts_for, scratch, stored

#: The numeric columns in vector order (fixed values).
NUMERIC_41 = (
    "file_size page_rot count_pages count_outline_items page_size_x page_size_y count_fonts count_font_colors count_font_families "
    "max_font_size min_font_size main_font_size perc_main_font_word copyright_symbol mean_words_pp mean_lines_pp mean_words_per_line "
    "mean_bold_words_pp mean_annotations_pp image_error mean_image_space_pp mean_images_pp max_image_page_ratio mean_free_space_pp "
    "mean_textboxes_pp mean_lines_per_textbox mean_blockstyles_pp mean_lines_per_blockstyle modal_textbox_columns_pp "
    "perc_modal_textbox_columns_pp modal_blockstyle_columns_pp perc_modal_blockstyle_columns_pp mean_textbox_space_pp "
    "mean_blockstyle_space_pp modal_right perc_modal_right modal_left perc_modal_left max_right max_left min_left"
).split()
KEY = ["doc_id", "page_no"]


def page_rects(elements: DataFrame) -> DataFrame:
    """Images clipped to their pages, as rectangles in element order."""
    box = G.clip(F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.col("page_width"), F.col("page_height"))
    return elements.where("kind = 'image'").select(*KEY, F.col("elem_seq").alias("seq"), *(v.alias(f"r_{k}") for k, v in box.items())).select(*KEY, "seq", *(F.col(f"r_{k}").alias(k) for k in box))


def document_texts(runs: DataFrame, lines: DataFrame, doubled: bool = False, parts: int | None = None) -> DataFrame:
    """(doc_id, text): the runs of each document in order; ``doubled`` puts the merged lines of a page behind its runs, page by page.

    runs: doc_id, page_no, elem_seq, text. lines: doc_id, page_no, seq, text (seq in element order). Empty runs say nothing.
    ``parts``: partitions of the work, Spark's own number if not given.
    """
    said = runs.where("text <> ''").select(*KEY, F.lit(0).alias("part"), F.col("elem_seq").alias("at"), "text")
    if doubled:
        said = said.unionByName(lines.select(*KEY, F.lit(1).alias("part"), F.col("seq").alias("at"), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "part", "at", "text")))
    said = said if parts is None else said.repartition(parts, "doc_id")
    return said.groupBy("doc_id").agg(ordered.alias("r")).select("doc_id", F.array_join("r.text", " ").alias("text"))


def box_counts(boxes: DataFrame, sheets: DataFrame, kind: str) -> DataFrame:
    """Per page: boxes of a kind that the page shows, their lines, and its columns (boxes of two lines or more that end on the page)."""
    own = boxes.where(F.col("kind") == kind).join(sheets.select(*KEY, "page_width", "page_height"), KEY)
    wide = F.least("right", "page_width") - F.least(F.greatest("left", F.lit(0)), "page_width")
    high = F.least("bot", "page_height") - F.least(F.greatest("top", F.lit(0)), "page_height")
    own = own.where(wide * high > 0)
    spread = F.collect_list(F.when((F.col("n_lines") >= 2) & (F.col("right") < F.col("page_width")), F.struct("left", "right")))
    return own.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.sum("n_lines").alias("lines"), pages.columns_of(spread).alias("cols"))


def assemble(elements: DataFrame, boxes: DataFrame | None = None, properties: DataFrame | None = None, lines: DataFrame | None = None, doubled: bool = False, mark_image_error: bool = False) -> DataFrame:
    """doc_id, NUMERIC_41, text, first_100_words, last_100_words, bold_text, producer, creator.

    ``lines`` and ``boxes`` as :func:`layout.laid_out` gives them (made here if not given). A document stops at its 51st tiny image of one
    size on a page: what was read before counts, the page itself only as a page, and its runs as text; ``mark_image_error`` sets
    image_error then (else it is 0). ``doubled`` takes the text twice, as runs and as lines.
    """
    marked = stored(pages.marked_tiny_images(elements))  # read by many steps, as lines, boxes and pages are
    docs = marked.select("doc_id").distinct()
    kept = marked.where("kept")
    done = kept.where("page_done")
    if boxes is None or lines is None:
        lines, boxes = layout.laid_out(done)
    whole = done.where("kind = 'page'").select(*KEY).distinct()
    lines, boxes = (stored(df.join(whole, KEY, "left_semi")) for df in (lines, boxes.drop("text")))
    parts = parts_for(kept)
    sheets = done.where("kind = 'page'").select(*KEY, "page_width", "page_height")
    runs = kept.where("kind = 'text' AND text <> ''").withColumn("words", T.word_count(F.col("text")))
    space = pages.page_space(sheets, page_rects(done), boxes, parts)
    dealt = lambda df: df.repartition(parts, *KEY)  # as page_space deals its pages
    worded = dealt(lines).withColumn("words", T.word_count(F.col("text")))
    page = space.join(worded.groupBy(*KEY).agg(F.count(F.lit(1)).alias("line_count"), F.sum("words").alias("words")), KEY, "left")
    kinds = {"textbox": "text", "blockstyle": "block"}
    for name, kind in kinds.items():
        page = page.join(box_counts(dealt(boxes), dealt(sheets), kind).select(*KEY, *(F.col(c).alias(f"{name}_{c}") for c in ("n", "lines", "cols"))), KEY, "left")
    page = stored(page.fillna(0))
    total = F.when(F.sum("space") == 0, 0.01).otherwise(F.sum("space"))

    def modal(name: str) -> list:
        cols = F.col(f"{name}_cols")
        return [F.mode(cols, deterministic=True).cast("double").alias(f"modal_{name}_columns_pp"), F.collect_list(cols).alias(f"{name}_all")]

    per_doc = page.groupBy("doc_id").agg(
        F.avg("words").alias("mean_words_pp"),
        F.avg("line_count").alias("mean_lines_pp"),
        F.try_divide(F.sum("words"), F.sum("line_count")).alias("mean_words_per_line"),
        (F.sum("image_space") / total).alias("mean_image_space_pp"),
        F.max(F.try_divide("image_space", "space")).alias("max_image_page_ratio"),
        (F.sum("free_space") / total).alias("mean_free_space_pp"),
        *(x for k in kinds for x in (F.sum(f"{k}_n").alias(f"{k}_total"), F.try_divide(F.sum(f"{k}_lines"), F.sum(f"{k}_n")).alias(f"mean_lines_per_{k}"), F.avg(f"{k}_space").alias(f"mean_{k}_space_pp"), *modal(k))),
    )
    own_images = pages.distinct_rects(page_rects(kept)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_images"))
    counts = kept.groupBy("doc_id").agg(
        F.sum((F.col("kind") == "page").cast("int")).alias("count_pages"), F.sum(F.col("kind").isin("outline", "item").cast("int")).alias("count_outline_items"), F.max("error_code").alias("error_code"),
        F.max(F.col("stopped").cast("int")).alias("stopped"), F.sum(F.when(F.col("kind") == "text", F.col("n_bold_words"))).alias("bold"), F.sum(F.when(F.col("kind") == "text", F.col("n_links"))).alias("links"),
    )
    specs = kept.where("kind = 'fontspec'")
    sized = runs.join(specs.groupBy("doc_id", "font").agg(F.max("size").alias("spec_size")), ["doc_id", "font"], "left").select("doc_id", "font", F.col("spec_size").alias("size"), "words")
    edges = pages.margins(lines.withColumn("seq", F.shiftleft(F.col("page_no").cast("long"), 32) + F.col("seq"))).withColumnsRenamed({"share_modal_left": "perc_modal_left", "share_modal_right": "perc_modal_right"})
    bold = runs.where("bold_text <> ''").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_no", "elem_seq", "bold_text")))["bold_text"], " ").alias("bold_text"))
    out = docs
    for part in (counts, per_doc, own_images, pages.fonts(specs), pages.main_font(sized), edges, document_texts(runs, lines, doubled, parts), bold):
        out = out.join(part, "doc_id", "left")
    n, said = F.col("count_pages"), F.col("text").isNotNull()
    out = out.withColumns(
        {"copyright_symbol": T.copyright_evidence(F.col("text")), "image_error": F.col("stopped") if mark_image_error else F.lit(0), "mean_images_pp": F.try_divide("n_images", n)}
        | {c: F.when(F.col("n_images") > 0, F.col(c)) for c in ("mean_image_space_pp", "max_image_page_ratio")}
        | {c: F.when(said, F.try_divide(v, n)) for c, v in (("mean_bold_words_pp", "bold"), ("mean_annotations_pp", "links"))}
        | {c: F.when(said, F.col(c)) for c in ("mean_words_pp", "mean_lines_pp")}
    )
    plural = {"textbox": "textboxes", "blockstyle": "blockstyles"}
    for k in kinds:
        has = F.col(f"{k}_total") > 0
        share = F.size(F.filter(f"{k}_all", (lambda c: lambda x: x == F.col(c))(f"modal_{k}_columns_pp"))) / n
        out = out.withColumn(f"perc_modal_{k}_columns_pp", F.when(has, share)).withColumns({f"modal_{k}_columns_pp": F.when(has, F.col(f"modal_{k}_columns_pp")), f"mean_{k}_space_pp": F.when(has, F.col(f"mean_{k}_space_pp")), f"mean_{plural[k]}_pp": F.try_divide(F.col(f"{k}_total"), n)})
    own = {"file_size": -1.0, "page_rot": -1.0, "page_size_x": -1.0, "page_size_y": -1.0}
    if properties is not None:
        out = out.join(properties, "doc_id", "left").fillna({**own, "producer": "empty", "creator": "empty"})
    else:
        out = out.withColumns({k: F.lit(v) for k, v in own.items()} | {"producer": F.lit("empty"), "creator": F.lit("empty")})
    text = F.coalesce("error_code", "text", F.lit("empty"))
    bad = F.col("error_code").isNotNull()
    number = lambda c: F.when(bad & ~F.lit(c in own), 0.0).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return out.select(
        "doc_id", *(number(c).alias(c) for c in NUMERIC_41), text.alias("text"),
        *(F.when(bad | ~said, text).otherwise(f).alias(name) for name, f in (("first_100_words", T.first_words(F.col("text"))), ("last_100_words", T.last_words(F.col("text"))), ("bold_text", F.coalesce("bold_text", F.lit(""))))),
        "producer", "creator",
    )


def in_slices(rows: DataFrame, key: str, n: int, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` of all ``rows``, in ``n`` slices by a hash of ``key``, one after another, for steps that judge each key's rows by themselves.

    What a step writes meanwhile is deleted before the next one begins, so the disk that is needed follows a slice and not the table.
    """
    at = F.pmod(F.xxhash64(key), F.lit(n))
    parts = []
    for k in range(n):
        with scratch(rows.sparkSession):
            parts.append(stored(step(rows.where(at == k) if n > 1 else rows), keep=True))
    return functools.reduce(DataFrame.unionByName, parts)


def vector(features: DataFrame) -> DataFrame:
    """Add ``numeric``: the 41 columns as one vector."""
    return VectorAssembler(inputCols=list(NUMERIC_41), outputCol="numeric", handleInvalid="keep").transform(features)
