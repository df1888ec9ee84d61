"""Page layout: lines, normal gap, blocks and text boxes.

Lines, joins of lines and gaps are windows and joins over the runs of a page. Only two steps run in Python: whether a run's height
is odd for its font depends on all earlier runs of the font in its document, so sorted runs are streamed (and numbered) with that state; and
blocks depend on the blocks before, so each page's sorted lines are streamed into its boxes (a page is bounded by what fits on one).

Runs without a document, page or place are left out; a null text is empty, a null font is -1, a null format 0. Of runs with equal
elem_seq the order is by place and text. Documents without runs give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quirelens.operators import pages
from quirelens.runtime import parts_for, stored

BOXES = "doc_id string, page_no int, box_id int, kind string, left int, top int, right int, bot int, n_lines int, text string"
#: Distances in pixels (fixed values).
NEAR_RUN, GAP_SLACK, EDGE_SLACK, SIDE_SLACK, INDENT = 10, 1, 5, 1, (10, 25)
#: A line whose top is above the bottom of the one before follows it if that is less than OVERLAP_PERCENT of the height.
SAME_SIDE, OVERLAP_PERCENT, RARE_EDGE = 2, 15, 2
PAGE = ["doc_id", "page_no"]
#: Tops below a line that are looked at in place for the line that follows it.
STEPS = 4


@dataclass(slots=True)
class Line:
    top: int
    left: int
    right: int
    bot: int
    text: str


def both_formats(a: Column, b: Column) -> Column:
    """Format of two joined runs: the one that there is, 4 if they differ."""
    return F.when((a == b) | (b == 0), a).when(a == 0, b).otherwise(4)


# ---------------------------------------------------------------- lines


RUN_ORDER = ("doc_id", "page_no", "elem_seq", "top", "left", "right", "text")


def _same_as_before(*columns: pa.Array) -> np.ndarray:
    """Whether each row but the first has the values of the row before it."""
    same = np.ones(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        same &= pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return same


def odd_heights(runs: DataFrame, parts: int) -> DataFrame:
    """``runs`` without elem_seq, with ``seq`` (place on the page), ``before`` (runs with text before it there) and ``odd``: another height is the
    usual one of the run's font so far in its document, and its page has a line already.

    Runs are dealt by document and streamed in order; what is kept is how often each height of the document's fonts was seen. Rows of a
    font that all have its usual height need no look one by one.
    """
    names = [c for c in runs.columns if c != "elem_seq"]
    ordered = runs.repartition(parts, "doc_id").sortWithinPartitions(*RUN_ORDER)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fonts, place, said_so_far = None, {}, 0, 0  # the last row's document and page, its fonts: [times a height was seen, usual height]
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            docs, page, font, height = (batch.column(c) for c in ("doc_id", "page_no", "font", "height"))
            new_doc, new_page = np.ones(n, bool), np.ones(n, bool)
            new_doc[1:], new_page[1:] = ~_same_as_before(docs), ~_same_as_before(docs, page)
            first = (docs[0].as_py(), page[0].as_py())
            new_doc[0], new_page[0] = last is None or first[0] != last[0], first != last
            said = pc.not_equal(batch.column("text"), "").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.flatnonzero(new_page)
            page_of = np.cumsum(new_page)  # 0: the page goes on from the batch before
            seq = np.arange(1, n + 1) - np.concatenate([[-place], starts])[page_of]
            total = np.cumsum(said) - said
            before = total - np.concatenate([[-said_so_far], total[starts]])[page_of]
            font, height, doc_of = font.to_numpy(), height.to_numpy(), np.cumsum(new_doc)
            odd = np.zeros(n, bool)
            order = np.lexsort((font, doc_of))
            groups = np.flatnonzero(np.concatenate([[True], (np.diff(doc_of[order]) != 0) | (np.diff(font[order]) != 0)]))
            low, high = np.minimum.reduceat(height[order], groups), np.maximum.reduceat(height[order], groups)
            now = 0
            for at, end, lo, hi in zip(groups.tolist(), [*groups[1:].tolist(), n], low.tolist(), high.tolist(), strict=True):
                doc = int(doc_of[order[at]])
                if doc != now:
                    now, fonts = doc, {}
                seen, usual = fonts.get(int(font[order[at]]), ({}, None))
                if lo == hi and usual in (None, lo):
                    seen[lo] = seen.get(lo, 0) + end - at
                    usual = lo
                else:
                    for k in order[at:end].tolist():
                        h = int(height[k])
                        seen[h] = seen.get(h, 0) + 1
                        if h != usual:
                            usual = max(seen, key=seen.get)  # of equal ones the first seen
                            if h != usual and before[k] > 0:
                                odd[k] = True
                            else:
                                seen[h] = 1
                fonts[int(font[order[at]])] = (seen, usual)
            last, place, said_so_far = (docs[n - 1].as_py(), page[n - 1].as_py()), int(seq[-1]), int(before[-1] + said[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq, pa.int32()), pa.array(before, pa.int64()), pa.array(odd, pa.bool_())], names=[*names, "seq", "before", "odd"])

    schema = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in names)
    return ordered.mapInArrow(stream, f"{schema}, seq int, before long, odd boolean")


def lines(elements: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, page_no, seq, top, left, right, height, font, text, fmt): text runs as lines (W04).

    Runs of odd height close behind a line lengthen it, one after another, up to the next run with text, which is a line
    of its own besides. ``parts``: partitions of the work (by the number of elements if not given); lines are dealt by page.
    """
    parts = parts_for(elements) if parts is None else parts
    given = elements.where("kind = 'text' AND doc_id IS NOT NULL").dropna(subset=["page_no", "top", "left", "width", "height"])
    runs = given.select("doc_id", "page_no", "elem_seq", "top", "left", (F.col("left") + F.col("width")).alias("right"), "height", F.coalesce("font", F.lit(-1)).alias("font"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("fmt", F.lit(0)).alias("fmt"))
    runs = stored(odd_heights(runs, parts))
    dealt = runs.repartition(parts, *PAGE)
    # a run with text begins a line; those of odd height behind it, up to the next with text, follow it on the page and go to it
    more = F.lit(None).cast("array<struct<left:int,right:int,text:string,fmt:int>>")
    if runs.where("odd").take(1):
        behind = Window.partitionBy(*PAGE, "before").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        dealt = dealt.withColumn("odds", F.collect_list(F.when(F.col("odd"), F.struct("left", "right", "text", "fmt"))).over(behind))
        more = F.lead("odds").over(Window.partitionBy(*PAGE).orderBy("before", "seq"))
    own = dealt.withColumn("more", more).where("text <> ''")
    start = F.struct("right", "text", "fmt")

    def lengthened(line: Column, run: Column) -> Column:
        gap = run["left"] - line["right"]
        joined = F.struct(run["right"].alias("right"), F.concat_ws(" ", line["text"], run["text"]).alias("text"), both_formats(line["fmt"], run["fmt"]).alias("fmt"))
        return F.when((gap >= 0) & (gap < NEAR_RUN), joined).otherwise(line)

    whole = F.when(F.coalesce(F.size("more"), F.lit(0)) <= 0, start).otherwise(F.aggregate("more", start, lengthened))
    return own.withColumn("w", whole).select(*PAGE, "seq", "top", "left", F.col("w.right").alias("right"), "height", "font", F.col("w.text").alias("text"), F.col("w.fmt").alias("fmt"))


def joined_lines(single: DataFrame) -> DataFrame:
    """Lines of one top joined with close right neighbours where one is formatted or the right one's left edge is rare (W03).

    The first top of a page joins nothing. Joins of a top are decided on its lines as they came; each join lowers the count of
    the left edge that it takes away for the tops below. That needs no state: formatted neighbours join anyway, and an
    edge that they have made rare stays rare.
    """
    across = Window.partitionBy(*PAGE, "top").orderBy("left", "seq")
    close = (F.col("left") - F.lag("right").over(across) < NEAR_RUN) & (F.col("top") > F.min("top").over(Window.partitionBy(*PAGE)))
    marked = single.withColumns({"close": F.coalesce(close, F.lit(False)), "styled": (F.col("fmt") > 0) | (F.coalesce(F.lag("fmt").over(across), F.lit(0)) > 0)})
    above = Window.partitionBy(*PAGE, "left").orderBy("top").rangeBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum((F.col("close") & F.col("styled")).cast("int")).over(above), F.lit(0))
    same_edge = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "left"))
    marked = marked.withColumn("joins", F.col("close") & (F.col("styled") | (same_edge - taken <= RARE_EDGE)))
    marked = marked.withColumn("island", F.sum((~F.col("joins")).cast("int")).over(across.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("left", "seq", "right", "height", "font", "text", "fmt"))).alias("p")
    islands = marked.groupBy(*PAGE, "top", "island").agg(parts)
    first, last = F.col("p")[0], F.element_at("p", -1)
    fmt = F.aggregate(F.reverse(F.slice("p", 1, F.size("p") - 1)), last["fmt"], lambda right, run: both_formats(run["fmt"], right))
    return islands.select(*PAGE, first["seq"].alias("seq"), "top", first["left"].alias("left"), last["right"].alias("right"), first["height"].alias("height"), first["font"].alias("font"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), fmt.alias("fmt"))


# ---------------------------------------------------------------- gaps


def heads(rows: DataFrame, name: str) -> DataFrame:
    """The first line of each top, in element order."""
    return rows.groupBy(*PAGE, "top").agg(F.min(F.struct("seq", "left", "right", "height", "font")).alias(name))


def follows(a: Column, a_top: Column, b: Column, b_top: Column) -> Column:
    """Whether line b may follow line a: below it, or barely overlapping it with a side in common or one inside the other."""
    gap = b_top - a_top - a["height"]
    beside = (F.abs(a["left"] - b["left"]) <= SAME_SIDE) | (F.abs(a["right"] - b["right"]) <= SAME_SIDE) | ((a["left"] <= b["left"]) & (b["right"] <= a["right"])) | ((b["left"] <= a["left"]) & (a["right"] <= b["right"]))
    return (gap > 0) | ((a["height"] > 0) & (F.abs(gap) * 100 < OVERLAP_PERCENT * a["height"]) & beside)


def successors(single: DataFrame, joined: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, page_no, top, gap, same_font): for the first line of each top, the next line that may follow it, where there is one (W02).

    The top right below is taken after its joins; where its line cannot follow, the search goes on over the tops below as they
    came, and takes the first that can. The next STEPS tops are looked at in place; lines that find none among them and have more
    tops below meet all of these.
    """
    down = Window.partitionBy(*PAGE).orderBy("top")
    if single is joined:
        levels = heads(joined, "a").withColumn("c", F.col("a"))
    else:  # both have the same tops
        head = F.struct("seq", "left", "right", "height", "font")
        none = F.lit(None).cast(joined.select(head).schema[0].dataType)
        both = single.select(*PAGE, "top", none.alias("a"), head.alias("c")).unionByName(joined.select(*PAGE, "top", head.alias("a"), none.alias("c")))
        both = both if parts is None else both.repartition(parts, *PAGE)
        levels = both.groupBy(*PAGE, "top").agg(F.min("a").alias("a"), F.min("c").alias("c"))
    told = {"b1": F.lead("a").over(down)} | {f"b{k}": F.lead("c", k).over(down) for k in range(2, STEPS + 1)} | {f"t{k}": F.lead("top", k).over(down) for k in range(1, STEPS + 2)}
    steps = levels.withColumns(told).where("t1 IS NOT NULL")
    found = F.coalesce(*(F.when(F.coalesce(follows(F.col("a"), F.col("top"), F.col(f"b{k}"), F.col(f"t{k}")), F.lit(False)), F.struct(F.col(f"t{k}").alias("top"), F.col(f"b{k}.font").alias("font"))) for k in range(1, STEPS + 1)))
    steps = steps.select(*PAGE, "top", "a", found.alias("b"), (F.col(f"t{STEPS}")).alias("looked"), F.col(f"t{STEPS + 1}").isNotNull().alias("more")).where("b IS NOT NULL OR more")
    steps = stored(steps)
    near, open_ = steps.where("b IS NOT NULL").drop("looked", "more"), steps.where("b IS NULL").drop("b", "more")
    if open_.take(1):
        far = open_.join(heads(single, "c").withColumnRenamed("top", "c_top"), PAGE).where((F.col("c_top") > F.col("looked")) & follows(F.col("a"), F.col("top"), F.col("c"), F.col("c_top")))
        near = near.unionByName(far.groupBy(*PAGE, "top").agg(F.first("a").alias("a"), F.min(F.struct(F.col("c_top").alias("top"), F.col("c.font").alias("font"))).alias("b")))
    return near.select(*PAGE, "top", (F.col("b.top") - F.col("top") - F.col("a.height")).alias("gap"), (F.col("a.font") == F.col("b.font")).alias("same_font"))


def normal_gaps(single: DataFrame, joined: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, page_no, norm): the most common gap between lines of one font (of equal ones the first seen); pages without any are left out (A20)."""
    return pages.modal(successors(single, joined, parts).where("same_font"), PAGE, "gap", "top", "norm").select(*PAGE, "norm")


# ---------------------------------------------------------------- blocks of a page


@dataclass
class Block:
    lines: list[Line] = field(default_factory=list)
    right: int = 0

    @property
    def left(self) -> int:
        return self.lines[0].left

    @property
    def top(self) -> int:
        return self.lines[0].top

    @property
    def bot(self) -> int:
        return self.lines[-1].bot


def build_blocks(lines: list[Line], norm: int) -> list[Block]:
    """Each line goes to the first block that it continues: one of its left edge that ends a normal gap above it (looked up by both)."""
    blocks: list[Block] = []
    ends: dict[tuple[int, int], list[int]] = {}  # left edge and bottom -> numbers of the blocks
    for x in lines:
        fits = [n for bot in range(x.top - norm - GAP_SLACK, x.top - norm + GAP_SLACK + 1) for n in ends.get((x.left, bot), ()) if abs(blocks[n].right - x.right) <= EDGE_SLACK]
        if fits:
            n = min(fits)
            ends[x.left, blocks[n].bot].remove(n)
            blocks[n].lines.append(x)
        else:
            n = len(blocks)
            blocks.append(Block([x], x.right))
        ends.setdefault((x.left, x.bot), []).append(n)
    return blocks


def repair(blocks: list[Block], norm: int) -> list[Block]:
    """Single lines directly below or, indented, directly above a block of three lines or more become part of it."""
    live: list[Block | None] = list(blocks)
    k = len(live) - 1
    while k >= 0:
        b = live[k]
        if b is not None and len(b.lines) > 2:
            bot = b.bot
            for j in range(k + 1, len(live)):
                c = live[j]
                if c is not None and len(c.lines) == 1 and abs(c.top - (bot + norm)) <= GAP_SLACK and abs(c.left - b.left) <= SIDE_SLACK and c.right < b.right + 1:
                    b.lines.append(c.lines[0])
                    live[j] = None
            for j in range(k):
                c = live[j]
                if c is not None and len(c.lines) == 1 and abs(c.bot - (b.top - norm)) <= GAP_SLACK and INDENT[0] <= c.left - b.left <= INDENT[1] and abs(c.right - b.right) <= SIDE_SLACK:
                    live[j] = Block([*c.lines, *b.lines], b.right)
                    live[k] = None
                    break
        k -= 1
    return [b for b in live if b is not None]


def text_boxes(blocks: list[Block], norm: int) -> list[Block]:
    """Chains of the small blocks, top to bottom."""
    small = sorted((b for b in blocks if len(b.lines) <= 2), key=lambda b: b.top)
    used, out = set(), []
    for i, b in enumerate(small):
        if i in used:
            continue
        chain = Block(list(b.lines), b.right)
        for j in range(i + 1, len(small)):
            c = small[j]
            if j in used:
                continue
            if c.top > chain.bot + norm + GAP_SLACK:
                break
            if abs(c.top - (chain.bot + norm)) <= GAP_SLACK and abs(c.left - chain.left) <= SIDE_SLACK:
                chain.lines += c.lines
                chain.right = max(chain.right, c.right)
                used.add(j)
        out.append(chain)
    return out


def page_boxes(rows: list[Line], norm: int | None) -> list[tuple[str, Block]]:
    """Lines of a page, by top and element order -> its boxes; without a normal gap each line is one."""
    if norm is None:
        return [("text", Block([x], x.right)) for x in rows]
    blocks = repair(build_blocks(rows, norm), norm)
    return [("block", b) for b in blocks if len(b.lines) > 2] + [("text", b) for b in text_boxes(blocks, norm)]


def boxes(elements: DataFrame) -> DataFrame:
    """Text runs (ELEMENTS) -> BOXES: block-style boxes of three lines or more, and text boxes."""
    return laid_out(elements)[1]


def laid_out(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(joined lines, BOXES) of text runs."""
    parts = parts_for(elements)
    single = lines(elements, parts)
    joined = stored(joined_lines(single))
    return joined, boxes_of(joined, normal_gaps(single, joined, parts), parts)


def boxes_of(joined: DataFrame, norms: DataFrame, parts: int | None = None) -> DataFrame:
    """BOXES of joined lines by the normal gap of their pages."""
    parts = parts_for(joined) if parts is None else parts
    ready = joined.repartition(parts, *PAGE).join(norms.repartition(parts, *PAGE), PAGE, "left")
    ordered = ready.select(*PAGE, "top", "seq", "left", "right", "height", "text", "norm").repartition(parts, *PAGE).sortWithinPartitions(*PAGE, "top", "seq")
    schema = to_arrow_schema(StructType.fromDDL(BOXES))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, own, norm = None, [], None

        def close_page() -> None:
            for k, (kind, b) in enumerate(page_boxes(own, norm)):
                x, n = b.lines[0], len(b.lines)
                edges = (x.top, x.right, x.bot, 1, x.text) if n == 1 else (min(y.top for y in b.lines), max(y.right for y in b.lines), max(y.bot for y in b.lines), n, " ".join(y.text for y in b.lines))
                out.append((*now, k, kind, x.left, *edges))

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, no, top, _, left, right, height, text, gap in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc_id, no) != now:
                    if own:
                        close_page()
                    now, own, norm = (doc_id, no), [], gap
                own.append(Line(top, left, right, top + height, text))
            yield told()
            out.clear()
        if own:
            close_page()
            yield told()

    return ordered.mapInArrow(stream, BOXES)
