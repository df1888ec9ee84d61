"""Lines, joins and gaps against a plain run-by-run version, and hand cases."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quirelens.operators import layout

ELEMENTS = "doc_id string, page_no int, elem_seq int, kind string, top int, left int, width int, height int, font int, text string, fmt int"


def combined(a, b):
    return a if a == b or b == 0 else b if a == 0 else 4


class Plain:
    """One document, run by run, with mutable lines; kept as the text of the rules says it."""

    def __init__(self):
        self.counts, self.best = defaultdict(dict), {}

    def page(self, runs):
        lines = []
        for top, left, width, height, font, text, fmt in runs:
            seen = self.counts[font]
            if self.best.get(font) == height:
                seen[height] += 1
            else:
                seen[height] = seen.get(height, 0) + 1
                self.best[font] = max(seen.items(), key=lambda kv: kv[1])[0]
                if self.best[font] != height and lines:
                    last = lines[-1]
                    if 0 <= left - last["right"] < 10:
                        last.update(right=left + width, text=f"{last['text']} {text}", fmt=combined(last["fmt"], fmt))
                else:
                    seen[height] = 1
            if text:
                lines.append({"n": len(lines), "top": top, "left": left, "right": left + width, "height": height, "font": font, "text": text, "fmt": fmt})
        return lines

    def align(self, lines):
        """(joined lines, {top: (gap, same font)}), the gap of a top searched when its next top has been joined."""
        single = [dict(x) for x in lines]
        lefts = Counter(x["left"] for x in lines)
        tops = sorted({x["top"] for x in lines})
        levels = {t: [x for x in lines if x["top"] == t] for t in tops}
        gaps = {}
        for i in range(1, len(tops)):
            level = levels[tops[i]]
            across = sorted(level, key=lambda x: x["left"])
            joins = [(a, b) for a, b in zip(across, across[1:], strict=False) if b["left"] - a["right"] < 10 and (a["fmt"] > 0 or b["fmt"] > 0 or lefts[b["left"]] <= 2)]
            for a, b in reversed(joins):
                lefts[b["left"]] -= 1
                level.remove(b)
                a.update(right=b["right"], text=f"{a['text']} {b['text']}", fmt=combined(a["fmt"], b["fmt"]))
            a = levels[tops[i - 1]][0]
            for j in range(i, len(tops)):
                b = levels[tops[j]][0]  # joined at j = i, as it came further down
                gap = tops[j] - tops[i - 1] - a["height"]
                inside = (0 if a["left"] <= b["left"] else 1) == (0 if a["right"] >= b["right"] else 1)
                if gap > 0 or (a["height"] and abs(gap) / a["height"] < 0.15 and (abs(a["left"] - b["left"]) <= 2 or abs(a["right"] - b["right"]) <= 2 or inside)):
                    gaps[tops[i - 1]] = (gap, a["font"] == b["font"])
                    break
        return single, [x for t in tops for x in levels[t]], gaps


def made(seed, n_docs=25):
    rng = random.Random(seed)
    rows = []
    for d in range(n_docs):
        for p in range(rng.randint(1, 3)):
            for k in range(rng.randint(0, 14)):
                rows.append((f"d{d}", p, k, "text", rng.randint(0, 9) * 7, rng.choice([0, 40, 80, 81, 120]), rng.choice([30, 33, 38, 45]), rng.choice([10, 10, 10, 15, 22]), rng.randint(0, 1), rng.choice(["", "a", "b c", "d"]), rng.choice([0, 0, 0, 1, 2])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_run_by_run(spark, seed):
    rows = made(seed)
    elements = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), ELEMENTS)
    single = layout.lines(elements)
    joined = layout.joined_lines(single)
    shape = lambda df: sorted((r.doc_id, r.page_no, r.top, r.left, r.right, r.height, r.font, r.text, r.fmt) for r in df.collect())
    want_single, want_joined, want_gaps = [], [], []
    for d in sorted({r[0] for r in rows}):
        plain = Plain()
        for p in sorted({r[1] for r in rows if r[0] == d}):
            s, j, gaps = plain.align(plain.page([r[4:] for r in rows if r[:2] == (d, p)]))
            flat = lambda x: (d, p, x["top"], x["left"], x["right"], x["height"], x["font"], x["text"], x["fmt"])  # noqa: B023, E731
            want_single += map(flat, s)
            want_joined += map(flat, j)
            want_gaps += [(d, p, t, *g) for t, g in gaps.items()]
    assert shape(single) == sorted(want_single) and shape(joined) == sorted(want_joined)
    got = sorted((r.doc_id, r.page_no, r.top, r.gap, r.same_font) for r in layout.successors(single, joined).collect())
    assert got == sorted(want_gaps) and any(g[3] <= 0 for g in got)


def test_state_of_a_font_goes_on_over_pages(spark):
    rows = [("d", p, k, "text", 20 * k, 0, 50, 10, 0, "x", 0) for p in range(2) for k in range(3)] + [("d", 2, 0, "text", 0, 0, 50, 10, 0, "x", 0), ("d", 2, 1, "text", 0, 52, 9, 6, 0, "2", 0)]
    got = layout.lines(spark.createDataFrame(rows, ELEMENTS)).where("page_no = 2").orderBy("left").collect()
    assert [(r.text, r.right) for r in got] == [("x 2", 61), ("2", 61)]


def test_edges(spark):
    rows = [(None, 1, 1, "text", 1, 1, 1, 1, 0, "x", 0), ("d", None, 1, "text", 1, 1, 1, 1, 0, "x", 0), ("d", 1, 1, "text", None, 1, 1, 1, 0, "x", 0), ("d", 1, 2, "text", 5, 1, 9, 0, None, None, None), ("d", 1, 3, "text", 5, 1, 9, 0, None, "y", None), ("d", 1, 3, "text", 5, 1, 9, 0, None, "y", None), ("e", 1, 1, "image", 5, 1, 9, 9, None, None, None)]
    df = spark.createDataFrame([(*r, 3) for r in rows], ELEMENTS + ", norm int")
    assert [(r.doc_id, r.kind, r.text) for r in layout.boxes(df).collect()] == [("d", "text", "y")] * 2
    assert layout.boxes(df.limit(0)).count() == 0
    assert layout.boxes(df.where(F.col("kind") == "image")).count() == 0


def test_partitions_follow_the_rows(spark, monkeypatch):
    """The memory of a task must not grow with the table: more runs are dealt into more partitions, up to the joined lines."""
    from quirelens import runtime

    rows = made(3)
    elements = spark.createDataFrame(rows, ELEMENTS)
    shape = lambda df: sorted(map(tuple, df.collect()))
    few = shape(layout.joined_lines(layout.lines(elements)))
    monkeypatch.setattr(runtime, "SPREAD_ROWS", 10)
    single = layout.lines(elements)
    many = -(-len(rows) // 10)
    assert many > 8 and single.rdd.getNumPartitions() == many and layout.joined_lines(single).rdd.getNumPartitions() == many
    assert shape(layout.joined_lines(single)) == few


def test_page_space_stays_with_its_pages(spark):
    """Pages are dealt once into the partitions asked for, and the joins and sums behind go on in them."""
    from quirelens.operators import pages

    sheets = spark.range(40).selectExpr("string(id) AS doc_id", "int(id % 3) AS page_no", "20 AS page_width", "10 AS page_height").localCheckpoint()
    images = sheets.selectExpr("doc_id", "page_no", "explode(array(1, 2)) AS seq").selectExpr("*", "seq * 2 AS left", "0 AS top", "seq * 2 + 4 AS right", "5 AS bot")
    boxes = sheets.selectExpr("doc_id", "page_no", "explode(array(0, 1)) AS box_id").selectExpr("*", "IF(box_id = 0, 'text', 'block') AS kind", "4 AS left", "4 AS top", "box_id + 6 AS right", "8 AS bot")
    out = pages.page_space(sheets, images, boxes, parts=13)
    assert out.rdd.getNumPartitions() == 13
    assert {tuple(r)[2:] for r in out.collect()} == {(200, 2, 30, 10, 8, 12, 9, 8, 167)}


def test_a_task_has_a_share_of_the_rows_that_fits(spark):
    """More partitions from half a million rows on, not only from millions on."""
    from quirelens import runtime

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert runtime.parts_for(spark.range(500_000)) > least and 500_000 / runtime.parts_for(spark.range(500_000)) <= 60_000


def test_blocks_are_looked_up_by_their_edges():
    """A line is compared with the blocks that it may continue, not with all of its page."""
    asked = []

    class Edge(int):
        __hash__ = int.__hash__

        def __eq__(self, other):
            asked.append(1)
            return int(self) == int(other)

    rows = [layout.Line(20 * k, Edge(k % 250), 100, 20 * k + 12, "x") for k in range(500)]
    assert len(layout.build_blocks(rows, 8)) == 500 and len(asked) < 5000
    column = [layout.Line(20 * k, 7 + k % 2, 100, 20 * k + 12, "x") for k in range(9)]
    assert [len(b.lines) for b in layout.build_blocks(column, 28)] == [5, 4]


def test_odd_heights_go_on_over_batches(spark):
    """Numbers, earlier texts and usual heights do not depend on where a batch ends, nor on the fonts between."""
    rng = random.Random(3)
    given = [(f"d{k % 3}", k // 30, k, "text", k * 5, 10, 20, rng.choice([9, 12, 12, 14]) if k % 3 else 12, k % 2, rng.choice(["", "t"]), 0) for k in range(180)]
    runs = spark.createDataFrame(given, ELEMENTS).withColumn("right", F.lit(30)).drop("kind", "width")
    tell = lambda: sorted((r.doc_id, r.page_no, r.seq, r.top, r.before, r.odd) for r in layout.odd_heights(runs, 2).collect())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = tell()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert tell() == whole and any(r[-1] for r in whole)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r[2] for r in whole if r[:2] == ("d0", 0)] == list(range(1, 11))


def test_successors_beyond_the_tops_looked_at_in_place(spark):
    """A high line over more narrow tops beside it than are looked at in place: the first below it follows."""
    n = layout.STEPS + 4
    rows = [("a", 1, 1, 0, 0, 10, 10 * n + 5, 0)] + [("a", 1, 1 + k, 10 * k, 50, 60, 4, 0) for k in range(1, n + 1)] + [("a", 1, n + 2, 10 * (n + 1), 0, 10, 4, 1)]
    lines = spark.createDataFrame(rows, "doc_id string, page_no int, seq int, top int, left int, right int, height int, font int")
    got = {r.top: (r.gap, r.same_font) for r in layout.successors(lines, lines).collect()}
    assert got[0] == (5, False) and got[10] == (6, True) and len(got) == n + 1
