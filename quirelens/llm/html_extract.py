"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes blocks of text. A logistic classifier on the words of a block (not on the page's markup) gives each block a log-odds of being
content; what the markup says (elements, class and id words) is added to it. That sum is the block's capacity to the content or
the boilerplate terminal. Smoothness edges join neighbours, the more the closer they stand in the document tree, and blocks
of one container with others between them. A maximum flow separates the two sides.

The classifier learns from the blocks whose side the markup states, of at most ``SAMPLE_PAGES`` pages (chosen by a hash).

Defined results: null, empty and blank html give an empty text; repeated rows and null ids get a result each; an empty table gives no
rows; unclosed and cut markup is read as far as it goes. Other columns are ignored. White space is what Unicode calls so.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelens.llm import bytescan

#: Pages that the classifier learns from, about; beyond that a hash picks them.
SAMPLE_PAGES = 4_000
#: Capacities are log-odds in hundredths. What markup states outweighs words; weak hints do not.
UNIT, STATED, HINTED, OUTSIDE, TEXT_LIMIT = 100, 6.0, 2.5, -2.0, 4.0
#: Smoothness between neighbours, divided by their distance in the tree, and within a container.
NEXT, CONTAINER = 1.5, 0.5
#: Log-odds by feature where no page states anything (bias, then FEATURES in order).
UNTRAINED = (-1.2, 0.9, -4.0, 0.8, 0.0, -0.8, 0.0, 0.2, 0.2, -0.5, -0.5)
FEATURES = ("size", "links", "sentence", "commas", "short", "digits", "size_before", "size_after", "links_before", "links_after")

# fixed values: element names and words of class, id and role attributes
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED_TAGS = frozenset("script style head title noscript template svg math iframe object canvas textarea select button datalist audio video map".split())
HEAD_TAGS = frozenset("base link meta title script style noscript template".split())
BOILER_TAGS = frozenset("nav aside footer form menu dialog".split())
CONTENT_TAGS = frozenset(("article", "main"))
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
BOILER_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising adbox banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar sidenav widget widgets footer masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login signin register search social share sharing related recommended recommendations trending popular "
    "pagination pager toolbar copyright disclaimer complementary contentinfo alert skip".split()
)
SOFT_WORDS = frozenset("header side notice notices notification aside top bottom bar meta tags links".split())
CONTENT_WORDS = frozenset("content article post entry story body text main maincontent".split())
LAYOUT_WORDS = frozenset("with has no without layout wrapper container".split())
NAME_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Open:
    """An open element: its container in the tree, and what it says about the text inside."""

    tag: str
    node: int
    cue: float = 0.0
    stuck: bool = False
    skipped: bool = False
    linked: bool = False
    inside: bool = False  # within an article or main element


def stated(tag: str, attrs: dict[str, str | None], up: Open) -> tuple[float, bool]:
    """(log-odds that the markup states, whether inner elements cannot change it) for an element within ``up``."""
    if up.stuck or tag in ("html", "body"):
        return up.cue, up.stuck
    names = " ".join(filter(None, (attrs.get(k) for k in ("class", "id", "role"))))
    words = {w.lower() for w in NAME_WORD.findall(names)} if names else frozenset()
    if tag in BOILER_TAGS or words & COMMENT_WORDS or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", ""):
        return -STATED, True
    if tag in CONTENT_TAGS:
        return STATED, False
    if tag == "header" and not up.inside:
        return -STATED, True
    if words & BOILER_WORDS and not words & LAYOUT_WORDS:
        return -STATED, True
    if words & SOFT_WORDS and not words & (CONTENT_WORDS | LAYOUT_WORDS):
        return -STATED, False
    if words & CONTENT_WORDS and up.cue <= 0:
        return HINTED, False
    return up.cue, False


@dataclass(slots=True)
class Block:
    text: str
    n_words: int
    n_linked: int
    node: int
    cue: float


class PageReader(HTMLParser):
    """Reads a page into ``blocks``; ``parent`` and ``depth`` hold the tree of block elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.depth, self.blocks = [0], [0], []
        self.has_article = False
        self.stack = [Open("", 0)]
        self.open_tags: Counter[str] = Counter()
        self.said: list[tuple[str, bool]] = []

    def flush(self) -> None:
        """Ends the block that is being read, if it has words."""
        if self.said:
            text = " ".join("".join(t for t, _ in self.said).split())
            if text:
                top = self.stack[-1]
                n_words = text.count(" ") + 1
                n_linked = sum(len(t.split()) for t, linked in self.said if linked)
                self.blocks.append(Block(text, n_words, min(n_linked, n_words), top.node, top.cue))
            self.said = []

    def close_to(self, tag: str) -> None:
        while True:
            done = self.stack[-1]
            if done.tag in BLOCK_TAGS:
                self.flush()
            self.stack.pop()
            self.open_tags[done.tag] -= 1
            if done.tag == tag:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open_tags["head"] and tag not in HEAD_TAGS and tag != "head":
            self.close_to("head")
        if tag == "br":
            self.said.append((" ", False))
        block = tag in BLOCK_TAGS
        if block:
            self.flush()
            if self.open_tags["p"]:  # a block ends an open paragraph
                self.close_to("p")
            if tag in ("li", "dt", "dd", "tr", "td", "th") and self.stack[-1].tag == tag:
                self.close_to(tag)
        if tag in VOID_TAGS:
            return
        up = self.stack[-1]
        node = up.node
        if block:
            node = len(self.parent)
            self.parent.append(up.node)
            self.depth.append(self.depth[up.node] + 1)
        cue, stuck = stated(tag, dict(attrs), up) if block or attrs else (up.cue, up.stuck)
        content = tag in CONTENT_TAGS and cue > 0
        self.has_article |= content
        self.stack.append(Open(tag, node, cue, stuck, up.skipped or tag in SKIPPED_TAGS, up.linked or tag == "a", up.inside or content))
        self.open_tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open_tags[tag] > 0:
            self.close_to(tag)

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if not top.skipped:
            self.said.append((data, top.linked))


def read_page(html: str | None) -> PageReader:
    page = PageReader()
    page.feed(html or "")
    page.close()
    page.flush()
    return page


def text_features(blocks: list[Block]) -> list[list[float]]:
    """FEATURES of each block: of its words and of its neighbours', not of the markup around them."""
    own = []
    for b in blocks:
        n = len(b.text)
        own.append((math.log1p(b.n_words), b.n_linked / b.n_words, float(b.text[-1] in ".!?…:;\"'”»)"), b.text.count(",") / b.n_words, float(b.n_words < 4), sum(map(b.text.count, "0123456789")) / n))
    edge = (0.0, 0.0)
    sizes = [edge, *((o[0], o[1]) for o in own), edge]
    return [[*o, before[0], after[0], before[1], after[1]] for o, before, after in zip(own, sizes, sizes[2:], strict=False)]


def tree_distance(page: PageReader, a: int, b: int) -> int:
    """Steps from one container to the other, counted up to 8."""
    steps = 0
    while a != b and steps < 8:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
        steps += 1
    return steps


def min_cut(supply: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The content side of a minimum cut: ``supply`` is the capacity to the content terminal, if negative to the other; edges (a, b, capacity).

    Blocks whose terminal outweighs all their edges are settled first (their edges then count at the neighbours'
    terminals); the rest goes through Dinic's maximum flow. A block that both sides want equally is boilerplate.
    """
    n = len(supply)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in edges:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    want, side = list(supply), [None] * n
    slack = [sum(x.values()) for x in near]
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if side[k] is None and abs(want[k]) > slack[k] or (side[k] is None and not near[k]):
            side[k] = want[k] > 0
            for x, c in near[k].items():
                want[x] += c if side[k] else -c
                slack[x] -= c
                del near[x][k]
                queue.append(x)
    left = [k for k in range(n) if side[k] is None]
    residual = {k: dict(near[k]) for k in left}
    while True:
        level = {k: 0 for k in left if want[k] > 0}
        order = deque(level)
        reached = False
        while order:
            k = order.popleft()
            for x, c in residual[k].items():
                if c > 0 and x not in level:
                    level[x] = level[k] + 1
                    reached |= want[x] < 0
                    order.append(x)
        if not reached:
            for k in left:
                side[k] = k in level
            return side
        arcs, at = {k: list(residual[k]) for k in level}, dict.fromkeys(level, 0)
        for source in [k for k, depth in level.items() if depth == 0]:
            path = [source]
            while path and want[source] > 0:
                k = path[-1]
                if want[k] < 0:
                    steps = list(zip(path, path[1:], strict=False))
                    flow = min([want[source], -want[k], *(residual[a][b] for a, b in steps)])
                    want[source] -= flow
                    want[k] += flow
                    for a, b in steps:
                        residual[a][b] -= flow
                        residual[b][a] += flow
                    path = [source]
                elif at[k] == len(arcs[k]):
                    path.pop()
                    if path:
                        at[path[-1]] += 1
                elif residual[k][arcs[k][at[k]]] > 0 and level.get(arcs[k][at[k]]) == level[k] + 1:
                    path.append(arcs[k][at[k]])
                else:
                    at[k] += 1


def main_blocks(page: PageReader, weights: tuple[float, ...]) -> list[bool]:
    """Which blocks of a page are content."""
    supply = []
    for b, features in zip(page.blocks, text_features(page.blocks), strict=True):
        words = weights[0] + sum(w * x for w, x in zip(weights[1:], features, strict=True))
        cue = b.cue + (OUTSIDE if page.has_article and b.cue == 0 else 0.0)
        supply.append(round(UNIT * (max(-TEXT_LIMIT, min(TEXT_LIMIT, words)) + cue)))
    edges, last = [], {}
    for k, b in enumerate(page.blocks):
        if k:
            edges.append((k - 1, k, round(UNIT * NEXT / (1 + tree_distance(page, page.blocks[k - 1].node, b.node)))))
        box = page.parent[b.node]
        if box in last and last[box] != k - 1:
            edges.append((last[box], k, round(UNIT * CONTAINER)))
        last[box] = k
    return min_cut(supply, edges)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES) -> tuple[float, ...]:
    """Weights (bias first) of the text classifier, from blocks whose side the markup states, of about ``sample`` pages."""
    total = pages.count()
    part = pages.select("html", F.xxhash64(F.coalesce("url", F.lit("")), F.octet_length("html")).bitwiseAND((1 << 32) - 1).alias("h"))
    part = part.where(F.col("h") < int((1 << 32) * min(1.0, sample / max(total, 1)))).select("html")

    def stated_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, labels = [], []
            for html in batch.column("html"):
                page = read_page(html.as_py())
                for b, f in zip(page.blocks, text_features(page.blocks), strict=True):
                    if abs(b.cue) >= STATED:
                        features.append(f)
                        labels.append(float(b.cue > 0))
            yield pa.RecordBatch.from_pydict({"features": pa.array(features, pa.list_(pa.float64())), "label": pa.array(labels, pa.float64())})

    rows = part.mapInArrow(stated_blocks, "features array<double>, label double").select(array_to_vector("features").alias("features"), "label").persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return UNTRAINED
        # both classes count alike: how many menu entries a site has says nothing about one block
        share = rows.agg(F.avg("label")).first()[0]
        weighted = rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(0.5 / share)).otherwise(F.lit(0.5 / (1 - share))))
        model = LogisticRegression(maxIter=25, regParam=0.01, weightCol="weight").fit(weighted)
        return tuple(round(float(x), 4) for x in (model.intercept, *model.coefficients))
    finally:
        rows.unpersist()


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) of ``pages`` (page_id, url, html); ``weights`` as :func:`fit` gives them."""
    weights = fit(pages) if weights is None else weights

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_blocks, n_kept = [], [], []
            for html in batch.column("html"):
                page = read_page(html.as_py())
                kept = [b.text for b, ok in zip(page.blocks, main_blocks(page, weights), strict=True) if ok]
                texts.append("\n".join(kept))
                n_blocks.append(len(page.blocks))
                n_kept.append(len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n_blocks, pa.int32()), pa.array(n_kept, pa.int32())], names=["page_id", "url", "text", "n_blocks", "n_kept"])
        bytescan.give_back()

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInArrow(scan, "page_id long, url string, text string, n_blocks int, n_kept int").withColumn("n_chars", F.char_length("text").cast("long"))
