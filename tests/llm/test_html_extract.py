import html as entities
import itertools
import random
import re
import time

from quirelens.llm import html_extract as X
from quirelens.runtime import table


def brute_cut(supply, edges):
    best = None
    for side in itertools.product((False, True), repeat=len(supply)):
        cost = sum(s if s > 0 and not x else -s if s < 0 and x else 0 for s, x in zip(supply, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(best, (cost, sum(side), side)) if best is not None else (cost, sum(side), side)
    return best


def test_minimum_cut_against_all_labellings():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 9)
        supply = [rng.randint(-12, 12) for _ in range(n)]
        edges = [(k - 1, k, rng.randint(0, 9)) for k in range(1, n)] + [(*rng.sample(range(n), 2), rng.randint(0, 9)) for _ in range(rng.randint(0, 4) if n > 1 else 0)]
        side = X.min_cut(supply, edges)
        cost = sum(s if s > 0 and not x else -s if s < 0 and x else 0 for s, x in zip(supply, side, strict=True)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert cost == brute_cut(supply, edges)[0]


def test_long_pages_are_cut_in_time():
    rng = random.Random(1)
    n = 50_000
    start = time.time()
    X.min_cut([rng.randint(-100, 100) for _ in range(n)], [(k - 1, k, 150) for k in range(1, n)])
    deep = X.read_page("<div>" * 20_000 + "deep text here." + "</section>" * 20_000)
    assert [b.text for b in deep.blocks] == ["deep text here."] and time.time() - start < 60


def by_pattern(page):
    """The test pages' own shape: headings and paragraphs of the one article element."""
    inner = re.search("<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    parts = re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", inner.replace("<br>", " ")))
    return "\n".join(filter(None, (" ".join(entities.unescape(x).split()) for x in parts)))


def test_whole_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    want = {r.page_id: by_pattern(r.html) for r in pages.collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in X.extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


NOISE = {
    "menu": '<div class="main-nav"><ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li></ul></div>',
    "header": '<header><h1>The Daily Site</h1><p>All the news, every day of the week.</p></header>',
    "sidebar": '<div id="sidebar"><h3>Popular</h3><p>Read how a farmer found a very old coin under the barn, and what came of it.</p></div>',
    "notice": '<div class="cookie-notice"><p>We use cookies to make this site work, and to learn how it is used by you.</p></div>',
    "advert": '<div class="ad">Buy two lamps now, get one lamp for free, only this week.</div>',
    "form": '<form><label>Your mail</label><input name="m"><button>Send</button> We write once a week, never more often.</form>',
    "comments": '<section class="comments"><h2>2 comments</h2><article><p>I liked this very much, and my sister, who lives there, did so too.</p></article><div class="content">Me too, thank you for writing it.</div></section>',
    "script": '<script>if (a < b) { document.write("<p>never shown</p>"); }</script><style>p > a { color: red }</style><!-- <p>hidden note</p> -->',
    "footer": "<footer><p>&copy; 2020 The Daily Site. All rights reserved, in all countries.</p></footer>",
}
STORY = ["A bridge &amp; its keeper", "For forty years, Anna opened the bridge each morning at six.", "Yes.", "Ships, boats and now and then a swan passed&nbsp;below, and she wrote each one into her book. It has 12,000 pages."]
PLAIN = [" ".join(entities.unescape(t).split()) for t in STORY]


def test_kinds_of_noise(spark):
    """Each kind before, after and inside the text, in pages with and without an article element."""
    weights = X.fit(table(spark, "/root/testdata/sf0.001", "pages"))
    body = f"<h1>{STORY[0]}</h1>" + "".join(f"<p>{t}</p>" for t in STORY[1:])
    for kind, noise in NOISE.items():
        for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", '<div class="post-content">{}</div>'):
            inside = noise if kind != "header" else ""  # a header within an article holds its title and belongs to it
            for page in (noise + wrap.format(body), wrap.format(body) + noise, wrap.format(body.replace("<p>Yes.", inside + "<p>Yes."))):
                read = X.read_page(f"<html><head><title>t</title></head><body>{page}</body></html>")
                kept = [b.text for b, ok in zip(read.blocks, X.main_blocks(read, weights), strict=True) if ok]
                assert kept == PLAIN, (kind, wrap)


def test_smoothness_keeps_short_lines():
    """Without any markup to go by, a short line between long ones is content, a list of links is not."""
    links = "".join(f'<li><a href="/{k}">Page {k}</a></li>' for k in range(6))
    paragraphs = "".join(f"<p>{t}</p>" for t in [STORY[3], "So it was.", STORY[1] + " " + STORY[3], STORY[3]])
    read = X.read_page(f"<body><ul>{links}</ul><div>{paragraphs}</div><ul>{links}</ul></body>")
    kept = [b.text for b, ok in zip(read.blocks, X.main_blocks(read, X.UNTRAINED), strict=True) if ok]
    assert kept == [PLAIN[3], "So it was.", PLAIN[1] + " " + PLAIN[3], PLAIN[3]]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", " \n "), (3, "u", "<article><p>One<br>two &#233; &lt;b&gt; &copy 5<p>three"), (3, "u", "<article><p>One<br>two &#233; &lt;b&gt; &copy 5<p>three")]
    rows += [(4, "u", "<article><p>" + "word " * 100_000 + "</article>"), (5, "u", "<article>" + "<p>again.</p>" * 3000 + "</article>"), (6, "u", "<<<>>> </p></p><!-- never closed <p>x"), (7, "u", "\x00<article>\x01a</article>")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = {}
    for r in X.extract(df).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    assert got[1] == got[2] == got[None] == [("", 0)] and got[3] == [("One two é <b> © 5\nthree", 23)] * 2
    assert got[4][0][1] == 499_999 and got[5][0][0].count("again.") == 3000 and len(got[6]) == len(got[7]) == 1
    assert X.extract(df.limit(0)).count() == 0
