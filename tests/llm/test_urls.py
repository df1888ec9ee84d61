import re

from pyspark.sql import functions as F

from quirelens.llm import urls
from quirelens.runtime import table


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [h + p for _, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, key=len, default=None)


def test_rules_and_parts(spark, sf_dir):
    odd = [None, "", "nothing", "http://", "HTTP://A.ORG", "http://org/", "http://xorg/", "x://a.example.org/es/1?x=/y#://", "a://b://c/d", "http://example.org/en/1", "http://Example.ORG/en/2\n/x", "https://É.org/é", "http://com?/de/", "http://a.com/de/" + "x" * 20_000]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(odd)], "page_id bigint, url string, host string").unionByName(table(spark, sf_dir, "pages").selectExpr("page_id + 1000 AS page_id", "url", "html AS host"))
    verdicts = {h + p: v for v, h, p in urls.RULES}
    rows = urls.judge(pages).join(pages.select("page_id", "url"), "page_id").collect()
    assert len(rows) == pages.count()
    for r in rows:
        host, path, rule = brute(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdicts[rule] if rule else r.verdict in ("allow", "block")


def test_trees_learn(spark):
    pages = spark.createDataFrame([(k, f"http://h{k}.{'good' if k % 2 else 'bad'}.net/a/{k}" + ("?x=1&y=2&z=3" if k % 2 == 0 else "")) for k in range(400)], "page_id bigint, url string")
    labelled = pages.where("page_id < 200").selectExpr("url", "CASE WHEN page_id % 2 = 0 THEN 1.0 ELSE 0.0 END AS label")
    got = urls.judge(pages, labelled=labelled).where("page_id >= 200").collect()
    assert all((r.verdict == "block") == (r.page_id % 2 == 0) for r in got)
    empty = spark.createDataFrame([], "page_id bigint, url string")
    assert urls.judge(empty).count() == 0


def test_repeated_rows_and_own_label(spark):
    rows = [(1, "http://a.net/x"), (1, "http://a.net/x"), (2, None), (3, "http://b.net/y")]
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string")).collect()
    assert len(got) == 4 and len({tuple(r) for r in got if r.page_id == 1}) == 1
    # a host that stands once says nothing of its own label
    once = spark.createDataFrame([(f"http://h{k}.s{k}.net/", float(k % 2)) for k in range(40)], "url string, label double")
    model = urls.UrlModel(once)
    lexical = urls.lexical(once)
    assert {round(r.suffix_share, 3) for r in model.featured(lexical, training=True).collect()} == {0.5}
    # rows of one suffix and fold have one value, whatever their labels
    many = spark.createDataFrame([(f"http://h{k}.same.net/", float(k % 2)) for k in range(60)], "url string, label double")
    shares = urls.UrlModel(many).featured(urls.lexical(many), training=True).groupBy("fold").agg(F.count_distinct("suffix_share").alias("n")).collect()
    assert {r.n for r in shares} == {1}
