import hashlib
import random
import re

from pyspark.sql import functions as F

from quirelens.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        worth = [int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(worth) % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in RAW.items() for m in re.finditer(p, text or "") if fits(k, m[0])]


def write(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def test_base_spans(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y@z-1.co", "@", ".", "1.2.3.4", "256.1.1.1", "10.0.0.255", "00255.1.2.3", "4539578763621486", "4539 5787 6362 1486", "-", " ", "+1 (456) 555-2186", "+", "1", "é", "日", "\n", "_", "(", "4111111111111111", "a" * 30]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(500)] + [None, "", "1" * 60_000, "a" * 200_000 + "@", "1.2.3.4 " * 400, "+1" + "-2" * 40_000]
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id bigint, text string, base string").repartition(4)
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = brute(t)
        assert got[k].base_sha256 == hashlib.sha256(write(want).encode()).hexdigest(), repr(t)
        assert (got[k].n_email, got[k].n_ip, got[k].n_card, got[k].n_phone) == tuple(sum(w[0] == kind for w in want) for kind in RAW)
        assert not want or set(write(want).split(",")) <= set(got[k].spans.split(","))
    assert pii.digest(df.limit(0)).count() == 0


def test_bootstrapping_and_redaction(spark):
    rows = [(k, f"intro words mailto user{k}@site{k % 7}.org thanks number {k} only") for k in range(40)]
    rows += [(100, "we saw mailto user.at.host77 thanks indeed"), (101, "nothing number 123456 here"), (102, "see user1@site1.org"), (102, "see user1@site1.org"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("found", F.lit(1))
    got = {r.doc_id: r for r in pii.digest(df).collect()}
    text = rows[40][1]
    at = text.index("user.at")
    assert got[100].spans == f"email:{at}:{at + len('user.at.host77')}" and got[100].n_email == 0
    assert got[101].spans == "" and got[None].spans == ""
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.count() == len(rows)
    have = {r.doc_id: r.text for r in clean.collect()}
    assert have[100] == "we saw mailto [EMAIL] thanks indeed" and have[101] == rows[41][1] and have[102] == "see [EMAIL]" and have[None] is None


def test_contexts_discover(spark):
    key = "0123456789abcdef" * 2
    rows = [(k, f'word{k} other{k} token = "{key[: -len(str(k))]}{k}" end{k}') for k in range(10, 22)] + [(99, 'so token = "hunter2-not-hex-9" it was'), (100, 'so tokens are "hunter3-not-hex-9" here')]
    got = {r.doc_id: (r.spans, r.n_spans) for r in pii.digest(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    at = rows[12][1].index('"')
    assert got[99] == (f"secret:{at}:{at + 19}", 1) and got[100] == ("", 0)
    assert all(got[k][0].startswith("secret:") for k in range(10, 22))
    assert {r.text for r in pii.redact(spark.createDataFrame(rows[12:], "doc_id bigint, text string")).collect()} == {rows[12][1], rows[13][1]}
