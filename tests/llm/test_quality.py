import random
import re

from quirelens.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + d for k, t in enumerate(tri) if tri.count(t) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(covered)


def test_base_statistics(spark):
    rng = random.Random(2)
    bits = ["a", "bé", "the", "#x", "日本", " ", "  ", "\n", "\t", "\r\n", "\x0b", "|", " ", "a b a b", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(400)] + [None, "", "\n\n", "x" * 300_000, "w " * 70_000]
    df = spark.createDataFrame([(k, t, "q") for k, t in enumerate(texts)], "doc_id bigint, text string, kept string").repartition(3)
    got = {r.doc_id: r for r in quality.digest(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts[:-1]):
        r = got[k]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    assert got[len(texts) - 1].base_failed and got[len(texts) - 1].n_repeat_words == 70_000
    assert quality.digest(df.limit(0)).count() == 0


def test_line_rules(spark):
    prose = " ".join(f"word{k} runs" for k in range(40)) + "."
    other = prose.replace("word", "term")
    nav = "Home | News | Sport | Contact | About | Help"
    shout = " ".join(f"WORD{k}!!" for k in range(60))
    marks = " ".join(f"word{k}%%%" for k in range(60))
    same = "again " * 60
    rows = [(1, f"{prose}\n{nav}\n{other}\nRead more."), (2, "\n".join([nav + str(k) for k in range(30)])), (3, shout), (4, marks), (5, same), (6, prose)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].kept and got[1].clean_text == f"{prose}\n{other}\n" and got[1].n_bad_lines == 2
    assert [got[k].kept for k in (2, 3, 4, 5, 6)] == [False, False, False, False, True]
    assert got[6].clean_text == prose


def brute_left(text):
    """Words outside failing lines, line by line."""
    left = 0
    for line in text.split("\n"):
        w = WORD.findall(line)
        if not w:
            continue
        bars = sum(x in ("|", ">", "•", "·", "»", "›") for x in w)
        loud = sum(len(x.encode()) > 2 and x.endswith("!!") for x in w)
        marked = sum(len(x.encode()) > 1 and x[-1] in "#*$%&|<>" for x in w)
        stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
        closes = any(re.search(r"[.!?:;][\"')\]]?$", x) for x in w) or any(m in line for m in quality.WIDE_ENDS)
        bad = bars >= 3 and 4 * bars >= len(w) - bars
        bad |= len(w) >= 3 and (2 * marked >= len(w) or 2 * loud >= len(w))
        bad |= len(w) >= 8 and stutter >= 0.6 * len(w)
        bad |= len(w) < quality.SENTENCE_WORDS and not closes
        bad |= not re.search(r"[0-9A-Za-z]|[^\x00-\x7f]", line)
        bad |= len(line.encode()) < 60 and line.strip(" \t\n\r\x0b\x0c").rstrip(".").lower() in quality.NOTICES
        left += 0 if bad else len(w)
    return left


def test_verdict_against_brute_force(spark):
    rng = random.Random(5)
    bits = ["Read more.", "Leer más", "a | b | c | d", "wow!! yes!! no", "x% y% z.", "go " * 9 + ".", "Menu item", "Said (so.)", "這是一句。", "***", "one two three four five six seven eight", "A longer line that says something, and ends.", ""]
    texts = ["\n".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    got = {r.doc_id: r for r in quality.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    for k, t in enumerate(texts):
        want, r = brute(t), got[k]
        assert r.words_left == brute_left(t), repr(t)
        assert r.kept == (want[0] >= 50 and 100 * want[4] <= 50 * want[0] and 2 * brute_left(t) >= want[0])
    assert {r.kept for r in got.values()} == {True, False}
    again = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, None)], "doc_id bigint, text string")
    assert quality.digest(again).count() == 4
