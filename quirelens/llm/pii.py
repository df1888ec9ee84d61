"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction of identifiers they miss.

Seeds are e-mail addresses, IPv4 addresses, payment cards, phone numbers (the base kinds) and long hexadecimal keys
(secrets). The words around the seeds induce lexical patterns: (kind, word before, two words before, or word after),
quotes and brackets beside a value left aside. A pattern and the identifier-like tokens that stand in its slot form a
bipartite graph; confidence runs over it from both sides for a few rounds:

* a pattern is as good as the mean confidence of its instances (the seeds of its kind 1, other kinds 0)
* an instance is as good as the best supported pattern it stands in

An unseen token in the slot of a pattern with enough distinct seeds and confidence is reported under the pattern's
kind. The texts are read with built-in functions only. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage

#: Order in which kinds are written; the first BASE of them are the base kinds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
# Possessive loops and the look at the character before (or the end of the last match) keep the leftmost matches as they
# are and the search linear: a match that fails at the beginning of a run fails inside it too.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9])",
}
#: What a text must hold before a pattern is tried on it.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9][ ().0-9-]", "secret": r"[0-9A-Fa-f]{32}"}
#: Identifier-like tokens: candidates for the slots of patterns, with the words around them.
TOKEN = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D]{0,63}[0-9@])[^\x20\x09-\x0D]{5,64}(?![^\x20\x09-\x0D])"
MIN_SEEDS, MIN_CONFIDENCE, ROUNDS = 5, 0.8, 3
#: Characters beside a token that are looked at for its words; words, gaps and the marks that may stand beside a value.
CONTEXT = 40
WORD, GAP, QUOTES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+", r"[\x22\x27(\[<>\])]{0,2}"


def spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches of one kind, failing ones dropped.

    Splitting at the pattern gives what stands between the matches, so running lengths give the offsets.
    """
    need = F.contains(text, F.lit(NEEDS[kind])) if kind == "email" else F.regexp_like(text, F.lit(NEEDS[kind]))
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    between = F.split(text, PATTERNS[kind], -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def add(acc: Column, pair: Column) -> Column:
        at = acc["at"] + F.char_length(pair["gap"])
        end = at + F.char_length(pair["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(at.alias("start"), end.alias("end"), pair["value"].alias("value"))).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    placed = F.aggregate(pairs, start, add, lambda acc: acc["out"])
    good = F.filter(placed, lambda s: valid(s["value"], kind))
    return F.when(need, good).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    worth = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(value: Column, kind: str) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind == "card":
        d = digits(value)
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    if kind == "secret":
        return F.regexp_like(value, F.lit("[0-9]")) & F.regexp_like(value, F.lit("[A-Fa-f]"))
    return F.lit(True)


EMPTY = "array<struct<n:int,start:int,end:int,value:string>>"


def seed_spans(text: Column) -> Column:
    """Array of (n: place in KINDS, start, end, value) of the seeds, by kind and start."""

    def of_kind(n: int) -> Column:
        return F.transform(spans(text, KINDS[n]), lambda s: F.struct(F.lit(n).alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))

    return F.concat(*map(of_kind, range(len(KINDS))))


def plain(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), s["end"].alias("end")))


def only_base(found: Column) -> Column:
    return F.filter(found, lambda s: s["n"] < BASE)


def keyed(df: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and two hashes of the row that serve as its key."""
    text = F.coalesce("text", F.lit(""))
    return df.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("h1"), F.xxhash64(text, F.lit("key"), F.col("doc_id")).alias("h2"))


def measured(df: DataFrame) -> DataFrame:
    """doc_id, h1, h2, base, and tokens: identifier-like tokens that no seed overlaps, and the seeds, with the words around them."""
    rows = keyed(df).withColumn("base", seed_spans(F.col("text")))
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    gaps = F.split(text, TOKEN, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(EMPTY).alias("out"))

    def add(acc: Column, p: Column) -> Column:
        at = acc["at"] + F.char_length(p["gap"])
        end = at + F.char_length(p["value"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(F.lit(-1).alias("n"), at.alias("start"), end.alias("end"), p["value"].alias("value"))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    free = F.filter(F.aggregate(pairs, start, add, lambda acc: acc["out"]), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def around(t: Column) -> Column:
        # the window before starts CONTEXT characters before the token, or at the text's beginning
        first = F.greatest(t["start"] - CONTEXT, F.lit(0))
        window = F.substring(text, first + 1, t["start"] - first)
        left = F.regexp_extract(window, rf"({WORD}){GAP}{QUOTES}$", 1)
        two = F.regexp_replace(F.regexp_extract(window, rf"({WORD}{GAP}{WORD}){GAP}{QUOTES}$", 1), GAP, " ")
        right = F.regexp_extract(F.substring(text, t["end"] + 1, F.lit(CONTEXT)), rf"^{QUOTES}{GAP}({WORD})", 1)
        return F.struct(t["n"].alias("n"), t["start"].alias("start"), t["end"].alias("end"), F.sha2(t["value"], 256).alias("value"), F.lower(left).alias("before"), F.lower(two).alias("two"), F.lower(right).alias("after"))

    has = F.regexp_like(text, F.lit("[0-9@]"))
    tokens = F.when(has, F.transform(F.concat(F.col("base"), free), around))
    return rows.select("doc_id", "h1", "h2", plain(F.col("base")).alias("base"), tokens.alias("tokens"))


def discover(narrow: DataFrame) -> DataFrame:
    """(h1, h2, new): spans that no fixed pattern took, found by confident lexical patterns."""
    each = narrow.where("tokens IS NOT NULL").select("h1", "h2", F.explode("tokens").alias("t")).select("h1", "h2", "t.*")
    slots = F.filter(F.array(*(F.struct(F.lit(side).alias("side"), F.col(c).alias("word")) for side, c in (("<", "before"), ("<<", "two"), (">", "after")))), lambda s: s["word"] != "")
    edges = each.select("h1", "h2", "start", "end", "value", "n", F.explode(slots).alias("slot")).select("h1", "h2", "start", "end", "value", "n", "slot.side", "slot.word")
    # an instance is a value: the same value in many texts is one node of the graph
    graph = cut_lineage(edges.select("side", "word", "value", "n").distinct())
    induced = graph.where("n >= 0").groupBy("side", "word", F.col("n").alias("kind")).agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    links = cut_lineage(graph.join(induced.select("side", "word", "kind"), ["side", "word"]))
    seed = F.when(F.col("n") >= 0, (F.col("n") == F.col("kind")).cast("double"))
    trust = links.groupBy("value", "kind").agg(F.coalesce(F.max(seed), F.lit(0.5)).alias("trust"))
    for _ in range(ROUNDS):
        scored = links.join(trust, ["value", "kind"]).groupBy("side", "word", "kind").agg(F.avg("trust").alias("score"))
        trust = cut_lineage(links.join(scored, ["side", "word", "kind"]).groupBy("value", "kind").agg(F.coalesce(F.max(seed), F.max("score")).alias("trust")))
    good = links.join(trust, ["value", "kind"]).groupBy("side", "word", "kind").agg(F.avg("trust").alias("score")).where(F.col("score") >= MIN_CONFIDENCE)
    hits = edges.where("n < 0").join(good, ["side", "word"]).groupBy("h1", "h2", "start", "end").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("n"))
    return hits.groupBy("h1", "h2").agg(F.collect_set(F.struct("n", "start", "end")).alias("new"))  # at most one text's tokens


def with_new(rows: DataFrame, new: DataFrame) -> DataFrame:
    joined = rows.join(new.select(F.col("h1").alias("_1"), F.col("h2").alias("_2"), "new"), (F.col("h1") == F.col("_1")) & (F.col("h2") == F.col("_2")), "left")
    return joined.withColumn("found", F.array_sort(F.concat(F.col("base"), F.coalesce("new", F.array().cast("array<struct<n:int,start:int,end:int>>"))))).drop("_1", "_2", "new")


def find(df: DataFrame) -> DataFrame:
    """Add ``base`` and ``found``: arrays of (n: place in KINDS, start, end), by kind and start; ``found`` holds the base spans and the bootstrapped ones.

    Equal rows get equal spans; a null text has none; an empty table stays empty. Columns of these names in the
    input are replaced, others stay. Texts do not move unless the discovered spans are too many to broadcast.
    """
    keep = [c for c in df.columns if c not in ("base", "found")]
    text = F.coalesce("text", F.lit(""))
    rows = df.select(*(F.col(c).alias(f"r_{k}") for k, c in enumerate(keep)), plain(seed_spans(text)).alias("base"), F.xxhash64("doc_id", text).alias("h1"), F.xxhash64(text, F.lit("key"), F.col("doc_id")).alias("h2"))
    return with_new(rows, discover(cut_lineage(measured(df)))).select(*(F.col(f"r_{k}").alias(c) for k, c in enumerate(keep)), only_base(F.col("base")).alias("base"), "found")


def redact(df: DataFrame) -> DataFrame:
    """The rows with ``[KIND]`` in ``text`` for every span found; of overlapping spans the one that starts first, then the longest."""
    keep = df.columns
    found = find(df)
    order = F.array_sort(F.transform("found", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["n"].alias("n"))))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], gap, F.element_at(names, s["n"] + 1)).alias("out"))
        return F.when(s["start"] >= acc["at"], new).otherwise(acc)

    whole = F.aggregate(order, start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    return found.withColumn("text", F.when(F.size("found") > 0, whole).otherwise(F.col("text"))).select(*keep)


def written(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["n"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """One row per row, null ids and repeated rows included; null and empty texts have no span and the hash of the empty string."""
    narrow = cut_lineage(measured(df))
    both = with_new(narrow.drop("tokens"), discover(narrow))
    counts = [F.size(F.filter("base", (lambda n: lambda s: s["n"] == n)(n))).cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE])]
    return both.select("doc_id", *counts, F.sha2(written(only_base(F.col("base"))), 256).alias("base_sha256"), written(F.col("found")).alias("spans"), F.size("found").cast("long").alias("n_spans"))
