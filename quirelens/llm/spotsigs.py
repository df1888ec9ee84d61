"""Document fingerprints by spot signatures: common-word anchors and the content words that follow them.

An anchor is a very common word. Its chain is the next ``CHAIN`` content words behind it (words that are no anchors).
The fingerprint is the set of the chains' hashes, written as sorted 8-digit hexadecimal numbers. Two fingerprints are
compared by Jaccard similarity; near duplicates need sets of similar length, so candidates are partitioned by set
length and pairs whose lengths already exclude the threshold are never compared.

Built-in functions only: a text without its anchors' neighbours never leaves the JVM, no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.runtime import cut_lineage

#: Anchors: articles, prepositions and forms of "to be" of four languages (fixed values).
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "al con de del el en es la las los no para por que se su un una y "
    "au aux avec dans des du elle est et il le les ne pas pour qui sur une "
    "als auf das dem den der die ein eine ist mit nicht sich und von zu"
).split()
CHAIN = 3
SIMILARITY = 0.8
#: Rows of a run of neighbouring ids at least, runs at most, and quantiles of the ids that place them.
RUN_ROWS, MAX_RUNS, QUANTILES = 500, 200_000, 64
MARK = "\x01"


def _anchor_pattern() -> str:
    """The anchors as alternatives by first letter, so that most words are turned down at one comparison."""
    by: dict[str, list[str]] = {}
    for a in sorted(set(ANCHORS), key=lambda w: (w[0], -len(w), w)):
        by.setdefault(a[0], []).append(a[1:])
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


def signatures(text: Column) -> Column:
    """Hashes (sorted array of non-negative 32-bit numbers) of the distinct chains of a text.

    Words are runs of letters and digits in lower case. A chain is the next CHAIN content words behind an anchor, any
    anchors between them left out. A text without a whole chain gives the hashes of its single words, a text without
    words (or null) none.
    """
    spaced = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    # an anchor and the blank behind it become one mark before the next word
    marked = F.regexp_replace(spaced, r"(?<![^ " + MARK + "])" + _anchor_pattern() + " ", MARK)
    chains = F.regexp_extract_all(marked, F.lit(f"{MARK}(?=((?:{MARK}*+[^ {MARK}]++ ){{{CHAIN}}}))"), F.lit(1))
    plain = F.transform(chains, lambda c: F.translate(c, MARK, ""))
    words = F.array_remove(F.split(spaced, " +"), "")
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 32))
    return F.array_sort(F.array_distinct(F.transform(F.when(F.size(plain) > 0, plain).otherwise(words), number)))


def fingerprint(signature: Column) -> Column:
    """The set as text: 8 hexadecimal digits per number."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sorted sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _run_of(doc_id: Column, cuts: list[int], per_cut: int) -> Column:
    """Number of the run that an id falls into, rising with the id; null ids fall below all."""
    if len(cuts) < 2:
        return F.when(doc_id.isNull(), -1).otherwise(0).cast("long")
    lows = F.array(*(F.lit(c).cast("long") for c in cuts))
    part = F.least(F.size(F.filter(lows, lambda c: c <= doc_id)), F.lit(len(cuts) - 1))
    low, high = F.element_at(lows, part), F.element_at(lows, part + 1)
    inside = F.floor((doc_id - low).cast("double") / F.greatest(high - low, F.lit(1)) * per_cut)
    return F.when(doc_id.isNull(), -1).otherwise((part - 1) * per_cut + F.least(F.greatest(inside, F.lit(0)), F.lit(per_cut - 1))).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, sig, next_text, next_sig: each row beside the one that follows in descending doc_id (behind the last: the first).

    Rows are dealt by runs of neighbouring ids, whose places come from quantiles of the ids, so texts move once and no
    task gets more than its runs. The first row of each run also stands, alone, for the row before it in the run above.
    Null ids come last, equal ids in the order of their text's hash; a null text is empty. A single row follows itself.
    """
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000).alias("q")).first()
    runs = max(1, min(MAX_RUNS, ids["n"] // RUN_ROWS))
    cuts = sorted(set(ids["q"] or []))
    run = _run_of(F.col("doc_id"), cuts if runs > 1 else [], max(1, runs // QUANTILES))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("run", run).withColumn("h", F.xxhash64("text"))
    first = F.struct(F.col("doc_id").isNotNull().alias("has"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    heads = rows.groupBy("run").agg(F.max_by("text", first).alias("head_text"))
    # at most MAX_RUNS + 1 numbers
    order = heads.select("run").withColumn("above", F.lag("run").over(Window.orderBy("run")))
    order = order.withColumn("above", F.coalesce("above", F.max("run").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = order.select(F.col("run").alias("r"), "above").join(heads.withColumnRenamed("run", "of"), F.col("above") == F.col("of")).select("r", "head_text")
    w = Window.partitionBy("run").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    dealt = rows.repartition("run").withColumn("sig", signatures(F.col("text")))
    led = dealt.withColumn("next", F.lead(F.struct("text", "sig")).over(w))
    joined = led.join(heads, F.col("run") == F.col("r"), "left").withColumn("last", F.col("next").isNull())
    return joined.select("doc_id", "text", "sig", F.when(F.col("last"), F.col("head_text")).otherwise(F.col("next.text")).alias("next_text"), F.when(F.col("last"), signatures(F.col("head_text"))).otherwise(F.col("next.sig")).alias("next_sig"))


def digest(docs: DataFrame) -> DataFrame:
    """Every document beside its edited text and the next document (descending id); a null text counts as empty, an only document is its own next."""
    rows = with_next(docs).withColumn("n_chars", F.char_length("text"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - third), F.substring(F.col("next_text"), F.lit(1), third)))
    rows = rows.withColumn("edited_sig", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members maps every doc_id to the class of its fingerprint (the smallest id that has it; null ids
    and empty fingerprints are left out), pairs (a, b, similarity) links classes at ``similarity`` or more, a < b.

    Classes are dealt by set length: a class meets only classes of its own and the next length band, bands being so
    wide that no pair lies further apart, and only over the lowest numbers of its set, one of which two similar sets share.
    """
    own = docs.where("doc_id IS NOT NULL").select("doc_id", signatures(F.col("text")).alias("sig")).where(F.size("sig") > 0)
    own = own.withColumn("f1", F.xxhash64("sig")).withColumn("f2", F.xxhash64(F.lit("2"), F.col("sig")))
    classes = own.groupBy("f1", "f2").agg(F.min("doc_id").alias("class"), F.first("sig").alias("sig"))
    classes = cut_lineage(classes)
    members = own.select("doc_id", "f1", "f2").join(classes.select("f1", "f2", "class"), ["f1", "f2"]).select("doc_id", "class")
    size = F.size("sig")
    band = F.floor(F.log(size.cast("double")) / F.log(F.lit(1 / similarity)) + 1e-9)
    first = size - F.ceil(similarity * size - 1e-9).cast("int") + 1
    marks = classes.select("class", size.alias("n"), band.alias("band"), F.explode(F.slice("sig", F.lit(1), first)).alias("mark"))
    a = marks.select(F.col("class").alias("a"), F.col("n").alias("na"), F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"), "mark", F.col("band").alias("own_a"))
    b = marks.select(F.col("class").alias("b"), F.col("n").alias("nb"), "band", "mark")
    near = (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9) & ((F.col("own_a") < F.col("band")) | (F.col("a") < F.col("b")))
    found = a.join(b, ["mark", "band"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sets = classes.select("class", "sig")
    scored = found.join(sets.select(F.col("class").alias("a"), F.col("sig").alias("sa")), "a").join(sets.select(F.col("class").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = scored.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)
    return members, pairs
