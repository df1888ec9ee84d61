"""Spelling variants: words one edit apart, found through variable-length grams, and the most frequent form of each.

The gram dictionary holds heads and tails of words by length: a gram is kept for a length where at most ``RARE`` words of that length,
one more or one less have it, and of a word's heads (tails) the shortest kept one is its variable gram. One edit touches at most one of two grams that do not overlap, so a word whose head
and tail fit into it side by side has an affected-gram bound of 1 in 2: every near word shares the head or the tail, and merging
those two lists (at most ``2 * RARE`` words) finds it. Where they do not fit, one edit may touch all rare grams and the bound is
0; pairs of two such words are met by a gapped gram instead, the whole word but one code point. All pairs found are verified.

Defined results: a null text has no words; repeated rows count again; a null doc_id is the empty string in the hash that picks
deletions; an empty table gives no rows. Other columns are ignored. Words may have any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelens.llm import bytescan
from quirelens.runtime import cut_lineage

MIN_LENGTH, MIN_COUNT = 5, 3
#: A deletion is planted where the hash of document and word is a multiple of this (part of the contract).
PLANT = 97
#: Lists of the gram dictionary (of three lengths) hold at most this many words; its grams are of MIN_GRAM to MAX_GRAM code points.
RARE, MIN_GRAM, MAX_GRAM = 256, 3, 16
#: Different words that a worker counts before it hands them on.
HELD_WORDS = 100_000
RUN = re.compile("[a-zÀ-ÿ]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, plant: int | None = PLANT) -> DataFrame:
    """(w, n): the words of all texts with their occurrences; ``plant`` deletes a code point where the hash says so (None: never)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"w": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                value = text.as_py()
                if not value:
                    continue
                seed = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for word, k in Counter(RUN.findall(value.encode().translate(LOWER).decode())).items():
                    if plant is not None:
                        h = zlib.crc32(word.encode(), seed)
                        if h % plant == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= min_length:
                        held[word] += k
                if len(held) >= HELD_WORDS:
                    yield hand_on()
        if held:
            yield hand_on()
        bytescan.give_back()

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text").where("text IS NOT NULL")
    return texts.mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def grams(words: DataFrame, *carried: str) -> DataFrame:
    """(side, gram, *carried): heads (side 0) and tails (side 1) of ``words`` (w, len, ...)."""
    sizes = F.sequence(F.lit(MIN_GRAM), F.least(F.col("len") - 2, F.lit(MAX_GRAM)))
    both = F.flatten(F.transform(sizes, lambda e: F.array(F.struct(F.lit(0).alias("side"), F.substring("w", F.lit(1), e).alias("gram")), F.struct(F.lit(1).alias("side"), F.substring("w", F.col("len") - e + 1, e).alias("gram")))))
    return words.select(*carried, F.explode(both).alias("g")).select("g.side", "g.gram", *carried)


def decomposed(words: DataFrame) -> DataFrame:
    """``words`` (wid, w, len, n) with the variable grams ``head`` and ``tail``: both null where the bound of the word is 0."""
    lists = grams(words, "len").groupBy("side", "gram", "len").agg(F.count(F.lit(1)).alias("n_words"))
    reach = Window.partitionBy("side", "gram").orderBy("len").rangeBetween(-1, 1)  # one row a length
    dictionary = lists.withColumn("met", F.sum("n_words").over(reach)).where(F.col("met") <= RARE).select("side", "gram", "len")
    own = grams(words, "wid", "len").join(dictionary, ["side", "gram", "len"])
    size = F.char_length("gram")
    shortest = own.groupBy("wid").agg(F.min(F.when(F.col("side") == 0, size)).alias("h"), F.min(F.when(F.col("side") == 1, size)).alias("t"))
    full = words.join(shortest, "wid", "left")
    # any cut between the two serves; the middle one has the shortest lists
    cut = F.greatest("h", F.least(F.floor(F.col("len") / 2).cast("int"), F.col("len") - F.col("t")))
    fits = F.col("h") + F.col("t") <= F.col("len")  # null without a rare head or tail
    head = F.when(fits, F.substring("w", F.lit(1), F.least(cut, F.lit(MAX_GRAM))))
    rest = F.least(F.col("len") - cut, F.lit(MAX_GRAM))
    return full.select("wid", "w", "len", "n", head.alias("head"), F.when(fits, F.substring("w", F.col("len") - rest + 1, rest)).alias("tail"))


def one_edit(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b, 1) == 1


def near_by_grams(words: DataFrame) -> DataFrame:
    """(wid, near_w, near_n): pairs with at least one word of a bound above 0, both ways, each once."""
    probes = words.where("head IS NOT NULL")
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("head").alias("gram")), F.struct(F.lit(1).alias("side"), F.col("tail").alias("gram")))
    probes = probes.select(F.explode(sides).alias("g"), F.col("wid").alias("pid"), F.col("w").alias("pw"), F.col("len").alias("plen"), F.col("n").alias("pn"), F.col("head").alias("phead"))
    reach = F.explode(F.array(F.col("plen") - 1, F.col("plen"), F.col("plen") + 1)).alias("len")
    probes = probes.select("g.side", "g.gram", reach, "pid", "pw", "pn", "phead")
    index = grams(words.withColumn("open", F.col("head").isNull()), "wid", "w", "len", "n", "open")
    again = (F.col("side") == 1) & F.col("w").startswith(F.col("phead"))  # the head's list has the pair already
    met = probes.join(index, ["side", "gram", "len"]).where((F.col("pid") != F.col("wid")) & ~again & one_edit(F.col("pw"), F.col("w")))
    # a near word that probes itself gives the other direction
    there = F.struct(F.col("pid").alias("wid"), F.col("w").alias("near_w"), F.col("n").alias("near_n"))
    back = F.struct("wid", F.col("pw").alias("near_w"), F.col("pn").alias("near_n"))
    return met.select(F.explode(F.when(F.col("open"), F.array(there, back)).otherwise(F.array(there))).alias("p")).select("p.*")


def gapped(words: DataFrame) -> DataFrame:
    """(h, cut, len, lead, wid): hashes of each word (cut -1) and of the word without its code point at ``cut``; lead marks the first of equal neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("wid").to_numpy(zero_copy_only=False)
            for first, end, data, at in bytescan.text_steps(batch, "w"):
                prefix = bytescan.prefix_hash(data)
                _, down = bytescan.powers(len(data) + 1)
                s = np.flatnonzero((data & 0xC0) != 0x80)  # code points
                e = np.append(s[1:], len(data))
                row = np.searchsorted(at, s, side="right") - 1
                lo, hi = at[row], at[row + 1]
                left = (prefix[s] - prefix[lo]) * down[lo]
                right = (prefix[hi] - prefix[e]) * down[lo + e - s]
                h = bytescan.mix(left + right + (hi - lo - (e - s)).astype(np.uint64))
                whole = bytescan.mix((prefix[at[1:]] - prefix[at[:-1]]) * down[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
                n_rows = end - first
                starts = np.searchsorted(row, np.arange(n_rows))
                cut = np.arange(len(s)) - starts[row]
                length = np.bincount(row, minlength=n_rows)
                code = prefix_code(data, s, e)
                lead = np.ones(len(s), bool)
                lead[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": np.concatenate([h, whole]).view(np.int64),
                        "cut": np.concatenate([cut, np.full(n_rows, -1)]).astype(np.int32),
                        "len": np.concatenate([length[row], length]).astype(np.int32),
                        "lead": np.concatenate([lead, np.ones(n_rows, bool)]),
                        "wid": np.concatenate([ids[first:end][row], ids[first:end]]),
                    }
                )

    return words.select("wid", "w").mapInArrow(scan, "h long, cut int, len int, lead boolean, wid long")


def prefix_code(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """One number per code point (of at most four bytes)."""
    code = np.zeros(len(s), np.int64)
    for k in range(4):
        has = s + k < e
        code[has] = code[has] * 256 + data[s[has] + k]
    return code


def near_by_gaps(words: DataFrame) -> DataFrame:
    """(wid, near_w, near_n): pairs of words that both have a bound of 0, both ways, each once.

    A group shares all but one code point at one place, so it has at most as many words as there are letters, times the length.
    """
    keys = gapped(words.where("head IS NULL"))
    a, b = keys.alias("a"), keys.alias("b")
    replaced = (F.col("a.cut") >= 0) & (F.col("a.cut") == F.col("b.cut")) & (F.col("a.len") == F.col("b.len"))
    shorter = (F.col("a.cut") == -1) & (F.col("b.cut") >= 0) & F.col("b.lead") & (F.col("b.len") == F.col("a.len") + 1)
    longer = (F.col("b.cut") == -1) & (F.col("a.cut") >= 0) & F.col("a.lead") & (F.col("a.len") == F.col("b.len") + 1)
    pairs = a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.wid") != F.col("b.wid")) & (replaced | shorter | longer)).select(F.col("a.wid").alias("wid"), F.col("b.wid").alias("other"))
    mine, theirs = words.select("wid", "w"), words.select(F.col("wid").alias("other"), F.col("w").alias("near_w"), F.col("n").alias("near_n"))
    return pairs.join(theirs, "other").join(mine, "wid").where(one_edit(F.col("w"), F.col("near_w"))).select("wid", "near_w", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(w, root) for the words that have a form (w, form): forms followed to the last by pointer doubling.

    A form occurs twice as often as its word, so chains have at most log2 of the largest count and the rounds its log2.
    """
    at = cut_lineage(forms.select("w", F.col("form").alias("root")))
    while True:
        jump = at.select(F.col("w").alias("root"), F.col("root").alias("far"))
        moved = cut_lineage(at.join(jump, "root", "left").select("w", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")))
        at = moved.select("w", "root")
        if moved.where("went").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, plant: int | None = PLANT) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of ``docs`` (doc_id, text) with its near words.

    form is the near word of the largest count (ties: the smallest), where that is at least twice the word's; root follows forms.
    Words have at least four code points (the variable grams ask for it).
    """
    if min_length < 4:
        raise ValueError("words shorter than four code points have no two grams side by side")
    counted = word_counts(docs, min_length, min_count, plant)
    words = cut_lineage(counted.select(F.monotonically_increasing_id().alias("wid"), "w", F.char_length("w").alias("len"), "n"))
    words = cut_lineage(decomposed(words))
    near = near_by_grams(words).unionByName(near_by_gaps(words))
    best = near.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("neg"), F.col("near_w").alias("w"))).alias("best"))
    joined = words.join(best, "wid", "left")
    has = -F.col("best.neg") >= 2 * F.col("n")
    told = cut_lineage(joined.select("w", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.neg")).alias("form_n")))
    last = roots(told.where("form IS NOT NULL"))
    return told.join(last, "w", "left").select(F.col("w").alias("word"), "form", F.coalesce("root", "w").alias("root"), "n", "n_near", "form_n")
