"""Removal of repeated byte strings by bucket-pointer refinement over kept suffixes.

Every byte that a ``WIDTH``-byte string covers which also starts earlier (smaller doc_id, or same document and earlier
start) is removed. A document is a distinct (doc_id, text), known by (d, t): the id and a hash that also tells texts of one id
apart. Equal rows are one document, so their equal suffixes are one suffix and never repeat each other.

Suffixes are put into buckets by their first bytes, and buckets are refined by the bucket numbers that stand at later
offsets: the number of the first 2k bytes comes from the pair (number at i, number at i + k), both of the pass before. From
``Q`` bytes on two passes settle ``WIDTH`` bytes, and no pass reads the text again.

1. Initial buckets. Of each WIDTH-byte window only one suffix is kept, the one with the smallest GRAM-byte hash in it
   (leftmost of equal ones). Equal windows keep the same suffix, so no match is lost, and about 3 % of the suffixes
   stay. Their bucket is the hash of those bytes; equal strings have equal numbers wherever they stand.
2. Refinement over the cluster. A kept suffix answers for a run of windows. Inside a bucket suffixes are sorted by the
   refined numbers at the first and the last of these windows, then by position: all but the first of a number
   are repeats as a whole, and buckets with one number need no more work. These numbers are hashes of the pairs, so
   that tasks name equal pairs alike without an exchange for each pass.
3. Refinement of open buckets. In the buckets left, every offset of the first suffixes of a number gets the rank of its
   Q bytes; each pass sorts by (rank, rank at the later offset), and the new ranks are what the next pass sorts by. All
   but the first window of a last rank are repeats.

Only narrow rows are sorted over the cluster. Stretches of step 3 are a few hundredths of the text; a bucket with more than
``MAX_BUCKET`` of them goes on by single windows, each its own key (the refined number of step 2), so it spreads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from quirelens.llm import bytescan as bs

WIDTH, GRAM = 100, 32
#: Bytes of the initial numbers that are refined: WIDTH is Q doubled twice.
Q = 25
PASSES = (Q, 2 * Q)
MAX_BUCKET = 2_000
#: Stand-in for a null doc_id: before all others.
FIRST = -(1 << 63)
#: Bytes of stretches that one vectorised step of the last refinement takes.
STEP = 4_000_000


def number_of(pair: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Number of the refined bucket that two numbers, an own one and a later offset's, lead to; equal pairs, equal numbers."""
    own, later = pair
    return bs.mix(own * np.uint64(bs.BASE) + later)


def refined_at(prefix: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers of the WIDTH-byte windows that start at ``at``, refined from those of Q bytes at the offsets they need."""
    level = [bs.span_hash(prefix, at + k, at + k + Q) for k in range(0, WIDTH, Q)]
    while len(level) > 1:
        level = [number_of(pair) for pair in zip(level[::2], level[1::2], strict=True)]
    return level[0]


def refined_all(data: np.ndarray) -> np.ndarray:
    """Numbers of all WIDTH-byte windows of ``data``, each pass over the numbers of the last."""
    at = np.arange(max(len(data) - Q + 1, 0))
    number = bs.span_hash(bs.prefix_hash(data), at, at + Q)
    for k in PASSES:
        number = number_of((number[:-k], number[k:]))
    return number


def refined_ranks(data: np.ndarray) -> np.ndarray:
    """Ranks instead of numbers: sort the Q-byte buckets, then by (own rank, rank at the later offset), reusing each pass's ranks.

    Ranks hold for this array only; windows that run over the end of a stretch get one as well, which nobody asks for.
    """
    at = np.arange(max(len(data) - Q + 1, 0))
    rank = np.unique(bs.span_hash(bs.prefix_hash(data), at, at + Q), return_inverse=True)[1].astype(np.int64)
    for k in PASSES:
        # a rank is below the array's length, so a pair fits into 64 bits for arrays below 2**31
        rank = np.unique(rank[:-k] * np.int64(len(data)) + rank[k:], return_inverse=True)[1].astype(np.int64)
    return rank


def kept_suffixes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, place of the suffix in the first window, bucket, stretch number) per kept suffix."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    n = len(data)
    if n < WIDTH:
        return none
    prefix = bs.prefix_hash(data)
    at = np.arange(n - GRAM + 1)
    gram = bs.span_hash(prefix, at, at + GRAM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(np.arange(n) + WIDTH <= offsets[1:][row])
    if not len(starts):
        return none
    windows = sliding_window_view(gram, WIDTH - GRAM + 1)
    chosen = np.concatenate([windows[starts[k : k + 50_000]].argmin(axis=1) + starts[k : k + 50_000] for k in range(0, len(starts), 50_000)])
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    head = np.flatnonzero(new)
    first, suffix = starts[head], chosen[head]
    count = np.diff(np.append(head, len(starts)))
    # a stretch is shorter than two windows, so its first and its last one cover it
    shape = (count.astype(np.uint64) << np.uint64(8)) | (suffix - first).astype(np.uint64)
    stretch = number_of((number_of((refined_at(prefix, first), refined_at(prefix, first + count - 1))), shape))
    return row[first], first - offsets[row[first]], count, suffix - first, gram[suffix], stretch


def merged(d: np.ndarray, t: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of intervals per document (d, t)."""
    if not len(d):
        return d, t, start, end
    order = np.lexsort((start, t, d))
    d, t, start, end = d[order], t[order], start[order], end[order]
    # running maximum of ends inside a document: lift each document above the one before
    lift = (np.cumsum(np.append(0, (d[1:] != d[:-1]) | (t[1:] != t[:-1])))).astype(np.int64) << 40
    reach = np.maximum.accumulate(end + lift)
    new = np.ones(len(d), bool)
    new[1:] = start[1:] + lift[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:] - 1, len(d) - 1)
    return d[head], t[head], start[head], reach[last] - lift[last]


def once(*columns: np.ndarray) -> np.ndarray:
    """Places of the first of each run of equal rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def pack_suffix(first, place, count):
    return (first.astype(np.int64) << 16) | (place.astype(np.int64) << 8) | count.astype(np.int64)


def pack_cover(start, end):
    """Negative: a stretch that is known to repeat."""
    return -1 - ((start.astype(np.int64) << 31) | (end - start).astype(np.int64))


def suffix_rows(docs: DataFrame) -> DataFrame:
    """(h: bucket, seg: stretch number, d, t: document, p: packed place) of the kept suffixes, repeats inside a batch taken out.

    Of suffixes of one batch with equal numbers only the first goes on; the others are written as known repeats. Suffixes
    that equal rows share are written once.
    """

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for lo, hi, data, offsets in bs.text_steps(batch, "text"):
                row, first, count, place, h, seg = kept_suffixes(data, offsets)
                d, t = (x[lo:hi][row] if len(row) else np.zeros(0, np.int64) for x in (ids, hashes))
                order = np.lexsort((first, t, d, seg, h))
                order = order[once(*(x[order] for x in (first, t, d, seg, h)))]
                first, count, place, h, seg, d, t = (x[order] for x in (first, count, place, h, seg, d, t))
                same = np.zeros(len(h), bool)
                same[1:] = (h[1:] == h[:-1]) & (seg[1:] == seg[:-1])
                cd, ct, cs, ce = merged(d[same], t[same], first[same], first[same] + count[same] - 1 + WIDTH)
                go = ~same
                fill = bs.mix(ct.astype(np.uint64) * np.uint64(31) + cs.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([h[go].view(np.int64), fill])),
                        pa.array(np.concatenate([seg[go].view(np.int64), np.zeros(len(cd), np.int64)])),
                        pa.array(np.concatenate([d[go], cd]).astype(np.int64)),
                        pa.array(np.concatenate([t[go], ct]).astype(np.int64)),
                        pa.array(np.concatenate([pack_suffix(first[go], place[go], count[go]), pack_cover(cs, ce)])),
                    ],
                    ["h", "seg", "d", "t", "p"],
                )

    return docs.select("d", "t", "text").mapInArrow(run, "h bigint, seg bigint, d bigint, t bigint, p bigint")


def stretches(joined: DataFrame) -> DataFrame:
    """(key, d, t, p, bytes) for step 3: the stretch of each open suffix, or, for a large bucket, its single windows (bytes null).

    Equal rows of a batch give theirs once; step 3 passes over what is left of them.
    """

    names = ["key", "d", "t", "p", "raw"]

    def batch_of(key, d, t, p, raw):
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (key, d, t, p)), pa.array(raw, pa.binary())], names)

    def run(batches):
        for batch in batches:
            own = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            texts = batch.column(3).cast(pa.binary()).to_pylist()
            seen = set()
            key, d, t, p, raw, size = [], [], [], [], [], 0
            for i, text, items in zip(own, texts, batch.column(4).to_pylist(), strict=True):
                if not items or i in seen:
                    continue
                seen.add(i)
                for item in items:
                    if item["p"] < 0 or item["h"] is None:
                        continue
                    first, count = item["p"] >> 16, item["p"] & 255
                    part = (text or b"")[first : first + count - 1 + WIDTH]
                    if item["big"]:
                        number = refined_all(np.frombuffer(part, np.uint8))
                        s = np.arange(len(number))
                        key += number.view(np.int64).tolist()
                        d += [i[0]] * len(s)
                        t += [i[1]] * len(s)
                        p += (first + s).tolist()
                        raw += [None] * len(s)
                    else:
                        key.append(item["h"])
                        d.append(i[0])
                        t.append(i[1])
                        p.append(item["p"])
                        raw.append(part)
                    size += len(part)
                if size > STEP:
                    yield batch_of(key, d, t, p, raw)
                    key, d, t, p, raw, size = [], [], [], [], [], 0
            yield batch_of(key, d, t, p, raw)

    # all columns of the join, so that its exchange of texts is the same as the last step's and is written once
    return joined.select("doc_id", "d", "t", "text", "items").mapInArrow(run, "key bigint, d bigint, t bigint, p bigint, raw binary")


def split_windows(keys: np.ndarray, d: np.ndarray, t: np.ndarray, p: np.ndarray, raw: list) -> tuple[np.ndarray, ...]:
    """Step 3 for whole buckets: (d, t, start, end) of repeated windows, merged."""
    whole = np.array([x is not None for x in raw], bool)
    # single windows come with their number as key; ranks and numbers are told apart
    numbers, ranked, ids, texts, starts = [keys[~whole]], [np.zeros(np.count_nonzero(~whole), bool)], [d[~whole]], [t[~whole]], [p[~whole]]
    if whole.any():
        parts = [x for x in raw if x is not None]
        size = np.array([len(x) for x in parts], np.int64)
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = np.cumsum(size) - size
        count = np.maximum(size - WIDTH + 1, 0)
        which = np.repeat(np.arange(len(parts)), count)
        step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        numbers.append(refined_ranks(data)[at[which] + step])
        ranked.append(np.ones(len(which), bool))
        ids.append(d[whole][which])
        texts.append(t[whole][which])
        starts.append((p[whole] >> 16)[which] + step)
    rows = [np.concatenate(x) for x in (starts, texts, ids, numbers, ranked)]
    order = np.lexsort(rows)
    order = order[once(*(x[order] for x in rows))]
    starts, texts, ids, numbers, ranked = (x[order] for x in rows)
    again = np.zeros(len(numbers), bool)
    again[1:] = (numbers[1:] == numbers[:-1]) & (ranked[1:] == ranked[:-1])
    return merged(ids[again], texts[again], starts[again], starts[again] + WIDTH)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(d, t, s, e) from the rows of :func:`stretches`, bucket by bucket."""

    def run(batches):
        held: list[tuple] = []

        def flush(upto: int | None):
            """Hand over the buckets that are complete: all rows, or those before the last key."""
            nonlocal held
            keys, d, t, p = (np.concatenate([x[k] for x in held]) for k in range(4))
            raw = [y for x in held for y in x[4]]
            cut = len(keys) if upto is None else int(np.searchsorted(keys, keys[-1], side="left"))
            held = [(keys[cut:], d[cut:], t[cut:], p[cut:], raw[cut:])]
            if upto is not None and cut == 0 and raw and raw[0] is None:
                # a very long run of one window: its first row stays, the others that are not that window again are repeats already
                held = [(keys[:1], d[:1], t[:1], p[:1], raw[:1])]
                again = (d != d[0]) | (t != t[0]) | (p != p[0])
                return merged(d[again], t[again], p[again], p[again] + WIDTH)
            return split_windows(keys[:cut], d[:cut], t[:cut], p[:cut], raw[:cut])

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["d", "t", "s", "e"])

        size = 0
        for batch in batches:
            raw = batch.column(4).to_pylist()
            held.append((*(batch.column(k).to_numpy() for k in range(4)), raw))
            size += sum(len(x) + 32 if x else 32 for x in raw)
            if size > STEP:
                found = flush(1)
                size = sum(len(x) + 32 if x else 32 for x in held[0][4])
                yield batch_of(found)
        if held:
            yield batch_of(flush(None))

    return rows.repartition("key").sortWithinPartitions("key", "d", "t", "p").mapInArrow(run, "d bigint, t bigint, s bigint, e bigint")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d, t, text: d puts documents in the order of their ids, t tells the texts of one id apart; below 0 without an id."""
    text = F.coalesce("text", F.lit(""))
    own = F.shiftrightunsigned(F.xxhash64(text, F.col("doc_id")), 1)
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).cast("long").alias("d"), F.when(F.col("doc_id").isNull(), -1 - own).otherwise(own).alias("t"), text.alias("text"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row of ``docs`` (doc_id, text).

    Null texts are empty; a null doc_id comes before all others. Rows that repeat an id with the same text are one
    document and get its result; different texts of one id, or without an id, are documents of their own, in the order of
    their hashes. Columns beyond the two are ignored. An empty table gives an empty table.
    """
    own = keyed(docs)
    rows = suffix_rows(own).repartition("h")
    by = Window.partitionBy("h").orderBy("seg", "d", "t", "p")
    marked = rows.withColumn("head", (F.lag("seg").over(by).isNull() | (F.lag("seg").over(by) != F.col("seg"))).cast("int"))
    marked = marked.withColumn("again", F.coalesce(F.lag(F.struct("seg", "d", "t", "p")).over(by) == F.struct("seg", "d", "t", "p"), F.lit(False)))
    marked = marked.withColumn("numbers", F.sum("head").over(Window.partitionBy("h"))).where("NOT again")
    cover = F.when(F.col("p") < 0, F.col("p")).when(F.col("head") == 0, -1 - (F.shiftleft(F.shiftright("p", 16), 31) + F.col("p").bitwiseAND(255) - 1 + WIDTH))
    open_ = (F.col("p") >= 0) & (F.col("head") == 1) & (F.col("numbers") > 1)
    items = marked.where((F.col("p") < 0) | (F.col("head") == 0) | open_).select("d", "t", F.struct(F.when(cover.isNull(), F.col("h")).alias("h"), F.coalesce(cover, F.col("p")).alias("p"), (F.col("numbers") > MAX_BUCKET).alias("big")).alias("item"))
    per_doc = items.groupBy("d", "t").agg(F.collect_set("item").alias("items"))  # at most a text's length
    joined = own.join(per_doc, ["d", "t"], "left").select("doc_id", "d", "t", "text", "items")
    late = repeated_windows(stretches(joined)).groupBy(F.col("d").alias("_d"), F.col("t").alias("_t")).agg(F.collect_list(F.struct("s", "e")).alias("late"))
    both = joined.join(late, (F.col("d") == F.col("_d")) & (F.col("t") == F.col("_t")), "left").select("doc_id", "text", F.transform(F.filter("items", lambda x: x["p"] < 0), lambda x: x["p"]).alias("covers"), "late")
    id_field = docs.schema["doc_id"]

    def run(batches):
        for batch in batches:
            sizes, gone, spans, kept = [], [], [], []
            for text, covers, late in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or b""
                packed = np.array([-1 - c for c in covers or ()], np.int64)
                s = np.concatenate([packed >> 31, np.array([x["s"] for x in late or ()], np.int64)])
                e = np.concatenate([(packed >> 31) + (packed & ((1 << 31) - 1)), np.array([x["e"] for x in late or ()], np.int64)])
                _, _, s, e = merged(np.zeros(len(s), np.int64), np.zeros(len(s), np.int64), s, e)
                e = np.minimum(e, len(text))
                ok = s < e
                s, e = s[ok].tolist(), e[ok].tolist()
                at, out = 0, []
                for a, b in zip(s, e, strict=True):
                    out.append(text[at:a])
                    at = b
                out.append(text[at:])
                sizes.append(len(text))
                gone.append(sum(e) - sum(s))
                spans.append(len(s))
                kept.append(b"".join(out))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, StructType([id_field, *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())]))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and the hash of what :func:`remove_repeats` keeps; null and empty texts have 0 bytes and the hash of the empty string."""
    out = remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
