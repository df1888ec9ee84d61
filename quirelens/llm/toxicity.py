"""Toxicity: a linear-chain conditional random field tags toxic tokens; documents get scores from its marginals.

1. Labelled tokens. Document labels are turned into token labels: terms (words, and word beginnings of four to
   eight letters) that stand almost only in toxic texts are counted over the labelled sample, and a greedy cover keeps those
   that explain toxic documents which few kept terms explain yet. A token that such a term fits is labelled toxic.
2. The field has two states over chains of up to ``CHAIN`` tokens and hashed features of the token (the word and its
   beginnings), fitted on ``MAX_WINDOWS`` windows by full-batch gradient ascent with forward-backward.
3. Scoring reads whole texts: forward-backward marginals of every token; the document's score is the largest marginal,
   and tokens at 0.5 or more are reported as offending offsets.

Only the text is an input. The labelled sample is bounded by ``MAX_DOCS`` documents of each class, taken by hash.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelens.llm import bytescan as bs

MAX_DOCS, MAX_WINDOWS, CHAIN = 5_000, 16_000, 64
DIMS = 1 << 17
MIN_SUPPORT, MIN_PRECISION, MAX_TERMS, CANDIDATES = 0.004, 0.97, 300, 2_000
STARTS = (4, 5, 6, 7, 8)
#: Terms that each toxic text of the sample is to be explained by.
COVER = 3
THRESHOLD = 0.3
ROUNDS, RATE, L2 = 60, 0.5, 1e-5


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training; null for a null id, and such a row is not trained on either."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2


def terms_of(word: str) -> list[str]:
    return [f"w:{word}", *(f"{k}:{word[:k]}" for k in STARTS if len(word) >= k)]


def trim(token: str) -> str:
    """Lower case, without what is no letter at both ends."""
    low = token.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalpha():
        a += 1
    while b > a and not low[b - 1].isalpha():
        b -= 1
    return low[a:b]


def term_column(text: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"), F.lit(1)))

    def starts(size: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= size), lambda w: F.concat(F.lit(f"{size}:"), F.substring(w, 1, size)))

    return F.array_distinct(F.flatten(F.array(F.transform(words, lambda w: F.concat(F.lit("w:"), w)), *map(starts, STARTS))))


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, text, toxic): at most about MAX_DOCS texts of each class, never a held-out one; equal texts once."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in own.groupBy("toxic").count().collect()}  # two rows
    spread = 1 << 24
    part = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(spread))
    limit = F.when(F.col("toxic") == 1, int(spread * min(1.0, MAX_DOCS / max(counts.get(1, 1), 1)))).otherwise(int(spread * min(1.0, MAX_DOCS / max(counts.get(0, 1), 1))))
    chosen = own.where(part < limit).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # bounded by MAX_DOCS of each class
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")
    return found.groupBy(F.xxhash64("text").alias("id")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def learn_terms(sample: DataFrame, totals: dict[int, int]) -> list[str]:
    """Terms that mark toxic texts: precise ones by support, then a greedy cover of the sample's toxic texts."""
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return []
    each = sample.select("id", "toxic", F.explode(term_column(F.col("text"))).alias("term"))
    rate = lambda c, n: (c + 1.0) / n
    stats = each.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    good = stats.where((F.col("t") >= max(3, int(MIN_SUPPORT * n1))) & (F.col("t") / n1 / (F.col("t") / n1 + rate(F.col("c"), n0)) >= MIN_PRECISION))
    top = good.orderBy(F.desc("t"), F.desc(F.length("term")), "term").limit(CANDIDATES).select("term")
    postings = each.where("toxic = 1").join(F.broadcast(top), "term").select("term", "id").toArrow()  # at most CANDIDATES terms of MAX_DOCS texts
    by: dict[str, set[int]] = {}
    for term, i in zip(postings["term"].to_pylist(), postings["id"].to_pylist(), strict=True):
        by.setdefault(term, set()).add(i)
    kept: list[str] = []
    lacks = {i: COVER for ids in by.values() for i in ids}
    least = max(3, int(MIN_SUPPORT * n1))
    while by and len(kept) < MAX_TERMS:
        gain = {t: sum(lacks[i] > 0 for i in ids) for t, ids in by.items()}
        term = max(gain, key=lambda t: (gain[t], len(t), t))
        if gain[term] < least:
            break
        kept.append(term)
        own, body = by.pop(term), term[2:]
        for i in own:
            lacks[i] -= 1
        # other lengths of the same word say the same again
        same = lambda t, ids: (t[2:].startswith(body) or body.startswith(t[2:])) and len(ids & own) >= 0.8 * len(ids)
        by = {t: ids for t, ids in by.items() if gain[t] >= least and not same(t, ids)}
    return kept


def token_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature indexes of each word and the number of them per word; the bias is index 0."""
    flat, sizes = [], []
    for w in words:
        own = [0, *(1 + zlib.crc32(t.encode()) % (DIMS - 1) for t in terms_of(w))] if w else [0]
        flat += own
        sizes.append(len(own))
    return np.array(flat, np.int64), np.array(sizes, np.int64)


def marginals(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(P(toxic) of each token, expected transitions [2, 2], log partition of each chain).

    emit: score of state 1 (state 0 has 0) in an array chains x tokens; mask: which entries are tokens (a prefix of each row).
    """
    n, width = emit.shape
    a = np.exp(trans)
    local = np.ones((n, width, 2))
    local[:, :, 1] = np.exp(np.clip(emit, -30, 30))
    alpha, scale = np.zeros((n, width, 2)), np.ones((n, width))
    for t in range(width):
        now = local[:, t] if t == 0 else (alpha[:, t - 1] @ a) * local[:, t]
        on = mask[:, t]
        z = np.where(on, now.sum(axis=1), 1.0)
        alpha[:, t] = np.where(on[:, None], now / z[:, None], alpha[:, t - 1] if t else 0.5)
        scale[:, t] = z
    beta = np.ones((n, width, 2))
    for t in range(width - 2, -1, -1):
        on = mask[:, t + 1]
        back = (local[:, t + 1] * beta[:, t + 1]) @ a.T / scale[:, t + 1][:, None]
        beta[:, t] = np.where(on[:, None], back, 1.0)
    gamma = alpha * beta
    p = gamma[:, :, 1] / np.maximum(gamma.sum(axis=2), 1e-300)
    pair = mask[:, 1:].astype(float)
    expected = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            expected[i, j] = (alpha[:, :-1, i] * a[i, j] * local[:, 1:, j] * beta[:, 1:, j] / scale[:, 1:] * pair).sum()
    return p, expected, (np.log(scale) * mask).sum(axis=1)


class Crf:
    """Weights of the field; ``weights`` is None for a model without triggers (every score is 0)."""

    def __init__(self, weights: np.ndarray | None, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, sizes = token_features(words)
        if not len(flat):
            return np.zeros(0)
        return np.add.reduceat(self.weights[flat], np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def fit_field(windows: list[list[str]], triggers: list[str]) -> Crf:
    """Full-batch AdaGrad on the conditional likelihood of the windows' token labels."""
    if not windows or not triggers:
        return Crf(None, np.zeros((2, 2)))
    marks = set(triggers)
    vocab: dict[str, int] = {}
    width = min(CHAIN, max(map(len, windows)))
    code = np.zeros((len(windows), width), np.int64)
    mask = np.zeros((len(windows), width), bool)
    for i, w in enumerate(windows):
        for t, word in enumerate(w[:width]):
            code[i, t] = vocab.setdefault(word, len(vocab))
            mask[i, t] = True
    words = list(vocab)
    gold_word = np.array([any(t in marks for t in terms_of(w)) for w in words])
    flat, sizes = token_features(words)
    heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    gold = gold_word[code] & mask
    gold_pairs = np.zeros((2, 2))
    for i in range(2):
        for j in range(2):
            gold_pairs[i, j] = ((gold[:, :-1] == i) & (gold[:, 1:] == j) & mask[:, 1:]).sum()
    w, trans = np.zeros(DIMS), np.zeros((2, 2))
    seen_w, seen_t = np.full(DIMS, 1e-8), np.full((2, 2), 1e-8)
    count = mask.sum()
    for _ in range(ROUNDS):
        emit_word = np.add.reduceat(w[flat], heads)
        p, expected, _ = marginals(emit_word[code] * mask, mask, trans)
        diff = np.bincount(code[mask], weights=(gold - p)[mask], minlength=len(words))
        grad = np.bincount(flat, weights=diff[owner], minlength=DIMS) / count * 1000 - L2 * w
        grad_t = (gold_pairs - expected) / count * 1000 - L2 * trans
        seen_w += grad**2
        seen_t += grad_t**2
        w += RATE * grad / np.sqrt(seen_w)
        trans += RATE * grad_t / np.sqrt(seen_t) * 0.2
    return Crf(w, trans)


def collect_windows(sample: DataFrame, triggers: list[str]) -> list[list[str]]:
    """Windows of CHAIN tokens of the sample: those with triggers and one other of each text, MAX_WINDOWS at most by hash."""
    marks = set(triggers)

    def run(batches):
        for b in batches:
            out, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = [trim(t) for t in text.split()]
                chunks = [words[k : k + CHAIN] for k in range(0, len(words), CHAIN)]
                hits = [c for c in chunks if any(t in marks for w in c for t in terms_of(w))]
                if chunks:
                    hits.append(chunks[i % len(chunks)])
                out += hits
                keys += [zlib.crc32(f"{i}:{k}".encode()) for k in range(len(hits))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.list_(pa.string()))], ["k", "words"])

    windows = sample.select("id", "text").mapInArrow(run, "k bigint, words array<string>")
    return windows.orderBy("k").limit(MAX_WINDOWS).select("words").toArrow()["words"].to_pylist()


def fit(docs: DataFrame, labels: DataFrame) -> Crf:
    """Fit on the rows of ``labels`` (doc_id, toxic) that are not held out; null and other labels are left out."""
    from quirelens.runtime import cut_lineage

    sample = cut_lineage(labelled_sample(docs, labels))
    totals = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}  # two rows
    triggers = learn_terms(sample, totals)
    return fit_field(collect_windows(sample, triggers) if triggers else [], triggers)


SPANS = "array<struct<start: int, end: int, p: double>>"


def score(df: DataFrame, model: Crf) -> DataFrame:
    """Add ``score`` and ``toxic_spans`` (code points, end exclusive). Null and empty texts score 0 and have no spans."""
    keep = [c for c in df.columns if c not in ("score", "toxic_spans")]
    weights = df.sparkSession.sparkContext.broadcast(model)  # DIMS numbers

    def run(batches):
        field = weights.value
        for batch in batches:
            for first, end, data, offsets in bs.text_steps(batch, "text"):
                part = batch.slice(first, end - first)
                n = len(offsets) - 1
                scores, spans = np.zeros(n), [[] for _ in range(n)]
                s, e, row = bs.word_bounds(data, offsets)
                if field.weights is not None and len(s):
                    h = bs.span_hash(bs.prefix_hash(data), s, e)
                    _, at, code = np.unique(h, return_index=True, return_inverse=True)
                    raw = data.tobytes()
                    emit = field.emissions([trim(raw[x:y].decode("utf-8", "replace")) for x, y in zip(s[at].tolist(), e[at].tolist(), strict=True)])[code]
                    counts = np.bincount(row, minlength=n)
                    place = np.arange(len(s)) - np.concatenate([[0], np.cumsum(counts)[:-1]])[row]
                    chains = np.concatenate([[0], np.cumsum((counts + CHAIN - 1) // CHAIN)[:-1]])[row] + place // CHAIN
                    grid, mask = np.zeros((int(chains.max()) + 1, CHAIN)), np.zeros((int(chains.max()) + 1, CHAIN), bool)
                    grid[chains, place % CHAIN], mask[chains, place % CHAIN] = emit, True
                    p = marginals(grid, mask, field.trans)[0][chains, place % CHAIN]
                    np.maximum.at(scores, row, p)
                    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                    for k in np.flatnonzero(p >= 0.5).tolist():
                        base = heads[offsets[row[k]]]
                        spans[row[k]].append({"start": int(heads[s[k]] - base), "end": int(heads[e[k]] - base), "p": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(np.clip(scores, 0, 1)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))],
                    [*keep, "score", "toxic_spans"],
                )

    from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

    schema = StructType([*(df.schema[c] for c in keep), StructField("score", DoubleType()), StructField("toxic_spans", _parse_datatype_string(SPANS))])
    return df.select(*keep).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``, repeated ones repeated. Null and empty texts have the score of no token; ``held_out`` of a null id is null."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
