"""Quality rules, line first: rules look at single lines, failing lines go, and documents that lose too much go.

Line rules (a line is a stretch between line ends that holds a word):

* navigation: three or more bars or bullets that part its words, at least one for every four words
* symbols: at least ``SYMBOL_SHARE`` of its words end in or are made of ``#*$%&|<>``
* shouting: at least ``SHOUT_SHARE`` of its words end in ``!!``
* stutter: eight words or more of which at least ``STUTTER_SHARE`` repeat the word before
* boilerplate: it is one of the usual notices of web pages (cookies, scripts, sharing) in four languages, as a whole line
* punctuation: fewer than ``SENTENCE_WORDS`` words and no word that closes a sentence or clause: headings, menus, labels
* bare: it has no letter and no digit

A document is rejected if the base rules fail it or if the lines left hold less than ``KEEP_SHARE`` of its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import numpy as np
import pyarrow as pa

from quirelens.llm import bytescan as bs

SYMBOLS = b"#*$%&|<>"
SYMBOL_SHARE, SHOUT_SHARE, STUTTER_SHARE, KEEP_SHARE = 0.5, 0.5, 0.6, 0.5
MIN_WORDS = 50
SENTENCE_WORDS = 8
#: Marks that close a sentence or clause at the end of a word, and what may stand behind them (fixed values).
END_MARKS, CLOSERS = b".!?:;", b"\"')]"
#: Three-byte marks that close a sentence wherever they stand (fixed values).
WIDE_ENDS = ("…", "。", "！", "？", "।")
#: Whole lines, lower case, without blanks and full stops at the end (fixed values).
NOTICES = (
    "accept all cookies",
    "accept cookies",
    "accepter tous les cookies",
    "aceptar todas las cookies",
    "alle cookies akzeptieren",
    "anmelden",
    "auf facebook teilen",
    "back to top",
    "ce site utilise des cookies",
    "click here",
    "click here to subscribe",
    "compartir en facebook",
    "diese website verwendet cookies",
    "enable javascript to continue",
    "este sitio utiliza cookies",
    "haut de page",
    "iniciar sesión",
    "leer más",
    "lire la suite",
    "log in",
    "nach oben",
    "partager sur facebook",
    "please enable javascript",
    "read more",
    "se connecter",
    "share on facebook",
    "share on twitter",
    "sign in",
    "sign up",
    "skip to content",
    "subscribe to our newsletter",
    "this site uses cookies",
    "volver arriba",
    "we use cookies",
    "weiterlesen",
)

STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "words_left")


def _sum_by(rows: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights=weight, minlength=n).astype(np.int64)


def _closes(data: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Which words (ends ``e``) end in a mark that closes a sentence or clause, or in one and a quote or bracket behind it."""
    marks, closers = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (END_MARKS, CLOSERS))
    last = data[e - 1]
    return marks[last] | (closers[last] & marks[data[np.maximum(e - 2, 0)]])


def _wide_ends(data: np.ndarray) -> np.ndarray:
    """Positions at which one of WIDE_ENDS starts."""
    out = np.zeros(len(data), bool)
    for mark in WIDE_ENDS:
        m = np.frombuffer(mark.encode(), np.uint8)
        at = np.flatnonzero(data[: max(len(data) - 2, 0)] == m[0])
        out[at[(data[at + 1] == m[1]) & (data[at + 2] == m[2])]] = True
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Statistics per text, and (start, end, failed) of every line with a word."""
    n = len(offsets) - 1
    s, e, row = bs.word_bounds(data, offsets)
    out = {k: np.zeros(n, np.int64) for k in STAT_COLUMNS}
    if not len(s):
        return out, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    cum = lambda mask: np.concatenate([np.zeros(1, np.int32), np.cumsum(mask, dtype=np.int32)])  # noqa: E731  a text is below 2 GB
    heads = cum((data & 0xC0) != 0x80)
    symbol = np.isin(data, np.frombuffer(SYMBOLS, np.uint8))
    symbols = cum(symbol)
    out["n_words"] = _sum_by(row, n)
    out["word_chars"] = _sum_by(row, n, heads[e] - heads[s])
    out["n_symbols"] = (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)
    prefix = bs.prefix_hash(data)
    h = bs.span_hash(prefix, s, e)
    # words of three-word runs that occur again in the same text
    near = np.flatnonzero(row[2:] == row[:-2]) if len(row) > 2 else np.zeros(0, np.int64)
    if len(near):
        tri = bs.mix(bs.mix(bs.mix(h[near]) * np.uint64(bs.BASE) + h[near + 1]) * np.uint64(bs.BASE) + h[near + 2])
        order = np.lexsort((tri, row[near]))
        r, t = row[near][order], tri[order]
        same = (r[1:] == r[:-1]) & (t[1:] == t[:-1])
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = near[order[twice]]
        covered = np.zeros(len(s), bool)
        for k in range(3):
            covered[hit + k] = True
        out["n_repeat_words"] = _sum_by(row[covered], n)
    # lines
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    cut[np.flatnonzero(data == 10) + 1] = True
    begin = np.flatnonzero(cut)
    begin = begin[begin < len(data)]
    of_word = np.searchsorted(begin, s, side="right") - 1
    words = np.bincount(of_word, minlength=len(begin))
    filled = np.flatnonzero(words)
    b = begin[filled]
    stop = np.append(begin[1:], len(data))[filled]
    stop = stop - (data[stop - 1] == 10)
    line_row = np.searchsorted(offsets, b, side="right") - 1
    out["n_lines"] = _sum_by(line_row, n)
    lh = bs.span_hash(prefix, b, stop)
    order = np.lexsort((b, lh, line_row))
    again = (line_row[order][1:] == line_row[order][:-1]) & (lh[order][1:] == lh[order][:-1])
    out["n_dup_lines"] = _sum_by(line_row[order][1:][again], n)
    w = words[filled].astype(np.float64)
    per_line = lambda mask: np.bincount(of_word, weights=mask, minlength=len(begin))[filled]
    last = data[e - 1]
    before = data[np.maximum(e - 2, 0)]
    bars = per_line(((e - s) == 1) & ((last == 124) | (last == 62)))
    for mark in ("•", "·", "»", "›"):
        m = np.frombuffer(mark.encode(), np.uint8)
        fits = (e - s) == len(m)
        for k in range(len(m)):
            fits &= data[np.minimum(s + k, len(data) - 1)] == m[k]
        bars += per_line(fits)
    loud = per_line((last == 33) & (before == 33) & (e - s > 2))
    marked = per_line(symbol[e - 1] & ((e - s) > 1))
    stutter = np.zeros(len(s), bool)
    stutter[1:] = (h[1:] == h[:-1]) & (of_word[1:] == of_word[:-1])
    wide = cum(_wide_ends(data))
    alnum = cum(((data >= 48) & (data <= 57)) | ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122)) | (data >= 128))
    bad = (bars >= 3) & (4 * bars >= w - bars)
    bad |= (w >= 3) & (marked >= SYMBOL_SHARE * w)
    bad |= (w >= 3) & (loud >= SHOUT_SHARE * w)
    bad |= (w >= 8) & (per_line(stutter) >= STUTTER_SHARE * w)
    bad |= (w < SENTENCE_WORDS) & (per_line(_closes(data, e)) == 0) & (wide[stop] == wide[b])
    bad |= alnum[stop] == alnum[b]
    short = np.flatnonzero((stop - b < 60) & ~bad)
    for k in short.tolist():
        if data[b[k] : stop[k]].tobytes().strip().rstrip(b".").lower().decode("utf-8", "replace") in _NOTICES:
            bad[k] = True
    out["n_bad_lines"] = _sum_by(line_row[bad], n)
    out["words_left"] = out["n_words"] - _sum_by(line_row[bad], n, w[bad])
    return out, b, stop, bad


_NOTICES = frozenset(NOTICES)


def clean_lines(df: DataFrame) -> DataFrame:
    """Add the statistics (``STAT_COLUMNS``, long) and ``clean_text`` (the text without its failing lines).

    Null texts count as empty and give a null ``clean_text``. Blank lines stay. Columns of these names in the
    input are replaced, all others kept; repeated rows stay repeated.
    """
    keep = [c for c in df.columns if c not in (*STAT_COLUMNS, "clean_text")]

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in bs.text_steps(batch, "text"):
                stats, b, stop, bad = measure(data, offsets)
                part = batch.slice(first, end - first)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                b, stop = b[bad], stop[bad]
                owner = np.searchsorted(offsets, b, side="right") - 1
                for r in np.unique(owner).tolist():
                    mine = owner == r
                    at, pieces = int(offsets[r]), []
                    for x, y in zip(b[mine].tolist(), stop[mine].tolist(), strict=True):
                        pieces.append(data[at:x].tobytes())
                        at = min(y + 1, int(offsets[r + 1]))  # with its line end
                    pieces.append(data[at : offsets[r + 1]].tobytes())
                    texts[r] = b"".join(pieces).decode("utf-8", "replace")
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in keep), *(pa.array(stats[k]) for k in STAT_COLUMNS), pa.array(texts, pa.string())],
                    [*keep, *STAT_COLUMNS, "clean_text"],
                )
        bs.give_back()

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*(df.schema[c] for c in keep), *(StructField(k, LongType()) for k in STAT_COLUMNS), StructField("clean_text", StringType())])
    return df.select(*keep).mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame) -> DataFrame:
    """:func:`clean_lines` with ``base_failed`` and ``kept``.

    Null and empty texts have no word, fail the base and are not kept; repeated rows are judged alike.
    """
    return clean_lines(df).withColumns({"base_failed": base_failed(), "kept": ~base_failed() & (F.col("words_left") >= KEEP_SHARE * F.col("n_words"))})


def digest(df: DataFrame) -> DataFrame:
    """One row per row, null ids and repeated rows included; a null text counts as empty (all 0, failed, not kept)."""
    own = judge(df.select("doc_id", "text"))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_bad_lines", "words_left")
