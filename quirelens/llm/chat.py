"""Chat formatting by incremental black-box rendering.

A template is any function from a list of ``(role, text)`` turns to one string; nothing of its inside is known.
Rendering the first k turns for k = 1, 2, ... and comparing each output with the one before locates the span of
every turn. Where an output does not start with the one before, the template rewrites history: the span then
begins at the common prefix and the conversation is marked. Where a turn's text lies inside its span is found in
the same way, by rendering the last turn with two texts of one differing letter: what stands before and behind
that letter is the template's.

A conversation is the unit of work (one row after aggregation): its turns are needed together to be written out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]

OPEN, CLOSE, ESCAPE = "### ", "</turn>", "\\"
#: Written names of the usual roles (fixed values); any other role is written escaped after "=".
NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(\\|### |</turn>)")
_TURN = re.compile(r"### (?:(System|User|Assistant)|=((?:\\[:\n\\]|[^:\n\\])*)): ((?:\\(?:\\|### |</turn>)|(?!### |</turn>)[^\\])*)</turn>\n", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(turns: list[Turn]) -> str:
    """The template of this library: ``### Role: text</turn>`` and a line end per turn."""
    out = []
    for role, text in turns:
        name = NAMES.get(role) or "=" + re.sub(r"([:\n\\])", r"\\\1", role)
        out.append(f"{OPEN}{name}: {escape(text)}{CLOSE}\n")
    return "".join(out)


def read_back(formatted: str) -> list[Turn] | None:
    """Turns of an output of :func:`render`; None for any other string."""
    at, turns = 0, []
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            return None
        turns.append((ROLES[m[1]] if m[1] else re.sub(r"\\([:\n\\])", r"\1", m[2] or ""), unescape(m[3])))
        at = m.end()
    return turns


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halves: slices are compared at memory speed."""
    same, other = 0, min(len(a), len(b))
    if a[:other] == b[:other]:
        return other
    while other - same > 1:
        half = (same + other) // 2
        if a[same:half] == b[same:half]:
            same = half
        else:
            other = half
    return same


Found = tuple[str, list[tuple[int, int, int, int]], bool]


def spans_by_prefixes(turns: list[Turn], template: Callable[[list[Turn]], str]) -> Found:
    """Every prefix rendered whole and held against the one before: right for any template, and quadratic in the conversation."""
    before, found, rewrites = "", [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(before)
        if not now.startswith(before):
            rewrites = True
            start = _common(before, now)
        found.append((start, len(now), *_text_span(turns[:k], now, template)))
        before = now
    return before, found, rewrites


def _text_span(turns: list[Turn], now: str, template: Callable[[list[Turn]], str]) -> tuple[int, int]:
    """Where the last turn's text lies: two texts that differ in their only character show its beginning and end."""
    one, two = (template([*turns[:-1], (turns[-1][0], probe)]) for probe in ("x", "y"))
    head = _common(one, two)
    stop = len(now) - _common(one[::-1], two[::-1])
    return (head, stop) if stop >= head else (len(now), len(now))  # a template may leave a role's text out


def spans(turns: list[Turn], template: Callable[[list[Turn]], str] = render) -> Found:
    """(output, (start, end, text start, text end) per turn in code points, whether the template rewrites history)."""
    return spans_by_prefixes(turns, template)


SPAN = "start int, end int, text_start int, text_end int"


def format_chats(df: DataFrame, template: Callable[[list[Turn]], str] = render, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted text, turn spans, loss spans, and whether history was rewritten.

    Input: conv_id, turn, role, text. Turns are taken in the order (turn, role, text), nulls first; a null role
    or text is empty; repeated rows are turns of their own; a null conv_id is a conversation. Other columns are
    ignored. An empty table gives an empty table.
    """
    turns = F.transform(
        F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))),
        lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")),
    )
    chats = df.select("conv_id", "turn", "role", "text").groupBy("conv_id").agg(turns.alias("turns"))
    conv = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = {"formatted": [], "spans": [], "loss_spans": [], "rewrites_history": []}
            for turns in b.column(1).to_pylist():
                pairs = [(t["role"], t["text"]) for t in turns]
                out, found, rewrites = spans(pairs, template)
                rows["formatted"].append(out)
                rows["spans"].append([dict(zip(("start", "end", "text_start", "text_end"), s, strict=True)) for s in found])
                rows["loss_spans"].append([{"start": s[2], "end": s[3]} for s, (role, _) in zip(found, pairs, strict=True) if role in loss_roles])
                rows["rewrites_history"].append(rewrites)
            i32 = pa.int32()
            span = pa.list_(pa.struct([(n, i32) for n in ("start", "end", "text_start", "text_end")]))
            loss = pa.list_(pa.struct([("start", i32), ("end", i32)]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows["formatted"], pa.string()), pa.array(rows["spans"], span), pa.array(rows["loss_spans"], loss), pa.array(rows["rewrites_history"], pa.bool_())],
                ["conv_id", "formatted", "spans", "loss_spans", "rewrites_history"],
            )

    return chats.mapInArrow(run, f"conv_id {conv}, formatted string, spans array<struct<{SPAN.replace(' int', ': int')}>>, loss_spans array<struct<start: int, end: int>>, rewrites_history boolean")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history; all read back from the output."""
    conv = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, joined, loss = [], [], []
            for text, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = read_back(text)
                if turns is None:
                    raise ValueError("an output of another template can't be read back")
                n.append(len(turns))
                joined.append("".join(f"{role}\n{said}\n" for role, said in turns))
                loss.append("".join(unescape(text[s["start"] : s["end"]]) for s in at))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(joined, pa.string()), pa.array(loss, pa.string())], ["conv_id", "formatted", "rewrites_history", "n_turns", "joined", "loss"])

    back = formatted.select("conv_id", "formatted", "loss_spans", "rewrites_history").mapInArrow(run, f"conv_id {conv}, formatted string, rewrites_history boolean, n_turns bigint, joined string, loss string")
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("joined").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "rewrites_history",
    )
