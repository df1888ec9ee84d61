"""Page XML to element rows: one row per page, font, image, text run, outline and item (schema ELEMENTS).

Runs once per document inside ``mapInPandas``; a document that cannot be read gives one row with an error code and never
stops the job.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

ELEMENTS = (
    "doc_id string, page_no int, page_width int, page_height int, elem_seq int, kind string, top int, left int, width int, "
    "height int, font int, size int, family string, color string, text string, bold_text string, fmt int, n_bold_words int, "
    "n_links int, src string, error_code string"
)
NAMES = [part.strip().split(" ")[0] for part in ELEMENTS.split(",")]
#: Format codes of a run (fixed values): none, bold, link, italic, several.
FORMATS = {"b": 1, "a": 2, "i": 3}
MIXED = 4
_ILLEGAL = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def decode(raw: bytes) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def parse(text: str) -> ET.Element | None:
    """Element tree after replacing illegal characters and dropping, one after another, all lines that do not fit."""
    lines = _ILLEGAL.sub(" ", text).split("\n")
    while True:  # every turn blanks a line that was not blank
        try:
            return ET.fromstring("\n".join(lines))
        except ET.ParseError as e:
            at = e.position[0] - 1
            if not 0 <= at < len(lines) or not lines[at].strip():
                return None
            lines[at] = ""


def _int(node: ET.Element, name: str) -> int | None:
    value = node.get(name)
    try:
        return int(float(value)) if value is not None else None
    except ValueError:
        return None


def run_text(node: ET.Element) -> tuple[str, str, int, int, int]:
    """(text, bold text, format, bold words, links) of a text element: its own and its nested elements' text, tails left out."""
    parts, bold, kinds, bold_words, links = [node.text or ""], [], set(), 0, 0
    for child in node.iter():
        if child is node:
            continue
        said = child.text or ""
        parts.append(said)
        if said and child.tag in FORMATS:
            kinds.add(FORMATS[child.tag])
        if child.tag == "b" and said:
            bold.append(said)
            bold_words += len(said.split())
        if child.tag == "a" and said:
            links += 1
    text = " ".join(p for p in parts)
    return text, " ".join(bold), (0 if not kinds else MIXED if len(kinds) > 1 else kinds.pop()), bold_words, links


def elements(doc_id: str, raw: bytes | None) -> list[dict]:
    blank = dict.fromkeys(NAMES) | {"doc_id": doc_id}
    if raw is None:
        return [blank | {"error_code": "pw_protected"}]
    text = decode(bytes(raw))
    words = text.split(None, 1)
    if words and words[0].rstrip(":") in ("Permission", "Syntax", "Command"):
        return [blank | {"error_code": text.strip()}]
    tree = parse(text)
    if tree is None:
        return [blank | {"error_code": "xml_error"}]
    out, seq, seen = [], 0, set()
    for outline in tree.iter("outline"):
        if outline in seen:  # inside an outline that was read
            continue
        for node in outline.iter():
            seen.add(node)
            if node.tag in ("outline", "item"):
                out.append(blank | {"kind": node.tag, "elem_seq": seq, "text": node.text})
                seq += 1
    for no, page in enumerate(tree.iter("page"), 1):
        at = blank | {"page_no": no, "page_width": _int(page, "width"), "page_height": _int(page, "height")}
        out.append(at | {"kind": "page", "elem_seq": seq})
        seq += 1
        for node in page:
            row = at | {"kind": node.tag, "elem_seq": seq} | {k: _int(node, k) for k in ("top", "left", "width", "height", "font", "size")}
            if node.tag == "fontspec":
                row |= {"font": _int(node, "id"), "family": node.get("family"), "color": node.get("color")}
            elif node.tag == "image":
                row["src"] = node.get("src")
            elif node.tag == "text":
                row["text"], row["bold_text"], row["fmt"], row["n_bold_words"], row["n_links"] = run_text(node)
            else:
                continue
            out.append(row)
            seq += 1
    return out


def read(docs: DataFrame) -> DataFrame:
    """(doc_id, xml binary) -> ELEMENTS."""

    def run(frames):
        for frame in frames:
            rows = [r for i, x in zip(frame["doc_id"], frame["xml"], strict=True) for r in elements(i, x)]
            out = pd.DataFrame(rows, columns=NAMES)
            for c in NAMES:
                if c not in ("doc_id", "kind", "family", "color", "text", "bold_text", "src", "error_code"):
                    out[c] = out[c].astype("Int32")
            yield out

    return docs.select("doc_id", "xml").mapInPandas(run, ELEMENTS)
