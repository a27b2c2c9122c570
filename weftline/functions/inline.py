"""Inline Markdown as spans instead of terminal codes."""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is looked for, one after the other; the group is the content, the rest are marks.
MARKS = (
    ("link", r"\[([^\]]+)\]\([^)]+\)"),
    ("code", r"`([^`]+)`"),
    ("bold", r"\*\*(.+?)\*\*"),
    ("bold", r"__(.+?)__"),
    ("italic", r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)"),
    ("italic", r"(?<!\w)_(?!_)(.+?)(?<!_)_(?!\w)"),
    ("superscript", r"\^(.+?)\^"),
    ("superscript", r"(?i:<sup>)(.+?)(?i:</sup>)"),
    ("subscript", r"(?<!~)~(?!~)(.+?)(?<!~)~(?!~)"),
    ("subscript", r"(?i:<sub>)(.+?)(?i:</sub>)"),
    ("strike", r"~~(.+?)~~"),
)
PATTERNS = [(kind, re.compile(p)) for kind, p in MARKS]
KINDS = list(dict.fromkeys(kind for kind, _ in MARKS))
ANY = re.compile(r"[\[`*_^~<]")
#: Stands where a mark has been read; no pattern takes it for a mark, a word or a blank.
TAKEN = ""

SPANS = "array<struct<start:int,end:int,kind:string>>"


def line_spans(line: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the contents in a line, by start, longest first."""
    out = []
    for kind, pattern in PATTERNS:
        taken = []
        for m in pattern.finditer(line):
            out.append((m.start(1), m.end(1), kind))
            taken += [(m.start(), m.start(1)), (m.end(1), m.end())]
        for a, b in taken:
            line = line[:a] + TAKEN * (b - a) + line[b:]
    return sorted(out, key=lambda s: (s[0], -s[1], s[2]))


def text_spans(text: str | None) -> list[tuple[int, int, str]] | None:
    if text is None:
        return None
    out, at = [], 0
    for line in text.split("\n"):
        if ANY.search(line):
            out += [(at + a, at + b, kind) for a, b, kind in line_spans(line)]
        at += len(line) + 1
    return out


def _spans(texts: pa.Array) -> pa.Array:
    """The spans as Arrow columns of numbers, a few bytes a span; one text at a time is held as Python objects."""
    at, starts, ends, kinds = array("i", [0]), array("i"), array("i"), array("b")
    for i in range(len(texts)):
        for a, b, kind in text_spans(texts[i].as_py()) or ():
            starts.append(a)
            ends.append(b)
            kinds.append(KINDS.index(kind))
        at.append(len(starts))
    names = pa.DictionaryArray.from_arrays(pa.array(kinds, pa.int8()), pa.array(KINDS)).cast(pa.string())
    spans = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), names], names=["start", "end", "kind"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans, mask=texts.is_null())


def inline_spans(text: Column) -> Column:
    """(start, end, kind) of a text's marked contents, in code points, end exclusive, by start and longest first.

    Links, code, bold, italic, superscript, subscript and strike are read in this
    order, each line by itself. The marks of one are out of the way of the next,
    so marks nest, and what stands inside code or a link is read as well; the
    address of a link isn't. Null stays null; a text without marks has no spans.
    """
    return F.arrow_udf(_spans, SPANS)(text)
