"""Front matter with nested values: maps and lists by indentation, quoted and block scalars, flow collections, typed scalars."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = re.compile(r"\A---[ \t\r\f\v]*\n(.*?)\n(?:---|\.\.\.)[ \t\r\f\v]*(?:\n|\Z)(.*)", re.DOTALL)
TRUE, FALSE, NULL = ("true", "yes", "on"), ("false", "no", "off"), ("", "~", "null")
NUMBER = re.compile(r"[-+]?(?:0|[1-9][0-9_]*|(?:[0-9][0-9_]*\.[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)")
KEY = re.compile(r"""(?P<key>"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#"'\[\]{},&*!|>%@`-][^:]*?|-[^\s:][^:]*?|[^\s#"'\[\]{}](?:[^:#]|:(?=\S)|(?<=\S)#)*?)\s*:(?=\s|$)\s*(?P<rest>.*)""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " ", "b": "\b", "f": "\f"}


class Broken(ValueError):
    """The text isn't in the form that is read here."""


def scalar(text: str) -> object:
    """A plain scalar by its look: true or false, null, a number, else text."""
    low = text.lower()
    if low in TRUE or low in FALSE:
        return low in TRUE
    if low in NULL:
        return None
    if NUMBER.fullmatch(text):
        plain = text.replace("_", "")
        return float(plain) if re.search("[.eE]", plain) else int(plain)
    return text


def quoted(text: str, at: int) -> tuple[str, int]:
    """The quoted scalar that begins at a place, and the place after it."""
    mark, out, at = text[at], [], at + 1
    while at < len(text):
        c = text[at]
        if c == mark == "'" and text[at + 1 : at + 2] == "'":
            out.append("'")
            at += 2
        elif c == mark:
            return "".join(out), at + 1
        elif c == "\n":  # lines fold: one line end is a blank, more are one fewer
            stop = at
            while stop < len(text) and text[stop].isspace():
                stop += 1
            ends = text.count("\n", at, stop)
            while out and out[-1] in (" ", "\t"):
                out.pop()
            out.append("\n" * (ends - 1) or " ")
            at = stop
        elif c == "\\" and mark == '"':
            e = text[at + 1 : at + 2]
            if e in ("u", "x"):
                size = 4 if e == "u" else 2
                out.append(chr(int(text[at + 2 : at + 2 + size], 16)))
                at += 2 + size
            elif e in ESCAPES:
                out.append(ESCAPES[e])
                at += 2
            else:
                raise Broken("an escape that isn't one")
        else:
            out.append(c)
            at += 1
    raise Broken("a quote isn't closed")


def flow(text: str, at: int = 0) -> tuple[object, int]:
    """The value of flow style at a place: [..], {..}, quoted or plain, and the place after it."""
    while at < len(text) and text[at].isspace():
        at += 1
    opener = text[at : at + 1]
    if opener in ("'", '"'):
        return quoted(text, at)
    if opener in ("[", "{"):
        closer, items, at = "]" if opener == "[" else "}", [], at + 1
        while True:
            while at < len(text) and (text[at].isspace()):
                at += 1
            if at >= len(text):
                raise Broken("a bracket isn't closed")
            if text[at] == closer:
                return (items if opener == "[" else dict(items)), at + 1
            value, at = flow(text, at)
            while at < len(text) and text[at].isspace():
                at += 1
            if opener == "{":
                if text[at : at + 1] == ":":
                    item, at = flow(text, at + 1)
                else:
                    item = None
                value = (value if isinstance(value, str) else json.dumps(value), item)
                while at < len(text) and text[at].isspace():
                    at += 1
            items.append(value)
            if text[at : at + 1] == ",":
                at += 1
            elif text[at : at + 1] != closer:
                raise Broken("a comma is missing")
    end = re.compile(r"[,\[\]{}\n]|:(?=[\s,\]}]|$)|\s#").search(text, at)
    stop = end.start() if end else len(text)
    return scalar(text[at:stop].strip()), stop


class Lines:
    """Lines with their indentation; comments and blank lines are passed over, but not inside block scalars."""

    def __init__(self, text: str):
        self.lines, self.at = text.split("\n"), 0

    def peek(self) -> tuple[int, str] | None:
        while self.at < len(self.lines):
            line = self.lines[self.at]
            if line.strip() and not line.lstrip().startswith("#"):
                if "\t" in line[: len(line) - len(line.lstrip())]:
                    raise Broken("a tab in the indentation")
                return len(line) - len(line.lstrip(" ")), line.strip()
            self.at += 1
        return None

    def block(self, style: str, parent: int) -> str:
        """A block scalar: lines deeper than its parent, kept (|) or folded (>), with its end clipped, stripped (-) or kept (+)."""
        own: list[str] = []
        while self.at < len(self.lines) and (not self.lines[self.at].strip() or len(self.lines[self.at]) - len(self.lines[self.at].lstrip(" ")) > parent):
            own.append(self.lines[self.at])
            self.at += 1
        depth = next((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), 0)
        own = [x[depth:] if x.strip() else "" for x in own]
        body = [*own]
        while body and not body[-1]:
            body.pop()
        if style[0] == "|":
            text = "\n".join(body)
        else:
            text, before = "", None
            for x in body:
                if before is None:
                    text = x
                elif not x:
                    text += "\n"
                elif before == "":
                    text += x
                elif x.startswith(" ") or before.startswith(" "):
                    text += "\n" + x
                else:
                    text += " " + x
                before = x
        if not body:
            return ""
        return text if "-" in style else text + "\n" * (len(own) - len(body) + 1) if "+" in style else text + "\n"


def value_of(lines: Lines, rest: str, parent: int) -> object:
    """The value after a key or a dash: on the line itself, over the next lines, or below."""
    if re.fullmatch(r"[|>][-+]?(?:\s+#.*)?", rest):
        return lines.block(rest, parent)
    if rest.startswith(("[", "{", '"', "'")):
        while True:
            try:
                value, end = flow(rest)
                break
            except Broken:
                if lines.at >= len(lines.lines):
                    raise
                rest += "\n" + lines.lines[lines.at].strip()
                lines.at += 1
        if rest[end:].strip() and not re.match(r"\s+#", rest[end:]):
            raise Broken("something after the end")
        return value
    if rest[:1] in ("&", "*", "!", "%", "@", "`"):
        raise Broken("anchors and tags aren't read")
    plain = re.sub(r"(?:^|\s)#.*$", "", rest).strip()
    if plain:
        if re.search(r":(?:\s|$)", plain):
            raise Broken("a map in a plain value")
        while (below := lines.peek()) and below[0] > parent:  # a plain scalar goes on
            if KEY.fullmatch(below[1]):
                raise Broken("a map below a value")
            plain += " " + re.sub(r"\s#.*$", "", below[1])
            lines.at += 1
        return scalar(plain)
    below = lines.peek()
    if below and (below[0] > parent or (below[0] == parent and below[1].startswith("- ") and parent >= 0)):
        return node(lines, below[0])
    return None


def node(lines: Lines, depth: int) -> object:
    """The map or list whose lines stand at this depth."""
    found = lines.peek()
    if found[1] == "-" or found[1].startswith("- "):
        items = []
        while (found := lines.peek()) and found[0] == depth and (found[1] == "-" or found[1].startswith("- ")):
            inner = found[1][1:].lstrip()
            own = depth + len(found[1]) - len(inner)
            if inner == "-" or inner.startswith("- ") or (KEY.fullmatch(inner) and not inner.startswith(("[", "{"))):
                lines.lines[lines.at] = " " * own + inner  # a list or map that begins beside its dash
                items.append(node(lines, own))
            else:
                lines.at += 1
                items.append(value_of(lines, inner, depth))
        if found and found[0] > depth:
            raise Broken("an item that is too deep")
        return items
    out: dict[str, object] = {}
    while (found := lines.peek()) and found[0] == depth and not found[1].startswith("- "):
        match = KEY.fullmatch(found[1])
        if not match:
            raise Broken("neither a key nor an item")
        key = match["key"]
        key = quoted(key, 0)[0] if key[0] in "\"'" else key.strip()
        lines.at += 1
        out[key] = value_of(lines, match["rest"].strip(), depth)
    if found and found[0] > depth:
        raise Broken("a line that is too deep")
    return out


def nested(head: str) -> dict[str, object]:
    """The map of a front matter, or Broken."""
    lines = Lines(head)
    first = lines.peek()
    if first is None:
        return {}
    out = node(lines, first[0])
    if lines.peek() is not None or not isinstance(out, dict):
        raise Broken("not a map")
    return out


def by_line(head: str) -> dict[str, object]:
    """The fallback: each line's text before its first colon, and the rest as true, false, a whole number or text."""
    out: dict[str, object] = {}
    for line in map(str.strip, head.split("\n")):
        key, colon, rest = line.partition(":")
        if not colon or line.startswith("#"):
            continue
        rest = rest.strip().strip('"').strip("'")
        low = rest.lower()
        if low in ("true", "yes", "false", "no"):
            out[key.strip()] = low in ("true", "yes")
        else:
            out[key.strip()] = int(rest) if re.fullmatch(r"[-+]?[0-9]+", rest) else rest
    return out


def _front_matter(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        match = MARKS.match(text) if text is not None else None
        if match is None:
            rows.append((None, None, None))
            continue
        try:
            fields, parsed = nested(match[1]), True
        except (Broken, ValueError, RecursionError):
            fields, parsed = {}, False
        rows.append((json.dumps(fields or by_line(match[1]), ensure_ascii=False), match[2].strip(), parsed))
    return pd.DataFrame(rows, columns=["fields", "body", "parsed"])


def front_matter(text: Column) -> Column:
    """(fields, body, parsed) of a text that begins with front matter; all null for others and for null.

    fields is a JSON object with nested maps and lists, in which what looks like
    a truth value, null or number is one. If the front matter isn't in that form,
    or is empty, parsed is false, or fields empty, and each `k: v` line counts
    by itself. Of a key that repeats the last value holds. body is trimmed.
    """
    return F.pandas_udf(_front_matter, "struct<fields:string,body:string,parsed:boolean>")(text)
