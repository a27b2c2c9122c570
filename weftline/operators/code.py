"""Chunks of source code: parsing needs more than expressions, so these run over Arrow batches."""

from __future__ import annotations

import ast
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

SCHEMA = "path string, start int, end int, type string, name string, parent string, imports array<string>, symbols array<string>, lang string, text string"
#: Which scanner reads a file, by its extension.
SCANNERS = {"py": "python", "go": "go", "rs": "rust"} | dict.fromkeys(("js", "jsx", "mjs", "cjs"), "javascript") | dict.fromkeys(("ts", "tsx", "mts", "cts"), "typescript")
FUNCTION = re.compile(r"(?:async\s+)?function\s*\*?\s*(\w+)\s*\(")
CLASS = re.compile(r"class\s+(\w+)")
RUST = re.compile(r"(?:pub\s+)?(?:unsafe\s+)?(fn|struct|impl|trait|enum|mod|type)\s+(?:<[^>]*>\s+)?(\w+)")


@dataclass
class Piece:
    start: int
    end: int
    type: str
    name: str
    text: str
    parent: str = ""
    imports: list[str] = field(default_factory=list)
    symbols: list[str] = field(default_factory=list)


def python_pieces(text: str) -> list[Piece]:
    """Top-level functions and classes, and what stands before the first; none if the text doesn't parse or defines nothing."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    nodes, lines = list(ast.walk(tree)), text.split("\n")
    imports = sorted({a.name for n in nodes if isinstance(n, ast.Import) for a in n.names} | {n.module or "" for n in nodes if isinstance(n, ast.ImportFrom)})
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    own = [n for n in tree.body if isinstance(n, (*functions, ast.ClassDef))]
    out = []
    if own and own[0].lineno > 1:
        out.append(Piece(1, own[0].lineno - 1, "module", "", "\n".join(lines[: own[0].lineno - 1])))
    for n in own:
        inner = list(ast.walk(n))
        if isinstance(n, ast.ClassDef):
            kind, symbols = "class", [m.name for m in inner if isinstance(m, functions)]
        else:
            kind, symbols = "function", [n.name, *(c.func.id for c in inner if isinstance(c, ast.Call) and isinstance(c.func, ast.Name))]
        end = min(n.end_lineno, len(lines))
        out.append(Piece(n.lineno, end, kind, n.name, "\n".join(lines[n.lineno - 1 : end]), symbols=symbols))
    for p in out:
        p.imports = imports
    return out


def _blocks(lines: list[str], opener) -> Iterator[tuple[str, str, int, int, list[tuple[str, str]]]]:
    """(kind, name, start, end, enclosing openers, latest first) of blocks, innermost first, by counting braces.

    A block is over on the line after which the depth is back where it was when
    it opened; the depth never falls below zero.
    """
    depth, stack = 0, []
    for i, line in enumerate(lines, 1):
        found = opener(line.strip(), [(k, n) for k, n, _, _ in stack])
        if found:
            stack.append((*found, i, depth))
        for c in line:
            depth = depth + 1 if c == "{" else max(0, depth - 1) if c == "}" else depth
        while stack and depth <= stack[-1][3]:
            kind, name, start, _ = stack.pop()
            yield kind, name, start, i, [(k, n) for k, n, _, _ in reversed(stack)]


def brace_pieces(text: str) -> list[Piece]:
    """Classes, functions, and functions inside classes as methods with their class's first line; three lines or more."""
    lines, heads = text.split("\n"), {}

    def opener(line: str, _):
        if c := CLASS.search(line):
            heads[c[1]] = line
            return "class", c[1]
        return ("function", f[1]) if (f := FUNCTION.search(line)) else None

    out = []
    for kind, name, start, end, around in _blocks(lines, opener):
        if end - start < 3:
            continue
        parent = next((n for k, n in around if k == "class"), "") if kind == "function" else ""
        body = "\n".join(lines[start - 1 : end - 1])
        out.append(Piece(start, end, "method" if parent else kind, name, f"{heads[parent]}\n{body}" if parent else body, parent))
    return out


def rust_pieces(text: str) -> list[Piece]:
    """Items of three lines or more; functions inside an impl are methods."""
    lines = text.split("\n")

    def opener(line: str, around):
        m = RUST.search(line)
        return ("method" if m[1] == "fn" and any(k == "impl" for k, _ in around) else m[1], m[2]) if m else None

    return [Piece(s, e, k, n, "\n".join(lines[s - 1 : e - 1])) for k, n, s, e, _ in _blocks(lines, opener) if e - s >= 3]


def _go_code(text: str) -> str:
    """The text with comments and literals blanked out, so that brackets in them don't count."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", blank, text, flags=re.S)


def go_pieces(text: str) -> list[Piece]:
    """Package head, types, variables and constants, functions, and methods led by their type if it came before."""
    code, lines = _go_code(text), text.split("\n")
    clean, starts, depth = code.split("\n"), [], 0
    if not (package := re.search(r"^package\s+(\w+)", code, re.M)):
        return []
    for i, line in enumerate(clean):
        if depth == 0 and re.match(r"(func|type|var|const|import)\b", line):
            starts.append(i)
        depth += sum(line.count(c) for c in "{(") - sum(line.count(c) for c in "})")
    imports, out, types = [], [], {}
    spans = []
    for i in starts:
        depth, end = 0, i
        for j in range(i, len(clean)):
            depth += sum(clean[j].count(c) for c in "{(") - sum(clean[j].count(c) for c in "})")
            end = j
            if depth <= 0:
                break
        spans.append((i, end))
    first = len(lines)
    for i, end in spans:
        word = re.match(r"\w+", clean[i])[0]
        if word == "import":
            imports += re.findall(r'"([^"]+)"', "\n".join(lines[i : end + 1]))
        first = min(first, i)
        body = "\n".join(lines[i : end + 1])
        if word == "func":
            m = re.match(r"func\s*(?:\(\s*\w*\s*\*?\s*(\w+)[^)]*\)\s*)?(\w+)", clean[i])
            if m:
                parent = m[1] or ""
                out.append(Piece(i + 1, end + 1, "method" if parent else "function", m[2], f"{types[parent]}\n{body}" if parent in types else body, parent, symbols=[m[2]]))
        elif word in ("type", "var", "const"):
            grouped = re.match(rf"{word}\s*\(", clean[i])
            at = [j for j in range(i + 1, end) if re.match(r"\s*\w", clean[j]) and _flat(clean, i + 1, j)] if grouped else [i]
            for k, j in enumerate(at):
                stop = (at[k + 1] - 1 if k + 1 < len(at) else end - 1) if grouped else end
                name = re.match(rf"\s*(?:{word}\s+)?(\w+)", clean[j])
                part = "\n".join(lines[j : stop + 1]).rstrip()
                head = clean[j]
                kind = ("struct" if re.search(r"\bstruct\b", head) else "interface" if re.search(r"\binterface\b", head) else "type") if word == "type" else "var"
                fields = [f[1] for x in clean[j + 1 : stop] if (f := re.match(r"\s*(\w+)", x))] if kind in ("struct", "interface") else []
                if name:
                    if word == "type":
                        types[name[1]] = part
                    out.append(Piece(j + 1, j + 1 + part.count("\n"), kind, name[1], part, symbols=fields))
    if imports:
        head = "\n".join(lines[: starts[0]]).strip()
        if head:
            out.insert(0, Piece(1, 1 + head.count("\n"), "module", package[1], head))
    for p in out:
        p.imports = imports
    return out


def _flat(clean: list[str], lo: int, hi: int) -> bool:
    """Whether brackets opened between two lines are closed again."""
    return not sum(x.count("{") + x.count("(") - x.count("}") - x.count(")") for x in clean[lo:hi])


def linear_pieces(text: str, size: int = 30, overlap: int = 15) -> list[Piece]:
    lines, out, start = text.split("\n"), [], 1
    while True:
        end = min(start + size - 1, len(lines))
        out.append(Piece(start, end, "code_block", "", "\n".join(lines[start - 1 : end])))
        if end == len(lines):
            return out
        start = end - overlap


READERS = {"python": python_pieces, "go": go_pieces, "rust": rust_pieces, "javascript": brace_pieces, "typescript": brace_pieces}


def chunk_code(files: DataFrame, path: str = "path", text: str = "text", max_bytes: int = 500 * 1024) -> DataFrame:
    """Chunks of code files by extension; files that a scanner finds nothing in, and others, are cut into windows.

    Python without definitions and Go that doesn't parse give nothing; files over max_bytes and null texts neither.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, body in zip(batch["path"], batch["text"], strict=True):
                lang = SCANNERS.get(p.rsplit(".", 1)[-1].lower() if "." in p else "", "unknown")
                found = READERS[lang](body) if lang in READERS else []
                if not found and lang not in ("python", "go"):
                    found = linear_pieces(body)
                rows += [(p, x.start, x.end, x.type, x.name, x.parent, x.imports, x.symbols, lang, x.text) for x in found]
            yield pd.DataFrame(rows, columns=["path", "start", "end", "type", "name", "parent", "imports", "symbols", "lang", "text"])

    own = files.select(F.col(path).alias("path"), F.col(text).alias("text")).where(F.col("path").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes))
    return own.mapInPandas(run, SCHEMA)


# Patches


def parse_patch(patch: str) -> list[tuple[str, str, str]]:
    """(file, old block, new block) of each hunk, in order; an empty old block appends."""
    out, name, hunk = [], None, None

    def close() -> None:
        if hunk and name and name != "/dev/null":
            out.append((name, "\n".join(x[1:] for x in hunk if x[:1] in "- " and x), "\n".join(x[1:] for x in hunk if x[:1] in "+ " and x)))

    for line in patch.split("\n"):
        if line.startswith("--- "):
            continue
        if line.startswith("+++ "):
            close()
            name, hunk = line[4:].strip(), None
        elif line.startswith("@@"):
            close()
            hunk = []
        elif hunk is not None:
            hunk.append(line)
    close()
    return out


def apply_patch(files: DataFrame, patch: str, path: str = "path", text: str = "text") -> DataFrame:
    """Adds patched, applied and failed: each hunk of a file replaces its first match, one after the other; all as expressions."""
    out = files.withColumns({"patched": F.col(text), "applied": F.lit(0), "failed": F.lit(0)})
    for name, old, new in parse_patch(patch):
        mine = F.col(path) == name
        at = F.instr("patched", old) if old else F.lit(1)
        swapped = F.concat(F.substring(F.col("patched"), F.lit(1), at - 1), F.lit(new), F.substring(F.col("patched"), at + len(old), F.length("patched"))) if old else F.concat("patched", F.lit("\n" + new + "\n"))
        out = out.withColumn("_hit", mine & (at > 0)).withColumns({"patched": F.when(F.col("_hit"), swapped).otherwise(F.col("patched")), "applied": F.col("applied") + F.col("_hit").cast("int"), "failed": F.col("failed") + (mine & ~F.col("_hit")).cast("int")}).drop("_hit")
    return out


# Terminal width


def width(s: str) -> int:
    """Columns that a string takes on a terminal: wide characters two, combining ones none, a variation selector makes its character wide."""
    total, last = 0, 0
    for c in s:
        if c == "️":
            total, last = total + (2 - last if last == 1 else 0), 2
        elif unicodedata.combining(c) or unicodedata.category(c) in ("Mn", "Me", "Cf", "Cc"):
            continue
        else:
            last = 2 if unicodedata.east_asian_width(c) in "WF" else 1
            total += last
    return total


@F.pandas_udf(IntegerType())
def display_width(c: pd.Series) -> pd.Series:
    return c.map(lambda s: None if s is None else width(s)).astype("Int32")


def column_widths(rows: DataFrame, cells: Column, by: str) -> DataFrame:
    """(by, at, width): the widest cell of each column of a table."""
    return rows.select(by, F.posexplode(cells).alias("at", "_cell")).groupBy(by, "at").agg(F.max(display_width(F.col("_cell"))).alias("width"))
