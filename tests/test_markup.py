"""Front matter against another parser, inline marks against a walk by characters, calls and creations case by case."""

import json
import random

import pytest

from weftline.functions import frontmatter, inline
from weftline.operators import tools

HEADS = [
    "a: 1\nb: yes\nc: [1, two, {x: y}]\nd:\n  e: 'it''s'\n  f:\n    - 1\n    - g: 2\n      h: \"q\\n\\u00e9\"\n    - - 3\n      - 4",
    "name: x # c\nlist:\n- a\n- b: c\n  d: e\n-\n  f: g\nblock: |\n  one\n   two\n\n  three\nfold: >-\n  a\n  b\n\n  c\nkeep: |+\n  x\n\nstrip: |-\n  y",
    'schema: {\n  "type": "object",\n  "properties": {"input": {"type": "string"}},\n  "required": ["input"]\n}\nurl: http://x.y/z\nempty:\nneg: -3\nfl: 1.5\nplain goes: on and\n  on',
    "# only a comment\n\nkey with blanks: v\n'quoted key': w\n\"other\": null\ntilde: ~\non: off\nno: No\nhash: a#b\ncolon: a:b\n",
    "deep:\n  a:\n    b:\n      c:\n        - d:\n            - e\n        - f",
]
BROKEN = ["k: v: w", "- a\n- b", "x: \"unclosed", "a: 1\n  b: 2", "a: [1, 2", "just text", "a:\n    b: 1\n  c: 2", "x: 'a' b"]


@pytest.mark.parametrize("head", HEADS)
def test_front_matter_as_another_parser_reads_it(head):
    yaml = pytest.importorskip("yaml")
    want = {("true" if k is True else "false" if k is False else k): v for k, v in yaml.safe_load(head).items()}
    got = {("true" if k == "on" else "false" if k == "no" else k): v for k, v in frontmatter.nested(head).items()}
    assert got == want


@pytest.mark.parametrize("head", BROKEN)
def test_broken_front_matter(head):
    with pytest.raises(frontmatter.Broken):
        frontmatter.nested(head)


def test_random_front_matter():
    yaml = pytest.importorskip("yaml")
    r = random.Random(3)

    def value(depth):
        kind = r.choice(["s", "i", "b", "n", "m", "l"] if depth < 4 else ["s", "i", "b", "n"])
        if kind == "m":
            return {f"k{i}": value(depth + 1) for i in range(r.randint(1, 3))}
        if kind == "l":
            return [value(depth + 1) for _ in range(r.randint(1, 3))]
        return {"s": r.choice(["text", "two words", "a: b", "- x", "#no", "it's", '"q"', "yes", "12", "line\nbreak", "é", "", " pad ", "a #b", "[x", "tail\n"]), "i": r.randint(-50, 50), "b": r.random() < 0.5, "n": None}[kind]

    for _ in range(300):
        want = {f"key{i}": value(1) for i in range(r.randint(1, 4))}
        for text in (yaml.safe_dump(want, allow_unicode=True, width=10**6), yaml.safe_dump(want, default_flow_style=True, allow_unicode=True, width=10**6), json.dumps(want)):
            if text[:1] == "{":  # flow style is read below a key
                assert frontmatter.nested("all: " + text.strip()) == {"all": want}, text
            else:
                assert frontmatter.nested(text) == want, text


def test_front_matter_of_texts(spark):
    texts = ["---\na: 1\n---\n body \n", "---\nk: v: w\nn: 7\nb: No\nq: 'x'\n# c: d\n---\nbody", "no marks", None, "---\n\n---\nbody", "---\na: 1\n...\n", "---\na: 1\nnever closed"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    out = [(r.m.fields and json.loads(r.m.fields), r.m.body, r.m.parsed) for r in df.select("k", frontmatter.front_matter(df.text).alias("m")).orderBy("k").collect()]
    assert out == [({"a": 1}, "body", True), ({"k": "v: w", "n": 7, "b": False, "q": "x"}, "body", False), (None, None, None), (None, None, None), ({}, "body", True), ({"a": 1}, "", True), (None, None, None)]


def test_inline_spans():
    spans = lambda t: [(t[a:b], k) for a, b, k in inline.text_spans(t)]
    assert spans("a **b *c* d** e") == [("b *c* d", "bold"), ("c", "italic")]
    assert spans("***x***") == [("*x", "bold"), ("x**", "italic")] or spans("***x***")[0][1] == "bold"
    assert spans("[**a** b](u_r_l) `c_d_e` snake_case_word _i_ __b__") == [("**a** b", "link"), ("a", "bold"), ("c_d_e", "code"), ("i", "italic"), ("b", "bold")]
    assert spans("~~s~~ ~t~ ^u^ <sup>v</SUP> <sub>w</sub>") == [("s", "strike"), ("t", "subscript"), ("u", "superscript"), ("v", "superscript"), ("w", "subscript")]
    assert spans("*a\nb* `c\nd`") == [] and spans("") == [] and inline.text_spans(None) is None
    assert spans("`a`*b*") == [("a", "code"), ("b", "italic")] and spans("**a****b**") == [("a", "bold"), ("b", "bold")]
    assert spans("line one\n*x* é *y*") == [("x", "italic"), ("y", "italic")]


def by_characters(line, kind, opener, closer):
    """Spans of a mark without looking around: the next closer with something before it."""
    out, at = [], 0
    while (a := line.find(opener, at)) >= 0:
        b = line.find(closer, a + len(opener) + 1)
        if b < 0:
            break
        out.append((a + len(opener), b, kind))
        at = b + len(closer)
    return out


@pytest.mark.parametrize(("kind", "mark"), [("bold", "**"), ("bold", "__"), ("strike", "~~"), ("superscript", "^")])
def test_inline_spans_of_random_lines(kind, mark):
    r = random.Random(len(mark))
    for _ in range(300):
        line = "".join(r.choice(["a", " ", "b c", mark, "é"]) for _ in range(12))
        if mark[0] * 3 in line:
            continue
        assert inline.line_spans(line) == by_characters(line, kind, mark, mark)


def test_checked_calls(spark):
    schema = '{"type":"object","properties":{"s":{"type":"string"},"i":{"type":"integer"},"f":{"type":"number"},"o":{"type":"object"},"z":{"type":"null"},"any":{}},"required":["s"]}'
    functions = spark.createDataFrame([("f", schema), ("none", '{"type":"object"}')], "name string, schema string")
    cases = [("f", '{"s":"x"}', []), ("f", "", ["missing: s"]), ("f", None, ["missing: s"]), ("f", "[]", ["not an object"]), ("f", "3", ["not an object"]), ("f", "{", ["not an object"]), ("g", "{}", ["no such function"]), (None, "{}", ["no such function"]), ("none", "{}", []), ("none", '{"x":1}', ["unknown: x"]),
             ("f", '{"s":"x","i":2.0,"f":3,"o":{"a":{"b":1}},"z":null,"any":[1]}', []), ("f", '{"s":null,"i":1.5,"f":"1","o":[],"z":0}', ["not a null: z", "not a number: f", "not a string: s", "not an integer: i", "not an object: o"])]
    calls = spark.createDataFrame([(k, n, a) for k, (n, a, _) in enumerate(cases)], "id int, name string, arguments string")
    assert [r.errors for r in tools.checked(calls, functions).orderBy("id").collect()] == [e for _, _, e in cases]
    assert tools.checked(calls.limit(0), functions).collect() == []


def test_creations(spark):
    good = "---\nname: f1\ndescription: d\n---\nbody"
    rows = [("f1", good, False, None), ("", good, False, "a name is required"), (None, good, False, "a name is required"), ("1f", good, False, "the name has other characters than letters, digits, _ and -"), ("f1", "body", False, "the content has no front matter"), ("f2", good, False, "the front matter has another name"), ("old", "---\nx: 1\n---\nb", None, "the function exists"), ("old", "---\nx: 1\n---\nb", True, None)]
    requests = spark.createDataFrame([(*r[:3], k) for k, r in enumerate(rows)], "name string, content string, replace boolean, k int")
    existing = spark.createDataFrame([("old",)], "folder string")
    assert [r.error for r in tools.creations(requests, existing).orderBy("k").collect()] == [r[3] for r in rows]
