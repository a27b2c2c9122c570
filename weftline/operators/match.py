"""Full-text matching of messages: a small query grammar over words, ranked by BM25."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Letters that lose their accents.
FOLDED = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: An index word or phrase that most messages hold counts at least so much.
LEAST_IDF = 1e-6


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Both:
    op: str  # AND, OR or NOT
    left: object
    right: object


def plain_words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased, without the accents of FOLDED and without marks of their own."""
    bare = "".join(c for c in text.lower() if unicodedata.category(c)[0] != "M").translate(str.maketrans(*FOLDED))
    return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in bare).split()


def parse(query: str):
    """OR of ANDs of NOTs of phrases: words side by side are ANDed, "quoted ones" stand in a row, word* is a prefix, brackets group."""
    pieces = re.findall(r'"(?:[^"]|"")*"\s*\*?|[()]|[^\s()"]+', query)
    at = 0

    def peek() -> str | None:
        return pieces[at] if at < len(pieces) else None

    def take() -> str:
        nonlocal at
        at += 1
        return pieces[at - 1]

    def one():
        if (p := peek()) is None or p in (")", "AND", "OR", "NOT"):
            raise ValueError(f"{query!r}: a word, a phrase or a bracket is missing")
        if take() == "(":
            inner = level(0)
            if peek() != ")":
                raise ValueError(f"{query!r}: a bracket is open")
            take()
            return inner
        prefix = p.endswith("*")
        words = tuple(plain_words(p.rstrip("* ").strip('"')))
        if not words:
            raise ValueError(f"{query!r}: {p!r} has no word")
        return Phrase(words, prefix)

    def level(n: int):
        if n == 3:
            return one()
        op = ("OR", "AND", "NOT")[n]
        left = level(n + 1)
        while (p := peek()) == op or (op == "AND" and p not in (None, ")", "OR", "NOT", "AND")):
            if p == op:
                take()
            left = Both(op, left, level(n + 1))
        return left

    tree = level(0)
    if peek() is not None:
        raise ValueError(f"{query!r}: {peek()!r} is not expected")
    return tree


def phrases(tree) -> list[Phrase]:
    """Those that a match may be ranked by; what is excluded isn't."""
    if isinstance(tree, Phrase):
        return [tree]
    return list(dict.fromkeys(phrases(tree.left) + ([] if tree.op == "NOT" else phrases(tree.right))))


def word_array(c: Column) -> Column:
    """plain_words() of a text, as an array."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{M}", "")
    folded = F.translate(bare, *FOLDED)
    return F.array_remove(F.split(folded, r"[^\p{L}\p{N}]+"), "")


def count_of(words: Column, phrase: Phrase) -> Column:
    """How often the phrase stands in the words."""
    n = len(phrase.words)
    own = F.array(*map(F.lit, phrase.words))
    if n == 1 and not phrase.prefix:
        return F.size(F.filter(words, lambda w: w == phrase.words[0]))
    last = lambda i: F.startswith(F.get(words, i + n - 1), F.lit(phrase.words[-1])) if phrase.prefix else F.get(words, i + n - 1) == phrase.words[-1]
    first = lambda i: F.slice(words, i + 1, n - 1) == F.slice(own, 1, n - 1) if n > 1 else F.lit(True)
    return F.size(F.filter(F.transform(words, lambda w, i: F.coalesce(first(i) & last(i), F.lit(False))), lambda x: x))


def match(messages: DataFrame, query: str, k: int = 10, key: str = "id", text: str = "text") -> DataFrame:
    """(key, score): the k best messages that match the query, the best first, ties by key.

    Each message is read once: its length and how often each phrase stands in it
    are all that goes on. A null text has no words and matches nothing.
    """
    tree = parse(query)
    ranked = phrases(tree)
    every = list(dict.fromkeys([*ranked, *_all(tree)]))
    rows = messages.select(key, word_array(F.col(text)).alias("_w"))
    rows = rows.select(key, F.size("_w").alias("_len"), *[count_of(F.col("_w"), p).alias(f"_f{i}") for i, p in enumerate(every)])

    def holds(t) -> Column:
        if isinstance(t, Phrase):
            return F.col(f"_f{every.index(t)}") > 0
        a, b = holds(t.left), holds(t.right)
        return a & ~b if t.op == "NOT" else a & b if t.op == "AND" else a | b

    stats = rows.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(ranked))])
    score = F.lit(0.0)
    for i in range(len(ranked)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5)), F.lit(LEAST_IDF))
        score = score + idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    found = rows.where(holds(tree)).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))
    return found.orderBy(F.desc("score"), key).limit(k)


def _all(tree) -> list[Phrase]:
    return [tree] if isinstance(tree, Phrase) else _all(tree.left) + _all(tree.right)
