"""Collocations against plain loops, whatever is split, and on odd rows."""

import random
import re
from collections import Counter, defaultdict

import pandas as pd
import pytest
from conftest import SF

from weftline.llm import collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=30, longest=4, top=2000, percent=80):
    """[(lang, text)] by the contract, with Python's own whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in f.items():
        candidates = {g: a for g, a in own.items() if len(g) > 1 and a >= least}
        around = Counter()
        for g, a in candidates.items():
            for s in range(2, len(g)):
                for i in range(len(g) - s + 1):
                    around[g[i : i + s]] = max(around[g[i : i + s]], a)
        kept = []
        for g, a in candidates.items():
            if 100 * around.get(g, -1) >= percent * a:
                continue
            score, _, left, right = min((2000000 * a // (own[g[:k]] + own[g[k:]]), k, own[g[:k]], own[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_collocations_of_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    rows = list(zip(docs.lang, docs.text, strict=True))
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows, least=5)
    assert len(want) > 100 and any(len(r[2].split(" ")) == 4 for r in want)
    assert rows_of(collocations.collocations(frame, least=5)) == want


def chatter(seed, n):
    r = random.Random(seed)
    words = ["the", "of", "The", "naïve", "Écho", "x", "new", "york", "city", "\x00", "-", "a"]
    return "".join(r.choice(words) + r.choice([" ", " ", " ", " ", "\t ", ". ", ", ", "\n", "? !", "\r\n"]) for _ in range(n))


@pytest.mark.parametrize("limits", [{}, {"shard": 3, "target": 40, "hot": 15}, {"longest": 2, "percent": 100}, {"longest": 5, "top": 7, "hot": 1}])
def test_collocations_split(spark, limits):
    """Files of three words, tasks of forty windows and split pivots change nothing; repeats of a pivot in an n-gram count once."""
    rows = [(lang, chatter(k, 400)) for k, lang in enumerate(["en", "de", None, "und", "en"])]
    rows += [("en", "the the the the the the. of the of the of the of")] * 12 + [("fr", None), ("fr", ""), (None, None), ("empty", " \n.,\t"), ("da", "A" * 100_000 + " b")]
    frame = spark.createDataFrame([(lang, text, 1.5, "clash", 3) for lang, text in rows], "lang string, text string, score double, phrase string, a int").repartition(3)
    own = {k: v for k, v in limits.items() if k in ("longest", "top", "percent")}
    assert rows_of(collocations.collocations(frame, least=6, **limits)) == brute(rows, least=6, **own)


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([("en", "never often")], "lang string, text string")
    for df in (frame.limit(0), frame):
        out = collocations.collocations(df)
        assert out.columns == COLUMNS and out.collect() == []


def test_scores_beyond_64_bits(spark, tmp_path):
    """2000000 * a is larger than a long here, and floors decide which cut counts."""
    big = 9 * 10**18
    grams = spark.createDataFrame([("en", "p q", big, [big, big]), ("en", "p q r", big - 10**17, [big, big, big - 1]), ("en", "q r", big - 3, [big, big - 1])], "lang string, phrase string, a long, counts array<long>")
    inner = collocations.phrases_inside(grams)
    out = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored(grams, inner, f"file://{tmp_path}/s", 100).collect()}
    assert out["p q"] == (big, big, 1_000_000)
    a = big - 10**17
    cuts = [(2000000 * a // (big + big - 3), 1, big, big - 3), (2000000 * a // (big + big - 1), 2, big, big - 1)]
    assert out["p q r"] == (min(cuts)[2], min(cuts)[3], min(cuts)[0])


def test_hashes_that_meet_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(collocations, "_key_of", lambda grams: np.zeros(len(grams), np.uint64))
    own, sums, back = collocations._summed(np.array([[1, 2], [3, 4], [1, 2]], np.int32), np.array([1, 2, 3]))
    assert own.tolist() == [[1, 2], [3, 4]] and sums.tolist() == [4, 2] and back.tolist() == [0, 1, 0]
