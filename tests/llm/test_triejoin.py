"""The Jaccard join against all pairs, on chains near the bound, hot buckets, repeats and odd rows."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import SF

from weftline.llm import triejoin


def shingle_set(text, width):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    """{(id, n): component} of [(id, text)] by comparing all pairs."""
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    real = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(real):
        for j, b in real[:k]:
            if percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted([(i, len(s), None if i is None else find(i)) for i, s in sets], key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()], key=str)


def edited(r, words, edits):
    words = list(words)
    for _ in range(edits):
        at = r.randrange(len(words))
        words[at : at + r.choice((0, 1))] = [r.choice("abcdefgh") * 3 for _ in range(r.choice((0, 1, 2)))]
    return words


def families(seed, count, copies, size=60):
    """Copies of copies, so that similarities lie on both sides of the bound."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    rows, next_id = [], 1
    for _ in range(count):
        group = [[r.choice(vocabulary) for _ in range(r.randrange(3, size))]]
        for _ in range(copies):
            group.append(edited(r, r.choice(group), r.choice((0, 1, 1, 2, 3))))
        for words in group:
            rows.append((next_id, " ".join(words)))
            next_id += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_join_of_families(spark, width, percent):
    rows = families(percent, 25, 12)
    want = brute(rows, width, percent)
    sizes = pd.Series([c for _, _, c in want]).value_counts()
    assert (sizes > 1).sum() >= 5 and (sizes == 1).sum() >= 5
    assert got(triejoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), width, percent)) == want


def test_join_in_small_blocks(spark, monkeypatch):
    """Buckets dealt to blocks of three sets, hot keys split in joins, ids joined by shuffle."""
    from weftline.llm import common

    monkeypatch.setattr(triejoin, "BLOCK_SETS", 3)
    monkeypatch.setattr(triejoin, "BROADCAST_IDS", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = families(5, 3, 60, size=80)
    assert got(triejoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)) == brute(rows, 3, 90)


def test_join_odd_rows(spark):
    """Null and repeated ids, null, blank, short, long and equal texts, an id whose texts belong to two groups, clashing columns."""
    long = " ".join(f"word{k % 997} of{k % 31}" for k in range(20_000))
    base = " ".join(f"a{k}" for k in range(50))
    other = " ".join(f"b{k}" for k in range(50))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "two words"), (5, "Two\nWORDS"), (6, "two words more"), (None, base), (None, None), (7, long), (8, long + " end"), (9, base), (9, base), (10, base + " x"), (11, other), (12, other + " y"), (10, other), (13, "ÄB c d"), (14, "äb c d"), (15, "one"), (16, "ONE")]
    frame = spark.createDataFrame([(i, t, 9, 1.0) for i, t in rows], "doc_id long, text string, _n int, component_id double")
    want = brute(rows, 3, 90)
    assert got(triejoin.jaccard_components(frame, 3, 90)) == want
    assert {c for i, _, c in want if i in (9, 10, 11, 12)} == {9}
    empty = triejoin.jaccard_components(frame.limit(0), 3, 90)
    assert empty.columns == ["doc_id", "n_shingles", "component_id"] and empty.collect() == []


@pytest.mark.parametrize("seed", range(12))
def test_trie_walk(seed):
    """The pairs of one walk, with and without an owner, are those of comparing all."""
    r = np.random.default_rng(seed)
    n, percent = 60, int(r.choice([50, 70, 80]))
    base = np.sort(r.choice(n, 40, replace=False))
    made = []
    for _ in range(50):
        keep = base[r.random(len(base)) > r.choice([0.02, 0.1, 0.3])]
        made.append(np.union1d(keep, r.choice(n, r.integers(0, 4))).astype(np.int64))
    size = np.array([len(m) + int(r.integers(0, 4)) for m in made])
    side = lambda rows: triejoin.Side([made[k] for k in rows], size[rows], np.zeros(len(rows), np.int64))
    cut = [int(r.integers(1, len(m) + 1)) for m in made]
    head = lambda rows: triejoin.Side([made[k][: cut[k]] for k in rows], size[rows], np.array([len(made[k]) - cut[k] for k in rows], np.int64))
    for owner in (None, int(base[3])):
        probes, stored = np.arange(0, 30), np.arange(20, 50)
        if owner is not None:
            probes, stored = (np.array([k for k in x if owner in made[k]]) for x in (probes, stored))
        want = set()
        for a in range(len(probes)):
            for b in range(len(stored)):
                common = np.intersect1d(made[probes[a]], made[stored[b]])
                if 100 * len(common) >= percent * (size[probes[a]] + size[stored[b]] - len(common)) and (owner is None or common.min() == owner):
                    want.add((b, a))
        walked = [(b, int(a)) for b, hits in triejoin.shared_overlaps(side(probes), side(stored), n, percent, owner) for a in hits]
        assert len(walked) == len(set(walked)) and set(walked) == want and (want or owner is not None)
        if owner is None:  # first grams never lose a pair, whatever their number
            assert want <= {(b, int(a)) for b, hits in triejoin.shared_overlaps(head(probes), head(stored), n, percent) for a in hits}


def test_documents(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    assert got(triejoin.jaccard_components(frame, 3, 90)) == brute(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), 3, 90)
