"""Each corpus operator against brute force, and on nulls, empty texts, repeats, empty tables and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from conftest import SF, same_rows
from pyspark.sql import functions as F

from weftline.llm import ann, common, decontaminate, langid, licenses, linededup, neardup, ngramlm, packing, pii, sharding
from weftline.llm.eliasfano import EliasFano, Ranges, flatten, unflatten
from weftline.llm.queries import oracle_sql, queries, tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, _text string, n_lines int, score string"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blank, long and repeated texts, clashing columns."""
    long = " ".join(f"word{i} of" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "hello there friend", "en", None), (4, "hello there friend", "en", None), (None, "lost words here", "de", "b"), (None, None, None, None), (5, long, "en", "a"), (6, "123 456", "fr", "a"), (7, "über straße naïve", "de", "b")]
    return spark.createDataFrame([(*r, "clash", 7, "s") for r in rows], DOCS)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, duck, name):
    same_rows(queries()[name](spark, SF), duck.sql(oracle_sql()[name]))


# 1


def brute_scores(texts, train, discounts):
    """Interpolated discounting over plain dictionaries; words seen once, and unseen ones, are one class."""
    words = {k: (t or "").encode().lower().split() for k, t in texts.items()}
    seen = Counter(w for k in train for w in words[k])
    cls = {w: w for w, n in seen.items() if n >= 2}
    rare_n, rare_v = sum(n for n in seen.values() if n < 2), sum(n < 2 for n in seen.values())
    seqs = {k: [0, *(cls.get(w, 1) for w in ws), 0] for k, ws in words.items()}
    uni = Counter(x for k in train for x in seqs[k][1:])
    uni[1] = uni.get(1, 0)
    total = sum(uni.values())
    p1 = {c: (n + 0.5) / (total + 0.5 * len(uni)) for c, n in uni.items()}
    two, three = Counter(), Counter()
    for k in train:
        s = seqs[k]
        two.update(zip(s, s[1:], strict=False))
        three.update(zip(s, s[1:], s[2:], strict=False))
    two, three = ({g: n for g, n in x.items() if n >= 2} for x in (two, three))
    left2, left3 = defaultdict(float), defaultdict(float)
    for (a, _), n in two.items():
        left2[a] += (n - discounts[0]) / uni[a]
    for (a, b, _), n in three.items():
        left3[a, b] += (n - discounts[1]) / two[a, b]

    def p2(b, c):
        return (max(two.get((b, c), 0) - discounts[0], 0) / uni[b] if uni.get(b) else 0) + max(1e-12, 1 - left2[b]) * p1[c]

    def p3(a, b, c):
        if (a, b) not in left3:
            return p2(b, c)
        n = three.get((a, b, c), 0)
        return (n - discounts[1]) / two[a, b] + max(1e-12, 1 - left3[a, b]) * p2(b, c) if n else max(1e-12, 1 - left3[a, b]) * p2(b, c)

    out = {}
    for k, s in seqs.items():
        logs = sum(math.log10(p2(s[i - 1], s[i]) if i == 1 else p3(s[i - 2], s[i - 1], s[i])) for i in range(1, len(s)))
        out[k] = logs + sum(math.log10((seen.get(w, 0) + 0.5) / (rare_n + 0.5 * (rare_v + 1))) for w in words[k] if w not in cls)
    return out


def test_lm_against_dictionaries(spark, docs):
    small = docs[docs.text.str.len() < 1500].head(60)
    df = spark.createDataFrame([(int(k), t) for k, t in small.text.items()], "doc_id long, text string")
    train = [k for k in small.index if zlib.crc32(str(k).encode()) % 5 != 1]
    for limits in (ngramlm.Limits(shards=3), ngramlm.Limits(shards=2, vocabulary=200, bucket=500)):
        model = ngramlm.train(ngramlm.training_rows(df), limits)
        got = ngramlm.score(df, model).toPandas().set_index("doc_id")
        if limits.vocabulary < 1000:  # fewer classes: only the exact columns are comparable
            assert not model.totals.complete
        else:
            rows = cut_counts(small, train)
            want = brute_scores(dict(small.text.items()), train, rows)
            for k in small.index:  # quantised probabilities
                assert got.score[k] == pytest.approx(want[k], rel=0.01, abs=0.3)
        counts = Counter(w for k in train for w in [*small.text[k].encode().lower().split(), 0])
        n, v = sum(counts.values()), len(counts)
        for k in small.index:
            toks = [*small.text[k].encode().lower().split(), 0]
            assert got.n_tokens[k] == len(toks) and got.n_known[k] == sum(counts[x] > 0 for x in toks)
            assert got.base_score[k] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in toks), abs=1e-6)


@pytest.mark.parametrize("vocabulary", [1 << 22, 200])
def test_lm_scores_by_groups(spark, docs, vocabulary):
    """A trie larger than a group is scored group by group: all that is seen twice counts, and the scores are those of one group."""
    small = docs[docs.text.str.len() < 1500].head(60)
    df = spark.createDataFrame([(int(k), t) for k, t in [*small.text.items(), *small.text.head(2).items()]], "doc_id long, text string")
    whole = ngramlm.train(df, ngramlm.Limits(vocabulary=vocabulary, shards=7))
    parted = ngramlm.train(df, ngramlm.Limits(vocabulary=vocabulary, shards=7, group=1))
    fine = ngramlm.train(df, ngramlm.Limits(vocabulary=vocabulary, shards=1, bucket=300, group=5000))
    assert len(whole.groups) == 1 and len(parted.groups) == 7 and fine.shards > 7 and 1 < len(fine.groups)
    want, got, other = (ngramlm.score(df, m).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True) for m in (whole, parted, fine))
    pd.testing.assert_frame_equal(got, want, check_exact=False, rtol=1e-9)
    assert (other.n_known == want.n_known).all() and other.score.tolist() == pytest.approx(want.score.tolist(), rel=0.01, abs=0.3)


def cut_counts(small, train):
    """The discounts of pairs and triples, from how many are seen once and twice."""
    out = []
    words = {k: small.text[k].encode().lower().split() for k in train}
    seen = Counter(w for ws in words.values() for w in ws)
    for n in (2, 3):
        grams = Counter()
        for ws in words.values():
            s = [0, *(w if seen[w] >= 2 else 1 for w in ws), 0]
            grams.update(zip(*[s[i:] for i in range(n)], strict=False))
        c = Counter(grams.values())
        out.append(min(0.95, max(0.1, c[1] / (c[1] + 2 * c[2]))))
    return out


def test_lm_counts_beyond_32_bits():
    keys, n = np.array([3, 9, 2**62], np.int64), np.array([1, 2**33 + 5, 2**40], np.int64)
    back = ngramlm._unpacked(ngramlm._packed(keys, n))
    assert (back[0] == keys).all() and (back[1] == n).all()
    twice = ngramlm._summed([ngramlm._packed(keys, n)] * 2)
    assert (twice[1] == 2 * n).all()


def test_lm_keeps_all_with_least_1(spark, docs):
    """With least 1 a pair seen once is in the trie, so the training text itself gets likelier."""
    small = docs[docs.text.str.len() < 1500].head(60)
    df = spark.createDataFrame([(int(k), t) for k, t in small.text.items()], "doc_id long, text string")
    two, one = (ngramlm.train(df, ngramlm.Limits(least=n, shards=3)) for n in (2, 1))
    assert one.size > two.size
    a, b = (ngramlm.score(df, m).agg(F.sum("score")).first()[0] for m in (two, one))
    assert b > a
    one.remove()


def test_lm_odd_rows(spark, odd):
    model = ngramlm.train(odd)
    assert ngramlm.score(odd, model).count() == 10
    nothing = ngramlm.train(odd.limit(0))
    got = ngramlm.score(odd, nothing).toPandas()
    assert len(got) == 10 and np.isfinite(got.score).all() and (got.n_known == 0).all()
    assert ngramlm.score(odd.limit(0), model).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 0), (5, 3), (500, 10), (500, 10**12), (3000, 2999)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano.of(unflatten(np.frombuffer(flatten(EliasFano.build(v).arrays()), np.uint8)))
        assert (e.access(np.arange(n)) == v).all()
    pairs = np.unique(rng.integers(0, 300, 4000) << 20 | np.minimum(rng.zipf(1.3, 4000), 5000))
    own, ids = pairs >> 20, pairs & ((1 << 20) - 1)
    r = Ranges.build(own, ids, 300)
    at, _ = r.find(own, ids)
    assert (at == np.arange(len(pairs))).all()
    asks = rng.integers(0, 300, 5000), rng.integers(0, 5200, 5000)
    at, _ = r.find(*asks)
    assert ((at >= 0) == np.isin(asks[0] << 20 | asks[1], pairs)).all()


# 2, 3, 6, 10


def test_licenses_brute(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "licensed apache 2 under license\nversion the 0", "this apache of license", "", None, "under the gnu lesser public license licensed", "CC BY 4.0 cc\nby mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        text = (r["text"] or "").lower()
        ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text) if w]
        want = {}
        lines = [{w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", line) if w} for line in text.split("\n")]
        for label, t in licenses.TEMPLATES:
            n = math.ceil(1.25 * len(t.split()))
            over = [set(ws[i : i + n]) for i in range(len(ws))] if len(lines) > 1 else []  # blocks of adjacent words, over line ends
            for block in lines + over:
                c = len(block & set(t.split())) / len(set(t.split()))
                if c >= 0.8 - 1e-9:
                    want[label] = max(c, want.get(label, 0))
        assert {m["label"]: m["containment"] for m in r["matches"]} == pytest.approx(want)
        places = sorted(i for p in licenses.PHRASES for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split())
        assert r["starts"] == places and r["n_words"] == len(ws)


def test_licenses_wrapped(spark):
    """Notices over line ends, with comment marks and changed words, against brute force over blocks of adjacent words."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    mit = "# Permission is hereby granted, free of charge, to any person\n# obtaining a copy of this software and associated\n# documentation files (the Software)"
    gpl = " * This program is licensed under the GNU\n * General Public License, version 3"
    apache = "Licensed under the Apache\nLicense, Version 2.0 (the License)"
    changed = mit.replace("hereby granted", "hereby given").replace("any person", "each reader")
    far = "licensed\n" + "x " * 9 + "under\ncc by " + "y " * 9 + "4 0"
    texts = [bsd, mit, gpl, apache, "x\n" + bsd.removeprefix("Redistribution and ") + "\ny", changed, far, "licensed\nunder a cloud by\n4 in cc 0", ("the of and\n" * 3000) + mit]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        ws, want = split(r["text"]), {}
        for label, t in licenses.TEMPLATES:
            own, n = set(t.split()), math.ceil(1.25 * len(t.split()))
            best = max([len(own & set(ws[i : i + n])) for i in range(len(ws))] + [len(own & set(split(x))) for x in r["text"].split("\n")]) / len(own)
            if best >= 0.8 - 1e-9:
                want[label] = best
        assert {m["label"]: m["containment"] for m in r["matches"]} == pytest.approx(want)
        assert (r["doc_id"] == 6) == (not want)


@pytest.mark.parametrize("run", [licenses.scan, linededup.dedup_lines, sharding.interleave, pii.scan], ids=lambda f: f.__module__)
def test_odd_rows(spark, odd, run):
    out = run(odd)
    rows = sorted(out.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(rows) == 10 and run(odd.limit(0)).count() == 0
    assert [r["doc_id"] for r in rows] == [1, 2, 3, 4, 4, 5, 6, 7, None, None] and {r["_text"] for r in rows} == {"clash"}
    of = {r["doc_id"]: r for r in rows}
    if run is licenses.scan:
        assert [of[k]["n_words"] for k in (1, 2, 3, 4, 5, 6, 7)] == [0, 0, 0, 3, 60_000, 2, 3] and {(r["score"], tuple(r["matches"]), tuple(r["starts"])) for r in rows} == {(0.0, (), ())}
    elif run is linededup.dedup_lines:
        assert [of[k]["n_lines"] for k in (1, 2, 3, 4)] == [1, 1, 2, 1] and {r["n_dropped"] for r in rows} == {0}
        assert [of[k]["text"] for k in (1, 2, 3, 4)] == ["", "", " \n\t ", "hello there friend"]
    elif run is sharding.interleave:
        assert [of[k]["size"] for k in (1, 2, 4)] == [1, 1, 19] and of[1]["text_crc32"] == 0 and sorted(r["shard"] for r in rows) == sorted(i * 16 // 10 for i in range(10))
    else:
        assert {tuple(r["spans"]) for r in rows} == {()}


def test_sharding(spark, docs):
    rows = sharding.interleave(spark.read.parquet(f"{SF}/documents.parquet"), 7).toPandas()
    sizes = rows.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(rows) == len(docs)
    for _, g in rows.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    mix = rows.groupby(["source", "shard"]).size().unstack(fill_value=0)
    assert (mix.max(axis=1) - mix.min(axis=1)).max() <= 2
    assert (rows.text_crc32 == [zlib.crc32(docs.text[d].encode()) for d in rows.doc_id]).all()
    again = sharding.interleave(spark.read.parquet(f"{SF}/documents.parquet").repartition(5), 7).toPandas()
    assert set(zip(rows.doc_id, rows.shard, rows.slot, strict=True)) == set(zip(again.doc_id, again.shard, again.slot, strict=True))
    # equal texts of several sources share a shard, but for the few groups that a cut parts
    groups = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 400).cast("string")).alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    spread = sharding.interleave(groups, 4).toPandas()
    assert (spread.groupby("text_crc32").shard.nunique() == 1).mean() >= 0.95 and spread.groupby("shard").size().tolist() == [1000] * 4
    alike = spark.range(500).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text"), F.lit("src").alias("source"))
    assert sorted(sharding.interleave(alike, 7).groupBy("shard").count().toPandas()["count"]) == [71] * 4 + [72] * 3


def test_line_dedup_brute(spark):
    texts = [f"Shared line\n unique {i} \n  SHARED LINE\t\n\nÉtat" for i in range(9)] + ["état", "", None, "a\n\n"]
    for least in (8, 9, 10):
        out = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least).collect()}
        fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
        seen = Counter(k for t in texts for k in {fold(x) for x in (t or "").split("\n")} if k)
        for i, t in enumerate(texts):
            lines = (t or "").split("\n")
            kept = [x for x in lines if seen[fold(x)] < least]
            assert (out[i]["text"], out[i]["n_lines"], out[i]["n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept))


def test_line_dedup_beyond_broadcast(spark, monkeypatch):
    """A line in every document, and more frequent lines than are broadcast."""
    rows = spark.createDataFrame([(i, f"top\nown {i}\nline {i % 40}\ntop") for i in range(800)], "doc_id long, text string")
    want = sorted(linededup.dedup_lines(rows).collect())
    monkeypatch.setattr(linededup, "BROADCAST_KEYS", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    assert sorted(linededup.dedup_lines(rows).collect()) == want and want[0]["text"] == "own 0" and {r["n_dropped"] for r in want} == {3}


def test_decontamination(spark, odd, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12))), (2, "short one"), (2, "short one"), (None, "nameless item"), (3, None), (4, "...")], "item_id long, text string")
    text = "Start W0 " + " ".join(f"w{i}" for i in range(1, 12)) + ", the SHORT; one nameless item w0 w1 end"
    df = spark.createDataFrame([(1, text), (2, "clean words"), (3, None), (4, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.scan(df, bench).collect()}
    assert (got[1]["n_words"], got[1]["n_hit"], got[1]["items"]) == (21, 16, ["1", "2"]) and [tuple(s) for s in got[1]["spans"]] == [(1, 13), (14, 18)]
    assert got[2]["n_hit"] == got[3]["n_hit"] == 0
    cleaned = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(decontaminate.scan(df, bench)).collect()}
    assert cleaned[1] == "Start the w0 w1 end" and cleaned[2] == "clean words" and cleaned[3] is None
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 2)
    assert {r["doc_id"]: r for r in decontaminate.scan(df, bench).collect()} == got
    assert decontaminate.scan(odd, bench).count() == 10 and decontaminate.scan(odd, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.remove_documents(decontaminate.scan(df, bench)).count() == 2


@pytest.mark.parametrize("bits", [1 << 27, 64])
def test_decontamination_large_benchmark(spark, monkeypatch, bits):
    """More windows than are broadcast, of common words, with any bitmap: the same hits as brute force."""
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice(["the", "of", "and", "to"], n))
    bench = {i: say(rng.integers(3, 14)) for i in range(300)}
    texts = {i: say(rng.integers(0, 60)) for i in range(80)}
    windows = defaultdict(set)
    for i, t in bench.items():
        w = t.split()
        for k in range(max(1, len(w) - 9)):
            windows[tuple(w[k : k + 10])].add(str(i))
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    monkeypatch.setattr(decontaminate, "BITMAP_BITS", bits)
    rows = decontaminate.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), spark.createDataFrame(list(bench.items()), "item_id long, text string"))
    for r in rows.collect():
        w, hit, items = texts[r["doc_id"]].split(), set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    items |= windows[tuple(w[k : k + n])]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(items))


# 4


def test_language_held_out(spark, docs):
    got = queries()["op4_language_id"](spark, SF).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang.reindex(held.index)).mean() >= 0.95
    assert [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.index] == got.held_out.tolist()


def test_language_features_of_long_runs():
    """The middle of a long run of letters counts, as its letters would in a short one."""
    (_, one), (_, two) = (langid.features(["a" * 100 + m * 100 + "a" * 100], {}) for m in ("b", "c"))
    _, short = langid.features(["bb"], {})
    assert len(one) > 2 * 300 and sorted(one) != sorted(two) and set(one) & set(short[1:2]) and not set(two) & set(short[1:2])


def test_language_switches(spark):
    rows = [("der hund und die katze sind nicht hier " * 3, "de"), ("the dog and the cat are not here " * 3, "en")] * 4
    rows = [(f"{t} {i}", y) for i, (t, y) in enumerate(rows)]
    model = langid.fit(rows, epochs=20)
    df = spark.createDataFrame([(1, "the dog und die katze"), (2, "12 ..."), (3, None)], "doc_id long, text string")
    assert [r["label"] for r in langid.label_words(df, model).orderBy("at").collect()] == ["en", "en", "de", "de", "de"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(df, model).collect()}[2] == "und"
    none = langid.train(df.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}


def test_forward_backward():
    rng = np.random.default_rng(1)
    score, trans, first = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    post, pairs = langid._forward_backward(score, np.array([4]), trans, first, pairs=True)
    every = np.array(np.meshgrid(*[range(3)] * 4)).reshape(4, -1).T
    w = np.array([first[y[0]] + sum(score[0, t, y[t]] for t in range(4)) + sum(trans[y[t], y[t + 1]] for t in range(3)) for y in every])
    w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    for t in range(4):
        assert post[0, t] == pytest.approx([w[every[:, t] == k].sum() for k in range(3)])
    assert pairs == pytest.approx(np.array([[sum(w[(every[:, t] == i) & (every[:, t + 1] == j)].sum() for t in range(3)) for j in range(3)] for i in range(3)]))


def test_language_odd_rows(spark, odd):
    model = langid.train(odd)
    got = langid.identify(odd, model)
    nothing = spark.createDataFrame([(1, "\u00bd \u00b2"), (2, "\u2167 12"), (3, "\u00bda")], "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(nothing, model).collect()}
    assert found[1] == found[2] == ("und", 0.0) and found[3][0] != "und"
    long = [(i, f"sehr lange worte {i} " * 600, "de") for i in range(12)] + [(i, f"a short one {i}", "en") for i in range(20, 50)]
    sample = langid.training_sample(spark.createDataFrame(long, "doc_id long, text string, lang string"), F.lit(True))
    assert Counter(y for _, y in sample) == {"de": 10, "en": 30}
    assert got.count() == 10 and got.columns.count("score") == 1 and langid.identify(odd.limit(0), model).count() == 0


# 5


def test_neighbours(spark):
    e = pd.read_parquet(f"{SF}/embeddings.parquet")
    x, ids = np.array(e.embedding.tolist(), float), e.vec_id.to_numpy()
    got = queries()["op5_nearest_neighbours"](spark, SF).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hits += len(set(ids[best]) & set(g.vec_id))
        assert sorted(g["rank"]) == list(range(1, 21)) and (np.diff(g.sort_values("rank").score) <= 0).all()
        assert g.score.to_numpy() == pytest.approx([x[ids == v][0] @ x[ids == q][0] for v in g.vec_id])
    assert hits / len(got) >= 0.9


@pytest.mark.parametrize("case", ["opposite", "12", "24", "30", "huge"])
def test_neighbours_small_tables_are_exact(spark, case):
    """Every query gets its k nearest, or all candidates, on tables that fill no bucket."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(3, 64))
    x = {"opposite": np.vstack([np.eye(64)[0], -np.eye(64)[0]]), "24": centres[np.arange(24) % 3] + 0.05 * rng.normal(size=(24, 64)), "huge": rng.normal(size=(5, 4)) * 1e100}.get(case)
    x = rng.normal(size=(int(case), 64)) if x is None else x
    x = x if case == "huge" else x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df).toPandas()
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -s))[: min(20, len(x) - 1)].tolist()
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == want


def test_neighbours_clusters(spark):
    """Clustered vectors: the fitted probes find them and meet few of the points; a third of the rows in one cluster."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(100, 32))
    which = np.where(np.arange(6000) % 3 == 0, 0, rng.integers(1, 100, 6000))
    x = (centres[which] + 0.3 * rng.normal(size=(6000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got, x = ann.search(df, every=60, block=500).toPandas(), x.astype(float)
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert hits / len(got) >= 0.9 and len(got) == 2000


def test_neighbours_many_small_clusters(spark):
    """Healthy queries of small clusters are not compared with the whole table, and a lonely one is probed further for."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(400, 64))
    x = np.repeat(centres, 50, axis=0) + 0.2 * rng.normal(size=(20_000, 64))
    x[[0, 20]] = rng.normal(size=(2, 64))  # two that belong to no cluster
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(20_000), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got, x, hits = ann.search(df, costs=True).toPandas(), x.astype(float), 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s)[:20]) & set(g.vec_id))
    assert len(got) == 20_000 and hits / len(got) >= 0.9
    met = got.groupby("query_id").met.max()
    assert met.mean() < 0.05 * 20_000 and (met < 0.05 * 20_000).mean() > 0.99


def test_probe_order_and_places():
    rng = np.random.default_rng(4)
    index = ann.CrossPolytope(tables=2, axes=2)
    q, p = ann._unit(rng.normal(size=(3, 16))), ann._unit(rng.normal(size=(5, 16)))
    who = np.array([0, 0, 1, 2, 2])
    need = index.places(q, p, who)
    for i, w in enumerate(who):
        meets = lambda m, i=i, w=w: any(index.buckets(p[i : i + 1], t)[0, 0] in index.buckets(q[w : w + 1], t, m)[0] for t in range(2))
        assert meets(int(need[i])) and (need[i] == 1 or not meets(int(need[i]) - 1))


def test_neighbours_odd_rows(spark):
    v = [0.5, 0.5, 0.1]
    rows = [(i, v) for i in range(60)] + [(100, None), (120, [0.0] * 3), (140, [1.0, None, 2.0]), (160, [float("nan")] * 3), (180, [1.0, 2.0]), (None, v), (0, v), (200, [-1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, ann.CrossPolytope(tables=2, axes=1, probes=8), block=7).toPandas()
    assert got[got.query_id == 20].sort_values("rank").vec_id.tolist() == [i for i in range(21) if i != 20]
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == list(range(1, 21))
    assert set(got.query_id) == {0, 20, 40, 200} and ann.search(df.limit(0)).count() == 0


# 7


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[k]
            if ok:
                out.append((list(BASE).index(k), m.start(), m.end()))
    return out


def test_pii_brute(spark):
    rng = np.random.default_rng(3)
    bits = ["a@b.co", "x.y@z", "a@b.c@d.e_f@g.hi", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "79927398713", "+1 (017) 555-7713", "+12", "é漢🙂", " ", "\n", "word", "12", "@", "+", "."]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(300)] + ["9" * 1500, "a" * 1500, "1 " * 1500, None, ""]
    got = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_support=10**6).collect()
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == brute_spans(r["text"] or ""), r["text"]


def test_pii_discovers_by_context(spark):
    cards = [d for d in ("4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004") if luhn(d)]
    texts = [f"please charge {d} today" for d in cards * 2] + ["please charge 4111111111111112 today", "order 4111111111111113 came"]
    got = {r["text"]: r["spans"] for r in pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_confidence=0.7).collect()}
    extra = [s for s in got[texts[-2]] if s["found"]]
    assert [(s["kind"], s["start"], s["end"]) for s in extra] == [(2, 14, 30)] and not got[texts[-1]]


def test_pii_discovers_unseen_with_defaults(spark):
    """With the parameters of op7_pii: contexts where over a third, and half, of the identifiers are unseen; not a word before any number."""
    valid = [n for n in (str(4111111111110000 + i) for i in range(400)) if luhn(n)]
    wrong = [n for n in (str(4222222222220000 + i) for i in range(400)) if not luhn(n)]
    seen = [f"charge {n} today" for n in valid[:10]] + [f"call +49 30 12345{i} now" for i in range(10, 22)]
    unseen = [f"charge {n} today" for n in wrong[:6]] + [f"call 030 99912{i} now" for i in range(10, 22)]
    other = [f"of {n} parts" for n in valid[10:15]] + [f"of {n} parts" for n in wrong[6:40]]
    rows = spark.createDataFrame(list(enumerate(seen + unseen + other)), "doc_id long, text string")
    got = {r["text"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["found"]] for r in pii.scan(rows).collect()}
    assert [got[t] for t in unseen] == [[(2, 7, 23)]] * 6 + [[(3, 5, 16)]] * 12
    assert not any(got[t] for t in seen + other)


def test_pii_finds_seeds_in_other_spellings(spark):
    """A number after a trusted word is found whether or not a text elsewhere holds it as a phone; an ip's digits alone aren't one."""
    texts = [f"call +49 30 12345{i} now" for i in range(10, 22)] + ["call 49 30 1234567 now", "ring 49-30-1234567", "from 1.2.3.4 to", "costs 12.34 or"]
    for more in ([], ["call +49 30 1234567 now"]):
        rows = spark.createDataFrame(list(enumerate(texts + more)), "doc_id long, text string")
        got = {r["text"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["found"]] for r in pii.scan(rows).collect()}
        assert got[texts[12]] == [(3, 5, 18)] and got[texts[13]] == [(3, 5, 18)] and not got[texts[15]]


def test_pii_long_context_words(spark, monkeypatch):
    """A neighbouring word counts whole, however long; one identifier in every text is spread over tasks."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    word = "charge" * 20
    valid = [n for n in (str(4111111111110000 + i) for i in range(400)) if luhn(n)]
    wrong = next(n for n in (str(4222222222220000 + i) for i in range(400)) if not luhn(n))
    texts = [f"a {word} {n} today" for n in valid[:10] * 3] + [f"a {word} {wrong} today"] * 30 + [f"b x{word[1:]} {wrong[:-2]}77 now", f"{word}\n{wrong[:-2]}78"] + ["x" * 200_000 + " 1.2.3.4"]
    got = pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert all([(s["kind"], s["found"]) for s in r["spans"]] == [(2, 30 <= r["doc_id"])] for r in got[:60])
    assert not got[60]["spans"] and not got[61]["spans"] and [(s["kind"], s["start"]) for s in got[62]["spans"]] == [(1, 200_001)]


def test_redact(spark):
    df = spark.createDataFrame([(1, "mail a@b.co or 1.2.3.4 now"), (2, None)], "doc_id long, text string")
    assert [r["text"] for r in pii.redact(pii.scan(df)).orderBy("doc_id").collect()] == ["mail [email] or [ip] now", ""]


# 8


def brute_groups(texts, width):
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(s), find(k)) for k, s in sets.items()}


def test_near_duplicates_brute(spark):
    rng = np.random.default_rng(5)
    texts, base = {}, [f"w{i}" for i in range(120)]
    for k in range(150):
        words = [w if rng.random() > 0.012 else f"x{rng.integers(999)}" for w in base]
        texts[k] = " ".join(words)
    texts |= {200: None, 201: "", 202: "a b", 203: "A  b", 204: "a b c", 205: texts[3].upper()}
    for width in (4, 5):
        got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(texts, width)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd)
    assert got.count() == 10 and {r["component_id"] for r in got.where("doc_id = 4").collect()} == {4}
    assert neardup.keep_one(odd, got).count() == 10 and neardup.near_duplicates(odd.limit(0)).count() == 0


def test_sketch_merges_and_estimates():
    rng, s = np.random.default_rng(2), neardup.Sketch()
    a, b = (np.sort(rng.integers(0, 2**63, 900).astype(np.uint64)) for _ in range(2))
    b = np.sort(np.concatenate((a[:800], b[:100])))
    both = np.union1d(a, b)
    regs = [s.of(x, np.array([0, len(x)])) for x in (a, b, both)]
    assert (np.maximum(regs[0], regs[1]) == regs[2]).all()
    assert s.jaccard(regs[0], regs[1], np.array([900.0]), np.array([900.0]))[0] == pytest.approx(0.8, abs=0.12)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5)]
    got = {r["_id"]: r["_component"] for r in neardup.connected_components(spark.createDataFrame(edges, "_a long, _b long")).collect()}
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys((100, 101, 102), 100)


def test_near_duplicates_hot_pivot(spark, monkeypatch):
    """A pivot with very many mates is dealt to several tasks: the result is that of brute force."""
    monkeypatch.setattr(common, "HOT_ROWS", 40)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(60)]
    texts = {k: " ".join(w if rng.random() > 0.004 else f"x{rng.integers(999)}" for w in base) + f" end{k}" for k in range(300)}
    texts |= {k: " ".join(f"y{k} z{i}" for i in range(20)) for k in range(300, 310)}
    got = neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_groups(texts, 5)
    star = [(0, i) for i in range(1, 2000)] + [(i, 5000 + i) for i in range(1, 300)]
    found = neardup.connected_components(spark.createDataFrame(star, "_a long, _b long"))
    assert found.agg(F.min("_component"), F.max("_component"), F.count("*"), F.countDistinct("_id")).first() == (0, 0, 2299, 2299)


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    left = spark.range(500).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(450).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    counts = left.groupBy("k").agg(F.count("*").alias("_n"))
    for how in ("inner", "left"):
        got, want = (sorted(df.select("k", "v", "w").collect(), key=str) for df in (common.spread_join(left, right, ["k"], counts, 500, how), left.join(right, "k", how)))
        assert got == want and len(got) == (450 if how == "inner" else 500)


def test_strangers_share_no_band():
    """Unrelated sets of one size agree in hardly a register; links at the bound are kept by the margin."""
    rng, s = np.random.default_rng(9), neardup.Sketch()
    sets = np.sort(rng.integers(0, 2**63, (200, 300)).astype(np.uint64), axis=1)
    regs = s.of(sets.ravel(), np.arange(201) * 300)
    same = np.mean([(regs[i] == regs[j]).mean() for i in range(100) for j in range(100, 200)])
    assert same < 0.002 and len(np.unique(s.keys(regs))) == 200 * s.bands


# 9


def test_packing(spark, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path())
    df = odd.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates()
    df = df.unionByName(spark.createDataFrame([(50, "a<|endoftext|>b"), (51, " two  spaces\n\n\tand it's 漢字 ")], "doc_id long, text string"))
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    rows = packing.pack_documents(df, tokenizer_path()).toPandas()
    for k, g in rows.sort_values("piece").groupby("doc_id"):
        ids = np.array([*own.encode(texts[k] or "", add_special_tokens=False).ids, 0], "<u4")
        assert g.length.sum() == len(ids) and (g.length.iloc[1:] == 2048).all()
        for _, r in g.iterrows():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack_documents(odd, tokenizer_path()).where("doc_id IS NULL").count() == 2
    assert packing.pack_documents(odd.limit(0), tokenizer_path()).count() == 0


def test_packing_spreads_rows_alike(spark):
    items = spark.range(3000).select(F.lit(None).cast("long").alias("_id"), F.lit(0).alias("piece"), F.lit(5).cast("long").alias("length"))
    rows = packing.pack(items, 20, group=200).toPandas()
    groups = rows.groupby(rows.sequence_id // 2**32).size()
    assert len(rows) == 3000 and len(groups) == 15 and groups.max() < 300
    assert (rows.groupby("sequence_id").length.sum() <= 20).all()


def test_sum_of_squares_rule():
    """Each placement is one that makes the sum smallest, by trying them all."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(1, 21, 200)
    bins, offsets = packing.sum_of_squares(sizes, 20)
    gaps: dict[int, int] = {}
    total = lambda g: sum(n * n for n in Counter(x for x in g.values() if 0 < x < 20).values())
    for size, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        options = [total(gaps | {k: v - size}) for k, v in gaps.items() if v >= size] + [total(gaps | {-1: 20 - size})]
        assert o == 20 - gaps.get(b, 20)
        gaps[b] = gaps.get(b, 20) - size
        assert gaps[b] >= 0 and (total(gaps) == min(options) or size == 20)
    assert len(gaps) <= -(-sizes.sum() // 20) * 1.1


# pipeline


def test_pipeline(spark, docs):
    import corpus_pipeline

    frame, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in frame.collect()}
        frame = stage(spark, frame, SF).cache()
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r["doc_id"]: r["text"] for r in frame.collect()}
        kept.append((name, before, after))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    _, before, after = kept[0]
    assert len(after) >= 0.99 * len(before)
    _, before, after = kept[1]
    fold = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for t in before.values() for k in {fold(x) for x in t.split("\n")} if k)
    assert after == {d: "\n".join(x for x in t.split("\n") if seen[fold(x)] < 10) for d, t in before.items()}
    _, before, after = kept[2]
    assert set(after) == {k for k, (n, c) in brute_groups(before, 5).items() if k == c}
    _, before, after = kept[3]
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
    bench = {tuple(w[i : i + 10]) for w in map(split, pd.read_parquet(f"{SF}/benchmark.parquet").text) for i in range(max(1, len(w) - 9)) if w}
    leaks = lambda w: any(tuple(w[i : i + n]) in bench for n in {len(b) for b in bench} for i in range(len(w) - n + 1))
    clean = {d for d, t in before.items() if not leaks(split(t))}
    assert set(after) == clean
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == set(after) and (packed.groupby("sequence_id").length.sum() <= 2048).all()


NAMES = "n_lines n_dropped n_words n_hit items spans score lang_pred n_shingles component_id kept _id _text _own_0".split()


@pytest.mark.parametrize("k", range(5))
def test_pipeline_stages_on_odd_rows(spark, odd, k):
    """Each stage alone: columns that clash with what operators add keep their values; nulls, repeats and empty tables."""
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[k]
    clean = odd.select("doc_id", "text", "lang", "source", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])
    out = stage(spark, clean, SF)
    rows, none = out.collect(), stage(spark, clean.limit(0), SF)
    assert none.columns == out.columns and none.count() == 0
    ids = Counter(r["doc_id"] for r in rows)
    if name == "packing":
        assert ids.keys() == {1, 2, 3, 4, 5, 6, 7, None} and ids[4] == 2 and ids[None] == 2
        return
    assert out.columns == clean.columns
    assert all(r[c] == f"{c} {r['doc_id'] if r['doc_id'] is not None else '-'}" for r in rows for c in NAMES)
    if name == "language_id":
        assert 1 not in ids and 2 not in ids and 3 not in ids and 6 not in ids and ids[4] == 2 and ids[5] == 1
    else:
        assert ids == {1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1, 7: 1, None: 2}
    if name == "line_dedup":
        assert {r["doc_id"]: r["text"] for r in rows if r["doc_id"] is not None} == {r["doc_id"]: r["text"] or "" for r in clean.collect() if r["doc_id"] is not None}


def test_digest_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert linededup.dedup_lines(df).select(F.sha2("text", 256)).first()[0] == hashlib.sha256(b"").hexdigest()
