"""Token alignment against a plain version over both tokenizers, on whole texts and odd ones."""

import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import public_tokenizers
import pytest
import sentencepiece
from conftest import SF
from tokenizers import Tokenizer

from weftline.llm import align, packing
from weftline.llm.queries import queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
NAMES = align.Vocabularies(A, B)


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


def brute(rows, tokenizers):
    """The contract's columns of [(id, text)] by plain loops."""
    a, b = tokenizers
    char = byte_of()
    linked, out = [], []
    for doc, text in rows:
        groups = []
        if text:
            ea, eb = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            pieces = [b.id_to_piece(i) for i in eb]
            ba = [bytes(char[c] for c in t) if all(c in char for c in t) else t.encode() for t in ea.tokens]
            bb = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
            if b"".join(ba) == b"".join(bb) == (" " + text).encode():
                i = j = at_a = at_b = 0
                own = ([], [])
                while i < len(ba) or j < len(bb):
                    if at_a <= at_b and i < len(ba):
                        own[0].append(ea.ids[i])
                        at_a += len(ba[i])
                        i += 1
                    else:
                        own[1].append(eb[j])
                        at_b += len(bb[j])
                        j += 1
                    if at_a == at_b:
                        groups.append(own)
                        own = ([], [])
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        linked.append(links)
        shown = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append([doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()), hashlib.sha256(shown.encode()).hexdigest() if groups else ""])
    count = Counter(p for links in linked for p in links)
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    for row, links in zip(out, linked, strict=True):
        row += [sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items())]
    return sorted(map(tuple, out), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def test_alignment_of_documents(spark, tokenizers):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = queries()["op12_token_alignment"](spark, SF)
    assert dict(got.dtypes) == {c: "string" if c == "groups_sha256" else "bigint" for c in COLUMNS}
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(list(zip(docs.doc_id.tolist(), docs.text, strict=True)), tokenizers)


def noise(seed, n):
    """Random text over blanks, digits, marks, scripts, private and unassigned characters."""
    r = random.Random(seed)
    pools = [" ", "  \t\n", "\x00\x7f\x85\xa0​ 　", "abcdeXYZ", "0123456789½²٣", "'.,-<|>\"", "äßñéÅ", "漢字仮名", "שלוםعرب", "🙂👩‍👩‍👧🏽", "͸\U000e0001\U0010fffd", "▁", "ǅʰ̈"]
    return "".join(r.choice(r.choice(pools)) * r.choice((1, 1, 1, 2, 7)) for _ in range(n))


def odd_rows():
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\n  \t"), (4, "\n\n  \t"), (None, "lost words"), (None, None), (5, "<|endoftext|> and <s> </s> <unk> <0x41>"), (6, "with ▁ inside"), (7, "\x00\x01 nul"), (8, "x" * 5000), (9, " " * 3000 + "é" * 3000), (10, "日本語" * 2000), (11, "0123456789" * 700)]
    return rows + [(100 + k, noise(k, 150)) for k in range(60)]


def test_alignment_of_odd_texts(spark, tokenizers, monkeypatch):
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, 3, "clash") for i, t in rows], "doc_id long, text string, n_a int, groups string")
    from pyspark.sql import functions as F

    for shard, large in ((align.SHARD, align.LARGE_GROUP), (50, 3)):
        monkeypatch.setattr(align, "LARGE_GROUP", large)
        found = align.align(docs, NAMES).withColumn("groups", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)))
        got = align.with_counts(found.withColumnRenamed("groups", "groups_sha256"), NAMES, shard=shard)
        assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == brute(rows, tokenizers)
    nothing = align.with_counts(align.align(docs.limit(0), NAMES), NAMES)
    assert nothing.collect() == [] and nothing.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]


def test_groups_are_counted_distinct(monkeypatch, tokenizers):
    """Large groups take another way to the same pairs."""
    texts = [noise(k, 300) for k in range(20)]
    own = align.Aligner(NAMES)
    usual = own.align(texts)
    monkeypatch.setattr(align, "LARGE_GROUP", 1)
    assert own.align(texts) == usual


def test_encoders_agree(tokenizers):
    """Both encoders give the same ids on random text: for alignment, and for packing."""
    own, other = align.ByteLevel(A), packing.Encoder(A)
    plain = Tokenizer.from_file(A)
    assert own.fast is not None
    for k in range(400):
        text = noise(k, 200)
        assert own.encode([text])[0] == tokenizers[0].encode(" " + text, add_special_tokens=False).ids
        assert other.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids
