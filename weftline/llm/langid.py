"""Language identification: a linear-chain conditional random field over words, read by forward-backward."""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, fold_of
from .tokens import mix

WORD = re.compile(r"[^\W\d_]+")
#: What WORD takes besides letters: numbers that aren't decimal digits, like fractions and superscripts.
NUMBERS = re.compile("[" + "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isnumeric() and not (c.isalpha() or c.isdecimal())) + "]")
#: Hashed feature space; a power of two.
FEATURES = 1 << 16
#: Texts of a label that a sample has at least, if there are so many.
FEW = 10
#: Words with their scores kept in a worker before the memory is cleared.
MEMORY = 300_000
UNDETERMINED = "und"


@dataclass
class Crf:
    """Weights of hashed word features by label, transitions, first-word weights, and lexicons of each label."""

    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, labels) sums of the weights of each word's features."""
        if not self.labels:
            return np.zeros((len(words), 0))
        owner, ids = features(words, self.lexicon)
        return np.stack([np.bincount(owner, self.weights[ids, y], minlength=len(words)) for y in range(len(self.labels))], axis=1)


_U = np.uint64


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(word, hashed feature) pairs: affixes up to four letters, letter 2- and 3-grams with edges, the word, its lexicon, a bias."""
    n = len(words)
    size = np.fromiter((len(w) for w in words), np.int64, n)
    chars = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    start = np.concatenate(([0], np.cumsum(size + 2)))[:-1]
    word = np.repeat(np.arange(n), size + 2)
    factor = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5)]
    code = lambda kind, *cs: mix(sum(c * f for c, f in zip(cs, factor, strict=False)) + _U(kind * 0x1000003))
    owner, out = [], []

    def add(who: np.ndarray, made: np.ndarray) -> None:
        owner.append(who)
        out.append((made % _U(FEATURES)).astype(np.int64))

    for width in (2, 3):
        same = np.flatnonzero(word[: 1 - width] == word[width - 1 :])
        add(word[same], code(width, *[chars[same + k] for k in range(width)]))
    for width in (1, 2, 3, 4):
        own = np.flatnonzero(size >= width)
        add(own, code(10 + width, *[chars[start[own] + 1 + k] for k in range(width)]))
        add(own, code(20 + width, *[chars[start[own] + size[own] - k] for k in range(width)]))
    if n:
        place = (np.arange(len(chars)) - np.repeat(start, size + 2)).astype(_U)
        add(np.arange(n), code(30, np.add.reduceat(mix(chars + place * factor[1]), start)))
        add(np.arange(n), code(40, np.fromiter((lexicon.get(w, -1) + 2 for w in words), np.int64, n).astype(_U)))
        add(np.arange(n), code(50, np.ones(n, _U)))
    return np.concatenate(owner), np.concatenate(out)


def _chains(text: str) -> list[list[str]]:
    """The words of each line that has any, made of letters alone; a chain ends with its line."""
    found = (WORD.findall(line) for line in text.lower().split("\n"))
    lettered = (c if "".join(c).isalpha() else [x for w in c for x in NUMBERS.split(w) if x] for c in found if c)
    return [c for c in lettered if c]


def _forward_backward(score: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray, pairs: bool = False):
    """Posteriors of words of padded chains, longest first; score is (chain, place, label), in logs.

    With pairs, also the expected counts of transitions.
    """
    n, t_max, k = score.shape
    e = np.exp(np.maximum(score - score.max(axis=2, keepdims=True), -40.0), dtype=np.float64)
    a = np.exp(np.maximum(trans - trans.max(), -40.0))
    alpha, beta = np.ones_like(e), np.ones_like(e)
    live = [int(np.searchsorted(-lengths, -t, "left")) for t in range(t_max)]  # chains longer than t
    alpha[:, 0] = e[:, 0] * np.exp(first - first.max())
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, t_max):
        m = live[t]
        x = (alpha[:m, t - 1] @ a) * e[:m, t]
        alpha[:m, t] = x / x.sum(axis=1, keepdims=True)
    counts = np.zeros((k, k))
    for t in range(t_max - 2, -1, -1):
        m = live[t + 1]
        x = e[:m, t + 1] * beta[:m, t + 1]
        if pairs:
            joint = alpha[:m, t, :, None] * a[None] * x[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        y = x @ a.T
        beta[:m, t] = y / y.sum(axis=1, keepdims=True)
    post = alpha * beta
    post /= np.maximum(post.sum(axis=2, keepdims=True), 1e-300)
    return (post, counts) if pairs else post


def _padded(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each word, given chain lengths."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)


def fit(rows: list[tuple[str, str]], epochs: int = 6, rate: float = 0.25, l2: float = 1e-6, lexicon_words: int = 200, batch: int = 256, seed: int = 4) -> Crf:
    """Learns from (text, label) rows: every word of a text carries its label.

    Chains of two labels are joined end to end, one pair in eight, so that
    transitions between labels are seen. Minibatch Adagrad on the conditional
    likelihood. Rows are ordered first, so the order given doesn't matter.
    """
    rows = sorted({(t, y) for t, y in rows if t and _chains(t)})
    labels = sorted({y for _, y in rows})
    if not labels:
        return Crf([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    k, rng = len(labels), np.random.Generator(np.random.PCG64(seed))
    number = {y: i for i, y in enumerate(labels)}
    seen: dict[str, Counter] = {}
    chains: list[tuple[list[str], list[int]]] = []
    for text, y in rows:
        for c in _chains(text):
            for w in c:
                seen.setdefault(w, Counter())[number[y]] += 1
            chains += [(c[i : i + 64], [number[y]] * len(c[i : i + 64])) for i in range(0, len(c), 64)]
    lexicon: dict[str, int] = {}
    for y in range(k):
        own = sorted(((c[y], w) for w, c in seen.items() if c[y] >= 3 and c[y] >= 0.9 * c.total()), key=lambda x: (-x[0], x[1]))
        lexicon |= {w: y for _, w in own[:lexicon_words]}
    joined = []
    for i in range(len(chains) // 8):
        (a, x), (b, z) = (chains[j] for j in rng.integers(0, len(chains), 2))
        joined.append((a[:16] + b[:16], x[:16] + z[:16]))
    chains += joined

    vocabulary = {w: i for i, w in enumerate(sorted(seen))}
    f_word, f_id = features(list(vocabulary), lexicon)
    order = np.argsort(f_word, kind="stable")
    f_word, f_id = f_word[order], f_id[order]
    f_start = np.searchsorted(f_word, np.arange(len(vocabulary) + 1))
    weights, trans, first = np.zeros((FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    squares = [np.full_like(x, 1e-2) for x in (weights, trans, first)]
    coded = [(np.array([vocabulary[w] for w in c]), np.array(y)) for c, y in chains]
    for _ in range(epochs):
        order = rng.permutation(len(coded))
        for lo in range(0, len(order), batch):
            part = sorted((coded[i] for i in order[lo : lo + batch]), key=lambda x: -len(x[0]))
            lengths = np.array([len(x) for x, _ in part])
            words, gold = np.concatenate([x for x, _ in part]), np.concatenate([y for _, y in part])
            used, at = np.unique(words, return_inverse=True)
            own = np.concatenate([np.arange(f_start[u], f_start[u + 1]) for u in used])
            owner = np.searchsorted(used, f_word[own])
            emission = np.zeros((len(used), k))
            np.add.at(emission, owner, weights[f_id[own]])
            row, place = _padded(lengths)
            score = np.zeros((len(part), lengths[0], k))
            score[row, place] = emission[at]
            post, pairs = _forward_backward(score, lengths, trans, first, pairs=True)
            error = -post[row, place]
            error[np.arange(len(gold)), gold] += 1
            by_word = np.zeros((len(used), k))
            np.add.at(by_word, at, error)
            touched, inverse = np.unique(f_id[own], return_inverse=True)
            g = np.zeros((len(touched), k))
            np.add.at(g, inverse, by_word[owner])
            g = g / len(gold) - l2 * weights[touched]
            follows = place[1:] > 0
            g_trans = -pairs
            np.add.at(g_trans, (gold[:-1][follows], gold[1:][follows]), 1)
            g_trans = g_trans / len(gold) - l2 * trans
            g_first = np.bincount(gold[place == 0], minlength=k) / len(part) - post[:, 0].mean(axis=0)
            squares[0][touched] += g**2
            weights[touched] += rate * g / np.sqrt(squares[0][touched])
            for x, s, d in ((trans, squares[1], g_trans), (first, squares[2], g_first)):
                s += d**2
                x += rate * d / np.sqrt(s)
    return Crf(labels, weights.astype(np.float32), trans, first, lexicon)


class Tagger:
    """Reads texts with a Crf, remembering words' scores."""

    def __init__(self, model: Crf):
        self.model, self.ids, self.scores = model, {}, np.zeros((1024, len(model.labels)), np.float32)

    def _add(self, words: list[str]) -> None:
        while len(self.ids) + len(words) > len(self.scores):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
        if words:
            self.scores[len(self.ids) : len(self.ids) + len(words)] = self.model.scores(words)
            self.ids.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))

    def word_posteriors(self, texts: list[str], pad: int = 400_000) -> list[np.ndarray]:
        """(words, labels) probabilities of each text."""
        k, owner, chains = len(self.model.labels), [], []
        if not k:
            return [np.zeros((0, 0))] * len(texts)
        for i, text in enumerate(texts):
            own = _chains(text)
            owner += [i] * len(own)
            chains += own
        missing = {w for c in chains for w in c} - self.ids.keys()
        if len(self.ids) + len(missing) > MEMORY:
            self.ids.clear()
            missing = {w for c in chains for w in c}
        self._add(sorted(missing))
        ids = self.ids
        coded = [np.array([ids[w] for w in c], np.int64) for c in chains]
        lengths = np.array([len(c) for c in chains], np.int64)
        posts: list = [None] * len(chains)
        order, lo = np.argsort(-lengths, kind="stable"), 0
        while lo < len(order):
            n = max(1, min(len(order) - lo, pad // int(lengths[order[lo]])))
            part, size = order[lo : lo + n], lengths[order[lo : lo + n]]
            row, place = _padded(size)
            score = np.zeros((n, int(size[0]), k), np.float32)
            score[row, place] = self.scores[np.concatenate([coded[i] for i in part])]
            flat = _forward_backward(score, size, self.model.transitions, self.model.first)[row, place]
            for i, x in zip(part, np.split(flat, np.cumsum(size)[:-1]), strict=True):
                posts[i] = x
            lo += n
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for i, x in zip(owner, posts, strict=True):
            out[i].append(x)
        return [np.concatenate(x) if x else np.zeros((0, k)) for x in out]

    def read(self, texts: list[str]) -> list[tuple[str, float]]:
        """(label, share of the words' probability) of each text; und and 0 without a letter or a learned label."""
        out = []
        for post in self.word_posteriors(texts):
            if not post.size:
                out.append((UNDETERMINED, 0.0))
            else:
                share = post.mean(axis=0, dtype=np.float64)
                best = int(share.argmax())
                out.append((self.model.labels[best], float(min(1.0, share[best]))))
        return out


_last: list = []


def _tagger(model: Crf) -> Tagger:
    """One tagger a worker and model: a worker gets the same broadcast object again for each task."""
    if not _last or _last[0] is not model:
        _last[:] = [model, Tagger(model)]
    return _last[1]


def training_sample(docs: DataFrame, where: Column, per_label: int = 250, max_bytes: int = 8_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most per_label (text, label) rows of each label with at most max_bytes of text, lowest hash of the row first.

    Labels are counted first, and only rows whose hash is under the share that
    holds about 16 * per_label rows of their label are ranked, so the rank sees a
    bounded number of rows however many a label has; only the chosen ones reach
    the driver. A label with fewer than FEW such texts gives FEW of its
    shortest ones instead, whole, so that none is lost.
    """
    label, key = F.col(lang_col).cast("string"), F.xxhash64(F.lit(4), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(text_col).alias("_text"), label.alias("_y"), key.alias("_h"), where.alias("_use")).where(F.col("_use") & F.col("_y").isNotNull() & (F.col("_y") != UNDETERMINED))
    rows = rows.withColumn("_n", F.octet_length("_text")).where(F.col("_n") > 0)
    short = F.col("_n") <= max_bytes
    counts = {r["_y"]: (r["n"], r["k"]) for r in rows.groupBy("_y").agg(F.count("*").alias("n"), F.count_if(short).alias("k")).collect()}
    if not counts:
        return []
    of_label = lambda f: F.try_element_at(F.create_map(*[F.lit(x) for y, c in sorted(counts.items()) for x in (y, f(*c))]), F.col("_y"))
    share = of_label(lambda n, k: min(1.0, 16 * per_label / (n if k < FEW else k)))
    room = of_label(lambda n, k: FEW if k < FEW else per_label)
    rows = rows.where((F.pmod("_h", F.lit(1 << 30)) < share * (1 << 30)) & (short | (room == FEW)))
    order = [F.when(short, 0).otherwise(F.col("_n")), "_h", "_text"]
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy(*order))).where((F.col("_r") <= per_label) & (F.col("_r") <= room))
    return [(r["_text"], r["_y"]) for r in rows.select("_text", "_y").collect()]


def train(docs: DataFrame, per_label: int = 250, max_bytes: int = 8_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Crf:
    """Fits on a bounded sample of the labelled rows outside fold 0 of five."""
    return fit(training_sample(docs, fold_of(id_col) != 0, per_label, max_bytes, id_col, text_col, lang_col), **options)


def identify(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns docs plus lang_pred and score, from the text alone.

    The label is the one with the largest share of the words' posterior
    probability, the score that share. A text that is null or has no letter, or
    any text if no label was learned, is und with score 0. Columns of docs with
    the new names give way; an empty table gives an empty table.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    at = own.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _tagger(shared.value)
        for batch in batches:
            for lo in range(0, max(1, batch.num_rows), 200):
                part = batch.slice(lo, 200)
                found = tagger.read([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*own, "lang_pred", "score"])

    return docs.select(*own).mapInArrow(run, schema)


def label_words(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, word, at, label, score): the likeliest label of each word of code-switched texts; at counts words from 0.

    Null and empty texts, and those without a letter, give no rows; nor does a
    model without labels. A null id is answered as null, repeated rows repeat,
    other columns are not read, an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for c in _chains(text or "") for w in c]
                if words and tagger.model.labels:
                    post = tagger.word_posteriors([text])[0]
                    best = post.argmax(axis=1)
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(words), pa.array(np.arange(n, dtype=np.int32)), pa.array([tagger.model.labels[b] for b in best]), pa.array(post[np.arange(n), best].astype(float))], names=["_id", "word", "at", "label", "score"])

    out = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "_id long, word string, at int, label string, score double")
    return out.withColumnRenamed("_id", id_col)
