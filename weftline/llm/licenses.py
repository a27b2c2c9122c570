"""License scans: an exact set-similarity join of the lines of documents with notice templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, row_key, words

#: Phrases whose words, in a row anywhere in a text, name a license.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Notices (label, words of one line). Common short license notices.
TEMPLATES = [
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("rights-reserved", "all rights reserved no part of this publication may be reproduced without permission"),
]
#: Templates are configuration; a list beyond this size is refused rather than broadcast.
MAX_TEMPLATE_WORDS = 100_000


def _starts(ws: Column, phrase: str) -> Column:
    """Indices of the words at which the phrase stands."""
    parts = phrase.split(" ")
    at = F.transform(ws, lambda w, i: F.when((w == parts[0]) & (F.slice(ws, i + 1, len(parts)) == F.array(*map(F.lit, parts))), i))
    return F.filter(at, lambda i: i.isNotNull())


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, _line, label, containment) of every line that holds at least threshold of a template's words.

    Lines and templates are sets of words ordered by their frequency over all
    lines, rarest first. With need = ceil(threshold * template size), a match
    shares a word with the first size - need + 1 words of its template, has
    need words itself, and leaves room for need common words from the first
    shared one on; what passes these filters is counted exactly. Null, empty and
    wordless texts match nothing; repeated rows share a key; an empty table gives
    no rows.
    """
    templates = templates or TEMPLATES
    spark, sets = docs.sparkSession, [(label, sorted(set(text.split()))) for label, text in templates]
    vocabulary = sorted({w for _, t in sets for w in t})
    if len(vocabulary) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"{len(vocabulary)} template words; at most {MAX_TEMPLATE_WORDS} are supported")
    lines = F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("_line", "_text")
    blocks = docs.select(*row_key(id_col, text_col), lines)
    blocks = blocks.select(*KEY, "_line", F.filter(F.array_distinct(words(F.col("_text"))), lambda w: w.isin(vocabulary)).alias("_set")).where(F.size("_set") > 0)

    # Lines per template word: a row for each word of the templates at most.
    lines_of = {r["_tok"]: r["n"] for r in blocks.select(F.explode("_set").alias("_tok")).groupBy("_tok").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary, key=lambda w: (lines_of.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for label, tokens in sets:
        tokens = sorted(tokens, key=rank.get)
        need = max(1, math.ceil(round(threshold * len(tokens), 9)))
        prefixes += [(label, w, i, len(tokens), need, tokens) for i, w in enumerate(tokens[: len(tokens) - need + 1])]
    prefix = spark.createDataFrame(prefixes, "label string, _tok string, _i int, _of int, _need int, _template array<string>")

    least = min(x[4] for x in prefixes)
    ordered = F.array_intersect(F.array(*map(F.lit, order)), "_set")
    pairs = blocks.where(F.size("_set") >= least).withColumn("_set", ordered).select(*KEY, "_line", "_set", F.posexplode("_set").alias("_j", "_tok"))
    pairs = pairs.join(F.broadcast(prefix), "_tok").where(F.size("_set") >= F.col("_need"))
    pairs = pairs.where(F.least(F.col("_of") - F.col("_i"), F.size("_set") - F.col("_j")) >= F.col("_need"))
    pairs = pairs.withColumn("_shared", F.size(F.array_intersect("_set", "_template"))).where(F.col("_shared") >= F.col("_need"))
    return pairs.groupBy(*KEY, "_line", "label").agg(F.max(F.col("_shared") / F.col("_of")).alias("containment"))


def _room(text: str) -> int:
    """Words that a notice may take where it is wrapped: a quarter more than its template."""
    return math.ceil(1.25 * len(text.split()))


def wrapped_matches(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row key, label, containment): blocks of adjacent words, over line ends too, that hold at least threshold of a template's words.

    A block has a quarter more words than the template, so marks, breaks and
    changed words may stand inside. A text is only looked at for the templates
    of which it has enough words at all; then each block that begins with a word
    of the template is counted exactly. Texts of one line are left to
    template_matches(); null, empty and wordless ones give none, repeated rows
    share a key, an empty table gives none, and a long text costs a sort of the
    places of its template words.
    """
    sets = [(label, text, sorted(set(text.split()))) for label, text in templates or TEMPLATES]
    vocabulary = sorted({w for _, _, t in sets for w in t})
    widths = [_room(text) for _, text, _ in sets]
    whole = math.lcm(*widths)  # places are scaled, so that one frame fits every width
    if whole > 1 << 32:
        raise ValueError("template lengths have too large a common multiple; round them")
    need = lambda t: max(1, math.ceil(round(threshold * len(t), 9)))
    specs = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, t)).alias("_template"), F.lit(need(t)).alias("_need"), F.lit(whole // n).cast("long").alias("_scale")) for (label, _, t), n in zip(sets, widths, strict=True)])
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.where(text.contains("\n")).select(*row_key(id_col, text_col), words(F.col(text_col)).alias("_words"))
    rows = rows.withColumn("_set", F.array_intersect("_words", F.array(*map(F.lit, vocabulary)))).where(F.size("_set") >= min(need(t) for _, _, t in sets))
    rows = rows.select(*KEY, "_words", F.inline(F.filter(specs, lambda x: F.size(F.array_intersect("_set", x["_template"])) >= x["_need"])))
    rows = rows.select(*KEY, "label", "_template", "_need", "_scale", F.posexplode("_words").alias("_at", "_tok")).where(F.array_contains("_template", F.col("_tok")))
    block = Window.partitionBy(*KEY, "label").orderBy(F.col("_at") * F.col("_scale")).rangeBetween(0, whole - 1)
    rows = rows.withColumn("_shared", F.size(F.collect_set("_tok").over(block))).where(F.col("_shared") >= F.col("_need"))
    return rows.groupBy(*KEY, "label").agg(F.max(F.col("_shared") / F.size("_template")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns docs plus n_words, starts (of all phrase places, ascending), base_labels, matches and score.

    base_labels are the sorted labels of phrases that occur; matches are sorted
    (label, containment) of the templates that some line, or some block of
    adjacent words over line ends, contains at the threshold; score is the best
    containment, and 1 where a phrase stands. Null or empty texts have no words,
    no labels and score 0. Rows alike in id and text get the same result;
    columns named like the new ones give way. Of several blocks the best counts,
    so ties don't matter; long texts take linear time and a sort of their
    template words; an empty table stays empty.
    """
    new = ["n_words", "starts", "base_labels", "matches", "score"]
    phrases = phrases or PHRASES
    own = [c for c in docs.columns if c not in new]
    kind = "array<struct<label:string,at:int>>"
    rows = docs.select(*own, *row_key(id_col, text_col), words(F.col(text_col)).alias("_w_words"))
    found = F.concat(*[_labelled(_starts(F.col("_w_words"), p), x) for p, x in phrases.items()])
    probe = F.arrays_overlap("_w_words", F.array(*[F.lit(w) for w in sorted({max(p.split(), key=len) for p in phrases})]))
    rows = rows.select(*own, *KEY, F.size("_w_words").cast("long").alias("n_words"), F.when(probe, found).otherwise(F.array().cast(kind)).alias("_w_found"))

    best = template_matches(docs, templates, threshold, id_col, text_col).select(*KEY, "label", "containment")
    best = best.unionByName(wrapped_matches(docs, templates, threshold, id_col, text_col)).groupBy(*KEY, "label").agg(F.max("containment").alias("containment"))
    best = best.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("label", "containment"))).alias("matches"))
    out = rows.join(best, KEY, "left").withColumn("matches", F.coalesce("matches", F.array().cast("array<struct<label:string,containment:double>>")))
    return out.select(
        *own,
        "n_words",
        F.array_sort(F.transform("_w_found", lambda x: x["at"])).alias("starts"),
        F.array_sort(F.array_distinct(F.transform("_w_found", lambda x: x["label"]))).alias("base_labels"),
        "matches",
        F.when(F.size("_w_found") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0))).alias("score"),
    )
