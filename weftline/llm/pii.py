"""Personal data: pattern matches, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, cut, row_key, spread_join

KINDS = ("email", "ip", "card", "phone")
#: The patterns, written so that Java neither recurses nor scans a run twice: a match can only begin where a run of
#: its first characters begins or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for the pattern to be tried.
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Identifier-like strings that contexts may turn into findings: digit chains, and addresses without a dotted domain.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++|(?<![A-Za-z0-9])[0-9]++(?:[\x20.-][0-9]++)*+(?![A-Za-z])"
#: What an instance that nothing confirms or contradicts weighs in a pattern's score, against 1.
UNSEEN = 0.125
#: Digits that a candidate must have to pass for the kind; an email candidate needs none.
DIGITS = {"ip": (4, 12), "card": (13, 19), "phone": (7, 15)}


def _luhn(digits: Column) -> Column:
    """Whether the checksum of a string of digits is right."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (lambda d: F.when((n - i) % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))(F.substring(digits, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, needs: str, kind: int) -> Column:
    """Matches, each with the text since the last match and up to the next one."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # Zipped, so that the text is split once and not again for each match.
    zipped = F.arrays_zip(values.alias("value"), gaps.alias("before"), F.slice(gaps, 2, F.length(text) + 1).alias("after"))
    own = F.filter(zipped, lambda z: z["value"].isNotNull())
    found = F.transform(
        own,
        lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(z["before"]).alias("skip"), z["value"].alias("value"), _edge_word(z["before"], -1).alias("left"), _edge_word(z["after"], 1).alias("right")),
    )
    return F.when(text.rlike(needs), found).otherwise(F.array().cast("array<struct<kind:int,i:int,skip:int,value:string,left:string,right:string>>"))


def _edge_word(gap: Column, side: int) -> Column:
    """The whole word at the end (-1) or the start (1) of a gap on the same line, or the empty string; at most 20 other signs away."""
    if side < 0:
        # a word is tried at its start alone and never given back, so a long one takes linear time
        found = F.regexp_extract(F.substring_index(gap, "\n", -1), r"(?U)(?<![^\W\d_])([^\W\d_]++)[^\w\n]{0,20}\z", 1)
    else:
        found = F.regexp_extract(gap, r"(?U)\A[^\w\n]{0,20}([^\W\d_]++)", 1)
    return ascii_lower(found)


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, kind, start, end, value, left, right, holds) of every match; kind is the place in KINDS, and 4 for candidates.

    Matches that fail their kind's test have holds false. Start and end are
    code points. Only rows with a match are built, one a match, so a text with
    very many costs a sort of its own matches and no more.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = F.concat(*[_matches(text, PATTERNS[k], NEEDS[k], i) for i, k in enumerate(KINDS)], _matches(text, CANDIDATE, "[0-9@]", len(KINDS)))
    rows = docs.select(*row_key(id_col, text_col), F.inline(every)).distinct()
    upto = Window.partitionBy(*KEY, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("skip") + F.length("value")).over(upto).cast("int")).withColumn("start", F.col("end") - F.length("value"))
    holds = F.lit(True)
    for i, k in enumerate(KINDS):
        holds = F.when(F.col("kind") == i, _holds(k, F.col("value"))).otherwise(holds)
    return rows.select(*KEY, "kind", "start", "end", "value", "left", "right", holds.alias("holds"))


def _free_candidates(found: DataFrame) -> DataFrame:
    """Candidates that touch no base match of their text."""
    w = Window.partitionBy(*KEY).orderBy("start", "_base")
    base = F.col("kind") < len(KINDS)
    rows = found.where(F.col("holds")).withColumn("_base", F.when(base, 0).otherwise(1))
    rows = rows.withColumn("_reach", F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_next", F.min(F.when(base, F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.where(~base & (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end")))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    fits = [F.when(F.col("value").contains("@"), F.lit(0))]
    fits += [F.when(~F.col("value").contains("@") & digits.between(lo, hi) & (F.col("value").contains(".") if k == "ip" else F.lit(True)), F.lit(KINDS.index(k))) for k, (lo, hi) in DIGITS.items()]
    return rows.select(*KEY, "start", "end", "value", "left", "right", F.explode(F.array_compact(F.array(*fits))).alias("kind"))


def _norm(kind: Column, value: Column) -> Column:
    """What spellings of an identifier share: an address lower-cased, else its digits; of an ip the places of its dots too."""
    digits = F.when(kind == KINDS.index("ip"), F.regexp_replace(value, "[^0-9]+", ".")).otherwise(F.regexp_replace(value, "[^0-9]", ""))
    return F.when(value.contains("@"), ascii_lower(value)).otherwise(digits)


def _contexts(rows: DataFrame) -> DataFrame:
    """Edges of the pattern-instance graph: the words that stand before and after an instance."""
    sides = F.array(F.concat(F.lit("<"), F.col("left")), F.concat(F.lit(">"), F.col("right")))
    edges = rows.select("kind", _norm(F.col("kind"), F.col("value")).alias("instance"), F.explode(sides).alias("pattern"))
    return edges.where(F.length("pattern") > 1).distinct()


def discover(found: DataFrame, rounds: int = 2, min_support: int = 3, min_confidence: float = 0.8) -> DataFrame:
    """Candidates (key, kind, start, end) that contexts of confirmed identifiers vouch for.

    Base matches are seeds with confidence 1, other instances start at 0. Each
    round scores a pattern of a kind by the confidence of its distinct
    instances over their weights, smoothed by one more: an instance confirmed
    as another kind weighs 1, another its confidence and UNSEEN at least, so
    that identifiers not seen elsewhere hardly speak against their context, but
    a word before very many unconfirmed numbers fails. It drops patterns with
    fewer than
    min_support confident instances or a score under min_confidence; an instance
    then takes the noisy-or of its patterns. Instances whose patterns reach
    min_confidence in the last round are found, wherever they occur, seeds in
    another spelling too; found is from occurrences(), and an empty one gives none.

    Edges are distinct before any join; what is joined on a pattern or an
    instance is counted first, so a word beside most identifiers, or an
    identifier in most texts, is dealt to several tasks.
    """
    base = found.where(F.col("holds") & (F.col("kind") < len(KINDS)))
    free = cut(_free_candidates(found))
    seeds = _contexts(base).withColumn("_seed", F.lit(1.0))
    edges = seeds.unionByName(_contexts(free).withColumn("_seed", F.lit(0.0)))
    edges = edges.groupBy("kind", "instance", "pattern").agg(F.max("_seed").alias("_seed"))
    known = edges.groupBy("kind", "instance").agg(F.max("_seed").alias("_known"))
    elsewhere = F.max("_known").over(Window.partitionBy("instance"))
    known = known.withColumn("_least", F.when(elsewhere > F.col("_known"), 1.0).otherwise(UNSEEN))
    by_instance, by_pattern = (cut(edges.groupBy("kind", c).agg(F.count("*").alias("_n"))) for c in ("instance", "pattern"))
    n = by_pattern.agg(F.sum("_n")).first()[0] or 0
    edges = spread_join(edges.drop("_seed"), known, ["kind", "instance"], by_instance, n)
    edges = cut(edges.withColumn("conf", F.col("_known")).withColumn("_v", F.lit(0.0)))
    for _ in range(rounds):
        patterns = edges.groupBy("kind", "pattern").agg((F.sum("conf") / (F.sum(F.greatest("conf", "_least")) + 1)).alias("_p"), F.count_if(F.col("conf") >= min_confidence).alias("_support"))
        patterns = patterns.where((F.col("_support") >= min_support) & (F.col("_p") >= min_confidence)).select("kind", "pattern", "_p")
        vouched = spread_join(edges.select("kind", "instance", "pattern"), patterns, ["kind", "pattern"], by_pattern, n)
        vouched = vouched.groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("_p"), F.lit(0.999999)))))).alias("_v"))
        edges = spread_join(edges.drop("_v"), vouched, ["kind", "instance"], by_instance, n, "left")
        edges = cut(edges.withColumn("conf", F.greatest("_known", F.coalesce("_v", F.lit(0.0)))))
    trusted = edges.where(F.col("_v") >= min_confidence).select("kind", "instance").distinct()
    free = free.withColumn("instance", _norm(F.col("kind"), F.col("value")))
    often = cut(free.groupBy("kind", "instance").agg(F.count("*").alias("_n")))
    hits = spread_join(free, trusted, ["kind", "instance"], often, often.agg(F.sum("_n")).first()[0] or 0)
    # A string that fits several kinds is reported once, as the first of them.
    return hits.groupBy(*KEY, "start", "end").agg(F.min("kind").alias("kind"))


def scan(docs: DataFrame, rounds: int = 2, min_support: int = 3, min_confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns docs plus spans: sorted (kind, start, end, found), kind by its place in KINDS.

    found is false for pattern matches and true for what contexts add; added
    spans never touch pattern matches. Null and empty texts have no spans. Rows
    alike in id and text get the same spans; a column named spans gives way. A
    string that fits several kinds is reported as the first of them; the order
    of rows decides nothing. Time is linear in a text's length, and a text with
    very many matches is sorted by them alone. An empty table stays empty.
    """
    found = cut(occurrences(docs, id_col, text_col))
    base = found.where(F.col("holds") & (F.col("kind") < len(KINDS))).select(*KEY, "kind", "start", "end", F.lit(False).alias("found"))
    more = discover(found, rounds, min_support, min_confidence).select(*KEY, "kind", "start", "end", F.lit(True).alias("found"))
    spans = base.unionByName(more).groupBy(*KEY).agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end", "found"))).alias("spans"))
    own = [c for c in docs.columns if c != "spans"]
    out = docs.select(*own, *row_key(id_col, text_col)).join(spans, KEY, "left")
    return out.select(*own, F.coalesce("spans", F.array().cast("array<struct<kind:int,start:int,end:int,found:boolean>>")).alias("spans"))


def redact(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces every span of scan() by its kind in brackets; overlapping spans become one, named by the first.

    Null text becomes the empty text. Repeated rows repeat, other columns stay,
    an empty table stays empty.
    """
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    kinds = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.get(kinds, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return scanned.withColumn(text_col, done)
