"""Row-level edits of texts and fact lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def occurrences(c: Column, part: Column) -> Column:
    """How often part stands in c, without overlap."""
    return F.when(F.length(part) > 0, ((F.length(c) - F.length(F.replace(c, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def replace_exact(df: DataFrame, old: str, new: str, every: bool = False, text: str = "text") -> DataFrame:
    """Adds edited and outcome (ok, missing, ambiguous): the text changes only if old stands once, or with every."""
    n = occurrences(F.col(text), F.lit(old))
    outcome = F.when(n == 0, "missing").when((n > 1) & F.lit(not every), "ambiguous").otherwise("ok")
    rows = df.withColumn("outcome", outcome)
    return rows.withColumn("edited", F.when(F.col("outcome") == "ok", F.replace(F.col(text), F.lit(old), F.lit(new))).otherwise(F.col(text)))


def numbered(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, cut to what there is) with their numbers."""
    first = F.greatest(start, F.lit(1))
    own = F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0)))
    return F.array_join(F.transform(own, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)), "\n")


def _line_at(text: Column, place: Column) -> Column:
    """The line, from 1, of a place in a text, from 1."""
    return F.size(F.split(F.left(text, place - 1), "\n"))


def edit_report(df: DataFrame, old: str, new: str, every: bool = False, text: str = "text", context: int = 4) -> DataFrame:
    """replace_exact() with report: the edited lines with `context` more around them, or where old, or lines of it, nearly stands.

    A text without old shows, for up to two of its first three lines that stand
    inside a line, that line with two around it; one with several shows the first
    two with one around each.
    """
    rows = replace_exact(df, old, new, every, text)
    lines = lambda c: F.split(c, "\n")
    at = F.instr(F.col("edited"), new) if every else F.instr(F.col(text), old)
    line, reach = _line_at(F.col("edited"), at), len(new.split("\n")) - 1
    shown = numbered(lines(F.col("edited")), line - context, line + reach + context)

    def near(needle: str, around: int, most: int) -> Column:
        hits = F.filter(F.transform(lines(F.col(text)), lambda x, i: F.when(x.contains(needle), i + 1)), lambda i: i.isNotNull())
        return F.transform(F.slice(hits, 1, most), lambda i: F.concat(F.lit("near line "), i.cast("string"), F.lit("\n"), numbered(lines(F.col(text)), i - around, i + around)))

    parts = [x.strip() for x in old.strip().split("\n")[:3] if x.strip()]
    hints = F.slice(F.concat(*[near(x, 2, 1) for x in parts]), 1, 2) if parts else F.array().cast("array<string>")
    report = F.when(F.col("outcome") == "ok", shown).when(F.col("outcome") == "missing", F.array_join(hints, "\n")).otherwise(F.array_join(near(old.strip().split("\n")[0], 1, 2), "\n"))
    return rows.withColumn("report", report)


def line_diff(old: Column, new: Column) -> Column:
    """All old lines with -, then all new ones with +."""
    marked = lambda c, sign: F.transform(F.split(c, "\n"), lambda x: F.concat(F.lit(sign), x))
    return F.array_join(F.concat(marked(old, "- "), marked(new, "+ ")), "\n")


def find_facts(facts: DataFrame, needle: str, store: str | None = None) -> DataFrame:
    """Fact lines that contain needle in any case, without comments."""
    rows = facts.where(F.lower("line").contains(needle.lower()) & ~F.ltrim("line").startswith("<!--"))
    return rows.where(F.col("store") == store) if store else rows


def upsert_fact(facts: DataFrame, store: str, content: str, limit: int = 2200, now: Column | None = None) -> DataFrame:
    """The first line of the store, headings and comments apart, that contains content is replaced by it; without one it is added at the end.

    With now, a comment says when it was added. A store that would have more
    than limit characters stays as it was; what a replaced line had counts no more.
    """
    trimmed, mine = F.ltrim("line"), F.col("store") == store
    own = mine & F.col("line").contains(content) & ~trimmed.startswith("#") & ~trimmed.startswith("<!--")
    size = F.sum(F.when(mine, F.length("line") + 1).otherwise(0))
    found = F.min_by(F.length("line"), F.when(own, F.col("line_no")))
    state = facts.agg(F.min(F.when(own, F.col("line_no"))).alias("_at"), F.max(F.when(mine, F.col("line_no"))).alias("_last"), F.coalesce(size, F.lit(0)).alias("_size"), found.alias("_old"))
    note = F.concat(F.lit("<!-- added "), F.date_format(now, "yyyy-MM-dd HH:mm:ss"), F.lit(" -->")) if now is not None else None
    more = F.when(F.col("_at").isNotNull(), -F.col("_old")).otherwise(F.lit(0 if now is None else len("<!-- added 2000-01-01 00:00:00 -->") + 1) + F.when(F.col("_size") > 0, 1).otherwise(0))
    # lines are joined by one character each, so the last one counted is too many
    state = state.withColumn("_fits", F.greatest(F.col("_size") - 1, F.lit(0)) + more + len(content) + 2 <= limit)
    changed = F.when(F.col("_fits") & (F.col("store") == store) & (F.col("line_no") == F.col("_at")), F.lit(f"- {content}")).otherwise(F.col("line"))
    rows = facts.crossJoin(F.broadcast(state)).select("store", "line_no", changed.alias("line"))
    new = [F.lit(f"- {content}")] + ([note] if note is not None else [])
    added = state.where(F.col("_at").isNull() & F.col("_fits")).select("_last", F.posexplode(F.array(*new)).alias("_i", "line"))
    line_no = (F.coalesce("_last", F.lit(0)) + 1 + F.col("_i")).cast(facts.schema["line_no"].dataType)
    return rows.unionByName(added.select(F.lit(store).alias("store"), line_no.alias("line_no"), "line"))


def remove_fact(facts: DataFrame, store: str, needle: str) -> DataFrame:
    """Drops the one line that contains needle, and a comment right after it; several or none change nothing."""
    hit = (F.col("store") == store) & F.col("line").contains(needle) & ~F.ltrim("line").startswith("<!--")
    state = facts.agg(F.count_if(hit).alias("_n"), F.min(F.when(hit, F.col("line_no"))).alias("_at"))
    rows = facts.crossJoin(F.broadcast(state))
    follows = (F.col("line_no") == F.col("_at") + 1) & F.ltrim("line").startswith("<!--")
    gone = (F.col("_n") == 1) & (F.col("store") == store) & ((F.col("line_no") == F.col("_at")) | follows)
    return rows.where(~F.coalesce(gone, F.lit(False))).select("store", "line_no", "line")


def matches(df: DataFrame, pattern: str, key: str, text: str = "text", width: int = 200, include: str | None = None) -> DataFrame:
    """(key, line_no, line) of all matching lines, in no order, cut to width. With include, only of keys whose last part fits that glob."""
    df = df.where(F.substring_index(F.col(key).cast("string"), "/", -1).rlike(glob_pattern(include))) if include else df
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "line")).where(F.col("line").rlike(pattern))
    return rows.select(key, (F.col("_i") + 1).alias("line_no"), F.substring("line", 1, width).alias("line"))


def grep(df: DataFrame, pattern: str, key: str, text: str = "text", most: int = 500, width: int = 200, include: str | None = None) -> DataFrame:
    """(key, line_no, line) of matching lines, cut to width; at most `most`, in order. With include, only of keys whose last part fits that glob."""
    return matches(df, pattern, key, text, width, include).orderBy(key, "line_no").limit(most)


def grep_lines(df: DataFrame, pattern: str, path: str = "path", text: str = "text", most: int = 500, width: int = 200, include: str | None = None) -> DataFrame:
    """(at, shown): path:line:text of the first `most` matches in order, then one row that says how many more there are.

    The matches are counted where they are found, and of each task only the
    first `most` go on, so no task gets them all.
    """
    found = matches(df, pattern, path, text, width, include)
    shown = found.orderBy(path, "line_no").limit(most).select(F.struct(F.col(path).cast("string"), "line_no").alias("at"), F.concat_ws(":", path, "line_no", "line").alias("shown"))
    more = found.agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    rest = more.select(F.lit(None).cast(shown.schema["at"].dataType).alias("at"), F.concat(F.lit("... ("), (F.col("_n") - most).cast("string"), F.lit(" more matches)")).alias("shown"))
    return shown.unionByName(rest).orderBy(F.asc_nulls_last("at"))


def read_marker(df: DataFrame, offset: int = 1, limit: int = 3000, max_chars: int = 32_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, marker): what follows ranged_read(): where to go on, or that the text ends."""
    last = ranged_read(df, offset, limit, max_chars, key, text).groupBy(key).agg(F.max("line_no").alias("_last"))
    rows = df.select(key, F.size(F.split(F.col(text), "\n")).alias("_total")).join(last, key, "left").withColumn("_last", F.coalesce("_last", F.lit(offset - 1)))
    on = F.format_string(f"(Showing lines {offset}-%d of %d. Use offset=%d to continue.)", "_last", "_total", F.col("_last") + 1)
    return rows.select(key, F.when(F.col("_last") < F.col("_total"), on).otherwise(F.format_string("(End of file - total %d lines)", "_total")).alias("marker"))


def list_folder(files: DataFrame, folder: str = "", path: str = "path", offset: int = 1, limit: int = 3000) -> DataFrame:
    """(pos, name, total): the entries of a folder in order, folders with a slash at the end, from offset on."""
    base = folder.strip("/") + "/" if folder.strip("/") else ""
    rest = F.substring(F.col(path), len(base) + 1, 1_000_000)
    name = F.when(rest.contains("/"), F.concat(F.substring_index(rest, "/", 1), F.lit("/"))).otherwise(rest)
    names = files.where(F.col(path).startswith(base)).select(name.alias("name")).distinct()
    first = names.orderBy("name").limit(offset - 1 + limit)  # what is numbered is bounded
    rows = first.withColumn("pos", F.row_number().over(Window.orderBy("name"))).where(F.col("pos") >= offset)
    return rows.crossJoin(F.broadcast(names.agg(F.count("*").alias("total")))).select("pos", "name", "total")


def containing(rows: DataFrame, needle: str, path: str = "path") -> DataFrame:
    """Rows whose path contains needle in any case."""
    return rows.where(F.lower(path).contains(needle.lower()))


def ranged_read(df: DataFrame, offset: int = 1, limit: int = 3000, max_chars: int = 32_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, shown) of lines from offset on, numbered, while their characters fit max_chars."""
    rows = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "_line")).where((F.col("_i") >= offset - 1) & (F.col("_i") < offset - 1 + limit))
    rows = rows.select(key, (F.col("_i") + 1).alias("line_no"), F.concat((F.col("_i") + 1).cast("string"), F.lit(": "), F.col("_line")).alias("shown"))
    used = F.sum(F.length("shown") + 1).over(Window.partitionBy(key).orderBy("line_no"))
    return rows.withColumn("_used", used).where(F.col("_used") <= max_chars).drop("_used")


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? don't, [ab] and [!ab] are classes."""
    out, i = "", 0
    while i < len(glob):
        closing = glob.find("]", i + 2) if glob[i] == "[" else -1
        if closing > 0:
            inner = glob[i + 1 : closing].replace("\\", r"\\").replace("[", r"\[").replace("&", r"\&")
            out, i = out + "[" + ("^/" + inner[1:] if inner[0] == "!" else inner.replace("^", r"\^", 1) if inner[0] == "^" else inner) + "]", closing + 1
            continue
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if c in ".^$+{}()|[]\\" else c
            i += 1
    return f"^{out}$"


def glob(df: DataFrame, pattern: str, path: str = "path", most: int = 200) -> DataFrame:
    """(path, total): the first paths that match, in order, and how many match in all."""
    hits = df.where(F.col(path).rlike(glob_pattern(pattern))).select(path)
    return hits.orderBy(path).limit(most).crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))
