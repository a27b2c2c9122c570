"""Ignore files: their patterns as regular expressions, asked of every folder on a path and of the path itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import bind
from weftline.sources.files import project_files

#: Pieces of a pattern: an escaped character, stars with their slashes, a wildcard, a set, or a character.
PIECES = r"\\.|^\*\*/|/\*\*/|/\*\*$|\*+|\?|\[[!^]?\]?[^\]]*\]|."


def _literal(c: Column) -> Column:
    return F.when(c.rlike("^[A-Za-z0-9_]$") | (c > "\x7f"), c).otherwise(F.concat(F.lit("\\"), c))


def _piece(p: Column) -> Column:
    """A piece as a regular expression; nothing but stars between slashes crosses one."""
    inside = F.replace(F.regexp_replace(F.substring(p, 2, 10_000), "^[!^]", ""), F.lit("\\"), F.lit("\\\\"))
    inside = F.replace(F.regexp_replace(inside, r"([\[&])", r"\\$1"), F.lit("^"), F.lit("\\^"))
    charset = F.concat(F.when(p.rlike(r"^\[[!^]"), "(?!/)[^").otherwise("(?!/)["), inside)
    return (
        F.when(p == "**/", "(?:.*/)?")
        .when(p == "/**/", "/(?:.*/)?")
        .when(p == "/**", "/.+")
        .when(p.startswith("*"), "[^/]*")
        .when(p == "?", "[^/]")
        .when((F.length(p) > 1) & p.startswith("["), charset)
        .when((F.length(p) > 1) & p.startswith("\\"), _literal(F.substring(p, 2, 1)))
        .otherwise(_literal(p))
    )


def compiled(pattern: Column) -> Column:
    """(regex, negated, folders_only) of a line of an ignore file; regex is null for blank lines and comments.

    The expression holds for a path relative to the file's folder. A pattern
    with a slash at its start or inside is bound to that folder, others match at
    any depth. `!` takes back, a slash at the end means folders, blanks at the
    end go unless escaped, a backslash makes any character plain.
    """
    line = F.regexp_replace(pattern, r"(?<!\\)[ \t\r]+$", "")
    negated = line.startswith("!")
    body = F.when(negated, F.substring(line, 2, 10_000)).otherwise(line)
    folders = body.rlike(r"[^\\]/$|^/$")
    body = F.when(folders, F.regexp_replace(body, "/$", "")).otherwise(body)
    bound = body.contains("/")
    pieces = F.regexp_extract_all(F.regexp_replace(body, "^/", ""), F.lit(PIECES), F.lit(0))
    regex = F.concat(F.when(bound, "^").otherwise("^(?:.*/)?"), F.array_join(F.transform(pieces, _piece), ""), F.lit("$"))
    nothing = (body == "") | line.startswith("#")
    return F.struct(F.when(~nothing, regex).alias("regex"), negated.alias("negated"), folders.alias("folders_only"))


def rules(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(folder, rules): the patterns of each ignore file in their order, by the folder that it lies in; '' is the root."""
    folder = F.regexp_replace(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), "/$", "")
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: compiled(x))
    own = F.filter(lines, lambda r: r["regex"].isNotNull())
    return files.select(folder.alias("folder"), own.alias("rules")).where(F.size("rules") > 0)


def _above(path: Column) -> Column:
    """The folders on the way to a path, the root first, without the path itself."""
    return bind(F.split(path, "/"), lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda n: F.array_join(F.slice(p, 1, n), "/")))


def _decided(paths: DataFrame, by_folder: DataFrame, is_folder: bool) -> DataFrame:
    """The paths that the last matching rule ignores; rules of deeper folders come after those above them."""
    rows = paths.select("path", F.posexplode(_above(F.col("path"))).alias("_depth", "folder")).join(by_folder, "folder")
    relative = F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substring(path, length(folder) + 2)"))
    hits = F.filter("rules", lambda r: (F.lit(is_folder) | ~r["folders_only"]) & F.regexp_like(F.col("_relative"), r["regex"]))
    rows = rows.withColumn("_relative", relative).withColumn("_hits", hits).where(F.size("_hits") > 0)
    last = rows.groupBy("path").agg(F.max_by(F.element_at("_hits", -1)["negated"], "_depth").alias("_negated"))
    return last.where(~F.col("_negated")).select("path")


def ignored(paths: DataFrame, by_folder: DataFrame) -> DataFrame:
    """The paths, of files, that rules() ignore: by a rule of their own, or with a folder on their way.

    A folder that is ignored takes all below it along, whatever rules say there.
    Each folder is decided once, however many files it holds.
    """
    paths = paths.select("path").where(F.col("path").isNotNull()).distinct()
    ways = paths.select("path", F.explode(_above(F.col("path"))).alias("_folder")).where(F.col("_folder") != "")
    shut = _decided(ways.select(F.col("_folder").alias("path")).distinct(), by_folder, True)
    below = ways.join(shut.select(F.col("path").alias("_folder")), "_folder", "left_semi").select("path")
    return below.unionAll(_decided(paths, by_folder, False)).distinct()


def project_scan(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """(path, length) of a project's files in order, without what its own ignore files leave out; files are (path, length, text)."""
    own = rules(files.where(F.regexp_extract("path", "[^/]+$", 0) == name).select("path", "text"))
    return project_files(files, ignored(files, own))
