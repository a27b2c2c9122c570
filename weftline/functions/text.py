"""Text as columns: tokens, stems, markup, classifiers. Everything here is a Spark expression."""

from __future__ import annotations

import html.entities
import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values, in the order of the tokenizer they belong to: letters that lose their accents.
ACCENTED, PLAIN = "áéíóúÁÉÍÓÚüÜñÑ", "aeiouAEIOUuUnN"
# Words that are no tokens.
STOP_WORDS = [
    "el", "la", "los", "las", "lo", "les", "le", "un", "una", "unos", "unas", "de", "del", "a", "en", "por", "para", "con", "sin", "al", "ante", "bajo",
    "contra", "desde", "durante", "hacia", "hasta", "mediante", "segun", "sobre", "tras", "via", "y", "e", "o", "u", "pero", "porque", "que", "pues",
    "si", "aunque", "como", "cuando", "donde", "mientras", "salvo", "excepto", "yo", "tu", "tú", "ella", "ello", "nos", "nosotros", "vos", "vosotros",
    "ustedes", "me", "te", "se", "os", "mi", "mis", "tus", "su", "sus", "este", "esta", "esto", "ese", "esa", "eso", "aquel", "aquella", "aquello",
    "quien", "cual", "cuyo", "es", "son", "fue", "fueron", "era", "eran", "soy", "eres", "somos", "estan", "estaba", "hay", "ha", "han", "he", "hemos",
    "haber", "ser", "estar", "sido", "siendo", "muy", "mas", "menos", "todo", "toda", "todos", "todas", "nada", "algo", "cada", "otro", "otra", "otros",
    "otras", "mismo", "misma", "entre", "asi", "tambien", "tampoco", "aqui", "alli", "alla", "ya", "aun", "todavia", "solo", "sola", "no", "puede",
    "debe", "podria", "the", "and", "for", "are", "you", "our", "out", "not", "but", "with", "this", "that",
]
# Suffixes that a stem loses, without the accented ones: accents are folded first, so those can't match.
SUFFIXES = [
    "erais", "asteis", "isteis", "abais", "ando", "endo", "anza", "anzas", "ario", "arios", "aria", "arias", "ador", "adora", "adores", "adoras", "ante",
    "antes", "ente", "entes", "miento", "mientos", "menta", "mento", "idad", "idades", "ible", "ibles", "ismo", "ismos", "ista", "istas", "ivo", "iva",
    "ivos", "ivas", "aje", "ajes", "eza", "ezas", "aba", "ada", "ido", "ar", "er", "ir", "as", "es", "an", "en", "in", "os", "a", "o", "e", "s",
]
# Words that a query is widened by.
SYNONYMS = {
    "crear": ["generar", "construir", "nuevo", "hacer"], "buscar": ["encontrar", "localizar", "consultar", "recuperar"],
    "obtener": ["recuperar", "conseguir", "leer", "sacar"], "eliminar": ["borrar", "remover", "quitar", "suprimir"],
    "actualizar": ["modificar", "editar", "cambiar", "update"], "insertar": ["agregar", "anadir", "incluir", "meter"],
    "listar": ["enumerar", "mostrar", "ver", "obtener"], "procesar": ["ejecutar", "realizar", "correr", "manipular"],
    "configurar": ["establecer", "definir", "ajustar", "setear"], "validar": ["verificar", "comprobar", "chequear"],
    "iniciar": ["comenzar", "empezar", "arrancar", "start"], "finalizar": ["terminar", "acabar", "completar", "end"],
    "cargar": ["load", "leer", "importar"], "guardar": ["save", "almacenar", "persistir", "escribir"],
    "archivo": ["fichero", "file", "documento"], "usuario": ["user", "cliente", "persona"], "datos": ["data", "informacion", "contenido"],
    "funcion": ["function", "metodo", "operacion"], "variable": ["var", "campo", "atributo", "field"], "clase": ["class", "tipo", "estructura"],
    "interfaz": ["interface", "contrato", "api"], "lista": ["array", "slice", "coleccion", "vector"], "mapa": ["map", "diccionario", "hash"],
    "error": ["err", "fallo", "exception"], "prueba": ["test", "testear", "probar", "verificar"],
    "base": ["base de datos", "bd", "database", "db", "sql"], "servicio": ["service", "api", "endpoint", "rest"],
    "create": ["crear", "nuevo", "generar"], "find": ["buscar", "encontrar", "localizar"], "delete": ["eliminar", "borrar"],
    "update": ["actualizar", "modificar"], "get": ["obtener", "recuperar", "leer"], "set": ["establecer", "definir", "poner"],
    "save": ["guardar", "almacenar"], "load": ["cargar", "leer"],
}
# Languages by extension.
LANGUAGES = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".jsx": "jsx", ".tsx": "tsx", ".rs": "rust", ".java": "java", ".rb": "ruby",
    ".php": "php", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".scala": "scala", ".r": "r",
    ".lua": "lua", ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".fish": "bash", ".ps1": "powershell", ".pl": "perl", ".pm": "perl", ".tex": "latex",
    ".md": "markdown", ".rst": "rst", ".txt": "text", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".html": "html", ".htm": "html",
    ".css": "css", ".scss": "scss", ".sass": "sass", ".less": "less", ".sql": "sql", ".toml": "toml", ".ini": "ini", ".cfg": "ini", ".env": "env",
    ".dockerfile": "dockerfile",
}
#: Between words, and inside identifiers at case and digit boundaries; before a small ASCII letter only a digit makes one.
BREAK = r"[^\p{L}\p{Nd}]+|(?<=\p{Nd})(?=\p{L})|(?![a-z])(?:(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Lu})(?=\p{Lu}\p{Ll}))"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fold_accents(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.translate(c, ACCENTED, PLAIN))


def raw_parts(c: Column) -> Column:
    """Runs of letters and digits, cut at case and digit boundaries, in their own case."""
    return F.split(fold_accents(c), BREAK)


def stem(word: Column) -> Column:
    """Strips the longest listed suffix that leaves two bytes; words of three bytes or fewer stay."""
    out = None
    for n in sorted({len(x) for x in SUFFIXES}, reverse=True):
        test = (F.octet_length(word) >= max(4, n + 2)) & F.right(word, F.lit(n)).isin([x for x in SUFFIXES if len(x) == n])
        cut = F.left(word, F.char_length(word) - n)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    return out.otherwise(word)


def _is_word(c: Column) -> Column:
    return (F.octet_length(c) >= 2) & ~c.isin(STOP_WORDS)


def tokenize(c: Column) -> Column:
    """Tokens of a text in order, as an array."""
    words = F.filter(F.transform(raw_parts(c), F.lower), _is_word)
    return F.filter(F.transform(words, stem), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def token_rows(df: DataFrame, text: Column, *keep: str, outer: bool = False) -> DataFrame:
    """(keep..., term), a row a token: the same tokens as tokenize(), exploded before filtering so that all of it is compiled.

    With outer, what is no token has a null term, so that a text without tokens
    has rows too. A word's lower case and its stem are each made by a generator,
    so that what asks for them several times doesn't compute them again.
    """
    explode = F.explode_outer if outer else F.explode
    words = df.select(*keep, explode(F.transform(raw_parts(text), F.lower)).alias("_w"))
    words = words if outer else words.where(_is_word(F.col("_w")))
    stems = F.array(F.when(_is_word(F.col("_w")), stem(F.col("_w"))) if outer else stem(F.col("_w")))
    words = words.select(*keep, F.explode(stems).alias("term"))
    good = (F.col("term") != "") & ~F.col("term").isin(STOP_WORDS)
    return words.withColumn("term", F.when(good, F.col("term"))) if outer else words.where(good)


def tokenize_query(query: str) -> list[str]:
    """tokenize() of a short string, on the driver: letters are the categories L, digits Nd, cases Lu and Ll."""
    kinds = [(c, unicodedata.category(c)) for c in query.translate(str.maketrans(ACCENTED, PLAIN))]
    parts, n = [""], len(kinds)
    for i, (c, kind) in enumerate(kinds):
        if kind[0] != "L" and kind != "Nd":
            parts.append("")
            continue
        before, after = kinds[i - 1][1] if i else "", kinds[i + 1][1] if i + 1 < n else ""
        if (before == "Ll" and kind == "Lu") or (before[:1] == "L" and kind == "Nd") or (before == "Nd" and kind[0] == "L") or (before == kind == "Lu" and after == "Ll"):
            parts.append("")
        parts[-1] += c
    words = [w for w in map(str.lower, parts) if len(w.encode()) >= 2 and w not in STOP_WORDS]
    return [w for w in map(stem_word, words) if w and w not in STOP_WORDS]


_ENDS = [(n, frozenset(x for x in SUFFIXES if len(x) == n)) for n in sorted({len(x) for x in SUFFIXES}, reverse=True)]

_LAST = {x[-1] for x in SUFFIXES}


def stem_word(word: str) -> str:
    """stem() of one word."""
    size = len(word.encode())
    if size > 3 and word[-1] in _LAST:
        for n, ends in _ENDS:
            if size - n >= 2 and word[-n:] in ends:
                return word[:-n]
    return word


def countable(c: Column) -> Column:
    """A text for count_terms(): what isn't ASCII and no letter or digit to Spark is a space, so that both know the same letters."""
    c = F.make_valid_utf8(c)
    return F.when(F.octet_length(c) == F.char_length(c), c).otherwise(F.regexp_replace(c, r"[^\x00-\x7f\p{L}\p{Nd}]+", " "))


class _Terms(dict):
    """The tokens of runs of letters and digits, each run cut and stemmed when it is first seen; emptied when it is full."""

    most, stops = 300_000, frozenset(STOP_WORDS)
    #: Runs that have no place to be cut at: small letters, perhaps after a capital, or capitals.
    plain = re.compile("[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+")
    folded = str.maketrans(ACCENTED, PLAIN)

    def __missing__(self, run: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        if self.plain.fullmatch(run):
            word = (run if run.isascii() else run.translate(self.folded)).lower()
            term = stem_word(word) if len(word.encode()) >= 2 and word not in self.stops else ""
            terms = (term,) if term and term not in self.stops else ()
        else:
            terms = tuple(tokenize_query(run))
        self[run] = terms
        return terms


_TERMS = _Terms()


def count_terms(texts: pa.Array) -> tuple[np.ndarray, pa.ListArray, pa.ListArray]:
    """(tokens, terms, tfs) of countable() texts: each one's number of tokens, its distinct ones and how often it has each; tokens are those of tokenize()."""
    n = len(texts)
    runs = pc.split_pattern_regex(pc.fill_null(texts, ""), r"[\x00-/:-@\[-`{-\x7f]+")
    seen = runs.flatten().dictionary_encode()
    found = [_TERMS[x] for x in seen.dictionary.to_numpy(zero_copy_only=False).tolist()]
    words = pa.array([w for x in found for w in x], pa.string()).dictionary_encode()
    numbers = words.indices.to_numpy()
    # A run has no token, one or several, which stand together in numbers.
    many = np.array([len(x) for x in found], "int64")
    codes = seen.indices.to_numpy()
    times, first = many[codes], (np.cumsum(many) - many)[codes]
    place = np.arange(times.sum()) + np.repeat(first - np.cumsum(times) + times, times)
    docs = np.repeat(np.repeat(np.arange(n), np.diff(runs.offsets.to_numpy())), times)
    pairs, tfs = np.unique(docs * len(words.dictionary) + numbers[place], return_counts=True)
    doc, word = np.divmod(pairs, max(1, len(words.dictionary)))
    ends = pa.array(np.searchsorted(doc, np.arange(n + 1)).astype("int32"))
    return np.bincount(docs, minlength=n), pa.ListArray.from_arrays(ends, words.dictionary.take(pa.array(word))), pa.ListArray.from_arrays(ends, pa.array(tfs.astype("int32")))


def expand_query(tokens: list[str], stem_keys: bool = False) -> list[str]:
    """Distinct tokens, each followed by the tokens of its synonyms; stem_keys also finds keys by their stems."""
    table = SYNONYMS | ({t: v for k, v in SYNONYMS.items() for t in tokenize_query(k)} if stem_keys else {})
    out: dict[str, None] = {}
    for t in tokens:
        if t not in out:
            out[t] = None
            out.update(dict.fromkeys(x for s in table.get(t, []) for x in tokenize_query(s)))
    return list(out)


def detect_language(path: Column) -> Column:
    """By extension, any case; then by the names of container and make files."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    known = F.try_element_at(table, F.regexp_extract(base, r"(\.[^.]*)$", 1))
    return F.coalesce(known, F.when(base.startswith("dockerfile"), "dockerfile").when(base.startswith("makefile") | (base == "gnumakefile"), "makefile").otherwise("unknown"))


# Headings

SPACE = r"[ \t\n\x0b\f\r\x{85}\x{a0}]"


def trimmed(c: Column, space: str = SPACE) -> Column:
    return F.regexp_replace(c, rf"^{space}+|{space}+\z", "")


CHAPTER = r"(?i)^(chapter|capítulo|lección|lesson|unit|unidad|parte)\s+\d+"
CAPITALS = r"^[A-ZÁÉÍÓÚÜÑ\s]{4,}$"
BOLD = r"^(\*{1,3}|_{1,3})(.+)(\*{1,3}|_{1,3})\s*$"
HEADING = r"^(#{1,6})\s+(.+)$"
RULE = r"^(---|\*\*\*|___)\s*$"


def section_header(line: Column) -> Column:
    """The title that a line gives to what follows, or null: heading marks, chapter words, capitals, bold."""
    t = trimmed(line)
    inner = trimmed(F.regexp_extract(t, BOLD, 2))
    return (
        F.when(t == "", F.lit(None).cast("string"))
        .when(line.rlike(HEADING), F.regexp_extract(line, HEADING, 2))
        .when(t.rlike(CHAPTER), t)
        .when((F.octet_length(t) > 10) & t.rlike(CAPITALS), t)
        .when(t.rlike(BOLD) & (F.octet_length(inner) > 3), inner)
    )


def markdown_block(line: Column) -> Column:
    """The kind of block that a line of markdown is, by its look alone."""
    t = trimmed(line)
    return (
        F.when(t.startswith("```"), "fence")
        .when(line.rlike(r"^#{1,6}\s+\S"), F.concat(F.lit("h"), F.length(F.regexp_extract(line, "^(#+)", 1)).cast("string")))
        .when(t.rlike(r"^(-{3,}|\*{3,}|_{3,})$"), "rule")
        .when(t.startswith(">"), "quote")
        .when(t.rlike(r"^[-*+]\s+\[[ xX]\]\s"), "task")
        .when(t.rlike(r"^[-*+]\s+"), "list")
        .when(t.rlike(r"^\d+[.)]\s+"), "ordered")
        .when(F.length(F.regexp_replace(t, r"[^|]", "")) >= 2, "table")
        .when(t == "", "blank")
        .otherwise("plain")
    )


def table_cells(line: Column) -> Column:
    """Cells of a table row without the outer pipes, trimmed."""
    return F.transform(F.split(F.regexp_replace(trimmed(line), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))


def is_table_separator(line: Column) -> Column:
    """Whether all cells that aren't empty are three dashes or more, with or without colons."""
    return F.forall(table_cells(line), lambda c: (c == "") | c.rlike("^:?-{3,}:?$"))


def table_rows(lines: Column) -> Column:
    """(separator, cells) of a table's lines, all with as many cells as the longest."""
    rows = F.transform(lines, lambda x: F.struct(is_table_separator(x).alias("separator"), table_cells(x).alias("cells")))

    def padded(rs: Column) -> Column:
        most = F.array_max(F.transform(rs, lambda r: F.size(r["cells"])))
        return F.transform(rs, lambda r: F.struct(r["separator"].alias("separator"), F.concat(r["cells"], F.array_repeat(F.lit(""), most - F.size(r["cells"]))).alias("cells")))

    return bind(rows, padded)


# Pages

#: What HTML calls characters, from the standard library's table: names with their semicolon, and the old ones that do without.
NAMED = {k.removesuffix(";"): v for k, v in html.entities.html5.items() if k.endswith(";")}
BARE = {k: v for k, v in html.entities.html5.items() if not k.endswith(";")}
#: Numbers that stand for another character: those of Windows' code page, and zero.
REMAPPED = {i: bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0)} | {0: "\ufffd", 13: "\r"}
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?"


def _table(values: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(values)), "map<string,string>")


def _decoded(ref: Column) -> Column:
    """The character of one reference, or the reference itself."""
    body = F.regexp_replace(ref, "^&|;$", "")
    number = F.when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10).cast("int")).when(body.startswith("#"), F.substring(body, 2, 8).cast("int"))
    char = F.decode(F.unhex(F.lpad(F.hex(number.cast("long")), 8, "0")), "UTF-32")
    gone = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    remapped = F.try_element_at(_table({str(k): v for k, v in REMAPPED.items()}), number.cast("string"))
    numbered = F.coalesce(remapped, F.when((number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd").when(gone, "").otherwise(char))
    # The longest name at the beginning that needs no semicolon; the rest stays.
    lengths = sorted({len(k) for k in BARE}, reverse=True)
    begun = [F.concat(F.try_element_at(_table(BARE), F.substring(ref, 2, n)), F.substring(ref, n + 2, 64)) for n in lengths]
    named = F.when(ref.endswith(";"), F.try_element_at(_table(NAMED), body))
    return F.when(body.isin("amp", "lt", "gt", "quot", "nbsp") & ref.endswith(";"), F.translate(F.left(body, F.lit(1)), "algqn", '&<>"\u00a0')).when(number.isNotNull(), numbered).otherwise(F.coalesce(named, *begun, ref))


def unescape(c: Column, only: list[tuple[str, str]] | None = None) -> Column:
    """Decodes named and numbered character references as HTML does.

    With only, nothing but these is decoded, one after the other.
    """
    if only is not None:
        for ref, char in only:
            c = F.replace(c, F.lit(ref), F.lit(char))
        return c
    gaps, refs = F.split(c, REFERENCE, -1), F.regexp_extract_all(c, F.lit(REFERENCE), F.lit(0))
    decoded = F.array_join(F.zip_with(gaps, F.transform(refs, _decoded), lambda g, d: F.concat(g, F.coalesce(d, F.lit("")))), "")
    return F.when(c.contains("&"), decoded).otherwise(c)


def html_to_text(html: Column, min_line: int = 0, only: list[tuple[str, str]] | None = None, space: str = SPACE) -> Column:
    """Lines of text without scripts, styles, navigation, footers, headers and tags.

    With min_line only longer lines stay, or all if none is longer; only is that of unescape(), and lines lose `space` at both ends.
    """
    c = html
    # Without regard to case, as Unicode has it: the long s is one, too.
    for tag in ("[s\u017f]cript", "[s\u017f]tyle", "nav", "footer", "header"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    c = F.regexp_replace(unescape(F.regexp_replace(c, "<[^>]+>", "\n"), only), r"[ \t]+", " ")
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: trimmed(x, space)), lambda x: x != "")

    def longer(lines: Column) -> Column:
        long = F.filter(lines, lambda x: F.length(x) > min_line)
        return F.when(F.size(long) > 0, long).otherwise(lines)

    return F.array_join(bind(lines, longer) if min_line else lines, "\n")


def truncate(c: Column, limit: int = 32_000) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("\n... (truncated, "), F.length(c).cast("string"), F.lit(" total chars)"))).otherwise(c)


def page_text(html: Column, max_chars: int = 4000, only: list[tuple[str, str]] | None = None, space: str = SPACE) -> Column:
    """The text of a page's longer lines, cut, or null if there is hardly any; only and space are those of html_to_text()."""

    def cut(text: Column) -> Column:
        return F.when(F.length(text) > 100, F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("\n... (truncated)"))).otherwise(text))

    return bind(html_to_text(html, 40, only, space), cut)


def unwrap_redirect(url: Column) -> Column:
    """The target that a search page's link wraps; a link without a scheme gets https."""
    url = F.trim(url)
    url = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    target = F.regexp_extract(url, r"[?&]uddg=([^&]+)", 1)
    return F.when(target != "", F.url_decode(F.replace(target, F.lit("+"), F.lit("%2B")))).otherwise(url)


def result_links(html: Column, most: int = 10, kind: str | None = None) -> Column:
    """(url, title) of the first `most` results of a search page, less adverts, help and empty titles among them.

    With kind, only anchors of that class are results; the class stands after the address.
    """
    of_kind = rf"""[^>]+class=['"]?{kind}['"][^>]*""" if kind else "[^>]*"
    anchor = rf"""(?s)<a[^>]+href=['"]([^'"]+)['"]{of_kind}>(.*?)</a>"""
    urls, titles = F.regexp_extract_all(html, F.lit(anchor), F.lit(1)), F.regexp_extract_all(html, F.lit(anchor), F.lit(2))
    pairs = F.zip_with(F.slice(urls, 1, most), F.slice(titles, 1, most), lambda u, t: F.struct(unwrap_redirect(unescape(u)).alias("url"), F.trim(F.regexp_replace(t, "<[^>]+>", "")).alias("title")))
    return F.filter(pairs, lambda p: (p["title"] != "") & (F.lower(p["title"]) != "more info") & ~p["url"].rlike("ad_provider|ad_domain|help-pages"))


def with_pages(results: DataFrame, pages: DataFrame, by: str, order: str, first: int = 2, max_chars: int = 3000) -> DataFrame:
    """Adds page: the text of the pages that the first results of each search name, where it is known.

    pages with the column `by` are those that each search has fetched, so two
    searches may know an address with different texts; without it they are known
    to all. They hold html, or a page whose text is made already. Of an address
    that stands more than once the page with the smallest text is taken: a result
    stays one row.
    """
    own = [by] if by in pages.columns else []
    text = F.col("page") if "page" in pages.columns else page_text(F.col("html"), max_chars)
    known = pages.select(*[F.col(c).alias("_by") for c in own], F.col("url").alias("_u"), text.alias("page"))
    known = known.groupBy(*["_by" for _ in own], "_u").agg(F.min("page").alias("page"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(order))
    rows = results.withColumn("_at", F.when(rank <= first, F.col("url")))
    same = rows["_at"] == known["_u"]
    return rows.join(known, same & (rows[by] == known["_by"]) if own else same, "left").drop("_at", "_u", "_by")


# Small formats


def collapse(c: Column, limit: int = 200) -> Column:
    one = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("…"))).otherwise(one)


def strip_ansi(c: Column) -> Column:
    for pattern in (r"\x1b\[[0-9;]*m", r"\x1b\].*?\x1b\\", r"\x1b\[[0-9;]*[A-Za-z]", r"\x1b"):
        c = F.regexp_replace(c, pattern, "")
    return c


def format_context(n: Column, millions: bool = True) -> Column:
    """1234 as 1K, millions as 1M, or, without millions, as 1000K."""
    thousands = F.when(n >= 1000, F.concat(F.floor(n / 1000).cast("string"), F.lit("K"))).otherwise(n.cast("string"))
    return F.when(n >= 1_000_000, F.concat(F.floor(n / 1_000_000).cast("string"), F.lit("M"))).otherwise(thousands) if millions else thousands


def format_price(prompt: Column, completion: Column) -> Column:
    """What a million tokens each way cost, as $1.23; nothing for free or unpriced ones."""
    total = (F.coalesce(prompt.try_cast("double"), F.lit(0.0)) + F.coalesce(completion.try_cast("double"), F.lit(0.0))) / 0.000001
    return F.when(total > 0, F.concat(F.lit("$"), F.format_string("%.2f", total)))


def format_cost(x: Column) -> Column:
    """Six places under a thousandth, else four; trailing zeros and point stripped."""
    shown = F.when(x < 0.001, F.format_string("%.6f", x)).otherwise(F.format_string("%.4f", x))
    return F.regexp_replace(shown, r"\.?0+$", "")


def classify_error(status: Column, message: Column) -> Column:
    # What providers say of a prompt that is too long.
    phrases = ("context_length_exceeded", "context window", "prompt is too long", "maximum context length", "reduce the length of", "too many tokens")
    over = F.lower(message).rlike("|".join(phrases))
    return F.when(status.isin(429, 529), "rate_limit").when((status == 400) & over, "context_overflow").otherwise(F.concat(F.lit("http_"), status.cast("string")))


def verdict(c: Column) -> Column:
    t = F.ltrim(c)
    return F.when(t.startswith("✅"), "pass").when(t.startswith("❌"), "fail").otherwise("none")


def qualified_name(c: Column) -> Column:
    """mcp__server__tool as (server, tool), or null."""
    parts = F.split(c, "__", 3)
    return F.when((F.size(parts) == 3) & (F.get(parts, 0) == "mcp"), F.struct(F.get(parts, 1).alias("server"), F.get(parts, 2).alias("tool")))


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    for key, value in values.items():
        c = F.replace(c, F.lit("{" + key + "}"), value)
    return c


def front_matter(c: Column) -> Column:
    """(fields, body): the k: v lines between the leading --- marks and the trimmed rest.

    Of a key that repeats the last value holds; quotes around a value go, yes and
    no become true and false, comments are passed over.
    """
    mark = r"(?s)\A---\s*\n(.*?)\n(?:---|\.\.\.)\s*(?:\n|\z)"
    head, body = F.regexp_extract(c, mark, 1), F.regexp_replace(c, mark, "")
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":") & ~F.ltrim(x).startswith("#"))

    def value(x: Column) -> Column:
        plain = F.regexp_replace(F.trim(F.regexp_replace(x, "^[^:]*:", "")), "^[\"']+|[\"']+$", "")
        return F.when(F.lower(plain).isin("true", "yes"), "true").when(F.lower(plain).isin("false", "no"), "false").otherwise(plain)

    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), value(x).alias("v")))
    last = bind(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["k"] == p["k"])))
    return F.struct(F.map_from_entries(last).alias("fields"), trimmed(body).alias("body"))


def markdown_functions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(folder, name, description, doc): functions that markdown files with front matter define, one a folder that isn't private.

    The name is that of the fields, else the folder's; the description that of
    the fields, else the first 80 characters of the body. A file without fields
    or body defines nothing.
    """
    folder = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    rows = files.where(~folder.startswith("_") & (folder != "")).select(folder.alias("folder"), front_matter(F.col(text)).alias("_f"))
    field = lambda k: F.nullif(F.try_element_at(F.col("_f.fields"), F.lit(k)), F.lit(""))
    rows = rows.where((F.size("_f.fields") > 0) & (F.col("_f.body") != ""))
    return rows.select("folder", F.coalesce(field("name"), F.col("folder")).alias("name"), F.coalesce(field("description"), F.substring("_f.body", 1, 80)).alias("description"), F.col("_f.body").alias("doc"))


def filter_markers(c: Column) -> Column:
    """The words that follow @@ in a prompt."""
    return F.regexp_extract_all(c, F.lit(r"@@(\S+)"), F.lit(1))


def cd_target(c: Column) -> Column:
    """Where a shell command first changes to, or null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(F.regexp_extract(c, r"^\s*cd\s+(.+?)(?:\s*[;&|#]|$)", 1)), "^['\"]+|['\"]+$", "")), F.lit(""))


def output_files(c: Column) -> Column:
    """Files that a shell command names after -o, > or >>."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?:-(?:o|O|output)\s+|>\s*|>>\s*)(\S+)"), F.lit(1)), lambda f: F.regexp_replace(f, "^['\"]+|['\"]+$", ""))


#: What marks a line that states a fact, and the phrases it follows.
FACT_MARKS, FACT_LEADS = ("remember", "aprende", "nota:", "importante", "lección"), ("remember that", "aprende que", "la lección es", "nota que")


def stated_facts(c: Column, most: int = 3) -> Column:
    """What lines say after the first phrase of FACT_LEADS that they hold; at most most, each under 200 characters."""

    def fact(line: Column) -> Column:
        low, out = F.lower(line), F.lit(None).cast("string")
        for lead in reversed(FACT_LEADS):
            out = F.when(low.contains(lead), F.trim(F.substring(line, F.instr(low, lead) + len(lead), F.length(line)))).otherwise(out)
        return F.when(low.rlike("|".join(FACT_MARKS)), out)

    return F.slice(F.filter(F.transform(F.split(c, "\n"), fact), lambda x: x.isNotNull() & (x != "") & (F.length(x) < 200)), 1, most)


def raw_url(c: Column) -> Column:
    """A repository page's file link as the link to its bytes."""
    return F.regexp_replace(c, r"^https://github\.com/([^/]+)/([^/]+)/(?:blob|tree)/(.+)$", "https://raw.githubusercontent.com/$1/$2/$3")


def install_source(url: Column) -> Column:
    """(kind, url) of where a function file comes from: `git`, a repository to be cloned, or `raw`, the file itself."""
    url = F.trim(url)
    url = F.when(url.startswith("gh:"), F.concat(F.lit("https://github.com/"), F.substring(url, 4, 10_000), F.lit(".git"))).otherwise(url)
    tree = r"^https://github\.com/([^/]+)/([^/]+)/tree/([^/]+)/(.+)"
    file = url.contains("SKILL.md")
    git = url.endswith(".git") | (~file & url.contains("github.com")) | url.startswith("git@")
    raw = F.regexp_replace(url, tree + "$", "https://raw.githubusercontent.com/$1/$2/$3/$4/SKILL.md")
    kind = F.when(url.rlike(tree), "raw").when(git, "git").otherwise("raw")
    target = F.when(url.rlike(tree), raw).when(git | file, url).otherwise(F.concat(F.regexp_replace(url, "/+$", ""), F.lit("/SKILL.md")))
    return F.struct(kind.alias("kind"), target.alias("url"))


def data_uri(path: Column, content: Column) -> Column:
    """A picture of up to 20 MB as a data URI, by its extension; else null."""
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp"}
    kind = F.try_element_at(F.create_map(*[F.lit(x) for p in kinds.items() for x in p]), F.lower(F.substring_index(path, ".", -1)))
    return F.when(kind.isNotNull() & (F.octet_length(content) <= 20 * 1024 * 1024), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", "")))
