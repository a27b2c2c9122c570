"""SQL of the tokenizer, for the DuckDB side."""

from __future__ import annotations

# Fixed values, written again here so that a wrong table shows: letters that lose their accents, words that are no tokens, suffixes.
ACCENTED, PLAIN = "áéíóúÁÉÍÓÚüÜñÑ", "aeiouAEIOUuUnN"
STOPS = """(
'el', 'la', 'los', 'las', 'lo', 'les', 'le', 'un', 'una', 'unos', 'unas', 'de', 'del', 'a', 'en', 'por', 'para', 'con', 'sin', 'al', 'ante', 'bajo',
'contra', 'desde', 'durante', 'hacia', 'hasta', 'mediante', 'segun', 'sobre', 'tras', 'via', 'y', 'e', 'o', 'u', 'pero', 'porque', 'que', 'pues',
'si', 'aunque', 'como', 'cuando', 'donde', 'mientras', 'salvo', 'excepto', 'yo', 'tu', 'tú', 'ella', 'ello', 'nos', 'nosotros', 'vos', 'vosotros',
'ustedes', 'me', 'te', 'se', 'os', 'mi', 'mis', 'tus', 'su', 'sus', 'este', 'esta', 'esto', 'ese', 'esa', 'eso', 'aquel', 'aquella', 'aquello',
'quien', 'cual', 'cuyo', 'es', 'son', 'fue', 'fueron', 'era', 'eran', 'soy', 'eres', 'somos', 'estan', 'estaba', 'hay', 'ha', 'han', 'he', 'hemos',
'haber', 'ser', 'estar', 'sido', 'siendo', 'muy', 'mas', 'menos', 'todo', 'toda', 'todos', 'todas', 'nada', 'algo', 'cada', 'otro', 'otra', 'otros',
'otras', 'mismo', 'misma', 'entre', 'asi', 'tambien', 'tampoco', 'aqui', 'alli', 'alla', 'ya', 'aun', 'todavia', 'solo', 'sola', 'no', 'puede',
'debe', 'podria', 'the', 'and', 'for', 'are', 'you', 'our', 'out', 'not', 'but', 'with', 'this', 'that'
)"""
SUFFIXES = "erais|asteis|isteis|abais|ando|endo|anza|anzas|ario|arios|aria|arias|ador|adora|adores|adoras|ante|antes|ente|entes|miento|mientos|menta|mento|idad|idades|ible|ibles|ismo|ismos|ista|istas|ivo|iva|ivos|ivas|aje|ajes|eza|ezas|aba|ada|ido|ar|er|ir|as|es|an|en|in|os|a|o|e|s"
#: What stays of a word: one letter of two bytes or more, else two letters, then as few more as a suffix needs.
STEM = rf"^(?:([^\x00-\x7F])|(..+?))(?:{SUFFIXES})$"
#: Where an identifier is cut, one pattern after the other.
CUTS = (r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})", r"(\p{Lu})(\p{Lu}\p{Ll})")


def parts(text: str) -> str:
    """The array of raw parts of a text."""
    e = f"regexp_replace(translate({text}, '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')"
    for c in CUTS:
        e = f"regexp_replace({e}, '{c}', '\\1 \\2', 'g')"
    return f"string_split({e}, ' ')"


def tokens(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in token(key, pos, term)."""
    return f"""
raw AS (SELECT {key}, generate_subscripts(p, 1) AS pos, lower(unnest(p)) AS w FROM (SELECT {key}, {parts(text)} AS p FROM {table})),
token AS (SELECT {key}, pos, term FROM (SELECT {key}, pos, CASE WHEN strlen(w) > 3 THEN regexp_replace(w, '{STEM}', '\\1\\2') ELSE w END AS term
  FROM raw WHERE strlen(w) >= 2 AND w NOT IN {STOPS}) WHERE term <> '' AND term NOT IN {STOPS})"""


def bm25(terms: list[str], table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """CTEs that end in scored(key, score)."""
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""{tokens(table, key, text)},
posting AS (SELECT term, {key}, count(*) AS tf FROM token GROUP BY ALL),
size AS (SELECT d.{key}, coalesce(s.n, 0) AS num FROM {table} d LEFT JOIN (SELECT {key}, sum(tf) AS n FROM posting GROUP BY {key}) s USING ({key})),
stat AS (SELECT count(*) AS n, avg(num) AS avgdl FROM size),
dfs AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
scored AS (SELECT {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * num / avgdl))) AS score
  FROM posting JOIN dfs USING (term) JOIN size USING ({key}), stat WHERE term IN ({names}) GROUP BY {key})"""


# Fixed values, written again as well: file extensions and their languages.
EXTENSIONS = [pair.split(":") for pair in """
go:go py:python js:javascript ts:typescript jsx:jsx tsx:tsx rs:rust java:java rb:ruby php:php c:c h:c cpp:cpp hpp:cpp cs:csharp swift:swift kt:kotlin scala:scala
r:r lua:lua sh:bash bash:bash zsh:bash fish:bash ps1:powershell pl:perl pm:perl tex:latex md:markdown rst:rst txt:text json:json yaml:yaml yml:yaml xml:xml
html:html htm:html css:css scss:scss sass:sass less:less sql:sql toml:toml ini:ini cfg:ini env:env dockerfile:dockerfile
""".split()]
