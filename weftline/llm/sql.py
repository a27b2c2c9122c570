"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES

_WORDS = r"list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _words(text: str) -> str:
    return _WORDS.format(text=text)


def _values(rows: list[tuple]) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_PHRASES = _values(list(PHRASES.items()))
_TEMPLATES = _values([(label, text) for label, text in TEMPLATES])

OP2 = f"""
WITH d AS (SELECT doc_id, text, {_words("text")} AS w FROM documents),
phrase(p, label) AS ({_PHRASES}),
places AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(list_intersect(w, ['gnu', 'apache', 'cc', 'mit'])) > 0) x, phrase
  WHERE w[i] = string_split(p, ' ')[1] AND w[i:i + len(string_split(p, ' ')) - 1] = string_split(p, ' ')),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS a, max(i) - 1 AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY doc_id),
template(label, text) AS ({_TEMPLATES}),
sets AS (SELECT label, list_distinct(string_split(text, ' ')) AS s FROM template),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
hit AS (SELECT doc_id, label, len(list_intersect(s, {_words("l")})) / len(s)::DOUBLE AS c FROM line, sets WHERE l ILIKE '%e%'),
best AS (SELECT doc_id, label, max(c) AS c FROM hit WHERE c >= 0.8 - 1e-9 GROUP BY doc_id, label),
found AS (SELECT doc_id, label, c FROM best UNION ALL SELECT DISTINCT doc_id, label, 1.0 FROM places),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(base.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)
"""

OP6 = """
WITH line AS (
  SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (SELECT doc_id, pos, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
hot AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(hot.k)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY pos) FILTER (WHERE hot.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""

OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(x) AS h FROM (SELECT doc_id, s, unnest(s) AS x FROM s)),
often AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
          WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM often WHERE 100 * c >= 80 * (an + bn - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
least_of AS (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN least_of USING (doc_id)
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
i AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[k:k + 9] AS g, len(w[k:k + 9]) AS n FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
seen AS (SELECT doc_id, k, w[k:k + n - 1] AS g, n FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, k, seen.n, item_id FROM seen JOIN win ON seen.g = win.g),
word AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(word.c, 0)::BIGINT AS n_hit, coalesce(items.c, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(word.c, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP11 = r"""
WITH piece AS (SELECT doc_id, lang, generate_subscripts(ps, 1) AS p, unnest(ps) AS t FROM (
  SELECT doc_id, coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
w AS (SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM piece),
place AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM place GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM cand),
lr AS (SELECT cut.lang, cut.phrase, cut.a, c, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a // (x.a::HUGEINT + y.a))::BIGINT AS score FROM cut
  JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(w[1:c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(w[c + 1:cut.k], ' ')),
low AS (SELECT lang, phrase, a, unnest(min({'score': score, 'c': c, 'l': l, 'r': r})) FROM lr GROUP BY lang, phrase, a),
inside AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda s: list_transform(range(1, k - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))))) AS phrase FROM cand WHERE k > 2),
around AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY ALL),
kept AS (SELECT low.* FROM low LEFT JOIN around USING (lang, phrase) WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

OP13 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, hash(x) AS h FROM (SELECT doc_id, s, unnest(s) AS x FROM s)),
often AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id
          WHERE 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL),
link AS (SELECT a, b FROM often WHERE 100 * c >= 90 * (an + bn - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a),
least_of AS (SELECT d AS doc_id, min(r) AS component_id FROM reach GROUP BY d)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN least_of USING (doc_id)
"""

ORACLES = {"op2_license_scan": OP2, "op6_line_dedup": OP6, "op8_near_dedup": OP8, "op10_decontamination": OP10, "op11_collocations": OP11, "op13_jaccard_join": OP13}
