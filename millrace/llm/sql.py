"""SQL of the operators that SQL can express, for a second engine over the same tables."""

from __future__ import annotations

from millrace.llm import quality_rules as q

_SPACED = r"[\x20\x09-\x0D]+"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _item_words(table: str, key: str) -> str:
    return f"SELECT {key}, list_filter(regexp_split_to_array({_LOWERED}, '{_NOT_WORD}'), lambda x: x <> '') AS w FROM {table}"


OP5 = f"""
WITH d AS ({_item_words("documents", "doc_id")}), b AS ({_item_words("benchmark", "item_id")}),
g AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, size, w[k:k + size - 1] AS gram
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT doc_id, size, k, w[k:k + size - 1] AS gram
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size)
),
hit AS (SELECT doc_id, k, dw.size, item_id FROM dw JOIN g ON dw.size = g.size AND dw.gram = g.gram),
places AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""

_RULES = {
    "short": f"n_words < {q.LEAST_WORDS}",
    "repeats": f"100 * n_repeat_words > {q.MOST_REPEATED} * n_words",
    "symbols": f"100 * n_symbols > {q.MOST_SYMBOLS} * n_words",
    "dup_lines": f"100 * n_dup_lines > {q.MOST_DUP_LINES} * n_lines",
}


def _prior(rule: str) -> str:
    """Mean and strength of the hosts' beta prior for a rule."""
    return f"""greatest(least(sum(k_{rule}) / sum(n), 1 - 1e-6), 1e-6) AS m_{rule},
    coalesce(var_samp(k_{rule} / n), 0) - greatest(least(sum(k_{rule}) / sum(n), 1 - 1e-6), 1e-6) * (1 - greatest(least(sum(k_{rule}) / sum(n), 1 - 1e-6), 1e-6)) * avg(1 / n) AS b_{rule}"""


def _failed(rule: str) -> str:
    strength = f"(CASE WHEN b_{rule} > 0 THEN least(greatest(m_{rule} * (1 - m_{rule}) / b_{rule} - 1, 1), 1e4) ELSE 1e4 END)"
    rate = f"((k_{rule} + m_{rule} * {strength}) / (n + {strength}))"
    return f"{rate} - {q.MARGIN} * sqrt({rate} * (1 - {rate}) / (n + {strength} + 1)) > {q.HOST_LIMITS[rule]}"


OP1 = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACED}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
),
grams AS (SELECT doc_id, k, w[k:k + {q.WINDOW - 1}] AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - {q.WINDOW - 2})) AS k FROM d WHERE len(w) >= {q.WINDOW})),
again AS (SELECT doc_id, k FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + {q.WINDOW})) AS p FROM again) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id
),
f AS (SELECT *, {", ".join(f"{rule} AS f_{name}" for name, rule in _RULES.items())} FROM m),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER (f_{r}) AS DOUBLE) AS k_{r}" for r in _RULES)} FROM f GROUP BY source
),
prior AS (SELECT {", ".join(_prior(r) for r in _RULES)} FROM hosts),
verdicts AS (SELECT source, {" OR ".join(_failed(r) for r in _RULES)} AS host_failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_short OR f_repeats AS base_failed,
  NOT ({" OR ".join(f"f_{r}" for r in _RULES)} OR host_failed) AS kept, host_failed
FROM f JOIN verdicts ON f.source IS NOT DISTINCT FROM verdicts.source"""

def _shingles(words: str) -> str:
    """The 5-word shingles of a list of words, or its whole sequence if it has fewer, as texts."""
    windows = f"list_transform(range(1, len({words}) - 3), lambda k: array_to_string({words}[k:k + 4], ' '))"
    return f"CASE WHEN len({words}) < 5 THEN [array_to_string({words}, ' ')] ELSE list_distinct({windows}) END"


OP2 = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, k - 1 AS pos, parts[k] AS line FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM d)),
w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(lower(line), '{_SPACED}'), lambda x: x <> '') AS words FROM l),
placed AS (SELECT doc_id, pos, array_to_string(words, ' ') AS key, words, row_number() OVER (ORDER BY doc_id, pos) AS place FROM w WHERE len(words) > 0),
firsts AS (SELECT place, words FROM placed QUALIFY row_number() OVER (PARTITION BY key ORDER BY place) = 1),
g AS (SELECT place, len(grams) AS n, unnest(grams) AS gram FROM (SELECT place, {_shingles("words")} AS grams FROM firsts)),
pairs AS (
  SELECT a.place, a.n, b.n AS e_n, count(*) AS common FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.place > b.place
  GROUP BY a.place, b.place, a.n, b.n
),
gone AS (
  SELECT doc_id, pos FROM placed WHERE place NOT IN (SELECT place FROM firsts)
    OR place IN (SELECT place FROM pairs WHERE 100 * common >= 80 * (n + e_n - common))
),
removed AS (SELECT doc_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos WHERE gone.pos IS NULL GROUP BY l.doc_id
)
SELECT t.doc_id, coalesce(removed.n, 0) AS n_removed,
  CASE WHEN t.text IS NOT NULL THEN length(coalesce(kept.text, '')) END AS kept_chars,
  CASE WHEN t.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256,
  coalesce(removed.places, '') AS removed_lines
FROM documents AS t LEFT JOIN removed ON t.doc_id = removed.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id"""

OP9 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWERED}, '{_SPACED}'), lambda x: x <> '') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE {_shingles("words")} END AS grams FROM w),
g AS (SELECT doc_id, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
),
reached(node, source) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT links.b, source FROM reached JOIN links ON reached.node = links.a WHERE source < links.b
),
least AS (SELECT node, min(source) AS component_id FROM reached GROUP BY node)
SELECT sets.doc_id, CAST(len(grams) AS BIGINT) AS n_shingles, component_id FROM sets JOIN least ON sets.doc_id = least.node"""

ORACLE_SQL = {
    "op1_quality_rules": OP1,
    "op2_line_dedup": OP2,
    "op5_decontamination": OP5,
    "op9_ngram_jaccard": OP9,
}
