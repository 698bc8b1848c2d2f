"""DuckDB SQL for the numbered operators that SQL can express."""

from __future__ import annotations

from . import fim, licenses


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def licences() -> str:
    """op4: places of whole key phrases by counting words, then each template's words within the drift of theirs."""
    rows = []
    for t, (label, text, key) in enumerate(licenses.TEMPLATES):
        words, need = text.split(), key.split()
        at = licenses.key_place(words, need)
        rows += [f"({t}, {_quoted(label)}, {len(words)}, {len(need)}, {p}, {_quoted(w)}, {at <= p < at + len(need)})" for p, w in enumerate(words)]
    bases = []
    for phrase, label in licenses.BASE.items():
        words = phrase.split()
        bases += [f"({_quoted(label)}, {len(words)}, {p}, {_quoted(w)})" for p, w in enumerate(words)]
    return rf"""
WITH texts AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM texts),
template(t, label, n, key_n, p, word, is_key) AS (VALUES {", ".join(rows)}),
phrase(label, n, p, word) AS (VALUES {", ".join(bases)}),
keyed AS (SELECT doc_id, t, pos - p AS start FROM words JOIN template USING (word) WHERE is_key GROUP BY doc_id, t, pos - p HAVING count(*) = any_value(key_n)),
met AS (
  SELECT k.doc_id, label, count(DISTINCT p) / any_value(n) AS cover
  FROM keyed k JOIN template USING (t) JOIN words w ON w.doc_id = k.doc_id AND w.word = template.word AND w.pos BETWEEN k.start + p - {licenses.DRIFT} AND k.start + p + {licenses.DRIFT}
  GROUP BY k.doc_id, label, t, k.start HAVING count(DISTINCT p) / any_value(n) >= {licenses.COVER}),
base AS (SELECT doc_id, label, pos - p AS start FROM words JOIN phrase USING (word) GROUP BY doc_id, label, pos - p HAVING count(*) = any_value(n)),
based AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM met) GROUP BY doc_id),
covers AS (SELECT doc_id, max(cover) AS cover FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(greatest(coalesce(cover, 0.0), CASE WHEN n_base > 0 THEN {licenses.COVER} ELSE 0.0 END) AS DOUBLE) AS score
FROM texts LEFT JOIN based USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN covers USING (doc_id)"""


#: op9: every pair that shares a shingle is counted, and links are followed to the smallest id.
NEAR_DUPLICATES = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(list_zip(ws[:-5], ws[2:-4], ws[3:-3], ws[4:-2], ws[5:]), lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5]))) END AS own
  FROM texts),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, any_value(len(own)) AS n, list_sort(own) AS own FROM sets WHERE len(own) > 0 GROUP BY list_sort(own)),
items AS MATERIALIZED (SELECT rep, n, hash(unnest(own)) AS item FROM classes),
links AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM items a JOIN items b ON a.item = b.item AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT a, b FROM both_ways UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
labels AS (SELECT node, min(least(node, other)) AS component FROM reach GROUP BY node),
named AS (SELECT own, coalesce(component, rep) AS c FROM classes LEFT JOIN labels ON rep = node)
SELECT s.doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, coalesce(c, s.doc_id) AS component_id, s.doc_id = coalesce(c, s.doc_id) AS kept
FROM sets s LEFT JOIN named ON list_sort(s.own) = named.own"""


def oracle_sql() -> dict[str, str]:
    return {"op4_rare_token_licenses": licences(), "op9_superminhash": NEAR_DUPLICATES, "op12_fill_in_middle": fim.SQL}
