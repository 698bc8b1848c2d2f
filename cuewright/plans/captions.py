"""Queries over captions and cards, and the same in SQL for DuckDB.

Stand-ins: the sentences that orders speak (see speech); a card is the middle of its sentence's neighbour by
key; a caption is a sentence between openings and ends with tags, handles, links and furniture.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions as C
from . import speech
from .speech import _ASCII, SAID, _in, _pick, _q

HEADS = ["", "#fun @me.x\n", "#a #b #c ", "@team ", "See https://x.io/a?b now. ", "**Bold** and `code` [link](http://y.z) — ", "> quoted\n- item\n1. point\n", "Don't ", "‘Nothing’ is ", "It is what it is: "]
TAILS = ["", " #one #two #three #four", " www.site.com/x and https://b.c/d", "\n\n#end", " They will not go, and she is going to stay.", " You're it's y'all"]


def _captioned(spark: bool) -> str:
    div = "DIV" if spark else "//"
    head, tail = (_pick(v, f"o_orderkey {div} {k} % {len(v)}", spark) for v, k in ((HEADS, 2), (TAILS, 5)))
    out = f"concat({head}, text, {tail})"
    return out


CAPS = f"caps AS (SELECT sid, card, {_captioned(False).replace('o_orderkey', 'sid')} AS text FROM (SELECT sid, text, {_pick(speech.MIDDLES, f'(sid + 5) // 3 % {len(speech.MIDDLES)}', False)} AS card FROM said))".replace("\n", "\\n")
#: DuckDB has no escapes in plain strings.
CAPS = CAPS.replace("\\n", "' || chr(10) || '")


def caps(s, d):
    rows = speech.said(s, d).withColumn("card", F.expr(_pick(speech.MIDDLES, f"(sid + 5) DIV 3 % {len(speech.MIDDLES)}", True)))
    return rows.select("sid", "card", F.expr(_captioned(True).replace("o_orderkey", "sid").replace("\n", "\\n")).alias("text"))


FLAT = lambda x: rf"""lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[‘’‛]', '''', 'g'), '[“”‟]', '"', 'g'), '—|–|‒|--', ' -- ', 'g'), '\s+', ' ', 'g')))"""
TOKS = lambda x: f"regexp_extract_all({FLAT(x)}, '[a-z0-9$'']+')"
_count = lambda x, p: rf"len(regexp_extract_all({_ASCII(f'lower({x})')}, '\b(?:{_q(p)})\b'))"
_joined = lambda c: F.array_join(c, "|")
TERMS = rf"""list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''’\-]*'), lambda t: trim(t, '''’-')), lambda t: (length(t) >= 4 OR regexp_matches(t, '[0-9]')) AND t NOT IN ({_in(C.STOP)}))"""
BITS = lambda x: rf"list_filter(list_transform(list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9''’\-]*'), lambda t: trim(t, '''’-') NOT IN ({_in(C.STOP)})), lambda t: trim(regexp_replace(t, '[''’]', '', 'g'), '-')), lambda t: t <> '')"
PLAIN = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '(?s)```.*?```', ' ', 'g'),
    '`([^`]*)`', '\1', 'g'), '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s{{0,3}}#{{1,6}}\s*', '', 'g'), '(?m)^\s{{0,3}}>\s?', '', 'g'), '(?m)^\s{{0,3}}[-*+]\s+', '', 'g'),
    '(?m)^\s{{0,3}}\d+[.)]\s+', '', 'g'), '[*_]{{1,3}}([^*_]+)[*_]{{1,3}}', '\1', 'g')"""  # noqa: E731
TAG, LINK = r"#\w+", r"https?://\S+|www\.\S+"


def _voice(s, d):
    one = caps(s, d).select("sid", F.col("text"))
    return one.select("sid", _joined(C.opening_shapes(F.col("text"))).alias("shapes"), C.closing(F.col("text")).alias("closing"), C.first_word(F.col("text")).alias("first_word"))


def _rate(s, d):
    sums = caps(s, d).agg(F.sum(C.contractions(F.col("text"))).alias("contracted"), F.sum(C.long_forms(F.col("text"))).alias("long"), F.sum(F.size(C.tokens(F.col("text")))).alias("words"))
    return sums.select("contracted", "long", F.round(F.col("contracted") / F.greatest(F.lit(1), F.col("contracted") + F.col("long")), 6).alias("rate"), F.round(1000 * F.col("contracted") / F.col("words"), 6).alias("per_1000"))


def _terms(s, d):
    return caps(s, d).select("sid", F.explode(C.content_terms(F.col("text"))).alias("term")).groupBy("sid", "term").agg(F.count("*").alias("n"))


QUERIES = {
    "f17_tokens": (
        lambda s, d: caps(s, d).select("sid", C.flat(F.col("text")).alias("flat"), _joined(C.tokens(F.col("text"))).alias("toks"), _joined(C.negations(F.col("text"))).alias("negations"), _joined(C.hits(F.col("text"), C.CONDITION)).alias("conditions")),
        f"""WITH {SAID}, {CAPS} SELECT sid, {FLAT('text')} AS flat, array_to_string({TOKS('text')}, '|') AS toks,
            array_to_string(list_filter({TOKS('text')}, lambda t: t IN ({_in(C.NEGATION)}) OR t LIKE '%n''t'), '|') AS negations,
            array_to_string(list_filter({TOKS('text')}, lambda t: t IN ({_in(C.CONDITION)})), '|') AS conditions FROM caps""",
    ),
    "f20_overlap": (
        lambda s, d: caps(s, d).select("sid", F.round(C.overlap(F.col("card"), F.col("text")), 9).alias("overlap")),
        f"""WITH {SAID}, {CAPS}, t AS (SELECT sid, {TOKS('card')} AS c, {TOKS('text')} AS l FROM caps)
        SELECT sid, CASE WHEN len(c) = 0 THEN 0.0 ELSE round(len(list_filter(c, lambda x: list_contains(l, x))) / len(c), 9) END AS overlap FROM t""",
    ),
    "p12_stands_alone": (
        lambda s, d: caps(s, d).select("sid", C.stands_alone(F.col("text")).alias("text_alone"), C.stands_alone(F.col("card")).alias("card_alone")),
        "WITH " + SAID + ", " + CAPS + ", " + ", ".join(
            f"""{x} AS (SELECT sid, list_contains([{_in(C.DIRECTIVE)}], t[1]) OR len(list_filter(t, lambda w: regexp_matches(w, '''(s|re|m|ll|d|ve)$'))) > 0
            OR len(list_filter(range(1, len(t) + 1), lambda i: (t[i] IN ({_in(C.SUBJECT)}) OR t[i] IN ({_in(C.DETERMINER)})) AND len(list_filter(t[i + 1:i + 3], lambda w: w IN ({_in(C.FINITE)}))) > 0)) > 0 AS ok
            FROM (SELECT sid, {TOKS(c)} AS t FROM caps))"""
            for x, c in (("a", "text"), ("b", "card"))
        ) + " SELECT sid, coalesce(a.ok, false) AS text_alone, coalesce(b.ok, false) AS card_alone FROM a JOIN b USING (sid)",
    ),
    "p10_opens_with_words": (
        lambda s, d: caps(s, d).select("sid", C.opens_with_words(F.col("text")).alias("ok"), C.leading_tags(F.col("text")).alias("tags")),
        rf"WITH {SAID}, {CAPS} SELECT sid, ltrim(text, E' \n\t') <> '' AND NOT regexp_matches(ltrim(text, E' \n\t'), '^[#@][\w.]+') AS ok, trim(regexp_extract(text, '^((?:[#@][\w.]+[ \t]*)+)(?:\n+|$)', 1)) AS tags FROM caps",
    ),
    "f16_tags_and_links": (
        lambda s, d: caps(s, d).select("sid", C.strip_tags(F.col("text"), 2).alias("two_tags"), C.without_links(F.col("text")).alias("no_links"), C.linked_in_bio(F.col("text"), "link in bio").alias("bio")),
        rf"""WITH {SAID}, {CAPS},
        p AS (SELECT sid, text, string_split(regexp_replace(text, '(\s+)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS parts FROM caps),
        k AS (SELECT *, list_filter(list_transform(range(1, len(parts) + 1), lambda i: CASE WHEN regexp_full_match(parts[i], '{TAG}') AND len(list_filter(parts[1:i], lambda t: regexp_full_match(t, '{TAG}'))) > 2 THEN NULL ELSE parts[i] END), lambda t: t IS NOT NULL) AS kept FROM p)
        SELECT sid, trim(regexp_replace(array_to_string(kept, ''), '[ \t]{{2,}}', ' ', 'g')) AS two_tags,
            CASE WHEN regexp_matches(text, '{LINK}') THEN trim(regexp_replace(text, '\s*(?:{LINK})\s*', ' ', 'g')) ELSE text END AS no_links,
            CASE WHEN regexp_matches(text, '{LINK}') THEN trim(regexp_replace(regexp_replace(regexp_replace(text, '{LINK}', 'link in bio'), '{LINK}', '', 'g'), '[ \t]{{2,}}', ' ', 'g')) ELSE text END AS bio FROM k""",
    ),
    "f12_closings": (
        _voice,
        rf"""WITH {SAID}, {CAPS}, v AS (SELECT sid, text, regexp_extract(text, '([.!?…]+)["'')\]]*$', 1) AS term, regexp_extract_all(lower(text), '[a-z][a-z''\-]*') AS ws FROM caps)
        SELECT sid, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(ltrim(text), '{_q(p)}{chr(92)}b', 'i') THEN '{n}' END" for n, p in C.VOICE_SHAPES.items())}], lambda x: x IS NOT NULL), '|') AS shapes,
            CASE WHEN contains(term, '?') THEN 'question' WHEN regexp_matches(trim(text), '{_q(C.IMPERATIVE_CLOSE)}\b', 'i') THEN 'command'
                WHEN (term = '' AND len(ws) <= 6) OR (NOT list_has_any(ws, [{_in(C.VERBS)}]) AND len(ws) <= 5) THEN 'fragment_like' ELSE 'statement' END AS closing,
            regexp_extract(lower(text), '[a-z][a-z''\-]*') AS first_word FROM v""",
    ),
    "f14_contractions": (
        _rate,
        f"""WITH {SAID}, {CAPS}, c AS (SELECT CAST(sum({_count('text', C.CONTRACTION)}) AS BIGINT) AS contracted, CAST(sum({_count('text', C.LONG_FORM)}) AS BIGINT) AS long, sum(len({TOKS('text')})) AS words FROM caps)
        SELECT contracted, long, round(contracted / greatest(1, contracted + long), 6) AS rate, round(1000 * contracted / words, 6) AS per_1000 FROM c""",
    ),
    "f10_plain_text": (
        lambda s, d: caps(s, d).select("sid", C.plain(F.col("text")).alias("text")),
        f"WITH {SAID}, {CAPS} SELECT sid, {PLAIN('text')} AS text FROM caps",
    ),
    "a13_term_counts": (_terms, f"WITH {SAID}, {CAPS}, t AS (SELECT sid, unnest({TERMS}) AS term FROM caps) SELECT sid, term, count(*) AS n FROM t GROUP BY ALL"),
    "f24_topic_slug": (
        lambda s, d: caps(s, d).select("sid", C.topic_slug(F.col("card"), F.col("text")).alias("slug")),
        f"""WITH {SAID}, {CAPS}, b AS (SELECT sid, ({BITS('card')})[1:7] AS own, {BITS('text')} AS more FROM caps),
        f AS (SELECT sid, CASE WHEN len(own) >= 3 THEN own ELSE list_concat(own, list_filter(list_transform(range(1, len(more) + 1), lambda i: CASE WHEN NOT list_contains(own, more[i]) AND NOT list_contains(more[1:i - 1], more[i]) THEN more[i] END), lambda x: x IS NOT NULL))[1:7] END AS bits FROM b)
        SELECT sid, CASE WHEN len(bits) = 0 THEN 'clip' ELSE array_to_string(bits, '-') END AS slug FROM f""",
    ),
    "f27_first_sentence": (
        lambda s, d: caps(s, d).select("sid", C.first_sentence(F.col("text"), 6).alias("first")),
        r"WITH " + SAID + ", " + CAPS + r""", w AS (SELECT sid, list_filter(regexp_split_to_array(string_split(regexp_replace(trim(text), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1))[1], '\s+'), lambda x: x <> '') AS ws FROM caps)
        SELECT sid, array_to_string(ws[1:6], ' ') || CASE WHEN len(ws) > 6 THEN '...' ELSE '' END AS first FROM w""",
    ),
    "f9_accents": (
        lambda s, d: caps(s, d).select("sid", C.accent(F.col("card")).alias("accent"), C.accent(F.col("text"), 1.0).alias("loose")),
        "WITH " + SAID + ", " + CAPS + ", " + ", ".join(
            f"""{x}0 AS (SELECT sid, list_filter(list_transform(regexp_split_to_array({c}, '\\s+'), lambda t: trim(lower(t), '.,!?;:''"()[]’“”—-')), lambda t: t <> '' AND t NOT IN ({_in(C.ACCENT_STOP)})) AS ws FROM caps),
            {x}1 AS (SELECT sid, ws, list_transform(ws, lambda b: CASE WHEN regexp_matches(b, '[0-9]') THEN 3.0 WHEN regexp_matches(b, '{C.STRONG}') THEN 2.0 WHEN length(b) >= 8 THEN 1.5 WHEN length(b) >= 6 THEN 1.0 ELSE 0.0 END) AS sc FROM {x}0),
            {x} AS (SELECT sid, CASE WHEN list_max(sc) >= {least} THEN ws[list_position(sc, list_max(sc))] END AS word FROM {x}1)"""
            for x, c, least in (("a", "card", 2.0), ("b", "text", 1.0))
        ) + " SELECT sid, a.word AS accent, b.word AS loose FROM a JOIN b USING (sid)",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
