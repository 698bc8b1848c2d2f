"""Queries over spoken sentences, and the same in SQL for DuckDB.

Stand-in: each order speaks one sentence, put together by its key from fixed openers, middles and ends (the
prose of the tables has none of the words that the operators look for). A customer's orders are a recording
in the order of their keys; a sentence lasts a third of a second for each word and character, and the pause
after it follows from the key; times are rounded to thousandths, so that both engines compare the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import speech as X
from ..operators import moments
from ..operators import rules as R

OPENERS = ["So what do you actually want", "But", "I mean", "Twenty-two people told me", "Um", "Yeah, because", "That is why", "Or you had a second chance", "Here's the thing", "They never tell you", "How do you", "The problem is", "And then Dana Smith", "You know", "Most people think", "I realized", "It was not the money", "Nobody in Paris", "Well, the truth is", "Okay"]
MIDDLES = ["we lost 40% of it", "your first offer was wrong", "kind of works, like, always", "it turns out to be real", "until the last three months", "but yeah, subscribe to the show notes", "nothing costs more than that", "Mary Jane and BBC paid $5,000", "we went back to the slides", "you're the one who quits", "xyz happened instead", "everything is a choice, isn't it", "I almost gave up on my team in Rome", "it's the same in fact", "", "the worst part was hardest"]
ENDS = [".", "?", "!", ", right?", ".", " and so on.", " and", " that.", ".", ", you know.", " stuff", '."', "", "?!", " so."]


def _pick(values: list[str], at: str, spark: bool) -> str:
    quoted = ", ".join("'" + v.replace("'", "\\'" if spark else "''") + "'" for v in values)
    return f"element_at(array({quoted}), CAST({at} AS INT) + 1)" if spark else f"list_extract([{quoted}], CAST({at} AS INT) + 1)"


def _said(spark: bool) -> str:
    div = "DIV" if spark else "//"
    a, b, c = _pick(OPENERS, f"o_orderkey % {len(OPENERS)}", spark), _pick(MIDDLES, f"o_orderkey {div} 3 % {len(MIDDLES)}", spark), _pick(ENDS, f"o_orderkey {div} 7 % {len(ENDS)}", spark)
    return f"trim(concat({a}, ' ', {b}, {c}))"


SAID = f"said AS (SELECT o_custkey AS rec, o_orderkey AS sid, {_said(False)} AS text FROM orders)"


def said(s, d):
    return s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("rec"), F.col("o_orderkey").alias("sid"), F.expr(_said(True)).alias("text"))


#: Letters beyond ASCII count as letters at word edges.
_ASCII = lambda x: f"regexp_replace({x}, '[à-öø-ÿœßÀ-ÖØ-ÞŒ]', 'x', 'g')"
_q = lambda p: p.replace("'", "''").replace(r"[^\p{L}\p{N}_]", r"\W").replace(r"[\p{L}\p{N}_]", r"\w")
_has = lambda x, p: rf"regexp_matches({x}, '\b(?:{_q(p)})\b')"
_in = lambda values: ", ".join("'" + v.replace("'", "''") + "'" for v in values)

#: Features of sentences (rec, sid, text): one step for each group of them.
FEATURES = rf"""
f0 AS (SELECT *, {_ASCII('lower(text)')} AS low, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ws FROM said),
f1 AS (SELECT *, len(ws) AS n_words, ends_with(rtrim(text, '"'')”’ '), '?') AND len(ws) >= 4 AS is_question,
    list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9''’\-\.,$%]+'), lambda t:
        CASE WHEN regexp_matches(t, '[0-9]') THEN trim(t, '.,')
             WHEN list_has_any(string_split(lower(trim(t, '.,''’')), '-'), [{_in(X.NUMBER_WORDS)}]) THEN lower(trim(t, '.,''’')) END), lambda t: t IS NOT NULL) AS numbers,
    list_transform(ws, lambda t: trim(t, '.,?!;:"''()“”‘’')) AS bare FROM f0),
f2 AS (SELECT *, list_transform(range(1, len(ws) + 1), lambda k: CASE WHEN k > 1 AND length(bare[k]) > 1 AND regexp_matches(bare[k], '^\p{{Lu}}')
        AND bare[k] NOT IN ({_in(X.NAME_STOP)}) AND bare[k] <> upper(bare[k]) THEN bare[k] ELSE '|' END) AS caps FROM f1),
f3 AS (SELECT *, list_filter(list_transform(string_split(array_to_string(caps, ' '), '|'), lambda t: trim(t)), lambda t: t <> '') AS names,
    list_filter([{", ".join(f"CASE WHEN {_has('low' if label != 'but' else chr(114) + 'egexp_replace(low, ' + chr(39) + chr(92) + 'bbut' + chr(92) + 's+yeah' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39) + ')', 'but' if label == 'but' else p)} THEN '{label.replace(chr(39), chr(39) * 2)}' END" for p, label in X.CONTRAST)},
        CASE WHEN regexp_matches(low, '\b(?:wasn''?t|isn''?t|not)\b[^.?!]{{0,50}}\b(?:it was|it is|it''?s|but)\b') THEN 'not X, it is Y' END], lambda t: t IS NOT NULL) AS contrast,
    len(list_filter(regexp_extract_all(low, '\w+'), lambda t: t IN ({_in(X.YOU)}))) AS you,
    regexp_matches(trim(low), '{_q(X.ACK)}') OR (n_words <= 2 AND NOT is_question) AS is_ack,
    len(text) - len(replace(text, '!', '')) AS exclaims, {_has('low', X.PROMO)} AS promo,
    trim(regexp_replace(trim(text), '{_q(X.OPENER)}', '', 'i')) AS rest FROM f2),
f4 AS (SELECT *, len(regexp_extract_all(low, '\b(?:{_q(X.FILLER)}|{X.FILLER_LIKE})\b')) + is_ack::INT AS filler,
    rest <> '' AND NOT regexp_matches(rest, '{_q(X.TAG)}', 'i') AND regexp_matches(rest, '{_q(X.INTERROGATIVE)}\b', 'i') AS asks FROM f3),
feat AS (SELECT *, (regexp_matches(text, '{_q(X.OPENER)}', 'i') AND NOT asks) OR is_ack AS bad_opener,
    is_ack OR filler > 0 OR promo OR (n_words <= 4 AND NOT (len(numbers) > 0 OR len(names) > 0 OR len(contrast) > 0 OR you > 0 OR is_question OR {_has('low', X.CLOSE_STRONG)})) AS dead FROM f4)"""


_asc = lambda p: _q(p).replace(R.START, r"\b").replace(R.END, r"\b").replace(r"(?:^|\W)", r"\b").replace(r"(?:\W|$)", r"\b")
#: The rules of a clip over clips (id, sents): a row for each fault, one without a fault for each clip that has none.
CLIP_RULES = rf"""
c0 AS (SELECT id, sents AS own, list_transform(sents, lambda x: {_ASCII('x')}) AS sents FROM clips),
c1 AS (SELECT *, sents[1] AS first, sents[-1] AS last, array_to_string(sents, ' ') AS body, len(sents) > 0 AS has FROM c0),
c2 AS (SELECT *, trim(regexp_replace(first, '{R.SOFT_CONNECTIVE}\b[,\s]*', '', 'i')) AS rest, regexp_matches(last, '[.!?]$') AS ended, regexp_replace(last, '[.!?]+$', '') AS stem,
    trim(regexp_replace(trim(first), '{_q(X.OPENER)}', '', 'i')) AS bare FROM c1),
c3 AS (SELECT *, bare <> '' AND NOT regexp_matches(bare, '{_q(X.TAG)}', 'i') AND regexp_matches(bare, '{_q(X.INTERROGATIVE)}\b', 'i') AS asks,
    CASE WHEN regexp_matches(first, '{_q(R.DANGLING)}', 'i') AND NOT (bare <> '' AND NOT regexp_matches(bare, '{_q(X.TAG)}', 'i') AND regexp_matches(bare, '{_q(X.INTERROGATIVE)}\b', 'i')) THEN 1
         WHEN regexp_matches(first, '{_q(R.HARD_CONTINUATION)}\b', 'i') THEN 2 WHEN regexp_matches(rest, '{R.ORPHAN}\b', 'i') THEN 3
         WHEN rest <> trim(first) AND NOT (regexp_matches(rest, '{_q(R.STANDS)}', 'i') OR ends_with(rest, '?')) THEN 4 END AS opening,
    list_position(list_transform(sents, lambda x: regexp_matches(x, '\b({_q(R.REFERENCE)})\b', 'i')), true) AS refers,
    list_position(list_transform(sents, lambda x: regexp_matches(x, '{_asc(R.PLACEHOLDER)}', 'i')), true) AS holds FROM c2),
c4 AS (SELECT id, list_filter([
    CASE WHEN NOT has THEN {{'f': 'empty', 's': 'fatal', 'e': ''}} END,
    CASE opening WHEN 1 THEN {{'f': 'opens on a dangling connective', 's': 'fatal', 'e': own[1][1:110]}} WHEN 2 THEN {{'f': 'opens mid argument', 's': 'fatal', 'e': own[1][1:110]}}
        WHEN 3 THEN {{'f': 'opens on an unresolved pronoun', 's': 'fatal', 'e': own[1][1:110]}} WHEN 4 THEN {{'f': 'opens mid argument', 's': 'serious', 'e': own[1][1:110]}} END,
    CASE WHEN regexp_matches(first, '{R.FILLER}', 'i') THEN {{'f': 'opens on filler', 's': 'serious', 'e': own[1][1:110]}} END,
    CASE WHEN len(regexp_extract_all(own[1], '[A-Za-z'']+')) > 34 THEN {{'f': 'opening sentence is long', 's': 'minor', 'e': own[1][1:110]}} END,
    CASE WHEN refers > 0 THEN {{'f': 'refers to the rest of the recording', 's': 'serious', 'e': own[refers][1:110]}} END,
    CASE WHEN has AND (NOT ended OR (regexp_matches(stem, '{_asc(R.TAIL)}', 'i') AND NOT regexp_matches(stem, '\b(that|so)\s*$', 'i'))) THEN {{'f': 'ends mid sentence', 's': 'fatal', 'e': right(own[-1], 110)}} END,
    CASE WHEN regexp_matches(last, '{R.FILLER}', 'i') THEN {{'f': 'ends on filler', 's': 'serious', 'e': own[-1][1:110]}} END,
    CASE WHEN has AND NOT regexp_matches(body, '{_asc(R.TURN)}', 'i') THEN {{'f': 'no turn', 's': 'serious', 'e': ''}} END,
    CASE WHEN has AND NOT regexp_matches(body, '{_asc(R.STAKES)}', 'i') THEN {{'f': 'nothing at stake', 's': 'minor', 'e': ''}} END,
    CASE WHEN has AND len(sents) < 3 THEN {{'f': 'too few sentences', 's': 'serious', 'e': ''}} END,
    CASE WHEN holds > 0 THEN {{'f': 'says a placeholder out loud', 's': 'serious', 'e': own[holds][1:110]}} END], lambda x: x IS NOT NULL) AS fs FROM c3),
faulted AS (SELECT id, CAST(CASE WHEN len(list_filter(fs, lambda x: x.s = 'fatal')) > 0 THEN 2 WHEN len(list_filter(fs, lambda x: x.s = 'serious')) >= 2 THEN 1 ELSE 0 END AS INT) AS verdict,
    f.f AS fault, f.s AS severity, f.e AS evidence FROM (SELECT id, fs, unnest(CASE WHEN len(fs) = 0 THEN [NULL] ELSE fs END) AS f FROM c4))"""


def featured(s, d):
    return X.once_each(said(s, d), X.features(F.col("text")))


_LISTS = ("numbers", "names", "contrast")


def _features(s, d):
    return featured(s, d).select("sid", "n_words", "is_question", *[F.array_join(c, "|").alias(c) for c in _LISTS], "you", "filler", "is_ack", "exclaims", "promo", "bad_opener", "dead")


#: Seconds of silence after a sentence, by its key.
PAUSES = [0.1, 0.5, 0.7, 1.2, 2.0, 0.2, 4.5, 0.3]
_timed_sql = f"""sents AS (
    SELECT *, row_number() OVER r - 1 AS n, CAST(length(text) / 4e0 AS DOUBLE) AS dur, CAST(list_extract([{", ".join(f"{p}e0" for p in PAUSES)}], CAST(sid % {len(PAUSES)} AS INT) + 1) AS DOUBLE) AS pause,
        regexp_matches(text, '{_q(X.TERMINAL)}') AS clean_end FROM feat WINDOW r AS (PARTITION BY rec ORDER BY sid)),
sn AS (SELECT *, round(coalesce(sum(dur + pause) OVER b, 0e0), 3) AS s, round(coalesce(sum(dur + pause) OVER b, 0e0) + dur, 3) AS e FROM sents WINDOW b AS (PARTITION BY rec ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
sg AS (SELECT *, coalesce(s - lag(e) OVER (PARTITION BY rec ORDER BY n), 0e0) AS gap FROM sn)"""
WINDOWS = rf"""
{_timed_sql},
sp AS (SELECT *, sum(CASE WHEN gap > 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec ORDER BY n) AS part FROM sg),
wi AS (SELECT a.rec, a.n AS i, b.n AS j, a.s AS t0, b.e AS t1, CASE WHEN a.n > 0 THEN a.gap END AS before FROM sp a JOIN sp b
    ON a.rec = b.rec AND b.n >= a.n AND a.part = b.part AND b.clean_end AND b.e - a.s BETWEEN 35 AND 75 WHERE NOT a.bad_opener OR a.n = 0),
mem AS (SELECT wi.*, x.* EXCLUDE (rec, part), x.n - i AS k, j - i + 1 AS size FROM wi JOIN sp x ON x.rec = wi.rec AND x.n BETWEEN i AND j),
answers AS (
    SELECT m.rec, m.i, m.j, m.k FROM mem m JOIN mem y ON y.rec = m.rec AND y.i = m.i AND y.j = m.j AND y.k BETWEEN m.k + 1 AND m.k + 4 AND NOT y.is_question
    WHERE m.is_question AND NOT m.promo AND m.k < m.size - 2 GROUP BY m.rec, m.i, m.j, m.k HAVING sum(y.n_words) >= 20 AND sum(y.filler) <= 1),
asked AS (SELECT rec, i, j, min(k) AS k FROM answers GROUP BY rec, i, j),
ag AS (SELECT rec, i, j, any_value(t0) AS t0, any_value(t1) AS t1, any_value(before) AS before, any_value(size) AS size, greatest(1, sum(n_words)) AS words,
    sum(len(numbers)) AS nums, sum(len(names)) AS nms, sum(len(contrast)) AS hits, bool_or(len(contrast) > 0 AND (s - t0) / (t1 - t0) >= 0.4) AS late,
    greatest(0, sum(you) - len(regexp_extract_all(string_agg(low, ' ' ORDER BY k), '\byou know\b'))) AS yous, bool_and(clean_end) AS whole,
    count(*) FILTER (k > 0 AND gap > 1.8) AS silent, sum(exclaims) AS ex, sum(filler) AS fill, count(*) FILTER (dead AND k < 3) + count(*) FILTER (dead AND k >= size - 2) AS deads, count(*) FILTER (promo) AS promos,
    any_value(CASE WHEN k = 0 THEN (CASE WHEN is_question THEN 8 ELSE 0 END) + (CASE WHEN len(numbers) > 0 THEN 4 ELSE 0 END) + (CASE WHEN you > 0 THEN 3 ELSE 0 END) + (CASE WHEN len(contrast) > 0 THEN 3 ELSE 0 END) END) AS hook,
    any_value(CASE WHEN k = 0 THEN n_words END) AS first_words FROM mem GROUP BY rec, i, j),
sh AS (SELECT a.rec, a.i, a.j, count(*) AS shifts FROM mem a JOIN mem b ON a.rec = b.rec AND a.i = b.i AND a.j = b.j AND b.k = a.k + 1 WHERE a.n_words >= 15 AND b.n_words <= 6 GROUP BY ALL),
cl AS (SELECT rec, i, j, CASE WHEN regexp_matches(low, '{_q(X.CLOSE_WEAK_START)}\b') OR regexp_matches(low, '{_q(X.CLOSE_WEAK_END)}') THEN -10 ELSE
    greatest(-10, least(14, (CASE WHEN n_words <= 14 THEN 4 ELSE 0 END) + (CASE WHEN n_words <= 8 THEN 3 ELSE 0 END) + (CASE WHEN {_has('low', X.CLOSE_STRONG)} THEN 4 ELSE 0 END) + (CASE WHEN is_question THEN 2 ELSE 0 END) - (CASE WHEN n_words > 30 THEN 3 ELSE 0 END))) END AS closing FROM mem WHERE n = j),
pts AS (SELECT ag.rec, ag.i, ag.j, t0, t1, unnest([
    {{'s': 'hook', 'p': least(15, hook + CASE WHEN hook > 0 AND first_words <= 16 THEN 3 ELSE 0 END)}},
    {{'s': 'question_then_answer', 'p': CASE WHEN asked.k <= greatest(1, size // 3) THEN 14 WHEN asked.k IS NOT NULL THEN 8 END}},
    {{'s': 'concrete_specifics', 'p': least(16, 3 * nums + 1.5e0 * nms)}},
    {{'s': 'contrast_or_reversal', 'p': CASE WHEN hits > 0 THEN least(16, 5 + 3 * (least(hits, 4) - 1) + CASE WHEN late THEN 3 ELSE 0 END) END}},
    {{'s': 'direct_address', 'p': least(8e0, 100e0 * yous / words * 0.8e0)}},
    {{'s': 'closing_line', 'p': closing}},
    {{'s': 'completeness', 'p': (CASE WHEN whole THEN 5 ELSE 0 END) + (CASE WHEN silent = 0 THEN 3 ELSE 0 END) + (CASE WHEN words / size BETWEEN 6 AND 24 THEN 2 ELSE 0 END)}},
    {{'s': 'internal_silence', 'p': -4 * silent}},
    {{'s': 'energy_proxy', 'p': least(8e0, (CASE WHEN before >= 1.5 THEN 6 WHEN before >= 0.8 THEN 4 ELSE 0 END) + least(3e0, 1.5e0 * coalesce(shifts, 0)) + least(2, ex))}},
    {{'s': 'clean_exit', 'p': CASE WHEN nx.s - t1 >= 1.0 THEN 5 WHEN nx.s - t1 >= 0.6 THEN 2 WHEN nx.s - t1 < 0.3 AND nx.n_words <= 12 AND NOT nx.dead THEN -5 END}},
    {{'s': 'filler', 'p': -least(25e0, 200e0 * fill / words)}},
    {{'s': 'dead_weight_at_edges', 'p': -3 * deads}},
    {{'s': 'promo_or_housekeeping', 'p': -least(20, 10 * promos)}},
    {{'s': 'duration', 'p': CASE WHEN t1 - t0 BETWEEN 45 AND 60 THEN 4 ELSE 2 END}}]) AS x
    FROM ag LEFT JOIN asked USING (rec, i, j) LEFT JOIN sh USING (rec, i, j) JOIN cl USING (rec, i, j) LEFT JOIN sp nx ON nx.rec = ag.rec AND nx.n = ag.j + 1),
why AS (SELECT rec, i, j, t0, t1, x.s AS signal, round(CAST(x.p AS DOUBLE), 1) AS points FROM pts WHERE round(CAST(x.p AS DOUBLE), 1) <> 0),
won AS (SELECT rec, i, j, any_value(t0) AS t0, any_value(t1) AS t1, sum(CAST(round(points * 10) AS INT)) / 10e0 AS score FROM why GROUP BY rec, i, j)"""


def timed(s, d, **more):
    """rec, n, text, start, end, clean_end, features and `more` (columns over the text) of each customer's sentences."""
    w = Window.partitionBy("rec").orderBy("sid")
    pause = F.element_at(F.array(*[F.lit(p) for p in PAUSES]), (F.col("sid") % len(PAUSES) + 1).cast("int"))
    rows = said(s, d).withColumn("dur", F.length("text") / 4.0).withColumn("pause", pause)
    start = F.coalesce(F.sum(F.col("dur") + F.col("pause")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    out = rows.select("rec", (F.row_number().over(w) - 1).alias("n"), "text", F.round(start, 3).alias("start"), F.round(start + F.col("dur"), 3).alias("end"))
    text = F.col("text")
    return X.once_each(out, {"clean_end": X.ends_terminal(text), **X.features(text), **moments.closings(text), **more})


def _scores(s, d):
    # outer: an inner explode would make the optimiser score every window twice, as a filter
    return moments.scored(moments.windows(timed(s, d))).select("rec", "i", "j", F.explode_outer("why").alias("x")).where("x is not null").select("rec", "i", "j", "x.signal", "x.points")


def _best(s, d):
    return moments.best_ends(moments.scored(moments.windows(timed(s, d)))).select("rec", "i", "j", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("score", 6).alias("score"))


def _picked(s, d):
    sents = moments.clean_starts(timed(s, d))
    best = moments.best_ends(moments.scored(moments.windows(sents.drop("starts_clean"))))
    return moments.pick(moments.lead_ins(best, sents)).withColumn("strength", moments.strength(F.col("score")))


QUERIES = {
    "f5_sentence_features": (
        _features,
        f"""WITH {SAID}, {FEATURES}
        SELECT sid, n_words, is_question, array_to_string(numbers, '|') AS numbers, array_to_string(names, '|') AS names,
            array_to_string(contrast, '|') AS contrast, you, filler, is_ack, exclaims, promo, bad_opener, dead FROM feat""",
    ),
    "f3_clean_cue_text": (
        lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", X.clean_cue(F.col("html")).alias("text")),
        r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\{\\[^}]*\}', '', 'g'),
            '\[[^\]]{0,30}\]|\((?:music|laughs?|laughter|applause|inaudible)[^)]*\)', ' ', 'gi') AS text FROM pages""",
    ),
    "g2_window_signals": (_scores, f"WITH {SAID}, {FEATURES}, {WINDOWS} SELECT rec, i, j, signal, points FROM why"),
    "a14_best_end": (
        _best,
        f"""WITH {SAID}, {FEATURES}, {WINDOWS}, r AS (SELECT *, row_number() OVER (PARTITION BY rec, i ORDER BY score DESC, t1 - t0, j) AS r FROM won)
        SELECT rec, i, j, round(t0, 3) AS start, round(t1, 3) AS "end", score FROM r WHERE r = 1""",
    ),
    "t3_pick_moments": (
        _picked,
        rf"""WITH RECURSIVE {SAID}, {FEATURES}, {WINDOWS}, be AS (SELECT *, row_number() OVER (PARTITION BY rec, i ORDER BY score DESC, t1 - t0, j) AS r FROM won),
        l0 AS (SELECT *, lag(ws[-1]) OVER w AS word, lag(s) OVER w AS ps, lag(e) OVER w AS pe, lag(clean_end) OVER w AND NOT lag(is_ack) OVER w AND lag(filler) OVER w = 0 AND NOT lag(promo) OVER w AND NOT lag(bad_opener) OVER w AS fine FROM sp WINDOW w AS (PARTITION BY rec ORDER BY n)),
        l1 AS (SELECT *, n = 0 OR coalesce(regexp_matches(word, '{_q(X.TERMINAL)}') AND lower(word) NOT IN ({_in(X.ABBREVIATIONS)}), false) OR coalesce(gap >= 0.6, false) AS starts FROM l0),
        l2 AS (SELECT rec, n AS i, starts, coalesce(lag(starts) OVER (PARTITION BY rec ORDER BY n), false) AS lead_starts, CASE WHEN regexp_matches(text, '{_q(X.ANAPHOR)}\b', 'i') AND NOT is_question AND fine AND s - pe < 1 AND pe - ps <= 12 THEN ps END AS early FROM l1),
        c AS (SELECT be.rec, t0, t1, score, starts, lead_starts, early, row_number() OVER (PARTITION BY be.rec ORDER BY score DESC, t1 - t0, be.i) AS place FROM be JOIN l2 ON l2.rec = be.rec AND l2.i = be.i WHERE r = 1),
        g AS (SELECT DISTINCT rec, 0 AS rank, CAST(0 AS BIGINT) AS place, CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[]) AS kept, 0e0 AS score, false AS led FROM c
            UNION ALL SELECT rec, rank + 1, place, list_append(kept, {{'s': CASE WHEN led THEN early ELSE t0 END, 'e': t1}}), score, led FROM (
                SELECT *, row_number() OVER (PARTITION BY rec ORDER BY place) AS k FROM (
                    SELECT c.*, g.rank, g.kept, coalesce(c.t1 - c.early <= 75 AND len(list_filter(g.kept, lambda x: least(c.t1, x.e) - greatest(c.early, x.s) > 0)) = 0, false) AS led FROM g JOIN c ON c.rec = g.rec AND c.place > g.place
                    WHERE g.rank < 5 AND len(list_filter(g.kept, lambda x: least(c.t1, x.e) - greatest(c.t0, x.s) > 0)) = 0)
                WHERE CASE WHEN led THEN lead_starts ELSE starts END) WHERE k = 1)
        SELECT rec, CAST(rank AS INT) AS rank, kept[-1].s AS start, kept[-1].e AS "end", score, led AS lead_in, CASE WHEN score >= 50 THEN 'strong' WHEN score >= 35 THEN 'usable' ELSE 'weak' END AS strength FROM g WHERE rank > 0""",
    ),
    "p7_starts_clean": (
        lambda s, d: moments.clean_starts(timed(s, d)).select("rec", "n", "starts_clean"),
        f"""WITH {SAID}, {FEATURES}, {WINDOWS}, l AS (SELECT *, lag(ws[-1]) OVER (PARTITION BY rec ORDER BY n) AS w FROM sp)
        SELECT rec, n, n = 0 OR (regexp_matches(w, '{_q(X.TERMINAL)}') AND lower(w) NOT IN ({_in(X.ABBREVIATIONS)})) OR gap >= 0.6 AS starts_clean FROM l""",
    ),
    "p9_stands_as_question": (
        lambda s, d: said(s, d).select("sid", X.stands_as_question(F.col("text")).alias("ok")),
        f"WITH {SAID}, {FEATURES} SELECT sid, asks AS ok FROM feat",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
