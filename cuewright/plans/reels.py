"""Queries over pieces, beats and cards, and the same in SQL for DuckDB.

Stand-ins: a user is a piece and the user's event sessions are its segments (hours for seconds); spoken
sentences (see speech) are cards.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import speech as X
from ..functions.captions import VOICING
from ..operators import reels, spoken
from . import speech
from .speech import FEATURES, SAID, WINDOWS, _has, _pick, _q

HOUR = 3600.0
TAPE = """ev AS (SELECT user_id AS u, event_id, epoch_us(ts) / 1e6 AS t FROM events),
fl AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, event_id) > 14400 THEN 1 ELSE 0 END AS new FROM ev),
ru AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM fl),
tape AS (SELECT u AS id, min(t) AS s, max(t) AS e, count(*) AS n FROM ru GROUP BY u, run HAVING max(t) > min(t)),
seg AS (SELECT id AS piece, row_number() OVER (PARTITION BY id ORDER BY s) AS ord, s, e, n FROM tape)"""
SPOKEN = f"{SAID}, {FEATURES}, {WINDOWS}"


def _segments(s, d):
    from .queries import _tape

    return _tape(s, d).select(F.col("id").alias("piece"), F.row_number().over(Window.partitionBy("id").orderBy("s")).alias("ord"), "s", "e", "n")


def _cards(s, d):
    return speech.timed(s, d).select(F.col("rec").alias("piece"), "n", F.col("start").alias("s"), F.col("end").alias("e"), "text", "n_words")


def _duplicates(s, d):
    out = reels.duplicates(_segments(s, d).select(F.col("piece").alias("id"), "s", "e"), 4 * HOUR, 1.0, 3 * HOUR)
    return out.withColumns({c: F.round(c, 6) for c in ("seconds", "share_a", "share_b")})


def _closed(s, d):
    seg = _segments(s, d)
    first = seg.groupBy("piece").agg(F.min("s").alias("t0"), (F.max("e") - F.min("s") + HOUR).alias("total"))
    own = reels.beats(seg, 3 * HOUR, 5 * HOUR).join(first, "piece").select("piece", (F.col("s") - F.col("t0") + 600).alias("s"), (F.col("e") - F.col("t0") + 600).alias("e"))
    return reels.closed(own, first.select("piece", "total"))


def _windows(s, d):
    seg = _segments(s, d)
    base = F.coalesce(F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("piece").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cards = seg.select("piece", F.col("ord").alias("card"), (base + (F.col("e") - F.col("s")) / 2).alias("cs"), (base + (F.col("e") - F.col("s")) * 3 / 2 + 60).alias("ce"))
    return reels.source_windows(cards, seg)


def _clamped(s, d):
    seg = _segments(s, d)
    trim = seg.groupBy("piece").agg((F.min("s") + 3 * HOUR).alias("lo"), (F.max("e") - 3 * HOUR).alias("hi"))
    return reels.clamped(seg.join(trim, "piece"), F.col("lo"), F.col("hi")).select("piece", "ord", "s", "e")


def _gaps(s, d):
    w = Window.partitionBy("piece").orderBy("n")
    c = _cards(s, d).withColumn("gap", F.col("s") - F.lag("e").over(w)).withColumn("short", (F.col("n_words") <= 6) & (F.lag("n_words").over(w) >= 15))
    return c.groupBy("piece").agg(F.count_if(F.col("gap") > 1.8).alias("silences"), F.round(F.max("gap"), 6).alias("longest"), F.count_if("short").alias("shifts"), F.percentile("n_words", F.lit(0.5)).alias("median_words"), F.count("*").alias("sentences"))


def _timing(s, d):
    cards = _cards(s, d)
    words = cards.select("piece", "n", F.posexplode(X.split_words(F.col("text"))).alias("pos", "word"))
    following = F.lead("word").over(Window.partitionBy("piece").orderBy("n", "pos"))
    per = words.withColumn("last", X.ends_terminal(F.col("word"))).withColumn("stop", X.is_terminal(F.col("word"), following))
    ends = per.groupBy("piece").agg(F.count("*").alias("words"), F.round(F.count_if("last") / F.count("*"), 9).alias("punctuation"), F.count_if("stop").alias("stops"))
    kind = cards.groupBy("piece").agg((F.count_if(F.col("n_words") <= 2) / F.count("*") > 0.8).alias("word_level"))
    return ends.join(kind, "piece").select("piece", "words", "punctuation", "stops", F.when(F.col("word_level"), "word-level").otherwise("interpolated").alias("timing"))


def _uniform(s, d):
    words = _cards(s, d).select("piece", "n", "s", "e", X.split_words(F.col("text")).alias("w")).select("piece", "n", "s", "e", F.size("w").alias("k"), F.posexplode("w").alias("pos", "word"))
    at = lambda i: F.round(F.col("s") + (F.col("e") - F.col("s")) * i / F.col("k"), 6)
    return words.select("piece", "n", "pos", "word", at(F.col("pos")).alias("t0"), at(F.col("pos") + 1).alias("t1"))


LABELS = ["", "ANNA: ", "", ">>SPEAKER_1: ", "Um, ", "", "I mean. ", "the the "]
MARKS = ["", " um.", "", " you know, right?", " uh", " like, so", ""]
WORDS = f"""lw AS (SELECT rec, sid, list_filter(regexp_split_to_array({_pick(LABELS, f"sid % {len(LABELS)}", False)} || text || {_pick(MARKS, f"sid % {len(MARKS)}", False)}, '\\s+'), lambda x: x <> '') AS ws FROM said),
wd AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY sid, pos) AS n, word, pos = 0 AS first FROM (SELECT rec, sid, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM lw))"""
_bare_sql = lambda w: f"trim(lower({w}), '.,!?;:''\"()[]’“”—-')"


def _labelled(s, d):
    text = F.concat(F.expr(_pick(LABELS, f"sid % {len(LABELS)}", True)), F.col("text"), F.expr(_pick(MARKS, f"sid % {len(MARKS)}", True)))
    rows = speech.said(s, d).select("rec", "sid", F.posexplode(X.split_words(text)).alias("pos", "word"))
    n = F.row_number().over(Window.partitionBy("rec").orderBy("sid", "pos"))
    out = rows.select("rec", n.cast("bigint").alias("n"), "word", (F.col("pos") == 0).alias("first"))
    return out.withColumns({"t0": F.col("n") * 0.3, "t1": F.col("n") * 0.3 + 0.25})


QUERIES = {
    "a29_duplicates": (
        _duplicates,
        f"""WITH {TAPE}, al AS (SELECT id, sum(e - s) AS al, max(e) AS last FROM tape GROUP BY id),
        p AS (SELECT a.id AS id_a, b.id AS id_b, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM tape a JOIN tape b ON a.id < b.id AND a.s < b.e AND b.s < a.e),
        g AS (SELECT id_a, id_b, sum(e - s) AS seconds, count(*) AS parts, arg_max({{'s': s, 'e': e}}, {{'d': e - s, 's': -s}}) AS l, max(e) AS m FROM p GROUP BY ALL HAVING sum(e - s) > 1.0)
        SELECT id_a, id_b, round(seconds, 6) AS seconds, parts, round(100 * seconds / x.al, 6) AS share_a, round(100 * seconds / y.al, 6) AS share_b, l.s AS s, l.e AS e,
            m > x.last - {3 * HOUR} AND m > y.last - {3 * HOUR} AS same_ending FROM g JOIN al x ON x.id = id_a JOIN al y ON y.id = id_b""",
    ),
    "w19_joins": (
        lambda s, d: reels.joins(_segments(s, d), HOUR),
        f"""WITH {TAPE}, j AS (SELECT piece, ord, greatest(s, e - {HOUR}) AS tail_s, e AS tail_e, lead(s) OVER w AS head_s, least(lead(e) OVER w, lead(s) OVER w + {HOUR}) AS head_e FROM seg WINDOW w AS (PARTITION BY piece ORDER BY ord))
        SELECT *, head_s - tail_e AS gap, head_s < tail_e AS reaches_back FROM j WHERE head_s IS NOT NULL""",
    ),
    "w17_beats": (
        lambda s, d: reels.beats(_segments(s, d), 3 * HOUR, 5 * HOUR),
        f"""WITH RECURSIVE {TAPE}, b(piece, ord, k, s, e, last) AS (
            SELECT piece, ord, 0, s, CASE WHEN e - s > {5 * HOUR} THEN s + {3 * HOUR} ELSE e END, e FROM seg
            UNION ALL SELECT piece, ord, k + 1, e, CASE WHEN last - e > {5 * HOUR} THEN e + {3 * HOUR} ELSE last END, last FROM b WHERE e < last)
        SELECT piece, ord, k, s, e FROM b""",
    ),
    "w18_closed_timeline": (
        _closed,
        f"""WITH RECURSIVE {TAPE}, b(piece, ord, k, s, e, last) AS (
            SELECT piece, ord, 0, s, CASE WHEN e - s > {5 * HOUR} THEN s + {3 * HOUR} ELSE e END, e FROM seg
            UNION ALL SELECT piece, ord, k + 1, e, CASE WHEN last - e > {5 * HOUR} THEN e + {3 * HOUR} ELSE last END, last FROM b WHERE e < last),
        f AS (SELECT piece, min(s) AS t0, max(e) - min(s) + {HOUR} AS total FROM seg GROUP BY piece),
        z AS (SELECT piece, s - t0 + 600 AS s, e - t0 + 600 AS e, total FROM b JOIN f USING (piece))
        SELECT piece, CASE WHEN row_number() OVER w = 1 THEN 0.0 ELSE s END AS s, coalesce(lead(s) OVER w, greatest(e, total)) AS e FROM z WINDOW w AS (PARTITION BY piece ORDER BY s)""",
    ),
    "j7_source_windows": (
        _windows,
        f"""WITH {TAPE}, c AS (SELECT *, coalesce(sum(e - s) OVER (PARTITION BY piece ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM seg),
        k AS (SELECT piece, ord AS card, base + (e - s) / 2 AS cs, base + (e - s) * 3 / 2 + 60 AS ce FROM c)
        SELECT k.piece, card, c.s + greatest(0.0, cs - base) AS s, c.s + least(c.e - c.s, ce - base) AS e FROM k JOIN c ON c.piece = k.piece AND ce > base AND cs < base + (c.e - c.s)""",
    ),
    "j16_hidden_cards": (
        lambda s, d: reels.hidden_cards(_segments(s, d).where("n >= 5").select(F.col("piece").alias("id"), "s", "e"), _segments(s, d).where("n < 5").select((F.col("piece") * 1000 + F.col("ord")).alias("id"), "s", "e"), 4 * HOUR),
        f"""WITH {TAPE} SELECT a.piece AS layer, b.piece * 1000 + b.ord AS card, least(a.e, b.e) - greatest(a.s, b.s) AS seconds
        FROM seg a JOIN seg b ON a.n >= 5 AND b.n < 5 AND least(a.e, b.e) - greatest(a.s, b.s) > 0.08""",
    ),
    "p20_clamped": (
        _clamped,
        f"""WITH {TAPE}, t AS (SELECT piece, min(s) + {3 * HOUR} AS lo, max(e) - {3 * HOUR} AS hi FROM seg GROUP BY piece)
        SELECT piece, ord, greatest(s, lo) AS s, least(e, hi) AS e FROM seg JOIN t USING (piece) WHERE least(e, hi) > greatest(s, lo)""",
    ),
    "w14_chains": (
        lambda s, d: reels.chains(_cards(s, d)).select("piece", "n", "chain"),
        f"""WITH {SPOKEN}, c AS (SELECT rec, n, sum(CASE WHEN n > 0 AND gap <= 1.2 THEN 0 ELSE 1 END) OVER (PARTITION BY rec ORDER BY n) AS run FROM sp)
        SELECT rec AS piece, n, min(n) OVER (PARTITION BY rec, run) AS chain FROM c""",
    ),
    "w20_gap_before": (
        lambda s, d: reels.gap_before(_segments(s, d).withColumn("n", F.col("ord")).withColumn("e", F.col("e") + (F.col("ord") % 3) * 40 * HOUR)).select("piece", "n", "gap"),
        f"""WITH {TAPE}, l AS (SELECT piece, ord AS n, s, e + (ord % 3) * {40 * HOUR} AS e FROM seg)
        SELECT piece, n, s - max(e) OVER (PARTITION BY piece ORDER BY s, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM l""",
    ),
    "w24_look_back": (
        lambda s, d: reels.look_back(speech.timed(s, d), F.lower("text").rlike(X.bounded(VOICING))).select("rec", "n", "voice"),
        f"""WITH {SPOKEN}, h AS (SELECT rec, n, {_has('low', VOICING)} AS hit FROM sp)
        SELECT a.rec, a.n, max(b.n) FILTER (b.hit) AS voice FROM h a JOIN h b ON a.rec = b.rec AND b.n BETWEEN a.n - 2 AND a.n GROUP BY a.rec, a.n""",
    ),
    "w7_inner_gaps": (
        _gaps,
        f"""WITH {SPOKEN}, l AS (SELECT rec, n, n_words, CASE WHEN n > 0 THEN gap END AS gap, n_words <= 6 AND lag(n_words) OVER (PARTITION BY rec ORDER BY n) >= 15 AS short FROM sp)
        SELECT rec AS piece, count(*) FILTER (gap > 1.8) AS silences, round(max(gap), 6) AS longest, count(*) FILTER (short) AS shifts, quantile_cont(n_words, 0.5) AS median_words, count(*) AS sentences FROM l GROUP BY rec""",
    ),
    "a17_punctuation": (
        _timing,
        f"""WITH {SPOKEN}, w AS (SELECT rec, n, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM sp),
        t AS (SELECT rec, word, regexp_matches(word, '{_q(X.TERMINAL)}') AS last, lead(word) OVER (PARTITION BY rec ORDER BY n, pos) AS nxt FROM w),
        p AS (SELECT rec, count(*) AS words, round(count(*) FILTER (last) / count(*), 9) AS punctuation,
            count(*) FILTER (last AND lower(word) NOT IN ({speech._in(X.ABBREVIATIONS)}) AND (regexp_matches(word, '[?!]["'')\\]”’]*$') OR nxt IS NULL OR regexp_matches(nxt, '^["''“‘(\\[]*[A-Z0-9]'))) AS stops FROM t GROUP BY rec),
        k AS (SELECT rec, count(*) FILTER (n_words <= 2) / count(*) > 0.8 AS wl FROM sp GROUP BY rec)
        SELECT rec AS piece, words, punctuation, stops, CASE WHEN wl THEN 'word-level' ELSE 'interpolated' END AS timing FROM p JOIN k USING (rec)""",
    ),
    "w3_uniform_words": (
        _uniform,
        f"""WITH {SPOKEN}, w AS (SELECT rec, n, s, e, len(ws) AS k, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM sp)
        SELECT rec AS piece, n, pos, word, round(s + (e - s) * pos / k, 6) AS t0, round(s + (e - s) * (pos + 1) / k, 6) AS t1 FROM w""",
    ),
    "w10_speaker_marks": (
        lambda s, d: spoken.mark_speakers(_labelled(s, d)).select("rec", "n", "word", "turn"),
        rf"""WITH {SAID}, {WORDS}, l AS (SELECT *, first AND regexp_matches(word, '{_q(spoken.SPEAKER_TOKEN)}') AS label FROM wd),
        t AS (SELECT *, coalesce(lag(label) OVER (PARTITION BY rec ORDER BY n), false) AS turn FROM l) SELECT rec, n, word, turn FROM t WHERE NOT label""",
    ),
    "w9_collapsed": (
        lambda s, d: spoken.collapse_repeats(_labelled(s, d)).select("rec", "n", "word"),
        rf"""WITH {SAID}, {WORDS}, l AS (SELECT *, {_bare_sql('word')} AS b, {_bare_sql('lead(word) OVER (PARTITION BY rec ORDER BY n)')} AS nb FROM wd)
        SELECT rec, n, word FROM l WHERE NOT coalesce(b = nb AND b <> '', false)""",
    ),
    "f8_without_filler": (
        lambda s, d: spoken.strip_filler(_labelled(s, d)).select("rec", "n", "word"),
        None,  # one thing after another: a recursive query takes minutes on a whole table
    ),
    "m11_estimated_cards": (
        lambda s, d: reels.estimated_cards(speech.said(s, d).select(F.col("sid").alias("id"), "text")),
        rf"""WITH {SAID}, w AS (SELECT sid AS id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM said),
        c AS (SELECT id, unnest(range(CAST(ceil(len(ws) / 4) AS INT))) AS card, ws FROM w),
        p AS (SELECT id, card, ws[card * 4 + 1:card * 4 + 4] AS part FROM c), u AS (SELECT *, greatest(0.65e0, len(part) / 2.6e0) AS d FROM p),
        v AS (SELECT *, sum(d) OVER (PARTITION BY id ORDER BY card) AS upto FROM u)
        SELECT id, card, array_to_string(part, ' ') AS text, round(upto - d, 3) AS s, round(upto, 3) AS e FROM v""",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
