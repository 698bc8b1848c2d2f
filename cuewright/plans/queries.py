"""Registered queries over the driver's tables, and the same in SQL for DuckDB.

Stand-ins: documents are videos (lang is the format, n_chars the views); conversations are recordings
whose clock is the running length of the text; event sessions are tape intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import cohort, intervals, rules, similarity, timed
from ..sources import transcripts
from . import captions, cards, files, making, naming, planning, profiles, reels, speech, voices

DAY, HOUR = 86400.0, 3600.0
#: Words of the languages at hand that say nothing of a topic.
STOP = ["the", "and", "that", "for", "with", "was", "are", "this", "from", "der", "die", "das", "und", "des", "les", "que", "del", "los", "las", "par", "sur", "con", "por"]


#: Phrases too short for a key are broadcast up to this many rows, and joined without it beyond.
SHORT = 10_000


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _videos(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("n_chars").alias("views"), F.col("lang").alias("format"))


def _cues(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w).cast("double")
    return _t(s, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("cue"), (end - F.length("text")).alias("start"), end.alias("end"), "text", "role")


def _words(s, d):
    return timed.words(_cues(s, d))


def _events(s, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return _t(s, d, "events").select(F.col("user_id").alias("user"), F.col("event_id").alias("event"), (micros / 1e6).alias("t"), "value")


def _tape(s, d):
    return intervals.sessions(_events(s, d), 4 * HOUR).where("e > s").select("id", "s", "e", "n")


def _terms(s, d):
    lines = _t(s, d, "lineitem").join(_t(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("c_nationkey").alias("id"), F.col("p_type").alias("term")).agg(F.count("*").alias("n"))


def _sents(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.filter(F.transform(F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "").alias("sents"))


def _n(df: DataFrame, *by) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


VID = "v AS (SELECT doc_id AS id, text AS title, n_chars AS views, lang AS format FROM documents)"
MARK = VID + f""", c AS (SELECT * FROM v WHERE views IS NOT NULL AND NOT (regexp_matches(title, '{X.NOISE}', 'i') OR (len(regexp_extract_all(title, '#[A-Za-z0-9_]+')) >= 3 AND len(regexp_extract_all(regexp_replace(title, '#[A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z'']+')) <= 6))),
m AS (SELECT *, row_number() OVER (PARTITION BY format ORDER BY views DESC, id) <= greatest(1, count(*) OVER (PARTITION BY format) // 4) AS winner FROM c)"""
_q = lambda p: p.replace("'", "''")
_strip = "ltrim(title)"
for _ in range(3):
    _strip = f"(SELECT CASE WHEN b = '' THEN a ELSE b END FROM (SELECT a, ltrim(regexp_replace(a, '{_q(X.MARKERS)}\\b[\\s,]*', '', 'i')) AS b FROM (SELECT {_strip} AS a)))"
_shape = lambda n: f"(regexp_matches(title, '{_q(X.SHAPES[n])}', 'i') OR regexp_matches(stripped, '{_q(X.SHAPES[n])}', 'i'))"
LIFT = "WITH " + MARK + f", st AS (SELECT *, {_strip} AS stripped FROM m), x AS (" + " UNION ALL ".join(f"SELECT '{n}' AS shape, count(*) FILTER (winner) AS w, count(*) FILTER (NOT winner) AS r, count(*) FILTER (winner AND {_shape(n)}) AS winners_using_it, count(*) FILTER (NOT winner AND {_shape(n)}) AS rest_using_it FROM st" for n in X.SHAPES) + """)
SELECT *, (winner_rate + 0.01e0) / (rest_rate + 0.01e0) AS lift, winners_using_it >= 6 AND (winner_rate + 0.01e0) / (rest_rate + 0.01e0) >= 1.25e0 AS recommend
FROM (SELECT shape, winners_using_it, rest_using_it, winners_using_it / greatest(w, 1) AS winner_rate, rest_using_it / greatest(r, 1) AS rest_rate FROM x)"""
CUE = "q AS (SELECT conv_id AS rec, turn AS cue, text, role, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS e FROM conversations), cues AS (SELECT rec, cue, e - length(text) AS s, e, text, role FROM q)"
WORD = CUE + r""", tk AS (SELECT rec, cue, s, e, list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '') AS ws FROM cues WHERE e > s),
tp AS (SELECT rec, cue, s, e, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM tk),
tw AS (SELECT *, length(word) + 1 AS w, sum(length(word) + 1) OVER (PARTITION BY rec, cue ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto, sum(length(word) + 1) OVER (PARTITION BY rec, cue) AS total FROM tp),
words AS (SELECT rec, cue, CAST(pos AS INT) AS pos, word, s + (e - s) * (upto - w) / total AS t0, s + (e - s) * upto / total AS t1 FROM tw)"""
TAPE = "ev AS (SELECT user_id AS u, event_id, epoch_us(ts) / 1e6 AS t FROM events), fl AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY u ORDER BY t, event_id) > 14400 THEN 1 ELSE 0 END AS new FROM ev), ru AS (SELECT *, sum(new) OVER (PARTITION BY u ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM fl), tape AS (SELECT u AS id, min(t) AS s, max(t) AS e, count(*) AS n FROM ru GROUP BY u, run HAVING max(t) > min(t))"
LONG = "lng AS (SELECT id, s - 7200 AS s, e + 7200 AS e FROM tape)"
ISLE = LONG + ", i1 AS (SELECT *, CASE WHEN s > coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1e300) + 1e-9 THEN 1 ELSE 0 END AS new FROM lng), i2 AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM i1), isle AS (SELECT id, min(s) AS s, max(e) AS e FROM i2 GROUP BY id, k)"
TERM = "tm AS (SELECT c_nationkey AS id, p_type AS term, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL), df AS (SELECT term, count(DISTINCT id) AS df, ln(1 + (SELECT count(DISTINCT id) FROM tm) / count(DISTINCT id)) AS idf FROM tm GROUP BY term), ve AS (SELECT id, term, (1 + ln(n)) * idf AS v FROM tm JOIN df USING (term)), nv AS (SELECT id, sum(v * v) AS n2, count(*) AS k FROM ve GROUP BY id)"
SENT = r"sn AS (SELECT doc_id AS id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sents FROM documents)"


def _padded(s, d):
    return _tape(s, d).select("id", (F.col("s") - 7200).alias("s"), (F.col("e") + 7200).alias("e"))


def _month(s, d):
    return _events(s, d).groupBy(F.col("user").alias("id")).agg(F.min("t").alias("s"), F.max("t").alias("e"))


def _over(s, d):
    return cohort.over_represented(cohort.winners(_videos(s, d)), STOP)


def _counted(df, by, value):
    """by, value, k, upto and total: rows of each value, so that windows hold a row for each value and not each row."""
    w = Window.partitionBy(by)
    upto = F.sum("k").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return df.groupBy(by, value).agg(F.count("*").alias("k")).withColumn("upto", upto).withColumn("total", F.sum("k").over(w))


def _percentile(s, d):
    docs = _t(s, d, "documents")
    ranks = _counted(docs, "lang", "n_chars").select(F.col("lang").alias("g"), F.col("n_chars").alias("v"), F.floor(100 * F.col("upto") / F.col("total") + 0.5).cast("bigint").alias("percentile"))
    return docs.join(ranks, F.col("lang").eqNullSafe(F.col("g")) & F.col("n_chars").eqNullSafe(F.col("v")), "left").select("doc_id", "percentile")


def _upper_median(s, d):
    counts = _counted(_t(s, d, "documents"), "source", "n_chars").where(F.col("upto") >= F.floor(F.col("total") / 2) + 1)
    return counts.groupBy("source").agg(F.first("total").alias("n"), F.min("n_chars").alias("upper_median"))


def _coverage(s, d):
    own = intervals.islands(_padded(s, d))
    return own.groupBy("id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count("*").alias("parts"), (F.max("e") - F.min("s")).alias("extent"))


def _locate_all(s, d):
    """Points among all sessions, numbered by start and user: the earliest that holds the point."""
    return intervals.first_holding(_events(s, d).select(F.col("event").alias("p"), "t"), _tape(s, d), HOUR)


def _intersect_all(s, d):
    """For each user's month, shared time with every island of every user."""
    return intervals.coverage(_month(s, d), intervals.islands(_padded(s, d)), HOUR).withColumnRenamed("id", "id_b")


def _band(s, d):
    """Words within 5 of each recording's cue boundaries: how many, on either side."""
    c = _cues(s, d).select("rec", F.col("end").alias("cut"))
    w = _words(s, d).select("rec", ((F.col("t0") + F.col("t1")) / 2).alias("mid"))
    hit = c.join(w, "rec").where("mid between cut - 20 and cut + 20")
    return hit.groupBy("rec", "cut").agg(F.count_if(F.col("mid") <= F.col("cut")).alias("before"), F.count_if(F.col("mid") > F.col("cut")).alias("after"))


def _prefix(s, d):
    """Names and types of parts with words equal, or both of four letters and one the other's beginning.

    Words of two letters and more; equal words and prefixes share their first four letters, so these are the key.
    """
    side = lambda c, x: _t(s, d, "part").select("p_partkey", F.explode(F.array_distinct(X.words(F.col(c)))).alias(x)).where(F.length(x) >= 2).withColumn("k", F.substring(x, 1, 4))
    hit = side("p_name", "a").unionByName(side("p_brand", "a")).distinct().join(side("p_type", "b").unionByName(side("p_brand", "b")).distinct(), ["p_partkey", "k"])
    return hit.where("a = b or (length(a) >= 4 and length(b) >= 4 and (startswith(a, b) or startswith(b, a)))").select("p_partkey", "a", "b")


def _phrases(s, d):
    """Documents that hold a benchmark passage whole: five of its inner words find candidates, contains decides.

    A passage's first and last word may be parts of longer ones in a document (a quote, a bracket, a full stop), so
    the key leaves them out. Passages too short for a key are looked for in every document.
    """
    toks = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    key = lambda i: F.array_join(F.slice("w", i, 5), " ")
    p = _t(s, d, "benchmark").where("text is not null").select("item_id", F.col("text").alias("phrase"), toks("text").alias("w"))
    docs = _t(s, d, "documents").select("doc_id", "text", toks("text").alias("w"))
    at = docs.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - 4)), key))).alias("k"))
    near = at.join(p.where(F.size("w") >= 7).select("item_id", "phrase", key(2).alias("k")), "k").select("doc_id", "item_id", "phrase")
    held = near.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("phrase"))).select("doc_id", "item_id")
    short = p.where(F.size("w") < 7).select("item_id", "phrase")
    n = short.limit(SHORT + 1).count()  # the short ones go to every document, broadcast as long as they are few
    if n:
        held = held.unionByName(docs.join(F.broadcast(short) if n <= SHORT else short, F.col("text").contains(F.col("phrase"))).select("doc_id", "item_id"))
    return held.distinct()


def _clip(s, d):
    # outer: an inner explode would make the optimiser run every rule twice, as a filter
    out = rules.clip_faults(_sents(s, d)).select("verdict", F.explode_outer("faults").alias("f"))
    return _n(out.select("verdict", "f.fault", "f.severity"), "verdict", "fault", "severity")


def _spoken_clips(s, d):
    """Each customer's orders speak a clip."""
    said = speech.said(s, d).groupBy(F.col("rec").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sid", "text"))).alias("x"))
    clips = said.select("id", F.transform("x", lambda x: x["text"]).alias("sents"))
    out = rules.clip_faults(clips).select("id", "verdict", F.explode_outer("faults").alias("f"))
    return out.select("id", "verdict", "f.fault", "f.severity", "f.evidence")


def _cards(s, d):
    cards = timed.chunks(_words(s, d))
    return rules.card_faults(cards.withColumn("following", F.lead("start").over(Window.partitionBy("rec").orderBy("cue", "card"))), most=3, longest=2.0).groupBy("kind").agg(F.count("*").alias("n"))


def _spoken(s, d):
    """Words of conversations with 0.7 s between turns, a change of speaker at each third one; those of every fifth have no marks."""
    own = _words(s, d).withColumns({"turn": (F.col("pos") == 0) & (F.col("cue") > 0) & (F.col("cue") % 3 == 0), "word": F.when(F.col("rec") % 5 == 0, F.regexp_replace("word", "[.?!]", "~")).otherwise(F.col("word"))})
    out = timed.spoken_sentences(own.withColumns({c: F.round(F.col(c) + F.col("cue") * 0.7, 6) for c in ("t0", "t1")}))
    return out.withColumns({c: F.round(c, 3) for c in ("start", "end")})


SPOKEN_SENTENCES = "WITH " + WORD + rf""", a AS (SELECT rec, cue, pos, CASE WHEN rec % 5 = 0 THEN regexp_replace(word, '[.?!]', '~', 'g') ELSE word END AS word, round(t0 + cue * 0.7e0, 6) AS t0, round(t1 + cue * 0.7e0, 6) AS t1, pos = 0 AND cue > 0 AND cue % 3 = 0 AS turn FROM words),
b AS (SELECT *, regexp_matches(word, '{_q(speech.X.TERMINAL)}') AS marked, lead(word) OVER o AS nw, lead(cue) OVER o AS nc, lead(t0) OVER o AS nt, lead(turn) OVER o AS nturn FROM a WINDOW o AS (PARTITION BY rec ORDER BY cue, pos)),
c AS (SELECT *, avg(marked::INT) OVER (PARTITION BY rec) >= 1e0 / 60 AS punct FROM b),
d AS (SELECT *, CASE WHEN nc IS NULL THEN 'end' WHEN nturn THEN 'turn' WHEN punct AND marked AND lower(word) NOT IN ({speech._in(speech.X.ABBREVIATIONS)}) AND (regexp_matches(word, '[?!]["'')\]”’]*$') OR regexp_matches(nw, '^["''“‘(\[]*[A-Z0-9]')) THEN 'punct'
    WHEN nc <> cue AND nt - t1 >= CASE WHEN punct THEN 1.5e0 ELSE 0.6e0 END THEN 'pause' END AS why FROM c),
e AS (SELECT *, count(why) OVER (PARTITION BY rec ORDER BY cue, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sid FROM d),
f AS (SELECT rec, sid, string_agg(word, ' ' ORDER BY cue, pos) AS text, CAST(count(*) AS INT) AS n_words, round(arg_min(t0, cue * 100000 + pos), 3) AS start, round(arg_max(t1, cue * 100000 + pos), 3) AS "end",
    arg_max(marked OR why IN ('turn', 'end') OR (NOT punct AND why = 'pause'), cue * 100000 + pos) AS clean_end, arg_min(pos, cue * 100000 + pos) > 0 AS start_estimated, arg_min(turn, cue * 100000 + pos) AS turn, arg_max(marked, cue * 100000 + pos) AS marked FROM e GROUP BY rec, sid)
SELECT rec, sid, text, n_words, start, "end", clean_end, start_estimated, CASE WHEN sid = 0 THEN 'file_start' WHEN lag(marked) OVER (PARTITION BY rec ORDER BY sid) THEN 'punctuation' WHEN turn THEN 'speaker_turn' ELSE 'pause' END AS start_boundary FROM f"""


def _sense(s, d):
    """Conversations as clips, a turn a sentence, fifteen characters a second; suspects are those of j10_misheard."""
    clips = _cues(s, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("cue", "text"))), lambda x: x["text"]).alias("sents"), (F.max("end") / 15).alias("seconds"))
    found = rules.sense(clips.withColumn("id", F.col("rec")), QUERIES["j10_misheard"][0](s, d))
    return found.select("id", "verdict", F.array_join(F.transform("faults", lambda f: f["fault"]), "; ").alias("faults"), "note")


#: Cards of four words, their ends closed over a breath, held for a while, and none over three seconds.
CARD_FAULTS = "WITH " + WORD + rf""", c0 AS (SELECT rec, cue, pos // 4 AS card, string_agg(word, ' ' ORDER BY pos) AS text, min(t0) AS s, max(t1) AS e FROM words GROUP BY rec, cue, pos // 4),
c1 AS (SELECT *, lead(s) OVER (PARTITION BY rec ORDER BY cue, card) AS nxt FROM c0), c2 AS (SELECT *, CASE WHEN nxt - e <= 0.5e0 THEN nxt ELSE e END AS closed FROM c1),
c3 AS (SELECT rec, cue, card, text, s, least(greatest(closed, least(coalesce(nxt, s + 0.55e0), s + 0.55e0)), s + 3e0) AS e FROM c2), c4 AS (SELECT *, lead(s) OVER (PARTITION BY rec ORDER BY cue, card) AS nxt FROM c3 WHERE e > s),
k AS (SELECT unnest([CASE WHEN len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 3 THEN 'word-ceiling' END, CASE WHEN e - s > 2e0 THEN 'held' END, CASE WHEN nxt < e - 0.02e0 THEN 'overlap' END,
    CASE WHEN regexp_matches(text, '{rules.FILLER}', 'i') THEN 'filler' END]) AS kind FROM c4) SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind"""
#: The k-th choice is the first range, in the order of choice, after the one before that meets none of those chosen.
GREEDY = "WITH RECURSIVE " + TAPE + ", " + LONG + """, r AS (SELECT id, s, e, floor((e - s) / 3600e0) AS score FROM lng),
c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, e - s, s) AS place FROM r),
g AS (SELECT id, s, e, score, 1 AS rank, place, [{'s': s, 'e': e}] AS kept FROM c WHERE place = 1
    UNION ALL SELECT id, s, e, score, rank + 1, place, list_append(kept, {'s': s, 'e': e}) FROM (SELECT c.*, g.rank, g.kept, row_number() OVER (PARTITION BY c.id ORDER BY c.place) AS k FROM g JOIN c ON c.id = g.id AND c.place > g.place
        WHERE g.rank < 3 AND len(list_filter(g.kept, lambda x: NOT (c.e <= x.s OR c.s >= x.e))) = 0) WHERE k = 1)
SELECT id, s, e, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM g"""


def _greedy(s, d):
    return intervals.greedy(_padded(s, d).withColumn("score", F.floor((F.col("e") - F.col("s")) / HOUR)))


def _best_end(s, d):
    """For each session the best later end within two days: most events, then shorter."""
    t = _tape(s, d)
    later = t.select("id", F.col("s").alias("s2"), F.col("e").alias("e2"))
    runs = t.join(later, "id").where(f"s2 >= s and e2 - s <= {2 * DAY}").groupBy("id", "s", "e2").agg(F.first("n").alias("n0"), F.count("*").alias("k"))
    upto = Window.partitionBy("id", "s").orderBy("e2")
    runs = runs.withColumn("score", F.count("*").over(upto) * 10 - F.floor((F.col("e2") - F.col("s")) / HOUR))
    pick = F.row_number().over(Window.partitionBy("id", "s").orderBy(F.desc("score"), F.col("e2") - F.col("s")))
    return runs.withColumn("r", pick).where("r = 1").select("id", "s", F.col("e2").alias("e"), "score")


def _sentence_runs(s, d):
    return timed.sentences(_words(s, d)).select("rec", "sid", "n_words", "start", "end")


def _most_common(s, d):
    w = _t(s, d, "documents").select("doc_id", F.lower(F.get(X.tokens(F.col("text")), F.lit(0))).alias("word")).where("word is not null")
    return w.groupBy("word").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(10)


def _carry(s, d):
    docs, lab = _t(s, d, "documents"), _t(s, d, "labels")
    return docs.join(lab, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.coalesce("quality", F.lit(0))).cast("bigint").alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))


def _round_trip(s, d):
    """Cues written as SRT text and parsed again."""
    return transcripts.srt(transcripts.to_srt(_cues(s, d).withColumn("text", F.regexp_replace("text", r"\s*\n\s*", " ")))).groupBy("rec").agg(F.count("*").alias("cues"), F.max("end").alias("end"))


def _stream_folder(s) -> str:
    import tempfile
    import uuid

    root = s.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not s.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp()
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(s, d):
    """The tumbling counts by a streaming run over the file, all batches taken at once."""
    from ..streaming import events

    return events.drained(events.tumbling(events.source(s, f"{d}/events.parquet")), "complete", _stream_folder(s)).drop("batch")


def _running(s, d):
    """Each user's events and sum of values so far, as the state stands after the last batch."""
    from ..streaming import events

    out = events.drained(events.running(events.source(s, f"{d}/events.parquet")), "update", _stream_folder(s))
    return out.groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "batch").alias("x")).select("user_id", "x.n", F.round("x.total", 6).alias("total"))


def _session(s, d):
    from ..streaming import events

    return events.sessions(_t(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


QUERIES = {
    "w1_winners": (lambda s, d: cohort.winners(_videos(s, d)).select("id", "format", "winner"), "WITH " + MARK + " SELECT id, format, winner FROM m"),
    "a2_hook_lift": (lambda s, d: cohort.shape_rates(cohort.winners(_videos(s, d))), LIFT),
    "a4_over_represented": (
        _over,
        "WITH " + MARK + f""",
        p AS (SELECT id, winner, regexp_extract_all(lower(title), '[a-z'']+') AS ws,
            list_transform(regexp_extract_all(regexp_replace(title, '([a-z,]) ', '\\1 ~', 'g'), '~([A-Z][a-z]{{2,}})', 1), lambda x: lower(x)) AS proper FROM m),
        wd AS (SELECT DISTINCT id, winner, unnest(list_filter(ws, lambda w: NOT list_contains(proper, w))) AS word FROM p),
        dw AS (SELECT * FROM wd WHERE length(word) > 2 AND word NOT IN ({', '.join(repr(w) for w in STOP)})),
        t AS (SELECT greatest(1, count(*) FILTER (winner)) AS tw, greatest(1, count(*) FILTER (NOT winner)) AS tr FROM dw),
        k AS (SELECT word, count(*) FILTER (winner) AS in_winners, count(*) FILTER (NOT winner) AS in_rest FROM dw GROUP BY word HAVING count(*) FILTER (winner) >= 3)
        SELECT word, in_winners, round(ln(((in_winners + 1) / tw) / ((in_rest + 1) / tr)), 2) AS lift FROM k, t ORDER BY lift DESC, in_winners DESC, word DESC LIMIT 12""",
    ),
    "a5_profile": (lambda s, d: cohort.profile(_videos(s, d)), "WITH " + MARK + ", j AS (SELECT v.*, m.winner FROM v LEFT JOIN m USING (id)) SELECT count(*) AS videos, count(*) FILTER (winner) AS winners, count(*) FILTER (winner IS NULL) AS dropped, count(*) >= 25 AS confident, quantile_cont(views, 0.5) AS median_all, quantile_cont(views, 0.5) FILTER (winner) AS median_winners FROM j"),
    "a6_quantiles": (lambda s, d: cohort.quantiles(_t(s, d, "documents"), "lang", "n_chars"), "SELECT lang, " + ", ".join(f"quantile_cont(n_chars, {p / 100}) AS p{p}" for p in (10, 25, 50, 75, 90)) + ", min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY lang"),
    "a15_percentile": (_percentile, "SELECT doc_id, CAST(floor(100 * cume_dist() OVER (PARTITION BY lang ORDER BY n_chars) + 0.5e0) AS BIGINT) AS percentile FROM documents"),
    "a9_most_common": (_most_common, r"WITH w AS (SELECT doc_id, lower(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')[1]) AS word FROM documents) SELECT word, count(*) AS n, min(doc_id) AS first_seen FROM w WHERE word IS NOT NULL GROUP BY word ORDER BY n DESC, first_seen LIMIT 10"),
    "a10_contractions": (lambda s, d: _t(s, d, "conversations").groupBy("role").agg(F.sum(F.regexp_count(F.lower("text"), F.lit("[a-z]+'(t|re|ve|ll|d|m|s)"))).cast("bigint").alias("contracted"), F.sum(F.regexp_count(F.lower("text"), F.lit("(^| )(is|are|will|have|had|would|not)( |$)"))).cast("bigint").alias("long")), "SELECT role, CAST(sum(len(regexp_extract_all(lower(text), '[a-z]+''(t|re|ve|ll|d|m|s)'))) AS BIGINT) AS contracted, CAST(sum(len(regexp_extract_all(lower(text), '(^| )(is|are|will|have|had|would|not)( |$)'))) AS BIGINT) AS long FROM conversations GROUP BY role"),
    "a11_idf": (lambda s, d: similarity.idf(_terms(s, d)).select("term", "df", F.round("idf", 9).alias("idf")), "WITH " + TERM + " SELECT term, df, round(idf, 9) AS idf FROM df"),
    "m1_cosine": (lambda s, d: similarity.pairs(_terms(s, d)).select("id_a", "id_b", "shared", *[F.round(c, 6).alias(c) for c in ("cosine", "dominance", "containment")]), "WITH " + TERM + " SELECT a.id AS id_a, b.id AS id_b, count(*) AS shared, round(sum(a.v * b.v) / sqrt(any_value(x.n2) * any_value(y.n2)), 6) AS cosine, round(max(a.v * b.v) / sum(a.v * b.v), 6) AS dominance, round(sum(a.v * b.v) / CASE WHEN any_value(x.k) <= any_value(y.k) THEN any_value(x.n2) ELSE any_value(y.n2) END, 6) AS containment FROM ve a JOIN ve b ON a.term = b.term AND a.id < b.id JOIN nv x ON x.id = a.id JOIN nv y ON y.id = b.id GROUP BY a.id, b.id"),
    "w2_word_times": (_words, "WITH " + WORD + " SELECT rec, cue, pos, word, t0, t1 FROM words"),
    "w4_sentences": (_sentence_runs, "WITH " + WORD + r", g AS (SELECT *, CASE WHEN regexp_matches(word, '[.!?]$') OR coalesce(lead(t0) OVER o - t1 >= 1.5e0 AND lead(cue) OVER o <> cue, true) THEN 1 ELSE 0 END AS cut FROM words WINDOW o AS (PARTITION BY rec ORDER BY cue, pos)), k AS (SELECT *, coalesce(sum(cut) OVER (PARTITION BY rec ORDER BY cue, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM g) SELECT rec, CAST(sid AS BIGINT) AS sid, count(*) AS n_words, min(t0) AS start, max(t1) AS ""end"" FROM k GROUP BY rec, sid".replace('""', '"')),
    "w6_silences": (lambda s, d: timed.silences(_cues(s, d).where("role <> 'assistant'"), 40.0), "WITH " + CUE + ", g AS (SELECT rec, cue, s - lag(e) OVER (PARTITION BY rec ORDER BY cue) AS gap FROM cues WHERE role <> 'assistant') SELECT rec, cue, gap FROM g WHERE gap >= 40"),
    "w9_stutters": (lambda s, d: timed.stutters(_words(s, d)), "WITH " + WORD + ", b AS (SELECT *, lower(regexp_replace(word, '^[^A-Za-z0-9'']+|[^A-Za-z0-9'']+$', '', 'g')) AS bare FROM words), l AS (SELECT *, lag(bare) OVER (PARTITION BY rec ORDER BY cue, pos) AS pb, lag(t1) OVER (PARTITION BY rec ORDER BY cue, pos) AS pt FROM b) SELECT rec, cue, pos, word FROM l WHERE bare = pb AND bare <> '' AND t0 - pt < 0.6e0"),
    "w15_edit_clock": (lambda s, d: timed.edit_clock(_tape(s, d).select(F.col("id").alias("piece"), F.col("s").alias("ord"), F.col("s").alias("start"), F.col("e").alias("end"))).select("piece", "start", "base"), "WITH " + TAPE + " SELECT id AS piece, s AS start, coalesce(sum(e - s) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS base FROM tape"),
    "w5_sessions": (lambda s, d: _tape(s, d), "WITH " + TAPE + " SELECT id, s, e, n FROM tape"),
    "w21_ngrams": (lambda s, d: _n(_words(s, d).withColumn("gram", F.concat_ws(" ", F.lower("word"), F.lower(F.lead("word").over(Window.partitionBy("rec", "cue").orderBy("pos"))))).where("gram like '% %'"), "gram"), "WITH " + WORD + ", g AS (SELECT lower(word) || ' ' || lower(lead(word) OVER (PARTITION BY rec, cue ORDER BY pos)) AS gram FROM words) SELECT gram, count(*) AS n FROM g WHERE gram IS NOT NULL GROUP BY gram"),
    "w25_islands": (lambda s, d: intervals.islands(_padded(s, d)), "WITH " + TAPE + ", " + ISLE + " SELECT id, s, e FROM isle"),
    "u3_subtract": (lambda s, d: intervals.gaps(_month(s, d), _padded(s, d)), "WITH " + TAPE + ", " + ISLE + ", sp AS (SELECT u AS id, min(t) AS lo, max(t) AS hi FROM ev GROUP BY u), cl AS (SELECT id, greatest(s, lo) AS s, least(e, hi) AS e, lo, hi FROM isle JOIN sp USING (id) WHERE least(e, hi) > greatest(s, lo)), lf AS (SELECT id, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), lo) AS s, s AS e FROM cl), al AS (SELECT * FROM lf UNION ALL SELECT id, max(e), max(hi) FROM cl GROUP BY id UNION ALL SELECT id, lo, hi FROM sp WHERE id NOT IN (SELECT id FROM cl)) SELECT id, s, e FROM al WHERE e > s"),
    "u4_intersect": (_intersect_all, "WITH " + TAPE + ", " + ISLE + ", mo AS (SELECT u AS id, min(t) AS s, max(t) AS e FROM ev GROUP BY u) SELECT m.id AS id_b, count(*) AS parts, sum(least(a.e, m.e) - greatest(a.s, m.s)) AS seconds FROM isle a JOIN mo m ON a.s < m.e AND m.s < a.e GROUP BY m.id"),
    "j1_shared_tape": (lambda s, d: intervals.shared(_tape(s, d).select("id", "s", "e"), 4 * HOUR).where("seconds > 1.0"), "WITH " + TAPE + " SELECT a.id AS id_a, b.id AS id_b, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS seconds, count(*) AS parts, max(least(a.e, b.e) - greatest(a.s, b.s)) AS longest FROM tape a JOIN tape b ON a.id < b.id AND a.s < b.e AND b.s < a.e GROUP BY ALL HAVING sum(least(a.e, b.e) - greatest(a.s, b.s)) > 1.0"),
    "j2_unmerged": (lambda s, d: intervals.shared(_padded(s, d), 8 * HOUR, merge=False).where("seconds >= 10.0"), "WITH " + TAPE + ", " + LONG + " SELECT a.id AS id_a, b.id AS id_b, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS seconds, count(*) AS parts, max(least(a.e, b.e) - greatest(a.s, b.s)) AS longest FROM lng a JOIN lng b ON a.id < b.id AND a.s < b.e AND b.s < a.e GROUP BY ALL HAVING sum(least(a.e, b.e) - greatest(a.s, b.s)) >= 10.0"),
    "j4_forbidden_ranges": (lambda s, d: intervals.without(_events(s, d).select(F.col("event").alias("id"), (F.col("t") - 60).alias("s"), (F.col("t") + 60).alias("e")), _tape(s, d).where("n >= 5").select("id", "s", "e"), HOUR).select("id"), "WITH " + TAPE + " SELECT event_id AS id FROM ev WHERE NOT EXISTS (SELECT 1 FROM tape f WHERE f.n >= 5 AND t - 60 < f.e AND f.s < t + 60)"),
    "j5_forbidden_phrases": (_phrases, "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)"),
    "j6_point_in_interval": (_locate_all, "WITH " + TAPE + ", f AS (SELECT row_number() OVER (ORDER BY s, id) AS ord, s, e FROM tape), h AS (SELECT event_id AS p, ord, t - s AS \"at\", row_number() OVER (PARTITION BY event_id ORDER BY ord) AS r FROM ev JOIN f ON t >= s AND t <= e) SELECT p, ord, \"at\" FROM h WHERE r = 1"),
    "j12_keyword_prefix": (
        _prefix,
        """WITH a AS (SELECT p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_name, p_brand)), '[a-z'']+')) AS a FROM part),
        b AS (SELECT p_partkey, unnest(regexp_extract_all(lower(concat_ws(' ', p_type, p_brand)), '[a-z'']+')) AS b FROM part)
        SELECT DISTINCT p_partkey, a, b FROM a JOIN b USING (p_partkey)
        WHERE length(a) >= 2 AND (a = b OR (length(a) >= 4 AND length(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a))))""",
    ),
    "j13_carry_labels": (_carry, "SELECT lang, count(*) AS n, CAST(sum(coalesce(quality, 0)) AS BIGINT) AS good, count(*) FILTER (quality IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang"),
    "j17_band_join": (_band, "WITH " + WORD + ' SELECT c.rec, c.e AS cut, count(*) FILTER ((t0 + t1) / 2 <= c.e) AS before, count(*) FILTER ((t0 + t1) / 2 > c.e) AS after FROM cues c JOIN words w ON c.rec = w.rec AND (t0 + t1) / 2 BETWEEN c.e - 20 AND c.e + 20 GROUP BY c.rec, c.e'),
    "j20_unrendered": (
        lambda s, d: _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "source"),
        "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)",
    ),
    "a23_coverage": (_coverage, "WITH " + TAPE + ", " + ISLE + " SELECT id, sum(e - s) AS covered, count(*) AS parts, max(e) - min(s) AS extent FROM isle GROUP BY id"),
    "a24_upper_median": (_upper_median, "SELECT source, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median FROM documents GROUP BY source"),
    "t2_best_end": (_best_end, "WITH " + TAPE + f", r AS (SELECT DISTINCT a.id, a.s, b.e AS e2 FROM tape a JOIN tape b ON a.id = b.id AND b.s >= a.s AND b.e - a.s <= {2 * DAY}), sc AS (SELECT *, CAST(count(*) OVER (PARTITION BY id, s ORDER BY e2) * 10 - floor((e2 - s) / {HOUR}) AS BIGINT) AS score FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY id, s ORDER BY score DESC, e2 - s) AS k FROM sc) SELECT id, s, e2 AS e, score FROM p WHERE k = 1"),
    "g1_clip_faults": (_clip, f"WITH {SENT}, clips AS (SELECT id, sents FROM sn), {speech.CLIP_RULES} SELECT verdict, fault, severity, count(*) AS n FROM faulted GROUP BY ALL"),
    "g1_spoken_clips": (_spoken_clips, f"WITH {speech.SAID}, clips AS (SELECT rec AS id, list(text ORDER BY sid) AS sents FROM said GROUP BY rec), {speech.CLIP_RULES} SELECT id, verdict, fault, severity, evidence FROM faulted"),
    "w4_spoken_sentences": (_spoken, SPOKEN_SENTENCES),
    "g1_sense": (_sense, None),
    "g5_card_faults": (_cards, CARD_FAULTS),
    "t3_greedy_ranges": (_greedy, GREEDY),
    "w11_group_cards": (lambda s, d: timed.group_cards(_words(s, d)), None),
    "j10_misheard": (lambda s, d: similarity.misheard(_words(s, d).withColumn("pos", F.row_number().over(Window.partitionBy("rec").orderBy("cue", "pos")))), None),
    "k1_srt_round_trip": (_round_trip, "WITH " + CUE + ' SELECT rec, count(*) AS cues, max(e) AS "end" FROM cues WHERE e > s GROUP BY rec'),
    "stream_tumbling": (_stream, "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL"),
    "stream_running": (_running, "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE user_id IS NOT NULL GROUP BY user_id"),
    "stream_sessions": (_session, "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL '4 hours' THEN 0 ELSE 1 END AS new FROM events) SELECT user_id, CAST(sum(new) AS BIGINT) AS sessions, count(*) AS events FROM e GROUP BY user_id"),
    "p11_has_sentence": (lambda s, d: _t(s, d, "documents").select("doc_id", X.has_sentence(F.col("text")).alias("ok"), X.is_noise(F.col("text")).alias("noise")), f"SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '#[A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z'']{{2,}}')) >= 3 AS ok, regexp_matches(text, '{X.NOISE}', 'i') OR (len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) >= 3 AND len(regexp_extract_all(regexp_replace(text, '#[A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z'']+')) <= 6) AS noise FROM documents"),
    "f24_slugs": (lambda s, d: _t(s, d, "part").select("p_partkey", X.slug(F.concat_ws(" ", "p_name", "p_brand")).alias("slug")), "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"),
    "f6_timecodes": (
        lambda s, d: _t(s, d, "events").select("event_id", X.timecode(F.abs("value") * 70).alias("timecode"), X.snip(F.concat_ws(" ", "event_type", F.col("ts").cast("date").cast("string"), "props"), 24).alias("snip")),
        """WITH v AS (SELECT event_id, abs(value) * 70 AS v, trim(concat_ws(' ', event_type, CAST(CAST(ts AS DATE) AS VARCHAR), props)) AS t FROM events)
        SELECT event_id, CASE WHEN v >= 3600 THEN CAST(CAST(floor(v / 3600) AS INT) AS VARCHAR) || ':' ELSE '' END || lpad(CAST(CAST(floor(v / 60) AS INT) % 60 AS VARCHAR), 2, '0') || ':' || printf('%04.1f', v % 60) AS timecode,
            CASE WHEN length(t) <= 24 THEN t ELSE rtrim(t[1:23]) || '...' END AS snip FROM v""",
    ),
    "m7_bitrate": (lambda s, d: _t(s, d, "part").select("p_partkey", F.round(X.bitrate(F.col("p_size") * 40.0, F.lit(1080.0), F.col("p_size").cast("double")), 6).alias("mbit")), "SELECT p_partkey, round(greatest(2e0, least(60e0, 12e0 * p_size * 40 * 1080 / (1080e0 * 1920) * pow(2e0, (18 - p_size) / 6e0))), 6) AS mbit FROM part"),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()} | speech.queries() | captions.queries() | reels.queries() | naming.queries() | profiles.queries() | planning.QUERIES | cards.queries() | files.queries() | making.queries() | voices.queries()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql} | speech.oracle_sql() | captions.oracle_sql() | reels.oracle_sql() | naming.oracle_sql() | profiles.oracle_sql() | cards.oracle_sql() | files.oracle_sql() | making.oracle_sql() | voices.oracle_sql()
