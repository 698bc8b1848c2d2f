"""Queries over cards held against their recordings. Stand-ins: a customer's spoken sentences (plans.speech) are a
recording; its piece plays seconds 60 to 120 first and 5 to 45 after; each sentence that starts there gives
one card, some of its words, on the finished clock."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import captions as C
from ..functions.speech import split_words
from ..operators import cardcheck, sequences, timed
from . import planning, speech
from .captions import TOKS
from .files import CARDS_SQL
from .speech import FEATURES, SAID, _in, _timed_sql

PLAYED = [(60.0, 120.0), (5.0, 45.0)]


def said(s, d):
    return speech.timed(s, d).select("rec", F.col("n").cast("long").alias("n"), "text", "start", "end")


def segments(s, d):
    played = F.posexplode(F.array(*[F.struct(F.lit(a).alias("s"), F.lit(b).alias("e")) for a, b in PLAYED])).alias("ord", "x")
    return said(s, d).select(F.col("rec").alias("piece")).distinct().select("piece", played).select("piece", (F.col("ord") + 1).alias("ord"), "x.*")


def cards(s, d):
    """piece, rec, card, text, start, end: words 1 to 8 of a sentence, from the second, third or first one on, by its number."""
    clock = timed.edit_clock(segments(s, d).select("piece", "ord", F.col("s").alias("start"), F.col("e").alias("end")))
    clock = clock.select(F.col("piece").alias("rec"), F.col("start").alias("p0"), F.col("end").alias("p1"), "base")
    met = said(s, d).join(clock, "rec").where("start >= p0 and start < p1")
    cut = F.slice(split_words(F.col("text")), (F.col("n") % 3 + 1).cast("int"), (F.col("n") % 5 + 4).cast("int"))
    at = F.col("base") + F.col("start") - F.col("p0")
    return met.select(F.col("rec").alias("piece"), "rec", F.col("n").cast("int").alias("card"), F.array_join(cut, " ").alias("text"), at.alias("start"), (at + F.col("end") - F.col("start")).alias("end")).where("text <> ''")


def pieces(s, d):
    total = sum(b - a for a, b in PLAYED)
    return cards(s, d).groupBy("piece").agg(F.min_by("text", "start").alias("hook")).select("piece", F.lit(total).alias("duration"), "hook")


def errors(s, d):
    return s.createDataFrame([("show notes", "shown oats"), ("xyz", "excise"), ("kind of", "kinds of")], "heard string, said string")


def _placed(s, d):
    return cardcheck.placed(cardcheck.tokenised(cards(s, d)), segments(s, d), cardcheck.lines(said(s, d)))


def neighbours(s, d):
    """id (rec, n), a, b: the words of each sentence of a document and of the one after it."""
    # they stand side by side in their document already; a number of its own, for their looking costs more than their bytes
    n = int(s.conf.get("spark.sql.shuffle.partitions"))
    docs = planning.split_documents(s, d).repartition(n, "rec").select("rec", F.transform("sents", lambda x: C.tokens(x)).alias("t"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("t") - 2), lambda i: F.struct(i.alias("n"), F.get("t", i).alias("a"), F.get("t", i + 1).alias("b")))
    own = docs.where(F.size("t") > 1).select("rec", F.explode(pairs).alias("x"))
    return own.select(F.struct("rec", "x.n").alias("id"), "x.a", "x.b")


def _long_lines(s, d):
    """Three spoken sentences in a row as one line each, so that phrases come again."""
    w = Window.partitionBy("rec").orderBy("n")
    joined = F.concat_ws(", ", "text", F.lead("text", 1).over(w), F.lead("text", 2).over(w))
    return said(s, d).select("rec", "n", C.tokens(joined).alias("tokens"))


def _edited(s, d):
    """Cards as an editor left them: each fourth loses its first word, each seventh is gone, each ninth has one more behind it, all start later."""
    own = cards(s, d).withColumn("start", F.col("start") + 0.25)
    less = F.array_join(F.slice(split_words(F.col("text")), 2, 20), " ")
    kept = own.where("card % 7 <> 3").withColumn("text", F.when(F.col("card") % 4 == 1, less).otherwise(F.col("text")))
    more = own.where("card % 9 = 2").select("piece", "rec", (F.col("card") + 1000).alias("card"), F.lit("something else entirely").alias("text"), (F.col("start") + 0.5).alias("start"), "end")
    return kept.unionByName(more.withColumn("card", F.col("card").cast("int")))


def _lined(s, d):
    return sequences.line_up(cards(s, d), _edited(s, d))


CARD_SQL = f"""WITH {SAID}, {FEATURES}, {_timed_sql}, seg(ord, p0, p1, base) AS (VALUES (1, 60e0, 120e0, 0e0), (2, 5e0, 45e0, 60e0)),
crd AS (SELECT * FROM (SELECT rec AS piece, rec, CAST(n AS INT) AS card, array_to_string(ws[n % 3 + 1:n % 3 + n % 5 + 4], ' ') AS text, base + s - p0 AS cs, base + s - p0 + e - s AS ce FROM sn, seg WHERE s >= p0 AND s < p1) WHERE text <> ''),
ct AS (SELECT *, {TOKS("text")} AS own FROM crd), lt AS (SELECT rec, n, s, e, {TOKS("text")} AS line FROM sn),
win AS (SELECT ct.*, p0 + greatest(0e0, cs - base) AS a, p0 + least(p1 - p0, ce - base) AS b FROM ct, seg WHERE ce > base AND cs < base + p1 - p0)"""
QUERIES = {
    "j8_best_sentence": (
        lambda s, d: _placed(s, d).select("piece", "card", "n", F.round("score", 6).alias("score")),
        CARD_SQL + """, pool AS (SELECT DISTINCT piece, card, own, n, line FROM win JOIN lt USING (rec) WHERE e > a AND s < b),
        r AS (SELECT *, CASE WHEN len(own) = 0 THEN 0e0 ELSE len(list_filter(own, lambda t: list_contains(line, t))) / len(own) END AS score FROM pool),
        b AS (SELECT *, row_number() OVER (PARTITION BY piece, card ORDER BY round(score, 9) DESC, n) AS k FROM r) SELECT piece, card, n, round(score, 6) AS score FROM b WHERE k = 1""",
    ),
    "f18_scope": (lambda s, d: _placed(s, d).select("piece", "card", F.col("scope.window.text").alias("window"), F.col("scope.prev.text").alias("prev"), F.col("scope.score").alias("clause_score")), None),
    "g4_meaning": (lambda s, d: cardcheck.meaning(_placed(s, d), strict=True), None),
    "g5_mechanics": (lambda s, d: cardcheck.mechanics(cardcheck.tokenised(cards(s, d)), pieces(s, d), errors(s, d)), None),
    "g6_checked_cards": (lambda s, d: cardcheck.check(cards(s, d), segments(s, d), said(s, d), pieces(s, d), errors(s, d)), None),
    "w22_said_twice": (
        lambda s, d: cardcheck.said_twice(_long_lines(s, d)).select("rec", "n", F.array_join("pair.phrase", " ").alias("phrase"), F.array_join(F.transform("pair.tails", lambda t: F.array_join(t, " ")), "; ").alias("tails")),
        f"""WITH {SAID}, {FEATURES}, {_timed_sql}, l AS (SELECT rec, n, {TOKS("concat_ws(', ', text, lead(text) OVER w, lead(text, 2) OVER w)")} AS t FROM sn WINDOW w AS (PARTITION BY rec ORDER BY n)),
        g AS (SELECT rec, n, k, i, t[i + 1:i + k] AS gram, list_filter(t[i + k + 1:i + k + 5], lambda x: x NOT IN ({_in(C.TAIL_STOP)}) AND length(x) > 2)[1:3] AS tail FROM l, range(3, 9) AS ks(k), range(0, 200) AS ix(i) WHERE k <= len(t) / 2 AND i + k <= len(t)),
        m AS (SELECT rec, n, k, gram, list([{{'i': i, 'tail': tail}}] ORDER BY i) AS seen FROM g WHERE len(list_filter(gram, lambda x: x IN ({_in(C.NEGATION)}) OR ends_with(x, 'n''t'))) > 0 GROUP BY rec, n, k, gram HAVING count(*) > 1),
        a AS (SELECT rec, n, k, gram, list_reduce(seen, lambda x, y: CASE WHEN y[1].i - x[-1].i >= k THEN list_concat(x, y) ELSE x END) AS seen FROM m),
        b AS (SELECT *, list_filter(list_transform(seen, lambda x: x.tail), lambda x: len(x) > 0) AS tails FROM a),
        c AS (SELECT *, row_number() OVER (PARTITION BY rec, n ORDER BY k DESC, seen[1].i) AS r FROM b WHERE len(tails) > 1 AND len(list_distinct(tails)) > 1)
        SELECT rec, n, array_to_string(gram, ' ') AS phrase, array_to_string(list_transform(tails, lambda x: array_to_string(x, ' ')), '; ') AS tails FROM c WHERE r = 1""",
    ),
    "m5_longest_run": (
        lambda s, d: sequences.longest_runs(neighbours(s, d)).select("id.rec", "id.n", "size", "at_a", "at_b"),
        CARDS_SQL + f""", p AS (SELECT doc_id AS rec, card - 1 AS n, {TOKS("text")} AS a, lead({TOKS("text")}) OVER (PARTITION BY doc_id ORDER BY card) AS b FROM c),
        x AS (SELECT rec, n, unnest(a) AS w, unnest(range(len(a))) AS p FROM p WHERE b IS NOT NULL), y AS (SELECT rec, n, unnest(b) AS w, unnest(range(len(b))) AS q FROM p WHERE b IS NOT NULL),
        m AS (SELECT rec, n, p, p - q AS d FROM x JOIN y USING (rec, n, w)), i AS (SELECT *, p - row_number() OVER (PARTITION BY rec, n, d ORDER BY p) AS g FROM m),
        u AS (SELECT rec, n, d, count(*) AS size, min(p) AS p FROM i GROUP BY rec, n, d, g), v AS (SELECT *, row_number() OVER (PARTITION BY rec, n ORDER BY size DESC, p, p - d) AS r FROM u)
        SELECT p.rec, p.n, coalesce(v.size, 0) AS size, v.p AS at_a, v.p - v.d AS at_b FROM p LEFT JOIN v ON v.rec = p.rec AND v.n = p.n AND v.r = 1 WHERE p.b IS NOT NULL""",
    ),
    "m6_edits": (lambda s, d: sequences.edits(neighbours(s, d)).select("id.rec", "id.n", F.round("ratio", 6).alias("ratio"), F.explode("ops").alias("op")).select("rec", "n", "ratio", "op.*"), None),
    "m6_lined_up": (_lined, None),
    "a21_scorecard": (lambda s, d: sequences.scorecard(_lined(s, d), cards(s, d), _edited(s, d)), None),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
