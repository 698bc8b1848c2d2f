"""Cards held against what was said: does a card, read alone and without sound, say what the recording says?

A card (piece, rec, card, text, start, end) lies on the finished clock of its piece. Its source windows follow from
the piece's segments; the sentence that it came from is the one inside them that shares most of its words; the
scope is the run of one to three clauses of that sentence that does so. What governs the scope and is not on the
card makes a finding. Lines: rec, n, text, start, end.

Findings: piece, card, kind, level (blocker, review, note) and evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions as C
from . import reels

MATCH_MIN, CLAUSE_MIN, NEIGHBOUR, LOOKBACK, PAIR_LEAST, PAIR_MOST = 0.5, 0.5, 1.2, 2, 3, 8
MOST_WORDS, TOUCHING, RESTATED = 7, 0.02, 0.85
_words = lambda text: F.regexp_extract_all(text, F.lit("[a-z0-9$']+"), F.lit(0))  # noqa: E731  of flat text
_set = lambda values: lambda t: t.isin(values)


def share(card: Column, line: Column) -> Column:
    """The share of the card's tokens that the line's tokens hold."""
    return F.when(F.size(card) == 0, 0.0).otherwise(F.size(F.filter(card, lambda t: F.array_contains(line, t))) / F.size(card))


def lead(clause: Column) -> Column:
    """The first of a clause's tokens after up to two that only join; '' where none is left."""
    glue = _set(C.COORDINATION)
    one, two, three = (F.get(clause, F.lit(i)) for i in range(3))
    return F.coalesce(F.when(~glue(one), one).when(~glue(two), two).when(glue(two), three), F.lit(""))


def scope(card: Column, clauses: Column) -> Column:
    """The run of one to three clauses that shares most of the card's tokens: window, prev (the clause before it) and score.

    card: tokens; clauses: array of (text, tokens). Fewer clauses win a tie, then the earlier ones. window and
    prev are (text, tokens); prev is null at the start.
    """
    n_all = F.size(clauses)
    runs = F.flatten(F.transform(F.array(*[F.lit(n) for n in (1, 2, 3)]), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(n_all - n, F.lit(0))), lambda i: F.struct(n.alias("n"), i.alias("i")))))
    rated = F.transform(runs, lambda r: F.struct(F.round(share(card, F.flatten(F.slice(clauses, r["i"] + 1, r["n"])["tokens"])), 9).alias("score"), (-r["n"]).alias("n"), (-r["i"]).alias("i")))
    best = F.array_max(rated)
    run = lambda b: F.slice(clauses, 1 - b["i"], -b["n"])
    window = lambda b: F.struct(F.array_join(run(b)["text"], " ").alias("text"), F.flatten(run(b)["tokens"]).alias("tokens"))
    # one array element: the argmax is looked for once
    return F.get(F.transform(F.array(best), lambda b: F.struct(b["score"].alias("score"), window(b).alias("window"), F.get(clauses, -b["i"] - 1).alias("prev"))), F.lit(0))


def lines(sentences: DataFrame) -> DataFrame:
    """Lines (rec, n, text, start, end) with tokens, clauses, the nearest quoting line of the two before, and the phrase said twice.

    voice: text; pair: (phrase tokens, tails), see said_twice.
    """
    w = Window.partitionBy("rec").orderBy("n")
    flat = C.clauses(F.col("text"))
    own = sentences.withColumns({"tokens": C.tokens(F.col("text")), "clauses": F.transform(flat, lambda c: F.struct(c.alias("text"), _words(c).alias("tokens"))), "voiced": C.voiced(F.col("text"))})
    near = F.coalesce(*[F.when(F.lag("voiced", k).over(w), F.lag("text", k).over(w)) for k in range(1, LOOKBACK + 1)])
    return own.withColumn("voice", near).drop("voiced").join(said_twice(own.select("rec", "n", "tokens")), ["rec", "n"], "left")


def said_twice(sentences: DataFrame) -> DataFrame:
    """rec, n, pair: the longest phrase (3 to 8 words, with a negation) that a sentence says twice and ends in different ways.

    pair: phrase and tails, both token arrays: of each place the first three words that carry it on. Of phrases of
    one length the one that begins first wins; places overlap in no case. Only sentences with a negation twice are
    taken apart, so the work grows with their words.
    """
    again = F.filter("tokens", C.is_negation)
    twice = sentences.where(F.size(again) > F.size(F.array_distinct(again)))
    sized = twice.withColumn("k", F.explode(F.sequence(F.lit(PAIR_LEAST), F.lit(PAIR_MOST)))).where(F.col("k") <= F.size("tokens") / 2)
    placed = sized.select("rec", "n", "k", "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - F.col("k"))).alias("i"))
    tail = F.slice(F.filter(F.expr("slice(tokens, i + k + 1, 5)"), lambda t: ~t.isin(C.TAIL_STOP) & (F.length(t) > 2)), 1, 3)
    grams = placed.select("rec", "n", "k", "i", F.expr("slice(tokens, i + 1, k)").alias("gram"), tail.alias("tail")).where(F.exists("gram", C.is_negation))
    met = grams.groupBy("rec", "n", "k", "gram").agg(F.sort_array(F.collect_list(F.struct("i", "tail"))).alias("at")).where(F.size("at") > 1)
    apart = F.aggregate("at", F.slice("at", 1, 1), lambda a, x: F.when(x["i"] - F.element_at(a, -1)["i"] >= F.col("k"), F.concat(a, F.array(x))).otherwise(a))
    tails = F.filter(F.transform(apart, lambda x: x["tail"]), lambda t: F.size(t) > 0)
    held = met.withColumn("tails", tails).where((F.size("tails") > 1) & (F.size(F.array_distinct("tails")) > 1))
    first = F.max_by(F.struct(F.col("gram").alias("phrase"), "tails"), F.struct("k", -F.col("at")[0]["i"]))
    return held.groupBy("rec", "n").agg(first.alias("pair"))


def windows(cards: DataFrame, segments: DataFrame) -> DataFrame:
    """piece, card, rec, s, e: where in the recording a card lies; its own times where no segment is met. Cards without a start have none."""
    timed = cards.where("start is not null").select("piece", "card", "rec", F.col("start").alias("cs"), F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("start") + 0.1).alias("ce"))
    met = reels.source_windows(timed, segments)
    keys = timed.select("piece", "card", "rec")
    own = timed.join(met, ["piece", "card"], "left_anti").select("piece", "card", "rec", F.col("cs").alias("s"), F.col("ce").alias("e"))
    return met.join(keys, ["piece", "card"]).select("piece", "card", "rec", "s", "e").unionByName(own)


def sources(cards: DataFrame, segments: DataFrame, said: DataFrame, width: float = 30.0) -> DataFrame:
    """piece, card, n, score: the line inside the card's windows that shares most of its words; of all lines of its recording where none lies there.

    Windows and lines meet by recording and by slots of `width` seconds. cards: with tokens; said: of lines().
    """
    slots = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(s, e) / width)))
    asked = windows(cards, segments).select("piece", "card", "rec", "s", "e", slots("s", "e").alias("slot"))
    there = said.select("rec", "n", F.col("start").alias("ls"), F.col("end").alias("le"), slots("start", "end").alias("slot"))
    inside = asked.join(there, ["rec", "slot"]).where("le > s and ls < e").select("piece", "card", "rec", "n").distinct()
    own = asked.select("piece", "card", "rec").distinct()
    lost = own.join(inside, ["piece", "card"], "left_anti").join(said.select("rec", "n"), "rec").select("piece", "card", "rec", "n")
    pool = inside.unionByName(lost)
    rated = pool.join(cards.select("piece", "card", F.col("tokens").alias("own")), ["piece", "card"]).join(said.select("rec", "n", "tokens"), ["rec", "n"])
    best = F.max(F.struct(F.round(share(F.col("own"), F.col("tokens")), 9).alias("score"), (-F.col("n")).alias("n")))
    return rated.groupBy("piece", "card").agg(best.alias("b")).select("piece", "card", (-F.col("b.n")).alias("n"), F.col("b.score").alias("score"))


def tokenised(cards: DataFrame) -> DataFrame:
    return cards.withColumn("tokens", C.tokens(F.col("text")))


def placed(cards: DataFrame, segments: DataFrame, said: DataFrame) -> DataFrame:
    """Cards with their line (n, line, score), its scope, voice and pair, the tokens of cards read in one breath (before,
    after; null where none is near), and unmatched: why no meaning can be judged; null where it can."""
    order = Window.partitionBy("piece").orderBy("start", "card")
    beside = {
        "before": F.when(F.col("start") - F.coalesce(F.lag("end").over(order), F.lit(0.0)) <= NEIGHBOUR, F.lag("tokens").over(order)),
        "after": F.when(F.lead("start").over(order) - F.col("end") <= NEIGHBOUR, F.lead("tokens").over(order)),
    }
    timed = cards.where("start is not null and end is not null").withColumns(beside).select("piece", "card", "before", "after")
    own = cards.where("start is not null").join(timed, ["piece", "card"], "left").join(sources(cards, segments, said), ["piece", "card"], "left")
    text = said.select("rec", "n", F.col("text").alias("line"), "clauses", "voice", "pair")
    out = own.join(text, ["rec", "n"], "left").withColumn("scope", scope(F.col("tokens"), F.col("clauses"))).drop("clauses")
    why = F.when(F.coalesce("score", F.lit(0.0)) < MATCH_MIN, "no sentence matches").when(F.col("scope.score") < CLAUSE_MIN, "no clause matches")
    return out.withColumn("unmatched", why)


def governing(opens: Column) -> tuple[Column, Column]:
    """Tokens and text that govern the card: its scope, and the clause before where that opens so."""
    window, prev = F.col("scope.window"), F.col("scope.prev")
    joins = F.coalesce(opens, F.lit(False))
    return F.when(joins, F.concat(prev["tokens"], window["tokens"])).otherwise(window["tokens"]), F.when(joins, F.concat(prev["text"], F.lit(", "), window["text"])).otherwise(window["text"])


def meaning(placed_: DataFrame, strict: bool = False) -> DataFrame:
    """Findings of the checks of meaning; those of cards without a line make none."""
    card, first, last = F.col("tokens"), F.get("tokens", F.lit(0)), F.element_at(F.col("tokens"), -1)
    before_it = lead(F.col("scope.prev.tokens"))
    off = lambda found: F.filter(found, lambda t: ~F.array_contains(card, t))  # noqa: E731  not on the card

    negated, negated_text = governing(C.is_negation(before_it))
    negations = F.filter(negated, C.is_negation)
    stranded = (F.size(negations) > 0) & ~F.exists(card, C.is_negation)

    tied, tied_text = governing(before_it.isin(C.CONDITION))
    conditions = off(F.filter(tied, _set(C.CONDITION)))

    weighed, weighed_text = governing(before_it.isin(C.COMPARISON))
    comparisons = off(F.filter(weighed, _set(C.COMPARISON)))
    compares = lambda c: F.coalesce(F.exists(c, _set(C.COMPARISON)), F.lit(False))
    half = F.when((F.size(comparisons) > 0) & ~compares(card) & ~compares(F.col("before")) & ~compares(F.col("after")), F.concat(F.get(comparisons, F.lit(0)), F.lit(": "), weighed_text))
    half = half.when(first.isin(C.COMPARISON), F.concat(F.lit("opens on "), first)).when(last.isin(C.COMPARISON) & F.col("after").isNull(), F.concat(F.lit("ends on "), last))

    threes = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - PAIR_LEAST + 1), lambda i: F.array_join(F.slice(t, i, PAIR_LEAST), " "))
    shared = F.when((F.size(card) >= PAIR_LEAST) & F.col("pair").isNotNull(), F.arrays_overlap(threes(F.col("pair.phrase")), threes(card)))
    shown = F.transform(F.col("pair.tails"), lambda tail: F.arrays_overlap(tail, card))
    one_side = F.coalesce(shared, F.lit(False)) & F.exists(shown, lambda x: x) & ~F.forall(shown, lambda x: x)

    near = F.when(F.col("scope.prev").isNotNull(), F.concat("scope.prev.text", F.lit(", "), "scope.window.text")).otherwise(F.col("scope.window.text"))
    grants = lambda t: t.rlike("(?i)" + C.bounded(C.PERMISSION))
    asks = lambda t: F.rtrim(t).endswith("?")
    order = F.coalesce(first.isin(C.DIRECTIVE), F.lit(False)) & ~C.voiced(F.col("text"))
    whose = F.when(order & C.voiced(near), F.concat(F.lit("quoted: "), near)).when(order & F.col("voice").isNotNull(), F.concat(F.lit("somebody else: "), "voice"))
    whose = whose.when(order & grants(near) & ~grants(F.col("text")), F.concat(F.lit("permission: "), near)).when(order & asks(F.col("line")) & ~asks(F.col("text")), F.concat(F.lit("question: "), "line"))

    found = [
        _finding(stranded, "stranded-negation", "blocker", F.concat(F.array_join(F.array_sort(F.array_distinct(negations)), "/"), F.lit(": "), negated_text)),
        _finding(F.size(conditions) > 0, "stranded-condition", F.when(C.whole(card), "blocker").otherwise("review"), F.concat(F.get(conditions, F.lit(0)), F.lit(": "), tied_text)),
        _finding(half.isNotNull(), "stranded-comparison", "blocker", half),
        _finding(one_side, "stranded-pair", "blocker", F.array_join("pair.phrase", " ")),
        _finding(whose.isNotNull(), "stranded-attribution", "blocker", whose),
    ]
    if strict:
        found.append(_finding(last.isin(C.DANGLING) & ~asks(F.col("text")), "dangling-tail", "note", last))
    return placed_.where("unmatched is null").select("piece", "card", F.explode(F.array_compact(F.array(*found))).alias("f")).select("piece", "card", "f.*")


def _finding(holds: Column, kind: str, level, evidence: Column) -> Column:
    return F.when(holds, F.struct(F.lit(kind).alias("kind"), (F.lit(level) if isinstance(level, str) else level).alias("level"), evidence.alias("evidence")))


def mechanics(cards: DataFrame, pieces: DataFrame, errors: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """Findings that need no recording. cards: with tokens; pieces: piece, duration, hook (null: not known); errors: heard, said."""
    w = Window.partitionBy("piece").orderBy("start", "end", "card")
    timed = cards.where("start is not null and end is not null")
    late = timed.withColumn("until", F.lag("end").over(w)).where(F.col("start") < F.col("until") - TOUCHING)
    late = late.select("piece", "card", F.lit("overlap").alias("kind"), F.lit("blocker").alias("level"), F.format_string("still shown until %.2f", "until").alias("evidence"))
    first, rest = F.get("tokens", F.lit(0)), F.slice("tokens", 2, F.greatest(F.size("tokens"), F.lit(1)))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    hook = C.tokens(F.col("hook"))
    inside = lambda a, b: F.forall(a, lambda t: F.array_contains(b, t))
    restates = (F.coalesce("hook", F.lit("")) != "") & (F.size("tokens") > 0) & (F.size(F.array_intersect("tokens", hook)) >= 4) & (inside(F.col("tokens"), hook) | inside(hook, F.col("tokens")))
    alike = F.col("alike") >= RESTATED
    found = [
        _finding(F.col("start").isNull() | F.col("end").isNull(), "out-of-range", "blocker", F.lit("no start or no end")),
        _finding(F.col("start") < -TOUCHING, "out-of-range", "blocker", F.lit("starts before the piece")),
        _finding(F.col("end") <= F.col("start") + TOUCHING, "out-of-range", "blocker", F.lit("ends at or before its start")),
        _finding(F.col("start").isNotNull() & (F.col("end") > F.col("duration") + TOUCHING), "out-of-range", "blocker", F.lit("ends behind the piece")),
        _finding(first.isin(C.CONTINUATION), "stranded-continuation", F.when(C.whole(rest), "review").otherwise("blocker"), first),
        _finding(words > most, "word-ceiling", "note", words.cast("string")),
        _finding(F.coalesce(alike, F.lit(False)) | restates, "hook-repeat", "note", F.col("hook")),
    ]
    held = _likeness(cards.join(pieces, "piece", "left"))
    own = held.select("piece", "card", F.explode(F.array_compact(F.array(*found))).alias("f")).select("piece", "card", "f.*")
    return reduce(DataFrame.unionByName, [own, late, misheard(cards, errors)])


def _likeness(cards: DataFrame) -> DataFrame:
    """Add alike: the sequence ratio of card and hook, where their lengths allow RESTATED at all."""

    @F.pandas_udf("double")
    def ratio(a, b):
        import difflib

        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    a, b = (C.flat(F.coalesce(c, F.lit(""))) for c in ("text", "hook"))
    sized = cards.withColumns({"_a": a, "_b": b})
    may = (F.col("_b") != "") & (2 * F.least(F.length("_a"), F.length("_b")) >= RESTATED * (F.length("_a") + F.length("_b")))
    # texts that cannot be alike are compared as empty ones
    sized = sized.withColumns({c: F.when(may, F.col(c)).otherwise("") for c in ("_a", "_b")})
    return sized.withColumn("alike", F.when(F.col("_b") != "", ratio("_a", "_b"))).drop("_a", "_b")


def misheard(cards: DataFrame, errors: DataFrame) -> DataFrame:
    """known-mishearing: the card holds words (heard) that the transcript is known to get wrong (said). They meet by the first word of `heard`."""
    word = lambda text: F.regexp_extract_all(text, F.lit("[a-z0-9']+"), F.lit(0))
    known = errors.select(C.flat(F.col("heard")).alias("low"), "heard", "said").withColumn("word", F.get(word(F.col("low")), F.lit(0))).where("word is not null")
    own = cards.select("piece", "card", C.flat(F.col("text")).alias("flat")).withColumn("word", F.explode(F.array_distinct(word(F.col("flat")))))
    literal = F.concat(F.lit(r"(?<![a-z0-9'])\Q"), "low", F.lit(r"\E(?![a-z0-9'])"))
    hit = own.join(known, "word").where(F.regexp_like("flat", literal))
    return hit.select("piece", "card", F.lit("known-mishearing").alias("kind"), F.lit("blocker").alias("level"), F.concat("heard", F.lit(" -> "), "said").alias("evidence")).distinct()


def check(cards: DataFrame, segments: DataFrame, sentences: DataFrame, pieces: DataFrame, errors: DataFrame, strict: bool = False) -> DataFrame:
    """All findings of the cards of all pieces. sentences: lines before lines()."""
    own = tokenised(cards)
    return mechanics(own, pieces, errors).unionByName(meaning(placed(own, segments, lines(sentences)), strict))


def sentences(cues: DataFrame, gap: float = 2.5) -> DataFrame:
    """rec, n, text, start, end of the sentences of cues (rec, cue, text, start, end): they close on a finished cue or before a long silence.

    Cues that hold no words after cleaning are passed over.
    """
    from ..functions import speech as X

    own = cues.withColumn("text", F.trim(X.clean_cue(F.col("text")))).where("text <> ''")
    w = Window.partitionBy("rec").orderBy("cue")
    new = F.coalesce(F.lag("text").over(w).rlike(r"[.!?]['\")\]]*$"), F.lit(True)) | (F.col("start") - F.lag("end").over(w) > gap)
    numbered = own.withColumn("n", new.cast("int")).withColumn("n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct("cue", "text", "start", "end")))  # the cues of one sentence
    held = numbered.groupBy("rec", "n").agg(parts.alias("p"))
    return held.select("rec", "n", F.trim(F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), " "), r"\s+", " ")).alias("text"), F.get("p", F.lit(0))["start"].alias("start"), F.element_at("p", -1)["end"].alias("end"))
