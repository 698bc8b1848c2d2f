"""Timed text: cues to words, sentences, silences, stutters, cards and clocks.

Cues: rec, cue (ordinal), start, end, text. Windows are partitioned by recording and never wider.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech as S
from ..functions import text as X

PAUSE, LONG_PAUSE, STUTTER, WEAK_PUNCTUATION = 0.6, 1.5, 0.6, 1 / 60


def words(cues: DataFrame) -> DataFrame:
    """rec, cue, pos, word, t0, t1: time shared inside a cue by the words' lengths plus one."""
    toks = cues.where("end > start").select("rec", "cue", "start", "end", F.posexplode(X.tokens(F.col("text"))).alias("pos", "word"))
    own = Window.partitionBy("rec", "cue")
    weight = F.length("word") + 1
    upto = F.sum(weight).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(weight).over(own)
    at = lambda w: F.col("start") + (F.col("end") - F.col("start")) * w / total
    return toks.select("rec", "cue", "pos", "word", at(upto - weight).alias("t0"), at(upto).alias("t1"))


def sentences(words_: DataFrame, pause: float = LONG_PAUSE) -> DataFrame:
    """rec, sid, text, n_words, start, end: cut after a terminal, at a pause between cues, and at the end."""
    w = Window.partitionBy("rec").orderBy("cue", "pos")
    after = (F.lead("t0").over(w) - F.col("t1") >= pause) & (F.lead("cue").over(w) != F.col("cue"))
    cut = F.when(F.col("word").rlike(X.TERMINAL) | F.coalesce(after, F.lit(True)), 1).otherwise(0)
    marked = words_.withColumn("cut", cut)
    sid = F.coalesce(F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("sid")
    parts = marked.select("rec", "cue", "pos", "word", "t0", "t1", sid)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", "pos", "word"))), lambda x: x["word"]), " ")
    return parts.groupBy("rec", "sid").agg(text.alias("text"), F.count("*").alias("n_words"), F.min("t0").alias("start"), F.max("t1").alias("end"))


def spoken_sentences(words_: DataFrame, weak: float = WEAK_PUNCTUATION) -> DataFrame:
    """rec, sid, text, n_words, start, end, clean_end, start_estimated, start_boundary: sentences as they are spoken.

    A sentence ends before a change of speaker (`turn`, if there), at a word that is_terminal, and at a long pause
    between cues. In a recording of which less than `weak` of the words end on a mark, marks do not count and shorter
    pauses do. clean_end: on a mark, before a turn, at the end, or at a pause where marks do not count.
    """
    words_ = words_ if "turn" in words_.columns else words_.withColumn("turn", F.lit(False))
    w, rec = Window.partitionBy("rec").orderBy("cue", "pos"), Window.partitionBy("rec")
    nxt = {c: F.lead(c).over(w) for c in ("word", "cue", "t0", "turn")}
    rows = words_.withColumns({**{f"next_{c}": x for c, x in nxt.items()}, "marked": S.ends_terminal(F.col("word"))})
    rows = rows.withColumn("punct", F.avg(F.col("marked").cast("int")).over(rec) >= weak)
    other = F.col("next_cue") != F.col("cue")
    pause = other & (F.col("next_t0") - F.col("t1") >= F.when(F.col("punct"), LONG_PAUSE).otherwise(PAUSE))
    why = F.when(F.col("next_cue").isNull(), "end").when(F.col("next_turn"), "turn").when(F.col("punct") & S.is_terminal(F.col("word"), F.col("next_word")), "punct").when(pause, "pause")
    rows = rows.withColumn("why", why)
    sid = F.coalesce(F.count("why").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.withColumn("sid", sid).groupBy("rec", "sid").agg(F.array_sort(F.collect_list(F.struct("cue", "pos", "word", "t0", "t1", "turn", "marked", "why", "punct"))).alias("x"))  # the words of one sentence
    first, last = F.get("x", F.lit(0)), F.element_at("x", -1)
    clean = last["marked"] | last["why"].isin("turn", "end") | (~last["punct"] & (last["why"] == "pause"))
    out = parts.select("rec", "sid", F.array_join(F.transform("x", lambda x: x["word"]), " ").alias("text"), F.size("x").alias("n_words"), first["t0"].alias("start"), last["t1"].alias("end"), clean.alias("clean_end"), (first["pos"] > 0).alias("start_estimated"), first["turn"].alias("turn"), last["marked"].alias("marked"))
    order = Window.partitionBy("rec").orderBy("sid")
    boundary = F.when(F.col("sid") == 0, "file_start").when(F.lag("marked").over(order), "punctuation").when(F.col("turn"), "speaker_turn").otherwise("pause")
    return out.withColumn("start_boundary", boundary).drop("turn", "marked")


def silences(cues: DataFrame, least: float) -> DataFrame:
    """Cues that begin at least so long after the one before has ended."""
    gap = F.col("start") - F.lag("end").over(Window.partitionBy("rec").orderBy("cue"))
    return cues.withColumn("gap", gap).where(F.col("gap") >= least).select("rec", "cue", "gap")


def bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "^[^A-Za-z0-9']+|[^A-Za-z0-9']+$", ""))


def stutters(words_: DataFrame, gap: float = STUTTER) -> DataFrame:
    """Words that repeat the one before within the gap."""
    w = Window.partitionBy("rec").orderBy("cue", "pos")
    again = (bare(F.col("word")) == bare(F.lag("word").over(w))) & (bare(F.col("word")) != "") & (F.col("t0") - F.lag("t1").over(w) < gap)
    return words_.withColumn("again", F.coalesce(again, F.lit(False))).where("again").select("rec", "cue", "pos", "word")


def edit_clock(segments: DataFrame) -> DataFrame:
    """piece, ord, start, end -> base: where the segment begins in the finished piece."""
    before = Window.partitionBy("piece").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("base", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)))


def chunks(words_: DataFrame, size: int = 4) -> DataFrame:
    """Cards of `size` words inside each cue: rec, cue, card, text, start, end, gaps of a breath closed."""
    card = words_.withColumn("card", F.floor(F.col("pos") / size))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    cards = card.groupBy("rec", "cue", "card").agg(text.alias("text"), F.min("t0").alias("start"), F.max("t1").alias("end"))
    following = F.lead("start").over(Window.partitionBy("rec").orderBy("cue", "card"))
    closed = F.when(following - F.col("end") <= 0.5, following).otherwise(F.col("end"))
    held = F.greatest(closed, F.least(F.coalesce(following, F.col("start") + 0.55), F.col("start") + 0.55))
    return cards.withColumn("end", F.least(held, F.col("start") + 3.0)).where("end > start")


def group_cards(words_: DataFrame, least: int = 2, most: int = 4, pause: float = 0.45) -> DataFrame:
    """Cards of at most `most` words that stop at sentence ends, pauses and changes of speaker (`turn`, if there).

    A lone word joins the card before it where nothing hard divides them and there is room; one that is
    still alone takes a word from a card of more than `least`. Closing quotes may follow a mark. Each cut
    rests on the one before: grouped by recording.
    """
    words_ = words_ if "turn" in words_.columns else words_.withColumn("turn", F.lit(False))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["cue", "pos"])
        word, t0, t1, turn = (pdf[c].tolist() for c in ("word", "t0", "t1", "turn"))
        ends, size = [], 0
        for k, w in enumerate(word):
            size += 1
            last = k + 1 == len(word)
            mark = w.rstrip("\"')]”’")[-1:]
            hard = last or (mark and mark in ".!?") or t0[k + 1] - t1[k] > pause or bool(turn[k + 1])
            if hard or size >= most or (mark and mark in ",;:—-" and size >= least):
                ends.append((k + 1, hard))
                size = 0
        bounds = []
        for a, (b, h) in zip([0, *[e for e, _ in ends]], ends, strict=False):
            if bounds and b - a == 1 and not bounds[-1][2] and bounds[-1][1] - bounds[-1][0] < most:
                bounds[-1][1:] = [b, h]
            else:
                bounds.append([a, b, h])
        for before, own in zip(bounds, bounds[1:], strict=False):
            if own[1] - own[0] == 1 and not before[2] and before[1] - before[0] > least:
                before[1] = own[0] = own[0] - 1
        return pd.DataFrame([(pdf["rec"].iloc[0], n, " ".join(word[a:b]), t0[a], t1[b - 1]) for n, (a, b, _) in enumerate(bounds) if b > a], columns=["rec", "card", "text", "start", "end"])

    return words_.groupBy("rec").applyInPandas(run, "rec long, card long, text string, start double, end double")
