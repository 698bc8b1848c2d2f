"""Words on their way to cards: speaker marks, restarts and fillers taken off the screen.

Words: rec, n (order in the recording), word, first (opens a cue), t0, t1. Windows are partitioned by recording.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.speech import TERMINAL

#: Fillers, alone and in pairs, and the hedges that may go too.
FILLERS = ["um", "umm", "ummm", "uh", "uhh", "uhhh", "uhm", "er", "erm", "hmm", "hmmm", "mm", "mmm", "mhm", "mmhmm", "uh-huh", "mm-hmm"]
FILLER_PAIRS = ["you know", "i mean"]
HEDGES, HEDGE_PAIRS = ["basically", "literally", "actually", "honestly"], ["kind of", "sort of", "i guess"]
SPEAKER_TOKEN = r"^[>\-]*\s*(?:SPEAKER[ _]?\d+|[A-Z][A-Za-z0-9_']*):$"
BARE = r"[.,!?;:'\"()\[\]’“”—-]+"


def _bare(word):
    return F.regexp_replace(F.lower(word), f"^{BARE}|{BARE}$", "")


def _order():
    return Window.partitionBy("rec").orderBy("n")


def mark_speakers(words: DataFrame) -> DataFrame:
    """Without the labels that open cues; turn marks the word after one."""
    label = F.col("first") & F.col("word").rlike(SPEAKER_TOKEN)
    marked = words.withColumn("label", label).withColumn("turn", F.coalesce(F.lag("label").over(_order()), F.lit(False)))
    return marked.where("not label").drop("label")


def collapse_repeats(words: DataFrame, gap: float = 0.6) -> DataFrame:
    """Of words that repeat the one before within the gap the last stays."""
    w = _order()
    again = (_bare(F.lead("word").over(w)) == _bare(F.col("word"))) & (_bare(F.col("word")) != "") & (F.lead("t0").over(w) - F.col("t1") < gap)
    return words.withColumn("again", F.coalesce(again, F.lit(False))).where("not again").drop("again")


def strip_filler(words: DataFrame, hedges: bool = False) -> DataFrame:
    """Without fillers. A full stop of a dropped word goes to the word before; a word that then opens a sentence gets a capital."""
    w = _order()
    singles, pairs = FILLERS + HEDGES * hedges, FILLER_PAIRS + HEDGE_PAIRS * hedges
    own, nxt = _bare(F.col("word")), _bare(F.lead("word").over(w))
    pair = F.coalesce(F.concat_ws(" ", own, nxt).isin(pairs), F.lit(False))
    rows = words.withColumn("pair", pair).withColumn("second", F.coalesce(F.lag("pair").over(w), F.lit(False)))
    like = (own == "like") & F.regexp_replace("word", r"[”’\"')]+$", "").endswith(",")
    rows = rows.withColumn("drop", F.col("pair") | F.col("second") | own.isin(singles) | like)
    # a dropped run belongs to the kept word before it; of a pair the second word's mark counts
    rows = rows.withColumn("group", F.sum((~F.col("drop")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    end = F.when(F.col("drop") & ~F.col("pair"), F.nullif(F.regexp_extract("word", TERMINAL, 0), F.lit("")))
    rows = rows.withColumn("end", end)
    inside = Window.partitionBy("rec", "group").orderBy("n")
    kept_end = F.max(F.when(~F.col("drop"), F.col("word").rlike(TERMINAL))).over(inside)
    before = F.coalesce(F.count("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)) > 0, F.lit(False))
    counts = F.col("drop") & ~F.col("pair")  # a pair is one dropped thing
    opens = counts & ((F.col("group") == 0) | (F.col("end").isNull() & (kept_end | before)))
    rows = rows.withColumn("opens", F.coalesce(opens, F.lit(False)))
    # a row for each group: its kept word, the ends of those dropped behind it, and whether the next group's word then opens a sentence
    ends = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("end").isNotNull(), F.struct("n", "end")))), lambda x: x["end"]), "")
    own = F.first(F.when(~F.col("drop"), F.struct(*words.columns)), ignorenulls=True)
    groups = rows.groupBy("rec", "group").agg(F.max("opens").alias("opens"), ends.alias("ends"), own.alias("own"))
    capital = F.coalesce(F.lag("opens").over(Window.partitionBy("rec").orderBy("group")), F.lit(False))
    kept = groups.withColumn("capital", capital).where("own is not null").select("own.*", "ends", "capital")
    raised = F.when(F.col("capital") & (F.col("word") == F.lower("word")), F.concat(F.upper(F.substring("word", 1, 1)), F.expr("substring(word, 2)"))).otherwise(F.col("word"))
    return kept.withColumn("word", F.concat(raised, "ends")).select(*words.columns)
