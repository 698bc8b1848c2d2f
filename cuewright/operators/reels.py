"""Pieces cut from tape: segments, joins, beats, cards on the finished clock, and their checks.

Segments: piece, ord (edit order), s, e. Windows are partitioned by piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals, timed
from .grouped import settle

CHAIN, HIDDEN = 1.2, 0.08


def _by(piece: str = "piece", *order):
    return Window.partitionBy(piece).orderBy(*(order or ("ord",)))


def duplicates(tape: DataFrame, width: float, threshold: float, tail: float) -> DataFrame:
    """Pairs of pieces (id, s, e) that share more than `threshold` of tape: id_a, id_b, seconds, parts, share_a and
    share_b in percent, the longest shared range, and same_ending: both share something of their last `tail`. Copies are looked at once."""
    own = intervals.islands(tape)
    reps = settle(intervals.copies(own))
    whole = own.groupBy("id").agg(F.sum(F.col("e") - F.col("s")).alias("all"), F.max("e").alias("last"))
    side = lambda x: whole.select(F.col("id").alias(f"id_{x}"), F.col("all").alias(f"all_{x}"), F.col("last").alias(f"last_{x}"))
    longest = F.max_by(F.struct("s", "e"), F.struct("d", -F.col("s"))).alias("longest")
    parts = intervals.self_overlaps(own, reps, width).withColumn("d", F.col("e") - F.col("s"))
    pairs = parts.groupBy("id_a", "id_b").agg(F.sum("d").alias("seconds"), F.count("*").alias("parts"), longest, F.max("e").alias("end"))
    pairs = pairs.where(F.col("seconds") > threshold).join(side("a"), "id_a").join(side("b"), "id_b")
    share = lambda x: (100 * F.col("seconds") / F.col(f"all_{x}")).alias(f"share_{x}")
    ends = (F.col("end") > F.col("last_a") - tail) & (F.col("end") > F.col("last_b") - tail)
    out = pairs.select("id_a", "id_b", "seconds", "parts", share("a"), share("b"), "longest.s", "longest.e", ends.alias("same_ending"))
    return intervals.expanded(out, reps, ("share",))


def joins(segments: DataFrame, pad: float) -> DataFrame:
    """piece, ord of the segment before, tail and head windows of `pad` clamped to their segments, gap, reaches_back."""
    w = _by()
    nxt = lambda c: F.lead(c).over(w)
    out = segments.select("piece", "ord", F.greatest("s", F.col("e") - pad).alias("tail_s"), F.col("e").alias("tail_e"), nxt("s").alias("head_s"), F.least(nxt("e"), nxt("s") + pad).alias("head_e"))
    return out.where("head_s is not null").withColumn("gap", F.col("head_s") - F.col("tail_e")).withColumn("reaches_back", F.col("gap") < 0)


def beats(segments: DataFrame, target: float, most: float) -> DataFrame:
    """Segments cut into beats: pieces of `target` as long as more than `most` is left, then the rest."""
    n = F.greatest(F.lit(0), F.ceil((F.col("e") - F.col("s") - most) / target)).cast("int")
    out = segments.where("e > s").withColumn("n", n).select("piece", "ord", "s", "e", "n", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("k"))
    start = F.col("s") + F.col("k") * target
    return out.select("piece", "ord", "k", start.alias("s"), F.when(F.col("k") < F.col("n"), start + target).otherwise(F.col("e")).alias("e"))


def closed(beats_: DataFrame, totals: DataFrame) -> DataFrame:
    """piece, s, e of beats that cover 0 to the piece's total: each holds until the next, the first from 0."""
    w = _by("piece", "s")
    first = F.row_number().over(w) == 1
    out = beats_.select("piece", F.when(first, F.least(F.col("s"), F.lit(0.0))).otherwise(F.col("s")).alias("s"), F.lead("s").over(w).alias("next"), "e")
    return out.join(totals, "piece").select("piece", "s", F.coalesce("next", F.greatest("e", "total")).alias("e"))


def source_windows(cards: DataFrame, segments: DataFrame) -> DataFrame:
    """Where in the recording cards (piece, card, cs, ce) on the finished clock lie: piece, card, s, e, one row for each segment met."""
    clock = timed.edit_clock(segments.where("e > s").select("piece", "ord", F.col("s").alias("start"), F.col("e").alias("end")))
    met = cards.join(clock, "piece").withColumn("span", F.col("end") - F.col("start")).where("ce > base and cs < base + span")
    return met.select("piece", "card", (F.col("start") + F.greatest(F.lit(0.0), F.col("cs") - F.col("base"))).alias("s"), (F.col("start") + F.least("span", F.col("ce") - F.col("base"))).alias("e"))


def hidden_cards(layers: DataFrame, cards: DataFrame, width: float, least: float = HIDDEN) -> DataFrame:
    """Pairs of a full-frame layer and a caption card (id, s, e both) on screen together for more than `least`."""
    return intervals.overlaps(layers, cards, width).withColumn("seconds", F.col("e") - F.col("s")).where(F.col("seconds") > least).select(F.col("id_a").alias("layer"), F.col("id_b").alias("card"), "seconds")


def chains(cards: DataFrame, gap: float = CHAIN) -> DataFrame:
    """cards (piece, n, s, e) with chain: the first n of the run of cards that follow each other within `gap`."""
    w = _by("piece", "n")
    new = F.when(F.col("s") - F.lag("e").over(w) <= gap, 0).otherwise(1)
    run = cards.withColumn("run", new)
    run = run.withColumn("run", F.sum("run").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.withColumn("chain", F.min("n").over(Window.partitionBy("piece", "run"))).drop("run")


def gap_before(cards: DataFrame) -> DataFrame:
    """cards with gap: from the latest end of any card before, null for the first."""
    before = _by("piece", "s", "n").rowsBetween(Window.unboundedPreceding, -1)
    return cards.withColumn("gap", F.col("s") - F.max("e").over(before))


def look_back(lines: DataFrame, hit: Column, back: int = 2) -> DataFrame:
    """lines (rec, n, ...) with voice: n of the nearest line where `hit` holds, among the line itself and `back` before."""
    w = Window.partitionBy("rec").orderBy("n").rowsBetween(-back, 0)
    return lines.withColumn("voice", F.max(F.when(hit, F.col("n"))).over(w))


def clamped(rows: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """rows (s, e) inside lo to hi: those outside are dropped, those that cross are clamped."""
    return rows.withColumns({"s": F.greatest("s", lo), "e": F.least("e", hi)}).where("e > s")


def estimated_cards(texts: DataFrame, most: int = 4, rate: float = 2.6, least: float = 0.65) -> DataFrame:
    """id, text -> id, card, text, s, e: cards of at most `most` words, timed by speaking rate."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("w") / most).cast("int") - 1), lambda k: F.slice("w", k * most + 1, most))
    cards = texts.withColumn("w", words).where(F.size("w") > 0).select("id", F.posexplode(parts).alias("card", "part"))
    d = F.greatest(F.lit(least), F.size("part") / rate)
    upto = F.sum(d).over(Window.partitionBy("id").orderBy("card").rowsBetween(Window.unboundedPreceding, 0))
    return cards.select("id", "card", F.array_join("part", " ").alias("text"), F.round(upto - d, 3).alias("s"), F.round(upto, 3).alias("e"))
