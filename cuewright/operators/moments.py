"""Moments of a recording: windows of whole sentences, scored by signals, and the best of them.

Sentences: rec, n (from 0), text, start, end, clean_end and the columns of speech.features. A window runs from
sentence n to sentence j. Its sentences are gathered by a range window over their starts, so a row holds no more
than what is said in LONGEST seconds, and every signal is an expression over that array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import speech as X
from .grouped import each_group

SHORTEST, LONGEST, SILENCE, BREAK = 35.0, 75.0, 1.8, 4.0
HELD = ["n", "text", "start", "end", "clean_end", "n_words", "is_question", "n_numbers", "n_names", "n_contrast", "you", "filler", "exclaims", "promo", "dead", "closes_weakly", "closes_strongly", "after"]


def clean_starts(sents: DataFrame, pause: float = 0.6) -> DataFrame:
    """Add starts_clean: the first sentence, one after a finished sentence (no abbreviation), or one after a pause."""
    w = Window.partitionBy("rec").orderBy("n")
    before = F.element_at(X.split_words(F.lag("text").over(w)), -1)
    done = X.ends_terminal(before) & ~F.lower(before).isin(X.ABBREVIATIONS)
    gap = F.col("start") - F.lag("end").over(w)
    return sents.withColumn("starts_clean", (F.col("n") == 0) | F.coalesce(done, F.lit(False)) | F.coalesce(gap >= pause, F.lit(False)))


def closings(text: Column) -> dict[str, Column]:
    return {"closes_weakly": X.closes_weakly(text), "closes_strongly": X.closes_strongly(text)}


def windows(sents: DataFrame, lo: float = SHORTEST, hi: float = LONGEST, most: int | None = None, starts: Column | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """rec, i, j, w (the window's sentences), before (seconds of silence ahead of it) and after (the sentence that follows).

    Windows of lo to hi seconds that start on no bad opener (the first sentence may), hold no silence over BREAK
    and end on a finished sentence. most: sentences of a window; starts: a further condition on its first one;
    carried: further columns of the sentences that w holds.
    """
    # what is asked of a sentence is looked up once, and not in each window that it ends
    closes = {k: c for k, c in closings(F.col("text")).items() if k not in sents.columns}
    counted = sents.withColumns({f"n_{c}": F.size(c) for c in ("numbers", "names", "contrast")} | closes)
    order = Window.partitionBy("rec").orderBy("n")
    ahead = Window.partitionBy("rec").orderBy("start").rangeBetween(0, int(hi))
    # the sentence that follows comes along: it may start later than the window's sentences reach, and a join would move every window
    follows = F.when(F.lead("n").over(order) == F.col("n") + 1, F.struct(*[F.lead(c).over(order).alias(c) for c in ("start", "n_words", "dead")]))
    counted = counted.withColumn("after", follows)
    held = counted.withColumn("ahead", F.sort_array(F.collect_list(F.struct(*HELD, *carried)).over(ahead)))
    held = held.withColumn("before", F.col("start") - F.lag("end").over(order)).where(~F.col("bad_opener") | (F.col("n") == 0))
    held = held if starts is None else held.where(starts)
    # how many sentences follow each other without a break
    gaps = F.expr(f"filter(sequence(1, size(ahead) - 1), k -> k > 0 and k < size(ahead) and ahead[k].start - ahead[k - 1].end > {BREAK})")
    held = held.withColumn("run", F.coalesce(F.array_min(gaps), F.size("ahead")))
    run = F.col("run") if most is None else F.least("run", F.lit(most))
    ends = held.select("rec", F.col("n").alias("i"), "before", "ahead", F.explode(F.sequence(F.lit(0), run - 1)).alias("k"))
    fits = ends.where(f"ahead[k].clean_end and ahead[k].end - ahead[0].start between {lo} and {hi}")
    return fits.select("rec", "i", (F.col("i") + F.col("k")).alias("j"), F.expr("slice(ahead, 1, k + 1)").alias("w"), "before", F.expr("ahead[k].after").alias("after"))


def _total(field: str) -> str:
    return f"aggregate(w, 0D, (a, x) -> a + {field})"


def signals() -> dict[str, Column]:
    """Points of each signal, over the columns of windows(); null where there are none."""
    e = F.expr
    words = "greatest(1D, " + _total("x.n_words") + ")"
    first, last = "w[0]", "element_at(w, -1)"
    span = f"({last}.end - {first}.start)"
    hook = f"(if({first}.is_question, 8, 0) + if({first}.n_numbers > 0, 4, 0) + if({first}.you > 0, 3, 0) + if({first}.n_contrast > 0, 3, 0))"
    asked = """array_min(filter(sequence(0, size(w) - 3), k -> k >= 0 and k < size(w) - 2 and w[k].is_question and not w[k].promo
        and aggregate(filter(slice(w, k + 2, 4), x -> not x.is_question), 0, (a, x) -> a + x.n_words) >= 20
        and aggregate(filter(slice(w, k + 2, 4), x -> not x.is_question), 0, (a, x) -> a + x.filler) <= 1))"""
    hits = _total("x.n_contrast")
    late = f"exists(w, x -> x.n_contrast > 0 and (x.start - {first}.start) / {span} >= 0.4)"
    said = F.lower(F.array_join(F.transform("w", lambda x: x["text"]), " "))
    asides = F.when(said.contains("you know"), F.regexp_count(said, F.lit(X.bounded("you know")))).otherwise(0)
    you = F.when(e(_total("x.you")) > 0, F.greatest(F.lit(0.0), e(_total("x.you")) - asides)).otherwise(0.0)
    n_last = e(f"{last}.n_words")
    landed = F.when(n_last <= 14, 4).otherwise(0) + F.when(n_last <= 8, 3).otherwise(0) + F.when(e(f"{last}.closes_strongly"), 4).otherwise(0) + F.when(e(f"{last}.is_question"), 2).otherwise(0) - F.when(n_last > 30, 3).otherwise(0)
    silent = f"size(filter(sequence(1, size(w) - 1), k -> k > 0 and k < size(w) and w[k].start - w[k - 1].end > {SILENCE}))"
    shifts = "size(filter(sequence(1, size(w) - 1), k -> k > 0 and k < size(w) and w[k].n_words <= 6 and w[k - 1].n_words >= 15))"
    ahead = "case when before >= 1.5 then 6 when before >= 0.8 then 4 else 0 end"
    gap = f"(after.start - {last}.end)"
    dead = "size(filter(slice(w, 1, 3), x -> x.dead)) + size(filter(slice(w, greatest(1, size(w) - 1), 2), x -> x.dead))"
    return {
        "hook": e(f"least(15, {hook} + if({hook} > 0 and {first}.n_words <= 16, 3, 0))"),
        "question_then_answer": e(f"case when {asked} <= greatest(1, size(w) div 3) then 14 when {asked} is not null then 8 end"),
        "concrete_specifics": e(f"least(16, 3 * {_total('x.n_numbers')} + 1.5 * {_total('x.n_names')})"),
        "contrast_or_reversal": e(f"if({hits} > 0, least(16, 5 + 3 * (least({hits}, 4) - 1) + if({late}, 3, 0)), null)"),
        "direct_address": F.least(F.lit(8.0), 100 * you / e(words) * 0.8),
        "closing_line": F.when(e(f"{last}.closes_weakly"), F.lit(-10)).otherwise(F.greatest(F.lit(-10), F.least(F.lit(14), landed))),
        "completeness": e(f"if(forall(w, x -> x.clean_end), 5, 0) + if({silent} = 0, 3, 0) + if({_total('x.n_words')} / size(w) between 6 and 24, 2, 0)"),
        "internal_silence": e(f"-4 * {silent}"),
        "energy_proxy": e(f"least(8, {ahead} + least(3, 1.5 * {shifts}) + least(2, {_total('x.exclaims')}))"),
        "clean_exit": e(f"case when {gap} >= 1.0 then 5 when {gap} >= 0.6 then 2 when {gap} < 0.3 and after.n_words <= 12 and not after.dead then -5 end"),
        "filler": e(f"-least(25, 200 * {_total('x.filler')} / {words})"),
        "dead_weight_at_edges": e(f"-3 * ({dead})"),
        "promo_or_housekeeping": e("-least(20, 10 * size(filter(w, x -> x.promo)))"),
        "duration": e(f"if({span} between 45 and 60, 4, 2)"),
    }


def opening_verdicts(found: DataFrame, shapes: DataFrame) -> DataFrame:
    """found with shape_points and hook_factor: what a niche's winners make of the window's first sentence. shapes: shape, lift, conf.

    The points are measured; the factor, at most 1, is what the hand-set points of the hook are still worth where the
    winners avoid the shape. Windows that open with no measured shape have none and 1.
    """
    from .profiles import shape_verdicts

    key = F.struct("rec", "i").alias("sid")
    lines = found.select(key, F.get("w", F.lit(0))["text"].alias("text")).dropDuplicates(["sid"])  # a window's start has one sentence
    met = shape_verdicts(lines, shapes).select("sid.rec", "sid.i", F.col("points").alias("shape_points"), F.col("factor").alias("hook_factor"))
    return found.join(met, ["rec", "i"], "left").withColumns({"shape_points": F.coalesce("shape_points", F.lit(0.0)), "hook_factor": F.coalesce("hook_factor", F.lit(1.0))})


def scored(found: DataFrame, without: tuple[str, ...] = ()) -> DataFrame:
    """Add why, the signals that gave points (signal, points to one place), and score, their sum.

    Tenths are summed as integers, so that equal scores are equal. without: signals that do not count. Where found has
    opening_verdicts, the hook is damped and niche_shape is a signal of its own.
    """
    own = signals()
    if "hook_factor" in found.columns:
        shape = F.col("shape_points")
        own = {"hook": own.pop("hook") * F.col("hook_factor"), "niche_shape": F.when(F.abs(shape) >= 0.1, shape), **own}
    one = [F.struct(F.lit(name).alias("signal"), F.round(points.cast("double"), 1).alias("points")) for name, points in own.items() if name not in without]
    out = found.withColumn("why", F.filter(F.array(*one), lambda x: F.coalesce(x["points"], F.lit(0.0)) != 0))
    tenths = F.aggregate("why", F.lit(0), lambda a, x: a + F.round(x["points"] * 10).cast("int"))
    return out.withColumn("score", tenths / 10.0)


def best_ends(windows_: DataFrame) -> DataFrame:
    """For each start the end of the best score, then of the shorter window: rec, i, j, start, end, score, why."""
    out = windows_.select("rec", "i", "j", F.col("w")[0]["start"].alias("start"), F.element_at("w", -1)["end"].alias("end"), "score", "why")
    rank = F.row_number().over(Window.partitionBy("rec", "i").orderBy(F.desc("score"), F.col("end") - F.col("start"), "j"))
    return out.withColumn("r", rank).where("r = 1").drop("r")


def lead_ins(best: DataFrame, sents: DataFrame, gap: float = 1.0, longest: float = 12.0) -> DataFrame:
    """Add starts_clean, lead (the start of the sentence before, where the opener leans on it and it may be added) and lead_clean.

    sents: with starts_clean and features.
    """
    w = Window.partitionBy("rec").orderBy("n")
    was = lambda c: F.lag(c).over(w)
    fine = was("clean_end") & ~was("is_ack") & (was("filler") == 0) & ~was("promo") & ~was("bad_opener")
    near = (F.col("start") - was("end") < gap) & (was("end") - was("start") <= longest)
    lead = F.when(X.leans_back(F.col("text")) & ~F.col("is_question") & fine & near, was("start"))
    own = sents.select("rec", F.col("n").alias("i"), "starts_clean", lead.alias("lead"), was("starts_clean").alias("lead_clean"))
    return best.join(own, ["rec", "i"])


def pick(best: DataFrame, n: int = 5, overlap: float = 0.0, longest: float = LONGEST) -> DataFrame:
    """Of each recording the best n windows that share no more than `overlap` seconds: by score, then shorter.

    best: rec, i, start, end, score, starts_clean, lead, lead_clean. A window takes its lead-in where it still
    fits; one whose first sentence starts unclean is passed over. Each choice rests on those before, so one function
    runs over a recording's windows (one for each start).
    """

    def run(rows):
        kept = []
        free = lambda s, e: all(min(e, k[2]) - max(s, k[1]) <= overlap for k in kept)
        for _, _, start, end, score, clean, lead, lead_clean in sorted(rows, key=lambda r: (-r[4], r[3] - r[2], r[1])):
            if len(kept) >= n:
                break
            if not free(start, end):
                continue
            led = lead is not None and end - lead <= longest and free(lead, end)
            if lead_clean if led else clean:
                kept.append((len(kept) + 1, lead if led else start, end, score, led))
        return kept

    own = best.select("rec", "i", "start", "end", "score", "starts_clean", "lead", F.coalesce("lead_clean", F.lit(False)).alias("lead_clean"))
    return each_group(own, "rec", ["i"], run, "rank int, start double, end double, score double, lead_in boolean")


def strength(score: Column) -> Column:
    return F.when(score >= 50, "strong").when(score >= 35, "usable").otherwise("weak")
