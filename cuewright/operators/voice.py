"""How somebody writes, counted: a profile of many blocks, words over-used, how far a draft drifts from it, and drafts.

Samples: by (whose), sample, text. One pass takes a row from each sample and one from each sentence; every block is
made of sums and counts over them, so parts of the samples may be counted apart and added up. Quantiles are exact,
from counts of lengths.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions as C
from ..functions import speech as X
from .grouped import settle

#: Persons spoken of; what makes a figure thin; what a line may not open a caption with.
PERSONS = {"i_me_my": ["i", "me", "my", "mine", "myself"], "we_us_our": ["we", "us", "our", "ours"], "you_your": ["you", "your", "yours", "yourself"]}
THIN = {"sentences": 60, "chances": 20}
LEANS = r"(?i)^\s*(?:he|she|it|they|them|this|that|these|those|and|but|so|because|which|anyway|also|then)" + X.RIGHT
SKIPPED = r"(?i)^\s*(?:um+|uh+|er+|yeah|right|okay|ok|i mean|you know|sort of|kind of|anyway)" + X.RIGHT + r"[\s,]*$"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}]"
LONG, SHORT, ROOM = 25, 8, 1.35
#: Figures of voices are broadcast up to this many.
FIGURES = 200_000


def _beyond_ascii(text: Column) -> Column:
    """Some character takes more than one byte."""
    return F.octet_length(text) > F.length(text)


def _times(text: Column, pattern: str, *marks: str) -> Column:
    """How often the pattern stands in the text; each of its matches holds one of the marks, which are found faster."""
    return F.when(reduce(or_, [text.contains(m) for m in marks]), F.regexp_count(text, F.lit(pattern))).otherwise(F.when(text.isNotNull(), 0))


def sentences(samples: DataFrame) -> DataFrame:
    """by, sample, n (from 0), last, sent, mark (its closing marks), n_words, opens: sentences that hold a word."""
    parts = F.split("text", r"(?<=[.!?…])\s+|\n+")
    rows = samples.select("by", "sample", F.posexplode(parts).alias("p", "raw"))
    rows = rows.withColumn("sent", C.bare(F.col("raw"))).withColumn("sent", F.when(_beyond_ascii(F.col("sent")), F.regexp_replace("sent", EMOJI, " ")).otherwise(F.col("sent")))
    rows = rows.withColumn("sent", F.trim(F.regexp_replace("sent", r"^\s+|\s+$", "")))
    own = rows.withColumn("w", F.regexp_extract_all(F.lower("sent"), F.lit(r"[a-z][a-z'\-]*"), F.lit(0))).where(F.size("w") > 0)
    w = Window.partitionBy("by", "sample").orderBy("p")
    return own.select("by", "sample", (F.row_number().over(w) - 1).alias("n"), F.lead("p").over(w).isNull().alias("last"), "sent", F.regexp_extract("sent", r"([.!?…]+)[\"')\]]*$", 1).alias("mark"), F.size("w").alias("n_words"), F.get("w", F.lit(0)).alias("opens"))


def counted(samples: DataFrame, profanity: str | None = None) -> DataFrame:
    """by and the sums of each sample: words, contractions and chances, emoji, profanity, tags, handles, links, persons."""
    t = F.col("text")
    own = F.col("own")
    rude = F.regexp_count(F.lower(t), F.lit(X.bounded(profanity))) if profanity else F.lit(0)
    among = lambda values: F.size(F.filter(own, lambda w: w.isin(values)))
    # a column of its own, so that the words of a text are looked for once
    return samples.withColumn("own", C.bare_words(t)).select(
        "by", "sample", F.size(own).alias("words"), C.contractions(t).alias("contracted"), C.long_forms(t).alias("written_out"), F.when(_beyond_ascii(t), F.regexp_count(t, F.lit(EMOJI))).otherwise(F.when(t.isNotNull(), 0)).alias("emoji"), rude.alias("profanity"),
        _times(t, C.HASHTAG, "#").alias("hashtags"), _times(t, C.MENTION, "@").alias("mentions"), _times(t, C.URL, "://", "www.").alias("links"), *[among(v).alias(k) for k, v in PERSONS.items()],
    )


def profile(samples: DataFrame, profanity: str | None = None) -> DataFrame:
    """by, block, name, value, n: every figure of every block with what it rests on.

    Blocks: built_from, sentence_length, sample_length, contractions, punctuation, opening (shape of a sample's first
    sentence, share of samples), closing (how its last one lands), emoji, profanity, marks, persons (per 1000 words).
    """
    samples = samples.repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "by", "sample")  # whole texts move once
    s = F.sum
    # every text and sentence is looked at once; what follows reads a row for each kind of them
    sums_of = ("contracted", "written_out", "emoji", "profanity", "hashtags", "mentions", "links", *PERSONS)
    per_sample = settle(counted(samples, profanity).groupBy("by", "words").agg(F.count("*").alias("k"), *[s(c).alias(c) for c in sums_of], F.count_if(F.col("emoji") > 0).alias("with_emoji"), F.count_if(F.col("profanity") > 0).alias("with_profanity")))
    shape = F.filter(C.opening_shapes(F.col("sent")), lambda x: (x != "question") | F.col("mark").contains("?") | F.col("sent").rlike(r"(?i)^\s*(?:how|what|why|when|where|who|which)" + X.RIGHT))
    kinds = sentences(samples).select("by", "n_words", "opens", F.col("mark").contains("?").alias("asks"), F.col("mark").contains("!").alias("cries"), (F.col("mark") == "").alias("open"), F.when(F.col("n") == 0, shape).alias("shapes"), F.when(F.col("last"), C.closing(F.col("sent"))).alias("closing"), "last")
    sents = settle(kinds.groupBy(*kinds.columns).agg(F.count("*").alias("k")))
    having = lambda c: s(F.when(c, F.col("k")).otherwise(0))
    wide = per_sample.groupBy("by").agg(s("k").alias("samples"), s(F.col("words").cast("long") * F.col("k")).alias("words"), *[s(c).alias(c) for c in (*sums_of, "with_emoji", "with_profanity")])
    said = sents.groupBy("by").agg(s("k").alias("sentences"), having(F.col("asks")).alias("questions"), having(F.col("cries")).alias("exclamations"), having(F.col("open")).alias("unpunctuated"), having(F.col("n_words") < SHORT).alias("under_8"), having(F.col("n_words") > LONG).alias("over_25"), F.count_distinct("opens").alias("openers"))
    both = wide.join(said, "by", "left").na.fill(0)
    chances = F.col("contracted") + F.col("written_out")
    per = lambda c, n: F.round(F.col(c) / F.when(n > 0, n), 3)
    n_sent, n, n_words = F.col("sentences"), F.col("samples"), F.col("words")
    figures = [
        ("built_from", "samples", n, n), ("built_from", "words", n_words, n), ("built_from", "sentences", n_sent, n),
        ("sentence_length", "under_8", per("under_8", n_sent), n_sent), ("sentence_length", "over_25", per("over_25", n_sent), n_sent), ("sentence_length", "thin", (n_sent < THIN["sentences"]).cast("int"), n_sent),
        ("contractions", "rate_when_possible", per("contracted", chances), chances), ("contractions", "thin", (chances < THIN["chances"]).cast("int"), chances),
        ("punctuation", "question_rate", per("questions", n_sent), n_sent), ("punctuation", "exclamation_rate", per("exclamations", n_sent), n_sent), ("punctuation", "unpunctuated", F.col("unpunctuated"), n_sent),
        ("emoji", "share_of_samples", per("with_emoji", n), n), ("emoji", "uses", F.col("emoji"), n), ("profanity", "share_of_samples", per("with_profanity", n), n), ("profanity", "uses", F.col("profanity"), n),
        *[("marks", c, F.round(F.col(c) / n, 2), n) for c in ("hashtags", "mentions", "links")], ("openings", "distinct_first_words", F.col("openers"), n_sent),
        *[("persons", k, F.round(1000 * F.col(k) / F.when(n_words > 0, n_words), 1), n_words) for k in PERSONS],
    ]
    sums = both.select("by", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.lit(k).alias("name"), v.cast("double").alias("value"), m.cast("long").alias("n")) for b, k, v, m in figures])).alias("f")).select("by", "f.*")
    lengths = [_quantiles(sents.select("by", F.col("n_words").alias("v"), "k"), "sentence_length"), _quantiles(per_sample.select("by", F.col("words").alias("v"), "k"), "sample_length")]
    of = per_sample.groupBy("by").agg(s("k").alias("n"))
    opening = _shares(sents.where("shapes is not null").select("by", F.explode("shapes").alias("name"), "k"), of, "opening")
    closing = _shares(sents.where("last").select("by", F.col("closing").alias("name"), "k"), of, "closing")
    return reduce(DataFrame.unionByName, [sums, *lengths, opening, closing])


def _quantiles(values: DataFrame, block: str) -> DataFrame:
    """Exact quantiles with linear interpolation, from counts (k) of each value."""
    counts = values.groupBy("by", "v").agg(F.sum("k").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("by").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("k").over(Window.partitionBy("by"))})
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in (("min", 0.0), ("p10", 0.1), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("max", 1.0))])).alias("a")
    place = F.col("a.q") * (F.col("n") - 1)
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("v")))
    found = ranked.select("*", asked).withColumns({"lo": F.floor(place), "hi": F.ceil(place), "part": place - F.floor(place)})
    out = found.groupBy("by", F.col("a.name").alias("name")).agg(F.first("n").alias("n"), F.first("part").alias("part"), at(F.col("lo")).alias("x"), at(F.col("hi")).alias("y"))
    return out.select("by", F.lit(block).alias("block"), "name", F.round(F.col("x") + (F.col("y") - F.col("x")) * F.col("part"), 1).cast("double").alias("value"), F.col("n").cast("long").alias("n"))


def _shares(names: DataFrame, of: DataFrame, block: str) -> DataFrame:
    return names.groupBy("by", "name").agg(F.sum("k").alias("k")).join(of, "by").select("by", F.lit(block).alias("block"), "name", F.round(F.col("k") / F.col("n"), 3).alias("value"), F.col("n").cast("long").alias("n"))


def over_used(samples: DataFrame, reference: DataFrame, top: int = 14, least: int = 3, uses: int = 4) -> DataFrame:
    """by, word, uses, in_samples, lift and place: words used more than ordinary language does, and (lift null) those outside the reference.

    reference: word, per_million. Words of under `least` samples or `uses` uses are left out; `top` of either kind stay.
    """
    said = samples.select("by", "sample", F.explode(C.bare_words(F.col("text"))).alias("word")).groupBy("by", "sample", "word").agg(F.count("*").alias("k"))
    counts = said.groupBy("by", "word").agg(F.sum("k").alias("uses"), F.count("*").alias("in_samples"))
    total = said.groupBy("by").agg(F.sum("k").alias("total"))
    kept = counts.where((F.col("in_samples") >= least) & (F.col("uses") >= uses)).join(total, "by").join(reference, "word", "left")
    lift = F.round(F.col("uses") * 1_000_000 / F.col("total") / F.col("per_million"), 1)
    rated = kept.withColumn("lift", F.when(F.col("per_million") > 0, lift))
    order = Window.partitionBy("by", F.col("lift").isNull()).orderBy(F.desc("lift"), F.desc(F.when(F.col("lift").isNull(), F.col("in_samples"))), F.desc("uses"), "word")
    return rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).select("by", "word", "uses", "in_samples", "lift", "place")


# ---------------------------------------------------------------- drafts


def drafts(moments: DataFrame, voices: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """id, lines (array), n_words, opener, ends_right, n_filler of each moment (id, by, text) that can open: its own sentences, in their order.

    The run begins at the best opener and goes on until the first sentence that would take it past the median length
    of the voice's samples by more than a third; what follows is not looked at. Sentences that carry nothing are passed
    over. A last line that is no sentence goes, unless it is how the voice ends. voices: profile(). verdicts: id, n,
    points of the shape that a sentence opens with (profiles.shape_verdicts), where a niche is measured.
    """
    split = F.filter(F.transform(F.split(F.trim("text"), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")
    rows = moments.select("id", "by", split.alias("all")).where(F.size("all") >= 3).select("id", "by", F.size("all").alias("m"), F.posexplode("all").alias("n", "sent"))
    rows = rows.withColumn("words", F.regexp_count("sent", F.lit("[A-Za-z']+")))
    if verdicts is not None:
        rows = rows.join(verdicts.select("id", "n", "points"), ["id", "n"], "left")
    points = F.coalesce("points", F.lit(0.0)) if verdicts is not None else F.lit(0.0)
    may = F.col("words").between(4, 30) & ~F.col("sent").rlike(LEANS)
    worth = points / 4 + 1 - F.col("n") / F.col("m") + F.when(F.col("words") <= 14, 1.0).otherwise(0.0)
    best = F.max(F.when(may, F.struct(F.round(worth, 9).alias("worth"), (-F.col("n")).alias("n")))).over(Window.partitionBy("id"))
    figure = lambda block, name, value: voices.where((F.col("block") == block) & (F.col("name") == name)).select("by", F.col("value").alias(value))
    voices = settle(voices)  # some figures of each voice
    wanted = figure("sample_length", "median", "median")
    lands = voices.where("block = 'closing'").groupBy("by").agg(F.min_by("name", F.struct(-F.col("value"), "name")).alias("lands"))
    usual = wanted.join(lands, "by", "full")
    if voices.limit(FIGURES + 1).count() <= FIGURES:  # so the sentences need not move to meet them
        usual = F.broadcast(usual)
    run = rows.withColumn("opener", -best["n"]).where("n >= opener").join(usual, "by", "left")
    carries = (F.col("n") == F.col("opener")) | ((F.col("words") >= 2) & ~F.col("sent").rlike(SKIPPED))
    w = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    run = run.where(carries).withColumn("upto", F.sum("words").over(w))
    # the first violation ends the run, whatever would fit behind it
    over = (F.col("upto") > F.coalesce(F.nullif("median", F.lit(0.0)), F.lit(60.0)) * ROOM) & (F.col("n") > F.col("opener"))
    kept = run.withColumn("broken", F.max(over.cast("int")).over(w)).where("broken = 0")
    held = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "sent", "words"))).alias("x"), F.first("opener").alias("opener"), F.first("lands").alias("lands"))
    last, size = F.element_at("x", -1)["sent"], F.size("x")
    lands_right = F.when(F.col("lands") == "question", last.endswith("?")).when(F.col("lands") == "command", last.rlike(C.IMPERATIVE_CLOSE)).when(F.col("lands") == "fragment_like", ~last.rlike(r"[.!?]$")).when(F.col("lands") == "statement", last.endswith(".")).otherwise(True)
    ends_right = (size > 1) & F.coalesce(lands_right, F.lit(False)) & F.element_at("x", -1)["words"].between(3, 26)
    # places of lines that end a sentence; two lines stay in any case
    whole = F.coalesce(F.array_max(F.transform("x", lambda s, i: F.when(s["sent"].rlike(r"[.!?]$"), i + 1))), F.lit(0))
    n = F.when(ends_right, size).otherwise(F.when(size > 2, F.greatest(F.lit(2), whole)).otherwise(size))
    out = held.withColumn("ends_right", ends_right).withColumn("x", F.slice("x", 1, n))
    lines = F.transform("x", lambda s: s["sent"])
    filler = F.size(F.filter(lines, lambda s: F.lower(s).rlike(X.bounded(r"you know|i mean|like,|sort of|kind of|at the end of the day|it is what it is|trust the process|believe in yourself"))))
    return out.select("id", lines.alias("lines"), F.aggregate("x", F.lit(0), lambda a, s: a + s["words"]).alias("n_words"), "opener", "ends_right", filler.alias("n_filler"))


def drift(made: DataFrame, voices: DataFrame) -> DataFrame:
    """id, block, draft, usual: where a draft (id, by, lines) parts from the voice: line length, contractions, questions."""
    get = lambda block, name: F.max(F.when((F.col("block") == block) & (F.col("name") == name), F.col("value")))
    usual = voices.groupBy("by").agg(get("sentence_length", "p25").alias("p25"), get("sentence_length", "p75").alias("p75"), get("contractions", "rate_when_possible").alias("contracts"), get("punctuation", "question_rate").alias("asks"))
    text = F.array_join("lines", " ")
    lens = F.array_sort(F.transform("lines", lambda s: F.regexp_count(s, F.lit("[A-Za-z']+"))))
    got = F.regexp_count(F.lower(text), F.lit(X.LEFT + r"\w+'(?:t|s|re|ve|ll|d|m)" + X.RIGHT))
    chances = got + C.long_forms(text)
    own = made.where(F.size("lines") > 0).withColumns({"median": F.get(lens, F.floor(F.size("lines") / 2).cast("int")), "got": got, "chances": chances, "asked": F.size(F.filter("lines", lambda s: F.rtrim(s).endswith("?"))) / F.size("lines")}).join(usual, "by")
    rate = F.col("got") / F.when(F.col("chances") > 0, F.col("chances"))
    found = [
        F.when((F.col("p25") > 0) & (F.col("p75") > 0) & ~F.col("median").between(F.col("p25"), F.col("p75")), F.struct(F.lit("sentence_length").alias("block"), F.col("median").cast("double").alias("draft"), F.when(F.col("median") < F.col("p25"), F.col("p25")).otherwise(F.col("p75")).alias("usual"))),
        F.when((F.col("chances") >= 3) & (F.abs(rate - F.col("contracts")) > 0.3), F.struct(F.lit("contractions").alias("block"), F.round(rate, 3).alias("draft"), F.col("contracts").alias("usual"))),
        F.when(F.col("asked") - F.col("asks") > 0.25, F.struct(F.lit("questions").alias("block"), F.round("asked", 3).alias("draft"), F.col("asks").alias("usual"))),
    ]
    return own.select("id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("id", "f.*")
