"""Rules with evidence: faults of a clip and of its cards, as arrays of structs; the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.speech import LEFT, RIGHT, stands_as_question
from ..functions.text import END, START, free_names

#: A change of direction, something at risk, an unfinished tail, words that carry nothing.
TURN = START + r"(but|however|except|instead|actually|turns out|the problem is|here'?s the thing|until|then one day|and then|the truth is|what changed|what nobody|most people|everyone thinks|i used to|i thought)" + END
STAKES = START + r"(cost|lost|lose|losing|broke|failed|failing|fail|quit|quitting|debt|afraid|scared|wrong|mistake|ruin|destroyed|nearly|almost|worst|hardest|hurt|resent|divorce|burn(ed|t)? out|rock bottom|gave up)" + END
TAIL = r"(,|;|:|(?:^|[^\p{L}\p{N}_])(and|but|so|because|which|that))\s*$"
FILLER = r"^\s*(um+|uh+|er+|ah+|yeah|right|okay|ok|so|well|like|you know)[\s,.]*$"
PLACEHOLDER = START + r"(x\.?\s?y\.?\s?z|blah\s*blah|yada\s*yada|dot\s+dot\s+dot|so\s+on\s+and\s+so\s+forth|insert\s+[A-Za-z0-9_]+\s+here)" + END


SOFT_CONNECTIVE = r"^\s*(so|and|but|because|anyway|anyways|also|plus|however|therefore|thus|then|again|now|well|right|okay|ok)"
DANGLING = r"^[\"'“‘(]*(?:and|but|or|because|also|plus|then|anyway|anyways|which|therefore|thus|hence|so)[,\s]"
HARD_CONTINUATION = r"^\s*(and |so |but )?(that'?s (exactly )?(why|what|how|when|where)|which is why|that is why|this is why|which means|that means|it'?s (exactly )?(why|what)|hence|ergo)"
ORPHAN = r"^\s*(he|she|its|it|they|them|him|hers|her|his|theirs|their|this|that|these|those|one|both|such)"
STANDS = r"^(who|what|why|when|where|how|which|can|could|should|do|does|did|is|are|was|were|if|most|every|nobody|everyone|here|there'?s a|the|a|an|my|our|i |we )"
REFERENCE = r"as i (said|mentioned)|like i said|earlier|a minute ago|before the break|back to|going back|as we discussed|in the last (episode|video|part)|we talked about|i told you|coming up|in a (second|minute|moment)|stay tuned|next (week|episode|time)|last (week|episode|time)|thank(s| you) for (listening|watching|joining)|if you made it (through|this far)|this (whole |entire )?(video|recording|session|call|class|training)|record(ing|ed)? (two|2|another|a second) version|we('re| are) (closing out|wrapping up|out of time|almost done)|i(''|')?ll leave you with|leave you with this|welcome (to|back to) (week|day|session|part|module)|workbooks?|worksheets?|handouts?|the slides|lock in with me|stick with me|stay with me|follow along|as we go through (this|it)|let'?s dive (in|into)|last (session|class|call)|next (session|class|call)|that(''|')?s your homework|for homework|see you (next|then)|before we (go|finish|wrap)"
LONGEST_OPENING, EVIDENCE = 34, 110


def _fault(when: Column, name: str, severity: str, evidence: Column) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("fault"), F.lit(severity).alias("severity"), evidence.alias("evidence")))


def clip_faults(clips: DataFrame) -> DataFrame:
    """id, sents array<string> -> faults array, verdict. No sentence at all is fatal.

    Each fault names the sentence that caused it. Of the opening's faults only the first holds: a dangling
    connective, a continuation, an unresolved pronoun, a connective before words that do not stand alone.
    """
    low = lambda p: "(?i)" + p
    has = F.size("sents") > 0
    names = free_names(clips, "first", "last", "body", "rest")
    at = dict(zip(("first", "last", "body", "rest"), map(F.col, names), strict=True))
    first, last, body, rest = at["first"], at["last"], at["body"], at["rest"]
    out = clips.withColumns({names[0]: F.get("sents", F.lit(0)), names[1]: F.try_element_at("sents", F.lit(-1)), names[2]: F.array_join("sents", " ")})
    out = out.withColumn(names[3], F.trim(F.regexp_replace(first, low(SOFT_CONNECTIVE) + RIGHT + r"[,\s]*", "")))
    head = F.substring(first, 1, EVIDENCE)
    ended = last.rlike(r"[.!?]$")
    stem = F.regexp_replace(last, r"[.!?]+$", "")
    cut_off = stem.rlike(low(TAIL)) & ~(ended & stem.rlike(low(START + r"(that|so)\s*$")))
    alone = rest.rlike(low(STANDS)) | rest.endswith("?")
    opening = F.coalesce(
        _fault(first.rlike(low(DANGLING)) & ~stands_as_question(first), "opens on a dangling connective", "fatal", head),
        _fault(first.rlike(low(HARD_CONTINUATION) + RIGHT), "opens mid argument", "fatal", head),
        _fault(rest.rlike(low(ORPHAN) + RIGHT), "opens on an unresolved pronoun", "fatal", head),
        _fault((rest != F.trim(first)) & ~alone, "opens mid argument", "serious", head),
    )

    def any_sentence(pattern: str, name: str) -> Column:
        hit = F.get(F.filter("sents", lambda x: x.rlike(pattern)), F.lit(0))
        return _fault(hit.isNotNull(), name, "serious", F.substring(hit, 1, EVIDENCE))

    found = [
        _fault(~has, "empty", "fatal", F.lit("")),
        opening,
        _fault(first.rlike(low(FILLER)), "opens on filler", "serious", head),
        _fault(F.regexp_count(first, F.lit("[A-Za-z']+")) > LONGEST_OPENING, "opening sentence is long", "minor", head),
        any_sentence(low(LEFT + "(" + REFERENCE + ")" + RIGHT), "refers to the rest of the recording"),
        _fault(cut_off | ~ended, "ends mid sentence", "fatal", F.substring(last, -EVIDENCE, EVIDENCE)),
        _fault(last.rlike(low(FILLER)), "ends on filler", "serious", F.substring(last, 1, EVIDENCE)),
        _fault(has & ~body.rlike(low(TURN)), "no turn", "serious", F.lit("")),
        _fault(has & ~body.rlike(low(STAKES)), "nothing at stake", "minor", F.lit("")),
        _fault(has & (F.size("sents") < 3), "too few sentences", "serious", F.lit("")),
        any_sentence(low(PLACEHOLDER), "says a placeholder out loud"),
    ]
    out = out.withColumn("faults", F.array_compact(F.array(*found)))
    return out.withColumn("verdict", _verdict()).drop(*names)


def misheard_faults(clips: DataFrame, suspects: DataFrame) -> DataFrame:
    """id, fault, severity and evidence where a clip (id, rec, body) holds a misheard run (rec, heard, probably) of its recording."""
    hit = clips.join(suspects, "rec").where(F.contains(F.lower("body"), F.lower("heard")))
    by = hit.groupBy("id", "probably").agg(F.min("heard").alias("evidence"))
    return by.select("id", F.lit("may contain a mis-heard word").alias("fault"), F.lit("serious").alias("severity"), "evidence")


def sense(clips: DataFrame, suspects: DataFrame) -> DataFrame:
    """clip_faults of clips (id, rec, sents, seconds) with mis-heard words among the faults and in the verdict, and note: their pace.

    suspects: rec, heard, probably.
    """
    own = clip_faults(clips).withColumn("body", F.array_join("sents", " "))
    heard = misheard_faults(own, suspects).select("id", F.struct("fault", "severity", "evidence").alias("x")).groupBy("id").agg(F.array_sort(F.collect_list("x")).alias("more"))
    both = own.join(heard, "id", "left").withColumn("faults", F.concat("faults", F.coalesce("more", F.array().cast(dict(own.dtypes)["faults"]))))
    words = F.regexp_count("body", F.lit("[A-Za-z']+"))
    return both.withColumn("verdict", _verdict()).withColumn("note", pace(words, F.col("seconds"))).drop("more", "body")


def _verdict() -> Column:
    """2: a fatal fault; 1: two serious ones; else 0."""
    count = lambda s: F.size(F.filter("faults", lambda f: f["severity"] == s))
    return F.when(count("fatal") > 0, 2).when(count("serious") >= 2, 1).otherwise(0)


def pace(words: Column, seconds: Column) -> Column:
    """A note where speech is slower than 95 or faster than 210 words a minute."""
    rate = words / (seconds / 60.0)
    return F.when((seconds > 0) & (words > 0), F.when(rate < 95, "slow").when(rate > 210, "fast"))


def card_faults(cards: DataFrame, most: int = 4, longest: float = 3.01) -> DataFrame:
    """rec, card, text, start, end and following (the next card's start) -> kind, a row for each fault."""
    n = F.size(F.filter(F.split("text", " +"), lambda w: w != ""))
    kinds = [F.when(n == 0, F.lit("empty")), F.when(n > most, F.lit("word-ceiling")), F.when(F.col("end") <= F.col("start"), F.lit("inverted")), F.when(F.col("end") - F.col("start") > longest, F.lit("held")), F.when(F.col("following") < F.col("end") - 0.02, F.lit("overlap")), F.when(F.col("text").rlike(r"(?i)" + FILLER), F.lit("filler"))]
    return cards.select("rec", "card", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
