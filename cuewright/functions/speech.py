"""Column expressions over spoken sentences: cleaning, terminals, features, openers and closers.

Word edges are those of letters, digits and underscore in any script. Null text gives null or empty results.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
SPACES = r"[ \t\n\r\f\x0B]+"
#: Different texts that are broadcast with what is known of them.
FEW = 20_000

#: Numbers as words.
NUMBER_WORDS = ["two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "percent", "dollars", "double", "triple", "half"]
#: Fixed values: (pattern of a word run, label) of a turn in the thought; "but yeah" is none.
CONTRAST = [
    (r"but(?!\s+yeah)", "but"),
    (r"until", "until"),
    (r"turns out", "turns out"),
    (r"the (?:problem|catch|truth|trick|real [\p{L}\p{N}_]+|actual [\p{L}\p{N}_]+|thing) (?:is|was)", "the problem is"),
    (r"except", "except"),
    (r"instead", "instead"),
    (r"actually", "actually"),
    (r"however", "however"),
    (r"in fact", "in fact"),
    (r"that'?s when", "that's when"),
    (r"here'?s the thing", "here's the thing"),
    (r"i (?:realized|realised|didn'?t realize|didn'?t realise)", "I realized"),
]
#: What every match of a turn holds: looked for first, since a search for a fixed text is far cheaper.
HOLDS = {"the problem is": "the ", "that's when": "s when", "here's the thing": "s the thing", "I realized": "reali"}
#: Words of address, fillers, acknowledgements, connectives, closings, promotion, pronouns.
YOU = ["you", "your", "yours", "yourself"]
FILLER = r"um+|uh+|uhm+|er|erm|hmm+|mm+-?hmm+|you know|kind of|sort of|i mean|basically|literally|i guess|or whatever|and stuff|and things|and yeah|so yeah"
#: Fixed value: a filler only where a word follows at once.
FILLER_LIKE = r"like,"
ACK = r"^(?:yeah|yes|yep|right|okay|ok|alright|sure|mm+-?hmm+|mm+|uh-huh|exactly|totally|true|cool|nice|great|wow|oh|ah|thanks|thank you|yeah yeah|no)[^\p{L}\p{N}_]*$"
OPENER = r"^[\"'“‘(]*(?:and|but|because|so|which|or|plus|then|anyway|anyways|yeah|right|okay|ok|alright|well|mm+|uh|um|oh|that'?s why|that'?s what|which is why)(?:[ ,]|$)"
CLOSE_STRONG = r"never|always|nothing|everything|only|real|the point|that'?s (?:the|why|what|how)|is not|isn'?t|is a|is the|means|not a|not the|none of|all of"
CLOSE_WEAK_START = r"^(?:so )?(?:yeah|anyway|anyways|okay|alright|right|whatever|thank you|thanks|you know|i don'?t know|um|uh)"
CLOSE_WEAK_END = r"(?:stuff|things|or whatever|you know|and yeah|i guess|and so on)[^\p{L}\p{N}_]*$"
PROMO = r"sponsor|sponsored|brought to you by|use the code|promo code|show notes|leave a review|subscribe|like and subscribe|thanks for listening|thank you all for listening|welcome back|see you next (?:week|time)|link in (?:the )?(?:bio|description)"
ANAPHOR = r"^[\"'“‘(]*(?:it|that|this|these|those|they|he|she|there|then|which|the next)"
TAG = r",\s*(?:right|yeah|yes|no|nope|okay|ok|correct|true|see|you know|isn'?t it|aren'?t they|don'?t you|doesn'?t it|didn'?t you|wasn'?t it|haven'?t you|hasn'?t it|won'?t you|can'?t you)\s*\?*\s*$"
INTERROGATIVE = r"^[\"'“‘(]*(?:what|why|how|when|where|who|whom|whose|which|do|does|did|is|are|am|was|were|can|could|will|would|should|shall|have|has|had|may|might|must|ain'?t|isn'?t|aren'?t|wasn'?t|weren'?t|don'?t|doesn'?t|didn'?t|can'?t|couldn'?t|won'?t|wouldn'?t|shouldn'?t)"
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "st.", "vs.", "e.g.", "i.e.", "etc.", "a.m.", "p.m.", "u.s.", "no.", "inc.", "jr.", "sr.", "prof."]
NAME_STOP = ["I", "I'm", "I'll", "I've", "I'd", "OK", "Okay", "Yeah", "Yes", "No", "So", "And", "But", "Um", "Uh", "Oh", "Well", "Right", "Alright"]
TERMINAL = r"[.?!]+[\"')\]”’]*$"
SPEAKER = r"^(?:>>\s*|-\s+|(?:SPEAKER[ _]?\d+|[A-Z]{2,}(?: [A-Z]{2,})?)\s*:\s*)"
NOISES = r"(?i)\[[^\]]{0,30}\]|\((?:music|laughs?|laughter|applause|inaudible)[^)]*\)"


def bounded(pattern: str) -> str:
    return f"{LEFT}(?:{pattern}){RIGHT}"


def clean_cue(text: Column) -> Column:
    """Without tags, style braces, and bracketed or named noises (which leave a blank)."""
    out = F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), r"\{\\[^}]*\}", "")
    return F.regexp_replace(out, NOISES, " ")


def ends_terminal(word: Column) -> Column:
    return word.rlike(TERMINAL)


def is_terminal(word: Column, following: Column) -> Column:
    """The word ends a sentence: no abbreviation, and a full stop only before a capital, a digit or nothing."""
    sure = word.rlike(r"[?!][\"')\]”’]*$") | following.isNull() | following.rlike(r"^[\"'“‘(\[]*[A-Z0-9]")
    return ends_terminal(word) & ~F.lower(word).isin(ABBREVIATIONS) & sure


def stands_as_question(text: Column) -> Column:
    """Without its connective an interrogative is left, and no mere tag."""
    rest = F.trim(F.regexp_replace(F.trim(text), "(?i)" + OPENER, ""))
    return (rest != "") & ~rest.rlike("(?i)" + TAG) & rest.rlike("(?i)" + INTERROGATIVE + RIGHT)


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda t: t != "")


def numbers(text: Column) -> Column:
    """Tokens with a digit, and hyphenated words with a number word among their parts."""
    raw = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9'’\-\.,$%]+"), F.lit(0))
    some = "(?i)[0-9]|" + "|".join(NUMBER_WORDS)  # few texts and few of their tokens are left to be taken apart
    raw = F.when(F.coalesce(text.rlike(some), F.lit(True)), F.filter(raw, lambda t: t.rlike(some))).otherwise(F.array().cast("array<string>"))

    def own(token):
        plain = F.lower(F.regexp_replace(token, "^[.,'’]+|[.,'’]+$", ""))
        spoken = F.arrays_overlap(F.split(plain, "-"), F.array(*[F.lit(w) for w in NUMBER_WORDS]))
        return F.when(plain.rlike("[0-9]"), F.regexp_replace(token, "^[.,]+|[.,]+$", "")).when(spoken, plain)

    return F.array_compact(F.transform(raw, own))


def names(text: Column) -> Column:
    """Capitalised words after the first, runs of them joined; all-capital words and a few others are none."""
    edge = r"[.,?!;:\"'()“”‘’]+"

    def own(token, k):
        plain = F.regexp_replace(token, f"^{edge}|{edge}$", "")
        head = F.substring(plain, 1, 1)
        shout = (plain == F.upper(plain)) & (F.upper(plain) != F.lower(plain))
        return F.when((k > 0) & (token != F.lower(token)) & (F.length(plain) > 1) & (head == F.upper(head)) & (head != F.lower(head)) & ~plain.isin(NAME_STOP) & ~shout, plain).otherwise("\u0001")

    joined = F.array_join(F.transform(split_words(text), own), " ")
    return F.filter(F.transform(F.split(joined, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def contrast(text: Column) -> Column:
    """Labels of the turns that the text makes."""
    def own(low):
        negated = low.contains("not") | low.contains("isn") | low.contains("wasn")
        spread = negated & low.rlike(LEFT + r"(?:wasn'?t|isn'?t|not)" + RIGHT + r"[^.?!]{0,50}" + bounded(r"it was|it is|it'?s|but"))
        turns = [F.when(low.contains(HOLDS.get(label, label)) & low.rlike(bounded(p)), F.lit(label)) for p, label in CONTRAST]
        return F.array_compact(F.array(*turns, F.when(spread, F.lit("not X, it is Y"))))

    return F.get(F.transform(F.array(F.lower(text)), own), F.lit(0))  # lower-cased once for all of them


def addresses(text: Column) -> Column:
    own = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.size(F.filter(own, lambda w: w.isin(YOU)))


def fillers(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(bounded(FILLER) + "|" + LEFT + FILLER_LIKE + r"(?=[\p{L}\p{N}_])"))


def features(text: Column) -> dict[str, Column]:
    """Columns of what a sentence carries: n_words, is_question, numbers, names, contrast, you, filler, is_ack, exclaims, promo, bad_opener, dead."""
    low = F.lower(text)
    n_words = F.size(split_words(text))
    question = F.regexp_replace(text, r"[\"')”’ ]+$", "").endswith("?") & (n_words >= 4)
    ack = F.trim(low).rlike(ACK) | ((n_words <= 2) & ~question)
    filler = fillers(text) + ack.cast("int")
    promo = low.rlike(bounded(PROMO))
    carried = reduce(or_, [F.size(numbers(text)) > 0, F.size(names(text)) > 0, F.size(contrast(text)) > 0, addresses(text) > 0, question, low.rlike(bounded(CLOSE_STRONG))])
    return {
        "n_words": n_words,
        "is_question": question,
        "numbers": numbers(text),
        "names": names(text),
        "contrast": contrast(text),
        "you": addresses(text),
        "filler": filler,
        "is_ack": ack,
        "exclaims": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "promo": promo,
        "bad_opener": (text.rlike("(?i)" + OPENER) & ~stands_as_question(text)) | ack,
        "dead": ack | (filler > 0) | promo | ((n_words <= 4) & ~carried),
    }


def once_each(df: DataFrame, own: dict[str, Column], key: str = "text") -> DataFrame:
    """df with columns `own` over its text (named by key), made once for each different text.

    Speech repeats itself, and what is asked of a text costs far more than to bring the answer to its rows. Up to FEW
    different texts are broadcast; beyond, rows and texts meet by a shuffle.
    """
    texts = df.select(key).distinct()
    known = texts.select(F.col(key).alias("_said"), F.struct(*[c.alias(n) for n, c in own.items()]).alias("_own"))
    known = F.broadcast(known) if texts.limit(FEW + 1).count() <= FEW else known
    kept = [c for c in df.columns if c not in own]
    return df.join(known, F.col(key).eqNullSafe(F.col("_said")), "left").select(*kept, *[F.col("_own")[n].alias(n) for n in own])


def leans_back(text: Column) -> Column:
    return text.rlike("(?i)" + ANAPHOR + RIGHT)


def closes_weakly(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(CLOSE_WEAK_START + RIGHT) | low.rlike(CLOSE_WEAK_END)


def closes_strongly(text: Column) -> Column:
    return F.lower(text).rlike(bounded(CLOSE_STRONG))
