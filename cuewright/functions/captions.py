"""Column expressions over captions and cards: one spelling, negations, clauses, openings, closings, tags, links.

Null text gives null, or an empty list.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .speech import LEFT, RIGHT, bounded, split_words

#: Words that negate, put a condition, compare, continue or order.
NEGATION = ["not", "no", "never", "none", "nothing", "nobody", "noone", "nowhere", "neither", "nor", "cannot", "without", "hardly", "barely", "scarcely", "rarely", "seldom", "lack", "lacks", "lacking", "untrue", "unable"]
CONDITION = ["if", "when", "whenever", "unless", "until", "because"]
COMPARISON = ["than", "rather", "instead", "versus", "vs", "compared", "opposed", "whereas"]
CONTINUATION = ["and", "but", "or", "so", "then", "yet", "that", "which", "who", "whose", "because", "while", "whereas"]
DIRECTIVE = ["stop", "start", "go", "do", "dont", "don't", "make", "take", "get", "keep", "give", "let", "ask", "say", "tell", "think", "quit", "remember", "forget", "choose", "build", "write", "call", "chase", "sell", "buy", "come", "show", "put", "use", "try", "look", "listen", "believe", "be", "have", "stay", "leave", "move", "pick", "drop", "run", "push", "pull", "please", "never", "always"]
FINITE = ["is", "are", "was", "were", "am", "has", "have", "had", "do", "does", "did", "can", "could", "will", "would", "shall", "should", "may", "might", "must", "becomes", "became", "gets", "got", "goes", "went", "comes", "came", "feels", "felt", "needs", "need", "makes", "made", "takes", "took", "wins", "win", "stays", "happens", "means", "says", "tells", "wants", "lives", "costs"]
SUBJECT = ["i", "you", "we", "they", "he", "she", "it", "that", "this", "there", "who", "what", "nothing", "everything", "nobody", "everybody", "money", "people"]
DETERMINER = ["the", "a", "an", "this", "that", "these", "those", "my", "your", "his", "her", "their", "our", "its", "no", "some", "every", "all"]
#: Somebody is quoted, or what somebody may do is granted.
VOICING = r"(?:i|he|she|it|they|we|you|brain|mind|ego|voice|heart|body|spirit|everyone|people|somebody|someone)\s+(?:was\s+|were\s+|am\s+|is\s+|are\s+)?(?:say|says|said|saying|tell|tells|told|telling|think|thinks|thought|thinking|ask|asks|asked|asking)|i'?m\s+like|you'?re\s+like|they'?re\s+like|it'?s\s+like"
PERMISSION = r"(?:you|we|i)\s*(?:'?(?:d|ll|re|ve))?\s*(?:can|could|may|might|should|get\s+to|are\s+allowed\s+to|want\s+to|wanna|have\s+permission)|do\s+you\s+want\s+to|do\s+you\s+need\s+to|all\s+you\s+have\s+to"
#: What may open a clause without being its own word; words that a repeated phrase's ending is not judged by; words that hang at a card's end.
COORDINATION = ["and", "but", "or", "so", "then", "yet", "because"]
TAIL_STOP = ["a", "an", "the", "to", "be", "is", "are", "was", "of", "in", "on", "it", "it's", "that", "and", "or", "but", "so", "like", "just", "very", "then", "i", "you", "we"]
DANGLING = ["at", "to", "from", "of", "with", "for", "in", "on", "about", "by", "and", "or", "but", "that", "than", "as", "is", "was", "are", "the", "a"]
CONTRACTED = r"'(?:s|re|m|ll|d|ve)$"
#: What a voice is measured by.
VOICE_SHAPES = {
    "question": r"^(how|what|why|when|where|who|which|can|should|is|are|do|does|did|if)",
    "number": r"^[^\p{L}\p{N}_]*(?:\d+|one|two|three|four|five|six|seven|eight|nine|ten)",
    "imperative": r"^(stop|start|never|always|don'?t|do not|avoid|try|watch|listen|read|build|make|get|go|take|tell|ask|look|save|share|follow|remember|think about|notice)",
    "first_person": r"^(i|i'?m|i'?ve|i'?d|i'?ll|we|we'?re|my|our|me)",
    "you": r"^(you|you'?re|you'?ve|your|yours)",
    "conjunction": r"^(and|but|so|because|or|yet|which)",
}
CONTRACTION = r"[\p{L}\p{N}_]+n't|(?:i|you|we|they|he|she|it|that|there|here|what|who|how|let)'(?:s|re|ve|ll|d|m)|y'all|ain't|gonna|gotta|wanna"
LONG_FORM = r"do not|does not|did not|is not|are not|was not|were not|cannot|can not|could not|would not|should not|will not|have not|has not|had not|it is|that is|there is|here is|i am|you are|we are|they are|he is|she is|let us|i have|i will|i would|you will|we will|going to"
IMPERATIVE_CLOSE = r"^(stop|start|go|get|do|don'?t|never|always|try|make|take|tell|ask|look|listen|watch|read|write|build|send|save|follow|share|comment|drop|book|click|tap|join|remember|keep|let|give|pick|choose|say|put|use|call|dm|message|subscribe|sign|grab|check|bring|find|open|close|run|wait|come)"
VERBS = "is are was were am be been being do does did done have has had get got go goes going went come came take took taken make made makes say says said see saw seen know knew known think thought want wanted need needed feel felt give gave look looks looked tell told ask asked try tried keep kept put find found works work worked happen happened happens means meant will would can could should may might must let lets stop stops stopped start started matters mattered counts counted costs cost pays paid sells sold buys bought wins won lose lost loses built build builds show showed shown becomes became".split()
HASHTAG, MENTION, URL = r"#[\p{L}\p{N}_]+", r"@[\p{L}\p{N}_.]+", r"https?://\S+|www\.\S+"
#: Content words leave these out.
STOP = """a about above after again against all also am an and any are aren't as at be because been before being below between both but by can cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he their here theirs themselves him himself his how i i'm i've if in into is isn't it it's its itself just like me more most my myself no nor not now of off on once only or other ought our ours ourselves out over own really same they should shouldn't so some such than that that's the their theirs them themselves then there there's these they this those through to too under until up very was wasn't we were weren't what what's when where which while who whom why will with won't would wouldn't you your yours yourself yourselves get got go going gonna know think thing things say said says saying want wants right okay ok yeah yes one two""".split()
STRONG = r"^(?:never|always|nothing|everything|everyone|nobody|none|only|every|all|most|worst|best|first|last|free|real|wrong|right|stop|start|instead|until|unless|but|because|problem|truth|point|secret|mistake|reason|why|how|what|everything|anything|twice|double|half)$"
ACCENT_STOP = ["the", "a", "an", "and", "or", "of", "to", "in", "on", "at", "is", "it", "that", "this", "was", "for", "with", "as", "be", "are", "you", "your", "i", "my", "we", "they", "he", "she", "do", "did", "so", "if", "then", "than", "but", "not", "no", "can", "will", "just", "have", "has", "had", "been", "would", "could", "should", "there", "here", "what", "when", "who", "out", "up", "one", "me", "them", "him"]


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def flat(text: Column) -> Column:
    """One spelling: ASCII quotes, dashes set apart, single blanks, lower case."""
    out = F.regexp_replace(F.regexp_replace(text, "[‘’‛]", "'"), "[“”‟]", '"')
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, "—|–|‒|--", " -- "), r"\s+", " ")))


def tokens(text: Column) -> Column:
    return _all(flat(text), "[a-z0-9$']+")


def is_negation(token: Column) -> Column:
    return token.isin(NEGATION) | token.endswith("n't")


def negations(text: Column) -> Column:
    return F.filter(tokens(text), is_negation)


def hits(text: Column, vocabulary: list[str]) -> Column:
    return F.filter(tokens(text), lambda t: t.isin(vocabulary))


def overlap(card: Column, line: Column) -> Column:
    """The share of the card's words that the line has."""
    own, there = tokens(card), tokens(line)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.size(F.filter(own, lambda t: F.array_contains(there, t))) / F.size(own))


def stands_alone(text: Column) -> Column:
    """A whole sentence by itself: an order, a contraction, or a subject with a finite verb within three words."""
    return whole(tokens(text))


def whole(t: Column) -> Column:
    """stands_alone over tokens."""
    verb = lambda w: w.isin(FINITE) | w.rlike(CONTRACTED)
    order = F.coalesce(F.get(t, F.lit(0)).isin(DIRECTIVE), F.lit(False))
    said = F.exists(F.transform(t, lambda w, i: w.isin(SUBJECT + DETERMINER) & F.exists(F.slice(t, i + 2, 3), verb)), lambda x: x)
    return order | F.exists(t, lambda w: w.rlike(CONTRACTED)) | said


def voiced(text: Column) -> Column:
    return text.rlike("(?i)" + bounded(VOICING) + "|" + LEFT + r"(?:goes|went)\s*,")


def clauses(text: Column) -> Column:
    """Pieces at commas, semicolons, colons and dashes; a conjunction after three words begins another."""
    parts = F.split(flat(text), r"\s*[,;:]\s*|\s+--+\s*|\s*--+\s+")
    step = lambda a, w: F.when(  # noqa: E731  one string: a line break parts the pieces
        w.isin("and", "but", "or") & (F.size(F.split(F.substring_index(a, "\n", -1), " ")) >= 3) & (F.substring_index(a, "\n", -1) != ""), F.concat(a, F.lit("\n"), w)
    ).otherwise(F.when((a == "") | a.endswith("\n"), F.concat(a, w)).otherwise(F.concat(a, F.lit(" "), w)))
    cut = lambda p: F.aggregate(F.filter(F.split(p, " "), lambda w: w != ""), F.lit(""), step)
    out = F.filter(F.flatten(F.transform(parts, lambda p: F.split(cut(p), "\n"))), lambda x: x != "")
    return F.when(F.size(out) == 0, F.array(flat(text))).otherwise(out)


def opens_with_words(text: Column) -> Column:
    head = F.regexp_replace(text, r"^\s+", "")
    return (head != "") & ~head.rlike(r"^[#@][\p{L}\p{N}_.]+")


def leading_tags(text: Column) -> Column:
    """The run of hashtags and handles that the text opens with, if a line end follows."""
    return F.trim(F.regexp_extract(text, r"^((?:[#@][\p{L}\p{N}_.]+[ \t]*)+)(?:\n+|$)", 1))


def strip_tags(text: Column, keep: int) -> Column:
    """Without the hashtags past the first `keep`."""
    parts = F.split(F.regexp_replace(text, r"(\s+)", "\u0001$1\u0001"), "\u0001")
    tag = lambda t: t.rlike("^" + HASHTAG + "$")
    kept = F.filter(F.transform(parts, lambda t, i: F.when(tag(t) & (F.size(F.filter(F.slice(parts, 1, i + 1), tag)) > keep), F.lit(None)).otherwise(t)), lambda t: t.isNotNull())
    return F.trim(F.regexp_replace(F.array_join(kept, ""), r"[ \t]{2,}", " "))


def without_links(text: Column) -> Column:
    return F.when(text.rlike(URL), F.trim(F.regexp_replace(text, r"\s*(?:" + URL + r")\s*", " "))).otherwise(text)


def linked_in_bio(text: Column, phrase: str) -> Column:
    """The first link is replaced by the phrase, the others go."""
    at = F.regexp_instr(text, F.lit(URL))
    first = F.regexp_extract(text, "(" + URL + ")", 1)
    out = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(phrase), F.regexp_replace(F.substring(text, at + F.length(first), F.length(text)), URL, ""))
    return F.when(at > 0, F.trim(F.regexp_replace(out, r"[ \t]{2,}", " "))).otherwise(text)


def contractions(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(bounded(CONTRACTION)))


def long_forms(text: Column) -> Column:
    return F.regexp_count(F.lower(text), F.lit(bounded(LONG_FORM)))


def opening_shapes(text: Column) -> Column:
    """Names of the shapes that a sentence opens with, in their order."""
    return F.array_compact(F.array(*[F.when(F.ltrim(text).rlike("(?i)" + p + RIGHT), F.lit(n)) for n, p in VOICE_SHAPES.items()]))


def closing(sentence: Column) -> Column:
    """question, command, fragment_like or statement."""
    terminal = F.regexp_extract(sentence, r"([.!?…]+)[\"')\]]*$", 1)
    own = _all(F.lower(sentence), r"[a-z][a-z'\-]*")
    fragment = ((terminal == "") & (F.size(own) <= 6)) | (~F.exists(own, lambda w: w.isin(VERBS)) & (F.size(own) <= 5))
    return F.when(terminal.contains("?"), "question").when(F.trim(sentence).rlike("(?i)" + IMPERATIVE_CLOSE + RIGHT), "command").when(fragment, "fragment_like").otherwise("statement")


def plain(text: Column) -> Column:
    """Markdown furniture and links off, words left alone."""
    for pattern, new in (
        (r"(?s)```.*?```", " "), (r"`([^`]*)`", "$1"), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s{0,3}#{1,6}\s*", ""),
        (r"(?m)^\s{0,3}>\s?", ""), (r"(?m)^\s{0,3}[-*+]\s+", ""), (r"(?m)^\s{0,3}\d+[.)]\s+", ""), (r"[*_]{1,3}([^*_]+)[*_]{1,3}", "$1"),
    ):
        text = F.regexp_replace(text, pattern, new)
    return text


def content_terms(text: Column) -> Column:
    """Words of four characters and more, or with a digit, that are no stop words; repeats kept."""
    own = F.transform(_all(F.lower(text), r"[a-z0-9][a-z0-9'’\-]*"), lambda t: F.regexp_replace(t, r"^['’\-]+|['’\-]+$", ""))
    return F.filter(own, lambda t: ((F.length(t) >= 4) | t.rlike("[0-9]")) & ~t.isin(STOP))


def topic_slug(text: Column, backup: Column, words: int = 7) -> Column:
    """Up to `words` content words joined by hyphens, from the backup where the text has under three; `clip` at last."""

    def bits(x):
        own = F.filter(_all(F.lower(x), r"[a-z0-9][a-z0-9'’\-]*"), lambda t: ~F.regexp_replace(t, r"^['’\-]+|['’\-]+$", "").isin(STOP))
        return F.filter(F.transform(own, lambda t: F.regexp_replace(F.regexp_replace(t, "['’]", ""), "^-+|-+$", "")), lambda t: t != "")

    own = F.slice(bits(text), 1, words)
    filled = F.when(F.size(own) < 3, F.slice(F.concat(own, F.array_except(F.array_distinct(bits(backup)), own)), 1, words)).otherwise(own)
    return F.when(F.size(filled) == 0, F.lit("clip")).otherwise(F.array_join(filled, "-"))


def first_sentence(text: Column, words: int = 12) -> Column:
    """The first sentence, cut to so many words and marked."""
    own = split_words(F.get(F.split(F.trim(text), r"(?<=[.?!])\s+"), F.lit(0)))
    return F.concat(F.array_join(F.slice(own, 1, words), " "), F.when(F.size(own) > words, "...").otherwise(""))


def accent(card: Column, least: float = 2.0) -> Column:
    """The card's word that carries it: one with a digit, a strong one, a long one; the first of the best, null below `least`."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"^[.,!?;:'\"()\[\]’“”—-]+|[.,!?;:'\"()\[\]’“”—-]+$", "")
    own = F.filter(F.transform(split_words(card), bare), lambda t: (t != "") & ~t.isin(ACCENT_STOP))
    score = lambda t: F.when(t.rlike("[0-9]"), 3.0).when(t.rlike(STRONG), 2.0).when(F.length(t) >= 8, 1.5).when(F.length(t) >= 6, 1.0).otherwise(0.0)
    best = F.array_max(F.transform(own, score))
    return F.when(best >= least, F.get(F.filter(own, lambda t: score(t) == best), F.lit(0)))


def bare(text: Column) -> Column:
    """Without links, tags and handles."""
    out = text
    for pattern in (URL, HASHTAG, MENTION):
        out = F.regexp_replace(out, pattern, " ")
    # most texts have none of their marks, and a mark is found faster than a pattern
    return F.when(text.contains("#") | text.contains("@") | text.contains("://") | text.contains("www."), out).otherwise(text)


def bare_words(text: Column) -> Column:
    return _all(F.lower(bare(text)), r"[a-z][a-z'\-]*")


def first_word(text: Column) -> Column:
    return F.regexp_extract(F.lower(text), r"[a-z][a-z'\-]*", 0)


def hits_any(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + LEFT + "(?:" + pattern + ")" + RIGHT)
