"""Column expressions over text: patterns, parsing of numbers and times, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ends a word in every regex dialect used here (\b differs between engines on accented text).
END = r"(?:[^\p{L}\p{N}_]|$)"
START = r"(?:^|[^\p{L}\p{N}_])"
#: How a title or sentence opens. The last two may stand anywhere.
SHAPES = {
    "question": r"^(how|what|why|when|where|who|which|can|should|is|are|do|does|did)" + END,
    "number": r"^[^\p{L}\p{N}_]*(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)" + END + "|" + START + r"(?:[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(?:things?|ways?|reasons?|rules?|signs?|steps?|mistakes?|lessons?|questions?|moves?)" + END,
    "imperative": r"^(stop|start|never|always|don'?t|do not|avoid|try|watch|listen|read|build|make|get)" + END,
    "first_person": r"^(i|we|my|our|me)" + END,
    "you": r"^(you|your|you'?re)" + END,
    "contrarian": START + r"(nobody|no one|everyone|everybody|myth|truth|actually|really|wrong|lie|secret)" + END,
    "stakes": START + r"(cost|lost|lose|losing|ruin|destroy|kill|fail|failed|broke|divorce|quit)" + END,
}
#: Markers that speech opens with and titles do not.
MARKERS = r"^[^\p{L}\p{N}_]*(?:so|and|but|okay|ok|well|now|yeah|yes|right|look|listen|see|like|anyway|anyways|basically|honestly|actually|i mean|you know|um|uh|er)"
#: Tags of entertainment.
NOISE = r"#(funny|comedy|skit|prank|meme|viral|trending|fyp|shorts?|explore|dailyvlog|minivlog)"
WORDS = r"[a-z']+"
TERMINAL = r"[.!?]$"


def free_names(df, *stems: str) -> list[str]:
    """A name for each stem that no column of `df` has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def strip_markers(text: Column, rounds: int = 3) -> Column:
    """Without up to `rounds` leading markers, but never without everything."""
    out = F.ltrim(text)
    for _ in range(rounds):
        less = F.ltrim(F.regexp_replace(out, "(?i)" + MARKERS + r"(?![\p{L}\p{N}_])[\s,]*", ""))
        out = F.when(less == "", out).otherwise(less)
    return out


def has_shape(name: str, text: Column) -> Column:
    """The text opens with the shape, as it stands or after its markers."""
    pattern = "(?i)" + SHAPES[name]
    return F.coalesce(text.rlike(pattern) | strip_markers(text).rlike(pattern), F.lit(False))


def is_noise(title: Column) -> Column:
    tags = F.regexp_count(title, F.lit(r"#[A-Za-z0-9_]+"))
    rest = F.regexp_count(F.regexp_replace(title, r"#[A-Za-z0-9_]+", " "), F.lit("[A-Za-z']+"))
    return title.rlike("(?i)" + NOISE) | ((tags >= 3) & (rest <= 6))


def has_sentence(title: Column) -> Column:
    """At least three words of two letters outside hashtags."""
    return F.regexp_count(F.regexp_replace(title, r"#[A-Za-z0-9_]+", " "), F.lit("[A-Za-z']{2,}")) >= 3


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def tokens(text: Column) -> Column:
    """White-space tokens, none empty."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda t: t != "")


def views(text: Column) -> Column:
    """'1.2M views' -> 1200000; 'No views' -> 0; unreadable -> null."""
    clean = F.trim(F.regexp_replace(text, " ", " "))
    number = F.regexp_replace(F.regexp_extract(clean, r"^([0-9.,]+)\s*([KMB])?", 1), ",", "").try_cast("double")
    unit = F.regexp_extract(clean, r"^([0-9.,]+)\s*([KMB])?", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(F.lower(clean).startswith("no views"), F.lit(0)).otherwise(number * scale).cast("bigint")


def seconds(text: Column) -> Column:
    """'1:02:03' or '00:01:02,500' -> seconds, folded base 60; unreadable -> null."""
    parts = F.split(F.regexp_replace(F.trim(text), ",", "."), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p.try_cast("double"))
    return F.when(F.trim(text) == "", None).otherwise(total)


def timecode(s: Column) -> Column:
    """Seconds -> mm:ss.s, from an hour on h:mm:ss.s."""
    minutes, rest = F.floor(s / 60).cast("bigint"), F.lpad(F.format_number(s % 60, 1), 4, "0")
    two = F.lpad((minutes % 60).cast("string"), 2, "0")
    return F.when(minutes >= 60, F.concat_ws(":", F.floor(minutes / 60).cast("string"), two, rest)).otherwise(F.concat_ws(":", two, rest))


def stamp(s: Column) -> Column:
    """Seconds -> HH:MM:SS,mmm as in SRT."""
    ms = F.floor(s * 1000 + 0.5)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(ms / 3600000)), F.lit(":"), two(F.floor(ms / 60000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(","), F.lpad((ms % 1000).cast("string"), 3, "0"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def snip(text: Column, n: int) -> Column:
    """At most n characters: without blanks around, cut one short of n and marked."""
    own = F.trim(text)
    return F.when(F.length(own) > n, F.concat(F.rtrim(F.substring(own, 1, n - 1)), F.lit("..."))).otherwise(own)


def bitrate(width: Column, height: Column, crf: Column) -> Column:
    """Megabits for a quality factor: 12 at 1080p and factor 18, halved every six steps, in 2..60."""
    return F.greatest(F.lit(2.0), F.least(F.lit(60.0), 12.0 * width * height / (1080.0 * 1920.0) * F.pow(F.lit(2.0), (18 - crf) / 6.0)))


def luminance(r: Column, g: Column, b: Column) -> Column:
    part = lambda c: F.when(c / 255.0 <= 0.03928, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * part(r) + 0.7152 * part(g) + 0.0722 * part(b)


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05)
