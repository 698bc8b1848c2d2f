"""A caption for each network: its own rules laid over the general ones, then handles, tags, links, opening and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captions as C
from ..sources import trees

#: Rules that hold where no file says otherwise; words whose full stop ends no sentence.
DEFAULTS = '{"limit": 2200, "lead": 125, "max_hashtags": 5, "links": "inline", "mentions": "keep", "bio_phrase": "link in bio"}'
ABBREVIATED = "tr|ed|vol|no|pp|p|st|mr|mrs|ms|dr|prof|etc|eg|ie|vs|jr|sr|approx|inc|ltd|co|fig|al|cf|ca"
KINDS = {"limit": "int", "lead": "int", "max_hashtags": "int", "links": "string", "mentions": "string", "bio_phrase": "string"}
#: All that goes before the last place where a text may be cut: a line end, or a stop that ends a sentence.
_CUT = rf"(?s)^(.*(?:[.!?…](?<!(?<![A-Za-z'’])(?i:[a-z'’]|{ABBREVIATED})[.!?…])(?=\s)|(?=\n)))"


def rules(files: DataFrame, networks: list[str]) -> DataFrame:
    """file, value (JSON with `defaults` and `networks`) -> file, network and a column for each rule: a network's own
    rule, else the file's default, else DEFAULTS. A network that the file does not name has the defaults."""
    v = F.try_parse_json("value")
    part = lambda path: F.coalesce(F.to_json(F.try_variant_get(F.col("v"), path, "variant")), F.lit("{}"))
    asked = files.withColumn("v", v).withColumn("network", F.explode(F.array(*[F.lit(n) for n in networks])))
    own = F.coalesce(*[F.when(F.col("network") == n, part(f"$.networks.{n}")) for n in networks])
    layered = asked.select(F.struct("file", "network").alias("id"), F.posexplode(F.array(F.lit(DEFAULTS), part("$.defaults"), own)).alias("layer", "value"))
    keyed = layered.withColumn("id", F.to_json("id"))
    flat = trees.table(trees.merged(keyed), KINDS)
    name = F.from_json("id", f"file {dict(files.dtypes)['file']}, network string")
    return flat.withColumn("id", name).select("id.file", "id.network", *KINDS)


def trim(text: Column, limit: Column) -> Column:
    """The text up to the last place inside the limit where it may be cut; at the last blank where there is none."""
    head = F.regexp_extract(F.substring(text, F.lit(1), limit + 1), _CUT, 1)
    start = F.substring(text, F.lit(1), limit)
    blank = F.regexp_replace(F.regexp_replace(start, r"(?s)^(.*) .*$", "$1"), "[ ,;:]+$", "")
    return F.when(F.length(text) <= limit, text).when(head == "", blank).otherwise(F.regexp_replace(head, r"\s+$", ""))


def adapt(captions: DataFrame, networks: DataFrame) -> DataFrame:
    """captions (id, text) met with every row of `networks` (rules(); a few rows) -> id, file, network, text and notes.

    What is told is what came out: a trim that takes tags or the link says so.
    """
    tags = lambda t: F.regexp_count(t, F.lit(C.HASHTAG))
    links = lambda t: F.regexp_count(t, F.lit(C.URL))
    tidy = lambda t: F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", "")
    out = captions.select("id", tidy(F.coalesce("text", F.lit(""))).alias("t0")).join(F.broadcast(networks))
    bare = F.col("mentions") == "strip"
    n_handles = F.when(bare, F.regexp_count("t0", F.lit(C.MENTION))).otherwise(0)
    out = out.withColumn("n_handles", n_handles).withColumn("t1", F.when(F.col("n_handles") > 0, tidy(F.regexp_replace("t0", rf"\s*(?:{C.MENTION})\s*", " "))).otherwise(F.col("t0")))
    out = out.withColumn("had", tags(F.col("t1"))).withColumn("t2", F.when(F.col("had") > F.col("max_hashtags"), C.strip_tags(F.col("t1"), F.col("max_hashtags"))).otherwise(F.col("t1")))
    away = F.when(F.col("links") == "inline", F.lit(0)).otherwise(links(F.col("t2")))
    moved = F.when(F.col("n_links") == 0, F.col("t2")).when(F.col("links") == "strip", C.without_links(F.col("t2"))).otherwise(C.linked_in_bio(F.col("t2"), F.col("bio_phrase")))
    out = out.withColumn("n_links", away).withColumn("t3", moved)
    block = C.leading_tags(F.col("t3"))
    rest = F.regexp_replace("t3", r"^(?:[#@][\p{L}\p{N}_.]+[ \t]*)+(?:\n+|$)\s*", "")
    walled = ~C.opens_with_words(F.col("t3"))
    out = out.withColumns({"walled": walled, "turned": walled & (block != "") & (rest != "")})
    out = out.withColumn("t4", F.when(F.col("turned"), F.concat(tidy(rest), F.lit("\n\n"), block)).otherwise(F.col("t3")))
    out = out.withColumn("t5", trim(F.col("t4"), F.col("limit")))
    cut, left = F.length("t4") > F.col("limit"), tags(F.col("t5"))
    meant = F.least("had", "max_hashtags")
    notes = [
        F.when(F.col("n_handles") > 0, F.format_string("removed %d handles", "n_handles")),
        F.when(F.col("had") > F.col("max_hashtags"), F.format_string("cut hashtags from %d to %d", "had", "max_hashtags")),
        F.when((F.col("n_links") > 0) & (F.col("links") == "bio"), F.concat(F.lit("the link reads: "), "bio_phrase")).when((F.col("n_links") > 0) & (F.col("links") == "strip"), F.format_string("removed %d links", "n_links")),
        F.when(F.col("turned"), F.lit("moved the opening tags to the end")).when(F.col("walled"), F.lit("WARNING: opens with tags and has nothing else to lead with")),
        F.when(cut, F.format_string("trimmed to %d characters", "limit")),
        F.when(cut & (F.col("links") == "inline") & (links(F.col("t4")) > 0) & (links(F.col("t5")) == 0), F.lit("WARNING: the trim cut the link off")),
        F.when((meant > 0) & (left < meant), F.format_string("the trim took %d tags, %d go out", meant - left, left)),
    ]
    said = F.array_compact(F.array(*notes))
    return out.select("id", "file", "network", tidy(F.col("t5")).alias("text"), F.when(F.size(said) == 0, F.array(F.lit("fits as written"))).otherwise(said).alias("notes"))
