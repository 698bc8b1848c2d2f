"""Cut lists and card lists in the shapes that they come in, one row for each piece, card, segment and fault.

A file holds {"pieces": [...]}, one piece, a list of pieces, or a bare list of cards, which are objects or
[start, end, text]. Everything that is wrong in any file is gathered; nothing is thrown away because something
else is wrong. The JSON is read on the JVM as variants.

Files: file, value (the whole text; null counts as unreadable).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAST_END = 0.05
#: Where a file keeps its clips, first found first.
COLLECTIONS = ["pieces", "built", "clips", "cuts", "pulls"]


def at(node: Column, path: str, kind: str = "string") -> Column:
    """What lies at `path` of a variant, as `kind`; null where nothing does or it is of no such kind."""
    return F.try_variant_get(node, f"$.{path}" if path else "$", kind)


def is_object(node: Column) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith("OBJECT"), F.lit(False))


def filled(*texts: Column) -> Column:
    """The first text that is not blank, trimmed; null where there is none."""
    return F.coalesce(*[F.when(F.trim(t) != "", F.trim(t)) for t in texts])


def word(node: Column, path: str) -> Column:
    """A string at `path`; numbers and other kinds are no strings."""
    found = F.try_variant_get(node, f"$.{path}", "variant")
    return F.when(F.schema_of_variant(found) == "STRING", at(node, path))


def cards_of(node: Column) -> Column:
    return F.coalesce(at(node, "caption_cards", "array<variant>"), at(node, "cards", "array<variant>"))


def hook_of(node: Column) -> Column:
    return filled(word(node, "hook_text"), word(node, "hook"), word(node, "hook.text"))


def name_of(node: Column) -> Column:
    return filled(*[word(node, k) for k in ("piece", "id", "name", "filename")])


def _blocks(files: DataFrame) -> DataFrame:
    """file, ord, block and times (of the file); ord is null where the file holds no list that is understood, block too if it is unreadable."""
    v = F.try_parse_json(F.regexp_replace("value", "^﻿", ""))
    top, listed = at(F.col("v"), "", "array<variant>"), at(F.col("v"), "pieces", "array<variant>")
    first = F.get(top, F.lit(0))
    bare = F.coalesce(F.schema_of_variant(first).startswith("ARRAY") | (is_object(first) & F.try_variant_get(first, "$.text", "variant").isNotNull()), F.lit(False))
    whole = F.array(F.col("v"))
    chosen = F.when(is_object(F.col("v")) & listed.isNotNull(), listed).when(is_object(F.col("v")) & cards_of(F.col("v")).isNotNull(), whole)
    chosen = chosen.when(is_object(first) & cards_of(first).isNotNull(), top).when(bare, whole)
    own = files.withColumn("v", v).withColumn("blocks", chosen)
    times = F.lower(F.trim(word(F.col("v"), "times")))
    return own.select("file", "v", F.when(times.isin("clip", "source"), times).alias("times"), bare.alias("bare"), F.posexplode_outer("blocks").alias("ord", "block")).withColumn("ord", F.col("ord") + 1)


def _pieces(files: DataFrame) -> DataFrame:
    """_blocks with raw (the list of cards)."""
    raw = F.when(F.col("bare") & ~is_object(F.col("block")), at(F.col("block"), "", "array<variant>")).otherwise(cards_of(F.col("block")))
    return _blocks(files).withColumn("raw", raw)


def pieces(files: DataFrame) -> DataFrame:
    """file, ord, name, duration, hook, times and n_cards of pieces that carry cards."""
    b = F.col("block")
    return _pieces(files).where("raw is not null").select("file", "ord", F.coalesce(name_of(b), F.concat(F.lit("piece "), "ord")).alias("name"), at(b, "duration", "double").alias("duration"), hook_of(b).alias("hook"), F.coalesce(word(b, "times"), F.col("times")).alias("times"), F.size("raw").alias("n_cards"))


def _cards(files: DataFrame) -> DataFrame:
    own = _pieces(files).select("file", "ord", F.posexplode("raw").alias("card", "c")).withColumn("card", F.col("card") + 1)
    c = F.col("c")
    triple = at(c, "", "array<variant>")
    field = lambda key, i, kind: F.when(is_object(c), at(c, key, kind)).when(F.size(triple) >= 3, F.try_variant_get(F.get(triple, F.lit(i)), "$", kind))
    fault = F.when(is_object(c) & at(c, "text", "variant").isNull(), "card has no text").when(~is_object(c) & (F.coalesce(F.size(triple), F.lit(0)) < 3), "card is neither an object nor [start, end, text]")
    return own.select("file", "ord", "card", field("text", 2, "string").alias("text"), field("start", 0, "double").alias("start"), field("end", 1, "double").alias("end"), fault.alias("fault"))


def cards(files: DataFrame) -> DataFrame:
    """file, ord, card (from 1), text, start, end; times that are no numbers are null."""
    return _cards(files).where("fault is null").drop("fault")


def _segments(files: DataFrame) -> DataFrame:
    s = F.col("s")
    listed = _pieces(files).select("file", "ord", F.posexplode(at(F.col("block"), "segments", "array<variant>")).alias("seg", "s")).withColumn("seg", F.col("seg") + 1)
    return listed.select("file", "ord", "seg", F.when(is_object(s), at(s, "start", "double")).alias("start"), F.when(is_object(s), at(s, "end", "double")).alias("end"), at(s, "text").alias("text"))


def segments(files: DataFrame, length: float | None = None) -> DataFrame:
    """file, ord, seg, start, end and text of segments on the recording; with its length known, ends are clamped to it."""
    good = _segments(files).where("start is not null and end > start")
    return good if length is None else good.where(F.col("start") < length).withColumn("end", F.least("end", F.lit(length)))


def faults(files: DataFrame, length: float | None = None) -> DataFrame:
    """file, ord, part (card or segment number), fault, fatal: all that is wrong, whatever else is."""
    spot = lambda df, part, fault, fatal=True: df.select("file", "ord", part.cast("int").alias("part"), F.lit(fault).alias("fault") if isinstance(fault, str) else fault.alias("fault"), F.lit(fatal).alias("fatal"))
    none, blocks, segs = F.lit(None), _pieces(files), _segments(files)
    found = [
        spot(blocks.where("v is null"), none, "file is no readable JSON"),
        spot(blocks.where("v is not null and block is null"), none, "file holds no card list that is understood"),
        spot(blocks.where("block is not null and raw is null"), none, "piece carries no cards", False),
        spot(_cards(files).where("fault is not null"), F.col("card"), F.col("fault")),
        spot(segs.where("start is null or end is null"), F.col("seg"), "segment needs start and end"),
        spot(segs.where("end <= start"), F.col("seg"), "segment ends before it starts"),
    ]
    if length is not None:
        found += [spot(segs.where(F.col("start") >= length), F.col("seg"), "segment starts behind the end of the source"), spot(segs.where((F.col("start") < length) & (F.col("end") > length + PAST_END)), F.col("seg"), "segment ends behind the end of the source, clamped", False)]
    return reduce(DataFrame.unionByName, found)


def on_clip(cards_: DataFrame, segments_: DataFrame, eps: float = 0.02) -> DataFrame:
    """Cards with times on the recording moved to where they play in the piece; `dropped` where no segment holds their start.

    A card that crosses a cut ends with its segment. cards_: file, ord, card, text, start, end; cards of pieces
    without segments, and those without a start, stay as they are.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("file", "ord").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    clock = segments_.withColumn("base", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0.0)))
    clock = clock.select("file", "ord", "seg", F.col("start").alias("a"), F.col("end").alias("b"), "base")
    # the first segment that holds the start
    held = cards_.join(clock, ["file", "ord"]).where((F.col("start") >= F.col("a") - eps) & (F.col("start") < F.col("b") + eps)).groupBy("file", "ord", "card").agg(F.min(F.struct("seg", "a", "b", "base")).alias("x"))
    out = cards_.join(held, ["file", "ord", "card"], "left").join(segments_.select("file", "ord").distinct().withColumn("cut", F.lit(True)), ["file", "ord"], "left")
    move = lambda t: F.when(F.col("x").isNotNull(), F.col("x.base") + t - F.col("x.a")).otherwise(t)
    return out.select(
        "file", "ord", "card", "text", move(F.col("start")).alias("start"),
        F.when(F.col("x").isNotNull(), move(F.least("end", "x.b"))).otherwise(F.col("end")).alias("end"),
        (F.coalesce("cut", F.lit(False)) & F.col("start").isNotNull() & F.col("x").isNull()).alias("dropped"),
    )


def clips(files: DataFrame) -> DataFrame:
    """file, ord, name, shape, span_s, span_e, stated (the duration that the file gives), note; and `used`, the ranges of tape as (s, e).

    A clip uses its segments, or its span less the ranges that are cut out of it. note says why a clip has none.
    """
    v = F.try_parse_json(F.regexp_replace("value", "^﻿", ""))
    keyed = lambda entries, kind: F.transform(entries, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("it"), F.lit(kind).alias("kind")))
    bare = lambda listed, kind: F.transform(listed, lambda x: F.struct(F.lit(None).cast("string").alias("key"), x.alias("it"), F.lit(kind).alias("kind")))
    held = [side for k in COLLECTIONS for side in (bare(at(F.col("v"), k, "array<variant>"), k), keyed(F.map_entries(at(F.col("v"), k, "map<string,variant>")), k))]
    items = F.coalesce(bare(at(F.col("v"), "", "array<variant>"), "list"), *held)
    rows = files.withColumn("v", v).select("file", F.posexplode_outer(items).alias("ord", "x")).select("file", (F.col("ord") + 1).alias("ord"), "x.*")
    it, given = F.col("it"), filled(word(F.col("it"), "filename"))
    name = F.when(F.col("key").isNotNull() & given.isNotNull(), F.concat_ws(" ", "key", given)).otherwise(F.coalesce(given, filled(word(it, "piece")), at(it, "id"), F.col("key"), F.concat("kind", F.lit(" #"), F.coalesce(at(it, "rank"), F.col("ord").cast("string")))))
    segs = at(it, "segments", "array<variant>")
    spans = F.filter(F.transform(segs, lambda s: F.struct(at(s, "start", "double").alias("s"), at(s, "end", "double").alias("e"))), lambda r: r["s"].isNotNull() & r["e"].isNotNull())
    s, e = at(it, "start", "double"), at(it, "end", "double")
    holes = F.transform(at(it, "internal_cuts", "array<array<double>>"), lambda h: F.struct(h[0].alias("s"), h[1].alias("e")))
    lone = F.when(s.isNotNull() & e.isNotNull(), F.array(F.struct(s.alias("s"), e.alias("e"))))
    some = F.coalesce(F.size(segs) > 0, F.lit(False))
    out = rows.select("file", "ord", name.alias("name"), F.when(some, F.concat(F.size(segs).cast("string"), F.lit(" segments"))).when(F.size(holes) > 0, F.concat(F.lit("span less "), F.size(holes).cast("string"), F.lit(" ranges"))).when(lone.isNotNull(), "one span").alias("shape"), F.when(~some, s).alias("span_s"), F.when(~some, e).alias("span_e"), at(it, "duration", "double").alias("stated"), F.when(some, spans).otherwise(lone).alias("used"), F.when(~some, holes).alias("holes"), F.when(F.col("kind").isNull(), "no collection of clips in this file").when(~some & lone.isNull(), "no segments and no start and end").alias("note"), is_object(it).alias("ok"))
    return out.where("ok or note = 'no collection of clips in this file'").drop("ok")


def used_tape(clips_: DataFrame) -> DataFrame:
    """id (file, ord), s, e: the tape of each clip, merged, with what is cut out taken away."""
    from ..operators import intervals

    good = clips_.where("note is null").select(F.struct("file", "ord").alias("id"), "used", "holes", F.col("span_s").isNull().alias("many"))
    ranges = lambda df, c: df.select("id", F.explode(c).alias("r")).select("id", "r.*").where("e > s")
    whole = intervals.islands(ranges(good.where("many"), "used")).select("id", "s", "e")
    return whole.unionByName(intervals.gaps(ranges(good.where("not many"), "used"), ranges(good.where("not many"), "holes")).select("id", "s", "e"))
