"""Transcripts as other tools write and read them, each with its own rules, and mis-heard words written back.

Files: rec, value (the whole text). All readers pass over what they cannot read; none drops a cue that another rule of
its own would keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_ARROW, _CLOCK, _LOOSE = "-->", r"(\d+):(\d+):(\d+)[,.](\d+)", r"([\d:.,]+)\s*-->\s*([\d:.,]+)"
_HEAD = r"(\d\d:\d\d:\d\d[,.]\d+)\s*-->"


def _blocks(files: DataFrame) -> DataFrame:
    """rec, ord, lines: the lines that hold something, block by block."""
    plain = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r\n?", "\n")
    rows = files.select("rec", F.posexplode(F.split(F.regexp_replace(plain, r"^\s+|\s+$", ""), r"\n\s*\n")).alias("ord", "block"))
    return rows.select("rec", "ord", F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "").alias("lines")).where(F.size("lines") > 0)


def _after(lines: Column, place: Column) -> Column:
    return F.array_join(F.transform(F.slice(lines, place + 1, F.greatest(F.size(lines), F.lit(1))), lambda x: F.trim(x)), " ")


def _numbered(rows: DataFrame) -> DataFrame:
    return rows.withColumn("cue", (F.row_number().over(Window.partitionBy("rec").orderBy("ord")) - 1).cast("long")).select("rec", "cue", "start", "end", "text")


def forgiving(files: DataFrame) -> DataFrame:
    """Cues (rec, cue, start, end, text) of whatever has text: a block without a whole timing line has no times."""
    timing = F.get(F.filter("lines", lambda x: x.contains(_ARROW)), F.lit(0))
    body = F.filter("lines", lambda x: ~x.contains(_ARROW) & ~F.trim(x).rlike(r"^\d+$"))
    stamps = F.regexp_extract_all(timing, F.lit(_CLOCK), F.lit(0))
    part = lambda k, g: F.regexp_extract(F.get(stamps, F.lit(k)), _CLOCK, g).cast("int")
    at = lambda k: F.when(F.size(stamps) == 2, part(k, 1) * 3600 + part(k, 2) * 60 + part(k, 3) + part(k, 4) / 1000)
    rows = _blocks(files).where(F.size(body) > 0)
    return _numbered(rows.select("rec", "ord", at(0).alias("start"), at(1).alias("end"), F.trim(F.array_join(body, " ")).alias("text")))


def shifted(files: DataFrame, offset: float) -> DataFrame:
    """Cues of a part of a recording that began `offset` seconds into it. The first line with two times counts; the text is what follows it."""
    timing = F.array_position(F.transform("lines", lambda x: x.rlike(_LOOSE)), F.lit(True)).cast("int")
    rows = _blocks(files).withColumn("k", timing).where("k > 0").withColumn("line", F.get("lines", F.col("k") - 1))
    at = lambda g: F.round(X.seconds(F.regexp_extract("line", _LOOSE, g)) + offset, 3)
    return _numbered(rows.select("rec", "ord", at(1).alias("start"), at(2).alias("end"), _after(F.col("lines"), F.col("k")).alias("text")))


def strict(files: DataFrame) -> DataFrame:
    """Cues of blocks whose timing line reads as two times; JSON files give their cues with start and end."""
    js = F.ltrim("value").rlike(r"^[\[{]")
    one = "struct<start:double,end:double,text:string>"
    listed = F.coalesce(F.from_json("value", f"array<{one}>"), F.from_json("value", f"struct<cues:array<{one}>>")["cues"])
    read = files.where(js).select("rec", F.posexplode(listed).alias("ord", "c")).select("rec", "ord", "c.start", "c.end", F.trim(F.coalesce("c.text", F.lit(""))).alias("text"))
    timing = F.array_position(F.transform("lines", lambda x: x.contains(_ARROW)), F.lit(True)).cast("int")
    rows = _blocks(files.where(~js)).withColumn("k", timing).where("k > 0").withColumn("line", F.get("lines", F.col("k") - 1))
    at = lambda k: X.seconds(F.trim(F.get(F.split("line", _ARROW), F.lit(k))))
    srt = rows.select("rec", "ord", at(0).alias("start"), at(1).alias("end"), F.trim(_after(F.col("lines"), F.col("k"))).alias("text"))
    return _numbered(read.unionByName(srt).where("start is not null and end is not null"))


def headed(files: DataFrame) -> DataFrame:
    """rec, cue, start, head, text: head is what stands above a cue's text, as it is written, so that the file can be written back.

    Digits alone are a number of the file before text, and text after it.
    """
    lines = files.select("rec", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).withColumn("bare", F.trim("line"))
    clock = F.col("bare").rlike(_HEAD)
    w = Window.partitionBy("rec").orderBy("n")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumns({"time": clock, "parts": clock | (F.col("bare") == "")})
    rows = rows.withColumn("seg", F.sum(F.col("parts").cast("int")).over(upto))
    words = ~F.col("parts") & ~F.col("bare").rlike(r"^\d+$")
    begun = F.max(words.cast("int")).over(Window.partitionBy("rec", "seg").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("said", ~F.col("parts") & begun)
    # what parts two cues is a blank or a time right after text
    rows = rows.withColumn("new", (F.col("parts") & F.coalesce(F.lag("said").over(w), F.lit(False))).cast("int"))
    rows = rows.withColumn("group", F.sum("new").over(upto)).where("bare <> ''")
    joined = lambda cond, c, mark: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("n", F.col(c).alias("t"))))), lambda x: x["t"]), mark)
    start = F.min_by(F.when(F.col("time"), F.col("bare")), F.when(F.col("time"), -F.col("n")))
    out = rows.groupBy("rec", "group").agg(joined(~F.col("said"), "line", "\n").alias("head"), joined(F.col("said"), "bare", " ").alias("text"), start.alias("at")).where("text <> ''")
    cue = (F.row_number().over(Window.partitionBy("rec").orderBy("group")) - 1).cast("long")
    return out.select("rec", cue.alias("cue"), X.seconds(F.regexp_extract("at", _HEAD, 1)).alias("start"), "head", "text")


def words(cues: DataFrame) -> DataFrame:
    """rec, pos (from 0 in the recording), word, cue, at (characters before it in its cue)."""
    token = "[A-Za-z']+"
    held = cues.select("rec", "cue", F.posexplode(F.arrays_zip(F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("word"), F.slice(F.split("text", token, -1), 1, F.greatest(F.lit(0), F.size(F.split("text", token, -1)) - 1)).alias("gap"))).alias("k", "x"))
    rows = held.select("rec", "cue", "k", "x.word", F.length("x.gap").alias("gap"))
    w = Window.partitionBy("rec", "cue").orderBy("k")
    before = F.coalesce(F.sum(F.length("word")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0))
    pos = F.row_number().over(Window.partitionBy("rec").orderBy("cue", "k")) - 1
    return rows.select("rec", pos.cast("long").alias("pos"), "word", "cue", before.cast("int").alias("at"))


def corrected(cues: DataFrame, suspects: DataFrame) -> DataFrame:
    """cues with the words that were meant: suspects (rec, pos, n, probably) span n words from pos on and do not overlap.

    The cue where a span begins gets the word; what the span holds of later cues goes. Blanks that are left over go too.
    """
    spans = words(cues).join(suspects.select("rec", F.col("pos").alias("p"), "n", "probably"), "rec").where("pos >= p and pos < p + n")
    parts = spans.groupBy("rec", "p", "cue").agg(F.min("at").alias("lo"), F.max(F.col("at") + F.length("word")).alias("hi"), F.first("probably").alias("probably"), F.min("pos").alias("first"))
    edits = parts.select("rec", "cue", F.struct((-F.col("lo")).alias("back"), "lo", "hi", F.when(F.col("first") == F.col("p"), F.col("probably")).otherwise("").alias("new")).alias("e"))
    held = edits.groupBy("rec", "cue").agg(F.array_sort(F.collect_list("e")).alias("edits"))  # of one cue, from its end
    put = F.aggregate("edits", F.col("text"), lambda t, e: F.concat(F.substring(t, F.lit(1), e["lo"]), e["new"], F.substring(t, e["hi"] + 1, F.length(t))))
    tidy = F.trim(F.regexp_replace(F.regexp_replace(put, r"\s{2,}", " "), r"\s+([,.?!])", "$1"))
    return cues.join(held, ["rec", "cue"], "left").withColumn("text", F.when(F.col("edits").isNull(), F.col("text")).otherwise(tidy)).drop("edits")


def to_text(cues: DataFrame) -> DataFrame:
    """rec, value: headed cues as the file that they came from."""
    block = F.concat("head", F.lit("\n"), "text", F.lit("\n"))
    return cues.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
