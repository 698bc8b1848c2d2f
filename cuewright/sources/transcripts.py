"""Transcripts and research results, read into canonical tables.

cue(rec, cue, start, end, text): SRT, bracketed lines and JSON under several key names.
video(id, title, views, format): nested result blocks, first of each id kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

_HEAD = r"\[?\s*([0-9:.,]+)\s*-->\s*([0-9:.,]+)\s*\]?"


def _cues(rows: DataFrame) -> DataFrame:
    good = rows.where("end > start")
    order = Window.partitionBy("rec").orderBy("start", "ord")
    return good.select("rec", (F.row_number().over(order) - 1).cast("bigint").alias("cue"), "start", "end", "text")


def read_text(spark: SparkSession, path) -> DataFrame:
    """rec (the path) and value (the whole file)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("rec"), "value")


def srt(files: DataFrame) -> DataFrame:
    """rec, value -> cues. Blocks part at blank lines; a block without a timing line is skipped."""
    blocks = files.select("rec", F.posexplode(F.split(F.regexp_replace("value", "\r\n?", "\n"), r"\n[ \t]*\n")).alias("ord", "block"))
    body = F.regexp_replace(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*\n?", ""), r"^\s+|\s+$", "")
    return _cues(blocks.select("rec", "ord", X.seconds(F.regexp_extract("block", _HEAD, 1)).alias("start"), X.seconds(F.regexp_extract("block", _HEAD, 2)).alias("end"), body.alias("text")).where("start is not null"))


def bracketed(files: DataFrame) -> DataFrame:
    """rec, value -> cues: '[a --> b] text' lines; other lines continue the cue before."""
    lines = files.select("rec", F.posexplode(F.split("value", "\r?\n")).alias("ord", "line")).where("trim(line) <> ''")
    head = F.col("line").rlike("^" + _HEAD)
    upto = Window.partitionBy("rec").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    run = lines.withColumn("n", F.sum(head.cast("int")).over(upto)).where("n > 0")
    rest = F.trim(F.regexp_replace("line", "^" + _HEAD, ""))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", rest.alias("t")))), lambda x: x["t"]), " ")
    at = lambda k: X.seconds(F.regexp_extract(F.min_by("line", "ord"), _HEAD, k))
    return _cues(run.groupBy("rec", F.col("n").alias("ord")).agg(at(1).alias("start"), at(2).alias("end"), F.trim(text).alias("text")))


def json_cues(files: DataFrame) -> DataFrame:
    """rec, value -> cues from a bare list or the first that is not empty under segments, cues or transcript."""
    one = "struct<start:string,start_time:string,end:string,end_time:string,text:string>"
    wrapped = F.from_json("value", f"struct<segments:array<{one}>,cues:array<{one}>,transcript:array<{one}>>")
    filled = [F.when(F.size(wrapped[k]) > 0, wrapped[k]) for k in ("segments", "cues", "transcript")]
    rows = F.coalesce(*filled, F.from_json("value", f"array<{one}>"))
    x = files.select("rec", F.posexplode(rows).alias("ord", "c")).select("rec", "ord", "c.*")
    return _cues(x.select("rec", "ord", X.seconds(F.coalesce("start", "start_time")).alias("start"), X.seconds(F.coalesce("end", "end_time")).alias("end"), "text"))


def cues(files: DataFrame) -> DataFrame:
    """rec, value -> cues, whichever of the three forms a file has: JSON, bracketed lines, else SRT."""
    start = F.ltrim("value")
    kind = F.when(start.rlike(r"^[\[{]\s*[\[{\"]") | start.rlike(r"^[\[{]\s*[\]}]"), "json").when(F.col("value").rlike(r"(?m)^\s*\[\s*[0-9:.,]+\s*-->"), "bracket").otherwise("srt")
    own = files.withColumn("kind", kind)
    of = lambda k: own.where(F.col("kind") == k).select("rec", "value")
    return json_cues(of("json")).unionByName(bracketed(of("bracket"))).unionByName(srt(of("srt")))


def videos(files: DataFrame) -> DataFrame:
    """rec, value of result blocks -> id, title, views, format, duration_s; the first of each id stays."""
    block = "array<struct<query:string,results:array<struct<format:string,title:string,channel:string,views:bigint,views_raw:string,duration:string,duration_s:int,age:string,id:string>>>>"
    b = files.select("rec", F.posexplode(F.from_json("value", block)).alias("b", "block"))
    v = b.select("rec", "b", F.posexplode("block.results").alias("v", "r")).select("rec", "b", "v", "r.*")
    v = v.withColumn("views", F.coalesce("views", X.views(F.col("views_raw")))).withColumn("duration_s", F.coalesce("duration_s", X.seconds(F.col("duration")).cast("int")))
    v = v.where(F.col("views").isNotNull() & (F.coalesce("title", F.lit("")) != "")).withColumn("id", F.coalesce("id", "title"))
    first = F.row_number().over(Window.partitionBy("id").orderBy("rec", "b", "v"))
    return v.withColumn("n", first).where("n = 1").select("id", "title", "views", "format", "duration_s")


def to_srt(cues: DataFrame) -> DataFrame:
    """rec, value: one numbered SRT file for each recording."""
    block = F.concat((F.col("cue") + 1).cast("string"), F.lit("\n"), X.stamp(F.col("start")), F.lit(" --> "), X.stamp(F.col("end")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.groupBy("rec").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))), lambda x: x["b"]), "\n").alias("value"))
