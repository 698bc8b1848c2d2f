"""Cohorts: winners within each format, rates of shapes, lift, over-used words, profiles.

Rows are videos: id, title, views, format. A null view count or format takes no part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

MIN_PER_BUCKET, MIN_SAMPLE = 6, 25


def winners(videos: DataFrame) -> DataFrame:
    """Add winner: noise dropped, then the top quarter (one at least) by views within each format, ties by id.

    Views are counted by value first, so a format is never sorted in one task: its windows hold a row for
    each value, and only the videos at the last winning value are ranked among themselves.
    """
    clean = videos.where(F.col("views").isNotNull() & ~X.is_noise(F.col("title")))
    values = clean.groupBy("format", "views").agg(F.count("*").alias("k"))
    by = Window.partitionBy("format")
    above = F.coalesce(F.sum("k").over(by.orderBy(F.desc("views")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.greatest(F.lit(1), F.floor(F.sum("k").over(by) / 4)) - above
    last = values.withColumn("room", room).where("room > 0").groupBy(F.col("format").alias("f")).agg(F.min_by(F.struct("views", "room"), "views").alias("last"))
    joined = clean.join(F.broadcast(last), F.col("format").eqNullSafe(F.col("f")), "left")  # a row for each format
    at = joined.where("views = last.views").select(F.col("format").alias("f2"), F.col("id").alias("i2"), "last")
    ranked = at.withColumn("nth", F.row_number().over(Window.partitionBy("f2").orderBy("i2"))).where("nth <= last.room").select("f2", "i2", F.lit(True).alias("in_room")).distinct()
    out = joined.join(ranked, F.col("format").eqNullSafe(F.col("f2")) & F.col("id").eqNullSafe(F.col("i2")), "left")
    winner = (F.col("views") > F.col("last.views")) | F.coalesce("in_room", F.lit(False))
    return out.withColumn("winner", winner).drop("f", "last", "f2", "i2", "in_room")


def shape_rates(cohort: DataFrame) -> DataFrame:
    """One row for each shape: counts and rates among winners and the rest, lift, recommend.

    One pass: every shape is a conditional sum, and the seven results are stacked afterwards.
    """
    sums = [F.sum(F.when(X.has_shape(s, F.col("title")) & (F.col("winner") == w), 1).otherwise(0)).alias(f"{s}_{int(w)}") for s in X.SHAPES for w in (True, False)]
    one = cohort.agg(F.count_if("winner").alias("w"), F.count_if(~F.col("winner")).alias("r"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), F.col(f"{s}_1").alias("winners_using_it"), F.col(f"{s}_0").alias("rest_using_it")) for s in X.SHAPES])).alias("x")
    out = one.select("w", "r", rows).select("w", "r", "x.*")
    out = out.withColumn("winner_rate", F.col("winners_using_it") / F.greatest("w", F.lit(1))).withColumn("rest_rate", F.col("rest_using_it") / F.greatest("r", F.lit(1)))
    out = out.withColumn("lift", (F.col("winner_rate") + 0.01) / (F.col("rest_rate") + 0.01))
    return out.withColumn("recommend", (F.col("winners_using_it") >= MIN_PER_BUCKET) & (F.col("lift") >= 1.25)).drop("w", "r")


def over_represented(cohort: DataFrame, stop: list[str], asked: list[str] | None = None, top: int = 12) -> DataFrame:
    """Words that more winners than others have: add-one log ratio of document counts, top few.

    A word with a capital inside a title is a name there and not counted; words of the searches `asked` are
    left out, since every result has them.
    """
    proper = F.transform(F.regexp_extract_all("title", F.lit(r"(?<=[a-z,] )[A-Z][a-z]{2,}"), F.lit(0)), lambda w: F.lower(w))
    word = F.explode(F.array_except(F.array_distinct(X.words(F.col("title"))), proper)).alias("word")
    queried = [w for q in asked or [] for w in re.findall(r"[a-z']+", q.lower()) if len(w) > 2]
    docs = cohort.select("winner", word).where((F.length("word") > 2) & ~F.col("word").isin(*stop, *queried))
    counts = docs.groupBy("word").agg(F.count_if("winner").alias("in_winners"), F.count_if(~F.col("winner")).alias("in_rest"))
    totals = docs.agg(F.greatest(F.count_if("winner"), F.lit(1)).alias("tw"), F.greatest(F.count_if(~F.col("winner")), F.lit(1)).alias("tr"))
    lift = F.log(((F.col("in_winners") + 1) / F.col("tw")) / ((F.col("in_rest") + 1) / F.col("tr")))
    scored = counts.where("in_winners >= 3").join(F.broadcast(totals)).select("word", "in_winners", F.round(lift, 2).alias("lift"))
    return scored.orderBy(F.desc("lift"), F.desc("in_winners"), F.desc("word")).limit(top)


def profile(videos: DataFrame) -> DataFrame:
    """One row: sizes, medians of all and of winners, confidence."""
    marked = videos.join(winners(videos).select("id", "winner"), "id", "left")
    won = F.coalesce("winner", F.lit(False))
    return marked.agg(
        F.count("*").alias("videos"), F.count_if(won).alias("winners"), F.count_if(F.col("winner").isNull()).alias("dropped"), (F.count("*") >= MIN_SAMPLE).alias("confident"),
        F.percentile("views", F.lit(0.5)).alias("median_all"), F.percentile(F.when(won, F.col("views")), F.lit(0.5)).alias("median_winners"))


def quantiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """Exact p10 to p90 with linear interpolation, least and most, for each group."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    out = df.groupBy(by).agg(q.alias("q"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(by, *[F.col("q")[i].alias(f"p{p}") for i, p in enumerate((10, 25, 50, 75, 90))], "least", "most")
