"""Interval algebra over (id, s, e): islands, gaps, overlaps, clocks and greedy choices.

Overlap joins are bucketed: each interval is exploded into the buckets of WIDTH that it touches, an
equi-join on the bucket follows, and a pair is kept in the bucket where the later of the two begins,
so it appears once. No nested loop and no cross join, whatever the number of intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grouped import settle

TOUCH = 1e-9
#: Ids and the ids that stand for them are broadcast up to this many.
MEMBERS = 1_000_000


def islands(ranges: DataFrame) -> DataFrame:
    """Merged: ranges that overlap or touch become one. id, s, e."""
    before = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col("s") > F.coalesce(F.max("e").over(before), F.lit(float("-inf"))) + TOUCH, 1).otherwise(0)
    upto = Window.partitionBy("id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    grouped = ranges.where("e > s").withColumn("new", new).withColumn("island", F.sum("new").over(upto))
    return grouped.groupBy("id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def gaps(spans: DataFrame, holes: DataFrame) -> DataFrame:
    """spans minus holes, both (id, s, e), one span for each id.

    Islands are read once: each gives what is free before it, the last one also what is free behind it. Those outside
    the span, clamped to one of its ends, take nothing; a span without any is free up to its end.
    """
    met = spans.select("id", F.col("s").alias("lo"), F.col("e").alias("hi")).join(islands(holes), "id", "left")
    clamped = lambda c: F.coalesce(F.least(F.greatest(c, "lo"), "hi"), "hi")
    cut = met.select("id", "lo", "hi", clamped("s").alias("s"), clamped("e").alias("e"))
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.struct(F.coalesce(F.lag("e").over(order), "lo").alias("s"), F.col("s").alias("e"))
    behind = F.when(F.lead("s").over(order).isNull(), F.struct(F.col("e").alias("s"), F.col("hi").alias("e")))
    return cut.select("id", F.array(before, behind).alias("free")).select("id", F.explode("free").alias("x")).select("id", "x.s", "x.e").where("e > s")


def overlaps(a: DataFrame, b: DataFrame, width: float, same: str | None = None) -> DataFrame:
    """Pairs that share time: id_a, id_b, s, e of the shared part. same: one table with itself, `<` or `<=` of id_a and id_b."""

    def dealt(df, x):
        first, last = F.floor(F.col("s") / width), F.floor(F.col("e") / width)
        return df.select(F.col("id").alias(f"id_{x}"), F.col("s").alias(f"s_{x}"), F.col("e").alias(f"e_{x}"), first.alias(f"first_{x}"), F.explode(F.sequence(first, last)).alias("bucket"))

    pairs = dealt(a, "a").join(dealt(b, "b"), "bucket").where("s_a < e_b and s_b < e_a and bucket = greatest(first_a, first_b)")
    if same:
        pairs = pairs.where(f"id_a {same} id_b")
    return pairs.select("id_a", "id_b", F.greatest("s_a", "s_b").alias("s"), F.least("e_a", "e_b").alias("e"))


def copies(ranges: DataFrame) -> DataFrame:
    """id and rep of ranges (id, s, e): the smallest id with the very same ranges. Ids that are null have none."""
    own = ranges.where("id is not null").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("tape"))
    reps = own.groupBy("tape").agg(F.min("id").alias("rep"))
    # null-safe, for a range may lack an end
    return own.join(reps.withColumnRenamed("tape", "same"), F.col("tape").eqNullSafe(F.col("same"))).select("id", "rep")


def self_overlaps(ranges: DataFrame, reps: DataFrame, width: float) -> DataFrame:
    """Overlaps of the representatives with each other and, as their copies have them, with themselves."""
    own = ranges.join(reps.where("id = rep").select("id"), "id", "left_semi")
    n = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a number of its own: few ranges make many pairs, so by their bytes they would be put together into a few tasks
    return overlaps(own, own, width, same="<=").repartition(n, "id_a", "id_b")


def expanded(pairs: DataFrame, reps: DataFrame, sides: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of representatives (id_a <= id_b, ...) given to all pairs of the ids that they stand for, id_a < id_b.

    sides: names of columns that come twice, as NAME_a and NAME_b. Pairs are not moved while the ids (two numbers each)
    can be broadcast.
    """
    if reps.limit(MEMBERS + 1).count() <= MEMBERS:
        reps = F.broadcast(reps)
    member = lambda x: reps.select(F.col("id").alias(f"own_{x}"), F.col("rep").alias(f"id_{x}"))
    both = pairs.join(member("a"), "id_a").join(member("b"), "id_b").where("id_a < id_b or own_a < own_b")
    turned = F.col("own_a") > F.col("own_b")
    values = {f"{c}_{x}": F.when(turned, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}") for c in sides for x, y in ("ab", "ba")}
    ends = [F.least("own_a", "own_b").alias("id_a"), F.greatest("own_a", "own_b").alias("id_b")]
    return both.select(*ends, *[values.get(c, F.col(c)) for c in pairs.columns if c not in ("id_a", "id_b")])


def shared(ranges: DataFrame, width: float, merge: bool = True) -> DataFrame:
    """For each pair of ids: shared seconds, number of shared parts, the longest part.

    Ids with the very same ranges are looked at once, so the parts met are those of different ones.
    """
    own = islands(ranges) if merge else ranges
    reps = settle(copies(own))
    length = F.col("e") - F.col("s")
    pairs = self_overlaps(own, reps, width).groupBy("id_a", "id_b").agg(F.sum(length).alias("seconds"), F.count("*").alias("parts"), F.max(length).alias("longest"))
    return expanded(pairs, reps)


def coverage(spans: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """For each span (id, s, e) that shares time with any of ranges (s, e): id, parts (how many) and seconds shared.

    No pair is made: the parts are the ranges that begin before the span's end less those over by its start, and the
    time filled before an instant follows from the starts and ends before it. These are counted inside buckets of
    WIDTH, moved by the buckets before; a bucket holds a row for each instant. Sums are whole microseconds.
    """
    micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint").cast("decimal(38,0)")
    spans = spans.where("e >= s")
    own = ranges.where("e > s")
    mark = lambda df, c, k, n: df.select((F.col(c) + 0.0).alias("x"), F.lit(k).alias("start"), F.lit(n).alias("end"))
    marks = mark(own, "s", 1, 0).unionByName(mark(own, "e", 0, 1)).unionByName(mark(spans, "s", 0, 0)).unionByName(mark(spans, "e", 0, 0))
    at = marks.groupBy("x").agg(F.sum("start").alias("starts"), F.sum("end").alias("ends")).withColumn("bucket", F.floor(F.col("x") / width))
    # what the starts and ends of one instant add: their numbers, and what they add to the filled time (as open * x - fill)
    at = at.withColumn("fill", (micros("x") * (F.col("starts") - F.col("ends"))).cast("decimal(38,0)"))
    sums = ["starts", "ends", "fill"]
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    zero = lambda c: F.coalesce(c, F.lit(0).cast("decimal(38,0)"))
    offsets = at.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in sums]).select("bucket", *[zero(F.sum(c).over(before)).alias(f"{c}_off") for c in sums])
    inner = Window.partitionBy("bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    known = at.withColumns({f"{c}_in": zero(F.sum(c).over(inner)) for c in sums}).join(offsets, "bucket")
    known = known.select("x", *[(F.col(f"{c}_in") + F.col(f"{c}_off")).cast("decimal(38,0)").alias(f"{c}_before") for c in sums], "ends")
    filled = (micros("x") * (F.col("starts_before") - F.col("ends_before")).cast("decimal(18,0)") - F.col("fill_before")).cast("decimal(38,0)")
    known = known.select("x", F.col("starts_before").cast("bigint").alias("begun"), (F.col("ends_before") + F.col("ends")).cast("bigint").alias("over"), filled.alias("filled"))
    side = lambda c: known.select(F.col("x").alias(c), *[F.col(k).alias(f"{k}_{c}") for k in ("begun", "over", "filled")])
    both = spans.join(side("s"), "s").join(side("e"), "e")
    seconds = ((F.col("filled_e") - F.col("filled_s")).cast("double") / 1e6).alias("seconds")
    return both.select("id", (F.col("begun_e") - F.col("over_s")).alias("parts"), seconds).where("parts > 0")


def locate(points: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """Point-in-interval join, first segment wins: points (p, t), segments (ord, s, e, base) -> p, ord, at."""
    seg = segments.select("*", F.explode(F.sequence(F.floor(F.col("s") / width), F.floor(F.col("e") / width))).alias("bucket"))
    hits = points.withColumn("bucket", F.floor(F.col("t") / width)).join(seg, "bucket").where("t >= s and t <= e")
    best = hits.groupBy("p").agg(F.min_by(F.struct("ord", (F.col("base") + F.col("t") - F.col("s")).alias("at")), "ord").alias("x"))
    return best.select("p", "x.ord", "x.at")


def first_holding(points: DataFrame, ranges: DataFrame, width: float) -> DataFrame:
    """Points (p, t) and the first of the ranges (id, s, e) that holds each: p, ord (its number by s, then id), at (seconds into it).

    A range that ends no later than one before it is never the first to hold a point. The others end in the order of
    their numbers, so a point's is the first that ends at t or later, if it has begun: no point meets more than that one.
    Numbers and ends are taken inside buckets of WIDTH, moved by the buckets before or behind.
    """
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before, behind = past(Window.orderBy("bucket")), past(Window.orderBy(F.desc("bucket")))  # a row for each bucket
    own = Window.partitionBy("bucket").orderBy("s", "id")
    begun = ranges.where("e >= s").select("id", "s", "e", F.floor(F.col("s") / width).alias("bucket"))
    moved = begun.groupBy("bucket").agg(F.count("*").alias("k"), F.max("e").alias("top")).select("bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("off"), F.max("top").over(before).alias("top"))
    upto = F.max("e").over(past(own))
    numbered = begun.withColumns({"rn": F.row_number().over(own), "upto": upto}).join(F.broadcast(moved), "bucket").select((F.col("off") + F.col("rn")).alias("ord"), "s", "e", F.greatest("upto", "top").alias("upto"))
    firsts = numbered.where("upto is null or e > upto").select(F.struct("e", "s", "ord").alias("r"))
    none = F.lit(None).cast(firsts.schema["r"].dataType)
    kind = dict(points.dtypes)["p"]
    both = points.select("p", F.col("t").alias("x"), none.alias("r")).unionByName(firsts.select(F.lit(None).cast(kind).alias("p"), F.col("r.e").alias("x"), "r"))
    both = both.withColumn("bucket", F.floor(F.col("x") / width))
    later = both.groupBy("bucket").agg(F.min("r").alias("r")).select("bucket", F.min("r").over(behind).alias("later"))
    # from the last on, a range before the points that lie where it ends
    upto = Window.partitionBy("bucket").orderBy(F.desc("x"), F.col("r").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumns({"point": F.col("r").isNull(), "r": F.last("r", ignorenulls=True).over(upto)}).where("point")
    met = met.join(F.broadcast(later), "bucket").select("p", F.col("x").alias("t"), F.coalesce("r", "later").alias("r")).where("r.s <= t")
    return met.groupBy("p").agg(F.min(F.struct("r.ord", (F.col("t") - F.col("r.s")).alias("at"))).alias("x")).select("p", "x.ord", "x.at")


def without(rows: DataFrame, forbidden: DataFrame, width: float) -> DataFrame:
    """Rows (id, s, e) that share no time with any forbidden (id, s, e): half-open ranges."""
    hit = overlaps(rows, forbidden, width).select(F.col("id_a").alias("id")).distinct()
    return rows.join(hit, "id", "left_anti")


def sessions(events: DataFrame, gap: float) -> DataFrame:
    """user, t -> id (user), s, e of runs that break where the next event comes more than `gap` later."""
    w = Window.partitionBy("user").orderBy("t", "event")
    new = F.when(F.col("t") - F.lag("t").over(w) > gap, 1).otherwise(0)
    run = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("new", new).withColumn("run", run).groupBy(F.col("user").alias("id"), "run").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


def greedy(scored: DataFrame, k: int = 3) -> DataFrame:
    """Of each id's ranges (s, e, score) the best k that do not overlap: by score, then shorter, then
    earlier. Each choice rests on those before, so it is a grouped function over one id's ranges."""

    def run(pdf):
        pdf = pdf.assign(d=pdf["e"] - pdf["s"]).sort_values(["score", "d", "s"], ascending=[False, True, True])
        kept = []
        for row in pdf.itertuples(index=False):
            if len(kept) < k and all(row.e <= o.s or row.s >= o.e for o in kept):
                kept.append(row)
        return pdf.head(0).assign(rank=0)[["id", "s", "e", "score", "rank"]] if not kept else type(pdf)([(o.id, o.s, o.e, o.score, n + 1) for n, o in enumerate(kept)], columns=["id", "s", "e", "score", "rank"])

    return scored.select("id", "s", "e", "score").groupBy("id").applyInPandas(run, "id long, s double, e double, score double, rank int")
