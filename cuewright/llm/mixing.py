"""Mixing sources to target weights by Pfair scheduling.

Weights become whole shares a of a period of slots; the period follows from the weights, so that the
smallest has RESOLUTION slots (see `period_for` for its bounds). Each source's rows are cut into blocks of
BLOCK rows, in hash order. Block k (from 1) of a source of weight w = a / period is released at slot
floor((k - 1) / w) and due by slot ceil(k / w); in each slot the released block with the earliest
deadline runs. After a period every source has had exactly its share, so one period is scheduled and
repeated; at any slot each source is less than one block off its share.

Sources of one share have the same releases and deadlines, so they are one class, which serves its
sources in turn. The fold that schedules a period holds a number for each class, and different shares
that sum to at most a period are at most sqrt(2 * period), however many sources there are.

All rows stay: when a source ends, its later slots are skipped. So the deviation holds as long as all
sources last. Only DataFrame functions are used, and no window gathers a source or the whole in one
task. Defined results: a null source is a source of its own; texts are not looked at; rows that repeat are
placed each; equal rows are interchangeable; other columns pass through, whatever their names, but
mix_slot, mix_block and mix_position are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, gapless_rank, small

BLOCK, PERIOD, POWER, RESOLUTION, LONGEST = 16, 1000, 0.5, 8, 100_000


def period_for(sources: int, total: float, least: float) -> int:
    """Slots of a period: RESOLUTION for the smallest weight, PERIOD at least.

    Beyond LONGEST slots the smallest weights are rounded up to one slot, but a period has RESOLUTION
    slots for each source on average, so that rounding moves at most 1 / RESOLUTION of the slots.
    """
    wanted = math.ceil(RESOLUTION * total / least) if least > 0 else PERIOD
    return max(PERIOD, min(wanted, max(LONGEST, RESOLUTION * sources)))


def shares(docs: DataFrame, group: str, power: float = POWER, period: int | None = None) -> DataFrame:
    """_src, n and share (1 at least) of each source; the shares sum to the period, or to a little more where
    many sources round up to 1.

    Target weight: rows ** power. Whole shares go by largest remainder, ties to the smaller name.
    """
    weight = F.pow(F.count("*").cast("double"), F.lit(power))
    counts = cut(docs.groupBy(F.col(group).alias("_src")).agg(F.count("*").alias("n"), weight.alias("_w")))
    found = counts.agg(F.count("*").alias("k"), F.sum("_w").alias("total"), F.min("_w").alias("least")).first()
    if not found["k"]:
        return counts.select("_src", "n", F.lit(1).cast("bigint").alias("share"))
    slots_ = max(period or period_for(found["k"], found["total"], found["least"]), found["k"])
    # a source under one slot gets one, the others share the rest by weight
    large = F.col("_w") * slots_ >= found["total"]
    over = counts.agg(F.count_if(~large).alias("k"), F.sum(F.when(large, F.col("_w"))).alias("total")).first()
    ideal = F.when(large, F.col("_w") / (over["total"] or 1.0) * (slots_ - over["k"])).otherwise(1.0)
    ideal = cut(counts.withColumn("_ideal", ideal).withColumn("_base", F.greatest(F.lit(1).cast("bigint"), F.floor("_ideal"))).withColumn("_rest", F.greatest(F.lit(0.0), F.col("_ideal") - F.col("_base"))))
    short = slots_ - ideal.agg(F.sum("_base")).first()[0]
    # remainders from 1 down to 0 over the range of a long
    key = ((0.5 - F.col("_rest")) * 1.8e19).cast("bigint")
    ranked = gapless_rank(ideal, [], key, [F.col("_src").asc_nulls_first()], "_rank")
    return ranked.select("_src", "n", (F.col("_base") + (F.col("_rank") < short).cast("bigint")).alias("share"))


def schedule(shares_: DataFrame) -> DataFrame:
    """share, sources of that share, period, turn of the class (from 0) in the period, and its slot.

    In turn c the class runs block c // sources of its source c % sources.
    """
    by = shares_.groupBy("share").agg(F.count("*").alias("m")).agg(F.array_sort(F.collect_list(F.struct("share", "m"))).alias("s"), F.sum(F.col("share") * F.col("m")).alias("period"))
    # a number for each class: turns done. Slots are folded in order, in stretches, so that no long array is copied for each
    k = "(acc.done[j] DIV x.m)"
    free_ = f"{k} < x.share AND ({k} * period) DIV x.share <= t"
    due = f"((({k} + 1) * period) DIV x.share + IF((({k} + 1) * period) % x.share > 0, 1, 0))"
    pick = f"array_min(filter(transform(s, (x, j) -> IF({free_}, struct({due} AS d, CAST(j AS BIGINT) AS i), NULL)), y -> y IS NOT NULL)).i"
    step = f"""(acc, t) -> aggregate(array({pick}), acc, (a, p) -> named_struct(
        'done', transform(a.done, (d, j) -> d + IF(j = p, 1L, 0L)), 'run', a.run || array(struct(p AS i, a.done[CAST(p AS INT)] AS c, t AS t))))"""
    none = "CAST(array() AS ARRAY<STRUCT<i: BIGINT, c: BIGINT, t: BIGINT>>)"
    fold = f"""aggregate(sequence(0L, (period - 1) DIV 500),
        named_struct('done', transform(s, x -> 0L), 'runs', CAST(array() AS ARRAY<ARRAY<STRUCT<i: BIGINT, c: BIGINT, t: BIGINT>>>)),
        (outer, u) -> aggregate(
            array(aggregate(sequence(u * 500, least(u * 500 + 499, period - 1)), named_struct('done', outer.done, 'run', {none}), {step})),
            outer, (o, r) -> named_struct('done', r.done, 'runs', o.runs || array(r.run))),
        outer -> flatten(outer.runs))"""
    runs = by.where(F.size("s") > 0).select("period", "s", F.expr(fold).alias("runs")).select("period", "s", F.explode_outer("runs").alias("r"))  # outer: else the fold runs once more, as a filter
    at = lambda f: F.expr(f"s[CAST(r.i AS INT)].{f}")
    return runs.select(at("share").alias("share"), at("m").alias("m"), "period", F.col("r.c").alias("turn"), F.col("r.t").alias("slot"))


def _ties(docs: DataFrame) -> list[str]:
    return ["doc_id"] + [c for c in ("text",) if c in docs.columns]


def in_slot(docs: DataFrame) -> list[Column]:
    """The order of the mix: by slot, and inside a slot by hash."""
    return [F.col("mix_slot"), F.xxhash64("doc_id", F.lit("mix")), *[F.col(c) for c in _ties(docs)]]


def slots(docs: DataFrame, group: str = "source", power: float = POWER, period: int | None = None, block: int = BLOCK, weights: DataFrame | None = None) -> tuple[DataFrame, int]:
    """docs with mix_block and mix_slot (its block's slot), and their number; rows are exchanged once.

    weights: _src, n and share as from shares(), if targets other than rows ** power are wanted.
    """
    docs = docs.drop("mix_block", "mix_slot", "mix_position")
    parts = cut(weights if weights is not None else shares(docs, group, power, period))
    plan = cut(schedule(parts))  # a row for each slot of one period
    n = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    s, share, m, member, of, turn, slot, span, rank = free(docs, "_s", "_share", "_m", "_member", "_of", "_turn", "_slot", "_span", "_rank")
    # each source's place among those of its share
    placed = gapless_rank(parts, ["share"], F.xxhash64("_src"), ["_src"], "_place").select(F.col("_src").alias(s), F.col("share").alias(share), F.col("_place").alias(member))
    ranked = gapless_rank(docs, [group], F.xxhash64("doc_id", F.lit("mix")), _ties(docs), rank)
    ranked = ranked.withColumn("mix_block", F.floor(F.col(rank) / block)).join(small(cut(placed)), F.col(group).eqNullSafe(F.col(s))).drop(s, rank)
    classes = plan.groupBy(F.col("share").alias(of)).agg(F.first("m").alias(m), F.first("period").alias(span))  # at most sqrt(2 * period) rows
    ranked = ranked.join(small(classes), F.col(share) == F.col(of)).drop(of)
    ranked = ranked.withColumn(turn, F.col("mix_block") % F.col(share) * F.col(m) + F.col(member))
    runs = plan.select(F.col("share").alias(of), F.col("turn").alias(rank), F.col("slot").alias(slot))
    ranked = ranked.join(small(runs), (F.col(share) == F.col(of)) & (F.col(turn) == F.col(rank)))
    ranked = ranked.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col(share)) * F.col(span) + F.col(slot))
    return ranked.drop(share, m, member, of, turn, slot, span, rank), n


def mix(docs: DataFrame, group: str = "source", power: float = POWER, period: int | None = None, block: int = BLOCK, weights: DataFrame | None = None) -> DataFrame:
    """docs with mix_block, mix_slot and mix_position (gapless order of all rows)."""
    placed, n = slots(docs, group, power, period, block, weights)
    stretch, st, off, rn = free(placed, "_stretch", "_st", "_off", "_rn")
    # gapless positions over all rows: at most about 100,000 stretches of slots are counted, then rows ranked inside each
    placed = placed.withColumn(stretch, F.floor(F.col("mix_slot") / max(512, n // (100_000 * block))))
    before = Window.orderBy(stretch).rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(stretch).agg(F.count("*").alias(rn)).select(F.col(stretch).alias(st), F.coalesce(F.sum(rn).over(before), F.lit(0)).alias(off))
    own = Window.partitionBy(stretch).orderBy(*in_slot(placed))
    out = placed.withColumn(rn, F.row_number().over(own)).join(offsets, F.col(stretch) == F.col(st))
    return out.withColumn("mix_position", (F.col(off) + F.col(rn) - 1).cast("bigint")).drop(stretch, st, off, rn)


def query(spark, sf_dir):
    from .common import read

    mixed = mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", "source", "mix_block", "mix_slot", "mix_position")
