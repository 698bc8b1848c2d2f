"""Two sequences side by side: the longest run of words that both hold, edit scripts, and card lists lined up in order.

Pairs: id, a, b (arrays of words).
"""

from __future__ import annotations

import difflib
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import captions as C
from .grouped import each_group

GAP, PAIR_FLOOR, NEAR, FAR, APART = -0.45, 0.40, 1.0, 8.0, 24.0


def longest_runs(pairs: DataFrame) -> DataFrame:
    """id, size, at_a, at_b: the longest unbroken run of words of a that b holds too; of runs of one size the first in a, then in b.

    Each pair is looked at where it lies, batch by batch. Pairs without a common word have size 0 and no places.
    """

    def run(batches):
        import difflib

        import pyarrow as pa

        for batch in batches:
            found = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = a or [], b or []
                at = difflib.SequenceMatcher(None, a, b, False).find_longest_match(0, len(a), 0, len(b))
                found.append((at.size, at.a, at.b) if at.size else (0, None, None))
            made = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *made], names=["id", "size", "at_a", "at_b"])

    return pairs.select("id", "a", "b").mapInArrow(run, f"id {dict(pairs.dtypes)['id']}, size bigint, at_a int, at_b int")


def edits(pairs: DataFrame, junk: bool = True) -> DataFrame:
    """id, ratio and ops, the steps from a to b: tag (equal, replace, delete, insert), a0, a1, b0, b1.

    The longest common run first, then the same on either side of it; of runs of one size the earliest. With `junk`,
    words that fill over a hundredth of a `b` of 200 words or more begin no run. Pairs are taken batch by batch.
    """
    step = "tag string, a0 int, a1 int, b0 int, b1 int"

    def run(frames):
        import difflib

        for pdf in frames:
            found = [difflib.SequenceMatcher(None, list(a), list(b), autojunk=junk) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            yield pdf[["id"]].assign(ratio=[m.ratio() for m in found], ops=[[dict(zip(("tag", "a0", "a1", "b0", "b1"), o, strict=True)) for o in m.get_opcodes()] for m in found])

    return pairs.mapInPandas(run, f"id {dict(pairs.dtypes)['id']}, ratio double, ops array<struct<{', '.join(x.strip().replace(' ', ': ') for x in step.split(','))}>>")


def line_up(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two card lists of each piece (piece, card, text, start) lined up in order: piece, place, card_a, card_b; one of the two null in a gap.

    The sum of likeness, less what lies between the starts, is as large as it can be; unlike cards over a second
    apart never pair. Each choice rests on all before it, so one function lines up one piece; pieces are many and
    have a few hundred cards at most. Cards stand in the order of start and card.
    """

    def run(rows):
        left, right = ([r for r in rows if r[1] == s] for s in (0, 1))
        n, m = len(left), len(right)
        score = [[-99.0] * m for _ in range(n)]
        for i, (_, _, _, x, at) in enumerate(left):
            for j, (_, _, _, y, other) in enumerate(right):
                apart = abs(at - other)
                like = _ratio(x, y) if apart <= NEAR else _ratio_above(x, y)
                if like >= PAIR_FLOOR or apart <= NEAR:
                    score[i][j] = like - min(apart, FAR) / APART
        best = [[GAP * j for j in range(m + 1)]]
        for i in range(1, n + 1):
            above, own = best[-1], [GAP * i]
            for j in range(1, m + 1):
                own.append(max(above[j - 1] + score[i - 1][j - 1], above[j] + GAP, own[j - 1] + GAP))
            best.append(own)
        i, j, out = n, m, []
        while i or j:
            if i and j and abs(best[i][j] - best[i - 1][j - 1] - score[i - 1][j - 1]) < 1e-9:
                i, j = i - 1, j - 1
                out.append((left[i][2], right[j][2]))
            elif i and abs(best[i][j] - best[i - 1][j] - GAP) < 1e-9:
                i -= 1
                out.append((left[i][2], None))
            else:
                j -= 1
                out.append((None, right[j][2]))
        return [(place, x, y) for place, (x, y) in enumerate(reversed(out), 1)]

    side = lambda cards, s: cards.select("piece", F.lit(s).alias("side"), F.col("card").cast("long").alias("card"), C.flat(F.coalesce("text", F.lit(""))).alias("flat"), F.coalesce("start", F.lit(0.0)).alias("start"))
    return each_group(side(a, 0).unionByName(side(b, 1)), "piece", ["start", "card"], run, "place int, card_a long, card_b long")


@lru_cache(1 << 16)
def _ratio(x: str, y: str) -> float:
    """How alike two texts are, looking from the first at the second."""
    return 1.0 if x == y else difflib.SequenceMatcher(None, x, y).ratio()


@lru_cache(1 << 16)
def _ratio_above(x: str, y: str) -> float:
    """The ratio; 0 where an upper bound of it is below the floor of pairs."""
    if x == y:
        return 1.0
    match = difflib.SequenceMatcher(None, x, y)
    return match.ratio() if match.real_quick_ratio() >= PAIR_FLOOR and match.quick_ratio() >= PAIR_FLOOR else 0.0


def scorecard(lined: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """piece and how many cards of a are kept as they are, reworded or gone in b, and how many of b are new."""
    text = lambda cards, s: cards.select("piece", F.col("card").cast("long").alias(f"card_{s}"), C.flat(F.col("text")).alias(f"text_{s}"))
    both = lined.join(text(a, "a"), ["piece", "card_a"], "left").join(text(b, "b"), ["piece", "card_b"], "left")
    same = F.col("text_a") == F.col("text_b")
    paired = F.col("card_a").isNotNull() & F.col("card_b").isNotNull()
    return both.groupBy("piece").agg(F.count_if(paired & same).alias("kept"), F.count_if(paired & ~same).alias("reworded"), F.count_if(F.col("card_b").isNull()).alias("gone"), F.count_if(F.col("card_a").isNull()).alias("new"))
