"""Edit scripts, longest runs and lined-up cards against the standard library and a plain table."""

import difflib
import random
from collections import defaultdict

from cuewright.operators import sequences
from cuewright.plans import cards as plans


def pairs_of(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(14))]
        b = [x for x in a if rng.random() < 0.7] if k % 2 else [rng.choice("abcdefgh") for _ in range(rng.randrange(14))]
        yield k, a, b


def test_edits_equal_the_standard_library(spark):
    rows = [*pairs_of(10_000, 1), (10_000, ["x"] * 300 + ["y"], ["x"] * 250 + ["y", "z"])]
    got = {r["id"]: (r["ratio"], [tuple(o) for o in r["ops"]]) for r in sequences.edits(spark.createDataFrame(rows, "id long, a array<string>, b array<string>")).collect()}
    for k, a, b in rows:
        m = difflib.SequenceMatcher(None, a, b)
        assert got[k] == (m.ratio(), m.get_opcodes())


def test_longest_runs_equal_the_standard_library(spark):
    rows = list(pairs_of(3000, 2))
    got = {r["id"]: r for r in sequences.longest_runs(spark.createDataFrame(rows, "id long, a array<string>, b array<string>")).collect()}
    for k, a, b in rows:
        m = difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b))
        assert got[k]["size"] == m.size and (not m.size or (got[k]["at_a"], got[k]["at_b"]) == (m.a, m.b))


def lined(a, b):
    """Best total by a table from the back, for lists of (card, flat text, start)."""
    like = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    value = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            options = [0.0] if not i + j else []
            if i and j:
                s, far = like(a[i - 1][1], b[j - 1][1]), abs(a[i - 1][2] - b[j - 1][2])
                options.append(value[i - 1, j - 1] + (-99.0 if s < 0.4 and far > 1 else s - min(far, 8.0) / 24))
            options += [value[at] - 0.45 for at in ((i - 1, j), (i, j - 1)) if min(at) >= 0]
            value[i, j] = max(options)
    return value[len(a), len(b)]


def test_lined_up_cards_are_the_best_order(spark, sf):
    from cuewright.functions import captions as C

    own, other = (df.select("piece", "card", C.flat(df.text).alias("flat"), "start").orderBy("start", "card").collect() for df in (plans.cards(spark, sf), plans._edited(spark, sf)))
    a, b, got = defaultdict(list), defaultdict(list), defaultdict(list)
    for side, rows in ((a, own), (b, other)):
        for r in rows:
            side[r["piece"]].append((r["card"], r["flat"], r["start"]))
    for r in plans._lined(spark, sf).orderBy("piece", "place").collect():
        got[r["piece"]].append((r["card_a"], r["card_b"]))
    for piece in a:
        assert [x for x, _ in got[piece] if x is not None] == [c for c, _, _ in a[piece]]
        assert [y for _, y in got[piece] if y is not None] == [c for c, _, _ in b[piece]]
        left, right = {c: (t, s) for c, t, s in a[piece]}, {c: (t, s) for c, t, s in b[piece]}
        total = 0.0
        for x, y in got[piece]:
            if x is None or y is None:
                total -= 0.45
                continue
            s, far = difflib.SequenceMatcher(None, left[x][0], right[y][0]).ratio(), abs(left[x][1] - right[y][1])
            assert s >= 0.4 or far <= 1
            total += s - min(far, 8.0) / 24
        assert abs(total - lined(a[piece], b[piece])) < 1e-6


def test_scorecard_counts_every_card(spark, sf):
    marks = plans.sequences.scorecard(plans._lined(spark, sf), plans.cards(spark, sf), plans._edited(spark, sf))
    sums = marks.selectExpr("sum(kept + reworded + gone)", "sum(kept + reworded + new)", "sum(kept)", "sum(reworded)").first()
    assert sums[0] == plans.cards(spark, sf).count() and sums[1] == plans._edited(spark, sf).count() and sums[2] > 0 and sums[3] > 0
