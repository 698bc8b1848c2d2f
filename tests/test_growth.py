"""Work that grows with the rows and not with their pairs, held against plain Python."""

import random

from cuewright.operators import intervals
from cuewright.plans import queries as plans


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_counts_without_pairs(spark, sf):
    rng = random.Random(5)
    at = lambda: rng.randrange(40) * 0.25  # noqa: E731  many touch or are equal
    ranges = [(n, *sorted((at(), at()))) for n in range(120)] + [(200, -7.5, 30.0), (201, None, 3.0)]
    spans = [(n, *sorted((at(), at()))) for n in range(60)] + [(100, 2.0, 2.0), (101, -90.0, -80.0), (102, -90.0, 90.0), (None, 1.0, 9.0)]
    want = set()
    for i, lo, hi in spans:
        met = [min(e, hi) - max(s, lo) for _, s, e in ranges if s is not None and e > s and s < hi and lo < e]
        if met:
            want.add((i, len(met), sum(met)))
    kind = "id long, s double, e double"
    for width in (0.7, 1000.0):
        got = intervals.coverage(spark.createDataFrame(spans, kind), spark.createDataFrame(ranges, kind), width)
        assert {tuple(r) for r in got.collect()} == want
    assert "Generate" not in plan(plans.queries()["u4_intersect"](spark, sf))  # nothing is dealt into buckets to be paired


def test_words_without_filler_are_not_joined(spark, sf):
    # a table that words or settings were exploded from looks small, so a join of them would be sent to the driver whole
    for name in ("f8_without_filler", "s26_layers"):
        assert "Join" not in plan(plans.queries()[name](spark, sf)).replace("JoinSelection", "")


def test_each_group_reads_groups_across_batches(spark):
    from cuewright.operators.grouped import each_group

    rows = [(k, n, f"t{n}") for k in (*range(50), None) for n in range(k or 7)] * 2
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        run = lambda own: [(len(own), ",".join(t for _, _, t in own))]
        got = each_group(spark.createDataFrame(rows, "k long, n int, t string"), "k", ["n"], run, "size int, all string").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = lambda k: sorted((n, t) for x, n, t in rows if x == k)
    assert {tuple(r) for r in got} == {(k, len(own(k)), ",".join(t for _, t in own(k))) for k in (*range(50), None)} and len(got) == 51


def test_small_groups_have_no_data_frame_each(spark, sf):
    for name in ("w16_beats_of_cards", "m6_lined_up", "a21_scorecard"):
        assert "FlatMapGroups" not in plan(plans.queries()[name](spark, sf))


def test_names_write_words_without_their_sentences(spark, monkeypatch):
    from cuewright.operators import titles

    written, settle = [], titles.settle
    monkeypatch.setattr(titles, "settle", lambda df: written.append(df.columns) or settle(df))
    texts = spark.createDataFrame([(1, "The market fell on bad news. Prices rise again in spring."), (2, "A second market fell.")], "id long, text string")
    first = {r["id"]: r["name"] for r in titles.candidates(texts).where("rank = 1").collect()}
    assert len(first) == 2 and not any("said" in columns for columns in written)
    monkeypatch.setattr(titles, "VOCABULARY", 1)  # the joined way beyond gives the same
    assert {r["id"]: r["name"] for r in titles.candidates(texts).where("rank = 1").collect()} == first


def test_assembly_has_no_data_frame_each(spark, sf):
    for name in ("t4_assembled", "t4_assembled_spoken", "t5_pieces", "t4_problems"):
        assert "FlatMapGroups" not in plan(plans.queries()[name](spark, sf))


def test_tape_that_is_too_short_makes_no_piece():
    import numpy as np

    from cuewright.operators.planning import _tape

    at = lambda *pairs: _tape(*(np.array(c, float) for c in zip(*pairs, strict=True)))
    assert at((0, 4), (2, 6), (1, 3), (8, 9), (8, 8.5)) == 7.0 and at((5, 9), (0, 10)) == 10.0
    assert _tape(np.zeros(0), np.zeros(0)) == 0.0


def test_clips_are_tallied_without_a_row_for_each(spark):
    from pyspark.sql import functions as F

    from cuewright.operators import shelf as S

    rng = random.Random(3)
    words = ["red", "reds", "house", "houses", "housetop", "river", "it's", "boat"]
    some = lambda n: [rng.choice(words) for _ in range(rng.randrange(n))]
    shelf = spark.createDataFrame([(f"c{k}", " ".join(some(3) + ["view"]), some(4), 2.0, None, True) for k in range(60)], "id string, label string, keywords array<string>, duration double, problem string, usable boolean")
    beats = spark.createDataFrame([(k // 4, k % 4, " ".join(some(6))) for k in range(40)] + [(None, 1, "red boat view"), (90, None, None)], "piece long, beat long, text string")
    want = S.scores(beats, shelf).groupBy("piece", "beat").agg(F.count("*").alias("clips"), F.max("score").alias("best"))
    got = S.tally(beats, shelf)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 20


def test_layers_have_no_data_frame_each(spark, sf):
    assert "FlatMapGroups" not in plan(plans.queries()["t7_layers"](spark, sf))


def test_windows_are_not_joined_and_scored_once(spark, sf):
    for name in ("g2_window_signals", "a14_best_end"):
        own = plan(plans.queries()[name](spark, sf))
        # the one join brings what is known of the different texts; the optimiser copies no scoring into a filter
        assert "n2#" not in own and own.count("question_then_answer") == 1


def test_texts_are_looked_at_once_each(spark, monkeypatch):
    from pyspark.sql import functions as F

    from cuewright.functions import speech as X

    rows = [(k, t) for k, t in enumerate(["But why?", None, "", "But why?", "Dana Smith won 40%."] * 3)]
    said = spark.createDataFrame(rows, "k long, text string")
    want = sorted(map(str, said.withColumns(X.features(F.col("text"))).collect()))
    for few in (20_000, 2):  # broadcast, and the way beyond
        monkeypatch.setattr(X, "FEW", few)
        assert sorted(map(str, X.once_each(said, X.features(F.col("text"))).collect())) == want


def test_picks_have_no_data_frame_each(spark, sf):
    assert "FlatMapGroups" not in plan(plans.queries()["t3_pick_moments"](spark, sf))


def _taped(n):
    """Ranges of n ids of which each three have the very same ones, some inside others, and a null id."""
    rng = random.Random(11)
    at = lambda: rng.randrange(60) * 0.5
    tapes = [[tuple(sorted((at(), at()))) for _ in range(rng.randrange(1, 5))] for _ in range(n // 3)]
    return [(k * 7 % n, s, e) for k in range(n) for s, e in tapes[k % len(tapes)] if e > s] + [(None, 0.0, 30.0)]


def _merged(own):
    out = []
    for s, e in sorted(own):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _met(rows, merge):
    """id_a, id_b -> shared parts (s, e), by plain loops."""
    tapes = {i: [(s, e) for k, s, e in rows if k == i] for i in {i for i, _, _ in rows if i is not None}}
    tapes = {i: _merged(own) if merge else own for i, own in tapes.items()}
    met = {(a, b): [(max(s, t), min(e, f)) for s, e in tapes[a] for t, f in tapes[b] if s < f and t < e] for a in tapes for b in tapes if a < b}
    return tapes, {k: v for k, v in met.items() if v}


def _ids_met(monkeypatch):
    ids, overlaps = [], intervals.overlaps
    monkeypatch.setattr(intervals, "overlaps", lambda a, b, *rest, **named: ids.append(a.select("id").distinct().count()) or overlaps(a, b, *rest, **named))
    return ids


def test_copies_share_tape_without_meeting(spark, monkeypatch):
    rows, ids = _taped(30), _ids_met(monkeypatch)
    for members in (intervals.MEMBERS, 0):  # with and without a broadcast of the ids
        monkeypatch.setattr(intervals, "MEMBERS", members)
        for merge in (True, False):
            _, met = _met(rows, merge)
            want = {(a, b, sum(e - s for s, e in own), len(own), max(e - s for s, e in own)) for (a, b), own in met.items()}
            got = intervals.shared(spark.createDataFrame(rows, "id long, s double, e double"), 3.0, merge).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert max(ids) <= 10


def test_duplicates_of_copies_have_their_own_shares(spark, monkeypatch):
    from cuewright.operators import reels

    rows, ids = _taped(30), _ids_met(monkeypatch)
    tapes, met = _met(rows, True)
    whole = lambda i: sum(e - s for s, e in tapes[i])
    want = set()
    for (a, b), own in met.items():
        seconds, late = sum(e - s for s, e in own), max(e for _, e in own)
        s, e = max(own, key=lambda x: (x[1] - x[0], -x[0]))
        if seconds > 1.0:
            want.add((a, b, seconds, len(own), round(100 * seconds / whole(a), 6), round(100 * seconds / whole(b), 6), s, e, all(late > tapes[i][-1][1] - 2.0 for i in (a, b))))
    got = reels.duplicates(spark.createDataFrame(rows, "id long, s double, e double"), 3.0, 1.0, 2.0).collect()
    assert len(got) == len(want) and {(*r[:4], round(r["share_a"], 6), round(r["share_b"], 6), *r[6:]) for r in got} == want
    assert max(ids) <= 10


def test_points_meet_one_range_each(spark, sf):
    rng = random.Random(3)
    at = lambda: rng.randrange(-30, 60) * 0.5  # noqa: E731  many are equal or touch
    ranges = [(rng.randrange(40), *sorted((at(), at()))) for _ in range(60)]
    ranges = list({(i, s): (i, s, e) for i, s, e in ranges}.values())
    points = [(n, at() + rng.choice((0.0, 0.25))) for n in range(200)] + [(200, None)]
    numbered = list(enumerate(sorted(ranges, key=lambda r: (r[1], r[0])), 1))
    want = {(p, *next((n, t - s) for n, (_, s, e) in numbered if s <= t <= e)) for p, t in points if t is not None and any(s <= t <= e for _, s, e in ranges)}
    for width in (0.7, 3.0, 1000.0):
        got = intervals.first_holding(spark.createDataFrame(points, "p long, t double"), spark.createDataFrame(ranges, "id long, s double, e double"), width).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert "Generate" not in plan(plans.queries()["j6_point_in_interval"](spark, sf))  # no range is dealt to all the hours that it fills


def test_gaps_read_islands_once(spark, sf):
    rng = random.Random(8)
    at = lambda: rng.randrange(-20, 40) * 0.5
    holes = [(rng.randrange(30), *sorted((at(), at()))) for _ in range(90)]
    spans = [(i, *sorted((at(), at()))) for i in range(35)] + [(None, 0.0, 9.0)]
    want = set()
    for i, lo, hi in spans:
        edge = lo
        for s, e in [*_merged((s, e) for k, s, e in holes if k == i and e > s and s < hi and e > lo), (hi, hi)]:
            if min(s, hi) > edge:
                want.add((i, edge, min(s, hi)))
            edge = max(edge, e)
    kind = "id long, s double, e double"
    got = intervals.gaps(spark.createDataFrame(spans, kind), spark.createDataFrame(holes, kind)).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    text = plan(plans.queries()["u3_subtract"](spark, sf))
    assert text.count("Join") == 1 and "Union" not in text


def test_voices_look_at_each_text_once(spark):
    from cuewright.operators import voice

    rows = [("a", n, f"Do you see #{n} of it? I don't. It is {n} @you www.x.org 😀") for n in range(30)] + [("b", 99, "")]
    own = spark.createDataFrame(rows, "by string, sample long, text string")
    made = voice.profile(own, "damn")
    assert "regexp" not in plan(made)  # what follows reads counts
    got = {(r["by"], r["block"], r["name"]): r["value"] for r in made.collect()}
    assert [got["a", b, n] for b, n in (("built_from", "samples"), ("built_from", "sentences"), ("marks", "hashtags"), ("marks", "mentions"), ("marks", "links"), ("emoji", "uses"))] == [30, 90, 1, 1, 1, 30]
    assert got["a", "closing", "fragment_like"] == 1 and ("b", "closing", "statement") not in got and got["b", "built_from", "words"] == 0


def test_neighbours_do_not_move(spark, sf):
    for name in ("m5_longest_run", "m6_edits", "f23_typed_words"):
        text = plan(plans.queries()[name](spark, sf))
        assert "Window" not in text and ("Join" not in text or name == "f23_typed_words"), name


def test_swallowed_words_next_to_numbers(spark):
    from cuewright.operators import titles

    texts = spark.createDataFrame([(1, "$5 dollars dollars 40 percent usd 7 and 3. 9 pct! 2000 dollars"), (2, None)], "id long, text string")
    got = [(r["sent"], r["pos"], r["norm"], r["kind"]) for r in titles.typed_words(texts).orderBy("sent", "pos").collect()]
    assert got == [(0, 0, "5", "number"), (0, 1, "dollars", "content"), (0, 2, "40-percent", "number"), (0, 3, "usd", "content"), (0, 4, "7", "number"), (0, 5, "and", "glue"), (0, 6, "", "reject"), (1, 0, "9-percent", "number"), (2, 0, "2k", "number")]


def test_names_stay_with_their_text(spark, monkeypatch):
    from cuewright.operators import titles

    texts = spark.createDataFrame([(n, f"Word{n % 3} prices rise again in spring, 40 percent of markets. The market {'fell' if n % 2 else 'rose'} on word{n}.") for n in range(12)] + [(99, None)], "id long, text string").repartition(3)
    want = [tuple(r) for r in titles.candidates(texts).groupBy("id").agg({"name": "count"}).orderBy("id").collect()]
    found = titles.listed(texts, best=True)
    got = sorted(tuple(r) for r in found.collect())
    assert [r[:2] for r in got] == want and len(got) == 12
    for no in ("Window", "Join", "Aggregate"):  # no name and no word moves to be scored
        assert no not in plan(found)
    monkeypatch.setattr(titles, "VOCABULARY", 2)  # other stems of two texts or more come with their text
    assert sorted(tuple(r) for r in titles.listed(texts, best=True).collect()) == got


def test_names_are_given_out_without_all_options_of_all_texts(spark, monkeypatch):
    from cuewright.operators import titles

    said = ["Stop buying the coaching program. Price the whole life first.", "Price the whole life. Read the fine print twice.", "um", None]
    texts = spark.createDataFrame([(n, said[n % 4]) for n in range(24)], "id long, text string")
    asked, free, words, typed = [], titles.free, [], titles.typed_words
    monkeypatch.setattr(titles, "free", lambda df, held: asked.append(df.columns) or free(df, held))
    monkeypatch.setattr(titles, "typed_words", lambda df: words.append(sorted(r["id"] for r in df.select("id").collect())) or typed(df))
    got = {r["id"]: r["name"] for r in titles.assign(titles.listed(texts), texts).collect()}
    assert len(set(got.values())) == len(got) == 24
    assert words and all(set(w) < set(range(24)) for w in words)  # only texts without a free phrase are read again
    monkeypatch.setattr(titles, "BLOCKS", [0, 2, 3])
    assert {r["id"]: r["name"] for r in titles.assign(titles.candidates(texts), texts).collect()} == got


def test_clips_are_not_sent_to_the_driver(spark, sf):
    # a table that clips' pairs of tokens were exploded from looks small, whatever the shelf
    found = plan(plans.queries()["t6_scores"](spark, sf))
    joins = [x for x in found.splitlines() if "Join" in x and ("pair#" in x or "key#" in x and "word#" in x)]
    assert joins and all("strategy=merge" in x for x in joins)


def test_beats_meet_the_longest_clips_of_a_token_only(spark, monkeypatch):
    from cuewright.operators import shelf as S

    rng = random.Random(3)
    words = ["market", "river", "bridge", "harbour"]
    clips = [(f"c{n:03}", rng.choice([*words, "market river", None]), [rng.choice(words)], rng.choice([0.8, 1.5, 2.0, 4.0, 6.0]), None, True) for n in range(90)]
    kept = spark.createDataFrame(clips, "id string, label string, keywords array<string>, duration double, problem string, usable boolean")
    says = [(b, p, k, k * 3.0, k * 3.0 + 3.0, " ".join(rng.sample(words, rng.randrange(3)))) for b in range(3) for p in (2 * b, 2 * b + 1) for k in range(1, 6)]
    beats = spark.createDataFrame(says, "batch long, piece long, beat int, start double, end double, text string")
    named, heads = S._named(beats, kept, S.usable(kept).where("why is null").select("id", "duration"), 4)
    assert all(len(x) <= 4 for own in heads.values() for x in own.values()) and set(heads) == set(words)
    assert all(len(m["tokens"]) > 1 for r in named.collect() for m in r["met"] or [])  # a clip of one token comes once, not with each beat
    got = sorted(map(tuple, S.layers(beats, kept).collect()))
    monkeypatch.setattr(S, "HEADS", 0)
    assert got and sorted(map(tuple, S.layers(beats, kept).collect())) == got
