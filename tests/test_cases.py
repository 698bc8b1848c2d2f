"""Operators that SQL does not express, against plain Python and against cases written out."""

import difflib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cuewright.functions import captions, speech
from cuewright.functions import text as X
from cuewright.operators import moments, rules, similarity, spoken, timed
from cuewright.plans import reels as reel_plans
from cuewright.plans import speech as plans
from cuewright.streaming import events


def cards(spark, text, gaps=(), turns=()):
    words = text.split()
    rows, at = [], 0.0
    for i, w in enumerate(words):
        at += 1.0 if i in gaps else 0.1
        rows.append((1, 0, i, w, at, at + 0.2, i in turns))
        at += 0.2
    df = spark.createDataFrame(rows, "rec long, cue long, pos long, word string, t0 double, t1 double, turn boolean")
    return [r["text"] for r in timed.group_cards(df).orderBy("card").collect()]


def test_cards_by_hand(spark):
    assert cards(spark, "one two three four five.") == ["one two three", "four five."]  # rebalanced
    assert cards(spark, "one two, three. four") == ["one two, three.", "four"]  # a lone word joins, and none joins after a full stop
    assert cards(spark, "a b, c. d") == ["a b, c.", "d"]
    assert cards(spark, 'he said "stop." then left') == ['he said "stop."', "then left"]
    assert cards(spark, "one two three four five six", gaps=(2,)) == ["one two", "three four five six"]
    assert cards(spark, "one two three four", turns=(1,)) == ["one", "two three four"]


def test_misheard_against_all_pairs(spark):
    text = "entrepreneur we met an entrepreneur and entre preneur again with entre pre neur or entrepreneur said so the entrepre neurs"
    words = text.split()
    uses = Counter(words)
    known = [w for w, n in uses.items() if len(w) >= 8 and n >= 2]
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    found = []
    for n in (2, 3, 4):
        for i in range(len(words) - n):
            span, joined = words[i : i + n], "".join(words[i : i + n])
            for k in known:
                r = ratio(joined, k) if len(joined) >= 8 and abs(len(joined) - len(k)) <= 4 and joined != k else 0
                if r >= 0.85 and r > max(ratio(w, k) for w in span) + 0.15:
                    found.append((-round(r, 3), i + 1, n, k))
    kept = []
    for r, i, n, k in sorted(found):
        if all(i >= b + m or b >= i + n for _, b, m, _ in kept):
            kept.append((r, i, n, k))
    rows = spark.createDataFrame([(7, i + 1, w) for i, w in enumerate(words)], "rec long, pos long, word string")
    got = similarity.misheard(rows).collect()
    assert sorted((-r["ratio"], r["pos"], r["n"], r["probably"]) for r in got) == sorted(kept) and kept


def test_picked_moments_against_plain_python(spark, sf):
    sents = moments.clean_starts(plans.timed(spark, sf)).cache()
    best = moments.lead_ins(moments.best_ends(moments.scored(moments.windows(sents.drop("starts_clean")))), sents).cache()
    want = {}
    for rec in {r["rec"] for r in best.collect()}:
        kept = []
        for r in sorted(best.where(F.col("rec") == rec).collect(), key=lambda r: (-r["score"], r["end"] - r["start"], r["i"])) if rec < 40 else []:
            clear = lambda s, e: all(e <= b or s >= c for b, c in kept)
            if len(kept) < 5 and clear(r["start"], r["end"]):
                led = r["lead"] is not None and r["end"] - r["lead"] <= 75 and clear(r["lead"], r["end"])
                if r["lead_clean"] if led else r["starts_clean"]:
                    kept.append((r["lead"] if led else r["start"], r["end"]))
        if rec < 40:
            want[rec] = kept
    got = {}
    for r in moments.pick(best.where("rec < 40")).orderBy("rec", "rank").collect():
        got.setdefault(r["rec"], []).append((r["start"], r["end"]))
    assert got == {k: v for k, v in want.items() if v} and got


def without_filler(words):
    """One word after another, as a person would do it."""
    kept, capital, i = [], False, 0
    plain = lambda w: w.lower().strip(".,!?;:'\"()[]’“”—-")
    mark = lambda w: (re.search(r"[.?!]+[\"')\]”’]*$", w) or [""])[0]
    while i < len(words):
        a, b = plain(words[i]), plain(words[i + 1]) if i + 1 < len(words) else None
        take = 2 if f"{a} {b}" in spoken.FILLER_PAIRS else 1 if a in spoken.FILLERS or (a == "like" and words[i].rstrip("”’\"')").endswith(",")) else 0
        if take:
            opens, end = not kept or bool(mark(kept[-1])), mark(words[i + take - 1])
            if end and kept:
                kept[-1] += end
            elif opens or end:
                capital = True
            i += take
            continue
        word = words[i]
        kept.append(word[:1].upper() + word[1:] if capital and word == word.lower() else word)
        capital = False
        i += 1
    return kept


def test_fillers_against_plain_python(spark, sf):
    words = defaultdict(list)
    for r in reel_plans._labelled(spark, sf).orderBy("rec", "n").collect():
        words[r["rec"]].append(r["word"])
    got = defaultdict(list)
    for r in reel_plans.queries()["f8_without_filler"](spark, sf).orderBy("rec", "n").collect():
        got[r["rec"]].append(r["word"])
    assert got == {k: without_filler(v) for k, v in words.items()}


def test_questions_and_openers(spark):
    cases = {"So what do you actually want?": True, "Or you had a stimulant, right?": False, "So I made one rule.": False, "And why?": True, "So": False}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").withColumns(speech.features(F.col("text"))).withColumn("asks", speech.stands_as_question(F.col("text"))).collect()
    assert {r["text"]: r["asks"] for r in rows} == cases
    assert {r["text"]: r["bad_opener"] for r in rows} == {"So what do you actually want?": False, "Or you had a stimulant, right?": True, "So I made one rule.": True, "And why?": True, "So": True}  # two words are an acknowledgement


def test_null_and_empty_sentences(spark):
    rows = spark.createDataFrame([(None,), ("",), ("   ",)], "text string").withColumns(speech.features(F.col("text"))).withColumn("alone", captions.stands_alone(F.col("text"))).collect()
    assert len(rows) == 3 and rows[1]["n_words"] == 0 and rows[1]["numbers"] == [] and rows[1]["alone"] is False
    clips = spark.createDataFrame([(1, [], 5), (2, [""], 5)], "id long, sents array<string>, first int")
    got = {r["id"]: r for r in rules.clip_faults(clips).collect()}
    assert got[1]["verdict"] == 2 and got[1]["faults"][0]["fault"] == "empty" and got[2]["first"] == 5


@pytest.mark.parametrize(("seconds", "want"), [(0.0, "00:00.0"), (65.25, "01:05.2"), (3599.4, "59:59.4"), (3661.04, "1:01:01.0")])
def test_timecodes(spark, seconds, want):
    assert spark.range(1).select(X.timecode(F.lit(seconds)).alias("t")).first()["t"] == want


def test_clauses(spark):
    cases = {"You don't have to pick-- it's not a moral to be-- like a millionaire, and it's not a moral to be broke": ["you don't have to pick", "it's not a moral to be", "like a millionaire", "and it's not a moral to be broke"], "we came and went but they stayed": ["we came and went", "but they stayed"], "": [""]}
    rows = spark.createDataFrame([(t,) for t in cases], "text string").withColumn("c", captions.clauses(F.col("text"))).collect()
    assert {r["text"]: r["c"] for r in rows} == cases


def test_state_goes_on_from_batch_to_batch(spark, tmp_path):
    """Three files, taken one for each batch. Batch n drops what is later than the watermark that batch n - 2 has set."""
    import datetime

    day = lambda n: datetime.datetime(2024, 1, n)
    folder = f"{tmp_path}/in"
    for k, rows in enumerate([[(1, day(1), 1.0), (2, day(9), 2.0)], [(1, day(10), 4.0), (2, day(1), 8.0)], [(1, day(1), 16.0)]]):
        spark.createDataFrame([(u, t, v, "x") for u, t, v in rows], "user_id long, ts timestamp, value double, event_type string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    import os
    import shutil

    os.makedirs(folder)
    for k in (0, 1, 2):
        part = next(f for f in os.listdir(f"{tmp_path}/{k}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/{k}/{part}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1e9 + k, 1e9 + k))
    stream = spark.readStream.schema("user_id long, ts timestamp, value double, event_type string").option("maxFilesPerTrigger", 1).parquet(folder)
    out = events.drained(events.running(stream), "update", f"{tmp_path}/run").collect()
    assert sorted((r["user_id"], r["n"], r["total"]) for r in out) == [(1, 1, 1.0), (1, 2, 5.0), (1, 3, 21.0), (2, 1, 2.0), (2, 2, 10.0)]
    closed = events.drained(events.tumbling(stream), "append", f"{tmp_path}/late").collect()
    assert {(r["start"].day, r["n"]) for r in closed} == {(1, 2)}  # the third file's event of the first day came too late


def test_misheard_words_and_pace_are_in_the_verdict(spark):
    sents = ["It was lost, but then we won the coach is back.", "Everything was at risk that year.", "That changed me."]
    clips = spark.createDataFrame([(1, 1, sents, 60.0), (2, 2, sents, 4.0), (3, 1, [], 0.0)], "id long, rec long, sents array<string>, seconds double")
    got = {r["id"]: r for r in rules.sense(clips, spark.createDataFrame([(1, "coach is", "couches"), (1, "not there", "x")], "rec long, heard string, probably string")).collect()}
    kinds = {i: [f["fault"] for f in r["faults"]] for i, r in got.items()}
    assert "may contain a mis-heard word" in kinds[1] and "may contain a mis-heard word" not in kinds[2] and kinds[3] == ["empty"]
    assert got[1]["note"] == "slow" and got[2]["note"] == "fast" and got[3]["note"] is None and got[3]["verdict"] == 2


def test_samples_are_cleaned_before_their_floor_of_words(spark):
    from cuewright.sources import results

    texts = spark.createDataFrame([
        ("a.md", "# One two\n\n**three** four five\n\nand #tag @me https://x.y\n\nit’s a line"),
        ("b.txt", "one two three\n= = =\nfour five six\n-*-*-\nno"),
        ("c.SRT", "1\n00:00:01,000 --> 00:00:02,000\n<i>one two</i>\n\n2\n00:00:02,000 --> 00:00:03,000\nthree"),
    ], "source string, text string")
    got = {k: [(r["source"], r["ord"], r["kind"], r["text"]) for r in results.samples(texts, k).orderBy("source", "ord").collect()] for k in ("blank", "rule", "file")}
    assert got["blank"] == [("a.md", 1, "written", "three four five"), ("a.md", 3, "written", "it's a line"), ("b.txt", 0, "written", "one two three\n= = =\nfour five six\n---\nno"), ("c.SRT", 0, "transcript", "one two three")]
    assert [r for r in got["rule"] if r[0] == "b.txt"] == [("b.txt", 0, "written", "one two three"), ("b.txt", 1, "written", "four five six")]
    assert [r[3] for r in got["file"] if r[0] == "c.SRT"] == ["one two three"]


def test_optional_metrics_stay_where_they_were_asked_for(spark):
    from cuewright.sources import results

    rows = spark.createDataFrame([(["T here now", "10", "5", "n/a", "2024-01-01", "7"],), (["", "1", "1", "1", "1", "1"],)], "raw array<string>")
    got = results.own_results(rows, ["IGPO03", "IGPO28", "IGPO27", "IGPO14", "IGPO01", "IGPO29"]).collect()
    assert [(r["title"], r["views"], r["shares"], r["reach"], r["date"], r["follows"]) for r in got] == [("T here now", 10.0, 5.0, None, "2024-01-01", 7.0)]
    assert "saved" not in got[0]


def test_an_empty_first_list_hides_no_later_one(spark):
    from cuewright.sources import transcripts

    files = spark.createDataFrame([(1, '{"segments": [], "cues": [{"start": 0, "end": 1, "text": "a"}]}'), (2, '[{"start_time": "2", "end": "3", "text": "b"}]')], "rec long, value string")
    assert [(r["rec"], r["start"], r["text"]) for r in transcripts.json_cues(files).orderBy("rec").collect()] == [(1, 0.0, "a"), (2, 2.0, "b")]
