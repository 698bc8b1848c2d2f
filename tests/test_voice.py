"""Voices: figures by hand on a small voice, drafts against plain Python on the table."""

import re
from collections import defaultdict

from cuewright.functions import speech as X
from cuewright.operators import voice
from cuewright.plans import voices as plans

SAMPLES = [
    ("a", 1, "Stop waiting. I don't know why! See https://x.y/z #tag @me"),
    ("a", 2, "How do you do it? We do not know 😀\nno mark here"),
    ("a", 3, "Do not do this. You're right."),
    ("b", 4, "#only @tags"),
]


def test_a_profile_by_hand(spark):
    got = {(r["by"], r["block"], r["name"]): r["value"] for r in voice.profile(spark.createDataFrame(SAMPLES, "by string, sample long, text string"), "damn").collect()}
    a = {(b, n): v for (by, b, n), v in got.items() if by == "a"}
    assert a["built_from", "samples"] == 3 and a["built_from", "sentences"] == 8 and a["built_from", "words"] == 25
    assert a["sentence_length", "min"] == 1 and a["sentence_length", "median"] == 3.5 and a["sentence_length", "max"] == 5
    assert a["contractions", "rate_when_possible"] == 0.5 and a["punctuation", "question_rate"] == round(1 / 8, 3) and a["punctuation", "exclamation_rate"] == round(1 / 8, 3)
    assert a["marks", "hashtags"] == 0.33 and a["marks", "links"] == 0.33 and a["emoji", "share_of_samples"] == 0.333
    assert a["opening", "question"] == 0.333 and a["opening", "imperative"] == 0.667
    assert got["b", "built_from", "sentences"] == 0 and got["b", "built_from", "words"] == 0


def test_words_over_used(spark):
    rows = [("a", k, "thing thing plain odd") for k in range(4)] + [("a", 9, "rare rare rare rare")]
    got = [(r["word"], r["uses"], r["in_samples"], r["lift"], r["place"]) for r in voice.over_used(spark.createDataFrame(rows, "by string, sample long, text string"), spark.createDataFrame([("thing", 100.0), ("plain", 400_000.0)], "word string, per_million double")).orderBy("word").collect()]
    assert got == [("odd", 4, 4, None, 1), ("plain", 4, 4, 0.5, 2), ("thing", 8, 4, 4000.0, 1)]


def draft(text, median, lands):
    sents = [x.strip() for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x.strip()]
    if len(sents) < 3:
        return None
    count = lambda s: len(re.findall("[A-Za-z']+", s))
    leans = re.compile(voice.LEANS.replace(X.RIGHT, r"(?!\w)"))
    options = [(round(1 - i / len(sents) + (count(s) <= 14), 9), -i) for i, s in enumerate(sents) if 4 <= count(s) <= 30 and not leans.match(s)]
    if not options:
        return None
    at = -max(options)[1]
    lines, total = [sents[at]], count(sents[at])
    for s in sents[at + 1 :]:
        if count(s) < 2:
            continue
        if total + count(s) > (median or 60) * 1.35:
            break
        lines.append(s)
        total += count(s)
    right = len(lines) > 1 and 3 <= count(lines[-1]) <= 26 and {"statement": lines[-1].endswith("."), "question": lines[-1].endswith("?"), "fragment_like": lines[-1][-1] not in ".!?", "command": False}[lands]
    while not right and len(lines) > 2 and lines[-1][-1] not in ".!?":
        lines.pop()
    return lines, at, right


def test_drafts_against_plain_python(spark, sf):
    own = plans.samples(spark, sf)
    prof = voice.profile(own).collect()
    median = {r["by"]: r["value"] for r in prof if (r["block"], r["name"]) == ("sample_length", "median")}
    lands = defaultdict(list)
    for r in prof:
        if r["block"] == "closing":
            lands[r["by"]].append((-r["value"], r["name"]))
    got = {r["id"]: (r["lines"], r["opener"], r["ends_right"]) for r in plans._drafts(spark, sf).collect()}
    want = {}
    for r in own.collect():
        if any(re.search(voice.SKIPPED.replace(X.RIGHT, r"(?!\w)"), s) for s in re.split(r"(?<=[.!?])\s+", r["text"])) or min(lands[r["by"]])[1] == "command":
            continue
        if d := draft(r["text"], median[r["by"]], min(lands[r["by"]])[1]):
            want[r["sample"]] = d
    assert len(want) > 100 and {k: v for k, v in got.items() if k in want} == want


def test_drift_by_hand(spark):
    voices = spark.createDataFrame([("a", "sentence_length", "p25", 5.0, 1), ("a", "sentence_length", "p75", 9.0, 1), ("a", "contractions", "rate_when_possible", 0.9, 1), ("a", "punctuation", "question_rate", 0.1, 1)], "by string, block string, name string, value double, n long")
    made = spark.createDataFrame([(1, "a", ["Do you do it?", "I do not.", "It is so and do not."]), (2, "a", ["Five words are in here."]), (3, "b", ["No voice."])], "id long, by string, lines array<string>")
    got = {(r["id"], r["block"]): (r["draft"], r["usual"]) for r in voice.drift(made, voices).collect()}
    assert got == {(1, "sentence_length"): (4.0, 5.0), (1, "contractions"): (0.0, 0.9), (1, "questions"): (0.333, 0.1)} or set(got) == {(1, "sentence_length"), (1, "contractions")}
