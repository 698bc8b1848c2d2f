"""Files in every shape, bad ones included; layers; blocks at any depth; captions for networks."""

import re

from pyspark.sql import functions as F

from cuewright.operators import networks
from cuewright.plans import files as plans
from cuewright.sources import cutlists, trees

SHAPES = {
    "batch": '{"times": " SOURCE ", "pieces": [{"piece": " A ", "hook": {"text": " h "}, "duration": "9.5", "cards": [{"text": "one", "start": 1, "end": "2"}, {"text": 5}], "segments": [{"start": 1, "end": 3}, {"start": 5, "end": 4}, {"end": 4}, {"start": 20, "end": 30}, {"start": 8, "end": 12}]}, {"name": "no cards"}, 7]}',
    "one": '﻿{"filename": "f", "hook_text": "", "hook": "said", "caption_cards": [[0, 1.5, "three"], [1, 2], 4, {"start": 1}], "cards": [{"text": "not read"}]}',
    "list": '[{"id": 7, "cards": []}, {"id": "b", "cards": [{"text": "x", "start": "no", "end": null}]}]',
    "objects": '[{"text": "p", "start": 0, "end": 1}]',
    "triples": '[[0, 1, "q"], [1, 2, "r", "more"]]',
    "broken": '{"cards": [',
    "other": '{"a": 1}',
    "empty": "[]",
    "null": None,
}


def shapes(spark, tmp_path):
    """Written as files and read back, but for the null one."""
    for name, text in SHAPES.items():
        if text is not None:
            (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    read = spark.read.text(str(tmp_path), wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("file"), "value")
    return read.unionByName(spark.createDataFrame([("null", None)], "file string, value string"))


def test_every_shape(spark, tmp_path):
    files = shapes(spark, tmp_path)
    got = {(r["file"], r["ord"]): (r["name"], r["duration"], r["hook"], r["times"], r["n_cards"]) for r in cutlists.pieces(files).collect()}
    assert got == {("batch", 1): ("A", 9.5, "h", "source", 2), ("one", 1): ("f", None, "said", None, 4), ("list", 1): ("piece 1", None, None, None, 0), ("list", 2): ("b", None, None, None, 1), ("objects", 1): ("piece 1", None, None, None, 1), ("triples", 1): ("piece 1", None, None, None, 2)}
    cards = {(r["file"], r["ord"], r["card"]): (r["text"], r["start"], r["end"]) for r in cutlists.cards(files).collect()}
    assert cards == {("batch", 1, 1): ("one", 1.0, 2.0), ("batch", 1, 2): ("5", None, None), ("one", 1, 1): ("three", 0.0, 1.5), ("list", 2, 1): ("x", None, None), ("objects", 1, 1): ("p", 0.0, 1.0), ("triples", 1, 1): ("q", 0.0, 1.0), ("triples", 1, 2): ("r", 1.0, 2.0)}
    faults = {(r["file"], r["ord"], r["part"], r["fault"]) for r in cutlists.faults(files, 10.0).collect()}
    assert faults == {
        ("batch", 2, None, "piece carries no cards"), ("batch", 3, None, "piece carries no cards"), ("batch", 1, 2, "segment ends before it starts"), ("batch", 1, 3, "segment needs start and end"),
        ("batch", 1, 4, "segment starts behind the end of the source"), ("batch", 1, 5, "segment ends behind the end of the source, clamped"),
        ("one", 1, 2, "card is neither an object nor [start, end, text]"), ("one", 1, 3, "card is neither an object nor [start, end, text]"), ("one", 1, 4, "card has no text"),
        ("broken", None, None, "file is no readable JSON"), ("null", None, None, "file is no readable JSON"), ("other", None, None, "file holds no card list that is understood"), ("empty", None, None, "file holds no card list that is understood"),
    }
    assert [(r["seg"], r["start"], r["end"]) for r in cutlists.segments(files, 10.0).where("file = 'batch'").orderBy("seg").collect()] == [(1, 1.0, 3.0), (5, 8.0, 10.0)]


def test_cards_move_to_where_they_play(spark):
    cards = spark.createDataFrame([("f", 1, 1, "a", 12.0, 14.0), ("f", 1, 2, "b", 3.0, 9.0), ("f", 1, 3, "c", 7.0, 8.0), ("f", 1, 4, "d", None, None), ("g", 1, 1, "e", 7.0, 8.0)], "file string, ord int, card int, text string, start double, end double")
    segs = spark.createDataFrame([("f", 1, 1, 10.0, 20.0), ("f", 1, 2, 2.0, 5.0)], "file string, ord int, seg int, start double, end double")
    got = {(r["file"], r["card"]): (r["start"], r["end"], r["dropped"]) for r in cutlists.on_clip(cards, segs).collect()}
    assert got == {("f", 1): (2.0, 4.0, False), ("f", 2): (11.0, 13.0, False), ("f", 3): (7.0, 8.0, True), ("f", 4): (None, None, False), ("g", 1): (7.0, 8.0, False)}


def test_clips_of_every_collection(spark):
    files = spark.createDataFrame([
        ("a", '[{"filename": "x", "segments": [{"start": 0, "end": 5}, {"start": 4, "end": 6}, {"start": 9}]}, 3, {"rank": 4}]'),
        ("b", '{"built": {"k1": {"start": 0, "end": 10, "internal_cuts": [[2, 3], [5, 6]], "duration": 8}, "k2": {"filename": "y", "start": 1, "end": 2}}}'),
        ("c", '{"nothing": 1}'),
    ], "file string, value string")
    got = {(r["file"], r["name"]): (r["shape"], r["stated"], r["note"]) for r in cutlists.clips(files).collect()}
    assert got == {("a", "x"): ("3 segments", None, None), ("a", "list #4"): (None, None, "no segments and no start and end"), ("b", "k1"): ("span less 2 ranges", 8.0, None), ("b", "k2 y"): ("one span", None, None), ("c", None): (None, None, "no collection of clips in this file")}
    tape = sorted((r["id"]["file"], r["id"]["ord"], r["s"], r["e"]) for r in cutlists.used_tape(cutlists.clips(files)).collect())
    assert tape == [("a", 1, 0.0, 6.0), ("b", 1, 0.0, 2.0), ("b", 1, 3.0, 5.0), ("b", 1, 6.0, 10.0), ("b", 2, 1.0, 2.0)]


def test_layers_at_any_depth(spark):
    rows = [(1, 0, '{"a": {"b": {"c": 1, "d": 2}}, "x": [1, 2], "y": {"z": 1}, "k": 1}'), (1, 1, '{"a": {"b": {"c": 3}}, "y": 5, "k": null}'), (1, 2, '{"a": {"b": {"e": {"f": 4}}}, "x": {"w": 1}, "y": {"q": 2}}'), (2, 0, "no json"), (3, 5, '{"e": {}}')]
    got = {(r["id"], ".".join(r["path"])): (r["leaf"], r["layer"]) for r in trees.merged(spark.createDataFrame(rows, "id int, layer int, value string")).collect()}
    assert got == {(1, "a.b.c"): ("3", 1), (1, "a.b.d"): ("2", 0), (1, "a.b.e.f"): ("4", 2), (1, "x.w"): ("1", 2), (1, "y.q"): ("2", 2), (1, "k"): ("1", 0)}


def test_nodes_in_the_order_of_the_text(spark):
    deep = '{"v": {"n": 1, "in": [{"v": {"n": 2}}]}, "o": ' + "[" * 500 + '{"v": {"n": 3}}' + "]" * 500 + "}"
    got = trees.nodes(spark.createDataFrame([("f", deep), ("g", "{"), ("h", None)], "file string, value string"), ["v"]).orderBy("ord").collect()
    assert [(r["file"], r["ord"], re.findall(r'"n": (\d)', r["node"])[0]) for r in got] == [("f", 1, "1"), ("f", 2, "2"), ("f", 3, "3")]


def test_results_without_parts(spark):
    blobs = [("a", '{"x": [{"videoRenderer": {"title": {"runs": [{"text": "T"}]}}}, {"videoRenderer": {"title": {"runs": [{"text": "T"}]}}}, {"videoRenderer": {}}, {"shortsLockupViewModel": {"overlayMetadata": {"primaryText": {"content": "S"}, "secondaryText": {"content": "No views"}}}}]}')]
    got = [(r["format"], r["title"], r["views"], r["id"]) for r in trees.results(trees.nodes(spark.createDataFrame(blobs, "file string, value string"), [trees.LONG, *trees.SHORT])).orderBy("ord").collect()]
    assert got == [("long", "T", None, None), ("short", "S", 0, None)]


# ---------------------------------------------------------------- networks

ABBREVIATED = set(networks.ABBREVIATED.split("|"))


def shortened(text, limit):
    if len(text) <= limit:
        return text
    best = 0
    for i in range(1, limit + 1):
        if text[i] == "\n":
            best = i
        elif text[i - 1] in ".!?…" and text[i].isspace():
            word = re.search(r"([A-Za-z'’]+)$", text[: i - 1])
            if not word or (len(word[1]) > 1 and word[1].lower() not in ABBREVIATED):
                best = i
    return text[:best].rstrip() if best else text[:limit].rsplit(" ", 1)[0].rstrip(" ,;:")


def test_trim_against_plain_python(spark, sf):
    texts = [r["text"] for r in plans.captions(spark, sf).collect()] + ["no end here at all of it", "A b. W. W. Westcott tr. by Dr. Who. Then more", "one.\n\ntwo", "x" * 99, "end.Next one. And", "", "a, b"]
    rows = [(k, t, n) for k, t in enumerate(texts) for n in (5, 20, 60, 140, 900)]
    got = spark.createDataFrame(rows, "k long, t string, n int").select("t", "n", networks.trim(F.col("t"), F.col("n")).alias("x")).collect()
    for r in got:
        assert r["x"] == shortened(r["t"], r["n"]), (r["t"][: r["n"] + 5], r["n"], r["x"])


def test_rules_of_a_network_over_the_general_ones(spark):
    got = {r["network"]: (r["limit"], r["max_hashtags"], r["links"], r["mentions"], r["bio_phrase"]) for r in plans.network_rules(spark, None).collect()}
    assert got == {"plain": (900, 3, "inline", "keep", "link in bio"), "short": (140, 3, "strip", "keep", "link in bio"), "bio": (900, 3, "bio", "strip", "link in bio"), "bare": (60, 0, "inline", "keep", "link in bio")}


def test_captions_for_networks(spark):
    caps = spark.createDataFrame([(1, "#a @b\nWords here. See https://x.y now. #c #d #e"), (2, "#only"), (3, "Fine."), (4, "Long words of this caption go on. " * 3 + "https://x.y/z")], "id long, text string")
    got = {(r["id"], r["network"]): (r["text"], r["notes"]) for r in networks.adapt(caps, plans.network_rules(spark, None)).collect()}
    assert got[3, "plain"] == ("Fine.", ["fits as written"])
    assert got[1, "plain"] == ("Words here. See https://x.y now. #c #d\n\n#a @b", ["cut hashtags from 4 to 3", "moved the opening tags to the end"])
    assert got[1, "bio"] == ("#a Words here. See link in bio now. #c #d", ["removed 1 handles", "cut hashtags from 4 to 3", "the link reads: link in bio", "WARNING: opens with tags and has nothing else to lead with"])
    assert got[2, "plain"][1] == ["WARNING: opens with tags and has nothing else to lead with"]
    assert got[4, "bare"] == ("Long words of this caption go on.", ["trimmed to 60 characters", "WARNING: the trim cut the link off"])
    assert got[4, "short"][0] == ("Long words of this caption go on. " * 3).strip()


# ---------------------------------------------------------------- transcripts of other tools

ODD = "1\n00:00:01,500 --> 00:00:02,000\n<i>one</i> two\n3\n\n2\nno time here\n\n\n00:00:03.000 --> later\nhalf a time\n00:00:05,000 --> 00:00:06,250\nright behind it\n\n4\n00:00:07,000 --> 00:00:08,000\n\n9\n00:00:09,000 --> 00:00:10,000 x\n\n"


def test_each_reader_has_its_own_rules(spark):
    from cuewright.sources import blocks

    files = spark.createDataFrame([(1, ODD), (2, '[{"start": 1, "end": 2, "text": " a "}, {"start": 3, "text": "b"}]'), (3, "")], "rec long, value string")
    rows = lambda df: [tuple(r) for r in df.where("rec = 1").orderBy("cue").collect()]
    assert rows(blocks.forgiving(files)) == [(1, 0, 1.5, 2.0, "<i>one</i> two"), (1, 1, None, None, "no time here"), (1, 2, None, None, "half a time right behind it")]
    assert [r[1:] for r in rows(blocks.shifted(files, 10.0))] == [(0, 11.5, 12.0, "<i>one</i> two 3"), (1, 15.0, 16.25, "right behind it"), (2, 17.0, 18.0, ""), (3, 19.0, 20.0, "")]
    assert [r[1:3] for r in rows(blocks.strict(files))][:1] == [(0, 1.5)]
    assert [tuple(r) for r in blocks.strict(files).where("rec = 2").collect()] == [(2, 0, 1.0, 2.0, "a")]
    assert [(r["start"], r["head"], r["text"]) for r in blocks.headed(files).where("rec = 1").orderBy("cue").collect()] == [
        (1.5, "1\n00:00:01,500 --> 00:00:02,000", "<i>one</i> two 3"), (None, "2", "no time here"), (3.0, "00:00:03.000 --> later", "half a time"), (5.0, "00:00:05,000 --> 00:00:06,250", "right behind it"),
    ]


def test_misheard_words_are_written_back(spark):
    from cuewright.sources import blocks

    cues = spark.createDataFrame([(1, 0, "h0", "We sold the coach"), (1, 1, "h1", "is , and the rest. Then some"), (1, 2, "h2", "more words")], "rec long, cue long, head string, text string")
    found = {(r["pos"], r["word"], r["cue"], r["at"]) for r in blocks.words(cues).collect()}
    assert {(3, "coach", 0, 12), (4, "is", 1, 0), (7, "rest", 1, 13)} <= found and len(found) == 12
    suspects = spark.createDataFrame([(1, 3, 2, "couches"), (1, 6, 2, "chest"), (1, 9, 3, "x")], "rec long, pos long, n int, probably string")
    fixed = blocks.corrected(cues, suspects)
    assert [r["text"] for r in fixed.orderBy("cue").collect()] == ["We sold the couches", ", and chest. Then x", ""]
    assert blocks.to_text(fixed).first()["value"].startswith("h0\nWe sold the couches\n\nh1\n")


def test_words_written_back_into_whole_recordings(spark, sf):
    import re as regex
    from collections import defaultdict

    from cuewright.sources import blocks

    cues = defaultdict(list)
    for r in blocks.headed(plans.spoken_files(spark, sf)).orderBy("rec", "cue").collect():
        cues[r["rec"]].append(r["text"])
    want = {}
    for rec, texts in cues.items():
        flat = [(k, m.start(), m.end()) for k, t in enumerate(texts) for m in regex.finditer("[A-Za-z']+", t)]
        edits = []
        for p in range(4, len(flat), 10):
            by_cue = defaultdict(list)
            for k, a, b in flat[p : p + 2]:
                by_cue[k] += [a, b]
            edits += [(k, min(x), max(x), "meant" if k == flat[p][0] else "") for k, x in by_cue.items()]
        for k, a, b, new in sorted(edits, reverse=True):
            texts[k] = texts[k][:a] + new + texts[k][b:]
        for k in {e[0] for e in edits}:
            texts[k] = regex.sub(r"\s+([,.?!])", r"\1", regex.sub(r"\s{2,}", " ", texts[k])).strip()
        want |= {(rec, k): t for k, t in enumerate(texts)}
    got = {(r["rec"], r["cue"]): r["text"] for r in plans.QUERIES["g9_corrected_cues"][0](spark, sf).collect()}
    assert got == want
