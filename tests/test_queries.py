"""Registered queries against their SQL, and those without SQL against plain Python."""

import os
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from cuewright.operators import rules, timed
from cuewright.plans import queries as plans


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


#: Rows that differ by rounding alone show only on more of them.
LARGER = ["a14_best_end", "g2_window_signals", "t3_pick_moments", "t3_greedy_ranges", "g5_card_faults", "w22_said_twice", "j8_best_sentence"]


@pytest.mark.parametrize("name", LARGER)
def test_same_rows_as_sql_on_more_of_them(spark, name):
    test_same_rows_as_sql(spark, "/root/testdata/sf0.01", name)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        base.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = plans.queries()[name](spark, sf)
    found = base.execute(plans.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str(tuple(map(plain, r))) for r in found.fetchall())
    assert sorted(str(tuple(map(plain, r))) for r in df.select(*names).collect()) == want


def test_cards_cover_every_word_in_order(spark, sf):
    words = defaultdict(list)
    for r in plans._words(spark, sf).orderBy("rec", "cue", "pos").collect():
        words[r["rec"]].append(r["word"])
    cards = defaultdict(list)
    for r in timed.group_cards(plans._words(spark, sf)).orderBy("rec", "card").collect():
        assert 1 <= len(r["text"].split(" ")) <= 4 and r["end"] > r["start"]
        cards[r["rec"]] += r["text"].split(" ")
    assert cards == words


def test_faults_of_a_clip(spark):
    clips = spark.createDataFrame([(1, []), (2, ["Um.", "It went well and"]), (3, ["I thought it was over.", "But then we lost it all.", "That changed me."])], "id long, sents array<string>")
    got = {r["id"]: r for r in rules.clip_faults(clips).select("id", F.transform("faults", lambda f: f["fault"]).alias("f"), "verdict").collect()}
    assert got[1]["f"] == ["empty"] and got[1]["verdict"] == 2
    assert {"opens on filler", "ends mid sentence", "too few sentences"} <= set(got[2]["f"]) and got[2]["verdict"] == 2
    assert got[3]["f"] == [] and got[3]["verdict"] == 0
