"""Held-out accuracy of the trained operators, and what they may learn from."""

import zlib

import numpy as np

from cuewright.llm import langid, quality, toxicity

SF = "/root/testdata/sf0.01"


def scored(spark, query, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = query(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    return [(r["doc_id"], r["held_out"], r["score"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]


def auc(rows):
    good, bad = (np.array([s for _, _, s, y in rows if y == k]) for k in (1, 0))
    return ((good[:, None] > bad).mean() + (good[:, None] == bad).mean() / 2), len(good), len(bad)


def test_toxicity(spark):
    rows = scored(spark, toxicity.query, "toxic")
    assert all(h == (zlib.crc32(str(d).encode()) % 4 == 2) for d, h, _, _ in rows)
    assert auc([r for r in rows if r[1]])[0] >= 0.9


def test_quality(spark):
    rows = scored(spark, quality.query, "quality")
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h, _, _ in rows)
    assert auc([r for r in rows if r[1]])[0] >= 0.85


def test_language(spark):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.query(spark, SF).collect()
    held = [(r["lang_pred"], truth[r["doc_id"]][0]) for r in rows if r["held_out"] and truth[r["doc_id"]][0] and langid.has_letter(truth[r["doc_id"]][1])]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) >= 0.97
    assert all((r["lang_pred"] == "und") == (not langid.has_letter(truth[r["doc_id"]][1])) for r in rows)


def test_weights_are_sparse():
    rng = np.random.default_rng(0)
    rows = [(" ".join(f"w{x}" for x in rng.integers(0, 500, 40)) + (" vile" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(300)]
    model = toxicity.fit(rows)
    assert 0 < len(model["at"]) < 2000 and model == toxicity.fit(rows[::-1])


def test_pool_rises():
    edges, steps = quality.pool(np.arange(6.0), np.array([0, 2, 1, 1, 3, 4.0]), np.full(6, 4.0))
    assert (np.diff(steps) > 0).all() and len(edges) == len(steps)


def test_samples_stay_bounded_where_rows_share_an_id(spark):
    """Forty thousand rows of one id, half of them of one text: neither bound nor language is lost."""
    rows = [(7, "the same words of one text again" if k % 2 else f"other words {k} of one id", "en") for k in range(40_000)] + [(k, f"andere Wörter {k} im Text", "de") for k in range(1, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()
    n = {r["lang"]: r["count"] for r in langid.sample(docs, 1000).groupBy("lang").count().collect()}
    assert 300 < n["en"] < 1200 and 600 < n["de"] < 900
    labels = spark.createDataFrame([(k, k % 2) for k in range(900)], "doc_id long, toxic int")
    assert 100 < toxicity.sample(docs, labels, 500).count() < 600
