"""Long pairs at the threshold, repeated ids and the order of the mix."""

from collections import Counter

import numpy as np

import corpus_pipeline
from cuewright.llm import neardup
from tests.llm.test_brute import grouped


def at_threshold(seed):
    """Two texts of 1019 words whose 1015 shingles each have a similarity of exactly 0.75."""
    base = [f"w{seed}x{i}" for i in range(1019)]
    other = list(base)
    for j in range(29):
        other[35 * j + 10] = f"c{seed}x{j}"
    return " ".join(base), " ".join(other)


def test_long_pairs_at_the_threshold(spark):
    """Of 40,000 such pairs, these agree in the fewest slots: 0.586 to 0.602."""
    rows = [(2 * k + i, t) for k, seed in enumerate((28884, 28406, 1406, 32467)) for i, t in enumerate(at_threshold(seed))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == grouped(rows)
    assert [r["component_id"] for r in sorted(got)] == [0, 0, 2, 2, 4, 4, 6, 6]


def test_texts_that_share_an_id(spark):
    a, b = at_threshold(1)[0], at_threshold(2)[0]
    rows = [(5, a), (5, b), (7, a + " more"), (8, b + " more"), (None, a), (None, "quite another text of seven words"), (None, "quite another text of seven words")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["n_shingles"] > 9) == [(0, 1015, 5, False), (5, 1015, 5, True), (5, 1015, 5, True), (7, 1016, 5, False), (8, 1016, 5, False)]
    assert sorted(r["kept"] for r in got if r["n_shingles"] == 2) == [False, True]


def test_stages_decide_by_row(spark, sf):
    """Repeated ids and null ids: one row of each group stays, and no rejected row does."""
    good = [r["text"] for r in corpus_pipeline.rules(spark, spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'"), sf).limit(3).collect()]
    bad = "same words " * 60
    rows = [(1, good[0], "en"), (1, good[0], "en"), (1, bad, "en"), (2, good[0], "en"), (None, good[1], "en"), (None, good[1], "en"), (None, bad, "en"), (1, good[2], "en"), (3, " ", "en"), (3, " ", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    passed = corpus_pipeline.rules(spark, docs, sf).collect()
    assert len(passed) == 6 and bad not in {r["text"] for r in passed}
    kept = [tuple(r) for r in corpus_pipeline.deduplicate(spark, docs, sf).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [*{tuple(r) for r in rows} - {(2, good[0], "en"), (None, bad, "en")}]))


def test_sequences_follow_the_mix(spark, sf, tmp_path):
    """Sources of 3600 and 400 rows have target shares of 3/4 and 1/4 as long as both last. Pieces follow the mix
    inside their length, so the test has some 500 of each of eight lengths."""
    rng = np.random.default_rng(3)
    rows = [(i, "word " * int(rng.choice([20, 75, 130, 210, 330, 480, 620, 800])), "small" if i % 10 == 0 else "large") for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "docs"))
    corpus_pipeline.mix(spark, spark.read.parquet(str(tmp_path / "docs")), sf).write.parquet(str(tmp_path / "mix"))
    got = corpus_pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mix")), sf).collect()
    used = Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert sorted(used) == list(range(len(used))) and max(used.values()) <= 1024 and len(got) == 4000
    shares = []
    for part in range(4):
        own = [r["doc_id"] % 10 == 0 for r in got if r["sequence_id"] * 10 // len(used) == part]
        shares.append(sum(own) / len(own))
    print("shares of the small source in tenths of the sequences:", shares)
    assert all(abs(s - 0.25) < 0.06 for s in shares[:3])
