"""Values, not only rows: what the operators give for null, empty, long and repeated rows, clashing names and many sources."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import ann, common, fertility, langid, licenses, mixing, sharding, toxicity


def test_weights_hold_with_more_sources_than_slots(spark):
    """One source of 6000 rows and 1500 of two: the large one's share follows its weight."""
    rows = spark.range(9000).selectExpr("id AS doc_id", "if(id < 6000, 'big', concat('s', (id - 6000) div 2)) AS source")
    share = {r["_src"]: r["share"] for r in mixing.shares(rows, "source").collect()}
    period, weight = sum(share.values()), 6000**0.5
    assert len(share) == 1501 and abs(share["big"] / period - weight / (weight + 1500 * 2**0.5)) < 2 / 1501
    got = mixing.mix(rows, block=1, power=0.5).select("doc_id", "source", "mix_slot", "mix_position").collect()
    assert sorted(r["mix_position"] for r in got) == list(range(9000)) and len({r["mix_slot"] for r in got}) == 9000
    big = np.sort([r["mix_slot"] for r in got if r["source"] == "big"])[:1000]
    assert np.abs(np.arange(1, 1001) - (big + 1) * share["big"] / period).max() < 1


def test_period_has_bounds():
    assert mixing.period_for(3, 100.0, 50.0) == mixing.PERIOD
    assert mixing.period_for(3, 1e12, 1.0) == mixing.LONGEST
    assert mixing.period_for(1_000_000, 1e6, 1.0) == 8_000_000


@pytest.mark.parametrize("n", [10**3, 10**6, 10**9, 10**11, 10**13])
def test_samples_keep_their_bound_at_any_size(n):
    share = toxicity.share_of(n, n * 2000.0, 12_000)
    assert 0 < share <= 1 and share * n <= 12_001 and share * n * 2000 <= toxicity.MAX_TRAIN_BYTES * 1.01
    assert share * n >= min(n, 11_999)


def test_draws_are_uniform(spark):
    rows = spark.range(100_000).select(common.draw("x", "id").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.count_if(F.col("u") < 1e-3)).first()
    assert 0 <= rows[0] and rows[1] < 1 and abs(rows[2] - 0.5) < 0.01 and 50 < rows[3] < 170


def test_repeated_queries_and_rows(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0]), *[(i, [1.0, i / 100]) for i in range(1, 20)], (5, [1.0, 0.05]), *[(100 + i, [-1.0, i / 100]) for i in range(30)]]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 21)) and len({r["vec_id"] for r in got}) == 20
    want = sorted({(-v[1], i) for i, v in rows if i != 20})[:20]  # of the two vectors of id 20 the least asks
    assert [(-r["score"], r["vec_id"]) for r in got] == want


def test_shards_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    got = sharding.query(spark, sf).collect()
    slots = defaultdict(list)
    for r in got:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kept_by_brute_force(spark, sf):
    """Bands from sorted rates in plain Python."""
    rows = [r.asDict() for r in fertility.judge(common.cut(fertility.measure(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")))).collect()]
    sound = [r for r in rows if not r["base_failed"]]

    def band(own, c):
        v = sorted(round(r[c] * fertility.GRID) / fertility.GRID for r in own)
        q1, q3 = (next(x for i, x in enumerate(v, 1) if i >= p * len(v)) for p in (0.25, 0.75))
        m = max(fertility.MARGINS[c], fertility.SPREAD * (q3 - q1))
        return q1 - m, q3 + m

    groups = defaultdict(list)
    for r in sound:
        groups[r["lang"]].append(r)
    for r in rows:
        own = groups[r["lang"]] if len(groups[r["lang"]]) >= fertility.MIN_GROUP else sound
        inside = all(lo - 1e-9 <= r[c] <= hi + 1e-9 for c in fertility.RATES for lo, hi in [band(own, c)])
        assert r["kept"] == (not r["base_failed"] and inside)


def test_junk_is_outside_the_bands(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select("doc_id", "lang", "text")
    rng = np.random.default_rng(1)
    junk = [(-1, "en", " ".join("".join(chr(int(c)) for c in rng.integers(0x4E00, 0x9FFF, 6)) for _ in range(80))), (-2, "en", " ".join("".join(chr(int(c)) for c in rng.integers(33, 127, 12)) for _ in range(80)))]
    got = {r["doc_id"]: r for r in fertility.judge(common.cut(fertility.measure(docs.unionByName(spark.createDataFrame(junk, docs.schema))))).collect()}
    assert not got[-1]["kept"] and not got[-1]["base_failed"] and not got[-2]["kept"] and not got[-2]["base_failed"]


NAMES = ["_key", "_sub", "_rn", "_off", "_g0", "_rank", "_block", "_b", "_ends", "_s", "_src", "_share", "_m", "_words", "_places", "_starts", "_base", "_group", "_bands", "_n", "_stretch", "_bits"]


@pytest.mark.parametrize("run", [sharding.shard, mixing.mix, lambda d: licenses.scan(d, {}), lambda d: fertility.judge(common.cut(fertility.measure(d))), lambda d: langid.identify(d, None)], ids=["shard", "mix", "scan", "judge", "identify"])
def test_helper_names_as_columns_of_the_user(spark, run):
    rows = spark.createDataFrame([(i, f"text number {i} of a few", "en", "a") for i in range(40)], "doc_id long, text string, lang string, source string")
    got = run(rows.withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in NAMES})).collect()
    assert len(got) == 40 and all(r[c] == f"{c}{r['doc_id']}" for r in got for c in NAMES)


def test_values_of_odd_rows(spark):
    long = "the river runs past the old mill " * 5000
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, "MIT License"), (5, "MIT License")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string"))
    scan = {r["doc_id"]: r for r in licenses.scan(docs, {}).collect()}
    assert [(scan[d]["n_words"], scan[d]["n_base"], scan[d]["labels"], scan[d]["score"]) for d in (1, 2, 3, 4)] == [(0, 0, "", 0.0), (0, 0, "", 0.0), (35000, 0, "", 0.0), (2, 1, "mit", 0.8)]
    judged = Counter((r["doc_id"], r["base_failed"], r["kept"]) for r in fertility.judge(common.cut(fertility.measure(docs))).collect())
    assert judged == {(1, True, False): 1, (2, True, False): 1, (3, True, False): 2, (4, True, False): 1, (5, True, False): 1}
    said = {(r["doc_id"], r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(docs, None).collect()}
    assert said == {(d, "und", 0.0, True) for d in (1, 2, 3, 4, 5)}
    scored = {r["doc_id"]: r["score"] for r in toxicity.score(docs, None).collect()}
    assert scored == dict.fromkeys((1, 2, 3, 4, 5), 0.0)
    mixed = mixing.mix(docs).collect()
    assert sorted(r["mix_position"] for r in mixed) == list(range(6)) and {r["mix_block"] for r in mixed} == {0}
