"""Operators against brute force and exact round trips."""

import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cuewright.llm import ann, common, fertility, licenses, mixing, neardup, oracle, packing, sharding

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def shingled(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(AZ))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def grouped(rows):
    """doc_id -> smallest linked doc_id, by comparing all pairs."""
    sets = {d: shingled(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


def held(rows, spark):
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == grouped(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_the_table(spark, sf):
    held([(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()], spark)


def test_near_duplicates_at_the_threshold(spark):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(1 << 30)}"
    rows = [(900, None), (901, ""), (902, "One two"), (903, "one TWO"), (904, "one two three")]
    for k in range(40):  # a text and one with some words changed, on either side of 0.75
        base = [word() for _ in range(204)]
        other = list(base)
        for j in range(k % 8):
            other[20 * j + 10] = word()
        rows += [(3 * k, " ".join(base)), (3 * k + 1, " ".join(other)), (3 * k + 2, "\n".join(base).upper())]
    held(rows, spark)


def test_near_duplicates_in_a_large_group(spark):
    """Many near copies of one text, each with its own end, and a chain of texts that drift apart."""
    rng = np.random.default_rng(2)
    word = lambda: f"v{rng.integers(1 << 30)}"
    base = [word() for _ in range(120)]
    rows = [(i, " ".join(base + [word() for _ in range(12)])) for i in range(150)]
    chain = [word() for _ in range(100)]
    for i in range(30):
        rows.append((1000 + i, " ".join(chain)))
        chain = chain[10:] + [word() for _ in range(10)]
    held(rows, spark)


def test_near_duplicates_sql(spark, sf):
    assert_sql(neardup.query(spark, sf), oracle.NEAR_DUPLICATES, sf)


def assert_sql(df, sql, sf):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = base.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(map(str, got.fetchall())) == sorted(str(tuple(r)) for r in df.select(*names).collect())


def test_licences_sql(spark, sf):
    assert_sql(licenses.query(spark, sf), oracle.licences(), sf)


def test_licences_by_hand(spark):
    texts = ["", None, "THE MIT License; see: Apache-License mit license", "General public\nlicenseé general Public License", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated written files the software to deal in the software without restriction", "permission is hereby granted, free of fees, to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.document_counts(docs)).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
        places = [(p, label) for phrase, label in licenses.BASE.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split()]
        assert (got[i]["n_words"], got[i]["n_base"]) == (len(words), len(places))
        assert (got[i]["first_word"], got[i]["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert got[i]["base_labels"] == ",".join(sorted({x for _, x in places}))
    assert got[4]["labels"] == "mit" and got[5]["labels"] == ""  # the second lacks the mandatory phrase


def matched(text):
    """(label, start, cover) of each template whose key phrase stands whole, by looking at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))
    for label, template, key in licenses.TEMPLATES:
        own, need = template.split(), key.split()
        at = licenses.key_place(own, need)
        for i in range(len(words)):
            if words[i : i + len(need)] == need:
                near = [words[max(0, i - at + p - licenses.DRIFT) : max(0, i - at + p + licenses.DRIFT + 1)] for p in range(len(own))]
                cover = sum(w in n for w, n in zip(own, near, strict=True)) / len(own)
                if cover >= licenses.COVER:
                    yield label, i - at, cover


def test_licences_inserted_lost_and_cut_words(spark):
    whole = [t for _, t, _ in licenses.TEMPLATES]
    texts = list(whole)
    for t in whole:
        words = t.split()
        half = len(words) // 2
        texts += [" ".join([*words[:1], "really", *words[1:]]), " ".join(words[:half] + ["um"] * 2 + words[half:]), " ".join(words[1:]), " ".join(words[:-1]), "Some words before: " + t.upper().replace(" ", ", ") + "; after. " + t]
    texts += ["terms of the gnu lesser general public license", "permission is hereby granted " * 500 + whole[1], ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(docs, licenses.document_counts(docs)).collect()}
    for i, text in enumerate(texts):
        assert [tuple(m) for m in got[i]["matches"]] == sorted(matched(text))
    assert "lgpl" in got[len(texts) - 3]["labels"]
    inserted = [got[len(whole) + 5 * k]["labels"] for k in range(len(whole))]
    assert all(label in own.split(",") for (label, t, key), own in zip(licenses.TEMPLATES, inserted, strict=True) if not t.startswith(key[: key.index(" ")]))


def base_numbers(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {p + k for p, t in enumerate(zip(words, words[1:], words[2:], strict=False)) if tri[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_fertility_counts(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, sf).collect()}
    for r in fertility.query(spark, sf).collect():
        want = base_numbers(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_fertility_counts_of_odd_texts():
    for text in ("", " ", "a b c d", "a b c a b c", "a b a b a", "x\r\nx\r\n x\n\n", "a\x1cb \x0b\x0c", "# $|<>", "中文 中文 中文 中文"):
        assert fertility.base_counts(text) == base_numbers(text), repr(text)


def test_packing_round_trip(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public(packing.TOKENIZER))
    docs = documents(spark, sf)
    cut = common.cut(packing.pieces(docs, with_ids=True))
    rows = packing.pack(cut).collect()
    whole = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        assert r["start"] == len(whole[r["doc_id"]]) and r["length"] == len(r["ids"]) <= packing.CAP
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        assert r["length"] == packing.CAP or r["piece"] == 0
        whole[r["doc_id"]] += r["ids"]
    for r in docs.collect():
        assert whole[r["doc_id"]] == [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, packing.END]
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= packing.CAP
    free = []  # best fit, one piece at a time
    for n in sorted((r["length"] for r in rows), reverse=True):
        fits = [i for i, g in enumerate(free) if g >= n]
        if fits:
            free[min(fits, key=free.__getitem__)] -= n
        else:
            free.append(packing.CAP - n)
    assert len(used) <= len(free)


def test_no_more_sequences_than_sequential_best_fit(spark):
    """Lengths of several kinds, one length with many pieces (ranked in several buckets), all short, all long."""
    rng = np.random.default_rng(5)
    kinds = [rng.integers(1, 65, 2000), np.append(np.full(900, 30), rng.integers(10, 40, 300)), [64] * 70]
    bucket, packing.BUCKET = packing.BUCKET, 100
    try:
        for lengths in kinds:
            rows = common.cut(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id long, length int"))
            got = packing.best_fit(rows, cap=64).collect()
            assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(lengths))
            used = Counter()
            for r in sorted(got, key=lambda r: (r["seq"], r["offset"])):
                assert r["offset"] == used[r["seq"]]
                used[r["seq"]] += r["length"]
            free = []
            for n in sorted(lengths, reverse=True):
                fits = [i for i, g in enumerate(free) if g >= n]
                if fits:
                    free[min(fits, key=free.__getitem__)] -= n
                else:
                    free.append(64 - n)
            assert max(used.values()) <= 64 and len(used) <= len(free)
    finally:
        packing.BUCKET = bucket


def test_both_vocabulary_files_give_the_same_ids():
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(packing.public(packing.TOKENIZER)), fertility.encoding(open(packing.public(packing.RANKS), "rb").read())
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}b1{chr(c)} {chr(c)}." for c in points[i : i + 64])
        assert plain.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)


def test_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vec"))
    ids, x = zip(*((r["vec_id"], r["vec"]) for r in rows.collect()), strict=True)
    x, at = np.array(x, float), {v: i for i, v in enumerate(ids)}
    found = defaultdict(list)
    for r in ann.nearest(rows, F.col("vec_id") % 20 == 0, shard_rows=200).orderBy("query_id", "rank").collect():
        assert np.isclose(r["score"], x[at[r["query_id"]]] @ x[at[r["vec_id"]]], rtol=1e-12, atol=1e-12)
        found[r["query_id"]].append((-r["score"], r["vec_id"]))
    hit = total = 0
    for q in (v for v in ids if v % 20 == 0):
        s = x @ x[at[q]]
        best = sorted((-s[at[v]], v) for v in ids if v != q)[:20]
        assert found[q] == sorted(found[q]) and len(found[q]) == len(best)
        hit, total = hit + len({v for _, v in found[q]} & {v for _, v in best}), total + len(best)
    assert hit >= 0.9 * total


def test_shards(spark, sf):
    docs = documents(spark, sf)
    got = sharding.shard(docs).select("doc_id", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.collect())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    sizes = [len(slots[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = sharding.shard(docs.repartition(5)).select("doc_id", "shard", "slot").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_matrix_keeps_both_totals():
    blocks = [5, 0, 17, 1, 40, 3]
    lines = np.array(sharding.matrix(blocks, 8, 3))
    assert lines.sum(1).tolist() == blocks and lines.sum(0).max() - lines.sum(0).min() <= 1 and lines.min() >= 0
    draws = [sharding.hypergeometric(np.random.default_rng(i), 600_000_000, 600_000_000, 100) for i in range(300)]
    assert 48 < np.mean(draws) < 52 and 3.5 < np.std(draws) < 6.5


def test_every_source_is_less_than_a_block_off_its_target(spark):
    rows = [(i, f"s{k}") for k, n in enumerate((400, 150, 50, 30)) for i in range(1000 * k, 1000 * k + n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    got = mixing.mix(docs, period=40, block=4).orderBy("mix_position").collect()
    assert [r["mix_position"] for r in got] == list(range(len(rows))) and sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    share = {r["_src"]: r["share"] for r in mixing.shares(docs, "source", period=40).collect()}
    assert sum(share.values()) == 40
    run = {}
    for r in got:
        assert run.setdefault(r["mix_slot"], r["source"]) == r["source"]
    last = min(max(r["mix_slot"] for r in got if r["source"] == s) for s in share)
    done = Counter()
    for slot in range(last):
        done[run[slot]] += 1
        assert all(abs(done[s] - (slot + 1) * a / 40) < 1 for s, a in share.items())


def test_gapless_rank_in_buckets(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, id % 2) AS g")
    ranked = common.gapless_rank(rows, ["g"], F.xxhash64("doc_id"), ["doc_id"], "r", per_bucket=16).collect()
    by = defaultdict(list)
    for r in ranked:
        by[r["g"]].append(r["r"])
    assert len(ranked) == 3000 and all(sorted(v) == list(range(len(v))) for v in by.values())
