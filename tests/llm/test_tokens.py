"""Alignment, fill-in-middle and SentencePiece against plain Python, the libraries and SQL; with their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuewright.llm import align, common, fim, merges
from cuewright.llm.fertility import PIECES, public

LONG = "the river runs past the old mill and the wide field of barley " * 3000
ROWS = [
    (1, "plain words of a small text about rivers and mills", "en", 5, "x"),
    (1, "plain words of a small text about rivers and mills", "en", 5, "x"),
    (2, None, None, None, None),
    (3, "", None, None, None),
    (4, LONG, "en", 1, "y"),
    (None, "a text without an id", "de", 1, "y"),
    (6, " \n\t 12 34 !!  ", "de", 1, "y"),
    (7, "Mühlen <|endoftext|> und <s> 日本語 😀ｆ <0x0A>", "de", 1, "y"),
    (8, "a literal ▁ is no space", "en", 1, "y"),
    (9, "marks <P> in a text", "en", 1, "y"),
    (10, "z" * 5000 + " " * 3000 + "́​\x00", "en", 1, "y"),
]
SCHEMA = "doc_id long, text string, n string, ids int, keys string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public(PIECES))


# ---------------------------------------------------------------- alignment


def aligned_plainly(rows):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of each text, token by token."""
    from tokenizers import Tokenizer

    a_side, b_side = Tokenizer.from_file(public("byte_bpe_50k.json")), library()
    a_side.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    out, links = [], []
    for text in rows:
        out.append((0, 0, 0, 0, ""))
        links.append([])
        if not text:
            continue
        a = a_side.encode(" " + text, add_special_tokens=False).ids
        b = b_side.encode(text)
        a_bytes = [bytes(table[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + text).encode()
        if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        i = j = 0
        while i < len(a) and j < len(b):
            links[-1].append((a[i], b[j]))
            x, y = a_ends[i], b_ends[j]
            i, j = i + (x <= y), j + (y <= x)
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        out[-1] = (len(a), len(b), len(groups), len(links[-1]), sha(";".join(groups)))
    counts = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    return [(*o[:4], sum(counts[p] == most[p[0]] for p in x), sum(counts[p] for p in x), o[4]) for o, x in zip(out, links, strict=True)]


def held(spark, docs, limit):
    rows, _ = common.keyed(docs.select(F.col("doc_id").alias("id"), "text"), "_row")
    found = common.cut(align.align(rows).withColumn("digest", F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")))
    got = align.scored(found, common.cut(align.pair_counts(found)), "_row", limit).orderBy("_row").collect()
    texts = [r["text"] for r in rows.orderBy("_row").collect()]
    assert [tuple(r[c] for c in (*align.STATS, "n_best", "count_sum", "digest")) for r in got] == aligned_plainly(texts)


@pytest.mark.parametrize("limit", [align.LIMIT, 50])
def test_alignment_against_plain_python(spark, sf, limit):
    held(spark, spark.read.parquet(f"{sf}/documents.parquet").where(F.length("text") < 20_000), limit)


@pytest.mark.parametrize("limit", [align.LIMIT, 3])
def test_alignment_of_edge_cases(spark, limit):
    held(spark, spark.createDataFrame(ROWS, SCHEMA).where("doc_id <> 4 or doc_id is null"), limit)


def test_alignment_chunk_borders(spark, monkeypatch):
    monkeypatch.setattr(align, "CHUNK_BYTES", 40)
    docs, _ = common.keyed(spark.createDataFrame(ROWS, SCHEMA).where("doc_id <> 4 or doc_id is null").coalesce(1), "_row")
    one = align.align(docs).where("not partial").orderBy("_row").select("doc_id", *align.STATS, "groups").collect()
    monkeypatch.setattr(align, "CHUNK_BYTES", 1 << 20)
    assert one == align.align(docs).where("not partial").orderBy("_row").select("doc_id", *align.STATS, "groups").collect()


# ---------------------------------------------------------------- fill-in-middle


def test_checkpoints_against_regex():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab é日😀\t\n  ,") for _ in range(rng.randrange(200)))
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
        index = fim.Checkpoints(np.frombuffer(text.encode(), np.uint8), every=rng.choice([1, 2, 3, 7]), block=rng.choice([1, 5, 16, 64]))
        assert index.n == len(units)
        for k in range(len(units) + 1):
            head = "".join(units[:k])
            assert index.cut(k) == (len(head.encode()), len(head))


def test_fill_in_middle_against_sql(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] is not None] * 2 + [(i, f"text {i} of  many words\n" * (i % 5), "en", 1, "y") for i in range(20, 400)], SCHEMA)
    base = duckdb.connect()
    base.register("documents", docs.select("doc_id", "text").toPandas())
    want = base.execute(fim.SQL)
    names = [d[0] for d in want.description]
    made = fim.fill_in_middle(docs)
    got = made.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(fim.restore(), 256)})
    assert Counter(map(tuple, got.select(names).collect())) == Counter(want.fetchall())
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}
    assert made.where(~fim.restore().eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0


def test_fill_in_middle_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = fim.fill_in_middle(docs, fim_percent=100)
    assert got.columns == ["doc_id", "text", "ids", "keys", "n", "form", "prefix_chars", "middle_chars", "output"]
    form = {r["doc_id"]: r["form"] for r in got.collect()}
    assert form[2] == form[3] == form[9] == "plain" and form[1] != "plain" and form[None] != "plain"
    assert got.count() == len(ROWS) and fim.fill_in_middle(docs.limit(0)).collect() == []


# ---------------------------------------------------------------- SentencePiece


def test_encoding_and_decoding_equal_the_library(spark, sf):
    lib, own = library(), merges._vocabulary(open(public(PIECES), "rb").read())
    rng = random.Random(5)
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    letters = "ab ▁\t\n<0xA>é日😀ｆ́\0.,nt the ingor"
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["".join(rng.choice(own.pieces[3:]) for _ in range(rng.randrange(20))) for _ in range(3000)]
    texts += [a + " " * k + b for k in range(70) for a, b in (("", ""), ("x", "y"))] + ["a" * k for k in range(60)]
    texts += ["qzjxkv" * 5000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(50_000)), " " * 50_000]
    want = lib.encode(texts, add_eos=True)
    ids, at = own.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    assert own.decode(ids, at) == [lib.decode(x) for x in want]
    odd = [[rng.randrange(own.n) if rng.random() < 0.5 else rng.randrange(259) for _ in range(rng.randrange(12))] for _ in range(5000)]
    assert own.decode(np.array([x for r in odd for x in r]), np.cumsum([0, *map(len, odd)])) == [lib.decode(x) for x in odd]


def test_the_public_vocabulary_is_canonical():
    """Merging a piece's characters one pair at a time, best and leftmost first, gives that piece by ranks that grow."""
    lib = library()
    rank = {lib.id_to_piece(i): -lib.get_score(i) for i in range(259, lib.get_piece_size())}
    for piece, own in rank.items():
        symbols, last = list(piece), -1.0
        while pairs := [(rank[a + b], i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in rank]:
            least, i = min(pairs)
            assert last <= least <= own
            last, symbols[i : i + 2] = least, [symbols[i] + symbols[i + 1]]
        assert symbols == [piece]


def test_sentencepiece_edges(spark):
    lib, docs = library(), spark.createDataFrame(ROWS, SCHEMA)
    coded = merges.encode(docs)
    assert coded.columns == ["doc_id", "text", "n", "keys", "ids"]
    got = merges.decode(coded).collect()
    assert len(got) == len(ROWS)
    for r in got:
        want = lib.encode(r["text"] or "", add_eos=True)
        assert r["ids"] == want and r["decoded"] == lib.decode(want)
    assert merges.decode(merges.encode(docs.limit(0))).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [2])], "id int, ids array<int>")
    assert [r["decoded"] for r in merges.decode(lists).orderBy("id").collect()] == [None, "", ""]
