"""Quality rules from tokeniser fertility.

Two public vocabularies, a byte-level one and one with byte fallback, tokenise each whole text. Measured
with each are characters per token, the share of tokens that are one bare byte of a longer character (byte
fallback) and the entropy of the token distribution, divided by the largest entropy that so many tokens
can have. A language's rejection bands are its quartiles over all documents, widened by SPREAD
interquartile ranges, but at least by the fixed margins below. Quartiles are read off counts of the rates
rounded to 1 / GRID, so they are the same however rows are partitioned. Beside them stand the base rules:
fewer than 50 words, or over half of the words inside 3-word windows that occur more than once.

Defined results: null text counts as no words (base_failed); very long texts are measured whole. A null
language forms a group of its own; of a language with fewer than MIN_GROUP measurable documents, the bands
over all languages hold, and with fewer than MIN_GROUP in all none does: only the base rules reject then. Repeated rows are judged each and alike. An empty table gives no rows. Other columns
pass through whatever their names; those named like an output are replaced.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, small, windows, word_hashes

VOCABULARY, PIECES = "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
SPREAD, MIN_GROUP, GRID = 3.0, 30, 1000
#: Least margins around the quartiles: characters per token, byte share, relative entropy.
MARGINS = {"chars_per_token": 0.5, "byte_share": 0.05, "entropy": 0.1, "piece_chars_per_token": 0.5, "piece_byte_share": 0.05, "piece_entropy": 0.1}
_SYMBOLS = list(b"#*$%&|<>")
_SPACES = [9, 10, 11, 12, 13, 32]
#: Fixed: the pre-tokenisation pattern of the public byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = tuple(MARGINS)


def encoding(raw: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_counts(text: str) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    raw = text.encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in text.split("\n") if x.encode("utf-8", "replace").split()]
    words = word_hashes(raw)
    n = len(words)
    covered = 0
    if n >= 4:
        tri = windows(words, 3)
        order = np.argsort(tri)
        same = np.diff(tri[order].view(np.int64)) == 0
        twice = np.zeros(len(tri), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        again = np.concatenate(([False, False], twice, [False, False]))
        covered = int((again[2:] | again[1:-1] | again[:-2]).sum())
    return n, len(text) - int(hist[_SPACES].sum()), int(hist[_SYMBOLS].sum()), len(lines) - len(set(lines)), covered


def rates(ids: np.ndarray, n_chars: int, bare: np.ndarray) -> tuple[float, float, float]:
    n = len(ids)
    if not n:
        return 0.0, 0.0, 0.0
    counts = np.unique(ids, return_counts=True)[1] / n
    return n_chars / n, float(bare[ids].mean()), float(-(counts * np.log2(counts)).sum() / max(1.0, np.log2(n)))


def public(name: str) -> str:
    """The file of a public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def measure(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """docs without its text, with the base counts and the rates. vocabulary, pieces: files of the two."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([open(f or public(n), "rb").read() for f, n in ((vocabulary, VOCABULARY), (pieces, PIECES))])  # about 1.5 MB
    docs = docs.drop(*COUNTS, *RATES)
    keep = [c for c in docs.columns if c != "text"]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in COUNTS], *[T.StructField(c, T.DoubleType()) for c in RATES]])

    def run(batches):
        import sentencepiece

        enc = encoding(shared.value[0])
        own = sentencepiece.SentencePieceProcessor(model_proto=shared.value[1])
        fallback = np.array([own.is_byte(i) for i in range(own.get_piece_size())])
        bare = np.zeros(enc.n_vocab, bool)
        for byte in range(128, 256):
            bare[enc.encode_single_token(bytes([byte]))] = True
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                ids = np.array(enc.encode_ordinary(text), np.int32)
                other = np.array(own.encode(text, num_threads=1), np.int32)
                out.append(base_counts(text) + rates(ids, len(text), bare) + rates(other, len(text), fallback))
            cols = list(zip(*out, strict=True)) or [[]] * (len(COUNTS) + len(RATES))
            arrays = [pa.array(c, pa.int64() if i < 5 else pa.float64()) for i, c in enumerate(cols)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def quartiles(measured: DataFrame, group: str | None) -> DataFrame:
    """_group (null without one), _rate, _n, q1 and q3: the lower quartile and the upper one of each rate, rounded to 1 / GRID."""
    key = F.col(group) if group else F.lit(None).cast("string")
    rate = F.posexplode(F.array(*[F.round(F.col(c) * GRID).cast("long") for c in RATES])).alias("_rate", "_bin")
    bins = measured.select(key.alias("_group"), rate).groupBy("_group", "_rate", "_bin").agg(F.count("*").alias("k"))
    # bins of one group and rate: rates lie below a few hundred, mostly below ten
    upto = Window.partitionBy("_group", "_rate").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumn("upto", F.sum("k").over(upto)).withColumn("_n", F.sum("k").over(Window.partitionBy("_group", "_rate")))
    at = lambda p: F.min(F.when(F.col("upto") >= p * F.col("_n"), F.col("_bin"))) / GRID
    return counted.groupBy("_group", "_rate").agg(F.first("_n").alias("_n"), at(0.25).alias("q1"), at(0.75).alias("q3"))


def bands(measured: DataFrame, group: str) -> tuple[DataFrame, list]:
    """_group and _bands, an array of (lo, hi) in the order of RATES, for groups of MIN_GROUP or more; and such bands over all rows."""
    margins = F.array(*[F.lit(m) for m in MARGINS.values()])
    wide = F.greatest(F.get(margins, F.col("_rate")), SPREAD * (F.col("q3") - F.col("q1")))
    own = F.struct("_rate", (F.col("q1") - wide).alias("lo"), (F.col("q3") + wide).alias("hi"))
    listed = lambda q: q.groupBy("_group").agg(F.array_sort(F.collect_list(own)).alias("_bands"))  # noqa: E731  a row for each rate
    enough = F.col("_n") >= MIN_GROUP
    every = [(r["lo"], r["hi"]) for x in listed(quartiles(measured, None).where(enough)).collect() for r in x["_bands"]]
    return listed(quartiles(measured, group).where(enough)), every


def judge(measured: DataFrame, group: str = "lang") -> DataFrame:
    """Add base_failed and kept. `measured` is read three times; cut it first."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.drop("base_failed", "kept").withColumn("base_failed", failed)
    own, every = bands(measured.where(~F.col("base_failed")), group)
    g, b = free(measured, "_group", "_bands")
    joined = measured.join(small(cut(own.select(F.col("_group").alias(g), F.col("_bands").alias(b)))), F.col(group).eqNullSafe(F.col(g)), "left")
    inside = F.lit(True)
    for i, c in enumerate(RATES):
        lo, hi = ((F.coalesce(F.col(b)[i][side], F.lit(every[i][k] if every else None).cast("double"))) for k, side in enumerate(("lo", "hi")))
        inside = inside & F.coalesce(F.col(c).between(lo, hi), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & inside).drop(g, b)


def query(spark, sf_dir):
    from .common import read

    measured = cut(measure(read(spark, sf_dir, "documents").select("doc_id", "lang", "text")))
    return judge(measured).select("doc_id", *COUNTS, "base_failed", "kept", *RATES)
