"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, adjacent pairs and one-word-skipping pairs of the lower-cased
text (ASCII punctuation separates words). Each coordinate has its own learning rate; L1 leaves most
weights at exactly zero, so what is broadcast is a short list of (bucket, weight).

Training uses at most about MAX_TRAIN_ROWS labelled rows and MAX_TRAIN_BYTES of whole texts, chosen by a
64-bit hash threshold, so the bound holds at any number of rows: a documented bound.

Defined results: null text counts as empty; an empty text scores the sigmoid of the bias; a very long text
is scored whole; labels null or absent are not learned from, several labels of a document count as their
maximum; no label at all -> score 0.0 for all. Repeated rows are scored each and alike; so are ties. An empty
table gives no rows. Other columns pass through whatever their names; one named score is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, crc_mod, cut, draw, mix, small, word_hashes

BITS, EPOCHS = 20, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.5
#: A bucket is admitted to training if so many training texts have it.
ADMIT = 2
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 12_000, 128_000_000
_PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Buckets of the words, pairs and skip pairs, repeats kept."""
    w = word_hashes((text or "").lower().encode("utf-8", "replace").translate(_PLAIN))
    pair = mix(w[:-1] * U64(3) + w[1:])
    skip = mix(w[:-2] * U64(5) + w[2:] + U64(1))
    return (np.concatenate((w, pair, skip)) >> U64(64 - BITS)).astype(np.int64)


def fit(rows: list[tuple[str, int]], seed: int = 11) -> dict:
    """FTRL-proximal over (text, label); the order of the rows does not matter."""
    rows = sorted(rows)
    rng = np.random.default_rng(seed)
    feats = [np.unique(features(t)).astype(np.int32) for t, _ in rows]
    seen = np.zeros(1 << BITS, np.int32)
    for idx in feats:
        seen[idx] += 1
    feats = [np.append(idx[seen[idx] >= ADMIT], 1 << BITS).astype(np.int32) for idx in feats]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            idx = feats[i]
            zi, ni = z[idx], n[idx]
            w = -np.sign(zi) * np.maximum(np.abs(zi) - L1, 0) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - rows[i][1]
            z[idx] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[idx] = ni + g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    at = np.flatnonzero(w[:-1])
    return {"at": at.tolist(), "weight": w[at].tolist(), "bias": float(w[-1])}


_MODEL = T.StructType([T.StructField("at", T.ArrayType(T.LongType())), T.StructField("weight", T.ArrayType(T.DoubleType())), T.StructField("bias", T.DoubleType())])


def share_of(n: int, size: float, max_rows: int, max_bytes: int = MAX_TRAIN_BYTES) -> float:
    """The share of n rows of so many bytes that keeps both bounds."""
    return min(1.0, max_rows / max(1, n), max_bytes / max(1.0, size))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """text and _y of about max_rows labelled rows whose crc32(doc_id) mod 4 is not 2.

    Rows are counted after they met their labels, drawn by id and text, and of equal rows one is learned from, so the
    bounds hold however many rows share an id.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 4) != 2)).groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = small(cut(known))
    sizes = docs.select("doc_id", F.octet_length("text").alias("_size")).join(known, "doc_id").agg(F.count("*").alias("n"), F.sum("_size").alias("size")).first()
    drawn = docs.select("doc_id", "text").where(draw("toxic", "doc_id", "text") < share_of(sizes["n"], sizes["size"] or 0, max_rows))
    return drawn.join(known, "doc_id").dropDuplicates(["text", "_y"]).select("text", "_y")


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """A model from sample(docs, labels)."""
    def run(pdf):
        import pandas as pd

        rows = [(t or "", int(y)) for t, y in zip(pdf["text"], pdf["_y"], strict=True)]
        return pd.DataFrame([fit(rows)], columns=["at", "weight", "bias"])

    found = sample(docs, labels, max_rows).groupBy().applyInPandas(run, _MODEL).collect()
    return found[0].asDict() if found else None


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with score double; columns besides text pass through."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches):
        m = shared.value
        table = np.zeros(1 << BITS, np.float32)
        if m:
            table[m["at"]] = m["weight"]
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                if not m:
                    out.append(0.0)
                    continue
                idx = features(text)
                hit = np.unique(idx[table[idx] != 0])
                out.append(float(1 / (1 + np.exp(-np.clip(table[hit].astype(float).sum() + m["bias"], -35, 35)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    model = train(docs, read(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
