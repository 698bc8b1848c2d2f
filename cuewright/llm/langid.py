"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte 3- and 4-grams of the lower-cased text that stay inside one word (a blank at
either end marks the word's edge), hashed to BUCKETS rows of an embedding table. A text is the mean
of its subwords' embeddings; a linear softmax on it is trained by plain stochastic gradient descent
in numpy. Table and softmax fold into one BUCKETS x languages matrix, which is what is broadcast.

Training uses at most about MAX_TRAIN_ROWS rows and MAX_TRAIN_BYTES of whole texts for each language, chosen
by a 64-bit hash threshold, so the bound holds at any number of rows: a documented bound. A fifth of them
calibrates a temperature and the rejection threshold.

Defined results: null text, or text without a letter -> `und`, score 0, rejected. Rows without lang,
text or letters are not learned from. No usable training row -> `und` for all. A very long text is read
whole. Repeated rows are scored each and alike; of equally likely languages the first by name is given. An
empty table gives no rows; all other columns pass through unread, one named like an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut, draw, small

BUCKETS, DIM, EPOCHS, RATE = 1 << 16, 16, 4, 2.0
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 1500, 16_000_000
_BLANK = np.zeros(256, bool)
_BLANK[:65] = True
_BLANK[91:97] = _BLANK[123:128] = True


def subwords(text: str) -> np.ndarray:
    """Hash buckets of the text's subwords, repeats kept."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    blank = _BLANK[raw]
    x = np.where(blank, 32, raw).astype(np.uint32)
    if len(x) < 3:
        return np.zeros(0, np.uint32)
    h3 = (x[:-2] * np.uint32(0x01000193) ^ x[1:-1]) * np.uint32(0x01000193) ^ x[2:]
    ok3 = ~blank[1:-1]
    h4 = (h3[:-1] * np.uint32(0x01000193) ^ x[3:]) * np.uint32(0x9E3779B1)
    h = np.concatenate(((h3 * np.uint32(0x85EBCA6B))[ok3], h4[ok3[:-1] & ~blank[2:-1]]))
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(16)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def fit(rows: list[tuple[str, str]], seed: int = 7) -> dict:
    """Train on (text, lang); the order of the rows does not matter."""
    rows = sorted(rows)
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 5] if len(rows) >= 50 else order[:0]
    learn = order[len(held) :]
    feats = [np.unique(subwords(t), return_counts=True) for t, _ in rows]
    target = np.array([langs.index(lang) for _, lang in rows], int)
    table = rng.normal(0, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(langs)), np.float32)
    steps, step = EPOCHS * max(1, len(learn)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            idx, counts = feats[i]
            rate, step = RATE * (1 - step / steps), step + 1
            if not len(idx):
                continue
            share = (counts / counts.sum()).astype(np.float32)
            hidden = share @ table[idx]
            grad = _softmax(hidden @ soft).astype(np.float32)
            grad[target[i]] -= 1
            back = soft @ grad
            soft -= rate * np.outer(hidden, grad)
            table[idx] -= rate * 4 * np.outer(share, back)
    matrix = (table @ soft).astype(np.float32)
    scale, floor = 1.0, 0.0
    if len(held):
        logits = np.array([(c / c.sum()) @ matrix[i] if len(i) else np.zeros(len(langs)) for i, c in (feats[k] for k in held)])
        loss = lambda s: -np.log(np.maximum(_softmax(logits * s)[np.arange(len(held)), target[held]], 1e-9)).mean()
        scale = float(min((0.5, 1, 1.5, 2, 3, 4, 6, 8), key=loss))
        prob = _softmax(logits * scale)
        right = prob.argmax(1) == target[held]
        floor = float(min(0.5, np.quantile(prob.max(1)[right], 0.002))) if right.any() else 0.0
    return {"langs": langs, "matrix": matrix.tobytes(), "scale": scale, "floor": floor}


_MODEL = T.StructType([T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("matrix", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("floor", T.DoubleType())])


def sample(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """text and lang of about max_rows rows of each language, whose crc32(doc_id) mod 5 is not 0.

    Each row is drawn by its id and text, and of equal rows one is learned from, so the bounds hold however
    many rows share an id.
    """
    usable = docs.select("doc_id", "text", "lang").where((crc_mod("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").agg(F.least(max_rows / F.count("*"), F.lit(float(MAX_TRAIN_BYTES)) / F.greatest(F.lit(1), F.sum(F.octet_length("text")))).alias("_share"))
    drawn = usable.join(small(cut(counts)), "lang").where(draw("langid", "doc_id", "text") < F.col("_share"))
    return drawn.dropDuplicates(["lang", "text"]).select("text", "lang")


def train(docs: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> dict | None:
    """A model from sample(docs)."""
    def run(pdf):
        import pandas as pd

        rows = [(t, g) for t, g in zip(pdf["text"], pdf["lang"], strict=True) if has_letter(t)]
        return pd.DataFrame([fit(rows)] if rows else [], columns=["langs", "matrix", "scale", "floor"])

    found = sample(docs, max_rows).groupBy().applyInPandas(run, _MODEL).collect()
    return found[0].asDict() if found else None


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred string, score double and rejected boolean."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches):
        m = shared.value
        matrix = np.frombuffer(m["matrix"], np.float32).reshape(BUCKETS, -1) if m else None
        for batch in batches:
            lang, score, out = [], [], []
            for text in batch.column("text").to_pylist():
                idx = subwords(text) if m and has_letter(text) else ()
                if not len(idx):
                    lang.append("und" if not m or not has_letter(text) else m["langs"][0])
                    score.append(0.0)
                    out.append(True)
                    continue
                p = _softmax(np.add.reduce(matrix[idx], 0, dtype=np.float64) * (m["scale"] / len(idx)))
                k = int(p.argmax())
                lang.append(m["langs"][k])
                score.append(float(p[k]))
                out.append(bool(p[k] < m["floor"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir):
    from .common import read

    docs = read(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
