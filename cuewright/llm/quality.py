"""Quality: random Fourier features over document statistics, ridge by summed normal equations, then
isotonic calibration.

Every text is measured once (16 statistics; the table of statistics is cut to the shared folder). The
cosine features approximate a Gaussian kernel; beside them the ridge sees the standardised statistics
themselves, scaled down, and a constant. Each partition of labelled rows sums its normal equations where it
lies, and the lines of the matrices are added in tasks, so the driver gets one matrix, however many rows
and partitions there are. A hashed fifth of the training rows is kept for calibration: their ridge scores
are counted in 4096 bins, and pool-adjacent-violators over the bins gives the rising step function from
ridge score to probability that is the score. So scores repeat: a step's documents are ties.

Defined results: null text counts as empty, and an empty text has a score like any; very long texts are
measured whole; labels null or absent are not learned from, several labels of a document count as their
maximum; no label -> score 0.0; no label in the calibrating fifth -> 0.5. Repeated rows are scored each and
alike. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_mod, cut, windows, word_hashes

N_STATS, FEATURES, BINS = 16, 256, 4096
RIDGE, GAMMA = 1e-3, 0.04
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(text: str | None) -> np.ndarray:
    """16 numbers that say how the text is made, not what it is about."""
    raw = (text or "").encode("utf-8", "replace")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    size, words = max(1.0, hist.sum()), word_hashes(raw.lower())
    n = max(1, len(words))
    counts = np.unique(words, return_counts=True)[1] if len(words) else np.zeros(1)
    tri = windows(words, 3) if len(words) > 2 else words[:0]
    lines = [x for x in (text or "").split("\n") if x.strip()]
    upper, lower = hist[65:91].sum(), hist[97:123].sum()
    p = hist[hist > 0] / size
    return np.array([
        np.log1p(len(words)), size / n, upper / max(1.0, upper + lower), hist[48:58].sum() / size, hist[33] / n, hist[_SYMBOL].sum() / n, hist[46] / n, hist[44] / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), len(counts) / n ** 0.9, counts.max() / n, (words[1:] == words[:-1]).sum() / n, 1 - len(np.unique(tri)) / max(1, len(tri)), -(p * np.log2(p)).sum(), hist[128:].sum() / size,
    ])


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and stats array<double>, one row for each row."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["doc_id", "stats"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("stats", T.ArrayType(T.DoubleType()))]))


class Lift:
    """Standardise, clip and lift to cosine features; the same on the driver and in tasks."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, sd
        self.w = rng.normal(0, np.sqrt(2 * GAMMA), (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.sd, -5, 5)
        return np.hstack((np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), x * 0.1, np.ones((len(x), 1))))


def pool(value: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: lower edges and means of the rising steps."""
    steps: list[list[float]] = []
    for v, g, k in zip(value, good, n, strict=True):
        steps.append([v, g, k])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, g2, k2 = steps.pop()
            steps[-1][1] += g2
            steps[-1][2] += k2
    return np.array([s[0] for s in steps]), np.array([s[1] / s[2] for s in steps])


def _stack(batches, names):
    for b in batches:
        if b.num_rows:
            yield [b.column(n).flatten().to_numpy().reshape(b.num_rows, -1) if n == "stats" else b.column(n).to_numpy() for n in names]


def train(stats: DataFrame, labels: DataFrame) -> dict | None:
    """A model from labelled rows whose crc32(doc_id) mod 5 is not 0; all of them are used."""
    spark = stats.sparkSession
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    fold = (F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0).alias("cal")
    rows = cut(stats.join(known, "doc_id").select("stats", "y", fold))
    moments = rows.select(F.count("*"), *[f(F.col("stats")[i]) for i in range(N_STATS) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    lift = Lift(np.array(moments[1::2], float), np.maximum(np.array(moments[2::2], float), 1e-3))
    shared = spark.sparkContext.broadcast(lift)

    def equations(batches):
        from pyspark import TaskContext

        size = FEATURES + N_STATS + 1
        lines = np.zeros((size, size + 2))  # line i of the matrix, then the right side and the number of rows
        for x, y in _stack(batches, ("stats", "y")):
            z = shared.value(x)
            lines += np.column_stack((z.T @ z, z.T @ y, np.full(size, len(y))))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"i": np.arange(size), "part": np.full(size, part), "line": [r.tobytes() for r in lines]})

    def added(pdf):
        total = sum(np.frombuffer(x) for x in pdf.sort_values("part")["line"])  # in a fixed order
        return pdf.head(1).assign(line=total.tobytes())[["i", "line"]]

    summed = rows.where(~F.col("cal")).mapInArrow(equations, "i long, part long, line binary").groupBy("i").applyInPandas(added, "i long, line binary")
    whole = np.array([np.frombuffer(r["line"]) for r in sorted(summed.collect())])  # FEATURES + N_STATS + 1 lines
    a, b, total = whole[:, :-2], whole[:, -2], whole[0, -1]
    w = np.linalg.solve(a + RIDGE * max(1, total) * np.eye(len(b)) / FEATURES + 1e-9 * np.eye(len(b)), b)
    model = {"lift": lift, "w": w, "edges": np.array([0]), "steps": np.array([0.5])}
    held = spark.sparkContext.broadcast(model)

    def binned(batches):
        for x, y in _stack(batches, ("stats", "y")):
            s = np.clip(held.value["lift"](x) @ held.value["w"], -0.5, 1.5)
            yield pa.RecordBatch.from_pydict({"bin": ((s + 0.5) / 2 * (BINS - 1)).astype(np.int64), "y": y})

    bins = rows.where("cal").mapInArrow(binned, "bin long, y double").groupBy("bin").agg(F.sum("y").alias("g"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows
    if bins:
        edges, steps = pool(np.array([r["bin"] for r in bins]), np.array([r["g"] for r in bins]), np.array([r["n"] for r in bins], float))
        model |= {"edges": edges, "steps": steps}
    return model


def predict(stats: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score double for each row of measure()."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.zeros(batch.num_rows)
            if m:
                x = batch.column("stats").flatten().to_numpy().reshape(batch.num_rows, -1)
                raw = np.clip(m["lift"](x) @ m["w"], -0.5, 1.5)
                out = m["steps"][np.maximum(np.searchsorted(m["edges"], np.floor((raw + 0.5) / 2 * (BINS - 1)), "right") - 1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.clip(out, 0, 1))], names=["doc_id", "score"])

    return stats.mapInArrow(run, T.StructType([stats.schema["doc_id"], T.StructField("score", T.DoubleType())]))


def query(spark, sf_dir):
    from .common import read

    stats = cut(measure(read(spark, sf_dir, "documents")))
    scored = predict(stats, train(stats, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
