"""What the operators share: reading, lineage cuts, word hashing and distributed ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce
from operator import and_

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
_PRIME = U64(0x100000001B3)
_GOLD = U64(0x9E3779B97F4A7C15)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cuewright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write `df` once to the shared folder and read it back.

    Lost executors then cost a reread, not a recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*cuts: DataFrame | None) -> None:
    """Delete the tables behind results of cut() that nothing reads any more."""
    for df in cuts:
        if df is not None and (path := getattr(df, "_cut_path", None)):
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def free(df: DataFrame, *stems: str) -> list[str]:
    """A name for each stem that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def draw(salt: str, *columns: str) -> Column:
    """A uniform number in [0, 1) from the columns' 64-bit hash."""
    return F.xxhash64(*columns, F.lit(salt)).cast("double") / 2.0**64 + 0.5


def keyed(df: DataFrame, out: str) -> tuple[DataFrame, int]:
    """`df` with `out`, a long of each row's own in the order of file names and rows, and a bound above it.

    It comes from the file and the row's place in it, so every read gives the same; a table that is not read
    from files is written first. Without filters it is gapless.
    """
    try:
        df.select("_metadata.row_index")
    except AnalysisException:
        df = cut(df)
    sizes = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(F.max("_metadata.row_index").alias("m")).collect()  # a row for each file
    files, n = [], 0
    for r in sorted(sizes):
        files.append((r["f"], n))
        n += r["m"] + 1
    path, file, start = free(df, "_path", "_file", "_start")
    starts = df.sparkSession.createDataFrame(files, f"{file} string, {start} long")  # a row for each file
    placed = df.withColumns({path: F.col("_metadata.file_path"), out: F.col("_metadata.row_index")}).join(small(starts), F.col(path) == F.col(file))
    return placed.withColumn(out, F.col(out) + F.col(start)).drop(path, file, start), n


def spread(column: str, n: int) -> Column:
    """Numbers from 0 to n - 1 over the whole range of a long, in their order."""
    half = n // 2 + 1
    return (F.col(column) - half) * ((2**63 - 1) // half)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array."""
    x = x + _GOLD
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, U64)
_INVERSE = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        size = 1 << max(16, math.ceil(math.log2(n)))
        inverse = U64(pow(int(_PRIME), -1, 1 << 64))
        _POWERS = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, _PRIME))), dtype=U64)
        _INVERSE = np.cumprod(np.concatenate(([U64(1)], np.full(size - 1, inverse))), dtype=U64)
    return _POWERS[:n], _INVERSE[:n]


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than space and \\t to \\r."""
    word = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of `text`, in order, without a Python loop over words."""
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        return np.zeros(0, U64)
    powers, inverse = _powers(len(raw))
    total = np.concatenate(([U64(0)], np.cumsum((raw.astype(U64) + U64(1)) * powers, dtype=U64)))
    return mix((total[ends] - total[starts]) * inverse[starts])


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words."""
    out = words[: len(words) - width + 1] * _PRIME
    for i in range(1, width):
        out = (out + words[i : len(words) - width + 1 + i]) * _PRIME
    return mix(out)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, of the whole sequence."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    return np.unique(windows(words, width))


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df` as the broadcast side of a join if it has at most so many (narrow) rows, and as it is beyond.

    It is counted, so cut it first where it is not cheap.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def gapless_rank(df: DataFrame, group: list[str], key: Column, ties: list[str], out: str, per_bucket: int = 10_000) -> DataFrame:
    """Add `out`: 0, 1, 2, ... within each group in the order of `key`, a uniform 64-bit long.

    No group is gathered in one task: a group of n rows is split by the leading bits of the key into about
    n / per_bucket buckets, rows are ranked inside the bucket and moved by the exact number of rows in the
    buckets before. `df` is read three times (counts of groups, counts of buckets, rows). A group may be
    null. Columns of `df` are kept whatever their names; one named `out` is replaced.
    """
    df = df.drop(out)
    key_, sub, bits, rn, off = free(df, "_key", "_sub", "_bits", "_rn", "_off")
    mine = free(df, *[f"_g{i}" for i in range(len(group))])
    own = lambda names: reduce(and_, [F.col(c).eqNullSafe(F.col(g)) for c, g in zip(group, names, strict=True)], F.lit(True))
    ranked_by = lambda *cols: F.row_number().over(Window.partitionBy(*cols).orderBy(key_, *ties))
    width = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / per_bucket))).cast("int")
    wide = cut(df.groupBy(*[F.col(c).alias(g) for c, g in zip(group, mine, strict=True)]).agg(width.alias(bits)).where(F.col(bits) > 0))
    keyed_ = df.withColumn(key_, key)
    if wide.isEmpty():  # every group fits one bucket
        return keyed_.withColumn(out, (ranked_by(*(group or [F.lit(0)])) - 1).cast("bigint")).drop(key_)
    keyed_ = keyed_.join(small(wide), own(mine), "left").drop(*mine) if group else keyed_.withColumn(bits, F.lit(wide.first()[0]))
    # the signed key's leading bits; none where the group has one bucket
    leading = F.when(F.coalesce(F.col(bits), F.lit(0)) > 0, F.expr(f"shiftright(`{key_}`, 64 - `{bits}`)")).otherwise(F.lit(0).cast("bigint"))
    keyed_ = keyed_.withColumn(sub, leading).drop(bits)
    before = Window.partitionBy(*[F.col(g) for g in mine]).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed_.groupBy(*[F.col(c).alias(g) for c, g in zip(group, mine, strict=True)], sub).agg(F.count("*").alias(rn))
    offsets = sizes.select(*mine, F.col(sub).alias(bits), F.coalesce(F.sum(rn).over(before), F.lit(0)).alias(off)).where(F.col(off) > 0)
    ranked = keyed_.withColumn(rn, ranked_by(*group, sub))
    joined = ranked.join(small(cut(offsets)), own(mine) & (F.col(sub) == F.col(bits)), "left")
    return joined.withColumn(out, (F.coalesce(F.col(off), F.lit(0)) + F.col(rn) - 1).cast("bigint")).drop(key_, sub, bits, rn, off, *mine)
