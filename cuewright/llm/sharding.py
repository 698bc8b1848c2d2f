"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows lie in source blocks (by hash of their content). How many of each block go to each shard is drawn
from the multivariate hypergeometric law of a uniform shuffle, with exact block and shard totals; each
block permutes its rows and deals them out by its line of the matrix; after the exchange each shard
permutes again, in buckets so that no shard is gathered in one task. Only the blocks' sizes reach the
driver: one number for each PER_BLOCK rows.

Blocks are classes of a content hash, not the partitions as they lie: so shard and slot follow from content
and seed alone, and a task that runs again, or a table that is laid out otherwise, gives the same rows.

Law: `rows` (shard sizes at most one apart). Defined results: null text counts as empty; very long texts
count with all their bytes; rows equal in doc_id and text are interchangeable and each get their own slot;
an empty table gives no rows. Other columns pass through whatever their names; those named like an output
are replaced.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, gapless_rank

PER_BLOCK = 50_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw. Beyond the generator's range: inversion from the mode outwards."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    lo, hi = max(0, draws - bad), min(good, draws)
    comb = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (good + bad + 2)))
    p = math.exp(comb(good, mode) + comb(bad, draws - mode) - comb(good + bad, draws))
    left = right = mode
    p_left = p_right = p
    u = rng.random() - p
    while u > 0 and (left > lo or right < hi):
        if right < hi:
            p_right *= (good - right) / (right + 1) * (draws - right) / (bad - draws + right + 1)
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > lo:
            p_left *= left / (good - left + 1) * (bad - draws + left) / (draws - left + 1)
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Line by line, how many rows of each block go to each shard."""
    rng, total = np.random.default_rng(seed), sum(blocks)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in blocks:
        line, left, others = [], size, sum(room)
        for s in range(shards):
            others -= room[s]
            k = hypergeometric(rng, room[s], others, left)
            line.append(k)
            left -= k
        room = [a - b for a, b in zip(room, line, strict=True)]
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """docs with size and text_crc32 of the text, shard int and slot long; columns of those names are replaced.

    Placement needs the two digests alone, so what is not selected afterwards (the text, say) is pruned
    from both exchanges.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digests = {"size": (F.octet_length(text) + 1).cast("bigint"), "text_crc32": F.crc32(text)}
    docs = docs.drop("shard", "slot", *digests).withColumns(digests)
    n = docs.count()
    n_blocks = max(1, -(-n // PER_BLOCK), min(32, n))
    block, rank, b, upto = free(docs, "_block", "_rank", "_b", "_ends")
    docs = docs.withColumn(block, F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(n_blocks)))
    sizes = {r[0]: r[1] for r in docs.groupBy(block).count().collect()}  # n_blocks rows
    lines = matrix([sizes.get(k, 0) for k in range(n_blocks)], shards, seed)
    ends = [(k, [int(x) for x in np.cumsum(line)]) for k, line in enumerate(lines)]
    dealt = spark.createDataFrame(ends, f"{b} long, {upto} array<long>")
    local = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "text_crc32"), "doc_id", "text_crc32")
    rows = docs.withColumn(rank, F.row_number().over(local) - 1).join(dealt, F.col(block) == F.col(b))
    rows = rows.withColumn("shard", F.size(F.filter(upto, lambda e: e <= F.col(rank))).cast("int")).drop(b, upto, rank, block)
    return gapless_rank(rows, ["shard"], F.xxhash64(F.lit(seed + 2), "doc_id", "text_crc32"), ["doc_id", "text_crc32"], "slot")


def query(spark, sf_dir):
    from .common import read

    placed = shard(read(spark, sf_dir, "documents")).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
