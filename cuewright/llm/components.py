"""Connected components of a link table, without gathering links anywhere.

Each partition first contracts its own links by union-find; then large-star and small-star rounds run
over the remaining star links until nothing changes. Every round is a shuffle of links by node; a hub
with very many links is only ever aggregated (min) and split by adaptive skew joins.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _contract(batches):
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [(x, root(x)) for x in list(parent)]
    nodes = [(x, r) for x, r in nodes if x != r]
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """links(a long, b long) -> node, component (the smallest node reachable); linked nodes only."""
    edges = cut(links.where("a <> b").select("a", "b").mapInArrow(_contract, "a long, b long").distinct())
    state = None
    while True:
        # large star: each node's larger neighbours go to its smallest
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = cut(large.join(small, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
        state = now
