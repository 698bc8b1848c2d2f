"""Approximate nearest neighbours by inner product: robust-pruned directed graphs in shards.

Rows are hashed to shards of about SHARD_ROWS. In each shard equal vectors become one node (their ids
stay with it), one coordinate is added so that all have one norm (then the nearest by distance is the
largest inner product), and nodes enter the graph in batches: a greedy beam search from the entry node
proposes neighbours, and pruning keeps the nearest one, drops those that it covers (ALPHA times as near
to it as to the node), and goes on with the next; spare places take the nearest dropped ones. A node takes
back links into SLACK spare places, and is pruned alike when they are full. Two passes are made, the second
with the relaxed ALPHA.

Each stated query is beam-searched in every shard, in blocks of queries; scores are recomputed in
double precision on the original vectors, and the K best over the shards are kept.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part, as
candidates or as queries, and neither do rows without an id. Vectors of one length are searched among
themselves: each length has graphs of its own. Rows equal in id and vector count once; rows that share an id
with other vectors are candidates each, and the least of the vectors is the query of that id. A query is
never its own result: no row of its id is. Ties go to the smaller id. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SHARD_ROWS, DEGREE, SLACK, BEAM, ALPHA, BATCH, QUERY_BLOCK = 4096, 24, 8, 48, 1.2, 256, 256
SEARCH_BEAM = 128
INF = np.float32(np.inf)


def beam_search(vectors: np.ndarray, links: np.ndarray, entry: np.ndarray, queries: np.ndarray, width: int, wide: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Largest inner products: (ids, scores) of each query's beam, best first; -1 where there are fewer.

    All queries step together: each expands its best node that has not been expanded.
    """
    q, n = len(queries), len(vectors)
    rows = np.arange(q)[:, None]
    ids = np.full((q, width), -1, np.int32)
    score = np.full((q, width), -INF, np.float32)
    done = np.ones((q, width), bool)
    seen = np.zeros((q, n), bool)
    entry = entry[:width]
    ids[:, : len(entry)] = entry
    score[:, : len(entry)] = queries @ vectors[entry].T
    done[:, : len(entry)] = False
    seen[:, entry] = True
    for _ in range(4 * width):
        open_score = np.where(done, -INF, score)
        best = open_score.argmax(1)
        live = np.flatnonzero(open_score[np.arange(q), best] > -INF)
        if not len(live):
            break
        at = best[live]
        done[live, at] = True
        near = links[ids[live, at]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        at, slot = np.nonzero(fresh)
        seen[live[at], near[at, slot]] = True
        near = np.where(fresh, near, 0)
        s = np.where(fresh, np.einsum("qd,qrd->qr", queries[live], vectors[near]), -INF)
        all_score = np.concatenate((score[live], s), 1)
        all_ids = np.concatenate((ids[live], np.where(fresh, near, -1)), 1)
        all_done = np.concatenate((done[live], ~fresh), 1)
        top = np.argpartition(-all_score, width - 1, 1)[:, :width]
        k = np.arange(len(live))[:, None]
        score[live], ids[live], done[live] = all_score[k, top], all_ids[k, top], all_done[k, top]
    order = np.argsort(-score, 1, kind="stable")
    return ids[rows, order], score[rows, order]


def prune(vectors: np.ndarray, nodes: np.ndarray, cand: np.ndarray, alpha: float, degree: int = DEGREE) -> np.ndarray:
    """Robust pruning for a batch of nodes; cand may repeat ids and hold -1."""
    cand = np.sort(cand, 1)
    bad = (cand < 0) | (cand == nodes[:, None])
    bad[:, 1:] |= cand[:, 1:] == cand[:, :-1]
    x = vectors[np.maximum(cand, 0)]
    dist = ((x - vectors[nodes][:, None]) ** 2).sum(2)
    dist[bad] = INF
    norm = (x * x).sum(2)
    between = np.maximum(norm[:, :, None] + norm[:, None, :] - 2 * (x @ x.transpose(0, 2, 1)), 0)
    out = np.full((len(nodes), degree), -1, np.int32)
    open_, left = dist.copy(), dist.copy()
    k = np.arange(len(nodes))
    for slot in range(degree):
        at = open_.argmin(1)
        spare = ~np.isfinite(open_[k, at])
        at = np.where(spare, left.argmin(1), at)  # none left uncovered: the nearest of the covered
        ok = np.isfinite(left[k, at])
        if not ok.any():
            break
        out[ok, slot] = cand[k[ok], at[ok]]
        left[k, at] = INF
        open_[k, at] = INF
        covered = alpha * alpha * between[k, at] <= dist
        open_[covered & ~spare[:, None]] = INF
    return out


def build(vectors: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """links (n x (DEGREE + SLACK), -1 where fewer) and entry nodes of the graph over the rows of `vectors`."""
    n = len(vectors)
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    x = np.hstack((vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None])).astype(np.float32)
    rng = np.random.default_rng(seed)
    links = np.full((n, DEGREE + SLACK), -1, np.int32)
    links[:, :DEGREE] = rng.integers(0, n, (n, DEGREE))
    centre = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    entry = np.unique(np.append(rng.choice(n, min(n, 15), replace=False), centre)).astype(np.int32)
    if n <= DEGREE:
        return np.tile(np.arange(n, dtype=np.int32), (n, 1)), entry
    for alpha in (1.0, ALPHA):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            nodes = order[i : i + BATCH]
            found, _ = beam_search(x, links, entry, x[nodes], BEAM)
            own = prune(x, nodes, np.concatenate((found, links[nodes]), 1), alpha)
            links[nodes, :DEGREE], links[nodes, DEGREE:] = own, -1
            src, to = np.repeat(nodes, DEGREE)[own.ravel() >= 0].astype(np.int32), own[own >= 0]
            new = ~(links[to] == src[:, None]).any(1)
            if not new.any():
                continue
            by = np.argsort(to[new], kind="stable")
            to, src = to[new][by], src[new][by]
            target, first, count = np.unique(to, return_index=True, return_counts=True)
            used = (links[target] >= 0).sum(1)
            nth = np.arange(len(to)) - np.repeat(first, count)
            spare = np.repeat(used + count <= links.shape[1], count)
            links[to[spare], (np.repeat(used, count) + nth)[spare]] = src[spare]
            full = used + count > links.shape[1]
            if full.any():
                back = np.full((len(target), min(int(count.max()), 2 * DEGREE)), -1, np.int32)
                fits = nth < back.shape[1]
                back[np.repeat(np.arange(len(target)), count)[fits], nth[fits]] = src[fits]
                target = target[full]
                links[target, :DEGREE] = prune(x, target, np.concatenate((back[full], links[target]), 1), alpha)
                links[target, DEGREE:] = -1
    return links, entry


def _sound(df: DataFrame, vector: str) -> DataFrame:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(v.isNotNull() & F.coalesce(fine, F.lit(False)))


def index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: its nodes, ids, links and entries, packed."""
    import math

    n = vectors.count()
    shards = max(1, math.ceil(n / shard_rows))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        full = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
        flat, first, back = np.unique(full, axis=0, return_index=True, return_inverse=True)
        links, entry = build(flat.astype(np.float32))
        order = np.argsort(back.ravel(), kind="stable")  # by node, then by id
        ends = np.cumsum(np.bincount(back.ravel(), minlength=len(flat)))
        pack = lambda a, t: np.ascontiguousarray(a, t).tobytes()
        return pd.DataFrame([{"shard": key[0], "dim": full.shape[1], "vectors": pack(flat, "f8"), "links": pack(links, "i4"), "entry": pack(entry, "i4"), "ids": pack(pdf["vec_id"].to_numpy()[order], "i8"), "ends": pack(ends, "i8")}])

    rows = vectors.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(shards)).cast("int").alias("shard"), F.size("vec").alias("dim"))
    return rows.repartition(shards, "shard").groupBy("shard", "dim").applyInPandas(run, "shard int, dim int, vectors binary, links binary, entry binary, ids binary, ends binary")


def search(graph: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest found. `graph` is read twice: cut it first."""
    blocks = queries.withColumn("block", F.xxhash64("vec_id") % F.lit(max(1, queries.count() // QUERY_BLOCK))).groupBy("block", F.size("vec").alias("dim")).agg(F.collect_list(F.struct("vec_id", "vec")).alias("own"))
    shards = graph.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # one small row for each dimension
    sent = blocks.join(F.broadcast(shards), "dim").select("dim", "own", F.explode("shards").alias("shard"))

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in ("dim", "vectors", "links", "entry", "ids", "ends")}
                x = np.frombuffer(row["vectors"]).reshape(-1, row["dim"])
                links = np.frombuffer(row["links"], np.int32).reshape(len(x), -1)
                ids, ends = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
                own = batch.column("own")[r].as_py()
                qid = np.array([o["vec_id"] for o in own], np.int64)
                q = np.array([o["vec"] for o in own], np.float64)
                found, _ = beam_search(x.astype(np.float32), links, np.frombuffer(row["entry"], np.int32), q.astype(np.float32), max(SEARCH_BEAM, 2 * k))
                out: list[list] = [[], [], []]
                for i in range(len(q)):
                    nodes = found[i][found[i] >= 0]
                    exact = (x[nodes] * q[i]).sum(1)
                    nodes, exact = nodes[np.lexsort((nodes, -exact))], np.sort(exact)[::-1]
                    taken = 0
                    for node, s in zip(nodes, exact, strict=True):
                        if taken >= k and s < floor:
                            break
                        mine = ids[(ends[node - 1] if node else 0) : ends[node]][: k + 1]  # its smallest ids are enough
                        mine = mine[mine != qid[i]][:k]
                        out[0] += [qid[i]] * len(mine)
                        out[1] += mine.tolist()
                        out[2] += [float(s)] * len(mine)
                        taken, floor = taken + len(mine), s
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    hits = sent.join(graph, ["shard", "dim"]).mapInArrow(run, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vectors(vec_id, vec); is_query: a condition on vec_id."""
    sound = _sound(vectors.select("vec_id", F.col("vec").cast("array<double>").alias("vec")), "vec").where(F.col("vec_id").isNotNull()).distinct()
    queries = sound.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec"))
    return search(cut(index(sound, shard_rows)), queries, k)


def query(spark, sf_dir):
    from .common import read

    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return nearest(rows, F.col("vec_id") % 20 == 0)
