"""Alignment of two tokenizers' tokens over the same bytes, by DuckDB inside each Arrow batch.

Vocabulary A is a byte-level BPE over a space and the text, vocabulary B a BPE with byte fallback over the text
(which brings that space itself). The tokens of a chunk of texts become two interval tables over one axis of
bytes. An ASOF join gives each A token the B token that covers its first byte, a range join those that start
further inside it: together all links. Offsets where both sides end cut the tokens into groups, numbered by a
window sum. Each chunk also counts in how many of its texts each pair of ids is linked; these partial counts
travel with the rows and Spark merges them. A second pass over the written pairs of each text, not over the
texts, then sums the corpus-wide counts.

The counts grow with the corpus, so they are not broadcast whole: pairs held by at least total / LIMIT documents
number at most LIMIT and are broadcast; the rarer ones, each with few rows, are joined by a shuffle.

Defined results: a text that is null, empty or not the bytes of its own tokens (one with a literal U+2581, say)
has no tokens: zeros and empty groups. A text's pairs are counted once for it, and once more for each repeated
row. Very long texts are aligned whole, in memory by themselves. An empty table gives no rows. Other columns pass
through whatever their names; those named like an output are replaced. A pair's key needs ids below 65,536.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free, keyed, read
from .fertility import PIECES, VOCABULARY, encoding, public
from .merges import gather

CHUNK_BYTES, FLUSH_PAIRS, LIMIT = 1 << 20, 200_000, 500_000
STATS = ("n_a", "n_b", "n_groups", "n_links")
#: No nested loops, whatever a range join's sides are thought to hold.
SETTINGS = {"nested_loop_join_threshold": 0, "merge_join_threshold": 0, "threads": 1, "memory_limit": "1GB", "temp_directory": ""}
#: Over a and b (doc, s, e, id), step by step: tokens that cover the same bytes are a link and a group by themselves; the
#: rest (ra, rb) meet by an ASOF join and a range join. links: doc, key, k, where k links of a text share a pair of ids.
STEPS = [
    "CREATE OR REPLACE TEMP TABLE same AS SELECT a.doc, a.s, a.id AS x, b.id AS y FROM a JOIN b USING (s, e)",
    "CREATE OR REPLACE TEMP TABLE ra AS FROM a ANTI JOIN same USING (s)",
    "CREATE OR REPLACE TEMP TABLE rb AS FROM b ANTI JOIN same USING (s)",
    "CREATE OR REPLACE TEMP TABLE first AS SELECT ra.doc, ra.id AS x, ra.e AS a_end, rb.id AS y, rb.e AS b_end FROM ra ASOF JOIN rb ON ra.s >= rb.s",
    "CREATE OR REPLACE TEMP TABLE wide AS FROM first WHERE a_end > b_end",
    """CREATE OR REPLACE TEMP TABLE links AS
    WITH further AS (SELECT w.doc, w.x, rb.id AS y FROM wide w JOIN rb ON rb.s >= w.b_end AND rb.s < w.a_end)
    SELECT doc, x * 65536 + y AS key, count(*) AS k FROM (SELECT doc, x, y FROM same UNION ALL SELECT doc, x, y FROM first UNION ALL FROM further) GROUP BY ALL""",
    "INSERT INTO counts SELECT key, count(*) FROM links GROUP BY key",
]
#: A text's distinct pairs.
PAIRS = "SELECT doc, sum(k)::BIGINT AS n_links, list(key) AS keys, list(k) AS ks FROM links GROUP BY doc ORDER BY doc"
#: The rest's tokens, group by group (at: where it starts), those of A first; what follows a token: 0 another of its side, 1 the other side, 2 another group.
GROUPS = """
WITH sides AS (SELECT ra.*, 0 AS side, rb.e IS NOT NULL AS done FROM ra LEFT JOIN rb USING (e) UNION ALL BY NAME SELECT rb.*, 1 AS side, ra.e IS NOT NULL AS done FROM rb LEFT JOIN ra USING (e)),
grouped AS (SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY side ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS g FROM sides)
SELECT doc, min(s) OVER (PARTITION BY g) AS at, side, id, CASE WHEN NOT done THEN 0 WHEN side = 0 THEN 1 ELSE 2 END AS follows FROM grouped ORDER BY g * 2 + side, s"""


def intervals(docs: np.ndarray, counts: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Tokens of several texts as intervals of one axis of bytes."""
    ends = np.cumsum(sizes[flat])
    return pa.table({"doc": np.repeat(docs, counts), "s": ends - sizes[flat], "e": ends, "id": flat})


class Side:
    """The bytes of one vocabulary's tokens."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.surface = np.frombuffer(b"".join(tokens), np.uint8)
        #: A token's id and what may follow it, in the order of `follows`.
        self.written = np.array([f"{i}{mark}" for mark in ",|;" for i in range(len(tokens))], object)

    def joined(self, ids: np.ndarray) -> bytes:
        return self.surface[gather(self.starts[ids], self.sizes[ids])].tobytes()


class Aligner:
    """Both vocabularies and a DuckDB connection; counts pairs until flush()."""

    def __init__(self, ranks: bytes, pieces: bytes):
        import duckdb
        import sentencepiece

        self.a = encoding(ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.sides = [
            Side([self.a.decode_single_token_bytes(i) for i in range(self.a.n_vocab)]),
            Side([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]),
        ]
        self.db = duckdb.connect(config=SETTINGS)
        self._run("CREATE TABLE counts (key BIGINT, n BIGINT)")

    def _run(self, sql: str) -> list:
        return self.db.execute(sql).fetchall()

    def chunk(self, texts: list[str | None]) -> tuple[np.ndarray, dict[str, np.ndarray], list[str], pa.Table]:
        """The places in `texts` of those that have tokens; and of these n_a, n_b and n_groups, the groups, and PAIRS."""
        docs = [i for i, t in enumerate(texts) if t]
        raw = [b" " + texts[i].encode("utf-8", "surrogatepass") for i in docs]
        both = (
            [self.a.encode_to_numpy(" " + texts[i], disallowed_special=()).astype(np.int64) for i in docs],
            [np.array(x, np.int64) for x in self.b.encode([texts[i] for i in docs], num_threads=1)],
        )
        same = [all(len(r) == side.sizes[ids[k]].sum() and side.joined(ids[k]) == r for ids, side in zip(both, self.sides, strict=True)) for k, r in enumerate(raw)]
        docs = np.array([d for d, ok in zip(docs, same, strict=True) if ok], np.int64)
        sizes = {}
        for name, ids, side in zip("ab", both, self.sides, strict=True):
            mine = [x for x, ok in zip(ids, same, strict=True) if ok]
            sizes[f"n_{name}"] = counts = np.array([len(x) for x in mine], np.int64)
            self.db.register("tokens", intervals(docs, counts, np.concatenate([*mine, np.zeros(0, np.int64)]), side.sizes))
            self._run(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM tokens")
        for step in STEPS:
            self._run(step)
        columns = lambda sql: [c.to_numpy() for c in self.db.sql(sql).to_arrow_table().columns]
        doc, at, x, y = columns("FROM same")
        doc2, at2, on, ids, follows = columns(GROUPS)
        n = [len(s.sizes) for s in self.sides]
        said = self.sides[0].written[n[0] + x] + self.sides[1].written[2 * n[1] + y]
        rest = np.where(on == 0, self.sides[0].written[np.where(on == 0, follows * n[0] + ids, 0)], self.sides[1].written[np.where(on == 1, follows * n[1] + ids, 0)])
        order = np.argsort(np.concatenate((at, at2)), kind="stable")
        said = np.concatenate((said, rest))[order].tolist()
        ends = np.searchsorted(np.concatenate((doc, doc2))[order], docs, side="right").tolist()
        sizes["n_groups"] = np.bincount(np.searchsorted(docs, np.concatenate((doc, doc2[follows == 2]))), minlength=len(docs))
        groups = ["".join(said[a:b])[:-1] for a, b in zip([0, *ends], ends, strict=False)]
        return docs, sizes, groups, self.db.sql(PAIRS).to_arrow_table()

    def flush(self, least: int = 0) -> tuple[np.ndarray, np.ndarray] | None:
        """Keys and numbers of texts counted so far, if at least so many rows wait; they start anew then."""
        if self._run("SELECT count(*) FROM counts")[0][0] <= least:
            return None
        found = self.db.sql("SELECT key, sum(n)::BIGINT AS n FROM counts GROUP BY key").to_arrow_table()
        self._run("TRUNCATE counts")
        return found["key"].to_numpy(), found["n"].to_numpy()


def align(docs: DataFrame, ranks: str | None = None, pieces: str | None = None, text: str = "text") -> DataFrame:
    """docs without its text, with n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;...`), and a text's pairs as `keys` and `ks`.

    A few rows more hold partial counts: their `partial` is true and all columns but keys and ks (numbers of
    documents) are null. ranks, pieces: files of the two vocabularies.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast([open(f or public(n), "rb").read() for f, n in ((ranks, VOCABULARY), (pieces, PIECES))])  # about 1.5 MB
    longs, new = T.ArrayType(T.LongType()), [*STATS, "groups", "keys", "ks", "partial"]
    rest = [c for c in docs.columns if c != text and c not in new]
    kept = [T.StructField(c, docs.schema[c].dataType) for c in rest]
    schema = T.StructType([*kept, *[T.StructField(c, T.LongType()) for c in STATS], T.StructField("groups", T.StringType()), T.StructField("keys", longs), T.StructField("ks", longs), T.StructField("partial", T.BooleanType())])
    (own,) = free(docs.drop(*new), "_aligned")

    def counts(found, like) -> pa.RecordBatch:
        keys, n = found
        nulls = [pa.nulls(1, column.type) for column in like.columns]
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (keys, n)]
        return pa.RecordBatch.from_arrays([*nulls, *[pa.nulls(1, pa.int64()) for _ in STATS], pa.nulls(1, pa.string()), *lists, pa.array([True])], names=schema.names)

    def rows(aligner: Aligner, part: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        docs, sizes, groups, pairs = aligner.chunk(texts)
        at = np.full(len(texts), -1)
        at[docs] = np.arange(len(docs))
        take = pa.array(at, mask=at < 0)
        stats = {**{c: pa.array(v, pa.int64()) for c, v in sizes.items()}, "n_links": pairs["n_links"].combine_chunks()}
        stats = [stats[c].take(take).fill_null(0).cast(pa.int64()) for c in STATS]
        lists = [pairs[c].combine_chunks().take(take).cast(pa.list_(pa.int64())) for c in ("keys", "ks")]
        return pa.RecordBatch.from_arrays([*part.columns, *stats, pa.array(groups, pa.string()).take(take).fill_null(""), *lists, pa.array(np.zeros(len(texts), bool))], names=schema.names)

    def run(batches):
        aligner, like = Aligner(*shared.value), None
        for batch in batches:
            like = batch.select(rest)
            start, size, texts = 0, 0, batch.column(own).to_pylist()
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= CHUNK_BYTES or i + 1 == len(texts):
                    yield rows(aligner, like.slice(start, i + 1 - start), texts[start : i + 1])
                    start, size = i + 1, 0
                    if (found := aligner.flush(FLUSH_PAIRS)) is not None:
                        yield counts(found, like)
        if (found := aligner.flush()) is not None:
            yield counts(found, like)

    return docs.select(*rest, F.col(text).alias(own)).mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """key, n_docs and best (no pair of the same A id is held by more documents), merged from the partial counts."""
    pairs = aligned.where("partial").select(F.explode(F.arrays_zip("keys", "ks")).alias("p")).groupBy(F.col("p.keys").alias("key")).agg(F.sum("p.ks").alias("n_docs"))
    merged = cut(pairs.withColumn("a_id", F.shiftright("key", 16)))
    return merged.join(merged.groupBy("a_id").agg(F.max("n_docs").alias("most")), "a_id").select("key", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def scored(aligned: DataFrame, counts: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """Rows of aligned with n_best and count_sum over their links. `aligned` has a column `key` of each row's own; both are read again."""
    known = counts.agg(F.count("*").alias("n"), F.sum("n_docs").alias("total")).first()
    least = math.ceil(known["total"] / limit) if known["n"] > limit else 0
    rows = aligned.where(~F.col("partial"))
    links = rows.select(F.col(key).alias("row"), F.explode(F.arrays_zip("keys", "ks")).alias("p")).select("row", F.col("p.keys").alias("key"), F.col("p.ks").alias("k"))
    found = links.join(F.broadcast(counts.where(F.col("n_docs") >= least)), "key", "left")  # at most `limit` rows of three numbers
    if least:
        rare = found.where("n_docs is null").select("row", "key", "k").join(counts.where(F.col("n_docs") < least), "key")
        found = found.where("n_docs is not null").unionByName(rare)
    sums = found.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n_docs")).alias("count_sum"))
    own, best, total = free(rows, "_of", "_best", "_sum")
    sums = sums.select(F.col("row").alias(own), F.col("n_best").alias(best), F.col("count_sum").alias(total))
    joined = rows.drop("keys", "ks", "partial", "n_best", "count_sum").join(sums, F.col(key) == F.col(own), "left")
    return joined.withColumns({"n_best": F.coalesce(best, F.lit(0)), "count_sum": F.coalesce(total, F.lit(0))}).drop(own, best, total)


def query(spark, sf_dir):
    docs, _ = keyed(read(spark, sf_dir, "documents").select("doc_id", "text"), "_row")
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise("")
    aligned = cut(align(docs).withColumn("groups_sha256", digest).drop("groups"))
    return scored(aligned, cut(pair_counts(aligned)), "_row").select("doc_id", *STATS, "n_best", "count_sum", "groups_sha256")
