"""Best-fit packing into sequences of at most CAP tokens, bulk-synchronously.

Tasks tokenise whole texts and cut only those longer than CAP (the first piece may be shorter). Then pieces
go to gaps, largest lengths first, in windows of lengths and rounds:

1. Pieces of the window and gaps that may hold them are sorted together, larger first (`_swept`): ranks in
   buckets of bounded size give every one its place.
2. A sweep from the large end finds each piece's successor: the smallest gap that holds it and that no larger
   piece takes. Gaps open and pieces close, as brackets do, so a piece meets the gap opened last on its
   level. A level holds at most one piece and one gap of each size, so levels are swept apart, in parallel.
3. Pieces that want one gap are in conflict; the rank inside their length, which sets the level, resolves it.
   A gap of several times the window's largest length stands as often, and is filled by several pieces.
4. Gaps are updated, and the rest of the window is swept again until nothing fits. Of what is left, the
   largest pieces open sequences, as many to one as their size class allows; then the round repeats.

The driver sees only how many pieces there are of each length and gaps of each size: at most 2 * CAP numbers.

Defined results: null text counts as empty (one piece: the end token). Very long texts are cut, never
shortened. Repeated rows are packed each; pieces of one length are ties, and which goes where follows from a
hash. Extra columns are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, gapless_rank, keyed, release, spread
from .fertility import encoding, public

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Rows of one size that are ranked in one task.
BUCKET = 50_000
#: Narrow rows in a file of a round.
ROWS = 50_000
CAP, END = 1024, 2


def piece_bounds(n: int, cap: int = CAP) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; the first takes the remainder."""
    first = n if n <= cap else n % cap or cap
    return [(0, first), *((s, cap) for s in range(first, n, cap))]


def pieces(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, cap: int = CAP, with_ids: bool = False, order: str | None = None) -> DataFrame:
    """doc_id (and order), piece, start, length, ids_crc32 (and ids) for each piece.

    The same vocabulary stands in two files: the rank file is encoded about three times as fast, and
    gives the same ids but where a special token's string occurs; such texts take the other file.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((open(tokenizer or public(TOKENIZER), encoding="utf-8").read(), open(ranks or public(RANKS), "rb").read()))  # 2.4 MB
    own = ["doc_id", *[order] * bool(order)]
    docs = docs.select(*own, "text")
    fields = [*[docs.schema[c] for c in own], *[T.StructField(c, T.LongType()) for c in ("piece", "start", "length", "ids_crc32")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids

    def run(batches):
        from tokenizers import Tokenizer

        fast, plain = encoding(shared.value[1]), None
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for *row, text in zip(*(batch.column(c).to_pylist() for c in (*own, "text")), strict=True):
                text = text or ""
                if "<|endoftext|>" in text:
                    plain = plain or Tokenizer.from_str(shared.value[0])
                    ids = plain.encode(text, add_special_tokens=False).ids
                else:
                    ids = fast.encode_ordinary(text)
                ids = np.array([*ids, END], "<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), cap)):
                    part = ids[start : start + length]
                    for column, value in zip(out, (*row, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32)), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [*[batch.schema.field(c).type for c in own], *[pa.int64()] * 4, pa.list_(pa.int32())], strict=False)], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def windows(cap: int = CAP) -> list[tuple[int, int]]:
    """(lo, hi]: lengths above a half, a third, a quarter, an eighth and a thirty-second of cap, then the rest."""
    ends = sorted({cap // k for k in (1, 2, 3, 4, 8, 32)} | {0}, reverse=True)
    return list(zip(ends[1:], ends, strict=False))


def _written(df: DataFrame, n: int) -> DataFrame:
    """A cut of about n narrow rows, in files of about ROWS rows whatever the number of shuffle partitions."""
    return cut(df.coalesce(max(2, -(-n // ROWS))))


def _placed(rows: str, counts: list[tuple[int, int, int]]) -> str:
    """SQL for the rows (size, kind, id, slot) of a query with `before`: gaps (kind 0) less pieces (kind 1)
    that stand before the row, larger sizes first and gaps before pieces of one size. Rows of one size and
    kind are ranked in buckets, and moved by what stands in the buckets before.

    counts: (size, kind, rows), at most 2 * CAP of them, from which the numbers of buckets follow.
    """
    wide = {(s, k): -(-n // BUCKET) for s, k, n in counts if n > BUCKET}
    sub = "0L"
    if wide:
        one, two = (", ".join(f"{wide.get((s, k), 1)}L" for s in range(1, max(s for s, _, _ in counts) + 1)) for k in (0, 1))
        sub = f"pmod(xxhash64(id), element_at(IF(kind = 0, array({one}), array({two})), size))"
    return f"""
        dealt AS (SELECT *, {sub} AS sub FROM ({rows})),
        buckets AS (SELECT size, kind, sub, sum(IF(kind = 0, 1L, -1L)) AS n FROM dealt GROUP BY size, kind, sub),
        offsets AS (SELECT size, kind, sub, coalesce(sum(n) OVER (ORDER BY size DESC, kind, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS off FROM buckets),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY size, kind, sub ORDER BY id, slot) - 1 AS place FROM dealt),
        placed AS (SELECT size, kind, id, off + IF(kind = 0, place, -place) AS before FROM ranked JOIN offsets USING (size, kind, sub))"""


def _swept(own: DataFrame, gaps: DataFrame, longest: int, counts: list[tuple[int, int, int]], cap: int) -> DataFrame:
    """id, length, seq and offset of each piece: its successor among the gaps, or null where all are taken."""
    rows = f"""SELECT length AS size, 1 AS kind, id, 0 AS slot FROM {{own}} UNION ALL
        SELECT gap AS size, 0 AS kind, seq AS id, explode(sequence(1, greatest(1, gap DIV {longest}L))) AS slot FROM {{gaps}}"""
    several = any(k == 0 and s >= 2 * longest for s, k, _ in counts)  # pieces of one sequence then follow each other
    ahead = "coalesce(sum(length) OVER (PARTITION BY coalesce(seq, -1 - id) ORDER BY length DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)" if several else "0L"
    return own.sparkSession.sql(
        f"""WITH {_placed(rows, counts)},
        swept AS (
            SELECT size, kind, id, lag(struct(kind, id, size)) OVER (PARTITION BY before + 1 - kind ORDER BY size DESC, kind) AS last FROM placed),
        met AS (SELECT id, size AS length, IF(last.kind = 0, last.id, NULL) AS seq, last.size AS gap FROM swept WHERE kind = 1)
        SELECT id, length, seq, {cap} - gap + {ahead} AS offset FROM met""",
        own=own,
        gaps=gaps,
    )


def _opened(own: DataFrame, each: int, first: int, counts: list[tuple[int, int, int]]) -> DataFrame:
    """id, length, seq and offset: `each` consecutive pieces to a new sequence, numbered from `first`."""
    return own.sparkSession.sql(
        f"""WITH {_placed("SELECT length AS size, 1 AS kind, id, 0 AS slot FROM {own}", counts)},
        dealt_out AS (SELECT id, size AS length, {first} - before DIV {each} AS seq FROM placed)
        SELECT *, coalesce(sum(length) OVER (PARTITION BY seq ORDER BY length DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS offset FROM dealt_out""",
        own=own,
    )


def best_fit(rows: DataFrame, cap: int = CAP) -> DataFrame:
    """id, length, seq and offset for each of the rows (id long, its own; length int, 1 to cap)."""
    spark = rows.sparkSession
    left = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most cap numbers
    gaps, open_, done, fresh = {}, cut(rows.limit(0).selectExpr("id AS seq", "length AS gap")), [], 0
    for lo, hi in windows(cap):
        own = rows.where(f"length > {lo} AND length <= {hi}")
        mine = {n: k for n, k in left.items() if lo < n <= hi}
        least = min((n for n in left if n <= lo), default=cap + 1)  # of the windows to come
        while mine:
            longest, shortest, before = max(mine), min(mine), fresh
            fits = {g: k for g, k in gaps.items() if g >= shortest}
            if fits:
                counts = [(n, 1, k) for n, k in mine.items()] + [(g, 0, k * max(1, g // longest)) for g, k in fits.items()]
                took = _written(_swept(own, open_.where(f"gap >= {shortest}"), longest, counts, cap), sum(mine.values()))
                own = took.where("seq IS NULL").select("id", "length")
                used = took.where("seq IS NOT NULL").selectExpr("seq", "-length AS gap")
            else:
                each = cap // longest
                part = {n: k for n, k in mine.items() if n > cap // (each + 1)}
                took = _written(_opened(own.where(f"length > {cap // (each + 1)}"), each, fresh, [(n, 1, k) for n, k in part.items()]), sum(part.values()))
                fresh += -(-sum(part.values()) // each)
                own = own.where(f"length <= {cap // (each + 1)}")
                used = took.selectExpr("seq", f"IF(offset = 0, {cap}, 0) - length AS gap")
            done.append(took)
            old = open_
            open_ = _written(old.unionByName(used).groupBy("seq").agg(F.expr("CAST(sum(gap) AS INT) AS gap")), sum(gaps.values()) + fresh - before)
            release(old)
            found = own.selectExpr("1 AS kind", "length AS size").unionAll(open_.selectExpr("0", "gap")).groupBy("kind", "size").count().collect()  # at most 2 * cap numbers
            mine, gaps = ({r["size"]: r["count"] for r in found if r["kind"] == k} for k in (1, 0))
            useful = min([*mine, least])
            open_ = _kept(open_, f"gap >= {useful}")
            gaps = {g: k for g, k in gaps.items() if g >= useful}
    if not done:
        return rows.selectExpr("id", "length", "0L AS seq", "0L AS offset")
    return spark.read.schema(done[0].schema).parquet(*[d._cut_path for d in done]).where("seq IS NOT NULL")


def _kept(table: DataFrame, condition: str) -> DataFrame:
    """Rows of a cut table; what is behind it can still be released."""
    out = table.where(condition)
    out._cut_path = table._cut_path
    return out


def pack(cut_pieces: DataFrame, cap: int = CAP, order: str | None = None, n: int = 0) -> DataFrame:
    """Add sequence_id and offset. `cut_pieces` is read more than once; cut it first.

    order: a column of numbers below n, which goes. Along sequence_id the pieces of each length follow it; which
    lengths share a sequence does not depend on it.
    """
    rows, _ = keyed(cut_pieces, "_piece_row")
    placed = best_fit(cut(rows.select(F.col("_piece_row").alias("id"), F.col("length").cast("int").alias("length"))), cap)
    if not order:
        found = placed.select(F.col("id").alias("_piece_row"), F.col("seq").alias("sequence_id"), "offset")
        return rows.join(found, "_piece_row").select(*cut_pieces.columns, "sequence_id", "offset")
    # the places of every length are spread evenly over the sequences in hash order, and its pieces go to them in theirs
    ranked = cut(gapless_rank(cut_pieces, ["length"], spread(order, n), [order, "piece"], "rank"))
    placed = cut(placed.select(F.col("seq").alias("sequence_id"), "offset", F.col("length").cast("long").alias("length")))
    shuffled = F.xxhash64("sequence_id")
    places = gapless_rank(placed, ["length"], shuffled, ["sequence_id", "offset"], "rank")
    numbers = gapless_rank(placed.where("offset = 0").select("sequence_id"), [], shuffled, ["sequence_id"], "_new")
    out = ranked.join(places, ["length", "rank"]).join(numbers, "sequence_id").withColumn("sequence_id", F.col("_new"))
    return out.select(*[c for c in cut_pieces.columns if c != order], "sequence_id", "offset")


def query(spark, sf_dir):
    from .common import read

    return pack(cut(pieces(read(spark, sf_dir, "documents"))))
