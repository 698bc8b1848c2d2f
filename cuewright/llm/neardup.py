"""Near-duplicates of documents by SuperMinHash.

1. Each text becomes its set of distinct 5-word shingles. Texts with equal sets are one class (their
   links are certain); everything after works on one representative, the smallest doc_id.
2. SuperMinHash: each shingle visits the SLOTS positions in its own random order, and a position keeps
   the least (step, random) it sees; once every position is filled by an earlier step, further steps
   cannot change it, so a long text stops after one or two.
3. Banding: BANDS bands of ROWS slots. In every bucket all members are compared with one leader (drawn
   by hash, so another in each band), which is linear in the bucket.
4. Verification: pairs whose signatures agree in too few slots go, the others are decided on full shingle
   sets. SuperMinHash's gain over independent slots fades with size (deviation at 0.75 for a union of 1160
   shingles: measured as 0.036, binomial 0.038), so MIN_AGREE is set by the binomial tail: a pair at 0.75
   agrees in fewer slots with a chance of 5e-7, whatever the size of its texts.
5. Union-find grouping. Buckets that still hold several components are then compared in blocks,
   between different components only: at first each member with the NEAREST that agree most with it
   (a hub joins its copies so), then, in what is still several components, every likely pair, on the
   full sets inside the task, so that only links leave it.

A pair at 0.75 shares a band but for a chance of 5e-6. Documents without words are linked with nothing.
Null text counts as empty. Rows are compared, not ids: rows that repeat a doc_id are given back each, and each
has its own text's group. A group is named by its smallest doc_id. Extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, cut, keyed, mix, shingles
from .components import components

SLOTS, BANDS, ROWS = 128, 32, 4
MIN_AGREE = 0.55
SHARE = 75
BLOCK = 1024
NEAREST = 2
#: Ids of candidate documents are broadcast up to this many rows (16 MB), and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SLOTS values for each set, step << 56 | random: the least over the set's items.

    The items of all sets take a step together; a set leaves when its signature cannot change any more.
    """
    m = SLOTS
    out = np.full((len(sets), m), np.iinfo(np.int64).max, np.int64)
    flat = out.reshape(-1)
    items, of = np.concatenate(sets or [np.zeros(0, U64)]), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = first = second = None
    for step in range(m):
        if not len(items):
            break
        draw = mix(items + U64((2 * step + 1) * 0xD1B54A32D192ED03 % (1 << 64)))
        k = step + ((draw * U64(0x9E3779B97F4A7C15) >> U64(32)) % U64(m - step)).astype(np.int64)
        rows = np.arange(len(items))
        if step == 0:
            slot = first = k
        elif step == 1:
            slot, second = np.where(k == first, 0, k), k
        else:
            if order is None:  # the two swaps so far, written out
                order = np.tile(np.arange(m, dtype=np.int16), (len(items), 1))
                order[rows, first], order[:, 0] = 0, first
                order[rows, second], order[:, 1] = order[:, 1].copy(), order[rows, second]
            slot = order[rows, k]
            order[rows, k] = order[:, step]
            order[:, step] = slot
        np.minimum.at(flat, of * m + slot, (draw >> U64(8)).astype(np.int64) | step << 56)
        stay = ((out >> 56).max(1) > step)[of]
        if not stay.all():
            items, of = items[stay], of[stay]
            order, first, second = (x if x is None else x[stay] for x in (order, first, second))
    return out


def _describe(batches):
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        i = 0
        while i < len(docs):
            own, total, start = [], 0, i
            while i < len(docs) and total < 60_000:
                own.append(shingles(texts[i]))
                total += len(own[-1])
                i += 1
            sig = signatures(own)
            bands = np.tile(np.arange(1, BANDS + 1, dtype=U64), (len(own), 1))
            for k in range(ROWS):
                bands = mix(bands ^ sig.reshape(len(own), BANDS, ROWS)[:, :, k].astype(U64))
            d1, d2 = (pa.array([int(f(s).sum(dtype=U64).astype(np.int64)) for s in own], pa.int64()) for f in (mix, lambda s: s * s))
            narrow = (sig ^ (sig >> 56)).astype(np.uint8)
            lists = pa.ListArray.from_arrays(np.arange(0, len(own) * BANDS + 1, BANDS, dtype=np.int32), pa.array(bands.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(docs[start:i], pa.int64()), batch.column("id").slice(start, i - start), pa.array([len(s) for s in own], pa.int64()), d1, d2, lists, pa.array([r.tobytes() for r in narrow], pa.binary())], names=["doc_id", "id", "n", "d1", "d2", "bands", "sig"])


def _fits(a: str, b: str) -> str:
    """Sizes that a pair of 0.75 or more can have."""
    return f"100 * least({a}, {b}) >= {SHARE} * greatest({a}, {b})"


def _agree(batches):
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in ("sig_a", "sig_b"))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(1) >= MIN_AGREE))


def _verify(batches):
    recent: dict[int, np.ndarray] = {}

    def own(doc: int, text: str) -> np.ndarray:
        if doc not in recent:
            if len(recent) >= 64:
                recent.clear()
            recent[doc] = shingles(text)
        return recent[doc]

    for batch in batches:
        keep = []
        for a, b, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
            x, y = own(a, s), own(b, t)
            shared = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * shared >= SHARE * (len(x) + len(y) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _likely(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = (reps.select(F.col("doc_id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents in ids."""
    ids = cut(ids)
    few = ids.count() <= BROADCAST_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _links(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs, those with 100 * intersection >= 75 * union of full shingle sets."""
    texts = cut(_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab")
    return cut(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"))


def _nearest(side, doc, comp, n, sig, sets):
    """Of one block pair: each row's NEAREST likely partners in other components."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(side))
    for i in x:
        j, agree = _partners(i, y, doc, comp, n, sig)
        if len(j) > NEAREST:
            top = np.argpartition(-agree, NEAREST - 1)[:NEAREST]
            j, agree = j[top], agree[top]
        j = j[agree >= MIN_AGREE]
        yield np.minimum(doc[j], doc[i]), np.maximum(doc[j], doc[i])


def _partners(i, y, doc, comp, n, sig):
    j = y[(comp[y] != comp[i]) & (doc[y] != doc[i]) & (100 * np.minimum(n[y], n[i]) >= SHARE * np.maximum(n[y], n[i]))]
    return j, (sig[j] == sig[i]).mean(1)


def _exact(side, doc, comp, n, sig, sets):
    """Of one block pair: links of full shingle sets that join components, by union-find inside."""
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if side.any() else np.arange(len(side))
    parent: dict[int, int] = {}
    items: dict[int, np.ndarray] = {}

    def root(c):
        while (p := parent.get(c, c)) != c:
            c = p
        return c

    def own(k):
        if k not in items:
            items[k] = np.frombuffer(sets[k], U64)
        return items[k]

    for i in x:
        j, agree = _partners(i, y, doc, comp, n, sig)
        for k in j[agree >= MIN_AGREE]:
            a, b = root(comp[i]), root(comp[k])
            if a != b:
                shared = len(np.intersect1d(own(i), own(k), assume_unique=True))
                if 100 * shared >= SHARE * (n[i] + n[k] - shared):
                    parent[max(a, b)] = min(a, b)
                    yield np.minimum(doc[[k]], doc[i]), np.maximum(doc[[k]], doc[i])


def _across(batches, step):
    """`step` over the block pairs of rows sorted by bucket and block pair; one is held at a time."""
    names = ("bucket", "i", "j", "side", "doc_id", "comp", "n")

    def answer(cols, ends):
        found, start = [], 0
        for end in ends:
            found += step(*(c[start:end] for c in cols[3:]))
            start = end
        both = np.unique(np.array([np.concatenate([f[k] for f in found]) for k in (0, 1)]), axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy() for c in names] + [np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS), np.array([*batch.column("items").to_pylist(), None], object)[:-1]]
        held = cols if held is None else [np.concatenate((h, c)) for h, c in zip(held, cols, strict=True)]
        ends = np.flatnonzero((np.diff(held[0]) != 0) | (np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1
        if len(ends):
            yield answer(held, ends)
            held = [h[ends[-1] :] for h in held]
    if held is not None:
        yield answer(held, [len(held[0])])


def _itemised(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingles(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "items"])


def _blocks(reps: DataFrame, crowded: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, dealt to block pairs."""
    placed = crowded.where("size > 2").select("doc_id", "n", "bucket").join(labels, F.col("doc_id") == F.col("node"), "left")
    placed = cut(placed.select("doc_id", "n", "bucket", F.coalesce("component", "doc_id").alias("comp")))
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket", "size")
    blocks = placed.join(mixed, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("own", F.pmod(F.hash("doc_id"), F.col("blocks")))
    dealt = blocks.select("doc_id", "n", "comp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("doc_id", "n", "comp", "bucket", F.least("own", "other").cast("bigint").alias("i"), F.greatest("own", "other").cast("bigint").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return dealt.join(reps.select("doc_id", "sig"), "doc_id")


def _swept(dealt: DataFrame, step) -> DataFrame:
    rows = dealt.select("bucket", "i", "j", "side", "doc_id", "comp", "n", "sig", "items").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return rows.mapInArrow(partial(_across, step=step), "a long, b long").distinct()


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of docs (a row's own doc_id, id, text): rows with their classes, classes with their groups, and each
    group's first row, that of the smallest id. Rows without words are in no class."""
    described = cut(docs.mapInArrow(_describe, "doc_id long, id long, n long, d1 long, d2 long, bands array<long>, sig binary"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))).alias("first")
    classes = cut(described.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), first))
    reps = cut(described.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "n", "bands", "sig"))
    members = reps.select("doc_id", "n", F.explode("bands").alias("bucket"))
    lead = F.min(F.struct(F.xxhash64("doc_id", "bucket").alias("h"), F.col("doc_id").alias("lead"), F.col("n").alias("lead_n"))).alias("l")
    leaders = cut(members.groupBy("bucket").agg(lead, F.count("*").alias("size")).where("size > 1").select("bucket", "l.lead", "l.lead_n", "size"))
    crowded = members.join(leaders, "bucket")
    pairs = crowded.where("doc_id <> lead").where(_fits("n", "lead_n")).select(F.least("doc_id", "lead").alias("a"), F.greatest("doc_id", "lead").alias("b")).distinct()
    tried = cut(_likely(reps, pairs))
    first = _links(docs, tried)
    near = _swept(_blocks(reps, crowded, components(first)).withColumn("items", F.lit(None).cast("binary")), _nearest)
    found = first.unionByName(_links(docs, cut(near.join(tried, ["a", "b"], "left_anti"))))
    rest = cut(_blocks(reps, crowded, components(found)))
    sets = _texts(docs, rest.select("doc_id").distinct()).mapInArrow(_itemised, "doc_id long, items binary")
    found = found.unionByName(cut(_swept(rest.join(sets, "doc_id"), _exact)))
    labels = cut(components(found))
    named = cut(classes.join(labels, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "rep").alias("_c"), "first"))
    firsts = named.groupBy("_c").agg(F.min("first").alias("first")).select("_c", F.col("first.id").alias("_id"), F.col("first.row").alias("_first"))
    return described.select("doc_id", "id", "n", "d1", "d2"), named.drop("first"), firsts


def _own(rows: DataFrame, row: str) -> DataFrame:
    return rows.select(F.col(row).alias("doc_id"), F.col("doc_id").cast("bigint").alias("id"), "text")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    rows, named, firsts = _grouped(_own(keyed(docs.select("doc_id", "text"), "_row")[0], "_row"))
    out = rows.join(named.join(firsts, "_c"), ["d1", "d2", "n"], "left").withColumn("component_id", F.coalesce("_id", "id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("doc_id") == F.col("_first"), F.lit(True))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def first_rows(rows: DataFrame, row: str) -> DataFrame:
    """`row` (a long of each row's own) of the one row that stays of each group. Of equal texts without words
    one stays for each doc_id."""
    _, _, firsts = _grouped(_own(rows, row))
    blank = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")).groupBy("doc_id", "text").agg(F.min(row).alias(row))
    return firsts.select(F.col("_first").alias(row)).unionByName(blank.select(row))


def query(spark, sf_dir):
    from .common import read

    return near_duplicates(read(spark, sf_dir, "documents"))
