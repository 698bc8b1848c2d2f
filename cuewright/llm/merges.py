"""SentencePiece BPE in vectorised merge rounds, and its decoding.

The file's pieces and scores are read through the public library; the work is numpy's. A text gets the library's
dummy space ahead of it, spaces become U+2581, and it falls into words: no piece goes on from another character
into U+2581, nor over two neighbouring characters that no piece holds side by side, so no merge crosses such an
edge. The distinct words of a batch lie in one flat array of symbols. A round finds the smallest pair rank of
each word, merges all its places at once, left to right where they overlap, and compacts the array; words without
a pair leave it. Characters that are no piece become bytes.

All places of a round may merge at once because a trained vocabulary is canonical: merging a piece's own
characters gives that piece, by ranks that grow (tests hold this of the public one, and all texts against the
library). The pieces that share the lowest score, runs of spaces there, are no such case: they come last and merge
leftmost first, which a stack does in one pass over a word.

Defined results: a null or empty text has the end id alone; very long texts are encoded whole; the literal
U+2581 is a space, as for the library; repeated rows are encoded alike; an empty table gives no rows. Other columns
pass through whatever their names; one named like an output is replaced. Ids that are null or outside the
vocabulary are an error.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read
from .fertility import PIECES, public

SPACE, NONE, BATCH_CHARS = "▁", np.iinfo(np.int64).max, 1 << 21
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def batches_of(texts, limit: int):
    """Runs of texts of about `limit` characters each (one text at least)."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of runs of a flat array, one run after the other."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    return np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


class Vocabulary:
    """Pieces, pair ranks and bytes of a BPE model file with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = lib.get_piece_size()
        self.n, self.end = n, lib.eos_id()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        kind = np.array([0 if lib.is_control(i) or lib.is_unused(i) else 1 if lib.is_unknown(i) else 2 if lib.is_byte(i) else 3 for i in range(n)])
        rank = {pieces[i]: -lib.get_score(i) for i in np.flatnonzero(kind == 3)}
        ids = {pieces[i]: int(i) for i in np.flatnonzero(kind == 3)}
        lowest = max(rank.values())
        self.tied = {p for p, r in rank.items() if r == lowest and len(p) > 1} if sum(r == lowest for r in rank.values()) > 1 else set()
        if any(p not in self.tied and any(t in p for t in self.tied) for p in rank):
            raise ValueError("pieces of the lowest score may not lie inside others")
        self.tied_ids = np.array(sorted({ids[p] for p in self.tied} | {ids[c] for p in self.tied for c in set(p) if c in ids}), np.int64)
        self.pieces, self.ids = pieces, ids
        symbol = lambda p: ids.get(p, n + ord(p) if len(p) == 1 else None)
        pairs = [(a * self.width + b, rank[q], ids[q]) for q in rank if q not in self.tied for k in range(1, len(q)) if (a := symbol(q[:k])) is not None and (b := symbol(q[k:])) is not None]
        keys, ranks, made = (np.array(x) for x in zip(*sorted(pairs), strict=True))
        self.keys, self.made = keys.astype(np.int64), made.astype(np.int64)
        #: Ranks as whole numbers in the order of the scores.
        self.ranks = np.unique(ranks, return_inverse=True)[1].astype(np.int64)
        inner = sorted({ord(q[k]) << 21 | ord(q[k + 1]) for q in rank for k in range(len(q) - 1)})
        self.inner = np.array(inner, np.int64)
        single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
        self.chars, self.char_ids = (np.array(x, np.int64) for x in zip(*single, strict=True))
        self.byte_ids = np.zeros(256, np.int64)
        surfaces = []
        for i, p in enumerate(pieces):
            if kind[i] == 2:
                self.byte_ids[int(p[3:5], 16)] = i
            surfaces.append(b"" if kind[i] == 0 else " ⁇ ".encode() if kind[i] == 1 else bytes([int(p[3:5], 16)]) if kind[i] == 2 else p.replace(SPACE, " ").encode())
        self.control, self.normal = kind == 0, kind == 3
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)
        self.sizes = np.array([len(s) for s in surfaces], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    @property
    def width(self) -> int:
        return self.n + 0x110000

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where it is no pair) and merged symbol of neighbours."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], NONE), self.made[at]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, flat, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        symbols = np.where(self.chars[at] == points, self.char_ids[at], self.n + points)
        seam = word[1:] != word[:-1]
        bigram = points[:-1] << 21 | points[1:]
        near = np.minimum(np.searchsorted(self.inner, bigram), len(self.inner) - 1)
        part = np.concatenate(([0], np.cumsum(seam | (self.inner[near] != bigram)))) if len(points) else word
        symbols, word = self._merge(symbols, part, word)
        symbols, word = self._stack(symbols, word)
        return self._fall_back(symbols, word, len(words))

    def _merge(self, symbols: np.ndarray, part: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.arange(len(symbols))
        done = []
        rank, made = self._pairs(symbols, part)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            least = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(part)))
            live = np.repeat(least != NONE, sizes)
            if not live.all():  # parts without a pair leave
                done.append((order[~live], symbols[~live], word[~live]))
                symbols, part, word, order, rank, made = (x[live] for x in (symbols, part, word, order, rank, made))
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            # of places that overlap, every second one from the left
            run = np.concatenate(([True], np.diff(hit) != 1))
            since = hit - hit[np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))]
            hit = hit[since % 2 == 0]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            now = hit - np.arange(len(hit))
            symbols, part, word, order, rank, made = (x[keep] for x in (symbols, part, word, order, rank, made))
            # only pairs at and ahead of a merged symbol are new
            near = np.zeros(len(symbols), bool)
            near[now] = near[np.maximum(now - 1, 0)] = True
            new = np.flatnonzero(near)
            follow = np.minimum(new + 1, len(symbols) - 1)
            r, m = self._rank(symbols[new], symbols[follow])
            rank[new] = np.where((part[new] == part[follow]) & (new != follow), r, NONE)
            made[new] = m
        order, symbols, word = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (order, symbols, word)
        back = np.argsort(order, kind="stable")
        return symbols[back], word[back]

    def _pairs(self, symbols: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            r, made[:-1] = self._rank(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(part[1:] == part[:-1], r, NONE)
        return rank, made

    def _stack(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the pieces of the lowest score, leftmost first."""
        if not self.tied or len(symbols) < 2:
            return symbols, word
        mine = np.isin(symbols, self.tied_ids)
        pair = mine[1:] & mine[:-1] & (word[1:] == word[:-1])
        if not pair.any():
            return symbols, word
        edges = np.diff(np.concatenate(([0], pair.astype(np.int8), [0])))
        known: dict[bytes, list[int]] = {}
        out, last = [], 0
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1, strict=True):
            run = symbols[a:b]
            merged = known.get(run.tobytes())
            if merged is None:
                stack: list[str] = []
                for s in run:
                    stack.append(self.pieces[s])
                    while len(stack) > 1 and stack[-2] + stack[-1] in self.tied:
                        top = stack.pop()
                        stack[-1] += top
                merged = known[run.tobytes()] = [self.ids[p] for p in stack]
            out += [(symbols[last:a], word[last:a]), (np.array(merged, np.int64), np.full(len(merged), word[a]))]
            last = b
        out.append((symbols[last:], word[last:]))
        symbols, word = (np.concatenate(x) for x in zip(*out, strict=True))
        return symbols, word

    def _fall_back(self, symbols: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, where a character that is no piece becomes its bytes; and how many ids each word has."""
        other = symbols >= self.n
        if other.any():
            points, which = np.unique(symbols[other] - self.n, return_inverse=True)
            raw = [chr(p).encode("utf-8", "replace") for p in points]
            sizes = np.array([len(b) for b in raw])
            flat = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            counts = np.ones(len(symbols), np.int64)
            counts[other] = sizes[which]
            at = np.repeat(other, counts)
            ids = np.repeat(symbols, counts)
            ids[at] = flat[gather((np.cumsum(sizes) - sizes)[which], sizes[which])]
            symbols, word = ids, np.repeat(word, counts)
        return symbols, np.bincount(word, minlength=n)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the offsets of each text's ids (one more than texts)."""
        split = [_WORD.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        n_words = np.fromiter(map(len, split), np.int64, len(split))
        coded = pa.array([w for ws in split for w in ws], pa.string()).dictionary_encode()
        flat, sizes = self.words(coded.dictionary.to_pylist())
        starts, which = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ids = flat[gather(starts[which], sizes[which])]
        upto = np.concatenate(([0], np.cumsum(sizes[which])))[np.concatenate(([0], np.cumsum(n_words)))]
        if end:
            ids = np.insert(ids, upto[1:], self.end)
            upto = upto + np.arange(len(upto))
        return ids.astype(np.int32), upto

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of rows of ids; bytes that are no UTF-8 become U+FFFD each."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.n:
            raise ValueError("an id lies outside the vocabulary")
        sizes = self.sizes[ids]
        raw = self.surface[gather(self.starts[ids], sizes)].tobytes()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        said = np.append(np.flatnonzero(~self.control[ids]), len(ids))  # places of ids that show
        first = said[np.searchsorted(said, offsets[:-1])]
        controls = np.flatnonzero(self.control[ids])
        out = []
        for a, b, f in zip(offsets[:-1].tolist(), offsets[1:].tolist(), first.tolist(), strict=True):
            # bytes on either side of a control id are no one character
            edges = [a, *controls[np.searchsorted(controls, a) : np.searchsorted(controls, b)].tolist(), b]
            text = "".join([raw[ends[x] : ends[y]].decode("utf-8", "each_byte") for x, y in zip(edges, edges[1:], strict=False)])
            dummy = f < b and self.normal[ids[f]] and self.pieces[ids[f]].startswith(SPACE)
            out.append(text[1:] if dummy else text)
        return out


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�", error.start + 1


def _vocabulary(model: bytes) -> Vocabulary:
    import codecs

    codecs.register_error("each_byte", _each_byte)
    return Vocabulary(model)


def encode(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """docs with `out`, the ids of its text (and the end id). model: the file of the vocabulary."""
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast(open(model or public(PIECES), "rb").read())  # 0.5 MB
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        own = _vocabulary(shared.value)
        for batch in batches:
            start = 0
            for texts in batches_of((t or "" for t in batch.column(text).to_pylist()), BATCH_CHARS):
                ids, offsets = own.encode(texts, end)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, len(texts)).columns, lists], names=schema.names)
                start += len(texts)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str | None = None, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """rows with `out`, the text of their ids; a null list gives null."""
    rows = rows.drop(out)
    shared = rows.sparkSession.sparkContext.broadcast(open(model or public(PIECES), "rb").read())
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        own = _vocabulary(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(ids)
                sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                flat = pa.compute.list_flatten(lists).to_numpy(zero_copy_only=False)
                texts = own.decode(flat, np.concatenate(([0], np.cumsum(sizes))))
                known = lists.is_valid().to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([t if k else None for t, k in zip(texts, known, strict=True)], pa.string())], names=schema.names)

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir):
    coded = encode(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    sums = {"n_tokens": F.size("ids").cast("long"), "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)}
    return decode(coded.withColumns(sums)).select("doc_id", *sums, F.sha2("decoded", 256).alias("decoded_sha256"))
