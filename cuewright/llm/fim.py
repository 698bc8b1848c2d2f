"""Fill-in-middle by a sparse checkpoint index.

A text is a row of units: a word with the white space ahead of it, or the white space at the end. They are
counted in one pass over the UTF-8 bytes, block by block, and every EVERY units the byte and code-point offset
reached is recorded. A cut after unit k is found by binary search over these checkpoints and a short rescan
from the one below it, so a text of any length needs room for one block and its checkpoints only. Where a text
is cut, and into which form, follows from its id and the seed alone.

Forms: psm is <P>prefix<S>suffix<M>middle, spm <S>suffix<P>prefix<M>middle, plain the text itself (a text that
is empty or holds a mark, and those that the draw leaves out). restore() rebuilds the text from output and form.

Defined results: a null text is an empty one (plain, n = 0); a null id draws like the empty id; very long texts
are cut whole; repeated rows are cut alike; an empty table gives no rows. Other columns pass through whatever
their names; those named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _SPACE, free, read

MARKS = ("<P>", "<S>", "<M>")
EVERY, BLOCK, BATCH_BYTES = 256, 1 << 16, 1 << 23
OUTPUTS = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


class Checkpoints:
    """The units of a text and, every `every` units, the offset of a unit's end in bytes and in code points."""

    def __init__(self, raw: np.ndarray, every: int = EVERY, block: int = BLOCK):
        self.raw, self.every = raw, every
        units = chars = 0
        at = [np.zeros((1, 2), np.int64)]
        for a in range(0, len(raw), block):
            part = raw[a : a + block]
            ends = self._ends(a, a + len(part))
            upto = np.cumsum((part & 0xC0) != 0x80)
            mine = ends[(units + 1 + np.arange(len(ends))) % every == 0]
            at.append(np.stack((mine, chars + upto[mine - a - 1]), 1))
            units += len(ends)
            chars += int(upto[-1])
        self.chars = chars
        #: Units, and whether the last one is white space alone.
        self.tail = bool(len(raw)) and bool(_SPACE[raw[-1]])
        self.n = units + self.tail
        self.at = np.concatenate(at)

    def _ends(self, a: int, b: int) -> np.ndarray:
        """Ends of words in bytes a to b: offsets just behind a byte of a word that white space or the text's end follows."""
        space = _SPACE[self.raw[a : b + 1]]
        after = space[1:] if b < len(self.raw) else np.append(space[1:], True)
        return np.flatnonzero(~space[: b - a] & after) + a + 1

    def cut(self, k: int) -> tuple[int, int]:
        """Byte and code-point offset of the end of unit k (0: the start)."""
        if k == self.n:
            return len(self.raw), self.chars
        i = int(np.searchsorted(np.arange(len(self.at)) * self.every, k, side="right")) - 1
        byte, char = map(int, self.at[i])
        need = k - i * self.every
        if not need:
            return byte, char
        a, width = byte, 4096
        while True:  # about one round: `every` units lie between checkpoints
            ends = self._ends(a, min(a + width, len(self.raw)))
            if len(ends) >= need:
                end = int(ends[need - 1])
                return end, char + int(np.count_nonzero((self.raw[byte:end] & 0xC0) != 0x80))
            need -= len(ends)
            a, width = a + width, width * 2


def rearrange(raw: bytes, draws: tuple[int, int, int, int], fim_percent: int, spm_percent: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output (bytes) of one text."""
    index = Checkpoints(np.frombuffer(raw, np.uint8))
    if not raw or draws[2] % 100 >= fim_percent or any(m.encode() in raw for m in MARKS):
        return index.n, "plain", None, None, raw
    first, second = sorted(d % (index.n + 1) for d in draws[:2])
    (b1, c1), (b2, c2) = index.cut(first), index.cut(second)
    prefix, middle, suffix = b"<P>" + raw[:b1], b"<M>" + raw[b1:b2], b"<S>" + raw[b2:]
    if draws[3] % 100 < spm_percent:
        return index.n, "spm", c1, c2 - c1, suffix + prefix + middle
    return index.n, "psm", c1, c2 - c1, prefix + suffix + middle


def draw(seed: int, key: str) -> list[Column]:
    """Four unsigned 32-bit numbers from the sha256 of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, key: str = "doc_id") -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; its text stays."""
    docs = docs.drop(*OUTPUTS.names)
    own = docs.schema
    draws = free(docs, *[f"_h{i}" for i in range(1, 5)])
    schema = T.StructType([*own.fields, *OUTPUTS.fields])

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            lots = list(zip(*[batch.column(h).to_pylist() for h in draws], strict=True))
            rest = batch.select(own.names)
            done, start, size = [], 0, 0
            for i in range(batch.num_rows):
                done.append(rearrange(texts[i].as_py() or b"", lots[i], fim_percent, spm_percent))
                size += len(done[-1][-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    cols = zip(*done, strict=True)
                    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
                    arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                    arrays[-1] = arrays[-1].cast(pa.string())
                    part = rest.slice(start, len(done))
                    yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.names)
                    done, start, size = [], i + 1, 0

    return docs.withColumns(dict(zip(draws, draw(seed, key), strict=True))).mapInArrow(run, schema)


def restore(output: str = "output", form: str = "form") -> Column:
    """The text that output and form came from. The marks lie apart, as no rearranged text holds one."""
    out = F.col(output)
    part = lambda a, b: F.substring_index(F.substring_index(out, a, -1), b, 1)  # noqa: E731  between two marks
    psm = F.concat(part("<P>", "<S>"), F.substring_index(out, "<M>", -1), part("<S>", "<M>"))
    spm = F.concat(part("<P>", "<M>"), F.substring_index(out, "<M>", -1), part("<S>", "<P>"))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def query(spark, sf_dir):
    made = fill_in_middle(read(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restore(), 256)}
    return made.withColumns(digests).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
u AS (SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS d FROM t),
v AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain' WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
w AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS p, coalesce(array_to_string(units[a + 1:b], ''), '') AS m, coalesce(array_to_string(units[b + 1:], ''), '') AS s FROM v)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256 FROM w"""
