"""A corpus pipeline of five stages, each over all that the one before kept.

Language identification drops documents that it rejects; tokeniser-fertility rules drop documents that
fail; of each group of near-duplicates the document with the smallest doc_id stays; the rest are put in
the order of a Pfair mix of their sources; and best-fit packing gives the pieces of that corpus.

Every stage decides by row, not by doc_id. Defined results: a null text is an empty one, without a letter, so
the first stage rejects it (given to `pack` alone, it is one piece, the end token); a null doc_id, lang or
source is a value like any other; very long texts go through whole; rows that repeat are judged each and
alike, and one stays in `deduplicate`; extra columns pass through the first four stages whatever their
names; an empty table gives none, and `pack` no pieces.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import functions as F

from cuewright.llm import common, fertility, langid, mixing, neardup, packing


def language(spark, docs, sf_dir):
    """Kept: documents in a known language. The model learns from the documents' own lang."""
    found = langid.identify(docs, langid.train(docs))
    return found.where(~F.col("rejected")).select(*docs.columns)


def rules(spark, docs, sf_dir):
    """Kept: rows that neither the base rules nor the fertility bands reject, by their own language and text."""
    own = {"_id": F.col("doc_id"), "_lang": F.col("lang"), "_text": F.md5("text")}
    measured = common.cut(fertility.measure(docs.select("lang", "text", *[c.alias(k) for k, c in own.items()])))
    good = fertility.judge(measured).where("kept").select(*own).distinct()
    same = reduce(and_, [c.eqNullSafe(F.col(k)) for k, c in own.items()])
    return docs.join(good, same, "left_semi")


def deduplicate(spark, docs, sf_dir):
    """Kept: of each group of near-duplicates one row, of the smallest doc_id."""
    rows, _ = common.keyed(docs, "_row")
    return rows.join(common.cut(neardup.first_rows(rows, "_row")), "_row", "left_semi").select(*docs.columns)


def mix(spark, docs, sf_dir):
    """All documents, in the order of the mix."""
    mixed, _ = mixing.slots(docs)
    order = mixing.in_slot(docs)
    return mixed.repartitionByRange(*order[:2]).sortWithinPartitions(*order).select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of at most 1024 tokens and their places in sequences, in the order of the mix: that of the files read."""
    rows, n = common.keyed(docs, "_row")
    return packing.pack(common.cut(packing.pieces(rows, order="_row")), order="_row", n=n)


STAGES = [("language", language), ("rules", rules), ("deduplicate", deduplicate), ("mix", mix), ("pack", pack)]
#: Trained models and tokenisers cannot be written in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to documents, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
