"""Queries over voices. A source of documents is somebody who writes; the reference of ordinary language is what all
sources write together; drafts are made from each document's own sentences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import captions as C
from ..operators import voice
from .captions import _q

PROFANITY = r"damn|hell|crap"


def samples(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text is not null")
    return docs.select(F.coalesce("source", F.lit("?")).alias("by"), F.col("doc_id").alias("sample"), "text")


def reference(s, d):
    """word, per_million over all samples; words used under twenty times are in no reference."""
    said = samples(s, d).select(F.explode(C.bare_words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("k"))
    return said.join(F.broadcast(said.agg(F.sum("k").alias("all")))).where("k >= 20").select("word", (F.col("k") * 1_000_000 / F.col("all")).alias("per_million"))


def _drafts(s, d, known=None):
    own = samples(s, d)
    made = voice.drafts(own.select(F.col("sample").alias("id"), "by", "text"), known or voice.profile(own))
    return made.join(own.select(F.col("sample").alias("id"), "by"), "id")


def _drift(s, d):
    known = voice.profile(samples(s, d))
    return voice.drift(_drafts(s, d, known), known)


_BARE = "lower(" + "".join("regexp_replace(" for _ in range(3)) + "text" + "".join(f", '{_q(p)}', ' ', 'g')" for p in (C.URL, C.HASHTAG, C.MENTION)) + ")"
WORDS = rf"w AS (SELECT coalesce(source, '?') AS who, doc_id, unnest(regexp_extract_all({_BARE}, '[a-z][a-z''\-]*')) AS word FROM documents WHERE text IS NOT NULL)"
QUERIES = {
    "a7_voice_profile": (lambda s, d: voice.profile(samples(s, d), PROFANITY), None),
    "a8_over_used": (
        lambda s, d: voice.over_used(samples(s, d), reference(s, d)),
        f"""WITH {WORDS}, r AS (SELECT word, count(*) * 1e6 / (SELECT count(*) FROM w) AS per_million FROM w GROUP BY word HAVING count(*) >= 20),
        c AS (SELECT who, word, count(*) AS uses, count(DISTINCT doc_id) AS in_samples FROM w GROUP BY ALL), t AS (SELECT who, count(*) AS total FROM w GROUP BY who),
        x AS (SELECT c.*, round(uses * 1e6 / total / per_million, 1) AS lift FROM c JOIN t USING (who) LEFT JOIN r USING (word) WHERE in_samples >= 3 AND uses >= 4),
        y AS (SELECT *, CAST(row_number() OVER (PARTITION BY who, lift IS NULL ORDER BY lift DESC, CASE WHEN lift IS NULL THEN in_samples END DESC, uses DESC, word) AS INT) AS place FROM x) SELECT who AS "by", word, uses, in_samples, lift, place FROM y WHERE place <= 14""",
    ),
    "t11_drafts": (lambda s, d: _drafts(s, d).select("id", "by", F.array_join("lines", " ").alias("draft"), "n_words", "opener", "ends_right", "n_filler"), None),
    "a26_drift": (_drift, None),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
