"""Results of one's own: positional rows under ordered metric ids, and samples of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import captions as C
from ..functions import text as X

#: What the last two characters of an id mean, and the ids that differ.
ROLES = {"01": "date", "02": "date", "03": "title", "04": "id", "06": "url", "07": "type"}
EXPLICIT = {"IGRE23": "views", "IGRE21": "shares", "IGRE12": "saved", "IGRE26": "duration_s", "IGRE27": "retention", "IGRE28": "view_rate", "IGRE09": "interactions", "IGRE11": "reach", "IGRE10": "likes", "IGPO28": "views", "IGPO27": "shares", "IGPO15": "saved", "IGPO12": "interactions", "IGPO14": "reach", "IGPO13": "likes", "IGPO29": "follows", "IGPO07": "type", "IGPO03": "title", "IGPO01": "date"}

#: Kept where they were asked for, beside the date.
OPTIONAL = ["shares", "saved", "interactions", "reach", "likes", "follows", "retention", "view_rate", "duration_s"]


def role_of(field: str) -> str:
    own = field.strip().upper()
    return EXPLICIT.get(own) or ROLES.get(own[-2:]) or own.lower()


def own_results(rows: DataFrame, metrics: list[str], rank_by: str = "views") -> DataFrame:
    """rows (raw array<string>) -> title, views, views_actual, ranked_by, id, has_sentence.

    What is ranked by goes where views are, the true reach beside it. A row without a title, views or the
    value it is ranked by is dropped. The id is the row's, else its url, else date and title.
    """
    at = {role_of(m): i for i, m in enumerate(metrics)}
    cell = lambda role: F.get("raw", F.lit(at[role])) if role in at else F.lit(None).cast("string")
    number = lambda role: cell(role).try_cast("double")
    title = F.trim(F.coalesce(cell("title"), F.lit("")))
    out = rows.select(
        title.alias("title"), number(rank_by).alias("views"), number("views").alias("views_actual"), F.lit(rank_by).alias("ranked_by"),
        F.coalesce(F.nullif(cell("id"), F.lit("")), F.nullif(cell("url"), F.lit("")), F.concat(F.coalesce(cell("date"), F.lit("None")), F.lit("::"), F.substring(title, 1, 40))).alias("id"),
        X.has_sentence(title).alias("has_sentence"), *[cell("date").alias("date")] * ("date" in at), *[number(r).alias(r) for r in OPTIONAL if r in at and r != rank_by])
    return out.where("title <> '' and views is not null and views_actual is not null")


def samples(texts: DataFrame, split: str = "blank") -> DataFrame:
    """texts (source, text) -> source, ord, kind (written, transcript), text: whole, or split at blank lines or at rules.

    Markdown goes, as do an SRT file's numbers, times and tags; a transcript is one sample however files are split. A
    sample has three words or more; tags, handles and links are none.
    """
    straight = F.translate(F.translate("text", "’‘", "''"), "“”", '""')
    transcript = F.lower("source").endswith(".srt")
    lines = F.filter(F.transform(F.split(straight, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[0-9]+$") & ~x.contains("-->"))
    spoken = F.regexp_replace(F.array_join(lines, " "), "<[^>]+>", "")
    written = C.plain(straight)
    pattern = {"blank": r"\n\s*\n", "rule": r"(?m)^\s*(?:[-=*_]\s*){3,}\s*$"}.get(split)
    parts: Column = F.when(transcript, F.array(spoken)).otherwise(F.split(written, pattern) if pattern else F.array(written))
    rows = texts.select("source", F.when(transcript, "transcript").otherwise("written").alias("kind"), F.posexplode(parts).alias("ord", "part"))
    out = rows.select("source", "ord", "kind", F.regexp_replace("part", r"^\s+|\s+$", "").alias("text"))
    return out.where(F.size(C.bare_words(F.col("text"))) >= 3)
