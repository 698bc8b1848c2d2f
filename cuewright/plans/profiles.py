"""Queries over profiles, reports and sources, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import captions as C
from ..functions import speech as X
from ..operators import cohort, profiles, rules
from ..sources import results, transcripts
from . import speech
from .captions import CAPS, PLAIN, caps
from .speech import FEATURES, SAID, WINDOWS, _q

RESTART = r"sorry|scratch that|let me (?:try|start|rephrase)|hold on|wait,|what i mean|i mean|what was i|where was i|anyway"
METRICS = ["IGRE04", "IGRE03", "IGRE23", "IGRE28", "IGRE01"]
SPOKEN_FAULTS = f"{SAID}, clips AS (SELECT rec AS id, list(text ORDER BY sid) AS sents FROM said GROUP BY rec), {speech.CLIP_RULES}"


def _t(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _videos(s, d):
    return _t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("n_chars").alias("views"), F.col("lang").alias("format"))


def _confidence(s, d):
    v = _videos(s, d)
    return profiles.shape_confidence(cohort.shape_rates(cohort.winners(v)), cohort.profile(v))


def _loaded(s, d):
    return _confidence(s, d).select("shape", "observations", F.round("conf", 9).alias("conf"), "rewards", "punishes")


def _verdicts(s, d):
    shapes = _confidence(s, d)
    return profiles.shape_verdicts(speech.said(s, d).select("sid", "text"), shapes).select("sid", "shape", *[F.round(c, 6).alias(c) for c in ("points", "factor")])


def _faults(s, d):
    said = speech.said(s, d).groupBy(F.col("rec").alias("id")).agg(F.array_sort(F.collect_list(F.struct("sid", "text"))).alias("x"))
    out = rules.clip_faults(said.select("id", F.transform("x", lambda x: x["text"]).alias("sents")))
    return out.select("id", F.explode_outer("faults").alias("f")).select("id", "f.fault", "f.severity")


def _summary(s, d):
    w = Window.partitionBy("lang")
    counted = _t(s, d, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(w.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("k").over(w))
    return profiles.summary(counted, "lang", "n_chars")


def _bonus(s, d):
    t = speech.timed(s, d)
    m = {"is_question": F.col("is_question"), "numbers": F.size("numbers"), "you": F.col("you"), "anaphor": X.leans_back(F.col("text")), "restart": F.lower("text").rlike(X.LEFT + "(?:" + RESTART + ")" + r"(?:(?<=,)(?=[\p{L}\p{N}_])|(?<!,)" + X.RIGHT + ")"), "filler": F.col("filler"), "seconds": F.col("end") - F.col("start")}
    out = t.withColumn("bonus", profiles.hook_bonus(m)).withColumn("seed", ~m["anaphor"] & ~m["restart"] & (m["filler"] == 0) & (m["seconds"] <= 14.0) & (F.col("bonus") > 0))
    return out.select("rec", "n", F.col("bonus").cast("int").alias("bonus"), "seed")


def _own(s, d):
    raw = F.array(F.when(F.col("doc_id") % 3 > 0, F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 7 > 0, F.substring("text", 1, 60)), F.when(F.col("doc_id") % 5 == 0, "n/a").otherwise(F.col("n_chars").cast("string")), (F.col("n_chars") % 100).cast("string"), F.lit("2024-01-01"))
    found = results.own_results(_t(s, d, "documents").select(raw.alias("raw")), METRICS, "view_rate")
    return found.select("title", "views", "views_actual", "ranked_by", "id", "has_sentence")


def _voices(s, d):
    return profiles.refusals(results.samples(caps(s, d).select(F.concat(F.lit("k"), F.col("sid") % 60).alias("source"), "text")), "source")


def _conversation_cues(s, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w).cast("double")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return _t(s, d, "conversations").select(F.col("conv_id").alias("rec"), F.col("turn").alias("cue"), (end - F.length("text")).alias("start"), end.alias("end"), flat.alias("text"))


def _sniffed(s, d):
    """The recordings written as SRT, as bracketed lines or as JSON by their number, and read whatever they are."""
    from ..functions import text as T

    cues = _conversation_cues(s, d)
    one = F.struct("cue", F.struct(T.stamp(F.col("start")).alias("start"), T.stamp(F.col("end")).alias("end"), "text").alias("c"))
    listed = cues.groupBy("rec").agg(F.array_sort(F.collect_list(one)).alias("x")).select("rec", F.transform("x", lambda x: x["c"]).alias("cs"))
    arrow = lambda c: F.concat(c["start"], F.lit(" --> "), c["end"])
    srt = F.array_join(F.transform("cs", lambda c, i: F.concat((i + 1).cast("string"), F.lit("\n"), arrow(c), F.lit("\n"), c["text"], F.lit("\n"))), "\n")
    bracket = F.array_join(F.transform("cs", lambda c: F.concat(F.lit("["), arrow(c), F.lit("] "), F.replace(c["text"], F.lit(", "), F.lit(",\n")))), "\n")
    bare, wrapped = F.to_json("cs"), F.to_json(F.struct(F.col("cs").alias("segments")))
    value = F.when(F.col("rec") % 4 == 0, srt).when(F.col("rec") % 4 == 1, bracket).when(F.col("rec") % 4 == 2, bare).otherwise(wrapped)
    read = transcripts.cues(listed.select("rec", value.alias("value")))
    return read.select("rec", "cue", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "text")


def _blocks(s, d):
    """Result blocks of each language written as JSON, and read: the first of each id stays."""
    one = F.struct(F.col("source").alias("query"), F.col("doc_id"), F.struct(F.lit("short").alias("format"), F.substring("text", 1, 40).alias("title"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("views"), F.concat(F.format_number(F.col("n_chars"), 0), F.lit(" views")).alias("views_raw"), F.when(F.col("doc_id") % 5 > 0, (F.col("doc_id") % 50).cast("string")).alias("id")).alias("r"))
    by = _t(s, d, "documents").where("lang is not null and source is not null").groupBy("lang", "source").agg(F.array_sort(F.collect_list(one)).alias("x")).select("lang", F.struct(F.col("source").alias("query"), F.transform("x", lambda x: x["r"]).alias("results")).alias("b"))
    files = by.groupBy(F.col("lang").alias("rec")).agg(F.to_json(F.array_sort(F.collect_list("b"), lambda a, b: F.when(a["query"] < b["query"], -1).when(a["query"] > b["query"], 1).otherwise(0))).alias("value"))
    return transcripts.videos(files).select("id", "title", "views", "format")


def _sql():
    from .queries import LIFT, X as T, _shape, _strip  # the patterns of shapes stand there

    one = """pf AS (SELECT count(*) AS videos, count(*) FILTER (winner) AS winners, count(*) >= 25 AS confident FROM (SELECT v.id, m.winner FROM (SELECT doc_id AS id FROM documents) v LEFT JOIN m USING (id)))"""
    body, tail = LIFT.rsplit("SELECT *, (winner_rate", 1)
    lift = f"{body.rstrip()}, lf AS (SELECT *, (winner_rate{tail}), {one}, cf AS (SELECT shape, lift, winners_using_it + rest_rate * (videos - winners) AS obs, least(1e0, (winners_using_it + rest_rate * (videos - winners)) / 20e0) * CASE WHEN confident THEN 1e0 ELSE 0.5e0 END AS conf FROM lf, pf)"
    shapes = ", ".join(f"CASE WHEN {_shape(n)} THEN {{'o': {i}, 's': '{n}'}} END" for i, n in enumerate(T.SHAPES))
    verdict = f"""{lift}, {SAID}, sx AS (SELECT sid, text AS title, {_strip} AS stripped FROM (SELECT sid, text, text AS title FROM said)),
        hx AS (SELECT sid, unnest(list_filter([{shapes}], lambda x: x IS NOT NULL)) AS h FROM sx),
        rx AS (SELECT sid, h.s AS shape, lift, conf, row_number() OVER (PARTITION BY sid ORDER BY round(conf * abs(lift - 1), 12) DESC, h.o) AS r FROM hx JOIN cf ON shape = h.s)
        SELECT sid, shape, round(12 * conf * greatest(-0.6e0, least(0.6e0, lift - 1)) / 0.6e0, 6) AS points, round(CASE WHEN lift < 1 THEN greatest(0.5e0, 1 - conf * (1 - lift)) ELSE 1 END, 6) AS factor FROM rx WHERE r = 1"""
    return f"{lift} SELECT shape, round(obs, 1) AS observations, round(conf, 9) AS conf, conf >= 0.25 AND lift > 1 AS rewards, conf >= 0.25 AND lift < 1 AS punishes FROM cf", verdict


def queries() -> dict:
    return {
        "s20_profile_confidence": _loaded,
        "t14_shape_verdicts": _verdicts,
        "a19_piece_labels": lambda s, d: profiles.piece_labels(_faults(s, d)),
        "a20_rollup": lambda s, d: profiles.rollup(_faults(s, d)),
        "a25_summary": _summary,
        "m3_hook_bonus": _bonus,
        "s18_own_results": _own,
        "g10_refusals": _voices,
        "s1_sniffed_cues": _sniffed,
        "s13_result_blocks": _blocks,
    }


def oracle_sql() -> dict[str, str]:
    loaded, verdicts = _sql()
    return {
        "s20_profile_confidence": loaded,
        "t14_shape_verdicts": verdicts,
        "a19_piece_labels": f"""WITH {SPOKEN_FAULTS} SELECT id, CASE WHEN bool_or(severity = 'fatal') THEN 'DO NOT POST' WHEN bool_or(severity = 'serious') THEN 'NEEDS A FIX' ELSE 'NOTHING SERIOUS FOUND' END AS label,
            count(*) FILTER (severity IN ('fatal', 'serious')) AS n_grave, arg_min(fault, {{'r': CASE severity WHEN 'fatal' THEN 1 WHEN 'serious' THEN 2 ELSE 3 END, 'f': fault}}) AS worst FROM faulted GROUP BY id""",
        "a20_rollup": f"""WITH {SPOKEN_FAULTS}, k AS (SELECT fault AS kind, count(*) AS n, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'serious') AS serious, count(*) FILTER (severity = 'minor') AS minor FROM faulted WHERE fault IS NOT NULL GROUP BY fault)
            SELECT *, row_number() OVER (ORDER BY n DESC, kind) AS place FROM k""",
        "a25_summary": "SELECT lang, count(*) AS n, list_sort(list(n_chars))[count(*) // 2 + 1] AS upper_median, max(n_chars) AS top FROM documents GROUP BY lang",
        "m3_hook_bonus": rf"""WITH {SAID}, {FEATURES}, {WINDOWS}, b AS (SELECT rec, n, filler, e - s AS d, regexp_matches(text, '{_q(X.ANAPHOR)}\b', 'i') AS anaphor, regexp_matches(low, '\b(?:{RESTART})\b') AS restart, is_question, numbers, you FROM sp),
            c AS (SELECT *, (CASE WHEN is_question THEN 8 ELSE 0 END) + (CASE WHEN len(numbers) > 0 THEN 4 ELSE 0 END) + (CASE WHEN you > 0 THEN 3 ELSE 0 END) - (CASE WHEN anaphor THEN 25 ELSE 0 END) - (CASE WHEN restart THEN 25 ELSE 0 END) - 10 * filler - (CASE WHEN d > 14 THEN 10 ELSE 0 END) AS bonus FROM b)
            SELECT rec, n, CAST(bonus AS INT) AS bonus, NOT anaphor AND NOT restart AND filler = 0 AND d <= 14 AND bonus > 0 AS seed FROM c""",
        "s18_own_results": """WITH r AS (SELECT CASE WHEN doc_id % 3 > 0 THEN CAST(doc_id AS VARCHAR) END AS i, CASE WHEN doc_id % 7 > 0 THEN trim(text[1:60]) ELSE '' END AS title, CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars AS DOUBLE) END AS v, CAST(n_chars % 100 AS DOUBLE) AS k FROM documents)
            SELECT title, k AS views, v AS views_actual, 'view_rate' AS ranked_by, coalesce(i, '2024-01-01::' || title[1:40]) AS id, len(regexp_extract_all(regexp_replace(title, '#[A-Za-z0-9_]+', ' ', 'g'), '[A-Za-z'']{2,}')) >= 3 AS has_sentence FROM r WHERE title <> '' AND v IS NOT NULL AND k IS NOT NULL""",
        "g10_refusals": rf"""WITH {SAID}, {CAPS}, t AS (SELECT sid, {PLAIN("replace(replace(text, '‘', chr(39)), '’', chr(39))")} AS text FROM caps), p AS (SELECT 'k' || (sid % 60) AS source, unnest(regexp_split_to_array(text, '\n\s*\n')) AS part FROM t),
            q AS (SELECT source FROM p WHERE len(regexp_extract_all(lower(regexp_replace(regexp_replace(regexp_replace(part, '{_q(C.URL)}', ' ', 'g'), '{_q(C.HASHTAG)}', ' ', 'g'), '{_q(C.MENTION)}', ' ', 'g')), '[a-z][a-z''\-]*')) >= 3) SELECT source, count(*) AS samples, count(*) < 20 AS refused FROM q GROUP BY source""",
        "s1_sniffed_cues": r"""WITH q AS (SELECT conv_id AS rec, turn, text, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS e FROM conversations)
            SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY turn) - 1 AS cue, e - length(text) AS start, e AS "end", trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM q WHERE length(text) > 0""",
        "s13_result_blocks": """WITH r AS (SELECT lang, source, doc_id, text[1:40] AS title, n_chars AS views, CASE WHEN doc_id % 5 > 0 THEN CAST(doc_id % 50 AS VARCHAR) ELSE text[1:40] END AS id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND text <> '' AND n_chars IS NOT NULL),
            k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lang, source, doc_id) AS r FROM r) SELECT id, title, views, 'short' AS format FROM k WHERE r = 1""",
    }
