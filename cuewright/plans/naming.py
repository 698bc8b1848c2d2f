"""Queries over names, numbers, addresses and layout, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import text as X
from . import captions
from .captions import CAPS, SAID, TOKS, caps

#: Furniture of names by key: numbers, accents, labels, addresses, times.
ODD = ["$400,000 and 1,234,567", "café – “naïve”…", "400 000 people", "(speaker 0) hello (Speaker 1) there", "[music]", "https://me@host.org/own/repo.git", "git@host.org:team/tool", "2026-01-05T10:00:00+02:00", "2026-01-05 10:00", "30000/1001", "25/1", "Übung Nr. 7.MP4", "...", "1.2M views", "No views", "10,746 views", "makers making makes", "(laughs) yes"]


def odd(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_retailprice", F.expr(captions._pick(ODD, f"p_partkey % {len(ODD)}", True)).alias("odd"), F.concat_ws(" ", "p_name", "p_brand").alias("name"))


SQL_ODD = f"odd AS (SELECT *, {captions._pick(ODD, f'p_partkey % {len(ODD)}', False)} AS odd, concat_ws(' ', p_name, p_brand) AS name FROM part)"
_fold = lambda x: f"translate(regexp_replace(translate({x}, '’‘“”…', '''''\"\" '), '[–—]', ' - ', 'g'), '{N.ACCENTED}', '{N.PLAIN}')"


def _joined(x: str, rounds: int = 4) -> str:
    for _ in range(rounds):
        x = rf"regexp_replace({x}, '([0-9]{{1,3}})[, ]([0-9]{{3}})([^0-9]|$)', '\1\2\3', 'g')"
    return x


_stem = lambda w: "CASE " + " ".join(f"WHEN length({w}) > {len(x) + 3} AND ends_with({w}, '{x}') THEN {w}[1:length({w}) - {len(x)}]" for x in N.SUFFIXES) + f" ELSE {w} END"


def _idf(s, d):
    words = odd(s, d).select("p_partkey", F.explode(F.array_distinct(F.transform(X.words(F.col("name")), N.stem))).alias("stem"))
    n = s.read.parquet(f"{d}/part.parquet").agg(F.count("*").alias("n"))
    return words.groupBy("stem").agg(F.count("*").alias("df")).join(F.broadcast(n)).select("stem", "df", F.round(N.naming_idf(F.col("n"), F.col("df")), 9).alias("weight"))


def _shared(s, d):
    one = caps(s, d).select("sid", F.array_distinct(captions.C.tokens(F.col("card"))).alias("c"), F.array_distinct(captions.C.tokens(F.col("text"))).alias("t"))
    both = F.size(F.array_intersect("c", "t"))
    return one.select("sid", both.alias("shared"), ((F.size("c") > 0) & (both == F.size("c")) | (both >= 4)).alias("repeats"))


QUERIES = {
    "f21_folded": (
        lambda s, d: odd(s, d).select("p_partkey", N.ascii_fold(F.col("odd")).alias("folded"), N.join_numbers(F.col("odd")).alias("numbers"), N.stem(F.get(X.words(F.col("odd")), F.lit(0))).alias("stem"), N.safe_name(F.col("odd")).alias("safe")),
        rf"""WITH {SQL_ODD}, w AS (SELECT *, regexp_extract_all(lower(odd), '[a-z'']+')[1] AS w, regexp_replace(translate(odd, '{N.ACCENTED}', '{N.PLAIN}'), '[^\x00-\x7F]', '', 'g') AS p FROM odd),
        q AS (SELECT *, regexp_extract(p, '^.+(\.[^.]+)$', 1) AS dot FROM w), r AS (SELECT *, regexp_replace(regexp_replace(p[1:length(p) - length(dot)], '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g') AS base FROM q)
        SELECT p_partkey, {_fold('odd')} AS folded, {_joined('odd')} AS numbers, {_stem('w')} AS stem, CASE WHEN base = '' THEN 'file' ELSE base END || lower(dot) AS safe FROM r""",
    ),
    "f30_addresses": (
        lambda s, d: odd(s, d).select("p_partkey", N.remote(F.col("odd"), "host.org").alias("r"), N.has_offset(F.col("odd")).alias("zoned"), N.frame_rate(F.col("odd")).alias("fps"), X.views(F.col("odd")).alias("views")).select("p_partkey", "r.owner", "r.repo", "zoned", "fps", "views"),
        rf"""WITH {SQL_ODD}, m AS (SELECT *, CASE WHEN regexp_matches(odd, '^https?://(?:[^@/]+@)?host\.org/') THEN regexp_extract(odd, 'host\.org/(.*)$', 1) WHEN regexp_matches(odd, '^(?:ssh://)?git@host\.org[:/]') THEN regexp_extract(odd, 'host\.org[:/](.*)$', 1) END AS path FROM odd)
        SELECT p_partkey, string_split(path, '/')[1] AS owner, regexp_replace(string_split(path, '/')[2], '\.git$', '') AS repo,
            regexp_matches(odd, '^\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)?(Z|[+-]\d{{2}}:?\d{{2}})$') AS zoned,
            CASE WHEN regexp_matches(odd, '^\d+/\d+$') THEN round(CAST(string_split(odd, '/')[1] AS DOUBLE) / CAST(string_split(odd, '/')[2] AS DOUBLE), 3) END AS fps,
            CASE WHEN odd ILIKE 'no views%' THEN 0 WHEN regexp_matches(odd, '^[0-9.,]+\s*[KMB]?') THEN
                CAST(try_cast(replace(regexp_extract(odd, '^([0-9.,]+)', 1), ',', '') AS DOUBLE) * CASE regexp_extract(odd, '^[0-9.,]+\s*([KMB])?', 1) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 ELSE 1 END AS BIGINT) END AS views FROM m""",
    ),
    "f31_speakers": (
        lambda s, d: odd(s, d).select("p_partkey", N.speakers(F.col("odd")).alias("text"), N.is_speech(F.col("odd")).alias("speech"), N.head_words(F.col("odd"), 2).alias("head"), N.tail_words(F.col("odd"), 2).alias("tail")),
        rf"""WITH {SQL_ODD}, w AS (SELECT *, list_filter(regexp_split_to_array(odd, '\s+'), lambda x: x <> '') AS ws, regexp_extract(odd, '^\s*\(speaker ?([0-9?]+)\)', 1, 'i') AS lead, trim(regexp_replace(odd, '\(speaker ?[0-9?]+\)', ' ', 'gi')) AS bare FROM odd)
        SELECT p_partkey, CASE WHEN NOT regexp_matches(odd, '\(speaker ?[0-9?]+\)', 'i') THEN odd WHEN lead <> '' THEN 'SPEAKER_' || lead || ': ' || bare ELSE bare END AS text,
            trim(odd) <> '' AND NOT regexp_matches(odd, '^\s*(\[[^\]]*\]|\([^)]*\))\s*$') AS speech, array_to_string(ws[1:2], ' ') AS head, array_to_string(ws[greatest(1, len(ws) - 1):], ' ') AS tail FROM w""",
    ),
    "m9_layout": (
        lambda s, d: odd(s, d).select("p_partkey", N.even(F.col("p_size") * 1.5).alias("even"), F.round(N.lerp(F.col("p_retailprice"), F.lit(1.0), F.col("p_size") / 40.0), 6).alias("lerp"), N.drift(F.col("p_size") / 60.0, F.lit(0.4)).alias("drift"), N.content_key(F.col("name"), F.col("p_size")).alias("key"), F.round(X.contrast(X.luminance(F.col("p_size") * 5.0, F.col("p_size") * 2.0, F.lit(20.0)), X.luminance(F.lit(255.0), F.lit(255.0), F.lit(255.0))), 6).alias("contrast")),
        f"""WITH {SQL_ODD}, c AS (SELECT *, list_transform([p_size * 5e0, p_size * 2e0, 20e0], lambda x: CASE WHEN x / 255e0 <= 0.03928e0 THEN x / 255e0 / 12.92e0 ELSE pow((x / 255e0 + 0.055e0) / 1.055e0, 2.4e0) END) AS l FROM odd)
        SELECT p_partkey, CAST(greatest(2, round_even(p_size * 1.5e0 / 2, 0) * 2) AS INT) AS even, round(1 + (p_retailprice - 1) * greatest(0e0, least(1e0, p_size / 40e0)), 6) AS lerp,
            CASE WHEN abs(p_size / 60e0 - 0.4e0) > 0.5 THEN 'fail' WHEN abs(p_size / 60e0 - 0.4e0) > 0.05 THEN 'warn' ELSE 'ok' END AS drift, sha256(name || chr(1) || p_size) AS key,
            round(1.05e0 / (0.2126e0 * l[1] + 0.7152e0 * l[2] + 0.0722e0 * l[3] + 0.05e0), 6) AS contrast FROM c""",
    ),
    "a12_naming_idf": (
        _idf,
        f"""WITH {SQL_ODD}, w AS (SELECT DISTINCT p_partkey, unnest(list_transform(regexp_extract_all(lower(name), '[a-z'']+'), lambda w: {_stem('w')})) AS stem FROM odd),
        n AS (SELECT count(*) AS n FROM part) SELECT stem, count(*) AS df, round(0.45e0 + 0.55e0 * ln(1 + any_value(n) / count(*)) / ln(1 + any_value(n)), 9) AS weight FROM w, n GROUP BY stem""",
    ),
    "u5_word_sets": (
        _shared,
        f"""WITH {SAID}, {CAPS}, t AS (SELECT sid, list_distinct({TOKS('card')}) AS c, list_distinct({TOKS('text')}) AS t FROM caps)
        SELECT sid, CAST(len(list_intersect(c, t)) AS INT) AS shared, (len(c) > 0 AND len(list_intersect(c, t)) = len(c)) OR len(list_intersect(c, t)) >= 4 AS repeats FROM t""",
    ),
    "u1_union_all": (
        lambda s, d: s.read.parquet(f"{d}/region.parquet").select(F.lit("region").alias("file"), F.col("r_name").alias("name")).unionByName(s.read.parquet(f"{d}/nation.parquet").select(F.lit("nation").alias("file"), F.col("n_name").alias("name"))),
        "SELECT 'region' AS file, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation",
    ),
    "u7_symmetric_difference": (
        lambda s, d: (lambda a, b: a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b"))))(
            s.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("k")), s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_nationkey").alias("k"))
        ).groupBy("k", "side").agg(F.count("*").alias("n")),
        """WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier), x AS (SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a))
        SELECT k, side, count(*) AS n FROM x GROUP BY ALL""",
    ),
    "t13_newest": (
        lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest")),
        "SELECT user_id, arg_max(event_id, {'t': ts, 'i': event_id}) AS newest FROM events GROUP BY user_id",
    ),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
