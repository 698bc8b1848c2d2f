"""Queries over files in many shapes, written as JSON from the tables. Stand-ins: a document is a file of cards (its
sentences, two seconds apart) in one of six shapes by its id; an order's texts are a settings file of three layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import networks
from ..sources import blocks, cutlists, transcripts, trees

#: Sentences of a document as cards, in SQL.
CARDS_SQL = r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS sents FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, unnest(sents) AS text, unnest(range(1, len(sents) + 1)) AS card FROM s)"""


def _sentences(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").where("text is not null")
    split = F.split(F.regexp_replace("text", r"([.!?])\s+", "$1\u0001"), "\u0001")
    return docs.select("doc_id", F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "").alias("sents"))


def card_files(s, d):
    """file, value: shape 0 a batch, 1 one piece, 2 a list of pieces, 3 bare objects, 4 bare triples, 5 broken."""
    timed = F.transform("sents", lambda x, i: F.struct(x.alias("text"), (i * 2.0).alias("start"), (i * 2.0 + 1.5).alias("end")))
    own = _sentences(s, d).where(F.size("sents") > 0).withColumn("cards", timed)
    name, hook = F.concat(F.lit("doc "), "doc_id"), F.get("sents", F.lit(0))
    segs = F.array(F.struct(F.lit(4.0).alias("start"), F.lit(10.0).alias("end")), F.struct(F.lit(0.0).alias("start"), F.lit(3.0).alias("end")))
    batch = F.to_json(F.struct(F.array(F.struct(name.alias("piece"), F.struct(hook.alias("text")).alias("hook"), F.lit(9.0).alias("duration"), segs.alias("segments"), F.col("cards").alias("caption_cards"))).alias("pieces"), F.lit("Source ").alias("times")))
    one = F.to_json(F.struct(name.alias("filename"), hook.alias("hook_text"), "cards"))
    listed = F.to_json(F.array(F.struct(name.alias("id"), hook.alias("hook"), "cards"), F.struct(F.lit("").alias("id"), F.lit(None).cast("string").alias("hook"), F.slice("cards", 1, 1).alias("cards"))))
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    triples = F.concat(F.lit("["), F.array_join(F.transform("cards", lambda c: F.concat(F.lit("["), c["start"].cast("string"), F.lit(","), c["end"].cast("string"), F.lit(","), quoted(c["text"]), F.lit("]"))), ","), F.lit("]"))
    shape = F.pmod("doc_id", F.lit(6))
    value = F.when(shape == 0, batch).when(shape == 1, one).when(shape == 2, listed).when(shape == 3, F.to_json("cards")).when(shape == 4, triples).otherwise(F.concat(F.lit("{"), F.to_json("cards")))
    return own.select(F.col("doc_id").alias("file"), value.alias("value"))


def _setting_layers(s, d):
    """Three layers for each order: general settings, those of its priority, its own."""
    own = F.when(F.col("o_orderkey") % 3 == 0, F.to_json(F.struct(F.struct(F.col("o_totalprice").cast("long").alias("size"), F.struct(F.col("o_orderstatus").alias("face")).alias("font")).alias("look")))).when(F.col("o_orderkey") % 3 == 1, F.lit('{"look": "plain", "tags": ["a"]}')).otherwise(F.lit('{"look": {"font": null}, "depth": {"a": {"b": {"c": 2}}}}'))
    general = F.lit('{"look": {"size": 10, "font": {"face": "X", "weight": 400}}, "tags": ["x", "y"], "depth": {"a": {"b": {"c": 1, "d": 1}}}}')
    middle = F.to_json(F.struct(F.struct(F.struct(F.substring("o_orderpriority", 1, 1).cast("int").alias("weight")).alias("font")).alias("look")))
    orders = s.read.parquet(f"{d}/orders.parquet")
    return orders.select(F.col("o_orderkey").alias("id"), F.posexplode(F.array(general, middle, own)).alias("layer", "value"))


def _result_files(s, d):
    """A page of results for each conversation: its turns lie as blocks ten levels deep, every third one twice."""
    turns = s.read.parquet(f"{d}/conversations.parquet")
    long = F.concat(F.lit('{"videoRenderer":'), F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("videoId"), F.struct(F.array(F.struct(F.substring("text", 1, 20).alias("text")), F.struct(F.lit("!").alias("text"))).alias("runs")).alias("title"), F.struct(F.concat(F.length("text").cast("string"), F.lit(" views")).alias("simpleText")).alias("viewCountText"), F.struct(F.concat(F.col("turn").cast("string"), F.lit(":05")).alias("simpleText")).alias("lengthText"))), F.lit("}"))
    short = F.concat(F.lit('{"reelItemRenderer":'), F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("videoId"), F.struct(F.substring("text", 1, 20).alias("simpleText")).alias("headline"), F.struct(F.lit("1.2M views").alias("simpleText")).alias("viewCountText"))), F.lit("}"))
    block = F.when(F.col("turn") % 2 == 0, long).otherwise(short)
    nested = F.concat(F.lit('{"a":[{"b":{"c":[0,{"d":{"e":[[{"f":'), block, F.lit("}]]}}]}}]}"))
    lists = turns.select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.concat(nested, F.lit(","), block)).otherwise(nested).alias("b")).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "b"))), lambda x: x["b"]), ",").alias("all"))
    return lists.select(F.col("conv_id").alias("file"), F.concat(F.lit('<html><script>var ytInitialData = {"contents":['), "all", F.lit("]};</script></html>")).alias("html"))


def _harvested(s, d):
    blobs = _result_files(s, d).select("file", trees.embedded(F.col("html")).alias("value"))
    return trees.results(trees.nodes(blobs, [trees.LONG, *trees.SHORT])).select("file", "format", "title", "views", "duration_s", "id")


RULES = '{"defaults": {"limit": 900, "max_hashtags": 3}, "networks": {"short": {"limit": 140, "links": "strip"}, "bio": {"links": "bio", "mentions": "strip"}, "bare": {"max_hashtags": 0, "limit": 60}}}'


def captions(s, d):
    """Documents with handles, tags and links around them, by id."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    head = F.element_at(F.array(*[F.lit(x) for x in ("#fun @me.x\n", "See https://x.io/a?b now. ", "@team ", "Dr. ", "")]), (F.pmod("doc_id", F.lit(5)) + 1).cast("int"))
    tail = F.element_at(F.array(*[F.lit(x) for x in (" #one #two #three #four", "\n\nhttps://b.c/d #end", "", " e.g. this vs. that #x")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(head, F.coalesce("text", F.lit("")), tail).alias("text"))


def network_rules(s, d):
    return networks.rules(s.createDataFrame([("rules.json", RULES)], "file string, value string"), ["plain", "short", "bio", "bare"])


def _used_tape(s, d):
    """Sessions of events as clips: of odd users as segments of one clip, of even ones as a span with a hole each."""
    from .queries import _tape

    own = _tape(s, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("start"), F.col("e").alias("end")))).alias("segments"))
    hole = F.array(F.array(F.get("segments", F.lit(0))["start"] + 60.0, F.get("segments", F.lit(0))["start"] + 120.0))
    span = F.struct(F.get("segments", F.lit(0))["start"].alias("start"), F.element_at("segments", -1)["end"].alias("end"), hole.alias("internal_cuts"))
    value = F.when(F.col("id") % 2 == 1, F.to_json(F.struct(F.array(F.struct("segments")).alias("clips")))).otherwise(F.concat(F.lit('{"built": {"k'), F.col("id").cast("string"), F.lit('": '), F.to_json(span), F.lit("}}")))
    found = cutlists.clips(own.select(F.col("id").alias("file"), value.alias("value")))
    tape = cutlists.used_tape(found).groupBy("id").agg(F.round(F.sum(F.col("e") - F.col("s")), 3).alias("seconds"), F.count("*").alias("n"))
    return found.join(tape.select("id.file", "id.ord", "seconds", "n"), ["file", "ord"]).select("file", "name", "shape", "n", "seconds")


def spoken_files(s, d):
    """A conversation as an SRT file: a turn a cue, one second for each character, its white space single."""
    from .queries import _cues

    own = _cues(s, d).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("end > start and text <> ''")
    return transcripts.to_srt(own.select("rec", "cue", "start", "end", "text"))


def suspects(s, d):
    """Each tenth word of a recording and the one after it were misheard."""
    found = blocks.words(blocks.headed(spoken_files(s, d)))
    return found.where("pos % 10 = 4").select("rec", "pos", F.lit(2).alias("n"), F.lit("meant").alias("probably"))


_SPOKEN = r"""WITH q AS (SELECT conv_id AS rec, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, length(text) AS n, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS e FROM conversations),
k AS (SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY turn) - 1 AS cue, e - n AS s, e, text FROM q WHERE n > 0 AND text <> '')"""
QUERIES = {
    "s5_forgiving_cues": (lambda s, d: blocks.forgiving(spoken_files(s, d)), _SPOKEN + """ SELECT rec, cue, s AS start, e AS "end", text FROM k"""),
    "s7_shifted_cues": (lambda s, d: blocks.shifted(spoken_files(s, d), 12.5), _SPOKEN + """ SELECT rec, cue, s + 12.5e0 AS start, e + 12.5e0 AS "end", text FROM k"""),
    "s8_strict_cues": (lambda s, d: blocks.strict(spoken_files(s, d)), _SPOKEN + """ SELECT rec, cue, s AS start, e AS "end", text FROM k"""),
    "s6_headed_cues": (
        lambda s, d: blocks.headed(spoken_files(s, d)).select("rec", "cue", "start", F.substring_index("head", "\n", 1).cast("int").alias("number"), "text"),
        _SPOKEN + " SELECT rec, cue, s AS start, CAST(cue + 1 AS INT) AS number, text FROM k",
    ),
    "g9_corrected_cues": (lambda s, d: blocks.corrected(blocks.headed(spoken_files(s, d)), suspects(s, d)).select("rec", "cue", "text"), None),
    "s9_cards": (
        lambda s, d: cutlists.cards(card_files(s, d)),
        CARDS_SQL + """ SELECT doc_id AS file, CAST(1 AS INT) AS ord, CAST(card AS INT) AS card, text, (card - 1) * 2e0 AS start, (card - 1) * 2e0 + 1.5e0 AS "end" FROM c WHERE doc_id % 6 < 5
        UNION ALL SELECT doc_id, 2, 1, text, 0e0, 1.5e0 FROM c WHERE doc_id % 6 = 2 AND card = 1""",
    ),
    "h10_pieces": (
        lambda s, d: cutlists.pieces(card_files(s, d)),
        CARDS_SQL + """, f AS (SELECT doc_id, doc_id % 6 AS k, sents[1] AS hook, len(sents) AS n FROM s WHERE len(sents) > 0)
        SELECT doc_id AS file, CAST(1 AS INT) AS ord, CASE WHEN k < 3 THEN concat('doc ', doc_id) ELSE 'piece 1' END AS name, CASE WHEN k = 0 THEN 9e0 END AS duration, CASE WHEN k < 3 THEN hook END AS hook, CASE WHEN k = 0 THEN 'source' END AS times, CAST(n AS INT) AS n_cards FROM f WHERE k < 5
        UNION ALL SELECT doc_id, 2, 'piece 2', NULL, NULL, NULL, 1 FROM f WHERE k = 2""",
    ),
    "g11_faults": (
        lambda s, d: cutlists.faults(card_files(s, d), 9.0),
        CARDS_SQL + """ SELECT doc_id AS file, CAST(NULL AS INT) AS ord, CAST(NULL AS INT) AS part, 'file is no readable JSON' AS fault, true AS fatal FROM s WHERE doc_id % 6 = 5 AND len(sents) > 0
        UNION ALL SELECT doc_id, 1, 1, 'segment ends behind the end of the source, clamped', false FROM s WHERE doc_id % 6 = 0 AND len(sents) > 0""",
    ),
    "h8_cards_on_clip": (
        lambda s, d: cutlists.on_clip(cutlists.cards(card_files(s, d)), cutlists.segments(card_files(s, d))).where("pmod(file, 6) = 0").drop("ord"),
        CARDS_SQL + """ SELECT doc_id AS file, CAST(card AS INT) AS card, text, CASE WHEN t >= 3.98 AND t < 10.02 THEN t - 4 WHEN t < 3.02 THEN t + 6 ELSE t END AS start,
            CASE WHEN t >= 3.98 AND t < 10.02 THEN least(t + 1.5e0, 10) - 4 WHEN t < 3.02 THEN least(t + 1.5e0, 3) + 6 ELSE t + 1.5e0 END AS "end", t >= 10.02 AS dropped
        FROM (SELECT *, (card - 1) * 2e0 AS t FROM c WHERE doc_id % 6 = 0)""",
    ),
    "s11_used_tape": (_used_tape, None),
    "s17_harvest": (
        _harvested,
        """SELECT conv_id AS file, CASE WHEN turn % 2 = 0 THEN 'long' ELSE 'short' END AS format, CASE WHEN turn % 2 = 0 THEN text[1:20] || '!' ELSE text[1:20] END AS title,
            CAST(CASE WHEN turn % 2 = 0 THEN length(text) ELSE 1200000 END AS BIGINT) AS views, CAST(CASE WHEN turn % 2 = 0 THEN turn * 60 + 5 END AS DOUBLE) AS duration_s, concat(conv_id, '-', turn) AS id FROM conversations""",
    ),
    "s26_layers": (
        lambda s, d: trees.merged(_setting_layers(s, d)).select("id", F.array_join("path", ".").alias("path"), "leaf", "layer"),
        """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 3 AS k, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS size, '"' || o_orderstatus || '"' AS face, o_orderpriority[1:1] AS w FROM orders)
        SELECT id, path, leaf, CAST(layer AS INT) AS layer FROM (
            SELECT id, unnest(CASE k
                WHEN 0 THEN [{'path': 'look.size', 'leaf': size, 'layer': 2}, {'path': 'look.font.face', 'leaf': face, 'layer': 2}, {'path': 'look.font.weight', 'leaf': w, 'layer': 1}, {'path': 'tags', 'leaf': '["x", "y"]', 'layer': 0}, {'path': 'depth.a.b.c', 'leaf': '1', 'layer': 0}, {'path': 'depth.a.b.d', 'leaf': '1', 'layer': 0}]
                WHEN 1 THEN [{'path': 'look', 'leaf': '"plain"', 'layer': 2}, {'path': 'tags', 'leaf': '["a"]', 'layer': 2}, {'path': 'depth.a.b.c', 'leaf': '1', 'layer': 0}, {'path': 'depth.a.b.d', 'leaf': '1', 'layer': 0}]
                ELSE [{'path': 'look.size', 'leaf': '10', 'layer': 0}, {'path': 'look.font.face', 'leaf': '"X"', 'layer': 0}, {'path': 'look.font.weight', 'leaf': w, 'layer': 1}, {'path': 'tags', 'leaf': '["x", "y"]', 'layer': 0}, {'path': 'depth.a.b.c', 'leaf': '2', 'layer': 2}, {'path': 'depth.a.b.d', 'leaf': '1', 'layer': 0}] END, recursive := true) FROM o)""",
    ),
    "f16_adapted": (lambda s, d: networks.adapt(captions(s, d), network_rules(s, d)).select("id", "network", "text", F.array_join("notes", "; ").alias("notes")), None),
}


def queries() -> dict:
    return {name: q for name, (q, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
