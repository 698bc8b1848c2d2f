"""JSON of unknown depth: nodes under a key wherever they lie, and layers of settings merged from the ground up.

A small Python function walks one text at a time, without recursion; all else is joins and windows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: The places of result blocks, long and short.
LONG, SHORT = "videoRenderer", ["reelItemRenderer", "shortsLockupViewModel"]
BLOB = r"(?s)var ytInitialData\s*=\s*(\{.*?\});</script>"
BLOB_OTHER = r"(?s)window\[\"ytInitialData\"\]\s*=\s*(\{.*?\});"


def nodes(files: DataFrame, keys: list[str]) -> DataFrame:
    """file, value (JSON) -> file, ord, key, node: what lies under one of `keys` at any depth, in the order of the text.

    A node inside a node counts too. A text that is no JSON gives none.
    """
    kind = dict(files.dtypes)["file"]

    def found(text):
        try:
            waiting = [json.loads(text)]
        except (TypeError, ValueError):
            return
        while waiting:  # the last one waiting comes first in the text
            node = waiting.pop()
            if isinstance(node, dict):
                yield from ((k, node[k]) for k in keys if k in node)
                waiting += reversed(list(node.values()))
            elif isinstance(node, list):
                waiting += reversed(node)

    def run(frames):
        for pdf in frames:
            rows = [(f, i, k, json.dumps(n)) for f, v in zip(pdf["file"], pdf["value"], strict=True) for i, (k, n) in enumerate(found(v), 1)]
            yield type(pdf)(rows, columns=["file", "ord", "key", "node"])

    return files.select("file", "value").mapInPandas(run, f"file {kind}, ord int, key string, node string")


def embedded(html: Column) -> Column:
    """The JSON that a page of results carries; null where it has none."""
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in (BLOB, BLOB_OTHER)])


def results(found: DataFrame) -> DataFrame:
    """nodes() of the result blocks -> file, ord, format, title, channel, views, duration, duration_s, age, id, each id (or title) once in a file."""
    v = F.try_parse_json("node")
    at = lambda *paths: F.coalesce(*[F.nullif(F.try_variant_get(F.col("v"), f"$.{p}", "string"), F.lit("")) for p in paths])
    runs = lambda path: F.nullif(F.array_join(F.transform(F.try_variant_get(F.col("v"), f"$.{path}", "array<variant>"), lambda r: F.coalesce(F.try_variant_get(r, "$.text", "string"), F.lit(""))), ""), F.lit(""))
    long = F.col("key") == LONG
    reel = F.col("key") == SHORT[0]
    title = F.when(long, F.coalesce(runs("title.runs"), F.lit(""))).when(reel, at("headline.simpleText")).otherwise(at("overlayMetadata.primaryText.content"))
    shown = F.when(long, F.coalesce(at("viewCountText.simpleText"), runs("viewCountText.runs"))).when(reel, at("viewCountText.simpleText")).otherwise(at("overlayMetadata.secondaryText.content"))
    own = F.when(long | reel, at("videoId")).otherwise(at("onTap.innertubeCommand.reelWatchEndpoint.videoId"))
    length = F.when(long, at("lengthText.simpleText"))
    rows = found.withColumn("v", v).select(
        "file", "ord", F.when(long, "long").otherwise("short").alias("format"), title.alias("title"), F.when(long, at("ownerText.runs[0].text")).alias("channel"), X.views(shown).alias("views"),
        length.alias("duration"), X.seconds(length).alias("duration_s"), F.when(long, at("publishedTimeText.simpleText")).alias("age"), own.alias("id"),
    )
    once = F.coalesce(F.nullif("id", F.lit("")), F.nullif("title", F.lit("")))
    first = F.row_number().over(Window.partitionBy("file", "once").orderBy("ord"))
    return rows.withColumn("once", once).where("once is not null").withColumn("r", first).where("r = 1").drop("r", "once")


def leaves(layers: DataFrame) -> DataFrame:
    """id, layer, value (a JSON object) -> id, layer, path (array), leaf (JSON; null for an object itself).

    Lists are leaves, nulls say nothing. A text that is no JSON object gives no rows.
    """
    kinds = dict(layers.dtypes)

    def found(text):
        try:
            waiting = [((), json.loads(text))]
        except (TypeError, ValueError):
            return
        while waiting:
            path, node = waiting.pop()
            if isinstance(node, dict):
                if path:
                    yield list(path), None
                waiting += [((*path, str(k)), x) for k, x in node.items() if x is not None]
            elif path:
                yield list(path), json.dumps(node)

    def run(frames):
        for pdf in frames:
            rows = [(i, n, p, x) for i, n, v in zip(pdf["id"], pdf["layer"], pdf["value"], strict=True) for p, x in found(v)]
            yield type(pdf)(rows, columns=["id", "layer", "path", "leaf"])

    return layers.select("id", "layer", "value").mapInPandas(run, f"id {kinds['id']}, layer {kinds['layer']}, path array<string>, leaf string")


def merged(layers: DataFrame) -> DataFrame:
    """id, path (array), leaf, layer: of any number of layers the settings that hold, higher layers first, at any depth.

    An object is merged key by key; a list or a single value in a higher layer replaces what lies below its place,
    and an object there replaces a single value. layers: id, layer (a number; the highest wins), value (JSON).
    """
    own = leaves(layers)
    # a leaf is looked at from every place on its way, an object from its own place
    way = F.when(F.col("leaf").isNull(), F.array("path")).otherwise(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.slice("path", 1, k)))
    seen = own.withColumn("at", F.explode(way)).withColumn("here", F.size("at") == F.size("path"))
    # the highest layer that puts something at a place, and the highest that puts no object there
    place = Window.partitionBy("id", "at")
    met = seen.withColumns({"any": F.max(F.when(F.col("here"), F.col("layer"))).over(place), "plain": F.max(F.when(F.col("here") & F.col("leaf").isNotNull(), F.col("layer"))).over(place)})
    over = F.when(F.col("here"), F.col("any") > F.col("layer")).otherwise(F.coalesce(F.col("plain") > F.col("layer"), F.lit(False)))
    return met.where("leaf is not null").groupBy("id", "path", "layer").agg(F.max("leaf").alias("leaf"), F.bool_or(over).alias("hidden")).where("not hidden").select("id", "path", "leaf", "layer")


def table(settings: DataFrame, columns: dict[str, str]) -> DataFrame:
    """merged() as one row for each id: a column for each dotted path of `columns`, of the kind named."""
    value = lambda kind: F.try_variant_get(F.try_parse_json("leaf"), "$", kind)
    dotted = F.array_join("path", ".")
    return settings.groupBy("id").agg(*[F.max(F.when(dotted == p, value(kind))).alias(p.replace(".", "_")) for p, kind in columns.items()])
