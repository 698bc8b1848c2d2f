"""Sparse text vectors: idf, cosine, containment; blocked fuzzy spelling.

Terms: (id, term, n). Pair similarities come from an equi-join on the term; no term is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def idf(terms: DataFrame) -> DataFrame:
    """term, df, idf = ln(1 + ids / df)."""
    ids = terms.agg(F.count_distinct("id").alias("ids"))
    return terms.groupBy("term").agg(F.count_distinct("id").alias("df")).join(F.broadcast(ids)).select("term", "df", F.log(1 + F.col("ids") / F.col("df")).alias("idf"))


def vectors(terms: DataFrame) -> DataFrame:
    """id, term, v = (1 + ln n) * idf, with norm2 and size of its id's vector."""
    v = terms.join(idf(terms), "term").select("id", "term", ((1 + F.log("n")) * F.col("idf")).alias("v"))
    return v.join(v.groupBy("id").agg(F.sum(F.col("v") * F.col("v")).alias("norm2"), F.count("*").alias("size")), "id")


def pairs(terms: DataFrame) -> DataFrame:
    """id_a < id_b with cosine, shared terms, dominance and containment (dot over the smaller's norm2,
    which may exceed 1; smaller means fewer terms, the first on a tie)."""
    a, b = (vectors(terms).select(F.col("id").alias(f"id_{x}"), "term", *[F.col(c).alias(f"{c}_{x}") for c in ("v", "norm2", "size")]) for x in "ab")
    part = F.col("v_a") * F.col("v_b")
    both = a.join(b, "term").where("id_a < id_b").groupBy("id_a", "id_b").agg(
        F.sum(part).alias("dot"), F.count("*").alias("shared"), F.max(part).alias("top"), F.first("norm2_a").alias("na"), F.first("norm2_b").alias("nb"), F.first("size_a").alias("sa"), F.first("size_b").alias("sb"))
    return both.select("id_a", "id_b", "shared", (F.col("dot") / F.sqrt(F.col("na") * F.col("nb"))).alias("cosine"), (F.col("top") / F.col("dot")).alias("dominance"), (F.col("dot") / F.when(F.col("sa") <= F.col("sb"), F.col("na")).otherwise(F.col("nb"))).alias("containment"))


def misheard(words: DataFrame, least: int = 8, ratio: float = 0.85, slack: int = 4, gain: float = 0.15) -> DataFrame:
    """Runs of 2 to 4 words of a recording that join to almost a long word it uses at least twice.

    rec, pos (from 1, gapless), word -> rec, pos, n, heard, probably, ratio. The join must do better than the best of
    its words by `gain`; of finds that share words the one of the higher ratio stays, then the earlier. The
    last start of each length is not looked at. Blocked by recording and by the joined length; the sequence
    ratio itself is a vectorised function over the blocked pairs.
    """
    low = words.select("rec", "pos", F.lower("word").alias("word"))
    known = low.groupBy("rec", F.col("word").alias("probably")).agg(F.count("*").alias("uses")).where((F.length("probably") >= least) & (F.col("uses") >= 2))
    w = Window.partitionBy("rec").orderBy("pos")
    ahead = [f"w{k}" for k in range(1, 5)]
    wide = low.withColumns({c: F.lead("word", k).over(w) for k, c in enumerate(ahead, 1)})
    run = lambda k: F.when(F.col(ahead[k]).isNotNull(), F.struct(F.lit(k + 1).alias("n"), F.array("word", *ahead[:k]).alias("parts")))
    spans = wide.select("rec", "pos", F.explode(F.array_compact(F.array(*[run(k) for k in (1, 2, 3)]))).alias("x")).select("rec", "pos", "x.*")
    spans = spans.withColumn("joined", F.array_join("parts", "")).where(F.length("joined") >= least)
    near = spans.join(known, "rec").where((F.abs(F.length("joined") - F.length("probably")) <= slack) & (F.col("joined") != F.col("probably")))

    @F.pandas_udf("double")
    def measure(a, b):
        import difflib

        import pandas as pd

        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    @F.pandas_udf("double")
    def best_single(parts, b):
        import difflib

        import pandas as pd

        return pd.Series([max(difflib.SequenceMatcher(None, x, y).ratio() for x in p) for p, y in zip(parts, b, strict=True)])

    def apart(pdf):
        kept = []
        for f in pdf.sort_values(["ratio", "pos", "n", "probably"], ascending=[False, True, True, True]).itertuples():
            if all(f.pos >= k.pos + k.n or k.pos >= f.pos + f.n for k in kept):
                kept.append(f)
        return pdf.loc[[k.Index for k in kept]]

    close = near.withColumn("ratio", measure("joined", "probably")).where(F.col("ratio") >= ratio)
    found = close.withColumn("single", best_single("parts", "probably")).where(F.col("ratio") > F.col("single") + gain)
    rounded = found.select("rec", "pos", "n", F.array_join("parts", " ").alias("heard"), "probably", F.round("ratio", 3).alias("ratio"))
    return rounded.groupBy("rec").applyInPandas(apart, rounded.schema)
