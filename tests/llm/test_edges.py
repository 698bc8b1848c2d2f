"""Nulls in any column, empty and very long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from cuewright.llm import ann, common, fertility, langid, licenses, mixing, neardup, packing, quality, sharding, toxicity

LONG = "the river runs past the old mill and the wide field of barley " * 3000
ROWS = [
    (1, "plain words of a small text about rivers and mills", "en", "a", 50, 0.5, 7, "x"),
    (1, "plain words of a small text about rivers and mills", "en", "a", 50, 0.5, 7, "x"),
    (2, None, "en", "a", None, 0.5, 7, "x"),
    (3, "", None, None, 0, None, None, None),
    (4, LONG, "en", None, len(LONG), 0.1, 1, "y"),
    (None, "a text without an id in the table of documents", None, "b", 1, 0.1, 1, "y"),
    (6, " \n\t 12 34 !! ", "de", "b", 9, 0.1, 1, "y"),
    (7, "ein kurzer Text über Mühlen <|endoftext|> und Flüsse", "de", "b", 9, 0.1, 1, "y"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, slot long, labels string"
OPERATORS = {
    "toxicity": lambda d, y: toxicity.score(d, toxicity.train(d, y)),
    "quality": lambda d, y: (lambda s: quality.predict(s, quality.train(s, y)))(common.cut(quality.measure(d))),
    "licenses": lambda d, y: licenses.scan(d, licenses.document_counts(d)),
    "sharding": lambda d, y: sharding.shard(d),
    "fertility": lambda d, y: fertility.judge(common.cut(fertility.measure(d))),
    "mixing": lambda d, y: mixing.mix(d),
    "langid": lambda d, y: langid.identify(d, langid.train(d)),
    "neardup": lambda d, y: neardup.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, None), (None, 1, 1), (4, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = OPERATORS[name](docs, labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in got) == sorted((r[0] is None, r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_packing_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = packing.pack(common.cut(packing.pieces(docs))).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in ROWS}
    assert [r["length"] for r in got if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack(common.cut(packing.pieces(docs.limit(0)))).collect() == []


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (40, None), (9, [-1.0, 0.0]), (None, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, vec array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 9, -1.0)]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, vec array<double>"), F.col("vec_id") % 20 == 0).collect() == []


def test_pipeline_stages_on_edges(spark, tmp_path):
    import corpus_pipeline

    for name, rows in (("edges", ROWS), ("none", [])):
        docs = spark.createDataFrame(rows, SCHEMA)
        for stage, (_, run) in enumerate(corpus_pipeline.STAGES):
            run(spark, docs, str(tmp_path)).write.parquet(path := str(tmp_path / f"{name}{stage}"))
            if stage < 4:
                assert spark.read.parquet(path).columns == docs.columns
