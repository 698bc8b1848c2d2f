"""Each stage against what it should do to the documents that it got."""

import corpus_pipeline
from cuewright.llm import langid
from tests.llm.test_brute import base_numbers, grouped


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        ids = [r["doc_id"] for r in after]
        if k < 4:
            assert docs.columns == columns and len(ids) == len(set(ids)) and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "language":
            assert all(langid.has_letter(r["text"]) for r in after) and len(after) >= 0.9 * sum(langid.has_letter(r["text"]) for r in before)
        if name == "rules":
            base = [base_numbers(r["text"]) for r in after]
            assert all(b[0] >= 50 and 100 * b[4] <= 50 * b[0] for b in base)
            sound = [b for b in (base_numbers(r["text"]) for r in before) if b[0] >= 50 and 100 * b[4] <= 50 * b[0]]
            assert len(after) >= 0.95 * len(sound)
        if name == "deduplicate":
            assert sorted(ids) == sorted(d for d, (_, c) in grouped([(r["doc_id"], r["text"]) for r in before]).items() if c == d)
        if name == "mix":
            assert sorted(ids) == sorted(r["doc_id"] for r in before)
        if name == "pack":
            assert set(ids) == {r["doc_id"] for r in before}
