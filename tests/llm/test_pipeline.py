"""The stages one after the other on the smallest tables, each against what it says it does."""

import corpus_pipeline as pipeline
from bookflow.llm import queries


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    own, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, step in pipeline.STAGES[:-1]:
        path = queries.folder(spark, f"test-{name}")
        step(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == own and after.keys() <= before.keys() and len(after) > 0.5 * len(before)
        if name == "substrings":
            assert all(len(after[i]) <= len(before[i]) for i in after)
        else:
            assert all(after[i] == before[i] for i in after)
        before = after
    out = pipeline.to_tokens(spark, docs, sf)
    assert {r.doc_id for r in out.collect()} == before.keys() and out.where("not round_trip").count() == 0
    assert pipeline.run(spark, sf).count() == len(before)
