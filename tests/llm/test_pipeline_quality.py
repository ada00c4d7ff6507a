"""The quality stage against the operator's own verdict."""

import corpus_pipeline
from rillwork.llm import quality

SF = "/root/testdata/sf0.001"


def test_stage_keeps_what_the_operator_predicts(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    scored = docs.selectExpr("doc_id", "text", "0.5 + (doc_id % 5) * 0.1D as __score")
    monkeypatch.setattr(quality, "fit", lambda *a: ())
    monkeypatch.setattr(quality, "score", lambda docs, *a: scored)
    good = {r.doc_id for r in quality.op1_quality(spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["quality"](spark, docs, SF).collect()} == good
