"""Each stage, on its own input, against a brute-force version of its decisions."""

from hashlib import sha256

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline
from rillwork.llm import bpe, quality
from tests.llm.test_jaccard import plain_kept
from tests.llm.test_substrings import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, SF)
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r["__score"] for r in quality.score(docs, *model, ("doc_id",)).collect()}
    assert good.columns == docs.columns
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY}

    rows = docs.collect()
    once = stages["near_dedup"](spark, docs, SF)
    assert once.columns == docs.columns
    assert sorted(r.doc_id for r in once.collect()) == sorted(min(d for d, _ in g) for g in plain_kept([(r.doc_id, r.text) for r in rows]))

    clean = stages["substring_dedup"](spark, docs, SF)
    words = {r.doc_id: len((r.text or "").split()) for r in clean.collect()}
    assert clean.columns == docs.columns
    assert words == {r.doc_id: n - gone for r, (n, gone, _) in zip(rows, plain([r.text for r in rows], 35), strict=True)}

    mixed = stages["mixing"](spark, docs, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == {r.doc_id for r in rows}

    theirs = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    expected = []
    for r in rows:
        ids = theirs.encode_ordinary(r.text or "")
        expected.append((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, stages["bpe"](spark, docs, SF).collect())) == sorted(expected)


def test_edge_rows(spark):
    rows = [(None, None, None, None, None, 1), (None, "", "en", "s", 0, 1), (4, "a b", "en", "s", 3, 1), (4, "a b", "en", "s", 3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `__copies` int")
    docs = docs.withColumnRenamed("__copies", "component_id")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            assert stage(spark, some, SF).columns == docs.columns
            assert stage(spark, some, SF).count() <= 8
