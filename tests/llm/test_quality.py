import numpy as np
import pytest

from rillwork.llm import quality
from rillwork.llm._shared import read_table


def test_word_table_is_the_sum_of_neighbours(spark):
    texts = ["the river runs", "the fan", None, "", "a"]
    table = quality.word_table(spark.createDataFrame([(t, 1) for t in texts], "text string, block int").repartition(3))
    place, sign = quality.index_vectors()
    total = np.zeros((quality.BUCKETS, quality.DIM))
    for _, tokens, sizes in quality._chunks(texts):
        for row in np.split(tokens, np.cumsum(sizes)[:-1]):
            for i, a in enumerate(row):
                for j, b in enumerate(row):
                    if i != j and abs(i - j) <= quality.WINDOW:
                        np.add.at(total[a], place[b], sign[b])
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(table, total / np.where(norm > 0, norm, 1), atol=1e-6)


def test_pooled_is_the_mean(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 3)
    table = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float32)
    texts = ["one two", "", "two two two one", None, "x" * 5]
    got = quality.pooled(texts, table)
    for t, v in zip(texts, got, strict=True):
        rows = [next(quality._chunks([w]))[1][0] for w in quality.TOKEN.findall(t or "")]
        assert np.allclose(v, table[rows].mean(axis=0) if rows else 0, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, quality.DIM))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    net = quality.train(x, y, epochs=30)
    p = net.score(rng.normal(size=(1, quality.DIM)))
    assert 0 < p[0] < 1 and net.temperature > 1
    assert abs(net.score(x).mean() - y.mean()) < 0.05


def test_held_out_accuracy(spark):
    """Labels whose remainder is 2 are never fitted on; they must be told apart well."""
    d = "/root/testdata/sf0.1"
    got = quality.op1_quality(spark, d).where("held_out").join(read_table(spark, d, "labels").select("doc_id", "quality"), "doc_id").toPandas()
    good, poor = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    auc = (good[:, None] > poor[None, :]).mean()
    print("held-out AUC", auc, "kept", (good >= 0.5).mean(), "rejected", (poor < 0.5).mean())
    assert auc > 0.95 and (good >= 0.5).mean() > 0.97


@pytest.mark.parametrize("labels", [[], [(1, 1), (1, 0), (2, None), (None, 1), (3, 0)]])
def test_edge_rows(spark, labels):
    docs = spark.createDataFrame([(1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "c " * 50000, "x"), (1, "a b", "x")], "doc_id long, text string, score string")
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = quality.score(docs, *model, ("doc_id", "score")).collect()
    assert len(got) == 5 and all(0 <= r["__score"] <= 1 for r in got)
    assert quality.score(docs.limit(0), *model, ("doc_id",)).count() == 0
    assert quality.word_table(docs.limit(0)).any() == False  # noqa: E712
