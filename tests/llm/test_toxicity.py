"""The risk, the features, and held-out accuracy."""

import numpy as np
import pytest

from rillwork.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_features_against_a_plain_version():
    texts = ["Aa aa aaa aab abcde", None, "", "x " * 500 + "abcdefg abcdefh", "abcdefg abcdefh"]
    row, feature = toxicity.feature_sets(texts)
    expected = set()
    for i, t in enumerate(texts):
        words = (t or "").lower().split()
        for n in (0, *toxicity.PREFIXES):
            heads = [w for w in words if len(w) >= n]
            for w in set(heads):
                h = int(toxicity._hashes([w], n)[0])
                count = sum(v[:n] == w[:n] for v in heads)
                expected |= {(i, h)} | ({(i, h | 1)} if n and count >= 2 and count * toxicity.DENSE >= len(words) else set())
    assert set(zip(row.tolist(), feature.tolist(), strict=True)) == expected and len(row) == len(expected)
    some = np.unique(feature)[::3]
    r, f = toxicity.feature_sets(texts, some)
    assert sorted(zip(r.tolist(), f.tolist(), strict=True)) == sorted(p for p in expected if p[1] in set(some.tolist()))


def test_long_texts_come_in_parts(monkeypatch):
    texts = ["one two three four two five " * 9, "six", "one two two"]
    whole = toxicity.feature_sets(texts)
    monkeypatch.setattr(toxicity, "CHUNK", 4)
    parts = toxicity.feature_sets(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_gradients_are_the_risks_slopes(shift):
    rng = np.random.default_rng(1)
    p, u, prior, e = rng.normal(shift, 1, 5), rng.normal(-3 * shift, 1, 7), 0.4, 1e-6
    part = lambda p, u: np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
    risk, gp, gu = toxicity.risk_step(p, u, prior)
    below = part(p, u) < 0
    assert below == (shift > 0) and risk >= 0
    goal = (lambda p, u: -part(p, u)) if below else (lambda p, u: toxicity.risk_step(p, u, prior)[0])
    for k in range(5):
        assert abs((goal(p + e * (np.arange(5) == k), u) - goal(p, u)) / e - gp[k]) < 1e-4
    for k in range(7):
        assert abs((goal(p, u + e * (np.arange(7) == k)) - goal(p, u)) / e - gu[k]) < 1e-4


def test_held_out_accuracy(spark):
    rows = toxicity.op11_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out and toxic is not null").collect()
    s, y = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    above = (s[y == 1][:, None] > s[y == 0][None, :]).mean() + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :]).mean()
    predicted = np.array([r.predicted for r in rows])
    assert above > 0.94 and predicted[y == 1].mean() > 0.85 and predicted[y == 0].mean() < 0.01


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert np.array_equal(a.features, b.features) and np.array_equal(a.weights, b.weights) and np.array_equal(a.bias, b.bias)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, "you clown", "en", 0.5), (1, "you clown", "en", 0.5), (2, None, None, None), (None, "", "en", 1.0), (3, "calm " * 100000, "de", 0.0), (4, "clown", "x", 1.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0), labels.where("toxic = 0")):
        out = toxicity.score(docs, toxicity.fit(docs, lab), ("doc_id", "score")).collect()
        assert len(out) == 6 and all(0 <= r["__score"] <= 1 for r in out)
        same = [r["__score"] for r in out if r.doc_id == 1]
        assert same[0] == same[1]
        if lab is not labels:
            assert all(r["__score"] < 1e-9 for r in out)
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels), ("doc_id",)).count() == 0
