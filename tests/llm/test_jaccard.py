"""The pipeline's near-copy stage against brute-force Jaccard similarity of 5-word shingles."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillwork.llm import jaccard


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The (doc_id, text) of each component with the least doc_id."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return groups.values()


@pytest.mark.parametrize("cell", [512, 8])
def test_stage_equals_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rng = random.Random(3)
    base = [" ".join("w%d" % rng.randrange(3000) for _ in range(rng.choice([30, 100, 400]))) for _ in range(12)]
    rows = []
    for k in range(200):
        words = base[rng.randrange(12)].split()
        for _ in range(rng.choice([0, 1, 2, 3, len(words) // 60, len(words) // 40])):
            words[rng.randrange(len(words))] = "Edit%d" % rng.randrange(99)
        rows.append((k, " ".join(words)))
    rows += [(300, None), (301, ""), (302, "one"), (303, "One"), (304, "a b c d e"), (305, "A b c d\te"), (306, "x " * 9000)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string").repartition(4)
    got = dict(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").select("doc_id", "text").collect())
    groups = plain_kept(rows)
    assert sorted(got) == sorted(min(i for i, _ in g) for g in groups)
    assert 20 < len(groups) < 180


def test_unlike_texts_of_one_id_both_stay(spark):
    one, two = " ".join("a%d" % i for i in range(50)), " ".join("b%d" % i for i in range(50))
    rows = [(7, one), (7, two), (7, two), (3, one + " z"), (9, two + " z"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, one), (3, one + " z"), (7, two)]


def test_candidates_of_similar_sets():
    rng = np.random.default_rng(2)
    for _ in range(2000):
        n = int(rng.integers(9, 200))
        common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = rng.integers(0, 1 << 63, n // 4, dtype=np.uint64)  # similarity of 0.8 or just above
        cut = int(rng.integers(0, len(other) + 1))
        a, b = (jaccard.sketch(np.concatenate([common, x])) for x in (other[:cut], other[cut:]))
        assert (jaccard.band_keys(a[None]) == jaccard.band_keys(b[None])).any()
        assert (a.astype(np.uint8) == b.astype(np.uint8)).sum() >= jaccard.LEAST_AGREEING


def test_candidates_meet_their_keys_once(spark, monkeypatch):
    """Only rows of keys that hold rows unlike their pivot are joined with keys a second time, once for both sides; each pair of such rows meets."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    rng = np.random.default_rng(4)
    one, two, three = (rng.integers(0, 256, jaccard.SLOTS, dtype=np.uint8).tobytes() for _ in range(3))
    rows = [(1, r, one) for r in range(40)] + [(2, r, two if r % 9 else three) for r in range(100, 140)] + [(3, r, one) for r in range(200, 203)]
    candidates = spark.createDataFrame(rows, "key long, rep long, low binary").repartition(5)
    sizes = candidates.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot"))
    links = jaccard._linked(candidates, sizes, "low", jaccard._ties, jaccard._rest_ties, "ties")
    root = {r: r for _, r, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in links.collect():
        root[find(a)] = find(b)
    groups = {}
    for r in root:
        groups.setdefault(find(r), set()).add(r)
    threes = {r for r in range(100, 140) if r % 9 == 0}
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, [set(range(40)), set(range(100, 140)) - threes, threes, {200, 201, 202}]))
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join Inner, \(key#", plan)) == 2  # with keys that have a rest, and of their counts with their sizes
