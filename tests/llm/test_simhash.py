import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import simhash


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=3):
    """The least id that each id reaches; rows without an id link others too."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j, q in enumerate(prints[:i]):
            if (p ^ q).bit_count() <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return {d: least[root(i)] for i, d in enumerate(ids) if d is not None}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbZ é \u0085\n\t\x1c.", max_size=60))
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_anchors_lose_no_near_pair():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    y = x.copy()
    for i in range(300):
        for b in rng.choice(64, 3, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    ax, kx, hx = simhash.anchors(x)
    ay, ky, _ = simhash.anchors(y)
    members = {(i, k) for i, k in zip(ay, ky)}
    assert {i for i, k, h in zip(ax, kx, hx) if h and (i, k) in members} == set(range(300))
    assert len(ax) <= 32 * 300


@pytest.mark.parametrize("cell", [4096, 8])
def test_components_match_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    base = [" ".join(rng.choice("the of and rill fan delta scree talus moraine".split()) + str(rng.randrange(30)) for _ in range(120)) for _ in range(12)]
    rows = []
    for k in range(180):
        words = base[rng.randrange(12)].split()
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = "edit%d" % rng.randrange(99)
        rows.append((k, " ".join(words)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "one"), (504, "One"), (None, base[0]), (5, rows[5][1]), (505, "x " * 30000)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in got) == sorted((i or -1, f"{p:016x}") for (i, _), p in zip(rows, prints))
    expected = plain_components([i for i, _ in rows], prints)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == expected
    assert len(set(expected.values())) < 150
    of_null = next(r for r in got if r.doc_id is None)
    assert of_null.component_id == expected[next(i for (i, _), p in zip(rows, prints) if p == plain_fingerprint(base[0]) and i is not None)]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chain_is_one_component(spark):
    from rillwork.llm.components import connected_components

    links = spark.range(1, 400).selectExpr("id as a", "id - 1 as b")
    got = connected_components(links).collect()
    assert len(got) == 400 and {r.component for r in got} == {0}


def test_rows_without_an_id_link_others(spark, monkeypatch):
    prints = [(1, 0), (None, 7), (3, 63), (None, 0xFFFF << 40)]
    rows = spark.createDataFrame(prints, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: rows)
    got = sorted(((r.fingerprint, r.doc_id, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    assert got == [(f"{fp:016x}", d, c) for (d, fp), c in zip(prints, (1, 1, 1, None), strict=True)]


def test_cells_of_many_homes_keep_a_forest():
    """A cell with over 256 homes: its links connect what brute force connects, and are no more than a forest of each 256 homes."""
    import numpy as np
    import pyarrow as pa

    from rillwork.llm._shared import local_forest

    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 62, 5, dtype=np.uint64)
    fp = np.unique(centres[rng.integers(0, 5, 700)] ^ (np.uint64(1) << rng.integers(0, 62, 700).astype(np.uint64)))
    n = len(fp)
    c = {"anchor": np.zeros(n, int), "cell": np.zeros(n, int), "fp": fp.view(np.int64), "rep": np.arange(n), "home": np.arange(n) % 3 > 0, "member": np.ones(n, bool)}
    got = simhash._compare(3)({k: pa.array(v) for k, v in c.items()})
    a, b = np.nonzero((np.bitwise_count(fp[:, None] ^ fp) <= 3) & c["home"][:, None])
    assert (local_forest(n, np.asarray(got["a"]), np.asarray(got["b"])) == local_forest(n, a, b)).all()
    assert len(got["a"]) < n
