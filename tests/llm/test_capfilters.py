import numpy as np
import pytest

from rillwork.llm import capfilters


def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 64))
    out = []
    for k in range(700):
        v = base[rng.integers(60)] if rng.random() < 0.8 else rng.normal(size=64)
        v = v + rng.normal(size=64) * rng.choice([0, 0.1, 0.25, 0.38])
        out.append((k, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(k % 3)))
    out += [(800, out[0][1], out[0][2])] * 1 + [(801, out[0][1], 9)] + [(900 + i, out[1][1], out[1][2]) for i in range(150)]
    bad = [(1, None, 0), (2, [0.0] * 64, 0), (3, [float("nan")] + [1.0] * 63, 0), (4, [float("inf")] + [1.0] * 63, 0), (5, [None] + [1.0] * 63, 0), (6, [1.0] * 3, 0), (7, out[0][1], None)]
    return out, [(2000 + i, e, x) for i, e, x in bad] + [(None, out[0][1], 0)]


@pytest.mark.parametrize("cell", [2048, 40])
def test_links_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(capfilters, "CELL", cell)
    good, bad = rows()
    data = spark.createDataFrame([(*r, 1) for r in good + bad], "vec_id long, embedding array<float>, label int, n_links int")
    got = {r.vec_id: r for r in capfilters.embedding_duplicates(data).collect()}
    assert len(got) == len(good) + len(bad)
    x = capfilters.unit_vectors(np.array([e for _, e, _ in good]))
    label = np.array([k for _, _, k in good])
    link = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    mine = np.array([got[i].n_links for i, _, _ in good])
    assert (mine <= link.sum(axis=1)).all()
    assert mine.sum() >= 0.97 * link.sum() > 0
    for i, e, k in good:
        c = got[i].component_id
        assert c <= i and got[i].kept == (c == i) and got[c].component_id == c
    assert got[800].component_id == got[0].component_id and got[801].n_links == 0
    for i, _, _ in bad:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept == (i is not None)


def test_list_decoding_is_complete():
    x = capfilters.unit_vectors(np.random.default_rng(2).normal(size=(20, 64)))
    size, alpha = 64, capfilters.threshold_for(64, 64, 0.93)
    row, f = capfilters.list_decode(x)
    for t, (rotation, codes) in enumerate(capfilters.product_codes(64, size)):
        direction = np.concatenate([np.repeat(codes[0], size, 0), np.tile(codes[1], (size, 1))], axis=1) / np.sqrt(2)
        expected = set(zip(*(v.tolist() for v in np.nonzero(x @ rotation @ direction.T >= alpha)), strict=True))
        assert {(r, g - t * size**2) for r, g in zip(row.tolist(), f.tolist(), strict=True) if g // size**2 == t} == expected


@pytest.mark.parametrize(("dim", "size"), [(2, 64), (7, 64), (32, 64), (64, 64), (64, 128), (256, 64)])
def test_recall_of_pairs_just_at_the_threshold(dim, size):
    """Pairs at a cosine of 0.93 exactly, the hardest to find: at least 0.97 of them share a filter."""
    rng = np.random.default_rng(dim)
    x = capfilters.unit_vectors(rng.normal(size=(1000, dim)))
    across = rng.normal(size=x.shape)
    across = capfilters.unit_vectors(across - (across * x).sum(axis=1, keepdims=True) * x)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * across
    lists = []
    for v in (x, y):
        row, f = capfilters.list_decode(capfilters.padded(v), size)
        lists.append(set(zip(row.tolist(), f.tolist(), strict=True)))
        assert len(row) < 120 * len(x)
    assert len({r for r, _ in lists[0] & lists[1]}) >= 0.97 * len(x)


def test_dimensions_come_from_the_data(spark):
    rows = [(1, [0.5] * 32, 1), (2, [1.0] * 32, 1), (3, [1.0] * 33, 1), (4, [2.0] * 33, 1), (5, [1.0], 1), (6, [-1.0], 1), (7, [3.0], 1), (8, [], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (0, 6), 7: (1, 5), 8: (0, 8)}


def test_more_rows_take_more_codes():
    assert [capfilters.codes_for(n) for n in (0, 1 << 16, (1 << 16) + 1, 1 << 20)] == [64, 64, 128, 256]


def test_empty_table(spark):
    assert capfilters.embedding_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
