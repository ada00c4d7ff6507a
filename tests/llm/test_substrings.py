import hashlib
import random
import re
from collections import Counter

import pytest

from rillwork.llm import substrings


def plain(texts, length):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - length + 1) if counts[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def corpus():
    rng = random.Random(7)
    word = lambda: rng.choice("a b c the of".split()) if rng.random() < 0.4 else f"w{rng.randrange(500)}"
    passages = [[word() for _ in range(rng.choice([36, 50, 90]))] for _ in range(8)]
    texts = []
    for _ in range(120):
        w = [word() for _ in range(rng.randrange(0, 200))]
        if rng.random() < 0.6:
            p = rng.choice(passages)
            p = p[rng.randrange(0, 10) :]
            at = rng.randrange(len(w) + 1)
            w = w[:at] + p + w[at:]
        texts.append(rng.choice([" ", "\n"]).join(w))
    texts += [texts[3], texts[3], None, "", "z " * 300, "p q " * 80, "é b " * 20, " ".join(f"u{i}" for i in range(30000))]
    return texts


@pytest.mark.parametrize(("group", "piece"), [(2048, 1 << 20), (2, 64)])
def test_removal_matches_brute_force(spark, monkeypatch, group, piece):
    monkeypatch.setattr(substrings, "GROUP", group)
    monkeypatch.setattr(substrings, "PIECE", piece)
    texts = corpus()
    rows = [(i if i % 9 else None, t, 1) for i, t in enumerate(texts)]
    rows += [rows[10]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h int")
    got = substrings.remove_repeats(docs).collect()
    mine = Counter((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got)
    assert mine == Counter((i, *x) for (i, _, _), x in zip(rows, plain([t for _, t, _ in rows], 35), strict=True))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_nodes_are_the_repeated_windows():
    assert sorted(substrings.repeated_windows([b"a b c a b c d", b"x b c d"], [range(5), range(2)], 3)) == [(0, 0), (0, 3), (0, 4), (1, 1)]


def test_hot_anchors_go_by_longer_prefixes(spark, monkeypatch):
    """One passage in many contexts, windows that share 14, 21 or 28 words, and copies: trees and whole windows alike."""
    monkeypatch.setattr(substrings, "GROUP", 4)
    rng = random.Random(3)
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    stem = [f"s{i}" for i in range(60)]
    texts = []
    for shared in (8, 14, 20, 21, 28, 34, 35, 36, 50, 60):
        tails = [new(30) for _ in range(2)]
        texts += [" ".join(new(3) + stem[:shared] + rng.choice([*tails, new(30)])) for _ in range(7)]
    texts += [texts[5]] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(docs).collect()}
    assert got == dict(enumerate(plain(texts, 35)))
    assert substrings.prefix_lengths(35) == [14, 21, 28, 35] and substrings.prefix_lengths(10) == [10]


def test_short_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP", 2)
    texts = corpus()[:60]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in substrings.remove_repeats(docs, 9).collect()}
    assert got == dict(enumerate(plain(texts, 9)))
