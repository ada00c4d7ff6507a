"""Words, keys and groups against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rillwork.llm import spelling


def counted(docs, every, letters, least):
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    n = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= letters
    return {w: k for w, k in n.items() if k >= least and len(w) >= letters}


def grouped(n):
    near, without, form, out = defaultdict(set), defaultdict(list), {}, []
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            without[i, rest].append(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for some in without.values():
        for w in some:
            near[w].update(x for x in some if x != w)
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_words_and_groups(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abBc\u00e9\u00c9\u00d7") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    rows = [(i if i % 17 else None, " ".join(rng.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=60)), 1) for i in range(300)]
    rows += [(1, None, 0), (2, "", 0), (3, "1 2 !", 0), (3, "1 2 !", 0), (4, ("longword" * 400 + " ") * 6, 0), (4, ("longword" * 399 + "longwrd ") * 40, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    n = counted([r[:2] for r in rows], 7, 6, 5)
    words = spelling.words(docs, every=7)
    assert {r.word: r.n for r in words.collect()} == n
    mine = sorted((tuple(r) for r in spelling.variants(words).collect()), key=str)
    assert mine == grouped(n)
    assert any(r[1] for r in mine) and sum(r[4] for r in mine) > 0


def test_sql_on_odd_rows(spark):
    rng = random.Random(6)
    stems = ["".join(rng.choice("abBc\u00e9\u00c9\u00d7") for _ in range(rng.randint(5, 9))) for _ in range(200)]
    rows = [(i if i % 17 else None, " ".join(rng.choices(stems, [1 / (k + 1) for k in range(len(stems))], k=80))) for i in range(200)] + [(1, None), (2, ""), (3, "1 2 !")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    expected = grouped(counted(rows, 199, 6, 5))
    assert sorted(con.execute(spelling.OP13_SQL).fetchall(), key=str) == expected
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, spelling.variants(spelling.words(docs)).collect()), key=str) == expected


def test_chains_and_ties(spark):
    n = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "bbbbbbb": 7, "bbbbbb": 15625, "aaaaaaa": 1, "zzzzzz": 9}
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(vocabulary).collect()), key=str) == grouped(n)
    assert spelling.variants(vocabulary.limit(0)).count() == 0


def test_equal_hashes_link_nothing():
    """With one key for all rows only the strings tell words apart."""
    keys = spelling._neighbours
    words = ["abcdef", "abcdeg", "abcde", "xbcdef", "qwerty"]
    rows = [(k, p, w) for w in words for k, p in [(spelling.REPLACED, i) for i in range(len(w))] + [(spelling.LONGER, i) for i in range(len(w)) if i == 0 or w[i] != w[i - 1]] + [(spelling.WHOLE, -1)]]
    import pyarrow as pa

    out = keys({"key": pa.array([1] * len(rows)), "kind": pa.array([r[0] for r in rows]), "place": pa.array([r[1] for r in rows]), "word": pa.array([r[2] for r in rows]), "n": pa.array([1] * len(rows))})
    total = Counter()
    for w, k in zip(out["word"], out["near"], strict=True):
        total[w] += k
    assert total == {w: k for w, _, _, _, k, _ in grouped(dict.fromkeys(words, 1)) if k}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\u00e9\U0001f600", min_size=1, max_size=9), min_size=1, max_size=8))
def test_deletion_hashes_equal_those_of_the_shorter_words(strings):
    word, place, h = spelling.deletion_keys(strings)
    rest = [strings[w] if p < 0 else strings[w][:p] + strings[w][p + 1 :] for w, p in zip(word.tolist(), place.tolist(), strict=True)]
    plain = []
    for r in rest:
        v = 0
        for c in r:
            v = (v * int(spelling.BASE) + ord(c) + 1) % 2**64
        plain.append(v)
    assert h.tolist() == plain and np.array_equal(np.bincount(word), [len(s) + 1 for s in strings])
