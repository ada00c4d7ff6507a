"""The manifest against a tree built in memory."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from rillwork.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return H("".join(map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text))))


def tree(digests):
    """The root, and for each digest its siblings as (before, after) by level."""
    paths, below, now = [[] for _ in digests], [[i] for i in range(len(digests))], digests
    while len(now) > 1:
        above, under = [], []
        for s in range(0, len(now), 8):
            run = now[s : s + 8]
            above.append(H("".join(run)))
            for k in range(len(run)):
                for i in below[s + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            under.append([i for k in range(len(run)) for i in below[s + k]])
        now, below = above, under
    return now[0], paths


def expected(rows):
    groups, done = {}, []
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    for g in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        some = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        done.append((some, *tree([leaf(r, r["text"]) for r in some])))
    root, tops = tree([sub for _, sub, _ in done]) if done else (None, [])
    out = []
    for (some, sub, paths), top in zip(done, tops, strict=True):
        for r, own in zip(some, paths, strict=True):
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = leaf(r, text)
            for before, after in own + top:
                h = H(before + h + after)
            out.append((r["doc_id"], leaf(r, r["text"]), sub, root, H("".join(b + a for b, a in own + top)), h, h == root))
    return sorted(out, key=str)


def got(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, COLUMNS)
    monkeypatch.setattr(merkle, "read_table", lambda *_: docs)
    return sorted(map(tuple, merkle.op12_merkle(spark, "").collect()), key=str)


def as_dicts(rows):
    return [dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r[:5], strict=True)) for r in rows]


def test_groups_of_many_sizes_and_odd_rows(spark, monkeypatch):
    rows = []
    for lang, n in ((None, 9), ("", 1), ("a", 65), ("b", 8), ("Z", 2), ("é", 73), ("\U0001f600", 1), ("ﬀ", 1), *((f"x{i}", 1) for i in range(9))):
        rows += [(len(rows) + i, f"s{i % 3}", lang, i, f"Text {i} Of ÄÖ" * (i % 4), "clash", 1) for i in range(n)]
    rows += [(None, None, None, None, None, None, None), (5, "s", "a", 1, "tie B", "", 0), (5, "s", "a", 1, "tie A", "", 0), (5, "s", "a", 1, "tie A", "", 0), (-7, "s", "a", None, "", "", 0), (3, "s", "b", 2, "Long " * 30000, "", 0)]
    assert got(spark, rows, monkeypatch) == expected(as_dicts(rows))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [r[:5] for r in rows])
    assert sorted(con.execute(merkle.OP12_SQL).fetchall(), key=str) == expected(as_dicts(rows))


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, monkeypatch, n):
    rows = [(i, "s", "en", 1, "Abc", "", 0) for i in range(n)]
    assert got(spark, rows, monkeypatch) == expected(as_dicts(rows))


def test_a_changed_sibling_breaks_the_proof(spark):
    docs = spark.createDataFrame([(i, "s", "en", 1, f"t{i}") for i in range(70)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = merkle.manifest(docs)
    wrong = F.transform("path", lambda s: F.struct(F.translate(s["before"], "0", "1").alias("before"), F.translate(s["after"], "0", "1").alias("after")))
    out = rows.select("root", merkle.fold(F.col("leaf"), F.col("path")).alias("right"), merkle.fold(F.col("leaf"), wrong).alias("wrong")).collect()
    assert all(r.right == r.root and r.wrong != r.root for r in out)
