"""Near copies by exact Jaccard similarity of word shingles: what the SimHash operator compares beyond its fingerprints.

Candidates come from two sides. The SimHash fingerprints of the shingle sets are covered by anchors
(``simhash.near_links``), which reaches 3 of 64 bits; pairs at a similarity of 0.8 differ by 10 bits on average, and anchors
for those would take over a thousand replicas a fingerprint. So MinHash completes them: SLOTS minima of the shingle
hashes, in BANDS keys of SLOTS / BANDS minima each, so a pair at similarity s shares a key but for (1 - s ** 4) ** 32
of cases: 5e-8 at 0.8, less above. Within a key, rows whose sketches agree in LEAST_AGREEING slots or more
(102 expected at 0.8) are tied together; what ties and covered fingerprints reach is a blob. A blob's
shingle sets are shipped once and compared exactly, so no pair below the similarity is ever linked.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm._shared import WORD, by_bitmaps, group_starts, local_forest, map_batches, map_groups, materialize, utf8
from rillwork.llm.components import connected_components
from rillwork.llm.simhash import majority, near_links

SLOTS, BANDS, LEAST_AGREEING = 128, 32, 70
CELL = 512
_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(0, 1 << 63, (SLOTS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, (SLOTS, 1), dtype=np.uint64)


def shingles(data: bytes, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole text if it is shorter, none without words."""
    words = WORD.findall(data.lower())  # bytes.lower changes A-Z only
    digest = xxhash.xxh64_intdigest
    grams = [b" ".join(words)] if len(words) <= size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    return np.unique(np.fromiter(map(digest, grams), np.uint64)) if words else np.zeros(0, np.uint64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SLOTS minima, each of the hashes' upper halves under a multiplication of its own."""
    low = np.full(SLOTS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 4096):
        low = np.minimum(low, ((hashes[i : i + 4096] * _FACTORS + _OFFSETS) >> np.uint64(32)).min(axis=1).astype(np.uint32))
    return low


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """(rows x SLOTS) minima to (rows x BANDS) signed longs."""
    parts = sketches.reshape(len(sketches), BANDS, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        key = (key ^ parts[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key.view(np.int64)


def _parts(size: str):
    return F.ceil(F.col(size) / CELL).cast("int")


def _near(low: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    return (low[j] == low[i]).sum(axis=1) >= LEAST_AGREEING


def _ties(c: dict) -> dict:
    """Whole cells of a key to ties of rows whose sketches agree enough, and the rows that need another look.

    In a cell each row meets the first one; those that do not agree with it meet all of the cell. In a key of
    several cells (``parts`` > 1) the first row is the key's pivot, and rows that do not agree are given back in ``rest``.
    """
    starts = group_starts([c["key"], c["cell"]])
    rep, parts = np.asarray(c["rep"]), np.asarray(c["parts"])
    low = np.frombuffer(b"".join(c["low"].to_pylist()), np.uint8).reshape(len(rep), SLOTS)
    size = np.diff(np.append(starts, len(rep)))
    first = np.repeat(starts, size)
    agree = np.zeros(len(rep), bool)
    for i in range(0, len(rep), 1 << 15):
        agree[i : i + (1 << 15)] = (low[i : i + (1 << 15)] == low[first[i : i + (1 << 15)]]).sum(axis=1) >= LEAST_AGREEING
    left, right = [np.flatnonzero(agree)], [first[agree]]
    rest = np.flatnonzero(~agree)
    for i in rest[parts[rest] == 1].tolist():
        s = first[i]
        j = s + np.flatnonzero(_near(low, i, np.arange(s, i)))
        left.append(np.full(len(j), i)), right.append(j)
    return _forest(rep, left, right, c["key"], rest[parts[rest] > 1])


def _rest_ties(c: dict) -> dict:
    """Cells of some rows without a tie to the pivot (``one``) and some of all rows of the key: every pair of the two."""
    starts = group_starts([c["key"], c["cell"]])
    rep, one = np.asarray(c["rep"]), np.asarray(c["one"].cast("int8")) > 0
    low = np.frombuffer(b"".join(c["low"].to_pylist()), np.uint8).reshape(len(rep), SLOTS)
    left, right = [], []
    for s, e in zip(starts, np.append(starts[1:], len(rep)), strict=True):
        others = s + np.flatnonzero(~one[s:e])
        for i in (s + np.flatnonzero(one[s:e])).tolist():
            j = others[_near(low, i, others)]
            left.append(np.full(len(j), i)), right.append(j)
    return _forest(rep, left, right)


def _rest_links(percent: int):
    """As ``_rest_ties``, by exact similarity of the sets."""

    def step(c: dict) -> dict:
        starts = group_starts([c["key"], c["cell"]])
        rep, one = np.asarray(c["rep"]), np.asarray(c["one"].cast("int8")) > 0
        sets = [np.frombuffer(x, np.uint64) for x in c["hashes"].to_pylist()]
        left, right = [], []
        for s, e in zip(starts, np.append(starts[1:], len(rep)), strict=True):
            if e - s > 1:
                a, b = similar(sets[s:e], percent)
                keep = one[s + a] != one[s + b]
                left.append(s + a[keep]), right.append(s + b[keep])
        return _forest(rep, left, right)

    return step


def _linked(rows: DataFrame, sizes: DataFrame, payload: str, first: Callable, rest: Callable, name: str) -> DataFrame:
    """rows(key, rep, payload) and sizes(key, size, pivot) -> links(a, b) that connect all matching rows of a key.

    A key's rows are dealt into cells of about CELL, each with a copy of the pivot's row as its first.
    Rows that do not match the pivot then meet all rows of their key, part by part. So a hot key whose rows
    match their pivot takes work in proportion to its rows, and no task holds more than two parts.
    """
    schema = "a bigint, b bigint, key bigint, rest bigint"
    at = rows.join(sizes, "key").withColumn("parts", _parts("size"))
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    cells = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    dealt = at.withColumn("cell", F.explode(cells)).withColumn("later", F.col("rep") != F.col("pivot"))
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell", "later").select("key", "cell", "rep", "parts", payload)
    found = materialize(map_groups(dealt, ["key", "cell"], first, schema), name)
    again = found.where("rest is not null").select("key", F.col("rest").alias("rep"))
    counts = materialize(again.groupBy("key").agg(F.count("*").alias("others")), f"{name}-rest")
    if counts.isEmpty():
        return found.where("a is not null").select("a", "b")
    # only the keys with such rows are joined again, once, for both sides
    some = sizes.join(counts, "key").select("key", _parts("size").alias("parts"), _parts("others").alias("q"))
    both = rows.join(some, "key").join(again.withColumn("one", F.lit(True)), ["key", "rep"], "left")
    other = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("q")).cast("int")
    place = lambda cell, one: F.struct(cell.cast("int").alias("cell"), F.lit(one).alias("one"))
    everyone = F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda x: place(part * F.col("q") + x, False))
    ones = F.when(F.col("one"), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: place(x * F.col("q") + other, True)))
    places = F.explode(F.concat(everyone, F.coalesce(ones, F.array().cast("array<struct<cell:int,one:boolean>>"))))
    dealt = both.select("key", "rep", payload, places.alias("at")).select("key", "at.cell", "rep", "at.one", payload)
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")
    more = map_groups(dealt, ["key", "cell"], rest, schema)
    return found.where("a is not null").select("a", "b").unionByName(more.where("a is not null").select("a", "b"))


def _forest(rep: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], key: pa.Array | None = None, rest: np.ndarray | None = None) -> dict:
    """The links of a spanning forest, then the rows of ``rest`` with their keys."""
    a = np.concatenate(left) if left else np.zeros(0, int)
    b = np.concatenate(right) if right else np.zeros(0, int)
    label = local_forest(len(rep), a, b)
    keep = np.flatnonzero(rep != rep[label])
    none = lambda n: pa.nulls(n, pa.int64())
    rest = np.zeros(0, int) if rest is None else rest
    links = [pa.array(rep[keep], pa.int64()), pa.array(rep[label[keep]], pa.int64())]
    names = pa.array(np.asarray(key)[rest], pa.int64()) if len(rest) else none(0)
    return {
        "a": pa.concat_arrays([links[0], none(len(rest))]), "b": pa.concat_arrays([links[1], none(len(rest))]),
        "key": pa.concat_arrays([none(len(keep)), names]), "rest": pa.concat_arrays([none(len(keep)), pa.array(rep[rest], pa.int64())]),
    }


def similar(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sorted distinct arrays whose Jaccard similarity is ``percent`` / 100 or more."""
    size = np.array([len(s) for s in sets])
    if len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        row, column = row[times[column] > 1], column[times[column] > 1]
        column = np.unique(column, return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float64)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            s, e = np.searchsorted(column, [first, first + 4096])
            x = np.zeros((len(sets), 4096), np.float32)
            x[row[s:e], column[s:e] - first] = 1
            common += x @ x.T  # at most 4096 a product: exact
    a, b = np.nonzero(np.triu(100 * common >= percent * (size[:, None] + size - common), 1))
    return a, b


def _verified(percent: int):
    """Whole cells of a blob to links of similar rows; in blobs of several cells rows unlike the pivot come back."""

    def step(c: dict) -> dict:
        rep, parts = np.asarray(c["rep"]), np.asarray(c["parts"])
        starts = group_starts([c["key"], c["cell"]])
        sets = [np.frombuffer(s, np.uint64) for s in c["hashes"].to_pylist()]
        size = np.array([len(s) for s in sets])
        left, right, rest = [], [], []
        for s, e in zip(starts, np.append(starts[1:], len(rep)), strict=True):
            if e - s == 1:
                continue
            common = np.array([np.isin(x, sets[s], assume_unique=True).sum() for x in sets[s:e]])
            like = 100 * common >= percent * (size[s] + size[s:e] - common)
            left.append(s + np.flatnonzero(like)), right.append(np.full(like.sum(), s))
            if like.all():
                continue
            if parts[s] > 1:
                rest.append(s + np.flatnonzero(~like))
            else:
                a, b = similar(sets[s:e], percent)
                left.append(s + a), right.append(s + b)
        return _forest(rep, left, right, c["key"], np.concatenate(rest) if rest else None)

    return step


def first_of_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, row: long, text) -> (doc_id, row), the least of each component, without rows that have no doc_id.

    Components are those of the pairs with a Jaccard similarity of ``percent`` / 100 or more. Texts
    with equal shingle sets, also those without words, are one class and never paired.
    """

    def make():
        def step(c: dict) -> dict:
            sets = [shingles(t, size) for t in utf8(c["text"])]
            digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = np.array([majority(s) for s in sets], np.uint64).view(np.int64)
            return {"doc_id": c["doc_id"], "row": c["row"], "digest": digests, "fp": prints, "sketch": pa.array([sketch(s).tobytes() for s in sets], pa.binary())}

        return step

    def make_keys():
        def step(c: dict) -> dict:
            all_ = np.frombuffer(b"".join(c["sketch"].to_pylist()), np.uint32).reshape(-1, SLOTS)
            return {"key": band_keys(all_).ravel(), "rep": np.repeat(np.asarray(c["rep"]), BANDS)}

        return step

    def make_low():
        def step(c: dict) -> dict:
            return {"rep": c["rep"], "low": pa.array([np.frombuffer(s, np.uint32).astype(np.uint8).tobytes() for s in c["sketch"].to_pylist()], pa.binary())}

        return step

    def make_sets():
        def step(c: dict) -> dict:
            return {"key": c["key"], "rep": c["rep"], "hashes": pa.array([shingles(t, size).tobytes() for t in utf8(c["text"])], pa.binary())}

        return step

    known = docs.where("doc_id is not null")
    prints = map_batches(known.select("doc_id", "row", "text"), make, "doc_id bigint, row bigint, digest binary, fp bigint, sketch binary")
    classes = prints.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("least"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "fp", "sketch"), "shingle-classes")

    # pairs within the anchors' reach, and classes with one fingerprint
    by_print = materialize(classes.groupBy("fp").agg(F.min("rep").alias("first")), "shingle-fingerprints")
    covered = near_links(by_print.withColumnRenamed("first", "rep"))
    equal = classes.select("fp", "rep").join(by_print, "fp").where("rep <> first").select(F.col("rep").alias("a"), F.col("first").alias("b"))

    bands = map_batches(classes.select("rep", "sketch"), make_keys, "key bigint, rep bigint")
    shared = materialize(bands.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")).where("size > 1"), "shared-bands")
    low = map_batches(classes.select("rep", "sketch"), make_low, "rep bigint, low binary")
    candidates = materialize(bands.join(shared.select("key"), "key", "left_semi").join(low, "rep"), "candidates")
    ties = _linked(candidates, shared, "low", _ties, _rest_ties, "ties")
    ties = ties.unionByName(covered).unionByName(equal)
    blobs = materialize(connected_components(ties).select(F.col("node").alias("rep"), F.col("component").alias("key")), "blobs")

    sizes = materialize(blobs.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("pivot")), "blob-sizes")
    members = materialize(blobs.join(classes.select("rep", "least"), "rep").select("key", "rep", "least.doc_id", "least.row"), "blob-members")
    few = by_bitmaps(known, members.select(F.col("doc_id").cast("bigint").alias("doc_id")))
    texts = (known if few is None else few).select("doc_id", "row", "text").join(members, ["doc_id", "row"]).dropDuplicates(["rep"])
    sets = materialize(map_batches(texts.select("key", "rep", "text"), make_sets, "key bigint, rep bigint, hashes binary"), "shingle-sets")
    links = _linked(sets, sizes, "hashes", _verified(percent), _rest_links(percent), "similar")
    components = connected_components(links).withColumnRenamed("node", "rep")
    named = classes.select("rep", "least").join(components, "rep", "left").select("least", F.coalesce("component", "rep").alias("component"))
    return named.groupBy("component").agg(F.min("least").alias("least")).select("least.doc_id", "least.row")
