"""SimHash near-duplicates, found by anchor-point covering.

Two fingerprints of 64 bits at a distance of 3 or less differ by at most one bit in one of two
blocks of 31 bits. In each block the anchors are the code words of the perfect (31, 26) Hamming
code, whose covering radius is 1: every value has one anchor within distance 1, its home, and
whatever lies one bit from the value lies within 2 of that home. So each fingerprint is replicated to all
anchors within 2 (16 of them, one if it is a code word), and homes are compared with all
replicas per anchor, on all 64 bits. No link is lost, whatever the size of the input.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import WORD, group_starts, local_forest, map_batches, map_groups, materialize, read_table, with_default_columns
from rillwork.llm.components import connected_components

BLOCK = 31
#: Anchors with more replicas are dealt into cells of about this many homes by this many replicas.
CELL = 4096


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """The SimHash as an unsigned integer; 0 for a null text or one without words."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = WORD.findall(data.lower())  # bytes.lower changes A-Z only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(size) - 1
        starts = ends - size + 1
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 if there are none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].astype(">u8").view(np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp): fp is the fingerprint as a signed long."""

    def make():
        def step(c: dict) -> dict:
            texts = c["text"].cast("binary").to_pylist()
            return {"doc_id": c["doc_id"], "fp": np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)}

        return step

    return map_batches(with_default_columns(docs, doc_id="bigint", text="string"), make, "doc_id bigint, fp bigint")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unsigned fingerprints: row index, anchor key (block and code word) and whether it is home."""
    rows, keys, home = [], [], []
    at = np.arange(len(fp))
    for block in range(2):
        x = (fp >> np.uint64(BLOCK * block)) & np.uint64((1 << BLOCK) - 1)
        syndrome = np.zeros(len(fp), np.uint64)
        for p in range(BLOCK):
            syndrome ^= ((x >> np.uint64(p)) & np.uint64(1)) * np.uint64(p + 1)
        flip = lambda a: np.where(a > 0, np.uint64(1) << (np.maximum(a, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        tag = np.uint64(block << BLOCK)
        rows.append(at), keys.append((x ^ flip(syndrome)) | tag), home.append(np.ones(len(fp), bool))
        for a in range(1, BLOCK + 1):
            b = syndrome ^ np.uint64(a)
            pair = (syndrome > 0) & (b > a)
            rows.append(at[pair]), keys.append((x[pair] ^ flip(np.full(pair.sum(), a, np.uint64)) ^ flip(b[pair])) | tag)
            home.append(np.zeros(pair.sum(), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(home)


def _compare(distance: int):
    """Whole anchors' rows to the links of a spanning forest of what lies within ``distance``."""

    def step(c: dict) -> dict:
        starts = group_starts([c["anchor"], c["cell"]])
        fp, rep = np.asarray(c["fp"]).view(np.uint64), np.asarray(c["rep"])
        home, member = np.asarray(c["home"].cast("int8")) > 0, np.asarray(c["member"].cast("int8")) > 0
        size = np.diff(np.append(starts, len(fp)))
        group = np.repeat(np.arange(len(starts)), size)
        left, right = [], []
        small = np.repeat((size > 1) & (size <= 64), size)
        at = np.flatnonzero(small)
        for d in range(1, 64):
            at = at[at + d < len(fp)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            near = (np.bitwise_count(fp[at] ^ fp[at + d]) <= distance) & ((home[at] & member[at + d]) | (member[at] & home[at + d]))
            left.append(at[near]), right.append(at[near] + d)
        for s, n in zip(starts[size > 64], size[size > 64], strict=True):
            h, m = s + np.flatnonzero(home[s : s + n]), s + np.flatnonzero(member[s : s + n])
            for i in range(0, len(h), 256):
                x, y = np.nonzero(np.bitwise_count(fp[h[i : i + 256], None] ^ fp[m]) <= distance)
                # only a forest of each 256 homes' links is kept, so a cell holds no more links than rows for each of them
                a, b = h[i : i + 256][x] - s, m[y] - s
                least = local_forest(n, a, b)
                tied = np.flatnonzero(least != np.arange(n))
                left.append(s + tied), right.append(s + least[tied])
        a = np.concatenate(left) if left else np.zeros(0, int)
        b = np.concatenate(right) if right else np.zeros(0, int)
        label = local_forest(len(fp), a, b)
        keep = np.flatnonzero(rep != rep[label])
        return {"a": rep[keep], "b": rep[label[keep]]}

    return step


def near_links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """classes(fp, rep: long, fp distinct) -> links(a, b) between reps, enough to connect all that lie near."""
    if distance > 3:
        raise ValueError("the anchors cover distances up to 3")

    def make():
        def step(c: dict) -> dict:
            fp, rep = np.asarray(c["fp"]), np.asarray(c["rep"])
            at, key, home = anchors(fp.view(np.uint64))
            return {"anchor": key.view(np.int64), "fp": fp[at], "rep": rep[at], "home": home}

        return step

    rows = map_batches(classes.select("fp", "rep"), make, "anchor bigint, fp bigint, rep bigint, home boolean")
    hot = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("h"))
    hot = materialize(hot.where((F.col("n") > CELL) & (F.col("h") > 0)), "hot-anchors")
    parts = lambda c: F.ceil(F.col(c) / CELL).cast("int")
    dealt = rows.join(hot, "anchor", "left").select(
        "anchor", "fp", "rep", "home", F.coalesce(parts("h"), F.lit(1)).alias("hc"), F.coalesce(parts("n"), F.lit(1)).alias("mc")
    )
    one = dealt.where("hc = 1 and mc = 1").select("anchor", F.lit(0).alias("cell"), "fp", "rep", "home", F.lit(True).alias("member"))
    many = dealt.where("hc > 1 or mc > 1").withColumn("i", F.pmod(F.xxhash64("fp"), "hc").cast("int")).withColumn("j", F.pmod(F.hash("fp"), "mc").cast("int"))
    as_member = many.select("anchor", F.explode(F.expr("transform(sequence(0, hc - 1), x -> x * mc + j)")).alias("cell"), "fp", "rep", F.lit(False).alias("home"), F.lit(True).alias("member"))
    as_home = many.where("home").select("anchor", F.explode(F.expr("transform(sequence(0, mc - 1), x -> i * mc + x)")).alias("cell"), "fp", "rep", "home", F.lit(False).alias("member"))
    cells = one.unionByName(as_member).unionByName(as_home)
    return map_groups(cells.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell"), ["anchor", "cell"], _compare(distance), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id).

    A null text counts as one without words: fingerprint zero, linked like any other. component_id
    is the smallest doc_id reachable; rows without a doc_id link like any others and get their component's
    id, null if no row of it has one. Equal fingerprints form one class, so copies are never paired;
    repeated rows stay rows. An empty table gives no rows; other columns are ignored, whatever their names.
    doc_id is cast to a long.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", F.col("fp"))
    classes = materialize(classes, "fingerprint-classes")
    components = connected_components(near_links(classes.select("fp", "rep"), distance)).withColumnRenamed("node", "rep")
    grouped = classes.join(components, "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("component"))
    grouped = materialize(grouped, "named-classes")
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_of_similar(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, row: long, text) -> (doc_id, row): the least row of each component of similar texts.

    Texts are linked where the Jaccard similarity of their shingle sets is ``percent`` / 100 or more. Fingerprints
    within the anchors' reach are candidates, completed as ``rillwork.llm.jaccard`` says; each is compared exactly.
    """
    from rillwork.llm import jaccard

    return jaccard.first_of_components(docs, shingle, percent)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
