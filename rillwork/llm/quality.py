"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Random indexing (Sahlgren, 2005): every context word has a fixed sparse ternary index vector, and a
word's vector is the sum of the index vectors of its neighbours over the whole corpus. Words are
hashed into ``BUCKETS`` rows, so the table has one size whatever the corpus (8 MB), which is what
bounds the driver's and the tasks' memory. The sums are integers: they do not depend on the order of tasks.
The network is fitted on the driver with numpy, on at most ``max_labelled`` labelled rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import map_batches, read_table, with_default_columns

#: Runs of word characters, and runs of other visible characters.
TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS, DIM, WINDOW, NONZERO, SEED = 1 << 15, 64, 2, 2, 20240
#: The table travels in this many row blocks.
BLOCKS = 128
#: Tokens handled at once.
CHUNK = 1 << 18


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and the signs of its index vector's non-zero entries."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice([-1, 1], (BUCKETS, NONZERO))


def _chunks(texts: list[str | None]):
    """(first row, token buckets, row lengths) for consecutive rows of about CHUNK tokens."""
    first, buckets, sizes = 0, [], []
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t or "")
        buckets += tokens
        sizes.append(len(tokens))
        if len(buckets) >= CHUNK or i == len(texts) - 1:
            hashed = pd.util.hash_array(np.array(buckets, dtype=object), categorize=True) if buckets else np.zeros(0, np.uint64)
            yield first, (hashed % np.uint64(BUCKETS)).astype(np.int64), np.array(sizes)
            first, buckets, sizes = i + 1, [], []


def word_table(docs: DataFrame) -> np.ndarray:
    """The word vectors (BUCKETS x DIM) of the corpus, unit length; a bucket without neighbours is zero."""

    def accumulate(batches):
        import pyarrow as pa

        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM)
        for batch in batches:
            for _, tokens, sizes in _chunks(batch.column(0).to_pylist()):
                row = np.repeat(np.arange(len(sizes)), sizes)
                for d in range(1, WINDOW + 1):
                    same = row[d:] == row[:-d]
                    a, b = tokens[:-d][same], tokens[d:][same]
                    for x, y in ((a, b), (b, a)):
                        for j in range(NONZERO):
                            total += np.bincount(x * DIM + place[y, j], weights=sign[y, j], minlength=BUCKETS * DIM)
        rows = total.astype("<i8").reshape(BLOCKS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([zlib.compress(r.tobytes(), 1) for r in rows], pa.binary())], names=["block", "sums"])

    def add(c: dict) -> dict:
        blocks, sums = np.asarray(c["block"]), {}
        for b, z in zip(blocks.tolist(), c["sums"], strict=True):
            x = np.frombuffer(zlib.decompress(z.as_py()), "<i8")
            sums[b] = sums[b] + x if b in sums else x
        return {"block": list(sums), "sums": [zlib.compress(x.tobytes(), 1) for x in sums.values()]}

    schema = "block int, sums binary"
    parts = docs.select(F.col("text").cast("string")).mapInArrow(accumulate, schema)
    # one more level first: tasks' tables meet in groups of 32, then all of a block
    level = lambda df, *keys: map_batches(df.repartition(*keys), lambda: add, schema)
    parts = level(parts.withColumn("part", (F.spark_partition_id() / 32).cast("int")), "block", "part")
    total = np.zeros((BLOCKS, BUCKETS // BLOCKS * DIM))
    for r in level(parts, "block").toLocalIterator():
        total[r.block] += np.frombuffer(zlib.decompress(bytes(r.sums)), "<i8")
    total = total.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return (total / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """The mean word vector of each text; zero for a text without tokens."""
    out = np.zeros((len(texts), DIM), np.float32)
    for first, tokens, sizes in _chunks(texts):
        full = np.flatnonzero(sizes)
        if len(full):
            starts = (np.cumsum(sizes) - sizes)[full]
            out[first + full] = np.add.reduceat(table[tokens], starts, axis=0) / sizes[full, None]
    return out


@dataclass
class Network:
    """Standardised inputs, one tanh layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x.astype(np.float64)) / self.temperature))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 0.003, decay: float = 1e-4) -> Network:
    """Adam on mini-batches; a fifth of the rows is set aside to calibrate the temperature by likelihood."""
    if len(y) == 0:
        return Network(np.zeros(DIM), np.ones(DIM), np.zeros((DIM, 1)), np.zeros(1), np.zeros(1), 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    cut = max(1, len(y) * 4 // 5)
    fit, held = order[:cut], order[cut:]
    mean, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.array(0.0)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(z[rows] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[rows]) / len(rows)
            dh = np.outer(d, p[2]) * (1 - h * h)
            t += 1
            for i, g in enumerate((z[rows].T @ dh + decay * p[0], dh.sum(0), h.T @ d + decay * p[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    if len(held):
        logit, grid = net.logits(x[held]), np.exp(np.linspace(np.log(0.25), np.log(8), 71))
        loss = [np.mean(np.logaddexp(0, logit / g) - y[held] * logit / g) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20000) -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs``, and the network fitted on labelled rows outside the held-out fold.

    ``max_labelled`` bounds the labelled rows (those smallest by a hash of doc_id are taken). A
    doc_id with several labels counts with its largest, one with several texts with the one whose pooled vector is
    least; null labels are not used. So at most ``max_labelled`` rows of DIM numbers reach the driver.
    """
    table = word_table(docs)
    rows = with_default_columns(labels, doc_id="bigint", quality="int").where("doc_id is not null and quality is not null").where(~held_out("doc_id"))
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = with_default_columns(docs, doc_id="bigint", text="string").join(F.broadcast(rows), "doc_id")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        return lambda c: {"doc_id": c["doc_id"], "quality": c["quality"], "x": list(pooled(c["text"].to_pylist(), shared.value))}

    pooled_rows = map_batches(texts, make, "doc_id bigint, quality int, x array<float>")
    got = pooled_rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x")).orderBy("doc_id").collect()
    x = np.array([r.x for r in got], np.float64).reshape(-1, DIM)
    return table, train(x, np.array([min(1, max(0, r.quality)) for r in got], np.float64))


def score(docs: DataFrame, table: np.ndarray, net: Network, extra: tuple[str, ...] = ()) -> DataFrame:
    """docs -> (extra columns, score): the calibrated probability of label 1 of each whole text; nulls count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((table, net))
    kept = docs.select(*extra, F.col("text").cast("string").alias("__text"))

    def make():
        words, network = shared.value

        def step(c: dict) -> dict:
            return {n: c[n] for n in extra} | {"__score": network.score(pooled(c["__text"].to_pylist(), words))}

        return step

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "__text"]
    return map_batches(kept, make, ", ".join([*fields, "__score double"]))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = score(docs, *fit(docs, read_table(spark, sf_dir, "labels")), ("doc_id",))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.7).cast("int").alias("predicted"))
