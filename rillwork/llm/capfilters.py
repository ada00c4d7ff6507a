"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter is a direction made of one code vector for each half of the coordinates, after a random
rotation; ``TABLES`` rotations with ``size`` codes a half give ``TABLES * size ** 2`` filters. A vector is
listed at every filter whose direction it exceeds by a threshold; list decoding visits only the first halves that
some second half can complete. Vectors of one filter and label are compared in double precision. A
pair is counted at the smallest filter that both share, so each found pair counts once.

Fewer blocks with more codes, over several rotations, keep the number of filters per vector even: with
four blocks of 32 codes the median vector met none. The codes of a half double whenever the largest label's vectors
grow fourfold beyond BASE_ROWS, and the threshold is the highest at which a pair at the wanted cosine shares
COMMON filters on average (``threshold_for``), whatever the dimension: so recall stays as it is while a filter holds
an ever smaller part of a label: one in some 4,800 vectors at 64 codes, one in some 17,000 at 128 (64 dimensions).
Of pairs at a cosine of 0.93 exactly, 0.987 or more shared a filter in 2, 7, 32, 64 and 256 dimensions.
Vectors of few dimensions are padded with zeros, which changes no cosine.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm._shared import group_starts, local_forest, map_batches, map_groups, materialize, read_table, with_default_columns
from rillwork.llm.components import connected_components

TABLES, SEED, LEAST_DIM = 24, 11, 16
#: Codes of a half for up to so many vectors of a label; filters that a pair at the threshold shares on average.
BASE_SIZE, BASE_ROWS, COMMON = 64, 1 << 16, 9.0
#: A filter's rows are dealt into chunks of about this many; a task compares two chunks at once.
CELL = 2048
#: Pairs whose filters are compared at once.
PAIRS = 1 << 13


def codes_for(rows: int) -> int:
    """Codes of a half for the largest label's number of vectors."""
    size = BASE_SIZE
    while rows > BASE_ROWS * (size // BASE_SIZE) ** 2:
        size *= 2
    return size


@lru_cache(16)
def threshold_for(dim: int, size: int, cosine: float) -> float:
    """The largest alpha at which a pair at ``cosine`` shares COMMON of the TABLES * size ** 2 filters on average.

    The product of a uniform unit vector and a direction has density (1 - t ** 2) ** ((dim - 3) / 2).
    """
    t = (np.arange(20000) + 0.5) / 10000 - 1
    density = (1 - t * t) ** ((dim - 3) / 2)
    density /= density.sum()
    across = (1 - t * t) ** ((dim - 4) / 2)
    beyond = np.append(np.cumsum((across / across.sum())[::-1])[::-1], 0.0)  # share of the component across at or above t

    def shared(alpha: float) -> float:
        a = t[t >= alpha]
        need = (alpha - cosine * a) / np.maximum(np.sqrt((1 - cosine**2) * (1 - a * a)), 1e-12)
        return TABLES * size**2 * float((density[t >= alpha] * beyond[np.clip(np.searchsorted(t, need), 0, len(t))]).sum())

    low, high = 0.0, 1.0
    for _ in range(40):
        middle = (low + high) / 2
        low, high = (middle, high) if shared(middle) >= COMMON else (low, middle)
    return low


@lru_cache(4)
def product_codes(dim: int, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each table the rotation (dim x dim) and the codes (2 x size x dim / 2) of unit vectors."""
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(TABLES):
        rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        codes = rng.normal(size=(2, size, dim // 2))
        out.append((rotation, codes / np.linalg.norm(codes, axis=2, keepdims=True)))
    return out


def list_decode(unit: np.ndarray, size: int = BASE_SIZE, cosine: float = 0.93) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters that unit vectors exceed by the threshold, rows ascending."""
    dim = unit.shape[1]
    need = threshold_for(dim, size, cosine) * np.sqrt(2)
    rows, filters = [], []
    for t, (rotation, codes) in enumerate(product_codes(dim, size)):
        turned = unit @ rotation
        first, second = turned[:, : dim // 2] @ codes[0].T, turned[:, dim // 2 :] @ codes[1].T
        row, a = np.nonzero(first >= (need - second.max(axis=1))[:, None])
        k, b = np.nonzero(second[row] >= (need - first[row, a])[:, None])
        rows.append(row[k]), filters.append((t * size + a[k]) * size + b)
    row, f = np.concatenate(rows), np.concatenate(filters)
    order = np.lexsort((f, row))
    return row[order], f[order]


def padded(x: np.ndarray) -> np.ndarray:
    """Vectors with zeros up to an even number of dimensions, LEAST_DIM at least."""
    dim = max(LEAST_DIM, x.shape[1] + x.shape[1] % 2)
    return np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def unit_vectors(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decode_classes(classes: DataFrame, size: int, cosine: float) -> DataFrame:
    """(ck, rep, label, dim, k, embedding) -> (ck, rep, label, dim, k, vec: binary float64 as given, filters: array<int>)."""

    def make():
        def step(c: dict) -> dict:
            dims, given = np.asarray(c["dim"]), c["embedding"].to_numpy(zero_copy_only=False)
            lists: list = [None] * len(given)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = padded(unit_vectors(np.stack(given[at])))
                for s in range(0, len(x), 1024):
                    row, f = list_decode(x[s : s + 1024], size, cosine)
                    cuts = np.searchsorted(row, np.arange(len(x[s : s + 1024]) + 1))
                    for i, a, b in zip(at[s : s + 1024], cuts[:-1], cuts[1:], strict=True):
                        lists[i] = f[a:b].astype(np.int32)
            return {n: c[n] for n in ("ck", "rep", "label", "dim", "k")} | {"vec": [np.asarray(v, np.float64).tobytes() for v in given], "filters": lists}

        return step

    return map_batches(classes, make, "ck bigint, rep bigint, label int, dim int, k bigint, vec binary, filters array<int>")


def _compare(threshold: float):
    def step(c: dict) -> dict:
        keys = [c[n] for n in ("dim", "label", "filter", "cell")]
        starts = group_starts(keys)
        n = len(c["ck"])
        size = np.diff(np.append(starts, n))
        group = np.repeat(np.arange(len(starts)), size)
        dims, vectors = np.asarray(c["dim"]), c["vec"].to_pylist()
        x = np.zeros((n, int(dims.max())))  # zeros beyond a vector's own dimension
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            x[at, :dim] = unit_vectors(np.frombuffer(b"".join([vectors[i] for i in at]), np.float64).reshape(-1, dim))
        k, own, chunk = np.asarray(c["k"]), np.asarray(c["filter"]), np.asarray(c["chunk"])
        a_side, b_side = np.asarray(c["a_side"].cast("int8")) > 0, np.asarray(c["b_side"].cast("int8")) > 0
        lengths = np.asarray(c["filters"].value_lengths())
        flat = np.asarray(c["filters"].flatten())
        lists = np.full((n, int(lengths.max())), -1, np.int32)
        lists[np.repeat(np.arange(n), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        lists = np.where(lists < own[:, None], lists, -1)  # only filters before this one
        count, left, right = np.zeros(n, np.int64), [], []

        def found(i: np.ndarray, j: np.ndarray) -> None:
            """Counts pairs that share no earlier filter: each is counted at the first that both share."""
            for q in range(0, len(i), PAIRS):
                p, r = i[q : q + PAIRS], j[q : q + PAIRS]
                earlier = ((lists[p][:, :, None] == lists[r][:, None, :]) & (lists[p][:, :, None] >= 0)).any(axis=(1, 2))
                p, r = p[~earlier], r[~earlier]
                np.add.at(count, p, k[r])
                np.add.at(count, r, k[p])
                left.append(p), right.append(r)

        at = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
        for d in range(1, 64):
            at = at[at + d < n]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            i, j = at, at + d
            paired = (a_side[i] & b_side[j] | a_side[j] & b_side[i]) & ((chunk[i] != chunk[j]) | (a_side[i] & b_side[i]))
            i, j = i[paired], j[paired]
            near = np.einsum("nd,nd->n", x[i], x[j]) >= threshold
            found(i[near], j[near])
        for s, m in zip(starts[size > 64], size[size > 64], strict=True):
            ia, ib = s + np.flatnonzero(a_side[s : s + m]), s + np.flatnonzero(b_side[s : s + m])
            same = bool((chunk[ia[:1]] == chunk[ib[:1]]).all())
            for q in range(0, len(ia), 256):
                r = ia[q : q + 256]
                hit = x[r] @ x[ib].T >= threshold
                if same:
                    hit &= ib[None, :] > r[:, None]
                u, v = np.nonzero(hit)
                found(r[u], ib[v])
        a = np.concatenate(left) if left else np.zeros(0, int)
        b = np.concatenate(right) if right else np.zeros(0, int)
        label, ck = local_forest(n, a, b), np.asarray(c["ck"])
        edge, counted = np.flatnonzero(label != np.arange(n)), np.flatnonzero(count)
        null = lambda m: pa.nulls(m, pa.int64())
        cat = lambda p, q: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p), q if isinstance(q, pa.Array) else pa.array(q)])
        return {
            "ck": cat(ck[counted], null(len(edge))), "links": cat(count[counted], null(len(edge))),
            "a": cat(null(len(counted)), ck[edge]), "b": cat(null(len(counted)), ck[label[edge]]),
        }

    return step


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vectors(vec_id, embedding, label) -> (vec_id, n_links, component_id, kept).

    Vectors of one label and length are linked where their cosine is at least ``threshold`` and a filter finds
    them. Vectors that are null, zero or hold null or non-finite numbers, and those without a
    label or vec_id, link with nothing and stay (without a vec_id: component null, not kept). Equal
    vectors of a label are one class: they link with one another and are compared once. Repeated rows count as
    rows; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    v = with_default_columns(vectors, vec_id="bigint", embedding="array<double>", label="int")
    ok = F.expr(
        "vec_id is not null and label is not null and embedding is not null "
        "and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    )
    v = v.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # a class is known by 128 bits of its label and vector
    keyed = v.withColumn("k1", F.when(F.col("ok"), F.xxhash64("label", "embedding"))).withColumn("k2", F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding", "label")))
    grouped = keyed.where("ok").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("k"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    grouped = materialize(grouped.withColumn("ck", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")), "vector-keys")
    most = grouped.groupBy("dim", "label").count().agg(F.max("count")).first()[0] or 0
    classes = materialize(_decode_classes(grouped.select("ck", "rep", "label", "dim", "k", "embedding"), codes_for(most), threshold), "vector-classes")
    key = ["dim", "label", "filter"]
    listed = classes.select("dim", "label", F.explode("filters").alias("filter"))
    hot = materialize(listed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > CELL), "hot-filters")
    rows = classes.withColumn("filter", F.explode("filters")).join(hot, key, "left")
    rows = rows.withColumn("parts", F.coalesce(F.ceil(F.col("n") / CELL), F.lit(1)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("ck"), F.col("parts")).cast("int"))
    # chunk c meets chunk d in the cell of the smaller and the larger of the two
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("cell", F.least("chunk", "other") * F.col("parts") + F.greatest("chunk", "other"))
    rows = rows.withColumn("a_side", F.col("chunk") <= F.col("other")).withColumn("b_side", F.col("chunk") >= F.col("other"))
    rows = rows.select(*key, "cell", "chunk", "a_side", "b_side", "ck", "k", "vec", "filters")
    rows = rows.repartition(*key, "cell").sortWithinPartitions(*key, "cell")
    found = materialize(map_groups(rows, [*key, "cell"], _compare(threshold), "ck bigint, links bigint, a bigint, b bigint"), "vector-links")
    counts = found.where("ck is not null").groupBy("ck").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("ck is null").select("a", "b")).withColumnRenamed("node", "ck")
    info = grouped.select("k1", "k2", "ck", "rep", "k").join(counts, "ck", "left").join(components, "ck", "left")
    info = info.select("k1", "k2", "rep", (F.col("k") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "ck").alias("component"))
    info = materialize(info, "vector-links-counted")
    least = info.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = materialize(info.join(least, "component").select("k1", "k2", "n_links", "component_id"), "vector-classes-done")
    out = keyed.join(info, ["k1", "k2"], "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op9_capfilters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(read_table(spark, sf_dir, "embeddings"))
