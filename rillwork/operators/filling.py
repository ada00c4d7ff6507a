"""Depression filling in two passes over tiles, with a graph of catchments between them.

A cell's filled level is the larger of its height and the level over which its catchment spills to a seed,
that is the least over all paths of the highest point. In a tile, cells descend to their catchments' lowest cells, and
neighbouring catchments are joined at their lowest common pass. Only catchments that touch the tile's edge matter
outside: of the rest of the graph a spanning tree over those and the outlet keeps every such level
(``reduced``). The tiles' graphs are joined across their edges and reduced again in groups of
GROUP x GROUP tiles, level by level, until one group holds what is left; then the levels go back down the same
way. So the shuffles grow with the logarithm of the raster's width, and what they move with the tiles' edges.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.plans.blocks import TILE, Block, as_table, tile_map, tile_map_with
from rillwork.plans.store import settle

#: Tiles (or groups of them) along a side of the next level's group.
GROUP = 8
#: The node that stands for everywhere that water leaves.
OUT = -1
EDGES = "run int, a bigint, b bigint, w double"
EDGE_ROWS = pa.schema([("run", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])


def catchments(block: Block, cols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of each own cell, edges a, b, w): labels and edge ends are grid nodes of lowest cells, or OUT; -2 without data.

    Cells descend to the neighbour that is lowest by (height, place), so plateaus have one lowest cell each.
    """
    t = block.tile
    z = block.own(block.arrays["z"])
    data = ~np.isnan(z)
    flat = np.where(data, z, np.inf).ravel()
    order = np.argsort(flat, kind="stable")
    rank = np.empty(t * t, np.int64)
    rank[order] = np.arange(t * t)
    ranks = np.full((t + 2, t + 2), t * t, np.int64)
    ranks[1:-1, 1:-1] = np.where(data, rank.reshape(t, t), t * t)
    low = ranks[1:-1, 1:-1].copy()
    for dr, dc in zip(DR, DC, strict=True):
        np.minimum(low, ranks[1 + dr : 1 + dr + t, 1 + dc : 1 + dc + t], out=low)
    to = np.append(order, 0)[low.ravel()]
    to = np.where(data.ravel(), to, np.arange(t * t))
    while True:
        further = to[to]
        if (further == to).all():
            break
        to = further
    node = (np.arange(t)[:, None] + block.r0).astype(np.int64) * cols + np.arange(t) + block.c0
    label = np.where(data, node.ravel()[to].reshape(t, t), -2)
    a, b, w = [], [], []
    for dr, dc in ((0, 1), (1, 0), (1, 1), (1, -1)):
        here = (slice(0, t - dr), slice(max(0, -dc), t - max(0, dc)))
        there = (slice(dr, t), slice(max(0, dc), t - max(0, -dc)))
        unlike = data[here] & data[there] & (label[here] != label[there])
        x, y = label[here][unlike], label[there][unlike]
        a.append(np.minimum(x, y)), b.append(np.maximum(x, y)), w.append(np.maximum(z[here], z[there])[unlike])
    whole = ~np.isnan(block.arrays["z"])
    inner = np.ones((t, t), bool)
    for dr, dc in zip(DR, DC, strict=True):
        inner &= block.shifted(whole, dr, dc)
    seed = data & ~inner
    a.append(np.full(seed.sum(), OUT)), b.append(label[seed]), w.append(z[seed])
    return label, *lowest(np.concatenate(a), np.concatenate(b), np.concatenate(w))


def lowest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least weight of each pair."""
    order = np.lexsort((w, b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[first], b[first], w[first]


def reduced(a: np.ndarray, b: np.ndarray, w: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges between ``ends`` only, with the same least highest weight between any two of them.

    Edges join components from the least on; where both sides hold an end, one of each is linked.
    """
    names, place = np.unique(np.concatenate([a, b, ends]), return_inverse=True)
    x, y, e = place[: len(a)], place[len(a) : 2 * len(a)], place[2 * len(a) :]
    root, end = list(range(len(names))), [-1] * len(names)
    for i in e.tolist():
        end[i] = i
    kept: list[tuple[int, int, int]] = []
    for i in np.argsort(w, kind="stable").tolist():
        p, q = int(x[i]), int(y[i])
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p == q:
            continue
        if end[p] >= 0 and end[q] >= 0:
            kept.append((end[p], end[q], i))
        root[q] = p
        end[p] = end[p] if end[p] >= 0 else end[q]
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    p, q, i = np.array(kept).T
    return names[p], names[q], w[i]


def spills(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, level): the least highest weight on a way to OUT; infinite without one."""
    names, place = np.unique(np.concatenate([a, b, [OUT]]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) : 2 * len(a)]
    source, target, weight = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([w, w])
    order = np.argsort(source, kind="stable")
    begin = np.searchsorted(source[order], np.arange(len(names) + 1)).tolist()
    target, weight = target[order].tolist(), weight[order].tolist()
    level = [np.inf] * len(names)
    level[int(place[-1])] = -np.inf
    heap = [(-np.inf, int(place[-1]))]
    while heap:
        v, i = heapq.heappop(heap)
        if v > level[i]:
            continue
        for k in range(begin[i], begin[i + 1]):
            j, new = target[k], max(v, weight[k])
            if new < level[j]:
                level[j] = new
                heapq.heappush(heap, (new, j))
    return names, np.array(level)


def _edge_labels(block: Block, cols: int) -> dict:
    """A tile's reduced graph and, as rows with ``r``, its edge cells with their catchments."""
    label, a, b, w = catchments(block, cols)
    rim = np.zeros_like(label, bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    rim &= label != -2
    r, c = np.nonzero(rim)
    a, b, w = reduced(a, b, w, np.append(np.unique(label[rim]), OUT))
    no = [None] * len(a)
    return {
        "run": [block.keys["run"]] * (len(a) + len(r)), "a": np.concatenate([a, label[rim]]), "b": pa.concat_arrays([pa.array(b, pa.int64()), pa.nulls(len(r), pa.int64())]),
        "w": np.concatenate([w, block.own(block.arrays["z"])[rim]]),
        "r": pa.concat_arrays([pa.array(no, pa.int32()), pa.array(r + block.r0, pa.int32())]), "c": pa.concat_arrays([pa.array(no, pa.int32()), pa.array(c + block.c0, pa.int32())]),
    }


def _group(node: str, cols: int, side: int):
    """The group of tiles that a node lies in; null for OUT."""
    at = lambda x: F.when(F.col(node) >= 0, F.floor(x / side).cast("int"))
    return F.struct(at(F.floor(F.col(node) / cols)).alias("tr"), at(F.pmod(F.col(node), F.lit(cols))).alias("tc"))


def _by_group(edges: DataFrame, cols: int, side: int) -> DataFrame:
    placed = edges.withColumn("ga", _group("a", cols, side)).withColumn("gb", _group("b", cols, side))
    inside = (F.col("a") < 0) | (F.col("b") < 0) | (F.col("ga") == F.col("gb"))
    return placed.withColumn("inside", inside).withColumn("g", F.when(F.col("a") < 0, F.col("gb")).otherwise(F.col("ga")))


def _columns(t: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    return t.column("run")[0].as_py(), t.column("a").to_numpy(), t.column("b").to_numpy(), t.column("w").to_numpy()


def _reduce_group(t: pa.Table) -> pa.Table:
    """Edges of a group and its ends (a = b) to the reduced edges."""
    run, a, b, w = _columns(t)
    end = a == b
    a2, b2, w2 = reduced(a[~end], b[~end], w[~end], np.append(a[end], OUT))
    return as_table({"run": [run] * len(a2), "a": a2, "b": b2, "w": w2}, EDGE_ROWS)


def _spill_group(t: pa.Table) -> pa.Table:
    run, a, b, w = _columns(t)
    node, level = spills(a, b, w)
    return as_table({"run": [run] * len(node), "a": node, "b": np.full(len(node), OUT), "w": level}, EDGE_ROWS)


def spill_levels(cells: DataFrame, grid: GridMeta, tile: int) -> DataFrame:
    """cells(run, r, c, z) -> (run, a: catchment, b: OUT, w: its level) for the catchments at tiles' edges."""
    cols = grid.cols
    out = settle(tile_map(cells, grid, lambda b: _edge_labels(b, cols), f"{EDGES}, r int, c int", tile, 1, keys=("run",)), "tile-graphs")
    rim = out.where("r is not null").select("run", "r", "c", "a", "w")
    tr, tc = F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)
    near = F.array(*(F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1))))
    ahead = rim.select("run", F.col("a").alias("b"), F.col("w").alias("v"), tr.alias("tr"), tc.alias("tc"), F.explode(near).alias("n")).select("run", "b", "v", "tr", "tc", "n.r", "n.c")
    ahead = ahead.where((F.floor(F.col("r") / tile) != F.col("tr")) | (F.floor(F.col("c") / tile) != F.col("tc")))
    across = rim.join(ahead, ["run", "r", "c"]).groupBy("run", "a", "b").agg(F.min(F.greatest("w", "v")).alias("w"))
    edges = settle(out.where("b is not null").select("run", "a", "b", "w").unionByName(across), "tile-edges")
    side, inner = tile * GROUP, []
    while side < max(grid.rows, grid.cols):
        placed = settle(_by_group(edges, cols, side), "groups")
        inside, crossing = placed.where("inside"), placed.where("not inside")
        ends = crossing.select("run", F.explode(F.array(F.struct("a", F.col("ga").alias("g")), F.struct(F.col("b").alias("a"), F.col("gb").alias("g")))).alias("e")).select("run", "e.g", "e.a").distinct()
        rows = inside.select("run", "g", "a", "b", "w").unionByName(ends.select("run", "g", "a", F.col("a").alias("b"), F.lit(0.0).alias("w")))
        inner.append((inside.select("run", "g", "a", "b", "w"), side))
        less = rows.groupBy("run", "g").applyInArrow(_reduce_group, EDGES)
        edges = settle(less.unionByName(crossing.select("run", "a", "b", "w")), "groups-reduced")
        side *= GROUP
    levels = settle(edges.groupBy("run").applyInArrow(_spill_group, EDGES), "spills").where(F.col("a") >= 0)
    for inside, size in reversed(inner):
        known = levels.select("run", _group("a", cols, size).alias("g"), "a", "b", "w")
        levels = settle(inside.unionByName(known).groupBy("run", "g").applyInArrow(_spill_group, EDGES), "spills").where(F.col("a") >= 0)
    return levels


def filled(cells: DataFrame, grid: GridMeta, tile: int = TILE) -> DataFrame:
    """cells(run, r, c, z without nulls) -> (run, r, c, z, w): w is the lowest level over which a cell drains to a seed.

    Seeds are cells at the grid's edge or beside a place without data. Cells that no seed reaches do not exist.
    """
    cols = grid.cols
    levels = spill_levels(cells, grid, tile).select("run", "a", "w", F.floor(F.floor(F.col("a") / cols) / tile).cast("int").alias("tr"), F.floor(F.pmod(F.col("a"), F.lit(cols)) / tile).cast("int").alias("tc"))

    def kernel(block: Block, known: pa.Table) -> dict:
        label, a, b, w = catchments(block, cols)
        k = known.column("a").to_numpy() if known.num_rows else np.zeros(0, np.int64)
        node, level = spills(np.append(a, k), np.append(b, np.full(len(k), OUT)), np.append(w, known.column("w").to_numpy() if known.num_rows else []))
        z = block.own(block.arrays["z"])
        data = ~np.isnan(z)
        raised = np.where(data, np.maximum(np.where(data, z, 0), level[np.searchsorted(node, np.where(data, label, OUT))]), np.nan)
        rows = block.rows(data, z=z, w=raised)
        return {"run": [block.keys["run"]] * len(rows["r"])} | rows

    return tile_map_with(cells, levels, grid, kernel, "run int, r int, c int, z double, w double", tile, 1, keys=("run",))
