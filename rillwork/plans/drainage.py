"""Single-receiver drainage over tiles: contract each tile to its exits, work on the exits, expand again.

In a tile every cell leads to one last cell: an end, or an exit whose receiver lies in another tile. Exits form a
forest of their own, smaller by the tile's side, on which ``plans.doubling`` works; a second pass over
the tiles brings its results to all cells. Cells on a cycle inside a tile give nothing on.
Node numbers travel as doubles inside kernels, exact up to 2 ** 53.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.plans.arrays import Blocks
from rillwork.plans.blocks import TILE, Block, arrow_schema, tile_map, tile_map_with
from rillwork.plans.doubling import Cycle, cycle_nodes, downstream, upstream_length, upstream_sum
from rillwork.plans.store import settle


@dataclass
class Tree:
    """Own cells by place: receiver inside the tile (itself at a last cell), last cell, steps to it, receiver's node outside (or -1), step's code."""

    to: np.ndarray
    last: np.ndarray
    depth: np.ndarray
    target: np.ndarray
    code: np.ndarray
    node: np.ndarray

    def levels(self) -> list[np.ndarray]:
        """The cells that flow on inside the tile, those farthest from their last cell first."""
        order = np.argsort(-self.depth, kind="stable")
        order = order[: int((self.depth > 0).sum())]
        cuts = np.flatnonzero(np.diff(self.depth[order])) + 1
        return np.split(order, cuts) if len(order) else []


def tree_of(block: Block, grid: GridMeta) -> Tree:
    t = block.tile
    code = block.own(block.arrays["dir"]).ravel()
    have = block.own(block.have).ravel()
    r, c = np.divmod(np.arange(t * t), t)
    flows = have & (code >= 0) & (code <= 7)
    k = np.where(flows, code, 0).astype(int)
    nr, nc = r + np.array(DR)[k], c + np.array(DC)[k]
    flows &= (nr + block.r0 >= 0) & (nr + block.r0 < grid.rows) & (nc + block.c0 >= 0) & (nc + block.c0 < grid.cols)
    inside = flows & (nr >= 0) & (nr < t) & (nc >= 0) & (nc < t)
    at = np.where(inside, nr * t + nc, 0)
    inside &= have[at]
    place = np.arange(t * t)
    to = np.where(inside, at, place)
    last, depth = _jumped(to)
    looping = to[last] != last
    if looping.any():
        to[np.unique(last[looping])] = np.unique(last[looping])
        last, depth = _jumped(to)
    node = (r + block.r0).astype(np.int64) * grid.cols + c + block.c0
    outside = (nr < 0) | (nr >= t) | (nc < 0) | (nc >= t)
    target = np.where(flows & outside, (nr + block.r0).astype(np.int64) * grid.cols + nc + block.c0, -1)
    return Tree(to, last, depth, target, np.where(flows, k, -1), node)


def _jumped(to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    last, depth = to.copy(), (to != np.arange(len(to))).astype(np.int64)
    for _ in range(int(np.ceil(np.log2(max(2, len(to))))) + 1):
        further = last[last]
        if (further == last).all():
            break
        depth += depth[last]
        last = further
    return last, depth


def _rim(block: Block) -> np.ndarray:
    t = block.tile
    rim = np.zeros((t, t), bool)
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    return np.flatnonzero((rim & block.own(block.have)).ravel())


RIM = "node bigint, last bigint, target bigint, code int"


def _rim_rows(block: Block, tree: Tree, **values: np.ndarray) -> dict:
    """Rim cells: their last cell, and of exits the receiver outside; values by place."""
    rim = _rim(block)
    target = tree.target[rim]
    return {"node": tree.node[rim], "last": tree.node[tree.last[rim]], "target": pa.array(target, mask=target < 0), "code": tree.code[rim]} | {n: v[rim] for n, v in values.items()}


def _exits(rim: DataFrame, *values: str) -> DataFrame:
    """(node, ptr: the exit that the receiver's path leaves its tile by, or null; entry: the receiver; its values) for each exit."""
    exits = rim.where("target is not null").select("node", "code", F.col("target").alias("entry"))
    entered = rim.select(F.col("node").alias("entry"), F.col("last").alias("__last"), *(F.col(v).alias(f"entry_{v}") for v in values))
    leaving = exits.select(F.col("node").alias("__last"), F.col("node").alias("ptr"))
    return exits.join(entered, "entry", "left").join(leaving, "__last", "left").drop("__last")


def _placed(rows: DataFrame, node: str, grid: GridMeta, tile: int) -> DataFrame:
    at = lambda x: F.floor(x / tile).cast("int")
    return rows.withColumn("tr", at(F.floor(F.col(node) / grid.cols))).withColumn("tc", at(F.pmod(F.col(node), F.lit(grid.cols))))


def _scatter(block: Block, grid: GridMeta, node: np.ndarray) -> np.ndarray:
    return (node // grid.cols - block.r0) * block.tile + node % grid.cols - block.c0


def without_cycles(operator):
    """Where paths run in circles, cells on a cycle give nothing on: the operator is repeated without their directions."""

    @wraps(operator)
    def run(directions: DataFrame, grid: GridMeta, *args, **options) -> DataFrame:
        try:
            return operator(directions, grid, *args, **options)
        except Cycle:
            if isinstance(directions, Blocks):
                directions = directions.cells().withColumn("w", F.lit(1.0))
            codes = F.col("dir").cast("int") + 1
            dr, dc = (F.element_at(F.array(*(F.lit(x) for x in s)), codes) for s in (DR, DC))
            there = F.when(F.col("dir").between(0, 7) & grid.inside(F.col("r") + dr, F.col("c") + dc), grid.node(F.col("r") + dr, F.col("c") + dc))
            nodes = directions.select(grid.node(F.col("r"), F.col("c")).alias("node"), there.alias("ptr"))
            looping = settle(cycle_nodes(nodes).withColumn("loops", F.lit(True)), "cycles")
            cut = directions.withColumn("node", grid.node(F.col("r"), F.col("c"))).join(looping, "node", "left")
            return operator(cut.withColumn("dir", F.when(F.col("loops").isNull(), F.col("dir"))).drop("node", "loops"), grid, *args, **options)

    return run


@without_cycles
def upstream_totals(directions: DataFrame, grid: GridMeta, tile: int = TILE) -> DataFrame:
    """directions(r, c, dir, w) -> (r, c, acc): the sum of w over all cells strictly upstream.

    Directions as blocks (named dir; written, since both passes read them) weigh 1 a cell.
    """
    packed = isinstance(directions, Blocks)
    if packed:
        columns, tile = ("dir",), directions.tile
    else:
        columns, directions = ("dir", "w"), settle(directions, "directions")

    def summed(tree: Tree, w: np.ndarray) -> np.ndarray:
        total = w.copy()
        for cells in tree.levels():
            np.add.at(total, tree.to[cells], total[cells])
        return total

    def weights(block: Block) -> np.ndarray:
        return (block.own(block.have).astype(float) if packed else np.nan_to_num(block.own(block.arrays["w"]))).ravel()

    def contract(block: Block) -> dict:
        tree = tree_of(block, grid)
        return _rim_rows(block, tree, w=summed(tree, weights(block)))

    def expand(block: Block, entries: pa.Table) -> dict:
        tree, own = tree_of(block, grid), weights(block)
        w = own.copy()
        if entries.num_rows:
            w[_scatter(block, grid, entries.column("entry").to_numpy())] += entries.column("w").to_numpy()
        acc = (summed(tree, w) - own).reshape(tile, tile)
        return block.rows(block.own(block.have), acc=acc)

    rim = settle(tile_map(directions, grid, contract, f"{RIM}, w double", tile, columns=columns), "tile-exits")
    exits = settle(_exits(rim).join(rim.select("node", "w"), "node"), "exits")
    total = upstream_sum(exits.select("node", "ptr", "w"))
    entries = exits.select("node", "entry").join(total, "node").groupBy("entry").agg(F.sum("w").alias("w"))
    return tile_map_with(directions, _placed(entries, "entry", grid, tile), grid, expand, "r int, c int, acc double", tile, columns=columns)


@without_cycles
def upstream_lengths(directions: DataFrame, grid: GridMeta, tile: int = TILE) -> DataFrame:
    """directions(r, c, dir) -> (r, c, length): the longest path from above, by steps of the grid."""
    directions = settle(directions, "directions")
    side, corner = grid.step(0), grid.step(1)
    step_of = lambda code: np.where(code < 0, 0.0, np.where(code % 2 == 0, side, corner))

    def longest(tree: Tree, start: np.ndarray) -> np.ndarray:
        length, step = start.copy(), step_of(tree.code)
        for cells in tree.levels():
            np.maximum.at(length, tree.to[cells], length[cells] + step[cells])
        return length

    def to_last(tree: Tree) -> np.ndarray:
        way, step = np.zeros(len(tree.to)), step_of(tree.code)
        for cells in reversed(tree.levels()):
            way[cells] = way[tree.to[cells]] + step[cells]
        return way

    def contract(block: Block) -> dict:
        tree = tree_of(block, grid)
        return _rim_rows(block, tree, length=longest(tree, np.zeros(tile * tile)), way=to_last(tree))

    def expand(block: Block, entries: pa.Table) -> dict:
        start = np.zeros(tile * tile)
        if entries.num_rows:
            start[_scatter(block, grid, entries.column("entry").to_numpy())] = entries.column("length").to_numpy()
        return block.rows(block.own(block.have), length=longest(tree_of(block, grid), start).reshape(tile, tile))

    rim = settle(tile_map(directions, grid, contract, f"{RIM}, length double, way double", tile, columns=("dir",)), "tile-exits")
    step = F.when(F.col("code") % 2 == 0, side).otherwise(corner)
    exits = settle(_exits(rim, "way").join(rim.select("node", "length"), "node").withColumn("step", step), "exits")
    far = upstream_length(exits.select("node", "ptr", (F.col("step") + F.coalesce("entry_way", F.lit(0.0))).alias("d"), "length"))
    entries = exits.select("node", "entry", "step").join(far, "node").groupBy("entry").agg(F.max(F.col("length") + F.col("step")).alias("length"))
    return tile_map_with(directions, _placed(entries, "entry", grid, tile), grid, expand, "r int, c int, length double", tile, columns=("dir",))


@without_cycles
def along_paths(directions: DataFrame, grid: GridMeta, least: bool = False, tile: int = TILE) -> DataFrame:
    """directions(r, c, dir, v) -> (r, c, v): the first v on the path from a cell on, itself included, or the least; null without one."""
    directions = settle(directions, "directions")
    columns = ("dir", "v")

    def combine(mine: np.ndarray, below: np.ndarray) -> np.ndarray:
        return np.fmin(mine, below) if least else np.where(np.isnan(mine), below, mine)

    def found(tree: Tree, v: np.ndarray) -> np.ndarray:
        out = v.copy()
        for cells in reversed(tree.levels()):
            out[cells] = combine(out[cells], out[tree.to[cells]])
        return out

    def contract(block: Block) -> dict:
        tree = tree_of(block, grid)
        v = found(tree, block.own(block.arrays["v"]).ravel())
        return _rim_rows(block, tree, v=v)

    def expand(block: Block, beyond: pa.Table) -> dict:
        tree, v = tree_of(block, grid), block.own(block.arrays["v"]).ravel().copy()
        if beyond.num_rows:
            at = _scatter(block, grid, beyond.column("node").to_numpy())
            v[at] = combine(v[at], beyond.column("v").cast(pa.float64()).to_numpy(zero_copy_only=False))
        return block.rows(block.own(block.have), v=found(tree, v).reshape(tile, tile))

    both = (lambda mine, below: F.least(mine, below)) if least else (lambda mine, below: F.coalesce(mine, below))
    rim = settle(tile_map(directions, grid, contract, f"{RIM}, v double", tile, columns=columns), "tile-exits")
    rim = rim.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    exits = settle(_exits(rim, "v").select("node", "ptr", F.col("entry_v").alias("v")), "exits")
    plain = (lambda mine, below: below if mine is None else mine if below is None else min(mine, below)) if least else (lambda mine, below: below if mine is None else mine)
    beyond = downstream(exits, {"v": both}, {"v": plain}).where("v is not null").select("node", "v")
    return tile_map_with(directions, _placed(beyond, "node", grid, tile), grid, expand, "r int, c int, v double", tile, columns=columns)


def passed_down(cells: DataFrame, edges: DataFrame, grid: GridMeta, tile: int = TILE) -> DataFrame:
    """cells(r, c, w), edges(node, to, p) -> (r, c, acc): what arrives when all pass on p of (own + arrived).

    A cell passes on once all its inflows have arrived. A round takes every tile as far as that goes inside it and
    sends what crosses its edge on, so rounds are the tiles that the longest path goes through; only tiles that
    something has come to are worked on. Cells on cycles never pass anything on.
    """
    need = edges.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("need"))
    out = edges.groupBy("node").agg(F.collect_list(F.struct("to", "p")).alias("out"))
    rows = cells.select(grid.node(F.col("r"), F.col("c")).alias("node"), F.col("w").cast("double").alias("w"))
    rows = settle(rows.join(need, "node", "left").join(out, "node", "left"), "cells")  # read again by every round
    # state: 0 waiting, 1 passed on; arrived: inflows so far
    state = _placed(rows, "node", grid, tile).select("tr", "tc", "node", "w", F.coalesce("need", F.lit(0)).cast("int").alias("need"), F.lit(0.0).alias("acc"), F.lit(False).alias("done"), "out")
    schema = "tr int, tc int, node bigint, w double, need int, acc double, done boolean, out array<struct<to:bigint,p:double>>, sent array<struct<to:bigint,v:double,n:int>>"
    state, target = settle(state, "waiting"), arrow_schema(schema)

    def work(t: pa.Table, came: pa.Table) -> pa.Table:
        if not t.num_rows:
            return target.empty_table()
        t = t.sort_by("node")
        node, w = t.column("node").to_numpy(), t.column("w").to_numpy()
        need, acc, done = t.column("need").to_numpy().copy(), t.column("acc").to_numpy().copy(), t.column("done").to_numpy(zero_copy_only=False).copy()
        if came.num_rows:
            at = np.searchsorted(node, came.column("node").to_numpy())
            np.add.at(acc, at, came.column("v").to_numpy())
            np.subtract.at(need, at, came.column("n").to_numpy())
        lists = t.column("out").combine_chunks()
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        flat = lists.flatten()
        to, p = flat.field("to").to_numpy(), flat.field("p").to_numpy()
        begin = np.cumsum(sizes) - sizes
        place = np.minimum(np.searchsorted(node, to), len(node) - 1)
        local = node[place] == to
        over_to, over_v = [], []
        ready = np.flatnonzero((need == 0) & ~done)
        while len(ready):
            done[ready] = True
            n = sizes[ready]
            e = np.repeat(begin[ready] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            v = np.repeat(w[ready] + acc[ready], n) * p[e]
            inner = local[e]
            np.add.at(acc, place[e[inner]], v[inner])
            np.subtract.at(need, place[e[inner]], 1)
            over_to.append(to[e[~inner]]), over_v.append(v[~inner])
            hit = np.unique(place[e[inner]])
            ready = hit[(need[hit] == 0) & ~done[hit]]
        far, far_v = (np.concatenate(x) if x else np.zeros(0) for x in (over_to, over_v))
        names, which = np.unique(far, return_inverse=True)
        sums, counts = np.zeros(len(names)), np.bincount(which, minlength=len(names))
        np.add.at(sums, which, far_v)
        sent = pa.StructArray.from_arrays([pa.array(names.astype(np.int64)), pa.array(sums), pa.array(counts.astype(np.int32))], names=["to", "v", "n"])
        offsets = np.concatenate([[0], np.full(len(node), len(names))]).astype(np.int32)  # all on the first row
        columns = [t.column("tr"), t.column("tc"), t.column("node"), t.column("w"), pa.array(need, pa.int32()), pa.array(acc), pa.array(done), lists, pa.ListArray.from_arrays(pa.array(offsets), sent)]
        return pa.Table.from_arrays([x.cast(f.type) for x, f in zip(columns, target, strict=True)], schema=target)

    sent = state.select("tr", "tc", "node", F.lit(0.0).alias("v"), F.lit(0).alias("n")).where("false")
    first = True
    while True:
        busy = F.broadcast(sent.select("tr", "tc").distinct())
        active = state if first else state.join(busy, ["tr", "tc"], "left_semi")
        moved = settle(active.groupBy("tr", "tc").cogroup(sent.groupBy("tr", "tc")).applyInArrow(work, schema), "passed")
        kept = moved.drop("sent") if first else moved.drop("sent").unionByName(state.join(busy, ["tr", "tc"], "left_anti"))
        crossing = moved.where("size(sent) > 0").select(F.explode("sent").alias("s")).groupBy(F.col("s.to").alias("node")).agg(F.sum("s.v").alias("v"), F.sum("s.n").cast("int").alias("n"))
        # places without a row take nothing
        sent = settle(_placed(crossing, "node", grid, tile).select("tr", "tc", "node", "v", "n").join(rows.select("node"), "node", "left_semi").select("tr", "tc", "node", "v", "n"), "crossing")
        if sent.isEmpty():
            break
        state, first = settle(kept, "waiting"), False
    return kept.select(F.floor(F.col("node") / grid.cols).cast("int").alias("r"), F.pmod(F.col("node"), F.lit(grid.cols)).cast("int").alias("c"), "acc")
