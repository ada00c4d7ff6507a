"""Pointer doubling over a forest: each node has one receiver (``ptr``) or none.

A round joins a node with what lies as far below it as it has looked so far, so the rounds are the
logarithm of the longest path, whatever its length. Nodes without a receiver left are done: they are
looked up by others, but take no part in joins themselves, so no null keys gather in one partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.plans.blocks import arrow_schema
from rillwork.plans.store import settle

#: Forests of no more nodes (counted) are solved by one task, at some 100 bytes a node; larger ones by rounds of joins.
SMALL = 1 << 20


class Cycle(ValueError):
    """The receivers hold a cycle, so some paths have no end."""


def _turns(state: DataFrame) -> range:
    """As many rounds as the longest path can take, if it ends."""
    return range(state.where("ptr is not null").count().bit_length() + 1)


def _ordered(node: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """For each node the place of its receiver (-1 without one in the table), and the places from the ends up; None on cycles."""
    by_node = np.argsort(node, kind="stable")
    at = np.minimum(np.searchsorted(node, ptr, sorter=by_node), len(node) - 1)
    to = np.where((ptr >= 0) & (node[by_node[at]] == ptr), by_node[at], -1)
    depth, far = (to >= 0).astype(np.int64), to.copy()
    for _ in range(len(node).bit_length() + 1):
        if (far < 0).all():
            return to, np.argsort(depth, kind="stable")
        depth += np.where(far >= 0, depth[far], 0)
        far = np.where(far >= 0, far[far], -1)
    return None


def _in_one_task(state: DataFrame, solve: Callable[[dict, list, list], dict], schema: str) -> DataFrame:
    """state(node, ptr, values), small and written: ``solve`` gets the columns as lists, receivers' places and the places from the ends up."""
    target = arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        ordered = _ordered(t.column("node").to_numpy(), t.column("ptr").fill_null(-1).to_numpy())
        if ordered is None:
            return target.empty_table()
        out = solve({n: t.column(n).to_pylist() for n in t.column_names}, ordered[0].tolist(), ordered[1].tolist())
        return pa.Table.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)

    out = settle(state.withColumn("__one", F.lit(0)).groupBy("__one").applyInArrow(run, schema), "solved")
    if out.isEmpty() and not state.isEmpty():
        raise Cycle("the flow directions hold a cycle")
    return out


def _typed(state: DataFrame, *names: str) -> str:
    return ", ".join(f"{n} {state.schema[n].dataType.simpleString()}" for n in names)


def cycle_nodes(nodes: DataFrame) -> DataFrame:
    """nodes(node, ptr) -> (node) of those on cycles: after so many steps every path without an end is on its cycle."""
    state = settle(nodes.where("ptr is not null").select("node", "ptr"), "paths")
    for _ in _turns(state):
        state = settle(state.join(state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next")), "ptr").select("node", F.col("next").alias("ptr")), "paths")
    return state.select(F.col("ptr").alias("node")).distinct()


def _rounds(state: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """``step``(nodes on their way, all nodes) gives the former anew; all nodes where none is on its way."""
    state = settle(state, "paths")
    for _ in _turns(state):
        moving = state.where("ptr is not null")
        if moving.isEmpty():
            return state
        state = settle(step(moving, state).unionByName(state.where("ptr is null")), "paths")
    raise Cycle("the flow directions hold a cycle")


def downstream(nodes: DataFrame, combine: dict[str, Callable[[Column, Column], Column]], plain: dict[str, Callable] | None = None) -> DataFrame:
    """nodes(node, ptr, values): each value combined with those of the whole path below it, nearest first.

    ``plain`` does to two Python values, or None, what ``combine`` does to columns; with it small forests take one task.
    """
    if plain:
        nodes = settle(nodes.select("node", "ptr", *combine), "paths")
        if nodes.count() <= SMALL:

            def solve(columns: dict, to: list, order: list) -> dict:
                for name, f in plain.items():
                    v = columns[name]
                    for i in order:
                        if to[i] >= 0:
                            v[i] = f(v[i], v[to[i]])
                return columns | {"ptr": [None] * len(to)}

            return _in_one_task(nodes, solve, _typed(nodes, "node", "ptr", *combine))

    def step(moving: DataFrame, every: DataFrame) -> DataFrame:
        below = every.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), *(F.col(v).alias(f"below_{v}") for v in combine))
        return moving.join(below, "ptr", "left").select("node", F.col("next").alias("ptr"), *(f(F.col(v), F.col(f"below_{v}")).alias(v) for v, f in combine.items()))

    return _rounds(nodes.select("node", "ptr", *combine), step)


def _with_above(state: DataFrame, value: str, more: Column, merge: Callable[[Column, Column], Column], gather: Callable[[Column], Column]) -> DataFrame:
    """state with ``value`` merged with what the nodes that point at a node have gathered."""
    above = state.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(gather(more).alias("more"))
    return state.join(above, "node", "left").withColumn(value, merge(F.col(value), F.col("more"))).drop("more")


def _upstream(nodes: DataFrame, value: str, more: Column, merge: Callable[[Column, Column], Column], gather: Callable[[Column], Column], ways: tuple[str, ...] = ()) -> DataFrame:
    """Rounds in which each node takes what points at it, then points as far again; ``ways`` add up along."""
    state = settle(nodes, "paths")
    for _ in _turns(state):
        if state.where("ptr is not null").isEmpty():
            return state
        taken = _with_above(state, value, more, merge, gather)
        nxt = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("next"), *(F.col(w).alias(f"next_{w}") for w in ways))
        moving = taken.where("ptr is not null").join(nxt, "ptr", "left")
        moved = moving.select("node", F.col("next").alias("ptr"), value, *((F.col(w) + F.coalesce(f"next_{w}", F.lit(0.0))).alias(w) for w in ways))
        state = settle(moved.unionByName(taken.where("ptr is null").select("node", "ptr", value, *ways)), "paths")
    raise Cycle("the flow directions hold a cycle")


def upstream_sum(nodes: DataFrame) -> DataFrame:
    """nodes(node, ptr, w) -> (node, w): w summed over a node and all that lies above it."""
    nodes = settle(nodes.select("node", "ptr", "w"), "paths")
    if nodes.count() <= SMALL:

        def solve(columns: dict, to: list, order: list) -> dict:
            w = columns["w"]
            for i in reversed(order):
                if to[i] >= 0:
                    w[to[i]] += w[i]
            return {"node": columns["node"], "w": w}

        return _in_one_task(nodes, solve, _typed(nodes, "node", "w"))
    merge = lambda mine, more: mine + F.coalesce(more, F.lit(0))
    return _upstream(nodes, "w", F.col("w"), merge, F.sum).select("node", "w")


def upstream_length(nodes: DataFrame) -> DataFrame:
    """nodes(node, ptr, d: length of the step to ptr, and length to start from, or 0) -> (node, length): the longest path from above."""
    start = F.col("length") if "length" in nodes.columns else F.lit(0.0)
    rows = settle(nodes.select("node", "ptr", start.alias("length"), "d"), "paths")
    if rows.count() <= SMALL:

        def solve(columns: dict, to: list, order: list) -> dict:
            length, d = columns["length"], columns["d"]
            for i in reversed(order):
                if to[i] >= 0 and d[i] is not None:
                    length[to[i]] = max(length[to[i]], length[i] + d[i])
            return {"node": columns["node"], "length": length}

        return _in_one_task(rows, solve, _typed(rows, "node", "length"))
    return _upstream(rows, "length", F.col("d") + F.col("length"), lambda mine, more: F.greatest(mine, more), F.max, ("d",)).select("node", "length")


def pass_down(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(node, w), edges(node, to, p) -> (node, acc): what arrives at each node when all pass on p of (own + arrived).

    Nodes pass on once all their inflows have, so a round is one step of the longest path; done nodes
    leave the working table. Nodes on cycles never pass anything on.
    """
    need = edges.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("need"))
    state = settle(nodes.join(need, "node", "left").select("node", "w", F.coalesce("need", F.lit(0)).alias("need"), F.lit(0.0).alias("acc")), "waiting")
    done = []
    while not (ready := state.where("need = 0")).isEmpty():
        done.append(ready)
        sent = ready.join(edges, "node").groupBy(F.col("to").alias("node")).agg(F.count("*").alias("came"), F.sum((F.col("w") + F.col("acc")) * F.col("p")).alias("more"))
        left = state.where("need > 0").join(sent, "node", "left")
        state = settle(left.select("node", "w", (F.col("need") - F.coalesce("came", F.lit(0))).alias("need"), (F.col("acc") + F.coalesce("more", F.lit(0.0))).alias("acc")), "waiting")
    out = state
    for part in done:
        out = out.unionByName(part)
    return out.select("node", "acc")
