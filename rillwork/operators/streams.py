"""Stream orders, stems and pruning on the forest of stream cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.routing import forest, numbered
from rillwork.plans.doubling import downstream, upstream_length, upstream_sum
from rillwork.plans.store import settle


def stream_forest(directions: DataFrame, stream_cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(node, r, c, dir, ptr) of the stream cells; ptr is null where the water leaves the streams."""
    nodes = forest(directions.join(stream_cells.where("stream").select("r", "c"), ["r", "c"]), grid)
    on = nodes.select(F.col("node").alias("ptr"), F.lit(True).alias("on"))
    return settle(nodes.join(on, "ptr", "left").withColumn("ptr", F.when(F.col("on"), F.col("ptr"))).select("node", "r", "c", "dir", "ptr"), "stream-forest")


def inflows(nodes: DataFrame) -> DataFrame:
    """nodes with ``inflow``: how many nodes flow into each."""
    fed = nodes.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.count("*").alias("inflow"))
    return nodes.join(fed, "node", "left").fillna(0, ["inflow"])


def shreve(nodes: DataFrame) -> DataFrame:
    """(node, magnitude): the heads upstream, itself included."""
    heads = inflows(nodes).select("node", "ptr", (F.col("inflow") == 0).cast("bigint").alias("w"))
    return upstream_sum(heads).withColumnRenamed("w", "magnitude")


def strahler(nodes: DataFrame) -> DataFrame:
    """(node, strahler). What has no confluence above it in the remaining forest has the lowest order left; it is taken away and the rest
    looked at again, so there are as many turns as orders, whatever the streams' length."""
    left, parts, order = nodes.select("node", "ptr"), [], 1
    while not left.isEmpty():
        marked = settle(inflows(left).select("node", "ptr", (F.col("inflow") >= 2).cast("bigint").alias("w")), "orders")
        found = settle(marked.select("node", "ptr").join(upstream_sum(marked), "node"), "orders")
        parts.append(found.where("w = 0").select("node", F.lit(order).cast("bigint").alias("strahler")))
        left, order = found.where("w > 0").select("node", "ptr"), order + 1
    out = parts[0] if parts else nodes.select("node", F.lit(1).cast("bigint").alias("strahler"))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stems(nodes: DataFrame) -> DataFrame:
    """(node, ptr, length, stem): steps from the farthest head, and whether the node is its receiver's longest inflow, the lower node on ties."""
    far = nodes.select("node", "ptr").join(upstream_length(nodes.select("node", "ptr", F.when(F.col("ptr").isNull(), 0.0).otherwise(1.0).alias("d"))), "node")
    best = far.where("ptr is not null").groupBy("ptr").agg(F.max(F.struct("length", (-F.col("node")).alias("node"))).alias("b")).select("ptr", (-F.col("b.node")).alias("chosen"))
    return settle(far.join(best, "ptr", "left").select("node", "ptr", "length", F.coalesce(F.col("chosen") == F.col("node"), F.lit(False)).alias("stem")), "stems")


def hack(nodes: DataFrame) -> DataFrame:
    """(node, hack): 1 on main stems, one more with each branching off a stem."""
    turns = stems(nodes).select("node", "ptr", (F.col("ptr").isNotNull() & ~F.col("stem")).cast("bigint").alias("turns"))
    return downstream(turns, {"turns": lambda mine, below: mine + below}).select("node", (F.col("turns") + 1).alias("hack"))


def stem_roots(stemmed: DataFrame) -> DataFrame:
    """(node, root): the lowest cell of the stem that a node lies on."""
    cut = stemmed.select("node", F.when(F.col("stem"), F.col("ptr")).alias("ptr"), F.col("node").alias("root"))
    return downstream(cut, {"root": lambda mine, below: F.coalesce(below, mine)}).select("node", "root")


def horton(nodes: DataFrame) -> DataFrame:
    """(node, horton): the Strahler order at the lowest cell of the node's stem."""
    low = strahler(nodes).select(F.col("node").alias("root"), F.col("strahler").alias("horton"))
    return stem_roots(stems(nodes)).join(low, "root").select("node", "horton")


def order(nodes: DataFrame, method: str = "strahler") -> DataFrame:
    """The stream order by name: strahler, shreve, horton or hack."""
    methods = {"strahler": strahler, "shreve": shreve, "horton": horton, "hack": hack}
    if method not in methods:
        raise ValueError(f"method is one of {[*methods]}")
    return methods[method](nodes)


def main_stem(nodes: DataFrame, outlet: int | None = None) -> DataFrame:
    """(node) of the stem from the outlet with the longest way from above, the lower node on ties; or of the stem that ends at the node ``outlet``.

    An outlet that is no stream cell has no stem.
    """
    if outlet is not None:
        ended = nodes.withColumn("ptr", F.when(F.col("node") != outlet, F.col("ptr")))
        return stem_roots(stems(ended)).where(F.col("root") == outlet).select("node")
    stemmed = stems(nodes)
    outlet = stemmed.where("ptr is null").agg(F.max(F.struct("length", (-F.col("node")).alias("node"))).alias("b")).select((-F.col("b.node")).alias("root"))
    return stem_roots(stemmed).join(F.broadcast(outlet), "root", "left_semi").select("node")


def prune_short(nodes: DataFrame, grid: GridMeta, min_length: float) -> DataFrame:
    """(node) without the links from a head that are shorter than ``min_length``, the step into the confluence included."""
    step = F.when(F.col("ptr").isNull(), 0.0).when(F.col("dir") % 2 == 0, grid.step(0)).otherwise(grid.step(1))
    marked = settle(inflows(nodes).select("node", "ptr", step.alias("d"), (F.col("inflow") >= 2).cast("bigint").alias("w")), "links")
    links = settle(marked.drop("w").join(upstream_sum(marked), "node"), "links")
    head = links.where("w = 0").select("node", "ptr", "d")
    on = head.select(F.col("node").alias("ptr"), F.lit(True).alias("on"))
    chain = settle(head.join(on, "ptr", "left").select("node", F.when(F.col("on"), F.col("ptr")).alias("ptr"), "d"), "links")
    total = downstream(chain, {"d": lambda mine, below: mine + below}).join(upstream_length(chain).withColumnRenamed("length", "above"), "node")
    return links.where("w > 0").select("node").unionByName(total.where(F.col("d") + F.col("above") >= min_length).select("node"))


def links(nodes: DataFrame) -> DataFrame:
    """(node, link_id): stretches from a head or confluence to the next confluence, numbered row by row of their first cells."""
    fed = nodes.where("ptr is not null").groupBy(F.col("ptr").alias("node")).agg(F.count("*").alias("inflow"), F.max("node").alias("up"))
    up = settle(nodes.join(fed, "node", "left").select("node", "r", "c", F.when(F.col("inflow") == 1, F.col("up")).alias("ptr"), F.col("node").alias("first")), "links")
    found = downstream(up, {"first": lambda mine, above: F.coalesce(above, mine)}).select("node", "first")
    starts = numbered(up.where("ptr is null").select("node", "r", "c"), "link_id").select(F.col("node").alias("first"), "link_id")
    return found.join(starts, "first").select("node", "link_id")


def link_basins(directions: DataFrame, nodes: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, basin_id): the link that a cell drains to first, 0 without one."""
    every = forest(directions, grid).join(links(nodes), "node", "left")
    found = downstream(every, {"link_id": lambda mine, below: F.coalesce(mine, below)}).select("node", F.coalesce("link_id", F.lit(0)).alias("basin_id"))
    return every.select("node", "r", "c").join(found, "node").select("r", "c", "basin_id")


def link_lines(nodes: DataFrame, grid: GridMeta, cells: DataFrame) -> DataFrame:
    """One row a link of two cells or more: from_node and to_node (grid node ids), length, drop, mean slope, sinuosity and its path as WKT.

    The path ends in the confluence below. A link's cells come together in one row, as its line does.
    """
    linked = settle(nodes.join(links(nodes), "node").join(cells, ["r", "c"]), "linked")
    below = linked.select(F.col("node").alias("ptr"), F.col("link_id").alias("next_link"), F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("z").alias("nz"))
    step = F.when(F.col("ptr").isNull(), 0.0).when(F.col("dir") % 2 == 0, grid.step(0)).otherwise(grid.step(1))
    stepped = settle(linked.join(below, "ptr", "left").withColumn("d", step).withColumn("last", F.col("ptr").isNull() | (F.col("next_link") != F.col("link_id"))), "link-steps")
    # what is left of the link below a cell orders its cells
    togo = downstream(stepped.select("node", F.when(~F.col("last"), F.col("ptr")).alias("ptr"), F.lit(1).cast("bigint").alias("hops")), {"hops": lambda mine, rest: mine + rest})
    spot = lambda node, r, c, z: F.struct(F.col(node).alias("node"), (grid.x0 + (F.col(c) + 0.5) * grid.dx).alias("x"), (grid.y0 + (F.col(r) + 0.5) * grid.dy).alias("y"), F.col(z).alias("z"))
    rows = stepped.join(togo.select("node", "hops"), "node").groupBy("link_id").agg(
        F.sum("d").alias("length_m"), F.max(F.when(F.col("last") & F.col("ptr").isNotNull(), spot("ptr", "nr", "nc", "nz"))).alias("end"),
        F.array_sort(F.collect_list(F.struct((-F.col("hops")).alias("at"), spot("node", "r", "c", "z").alias("p")))).alias("cells"),
    )
    path = F.concat(F.transform("cells", lambda s: s["p"]), F.when(F.col("end").isNotNull(), F.array("end")).otherwise(F.array().cast("array<struct<node:bigint,x:double,y:double,z:double>>")))
    rows = rows.withColumn("path", path).where("size(path) > 1").withColumn("a", F.element_at("path", 1)).withColumn("b", F.element_at("path", -1))
    rows = rows.withColumn("drop_m", F.greatest(F.col("a.z") - F.col("b.z"), F.lit(0.0))).withColumn("straight", F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")))
    wkt = F.concat(F.lit("LINESTRING ("), F.array_join(F.transform("path", lambda p: F.concat_ws(" ", p["x"], p["y"])), ", "), F.lit(")"))
    return rows.select("link_id", F.col("a.node").alias("from_node"), F.col("b.node").alias("to_node"), "length_m", "drop_m", (F.col("drop_m") / F.col("length_m")).alias("mean_slope"), F.when(F.col("straight") > 0, F.col("length_m") / F.col("straight")).otherwise(1.0).alias("sinuosity"), wkt.alias("line"))
