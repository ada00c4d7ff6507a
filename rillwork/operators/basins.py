"""What follows from basin labels: Pfafstetter codes, outlines, counts, the lowest basin; single cells' upstream counts."""

from __future__ import annotations

import warnings
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.grid import GridMeta
from rillwork.operators.routing import accumulate, forest
from rillwork.plans.doubling import downstream
from rillwork.plans.drainage import along_paths
from rillwork.plans.store import settle


def pfafstetter(directions: DataFrame, acc: DataFrame, stream_cells: DataFrame, grid: GridMeta, level: int = 1) -> DataFrame:
    """(r, c, code): the stem of a basin 5, its four largest tributaries 2, 4, 6, 8 from below, the rest as what they drain to.

    The stem goes up from the stream cell of most accumulation by the inflow of most, the lowest direction code on ties. A basin
    without streams is 1. Each further level divides every coded part again and appends a digit, 0 where there is none.
    All parts of a level are divided together.
    """
    if level < 1:
        raise ValueError("level must be at least 1")
    flows = forest(directions.join(acc, ["r", "c"]).join(stream_cells.select("r", "c", "stream"), ["r", "c"]), grid, "acc", "stream")
    state = settle(flows.withColumn("code", F.lit(0).cast("bigint")), "pfafstetter")
    for depth in range(level):
        coded = _divided(state, grid, depth == 0)
        code = F.col("code") * 10 + F.coalesce("digit", F.lit(0))
        state = settle(state.join(coded, "node", "left").select(*flows.columns, code.alias("code")), "pfafstetter")
    return state.select("r", "c", "code")


def _divided(state: DataFrame, grid: GridMeta, whole: bool) -> DataFrame:
    """(node, digit) of the cells of every part (equal ``code``; 0 is no part but at first)."""
    parts = state if whole else state.where("code > 0")
    below = parts.select(F.col("node").alias("ptr"), F.col("code").alias("below"), F.col("stream").alias("wet_below"))
    linked = parts.where("ptr is not null").join(below, "ptr", "left").withColumn("stays", F.coalesce(F.col("below") == F.col("code"), F.lit(False)))
    linked = settle(linked.unionByName(parts.where("ptr is null").selectExpr("*", "cast(null as bigint) as below", "cast(null as boolean) as wet_below", "false as stays")), "parts")
    streams = linked.where("stream").select("node", "code", "acc", "dir", F.when(F.col("stays") & F.col("wet_below"), F.col("ptr")).alias("ptr"))
    first = F.struct("acc", (-F.pmod(F.col("dir") + 4, F.lit(8))).alias("k"))  # the receiver's codes count up from its own view
    chosen = streams.where("ptr is not null").groupBy("ptr").agg(F.max(F.struct(first.alias("f"), "node")).alias("b")).select(F.col("b.node").alias("node"), F.lit(True).alias("main"))
    marked = settle(streams.join(chosen, "node", "left"), "inflows")
    outlets = marked.groupBy("code").agg(F.max(F.struct("acc", (-F.col("node")).alias("n"))).alias("b")).select("code", (-F.col("b.n")).alias("outlet"))
    outlets = F.broadcast(outlets)  # a row a part, where one part may be the whole raster
    chain = marked.join(outlets, "code").withColumn("end", F.col("node") == F.col("outlet"))
    chain = chain.select("node", F.when(F.col("main") & ~F.col("end"), F.col("ptr")).alias("ptr"), F.when(F.col("end"), F.lit(0)).alias("at"), F.lit(1).alias("hops"))
    # hops count the nodes from here on, the last one too
    walked = downstream(chain, {"at": lambda mine, under: F.coalesce(mine, under), "hops": lambda mine, under: mine + under})
    stem = settle(walked.where("at = 0").select("node", (F.col("hops") - 1).alias("position")), "stem")
    joined = marked.where("main is null and ptr is not null").join(stem.select(F.col("node").alias("ptr"), "position"), "ptr")
    order = F.pmod(F.col("dir") + 4, F.lit(8))
    ranked = joined.withColumn("volume", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("acc"), "position", order))).where("volume <= 4")
    digits = ranked.withColumn("digit", 2 * F.row_number().over(Window.partitionBy("code").orderBy("position", "volume"))).select("node", "digit")
    dry = linked.join(outlets, "code", "left_anti").select("node", F.lit(1).alias("digit")).hint("merge")
    marks = stem.select("node", F.lit(5).alias("digit")).unionByName(digits)
    # paths that leave a part end there
    inside = linked.select("node", "r", "c", F.when(F.col("stays"), F.col("dir")).alias("dir")).join(marks, "node", "left")
    found = along_paths(inside.select("r", "c", "dir", F.col("digit").alias("v")), grid).where("v is not null")
    found = found.select(grid.node(F.col("r"), F.col("c")).alias("node"), F.col("v").cast("int").alias("digit"))
    return found.join(dry, "node", "left_anti").unionByName(dry)


def basin_count(labels: DataFrame) -> int:
    """Distinct basins; 0 is none."""
    return labels.where("basin_id <> 0").agg(F.count_distinct("basin_id")).first()[0]


def lowest_basin(labels: DataFrame) -> DataFrame:
    """(r, c, basin_id): only the basin of the lowest id stays; null elsewhere."""
    low = labels.where("basin_id <> 0").agg(F.min("basin_id").alias("low"))
    return labels.join(F.broadcast(low)).select("r", "c", F.when(F.col("basin_id") == F.col("low"), F.col("basin_id")).alias("basin_id"))


def metrics(statistics: DataFrame, names: list[str]) -> DataFrame:
    """Only the named columns of basin statistics, with ids and centroids; unknown names are ignored."""
    keep = {"basin_id", "centroid_x", "centroid_y", *names}
    return statistics.select(*(c for c in statistics.columns if c in keep))


def _simple(ring: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """A closed walk over corners (the first not repeated) as rings that visit no corner twice."""
    out, held, at = [], [], {}
    for p in [*ring, ring[0]]:
        if p in at:
            begin = at[p]
            out.append(held[begin:])
            for q in held[begin:]:
                del at[q]
            del held[begin:]
        at[p] = len(held)
        held.append(p)
    return out


def _rings(edges: Iterable[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """The rings of directed unit edges (r1, c1, r2, c2) with the cell on their right; none visits a corner twice."""
    out: dict = {}
    for r1, c1, r2, c2 in edges:
        out.setdefault((r1, c1), []).append((r2, c2))
    rings = []
    for start in sorted(out):
        while out[start]:
            ring, came, at = [start], start, out[start].pop()
            while at != start or len(ring) == 1:
                ring.append(at)
                # at a corner where two rings meet, turn right: the cell's own corner
                right = (at[0] + at[1] - came[1], at[1] - at[0] + came[0])
                nxt = right if right in out[at] else out[at][0]
                out[at].remove(nxt)
                came, at = at, nxt
            rings += _simple(ring)
    return rings


def _nested(rings: list[list[tuple[int, int]]]) -> list[list[int]]:
    """Rings' numbers as polygons: a shell and then its holes.

    Shells run one way and holes the other. Left of a hole's leftmost side lies a cell of the polygon; the next side to the
    left in its row is its shell's, or that of a hole farther left with the same shell.
    """
    area = [sum(r1 * c2 - r2 * c1 for (r1, c1), (r2, c2) in zip(ring, [*ring[1:], ring[0]], strict=True)) for ring in rings]
    shells = [i for i, a in enumerate(area) if a < 0]
    polygons, owner = {i: [i] for i in shells}, {i: i for i in shells}
    sides: dict[int, list[tuple[int, int]]] = {}
    lefts = {}
    for i, ring in enumerate(rings):
        upright = [(c1, min(r1, r2)) for (r1, c1), (r2, c2) in zip(ring, [*ring[1:], ring[0]], strict=True) if c1 == c2]
        for c, r in upright:
            sides.setdefault(r, []).append((c, i))
        lefts[i] = min(upright)
    for row in sides.values():
        row.sort()
    for i in sorted((i for i in range(len(rings)) if i not in owner), key=lambda i: lefts[i]):
        c, r = lefts[i]
        owner[i] = owner[sides[r][bisect_left(sides[r], (c, -1)) - 1][1]]
        polygons[owner[i]].append(i)
    return list(polygons.values())


def to_polygons(labels: DataFrame, grid: GridMeta) -> DataFrame:
    """(basin_id, wkt): the outline of each basin, a POLYGON, or a MULTIPOLYGON where its cells are not joined by sides.

    Cell sides that two cells of a basin share cancel out before a basin's edges come together in the row that its
    outline is. Pieces that touch at a corner only are polygons of their own; each hole belongs to its shell.
    """
    side = lambda r1, c1, r2, c2: F.struct(*(x.cast("int").alias(n) for n, x in zip(("r1", "c1", "r2", "c2"), (r1, c1, r2, c2), strict=True)))
    r, c = F.col("r"), F.col("c")
    around = F.array(side(r, c, r, c + 1), side(r, c + 1, r + 1, c + 1), side(r + 1, c + 1, r + 1, c), side(r + 1, c, r, c))
    sides = labels.where("basin_id <> 0").select("basin_id", F.explode(around).alias("s")).select("basin_id", "s.*")
    ends = [F.struct(F.col(f"r{i}").alias("r"), F.col(f"c{i}").alias("c")) for i in (1, 2)]
    low, high = F.least(*ends), F.greatest(*ends)
    rim = sides.groupBy("basin_id", low.alias("p"), high.alias("q")).agg(F.count("*").alias("n"), F.first("r1").alias("r1"), F.first("c1").alias("c1"), F.first("r2").alias("r2"), F.first("c2").alias("c2")).where("n = 1")

    def text(ring: list[tuple[int, int]]) -> str:
        """Straight runs become one edge."""
        bends = [p for a, p, b in zip([ring[-1], *ring], ring, [*ring[1:], ring[0]], strict=False) if (p[0] - a[0], p[1] - a[1]) != (b[0] - p[0], b[1] - p[1])]
        return "(" + ", ".join(f"{grid.x0 + c * grid.dx} {grid.y0 + r * grid.dy}" for r, c in [*bends, bends[0]]) + ")"

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        rings = _rings(zip(pdf.r1.tolist(), pdf.c1.tolist(), pdf.r2.tolist(), pdf.c2.tolist(), strict=True))
        polygons = ["(" + ", ".join(text(rings[i]) for i in some) + ")" for some in _nested(rings)]
        wkt = f"POLYGON {polygons[0]}" if len(polygons) == 1 else f"MULTIPOLYGON ({', '.join(polygons)})"
        return pd.DataFrame({"basin_id": [pdf.basin_id.iloc[0]], "wkt": [wkt]})

    return rim.select("basin_id", "r1", "c1", "r2", "c2").groupBy("basin_id").applyInPandas(trace, "basin_id bigint, wkt string")


def upstream_count(directions: DataFrame, grid: GridMeta, r: int, c: int) -> int:
    """Cells strictly upstream of one cell; 0 off the grid."""
    row = accumulate(directions, grid).where((F.col("r") == r) & (F.col("c") == c)).first()
    return int(row["acc"]) if row else 0


def flow_accumulation(cells: DataFrame, directions: DataFrame, grid: GridMeta, weight: str | None = None, fractional: bool = False) -> DataFrame:
    """(r, c, acc: bigint): accumulation cut to whole numbers, null where ``cells`` has no data."""
    if fractional:
        warnings.warn("shares are cut to whole numbers; use accumulate_edges", UserWarning, stacklevel=2)
    acc = accumulate(directions, grid, weight)
    return cells.join(acc, ["r", "c"], "left").select("r", "c", F.when(F.col("z").isNotNull(), F.col("acc").cast("bigint")).alias("acc"))
