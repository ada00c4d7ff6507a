"""Triangle meshes: vertices(vid, x, y, z) and triangles(tid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.plans.store import settle


def edges(triangles: DataFrame) -> DataFrame:
    """(u, v, n): undirected edges with how many triangles have them, u < v."""
    sides = F.array(*(F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    return triangles.select(F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count("*").alias("n"))


def problems(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(tid, problem): triangles with a vertex that is null ("null"), not there ("missing") or named twice ("repeated"), a row for each."""
    lacking = [c for c in ("vid", "x", "y") if c not in vertices.columns] + [c for c in ("tid", "a", "b", "c") if c not in triangles.columns]
    if lacking:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    corners = triangles.select("tid", F.explode(F.array("a", "b", "c")).alias("vid"))
    absent = corners.where("vid is not null").join(vertices.select("vid"), "vid", "left_anti").select("tid", F.lit("missing").alias("problem"))
    null = corners.where("vid is null").select("tid", F.lit("null").alias("problem"))
    twice = triangles.where("a = b or b = c or a = c").select("tid", F.lit("repeated").alias("problem"))
    return absent.unionByName(null).unionByName(twice).distinct()


def boundary_vertices(triangles: DataFrame) -> DataFrame:
    """(vid) of the vertices on edges that only one triangle has."""
    return edges(triangles).where("n = 1").select(F.explode(F.array("u", "v")).alias("vid")).distinct()


def neighbours(triangles: DataFrame) -> DataFrame:
    """(vid, ring): the sorted vertices that share an edge with each."""
    e = edges(triangles)
    both = e.select(F.col("u").alias("vid"), F.col("v").alias("w")).unionByName(e.select(F.col("v").alias("vid"), F.col("u").alias("w")))
    return both.groupBy("vid").agg(F.array_sort(F.collect_list("w")).alias("ring"))


def laplacian_smooth(vertices: DataFrame, triangles: DataFrame, iterations: int = 1, relaxation: float = 0.5, hold_boundary: bool = True, smooth_z: bool = False) -> DataFrame:
    """vertices moved by ``relaxation`` towards the mean of their neighbours, all at once in each iteration; z stays unless asked for."""
    e = edges(triangles)
    both = settle(e.select(F.col("u").alias("vid"), F.col("v").alias("w")).unionByName(e.select(F.col("v").alias("vid"), F.col("u").alias("w"))), "mesh-edges")
    held = boundary_vertices(triangles).withColumn("held", F.lit(hold_boundary))
    state = settle(vertices.join(held, "vid", "left").fillna(False, ["held"]), "mesh")
    moved = ["x", "y", *(["z"] if smooth_z else [])]
    for _ in range(iterations):
        at = state.select(F.col("vid").alias("w"), *(F.col(m).alias(f"{m}_w") for m in moved))
        mean = both.join(at, "w").groupBy("vid").agg(*(F.avg(f"{m}_w").alias(f"{m}_w") for m in moved))
        step = {m: F.when(F.col("held") | F.col(f"{m}_w").isNull(), F.col(m)).otherwise(F.col(m) + relaxation * (F.col(f"{m}_w") - F.col(m))) for m in moved}
        state = settle(state.join(mean, "vid", "left").withColumns(step).select(*state.columns), "mesh")
    return state.drop("held")


def aspect_ratios(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """(tid, ratio): circumradius over twice the inradius, 1 for equilateral triangles and infinite for flat ones."""
    out = triangles
    for p in "abc":
        out = out.join(vertices.select(F.col("vid").alias(p), F.col("x").alias(f"x{p}"), F.col("y").alias(f"y{p}")), p)
    length = lambda p, q: F.hypot(F.col(f"x{p}") - F.col(f"x{q}"), F.col(f"y{p}") - F.col(f"y{q}"))
    out = out.select("tid", length("b", "c").alias("l"), length("a", "c").alias("m"), length("a", "b").alias("n"))
    # R / 2r = lmn / ((l + m - n)(l - m + n)(-l + m + n)), by Heron's formula
    spare = (F.col("l") + F.col("m") - F.col("n")) * (F.col("l") - F.col("m") + F.col("n")) * (F.col("m") + F.col("n") - F.col("l"))
    return out.select("tid", F.when(spare > 0, F.col("l") * F.col("m") * F.col("n") / spare).otherwise(F.lit(float("inf"))).alias("ratio"))
