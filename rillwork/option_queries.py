"""Queries of operators' options: other gradients, several lights, thresholds in areas, snapping by distance; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.grid import embedding_dem
from rillwork.operators import mesh, routing, terrain
from rillwork.plans.store import shared_path
from rillwork.queries import CELLS, D8, DEM, PALETTE, PATCH, POUR, REACH, SNAP, _upscale_sql, dem, dem_arrays, ints, query, rounded, routed, with_
from rillwork.shape_queries import MESH, QUERIES, SQL, lattice
from rillwork.sources import geotiff

__all__ = ["QUERIES", "SQL"]

FOUR = PATCH + ", four as (select r, c, z, (n6 - n2) / 2 as gx, (n0 - n4) / 2 as gy from p)"
ACC = D8 + ", " + REACH + ", acc as (select d8.r, d8.c, d8.z, coalesce(a.n, 0)::double as acc from d8 left join (select down, count(*) as n from reach group by down) a on a.down = d8.node)"
#: Azimuth, altitude, exaggeration and scale of each light, and the lights' weights.
LIGHTS, WEIGHTS = [(315.0, 45.0, 1.0, 1.0), (45.0, 30.0, 2.0, 1.0), (180.0, 60.0, 1.0, 4.0)], [2.0, 1.0, 1.0]


@query("slope_four_neighbours", with_(FOUR) + " select r, c, round(100 * sqrt(gx * gx + gy * gy) / 2, 6) as slope from four")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(terrain.horn_slope(cells, grid, percent=True, method="zevenbergen_thorne", scale=2.0), "r", "c"))


@query(
    "aspect_zero_flat",
    with_(FOUR.replace("embedding[i]::double", "floor(embedding[i]::double * 4)"))
    + " select r, c, round(case when gx <> 0 or gy <> 0 then (degrees(atan2(-gx, gy)) + 360) % 360 else 0 end, 6) as aspect from four",
)
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    stepped = cells.withColumn("z", F.floor(F.col("z") * 4).cast("double"))
    return ints(rounded(terrain.aspect(stepped, grid, method="zevenbergen_thorne", zero_flat=True), "r", "c"))


def _light_sql(azimuth: float, altitude: float, exaggeration: float, scale: float) -> str:
    a, h, f = f"radians({azimuth})", f"radians({altitude})", f"{exaggeration / scale}::double"
    up = f"(-gx * {f} * sin({a}) * cos({h}) + gy * {f} * cos({a}) * cos({h}) + sin({h}))"
    return f"floor(0.5 + greatest(0, 1 + 254 * {up} / sqrt(1 + gx * gx * {f} * {f} + gy * gy * {f} * {f})))"


@query(
    "hillshade_of_lights",
    with_(PATCH) + " select r, c, floor((" + " + ".join(f"{w} * {_light_sql(*x)}" for x, w in zip(LIGHTS, WEIGHTS, strict=True)) + f") / {sum(WEIGHTS)} + 1e-9)::bigint as shade from grad",
)
def _(spark, sf_dir):
    return ints(terrain.hillshade_of_lights(*dem(spark, sf_dir), LIGHTS, WEIGHTS))


RGBA = [(*stop, alpha) for stop, alpha in zip(PALETTE, (255, 128, 0), strict=True)]


@query("color_relief_alpha", with_(DEM) + " select r, c, " + ", ".join(
    f"floor(0.5 + case when z <= -0.2::double then {lo} when z < 0 then {lo} + (z + 0.2::double) / 0.2::double * {mid - lo} when z < 0.2::double then {mid} + z / 0.2::double * {hi - mid} else {hi} end)::bigint as {name}"
    for name, lo, mid, hi in zip(("red", "green", "blue", "alpha"), *(p[1:] for p in RGBA), strict=True)) + " from dem")
def _(spark, sf_dir):
    return ints(terrain.color_relief(embedding_dem(spark, sf_dir), RGBA))


@query("streams_by_area", with_(ACC, True) + " select r, c, acc >= 5 and z > 0 as stream from acc")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    return ints(routing.streams(routing.accumulate(d8, grid), 4.5e-6, grid, "km2", envelope=cells.where("z > 0")))


@query("streams_by_area_and_slope", with_(ACC, True) + """, grade as (select r, c, max(s) as s from drop8 group by r, c)
select acc.r, acc.c, acc * pow(greatest(s, 0), 2) >= 0.05::double as stream from acc join grade using (r, c)""")  # fmt: skip
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    return ints(routing.streams(routing.accumulate(d8, grid), 0.05, slope=terrain.slope(cells, grid), exponent=2.0))


@query("snap_pour_points_report", with_(SNAP, True) + """, closest as (select * from near where acc >= 4 and abs(r - (select pr from pour p where p.id = near.id)) <= 2 and abs(c - (select pc from pour p where p.id = near.id)) <= 2
  qualify row_number() over (partition by id order by acc desc, r, c) = 1)
select pour.id::bigint as id, coalesce(b.r, pr)::bigint as r, coalesce(b.c, pc)::bigint as c, b.acc, pr::bigint as from_r, pc::bigint as from_c,
  round(case when b.r <> pr or b.c <> pc then sqrt(pow(b.r - pr, 2) + pow(b.c - pc, 2)) end, 6) as moved from pour left join closest b on b.id = pour.id""")  # fmt: skip
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    found = routing.snap_pour_points(spark.createDataFrame(POUR, "id int, r int, c int"), routing.accumulate(d8, grid), grid, radius_m=1.5, min_acc=4.0, report=True)
    return ints(rounded(found, "id", "r", "c", "from_r", "from_c"))


@query("coarse_elevation", with_(ACC, True) + """ select r // 4 as r, c // 4 as c, arg_max(z, acc * 1e9 - r * 64 - c) as z from acc
where r < (select nr from size) // 4 * 4 group by r // 4, c // 4""")  # fmt: skip
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    return ints(routing.coarse_elevation(cells, routing.accumulate(d8, grid), grid, 4))


@query("mesh_problems", with_(MESH) + """, chosen as (select vid from v where z > 0), bent as (select tid, a, b, case when tid % 7 = 0 then a else c end as c from tri),
corner as (select tid, a as vid from bent union all select tid, b from bent union all select tid, c from bent)
select distinct tid::bigint as tid, 'missing' as problem from corner where vid not in (select vid from chosen) union all select tid::bigint, 'repeated' from bent where a = b or b = c or a = c""")  # fmt: skip
def _(spark, sf_dir):
    vertices, triangles = lattice(spark, sf_dir)
    return mesh.problems(vertices.where("z > 0"), triangles.withColumn("c", F.when(F.col("tid") % 7 == 0, F.col("a")).otherwise(F.col("c"))))


GRADIENT = PATCH + ", t as (select r, c, gx, gy, gx * gx + gy * gy as s, pi() / 4 as h from grad)"
_LIGHTS = " + ".join(
    f"pow(-gx * cos(radians({a})) - gy * sin(radians({a})), 2) * greatest(0, -gx * sin(radians({a})) * cos(h) + gy * cos(radians({a})) * cos(h) + sin(h))" for a in (225, 270, 315, 360)
)
_COSINE = "(-gx * sin(radians(315)) * cos(h) + gy * cos(radians(315)) * cos(h) + sin(h)) / sqrt(1 + s)"
_TURN = "((atan2(-gx, gy) - radians(495)) - 2 * pi() * floor((atan2(-gx, gy) - radians(495)) / (2 * pi())))"
SHADINGS = {
    "multidirectional": f"1 + 254 * case when s > 0 then ({_LIGHTS}) / (2 * s) / sqrt(1 + s) else sin(h) end",
    "combined": f"1 + 254 * greatest(0, 1 - acos(greatest(-1, least(1, {_COSINE}))) * atan(sqrt(s)) / pow(pi() / 2, 2))",
    "igor": f"255 * (1 - atan(sqrt(s)) / (pi() / 2) * (1 - least({_TURN}, 2 * pi() - {_TURN}) / pi()))",
}
for _kind, _text in SHADINGS.items():
    query(f"hillshade_{_kind}", with_(GRADIENT) + f" select r, c, round({_text}, 6) as shade from t")(
        lambda spark, sf_dir, kind=_kind: ints(rounded(terrain.hillshade(*dem_arrays(spark, sf_dir), kind=kind), "r", "c"))
    )


#: The window's sums by columns, then by rows, each place mirrored at the edges.
WIDE = DEM + """, across as (select a.r, a.c, sum(b.z) as s from dem a, size n, range(-15, 16) j(j) join dem b on true
  where b.r = a.r and b.c = (case when a.c + j < 0 then -(a.c + j) - 1 when a.c + j >= n.nc then 2 * n.nc - 1 - (a.c + j) else a.c + j end) group by a.r, a.c),
down as (select a.r, a.c, sum(b.s) / 961 as m from dem a, size n, range(-15, 16) i(i) join across b on true
  where b.c = a.c and b.r = (case when a.r + i < 0 then -(a.r + i) - 1 when a.r + i >= n.nr then 2 * n.nr - 1 - (a.r + i) else a.r + i end) group by a.r, a.c)"""


@query("tpi_wide", with_(WIDE) + " select a.r, a.c, round(a.z - m, 6) as tpi from dem a join down using (r, c)")
def _(spark, sf_dir):
    """A window of 31 cells to the side, by running sums."""
    return ints(rounded(terrain.tpi(*dem_arrays(spark, sf_dir), 31), "r", "c"))


@query("export_geotiff", with_(CELLS) + " select r, c, round(z::float::double, 6) as z from dem")
def _(spark, sf_dir):
    """The elevations as a GeoTIFF of 32 bits, read back."""
    arrays, _ = dem_arrays(spark, sf_dir)
    path = f"{shared_path(spark, 'geotiff')}/dem.tif"
    geotiff.write_geotiff(arrays.blocks(), path, bits=32)
    return ints(rounded(geotiff.read_geotiff(spark, path).cells(), "r", "c"))
