"""The engine's queries over the supplied tables, each with the SQL that gives the same rows.

The tables hold no rasters: the embeddings serve as an elevation grid, lineitem as a point cloud.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.grid import GridMeta, as_points, embedding_dem, embedding_rows, grid_of, line_item_points
from rillwork.operators import conditioning, points, routing, streams, terrain, zonal
from rillwork.plans.arrays import RowArrays, blocks_of_cells, d8_blocks
from rillwork.plans.store import settle
from rillwork.streaming import gridding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BINS = GridMeta(40, 40, 0.0, 50.0, 0.0, 2.5)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def dem(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridMeta]:
    return embedding_dem(spark, sf_dir), embedding_rows(spark, sf_dir)[1]


def dem_arrays(spark: SparkSession, sf_dir: str) -> tuple[RowArrays, GridMeta]:
    """The elevations for operators that work on tiles of arrays."""
    rows, grid = embedding_rows(spark, sf_dir)
    return RowArrays(rows, grid), grid


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(c if c in keys else F.round(c, 6).alias(c) for c in df.columns))


def ints(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("bigint").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def routed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, GridMeta]:
    cells, grid = dem(spark, sf_dir)
    return cells, settle(routing.flow_direction_d8(*dem_arrays(spark, sf_dir)), "directions"), grid


CELLS = "dem as (select vec_id::bigint as r, (i - 1)::bigint as c, embedding[i]::double as z from embeddings, range(1, 65) t(i))"
DEM = CELLS + """,
size as (select max(r) + 1 as nr, 64 as nc from dem),
offs(k, dr, dc) as (values (0, 1, 0), (1, 1, -1), (2, 0, -1), (3, -1, -1), (4, -1, 0), (5, -1, 1), (6, 0, 1), (7, 1, 1)),
drop8 as (select a.r, a.c, a.z, k, b.r as nr, b.c as nc, b.z as zn, (a.z - b.z) / (case when k % 2 = 0 then 1.0::double else 1.4142135623730951::double end) as s
  from dem a, offs join dem b on true where b.r = a.r + dr and b.c = a.c + dc)"""
D8 = DEM + """, best as (select r, c, z, k, s, nr, nc from drop8 qualify row_number() over (partition by r, c order by s desc, k) = 1),
d8 as (select r, c, z, case when s > 0 then k end as dir, case when s > 0 then nr * 64 + nc end as ptr, r * 64 + c as node from best)"""
REACH = "reach(node, down, hops) as (select node, ptr, 1 from d8 where ptr is not null union all select reach.node, d8.ptr, hops + 1 from reach join d8 on d8.node = reach.down where d8.ptr is not null)"
#: 3 x 3 values with replicated edges.
PATCH = DEM + """, n as (select a.r, a.c, a.z, k, b.z as zn from dem a, size s, offs join dem b on true
  where b.r = greatest(0, least(s.nr - 1, a.r + dr)) and b.c = greatest(0, least(s.nc - 1, a.c + dc))),
p as (select r, c, z, """ + ", ".join(f"max(zn) filter (where k = {k}) as n{k}" for k in range(8)) + """ from n group by r, c, z),
grad as (select *, ((n5 + 2 * n6 + n7) - (n3 + 2 * n2 + n1)) / 8 as gx, ((n1 + 2 * n0 + n7) - (n3 + 2 * n4 + n5)) / 8 as gy from p)"""


def with_(body: str, recursive: bool = False) -> str:
    return ("with recursive " if recursive else "with ") + body


def stream_nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, GridMeta]:
    _, d8, grid = routed(spark, sf_dir)
    return streams.stream_forest(d8, routing.streams(routing.accumulate(d8, grid), 3.0), grid), grid


def on_streams(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    nodes, _ = stream_nodes(spark, sf_dir)
    return ints(nodes.select("node", "r", "c").join(operator(nodes), "node").drop("node"))


@query("dem_slope", with_(DEM) + " select r, c, round(max(s), 6) as slope from drop8 group by r, c")
def _(spark, sf_dir):
    return ints(rounded(terrain.slope(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("flow_direction_d8", with_(D8) + " select r, c, dir::bigint as dir from d8")
def _(spark, sf_dir):
    return ints(routing.flow_direction_d8(*dem_arrays(spark, sf_dir)))


@query("flow_direction_mfd_quinn", with_(DEM) + """, w as (select r, c, k, case when s > 0 then pow(s, 1.1) * (case when k % 2 = 0 then 0.5 else 1 / (2 * sqrt(2)) end) else 0 end as w from drop8)
select r, c, """ + ", ".join(f"round(coalesce(sum(w) filter (where k = {k}), 0) / nullif(sum(w), 0), 6) as f{k}" for k in range(8)) + " from w group by r, c having sum(w) > 0")
def _(spark, sf_dir):
    f = routing.flow_direction_mfd(*dem_arrays(spark, sf_dir))
    return ints(f.where("aggregate(fractions, 0D, (a, x) -> a + x) > 0").select("r", "c", *(F.round(F.col("fractions")[k], 6).alias(f"f{k}") for k in range(8))))


@query("flow_accumulation", with_(D8 + ", " + REACH, True) + " select d8.r, d8.c, coalesce(a.n, 0)::double as acc from d8 left join (select down, count(*) as n from reach group by down) a on a.down = d8.node")
def _(spark, sf_dir):
    arrays, grid = dem_arrays(spark, sf_dir)
    return ints(routing.accumulate(d8_blocks(arrays).stored(), grid))


#: Directions and streams of the filled surface: the same texts, with the filled cells as elevations.
FILLED = (
    DEM.replace("dem as (", "raw as (").replace("from dem)", "from raw)", 1).split("drop8 as")[0]
    + """w(r, c, v) using key (r, c) as (select r, c, z as v from raw, size where r = 0 or c = 0 or r = nr - 1 or c = 63
  union select n.r, n.c, min(greatest(n.z, w.v)) from w, offs join raw n on true left join recurring.w x on x.r = n.r and x.c = n.c
  where n.r = w.r + dr and n.c = w.c + dc and (x.v is null or greatest(n.z, w.v) < x.v) group by n.r, n.c),
dem as materialized (select r, c, v as z from w),
drop8 as"""
    + D8.split("drop8 as")[1].replace("d8 as (", "d8 as materialized (")
)


@query("full_hydro_pipeline", with_(FILLED + ", " + REACH + ", a as (select down, count(*) as n from reach group by down)", True)
  + " select d8.r, d8.c, round(d8.z, 6) as filled, d8.dir::bigint as dir, coalesce(a.n, 0)::double as acc, coalesce(a.n, 0) >= 10 as stream from d8 left join a on a.down = d8.node")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    filled = settle(conditioning.fill_depressions(cells, grid), "filled")
    d8 = d8_blocks(blocks_of_cells(filled, grid)).stored()
    wet = routing.streams(routing.accumulate(d8, grid), 10.0, keep=("acc",))
    out = filled.join(d8.cells().withColumn("dir", F.col("dir").cast("int")), ["r", "c"]).join(wet, ["r", "c"])
    return ints(out.select("r", "c", F.round("z", 6).alias("filled"), "dir", "acc", "stream"))


@query("streams", with_(D8 + ", " + REACH, True) + " select d8.r, d8.c, coalesce(a.n, 0) >= 5 as stream from d8 left join (select down, count(*) as n from reach group by down) a on a.down = d8.node")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.streams(routing.accumulate(d8, grid), 5.0))


@query("wetness_indices", with_(D8 + ", " + REACH, True) + """, a as (select down, count(*) as n from reach group by down),
s as (select r, c, greatest(atan(max(s)), 1e-3) as s from drop8 group by r, c)
select d8.r, d8.c, round(ln(case when a.n > 0 then a.n end / tan(s)), 6) as twi, round(coalesce(a.n, 0) * tan(s), 6) as spi, round(pow(coalesce(a.n, 0) / 22.13, 0.6) * pow(sin(s) / 0.0896, 1.3), 6) as sti
from d8 join s on s.r = d8.r and s.c = d8.c left join a on a.down = d8.node""")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    rows = routing.accumulate(d8, grid).join(terrain.slope(cells, grid), ["r", "c"])
    return ints(rounded(rows.select("r", "c", *(v.alias(k) for k, v in terrain.index_columns(F.col("acc"), F.atan("slope"), grid.dx).items())), "r", "c"))


@query("local_minima", with_(DEM) + " select r, c from drop8, size where drop8.r between 1 and size.nr - 2 and drop8.c between 1 and 62 group by r, c, z having z < min(zn)")
def _(spark, sf_dir):
    return ints(terrain.local_minima(*dem_arrays(spark, sf_dir)))


FOCAL = DEM + """, f as (select a.r, a.c, a.z, b.z as zn from dem a, size s, range(-1, 2) i(i), range(-1, 2) j(j) join dem b on true
  where b.r = (case when a.r + i < 0 then -(a.r + i) - 1 when a.r + i >= s.nr then 2 * s.nr - 1 - (a.r + i) else a.r + i end)
    and b.c = (case when a.c + j < 0 then -(a.c + j) - 1 when a.c + j >= s.nc then 2 * s.nc - 1 - (a.c + j) else a.c + j end)),
m as (select r, c, z, sum(zn) / 9 as m, sqrt(greatest(sum(zn * zn) / 9 - pow(sum(zn) / 9, 2), 0)) as sd from f group by r, c, z)"""


@query("tpi", with_(FOCAL) + " select r, c, round(z - m, 6) as tpi from m")
def _(spark, sf_dir):
    return ints(rounded(terrain.tpi(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("deviation_from_mean", with_(FOCAL) + " select r, c, round((z - m) / (case when sd = 0 then 1 else sd end), 6) as dev from m")
def _(spark, sf_dir):
    return ints(rounded(terrain.deviation_from_mean(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("elev_std", with_(FOCAL) + " select r, c, round(sd, 6) as elev_std from m")
def _(spark, sf_dir):
    return ints(rounded(terrain.elev_std(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("ruggedness", with_(DEM) + """ select a.r, a.c, round(avg(abs(a.z - b.z)), 6) as ruggedness from dem a, size s, offs join dem b on true
where b.r = (a.r + dr + s.nr) % s.nr and b.c = (a.c + dc + s.nc) % s.nc group by a.r, a.c""")
def _(spark, sf_dir):
    return ints(rounded(terrain.ruggedness(*dem(spark, sf_dir)), "r", "c"))


@query("terrain_slope", with_(PATCH) + " select r, c, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) as slope from grad")
def _(spark, sf_dir):
    return ints(rounded(terrain.horn_slope(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("terrain_aspect", with_(PATCH) + " select r, c, round(case when gx <> 0 or gy <> 0 then (degrees(atan2(-gx, gy)) + 360) % 360 end, 6) as aspect from grad")
def _(spark, sf_dir):
    return ints(rounded(terrain.aspect(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("terrain_hillshade", with_(PATCH) + """ select r, c, round(greatest(0, 1 + 254 * (-gx * sin(radians(315)) * cos(radians(45)) + gy * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(1 + gx * gx + gy * gy)), 6) as shade from grad""")
def _(spark, sf_dir):
    return ints(rounded(terrain.hillshade(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("curvature_terms", with_(PATCH) + " select r, c, round((n2 + n6) / 2 - z, 6) as d, round((n4 + n0) / 2 - z, 6) as e, round((n5 + n1 - n3 - n7) / 4, 6) as f, round((n6 - n2) / 2, 6) as g, round((n4 - n0) / 2, 6) as h from p")
def _(spark, sf_dir):
    return ints(rounded(terrain.curvature_terms(*dem_arrays(spark, sf_dir)), "r", "c"))


@query("upslope_flowpath_length", with_(D8 + """, walk(node, down, len) as (select node, ptr, case when dir % 2 = 0 then 1.0::double else 1.4142135623730951::double end from d8 where ptr is not null
  union all select walk.node, d8.ptr, len + case when d8.dir % 2 = 0 then 1.0::double else 1.4142135623730951::double end from walk join d8 on d8.node = walk.down where d8.ptr is not null)""", True)
  + " select d8.r, d8.c, round(coalesce(max(len), 0), 6) as length from d8 left join walk on walk.down = d8.node group by d8.r, d8.c")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(rounded(routing.upslope_length(d8, grid), "r", "c"))


ROOTS = ", roots as (select node, last(down order by hops) as root from (select node, down, hops from reach union all select node, node, 0 from d8) group by node)"


@query("basins", with_(D8 + ", " + REACH, True) + ROOTS + """, ids as (select node, row_number() over (order by node) as basin_id from d8 where dir is null)
select d8.r, d8.c, ids.basin_id::bigint as basin_id from d8 join roots on roots.node = d8.node join ids on ids.node = roots.root""")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.basins(d8, grid))


@query("basin_statistics", with_(D8 + ", " + REACH, True) + ROOTS + """, ids as (select node, row_number() over (order by node) as basin_id from d8 where dir is null),
l as (select d8.r, d8.c, d8.z, basin_id from d8 join roots on roots.node = d8.node join ids on ids.node = roots.root)
select basin_id::bigint as basin_id, round(count(*) / 1e6::double, 9) as area_km2, round(avg(c) + 0.5, 6) as centroid_x, round(-(avg(r) + 0.5), 6) as centroid_y, round(min(z), 6) as min_elev, round(max(z), 6) as max_elev,
  round(avg(z), 6) as mean_elev, round(stddev_pop(z), 6) as std_elev, round(case when max(z) = min(z) then 0 else (avg(z) - min(z)) / (max(z) - min(z)) end, 6) as hypsometric_integral from l group by basin_id""")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    out = zonal.basin_statistics(routing.basins(d8, grid), cells, grid)
    return ints(out.select("basin_id", F.round("area_km2", 9).alias("area_km2"), *(F.round(c, 6).alias(c) for c in out.columns[2:])))


POUR = [(1, 10, 10), (2, 20, 30), (3, 100, 5), (4, 100, 40), (5, 250, 20), (6, 20, 31)]


@query("watershed", with_(D8 + ", " + REACH + ", pour(id, r, c) as (values " + ", ".join(map(str, POUR)) + ")", True) + """
select d8.r, d8.c, coalesce(max(p.id), 0)::bigint as basin_id from d8 left join (select node, down from reach union all select node, node from d8) x on x.node = d8.node
left join pour p on p.r * 64 + p.c = x.down group by d8.r, d8.c""")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.watershed(d8, grid, spark.createDataFrame(POUR, "id int, r int, c int")))


@query("hand", with_(D8 + ", " + REACH, True) + """, a as (select down, count(*) as n from reach group by down), st as (select d8.node, d8.z from d8 join a on a.down = d8.node where a.n >= 5)
select d8.r, d8.c, round(d8.z - x.zs, 6) as hand from d8 left join
  (select y.node, first(st.z order by hops) as zs from (select node, down, hops from reach union all select node, node, 0 from d8) y join st on st.node = y.down group by y.node) x on x.node = d8.node""")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    wet = settle(routing.streams(routing.accumulate(d8, grid), 5.0), "streams")
    return ints(rounded(routing.hand(cells, d8, wet, grid), "r", "c"))


@query("stream_order_shreve", with_(D8 + ", " + REACH, True) + """, a as (select down, count(*) as n from reach group by down), st as (select d8.* from d8 join a on a.down = d8.node where a.n >= 3),
heads as (select node from st where node not in (select ptr from st where ptr is not null)), x as (select node, down from reach union all select node, node from d8)
select st.r, st.c, count(*)::bigint as magnitude from st join x on x.down = st.node join heads on heads.node = x.node group by st.r, st.c""")
def _(spark, sf_dir):
    return on_streams(spark, sf_dir, streams.shreve)


def _upscale_sql(weight: str) -> str:
    return with_(D8 + ", " + REACH + ", acc as (select d8.node, count(reach.down) as n from d8 left join reach on reach.down = d8.node group by d8.node)" + """, b as (select d8.*, r // 4 as br, c // 4 as bc, n from d8 join acc on acc.node = d8.node),
step as (select b.*, t.br as tr, t.bc as tc from b left join b t on t.node = b.ptr),
go(node, br, bc, down, w, dir) as (select node, br, bc, case when tr = br and tc = bc then ptr end, """ + weight + """, case when tr <> br or tc <> bc then (select k from offs where dr = tr - br and dc = tc - bc) end from step
  union all select go.node, go.br, go.bc, case when s.tr = s.br and s.tc = s.bc then s.ptr end, go.w, case when s.tr <> s.br or s.tc <> s.bc then (select k from offs where dr = s.tr - s.br and dc = s.tc - s.bc) end from go join step s on s.node = go.down),
v as (select br, bc, dir, sum(w) as v from go where dir is not null group by all),
won as (select br, bc, case when v > 0 then dir end as dir from v qualify row_number() over (partition by br, bc order by v desc, dir) = 1)
select x.br as r, x.bc as c, won.dir::bigint as dir from (select distinct br, bc from b) x left join won on won.br = x.br and won.bc = x.bc""", True)


@query("upscale_dmm", _upscale_sql("1.0::double"))
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.upscale_dmm(d8, settle(routing.accumulate(d8, grid), "accumulation"), grid, 4))


@query("upscale_eam", _upscale_sql("n::double"))
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.upscale_dmm(d8, settle(routing.accumulate(d8, grid), "accumulation"), grid, 4, weighted=True))


@query("fill_depressions", with_(DEM + """, w(r, c, v) using key (r, c) as (select r, c, z as v from dem, size where r = 0 or c = 0 or r = nr - 1 or c = 63
  union select n.r, n.c, min(greatest(n.z, w.v)) from w, offs join dem n on true left join recurring.w x on x.r = n.r and x.c = n.c
  where n.r = w.r + dr and n.c = w.c + dc and (x.v is null or greatest(n.z, w.v) < x.v) group by n.r, n.c)""", True) + " select r, c, round(v, 6) as z from w")
def _(spark, sf_dir):
    return ints(rounded(conditioning.fill_depressions(*dem(spark, sf_dir)), "r", "c"))


@query("subgrid_bathymetry", with_(DEM + """, b as (select r // 4 as r, c // 4 as c, z from dem, size where r < nr // 4 * 4), m as (select r, c, min(z) as lo, max(z) as hi from b group by r, c)""") + """
select b.r, b.c, round(lo, 6) as z_min, round(hi, 6) as z_max, """ + ", ".join(f"round(avg(case when hi = lo or z <= lo + {k} * (hi - lo) / 3 then 1.0::double else 0 end), 6) as frac_below_{k}" for k in (1, 2, 3)) + " from b join m on m.r = b.r and m.c = b.c group by b.r, b.c, lo, hi")
def _(spark, sf_dir):
    return ints(rounded(conditioning.subgrid_bathymetry(*dem(spark, sf_dir), 4, 3), "r", "c"))


PLACED = "p as (select greatest(0, least(39, floor(l_suppkey / 2.5::double)))::bigint as r, greatest(0, least(39, floor(l_partkey / 50.0::double)))::bigint as c, l_extendedprice as z, l_returnflag as f from lineitem), cells as (select i.i as r, j.j as c from range(0, 40) i(i), range(0, 40) j(j))"
for _how, _sql in {"min": "min(z)", "max": "max(z)", "mean": "avg(z)", "median": "median(z)", "count": "count(z)::double"}.items():
    query(f"grid_points_{_how}", with_(PLACED) + f" select cells.r, cells.c, round({_sql}, 4) as z from cells left join p on p.r = cells.r and p.c = cells.c group by cells.r, cells.c")(
        lambda spark, sf_dir, how=_how: ints(points.grid_points(line_item_points(spark, sf_dir), BINS, how).select("r", "c", F.round("z", 4).alias("z")))
    )


@query("classify_ground", with_(PLACED) + """, low as (select cells.r, cells.c, coalesce(min(z), (select min(z) from p)) as z from cells left join p on p.r = cells.r and p.c = cells.c group by cells.r, cells.c),
e as (select a.r, a.c, min(b.z) as z from low a join low b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.r, a.c),
o as (select a.r, a.c, max(b.z) as z from e a join e b on abs(a.r - b.r) <= 1 and abs(a.c - b.c) <= 1 group by a.r, a.c)
select (case when p.z - o.z <= 2000 then 2 else 1 end)::bigint as classification, count(*) as n, round(sum(p.z), 2) as total from p join o on o.r = p.r and o.c = p.c group by 1""")
def _(spark, sf_dir):
    got = points.classify_ground(line_item_points(spark, sf_dir), BINS, 3, 2000.0)
    return ints(got.groupBy("classification").agg(F.count("*").alias("n"), F.round(F.sum("z"), 2).alias("total")))


@query("filter_and_merge", "select count(*) as n, min(l_extendedprice) as low, max(l_extendedprice) as high from (select * from lineitem where l_returnflag = 'A' union all select * from lineitem where l_returnflag in ('A', 'N'))")
def _(spark, sf_dir):
    p = line_item_points(spark, sf_dir)
    both = points.merge(points.filter_classes(p, [2]), points.filter_classes(p, [1, 2]))
    return both.agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))


@query("detect_trees", with_(DEM) + ", h as (select r, c, z * 40 as z from dem) select a.r, a.c, round(a.z, 6) as height from h a join h b on abs(a.r - b.r) <= greatest(1, floor(0.5 + 0.05 * a.z)) and abs(a.c - b.c) <= greatest(1, floor(0.5 + 0.05 * a.z)) where a.z >= 2 group by a.r, a.c, a.z having a.z >= max(b.z)")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(points.detect_trees(cells.withColumn("z", F.col("z") * 40), grid), "r", "c"))


for _blend, _rule in {"max": "greatest(t, b)", "min": "least(t, b)", "topo_above": "case when t >= 0 then t else b end", "bathy_below": "case when b <= 0 then b else t end"}.items():
    query(f"fuse_{_blend}", with_(CELLS) + f" select r, c, round({_rule}, 6) as z from (select a.r, a.c, a.z as t, -b.z as b from dem a join dem b on b.r = a.r and b.c = 63 - a.c)")(
        lambda spark, sf_dir, blend=_blend: (lambda d: ints(rounded(zonal.fuse(d, d.select("r", (63 - F.col("c")).alias("c"), (-F.col("z")).alias("z")), blend), "r", "c")))(embedding_dem(spark, sf_dir))
    )


CURVES = {
    "plan": "-2 * (d * h * h + e * g * g - f * g * h) / (g * g + h * h + 1e-12::double)", "profile": "2 * (d * g * g + e * h * h + f * g * h) / (g * g + h * h + 1e-12::double)",
    "total": "2 * (d + e)", "mean": "d + e", "gaussian": "4 * d * e - f * f",
}
for _kind, _rule in CURVES.items():
    query(f"curvature_{_kind}", with_(PATCH) + f" select r, c, round({_rule}, 6) as curvature from (select r, c, (n2 + n6) / 2 - z as d, (n4 + n0) / 2 - z as e, (n5 + n1 - n3 - n7) / 4 as f, (n6 - n2) / 2 as g, (n4 - n0) / 2 as h from p)")(
        lambda spark, sf_dir, kind=_kind: ints(rounded(terrain.curvature(*dem(spark, sf_dir), kind), "r", "c"))
    )


@query("normal_vector_deviation", with_(PATCH) + """, u as (select r, c, (n2 - n6) / 2 / sqrt(1 + pow((n6 - n2) / 2, 2) + pow((n0 - n4) / 2, 2)) as x, (n4 - n0) / 2 / sqrt(1 + pow((n6 - n2) / 2, 2) + pow((n0 - n4) / 2, 2)) as y,
  1 / sqrt(1 + pow((n6 - n2) / 2, 2) + pow((n0 - n4) / 2, 2)) as w from p),
m as (select a.r, a.c, a.x, a.y, a.w, sum(b.x) as mx, sum(b.y) as my, sum(b.w) as mw from u a, size s, range(-1, 2) i(i), range(-1, 2) j(j) join u b on true
  where b.r = greatest(0, least(s.nr - 1, a.r + i)) and b.c = greatest(0, least(s.nc - 1, a.c + j)) group by a.r, a.c, a.x, a.y, a.w)
select r, c, round(acos(greatest(-1, least(1, (x * mx + y * my + w * mw) / (sqrt(mx * mx + my * my + mw * mw) + 1e-12::double)))), 6) as angle from m""")
def _(spark, sf_dir):
    return ints(rounded(terrain.normal_vector_deviation(*dem(spark, sf_dir)), "r", "c"))


HORIZONS = DEM + """, far as (select a.r, a.c, k, max(atan2(b.z - a.z, t * (case when k % 2 = 0 then 1.0::double else 1.4142135623730951::double end))) as h from dem a, offs, range(1, 5) t(t) join dem b on true
  where b.r = a.r + t * dr and b.c = a.c + t * dc group by a.r, a.c, k)"""


@query("openness_positive", with_(HORIZONS) + " select r, c, round(pi() / 2 - sum(greatest(0, h)) / 8, 6) as openness from far group by r, c")
def _(spark, sf_dir):
    return ints(rounded(terrain.openness(*dem(spark, sf_dir), 4), "r", "c"))


@query("openness_negative", with_(HORIZONS.replace("b.z - a.z", "a.z - b.z")) + " select r, c, round(pi() / 2 - sum(greatest(0, h)) / 8, 6) as openness from far group by r, c")
def _(spark, sf_dir):
    return ints(rounded(terrain.openness(*dem(spark, sf_dir), 4, "negative"), "r", "c"))


@query("sky_view_factor", with_(HORIZONS) + " select r, c, round(1 - sum(sin(greatest(0, h))) / 8, 6) as svf from far group by r, c")
def _(spark, sf_dir):
    return ints(rounded(terrain.sky_view_factor(*dem(spark, sf_dir), 4), "r", "c"))


PALETTE = [(-0.2, 0, 0, 200), (0.0, 40, 160, 40), (0.2, 240, 240, 200)]


@query("color_relief", with_(DEM) + " select r, c, " + ", ".join(
    f"floor(0.5 + case when z <= -0.2::double then {lo} when z < 0 then {lo} + (z + 0.2::double) / 0.2::double * {mid - lo} when z < 0.2::double then {mid} + z / 0.2::double * {hi - mid} else {hi} end)::bigint as {name}"
    for name, lo, mid, hi in zip(("red", "green", "blue"), *(p[1:] for p in PALETTE), strict=True)) + " from dem")
def _(spark, sf_dir):
    return ints(terrain.color_relief(embedding_dem(spark, sf_dir), PALETTE))


#: The facets between neighbouring eighths of a turn, and the steepest of them.
DINF = DEM + """, ns as (select r, c, z, list_value(""" + ", ".join(f"max(zn) filter (where k = {k})" for k in range(8)) + """) as n from drop8 group by r, c, z),
facet as (select r, c, z, i, case when i % 2 = 0 then i else i + 1 end as side, n[(14 - (case when i % 2 = 0 then i else i + 1 end)) % 8 + 1] as e1, n[(14 - (case when i % 2 = 0 then i + 1 else i end)) % 8 + 1] as e2 from ns, range(0, 8) t(i)),
lean as (select *, z - e1 as s1, e1 - e2 as s2, atan2(e1 - e2, z - e1) as q from facet where e1 is not null and e2 is not null),
fs as (select r, c, i, case when q < 0 then s1 when q > pi() / 4 then (z - e2) / sqrt(2) else sqrt(s1 * s1 + s2 * s2) end as s, side * (pi() / 4) + (case when i % 2 = 0 then 1 else -1 end) * least(greatest(q, 0), pi() / 4) as a from lean),
steep as (select r, c, s, case when a >= 2 * pi() then a - 2 * pi() else a end as a from fs where s > 0 qualify row_number() over (partition by r, c order by s desc, i) = 1)"""


@query("flow_direction_dinf", with_(DINF) + " select d.r, d.c, round(coalesce(a, -1), 6) as angle, round(coalesce(s, 0), 6) as magnitude from dem d left join steep x on x.r = d.r and x.c = d.c")
def _(spark, sf_dir):
    return ints(rounded(routing.flow_direction_dinf(*dem_arrays(spark, sf_dir)), "r", "c"))


FLOWING = """, edge as materialized ({edges}), lvl(node, m, i) as (select r * 64 + c, 1.0::double, 0 from dem union all select e.dst, sum(m * p), i + 1 from lvl join edge e on e.src = lvl.node group by e.dst, i)
select d.r, d.c, round(coalesce(x.acc, 0), 6) as acc from dem d left join (select node, sum(m) as acc from lvl where i > 0 group by node) x on x.node = d.r * 64 + d.c"""


@query("accumulate_mfd", with_(DEM + """, w as (select r, c, nr, nc, pow(s, 1.1) * (case when k % 2 = 0 then 0.5 else 1 / (2 * sqrt(2)) end) as w from drop8 where s > 0)""", True)
  + FLOWING.format(edges="select r * 64 + c as src, nr * 64 + nc as dst, w / sum(w) over (partition by r, c) as p from w"))
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    edges = settle(routing.mfd_edges(routing.flow_direction_mfd(cells, grid), grid), "edges")
    return ints(rounded(routing.accumulate_edges(cells, edges, grid), "r", "c"))


@query("accumulate_dinf", with_(DINF + """, part as (select r, c, floor(a / (pi() / 4)) as q, a / (pi() / 4) - floor(a / (pi() / 4)) as f from steep), snapped as (select r, c, q::bigint as q, case when f < 1e-6::double then 0 when f > 1 - 1e-6::double then 1 else f end as f from part),
both_ as (select r, c, (14 - q) % 8 as k, 1 - f as p from snapped union all select r, c, (13 - q) % 8, f from snapped)""", True)
  + FLOWING.format(edges="select b.r * 64 + b.c as src, s.r * 64 + s.c as dst, p from both_ b join offs o on o.k = b.k join steep s on s.r = b.r + o.dr and s.c = b.c + o.dc where p > 0"))
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    edges = settle(routing.dinf_edges(settle(routing.flow_direction_dinf(cells, grid), "directions"), grid), "edges")
    return ints(rounded(routing.accumulate_edges(cells, edges, grid), "r", "c"))


@query("flow_direction_rho8")
def _(spark, sf_dir):
    return ints(routing.flow_direction_rho8(*dem_arrays(spark, sf_dir), seed=7))


ST = D8 + ", " + REACH + """, a as (select down, count(*) as n from reach group by down), wet as (select d8.* from d8 join a on a.down = d8.node where a.n >= 3),
st as (select w.node, w.r, w.c, w.dir, x.node as ptr from wet w left join wet x on x.node = w.ptr),
sreach(node, down, hops) as (select node, ptr, 1 from st where ptr is not null union all select s.node, st.ptr, hops + 1 from sreach s join st on st.node = s.down where st.ptr is not null),
below as (select node, down from sreach union all select node, node from st),
len as (select st.node, st.ptr, coalesce(max(hops), 0) as len from st left join sreach s on s.down = st.node group by st.node, st.ptr),
stem as (select node, ptr, len, ptr is not null and row_number() over (partition by ptr order by len desc, node) = 1 as stem from len)"""
STRAHLER = """, so(node, o) using key (node) as (select node, 1::bigint from st
  union select q.ptr, q.m + (case when q.t >= 2 then 1 else 0 end) from (select st.ptr, max(x.o) as m, count(*) filter (where x.o = y.m) as t from st join recurring.so x on x.node = st.node
    join (select st.ptr, max(x.o) as m from st join recurring.so x on x.node = st.node where st.ptr is not null group by st.ptr) y on y.ptr = st.ptr group by st.ptr) q
  join recurring.so z on z.node = q.ptr where q.m + (case when q.t >= 2 then 1 else 0 end) > z.o and exists (select 1 from so))"""
STEM_ROOT = """, sdown(node, down, hops) as (select node, ptr, 1 from stem where stem union all select s.node, t.ptr, hops + 1 from sdown s join stem t on t.node = s.down where t.stem),
sroot as (select node, last(down order by hops) as root from (select node, down, hops from sdown union all select node, node, 0 from st) group by node)"""


@query("stream_order_strahler", with_(ST + STRAHLER, True) + " select st.r, st.c, so.o as strahler from st join so on so.node = st.node")
def _(spark, sf_dir):
    return on_streams(spark, sf_dir, streams.strahler)


@query("stream_order_hack", with_(ST, True) + " select st.r, st.c, (1 + count(*) filter (where s.ptr is not null and not s.stem))::bigint as hack from st join below b on b.node = st.node join stem s on s.node = b.down group by st.r, st.c")
def _(spark, sf_dir):
    return on_streams(spark, sf_dir, streams.hack)


@query("stream_order_horton", with_(ST + STRAHLER + STEM_ROOT, True) + " select st.r, st.c, so.o as horton from st join sroot on sroot.node = st.node join so on so.node = sroot.root")
def _(spark, sf_dir):
    return on_streams(spark, sf_dir, streams.horton)


@query("main_stem", with_(ST + STEM_ROOT, True) + " select st.r, st.c from st join sroot on sroot.node = st.node where sroot.root = (select node from stem where ptr is null order by len desc, node limit 1)")
def _(spark, sf_dir):
    return on_streams(spark, sf_dir, streams.main_stem)


@query("prune_short", with_(ST, True) + """, conf as (select ptr as node from st where ptr is not null group by ptr having count(*) >= 2), inner_ as (select distinct b.down as node from below b join conf on conf.node = b.node),
heads as (select node from st where node not in (select ptr from st where ptr is not null)), chain as (select b.node as head, b.down as node from below b join heads h on h.node = b.node where b.down not in (select node from inner_)),
long as (select head from chain join st on st.node = chain.node group by head having sum(case when ptr is null then 0.0::double when dir % 2 = 0 then 1.0::double else 1.4142135623730951::double end) >= 2)
select st.r, st.c from st where node in (select node from inner_) or node in (select chain.node from chain join long on long.head = chain.head)""")
def _(spark, sf_dir):
    nodes, grid = stream_nodes(spark, sf_dir)
    return ints(nodes.join(streams.prune_short(nodes, grid, 2.0), "node", "left_semi").select("r", "c"))


SNAP = D8 + ", " + REACH + """, acc as (select d8.r, d8.c, count(reach.down)::double as acc from d8 left join reach on reach.down = d8.node group by d8.r, d8.c),
pour(id, pr, pc) as (values """ + ", ".join(map(str, POUR)) + """), near as (select id, r, c, acc, (r - pr) * (r - pr) + (c - pc) * (c - pc) as far from pour join acc on abs(r - pr) <= 3 and abs(c - pc) <= 3)"""


@query("snap_pour_points", with_(SNAP, True) + " select id::bigint as id, r, c, acc from near qualify row_number() over (partition by id order by acc desc, r, c) = 1")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.snap_pour_points(spark.createDataFrame(POUR, "id int, r int, c int"), routing.accumulate(d8, grid), grid, 3))


@query("snap_pour_points_to_streams", with_(SNAP, True) + " select id::bigint as id, r, c, acc from near where acc >= 3 qualify row_number() over (partition by id order by far, r, c) = 1")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    acc = settle(routing.accumulate(d8, grid), "accumulation")
    return ints(routing.snap_pour_points(spark.createDataFrame(POUR, "id int, r int, c int"), acc, grid, 3, routing.streams(acc, 3.0)))


@query("planchon_darboux", SQL["fill_depressions"].replace("greatest(n.z, w.v)", "greatest(n.z, w.v + 0.01::double)"))
def _(spark, sf_dir):
    return ints(rounded(conditioning.planchon_darboux(*dem(spark, sf_dir), 0.01), "r", "c"))


@query("stream_grid_points", with_(PLACED) + " select r, c, min(z) as low, max(z) as high, round(avg(z), 4) as mean, count(*) as n from p group by r, c")
def _(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/lineitem.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    return ints(gridding.run_available(gridding.grid_stream(as_points(feed), BINS)).withColumn("mean", F.round("mean", 4)))
