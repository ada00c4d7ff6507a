"""Queries over shapes, flats, links, meshes and nearest points, with their SQL. The shapes are literals."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.grid import SQRT2, GridMeta, embedding_dem, line_item_points
from rillwork.operators import basins, breaching, conditioning, interpolate, mesh, routing, streams, terrain, vectors, zonal
from rillwork.plans.store import settle
from rillwork.queries import CELLS, D8, DEM, QUERIES, REACH, ROOTS, SQL, ST, _upscale_sql, dem, ints, query, rounded, routed, stream_nodes, with_
from rillwork.sources import tiles

__all__ = ["QUERIES", "SQL"]

LINES = {1: [(3.2, -4.1), (40.7, -90.3), (41.3, -140.9)], 2: [(60.1, -20.2), (10.4, -80.8)]}
ROADS = {1: [(2.3, -60.6), (62.8, -61.9)]}
POLYGONS = {1: [[(5.13, -7.29), (30.41, -12.37), (22.77, -40.61)], [(15.21, -15.83), (21.37, -17.11), (18.91, -24.23)]], 2: [[(20.33, -20.57), (50.71, -30.19), (40.47, -70.83), (12.59, -55.41)]]}
POINTS, RINGS = "array<struct<x:double,y:double>>", "array<array<struct<x:double,y:double>>>"


def lines_of(spark, lines):
    return spark.createDataFrame([(i, [*p]) for i, p in lines.items()], f"id int, points {POINTS}")


def polygons_of(spark):
    return spark.createDataFrame([(i, p) for i, p in POLYGONS.items()], f"id int, rings {RINGS}")


def _segments(lines) -> str:
    return ", ".join(f"({i}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for i, p in lines.items() for a, b in zip(p, p[1:], strict=False))


def _edges() -> str:
    return ", ".join(f"({i}, {a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for i, rings in POLYGONS.items() for p in rings for a, b in zip(p, [*p[1:], p[0]], strict=True))


def line_sql(name: str, lines) -> str:
    return f""", {name}_s(id, x1, y1, x2, y2) as (values {_segments(lines)}), {name}_n as (select *, 2 * greatest(floor(abs(y1 - y2)), floor(abs(x2 - x1)), 1)::bigint as n from {name}_s),
{name} as (select distinct id, floor(-y1 + i / n::double * (y1 - y2))::bigint as r, floor(x1 + i / n::double * (x2 - x1))::bigint as c from {name}_n, range(0, 200) t(i), size where i <= n
  qualify r >= 0 and r < max(nr) over () and c between 0 and 63)"""


INSIDE = f""", edge(id, ax, ay, bx, b_y) as (values {_edges()}), inside as (select id, r, c from dem, edge where (ay > -(r + 0.5)) <> (b_y > -(r + 0.5)) and c + 0.5 < ax + (-(r + 0.5) - ay) / (b_y - ay) * (bx - ax) group by id, r, c having count(*) % 2 = 1)"""
BURNT = DEM + line_sql("line", LINES)


@query("line_cells", with_(BURNT) + " select id::bigint as id, r, c from line")
def _(spark, sf_dir):
    return ints(vectors.line_cells(lines_of(spark, LINES), dem(spark, sf_dir)[1]))


@query("polygon_cells", with_(DEM + INSIDE) + " select id::bigint as id, r, c from inside")
def _(spark, sf_dir):
    return ints(vectors.polygon_cells(polygons_of(spark), dem(spark, sf_dir)[1]))


@query("burn_streams", with_(BURNT + ", cut as (select d.r, d.c, z - (case when l.r is null then 0 else 0.5::double end) as z from dem d left join (select distinct r, c from line) l on l.r = d.r and l.c = d.c)" + """, w(r, c, v) using key (r, c) as (select r, c, z as v from cut, size where r = 0 or c = 0 or r = nr - 1 or c = 63
  union select n.r, n.c, min(greatest(n.z, w.v)) from w, offs join cut n on true left join recurring.w x on x.r = n.r and x.c = n.c
  where n.r = w.r + dr and n.c = w.c + dc and (x.v is null or greatest(n.z, w.v) < x.v) group by n.r, n.c)""", True) + " select r, c, round(v, 6) as z from w")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(vectors.burn_streams(cells, lines_of(spark, LINES), grid, 0.5), "r", "c"))


@query("burn_agree", with_(BURNT) + """, near as (select d.r, d.c, d.z, min(greatest(abs(d.r - l.r), abs(d.c - l.c))) as k from dem d left join line l on abs(d.r - l.r) <= 3 and abs(d.c - l.c) <= 3 group by d.r, d.c, d.z)
select r, c, round(z - coalesce(2 * (1 - k / 3::double) + 0.1::double, 0), 6) as z from near""")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(vectors.burn_agree(cells, lines_of(spark, LINES), grid, 2.0, 0.1, 3), "r", "c"))


@query("enforce_culverts", with_(BURNT + line_sql("road", ROADS)) + """ select d.r, d.c, round(z - (case when x.r is null then 0 else 1 end), 6) as z from dem d
left join (select r, c from line intersect select r, c from road) x on x.r = d.r and x.c = d.c""")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(vectors.enforce_culverts(cells, lines_of(spark, ROADS), lines_of(spark, LINES), grid), "r", "c"))


@query("enforce_breaklines", with_(BURNT) + " select d.r, d.c, round(z + (case when x.r is null then 0 else 1 end), 6) as z from dem d left join (select distinct r, c from line) x on x.r = d.r and x.c = d.c")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(vectors.enforce_breaklines(cells, lines_of(spark, LINES), grid), "r", "c"))


@query("burn_buildings", with_(CELLS + INSIDE) + " select d.r, d.c, round(z + 10 * coalesce(n, 0), 6) as z from dem d left join (select r, c, count(*) as n from inside group by r, c) x on x.r = d.r and x.c = d.c")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(vectors.burn_buildings(cells, polygons_of(spark), grid), "r", "c"))


for _method, _stat in {"min": "min(z)", "mean": "avg(z)", "median": "median(z)"}.items():
    query(f"hydroflatten_{_method}", with_(DEM + INSIDE) + f""", lv as (select id, {_stat} as v from inside i join dem d on d.r = i.r and d.c = i.c group by id), top as (select r, c, max(id) as id from inside group by r, c)
select d.r, d.c, round(coalesce(v, z), 6) as z from dem d left join top on top.r = d.r and top.c = d.c left join lv on lv.id = top.id""")(
        lambda spark, sf_dir, method=_method: (lambda d: ints(rounded(vectors.hydroflatten(d[0], polygons_of(spark), d[1], method), "r", "c")))(dem(spark, sf_dir))
    )

CLIP = [[(10.5, 1.5), (150.5, 2.25), (90.25, 9.75), (30.5, 8.5)]]
CLIP_EDGES = ", ".join(f"({a[0]}::double, {a[1]}::double, {b[0]}::double, {b[1]}::double)" for a, b in zip(CLIP[0], [*CLIP[0][1:], CLIP[0][0]], strict=True))


@query("clip_points", f"""with edge(ax, ay, bx, b_y) as (values {CLIP_EDGES}), p as (select row_number() over () as i, l_partkey as x, l_suppkey as y, l_extendedprice as z from lineitem),
x as (select p.i, any_value(z) as z, count(*) filter (where (ay > y) <> (b_y > y) and x < ax + (y - ay) / (b_y - ay) * (bx - ax)) % 2 = 1 as inside from p, edge group by p.i)
select inside, count(*) as n, round(sum(z), 2) as total from x group by inside""")
def _(spark, sf_dir):
    p = line_item_points(spark, sf_dir)
    both = vectors.clip(p, CLIP).withColumn("inside", F.lit(True)).unionByName(vectors.clip(p, CLIP, inverse=True).withColumn("inside", F.lit(False)))
    return both.groupBy("inside").agg(F.count("*").alias("n"), F.round(F.sum("z"), 2).alias("total"))


SPREAD = "select {0} from {1} join e on e.node = {1}.node left join recurring.{1} x on x.node = e.nb where x.w is null group by e.nb"


@query("resolve_flats", with_(DEM + """, f as (select r, c, floor(z * 20) as z from dem), adj as (select a.r * 64 + a.c as node, b.r * 64 + b.c as nb, a.z, b.z as zn from f a, offs join f b on true where b.r = a.r + dr and b.c = a.c + dc),
flat as (select node, any_value(z) as z, bool_or(zn < z) as low, bool_or(zn > z) as high from adj group by node having bool_or(zn = z)), e as (select node, nb from adj where z = zn),
lab(node, w) using key (node) as (select node, node from flat union select e.nb, min(lab.w) from lab join e on e.node = lab.node join recurring.lab x on x.node = e.nb where lab.w < x.w group by e.nb),
lo(node, w) using key (node) as (select node, 1::bigint from flat where low union """ + SPREAD.format("e.nb, min(lo.w) + 1", "lo") + """),
hi(node, w) using key (node) as (select node, 1::bigint from flat where high union """ + SPREAD.format("e.nb, min(hi.w) + 1", "hi") + """),
k as (select flat.node, low, lab.w as p, lo.w as lo, hi.w as hi from flat join lab on lab.node = flat.node left join lo on lo.node = flat.node left join hi on hi.node = flat.node),
g as (select p, bool_or(low) as drains, max(hi) as deep from k group by p)""", True)
  + " select f.r, f.c, round(f.z + coalesce(case when drains and not low then 1e-3::double * (2 * coalesce(deep - hi, 0) + lo) end, 0), 6) as z from f left join k on k.node = f.r * 64 + f.c left join g on g.p = k.p")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(conditioning.resolve_flats(cells.withColumn("z", F.floor(F.col("z") * 20).cast("double")), grid, 1e-3), "r", "c"))


@query("stochastic_depressions")
def _(spark, sf_dir):
    return ints(conditioning.stochastic_depressions(*dem(spark, sf_dir), sigma=0.01, runs=4, seed=7))


@query("upscale_cotat", _upscale_sql("1.0::double").split(",\nv as")[0] + """, top as (select br, bc, node from b qualify row_number() over (partition by br, bc order by n desc, node) = 1)
select top.br as r, top.bc as c, max(go.dir)::bigint as dir from top left join go on go.node = top.node and go.dir is not null group by top.br, top.bc""")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.upscale_cotat(d8, settle(routing.accumulate(d8, grid), "accumulation"), grid, 4))


LABELS = D8 + ", " + REACH + ROOTS + """, ids as (select node, row_number() over (order by node) as b from d8 where dir is null),
l as (select d8.r, d8.c, d8.node, ids.b from d8 join roots on roots.node = d8.node join ids on ids.node = roots.root), sz as (select b, count(*) as n from l group by b)"""


@query("basins_merged", with_(LABELS + """, touch as (select a.b, o.b as other from l a, offs join l o on true where o.r = a.r + dr and o.c = a.c + dc group by a.b, o.b),
into_ as (select t.b, other from touch t join sz s on s.b = t.b join sz on sz.b = other where s.n < 4 and sz.n >= 4 qualify row_number() over (partition by t.b order by sz.n desc, other) = 1)""", True)
  + " select l.r, l.c, (case when sz.n >= 4 then l.b else coalesce(into_.other, 0) end)::bigint as basin_id from l join sz on sz.b = l.b left join into_ on into_.b = l.b")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.merge_small(settle(routing.basins(d8, grid), "basins"), grid, 4, into_neighbour=True))


@query("basins_dropped", with_(LABELS, True) + " select l.r, l.c, (case when sz.n >= 4 then l.b else 0 end)::bigint as basin_id from l join sz on sz.b = l.b")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(routing.merge_small(settle(routing.basins(d8, grid), "basins"), grid, 4))


@query("isobasins", with_(ST + """, q as (select st.node, st.ptr, a.n // 6 as q from st join a on a.down = st.node), up as (select ptr, max(q) as u from q where ptr is not null group by ptr),
seed as (select q.node, row_number() over (order by q.node) as id from q left join up on up.ptr = q.node where q.q > coalesce(u, -1)), x as (select node, down from reach union all select node, node from d8)""", True)
  + " select d8.r, d8.c, coalesce(min(seed.id), 0)::bigint as basin_id from d8 join x on x.node = d8.node left join seed on seed.node = x.down group by d8.r, d8.c")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    acc = settle(routing.accumulate(d8, grid), "accumulation")
    return ints(routing.isobasins(d8, acc, routing.streams(acc, 3.0), grid, 6e-6))


CHAIN = ST + """, fed as (select ptr as node, count(*) as n from st where ptr is not null group by ptr), starts as (select st.node from st left join fed on fed.node = st.node where coalesce(n, 0) <> 1),
st2 as (select st.*, s.node is not null as stops from st left join starts s on s.node = st.ptr), link as (select node, row_number() over (order by node) as link_id from starts),
chain(first, node, ptr, stops, dir) as (select s.node, s.node, s.ptr, s.stops, s.dir from st2 s join starts t on t.node = s.node union all select first, s.node, s.ptr, s.stops, s.dir from chain join st2 s on s.node = chain.ptr where not chain.stops)"""


@query("stream_links", with_(CHAIN + f""", body as (select first, count(*) as n, sum(case when ptr is null then 0.0::double when dir % 2 = 0 then 1.0::double else {SQRT2}::double end) as len, max(case when ptr is null then node when stops then ptr end) as last, bool_or(stops and ptr is not null) as joins from chain group by first),
g as (select link_id, first, last, len, greatest(a.z - b.z, 0) as fall, sqrt(pow(a.r - b.r, 2) + pow(a.c - b.c, 2)) as straight from body join link on link.node = first join d8 a on a.node = first join d8 b on b.node = last where n > 1 or joins)""", True)
  + " select link_id::bigint as link_id, first as from_node, last as to_node, round(len, 6) as length_m, round(fall, 6) as drop_m, round(fall / len, 6) as mean_slope, round(case when straight > 0 then len / straight else 1 end, 6) as sinuosity from g")
def _(spark, sf_dir):
    nodes, grid = stream_nodes(spark, sf_dir)
    out = streams.link_lines(nodes, grid, embedding_dem(spark, sf_dir)).drop("line")
    return ints(rounded(out, "link_id", "from_node", "to_node"))


@query("link_basins", with_(CHAIN + """, lk as (select chain.node, link_id from chain join link on link.node = first), y as (select node, down, hops from reach union all select node, node, 0 from d8),
f as (select y.node, first(link_id order by hops) as id from y join lk on lk.node = y.down group by y.node)""", True) + " select d8.r, d8.c, coalesce(id, 0)::bigint as basin_id from d8 left join f on f.node = d8.node")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    nodes = streams.stream_forest(d8, routing.streams(routing.accumulate(d8, grid), 3.0), grid)
    return ints(streams.link_basins(d8, nodes, grid))


@query("hand_euclidean", with_(D8 + ", " + REACH + """, st as (select d8.node, d8.r, d8.c, d8.z from d8 join (select down from reach group by down having count(*) >= 5) a on a.down = d8.node)""", True)
  + " select d8.r, d8.c, round(d8.z - arg_min(st.z, ((d8.r - st.r) * (d8.r - st.r) + (d8.c - st.c) * (d8.c - st.c)) * 1000000 + st.node), 6) as hand from d8, st group by d8.r, d8.c, d8.z")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    return ints(rounded(interpolate.hand_euclidean(cells, routing.streams(routing.accumulate(d8, grid), 5.0)), "r", "c"))


COARSE = GridMeta(16, 16, 0.0, 125.0, 0.0, 6.25)
PAIRS = "p as (select l_partkey::double as x, l_suppkey::double as y, l_extendedprice::double as z from lineitem), near as (select i.i as r, j.j as c, min({{'d': pow(x - (j.j + 0.5) * 125, 2) + pow(y - (i.i + 0.5) * 6.25, 2), 'y': y, 'x': x, 'z': z}}, {0}) as best from p, range(0, 16) i(i), range(0, 16) j(j) group by r, c)"


@query("grid_points_nn", with_(PAIRS.format(1)) + " select r, c, round(best[1].z, 4) as z from near")
def _(spark, sf_dir):
    return ints(interpolate.nearest_points(line_item_points(spark, sf_dir), COARSE).select("r", "c", F.round("z", 4).alias("z")))


@query("grid_points_idw", with_(PAIRS.format(8)) + ", u as (select r, c, unnest(best) as b, best[1] as f from near) select r, c, round(case when any_value(f.d) = 0 then any_value(f.z) else sum(b.z / b.d) / sum(1 / b.d) end, 4) as z from u group by r, c")
def _(spark, sf_dir):
    return ints(interpolate.inverse_distance(line_item_points(spark, sf_dir), COARSE).select("r", "c", F.round("z", 4).alias("z")))


for _kind in ("laplacian", "biharmonic"):
    query(f"interpolate_{_kind}")(lambda spark, sf_dir, kind=_kind: (lambda d: ints(rounded(interpolate.relax(d[0].withColumn("z", F.when((F.col("r") * 7 + F.col("c") * 13) % 5 > 0, F.col("z"))), d[1], biharmonic=kind == "biharmonic"), "r", "c")))(dem(spark, sf_dir)))


@query("basin_hydrology", with_(LABELS + f""", a as (select down, count(*) as n from reach group by down), walk(node, down, len) as (select node, ptr, case when dir % 2 = 0 then 1.0::double else {SQRT2}::double end from d8 where ptr is not null
  union all select walk.node, d8.ptr, len + case when d8.dir % 2 = 0 then 1.0::double else {SQRT2}::double end from walk join d8 on d8.node = walk.down where d8.ptr is not null),
w as (select down, max(len) as len from walk group by down), s as (select r, c, max(s) as s from drop8 group by r, c)""", True)
  + f""" select l.b::bigint as basin_id, round(avg(s.s), 6) as mean_slope, round(max(coalesce(w.len, 0)), 6) as longest_flow_path_m,
  round(sum(case when coalesce(a.n, 0) < 5 then 0 when coalesce(d8.dir % 2, 0) = 0 then 1.0::double else {SQRT2}::double end) / 1000 / (count(*) / 1e6::double), 6) as drainage_density_km_per_km2
  from l join d8 on d8.node = l.node join s on s.r = l.r and s.c = l.c left join a on a.down = l.node left join w on w.down = l.node group by l.b""")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    wet = routing.streams(settle(routing.accumulate(d8, grid), "accumulation"), 5.0)
    return ints(rounded(zonal.basin_hydrology(settle(routing.basins(d8, grid), "basins"), terrain.slope(cells, grid), routing.upslope_length(d8, grid), wet, d8, grid), "basin_id"))


def lattice(spark, sf_dir):
    """The raster as a mesh of two triangles for each square of cells."""
    cells, grid = dem(spark, sf_dir)
    vid = grid.node(F.col("r"), F.col("c"))
    v = cells.select(vid.alias("vid"), (F.col("c") + F.col("z")).alias("x"), (-F.col("r")).cast("double").alias("y"), "z")
    quads = cells.where(f"r < {grid.rows - 1} and c < {grid.cols - 1}").select(vid.alias("v"))
    n = grid.cols
    two = F.array(*(F.struct(*(x.cast("bigint").alias(k) for k, x in zip(("tid", "a", "b", "c"), t, strict=True))) for t in ((F.col("v") * 2, F.col("v"), F.col("v") + 1, F.col("v") + n), (F.col("v") * 2 + 1, F.col("v") + 1, F.col("v") + n + 1, F.col("v") + n))))
    return v, quads.select(F.explode(two).alias("t")).select("t.*")


MESH = DEM + """, v as (select r * 64 + c as vid, c + z as x, -r::double as y, z from dem), quad as (select r * 64 + c as q from dem, size where r < nr - 1 and c < 63),
tri as (select q * 2 as tid, q as a, q + 1 as b, q + 64 as c from quad union all select q * 2 + 1, q + 1, q + 65, q + 64 from quad),
side as (select a as p, b as q from tri union all select b, c from tri union all select c, a from tri), edge as (select least(p, q) as u, greatest(p, q) as w, count(*) as n from side group by 1, 2),
rim as (select u as vid from edge where n = 1 union select w from edge where n = 1), both_ as (select u as vid, w as o from edge union all select w, u from edge)"""


@query("mesh_boundary", with_(MESH) + " select vid from rim")
def _(spark, sf_dir):
    return mesh.boundary_vertices(lattice(spark, sf_dir)[1])


@query("mesh_neighbours", with_(MESH) + " select vid, string_agg(o::varchar, ' ' order by o) as ring from both_ group by vid")
def _(spark, sf_dir):
    return mesh.neighbours(lattice(spark, sf_dir)[1]).select("vid", F.concat_ws(" ", F.col("ring").cast("array<string>")).alias("ring"))


def _smooth(src: str, to: str) -> str:
    return f", {to} as (select s.vid, case when rim.vid is null then s.x + 0.5 * (m.x - s.x) else s.x end as x, case when rim.vid is null then s.y + 0.5 * (m.y - s.y) else s.y end as y, s.z from {src} s left join rim on rim.vid = s.vid join (select b.vid, avg(o.x) as x, avg(o.y) as y from both_ b join {src} o on o.vid = b.o group by b.vid) m on m.vid = s.vid)"


@query("mesh_smooth", with_(MESH + _smooth("v", "s1") + _smooth("s1", "s2")) + " select vid, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from s2")
def _(spark, sf_dir):
    return rounded(mesh.laplacian_smooth(*lattice(spark, sf_dir), iterations=2), "vid")


@query("mesh_aspect", with_(MESH) + """, g as (select tid, sqrt(pow(vb.x - vc.x, 2) + pow(vb.y - vc.y, 2)) as l, sqrt(pow(va.x - vc.x, 2) + pow(va.y - vc.y, 2)) as m, sqrt(pow(va.x - vb.x, 2) + pow(va.y - vb.y, 2)) as n
  from tri join v va on va.vid = a join v vb on vb.vid = b join v vc on vc.vid = tri.c) select tid, round(l * m * n / ((l + m - n) * (l - m + n) * (m + n - l)), 4) as ratio from g""")
def _(spark, sf_dir):
    return mesh.aspect_ratios(*lattice(spark, sf_dir)).select("tid", F.round("ratio", 4).alias("ratio"))


@query("tile_windows", with_(DEM) + " select i * 120 as row_off, j * 28 as col_off, least(128, nr - i * 120)::bigint as n_rows, least(36, 64 - j * 28)::bigint as n_cols from size, range(0, 1000) i(i), range(0, 3) j(j) where i * 120 < nr")
def _(spark, sf_dir):
    return ints(tiles.tile_windows(spark, dem(spark, sf_dir)[1], 128, 36, 8))


@query("export_ascii", with_(DEM) + " select r, string_agg(printf('%.6f', z), ' ' order by c) as line from dem group by r")
def _(spark, sf_dir):
    return ints(tiles.ascii_rows(embedding_dem(spark, sf_dir)))


for _method in breaching.METHODS:
    query(f"breach_{_method}")(lambda spark, sf_dir, method=_method: (lambda d: ints(rounded(breaching.breach_depressions(*d, method, max_length=4), "r", "c")))(dem(spark, sf_dir)))


@query("burn_topological_breach")
def _(spark, sf_dir):
    cells, grid = dem(spark, sf_dir)
    return ints(rounded(breaching.burn_by_breaching(cells, vectors.line_cells(lines_of(spark, LINES), grid), grid, 0.5, max_length=4), "r", "c"))


@query("pfafstetter")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    acc = settle(routing.accumulate(d8, grid), "accumulation")
    return ints(basins.pfafstetter(d8, acc, routing.streams(acc, 3.0), grid, 2))


@query("lowest_basin", with_(LABELS, True) + " select r, c, case when b = 1 then 1::bigint end as basin_id from l")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return ints(basins.lowest_basin(settle(routing.basins(d8, grid), "basins")))


@query("basin_polygons")
def _(spark, sf_dir):
    _, d8, grid = routed(spark, sf_dir)
    return basins.to_polygons(routing.basins(d8, grid), grid)


@query("flow_accumulation_int", with_(D8 + ", " + REACH, True) + " select d8.r, d8.c, coalesce(n, 0)::bigint as acc from d8 left join (select down, count(*) as n from reach group by down) a on a.down = d8.node")
def _(spark, sf_dir):
    cells, d8, grid = routed(spark, sf_dir)
    return ints(basins.flow_accumulation(cells, d8, grid))
