"""Tile kernels and what is built on them against plain versions, with tiles so small that most paths cross several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.operators import basins, breaching, conditioning, filling, routing
from rillwork.plans import drainage
from rillwork.sources import las, rasters, tiles
from tests.test_shapes import array_of, cells_of


def plain_fill(z):
    w = np.where(np.isnan(z), np.nan, np.inf)
    for r, c in np.ndindex(z.shape):
        around = [(r + dr, c + dc) for dr, dc in zip(DR, DC)]
        if any(not (0 <= a < z.shape[0] and 0 <= b < z.shape[1]) or np.isnan(z[a, b]) for a, b in around):
            w[r, c] = z[r, c]
    while True:
        p = np.pad(w, 1, constant_values=np.nan)
        low = np.fmin.reduce([p[1 + dr : 1 + dr + z.shape[0], 1 + dc : 1 + dc + z.shape[1]] for dr, dc in zip(DR, DC)])
        new = np.where(np.isnan(z), np.nan, np.fmin(w, np.fmax(z, low)))
        if np.array_equal(new, w, equal_nan=True):
            return w
        w = new


def test_filling_over_several_levels_of_groups(spark, monkeypatch):
    monkeypatch.setattr(filling, "GROUP", 2)
    z = np.random.default_rng(4).integers(0, 9, (27, 21)).astype(float)
    z[5:8, 9] = z[20, 3:6] = np.nan
    got = array_of(conditioning.fill_depressions(cells_of(spark, z), GridMeta(27, 21), tile=4), z.shape)
    assert np.array_equal(got, plain_fill(z), equal_nan=True)


def test_noisy_depressions_take_the_same_noise(spark):
    z = np.random.default_rng(6).random((9, 8))
    cells = cells_of(spark, z)
    expected, given = np.zeros(z.shape), cells.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select("run", "r", "c", conditioning.noise(11).alias("n")).collect()
    draws = np.array([r.n for r in given])
    assert len(set(draws)) == len(draws) and abs(draws.mean()) < 0.25 and 0.8 < draws.std() < 1.2
    for run in range(3):
        noisy = z.copy()
        for r in given:
            if r.run == run:
                noisy[r.r, r.c] += 0.3 * r.n
        expected += plain_fill(noisy) > noisy
    got = array_of(conditioning.stochastic_depressions(cells, GridMeta(9, 8), 0.3, 3, seed=11, tile=4), z.shape)
    assert np.allclose(got, expected / 3)


def flows(spark, shape, seed):
    """Random directions, some pairs of cells pointing at each other; null at a few cells."""
    d = np.random.default_rng(seed).integers(0, 9, shape)
    d[3, 3:6] = [6, 2, 2]
    d[7:12, 8] = 0
    rows = [(int(r), int(c), None if v == 8 else int(v)) for (r, c), v in np.ndenumerate(d)]
    return d, spark.createDataFrame(rows, "r int, c int, dir int")


def plain_paths(d):
    """Receiver of each cell, or None; cells on cycles."""
    to = {}
    for (r, c), k in np.ndenumerate(d):
        a, b = (r + DR[k], c + DC[k]) if k < 8 else (-1, -1)
        to[r, c] = (a, b) if 0 <= a < d.shape[0] and 0 <= b < d.shape[1] else None
    looping = set()
    for start in to:
        seen, at = {}, start
        while at is not None and at not in seen:
            seen[at] = len(seen)
            at = to[at]
        if at is not None:
            looping |= {p for p, n in seen.items() if n >= seen[at]}
    return {p: None if p in looping else q for p, q in to.items()}


def test_contracted_drainage_with_cycles(spark):
    d, directions = flows(spark, (17, 14), 5)
    to, grid = plain_paths(d), GridMeta(17, 14)
    acc, length, first, least = (np.zeros(d.shape), np.zeros(d.shape), np.full(d.shape, np.nan), np.full(d.shape, np.nan))
    marks = {p: float((p[0] * 7 + p[1] * 3) % 50) for p in to if (p[0] + p[1]) % 5 == 0}
    for p in to:
        at, way, seen = p, 0.0, []
        while at is not None:
            seen.append(at)
            if at != p:
                acc[at] += 1
                length[at] = max(length[at], way)
            way += grid.step(int(d[at])) if d[at] < 8 else 0
            at = to[at]
        found = [marks[q] for q in seen if q in marks]
        if found:
            first[p], least[p] = found[0], min(found)
    marked = spark.createDataFrame([(r, c, v) for (r, c), v in marks.items()], "r int, c int, v double")
    marked = directions.join(marked, ["r", "c"], "left")
    assert np.array_equal(array_of(drainage.upstream_totals(directions.withColumn("w", F.lit(1.0)), grid, tile=4), d.shape), acc)
    assert np.allclose(array_of(drainage.upstream_lengths(directions, grid, tile=4), d.shape), length)
    for flag, expected in ((False, first), (True, least)):
        got = array_of(drainage.along_paths(marked, grid, flag, tile=4), d.shape)
        ends = np.array([[bool(np.isnan(expected[r, c])) for c in range(14)] for r in range(17)])
        assert np.array_equal(got[~ends], expected[~ends])


def test_shares_pass_down_over_tiles(spark):
    z = np.random.default_rng(9).random((11, 10))
    cells, grid = cells_of(spark, z), GridMeta(11, 10)
    for quinn in (True, False):  # the second is Holmgren's rule
        fractions = routing.flow_direction_mfd(cells, grid, 1.3, quinn)
        share = {(r.r, r.c): r.fractions for r in fractions.collect()}
        acc = np.zeros(z.shape)
        for _, r, c in sorted(((v, r, c) for (r, c), v in np.ndenumerate(z)), reverse=True):
            weight = [0.0] * 8
            for k in range(8):
                a, b = r + DR[k], c + DC[k]
                if 0 <= a < 11 and 0 <= b < 10 and z[a, b] < z[r, c]:
                    drop = (z[r, c] - z[a, b]) / (1 if k % 2 == 0 else np.sqrt(2))
                    weight[k] = drop**1.3 * ((0.5 if k % 2 == 0 else 1 / (2 * np.sqrt(2))) if quinn else 1)
            total = sum(weight)
            assert np.allclose(share[r, c], [w / total if total else 0 for w in weight])
            for k, w in enumerate(weight):
                if w:
                    acc[r + DR[k], c + DC[k]] += (1 + acc[r, c]) * w / total
        got = drainage.passed_down(cells.withColumn("w", F.lit(1.0)), routing.mfd_edges(fractions, grid), grid, tile=4)
        assert np.allclose(array_of(got, z.shape), acc)


def test_rho8_and_forced_directions(spark):
    z = np.random.default_rng(3).random((7, 7))
    cells, grid = cells_of(spark, z), GridMeta(7, 7)
    chance = lambda k: (F.pmod(F.xxhash64(F.lit(5), "r", "c", F.lit(k)), F.lit(1 << 53)) / F.lit(float(1 << 53))).alias(f"u{k}")
    u = {(r.r, r.c): r for r in cells.select("r", "c", *map(chance, range(8))).collect()}
    expected = {}
    for (r, c), v in np.ndenumerate(z):
        drops = []
        for k in range(8):
            a, b = r + DR[k], c + DC[k]
            if 0 <= a < 7 and 0 <= b < 7:
                drops.append(((v - z[a, b]) / (2 - u[r, c][f"u{k}"]) if k % 2 == 0 else (v - z[a, b]) / np.sqrt(2), -k))
        best = max(drops)
        expected[r, c] = -best[1] if best[0] > 0 else None
    assert {(r.r, r.c): r.dir for r in routing.flow_direction_rho8(cells, grid, 5).collect()} == expected
    forced = spark.createDataFrame([(2, 2, 6), (3, 3, 1)], "r int, c int, dir int")
    got = {(r.r, r.c): r.dir for r in routing.flow_direction_d8(cells, grid, forced).collect()}
    assert got[2, 2] == 6 and got[3, 3] == 1


def plain_pits(z):
    out = []
    for r in range(1, z.shape[0] - 1):
        for c in range(1, z.shape[1] - 1):
            near = [z[r + dr, c + dc] for dr, dc in zip(DR, DC) if not np.isnan(z[r + dr, c + dc])]
            if near and all(z[r, c] < v for v in near):
                out.append((z[r, c], r, c))
    return sorted(out)


def plain_breach(z, method, max_length, max_depth):
    """All pits one after the other over the whole grid."""
    z, (rows, cols) = z.copy(), z.shape
    at = lambda r, c: 0 <= r < rows and 0 <= c < cols
    order = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
    for v, r, c in plain_pits(z):
        v, done = z[r, c], False
        for a, b in [(a, b) for a in range(-2, 3) for b in range(-2, 3) if max(abs(a), abs(b)) == 2]:
            if done or not at(r + a, c + b):
                continue
            far = z[r + a, c + b]
            if not (np.isnan(far) or far < v):
                continue
            level = v if np.isnan(far) else (v + far) / 2
            for e, f in order:
                if abs(a - e) <= 1 and abs(b - f) <= 1 and at(r + e, c + f) and z[r + e, c + f] > level:
                    z[r + e, c + f], done = level, True
                    break
    if method == "single_cell":
        return z
    fall, failed = max(np.nanmax(z) - np.nanmin(z), 1.0) * 1e-9, False
    for _, r, c in plain_pits(z):
        v = z[r, c]
        if not all(v < z[r + a, c + b] for a, b in order if not np.isnan(z[r + a, c + b])):
            continue
        front, best, closed, serial, outlet = [(0.0, 0, r, c)], {(r, c): (0.0, 0, None)}, set(), 0, None
        while front and outlet is None:
            front.sort(reverse=True)
            dug, _, x, y = front.pop()
            if (x, y) in closed:
                continue
            closed.add((x, y))
            if max_depth is not None and dug > max_depth:
                break
            n = best[x, y][1] + 1
            for a, b in order:
                p = (x + a, y + b)
                if not at(*p) or p in closed or n > max_length:
                    continue
                if np.isnan(z[p]) or z[p] <= v - n * fall:
                    outlet = (x, y)
                    break
                more = dug + max(0.0, z[p] - (v - n * fall))
                if more < best.get(p, (np.inf,))[0]:
                    serial += 1
                    best[p] = (more, n, (x, y))
                    front.append((more, serial, *p))
        failed |= outlet is None
        while outlet is not None and best[outlet][2] is not None:
            z[outlet] = min(z[outlet], v - best[outlet][1] * fall)
            outlet = best[outlet][2]
    return plain_fill(z) if method == "hybrid" and failed else z


@pytest.mark.parametrize(("method", "depth"), [("single_cell", None), ("least_cost", None), ("hybrid", 0.4)])
def test_breaching_equals_pits_in_turn(spark, method, depth):
    z = np.random.default_rng(2).random((24, 26)).round(3) * 3 + np.abs(np.arange(26) - 13) * 0.1
    z[10:12, 4] = np.nan
    got = array_of(breaching.breach_depressions(cells_of(spark, z), GridMeta(24, 26), method, 3, depth, tile=8), z.shape)
    assert np.allclose(got, plain_breach(z, method, 3, depth), atol=1e-12, equal_nan=True)
    with pytest.raises(ValueError):
        breaching.breach_depressions(cells_of(spark, z), GridMeta(24, 26), "deep")


def plain_pfafstetter(to, d, acc, wet, level, part=None):
    part = set(to) if part is None else part
    streams = [p for p in part if wet[p]]
    if not streams:
        return {p: 10 ** (level - 1) for p in part} if level == 1 else {p: 10 ** (level - 1) + plain_pfafstetter(to, d, acc, wet, level - 1, part)[p] for p in part}
    outlet = min(streams, key=lambda p: (-acc[p], p))
    label, sides, at, place = {outlet: 5}, [], outlet, 0
    while True:
        inflows = sorted(((p for p in streams if to[p] == at)), key=lambda p: ((int(d[p]) + 4) % 8))
        if not inflows:
            break
        best = max(inflows, key=lambda p: acc[p])
        sides += [(-acc[p], place, n, p) for n, p in enumerate(inflows) if p != best]
        label[best], at, place = 5, best, place + 1
    top = sorted(sorted(sides, key=lambda s: s[0])[:4], key=lambda s: s[1])
    label |= {p: 2 * i + 2 for i, (*_, p) in enumerate(top)}
    out = {}
    for p in part:
        at = p
        while at is not None and at in part and at not in label:
            at = to[at]
        out[p] = label[at] if at is not None and at in part else 0
    if level == 1:
        return out
    deeper = {}
    for code in set(out.values()) - {0}:
        below = plain_pfafstetter(to, d, acc, wet, level - 1, {p for p in part if out[p] == code})
        deeper |= {p: code * 10 ** (level - 1) + v for p, v in below.items()}
    return {p: deeper.get(p, 0) for p in part}


def test_pfafstetter_over_two_levels(spark):
    z = np.random.default_rng(1).random((14, 13)) + np.add.outer(np.arange(14) * 0.8, np.abs(np.arange(13) - 6) * 0.5)
    cells, grid = cells_of(spark, z), GridMeta(14, 13)
    directions = routing.flow_direction_d8(cells, grid).cache()
    acc = routing.accumulate(directions, grid).cache()
    wet = routing.streams(acc, 2.0)
    d, a = np.full(z.shape, 8), array_of(acc, z.shape)
    for r in directions.collect():
        d[r.r, r.c] = 8 if r.dir is None else r.dir
    expected = plain_pfafstetter(plain_paths(d), d, a, a >= 2, 2)
    got = {(r.r, r.c): r.code for r in basins.pfafstetter(directions, acc, wet, grid, 2).collect()}
    assert got == expected and len(set(got.values())) > 6


def test_outlines_cover_their_cells(spark):
    label = np.array([[1, 1, 1, 2], [1, 0, 1, 2], [1, 1, 1, 3], [4, 2, 4, 4], [2, 4, 2, 2]])
    rows = [(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(label)]
    labels = spark.createDataFrame(rows, "r int, c int, basin_id long")
    got = {r.basin_id: r.wkt for r in basins.to_polygons(labels, GridMeta(5, 4, dx=2.0, dy=-2.0)).collect()}
    for b in (1, 2, 3, 4):
        area = 0.0
        for ring in got[b].removeprefix("MULTI").removeprefix("POLYGON ").replace("(", "").rstrip(")").split("), "):
            ring = ring.replace(")", "")
            p = [tuple(map(float, x.split())) for x in ring.split(", ")]
            assert p[0] == p[-1] and len(set(p)) == len(p) - 1
            area += sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:])) / 2
        assert abs(area) == 4 * (label == b).sum()
    assert basins.basin_count(labels) == 4
    assert {(r.r, r.c) for r in basins.lowest_basin(labels).where("basin_id is not null").collect()} == {(int(r), int(c)) for r, c in np.argwhere(label == 1)}


def polygons_of(wkt):
    """Each polygon's rings as lists of corners."""
    text = wkt[len("MULTIPOLYGON (") : -1] if wkt.startswith("MULTI") else wkt[len("POLYGON ") :]
    whole = text.replace("), (", ");(").replace(")), ((", "));((")
    return [[[tuple(map(float, p.split())) for p in ring.strip("() ").split(", ")] for ring in poly.split(");(")] for poly in whole.split("));((")]


def crossings(ring, x, y):
    return sum(x1 == x2 and x1 < x and min(y1, y2) < y < max(y1, y2) for (x1, y1), (x2, y2) in zip(ring, ring[1:]))


def test_outlines_are_valid_and_hold_their_cells_alone(spark):
    """Random labels full of holes, split basins and corners that touch; and a hole that holds a basin's own piece."""
    rng = np.random.default_rng(11)
    grids = [rng.integers(0, 3, (9, 11)) for _ in range(6)]
    nest = np.ones((9, 9), int)
    nest[2:7, 2:7], nest[3:6, 3:6], nest[4, 4] = 0, 1, 0
    for label in [*grids, nest]:
        rows = [(int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(label)]
        for out in basins.to_polygons(spark.createDataFrame(rows, "r int, c int, basin_id long"), GridMeta(*label.shape)).collect():
            parts = polygons_of(out.wkt)
            assert out.wkt.startswith("MULTI") == (len(parts) > 1)
            inside = np.zeros(label.shape, int)
            for shell, *holes in parts:
                for ring in (shell, *holes):
                    assert ring[0] == ring[-1] and len(set(ring)) == len(ring) - 1
                for (r, c), _ in np.ndenumerate(label):
                    in_shell = crossings(shell, c + 0.5, -r - 0.5) % 2
                    in_holes = [crossings(h, c + 0.5, -r - 0.5) % 2 for h in holes]
                    assert sum(in_holes) <= in_shell
                    inside[r, c] += in_shell - sum(in_holes)
            assert (inside == (label == out.basin_id)).all()


def test_stored_rasters_keep_their_tags(spark, tmp_path):
    cells, grid = cells_of(spark, np.arange(30.0).reshape(5, 6)).withColumnRenamed("z", "dir"), GridMeta(5, 6, 10.0, 2.0, 20.0, -2.0, 3857)
    path = str(tmp_path / "fd")
    rasters.write_raster(rasters.Raster(cells, grid, {"routing": "d8"}), path, tile=2)
    back = rasters.open_flow_direction(spark, path)
    assert back.grid == grid and back.tags == {"routing": "d8", "kind": "flow_direction", "encoding": "native"}
    assert sorted(map(tuple, back.cells.collect())) == sorted(map(tuple, cells.collect()))
    assert rasters.open_accumulation(spark, path, routing="rho8").tags["routing"] == "rho8"
    with pytest.raises(ValueError):
        rasters.open_streams(spark, path)
    with pytest.raises(TypeError):
        rasters.open_streams(spark, path, 5, "dinf")
    with pytest.raises(ValueError):
        rasters.Raster(cells, grid, {"routing": "d9"})


def test_las_files_come_back(spark, tmp_path, monkeypatch):
    rows = [(100 + i * 0.25, 7.125 - i, i * 0.5, i % 7, 2 if i % 3 else 6, 1 + i % 4) for i in range(500)]
    points = spark.createDataFrame(rows, "x double, y double, z double, intensity int, classification short, return_number short").repartition(3)
    las.write_las(points, str(tmp_path / "out"))
    got = las.read_las(spark, str(tmp_path / "out")).collect()
    assert sorted(tuple(round(v, 3) for v in r) for r in got) == sorted(rows)
    assert las.las_crs(str(next((tmp_path / "out").glob("*.las")))) is None
    crs = 'GEOGCS["WGS 84",AUTHORITY["EPSG","4326"]]'
    las.write_las(points, str(tmp_path / "named"), 0.001, crs)
    named = [str(f) for f in (tmp_path / "named").glob("*.las")]
    assert named and {las.las_crs(f) for f in named} == {crs}
    assert las.read_las(spark, str(tmp_path / "named")).count() == points.count()


def test_exports_are_files(spark, tmp_path):
    z = np.array([[1.5, np.nan, 2.0], [3.0, 0.25, 4.0]])
    cells, grid = cells_of(spark, z), GridMeta(2, 3)
    read = lambda folder: b"".join(p.read_bytes() for p in sorted(tmp_path.joinpath(*folder).glob("part-*")))
    tiles.export(cells, grid, str(tmp_path / "t"), "tuflow")
    assert np.frombuffer(read(("t", "flt")), "<f4").tolist() == [1.5, -9999.0, 2.0, 3.0, 0.25, 4.0] and b"byteorder LSBFIRST" in read(("t", "header"))
    tiles.export(cells, grid, str(tmp_path / "s"), "sfincs")
    assert read(("s", "msk")) == b"\1\0\1\1\1\1"
    tiles.export(cells, grid, str(tmp_path / "l"), "lisflood_fp")
    assert read(("l", "rows")).decode().split("\n")[:2] == ["1.500000 -9999.000000 2.000000", "3.000000 0.250000 4.000000"] and read(("l", "header")).startswith(b"ncols 3\nnrows 2")
    tiles.export(cells, grid, str(tmp_path / "g"), "gmsh")
    assert b"Line(4) = {4, 1};" in read(("g", "geo"))
