"""Focal terrain operators over window3 and focal statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.grid import DC, DR, GridMeta
from rillwork.plans.blocks import Block, tile_map
from rillwork.plans.stencil import clamped, focal, window3, window_sums


def slopes(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, z, s0..s7): drop over distance to each neighbour."""
    w = window3(cells)
    return w.select("r", "c", "z", *(((F.col("z") - F.col(f"n{k}")) / F.lit(grid.step(k))).alias(f"s{k}") for k in range(8)))


def slope(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, slope): the steepest drop; negative in pits."""
    return slopes(cells, grid).select("r", "c", F.greatest(*(f"s{k}" for k in range(8))).alias("slope"))


def local_minima(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c): interior cells strictly below all valid neighbours, of which there is at least one."""
    low = F.least(*(f"n{k}" for k in range(8)))
    return window3(cells).where((F.col("z") < low) & F.col("r").between(1, grid.rows - 2) & F.col("c").between(1, grid.cols - 2)).select("r", "c")


def tpi(cells: DataFrame, grid: GridMeta, window: int = 3) -> DataFrame:
    return focal(cells, grid, window).select("r", "c", (F.col("z") - F.col("m")).alias("tpi"))


def deviation_from_mean(cells: DataFrame, grid: GridMeta, window: int = 3) -> DataFrame:
    return focal(cells, grid, window).select("r", "c", ((F.col("z") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))).alias("dev"))


def elev_std(cells: DataFrame, grid: GridMeta, window: int = 3) -> DataFrame:
    return focal(cells, grid, window).select("r", "c", F.col("sd").alias("elev_std"))


def ruggedness(cells: DataFrame, grid: GridMeta, window: int = 3) -> DataFrame:
    """(r, c, ruggedness): mean size of the difference to the window's other cells, wrapped around; no-data is 0."""
    h = window // 2
    if h == 0:
        return cells.select("r", "c", F.lit(None).cast("double").alias("ruggedness"))
    near = lambda x, size: F.filter(F.array(F.col(x), F.col(x) - size, F.col(x) + size), lambda p: p.between(-h, size - 1 + h))
    # the grid's far sides once more beyond its edges: a tile's ring then holds what is wrapped around
    wrapped = cells.select(F.explode(near("r", grid.rows)).alias("r"), "c", F.coalesce("z", F.lit(0.0)).alias("z")).select("r", F.explode(near("c", grid.cols)).alias("c"), "z")

    def kernel(block: Block) -> dict:
        z, total, n = block.arrays["z"], 0.0, 0
        own = block.own(z)
        for dr in range(-h, h + 1):
            for dc in range(-h, h + 1):
                if dr or dc:
                    size = np.abs(own - block.shifted(z, dr, dc))
                    seen = ~np.isnan(size)
                    total, n = total + np.where(seen, size, 0.0), n + seen
        r, c = np.ogrid[: block.tile, : block.tile]
        inside = block.own(block.have) & (r + block.r0 < grid.rows) & (c + block.c0 < grid.cols)
        return block.rows(inside, ruggedness=np.where(n > 0, total / np.maximum(n, 1), np.nan))

    return tile_map(wrapped, grid, kernel, "r int, c int, ruggedness double", halo=h)


def _gradient(cells: DataFrame, grid: GridMeta, method: str = "horn", scale: float = 1.0) -> DataFrame:
    """The gradient with replicated edges: gx to the east, gy to the south, per unit of length times ``scale``.

    Horn's weights all eight neighbours, Zevenbergen and Thorne's takes the four beside the cell.
    """
    if method not in ("horn", "zevenbergen_thorne"):
        raise ValueError("method is horn or zevenbergen_thorne")
    n, dx, dy = {k: clamped(grid, k) for k in range(8)}, abs(grid.dx) * scale, abs(grid.dy) * scale
    if method == "horn":
        gx = ((n[5] + 2 * n[6] + n[7]) - (n[3] + 2 * n[2] + n[1])) / (8 * dx)
        gy = ((n[1] + 2 * n[0] + n[7]) - (n[3] + 2 * n[4] + n[5])) / (8 * dy)
    else:
        gx, gy = (n[6] - n[2]) / (2 * dx), (n[0] - n[4]) / (2 * dy)
    return window3(cells).select("r", "c", "z", gx.alias("gx"), gy.alias("gy"))


def horn_slope(cells: DataFrame, grid: GridMeta, percent: bool = False, method: str = "horn", scale: float = 1.0) -> DataFrame:
    """(r, c, slope): degrees or percent of the steepest rise."""
    rise = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    return _gradient(cells, grid, method, scale).select("r", "c", (rise * 100 if percent else F.degrees(F.atan(rise))).alias("slope"))


def aspect(cells: DataFrame, grid: GridMeta, method: str = "horn", zero_flat: bool = False) -> DataFrame:
    """Degrees clockwise from north that the slope faces; flat cells null, or 0 with ``zero_flat``."""
    faced = F.degrees(F.atan2(-F.col("gx"), F.col("gy")))
    flat = F.lit(0.0 if zero_flat else None).cast("double")
    return _gradient(cells, grid, method).select("r", "c", F.when((F.col("gx") != 0) | (F.col("gy") != 0), F.pmod(faced, F.lit(360.0))).otherwise(flat).alias("aspect"))


def _shade(azimuth: float, altitude: float, exaggeration: float = 1.0, scale: float = 1.0) -> Column:
    """1 + 254 cos(incidence), at least 0, of a row with gx and gy."""
    a, h = math.radians(azimuth), math.radians(altitude)
    east, north, up = math.sin(a) * math.cos(h), math.cos(a) * math.cos(h), math.sin(h)
    gx, gy = F.col("gx") * (exaggeration / scale), F.col("gy") * (exaggeration / scale)
    return F.greatest(F.lit(0.0), 1 + 254 * (-gx * east + gy * north + up) / F.sqrt(1 + gx * gx + gy * gy))


def _combined(azimuth: float, altitude: float, exaggeration: float, scale: float) -> Column:
    """1 less the angle of incidence times the slope, both as shares of a right angle; scaled to 1..255."""
    a, h, f = math.radians(azimuth), math.radians(altitude), exaggeration / scale
    gx, gy = F.col("gx") * f, F.col("gy") * f
    cosine = (-gx * (math.sin(a) * math.cos(h)) + gy * (math.cos(a) * math.cos(h)) + math.sin(h)) / F.sqrt(1 + gx * gx + gy * gy)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    return 1 + 254 * F.greatest(F.lit(0.0), 1 - angle * F.atan(F.sqrt(gx * gx + gy * gy)) / (math.pi / 2) ** 2)


def _multidirectional(altitude: float, exaggeration: float, scale: float) -> Column:
    """Lights from 225, 270, 315 and 360 degrees, each weighted by the squared sine of its angle to the aspect; flat cells see the altitude alone."""
    h, f = math.radians(altitude), exaggeration / scale
    gx, gy = F.col("gx") * f, F.col("gy") * f
    steep, total = gx * gx + gy * gy, F.lit(0.0)
    for azimuth in (225.0, 270.0, 315.0, 360.0):
        a = math.radians(azimuth)
        # the downhill side faces (-gx, gy) to the east and north
        across = -gx * math.cos(a) - gy * math.sin(a)
        light = F.greatest(F.lit(0.0), -gx * (math.sin(a) * math.cos(h)) + gy * (math.cos(a) * math.cos(h)) + math.sin(h))
        total = total + across * across * light
    return 1 + 254 * F.when(steep > 0, total / (2 * F.when(steep > 0, steep)) / F.sqrt(1 + steep)).otherwise(math.sin(h))


def _igor(azimuth: float, exaggeration: float, scale: float) -> Column:
    """255 less what slopes that face away from the light lose, by their steepness."""
    f = exaggeration / scale
    gx, gy = F.col("gx") * f, F.col("gy") * f
    turn = F.pmod(F.atan2(-gx, gy) - math.radians(azimuth + 180), F.lit(2 * math.pi))
    apart = F.least(turn, 2 * math.pi - turn)
    return 255 * (1 - F.atan(F.sqrt(gx * gx + gy * gy)) / (math.pi / 2) * (1 - apart / math.pi))


def hillshade(cells: DataFrame, grid: GridMeta, azimuth: float = 315.0, altitude: float = 45.0, exaggeration: float = 1.0, scale: float = 1.0, kind: str = "regular") -> DataFrame:
    """(r, c, shade): 1 + 254 cos(incidence), at least 0; or one of the kinds combined, multidirectional (which has no azimuth) and igor (no altitude)."""
    kinds = {
        "regular": lambda: _shade(azimuth, altitude, exaggeration, scale), "combined": lambda: _combined(azimuth, altitude, exaggeration, scale),
        "multidirectional": lambda: _multidirectional(altitude, exaggeration, scale), "igor": lambda: _igor(azimuth, exaggeration, scale),
    }
    if kind not in kinds:
        raise ValueError(f"kind is one of {[*kinds]}")
    return _gradient(cells, grid).select("r", "c", kinds[kind]().alias("shade"))


def hillshade_of_lights(cells: DataFrame, grid: GridMeta, lights: list[tuple[float, ...]], weights: list[float] | None = None) -> DataFrame:
    """(r, c, shade): the weighted mean of the shades of lights (azimuth, altitude, exaggeration = 1, scale = 1), in whole bytes.

    Each light's shade is rounded to a byte first; the mean's fraction goes. All lights see one gather of neighbours.
    """
    weights = weights or [1.0] * len(lights)
    if not lights or len(weights) != len(lights) or sum(weights) == 0:
        raise ValueError("each light takes one weight, and their sum is not 0")
    mean = sum((F.floor(_shade(*light) + 0.5) * (w / sum(weights)) for light, w in zip(lights, weights, strict=True)), F.lit(0.0))
    # shares such as thirds add up to a little less than one: a mean that is whole stays so
    return _gradient(cells, grid).select("r", "c", F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mean + 1e-9))).cast("int").alias("shade"))


def curvature_terms(cells: DataFrame, grid: GridMeta) -> DataFrame:
    """(r, c, d, e, f, g, h): second-order surface terms with replicated edges, no-data neighbours 0."""
    n, cs, z = {k: clamped(grid, k) for k in range(8)}, abs(grid.dx), F.col("z")
    return window3(cells).select(
        "r", "c", (((n[2] + n[6]) / 2 - z) / cs**2).alias("d"), (((n[4] + n[0]) / 2 - z) / cs**2).alias("e"),
        ((n[5] + n[1] - n[3] - n[7]) / (4 * cs**2)).alias("f"), ((n[6] - n[2]) / (2 * cs)).alias("g"), ((n[4] - n[0]) / (2 * cs)).alias("h"),
    )


def index_columns(acc: Column, slope_rad: Column, cell: float) -> dict[str, Column]:
    """Wetness, power and transport indices from accumulation and slope; null where not finite."""
    s, sca = F.greatest(slope_rad, F.lit(1e-3)), F.when(acc > 0, acc * abs(cell))
    return {"twi": F.log(sca / F.tan(s)), "spi": acc * abs(cell) * F.tan(s), "sti": F.pow(acc * abs(cell) / 22.13, F.lit(0.6)) * F.pow(F.sin(s) / 0.0896, F.lit(1.3))}


def curvature(cells: DataFrame, grid: GridMeta, kind: str = "total") -> DataFrame:
    """(r, c, curvature): plan, profile, total, mean or gaussian, from the second-order surface."""
    d, e, f, g, h = (F.col(x) for x in "defgh")
    steep = g * g + h * h + 1e-12
    kinds = {
        "plan": -2 * (d * h * h + e * g * g - f * g * h) / steep, "profile": 2 * (d * g * g + e * h * h + f * g * h) / steep,
        "total": 2 * (d + e), "mean": d + e, "gaussian": 4 * d * e - f * f,
    }
    if kind not in kinds:
        raise ValueError(f"kind is one of {[*kinds]}")
    return curvature_terms(cells, grid).select("r", "c", kinds[kind].alias("curvature"))


def normal_vector_deviation(cells: DataFrame, grid: GridMeta, window: int = 3) -> DataFrame:
    """(r, c, angle): radians between a cell's normal and the mean normal of its window."""
    gx = (clamped(grid, 6) - clamped(grid, 2)) / (2 * abs(grid.dx))
    gy = (clamped(grid, 0) - clamped(grid, 4)) / (2 * abs(grid.dx))
    size = F.sqrt(1 + F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    unit = window3(cells).select("r", "c", gx.alias("gx"), gy.alias("gy")).select("r", "c", (-F.col("gx") / size).alias("nx"), (-F.col("gy") / size).alias("ny"), (1 / size).alias("nz"))
    around = window_sums(unit, grid, window, ["nx", "ny", "nz"]).select("r", "c", *(F.col(x).alias(f"m{x}") for x in ("nx", "ny", "nz")))
    dot = sum((F.col(x) * F.col(f"m{x}") for x in ("ny", "nz")), F.col("nx") * F.col("mnx"))
    length = F.sqrt(sum((F.col(f"m{x}") * F.col(f"m{x}") for x in ("ny", "nz")), F.col("mnx") * F.col("mnx")))
    return unit.join(around, ["r", "c"]).select("r", "c", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (length + 1e-12)))).alias("angle"))


def horizons(cells: DataFrame, grid: GridMeta, radius: int) -> DataFrame:
    """(r, c, h0..h7): the highest angle above level up to ``radius`` cells away in each direction; no-data is 0."""

    def kernel(block: Block) -> dict:
        z = np.where(block.have, np.nan_to_num(block.arrays["z"]), np.nan)
        own = block.own(z)
        out = {}
        for k, (dr, dc) in enumerate(zip(DR, DC, strict=True)):
            high = np.zeros_like(own)
            for s in range(1, radius + 1):
                high = np.fmax(high, np.arctan2(block.shifted(z, dr * s, dc * s) - own, grid.step(k) * s))
            out[f"h{k}"] = high
        return block.rows(block.own(block.have), **out)

    return tile_map(cells, grid, kernel, "r int, c int, " + ", ".join(f"h{k} double" for k in range(8)), halo=radius)


def openness(cells: DataFrame, grid: GridMeta, radius: int = 10, kind: str = "positive") -> DataFrame:
    """(r, c, openness): mean over eight directions of the angle between the zenith and the horizon."""
    if kind not in ("positive", "negative"):
        raise ValueError("kind is positive or negative")
    facing = cells if kind == "positive" else cells.withColumn("z", -F.col("z"))
    return horizons(facing, grid, radius).select("r", "c", (math.pi / 2 - sum((F.col(f"h{k}") for k in range(1, 8)), F.col("h0")) / 8).alias("openness"))


def sky_view_factor(cells: DataFrame, grid: GridMeta, radius: int = 10) -> DataFrame:
    return horizons(cells, grid, radius).select("r", "c", (1 - sum((F.sin(f"h{k}") for k in range(1, 8)), F.sin("h0")) / 8).alias("svf"))


def color_relief(cells: DataFrame, palette: list[tuple[float, ...]]) -> DataFrame:
    """(r, c, red, green, blue), and alpha where stops have it: colours between the palette's stops, which are few, by linear interpolation; beyond them the end stops'."""
    stops = sorted(palette)
    bands = len(stops[0]) - 1
    if bands not in (3, 4) or any(len(s) != bands + 1 for s in stops):
        raise ValueError("all stops are (value, red, green, blue) or all (value, red, green, blue, alpha)")
    out = []
    for i, name in enumerate(("red", "green", "blue", "alpha")[:bands], 1):
        v = F.lit(float(stops[-1][i]))
        for a, b in reversed([*zip(stops, stops[1:], strict=False)]):
            v = F.when(F.col("z") < b[0], a[i] + (F.col("z") - a[0]) / (b[0] - a[0]) * (b[i] - a[i])).otherwise(v)
        v = F.when(F.col("z") <= stops[0][0], float(stops[0][i])).otherwise(v)
        out.append(F.when(F.col("z").isNotNull(), F.floor(v + 0.5)).alias(name))
    return cells.select("r", "c", *out)
