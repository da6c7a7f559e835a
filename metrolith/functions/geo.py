"""Geometry and map projection as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_008.8
# The GRS80 ellipsoid and the UTM scale.
A, INV_F, K0 = 6_378_137.0, 298.257222101, 0.9996


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = EARTH_M) -> Column:
    """Great circle distance in metres."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return (F.degrees(F.atan2(dx, dy)) + 360) % 360


def bearing_diff(a: Column, b: Column) -> Column:
    """The angle between two bearings whatever the direction of travel: 0 to 90."""
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


def turn(a: Column, b: Column) -> Column:
    """The angle between two headings: 0 to 180."""
    d = F.abs(a - b) % 360
    return F.least(d, 360 - d)


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of (x, y), closed or not), by the even-odd rule."""
    n = F.size(ring)
    crossings = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (
        (F.get(ring, i)["y"] > y) != (F.get(ring, (i + 1) % n)["y"] > y))
        & (x < (F.get(ring, (i + 1) % n)["x"] - F.get(ring, i)["x"]) * (y - F.get(ring, i)["y"]) / F.nullif(F.get(ring, (i + 1) % n)["y"] - F.get(ring, i)["y"], F.lit(0.0)) + F.get(ring, i)["x"]))
    return F.size(crossings) % 2 == 1


def ring_area(ring: Column) -> Column:
    """The area of a ring by the shoelace rule."""
    n = F.size(ring)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)) / 2


def line_length(points: Column) -> Column:
    """The length of a line (array of (x, y))."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.hypot(F.get(points, i)["x"] - F.get(points, i - 1)["x"], F.get(points, i)["y"] - F.get(points, i - 1)["y"]))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda a, t: a + t))


def lens_area(r1: Column, r2: Column, d: Column) -> Column:
    """The area that two circles share."""
    small = F.least(r1, r2)
    a = (d * d + r1 * r1 - r2 * r2) / (2 * d * r1)
    b = (d * d + r2 * r2 - r1 * r1) / (2 * d * r2)
    k = (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)
    lens = r1 * r1 * F.acos(a) + r2 * r2 * F.acos(b) - F.sqrt(F.greatest(k, F.lit(0.0))) / 2
    return F.when(d >= r1 + r2, 0.0).when(d <= F.abs(r1 - r2), math.pi * small * small).otherwise(lens)


def _kruger() -> tuple[float, list[float], list[float], list[float], float]:
    """The rectifying radius and the series coefficients to the third order of the flattening."""
    f = 1 / INV_F
    n = f / (2 - f)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3, 13 / 48 * n**2 - 3 / 5 * n**3, 61 / 240 * n**3]
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3, n**2 / 48 + n**3 / 15, 17 / 480 * n**3]
    delta = [2 * n - 2 / 3 * n**2 - 2 * n**3, 7 / 3 * n**2 - 8 / 5 * n**3, 56 / 15 * n**3]
    return radius, alpha, beta, delta, 2 * math.sqrt(n) / (1 + n)


def to_utm(lon: Column, lat: Column, zone: int) -> tuple[Column, Column]:
    """(easting, northing) in metres, north of the equator, by Krueger's series."""
    radius, alpha, _, _, e = _kruger()
    phi, lam = F.radians(lat), F.radians(lon - (6 * zone - 183))
    s = F.sin(phi)
    atanh = lambda z: F.log((1 + z) / (1 - z)) / 2
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(alpha, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500_000 + K0 * radius * east, K0 * radius * north


def from_utm(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    radius, _, beta, delta, _ = _kruger()
    xi0, eta0 = north / (K0 * radius), (east - 500_000) / (K0 * radius)
    xi, eta = xi0, eta0
    for j, b in enumerate(beta, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return 6 * zone - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def tile_x(lon: Column, zoom: int) -> Column:
    n = 2**zoom
    return F.least(F.greatest(F.floor((lon + 180) / 360 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def tile_y(lat: Column, zoom: int) -> Column:
    n = 2**zoom
    r = F.radians(lat)
    return F.least(F.greatest(F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * n), F.lit(0)), F.lit(n - 1)).cast("long")


def ground_resolution(lat: Column, zoom: int, pixels: int = 256) -> Column:
    """Metres for each pixel of a tile."""
    return F.cos(F.radians(lat)) * (2 * math.pi * A / (pixels * 2**zoom))


def hilbert_tile_id(x: Column, y: Column, zoom: int) -> Column:
    """The tile's number along the Hilbert curves of all zooms, those of lower zooms first."""
    d, n = F.lit(0).cast("long"), 1 << zoom
    s = n // 2
    while s > 0:
        rx, ry = (x.bitwiseAND(F.lit(s)) > 0).cast("long"), (y.bitwiseAND(F.lit(s)) > 0).cast("long")
        d = d + F.lit(s * s).cast("long") * (3 * rx).bitwiseXOR(ry)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x.bitwiseAND(F.lit(s - 1))).otherwise(x.bitwiseAND(F.lit(s - 1))), F.when(flip, s - 1 - y.bitwiseAND(F.lit(s - 1))).otherwise(y.bitwiseAND(F.lit(s - 1)))
        x, y = F.when(ry == 0, fy).otherwise(fx), F.when(ry == 0, fx).otherwise(fy)
        s //= 2
    return d + (4**zoom - 1) // 3


def quantised(v: Column, unit: float) -> Column:
    """The nearest multiple of a unit: off by half a unit at most."""
    return F.round(v / unit) * unit


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once; nested expressions would compute it wherever it stands."""
    return F.transform(F.array(value), use)[0]


def _towards(a: Column, v: Column, t: Column) -> tuple[Column, Column]:
    return a["x"] + t * (v["x"] - a["x"]), a["y"] + t * (v["y"] - a["y"])


def located(line: Column, point: Column) -> Column:
    """Where on a line (vertices x, y) a point's (x, y) nearest position is: struct(distance, along) in the line's unit; the
    first such position on ties. A line of one vertex has along 0, an empty one null."""
    def of(line: Column, p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("run"), F.lit(float("inf")).alias("distance"), F.lit(0.0).alias("along"), line[0]["x"].alias("x"), line[0]["y"].alias("y"))

        def step(a: Column, v: Column) -> Column:
            dx, dy = v["x"] - a["x"], v["y"] - a["y"]
            share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / (dx * dx + dy * dy)))
            found = F.struct(F.sqrt(dx * dx + dy * dy).alias("size"), F.when((dx != 0) | (dy != 0), share).otherwise(0.0).alias("t"))

            def moved(f: Column) -> Column:
                x, y = _towards(a, v, f["t"])
                return let(F.sqrt((x - p["x"]) ** 2 + (y - p["y"]) ** 2), lambda d: F.struct(
                    (a["run"] + f["size"]).alias("run"), F.least(a["distance"], d).alias("distance"), F.when(d < a["distance"], a["run"] + f["t"] * f["size"]).otherwise(a["along"]).alias("along"),
                    v["x"].alias("x"), v["y"].alias("y")))

            return let(found, moved)

        return F.aggregate(line, start, step, lambda a: F.struct(a["distance"], a["along"]))

    return F.when(F.size(line) > 0, let(F.struct(line.alias("line"), point.alias("p")), lambda s: of(s["line"], s["p"])))


def midpoint(line: Column) -> Column:
    """The point (x, y) halfway along a line."""
    def of(line: Column, half: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("run"), line[0]["x"].alias("x"), line[0]["y"].alias("y"), line[0].alias("mid"))

        def step(a: Column, v: Column) -> Column:
            def moved(size: Column) -> Column:
                x, y = _towards(a, v, F.when(size > 0, F.least(F.lit(1.0), (half - a["run"]) / size)).otherwise(0.0))
                mid = F.when(a["run"] <= half, F.struct(x.alias("x"), y.alias("y"))).otherwise(a["mid"])
                return F.struct((a["run"] + size).alias("run"), v["x"].alias("x"), v["y"].alias("y"), mid.alias("mid"))

            return let(F.sqrt((v["x"] - a["x"]) ** 2 + (v["y"] - a["y"]) ** 2), moved)

        return F.aggregate(line, start, step, lambda a: a["mid"])

    return let(F.struct(line.alias("line"), (line_length(line) / 2).alias("half")), lambda s: of(s["line"], s["half"]))


def drawn_same_way(parts: Column, segments: Column) -> Column:
    """Whether a line of several parts runs the way of a segment of several: the segment's first and last vertex are located
    on the part that is nearest to the middle of the segment's first part. Null without vertices."""
    near = let(midpoint(segments[0]), lambda mid: F.array_min(F.transform(parts, lambda p: F.struct(located(p, mid)["distance"].alias("d"), p.alias("p"))))["p"])
    start, end = segments[0][0], F.element_at(F.element_at(segments, -1), -1)
    return let(near, lambda line: located(line, start)["along"] <= located(line, end)["along"])
