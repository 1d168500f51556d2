"""Planar and geodetic geometry as native Column expressions (no UDF)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0

# WGS-84 and the transverse Mercator series of Krueger in the third flattening n.
_A = 6378137.0
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_K0 = 0.9996
_FALSE_EASTING = 500000.0
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)


def _poly(coefficients: dict[int, float]) -> float:
    return sum(c * _N**power for power, c in coefficients.items())


# published series coefficients (forward alpha, inverse beta, latitude delta)
_ALPHA = [
    _poly({1: 1 / 2, 2: -2 / 3, 3: 5 / 16, 4: 41 / 180, 5: -127 / 288, 6: 7891 / 37800}),
    _poly({2: 13 / 48, 3: -3 / 5, 4: 557 / 1440, 5: 281 / 630, 6: -1983433 / 1935360}),
    _poly({3: 61 / 240, 4: -103 / 140, 5: 15061 / 26880, 6: 167603 / 181440}),
    _poly({4: 49561 / 161280, 5: -179 / 168, 6: 6601661 / 7257600}),
    _poly({5: 34729 / 80640, 6: -3418889 / 1995840}),
    _poly({6: 212378941 / 319334400}),
]
_BETA = [
    _poly({1: 1 / 2, 2: -2 / 3, 3: 37 / 96, 4: -1 / 360, 5: -81 / 512, 6: 96199 / 604800}),
    _poly({2: 1 / 48, 3: 1 / 15, 4: -437 / 1440, 5: 46 / 105, 6: -1118711 / 3870720}),
    _poly({3: 17 / 480, 4: -37 / 840, 5: -209 / 4480, 6: 5569 / 90720}),
    _poly({4: 4397 / 161280, 5: -11 / 504, 6: -830251 / 7257600}),
    _poly({5: 4583 / 161280, 6: -108847 / 3991680}),
    _poly({6: 20648693 / 638668800}),
]
_DELTA = [
    _poly({1: 2, 2: -2 / 3, 3: -2, 4: 116 / 45, 5: 26 / 45, 6: -2854 / 675}),
    _poly({2: 7 / 3, 3: -8 / 5, 4: -227 / 45, 5: 2704 / 315, 6: 2323 / 945}),
    _poly({3: 56 / 15, 4: -136 / 35, 5: -1262 / 105, 6: 73814 / 2835}),
    _poly({4: 4279 / 630, 5: -332 / 35, 6: -399572 / 14175}),
    _poly({5: 4174 / 315, 6: -144838 / 6237}),
    _poly({6: 601676 / 22275}),
]


def utm_from_lonlat(longitude: Column, latitude: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing (northern hemisphere) in the given UTM zone."""
    lam = F.radians(longitude - float(zone * 6 - 183))
    sphi = F.sin(F.radians(latitude))
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(sphi) - e * F.atanh(e * sphi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return _FALSE_EASTING + _K0 * _RECTIFYING * x, _K0 * _RECTIFYING * y


def lonlat_from_utm(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a northern UTM position."""
    xi = northing / (_K0 * _RECTIFYING)
    eta = (easting - _FALSE_EASTING) / (_K0 * _RECTIFYING)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + d * F.sin(2 * j * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lam) + float(zone * 6 - 183), F.degrees(phi)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dphi = F.radians(lat2 - lat1)
    dlam = F.radians(lon2 - lon1)
    h = F.pow(F.sin(dphi / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlam / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def local_plane(latitude: Column, longitude: Column, mean_latitude: Column) -> tuple[Column, Column]:
    """Equirectangular metres around a mean latitude."""
    return (
        EARTH_RADIUS_M * F.radians(longitude) * F.cos(F.radians(mean_latitude)),
        EARTH_RADIUS_M * F.radians(latitude),
    )


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance from a point to a segment, the foot clamped to its ends."""
    ux, uy = x2 - x1, y2 - y1
    norm = ux * ux + uy * uy
    raw = ((px - x1) * ux + (py - y1) * uy) / F.when(norm > 0, norm)
    t = F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return distance(px, py, x1 + t * ux, y1 + t * uy)


def _ring_edges(ring: Column) -> Column:
    """Ring -> array of (p, q) consecutive vertices, closed."""
    closing = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, closing, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def _cross(e: Column) -> Column:
    return e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]


def _localised(ring: Column) -> Column:
    """Shift a ring to its first vertex: shoelace sums keep their digits."""
    x0, y0 = ring[0]["x"], ring[0]["y"]
    return F.transform(ring, lambda v: F.struct((v["x"] - x0).alias("x"), (v["y"] - y0).alias("y")))


def ring_area(ring: Column) -> Column:
    edges = _ring_edges(_localised(ring))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + _cross(e))) / 2.0


def ring_centroid(ring: Column) -> tuple[Column, Column]:
    edges = _ring_edges(_localised(ring))
    twice = F.aggregate(edges, F.lit(0.0), lambda s, e: s + _cross(e))
    cx = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["p"]["x"] + e["q"]["x"]) * _cross(e))
    cy = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["p"]["y"] + e["q"]["y"]) * _cross(e))
    return ring[0]["x"] + cx / (3.0 * twice), ring[0]["y"] + cy / (3.0 * twice)


def ring_contains(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd ray casting; lower and left borders belong to the ring."""
    def flips(inside: Column, e: Column) -> Column:
        p, q = e["p"], e["q"]
        spans = (p["y"] > py) != (q["y"] > py)
        at = p["x"] + (py - p["y"]) * (q["x"] - p["x"]) / F.when(q["y"] != p["y"], q["y"] - p["y"])
        return F.when(spans & (px < at), ~inside).otherwise(inside)

    return F.aggregate(_ring_edges(ring), F.lit(False), flips)


def polyline_length(line: Column) -> Column:
    rest = F.slice(line, 2, F.size(line))
    head = F.slice(line, 1, F.size(line) - 1)
    steps = F.zip_with(head, rest, lambda p, q: distance(p["x"], p["y"], q["x"], q["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def block_id(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))
