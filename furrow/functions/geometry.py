"""Planar geometry as column expressions.

A polygon layer holds multipolygons: ARRAY<polygon>, a polygon ARRAY<ring> (the shell, then holes), a ring
ARRAY<STRUCT<x, y>> whose last vertex repeats the first. Builders take and give SQL text, so expressions
nest and stay in the JVM; what SQL cannot say (clipping) is an Arrow function over NumPy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERTEX = "struct<x:double,y:double>"
MULTIPOLYGON = f"array<array<array<{VERTEX}>>>"
ALONG = "transform(sequence(0, size({r}) - 2), i -> {body})"


def box(x: str, y: str, length: str, width: str) -> str:
    """A rectangle as a multipolygon."""
    x1, y1 = f"({x} + {length})", f"({y} + {width})"
    corners = ", ".join(f"struct(double({a}) as x, double({b}) as y)" for a, b in ((x, y), (x1, y), (x1, y1), (x, y1), (x, y)))
    return f"array(array(array({corners})))"


def _sum(values: str) -> str:
    return f"aggregate({values}, 0d, (a, v) -> a + v)"


def ring_area(r: str) -> str:
    """Signed: positive counter-clockwise. Coordinates count from the first vertex, which keeps large ones exact."""
    cross = f"(({r}[i].x - {r}[0].x) * ({r}[i + 1].y - {r}[0].y) - ({r}[i + 1].x - {r}[0].x) * ({r}[i].y - {r}[0].y))"
    return f"(if(size({r}) < 4, 0d, {_sum(ALONG.format(r=r, body=cross))}) / 2)"


def area(geometry: str) -> str:
    """Shells less holes."""
    return _sum(f"transform({geometry}, p -> {_sum('transform(p, (g, k) -> if(k = 0, 1, -1) * abs(' + ring_area('g') + '))')})")


def bounds(geometry: str) -> dict[str, str]:
    flat = f"flatten(flatten({geometry}))"
    return {f"{f}{c}": f"array_{f}(transform({flat}, v -> v.{c}))" for f in ("min", "max") for c in ("x", "y")}


def centroid(geometry: str) -> tuple[str, str]:
    """Centroid by area; that of the vertices where there is no area."""
    out = []
    flat = f"flatten(flatten({geometry}))"
    for c in ("x", "y"):
        base = f"{flat}[0].{c}"
        cross = "((g[i].x - g[0].x) * (g[i + 1].y - g[0].y) - (g[i + 1].x - g[0].x) * (g[i].y - g[0].y))"
        moment = _sum(ALONG.format(r="g", body=f"(g[0].{c} + g[i].{c} + g[i + 1].{c} - 3 * {base}) * {cross}"))
        part = f"if(size(g) < 4, 0d, if(k = 0, 1, -1) * sign({ring_area('g')}) * {moment} / 6)"
        whole = _sum(f"transform({geometry}, p -> {_sum('transform(p, (g, k) -> ' + part + ')')})")
        mean = f"{_sum(f'transform({flat}, v -> v.{c})')} / size({flat})"
        out.append(f"(if({area(geometry)} = 0, {mean}, {base} + {whole} / {area(geometry)}))")
    return out[0], out[1]


def segment_distance2(x: str, y: str, a: str, b: str) -> str:
    """Squared distance from a point to the segment between vertices a and b."""
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    at = f"if({dx} = 0 and {dy} = 0, 0d, greatest(0d, least(1d, (({x} - {a}.x) * {dx} + ({y} - {a}.y) * {dy}) / ({dx} * {dx} + {dy} * {dy}))))"
    return f"(pow({x} - {a}.x - {at} * {dx}, 2) + pow({y} - {a}.y - {at} * {dy}, 2))"


def boundary_distance(x: str, y: str, geometry: str) -> str:
    parts = f"transform(flatten({geometry}), r -> array_min({ALONG.format(r='r', body=segment_distance2(x, y, 'r[i]', 'r[i + 1]'))}))"
    return f"sqrt(array_min({parts}))"


def covers(x: str, y: str, geometry: str) -> str:
    """Whether the point lies in the polygon or on its edge (even-odd rule)."""
    edge = f"exists(flatten({geometry}), r -> exists(sequence(0, size(r) - 2), i -> {segment_distance2(x, y, 'r[i]', 'r[i + 1]')} = 0))"
    crossing = f"int((r[i].y > {y}) <> (r[i + 1].y > {y}) and {x} < (r[i + 1].x - r[i].x) * ({y} - r[i].y) / (r[i + 1].y - r[i].y) + r[i].x)"
    # a horizontal edge never crosses, and its division must not be asked
    crossing = f"if(r[i].y = r[i + 1].y, 0, {crossing})"
    odd = f"aggregate(flatten({geometry}), 0, (n, r) -> n + aggregate(sequence(0, size(r) - 2), 0, (m, i) -> m + {crossing})) % 2 = 1"
    return f"(({odd}) or {edge})"


def distance(x: str, y: str, geometry: str) -> str:
    return f"if({covers(x, y, geometry)}, 0d, {boundary_distance(x, y, geometry)})"


def rotate(x: str, y: str, degrees: float, px: float, py: float) -> tuple[str, str]:
    """Counter-clockwise around (px, py)."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return f"({px!r}d + ({x} - {px!r}d) * {c!r}d - ({y} - {py!r}d) * {s!r}d)", f"({py!r}d + ({x} - {px!r}d) * {s!r}d + ({y} - {py!r}d) * {c!r}d)"


def total_bounds(points: DataFrame) -> tuple[float, float, float, float]:
    """minx, miny, maxx, maxy of a point layer: one aggregate, one row."""
    return tuple(points.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())


def clip_convex(ring: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex counter-clockwise polygon; what only touches it stays as a flat ring."""
    out = ring
    for a, b in zip(corners, np.roll(corners, -1, 0), strict=True):
        if not len(out):
            return out
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, other = np.roll(out, -1, 0), np.roll(side, -1)
        kept = []
        for p, q, s, t in zip(out, nxt, side, other, strict=True):
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def flat_area(ring: np.ndarray) -> float:
    if len(ring) < 3:
        return 0.0
    x, y = (ring - ring[0]).T
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


@F.pandas_udf(T.StructType([T.StructField("touches", T.BooleanType()), T.StructField("area", T.DoubleType())]))
def overlap(geometry: pd.Series, cell: pd.Series) -> pd.DataFrame:
    """Of a multipolygon and a convex cell (four corners, counter-clockwise): whether they meet, and their common area."""
    rows = []
    for parts, corners in zip(geometry, cell, strict=True):
        c = np.array([(v["x"], v["y"]) for v in corners], float)
        touches, total = False, 0.0
        for rings in parts if parts is not None else []:
            cut_rings = [clip_convex(np.array([(v["x"], v["y"]) for v in r[:-1]], float), c) for r in rings]
            if len(cut_rings) and len(cut_rings[0]):
                own = flat_area(cut_rings[0]) - sum(flat_area(h) for h in cut_rings[1:])
                shell = flat_area(cut_rings[0])
                # a cell that lies in a hole meets nothing
                touches |= own > 1e-12 * max(shell, 1.0) or shell == 0.0
                total += max(own, 0.0)
        rows.append((touches, total))
    return pd.DataFrame(rows, columns=["touches", "area"])


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by monotone chains."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for q in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_area(points: DataFrame) -> DataFrame:
    """One row (hull_area): each batch leaves its own hull, the hull of these is the whole one's."""

    def partial(frames):
        for f in frames:
            h = hull(f[["x", "y"]].dropna().to_numpy())
            yield pd.DataFrame({"x": h[:, 0], "y": h[:, 1]} if len(h) else {"x": [], "y": []}, dtype=float)

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"hull_area": [flat_area(hull(f[["x", "y"]].to_numpy()))]})

    corners = points.select("x", "y").mapInPandas(partial, "x double, y double")
    return corners.groupBy(F.lit(0).alias("k")).applyInPandas(whole, "hull_area double")


def north_east(aspect: Column) -> tuple[Column, Column]:
    """A direction in degrees as its northern and eastern parts."""
    return F.cos(F.radians(aspect)), F.sin(F.radians(aspect))


# WGS 84 and its transverse Mercator zones (fixed values of the standard)
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0


def utm_series() -> tuple[float, list[float], list[float], list[float]]:
    """Rectifying radius, and the coefficients of the series in the third flattening for both ways and for latitude."""
    n = FLATTENING / (2 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    latitude = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return radius, forward, back, latitude


def lonlat_to_utm(lon: Column, lat: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Degrees to metres in a zone, to under a millimetre within it."""
    radius, forward, _, _ = utm_series()
    n = FLATTENING / (2 - FLATTENING)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    atanh = lambda v: 0.5 * F.log((1 + v) / (1 - v))
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(FALSE_EAST) + SCALE * radius * east, F.lit(FALSE_NORTH if south else 0.0) + SCALE * radius * north


def utm_to_lonlat(x: Column, y: Column, zone: int, south: bool) -> tuple[Column, Column]:
    radius, _, back, latitude = utm_series()
    xi, eta = (y - F.lit(FALSE_NORTH if south else 0.0)) / (SCALE * radius), (x - F.lit(FALSE_EAST)) / (SCALE * radius)
    xi1, eta1 = xi, eta
    for j, b in enumerate(back, 1):
        xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(latitude, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(6.0 * zone - 183.0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(phi)
