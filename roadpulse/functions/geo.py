"""Distances and polyline functions on WGS84 coordinates.

Three metrics are offered. ``planar`` projects onto the tangent plane with the
ellipsoid's radii at the middle latitude: it stays in generated code and is
exact to millimetres at matching distances. ``haversine`` is the sphere.
``wgs84`` is the inverse geodesic, vectorised over Arrow batches.

A polyline is ``array<struct<lon double, lat double>>``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
ECC2 = FLATTENING * (2 - FLATTENING)
MEAN_RADIUS = 6371008.8
SNAP = 1e-10


def metres_per_degree(lat: Column) -> tuple[Column, Column]:
    """Metres per degree of longitude and of latitude at ``lat``."""
    w = 1 - F.lit(ECC2) * F.pow(F.sin(F.radians(lat)), F.lit(2.0))
    unit = math.pi / 180 * AXIS
    kx = F.lit(unit) * F.cos(F.radians(lat)) / F.sqrt(w)
    ky = F.lit(unit * (1 - ECC2)) / (w * F.sqrt(w))
    return kx, ky


def planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    kx, ky = metres_per_degree((lat1 + lat2) / 2)
    return F.hypot((lon2 - lon1) * kx, (lat2 - lat1) * ky)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return 2 * MEAN_RADIUS * F.asin(F.sqrt(a))


def inverse_geodesic(lon1, lat1, lon2, lat2) -> np.ndarray:
    """Vincenty's inverse formula on arrays of degrees, in metres."""
    lon1, lat1, lon2, lat2 = (np.asarray(v, dtype=float) for v in (lon1, lat1, lon2, lat2))
    axis_b = AXIS * (1 - FLATTENING)
    u1 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat1)))
    u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat2)))
    diff = np.radians(lon2 - lon1)
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    lam = diff.copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(200):
            sin_s = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
            cos_s = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, cu1 * cu2 * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a == 0, 0.0, cos_s - 2 * su1 * su2 / cos2_a)
            c = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            step = diff + (1 - c) * FLATTENING * sin_a * (
                sigma + c * sin_s * (cos_m + c * cos_s * (2 * cos_m**2 - 1))
            )
            moved = np.nanmax(np.abs(step - lam), initial=0.0)
            lam = step
            if moved < 1e-13:
                break
        k = cos2_a * (AXIS**2 - axis_b**2) / axis_b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        delta = big_b * sin_s * (
            cos_m
            + big_b / 4 * (
                cos_s * (2 * cos_m**2 - 1)
                - big_b / 6 * cos_m * (4 * sin_s**2 - 3) * (4 * cos_m**2 - 3)
            )
        )
    return axis_b * big_a * (sigma - delta)


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Exact distance on the ellipsoid; the function for tasks is made per call, so no module holds a Spark object."""

    @F.pandas_udf(T.DoubleType())
    def exact(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
        return pd.Series(inverse_geodesic(lon1, lat1, lon2, lat2))

    return exact(lon1, lat1, lon2, lat2)


METRICS = {"planar": planar, "haversine": haversine, "wgs84": geodesic}


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metric: str = "planar") -> Column:
    return METRICS[metric](lon1, lat1, lon2, lat2)


def project_on_segment(lon, lat, lon1, lat1, lon2, lat2) -> Column:
    """Signed fraction along the segment of the point closest to (lon, lat)."""
    kx, ky = metres_per_degree(lat)
    dx, dy = (lon2 - lon1) * kx, (lat2 - lat1) * ky
    px, py = (lon - lon1) * kx, (lat - lat1) * ky
    norm = dx * dx + dy * dy
    return F.when(norm > 0, (px * dx + py * dy) / norm).otherwise(F.lit(0.0))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def interpolate_segment(lon1, lat1, lon2, lat2, fraction) -> tuple[Column, Column]:
    return lon1 + (lon2 - lon1) * fraction, lat1 + (lat2 - lat1) * fraction


def legs(points: Column) -> Column:
    """Array of (a, b, length) for consecutive vertices."""
    n = F.size(points)
    return F.zip_with(
        F.slice(points, F.lit(1), n - 1),
        F.slice(points, F.lit(2), n - 1),
        lambda a, b: F.struct(
            a.alias("a"), b.alias("b"), planar(a.lon, a.lat, b.lon, b.lat).alias("length")
        ),
    )


def polyline_length(points: Column, metric: str = "planar") -> Column:
    """Length of a polyline. The exact metric needs Python, which takes the whole array at once."""
    if metric == "wgs84":
        return _exact_length(points)
    n = F.size(points)
    lengths = F.zip_with(
        F.slice(points, F.lit(1), n - 1),
        F.slice(points, F.lit(2), n - 1),
        lambda a, b: METRICS[metric](a.lon, a.lat, b.lon, b.lat),
    )
    return F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + x)


def _exact_length(points: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def exact(lines: pd.Series) -> pd.Series:
        """All legs of all lines in one vectorised call."""
        flat = [(i, a["lon"], a["lat"], b["lon"], b["lat"]) for i, line in enumerate(lines) if line is not None
                for a, b in zip(line[:-1], line[1:], strict=True)]
        sums = np.zeros(len(lines))
        if flat:
            rows, *ends = (np.array(c) for c in zip(*flat, strict=True))
            np.add.at(sums, rows.astype(int), inverse_geodesic(*ends))
        return pd.Series([None if line is None else s for line, s in zip(lines, sums, strict=True)], dtype="float64")

    return exact(points)


def along_polyline(points: Column, fraction: Column) -> Column:
    """Point at a fraction of the length; both ends snap within 1e-10."""
    parts = legs(points)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, leg: acc + leg.length)
    first, last = F.element_at(points, 1), F.element_at(points, -1)
    start = F.struct(
        F.lit(0.0).alias("done"), first.lon.alias("lon"), first.lat.alias("lat")
    )
    goal = fraction * total

    def walk(acc, leg):
        part = F.when(leg.length > 0, (goal - acc.done) / leg.length).otherwise(F.lit(0.0))
        inside = (acc.done <= goal) & (goal <= acc.done + leg.length)
        x, y = interpolate_segment(leg.a.lon, leg.a.lat, leg.b.lon, leg.b.lat, part)
        return F.struct(
            (acc.done + leg.length).alias("done"),
            F.when(inside, x).otherwise(acc.lon).alias("lon"),
            F.when(inside, y).otherwise(acc.lat).alias("lat"),
        )

    walked = F.aggregate(parts, start, walk, lambda acc: F.struct(acc.lon.alias("lon"), acc.lat.alias("lat")))
    return (
        F.when(fraction < SNAP, F.struct(first.lon.alias("lon"), first.lat.alias("lat")))
        .when(fraction > 1 - SNAP, F.struct(last.lon.alias("lon"), last.lat.alias("lat")))
        .otherwise(walked)
    )


def clip_polyline(points: Column, start: Column, stop: Column) -> Column:
    """Part of a polyline between two fractions, end points included."""
    parts = legs(points)
    cumulative = F.aggregate(
        parts,
        F.array(F.lit(0.0)),
        lambda acc, leg: F.concat(acc, F.array(F.element_at(acc, -1) + leg.length)),
    )
    marked = F.arrays_zip(points.alias("p"), cumulative.alias("d"))
    total = F.element_at(cumulative, -1)
    inner = F.filter(marked, lambda m: (m.d > start * total) & (m.d < stop * total))
    return F.concat(
        F.array(along_polyline(points, start)),
        F.transform(inner, lambda m: m.p),
        F.array(along_polyline(points, stop)),
    )


def envelope(lon: Column, lat: Column, radius: Column) -> Column:
    """Degree box around a point, on the sphere."""
    dlat = F.degrees(radius / MEAN_RADIUS)
    dlon = dlat / F.cos(F.radians(lat))
    return F.struct(
        (lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"),
        (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"),
    )


def reverse_polyline(points: Column) -> Column:
    return F.reverse(points)


def wkt_point(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("POINT ("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def wkt_line(points: Column) -> Column:
    pairs = F.transform(points, lambda p: F.concat_ws(" ", p.lon.cast("string"), p.lat.cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(pairs, ", "), F.lit(")"))
