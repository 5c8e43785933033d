"""Spherical and planar geometry as column expressions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import COMPASS, EARTH_KM, KM_PER_DEGREE, METRES_PER_DEGREE


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cosines: tuple[Column, Column] | None = None) -> Column:
    """Great-circle distance. cosines: those of both latitudes, where they are known already."""
    dlat, dlon = F.radians(lat2) - F.radians(lat1), F.radians(lon2) - F.radians(lon1)
    first, second = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    a = F.pow(F.sin(dlat / 2), 2) + first * second * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def unit_vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def chord_km(chord: Column) -> Column:
    """Great-circle distance of a chord on the unit sphere."""
    return 2 * F.asin(F.least(chord / 2, F.lit(1.0))) * EARTH_KM


def offset_degrees(lat: Column, dx_m: Column, dy_m: Column) -> tuple[Column, Column]:
    """Degrees of latitude and longitude that metres east and north come to at a latitude."""
    return dy_m / METRES_PER_DEGREE, dx_m / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def compass(angle: Column, names: tuple[str, ...] = COMPASS) -> Column:
    return F.get(F.array(*map(F.lit, names)), F.pmod(F.floor((angle + 180.0 / len(names)) / (360.0 / len(names))), F.lit(len(names))).cast("int"))


def bearing_text(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Eight-way direction on a plane scaled at the mean latitude."""
    dx = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return compass(F.pmod(F.degrees(F.atan2(dx, lat2 - lat1)) + 360, F.lit(360.0)))


def spherical_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


#: Of the WGS-84 ellipsoid: equatorial radius, third flattening; scale of UTM's central meridian.
_A, _N, _K0 = 6378137.0, 1 / (2 * 298.257223563 - 1), 0.9996
_RECTIFYING = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_LATITUDE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres in a UTM zone (negative for the southern hemisphere), by the transverse Mercator series to the third order."""
    phi, lam = F.radians(lat), F.radians(lon - (F.abs(zone) * 6 - 183))
    e = 2 * _N**0.5 / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum((a * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    y = xi + sum((a * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, a in enumerate(_FORWARD, 1)), F.lit(0.0))
    return 500_000 + _K0 * _RECTIFYING * x, _K0 * _RECTIFYING * y + F.when(zone < 0, 10_000_000.0).otherwise(0.0)


def from_utm(x: Column, y: Column, zone: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a place in a UTM zone."""
    xi, eta = (y - F.when(zone < 0, 10_000_000.0).otherwise(0.0)) / (_K0 * _RECTIFYING), (x - 500_000) / (_K0 * _RECTIFYING)
    a = xi - sum((b * F.sin(2 * k * xi) * F.cosh(2 * k * eta) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
    c = eta - sum((b * F.cos(2 * k * xi) * F.sinh(2 * k * eta) for k, b in enumerate(_BACK, 1)), F.lit(0.0))
    chi = F.asin(F.sin(a) / F.cosh(c))
    lat = chi + sum((d * F.sin(2 * k * chi) for k, d in enumerate(_LATITUDE, 1)), F.lit(0.0))
    return F.degrees(lat), F.abs(zone) * 6 - 183 + F.degrees(F.atan2(F.sinh(c), F.cos(a)))


def point_in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against a ring: array of structs (lat, lon), closed or not. Points on an edge are unspecified."""
    n = F.size(ring)

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        at = a["lon"] + (lat - a["lat"]) / F.nullif(b["lat"] - a["lat"], F.lit(0.0)) * (b["lon"] - a["lon"])
        return F.when(straddles & (lon < at), 1).otherwise(0)

    return F.when(n < 3, F.lit(False)).otherwise(F.pmod(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), crosses), F.lit(0), lambda s, x: s + x), F.lit(2)) == 1)


def ring_area_km2(ring: Column) -> Column:
    """Shoelace area of a ring on a plane scaled at its mean latitude."""
    n = F.size(ring)
    mean = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / n
    scale = KM_PER_DEGREE * KM_PER_DEGREE * F.cos(F.radians(mean))

    def part(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, F.pmod(i + 1, n))
        return a["lon"] * b["lat"] - b["lon"] * a["lat"]

    return F.abs(F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0.0), lambda s, x: s + x)) / 2 * scale


class Land:
    """Rings of (lat, lon) with even-odd containment for many points at once."""

    def __init__(self, rings: list[list[tuple[float, float]]] = ()):
        self.rings = [np.asarray(r, float) for r in rings]

    def __call__(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        inside = np.zeros(np.shape(lat), bool)
        for r in self.rings:
            if len(r) < 3:
                continue
            odd = np.zeros(np.shape(lat), bool)
            for (a_lat, a_lon), (b_lat, b_lon) in zip(r, np.roll(r, -1, axis=0)):
                if a_lat != b_lat:
                    odd ^= ((a_lat > lat) != (b_lat > lat)) & (lon < a_lon + (lat - a_lat) / (b_lat - a_lat) * (b_lon - a_lon))
            inside |= odd
        return inside


def on_land(lat: Column, lon: Column, rings: list[list[tuple[float, float]]]) -> Column:
    """Whether a point lies in any of a bounded list of rings ((lat, lon), ...). A point without a place lies in none."""
    land = Land(rings)

    def inside(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(land(lat.to_numpy(float), lon.to_numpy(float)))

    return F.pandas_udf(inside, "boolean")(lat.cast("double"), lon.cast("double"))


#: Legs whose sampled points are held at once.
LEGS = 2_000


def crosses_land(lat1: Column, lon1: Column, lat2: Column, lon2: Column, rings, skip_km: float = 6.0, samples: int = 25) -> Column:
    """Whether a straight leg passes over land, both ends' first kilometres left out; short legs never do, nor do those without both ends. Points of many legs are
    tested at once, and only those of legs whose box meets a ring's."""
    land, k = Land(rings), np.arange(samples)[:, None]
    boxes = [(*r.min(0), *r.max(0)) for r in land.rings if len(r) > 2]

    def crosses(d: pd.Series, lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
        d, a, b, c, e = (x.to_numpy(float) for x in (d, lat1, lon1, lat2, lon2))
        met = np.zeros(len(d), bool)
        for south, west, north, east in boxes:
            met |= (np.maximum(a, c) >= south) & (np.minimum(a, c) <= north) & (np.maximum(b, e) >= west) & (np.minimum(b, e) <= east)
        out, at = np.zeros(len(d), bool), np.flatnonzero(met & (d >= 2 * skip_km))
        for i in (at[n : n + LEGS] for n in range(0, len(at), LEGS)):
            first = skip_km / d[i]
            f = first + (1 - 2 * first) * k / (samples - 1)
            out[i] = land(a[i] + f * (c[i] - a[i]), b[i] + f * (e[i] - b[i])).any(0)
        return pd.Series(out)

    ends = [x.cast("double") for x in (lat1, lon1, lat2, lon2)]
    return F.pandas_udf(crosses, "boolean")(haversine_km(*ends), *ends)


def box_coverage(ring: list[tuple[float, float]], box: tuple[float, float, float, float]) -> float:
    """Share of a box (lat_min, lat_max, lon_min, lon_max) that a convex-clipped ring covers."""
    lo_lat, hi_lat, lo_lon, hi_lon = box
    points = list(ring)
    for axis, limit, keep_above in ((0, lo_lat, True), (0, hi_lat, False), (1, lo_lon, True), (1, hi_lon, False)):
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            inside, after = ((x[axis] >= limit) == keep_above or x[axis] == limit for x in (p, q))
            if inside:
                out.append(p)
            if inside != after:
                f = (limit - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(p[k] + f * (q[k] - p[k]) for k in (0, 1)))
        points = out
        if not points:
            return 0.0
    area = abs(sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(points, points[1:] + points[:1]))) / 2
    return area / ((hi_lat - lo_lat) * (hi_lon - lo_lon))
