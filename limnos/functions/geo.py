"""Geometry and projections as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6_371_000.0) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def cell_key(lat: Column, lon: Column) -> Column:
    """One-degree cell, half-even rounding."""
    return F.concat(F.lit("grid_"), F.bround(lat, 0).cast("int"), F.lit("_"), F.bround(lon, 0).cast("int"))


# WGS84/GRS80 ellipsoid and the transverse Mercator zone of EPSG:3006: fixed values.
_A, _F, _LON0, _K0, _E0, _N0 = 6378137.0, 1 / 298.257222101, 15.0, 0.9996, 500000.0, 0.0


def transverse_mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in EPSG:3006 by the Krüger series."""
    e2 = _F * (2 - _F)
    n = _F / (2 - _F)
    scale = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    a, b, c, d = e2, (5 * e2**2 - e2**3) / 6, (104 * e2**3 - 45 * e2**4) / 120, 1237 * e2**4 / 1260
    phi, lam = F.radians(lat), F.radians(lon) - math.radians(_LON0)
    s2 = F.pow(F.sin(phi), 2)
    conf = phi - F.sin(phi) * F.cos(phi) * (a + b * s2 + c * F.pow(s2, 2) + d * F.pow(s2, 3))
    xi = F.atan2(F.tan(conf), F.cos(lam))
    eta = F.atanh(F.cos(conf) * F.sin(lam))
    beta = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    north, east = xi, eta
    for i, k in enumerate(beta, 1):
        north = north + k * F.sin(2 * i * xi) * F.cosh(2 * i * eta)
        east = east + k * F.cos(2 * i * xi) * F.sinh(2 * i * eta)
    return _K0 * scale * east + _E0, _K0 * scale * north + _N0


def inverse_transverse_mercator(easting: Column, northing: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees from EPSG:3006, by the inverse series."""
    e2 = _F * (2 - _F)
    n = _F / (2 - _F)
    scale = _A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    xi, eta = (northing - _N0) / (_K0 * scale), (easting - _E0) / (_K0 * scale)
    delta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    x, y = xi, eta
    for i, k in enumerate(delta, 1):
        x = x - k * F.sin(2 * i * xi) * F.cosh(2 * i * eta)
        y = y - k * F.cos(2 * i * xi) * F.sinh(2 * i * eta)
    conf = F.asin(F.sin(x) / F.cosh(y))
    a, b = e2 + e2**2 + e2**3 + e2**4, -(7 * e2**2 + 17 * e2**3 + 30 * e2**4) / 6
    c, d = (224 * e2**3 + 889 * e2**4) / 120, -(4279 * e2**4) / 1260
    s2 = F.pow(F.sin(conf), 2)
    lat = conf + F.sin(conf) * F.cos(conf) * (a + b * s2 + c * F.pow(s2, 2) + d * F.pow(s2, 3))
    return F.degrees(lat), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + _LON0


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """The point of the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)


def rotate_pole(lat: Column, lon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """Coordinates on a grid whose south pole lies at (pole_lat, pole_lon): (rotated lat, rotated lon) in degrees."""
    return _turned(lat, lon, math.radians(90 + pole_lat), math.radians(pole_lon), 0.0)


def unrotate_pole(rlat: Column, rlon: Column, pole_lat: float, pole_lon: float) -> tuple[Column, Column]:
    """The inverse of `rotate_pole`: (lat, lon) in degrees."""
    return _turned(rlat, rlon, -math.radians(90 + pole_lat), 0.0, math.radians(pole_lon))


def _turned(lat: Column, lon: Column, t: float, before: float, after: float) -> tuple[Column, Column]:
    """Turned by `t` about the axis through the equator at 90 degrees east, longitudes shifted before and after."""
    la, lo = F.radians(lat), F.radians(lon) - before
    x, y, z = F.cos(lo) * F.cos(la), F.sin(lo) * F.cos(la), F.sin(la)
    xr, zr = F.lit(math.cos(t)) * x + F.lit(math.sin(t)) * z, F.lit(-math.sin(t)) * x + F.lit(math.cos(t)) * z
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), zr)))), F.degrees(F.atan2(y, xr) + after)


def rotated_cell(lat: Column, lon: Column, pole_lat: float, pole_lon: float, first: tuple[float, float], step: float, shape: tuple[int, int]) -> dict[str, Column]:
    """The nearest cell of a rotated-pole grid: its row and column from the cell at `first` (rotated lat, lon), clipped to the grid; the cell's own lat and lon; metres from the point to it."""
    rlat, rlon = rotate_pole(lat, lon, pole_lat, pole_lon)
    index = lambda x, at, n: F.least(F.greatest(F.round((x - at) / step), F.lit(0)), F.lit(n - 1)).cast("int")
    row, col = index(rlat, first[0], shape[0]), index(rlon, first[1], shape[1])
    cell_lat, cell_lon = unrotate_pole(first[0] + row * step, first[1] + col * step, pole_lat, pole_lon)
    return {"row": row, "col": col, "cell_lat": cell_lat, "cell_lon": cell_lon, "dist": haversine(lat, lon, cell_lat, cell_lon)}


def laea(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) in EPSG:3035, ellipsoidal Lambert azimuthal equal-area."""
    e2 = _F * (2 - _F)
    e = math.sqrt(e2)
    lat0, lon0 = math.radians(52), math.radians(10)

    def q_of(sin, log):
        return (1 - e2) * (sin / (1 - e2 * sin * sin) - (1 / (2 * e)) * log((1 - e * sin) / (1 + e * sin)))

    qp = q_of(1.0, math.log)
    b0, rq = math.asin(q_of(math.sin(lat0), math.log) / qp), _A * math.sqrt(qp / 2)
    d = _A * (math.cos(lat0) / math.sqrt(1 - e2 * math.sin(lat0) ** 2)) / (rq * math.cos(b0))
    b, dl = F.asin(q_of(F.sin(F.radians(lat)), F.ln) / qp), F.radians(lon) - lon0
    k = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(b) + math.cos(b0) * F.cos(b) * F.cos(dl)))
    return 4321000 + d * k * F.cos(b) * F.sin(dl), 3210000 + k / d * (math.cos(b0) * F.sin(b) - math.sin(b0) * F.cos(b) * F.cos(dl))


def year_span(year: Column, years: int) -> Column:
    """Label of the period of so many years that a year lies in: first-last."""
    first = F.floor(year / years) * years
    return F.concat_ws("-", first.cast("string"), (first + years - 1).cast("string"))


def season(month: Column) -> Column:
    return F.when(month.between(3, 5), "MAM").when(month.between(6, 8), "JJA").when(month.between(9, 11), "SON").when(month.isNotNull(), "DJF")
