"""Map projections as Column arithmetic: UTM (Krueger series), Albers equal area, MGRS squares."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from swathframe.constants import ALBERS_AU, GRS80_A, GRS80_F, MGRS_LETTERS, WGS84_A, WGS84_F
from swathframe.functions.common import as_col

# Krueger series coefficients of the WGS84 ellipsoid, fourth order in the third flattening.
_N = WGS84_F / (2 - WGS84_F)
_SCALE = 0.9996 * WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
          13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
          61 * _N**3 / 240 - 103 * _N**4 / 140,
          49561 * _N**4 / 161280)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
         _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
         17 * _N**3 / 480 - 37 * _N**4 / 840,
         4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
          7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
          56 * _N**3 / 15 - 136 * _N**4 / 35,
          4279 * _N**4 / 630)
_EASTING0 = 500000.0
_SOUTH0 = 10000000.0


def _zone_of(epsg: Column) -> tuple[Column, Column]:
    """Central meridian in degrees and false northing of a 326xx/327xx code."""
    code = epsg.cast("int")
    meridian = (code % 100) * 6 - 183
    return meridian, F.when(code >= 32700, F.lit(_SOUTH0)).otherwise(F.lit(0.0))


def to_utm(lon, lat, epsg) -> Column:
    """(easting, northing) of a geographic point in a UTM zone."""
    meridian, false_north = _zone_of(as_col(epsg))
    phi = F.radians(as_col(lat))
    lam = F.radians(as_col(lon) - meridian)
    c = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(c) * F.atanh(F.lit(c) * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((F.lit(_EASTING0) + F.lit(_SCALE) * east).alias("easting"),
                    (false_north + F.lit(_SCALE) * north).alias("northing"))


def from_utm(easting, northing, epsg) -> Column:
    """(lon, lat) of a UTM point."""
    meridian, false_north = _zone_of(as_col(epsg))
    xi = (as_col(northing) - false_north) / F.lit(_SCALE)
    eta = (as_col(easting) - F.lit(_EASTING0)) / F.lit(_SCALE)
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return F.struct((meridian + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))).alias("lon"),
                    F.degrees(phi).alias("lat"))


_E2 = GRS80_F * (2 - GRS80_F)
_E = math.sqrt(_E2)


def _q(sin_phi: float) -> float:
    es = _E * sin_phi
    return (1 - _E2) * (sin_phi / (1 - es * es) - math.log((1 - es) / (1 + es)) / (2 * _E))


def _albers(p: dict) -> tuple[float, float, float]:
    """Cone constant, C and the radius of the origin parallel."""
    def m2(phi):
        return math.cos(phi) ** 2 / (1 - _E2 * math.sin(phi) ** 2)

    p1, p2, p0 = (math.radians(p[k]) for k in ("lat1", "lat2", "lat0"))
    q1, q2 = _q(math.sin(p1)), _q(math.sin(p2))
    n = (m2(p1) - m2(p2)) / (q2 - q1)
    c = m2(p1) + n * q1
    return n, c, GRS80_A * math.sqrt(c - n * _q(math.sin(p0))) / n


def to_albers(lon, lat, params: dict | None = None) -> Column:
    """(x, y) in the Australian Albers equal-area projection unless other parallels are given."""
    p = params or ALBERS_AU
    n, c, rho0 = _albers(p)
    s = F.sin(F.radians(as_col(lat)))
    es = F.lit(_E) * s
    q = F.lit(1 - _E2) * (s / (1 - es * es) - F.log((1 - es) / (1 + es)) / F.lit(2 * _E))
    rho = F.lit(GRS80_A / n) * F.sqrt(F.lit(c) - F.lit(n) * q)
    theta = F.lit(n) * F.radians(as_col(lon) - F.lit(p["lon0"]))
    return F.struct((rho * F.sin(theta)).alias("x"), (F.lit(rho0) - rho * F.cos(theta)).alias("y"))


def from_albers(x, y, params: dict | None = None) -> Column:
    p = params or ALBERS_AU
    n, c, rho0 = _albers(p)
    sign = 1.0 if n > 0 else -1.0
    xs, ys = F.lit(sign) * as_col(x), F.lit(sign) * (F.lit(rho0) - as_col(y))
    rho = F.sqrt(xs * xs + ys * ys)
    q = (F.lit(c) - F.pow(rho * F.lit(n / GRS80_A), F.lit(2.0))) / F.lit(n)
    beta = F.asin(q / F.lit(_q(1.0)))
    e4, e6 = _E2**2, _E2**3
    phi = (beta + F.lit(_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta)
           + F.lit(23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta)
           + F.lit(761 * e6 / 45360) * F.sin(6 * beta))
    return F.struct((F.lit(p["lon0"]) + F.degrees(F.atan2(xs, ys)) / F.lit(n)).alias("lon"),
                    F.degrees(phi).alias("lat"))


def _letter(index: Column) -> Column:
    return F.substring(F.lit(MGRS_LETTERS), index + 1, F.lit(1))


def mgrs_square(epsg, easting, northing) -> Column:
    """100 km grid square, e.g. ``55HFA``.

    The latitude band comes from the mean latitude at eastings 200 and 700 km,
    never above band X; NULL for codes that are not UTM.
    """
    code = as_col(epsg).cast("int")
    e, n = as_col(easting), as_col(northing)
    zone = code % 100
    mean_lat = (from_utm(F.lit(200000.0), n, code)["lat"] + from_utm(F.lit(700000.0), n, code)["lat"]) / 2
    band = F.least(((mean_lat + 80) / 8).cast("int") + MGRS_LETTERS.index("C"), F.lit(MGRS_LETTERS.index("X")))
    first_column = (F.when(zone % 3 == 1, F.lit(MGRS_LETTERS.index("A")))
                    .when(zone % 3 == 2, F.lit(MGRS_LETTERS.index("J")))
                    .otherwise(F.lit(MGRS_LETTERS.index("S"))))
    column = first_column + (e / 100000).cast("int") - 1
    shifted = n + F.when(zone % 2 == 0, F.lit(500000.0)).otherwise(F.lit(0.0))
    row = ((shifted % 2000000) / 100000).cast("int")
    square = F.concat(F.lpad(zone.cast("string"), 2, "0"), _letter(band), _letter(column), _letter(row))
    return F.when(F.floor(code / 100).isin(326, 327) & (zone != 61), square)
