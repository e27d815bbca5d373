"""Coordinate reference systems in closed form, as Columns: EPSG:4326, 3857 and the UTM zones 326zz and 327zz."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING = 6378137.0, 1 / 298.257223563
_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = math.sqrt(FLATTENING * (2 - FLATTENING))
# Krüger's series to the third power: forward and inverse
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_SCALE, _EASTING, _SOUTH = 0.9996, 500000.0, 10000000.0


def code_of(crs: str) -> int:
    """The EPSG number; an error for what is not supported."""
    found = re.fullmatch(r"(?i)epsg:(\d+)", crs.strip())
    code = int(found[1]) if found else 0
    if code not in (4326, 3857) and not (32601 <= code <= 32660 or 32701 <= code <= 32760):
        raise ValueError(f"unsupported coordinate reference system {crs!r}")
    return code


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _to_utm(lon: Column, lat: Column, code: int) -> Column:
    zone, south = code % 100, code >= 32700

    def series(e: Column) -> Column:
        xi, eta = e["x"], e["y"]
        x, y = eta, xi
        for j, a in enumerate(_ALPHA, 1):
            x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _xy(_EASTING + _SCALE * _RADIUS * x, (_SOUTH if south else 0.0) + _SCALE * _RADIUS * y)

    lam = F.radians(lon - (6 * zone - 183))
    conformal = _let(F.sin(F.radians(lat)), lambda s: F.sinh(_atanh(s) - _E * _atanh(_E * s)))
    return _let(_let(conformal, lambda t: _xy(F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t)))), series)


def _from_utm(x: Column, y: Column, code: int) -> Column:
    zone, south = code % 100, code >= 32700

    def series(e: Column) -> Column:
        xi, eta = e["x"], e["y"]
        p, q = xi, eta
        for j, b in enumerate(_BETA, 1):
            p = p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            q = q - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return _xy(p, q)

    def newton(tau: Column, t: Column) -> Column:
        """Conformal to geodetic latitude: one step towards the tangent t that gives tau."""

        def step(sigma: Column) -> Column:
            back = t * F.sqrt(1 + sigma * sigma) - sigma * F.sqrt(1 + t * t)
            return _let(back, lambda k: t + (tau - k) / F.sqrt(1 + k * k) * (1 + (1 - _E**2) * t * t) / ((1 - _E**2) * F.sqrt(1 + t * t)))

        return _let(F.sinh(_E * _atanh(_E * t / F.sqrt(1 + t * t))), step)

    def geodetic(e: Column) -> Column:
        p, q = e["x"], e["y"]
        tau = F.sin(p) / F.sqrt(F.sinh(q) * F.sinh(q) + F.cos(p) * F.cos(p))
        t = _let(tau, lambda v: _let(newton(v, v), lambda t1: _let(newton(v, t1), lambda t2: newton(v, t2))))
        return _xy((6 * zone - 183) + F.degrees(F.atan2(F.sinh(q), F.cos(p))), F.degrees(F.atan(t)))

    at = _xy((y - (_SOUTH if south else 0.0)) / (_SCALE * _RADIUS), (x - _EASTING) / (_SCALE * _RADIUS))
    return _let(_let(at, series), geodetic)


def transform_xy(x: Column, y: Column, source: str, target: str) -> Column:
    """Struct x, y in longitude, latitude (or easting, northing) order from one system to another."""
    a, b = code_of(source), code_of(target)
    if a == b:
        return _xy(x, y)

    def from_lonlat(e: Column) -> Column:
        if b == 3857:
            return _xy(F.radians(e["x"]) * A, A * F.log(F.tan(math.pi / 4 + F.radians(e["y"]) / 2)))
        return e if b == 4326 else _to_utm(e["x"], e["y"], b)

    if a == 4326:
        return from_lonlat(_xy(x, y))
    if a == 3857:
        return from_lonlat(_xy(F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A)) - math.pi / 2)))
    return _let(_from_utm(x, y, a), from_lonlat)
