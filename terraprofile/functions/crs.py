"""Coordinate reference systems as closed-form column arithmetic.

Only the listed codes are known. Each projection gives a ``forward`` map from
longitude and latitude in degrees to metres and an ``inverse`` one, as functions
from two columns to two columns; datums are not shifted.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terraprofile.functions.geometry import let

Pair = tuple[Column, Column]
Move = Callable[[Column, Column], Pair]

# Semi-major axis and inverse flattening of the ellipsoids.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563),
    "GRS80": (6378137.0, 298.257222101),
    "airy": (6377563.396, 299.3249646),
    "intl": (6378388.0, 297.0),
}

# Public parameters of the projections, by EPSG code.
PROJECTIONS = {
    2154: dict(method="lcc", lat0=46.5, lon0=3.0, lat1=49.0, lat2=44.0, x0=700000.0, y0=6600000.0, ellipsoid="GRS80"),
    2062: dict(method="lcc", lat0=40.0, lon0=-3.0, lat1=40.0, lat2=40.0, x0=2500000.0, y0=0.0, ellipsoid="intl"),
    3857: dict(method="mercator", radius=6378137.0),
    27700: dict(method="tmerc", lat0=49.0, lon0=-2.0, k0=0.9996012717, x0=400000.0, y0=-100000.0, ellipsoid="airy"),
    25832: dict(method="tmerc", lat0=0.0, lon0=9.0, k0=0.9996, x0=500000.0, y0=0.0, ellipsoid="GRS80"),
    3035: dict(method="laea", lat0=52.0, lon0=10.0, x0=4321000.0, y0=3210000.0, ellipsoid="GRS80"),
    5070: dict(method="aea", lat0=23.0, lon0=-96.0, lat1=29.5, lat2=45.5, x0=0.0, y0=0.0, ellipsoid="GRS80"),
}
GEOGRAPHIC = 4326
KNOWN = (GEOGRAPHIC, *PROJECTIONS)


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    e: float
    n: float

    @classmethod
    def named(cls, name: str) -> "Ellipsoid":
        a, inverse_flattening = ELLIPSOIDS[name]
        f = 1 / inverse_flattening
        return cls(a, math.sqrt(f * (2 - f)), f / (2 - f))

    def isometric_t(self, phi: float) -> float:
        s = math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) * math.exp(self.e * math.atanh(self.e * s))

    def m(self, phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (self.e * math.sin(phi)) ** 2)

    def q(self, phi: float) -> float:
        """Authalic latitude function."""
        es = self.e * math.sin(phi)
        return (1 - self.e**2) * (math.sin(phi) / (1 - es * es) + math.atanh(es) / self.e)


# ------------------------------------------------------------- shared latitudes

def _t(ell: Ellipsoid, phi: Column) -> Column:
    return F.tan(F.lit(math.pi / 4) - phi / 2) * F.exp(F.atanh(F.sin(phi) * ell.e) * ell.e)


def _latitude_of_t(ell: Ellipsoid, t: Column) -> Column:
    """Geodetic latitude of an isometric ``t``; each round gains two digits or more."""

    def rounds(tt: Column) -> Column:
        phi = F.lit(math.pi / 2) - F.atan(tt) * 2
        for _ in range(6):
            phi = F.lit(math.pi / 2) - F.atan(tt * F.exp(F.atanh(F.sin(phi) * ell.e) * -ell.e)) * 2
        return phi

    return let(t, rounds)


def _q(ell: Ellipsoid, phi: Column) -> Column:
    return let(
        F.sin(phi) * ell.e,
        lambda es: (es / ell.e / (1 - es * es) + F.atanh(es) / ell.e) * (1 - ell.e**2),
    )


def _latitude_of_q(ell: Ellipsoid, q: Column) -> Column:
    """Geodetic latitude of an authalic ``q``: Newton's method on its sine."""
    e, e2 = ell.e, ell.e**2

    def solve(qq: Column) -> Column:
        def newton(s: Column, _round: Column) -> Column:
            return let(
                F.lit(1.0) - s * s * e2,
                lambda w: s - (s / w + F.atanh(s * e) / e - qq / (1 - e2)) * w * w / 2,
            )

        sine = F.aggregate(F.sequence(F.lit(1), F.lit(5)), qq / 2, newton)
        return F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), sine)))

    return let(q, solve)


# ------------------------------------------------------------------ projections

def _lcc(p: dict) -> tuple[Move, Move]:
    ell = Ellipsoid.named(p["ellipsoid"])
    phi0, phi1, phi2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    lam0 = math.radians(p["lon0"])
    if abs(phi1 - phi2) < 1e-12:
        n = math.sin(phi1)
    else:
        n = (math.log(ell.m(phi1)) - math.log(ell.m(phi2))) / (
            math.log(ell.isometric_t(phi1)) - math.log(ell.isometric_t(phi2))
        )
    scale = ell.a * ell.m(phi1) / (n * ell.isometric_t(phi1) ** n)
    rho0 = scale * ell.isometric_t(phi0) ** n

    def forward(lon: Column, lat: Column) -> Pair:
        rho = F.pow(_t(ell, F.radians(lat)), F.lit(n)) * scale
        theta = (F.radians(lon) - lam0) * n
        return rho * F.sin(theta) + p["x0"], F.lit(rho0 + p["y0"]) - rho * F.cos(theta)

    def inverse(x: Column, y: Column) -> Pair:
        dx, dy = x - p["x0"], F.lit(rho0 + p["y0"]) - y
        sign = math.copysign(1.0, n)
        rho = F.sqrt(dx * dx + dy * dy) * sign
        lam = F.atan2(dx * sign, dy * sign) / n + lam0
        return F.degrees(lam), F.degrees(_latitude_of_t(ell, F.pow(rho / scale, F.lit(1 / n))))

    return forward, inverse


def _mercator(p: dict) -> tuple[Move, Move]:
    r = p["radius"]

    def forward(lon: Column, lat: Column) -> Pair:
        return F.radians(lon) * r, F.atanh(F.sin(F.radians(lat))) * r

    def inverse(x: Column, y: Column) -> Pair:
        return F.degrees(x / r), F.degrees(F.atan(F.sinh(y / r)))

    return forward, inverse


def _tmerc(p: dict) -> tuple[Move, Move]:
    """Transverse Mercator by the Krueger series to the fourth order in ``n``."""
    ell = Ellipsoid.named(p["ellipsoid"])
    n = ell.n
    lam0, phi0 = math.radians(p["lon0"]), math.radians(p["lat0"])
    rect = ell.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    )
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    chi0 = math.atan(math.sinh(math.asinh(math.tan(phi0)) - ell.e * math.atanh(ell.e * math.sin(phi0))))
    origin = chi0 + sum(a * math.sin(2 * (j + 1) * chi0) for j, a in enumerate(alpha))
    k = p["k0"] * rect

    def forward(lon: Column, lat: Column) -> Pair:
        phi, lam = F.radians(lat), F.radians(lon) - lam0
        # tan of the conformal latitude
        tau = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * ell.e) * ell.e)
        xi = F.atan2(tau, F.cos(lam))
        eta = F.atanh(F.sin(lam) / F.sqrt(tau * tau + 1))
        north, east = xi, eta
        for j, a in enumerate(alpha, 1):
            north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a
            east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a
        return east * k + p["x0"], (north - origin) * k + p["y0"]

    def inverse(x: Column, y: Column) -> Pair:
        xi, eta = (y - p["y0"]) / k + origin, (x - p["x0"]) / k
        north, east = xi, eta
        for j, b in enumerate(beta, 1):
            north = north - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
            east = east - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
        lam = F.atan2(F.sinh(east), F.cos(north)) + lam0
        chi = F.asin(F.sin(north) / F.cosh(east))
        t = F.tan(F.lit(math.pi / 4) - chi / 2)
        return F.degrees(lam), F.degrees(_latitude_of_t(ell, t))

    return forward, inverse


def _laea(p: dict) -> tuple[Move, Move]:
    ell = Ellipsoid.named(p["ellipsoid"])
    phi0, lam0 = math.radians(p["lat0"]), math.radians(p["lon0"])
    qp = ell.q(math.pi / 2)
    beta0 = math.asin(ell.q(phi0) / qp)
    rq = ell.a * math.sqrt(qp / 2)
    d = ell.a * ell.m(phi0) / (rq * math.cos(beta0))

    def forward(lon: Column, lat: Column) -> Pair:
        beta = F.asin(_q(ell, F.radians(lat)) / qp)
        lam = F.radians(lon) - lam0
        b = F.sqrt(
            F.lit(2.0) / (F.sin(beta) * math.sin(beta0) + F.cos(beta) * F.cos(lam) * math.cos(beta0) + 1)
        ) * rq
        x = b * d * F.cos(beta) * F.sin(lam)
        y = (b / d) * (F.sin(beta) * math.cos(beta0) - F.cos(beta) * F.cos(lam) * math.sin(beta0))
        return x + p["x0"], y + p["y0"]

    def inverse(x: Column, y: Column) -> Pair:
        dx, dy = (x - p["x0"]) / d, (y - p["y0"]) * d
        rho = F.sqrt(dx * dx + dy * dy)
        ce = F.asin(rho / (2 * rq)) * 2
        centre = rho < 1e-9
        sin_beta = F.when(centre, F.lit(math.sin(beta0))).otherwise(
            F.cos(ce) * math.sin(beta0) + dy * F.sin(ce) * math.cos(beta0) / rho
        )
        lam = F.when(centre, F.lit(0.0)).otherwise(
            F.atan2(dx * F.sin(ce), rho * F.cos(ce) * math.cos(beta0) - dy * F.sin(ce) * math.sin(beta0))
        )
        return F.degrees(lam + lam0), F.degrees(_latitude_of_q(ell, sin_beta * qp))

    return forward, inverse


def _aea(p: dict) -> tuple[Move, Move]:
    ell = Ellipsoid.named(p["ellipsoid"])
    phi0, phi1, phi2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    lam0 = math.radians(p["lon0"])
    n = (ell.m(phi1) ** 2 - ell.m(phi2) ** 2) / (ell.q(phi2) - ell.q(phi1))
    c = ell.m(phi1) ** 2 + n * ell.q(phi1)
    rho0 = ell.a * math.sqrt(c - n * ell.q(phi0)) / n

    def forward(lon: Column, lat: Column) -> Pair:
        rho = F.sqrt(F.lit(c) - _q(ell, F.radians(lat)) * n) * (ell.a / n)
        theta = (F.radians(lon) - lam0) * n
        return rho * F.sin(theta) + p["x0"], F.lit(rho0 + p["y0"]) - rho * F.cos(theta)

    def inverse(x: Column, y: Column) -> Pair:
        dx, dy = x - p["x0"], F.lit(rho0 + p["y0"]) - y
        q = (F.lit(c) - (dx * dx + dy * dy) * (n * n / ell.a**2)) / n
        lam = F.atan2(dx, dy) / n + lam0
        return F.degrees(lam), F.degrees(_latitude_of_q(ell, q))

    return forward, inverse


_METHODS = {"lcc": _lcc, "mercator": _mercator, "tmerc": _tmerc, "laea": _laea, "aea": _aea}


def maps(epsg: int) -> tuple[Move, Move]:
    """``(forward, inverse)`` of a projected code."""
    if epsg not in PROJECTIONS:
        raise ValueError(f"EPSG:{epsg} is not a known projection")
    p = PROJECTIONS[epsg]
    return _METHODS[p["method"]](p)


def transformer(source: int, target: int) -> Move:
    """The map between two codes; equal codes give the coordinates unchanged."""
    if source == target:
        return lambda x, y: (x, y)
    if source == GEOGRAPHIC:
        return maps(target)[0]
    back = maps(source)[1]
    if target == GEOGRAPHIC:
        return back
    onward = maps(target)[0]
    return lambda x, y: onward(*back(x, y))


def move_struct(source: int, target: int) -> Callable[[Column, Column], Column]:
    """:func:`transformer` returning one ``struct<x, y>``, for array lambdas."""
    move = transformer(source, target)

    def apply(x: Column, y: Column) -> Column:
        mx, my = move(x, y)
        return F.struct(mx.alias("x"), my.alias("y"))

    return apply
