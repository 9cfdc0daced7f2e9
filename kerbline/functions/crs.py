"""Map projections of the Korean grids as column expressions.

Transverse Mercator by the Krüger series in the third flattening (to its fourth power), plus a
seven-parameter shift for the Bessel-based grid. Accuracy is far below a millimetre in Korea.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# EPSG definitions (semi-major axis, inverse flattening, origin, scale, offsets,
# and for the Bessel grid the shift to WGS84: metres, arc seconds, parts per million).


@dataclass(frozen=True)
class Grid:
    a: float
    inv_f: float
    lat0: float
    lon0: float
    k0: float
    fe: float
    fn: float
    shift: tuple[float, ...] | None = None


GRIDS = {
    5174: Grid(6377397.155, 299.1528128, 38.0, 127.0028902777778, 1.0, 200000.0, 500000.0,
               (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)),
    5179: Grid(6378137.0, 298.257222101, 38.0, 127.5, 0.9996, 1000000.0, 2000000.0),
    5186: Grid(6378137.0, 298.257222101, 38.0, 127.0, 1.0, 200000.0, 600000.0),
}
WGS84 = (6378137.0, 298.257223563)


def _series(g: Grid):
    n = 1 / (2 * g.inv_f - 1)
    radius = g.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
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
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
        7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35,
        4279 * n**4 / 630,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    phi0 = math.radians(g.lat0)
    t0 = math.sinh(math.atanh(math.sin(phi0)) - e * math.atanh(e * math.sin(phi0)))
    xi0 = math.atan(t0)
    m0 = xi0 + sum(al * math.sin(2 * j * xi0) for j, al in enumerate(alpha, 1))
    return radius, alpha, beta, delta, e, m0


# A projection is a list of small steps, each turning named columns into new ones. On a DataFrame a
# step is one projection, so no expression is ever repeated inside another.


def _forward_steps(g: Grid) -> list:
    radius, alpha, _, _, e, m0 = _series(g)

    def conformal(c):
        phi = F.radians(c["lat"])
        return {"t": F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e), "lam": F.radians(c["lon"] - g.lon0)}

    def sphere(c):
        t, lam = c["t"], c["lam"]
        return {"xi": F.atan2(t, F.cos(lam)), "eta": F.atanh(F.sin(lam) / F.sqrt(t * t + 1))}

    def plane(c):
        north, east = c["xi"], c["eta"]
        for j, al in enumerate(alpha, 1):
            north = north + F.sin(c["xi"] * (2 * j)) * F.cosh(c["eta"] * (2 * j)) * al
            east = east + F.cos(c["xi"] * (2 * j)) * F.sinh(c["eta"] * (2 * j)) * al
        return {"x": east * (g.k0 * radius) + g.fe, "y": (north - m0) * (g.k0 * radius) + g.fn}

    return [conformal, sphere, plane]


def _inverse_steps(g: Grid) -> list:
    radius, _, beta, delta, _, m0 = _series(g)

    def scaled(c):
        return {"xi": (c["y"] - g.fn) / (g.k0 * radius) + m0, "eta": (c["x"] - g.fe) / (g.k0 * radius)}

    def corrected(c):
        xi, eta = c["xi"], c["eta"]
        for j, b in enumerate(beta, 1):
            xi = xi - F.sin(c["xi"] * (2 * j)) * F.cosh(c["eta"] * (2 * j)) * b
            eta = eta - F.cos(c["xi"] * (2 * j)) * F.sinh(c["eta"] * (2 * j)) * b
        return {"xi": xi, "eta": eta}

    def sphere(c):
        return {
            "chi": F.asin(F.sin(c["xi"]) / F.cosh(c["eta"])),
            "lon": F.degrees(F.atan2(F.sinh(c["eta"]), F.cos(c["xi"]))) + g.lon0,
        }

    def geodetic(c):
        phi = c["chi"]
        for j, d in enumerate(delta, 1):
            phi = phi + F.sin(c["chi"] * (2 * j)) * d
        return {"lat": F.degrees(phi), "lon": c["lon"]}

    return [scaled, corrected, sphere, geodetic]


def _datum_steps(a: float, inv_f: float, params: tuple[float, ...], sign: int, a2: float, inv_f2: float) -> list:
    """Latitude and longitude on one ellipsoid to another by a seven-parameter shift (sign -1 undoes it)."""
    e2 = (2 - 1 / inv_f) / inv_f
    f2 = 1 / inv_f2
    e2b, b2 = (2 - f2) * f2, a2 * (1 - f2)
    rx, ry, rz = (math.radians(s / 3600) * sign for s in params[3:6])
    tx, ty, tz = params[:3]
    m = 1 + params[6] * 1e-6

    def geocentric(c):
        phi, lam = F.radians(c["lat"]), F.radians(c["lon"])
        nu = F.lit(a) / F.sqrt(F.lit(1.0) - F.sin(phi) * F.sin(phi) * e2)
        return {"gx": nu * F.cos(phi) * F.cos(lam), "gy": nu * F.cos(phi) * F.sin(lam), "gz": nu * (1 - e2) * F.sin(phi)}

    def move(c):
        x, y, z = c["gx"], c["gy"], c["gz"]
        if sign < 0:
            x, y, z = (x - tx) / m, (y - ty) / m, (z - tz) / m
        moved = (x - y * rz + z * ry, x * rz + y - z * rx, y * rx - x * ry + z)
        if sign > 0:
            moved = (moved[0] * m + tx, moved[1] * m + ty, moved[2] * m + tz)
        return dict(zip(("gx", "gy", "gz"), moved))

    def polar(c):
        p = F.sqrt(c["gx"] * c["gx"] + c["gy"] * c["gy"])
        return {"p": p, "theta": F.atan2(c["gz"] * a2, p * b2), "gz": c["gz"], "lon": F.degrees(F.atan2(c["gy"], c["gx"]))}

    def geodetic(c):
        st, ct = F.sin(c["theta"]), F.cos(c["theta"])
        up = c["gz"] + st * st * st * (e2b / (1 - e2b) * b2)
        return {"lat": F.degrees(F.atan2(up, c["p"] - ct * ct * ct * (e2b * a2))), "lon": c["lon"]}

    return [geocentric, move, polar, geodetic]


def _steps(source: int, target: int) -> list:
    steps: list = []
    if source != 4326:
        g = GRIDS[source]
        steps += _inverse_steps(g)
        if g.shift:
            steps += _datum_steps(g.a, g.inv_f, g.shift, 1, *WGS84)
    else:
        steps.append(lambda c: {"lat": c["y"], "lon": c["x"]})
    if target != 4326:
        g = GRIDS[target]
        if g.shift:
            steps += _datum_steps(*WGS84, g.shift, -1, g.a, g.inv_f)
        steps += _forward_steps(g)
    else:
        steps.append(lambda c: {"x": c["lon"], "y": c["lat"]})
    return steps


def reproject(df: DataFrame, x: str, y: str, source: int, target: int, out_x: str, out_y: str) -> DataFrame:
    """Add coordinates in ``target``; 4326 means x = longitude, y = latitude."""
    keep = [c for c in df.columns if c not in (out_x, out_y)]
    cols = {"x": F.col(x), "y": F.col(y)}
    if source != target:
        for i, step in enumerate(_steps(source, target)):
            made = {k: v.alias(f"_{k}{i}") for k, v in step(cols).items()}
            df = df.select(*keep, *made.values())
            cols = {k: F.col(f"_{k}{i}") for k in made}
    return df.select(*keep, cols["x"].alias(out_x), cols["y"].alias(out_y))


def geom_to_crs(geom, source: int, target: int) -> Column:
    """Reproject every vertex of an array geometry, one step of the projection at a time."""
    geom = F.col(geom) if isinstance(geom, str) else geom
    names = ("x", "y", "lat", "lon", "t", "lam", "xi", "eta", "chi", "gx", "gy", "gz", "p", "theta")

    def vertex(step):
        return lambda v: F.struct(*[c.alias(k) for k, c in step({n: v.getField(n) for n in names}).items()])

    for step in _steps(source, target) if source != target else []:
        geom = F.transform(geom, vertex(step))
    return geom


def shifted(x, y, dx: float, dy: float) -> tuple[Column, Column]:
    """Constant correction applied before projecting."""
    x, y = (F.col(x) if isinstance(x, str) else x), (F.col(y) if isinstance(y, str) else y)
    return x + dx, y + dy
