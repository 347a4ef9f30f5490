"""Point reprojection between a Transverse Mercator grid and WGS84 lon/lat.

Native column math (series of Snyder, "Map Projections: A Working Manual",
USGS PP 1395, 1987), so it runs inside whole-stage codegen. Accuracy is well
below a millimetre within a few degrees of the central meridian, which is
the zone a national TM grid is defined for.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WGS84 = 4326


@dataclass(frozen=True)
class TransverseMercator:
    lon0: float          # central meridian, degrees
    lat0: float          # latitude of origin, degrees
    k0: float            # scale factor on the central meridian
    false_easting: float
    false_northing: float
    a: float = 6378137.0                # ellipsoid semi-major axis (m)
    inv_f: float = 298.257223563        # ellipsoid inverse flattening


# Published definition of EPSG:5367 (CR05 / CRTM05).
GRIDS: dict[int, TransverseMercator] = {
    5367: TransverseMercator(lon0=-84.0, lat0=0.0, k0=0.9999,
                             false_easting=500000.0, false_northing=0.0),
}


def _consts(g: TransverseMercator):
    f = 1.0 / g.inv_f
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    m1 = 1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256
    m2 = 3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024
    m3 = 15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024
    m4 = 35 * e2 ** 3 / 3072
    return e2, ep2, (m1, m2, m3, m4)


def _meridian_arc(a: float, m: tuple, phi):
    """Distance along the meridian from the equator to latitude ``phi``."""
    m1, m2, m3, m4 = m
    if isinstance(phi, float):
        return a * (m1 * phi - m2 * math.sin(2 * phi) + m3 * math.sin(4 * phi)
                    - m4 * math.sin(6 * phi))
    return F.lit(a) * (F.lit(m1) * phi - F.lit(m2) * F.sin(2 * phi)
                       + F.lit(m3) * F.sin(4 * phi) - F.lit(m4) * F.sin(6 * phi))


def tm_forward(lon: Column, lat: Column, g: TransverseMercator) -> tuple[Column, Column]:
    """Degrees lon/lat -> grid easting/northing (metres)."""
    e2, ep2, m = _consts(g)
    phi = F.radians(lat)
    n = F.lit(g.a) / F.sqrt(1 - F.lit(e2) * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = F.lit(ep2) * F.pow(F.cos(phi), 2)
    a_ = (F.radians(lon) - F.lit(math.radians(g.lon0))) * F.cos(phi)
    m0 = _meridian_arc(g.a, m, math.radians(g.lat0))
    x = F.lit(g.false_easting) + F.lit(g.k0) * n * (
        a_ + (1 - t + c) * F.pow(a_, 3) / 6
        + (5 - 18 * t + t * t + 72 * c - F.lit(58 * ep2)) * F.pow(a_, 5) / 120
    )
    y = F.lit(g.false_northing) + F.lit(g.k0) * (
        _meridian_arc(g.a, m, phi) - F.lit(m0) + n * F.tan(phi) * (
            a_ * a_ / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a_, 4) / 24
            + (61 - 58 * t + t * t + 600 * c - F.lit(330 * ep2)) * F.pow(a_, 6) / 720
        )
    )
    return x, y


def tm_inverse(x: Column, y: Column, g: TransverseMercator) -> tuple[Column, Column]:
    """Grid easting/northing (metres) -> degrees lon/lat."""
    e2, ep2, m = _consts(g)
    m0 = _meridian_arc(g.a, m, math.radians(g.lat0))
    mu = (F.lit(m0) + (y - F.lit(g.false_northing)) / F.lit(g.k0)) / F.lit(g.a * m[0])
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    phi1 = (mu + F.lit(3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(2 * mu)
            + F.lit(21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
            + F.lit(151 * e1 ** 3 / 96) * F.sin(6 * mu)
            + F.lit(1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    s2 = F.pow(F.sin(phi1), 2)
    c1 = F.lit(ep2) * F.pow(F.cos(phi1), 2)
    t1 = F.pow(F.tan(phi1), 2)
    n1 = F.lit(g.a) / F.sqrt(1 - F.lit(e2) * s2)
    r1 = F.lit(g.a * (1 - e2)) / F.pow(1 - F.lit(e2) * s2, 1.5)
    d = (x - F.lit(g.false_easting)) / (n1 * F.lit(g.k0))
    phi = phi1 - (n1 * F.tan(phi1) / r1) * (
        d * d / 2
        - (5 + 3 * t1 + 10 * c1 - 4 * c1 * c1 - F.lit(9 * ep2)) * F.pow(d, 4) / 24
        + (61 + 90 * t1 + 298 * c1 + 45 * t1 * t1 - F.lit(252 * ep2) - 3 * c1 * c1)
        * F.pow(d, 6) / 720
    )
    lam = F.lit(math.radians(g.lon0)) + (
        d - (1 + 2 * t1 + c1) * F.pow(d, 3) / 6
        + (5 - 2 * c1 + 28 * t1 - 3 * c1 * c1 + F.lit(8 * ep2) + 24 * t1 * t1)
        * F.pow(d, 5) / 120
    ) / F.cos(phi1)
    return F.degrees(lam), F.degrees(phi)


def reproject(
    df: DataFrame,
    source_epsg: int | None,
    target_epsg: int,
    x: str = "x",
    y: str = "y",
    epsg_col: str = "epsg",
    grids: dict[int, TransverseMercator] | None = None,
) -> DataFrame:
    """Reproject point columns ``x``/``y`` and set ``epsg_col``.

    Equal CRS: unchanged. Unknown source CRS (None): unchanged, since
    there is nothing to convert from. Supported: a grid of ``grids``
    (default :data:`GRIDS`) to or from WGS84 (4326, x = lon, y = lat), and
    grid to grid through WGS84.
    """
    if source_epsg is None or source_epsg == target_epsg:
        return df
    table = {**GRIDS, **(grids or {})}
    if source_epsg in table and target_epsg == WGS84:
        nx, ny = tm_inverse(F.col(x), F.col(y), table[source_epsg])
    elif source_epsg == WGS84 and target_epsg in table:
        nx, ny = tm_forward(F.col(x), F.col(y), table[target_epsg])
    elif source_epsg in table and target_epsg in table:
        lon, lat = tm_inverse(F.col(x), F.col(y), table[source_epsg])
        nx, ny = tm_forward(lon, lat, table[target_epsg])
    else:
        raise ValueError(f"no projection from EPSG:{source_epsg} to EPSG:{target_epsg}")
    return df.withColumns({x: nx, y: ny, epsg_col: F.lit(int(target_epsg))})
