"""Geodesy as Column expressions.

Points are two double columns in degrees; metric work happens in UTM metres
obtained with the third-order Krueger series on the GRS80 ellipsoid. The projection is a
long expression: store its result before grouping, joining or sorting by it, or the code
generated for those grows past what Java compiles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.config import EARTH_RADIUS_KM, KM_PER_DEGREE

# GRS80 ellipsoid and UTM constants.
SEMI_MAJOR_M = 6_378_137.0
FLATTENING = 1.0 / 298.257222101
SCALE_K0 = 0.9996
FALSE_EASTING_M = 500_000.0

_N = FLATTENING / (2.0 - FLATTENING)
RECTIFYING_M = SEMI_MAJOR_M / (1.0 + _N) * (1.0 + _N**2 / 4.0 + _N**4 / 64.0)
ECC = 2.0 * math.sqrt(_N) / (1.0 + _N)
ALPHA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 5.0 * _N**3 / 16.0,
    13.0 * _N**2 / 48.0 - 3.0 * _N**3 / 5.0,
    61.0 * _N**3 / 240.0,
)
BETA = (
    _N / 2.0 - 2.0 * _N**2 / 3.0 + 37.0 * _N**3 / 96.0,
    _N**2 / 48.0 + _N**3 / 15.0,
    17.0 * _N**3 / 480.0,
)
DELTA = (
    2.0 * _N - 2.0 * _N**2 / 3.0 - 2.0 * _N**3,
    7.0 * _N**2 / 3.0 - 8.0 * _N**3 / 5.0,
    56.0 * _N**3 / 15.0,
)
CENTRAL_MERIDIAN = {28: -15.0, 29: -9.0, 30: -3.0, 31: 3.0}
ISLANDS_WEST_OF = -12.0


def zone_of_lon(lon: Column) -> Column:
    """UTM zone used for a longitude: islands 28, mainland 30."""
    return F.when(lon < ISLANDS_WEST_OF, F.lit(28)).otherwise(F.lit(30))


def zone_of_area(area_key: Column) -> Column:
    return F.when(area_key == "canarias", F.lit(28)).otherwise(F.lit(30))


def _meridian(zone: Column | int) -> Column:
    if isinstance(zone, int):
        return F.lit(CENTRAL_MERIDIAN[zone])
    expr = F.lit(None).cast("double")
    for number, lon0 in CENTRAL_MERIDIAN.items():
        expr = F.when(zone == number, F.lit(lon0)).otherwise(expr)
    return expr


def utm_xy(lat: Column, lon: Column, zone: Column | int = 30) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    sin_phi = F.sin(F.radians(lat))
    lam = F.radians(lon - _meridian(zone))
    t = F.sinh(F.atanh(sin_phi) - F.lit(ECC) * F.atanh(F.lit(ECC) * sin_phi))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, start=1):
        east = east + F.lit(a) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
        north = north + F.lit(a) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
    scale = F.lit(SCALE_K0 * RECTIFYING_M)
    return F.lit(FALSE_EASTING_M) + scale * east, scale * north


def with_utm(
    df: DataFrame, lat: str, lon: str, zone: Column | int = 30, x: str = "x", y: str = "y"
) -> DataFrame:
    """``df`` with easting and northing added.

    Same series as ``utm_xy`` but in steps: each intermediate is a projection of its
    own, so the optimiser does not expand it once per use.
    """
    step1 = df.withColumns(
        {
            "_sin": F.sin(F.radians(F.col(lat))),
            "_lam": F.radians(F.col(lon) - _meridian(zone)),
        }
    )
    step2 = step1.withColumn(
        "_t", F.sinh(F.atanh("_sin") - F.lit(ECC) * F.atanh(F.lit(ECC) * F.col("_sin")))
    )
    step3 = step2.withColumns(
        {
            "_xi": F.atan2(F.col("_t"), F.cos("_lam")),
            "_eta": F.atanh(F.sin("_lam") / F.sqrt(F.lit(1.0) + F.col("_t") * F.col("_t"))),
        }
    )
    east, north = F.col("_eta"), F.col("_xi")
    for j, a in enumerate(ALPHA, start=1):
        k = F.lit(2.0 * j)
        east = east + F.lit(a) * F.cos(k * F.col("_xi")) * F.sinh(k * F.col("_eta"))
        north = north + F.lit(a) * F.sin(k * F.col("_xi")) * F.cosh(k * F.col("_eta"))
    scale = F.lit(SCALE_K0 * RECTIFYING_M)
    return step3.withColumns({x: F.lit(FALSE_EASTING_M) + scale * east, y: scale * north}).drop(
        "_sin", "_lam", "_t", "_xi", "_eta"
    )


def utm_to_degrees(x: Column, y: Column, zone: Column | int = 30) -> tuple[Column, Column]:
    """Latitude and longitude of a UTM position; null for an unknown zone."""
    scale = F.lit(SCALE_K0 * RECTIFYING_M)
    xi = y / scale
    eta = (x - F.lit(FALSE_EASTING_M)) / scale
    xi1, eta1 = xi, eta
    for j, b in enumerate(BETA, start=1):
        xi1 = xi1 - F.lit(b) * F.sin(F.lit(2.0 * j) * xi) * F.cosh(F.lit(2.0 * j) * eta)
        eta1 = eta1 - F.lit(b) * F.cos(F.lit(2.0 * j) * xi) * F.sinh(F.lit(2.0 * j) * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi
    for j, d in enumerate(DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(F.lit(2.0 * j) * chi)
    lam = F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(phi), _meridian(zone) + F.degrees(lam)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2.0
    dlon = F.radians(lon2 - lon1) / 2.0
    h = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(
        dlon
    ) * F.sin(dlon)
    return F.lit(2.0 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from point 1 to point 2, 0-360 clockwise from north."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0-180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.when(d > 180.0, F.lit(360.0) - d).otherwise(d)


def flat_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar distance with the longitude scaled at the first point."""
    dy = (lat1 - lat2) * KM_PER_DEGREE
    dx = (lon1 - lon2) * KM_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lat.between(south, north) & lon.between(west, east)


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Strict overlap on both axes of (west, south, east, north) boxes."""
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def cell(value: Column, side: float) -> Column:
    return F.floor(value / F.lit(float(side))).cast("long")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def circle_radius_km(area_ha: Column) -> Column:
    return F.sqrt(area_ha * 1e4 / math.pi) / 1000.0


def web_tile(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator tile column and row at a zoom level."""
    n = float(2**zoom)
    phi = F.radians(lat)
    col = F.floor((lon + 180.0) / 360.0 * n).cast("long")
    row = F.floor((F.lit(1.0) - F.ln(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi) / 2.0 * n)
    return col, row.cast("long")
