"""Proximity joins on grid cells.

A radius join becomes an equality join: probes keep the cell they stand in, sites
are copied to the cells around theirs, and the exact distance is a residual filter.
Sites standing on the same spot are folded into one before the copy, so a pile of
copies costs one row. Nothing is hinted as broadcast; adaptive execution does so
from measured sizes and splits skewed cells otherwise.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.config import EARTH_RADIUS_KM
from firespark.functions import geo

PLANE = ("_x", "_y")
SPHERE = ("_x", "_y", "_z")
AXES = "xyz"


def collapse_sites(sites: DataFrame, *aggregates: Column, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """One row per exact position."""
    return sites.groupBy("_zone", *axes).agg(*aggregates)


def probe_keys(df: DataFrame, side: float) -> DataFrame:
    return df.withColumns({"_cx": geo.cell(F.col("_x"), side), "_cy": geo.cell(F.col("_y"), side)})


def near_keys(df: DataFrame, side: float, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """Copy each row to its own cell and all those around it."""
    steps = F.array(*[F.lit(v).cast("long") for v in (-1, 0, 1)])
    out = df
    for axis in axes:
        out = out.withColumn("_i", F.explode(steps)).withColumn(
            f"_c{axis[1]}", geo.cell(F.col(axis), side) + F.col("_i")
        )
    return out.drop("_i")


def with_metres(df: DataFrame, lat: str, lon: str, zone: Column | None = None) -> DataFrame:
    """Add ``_zone``, ``_x``, ``_y``; each row uses the UTM zone of its own longitude."""
    zoned = df.withColumn("_zone", geo.zone_of_lon(F.col(lon)) if zone is None else zone)
    return geo.with_utm(zoned, lat, lon, F.col("_zone"), "_x", "_y")


def with_sphere(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """Add earth-centred kilometres, so that cells work at any longitude."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon))
    r = F.lit(EARTH_RADIUS_KM)
    return df.withColumns(
        {
            "_zone": F.lit(0),
            "_x": r * F.cos(phi) * F.cos(lam),
            "_y": r * F.cos(phi) * F.sin(lam),
            "_z": r * F.sin(phi),
        }
    )


def chord_km(arc_km: float) -> float:
    return 2.0 * EARTH_RADIUS_KM * math.sin(min(math.pi / 2.0, arc_km / (2.0 * EARTH_RADIUS_KM)))


def straight(axes: tuple[str, ...]) -> Column:
    """Distance between probe and site columns."""
    squares = [(F.col(a) - F.col(f"_s{a[1]}")) * (F.col(a) - F.col(f"_s{a[1]}")) for a in axes]
    return F.sqrt(reduce(lambda p, q: p + q, squares))


def within(probes: DataFrame, sites: DataFrame, radius: float) -> DataFrame:
    """Inner join of metric ``probes`` and ``sites`` at most ``radius`` metres apart.

    Adds ``_gap``. Both sides carry ``_zone, _x, _y``; site columns keep their names.
    """
    copies = near_keys(sites, radius).withColumnsRenamed({"_x": "_sx", "_y": "_sy"})
    return (
        probe_keys(probes, radius)
        .join(copies, ["_zone", "_cx", "_cy"])
        .withColumn("_gap", straight(PLANE))
        .where(F.col("_gap") <= radius)
        .drop("_cx", "_cy", "_sx", "_sy")
    )
