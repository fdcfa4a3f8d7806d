"""Estimated perimeters: buffered convex hull per fire.

Hulls combine: the hull of partial hulls is the hull of the whole. Each Arrow batch
is reduced to the few corner points of its fires before anything is shuffled, and
then once more per salted share, so no task ever receives a large fire whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import geo

SHARES = 256
QUARTER_STEPS = 16
_PARTIAL = "fire_id string, zone int, x double, y double, n long"
_RESULT = (
    "fire_id string, zone int, n long, hull_area_ha double,"
    " rings array<array<struct<x:double,y:double>>>"
)


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise corners of the distinct ``points``, collinear ones dropped."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def chain(rows) -> list:
        out: list = []
        for p in rows:
            while len(out) >= 2:
                (ax, ay), (bx, by) = out[-2], out[-1]
                if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) > 0:
                    break
                out.pop()
            out.append((p[0], p[1]))
        return out

    lower, upper = chain(pts), chain(pts[::-1])
    return np.array(lower[:-1] + upper[:-1])


def _corners(frame: pd.DataFrame) -> pd.DataFrame:
    """Corner points of every fire in the batch; the first one carries the row count."""
    ordered = frame.sort_values(["fire_id", "zone"], kind="stable")
    fire, zone = ordered["fire_id"].to_numpy(), ordered["zone"].to_numpy()
    xy, n = ordered[["x", "y"]].to_numpy(), ordered["n"].to_numpy()
    starts = np.flatnonzero(np.r_[True, (fire[1:] != fire[:-1]) | (zone[1:] != zone[:-1])])
    ends = np.r_[starts[1:], len(ordered)]
    hulls = [convex_hull(xy[i:j]) for i, j in zip(starts, ends)]
    sizes = [len(h) for h in hulls]
    counts = np.zeros(sum(sizes), dtype="int64")
    counts[np.r_[0, np.cumsum(sizes)[:-1]].astype(int)] = np.add.reduceat(n, starts)
    corners = np.vstack(hulls)
    return pd.DataFrame(
        {"fire_id": np.repeat(fire[starts], sizes), "zone": np.repeat(zone[starts], sizes),
         "x": corners[:, 0], "y": corners[:, 1], "n": counts}
    )


def _reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        if len(frame):
            yield _corners(frame)


def buffered_area_m2(hull: np.ndarray, n: int, r: float) -> float:
    """Area of the hull grown by ``r``.

    Below three detections the shape is the union of their discs; from three on it is
    the hull itself, which may be a segment or a point.
    """
    if len(hull) == 1:
        return math.pi * r * r
    if len(hull) == 2:
        d = float(np.hypot(*(hull[1] - hull[0])))
        if n >= 3:
            return 2.0 * r * d + math.pi * r * r
        if d >= 2.0 * r:
            return 2.0 * math.pi * r * r
        lens = 2.0 * r * r * math.acos(d / (2.0 * r)) - d / 2.0 * math.sqrt(4.0 * r * r - d * d)
        return 2.0 * math.pi * r * r - lens
    nxt = np.roll(hull, -1, axis=0)
    area = 0.5 * float(np.sum(hull[:, 0] * nxt[:, 1] - hull[:, 1] * nxt[:, 0]))
    return area + float(np.sum(np.hypot(*(nxt - hull).T))) * r + math.pi * r * r


def _disc(centre: np.ndarray, r: float) -> np.ndarray:
    angles = np.arange(4 * QUARTER_STEPS) * (math.pi / 2.0 / QUARTER_STEPS)
    return centre + np.column_stack([np.cos(angles), np.sin(angles)]) * r


def _closed(outline: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in np.vstack([outline, outline[:1]])]


def _outline(hull: np.ndarray, r: float) -> np.ndarray:
    """Corners of hull plus disc: between two edge normals both shapes have one extreme point."""
    disc = _disc(np.zeros(2), r)
    edge = np.roll(hull, -1, axis=0) - hull if len(hull) > 1 else np.empty((0, 2))
    step = math.pi / 2.0 / QUARTER_STEPS
    normals = np.r_[np.arctan2(-edge[:, 0], edge[:, 1]), (np.arange(len(disc)) + 0.5) * step]
    normals = np.sort(np.mod(normals, 2.0 * math.pi))
    middle = (normals + np.r_[normals[1:], normals[0] + 2.0 * math.pi]) / 2.0
    towards = np.column_stack([np.cos(middle), np.sin(middle)])
    return hull[np.argmax(towards @ hull.T, axis=1)] + disc[np.argmax(towards @ disc.T, axis=1)]


def buffered_rings(hull: np.ndarray, n: int, r: float) -> list[list[dict]]:
    """Outline of the shape measured by ``buffered_area_m2``."""
    if len(hull) == 2 and n < 3:
        one, two = _disc(hull[0], r), _disc(hull[1], r)
        if np.hypot(*(hull[1] - hull[0])) >= 2.0 * r:
            return [_closed(one), _closed(two)]
        outer = np.vstack(
            [one[np.hypot(*(one - hull[1]).T) >= r], two[np.hypot(*(two - hull[0]).T) >= r]]
        )
        spoke = outer - hull.mean(axis=0)
        return [_closed(outer[np.argsort(np.arctan2(spoke[:, 1], spoke[:, 0]))])]
    return [_closed(_outline(hull, r))]


def _finish(frame: pd.DataFrame) -> pd.DataFrame:
    hull = convex_hull(frame[["x", "y"]].to_numpy())
    n = int(frame["n"].sum())
    area = buffered_area_m2(hull, n, C.HULL_BUFFER_M) / 1e4
    return pd.DataFrame(
        {
            "fire_id": [frame["fire_id"].iloc[0]], "zone": [frame["zone"].iloc[0]], "n": [n],
            "hull_area_ha": [round(area, 1)], "rings": [buffered_rings(hull, n, C.HULL_BUFFER_M)],
        }
    )


def build_perimeters(hotspots: DataFrame) -> DataFrame:
    """``(fire_id, hull_area_ha, is_estimate, rings)``, rings in degrees."""
    placed = hotspots.select(
        "fire_id", "latitude", "longitude", geo.zone_of_area(F.col("area_key")).alias("zone")
    )
    metres = geo.with_utm(placed, "latitude", "longitude", F.col("zone")).select(
        "fire_id", "zone", "x", "y", F.lit(1).cast("long").alias("n")
    )
    partial = metres.mapInPandas(_reduce_batches, _PARTIAL)
    share = F.pmod(F.xxhash64("x", "y"), F.lit(SHARES))
    # Few bytes but much Python work: an explicit count keeps adaptive execution from
    # coalescing these shuffles into a single task.
    width = int(hotspots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = partial.repartition(width, "fire_id", "zone", share).mapInPandas(_reduce_batches, _PARTIAL)
    shared = shared.repartition(width, "fire_id", "zone")
    done = shared.groupBy("fire_id", "zone").applyInPandas(_finish, _RESULT)

    def degrees(p):
        lat, lon = geo.utm_to_degrees(p["x"], p["y"], F.col("zone"))
        return F.struct(lon.alias("x"), lat.alias("y"))

    return done.select(
        "fire_id", "hull_area_ha", F.lit(True).alias("is_estimate"),
        F.transform("rings", lambda ring: F.transform(ring, degrees)).alias("rings"),
    )
