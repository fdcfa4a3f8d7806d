"""Containment in cells against a ray over all edges, and polygons of very many edges."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from firespark.operators import polygons as P


def ray(lat, lon, rings):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, x, y, size, n):
    points = [(x + size * rng.uniform(0.3, 1) * math.cos(t * 2 * math.pi / n), y + size * rng.uniform(0.3, 1) * math.sin(t * 2 * math.pi / n)) for t in range(n)]
    return points + points[:1]


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def frame(spark, layer):
    rows = [(i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for i, rings in enumerate(layer)]
    return spark.createDataFrame(rows, "name long, rings array<array<struct<x: double, y: double>>>")


@pytest.mark.parametrize("limit", [3, 64])
def test_cells_say_what_a_ray_over_all_edges_says(spark, limit):
    rng = random.Random(limit)
    layer = [[star(rng, rng.uniform(-3, 3), rng.uniform(38, 42), rng.uniform(0.01, 2.5), rng.choice([3, 5, 40, 200]))] for _ in range(12)]
    layer += [[box(-1.0, 40.0, 1.0, 0.5)], [box(-2.0, 39.0, 2.5, 2.25), box(-1.5, 39.25, 0.5, 0.5)], [box(0.1, 40.1, 0.01, 0.01), box(2.0, 41.0, 0.3, 0.3)], []]
    layer.append(layer[12])
    points = [(rng.uniform(37, 43), rng.uniform(-5, 5)) for _ in range(300)]
    points += [(y + rng.uniform(-0.02, 0.02), x + rng.uniform(-0.02, 0.02)) for rings in layer for ring in rings for x, y in ring[:20]]
    # On lines of the grid, and on edges and corners of boxes that lie on it.
    points += [(40.0 + i * 0.125, -1.0 + j * 0.125) for i in range(-2, 7) for j in range(-2, 11)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "id long, latitude double, longitude double")
    got = {(r.id, r.name) for r in P.covering(rows, frame(spark, layer), ["name"], cell_edges=limit).select("id", "name").collect()}
    assert got == {(i, n) for i, (lat, lon) in enumerate(points) for n, rings in enumerate(layer) if ray(lat, lon, rings)}


def test_a_million_edges_leave_small_cells(spark):
    """A coast line of 10^6 vertices: no cell above the deepest level holds more than its share of edges."""
    n = 1_000_000
    vertex = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct(
        (F.lit(-3.0) + (F.lit(0.6) + 0.05 * F.sin(i % n * (80 * math.pi / n)) + 0.0005 * F.sin(i % n * (18002 * math.pi / n))) * F.cos(i % n * (2 * math.pi / n))).alias("x"),
        (F.lit(40.0) + (F.lit(0.6) + 0.05 * F.sin(i % n * (80 * math.pi / n)) + 0.0005 * F.sin(i % n * (18002 * math.pi / n))) * F.sin(i % n * (2 * math.pi / n))).alias("y"),
    ))
    layer = spark.range(1).select(F.lit(1).alias("name"), F.array(vertex).alias("rings"))
    cells, deepest = P.cut(layer, ["name"])
    sizes = cells.groupBy("_level").agg(F.max(F.size("_edges")).alias("most"), F.count_if(F.size("_edges") == 0).alias("inner")).collect()
    assert deepest >= 3 and all(s.most <= P.CELL_EDGES for s in sizes if s._level < P.DEEPEST) and sum(s.inner for s in sizes) > 100
    points = spark.createDataFrame([(40.0, -3.0), (40.54, -3.0), (40.7, -3.0), (40.0, -3.66), (40.0, -2.5)], "latitude double, longitude double")
    found = {(q.latitude, q.longitude) for q in P.covering(points, layer, ["name"]).collect()}

    def inside(lat, lon):
        a = math.atan2(lat - 40, lon + 3) % (2 * math.pi)
        return math.hypot(lat - 40, lon + 3) < 0.6 + 0.05 * math.sin(a * 40) + 0.0005 * math.sin(a * 9001)

    assert found == {(p.latitude, p.longitude) for p in points.collect() if inside(p.latitude, p.longitude)}
