"""Clustering against brute force, and the rules that must survive any refactor."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.operators import cluster, components
from firespark.operators.components import connected_components


def brute_labels(points: np.ndarray, eps: float, k: int) -> list[int]:
    """Textbook density clustering over all pairs; border points get the smallest cluster."""
    near = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)) <= eps + 1e-6
    core = near.sum(1) >= k
    label = np.full(len(points), -1)
    for start in np.flatnonzero(core):
        if label[start] >= 0:
            continue
        stack, label[start] = [start], start
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core):
                if label[j] < 0:
                    label[j] = start
                    stack.append(j)
    return [int(l) for l in label], core


def frame(spark, points, area="peninsula"):
    rows = [(i, area, float(x), float(y), float(t)) for i, (x, y, t) in enumerate(points)]
    return spark.createDataFrame(rows, "i int, area_key string, x double, y double, t double")


def partition(labels: dict) -> set:
    groups: dict = {}
    for i, l in labels.items():
        if l not in (None, -1):
            groups.setdefault(l, set()).add(i)
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize("direct_pairs", [1024, 4])
def test_matches_brute_force(spark, direct_pairs):
    rng = np.random.default_rng(7)
    centres = rng.uniform(0, 30_000, (8, 3))
    points = np.vstack([c + rng.normal(0, 900, (25, 3)) for c in centres] + [rng.uniform(0, 30_000, (30, 3))])
    want, _ = brute_labels(points, 1500.0, 1)
    got = cluster.label_points(frame(spark, points), direct_pairs=direct_pairs).collect()
    assert partition({r.i: r.label for r in got}) == partition(dict(enumerate(want)))


def test_min_samples_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    points = np.vstack([rng.normal(c, 700, (20, 3)) for c in (0, 9_000, 16_000)] + [rng.uniform(-5e3, 2e4, (25, 3))])
    want, core = brute_labels(points, 1500.0, 5)
    rows = {r.i: r.label for r in cluster.label_points(frame(spark, points), min_samples=5).collect()}
    only_core = {i for i in range(len(points)) if core[i]}
    assert partition({i: l for i, l in rows.items() if i in only_core}) == partition(
        {i: want[i] for i in only_core}
    )
    near = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1)) <= 1500.0 + 1e-6
    for i in set(range(len(points))) - only_core:
        touched = {rows[j] for j in np.flatnonzero(near[i]) if j in only_core}
        assert rows[i] == (min(touched) if touched else None)


def test_hot_cube_of_copies_is_one_cluster(spark):
    points = [(0.0, 0.0, 0.0)] * 500 + [(10.0, 0.0, 0.0)] * 3 + [(9_000.0, 0.0, 0.0)]
    got = cluster.label_points(frame(spark, points)).groupBy("label").count().collect()
    assert sorted(r["count"] for r in got) == [1, 503]


def test_exactly_eps_apart_is_connected_and_beyond_is_not(spark):
    points = [(0.0, 0.0, 0.0), (1500.0, 0.0, 0.0), (3000.5, 0.0, 0.0)]
    rows = {r.i: r.label for r in cluster.label_points(frame(spark, points)).collect()}
    assert rows[0] == rows[1] != rows[2]


def test_areas_are_independent(spark):
    both = frame(spark, [(0, 0, 0)]).unionByName(frame(spark, [(0, 0, 0)], "canarias"))
    assert cluster.label_points(both).select("label").distinct().count() == 2


def test_long_chain_is_one_component(spark):
    edges = spark.range(400).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"))
    out = connected_components(edges)
    assert out.count() == 401 and out.select("component").distinct().count() == 1


def test_two_passes_one_fire_and_id_ignores_order(spark):
    rows = [
        (40.0, -4.0, "2024-01-01 01:00:00"), (40.002, -4.002, "2024-01-01 13:00:00"),
        (40.05, -4.0, "2024-01-01 01:00:00"), (40.0, -4.0, "2024-01-05 01:00:00"),
    ]
    make = lambda data: spark.createDataFrame(data, "latitude double, longitude double, s string").select(
        "latitude", "longitude", F.col("s").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key")
    )
    got = {tuple(r) for r in cluster.assign_fire_ids(make(rows)).select("latitude", "acq_dt", "fire_id").collect()}
    again = {tuple(r) for r in cluster.assign_fire_ids(make(rows[::-1])).select("latitude", "acq_dt", "fire_id").collect()}
    assert got == again
    ids = sorted(got, key=lambda r: (r[1], r[0]))
    assert len({r[2] for r in got}) == 3
    assert ids[0][2] == next(r[2] for r in ids if r[0] == 40.002)


@pytest.mark.parametrize("finish", [0, 40, 300_000])
def test_components_of_random_graphs_on_either_path(spark, finish):
    rng = random.Random(finish)
    pairs = [(f"v{rng.randrange(200)}", f"v{rng.randrange(200)}") for _ in range(150)] + [(f"hub{i % 2}", f"leaf{i}") for i in range(120)]
    found = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a string, b string"), finish).collect()}
    parent = {v: v for p in pairs for v in p if p[0] != p[1]}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        if a != b:
            parent[top(a)] = top(b)
    assert set(found) == set(parent)
    named = {}
    assert all(named.setdefault(found[v], top(v)) == top(v) for v in parent) and len(named) == len({top(v) for v in parent})
    numbers = connected_components(spark.createDataFrame([(1, 2), (2, 3), (8, 9), (5, 5)], "a long, b long"), finish).collect()
    assert len({r.component for r in numbers}) == 2 and {r.id for r in numbers} == {1, 2, 3, 8, 9}


def test_a_fire_with_a_third_of_all_detections_is_no_join_key(spark):
    """The plan joins detections by cube alone, and the cubes of one fire stand under many salts."""
    rows = [(i, 40.0 + (i % 60) * 0.004, -3.0 + (i // 60) * 0.004, "2024-01-01 00:00:00") for i in range(1200)]
    rows += [(2000 + i, 41.5 + (i % 40) * 0.05, -8.0 + (i // 40) * 0.05, "2024-01-01 00:00:00") for i in range(2000)]
    points = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, t string").select(
        "event_id", "latitude", "longitude", F.col("t").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key")
    )
    out = cluster.assign_fire_ids(points)
    sizes = {r.fire_id: r["count"] for r in out.groupBy("fire_id").count().collect()}
    assert sum(sizes.values()) == len(rows) and max(sizes.values()) == 1200
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and "cell" in joins[0] and "label" not in joins[0]


def test_links_made_in_blocks_connect_what_the_edges_connect_and_are_few(spark):
    """Cubes of several blocks, on both sides of zero, with copies, a second area and rows without a place."""
    rng = np.random.default_rng(3)
    side, eps = cluster.C.EPS_M / np.sqrt(3.0), cluster.C.EPS_M
    points = np.vstack([rng.uniform((-20_000, -2_000, -2_000), (20_000, 2_000, 2_000), (2500, 3)), rng.uniform(1e5, 1.1e5, (40, 3)), [(0.0, 0.0, 0.0)] * 50])
    rows = [("peninsula" if i % 4 else "canarias", *map(float, p)) for i, p in enumerate(points)] + [(None, 0.0, 0.0, 0.0), ("peninsula", None, None, 0.0)]
    base = cluster._with_cells(spark.createDataFrame(rows, "area_key string, x double, y double, t double"), side).localCheckpoint()
    cells = base.groupBy(*cluster.CUBE).agg(F.count("*").alias("n"), *cluster._bounds(), *cluster._witnesses())
    for direct_pairs in (1024, 4):
        links = cluster._cell_links(cells, base, side, eps, direct_pairs).distinct().localCheckpoint()
        edges = cluster._cell_edges(base.distinct(), side, eps, direct_pairs).distinct().localCheckpoint()
        labels = [{r.id: r.component for r in connected_components(e).collect()} for e in (links, edges)]
        assert partition(labels[0]) == partition(labels[1]) and len(partition(labels[0])) > 1
        assert 2 * links.count() < edges.count()


def test_a_fire_across_blocks_and_chunks_is_one(spark, monkeypatch):
    """A line of cubes longer than a block, taken a few rows at a time, with a gap that only its points bridge."""
    monkeypatch.setattr(cluster, "BLOCK_ROWS", 7)
    rows = [(i, "peninsula", -20_000.0 + 800.0 * i, 0.0, 0.0) for i in range(60)] + [(100, "peninsula", 40_000.0, 0.0, 0.0)]
    rows += [(200 + i, "peninsula", -5_000.0 + 1.0 * i, 30_000.0, 0.0) for i in range(40)]
    labels = {r.i: r.label for r in cluster.label_points(spark.createDataFrame(rows, "i int, area_key string, x double, y double, t double")).collect()}
    assert partition(labels) == {frozenset(range(60)), frozenset({100}), frozenset(range(200, 240))}


def test_a_forest_is_searched_as_it_comes_and_a_round_tells_a_vertex_once(spark, monkeypatch):
    kept = []
    real = components.stored
    monkeypatch.setattr(components, "stored", lambda df, name: kept.append(df) or real(df, name))
    pairs = [(f"v{i // 2}", f"v{i}") for i in range(1, 400)] + [("v3", "v1")] * 5 + [(f"w{i}", f"w{i + 1}") for i in range(0, 50, 2)]
    edges = spark.createDataFrame(pairs, "a string, b string")
    for finish in (10, 1_000):
        found = connected_components(edges, finish, forest=True).groupBy("component").count().collect()
        assert sorted(r["count"] for r in found) == [2] * 25 + [400]
    plans = [df._jdf.queryExecution().sparkPlan().toString() for df in (*kept, components._contraction(edges, 0))]
    assert len(kept) == 2 and not any("Aggregate" in p for p in plans[:2])
    assert "first(" not in plans[2]
