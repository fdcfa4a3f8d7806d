"""The nearest-site join against all pairs, and how many sites it compares."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.operators import quadtree as Q
from firespark.operators.grids import PLANE, SPHERE


def frames(spark, probes, sites, axes):
    ddl = ", ".join(f"{a} double" for a in axes)
    named = lambda rows: [(i, 30, *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(named(probes), f"id long, _zone int, {ddl}"), spark.createDataFrame(named(sites), f"site long, _zone int, {ddl}")


def slow(probes, sites, radius):
    out = {}
    for i, p in enumerate(np.asarray(probes, float)):
        gaps = np.sqrt(((np.asarray(sites, float) - p) ** 2).sum(axis=1))
        best = min(((round(g, 3), s) for s, g in enumerate(gaps) if g <= radius), default=None)
        if best:
            out[i] = best[1]
    return out


@pytest.mark.parametrize(("axes", "leaf"), [(PLANE, 1), (PLANE, 64), (SPHERE, 4)])
def test_nearest_is_that_of_all_pairs(spark, axes, leaf):
    rng = np.random.default_rng(leaf)
    size = 4e5 if axes == PLANE else 6371
    spots = [rng.uniform(-size, size, (30, len(axes))), rng.normal(size / 3, size / 1e4, (300, len(axes))), np.zeros((3, len(axes)))]
    sites = np.concatenate(spots).round(1)
    probes = np.concatenate([rng.uniform(-size, size, (60, len(axes))), rng.normal(size / 3, size / 1e3, (60, len(axes))), sites[:5]])
    left, right = frames(spark, probes, sites, axes)
    for radius in (size / 20, size * 4):
        got = {r.id: r.site for r in Q.nearest(left, right, "id", ["site"], radius, axes, leaf).collect()}
        assert got == slow(probes, sites, radius)


def test_a_crowd_of_sites_and_far_probes_meet_few(spark):
    """10^5 distinct sites within 2 km, probes among them and far away: candidates stay near a leaf or two."""
    sites = spark.range(100_000).select(
        F.col("id").alias("site"), F.lit(30).alias("_zone"), (F.lit(4e5) + (F.col("id") % 400) * 5).alias("_x"),
        (F.lit(4.4e6) + F.floor(F.col("id") / 400) * 8).cast("double").alias("_y"),
    )
    rng = random.Random(1)
    inside = [(i, 30, 4e5 + rng.uniform(0, 2000), 4.4e6 + rng.uniform(0, 2000)) for i in range(200)]
    far = [(200 + i, 30, rng.uniform(-2e6, 3e6), rng.uniform(2e6, 7e6)) for i in range(200)]
    probes = spark.createDataFrame(inside + far, "id long, _zone int, _x double, _y double")
    cells = Q.tree(sites)
    assert cells.where("_leaf").agg(F.max("_n")).first()[0] <= Q.LEAF_SITES
    met = Q.candidate_leaves(probes, cells, "id", 1e7).groupBy("id").agg(F.sum("_n").alias("n"))
    by = met.select((F.col("id") < 200).alias("inside"), "n").groupBy("inside").agg(F.avg("n").alias("mean"), F.max("n").alias("most"))
    told = {r.inside: r for r in by.collect()}
    assert told[True].most <= 600 and told[False].mean <= 2_000 and told[False].most <= 10_000


def test_nothing_to_meet(spark):
    left, right = frames(spark, [(0, 0)], [(1, 1)], PLANE)
    assert Q.nearest(left, right.where("false"), "id", ["site"], 10.0).count() == 0
    assert Q.nearest(left.where("false"), right, "id", ["site"], 10.0).count() == 0
    assert Q.nearest(left.withColumn("_x", F.lit(None).cast("double")), right, "id", ["site"], 10.0).count() == 0
    assert Q.nearest(left, right.withColumn("_zone", F.lit(28)), "id", ["site"], 10.0).count() == 0
