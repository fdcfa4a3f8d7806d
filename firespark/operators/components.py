"""Connected components by random local contraction.

Each round every vertex joins the lowest-ranked vertex of its own neighbourhood
and the graph is rewritten on the surviving vertices. The edge list shrinks by a
constant factor per round whatever the shape of the component, so a chain of a
million cells needs a few dozen rounds, not a million. Round maps are composed
backwards, from the smallest graph to the largest: the join key is always a
one-round neighbourhood and never the final label, which may be very hot. Once no more
than ``FINISH`` edges are left, counted, they are solved in one task: a round of jobs for
so small a graph costs more than all of its work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firespark.session import materialise, stored

#: Edges that one task may hold, about 100 MB with long string ids.
FINISH = 300_000


def connected_components(edges: DataFrame, finish: int = FINISH, forest: bool = False) -> DataFrame:
    """``edges(a, b)`` to ``(id, component)`` for every vertex with an edge.

    Edges of a ``forest`` hardly repeat: they are not made distinct before the first round.
    """
    ends = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = stored(ends, "edges") if forest else materialise(ends.distinct())
    # Only the rewritten edges are stored: a round's map is one cheap aggregate over
    # them and is worked out again when the maps are composed.
    maps: list[DataFrame] = []
    while True:
        left = current.count()
        if left <= finish:
            break
        step = _contraction(current, len(maps))
        maps.append(step)
        current = materialise(_rewrite(current, step))
    if left:
        kind = current.schema["a"].dataType.simpleString()
        maps.append(materialise(current.coalesce(1).mapInArrow(_solved, f"id {kind}, component {kind}")))
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")

    result = maps[-1]
    for earlier in reversed(maps[:-1]):
        later = result.select(F.col("id").alias("target"), F.col("component").alias("_final"))
        result = (
            earlier.withColumnRenamed("component", "target")
            .join(later, "target", "left")
            .select("id", F.coalesce("_final", "target").alias("component"))
        )
    return result


def _contraction(edges: DataFrame, seed: int) -> DataFrame:
    def ranked(column: str):
        return F.struct(F.xxhash64(F.lit(seed), F.col(column)).alias("r"), F.col(column).alias("v"))

    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        both.groupBy(F.col("a").alias("id"))
        .agg(F.min(ranked("b")).alias("best"))
        .select("id", F.least(F.col("best"), ranked("id"))["v"].alias("component"))
    )


def _rewrite(edges: DataFrame, step: DataFrame) -> DataFrame:
    left = step.select(F.col("id").alias("a"), F.col("component").alias("_a"))
    right = step.select(F.col("id").alias("b"), F.col("component").alias("_b"))
    return (
        edges.join(left, "a")
        .join(right, "b")
        .where("_a <> _b")
        .select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        .distinct()
    )


def least_labels(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of the component of each of ``size`` numbered vertices, by their edges."""
    label = np.arange(size)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        # The least label goes to both ends and to what they stand for, then along the chains.
        for end in (a, b):
            np.minimum.at(label, before[end], low)
            np.minimum.at(label, end, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of one small graph to each vertex with the first vertex of its component."""
    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    table = pa.Table.from_batches(tables)
    both = pa.chunked_array(table.column("a").chunks + table.column("b").chunks)
    flat, ids = pd.factorize(both.to_pandas())
    a, b = flat[: table.num_rows], flat[table.num_rows :]
    label = least_labels(len(ids), a, b)
    kind = both.type
    yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(ids[label], kind)], names=["id", "component"])
