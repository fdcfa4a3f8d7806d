"""Vector classes against the full matrix of cosines."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.llm import embeddings


def slow(rows, cosine=0.9):
    fine = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    near = {i: set() for i in range(len(rows))}
    for i in fine:
        for j in fine:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.asarray(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                    near[i].add(j)
                    near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, stack = {i}, [i]
        while stack:
            stack += (fresh := near[stack.pop()] - seen)
            seen |= fresh
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        out.append((rows[i][0], len(near[i]), min(ids, default=None)))
    return out


@pytest.mark.parametrize("chunk", [16_384, 20])
def test_matches_brute_force(spark, chunk):
    rng = np.random.default_rng(chunk)
    centres = rng.normal(size=(8, 24))
    rows = []
    for i in range(160):
        v = centres[i % 8] + rng.normal(size=24) * rng.choice([0.02, 0.3, 0.45, 2.0])
        rows.append((i, [float(np.float32(c)) for c in v * rng.choice([1e-3, 1.0, 50.0])]))
    rows += [(200 + i, rows[3][1]) for i in range(12)] + [(3, rows[3][1]), (None, rows[4][1]), (300, None), (301, [0.0] * 24), (302, [1.0, None]),
             (303, [float("nan")] + [1.0] * 23), (304, [float("inf")] + [1.0] * 23), (305, []), (306, [1.0, 0.5]), (307, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    frame = frame.withColumn("cell", F.lit(0)).withColumn("vector", F.lit("clash"))
    got = embeddings.vector_classes(frame, chunk=chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)
    assert sorted(((r.id, r.n_links, r.component_id) for r in got), key=key) == sorted(slow(rows), key=key)


def test_empty_table(spark):
    assert embeddings.vector_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
