"""Targets, cuts and the splitting tree of a mixture."""

from __future__ import annotations

import random
from math import comb

import pytest
from pyspark.sql import functions as F

from firespark.llm import mixing


def slow_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    words, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rest = words - sum(target.values())
        now = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if now[s] > most * sizes[s]}
        if not over:
            return target | now
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = []
    for i in range(400):
        source = rng.choice(["a", "a", "a", "B", "é", "zz", None, "tiny"]) if i else "tiny"
        out.append((i, " ".join("w" for _ in range(rng.randrange(1, 60))), source))
    return out + [(500, None, "a"), (501, " \t\n", "B"), (None, "no id here", "a"), (502, "twice", "a"), (502, "twice", "a"), (503, "x", "only")]


def test_targets_and_takes(make_docs, rows):
    docs = make_docs(rows).withColumn("g", F.lit("clash")).withColumn("mix_shard", F.lit(-1))
    mix = mixing.Mix(docs)
    got = mix.taken().collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    target = slow_targets(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {sizes[source]} and own[0].target == pytest.approx(target[source])
        assert abs(sum(r.taken for r in own) - target[source]) <= 30
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)
    again = mixing.Mix(docs.repartition(5)).taken().collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_shards_hold_the_takes(make_docs, rows):
    docs = make_docs(rows)
    mix = mixing.Mix(docs)
    placed = mix.documents(words_per_shard=2_000).collect()
    copies = {}
    for r in placed:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    for r in mix.taken().collect():
        if r.id is not None and r.id != 502 and r.size:
            assert copies.get(r.id, 0) * r.size == r.taken
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r.mix_shard, []).append(r.mix_order)
    assert set(by_shard) <= set(range(16)) and len(by_shard) > 8 and all(v == sorted(v) for v in by_shard.values())


@pytest.mark.parametrize(("n", "k", "m"), [(40, 15, 20), (10, 10, 4), (9, 1, 5), (1, 1, 1), (30, 4, 30)])
def test_draw_follows_the_hypergeometric_law(spark, n, k, m):
    big = 4000
    long = lambda v: F.lit(v).cast("long")
    drawn = spark.range(big).select(mixing._draw(long(n), long(k), long(m), (F.col("id") + 0.5) / big).alias("x"))
    for r in drawn.groupBy("x").count().collect():
        assert r["count"] / big == pytest.approx(comb(k, r.x) * comb(n - k, m - r.x) / comb(n, m), abs=2 / big)


def test_quotas_are_split_exactly(spark):
    quotas = spark.createDataFrame([("a", 1000), ("b", 3), ("c", 0), ("d", 77)], "g string, n long")
    got = mixing.split_quotas(quotas, 3).collect()
    assert {g: sum(r.n for r in got if r.g == g) for g in "abcd"} == {"a": 1000, "b": 3, "c": 0, "d": 77}
    totals = [sum(r.n for r in got if r.shard == s) for s in range(8)]
    assert sum(totals) == 1080 and max(totals) - min(totals) <= 3


def test_empty_table(make_docs):
    mix = mixing.Mix(make_docs([]))
    assert mix.taken().count() == 0 and mix.documents().count() == 0
