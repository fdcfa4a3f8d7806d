"""Periodic runs against a plain scan of every period."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.llm import queries, runs


def slow(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(p < q and a <= i and i + length <= a + m for a, m, p in out):
                out.append((i, length, q))
            i = max(i, j) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng, size, letters):
    words = []
    while len(words) < size:
        unit = [rng.randrange(letters) for _ in range(rng.randrange(1, 60))]
        words += (unit * 8)[: int(len(unit) * rng.uniform(1, 8))] if rng.random() < 0.5 else unit
    return [b"%d" % w for w in words]


@pytest.mark.parametrize("letters", [1, 2, 3, 50])
def test_every_run_is_found(letters):
    rng = random.Random(letters)
    texts = [made(rng, rng.choice([1, 23, 24, 60, 200, 400]), letters) for _ in range(150)] + [[]]
    exact = [slow(t) for t in texts]
    assert runs.text_runs(texts, at_once=1000) == exact
    assert [runs.text_runs([t])[0] for t in texts[:40]] == exact[:40]


@pytest.mark.parametrize("size", [8, 32, 128])
def test_mismatches_are_exact(size):
    rng = np.random.default_rng(size)
    block, window = (rng.integers(0, 200_000, (3, n)).astype(np.uint64) for n in (size, 2 * size))
    got = runs.mismatches(block, window)
    for row in range(3):
        for d in range(size):
            apart = sum((int(a) - int(b)) ** 2 for a, b in zip(block[row], window[row, d : d + size]))
            assert got[row, d] == apart % runs.MODULUS


def test_a_long_text_of_one_period():
    words = [b"%d" % (i % 40_000) for i in range(130_000)]
    assert runs.text_runs([words]) == [[(0, 130_000, 40_000)]]
    assert runs.text_runs([[b"a"] * 50_000]) == [[(0, 50_000, 1)]]


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_is_the_plain_scan(spark, make_docs, tmp_path):
    rng = random.Random(6)
    rows = [(i, b" ".join(made(rng, rng.choice([0, 5, 40, 120]), rng.choice([2, 400]))).decode()) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \t\n"), (503, "é " * 30), (503, "é " * 30), (None, "x y z " * 20)]
    make_docs(rows).withColumn("words", F.lit("clash")).withColumn("n", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op12_runs(spark, str(tmp_path)).collect()]
    exact = []
    for doc_id, text in rows:
        words = planted(doc_id, text)
        found = slow(words)
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        digests = ["".join(f"{s},{length},{q}\n" for s, length, q in found).encode(), b" ".join(w for i, w in enumerate(words) if i not in gone)]
        milli = 1000 * best[1] // best[2] if found else None
        exact.append((doc_id, len(found), *best, milli, *[hashlib.sha256(d).hexdigest() for d in digests]))
    assert sorted(got, key=str) == sorted(exact, key=str) and sum(r[1] for r in exact) > 30


def test_empty_table(make_docs):
    docs = runs.with_repeated_tail(make_docs([]))
    assert docs.select(runs.periodic_runs(F.col("text"))).count() == 0
