"""Repeated passages against a plain dictionary of all 50-byte strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.llm import repeats


def slow(rows):
    """(bytes, removed, runs, digest) per row; a null id comes last, equal ids don't count as smaller."""
    place = lambda i: float("inf") if i is None else i
    first: dict = {}
    data = [(place(i), (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_matches_brute_force(make_docs, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(a) for _ in range(n)) for a, n in (("ab", 300), ("abcdefgh é", 500), ("a", 200), ("xyz漢", 120))]
    rows = []
    for d in rng.sample(range(1000), 60):
        text = ""
        for _ in range(rng.randrange(4)):
            s = rng.choice(base)
            i, j = sorted(rng.sample(range(len(s)), 2))
            text += s[i:j] + "".join(rng.choice("pqr") for _ in range(rng.randrange(20)))
        rows.append((d, text))
    rows += [(rows[0][0], rows[1][1]), (rows[2][0], rows[2][1]), (None, rows[3][1]), (None, base[1]), (2000, None), (2001, "")]
    docs = make_docs(rows).withColumn("n_bytes", F.lit(0)).withColumn("at", F.lit(0))
    got = repeats.remove_repeats(docs).collect()
    expected = sorted(((i, t or ""), r) for (i, t), r in zip([((-1 if i is None else i), t) for i, t in rows], slow(rows)))
    found = sorted(((-1 if r.id is None else r.id, r.text or ""), (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got)
    assert found == expected


def test_empty_table_and_lone_document(make_docs):
    assert repeats.remove_repeats(make_docs([])).count() == 0
    row = repeats.remove_repeats(make_docs([(1, "ab" * 100)])).head()
    assert (row.n_removed, row.kept) == (0, "ab" * 100)


def test_a_shared_line_in_every_document(make_docs):
    rows = [(i, f"{i} begins " + "the line that all of the documents share with one another, " + f"and ends {i}") for i in range(300)]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(make_docs(rows)).collect()}
    assert [got[i] for i, _ in rows] == slow(rows)


@pytest.mark.parametrize("kind", ["string", "date", "bigint"])
def test_ids_of_other_types_and_the_largest_number(spark, make_docs, kind):
    rng = random.Random(4)
    shared = "".join(rng.choice("abcdefgh é") for _ in range(90))
    texts = [shared + "1", "before " + shared, shared * 2, None, "".join(rng.choice("xyz") for _ in range(120))]
    number = {"string": ["b", "a", "c", "aa", "d"], "date": [f"2024-01-0{i}" for i in (4, 2, 9, 1, 3)], "bigint": [str(2**63 - 1), "5", "7", "1", "2"]}[kind]
    rows = [*zip(number, texts), (None, shared + " no id")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(kind))
    order = {n: i for i, n in enumerate(sorted(number, key=int) if kind == "bigint" else sorted(number))}
    exact = slow([(None if i is None else order[i], t) for i, t in rows])
    got = {None if r.id is None else str(r.id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect()}
    assert got == {i: e for (i, _), e in zip(rows, exact)}
