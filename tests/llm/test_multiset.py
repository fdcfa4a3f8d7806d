"""Multiset fingerprints: sums, updates, likeness, and the neighbours in id order."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from firespark.llm import multiset as M


def sentences(rng, n):
    return [f"{rng.randrange(10**9)} words here." for _ in range(n)]


def prints(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return [r.fp for r in M.with_fingerprint(rows, "text", "fp").orderBy("id").select(M.as_text(F.col("fp")).alias("fp")).collect()]


def slow_print(text):
    dense, located, total = [0] * 6, [0] * 256, 0
    for p in re.findall(r"[^\x09-\x0D\x20.!?][^.!?\x0A]*[.!?]*", text or ""):
        digest = hashlib.sha256(p.encode()).digest()
        w = [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(8)]
        total += 1
        dense = [(a + b) % 2**32 for a, b in zip(dense, w)]
        at = 32 * min(7, 32 - w[6].bit_length()) + w[7] % 32
        located[at] = (located[at] + (w[7] >> 5)) % 256
    return f"{total:08x}" + "".join(f"{v:08x}" for v in dense) + "".join(f"{v:02x}" for v in located)


def test_fingerprints_are_sums_in_any_order(spark):
    rng = random.Random(1)
    some = sentences(rng, 40)
    texts = [" ".join(some), "\n".join(reversed(some)), " ".join(some[:-1]), None, "", " \n\t", "é. é! è?", "one line", "x" * 200_000, "a. a. a."]
    got = prints(spark, texts)
    assert got == [slow_print(t) for t in texts]
    assert got[0] == got[1] != got[2] and got[3] == got[4] == got[5] == "0" * 568


def test_updates_equal_a_new_fingerprint(spark):
    rng = random.Random(2)
    a, b = sentences(rng, 30), sentences(rng, 12)
    rows = spark.createDataFrame([(" ".join(a), " ".join(b), " ".join(a + b))], "a string, b string, both string")
    for name in ("a", "b", "both"):
        rows = M.with_fingerprint(rows, name, f"f{name}")
    f = {n: F.col(f"f{n}") for n in ("a", "b", "both")}
    same = rows.select(
        M.as_text(M.combined(f["a"], f["b"])) == M.as_text(f["both"]), M.as_text(M.combined(f["both"], f["b"], -1)) == M.as_text(f["a"])
    ).first()
    assert all(same)
    parts = spark.createDataFrame([(1, " ".join(a)), (1, " ".join(b)), (2, None)], "g int, t string")
    folded = M.summed(M.with_fingerprint(parts, "t", "fp"), ["g"], "fp", "fp").orderBy("g").select(M.as_text(F.col("fp")).alias("s")).collect()
    assert [r.s for r in folded] == prints(spark, [" ".join(a + b), None])


@pytest.mark.parametrize("size", [20, 200, 3000])
def test_likeness_follows_the_shared_paragraphs(spark, size):
    rng = random.Random(size)
    base = sentences(rng, size)
    shares = [1.0, 0.9, 0.5, 0.0]
    pairs = [(" ".join(base), " ".join(base[: int(size * s)] + sentences(rng, size - int(size * s)))) for s in shares] + [(None, ""), ("a.", None)]
    rows = M.with_fingerprint(M.with_fingerprint(spark.createDataFrame(pairs, "a string, b string"), "a", "fa"), "b", "fb")
    got = [r.x for r in rows.select(M.likeness(F.col("fa"), F.col("fb")).alias("x")).collect()]
    assert got[0] == 1.0 and got[4] == 1.0 and got[5] == 0.0
    assert got[1:4] == pytest.approx(shares[1:], abs=0.3) and got[1] > got[2] > got[3]


@pytest.mark.parametrize("count", [0, 1, 2, 57])
def test_neighbours_go_round_in_descending_order(make_docs, count):
    rng = random.Random(count)
    rows = [(7 * i, " ".join(sentences(rng, rng.randrange(0, 9)))) for i in range(count)]
    docs = make_docs(rows).withColumn("fp", F.lit("clash")).withColumn("bucket", F.lit(0)).withColumn("key", F.lit(0))
    got = {r.id: r for r in M.edit_fingerprints(docs).select("id", "n_chars", "edited", M.as_text(F.col("fp")).alias("fp"), M.as_text(F.col("edited_fp")).alias("e"), "near_edited", "near_next").collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == count
    for (i, text), (_, following) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r = got[i]
        assert (r.n_chars, r.edited, r.fp, r.e) == (len(text), edited, slow_print(text), slow_print(edited))
        assert (r.near_next == 1.0) if text == following else (0 <= r.near_next <= 1)


def test_null_ids_nulls_and_repeated_rows(make_docs):
    rows = [(3, "a. b. c."), (3, "a. b. c."), (3, None), (None, "no id. here."), (None, None), (1, "long. " * 20_000)]
    got = M.edit_fingerprints(make_docs(rows)).collect()
    assert len(got) == len(rows) and sorted(r.n_chars for r in got) == [0, 0, 8, 8, 12, 120_000]
    assert len({str(r.fp) for r in got if r.n_chars == 8}) == 1
