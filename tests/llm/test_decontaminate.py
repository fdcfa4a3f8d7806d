"""Contamination against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from firespark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(text, items, size=13):
    w = words(text)
    hit, found = set(), set()
    for item, body in items:
        x = words(body)
        for s in range(max(1, len(x) - size + 1) if x else 0):
            window = x[s : s + size]
            for p in range(len(w) - len(window) + 1):
                if w[p : p + len(window)] == window:
                    hit |= set(range(p, p + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    pool = ["alpha", "Beta", "é", "x1", "the", "of", "漢字", "zz"]
    items = [(i, " ".join(rng.choices(pool, k=rng.choice([0, 1, 5, 13, 14, 30])))) for i in range(12)]
    items += [(3, "repeated item words here"), (3, "repeated item words here"), (None, "no id but words"), (77, None), (78, "...")]
    docs = []
    for d in range(60):
        parts = [" ".join(rng.choices(pool, k=rng.randrange(40)))]
        if d % 3 == 0:
            parts.append(rng.choice(items)[1] or "")
        docs.append((d, "!? ".join(parts)))
    docs += [(None, "no id but words"), (90, None), (91, ""), (92, "REPEATED, item: words-here"), (92, "REPEATED, item: words-here")]
    return docs, items


@pytest.mark.parametrize("block", [100_000, 7])
def test_matches_plain_search(spark, make_docs, case, block):
    docs, items = case
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(make_docs(docs).withColumn("n_words", F.lit(1)), benchmark, block_windows=block).collect()
    assert len(got) == len(docs)
    for r in got:
        n, hit, found, bad = slow(r.text, items)
        assert (r.judged.n_words, r.judged.n_hit, r.judged["items"], r.judged.contaminated) == (n, hit, found, bad), r.text


def test_digest(spark):
    frame = spark.createDataFrame([(["10", "2"],), ([],)], "items array<string>")
    got = [r[0] for r in frame.select(decontaminate.items_digest(F.col("items"))).collect()]
    assert got == [hashlib.sha256(b"10,2").hexdigest(), hashlib.sha256(b"").hexdigest()]


def test_empty_sides(spark, make_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judge(make_docs([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    row = decontaminate.judge(make_docs([(1, "a b")]), nothing).head()
    assert (row.judged.n_words, row.judged.n_hit, row.judged["items"], row.judged.contaminated) == (2, 0, [], False)
