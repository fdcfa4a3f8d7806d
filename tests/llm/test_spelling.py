"""Spelling variants against a plain comparison of all words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from firespark.llm import spelling

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def got(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(docs).collect()}


def variants_of(rng, word, count):
    out = []
    for _ in range(count):
        i = rng.randrange(len(word))
        c = rng.choice("abcxyzéÿ")
        out.append(rng.choice([word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word + c, c + word]))
    return out


def test_chains_and_ties_are_those_of_all_pairs(make_docs):
    rng = random.Random(4)
    rows, bases = [], ["retitioning", "ÉtÉreché", "aaaaaaaa", "aaaaaaaaa", "ababababab", "underst" + "and" * 30]
    for i, base in enumerate(bases):
        words = [base] * 300
        for v in variants_of(rng, base, 12):
            words += [v] * rng.choice([1, 2, 3, 20, 25])
            for u in variants_of(rng, v, 4):
                words += [u] * rng.choice([2, 2, 3])
        rng.shuffle(words)
        rows += [(10 * i + j, " ".join(words[j::7])) for j in range(7)]
    rows += [(900, None), (901, ""), (902, "short words only ÷× 123"), (None, "Retitioning retitioning"), (903, "twice-told,understood understood"), (903, "twice-told,understood understood")]
    docs = make_docs(rows).withColumn("word", F.lit("clash")).withColumn("id", F.lit(1)).withColumn("h", F.lit(2))
    exact = slow(rows)
    assert sum(v[0] is not None for v in exact.values()) > 20 and any(v[0] != v[1] for v in exact.values() if v[0])
    assert got(docs) == exact


def test_crowded_keys_are_split_into_small_blocks_without_loss(spark):
    rng = random.Random(5)
    words = sorted({"prefix" + "".join(rng.choice("ab") for _ in range(rng.randrange(7, 10))) + "suffix" for _ in range(700)})
    rows = spark.createDataFrame(list(enumerate(words)), "id long, word string")
    exact = {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if one_edit(a, b)}
    assert {(r.a, r.b) for r in spelling.near_words(rows, block_words=16).collect()} == exact


def test_a_very_long_word_and_an_empty_table(make_docs):
    long = "lengthy" * 3000
    assert got(make_docs([(1, f"{long} {long}x {long}x {long}")]))[long][2:4] == (2, 1)
    assert got(make_docs([])) == {}
