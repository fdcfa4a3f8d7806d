"""SimHash fingerprints, covering links and near-duplicate classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from firespark.llm import simhash


def slow_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    return value - (1 << 64) if value >> 63 else value


def components(ids, near):
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in near:
        x, y = sorted((root(a), root(b)))
        label[y] = x
    return {i: root(i) for i in ids}


TEXTS = ["", None, "  \n ", "one", "Two WORDS", "É É é a b c d", "a\x0bb\x0cc\td", "x " * 500, "Same text here now", "same TEXT here now"]


def test_fingerprint_matches_the_definition():
    for text in TEXTS + ["".join(random.Random(i).choice("ab cÉ\n") for _ in range(200)) for i in range(50)]:
        assert simhash.fingerprint(text, 3) == slow_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pair_within_the_radius_meets_in_a_table(radius):
    masks = simhash.covering_masks(radius)
    rng = random.Random(radius)
    for _ in range(500):
        gone = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not (m & (2**64 - 1)) & gone for m in masks)


@pytest.mark.parametrize("bucket", [4, 256])
def test_links_connect_what_brute_force_connects(spark, bucket):
    rng = np.random.default_rng(bucket)
    seeds = rng.integers(-(2**63), 2**63, 6, dtype=np.int64)
    values = set()
    for s in seeds:
        for _ in range(40):
            x = int(s)
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            values.add((x + 2**63) % 2**64 - 2**63)
    values = sorted(values)
    links = simhash.covering_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, bucket).collect()
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert all(bits(r.a, r.b) <= 2 for r in links)
    exact = components(values, [(a, b) for i, a in enumerate(values) for b in values[:i] if bits(a, b) <= 2])
    assert components(values, [(r.a, r.b) for r in links]) == exact


def test_classes_with_nulls_copies_and_repeated_rows(spark, make_docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (3, "one"), (None, "one"), (None, "alone with a null id")]
    docs = make_docs(rows).withColumn("fp", F.lit("clash")).withColumn("component", F.lit(1))
    got = simhash.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows)
    fps = {i: slow_fingerprint(t) for i, t in rows if i is not None}
    exact = components(sorted(fps), [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() <= 2])
    for r in got:
        assert r.component_id == (exact[r.id] if r.id is not None else 3 if r.fp == fps[3] else None)


def test_empty_table(make_docs):
    assert simhash.near_duplicate_classes(make_docs([])).count() == 0
    assert simhash.drop_near_duplicates(make_docs([])).count() == 0


def test_similar_documents_leave_one_and_clean_ones_stay(make_docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows = [(100 + i, " ".join(rng.choices(words, k=120))) for i in range(20)]
    for i, (_, text) in enumerate(rows[:5]):
        w = text.split()
        w[3 + i] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(7, rows[10][1].upper()), (200, None), (201, ""), (202, "  "), (None, "no id"), (50, "twice"), (50, "twice")]
    out = simhash.drop_near_duplicates(make_docs(rows).withColumn("_row", F.lit(1))).collect()
    kept = sorted(r.doc_id for r in out if r.doc_id is not None)
    assert kept == sorted([0, 1, 2, 3, 4, 7, 50, 200, *[100 + i for i in range(20) if i >= 5 and i != 10]])
    assert [r.text for r in out if r.doc_id is None] == ["no id"] and "_row" in out[0].asDict()


def shingle_sets(rows, k=5):
    words = {i: text.split() for i, text in rows}
    return {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} for i, w in words.items()}


def jaccard_classes(rows):
    """Classes at similarity 0.8 by comparing all pairs."""
    sets = shingle_sets(rows)
    alike = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    return components(sorted(sets), alike)


def test_appended_truncated_and_short_copies_are_found(make_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    rows = []
    for n in (13, 20, 30, 60, 100, 200, 400):
        for _ in range(4):
            base = [word() for _ in range(n)]
            cut = (n - 4) // 10
            copies = [base, base[:-1] + [word()], base[: n - cut] + [word() for _ in range(cut)], base + [word() for _ in range((n - 4) // 5)],
                      base[: n - (n - 4) // 5], base[(n - 4) // 5 :]]
            rows += [(len(rows) + i, " ".join(c)) for i, c in enumerate(copies)]
    exact = jaccard_classes(rows)
    assert len(set(exact.values())) == 28
    got = {r.id: r.component_id for r in simhash.similar_classes(make_docs(rows)).collect()}
    assert got == exact


@pytest.mark.parametrize("order", ["none", "one row", "commonest first"])
def test_classes_do_not_depend_on_the_order_of_shingles(make_docs, monkeypatch, order):
    """Counts of shingles set the order of keys only: without any, or turned round, the same pairs are found."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    common, rows = [word() for _ in range(20)], []
    for i in range(12):
        base = common[: 5 + i] + [word() for _ in range(60)]
        copies = [base, base[:-2] + [word(), word()], [word(), *base[1:]], base[:40] + [word()] * 9 + base[49:]]
        rows += [(4 * i + k, " ".join(c)) for k, c in enumerate(copies)]
    counted = simhash.common_shingles
    given = {
        "none": lambda *a: (np.zeros(0, np.int64), np.zeros(0, np.int64)),
        "one row": lambda docs, *a: counted(docs.limit(1), *a),
        "commonest first": lambda *a: (lambda found, n: (found, -n))(*counted(*a)),
    }
    monkeypatch.setattr(simhash, "common_shingles", given[order])
    got = {r.id: r.component_id for r in simhash.similar_classes(make_docs(rows)).collect()}
    assert got == jaccard_classes(rows)


def test_no_pair_is_lost_in_a_crowd_of_one_template(make_docs):
    """Forms whose fingerprints are near but whose shingles are not, each with one true near copy."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template, rows = [word() for _ in range(100)], []
    for i in range(60):
        form = list(template)
        for at in (12, 37, 62, 87):
            form[at] = word()
        copy = form[:-1] + [word()]
        rows += [(2 * i, " ".join(form)), (2 * i + 1, " ".join(copy))]
    exact = jaccard_classes(rows)
    assert len(set(exact.values())) == 60
    got = {r.id: r.component_id for r in simhash.similar_classes(make_docs(rows)).collect()}
    assert got == exact


@pytest.mark.parametrize("classes", [1, 3, 40])
def test_links_in_a_key_connect_what_brute_force_connects(classes):
    rng = np.random.default_rng(classes)
    shared, sets = rng.integers(0, 2**60, 70), []
    for _ in range(40):
        own = np.concatenate([shared, rng.integers(0, 2**60, rng.integers(8, 31))])
        sets += [np.unique(np.concatenate([own[: len(own) - cut], rng.integers(0, 2**60, cut)])) for cut in rng.integers(0, 12, 3)]
    known = np.arange(len(sets)) % classes if classes < 40 else np.arange(len(sets))
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    alike = [(a, b) for a in range(len(sets)) for b in range(a) if 9 * both(a, b) >= 4 * (len(sets[a]) + len(sets[b]))]
    before = [(i, int(np.flatnonzero(known == k)[0])) for i, k in enumerate(known)]
    links = simhash.similar_trees(np.arange(len(sets)), known, sets, 0.8)
    assert set(links) <= {*alike, *[(b, a) for a, b in alike]} and len(links) < len(sets)
    assert components(range(len(sets)), before + links) == components(range(len(sets)), before + alike)


def test_texts_of_one_fingerprint_in_other_orders_are_told_apart(make_docs):
    """Lists of the same distinct words in other orders, each with a near copy: the fingerprint is one."""
    rng = random.Random(10)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(80)]
    rows = []
    for i in range(40):
        order = rng.sample(words, len(words))
        copy = list(order)
        copy[70], copy[71] = copy[71], copy[70]
        rows += [(2 * i, " ".join(order)), (2 * i + 1, " ".join(copy))]
    assert len({simhash.fingerprint(text, 1, True) for _, text in rows}) == 1
    exact = jaccard_classes(rows)
    assert len(set(exact.values())) == 40
    got = {r.id: r.component_id for r in simhash.similar_classes(make_docs(rows)).collect()}
    assert got == exact


def test_parity_maps_rule_out_no_similar_pair_and_most_others():
    rng = np.random.default_rng(3)
    ruled = 0
    for n in (1, 5, 60, 130, 700, 3000):
        for kept in (1.0, 0.95, 0.9, 0.88, 0.7, 0.3):
            a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            b = np.unique(np.concatenate([a[: int(len(a) * kept)], rng.integers(-(2**63), 2**63 - 1, len(a) - int(len(a) * kept) + rng.integers(0, 9))]))
            alike = 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b))
            possible = simhash.could_be_similar(simhash.parity(a), len(a), simhash.parity(b), len(b), 0.8)
            assert possible or not alike
            ruled += not possible
            near = simhash.near_by_parity(np.array([0, 1]), np.array([len(a), len(b)]), [simhash.parity(a), simhash.parity(b)], 0.8)
            assert near.all() or not alike
    assert ruled >= 10


@pytest.mark.parametrize(("chunk", "parity_chunk"), [(8, 16), (1_000, 20_000)])
def test_a_crowd_of_thousands_under_one_shingle_is_cut_and_loses_no_pair(spark, make_docs, chunk, parity_chunk):
    """Forms of one template, each with a true copy; however small the chunks, the classes are those of brute force."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    template, rows = [word() for _ in range(60)], []
    for i in range(50):
        form = template[:40] + [word() for _ in range(30)]
        rows += [(2 * i, " ".join(form)), (2 * i + 1, " ".join(form[:-2] + [word()]))]
    got = {r.id: r.component_id for r in simhash.similar_classes(make_docs(rows), chunk=chunk, parity_chunk=parity_chunk).collect()}
    assert got == jaccard_classes(rows)
    crowd = spark.range(3000).select(F.lit(7).alias("key"), F.col("id").alias("vertex")).unionByName(spark.createDataFrame([(8, 1), (8, 2)], "key int, vertex long"))
    groups = simhash._chunked(crowd, 500)
    sizes = {r.group: r["count"] for r in groups.groupBy("group").count().collect()}
    assert max(sizes.values()) <= 1200 and sizes["8:0:0"] == 2
    meet = groups.where("key = 7 and vertex in (5, 6, 1700)").groupBy("group").agg(F.collect_set("vertex").alias("v")).collect()
    for pair in ((5, 6), (5, 1700), (6, 1700)):
        assert any(set(pair) <= set(r.v) for r in meet)


def test_repeated_rows_with_a_map_column(make_docs):
    docs = make_docs([(1, "twice"), (1, "twice"), (2, "other")]).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    assert sorted((r.doc_id, r.m["k"]) for r in simhash.drop_near_duplicates(docs).collect()) == [(1, 1), (2, 2)]
