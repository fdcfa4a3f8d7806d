"""The pipeline's stages over planted documents."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firespark.llm import simhash
from firespark.llm.common import stored


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = random.Random(11)
    words = {"en": [f"{a}{b}" for a in ("the", "wh", "th", "ing") for b in ("at", "en", "is", "ose", "ere")],
             "fr": [f"{a}{b}" for a in ("é", "eau", "ou", "çe") for b in ("le", "que", "ment", "aux", "tion")]}
    unique = lambda: "".join(rng.choice("bcdfgklmnp") for _ in range(7))
    text = lambda lang, n: " ".join(rng.choice(words[lang]) if rng.random() < 0.6 else unique() for _ in range(n))
    rows = [(i, text("en" if i % 2 else "fr", 80), f"s{i % 3}", "en" if i % 2 else "fr") for i in range(80)]
    item = " ".join(unique() for _ in range(20))
    near = rows[5][1].split()
    near[7] = "edited"
    rows += [(100, rows[3][1], "s0", "en"), (101, " ".join(near), "s1", "en"), (102, text("en", 60) + " " + item, "s2", "en"),
             (103, f'{text("en", 30)} token = "{"0a1b2c3d4e5f67" * 3}" {text("en", 30)}', "s0", "en"), (104, None, "s0", None), (105, "12 34 !!", None, "en")]
    rows += [(200 + i, f'{text("en", 40)} secret = "{rng.randrange(16**31, 16**32):x}"', "s1", "en") for i in range(8)]
    make_docs(rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    page = "<a href='/one/two/three/long-path-{0}.html'>{0}</a>"
    spark.createDataFrame([(i, "u", page.format(i)) for i in range(30)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return str(root)


def test_stages_take_effect_and_clean_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    docs = docs.withColumn("found", F.lit("x")).withColumn("clean", F.lit("y")).withColumn("judged", F.lit(1)).withColumn("g", F.lit(2))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder), "test-stage")
        seen[name] = docs.collect()
        assert docs.columns == columns + ["mix_epoch", "mix_shard", "mix_order"] * (name == "mixture")
    ids = {name: {r.doc_id for r in rows} for name, rows in seen.items()}
    clean = set(range(80))
    assert clean <= ids["language"] and not ids["language"] & {104, 105}
    assert clean <= ids["near_duplicates"] and not ids["near_duplicates"] & {100, 101}
    assert ids["near_duplicates"] - ids["contamination"] == {102}
    assert ids["secrets"] == ids["contamination"]
    changed = {r.doc_id: r for r in seen["secrets"]}
    assert "[secret]" in changed[103].text and changed[103].n_chars == len(changed[103].text)
    assert all("[secret]" not in changed[i].text for i in clean) and all("[secret]" in changed[200 + i].text for i in range(8))
    assert ids["mixture"] <= ids["secrets"] and len(seen["mixture"]) >= len(ids["mixture"])


def test_run_is_the_stages_in_turn(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"mix_shard", "mix_epoch", "mix_order"} <= set(out.columns) and out.count() > 80


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (1, None, None, None), (1, "", None, None)]])
def test_stages_over_nothing_and_nulls(spark, make_docs, folder, rows):
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, make_docs(rows), folder).count()
        assert kept == {"language": 0, "near_duplicates": min(1, len(rows)), "mixture": 0}.get(name, len(rows))


def test_copies_by_fingerprint_are_one_though_their_shingles_differ(spark, make_docs, folder):
    """A line repeated many times outweighs the ends: one fingerprint or nearly, shingle sets far apart."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bcdfghklmnp") for _ in range(7))
    line, rows = [word() for _ in range(13)], []
    for i in range(3):
        rows.append((i, " ".join(line * 60 + [word() for _ in range(25)]), "s", "en"))
    rows.append((3, " ".join(word() for _ in range(60)), "s", "en"))
    marks = [simhash.fingerprint(r[1], 3) for r in rows]
    assert max((marks[0] ^ m).bit_count() for m in marks[1:3]) <= 2 < min((marks[3] ^ m).bit_count() for m in marks[:3])
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(make_docs(rows)).collect()) == [0, 1, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, make_docs(rows), folder).collect()) == [0, 3]


def test_a_small_graph_of_copies_is_solved_without_rounds(spark, make_docs, folder):
    """A chain of copies, each near its neighbours only: the number of jobs doesn't grow with its length."""
    rng = random.Random(4)
    words = ["".join(rng.choice("bcdfghklmnp") for _ in range(7)) for _ in range(400)]
    docs = make_docs([(i, " ".join(words[i * 4 : i * 4 + 90]), "s", "en") for i in range(70)])
    spark.sparkContext.setJobGroup("copies", "")
    try:
        kept = [r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, folder).collect()]
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("copies"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert kept == [0] and jobs < 160


def test_near_duplicates_go_to_python_in_small_batches(spark, make_docs, folder, monkeypatch):
    """Each table of the stage is made under the smaller limit, and the session keeps its own."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", set()
    before = spark.conf.get(name)
    monkeypatch.setattr(simhash, "stored", lambda df, n: seen.add(spark.conf.get(name)) or stored(df, n))
    docs = make_docs([(i, " ".join(f"w{i}x{j}" for j in range(30)), "s", "en") for i in range(3)])
    assert simhash.drop_near_duplicates(docs).count() == 3
    assert seen == {str(simhash.BATCH)} and int(before) > simhash.BATCH and spark.conf.get(name) == before
