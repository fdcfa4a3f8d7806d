"""Language ID, quality and secret scans: held-out accuracy, and defined results at the edges."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from firespark.llm import langid, quality, secrets, trees

VOCABULARY = {
    "en": "the and with from that this have there would about which their other could people".split(),
    "de": "der die und nicht eine werden haben sich auch nach über können schließlich müssen straße".split(),
    "fr": "le les des est pour dans une avec être plus française même après où déjà".split(),
}


def prose(lang, n, rng):
    return " ".join(rng.choice(VOCABULARY[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(n))


def test_languages_on_held_out_texts(make_docs):
    rng = random.Random(0)
    rows = [(i, prose(lang, 60, rng), "s", lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    languages = langid.learn(make_docs(rows + [(900, None, "s", "en"), (901, "a text", "s", None), (902, "123", "s", "xx")]))
    assert sorted(languages.names) == ["de", "en", "fr"]
    fresh = [(i, prose(lang, 50, rng), "s", lang) for i, lang in enumerate(["en", "de", "fr"] * 20)]
    edges = [(1000, None), (1001, ""), (1002, "12 ... 34"), (1003, "x"), (1003, "x"), (None, prose("de", 9000, rng))]
    docs = make_docs(fresh + edges).withColumn("score", F.lit("clash"))
    got = langid.predict(docs, languages).collect()
    told = {r.id: r for r in got}
    assert len(got) == len(fresh) + len(edges) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([told[i].lang_pred == lang for i, _, _, lang in fresh]) > 0.95
    assert all(told[i].lang_pred == "und" and told[i].rejected for i in (1000, 1001, 1002))
    assert told[1003].lang_pred in languages.names and told[None].lang_pred == "de" and not told[None].rejected


def test_nothing_learned(make_docs):
    languages = langid.learn(make_docs([]))
    row = langid.predict(make_docs([(1, "some text")]), languages).head()
    assert (row.lang_pred, row.rejected) == ("und", True)
    assert langid.predict(make_docs([]), languages).count() == 0


def test_bounded_sample_takes_long_texts_only_where_there_are_no_short_ones(make_docs):
    rows = [(1, "kurz genug", "s", "de"), (2, "lang " * 3000, "s", "de"), (3, "very long " * 3000, "s", "en")]
    languages = langid.learn(make_docs(rows))
    assert dict(zip(languages.names, (len(c) for c in languages.contents))) == {"de": 10, "en": 30000}


def test_quality_on_held_out_documents(spark, make_docs):
    rng = random.Random(1)

    def document(good):
        text = prose("en", rng.randrange(20, 80), rng).capitalize() + "."
        return text if good else " ".join(w.upper() + rng.choice(["!!", "%%%", " |"]) for w in text.split())

    rows = [(i, document(i % 3 > 0)) for i in range(300)]
    docs = make_docs(rows + [(400, None), (401, ""), (401, ""), (None, "a null id")])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)] + [(5, None), (None, 1), (5000, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = docs.select("doc_id", quality.score(docs, model).alias("score")).collect()
    assert len(got) == 304 and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id: r.score for r in got if r.doc_id is not None and 200 <= r.doc_id < 300}
    assert all((s >= 0.3) == (i % 3 > 0) for i, s in held.items())


def test_quality_without_labels(spark, make_docs):
    model = quality.fit(make_docs([(1, "x")]), spark.createDataFrame([], "doc_id long, quality int"))
    docs = make_docs([(1, "x"), (2, None)])
    assert {r.score for r in docs.select(quality.score(docs, model).alias("score")).collect()} == {0.5}
    assert make_docs([]).select(quality.score(docs, model)).count() == 0


def test_flat_trees_equal_a_walk_node_by_node():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)).round(1)
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    start, boosted = trees.boosted(x, y, trees=20)

    def walk(row):
        total = 0.0
        for node in boosted.roots:
            for _ in range(boosted.depth):
                node = boosted.left[node] if row[boosted.feature[node]] <= boosted.threshold[node] else boosted.right[node]
            total += boosted.value[node]
        return total

    assert np.allclose(boosted.total(x), [walk(r) for r in x])
    assert (((start + boosted.total(x)) > 0) == (y > 0)).mean() > 0.95
    assert ((trees.random_forest(x, y).total(x) > 0.5) == (y > 0)).mean() > 0.95


def test_secrets_and_false_positives(spark, make_docs):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    kinds = [
        lambda: (1, f'{prose("en", 8, rng)} token = "{key(40)}" {prose("en", 5, rng)}'),
        lambda: (1, f"api_key={key(32)} {prose('en', 4, rng)}"),
        lambda: (0, f"see /usr/local/share/{prose('en', 1, rng)}/config-{rng.randrange(99)}.yaml now"),
        lambda: (0, f"mail {prose('en', 1, rng)}.{rng.randrange(99)}@mail.example.com today"),
        lambda: (0, f"call {rng.randrange(10**17, 10**18)} or not"),
    ]
    made = [kinds[i % 5]() for i in range(400)]
    docs = make_docs([(i, t) for i, (_, t) in enumerate(made)])
    model = secrets.train(secrets.labelled_findings(docs.where("doc_id < 300")), secrets.dictionary(docs, least_count=5))
    edges = [(500, None), (501, ""), (502, f'a token = "{key(40)}"'), (502, 'a token = "x"'), (None, f'secret: "{key(40)}"')]
    got = secrets.scan(make_docs([(i, t) for i, (_, t) in enumerate(made) if i >= 300] + edges).withColumn("score", F.lit(1)), model).collect()
    judged = [(r.secret, made[r.id][0] == 1) for r in got if r.id is not None and r.id < 500]
    assert len(judged) == 100 and all(a == b for a, b in judged)
    assert [r.secret for r in got if r.id is None] == [True] and [r.secret for r in got if r.id == 502] == [True]
    held = docs.where("doc_id >= 300")
    for r in held.select("doc_id", "text", secrets.redacted(F.col("text"), model, held).alias("clean")).collect():
        assert (r.clean == r.text) == (made[r.doc_id][0] == 0)


def test_secrets_without_labels(spark, make_docs):
    nothing = spark.createDataFrame([], "value string, before string, after string, label int")
    model = secrets.train(nothing, frozenset())
    assert not any(r.secret for r in secrets.scan(make_docs([(1, 'token = "0123456789abcdef0123"')]), model).collect())
    assert secrets.scan(make_docs([]), model).count() == 0
