"""Language identification against plain compression of every piece with every language's texts."""

from __future__ import annotations

import random

import zstandard
from pyspark.sql import functions as F

from firespark.llm import langid


def slow(text, languages):
    """Smallest total over pieces of 4 KB, each compressed anew with a raw-content dictionary."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = text.lower().encode("utf-8", "surrogatepass")
    totals = []
    for content in languages.contents:
        total = 0
        for i in range(0, len(data), 4096):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=6, dict_data=known, write_checksum=False, write_content_size=False).compress(data[i : i + 4096]))
        totals.append(total)
    first, second = sorted(totals)[:2]
    return languages.names[totals.index(first)], 1 - first / second


def test_predictions_are_those_of_plain_compression(make_docs):
    rng = random.Random(2)
    words = {"en": ["the", "whether", "things", "every", "reading"], "fr": ["été", "beaucoup", "manière", "leçon", "oiseaux"], "de": ["straße", "über", "machen", "schön", "nicht"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(lang, rng.randrange(5, 60)), "s", lang) for i, lang in enumerate(["en", "fr", "de"] * 20)]
    languages = langid.learn(make_docs(rows))
    asked = [(100 + i, t) for i, t in enumerate([text("fr", 3), text("de", 3000), text("en", 1), "12 !", "", None, "ß", "the été nicht", "X" * 20_000])]
    docs = make_docs(asked).withColumn("p", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r.id: r for r in langid.predict(docs, languages).collect()}
    for i, t in asked:
        lang, score = slow(t, languages)
        r = got[i]
        assert (r.lang_pred, round(r.score, 12)) == (lang, round(score, 12))
        assert r.rejected == (lang == "und" or score < 0.002)
    assert got[103].rejected and not got[101].rejected
