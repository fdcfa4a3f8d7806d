"""Language identification by compression.

For each language a raw-content zstandard dictionary is put together from labelled
texts. A text is lower-cased and cut into pieces of a few KB, each piece is compressed under
every dictionary, and the language whose total is smallest wins. A narrow margin to the
second smallest is reported as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import frame

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
PIECE_BYTES = 4096


@dataclass
class Languages:
    """Languages, the one with most labelled texts first, each with its dictionary's bytes."""

    names: list[str]
    contents: list[bytes]


def learn(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    dictionary_bytes: int = 65_536,
    sample_texts: int = 400,
    longest_sample: int = 8_192,
) -> Languages:
    """Dictionaries from rows with a text and a language.

    The sample is bounded and documented: per language the ``sample_texts`` texts of at
    most ``longest_sample`` characters (all texts if it has none so short) with the
    smallest hash of their content, whole, up to ``dictionary_bytes`` in all. Rows
    without text, language or any letter teach nothing. No rows: no languages.
    """
    usable = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    sized = usable.withColumn("long", F.length("text") > longest_sample)
    counts = {(r["lang"], r["long"]): r["n"] for r in sized.groupBy("lang", "long").agg(F.count("*").alias("n")).collect()}
    texts: dict[str, int] = {}
    for (lang, _), n in counts.items():
        texts[lang] = texts.get(lang, 0) + n
    names = sorted(texts, key=lambda lang: (-texts[lang], lang))
    # A threshold on the hash keeps about twice the sample of each language, so no
    # language is gathered or sorted whole.
    keep = F.lit(False)
    rank = F.pmod(F.xxhash64("text"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    for lang in names:
        only_long = (lang, False) not in counts
        share = min(1.0, 2 * sample_texts / counts[(lang, only_long)] + 64 / counts[(lang, only_long)])
        keep = keep | ((F.col("lang") == lang) & (F.col("long") == only_long) & (F.col("rank") <= share))
    rows = sized.withColumn("rank", rank).where(keep).select("lang", "rank", F.substring("text", 1, dictionary_bytes).alias("text")).distinct().collect()
    contents = []
    for lang in names:
        best = sorted((r["rank"], r["text"]) for r in rows if r["lang"] == lang)[:sample_texts]
        contents.append(b"\n".join(t.lower().encode("utf-8", "surrogatepass") for _, t in best)[:dictionary_bytes])
    return Languages(names, contents)


class Classifier:
    def __init__(self, languages: Languages, level: int = 6):
        self.names = languages.names
        self.compressors = []
        for content in languages.contents:
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=False, write_content_size=False))

    def classify(self, text: str | None) -> tuple[str, float]:
        """Predicted language and score: the share by which the second smallest total is larger."""
        if text is None or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0
        data = text.lower().encode("utf-8", "surrogatepass")
        totals = np.zeros(len(self.names), np.int64)
        for i in range(0, len(data), PIECE_BYTES):
            piece = data[i : i + PIECE_BYTES]
            totals += [len(c.compress(piece)) for c in self.compressors]
        order = np.argsort(totals, kind="stable")
        if len(order) == 1:
            return self.names[0], 1.0
        first, second = totals[order[0]], totals[order[1]]
        return self.names[order[0]], float(1 - first / second)


def predict(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text", min_margin: float = 0.002) -> DataFrame:
    """(id, lang_pred, score, rejected) for every row's whole text.

    ``lang_pred`` is a learned language, or ``und`` for null texts, texts without any
    letter, or if nothing was learned. Equal totals go to the language with more labelled
    texts, then to the first in code-point order. ``rejected`` marks ``und`` and scores under ``min_margin``.
    Repeated rows and null ids are kept; an empty table gives no rows.
    """
    marked = docs.select(F.col(id_col).alias("id"), prediction(docs, languages, text_col).alias("p"))
    return marked.select("id", "p.lang_pred", "p.score", rejected(F.col("p"), min_margin).alias("rejected"))


def rejected(prediction: Column, min_margin: float = 0.002) -> Column:
    return (prediction["lang_pred"] == UNKNOWN) | (prediction["score"] < min_margin)


def prediction(docs: DataFrame, languages: Languages, text_col: str = "text") -> Column:
    """The prediction of ``text_col`` as a column: struct(lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    @F.pandas_udf("lang_pred string, score double")
    def take(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(shared.value)
        for texts in parts:
            yield frame([classifier.classify(t) for t in texts], ["lang_pred", "score"])

    return take(F.col(text_col))
