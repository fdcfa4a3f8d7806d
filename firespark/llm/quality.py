"""Quality scores: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.trees import Trees, boosted

NAMES = (
    "bytes", "words", "lines", "word_length", "longest_word", "line_length", "lower", "upper", "digit", "space", "mark",
    "other", "commas", "stops", "pipes", "bangs", "symbols", "distinct_words", "top_word", "distinct_lines", "short_words",
    "entropy", "marked_words", "repeated_triples",
)
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[128:] = 5
_SYMBOLS = [ord(c) for c in "#$%&*+<>=@\\^_`{}~"]
_END_MARKS = frozenset(b"!#$%&*|+=<>~^@")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; an empty one gives zeros."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [float(len(data))] + [0.0] * (len(NAMES) - 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, counts, 6)
    n, size, share = len(words), len(data), counts[counts > 0] / len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    triples = len(set(zip(words, words[1:], words[2:]))) if n > 2 else 0
    return [
        float(size), float(n), float(len(lines)), float(lengths.mean()), float(lengths.max()), size / len(lines),
        kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[0] / size, kinds[5] / size,
        counts[44] / n, counts[46] / n, counts[124] / n, counts[33] / n, counts[_SYMBOLS].sum() / n,
        len(seen) / n, max(seen.values()) / n, len(set(lines)) / len(lines), float((lengths <= 3).mean()),
        float(-(share * np.log2(share)).sum()), sum(w[-1] in _END_MARKS for w in words) / n,
        1 - triples / (n - 2) if n > 2 else 0.0,
    ]


class Model:
    """Starting log-odds and trees; without any training rows every score is 0.5."""

    def __init__(self, start: float, trees: Trees | None):
        self.start, self.trees = start, trees

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES))
        logit = np.full(len(x), self.start) + (self.trees.total(x) if self.trees else 0.0)
        return 1 / (1 + np.exp(-logit))


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
    label_col: str = "quality", sample_rows: int = 20_000,
) -> Model:
    """Fit on a bounded sample of labelled rows: about ``sample_rows`` of them by a hash of their id.

    Rows with a null id or label teach nothing; rows that label one document twice count
    twice. Only the sampled rows' statistics reach the driver.
    """
    usable = labels.select(F.col(label_id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where(
        F.col("id").isNotNull() & F.col("y").isNotNull()
    )
    total = usable.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.lit(8), F.col("id")), F.lit(1 << 40)).cast("double") / float(1 << 40) < share
    sample = usable.where(drawn)

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    # About sample_rows ids of fixed size: the bound makes it safe to send them to all executors.
    rows = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(sample), "id")
        .select("id", "y", features("text").alias("x"))
        .toPandas()
    )
    if not len(rows):
        return Model(0.0, None)
    rows = rows.sort_values(["id", "y"], kind="stable")
    x = np.stack(rows["x"].to_numpy())
    return Model(*boosted(x, (rows["y"].to_numpy() > 0).astype(float)))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Score of every row's whole text, 0 to 1; null and empty texts are scored by their zeros."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def take(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores(texts.tolist()), dtype="float64")

    return take(F.col(text_col))
