"""Secret scans: candidate strings, judged by a random forest trained from labelled findings.

A candidate is a long run of characters that credentials are made of. Its features are
length, transitions between kinds of characters, coverage by a dictionary of the
corpus's own words, signs of a path or address, and the words beside it. The forest
learns from labelled findings which candidates are false positives.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import fold, frame, stored
from firespark.llm.trees import Trees, random_forest

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=@%~-])[A-Za-z0-9+/_.=@%~-]{16,}")
CONTEXT = 48
# Words that name a credential.
NAMING = frozenset("token secret password passwd pwd key apikey api_key access_key private_key auth bearer credential credentials".split())
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_-]*)[\"']?\s*(=|:=|:|=>|\s)\s*([\"'`]?)$")
_WORD = re.compile(r"[a-z]{4,}")
NAMES = (
    "length", "transitions", "kinds", "digits", "upper", "hex", "entropy", "longest_letters", "covered", "longest_word",
    "slashes", "dots", "at", "extension", "scheme", "named", "assigned", "quoted", "closed", "words_before", "repeats",
)


def kinds_of(value: str) -> str:
    return "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in value)


def coverage(value: str, dictionary: frozenset[str], longest: int) -> tuple[float, int]:
    """Share of the characters inside dictionary words, taken greedily from the left, and the longest word."""
    low, at, covered, best = value.lower(), 0, 0, 0
    while at < len(low):
        for size in range(min(longest, len(low) - at), 3, -1):
            if low[at : at + size] in dictionary:
                covered, best, at = covered + size, max(best, size), at + size
                break
        else:
            at += 1
    return covered / len(value), best


def features(before: str, value: str, after: str, dictionary: frozenset[str], longest: int) -> list[float]:
    kinds = kinds_of(value)
    counts = np.array(list(Counter(value).values())) / len(value)
    covered, word = coverage(value, dictionary, longest)
    name = _NAME.search(before)
    runs = re.findall(r"[A-Za-z]+", value)
    return [
        float(len(value)), sum(a != b for a, b in zip(kinds, kinds[1:])) / len(value), float(len(set(kinds))),
        kinds.count("0") / len(value), kinds.count("A") / len(value), sum(c in "0123456789abcdefABCDEF" for c in value) / len(value),
        float(-(counts * np.log2(counts)).sum()), float(max(map(len, runs), default=0)), covered, float(word),
        float(value.count("/")), float(value.count(".")), float("@" in value), float(bool(re.search(r"\.[A-Za-z]{1,5}$", value))),
        float(before.endswith("://") or value.startswith("www.")),
        float(bool(name) and name[1].lower().replace("-", "_").split("_")[-1] in NAMING or bool(name) and name[1].lower() in NAMING),
        float(bool(name) and name[2].strip() != ""), float(before[-1:] in ('"', "'", "`")), float(after[:1] in ('"', "'", "`")),
        float(len(_WORD.findall(before.lower()))), float(max(Counter(value).values()) / len(value)),
    ]


def candidates(text: str | None) -> Iterator[tuple[int, str, str, str]]:
    """(start, before, value, after) of every candidate in the whole text."""
    for m in CANDIDATE.finditer(text or ""):
        start, value = m.start(), m[0]
        # An assignment without spaces: the name isn't part of the value.
        name = re.match(r"[A-Za-z_-]{2,24}=(?=[A-Za-z0-9+/_.@%~-]{16,})", value)
        if name:
            start, value = start + name.end(), value[name.end() :]
        yield start, text[max(0, start - CONTEXT) : start], value, text[start + len(value) : start + len(value) + CONTEXT]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, value, before, after): every candidate of every row's whole text."""

    @F.pandas_udf("array<struct<start int, value string, before string, after string>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "value": v, "before": b, "after": a} for s, b, v, a in candidates(t)] for t in texts])

    return docs.select(F.col(id_col).alias("id"), F.explode(find(F.col(text_col))).alias("f")).select("id", "f.*")


def dictionary(docs: DataFrame, text_col: str = "text", least_count: int = 20, words: int = 20_000) -> frozenset[str]:
    """The corpus's most frequent words of 4 to 16 letters, counted over all texts.

    The dictionary's size is its feature: ``words`` words at most, those of at least
    ``least_count`` occurrences, ties in code-point order.
    """
    blanks = bytes(b if 97 <= b <= 122 else 32 for b in range(256))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for part in parts:
            for text in part["text"]:
                seen.update(w for w in fold(text).translate(blanks).split() if 4 <= len(w) <= 16)
                if len(seen) > 500_000:
                    yield frame([(w.decode(), n) for w, n in seen.items()], ["word", "n"])
                    seen.clear()
        yield frame([(w.decode(), n) for w, n in seen.items()], ["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    best = counted.where(F.col("n") >= least_count).orderBy(F.desc("n"), "word").limit(words)
    return frozenset(r["word"] for r in best.collect())


@dataclass
class Model:
    """A forest with the dictionary its features need; without a forest nothing is a secret."""

    words: frozenset[str]
    longest: int
    forest: Trees | None
    threshold: float = 0.5

    def scores(self, rows: list[tuple[str, str, str]]) -> np.ndarray:
        if not rows or self.forest is None:
            return np.zeros(len(rows))
        x = np.array([features(b, v, a, self.words, self.longest) for b, v, a in rows])
        return np.clip(self.forest.total(x), 0.0, 1.0)


def train(labelled: DataFrame, words: frozenset[str], sample_rows: int = 20_000) -> Model:
    """Fit on labelled findings (value, before, after, label 0/1).

    The sample is bounded: about ``sample_rows`` findings of each label, by a hash of
    value and context. Findings with a null label or value teach nothing. With one label only,
    nothing is learned.
    """
    shaped = labelled.where("value is not null and label is not null").select(
        "value", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"),
        (F.col("label").cast("double") > 0).cast("int").alias("label"),
    )
    usable = stored(shaped, "labelled")
    totals = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    longest = max(map(len, words), default=4)
    if len(totals) < 2:
        return Model(words, longest, None)
    place = F.pmod(F.xxhash64("value", "before", "after"), F.lit(1 << 40)).cast("double") / float(1 << 40)
    keep = F.lit(False)
    for label, n in totals.items():
        keep = keep | ((F.col("label") == label) & (place < min(1.0, sample_rows / n)))
    rows = sorted((r["value"], r["before"], r["after"], r["label"]) for r in usable.where(keep).collect())
    x = np.array([features(b, v, a, words, longest) for v, b, a, _ in rows])
    return Model(words, longest, random_forest(x, np.array([r[3] for r in rows], float)))


def labelled_findings(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Labels for findings by what is known without reading the candidate's surroundings alike.

    Secret: a value of mixed letters and digits without any long run of letters that some
    text assigns to a credential's name. False positive: candidates of web pages, where
    addresses, file names and attributes are plenty, and candidates of texts that have no
    digit or stand in no assignment. Everything else stays unlabelled.
    """
    found = findings(docs)
    named = F.lower("before").rlike(r"(" + "|".join(sorted(NAMING)) + r")[\"']?\s*(=|:=|:|=>)\s*[\"'`]?$")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & ~F.col("value").rlike(r"[A-Za-z]{12,}|[/@]|\.[a-z]{2,4}$")
    plain = ~F.col("value").rlike("[0-9]") | ~F.col("value").rlike("[A-Za-z]") | F.col("value").rlike(r"[/@]")
    label = F.when(named & mixed, 1).when(~named & plain, 0)
    out = found.select("value", "before", "after", label.alias("label"))
    if pages is not None:
        web = findings(pages, "page_id", "html")
        out = out.unionByName(web.where(~F.lower("before").rlike("|".join(sorted(NAMING)))).select("value", "before", "after", F.lit(0).alias("label")))
    return out.where("label is not null")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, value, before, after, score, secret) per candidate of every row's whole text.

    ``start`` counts characters from 0. Null and empty texts give no rows; neither does
    an empty table. Repeated rows give repeated findings, null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def take(before: pd.Series, value: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(list(zip(before, value, after))), dtype="float64")

    scored = findings(docs, id_col, text_col).withColumn("score", take("before", "value", "after"))
    return scored.withColumn("secret", F.col("score") >= model.threshold)


def redacted(text: Column, model: Model, docs: DataFrame, mask: str = "[secret]") -> Column:
    """The text with every secret replaced by ``mask``; texts without secrets, and nulls, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = list(candidates(t))
            scores = shared.value.scores([(b, v, a) for _, b, v, a in found])
            for (start, _, value, _), s in reversed(list(zip(found, scores))):
                if s >= shared.value.threshold:
                    t = t[:start] + mask + t[start + len(value) :]
            out.append(t)
        return pd.Series(out, dtype=object)

    return clean(text)
