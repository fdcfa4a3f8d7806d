"""Benchmark decontamination as a prefix-filtered set join with exact windows.

A window is ``size`` consecutive words of a benchmark item (the whole item if it has
fewer). The words of a window are ordered by rarity over the whole corpus. A document
passage equal to the window contains all of its words, so the necessary prefix of that
order is one token long: the rarest word. Document words that are some window's prefix
token give candidates; the token's place in the window fixes where the window would
have to start (positional bound) and that it ends inside the document (length bound),
and the words at that place are then compared exactly.

Benchmark windows form a stated query set. They are put up in blocks of bounded size,
each sent to the tasks that scan the documents; a larger benchmark means more blocks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import fold, frame, stored

#: ASCII bytes that are no word characters become spaces; all others stay.
_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII digits and letters and of all other characters."""
    return fold(text).translate(_BLANKS).split()


@dataclass
class Block:
    """Windows under their rarest word: (place of the word, the window's words, items)."""

    by_word: dict[bytes, list[tuple[int, tuple[bytes, ...], tuple[str, ...]]]]


def benchmark_windows(benchmark: DataFrame, size: int, item_col: str, text_col: str) -> DataFrame:
    """(window array<binary>, items array<string>): distinct windows with their items' ids."""

    @F.pandas_udf("array<array<binary>>")
    def windows(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> list[list[bytes]]:
            words = words_of(text)
            if not words:
                return []
            return [list(w) for w in {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}]

        return pd.Series([one(t) for t in texts])

    cut = benchmark.select(F.col(item_col).cast("string").alias("item"), F.explode(windows(F.col(text_col))).alias("window"))
    return cut.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, int]:
    """How often each word of one block's vocabulary stands in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, seen = shared.value, Counter()
        for part in parts:
            for text in part["text"]:
                seen.update(w for w in words_of(text) if w in wanted)
        yield frame(list(seen.items()), ["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word binary, n long")
    return {bytes(r["word"]): r["n"] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


def blocks_of(windows: DataFrame, docs: DataFrame, text_col: str, block_windows: int) -> Iterator[Block]:
    """The windows in blocks of about ``block_windows``, each indexed by its rarest words."""
    total = windows.count()
    blocks = max(1, -(-total // block_windows))
    slot = F.pmod(F.xxhash64("window"), F.lit(blocks))
    for number in range(blocks if total else 0):
        rows = windows.where(slot == number).collect()
        found = [(tuple(bytes(w) for w in r["window"]), tuple(r["items"])) for r in rows]
        counts = word_counts(docs, {w for window, _ in found for w in window}, text_col)
        by_word: dict = defaultdict(list)
        for window, items in found:
            place = min(range(len(window)), key=lambda i: (counts.get(window[i], 0), window[i], i))
            # A word that no document holds can't give a candidate.
            if counts.get(window[place], 0):
                by_word[window[place]].append((place, window, items))
        yield Block(dict(by_word))


def match(words: list[bytes], block: Block, hit: np.ndarray, items: set[str]) -> None:
    """Mark the words inside any occurrence of the block's windows, and note their items."""
    index = block.by_word
    for at in [i for i, w in enumerate(words) if w in index]:
        for place, window, owners in index[words[at]]:
            start = at - place
            if start < 0 or start + len(window) > len(words):
                continue
            if tuple(words[start : start + len(window)]) == window:
                hit[start : start + len(window)] = True
                items.update(owners)


def _finder(shared: Broadcast):
    """Marks one block's windows in texts."""

    @F.pandas_udf("n_words long, hits array<int>, items array<string>")
    def find(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for text in texts:
                words = words_of(text)
                hit, items = np.zeros(len(words) + 2, bool), set()
                match(words, shared.value, hit[1:-1], items)
                rows.append((len(words), np.flatnonzero(hit[1:] != hit[:-1]).astype(np.int32), sorted(items)))
            yield frame(rows, ["n_words", "hits", "items"])

    return find


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_windows: int = 100_000,
) -> list[Column]:
    """One column per block of windows: struct(n_words, hits, items) of ``text_col``.

    ``hits`` are the marked words as start and end of each run.
    """
    windows = stored(benchmark_windows(benchmark, size, item_col, item_text_col), "windows")
    context = docs.sparkSession.sparkContext
    columns = []
    for block in blocks_of(windows, docs, text_col, block_windows):
        columns.append(_finder(context.broadcast(block))(F.col(text_col)))
    if not columns:
        nothing = F.array().cast("array<int>")

        @F.pandas_udf("long")
        def count(texts: pd.Series) -> pd.Series:
            return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

        columns.append(F.struct(count(F.col(text_col)).alias("n_words"), nothing.alias("hits"), F.array().cast("array<string>").alias("items")))
    return columns


def _covered(runs: Column) -> Column:
    """Number of words covered by runs of several blocks, given as starts and ends in turn."""

    def one(flat) -> int:
        pairs = np.asarray(flat, np.int64).reshape(-1, 2)
        if not len(pairs):
            return 0
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        ends = np.maximum.accumulate(pairs[:, 1])
        return int(np.maximum(ends - np.maximum(pairs[:, 0], np.r_[0, ends[:-1]]), 0).sum())

    @F.pandas_udf("long")
    def take(lists: pd.Series) -> pd.Series:
        return pd.Series([one(r) for r in lists], dtype="int64")

    return take(runs)


def judged(docs: DataFrame, found: list[Column], share: int = 20, out_col: str = "judged") -> DataFrame:
    """``docs`` with a struct ``out_col``: n_words, n_hit, items, contaminated.

    Contaminated: some word is hit and ``share * n_hit >= n_words``. An input column of
    that name is replaced.
    """
    marked = docs.withColumn(out_col, F.array(*found))
    blocks = F.col(out_col)
    runs = F.flatten(F.transform(blocks, lambda b: b["hits"]))
    items = F.sort_array(F.array_distinct(F.flatten(F.transform(blocks, lambda b: b["items"]))))
    shaped = marked.withColumn(out_col, F.struct(blocks[0]["n_words"].alias("n_words"), runs.alias("hits"), items.alias("items")))
    n_words, hits = F.col(out_col)["n_words"], F.col(out_col)["hits"]
    n_hit = _covered(hits) if len(found) > 1 else _run_words(hits)
    counted = shaped.withColumn(out_col, F.struct(n_words.alias("n_words"), n_hit.alias("n_hit"), F.col(out_col)["items"].alias("items")))
    n_hit = F.col(out_col)["n_hit"]
    return counted.withColumn(out_col, F.col(out_col).withField("contaminated", (n_hit > 0) & (share * n_hit >= n_words)))


def _run_words(runs: Column) -> Column:
    """Words in disjoint runs: the ends less the starts."""
    signed = F.transform(runs, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda acc, x: acc + x)


def judge(
    docs: DataFrame, benchmark: DataFrame, size: int = 13, share: int = 20, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block_windows: int = 100_000, out_col: str = "judged",
) -> DataFrame:
    """``docs`` with a struct ``out_col`` (n_words, n_hit, items, contaminated).

    Null texts and texts without words have no words, no hits and aren't contaminated;
    items without words give no window; a null item id is no item of the list but its
    words are hit. Repeated documents or items change nothing for the others. Works for
    empty tables on either side.
    """
    return judged(docs, contamination(docs, benchmark, size, text_col, item_col, item_text_col, block_windows), share, out_col)


def items_digest(items: Column) -> Column:
    """SHA-256 in lower-case hex of the item ids, sorted as strings, joined by commas."""
    return F.sha2(F.concat_ws(",", items), 256)
