"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. The pre-tokens that a worker
has not seen yet are laid end to end in one ragged numpy array of byte symbols. In each
round every pre-token finds its own lowest-ranked adjacent pair, and all occurrences of
those pairs are merged at once, left to right where they overlap; a pre-token without a
known pair is done and leaves the array. What is left of it is its token count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

NONE = np.int32(2**31 - 1)
ROUND_SYMBOLS = 1 << 20


@dataclass
class Merges:
    """A vocabulary as arrays: pair keys in ascending order, their ranks and results."""

    width: int
    keys: np.ndarray
    ranks: np.ndarray
    results: np.ndarray
    first: np.ndarray
    special: list[str]


def load_merges(path: str) -> Merges:
    """Read a byte-level BPE vocabulary file; refuses settings that change the counts."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split, model = spec["pre_tokenizer"], spec["model"]
    if split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE vocabularies are supported")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take neighbouring characters are not supported")
    vocabulary = model["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in shown):
        shown[b] = chr(256 + i)
    width = max(vocabulary.values()) + 1
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    keys = np.array([vocabulary[a] * width + vocabulary[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    return Merges(
        width=width,
        keys=keys[order],
        ranks=np.arange(len(pairs), dtype=np.int32)[order],
        results=np.array([vocabulary[a + b] for a, b in pairs], np.int32)[order],
        first=np.array([vocabulary[shown[b]] for b in range(256)], np.int32),
        special=[t["content"] for t in spec["added_tokens"] if t["special"]],
    )


def _look_up(merges: Merges, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of each pair; NONE for pairs that the vocabulary doesn't merge."""
    wanted = left.astype(np.int64) * merges.width + right
    at = np.minimum(np.searchsorted(merges.keys, wanted), len(merges.keys) - 1)
    known = merges.keys[at] == wanted
    return np.where(known, merges.ranks[at], NONE), merges.results[at]


def count_merged(pieces: list[bytes], merges: Merges) -> np.ndarray:
    """Token count of each piece, merging all of them in step."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = lengths.copy()
    symbols = merges.first[np.frombuffer(b"".join(pieces), np.uint8)]
    owner = np.repeat(np.arange(len(pieces)), lengths)
    rank, result = _pair_up(symbols, owner, merges)
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        done = lowest == NONE
        if done.any():
            counts[owner[starts[done]]] = sizes[done]
            keep = np.repeat(~done, sizes)
            symbols, owner, rank, result = symbols[keep], owner[keep], rank[keep], result[keep]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        hit = rank == np.repeat(lowest, sizes)
        # Overlapping hits (a pair of equal symbols in a row): every other one from the left.
        at = np.flatnonzero(hit)
        run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
        at = at[place % 2 == 0]
        symbols[at] = result[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank, result = symbols[keep], owner[keep], rank[keep], result[keep]
        at = moved[at]
        again = np.union1d(at, at[at > 0] - 1)
        inner = again[again < len(symbols) - 1]
        inner = inner[owner[inner] == owner[inner + 1]]
        rank[again] = NONE
        rank[inner], result[inner] = _look_up(merges, symbols[inner], symbols[inner + 1])
    return counts


def _pair_up(symbols: np.ndarray, owner: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    rank = np.full(len(symbols), NONE, np.int32)
    result = np.zeros(len(symbols), np.int32)
    inner = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inner], result[inner] = _look_up(merges, symbols[inner], symbols[inner + 1])
    return rank, result


class Counter:
    """Counts tokens of texts; remembers the counts of short pre-tokens it has merged."""

    def __init__(self, merges: Merges, remembered: int = 1 << 20):
        self.merges, self.remembered = merges, remembered
        self.known: dict[str, int] = {}
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None

    def count(self, texts: list[str | None]) -> list[int]:
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [self._pieces(t or "") for t in texts]
        fresh = list({p for pieces, _ in cut for p in pieces}.difference(self.known))
        self._learn(fresh)
        known = self.known
        return [sum(map(known.__getitem__, pieces)) + extra for pieces, extra in cut]

    def _pieces(self, text: str) -> tuple[list[str], int]:
        if self.special is None or not self.special.search(text):
            return self.words.findall(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.words.findall(part)], len(parts) - 1

    def _learn(self, fresh: list[str]) -> None:
        held: list[str] = []
        data: list[bytes] = []
        size = 0
        for i, piece in enumerate(fresh):
            held.append(piece)
            data.append(piece.encode("utf-8", "surrogatepass"))
            size += len(data[-1])
            if size >= ROUND_SYMBOLS or i == len(fresh) - 1:
                self.known.update(zip(held, count_merged(data, self.merges).tolist()))
                held, data, size = [], [], 0


def token_counts(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row's whole text.

    Counts as the vocabulary's own library does without added begin or end tokens: a
    special string inside a text is its one token. Null and empty texts have 0 bytes and
    0 tokens. Repeated rows and null ids are kept; an empty table gives no rows.
    ``vocabulary`` is the path of a byte-level BPE file; the driver reads it and sends
    its arrays (a fixed size of under 2 MB) to the executors.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    @F.pandas_udf("long")
    def take(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(shared.value)
        for texts in parts:
            whole = texts.tolist()
            counts: list[int] = []
            for i in range(0, len(whole), 256):
                counts += counter.count(whole[i : i + 256])
            yield pd.Series(counts, dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), take(F.col(text_col)).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
