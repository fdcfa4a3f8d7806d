"""Spelling variants: words one edit apart, found in a bit-sliced position index.

A block of the vocabulary is indexed by bit sets: one per (position, letter), a bit per
word. A query runs over its own letters and keeps four sets of words: those that agree so
far, and those with one letter replaced, one more or one less, compared at the same, the
next or the last position. Each step is a few AND and OR of machine words, 64 words of
the vocabulary at a time.

Blocks keep the search from being all against all. A target is cut into parts of two
letters; one edit damages one of them, so the query agrees with the target before and
after that part. These are the keys, as running hashes of both ends. A key's targets
differ in two letters at most, so their number is bounded by the alphabet, not by the
vocabulary, and a word has one key per two letters, however long it is. Words that are
alone with a key are left out; the others are packed whole keys at a time into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import stored

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PART = 2
_PRIME = (1 << 61) - 1
_BASE = 0x1F3D5B79


def vocabulary(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 7, least: int = 2, edit_every: int = 31
) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that stand at least ``least`` times.

    A word is a maximal run of letters with A-Z lowered. Of the runs whose crc32 with the
    document's id ``edit_every`` divides, one letter is deleted first (0: none). Null texts
    have no words; a null id counts as an empty one. Repeated rows count each time.
    """
    runs = F.regexp_extract_all(F.col(text_col), F.lit(LETTERS + "{%d,}" % shortest), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run")
    if edit_every:
        rows = rows.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        word = F.when(F.col("h") % edit_every == 0, cut).otherwise(F.col("run"))
    counted = rows.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least)


def part_keys(word: str) -> tuple[list[int], list[int]]:
    """Keys of a word as a target, and those that it asks for as a query.

    A key names a target's length, the damaged part and a hash of what stands before and
    after it; equal strings have equal keys.
    """
    codes = list(map(ord, word))
    n = len(codes)
    ahead, behind, power = [0], [0], [1]
    for c in codes:
        ahead.append((ahead[-1] * _BASE + c) % _PRIME)
        power.append(power[-1] * _BASE % _PRIME)
    for i, c in enumerate(reversed(codes)):
        behind.append((behind[-1] + c * power[i]) % _PRIME)

    def keys(length: int) -> list[int]:
        out = []
        for a in range(0, length, PART):
            after = length - min(a + PART, length)
            if a <= n and after <= n and a + after <= n:
                out.append(hash((length, a, ahead[a], behind[after])))
        return out

    return keys(n), keys(n - 1) + keys(n) + keys(n + 1)


def _pack(block_words: int):
    """Rows (key, word, target) sorted by key to blocks (block, word, target) of whole keys with two words or more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        number = 0

        def emit(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            key, word, target = rows
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            if not len(starts):
                return
            size = np.diff(np.r_[starts, len(key)])
            # A group is of use if a target and a query of two different words meet in it.
            mixed = np.maximum.reduceat(word, starts) != np.minimum.reduceat(word, starts)
            mixed &= np.logical_or.reduceat(target, starts)
            keep = np.repeat(mixed, size)
            group = np.repeat(np.cumsum(mixed), size)[keep]
            word, target = word[keep], target[keep]
            if not len(word):
                return
            # Groups stay whole: a block ends with the group in which it has enough targets.
            before = np.r_[0, np.cumsum(target)]
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            block = np.repeat(before[first] // block_words, np.diff(np.r_[first, len(word)]))
            rows = np.unique(np.stack([block, word, target.astype(np.int64)]), axis=1)
            name = (part << 40) + number + rows[0]
            number += int(rows[0][-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(name), pa.array(rows[1]), pa.array(rows[2].astype(bool))], names=["block", "word", "target"]
            )

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "target")]
            held = [np.concatenate(c) for c in zip(held, rows)]
            if len(held[0]) > 200_000:
                last = int(np.searchsorted(held[0], held[0][-1]))
                yield from emit([c[:last] for c in held])
                held = [c[last:] for c in held]
        yield from emit(held)

    return pack


class PositionIndex:
    """Bit sets over words: bit ``w`` of set (position, letter) says that word ``w`` has the letter there."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.width = -(-len(words) // 64)
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64) for w in words]
        letters = np.concatenate(codes)
        places = np.concatenate([np.arange(len(c)) for c in codes])
        owner = np.repeat(np.arange(len(words)), self.lengths)
        self.names, row = np.unique((places << 21) | letters, return_inverse=True)
        self.sets = np.zeros((len(self.names) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.sets, (row, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        self.of_length = {int(n): self._bits(np.flatnonzero(self.lengths == n)) for n in np.unique(self.lengths)}

    def _bits(self, members: np.ndarray) -> np.ndarray:
        bits = np.zeros(self.width, np.uint64)
        np.bitwise_or.at(bits, members >> 6, np.uint64(1) << (members & 63).astype(np.uint64))
        return bits

    def having(self, place: int, letters: np.ndarray) -> np.ndarray:
        """For each letter the words that have it at the place; none before the first one."""
        names = (np.int64(place) << 21) | letters
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return self.sets[np.where((place >= 0) & (self.names[at] == names), at, len(self.names))]

    def one_edit(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word): all pairs that are exactly one inserted, deleted or replaced letter apart."""
        found_q, found_w = [], []
        by_length: dict[int, list[int]] = {}
        for i, q in enumerate(queries):
            by_length.setdefault(len(q), []).append(i)
        zeros = np.zeros(self.width, np.uint64)
        for n, members in by_length.items():
            if not {n - 1, n, n + 1} & self.of_length.keys():
                continue
            for lo in range(0, len(members), 4096):
                mine = np.array(members[lo : lo + 4096])
                codes = np.frombuffer("".join(queries[i] for i in mine).encode("utf-32-le"), np.uint32).reshape(len(mine), n).astype(np.int64)
                shape = (len(mine), self.width)
                same = np.full(shape, ~np.uint64(0))
                replaced, more, less = (np.zeros(shape, np.uint64) for _ in range(3))
                for i in range(n):
                    here = self.having(i, codes[:, i])
                    # The word's letter too many stands before this one, at this place or earlier.
                    more = (more | same) & self.having(i + 1, codes[:, i])
                    less = (less & self.having(i - 1, codes[:, i])) | same
                    replaced = (replaced & here) | (same & ~here)
                    same &= here
                ends = (
                    (replaced & self.of_length.get(n, zeros)) | ((more | same) & self.of_length.get(n + 1, zeros))
                    | (less & self.of_length.get(n - 1, zeros))
                )
                bits = np.unpackbits(ends.view(np.uint8), axis=1, bitorder="little")
                q, w = np.nonzero(bits)
                found_q.append(mine[q])
                found_w.append(w)
        if not found_q:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found_q), np.concatenate(found_w)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, id, word, target) sorted by block to pairs (a, b) one edit apart, from each side."""
    run, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        targets = [(i, w) for i, w, t in held if t]
        asked = [(i, w) for i, w, t in held if not t]
        if targets and asked:
            q, w = PositionIndex([t[1] for t in targets]).one_edit([a[1] for a in asked])
            a = np.array([x[0] for x in asked], np.int64)[q]
            b = np.array([x[0] for x in targets], np.int64)[w]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        for block, i, w, t in zip(*(batch.column(c).to_pylist() for c in ("block", "id", "word", "target"))):
            if block != run:
                yield from close()
                run, held = block, []
            held.append((i, w, t))
    yield from close()


def near_words(words: DataFrame, block_words: int = 1024) -> DataFrame:
    """(a, b) for all pairs of ids of (id, word) whose words are exactly one edit apart, both ways round.

    Words are distinct. No pair is capped or dropped; an empty table gives no rows.
    """

    @F.pandas_udf("array<struct<key: long, target: boolean>>")
    def keys(column: pd.Series) -> pd.Series:
        out = []
        for word in column:
            own, asked = part_keys(word)
            out.append([{"key": k, "target": True} for k in own] + [{"key": k, "target": False} for k in asked])
        return pd.Series(out, dtype=object)

    keyed = words.select("id", F.explode(keys("word")).alias("k")).select("k.key", "id", "k.target")
    blocks = stored(
        keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_pack(block_words), "block long, word long, target boolean"), "blocks"
    )
    spelled = blocks.join(words.select(F.col("id").alias("word"), F.col("word").alias("spelling")), "word").select(
        "block", F.col("word").alias("id"), F.col("spelling").alias("word"), "target"
    )
    pairs = spelled.repartition("block").sortWithinPartitions("block").mapInArrow(_search, "a long, b long")
    return stored(pairs.distinct(), "near-words")


def variants(words: DataFrame, share: int = 10) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every row of (word, n).

    A word's form is its near word of the largest n (ties: the first in code-point order) if
    that n is ``share`` times its own at least, else null. Forms are followed to the last by
    doubling the steps; n grows with each one, so there are no rings.
    """
    named = stored(words.withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(named.select("id", "word"))
    right = named.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    # The largest n, then the first word: the least of (-n, word).
    best = near.join(right, "b").groupBy("a").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form"), F.col("b"))).alias("best")
    )
    joined = named.join(best.withColumnRenamed("a", "id"), "id", "left")
    follows = -F.col("best.m") >= share * F.col("n")
    formed = stored(
        joined.select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"),
            F.when(follows, -F.col("best.m")).alias("form_n"), F.when(follows, F.col("best.b")).alias("next"),
        ), "forms",
    )
    # Only words with a form take part; all others end a chain.
    step = formed.where("next is not null").select("id", "next")
    while True:
        onward = step.select(F.col("id").alias("next"), F.col("next").alias("after"))
        moved = stored(step.join(onward, "next", "left").select("id", F.coalesce("after", "next").alias("next"), F.col("after").isNotNull().alias("went")), "roots")
        step = moved.select("id", "next")
        if moved.where("went").isEmpty():
            break
    last = step.join(named.select(F.col("id").alias("next"), F.col("word").alias("end")), "next").select("id", "end")
    return formed.join(last, "id", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("end", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variants of the vocabulary of ``docs``; columns of other names play no part."""
    return variants(stored(vocabulary(docs, id_col, text_col), "vocabulary"))
