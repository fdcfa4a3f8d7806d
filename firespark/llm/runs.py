"""Periodic runs of words, located by block convolution.

At each dyadic scale B a text is cut into blocks of B words. The sum of squared
differences between a block and the words d further on is
``sum x^2 + sum y^2 - 2 sum x y`` for all d of [B, 2B) at once, by one number-theoretic
transform per block and window: exact arithmetic modulo 3 * 2^30 + 1. Where it is zero
the block recurs. A run of period q and at least max(24, 3 q) words holds a whole block
of the scale with B <= q < 2B and its recurrence q words on (the scale 8 serves all q
below 16), so every run gets a seed. Seeds are extended to both sides word by word as
long as words q apart agree, which also proves the match beyond the modulus.

Two exact screens spare most transforms: a block recurs within 2B words only if each of
its words does, and what lies in a run of a smaller period gives nothing new.
"""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import WHITE, frame

MODULUS, _GENERATOR = 3 * 2**30 + 1, 5
SHORTEST, TIMES = 24, 3
FIRST = 8
#: Words of one transform at a time, to bound the memory of a task.
_AT_ONCE = 1 << 18


@lru_cache(maxsize=64)
def _twiddles(size: int, inverse: bool) -> np.ndarray:
    root = pow(_GENERATOR, (MODULUS - 1) // size, MODULUS)
    root = pow(root, -1, MODULUS) if inverse else root
    powers = np.ones(1, np.uint64)
    while len(powers) < size // 2:
        step = np.uint64(pow(root, len(powers), MODULUS))
        powers = np.concatenate([powers, powers * step % np.uint64(MODULUS)])
    return powers


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (a power of two long), values below the modulus."""
    p = np.uint64(MODULUS)
    m, size = rows.shape
    x = rows.astype(np.uint64).reshape(m, size, 1)
    half = size // 2
    # Stockham's order: no bit reversal, each step halves the length and doubles the stride.
    while half >= 1:
        w = _twiddles(2 * half, inverse)[:half].reshape(1, half, 1)
        a, b = x[:, :half], x[:, half:]
        x = np.stack([(a + b) % p, (a + (p - b)) % p * w % p], axis=2).reshape(m, half, -1)
        half //= 2
    x = x.reshape(m, size)
    return x * np.uint64(pow(size, -1, MODULUS)) % p if inverse else x


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Squared differences, modulo the modulus, of each block at every offset of its window.

    A window of ``2 * size`` values gives the offsets 0 to ``size - 1``.
    """
    p = np.uint64(MODULUS)
    size = blocks.shape[1]
    flipped = np.zeros((len(blocks), 2 * size), np.uint64)
    flipped[:, :size] = blocks[:, ::-1]
    product = transform(transform(flipped) * transform(windows) % p, inverse=True)[:, size - 1 : 2 * size - 1]
    own = (blocks * blocks % p).sum(axis=1) % p
    squares = np.concatenate([np.zeros((len(windows), 1), np.uint64), np.cumsum(windows * windows % p, axis=1)], axis=1)
    theirs = (squares[:, size : 2 * size] - squares[:, :size]) % p
    return (own[:, None] + theirs + p + p - 2 * product % p) % p


def _reach(x: np.ndarray, at: int, d: int, stop: int, step: int) -> int:
    """How many places from ``at`` on, in the direction of ``step`` up to ``stop``, agree with the word d further."""
    done, width = 0, 32
    total = (stop - at) * step
    while done < total:
        n = min(width, total - done)
        if step > 0:
            lo = at + done
            bad = np.flatnonzero(x[lo : lo + n] != x[lo + d : lo + d + n])
            if len(bad):
                return done + int(bad[0])
        else:
            hi = at - done + 1
            bad = np.flatnonzero(x[hi - n : hi] != x[hi - n + d : hi + d])
            if len(bad):
                return done + n - 1 - int(bad[-1])
        done, width = done + n, width * 2
    return done


def find_runs(ids: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of several texts laid end to end, by start, then period.

    ``ids`` are nonnegative numbers of words, equal for equal words of one text and never
    equal for words of two texts; ``ends`` are the ends of the texts in them.
    """
    n = len(ids)
    if n < SHORTEST:
        return []
    x = ids.astype(np.int64)
    order = np.argsort(x, kind="stable")
    gap = np.full(n, n, np.int64)
    again = x[order[1:]] == x[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    longest = int(np.diff(np.r_[0, ends]).max())
    #: For each word the furthest end of the known runs of shorter periods that hold it.
    far = np.zeros(n, np.int64)
    found: set[tuple[int, int, int]] = set()
    size = FIRST
    while size == FIRST or TIMES * size <= longest:
        starts = np.arange(0, n - size + 1, size)
        live = starts[np.maximum.reduceat(gap[: len(starts) * size], starts) < 2 * size]
        live = live[far[live] < np.minimum(live + 3 * size - 1, n)]
        later = []
        for d, s in _seeds(x, live, size):
            if s + d + size <= far[s] or any(q == d and a <= s and s + d + size <= a + length for a, length, q in later[-1:]):
                continue
            right = _reach(x, s, d, n - d, 1)
            left = _reach(x, s - 1, d, -1, -1)
            length = left + right + d
            if right < size or length < max(SHORTEST, TIMES * d):
                continue
            found.add((s - left, length, d))
            if d <= size:
                far[s - left : s + right + d] = np.maximum(far[s - left : s + right + d], s + right + d)
            later.append((s - left, length, d))
        for a, length, _ in later:
            far[a : a + length] = np.maximum(far[a : a + length], a + length)
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def _seeds(x: np.ndarray, live: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(distance, block start) of the zero-mismatch recurrences of the live blocks, in order.

    Of blocks of one distance that follow one another only the first is given.
    """
    n = len(x)
    rows = max(1, _AT_ONCE // (2 * size))
    distance, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # The first scale has all the shorter distances too: two windows.
    for low in (1, 1 + size) if size == FIRST else (size,):
        for i in range(0, len(live), rows):
            s = live[i : i + rows]
            place = s[:, None] + np.arange(low, low + 2 * size)[None]
            # Beyond the end stands a number that no word has.
            window = np.where(place < n, x[np.minimum(place, n - 1)], n + 1).astype(np.uint64)
            block = x[s[:, None] + np.arange(size)[None]].astype(np.uint64)
            row, offset = np.nonzero(mismatches(block, window) == 0)
            distance.append(offset + low)
            start.append(s[row])
    d, s = np.concatenate(distance), np.concatenate(start)
    fits = s + d + size <= n
    d, s = d[fits], s[fits]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    follows = np.r_[False, (d[1:] == d[:-1]) & (s[1:] == s[:-1] + size)] if len(d) else np.zeros(0, bool)
    return list(zip(d[~follows].tolist(), s[~follows].tolist()))


def number_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of several texts laid end to end, own ones for each text, and the texts' ends."""
    ids: list[int] = []
    ends = []
    base = 0
    for words in texts:
        known: dict[bytes, int] = {}
        ids += [known.setdefault(w, base + len(known)) for w in words]
        base += len(known)
        ends.append(len(ids))
    return np.array(ids, np.int64), np.array(ends, np.int64)


def text_runs(texts: list[list[bytes]], at_once: int = 200_000) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, those of short texts looked for together."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lo = 0
    while lo < len(texts):
        hi, total = lo, 0
        while hi < len(texts) and (hi == lo or total + len(texts[hi]) <= at_once):
            total += len(texts[hi])
            hi += 1
        ids, ends = number_words(texts[lo:hi])
        for start, length, period in find_runs(ids, ends):
            own = int(np.searchsorted(ends, start, side="right"))
            out[lo + own].append((start - (int(ends[own - 1]) if own else 0), length, period))
        lo = hi
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


SCHEMA = "n_words long, runs array<struct<start: long, length: long, period: long>>, longest struct<start: long, length: long, period: long>, collapsed string"


def periodic_runs(text: Column) -> Column:
    """(n_words, runs, longest, collapsed) of a text: all maximal runs of at least three periods and 24 words.

    ``runs`` are in order of start, then period; ``longest`` is the one of the greatest exact
    length by period (ties: the smallest start, then period; null without runs); ``collapsed``
    is the text's words joined by single spaces without those that repeat a run's first
    period. Words are bounded by ASCII white space. Null, empty and blank texts have no
    words and no runs. Texts are worked through whole.
    """

    @F.pandas_udf(SCHEMA)
    def take(column: pd.Series) -> pd.DataFrame:
        texts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in column]
        split = [t.split() for t in texts]
        rows = []
        for words, runs in zip(split, text_runs(split)):
            named = [dict(zip(("start", "length", "period"), r)) for r in runs]
            best = max(named, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
            rows.append((len(words), named, best, b" ".join(collapse(words, runs)).decode("utf-8", "surrogatepass")))
        return frame(rows, ["n_words", "runs", "longest", "collapsed"])

    return take(text)


def with_repeated_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10) -> DataFrame:
    """(id, text): each ``every``-th document, by its id's crc32, goes on repeating a few of its words from some word on.

    Rows whose id is null, and texts without words, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), h.alias("h"))
    # Words are a column of their own: named twice below, they must not be found twice.
    rows = rows.withColumn("words", F.when(F.col("h") % every == 0, F.regexp_extract_all("text", F.lit(WHITE), F.lit(0))))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / every)
    rows = rows.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + g % 8)))
    source = lambda i: (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    repeated = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", source(i)))), " ")
    return rows.select("id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))
