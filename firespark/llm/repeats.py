"""Removal of passages that repeat across documents, by distributed prefix doubling.

Positions carry ranks (names) of the strings that start there; the rank of a string of
twice the length is made from the rank pair of its two halves. Short lengths (1, 2, 4, 8,
16, then 24 and 25 with overlapping halves) are doubled inside a task, where all halves
are at hand and a rank is a 64-bit fingerprint of the pair. Spark does the rounds that
need the whole corpus, each one a sort of rank pairs with a rerank in sort order:

1. At length 24 only synchronising positions take part: a 50-byte window is represented
   by the least rank among its 27 strings of 24 bytes. Windows next to each other mostly
   share it, so a run of windows is one row. Equal windows have equal representatives,
   so a rank that stands in one document only is unique and its windows are out. Runs
   that agree whole with a run of a smaller document are settled here as well.
   The ranks of this round keep 48 bits: what is settled here rests on two such values.
2. At length 50, past the threshold, the windows that are still open are sorted by the
   pair (rank of 25 bytes, rank of 25 bytes at offset 25), and every window whose pair
   starts in a smaller document is marked.

Both rounds drop, inside each batch, rows that a row of a smaller document in the same
batch already decides: a string that a third of all documents share enters a sort once
per batch, and the sorted runs are streamed with constant state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import frame, release, stored

LENGTH = 50
HALF = LENGTH // 2
GRAM = 24
#: Strings of GRAM bytes in a window; also the longest run of windows in one row.
SPREAD = LENGTH - GRAM + 1
SLICE = 1 << 18
LAST = 2**63 - 1
_KEEP = np.uint64(0xFFFFFFFFFFFF0000)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_BYTES = np.random.default_rng(50).integers(0, 2**64, 256, dtype=np.uint64)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rank of a rank pair."""
    h = x * _A
    h += y * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def _ranks(data: np.ndarray) -> np.ndarray:
    """Ranks of the 16-byte strings at every position, by four doublings."""
    rank = _BYTES[data]
    for length in (1, 2, 4, 8):
        rank = _join(rank[:-length], rank[length:])
    return rank


def _longer(rank16: np.ndarray, length: int) -> np.ndarray:
    """Ranks of ``length`` (17 to 32) bytes from two 16-byte strings that overlap."""
    return _join(rank16[: len(rank16) - (length - 16)], rank16[length - 16 :])


def runs_of_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(g, c, document, first window, windows - 1) of every run in documents laid end to end.

    ``g`` ranks the run's representative string, ``c`` the run's whole bytes.
    """
    if len(data) < LENGTH:
        nothing = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), nothing, nothing, nothing
    rank16 = _ranks(data)
    gram, half = _longer(rank16, GRAM), _longer(rank16, HALF)
    least = gram
    for size in (1, 2, 4, 8):
        least = np.minimum(least[:-size], least[size:])
    least = np.minimum(least[: len(least) - (SPREAD - 16)], least[SPREAD - 16 :])
    owner = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= ends[owner]
    new = np.r_[True, (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])]
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(least)])
    first, count = first[inside[first]], count[inside[first]]
    pieces = -(-count // SPREAD)
    step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.repeat(first, pieces) + step * SPREAD
    more = np.minimum(np.repeat(count, pieces) - step * SPREAD, SPREAD) - 1
    high = low + more
    whole = _join(_join(half[low], half[low + HALF]), _join(half[high], half[high + HALF])) + more.astype(np.uint64) * _B
    whole ^= whole >> np.uint64(31)
    document = owner[low]
    return least[low], whole * _C, document, low - starts[document], more


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its values; nulls are empty."""
    texts = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _settle(key: np.ndarray, other: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Rows for which the same batch has an equal row of a smaller document."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key ^ (other * _A), kind="stable")
    k, o = key[order], other[order]
    group = np.cumsum(np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])]) - 1
    least = np.minimum.reduceat(d[order], np.flatnonzero(np.r_[True, np.diff(group) > 0]))
    settled = np.zeros(len(key), bool)
    settled[order] = d[order] > least[group]
    return settled


def _batch(names: list[str], columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def _route(settled: np.ndarray, key: np.ndarray, other: np.ndarray, at: np.ndarray, d: np.ndarray):
    """Settled rows need no sort: they are spread by a hash of their place and marked by a negative place."""
    spread = (d.astype(np.uint64) * _A + at.astype(np.uint64)) * _C
    return np.where(settled, spread, key), np.where(settled, np.uint64(0), other), np.where(settled, -at - 1, at)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, v, text) to one row per run of windows: (g, c, d, v, at)."""
    for batch in batches:
        data, offsets = _texts(batch.column("text"))
        d = batch.column("d").to_numpy(zero_copy_only=False)
        v = batch.column("v").to_numpy(zero_copy_only=False)
        parts, begin = [], 0
        while begin < len(d):
            end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + SLICE, side="right")) - 1)
            base = offsets[begin]
            g, c, doc, low, more = runs_of_windows(data[base : offsets[end]], offsets[begin:end] - base, offsets[begin + 1 : end + 1] - base)
            parts.append((g & _KEEP, c & _KEEP, doc + begin, (low << 5) + more))
            begin = end
        if not parts:
            continue
        g, c, doc, at = (np.concatenate(x) for x in zip(*parts))
        g, c, at = _route(_settle(g, c, d[doc]), g, c, at, d[doc])
        yield _batch(["g", "c", "d", "v", "at"], [g, c, d[doc], v[doc], at])


class _Runs:
    """Decides sorted (key, part, d) rows batch by batch; what a key has so far is its state.

    ``open_parts``: rows whose key holds several parts and several documents are passed
    on as open (kind 0). Rows whose (key, part) stands in a smaller document are settled
    (kind 1) either way.
    """

    def __init__(self, open_parts: bool):
        self.open_parts = open_parts
        self.held = [np.zeros(0, np.int64) for _ in range(5)]
        self.ghost = np.zeros(0, bool)
        self.flushed = self.documents = False

    def step(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        ready = rows[4] < 0
        passed = [rows[2][ready], rows[3][ready], -rows[4][ready] - 1, np.ones(int(ready.sum()), np.int8)]
        g, c, d, v, at = (np.concatenate([h, r[~ready]]) for h, r in zip(self.held, rows))
        if not len(g):
            return passed
        ghost = np.r_[self.ghost, np.zeros(len(g) - len(self.ghost), bool)]
        new_key = np.r_[True, g[1:] != g[:-1]]
        new_part = new_key | np.r_[True, c[1:] != c[:-1]]
        keys, part = np.cumsum(new_key) - 1, np.cumsum(new_part) - 1
        settled = d > d[np.flatnonzero(new_part)][part]
        begins = np.flatnonzero(new_key)
        several = np.minimum.reduceat(d, begins) != np.maximum.reduceat(d, begins)
        several[0] |= self.documents
        multi = several & (np.add.reduceat(new_part.astype(np.int64), begins) > 1)
        multi[0] |= self.flushed
        still_open = ~settled & ~ghost & multi[keys] if self.open_parts else np.zeros(len(g), bool)
        # The last key may go on in the next batch.
        tail = slice(int(begins[-1]), len(g))
        if multi[-1] or not self.open_parts:
            keep = np.array([np.flatnonzero(new_part)[-1]])
            self.ghost = np.ones(1, bool)
        else:
            keep = np.flatnonzero(~settled[tail]) + tail.start
            self.ghost = ghost[keep]
        self.flushed, self.documents = bool(multi[-1]), bool(several[-1])
        self.held = [x[keep] for x in (g, c, d, v, at)]
        out = (settled & ~ghost) | still_open
        return [np.concatenate([p, x]) for p, x in zip(passed, (d[out], v[out], at[out], settled[out].astype(np.int8)))]


def _rerank(open_parts: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _Runs(open_parts)
        for batch in batches:
            rows = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("g", "c", "d", "v", "at")]
            out = runs.step(rows)
            if len(out[0]):
                yield _batch(["d", "v", "at", "kind"], out)

    return scan


def _second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, v, text, ats) to one row per open window: its rank pair (g, c), and its place."""
    for batch in batches:
        data, offsets = _texts(batch.column("text"))
        lists = batch.column("ats")
        at = lists.flatten().to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        d = batch.column("d").to_numpy(zero_copy_only=False)
        v = batch.column("v").to_numpy(zero_copy_only=False)
        for i in range(0, max(len(at), 1), 1 << 14):
            low, more, of = at[i : i + (1 << 14)] >> 5, at[i : i + (1 << 14)] & 31, doc[i : i + (1 << 14)]
            if not len(low):
                continue
            size = more + LENGTH
            start = np.cumsum(size) - size
            place = np.repeat(offsets[of] + low - start, size) + np.arange(size.sum())
            half = _longer(_ranks(data[place]), HALF)
            count = more + 1
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            window = np.repeat(start, count) + step
            g, c = half[window], half[window + HALF]
            where, of = (np.repeat(low, count) + step) << 5, np.repeat(of, count)
            g, c, where = _route(_settle(g, c, d[of]), g, c, where, d[of])
            yield _batch(["g", "c", "d", "v", "at"], [g, c, d[of], v[of], where])


def cut(text: str | None, ats) -> tuple[bytes, int, int, bytes]:
    """The text's bytes, bytes removed, maximal removed runs, and the bytes kept."""
    data = b"" if text is None else text.encode("utf-8", "surrogatepass")
    if ats is None or not len(ats):
        return data, 0, 0, data
    ats = np.asarray(ats, np.int64)
    change = np.zeros(len(data) + 1, np.int64)
    np.add.at(change, ats >> 5, 1)
    np.add.at(change, (ats >> 5) + (ats & 31) + LENGTH, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(gone[0])
    return data, int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def _digest(text: Column, ats: Column) -> Column:
    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    def take(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        rows = []
        for text, at in zip(texts, places):
            data, removed, runs, kept = cut(text, at)
            rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        return frame(rows, ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return take(text, ats)


_PLACES = "d long, v long, at long, kind byte"
_ROWS = "g long, c long, d long, v long, at long"


def _ordered(docs: DataFrame, id_col: str) -> DataFrame:
    """(id, d): distinct ids of any type that sorts, numbered in their own order."""
    ids = docs.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    ranged = ids.repartitionByRange("id").sortWithinPartitions("id")
    return stored(ranged.withColumn("d", F.monotonically_increasing_id()), "order")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, d, v, text): ``d`` orders documents; ``v`` tells rows of one id apart, 0 if ids don't repeat.

    Whole numbers stand for themselves; ids of other types, and numbers up to the largest
    one, which null ids take, are numbered first.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    if whole and rows.agg(F.max("id")).head()[0] != LAST:
        placed = rows.withColumn("d", F.coalesce(F.col("id").cast("long"), F.lit(LAST)))
    else:
        placed = rows.join(_ordered(docs, id_col), "id", "left").withColumn("d", F.coalesce("d", F.lit(LAST)))
    repeated = placed.groupBy("d").count().where("count > 1")
    v = F.lit(0).cast("long") if repeated.isEmpty() else F.xxhash64("text")
    return placed.select("id", "d", v.alias("v"), "text")


def _sorted(rows: DataFrame, open_parts: bool) -> DataFrame:
    return rows.repartition("g").sortWithinPartitions("g", "c", "d", "at").mapInArrow(_rerank(open_parts), _PLACES)


def _listed(places: DataFrame) -> DataFrame:
    return places.groupBy("d", "v").agg(F.collect_list("at").alias("ats"))


def repeated_places(keyed: DataFrame) -> DataFrame:
    """(d, v, ats): per document the runs of windows to remove, as first window * 32 + windows - 1."""
    spark = keyed.sparkSession
    texts = keyed.select("d", "v", "text")
    first = stored(_sorted(texts.mapInArrow(_first_round, _ROWS), True), "runs")
    release(spark)
    still_open = texts.join(_listed(first.where("kind = 0")), ["d", "v"])
    second = stored(_sorted(still_open.mapInArrow(_second_round, _ROWS), False).where("kind = 1"), "windows")
    release(spark)
    return _listed(first.where("kind = 1").select("d", "v", "at").unionByName(second.select("d", "v", "at")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_bytes, n_removed, n_spans, kept_sha256, kept) for every row's whole text.

    Removes each byte covered by a 50-byte string that also starts in a document with a
    smaller id; matches never cross documents and are judged on the input. Null and
    empty texts keep nothing. Ids may be of any type that sorts, in its own order. A null
    id is larger than all others; rows of one id don't
    remove from each other. Repeated rows stay repeated. ``kept`` drops characters that
    are cut in the middle; the digest is of the exact bytes.
    """
    keyed = _keyed(docs, id_col, text_col)
    marked = keyed.join(repeated_places(keyed), ["d", "v"], "left")
    return marked.select("id", "text", _digest(F.col("text"), F.col("ats")).alias("x")).select("id", "text", "x.*")
