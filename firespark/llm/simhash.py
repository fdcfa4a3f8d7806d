"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint takes one bit per majority of the shingles' 64-bit hashes. Every bit
position is given a nonzero vector of ``radius + 1`` bits; table ``v`` keeps the
positions whose vector has odd parity with ``v``. Two fingerprints that differ in at
most ``radius`` positions give ``radius`` equations in ``radius + 1`` unknowns over
GF(2), so some nonzero ``v`` drops all the differing positions: the pair surely
collides in that table. There is no second chance to take and no pair to lose.

A bucket of up to 65 536 fingerprints is linked inside its task by trees that shrink as
they grow. A larger one is never compared: its open bits are split into ``radius + 1`` parts, one of which must agree
whole (pigeonhole), and its rows go to the next round under the finer keys. When no
more than ``radius`` bits are open, all rows of a bucket are linked to its first one.

The pipeline's classes (``similar_classes``) start from these links and add those of Jaccard
similarity: no radius in reach covers block edits. Their candidates share a rare shingle (prefix filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import arrow_rows, discard, fold, frame, release, spans, stored
from firespark.operators.components import connected_components

SEED = 42
BITS = 64
#: A pair is linked in this many of the tables it meets in. One would connect the same
#: fingerprints; the links bear on nothing but that (no similarity is judged along them).
REPEATS = 3
#: Rows that a Python task of the near-duplicate stage is given at a time.
BATCH = 2_000


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of every shingle, repeats included; of all words if they are fewer; none without words."""
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if shingle == 1:
        return [digest(w, SEED) for w in words]
    joined, starts, ends = spans(words)
    if len(words) < shingle:
        return [digest(joined, SEED)]
    first, last = starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(first, last)]


def fingerprint(text: str | None, shingle: int, distinct: bool = False) -> int:
    """Signed 64-bit SimHash of the word shingles, each as often as it stands (or once); 0 without words."""
    hashes = shingle_hashes(fold(text).split(), shingle)
    if not hashes:
        return 0
    if distinct:
        hashes = list(set(hashes))
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp long): the fingerprint of every row's whole text.

    Null, empty and blank texts have the fingerprint 0. Repeated rows and null ids are kept.
    """

    @F.pandas_udf("long")
    def take(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return docs.select(F.col(id_col).alias("id"), take(F.col(text_col)).alias("fp"))


def covering_masks(radius: int) -> list[int]:
    """Signed masks of the bit positions that each table keeps."""
    vectors = (1 << (radius + 1)) - 1
    order = np.random.default_rng(SEED).permutation(BITS)
    of = {int(bit): 1 + i % vectors for i, bit in enumerate(order)}
    masks = []
    for v in range(1, vectors + 1):
        mask = sum(1 << bit for bit in range(BITS) if (of[bit] & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def _parts(mask: int, parts: int) -> list[int]:
    """The mask with each of ``parts`` shares of its open bits added."""
    bits = [b for b in range(BITS) if not (mask >> b) & 1]
    return [mask | sum(1 << b for b in bits[i::parts]) for i in range(parts)]


def near_trees(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(child, parent): a tree of links within the radius over each connected part of distinct ``fps``.

    Values reached leave the set that the next ones are compared with, so a crowd of near
    copies is settled in about as many compares as it has members.
    """
    x = fps.view(np.uint64)
    left = np.arange(len(fps))
    children, parents = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for i in range(0, len(front), 64):
                part = front[i : i + 64]
                near = np.bitwise_count(x[part, None] ^ x[None, left]) <= radius
                hit = near.any(axis=0)
                if hit.any():
                    reached.append(left[hit])
                    parents.append(part[near[:, hit].argmax(axis=0)])
                    left = left[~hit]
                    if not len(left):
                        break
            children += reached
            front = np.concatenate(reached) if reached else left[:0]
    if not children:
        return fps[:0], fps[:0]
    return fps[np.concatenate(children)], fps[np.concatenate(parents)]


def _bucket_scan(radius: int, bucket: int):
    """Rows sorted by (mask, key, fp) to links (kind 0) and rows of the next round (kind 1)."""

    def signed(values: np.ndarray) -> np.ndarray:
        return values.astype(np.uint64).view(np.int64)

    masks = np.array(covering_masks(radius), np.int64)
    place = {m: i for i, m in enumerate(masks.tolist())}

    def early(mask: int, child: np.ndarray, parent: np.ndarray) -> np.ndarray:
        """Links in one of the first REPEATS tables that their pair meets in.

        The link of a pair's first table alone keeps all connected: the others of the pair's
        parts are joined, table by table, by trees that were kept before.
        """
        differ, at = child ^ parent, place[mask]
        met = [np.count_nonzero((differ[i : i + 4096, None] & masks[None, :at]) == 0, axis=1) for i in range(0, len(differ), 4096)]
        return np.concatenate(met) < REPEATS

    def finish(mask: int, fps: np.ndarray, out: list) -> None:
        if len(fps) < 2:
            return
        child, parent = near_trees(fps, radius)
        if len(child) and mask in place:
            keep = early(mask, child, parent)
            child, parent = child[keep], parent[keep]
        if len(child):
            out.append((np.zeros(len(child), np.int8), child, parent, child))

    def refine(mask: int, fps: np.ndarray, out: list) -> None:
        for finer in _parts(mask & (2**64 - 1), radius + 1):
            m = signed(np.full(len(fps), finer, np.uint64))
            out.append((np.ones(len(fps), np.int8), m, fps & m, fps))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: tuple[int, int] | None = None
        held, first, crowded = np.zeros(0, np.int64), 0, False
        out: list = []

        def close() -> None:
            if run is not None and not crowded:
                finish(run[0], held, out)

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                cols = [np.concatenate([o[i] for o in out]) for i in range(4)]
                out.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "x", "y", "fp"])

        for batch in batches:
            mask, key, fp = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("mask", "key", "fp"))
            if not len(fp):
                continue
            new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
            for lo, hi in zip(new.tolist(), np.r_[new[1:], len(fp)].tolist()):
                here = (int(mask[lo]), int(key[lo]))
                part = fp[lo:hi]
                if here != run:
                    close()
                    run, held, first, crowded = here, np.zeros(0, np.int64), int(part[0]), False
                open_bits = BITS - (here[0] & (2**64 - 1)).bit_count()
                if open_bits <= radius:
                    crowded = True
                    others = part[part != first]
                    out.append((np.zeros(len(others), np.int8), others, np.full(len(others), first), others))
                elif crowded:
                    refine(here[0], part, out)
                else:
                    held = np.concatenate([held, part])
                    if len(held) > bucket:
                        crowded = True
                        refine(here[0], held, out)
                        held = np.zeros(0, np.int64)
            if sum(len(o[0]) for o in out) > 50_000:
                yield from flush()
        close()
        yield from flush()

    return scan


def covering_links(fps: DataFrame, radius: int = 2, bucket: int = 65_536) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints within ``radius`` bits.

    ``fps`` has one row per distinct ``fp``. Each link is a pair within the radius; those
    that a chain of others in the same bucket already implies are left out.
    """
    keyed = [F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for m in covering_masks(radius)]
    level = fps.select("fp", F.explode(F.array(*keyed)).alias("k")).select("k.mask", "k.key", "fp")
    links = None
    while True:
        found = stored(
            level.repartition("mask", "key")
            .sortWithinPartitions("mask", "key", "fp")
            .mapInArrow(_bucket_scan(radius, bucket), "kind byte, x long, y long, fp long"),
            "covering",
        )
        some = found.where("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
        links = some if links is None else links.unionByName(some)
        level = found.where("kind = 1").select(F.col("x").alias("mask"), F.col("y").alias("key"), "fp")
        if level.isEmpty():
            return links


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2
) -> DataFrame:
    """(id, fp, component_id): every row with the least id reachable through links.

    Copies share a fingerprint and are one vertex; only distinct fingerprints are
    compared. Rows with a null id keep a row and take their class's least non-null id
    (null if it has none). Repeated rows stay repeated; an empty table gives no rows.
    """
    marked = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("id").alias("least"))
    component = connected_components(covering_links(distinct.select("fp"), radius))
    grouped = distinct.join(component.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("fp", "component_id")
    return marked.join(classes, "fp").select("id", "fp", "component_id")


def _vertex_links(vertices: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect exactly the ``vertices(vertex, fp)`` whose fingerprints are within ``radius`` bits."""
    first = vertices.groupBy("fp").agg(F.min("vertex").alias("first"))
    same = vertices.join(first, "fp").where("vertex <> first").select(F.col("vertex").alias("a"), F.col("first").alias("b"))
    of = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"_{c}"))
    near = covering_links(first.select("fp"), radius).join(of("a"), "a").join(of("b"), "b")
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def _shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    return np.unique(np.array(shingle_hashes(fold(text).split(), shingle), dtype=np.uint64).view(np.int64))


def _least_overlap(similarity: float, sizes):
    """The least number of common elements of two sets of ``sizes`` in all whose Jaccard similarity suffices."""
    return np.ceil(similarity / (1 + similarity) * sizes - 1e-6)


def common_shingles(docs: DataFrame, text_col: str, shingle: int, sample: int = 5_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes ascending, rows with it): shingles that stand in three or more rows of a sample.

    They only set the order in which the shingles of a document are keyed: any order finds
    all pairs, one with common shingles last finds them by few candidates.
    """

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_set(t, shingle) for t in texts], dtype=object)

    share = -(-docs.count() // sample)
    some = docs.where(F.pmod(F.xxhash64(text_col), F.lit(max(1, share))) == 0) if share > 1 else docs
    counts = some.select(F.explode(hashes(text_col)).alias("s")).groupBy("s").count().where("count > 2")
    top = counts.orderBy(F.desc("count"), "s").limit(500_000).toArrow()
    found, rows = (top.column(n).to_numpy() for n in ("s", "count"))
    order = np.argsort(found)
    return found[order], rows[order]


def rare_prefix(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The rarest of a set's hashes, of which any set similar enough has one among its own."""
    if not len(hashes):
        return hashes
    known, rows = common
    weight = np.zeros(len(hashes), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        weight = np.where(known[at] == hashes, rows[at], 0)
    length = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1
    return hashes[np.lexsort((hashes, weight))[:length]]


#: Sets that share a key are paired with each other up to this many; of more, each is paired with two first.
FEW = 4


def _key_scan(similarity: float):
    """Rows sorted by key to pairs of vertices (kind 0) and (key, vertex) of keys with more than FEW (kind 1)."""

    def settle(key: np.ndarray, vertex: np.ndarray, n: np.ndarray, pos: np.ndarray) -> list:
        out: list = []
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[starts, len(key)])
        many = np.repeat(size, size)
        for d in range(1, FEW):
            i = np.flatnonzero((many[:-d] <= FEW) & (key[:-d] == key[d:])) if len(key) > d else np.zeros(0, np.int64)
            # Enough must be left behind the first key that a pair shares.
            ahead = np.minimum(n[i] - pos[i], n[i + d] - pos[i + d])
            i = i[ahead >= _least_overlap(similarity, n[i] + n[i + d])]
            out.append((np.zeros(len(i), np.int8), vertex[i], vertex[i + d]))
        crowd = many > FEW
        if crowd.any():
            v, n, pos, size = vertex[crowd], n[crowd], pos[crowd], size[size > FEW]
            starts = np.r_[0, np.cumsum(size)[:-1]]
            for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                mixed = v.view(np.uint64) * np.uint64(odd)
                # The first row of each key's least value, should a vertex stand twice in it.
                least = np.flatnonzero(mixed == np.repeat(np.minimum.reduceat(mixed, starts), size))
                root = np.repeat(least[np.searchsorted(least, starts)], size)
                ahead = np.minimum(n - pos, n[root] - pos[root])
                i = np.flatnonzero((ahead >= _least_overlap(similarity, n + n[root])) & (v != v[root]))
                out.append((np.zeros(len(i), np.int8), v[i], v[root[i]]))
            out.append((np.ones(len(v), np.int8), key[crowd], v))
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4

        def give(rows: list) -> Iterator[pa.RecordBatch]:
            if len(rows[0]) > 1:
                cols = [np.concatenate(c) for c in zip(*settle(*rows))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "x", "y"])

        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "vertex", "n", "pos")]
            rows = [np.concatenate(c) for c in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [c[last:] for c in rows]
            yield from give([c[:last] for c in rows])
        yield from give(held)

    return scan


def similar_trees(vertex: np.ndarray, known: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that, with the ``known`` classes, connect exactly the sets that are similar enough.

    A set leaves only when it is in the class that is being grown; that class's members
    are compared with all that have not left.
    """
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    ends = np.cumsum(size)
    tokens = [flat[e - n : e] for e, n in zip(ends.tolist(), size.tolist())]
    here = np.zeros(len(words), bool)
    left = np.ones(len(sets), bool)
    links: list[tuple[int, int]] = []
    rest = np.zeros(0, np.int64)
    while left.any():
        front = np.flatnonzero(left & (known == known[left.argmax()])).tolist()
        left[front] = False
        stale = True
        while front and left.any():
            one = front.pop()
            if stale or 2 * np.count_nonzero(left[rest]) < len(rest):
                rest = np.flatnonzero(left)
                joined = np.concatenate([tokens[i] for i in rest.tolist()])
                starts = np.r_[0, np.cumsum(size[rest])[:-1]]
                stale = False
            here[tokens[one]] = True
            both = np.add.reduceat(here[joined], starts, dtype=np.int64)
            here[tokens[one]] = False
            hit = rest[left[rest] & (both >= _least_overlap(similarity, size[rest] + size[one]))]
            if len(hit):
                classes, first = np.unique(known[hit], return_index=True)
                links += [(int(vertex[one]), int(v)) for v in vertex[hit[first]]]
                more = np.flatnonzero(left & np.isin(known, classes))
                left[more] = False
                front += more.tolist()
    return links


def _set_rows(batch: pa.RecordBatch) -> list[np.ndarray]:
    column = batch.column("set")
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    # Copies: a view would keep the whole batch while a group lasts.
    return [values[lo:hi].copy() for lo, hi in zip(ends[:-1], ends[1:])]


def _crowd_scan(similarity: float):
    """Rows (group, vertex, known, set) sorted by group to links (a, b) of similar sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                vertex, known, sets = zip(*held)
                links = similar_trees(np.array(vertex), np.array(known), list(sets), similarity)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

        for batch in batches:
            groups, vertices, known = (batch.column(c).to_pylist() for c in ("group", "vertex", "known"))
            for group, v, k, one in zip(groups, vertices, known, _set_rows(batch)):
                if group != run:
                    yield from close()
                    run, held = group, []
                held.append((v, k, one))
        yield from close()

    return scan


def parity(hashes: np.ndarray) -> bytes:
    """A bit per residue of the hashes, set where an odd number of them falls: about as many bits as hashes.

    Bits in which two such maps differ are at most as many as elements that only one set has.
    """
    bits = 64
    while bits < len(hashes):
        bits *= 2
    return np.packbits(np.bincount(hashes & (bits - 1), minlength=bits) & 1, bitorder="little").tobytes()


def _folded(words: np.ndarray, width: int) -> np.ndarray:
    """Parity maps (last axis: 64-bit words) brought down to a smaller power of two."""
    while words.shape[-1] > width:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def could_be_similar(x: bytes, nx: int, y: bytes, ny: int, similarity: float) -> bool:
    """False only for sets that can't be similar enough: their parity maps differ in too many bits."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    width = min(len(a), len(b))
    apart = int(np.bitwise_count(_folded(a, width) ^ _folded(b, width)).sum())
    return nx + ny - apart >= 2 * _least_overlap(similarity, nx + ny)


def near_by_parity(known: np.ndarray, n: np.ndarray, maps: list[bytes], similarity: float) -> np.ndarray:
    """Which sets could be similar to one of another known class, by size and parity map."""
    width = np.array([len(m) // 8 for m in maps])
    near = np.zeros(len(maps), bool)
    places = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    words = {w: np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), w) for w, at in places.items()}
    for w, at in places.items():
        # Sets of more than twice the width are more than twice the size.
        for other in (w, 2 * w):
            if other not in places:
                continue
            with_, theirs = places[other], _folded(words[other], w)
            for i, mine in zip(at.tolist(), words[w]):
                apart = np.bitwise_count(theirs ^ mine).sum(axis=1)
                both = n[with_] + n[i]
                hit = (both - apart >= 2 * _least_overlap(similarity, both)) & (known[with_] != known[i])
                if hit.any():
                    near[i] = True
                    near[with_[hit]] = True
    return near


def _parity_scan(similarity: float):
    """Rows (group, key, vertex, known, n, bits) sorted by group to (key, vertex) that need a look at the sets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = None, []

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                key, vertex, known, n, maps = zip(*held)
                near = near_by_parity(np.array(known), np.array(n), list(maps), similarity)
                if near.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(key)[near]), pa.array(np.array(vertex)[near])], names=["key", "vertex"]
                    )

        for batch in batches:
            for group, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "key", "vertex", "known", "n", "bits"))):
                if group != run:
                    yield from close()
                    run, held = group, []
                held.append(row)
        yield from close()

    return scan


def _star_scan(similarity: float):
    """Rows (x, salt, vertex, set) sorted by group, ``x`` itself first, to the similar pairs (a, b) of each with x."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, own = None, np.zeros(0, np.int64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for x, v, one in zip(batch.column("x").to_pylist(), batch.column("vertex").to_pylist(), _set_rows(batch)):
                if v == x:
                    root, own = x, one
                    continue
                at = np.minimum(np.searchsorted(own, one), len(own) - 1)
                if x == root and np.count_nonzero(own[at] == one) >= _least_overlap(similarity, len(own) + len(one)):
                    found.append((x, v))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    return scan


def _proved(pairs: DataFrame, sets: DataFrame, similarity: float, fan: int = 512) -> DataFrame:
    """(a, b): the distinct ``pairs(x, y)`` whose sets are similar enough.

    The set of ``y`` goes to its pair's task, that of ``x`` once per ``fan`` of its pairs.
    """
    crowd = pairs.groupBy("x").agg(F.ceil(F.count("*") / fan).alias("parts"))
    salted = pairs.join(crowd, "x").select("x", F.pmod(F.xxhash64("y"), F.col("parts")).alias("salt"), "y")
    roots = salted.select("x", "salt").distinct().withColumn("vertex", F.col("x"))
    rows = salted.withColumnRenamed("y", "vertex").unionByName(roots).join(sets, "vertex")
    first = F.col("vertex") != F.col("x")
    grouped = rows.repartition("x", "salt").sortWithinPartitions("x", "salt", first)
    return grouped.select("x", "vertex", "set").mapInArrow(_star_scan(similarity), "a long, b long")


def _chunked(rows: DataFrame, size: int) -> DataFrame:
    """``rows(key, vertex, …)`` with a ``group``: every two rows of a key meet in one, none has over about twice ``size`` rows.

    A key of more rows is cut into chunks; a group holds two of them.
    """
    chunks = rows.groupBy("key").agg(F.ceil(F.count("*") / size).alias("chunks"))
    own = F.pmod(F.xxhash64("vertex", F.lit(7)), F.col("chunks"))
    # With another chunk, never with itself alone, unless there is one only.
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda j: j != F.col("own"))
    )
    spread = rows.join(chunks, "key").withColumn("own", own).withColumn("other", F.explode(others))
    group = F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other"))
    return spread.withColumn("group", group).drop("chunks", "own", "other")


def _labelled(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """``pairs(x, y)`` whose ends are in different classes."""
    of = lambda c: component.select(F.col("vertex").alias(c), F.col("component").alias(f"_{c}"))
    named = pairs.join(of("x"), "x", "left").join(of("y"), "y", "left")
    return named.where(~F.coalesce("_x", "x").eqNullSafe(F.coalesce("_y", "y"))).select("x", "y")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    chunk: int = 1_000, parity_chunk: int = 20_000, radius: int | None = None,
) -> DataFrame:
    """(id, h, component_id): classes of documents whose five-word shingles agree to ``similarity`` or more.

    All pairs of that similarity are connected, whatever the kind of edit. Two such sets of
    shingles share one of the rarest ``n - ceil(similarity n) + 1`` of each, in any common
    order; these are the keys (prefix filter). Sets that share a key are paired: where many
    share one, each with two of them first. A pair's parity maps, a bit per shingle, give
    an exact bound that rules most false ones out. The whole sets of the others are compared,
    a forest of pairs at a time: pairs within a class that is proved need no look.
    In keys whose members are in different classes then, members that could be similar by
    their maps are compared set by set in tasks of two chunks of the crowd, which give links
    and never pairs.
    With a ``radius``, texts whose SimHash fingerprints (three-word shingles, repeats included) differ in at most so
    many bits are linked first, by covering masks; pairs that these links connect need no look.
    ``h`` is a hash of the text that tells rows of one id apart. Texts of equal words,
    null and empty ones among them, are one class. Shingles are compared by 64-bit hashes.
    """
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, text_col, shingle))

    @F.pandas_udf("words binary, n int, keys array<long>, bits binary, fp long")
    def mark(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = _shingle_set(t, shingle)
            words = xxhash.xxh128_digest(b" ".join(fold(t).split()))
            fp = None if radius is None else fingerprint(t, 3)
            rows.append((words, len(hashes), rare_prefix(hashes, common.value, similarity), parity(hashes), fp))
        return frame(rows, ["words", "n", "keys", "bits", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), mark(F.col(text_col)).alias("m"))
    spark = docs.sparkSession
    heavy = stored(rows.select("id", "h", "m.words", "m.n", "m.keys", "m.bits", "m.fp"), "marks")
    # One vertex per sequence of words; any of its rows can stand for it.
    keyed = stored(
        heavy.groupBy("words").agg(
            F.min("id").alias("least"), F.min(F.struct("id", "h")).alias("row"), *[F.first(c).alias(c) for c in ("n", "keys", "bits", "fp")]
        ).withColumn("vertex", F.monotonically_increasing_id()),
        "vertices",
    )
    marked = stored(heavy.select("id", "h", "words"), "rows")
    discard(heavy)
    vertex = keyed.drop("keys")
    found = stored(
        keyed.select("vertex", "n", F.posexplode("keys").alias("pos", "key")).repartition("key").sortWithinPartitions("key")
        .mapInArrow(_key_scan(similarity), "kind byte, x long, y long"), "keys",
    )
    release(spark)

    @F.pandas_udf("boolean")
    def possible(x: pd.Series, nx: pd.Series, y: pd.Series, ny: pd.Series) -> pd.Series:
        return pd.Series([could_be_similar(*r, similarity) for r in zip(x, nx, y, ny)], dtype=bool)

    # Of two ends the one first in a random order is ``x``: the root of the other in a forest.
    ranked = found.where("kind = 0 and x <> y").select(*[F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v")).alias(c) for c in "xy"])
    pairs = ranked.select(F.least("x", "y")["v"].alias("x"), F.greatest("x", "y")["v"].alias("y")).distinct()
    with_x = pairs.join(vertex.select(F.col("vertex").alias("x"), F.col("bits").alias("bx"), F.col("n").alias("nx")), "x")
    with_both = with_x.join(vertex.select(F.col("vertex").alias("y"), F.col("bits").alias("by"), F.col("n").alias("ny")), "y")
    left = stored(with_both.where(possible("bx", "nx", "by", "ny")).select("x", "y"), "pairs")
    release(spark)

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_set(t, shingle) for t in texts], dtype=object)

    def sets_of(vertices: DataFrame) -> DataFrame:
        """Shingle sets of some vertices, each taken from one of its rows."""
        wanted = vertex.join(vertices.distinct(), "vertex").select("vertex", "row.id", "row.h")
        texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
        same = (texts["id"].eqNullSafe(wanted["id"])) & (texts["h"] == wanted["h"])
        one = texts.join(wanted, same).groupBy("vertex").agg(F.first("text").alias("text"))
        return stored(one.select("vertex", shingles("text").alias("set")), "sets")

    def classes_of(links: DataFrame) -> DataFrame:
        return connected_components(links).withColumnRenamed("id", "vertex")

    proved = spark.createDataFrame([], "a long, b long")
    component = spark.createDataFrame([], "vertex long, component long")
    if radius is not None:
        proved = stored(_vertex_links(vertex.select("vertex", "fp"), radius), "near-fingerprints")
        component = stored(classes_of(proved), "component")
        left = stored(_labelled(left, component), "left")
        release(spark)
    sets = sets_of(left.select(F.explode(F.array("x", "y")).alias("vertex")))
    release(spark)
    # Two forests settle nearly all; what they leave is judged whole.
    for turn in range(3):
        if left.isEmpty():
            break
        forest = left.groupBy("y").agg(F.min_by("x", F.xxhash64("x")).alias("x")).select("x", "y")
        chosen = stored(forest, "forest") if turn < 2 else left
        proved = proved.unionByName(stored(_proved(chosen, sets, similarity), "proved"))
        release(spark)
        component = stored(classes_of(proved), "component")
        left = stored(_labelled(left.join(chosen, ["x", "y"], "left_anti"), component), "left")
        release(spark)
    discard(sets)

    crowds = found.where("kind = 1").select(F.col("x").alias("key"), F.col("y").alias("vertex")).join(component, "vertex", "left")
    crowds = stored(crowds.select("key", "vertex", F.coalesce("component", "vertex").alias("known")), "crowds")
    member = [F.sum(F.pmod(F.xxhash64("vertex", F.lit(seed)), F.lit(1 << 40))).alias(f"s{seed}") for seed in (1, 2)]
    per_key = crowds.groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count("*").alias("size"), *member)
    # Of keys with the same members one is looked at.
    open_keys = per_key.where("low <> high").groupBy("size", "s1", "s2").agg(F.min("key").alias("key")).select("key")
    unsettled = crowds.join(open_keys, "key", "left_semi").join(vertex.select("vertex", "n", "bits"), "vertex")
    by_map = _chunked(unsettled, parity_chunk).repartition("group").sortWithinPartitions("group")
    near = stored(
        by_map.select("group", "key", "vertex", "known", "n", "bits").mapInArrow(_parity_scan(similarity), "key long, vertex long").distinct(),
        "near",
    )
    release(spark)
    if not near.isEmpty():
        more_sets = sets_of(near.select("vertex"))
        compared = _chunked(near.join(crowds, ["key", "vertex"]), chunk).join(more_sets, "vertex")
        ordered = compared.select("group", "vertex", "known", "set").repartition("group").sortWithinPartitions("group")
        more = stored(ordered.mapInArrow(_crowd_scan(similarity), "a long, b long"), "links")
        discard(more_sets)
        release(spark)
        if not more.isEmpty():
            component = classes_of(proved.unionByName(more))
    grouped = vertex.join(component, "vertex", "left").withColumn("component", F.coalesce("component", "vertex"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = grouped.join(least, "component").select("words", "component", "component_id")
    return marked.select("id", "h", "words").join(classes, "words").select("id", "h", "component", "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8,
    radius: int | None = None,
) -> DataFrame:
    """``docs`` with one row of each class of ``similar_classes``: the one of the least id.

    A null id is larger than all others. Rows that repeat an id and text stay once.
    Input columns are kept as they are, whatever their names.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        classes = stored(similar_classes(docs, id_col, text_col, shingle, similarity, radius=radius), "classes")
    chosen = classes.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("kept"))
    keys = chosen.select(F.col("kept.id").alias("_kept_id"), F.col("kept.h").alias("_kept_h")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    name = lambda c: F.col("_row").getField(c)
    out = rows.join(keys, name(id_col).eqNullSafe(F.col("_kept_id")) & (F.xxhash64(name(text_col)) == F.col("_kept_h")), "left_semi")
    repeated = classes.groupBy("id", "h").count().where("count > 1")
    if not repeated.isEmpty():
        # In the order of the rows' JSON, which any type of column has.
        first = F.min_by("_row", F.to_json("_row")).alias("_row")
        out = out.groupBy(name(id_col).alias("_id"), F.xxhash64(name(text_col)).alias("_h")).agg(first)
    return out.select("_row.*")
