"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine >= c have a squared distance <= 2 - 2c. A fixed random rotation
spreads that distance over the coordinates; they are split into blocks, and each block
gets a share of the squared distance in proportion to its dimensions. A linked pair keeps
within the share in at least one block (pigeonhole), so range joins in the blocks, each
under its own share, meet every linked pair.

A range join cuts the block's first coordinate into cells as wide as its radius; a vector
meets the vectors of its own and of the next cell. Crowded cells are split into chunks,
and each pair of chunks is a task of its own. Candidates are compared exactly, in double
precision on the original components. A pair met in several blocks counts in the one
where it uses the smallest part of its share, so counts add up without listing pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.llm.common import forest, stored
from firespark.operators.components import connected_components

BLOCK_DIMENSIONS = 16
TILE = 1024
#: Slack of the single-precision range test, far above its rounding error.
SLACK = 1e-4


def rotation(dimensions: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(4).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks_of(dimensions: int) -> list[slice]:
    count = max(1, round(dimensions / BLOCK_DIMENSIONS))
    edges = np.linspace(0, dimensions, count + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:])]


def _usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(parts: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in parts])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells(classes: DataFrame, budget: float) -> DataFrame:
    """(cls, n, vector, size, block, cell): every class once per block, with its cell there."""

    @F.pandas_udf("array<int>")
    def of(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        lengths = vectors.map(len)
        for size in lengths.unique():
            at = np.flatnonzero(lengths.to_numpy() == size)
            turned = _unit(vectors.iloc[at]) @ rotation(size)
            found = [
                np.floor(turned[:, b.start] / np.sqrt(budget * (b.stop - b.start) / size + SLACK)).astype(np.int32) for b in blocks_of(size)
            ]
            for i, row in zip(at, np.stack(found, axis=1)):
                out[i] = row
        return pd.Series(out)

    placed = classes.withColumn("size", F.size("vector")).withColumn("cells", of("vector"))
    return placed.select("cls", "n", "vector", "size", F.posexplode("cells").alias("block", "cell"))


def _meetings(placed: DataFrame, chunk: int) -> DataFrame:
    """Each class under every pair of chunks in which it has to be compared.

    A cell's rows are dealt into chunks of about ``chunk`` by a hash. Chunk i of a cell
    meets chunks j >= i of its cell and all chunks of the next cell.
    """
    key = ["size", "block", "cell"]
    counts = placed.groupBy(*key).agg(F.ceil(F.count("*") / float(chunk)).cast("int").alias("chunks"))
    after = counts.select("size", "block", (F.col("cell") - 1).alias("cell"), F.col("chunks").alias("next"))
    before = counts.select("size", "block", (F.col("cell") + 1).alias("cell"), F.col("chunks").alias("prior"))
    shape = stored(counts.join(after, key, "left").join(before, key, "left"), "chunks")
    dealt = placed.join(shape, key).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))

    def meeting(cell: Column, left: Column, over: int, right: Column, side: int) -> Column:
        return F.struct(cell.alias("cell"), left.alias("left"), F.lit(over).alias("over"), right.alias("right"), F.lit(side).alias("side"))

    def upto(stop: Column, start: Column | None = None) -> Column:
        first = F.lit(0) if start is None else start
        return F.when(F.coalesce(stop, F.lit(0)) > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))

    cell, own = F.col("cell"), F.col("own")
    meetings = F.concat(
        F.transform(upto(F.col("chunks"), own), lambda j: meeting(cell, own, 0, j, 0)),
        F.transform(upto(own), lambda i: meeting(cell, i, 0, own, 1)),
        F.transform(upto(F.col("next")), lambda j: meeting(cell, own, 1, j, 0)),
        F.transform(upto(F.col("prior")), lambda i: meeting(cell - 1, i, 1, own, 1)),
    )
    return dealt.select("size", "block", F.explode(meetings).alias("m"), "cls", "n", "vector").select(
        "size", "block", "m.*", "cls", "n", "vector"
    )


def _compare(cosine: float, budget: float):
    """One pair of chunks to (a, b, links): per class its links counted here, and connecting links (links 0)."""

    def compare(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        size, block, _, left, over, right = key
        unit = _unit(part["vector"])
        turned = unit @ rotation(int(size))
        slices = blocks_of(int(size))
        here = slices[int(block)]
        limit = budget * (here.stop - here.start) / int(size) + SLACK
        near = turned[:, here].astype(np.float32)
        half = (near * near).sum(axis=1) / 2
        same = over == 0 and left == right
        side = part["side"].to_numpy()
        rows = np.arange(len(part)) if same else np.flatnonzero(side == 0)
        cols = rows if same else np.flatnonzero(side == 1)
        n, cls = part["n"].to_numpy(), part["cls"].to_numpy()
        links, pairs = np.zeros(len(part), np.int64), []
        for i in range(0, len(rows), TILE):
            r = rows[i : i + TILE]
            for j in range(i if same else 0, len(cols), TILE):
                c = cols[j : j + TILE]
                close = near[r] @ near[c].T
                close -= half[r][:, None]
                # |x - y|^2 / 2 = |x|^2 / 2 + |y|^2 / 2 - x.y
                hits = close >= (half[c] - limit / 2)[None, :]
                if same and i == j:
                    hits = np.triu(hits, 1)
                if not hits.any():
                    continue
                if np.count_nonzero(hits) > hits.size // 50:
                    x, y = np.nonzero(hits & (unit[r] @ unit[c].T >= cosine - 1e-9))
                else:
                    x, y = np.nonzero(hits)
                x, y = r[x], c[y]
                for k in range(0, len(x), 1 << 16):
                    a, b = x[k : k + (1 << 16)], y[k : k + (1 << 16)]
                    linked = np.einsum("ij,ij->i", unit[a], unit[b]) >= cosine
                    a, b = a[linked], b[linked]
                    gap = (turned[a] - turned[b]) ** 2
                    used = np.stack([gap[:, s].sum(axis=1) / (s.stop - s.start) for s in slices], axis=1)
                    first = np.argmin(used, axis=1) == int(block)
                    a, b = a[first], b[first]
                    np.add.at(links, a, n[b])
                    np.add.at(links, b, n[a])
                    if len(a):
                        pairs.append(forest(a, b))
        some = np.flatnonzero(links)
        a, b = forest(*(np.concatenate(x) for x in zip(*pairs))) if pairs else (some[:0], some[:0])
        return pd.DataFrame(
            {"a": np.r_[cls[some], cls[a]], "b": np.r_[cls[some], cls[b]], "links": np.r_[links[some], np.zeros(len(a), np.int64)]}
        )

    return compare


def vector_classes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, chunk: int = 16_384
) -> DataFrame:
    """(id, n_links, component_id) for every row.

    ``n_links`` counts the other rows whose cosine with this one is >= ``cosine``, copies
    included; ``component_id`` is the least id reachable by links. Rows whose vector is
    null, empty, zero, or has null or non-finite components link with nothing, nor do
    vectors of different lengths with each other. Equal vectors are one class and are
    compared once. Null ids keep their rows and take their class's least non-null id.
    An empty table gives no rows.
    """
    budget = 2 - 2 * cosine
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).withColumn("ok", _usable(F.col("vector")))
    usable = rows.where("ok").groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # Stored, so that the number that names a class is drawn once.
    classes = stored(usable.withColumn("cls", F.monotonically_increasing_id()), "classes")
    found = stored(
        _meetings(cells(classes.select("cls", "n", "vector"), budget), chunk)
        .groupBy("size", "block", "cell", "left", "over", "right")
        .applyInPandas(_compare(cosine, budget), "a long, b long, links long"),
        "vector-links",
    )
    counts = found.where("links > 0").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    component = connected_components(found.where("links = 0").select("a", "b")).withColumnRenamed("id", "cls")
    joined = classes.join(counts, "cls", "left").join(component, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    shaped = joined.join(least, "component").select(
        "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"
    )
    linked = rows.where("ok").join(shaped, "vector").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone)
