"""Nearest-site join over a tree of cells that is deep where sites are dense.

Cells of three bits per axis and level are split until a leaf holds few sites, however
crowded a spot is. A probe first takes an upper bound from the cells that it stands in
(the farthest corner of what they hold), then looks at the cells that its ball touches,
at the level where these are few, and goes down only into those that can still hold
something nearer. Bounds get tighter on the way. Sites are compared in the leaves that are
left; a far probe meets the near side of a cluster, never all of it.

Works in the plane (metres) and on the sphere (earth-centred kilometres). Levels are
joins on cell keys; no side is broadcast by hand, and the few cells at the top are copied
so that probes spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.operators.grids import PLANE, collapse_sites
from firespark.session import materialise

BITS = 3
LEAF_SITES = 16
#: Side of the top cells and number of levels below, by number of axes: down to 2 m and 8 m.
TOP = {2: (float(1 << 25), 8), 3: (float(1 << 14), 7)}
#: Two sites whose distances round to the same thousandth are a tie.
SLACK = 2e-3
SPREAD = 32


def _side(axes: tuple[str, ...], level: Column) -> Column:
    return F.lit(TOP[len(axes)][0]) / F.pow(F.lit(float(1 << BITS)), level)


def _keys(axes: tuple[str, ...]) -> list[str]:
    return [f"_k{a[1]}" for a in axes]


def _boxes(axes: tuple[str, ...]) -> list[str]:
    return [f"{end}{a[1]}" for a in axes for end in ("_lo", "_hi")]


def _top(radius: float, axes: tuple[str, ...]) -> int:
    """The finest level whose cells are as wide as the radius: what lies above bounds nothing."""
    side, deepest = TOP[len(axes)]
    return max([k for k in range(deepest + 1) if side / (1 << (BITS * k)) >= radius], default=0)


def _with_level(df: DataFrame, axes: tuple[str, ...], first: int, last: int) -> DataFrame:
    """A row per level, with the cell that the position is in."""
    levels = F.array(*[F.lit(k) for k in range(first, last + 1)]).cast("array<int>")
    out = df.withColumn("_level", F.explode(levels))
    side = _side(axes, F.col("_level"))
    return out.withColumns({k: F.floor(F.col(a) / side).cast("long") for a, k in zip(axes, _keys(axes))})


def tree(sites: DataFrame, axes: tuple[str, ...] = PLANE, leaf_sites: int = LEAF_SITES, radius: float = float("inf")) -> DataFrame:
    """Cells of the tree over ``sites(_zone, axes…)``: key, number of sites, their bounds, whether it is a leaf.

    A cell is part of the tree if it is at the top or the one above it holds too many sites.
    The top is the finest level that is as wide as the radius.
    """
    keys, deepest, top = _keys(axes), TOP[len(axes)][1], _top(radius, axes)
    bounds = [f(a).alias(f"{end}{a[1]}") for a in axes for f, end in ((F.min, "_lo"), (F.max, "_hi"))]
    cells = materialise(_with_level(sites.select("_zone", *axes), axes, top, deepest).groupBy("_zone", "_level", *keys).agg(F.count("*").alias("_n"), *bounds))
    crowded = cells.where(F.col("_n") > leaf_sites)
    above = crowded.select("_zone", (F.col("_level") + 1).alias("_level"), *[F.col(k).alias(f"{k}p") for k in keys])
    below = cells.where(F.col("_level") > top).withColumns({f"{k}p": F.shiftright(k, BITS) for k in keys})
    kept = below.join(above, ["_zone", "_level", *[f"{k}p" for k in keys]], "left_semi").select(*cells.columns)
    leaf = (F.col("_n") <= leaf_sites) | (F.col("_level") == deepest)
    return materialise(cells.where(F.col("_level") == top).unionByName(kept).withColumn("_leaf", leaf))


def _span(cells: DataFrame) -> tuple[int, int]:
    """The levels that the tree has."""
    found = cells.agg(F.min("_level"), F.max("_level")).head()
    return (found[0], found[1]) if found[0] is not None else (0, -1)


def _far(axes: tuple[str, ...], box: Column | None = None) -> Column:
    """Distance to the farthest corner of a box."""
    of = (lambda name: F.col(name)) if box is None else (lambda name: box[name])
    parts = [F.greatest(F.abs(F.col(a) - of(f"_lo{a[1]}")), F.abs(F.col(a) - of(f"_hi{a[1]}"))) for a in axes]
    return F.sqrt(reduce(lambda p, q: p + q, [v * v for v in parts]))


def _near(axes: tuple[str, ...], box: Column | None = None) -> Column:
    """Distance to a box, zero inside it."""
    of = (lambda name: F.col(name)) if box is None else (lambda name: box[name])
    parts = [F.greatest(F.lit(0.0), of(f"_lo{a[1]}") - F.col(a), F.col(a) - of(f"_hi{a[1]}")) for a in axes]
    return F.sqrt(reduce(lambda p, q: p + q, [v * v for v in parts]))


def _salted(cells: DataFrame, top: int) -> DataFrame:
    """The cells at the top once per salt: there are few of them, and every probe asks for one."""
    each = F.sequence(F.lit(0), F.lit(SPREAD - 1))
    return cells.withColumn("_salt", F.explode(F.when(F.col("_level") == top, each).otherwise(F.array(F.lit(0)))))


def _salt(probe_id: str, top: int) -> Column:
    return F.when(F.col("_level") == top, F.pmod(F.xxhash64(probe_id), F.lit(SPREAD)).cast("int")).otherwise(F.lit(0))


def _bounded(probes: DataFrame, cells: DataFrame, probe_id: str, radius: float, axes: tuple[str, ...], span: tuple[int, int]) -> DataFrame:
    """Probes with ``_ub``: no more than the distance to the nearest site, or the radius."""
    here = _with_level(probes, axes, *span).withColumn("_salt", _salt(probe_id, span[0]))
    met = here.join(_salted(cells, span[0]), ["_zone", "_level", "_salt", *_keys(axes)])
    best = met.groupBy(probe_id).agg(F.min(_far(axes)).alias("_ub"))
    return probes.join(best, probe_id, "left").withColumn("_ub", F.least(F.coalesce("_ub", F.lit(radius)), F.lit(radius)))


def _first_cells(bounded: DataFrame, cells: DataFrame, probe_id: str, axes: tuple[str, ...], span: tuple[int, int]) -> DataFrame:
    """The cells that a probe's ball touches: leaves at any level above, and all at the finest level with few of them."""
    top, last = span
    finest = F.lit(top)
    for k in range(top + 1, last + 1):
        finest = F.when(F.lit(TOP[len(axes)][0] / (1 << (BITS * k))) >= F.col("_ub"), F.lit(k)).otherwise(finest)
    rows = bounded.withColumn("_start", finest).withColumn("_level", F.explode(F.sequence(F.lit(top), F.col("_start"))))
    side, reach = _side(axes, F.col("_level")), F.col("_ub") + SLACK
    for a, k in zip(axes, _keys(axes)):
        low, high = (F.floor((F.col(a) + s * reach) / side).cast("long") for s in (-1, 1))
        rows = rows.withColumn(k, F.explode(F.sequence(low, high)))
    met = rows.withColumn("_salt", _salt(probe_id, top)).join(_salted(cells, top), ["_zone", "_level", "_salt", *_keys(axes)])
    return met.where((F.col("_leaf") | (F.col("_level") == F.col("_start"))) & (_near(axes) <= reach))


def candidate_leaves(probes: DataFrame, cells: DataFrame, probe_id: str, radius: float, axes: tuple[str, ...] = PLANE) -> DataFrame:
    """(probe…, leaf key, _n): the leaves in which a probe's nearest site within the radius can be."""
    keys = _keys(axes)
    cell = F.struct("_level", *keys, *_boxes(axes), "_n", "_leaf").alias("cell")
    own = [probe_id, "_zone", *axes]
    span = _span(cells)
    if span[1] < span[0]:
        return probes.where("false").select(*own, F.lit(0).alias("_level"), *[F.lit(0).cast("long").alias(k) for k in keys], F.lit(0).cast("long").alias("_n"))
    bounded = _bounded(probes, cells, probe_id, radius, axes, span)
    # Most probes start among leaves and are done; the others go down, cell lists in a row.
    first = materialise(_first_cells(bounded, cells, probe_id, axes, span).select(*own, "_ub", "_leaf", cell))
    settled = first.select(*own, "cell._level", *[F.col(f"cell.{k}") for k in keys], "cell._n")
    deeper = first.where("not _leaf").select(probe_id).distinct()
    if deeper.isEmpty():
        return settled
    settled = settled.join(deeper, probe_id, "left_anti")
    front = first.join(deeper, probe_id, "left_semi").groupBy(*own, "_ub").agg(F.collect_list("cell").alias("cells"))
    children = cells.withColumns({f"{k}p": F.shiftright(k, BITS) for k in keys}).select(
        "_zone", *[F.col(f"{k}p") for k in keys], (F.col("_level") - 1).alias("_above"), cell.alias("child")
    )
    done = []
    while True:
        tight = front.withColumn("_ub", F.least("_ub", F.array_min(F.transform("cells", lambda c: _far(axes, c)))))
        tight = materialise(tight.withColumn("cells", F.filter("cells", lambda c: _near(axes, c) <= F.col("_ub") + SLACK)))
        is_open = F.exists("cells", lambda c: ~c["_leaf"])
        done.append(tight.where(~is_open))
        still = tight.where(is_open)
        if still.isEmpty():
            break
        each = still.select(*own, "_ub", F.explode("cells").alias("cell"))
        down = each.where("not cell._leaf").select(
            *own, "_ub", F.col("cell._level").alias("_above"), *[F.col(f"cell.{k}").alias(f"{k}p") for k in keys]
        )
        went = down.join(children, ["_zone", "_above", *[f"{k}p" for k in keys]]).select(*own, "_ub", F.col("child").alias("cell"))
        front = each.where("cell._leaf").select(*own, "_ub", "cell").unionByName(went).groupBy(*own, "_ub").agg(F.collect_list("cell").alias("cells"))
    went_down = reduce(DataFrame.unionByName, done).select(*own, F.explode("cells").alias("cell"))
    return settled.unionByName(went_down.select(*own, "cell._level", *[F.col(f"cell.{k}") for k in keys], "cell._n"))


def nearest(
    probes: DataFrame, sites: DataFrame, probe_id: str, payload: list[str], radius: float, axes: tuple[str, ...] = PLANE,
    leaf_sites: int = LEAF_SITES,
) -> DataFrame:
    """``(probe_id, _dist, payload…)`` of the closest site within the radius.

    ``probes(probe_id, _zone, axes…)`` and ``sites(_zone, axes…, payload…)``; equal
    distances (to a thousandth) are decided by the payload in order. Rows without a
    position match nothing. Sites on one spot are one.
    """
    somewhere = reduce(lambda p, q: p & q, [F.col(a).isNotNull() for a in axes])
    folded = materialise(collapse_sites(sites.where(somewhere), F.min(F.struct(*payload)).alias("_site"), axes=axes))
    asked = materialise(probes.where(somewhere).select(probe_id, "_zone", *axes).distinct())
    cells = tree(folded, axes, leaf_sites, radius)
    leaves = candidate_leaves(asked, cells, probe_id, radius, axes)
    key = ["_zone", "_level", *_keys(axes)]
    # A leaf's few sites travel as one array: a probe and a leaf give one row, not one per site.
    packed = _with_level(folded, axes, *_span(cells)).join(cells.where("_leaf").select(*key), key).groupBy(*key).agg(
        F.collect_list(F.struct(*axes, "_site")).alias("_sites")
    )

    def met(site: Column) -> Column:
        squares = [(F.col(a) - site[a]) * (F.col(a) - site[a]) for a in axes]
        gap = F.sqrt(reduce(lambda p, q: p + q, squares))
        return F.when(gap <= radius, F.struct(F.round(gap, 3).alias("k"), site["_site"].alias("s"), gap.alias("d")))

    found = leaves.join(packed, key).select(probe_id, F.array_min(F.transform("_sites", met)).alias("_hit"))
    best = found.where("_hit is not null").groupBy(probe_id).agg(F.min("_hit").alias("_hit"))
    return best.select(probe_id, F.col("_hit.d").alias("_dist"), *[F.col(f"_hit.s.{c}").alias(c) for c in payload])
