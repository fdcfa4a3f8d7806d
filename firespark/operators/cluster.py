"""Density clustering of detections in space and time, and the fires it yields.

Time is scaled to metres, so a neighbourhood is a ball of radius ``eps`` in three
dimensions. Points are first folded into cubes whose diagonal is ``eps``: all the
points of one cube are neighbours by construction, however many they are. The
graph is therefore built between *cubes*, never between the points of a hot spot.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, geo, times
from firespark.operators.components import connected_components, least_labels
from firespark.session import materialise, stored

# Distances are inclusive; a micron absorbs rounding when two passes are exactly eps apart.
TIE_M = 1e-6
DIRECT_PAIRS = 1024
BOX_SPLIT = 4
#: Shares that the cubes of one label are dealt out to when they are told its fire.
LABEL_SALTS = 64
#: Cubes along the edge of a block. A task meets at most 18 x 20 x 20 cubes under one block.
BLOCK = 16
#: Rows of whole blocks that a task pairs at a time.
BLOCK_ROWS = 20_000
CUBE = ["area_key", "cx", "cy", "ct"]


def metric_points(hotspots: DataFrame, metres_per_hour: float = C.METRES_PER_HOUR) -> DataFrame:
    """Add ``x``, ``y`` in the area's UTM zone and ``t`` in metre equivalents."""
    hours = F.unix_micros("acq_dt") / 3.6e9
    placed = geo.with_utm(hotspots, "latitude", "longitude", geo.zone_of_area(F.col("area_key")))
    return placed.withColumn("t", hours * F.lit(metres_per_hour))


def _with_cells(points: DataFrame, side: float) -> DataFrame:
    cells = points.withColumns(
        {"cx": geo.cell(F.col("x"), side), "cy": geo.cell(F.col("y"), side), "ct": geo.cell(F.col("t"), side)}
    )
    return cells.withColumn("cell", F.concat_ws(":", "area_key", "cx", "cy", "ct"))


def _bounds() -> list[Column]:
    out = []
    for axis in "xyt":
        out += [F.min(axis).alias(f"{axis}0"), F.max(axis).alias(f"{axis}1")]
    return out


def _witnesses() -> list[Column]:
    """Two points that the cube has, at opposite ends of it."""
    along = F.col("x") + F.col("y") + F.col("t")
    return [pick(v, along).alias(f"{v}{k}") for k, pick in (("2", F.min_by), ("3", F.max_by)) for v in "xyt"]


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), b0 - a1, a0 - b1)


def _span(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(b1 - a0, a1 - b0)


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(reduce(lambda p, q: p + q, [v * v for v in parts]))


def _box_distance(measure, left: str, right: str) -> Column:
    return _norm(
        [
            measure(
                F.col(f"{left}.{v}0"), F.col(f"{left}.{v}1"), F.col(f"{right}.{v}0"), F.col(f"{right}.{v}1")
            )
            for v in "xyt"
        ]
    )


def _point_box(point: str, box: str) -> Column:
    return _norm(
        [
            F.greatest(
                F.lit(0.0), F.col(f"{box}.{v}0") - F.col(f"{point}.{v}"), F.col(f"{point}.{v}") - F.col(f"{box}.{v}1")
            )
            for v in "xyt"
        ]
    )


def _point_distance(p: str, q: str) -> Column:
    return _norm([F.col(f"{p}.{v}") - F.col(f"{q}.{v}") for v in "xyt"])


def _offsets(half: bool) -> Column:
    """Cube offsets within reach of ``eps``; ``half`` lists each unordered pair once."""
    steps = [o for o in itertools.product(range(-2, 3), repeat=3) if any(o)]
    if half:
        steps = [o for o in steps if o > (0, 0, 0)]
    fields = ("dx", "dy", "dt")
    return F.array(
        *[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(o, fields)]) for o in steps]
    )


def _cell_gap(side: float) -> Column:
    """Distance from a cube's own point bounds to the cube one offset away."""
    parts = []
    for axis in "xyt":
        low = (F.col(f"c{axis}") + F.col(f"o.d{axis}")) * F.lit(side)
        parts.append(_gap(F.col(f"{axis}0"), F.col(f"{axis}1"), low, low + F.lit(side)))
    return _norm(parts)


def _candidate_pairs(cells: DataFrame, side: float, eps: float) -> DataFrame:
    """Pairs of occupied cubes whose point bounds come within ``eps``."""
    box = F.struct("cell", "n", "x0", "x1", "y0", "y1", "t0", "t1")
    left = (
        cells.withColumn("o", F.explode(_offsets(half=True)))
        .where(_cell_gap(side) <= eps * (1 + 1e-9))
        .select(
            "area_key",
            (F.col("cx") + F.col("o.dx")).alias("cx"),
            (F.col("cy") + F.col("o.dy")).alias("cy"),
            (F.col("ct") + F.col("o.dt")).alias("ct"),
            box.alias("p"),
        )
    )
    right = cells.select("area_key", "cx", "cy", "ct", box.alias("q"))
    return (
        left.join(right, ["area_key", "cx", "cy", "ct"])
        .withColumn("near", _box_distance(_gap, "p", "q"))
        .withColumn("far", _box_distance(_span, "p", "q"))
        .where(F.col("near") <= eps)
        .select("p", "q", "far")
    )


def _point_edges(pairs: DataFrame, points: DataFrame, eps: float) -> DataFrame:
    """Cube pairs ``(a, b)`` with at least one point of ``p`` within ``eps`` of one of ``q``.

    ``points(box, x, y, t)``; a point is paired on only if it reaches the other box.
    """
    mine = points.select(F.col("box").alias("_p"), F.struct("x", "y", "t").alias("u"))
    other = points.select(F.col("box").alias("_q"), F.struct("x", "y", "t").alias("w"))
    return (
        pairs.join(mine, F.col("p.box") == F.col("_p"))
        .where(_point_box("u", "q") <= eps)
        .join(other, F.col("q.box") == F.col("_q"))
        .where(_point_distance("u", "w") <= eps)
        .select("a", "b")
        .distinct()
    )


def _cell_edges(points: DataFrame, side: float, eps: float, direct_pairs: int) -> DataFrame:
    """Exact edges between cubes of distinct ``points``.

    Bounds settle most pairs. A small undecided pair is compared point by point; a
    large one is split into sub-boxes, and only sub-box pairs straddling the radius
    are split again, so two crowded cubes never meet point against point in full.
    """
    cells = points.groupBy("area_key", "cx", "cy", "ct", "cell").agg(F.count("*").alias("n"), *_bounds())
    pairs = materialise(_candidate_pairs(cells, side, eps))
    named = pairs.select(F.col("p.cell").alias("a"), F.col("q.cell").alias("b"), "far", "p", "q")
    settled = named.where(F.col("far") <= eps).select("a", "b")
    undecided = named.where(F.col("far") > eps).select(
        "a", "b",
        F.col("p").withField("box", F.col("a")).alias("p"),
        F.col("q").withField("box", F.col("b")).alias("q"),
    )
    return settled.unionByName(_undecided_edges(undecided, points, side, eps, direct_pairs))


def _undecided_edges(undecided: DataFrame, points: DataFrame, side: float, eps: float, direct_pairs: int) -> DataFrame:
    """The ``undecided(a, b, p, q)`` cube pairs that have points within ``eps``; ``p`` and ``q`` are their boxes."""
    size = F.col("p.n") * F.col("q.n")
    found = [_point_edges(undecided.where(size <= direct_pairs), points.withColumn("box", F.col("cell")), eps)]

    open_pairs = undecided.where(size > direct_pairs)
    level = 1
    while not open_pairs.isEmpty():
        boxed = _boxed(points, side, level)
        boxes = boxed.groupBy("parent", "box").agg(F.count("*").alias("n"), *_bounds())
        shape = F.struct("box", "n", "x0", "x1", "y0", "y1", "t0", "t1")
        mine = boxes.select(F.col("parent").alias("_p"), shape.alias("u"))
        other = boxes.select(F.col("parent").alias("_q"), shape.alias("w"))
        split = materialise(
            open_pairs.select("a", "b", F.col("p.box").alias("_p"), "q")
            .join(mine, "_p")
            .where(_box_distance(_gap, "u", "q") <= eps)
            .select("a", "b", F.col("q.box").alias("_q"), F.col("u").alias("p"))
            .join(other, "_q")
            .select("a", "b", "p", F.col("w").alias("q"))
            .withColumn("far", _box_distance(_span, "p", "q"))
            .where(_box_distance(_gap, "p", "q") <= eps)
        )
        joined = split.where(F.col("far") <= eps).select("a", "b").distinct()
        rest = split.join(joined, ["a", "b"], "left_anti")
        found += [joined, _point_edges(rest.where(size <= direct_pairs), boxed, eps)]
        open_pairs = rest.where(size > direct_pairs)
        level += 1
    return reduce(DataFrame.unionByName, found)


def _block_scan(eps: float):
    """Rows (area_key, block, cube, n, bounds, witnesses) sorted by block to pairs of cubes: a forest of the settled ones, and the undecided.

    A pair belongs to the block of its first cube. Bounds settle it, or two witnesses. An undecided
    pair whose cubes the settled ones connect already is left out; the others carry their bounds.
    """
    steps = [o for o in itertools.product(range(-2, 3), repeat=3) if o > (0, 0, 0)]
    shape = ["n", "x0", "x1", "y0", "y1", "t0", "t1"]

    def norm(parts: list[np.ndarray]) -> np.ndarray:
        return np.sqrt((parts[0] * parts[0] + parts[1] * parts[1]) + parts[2] * parts[2])

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: table.column(c).to_numpy() for c in table.column_names if c != "area_key"}
        area = table.column("area_key").combine_chunks().dictionary_encode().indices.to_numpy()
        block = np.stack([area, col["bx"], col["by"], col["bt"]])
        first = np.r_[True, (block[:, 1:] != block[:, :-1]).any(axis=0)]
        at = [col[f"c{v}"] - BLOCK * col[f"b{v}"] for v in "xyt"]
        # Places in a block run from -2 to BLOCK + 1: five bits each, and the block's number above.
        code = np.cumsum(first)
        for place in at:
            code = code * 32 + place + 2
        mine = np.flatnonzero(np.all([(place >= 0) & (place < BLOCK) for place in at], axis=0))
        settled: list[tuple[np.ndarray, np.ndarray]] = []
        undecided: list[tuple[np.ndarray, np.ndarray]] = []
        for dx, dy, dt in steps:
            want = code[mine] + ((dx * 32 + dy) * 32 + dt)
            found = np.minimum(np.searchsorted(code, want), len(code) - 1)
            hit = code[found] == want
            i, j = mine[hit], found[hit]
            ends = [(col[f"{v}0"][i], col[f"{v}1"][i], col[f"{v}0"][j], col[f"{v}1"][j]) for v in "xyt"]
            near = norm([np.maximum(0.0, np.maximum(b0 - a1, a0 - b1)) for a0, a1, b0, b1 in ends]) <= eps
            far = norm([np.maximum(b1 - a0, a1 - b0) for a0, a1, b0, b1 in ends]) <= eps
            settled.append((i[near & far], j[near & far]))
            i, j = i[near & ~far], j[near & ~far]
            seen = np.zeros(len(i), bool)
            for mine_, theirs in itertools.product("23", repeat=2):
                seen |= norm([col[f"{v}{mine_}"][i] - col[f"{v}{theirs}"][j] for v in "xyt"]) <= eps
            settled.append((i[seen], j[seen]))
            undecided.append((i[~seen], j[~seen]))
        label = least_labels(len(code), *[np.concatenate(c) for c in zip(*settled)])
        i, j = (np.concatenate(c) for c in zip(*undecided))
        apart = label[i] != label[j]
        joined = np.flatnonzero(label != np.arange(len(label)))
        for open_, a, b in ((False, joined, label[joined]), (True, i[apart], j[apart])):
            ends = [table.select([*CUBE[1:], *shape]).take(pa.array(end)) for end in (a, b)]
            if not len(a):
                continue
            columns = {"area_key": table.column("area_key").take(pa.array(a))}
            for side_, end in zip("pq", ends):
                columns |= {f"{side_}_{c}": end.column(c) for c in CUBE[1:]}
                columns |= {f"{side_}_{c}": end.column(c) if open_ else pa.nulls(len(a), end.schema.field(c).type) for c in shape}
            yield from pa.table(columns).combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(c).to_pylist() if c == "area_key" else table.column(c).to_numpy() for c in ("area_key", "bx", "by", "bt")]
            cut = rows - 1
            while cut and all(k[cut - 1] == k[rows - 1] for k in keys):
                cut -= 1
            if cut:
                yield from settle(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), rows - cut
        if rows:
            yield from settle(pa.Table.from_batches(held).combine_chunks())

    return scan


def _cell_links(cells: DataFrame, points: DataFrame, side: float, eps: float, direct_pairs: int) -> DataFrame:
    """Edges ``(a, b)`` that connect the same cubes as those of ``_cell_edges``, about one for each cube.

    ``cells(area_key, cx, cy, ct, n, bounds, witnesses)`` go to their block of cubes and to those
    whose cubes look at them, fewer than two copies each; pairs are made inside the
    tasks and leave them as forests. ``points`` may repeat positions.
    """
    placed = cells.where(reduce(lambda p, q: p & q, [F.col(c).isNotNull() for c in CUBE]))
    for axis, ahead in (("x", 0), ("y", 2), ("t", 2)):
        at = [F.floor((F.col(f"c{axis}") + F.lit(d)) / F.lit(BLOCK)) for d in (-2, ahead)]
        placed = placed.withColumn(f"b{axis}", F.explode(F.array_distinct(F.array(*at))))
    block = ["area_key", "bx", "by", "bt"]
    bounds = [f"{v}{k}" for v in "xyt" for k in "01"]
    placed = placed.select(*block, *CUBE[1:], "n", *bounds, *[f"{v}{k}" for k in "23" for v in "xyt"]).repartition(*block).sortWithinPartitions(*block, *CUBE[1:])
    fields = lambda s: [f"{s}_{c} long" for c in [*CUBE[1:], "n"]] + [f"{s}_{c} double" for c in bounds]
    found = stored(placed.mapInArrow(_block_scan(eps), ", ".join(["area_key string", *fields("p"), *fields("q")])), "links")
    name = lambda s: F.concat_ws(":", "area_key", *[f"{s}_{c}" for c in CUBE[1:]])
    settled = found.where("p_n is null").select(name("p").alias("a"), name("q").alias("b"))
    box = lambda s: F.struct(name(s).alias("box"), *[F.col(f"{s}_{c}").alias(c) for c in ("n", *bounds)])
    undecided = found.where("p_n is not null").select(name("p").alias("a"), name("q").alias("b"), box("p").alias("p"), box("q").alias("q"))
    if undecided.isEmpty():
        return settled
    asked = undecided.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    spots = materialise(points.select("cell", "x", "y", "t").join(asked, "cell", "left_semi").distinct())
    return settled.unionByName(_undecided_edges(undecided, spots, side, eps, direct_pairs))


def _boxed(points: DataFrame, side: float, level: int) -> DataFrame:
    """Name the sub-box of each point at a level and the box it was split from."""

    def name(depth: int) -> Column:
        if depth == 0:
            return F.col("cell")
        small = side / BOX_SPLIT**depth
        keys = [geo.cell(F.col(v), small) for v in "xyt"]
        return F.concat_ws("/", name(depth - 1), *keys)

    return points.withColumns({"parent": name(level - 1), "box": name(level)})


def label_points(
    points: DataFrame,
    eps: float = C.EPS_M,
    min_samples: int = C.MIN_SAMPLES,
    direct_pairs: int = DIRECT_PAIRS,
) -> DataFrame:
    """Add ``label`` to ``points(area_key, x, y, t, …)``; noise gets a null label.

    With ``min_samples`` 1 the result is exactly the connected components of the
    neighbourhood graph. Otherwise a point is core when ``min_samples`` points lie
    within ``eps`` of it, itself included; core points connect, and a border point
    takes the smallest label among the core points it touches.
    """
    side = eps / math.sqrt(3.0) * (1.0 - 1e-12)
    eps = eps + TIE_M
    base = _with_cells(points, side)
    if min_samples <= 1:
        base = stored(base, "cubed")
        cells = base.groupBy(*CUBE).agg(F.count("*").alias("n"), *_bounds(), *_witnesses())
        groups = materialise(connected_components(_cell_links(cells, base, side, eps, direct_pairs), forest=True))
        return (
            base.join(groups.select(F.col("id").alias("cell"), "component"), "cell", "left")
            .withColumn("label", F.coalesce("component", "cell"))
            .drop("component", "cell", "cx", "cy", "ct")
        )

    where = ["area_key", "cx", "cy", "ct", "cell", "x", "y", "t"]
    spots = materialise(base.groupBy(*where).agg(F.count("*").alias("weight")))
    crowded = spots.groupBy("cell").agg(F.sum("weight").alias("total"))
    sized = spots.join(crowded, "cell")
    dense = sized.where(F.col("total") >= min_samples).select(*where)
    sparse = sized.where(F.col("total") < min_samples).select(*where, "weight")

    # Only cubes below the threshold ask about their neighbours, so a crowded cube
    # meets fewer than ``min_samples`` askers per neighbouring cube: linear work.
    counted = (
        _reach(sparse, spots.select(*where, "weight"), eps)
        .groupBy(*[f"p.{c}" for c in where])
        .agg(F.sum("q.weight").alias("seen"))
    )
    asked = sparse.join(counted, where, "left").withColumn(
        "seen", F.coalesce("seen", F.lit(0)) + F.col("weight")
    )
    within = sparse.groupBy("cell").agg(F.sum("weight").alias("own"))
    asked = asked.join(within, "cell").withColumn("seen", F.col("seen") + F.col("own") - F.col("weight"))
    asked = materialise(asked)
    core = materialise(
        dense.unionByName(asked.where(F.col("seen") >= min_samples).select(*where))
    )
    groups = connected_components(_cell_edges(core, side, eps, direct_pairs))
    core_cells = core.select("cell").distinct()
    named = core_cells.join(groups.select(F.col("id").alias("cell"), "component"), "cell", "left").select(
        "cell", F.coalesce("component", "cell").alias("label")
    )
    named = materialise(named)
    core_labelled = core.join(named, "cell")
    loose = asked.where(F.col("seen") < min_samples).select(*where)
    same_cell = loose.join(named, "cell").select(*where, "label")
    touched = _reach(loose, core_labelled.select(*where, "label"), eps).select(
        *[F.col(f"p.{c}").alias(c) for c in where], F.col("q.label").alias("label")
    )
    border = same_cell.unionByName(touched).groupBy(*where).agg(F.min("label").alias("label"))
    labels = core_labelled.select(*where, "label").unionByName(border)
    return base.join(labels, where, "left").drop("cell", "cx", "cy", "ct")


def _reach(probes: DataFrame, targets: DataFrame, eps: float) -> DataFrame:
    """Pairs (p, q) in different cubes at most ``eps`` apart."""
    keys = ["area_key", "cx", "cy", "ct"]
    left = probes.withColumn("o", F.explode(_offsets(half=False))).select(
        "area_key",
        (F.col("cx") + F.col("o.dx")).alias("cx"),
        (F.col("cy") + F.col("o.dy")).alias("cy"),
        (F.col("ct") + F.col("o.dt")).alias("ct"),
        F.struct(*probes.columns).alias("p"),
    )
    right = targets.select(*keys, F.struct(*targets.columns).alias("q"))
    return left.join(right, keys).where(_point_distance("p", "q") <= eps)


def neighbour_pairs(points: DataFrame, eps: float = C.EPS_M) -> DataFrame:
    """Pairs of occupied cubes linked by the eps-neighbourhood graph.

    The graph of points is this graph plus a clique inside every cube; it is never
    written out, because a single hot cube would square its size.
    """
    side = eps / math.sqrt(3.0) * (1.0 - 1e-12)
    eps = eps + TIE_M
    spots = _with_cells(points, side).select("area_key", "cx", "cy", "ct", "cell", "x", "y", "t").distinct()
    return _cell_edges(spots, side, eps, DIRECT_PAIRS).distinct()


def _mean_degrees(column: str) -> Column:
    """Mean of a coordinate with an exact integer sum: same result in any row order."""
    return F.sum(F.round(F.col(column) * 1e7).cast("long")) / (F.count("*") * F.lit(1e7))


def seeds(labelled: DataFrame) -> DataFrame:
    """Centroid and first sighting of every cluster label, and the id they hash to."""
    return (
        labelled.groupBy("label")
        .agg(
            _mean_degrees("latitude").alias("lat"),
            _mean_degrees("longitude").alias("lon"),
            F.min("acq_dt").alias("start"),
        )
        .withColumn("fire_id", domain.fire_id(F.col("lat"), F.col("lon"), F.col("start")))
    )


def assign_fire_ids(
    hotspots: DataFrame, eps: float = C.EPS_M, min_samples: int = C.MIN_SAMPLES
) -> DataFrame:
    """Cluster detections and add a ``fire_id`` that does not depend on row order.

    With ``min_samples`` 1, detections meet their fire by cube: a fire that holds a third of
    all detections is no join key of theirs. Sums are taken per cube first, and cubes of a
    label are dealt by salt to get its id.
    """
    if min_samples > 1:
        labelled = label_points(materialise(metric_points(hotspots)), eps, min_samples).where(F.col("label").isNotNull())
        ids = seeds(labelled).select("label", "fire_id")
        return labelled.join(ids, "label").select(*hotspots.columns, "fire_id")
    side = eps / math.sqrt(3.0) * (1.0 - 1e-12)
    base = stored(_with_cells(metric_points(hotspots), side), "cubed")
    cubes = stored(
        base.groupBy(*CUBE, "cell").agg(
            F.count("*").alias("n"), *_bounds(), *_witnesses(), F.sum(F.round(F.col("latitude") * 1e7).cast("long")).alias("lat"),
            F.sum(F.round(F.col("longitude") * 1e7).cast("long")).alias("lon"), F.min("acq_dt").alias("start"),
        ), "cubes",
    )
    groups = connected_components(_cell_links(cubes, base, side, eps + TIE_M, DIRECT_PAIRS), forest=True)
    per_cube = cubes.select("cell", "n", "lat", "lon", "start")
    labelled = per_cube.join(groups.withColumnRenamed("id", "cell"), "cell", "left").withColumn("label", F.coalesce("component", "cell"))
    labelled = materialise(labelled.withColumn("salt", F.pmod(F.xxhash64("cell"), F.lit(LABEL_SALTS)).cast("int")))
    total = labelled.groupBy("label").agg(
        F.sum("n").alias("n"), F.sum("lat").alias("lat"), F.sum("lon").alias("lon"), F.min("start").alias("start"), F.collect_set("salt").alias("salts")
    )
    mean = lambda c: F.col(c) / (F.col("n") * F.lit(1e7))
    ids = total.select("label", domain.fire_id(mean("lat"), mean("lon"), F.col("start")).alias("fire_id"), F.explode("salts").alias("salt"))
    of_cube = labelled.select("cell", "label", "salt").join(ids, ["label", "salt"]).select("cell", "fire_id")
    return base.join(of_cube, "cell").select(*hotspots.columns, "fire_id")


def build_fires(hotspots: DataFrame, now: Column) -> DataFrame:
    """One row per fire. Every aggregate combines on the map side."""
    rolled = hotspots.groupBy("fire_id").agg(
        F.min("area_key").alias("area_key"),
        F.count("*").alias("n_hotspots"),
        F.sum("frp_mw").alias("frp_total_mw"),
        F.max("frp_mw").alias("frp_max_mw"),
        F.max("brightness_k").alias("brightness_max_k"),
        F.avg("confidence_pct").alias("confidence_mean"),
        F.min("acq_dt").alias("first_detected"),
        F.max("acq_dt").alias("last_detected"),
        _mean_degrees("latitude").alias("lat"),
        _mean_degrees("longitude").alias("lon"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sensors"),
    )
    since = times.hours_between(now, F.col("last_detected"))
    return rolled.withColumns(
        {
            "hours_since_last": since,
            "duration_hours": times.hours_between(F.col("last_detected"), F.col("first_detected")),
            "status": domain.activity(since),
            "area_est_ha": domain.estimated_area_ha(F.col("n_hotspots")),
            "intensity": domain.intensity(F.col("frp_total_mw")),
        }
    )
