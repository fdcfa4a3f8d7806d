"""Point-in-polygon and point-near-polygon joins without a geometry library.

A layer is a table with ``rings``: an array of closed rings, each an array of
``struct<x, y>`` in degrees; holes and parts are just more rings (even-odd rule).
Each polygon is cut along a grid whose cells are split again where edges crowd. A cell
keeps only the edges that touch it, and whether the middle of its east side is inside the
polygon. A point goes from there along the side and then west: it is inside if that
changes an odd number of times. Cells that no edge touches need no test. So a test costs
a few edges whatever the polygon's size, and the join is an equality join on the cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.functions import geo
from firespark.functions.text import fold
from firespark.session import materialise, shuffled

CELL_DEG = 0.25
#: A cell with more edges of one polygon is split into ``SPLIT`` by ``SPLIT``, down to about 6 m.
CELL_EDGES = 64
SPLIT, DEEPEST = 4, 6


def ring_edges(rings: Column) -> Column:
    """Flat array of ``struct<x1, y1, x2, y2>``."""

    def edges(ring: Column) -> Column:
        n = F.size(ring)
        return F.zip_with(
            F.slice(ring, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))),
            lambda a, b: F.struct(
                a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
            ),
        )

    return F.flatten(F.transform(rings, edges))


def _extreme(rings: Column, axis: str, largest: bool) -> Column:
    values = F.transform(F.flatten(rings), lambda p: p[axis])
    return F.array_max(values) if largest else F.array_min(values)


def with_bounds(layer: DataFrame) -> DataFrame:
    rings = F.col("rings")
    return layer.withColumns(
        {
            "west": _extreme(rings, "x", False), "east": _extreme(rings, "x", True),
            "south": _extreme(rings, "y", False), "north": _extreme(rings, "y", True),
        }
    )


def _cells_between(low: Column, high: Column, side: float) -> Column:
    return F.explode(F.sequence(geo.cell(low, side), geo.cell(high, side)))


def _side(level: Column, side: float) -> Column:
    return F.lit(side) / F.pow(F.lit(float(SPLIT)), level)


def _turns(edge, lat: Column, lon: Column, east: Column, middle: Column) -> Column:
    """How often the way from (middle, east) along the side to ``lat`` and west to ``lon`` crosses an edge."""
    x1, y1, x2, y2 = (edge[c] for c in ("x1", "y1", "x2", "y2"))
    y_at = (y2 - y1) * (east - x1) / F.nullif(x2 - x1, F.lit(0.0)) + y1
    along = ((x1 > east) != (x2 > east)) & ((y_at > lat) != (y_at > middle))
    x_at = (x2 - x1) * (lat - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1
    across = ((y1 > lat) != (y2 > lat)) & (lon < x_at) & (x_at <= east)
    return F.coalesce(along, F.lit(False)).cast("int") + F.coalesce(across, F.lit(False)).cast("int")


def _spread(edges: DataFrame, side: float) -> DataFrame:
    """Edges once per cell of a side that they touch; a long slanted one follows its cells, not its box."""
    rows = edges.withColumn("_gy", _cells_between(F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2"), side))
    low = F.col("_gy") * F.lit(side)
    dy = F.col("e.y2") - F.col("e.y1")

    def x_at(y: Column) -> Column:
        """Where the edge is at a latitude, kept between its ends."""
        x = F.col("e.x1") + (F.col("e.x2") - F.col("e.x1")) * (y - F.col("e.y1")) / F.nullif(dy, F.lit(0.0))
        return F.least(F.greatest(x, F.least("e.x1", "e.x2")), F.greatest("e.x1", "e.x2"))

    # A hair wider than the row, so that rounding loses no cell.
    hair = side * 1e-9
    lowest = F.greatest(F.least("e.y1", "e.y2"), low - hair)
    highest = F.least(F.greatest("e.y1", "e.y2"), low + side + hair)
    a, b = F.coalesce(x_at(lowest), F.col("e.x1")), F.coalesce(x_at(highest), F.col("e.x2"))
    return rows.withColumn("_gx", _cells_between(F.least(a, b) - hair, F.greatest(a, b) + hair, side))


def _top_cells(base: DataFrame, touching: DataFrame, side: float) -> DataFrame:
    """(_pid, _gx, _gy, _odd, _touched) of the widest cells that an edge touches or that are inside."""
    middle = (F.col("_gy") + 0.5) * F.lit(side)
    e = F.col("e")
    rows = touching.where((e["y1"] > middle) != (e["y2"] > middle)).select("_pid", "_gy", "e").distinct()
    x_at = (e["x2"] - e["x1"]) * (middle - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"]
    lines = rows.groupBy("_pid", "_gy").agg(F.collect_list(x_at).alias("xs"))
    # Columns from the first to the last crossing of the row; outside of them all is even.
    spans = lines.withColumn("_gx", _cells_between(F.array_min("xs") - side, F.array_max("xs"), side))
    east = (F.col("_gx") + 1) * F.lit(side)
    odd = F.size(F.filter("xs", lambda x: x > east)) % 2
    inside = spans.select("_pid", "_gx", "_gy", odd.alias("_odd"))
    touched = touching.select("_pid", "_gx", "_gy").distinct().withColumn("_touched", F.lit(True))
    both = touched.join(inside, ["_pid", "_gx", "_gy"], "full").select(
        "_pid", "_gx", "_gy", F.coalesce("_odd", F.lit(0)).alias("_odd"), F.coalesce("_touched", F.lit(False)).alias("_touched")
    )
    return both.where("_touched or _odd = 1")


def _children(crowded: DataFrame, touching: DataFrame, side: float) -> tuple[DataFrame, DataFrame]:
    """Cells and their edges after splitting: the middle of a child's east side is reached inside its parent."""
    small = side / SPLIT
    keys = ["_pid", "_gx", "_gy"]
    local = touching.join(crowded.select(*keys, "_odd"), keys)
    steps = F.array(*[F.lit(i).cast("long") for i in range(SPLIT)])
    sub = crowded.select(*keys, "_odd").withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    east, middle = (F.col("_gx") + 1) * F.lit(side), (F.col("_gy") + 0.5) * F.lit(side)
    lon = (F.col("_gx") * SPLIT + F.col("_i") + 1) * F.lit(small)
    lat = (F.col("_gy") * SPLIT + F.col("_j") + 0.5) * F.lit(small)
    way = local.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    turns = way.groupBy(*keys, "_i", "_j").agg(F.sum(_turns(F.col("e"), lat, lon, east, middle)).alias("_n"))
    named = sub.join(turns, [*keys, "_i", "_j"]).select(
        "_pid", (F.col("_gx") * SPLIT + F.col("_i")).alias("_gx"), (F.col("_gy") * SPLIT + F.col("_j")).alias("_gy"),
        ((F.col("_odd") + F.col("_n")) % 2).cast("int").alias("_odd"),
    )
    finer = _spread(local.select("_pid", "e", F.col("_gx").alias("_px"), F.col("_gy").alias("_py")), small)
    finer = finer.where((F.floor(F.col("_gx") / SPLIT) == F.col("_px")) & (F.floor(F.col("_gy") / SPLIT) == F.col("_py"))).drop("_px", "_py")
    touched = finer.select(*keys).distinct().withColumn("_touched", F.lit(True))
    cells = named.join(touched, keys, "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))
    return cells.where("_touched or _odd = 1"), finer


def cut(layer: DataFrame, attributes: list[str], side: float = CELL_DEG, cell_edges: int = CELL_EDGES) -> tuple[DataFrame, int]:
    """``(_level, _gx, _gy, attributes…, _edges, _odd)`` per cell a polygon covers or touches, and the deepest level.

    Only cells with too many edges go down a level; no array holds more than a cell's edges.
    """
    base = materialise(layer.where(F.size("rings") > 0).select(*attributes, "rings").withColumn("_pid", F.monotonically_increasing_id()))
    edges = base.select("_pid", F.explode(ring_edges(F.col("rings"))).alias("e"))
    touching = _spread(edges, side)
    cells = _top_cells(base, touching, side)
    keys = ["_pid", "_gx", "_gy"]
    done, level = [], 0
    while True:
        counted = touching.groupBy(*keys).agg(F.count("*").alias("_n"))
        crowds = counted.where(F.col("_n") > cell_edges)
        deeper = level < DEEPEST and not crowds.isEmpty()
        if deeper:
            touching, cells = materialise(touching), materialise(cells)
            crowds = materialise(touching.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > cell_edges)).select(*keys)
            kept, held = cells.join(crowds, keys, "left_anti"), touching.join(crowds, keys, "left_anti")
        else:
            kept, held = cells, touching
        listed = held.groupBy(*keys).agg(F.collect_list("e").alias("_edges"))
        whole = kept.join(listed, keys, "left").withColumn("_edges", F.coalesce("_edges", F.array().cast(listed.schema["_edges"].dataType)))
        done.append(whole.select(F.lit(level).alias("_level"), *keys, "_edges", "_odd"))
        if not deeper:
            break
        cells, touching = _children(cells.join(crowds, keys, "left_semi"), touching, side / SPLIT**level)
        level += 1
    every = reduce(DataFrame.unionByName, done)
    return every.join(base.select("_pid", *attributes), "_pid").select("_level", "_gx", "_gy", *attributes, "_edges", "_odd"), level


def contains(lat: Column, lon: Column, edges: Column, odd: Column, level: Column, gx: Column, gy: Column, side: float = CELL_DEG) -> Column:
    """Whether a point of a cell is inside, from the cell's own edges and the state of its east side's middle."""
    width = _side(level, side)
    east, middle = (gx + 1) * width, (gy + 0.5) * width
    turns = F.aggregate(edges, F.lit(0), lambda acc, e: acc + _turns(e, lat, lon, east, middle))
    return (odd + turns) % 2 == 1


def covering(
    points: DataFrame, layer: DataFrame, attributes: list[str],
    lat: str = "latitude", lon: str = "longitude", side: float = CELL_DEG, cell_edges: int = CELL_EDGES,
) -> DataFrame:
    """Inner join of points with every polygon that contains them."""
    cells, deepest = cut(layer, attributes, side, cell_edges)
    keyed = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(deepest + 1)])))
    width = _side(F.col("_level"), side)
    keyed = keyed.withColumns({"_gx": F.floor(F.col(lon) / width).cast("long"), "_gy": F.floor(F.col(lat) / width).cast("long")})
    inside = contains(F.col(lat), F.col(lon), F.col("_edges"), F.col("_odd"), F.col("_level"), F.col("_gx"), F.col("_gy"), side)
    return keyed.join(cells, ["_level", "_gx", "_gy"]).where(inside).drop("_level", "_gx", "_gy", "_edges", "_odd")


def locate_places(
    points: DataFrame, layer: DataFrame, order: list[Column], attributes: list[str],
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """``(lat, lon, attributes…)``: the first covering polygon of every distinct position."""
    places = points.select(lat, lon).distinct()
    wanted = layer.select(
        F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *attributes).alias("_best"), "rings"
    )
    # Of polygons with the same outline only the first can be the answer.
    wanted = wanted.groupBy("rings").agg(F.min("_best").alias("_best"))
    hits = covering(places, wanted, ["_best"], lat, lon)
    return hits.groupBy(lat, lon).agg(F.min("_best").alias("_best")).select(
        lat, lon, *[F.col(f"_best.{a}").alias(a) for a in attributes]
    )


def locate(
    points: DataFrame, layer: DataFrame | None, order: list[Column], attributes: list[str],
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Left join with the first covering polygon; no layer gives null attributes."""
    if layer is None:
        return points.withColumns({a: F.lit(None).cast("string") for a in attributes})
    found = locate_places(points, layer, order, attributes, lat, lon)
    return points.join(found, [lat, lon], "left").select(*points.columns, *attributes)


def _segment_gap(x: Column, y: Column) -> Column:
    ax, ay, bx, by = F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by")
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((x - ax) * dx + (y - ay) * dy) / F.nullif(length2, F.lit(0.0))).otherwise(0.0)
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return geo.distance(x, y, ax + s * dx, ay + s * dy)


def _metric_segments(layer: DataFrame, margin: float) -> DataFrame:
    """Distinct edges in metres, once per cell of ``margin`` metres that has points so near to them.

    A row of cells is met by the part of the edge that is at most ``margin`` above or below
    it, so a long slanted edge follows its cells, not its box.
    """
    edges = layer.select(F.explode(ring_edges(F.col("rings"))).alias("e")).distinct()
    flat = edges.select("e.*")
    seg = geo.with_utm(flat, "y1", "x1", 30, "_ax", "_ay")
    seg = geo.with_utm(seg, "y2", "x2", 30, "_bx", "_by").select("_ax", "_ay", "_bx", "_by")
    wide = seg.withColumn(
        "_cy", _cells_between(F.least("_ay", "_by") - margin, F.greatest("_ay", "_by") + margin, margin)
    )
    # A millimetre more, so that rounding loses no cell.
    reach = margin + 1e-3
    low = F.col("_cy") * F.lit(margin)

    def x_at(y: Column) -> Column:
        x = F.col("_ax") + (F.col("_bx") - F.col("_ax")) * (y - F.col("_ay")) / F.nullif(F.col("_by") - F.col("_ay"), F.lit(0.0))
        # A level edge has no such place: it must stay null, which greatest and least would pass over.
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.least("_ax", "_bx")), F.greatest("_ax", "_bx")))

    a = F.coalesce(x_at(F.greatest(F.least("_ay", "_by"), low - reach)), F.col("_ax"))
    b = F.coalesce(x_at(F.least(F.greatest("_ay", "_by"), low + margin + reach)), F.col("_bx"))
    return wide.withColumn("_cx", _cells_between(F.least(a, b) - reach, F.greatest(a, b) + reach, margin))


def territory_places(
    points: DataFrame, layer: DataFrame, margin_m: float,
    lat: str = "latitude", lon: str = "longitude",
) -> DataFrame:
    """Distinct positions inside a polygon or at most ``margin_m`` from one.

    Two passes: the cheap containment test first, then the distance to the outline
    for the positions that failed it. Both are semi joins, so nothing multiplies.
    """
    places = points.select(lat, lon).distinct()
    outlines = layer.select("rings").distinct()
    inside = covering(places, outlines, [], lat, lon).distinct()
    outside = geo.with_utm(
        places.join(inside, [lat, lon], "left_anti"), lat, lon, 30, "_x", "_y"
    ).withColumns({"_cx": geo.cell(F.col("_x"), margin_m), "_cy": geo.cell(F.col("_y"), margin_m)})
    seg = shuffled(_metric_segments(outlines, margin_m))
    on = (
        (outside["_cx"] == seg["_cx"])
        & (outside["_cy"] == seg["_cy"])
        & (_segment_gap(F.col("_x"), F.col("_y")) <= margin_m)
    )
    near = outside.join(seg, on, "left_semi").select(lat, lon)
    return inside.select(lat, lon).unionByName(near)


def clip_to_territory(points: DataFrame, layer: DataFrame | None, margin_m: float) -> DataFrame:
    """Keep the points on or near the territory; without a layer keep them all."""
    if layer is None:
        return points
    return points.join(territory_places(points, layer, margin_m), ["latitude", "longitude"], "left_semi")


def outside_territory(points: DataFrame, layer: DataFrame, margin_m: float) -> DataFrame:
    return points.join(territory_places(points, layer, margin_m), ["latitude", "longitude"], "left_anti")


def interior_points(layer: DataFrame, attributes: list[str]) -> DataFrame:
    """A point guaranteed inside each polygon: middle of the widest run of a scan line.

    The line crosses halfway up the bounding box, nudged off any vertex by working
    between the two vertex latitudes that enclose it.
    """
    b = with_bounds(layer).withColumn("_e", ring_edges(F.col("rings")))
    middle = (F.col("south") + F.col("north")) / 2.0
    ys = F.transform(F.flatten("rings"), lambda p: p["y"])
    below = F.array_max(F.filter(ys, lambda v: v <= middle))
    above = F.array_min(F.filter(ys, lambda v: v > middle))
    b = b.withColumn("lat", (below + above) / 2.0)
    hit = F.filter("_e", lambda e: (e["y1"] > F.col("lat")) != (e["y2"] > F.col("lat")))
    xs = F.array_sort(
        F.transform(
            hit,
            lambda e: (e["x2"] - e["x1"]) * (F.col("lat") - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0))
            + e["x1"],
        )
    )
    b = b.withColumn("_xs", xs)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("_xs") - 1), F.lit(2))
    runs = F.transform(
        starts,
        lambda i: F.struct(
            (F.element_at("_xs", i + 1) - F.element_at("_xs", i)).alias("w"),
            ((F.element_at("_xs", i + 1) + F.element_at("_xs", i)) / 2.0).alias("x"),
        ),
    )
    found = b.where(F.size("_xs") >= 2).select(
        *attributes, F.col("lat"), F.array_max(runs)["x"].alias("lon")
    )
    # A prepared layer: written once, so later joins do not expand this expression again.
    return materialise(found)


def control_points(points: DataFrame, layer: DataFrame, name: str, expected: str) -> DataFrame:
    """How many known points fall in a unit whose name contains the expected text."""
    named = locate(points, layer, [F.col(name)], [name])
    right = fold(F.coalesce(name, F.lit(""))).contains(fold(F.col(expected)))
    return named.agg(F.count("*").alias("puntos"), F.count_if(~right).alias("fallos"))
