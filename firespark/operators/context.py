"""Surroundings of an incident: wind, warnings, closures, growth, towns, land cover.

Everything but growth depends on the position alone, so each layer is evaluated once
per distinct position and joined back: incidents piled on one municipal centroid cost
a single lookup. Null means "unknown" (no layer), zero means "looked, found none".
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, geo
from firespark.operators.grids import PLANE, with_metres, within
from firespark.operators.polygons import locate, locate_places
from firespark.operators.quadtree import nearest
from firespark.session import materialise

WIND_BLOCK = 1024
SETTLEMENT_REACH_M = C.SETTLEMENT_MAX_KM * 1000.0 + 50.1
NODE_VALUES = ("speed_kmh", "gusts_kmh", "temp_c", "humedad_pct")


def places_of(incidents: DataFrame) -> DataFrame:
    """Distinct positions with their metres, stored: the projection is worked out once, and
    its long expression stays out of the keys of every later join and aggregate."""
    return materialise(with_metres(incidents.select("lat", "lon").distinct(), "lat", "lon"))


def placed(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """``df`` with metres; one that has them is taken as it is."""
    return df if {"_zone", *PLANE} <= set(df.columns) else with_metres(df, lat, lon)


def by_place(
    incidents: DataFrame, lookup: Callable[[DataFrame], DataFrame], columns: list[str]
) -> DataFrame:
    """Run ``lookup`` on distinct ``(lat, lon)`` and join its columns back."""
    found = lookup(places_of(incidents)).select("lat", "lon", *columns)
    clean = incidents.drop(*columns)
    return clean.join(found, ["lat", "lon"], "left").select(*clean.columns, *columns)


def _nulls(incidents: DataFrame, columns: dict[str, str]) -> DataFrame:
    return incidents.withColumns({c: F.lit(None).cast(t) for c, t in columns.items()})


# --- Wind ----------------------------------------------------------------------

WIND_COLUMNS = {
    "viento_kmh": "double", "viento_rachas_kmh": "double", "viento_hacia_deg": "double",
    "viento_cardinal_desde": "string", "temp_c": "double", "humedad_pct": "double",
}


def _node_blocks(nodes: DataFrame, values: list[Column]) -> DataFrame:
    """Node positions packed into arrays of about ``WIND_BLOCK``, one row per block.

    ``values`` are aggregates over the nodes of one position: those on one spot weigh alike
    everywhere, so they are one element with their sums and numbers.
    """
    spots = nodes.groupBy("longitude", "latitude").agg(*values)
    names = spots.columns[2:]
    spots = materialise(spots)
    count = spots.agg(F.count("*")).scalar()
    sized = spots.withColumn("_blocks", F.ceil(count / F.lit(WIND_BLOCK)))
    return (
        sized.withColumn("_block", F.pmod(F.xxhash64("longitude", "latitude"), F.col("_blocks")))
        .groupBy("_block")
        .agg(F.array_sort(F.collect_list(F.struct("longitude", "latitude", *names))).alias("_nodes"))
    )


def _every_block(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each place once per block: one row per thousand nodes, not one per node."""
    ids = blocks.agg(F.collect_list("_block")).scalar()
    return places.withColumn("_block", F.explode(ids)).join(blocks, "_block")


def add_wind(incidents: DataFrame, wind: DataFrame | None, parity: bool = False) -> DataFrame:
    """Inverse-distance wind at every incident from all the nodes.

    The mean runs over the nodes that have the value, and is null if none has.
    ``parity`` keeps the published arithmetic: a missing value counts as zero.
    """
    if wind is None:
        return _nulls(incidents, WIND_COLUMNS)
    return by_place(incidents, lambda p: wind_at(p, wind, parity), list(WIND_COLUMNS))


def wind_at(places: DataFrame, wind: DataFrame, parity: bool = False) -> DataFrame:
    """Weighted sums over all the nodes; only the sums of each place are shuffled."""
    nodes = wind.where(F.col("direction_to_deg").isNotNull())
    rad = F.radians("direction_to_deg")
    values = [
        F.count("*").alias("n"), F.sum(F.sin(rad)).alias("u"), F.sum(F.cos(rad)).alias("v"),
        *[F.sum(c).alias(c) for c in NODE_VALUES], *[F.count(c).alias(f"n_{c}") for c in NODE_VALUES],
    ]
    pairs = _every_block(places, _node_blocks(nodes, values)).select("lat", "lon", F.inline("_nodes"))
    km = geo.flat_km(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    near = F.greatest(F.col("km"), F.lit(0.5))
    weighed = pairs.withColumn("km", km).withColumn("w", F.lit(1.0) / F.pow(near, F.lit(C.IDW_POWER)))

    def total(name: str) -> Column:
        return F.sum(F.col(name) * F.col("w"))

    def mean(name: str, decimals: int) -> Column:
        weight = F.col("_w") if parity else F.col(f"_k_{name}")
        return F.bround(F.coalesce(F.col(f"_s_{name}"), F.lit(0.0) if parity else F.lit(None)) / weight, decimals)

    merged = weighed.groupBy("lat", "lon").agg(
        F.min("km").alias("_closest"), F.sum(F.col("n") * F.col("w")).alias("_w"), total("u").alias("_u"), total("v").alias("_v"),
        *[total(n).alias(f"_s_{n}") for n in NODE_VALUES],
        *[F.sum(F.when(F.col(f"n_{n}") > 0, F.col(f"n_{n}") * F.col("w"))).alias(f"_k_{n}") for n in NODE_VALUES],
    )
    towards = F.pmod(F.degrees(F.atan2(F.col("_u") / F.col("_w"), F.col("_v") / F.col("_w"))) + 360.0, F.lit(360.0))
    return (
        merged.where(F.col("_closest") <= C.WIND_MAX_KM)
        .withColumn("_to", towards)
        .select(
            "lat", "lon",
            mean("speed_kmh", 1).alias("viento_kmh"),
            mean("gusts_kmh", 1).alias("viento_rachas_kmh"),
            F.bround("_to", 1).alias("viento_hacia_deg"),
            domain.compass(F.col("_to") + 180.0).alias("viento_cardinal_desde"),
            mean("temp_c", 1).alias("temp_c"),
            mean("humedad_pct", 0).alias("humedad_pct"),
        )
    )


def sample_wind_field(targets: DataFrame, wind: DataFrame) -> DataFrame:
    """Velocity components at ``targets(name, latitude, longitude)``.

    Planar degrees, and a target standing on a node takes the node's own values.
    """
    nodes = wind.where(F.col("direction_to_deg").isNotNull() & F.col("speed_kmh").isNotNull())
    rad = F.radians("direction_to_deg")
    u, v = F.sin(rad) * F.col("speed_kmh"), F.cos(rad) * F.col("speed_kmh")
    values = [
        F.count("*").alias("n"), F.sum(u).alias("u"), F.sum(v).alias("v"), F.sum("speed_kmh").alias("s"),
        F.min(F.struct(u.alias("u"), v.alias("v"), F.col("speed_kmh").alias("s"))).alias("first"),
    ]
    blocks = _node_blocks(nodes, values)
    # Targets on one spot get one sum; they are joined back by it.
    placed = targets.select("name", F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon")).distinct()
    spots = placed.select("_lat", "_lon").distinct()
    pairs = _every_block(spots, blocks).select("_lat", "_lon", F.inline("_nodes"))
    dx, dy = F.col("_lon") - F.col("longitude"), F.col("_lat") - F.col("latitude")
    squared = pairs.withColumn("d2", dx * dx + dy * dy)
    exact = F.col("d2") < 1e-8

    def total(name: str) -> Column:
        return F.sum(F.when(~exact, F.col(name) / F.col("d2")))

    merged = squared.groupBy("_lat", "_lon").agg(
        total("u").alias("_u"), total("v").alias("_v"), total("s").alias("_s"), total("n").alias("_w"),
        F.min(F.when(exact, F.struct("d2", "first"))).alias("_hit"),
    )

    def pick(field: str, total_col: str) -> Column:
        return F.coalesce(F.col(f"_hit.first.{field}"), F.col(total_col) / F.nullif(F.col("_w"), F.lit(0.0)))

    at = merged.select(
        F.col("_lat").alias("latitude"), F.col("_lon").alias("longitude"),
        pick("u", "_u").alias("u"), pick("v", "_v").alias("v"), pick("s", "_s").alias("speed_kmh"),
    )
    same = placed["_lat"].eqNullSafe(at["latitude"]) & placed["_lon"].eqNullSafe(at["longitude"])
    return placed.join(at, same).select("name", "latitude", "longitude", "u", "v", "speed_kmh")


# --- Warnings ------------------------------------------------------------------

WARNING_COLUMNS = {
    "aviso_nivel": "string", "aviso_nivel_orden": "int", "aviso_fenomeno": "string",
    "aviso_titular": "string",
}


def add_warnings(incidents: DataFrame, warnings: DataFrame | None) -> DataFrame:
    """The most serious warning covering the position."""
    if warnings is None:
        return _nulls(incidents, WARNING_COLUMNS)
    return by_place(incidents, lambda p: warnings_at(p, warnings), list(WARNING_COLUMNS))


def warnings_at(places: DataFrame, warnings: DataFrame) -> DataFrame:
    named = warnings.select(
        "id", "rings",
        F.col("nivel").alias("aviso_nivel"), F.col("nivel_orden").alias("aviso_nivel_orden"),
        F.col("fenomeno").alias("aviso_fenomeno"), F.col("titular").alias("aviso_titular"),
    )
    order = [-F.col("aviso_nivel_orden"), F.col("id")]
    return locate_places(places, named, order, list(WARNING_COLUMNS), "lat", "lon")


# --- Road closures -------------------------------------------------------------


def road_label() -> Column:
    name = F.trim("carretera")
    return F.when(F.col("pk").isNotNull(), F.concat(name, F.lit(" pk "), F.col("pk"))).otherwise(name)


def closures_near(places: DataFrame, closures: DataFrame, radius: float = C.CLOSURE_RADIUS_M) -> DataFrame:
    """``(lat, lon, cortes_cerca, cortes_cerca_por_incendio)`` where there is at least one."""
    caused = F.coalesce("por_incendio", F.lit(False))
    sites = (
        placed(closures, "latitude", "longitude")
        .groupBy("_zone", "_x", "_y")
        .agg(F.count("*").alias("_n"), F.count_if(caused).alias("_f"))
    )
    return (
        within(placed(places, "lat", "lon"), sites, radius)
        .groupBy("lat", "lon")
        .agg(F.sum("_n").alias("cortes_cerca"), F.sum("_f").alias("cortes_cerca_por_incendio"))
    )


def roads_near(places: DataFrame, closures: DataFrame, radius: float = C.CLOSURE_RADIUS_M) -> DataFrame:
    """``(lat, lon, cortes_vias)``: three road names and how many more.

    Names are made distinct before the join and again per place; only the first three
    are ever gathered, the rest is a count.
    """
    declared = F.coalesce("por_incendio", F.lit(False))
    roads = (
        placed(closures.where(F.col("carretera").isNotNull()), "latitude", "longitude")
        .withColumns({"_label": road_label(), "_late": ~declared})
        .groupBy("_zone", "_x", "_y", "_label")
        .agg(F.min(F.struct("_late", "carretera")).alias("_o"))
    )
    named = (
        within(placed(places, "lat", "lon"), roads, radius)
        .groupBy("lat", "lon", "_label")
        .agg(F.min("_o").alias("_o"))
    )
    w = Window.partitionBy("lat", "lon").orderBy("_o", "_label")
    top = (
        named.withColumn("_rn", F.row_number().over(w))
        .where(F.col("_rn") <= C.MAX_ROADS)
        .groupBy("lat", "lon")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "_label"))).alias("_top"))
    )
    counts = named.groupBy("lat", "lon").agg(F.count("*").alias("_all"))
    listed = F.array_join(F.transform("_top", lambda r: r["_label"]), " · ")
    more = F.concat(
        listed, F.lit(" · y "), (F.col("_all") - C.MAX_ROADS).cast("string"), F.lit(" más")
    )
    return top.join(counts, ["lat", "lon"]).select(
        "lat", "lon", F.when(F.col("_all") > C.MAX_ROADS, more).otherwise(listed).alias("cortes_vias")
    )


COUNTED = ("cortes_cerca", "cortes_cerca_por_incendio")
CLOSURE_COLUMNS = {**{c: "long" for c in COUNTED}, "cortes_vias": "string"}


def closures_at(places: DataFrame, closures: DataFrame) -> DataFrame:
    """Counts and road names at every place that has a closure near; closures are projected once."""
    needed = closures.select("latitude", "longitude", "por_incendio", "carretera", "pk")
    metric = materialise(with_metres(needed, "latitude", "longitude"))
    return closures_near(places, metric).join(roads_near(places, metric), ["lat", "lon"], "left")


def _no_closures(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in COUNTED})


def add_closures(incidents: DataFrame, closures: DataFrame | None) -> DataFrame:
    if closures is None:
        return _nulls(incidents, CLOSURE_COLUMNS)
    return _no_closures(by_place(incidents, lambda p: closures_at(p, closures), list(CLOSURE_COLUMNS)))


# --- Growth --------------------------------------------------------------------


def add_growth(incidents: DataFrame, hotspots: DataFrame | None, now: Column) -> DataFrame:
    """Observed growth: detections of the last six hours, as hectares per hour."""
    if hotspots is None or "fire_id" not in hotspots.columns:
        return _nulls(incidents, {"focos_recientes": "long", "crecimiento_ha_h": "double"})
    since = now - F.expr(f"INTERVAL {int(C.GROWTH_WINDOW_HOURS)} HOURS")
    recent = (
        hotspots.where(F.col("acq_dt") >= since)
        .groupBy(F.col("fire_id").alias("id"))
        .agg(F.count("*").alias("_n"))
    )
    n = F.coalesce("_n", F.lit(0)).cast("long")
    rate = F.bround(n * F.lit(C.HECTARES_PER_HOTSPOT) / F.lit(C.GROWTH_WINDOW_HOURS), 1)
    return (
        incidents.drop("focos_recientes", "crecimiento_ha_h")
        .join(recent, "id", "left")
        .withColumns({"focos_recientes": n, "crecimiento_ha_h": rate})
        .drop("_n")
    )


# --- Settlements ---------------------------------------------------------------

SETTLEMENT_COLUMNS = {
    "nucleo_cercano": "string", "nucleo_cercano_km": "double", "nucleo_cercano_habitantes": "long",
}


def nearest_settlement(places: DataFrame, settlements: DataFrame) -> DataFrame:
    """Nearest inhabited settlement; the 50 km limit applies to the rounded distance."""
    inhabited = settlements.where(F.coalesce(F.col("habitantes").try_cast("double"), F.lit(0.0)) > 0)
    sites = materialise(
        with_metres(
            inhabited.select("nombre", F.col("habitantes").try_cast("long").alias("habitantes"), "latitude", "longitude"),
            "latitude", "longitude",
        )
    )
    keyed = placed(places.withColumn("_pid", F.concat_ws("|", "lat", "lon")), "lat", "lon")
    found = nearest(keyed, sites, "_pid", ["nombre", "habitantes"], SETTLEMENT_REACH_M)
    km = F.bround(F.col("_dist") / 1000.0, 1)
    return (
        keyed.select("_pid", "lat", "lon").join(found, "_pid")
        .where(km <= C.SETTLEMENT_MAX_KM)
        .select(
            "lat", "lon", F.col("nombre").alias("nucleo_cercano"), km.alias("nucleo_cercano_km"),
            F.col("habitantes").alias("nucleo_cercano_habitantes"),
        )
    )


def add_settlements(incidents: DataFrame, settlements: DataFrame | None) -> DataFrame:
    if settlements is None:
        return _nulls(incidents, SETTLEMENT_COLUMNS)
    return by_place(
        incidents, lambda p: nearest_settlement(p, settlements), list(SETTLEMENT_COLUMNS)
    )


# --- Land cover ----------------------------------------------------------------


def add_land_cover(incidents: DataFrame, layer: DataFrame | None) -> DataFrame:
    """Land-cover code at the position, its class and type. Never drops a row."""
    if layer is None:
        out = _nulls(incidents, {"suelo_codigo": "string"})
    else:
        coded = layer.select("rings", "code", F.col("code").alias("suelo_codigo"))
        out = locate(incidents, coded, [F.col("code")], ["suelo_codigo"], "lat", "lon")
    return out.withColumns(
        {
            "suelo_clase": domain.land_cover_class(F.col("suelo_codigo")),
            "suelo_tipo": domain.land_cover_type(F.col("suelo_codigo")),
        }
    )


def enrich(
    incidents: DataFrame,
    now: Column,
    wind: DataFrame | None = None,
    warnings: DataFrame | None = None,
    closures: DataFrame | None = None,
    hotspots: DataFrame | None = None,
    settlements: DataFrame | None = None,
) -> DataFrame:
    """The five context joins; each is optional and independent of the others.

    All that depends on the position is gathered in one table of places and joined back
    to the incidents once; a centroid with many incidents is one skewed key there.
    """
    layers = [
        (wind, WIND_COLUMNS, wind_at), (warnings, WARNING_COLUMNS, warnings_at),
        (closures, CLOSURE_COLUMNS, closures_at), (settlements, SETTLEMENT_COLUMNS, nearest_settlement),
    ]
    out = incidents.drop(*[c for _, columns, _ in layers for c in columns])
    here = [(layer, columns, lookup) for layer, columns, lookup in layers if layer is not None]
    if here:
        places = places_of(out)
        found = places.select("lat", "lon")
        for layer, columns, lookup in here:
            found = found.join(lookup(places, layer).select("lat", "lon", *columns), ["lat", "lon"], "left")
        kept = out.columns
        out = out.join(found, ["lat", "lon"], "left").select(*kept, *[c for _, columns, _ in here for c in columns])
    for layer, columns, _ in layers:
        if layer is None:
            out = _nulls(out, columns)
    if closures is not None:
        out = _no_closures(out)
    return add_growth(out, hotspots, now)


