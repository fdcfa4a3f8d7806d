"""Counts, grids and reports over detections, fires and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, geo, text, times
from firespark.functions.text import lookup
from firespark.operators import clean as clean_ops
from firespark.operators.rows import number_rows
from firespark.session import materialise


def discards(hotspots: DataFrame, mask: DataFrame | None, territory: DataFrame | None) -> DataFrame:
    """One row: how many detections each cleaning stage removed."""
    return clean_ops.clean_and_count(hotspots, mask, territory)[1]


def persistent_sources(
    history: DataFrame, min_days: int = C.PERSISTENT_MIN_DAYS, approximate: bool = False
) -> DataFrame:
    """Grid cells seen hot on many different days.

    Distinct days and values are counted per (cell, day) first, so the heaviest cell
    is spread over its days before the final aggregate. The median is exact: values
    are pre-counted and the frequency-weighted percentile merges the counts.
    ``approximate`` trades the exact day count and median for fixed-size sketches.
    """
    side = F.lit(C.PERSISTENT_CELL_DEG)
    cells = history.select(
        (F.round(F.col("latitude") / side) * side).alias("lat"),
        (F.round(F.col("longitude") / side) * side).alias("lon"),
        F.to_date("acq_dt").alias("day"),
        "frp_mw",
    )
    if approximate:
        out = cells.groupBy("lat", "lon").agg(
            F.approx_count_distinct("day").alias("active_days"),
            F.count("*").alias("detections"),
            F.approx_percentile("frp_mw", 0.5).alias("frp_median"),
        )
        return out.where(F.col("active_days") >= min_days)
    counted = cells.groupBy("lat", "lon", "day", "frp_mw").agg(F.count("*").alias("n"))
    days = (
        counted.groupBy("lat", "lon", "day").agg(F.sum("n").alias("n"))
        .groupBy("lat", "lon")
        .agg(F.count("*").alias("active_days"), F.sum("n").alias("detections"))
        .where(F.col("active_days") >= min_days)
    )
    values = (
        counted.where(F.col("frp_mw").isNotNull()).groupBy("lat", "lon", "frp_mw").agg(F.sum("n").alias("n"))
        .groupBy("lat", "lon")
        .agg(F.percentile("frp_mw", F.lit(0.5), F.col("n")).alias("frp_median"))
    )
    return days.join(values, ["lat", "lon"], "left").orderBy(F.desc("active_days"), "lat", "lon")


SKETCH_K = 400


def day_partials(history: DataFrame) -> DataFrame:
    """(day, lat, lon, n, sketch, counts): what a day adds to each cell, mergeable in any order.

    ``sketch`` is a quantile sketch of the power, ``counts`` its exact value counts. A cell's
    values of one day are bounded by the satellite passes of a day.
    """
    side = F.lit(C.PERSISTENT_CELL_DEG)
    cells = history.select(
        F.to_date("acq_dt").alias("day"), (F.round(F.col("latitude") / side) * side).alias("lat"),
        (F.round(F.col("longitude") / side) * side).alias("lon"), F.col("frp_mw").cast("double").alias("frp_mw"),
    )
    counted = cells.groupBy("day", "lat", "lon", "frp_mw").agg(F.count("*").alias("n"))
    values = F.array_sort(F.collect_list(F.when(F.col("frp_mw").isNotNull(), F.struct("frp_mw", "n"))))
    exact = counted.groupBy("day", "lat", "lon").agg(F.sum("n").alias("n"), values.alias("counts"))
    sketched = cells.where("frp_mw is not null").groupBy("day", "lat", "lon").agg(F.kll_sketch_agg_double("frp_mw", SKETCH_K).alias("sketch"))
    return exact.join(sketched, ["day", "lat", "lon"], "left")


def persistent_from_partials(partials: DataFrame, min_days: int = C.PERSISTENT_MIN_DAYS, approximate: bool = False) -> DataFrame:
    """``persistent_sources`` of all days from their partials: as many rows as cells have days, however long the history."""
    per_cell = partials.groupBy("lat", "lon").agg(F.count("*").alias("active_days"), F.sum("n").alias("detections"))
    days = per_cell.where(F.col("active_days") >= min_days)
    if approximate:
        merged = partials.where("sketch is not null").groupBy("lat", "lon").agg(F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))
        values = merged.select("lat", "lon", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5)).alias("frp_median"))
    else:
        each = partials.select("lat", "lon", F.explode("counts").alias("v")).groupBy("lat", "lon", "v.frp_mw").agg(F.sum("v.n").alias("n"))
        values = each.groupBy("lat", "lon").agg(F.percentile("frp_mw", F.lit(0.5), F.col("n")).alias("frp_median"))
    return days.join(values, ["lat", "lon"], "left").orderBy(F.desc("active_days"), "lat", "lon")


def named_candidates(cells: DataFrame) -> DataFrame:
    """Candidate mask sites, numbered by how persistent they are. Never applied as such.

    The sorted cells are stored first, so that numbering them twice gives one answer.
    """
    ordered = materialise(cells.orderBy(F.desc("active_days"), "lat", "lon"))
    return number_rows(ordered, "_rank").withColumns(
        {"name": F.concat(F.lit("auto_"), F.col("_rank").cast("string")), "kind": F.lit("auto")}
    ).drop("_rank")


def combined_layer(reliable: DataFrame, low: DataFrame) -> DataFrame:
    """Published detections: reliable ones with their fire, low-confidence ones without."""
    left = reliable.withColumn("confianza_baja", F.lit(False))
    right = low.withColumn("fire_id", F.lit(None).cast("string"))
    return left.unionByName(right, allowMissingColumns=True)


BOX = ("west", "south", "east", "north")


def box_overlaps(boxes: DataFrame, side: float = 1.0) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of overlapping boxes ``(id, west, south, east, north)``, copies included.

    Boxes meet through grid cells, once per distinct bounds; a pair sharing several cells
    is reported by one of them only: the cell holding the south-west corner of the shared
    part. The boxes of the two bounds are told pair by pair at the end, so the work beyond
    the output does not grow with piled copies.
    """
    single = boxes.select(*BOX).distinct()
    cells = single.withColumn(
        "gx", F.explode(F.sequence(geo.cell(F.col("west"), side), geo.cell(F.col("east"), side)))
    ).withColumn("gy", F.explode(F.sequence(geo.cell(F.col("south"), side), geo.cell(F.col("north"), side))))
    a, b = cells.alias("a"), cells.alias("b")
    strict = geo.boxes_overlap(tuple(F.col(f"a.{c}") for c in BOX), tuple(F.col(f"b.{c}") for c in BOX))
    corner = (geo.cell(F.greatest("a.west", "b.west"), side) == F.col("a.gx")) & (
        geo.cell(F.greatest("a.south", "b.south"), side) == F.col("a.gy")
    )
    # Both orders: a box of either bounds may have the smaller id.
    on = (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy"))
    met = a.join(b, on & strict & corner).select(*[F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in BOX])

    def members(t: str) -> DataFrame:
        return boxes.select(F.col("id").alias(t), *[F.col(c).alias(f"{t}_{c}") for c in BOX])

    left = met.join(members("a"), [f"a_{c}" for c in BOX])
    return left.join(members("b"), [f"b_{c}" for c in BOX]).where("a < b").select("a", "b")


def daily_evolution(hotspots: DataFrame, now: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Detections and hectares per UTC day; today is marked as partial."""
    day = F.date_format("acq_dt", "yyyy-MM-dd")
    n = F.col("focos")
    return (
        hotspots.where(F.col("acq_dt").isNotNull())
        .groupBy(*by, day.alias("dia"))
        .agg(F.count("*").alias("focos"))
        .withColumns(
            {
                "etiqueta": F.concat(F.substring("dia", 9, 2), F.lit("/"), F.substring("dia", 6, 2)),
                "hectareas": F.floor(n * F.lit(C.HECTARES_PER_HOTSPOT) + 0.5).cast("long"),
                "parcial": F.col("dia") == F.date_format(now, "yyyy-MM-dd"),
            }
        )
    )


def tile_groups(incidents: DataFrame, zoom: int) -> DataFrame:
    """Incidents per map tile, with the worst intensity of the group."""
    col, row = geo.web_tile(F.col("lat"), F.col("lon"), zoom)
    rank = F.coalesce(lookup(C.INTENSITY_RANK, F.col("intensity")), F.lit(1))
    return (
        incidents.withColumns({"tile_x": col, "tile_y": row})
        .groupBy("tile_x", "tile_y")
        .agg(F.count("*").alias("n"), F.max(rank).cast("int").alias("peor"))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("(nulo)")).alias("valor")).agg(
        F.lit(column).alias("campo"), F.count("*").alias("n")
    )


def sensor_family(instrument: Column) -> Column:
    upper = F.upper(instrument)
    chain = F.when(F.lit(False), F.lit(""))
    for family_id, _, prefix, *_ in C.SENSOR_FAMILIES:
        chain = chain.when(upper.startswith(prefix), F.lit(family_id))
    return chain


def families(hotspots: DataFrame) -> DataFrame:
    """Record count and newest sighting of the three declared families, present or not."""
    spark = hotspots.sparkSession
    declared = spark.createDataFrame(
        [tuple(f) for f in C.SENSOR_FAMILIES],
        "source_id string, name string, prefix string, precision_m double, ttl_seconds long,"
        " critical boolean, max_data_age_seconds long",
    )
    counted = (
        hotspots.withColumn("source_id", sensor_family(F.col("instrument")))
        .where(F.col("source_id").isNotNull())
        .groupBy("source_id")
        .agg(F.count("*").alias("records"), F.max("acq_dt").alias("latest_data_at"))
    )
    return declared.join(counted, "source_id", "left").withColumn(
        "records", F.coalesce("records", F.lit(0)).cast("long")
    )


def data_ages(hotspots: DataFrame, official: DataFrame | None, now: Column) -> DataFrame:
    """``(clave, edad_s)`` for each family present and for the reports."""
    rows = (
        hotspots.withColumn("clave", sensor_family(F.col("instrument")))
        .where(F.col("clave").isNotNull())
        .groupBy("clave")
        .agg(F.max("acq_dt").alias("latest"))
    )
    if official is not None:
        newest = official.agg(F.max("reported_at").alias("latest")).withColumn("clave", F.lit("official"))
        rows = rows.unionByName(newest.where(F.col("latest").isNotNull()))
    return rows.select("clave", times.whole_seconds(now, F.col("latest")).alias("edad_s"))


def sensor_lag(hotspots: DataFrame, now: Column, late_hours: float = 6.0) -> DataFrame:
    """Rows, newest sighting and lag per satellite product; late beyond six hours."""
    rolled = hotspots.groupBy("source").agg(F.count("*").alias("filas"), F.max("acq_dt").alias("_newest"))
    hours = times.hours_between(now, F.col("_newest"))
    return rolled.select(
        "source", "filas", times.iso_z(F.col("_newest")).alias("mas_reciente"),
        F.bround(hours, 1).alias("horas"), (hours > late_hours).alias("retrasado"),
    )


def layer_plausibility(
    points: DataFrame, low: int, high: int, box: tuple[float, float, float, float],
    lat: str = "lat", lon: str = "lon", min_width: float = 10.0,
) -> DataFrame:
    """Row-count band, bounds within a degree of the box, and enough width."""
    west, south, east, north = box
    stats = points.agg(
        F.count("*").alias("n"), F.min(lon).alias("oeste"), F.max(lon).alias("este"),
        F.min(lat).alias("sur"), F.max(lat).alias("norte"),
    )
    return stats.select(
        "n", "oeste", "sur", "este", "norte",
        F.col("n").between(low, high).alias("recuento_ok"),
        ((F.col("oeste") >= west - 1) & (F.col("este") <= east + 1) & (F.col("sur") >= south - 1)
         & (F.col("norte") <= north + 1)).alias("caja_ok"),
        ((F.col("este") - F.col("oeste")) >= min_width).alias("ancho_ok"),
    )


def missing_controls(df: DataFrame, column: str, controls: list[str]) -> DataFrame:
    """Control names the layer does not contain."""
    wanted = df.sparkSession.createDataFrame([(c,) for c in controls], "control string")
    return wanted.join(df, F.col("control") == F.col(column), "left_anti")


def name_like_columns(df: DataFrame) -> DataFrame:
    """For every text column, whether its content reads as names. One pass."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    letters = "[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]"
    melted = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("columna"), F.col(n).alias("v")) for n in names])).alias("c"))
    by_value = melted.where(F.col("c.v").isNotNull()).groupBy("c.columna", "c.v").agg(F.count("*").alias("n"))
    stats = by_value.groupBy("columna").agg(
        F.sum("n").alias("valores"), F.count("*").alias("distintos"),
        F.sum(F.when(F.col("v").rlike(letters), F.col("n")).otherwise(0)).alias("con_letras"),
    )
    return stats.withColumn(
        "parece_nombre",
        (F.col("valores") >= 20)
        & (F.col("distintos") / F.col("valores") > 0.5)
        & (F.col("con_letras") / F.col("valores") > 0.95),
    )


# Words that hint which contract field a feed's column may feed.
FIELD_HINTS = {
    "external_id": ("objectid", "id_incendio", "codigo", "id", "fid", "num"),
    "status": ("estado", "situacion", "fase", "estat"),
    "municipio": ("municipio", "muni", "termino", "localidad", "poblacion"),
    "provincia": ("provincia", "prov"),
    "level": ("igr", "nivel", "gravedad"),
    "resources": ("medios", "recursos", "dotacio"),
    "reported_at": ("fecha", "alta", "inicio", "deteccion", "data", "hora"),
}


def field_inventory(records: DataFrame, column: str) -> DataFrame:
    """Fields of a map column: how often filled, and a sample value."""
    flat = records.select(F.explode(column).alias("campo", "valor"))
    filled = text.blank_to_null(F.col("valor"))
    return flat.groupBy("campo").agg(
        F.count("*").alias("presentes"), F.count(filled).alias("con_valor"), F.min(filled).alias("muestra")
    )


def propose_field_map(inventory: DataFrame) -> DataFrame:
    """First field, by name, whose lower-cased name contains a hint of each target."""
    low = F.lower("campo")
    options = []
    for target, hints in FIELD_HINTS.items():
        hit = F.lit(False)
        for h in hints:
            hit = hit | low.contains(h)
        options.append(F.when(hit, F.lit(target)))
    return (
        inventory.select("campo", F.explode(F.array_compact(F.array(*options))).alias("destino"))
        .groupBy("destino")
        .agg(F.min("campo").alias("campo"))
    )


def status_counts_label(incidents: DataFrame, now: Column) -> DataFrame:
    seen = times.hours_between(now, F.col("last_detected"))
    return incidents.groupBy(domain.status_text(F.col("status"), F.round(seen, 1)).alias("texto")).agg(
        F.count("*").alias("n")
    )
