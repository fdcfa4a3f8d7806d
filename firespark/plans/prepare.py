"""Preparing static layers: read, judge, and replace the layer in use only if the new one holds.

A cropped or foreign layer would name fires wrongly, which is worse than not naming them;
so nothing is written unless every check passes. Also the job that proposes mask sites.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.operators import polygons, summaries
from firespark.operators.quality import PublicationAborted
from firespark.session import materialise
from firespark.sinks import features as geojson
from firespark.sinks.publish import refuse_small
from firespark.sources import layers

#: What a layer of the whole country has.
MUNICIPALITIES_BAND = (6_500, 9_500)
TOLERATED_CONTROLS = 1
WESTERNMOST, NORTHERNMOST = -17.0, 43.0


@dataclass(frozen=True)
class Limits:
    """What a layer must look like. Bounds in degrees; ``controls`` are (lat, lon, name) of known places."""

    low: int
    high: int
    box: tuple[float, float, float, float] = C.PUBLISH_BOX
    min_width: float = 10.0
    controls: tuple[tuple[float, float, str], ...] = ()
    tolerated: int = TOLERATED_CONTROLS


FINDING = "comprobacion string, valor string"


def _finding(name: str, df: DataFrame, failed, value) -> DataFrame:
    return df.where(failed).select(F.lit(name).alias("comprobacion"), value.cast("string").alias("valor"))


def judge_polygons(features: DataFrame, layer: DataFrame, limits: Limits) -> DataFrame:
    """``(comprobacion, valor)`` of what is wrong with a layer of named polygons; no rows if it holds."""
    kinds = layers.non_polygonal(features)
    shapes = polygons.with_bounds(layer)
    corners = shapes.select(F.inline(F.array(
        F.struct(F.col("south").alias("lat"), F.col("west").alias("lon")), F.struct(F.col("north").alias("lat"), F.col("east").alias("lon"))
    )))
    bounds = summaries.layer_plausibility(corners, 0, 2**62, limits.box, min_width=limits.min_width)
    counted = layer.agg(F.count("*").alias("n"), F.count("municipio").alias("named"))
    found = [
        _finding("recintos", counted, ~F.col("n").between(limits.low, limits.high), F.col("n")),
        _finding("sin nombres", counted, F.col("named") == 0, F.col("n")),
        _finding("geometrías", kinds, F.lit(True), F.concat_ws(" ", F.coalesce("kind", F.lit("ninguna")), "n")),
        _finding("caja", bounds, ~F.coalesce("caja_ok", F.lit(False)), F.concat_ws(",", "oeste", "sur", "este", "norte")),
        _finding("ancho", bounds, ~F.coalesce("ancho_ok", F.lit(False)), F.col("este") - F.col("oeste")),
    ]
    if limits.controls:
        points = layer.sparkSession.createDataFrame(list(limits.controls), "latitude double, longitude double, esperado string")
        told = polygons.control_points(points, layer, "municipio", "esperado")
        found.append(_finding("controles", told, F.col("fallos") > limits.tolerated, F.concat_ws("/", "fallos", "puntos")))
    return reduce(DataFrame.unionByName, found)


def judge_points(points: DataFrame, name: str, limits: Limits) -> DataFrame:
    """The same for a layer of points: count, control names, and that it reaches the far west and north."""
    wide = summaries.layer_plausibility(points, limits.low, limits.high, limits.box, "latitude", "longitude", limits.min_width)
    absent = summaries.missing_controls(points, name, [c[2] for c in limits.controls])
    found = [
        _finding("recuento", wide, ~F.col("recuento_ok"), F.col("n")),
        _finding("falta", absent, F.lit(True), F.col("control")),
        _finding("oeste", wide, ~F.coalesce(F.col("oeste") <= WESTERNMOST, F.lit(False)), F.col("oeste")),
        _finding("norte", wide, ~F.coalesce(F.col("norte") >= NORTHERNMOST, F.lit(False)), F.col("norte")),
    ]
    return reduce(DataFrame.unionByName, found)


def _refuse(found: DataFrame, what: str) -> None:
    wrong = sorted(f"{r.comprobacion}: {r.valor}" for r in found.limit(50).collect())
    if wrong:
        raise PublicationAborted(f"{what} refused, nothing overwritten: " + "; ".join(wrong))


def prepare_municipalities(
    spark: SparkSession, parts: list[tuple[str, int | None]], out: str, limits: Limits = Limits(*MUNICIPALITIES_BAND), keys: tuple[str, ...] = ("NAMEUNIT", "provincia"),
) -> DataFrame:
    """Files of one logical layer, joined, judged and written as feature lines to ``out``.

    A part with a UTM zone is brought to degrees. Returns the layer written.
    """
    features = reduce(DataFrame.unionByName, [layers.scan_features(spark, path) for path, _ in parts])
    rings = layers.read_layers(spark, parts)
    prop = lambda names: F.coalesce(*[F.try_element_at("props", F.lit(k)) for k in names if k in keys], F.lit(None).cast("string"))
    layer = materialise(rings.select(prop(layers.NAME_COLUMNS).alias("municipio"), prop(layers.PROVINCE_COLUMNS).alias("provincia"), "rings"))
    _refuse(judge_polygons(features, layer, limits), "layer of municipalities")
    kept = refuse_small(layer, limits.low, "municipalities")
    geojson.write_features(kept, out, ("municipio", "provincia"), geojson.polygon_geometry("rings"))
    return kept


def prepare_settlements(spark: SparkSession, path: str, out: str, limits: Limits) -> DataFrame:
    """Settlements judged and written; the same refusal."""
    rows = materialise(layers.settlements(layers.scan_features(spark, path)))
    _refuse(judge_points(rows, "nombre", limits), "layer of settlements")
    geojson.write_features(rows, out, ("nombre", "habitantes", "tipo", "codine"), geojson.point_geometry("latitude", "longitude"))
    return rows


def propose_mask(partials: DataFrame, out: str, min_days: int = C.PERSISTENT_MIN_DAYS) -> DataFrame:
    """Cells hot on many days, as named mask candidates in ``out``, from the partials kept beside the history.

    They are proposals: nobody applies them before they are looked at. Without any cell the
    job ends with an error and leaves earlier proposals alone.
    """
    named = materialise(summaries.named_candidates(summaries.persistent_from_partials(partials, min_days)))
    if named.isEmpty():
        raise PublicationAborted(f"no cell is hot on {min_days} days or more; nothing proposed")
    geojson.write_features(named, out, ("name", "kind", "active_days", "detections", "frp_median"), geojson.point_geometry("lat", "lon"))
    return named
