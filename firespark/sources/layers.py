"""Static layers: polygons, settlements, masks and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firespark.functions import geo, text
from firespark.operators.rows import union_aligned

NAME_COLUMNS = ("NAMEUNIT", "nombre", "NOMBRE", "municipio", "name")
PROVINCE_COLUMNS = ("provincia", "PROVINCIA", "CODNUT3", "nut3")
SIMPLIFY_DEG = 0.0005
COORDINATE_DECIMALS = 5

_GEOMETRY = "struct<type:string,coordinates:string>"
COLLECTION = f"struct<features:array<struct<geometry:{_GEOMETRY},properties:map<string,string>>>>"
_LINE = "array<array<double>>"
_POLYGON = "array<array<array<double>>>"
_MULTI = "array<array<array<array<double>>>>"
POLYGONAL = ("Polygon", "MultiPolygon")


def read_features(documents: DataFrame) -> DataFrame:
    """``(kind, coordinates, props)``; coordinates stay text until the kind is known."""
    parsed = documents.select(F.from_json("value", COLLECTION).alias("d"))
    return parsed.select(F.explode("d.features").alias("f")).select(
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"),
        F.col("f.properties").alias("props"),
    )


FEATURE = f"struct<type:string,geometry:{_GEOMETRY},properties:map<string,string>>"
#: Features name their type first, as writers do; the name is the separator of records.
FEATURE_MARK = '"Feature"'
WAY_MARK = '"way"'


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """The text between marks as rows ``value``: files of any size are split between tasks.

    What follows the end of an object (the start of the next one, or the end of the
    document) stays at the end of a piece; the JSON reader stops before it.
    """
    return spark.read.text(path, lineSep=mark)


def scan_features(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, coordinates, props)`` of the features under a path, read in pieces.

    Documents whose features don't say ``"Feature"``, first of all, can't be cut: then all
    are read whole, one row each, as ``read_features`` does. A piece that breaks off in the
    middle is an error, not a missing row.
    """
    head = F.col("value").rlike(r"^\s*[{\[]")
    pieces = _pieces(spark, path, FEATURE_MARK).where(~head)
    if pieces.isEmpty() or not pieces.where(F.col("value").rlike(r"^\s*\}")).isEmpty():
        return read_features(spark.read.text(path, wholetext=True))
    parsed = pieces.select("value", F.from_json(F.concat(F.lit('{"type":"Feature"'), "value"), FEATURE).alias("f"))
    # The condition is repeated here: an optimised plan may look at this before the filter.
    broken = ~head & F.col("f.type").isNull()
    whole = F.when(broken, F.raise_error(F.lit("a feature of the layer breaks off"))).otherwise(F.col("f"))
    return parsed.select(whole.alias("f")).select(
        F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("props")
    )


def _rings(polygons: Column) -> Column:
    return F.transform(
        polygons, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    )


def polygon_layer(features: DataFrame) -> DataFrame:
    """Rings of polygons and multipolygons; other geometries are left out."""
    one = F.from_json("coordinates", _POLYGON)
    many = F.flatten(F.from_json("coordinates", _MULTI))
    rings = _rings(F.when(F.col("kind") == "Polygon", one).otherwise(many))
    return features.where(F.col("kind").isin(*POLYGONAL)).select("props", rings.alias("rings"))


def non_polygonal(features: DataFrame) -> DataFrame:
    """Geometry kinds that disqualify a layer meant to be polygons."""
    other = ~F.coalesce(F.col("kind").isin(*POLYGONAL), F.lit(False))
    return features.where(other).groupBy("kind").agg(F.count("*").alias("n"))


def municipalities(features: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``(municipio, provincia, rings)`` under whichever names the layer uses.

    ``keys`` are the property names present (a profile job finds them).
    """
    name = next((c for c in NAME_COLUMNS if c in keys), None)
    province = next((c for c in PROVINCE_COLUMNS if c in keys), None)

    def prop(key: str | None) -> Column:
        return F.try_element_at("props", F.lit(key)) if key else F.lit(None).cast("string")

    return polygon_layer(features).select(
        prop(name).alias("municipio"), prop(province).alias("provincia"), "rings"
    )


def point_layer(features: DataFrame) -> DataFrame:
    xy = F.from_json("coordinates", "array<double>")
    return features.where(F.col("kind") == "Point").select(
        xy[1].alias("latitude"), xy[0].alias("longitude"), "props"
    )


def settlements(features: DataFrame) -> DataFrame:
    """Six attributes per settlement; the geometry is never looked at."""
    def prop(name: str) -> Column:
        return F.try_element_at("props", F.lit(name))

    lat, lon = prop("latitud").try_cast("double"), prop("longitud").try_cast("double")
    return features.where(lat.isNotNull() & lon.isNotNull()).select(
        prop("nombre").alias("nombre"), prop("habitantes").try_cast("long").alias("habitantes"), prop("tipo").alias("tipo"),
        prop("codine").alias("codine"), lat.alias("latitude"), lon.alias("longitude"),
    )


WAY = "struct<type:string,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>>"


_XY = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(T.ArrayType(_XY))
def simplify(lines: pd.Series) -> pd.Series:
    """Drop the vertices that stay within the tolerance of the line without them."""

    def one(points) -> list:
        xy = np.array([[p["x"], p["y"]] for p in points], dtype=float)
        keep = np.zeros(len(xy), dtype=bool)
        keep[[0, -1]] = True
        spans = [(0, len(xy) - 1)]
        while spans:
            i, j = spans.pop()
            if j - i < 2:
                continue
            base, inner = xy[j] - xy[i], xy[i + 1 : j] - xy[i]
            length2 = float(base @ base)
            along = np.clip(inner @ base / length2, 0.0, 1.0) if length2 else np.zeros(len(inner))
            off = np.hypot(*(inner - along[:, None] * base).T)
            worst = int(np.argmax(off))
            if off[worst] > SIMPLIFY_DEG:
                k = i + 1 + worst
                keep[k] = True
                spans += [(i, k), (k, j)]
        return [
            {"x": round(float(x), COORDINATE_DECIMALS), "y": round(float(y), COORDINATE_DECIMALS)}
            for x, y in xy[keep]
        ]

    return lines.map(one)


def scan_ways(spark: SparkSession, path: str) -> DataFrame:
    """``(kv, line)``: lines of two points or more, simplified and rounded, read in pieces.

    Elements say their type first. Nodes and relations between the ways are passed over.
    """
    pieces = _pieces(spark, path, WAY_MARK).where(F.col("value").rlike(r"^\s*,"))
    rows = pieces.select(F.from_json(F.concat(F.lit('{"type":"way"'), "value"), WAY).alias("w"))
    usable = rows.where(F.size("w.geometry") >= 2)
    line = F.transform("w.geometry", lambda p: F.struct(p["lon"].alias("x"), p["lat"].alias("y")))
    return usable.select(
        text.kilovolts(F.try_element_at("w.tags", F.lit("voltage"))).alias("kv"), simplify(line).alias("line")
    )


def rings_to_degrees(layer: DataFrame, zone: int) -> DataFrame:
    """Rings given in UTM metres, as degrees."""

    def degrees(p: Column) -> Column:
        lat, lon = geo.utm_to_degrees(p["x"], p["y"], zone)
        return F.struct(lon.alias("x"), lat.alias("y"))

    return layer.withColumn("rings", F.transform("rings", lambda r: F.transform(r, degrees)))


def read_layers(spark: SparkSession, parts: list[tuple[str, int | None]]) -> DataFrame:
    """Polygon files joined into one layer; a part in UTM names its zone."""
    frames = []
    for path, zone in parts:
        layer = polygon_layer(scan_features(spark, path))
        frames.append(layer if zone is None else rings_to_degrees(layer, zone))
    return union_aligned(frames)
