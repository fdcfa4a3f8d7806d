"""Points uploaded by users: CSV of any dialect, or GeoJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.functions import text
from firespark.operators.rows import number_rows

# Accepted column names.
NAMES = ("nombre", "name", "activo", "descripcion", "descripción", "id")
LATITUDES = ("lat", "latitud", "latitude", "y")
LONGITUDES = ("lon", "lng", "long", "longitud", "longitude", "x")


class AssetFileError(ValueError):
    """The file cannot be read as a list of points."""


def _find(header: list[str], names: tuple[str, ...]) -> int:
    return next((i for i, c in enumerate(header) if c.strip().lower() in names), -1)


def decimal(cell: Column) -> Column:
    """Comma or point decimals; an empty cell is null, never zero."""
    return F.replace(text.blank_to_null(cell), F.lit(","), F.lit(".")).try_cast("double")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(nombre, lat, lon)``. Only the header line is looked at on the driver."""
    lines = spark.read.text(path)
    head = lines.where(F.trim("value") != "").head(1)
    if not head:
        raise AssetFileError("El fichero no tiene datos.")
    first = head[0]["value"].lstrip("﻿")
    sep = ";" if first.count(";") > first.count(",") else ","
    header = first.split(sep)
    i_lat, i_lon, i_name = (_find(header, n) for n in (LATITUDES, LONGITUDES, NAMES))
    if i_lat < 0 or i_lon < 0:
        raise AssetFileError("Faltan columnas de latitud y longitud.")
    return parse_rows(number_rows(lines.where(F.trim("value") != ""), "n"), sep, i_lat, i_lon, i_name)


def parse_rows(lines: DataFrame, sep: str, i_lat: int, i_lon: int, i_name: int) -> DataFrame:
    """``lines(n, value)``, header as 0, to points; rows without both coordinates are skipped."""
    cells = F.split("value", sep)

    def cell(i: int) -> Column:
        return F.try_element_at(cells, F.lit(i + 1)) if i >= 0 else F.lit(None).cast("string")

    default = F.concat(F.lit("Punto "), F.col("n").cast("string"))
    return (
        lines.where(F.col("n") > 0)
        .select(
            F.coalesce(text.blank_to_null(cell(i_name)), default).alias("nombre"),
            decimal(cell(i_lat)).alias("lat"), decimal(cell(i_lon)).alias("lon"),
        )
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


POINTS = (
    "struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>>,"
    "properties:map<string,string>>>>"
)


def parse_geojson(documents: DataFrame) -> DataFrame:
    """Points only, named by the first filled alias."""
    rows = documents.select(F.posexplode(F.from_json("value", POINTS)["features"]).alias("i", "f"))
    names = [text.blank_to_null(F.try_element_at("f.properties", F.lit(c))) for c in NAMES]
    default = F.concat(F.lit("Punto "), (F.col("i") + 1).cast("string"))
    xy = F.col("f.geometry.coordinates")
    return (
        rows.where(F.col("f.geometry.type") == "Point")
        .select(
            F.coalesce(*names, default).alias("nombre"),
            F.try_element_at(xy, F.lit(2)).alias("lat"), F.try_element_at(xy, F.lit(1)).alias("lon"),
        )
        .where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    )


def batch_report(assets: DataFrame, limit: int | None = None) -> DataFrame:
    """One row: how many points, how many look swapped, and the verdict."""
    swapped = (F.abs("lat") <= 10) & (F.abs("lon") >= 30)
    one = assets.agg(F.count("*").alias("n"), F.count_if(swapped).alias("invertidos"))
    too_many = F.lit(False) if limit is None else F.col("n") > limit
    verdict = (
        F.when(F.col("n") == 0, "vacio").when(too_many, "demasiados")
        .when(F.col("invertidos") > F.col("n") / 2, "coordenadas invertidas").otherwise("ok")
    )
    return one.withColumn("veredicto", verdict)


def validate(assets: DataFrame, limit: int | None = None) -> DataFrame:
    verdict = batch_report(assets, limit).head()["veredicto"]
    if verdict != "ok":
        raise AssetFileError(verdict)
    return assets
