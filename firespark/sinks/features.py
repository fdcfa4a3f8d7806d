"""GeoJSON and JSON text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark.functions import times

HOTSPOT_FIELDS = (
    "acq_dt", "frp_mw", "confidence_pct", "fire_id", "daynight", "instrument", "confianza_baja",
)
FIRE_FIELDS = (
    "fire_id", "status", "intensity", "n_hotspots", "frp_total_mw", "area_est_ha", "first_detected",
    "last_detected", "hours_since_last", "municipio", "provincia",
)
PERIMETER_FIELDS = ("fire_id", "hull_area_ha", "is_estimate")


def iso_dates(df: DataFrame) -> DataFrame:
    """Every timestamp column as ISO text."""
    dates = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp"]
    return df.withColumns({c: times.iso_z(F.col(c)) for c in dates})


def point_geometry(lat: str, lon: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def polygon_geometry(rings: str) -> Column:
    """Each ring as a part of its own: the perimeters written here have no holes."""
    parts = F.transform(rings, lambda r: F.array(F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    return F.struct(F.lit("MultiPolygon").alias("type"), parts.alias("coordinates"))


def features(df: DataFrame, fields: tuple[str, ...], geometry: Column) -> DataFrame:
    """One GeoJSON feature per row, limited to the listed fields that exist."""
    kept = [c for c in fields if c in df.columns]
    options = {"ignoreNullFields": "false"}
    dated = iso_dates(df)
    return dated.select(
        F.to_json(
            F.struct(
                F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*kept).alias("properties")
            ),
            options,
        ).alias("value")
    )


def write_features(df: DataFrame, path: str, fields: tuple[str, ...], geometry: Column) -> None:
    """Line-delimited features: written and read in parallel, whatever the size."""
    features(df, fields, geometry).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    iso_dates(df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)
