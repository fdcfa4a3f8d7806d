"""Context layers derived from the given tables for the checked queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.functions import domain
from firespark.plans import projections as P

_S = "3 * (s_suppkey % 50)"
STATIONS = {
    "name": "s_name",
    "latitude": f"{P.lat_of(_S)} + (((s_suppkey * 23) % 100) - 50) / 1e2",
    "longitude": f"{P.lon_of(_S)} + (((s_suppkey * 41) % 100) - 50) / 1e2",
    "speed_kmh": "CAST(5 + (s_suppkey * 13) % 60 AS DOUBLE)",
    "gusts_kmh": "CAST(CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE 15 + (s_suppkey * 17) % 70 END AS DOUBLE)",
    "direction_from_deg": "CAST(CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE (s_suppkey * 47) % 360 END AS DOUBLE)",
    "temp_c": "CAST((s_suppkey * 7) % 40 AS DOUBLE)",
    "humedad_pct": "CAST((s_suppkey * 19) % 100 AS DOUBLE)",
    "aqi": "CAST(CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE (s_suppkey * 29) % 140 END AS DOUBLE)",
}
SQL_STATIONS = f"stations AS (SELECT {P._sql_list(STATIONS)} FROM supplier)"
SQL_WIND = (
    f"{SQL_STATIONS}, wind AS (SELECT *, fmod(direction_from_deg + 1.8e2, 3.6e2) AS direction_to_deg"
    " FROM stations WHERE direction_from_deg IS NOT NULL)"
)
LEVELS = ("verde", "amarillo", "naranja", "rojo")
SQL_WARNINGS = (
    f"{P.SQL_AREAS}, warnings AS (SELECT *, 'w' || CAST(area_id AS VARCHAR) AS id,"
    " ['verde','amarillo','naranja','rojo'][level + 1] AS nivel FROM areas WHERE level >= 1)"
)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P._project(P.table(spark, sf_dir, "supplier"), STATIONS)


def wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations(spark, sf_dir).withColumn("direction_to_deg", domain.wind_towards(F.col("direction_from_deg")))


def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*[F.lit(v) for v in LEVELS])
    return (
        P.areas(spark, sf_dir).where("level >= 1")
        .select(
            F.concat(F.lit("w"), F.col("area_id").cast("string")).alias("id"),
            F.element_at(levels, F.col("level") + 1).alias("nivel"),
            F.col("level").alias("nivel_orden"),
            F.lit("viento").alias("fenomeno"), F.col("name").alias("titular"), "rings",
        )
    )
