"""Manifests: one row describing a publication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import times
from firespark.operators.summaries import data_ages

SCHEMA_VERSION = 1
LEGACY_SOURCES = ("NASA FIRMS VIIRS (S-NPP, NOAA-20, NOAA-21)", "NASA FIRMS MODIS")


def ages_map(ages: DataFrame) -> DataFrame:
    """``(data_age_seconds, worst_data_age_seconds)``; at most one entry per family."""
    return ages.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("clave", "edad_s")))).alias("data_age_seconds"),
        F.max("edad_s").alias("worst_data_age_seconds"),
    )


def incident_counts(incidents: DataFrame) -> DataFrame:
    sat = F.coalesce("satellite_confirmed", F.lit(False))
    off = F.coalesce("official_confirmed", F.lit(False))
    return incidents.agg(
        F.count("*").alias("incidents_total"),
        F.count_if(sat).alias("incidents_satellite_confirmed"),
        F.count_if(off & ~sat).alias("incidents_official_only"),
        F.coalesce(F.sum("frp_total_mw"), F.lit(0.0)).alias("_frp"),
    )


def build_manifest(
    hotspots: DataFrame,
    incidents: DataFrame,
    official: DataFrame | None,
    now: Column,
    suppressed: DataFrame | None = None,
    started_at: Column | None = None,
) -> DataFrame:
    """One row. ``suppressed`` is the discard accounting; its columns may be missing."""
    ages = ages_map(data_ages(hotspots, official, now))
    counted = incident_counts(incidents)
    detections = hotspots.agg(F.count("*")).scalar()

    def dropped(name: str) -> Column:
        return F.lit(0).cast("long") if suppressed is None else suppressed.select(name).scalar()

    worst = F.col("worst_data_age_seconds")
    late = worst > C.MAX_DATA_AGE_S
    reason = F.concat(
        F.lit("el dato más antiguo tiene "), F.format_number(worst / 3600.0, 1), F.lit(" h (umbral: 4 h)")
    )
    facts = counted.withColumns(
        {
            "hotspots_24h": detections,
            "hotspots_suppressed_industrial": dropped("industrial"),
            "hotspots_suppressed_lowconf": dropped("lowconf"),
            "hotspots_deduplicated": dropped("deduplicated"),
            "hotspots_outside_spain": dropped("outside"),
            "data_age_seconds": ages.select("data_age_seconds").scalar(),
            "worst_data_age_seconds": ages.select("worst_data_age_seconds").scalar(),
        }
    )
    counts = [
        "incidents_total", "incidents_satellite_confirmed", "incidents_official_only", "hotspots_24h",
        "hotspots_suppressed_industrial", "hotspots_suppressed_lowconf", "hotspots_deduplicated",
        "hotspots_outside_spain",
    ]
    age = F.lit(0).cast("long") if started_at is None else times.whole_seconds(now, started_at)
    return facts.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        times.iso_z(now).alias("generated_at"),
        age.alias("pipeline_age_seconds"),
        "data_age_seconds", "worst_data_age_seconds",
        F.struct(*counts).alias("counts"),
        F.round("_frp", 1).alias("frp_total_mw"),
        F.coalesce(late, F.lit(False)).alias("degraded"),
        F.when(late, reason).alias("degraded_reason"),
        F.lit(C.DISCLAIMER).alias("disclaimer"),
    )


def legacy_manifest(hotspots: DataFrame, fires: DataFrame, now: Column) -> DataFrame:
    """Older one-row summary kept for its readers."""
    seen = hotspots.agg(F.max("acq_dt").alias("last"), F.count("*").alias("hotspots"))
    totals = fires.agg(
        F.count("*").alias("fires_total"), F.count_if(F.col("status") == "activo").alias("fires_active"),
        F.coalesce(F.sum("frp_total_mw"), F.lit(0.0)).alias("frp_total_mw"),
    )
    both = totals.withColumns({"last": seen.select("last").scalar(), "hotspots": seen.select("hotspots").scalar()})
    minutes = (times.seconds_between(now, F.col("last")) / 60.0).cast("long")
    return both.select(
        times.iso_z(now).alias("generated_at"), times.iso_z(F.col("last")).alias("last_detection_at"),
        minutes.alias("data_age_minutes"), "hotspots", "fires_total", "fires_active", "frp_total_mw",
        F.array(*[F.lit(s) for s in LEGACY_SOURCES]).alias("sources"),
    )
