"""Fusion of official reports with satellite fires."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, text, times
from firespark.functions.text import lookup
from firespark.operators.grids import with_metres
from firespark.operators.quadtree import nearest
from firespark.operators.rows import conform
from firespark.schemas import schema
from firespark.session import materialise, stored


def _row_key(official: DataFrame) -> Column:
    """The same for identical reports, different for all others, nulls included."""
    columns = F.struct(*[F.col(c) for c in sorted(official.columns)])
    return F.sha2(F.to_json(columns, {"ignoreNullFields": "false"}), 256)


def _nearest_at(places: DataFrame, fires: DataFrame) -> DataFrame:
    """``(latitude, longitude, _fire, _seen, _gap)``: the nearest fire of every distinct position, stored.

    It depends on the position alone, so reports piled on one centroid ask once.
    """
    sites = with_metres(fires.select("fire_id", "last_detected", "lat", "lon"), "lat", "lon")
    spots = places.select("latitude", "longitude").distinct()
    probes = materialise(with_metres(spots, "latitude", "longitude")).withColumn("_pid", F.concat_ws("|", "latitude", "longitude"))
    found = nearest(probes, sites, "_pid", ["fire_id", "last_detected"], C.MATCH_MAX_M)
    told = probes.select("_pid", "latitude", "longitude").join(found, "_pid").select(
        "latitude", "longitude", F.col("fire_id").alias("_fire"), F.col("last_detected").alias("_seen"), F.col("_dist").alias("_gap")
    )
    return stored(told, "nearest")


def nearest_fires(official: DataFrame, fires: DataFrame) -> DataFrame:
    """Each report with the one nearest fire up to 15 km; distance only, no other test."""
    near = _nearest_at(official, fires)
    return official.join(near, ["latitude", "longitude"], "left").select(*official.columns, *near.columns[2:])


def eligible() -> Column:
    """Nearest first, test after: a failing nearest fire is not replaced by the next."""
    hours = F.abs(times.hours_between(F.col("reported_at"), F.col("_seen")))
    return F.coalesce(
        (F.col("_gap") <= domain.match_tolerance_m(F.col("precision_m")))
        & (hours <= C.MATCH_WINDOW_HOURS),
        F.lit(False),
    )


def _winners(able: DataFrame, columns: list[str]) -> DataFrame:
    """The one report that every fire takes from a source, whole and with the number of its copies."""
    best = able.groupBy(F.col("_fire").alias("_f"), F.col("source_id").alias("_s")).agg(
        F.min(F.struct(F.round("_gap", 3).alias("k"), "external_id")).alias("w")
    )
    first = (
        (F.col("_fire") == F.col("_f")) & F.col("source_id").eqNullSafe(F.col("_s"))
        & (F.round("_gap", 3) == F.col("w.k")) & F.col("external_id").eqNullSafe(F.col("w.external_id"))
    )
    # Only the reports that tie for a fire are folded and get a key.
    alike = able.join(best, first).groupBy(*columns, "_fire", "_gap").agg(F.count("*").alias("_copies"))
    whole = F.struct(*columns, "_gap", "_copies")
    picked = alike.groupBy("_fire", F.col("source_id").alias("_s")).agg(F.min_by(whole, _row_key(alike.drop("_fire", "_gap"))).alias("w"))
    return picked.select("w.*", "_fire")


def match_reports(official: DataFrame, fires: DataFrame) -> DataFrame:
    """Reports with ``fire_id`` and ``match_distance_m``; null when nothing matched.

    A fire takes one report per source, the closest; the others stay unmatched, also
    when they repeat the winner word for word. Reports are stored with the nearest fire of
    their place, where they stand: what is shuffled is a minimum per (fire, source), combined
    map-side, and the reports that tie for it, copies folded. All that equal no winner pass by.
    """
    columns = official.columns
    at = _nearest_at(official, fires)
    near = stored(official.join(at, ["latitude", "longitude"], "left").select(*columns, *at.columns[2:]), "near")
    able = near.where(eligible())
    winners = stored(_winners(able, columns), "winners")
    taken = winners.select(*[F.col(c).alias(f"_w_{c}") for c in columns])
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in columns])
    lost = able.join(taken, same, "left_anti").unionByName(near.where(~eligible())).select(*columns)
    first = F.col("_copy") == 1
    told = winners.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(
        *columns,
        F.when(first, F.col("_fire")).alias("fire_id"),
        F.when(first, F.bround("_gap", 0)).alias("match_distance_m"),
    )
    return told.unionByName(lost, allowMissingColumns=True)


def _first_known(column: str) -> Column:
    """Value of the closest report that has one."""
    filled = text.blank_to_null(F.col(column))
    order = F.struct("match_distance_m", "source_id", "external_id", filled.alias("v"))
    return F.min(F.when(filled.isNotNull(), order))["v"]


def worst_status(status: Column) -> Column:
    rank = F.coalesce(lookup(C.STATUS_RANK, status), F.lit(0))
    return F.max(F.struct(rank.alias("rank"), status.alias("status")))["status"]


def joined_texts(column: str) -> Column:
    """Distinct non-blank texts, closest report first. At most one report per source."""
    filled = text.blank_to_null(F.col(column))
    rows = F.array_sort(
        F.collect_list(
            F.when(
                filled.isNotNull(),
                F.struct("match_distance_m", "source_id", "external_id", filled.alias("v")),
            )
        )
    )
    return F.array_join(F.array_distinct(F.transform(rows, lambda r: r["v"])), " · ")


def report_rollup(reports: DataFrame) -> DataFrame:
    """One row per matched fire with what its reports say."""
    return (
        reports.where(F.col("fire_id").isNotNull())
        .groupBy("fire_id")
        .agg(
            F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("confirmed_by"),
            _first_known("municipio").alias("official_name"),
            worst_status(F.col("status")).alias("official_status"),
            F.max("level").alias("official_level"),
            _first_known("provincia").alias("official_provincia"),
            joined_texts("resources").alias("official_resources"),
            _first_known("detalle").alias("official_detalle"),
            F.min("match_distance_m").alias("official_separacion_m"),
        )
    )


OFFICIAL_COLUMNS = (
    "confirmed_by", "official_name", "official_status", "official_level", "official_provincia",
    "official_resources", "official_detalle", "official_separacion_m",
)


def confirm_fires(fires: DataFrame, reports: DataFrame) -> DataFrame:
    """Fires with the official columns; non-null report values overwrite older ones."""
    rollup = report_rollup(reports)
    renamed = rollup.withColumnsRenamed({c: f"_new_{c}" for c in OFFICIAL_COLUMNS})
    joined = fires.join(renamed, "fire_id", "left")
    updated = {}
    for c in OFFICIAL_COLUMNS:
        old = F.col(c) if c in fires.columns else (F.lit("") if c == "confirmed_by" else F.lit(None))
        updated[c] = F.coalesce(F.col(f"_new_{c}"), old)
    out = joined.withColumns(updated).drop(*[f"_new_{c}" for c in OFFICIAL_COLUMNS])
    return out.withColumn("confirmed_by", F.coalesce("confirmed_by", F.lit("")))


def match(official: DataFrame, fires: DataFrame) -> tuple[DataFrame, DataFrame]:
    reports = match_reports(official, fires)
    return reports, confirm_fires(fires, reports)


def _external_or_place() -> Column:
    """A report without an id of its own is named by where and when it is."""
    place = F.concat_ws("|", domain.fixed3(F.col("latitude")), domain.fixed3(F.col("longitude")), times.iso_z(F.col("reported_at")))
    return F.coalesce("external_id", F.substring(F.sha1(F.encode(place, "UTF-8")), 1, 10))


def orphans(reports: DataFrame) -> DataFrame:
    """Reports that matched no fire, shaped as incidents of their own."""
    return reports.where(F.col("fire_id").isNull()).select(
        domain.orphan_id(F.col("source_id"), _external_or_place()).alias("id"),
        F.lit("oficial").alias("origin"),
        F.lit(False).alias("satellite_confirmed"),
        F.lit(True).alias("official_confirmed"),
        F.col("source_id").alias("confirmed_by"),
        "status",
        F.lit("oficial").alias("status_origen"),
        "municipio",
        "provincia",
        F.col("level").alias("igr_level"),
        F.col("resources").alias("resources_text"),
        F.col("detalle").alias("detalle_oficial"),
        F.lit(0).alias("n_hotspots"),
        F.lit(0.0).alias("frp_total_mw"),
        F.col("precision_m").alias("position_precision_m"),
        F.col("reported_at").alias("first_detected"),
        F.col("reported_at").alias("last_detected"),
        F.col("reported_at").alias("started_at"),
        F.lit(None).cast("double").alias("official_separacion_m"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
    )


def fire_incidents(fires: DataFrame) -> DataFrame:
    """Fires shaped as incidents. Only a report may state a status."""
    confirmed = F.col("confirmed_by") != ""
    declared = confirmed & F.col("official_status").isNotNull()
    admin = [c for c in ("municipio", "provincia") if c in fires.columns]
    base = fires.withColumns({c: F.lit(None).cast("string") for c in {"municipio", "provincia"} - set(admin)})
    return base.select(
        F.col("fire_id").alias("id"),
        F.when(confirmed, "ambos").otherwise("satelite").alias("origin"),
        F.lit(True).alias("satellite_confirmed"),
        confirmed.alias("official_confirmed"),
        "confirmed_by",
        F.when(declared, F.col("official_status"))
        .when(F.col("status") == "inactivo", C.NO_RECENT_DETECTIONS)
        .alias("status"),
        F.when(declared, "oficial").otherwise("satelite").alias("status_origen"),
        "municipio",
        F.coalesce("official_provincia", "provincia").alias("provincia"),
        F.col("official_level").alias("igr_level"),
        F.col("official_resources").alias("resources_text"),
        F.col("official_detalle").alias("detalle_oficial"),
        "n_hotspots", "sensors", "frp_total_mw", "intensity", "area_est_ha",
        domain.sensor_precision_m(F.col("sensors")).alias("position_precision_m"),
        "first_detected", "last_detected", "official_separacion_m", "lat", "lon",
    )


def build_incidents(
    reports: DataFrame, fires: DataFrame, unknown_to_null: bool = True
) -> DataFrame:
    """One row per real fire: satellite fires plus the reports no satellite saw.

    Extinguished incidents go, and so do satellite-only fires with no recent sighting.
    ``unknown_to_null`` turns the catch-all status into null, which validation accepts.
    """
    merged = fire_incidents(fires).unionByName(orphans(reports), allowMissingColumns=True)
    if unknown_to_null:
        merged = merged.withColumn("status", F.nullif(F.col("status"), F.lit("desconocido")))
    kept = merged.where(
        ~F.col("status").eqNullSafe("extinguido") & ~F.col("status").eqNullSafe(C.NO_RECENT_DETECTIONS)
    )
    return conform(kept, schema("incidents"))


def separation_by_source(reports: DataFrame) -> DataFrame:
    """How far matched reports stood from their fire, per source."""
    gap = F.col("match_distance_m")
    return reports.groupBy("source_id").agg(
        F.count(gap).alias("emparejados"),
        F.percentile(gap, F.lit(0.5)).alias("mediana_m"),
        F.min(gap).alias("min_m"),
        F.max(gap).alias("max_m"),
        F.count("*").alias("partes"),
    )
