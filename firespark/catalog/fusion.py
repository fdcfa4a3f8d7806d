"""Checks of report matching, contested fires, roll-ups and incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.functions import times
from firespark.operators import fuse
from firespark.plans import projections as P

ZLAT = "(CASE WHEN longitude < -12 THEN 28 ELSE 30 END)"
ZF = "(CASE WHEN lon < -12 THEN 28 ELSE 30 END)"
NEAR = f"""{S.FIRES}, {P.SQL_OFFICIAL}, {S.utm('off_m', 'official', ZLAT)}, {S.utm('fire_m', 'fires', ZF, 'lat', 'lon')},
  cand AS (SELECT o.source_id, o.external_id, f.fire_id, f.last_detected, sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) AS d
    FROM off_m o JOIN fire_m f ON abs(o.x - f.x) <= 1.5e4 AND abs(o.y - f.y) <= 1.5e4 AND (o.longitude < -12) = (f.lon < -12)),
  near AS (SELECT * FROM cand WHERE d <= 1.5e4 QUALIFY row_number() OVER (PARTITION BY source_id, external_id
    ORDER BY round(d, 3), fire_id) = 1),
  ok AS (SELECT n.*, o.* EXCLUDE (source_id, external_id) FROM near n JOIN official o USING (source_id, external_id)
    WHERE d <= least(precision_m + 3e3, 1.5e4) AND abs(epoch_us(reported_at) - epoch_us(last_detected)) / 3.6e9 <= 48),
  won AS (SELECT *, round_even(d, 0) AS match_distance_m FROM ok QUALIFY row_number() OVER (PARTITION BY fire_id, source_id
    ORDER BY round(d, 3), external_id) = 1),
  reports AS (SELECT o.*, w.fire_id, w.match_distance_m FROM official o LEFT JOIN won w USING (source_id, external_id))"""


@register("nearest_fire", S.query(NEAR, "SELECT source_id, external_id, fire_id, round(d, 2) AS dist_m FROM near"))
def nearest_fire(spark, sf):
    found = fuse.nearest_fires(P.official(spark, sf), stages.fires(spark, sf))
    return found.where(F.col("_fire").isNotNull()).select(
        "source_id", "external_id", F.col("_fire").alias("fire_id"), F.round("_gap", 2).alias("dist_m")
    )


@register("report_match_duplicates", S.query(NEAR, """
  SELECT source_id, external_id, fire_id, match_distance_m FROM reports
  UNION ALL SELECT source_id, external_id, NULL, NULL FROM official"""))
def report_match_duplicates(spark, sf):
    """Every report twice: of two alike only one may win, the other is an orphan."""
    twice = P.official(spark, sf).unionByName(P.official(spark, sf))
    return fuse.match_reports(twice, stages.fires(spark, sf)).select("source_id", "external_id", "fire_id", "match_distance_m")


@register("report_match", S.query(NEAR, "SELECT source_id, external_id, fire_id, match_distance_m FROM reports"))
def report_match(spark, sf):
    reports, _ = stages.matched(spark, sf)
    return reports.select("source_id", "external_id", "fire_id", "match_distance_m")


@register("contested_losers", S.query(NEAR, """
  SELECT ok.source_id, ok.external_id FROM ok LEFT JOIN won USING (source_id, external_id) WHERE won.fire_id IS NULL"""))
def contested_losers(spark, sf):
    official, fires = P.official(spark, sf), stages.fires(spark, sf)
    able = fuse.nearest_fires(official, fires).where(fuse.eligible()).select("source_id", "external_id")
    kept = fuse.match_reports(official, fires).where(F.col("fire_id").isNotNull())
    return able.join(kept, ["source_id", "external_id"], "left_anti")


RANK = "CASE status WHEN 'activo' THEN 4 WHEN 'estabilizado' THEN 3 WHEN 'controlado' THEN 2 WHEN 'extinguido' THEN 1 ELSE 0 END"
ROLLUP = f"""{NEAR},
  texts AS (SELECT fire_id, string_agg(v, ' · ' ORDER BY o) AS official_resources FROM (
     SELECT fire_id, trim(resources) AS v, min((match_distance_m, source_id, external_id)) AS o FROM reports
     WHERE fire_id IS NOT NULL AND trim(resources) <> '' GROUP BY 1, 2) GROUP BY fire_id),
  rollup AS (SELECT fire_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS confirmed_by,
     arg_min(municipio, (match_distance_m, source_id, external_id)) AS official_name,
     arg_max(status, ({RANK}, status)) AS official_status, max(level) AS official_level,
     arg_min(provincia, (match_distance_m, source_id, external_id)) FILTER (provincia IS NOT NULL) AS official_provincia,
     arg_min(detalle, (match_distance_m, source_id, external_id)) FILTER (detalle IS NOT NULL) AS official_detalle,
     min(match_distance_m) AS official_separacion_m FROM reports WHERE fire_id IS NOT NULL GROUP BY fire_id),
  rolled AS (SELECT r.*, coalesce(t.official_resources, '') AS official_resources FROM rollup r LEFT JOIN texts t USING (fire_id))"""


@register("report_rollup", S.query(ROLLUP, """SELECT fire_id, confirmed_by, official_name, official_status, official_level,
  official_provincia, official_resources, official_detalle, official_separacion_m FROM rolled"""))
def report_rollup(spark, sf):
    reports, _ = stages.matched(spark, sf)
    return fuse.report_rollup(reports)


@register("confirmed_fires", S.query(ROLLUP, """SELECT fire_id, coalesce(confirmed_by, '') AS confirmed_by, official_status,
  official_level, n_hotspots FROM fires LEFT JOIN rolled USING (fire_id)"""))
def confirmed_fires(spark, sf):
    _, fires = stages.matched(spark, sf)
    return fires.select("fire_id", "confirmed_by", "official_status", "official_level", "n_hotspots")


INCIDENTS = f"""{ROLLUP},
  sat AS (SELECT fire_id AS id, CASE WHEN confirmed_by IS NOT NULL THEN 'ambos' ELSE 'satelite' END AS origin, true AS satellite_confirmed,
     confirmed_by IS NOT NULL AS official_confirmed, coalesce(confirmed_by, '') AS confirmed_by,
     CASE WHEN official_status IS NOT NULL THEN official_status WHEN status = 'inactivo' THEN '_old' END AS status,
     CASE WHEN official_status IS NOT NULL THEN 'oficial' ELSE 'satelite' END AS status_origen,
     CAST(NULL AS VARCHAR) AS municipio, official_provincia AS provincia, official_level AS igr_level, official_resources AS resources_text,
     official_detalle AS detalle_oficial, n_hotspots, sensors, frp_total_mw, intensity, area_est_ha,
     CASE WHEN sensors LIKE '%VIIRS%' THEN 3.75e2 ELSE 1e3 END AS position_precision_m, first_detected, last_detected,
     CAST(NULL AS TIMESTAMP) AS started_at, official_separacion_m, lat, lon FROM fires LEFT JOIN rolled USING (fire_id)),
  alone AS (SELECT 'off_' || source_id || '_' || external_id AS id, 'oficial' AS origin, false AS satellite_confirmed, true AS official_confirmed,
     source_id AS confirmed_by, status, 'oficial' AS status_origen, municipio, provincia, level AS igr_level, resources AS resources_text,
     detalle AS detalle_oficial, 0 AS n_hotspots, CAST(NULL AS VARCHAR) AS sensors, 0e0 AS frp_total_mw, CAST(NULL AS VARCHAR) AS intensity,
     CAST(NULL AS DOUBLE) AS area_est_ha, precision_m AS position_precision_m, reported_at AS first_detected, reported_at AS last_detected,
     reported_at AS started_at, CAST(NULL AS DOUBLE) AS official_separacion_m, latitude AS lat, longitude AS lon
     FROM reports WHERE fire_id IS NULL),
  incidents AS (SELECT * FROM (SELECT * FROM sat UNION ALL SELECT * FROM alone) WHERE coalesce(status, '') NOT IN ('extinguido', '_old'))"""


@register("orphan_reports", S.query(INCIDENTS, "SELECT id, status, municipio, igr_level, position_precision_m FROM alone"))
def orphan_reports(spark, sf):
    reports, _ = stages.matched(spark, sf)
    return fuse.orphans(reports).select("id", "status", "municipio", "igr_level", "position_precision_m")


@register("incidents", S.query(INCIDENTS, f"""SELECT id, origin, satellite_confirmed, official_confirmed, confirmed_by, status, status_origen,
  municipio, provincia, igr_level, resources_text, detalle_oficial, CAST(n_hotspots AS BIGINT) AS n_hotspots, sensors,
  round(frp_total_mw, 2) AS frp_total_mw, intensity, area_est_ha, position_precision_m, {S.iso('first_detected')} AS first_detected,
  {S.iso('last_detected')} AS last_detected, {S.iso('started_at')} AS started_at, official_separacion_m,
  round(lat, 6) AS lat, round(lon, 6) AS lon FROM incidents"""))
def incidents(spark, sf):
    return stages.incidents(spark, sf).drop("resources_air", "resources_ground", "resources_people").withColumns(
        {
            "frp_total_mw": F.round("frp_total_mw", 2), "lat": F.round("lat", 6), "lon": F.round("lon", 6),
            **{c: times.iso_z(F.col(c)) for c in ("first_detected", "last_detected", "started_at")},
        }
    )


@register("separation_by_source", S.query(NEAR, """SELECT source_id, count(match_distance_m) AS emparejados,
  median(match_distance_m) AS mediana_m, min(match_distance_m) AS min_m, max(match_distance_m) AS max_m, count(*) AS partes
  FROM reports GROUP BY source_id"""))
def separation_by_source(spark, sf):
    reports, _ = stages.matched(spark, sf)
    return fuse.separation_by_source(reports)
