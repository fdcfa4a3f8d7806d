"""Checks of filters, rankings, questions, exposure and place search."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.catalog.fusion import INCIDENTS
from firespark.functions import geo
from firespark.operators import explore, summaries
from firespark.plans import layers as L
from firespark.plans import projections as P

NOW = P.SQL_NOW


@register("incident_filter", S.query(INCIDENTS, f"""
  SELECT 'todos' AS origen, id FROM incidents WHERE last_detected >= {NOW} - INTERVAL 3 DAYS
  UNION ALL SELECT 'oficial', id FROM incidents WHERE last_detected >= {NOW} - INTERVAL 2 DAYS AND official_confirmed
  UNION ALL SELECT 'satelite', id FROM incidents WHERE last_detected >= {NOW} - INTERVAL 1 DAYS AND satellite_confirmed"""))
def incident_filter(spark, sf):
    inc = stages.incidents(spark, sf)
    parts = [
        explore.filter_incidents(inc, P.now(), days, origin).select(F.lit(origin).alias("origen"), "id")
        for days, origin in ((3, "todos"), (2, "oficial"), (1, "satelite"))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("hotspot_filter", S.query(S.HOT, f"""
  SELECT event_id FROM hot WHERE acq_dt >= {NOW} - INTERVAL 3 DAYS AND coalesce(confidence_pct, 0) >= 50
    AND coalesce(instrument, 'VIIRS') IN ('VIIRS', 'SEVIRI')"""))
def hotspot_filter(spark, sf):
    return explore.filter_hotspots(
        P.hotspots(spark, sf), P.now(), 3, "media", ("VIIRS", "SEVIRI")
    ).select("event_id")


@register("hotspot_filter_no_sensor", S.query(S.HOT, f"""
  SELECT 'ninguno' AS sensores, event_id FROM hot WHERE false
  UNION ALL SELECT 'MODIS', event_id FROM hot WHERE acq_dt >= {NOW} - INTERVAL 3 DAYS AND coalesce(instrument, 'VIIRS') = 'MODIS'"""))
def hotspot_filter_no_sensor(spark, sf):
    """No sensor chosen shows nothing; one chosen shows its own."""
    hot = P.hotspots(spark, sf)
    parts = [
        explore.filter_hotspots(hot, P.now(), 3, "todas", sensors).select(F.lit(label).alias("sensores"), "event_id")
        for label, sensors in (("ninguno", ()), ("MODIS", ("MODIS",)))
    ]
    return parts[0].unionByName(parts[1])


@register("day_slice", S.query(S.HOT, f"""
  SELECT event_id FROM hot WHERE acq_dt >= {NOW} - INTERVAL 3 DAYS AND confidence_pct >= 80
    AND CAST(acq_dt AS DATE) = DATE '2024-01-29'"""))
def day_slice(spark, sf):
    return explore.filter_hotspots(
        P.hotspots(spark, sf), P.now(), 3, "alta", ("VIIRS", "MODIS", "SEVIRI"), "2024-01-29"
    ).select("event_id")


# The context columns of the questions, from plain fields, so that all answers occur.
ASKED = """asked AS (SELECT *, CASE ascii(right(id, 1)) % 4 WHEN 0 THEN 'forestal' WHEN 1 THEN 'agrícola' WHEN 2 THEN 'urbano' END AS suelo_tipo,
  CASE WHEN ascii(right(id, 1)) % 5 = 0 THEN NULL ELSE ascii(substr(id, length(id) - 1, 1)) % 5 + 5e-1 END AS nucleo_cercano_km,
  CASE WHEN ascii(right(id, 1)) % 7 = 0 THEN NULL ELSE ascii(substr(id, length(id) - 1, 1)) % 40 + 1e0 END AS viento_kmh,
  CASE WHEN ascii(right(id, 1)) % 3 = 0 THEN NULL ELSE 'amarillo' END AS aviso_nivel FROM incidents)"""


def _asked(spark, sf):
    last, before = "ascii(right(id, 1))", "ascii(substr(id, length(id) - 1, 1))"
    return stages.incidents(spark, sf).withColumns(
        {
            "suelo_tipo": F.expr(f"CASE {last} % 4 WHEN 0 THEN 'forestal' WHEN 1 THEN 'agrícola' WHEN 2 THEN 'urbano' END"),
            "nucleo_cercano_km": F.expr(f"CASE WHEN {last} % 5 = 0 THEN NULL ELSE {before} % 5 + 5e-1 END"),
            "viento_kmh": F.expr(f"CASE WHEN {last} % 7 = 0 THEN NULL ELSE {before} % 40 + 1e0 END"),
            "aviso_nivel": F.expr(f"CASE WHEN {last} % 3 = 0 THEN NULL ELSE 'amarillo' END"),
        }
    )


QUESTION_SQL = {
    "monte-cerca-viento": ("suelo_tipo IS NULL OR nucleo_cercano_km IS NULL OR viento_kmh IS NULL",
                           "suelo_tipo = 'forestal' AND nucleo_cercano_km <= 2 AND viento_kmh >= 20"),
    "monte-cerca": ("suelo_tipo IS NULL OR nucleo_cercano_km IS NULL", "suelo_tipo = 'forestal' AND nucleo_cercano_km <= 2"),
    "bajo-aviso": ("aviso_nivel IS NULL", "aviso_nivel <> ''"),
    "confirmado": ("false", "official_confirmed"),
    "probable-agricola": ("suelo_tipo IS NULL", "suelo_tipo = 'agrícola' AND NOT official_confirmed"),
}


@register("cross_questions", S.query(f"{INCIDENTS}, {ASKED}", " UNION ALL ".join(
    f"SELECT '{q}' AS pregunta, count(*) FILTER (NOT ({u}) AND {p}) AS cumplen, count(*) FILTER ({u}) AS sin_dato FROM asked"
    for q, (u, p) in QUESTION_SQL.items())))
def cross_questions(spark, sf):
    return explore.ask_all(_asked(spark, sf))


@register("cross_question_semi_join", S.query(f"{INCIDENTS}, {ASKED}", f"""
  SELECT id, origin FROM incidents WHERE id IN (SELECT id FROM asked WHERE NOT ({QUESTION_SQL['monte-cerca'][0]}) AND {QUESTION_SQL['monte-cerca'][1]})"""))
def cross_question_semi_join(spark, sf):
    ids = explore.ask(_asked(spark, sf), explore.QUESTIONS[1]).select("id")
    return explore.keep_ids(stages.incidents(spark, sf), ids).select("id", "origin")


WEB = f"""{INCIDENTS}, web AS (SELECT *, round_even({S.hours(NOW, 'last_detected')}, 1) AS ultima_observacion_h,
   round_even(sqrt(area_est_ha * 1e4 / pi()) / 1e3, 1) AS radio_est_km FROM incidents)"""


@register("incidents_for_web", S.query(WEB, f"""
  SELECT id, radio_est_km, ultima_observacion_h, {S.iso('last_detected')} AS last_detected FROM web"""))
def incidents_for_web(spark, sf):
    return explore.web_incidents(stages.incidents(spark, sf), P.now()).select(
        "id", "radio_est_km", "ultima_observacion_h", "last_detected"
    )


@register("severity_ranking", S.query(WEB, """
  SELECT id, status, ultima_observacion_h, round(frp_total_mw, 2) AS frp_total_mw FROM web ORDER BY
    CASE WHEN coalesce(status, '') <> '' THEN 0 ELSE 1 END,
    CASE WHEN coalesce(status, '') <> '' THEN CASE status WHEN 'activo' THEN 0 WHEN 'estabilizado' THEN 1 WHEN 'controlado' THEN 2 WHEN 'extinguido' THEN 3 ELSE 9 END
         ELSE coalesce(ultima_observacion_h, 1e9) END, coalesce(frp_total_mw, 0) DESC, id LIMIT 100"""))
def severity_ranking(spark, sf):
    web = explore.web_incidents(stages.incidents(spark, sf), P.now())
    return explore.rank_incidents(web).select(
        "id", "status", "ultima_observacion_h", F.round("frp_total_mw", 2).alias("frp_total_mw")
    )


def _windy(spark, sf):
    return stages.incidents(spark, sf).withColumn(
        "viento_hacia_deg",
        F.expr("CASE WHEN ascii(right(id, 1)) % 5 = 0 THEN NULL ELSE (ascii(right(id, 1)) * 37) % 360 * 1e0 END"),
    )


def _assets(spark, sf):
    return P.settlements(spark, sf).select(
        F.col("codigo").alias("asset_id"), "nombre", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )


EXPOSED = f"""{INCIDENTS}, {P.SQL_SETTLEMENTS},
  spot AS (SELECT lat AS ilat, lon AS ilon, min((id, CASE WHEN ascii(right(id, 1)) % 5 = 0 THEN NULL ELSE (ascii(right(id, 1)) * 37) % 360 * 1e0 END)) AS s
     FROM incidents GROUP BY 1, 2),
  hav AS (SELECT a.codigo, a.nombre, a.latitude, a.longitude, s.ilat, s.ilon, s.s[1] AS incendio, s.s[2] AS viento,
     {S.haversine('a.latitude', 'a.longitude', 's.ilat', 's.ilon')} AS km FROM settlements a CROSS JOIN spot s),
  closest AS (SELECT * FROM hav QUALIFY row_number() OVER (PARTITION BY codigo ORDER BY round(km, 3), incendio) = 1),
  turned AS (SELECT *, abs(viento - {S.bearing('ilat', 'ilon', 'latitude', 'longitude')}) AS dd FROM closest),
  exposed AS (SELECT *, CASE WHEN dd > 180 THEN 360 - dd ELSE dd END <= 45 AS sota FROM turned)"""


@register("asset_exposure", S.query(EXPOSED, """
  SELECT codigo AS asset_id, incendio, round(km, 3) AS distancia_km, sota AS a_sotavento,
    CASE WHEN km > 10 THEN 'lejos' WHEN sota IS NULL THEN 'duda' WHEN sota THEN 'alta' ELSE 'media' END AS clase FROM exposed"""))
def asset_exposure(spark, sf):
    out = explore.classify_exposure(explore.exposure(_assets(spark, sf), _windy(spark, sf)))
    return out.select("asset_id", "incendio", F.round("distancia_km", 3).alias("distancia_km"), "a_sotavento", "clase")


@register("asset_ranking_top50", S.query(EXPOSED, """
  SELECT codigo AS asset_id, round(CASE WHEN sota THEN km / 2 ELSE km END, 3) AS gravedad FROM exposed
  ORDER BY CASE WHEN sota THEN km / 2 ELSE km END NULLS LAST, nombre, codigo LIMIT 50"""))
def asset_ranking_top50(spark, sf):
    ranked = explore.rank_exposure(explore.exposure(_assets(spark, sf), _windy(spark, sf)))
    return ranked.select("asset_id", F.round(explore.exposure_rank(), 3).alias("gravedad"))


@register("search_index", S.query(P.SQL_SETTLEMENTS, """
  SELECT nombre, round_even(latitude, 4) AS lat, round_even(longitude, 4) AS lon, habitantes FROM settlements"""))
def search_index(spark, sf):
    return explore.search_index(P.settlements(spark, sf))


@register("place_search", S.query(P.SQL_SETTLEMENTS, """
  SELECT nombre, habitantes FROM settlements WHERE lower(nombre) LIKE '%0012%' ORDER BY habitantes DESC, nombre LIMIT 8"""))
def place_search(spark, sf):
    return explore.search(explore.search_index(P.settlements(spark, sf)), " 0012 ").select("nombre", "habitantes")


@register("place_search_accents", S.query("""
  names AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ .,;\n]+')) AS nombre FROM documents)""", """
  SELECT nombre FROM names WHERE strip_accents(lower(nombre)) LIKE '%en%' ORDER BY
    CASE WHEN strip_accents(lower(nombre)) LIKE 'en%' THEN 0 ELSE 1 END, nombre LIMIT 8"""))
def place_search_accents(spark, sf):
    words = P.table(spark, sf, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[^ .,;\n]+"), F.lit(0))).alias("nombre")
    ).distinct()
    index = words.withColumns({"habitantes": F.lit(1), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    return explore.search(index, "ÉN").select("nombre")


@register("tile_groups", S.query(INCIDENTS, """
  SELECT CAST(floor((lon + 1.8e2) / 3.6e2 * 5.12e2) AS BIGINT) AS tile_x,
    CAST(floor((1e0 - ln(tan(radians(lat)) + 1e0 / cos(radians(lat))) / pi()) / 2e0 * 5.12e2) AS BIGINT) AS tile_y, count(*) AS n,
    max(CASE intensity WHEN 'media' THEN 2 WHEN 'alta' THEN 3 WHEN 'extrema' THEN 4 ELSE 1 END) AS peor FROM incidents GROUP BY 1, 2"""))
def tile_groups(spark, sf):
    return summaries.tile_groups(stages.incidents(spark, sf), 9)


@register("distributions", S.query(INCIDENTS, " UNION ALL ".join(
    f"SELECT '{c}' AS campo, coalesce({c}, '(nulo)') AS valor, count(*) AS n FROM incidents GROUP BY 2"
    for c in ("origin", "status", "intensity"))))
def distributions(spark, sf):
    inc = stages.incidents(spark, sf)
    parts = [summaries.distribution(inc, c) for c in ("origin", "status", "intensity")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("viewport_filter_rank", S.query(WEB, """
  SELECT id FROM web WHERE lat BETWEEN 38 AND 42 AND lon BETWEEN -6 AND 1 AND last_detected >= TIMESTAMP '2024-01-28 00:00:00'
  ORDER BY CASE WHEN coalesce(status, '') <> '' THEN 0 ELSE 1 END,
    CASE WHEN coalesce(status, '') <> '' THEN CASE status WHEN 'activo' THEN 0 WHEN 'estabilizado' THEN 1 WHEN 'controlado' THEN 2 ELSE 9 END
         ELSE ultima_observacion_h END, coalesce(frp_total_mw, 0) DESC, id LIMIT 100"""))
def viewport_filter_rank(spark, sf):
    recent = explore.filter_incidents(stages.incidents(spark, sf), P.now(), 3)
    seen = recent.where(geo.in_box(F.col("lat"), F.col("lon"), (-6.0, 38.0, 1.0, 42.0)))
    return explore.rank_incidents(explore.web_incidents(seen, P.now())).select("id")
