"""Table contracts. Names are the published ones; types are fixed here."""

from __future__ import annotations

from pyspark.sql import types as T


HOTSPOTS_DDL = """latitude double, longitude double, acq_dt timestamp, satellite string,
    instrument string, source string, area_key string, confidence_raw string,
    confidence_pct double, brightness_k double, frp_mw double, daynight string,
    scan double, track double"""
OFFICIAL_DDL = """source_id string, external_id string, latitude double, longitude double,
    precision_m double, reported_at timestamp, status string, municipio string,
    provincia string, level int, resources string, raw_status string, detalle string"""
INCIDENTS_DDL = """id string, origin string, satellite_confirmed boolean,
    official_confirmed boolean, confirmed_by string, status string, status_origen string,
    municipio string, provincia string, igr_level int, resources_air int,
    resources_ground int, resources_people int, resources_text string,
    detalle_oficial string, n_hotspots long, sensors string, frp_total_mw double,
    intensity string, area_est_ha double, position_precision_m double,
    first_detected timestamp, last_detected timestamp, started_at timestamp,
    official_separacion_m double, lat double, lon double"""
WIND_DDL = """name string, latitude double, longitude double, speed_kmh double,
    gusts_kmh double, direction_from_deg double, direction_to_deg double,
    cardinal_from string, temp_c double, humedad_pct double, observed_at string"""
AIR_DDL = """name string, latitude double, longitude double, aqi double, nivel string,
    pm2_5 double, pm10 double, co double, observed_at string"""
CLOSURES_DDL = """id string, causa string, detalle string, cierre string,
    por_incendio boolean, carretera string, pk string, municipio string,
    provincia string, comunidad string, latitude double, longitude double,
    desde string, actualizado string, edad_dias double"""
WARNINGS_DDL = """id string, fenomeno string, fenomeno_codigo string, nivel string,
    nivel_orden int, zona string, zona_codigo string, titular string,
    descripcion string, probabilidad string, onset string, expires string, sent string,
    rings array<array<struct<x:double,y:double>>>"""
RUNS_DDL = "hotspots long, incidents long, at string"
ASSETS_DDL = "nombre string, lat double, lon double"

CONTEXT_DDL = """viento_kmh double, viento_rachas_kmh double, viento_hacia_deg double,
    viento_cardinal_desde string, temp_c double, humedad_pct double, aviso_nivel string,
    aviso_nivel_orden int, aviso_fenomeno string, aviso_titular string,
    cortes_cerca long, cortes_cerca_por_incendio long, cortes_vias string,
    focos_recientes long, crecimiento_ha_h double, nucleo_cercano string,
    nucleo_cercano_km double, nucleo_cercano_habitantes long"""
SOIL_DDL = "suelo_codigo string, suelo_clase string, suelo_tipo string"


def schema(name: str) -> T.StructType:
    """Contract by table name; needs a running session."""
    return T.StructType.fromDDL(" ".join(globals()[f"{name.upper()}_DDL"].split()))
