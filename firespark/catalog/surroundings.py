"""Checks of the context joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.catalog import ORACLES, register, stages
from firespark.catalog import sql as S
from firespark.catalog.cleaning import INSIDE
from firespark.catalog.fusion import INCIDENTS, ZF
from firespark.functions import domain
from firespark.operators import context, polygons
from firespark.plans import layers as L
from firespark.plans import projections as P

PLACES = f"{INCIDENTS}, place AS (SELECT DISTINCT lat, lon FROM incidents)"
KM = "sqrt(pow((lat - latitude) * 1.1132e2, 2) + pow((lon - longitude) * 1.1132e2 * cos(radians(lat)), 2))"
COMPASS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO']"


def _wind_sql(parity: bool) -> str:
    def mean(col: str, dp: int) -> str:
        weight = "sum(w)" if parity else f"sum(w) FILTER ({col} IS NOT NULL)"
        return f"round_even(sum(coalesce({col}, 0) * w) / {weight}, {dp})"

    return S.query(f"""{PLACES}, {L.SQL_WIND},
      pair AS (SELECT lat, lon, wind.*, {KM} AS km, 1e0 / pow(greatest({KM}, 5e-1), 2e0) AS w FROM place CROSS JOIN wind),
      idw AS (SELECT lat, lon, {mean('speed_kmh', 1)} AS viento_kmh, {mean('gusts_kmh', 1)} AS viento_rachas_kmh,
        fmod(degrees(atan2(sum(sin(radians(direction_to_deg)) * w) / sum(w), sum(cos(radians(direction_to_deg)) * w) / sum(w))) + 3.6e2, 3.6e2) AS too,
        {mean('temp_c', 1)} AS temp_c, {mean('humedad_pct', 0)} AS humedad_pct
        FROM pair GROUP BY lat, lon HAVING min(km) <= 120)""", f"""
      SELECT id, viento_kmh, viento_rachas_kmh, round_even(too, 1) AS viento_hacia_deg,
        {COMPASS}[CAST(floor(fmod(too + 1.8e2, 3.6e2) / 2.25e1 + 5e-1) AS INT) % 16 + 1] AS viento_cardinal_desde, temp_c, humedad_pct
      FROM incidents LEFT JOIN idw USING (lat, lon)""")


WIND_OUT = ["id", *context.WIND_COLUMNS]


@register("wind_idw", _wind_sql(True))
def wind_idw(spark, sf):
    return context.add_wind(stages.incidents(spark, sf), L.wind(spark, sf), parity=True).select(*WIND_OUT)


@register("wind_idw_present_values", _wind_sql(False))
def wind_idw_present_values(spark, sf):
    return context.add_wind(stages.incidents(spark, sf), L.wind(spark, sf)).select(*WIND_OUT)


@register("wind_field_sampling", S.query(f"""{P.SQL_SETTLEMENTS}, {L.SQL_WIND},
  pair AS (SELECT s.codigo, w.speed_kmh, sin(radians(direction_to_deg)) * speed_kmh AS u, cos(radians(direction_to_deg)) * speed_kmh AS v,
     pow(s.longitude - w.longitude, 2) + pow(s.latitude - w.latitude, 2) AS d2 FROM settlements s CROSS JOIN wind w)""", """
  SELECT CAST(codigo AS VARCHAR) AS name, round(sum(u / d2) / sum(1e0 / d2), 3) AS u, round(sum(v / d2) / sum(1e0 / d2), 3) AS v,
    round(sum(speed_kmh / d2) / sum(1e0 / d2), 3) AS speed_kmh FROM pair WHERE codigo NOT IN (SELECT codigo FROM pair WHERE d2 < 1e-8)
  GROUP BY codigo UNION ALL
  SELECT CAST(codigo AS VARCHAR), round(arg_min(u, (d2, u)), 3), round(arg_min(v, (d2, u)), 3), round(arg_min(speed_kmh, (d2, u)), 3) FROM pair WHERE d2 < 1e-8 GROUP BY codigo"""))
def wind_field_sampling(spark, sf):
    targets = P.settlements(spark, sf).select(F.col("codigo").cast("string").alias("name"), "latitude", "longitude")
    return context.sample_wind_field(targets, L.wind(spark, sf)).select(
        "name", F.round("u", 3).alias("u"), F.round("v", 3).alias("v"), F.round("speed_kmh", 3).alias("speed_kmh")
    )


AT = INSIDE.replace("p.longitude", "p.lon").replace("p.latitude", "p.lat")


@register("warnings_worst_wins", S.query(f"{PLACES}, {L.SQL_WARNINGS}", f"""
  SELECT i.id, w.nivel AS aviso_nivel, w.level AS aviso_nivel_orden, w.name AS aviso_titular FROM incidents i LEFT JOIN (
    SELECT p.lat, p.lon, a.nivel, a.level, a.name FROM place p JOIN warnings a ON {AT}
    QUALIFY row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY a.level DESC, a.id) = 1) w USING (lat, lon)"""))
def warnings_worst_wins(spark, sf):
    out = context.add_warnings(stages.incidents(spark, sf), L.warnings(spark, sf))
    return out.select("id", "aviso_nivel", "aviso_nivel_orden", "aviso_titular")


CLOSE = f"""{PLACES}, {S.utm('place_m', 'place', ZF, 'lat', 'lon')}, {P.SQL_CLOSURES},
  {S.utm('clo_m', 'closures', "(CASE WHEN longitude < -12 THEN 28 ELSE 30 END)")},
  hit AS (SELECT p.lat, p.lon, c.* EXCLUDE (x, y) FROM place_m p JOIN clo_m c ON abs(p.x - c.x) <= 1.5e4 AND abs(p.y - c.y) <= 1.5e4
    AND (p.lon < -12) = (c.longitude < -12) AND sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) <= 1.5e4)"""


@register("closures_radius_count", S.query(f"""{CLOSE}, n AS (SELECT lat, lon, count(*) AS n, count(*) FILTER (por_incendio) AS f FROM hit GROUP BY lat, lon)""", """
  SELECT id, coalesce(n, 0) AS cortes_cerca, coalesce(f, 0) AS cortes_cerca_por_incendio FROM incidents LEFT JOIN n USING (lat, lon)"""))
def closures_radius_count(spark, sf):
    out = context.add_closures(stages.incidents(spark, sf), P.closures(spark, sf))
    return out.select("id", "cortes_cerca", "cortes_cerca_por_incendio")


@register("closures_road_names", S.query(f"""{CLOSE},
  lab AS (SELECT lat, lon, trim(carretera) || CASE WHEN pk IS NULL THEN '' ELSE ' pk ' || pk END AS label, min((NOT por_incendio, carretera)) AS o
    FROM hit WHERE carretera IS NOT NULL GROUP BY 1, 2, 3),
  num AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY o, label) AS rn, count(*) OVER (PARTITION BY lat, lon) AS k FROM lab),
  txt AS (SELECT lat, lon, string_agg(label, ' · ' ORDER BY rn) FILTER (rn <= 3) || CASE WHEN max(k) > 3 THEN ' · y ' || CAST(max(k) - 3 AS VARCHAR) || ' más' ELSE '' END AS v FROM num GROUP BY lat, lon)""",
  "SELECT id, v AS cortes_vias FROM incidents LEFT JOIN txt USING (lat, lon)"))
def closures_road_names(spark, sf):
    return context.add_closures(stages.incidents(spark, sf), P.closures(spark, sf)).select("id", "cortes_vias")


@register("growth_recent_hotspots", S.query(f"""{INCIDENTS}, rec AS (SELECT fire_id AS id, count(*) AS n FROM burned
   WHERE acq_dt >= {P.SQL_NOW} - INTERVAL 6 HOURS GROUP BY 1)""", """
  SELECT id, coalesce(n, 0) AS focos_recientes, round_even(coalesce(n, 0) * 1.406e1 / 6e0, 1) AS crecimiento_ha_h
  FROM incidents LEFT JOIN rec USING (id)"""))
def growth_recent_hotspots(spark, sf):
    out = context.add_growth(stages.incidents(spark, sf), stages.burned(spark, sf), P.now())
    return out.select("id", "focos_recientes", "crecimiento_ha_h")


@register("nearest_settlement", S.query(f"""{PLACES}, {S.utm('place_m', 'place', ZF, 'lat', 'lon')}, {P.SQL_SETTLEMENTS},
  {S.utm('set_m', '(SELECT * FROM settlements WHERE habitantes > 0)', "(CASE WHEN longitude < -12 THEN 28 ELSE 30 END)")},
  best AS (SELECT p.lat, p.lon, s.nombre, s.habitantes, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) AS d
    FROM place_m p JOIN set_m s ON abs(p.x - s.x) <= 5.1e4 AND abs(p.y - s.y) <= 5.1e4 AND (p.lon < -12) = (s.longitude < -12)
    QUALIFY row_number() OVER (PARTITION BY p.lat, p.lon ORDER BY round(d, 3), s.nombre, s.habitantes) = 1)""", """
  SELECT id, nombre AS nucleo_cercano, round_even(d / 1e3, 1) AS nucleo_cercano_km, habitantes AS nucleo_cercano_habitantes
  FROM incidents LEFT JOIN (SELECT * FROM best WHERE round_even(d / 1e3, 1) <= 50) b USING (lat, lon)"""))
def nearest_settlement(spark, sf):
    out = context.add_settlements(stages.incidents(spark, sf), P.settlements(spark, sf))
    return out.select("id", *context.SETTLEMENT_COLUMNS)


def _case(table: dict, index: int, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v[index]}'" for k, v in table.items()) + " END"


@register("land_cover", S.query(f"""{PLACES}, {P.SQL_AREAS},
  covered AS (SELECT p.lat, p.lon, min(a.code) AS code FROM place p JOIN areas a ON {AT} GROUP BY 1, 2)""", f"""
  SELECT id, code AS suelo_codigo,
    coalesce({_case(domain.LAND_COVER, 0, 'trim(code)')}, {_case(domain.LAND_COVER_LEVEL_1, 0, 'substr(trim(code), 1, 1)')}) AS suelo_clase,
    coalesce({_case(domain.LAND_COVER, 1, 'trim(code)')}, {_case(domain.LAND_COVER_LEVEL_1, 1, 'substr(trim(code), 1, 1)')}) AS suelo_tipo
  FROM incidents LEFT JOIN covered USING (lat, lon)"""))
def land_cover(spark, sf):
    out = context.add_land_cover(stages.incidents(spark, sf), P.areas(spark, sf))
    return out.select("id", "suelo_codigo", "suelo_clase", "suelo_tipo")


@register("admin_point_in_polygon", S.query(f"{S.FIRES}, {P.SQL_AREAS}", f"""
  SELECT f.fire_id, b.name AS municipio, b.provincia FROM fires f LEFT JOIN (
    SELECT p.fire_id, a.name, a.provincia FROM fires p JOIN areas a ON {AT}
    QUALIFY row_number() OVER (PARTITION BY p.fire_id ORDER BY a.area_id) = 1) b USING (fire_id)"""))
def admin_point_in_polygon(spark, sf):
    layer = P.areas(spark, sf).select("area_id", F.col("name").alias("municipio"), "provincia", "rings")
    out = polygons.locate(
        stages.fires(spark, sf), layer, [F.col("area_id")], ["municipio", "provincia"], "lat", "lon"
    )
    return out.select("fire_id", "municipio", "provincia")


INTERIOR = """interior AS (SELECT area_id, name, provincia, clon AS lon,
    CASE WHEN clat <= ((clat - hh) + (clat + hh)) / 2e0 THEN (clat + (clat + hh)) / 2e0 ELSE ((clat - hh) + clat) / 2e0 END AS lat FROM areas)"""


@register("interior_points", S.query(f"{P.SQL_AREAS}, {INTERIOR}", """
  SELECT area_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM interior"""))
def interior_points(spark, sf):
    return polygons.interior_points(P.areas(spark, sf), ["area_id"]).select(
        "area_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon")
    )


@register("interior_attribute_join", S.query(f"{P.SQL_AREAS}, {INTERIOR}", f"""
  SELECT p.area_id, min(a.area_id) AS primera FROM interior p JOIN areas a ON {AT} GROUP BY 1"""))
def interior_attribute_join(spark, sf):
    areas = P.areas(spark, sf)
    points = polygons.interior_points(areas, ["area_id"])
    layer = areas.select(F.col("area_id").alias("primera"), "rings")
    return polygons.locate(points, layer, [F.col("primera")], ["primera"], "lat", "lon").select("area_id", "primera")


@register("control_point_validation", S.query(f"{P.SQL_AREAS}, {P.SQL_SETTLEMENTS}", f"""
  SELECT count(*) AS puntos, count(*) FILTER (coalesce(hit, '') NOT LIKE '%%#00000000%%') AS fallos FROM (
    SELECT s.codigo, (SELECT min(a.name) FROM areas a WHERE {INSIDE.replace('p.', 's.')}) AS hit FROM settlements s)""".replace("%%", "%")))
def control_point_validation(spark, sf):
    points = P.settlements(spark, sf).withColumn("esperado", F.lit("#00000000"))
    layer = P.areas(spark, sf).select("name", "rings")
    return polygons.control_points(points, layer, "name", "esperado")


COMPOSED = (
    "wind_idw_present_values", "warnings_worst_wins", "closures_radius_count", "closures_road_names", "growth_recent_hotspots", "nearest_settlement",
    "land_cover",
)
CONTEXT_COLUMNS = (
    "id", *context.WIND_COLUMNS, "aviso_nivel", "aviso_nivel_orden", "aviso_titular", "cortes_cerca", "cortes_cerca_por_incendio",
    "cortes_vias", "focos_recientes", "crecimiento_ha_h", *context.SETTLEMENT_COLUMNS, "suelo_codigo", "suelo_clase", "suelo_tipo",
)


@register(
    "context_composed",
    f"SELECT {', '.join(CONTEXT_COLUMNS)} FROM ({ORACLES[COMPOSED[0]]}) c0 "
    + " ".join(f"JOIN ({ORACLES[name]}) c{i} USING (id)" for i, name in enumerate(COMPOSED[1:], 1)),
)
def context_composed(spark, sf):
    """All the context joins in one plan, against the join of their single checks."""
    out = context.enrich(
        stages.incidents(spark, sf), P.now(), L.wind(spark, sf), L.warnings(spark, sf),
        P.closures(spark, sf), stages.burned(spark, sf), P.settlements(spark, sf),
    )
    return context.add_land_cover(out, P.areas(spark, sf)).select(*CONTEXT_COLUMNS)
