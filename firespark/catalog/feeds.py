"""Checks of the source readers, on payloads written from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from firespark.catalog import register
from firespark.catalog import sql as S
from firespark.functions import geo, times
from firespark.operators import polygons
from firespark.plans import layers as L
from firespark.plans import prepare
from firespark.plans import projections as P
from firespark.session import shared_dir, use_utc
from firespark.sinks import history, publish
from firespark.sources import assets, feeds, hotspots, layers, official

NOW = P.SQL_NOW


def batch(key: str, size: int = 500):
    """Number of the payload a row goes to; payloads hold a bounded run of keys."""
    return F.floor(F.col(key) / size).alias("doc")


def scratch(spark, name: str) -> str:
    return f"{shared_dir(use_utc(spark))}/payloads/{name}-{uuid.uuid4().hex}"


# --- Detection files --------------------------------------------------------------


def _raw_files(spark, sf, without: str = "") -> str:
    root = scratch(spark, "hotspots")
    hot = P.hotspots(spark, sf).select(
        "source", "area_key", F.lit("ESP").alias("country_id"), "latitude", "longitude",
        "brightness_k", F.date_format("acq_dt", "yyyy-MM-dd").alias("acq_date"),
        (F.hour("acq_dt") * 100).alias("acq_time"), "satellite", "instrument",
        F.col("confidence_raw").alias("confidence"),
        F.when(F.col("event_id") % 20 != 3, F.col("frp_mw")).alias("frp"), "daynight", "scan", "track",
    )
    for family, column in (("MODIS", "brightness"), ("VIIRS", "bright_ti4")):
        (
            hot.where((F.col("instrument") == family) & (F.col("source") != without)).withColumnRenamed("brightness_k", column)
            .write.mode("append").option("header", True).partitionBy("source", "area_key").csv(root)
        )
    return root


@register("hotspot_csv_scan", S.query(S.HOT, f"""
  SELECT round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, {S.iso('acq_dt')} AS acq_dt, satellite, instrument, source, area_key,
    confidence_raw, confidence_pct, round(brightness_k, 3) AS brightness_k, CASE WHEN event_id % 20 = 3 THEN 0e0 ELSE frp_mw END AS frp_mw,
    daynight, CAST(scan AS DOUBLE) AS scan, CAST(track AS DOUBLE) AS track FROM hot"""))
def hotspot_csv_scan(spark, sf):
    root = _raw_files(spark, sf)
    return hotspots.read_all(spark, root, hotspots.declared_jobs()).withColumns(
        {
            "acq_dt": times.iso_z(F.col("acq_dt")), "brightness_k": F.round("brightness_k", 3),
            "latitude": F.round("latitude", 3), "longitude": F.round("longitude", 3),
        }
    )


@register("hotspot_csv_scan_missing", S.query(S.HOT, """
  SELECT source, area_key, count(*) AS n, 'leído' AS estado FROM hot WHERE source <> 'VIIRS_NOAA21_NRT' GROUP BY 1, 2
  UNION ALL SELECT 'VIIRS_NOAA21_NRT', area_key, 0, 'no landed files' FROM (SELECT unnest(['peninsula', 'canarias']) AS area_key)"""))
def hotspot_csv_scan_missing(spark, sf):
    """One sensor's folders are absent: the others are read, and the reason is kept."""
    root = _raw_files(spark, sf, "VIIRS_NOAA21_NRT")
    failures: dict[str, str] = {}
    read = hotspots.read_all(spark, root, hotspots.declared_jobs(), failures)
    told = spark.createDataFrame(
        [(*job.split("/"), 0, why) for job, why in failures.items()], "source string, area_key string, n long, estado string"
    )
    return read.groupBy("source", "area_key").agg(F.count("*").alias("n")).withColumn("estado", F.lit("leído")).unionByName(told)


@register("non_csv_quarantine", """SELECT event_type || '-' || CAST(user_id % 16 AS VARCHAR) AS fichero, 'Limite superado' AS body
  FROM events WHERE user_id % 16 % 3 = 0 GROUP BY 1""")
def non_csv_quarantine(spark, sf):
    root = scratch(spark, "bodies")
    events = P.table(spark, sf, "events").withColumn("b", F.col("user_id") % 16)
    body = F.when(F.col("b") % 3 == 0, "Limite superado").otherwise(F.concat_ws(",", "event_id", "value"))
    events.select("event_type", "b", body.alias("value")).write.partitionBy("event_type", "b").text(root)
    part = F.regexp_extract("file", "event_type=([^/]+)/b=([0-9]+)", 1)
    bucket = F.regexp_extract("file", "event_type=([^/]+)/b=([0-9]+)", 2)
    return hotspots.quarantine(spark, root).select(F.concat_ws("-", part, bucket).alias("fichero"), "body").distinct()


# --- Feature collections ------------------------------------------------------------

ESTADO = "CASE o_orderstatus WHEN 'O' THEN 'En curso' WHEN 'P' THEN 'Totalmente CONTROLADO' ELSE 'otro' END"
FIELD_MAP = {"external_id": "id", "status": "estado", "municipio": "muni", "resources": "medios", "level": "nivel"}


def _feature_documents(spark, sf):
    rows = P.official(spark, sf).withColumn("k", F.col("external_id").cast("long"))
    estado = F.expr("CASE raw_status WHEN 'O' THEN 'En curso' WHEN 'P' THEN 'Totalmente CONTROLADO' ELSE 'otro' END")
    flat = F.struct("longitude", "latitude")
    geometry = F.struct(
        F.when(F.col("k") % 3 == 0, F.array("longitude", "latitude")).alias("coordinates"),
        F.when(F.col("k") % 3 == 1, flat["longitude"]).alias("x"),
        F.when(F.col("k") % 3 == 1, flat["latitude"]).alias("y"),
    )
    feature = F.struct(
        geometry.alias("geometry"),
        F.struct(F.col("external_id").alias("id"), estado.alias("estado"), F.col("municipio").alias("muni")).alias("properties"),
    )
    return rows.groupBy(batch("k")).agg(F.collect_list(feature).alias("features")).select(
        F.to_json(F.struct("features")).alias("value")
    )


@register("feature_collection_source", S.query(P.SQL_OFFICIAL, """
  SELECT 'infocam' AS source_id, external_id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, 6e3 AS precision_m,
    '2024-01-31T00:00:00Z' AS reported_at, CASE raw_status WHEN 'O' THEN 'activo' WHEN 'P' THEN 'controlado' ELSE 'desconocido' END AS status,
    municipio, CASE raw_status WHEN 'O' THEN 'En curso' WHEN 'P' THEN 'Totalmente CONTROLADO' ELSE 'otro' END AS raw_status
  FROM official WHERE CAST(external_id AS BIGINT) % 3 <> 2 AND latitude BETWEEN 27 AND 44 AND longitude BETWEEN -19 AND 5"""))
def feature_collection_source(spark, sf):
    meta = official.SourceMeta("infocam", "x", "x", 6000.0)
    rows = official.finalise(official.feature_parser(FIELD_MAP)(_feature_documents(spark, sf)), meta, P.now())
    return rows.select(
        "source_id", "external_id", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"),
        "precision_m", times.iso_z(F.col("reported_at")).alias("reported_at"), "status", "municipio", "raw_status",
    )


@register("renamed_field_detector", """SELECT c AS campo FROM (SELECT unnest(['estado','id','medios','muni','nivel']) AS c)
  WHERE c NOT IN ('id', 'estado', 'muni') AND (SELECT count(*) FROM orders) > 0""")
def renamed_field_detector(spark, sf):
    return official.missing_fields(_feature_documents(spark, sf), FIELD_MAP)


# --- Emergencies --------------------------------------------------------------------

KIND = "CASE (k + {i}) % 3 WHEN 0 THEN 'Helicóptero' WHEN 1 THEN ' Autobomba ' ELSE '' END"


def _emergency_documents(spark, sf):
    rows = P.official(spark, sf).withColumn("k", F.col("external_id").cast("long"))
    zone = F.when(F.col("k") % 3 == 0, 29).when(F.col("k") % 3 == 1, 30).otherwise(31)
    x, y = geo.utm_xy(F.col("latitude"), F.col("longitude"), F.col("zone"))
    units = F.array(
        *[
            F.struct(
                (F.col("k") % (i + 2) != 0).alias("ACTUANDO"),
                F.struct(F.expr(KIND.format(i=i)).alias("NOMBRE")).alias("TIPO"),
            )
            for i in range(5)
        ]
    )
    e = rows.withColumn("zone", zone).withColumns({"x": x, "y": y}).select(
        "k",
        F.struct(
            F.lit("24").alias("emergencia_cpm"), F.when(F.col("k") % 6 != 0, F.col("k")).alias("emergencia_num1"),
            (F.col("k") % 9).alias("emergencia_num2"),
            F.struct(F.expr("CASE raw_status WHEN 'O' THEN 'ACTIVO ' WHEN 'P' THEN 'Controlado' ELSE 'raro' END").alias("NOMBRE")).alias("estado"),
            (F.col("k") % 10 == 0).alias("falsa_alarma"),
            F.date_format("reported_at", "dd/MM/yyyy HH:mm:ss").alias("fecha_inicio"),
            F.when(F.col("k") % 3 != 1, F.col("zone")).alias("huso"),
            F.col("y").alias("latitud"), F.col("x").alias("longitud"),
            F.struct(F.upper("municipio").alias("nombre")).alias("municipio"),
            F.struct(F.when(F.col("k") % 2 == 0, "LEON").otherwise("SAN JUAN DE LA RIA-ALTA").alias("nombre")).alias("provincia"),
            F.col("level").alias("nivel_infocal"), units.alias("medios"),
        ).alias("e"),
    )
    return e.groupBy(batch("k")).agg(F.collect_list("e").alias("listaEmergencias")).select(
        F.to_json(F.struct("listaEmergencias")).alias("value")
    )


ACTING = " UNION ALL ".join(
    f"SELECT external_id, {i} AS i, CASE (k + {i}) % 3 WHEN 0 THEN 'Helicóptero' WHEN 1 THEN 'Autobomba' ELSE 'Otros' END AS kind FROM e WHERE k % {i + 2} <> 0"
    for i in range(5)
)


@register("emergencies_source", S.query(f"""{P.SQL_OFFICIAL}, e AS (SELECT *, CAST(external_id AS BIGINT) AS k FROM official
    WHERE CAST(external_id AS BIGINT) % 10 <> 0 AND round(longitude, 6) BETWEEN -7.2 AND -1.5 AND round(latitude, 6) BETWEEN 40.0 AND 43.5),
  acting AS ({ACTING}), kinds AS (SELECT external_id, kind, count(*) AS n, min(i) AS i FROM acting GROUP BY 1, 2),
  res AS (SELECT external_id, string_agg(CAST(n AS VARCHAR) || ' ' || lower(kind), ' · ' ORDER BY n DESC, i) AS units FROM kinds GROUP BY 1)""", f"""
  SELECT '24-' || CASE WHEN k % 6 <> 0 THEN CAST(k AS VARCHAR) || '-' ELSE '' END || CAST(k % 9 AS VARCHAR) AS external_id,
    round(latitude, 4) AS latitude, round(longitude, 4) AS longitude, {S.iso('reported_at - INTERVAL 1 HOURS')} AS reported_at,
    CASE raw_status WHEN 'O' THEN 'activo' WHEN 'P' THEN 'controlado' ELSE 'desconocido' END AS status, municipio,
    CASE WHEN k % 2 = 0 THEN 'León' ELSE 'San Juan de la Ria-Alta' END AS provincia, level, coalesce(units, '') AS resources
  FROM e LEFT JOIN res USING (external_id)"""))
def emergencies_source(spark, sf):
    rows = official.emergencies(_emergency_documents(spark, sf))
    return rows.select(
        "external_id", F.round("latitude", 4).alias("latitude"), F.round("longitude", 4).alias("longitude"),
        times.iso_z(F.col("reported_at")).alias("reported_at"), "status", "municipio", "provincia", "level", "resources",
    )


# --- Incident list --------------------------------------------------------------------

DESCRIPTION = (
    "CASE k % 5 WHEN 0 THEN 'Incendio > Vegetación > Forestal' WHEN 1 THEN 'INCENDIO > Vegetación > Rural/Montañosa > Humo'"
    " WHEN 2 THEN 'Incendio > Vegetación > Urbana > vegetación > forestal' WHEN 3 THEN 'Accidente > tráfico' ELSE 'Incendio > Vivienda' END"
)
TOWN = "CASE k % 4 WHEN 0 THEN 'Fuera de la Comunidad Valenciana' WHEN 1 THEN '' ELSE concat(' ', municipio, ' ') END"
STREET = "CASE WHEN k % 7 = 0 THEN '  ' ELSE concat('Calle ', CAST(k % 13 AS STRING)) END"


def _incident_documents(spark, sf):
    rows = P.official(spark, sf).withColumn("k", F.col("external_id").cast("long"))
    item = F.struct(
        F.col("k").alias("id"), F.expr(TOWN).alias("municipio"), F.expr(STREET).alias("direccion"),
        F.expr(DESCRIPTION).alias("descripcionEs"),
        F.when(F.col("k") % 11 != 0, F.array(F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))))
        .otherwise(F.array().cast("array<struct<x:double,y:double>>")).alias("coordenadas"),
    )
    return rows.groupBy(batch("k")).agg(F.collect_list(item).alias("items")).select(F.to_json("items").alias("value"))


@register("incident_list_source", S.query(f"{P.SQL_OFFICIAL}, e AS (SELECT *, CAST(external_id AS BIGINT) AS k FROM official)", f"""
  SELECT CASE WHEN k = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS external_id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, 'activo' AS status, {DESCRIPTION} AS raw_status,
    CASE WHEN k % 4 <= 1 THEN NULL ELSE municipio END AS municipio, CASE WHEN k % 7 = 0 THEN NULL ELSE {STREET.replace('STRING', 'VARCHAR')} END AS detalle, k % 5 = 1 AS solo_humo
  FROM e WHERE k % 5 <= 1 AND k % 11 <> 0 AND longitude BETWEEN -1.6 AND 0.8 AND latitude BETWEEN 37.8 AND 40.9"""))
def incident_list_source(spark, sf):
    return official.incident_list(_incident_documents(spark, sf)).select(
        "external_id", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"), "status", "raw_status",
        "municipio", "detalle", "solo_humo",
    )


# --- Road closures ----------------------------------------------------------------------

CLASS = "CASE p_partkey % 4 WHEN 0 THEN 'roadClosed' WHEN 1 THEN 'laneClosures' WHEN 2 THEN 'speedLimit' ELSE NULL END"
DETAIL = "CASE p_partkey % 3 WHEN 0 THEN 'forestFire' WHEN 1 THEN 'roadworks' ELSE 'otherThing' END"


def _records(spark, sf) -> str:
    """DATEX-like documents on disk."""
    root = scratch(spark, "closures")
    rows = P.table(spark, sf, "part").selectExpr(
        "p_brand", "p_partkey", f"{CLASS} AS class", f"{DETAIL} AS detail",
        f"{P.CLOSURES['latitude']} AS lat", f"{P.CLOSURES['longitude']} AS lon",
    )

    def tag(name: str, value) -> F.Column:
        return F.coalesce(F.concat(F.lit(f"<loc:{name}>"), value, F.lit(f"</loc:{name}>")), F.lit(""))

    record = F.concat(
        F.lit('<sit:situationRecord xsi:type="sit:X" id="'), F.col("p_partkey").cast("string"), F.lit('">\n'),
        tag("situationRecordVersionTime", F.lit("2024-01-29T12:00:00+01:00")),
        tag("causeType", F.when(F.col("p_partkey") % 2 == 0, "accident").otherwise("strange")),
        F.lit("<sit:obstructionType> </sit:obstructionType>"),
        tag("roadMaintenanceType", F.col("detail")),
        tag("roadOrCarriagewayOrLaneManagementType", F.col("class")),
        F.when(F.col("p_partkey") % 10 != 0, tag("latitude", F.col("lat").cast("string"))).otherwise(F.lit("")),
        tag("longitude", F.col("lon").cast("string")),
        F.lit("<loc:roadName><com:values><com:value>x</com:value></com:values>"),
        F.lit("<com:value> "), F.col("p_brand"), F.lit(" </com:value></loc:roadName>"),
        F.when(F.col("p_partkey") % 5 != 0, tag("kilometerPoint", (F.col("p_partkey") % 50).cast("string"))).otherwise(F.lit("")),
        F.lit("</sit:situationRecord>"),
    )
    documents = rows.groupBy(batch("p_partkey")).agg(F.array_join(F.collect_list(record), "\n").alias("body")).select(
        F.concat(F.lit('<?xml version="1.0"?><d2:payload xmlns:d2="a">'), "body", F.lit("</d2:payload>")).alias("value")
    )
    documents.write.text(root)
    return root


@register("closures_source", S.query(f"p AS (SELECT *, {CLASS} AS class, {DETAIL} AS detail, {P.CLOSURES['latitude']} AS lat, {P.CLOSURES['longitude']} AS lon FROM part)", """
  SELECT CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'accidente' ELSE 'strange' END AS causa,
    CASE detail WHEN 'forestFire' THEN 'incendio forestal' WHEN 'roadworks' THEN 'obras' ELSE detail END AS detalle,
    CASE class WHEN 'roadClosed' THEN 'carretera cerrada' WHEN 'laneClosures' THEN 'carril cortado' END AS cierre,
    detail = 'forestFire' AS por_incendio, p_brand AS carretera, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 50 AS VARCHAR) END AS pk,
    round(lat, 3) AS latitude, round(lon, 3) AS longitude, 1.5e0 AS edad_dias
  FROM p WHERE (class IN ('roadClosed', 'laneClosures') OR detail = 'forestFire') AND p_partkey % 10 <> 0"""))
def closures_source(spark, sf):
    records = feeds.read_situation_records(spark, _records(spark, sf))
    return feeds.parse_closures(records, P.now()).select(
        "id", "causa", "detalle", "cierre", "por_incendio", "carretera", "pk",
        F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"), "edad_dias",
    )


# --- Warnings ---------------------------------------------------------------------------

CODE = "CASE area_id % 5 WHEN 0 THEN 'AT' WHEN 1 THEN 'VI' WHEN 2 THEN 'PR' WHEN 3 THEN 'NB' ELSE 'TO' END"


def _alert_documents(spark, sf):
    areas = P.areas(spark, sf)
    level = F.element_at(F.array(*[F.lit(v) for v in L.LEVELS]), F.col("level") + 1)
    corners = F.array_join(
        F.transform(F.col("rings")[0], lambda p: F.concat_ws(",", p["y"].cast("string"), p["x"].cast("string"))), " "
    )

    def pair(outer: str, name: str, value) -> F.Column:
        return F.concat(
            F.lit(f"<{outer}><valueName>{name}</valueName><value>"), value, F.lit(f"</value></{outer}>")
        )

    def info(language: str) -> F.Column:
        return F.concat(
            F.lit(f"<info><language>{language}</language>"),
            pair("eventCode", "AEMET-Meteoalerta fenomeno", F.concat(F.expr(CODE), F.lit(";texto"))),
            F.lit("<onset>2024-01-29T00:00:00+01:00</onset>"),
            F.when(
                F.col("area_id") % 4 == 0, F.lit("<expires>2024-01-29T00:00:00+01:00</expires>")
            ).otherwise(F.lit("<expires>2024-02-02T00:00:00+01:00</expires>")),
            F.lit("<headline>Aviso "), F.col("name"), F.lit("</headline><description>d</description>"),
            pair("parameter", "otro", F.lit("1")), pair("parameter", feeds.LEVEL_PARAMETER, level),
            F.lit("<area><areaDesc> Zona </areaDesc>"),
            F.when(F.col("area_id") % 11 != 10, F.concat(F.lit("<polygon>"), corners, F.lit("</polygon>"))).otherwise(F.lit("")),
            pair("geocode", feeds.ZONE_CODE, (F.col("area_id") % 30).cast("string")), F.lit("</area></info>"),
        )

    sound = F.concat(
        F.lit('<alert xmlns="urn:oasis:names:tc:emergency:cap:1.2"><identifier>id'), F.col("area_id").cast("string"),
        F.lit("</identifier><sent>2024-01-28T00:00:00+01:00</sent>"), info("en-GB"), info("es-ES"), F.lit("</alert>"),
    )
    broken = F.concat(F.lit("<alert><identifier>id"), F.col("area_id").cast("string"))
    return areas.select(F.when(F.col("area_id") % 10 == 9, broken).otherwise(sound).alias("value"))


ALERTS = f"""{P.SQL_AREAS}, w AS (SELECT *, {CODE} AS fcode, ['verde','amarillo','naranja','rojo'][level + 1] AS nivel FROM areas
   WHERE level >= 1 AND area_id % 10 <> 9 AND area_id % 11 <> 10 AND area_id % 5 <> 3)"""


@register("warnings_source", S.query(ALERTS, """
  SELECT 'id' || CAST(area_id AS VARCHAR) || ':' || CAST(area_id % 30 AS VARCHAR) AS id, fcode AS fenomeno_codigo, nivel, level AS nivel_orden,
    'Zona' AS zona, CAST(area_id % 30 AS VARCHAR) AS zona_codigo, 'Aviso ' || name AS titular, 5 AS vertices, round(clon - hw, 4) AS x0, round(clat, 4) AS y0 FROM w"""))
def warnings_source(spark, sf):
    rows = feeds.parse_warnings(_alert_documents(spark, sf))
    return rows.select(
        "id", "fenomeno_codigo", "nivel", "nivel_orden", "zona", "zona_codigo", "titular",
        F.size(F.col("rings")[0]).alias("vertices"), F.round(F.col("rings")[0][0]["x"], 4).alias("x0"),
        F.round(F.col("rings")[0][0]["y"], 4).alias("y0"),
    )


@register("warnings_unreadable", S.query(P.SQL_AREAS, "SELECT count(*) AS n FROM areas WHERE area_id % 10 = 9"))
def warnings_unreadable(spark, sf):
    return feeds.unreadable_alerts(_alert_documents(spark, sf)).agg(F.count("*").alias("n"))


@register("warnings_latest_in_force", S.query(ALERTS, """
  SELECT id, nivel_orden FROM (SELECT *, 'id' || CAST(area_id AS VARCHAR) || ':' || CAST(area_id % 30 AS VARCHAR) AS id, level AS nivel_orden FROM w
    QUALIFY row_number() OVER (PARTITION BY area_id % 30, fcode ORDER BY level DESC, id) = 1) WHERE area_id % 4 <> 0"""))
def warnings_latest_in_force(spark, sf):
    rows = feeds.latest_warnings(feeds.parse_warnings(_alert_documents(spark, sf)))
    return feeds.in_force(rows, P.now()).select("id", "nivel_orden")


# --- Node grids ---------------------------------------------------------------------------

GRID = """g AS (SELECT lat_i * 19 + lon_i AS pos, round(3.6e1 + lat_i * 7.5e-1, 2) AS glat, round(-9.3e0 + lon_i * 7.5e-1, 2) AS glon
    FROM (SELECT unnest(range(11)) AS lat_i), (SELECT unnest(range(19)) AS lon_i)
  UNION ALL SELECT 209 + lat_i * 7 + lon_i, round(2.76e1 + lat_i * 7.5e-1, 2), round(-1.82e1 + lon_i * 7.5e-1, 2)
    FROM (SELECT unnest(range(3)) AS lat_i), (SELECT unnest(range(7)) AS lon_i)),
  grid AS (SELECT *, printf('%.2f,%.2f', glat, glon) AS name FROM g)"""


#: Keys in one payload: fewer than the grid's 230 nodes, so pairing blocks with nodes cuts none.
NODE_RUN = 200


def _node_documents(spark, sf, current: dict[str, str]):
    """Payloads per nation and part of the grid's length: no payload has more blocks than the grid has nodes.

    A supplier's place inside its payload is its rank among the nation's keys of one run of
    ``NODE_RUN`` keys; a run is never longer than the grid.
    """
    rows = L.stations(spark, sf).join(
        P.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), "s_suppkey", "s_nationkey"), "name"
    )
    now = F.struct(F.lit("2024-01-30T23:00").alias("time"), *[F.col(c).alias(a) for c, a in current.items()])
    block = F.struct(
        "s_suppkey",
        F.when(F.col("s_suppkey") % 3 != 0, F.col("latitude")).alias("latitude"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("longitude")).alias("longitude"), now.alias("current"),
    )
    listed = rows.groupBy("s_nationkey", batch("s_suppkey", NODE_RUN)).agg(F.array_sort(F.collect_list(block)).alias("b"))
    single = F.to_json(F.col("b")[0])
    return listed.select(F.when(F.size("b") == 1, single).otherwise(F.to_json("b")).alias("value"))


NODES = f"""{L.SQL_STATIONS}, {GRID}, n AS (SELECT st.*, s.s_suppkey, row_number() OVER (PARTITION BY s.s_nationkey, s.s_suppkey // {NODE_RUN} ORDER BY s.s_suppkey) - 1 AS pos
   FROM stations st JOIN supplier s ON st.name = s.s_name),
  node AS (SELECT n.* EXCLUDE (name, latitude, longitude), grid.name, CASE WHEN s_suppkey % 3 <> 0 THEN n.latitude ELSE glat END AS latitude,
    CASE WHEN s_suppkey % 3 <> 0 THEN n.longitude ELSE glon END AS longitude FROM n JOIN grid USING (pos))"""
COMPASS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO']"


@register("wind_source", S.query(NODES, f"""
  SELECT name, round(latitude, 2) AS latitude, round(longitude, 2) AS longitude, speed_kmh, gusts_kmh, direction_from_deg,
    fmod(direction_from_deg + 1.8e2, 3.6e2) AS direction_to_deg, {COMPASS}[CAST(floor(direction_from_deg / 2.25e1 + 5e-1) AS INT) % 16 + 1] AS cardinal_from,
    temp_c, humedad_pct FROM node WHERE direction_from_deg IS NOT NULL"""))
def wind_source(spark, sf):
    docs = _node_documents(
        spark, sf,
        {"speed_kmh": "wind_speed_10m", "direction_from_deg": "wind_direction_10m", "gusts_kmh": "wind_gusts_10m",
         "temp_c": "temperature_2m", "humedad_pct": "relative_humidity_2m"},
    )
    return feeds.parse_wind(docs, feeds.grid_points(spark)).drop("observed_at").withColumns(
        {"latitude": F.round("latitude", 2), "longitude": F.round("longitude", 2)}
    )


@register("air_source", S.query(NODES, """
  SELECT name, aqi, CASE WHEN aqi < 20 THEN 'buena' WHEN aqi < 40 THEN 'aceptable' WHEN aqi < 60 THEN 'moderada' WHEN aqi < 80 THEN 'desfavorable'
    WHEN aqi < 100 THEN 'mala' ELSE 'muy mala' END AS nivel, temp_c AS pm2_5, humedad_pct AS pm10 FROM node WHERE aqi IS NOT NULL"""))
def air_source(spark, sf):
    docs = _node_documents(spark, sf, {"aqi": "european_aqi", "temp_c": "pm2_5", "humedad_pct": "pm10"})
    return feeds.parse_air(docs, feeds.grid_points(spark)).select("name", "aqi", "nivel", "pm2_5", "pm10")


@register("grid_node_counts", S.query(f"{S.HOT}, {GRID}", """
  SELECT name, count(h.event_id) AS n FROM grid LEFT JOIN hot h ON CAST(round((h.latitude - 3.6e1) / 7.5e-1) AS BIGINT) * 19
     + CAST(round((h.longitude + 9.3e0) / 7.5e-1) AS BIGINT) = pos AND h.area_key = 'peninsula' GROUP BY name"""))
def grid_node_counts(spark, sf):
    row = F.round((F.col("latitude") - 36.0) / 0.75).cast("long")
    col = F.round((F.col("longitude") + 9.3) / 0.75).cast("long")
    hot = P.hotspots(spark, sf).where(F.col("area_key") == "peninsula").groupBy((row * 19 + col).alias("pos")).agg(
        F.count("*").alias("n")
    )
    return feeds.grid_points(spark).join(hot, "pos", "left").groupBy("name").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n")
    )


# --- Layers and assets ------------------------------------------------------------------


def _collection(rows, geometry, props):
    feature = F.struct(geometry.alias("geometry"), props.alias("properties"))
    return rows.groupBy(batch("codigo")).agg(F.collect_list(feature).alias("features")).select(
        F.to_json(F.struct("features")).alias("value")
    )


def _landed_features(spark, rows, key: str, geometry, props, name: str, size: int = 500):
    """Feature collections of a bounded number of features each, as files; features name their type first."""
    feature = F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), F.to_json(props), F.lit("}"))
    docs = rows.groupBy(batch(key, size)).agg(F.array_join(F.collect_list(feature), ",\n").alias("f"))
    path = scratch(spark, name)
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","name":"capa","features":['), "f", F.lit('],"total":1}'))).write.text(path)
    return path


def _area_geometry():
    coordinates = F.transform("rings", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    kind = F.when(F.col("area_id") % 9 == 0, "LineString").when(F.col("area_id") % 2 == 0, "MultiPolygon").otherwise("Polygon")
    nested = F.when(F.col("area_id") % 2 == 0, F.to_json(F.array(coordinates))).otherwise(F.to_json(coordinates))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), nested, F.lit("}"))


def _landed_areas(spark, sf, name: str):
    areas = P.areas(spark, sf)
    return _landed_features(spark, areas, "area_id", _area_geometry(), F.struct(F.col("name").alias("NAMEUNIT"), "provincia"), name, 100)


@register("polygon_layer_source", S.query(P.SQL_AREAS, """
  SELECT name AS municipio, provincia, 1 AS anillos, round(clon - hw, 4) AS x0, round(clat, 4) AS y0 FROM areas WHERE area_id % 9 <> 0"""))
def polygon_layer_source(spark, sf):
    layer = layers.municipalities(layers.scan_features(spark, _landed_areas(spark, sf, "areas")), ("NAMEUNIT", "provincia"))
    return layer.select(
        "municipio", "provincia", F.size("rings").alias("anillos"),
        F.round(F.col("rings")[0][0]["x"], 4).alias("x0"), F.round(F.col("rings")[0][0]["y"], 4).alias("y0"),
    )


@register("layer_judgement", S.query(f"""{P.SQL_AREAS}, good AS (SELECT * FROM areas WHERE area_id % 9 <> 0)""", """
  SELECT 'recintos' AS comprobacion, CAST(count(*) AS VARCHAR) AS valor FROM good HAVING count(*) > 10
  UNION ALL SELECT 'geometrías', 'LineString ' || CAST(count(*) AS VARCHAR) FROM areas WHERE area_id % 9 = 0 HAVING count(*) > 0
  UNION ALL SELECT 'controles', '2/3'"""))
def layer_judgement(spark, sf):
    """What the preparation of a layer finds wrong: too many polygons, lines among them, and unknown control points."""
    features = layers.scan_features(spark, _landed_areas(spark, sf, "judged"))
    layer = layers.municipalities(features, ("NAMEUNIT", "provincia"))
    one = polygons.interior_points(layer.orderBy("municipio").limit(1), ["municipio"]).head()
    controls = ((float(one.lat), float(one.lon), ""), (0.0, 0.0, "Nada"), (1.0, 1.0, "Tampoco"))
    return prepare.judge_polygons(features, layer, prepare.Limits(1, 10, min_width=0.0, controls=controls))


@register("settlement_source", S.query(P.SQL_SETTLEMENTS, """
  SELECT nombre, habitantes, tipo, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude FROM settlements WHERE codigo % 8 <> 0"""))
def settlement_source(spark, sf):
    rows = P.settlements(spark, sf)
    props = F.struct(
        "nombre", "habitantes", "tipo", F.col("codigo").cast("string").alias("codine"),
        F.when(F.col("codigo") % 8 != 0, F.col("latitude")).alias("latitud"), F.col("longitude").alias("longitud"),
    )
    path = _landed_features(spark, rows, "codigo", F.lit('{"type":"Point","coordinates":[0,0]}'), props, "settlements")
    return layers.settlements(layers.scan_features(spark, path)).select(
        "nombre", "habitantes", "tipo", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude")
    )


VOLTS = "CASE c_custkey % 4 WHEN 0 THEN '220000;132000' WHEN 1 THEN '400000' WHEN 2 THEN 'medium' ELSE NULL END"


@register("lines_source", f"""WITH w AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 220 WHEN 1 THEN 400 ELSE 0 END AS kv, c_custkey % 2 = 0 AS straight,
    -300000 + c_custkey % 100 * 1000 AS x FROM customer WHERE c_custkey % 5 <> 0)
  SELECT kv, CASE WHEN straight THEN printf('%d 4000000,%d 4000000', x, x + 2000) ELSE printf('%d 4000000,%d 4001000,%d 4000000', x, x + 1000, x + 2000) END AS linea,
    count(*) AS n FROM w GROUP BY 1, 2""")
def lines_source(spark, sf):
    """Simplified lines by their own coordinates: a bend within the tolerance goes, a larger one stays."""
    rows = P.table(spark, sf, "customer").withColumn("v", F.expr(VOLTS))
    bend = F.when(F.col("c_custkey") % 2 == 0, 0.0001).otherwise(0.01)
    start = F.lit(-3.0) + (F.col("c_custkey") % 100) * 0.01
    point = lambda i, dy: F.struct((F.lit(40.0) + dy).alias("lat"), (start + i * 0.01).alias("lon"))
    path = F.array(point(0, F.lit(0.0)), point(1, bend), point(2, F.lit(0.0)))
    geometry = F.when(F.col("c_custkey") % 5 == 0, F.slice(path, 1, 1)).otherwise(path)
    body = F.to_json(F.struct(F.struct(F.col("v").alias("voltage")).alias("tags"), geometry.alias("geometry")))
    way = F.concat(F.lit('{"type":"way",'), F.substring(body, F.lit(2), F.length(body)))
    node = F.lit('{"type":"node","lat":1.0,"lon":2.0},')
    docs = rows.groupBy(batch("c_custkey")).agg(F.array_join(F.collect_list(way), ",").alias("w"))
    where = scratch(spark, "ways")
    docs.select(F.concat(F.lit('{"version":0.6,"elements":['), node, "w", F.lit("]}"))).write.text(where)
    whole = lambda c: F.round(c * 1e5).cast("long").cast("string")
    drawn = F.array_join(F.transform("line", lambda p: F.concat(whole(p["x"]), F.lit(" "), whole(p["y"]))), ",")
    return layers.scan_ways(spark, where).groupBy("kv", drawn.alias("linea")).agg(F.count("*").alias("n"))


@register("asset_csv_source", S.query(P.SQL_SETTLEMENTS, """
  SELECT nombre, round(latitude, 3) AS lat, round(longitude, 3) AS lon FROM settlements WHERE codigo % 6 <> 0"""))
def asset_csv_source(spark, sf):
    comma = lambda c: F.replace(F.format_number(c, 3), F.lit("."), F.lit(","))
    line = F.concat_ws(
        ";", "nombre", F.when(F.col("codigo") % 6 != 0, comma("latitude")).otherwise(F.lit("")), comma("longitude")
    )
    lines = P.settlements(spark, sf).select((F.col("codigo") + 1).alias("n"), line.alias("value"))
    rows = assets.parse_rows(lines, ";", 1, 2, 0)
    return rows.select("nombre", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@register("asset_geojson_source", S.query(P.SQL_SETTLEMENTS, """
  SELECT nombre, round(latitude, 3) AS lat, round(longitude, 3) AS lon FROM settlements WHERE codigo % 4 <> 0"""))
def asset_geojson_source(spark, sf):
    kind = F.when(F.col("codigo") % 4 == 0, "LineString").otherwise("Point")
    geometry = F.struct(kind.alias("type"), F.array("longitude", "latitude").alias("coordinates"))
    props = F.struct(F.lit(" ").alias("name"), F.col("nombre").alias("activo"))
    docs = _collection(P.settlements(spark, sf), geometry, props)
    return assets.parse_geojson(docs).select("nombre", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@register("asset_batch_report", S.query(P.SQL_SETTLEMENTS, """
  SELECT count(*) AS n, count(*) FILTER (abs(longitude) <= 10 AND abs(latitude) >= 30) AS invertidos,
    CASE WHEN count(*) FILTER (abs(longitude) <= 10 AND abs(latitude) >= 30) > count(*) / 2e0 THEN 'coordenadas invertidas' ELSE 'ok' END AS veredicto
  FROM settlements"""))
def asset_batch_report(spark, sf):
    swapped = P.settlements(spark, sf).select(F.col("longitude").alias("lat"), F.col("latitude").alias("lon"))
    return assets.batch_report(swapped)


# --- History and runs --------------------------------------------------------------------


@register("history_idempotent_append", S.query(S.CLEAN, """
  SELECT strftime(acq_dt, '%Y-%m-%d') AS dia, count(*) AS n, round(sum(frp_mw), 2) AS frp FROM clean GROUP BY 1"""))
def history_idempotent_append(spark, sf):
    from firespark.catalog import stages

    root = scratch(spark, "history")
    rows = stages.clean(spark, sf)
    early = rows.where(F.col("acq_dt") < F.lit("2024-01-20").cast("timestamp"))
    history.append_history(early, root)
    history.append_history(rows.withColumn("frp_mw", F.col("frp_mw") + F.when(F.col("acq_dt") < F.lit("2024-01-20").cast("timestamp"), 1.0).otherwise(0.0)), root)
    stored = spark.read.parquet(root)
    return stored.groupBy(F.date_format("acq_dt", "yyyy-MM-dd").alias("dia")).agg(
        F.count("*").alias("n"), F.round(F.sum("frp_mw"), 2).alias("frp")
    )


@register("history_partitioned_scan", S.query(S.HOT, f"""
  SELECT source, count(*) AS n, count(DISTINCT CAST(acq_dt AS DATE)) AS dias FROM hot WHERE acq_dt >= {NOW} - INTERVAL 3 DAYS GROUP BY 1"""))
def history_partitioned_scan(spark, sf):
    root = scratch(spark, "history")
    history.append_history(P.hotspots(spark, sf), root)
    recent = history.read_history(spark, root).where(F.col("acq_date") >= F.lit("2024-01-28").cast("date"))
    return recent.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("acq_date").alias("dias"))


@register("run_counters_append", """SELECT 24 AS n, (SELECT count(*) FROM events) AS ultimo, (SELECT count(DISTINCT user_id) FROM events) AS incidentes""")
def run_counters_append(spark, sf):
    from firespark.catalog.quality_checks import _runs

    events = P.table(spark, sf, "events")
    kept = publish.append_run(
        _runs(spark, sf).select("hotspots", "incidents", "at"), events, events.select("user_id").distinct(),
        "2024-01-31T00:00:00Z",
    )
    return kept.agg(
        F.count("*").cast("int").alias("n"), F.max_by("hotspots", "at").alias("ultimo"),
        F.max_by("incidents", "at").alias("incidentes"),
    )
