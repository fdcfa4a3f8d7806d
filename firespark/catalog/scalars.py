"""Checks of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.catalog import register
from firespark.catalog import sql as S
from firespark.functions import domain, geo, text, times
from firespark.operators import explore, fuse, summaries
from firespark.plans import layers as L
from firespark.plans import projections as P
from firespark.sinks import features as geojson

NOW = P.SQL_NOW
COMPASS = "['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSO','SO','OSO','O','ONO','NO','NNO']"


@register("utm_forward", S.query(f"{S.HOT}, {S.utm('m', 'hot', S.ZONE_OF_AREA)}", """
  SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM m"""))
def utm_forward(spark, sf):
    placed = geo.with_utm(P.hotspots(spark, sf), "latitude", "longitude", geo.zone_of_area(F.col("area_key")))
    return placed.select("event_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@register("utm_round_trip", S.query(S.HOT, """
  SELECT event_id, round(latitude, 6) AS lat, round(longitude, 6) AS lon FROM hot"""))
def utm_round_trip(spark, sf):
    zone = geo.zone_of_area(F.col("area_key"))
    placed = geo.with_utm(P.hotspots(spark, sf), "latitude", "longitude", zone)
    lat, lon = geo.utm_to_degrees(F.col("x"), F.col("y"), zone)
    return placed.select("event_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@register("spherical_measures", S.query(P.SQL_SETTLEMENTS, f"""
  SELECT codigo, round({S.haversine('latitude', 'longitude', '4.04168e1', '-3.7038e0')}, 3) AS km,
    round({S.bearing('latitude', 'longitude', '4.04168e1', '-3.7038e0')}, 3) AS rumbo,
    round(sqrt(pow((latitude - 4.04168e1) * 1.1132e2, 2) + pow((longitude + 3.7038e0) * 1.1132e2 * cos(radians(latitude)), 2)), 3) AS plano,
    round(CASE WHEN abs({S.bearing('latitude', 'longitude', '4.04168e1', '-3.7038e0')} - 1e1) > 180
      THEN 360 - abs({S.bearing('latitude', 'longitude', '4.04168e1', '-3.7038e0')} - 1e1)
      ELSE abs({S.bearing('latitude', 'longitude', '4.04168e1', '-3.7038e0')} - 1e1) END, 3) AS angulo FROM settlements"""))
def spherical_measures(spark, sf):
    a = (F.col("latitude"), F.col("longitude"))
    b = (F.lit(40.4168), F.lit(-3.7038))
    return P.settlements(spark, sf).select(
        "codigo", F.round(geo.haversine_km(*a, *b), 3).alias("km"), F.round(geo.bearing_deg(*a, *b), 3).alias("rumbo"),
        F.round(geo.flat_km(*a, *b), 3).alias("plano"),
        F.round(geo.angle_between(geo.bearing_deg(*a, *b), F.lit(10.0)), 3).alias("angulo"),
    )


@register("stable_fire_id", S.query(S.HOT, """
  SELECT event_id, substr(sha1(printf('%.3f', latitude) || '|' || printf('%.3f', longitude) || '|' || strftime(acq_dt, '%Y-%m-%d')), 1, 10) AS fire_id FROM hot"""))
def stable_fire_id(spark, sf):
    return P.hotspots(spark, sf).select(
        "event_id", domain.fire_id(F.col("latitude"), F.col("longitude"), F.col("acq_dt")).alias("fire_id")
    )


@register("iso_and_hours", S.query(S.HOT, f"""
  SELECT event_id, {S.iso('acq_dt')} AS iso, round({S.hours(NOW, 'acq_dt')}, 3) AS horas,
    CASE WHEN {S.hours(NOW, 'acq_dt')} <= 24 THEN 'activo' ELSE 'inactivo' END AS estado,
    CASE WHEN event_id % 50 = 0 THEN 'nulo' WHEN event_id * 7 % 20000 < 3600 THEN 'ok' WHEN event_id * 7 % 20000 <= 14400 THEN 'warn' ELSE 'bad' END AS latencia FROM hot"""))
def iso_and_hours(spark, sf):
    hours = times.hours_between(P.now(), F.col("acq_dt"))
    secs = F.when(F.col("event_id") % 50 != 0, F.col("event_id") * 7 % 20000)
    return P.hotspots(spark, sf).select(
        "event_id", times.iso_z(F.col("acq_dt")).alias("iso"), F.round(hours, 3).alias("horas"),
        domain.activity(hours).alias("estado"), domain.latency_class(secs).alias("latencia"),
    )


@register("hhmm_padding", S.query("", """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + to_minutes(CAST((o_orderkey % 24) * 60 + o_orderkey % 60 AS BIGINT)),
   '%Y-%m-%dT%H:%M:%SZ') AS acq FROM orders""").replace("WITH RECURSIVE  ", ""))
def hhmm_padding(spark, sf):
    hhmm = (F.col("o_orderkey") % 24) * 100 + F.col("o_orderkey") % 60
    return P.table(spark, sf, "orders").select(
        "o_orderkey",
        times.iso_z(times.hhmm_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd"), hhmm)).alias("acq"),
    )


@register("madrid_local_time", """SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE strftime(
   CAST(o_orderdate AS TIMESTAMP) + INTERVAL 12 HOURS - CASE WHEN
     CAST(o_orderdate AS DATE) >= last_day(make_date(year(o_orderdate), 3, 1)) - CAST(dayofweek(last_day(make_date(year(o_orderdate), 3, 1))) AS INT)
     AND CAST(o_orderdate AS DATE) < last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) <= 1995 THEN 9 ELSE 10 END, 1)) - CAST(dayofweek(last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) <= 1995 THEN 9 ELSE 10 END, 1))) AS INT)
   THEN INTERVAL 2 HOURS ELSE INTERVAL 1 HOURS END, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM orders""")
def madrid_local_time(spark, sf):
    shown = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 12:00:00"))
    shown = F.when(F.col("o_orderkey") % 13 == 0, "no consta").otherwise(shown)
    return P.table(spark, sf, "orders").select("o_orderkey", times.iso_z(times.madrid_to_utc(shown)).alias("utc"))


@register("age_in_days", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE
   round_even((epoch_us({NOW}) - epoch_us(CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS BIGINT)) - INTERVAL 1 HOURS)) / 1e6 / 8.64e4, 1) END AS edad FROM orders""")
def age_in_days(spark, sf):
    iso = F.concat(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"),
        F.lit(":00:00+01:00"),
    )
    iso = F.when(F.col("o_orderkey") % 7 == 0, "ayer").otherwise(iso)
    return P.table(spark, sf, "orders").select("o_orderkey", times.age_days(iso, P.now()).alias("edad"))


@register("compass_and_wind", S.query(L.SQL_WIND, f"""
  SELECT name, {COMPASS}[CAST(floor(direction_from_deg / 2.25e1 + 5e-1) AS INT) % 16 + 1] AS desde, direction_to_deg AS hacia FROM wind"""))
def compass_and_wind(spark, sf):
    return L.wind(spark, sf).where(F.col("direction_from_deg").isNotNull()).select(
        "name", domain.compass(F.col("direction_from_deg")).alias("desde"), F.col("direction_to_deg").alias("hacia")
    )


@register("air_bands", S.query(L.SQL_STATIONS, """
  SELECT name, CASE WHEN aqi IS NULL THEN '' WHEN aqi < 20 THEN 'buena' WHEN aqi < 40 THEN 'aceptable' WHEN aqi < 60 THEN 'moderada'
    WHEN aqi < 80 THEN 'desfavorable' WHEN aqi < 100 THEN 'mala' ELSE 'muy mala' END AS nivel FROM stations"""))
def air_bands(spark, sf):
    return L.stations(spark, sf).select("name", domain.air_band(F.col("aqi")).alias("nivel"))


@register("intensity_area_radius", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 2e1 <= 50 THEN 'baja' WHEN l_quantity * 2e1 <= 200 THEN 'media'
   WHEN l_quantity * 2e1 <= 800 THEN 'alta' ELSE 'extrema' END AS intensidad, round_even(l_quantity * 1.406e1, 0) AS area,
   round(sqrt(round_even(l_quantity * 1.406e1, 0) * 1e4 / pi()) / 1e3, 6) AS radio FROM lineitem""")
def intensity_area_radius(spark, sf):
    area = domain.estimated_area_ha(F.col("l_quantity"))
    return P.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", domain.intensity(F.col("l_quantity") * 20.0).alias("intensidad"),
        area.alias("area"), F.round(geo.circle_radius_km(area), 6).alias("radio"),
    )


@register("status_and_ids", S.query(P.SQL_OFFICIAL, """
  SELECT external_id, 'off_' || source_id || '_' || external_id AS huerfano, least(precision_m + 3e3, 1.5e4) AS tolerancia,
    CASE raw_status WHEN 'O' THEN 'activo' WHEN 'P' THEN 'controlado' ELSE 'desconocido' END AS estado,
    CASE WHEN level = 0 THEN external_id ELSE provincia || '-' || external_id END AS compuesto FROM official WHERE provincia IS NOT NULL
  UNION ALL SELECT external_id, 'off_' || source_id || '_' || external_id, least(precision_m + 3e3, 1.5e4),
    CASE raw_status WHEN 'O' THEN 'activo' WHEN 'P' THEN 'controlado' ELSE 'desconocido' END, external_id FROM official WHERE provincia IS NULL"""))
def status_and_ids(spark, sf):
    from firespark.sources.official import normalise_status

    raw = F.expr("CASE raw_status WHEN 'O' THEN ' Declarado hoy' WHEN 'P' THEN 'bajo CONTROL' ELSE '' END")
    return P.official(spark, sf).select(
        "external_id", domain.orphan_id(F.col("source_id"), F.col("external_id")).alias("huerfano"),
        domain.match_tolerance_m(F.col("precision_m")).alias("tolerancia"), normalise_status(raw).alias("estado"),
        F.concat_ws("-", F.when(F.col("level") != 0, F.col("provincia")), "external_id").alias("compuesto"),
    )


@register("fold_accents", r"""SELECT doc_id, md5(trim(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS huella FROM documents""")
def fold_accents(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("huella"))


WORDS = r"list_filter(string_split_regex(trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '\s+'), lambda w: w <> '')"


@register("place_names", rf"""SELECT doc_id, md5(array_to_string(list_transform({WORDS}, lambda w, i: CASE WHEN i > 1 AND w IN ('de','del','la','las','el','los','y','e','a','al')
   THEN w ELSE array_to_string(list_transform(string_split(w, '-'), lambda t: replace(upper(substr(t, 1, 1)), 'ẞ', 'Ss') || substr(t, 2)), '-') END), ' ')) AS huella FROM documents""")
def place_names(spark, sf):
    return P.table(spark, sf, "documents").select("doc_id", F.md5(text.place_name(F.col("text"))).alias("huella"))


@register("province_names", S.query(P.SQL_SETTLEMENTS, """
  SELECT codigo, CASE codigo % 4 WHEN 0 THEN 'León' WHEN 1 THEN 'Ávila' WHEN 2 THEN 'Las Rozas de Arriba' ELSE NULL END AS provincia FROM settlements"""))
def province_names(spark, sf):
    raw = F.expr("CASE codigo % 4 WHEN 0 THEN ' LEON' WHEN 1 THEN 'avila ' WHEN 2 THEN 'LAS ROZAS  DE ARRIBA' ELSE '' END")
    return P.settlements(spark, sf).select("codigo", text.province_name(raw).alias("provincia"))


@register("voltages_and_numbers", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 220 WHEN 1 THEN 45 ELSE 0 END AS kv,
   CASE c_custkey % 3 WHEN 0 THEN c_acctbal WHEN 1 THEN NULL ELSE 12 END AS num, CASE c_custkey % 2 WHEN 0 THEN 'AT' ELSE 'VI' END AS codigo FROM customer""")
def voltages_and_numbers(spark, sf):
    volts = F.expr("CASE c_custkey % 5 WHEN 0 THEN '220000;132000' WHEN 1 THEN ' 45000 ' WHEN 2 THEN 'alta' WHEN 3 THEN NULL ELSE '' END")
    number = F.expr("CASE c_custkey % 3 WHEN 0 THEN CAST(c_acctbal AS STRING) WHEN 1 THEN 'n/d' ELSE ' 12 ' END")
    code = F.expr("CASE c_custkey % 2 WHEN 0 THEN 'AT ;Temperaturas' ELSE 'VI' END")
    return P.table(spark, sf, "customer").select(
        "c_custkey", text.kilovolts(volts).alias("kv"), text.number(number).alias("num"), text.code_prefix(code).alias("codigo")
    )


SENSORS = ("CASE o_orderkey % 4 WHEN 0 THEN 'MODIS_NRT,VIIRS_SNPP_NRT, VIIRS_NOAA20_NRT' WHEN 1 THEN 'MODIS_NRT' WHEN 2 THEN NULL ELSE 'SEVIRI_FRP_PIXEL,Otro' END")


@register("sensor_lists", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'MODIS · VIIRS' WHEN 1 THEN 'MODIS' WHEN 2 THEN '—' ELSE 'SEVIRI · Otro' END AS familias,
   CASE o_orderkey % 4 WHEN 0 THEN '375 m' WHEN 1 THEN '1 km' WHEN 3 THEN '3 km' END AS resolucion,
   CASE o_orderkey % 4 WHEN 0 THEN 3.75e2 ELSE 1e3 END AS precision_m FROM orders""")
def sensor_lists(spark, sf):
    sensors = F.expr(SENSORS)
    return P.table(spark, sf, "orders").select(
        "o_orderkey", domain.sensor_families(sensors).alias("familias"), domain.sensor_resolution(sensors).alias("resolucion"),
        domain.sensor_precision_m(sensors).alias("precision_m"),
    )


@register("status_texts", S.query(P.SQL_OFFICIAL, f"""
  SELECT external_id, CASE WHEN level = 0 THEN CASE status WHEN 'activo' THEN 'Activo' WHEN 'controlado' THEN 'Controlado' ELSE 'Extinguido' END
    WHEN level = 1 THEN 'Sin estado declarado' WHEN {S.hours(NOW, 'reported_at')} < 1 THEN 'Calor detectado hace menos de 1 h'
    ELSE 'Calor detectado hace ' || CAST(CAST(floor({S.hours(NOW, 'reported_at')} + 5e-1) AS BIGINT) AS VARCHAR) || ' h' END AS texto FROM official"""))
def status_texts(spark, sf):
    seen = F.when(F.col("level") != 1, times.hours_between(P.now(), F.col("reported_at")))
    status = F.when(F.col("level") == 0, F.col("status"))
    return P.official(spark, sf).select("external_id", domain.status_text(status, seen).alias("texto"))


@register("land_cover_codes", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Bosque mixto' WHEN 1 THEN 'Superficie artificial' WHEN 2 THEN 'Olivar' WHEN 3 THEN NULL
   WHEN 4 THEN 'Superficie forestal o seminatural' ELSE 'Superficie de agua' END AS clase,
   CASE p_partkey % 6 WHEN 0 THEN 'forestal' WHEN 1 THEN 'urbano' WHEN 2 THEN 'agrícola' WHEN 3 THEN NULL WHEN 4 THEN 'forestal' ELSE 'otro' END AS tipo FROM part""")
def land_cover_codes(spark, sf):
    code = F.expr("CASE p_partkey % 6 WHEN 0 THEN '313' WHEN 1 THEN '112' WHEN 2 THEN ' 223 ' WHEN 3 THEN '999' WHEN 4 THEN '3' ELSE '512' END")
    return P.table(spark, sf, "part").select(
        "p_partkey", domain.land_cover_class(code).alias("clase"), domain.land_cover_type(code).alias("tipo")
    )


@register("worst_status", S.query(P.SQL_OFFICIAL, """
  SELECT municipio, arg_max(status, CASE status WHEN 'activo' THEN 4 WHEN 'estabilizado' THEN 3 WHEN 'controlado' THEN 2 ELSE 1 END) AS peor FROM official GROUP BY 1"""))
def worst_status(spark, sf):
    return P.official(spark, sf).groupBy("municipio").agg(fuse.worst_status(F.col("status")).alias("peor"))


@register("exposure_classes", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 OR l_quantity > 10 THEN 'lejos' WHEN l_orderkey % 3 = 0 THEN 'duda'
   WHEN l_orderkey % 3 = 1 THEN 'alta' ELSE 'media' END AS clase FROM lineitem""")
def exposure_classes(spark, sf):
    km = F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity"))
    down = F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 3 == 1)
    return P.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", domain.exposure_class(km, down, 10.0).alias("clase")
    )


@register("geojson_features", S.query(S.CONF, f"""
  SELECT event_id, CAST(round(longitude, 3) AS DOUBLE) AS lon, CAST(round(latitude, 3) AS DOUBLE) AS lat, 'Feature' AS tipo, {S.iso('acq_dt')} AS acq_dt,
    instrument, frp_mw, 7 AS claves FROM conf"""))
def geojson_features(spark, sf):
    from firespark.operators.clean import filter_confidence

    rows = filter_confidence(P.hotspots(spark, sf)).withColumns(
        {"fire_id": F.lit(None).cast("string"), "confianza_baja": F.lit(False)}
    )
    made = geojson.features(
        rows.withColumn("event", F.col("event_id")), (*geojson.HOTSPOT_FIELDS, "event", "absent"),
        geojson.point_geometry("latitude", "longitude"),
    )
    layout = (
        "struct<type:string,geometry:struct<type:string,coordinates:array<double>>,properties:map<string,string>>"
    )
    f = made.select(F.from_json("value", layout).alias("f"))
    prop = lambda n: F.col("f.properties")[n]
    return f.select(
        prop("event").cast("long").alias("event_id"), F.round(F.col("f.geometry.coordinates")[0], 3).alias("lon"),
        F.round(F.col("f.geometry.coordinates")[1], 3).alias("lat"), F.col("f.type").alias("tipo"),
        prop("acq_dt").alias("acq_dt"), prop("instrument").alias("instrument"),
        prop("frp_mw").cast("double").alias("frp_mw"), (F.size("f.properties") - 1).alias("claves"),
    )


@register("name_like_columns", """SELECT 'nombre' AS columna, count(*) AS valores, count(DISTINCT c_name) AS distintos, count(*) AS con_letras, true AS parece_nombre FROM customer
  UNION ALL SELECT 'tipo', count(*), count(DISTINCT c_mktsegment), count(*), false FROM customer""")
def name_like_columns(spark, sf):
    return summaries.name_like_columns(P.settlements(spark, sf))


@register("layer_plausibility", S.query(P.SQL_SETTLEMENTS, """
  SELECT count(*) AS n, round(min(longitude), 3) AS oeste, round(max(longitude), 3) AS este, round(min(latitude), 3) AS sur, round(max(latitude), 3) AS norte,
    count(*) BETWEEN 100 AND 100000 AS recuento_ok, true AS caja_ok, max(longitude) - min(longitude) >= 10 AS ancho_ok FROM settlements"""))
def layer_plausibility(spark, sf):
    out = summaries.layer_plausibility(
        P.settlements(spark, sf), 100, 100_000, (-18.5, 27.0, 5.0, 44.5), "latitude", "longitude"
    )
    return out.withColumns({c: F.round(c, 3) for c in ("oeste", "este", "sur", "norte")})


@register("missing_controls", """SELECT c AS control FROM (SELECT unnest(['Customer#000000007', 'Madrid', 'Sevilla']) AS c) WHERE c NOT IN (SELECT c_name FROM customer)""")
def missing_controls(spark, sf):
    return summaries.missing_controls(
        P.settlements(spark, sf), "nombre", ["Customer#000000007", "Madrid", "Sevilla"]
    ).select("control")


@register("field_inventory", """SELECT unnest(['k']) AS campo, count(*) AS presentes, count(*) AS con_valor FROM events""")
def field_inventory(spark, sf):
    events = P.table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("m"))
    return summaries.field_inventory(events, "m").select("campo", "presentes", "con_valor")


@register("field_map_proposal", S.query("", """SELECT 'external_id' AS destino, 'id_incendio' AS campo WHERE (SELECT count(*) FROM orders) > 0
  UNION ALL SELECT 'municipio', 'municipio_nombre' UNION ALL SELECT 'reported_at', 'fecha_alta' UNION ALL SELECT 'status', 'estado_actual'""").replace("WITH RECURSIVE  ", ""))
def field_map_proposal(spark, sf):
    records = P.official(spark, sf).select(
        F.create_map(
            F.lit("id_incendio"), F.col("external_id"), F.lit("estado_actual"), F.col("raw_status"),
            F.lit("municipio_nombre"), F.col("municipio"), F.lit("fecha_alta"), F.col("reported_at").cast("string"),
            F.lit("zzz"), F.lit(" "),
        ).alias("m")
    )
    return summaries.propose_field_map(summaries.field_inventory(records, "m")).select("destino", "campo")


@register("exposure_rank_key", """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 3 = 1 THEN l_quantity / 2 ELSE l_quantity END AS gravedad FROM lineitem""")
def exposure_rank_key(spark, sf):
    rows = P.table(spark, sf, "lineitem").withColumns(
        {
            "distancia_km": F.col("l_quantity"),
            "a_sotavento": F.when(F.col("l_orderkey") % 3 != 0, F.col("l_orderkey") % 3 == 1),
        }
    )
    return rows.select("l_orderkey", "l_linenumber", explore.exposure_rank().alias("gravedad"))
