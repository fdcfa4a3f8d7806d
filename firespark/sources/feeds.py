"""Weather grids, weather warnings (CAP) and road closures (DATEX II)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.functions import domain, text, times
from firespark.functions.text import lookup
from firespark.operators.rows import conform, keep_first
from firespark.schemas import schema

# Regular grids as (lat0, rows, lon0, columns); the step is 0.75 degrees.
GRIDS = ((36.0, 11, -9.3, 19), (27.6, 3, -18.2, 7))
STEP_DEG = 0.75


def grid_points(spark: SparkSession) -> DataFrame:
    """``(pos, name, latitude, longitude)`` of the fixed node grid, in feed order."""
    parts, offset = [], 0
    for lat0, n_lat, lon0, n_lon in GRIDS:
        ids = spark.range(n_lat * n_lon)
        i, j = F.floor(F.col("id") / n_lon), F.col("id") % n_lon
        parts.append(
            ids.select(
                (F.col("id") + offset).alias("pos"),
                F.round(F.lit(lat0) + i * F.lit(STEP_DEG), 2).alias("latitude"),
                F.round(F.lit(lon0) + j * F.lit(STEP_DEG), 2).alias("longitude"),
            )
        )
        offset += n_lat * n_lon
    grid = parts[0].unionByName(parts[1])
    name = F.concat_ws(",", F.format_number("latitude", 2), F.format_number("longitude", 2))
    return grid.select("pos", name.alias("name"), "latitude", "longitude")


# --- Node payloads ---------------------------------------------------------------

_WIND_NOW = (
    "struct<time:string,wind_speed_10m:double,wind_direction_10m:double,wind_gusts_10m:double,"
    "temperature_2m:double,relative_humidity_2m:double>"
)
_AIR_NOW = "struct<time:string,european_aqi:double,pm2_5:double,pm10:double,carbon_monoxide:double>"


def _blocks(documents: DataFrame, current: str) -> DataFrame:
    """``(pos, b)`` per block; a document may be a list of blocks or a single one."""
    item = f"struct<latitude:double,longitude:double,current:{current}>"
    one = F.concat(F.lit("["), F.col("value"), F.lit("]"))
    listed = F.when(F.ltrim("value").startswith("["), F.col("value")).otherwise(one)
    return documents.select(F.posexplode(F.from_json(listed, f"array<{item}>")).alias("pos", "b"))


def _zip(documents: DataFrame, grid: DataFrame, current: str) -> DataFrame:
    """Block i belongs to grid node i; the shorter side wins."""
    nodes = grid.withColumnsRenamed({"latitude": "_lat", "longitude": "_lon"})
    joined = _blocks(documents, current).join(nodes, "pos")
    return joined.select(
        "pos", "name",
        F.coalesce("b.latitude", "_lat").alias("latitude"),
        F.coalesce("b.longitude", "_lon").alias("longitude"),
        F.col("b.current").alias("c"),
    )


def parse_wind(documents: DataFrame, grid: DataFrame) -> DataFrame:
    rows = _zip(documents, grid, _WIND_NOW).where(F.col("c.wind_direction_10m").isNotNull())
    shaped = rows.select(
        "name", "latitude", "longitude",
        F.col("c.wind_speed_10m").alias("speed_kmh"), F.col("c.wind_gusts_10m").alias("gusts_kmh"),
        F.col("c.wind_direction_10m").alias("direction_from_deg"),
        domain.wind_towards(F.col("c.wind_direction_10m")).alias("direction_to_deg"),
        domain.compass(F.col("c.wind_direction_10m")).alias("cardinal_from"),
        F.col("c.temperature_2m").alias("temp_c"), F.col("c.relative_humidity_2m").alias("humedad_pct"),
        F.col("c.time").alias("observed_at"),
    )
    return conform(shaped, schema("wind"))


def parse_air(documents: DataFrame, grid: DataFrame) -> DataFrame:
    rows = _zip(documents, grid, _AIR_NOW).where(F.col("c.european_aqi").isNotNull())
    shaped = rows.select(
        "name", "latitude", "longitude",
        F.col("c.european_aqi").alias("aqi"), domain.air_band(F.col("c.european_aqi")).alias("nivel"),
        F.col("c.pm2_5").alias("pm2_5"), F.col("c.pm10").alias("pm10"),
        F.col("c.carbon_monoxide").alias("co"), F.col("c.time").alias("observed_at"),
    )
    return conform(shaped, schema("air"))


# --- Road closures ---------------------------------------------------------------

# Closure classes kept, and display labels of causes and details.
CLOSURE_CLASS = {
    "roadClosed": "carretera cerrada", "carriagewayClosures": "calzada cortada",
    "laneClosures": "carril cortado",
}
CAUSE_LABEL = {
    "roadMaintenance": "obras",
    "accident": "accidente",
    "vehicleObstruction": "vehículo obstaculizando",
    "environmentalObstruction": "obstáculo natural",
    "obstruction": "obstáculo",
    "infrastructureDamageObstruction": "daño en la infraestructura",
    "abnormalTraffic": "tráfico anómalo",
    "poorEnvironment": "condiciones ambientales",
    "roadOrCarriagewayOrLaneManagement": "gestión de carriles",
}
DETAIL_LABEL = {
    "forestFire": "incendio forestal",
    "rockfalls": "desprendimientos",
    "flooding": "inundación",
    "avalanches": "aludes",
    "objectOnTheRoad": "objeto en la calzada",
    "obstructionOnTheRoad": "obstáculo en la calzada",
    "roadworks": "obras",
    "slowTraffic": "tráfico lento",
    "heavyTraffic": "tráfico denso",
}
DETAIL_ELEMENTS = (
    "environmentalObstructionType", "obstructionType", "accidentType", "abnormalTrafficType",
    "roadMaintenanceType",
)
FIRE_CAUSE = "forestFire"
RECORD_END = "situationRecord>"


def read_situation_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record text. The closing tag is the line separator, so a feed of any
    size is split between tasks instead of being loaded as one document."""
    return spark.read.text(path, lineSep=RECORD_END)


def _bare(xml: Column) -> Column:
    """The record without name-space prefixes, complete and well formed; null if none.

    An opening tag without attributes ends in the separator too: its record is the next
    row, which has a closing tag and no opening one.
    """
    whole = F.regexp_extract(xml, r"(?s)(<(?:[\w.-]+:)?situationRecord\b.*)$", 1)
    headless = (whole == "") & xml.rlike(r"</(?:[\w.-]+:)?$")
    inner = F.when(headless, F.concat(F.lit("<situationRecord>"), xml)).otherwise(whole)
    open_end = F.regexp_replace(inner, r"</(?:[\w.-]+:)?$", "")
    plain = F.regexp_replace(open_end, r"<(/?)[\w.-]+:", "<$1")
    plain = F.regexp_replace(plain, r"\s[\w.-]+:([\w.-]+)\s*=", " $1=")
    return F.when(inner != "", F.concat(plain, F.lit("</situationRecord>")))


def _first_text(record: str, element: str) -> Column:
    """First non-blank text of an element, or of its ``value`` child."""
    found = F.xpath(record, F.lit(f"//{element}/text() | //{element}/value/text()"))
    kept = F.filter(F.transform(found, text.strip), lambda v: v != "")
    return F.try_element_at(kept, F.lit(1))


def parse_closures(records: DataFrame, now: Column) -> DataFrame:
    """Closures that matter: a closed road, or a record whose cause is a forest fire."""
    named = {
        "gestion": "roadOrCarriagewayOrLaneManagementType", "causa": "causeType",
        "lat": "latitude", "lon": "longitude", "actualizado": "situationRecordVersionTime",
        "referencia": "situationRecordCreationReference", "via": "roadName", "numero": "roadNumber",
        "pk": "kilometerPoint", "municipio": "municipality", "provincia": "province",
        "comunidad": "autonomousCommunity", "desde": "overallStartTime",
    }
    bare = records.select(_bare(F.col("value")).alias("r")).where(F.col("r").isNotNull())
    cols = {alias: _first_text("r", element) for alias, element in named.items()}
    cols["tipo"] = F.coalesce(*[_first_text("r", e) for e in DETAIL_ELEMENTS])
    cols["propio"] = F.nullif(F.xpath_string("r", F.lit("/situationRecord/@id")), F.lit(""))
    rows = bare.withColumns(cols).drop("r")
    relevant = F.col("gestion").isin(*CLOSURE_CLASS) | F.col("tipo").eqNullSafe(FIRE_CAUSE)
    rows = rows.where(
        F.coalesce(relevant, F.lit(False)) & F.col("lat").isNotNull() & F.col("lon").isNotNull()
    )
    shaped = rows.select(
        F.coalesce("propio", "referencia").alias("id"),
        lookup(CAUSE_LABEL, F.col("causa"), F.coalesce("causa", F.lit("incidencia"))).alias("causa"),
        lookup(DETAIL_LABEL, F.col("tipo"), F.col("tipo")).alias("detalle"),
        lookup(CLOSURE_CLASS, F.col("gestion")).alias("cierre"),
        F.col("tipo").eqNullSafe(FIRE_CAUSE).alias("por_incendio"),
        F.coalesce("via", "numero").alias("carretera"),
        "pk", "municipio", "provincia", "comunidad",
        F.col("lat").try_cast("double").alias("latitude"),
        F.col("lon").try_cast("double").alias("longitude"),
        "desde", "actualizado", times.age_days(F.col("actualizado"), now).alias("edad_dias"),
    )
    return conform(shaped, schema("closures"))


# --- Weather warnings --------------------------------------------------------------

# Phenomena that matter for a fire.
PHENOMENA = {
    "AT": "temperaturas máximas", "BT": "temperaturas mínimas", "PR": "lluvia", "NE": "nieve",
    "TO": "tormentas", "VI": "viento", "PV": "polvo en suspensión",
}
LANGUAGE = "es-ES"
LEVEL_PARAMETER = "AEMET-Meteoalerta nivel"
PROBABILITY_PARAMETER = "AEMET-Meteoalerta probabilidad"
ZONE_CODE = "AEMET-Meteoalerta zona"
MIN_LEVEL = 1

_PAIR = "struct<valueName:string,value:string>"
ALERT = (
    "struct<identifier:string,sent:string,info:array<struct<language:string,"
    f"eventCode:array<{_PAIR}>,onset:string,expires:string,headline:string,description:string,"
    f"parameter:array<{_PAIR}>,area:array<struct<areaDesc:string,polygon:string,geocode:array<{_PAIR}>>>>>,"
    "_corrupt_record:string>"
)


def _parameter(pairs: Column, name: str, last: bool = False) -> Column:
    hits = F.filter(pairs, lambda p: text.strip(p["valueName"]) == name)
    return F.coalesce(text.strip(F.try_element_at(hits, F.lit(-1 if last else 1))["value"]), F.lit(""))


def cap_ring(polygon: Column) -> Column:
    """``lat,lon lat,lon …`` to a closed ring of (x, y); null below four vertices."""

    def vertex(pair: Column) -> Column:
        parts = F.split(pair, ",")
        sound = F.size(parts) == 2
        return F.struct(
            F.when(sound, F.try_element_at(parts, F.lit(2)).try_cast("double")).alias("x"),
            F.when(sound, F.try_element_at(parts, F.lit(1)).try_cast("double")).alias("y"),
        )

    points = F.filter(
        F.transform(F.split(text.strip(polygon), r"\s+"), vertex),
        lambda p: p["x"].isNotNull() & p["y"].isNotNull(),
    )
    first, last = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    closed = F.when(first == last, points).otherwise(F.concat(points, F.array(first)))
    return F.when(F.size(points) >= 4, closed)


def alerts(documents: DataFrame) -> DataFrame:
    """Each XML document as a struct ``a``; unreadable ones keep ``_corrupt_record``."""
    plain = F.regexp_replace(F.col("value"), r"<(/?)[\w.-]+:", "<$1")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    return documents.select(F.from_xml(plain, ALERT, options).alias("a"), "value")


def unreadable_alerts(documents: DataFrame) -> DataFrame:
    return alerts(documents).where(F.col("a.identifier").isNull()).select("value")


def parse_warnings(documents: DataFrame) -> DataFrame:
    """Relevant Spanish warnings, one row per area; one bad document loses only itself."""
    info = alerts(documents).where(F.col("a.identifier").isNotNull()).select(
        text.strip("a.identifier").alias("identifier"), text.strip("a.sent").alias("sent"),
        F.explode("a.info").alias("i"),
    )
    code = text.code_prefix(F.coalesce(text.strip(F.try_element_at("i.eventCode", F.lit(1))["value"]), F.lit("")))
    level = F.lower(_parameter(F.col("i.parameter"), LEVEL_PARAMETER))
    kept = (
        info.where(text.strip("i.language") == LANGUAGE)
        .withColumns({"nivel": level, "fenomeno_codigo": code})
        .withColumn("nivel_orden", domain.warning_order(F.col("nivel")))
        .where((F.col("nivel_orden") >= MIN_LEVEL) & F.col("fenomeno_codigo").isin(*PHENOMENA))
    )
    rows = kept.select("*", F.explode("i.area").alias("area")).withColumns(
        {
            "ring": cap_ring(F.col("area.polygon")),
            "zona_codigo": _parameter(F.col("area.geocode"), ZONE_CODE, last=True),
        }
    )
    shaped = rows.where(F.col("ring").isNotNull()).select(
        F.when(F.col("zona_codigo") != "", F.concat_ws(":", "identifier", "zona_codigo"))
        .otherwise(F.col("identifier")).alias("id"),
        lookup(PHENOMENA, F.col("fenomeno_codigo")).alias("fenomeno"),
        "fenomeno_codigo", "nivel", "nivel_orden",
        text.strip("area.areaDesc").alias("zona"), "zona_codigo",
        text.strip("i.headline").alias("titular"), text.strip("i.description").alias("descripcion"),
        _parameter(F.col("i.parameter"), PROBABILITY_PARAMETER).alias("probabilidad"),
        F.col("i.onset").alias("onset"), F.col("i.expires").alias("expires"), "sent",
        F.array("ring").alias("rings"),
    )
    return conform(shaped, schema("warnings"))


def latest_warnings(warnings: DataFrame) -> DataFrame:
    """One warning per zone and phenomenon: the most serious, then the newest."""
    newest = F.coalesce(F.unix_micros(F.try_to_timestamp("sent")), F.lit(0))
    return keep_first(warnings, ["zona_codigo", "fenomeno_codigo"], [-F.col("nivel_orden"), -newest, F.col("id")])


def in_force(warnings: DataFrame, now: Column) -> DataFrame:
    """Not expired; a warning without a readable expiry stays."""
    until = F.try_to_timestamp("expires")
    return warnings.where(until.isNull() | (until >= now))
