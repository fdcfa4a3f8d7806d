"""Vocabulary of the fire domain as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions.text import fixed3, lookup

# 16-point compass in Spanish.
COMPASS = (
    "N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE",
    "S", "SSO", "SO", "OSO", "O", "ONO", "NO", "NNO",
)

# European air-quality bands, upper bound exclusive.
AIR_BANDS = ((20, "buena"), (40, "aceptable"), (60, "moderada"), (80, "desfavorable"), (100, "mala"))
AIR_WORST = "muy mala"

# Warning levels.
WARNING_ORDER = {"verde": 0, "amarillo": 1, "naranja": 2, "rojo": 3}

# Land-cover code to class name and type.
LAND_COVER = {
    "211": ("Cultivo herbáceo de secano", "agrícola"),
    "212": ("Cultivo herbáceo de regadío", "agrícola"),
    "213": ("Arrozal", "agrícola"),
    "221": ("Viñedo", "agrícola"),
    "222": ("Frutal", "agrícola"),
    "223": ("Olivar", "agrícola"),
    "231": ("Pradera", "agrícola"),
    "241": ("Cultivo anual con permanente", "agrícola"),
    "242": ("Mosaico de cultivos", "agrícola"),
    "243": ("Cultivo con vegetación natural", "agrícola"),
    "244": ("Sistema agroforestal", "agrícola"),
    "311": ("Bosque de frondosas", "forestal"),
    "312": ("Bosque de coníferas", "forestal"),
    "313": ("Bosque mixto", "forestal"),
    "321": ("Pastizal natural", "forestal"),
    "322": ("Landas y matorral", "forestal"),
    "323": ("Matorral esclerófilo", "forestal"),
    "324": ("Matorral boscoso de transición", "forestal"),
    "331": ("Playas y dunas", "otro"),
    "332": ("Roquedo", "otro"),
    "333": ("Espacios con vegetación escasa", "forestal"),
    "334": ("Zonas quemadas", "forestal"),
    "335": ("Glaciares y nieves", "otro"),
}
LAND_COVER_LEVEL_1 = {
    "1": ("Superficie artificial", "urbano"),
    "2": ("Superficie agrícola", "agrícola"),
    "3": ("Superficie forestal o seminatural", "forestal"),
    "4": ("Zona húmeda", "otro"),
    "5": ("Superficie de agua", "otro"),
}

# Satellite product to instrument family.
SENSOR_FAMILY = {
    "VIIRS_SNPP_NRT": "VIIRS", "VIIRS_NOAA20_NRT": "VIIRS", "VIIRS_NOAA21_NRT": "VIIRS",
    "MODIS_NRT": "MODIS", "SEVIRI_FRP_PIXEL": "SEVIRI",
}

# Display label of a declared status.
STATUS_LABEL = {
    "activo": "Activo", "estabilizado": "Estabilizado", "controlado": "Controlado",
    "extinguido": "Extinguido",
}


def compass(deg: Column) -> Column:
    index = F.floor(F.pmod(deg.cast("double"), F.lit(360.0)) / 22.5 + 0.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(p) for p in COMPASS]), index + 1)


def wind_towards(from_deg: Column) -> Column:
    return F.pmod(from_deg.cast("double") + 180.0, F.lit(360.0))


def air_band(aqi: Column) -> Column:
    chain = F.when(aqi.isNull() | F.isnan(aqi.cast("double")), F.lit(""))
    for bound, label in AIR_BANDS:
        chain = chain.when(aqi < bound, F.lit(label))
    return chain.otherwise(F.lit(AIR_WORST))


def intensity(frp_total: Column) -> Column:
    return (
        F.when(frp_total <= 50, "baja")
        .when(frp_total <= 200, "media")
        .when(frp_total <= 800, "alta")
        .when(frp_total.isNotNull(), "extrema")
    )


def activity(hours_since_last: Column) -> Column:
    return F.when(hours_since_last <= C.ACTIVE_WINDOW_HOURS, "activo").otherwise("inactivo")


def estimated_area_ha(n_hotspots: Column) -> Column:
    return F.bround(n_hotspots * F.lit(C.HECTARES_PER_HOTSPOT), 0)


def fire_id(lat: Column, lon: Column, start: Column) -> Column:
    text = F.concat_ws("|", fixed3(lat), fixed3(lon), F.date_format(start, "yyyy-MM-dd"))
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 10)


def orphan_id(source_id: Column, external_id: Column) -> Column:
    return F.concat(F.lit("off_"), source_id, F.lit("_"), external_id)


def sensor_precision_m(sensors: Column) -> Column:
    """Best sensor wins: one VIIRS sighting is enough for its pixel size."""
    return F.when(
        F.upper(F.coalesce(sensors, F.lit(""))).contains("VIIRS"), F.lit(C.VIIRS_PRECISION_M)
    ).otherwise(F.lit(C.OTHER_SENSOR_PRECISION_M))


def match_tolerance_m(precision_m: Column) -> Column:
    return F.least(precision_m + C.MATCH_SLACK_M, F.lit(C.MATCH_MAX_M))


def passes_confidence(instrument: Column, raw: Column, pct: Column) -> Column:
    viirs = F.coalesce(F.upper(instrument).startswith("VIIRS"), F.lit(False))
    word = F.coalesce(F.lower(F.trim(raw)).isin(*C.VIIRS_ACCEPTED), F.lit(False))
    level = F.coalesce(pct >= C.MODIS_MIN_CONFIDENCE, F.lit(False))
    return F.when(viirs, word).otherwise(level)


def confidence_pct(raw: Column) -> Column:
    """Category or number to 0-100; anything else is null."""
    category = lookup(C.CONFIDENCE_PCT, F.lower(F.trim(raw)))
    return F.coalesce(category.cast("double"), raw.try_cast("double"))


def land_cover_class(code: Column) -> Column:
    key = F.trim(code)
    exact = lookup({k: v[0] for k, v in LAND_COVER.items()}, key)
    coarse = lookup({k: v[0] for k, v in LAND_COVER_LEVEL_1.items()}, F.substring(key, 1, 1))
    return F.coalesce(exact, coarse)


def land_cover_type(code: Column) -> Column:
    key = F.trim(code)
    exact = lookup({k: v[1] for k, v in LAND_COVER.items()}, key)
    coarse = lookup({k: v[1] for k, v in LAND_COVER_LEVEL_1.items()}, F.substring(key, 1, 1))
    return F.coalesce(exact, coarse)


def warning_order(level: Column) -> Column:
    return lookup(WARNING_ORDER, F.lower(level)).cast("int")


def latency_class(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull(), "nulo")
        .when(seconds < 3600, "ok")
        .when(seconds <= 14_400, "warn")
        .otherwise("bad")
    )


def status_text(status: Column, seen_hours_ago: Column) -> Column:
    declared = lookup(STATUS_LABEL, status, F.lit("Estado no facilitado"))
    return (
        F.when(F.coalesce(status, F.lit("")) != "", declared)
        .when(seen_hours_ago.isNull(), "Sin estado declarado")
        .when(seen_hours_ago < 1, "Calor detectado hace menos de 1 h")
        .otherwise(
            F.concat(
                F.lit("Calor detectado hace "),
                F.floor(seen_hours_ago + 0.5).cast("string"),
                F.lit(" h"),
            )
        )
    )


def sensor_families(sensors: Column) -> Column:
    """Distinct families in first-seen order, or a dash."""
    parts = F.filter(F.transform(F.split(sensors, ","), lambda s: F.trim(s)), lambda s: s != "")
    families = F.array_distinct(
        F.transform(parts, lambda s: lookup(SENSOR_FAMILY, s, s))
    )
    return F.when(F.size(families) > 0, F.array_join(families, " · ")).otherwise("—")


def sensor_resolution(sensors: Column) -> Column:
    seen = sensor_families(sensors)
    return (
        F.when(seen.contains("VIIRS"), "375 m")
        .when(seen.contains("SEVIRI"), "3 km")
        .when(seen.contains("MODIS"), "1 km")
    )


def exposure_class(distance_km: Column, downwind: Column, near_km: float) -> Column:
    return (
        F.when(distance_km.isNull() | (distance_km > near_km), "lejos")
        .when(downwind.isNull(), "duda")
        .when(downwind, "alta")
        .otherwise("media")
    )
