"""Interactive questions over incidents, detections and the user's own points."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, geo, text, times
from firespark.functions.text import lookup
from firespark.operators.grids import SPHERE, chord_km, with_sphere
from firespark.operators.quadtree import nearest
from firespark.session import materialise

MIN_CONFIDENCE = {"todas": 0.0, "media": 50.0, "alta": 80.0}
TOP_INCIDENTS = 100
TOP_ASSETS = 50
TOP_PLACES = 8
MIN_QUERY = 2
EARTH_KM = 20_100.0


def _since(now: Column, days: int) -> Column:
    return now - F.expr(f"INTERVAL {int(days)} DAYS")


def filter_incidents(incidents: DataFrame, now: Column, days: int, origin: str = "todos") -> DataFrame:
    """Seen within the period; optionally only official or only satellite-confirmed ones."""
    out = incidents.where(F.col("last_detected") >= _since(now, days))
    if origin == "oficial":
        out = out.where("official_confirmed")
    elif origin == "satelite":
        out = out.where("satellite_confirmed")
    return out


def filter_hotspots(
    hotspots: DataFrame, now: Column, days: int, confidence: str, sensors: tuple[str, ...],
    day: str | None = None,
) -> DataFrame:
    """Period, minimum confidence (null counts as 0) and sensors (null counts as VIIRS)."""
    kept = F.coalesce(F.col("instrument"), F.lit("VIIRS")).isin(*sensors) if sensors else F.lit(False)
    out = hotspots.where(
        (F.col("acq_dt") >= _since(now, days))
        & (F.coalesce(F.col("confidence_pct"), F.lit(0.0)) >= MIN_CONFIDENCE[confidence])
        & kept
    )
    if day is not None:
        out = out.where(F.to_date("acq_dt") == F.lit(day).cast("date"))
    return out


def keep_ids(df: DataFrame, ids: DataFrame | None, column: str = "id") -> DataFrame:
    """Semi-join with a result set; no result set keeps everything."""
    return df if ids is None else df.join(ids.select(column).distinct(), column, "left_semi")


@dataclass(frozen=True)
class Question:
    """A predicate and the fields without which it cannot be answered."""

    id: str
    predicate: str
    required: tuple[str, ...]


STRONG_WIND_KMH = 20
NEAR_TOWN_KM = 2

QUESTIONS = (
    Question(
        "monte-cerca-viento",
        f"suelo_tipo = 'forestal' AND nucleo_cercano_km <= {NEAR_TOWN_KM} AND viento_kmh >= {STRONG_WIND_KMH}",
        ("suelo_tipo", "nucleo_cercano_km", "viento_kmh"),
    ),
    Question(
        "monte-cerca",
        f"suelo_tipo = 'forestal' AND nucleo_cercano_km <= {NEAR_TOWN_KM}",
        ("suelo_tipo", "nucleo_cercano_km"),
    ),
    Question("bajo-aviso", "aviso_nivel <> ''", ("aviso_nivel",)),
    Question("confirmado", "official_confirmed", ()),
    Question("probable-agricola", "suelo_tipo = 'agrícola' AND NOT official_confirmed", ("suelo_tipo",)),
)


def answer(question: Question) -> Column:
    """'si', 'no' or 'sin_dato': not knowing is not a no."""
    unknown = F.lit(False)
    for c in question.required:
        unknown = unknown | F.col(c).isNull()
    return (
        F.when(unknown, "sin_dato")
        .when(F.coalesce(F.expr(question.predicate), F.lit(False)), "si")
        .otherwise("no")
    )


def ask(incidents: DataFrame, question: Question) -> DataFrame:
    """Incidents that satisfy the question."""
    return incidents.where(answer(question) == "si")


def ask_all(incidents: DataFrame, questions: tuple[Question, ...] = QUESTIONS) -> DataFrame:
    """``(pregunta, cumplen, sin_dato)`` for every question in one pass."""
    counts = []
    for i, q in enumerate(questions):
        counts += [
            F.count_if(answer(q) == "si").alias(f"y{i}"), F.count_if(answer(q) == "sin_dato").alias(f"u{i}")
        ]
    one = incidents.agg(*counts)
    rows = F.array(
        *[
            F.struct(F.lit(q.id).alias("pregunta"), F.col(f"y{i}").alias("cumplen"), F.col(f"u{i}").alias("sin_dato"))
            for i, q in enumerate(questions)
        ]
    )
    return one.select(F.inline(rows))


def severity_order() -> list[Column]:
    """Declared status first, by gravity; then the most recent; then the most powerful."""
    declared = F.coalesce(F.col("status"), F.lit("")) != ""
    rank = F.coalesce(lookup(C.STATUS_ORDER, F.col("status")), F.lit(9))
    seen = F.coalesce(F.col("ultima_observacion_h"), F.lit(1e9))
    return [
        F.when(declared, 0).otherwise(1).asc(),
        F.when(declared, rank.cast("double")).otherwise(seen).asc(),
        F.coalesce(F.col("frp_total_mw"), F.lit(0.0)).desc(),
        F.col("id").asc(),
    ]


def rank_incidents(incidents: DataFrame, limit: int | None = TOP_INCIDENTS) -> DataFrame:
    ordered = incidents.orderBy(*severity_order())
    return ordered if limit is None else ordered.limit(limit)


def exposure(assets: DataFrame, incidents: DataFrame) -> DataFrame:
    """Nearest incident of every asset and whether the wind blows towards the asset.

    ``assets(asset_id, nombre, lat, lon)``. The tree stands on the sphere, so it works at
    any latitude and as far as the other side of the earth. Assets on one spot ask once.
    """
    sites = with_sphere(
        incidents.select(
            "id", F.col("lat").alias("ilat"), F.col("lon").alias("ilon"), "viento_hacia_deg"
        ),
        "ilat", "ilon",
    )
    spots = materialise(with_sphere(assets.select("lat", "lon").distinct(), "lat", "lon")).withColumn("_pid", F.concat_ws("|", "lat", "lon"))
    told = ["id", "ilat", "ilon", "viento_hacia_deg"]
    found = nearest(spots, sites, "_pid", told, chord_km(EARTH_KM), SPHERE)
    at = spots.select("_pid", "lat", "lon").join(found, "_pid").select("lat", "lon", *told)
    a_lat, a_lon, b_lat, b_lon = F.col("lat"), F.col("lon"), F.col("ilat"), F.col("ilon")
    towards = geo.angle_between(F.col("viento_hacia_deg"), geo.bearing_deg(b_lat, b_lon, a_lat, a_lon))
    joined = assets.join(at, ["lat", "lon"], "left")
    return joined.select(
        *assets.columns,
        F.col("id").alias("incendio"),
        geo.haversine_km(a_lat, a_lon, b_lat, b_lon).alias("distancia_km"),
        (towards <= C.DOWNWIND_ARC_DEG).alias("a_sotavento"),
    )


def exposure_rank() -> Column:
    """Kilometres, halved when the asset is downwind."""
    d = F.col("distancia_km")
    return F.when(F.coalesce(F.col("a_sotavento"), F.lit(False)), d / 2.0).otherwise(d)


def rank_exposure(exposed: DataFrame, limit: int | None = TOP_ASSETS) -> DataFrame:
    ordered = exposed.orderBy(exposure_rank().asc_nulls_last(), "nombre", "asset_id")
    return ordered if limit is None else ordered.limit(limit)


def classify_exposure(exposed: DataFrame, near_km: float = C.NEAR_ASSET_KM) -> DataFrame:
    return exposed.withColumn(
        "clase", domain.exposure_class(F.col("distancia_km"), F.col("a_sotavento"), near_km)
    )


def search_index(settlements: DataFrame) -> DataFrame:
    """Name, position to four decimals and whole population, largest first."""
    people = F.coalesce(F.col("habitantes").try_cast("long"), F.lit(0)).cast("long")
    return (
        settlements.where(F.col("nombre") != "")
        .select(
            "nombre", F.bround("latitude", 4).alias("lat"), F.bround("longitude", 4).alias("lon"),
            people.alias("habitantes"),
        )
        .orderBy(F.desc("habitantes"), "nombre")
    )


def search(index: DataFrame, query: str, limit: int = TOP_PLACES) -> DataFrame:
    """Accent-insensitive: names starting with the query, then names containing it."""
    needle = text.fold(F.lit(query))
    name = text.fold(F.col("nombre"))
    rank = F.when(name.startswith(needle), 0).when(name.contains(needle), 1)
    return (
        index.withColumn("_rank", rank)
        .where(F.col("_rank").isNotNull() & (F.length(needle) >= MIN_QUERY))
        .orderBy("_rank", F.desc("habitantes"), "nombre", "lat", "lon")
        .limit(limit)
        .drop("_rank")
    )


def web_incidents(incidents: DataFrame, now: Column) -> DataFrame:
    """Published form: ISO dates, equivalent radius and hours since last seen."""
    return incidents.withColumns(
        {
            "radio_est_km": F.bround(geo.circle_radius_km(F.col("area_est_ha")), 1),
            "ultima_observacion_h": F.bround(times.hours_between(now, F.col("last_detected")), 1),
            **{c: times.iso_z(F.col(c)) for c in ("first_detected", "last_detected", "started_at")},
        }
    )
