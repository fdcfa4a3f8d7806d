"""Official incident sources: one contract, several payload shapes.

A source turns landed payloads (a DataFrame with one ``value`` text per document)
into the report schema. Parsing is ``from_json`` plus column expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import geo, text, times
from firespark.functions.text import lookup
from firespark.operators.rows import conform, empty, union_aligned
from firespark.schemas import schema

# Fragments of a free-text status, searched in this order.
STATUS_FRAGMENTS = {
    "extingu": "extinguido", "control": "controlado", "estabiliz": "estabilizado",
    "activo": "activo", "en curso": "activo", "declarado": "activo",
}
KNOWN_STATUS = tuple(C.STATUS_RANK)

# Exact status words of the emergencies feed.
EMERGENCY_STATUS = {
    "activo": "activo", "falsa alarma": "falsa_alarma", "estabilizado": "estabilizado",
    "controlado": "controlado", "extinguido": "extinguido",
}
EMERGENCY_BOX = (-7.2, 40.0, -1.5, 43.5)
INCIDENT_BOX = (-1.6, 37.8, 0.8, 40.9)
OUTSIDE_REGION = "fuera de la comunidad valenciana"
WILDLAND_BRANCHES = ("vegetación > forestal", "vegetación > rural/montañosa")
URBAN_BRANCH = "vegetación > urbana"


@dataclass(frozen=True)
class SourceMeta:
    source_id: str
    name: str
    region: str
    precision_m: float
    ttl_seconds: int = 300
    path: str = ""
    attribution: str = ""
    notes: str = ""


@dataclass(frozen=True)
class OfficialSource:
    """``parse`` maps documents to report columns; ``collect`` applies the contract."""

    meta: SourceMeta
    parse: Callable[[DataFrame], DataFrame]

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.text(self.meta.path, wholetext=True)

    def collect(self, spark: SparkSession, now: Column) -> DataFrame:
        return finalise(self.parse(self.read(spark)), self.meta, now)


def finalise(rows: DataFrame, meta: SourceMeta, now: Column) -> DataFrame:
    """Constant source, defaults for precision and time, known status, sane position."""
    shaped = conform(rows, schema("official"))
    status = F.col("status")
    return shaped.withColumns(
        {
            "source_id": F.lit(meta.source_id),
            "precision_m": F.coalesce("precision_m", F.lit(float(meta.precision_m))),
            "reported_at": F.coalesce("reported_at", now),
            "status": F.when(status.isin(*KNOWN_STATUS), status).otherwise("desconocido"),
        }
    ).where(geo.in_box(F.col("latitude"), F.col("longitude"), C.OFFICIAL_BOX))


def normalise_status(raw: Column, fragments: dict[str, str] = STATUS_FRAGMENTS) -> Column:
    return text.first_matching(raw, fragments, "desconocido")


# --- Feature collections ---------------------------------------------------------

FEATURES = (
    "struct<features:array<struct<geometry:struct<type:string,coordinates:array<double>,x:double,y:double>,"
    "properties:map<string,string>,attributes:map<string,string>>>>"
)


def features(documents: DataFrame) -> DataFrame:
    """One row per feature: ``longitude, latitude, props``; features without position go."""
    parsed = documents.select(F.from_json("value", FEATURES).alias("d"))
    rows = parsed.select(F.explode("d.features").alias("f"))
    coordinates = F.col("f.geometry.coordinates")
    placed = F.size(coordinates) > 0
    return rows.select(
        F.when(placed, coordinates[0]).otherwise(F.col("f.geometry.x")).alias("longitude"),
        F.when(placed, coordinates[1]).otherwise(F.col("f.geometry.y")).alias("latitude"),
        F.coalesce("f.properties", "f.attributes").alias("props"),
    ).where(F.col("longitude").isNotNull())


def feature_parser(
    field_map: dict[str, str], fragments: dict[str, str] = STATUS_FRAGMENTS
) -> Callable[[DataFrame], DataFrame]:
    """Parser driven by configuration: contract field to feed field."""

    def parse(documents: DataFrame) -> DataFrame:
        mapped = {dest: F.try_element_at("props", F.lit(src)) for dest, src in field_map.items()}
        rows = features(documents).withColumns(mapped)
        raw = F.col("status") if "status" in field_map else F.lit(None).cast("string")
        out = rows.withColumns({"raw_status": raw, "status": normalise_status(raw, fragments)})
        if "reported_at" in field_map:
            out = out.withColumn("reported_at", F.try_to_timestamp("reported_at"))
        if "level" in field_map:
            out = out.withColumn("level", F.col("level").try_cast("int"))
        if "precision_m" in field_map:
            out = out.withColumn("precision_m", F.col("precision_m").try_cast("double"))
        return out.drop("props")

    return parse


def missing_fields(documents: DataFrame, field_map: dict[str, str]) -> DataFrame:
    """Mapped feed fields that no record carries: the feed renamed them."""
    expected = sorted({v for v in field_map.values() if v})
    keys = features(documents).select(F.explode(F.map_keys("props")).alias("campo")).distinct()
    wanted = documents.sparkSession.createDataFrame([(c,) for c in expected], "campo string")
    return wanted.join(keys, "campo", "left_anti")


def json_parser(
    extract: Callable[[DataFrame], DataFrame], fragments: dict[str, str] = STATUS_FRAGMENTS
) -> Callable[[DataFrame], DataFrame]:
    """Any JSON feed: ``extract`` flattens documents, the status is normalised here."""

    def parse(documents: DataFrame) -> DataFrame:
        rows = extract(documents)
        return rows.withColumns(
            {"raw_status": F.col("status"), "status": normalise_status(F.col("status"), fragments)}
        )

    return parse


# --- Emergencies feed ------------------------------------------------------------

EMERGENCIES = """struct<listaEmergencias:array<struct<
    emergencia_cpm:string,emergencia_num1:bigint,emergencia_num2:bigint,estado:struct<CODIGO:int,NOMBRE:string>,
    falsa_alarma:boolean,fecha_inicio:string,huso:int,latitud:double,longitud:double,
    municipio:struct<nombre:string>,provincia:struct<nombre:string>,
    localidad:struct<nombre:string,municipio:struct<nombre:string>>,nivel_infocal:int,
    medios:array<struct<ACTUANDO:boolean,NOMBRE:string,TIPO:struct<CATEGORIA:string,NOMBRE:string>>>>>>"""


def resources_summary(units: Column) -> Column:
    """Acting units counted by type, most numerous first; ties keep feed order."""
    acting = F.filter(units, lambda m: F.coalesce(m["ACTUANDO"], F.lit(False)))
    kinds = F.transform(
        acting,
        lambda m: text.strip(F.coalesce(F.nullif(m["TIPO"]["NOMBRE"], F.lit("")), F.lit("Otros"))),
    )
    counted = F.transform(
        F.array_distinct(kinds),
        lambda kind, i: F.struct(
            (-F.size(F.filter(kinds, lambda k: k == kind))).alias("n"), i.alias("i"), kind.alias("kind")
        ),
    )
    label = F.transform(
        F.array_sort(counted),
        lambda c: F.concat((-c["n"]).cast("string"), F.lit(" "), F.lower(c["kind"])),
    )
    return F.coalesce(F.array_join(label, " · "), F.lit(""))


def emergencies(documents: DataFrame) -> DataFrame:
    """Positions come in UTM metres under the names of degrees; false alarms are dropped."""
    parsed = documents.select(F.from_json("value", " ".join(EMERGENCIES.split())).alias("d"))
    e = parsed.select(F.explode("d.listaEmergencias").alias("e")).select("e.*")
    e = e.where(~F.coalesce("falsa_alarma", F.lit(False)))
    zone = F.coalesce(F.nullif(F.col("huso"), F.lit(0)), F.lit(30))
    lat, lon = geo.utm_to_degrees(F.col("longitud"), F.col("latitud"), F.col("zone"))
    placed = (
        e.withColumn("zone", zone).where(F.col("zone").isin(29, 30, 31))
        .withColumns({"latitude": lat, "longitude": lon})
        # Six decimals (a tenth of a metre) absorb the projection's rounding at the edge of the box.
        .where(geo.in_box(F.round("latitude", 6), F.round("longitude", 6), EMERGENCY_BOX))
    )
    raw = F.coalesce("estado.NOMBRE", F.lit(""))
    town = F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("municipio.nombre", "localidad.municipio.nombre", "localidad.nombre")]
    )
    status = lookup(EMERGENCY_STATUS, F.lower(text.strip(raw)), F.lit("desconocido"))
    return placed.where(status != "falsa_alarma").select(
        F.concat_ws("-", "emergencia_cpm", "emergencia_num1", "emergencia_num2").alias("external_id"),
        "latitude", "longitude",
        times.madrid_to_utc(F.col("fecha_inicio")).alias("reported_at"),
        status.alias("status"), raw.alias("raw_status"),
        text.place_name(town).alias("municipio"),
        text.province_name(F.col("provincia.nombre")).alias("provincia"),
        F.col("nivel_infocal").alias("level"),
        resources_summary(F.col("medios")).alias("resources"),
    )


# --- Incident list ----------------------------------------------------------------

INCIDENT_LIST = """array<struct<id:long,municipio:string,direccion:string,descripcionEs:string,
    coordenadas:array<struct<x:double,y:double>>>>"""


def is_wildfire(description: Column) -> Column:
    d = F.lower(text.strip(F.coalesce(description, F.lit(""))))
    branch = F.lit(False)
    for b in WILDLAND_BRANCHES:
        branch = branch | d.contains(b)
    return d.startswith("incendio") & ~d.contains(URBAN_BRANCH) & branch


def smoke_only(description: Column) -> Column:
    return F.lower(F.coalesce(description, F.lit(""))).contains("humo")


def town_or_null(name: Column) -> Column:
    clean = text.strip(name)
    return F.when((name != "") & (F.lower(clean) != OUTSIDE_REGION), clean)


def incident_list(documents: DataFrame) -> DataFrame:
    """Wildland fires of a general incident feed, first coordinate inside the region."""
    parsed = documents.select(F.from_json("value", " ".join(INCIDENT_LIST.split())).alias("d"))
    rows = parsed.select(F.inline("d")).where(is_wildfire(F.col("descripcionEs")))
    first = F.try_element_at("coordenadas", F.lit(1))
    placed = rows.withColumns({"longitude": first["x"], "latitude": first["y"]}).where(
        geo.in_box(F.col("latitude"), F.col("longitude"), INCIDENT_BOX)
    )
    return placed.select(
        F.coalesce(F.nullif(F.col("id"), F.lit(0)).cast("string"), F.lit("")).alias("external_id"),
        "latitude", "longitude",
        F.lit(None).cast("timestamp").alias("reported_at"),
        F.lit("activo").alias("status"),
        F.col("descripcionEs").alias("raw_status"),
        town_or_null(F.col("municipio")).alias("municipio"),
        F.lit("").alias("resources"),
        text.blank_to_null(F.col("direccion")).alias("detalle"),
        smoke_only(F.col("descripcionEs")).alias("solo_humo"),
    )


# --- Registry ---------------------------------------------------------------------


@dataclass
class Registry:
    """Configured sources. An empty path means the source is not configured."""

    sources: list[OfficialSource] = field(default_factory=list)
    failures: dict[str, str] = field(default_factory=dict)

    def collect(self, spark: SparkSession, now: Column) -> DataFrame:
        """Union of the configured sources; one that cannot be planned gives no rows.

        ``failures`` keeps the reason of each for the health of the sources.
        """
        frames = []
        self.failures = {}
        for source in self.sources:
            if not source.meta.path:
                continue
            try:
                frames.append(source.collect(spark, now))
            except Exception as exc:  # noqa: BLE001 - a broken feed must not stop the others
                self.failures[source.meta.source_id] = str(exc)
        return union_aligned(frames) if frames else empty(spark, schema("official"))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (s.meta.source_id, s.meta.name, s.meta.region, float(s.meta.precision_m),
             int(s.meta.ttl_seconds), bool(s.meta.path), s.meta.attribution)
            for s in self.sources
        ]
        return spark.createDataFrame(
            rows,
            "source_id string, name string, region string, precision_m double, ttl_seconds long,"
            " configured boolean, attribution string",
        )


def official_sources(
    paths: dict[str, str] | None = None, field_maps: dict[str, dict[str, str]] | None = None
) -> Registry:
    """The five known services; ``paths`` says where each one's payloads land.

    The three map services publish under names of their own, which have to be looked up
    in the running service: without a map in ``field_maps`` such a source is not
    configured, whatever its path.
    """
    at, maps = paths or {}, field_maps or {}
    own_format = {"jcyl", "112cv"}

    def meta(sid: str, name: str, region: str, precision: float, ttl: int = 300) -> SourceMeta:
        usable = sid in own_format or bool(maps.get(sid))
        return SourceMeta(sid, name, region, precision, ttl, at.get(sid, "") if usable else "", name)

    def mapped(sid: str) -> Callable[[DataFrame], DataFrame]:
        return feature_parser(maps.get(sid) or {})

    return Registry(
        [
            OfficialSource(meta("jcyl", "Junta de Castilla y León", "Castilla y León", 500.0), emergencies),
            OfficialSource(meta("infocam", "INFOCAM / FIDIAS", "Castilla-La Mancha", 6000.0, 600), mapped("infocam")),
            OfficialSource(meta("112cv", "112 Comunitat Valenciana", "Comunitat Valenciana", 100.0), incident_list),
            OfficialSource(meta("bombers", "Bombers de la Generalitat", "Cataluña", 1500.0), mapped("bombers")),
            OfficialSource(meta("infoca", "Plan INFOCA", "Andalucía", 1500.0), mapped("infoca")),
        ]
    )
