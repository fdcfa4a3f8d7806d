"""Deterministic projections of the given tables onto the fire schemas.

The given tables hold no detections, so each operator is checked on a projection
of them: events become detections, orders official reports, suppliers mask sites
and areas, customers settlements and assets, parts road closures. The column
expressions are plain SQL that both engines read the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.session import use_utc

NOW = "2024-01-31 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def lat_of(u: str) -> str:
    return (
        f"(CASE WHEN ({u}) % 15 = 0 THEN 2.8e1 + ((({u}) * 37) % 10) / 1e1"
        f" ELSE 3.65e1 + ((({u}) * 37) % 70) / 1e1 END)"
    )


def lon_of(u: str) -> str:
    return (
        f"(CASE WHEN ({u}) % 15 = 0 THEN -1.75e1 + ((({u}) * 53) % 30) / 1e1"
        f" ELSE -8.5e0 + ((({u}) * 53) % 110) / 1e1 END)"
    )


_U = "user_id - user_id % 3"

HOTSPOTS = {
    "event_id": "event_id",
    "latitude": f"{lat_of(_U)} + (((event_id * 7919) % 10) - 5) * 2e-3",
    "longitude": f"{lon_of(_U)} + (((event_id * 6101) % 11) - 5) * 2e-3",
    "satellite": "CASE WHEN event_type IN ('signup', 'error') THEN 'Terra' ELSE 'N' END",
    "instrument": "CASE WHEN event_type IN ('signup', 'error') THEN 'MODIS' ELSE 'VIIRS' END",
    "source": (
        "CASE WHEN event_type IN ('signup', 'error') THEN 'MODIS_NRT'"
        " WHEN event_type = 'click' THEN 'VIIRS_NOAA20_NRT'"
        " WHEN event_type = 'view' THEN 'VIIRS_SNPP_NRT' ELSE 'VIIRS_NOAA21_NRT' END"
    ),
    "area_key": f"CASE WHEN ({_U}) % 15 = 0 THEN 'canarias' ELSE 'peninsula' END",
    "confidence_raw": (
        "CASE WHEN event_type IN ('signup', 'error') THEN CAST(event_id % 100 AS STRING)"
        " WHEN event_id % 10 = 0 THEN 'l' WHEN event_id % 10 <= 6 THEN 'n' ELSE 'h' END"
    ),
    "confidence_pct": (
        "CAST(CASE WHEN event_type IN ('signup', 'error') THEN event_id % 100"
        " WHEN event_id % 10 = 0 THEN 20 WHEN event_id % 10 <= 6 THEN 60 ELSE 90 END AS DOUBLE)"
    ),
    "brightness_k": "3e2 + value / 1e1",
    "frp_mw": "value",
    "daynight": "CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'N' END",
    "scan": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE 3.9e-1 END",
    "track": "3.6e-1",
}

PASS_SECONDS = 21_600

_C = "3 * (o_custkey % 50)"
OFFICIAL = {
    "source_id": (
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '112cv' WHEN '2' THEN 'jcyl'"
        " WHEN '3' THEN 'bombers' WHEN '4' THEN 'infoca' ELSE 'infocam' END"
    ),
    "external_id": "CAST(o_orderkey AS STRING)",
    "latitude": f"{lat_of(_C)} + (((o_orderkey * 31) % 100) - 50) / 1e3",
    "longitude": f"{lon_of(_C)} + (((o_orderkey * 17) % 100) - 50) / 1e3",
    "precision_m": (
        "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1e2 WHEN '2' THEN 5e2"
        " WHEN '5' THEN 6e3 ELSE 1.5e3 END"
    ),
    "status": "CASE o_orderstatus WHEN 'O' THEN 'activo' WHEN 'P' THEN 'controlado' ELSE 'extinguido' END",
    "municipio": "concat('Municipio ', CAST(o_custkey % 50 AS STRING))",
    "provincia": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Provincia ', CAST(o_custkey % 7 AS STRING)) END",
    "level": "CAST(o_orderkey % 3 AS INT)",
    "resources": (
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN ' '"
        " ELSE concat(CAST(o_orderkey % 4 + 1 AS STRING), ' brigada') END"
    ),
    "raw_status": "o_orderstatus",
    "detalle": "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE concat('Paraje ', CAST(o_orderkey % 11 AS STRING)) END",
}

_K = "3 * (c_custkey % 50)"
SETTLEMENTS = {
    "codigo": "c_custkey",
    "nombre": "c_name",
    "latitude": f"{lat_of(_K)} + (((c_custkey * 31) % 100) - 50) / 1e3",
    "longitude": f"{lon_of(_K)} + (((c_custkey * 17) % 100) - 50) / 1e3",
    "habitantes": "CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END AS BIGINT)",
    "tipo": "c_mktsegment",
}

_P = "3 * (p_partkey % 50)"
CLOSURES = {
    "id": "p_partkey",
    "latitude": f"{lat_of(_P)} + (((p_partkey * 31) % 100) - 50) / 1e3",
    "longitude": f"{lon_of(_P)} + (((p_partkey * 17) % 100) - 50) / 1e3",
    "carretera": "CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand END",
    "pk": "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS STRING) END",
    "por_incendio": "(p_type = 'ECONOMY')",
}

_S = "3 * (s_suppkey % 50)"
MASK = {
    "name": "s_name",
    "kind": "'industria'",
    "latitude": f"{lat_of(_S)} + (((s_suppkey * 31) % 100) - 50) / 1e3",
    "longitude": f"{lon_of(_S)} + (((s_suppkey * 17) % 100) - 50) / 1e3",
}

# Diamond-shaped areas around supplier places: |dx| / a + |dy| / b < 1.
AREA_HALF_WIDTH = "2.1237e-1 + (s_suppkey % 4) * 3.0171e-1"
AREA_HALF_HEIGHT = "1.7139e-1 + (s_suppkey % 3) * 2.0333e-1"
AREAS = {
    "area_id": "s_suppkey",
    "name": "s_name",
    "provincia": "concat('Provincia ', CAST(s_nationkey AS STRING))",
    "level": "CAST(s_suppkey % 4 AS INT)",
    "code": (
        "CASE s_suppkey % 7 WHEN 0 THEN '311' WHEN 1 THEN '211' WHEN 2 THEN '112'"
        " WHEN 3 THEN '323' WHEN 4 THEN '412' WHEN 5 THEN ' 312 ' ELSE '999' END"
    ),
    "clon": f"{lon_of(_S)} + (((s_suppkey * 13) % 10) - 5) * 7.3e-2",
    "clat": f"{lat_of(_S)} + (((s_suppkey * 29) % 10) - 5) * 6.1e-2",
    "hw": AREA_HALF_WIDTH,
    "hh": AREA_HALF_HEIGHT,
}


def _project(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    return df.selectExpr(*keep, *[f"{e} AS {name}" for name, e in columns.items()])


def hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    floored = F.timestamp_seconds(
        F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / PASS_SECONDS) * PASS_SECONDS
    )
    return _project(table(spark, sf_dir, "events").withColumn("acq_dt", floored), HOTSPOTS, "acq_dt")


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("o_orderkey") % 720) * 3600)
    rows = table(spark, sf_dir, "orders")
    return _project(rows.withColumn("reported_at", reported), OFFICIAL, "reported_at")


def settlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "customer"), SETTLEMENTS)


def closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "part"), CLOSURES)


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project(table(spark, sf_dir, "supplier"), MASK)


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygon layer: one diamond per supplier, as an array of closed rings."""
    rows = _project(table(spark, sf_dir, "supplier"), AREAS)

    def corner(dx: str, dy: str) -> str:
        return f"struct(clon + ({dx}) AS x, clat + ({dy}) AS y)"

    ring = ", ".join(
        corner(dx, dy) for dx, dy in (("-hw", "0e0"), ("0e0", "hh"), ("hw", "0e0"), ("0e0", "-hh"), ("-hw", "0e0"))
    )
    return rows.withColumn("rings", F.expr(f"array(array({ring}))"))


# --- The same projections for the reference engine of the checks ---------------


def _sql_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{e.replace('AS STRING', 'AS VARCHAR')} AS {n}" for n, e in columns.items())


SQL_HOT = (
    f"hot AS (SELECT time_bucket(INTERVAL 6 HOURS, ts) AS acq_dt, {_sql_list(HOTSPOTS)} FROM events)"
)
SQL_OFFICIAL = (
    "official AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o_orderkey % 720 AS BIGINT))"
    f" AS reported_at, {_sql_list(OFFICIAL)} FROM orders)"
)
SQL_SETTLEMENTS = f"settlements AS (SELECT {_sql_list(SETTLEMENTS)} FROM customer)"
SQL_CLOSURES = f"closures AS (SELECT {_sql_list(CLOSURES)} FROM part)"
SQL_MASK = f"mask AS (SELECT {_sql_list(MASK)} FROM supplier)"
SQL_AREAS = f"areas AS (SELECT {_sql_list(AREAS)} FROM supplier)"
SQL_NOW = f"TIMESTAMP '{NOW}'"
