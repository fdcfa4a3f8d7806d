"""Checks of invariants, guards, health and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark import config as C
from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.catalog.fusion import INCIDENTS
from firespark.functions import times
from firespark.operators import quality, summaries
from firespark.plans import projections as P
from firespark.plans import run
from firespark.sinks import manifest
from firespark.sources.official import official_sources

NOW = P.SQL_NOW

# Incidents broken on purpose by the last character of their id, so that every rule fails somewhere.
LAST = "ascii(right(id, 1))"
BREAK = {
    "satellite_confirmed": f"CASE WHEN {LAST} % 7 = 0 THEN false ELSE satellite_confirmed END",
    "official_confirmed": f"CASE WHEN {LAST} % 7 = 0 THEN false ELSE official_confirmed END",
    "origin": f"CASE WHEN {LAST} % 13 = 0 THEN 'otro' ELSE origin END",
    "last_detected": f"CASE WHEN {LAST} % 5 = 1 THEN first_detected - INTERVAL '1' HOUR ELSE last_detected END",
    "lat": f"CASE WHEN {LAST} % 6 = 2 THEN lat + 3e1 WHEN {LAST} % 17 = 3 THEN NULL ELSE lat END",
    "position_precision_m": f"CASE WHEN {LAST} % 9 = 3 THEN 0e0 WHEN {LAST} % 9 = 4 THEN NULL ELSE position_precision_m END",
    "n_hotspots": f"CASE WHEN {LAST} % 4 = 1 THEN 0 ELSE n_hotspots END",
    "status": f"CASE WHEN {LAST} % 8 = 4 THEN 'raro' WHEN {LAST} % 8 = 5 THEN 'extinguido' ELSE status END",
}
KEEP = ("id", "first_detected", "lon")
BROKEN_SQL = f"""{INCIDENTS}, b0 AS (SELECT {', '.join(KEEP)}, {', '.join(f'{e} AS {c}' for c, e in BREAK.items())} FROM incidents),
  broken AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE {LAST} % 11 = 5)"""
RULE_SQL = (
    (2, "incidente sin origen", "NOT (coalesce(satellite_confirmed, false) OR coalesce(official_confirmed, false))"),
    (3, "origin incoherente con los flags", "(origin = 'ambos') <> (satellite_confirmed AND official_confirmed)"),
    (3, "origin fuera del vocabulario", "origin NOT IN ('satelite', 'oficial', 'ambos')"),
    (4, "ventana temporal invertida", "first_detected > last_detected"),
    (5, "geometría fuera de España", "NOT coalesce(lat BETWEEN 27 AND 44.5 AND lon BETWEEN -19 AND 5, false)"),
    (6, "precisión no positiva", "NOT coalesce(position_precision_m > 0, false)"),
    (7, "incidente satelital sin hotspots", "coalesce(n_hotspots, 0) = 0 AND origin <> 'oficial'"),
    (8, "incendio extinguido publicado", "status = 'extinguido'"),
    (8, "status fuera del vocabulario", "status IS NOT NULL AND status NOT IN ('activo', 'estabilizado', 'controlado', 'extinguido')"),
    (9, "estado afirmado sin parte oficial", "status IS NOT NULL AND NOT official_confirmed"),
)
VIOLATIONS_SQL = " UNION ALL ".join(
    [f"SELECT {i} AS invariant, '{n}' AS name, id FROM broken WHERE {p}" for i, n, p in RULE_SQL]
    + ["SELECT 1, 'id duplicado', id FROM broken WHERE id IN (SELECT id FROM broken GROUP BY id HAVING count(*) > 1)"]
)


def _broken(spark, sf):
    base = stages.incidents(spark, sf).select(*KEEP, *[F.expr(e).alias(c) for c, e in BREAK.items()])
    return base.unionByName(base.where(F.expr(f"{LAST} % 11 = 5")))


@register("invariant_violations", S.query(f"{BROKEN_SQL}, v AS ({VIOLATIONS_SQL})", """
  SELECT a.invariant, a.name, a.n, b.sample FROM (SELECT invariant, name, count(*) AS n FROM v GROUP BY 1, 2) a
  JOIN (SELECT invariant, name, string_agg(id, ', ' ORDER BY id) AS sample FROM (
     SELECT *, row_number() OVER (PARTITION BY invariant, name ORDER BY id) AS rn FROM (
       SELECT * FROM v WHERE invariant <> 1 UNION ALL SELECT DISTINCT * FROM v WHERE invariant = 1)) WHERE rn <= 5 GROUP BY 1, 2) b
  USING (invariant, name)"""))
def invariant_violations(spark, sf):
    return quality.violations(_broken(spark, sf))


@register("invariants_hold", S.query(INCIDENTS, "SELECT 0 AS invariant, '' AS name FROM incidents WHERE false"))
def invariants_hold(spark, sf):
    return quality.violations(stages.incidents(spark, sf)).select("invariant", "name")


@register("duplicate_ids", S.query(BROKEN_SQL, """
  SELECT id, count(*) AS k FROM broken GROUP BY id HAVING count(*) > 1"""))
def duplicate_ids(spark, sf):
    return _broken(spark, sf).groupBy("id").agg(F.count("*").alias("k")).where("k > 1")


RUNS_SQL = """runs AS (SELECT strftime(time_bucket(INTERVAL 30 MINUTES, ts), '%Y-%m-%dT%H:%M:%SZ') AS "at", count(*) AS hotspots,
   count(DISTINCT user_id) AS incidents FROM events GROUP BY 1), recent AS (SELECT * FROM runs ORDER BY "at" DESC LIMIT 24)"""


def _runs(spark, sf):
    ts = F.col("ts").cast("timestamp")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 1800) * 1800)
    return P.table(spark, sf, "events").groupBy(times.iso_z(slot).alias("at")).agg(
        F.count("*").alias("hotspots"), F.count_distinct("user_id").alias("incidents")
    )


@register("run_history_last24", S.query(RUNS_SQL, 'SELECT "at", hotspots, incidents FROM recent'))
def run_history_last24(spark, sf):
    return quality.last_runs(_runs(spark, sf)).select("at", "hotspots", "incidents")


@register("run_median", S.query(RUNS_SQL, "SELECT count(*) AS ejecuciones, median(hotspots) AS mediana FROM recent"))
def run_median(spark, sf):
    return quality.median_of_runs(_runs(spark, sf))


@register("suspicious_emptiness", S.query(RUNS_SQL, """
  SELECT h.hotspots, m.mediana, m.ejecuciones, m.mediana >= 20 AND h.hotspots <= m.mediana * (1e0 - 9e-1) AS vaciado_sospechoso
  FROM (SELECT DISTINCT hotspots FROM runs) h, (SELECT count(*) AS ejecuciones, median(hotspots * 10) AS mediana FROM recent) m"""))
def suspicious_emptiness(spark, sf):
    runs = _runs(spark, sf)
    current = runs.select("hotspots").distinct()
    return quality.emptiness(current, runs.withColumn("hotspots", F.col("hotspots") * 10))


FAMILY = "CASE WHEN upper(instrument) LIKE 'VIIRS%' THEN 'firms_viirs' WHEN upper(instrument) LIKE 'MODIS%' THEN 'firms_modis' WHEN upper(instrument) LIKE 'SEVIRI%' THEN 'seviri' END"
FAMILIES_SQL = " UNION ALL ".join(
    f"SELECT '{i}' AS source_id, '{n}' AS name, {t} AS ttl, {str(c).lower()} AS critical, {m} AS max_age"
    for i, n, _, _, t, c, m in C.SENSOR_FAMILIES
)


@register("sensor_families", S.query(f"{S.CLEAN}, fam AS ({FAMILIES_SQL})", f"""
  SELECT fam.source_id, fam.name, count(c.event_id) AS records, {S.iso('max(c.acq_dt)')} AS latest
  FROM fam LEFT JOIN clean c ON fam.source_id = {FAMILY} GROUP BY 1, 2"""))
def sensor_families(spark, sf):
    return summaries.families(stages.clean(spark, sf)).select(
        "source_id", "name", "records", times.iso_z(F.col("latest_data_at")).alias("latest")
    )


AGED = f"""ages AS (SELECT {FAMILY} AS clave, max(acq_dt) AS latest FROM clean GROUP BY 1
   UNION ALL SELECT 'official', max(reported_at) FROM official),
   aged AS (SELECT clave, greatest(0, CAST(floor((epoch_us({NOW}) - epoch_us(latest)) / 1e6) AS BIGINT)) AS edad_s FROM ages)"""
AGES = f"{S.CLEAN}, {P.SQL_OFFICIAL}, {AGED}"


@register("data_ages", S.query(AGES, "SELECT clave, edad_s FROM aged"))
def data_ages(spark, sf):
    return summaries.data_ages(stages.clean(spark, sf), P.official(spark, sf), P.now())


@register("sensor_lag", S.query(S.HOT, f"""
  SELECT source, count(*) AS filas, {S.iso('max(acq_dt)')} AS mas_reciente, round_even({S.hours(NOW, 'max(acq_dt)')}, 1) AS horas,
   {S.hours(NOW, 'max(acq_dt)')} > 6 AS retrasado FROM hot GROUP BY 1"""))
def sensor_lag(spark, sf):
    return summaries.sensor_lag(P.hotspots(spark, sf), P.now())


# One health row per (source, hour of report): every state of the machine occurs.
HEALTH = f"""{P.SQL_OFFICIAL}, src AS (SELECT source_id || '-' || CAST(epoch_us(reported_at) // 3600000000 % 97 AS VARCHAR) AS source_id,
    max(reported_at) AS last_seen, count(*) AS records, min(source_id) AS base, max(CAST(external_id AS BIGINT)) AS k FROM official GROUP BY 1),
  st AS (SELECT source_id, 'Fuente ' || source_id AS name, base <> 'infoca' AS configured, CASE WHEN k % 7 = 0 THEN 'fallo' END AS error,
    last_seen AS last_success_at, last_seen - INTERVAL 2 HOURS AS latest_data_at, CASE WHEN base = '112cv' THEN 90000 ELSE 3600 END AS ttl_seconds,
    CASE WHEN base = 'bombers' THEN NULL ELSE 100000 END AS max_data_age_seconds, base = 'jcyl' AND k % 5 = 0 AS critical, records FROM src),
  ag AS (SELECT *, CAST((epoch_us({NOW}) - epoch_us(last_success_at)) / 1e6 AS BIGINT) AS age_seconds,
    CAST((epoch_us({NOW}) - epoch_us(latest_data_at)) / 1e6 AS BIGINT) AS data_age_seconds FROM st),
  health AS (SELECT *, CASE WHEN NOT configured THEN 'disabled' WHEN error IS NOT NULL THEN 'error'
    WHEN age_seconds > ttl_seconds * 3 OR coalesce(data_age_seconds > max_data_age_seconds, false) THEN 'stale' ELSE 'ok' END AS status FROM ag)"""


def _health(spark, sf):
    slot = (F.floor(F.unix_seconds("reported_at") / 3600) % 97).cast("string")
    src = (
        P.official(spark, sf).groupBy(F.concat_ws("-", "source_id", slot).alias("sid"))
        .agg(
            F.max("reported_at").alias("last_success_at"), F.count("*").alias("records"),
            F.min("source_id").alias("base"), F.max(F.col("external_id").cast("long")).alias("k"),
        )
    )
    rows = src.select(
        F.col("sid").alias("source_id"), F.concat(F.lit("Fuente "), "sid").alias("name"),
        (F.col("base") != "infoca").alias("configured"), F.when(F.col("k") % 7 == 0, "fallo").alias("error"),
        "last_success_at", (F.col("last_success_at") - F.expr("INTERVAL 2 HOURS")).alias("latest_data_at"),
        F.when(F.col("base") == "112cv", 90000).otherwise(3600).alias("ttl_seconds"),
        F.when(F.col("base") != "bombers", 100000).alias("max_data_age_seconds"),
        ((F.col("base") == "jcyl") & (F.col("k") % 5 == 0)).alias("critical"), "records",
    )
    return quality.source_health(rows, P.now())


@register("source_health_states", S.query(HEALTH, """
  SELECT source_id, status, age_seconds, data_age_seconds, CASE WHEN status = 'stale' THEN
     CASE WHEN coalesce(data_age_seconds > max_data_age_seconds, false)
       THEN 'responde, pero sin datos nuevos desde hace ' || CAST(CAST(round_even(data_age_seconds / 3.6e3, 0) AS BIGINT) AS VARCHAR) || ' h'
       ELSE 'sin respuesta correcta desde hace ' || CAST(CAST(round_even(age_seconds / 6e1, 0) AS BIGINT) AS VARCHAR) || ' min' END END AS stale_reason
  FROM health"""))
def source_health_states(spark, sf):
    return _health(spark, sf).select("source_id", "status", "age_seconds", "data_age_seconds", "stale_reason")


@register("source_health_registry", S.query(f"""{P.SQL_OFFICIAL}, reg AS (SELECT unnest(['jcyl','infocam','112cv','bombers','infoca']) AS source_id),
  n AS (SELECT source_id, count(*) AS records FROM official WHERE source_id <> '112cv' GROUP BY 1)""", """
  SELECT source_id, source_id IN ('jcyl', '112cv', 'bombers') AS configured, coalesce(records, 0) AS records,
    CASE WHEN source_id IN ('infocam', 'infoca') THEN 'disabled' WHEN coalesce(records, 0) = 0 THEN 'error' ELSE 'ok' END AS status,
    CASE WHEN source_id IN ('jcyl', '112cv', 'bombers') AND records IS NULL THEN 'sin datos' END AS error FROM reg LEFT JOIN n USING (source_id)"""))
def source_health_registry(spark, sf):
    """A configured silent source is in error; one without path or without field map is disabled."""
    registry = official_sources(
        {sid: f"landed/{sid}" for sid in ("jcyl", "112cv", "bombers", "infoca")}, {"bombers": {"external_id": "id"}}
    )
    reports = P.official(spark, sf).where("source_id <> '112cv'").withColumn("match_distance_m", F.lit(None).cast("double"))
    states = quality.source_health(run.official_states(registry, reports, P.now()), P.now())
    return states.select("source_id", "configured", "records", "status", "error")


@register("health_ordering", S.query(HEALTH, """
  SELECT source_id, status FROM health ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'stale' THEN 1 WHEN 'disabled' THEN 2 ELSE 3 END, name"""))
def health_ordering(spark, sf):
    return _health(spark, sf).orderBy(*quality.health_order()).select("source_id", "status")


@register("degraded_reasons", S.query(HEALTH, """
  SELECT true AS degraded, 'fuentes críticas sin datos recientes: ' || string_agg(name || ' (' || status || ')', ', ' ORDER BY name || ' (' || status || ')')
    || '; el dato más antiguo tiene ' || printf('%.1f', (SELECT max(data_age_seconds) / 3.6e3 FROM health)) || ' h (umbral: 4 h)' AS degraded_reason
  FROM health WHERE critical AND status IN ('error', 'stale')"""))
def degraded_reasons(spark, sf):
    health = _health(spark, sf)
    worst = health.agg(F.max("data_age_seconds").alias("worst"))
    return quality.degraded(health, worst)


@register("registry_left_join", S.query(f"{P.SQL_OFFICIAL}, reg AS (SELECT unnest(['jcyl','infocam','112cv','bombers','infoca','ninguna']) AS source_id)", """
  SELECT r.source_id, count(o.external_id) AS records, coalesce(sum(o.precision_m), 0) AS precision_sum FROM reg r LEFT JOIN
   (SELECT * FROM official WHERE source_id <> 'infoca') o USING (source_id) GROUP BY 1"""))
def registry_left_join(spark, sf):
    registry = official_sources().table(spark).select("source_id").unionByName(
        spark.createDataFrame([("ninguna",)], "source_id string")
    )
    rows = P.official(spark, sf).where("source_id <> 'infoca'").groupBy("source_id").agg(
        F.count("*").alias("records"), F.sum("precision_m").alias("precision_sum")
    )
    return registry.join(rows, "source_id", "left").select(
        "source_id", F.coalesce("records", F.lit(0)).cast("long").alias("records"),
        F.coalesce("precision_sum", F.lit(0.0)).alias("precision_sum"),
    )


@register("manifest", S.query(f"{INCIDENTS}, {AGED}", f"""
  SELECT 1 AS schema_version, {S.iso(NOW)} AS generated_at, (SELECT max(edad_s) FROM aged) AS worst_data_age_seconds,
    (SELECT string_agg(clave || '=' || CAST(edad_s AS VARCHAR), ',' ORDER BY clave) FROM aged) AS data_age_seconds,
    count(*) AS incidents_total, count(*) FILTER (satellite_confirmed) AS incidents_satellite_confirmed,
    count(*) FILTER (official_confirmed AND NOT satellite_confirmed) AS incidents_official_only, (SELECT count(*) FROM clean) AS hotspots_24h,
    round(sum(frp_total_mw), 1) AS frp_total_mw, (SELECT max(edad_s) FROM aged) > 14400 AS degraded FROM incidents"""))
def manifest_row(spark, sf):
    m = manifest.build_manifest(
        stages.clean(spark, sf), stages.incidents(spark, sf), P.official(spark, sf), P.now()
    )
    ages = F.array_join(
        F.transform(F.array_sort(F.map_entries("data_age_seconds")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))),
        ",",
    )
    return m.select(
        "schema_version", "generated_at", "worst_data_age_seconds", ages.alias("data_age_seconds"),
        "counts.incidents_total", "counts.incidents_satellite_confirmed", "counts.incidents_official_only",
        "counts.hotspots_24h", "frp_total_mw", "degraded",
    )


@register("manifest_legacy", S.query(S.FIRES, f"""
  SELECT (SELECT count(*) FROM clean) AS hotspots, {S.iso('(SELECT max(acq_dt) FROM clean)')} AS last_detection_at,
    CAST((epoch_us({NOW}) - (SELECT max(epoch_us(acq_dt)) FROM clean)) / 6e7 AS BIGINT) AS data_age_minutes, count(*) AS fires_total,
    count(*) FILTER (status = 'activo') AS fires_active, round(sum(frp_total_mw), 2) AS frp_total_mw FROM fires"""))
def manifest_legacy(spark, sf):
    m = manifest.legacy_manifest(stages.clean(spark, sf), stages.fires(spark, sf), P.now())
    return m.select(
        "hotspots", "last_detection_at", "data_age_minutes", "fires_total", "fires_active",
        F.round("frp_total_mw", 2).alias("frp_total_mw"),
    )
