"""Checks of the composed run and of the reconciliation of what it published."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.catalog.feeds import scratch
from firespark.catalog.fusion import INCIDENTS
from firespark.operators import hull, quality, summaries
from firespark.plans import projections as P
from firespark.plans import verify
from firespark.sinks import features as geojson
from firespark.sinks import history, manifest, publish
from firespark.sources import hotspots as hotspot_source


RUN_ID = "20240131T000000Z"


def _published(spark, sf, root: str, broken: bool = False) -> str:
    """A whole run under ``root``; a broken one has a detection at sea, an incident twice and a manifest that counts one more."""
    burned, fires, incidents = stages.burned(spark, sf), stages.fires(spark, sf), stages.incidents(spark, sf)
    told = manifest.build_manifest(burned, incidents, None, P.now(), summaries.discards(P.hotspots(spark, sf), P.mask(spark, sf), None))
    if broken:
        first = burned.orderBy("event_id").limit(1)
        burned = burned.unionByName(first.withColumn("longitude", F.lit(-40.0)))
        incidents = incidents.unionByName(incidents.orderBy("id").limit(1))
        counts = F.col("counts")
        told = told.withColumns({
            "counts": counts.withField("hotspots_24h", counts["hotspots_24h"] + 2), "worst_data_age_seconds": F.col("worst_data_age_seconds") + 121,
        })
    point = geojson.point_geometry
    states = spark.createDataFrame([("sensor", "ok"), ("otra", "error" if broken else "ok")], "name string, status string")
    steps = [
        ("hotspots", lambda p: geojson.write_features(burned, p, geojson.HOTSPOT_FIELDS, point("latitude", "longitude"))),
        ("fires", lambda p: geojson.write_features(fires, p, geojson.FIRE_FIELDS, point("lat", "lon"))),
        ("perimeters", lambda p: geojson.write_features(hull.build_perimeters(stages.burned(spark, sf)), p, geojson.PERIMETER_FIELDS, geojson.polygon_geometry("rings"))),
        ("incidents", lambda p: geojson.write_features(incidents, p, tuple(incidents.columns), point("lat", "lon"))),
        ("sources", lambda p: geojson.write_json(states, p)),
        ("legacy", lambda p: geojson.write_json(manifest.legacy_manifest(burned, fires, P.now()), p)),
        ("manifest", lambda p: geojson.write_json(told, p)),
    ]
    publish.publish(spark, root, RUN_ID, steps)
    return root


@register("published_run", S.query(INCIDENTS, """
  SELECT 'hotspots' AS capa, count(*) AS n FROM burned UNION ALL SELECT 'incidents', count(*) FROM incidents
  UNION ALL SELECT 'fires', count(*) FROM fires UNION ALL SELECT 'perimeters', count(DISTINCT fire_id) FROM burned
  UNION ALL SELECT 'history', count(*) FROM burned UNION ALL SELECT 'legacy', count(*) FROM fires"""))
def published_run(spark, sf):
    """Lines of every layer of a run, the rows of its history, and the fires that the older manifest tells."""
    root = _published(spark, sf, scratch(spark, "publish"))
    current = publish.current_run(spark, root)
    kept = stages.burned(spark, sf).drop("fire_id")
    for _ in range(2):
        history.append_history(kept, f"{root}/history")
    parts = [
        spark.read.text(f"{current}/{name}").agg(F.count("*").alias("n")).withColumn("capa", F.lit(name))
        for name in ("hotspots", "fires", "incidents", "perimeters")
    ]
    parts += [
        history.read_history(spark, f"{root}/history").agg(F.count("*").alias("n")).withColumn("capa", F.lit("history")),
        spark.read.schema("fires_total long").json(f"{current}/legacy").select(F.col("fires_total").alias("n"), F.lit("legacy").alias("capa")),
    ]
    return reduce(DataFrame.unionByName, parts).select("capa", "n")


@register("perimeter_features")
def perimeter_features(spark, sf):
    made = hull.build_perimeters(stages.burned(spark, sf))
    return geojson.features(made, geojson.PERIMETER_FIELDS, geojson.polygon_geometry("rings"))


@register("raw_snapshot", S.query(S.HOT, "SELECT source, count(*) AS n FROM hot GROUP BY 1"))
def raw_snapshot(spark, sf):
    path = hotspot_source.snapshot(P.hotspots(spark, sf), scratch(spark, "raw"), "20240131T000000Z")
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"))


OLDEST = """(SELECT CAST(max((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - m) / 1e6) AS BIGINT) FROM
  (SELECT max(epoch_us(date_trunc('second', acq_dt))) AS m FROM burned GROUP BY instrument))"""
REMOVED = "(SELECT (SELECT count(*) FROM hot) - (SELECT count(*) FROM unmasked) AS s, (SELECT count(*) FROM burned) AS k) a"


def _verdicts(broken: bool) -> str:
    more = 1 if broken else 0
    bad = "'fallo'" if broken else "'ok'"
    first = "(SELECT CASE WHEN municipio IS NULL THEN 1 ELSE 0 END FROM incidents ORDER BY id LIMIT 1)"
    twice = f"CASE WHEN origin = (SELECT origin FROM incidents ORDER BY id LIMIT 1) THEN {more} ELSE 0 END"
    missing = f"(SELECT count(*) FROM incidents WHERE municipio IS NULL) + {more} * {first}"
    return f"""
  SELECT 'manifiesto' AS comprobacion, 'ok' AS nivel, '2024-01-31T00:00:00Z' AS publicado, NULL AS esperado
  UNION ALL SELECT 'incidentes', {bad}, CAST(count(*) + {more} AS VARCHAR), CAST(count(*) AS VARCHAR) FROM incidents
  UNION ALL SELECT 'focos', {bad}, CAST(count(*) + {more} AS VARCHAR), CAST(count(*) + {2 * more} AS VARCHAR) FROM burned
  UNION ALL SELECT 'confianza baja', 'ok', '0', NULL
  UNION ALL SELECT 'invariantes', {bad}, '{more}', '0'
  UNION ALL SELECT 'fuera de la caja', {bad}, '{more}', '0'
  UNION ALL SELECT 'desfase de antigüedad', {bad}, '{121 * more}', '0'
  UNION ALL SELECT 'antigüedad', CASE WHEN {OLDEST} > 14400 THEN 'aviso' ELSE 'ok' END, CAST({OLDEST} AS VARCHAR), '14400'
  UNION ALL SELECT 'suprimidos %', CASE WHEN round_even(a.s * 1e2 / (a.s + a.k + {2 * more}), 0) > 60 THEN 'aviso' ELSE 'ok' END,
    CAST(CAST(round_even(a.s * 1e2 / (a.s + a.k + {2 * more}), 0) AS BIGINT) AS VARCHAR), '60' FROM {REMOVED}
  UNION ALL SELECT 'sin municipio', CASE WHEN {missing} = count(*) + {more} THEN 'aviso' ELSE 'ok' END, CAST({missing} AS VARCHAR), CAST(count(*) + {more} AS VARCHAR) FROM incidents
  UNION ALL SELECT 'degradado', CASE WHEN {OLDEST} > 14400 THEN 'aviso' ELSE 'ok' END,
    CASE WHEN {OLDEST} > 14400 THEN 'el dato más antiguo tiene ' || printf('%.1f', {OLDEST} / 3.6e3) || ' h (umbral: 4 h)' END, NULL
  UNION ALL SELECT 'origen ' || origin, 'ok', CAST(count(*) + {twice} AS VARCHAR), NULL FROM incidents GROUP BY origin
  UNION ALL SELECT 'fuentes ok', 'ok', '{2 - more}', NULL""" + (" UNION ALL SELECT 'fuentes error', 'aviso', '1', 'otra'" if broken else "")


def _verdict(spark, sf, name: str, broken: bool):
    report = verify.verify(spark, _published(spark, sf, scratch(spark, name), broken), P.now())
    # Bytes depend on how files are cut; their rows are tested on a small run.
    return report.where(~F.col("comprobacion").startswith("tamaño"))


@register("reconciliation", S.query(INCIDENTS, _verdicts(False)))
def reconciliation(spark, sf):
    """Every check of a run, over the files that it published."""
    return _verdict(spark, sf, "verified", False)


@register("reconciliation_broken_run", S.query(INCIDENTS, _verdicts(True)))
def reconciliation_broken_run(spark, sf):
    """The same over a run whose files and manifest were spoilt: five checks fail, one warns."""
    return _verdict(spark, sf, "spoilt", True)


@register("emptiness_by_day", S.query(S.CLEAN, """
  , d AS (SELECT CAST(acq_dt AS DATE) AS dia, count(*) AS n FROM clean GROUP BY 1)
  SELECT strftime(dia, '%Y-%m-%d') AS dia, n AS hotspots, n <= m.med * (1e0 - 9e-1) AND m.med >= 20 AS sospechoso
  FROM d, (SELECT median(n) AS med FROM (SELECT n FROM d ORDER BY dia DESC LIMIT 24)) m"""))
def emptiness_by_day(spark, sf):
    days = stages.clean(spark, sf).groupBy(F.date_format("acq_dt", "yyyy-MM-dd").alias("dia")).agg(
        F.count("*").alias("hotspots")
    )
    runs = days.select("hotspots", F.lit(0).alias("incidents"), F.col("dia").alias("at"))
    judged = quality.emptiness(days.select("hotspots").distinct(), runs)
    return days.join(judged, "hotspots").select(
        "dia", "hotspots", F.col("vaciado_sospechoso").alias("sospechoso")
    )
