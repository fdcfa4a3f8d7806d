"""Does a published run hold together? Reads the files that readers get, not the tables they came from.

``python -m firespark.plans.verify PUBLISHED`` prints the report and ends with status 1 if a
check has failed. Warnings don't change the status.
"""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import geo, times
from firespark.operators import quality
from firespark.session import build_session, materialise, path_exists
from firespark.sinks.publish import current_run

OK, WARNING, FAILURE = "ok", "aviso", "fallo"
AGE_SLACK_S = 120
SUPPRESSED_LIMIT_PCT = 60
#: Bytes that an artifact should stay under.
BUDGETS = {
    "manifest": 4_000, "sources": 8_000, "incidents": 400_000, "perimeters": 1_500_000, "hotspots": 3_000_000, "wind": 20_000,
}
ROW = "comprobacion string, nivel string, publicado string, esperado string"
MANIFEST = """generated_at string, worst_data_age_seconds long, degraded boolean, degraded_reason string, counts struct<incidents_total: long,
    hotspots_24h: long, hotspots_suppressed_industrial: long, hotspots_suppressed_lowconf: long>"""
POINT = "geometry struct<type: string, coordinates: array<double>>"
HOTSPOT = f"{POINT}, properties struct<acq_dt: string, instrument: string, confianza_baja: boolean>"
INCIDENT = f"""{POINT}, properties struct<id: string, origin: string, satellite_confirmed: boolean, official_confirmed: boolean,
    status: string, municipio: string, n_hotspots: long, position_precision_m: double, first_detected: string, last_detected: string>"""
SOURCE = "name string, status string"


def _row(name: str | Column, level: str | Column, told: Column | None = None, expected: Column | None = None) -> Column:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    text = lambda v: F.lit(None).cast("string") if v is None else v.cast("string")
    return F.struct(
        lit(name).alias("comprobacion"), lit(level).alias("nivel"), text(told).alias("publicado"), text(expected).alias("esperado")
    )


def _failed_if(bad: Column, level: str = FAILURE) -> Column:
    return F.when(bad, level).otherwise(OK)


def _points(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """Properties and position of every feature line of an artifact; lines that aren't features have neither."""
    rows = spark.read.schema(layout).json(path)
    return rows.select("properties.*", F.get("geometry.coordinates", F.lit(0)).alias("lon"), F.get("geometry.coordinates", F.lit(1)).alias("lat"))


def _against_manifest(told: DataFrame, hotspots: DataFrame, incidents: DataFrame, now: Column) -> DataFrame:
    reliable = ~F.coalesce("confianza_baja", F.lit(False))
    inside = F.coalesce(geo.in_box(F.col("lat"), F.col("lon"), C.PUBLISH_BOX), F.lit(False))
    family = F.coalesce(*[F.when(F.upper("instrument").startswith(p), p) for p in ("VIIRS", "MODIS", "SEVIRI")])
    seen = hotspots.withColumns({"_reliable": reliable, "_inside": inside, "_family": family})
    # The worst family counts: the freshest of several would hide the one that is silent.
    ages = seen.where("_reliable and _family is not null").groupBy("_family").agg(F.max(F.to_timestamp("acq_dt")).alias("last"))
    counted = seen.agg(
        F.count_if("_reliable").alias("focos"), F.count_if(~F.col("_reliable")).alias("bajas"), F.count_if(~F.col("_inside")).alias("fuera")
    )
    there = incidents.agg(F.count("*").alias("n"), F.count_if(F.col("municipio").isNull()).alias("sin"))
    broken = quality.violations(incidents).agg(F.count("*").alias("rotas"))
    oldest = ages.agg(F.max(times.whole_seconds(now, F.col("last"))).alias("edad"))
    one = told
    for part in (counted, there, broken, oldest):
        whole = part.select(F.struct(*part.columns)).scalar()
        one = one.withColumn("_part", whole).select("*", "_part.*").drop("_part")
    removed = F.col("counts.hotspots_suppressed_industrial") + F.col("counts.hotspots_suppressed_lowconf")
    pct = F.bround(100.0 * removed / F.nullif(removed + F.col("counts.hotspots_24h"), F.lit(0)), 0).cast("long")
    real = F.coalesce("edad", F.lit(0).cast("long"))
    drift = F.abs(real - F.coalesce("worst_data_age_seconds", F.lit(0).cast("long")))
    zero = F.lit(0)
    rows = [
        _row("manifiesto", OK, F.col("generated_at")),
        _row("incidentes", _failed_if(~F.col("n").eqNullSafe(F.col("counts.incidents_total"))), F.col("n"), F.col("counts.incidents_total")),
        _row("focos", _failed_if(~F.col("focos").eqNullSafe(F.col("counts.hotspots_24h"))), F.col("focos"), F.col("counts.hotspots_24h")),
        _row("confianza baja", OK, F.col("bajas")),
        _row("invariantes", _failed_if(F.col("rotas") > 0), F.col("rotas"), zero),
        _row("fuera de la caja", _failed_if(F.col("fuera") > 0), F.col("fuera"), zero),
        _row("desfase de antigüedad", _failed_if(drift > AGE_SLACK_S), drift, zero),
        _row("antigüedad", _failed_if(real > C.MAX_DATA_AGE_S, WARNING), real, F.lit(C.MAX_DATA_AGE_S)),
        _row("suprimidos %", _failed_if(F.coalesce(pct > SUPPRESSED_LIMIT_PCT, F.lit(False)), WARNING), pct, F.lit(SUPPRESSED_LIMIT_PCT)),
        _row("sin municipio", _failed_if((F.col("n") > 0) & (F.col("sin") == F.col("n")), WARNING), F.col("sin"), F.col("n")),
        _row("degradado", _failed_if(F.coalesce("degraded", F.lit(False)), WARNING), F.col("degraded_reason")),
    ]
    return one.select(F.inline(F.array(*rows)))


def _sizes(spark: SparkSession, run: str, names: list[str]) -> DataFrame:
    """Bytes of every artifact of a run against its budget."""
    parts = []
    for name in names:
        # An artifact of no lines has no rows to take file sizes from: zero bytes.
        files = spark.read.text(f"{run}/{name}").select("_metadata.file_path", "_metadata.file_size").distinct()
        parts.append(files.agg(F.coalesce(F.sum("file_size"), F.lit(0).cast("long")).alias("bytes")).select(
            F.inline(F.array(_row(f"tamaño de {name}", _failed_if(F.col("bytes") > BUDGETS[name], WARNING), F.col("bytes"), F.lit(BUDGETS[name]))))
        ))
    return reduce(DataFrame.unionByName, parts)


def verify(spark: SparkSession, root: str, now: Column) -> DataFrame:
    """``(comprobacion, nivel, publicado, esperado)`` of the current run under ``root``: one row per check.

    Counts per origin and per state of source are rows of their own. Without a manifest
    there is one row, a failure; a missing artifact is a failure by its name.
    """
    run = current_run(spark, root)
    if run is None or not path_exists(spark, f"{run}/manifest"):
        return spark.createDataFrame([("manifiesto", FAILURE, None, None)], ROW)
    needed = [n for n in ("hotspots", "incidents") if not path_exists(spark, f"{run}/{n}")]
    if needed:
        return spark.createDataFrame([(f"falta {n}", FAILURE, None, None) for n in needed], ROW)
    told = spark.read.schema(MANIFEST).json(f"{run}/manifest")
    hotspots = _points(spark, f"{run}/hotspots", HOTSPOT)
    incidents = materialise(_points(spark, f"{run}/incidents", INCIDENT))
    origin = incidents.groupBy(F.coalesce("origin", F.lit("nulo")).alias("o")).agg(F.count("*").alias("n"))
    out = _against_manifest(told, hotspots, incidents, now).unionByName(
        origin.select(F.inline(F.array(_row(F.concat(F.lit("origen "), "o"), OK, F.col("n")))))
    )
    if path_exists(spark, f"{run}/sources"):
        states = spark.read.schema(SOURCE).json(f"{run}/sources").groupBy("status").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names"))
        level = _failed_if(F.col("status") == "error", WARNING)
        out = out.unionByName(states.select(F.inline(F.array(_row(F.concat(F.lit("fuentes "), "status"), level, F.col("n"), F.when(F.col("status") == "error", F.array_join("names", ", ")))))))
    sized = [n for n in BUDGETS if path_exists(spark, f"{run}/{n}")]
    return out.unionByName(_sizes(spark, run, sized))


def exit_status(report: DataFrame) -> int:
    return int(not report.where(F.col("nivel") == FAILURE).isEmpty())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Check a published run against its manifest")
    parser.add_argument("published", help="folder that runs are published into")
    parser.add_argument("--now", help="UTC time to take ages at, ISO; the clock by default")
    args = parser.parse_args(argv)
    spark = build_session()
    stamp = datetime.fromisoformat(args.now).astimezone(UTC) if args.now else datetime.now(UTC)
    report = materialise(verify(spark, args.published, F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")))
    # At most one row per check, origin, state and artifact.
    for r in report.collect():
        print(f"[{r.nivel}] {r.comprobacion}: {r.publicado if r.publicado is not None else '-'}" + (f" ({r.esperado})" if r.esperado is not None else ""))
    return exit_status(report)


if __name__ == "__main__":
    sys.exit(main())
