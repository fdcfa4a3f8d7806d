"""The batch run: landed files to published incidents.

Stage order is a contract: ingest, clean, clip, cluster, locate, fuse, surround,
validate, guard, publish. Nothing is published unless every check passes.
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions.text import lookup
from firespark.operators import clean, cluster, context, explore, fuse, hull, polygons, quality, summaries
from firespark.operators.rows import empty
from firespark.schemas import schema
from firespark.session import build_session, materialise, path_exists, shared_dir, use_utc
from firespark.sinks import features as geojson
from firespark.sinks import history, manifest, publish
from firespark.sources import feeds, hotspots, layers
from firespark.sources.official import Registry, official_sources


@dataclass
class Inputs:
    """Tables of one run. A layer left as ``None`` gives null columns, not zeros."""

    hotspots: DataFrame
    official: DataFrame | None = None
    mask: DataFrame | None = None
    municipalities: DataFrame | None = None
    wind: DataFrame | None = None
    air: DataFrame | None = None
    warnings: DataFrame | None = None
    closures: DataFrame | None = None
    settlements: DataFrame | None = None
    land_cover: DataFrame | None = None
    registry: Registry = field(default_factory=official_sources)
    sensor_failures: dict[str, str] = field(default_factory=dict)


@dataclass
class Results:
    hotspots: DataFrame
    fires: DataFrame
    perimeters: DataFrame
    incidents: DataFrame
    discards: DataFrame
    official: DataFrame


def build(inputs: Inputs, now: Column) -> Results:
    """Every table of a run. Stages read by several later ones are stored once."""
    spark = use_utc(inputs.hotspots.sparkSession)
    quality.abort_if_empty(inputs.hotspots, "ingest")
    low = clean.split_confidence(inputs.hotspots)[1]
    kept, removed = clean.clean_and_count(inputs.hotspots, inputs.mask, inputs.municipalities)
    quality.abort_if_empty(kept, "cleaning")
    burned = materialise(cluster.assign_fire_ids(kept))
    layer = inputs.municipalities
    if layer is not None:
        layer = layer.select("municipio", "provincia", "rings")
    fires = polygons.locate(
        cluster.build_fires(burned, now), layer, [F.col("municipio")], ["municipio", "provincia"], "lat", "lon"
    )
    official = inputs.official if inputs.official is not None else empty(spark, schema("official"))
    fires = materialise(fires)
    reports = materialise(fuse.match_reports(official, fires))
    confirmed = fuse.confirm_fires(fires, reports)
    incidents = context.enrich(
        materialise(fuse.build_incidents(reports, confirmed)), now, inputs.wind, inputs.warnings,
        inputs.closures, burned, inputs.settlements,
    )
    incidents = materialise(context.add_land_cover(incidents, inputs.land_cover))
    near = polygons.clip_to_territory(low, inputs.municipalities, C.BORDER_MARGIN_M)
    return Results(
        summaries.combined_layer(burned, near), confirmed, hull.build_perimeters(burned), incidents,
        removed, reports,
    )


def official_states(registry: Registry, reports: DataFrame, now: Column) -> DataFrame:
    """One row per official source: a configured one without reports is in error, one that
    nobody configured is disabled. ``reports`` has ``match_distance_m``, null if unmatched."""
    counted = reports.groupBy("source_id").agg(
        F.count("*").alias("records"), F.count("match_distance_m").alias("emparejados"),
        F.round(F.median("match_distance_m"), 1).alias("separacion_mediana_m"),
    )
    failed = lookup(registry.failures, F.col("source_id")) if registry.failures else F.lit(None).cast("string")
    silent = F.coalesce(failed, F.lit("sin datos"))
    return registry.table(reports.sparkSession).join(counted, "source_id", "left").withColumns(
        {
            "records": F.coalesce("records", F.lit(0)).cast("long"), "kind": F.lit("oficial"),
            "critical": F.lit(False), "error": F.when(F.col("configured") & F.col("records").isNull(), silent),
            "last_success_at": F.when(F.col("records") > 0, now),
            "latest_data_at": F.lit(None).cast("timestamp"),
            "max_data_age_seconds": F.lit(None).cast("long"),
        }
    )


def health(
    results: Results, now: Column, registry: Registry | None = None, sensor_failures: dict[str, str] | None = None
) -> DataFrame:
    """One row per source, with or without data."""
    reliable = results.hotspots.where(~F.col("confianza_baja"))
    told: dict[str, str] = {}
    for prefix in {p for _, _, p, *_ in C.SENSOR_FAMILIES}:
        reasons = [f"{job}: {why}" for job, why in sorted((sensor_failures or {}).items()) if job.upper().startswith(prefix)]
        if reasons:
            told[prefix] = "; ".join(reasons)
    silent = F.coalesce(lookup(told, F.col("prefix")), F.lit("sin detecciones")) if told else F.lit("sin detecciones")
    sensors = summaries.families(reliable).withColumns(
        {
            "kind": F.lit("satelite"), "region": F.lit("España"),
            "configured": (F.col("prefix") != "SEVIRI") | (F.col("records") > 0),
            "error": F.when(F.col("records") == 0, silent),
            "last_success_at": F.when(F.col("records") > 0, now),
        }
    )
    official = official_states(registry or official_sources(), results.official, now)
    return quality.source_health(sensors.unionByName(official, allowMissingColumns=True), now)


def publish_run(results: Results, inputs: Inputs, root: str, run_id: str, now: Column) -> str:
    """Validate, guard against a suspicious emptying, then publish with the pointer last."""
    spark = results.hotspots.sparkSession
    quality.validate_or_abort(results.incidents)
    reliable = results.hotspots.where(~F.col("confianza_baja"))
    runs = publish.read_runs(spark, f"{root}/runs-log/{_last_log(spark, root)}")
    verdict = quality.emptiness(reliable.agg(F.count("*").alias("hotspots")), runs).head()
    if verdict["vaciado_sospechoso"]:
        raise quality.PublicationAborted(f"{verdict['hotspots']} detections against a median of {verdict['mediana']}")
    told = manifest.build_manifest(reliable, results.incidents, results.official, now, results.discards)
    states = health(results, now, inputs.registry, inputs.sensor_failures)
    worst = told.select("worst_data_age_seconds")
    sick = quality.degraded(states, worst)
    told = told.withColumns(
        {
            "degraded": F.col("degraded") | sick.select("degraded").scalar(),
            "degraded_reason": F.coalesce(sick.select("degraded_reason").scalar(), "degraded_reason"),
        }
    )
    point = geojson.point_geometry
    web = explore.web_incidents(results.incidents, now)
    steps = [
        ("hotspots", lambda p: geojson.write_features(results.hotspots, p, geojson.HOTSPOT_FIELDS, point("latitude", "longitude"))),
        ("fires", lambda p: geojson.write_features(results.fires, p, geojson.FIRE_FIELDS, point("lat", "lon"))),
        ("perimeters", lambda p: geojson.write_features(results.perimeters, p, geojson.PERIMETER_FIELDS, geojson.polygon_geometry("rings"))),
        ("incidents", lambda p: geojson.write_features(web, p, tuple(c for c in web.columns if c not in ("lat", "lon")), point("lat", "lon"))),
    ]
    for name, layer in (("wind", inputs.wind), ("air", inputs.air), ("closures", inputs.closures)):
        if layer is not None:
            steps.append((name, lambda p, d=layer: geojson.write_features(d, p, tuple(d.columns), point("latitude", "longitude"))))
    if inputs.warnings is not None:
        fields = tuple(c for c in inputs.warnings.columns if c != "rings")
        steps.append(("warnings", lambda p: geojson.write_features(inputs.warnings, p, fields, geojson.polygon_geometry("rings"))))
    steps += [
        ("sources", lambda p: geojson.write_json(states.orderBy(*quality.health_order()), p)),
        ("manifest", lambda p: geojson.write_json(told, p)),
        # The log stands before the pointer moves: the next run always finds one.
        ("runs-log", lambda p: publish.append_run(runs, reliable, results.incidents, run_id).write.mode("overwrite").json(f"{root}/runs-log/{run_id}")),
    ]
    target = publish.publish(spark, root, run_id, steps)
    # The merge is idempotent: a run that stops here is repaired by the next one.
    history.append_history(reliable.drop("confianza_baja"), f"{root}/history")
    return target


def _last_log(spark: SparkSession, root: str) -> str:
    current = publish.current_run(spark, root)
    return current.rsplit("/", 1)[1] if current else "none"


def read_inputs(
    spark: SparkSession, landed: str, now: Column, skip: tuple[str, ...] = (), field_maps: dict[str, dict[str, str]] | None = None
) -> Inputs:
    """Everything under one landing folder; a layer whose folder is missing is ``None``.

    An official source is configured by its folder, and by its field map if it needs one.
    A layer that is there and can't be read stops the run.
    """

    def texts(name: str) -> DataFrame | None:
        if name in skip or not path_exists(spark, f"{landed}/{name}"):
            return None
        return spark.read.text(f"{landed}/{name}", wholetext=True)

    def with_texts(name: str, make):
        found = texts(name)
        return None if found is None else make(found)

    def with_layer(name: str, make):
        if name in skip or not path_exists(spark, f"{landed}/{name}"):
            return None
        return make(layers.scan_features(spark, f"{landed}/{name}"))

    grid = feeds.grid_points(spark)
    known = [s.meta.source_id for s in official_sources().sources]
    places = {sid: f"{landed}/official/{sid}" for sid in known if path_exists(spark, f"{landed}/official/{sid}")}
    registry = official_sources(places, field_maps)
    sensor_failures: dict[str, str] = {}
    records = None
    if "closures" not in skip and path_exists(spark, f"{landed}/closures"):
        records = feeds.parse_closures(feeds.read_situation_records(spark, f"{landed}/closures"), now)

    def named_sites(features: DataFrame) -> DataFrame:
        sites = layers.point_layer(features)
        return sites.select(F.col("props")["name"].alias("name"), "latitude", "longitude")

    def coded(features: DataFrame) -> DataFrame:
        return layers.polygon_layer(features).select(F.col("props")["code"].alias("code"), "rings")

    return Inputs(
        hotspots=hotspots.read_all(spark, f"{landed}/hotspots", hotspots.declared_jobs(), sensor_failures),
        registry=registry,
        sensor_failures=sensor_failures,
        official=registry.collect(spark, now),
        mask=with_layer("mask", named_sites),
        municipalities=with_layer(
            "municipalities", lambda f: layers.municipalities(f, ("NAMEUNIT", "provincia"))
        ),
        wind=with_texts("wind", lambda d: feeds.parse_wind(d, grid)),
        air=with_texts("air", lambda d: feeds.parse_air(d, grid)),
        warnings=with_texts(
            "warnings", lambda d: feeds.in_force(feeds.latest_warnings(feeds.parse_warnings(d)), now)
        ),
        closures=records,
        settlements=with_layer("settlements", layers.settlements),
        land_cover=with_layer("land_cover", coded),
    )


def main() -> None:
    parser = argparse.ArgumentParser(description="Landed detections to published incidents")
    parser.add_argument("landed", help="folder with the landed feeds")
    parser.add_argument("published", help="folder to publish into")
    parser.add_argument("--now", help="UTC time of the run, ISO; the clock by default")
    parser.add_argument("--no-raw", action="store_true", help="do not keep a raw snapshot")
    for layer in ("wind", "air", "closures", "warnings", "land_cover"):
        parser.add_argument(f"--no-{layer.replace('_', '-')}", dest="skip", action="append_const", const=layer)
    args = parser.parse_args()
    spark = build_session()
    shared_dir(spark)
    stamp = datetime.fromisoformat(args.now).astimezone(UTC) if args.now else datetime.now(UTC)
    now = F.lit(stamp.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    run_id = stamp.strftime("%Y%m%dT%H%M%SZ")
    inputs = read_inputs(spark, args.landed, now, tuple(args.skip or ()))
    inputs.hotspots = materialise(inputs.hotspots)
    if not args.no_raw:
        hotspots.snapshot(inputs.hotspots, f"{args.published}/raw", run_id)
    print(publish_run(build(inputs, now), inputs, args.published, run_id, now))


if __name__ == "__main__":
    main()
