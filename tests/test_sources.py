"""Small landed payloads through the readers, the history and a whole run."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from firespark.operators import quality
from firespark.plans import run
from firespark.sinks import history, publish
from firespark.sources import assets, feeds, hotspots, official


def write(path, body):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body, encoding="utf-8")
    return str(path.parent)


VIIRS = (
    "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,instrument,confidence,frp,daynight\n"
    "40.25,-4.6,338.7,0.39,0.36,2024-01-30,45,N,VIIRS,n,12.4,N\n"
    "40.25,-4.6,338.7,0.39,0.36,2024-01-30,45,N,VIIRS,n,12.4,N\n"
    "40.253,-4.603,330.0,0.39,0.36,2024-01-30,1200,N,VIIRS,h,,D\n"
    "41.9,-3.0,320.0,0.39,0.36,2024-01-30,1200,N,VIIRS,l,3.0,D\n"
)


def test_two_sensor_headers_and_quota_body(spark, tmp_path):
    write(tmp_path / "h/source=VIIRS_SNPP_NRT/area_key=peninsula/a.csv", VIIRS)
    write(
        tmp_path / "h/source=MODIS_NRT/area_key=peninsula/a.csv",
        VIIRS.splitlines()[0].replace("bright_ti4", "brightness") + "\n39,-3,310,1,1,2024-01-30,5,T,MODIS,78,1,D\n",
    )
    write(tmp_path / "q/a.csv", "Exceeding allowed transaction limit\n")
    jobs = [("VIIRS_SNPP_NRT", "peninsula"), ("MODIS_NRT", "peninsula")]
    rows = hotspots.read_all(spark, str(tmp_path / "h"), jobs).orderBy("acq_dt", "latitude").collect()
    assert len(rows) == 4 and rows[0].confidence_pct == 78.0 and rows[0].acq_dt.minute == 5
    assert {r.frp_mw for r in rows if r.latitude == 40.253} == {0.0}
    assert hotspots.read_one(spark, str(tmp_path / "q"), "s", "a").count() == 0
    assert hotspots.quarantine(spark, str(tmp_path / "q")).count() == 1
    with pytest.raises(ValueError, match="SNPP/x.*confidence"):
        hotspots.check_columns(spark.createDataFrame([(1.0,)], "latitude double"), "SNPP", "x")


def test_asset_dialects(spark, tmp_path):
    path = write(tmp_path / "a.csv", "Nombre;Latitud;LON\nNave;40,5;-3,2\n;41,0;-3,0\nSin;;-3,0\n")
    got = [(r.nombre, r.lat, r.lon) for r in assets.read_csv(spark, path).collect()]
    assert sorted(got) == [("Nave", 40.5, -3.2), ("Punto 2", 41.0, -3.0)]
    with pytest.raises(assets.AssetFileError):
        assets.read_csv(spark, write(tmp_path / "b/b.csv", "a,b\n1,2\n"))
    swapped = spark.createDataFrame([("x", -3.0, 40.0)], "nombre string, lat double, lon double")
    with pytest.raises(assets.AssetFileError, match="invertidas"):
        assets.validate(swapped)


def test_bare_wind_object_and_missing_direction(spark):
    block = {"latitude": 1.0, "longitude": 2.0, "current": {"wind_direction_10m": 190, "wind_speed_10m": 5}}
    none = {"current": {"wind_speed_10m": 5}}
    docs = spark.createDataFrame([(json.dumps(block),), (json.dumps([none, block]),)], "value string")
    rows = feeds.parse_wind(docs, feeds.grid_points(spark)).orderBy("name").collect()
    assert len(rows) == 2 and {r.direction_to_deg for r in rows} == {10.0}
    assert feeds.grid_points(spark).count() == 230


def test_registry_isolates_a_broken_source(spark, tmp_path):
    good = {"listaEmergencias": [{"emergencia_cpm": "5", "emergencia_num1": 7, "longitud": 352454.0, "latitud": 4468904.0,
                                  "estado": {"NOMBRE": "ACTIVO"}, "provincia": {"nombre": "AVILA"}}]}
    path = write(tmp_path / "j/a.json", json.dumps(good))
    registry = official.official_sources(
        {"jcyl": path, "infoca": str(tmp_path / "absent"), "bombers": path}, {"infoca": {"external_id": "id"}}
    )
    rows = registry.collect(spark, F.lit("2024-01-31").cast("timestamp")).collect()
    assert [(r.external_id, r.status, r.provincia, r.precision_m) for r in rows] == [("5-7", "activo", "Ávila", 500.0)]
    # The third source has a path and no field map: it isn't configured, so it can't fail.
    assert set(registry.failures) == {"infoca"}
    told = {r.source_id: r.configured for r in registry.table(spark).collect()}
    assert told == {"jcyl": True, "infoca": True, "bombers": False, "infocam": False, "112cv": False}
    NOON = F.lit("2024-01-31 12:00:00").cast("timestamp")
    states = {r.source_id: (r.status, r.error) for r in quality.source_health(
        run.official_states(registry, registry.collect(spark, NOON).withColumn("match_distance_m", F.lit(1.0)), NOON), NOON).collect()}
    assert states["jcyl"] == ("ok", None) and states["infoca"][0] == "error" and states["bombers"] == ("disabled", None)


def test_absent_and_changed_sensors_leave_the_others_alone(spark, tmp_path):
    write(tmp_path / "h/source=A/area_key=x/a.csv", VIIRS)
    write(tmp_path / "h/source=B/area_key=x/a.csv", "latitude,longitude\n1,2\n")
    failures = {}
    rows = hotspots.read_all(spark, str(tmp_path / "h"), [("A", "x"), ("B", "x"), ("C", "x")], failures)
    assert {r.source for r in rows.collect()} == {"A"}
    assert failures["C/x"] == "no landed files" and "missing columns" in failures["B/x"]


def test_closure_without_attributes_is_kept(spark, tmp_path):
    record = ("<sit:situationRecord{0}><sit:roadOrCarriagewayOrLaneManagementType>roadClosed</sit:roadOrCarriagewayOrLaneManagementType>"
              "<loc:latitude>40.1</loc:latitude><loc:longitude>-4.{1}</loc:longitude><loc:roadName>A-{1}</loc:roadName></sit:situationRecord>")
    path = write(tmp_path / "c/a.xml", "<p><a>" + record.format(' id="1"', 1) + record.format("", 2) + record.format(' id="3"', 3) + "</a></p>")
    records = feeds.read_situation_records(spark, path)
    bare = [r[0] for r in records.select(feeds._bare(F.col("value"))).collect() if r[0]]
    assert len(bare) == 3 and all(b.startswith("<situationRecord") and b.endswith("</situationRecord>") for b in bare)


def test_history_is_idempotent_and_first_wins(spark, tmp_path):
    root = str(tmp_path / "hist")
    rows = spark.createDataFrame(
        [(40.0, -3.0, "s", 1.0, "2024-01-01 10:00:00"), (41.0, -3.0, "s", 2.0, "2024-01-02 10:00:00")],
        "latitude double, longitude double, source string, frp_mw double, t string",
    ).withColumn("acq_dt", F.col("t").cast("timestamp")).drop("t")
    history.append_history(rows, root)
    history.append_history(rows.withColumn("frp_mw", F.lit(9.0)).where("latitude = 40.0"), root)
    assert sorted(r.frp_mw for r in history.read_history(spark, root).collect()) == [1.0, 2.0]


def test_history_merge_reads_only_the_days_of_the_batch(spark, tmp_path):
    root = str(tmp_path / "hist")
    days = [(40.0, -3.0, "s", 1.0, f"2024-01-{d:02d} 10:00:00") for d in range(1, 6)]
    rows = spark.createDataFrame(days, "latitude double, longitude double, source string, frp_mw double, t string").select(
        "latitude", "longitude", "source", "frp_mw", F.col("t").cast("timestamp").alias("acq_dt"))
    history.append_history(rows, root)
    merged = history.merge_days(history.read_history(spark, root), rows.where("day(acq_dt) = 3"))
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(acq_date" in plan and "2024-01-03" in plan and merged.count() == 1


def test_failed_step_keeps_the_previous_run(spark, tmp_path):
    root = str(tmp_path / "pub")
    publish.publish(spark, root, "1", [("a", lambda p: spark.range(1).write.parquet(p))])

    def broken(_):
        raise OSError("disk")

    with pytest.raises(publish.PublicationAborted, match="'b'"):
        publish.publish(spark, root, "2", [("b", broken)])
    assert publish.current_run(spark, root).endswith("/runs/1")


def test_landed_files_to_published_incidents(spark, tmp_path):
    landed, out = tmp_path / "landed", str(tmp_path / "out")
    write(landed / "hotspots/source=VIIRS_SNPP_NRT/area_key=peninsula/a.csv", VIIRS)
    for source in ("VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT", "MODIS_NRT"):
        write(landed / f"hotspots/source={source}/area_key=peninsula/a.csv", "quota exceeded\n")
    for source in ("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT", "MODIS_NRT"):
        write(landed / f"hotspots/source={source}/area_key=canarias/a.csv", "quota exceeded\n")
    write(landed / "settlements/a.json", json.dumps({"features": [{"properties": {
        "nombre": "Cebreros", "habitantes": 3000, "tipo": "x", "latitud": 40.3, "longitud": -4.6}}]}))
    now = F.lit("2024-01-30 18:00:00").cast("timestamp")
    inputs = run.read_inputs(spark, str(landed), now)
    target = run.publish_run(run.build(inputs, now), inputs, out, "20240130T180000Z", now)
    incident = json.loads(spark.read.text(f"{target}/incidents").head()["value"])
    assert incident["properties"]["n_hotspots"] == 2 and incident["properties"]["status"] is None
    assert incident["properties"]["nucleo_cercano"] == "Cebreros" and incident["properties"]["viento_kmh"] is None
    told = json.loads(spark.read.text(f"{target}/manifest").head()["value"])
    assert told["counts"]["hotspots_24h"] == 2 and told["counts"]["hotspots_suppressed_lowconf"] == 1
    assert spark.read.text(f"{target}/hotspots").count() == 3
    assert history.read_history(spark, f"{out}/history").count() == 2
