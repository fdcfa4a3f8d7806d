"""Layers read in pieces, and the jobs that prepare them."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from firespark.operators.quality import PublicationAborted
from firespark.plans import prepare
from firespark.sinks import history
from firespark.sources import layers


def feature(i, kind="Point", coordinates=None, **props):
    return {"type": "Feature", "geometry": {"type": kind, "coordinates": coordinates or [i / 100, 40]}, "properties": {"n": i, **props}}


def put(path, features, **more):
    path.mkdir(exist_ok=True)
    (path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features, **more}), encoding="utf-8")
    return str(path)


@pytest.fixture()
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_one_file_is_read_by_several_tasks_and_whole(spark, tmp_path, small_splits):
    odd = 'it says \"Feature\" and {"type": "Feature"} in é'
    path = put(tmp_path / "l", [feature(i, text=odd if i % 7 == 0 else "x" * (i % 50)) for i in range(4000)], crs={"type": "name", "properties": {}})
    found = layers.scan_features(spark, path)
    assert found.rdd.getNumPartitions() > 5
    rows = found.select(F.col("props")["n"].cast("int").alias("n"), "kind", F.col("props")["text"].alias("t")).collect()
    assert sorted(r.n for r in rows) == list(range(4000)) and {r.kind for r in rows} == {"Point"}
    assert all(r.t == odd for r in rows if r.n % 7 == 0)


def test_layers_of_other_shapes(spark, tmp_path):
    bare = tmp_path / "bare"
    bare.mkdir()
    (bare / "a.json").write_text(json.dumps({"features": [{"geometry": None, "properties": {"n": 1}}, {"properties": {"n": 2}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert sorted(r.props["n"] for r in layers.scan_features(spark, str(bare)).collect()) == ["1", "2"]
    last = tmp_path / "last"
    last.mkdir()
    (last / "a.json").write_text(json.dumps({"features": [{"properties": {"n": i}, "geometry": {"type": "Point", "coordinates": [1, 2]}, "type": "Feature"} for i in range(3)]}))
    assert layers.scan_features(spark, str(last)).count() == 3
    assert layers.scan_features(spark, put(tmp_path / "none", [])).count() == 0
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "a.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point"')
    with pytest.raises(Exception, match="breaks off"):
        layers.scan_features(spark, str(broken)).collect()


SQUARE = lambda x, y, d=1.0: [[[x, y], [x + d, y], [x + d, y + d], [x, y + d], [x, y]]]


def towns(n=12):
    return [feature(i, "Polygon", SQUARE(-9.0 + i, 40.0), NAMEUNIT=f"Villa {i}", provincia="P") for i in range(n)]


LIMITS = prepare.Limits(10, 20, controls=((40.5, -8.5, "villa 0"), (40.5, -7.5, "Vílla 1"), (40.5, -6.5, "Otra")))


def test_a_sound_layer_replaces_the_old_one_and_a_bad_one_does_not(spark, tmp_path):
    out = str(tmp_path / "out")
    made = prepare.prepare_municipalities(spark, [(put(tmp_path / "good", towns()), None)], out, LIMITS)
    assert made.count() == 12 and spark.read.text(out).count() == 12
    bad = {
        "recintos": towns(3), "geometrías": [*towns(), feature(99, "LineString", [[0, 40], [1, 41]])], "caja": [*towns(), feature(98, "Polygon", SQUARE(80.0, 10.0), NAMEUNIT="Lejos")],
        "controles": [dict(f, properties={"NAMEUNIT": "Z"}) for f in towns()], "sin nombres": [dict(f, properties={"otro": "Z"}) for f in towns()],
    }
    for name, features in bad.items():
        with pytest.raises(PublicationAborted, match=name):
            prepare.prepare_municipalities(spark, [(put(tmp_path / name.replace(" ", "_"), features), None)], out, LIMITS)
    assert spark.read.text(out).count() == 12


def test_settlements_must_reach_the_islands_and_the_north(spark, tmp_path):
    def town(i, lat, lon):
        return feature(i, nombre=f"N{i}", habitantes=i, latitud=lat, longitud=lon)

    limits = prepare.Limits(2, 10, controls=((0.0, 0.0, "N1"),))
    good = put(tmp_path / "good", [town(0, 28.1, -17.2), town(1, 43.4, -3.0), town(2, None, 1.0)])
    assert prepare.prepare_settlements(spark, good, str(tmp_path / "out"), limits).count() == 2
    cases = {"oeste": [town(0, 40.0, -8.0), town(1, 43.4, -3.0)], "norte": [town(0, 28.1, -17.2), town(1, 42.0, -3.0)], "falta": [town(0, 28.1, -17.2), town(5, 43.4, -3.0)]}
    for name, features in cases.items():
        with pytest.raises(PublicationAborted, match=name):
            prepare.prepare_settlements(spark, put(tmp_path / name, features), str(tmp_path / "out"), limits)


def test_mask_proposals_come_from_the_days_kept(spark, tmp_path):
    rows = spark.range(60).select(
        F.lit(40.0).alias("latitude"), (F.lit(-3.0) - F.floor(F.col("id") / 50) * 0.1).alias("longitude"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=(F.col("id") % 50).cast("int"))).alias("acq_dt"), F.lit("V").alias("source"), F.col("id").cast("double").alias("frp_mw"),
    )
    root, partials, out = (str(tmp_path / n) for n in ("history", "partials", "out"))
    for low in (0, 30):
        history.append_with_partials(rows.where(F.col("frp_mw").between(low, low + 29)), root, partials)
    named = prepare.propose_mask(spark.read.parquet(partials), out).collect()
    assert [(r.name, r.active_days, r.frp_median) for r in named] == [("auto_0", 50, 24.5)] and spark.read.text(out).count() == 1
    with pytest.raises(PublicationAborted, match="nothing proposed"):
        prepare.propose_mask(spark.read.parquet(partials), out, min_days=51)
    assert spark.read.text(out).count() == 1
