"""The verifier over small published folders: sizes, missing artifacts, exit status."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from firespark.plans import verify as V
from firespark.sinks.publish import publish


def now():
    return F.lit("2024-01-31 01:00:00").cast("timestamp")



def feature(lon, lat, **properties):
    return json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [lon, lat]}, "properties": properties})


def put(spark, root, run="r1", **lines):
    def write(rows):
        return lambda p: spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1).write.text(p)

    publish(spark, root, run, [(name, write(rows)) for name, rows in lines.items()])


def told(spark, root):
    return {r.comprobacion: r for r in V.verify(spark, root, now()).collect()}


HOTSPOT = feature(-3.0, 40.0, acq_dt="2024-01-31T00:00:00Z", instrument="VIIRS", confianza_baja=False)
LOW = feature(-3.0, 40.0, acq_dt="2024-01-01T00:00:00Z", instrument="VIIRS", confianza_baja=True)
INCIDENT = feature(-3.0, 40.0, id="i1", origin="satelite", satellite_confirmed=True, official_confirmed=False, n_hotspots=1, position_precision_m=375.0, municipio="X")
MANIFEST = {"generated_at": "2024-01-31T01:00:00Z", "worst_data_age_seconds": 3600, "degraded": False,
            "counts": {"incidents_total": 1, "hotspots_24h": 1, "hotspots_suppressed_industrial": 3, "hotspots_suppressed_lowconf": 1}}


def test_a_sound_run_and_its_warnings(spark, tmp_path):
    root = str(tmp_path)
    put(spark, root, hotspots=[HOTSPOT, LOW], incidents=[INCIDENT], wind=["x" * 30_000], sources=[json.dumps({"name": "s", "status": "error"})], manifest=[json.dumps(MANIFEST)])
    got = told(spark, root)
    assert {r.nivel for r in got.values()} == {"ok", "aviso"} and V.exit_status(V.verify(spark, root, now())) == 0
    assert {n for n, r in got.items() if r.nivel == "aviso"} == {"tamaño de wind", "fuentes error", "suprimidos %"}
    assert got["tamaño de wind"].publicado == "30001" and got["fuentes error"].esperado == "s" and got["confianza baja"].publicado == "1"
    assert got["suprimidos %"].publicado == "80" and got["origen satelite"].publicado == "1"


@pytest.mark.parametrize(("change", "failed"), [
    ({"worst_data_age_seconds": 3000}, {"desfase de antigüedad"}), ({"counts": {**MANIFEST["counts"], "hotspots_24h": 2}}, {"focos"}), ({"counts": None}, {"incidentes", "focos"}),
])
def test_a_manifest_that_lies(spark, tmp_path, change, failed):
    root = str(tmp_path)
    put(spark, root, hotspots=[HOTSPOT], incidents=[INCIDENT], manifest=[json.dumps(MANIFEST | change)])
    assert {n for n, r in told(spark, root).items() if r.nivel == "fallo"} == failed
    assert V.main([root, "--now", "2024-01-31T01:00:00+00:00"]) == 1


def test_what_is_not_there(spark, tmp_path):
    root = str(tmp_path)
    assert [(r.comprobacion, r.nivel) for r in V.verify(spark, root, now()).collect()] == [("manifiesto", "fallo")]
    put(spark, root, manifest=[json.dumps(MANIFEST)], hotspots=[HOTSPOT])
    assert set(told(spark, root)) == {"falta incidents"}
    put(spark, root, run="r2", hotspots=["not json", HOTSPOT], incidents=[INCIDENT], manifest=[json.dumps(MANIFEST)])
    got = told(spark, root)
    assert got["focos"].publicado == "2" and got["fuera de la caja"].publicado == "1" and V.exit_status(V.verify(spark, root, now())) == 1
