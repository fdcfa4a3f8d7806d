"""Edge rules of cleaning, fusion, context, quality and hulls."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firespark.functions import domain, geo, text, times
from firespark.operators import clean, context, explore, fuse, hull, polygons, quality, summaries
from firespark.operators.rows import empty
from firespark.schemas import schema

NOW = "2024-01-31 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def points(spark, rows, ddl="id string, lat double, lon double"):
    return spark.createDataFrame(rows, ddl)


# --- functions -------------------------------------------------------------------


def test_utm_known_point_and_round_trip(spark):
    x, y = geo.utm_xy(F.lit(40.3581), F.lit(-4.7389), 30)
    assert value(spark, x) == pytest.approx(352_343, abs=1) and value(spark, y) == pytest.approx(4_468_955, abs=1)
    lat, lon = geo.utm_to_degrees(x, y, 30)
    assert value(spark, lat) == pytest.approx(40.3581, abs=1e-7)
    assert value(spark, lon) == pytest.approx(-4.7389, abs=1e-7)


def test_hhmm_and_local_time(spark):
    for number, want in ((45, "00:45"), (0, "00:00"), (1200, "12:00")):
        got = times.hhmm_timestamp(F.lit("2026-07-27"), F.lit(number))
        assert value(spark, F.date_format(got, "HH:mm")) == want
    ambiguous = times.madrid_to_utc(F.lit("25/10/2026 02:30:00"))
    assert value(spark, times.iso_z(ambiguous)) == "2026-10-25T00:30:00Z"
    assert value(spark, times.madrid_to_utc(F.lit("ayer"))) is None


def test_vocabulary_edges(spark):
    assert [value(spark, domain.intensity(F.lit(v))) for v in (50.0, 50.1, 200.0, 800.0, 800.1)] == [
        "baja", "media", "media", "alta", "extrema"
    ]
    assert value(spark, domain.air_band(F.lit(20.0))) == "aceptable"
    assert value(spark, domain.air_band(F.lit(None).cast("double"))) == ""
    assert value(spark, domain.compass(F.lit(348.75))) == "N" and value(spark, domain.compass(F.lit(270.0))) == "O"
    assert value(spark, text.place_name(F.lit("SAN JUAN DE LA PEÑA-ALTA"))) == "San Juan de la Peña-Alta"
    assert value(spark, text.place_name(F.lit("DEL MONTE"))) == "Del Monte"
    assert value(spark, text.fold(F.lit(" Ávila "))) == "avila"
    assert value(spark, geo.angle_between(F.lit(350.0), F.lit(10.0))) == pytest.approx(20.0)


# --- cleaning ----------------------------------------------------------------------


def detections(spark, rows):
    ddl = "latitude double, longitude double, s string, source string, frp_mw double, instrument string, confidence_raw string, confidence_pct double"
    return spark.createDataFrame(rows, ddl).withColumn("acq_dt", F.col("s").cast("timestamp")).drop("s")


def test_mask_radius(spark):
    step = 1200.0 / 111_132.0
    hot = detections(
        spark,
        [(40.0 + step * k, -3.0, "2024-01-01 00:00:00", "a", 1.0, "VIIRS", "n", 60.0) for k in (0.5, 2.0)],
    )
    mask = spark.createDataFrame([("b", 40.0, -3.0), ("a", 40.0, -3.0)], "name string, latitude double, longitude double")
    kept = clean.apply_mask(hot, mask).collect()
    assert len(kept) == 1 and kept[0].latitude > 40.02
    assert clean.masked_by(hot, mask).select("excluded_by").head()[0] == "a"
    assert clean.apply_mask(hot, mask.limit(0)).count() == 2 and clean.apply_mask(hot, None).count() == 2


def test_dedup_keeps_strongest_of_same_hour(spark):
    hot = detections(
        spark,
        [
            (40.0, -3.5, "2024-01-01 10:05:00", "a", 1.0, "VIIRS", "n", 60.0),
            (40.0, -3.5, "2024-01-01 10:55:00", "b", 9.0, "VIIRS", "n", 60.0),
            (40.0, -3.5, "2024-01-01 11:00:00", "c", 2.0, "VIIRS", "n", 60.0),
            (40.01, -3.5, "2024-01-01 10:05:00", "d", 2.0, "VIIRS", "n", 60.0),
        ],
    )
    assert {r.source for r in clean.deduplicate_spatial(hot).collect()} == {"b", "c", "d"}


def test_confidence_split_loses_nothing(spark):
    hot = detections(
        spark,
        [
            (40.0, -3.0, NOW, "a", 1.0, "VIIRS", " N ", None), (40.0, -3.0, NOW, "b", 1.0, "VIIRS", "l", 99.0),
            (40.0, -3.0, NOW, "c", 1.0, "MODIS", "30", 30.0), (40.0, -3.0, NOW, "d", 1.0, "MODIS", "x", None),
        ],
    )
    good, low = clean.split_confidence(hot)
    assert {r.source for r in good.collect()} == {"a", "c"} and {r.source for r in low.collect()} == {"b", "d"}


# --- fusion ------------------------------------------------------------------------


def reports(spark, rows):
    ddl = "source_id string, external_id string, latitude double, longitude double, precision_m double, s string, status string"
    df = spark.createDataFrame(rows, ddl).withColumn("reported_at", F.col("s").cast("timestamp")).drop("s")
    return df.withColumns(
        {
            **{c: F.lit(None).cast("string") for c in ("municipio", "provincia", "raw_status")},
            "level": F.lit(1), "resources": F.lit("2 brigadas"), "detalle": F.lit(" "),
        }
    )


def fires(spark, rows):
    ddl = "fire_id string, lat double, lon double, s string, status string"
    df = spark.createDataFrame(rows, ddl).withColumn("last_detected", F.col("s").cast("timestamp")).drop("s")
    return df.withColumns(
        {
            "first_detected": F.col("last_detected"), "sensors": F.lit("VIIRS_SNPP_NRT"), "n_hotspots": F.lit(3).cast("long"),
            "frp_total_mw": F.lit(10.0), "intensity": F.lit("baja"), "area_est_ha": F.lit(42.0),
        }
    )


def test_nearest_is_chosen_before_the_tests(spark):
    """The nearest fire is too old, the second nearest would do: still no match."""
    official = reports(spark, [("x", "1", 40.0, -3.0, 6000.0, "2024-01-30 00:00:00", "activo")])
    f = fires(spark, [("old", 40.001, -3.0, "2024-01-01 00:00:00", "activo"), ("new", 40.01, -3.0, "2024-01-30 00:00:00", "activo")])
    assert fuse.match_reports(official, f).head()["fire_id"] is None


def test_contested_fire_and_incidents(spark):
    official = reports(
        spark,
        [
            ("x", "near", 40.001, -3.0, 500.0, "2024-01-30 00:00:00", "controlado"),
            ("x", "far", 40.02, -3.0, 500.0, "2024-01-30 00:00:00", "activo"),
            ("y", "other", 40.003, -3.0, 500.0, "2024-01-30 00:00:00", "activo"),
            ("z", "out", 42.0, -3.0, 500.0, "2024-01-30 00:00:00", "extinguido"),
        ],
    )
    f = fires(spark, [("f1", 40.0, -3.0, "2024-01-30 00:00:00", "activo"), ("f2", 43.0, -5.0, "2024-01-10 00:00:00", "inactivo")])
    matched, confirmed = fuse.match(official, f)
    assert {r.external_id: r.fire_id for r in matched.collect()} == {"near": "f1", "far": None, "other": "f1", "out": None}
    row = confirmed.where("fire_id = 'f1'").head()
    assert row.confirmed_by == "x,y" and row.official_status == "activo" and row.official_resources == "2 brigadas"
    inc = {r.id: r for r in fuse.build_incidents(matched, confirmed).collect()}
    assert set(inc) == {"f1", "off_x_far"} and inc["f1"].origin == "ambos" and not inc["off_x_far"].satellite_confirmed


def test_identical_reports_win_once(spark):
    fires = spark.createDataFrame([("f1", "2024-01-30 12:00:00", 40.0, -4.0)], "fire_id string, last_detected string, lat double, lon double")
    fires = fires.withColumn("last_detected", F.col("last_detected").cast("timestamp"))
    row = ("a", None, 40.001, -4.0, 100.0, "2024-01-30 13:00:00")
    reports = spark.createDataFrame(
        [row, row, ("b", "1", 40.002, -4.0, 100.0, "2024-01-30 13:00:00"), ("b", None, 40.002, -4.0, 100.0, "2024-01-30 13:00:00")],
        "source_id string, external_id string, latitude double, longitude double, precision_m double, reported_at string",
    ).withColumn("reported_at", F.col("reported_at").cast("timestamp"))
    found = fuse.match_reports(reports, fires).collect()
    assert sorted((r.source_id, r.fire_id) for r in found if r.fire_id) == [("a", "f1"), ("b", "f1")] and len(found) == 4


def test_no_power_is_no_intensity(spark):
    assert spark.range(1).select(domain.intensity(F.lit(None).cast("double"))).head()[0] is None


def test_satellite_only_states_no_status(spark):
    f = fires(spark, [("f1", 40.0, -3.0, "2024-01-30 00:00:00", "activo")])
    _, confirmed = fuse.match(empty(spark, schema("official")), f)
    row = fuse.build_incidents(fuse.match_reports(empty(spark, schema("official")), f), confirmed).head()
    assert row.status is None and row.origin == "satelite" and row.confirmed_by == ""


# --- context -------------------------------------------------------------------------


def test_null_is_not_zero(spark):
    inc = points(spark, [("a", 40.0, -3.0)])
    closures = spark.createDataFrame(
        [(43.0, -8.0, "A-1", None, True)], "latitude double, longitude double, carretera string, pk string, por_incendio boolean"
    )
    assert context.add_closures(inc, None).head()["cortes_cerca"] is None
    assert context.add_closures(inc, closures).head()["cortes_cerca"] == 0
    assert context.add_growth(inc, None, now()).head()["focos_recientes"] is None


def test_road_names_declared_first_and_counted(spark):
    inc = points(spark, [("a", 40.0, -3.0), ("copy", 40.0, -3.0)])
    closures = spark.createDataFrame(
        [(40.01, -3.0, n, pk, d) for n, pk, d in (("Z-9", "3", True), ("A-1", None, False), ("A-1", None, False), ("B-2", None, None), ("C-3", None, False), (None, None, True))],
        "latitude double, longitude double, carretera string, pk string, por_incendio boolean",
    )
    rows = context.add_closures(inc, closures).collect()
    assert len(rows) == 2 and rows[0].cortes_cerca == 6 and rows[0].cortes_cerca_por_incendio == 2
    assert rows[0].cortes_vias == "Z-9 pk 3 · A-1 · B-2 · y 1 más"


def test_wind_is_averaged_as_a_vector_and_far_nodes_are_silent(spark):
    ddl = "latitude double, longitude double, direction_to_deg double, speed_kmh double, gusts_kmh double, temp_c double, humedad_pct double"
    nodes = spark.createDataFrame([(40.1, -3.0, 350.0, 10.0, None, 20.0, 50.0), (39.9, -3.0, 10.0, 20.0, 30.0, 20.0, 50.0)], ddl)
    rows = {r.id: r for r in context.add_wind(points(spark, [("a", 40.0, -3.0), ("far", 43.9, 4.0)]), nodes, parity=True).collect()}
    assert rows["a"].viento_hacia_deg in (0.0, 360.0) and rows["a"].viento_kmh == 15.0
    assert rows["a"].viento_rachas_kmh == 15.0 and rows["far"].viento_kmh is None
    present = context.add_wind(points(spark, [("a", 40.0, -3.0)]), nodes).head()
    assert present.viento_rachas_kmh == 30.0


def test_nearest_settlement_against_brute_force(spark):
    rng = np.random.default_rng(3)
    inc = [(f"i{k}", float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(38, 42, 60), rng.uniform(-6, 0, 60)))]
    towns = [(f"t{k}", 10, float(a), float(o)) for k, (a, o) in enumerate(zip(rng.uniform(38, 40, 40), rng.uniform(-6, -3, 40)))]
    got = {r.id: (r.nucleo_cercano, r.nucleo_cercano_km) for r in context.add_settlements(
        points(spark, inc), spark.createDataFrame(towns, "nombre string, habitantes long, latitude double, longitude double")
    ).collect()}
    xy = {r.id: (r.x, r.y) for r in geo.with_utm(points(spark, inc), "lat", "lon", 30).collect()}
    txy = {r.id: (r.x, r.y) for r in geo.with_utm(points(spark, [(t[0], t[2], t[3]) for t in towns]), "lat", "lon", 30).collect()}
    for i, (x, y) in xy.items():
        d, name = min((math.hypot(x - a, y - b), n) for n, (a, b) in txy.items())
        want = (name, pytest.approx(d / 1000, abs=0.051)) if round(d / 1000, 1) <= 50 else (None, None)
        assert got[i] == want


def test_polygon_with_hole_and_territory_margin(spark):
    def ring(x0, y0, x1, y1):
        return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]

    layer = spark.createDataFrame(
        [("outer", [ring(-4.0, 39.0, -2.0, 41.0), ring(-3.2, 39.8, -2.8, 40.2)])],
        "name string, rings array<array<struct<x:double,y:double>>>",
    )
    pts = points(spark, [("in", 39.5, -3.5), ("hole", 40.0, -3.0), ("near", 41.1, -3.0), ("away", 42.0, -3.0)])
    got = {r.id: r.name for r in polygons.locate(pts, layer, [F.col("name")], ["name"], "lat", "lon").collect()}
    assert got == {"in": "outer", "hole": None, "near": None, "away": None}
    hot = pts.withColumnsRenamed({"lat": "latitude", "lon": "longitude"})
    kept = {r.id for r in polygons.clip_to_territory(hot, layer, 15_000.0).collect()}
    assert kept == {"in", "near"} | ({"hole"} if "hole" in kept else set()) and "away" not in kept
    assert polygons.clip_to_territory(hot, None, 15_000.0).count() == 4


# --- quality and exploration ------------------------------------------------------------


def test_every_violation_is_listed(spark):
    row = {"id": "a", "origin": "raro", "satellite_confirmed": False, "official_confirmed": None, "status": "activo",
           "n_hotspots": 0, "position_precision_m": None, "lat": 10.0, "lon": 0.0}
    bad = spark.createDataFrame([row, row], schema("incidents"))
    assert [r.invariant for r in quality.violations(bad).orderBy("invariant", "name").collect()] == [1, 2, 3, 5, 6, 7, 9]
    with pytest.raises(quality.PublicationAborted, match="incidente sin origen"):
        quality.validate_or_abort(bad)
    assert quality.violations(bad.drop("origin")).head()["invariant"] == 0


def test_emptiness_needs_a_meaningful_median(spark):
    runs = lambda n: spark.createDataFrame([(n, 1, f"2024-01-{d:02d}") for d in range(1, 31)], schema("runs"))
    current = spark.createDataFrame([(9,), (11,)], "hotspots long")
    flags = {r.hotspots: r.vaciado_sospechoso for r in quality.emptiness(current, runs(100)).collect()}
    assert flags == {9: True, 11: False}
    assert not quality.emptiness(current, runs(19)).where("vaciado_sospechoso").count()


def test_unknown_is_not_a_no(spark):
    q = explore.QUESTIONS[0]
    rows = spark.createDataFrame(
        [("y", "forestal", 1.0, 30.0), ("n", "forestal", 5.0, 30.0), ("u", "forestal", 1.0, None)],
        "id string, suelo_tipo string, nucleo_cercano_km double, viento_kmh double",
    )
    assert {r.id: r.a for r in rows.select("id", explore.answer(q).alias("a")).collect()} == {"y": "si", "n": "no", "u": "sin_dato"}


def test_exposure_reaches_any_distance(spark):
    inc = spark.createDataFrame([("near", 40.0, -3.0, 0.0), ("far", -30.0, 150.0, None)], "id string, lat double, lon double, viento_hacia_deg double")
    assets = spark.createDataFrame([(1, "n", 40.05, -3.0), (2, "s", 39.95, -3.0), (3, "x", -31.0, 170.0)], "asset_id int, nombre string, lat double, lon double")
    got = {r.asset_id: r for r in explore.exposure(assets, inc).collect()}
    assert got[1].incendio == "near" and got[1].a_sotavento and not got[2].a_sotavento
    assert got[3].incendio == "far" and got[3].a_sotavento is None and got[3].distancia_km > 1000


def test_hull_areas():
    r = 190.0
    disc = math.pi * r * r
    square = hull.convex_hull(np.array([[0, 0], [100, 0], [100, 100], [0, 100], [50, 50]], dtype=float))
    assert len(square) == 4
    assert hull.buffered_area_m2(square, 5, r) == pytest.approx(10_000 + 400 * r + disc)
    two = hull.convex_hull(np.array([[0.0, 0.0], [1000.0, 0.0]]))
    assert hull.buffered_area_m2(two, 2, r) == pytest.approx(2 * disc)
    assert hull.buffered_area_m2(two, 3, r) == pytest.approx(2 * r * 1000 + disc)
    assert len(hull.buffered_rings(two, 2, r)) == 2
    for shape, n in ((square, 5), (two, 3), (two[:1], 1)):
        (ring,) = hull.buffered_rings(shape, n, r)
        xy = np.array([[p["x"], p["y"]] for p in ring])
        area = 0.5 * float(np.sum(xy[:-1, 0] * xy[1:, 1] - xy[1:, 0] * xy[:-1, 1]))
        assert area == pytest.approx(hull.buffered_area_m2(shape, n, r), rel=0.002)
    assert hull.buffered_area_m2(hull.convex_hull(np.zeros((4, 2))), 4, r) == pytest.approx(disc)


def test_persistent_cells_count_days_not_detections(spark):
    rows = [(40.0, -3.0, f"2024-01-{d:02d} 01:00:00", "a", float(d), "VIIRS", "n", 60.0) for d in (1, 2, 3)]
    rows += [(41.0, -3.0, "2024-01-01 01:00:00", "a", 1.0, "VIIRS", "n", 60.0)] * 9
    cells = summaries.persistent_sources(detections(spark, rows), min_days=2).collect()
    assert [(c.active_days, c.detections, c.frp_median) for c in cells] == [(3, 3, 2.0)]
