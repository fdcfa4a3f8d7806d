"""Work that grows with distinct places and outlines, not with their copies; whole pairs; repeatable choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.operators import cluster, context, explore, fuse, polygons, summaries
from firespark.streaming import detections as D
from firespark.streaming import incremental
from firespark.streaming.incremental import IncrementalFires

RINGS = "area_id long, rings array<array<struct<x:double,y:double>>>"


def plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def slanted(i: int, size: float):
    return (i, [[(-3.0, 39.0), (-3.0 + size, 39.0 + size), (-3.0, 39.0 + size), (-3.0, 39.0)]])


def spots(spark, rows):
    return spark.createDataFrame(rows, "latitude double, longitude double")


def test_edges_of_copies_are_one_and_long_edges_follow_their_cells(spark):
    one, many = spark.createDataFrame([slanted(0, 2.0)], RINGS), spark.createDataFrame([slanted(i, 2.0) for i in range(40)], RINGS)
    cells = polygons._metric_segments(one, 2_000.0).count()
    assert polygons._metric_segments(many, 2_000.0).count() == cells
    # The box of the slanted edge alone has over 8 000 cells.
    assert cells < 4_000


def test_edges_near_places_are_not_broadcast_by_estimate(spark):
    places = spots(spark, [(40.0, -2.01), (39.9, -2.0), (45.0, 0.0)])
    layer = spark.createDataFrame([slanted(i, 2.0) for i in range(3)], RINGS)
    near = polygons.territory_places(places, layer, 15_000.0)
    semi = [line for line in plan(near).splitlines() if "LeftSemi" in line]
    assert semi and not any("Broadcast" in line for line in semi)
    assert {r.latitude for r in near.collect()} == {40.0, 39.9}


def test_margin_reaches_all_points_along_a_slanted_edge(spark):
    layer = spark.createDataFrame([slanted(0, 2.0)], RINGS)
    # To the right of the edge, about 11.3 km (inside the margin) and 17 km (outside of it) away.
    rows = [(39.2 + 0.05 * i, -2.8 + 0.05 * i + d, d) for i in range(30) for d in (0.15, 0.30)]
    places = spark.createDataFrame(rows, "latitude double, longitude double, d double")
    kept = polygons.clip_to_territory(places, layer, 15_000.0).groupBy("d").count().collect()
    assert {r.d: r["count"] for r in kept} == {0.15: 30}


def test_first_of_polygons_of_one_outline(spark):
    layer = spark.createDataFrame([slanted(i, 2.0) for i in (7, 3, 5)], RINGS)
    places = spots(spark, [(40.5, -2.9)])
    found = polygons.locate_places(places, layer, [F.col("area_id")], ["area_id"])
    assert [r.area_id for r in found.collect()] == [3]


def test_cells_round_a_batch_are_not_broadcast(spark, tmp_path):
    fires = IncrementalFires(spark, str(tmp_path / "fires"), key=["event_id"])
    rows = spark.range(20).select(
        F.col("id").alias("event_id"), (F.lit(40.0) + F.col("id") * 0.05).alias("latitude"), F.lit(-3.0).alias("longitude"),
        F.lit("2024-01-10 00:00:00").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key"),
    )
    fires.update(rows.where("event_id < 15"), 0)
    stored, fresh = fires._read("points", 1), fires._read("points", 1).where("event_id > 3")
    semi = [line for line in plan(fires._near(stored, fresh, 1)).splitlines() if "LeftSemi" in line]
    assert semi and not any("Broadcast" in line for line in semi)


def test_fires_grow_without_broadcasting_what_grows_with_the_batch(spark, tmp_path, monkeypatch):
    plans = []

    def watch(owner, name, at):
        real = getattr(owner, name)
        monkeypatch.setattr(owner, name, lambda *args, **kw: plans.append(plan(args[at])) or real(*args, **kw))

    for owner in (incremental, cluster):
        watch(owner, "materialise", 0)
    watch(cluster, "stored", 0)
    watch(IncrementalFires, "_write", 1)
    # A range has a small estimate, as a small file has, whatever is made of it.
    rows = spark.range(60).select(
        F.col("id").alias("event_id"), (F.lit(40.0) + F.col("id") * 0.01 + F.floor(F.col("id") / 20) * 0.5).alias("latitude"), F.lit(-3.0).alias("longitude"),
        F.lit("2024-01-10 00:00:00").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key"),
    )
    fires = IncrementalFires(spark, str(tmp_path / "fires"), key=["event_id"])
    fires.update(rows.where("event_id % 2 = 0"), 0)
    fires.update(rows, 1)
    sent = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    # Only maps of labels, whose size their own files tell.
    assert [line for line in sent if "cell" in line or "cx" in line or "_a" in line or "_b" in line or "event_id" in line] == []
    found = {r.event_id: r.fire_id for r in fires.detections().collect()}
    assert found == {r.event_id: r.fire_id for r in cluster.assign_fire_ids(rows).collect()} and len(set(found.values())) == 3


def test_nodes_of_one_spot_are_one_element(spark):
    nodes = [(40.0 + i % 3, -3.0, 10.0 + i, float(i * 30 % 360)) for i in range(60)]
    wind = spark.createDataFrame(nodes, "latitude double, longitude double, speed_kmh double, direction_to_deg double")
    blocks = context._node_blocks(wind, [F.count("*").alias("n")])
    assert [len(r["_nodes"]) for r in blocks.collect()] == [3]
    targets = spark.createDataFrame([(str(i), 40.5, -3.5) for i in range(5)] + [("on", 41.0, -3.0)], "name string, latitude double, longitude double")
    got = {r.name: r.speed_kmh for r in context.sample_wind_field(targets, wind).collect()}
    d2 = [(40.5 - lat) ** 2 + (-3.5 - lon) ** 2 for lat, lon, *_ in nodes]
    want = sum(n[2] / d for n, d in zip(nodes, d2)) / sum(1 / d for d in d2)
    assert len(got) == 6 and all(abs(got[str(i)] - want) < 1e-9 for i in range(5))
    assert got["on"] in {n[2] for n in nodes if n[0] == 41.0}


def test_reports_on_one_place_ask_once_for_their_fire(spark, monkeypatch):
    asked = []
    real = fuse.nearest
    monkeypatch.setattr(fuse, "nearest", lambda probes, *a: asked.append(probes.count()) or real(probes, *a))
    rows = [("s", str(i), 40.0 + i % 2 * 0.01, -3.0, 500.0, "2024-01-30 00:00:00") for i in range(50)]
    official = spark.createDataFrame(rows, "source_id string, external_id string, latitude double, longitude double, precision_m double, t string")
    official = official.withColumn("reported_at", F.col("t").cast("timestamp")).drop("t")
    fires = spark.createDataFrame([("f", 40.0, -3.0)], "fire_id string, lat double, lon double").withColumn("last_detected", F.lit("2024-01-30").cast("timestamp"))
    got = fuse.match_reports(official, fires).collect()
    assert asked == [2] and len(got) == 50
    assert [(r.external_id, r.match_distance_m) for r in got if r.fire_id] == [("0", 0.0)]


def test_reports_are_matched_where_they_stand(spark, monkeypatch):
    kept = {}
    real = fuse.stored
    monkeypatch.setattr(fuse, "stored", lambda df, name: kept.update({name: df}) or real(df, name))
    # Three that tie for the fire, with two copies each, then four copies of a loser, a late one and one without a place.
    rows = [("s", "1", 40.0, -3.0, f"detail {i % 3}") for i in range(6)] + [("s", "2", 40.01, -3.0, None)] * 4 + [(None, None, 40.01, -3.0, None)] * 2
    rows += [("s", None, None, -3.0, None)]
    official = spark.createDataFrame(rows, "source_id string, external_id string, latitude double, longitude double, detalle string")
    official = official.withColumns({"precision_m": F.lit(500.0), "reported_at": F.lit("2024-01-30").cast("timestamp")})
    late = official.where("external_id = '2'").limit(1).withColumn("reported_at", F.lit("2024-01-10").cast("timestamp"))
    fires = spark.createDataFrame([("f", 40.0, -3.0)], "fire_id string, lat double, lon double").withColumn("last_detected", F.lit("2024-01-30").cast("timestamp"))
    got = fuse.match_reports(official.unionByName(late), fires).collect()
    assert "Aggregate" not in plan(kept["near"])
    assert sorted((str(r.source_id), str(r.external_id)) for r in got if r.fire_id) == [("None", "None"), ("s", "1")]
    told = sorted((str(r.external_id), str(r.detalle), str(r.reported_at)[:10]) for r in got)
    want = sorted([("1", f"detail {i % 3}", "2024-01-30") for i in range(6)] + [("2", "None", "2024-01-30")] * 4 + [("None", "None", "2024-01-30")] * 3 + [("2", "None", "2024-01-10")])
    assert told == want
    assert [r for r in got if (r.fire_id is None) != (r.match_distance_m is None)] == []


def test_assets_on_one_spot_ask_once_for_their_incident(spark, monkeypatch):
    asked = []
    real = explore.nearest
    monkeypatch.setattr(explore, "nearest", lambda probes, *a: asked.append(probes.count()) or real(probes, *a))
    rows = [(i, f"n{i}", 40.0 + i % 2 * 0.5, -3.0) for i in range(40)] + [(40, "nowhere", None, -3.0), (40, "again", 40.5, -3.0)]
    assets = spark.createDataFrame(rows, "asset_id int, nombre string, lat double, lon double")
    inc = spark.createDataFrame([("a", 40.0, -3.1, 90.0), ("b", 40.6, -3.0, None)], "id string, lat double, lon double, viento_hacia_deg double")
    got = explore.exposure(assets, inc).collect()
    assert asked[0] <= 3 and len(got) == 42
    assert {r.nombre: r.incendio for r in got} == {n: None if lat is None else "a" if lat == 40.0 else "b" for _, n, lat, _ in rows}


def test_overlaps_of_copies_are_all_told(spark):
    boxes = [(0, 0.0, 0.0, 2.0, 2.0), (1, 1.5, 1.5, 3.5, 3.5), (2, 0.0, 0.0, 2.0, 2.0), (3, 9.0, 9.0, 9.5, 9.5), (4, 1.5, 1.5, 3.5, 3.5), (5, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "id long, west double, south double, east double, north double")
    got = sorted((r.a, r.b) for r in summaries.box_overlaps(df).collect())
    assert got == [(0, 1), (0, 2), (0, 4), (1, 2), (1, 4), (2, 4)]


def test_stream_keeps_the_first_of_a_batch_and_tells_a_key_once(spark, tmp_path):
    layout = "event_id long, latitude double, longitude double, acq_dt timestamp, source string"
    landed, out, ckpt = (str(tmp_path / n) for n in ("landed", "out", "ckpt"))
    at = F.lit("2024-01-10 00:00:00").cast("timestamp")

    def land(ids):
        df = spark.createDataFrame([(i,) for i in ids], "event_id long").repartition(len(ids))
        df.select("event_id", F.lit(1.0).alias("latitude"), (F.col("event_id") % 3).cast("double").alias("longitude"), at.alias("acq_dt"), F.lit("s").alias("source")).write.mode("append").parquet(landed)
        stream = D.deduplicated(D.arriving(spark, landed, spark.createDataFrame([], layout).schema))
        stream.writeStream.outputMode("update").foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).option(
            "checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()

    land([11, 7, 9, 4, 13])
    land([1, 2, 3, 5])
    # Keys 0, 1 and 2 of the first batch: 9, 4 (of 4, 7 and 13) and 11.
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [4, 9, 11]
