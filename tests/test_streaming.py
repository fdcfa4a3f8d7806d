"""Keyed streaming state over small files that arrive one by one."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from firespark.operators import cluster
from firespark.operators.quality import PublicationAborted
from firespark.streaming import detections as D
from firespark.streaming.incremental import IncrementalFires
from firespark.streaming.ledger import guarded_writer, read_ledger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(spark, make, batches, ddl, tmp_path, mode="append"):
    """Feed the batches as files, one per trigger, and return what came out with its batch number."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        frame = spark.createDataFrame(rows, ddl).withColumn("acq_dt", F.col("t").cast("timestamp")).drop("t").coalesce(1)
        frame.write.mode("append").parquet(source)
        stream = D.arriving(spark, source, frame.schema, maxFilesPerTrigger="1")

        def write(batch, number):
            batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

        made = make(stream).writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", str(tmp_path / "ckpt"))
        made.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).collect()


def test_stable_ids_tell_fires_of_one_place_apart_and_forget(spark, tmp_path):
    day = "2024-01-{:02d} {:02d}:00:00".format
    batches = [
        [("f1", 40.000, -2.800, day(1, 0)), ("g1", 40.030, -2.800, day(1, 0))],
        [("f2", 40.001, -2.801, day(1, 12)), ("g2", 40.031, -2.800, day(1, 12))],
        [("late", 41.0, -3.0, day(20, 0))],
        [("f3", 40.001, -2.801, day(20, 1))],
    ]
    got = run(spark, lambda s: D.stable_ids(s, cell_m=50_000.0), batches, "fire_id string, latitude double, longitude double, t string", tmp_path)
    assert {r.fire_id: r.id_estable for r in got} == {"f1": "f1", "g1": "g1", "f2": "f1", "g2": "g1", "late": "late", "f3": "f3"}


def test_a_replayed_batch_leaves_one_row_and_the_guard_holds_back_an_emptying(spark, tmp_path):
    ledger, out = str(tmp_path / "ledger"), str(tmp_path / "out")

    def publish(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def rows(n):
        return spark.range(n).withColumn("at", F.lit(f"run of {n}"))

    write = guarded_writer(ledger, "q", publish, at=F.col("at"))
    other = guarded_writer(ledger, "other", publish, at=F.col("at"))
    for number, n in enumerate((100, 120, 90)):
        write(rows(n), number)
    other(rows(1), 3)
    with pytest.raises(PublicationAborted, match="median of the last 3 runs 100"):
        write(rows(9), 3)
    assert read_ledger(spark, ledger, "q").count() == 3
    # The first attempt of batch 1 is replayed after later ones: same row, same output.
    write(rows(120), 1)
    told = {r.batch: r for r in read_ledger(spark, ledger, "q").collect()}
    assert sorted(told) == [0, 1, 2] and (told[1].hotspots, told[1].mediana, told[1].ejecuciones) == (120, 100.0, 1)
    assert spark.read.parquet(f"{out}/batch=1").count() == 120
    passing = guarded_writer(ledger, "q", publish, at=F.col("at"), stop=False)
    passing(rows(0), 3)
    passing(rows(11), 4)
    told = {r.batch: r for r in read_ledger(spark, ledger, "q").collect()}
    assert told[3].vaciado_sospechoso and not told[3].publicado and told[3].at is None
    # An unpublished run isn't part of the median.
    assert (told[4].mediana, told[4].ejecuciones, told[4].publicado) == (100.0, 3, True)


DETECTION = "event_id long, latitude double, longitude double, acq_dt timestamp, area_key string, source string"


def grow(spark, root, batches, **options):
    fires = IncrementalFires(spark, root, key=["event_id"], **options)
    frames = []
    for number, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "event_id long, latitude double, longitude double, t string").select(
            "event_id", "latitude", "longitude", F.col("t").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key"), F.lit("V").alias("source")
        )
        frames.append(frame)
        fires.update(frame, number)
    return fires, frames


def at(east, hour, day=1):
    return (40.0, -3.0 + east * 0.01, f"2024-01-{day:02d} {hour:02d}:00:00")


def test_fires_grow_merge_and_keep_their_first_name(spark, tmp_path):
    # Two fires about 5 km apart; the third batch bridges them, the fourth grows the whole eastwards.
    batches = [
        [(1, *at(0, 0)), (2, *at(1, 1))], [(3, *at(6, 2)), (4, *at(30, 2))],
        [(5, *at(2, 3)), (6, *at(3, 3)), (7, *at(4, 3)), (8, *at(5, 3)), (2, *at(1, 1))], [(9, *at(7, 5)), (10, *at(8, 6))],
    ]
    fires, frames = grow(spark, str(tmp_path), batches)
    kept = {r.stable_id: r for r in fires.identities().collect()}
    assert sorted(r.n for r in kept.values()) == [1, 9]
    first = next(r for r in kept.values() if r.n == 9)
    alone, _ = grow(spark, str(tmp_path / "alone"), batches[:1])
    assert first.stable_id == alone.components().first().fire_id and first.born == 0 and first.fire_id != first.stable_id
    assert [(r.into, r.batch) for r in fires.ends().collect()] == [(first.stable_id, 2)]
    # A replay of the last batch changes nothing.
    before = sorted(map(str, fires.detections().collect()))
    fires.update(frames[3], 3)
    assert sorted(map(str, fires.detections().collect())) == before and len(before) == 10


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_is_the_same_as_one_clustering_after_every_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, 40 + rng.randrange(40) * 0.006, -3 + rng.randrange(12) * 0.008, f"2024-01-{rng.randrange(1, 8):02d} {rng.randrange(24):02d}:00:00") for i in range(150)]
    fires, seen = IncrementalFires(spark, str(tmp_path), key=["event_id"]), None
    for number in range(3):
        frame = spark.createDataFrame(rows[number * 50 : number * 50 + 50], "event_id long, latitude double, longitude double, t string").select(
            "event_id", "latitude", "longitude", F.col("t").cast("timestamp").alias("acq_dt"), F.lit("peninsula").alias("area_key"), F.lit("V").alias("source")
        )
        fires.update(frame, number)
        seen = frame if seen is None else seen.unionByName(frame)
        exact = {r.event_id: r.fire_id for r in cluster.assign_fire_ids(seen).select("event_id", "fire_id").collect()}
        assert {r.event_id: r.fire_id for r in fires.detections().select("event_id", "fire_id").collect()} == exact


def test_an_empty_batch_and_old_days(spark, tmp_path):
    fires, _ = grow(spark, str(tmp_path), [[(1, *at(0, 0, 1))], [], [(2, *at(0, 1, 20))]], window_days=3)
    assert [r.n for r in fires.components().collect()] == [1] and fires.detections().count() == 1


def test_a_silent_source_goes_stale(spark, tmp_path):
    """Processing time: a source that sends nothing for three times its period is told once, while the query runs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.createDataFrame([("s1", "2024-01-01 00:00:00"), ("s2", "2024-01-02 00:00:00")], "source string, t string")
    rows.select("source", F.col("t").cast("timestamp").alias("acq_dt")).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("source string, acq_dt timestamp").parquet(source)

    def write(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    query = D.source_watch(stream, ttl_seconds=1).writeStream.outputMode("update").foreachBatch(write).option(
        "checkpointLocation", str(tmp_path / "ckpt")
    ).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            query.awaitTermination(1)
            told = spark.read.schema("source string, status string, latest_ms long").parquet(out).collect() if (tmp_path / "out").exists() else []
            if sum(r.status == "stale" for r in told) == 2:
                break
    finally:
        query.stop()
    assert sorted((r.source, r.status) for r in told) == [("s1", "ok"), ("s1", "stale"), ("s2", "ok"), ("s2", "stale")]
    assert {r.source: r.latest_ms for r in told if r.status == "stale"}["s2"] - {r.source: r.latest_ms for r in told if r.status == "stale"}["s1"] == 86_400_000
