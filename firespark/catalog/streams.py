"""Streaming forms of the operators, run to completion over the landed table.

Each query writes the projected detections as files, streams them in several
micro-batches and returns what the stream produced.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark import config as C
from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.catalog.feeds import scratch
from firespark.functions import times
from firespark.plans import projections as P
from firespark.sinks import history
from firespark.streaming import detections as D
from firespark.streaming.incremental import IncrementalFires, fires_writer
from firespark.streaming.ledger import guarded_writer, read_ledger

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _landed(spark, df, name: str, files: int = 4) -> tuple[str, object]:
    path = scratch(spark, name)
    df.repartitionByRange(files, "acq_dt").write.parquet(path)
    return path, spark.read.parquet(path).schema


def _drain(spark, stream, name: str, mode: str):
    """Run the stream over everything landed, into a table of files."""
    out = scratch(spark, f"out-{name}")

    def write(batch, batch_id):
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", scratch(spark, f"ckpt-{name}")).trigger(availableNow=True).start()
        .awaitTermination()
    )
    return spark.read.parquet(out)


@register("stream_dedup_within_watermark", S.query(S.HOT, """
  SELECT event_id FROM hot QUALIFY row_number() OVER (PARTITION BY latitude, longitude, acq_dt, source ORDER BY event_id) = 1"""))
def stream_dedup_within_watermark(spark, sf):
    rows = P.hotspots(spark, sf)
    twice = rows.unionByName(rows)
    path, layout = _landed(spark, twice, "twice", 6)
    stream = D.arriving(spark, path, layout)
    return _drain(spark, D.deduplicated(stream), "dedup", "update").select("event_id")


@register("stream_daily_counts", S.query(S.HOT, """
  SELECT strftime(acq_dt, '%Y-%m-%d') AS dia, count(*) AS focos FROM hot GROUP BY 1"""))
def stream_daily_counts(spark, sf):
    path, layout = _landed(spark, P.hotspots(spark, sf), "daily")
    out = _drain(spark, D.daily_counts(D.arriving(spark, path, layout)), "daily", "update")
    last = out.groupBy("dia").agg(F.max_by("focos", "batch").alias("focos"))
    return last.select(F.date_format("dia.start", "yyyy-MM-dd").alias("dia"), "focos")


@register("stream_hourly_cells", S.query(f"{S.HOT}, {S.utm('m', 'hot')}", f"""
  SELECT CAST(floor(x / 2e2) AS BIGINT) AS cx, CAST(floor(y / 2e2) AS BIGINT) AS cy, {S.iso('acq_dt')} AS hora, max(frp_mw) AS frp_mw, count(*) AS n
  FROM m GROUP BY 1, 2, 3"""))
def stream_hourly_cells(spark, sf):
    path, layout = _landed(spark, P.hotspots(spark, sf), "hourly")
    out = _drain(spark, D.hourly_cells(D.arriving(spark, path, layout)), "hourly", "update")
    last = out.groupBy("hora", "cx", "cy").agg(F.max_by(F.struct("frp_mw", "n"), "batch").alias("v"))
    return last.select("cx", "cy", times.iso_z(F.col("hora.start")).alias("hora"), "v.frp_mw", "v.n")


@register("stream_growth_windows", S.query(S.CLUSTERED, f"""
  SELECT fire_id, {S.iso("w")} AS inicio, count(*) AS focos, round_even(count(*) * 1.406e1 / 6e0, 1) AS ha_h
  FROM (SELECT fire_id, unnest(range(acq_dt - INTERVAL 330 MINUTES, acq_dt + INTERVAL 1 MINUTES, INTERVAL 30 MINUTES)) AS w FROM burned) GROUP BY 1, 2"""))
def stream_growth_windows(spark, sf):
    path, layout = _landed(spark, stages.burned(spark, sf), "growth")
    out = _drain(spark, D.growth_windows(D.arriving(spark, path, layout)), "growth", "update")
    last = out.groupBy("fire_id", "ventana").agg(F.max_by(F.struct("focos", "ha_h"), "batch").alias("v"))
    return last.select("fire_id", times.iso_z(F.col("ventana.start")).alias("inicio"), "v.focos", "v.ha_h")


@register("stream_fire_lives", S.query(S.CLUSTERED, f"""
  SELECT fire_id, count(*) AS n, {S.iso('max(acq_dt)')} AS ultima,
    CASE WHEN max(acq_dt) + INTERVAL 24 HOURS <= (SELECT max(acq_dt) FROM burned) - INTERVAL {C.LOOKBACK_DAYS} DAYS THEN 'inactivo' ELSE 'activo' END AS estado
  FROM burned GROUP BY 1"""))
def stream_fire_lives(spark, sf):
    """Detections per fire, the last one seen, and whether 24 quiet hours have closed it.

    All that has landed is one batch; the watermark that it leaves behind closes fires in the next.
    """
    path, layout = _landed(spark, stages.burned(spark, sf), "lives")
    out = _drain(spark, D.fire_lives(D.arriving(spark, path, layout)), "lives", "update")
    closed = F.max(F.when(F.col("status") == "inactivo", F.col("n")))
    lives = out.groupBy("fire_id").agg(F.max("n").alias("n"), F.max("last_ms").alias("last_ms"), closed.alias("closed"))
    return lives.select(
        "fire_id", "n", times.iso_z(F.timestamp_millis("last_ms")).alias("ultima"),
        F.when(F.col("closed") == F.col("n"), "inactivo").otherwise("activo").alias("estado"),
    )


@register("stream_activity_sessions", S.query(f"{S.HOT}, {S.utm('m', 'hot')}", f"""
  , p AS (SELECT CAST(floor(x / 5e3) AS BIGINT) AS cx, CAST(floor(y / 5e3) AS BIGINT) AS cy, acq_dt, frp_mw FROM m),
  g AS (SELECT *, acq_dt > lag(acq_dt) OVER w + INTERVAL 24 HOURS AS starts FROM p WINDOW w AS (PARTITION BY cx, cy ORDER BY acq_dt)),
  s AS (SELECT *, count(*) FILTER (starts) OVER (PARTITION BY cx, cy ORDER BY acq_dt) AS run FROM g)
  SELECT cx, cy, {S.iso('min(acq_dt)')} AS inicio, {S.iso('max(acq_dt) + INTERVAL 24 HOURS')} AS fin, count(*) AS focos, round(sum(frp_mw), 3) AS frp_mw
  FROM s GROUP BY cx, cy, run HAVING max(acq_dt) + INTERVAL 24 HOURS <= (SELECT max(acq_dt) FROM hot) - INTERVAL {C.LOOKBACK_DAYS} DAYS"""))
def stream_activity_sessions(spark, sf):
    """Sessions that the watermark has closed; open ones are still in the state."""
    path, layout = _landed(spark, P.hotspots(spark, sf), "sessions")
    out = _drain(spark, D.activity_sessions(D.arriving(spark, path, layout)), "sessions", "append")
    return out.select(
        "cx", "cy", times.iso_z(F.col("sesion.start")).alias("inicio"), times.iso_z(F.col("sesion.end")).alias("fin"), "focos",
        F.round("frp_mw", 3).alias("frp_mw"),
    )


def _arrivals(batch: str) -> str:
    """When each detection arrives, as a condition on its batch number: two halves of the month, then late ones."""
    return f"(CASE WHEN event_id % 4 = 0 THEN 2 WHEN acq_dt < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END) {batch}"


def _grown(spark, sf, name: str) -> IncrementalFires:
    """Clean detections streamed in three arrivals into incremental fires."""
    rows = stages.clean(spark, sf)
    path, ckpt = scratch(spark, f"arrivals-{name}"), scratch(spark, f"ckpt-{name}")
    fires = IncrementalFires(spark, scratch(spark, f"fires-{name}"), key=["event_id"])
    for number in range(3):
        rows.where(_arrivals(f"= {number}")).write.mode("append").parquet(path)
        D.arriving(spark, path, rows.schema).writeStream.foreachBatch(fires_writer(fires)).option("checkpointLocation", ckpt).trigger(
            availableNow=True
        ).start().awaitTermination()
    return fires


@register("stream_fires", S.query(S.CLUSTERED, "SELECT event_id, fire_id FROM burned"))
def stream_fires(spark, sf):
    """Components grown from batch to batch, late detections and merging fires included: the same as one clustering."""
    return _grown(spark, sf, "fires").detections().select("event_id", "fire_id")


def _snapshot(k: int) -> str:
    """CTEs of the clustering of all that has arrived up to batch ``k``, with a seed per component."""
    labels = S.components(f"p{k}", f"edge{k}").replace("label", f"label{k}")
    return f"""p{k} AS (SELECT * FROM pts WHERE {_arrivals(f"<= {k}")}), {labels},
      s{k} AS (SELECT {k} AS k, root, list(event_id) AS members, min({_arrivals("")}) AS newest,
        substr(sha1(printf('%.3f', sum(CAST(round(latitude * 1e7) AS BIGINT)) / (count(*) * 1e7)) || '|' ||
          printf('%.3f', sum(CAST(round(longitude * 1e7) AS BIGINT)) / (count(*) * 1e7)) || '|' || strftime(min(acq_dt), '%Y-%m-%d')), 1, 10) AS id,
        count(*) AS n FROM p{k} JOIN label{k} USING (event_id) GROUP BY root)"""


BORN = f"""{S.POINTS}, {", ".join(_snapshot(k) for k in range(3))},
  born AS (SELECT k, id, members[1] AS event_id FROM (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2) WHERE newest = k),
  family AS (SELECT root, k, id, row_number() OVER (PARTITION BY root ORDER BY k, id) AS age FROM born JOIN label2 USING (event_id))"""


@register("stream_stable_ids", S.query(BORN, """
  SELECT f.id AS id_estable, CAST(f.k AS BIGINT) AS nacido, s2.id AS fire_id, s2.n AS focos FROM family f JOIN s2 USING (root) WHERE age = 1"""))
def stream_stable_ids(spark, sf):
    """The first name of every fire that lives: the oldest one of those that grew into it."""
    lives = _grown(spark, sf, "identities").identities()
    return lives.select(F.col("stable_id").alias("id_estable"), F.col("born").alias("nacido"), "fire_id", F.col("n").alias("focos"))


@register("stream_identity_ends", S.query(BORN, "SELECT id AS id_estable FROM family WHERE age > 1"))
def stream_identity_ends(spark, sf):
    """Identities that ended in an older fire."""
    return _grown(spark, sf, "ends").ends().select(F.col("stable_id").alias("id_estable"))


RUN = "least(CAST(floor((epoch_us(acq_dt) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 2.592e11) AS INT), 9)"


@register("stream_run_counters", S.query(f"""{S.HOT},
  runs AS (SELECT k, count(*) AS hotspots, {S.iso('max(acq_dt)')} AS momento FROM (SELECT *, {RUN} AS k FROM hot)
    WHERE k <> 6 OR event_id % 50 = 0 GROUP BY 1),
  turn AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM runs),
  told(i, lote, momento, hotspots, mediana, ejecuciones, past) AS (SELECT 0, CAST(NULL AS BIGINT), '', CAST(0 AS BIGINT), 0e0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL
    SELECT r.i, r.i - 1, r.momento, r.hotspots, m, CAST(len(recent) AS BIGINT), CASE WHEN m >= 20 AND r.hotspots <= m * (1 - 9e-1) THEN past ELSE list_append(past, r.hotspots) END
    FROM (SELECT *, past[-24:] AS recent, coalesce(list_aggregate(past[-24:], 'median'), 0e0) AS m FROM told) t JOIN turn r ON r.i = t.i + 1)""", """
  SELECT lote, momento, hotspots, mediana, ejecuciones, mediana >= 20 AND hotspots <= mediana * (1 - 9e-1) AS vaciado_sospechoso,
    NOT (mediana >= 20 AND hotspots <= mediana * (1 - 9e-1)) AS publicado FROM told WHERE i > 0"""))
def stream_run_counters(spark, sf):
    """Ten runs in the ledger, one of which brings a fiftieth of its detections and isn't published."""
    rows = P.hotspots(spark, sf)
    elapsed = F.floor((F.unix_micros("acq_dt") - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 2.592e11)
    rows = rows.withColumn("k", F.least(elapsed, F.lit(9)).cast("int")).where("k <> 6 or event_id % 50 = 0")
    path, ckpt = scratch(spark, "runs"), scratch(spark, "ckpt-runs")
    ledger, out = scratch(spark, "ledger"), scratch(spark, "out-runs")

    def publish(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    write = guarded_writer(ledger, "detections", publish, at=times.iso_z(F.col("acq_dt")), stop=False)
    for k in range(10):
        rows.where(F.col("k") == k).drop("k").write.mode("append").parquet(path)
        D.arriving(spark, path, rows.drop("k").schema).writeStream.foreachBatch(write).option("checkpointLocation", ckpt).trigger(
            availableNow=True
        ).start().awaitTermination()
    return read_ledger(spark, ledger, "detections").select(
        F.col("batch").alias("lote"), F.col("at").alias("momento"), "hotspots", "mediana", "ejecuciones", "vaciado_sospechoso", "publicado"
    )


@register("stream_unexpired_warnings", S.query(P.SQL_AREAS, """
  SELECT 'w' || CAST(area_id AS VARCHAR) AS id FROM areas WHERE area_id % 3 <> 1"""))
def stream_unexpired_warnings(spark, sf):
    """Warnings that haven't ended at the clock of their batch; one without a readable end stays."""
    end = F.when(F.col("area_id") % 3 == 0, "2024-01-31T01:00:00+01:00").when(F.col("area_id") % 3 == 1, "2024-01-30T23:59:59Z").otherwise("sin fin")
    rows = P.areas(spark, sf).select(F.concat(F.lit("w"), F.col("area_id").cast("string")).alias("id"), end.alias("expires"))
    path = scratch(spark, "expiring")
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return _drain(spark, D.unexpired(stream, P.now()), "expiring", "append").select("id")


@register("stream_history_merge", S.query(S.HOT, """
  SELECT strftime(acq_dt, '%Y-%m-%d') AS dia, source, count(*) AS n FROM hot GROUP BY 1, 2"""))
def stream_history_merge(spark, sf):
    rows = P.hotspots(spark, sf)
    path, layout = _landed(spark, rows.unionByName(rows), "merge", 3)
    root = scratch(spark, "stream-history")
    (
        D.arriving(spark, path, layout, maxFilesPerTrigger="1").writeStream.foreachBatch(D.history_writer(root))
        .option("checkpointLocation", scratch(spark, "ckpt-merge")).trigger(availableNow=True).start()
        .awaitTermination()
    )
    stored = history.read_history(spark, root)
    return stored.groupBy(F.date_format("acq_dt", "yyyy-MM-dd").alias("dia"), "source").agg(F.count("*").alias("n"))


@register("stream_report_match", S.query(f"{S.FIRES}, {P.SQL_OFFICIAL}, {S.utm('o', 'official')}, {S.utm('f', 'fires', '30', 'lat', 'lon')}", """
  , c AS (SELECT o.source_id, o.external_id, f.fire_id, sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) AS d FROM o LEFT JOIN f
    ON abs(o.x - f.x) <= 1.5e4 AND abs(o.y - f.y) <= 1.5e4 AND sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y)) <= least(precision_m + 3e3, 1.5e4)
    AND abs(epoch_us(o.reported_at) - epoch_us(f.last_detected)) <= 48 * 3.6e9)
  SELECT source_id, external_id, fire_id, round_even(d, 0) AS match_distance_m FROM c
  QUALIFY row_number() OVER (PARTITION BY source_id, external_id ORDER BY round(d, 3), fire_id) = 1"""))
def stream_report_match(spark, sf):
    """One row per report from a stream-stream join, closed by a last late row on each side."""
    reports = P.official(spark, sf).select("source_id", "external_id", "reported_at", "latitude", "longitude", "precision_m")
    fires = stages.fires(spark, sf).select("fire_id", "last_detected", "lat", "lon")
    far = F.lit("2025-01-01").cast("timestamp")
    r_path, f_path = scratch(spark, "reports"), scratch(spark, "fires")
    reports.write.parquet(r_path)
    fires.write.parquet(f_path)
    left = spark.readStream.schema(spark.read.parquet(r_path).schema).parquet(r_path)
    right = spark.readStream.schema(spark.read.parquet(f_path).schema).parquet(f_path)
    joined = D.matched_in_time(
        left.withWatermark("reported_at", "1 day"), right.withWatermark("last_detected", "1 day")
    )
    out_path, ckpt = scratch(spark, "out-match"), scratch(spark, "ckpt-match")

    def drain() -> None:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        (
            joined.writeStream.outputMode("append").format("parquet").option("path", out_path)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start().awaitTermination()
        )

    drain()
    # A later arrival on both sides moves the watermark, so unmatched reports are released.
    late_report = reports.limit(1).withColumns({"external_id": F.lit("cierre"), "reported_at": far})
    late_fire = fires.limit(1).withColumns({"fire_id": F.lit("cierre"), "last_detected": far})
    late_report.write.mode("append").parquet(r_path)
    late_fire.write.mode("append").parquet(f_path)
    drain()
    return spark.read.parquet(out_path).where("external_id <> 'cierre'").select("source_id", "external_id", "fire_id", "match_distance_m")
