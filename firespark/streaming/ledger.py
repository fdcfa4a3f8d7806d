"""Run counters of a stream and the guard that reads them.

Each micro-batch leaves one row in a ledger, keyed by query and batch. A replayed batch
overwrites its own row and its own output, so a crash between the two leaves no trace.
The guard compares a batch with the median of the runs before it and publishes nothing
when the number of detections collapses: an empty source isn't an absence of fires.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.operators.quality import PublicationAborted
from firespark.session import materialise, path_exists

LAYOUT = "at string, hotspots long, mediana double, ejecuciones long, vaciado_sospechoso boolean, publicado boolean, query string, batch long"


def read_ledger(spark: SparkSession, root: str, query: str) -> DataFrame:
    """One row per batch of a query; no ledger yet is an empty one."""
    if not path_exists(spark, root):
        return spark.createDataFrame([], LAYOUT)
    return spark.read.schema(LAYOUT).option("basePath", root).json(root).where(F.col("query") == query)


def past_median(ledger: DataFrame, before: int, keep: int = C.RUN_HISTORY) -> tuple[float, int]:
    """Median detections and number of the last ``keep`` published runs before a batch.

    Replays read what the batch read at first: later rows and its own don't count.
    """
    recent = ledger.where(F.col("publicado") & (F.col("batch") < before)).orderBy(F.desc("batch")).limit(keep)
    row = recent.agg(F.coalesce(F.median("hotspots"), F.lit(0.0)).alias("m"), F.count("*").alias("n")).first()
    return float(row.m), int(row.n)


def suspicious(hotspots: int, median: float) -> bool:
    return median >= C.MIN_MEDIAN_RUNS and hotspots <= median * (1.0 - C.EMPTINESS_DROP_RATIO)


def guarded_writer(
    root: str, query: str, publish: Callable[[DataFrame, int], None], at: Column | None = None, stop: bool = True
) -> Callable[[DataFrame, int], None]:
    """Micro-batch sink: count, compare, publish, and enter the run in the ledger, in that order.

    ``publish(batch, batch_id)`` must overwrite what an earlier attempt of the same batch left.
    The batch is stored once and counted in the pass that stores it. A suspicious batch ends
    the query (``stop``), so that it is tried again on the next start, or is entered as not
    published and passed over. ``at`` names the run; by default it is the current time.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = Observation(f"{query}-{batch_id}")
        named = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if at is None else at
        counted = materialise(batch.observe(seen, F.count("*").alias("hotspots"), F.max(named).alias("at")))
        hotspots, stamp = seen.get["hotspots"], seen.get["at"]
        median, runs = past_median(read_ledger(spark, root, query), batch_id)
        doubtful = suspicious(hotspots, median)
        if doubtful and stop:
            raise PublicationAborted(f"batch {batch_id}: {hotspots} detections, median of the last {runs} runs {median:g}; nothing published")
        if not doubtful:
            publish(counted, batch_id)
        row = spark.createDataFrame(
            [(stamp, hotspots, median, runs, doubtful, not doubtful)],
            "at string, hotspots long, mediana double, ejecuciones long, vaciado_sospechoso boolean, publicado boolean",
        )
        row.coalesce(1).write.mode("overwrite").json(f"{root}/query={query}/batch={batch_id}")

    return write
