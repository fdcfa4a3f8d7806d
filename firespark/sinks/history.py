"""Append-only detection history, partitioned by acquisition day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark.operators.clean import DETECTION_KEY
from firespark.operators.rows import keep_first
from firespark.operators.summaries import day_partials
from firespark.session import materialise

DAY = "acq_date"


def merge_days(existing: DataFrame | None, new: DataFrame) -> DataFrame:
    """Union distinct on the detection key; the row already stored wins.

    The days of the batch, a few dates at most (its look-back), become a literal filter
    on the partition column, so other days of the history are not even listed.
    """
    fresh = new.withColumn(DAY, F.to_date("acq_dt")).withColumn("_fresh", F.lit(1))
    if existing is None:
        rows = fresh
    else:
        days = [row[0] for row in fresh.select(DAY).distinct().collect()]
        touched = existing.where(F.col(DAY).isin(days)).withColumn("_fresh", F.lit(0))
        rows = touched.unionByName(fresh, allowMissingColumns=True)
    return keep_first(rows, [*DETECTION_KEY, DAY], [F.col("_fresh")]).drop("_fresh")


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    """The stored history, or nothing when it does not exist yet."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path) or not fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{DAY}=*")):
        return None
    return spark.read.option("basePath", root).parquet(root)


def append_history(hotspots: DataFrame, root: str) -> DataFrame:
    """Idempotent append: only the days touched are read, merged and replaced.

    The merged days are stored before the overwrite, because they were read from the
    partitions about to be replaced.
    """
    spark = hotspots.sparkSession
    merged = materialise(merge_days(read_history(spark, root), hotspots))
    (
        merged.repartition(DAY, F.pmod(F.xxhash64("latitude", "longitude"), F.lit(16)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(root)
    )
    return merged


def append_with_partials(hotspots: DataFrame, root: str, partials: str) -> None:
    """Append to the history and work out anew what its touched days add to the persistent sources.

    Only the batch's days are read and written, in the history and in the partials, however
    long both are. A repeated batch leaves both as they were.
    """
    days = day_partials(append_history(hotspots, root))
    days.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(partials)
