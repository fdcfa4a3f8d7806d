"""Session defaults and the durable folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "firespark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive execution.

    On a cluster pass no ``master``: spark-submit decides. Shuffle partitions are
    left to adaptive coalescing; set an upper bound with ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        # A checkpoint goes when the table that it cut off is no longer referred to.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Times are UTC everywhere; make a borrowed session agree."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: the cluster's own, or a scratch one in local tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    path = os.environ.get("FIRESPARK_LOCAL_CHECKPOINTS")
    if not path:
        path = tempfile.mkdtemp(prefix="spark-")
        os.environ["FIRESPARK_LOCAL_CHECKPOINTS"] = path
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any store that Spark can reach."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and read from there afterwards.

    Reliable checkpointing survives the loss of any executor and keeps the plan of
    an iterative job from growing with the number of rounds.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged, never sent whole through the driver.

    For tables whose rows multiply (cells around a point, pieces of an edge): the planner's
    estimate stays that of the small files they come from, and it would broadcast them.
    """
    return df.hint("merge")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: wide tables take a fraction of a checkpoint's bytes there.

    Later plans know its size from the files. Row order is not kept.
    """
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
