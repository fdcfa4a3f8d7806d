"""Publication: stage everything, then switch one pointer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.operators.quality import PublicationAborted, last_runs
from firespark.operators.rows import conform, empty
from firespark.schemas import schema
from firespark.session import path_exists

POINTER = "current"


def publish(
    spark: SparkSession, root: str, run_id: str, steps: list[tuple[str, Callable[[str], None]]]
) -> str:
    """Run every step into ``root/runs/run_id`` and point readers at it last.

    A step that fails leaves the pointer alone, so readers keep the previous run.
    """
    target = f"{root}/runs/{run_id}"
    for name, write in steps:
        try:
            write(f"{target}/{name}")
        except Exception as exc:
            raise PublicationAborted(f"publishing stopped at '{name}': {exc}") from exc
    spark.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("append").json(f"{root}/{POINTER}")
    return target


def current_run(spark: SparkSession, root: str) -> str | None:
    """Folder of the newest published run (run ids sort by time)."""
    if not path_exists(spark, f"{root}/{POINTER}"):
        return None
    newest = spark.read.schema("run_id string").json(f"{root}/{POINTER}").agg(F.max("run_id")).head()
    return f"{root}/runs/{newest[0]}" if newest and newest[0] else None


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Counters of earlier runs; a missing file is an empty history, and so are its unreadable lines.

    Any other fault of the store is raised: taking it for an empty history would switch
    off the guard against a suspicious emptying.
    """
    if not path_exists(spark, path):
        return empty(spark, schema("runs"))
    runs = conform(spark.read.schema(schema("runs")).json(path), schema("runs"))
    return runs.where(F.col("hotspots").isNotNull())


def append_run(runs: DataFrame, hotspots: DataFrame, incidents: DataFrame, at: str) -> DataFrame:
    """Earlier runs plus this one, the last 24 kept."""
    row = hotspots.agg(F.count("*").alias("hotspots")).withColumns(
        {"incidents": incidents.agg(F.count("*")).scalar(), "at": F.lit(at)}
    )
    return last_runs(runs.unionByName(conform(row, schema("runs"))), C.RUN_HISTORY)


def refuse_small(df: DataFrame, minimum: int, what: str) -> DataFrame:
    """Do not overwrite a good layer with a suspiciously short one."""
    n = df.count()
    if n < minimum:
        raise PublicationAborted(f"{what}: only {n} rows, at least {minimum} expected; nothing overwritten")
    return df
