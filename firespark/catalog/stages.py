"""Shared intermediate tables of the checked queries.

Clustering is the one iterative stage; like a scheduled run it writes its result
once per input and the stages after it read that table. ``clear`` forgets it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from firespark.operators import clean as clean_ops
from firespark.operators import cluster, fuse
from firespark.plans import projections as P
from firespark.session import materialise, stored

_done: dict[tuple[str, str, str], DataFrame] = {}


def clear() -> None:
    _done.clear()


def _once(
    name: str, spark: SparkSession, sf_dir: str, make: Callable[[], DataFrame], keep: Callable[[DataFrame], DataFrame] = materialise
) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _done:
        _done[key] = keep(make())
    return _done[key]


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean detections: the input of most later stages."""
    return _once(
        "clean", spark, sf_dir,
        lambda: clean_ops.clean(P.hotspots(spark, sf_dir), P.mask(spark, sf_dir)),
        keep=lambda df: stored(df, "clean"),
    )


def burned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean detections with their fire id."""
    return _once("burned", spark, sf_dir, lambda: cluster.assign_fire_ids(clean(spark, sf_dir)), keep=lambda df: stored(df, "burned"))


def fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.build_fires(burned(spark, sf_dir), P.now())


def matched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    # Matching has stored all but a last join with the winners, which are few.
    reports = _once(
        "reports", spark, sf_dir,
        lambda: fuse.match_reports(P.official(spark, sf_dir), fires(spark, sf_dir)),
        keep=lambda df: df,
    )
    return reports, fuse.confirm_fires(fires(spark, sf_dir), reports)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        reports, confirmed = matched(spark, sf_dir)
        return fuse.build_incidents(reports, confirmed)

    return _once("incidents", spark, sf_dir, make, keep=lambda df: stored(df, "incidents"))
