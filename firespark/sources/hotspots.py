"""Landed detection files of several sensors, read into one schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, text, times
from firespark.operators.clean import deduplicate_exact
from firespark.operators.rows import conform, empty, first_present, require_columns, union_aligned
from firespark.schemas import schema
from firespark.session import path_exists

REQUIRED = ("latitude", "longitude", "acq_date", "acq_time", "satellite", "instrument", "confidence")
BRIGHTNESS = ("bright_ti4", "brightness")


def check_columns(raw: DataFrame, source: str, area: str) -> None:
    """Name the sensor, the area and the difference when a feed changes its header."""
    label = f"{source}/{area}"
    require_columns(raw, REQUIRED, label)
    if first_present(raw, BRIGHTNESS) is None:
        raise ValueError(f"{label}: missing columns ['{'|'.join(BRIGHTNESS)}']; received {sorted(raw.columns)}")


def normalise(raw: DataFrame, source: str = "?", area: str = "?") -> DataFrame:
    """Either sensor schema to the common one. Needs ``source`` and ``area_key`` columns."""
    check_columns(raw, source, area)
    bright = F.coalesce(*[F.col(c).try_cast("double") for c in BRIGHTNESS if c in raw.columns])

    def optional(name: str):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    confidence = F.col("confidence").cast("string")
    shaped = raw.select(
        F.col("latitude").try_cast("double").alias("latitude"),
        F.col("longitude").try_cast("double").alias("longitude"),
        times.hhmm_timestamp(F.col("acq_date"), F.col("acq_time")).alias("acq_dt"),
        F.col("satellite").cast("string").alias("satellite"),
        F.col("instrument").cast("string").alias("instrument"),
        "source", "area_key",
        confidence.alias("confidence_raw"),
        domain.confidence_pct(confidence).alias("confidence_pct"),
        bright.alias("brightness_k"),
        F.coalesce(text.number(optional("frp")), F.lit(0.0)).alias("frp_mw"),
        F.coalesce(optional("daynight"), F.lit("")).alias("daynight"),
        text.number(optional("scan")).alias("scan"),
        text.number(optional("track")).alias("track"),
    )
    return conform(shaped, schema("hotspots"))


def read_one(spark: SparkSession, path: str, source: str, area: str) -> DataFrame:
    """One sensor over one area. A body that is not CSV yields no rows (see ``quarantine``)."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    if len(raw.columns) < 2:
        return empty(spark, schema("hotspots"))
    tagged = raw.withColumns({"source": F.lit(source), "area_key": F.lit(area)})
    return normalise(tagged, source, area).where(F.col("acq_dt").isNotNull())


def read_all(
    spark: SparkSession, root: str, jobs: list[tuple[str, str]], failures: dict[str, str] | None = None
) -> DataFrame:
    """Union of ``root/source=…/area_key=…`` for every (source, area), duplicates removed.

    One that is absent or whose header changed gives no rows and leaves the others
    alone; ``failures`` takes its reason under ``source/area``.
    """
    frames, told = [], {} if failures is None else failures
    for source, area in jobs:
        path = f"{root}/source={source}/area_key={area}"
        if not path_exists(spark, path):
            told[f"{source}/{area}"] = "no landed files"
            continue
        try:
            frames.append(read_one(spark, path, source, area))
        except ValueError as broken:
            told[f"{source}/{area}"] = str(broken)
    if not frames:
        return empty(spark, schema("hotspots"))
    return deduplicate_exact(union_aligned(frames))


def declared_jobs() -> list[tuple[str, str]]:
    return [(s, a) for s in C.SENSOR_SOURCES for a in C.AREAS]


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Files whose first line has no comma: a quota message instead of data."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
        "value",
    )
    first = (
        lines.where(F.col("block") == 0)
        .where(F.trim("value") != "")
        .groupBy("file")
        .agg(F.min(F.struct("line", "value")).alias("first"))
    )
    return first.where(~F.col("first.value").contains(",")).select(
        "file", F.col("first.value").alias("body")
    )


def snapshot(hotspots: DataFrame, root: str, stamp: str) -> str:
    """Raw copy of an ingest under its own time stamp."""
    path = f"{root}/ingest_ts={stamp}"
    hotspots.write.mode("overwrite").parquet(path)
    return path
