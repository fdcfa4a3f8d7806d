"""Quality filters, masks and de-duplication of detections."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import domain, geo
from firespark.operators.grids import collapse_sites, near_keys, probe_keys
from firespark.operators.polygons import clip_to_territory
from firespark.operators.rows import keep_first
from firespark.session import materialise


def confidence_ok() -> Column:
    return domain.passes_confidence(
        F.col("instrument"), F.col("confidence_raw"), F.col("confidence_pct")
    )


def filter_confidence(hotspots: DataFrame) -> DataFrame:
    return hotspots.where(confidence_ok())


def split_confidence(hotspots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reliable and low-confidence detections; nothing is lost, both carry the flag."""
    flagged = hotspots.withColumn("confianza_baja", ~confidence_ok())
    return flagged.where(~F.col("confianza_baja")), flagged.where("confianza_baja")


def _metric(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return geo.with_utm(df, lat, lon, 30, "_x", "_y").withColumn("_zone", F.lit(30))


def _mask_sites(mask: DataFrame, radius: float) -> DataFrame:
    sites = collapse_sites(_metric(mask), F.min("name").alias("name"))
    return near_keys(sites, radius).select(
        "_zone", "_cx", "_cy", F.col("_x").alias("_sx"), F.col("_y").alias("_sy"), "name"
    )


def apply_mask(
    hotspots: DataFrame, mask: DataFrame | None, radius: float = C.MASK_RADIUS_M
) -> DataFrame:
    """Drop detections closer than ``radius`` to a masked site.

    An anti-join on the grid cell with the distance as residual condition: no row is
    duplicated and no aggregate follows. The mask is not hinted; Spark broadcasts it
    when its measured size allows and otherwise shuffles on the cell.
    """
    if mask is None:
        return hotspots
    probes = probe_keys(_metric(hotspots), radius)
    sites = _mask_sites(mask, radius)
    close = geo.distance(F.col("_x"), F.col("_y"), F.col("_sx"), F.col("_sy")) < radius
    on = (
        (probes["_zone"] == sites["_zone"])
        & (probes["_cx"] == sites["_cx"])
        & (probes["_cy"] == sites["_cy"])
        & close
    )
    return probes.join(sites, on, "left_anti").select(*hotspots.columns)


def masked_by(hotspots: DataFrame, mask: DataFrame, radius: float = C.MASK_RADIUS_M) -> DataFrame:
    """Masked detections with ``excluded_by``, the first mask name in order.

    The name depends on the position alone, so it is worked out once per position.
    """
    places = hotspots.select("latitude", "longitude").distinct()
    hits = probe_keys(_metric(places), radius).join(_mask_sites(mask, radius), ["_zone", "_cx", "_cy"])
    names = (
        hits.where(geo.distance(F.col("_x"), F.col("_y"), F.col("_sx"), F.col("_sy")) < radius)
        .groupBy("latitude", "longitude")
        .agg(F.min("name").alias("excluded_by"))
    )
    return hotspots.join(names, ["latitude", "longitude"]).select(*hotspots.columns, "excluded_by")


def deduplicate_spatial(hotspots: DataFrame, grid_m: float = C.DEDUP_GRID_M) -> DataFrame:
    """One detection per ground cell and hour: the most powerful one."""
    keyed = (
        _metric(hotspots)
        .withColumns(
            {
                "_cx": geo.cell(F.col("_x"), grid_m),
                "_cy": geo.cell(F.col("_y"), grid_m),
                "_hour": F.date_trunc("hour", "acq_dt"),
            }
        )
        .drop("_x", "_y", "_zone")
    )
    order = [-F.col("frp_mw"), F.col("acq_dt"), F.col("source"), F.col("latitude"), F.col("longitude")]
    return keep_first(keyed, ["_cx", "_cy", "_hour"], order).drop("_cx", "_cy", "_hour")


DETECTION_KEY = ["latitude", "longitude", "acq_dt", "source"]


def deduplicate_exact(hotspots: DataFrame) -> DataFrame:
    return keep_first(hotspots, DETECTION_KEY, [])


def clean(hotspots: DataFrame, mask: DataFrame | None) -> DataFrame:
    return deduplicate_spatial(apply_mask(filter_confidence(hotspots), mask))


def clean_and_count(
    hotspots: DataFrame, mask: DataFrame | None, territory: DataFrame | None, margin_m: float = C.BORDER_MARGIN_M
) -> tuple[DataFrame, DataFrame]:
    """Clean detections inside the territory, stored, and one row that says how many each stage removed.

    The counts are taken in the two passes that do the work; no stage runs again for them.
    """
    seen = {name: Observation(f"{name}-{uuid.uuid4().hex}") for name in ("raw", "kept", "unmasked", "single", "inside")}

    def watched(df: DataFrame, name: str) -> DataFrame:
        return df.observe(seen[name], F.count("*").alias("n"))

    reliable = watched(filter_confidence(watched(hotspots, "raw")), "kept")
    unmasked = watched(apply_mask(reliable, mask), "unmasked")
    single = materialise(watched(deduplicate_spatial(unmasked), "single"))
    inside = materialise(watched(clip_to_territory(single, territory, margin_m), "inside"))
    n = {name: int(o.get["n"]) for name, o in seen.items()}
    removed = (n["raw"], n["raw"] - n["kept"], n["kept"] - n["unmasked"], n["unmasked"] - n["single"], n["single"] - n["inside"])
    layout = "raw long, lowconf long, industrial long, deduplicated long, outside long"
    return inside, hotspots.sparkSession.createDataFrame([removed], layout)
