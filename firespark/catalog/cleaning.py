"""Checks of filters, masks, de-duplication, clipping and the persistent-source grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark import config as C
from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.catalog.feeds import scratch
from firespark.functions import geo, times
from firespark.operators import clean as ops
from firespark.operators import polygons, summaries
from firespark.plans import projections as P
from firespark.sinks import history

BASE = "event_id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, source"


def narrow():
    return [
        "event_id", F.round("latitude", 3).alias("latitude"), F.round("longitude", 3).alias("longitude"),
        "source",
    ]


@register("hotspots_normalised", S.query(S.HOT, f"""
  SELECT event_id, round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, {S.iso('acq_dt')} AS acq_dt,
    satellite, instrument, source, area_key, confidence_raw, confidence_pct, round(brightness_k, 3) AS brightness_k,
    frp_mw, daynight, scan, track FROM hot"""))
def hotspots_normalised(spark, sf):
    return P.hotspots(spark, sf).withColumns(
        {
            "acq_dt": times.iso_z(F.col("acq_dt")),
            "latitude": F.round("latitude", 3), "longitude": F.round("longitude", 3),
            "brightness_k": F.round("brightness_k", 3), "track": F.col("track").cast("double"),
            "scan": F.col("scan").cast("double"),
        }
    )


@register("confidence_filter", S.query(S.CONF, f"SELECT {BASE} FROM conf"))
def confidence_filter(spark, sf):
    return ops.filter_confidence(P.hotspots(spark, sf)).select(*narrow())


@register("confidence_split", S.query(S.HOT, f"""
  SELECT NOT {S.CONFIDENT} AS confianza_baja, instrument, count(*) AS n, round(sum(frp_mw), 2) AS frp
  FROM hot GROUP BY 1, 2"""))
def confidence_split(spark, sf):
    reliable, low = ops.split_confidence(P.hotspots(spark, sf))
    return reliable.unionByName(low).groupBy("confianza_baja", "instrument").agg(
        F.count("*").alias("n"), F.round(F.sum("frp_mw"), 2).alias("frp")
    )


@register("mask_anti_join", S.query(S.UNMASKED, f"SELECT {BASE} FROM unmasked"))
def mask_anti_join(spark, sf):
    return ops.apply_mask(ops.filter_confidence(P.hotspots(spark, sf)), P.mask(spark, sf)).select(*narrow())


@register("mask_excluded_by", S.query(f"{S.CONF}, {S.utm('conf_m', 'conf')}, {S.MASK_M}", """
  SELECT c.event_id, min(m.name) AS excluded_by FROM conf_m c JOIN mask_m m
    ON sqrt((c.x - m.x) * (c.x - m.x) + (c.y - m.y) * (c.y - m.y)) < 1.2e3 GROUP BY c.event_id"""))
def mask_excluded_by(spark, sf):
    kept = ops.filter_confidence(P.hotspots(spark, sf))
    return ops.masked_by(kept, P.mask(spark, sf)).select("event_id", "excluded_by")


@register("spatial_dedup", S.query(S.CLEAN, f"SELECT {BASE}, frp_mw FROM clean"))
def spatial_dedup(spark, sf):
    kept = ops.apply_mask(ops.filter_confidence(P.hotspots(spark, sf)), P.mask(spark, sf))
    return ops.deduplicate_spatial(kept).select(*narrow(), "frp_mw")


@register("exact_dedup", S.query(S.HOT, f"""
  SELECT round(latitude, 3) AS latitude, round(longitude, 3) AS longitude, {S.iso('acq_dt')} AS acq_dt, source,
    min(event_id) AS event_id FROM hot GROUP BY hot.latitude, hot.longitude, hot.acq_dt, source"""))
def exact_dedup(spark, sf):
    kept = ops.deduplicate_exact(P.hotspots(spark, sf))
    return kept.select(*narrow(), times.iso_z(F.col("acq_dt")).alias("acq_dt"))


@register("clean_composed", S.query(S.CLEAN, """
  SELECT area_key, instrument, count(*) AS n, round(sum(frp_mw), 2) AS frp FROM clean GROUP BY 1, 2"""))
def clean_composed(spark, sf):
    return ops.clean(P.hotspots(spark, sf), P.mask(spark, sf)).groupBy("area_key", "instrument").agg(
        F.count("*").alias("n"), F.round(F.sum("frp_mw"), 2).alias("frp")
    )


INSIDE = "abs(p.longitude - a.clon) / a.hw + abs(p.latitude - a.clat) / a.hh < 1e0"


def _corner_utm() -> str:
    """UTM of the four corners of every diamond, one CTE per corner."""
    out = []
    for i, (dx, dy) in enumerate((("-hw", "0e0"), ("0e0", "hh"), ("hw", "0e0"), ("0e0", "-hh"))):
        src = f"(SELECT area_id, clon + ({dx}) AS vlon, clat + ({dy}) AS vlat FROM areas)"
        out.append(S.utm(f"corner{i}", src, "30", "vlat", "vlon"))
    return ", ".join(out)


SIDES = " UNION ALL ".join(
    f"SELECT a.area_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM corner{i} a JOIN corner{(i + 1) % 4} b USING (area_id)"
    for i in range(4)
)
CLIP = f"""{S.CLEAN}, {P.SQL_AREAS}, {_corner_utm()}, side AS ({SIDES}),
  place AS (SELECT DISTINCT latitude, longitude FROM clean), {S.utm('place_m', 'place')},
  near AS (SELECT DISTINCT p.latitude, p.longitude FROM place_m p JOIN side s ON
      p.x BETWEEN least(ax, bx) - 1.5e4 AND greatest(ax, bx) + 1.5e4
      AND p.y BETWEEN least(ay, b_y) - 1.5e4 AND greatest(ay, b_y) + 1.5e4
      AND sqrt(pow(p.x - (ax + (bx - ax) * greatest(0e0, least(1e0, ((p.x - ax) * (bx - ax) + (p.y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))))), 2)
             + pow(p.y - (ay + (b_y - ay) * greatest(0e0, least(1e0, ((p.x - ax) * (bx - ax) + (p.y - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))))), 2)) <= 1.5e4
    UNION SELECT p.latitude, p.longitude FROM place p JOIN areas a ON {INSIDE}),
  clipped AS (SELECT c.* FROM clean c JOIN near n USING (latitude, longitude))"""


@register("clip_to_territory", S.query(CLIP, f"SELECT {BASE} FROM clipped"))
def clip_to_territory(spark, sf):
    kept = polygons.clip_to_territory(stages.clean(spark, sf), P.areas(spark, sf), C.BORDER_MARGIN_M)
    return kept.select(*narrow())


@register("discard_accounting", S.query(CLIP, f"""
  SELECT (SELECT count(*) FROM hot) AS raw, (SELECT count(*) FROM hot) - (SELECT count(*) FROM conf) AS lowconf,
    (SELECT count(*) FROM conf) - (SELECT count(*) FROM unmasked) AS industrial,
    (SELECT count(*) FROM unmasked) - (SELECT count(*) FROM clean) AS deduplicated,
    (SELECT count(*) FROM clean) - (SELECT count(*) FROM clipped) AS outside"""))
def discard_accounting(spark, sf):
    return summaries.discards(P.hotspots(spark, sf), P.mask(spark, sf), P.areas(spark, sf))


@register("persistent_sources", S.query(S.HOT, """
  SELECT round(round(latitude / 5e-3) * 5e-3, 3) AS lat, round(round(longitude / 5e-3) * 5e-3, 3) AS lon,
    count(DISTINCT CAST(acq_dt AS DATE)) AS active_days, count(*) AS detections, round(median(frp_mw), 3) AS frp_median
  FROM hot GROUP BY 1, 2 HAVING count(DISTINCT CAST(acq_dt AS DATE)) >= 3"""))
def persistent_sources(spark, sf):
    return summaries.persistent_sources(P.hotspots(spark, sf), min_days=3).select(
        F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "active_days", "detections",
        F.round("frp_median", 3).alias("frp_median"),
    )


@register("persistent_candidates_named", S.query(S.HOT, """
  SELECT 'auto_' || CAST(row_number() OVER (ORDER BY active_days DESC, lat, lon) - 1 AS VARCHAR) AS name, 'auto' AS kind,
    lat, lon, active_days FROM (SELECT round(round(latitude / 5e-3) * 5e-3, 3) AS lat,
    round(round(longitude / 5e-3) * 5e-3, 3) AS lon, count(DISTINCT CAST(acq_dt AS DATE)) AS active_days
    FROM hot GROUP BY 1, 2 HAVING count(DISTINCT CAST(acq_dt AS DATE)) >= 4)"""))
def persistent_candidates_named(spark, sf):
    cells = summaries.persistent_sources(P.hotspots(spark, sf), min_days=4)
    named = summaries.named_candidates(cells)
    return named.select("name", "kind", F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "active_days")


PERSISTENT = """
  SELECT round(round(latitude / 5e-3) * 5e-3, 3) AS lat, round(round(longitude / 5e-3) * 5e-3, 3) AS lon,
    count(DISTINCT CAST(acq_dt AS DATE)) AS active_days, count(*) AS detections{more}
  FROM clean GROUP BY 1, 2 HAVING count(DISTINCT CAST(acq_dt AS DATE)) >= 3"""


def _partials(spark, sf, name: str):
    """Clean detections appended to a history in three batches that share days, the last one twice."""
    rows = stages.clean(spark, sf)
    root, partials = scratch(spark, f"history-{name}"), scratch(spark, f"partials-{name}")
    for part in (0, 1, 2, 2):
        history.append_with_partials(rows.where(F.col("event_id") % 3 == part), root, partials)
    return spark.read.parquet(partials)


@register("persistent_sources_incremental", S.query(S.CLEAN, PERSISTENT.format(more=", round(median(frp_mw), 3) AS frp_median")))
def persistent_sources_incremental(spark, sf):
    """The report from partials kept day by day, the same as from the whole history."""
    found = summaries.persistent_from_partials(_partials(spark, sf, "exact"), min_days=3)
    return found.select(
        F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"), "active_days", "detections", F.round("frp_median", 3).alias("frp_median")
    )


@register("persistent_sources_sketch", S.query(S.CLEAN, PERSISTENT.format(more=", true AS days_close, true AS median_close, true AS sketch_close")))
def persistent_sources_sketch(spark, sf):
    """Sketches against exact figures: days within a tenth or one, and medians by their rank.

    At most half of a cell's values, and a hundredth of all, may be smaller or larger than a median.
    """
    clean = stages.clean(spark, sf)
    at = lambda c: F.round(F.round(F.col(c) / 5e-3) * 5e-3, 3)
    values = clean.select(at("latitude").alias("lat"), at("longitude").alias("lon"), "frp_mw")
    cell = [F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")]
    exact = summaries.persistent_sources(clean, min_days=3).select(*cell, "active_days", "detections")
    rough = summaries.persistent_sources(clean, min_days=1, approximate=True).select(*cell, F.col("active_days").alias("days"), F.col("frp_median").alias("m"))
    kll = summaries.persistent_from_partials(_partials(spark, sf, "sketch"), min_days=1, approximate=True).select(*cell, F.col("frp_median").alias("k"))
    told = values.join(exact, ["lat", "lon"]).join(rough, ["lat", "lon"]).join(kll, ["lat", "lon"])

    def halves(name: str):
        n = F.count("frp_mw") * 0.51
        return (F.count_if(F.col("frp_mw") < F.col(name)) <= n) & (F.count_if(F.col("frp_mw") > F.col(name)) <= n)

    return told.groupBy("lat", "lon", "active_days", "detections").agg(
        (F.abs(F.first("days") - F.first("active_days")) <= F.greatest(F.lit(1.0), F.first("active_days") * 0.1)).alias("days_close"),
        halves("m").alias("median_close"), halves("k").alias("sketch_close"),
    )


@register("combined_hotspot_layer", S.query(S.CLUSTERED, f"""
  SELECT event_id, fire_id, false AS confianza_baja FROM burned
  UNION ALL SELECT event_id, NULL, true FROM hot WHERE NOT {S.CONFIDENT}"""))
def combined_hotspot_layer(spark, sf):
    _, low = ops.split_confidence(P.hotspots(spark, sf))
    return summaries.combined_layer(stages.burned(spark, sf), low).select(
        "event_id", "fire_id", "confianza_baja"
    )


@register("area_overlaps", S.query(P.SQL_AREAS, """
  SELECT a.area_id AS a, b.area_id AS b FROM areas a JOIN areas b ON a.area_id < b.area_id
    AND a.clon - a.hw < b.clon + b.hw AND b.clon - b.hw < a.clon + a.hw
    AND a.clat - a.hh < b.clat + b.hh AND b.clat - b.hh < a.clat + a.hh"""))
def area_overlaps(spark, sf):
    """All overlapping pairs of areas, copies of a box included."""
    boxes = polygons.with_bounds(P.areas(spark, sf)).select(
        F.col("area_id").alias("id"), "west", "south", "east", "north"
    )
    return summaries.box_overlaps(boxes)


@register("viewport_filter", S.query(S.HOT, """
  SELECT event_id FROM hot WHERE latitude BETWEEN 3.8e1 AND 4.1e1 AND longitude BETWEEN -5e0 AND 0e0"""))
def viewport_filter(spark, sf):
    df = P.hotspots(spark, sf)
    return df.where(geo.in_box(F.col("latitude"), F.col("longitude"), (-5.0, 38.0, 0.0, 41.0))).select("event_id")


@register("official_box_filter", S.query(P.SQL_OFFICIAL, """
  SELECT source_id, external_id FROM official WHERE latitude BETWEEN 27 AND 44 AND longitude BETWEEN -19 AND 5"""))
def official_box_filter(spark, sf):
    df = P.official(spark, sf)
    return df.where(geo.in_box(F.col("latitude"), F.col("longitude"), C.OFFICIAL_BOX)).select(
        "source_id", "external_id"
    )
