"""Checks of clustering, fire roll-ups and perimeters."""

from __future__ import annotations

from pyspark.sql import functions as F

from firespark.catalog import register, stages
from firespark.catalog import sql as S
from firespark.functions import times
from firespark.operators import cluster, hull, summaries
from firespark.plans import projections as P


@register("fire_assignment", S.query(S.CLUSTERED, "SELECT event_id, fire_id FROM burned"))
def fire_assignment(spark, sf):
    return stages.burned(spark, sf).select("event_id", "fire_id")


FIRE_SQL = f"""
  SELECT fire_id, area_key, n_hotspots, round(frp_total_mw, 2) AS frp_total_mw, frp_max_mw,
    round(brightness_max_k, 3) AS brightness_max_k, round(confidence_mean, 4) AS confidence_mean,
    {S.iso('first_detected')} AS first_detected, {S.iso('last_detected')} AS last_detected,
    round(lat, 6) AS lat, round(lon, 6) AS lon, sensors, round(hours_since_last, 3) AS hours_since_last,
    round(duration_hours, 3) AS duration_hours, status, area_est_ha, intensity FROM fires"""


def _fire_view(fires):
    return fires.select(
        "fire_id", "area_key", "n_hotspots", F.round("frp_total_mw", 2).alias("frp_total_mw"), "frp_max_mw",
        F.round("brightness_max_k", 3).alias("brightness_max_k"),
        F.round("confidence_mean", 4).alias("confidence_mean"),
        times.iso_z(F.col("first_detected")).alias("first_detected"),
        times.iso_z(F.col("last_detected")).alias("last_detected"),
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "sensors",
        F.round("hours_since_last", 3).alias("hours_since_last"),
        F.round("duration_hours", 3).alias("duration_hours"), "status", "area_est_ha", "intensity",
    )


@register("fire_rollup", S.query(S.FIRES, FIRE_SQL))
def fire_rollup(spark, sf):
    return _fire_view(stages.fires(spark, sf))


@register("cluster_seeds", S.query(S.CLUSTERED, f"""
  SELECT fire_id, round(lat, 6) AS lat, round(lon, 6) AS lon, {S.iso('start')} AS start FROM ids"""))
def cluster_seeds(spark, sf):
    placed = cluster.metric_points(stages.clean(spark, sf))
    found = cluster.seeds(cluster.label_points(placed))
    return found.select(
        "fire_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"),
        times.iso_z(F.col("start")).alias("start"),
    )


@register("eps_graph_degree", S.query(f"{S.POINTS}, {S.components('pts')}", """
  SELECT CAST(count(*) AS BIGINT) AS clusters, CAST(sum(n) AS BIGINT) AS points, CAST(max(n) AS BIGINT) AS largest,
    CAST(count(*) FILTER (n = 1) AS BIGINT) AS singletons FROM (SELECT root, count(*) AS n FROM label GROUP BY root)"""))
def eps_graph_degree(spark, sf):
    placed = cluster.metric_points(stages.clean(spark, sf))
    sizes = cluster.label_points(placed).groupBy("label").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("points"), F.max("n").alias("largest"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )


K = 4
SIDE = S.num(1500.0 / 3.0**0.5 * (1.0 - 1e-12))
CUBE = "concat_ws(':', area_key, CAST(floor({p}x / {s}) AS BIGINT), CAST(floor({p}y / {s}) AS BIGINT), CAST(floor({p}t / {s}) AS BIGINT))"


@register("eps_cube_edges", S.query(f"{S.POINTS}, cubed AS (SELECT *, {CUBE.format(p='', s=SIDE)} AS cube FROM pts)", """
  SELECT DISTINCT least(a.cube, b.cube) AS a, greatest(a.cube, b.cube) AS b FROM cubed a JOIN cubed b
    ON a.area_key = b.area_key AND a.cube <> b.cube
   AND abs(a.x - b.x) <= 1.501e3 AND abs(a.y - b.y) <= 1.501e3
   AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.t - b.t) * (a.t - b.t)) <= 1.5e3 + 1e-6"""))
def eps_cube_edges(spark, sf):
    pairs = cluster.neighbour_pairs(cluster.metric_points(stages.clean(spark, sf)))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


@register("core_points_min_samples", S.query(S.POINTS, f"""
  , near AS (SELECT a.event_id, count(*) AS n FROM pts a JOIN pts b ON a.area_key = b.area_key
      AND abs(a.x - b.x) <= 1.501e3 AND abs(a.y - b.y) <= 1.501e3
      AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.t - b.t) * (a.t - b.t)) <= 1.5e3 + 1e-6
      GROUP BY a.event_id),
  core AS (SELECT p.* FROM pts p JOIN near USING (event_id) WHERE n >= {K}),
  {S.components('core')},
  border AS (SELECT DISTINCT p.event_id FROM pts p JOIN core c ON p.area_key = c.area_key
      AND abs(p.x - c.x) <= 1.501e3 AND abs(p.y - c.y) <= 1.501e3
      AND sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) + (p.t - c.t) * (p.t - c.t)) <= 1.5e3 + 1e-6
      WHERE p.event_id NOT IN (SELECT event_id FROM core))
  SELECT (SELECT count(DISTINCT root) FROM label) AS clusters, (SELECT count(*) FROM core) + (SELECT count(*) FROM border) AS clustered,
    (SELECT count(*) FROM pts) - (SELECT count(*) FROM core) - (SELECT count(*) FROM border) AS noise"""))
def core_points_min_samples(spark, sf):
    placed = cluster.metric_points(stages.clean(spark, sf))
    labelled = cluster.label_points(placed, min_samples=K)
    return labelled.agg(
        F.count_distinct("label").alias("clusters"), F.count("label").alias("clustered"),
        F.count_if(F.col("label").isNull()).alias("noise"),
    )


@register("perimeters", S.query(f"""{S.CLUSTERED}, fx AS (SELECT fire_id, x, y FROM burned),
  fd AS (SELECT DISTINCT fire_id, x, y FROM fx),
  dir AS (SELECT a.fire_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM fd a JOIN fd b
     ON a.fire_id = b.fire_id AND (a.x <> b.x OR a.y <> b.y)),
  side AS (SELECT d.fire_id, ax, ay, bx, b_y FROM dir d JOIN fd p ON p.fire_id = d.fire_id
     GROUP BY d.fire_id, ax, ay, bx, b_y
     HAVING min((bx - ax) * (p.y - ay) - (b_y - ay) * (p.x - ax)) >= 0e0),
  geom AS (SELECT fire_id, sum(ax * b_y - bx * ay) / 2e0 AS area, sum(sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))) AS per
     FROM side GROUP BY fire_id),
  cnt AS (SELECT fire_id, count(*) AS n, count(DISTINCT (x, y)) AS d FROM fx GROUP BY fire_id)""", """
  SELECT fire_id, round(CASE WHEN d = 1 THEN pi() * 3.61e4
      WHEN n = 2 THEN CASE WHEN per / 2e0 >= 3.8e2 THEN 2e0 * pi() * 3.61e4 ELSE 2e0 * pi() * 3.61e4
         - (2e0 * 3.61e4 * acos(per / 2e0 / 3.8e2) - per / 4e0 * sqrt(4e0 * 3.61e4 - per * per / 4e0)) END
      ELSE area + per * 1.9e2 + pi() * 3.61e4 END / 1e4, 1) AS hull_area_ha, true AS is_estimate
  FROM cnt LEFT JOIN geom USING (fire_id)"""))
def perimeters(spark, sf):
    made = hull.build_perimeters(stages.burned(spark, sf))
    return made.select("fire_id", "hull_area_ha", "is_estimate")


@register("daily_evolution", S.query(S.CLUSTERED, """
  SELECT strftime(acq_dt, '%Y-%m-%d') AS dia, count(*) AS focos, strftime(acq_dt, '%d/%m') AS etiqueta,
    CAST(floor(count(*) * 1.406e1 + 5e-1) AS BIGINT) AS hectareas, strftime(acq_dt, '%Y-%m-%d') = '2024-01-31' AS parcial
  FROM burned GROUP BY 1, 3, 5"""))
def daily_evolution(spark, sf):
    return summaries.daily_evolution(stages.burned(spark, sf), P.now())


@register("daily_evolution_per_fire", S.query(S.CLUSTERED, """
  SELECT fire_id, strftime(acq_dt, '%Y-%m-%d') AS dia, count(*) AS focos,
    CAST(floor(count(*) * 1.406e1 + 5e-1) AS BIGINT) AS hectareas FROM burned GROUP BY 1, 2"""))
def daily_evolution_per_fire(spark, sf):
    return summaries.daily_evolution(stages.burned(spark, sf), P.now(), ("fire_id",)).select(
        "fire_id", "dia", "focos", "hectareas"
    )


@register("severe_fires_top20", S.query(S.FIRES, """
  SELECT fire_id, intensity, n_hotspots, round(frp_total_mw, 2) AS frp_total_mw FROM fires
  ORDER BY frp_total_mw DESC, fire_id LIMIT 20"""))
def severe_fires_top20(spark, sf):
    return (
        stages.fires(spark, sf).orderBy(F.desc("frp_total_mw"), "fire_id").limit(20)
        .select("fire_id", "intensity", "n_hotspots", F.round("frp_total_mw", 2).alias("frp_total_mw"))
    )
