"""SQL text blocks for the side-by-side checks: plain, brute-force formulations."""

from __future__ import annotations

from firespark.functions import geo
from firespark.plans import projections as P


def num(value: float) -> str:
    return f"{float(value)!r}e0" if "e" not in repr(float(value)) else repr(float(value))


def utm(name: str, source: str, zone: str = "30", lat: str = "latitude", lon: str = "longitude") -> str:
    """CTE ``name``: ``source`` plus UTM ``x`` and ``y``."""
    lon0 = f"(CASE WHEN {zone} = 28 THEN -1.5e1 ELSE -3e0 END)"
    east, north = "_eta", "_xi"
    for j, a in enumerate(geo.ALPHA, start=1):
        east += f" + {num(a)} * cos({num(2 * j)} * _xi) * sinh({num(2 * j)} * _eta)"
        north += f" + {num(a)} * sin({num(2 * j)} * _xi) * cosh({num(2 * j)} * _eta)"
    k = num(geo.SCALE_K0 * geo.RECTIFYING_M)
    e = num(geo.ECC)
    return f"""{name} AS (
      SELECT * EXCLUDE (_s, _l, _t, _xi, _eta), 5e5 + {k} * ({east}) AS x, {k} * ({north}) AS y FROM (
        SELECT *, atan2(_t, cos(_l)) AS _xi, atanh(sin(_l) / sqrt(1e0 + _t * _t)) AS _eta FROM (
          SELECT *, sinh(atanh(_s) - {e} * atanh({e} * _s)) AS _t FROM (
            SELECT *, sin(radians({lat})) AS _s, radians({lon} - {lon0}) AS _l FROM {source}))))"""


HAVERSINE = (
    "(2e0 * 6.371e3 * asin(least(1e0, sqrt(pow(sin(radians({b_lat} - {a_lat}) / 2e0), 2)"
    " + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2e0), 2)))))"
)


def haversine(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return HAVERSINE.format(a_lat=a_lat, a_lon=a_lon, b_lat=b_lat, b_lon=b_lon)


def bearing(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return (
        f"fmod(degrees(atan2(sin(radians({b_lon} - {a_lon})) * cos(radians({b_lat})),"
        f" cos(radians({a_lat})) * sin(radians({b_lat})) - sin(radians({a_lat})) * cos(radians({b_lat}))"
        f" * cos(radians({b_lon} - {a_lon})))) + 3.6e2, 3.6e2)"
    )


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%SZ')"


def hours(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 3.6e9)"


CONFIDENT = (
    "(CASE WHEN upper(instrument) LIKE 'VIIRS%' THEN lower(trim(confidence_raw)) IN ('n','h','nominal','high')"
    " ELSE coalesce(confidence_pct >= 30, false) END)"
)

HOT = P.SQL_HOT
MASK_M = ", ".join([P.SQL_MASK, utm("mask_m", "mask")])
CONF = f"{HOT}, conf AS (SELECT * FROM hot WHERE {CONFIDENT})"
UNMASKED = f"""{CONF}, {utm('conf_m', 'conf')}, {MASK_M},
  unmasked AS (SELECT * FROM conf_m c WHERE NOT EXISTS (
    SELECT 1 FROM mask_m m WHERE sqrt((c.x - m.x) * (c.x - m.x) + (c.y - m.y) * (c.y - m.y)) < 1.2e3))"""
CLEAN = f"""{UNMASKED},
  clean AS (SELECT * EXCLUDE (x, y, rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY floor(x / 2e2), floor(y / 2e2), date_trunc('hour', acq_dt)
      ORDER BY frp_mw DESC, acq_dt, source, latitude, longitude, event_id) AS rn FROM unmasked) WHERE rn = 1)"""

ZONE_OF_AREA = "(CASE WHEN area_key = 'canarias' THEN 28 ELSE 30 END)"
POINTS = f"""{CLEAN}, {utm('pts0', 'clean', ZONE_OF_AREA)},
  pts AS MATERIALIZED (SELECT *, epoch_us(acq_dt) / 3.6e9 * {num(1500.0 / 18.0)} AS t FROM pts0)"""


def components(points: str, edges: str = "edge", eps: float = 1500.0) -> str:
    """CTEs ``edge`` and ``label(event_id, root)`` by transitive closure."""
    return f"""
  {edges} AS MATERIALIZED (SELECT a.event_id AS s, b.event_id AS d FROM {points} a JOIN {points} b
    ON a.area_key = b.area_key AND a.event_id <> b.event_id
   AND abs(a.x - b.x) <= {num(eps)} + 1e0 AND abs(a.y - b.y) <= {num(eps)} + 1e0
   AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.t - b.t) * (a.t - b.t)) <= {num(eps)} + 1e-6),
  label(event_id, root) USING KEY (event_id) AS (SELECT event_id, event_id FROM {points}
    UNION SELECT e.d, min(r.root) FROM label r JOIN {edges} e ON e.s = r.event_id
      JOIN recurring.label cur ON cur.event_id = e.d WHERE r.root < cur.root GROUP BY e.d)"""


SEEDS = """
  labelled AS (SELECT p.*, l.root FROM pts p JOIN label l USING (event_id)),
  seed AS (SELECT root,
      sum(CAST(round(latitude * 1e7) AS BIGINT)) / (count(*) * 1e7) AS lat,
      sum(CAST(round(longitude * 1e7) AS BIGINT)) / (count(*) * 1e7) AS lon,
      min(acq_dt) AS start FROM labelled GROUP BY root),
  ids AS (SELECT *, substr(sha1(printf('%.3f', lat) || '|' || printf('%.3f', lon) || '|' || strftime(start, '%Y-%m-%d')), 1, 10)
      AS fire_id FROM seed),
  burned AS (SELECT p.*, i.fire_id FROM labelled p JOIN ids i USING (root))"""

CLUSTERED = f"{POINTS}, {components('pts')}, {SEEDS}"

INTENSITY = (
    "CASE WHEN frp_total_mw <= 50 THEN 'baja' WHEN frp_total_mw <= 200 THEN 'media'"
    " WHEN frp_total_mw <= 800 THEN 'alta' ELSE 'extrema' END"
)
FIRES = f"""{CLUSTERED},
  fires0 AS (SELECT fire_id, min(area_key) AS area_key, count(*) AS n_hotspots, sum(frp_mw) AS frp_total_mw,
      max(frp_mw) AS frp_max_mw, max(brightness_k) AS brightness_max_k, avg(confidence_pct) AS confidence_mean,
      min(acq_dt) AS first_detected, max(acq_dt) AS last_detected,
      sum(CAST(round(latitude * 1e7) AS BIGINT)) / (count(*) * 1e7) AS lat,
      sum(CAST(round(longitude * 1e7) AS BIGINT)) / (count(*) * 1e7) AS lon,
      string_agg(DISTINCT source, ',' ORDER BY source) AS sensors FROM burned GROUP BY fire_id),
  fires AS (SELECT *, {hours(P.SQL_NOW, 'last_detected')} AS hours_since_last,
      {hours('last_detected', 'first_detected')} AS duration_hours,
      CASE WHEN {hours(P.SQL_NOW, 'last_detected')} <= 24 THEN 'activo' ELSE 'inactivo' END AS status,
      round_even(n_hotspots * 1.406e1, 0) AS area_est_ha, {INTENSITY} AS intensity FROM fires0)"""


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"
