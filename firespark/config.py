"""Constants shared by every operator. One value, one place."""

from __future__ import annotations

# --- Fixed values: the results depend on these exact numbers and words. -------

VIIRS_ACCEPTED = ("n", "h", "nominal", "high")
MODIS_MIN_CONFIDENCE = 30.0
CONFIDENCE_PCT = {"l": 20.0, "n": 60.0, "h": 90.0, "low": 20.0, "nominal": 60.0, "high": 90.0}

AREAS = {
    "peninsula": (-9.60, 35.85, 4.40, 43.90),
    "canarias": (-18.30, 27.55, -13.30, 29.50),
}
SENSOR_SOURCES = ("VIIRS_SNPP_NRT", "VIIRS_NOAA20_NRT", "VIIRS_NOAA21_NRT", "MODIS_NRT")
LOOKBACK_DAYS = 3

MASK_RADIUS_M = 1200.0
DEDUP_GRID_M = 200.0
BORDER_MARGIN_M = 15_000.0

EPS_M = 1500.0
EPS_HOURS = 18.0
MIN_SAMPLES = 1
METRES_PER_HOUR = EPS_M / EPS_HOURS

ACTIVE_WINDOW_HOURS = 24.0
HECTARES_PER_HOTSPOT = 14.06
HULL_BUFFER_M = 190.0

MATCH_SLACK_M = 3000.0
MATCH_MAX_M = 15_000.0
MATCH_WINDOW_HOURS = 48.0
VIIRS_PRECISION_M = 375.0
OTHER_SENSOR_PRECISION_M = 1000.0

IDW_POWER = 2.0
WIND_MAX_KM = 120.0
CLOSURE_RADIUS_M = 15_000.0
MAX_ROADS = 3
GROWTH_WINDOW_HOURS = 6.0
SETTLEMENT_MAX_KM = 50.0
KM_PER_DEGREE = 111.32
EARTH_RADIUS_KM = 6371.0
DOWNWIND_ARC_DEG = 45.0
NEAR_ASSET_KM = 10.0

OFFICIAL_BOX = (-19.0, 27.0, 5.0, 44.0)  # west, south, east, north
PUBLISH_BOX = (-19.0, 27.0, 5.0, 44.5)

STATUS_RANK = {"activo": 4, "estabilizado": 3, "controlado": 2, "extinguido": 1, "desconocido": 0}
STATUS_ORDER = {"activo": 0, "estabilizado": 1, "controlado": 2, "extinguido": 3}
INTENSITY_RANK = {"baja": 1, "media": 2, "alta": 3, "extrema": 4}
VALID_ORIGINS = ("satelite", "oficial", "ambos")
VALID_PUBLISHED_STATUS = ("activo", "estabilizado", "controlado", "extinguido")
NO_RECENT_DETECTIONS = "_sin_detecciones_recientes"

EMPTINESS_DROP_RATIO = 0.9
RUN_HISTORY = 24
MIN_MEDIAN_RUNS = 20
STALE_TTL_FACTOR = 3
MAX_DATA_AGE_S = 14_400

PERSISTENT_CELL_DEG = 0.005
PERSISTENT_MIN_DAYS = 45

SENSOR_FAMILIES = (
    # id, name, prefix, precision_m, ttl_seconds, critical, max_data_age_seconds
    ("firms_viirs", "NASA FIRMS · VIIRS", "VIIRS", 375.0, 600, True, 43_200),
    ("firms_modis", "NASA FIRMS · MODIS", "MODIS", 1000.0, 600, False, 43_200),
    ("seviri", "EUMETSAT LSA-SAF · SEVIRI", "SEVIRI", 3000.0, 900, False, 7_200),
)

DISCLAIMER = (
    "Detecciones satelitales de anomalías térmicas y partes oficiales. No es "
    "información oficial de emergencias. Ante una emergencia, 112."
)
