"""Invariants, publication guards and the health of the sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from firespark import config as C
from firespark.functions import geo, times

REQUIRED = ("id", "origin", "satellite_confirmed", "official_confirmed")
SAMPLE = 5


class PublicationAborted(RuntimeError):
    """Nothing may be published; the message lists every reason."""


def _flag(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def rules(columns: list[str]) -> list[tuple[int, str, Column]]:
    """``(invariant, name, violated)`` for the columns present."""
    sat, off = _flag("satellite_confirmed"), _flag("official_confirmed")
    out = [
        (2, "incidente sin origen", ~(sat | off)),
        (3, "origin incoherente con los flags", F.col("origin").eqNullSafe("ambos") != (sat & off)),
        (3, "origin fuera del vocabulario", ~F.coalesce(F.col("origin").isin(*C.VALID_ORIGINS), F.lit(False))),
    ]
    if {"first_detected", "last_detected"} <= set(columns):
        out.append((4, "ventana temporal invertida", F.col("first_detected") > F.col("last_detected")))
    if {"lat", "lon"} <= set(columns):
        out.append((5, "geometría fuera de España", ~geo.in_box(F.col("lat"), F.col("lon"), C.PUBLISH_BOX)))
        out[-1] = (*out[-1][:2], F.coalesce(out[-1][2], F.lit(True)))
    if "position_precision_m" in columns:
        out.append((6, "precisión no positiva", ~F.coalesce(F.col("position_precision_m") > 0, F.lit(False))))
    if "n_hotspots" in columns:
        none = F.coalesce(F.col("n_hotspots"), F.lit(0)) == 0
        out.append((7, "incidente satelital sin hotspots", none & ~F.col("origin").eqNullSafe("oficial")))
    if "status" in columns:
        status = F.col("status")
        out.append((8, "incendio extinguido publicado", status == "extinguido"))
        out.append((8, "status fuera del vocabulario", ~status.isin(*C.VALID_PUBLISHED_STATUS)))
        out.append((9, "estado afirmado sin parte oficial", status.isNotNull() & ~off))
    return out


def violations(incidents: DataFrame) -> DataFrame:
    """``(invariant, name, n, sample)``: every broken rule, nothing when all hold.

    Rows are tagged with the rules they break in one pass; only broken rows go on.
    """
    missing = [c for c in REQUIRED if c not in incidents.columns]
    if missing:
        return incidents.sparkSession.createDataFrame(
            [(0, "esquema incompleto", 1, ", ".join(missing))], "invariant int, name string, n long, sample string"
        )
    tags = [
        F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(i).alias("invariant"), F.lit(name).alias("name")))
        for i, name, broken in rules(incidents.columns)
    ]
    tagged = incidents.select("id", F.explode(F.array_compact(F.array(*tags))).alias("r")).select("r.*", "id")
    repeated = incidents.groupBy("id").agg(F.count("*").alias("k")).where("k > 1")
    doubled = repeated.select(
        F.lit(1).alias("invariant"), F.lit("id duplicado").alias("name"), "id", "k"
    )
    broken = tagged.withColumn("k", F.lit(1).cast("long")).unionByName(doubled)
    w = Window.partitionBy("invariant", "name").orderBy("id")
    first = (
        broken.select("invariant", "name", "id")
        .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= SAMPLE)
        .groupBy("invariant", "name")
        .agg(F.array_join(F.array_sort(F.collect_list("id")), ", ").alias("sample"))
    )
    counts = broken.groupBy("invariant", "name").agg(F.sum("k").alias("n"))
    return counts.join(first, ["invariant", "name"]).select("invariant", "name", "n", "sample")


def validate_or_abort(incidents: DataFrame) -> None:
    """Raise with the full list of violations; at most one row per rule reaches the driver."""
    found = violations(incidents).orderBy("invariant", "name").collect()
    if found:
        lines = [f"[invariante {r.invariant}] {r.name}: {r.n} · {r.sample}" for r in found]
        raise PublicationAborted("\n".join(lines))


# --- Emptiness -----------------------------------------------------------------


def last_runs(runs: DataFrame, keep: int = C.RUN_HISTORY) -> DataFrame:
    return runs.orderBy(F.desc("at")).limit(keep)


def median_of_runs(runs: DataFrame) -> DataFrame:
    recent = last_runs(runs).where(F.col("hotspots").isNotNull())
    return recent.agg(
        F.count("*").alias("ejecuciones"), F.coalesce(F.median("hotspots"), F.lit(0.0)).alias("mediana")
    )


def emptiness(current: DataFrame, runs: DataFrame) -> DataFrame:
    """``current(hotspots)`` against the median of the last runs."""
    threshold = F.col("mediana") * F.lit(1.0 - C.EMPTINESS_DROP_RATIO)
    past = median_of_runs(runs)
    told = current.withColumns(
        {"mediana": past.select("mediana").scalar(), "ejecuciones": past.select("ejecuciones").scalar()}
    )
    return told.select(
        "hotspots", "mediana", "ejecuciones",
        ((F.col("mediana") >= C.MIN_MEDIAN_RUNS) & (F.col("hotspots") <= threshold)).alias("vaciado_sospechoso"),
    )


def abort_if_empty(hotspots: DataFrame, stage: str) -> None:
    if hotspots.isEmpty():
        raise PublicationAborted(f"no detections after {stage}")


# --- Health --------------------------------------------------------------------

HEALTH_RANK = {"error": 0, "stale": 1, "disabled": 2, "ok": 3}


def _whole_hours(seconds: Column) -> Column:
    return F.bround(seconds / 3600.0, 0).cast("long").cast("string")


def source_health(sources: DataFrame, now: Column) -> DataFrame:
    """Add ages, ``status`` and ``stale_reason`` to one row per source.

    Needs ``configured, error, last_success_at, latest_data_at, ttl_seconds,
    max_data_age_seconds``.
    """
    aged = sources.withColumns(
        {
            "age_seconds": times.whole_seconds(now, F.col("last_success_at")),
            "data_age_seconds": times.whole_seconds(now, F.col("latest_data_at")),
        }
    )
    old_data = F.coalesce(F.col("data_age_seconds") > F.col("max_data_age_seconds"), F.lit(False))
    silent = F.col("age_seconds") > F.col("ttl_seconds") * C.STALE_TTL_FACTOR
    status = (
        F.when(~F.col("configured"), "disabled")
        .when(F.col("error").isNotNull() | F.col("age_seconds").isNull(), "error")
        .when(silent | old_data, "stale")
        .otherwise("ok")
    )
    minutes = F.bround(F.col("age_seconds") / 60.0, 0).cast("long").cast("string")
    reason = F.when(
        F.col("status") == "stale",
        F.when(
            old_data,
            F.concat(F.lit("responde, pero sin datos nuevos desde hace "), _whole_hours(F.col("data_age_seconds")), F.lit(" h")),
        ).otherwise(F.concat(F.lit("sin respuesta correcta desde hace "), minutes, F.lit(" min"))),
    )
    return aged.withColumn("status", status).withColumn("stale_reason", reason)


def health_order() -> list[Column]:
    from firespark.functions.text import lookup

    return [lookup(HEALTH_RANK, F.col("status")), F.col("name")]


def degraded(health: DataFrame, worst_age_s: DataFrame) -> DataFrame:
    """One row ``(degraded, degraded_reason)``; ``worst_age_s`` is a single value."""
    broken = F.col("critical") & F.col("status").isin("error", "stale")
    named = F.when(broken, F.concat(F.col("name"), F.lit(" ("), F.col("status"), F.lit(")")))
    summary = health.agg(F.array_sort(F.collect_list(named)).alias("_broken"))
    sources = F.when(
        F.size("_broken") > 0,
        F.concat(F.lit("fuentes críticas sin datos recientes: "), F.array_join("_broken", ", ")),
    )
    late = F.when(
        F.col("worst") > C.MAX_DATA_AGE_S,
        F.concat(
            F.lit("el dato más antiguo tiene "), F.format_number(F.col("worst") / 3600.0, 1),
            F.lit(" h (umbral: 4 h)"),
        ),
    )
    reason = F.concat_ws("; ", sources, late)
    return summary.withColumn("worst", worst_age_s.scalar()).select(
        (reason != "").alias("degraded"), F.nullif(reason, F.lit("")).alias("degraded_reason")
    )
