"""Timestamps, ages and ISO text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_Z = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, ISO_Z)


def hhmm_timestamp(date_text: Column, hhmm: Column) -> Column:
    """Acquisition date plus an HHMM number without leading zeros, as UTC."""
    padded = F.lpad(F.trim(hhmm.cast("string")), 4, "0")
    return F.try_to_timestamp(
        F.concat(F.date_format(date_text.cast("date"), "yyyy-MM-dd"), padded),
        F.lit("yyyy-MM-ddHHmm"),
    )


def madrid_to_utc(text: Column) -> Column:
    """Local d/m/Y H:M:S text; unreadable text gives null."""
    return F.to_utc_timestamp(
        F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm:ss")), "Europe/Madrid"
    )


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def age_days(iso_text: Column, now: Column) -> Column:
    return F.bround(seconds_between(now, F.try_to_timestamp(iso_text)) / 86_400.0, 1)


def whole_seconds(later: Column, earlier: Column) -> Column:
    """Age in whole seconds, never negative."""
    secs = ((F.unix_micros(later) - F.unix_micros(earlier)) / 1e6).cast("long")
    return F.when(secs < 0, F.lit(0).cast("long")).otherwise(secs)
